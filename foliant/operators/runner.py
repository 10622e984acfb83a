"""Models in tasks: loaded once a worker, fed batches of rows of like length, halved where memory runs out."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Rows = list[tuple]
#: What load() gives: results for a list of rows, in their order.
Work = Callable[[Rows], Sequence]

_LOADED: dict[str, Work] = {}
#: Rows of one Arrow batch that are taken at a time at most, if a model's batch is no larger.
SLICE_ROWS = 1024


def out_of_memory(error: BaseException) -> bool:
    """A MemoryError, or an error of a model library that says so."""
    return isinstance(error, MemoryError) or "out of memory" in str(error).lower()


def batches(sizes: list[int], rows: int, size: int) -> Iterator[list[int]]:
    """Places of rows, the longest first, in batches of at most so many rows and, but for single rows, so much length in all."""
    some, held = [], 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if some and (len(some) == rows or held + sizes[i] > size):
            yield some
            some, held = [], 0
        some.append(i)
        held += sizes[i]
    if some:
        yield some


def answered(work: Work, rows: Rows, batch: int, length: int) -> list:
    """work's results for rows, in their order. A batch that memory is too short for is halved, down to one row, which must do."""
    out: list = [None] * len(rows)
    waiting = list(batches([sum(len(x) for x in row if isinstance(x, str)) for row in rows], batch, length))[::-1]
    while waiting:
        some = waiting.pop()
        try:
            found = work([rows[i] for i in some])
        except Exception as error:
            if len(some) == 1 or not out_of_memory(error):
                raise
            waiting += [some[len(some) // 2 :], some[: len(some) // 2]]
            continue
        if len(found) != len(some):
            raise ValueError(f"a model gave {len(found)} results for {len(some)} rows")
        for i, x in zip(some, found, strict=True):
            out[i] = x
    return out


@dataclass(frozen=True)
class Model:
    """A column function of one or more columns, worked out by what load() gives.

    load runs once in each Python worker. A row with a null gives null and is not shown to the model. batch and length bound the rows
    and the characters that it is given at once. The results must not depend on which rows share a batch.
    """

    load: Callable[[], Work]
    returns: str
    batch: int = 64
    length: int = 1_000_000
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def work(self) -> Work:
        if self.key not in _LOADED:
            _LOADED[self.key] = self.load()
        return _LOADED[self.key]

    def __call__(self, *columns: Column | str) -> Column:
        def answers(series: tuple[pd.Series, ...]) -> pd.Series:
            rows = list(zip(*(s.tolist() for s in series), strict=True))
            there = [i for i, row in enumerate(rows) if all(x is not None for x in row)]
            out = [None] * len(rows)
            for i, x in zip(there, answered(self.work(), [rows[i] for i in there], self.batch, self.length), strict=True):
                out[i] = x
            return pd.Series(out, dtype=object)

        def sliced(series: tuple[pd.Series, ...]) -> Iterator[pd.Series]:
            step = max(SLICE_ROWS, self.batch)
            for at in range(0, max(len(series[0]), 1), step):
                yield answers(tuple(s.iloc[at : at + step] for s in series))

        def one(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in parts:
                yield from sliced((s,))

        def many(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for some in parts:
                yield from sliced(some)

        return F.pandas_udf(one if len(columns) == 1 else many, self.returns)(*columns)
