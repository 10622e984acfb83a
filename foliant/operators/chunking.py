"""Markdown chunks with headings, code fences kept whole, overlap, and offsets into the source.

Splitting carries an overlap from chunk to chunk, so it runs in Python over whole texts, a few at a
time; everything after it is DataFrame work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from foliant.functions import text as X

MAX_TOKENS, OVERLAP_RATIO, MIN_SECTION_TOKENS = 256, 0.35, 10
SEPARATORS = ("\n\n", "\n", ". ", " ")
_HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.M)
_FENCE = re.compile(r"^```", re.M)
CHUNK = "text string, heading string, chunk_index int, char_start int, char_end int, token_count int"
#: Bytes of texts that are split at a time, but for single texts.
SLICE_BYTES = 1 << 20


def tokens(text: str) -> int:
    return int(len(text.split()) * X.TOKENS_PER_WORD)


def fences(text: str) -> list[tuple[int, int]]:
    """Spans of fenced code, from the opening mark to the end of the closing line; an open one runs to the end."""
    marks = [m.start() for m in _FENCE.finditer(text)]
    spans = []
    for opening, closing in zip(marks[::2], marks[1::2], strict=False):
        stop = text.find("\n", closing)
        spans.append((opening, stop if stop >= 0 else len(text)))
    if len(marks) % 2:
        spans.append((marks[-1], len(text)))
    return spans


def pieces(text: str, base: int, limit: int, overlap: int, code: list[tuple[int, int]]) -> list[tuple[str, int]]:
    """(piece, absolute start): parts between the first separator found, gathered up to the limit, `overlap` characters repeated."""
    separator = next((s for s in SEPARATORS if s in text), None)
    if tokens(text) <= limit or separator is None:
        return [(text, base)]
    first, *rest = text.split(separator)
    done, held, start = [], first, base
    for part in rest:
        grown, stop = held + separator + part, start + len(held)
        if tokens(grown) <= limit or any(a <= stop <= b for a, b in code):
            held = grown
            continue
        done.append((held, start))
        tail = held[len(held) - overlap :] if overlap < len(held) else held
        held, start = tail + separator + part, stop - len(tail)
    return [*done, (held, start)]


def sections(text: str, least: int) -> list[tuple[str, str, int]]:
    """(heading, text, start): a tiny section is put in front of the next one, under that one's heading."""
    found = list(_HEADING.finditer(text))
    stops = [m.start() for m in found[1:]] + [len(text)]
    raw = [(m[2].strip(), text[m.start() : stop], m.start()) for m, stop in zip(found, stops, strict=True)]
    if text[: found[0].start()].strip():
        raw.insert(0, ("(preamble)", text[: found[0].start()], 0))
    out, waiting, waiting_from = [], "", 0
    for k, (heading, body, start) in enumerate(raw):
        if k < len(raw) - 1 and tokens(body) < least:
            waiting_from = waiting_from if waiting else start
            waiting += body + "\n"
        else:
            out.append((heading, waiting + body, waiting_from if waiting else start))
            waiting = ""
    return out


def chunk_text(text: str | None, limit: int = MAX_TOKENS, ratio: float = OVERLAP_RATIO, least: int = MIN_SECTION_TOKENS) -> list[dict]:
    """Chunks of one text; none for null or blank text."""
    if not text or not text.strip():
        return []
    code, overlap = fences(text), int(int(limit * ratio) / X.TOKENS_PER_WORD * 5)
    headed = _HEADING.search(text) is not None
    out: list[dict] = []
    for heading, body, start in sections(text, least) if headed else [("(no heading)", text, 0)]:
        for k, (piece, at) in enumerate(pieces(body, start, limit, overlap, code)):
            if piece.strip():  # without headings the index counts blank pieces too
                out.append({"text": piece.strip(), "heading": heading, "chunk_index": len(out) if headed else k, "char_start": at, "char_end": at + len(piece), "token_count": tokens(piece)})
    return out


def slices(sizes: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of rows, each of about so many bytes at most or a single larger row more."""
    runs = np.cumsum(sizes) // most
    starts = np.flatnonzero(np.diff(runs, prepend=-1))
    yield from zip(starts.tolist(), np.diff(np.append(starts, len(sizes))).tolist(), strict=True)


def chunks(docs: DataFrame, limit: int = MAX_TOKENS, ratio: float = OVERLAP_RATIO, least: int = MIN_SECTION_TOKENS) -> DataFrame:
    """Rows with doc_path and text -> their other columns with text, heading, chunk_index, char_start, char_end, token_count and content_hash of each chunk.

    Documents are dealt by their path, for a table's files may hold very many in one row group, which is one task's.
    """
    rest = [c for c in docs.columns if c != "text"]
    piece = T.StructType.fromDDL(CHUNK)
    made = T.StructType([*docs.select(*rest).schema.fields, *piece.fields])

    def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(piece)
        for part in parts:
            texts = part.column("text")
            for at, n in slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)):
                cut = [chunk_text(t, limit, ratio, least) for t in texts.slice(at, n).to_pylist()]
                flat = [c for some in cut for c in some]
                if not flat:
                    continue
                owner = pa.array(np.repeat(np.arange(at, at + n), [len(some) for some in cut]))
                columns = [part.column(c).take(owner) for c in rest] + [pa.array([c[name] for c in flat], shape.field(name).type) for name in piece.names]
                yield pa.RecordBatch.from_arrays(columns, names=made.names)

    cut = docs.select(*rest, "text").repartition("doc_path").mapInArrow(split, made)
    return cut.withColumn("content_hash", X.content_hash(F.col("text")))
