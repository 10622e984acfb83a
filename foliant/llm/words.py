"""Words of an Arrow batch of texts, each distinct word handed to Python once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: ASCII white space.
WHITE = b" \t\n\r\x0b\x0c"


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array without nulls, and where each text begins in them, with the end of the last."""
    wide = texts.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, 8 * wide.offset)
    data = wide.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_array(body: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The pieces of body between neighbouring cuts."""
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(body)])


def coded_words(texts: pa.Array, table: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, number of each word of all texts in order, where each text's words begin, with the end).

    table: what each byte becomes, as in bytes.translate; a byte that becomes 32 separates words.
    """
    body, offsets = text_buffer(texts)
    body = np.frombuffer(table, np.uint8)[body]
    inside = body != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(body)]
    begins[at] = inside[at]  # texts lie side by side without a separator
    kept = np.cumsum(inside) - inside  # bytes of words before each place
    firsts = np.flatnonzero(begins)
    if not len(firsts):
        return [], np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
    coded = binary_array(body[inside], np.append(kept[firsts], kept[-1] + inside[-1])).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.searchsorted(firsts, offsets)


#: Bytes as they are, white space as one of its kind.
WHITE_TABLE = bytes(32 if c in WHITE else c for c in range(256))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """XXH3 of each white-space-separated word of all texts in order, and where each text's words begin, with the end."""
    names, numbers, starts = coded_words(texts, WHITE_TABLE)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))[numbers], starts


def grouped(texts: pa.Array, group_bytes: int = 8_000_000):
    """Slices of the array of about group_bytes, or one longer text."""
    offsets = text_buffer(texts)[1]
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + group_bytes, "right")) - 1)
        yield texts.slice(at, stop - at)
        at = stop
