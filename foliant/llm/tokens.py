"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once per worker.

Encoding is unchanged by cutting a text in front of white space that follows other text and,
where the tokenizer's own pre-tokenizer parts them too, between ASCII letters, digits and marks.
An Arrow batch of texts is cut by offsets into its buffer, its pieces are dictionary-encoded, and
only distinct pieces are looked up in the worker's memory; new ones go to the library. Taking
the ids of the pieces by their dictionary numbers gives the ids of the batch in one buffer.
Texts with unusual white space, or with the spelling of an added token, are given to the
library whole, so ids are those of `encode(text, add_special_tokens=False)` in every case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from .words import WHITE, binary_array, text_buffer

#: Pieces kept by one worker; beyond that the older half is dropped.
MAX_PIECES = 600_000
#: Bytes of text that are cut and encoded at a time.
GROUP_BYTES = 4_000_000
#: Byte classes: 1 white space, 2 letters, 3 digits, 4 marks but the apostrophe, 0 all others.
_CLASS = np.zeros(256, np.uint8)
for _number, _members in enumerate((WHITE, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"0123456789", b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"), 1):
    _CLASS[list(_members)] = _number
#: One word of Latin letters, with or without a space in front.
_LATIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_PROBES = [b"hello", b" hello", b"Capital", b" \xc3\x9cber", b" na\xc3\xafvet\xc3\xa9", b"\xc3\x9f", b" unlikelyword", b" A", b" CAPS"]
#: Control separators, next line, and the Unicode spaces, by their first bytes and in full (fixed values).
_MAYBE_UNUSUAL = (b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_UNUSUAL = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


@lru_cache(maxsize=4)
def id_type(path: str) -> str:
    """The numpy type of this tokenizer's ids: unsigned, little-endian, of 16 bits where they suffice."""
    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: visible ones stand for themselves, the others follow code point 255."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def piece_starts(body: np.ndarray, fine: bool) -> np.ndarray:
    """Whether a piece may begin at each byte: at white space after other text; if fine, also between letters, digits and marks."""
    kind = _CLASS[body]
    begins = np.zeros(len(body), bool)
    left, right = kind[:-1], kind[1:]
    begins[1:] = (right == 1) & (left != 1)
    if fine:
        begins[1:] |= (left > 1) & (right > 1) & (left != right)
    return begins


class PieceEncoder:
    """encode(texts) for one tokenizer file."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype(id_type(path))
        # an added token may match before the text is folded or after
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces: dict[bytes, bytes] = {}
        self.drops_space, self.folds_case = not self._plain(" "), self._plain("Ab") == self._plain("ab")
        self.cuts, self.fine = (self._parts_at_cuts(fine) for fine in (False, True))
        # one word of letters is one unit of the vocabulary's model, which alone is asked then
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = {b: c for b, c in _byte_letters().items() if b != 10}
        self.zero = self.words.encode("0", add_special_tokens=False).ids
        self.quick = len(self.zero) == 1 and self._encode_words(_PROBES) == self._encode(_PROBES)

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _parts_at_cuts(self, fine: bool) -> bool:
        """Whether the pre-tokenizer begins or ends a unit at each cut of a sample text."""
        if self.tokenizer.pre_tokenizer is None:
            return False
        sample = "Ab, cd12.5e (f-g)h\t\ti  j\n\nk-3 #4, l.\n m<n>o_p: 'q' r;s!t?u=v+w|x$y%z&7@8*9~0^[a]{b}/c\\\"d\" `e` "
        units = {x for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(sample) for x in span}
        at = np.flatnonzero(piece_starts(np.frombuffer(sample.encode(), np.uint8), fine)).tolist()
        return all(x in units for x in at)

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.type).tobytes() for e in found]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """ids of words of letters, read as one text with a digit behind each, by which they are told apart."""
        text = b"\n0\n".join([*words, b""])
        if self.drops_space:
            text = text.replace(b" ", b"")
        if self.folds_case:
            text = text.decode().lower().encode()
        ids = np.array(self.words.encode_batch_fast([text.decode("latin-1").translate(self.letters)], add_special_tokens=False)[0].ids, self.type)
        ends = self.type.itemsize * np.flatnonzero(ids == self.zero[0])
        starts = np.concatenate([[0], ends + self.type.itemsize])
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=False)]

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        if not self.quick:
            return self._encode(pieces)
        match = _LATIN.fullmatch
        simple = [match(p) is not None for p in pieces]
        words = iter(self._encode_words([p for p, s in zip(pieces, simple, strict=True) if s]))
        rest = iter(self._encode([p for p, s in zip(pieces, simple, strict=True) if not s]))
        return [next(words if s else rest) for s in simple]

    def _odd(self, body: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Numbers of the texts that are not cut."""
        if not self.cuts:
            return np.arange(len(starts) - 1)
        data = body.tobytes()
        folded = data.lower() if self.added else b""
        maybe = [x for x in _MAYBE_UNUSUAL if x in data]
        added = [x for x in self.added if x in folded]
        if not maybe and not added:
            return np.empty(0, np.int64)
        at = [m.start() for m in _UNUSUAL.finditer(data)] if maybe else []
        at += [m.start() for x in added for m in re.finditer(re.escape(x), folded)]
        return np.unique(np.searchsorted(starts, np.array(at, np.int64), "right") - 1)

    def _group(self, body: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = np.zeros(len(body) + 1, bool)
        odd = np.empty(0, np.int64)
        if len(body):
            begins[:-1] = piece_starts(body, self.fine)
            odd = self._odd(body, starts)
        for i in odd:
            begins[starts[i] : starts[i + 1]] = False
        begins[starts] = True
        cuts = np.flatnonzero(begins)  # an empty text has no piece
        if len(cuts) < 2:
            return np.empty(0, self.type), np.zeros(len(starts), np.int64)
        coded = binary_array(body, cuts).dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        whole = {bytes(body[starts[i] : starts[i + 1]]) for i in odd}
        known = list(map(self.pieces.get, names))
        new = [i for i, x in enumerate(known) if x is None]
        if new:
            asked = [names[i] for i in new]
            if whole:  # long, and hardly met again
                texts = [x for x in asked if x in whole]
                asked = [x for x in asked if x not in whole]
                met = dict(zip(texts, self._encode(texts), strict=True))
                new = [i for i in new if (x := met.get(names[i])) is None or known.__setitem__(i, x)]
            fresh = self._encode_pieces(asked)
            for i, x in zip(new, fresh, strict=True):
                known[i] = x
            if len(self.pieces) > MAX_PIECES:
                self.pieces = dict(islice(self.pieces.items(), len(self.pieces) // 2, None))
            self.pieces.update(zip(asked, fresh, strict=True))
        taken = pa.array(known, pa.large_binary()).take(coded.indices)
        ids, ends = text_buffer(taken)
        first = np.searchsorted(cuts, starts)  # of each text's pieces; an empty text's is the next one's
        return ids.view(self.type), ends[first] // self.type.itemsize

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, starts) of groups of whole texts in order: starts of each text's ids, and the end of the last's.

        texts: binary, without nulls. A group holds about GROUP_BYTES of text, or one longer text.
        """
        body, starts = text_buffer(texts)
        at = 0
        while at < len(starts) - 1:
            stop = max(at + 1, int(np.searchsorted(starts, starts[at] + GROUP_BYTES, "right")) - 1)
            yield self._group(body[starts[at] : starts[stop]], starts[at : stop + 1] - starts[at])
            at = stop

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as bytes of the encoder's type."""
        groups = self.encode(pa.array(texts, pa.large_binary()))
        return [x.tobytes() for ids, starts in groups for x in np.split(ids, starts[1:-1])]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for this file; workers are reused, so pieces carry over between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, starts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """encode()'s group with the end id behind each text."""
    lengths = np.diff(starts)
    out = np.full(len(ids) + len(lengths), end_id, ids.dtype)
    placed = np.ones(len(out), bool)
    ends = np.cumsum(lengths + 1)
    placed[ends - 1] = False
    out[placed] = ids
    return out, np.concatenate([[0], ends])
