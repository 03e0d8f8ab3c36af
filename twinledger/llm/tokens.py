"""Token ids of whole texts, encoded once per distinct piece of text.

A tokenizer's file of the tokenizers library is loaded in each Python worker. Its
encoding never joins what stands before a run of white space with what stands after
the run's begin, so a text is cut there into units; a unit of a line feed or blank, a word of
Latin letters and sentence marks is cut into these parts, since no token spans two of them. The cuts of
many texts are found at once, equal pieces are told apart by Arrow's dictionary encoding, and only
distinct pieces are looked up; ids are then laid out by their codes. Words are one pre-token
each, so the file's model is asked directly for their ids. A worker's look-up table begins anew
at ``_UNITS`` entries and keeps one older generation: that bounds memory and changes no result.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_UNITS = 400_000
_LONGEST = 100  # bytes of a piece that is kept
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_BLANK, _FEED, _LETTER, _MARK, _OTHER = range(5)
#: White space other than blank and line feed, in any library's view: a text that has some is encoded as a whole.
_ODD_BLANK = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


def _kinds() -> np.ndarray:
    """The kind of each byte; those of two-byte letters are found by their neighbours."""
    kind = np.full(256, _OTHER, np.uint8)
    kind[32], kind[10] = _BLANK, _FEED
    kind[[b for b in range(128) if chr(b).isalpha()]] = _LETTER
    kind[list(b'!"#$%&()*+,-./:;=>?@[\\]^_`{|}~')] = _MARK  # an apostrophe may begin a word's ending
    return kind


_KIND = _kinds()


def _cuts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin; text i is ``raw[bounds[i]:bounds[i + 1]]``."""
    kind = _KIND[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[~np.isin(raw[lead + 1], (0x97, 0xB7))]  # the signs of multiplication and division
    kind[lead] = kind[lead + 1] = _LETTER
    white = kind <= _FEED
    first = np.zeros(len(raw), bool)
    first[1:] = white[1:] & ~white[:-1]
    first[bounds[:-1][bounds[:-1] < len(raw)]] = True
    units = np.flatnonzero(first)
    # What may follow inside a unit: a letter on white space, marks on letters.
    before, after = kind[:-1], kind[1:]
    parts = np.flatnonzero((before != after) & ~first[1:] & (after != _OTHER) & ((before == _FEED) | (after == _MARK))) + 1
    odd = white[:-1] & (after != _LETTER) | (before == _MARK) & (after == _LETTER) | (after == _OTHER)
    odd = np.concatenate([np.flatnonzero(odd & ~first[1:]) + 1, units[kind[units] == _OTHER]])
    whole = np.zeros(len(units), bool)
    whole[np.searchsorted(units, odd, "right") - 1] = True
    first[parts[~whole[np.searchsorted(units, parts, "right") - 1]]] = True
    return np.flatnonzero(first)


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: visible ones as themselves, the others as U+0100 and on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_SPELT = _byte_letters() | {10: "\n"}  # a line feed parts words here


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, with one tokenizer file.

    ``blanks`` says whether white space belongs to tokens and letters keep their case (byte-level
    vocabularies), or white space is dropped and letters are lower-cased (vocabularies with word ends).
    """

    def __init__(self, path: str, blanks: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.blanks = blanks
        self.units: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _words(self, words: list[bytes]) -> list[bytes]:
        """The ids of words, asked from the model."""
        joined = b"\n".join(words)
        if not self.blanks:
            joined = joined.replace(b" ", b"").decode().lower().encode()
        spelt = joined.decode("latin-1").translate(_SPELT).split("\n")
        tokenize = self.model.tokenize
        return [array("I", [t.id for t in tokenize(word)]).tobytes() for word in spelt]

    def _look_up(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces."""
        if len(self.units) > _UNITS:
            self.units, self.older = {}, self.units
        found = list(map(self.units.get, pieces))
        lacking = [i for i, ids in enumerate(found) if ids is None]
        words = []
        for i in lacking:
            found[i] = self.older.get(pieces[i])
            if found[i] is None and _WORD.fullmatch(pieces[i]):
                words.append(i)
            elif found[i] is None:
                found[i] = self.whole(pieces[i].decode("utf-8"))
        if words:
            for i, ids in zip(words, self._words([pieces[i] for i in words])):
                found[i] = ids
        self.units.update((pieces[i], found[i]) for i in lacking if len(pieces[i]) <= _LONGEST)
        return found

    def _laid_out(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after the other, and where each text's begin (one more at the end)."""
        buffer = b"".join(texts)
        bounds = np.cumsum([0] + [len(t) for t in texts])
        if not buffer:
            return np.zeros(0, "<u4"), bounds
        cuts = _cuts(np.frombuffer(buffer, np.uint8), bounds)
        offsets = np.append(cuts, len(buffer)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(buffer)]).dictionary_encode()
        found = self._look_up(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        codes = pieces.indices.to_numpy()
        sizes = size[codes]
        ends = np.append(0, np.cumsum(sizes))
        ids = flat[np.repeat((np.cumsum(size) - size)[codes] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(cuts, bounds)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        odd = [bool(_ODD_BLANK.search(text)) for text in texts]
        ids, at = self._laid_out([b"" if o else t.encode("utf-8", "replace") for t, o in zip(texts, odd)])
        for i, text in enumerate(texts):
            yield self.whole(text) if odd[i] else ids[at[i]:at[i + 1]].tobytes()


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, blanks: bool) -> Encoder:
    """This worker's encoder for a file."""
    if (path, blanks) not in _encoders:
        _encoders[path, blanks] = Encoder(path, blanks)
    return _encoders[path, blanks]


def in_blocks(texts: list[str], most: int) -> Iterator[slice]:
    """Slices of consecutive texts of at most ``most`` characters, or of one longer text."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))
