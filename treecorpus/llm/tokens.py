"""Vectorised pre-tokenisation and piece-wise encoding for byte-level BPE.

Many texts are pre-tokenised at once on their code points with numpy: one class per code point
(letter, number, white space, other), and a boundary wherever the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

starts a match. The pieces then go through an exact dictionary, so each distinct piece is encoded
once per batch and mostly found in a bounded cache.
"""

from __future__ import annotations

import functools
import unicodedata
from array import array
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 0, 1, 2, 3, 4
#: The code points that the pattern's \s matches.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe in a piece of its own.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
#: Distinct pieces in each of the two generations that a worker remembers; about 50 MB each.
REMEMBERED = 250_000
#: Code points of a text that are scanned at once.
LONGEST = 1 << 21


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point; unassigned ones are unknown, as engines may differ on them."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([UNKNOWN if (c := unicodedata.category(chr(i))) == "Cn" else kinds.get(c[0], OTHER)
                      for i in range(0x110000)], dtype=np.uint8)
    table[WHITE] = SPACE
    return table


def boundaries(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places where a piece starts, given the code points of several texts and where each text starts.

    ``starts`` lists the first place of every non-empty text, ascending.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    kind[kind == UNKNOWN] = OTHER
    first = np.zeros(n, bool)
    first[starts] = True
    last = np.zeros(n, bool)  # the last place of a text
    last[-1] = True
    last[starts[1:] - 1] = True
    changed = first.copy()
    changed[1:] |= kind[1:] != kind[:-1]
    white, blank = kind == SPACE, points == 32
    begins = changed.copy()
    # A run of white space gives its last character to what follows, unless the text ends there.
    before_word = np.zeros(n, bool)
    before_word[:-1] = white[:-1] & ~white[1:] & ~last[:-1]
    begins |= before_word
    # A blank before a word belongs to it.
    begins[1:] &= ~(before_word[:-1] & blank[:-1])
    # Endings after an apostrophe that no blank precedes and that starts a run.
    mark = (points == 39) & changed & ~last
    mark[1:] &= first[1:] | ~blank[:-1]
    for at in np.flatnonzero(mark):
        for ending in ENDINGS:
            stop = at + 1 + len(ending)
            if stop <= n and not last[at:stop - 1].any() and all(points[at + 1 + j] == ord(c) for j, c in enumerate(ending)):
                begins[at + 1:stop] = False
                if stop < n:
                    begins[stop] = True
                break
    return np.flatnonzero(begins)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def trusted(text: str, whole_end: bool) -> np.ndarray:
    """Boundaries of a part of a text that do not depend on what follows its end.

    A scan is a function of the text from where it starts; a match that ends inside the part was
    ended by a character of the part. Only the match that touches a cut end may be another.
    """
    points = code_points(text)
    at = boundaries(points, np.zeros(min(1, len(points)), np.int64))
    return at if whole_end else at[:-1] if len(at) > 1 else at[:0]


def parts(text: str, size: int):
    """A text in parts of about ``size`` code points that are cut where a piece starts."""
    start = 0
    while len(text) - start > size:
        reach = size
        while start + reach < len(text):
            at = trusted(text[start:start + reach], False)
            if len(at) and at[-1]:
                yield text[start:start + int(at[-1])]
                start += int(at[-1])
                break
            reach *= 2
        else:
            break
    yield text[start:]


class PieceEncoder:
    """Encodes texts piece by piece; ``encode`` turns distinct pieces into lists of ids.

    Texts with unassigned code points, or for which ``whole`` holds, go through ``encode`` as they are.
    """

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int]]], whole: Callable[[str], bool] = lambda text: False):
        self.encode, self.whole = encode, whole
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = list(map(known.get, pieces))
        missing = [i for i, x in enumerate(out) if x is None]
        new = []
        for i in missing:
            kept = older.get(pieces[i])
            if kept is None:
                new.append(pieces[i])
            else:
                known[pieces[i]] = kept
        known.update((p, array("I", ids).tobytes()) for p, ids in zip(new, self.encode([x.decode() for x in new])))
        for i in missing:
            out[i] = known[pieces[i]]
        return out

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text. The texts together should be some MB at most; longer ones are cut."""
        if any(len(x) > LONGEST for x in texts):
            cutted = [[x] if self.whole(x) else list(parts(x, LONGEST)) for x in texts]
            return [np.concatenate([self._some([p])[0] for p in pieces]) for pieces in cutted]
        return self._some(texts)

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        points = [code_points(x) for x in texts]
        plain = []
        for i, x in enumerate(points):
            if not len(x):
                continue
            if (classes()[x] == UNKNOWN).any() or self.whole(texts[i]):
                out[i] = np.asarray(self.encode([texts[i]])[0], dtype="<u4")
            else:
                plain.append(i)
        if not plain:
            return out
        sizes = np.array([len(points[i]) for i in plain])
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        every = np.concatenate([points[i] for i in plain])
        at = boundaries(every, starts)
        # Pieces as slices of one UTF-8 buffer: byte offsets of the boundaries.
        width = (every >= 0x80).astype(np.int8) + (every >= 0x800) + (every >= 0x10000) + np.int8(1)
        byte_at = np.zeros(len(every) + 1, np.int32)
        np.cumsum(width, out=byte_at[1:])
        offsets = np.r_[byte_at[at], byte_at[-1:]]
        data = "".join(texts[i] for i in plain).encode()
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        which = pieces.indices.to_numpy(zero_copy_only=False)
        _, spots, raw = pieces.dictionary.buffers()
        raw, spots = raw.to_pybytes(), np.frombuffer(spots, np.int32, len(pieces.dictionary) + 1).tolist()
        ids = self._ids([raw[a:b] for a, b in zip(spots, spots[1:])])
        counts = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        flat, begin = np.frombuffer(b"".join(ids), "<u4"), np.r_[0, np.cumsum(counts)[:-1]]
        n = counts[which]
        end = np.cumsum(n)
        tokens = flat[np.repeat(begin[which] - (end - n), n) + np.arange(end[-1])]
        piece_of = np.searchsorted(at, np.r_[starts, len(every)])
        cuts = np.r_[0, end][piece_of]
        for i, a, b in zip(plain, cuts[:-1], cuts[1:]):
            out[i] = tokens[a:b]
        return out
