"""Many tokens at once as one array of code points, so that chains and scores are array operations."""

from __future__ import annotations

import re

import numpy as np

#: Characters that are worked on at a time: few enough for a core's cache.
CHARACTERS = 1 << 17
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(0x110000, -1, np.int32)


def folded(codes: np.ndarray) -> np.ndarray:
    """Lower-cased code points, each for itself (the first one where lower-casing gives several)."""
    out = _FOLD[codes]
    if len(out) and out.min() < 0:
        for c in np.unique(codes[out < 0]).tolist():
            _FOLD[c] = ord(chr(c).lower()[0])
        out = _FOLD[codes]
    return out


class Flat:
    """Tokens in a row, each between two spaces and one (they hold none themselves): code points, where each token's spaces start, the
    kinds of character, and of each place its kind. changed: the tokens that aren't what they were before, if this is what a chain made."""

    def __init__(self, codes: np.ndarray, start: np.ndarray, changed: np.ndarray | None = None):
        self.codes, self.start, self.changed = codes, start, changed
        there = np.zeros(int(codes.max()) + 1, bool)
        there[codes] = True
        self.kinds = np.flatnonzero(there)
        index = np.zeros(len(there), np.int32)
        index[self.kinds] = np.arange(len(self.kinds))
        self.of = index[codes]

    @classmethod
    def of_tokens(cls, tokens: list[str]) -> Flat:
        text = "  " + "   ".join(tokens) + " "
        size = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 3
        return cls(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32), np.cumsum(size) - size)

    def tokens(self) -> list[str]:
        return self.codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")[2:-1].split("   ")

    def token(self) -> np.ndarray:
        """Of each place the number of its token."""
        return np.repeat(np.arange(len(self.start)), np.diff(self.start, append=len(self.codes)))

    def some(self, which: np.ndarray) -> Flat:
        """The tokens of a mask."""
        if which.all():
            return self
        size = np.diff(self.start, append=len(self.codes))
        kept = size[which]
        return Flat(self.codes[np.repeat(which, size)], np.cumsum(kept) - kept)

    def any(self, marked: np.ndarray) -> np.ndarray:
        """Whether each token has a marked place."""
        return np.logical_or.reduceat(marked, self.start)

    def letters(self) -> np.ndarray:
        """Whether each token has a letter beyond ASCII, or a C1 control between two letters."""
        listed = [chr(c) for c in self.kinds.tolist()]
        out = self.any(np.array([c > "\x7f" and c.isalpha() for c in listed], bool)[self.of])
        c1 = (self.kinds > 0x7F) & (self.kinds < 0xA0)
        if c1.any():
            letter, c1 = np.array([bool(_LETTER.match(c)) for c in listed], bool)[self.of], c1[self.of]
            c1[1:-1] &= letter[:-2] & letter[2:]
            out |= self.any(c1)
        return out

    def replaced(self, at: np.ndarray, size: np.ndarray, by: np.ndarray) -> Flat:
        """With single characters `by` instead of the `size` ones from each of the places `at` (rising, apart)."""
        codes = self.codes.copy()
        codes[at] = by
        drop = np.concatenate([at[size > k] + k for k in range(1, int(size.max()))]) if size.max() > 1 else at[:0]
        keep = np.ones(len(codes), bool)
        keep[drop] = False
        drop.sort()
        changed = np.zeros(len(self.start), bool)
        changed[np.searchsorted(self.start, at, "right") - 1] = True
        return Flat(codes[keep], self.start - np.searchsorted(drop, self.start), changed)


def utf8_undone(flat: Flat, byte: np.ndarray) -> Flat | None:
    """Valid UTF-8 sequences among the bytes of the places (0: none) become their characters; None if there are none."""
    lead = np.flatnonzero(byte >= 0xC2)
    lead = lead[byte[lead] < 0xF5]
    if not len(lead):
        return None
    b = byte.astype(np.int32)  # tokens end with a space, so what follows a place by less than three is there or of no use
    b = np.concatenate([b, np.zeros(3, np.int32)])
    first, x, y, z = (b[lead + k] for k in range(4))
    n = 2 + (first >= 0xE0) + (first >= 0xF0)
    tail = lambda v: (v >= 0x80) & (v < 0xC0)
    good = tail(x) & ((n < 3) | tail(y)) & ((n < 4) | tail(z))
    x, y, z = x & 63, y & 63, z & 63
    new = np.where(n == 2, (first & 31) << 6 | x, np.where(n == 3, (first & 15) << 12 | x << 6 | y, (first & 7) << 18 | x << 12 | y << 6 | z))
    good &= np.where(n == 2, True, np.where(n == 3, (new >= 0x800) & ((new < 0xD800) | (new > 0xDFFF)), (new >= 0x10000) & (new < 0x110000)))
    if not good.any():
        return None
    return flat.replaced(lead[good], n[good], new[good].astype(np.int32))


#: What runs that were met lately are decoded to ('' if they can't be), up to so many a charset.
RUNS = 100_000
_RUNS: dict[str, dict[bytes, str]] = {}
RUN = re.compile(rb"[\x80-\xff][\x40-\x7e\x80-\xff]+")


def runs_undone(flat: Flat, byte: np.ndarray, charset: str) -> Flat | None:
    """Runs that start with a high byte are decoded, each as a whole if it can be; None if none can. byte: of each place, 0 where it has none."""
    known = _RUNS.setdefault(charset, {})
    at, end, made = [], [], []
    for m in RUN.finditer(byte.tobytes()):
        run = m[0]
        new = known.get(run)
        if new is None:
            try:
                new = run.decode(charset)
            except UnicodeDecodeError:
                new = ""
            if len(known) >= RUNS:
                known.clear()
            known[run] = new
        if new:
            made.append(new)
            at.append(m.start())
            end.append(m.end())
    if not at:
        return None
    at, end, size = np.array(at), np.array(end), np.fromiter(map(len, made), np.int64, len(made))
    length = np.ones(len(byte), np.int64)
    inside = np.zeros(len(byte) + 1, np.int64)
    np.add.at(inside, at, 1)
    np.add.at(inside, end, -1)
    inside = np.cumsum(inside)[:-1] > 0
    length[inside] = 0
    length[at] = size
    where = np.cumsum(length) - length
    codes = np.empty(int(length.sum()), np.int32)
    codes[where[~inside]] = flat.codes[~inside]
    codes[np.repeat(where[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = np.frombuffer("".join(made).encode("utf-32-le"), np.int32)
    changed = np.zeros(len(flat.start), bool)
    changed[np.searchsorted(flat.start, at, "right") - 1] = True
    return Flat(codes, where[flat.start], changed)
