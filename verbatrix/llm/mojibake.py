"""Texts decoded with the wrong charset: found and restored.

Method: a smoothed character n-gram model of the clean records scores, for every passage, each candidate chain (encode with the
charset it was wrongly read in, decode with the right one); the likeliest is accepted if it beats the text as it stands by a
margin that was validated on all clean records, each held out of the model that judges it, and on their lines, garbled by every chain that can be
undone on them.

Chains act on non-ASCII characters only, so a passage's score is that of its non-ASCII tokens, and tokens are scored once a
worker, many at a time. Texts are tried whole, then by line, then by sentence, so garbled parts of otherwise clean texts are found; double
garbling is undone step by step. What every part of a text says against every chain is summed for many texts at once; only texts of which some
part speaks for a chain are looked at one by one.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .flat import CHARACTERS, Flat, folded, runs_undone, utf8_undone

LOST = "�"
#: A worker forgets its tokens when they are more, or have more characters.
MOST_TOKENS, MOST_CHARACTERS = 100_000, 20_000_000
#: What a chain's result loses for every kind of character that no clean record has, beyond those it had before, and the margin: values to
#: choose from by validation, and those of the first model, by which clean records are chosen before anything can be validated.
STRANGE_GRID, MARGIN_GRID = (4.0, 8.0, 12.0), (2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0)
FIRST_STRANGE, FIRST_MARGIN = 8.0, 6.0
#: A larger model isn't broadcast but written to a file that every executor fetches once and its workers map.
MODEL_BYTES = 64 << 20
#: Texts whose parts are summed at a time.
TEXTS = 256
TOKEN = re.compile(r"[^ \t\r\n]+")
C1 = re.compile(r"[\x80-\x9f]")
LINES = re.compile(r"(?<=\n)")
SENTENCES = re.compile(r"(?<=[.!?。！？])(?=\s|[^\x00-\x7f])")

# Charsets in which UTF-8 is often read, and pairs (read in, written in) of single- and multi-byte charsets.
UTF8_READ_IN = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "koi8_r", "cp866", "iso8859_2", "iso8859_15", "cp1254")
SWAPPED = (
    ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "cp866"), ("cp1252", "cp1250"), ("cp1252", "mac_roman"), ("cp1252", "cp850"),
    ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1251", "cp1252"), ("cp1250", "cp1252"),
    ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"),
)
MULTIBYTE = (("cp1252", "gbk"), ("cp1252", "shift_jis"), ("cp1252", "euc_jp"))


def high_bytes(charset: str) -> dict[str, int]:
    """The byte of each character that bytes from 0x80 are read as; undefined bytes are read as C1 controls. cp1252 and Latin-1 are
    one: what they have between 0x80 and 0x9f both map."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(charset)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
        if charset == "cp1252":
            out[chr(b)] = b
    return out


def bytes_of(flat: Flat, byte: dict[str, int]) -> np.ndarray:
    """The byte of each place, 0 where it has none."""
    return np.array([byte.get(chr(c), 0) for c in flat.kinds.tolist()], np.uint8)[flat.of]


def exchanged(flat: Flat, table: dict[int, str]) -> Flat | None:
    """With single characters exchanged; None if there is none to exchange."""
    new = np.array([ord(table[c]) if c in table else c for c in flat.kinds.tolist()], np.int32)
    other = new != flat.kinds
    return Flat(new[flat.of], flat.start, flat.any(other[flat.of])) if other.any() else None


class Utf8ReadIn:
    """UTF-8 read in a single-byte charset: valid sequences become their characters, the rest stays."""

    def __init__(self, charset: str):
        self.name, self.byte = f"utf-8 as {charset}", high_bytes(charset)
        of = defaultdict(list)
        for c, b in self.byte.items():
            of["x" if b < 0xC0 else "2" if 0xC2 <= b < 0xE0 else "3" if 0xE0 <= b < 0xF0 else "4" if 0xF0 <= b < 0xF5 else "-"].append(c)
        tail, two, three, four = ("[" + "".join(map(re.escape, of[k])) + "]" for k in "x234")
        self.pattern = re.compile(f"{two}{tail}|{three}{tail}{{2}}|{four}{tail}{{3}}")
        self.char = {b: c for c, b in self.byte.items() if ord(c) > 0x9F or b not in [x for y, x in self.byte.items() if y != c]}
        self.table = {b: self.char.get(b, chr(b)) for b in range(0x80, 0x100)}

    def _one(self, m: re.Match) -> str:
        try:
            return bytes(self.byte[c] for c in m[0]).decode()
        except UnicodeDecodeError:
            return m[0]

    def fix(self, text: str) -> str:
        return self.pattern.sub(self._one, text)

    def garble(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.table)

    def fix_all(self, flat: Flat) -> Flat | None:
        return utf8_undone(flat, bytes_of(flat, self.byte))


class Swapped:
    """One single-byte charset read in another: characters are exchanged one by one."""

    def __init__(self, read: str, written: str):
        self.name, self.table = f"{written} as {read}", {}
        for c, b in high_bytes(read).items():
            try:
                right = bytes([b]).decode(written)
            except UnicodeDecodeError:
                continue
            if right != c and ord(right) > 0x9F:
                self.table[ord(c)] = right
        self.back = {ord(r): chr(c) for c, r in self.table.items()}

    def fix(self, text: str) -> str:
        return text.translate(self.table)

    def fix_all(self, flat: Flat) -> Flat | None:
        return exchanged(flat, self.table)

    def garble(self, text: str) -> str:
        return text.translate(self.back)


class OnlyC1:
    """cp1252 read in Latin-1: only C1 controls are exchanged."""

    name = "cp1252 as latin-1"

    def __init__(self) -> None:
        self.table = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}

    def fix(self, text: str) -> str:
        return text.translate(self.table)

    def fix_all(self, flat: Flat) -> Flat | None:
        return exchanged(flat, self.table)

    def garble(self, text: str) -> str:
        return text.translate({ord(c): chr(b) for b, c in self.table.items()})


class Multibyte:
    """A multi-byte charset read in a single-byte one: runs of high bytes are decoded as a whole."""

    def __init__(self, read: str, written: str):
        self.name, self.written, self.byte = f"{written} as {read}", written, high_bytes(read)
        self.pattern = re.compile("[" + "".join(map(re.escape, self.byte)) + "][" + "".join(map(re.escape, self.byte)) + "\x40-\x7e]+")
        self.char = {b: c for c, b in self.byte.items()}

    def _one(self, m: re.Match) -> str:
        try:
            return bytes(self.byte.get(c, ord(c) if ord(c) < 0x80 else 0) for c in m[0]).decode(self.written)
        except UnicodeDecodeError:
            return m[0]

    def fix(self, text: str) -> str:
        return self.pattern.sub(self._one, text)

    def garble(self, text: str) -> str:
        return text.encode(self.written, "ignore").decode("latin-1").translate(self.char)

    def fix_all(self, flat: Flat) -> Flat | None:
        byte = bytes_of(flat, self.byte)
        ascii_ = flat.codes < 0x80
        byte[ascii_] = flat.codes[ascii_]
        return runs_undone(flat, byte, self.written)


class Twice:
    """A chain done twice."""

    def __init__(self, chain):  # noqa: ANN001
        self.name, self.chain = f"twice {chain.name}", chain

    def fix(self, text: str) -> str:
        return self.chain.fix(self.chain.fix(text))

    def garble(self, text: str) -> str:
        return self.chain.garble(self.chain.garble(text))

    def fix_all(self, flat: Flat) -> Flat | None:
        once = self.chain.fix_all(flat)
        return (once and self.chain.fix_all(once)) or once


def all_chains() -> list:
    utf8 = [Utf8ReadIn(c) for c in UTF8_READ_IN]
    return [OnlyC1(), *utf8, *map(Twice, utf8), *(Swapped(a, b) for a, b in SWAPPED), *(Multibyte(a, b) for a, b in MULTIBYTE)]


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and the length of each."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.fromiter(map(len, texts), np.int64, len(texts))


def _trigrams(codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed trigrams (21 bits a character) of tokens, each between two spaces and one, and how many each token has."""
    padded = np.full(len(codes) + 3 * len(size), 32, np.int64)
    start = np.cumsum(size) - size
    padded[np.arange(len(codes)) + np.repeat(3 * np.arange(len(size)) + 2, size)] = codes
    keys = (padded[:-2] << 42) | (padded[1:-1] << 21) | padded[2:]
    inside = np.ones(len(padded), bool)
    ends = start + size + 3 * np.arange(1, len(size) + 1)
    inside[ends - 2] = inside[ends - 1] = False  # trigrams over the border of two tokens
    return keys[inside[:-2]], size + 1


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes, size = _characters(texts)
    return _trigrams(folded(codes).astype(np.int64), size)


class CharModel:
    """Witten-Bell smoothed character trigrams of non-ASCII tokens, from packed trigrams in order and their counts; case is folded."""

    def __init__(self, three: np.ndarray, n: np.ndarray):
        self.three, self.n = three, n
        self.pair, first = np.unique(three >> 21, return_index=True)  # the first two characters, what follows them, and how many kinds
        self.after2, self.kinds2 = self._sums(n, first), np.diff([*first, len(three)])
        self.two, of = np.unique(three & ((1 << 42) - 1), return_inverse=True)
        self.n2 = np.bincount(of, weights=n, minlength=len(self.two))
        self.first, first = np.unique(self.two >> 21, return_index=True)
        self.after1, self.kinds1 = self._sums(self.n2, first), np.diff([*first, len(self.two)])
        self.one, of = np.unique(self.two & ((1 << 21) - 1), return_inverse=True)
        self.n1 = np.bincount(of, weights=self.n2, minlength=len(self.one))
        self.total = float(self.n1.sum()) + 1
        self.known = np.zeros(0x110000, bool)
        self.known[self.one] = self.known[32] = True
        self.seen, self.seen_logs = np.full(1 << 20, -1), np.zeros(1 << 20)  # trigrams met lately by hash, and their logarithms

    @staticmethod
    def _sums(n: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.add.reduceat(n, first).astype(float) if len(first) else np.zeros(0)

    @staticmethod
    def _at(keys: np.ndarray, of: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        if not len(keys):
            return [np.zeros(len(of))] * len(values)
        at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
        there = keys[at] == of
        return [np.where(there, v[at], 0.0) for v in values]

    def logs(self, three: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of the last character of each trigram after the others."""
        p = self._at(self.one, three & ((1 << 21) - 1), self.n1)[0] / self.total * 0.95 + 0.05 / self.total
        after, kinds = self._at(self.first, (three >> 21) & ((1 << 21) - 1), self.after1, self.kinds1)
        p = np.where(kinds > 0, (self._at(self.two, three & ((1 << 42) - 1), self.n2)[0] + kinds * p) / np.maximum(after + kinds, 1), p)
        after, kinds = self._at(self.pair, three >> 21, self.after2, self.kinds2)
        return np.log(np.where(kinds > 0, (self._at(self.three, three, self.n)[0] + kinds * p) / np.maximum(after + kinds, 1), p))

    def logs_in_row(self, three: np.ndarray) -> np.ndarray:
        """The same for the trigrams at all places of a row of tokens; 0 for those over the border of two tokens, which end with two spaces."""
        at = ((three.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).view(np.int64)
        out = self.seen_logs[at]
        new = np.flatnonzero(self.seen[at] != three)
        if len(new):
            kinds, of = np.unique(three[new], return_inverse=True)
            logs = np.where((kinds & ((1 << 42) - 1)) == (32 << 21 | 32), 0.0, self.logs(kinds))
            out[new] = logs[of]
            self.seen[at[new]], self.seen_logs[at[new]] = three[new], out[new]
        return out

    def strange(self, token: np.ndarray, codes: np.ndarray, tokens: int) -> np.ndarray:
        """How many kinds of folded characters that no clean record has each token has; token and codes: where there are such."""
        return np.bincount(np.unique((token << 21) | codes) >> 21, minlength=tokens)

    def scores_in_row(self, flat: Flat) -> tuple[np.ndarray, np.ndarray]:
        """scores() of a row of tokens."""
        kinds = folded(flat.kinds).astype(np.int64)
        codes = kinds[flat.of]
        logs = np.zeros(len(codes))
        logs[2:] = self.logs_in_row((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])
        odd = np.flatnonzero(~self.known[kinds][flat.of])
        return np.add.reduceat(logs, flat.start), self.strange(flat.token()[odd], codes[odd], len(flat.start))

    def scores(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token, given by its folded characters, the natural logarithm of its probability, and how many kinds of character it has that
        no clean record has."""
        if not len(size):
            return np.zeros(0), np.zeros(0, np.int64)
        keys, n = _trigrams(codes, size)
        kinds, of = np.unique(keys, return_inverse=True)
        token = np.repeat(np.arange(len(size)), size)
        kind, of_kind = np.unique(codes, return_inverse=True)
        strange = ~np.isin(kind, self.one)[of_kind]
        odd = np.unique((token[strange] << 21) | codes[strange]) >> 21
        return np.add.reduceat(self.logs(kinds)[of], np.cumsum(n) - n), np.bincount(odd, minlength=len(size))


class Restorer:
    """Finds and undoes garbling with a model, a margin, and a price of strange characters."""

    def __init__(self, model: CharModel, margin: float, strange: float = FIRST_STRANGE):
        self.model, self.margin, self.strange, self.chains = model, margin, strange, all_chains()
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.gains = np.zeros((1024, len(self.chains)), np.float32)
        self.more = np.zeros((1024, len(self.chains)), np.uint8)  # kinds of strange characters that a chain adds
        self.characters = 0

    def price(self, strange: float) -> None:
        """Another price of strange characters for all that has been learnt."""
        self.gains += (self.strange - strange) * self.more
        self.strange = strange

    def learnt(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By how much each chain makes each of the tokens likelier, and how many kinds of strange characters it adds: a row for each."""
        gains, more = np.zeros((len(tokens), len(self.chains)), np.float32), np.zeros((len(tokens), len(self.chains)), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
        a = 0
        while a < len(tokens):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHARACTERS, "right")))
            self.learn_row(Flat.of_tokens(tokens[a:b]), gains[a:b], more[a:b])
            a = b
        return gains, more

    def learn_row(self, flat: Flat, gains: np.ndarray, more: np.ndarray) -> None:
        model, letters, token = self.model, flat.letters(), flat.token()
        fold = folded(flat.kinds).astype(np.int64)
        # different trigrams of kinds of character, which of them are where, and the different kinds of each token: chains that exchange single
        # characters are looked at by these
        k, bits = flat.of.astype(np.int64), 20
        tri, of = np.unique((k[:-2] << 2 * bits) | (k[1:-1] << bits) | k[2:], return_inverse=True)
        three = tri >> 2 * bits, (tri >> bits) & ((1 << bits) - 1), tri & ((1 << bits) - 1)
        pairs = np.unique((token << bits) | k)
        own, kind = pairs >> bits, pairs & ((1 << bits) - 1)

        def logs(codes: np.ndarray) -> np.ndarray:
            return model.logs_in_row((codes[three[0]] << 42) | (codes[three[1]] << 21) | codes[three[2]])

        def strange(codes: np.ndarray) -> np.ndarray:
            odd = np.flatnonzero(~model.known[codes][kind])
            return model.strange(own[odd], codes[kind[odd]], len(flat.start))

        def summed(of_tri: np.ndarray) -> np.ndarray:
            each = np.zeros(len(k))
            each[2:] = of_tri[of]
            return np.add.reduceat(each, flat.start)

        before, odd = logs(fold), strange(fold)
        now = summed(before)

        def put(i: int, rows: np.ndarray, gain: np.ndarray, extra: np.ndarray) -> None:
            more[rows, i] = np.clip(extra, 0, 255)
            gains[rows, i] = gain - self.strange * more[rows, i]

        once: dict[int, tuple[int, Flat | None]] = {}
        for i, c in enumerate(self.chains):
            if isinstance(c, (Swapped, OnlyC1)):
                new = np.array([ord(c.table[x]) if x in c.table else x for x in flat.kinds.tolist()], np.int64)
                if (new != flat.kinds).any():
                    new = folded(new).astype(np.int64)
                    rows = np.flatnonzero(letters) if isinstance(c, Swapped) else slice(None)
                    put(i, rows, summed(logs(new) - before)[rows], (strange(new) - odd)[rows])
                continue
            if isinstance(c, Twice):
                j, made = once[id(c.chain)]
                gains[:, i], more[:, i] = gains[:, j], more[:, j]
                made = made and c.chain.fix_all(made)
            else:
                made = c.fix_all(flat)
                once[id(c)] = i, made
            if made is not None:
                which = made.changed & letters if isinstance(c, Multibyte) else made.changed
                if which.any():
                    rows = np.flatnonzero(which)
                    score, added = model.scores_in_row(made.some(which))
                    put(i, rows, score - now[rows], added - odd[rows])

    def learn(self, tokens: list[str]) -> None:
        """Rows of gains for tokens (all different)."""
        if len(self.row) + len(tokens) > MOST_TOKENS or self.characters > MOST_CHARACTERS:
            self.forget()
        start = len(self.row)
        while len(self.gains) < start + len(tokens):
            self.gains, self.more = (np.concatenate([x, np.zeros_like(x)]) for x in (self.gains, self.more))
        self.gains[start : start + len(tokens)], self.more[start : start + len(tokens)] = self.learnt(tokens)
        self.row.update((t, start + k) for k, t in enumerate(tokens))
        self.characters += sum(map(len, tokens))

    def sums(self, units: list[list[str]]) -> np.ndarray:
        """What the tokens of each unit say for each chain."""
        new = {t for u in units for t in u if t not in self.row}
        if new:
            self.learn(sorted(new))
            if any(t not in self.row for u in units for t in u):  # it has forgotten
                self.learn(sorted({t for u in units for t in u if t not in self.row}))
        out = np.zeros((len(units), len(self.chains)))
        size = np.array([len(u) for u in units])
        at = np.array([self.row[t] for u in units for t in u], np.int64)
        some = np.flatnonzero(size)
        if len(some):
            out[some] = np.add.reduceat(self.gains[at].astype(np.float64), (np.cumsum(size) - size)[some], axis=0)
        return out

    @staticmethod
    def tokens(text: str) -> list[str]:
        return [t for t in TOKEN.findall(text) if not t.isascii()]

    def best(self, text: str) -> tuple[float, int]:
        """The likeliest chain of a text and what speaks for it."""
        total = self.sums([self.tokens(text)])[0]
        i = int(total.argmax())
        return float(total[i]), i

    def suspects(self, texts: list[str]) -> list[int]:
        """The texts of which the whole, a line or a sentence speaks for a chain by more than the margin; the others stay as they are."""
        units: list[list[str]] = []
        line_of: list[int] = []  # of each line its text
        at: list[int] = []  # of each line its unit
        rest: list[tuple[int, int]] = []  # text and unit of the sentences of lines that have several
        for k, text in enumerate(texts):
            for line in self.parts(text, 0):
                if line.isascii():
                    continue
                line_of.append(k)
                at.append(len(units))
                units.append(self.tokens(line))
                sentences = self.parts(line, 1)
                if len(sentences) > 1:
                    for x in sentences:
                        if not x.isascii():
                            rest.append((k, len(units)))
                            units.append(self.tokens(x))
        if not units:
            return []
        total = self.sums(units)
        high = total.max(axis=1) > self.margin
        found = {k for k, u in zip(line_of, at) if high[u]} | {k for k, u in rest if high[u]}
        own, first = np.unique(line_of, return_index=True)
        whole = np.add.reduceat(total[at], first, axis=0).max(axis=1) > self.margin
        return sorted(found | set(own[whole].tolist()))

    def restore_all(self, texts: list[str]) -> dict[int, str]:
        """The texts that have garbled parts, restored, by place."""
        out = {}
        for a in range(0, len(texts), TEXTS):
            some = texts[a : a + TEXTS]
            for k in self.suspects(some):
                y = self.restore(some[k])
                if y != some[k]:
                    out[a + k] = y
        return out

    def restore(self, text: str, level: int = 0) -> str:
        """The text with what is garbled in it restored."""
        if text.isascii():
            return text
        for _ in range(4):  # garbled more than once
            gain, i = self.best(text)
            if gain <= self.margin:
                break
            parts = self.parts(text, level)
            if len(parts) > 1:
                each = self.sums([self.tokens(p) for p in parts])
                if (each[:, i] < np.maximum(0.0, each.max(axis=1) - self.margin)).any():
                    break  # another chain, or none, is better for some part: part by part
            text = self.chains[i].fix(text)
        if level < 2:
            parts = self.parts(text, level)
            if len(parts) > 1 or level == 0:
                return "".join(self.restore(p, level + 1) for p in parts)
        return text

    @staticmethod
    def parts(text: str, level: int) -> list[str]:
        """The lines of a text, or (at level 1) the sentences of a line, with all their characters; deeper there are none."""
        return (LINES if level == 0 else SENTENCES).split(text)


def half(text: str) -> int:
    """The half of all texts that a text is of; equal texts are of one."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) & 1


def trigram_counts(src: DataFrame) -> DataFrame:
    """(gram, n, n0) over the non-ASCII tokens of rows (half, tokens); gram is packed; n0: of half 0. Summed in the tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            grams, n, n0 = [], [], []
            for of, counts in zip(tokens, (1, 0)):
                if of:
                    keys, size = _codes(list(of))
                    grams.append(keys)
                    n.append(np.repeat(np.fromiter(of.values(), np.int64, len(of)), size))
                    n0.append(n[-1] * counts)
                of.clear()
            kinds, at = np.unique(np.concatenate(grams), return_inverse=True)
            n, n0 = (np.bincount(at, weights=np.concatenate(x), minlength=len(kinds)).astype(np.int64) for x in (n, n0))
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n), pa.array(n0)], ["gram", "n", "n0"])

        for b in batches:
            for k, x in zip(b.column("half").to_pylist(), b.column("tokens").to_pylist()):
                tokens[k].update(x)
            if sum(map(len, tokens)) > 200_000:
                yield out()
        if any(tokens):
            yield out()

    return src.mapInArrow(count, "gram bigint, n bigint, n0 bigint").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("n0").alias("n0"))


def lines_of(src: DataFrame, clean: Callable) -> DataFrame:
    """(half, tokens): of each line of the texts that the function made by clean() leaves of a list, its non-ASCII tokens, if it has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = clean()
        for b in batches:
            rows = [(half(x), t) for x in good(b.column("text").to_pylist()) for line in x.split("\n") for t in [Restorer.tokens(line)] if t]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([t for _, t in rows], pa.list_(pa.string()))], ["half", "tokens"])

    return src.mapInArrow(run, "half int, tokens array<string>")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def collected(grams: DataFrame, n: Column) -> CharModel:
    """The model of written trigram counts: sixteen bytes a trigram, brought to the driver in ranges of a bounded number of them."""
    rows = grams.select("gram", n.alias("n")).filter("n > 0")
    slices = max(1, -(-rows.count() // 4_000_000))
    cuts = [int(x) for x in rows.approxQuantile("gram", [i / slices for i in range(1, slices)], 0.001)] if slices > 1 else []
    parts = []
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = rows if lo is None else rows.filter(F.col("gram") >= lo)
        got = (part if hi is None else part.filter(F.col("gram") < hi)).toArrow()
        keys, counts = (got.column(c).to_numpy().astype(np.int64) for c in ("gram", "n"))
        order = np.argsort(keys)
        parts.append((keys[order], counts[order]))
    return CharModel(*(np.concatenate(x) for x in zip(*parts)))


class Shared:
    """A restorer for all workers: broadcast, or, where its model is large, in files that every executor fetches once and workers map."""

    def __init__(self, spark, restorer: Restorer, model_bytes: int = MODEL_BYTES):  # noqa: ANN001
        self.how, self.key = (restorer.margin, restorer.strange), uuid.uuid4().hex
        arrays = restorer.model.three, restorer.model.n
        self.names: list[str] = []
        self.value = None
        if sum(a.nbytes for a in arrays) <= model_bytes:
            self.value = spark.sparkContext.broadcast(arrays)
            return
        folder = tempfile.mkdtemp(prefix="verbatrix-model-")  # the driver's copy, from which executors fetch
        for k, a in enumerate(arrays):
            self.names.append(f"{self.key}-{k}.npy")
            np.save(os.path.join(folder, self.names[-1]), a)
            spark.sparkContext.addFile(os.path.join(folder, self.names[-1]))

    def restorer(self) -> Restorer:
        """Built once a worker."""
        if self.key not in _READY:
            while len(_READY) > 1:  # those of both halves are used in turn
                _READY.pop(next(iter(_READY)))
            arrays = self.value.value if self.value is not None else [np.load(SparkFiles.get(n), mmap_mode="r") for n in self.names]
            _READY[self.key] = Restorer(CharModel(*arrays), *self.how)
        return _READY[self.key]


_READY: dict[str, Restorer] = {}


def train(docs: DataFrame, text: str = "text", at_once: int = 500_000, model_bytes: int = MODEL_BYTES) -> Restorer:
    """A restorer from the trigrams of all clean records. Its margin and price are validated on all of them: every record is judged by a model
    of the half of the records that it isn't of. They are then used with the model of all.

    Clean records are those without replacement characters and C1 controls which a first model, of all such records, leaves as they are.
    at_once: tokens that are judged at a time in a task (it bounds memory only)."""
    src = docs.select(F.col(text).alias("text")).filter(F.col("text").rlike(r"[^\x00-\x7f]"))
    plain = src.filter(~F.col("text").rlike(f"[\x80-\x9f{LOST}]"))
    first = Restorer(collected(materialise(trigram_counts(lines_of(plain, lambda: lambda texts: texts)), "first"), F.col("n")), FIRST_MARGIN)
    shared = Shared(docs.sparkSession, first, model_bytes)

    def clean():  # noqa: ANN202
        fixer = shared.restorer()

        def left(texts: list[str]) -> list[str]:
            bad = fixer.restore_all(texts)
            return [x for k, x in enumerate(texts) if k not in bad]

        return left

    lines = materialise(lines_of(plain, clean), "lines")
    grams = materialise(trigram_counts(lines), "trigrams")
    unseen = [Shared(docs.sparkSession, Restorer(collected(grams, n), 0.0), model_bytes) for n in (F.col("n") - F.col("n0"), F.col("n0"))]
    return Restorer(collected(grams, F.col("n")), *chosen(verdicts(lines, unseen, at_once)))


def undone(chain, tokens: list[str]) -> list[str]:  # noqa: ANN001
    """What a chain makes of tokens."""
    out: list[str] = []
    while len(out) < len(tokens):
        some = tokens[len(out) : len(out) + CHARACTERS // 32]
        made = chain.fix_all(Flat.of_tokens(some))
        out += some if made is None else made.tokens()
    return out


def judged(restorer: Restorer, tokens: list[str], at: np.ndarray, size: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
    """For no chain (-1) and each chain how often, by price and margin, some chain beats lines as they stand, garbled by this one; and how many
    lines that is, those that it changes and undoes. A line is given by the places of its tokens, in a row, their number, and how often it is there.
    Neither garbling nor its undoing crosses the ASCII space between tokens, so each different token is garbled and learnt once a chain."""
    start = np.cumsum(size) - size
    text = "\n".join(tokens)
    for i, c in [(-1, None), *enumerate(restorer.chains)]:
        made = tokens if c is None else c.garble(text).split("\n")
        lines = np.arange(len(size))
        if c is not None:
            other = np.fromiter((y != t for y, t in zip(made, tokens)), bool, len(tokens))
            if not other.any():
                continue
            back = np.fromiter((y == t for y, t in zip(undone(c, made), tokens)), bool, len(tokens))
            lines = np.flatnonzero(np.logical_and.reduceat(back[at], start) & np.logical_or.reduceat(other[at], start))
        if not len(lines):
            continue
        used = np.zeros(len(size), bool)
        used[lines] = True
        kinds, row = np.unique(at[np.repeat(used, size)], return_inverse=True)
        gains, more = restorer.learnt([made[k] for k in kinds.tolist()])
        n, of = size[lines], times[lines]
        over = np.zeros((len(STRANGE_GRID), len(MARGIN_GRID)), np.int64)
        ends = np.cumsum(n)
        a = 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + 50_000)))
            x, first = row[ends[a] - n[a] : ends[b - 1]], (ends[a:b] - n[a:b]) - (ends[a] - n[a])
            gain, extra = (np.add.reduceat(y[x], first, axis=0, dtype=np.float64) for y in (gains, more))
            for s, strange in enumerate(STRANGE_GRID):
                top = (gain + (restorer.strange - strange) * extra).max(axis=1)
                over[s] += of[a:b] @ (top[:, None] > np.array(MARGIN_GRID))
            a = b
        yield i, over, int(of.sum())


def verdicts(lines: DataFrame, unseen: list[Shared], at_once: int) -> dict[int, tuple[np.ndarray, int]]:
    """What judged() says of all lines (half, tokens), each by the model that hasn't seen its half, by chain. Summed before the shuffle.

    A task has lines of one half, and lines with the same longest token are in one task: equal lines are judged once, and a long token, which
    costs most and tends to be rare, is learnt once in all."""
    n = max(1, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple[list, list] = ([], [])
        size = [0, 0]

        def out(k: int) -> Iterator[pa.RecordBatch]:
            same = pa.compute.value_counts(pa.chunked_array(waiting[k]).combine_chunks())
            waiting[k].clear()
            size[k] = 0
            lists = pa.compute.split_pattern(same.field("values"), " ")
            coded = lists.flatten().dictionary_encode()
            of = np.asarray(lists.value_lengths()).astype(np.int64), np.asarray(same.field("counts")).astype(np.int64)
            for i, over, n in judged(unseen[k].restorer(), coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64), *of):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([n], pa.int64()), *(pa.array([int(x)], pa.int64()) for x in over.ravel())], names)

        for b in batches:
            for k in (0, 1):
                some = b.filter(pa.compute.equal(b.column("half"), k)).column("tokens")
                if len(some):
                    waiting[k].append(pa.compute.binary_join(some, " "))
                    size[k] += len(some.flatten())
                if size[k] > at_once:
                    yield from out(k)
        for k in (0, 1):
            if waiting[k]:
                yield from out(k)

    counts = [f"o{k}" for k in range(len(STRANGE_GRID) * len(MARGIN_GRID))]
    names = ["chain", "n", *counts]
    longest = F.expr("array_max(transform(tokens, t -> struct(length(t) as n, t as t)))").getField("t")
    lines = lines.repartitionById(2 * n, (F.col("half") * n + F.pmod(F.xxhash64(longest), F.lit(n))).cast("int"))
    each = lines.mapInArrow(run, "chain int, n bigint, " + ", ".join(f"{c} bigint" for c in counts))
    rows = each.groupBy("chain").agg(*(F.sum(c).alias(c) for c in names[1:])).collect()
    return {r["chain"]: (np.array([r[c] for c in counts]).reshape(len(STRANGE_GRID), -1), r["n"]) for r in rows}


def chosen(by: dict[int, tuple[np.ndarray, int]]) -> tuple[float, float]:
    """The margin and the price of strange characters that decide most right: clean lines as they are, and garbled ones as garbled, every chain
    counting alike however many lines it can be undone on."""
    if -1 not in by:
        return FIRST_MARGIN, FIRST_STRANGE
    false, lines = by[-1]
    missed = [1 - over / n for i, (over, n) in by.items() if i >= 0]
    # clean lines are the many: a false case weighs as ten missed ones
    wrong = 10 * false / lines + (sum(missed) / len(missed) if missed else 0)
    return min((round(float(wrong[s, m]), 9), abs(strange - FIRST_STRANGE), -margin, margin, strange) for s, strange in enumerate(STRANGE_GRID) for m, margin in enumerate(MARGIN_GRID))[3:]


def find_garbled(docs: DataFrame, key: str = "doc_id", text: str = "text", at_once: int = 500_000, restorer: Restorer | None = None, with_text: bool = False, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """(key, restored_h, and with_text the restored text): one row per document with garbled text.

    restored_h: the first 16 hex digits of the SHA-256 of the restored text in UTF-8, '' (and a null text) where characters were lost (the text has
    replacement characters), so the original can't come back. What isn't garbled stays as it is.
    Null, empty and plain ASCII texts are never garbled. Repeated rows give repeated cases; an empty table gives none; other columns are
    ignored whatever their names.

    The model counts the trigrams of all clean records, reduced before the shuffle, none left out; it is broadcast up to model_bytes and mapped from a
    file beyond. The margin is validated on all their lines, garbled by every chain, with models that haven't seen them. Then one narrow pass over the
    documents.
    """
    shared = Shared(docs.sparkSession, restorer or train(docs, text, at_once, model_bytes), model_bytes)
    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").rlike(r"[^\x00-\x7f]"))
    kind = src.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixer = shared.restorer()
        for b in batches:
            texts = b.column("text").to_pylist()
            lost = {k for k, x in enumerate(texts) if LOST in x}
            right = fixer.restore_all(["" if k in lost else x for k, x in enumerate(texts)])
            rows = sorted(lost | set(right))
            hashes = ["" if k in lost else digest(right[k]) for k in rows]
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(rows, pa.int64())), pa.array(hashes, pa.string()), pa.array([right.get(k) for k in rows], pa.string())], ["key", "restored_h", "restored"])

    out = src.mapInArrow(run, f"key {kind}, restored_h string, restored string").withColumnRenamed("key", key)
    return out if with_text else out.drop("restored")
