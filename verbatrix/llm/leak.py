"""Evaluation passages inside a training corpus.

Method: a broadcast hash set of the test items' normalised n-grams; the corpus' word windows are scanned against it and every
hit is verified word by word; leaked spans or whole documents can then be removed. Item sets too large for a broadcast are joined by hash: a
Bloom filter of their n-grams, of bounded size, is broadcast instead, and only windows that pass it are shuffled.

Words are the maximal runs of letters and digits of the lower-cased text. A document leaks an item if they share `n`
consecutive words, or all the item's words consecutively where it has fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialise

#: Items with at most so many words are broadcast. A word begins at most one n-gram, so they take less than 100 MB in a worker.
BROADCAST_WORDS = 500_000
#: Bits of the largest Bloom filter (64 MB), and of one slice of it, as it is built.
MOST_BITS, SLICE = 29, 23

WORD = regex.compile(r"[\p{L}\p{N}]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """The words of a text; none of a null one."""
    return WORD.findall(text.lower()) if text else []


def mixed(ids: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values of word numbers."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive word numbers."""
    out = np.zeros(len(ids) - n + 1, np.uint64)
    values = mixed(ids)
    for i in range(n):
        out = out * _MULTIPLIER + values[i : i + len(out)]
    return out


class Passages:
    """The n-grams of all test items, searchable; arrays and one dictionary of words, so that it can be broadcast."""

    def __init__(self, items: list[tuple], n: int):
        self.keys = [key for key, _ in items]
        self.number: dict[str, int] = {}
        by_size: dict[int, list] = {}
        for at, (_, text) in enumerate(items):
            w = np.array([self.number.setdefault(x, len(self.number) + 1) for x in words(text)], np.int32)
            if size := min(n, len(w)):
                by_size.setdefault(size, []).append((np.lib.stride_tricks.sliding_window_view(w, size), window_hashes(w, size), at))
        #: size -> hashes in order, the words behind each, and the item it is of
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, parts in sorted(by_size.items()):
            hashes = np.concatenate([h for _, h, _ in parts])
            order = np.argsort(hashes, kind="stable")
            of = np.repeat([at for *_, at in parts], [len(h) for _, h, _ in parts])
            self.grams[size] = hashes[order], np.concatenate([g for g, _, _ in parts])[order], of[order]

    def hits(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
        """For each size of n-gram: text, first word, size, and item (its place among keys) of each window that is an n-gram of an item."""
        get = self.number.get
        each = [[get(x, 0) for x in words(t)] for t in texts]
        sizes = np.array([len(x) for x in each], np.int64)
        ids = np.fromiter((x for e in each for x in e), np.int32, int(sizes.sum()))
        start = np.concatenate([[0], np.cumsum(sizes)])
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for k, (hashes, grams, of) in self.grams.items():
            if len(ids) < k:
                continue
            # windows of known words that lie in one text
            at = np.flatnonzero(unknown[k:] == unknown[:-k])
            row = np.searchsorted(start, at, "right") - 1
            inside = at + k <= start[row + 1]
            at, row = at[inside], row[inside]
            if not len(at):
                continue
            h = window_hashes(ids, k)[at]
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            count = hi - lo
            at, row, lo = (np.repeat(x, count) for x in (at, row, lo))
            gram = lo + np.arange(len(lo)) - np.repeat(np.cumsum(count) - count, count)
            same = np.ones(len(at), bool)
            for i in range(k):
                same &= ids[at + i] == grams[gram, i]
            yield row[same], at[same] - start[row[same]], k, of[gram[same]]


def _passages(items: DataFrame, n: int, most: int):
    """The n-grams of items (item, text) as a broadcast, or None if they have more than `most` words."""
    total = items.agg(F.sum(F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))) + 1)).first()[0] or 0
    if total > most:
        return None
    rows = [(r[0], r[1]) for r in items.filter("text is not null").select("item", "text").toLocalIterator()]
    return items.sparkSession.sparkContext.broadcast(Passages(rows, n))


def _windows(text: str | None, sizes: list[int], known: dict[str, int]) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """(size, words, hash of each window) of a text, by hashes of its words."""
    w = words(text)
    if len(known) > 500_000:
        known.clear()
    ids = np.array([known[x] if x in known else known.setdefault(x, xxhash.xxh64_intdigest(x)) for x in w], np.uint64)
    for k in sizes:
        if 0 < k <= len(w):
            yield k, w, window_hashes(ids, k).view(np.int64)


def _item_grams(items: DataFrame, n: int) -> DataFrame:
    """(gram, k, words, item): the n-grams of each item, of its own size."""
    kind = items.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            for r, t in enumerate(b.column("text").to_pylist()):
                for k, w, h in _windows(t, [min(n, len(words(t)))], known):
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.repeat(pa.scalar(k, pa.int32()), len(h)), pa.array([" ".join(w[i : i + k]) for i in range(len(h))]), pa.repeat(b.column("item")[r], len(h))], ["gram", "k", "words", "item"])

    return items.filter("text is not null").select("item", "text").mapInArrow(run, f"gram bigint, k int, words string, item {kind}")


def _places(h: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in a Bloom filter."""
    x = h.view(np.uint64)
    return (x & np.uint64(mask)).astype(np.int64), ((x * _MULTIPLIER >> np.uint64(33)) & np.uint64(mask)).astype(np.int64)


def _bloom(grams: DataFrame) -> np.ndarray:
    """A Bloom filter of the n-grams, ten bits for each of them up to its largest size; built slice by slice in the cluster."""
    bits = min(MOST_BITS, max(SLICE, int(np.ceil(np.log2(10 * grams.count() + 1)))))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(_places(b.column("gram").to_numpy(), (1 << bits) - 1)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> SLICE).astype(np.int32)), pa.array((at & ((1 << SLICE) - 1)).astype(np.int32))], ["slice", "bit"])

    def packed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(1 << SLICE, bool)
        for b in batches:
            on[b.column("bit").to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(on).tobytes()], pa.binary())], ["slice", "bits"])

    parts = grams.select("gram").mapInArrow(places, "slice int, bit int").distinct().groupBy("slice").applyInArrow(packed, "slice int, bits binary").collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts:
        out[r["slice"] << (SLICE - 3) : (r["slice"] + 1) << (SLICE - 3)] = np.frombuffer(r["bits"], np.uint8)
    return out


def _joined_hits(texts: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """(key, pos, k, item) of each window of the texts (key, text) that is an n-gram of an item, by a join on hashes. Only windows that pass
    the Bloom filter are shuffled: the true ones and about one in thirty of the others, more where the filter is full."""
    grams = materialise(_item_grams(items, n), "grams")
    sizes = sorted(r[0] for r in grams.select("k").distinct().collect())
    shared = texts.sparkSession.sparkContext.broadcast(_bloom(grams))
    kind = texts.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        bloom = shared.value
        mask = 8 * len(bloom) - 1
        for b in batches:
            for r, t in enumerate(b.column("text").to_pylist()):
                for k, w, h in _windows(t, sizes, known):
                    one, two = _places(h, mask)
                    at = np.flatnonzero((bloom[one >> 3] >> (7 - (one & 7)).astype(np.uint8)) & (bloom[two >> 3] >> (7 - (two & 7)).astype(np.uint8)) & 1)
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [pa.repeat(b.column("key")[r], len(at)), pa.array(at.astype(np.int32)), pa.array(h[at]), pa.repeat(pa.scalar(k, pa.int32()), len(at)), pa.array([" ".join(w[i : i + k]) for i in at.tolist()])],
                            ["key", "pos", "gram", "k", "words"],
                        )

    seen = texts.filter("text is not null").select("key", "text").mapInArrow(run, f"key {kind}, pos int, gram bigint, k int, words string")
    return seen.join(grams, ["gram", "k", "words"]).select("key", "pos", "k", "item")


def find_leaks(docs: DataFrame, items: DataFrame, n: int = 10, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_key, item_key), one row for each document and item that share a passage.

    Null texts and texts without words neither leak nor are leaked. Repeated rows are one case. Empty tables give no rows;
    other columns are ignored whatever their names.
    The items' n-grams are broadcast while their texts have at most `broadcast_words` words (the bound of the broadcast's size). The scan of the
    documents is then narrow: no shuffle but that of the found cases. Beyond, n-grams are joined by hash and verified by their words; a Bloom
    filter of at most 64 MB keeps all but few of the documents' windows out of the shuffle.
    """
    ds = docs.select(F.col(doc_key).alias("key"), F.col(text).alias("text"))
    its = items.select(F.col(item_key).alias("item"), F.col(text).alias("text"))
    doc_t, item_t = ds.schema["key"].dataType.simpleString(), its.schema["item"].dataType.simpleString()
    shared = _passages(its, n, broadcast_words)
    b_item = to_arrow_type(its.schema["item"].dataType)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.stack([row, of], axis=1) for row, _, _, of in shared.value.hits(b.column("text").to_pylist())]
            cases = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(cases[:, 0])), pa.array([shared.value.keys[i] for i in cases[:, 1].tolist()], b_item)], ["key", "item"])

    if shared is not None:
        found = ds.filter("text is not null").mapInArrow(scan, f"key {doc_t}, item {item_t}").distinct()
    else:
        found = _joined_hits(ds, its, n).select("key", "item").distinct()
    return found.select(F.col("key").alias(doc_key), F.col("item").alias(item_key))


def _without(text: str, found: list[tuple[int, int]]) -> str:
    """A text without runs of words, given by the numbers of their first word and of the word after their last. Lower-casing may change a
    text's length: the character counts that each one of the lower-cased text comes from."""
    low = text.lower()
    at = [m.span() for m in WORD.finditer(low)]
    of = range(len(text)) if len(low) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()]
    drop = np.zeros(len(text), bool)
    for a, e in found:
        drop[of[at[a][0]] : of[at[e - 1][1] - 1] + 1] = True
    return "".join(c for c, d in zip(text, drop) if not d)


def remove_leaks(docs: DataFrame, items: DataFrame, n: int = 10, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", spans: bool = True, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """docs without what leaks: the leaked spans cut out of the text (the characters from the first to the last word of each
    run of hits), or, with spans=False, whole documents left out. All columns and rows stay otherwise; null texts stay as they are.
    Above broadcast_words, the spans of each distinct leaking text are found by the join and joined back by a hash of the text.
    """
    if not spans:
        return docs.join(find_leaks(docs, items, n, doc_key, item_key, text, broadcast_words), doc_key, "left_anti")
    its = items.select(F.col(item_key).alias("item"), F.col(text).alias("text"))
    shared = _passages(its, n, broadcast_words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text).to_pylist()
            runs: dict[int, list[tuple[int, int]]] = {}
            for row, pos, k, _ in shared.value.hits(texts):
                for r, p in zip(row.tolist(), pos.tolist()):
                    runs.setdefault(r, []).append((p, p + k))
            for r, found in runs.items():
                texts[r] = _without(texts[r], found)
            i = b.schema.get_field_index(text)
            yield b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type))

    if shared is not None:
        return docs.mapInArrow(cut, docs.schema)

    def cut_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x if s is None else _without(x, [(e["pos"], e["pos"] + e["k"]) for e in s]) for x, s in zip(b.column(text).to_pylist(), b.column(mark).to_pylist())]
            b = b.drop_columns([mark])
            i = b.schema.get_field_index(text)
            yield b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type))

    mark, hashed = "_spans_of_leaks", "_hash_of_text"
    distinct = docs.select(F.md5(F.col(f"`{text}`")).alias("key"), F.col(f"`{text}`").alias("text")).filter("text is not null").dropDuplicates(["key"])
    runs = _joined_hits(distinct, its, n).select("key", "pos", "k").distinct().groupBy(F.col("key").alias(hashed)).agg(F.collect_list(F.struct("pos", "k")).alias(mark))
    return docs.withColumn(hashed, F.md5(F.col(f"`{text}`"))).join(runs, hashed, "left").select(*(docs[f"`{c}`"] for c in docs.columns), mark).mapInArrow(cut_joined, docs.schema)
