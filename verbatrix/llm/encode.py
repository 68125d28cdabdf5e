"""Token ids of a whole corpus by a public byte-level BPE vocabulary.

Method: overlapping chunk encoding. Texts up to `chunk` characters are one chunk and are encoded where they are read. Longer
ones are cut into chunks that overlap, spread over all tasks, and pre-tokenised and encoded each for itself. Two neighbours
are stitched at the first position of their overlap that is a pre-token boundary in both: the pattern looks only ahead, so
from there both go on alike, and everything a chunk did before its first such position is dropped. Where an overlap has none
(one run longer than the overlap), the text is encoded again in one go. Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the published pre-token pattern of this vocabulary.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_ENCODINGS: dict[str, object] = {}
_PATTERN = regex.compile(PRE_TOKEN)


def encoding(ranks: bytes):
    """The encoding of a vocabulary file's content, built once a worker."""
    key = hashlib.md5(ranks).hexdigest()
    if key not in _ENCODINGS:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _ENCODINGS[key] = tiktoken.Encoding(key, pat_str=PRE_TOKEN, mergeable_ranks=table, special_tokens={})
    return _ENCODINGS[key]


def lists(values: list[list[int]]) -> pa.ListArray:
    """Lists of int32 as one Arrow array, without a Python object a number."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.fromiter((x for v in values for x in v), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def chunk_tokens(text: str, last: bool, enc) -> tuple[list[int], list[int], list[int]]:
    """Pre-token boundaries of a chunk (its start and each pre-token's end), ids, and how many ids there are up to each boundary.
    What touches the end of a chunk that isn't the last is left out: the text beyond might change it."""
    ends = [m.end() for m in _PATTERN.finditer(text)]
    if not last:
        while ends and ends[-1] >= len(text) - 1:
            ends.pop()
    bounds, ids, count = [0], [], [0]
    for e in ends:
        ids += enc.encode_ordinary(text[bounds[-1] : e])
        bounds.append(e)
        count.append(len(ids))
    return bounds, ids, count


def stitch(parts: list[dict], enc) -> list[int]:
    """The ids of a text from its chunks, in order; each has at (where it starts), text, bounds, ids, count."""
    out: list[int] = []
    begin = 0  # the boundary of the chunk from which its ids count
    for a, b in zip(parts, [*parts[1:], None]):
        stop = len(a["bounds"]) - 1
        if b is not None:
            shift = b["at"] - a["at"]
            own = {p - shift: i for i, p in enumerate(a["bounds"]) if i >= begin and p >= shift}
            meet = next((i for i, p in enumerate(b["bounds"]) if p in own), None)
            if meet is None:  # a run longer than the overlap
                whole = parts[0]["text"]
                for x, y in zip(parts, parts[1:]):
                    whole += y["text"][x["at"] + len(x["text"]) - y["at"] :]
                return enc.encode_ordinary(whole)
            stop = own[b["bounds"][meet]]
        out += a["ids"][a["count"][begin] : a["count"][stop]]
        if b is not None:
            begin = meet
    return out


def encode_corpus(df: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, text: str = "text", key: str = "doc_id", chunk: int = 8192, overlap: int = 512) -> DataFrame:
    """(key, ids) of every row: the token ids of its text, without special tokens; whatever looks like one is ordinary text.

    Null and empty texts both have the empty list. Repeated rows and keys stay as they are (a long text's row is told apart by
    an id of its own). An empty table gives none; other columns are ignored whatever their names.
    The vocabulary file is read on the driver and broadcast (below 1 MB; refused above 64 MB). Short texts take no shuffle;
    chunks of long ones are shuffled twice, out and back.
    """
    with open(vocabulary, "rb") as f:
        raw = f.read()
    if len(raw) > 64 << 20:
        raise ValueError("vocabulary file above 64 MB")
    ranks = df.sparkSession.sparkContext.broadcast(raw)
    src = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value)
        for b in batches:
            ids = lists([enc.encode_ordinary(x) if x else [] for x in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("key"), ids], ["key", "ids"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value)
        for b in batches:
            bounds, ids, count = zip(*(chunk_tokens(x, z, enc) for x, z in zip(b.column("text").to_pylist(), b.column("last").to_pylist())))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("row", "key", "at", "text")), *map(lists, (bounds, ids, count))], ["row", "key", "at", "text", "bounds", "ids", "count"]
            )

    def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), lists([stitch(p, enc) for p in b.column("parts").to_pylist()])], ["key", "ids"])

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, x in enumerate(b.column("text").to_pylist()):
                at = range(0, len(x), chunk)
                for a in range(0, len(at), 256):  # a very long text leaves in several batches
                    some = at[a : a + 256]
                    rows = pa.array([r] * len(some))
                    last = [i + chunk + overlap >= len(x) for i in some]
                    yield pa.RecordBatch.from_arrays(
                        [b.column("row").take(rows), b.column("key").take(rows), pa.array(some, pa.int32()), pa.array([x[i : i + chunk + overlap] for i in some]), pa.array(last)], ["row", "key", "at", "text", "last"]
                    )

    cut = src.filter(is_long).withColumn("row", F.monotonically_increasing_id()).mapInArrow(sliced, f"row bigint, key {kind}, at int, text string, last boolean")
    cut = cut.repartition("row", "at")
    coded = cut.mapInArrow(chunks, f"row bigint, key {kind}, at int, text string, bounds array<int>, ids array<int>, count array<int>")
    long = coded.groupBy("row").agg(F.first("key").alias("key"), F.sort_array(F.collect_list(F.struct("at", "text", "bounds", "ids", "count"))).alias("parts")).select("key", "parts")
    long = long.mapInArrow(stitched, f"key {kind}, ids array<int>")
    out = src.filter(~is_long).mapInArrow(short, f"key {kind}, ids array<int>").unionByName(long)
    return out.withColumnRenamed("key", key)


def decode(ids: list[int], vocabulary: str = DEFAULT_VOCABULARY) -> str:
    """The text of a list of ids: the tokens' bytes one after the other."""
    with open(vocabulary, "rb") as f:
        return encoding(f.read()).decode_bytes(ids).decode("utf-8", "replace")
