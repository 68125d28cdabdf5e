"""Splitting oversized texts at natural boundaries, with a fixed overlap between consecutive pieces.

Method: agglomerative merging. The text is cut into atomic segments at every boundary; the pairs of adjacent segments are held in
a heap by the strength of the boundary between them, and the weakest (of equal ones the leftmost) is merged first, as long as
the merged segment fits the limit. What can't be merged any more is cut. A piece starts a fixed overlap before the last cut, so merging is
done from each start on, over the text that can belong to its piece and one character more: that can't all be merged, so a cut is left.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BREAKS = re.compile(r"[ \t\r\n。！？]")
BLANK_LINE = re.compile(r"\n[ \t\r]*(?=\n)")
PARAGRAPH, LINE, SENTENCE, WORD = 4, 3, 2, 1


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Positions of all natural boundaries, ascending, and their strengths."""
    after_blank = {m.end() + 1 for m in BLANK_LINE.finditer(text)}
    at: list[int] = []
    strength: list[int] = []
    for m in BREAKS.finditer(text):
        i = m.start()
        c = text[i]
        if c == "\n":
            s = PARAGRAPH if i + 1 in after_blank else LINE
        elif c in "。！？" or (i and text[i - 1] in ".!?"):
            s = SENTENCE
        else:
            s = WORD
        at.append(i + 1)
        strength.append(s)
    return at, strength


def merged(start: int, cuts: list[int], strength: list[int], end: int, limit: int) -> tuple[list[int], int]:
    """The cuts that are left when the segments between start, the cuts and end are merged, and the number of merges.

    Segments are linked through their borders: before[i] and after[i] are the next borders that still stand left and right of cut i. A pair that
    doesn't fit when its turn comes never will, since segments only grow: its cut stays."""
    n = len(cuts)
    border = [*cuts, end, start]  # of index n the end, of index -1 the start
    before, after = list(range(-1, n)), list(range(1, n + 2))
    pairs = list(zip(strength, range(n)))
    heapq.heapify(pairs)
    left, merges = [], 0
    while pairs:
        i = heapq.heappop(pairs)[1]
        a, b = before[i], after[i]
        if border[b] - border[a] > limit:
            left.append(cuts[i])
            continue
        merges += 1
        after[a] = b
        before[b] = a
    return sorted(left), merges


def pieces(text: str, limit: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of each piece of a text."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    at, strength = boundaries(text)
    out: list[tuple[int, int]] = []
    s = 0
    while n - s > limit:
        # up to `least` characters are one atom: a piece is longer than that; the limit is a cut weaker than all others
        lo, hi = bisect_right(at, s + least), bisect_right(at, s + limit)
        cuts, strong = at[lo:hi], strength[lo:hi]
        if not cuts or cuts[-1] != s + limit:
            cuts, strong = [*cuts, s + limit], [*strong, 0]
        e = merged(s, cuts, strong, s + limit + 1, limit)[0][-1]
        out.append((s, e))
        s = e - overlap
    out.append((s, n))
    return out


def split_oversized(df: DataFrame, text: str = "text", topic: str = "topic", keys: tuple[str, ...] = ("entry_id",), limit: int = 1500, overlap: int = 150, with_text: bool = False) -> DataFrame:
    """One row per piece of every text longer than `limit` characters (code points): keys, piece_no from 1, start_pos, end_pos
    (exclusive), piece_topic, and the piece itself if with_text.

    A piece ends with the text if at most `limit` characters remain; else in its second half, at the rightmost of the
    strongest boundaries: blank line, line, sentence, space, none. The next starts `overlap` before that end (overlap must be
    less than limit // 2). piece_topic is the topic, from the second piece on with '/' and the number, '' for a null topic.
    Null, empty and short texts give no rows; repeated rows give repeated pieces; an empty table gives none; other columns are
    ignored whatever their names. A narrow operator: no shuffle, one row in memory at a time.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    src = df.filter(F.length(text) > limit).select(*(F.col(k).alias(f"key{i}") for i, k in enumerate(keys)), F.col(text).alias("text"), F.col(topic).alias("topic"))
    least = limit // 2
    types = [t for f in src.schema.fields for t in [f.dataType.simpleString()]]
    out = [*(f"key{i} {types[i]}" for i in range(len(keys))), "piece_no int", "start_pos int", "end_pos int", "piece_topic string", *(["piece string"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            no: list[int] = []
            start: list[int] = []
            end: list[int] = []
            topics: list[str] = []
            parts: list[str] = []
            for r, (x, t) in enumerate(zip(b.column("text").to_pylist(), b.column("topic").to_pylist())):
                for i, (s, e) in enumerate(pieces(x, limit, overlap, least), 1):
                    rows.append(r)
                    no.append(i)
                    start.append(s)
                    end.append(e)
                    topics.append("" if t is None else t if i == 1 else f"{t}/{i}")
                    if with_text:
                        parts.append(x[s:e])
            keep = b.select([f"key{i}" for i in range(len(keys))]).take(pa.array(rows, pa.int64()))
            cols = [*keep.columns, pa.array(no, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(topics, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(parts, pa.string())] if with_text else []), [x.split()[0] for x in out])

    return src.mapInArrow(run, ", ".join(out)).withColumnsRenamed({f"key{i}": k for i, k in enumerate(keys)})
