"""Splitting, against a scan for the rightmost strongest boundary."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbatrix.llm.split import boundaries, merged, pieces, split_oversized

TESTS = (
    lambda t, e: t[e - 1] == "\n" and re.search(r"\n[ \t\r]*\Z", t[: e - 1]),
    lambda t, e: t[e - 1] == "\n",
    lambda t, e: t[e - 1] in "。！？" or (t[e - 1] in " \t\r\n" and e > 1 and t[e - 2] in ".!?"),
    lambda t, e: t[e - 1] in " \t\r\n",
    lambda t, e: True,
)


def plain(t, limit, overlap):
    s, out = 0, []
    while len(t) - s > limit:
        e = next(e for test in TESTS for e in range(s + limit, s + limit // 2, -1) if (test is TESTS[4] and e == s + limit) or (test is not TESTS[4] and test(t, e)))
        out.append((s, e))
        s = e - overlap
    return [*out, (s, len(t))]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.!?。\n\r\t é😀", max_size=400))
def test_pieces(t):
    assert pieces(t, 40, 6, 20) == plain(t, 40, 6)


def test_weakest_boundary_goes_first():
    text = "a b. c\n\nd e\nf"
    at, strength = boundaries(text)
    # all but one boundary are merged away where everything but the whole fits
    assert merged(0, at, strength, len(text), len(text) - 1) == ([len("a b. c\n\n")], len(at) - 1)
    # what fits is merged completely, what doesn't isn't
    assert merged(0, at, strength, len(text), len(text)) == ([], len(at))
    assert merged(0, [4, 8], [1, 1], 12, 3) == ([4, 8], 0)
    # the weakest pair is merged first, and the pair that doesn't fit afterwards keeps its cut
    assert merged(0, [4, 8], [2, 1], 12, 8) == ([4], 1)
    assert merged(0, [4, 8], [1, 2], 12, 8) == ([8], 1)


def test_table(spark):
    rng = random.Random(1)
    long = "".join(rng.choice(["w ", "word. ", "\n", "\n \n", "漢。"]) for _ in range(5000))
    df = spark.createDataFrame([(1, "t", long), (1, "t", long), (2, None, "x" * 3001), (3, "t", None), (4, "t", ""), (5, "t", "x" * 1500)], "entry_id bigint, topic string, text string").withColumn("key0", F.lit("clash")).withColumn("piece_no", F.lit(9))
    got = split_oversized(df, with_text=True).collect()
    assert {r["entry_id"] for r in got} == {1, 2}
    one = sorted((r["piece_no"], r["start_pos"], r["end_pos"], r["piece_topic"], r["piece"]) for r in got if r["entry_id"] == 1)
    assert len(one) == 2 * len(plain(long, 1500, 150))
    assert sorted(set(one)) == [(n, s, e, "t" if n == 1 else f"t/{n}", long[s:e]) for n, (s, e) in enumerate(plain(long, 1500, 150), 1)]
    assert [r["piece_topic"] for r in got if r["entry_id"] == 2] == ["", "", ""]
    assert split_oversized(df.limit(0)).count() == 0
