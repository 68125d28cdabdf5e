"""Sets of word runs of texts, in the JVM, and what exact set similarity joins share.

A text's words are the maximal runs of letters and digits of its lower-cased form; its set holds a 64-bit hash of each run of
`size` consecutive words. Texts of fewer than `least_words` words, and null ones, have no set. Texts with the same words
are copies; they share one digest and are compared once.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}]+"


def word_array(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORDS), F.lit(0))


def shingled(df: DataFrame, keep: list[str], text: str = "text", size: int = 3, least_words: int = 8) -> DataFrame:
    """keep, digest (of the words, null without a set), grams (distinct hashes of word runs, null without a set)."""
    run = F.transform(
        F.sequence(F.lit(1), F.size("_w") - (size - 1)),
        lambda i: F.xxhash64(*(F.element_at("_w", i + k) for k in range(size))),
    )
    has = F.size("_w") >= max(least_words, size)
    return (
        df.select(*keep, word_array(text).alias("_w"))
        .select(*keep, F.when(has, F.md5(F.array_join("_w", " "))).alias("digest"), F.when(has, F.array_distinct(run)).alias("grams"))
    )


class Closeness:
    """|A∩B| / |A∪B| >= threshold in whole numbers: overlap * over >= under * (|A| + |B|)."""

    def __init__(self, threshold: float):
        f = Fraction(str(threshold))
        if not 0 < f <= 1:
            raise ValueError("the threshold must be in (0, 1]")
        self.num, self.den = f.numerator, f.denominator
        self.over, self.under = f.numerator + f.denominator, f.numerator

    def least_shared(self, n: str) -> str:
        """SQL of the overlap that a set of n elements needs at least with any close set."""
        return f"cast(ceil({n} * {self.num} / {self.den}d - 1e-9) as int)"

    def close(self, overlap: str, a: str, b: str) -> str:
        """SQL: sets of sizes a and b with this overlap are close, or could be if it is an upper bound of it."""
        return f"({overlap}) * {self.over} >= {self.under} * ({a} + {b})"


def prefix_sets(sets: DataFrame, key: str, frequency: DataFrame, close: Closeness, shared_only: bool) -> DataFrame:
    """(key, n, grams, m): of each set its size and its grams in one order for all, rare ones first.

    sets: key, grams. frequency: gram, df; a gram without one counts as rarest. shared_only: frequency has every gram that
    two sets share, so others are left out (m of n grams are kept, the left-out ones come first in the order) and sets with
    too few shared grams for any partner vanish.
    """
    each = sets.select(key, F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    each = each.join(frequency, "gram", "inner" if shared_only else "left")
    out = each.groupBy(key, "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("o"))
    out = out.withColumn("m", F.size("o"))
    if shared_only:
        out = out.filter(f"m >= {close.least_shared('n')}")
    return out


def prefixes(ordered: DataFrame, key: str, close: Closeness, carry: list[str]) -> DataFrame:
    """(gram, df, key, n, pos, carry): the grams of each set's prefix. Close sets share a gram of both prefixes, and at the first
    such gram what is left of both sets is enough for their overlap."""
    return ordered.select(key, "n", "m", *carry, F.posexplode(F.expr(f"slice(o, 1, greatest(0, m - {close.least_shared('n')} + 1))")).alias("i", "g")).select(
        F.col("g.gram").alias("gram"), F.col("g.df").alias("df"), key, "n", (F.col("n") - F.col("m") + F.col("i")).alias("pos"), *carry
    )
