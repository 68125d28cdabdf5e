"""Connected components of a link table, in Spark: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_out


def _pairs(df: DataFrame) -> DataFrame:
    return df.filter("hi != lo").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link to another; root is the component's smallest node.

    Every round connects each node's larger neighbours with its smallest one, then its smaller ones; rounds are
    logarithmic in the number of nodes. A hub's neighbours are never collected: minima are reduced before the shuffle and
    joined back, and adaptive execution splits a hot hub. Each round's links are written to the shared folder. Links of a node to itself
    and repeated links do nothing; null ends are ignored; an empty table gives no rows.
    """
    link = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"), F.col(a).isNotNull() & F.col(b).isNotNull()).toDF("hi", "lo", "ok").filter("ok").drop("ok")
    now = write_out(_pairs(link), "links")
    sign = None
    for _ in range(max_rounds):
        e = now.df
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _pairs(both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")))
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(small, "hi").select("hi", "lo", "m")
        after = write_out(_pairs(joined.select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("p")).select("p.hi", "p.lo")), "links")
        now.drop()
        now = after
        seen = tuple(now.df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0))).first())
        if seen == sign:
            return now.df.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.df.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        sign = seen
    raise RuntimeError("components: no end within max_rounds")
