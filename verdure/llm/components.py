"""Connected components of a link table by alternating large and small stars; nothing of it reaches the driver but a count and a checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.llm.common import cut, uncut

ROUNDS = 60


def _sign(e: DataFrame):
    return e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each node that has a link, the smallest node it is linked with over any path. Self-links and repeats don't matter; no links give no rows."""
    e = cut(links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    sign = _sign(e)
    for _ in range(ROUNDS):
        if not sign[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.expr("array(struct(u, m AS v), struct(v AS u, m AS v))")).alias("x")).select("x.u", "x.v").where("u > v").distinct()
        now = cut(small, "links")
        uncut(e)
        e, last, sign = now, sign, _sign(now)
        if sign == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
