"""From raw documents to packed training sequences: five stages, each by one operator of verdure.llm.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents, whatever those are besides doc_id,
text and n_chars: a row travels as one struct, so its names can't clash with those used inside. In all stages a null text is an
empty text, an id may be null or stand in several rows without linking them, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdure.llm import byte_dedup, common, decontaminate, packing, quality_rules, simhash
from verdure.llm.components import components

#: Stages can't be put in SQL (XXH64 fingerprints, tokenizers); tests hold them against brute force.
ORACLE_SQL = None


def _rows(docs: DataFrame) -> DataFrame:
    """(r, id, text): each row as it is, and its id and text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r")).select("r", F.coalesce(F.col("r.doc_id").cast("long"), F.lit(common.NULL_ID)).alias("id"), F.col("r.text").cast("string").alias("text"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; null and empty texts are rejected (too few words), repeated rows are judged each."""
    return quality_rules.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of linked fingerprints: of those with the smallest id (null is smallest), the one with the smallest fingerprint; of equal ones any.

    Texts without words have fingerprint 0 and are one group. An id links nothing, whether null or met twice.
    """
    rows = common.cut(_rows(docs).select("r", "id", simhash.fingerprint_of("text").alias("fp"), F.monotonically_increasing_id().alias("k")), "fingerprints")
    entries = rows.groupBy("fp").agg(F.min(F.struct("id", "k")).alias("first"))
    roots = components(simhash.links(entries.select("fp", F.col("fp").alias("node"))))
    group = F.coalesce("root", "fp")
    stay = entries.join(roots.withColumnRenamed("node", "fp"), "fp", "left").groupBy(group).agg(F.min(F.struct("first.id", "fp", "first.k")).alias("x")).select("x.k")
    return rows.join(stay, "k", "left_semi").select("r.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 50-byte strings that start under a smaller id (null is smallest; equal ids take nothing from each other); n_chars counts what is left."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")])  # goes along, and the text comes back
    left = byte_dedup.remove_repeats(docs, as_text=True, carry=rest)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return left.select(*[new[c].alias(c) if c in new else F.col(f"carry.`{c}`").alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found; repeated rows go or stay together. Rows go by a name of id and text, so that a leak takes no other text of its id."""
    rows = _rows(docs).withColumn("k", F.xxhash64("id", F.coalesce("text", F.lit(""))))
    found = decontaminate.leaks(rows.select("k", "text"), common.table(spark, sf_dir, "benchmark"), id_col="k").select(F.col("id").alias("k")).distinct()
    return rows.join(found, "k", "left_anti").select("r.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences; an empty text is packed as its end token."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; each stage's rows are written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.cut(docs, name)
    return docs
