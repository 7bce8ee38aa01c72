"""A corpus pipeline: language ID, near-dedup, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last keep the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm import langid, likeness, packing, secrets
from seqloom.session import table

#: Near-duplicates: this Jaccard likeness, or more, of the distinct five-word shingles.
SHINGLE, LIKENESS = 5, 0.8


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects: no letters, or far from every centroid."""
    learn = docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.lit(True)))
    return langid.predict(docs, langid.fit(learn)).where("NOT rejected").select(*docs.columns)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each near-duplicate group.

    SimHash BK-trees propose, the exact likeness decides. A doc_id names one
    document: its rows go or stay together, and of those with one text one stays. Rows
    without doc_id stay. Other columns keep their values whatever their names.
    """
    # other columns go by names that no inner one has
    other = {c: f"_kept{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    columns = [other.get(c, c) for c in docs.columns]
    groups = likeness.near_components(docs.select("doc_id", "text"), SHINGLE, LIKENESS)
    named = groups.groupBy("doc_id").agg(F.min("component_id").alias("_near_first"), F.count("*").alias("_near_rows"))
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, columns)])
    out = inner.join(named.where("_near_first < doc_id OR _near_rows > 1").withColumnRenamed("doc_id", "_near_id"), F.col("doc_id") == F.col("_near_id"), "left").where("_near_id IS NULL OR _near_first >= _near_id")
    once = out.where("_near_id IS NULL").select(*columns)
    # only rows of repeated ids are compared
    kept = once.unionByName(out.where("_near_id IS NOT NULL").select(*columns).dropDuplicates(["doc_id", "text"]))
    return kept.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, columns)])


def mask_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the text; every document stays."""
    return secrets.redact(docs)


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a packed sequence."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("mask_secrets", mask_secrets), ("pack", pack)]

#: Near-dedup and forests have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The stages over all of documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
