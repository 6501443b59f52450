"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after deleting white space ``[\\x20\\x09-\\x0D]``. Only rows that share a length go on to
the prefix level, only rows that share length and prefix hash to the full level, and only those are grouped by the full
hash (SHA-256 of the normalised text). Counts are pre-aggregated by each task, so a group of copies that holds a third of
all rows reaches one task as a few partial rows; rows meet their group in joins of two written tables, which adaptive
execution splits where one key is hot.

Null text counts as empty. Of equal texts the row with the most code points in the original text, then the smallest
doc_id stays (a null id sorts first). Rows repeated with the same id and text share one fate. Columns of the input other
than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calltrace.functions.work import materialize

PREFIX = 128


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hash_all: bool = False, prefix: int = PREFIX) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row.

    ``text_sha256`` is null for a row that the length or prefix level has shown to be unique, unless ``hash_all``: then every text is
    hashed in full, because the result names every hash, and the levels save the grouping of the unique ones alone.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("tid", F.xxhash64("text"))
    norm = normalised(F.col("text"))
    light = materialize(
        rows.withColumn("norm", norm).select(
            "doc_id", "tid", F.length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, prefix)).alias("head")
        ),
        "exact-light",
    )
    by_len = materialize(light.groupBy("len").agg(F.count("*").alias("n")).where("n > 1").select("len"), "exact-len")
    second = light.join(by_len, "len", "left_semi")
    by_head = materialize(second.groupBy("len", "head").agg(F.count("*").alias("n")).where("n > 1").select("len", "head"), "exact-head")
    third = second.join(by_head, ["len", "head"], "left_semi").select("doc_id", "tid", "len").distinct()

    a, b = rows.alias("a"), third.alias("b")
    full = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.tid") == F.col("b.tid")), "left_semi")
    if hash_all:  # every row needs its hash: one scan gives them all, and only ids are joined
        a = rows.select("doc_id", "tid", F.length(F.coalesce("text", F.lit(""))).alias("raw"), F.sha2(F.encode(norm, "UTF-8"), 256).alias("sha")).alias("a")
        full = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.tid") == F.col("b.tid")), "left").select(
            "a.*", F.col("b.len").isNotNull().alias("shared")
        )
    else:
        full = full.select("doc_id", "tid", F.length(F.coalesce("text", F.lit(""))).alias("raw"), F.sha2(F.encode(norm, "UTF-8"), 256).alias("sha"), F.lit(True).alias("shared"))
    full = materialize(full, "exact-full")
    groups = full.where("shared").groupBy("sha").agg(
        F.min(F.struct((-F.col("raw")).alias("raw"), F.col("doc_id"))).alias("best"), F.count("*").alias("group_size")
    )
    groups = materialize(groups.where("group_size > 1").select("sha", F.col("best.doc_id").alias("keep_id"), "group_size", F.lit(True).alias("hit")), "exact-groups")
    out = full.join(groups, "sha", "left")
    if not hash_all:
        alone = light.select("doc_id", "tid").alias("a").join(
            third.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.tid") == F.col("b.tid")), "left_anti"
        )
        empty = {c: F.lit(None).cast(t) for c, t in (("sha", "string"), ("keep_id", "long"), ("group_size", "long"), ("hit", "boolean"))}
        out = out.select("doc_id", *empty).unionByName(alone.select("doc_id").withColumns(empty))
    keep = F.when(F.col("hit"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256")
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), hash_all=True)


OP2_SQL = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS raw,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm
  FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-raw, doc_id)) AS keep_id FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size::BIGINT AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
