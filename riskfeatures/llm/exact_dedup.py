"""Exact dedup by distributed MSD radix partitioning.

Texts are compared after deleting ASCII white space.  The radix key of a text is
its length in bytes followed by its bytes.  Round by round the live documents
are split by the next stretch of key bytes: (group, bytes) pairs are counted with
pre-aggregation, singletons leave, documents whose bytes have ended form a final
group, the others go on with what is left of their text.  Stretches grow
eightfold up to a mebibyte, so a text of any length ends after a few rounds, and
every round moves only the documents that still have a twin.  Equality never
rests on a digest; the reported SHA-256 is output only.

A group of copies of any size costs a partial count per task and an equi-join
with one row per group, whose large side adaptive execution splits; it is never
gathered.  Every round is a written table in the shared folder.

Defined results: null counts as empty, and all-white-space texts equal the empty
one; ids may be null or repeated (rows are told apart by a row number; a null id
stays only where no row of the group has one; of rows alike in every respect one
stays); an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stored

FIRST, GROW, MOST = 64, 8, 1 << 20


def copy_groups(rows: DataFrame) -> DataFrame:
    """``rows`` has ``rid``, ``size`` and ``body`` (binary) besides others; returns the
    rows that have equals, without ``body`` and with ``gid``, the least rid."""
    keep = [c for c in rows.columns if c not in ("body", "size")]
    at, width = FIRST, FIRST
    digit = F.substring("body", 1, FIRST)
    groups = rows.select("size", digit.alias("digit"), "rid").groupBy("size", "digit").agg(
        F.min("rid").alias("gid"), F.count("*").alias("c")).where("c > 1").drop("c")
    live = stored(rows.withColumn("digit", digit).join(groups, ["size", "digit"]).select(
        *keep, "gid", "size", F.expr(f"substring(body, {FIRST + 1})").alias("body")), "radix")
    done = [live.where(F.col("size") <= at)]
    live = live.where(F.col("size") > at)
    while not live.isEmpty():
        width = min(MOST, width * GROW)
        digit = F.substring("body", 1, width)
        groups = live.select("gid", digit.alias("digit"), "rid").groupBy("gid", "digit").agg(
            F.min("rid").alias("next"), F.count("*").alias("c")).where("c > 1").drop("c")
        live = stored(live.withColumn("digit", digit).join(groups, ["gid", "digit"]).select(
            *keep, F.col("next").alias("gid"), "size", F.expr(f"substring(body, {width + 1})").alias("body")), "radix")
        at += width
        done.append(live.where(F.col("size") <= at))
        live = live.where(F.col("size") > at)
    return reduce(DataFrame.union, done).drop("size", "body")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    body = F.regexp_replace(text, f"[{SPACE}]+", "")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"),
                       F.length(text).cast("long").alias("n_chars"), body.alias("body"))
    return stored(rows.select("rid", "doc_id", "n_chars", F.sha2("body", 256).alias("sha"), F.octet_length("body").alias("size"),
                              F.col("body").cast("binary").alias("body")), "bodies")


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``keep_id`` (the id of the row that stays),
    ``group_size``, ``kept`` and ``text_sha256`` of the normalised text."""
    rows = _numbered(docs, id_col, text_col)
    members = copy_groups(rows.select("rid", "doc_id", "n_chars", "size", "body"))
    best = members.groupBy("gid").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"), F.col("rid").alias("rid"))).alias("first"))
    best = best.select("gid", "group_size", F.col("first.doc_id").alias("first_id"), F.col("first.rid").alias("first_rid"))
    found = members.select("rid", "gid").join(best, "gid")
    single = F.col("group_size").isNull()
    return rows.select("rid", "doc_id", "sha").join(found, "rid", "left").select(
        F.col("doc_id").alias(id_col), F.when(single, F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("rid") == F.col("first_rid"))).alias("kept"), F.col("sha").alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, length(coalesce(text, '')) AS n,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY body) AS c,
        row_number() OVER (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST, rid) AS k,
        first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST, rid) AS keep_id FROM d)
SELECT doc_id, keep_id, CAST(c AS BIGINT) AS group_size, k = 1 AS kept, sha256(body) AS text_sha256 FROM g
"""
