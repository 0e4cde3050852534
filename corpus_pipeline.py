"""A training corpus from raw documents, in five stages.

Every stage works on all rows its predecessor kept and returns the columns of
its input, but for the last, which returns the encoded corpus:

1. quality rules: documents that a rule rejects go;
2. line dedup: lines similar to an earlier line of the corpus go (an emptied
   text stays as the empty text);
3. n-gram Jaccard join: of the documents linked by five-word shingles with a
   similarity of 0.8 or more, the one of the smallest id stays;
4. mixing: sources are repeated or cut to tempered weights (entropy of at least
   0.95 of the even mixture's, at most 4 passes), within the tokens there are;
5. byte-level BPE: ids of every text, with the digest of the decoded ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfeatures.llm import bpe, jaccard_join, line_dedup, quality_rules, source_mixing
from riskfeatures.llm.common import stored, table
from riskfeatures.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs, percent=80)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_copies(docs, size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.mixed(docs, entropy=0.95, max_epochs=4.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, vocabulary(), with_ids=True)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("encode", encode)]

# Byte-level BPE has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
