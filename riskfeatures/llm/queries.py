"""The operators' registered queries and their DuckDB SQL."""

from __future__ import annotations

from . import (bpe, brown_lm, cap_filters, chat_format, exact_dedup, html_text, jaccard_join, line_dedup, periodic_runs, prefix_trie, quality_rules,
               secret_scan, source_mixing)
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def vocabulary(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.duplicate_report(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark, sf_dir):
    return quality_rules.quality_table(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark, sf_dir):
    return source_mixing.mixture(table(spark, sf_dir, "documents"), entropy=0.95, max_epochs=4.0)


def op4_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op5_html_text(spark, sf_dir):
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"), percent=80)


def op7_chat_format(spark, sf_dir):
    return chat_format.rotate(table(spark, sf_dir, "conversations"))


def op8_brown_lm(spark, sf_dir):
    return brown_lm.scored(table(spark, sf_dir, "documents"), classes=64)


def op9_secret_scan(spark, sf_dir):
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark, sf_dir):
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"), size=3, percent=90)


def op11_cap_filters(spark, sf_dir):
    return cap_filters.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op12_periodic_runs(spark, sf_dir):
    return periodic_runs.run_report(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_quality_rules, op3_source_mixing, op4_bpe, op5_html_text, op6_line_dedup,
                                  op7_chat_format, op8_brown_lm, op9_secret_scan, op10_ngram_join, op11_cap_filters, op12_periodic_runs, op13_prefix_trie)}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_quality_rules": quality_rules.ORACLE,
    "op3_source_mixing": source_mixing.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op7_chat_format": chat_format.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
