"""Quality rules: one threshold table compiled into one Spark projection.

Every measure is an integer counted over the whole text with built-in
functions; every rule compares ``100 * numerator`` with ``percent *
denominator``, so no division and no rounding takes part.  The plan is a scan
followed by projections: no shuffle, no user functions.

Defined results: a null text has no words (all counts 0, ``base_failed`` true,
rejected); a null id is carried through; repeated rows each get their own
result; an empty table gives an empty result; extra columns are kept by
``apply_rules`` whatever their names, since the measures are built in a select
of their own and only the verdict is added.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, key_column, words

# Frequent function words of seven languages.
STOP_WORDS = {
    "en": "a an and are as at be but by for from has have he her his i if in is it its not of on or she that the their "
          "them there they this to was we were which will with you".split(),
    "de": "als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im "
          "in ist mit nach nicht noch nur oder sich sie sind so über um und von war werden wie wird zu zum zur".split(),
    "fr": "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par "
          "pas plus pour qu que qui sa se ses son sont sur un une vous".split(),
    "es": "al como con de del el ella en entre es esta este fue ha la las le lo los más me no o para pero por que se sin "
          "son su sus también un una y".split(),
    "it": "che di e gli i il non per una uno è".split(),
    "pt": "da das do dos em foi não os para por são uma".split(),
    "nl": "dat de een en het is met niet op te van voor zijn".split(),
}
ALL_STOP_WORDS = sorted({w for ws in STOP_WORDS.values() for w in ws})
# Marks taken off the end of a word before it is looked up.
TRAIL = ",.;:!?#*$%&|<>\")("
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Fails when ``100 * num`` lies outside ``[low, high] percent of den``;
    rows with fewer than ``min_words`` words are exempt."""
    name: str
    num: str
    den: str
    low: int | None = None
    high: int | None = None
    base: bool = False
    min_words: int = 0


RULES = (
    Rule("too_short", "n_words", "one", low=2000, base=True),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=30, base=True),
    Rule("word_length", "word_chars", "n_words", low=150, high=2500),
    Rule("symbols", "n_symbols", "n_words", high=25),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=60),
    Rule("stop_words", "n_stop", "n_words", low=2, min_words=50),
)


def compile_rules(rules: tuple[Rule, ...], base_only: bool = False) -> Column:
    """True when any (base) rule fails."""
    failed = F.lit(False)
    for r in rules:
        if base_only and not r.base:
            continue
        num, den = F.col(r.num) * 100, F.lit(1) if r.den == "one" else F.col(r.den)
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (num < r.low * den)
        if r.high is not None:
            bad = bad | (num > r.high * den)
        failed = failed | (bad & (F.col("n_words") >= r.min_words) if r.min_words else bad)
    return failed


def measures(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """``keep`` plus the integer measures of ``text_col``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = [f"_keep{i}" for i in range(len(keep))]
    df = docs.select(*[c.alias(n) for c, n in zip(keep, names)], text.alias("_t"))
    df = df.withColumn("_w", words(F.col("_t"))).withColumn("n_words", F.size("_w").cast("long"))
    # windows as 64-bit hashes: all distinct -> no window is found twice
    hashes = F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_w"), i, WINDOW)))
    df = df.withColumn("_h", F.when(F.col("n_words") > WINDOW, hashes))
    stop = F.filter("_w", lambda x: F.lower(F.rtrim(x, F.lit(TRAIL))).isin(ALL_STOP_WORDS))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    df = df.select(
        *names, "_w", "n_words",
        F.length(F.regexp_replace("_t", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.size(stop).cast("long").alias("n_stop"),
        lines.alias("_l"),
        (F.size(F.array_distinct("_h")) < F.size("_h")).alias("_again"),
    )
    # only texts with a repeated hash sort their windows, as whole strings: exact
    windows = F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)),
                          lambda i: F.struct(F.array_join(F.slice(F.col("_w"), i, WINDOW), " ").alias("g"), i.alias("i")))
    df = df.withColumn("_p", F.when(F.col("_again"), F.array_sort(windows)))
    twice = F.filter("_p", lambda p, k: F.coalesce(F.get(F.col("_p"), k - 1)["g"] == p["g"], F.lit(False))
                     | F.coalesce(F.get(F.col("_p"), k + 1)["g"] == p["g"], F.lit(False)))
    df = df.withColumn("_at", F.when(F.col("_again"), F.array_sort(F.transform(twice, lambda p: p["i"]))))
    cover = F.aggregate(
        F.transform("_at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), k + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    df = df.select(
        *names, "n_words", "word_chars", "n_symbols", "n_stop",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    # a generator of one row: a filter on the measures is not pushed below it, where
    # each of its columns would be evaluated inside the lambdas of the next
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def quality_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: id, measures, ``base_failed``, ``kept``."""
    m = measures(docs, text_col, [F.col(id_col)])
    return (m.withColumn("base_failed", compile_rules(rules, base_only=True))
             .withColumn("kept", ~compile_rules(rules))
             .select(F.col("_keep0").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                     "n_repeat_words", "n_stop", "n_lines", "base_failed", "kept"))


def apply_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass every rule, with their own columns only."""
    row = key_column(docs, "row")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col(text_col).alias("_text"))
    m = measures(packed, "_text", [F.col(row)])
    return m.where(~compile_rules(rules)).select("_keep0.*")


_STOP_SQL = ", ".join("'" + w + "'" for w in ALL_STOP_WORDS)

ORACLE = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rn, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
win AS (SELECT rn, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
        FROM (SELECT rn, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})),
twice AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS c FROM win) WHERE c > 1),
cover AS (SELECT rn, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n
          FROM (SELECT rn, i, lead(i) OVER (PARTITION BY rn ORDER BY i) AS nxt FROM twice) GROUP BY rn),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len([x for x in w if lower(rtrim(x, '{TRAIL}')) IN ({_STOP_SQL})]) AS BIGINT) AS n_stop,
        CAST(len(l) AS BIGINT) AS n_lines
      FROM w LEFT JOIN cover c USING (rn))
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words
       OR 100 * word_chars < 150 * n_words OR 100 * word_chars > 2500 * n_words
       OR 100 * n_symbols > 25 * n_words OR 100 * n_dup_lines > 60 * n_lines
       OR (n_words >= 50 AND 100 * n_stop < 2 * n_words)) AS kept
FROM m
"""
