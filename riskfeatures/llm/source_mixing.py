"""Mixing sources to target weights, with built-in functions only.

Token shares ``p`` of the sources become weights ``p^a / sum p^a``.  The exponent
``a`` in [0, 1] is found by bisection on one-row aggregates over the table of
sources: the largest one whose weights reach the target entropy (a fraction of
the even mixture's), raised where needed so that no source repeats more often
than ``max_epochs``.  Weights times the token budget give each source's budget.
A budget is realised as whole passes over the source plus a last partial pass:
in pass ``e`` the documents are ordered by ``md5(seed|e|id)``, whose first three
digits are the block (4096 blocks in permuted order); blocks are taken while
their running token sum fits, and only the block at the border ranks its rows.

The per-source table is as small as the number of sources; the window over it
has at most 4096 rows for each source, and the border block holds a 4096th of its
source, so a source with a third of all rows is no hot task.  Spark broadcasts
the plan when its measured size allows and else joins it by shuffle.

Defined results: a null source is a source of its own; null or empty text has no
tokens; null ids order by the key of the empty id; rows that share a key (repeated
rows) are taken or left together; a source without tokens gets no rows; an empty
table gives an empty result; ``mixed`` keeps the columns of its input whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import key_column, stored, words

LEVELS, STEP = 32, 4      # bisection levels; levels that one aggregate serves
SCALE = 10 ** 15          # fixed-point scale of sums: their order does not matter
BLOCK_DIGITS = 3          # 16^3 blocks
SEED = 42


def _fixed_sum(c: Column) -> Column:
    return F.sum(F.round(c * SCALE).cast("decimal(38,0)")).cast("double") / SCALE


def _curves(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """Per exponent: sum of p^a, sum of p^a ln p, greatest p^(a-1)."""
    p = F.col("p")
    cols = [x for a in exponents for x in (_fixed_sum(F.pow(p, F.lit(a))), _fixed_sum(F.pow(p, F.lit(a)) * F.ln(p)),
                                           F.max(F.pow(p, F.lit(a - 1.0))))]
    row = sources.agg(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return [tuple(row[3 * i:3 * i + 3]) for i in range(len(exponents))]


def _bisect(sources: DataFrame, high_side) -> tuple[float, float]:
    """Bisect [0, 1]: ``high_side(a, curve)`` tells whether to go on in the upper half."""
    lo, hi = 0.0, 1.0
    for _ in range(LEVELS // STEP):
        mids = [lo + (hi - lo) * k / 2 ** STEP for k in range(1, 2 ** STEP)]
        curves = _curves(sources, mids)
        left, right = 0, 2 ** STEP
        while right - left > 1:
            mid = (left + right) // 2
            if high_side(mids[mid - 1], curves[mid - 1]):
                left = mid
            else:
                right = mid
        lo, hi = lo + (hi - lo) * left / 2 ** STEP, lo + (hi - lo) * right / 2 ** STEP
    return lo, hi


def temperature(sources: DataFrame, budget: int, total: int, entropy: float | None, max_epochs: float | None) -> float:
    """The exponent; ``sources`` has one row per source with its share ``p`` > 0."""
    import math
    n, (curve,) = sources.count(), _curves(sources, [1.0])
    a = 1.0
    if entropy is not None and math.log(curve[0]) - curve[1] / curve[0] < entropy * math.log(n):
        a = _bisect(sources, lambda x, c: math.log(c[0]) - x * c[1] / c[0] >= entropy * math.log(n))[0]
    if max_epochs is not None:
        repeats = lambda c: c[2] / c[0] * budget / total
        if repeats(_curves(sources, [a])[0]) > max_epochs:
            a = max(a, _bisect(sources, lambda x, c: repeats(c) > max_epochs)[1])
    return a


def mix_plan(docs: DataFrame, entropy: float | None = 0.95, max_epochs: float | None = 4.0, budget: int | None = None,
             seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """``(plan, tokens)``: per source its weight, budget, whole passes and the last
    key of the partial pass; per document its source, id and number of tokens.

    ``budget`` defaults to the corpus's own number of tokens."""
    tokens = stored(docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("doc_id"),
                                F.size(words(F.coalesce(F.col(text_col), F.lit("")))).cast("long").alias("n_tokens")), "mix-tokens")
    total = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    budget = total if budget is None else budget
    sources = stored(tokens.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens")).where("source_tokens > 0")
                           .withColumn("p", F.col("source_tokens") / F.lit(float(max(total, 1)))), "mix-sources")
    a = temperature(sources, budget, total, entropy, max_epochs) if total else 1.0
    norm = _curves(sources, [a])[0][0] if total else 1.0
    weight = F.pow("p", F.lit(a)) / F.lit(norm)
    plan = sources.select("source", "source_tokens", weight.alias("weight"), F.floor(weight * F.lit(float(budget)) + 0.5).cast("long").alias("budget"))
    plan = (plan.withColumn("passes", F.floor(F.col("budget") / F.col("source_tokens")).cast("long"))
                .withColumn("rest", F.col("budget") - F.col("passes") * F.col("source_tokens")))
    keyed = (tokens.join(plan.select(F.col("source").alias("_s"), "passes", "rest"), F.col("source").eqNullSafe(F.col("_s")))
                   .select("source", "n_tokens", "rest", _key(seed, F.col("passes"), F.col("doc_id")).alias("key"))
                   .withColumn("block", F.substring("key", 1, BLOCK_DIGITS)))
    sums = keyed.groupBy("source", "block", "rest").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("block"))
    border = (sums.withColumn("upto", upto).where("upto > rest").groupBy("source")
                  .agg(F.min(F.struct("block", (F.col("upto") - F.col("n")).alias("before"))).alias("b"))
                  .select(F.col("source").alias("_s"), F.col("b.block").alias("_b"), F.col("b.before").alias("before")))
    rows = keyed.join(border, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    run = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, 0))
    last = (rows.withColumn("run", F.col("before") + run).groupBy("source")
                .agg(F.coalesce(F.max(F.when(F.col("run") <= F.col("rest"), F.col("key"))), F.first("block")).alias("last_key"))
                .select(F.col("source").alias("_s"), "last_key"))
    plan = plan.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return stored(plan, "mix-plan"), tokens


def _key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _taken(docs: DataFrame, plan: DataFrame, seed: int, id_col: str, source_col: str) -> tuple[DataFrame, str, str]:
    """``docs`` repeated once for each pass that takes them, with pass and key."""
    epoch, key, s, n, k, last = (key_column(docs, x) for x in ("epoch", "shuffle_key", "mix_source", "mix_passes", "mix_key", "mix_last"))
    p = plan.select(F.col("source").alias(s), F.col("passes").alias(n), F.col("last_key").alias(k))
    until = F.when(_key(seed, F.col(n), F.col(id_col)) <= F.col(k), F.col(n)).otherwise(F.col(n) - 1)
    out = docs.join(p, F.col(source_col).eqNullSafe(F.col(s))).withColumn(last, until).where(F.col(last) >= 0)
    out = out.withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("long"), F.col(last))))
    out = out.withColumn(key, _key(seed, F.col(epoch), F.col(id_col)))
    return out.drop(s, n, k, last), epoch, key


def mixed(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs`` with each row as often as the mixture takes it; own columns only."""
    plan, _ = mix_plan(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    out, epoch, key = _taken(docs, plan, seed, id_col, source_col)
    return out.drop(epoch, key)


def mixture(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The realised mixture, one row per document and pass: ``doc_id``, ``source``,
    ``n_tokens``, ``epoch``, ``block`` and ``shuffle_key`` (the order of a pass)."""
    plan, tokens = mix_plan(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    out, _, _ = _taken(tokens, plan, seed, "doc_id", "source")
    return out.select("doc_id", "source", "n_tokens", "epoch", F.substring("shuffle_key", 1, BLOCK_DIGITS).alias("block"), "shuffle_key")


ORACLE = rf"""
WITH RECURSIVE t AS (SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
tot AS (SELECT CAST(coalesce(sum(n_tokens), 0) AS BIGINT) AS total FROM t),
src AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS st, sum(n_tokens) / CAST((SELECT total FROM tot) AS DOUBLE) AS p
        FROM t GROUP BY source HAVING sum(n_tokens) > 0),
goal AS (SELECT 0.95 * ln(count(*)) AS want, -sum(p * ln(p)) AS h1 FROM src),
ent AS (
  SELECT 0 AS lvl, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT lvl + 1, CASE WHEN h >= want THEN mid ELSE lo END, CASE WHEN h >= want THEN hi ELSE mid END
  FROM (SELECT lvl, lo, hi, (lo + hi) / 2 AS mid,
          ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) AS h
        FROM ent, src WHERE lvl < {LEVELS} GROUP BY lvl, lo, hi) x, goal),
rep AS (
  SELECT 0 AS lvl, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT lvl + 1, CASE WHEN r > 4.0 THEN mid ELSE lo END, CASE WHEN r > 4.0 THEN hi ELSE mid END
  FROM (SELECT lvl, lo, hi, (lo + hi) / 2 AS mid, max(pow(p, (lo + hi) / 2 - 1)) / sum(pow(p, (lo + hi) / 2)) AS r
        FROM rep, src WHERE lvl < {LEVELS} GROUP BY lvl, lo, hi) x),
a0 AS (SELECT CASE WHEN h1 < want THEN (SELECT lo FROM ent WHERE lvl = {LEVELS}) ELSE 1.0 END AS a FROM goal),
a AS (SELECT CASE WHEN (SELECT max(pow(p, a0.a - 1)) / sum(pow(p, a0.a)) FROM src, a0) > 4.0
             THEN greatest(a0.a, (SELECT hi FROM rep WHERE lvl = {LEVELS})) ELSE a0.a END AS a FROM a0),
plan AS (SELECT source, st, CAST(floor(pow(p, a) / (SELECT sum(pow(p, a)) FROM src, a) * (SELECT total FROM tot) + 0.5) AS BIGINT) AS budget FROM src, a),
pass AS (SELECT source, st, budget // st AS passes, budget % st AS rest FROM plan),
k AS (SELECT t.*, passes, rest, md5(concat_ws('|', '{SEED}', CAST(passes AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''))) AS key
      FROM t JOIN pass ON t.source IS NOT DISTINCT FROM pass.source),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY key RANGE UNBOUNDED PRECEDING) AS run FROM k),
e AS (SELECT doc_id, source, n_tokens, unnest(range(0, passes + CASE WHEN run <= rest THEN 1 ELSE 0 END)) AS epoch FROM run)
SELECT doc_id, source, n_tokens, epoch, key[1:{BLOCK_DIGITS}] AS block, key AS shuffle_key
FROM (SELECT *, md5(concat_ws('|', '{SEED}', CAST(epoch AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''))) AS key FROM e)
"""
