"""Query catalogue: name -> (Spark builder, DuckDB oracle SQL).

Builders take ``(spark, sf_dir)`` and return a lazy DataFrame.  Oracles are
independent SQL over the role views (prefixed automatically) — omitted for
operators that are not SQL-expressible (fitted models, file round trips).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..sources.roles import with_roles

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None, round_cols: Sequence[str] = ()):
    """Register a query; ``round_cols`` are rounded to 6 digits in the oracle
    (the Spark side rounds every double column the same way)."""
    def deco(fn):
        def run(spark, sf_dir, _fn=fn):
            return round_doubles(_fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_roles(rounded(oracle, round_cols) if round_cols else oracle)
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column to ``digits`` the way SQL engines round binary
    doubles (scale, round half away from zero, unscale) — Spark's decimal
    rounding of the shortest text form differs on exact ``...5`` ties."""
    from ..functions.scalar import sql_round
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(sql_round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def rounded(sql: str, cols: Sequence[str], digits: int = 6) -> str:
    """Wrap ``sql`` so the named columns are rounded (CTEs stay at the top)."""
    rep = ", ".join(f'round(CAST("{c}" AS DOUBLE), {digits}) AS "{c}"' for c in cols)
    body = sql.strip()
    if body[:4].upper() == "WITH":
        # split off the final SELECT: wrap it as a CTE named _final
        idx = _final_select_index(body)
        head, tail = body[:idx].rstrip().rstrip(","), body[idx:]
        return f"{head},\n_final AS (\n{tail}\n)\nSELECT * REPLACE ({rep}) FROM _final"
    return f"SELECT * REPLACE ({rep}) FROM (\n{body}\n) _final"


def _final_select_index(sql: str) -> int:
    """Index of the top-level SELECT that follows the WITH list."""
    depth = 0
    i = 0
    up = sql.upper()
    while i < len(sql):
        ch = sql[i]
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "'":
            j = sql.index("'", i + 1)
            i = j
        elif depth == 0 and up.startswith("SELECT", i) and i > 4:
            return i
        i += 1
    raise ValueError("no final SELECT found")
