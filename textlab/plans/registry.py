"""Registered queries: one per SURVEY id, each with its DuckDB oracle SQL.

``QUERIES[id](spark, sf_dir) -> DataFrame`` reads the driver's parquet tables
(through ``textlab.fixtures``).  ``ORACLE[id]`` is the same result in SQL over
the pre-registered views.  Doubles are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab import fixtures as fx
from textlab.functions.text import COMPARE_EXCLUDE, PUNCT

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(qid: str, sql: str | None = None):
    def deco(fn):
        QUERIES[qid] = fn
        if sql is not None:
            ORACLE[qid] = sql.strip()
        return fn
    return deco


def r6(c) -> "F.Column":
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# Shared SQL fragments (DuckDB dialect) -------------------------------------------------
WORD_RE = r"[\p{L}\p{M}\p{N}]+"
TOKEN_RE = r"([\p{L}\p{M}\p{N}]+|\s+|[^\p{L}\p{M}\p{N}\s])"


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PUNCT_SQL = sql_text(PUNCT)
EXCL_SQL = "(" + ", ".join(map(sql_text, COMPARE_EXCLUDE)) + ")"
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in fx.STOPWORDS_10) + ")"

SQL_FREQ = f"""(select w as word, count(*)::BIGINT as frequency
  from (select unnest(regexp_extract_all(lower(text), '{WORD_RE}')) as w from documents) group by w)"""


def sql_corpus(side: str) -> str:
    op = "<" if side == "a" else ">="
    return f"(select * from documents where try_cast(substr(source, 4) as integer) {op} 10)"


def sql_freq_of(src: str) -> str:
    return f"""(select w as word, count(*)::BIGINT as frequency
  from (select unnest(regexp_extract_all(lower(text), '{WORD_RE}')) as w from {src}) group by w)"""


SQL_FA = sql_freq_of(sql_corpus("a"))
SQL_FB = sql_freq_of(sql_corpus("b"))
SQL_FA_F = f"(select * from {SQL_FA} where frequency > 5 and word not in {EXCL_SQL})"
SQL_FB_F = f"(select * from {SQL_FB} where frequency > 5 and word not in {EXCL_SQL})"
SQL_ALIGNED = f"(select a.word, a.frequency as o1, b.frequency as o2 from {SQL_FA_F} a join {SQL_FB_F} b using (word))"
SQL_LL = f"""(select word, o1, o2, e1, e2, 2.0 * (o1 * ln(o1 / e1) + o2 * ln(o2 / e2)) as ll from (
  select word, o1, o2, n1 * (o1 + o2) / (n1 + n2) as e1, n2 * (o1 + o2) / (n1 + n2) as e2
  from {SQL_ALIGNED}, (select sum(o1)::DOUBLE as n1, sum(o2)::DOUBLE as n2 from {SQL_ALIGNED})))"""

# Import the per-area registrations (each module calls ``register``).
from textlab.plans import q_corpus, q_io, q_knn, q_labels, q_metrics, q_models, q_split  # noqa: E402,F401
