"""Registry of named queries, each with the plain SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewscope.config import EVENTS_STUDY, ORDERS_STUDY
from renewscope.plans.sqltext import compose, study_ctes
from renewscope.sources.adapters import StudyInputs, events_study, orders_study

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
GROUPS: dict[str, str] = {}

_CTES = {"orders": study_ctes(ORDERS_STUDY, "orders"), "events": study_ctes(EVENTS_STUDY, "events")}
_INPUTS = {"orders": orders_study, "events": events_study}


def inputs_of(study: str, spark: SparkSession, sf_dir: str) -> StudyInputs:
    return _INPUTS[study](spark, sf_dir)


def _columns(spec: str) -> list[tuple[str, str]]:
    """'a b:f c:d' -> names with kinds: s text, i whole number, f double, d date."""
    return [tuple((c.split(":") + ["s"])[:2]) for c in spec.split()]


def emit(df: DataFrame, spec: str) -> DataFrame:
    """Same text for dates and same rounding for doubles on both sides."""
    kinds = {
        "s": lambda c: F.col(c).cast("string"),
        "i": lambda c: F.col(c).cast("long"),
        "f": lambda c: F.round(F.col(c).cast("double"), 6),
        "g": lambda c: F.round(F.col(c).cast("double"), 3),
        "d": lambda c: F.date_format(c, "yyyy-MM-dd"),
    }
    return df.select(*[kinds[k](c).alias(c) for c, k in _columns(spec)])


def emit_sql(spec: str) -> str:
    kinds = {
        "s": lambda c: f"CAST({c} AS VARCHAR)",
        "i": lambda c: f"CAST({c} AS BIGINT)",
        "f": lambda c: f"round(CAST({c} AS DOUBLE), 6)",
        "g": lambda c: f"round(CAST({c} AS DOUBLE), 3)",
        "d": lambda c: f"strftime({c}, '%Y-%m-%d')",
    }
    return ", ".join(f"{kinds[k](c)} AS {c}" for c, k in _columns(spec))


def query(name: str, columns: str, sql: str | None = None, study: str = "orders"):
    """Register a function of StudyInputs; `sql` yields the same columns unformatted."""

    def add(fn: Callable[[StudyInputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        GROUPS[name] = fn.__module__.rsplit(".", 1)[-1]
        QUERIES[name] = lambda spark, sf_dir: emit(fn(inputs_of(study, spark, sf_dir)), columns)
        if sql is not None:
            ORACLES[name] = compose(_CTES[study], f"SELECT {emit_sql(columns)} FROM ({sql}) AS result")
        return fn

    return add


def table_query(name: str, columns: str, sql: str | None = None, ctes: dict[str, str] | None = None):
    """Register a function of (spark, sf_dir) over the given tables."""

    def add(fn: Query):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        GROUPS[name] = fn.__module__.rsplit(".", 1)[-1]
        QUERIES[name] = lambda spark, sf_dir: emit(fn(spark, sf_dir), columns)
        if sql is not None:
            ORACLES[name] = compose(ctes or {}, f"SELECT {emit_sql(columns)} FROM ({sql}) AS result")
        return fn

    return add
