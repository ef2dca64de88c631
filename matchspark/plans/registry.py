"""Registered queries and the DuckDB text each is checked against."""
from __future__ import annotations

import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .derive import SQL as DERIVED

CTE: dict[str, str] = dict(DERIVED)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
EPS, DIGITS = 1e-7, 4


def ship_package(spark) -> None:
    """Give the Python workers this package, wherever the driver was started from; once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_matchspark_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/matchspark", "zip", root, "matchspark")
    sc.addPyFile(archive)
    sc._matchspark_shipped = True


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Floating columns rounded the way the SQL side rounds them."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("double", "float"):
            c = F.round(c.cast("double") + EPS, digits)
        elif f.dataType.typeName() in ("byte", "short"):
            c = c.cast("int")
        cols.append(c.alias(f.name))
    return df.select(cols)


def define(name: str, sql: str) -> None:
    """A named table expression other SQL may refer to."""
    CTE[name] = sql


def _deps(sql: str) -> list[str]:
    names = set(re.findall(r"[a-z_][a-z0-9_]*", sql))
    return [n for n in CTE if n in names]


def with_tables(sql: str) -> str:
    """Prefix the WITH chain of every named expression the text needs, dependencies first."""
    chain: dict[str, str] = {}

    def need(text: str, own: str = "") -> None:
        for n in _deps(text):
            if n != own and n not in chain:
                need(CTE[n], n)
                chain[n] = f"{n} AS ({CTE[n]})"
    need(sql)
    return ("WITH " + ",\n".join(chain.values()) + "\n" if chain else "") + sql


def oracles() -> dict[str, str]:
    """DuckDB text per query, built once every named expression is known."""
    return {k: with_tables(v) for k, v in ORACLES.items()}


def query(name: str, sql: str | None = None, doubles: str = "", cte: bool = False):
    """Register a query; `doubles` names the floating columns the SQL side rounds."""
    def wrap(fn):
        def run(spark, sf_dir):
            ship_package(spark)
            return rounded(fn(spark, sf_dir))
        QUERIES[name] = run
        if sql is not None:
            if cte:
                define(name, sql)
                body = f"SELECT * FROM {name}"
            else:
                body = sql
            reps = ", ".join(f'round({c} + {EPS}, {DIGITS}) AS {c}' for c in doubles.split())
            pick = f"* REPLACE ({reps})" if reps else "*"
            ORACLES[name] = f"SELECT {pick} FROM ({body})"
        return fn
    return wrap
