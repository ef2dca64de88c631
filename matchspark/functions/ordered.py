"""Order-dependent columns over keyed groups, one plan for every size.

Groups are cut into chunks of the order column. Windows run inside a chunk, all on one ascending sort; what earlier or later
chunks contribute comes from a table of one row per chunk: one aggregate for all columns of a step, one small window, one join.
Nothing runs while the columns are added, and no key gathers in one task.
"""
from __future__ import annotations

from collections.abc import Callable
from copy import copy
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_CONF = "spark.matchspark.chunkRows"        # how far the order column runs inside one chunk
DEFAULT_CHUNK = 8192


def chunk_size(spark: SparkSession) -> int:
    return int(spark.conf.get(CHUNK_CONF, str(DEFAULT_CHUNK)))


@dataclass(frozen=True)
class Step:
    """A column: its value inside the chunk, what a chunk passes on, how passed values add up, and how both combine."""
    here: Callable
    summary: Callable
    carry: Callable
    both: Callable


def _rows(w, strict: bool = False):
    return w.rowsBetween(Window.unboundedPreceding, -1 if strict else 0)


def _ahead(w, strict: bool = False):
    return w.rowsBetween(1 if strict else 0, Window.unboundedFollowing)


def running_sum(expr: Column) -> Step:
    """Sum of expr up to and including the row."""
    return Step(lambda w: F.sum(expr).over(_rows(w)), lambda by: F.sum(expr), lambda v, w: F.sum(v).over(_rows(w, True)),
                lambda here, passed: F.coalesce(passed, F.lit(0)) + here)


def running_max(expr: Column, strict: bool = False) -> Step:
    """Largest value of expr up to the row (before it when strict)."""
    return Step(lambda w: F.max(expr).over(_rows(w, strict)), lambda by: F.max(expr), lambda v, w: F.max(v).over(_rows(w, True)),
                lambda here, passed: F.greatest(passed, here))


def last_value(expr: Column, strict: bool = False) -> Step:
    """Last non-null value up to the row (before it when strict)."""
    return Step(lambda w: F.last(expr, ignorenulls=True).over(_rows(w, strict)),
                lambda by: F.max_by(expr, F.when(expr.isNotNull(), by)),
                lambda v, w: F.last(v, ignorenulls=True).over(_rows(w, True)), F.coalesce)


def next_value(expr: Column, strict: bool = False) -> Step:
    """First non-null value from the row on (after it when strict)."""
    return Step(lambda w: F.first(expr, ignorenulls=True).over(_ahead(w, strict)),
                lambda by: F.min_by(expr, F.when(expr.isNotNull(), by)),
                lambda v, w: F.first(v, ignorenulls=True).over(_ahead(w, True)), F.coalesce)


def _boxed(expr: Column) -> Column:
    """A value that is never null itself, so that a null neighbour and no neighbour differ."""
    return F.struct(expr.alias("v"))


def lag(expr: Column) -> Step:
    """Value of the row before."""
    return Step(lambda w: F.lag(_boxed(expr)).over(w), lambda by: F.max_by(_boxed(expr), by),
                lambda v, w: F.last(v, ignorenulls=True).over(_rows(w, True)), lambda here, passed: F.coalesce(here, passed)["v"])


def lead(expr: Column) -> Step:
    """Value of the row after."""
    return Step(lambda w: F.lead(_boxed(expr)).over(w), lambda by: F.min_by(_boxed(expr), by),
                lambda v, w: F.first(v, ignorenulls=True).over(_ahead(w, True)), lambda here, passed: F.coalesce(here, passed)["v"])


class Ordered:
    """A DataFrame with keys and an order; methods return a new one with columns added.

    Steps are noted, not nested: the rows are always the input, joined with one table of a row per chunk that holds what every step
    carries in, and all columns are computed on one exchange and one sort. Each further `add` reads the input once more, for its summaries.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], chunk_rows: int | None = None):
        self.keys, self.order, self.chunk_rows = list(keys), list(order), chunk_rows or chunk_size(df.sparkSession)
        self._base = df.withColumn("_chunk", F.floor(F.col(order[0]) / F.lit(self.chunk_rows)).cast("long"))
        self._noted: tuple = ()
        self._chunks: DataFrame | None = None

    def _with(self, noted, chunks: DataFrame | None = None) -> "Ordered":
        out = copy(self)
        out._noted, out._chunks = (*self._noted, noted), chunks if chunks is not None else self._chunks
        return out

    def _carried(self) -> list[str]:
        return [c for c in self._chunks.columns if c not in self.keys and c != "_chunk"] if self._chunks is not None else []

    def _rows(self) -> DataFrame:
        """The input with all noted columns, and what the chunk carries in."""
        part = [*self.keys, "_chunk"]
        inside = Window.partitionBy(*part).orderBy(*self.order)
        df = self._base if self._chunks is None else self._base.join(self._chunks, part, "left")
        for level, noted in enumerate(self._noted):
            if callable(noted):
                df = noted(df)
                continue
            df = df.select("*", *[step.here(inside).alias(f"_h_{name}") for name, step in noted.items()])
            new = {name: step.both(F.col(f"_h_{name}"), F.col(f"_c{level}_{name}")) for name, step in noted.items()}
            kept = [c for c in df.columns if c not in new and not (c.startswith("_h_") and c[3:] in new)]
            df = df.select(*kept, *[c.alias(name) for name, c in new.items()])
        return df

    def add(self, **steps: Step) -> "Ordered":
        """Columns that need each other's inputs only, in one pass."""
        part, by = [*self.keys, "_chunk"], F.struct(*self.order)
        level, known = len(self._noted), self._carried()
        sums = self._rows().groupBy(*part).agg(*[F.first(c).alias(c) for c in known], *[s.summary(by).alias(f"_s_{n}") for n, s in steps.items()])
        across = Window.partitionBy(*self.keys).orderBy("_chunk")
        return self._with(steps, sums.select(*part, *known, *[s.carry(F.col(f"_s_{n}"), across).alias(f"_c{level}_{n}") for n, s in steps.items()]))

    def col(self, name: str, expr: Column) -> "Ordered":
        return self._with(lambda df: df.withColumn(name, expr))

    def filter(self, cond: Column) -> "Ordered":
        return self._with(lambda df: df.filter(cond))

    def drop(self, *names: str) -> "Ordered":
        return self._with(lambda df: df.drop(*names))

    @property
    def df(self) -> DataFrame:
        return self._rows().drop(*self._carried())

    def done(self) -> DataFrame:
        return self.df.drop("_chunk")
