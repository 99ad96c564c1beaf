"""Registry of queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """Lazy access to the parquet tables of one folder: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None = None
    note: str = ""


@dataclass
class Registry:
    queries: dict[str, Query] = field(default_factory=dict)

    def add(self, name: str, covers: str, sql: str | None = None, note: str = ""):
        """Register ``build(tables)`` with the operator ids it covers (space separated)."""

        def register(build):
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = Query(name, tuple(covers.split()), build, sql, note)
            return build

        return register

    def run(self, name: str, spark: SparkSession, folder: str) -> DataFrame:
        return self.queries[name].build(Tables(prepare(spark), folder))


REGISTRY = Registry()
query = REGISTRY.add


def _nudge(digits: int) -> str:
    """A step far below the last kept digit.

    Means of short decimals often end exactly on a rounding tie, where the last
    bit of a sum decides; adding this to both sides makes ties round alike.
    """
    return f"1e-{digits + 3}"


def rnd(expr: str, digits: int = 6) -> str:
    """SQL for a rounded double without negative zero."""
    return f"(round(CAST({expr} AS DOUBLE) + {_nudge(digits)}, {digits}) + 0.0)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, so that engines that add in another order agree."""
    from pyspark.sql import functions as F

    step = float(_nudge(digits))
    return df.select(*[
        (F.round(F.col(f"`{c}`") + step, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`")
        for c, t in df.dtypes
    ])
