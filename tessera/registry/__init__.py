"""Registered queries: each pairs a Spark plan with an independent DuckDB oracle.

A query reads whole tables from a scale-factor folder (or views Spark derives
from them) and returns a DataFrame. Double columns listed in ``digits`` are
rounded half-even on both sides (``bround`` / ``round_even``) so the two
engines' last-bit differences in summation order do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import col
from ..sources.views import with_views


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    views: tuple = ()
    digits: dict = field(default_factory=dict)
    ops: str = ""

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.fn(spark, sf_dir)
        if self.digits:
            df = df.withColumns({c: F.bround(col(c), d) for c, d in self.digits.items()})
        return df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = with_views(self.sql, *self.views)
        if not self.digits:
            return body
        rep = ", ".join(f'round_even("{c}", {d}) as "{c}"' for c, d in self.digits.items())
        return f"select * replace ({rep}) from (\n{body}\n) as _oracle"


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, views=(), digits=None, ops: str = ""):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    if isinstance(digits, str):
        digits = {c: 6 for c in digits.split()}

    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, tuple(views), dict(digits or {}), ops)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    from . import series, profile, prepare, explore, decay, evaluate, train, design_explain, lablog_q, misc_q  # noqa: F401  (import registers the queries)
    return REGISTRY
