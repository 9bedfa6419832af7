"""Name -> Spark query and name -> oracle SQL, filled by the modules of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with the SQL that must give the same rows."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if oracle is not None:
            ORACLES[key] = oracle
        return f

    return register


from epiframe.plans import aligns, annotations, codec, evaluation, joins, metrics, numbers, parts, selection, stats, streams, windows  # noqa: E402,F401
