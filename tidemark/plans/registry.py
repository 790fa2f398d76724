"""Registration of queries: name, function of (spark, sf_dir), and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables, and the memory model's tables made of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def keywords(self, of: str, columns: tuple[str, ...]):
        """The kept keyword index of one of the model's tables, in the shared folder: later queries on the same tables find it."""
        from hashlib import sha256

        from tidemark.operators.keyword_index import KeywordIndex
        from tidemark.work import base_dir

        named = sha256(f"{self.dir}|{of}|{columns}".encode()).hexdigest()[:24]
        return KeywordIndex(self.spark, f"{base_dir(self.spark)}/keywords-{named}", columns)

    def __getattr__(self, name: str) -> DataFrame:
        from tidemark.plans import model

        make = getattr(model, name, None)
        return make(self) if make else self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Register a function of Tables as a query; {entries} and the like in the SQL stand for the model's tables."""

    def register(f):
        from tidemark.plans import model

        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            text = sql
            for k, v in model.SQL.items():
                text = text.replace("{" + k + "}", f"({v})")
            ORACLES[key] = text
        return f

    return register
