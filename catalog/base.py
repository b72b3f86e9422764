"""Registry, table access and output form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given Parquet tables as attributes; zone-less timestamps become timestamps."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        zoned = {
            f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)
        }
        table = df.withColumns(zoned) if zoned else df
        setattr(self, name, table)
        return table


def tidy(df: DataFrame) -> DataFrame:
    """Output form shared with the SQL: doubles to 6 digits, dates as text, flags as 0/1."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    """Registers a function of Tables, and its SQL when there is one."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = lambda spark, folder: tidy(fn(Tables(spark, folder)))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# SQL spellings of the output form.
def num(expr: str, name: str | None = None) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name or expr.split('.')[-1]}"


def nums(names: str) -> str:
    return ", ".join(num(n) for n in names.split())


def day(expr: str, name: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d') AS {name or expr.split('.')[-1]}"


def moment(expr: str, name: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name or expr.split('.')[-1]}"


def whole(expr: str, name: str | None = None, kind: str = "BIGINT") -> str:
    return f"CAST({expr} AS {kind}) AS {name or expr.split('.')[-1]}"


def int4(expr: str, name: str | None = None) -> str:
    return whole(expr, name, "INTEGER")
