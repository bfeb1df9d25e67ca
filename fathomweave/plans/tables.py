"""Access to the driver's tables, registration, and the stand-ins made from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(queries: dict, oracles: dict, sql: str | None = None, name: str | None = None) -> Callable:
    """Decorator: registers a query with its SQL."""

    def add(f: Callable) -> Callable:
        queries[name or f.__name__] = f
        if sql is not None:
            oracles[name or f.__name__] = sql
        return f

    return add


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def quoted(value: object) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def values_sql(values: list[tuple], columns: str) -> str:
    return "(values " + ", ".join("(" + ", ".join(map(quoted, v)) + ")" for v in values) + f") as t({columns})"


def pick(number: str, values: list[str]) -> str:
    """SQL of both engines: one of ``values`` by the remainder of a number that isn't negative."""
    return f"case ({number}) % {len(values)} " + " ".join(f"when {i} then {quoted(v)}" for i, v in enumerate(values)) + " end"


#: Words of conversations that stand for parameters, keys and messages.
PARAMETERS = ["ation", "the", "que", "ing", "und", "ent"]
KEYS = ["ble", "eau", "sch"]
MESSAGES = ["user request", "assistant reply", "the", "status"]


def procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as procedures: turns are steps, roles network functions."""
    c = table(spark, sf_dir, "conversations").withColumn("procedure", F.concat(F.lit("conv_"), F.col("conv_id")))
    step = F.struct(F.col("turn").alias("ord"), F.concat(F.col("procedure"), F.lit("_step_"), F.col("turn")).alias("name"), F.col("text").alias("description"))
    roles = F.array_sort(F.collect_set("role"))
    roles = F.when(F.bool_or(F.col("role").isNull()), F.array_append(roles, F.lit(None).cast("string"))).otherwise(roles)  # a null role is one too
    wide = c.groupBy("procedure").agg(F.array_sort(F.collect_list(step)).alias("steps"), roles.alias("network_functions"))
    words = lambda ws: F.array(*[F.lit(w) for w in ws])
    return wide.withColumn("messages", words(MESSAGES)).withColumn("parameters", words(PARAMETERS)).withColumn("keys", words(KEYS))


def word_rows(words: list[str]) -> str:
    return "(values " + ", ".join(f"({i}, {quoted(w)})" for i, w in enumerate(words)) + ") as w(ord, word)"


STEPS_SQL = """steps as (select 'conv_' || conv_id as procedure, 'conv_' || conv_id || '_step_' || turn as name, role, text, turn,
  row_number() over (partition by conv_id order by turn) - 1 as idx, count(*) over (partition by conv_id) as n from conversations)"""
ROLES_SQL = """roles as (select distinct 'conv_' || conv_id as procedure, role from conversations)"""
