"""The stand-in tables of the identification pipeline, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidscan.runtime import table

FN = """fn AS (SELECT vec_id AS pos, 'f' || vec_id AS name, CAST(1 + vec_id % 7 AS INT) AS size, 'lib' || label AS lib,
 'lib' || label || '-' || (vec_id % 3) AS version, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
ED = "ed AS (SELECT 'f' || (event_id % 200) AS src, 'f' || (user_id % 200) AS dst, CAST(1 AS BIGINT) AS dist FROM events)"


def fn(spark: SparkSession, sf: str) -> DataFrame:
    e, i = table(spark, sf, "embeddings"), F.col("vec_id")
    return e.select(
        i.alias("pos"), F.concat(F.lit("f"), i).alias("name"), (1 + i % 7).cast("int").alias("size"), F.concat(F.lit("lib"), "label").alias("lib"),
        F.concat(F.lit("lib"), "label", F.lit("-"), i % 3).alias("version"), "label", F.col("embedding").cast("array<double>").alias("v"),
    )


def ed(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.concat(F.lit("f"), F.col("event_id") % 200).alias("src"), F.concat(F.lit("f"), F.col("user_id") % 200).alias("dst"), F.lit(1).cast("long").alias("dist"))
