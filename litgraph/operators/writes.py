"""Writes that are read back: Turtle, gap stores, extraction batches, evaluation results, and the framing of event streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import shared_folder


def literal(value: Column) -> Column:
    """A string as a Turtle literal."""
    out = value
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return F.concat(F.lit('"'), out, F.lit('"'))


def turtle(triples: DataFrame, folder: str) -> DataFrame:
    """Writes (subject, predicate, object, is_iri) as one statement a line, in as many files as there are tasks; returns the lines read back."""
    iri = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    line = F.concat_ws(" ", iri(F.col("subject")), iri(F.col("predicate")), F.when(F.col("is_iri"), iri(F.col("object"))).otherwise(literal(F.col("object"))), F.lit("."))
    triples.select(line.alias("value")).write.mode("overwrite").text(folder)
    return triples.sparkSession.read.text(folder).select(F.col("value").alias("line"))


def replaced(rows: DataFrame, store: str, partition: str) -> DataFrame:
    """Writes rows as JSON files by partition to a version of their own, and only then names it the current one, so that a reader sees
    the old store or the new one. Returns the store read back."""
    spark = rows.sparkSession
    version = uuid.uuid4().hex
    rows.write.partitionBy(partition).json(f"{store}/{version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{store}/current")
    current = spark.read.text(f"{store}/current").first()[0]
    return spark.read.schema(rows.schema).json(f"{store}/{current}")


def write_extraction(statements: DataFrame, evidence: DataFrame, run: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Validates a batch, then writes its statements and its distinct evidence in the run's own partition; returns both as read back.

    Every statement needs evidence from its own work, or nothing is written.
    """
    own = evidence.select("statement", F.col("work_id").alias("seen")).distinct()
    bad = statements.join(own, (F.col("statement") == F.col("id")) & (F.col("seen") == F.col("work_id")), "left_anti")
    if bad.limit(1).count():
        raise ValueError("a statement has no evidence from its own work; nothing is written")
    for name, rows in (("statements", statements), ("evidence", evidence.distinct())):
        rows.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{folder}/{name}")
    spark = statements.sparkSession
    return spark.read.parquet(f"{folder}/statements"), spark.read.parquet(f"{folder}/evidence")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Per key the new row's values where they are not null, else the old ones."""
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return both.select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns])


def summary(results: DataFrame, folder: str) -> DataFrame:
    """Writes results as JSON, and as lines of a Markdown table; returns the table's lines."""
    results.coalesce(1).write.mode("overwrite").json(f"{folder}/json")
    back = results.sparkSession.read.schema(results.schema).json(f"{folder}/json")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in results.columns]), F.lit(" |"))
    back.select(row.alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/markdown")
    return results.sparkSession.read.text(f"{folder}/markdown").select(F.col("value").alias("line"))


def frame(kind: Column, data: Column) -> Column:
    """One event of a stream: its kind, and a data line for each line of its text."""
    return F.concat(F.lit("event: "), kind, F.lit("\n"), F.concat(F.lit("data: "), F.replace(data, F.lit("\n"), F.lit("\ndata: "))), F.lit("\n\n"))


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"
