"""A survey of how well a growing archive of texts can be coded.

Input: a folder (or file) of Parquet files with texts.  Output, partitioned by group: bytes, runs, entropy of a byte alone and after the byte
before, and the size of the Huffman-coded bytes, so that coders can be chosen before any data are coded.

A file stream takes the files that are new since the last run (its checkpoint knows them) and then ends.  The counts of all files so far are
``out``/counts/batch=k, made of those of batch k - 1 and the new files, so a batch that is done again gives what it gave before.
``out``/survey is derived from the last counts at the end of each run, also of one without new files: the run before may have been stopped.

Null texts and empty ones have no bytes; a null group is one of its own.  A group without bytes has no row.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobs.common import main, settings, there
from swirlframe.operators import coding

NAME = "symbol_survey"
log = logging.getLogger(NAME)

COUNTS = T.StructType([T.StructField("before", T.IntegerType()), T.StructField("sym", T.IntegerType()), T.StructField("n", T.LongType())])


def counts_schema(group: T.StructField) -> T.StructType:
    return T.StructType([group, *COUNTS.fields, T.StructField("batch", T.LongType())])


def last_counts(spark: SparkSession, out: str, group: T.StructField) -> DataFrame | None:
    """The counts of the last batch, without its number, or None before the first one."""
    every = there(spark, f"{out}/counts", counts_schema(group))
    last = None if every is None else every.agg(F.max("batch")).first()[0]
    return None if last is None else every.filter(F.col("batch") == last).drop("batch")


def added(out: str, group: T.StructField, text: str):
    """What is done with each batch of new rows."""

    def add(rows: DataFrame, batch: int) -> None:
        spark, by = rows.sparkSession, group.name
        new = coding.byte_pairs(rows, by, text)
        if batch:
            before = spark.read.schema(counts_schema(group)).parquet(f"{out}/counts").filter(F.col("batch") == batch - 1).drop("batch")
            new = before.unionByName(new).groupBy(by, "before", "sym").agg(F.sum("n").alias("n"))
        # a new checkpoint begins anew: the first batch replaces all counts, any other one its own
        how = "dynamic" if batch else "static"
        new.withColumn("batch", F.lit(batch).cast("long")).repartition(by).write.mode("overwrite").option("partitionOverwriteMode", how).partitionBy("batch").parquet(f"{out}/counts")
        log.info("counted batch %d", batch)

    return add


def run(spark: SparkSession, texts: str, out: str, checkpoint: str, given: dict | None = None) -> dict:
    """Takes the new files of ``texts`` into the survey at ``out``; returns n_rows, the number of rows read."""
    cfg = settings(NAME, given)
    schema = spark.read.parquet(texts).schema
    group = T.StructField(cfg["by"], schema[cfg["by"]].dataType)
    # a pattern that only this path matches: a stream takes a plain path for a folder, and this may be a file
    same = f"{texts.rstrip('/')[:-1]}[{texts.rstrip('/')[-1]}]"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", cfg["files_per_batch"]).parquet(same).select(cfg["by"], cfg["text"])
    query = stream.writeStream.foreachBatch(added(out, group, cfg["text"])).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    n = sum(p["numInputRows"] for p in query.recentProgress)
    log.info("read %d new rows of %s", n, texts)
    counts = last_counts(spark, out, group)
    if counts is not None:
        table = coding.pair_statistics(counts, cfg["by"])
        # names of folders have to tell null from an empty name
        part = F.coalesce(F.concat(F.lit("="), F.col(cfg["by"]).cast("string")), F.lit("null"))
        table.withColumn("part", part).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("part").parquet(f"{out}/survey")
        log.info("wrote the survey to %s/survey", out)
    return {"n_rows": n}


def surveyed_schema(group: T.StructField) -> T.StructType:
    return T.StructType([group, *(T.StructField(c, T.DoubleType() if c in ("entropy_bits", "order1_bits") else T.LongType()) for c in ("n_texts", "n_bytes", "n_runs", "n_symbols", "entropy_bits", "order1_bits", "huffman_bits")), T.StructField("part", T.StringType())])


def survey(spark: SparkSession, out: str, group: T.StructField) -> DataFrame:
    """The output of all runs."""
    made = there(spark, f"{out}/survey", surveyed_schema(group))
    return spark.createDataFrame([], surveyed_schema(group)) if made is None else made


if __name__ == "__main__":
    main(NAME, __doc__, {"texts": "folder of Parquet files with texts", "out": "folder of the counts and the survey", "checkpoint": "folder of the stream's checkpoint"}, run)
