"""What the jobs share: settings, the log, tables that may not be there yet."""

from __future__ import annotations

import argparse
import json
import logging
from importlib import resources

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def settings(name: str, given: dict | None = None) -> dict:
    """The job's settings file with other values for some of them; an unknown name raises."""
    known = json.loads(resources.files("jobs").joinpath(f"{name}.json").read_text())
    if more := set(given or {}) - set(known):
        raise ValueError(f"{name} has no setting {', '.join(sorted(more))}; it has {', '.join(sorted(known))}")
    return known | (given or {})


def there(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame | None:
    """A Parquet table, or None if nothing is at its path."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def main(name: str, what: str, paths: dict[str, str], run) -> None:
    """The command line of a job: ``paths`` are its arguments with their help; it alone makes and stops a session."""
    ask = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=what)
    for path, text in paths.items():
        ask.add_argument(path, help=text)
    ask.add_argument("--settings", help="JSON file with other values for some of the settings in jobs/" + name + ".json")
    args = vars(ask.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s: %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        given = args.pop("settings")
        if given:
            given = json.loads("\n".join(r.value for r in spark.read.text(given).toLocalIterator()))
        run(spark, **args, given=given)
    finally:
        spark.stop()
