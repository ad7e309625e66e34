"""Commands: python -m klaxon ingest STORE LOG.csv | demo STORE | report STORE | dump STORE FILE.json"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import report
from .plans.service import Service
from .sources.store import ParquetStore


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> str:
    parser = argparse.ArgumentParser(prog="klaxon", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, more in (("ingest", "log"), ("demo", None), ("report", None), ("dump", "file")):
        command = commands.add_parser(name)
        command.add_argument("store")
        if more:
            command.add_argument(more)
    given = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("klaxon").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = ParquetStore(spark, given.store)
    if given.command == "ingest":
        return f"{report.ingest_log(spark, store, given.log)} rows rejected"
    if given.command == "demo":
        return f"{report.ingest_synthetic(spark, store).n} incidents planted"
    if given.command == "report":
        return report.report(Service(store), report.truth_of(store))
    report.dump(Service(store), given.file)
    return given.file


if __name__ == "__main__":
    print(main())
