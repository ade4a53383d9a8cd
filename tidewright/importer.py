"""python -m tidewright.importer FILE PAIR SIDE [--root FOLDER] [--zone ZONE]: bars of a CSV or Parquet file into the store."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidewright.settings import bar_root, setup_logging
from tidewright.sources.barstore import BarStore, import_bars


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Returns how many new times were stored."""
    asked = argparse.ArgumentParser(description=__doc__)
    asked.add_argument("file")
    asked.add_argument("pair")
    asked.add_argument("side", choices=("bid", "ask"))
    asked.add_argument("--root")
    asked.add_argument("--zone", default="UTC")
    given = asked.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    store = BarStore(spark, given.root or bar_root(spark), given.pair, given.side)
    added = store.append(import_bars(spark, given.file, given.zone))
    setup_logging().info("%s %s: %d new bars, %d in all", given.pair.upper(), given.side, added, store.row_count())
    return added


if __name__ == "__main__":
    main()
