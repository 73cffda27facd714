"""What the jobs share: their config file, log and command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from dataclasses import fields
from typing import Any

from pyspark.sql import SparkSession


def settings_of(spark: SparkSession, kind: type, path: str | None, given: dict[str, Any]) -> Any:
    """The settings of a config file (a JSON object, read by Spark), those ``given`` before them; unknown names raise."""
    own = json.loads(spark.read.text(path, wholetext=True).head()[0]) if path else {}
    own |= {k: v for k, v in given.items() if v is not None}
    if unknown := set(own) - {f.name for f in fields(kind)}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return kind(**own)


def main(kind: type, run: Callable, about: str) -> None:
    """A command line: ``--config`` and an option for each path of the settings."""
    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--config", help="a JSON file of settings")
    for f in fields(kind):
        if f.type == "str":
            parser.add_argument(f"--{f.name}")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        run(spark, settings_of(spark, kind, given.pop("config"), given))
    finally:
        spark.stop()
