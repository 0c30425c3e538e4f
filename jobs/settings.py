"""Settings of a job: a dataclass, its TOML file, and what the command line says otherwise."""

from __future__ import annotations

import argparse
import dataclasses
import logging
import tomllib
from pathlib import Path
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


def from_command_line(kind: type[T], default: str, about: str, argv: list[str] | None = None) -> T:
    """The settings of ``--config`` (by default the file beside the job), with every ``--name value`` that is given in its place."""
    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--config", default=str(Path(__file__).parent / default))
    fields = {f.name: type(f.default) for f in dataclasses.fields(kind)}
    for name, of in fields.items():
        parser.add_argument("--" + name.replace("_", "-"), type=of, default=None)
    given = vars(parser.parse_args(argv))
    with open(given.pop("config"), "rb") as f:
        told = tomllib.load(f)
    if unknown := told.keys() - fields.keys():
        parser.error(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**told | {k: v for k, v in given.items() if v is not None})


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s: %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
