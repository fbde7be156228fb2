"""The register of queries: what the modules of this folder put in, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tramline.plans.views import frame, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function of (get,) under its name; get(name) gives a table or view."""

    def register(build: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(lambda name: frame(spark, sf_dir, name))
        if oracle:
            ORACLES[build.__name__] = with_views(oracle)
        return build

    return register
