"""Counts, rates and value ranges that a job gathers while it runs, without a pass of their own."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


class Progress:
    """Observes a step's rows: ``watch`` adds the metrics, which are there once an action has run.

    The counts follow the rows, so a task that is run again counts once.
    """

    def __init__(self, name: str):
        self.name, self.began = name, time.monotonic()
        self.observation = Observation(name)
        self.ranged: tuple[str, ...] = ()

    def watch(self, rows: DataFrame, *ranged: str) -> DataFrame:
        """``rows`` with their count and the least and greatest values of the ``ranged`` columns observed."""
        self.ranged = ranged
        ends = [f(c).cast("double").alias(f"{n}_{c}") for c in ranged for n, f in (("min", F.min), ("max", F.max))]
        return rows.observe(self.observation, F.count(F.lit(1)).alias("items"), *ends)

    def report(self) -> dict:
        """step, items, seconds, millions of items a second, and the ranges; waits for the action."""
        got = dict(self.observation.get)
        seconds = time.monotonic() - self.began
        return {"step": self.name, "seconds": seconds, "rate_m": got["items"] / max(seconds, 1e-9) / 1e6, **got}

    def metrics(self, spark: SparkSession) -> DataFrame:
        """One row: step, items and the ranges (null where there was no row)."""
        ends = [f"{n}_{c}" for c in self.ranged for n in ("min", "max")]
        got = self.observation.get
        return spark.createDataFrame([(self.name, got["items"], *[got[e] for e in ends])], ", ".join(["step string", "items long", *[f"{e} double" for e in ends]]))
