"""Run control: page fetch guards, rate plans, budgets, evaluation counts, memoised calls, failover, stored configuration."""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orecart import rules
from orecart.operators.relevance import numbered


def acceptable(content_type: Column, body: Column, most: int = rules.PAGE_BYTES) -> Column:
    """Whether a response is a page: text of a known type (or none named) within the size limit in UTF-8 bytes."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    known = kind == ""
    for part in rules.PAGE_TYPES:
        known = known | kind.contains(part)
    return known & (F.octet_length(F.coalesce(body, F.lit(""))) <= most)


def fetch_schedule(fetches: DataFrame, order: str = "seq", per_minute: int = 120, domain_delay: int = 2) -> DataFrame:
    """Earliest start of every fetch in seconds: the overall rate in order, and a delay between two of one domain."""
    own = F.row_number().over(Window.partitionBy("domain").orderBy(order)) - 1
    return numbered(fetches, order, "__n").withColumn("start_s", F.greatest(F.floor(F.col("__n") * 60 / per_minute), own * domain_delay).cast("long")).drop("__n")


def within_budget(calls: DataFrame, most: int, run: str = "run_id", order: str = "seq") -> DataFrame:
    """Calls of a run in order; those beyond its budget are marked, not made."""
    n = F.row_number().over(Window.partitionBy(run).orderBy(order))
    return calls.withColumn("allowed", n <= most)


def usage(calls: DataFrame, most: int, run: str = "run_id") -> DataFrame:
    """Calls made and the budget, per run."""
    return calls.groupBy(run).agg(F.least(F.count("*"), F.lit(most)).alias("calls")).withColumn("max_calls", F.lit(most).cast("long"))


def eval_metrics(cases: DataFrame) -> DataFrame:
    """Leaks (expected blocked, got through), correct answers and precision of `approved`. cases: expected, actual."""
    good = F.count_if((F.col("actual") == "approved") & (F.col("expected") == "approved"))
    said = F.count_if(F.col("actual") == "approved")
    return cases.agg(
        F.count_if((F.col("expected") == "blocked") & (F.col("actual") != "blocked")).alias("leaks"),
        F.count_if(F.col("expected") == F.col("actual")).alias("correct"),
        F.count("*").alias("cases"),
        F.when(said > 0, good / said).alias("precision"),
    )


def memoized(rows: DataFrame, key: str, call: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """call gets every distinct key once and returns the key with its answers; they are joined back to all rows. A null key has no answer."""
    return rows.join(call(rows.select(key).where(F.col(key).isNotNull()).distinct()), key, "left")


class Channel:
    """The first backend in order whose probe holds; a call that fails probes once more and tries again.

    backends: (name, probe, call). Driver-side control: each backend's call may be a Spark scan.
    """

    def __init__(self, kind: str, backends: Sequence[tuple[str, Callable[[], bool], Callable]]) -> None:
        self.kind, self.backends, self.active, self.last_error = kind, list(backends), None, None

    def probe(self) -> str | None:
        self.active = None
        for name, alive, call in self.backends:
            try:
                if alive():
                    self.active = (name, call)
                    return name
            except Exception as e:  # noqa: BLE001  an unhealthy backend may fail in any way
                self.last_error = str(e)
        return None

    def run(self, *args, **kwargs):
        if self.active is None and self.probe() is None:
            raise RuntimeError(f"{self.kind}: no working backend")
        try:
            return self.active[1](*args, **kwargs)
        except Exception as e:
            self.last_error = str(e)
            if self.probe() is None:
                raise
            return self.active[1](*args, **kwargs)

    def status(self) -> dict:
        return {"type": self.kind, "active": self.active[0] if self.active else None, "candidates": [x[0] for x in self.backends], "last_error": self.last_error}


@dataclass(frozen=True)
class Config:
    """Limits of a run, read from the environment under upper-case names with a prefix."""

    search_queries: int = rules.SEARCH_QUERIES
    search_pages: int = 1
    cache_days: int = 30
    discovery_limit: int = 200
    target_count: int = 10
    pages_per_domain: int = rules.NEXT_FETCHES
    requests_per_minute: int = 120
    domain_delay_s: int = 2
    page_bytes: int = rules.PAGE_BYTES
    max_calls: int = 50
    bypass_cache: bool = False

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None, prefix: str = "ORECART_") -> Config:
        """Numbers must be whole and not negative, switches true/false, 1/0 or yes/no; anything else is an error that names the variable."""
        env, found = os.environ if env is None else env, {}
        for f in fields(cls):
            name = prefix + f.name.upper()
            text = str(env.get(name, "")).strip()
            if not text:
                continue
            if isinstance(f.default, bool):
                if text.lower() not in ("true", "false", "1", "0", "yes", "no"):
                    raise ValueError(f"{name} must be true or false")
                found[f.name] = text.lower() in ("true", "1", "yes")
            else:
                if not text.isascii() or not text.isdigit():
                    raise ValueError(f"{name} must be a whole number")
                found[f.name] = int(text)
        return cls(**found)


class Log:
    """Events as JSON lines from a level on."""

    LEVELS = ("debug", "info", "warn", "error")

    def __init__(self, level: str = "info", out=None, **context: object) -> None:
        self.least, self.out, self.context = self.LEVELS.index(level), out, context

    def write(self, level: str, message: str, **more: object) -> None:
        if self.LEVELS.index(level) >= self.least:
            print(json.dumps({"time": time.time(), "level": level, "message": message, **self.context, **more}, default=str), file=self.out or sys.stderr)
