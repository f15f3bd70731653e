"""Keyed mutable state: target upserts, the target state machine, incremental parsing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orecart import rules
from orecart.functions.text import backoff_ms

MAX_ATTEMPTS = 3
BLOCKED_STATUS = (403, 429, 503)


def fold_upserts(log: DataFrame, seq: str = "seq") -> DataFrame:
    """Current targets from a log of upserts: least priority and depth, greatest score, summed occurrences, united
    queries, latest values, and for some columns the latest that is set; state columns stay as first written.

    Every rule is associative given seq, so the aggregate combines on the map side.
    """
    at = F.col(seq)
    latest = lambda c: F.max_by(c, at).alias(c)
    given = lambda c, ok: F.max_by(c, F.when(ok, at)).alias(c)
    some = lambda c: F.col(c).isNotNull()
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return log.groupBy("url").agg(
        F.min("priority").alias("priority"),
        F.min("depth").alias("depth"),
        F.max("priority_score").alias("priority_score"),
        F.sum("occurrences").alias("occurrences"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("matched_queries")))).alias("matched_queries"),
        *[latest(c) for c in ("domain", "source_type", "discovered_by")],
        *[given(c, filled(c)) for c in ("title", "anchor_text", "archetype")],
        *[given(c, some(c)) for c in ("base_url", "parent_url", "priority_reason", "product_id", "product_name")],
        *[F.min_by(c, at).alias(c) for c in ("state", "attempts", "next_attempt_at")],
    )


def patch(targets: DataFrame, changes: DataFrame, seq: str = "seq") -> DataFrame:
    """Targets after a log of patches by url: only columns that a patch may set, each with its latest change. changes: url, seq, name, value; a null value clears."""
    allowed = [c for c in rules.TARGET_PATCH if c in targets.columns]
    mine = changes.where(F.col("name").isin(allowed))
    last = lambda c: F.max_by(F.struct("value"), F.when(F.col("name") == c, F.col(seq))).alias(f"__{c}")
    wide = mine.groupBy("url").agg(*[last(c) for c in allowed])
    joined = targets.join(wide, "url", "left")
    kinds = dict(targets.dtypes)
    return joined.select(*[F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}.value").cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in allowed else F.col(c) for c in targets.columns])


def product_sources(log: DataFrame, seq: str = "seq") -> DataFrame:
    """Product sources after a log of add, delete, disable and harvested events. An add makes or re-enables one and clears its error; a delete ends it."""
    at, key = F.col(seq), ["product_id", "source_url"]
    last = log.groupBy(*key).agg(F.max(F.when(F.col("kind") == "delete", at)).alias("__gone"))
    live = log.join(last, key).where(F.col("__gone").isNull() | (at > F.col("__gone")))
    when = lambda *kinds: F.when(F.col("kind").isin(*kinds), at)
    out = live.groupBy(*key).agg(
        F.min(when("add")).alias("added"),
        F.max_by("product_name", when("add")).alias("product_name"),
        F.max_by("kind", when("add", "disable")).alias("__switch"),
        F.max_by("discovered", when("harvested")).alias("last_discovered_count"),
        F.max_by(F.struct("error"), when("add", "harvested"))["error"].alias("last_error"),
    )
    return out.where("added IS NOT NULL").withColumn("enabled", F.col("__switch") == "add").drop("added", "__switch")


def step(state: tuple[str, int], kind: str, status: int | None, used: int = 1) -> tuple[str, int]:
    """State and attempts after an event: fetching, done, failed or suppressed."""
    now, attempts = state
    if kind == "fetching":
        return "fetching", attempts
    if kind == "done":
        return "done", 0
    if kind == "suppressed":
        return "blocked", attempts
    attempts += used
    return ("blocked" if status in BLOCKED_STATUS or attempts >= MAX_ATTEMPTS else "failed"), attempts


def machine(events: DataFrame, key: str = "url", seq: str = "seq") -> DataFrame:
    """Batch form: state, attempts and delay per key from its events (kind, status) in order.

    Attempts restart at each `done`, and the last event decides the state, so no fold over a collected
    list is needed: one aggregate per key, then one over the events after the last `done`.
    """
    done = events.groupBy(key).agg(F.max(F.when(F.col("kind") == "done", F.col(seq))).alias("done_at"))
    after = events.join(done, key).where(F.col("done_at").isNull() | (F.col(seq) >= F.col("done_at")))
    out = after.groupBy(key).agg(F.count_if(F.col("kind") == "failed").cast("int").alias("attempts"), F.max_by(F.struct("kind", "status"), seq).alias("last"))
    state = (
        F.when(F.col("last.kind") == "fetching", "fetching")
        .when(F.col("last.kind") == "done", "done")
        .when(F.col("last.kind") == "suppressed", "blocked")
        .when(F.col("last.status").isin(*BLOCKED_STATUS) | (F.col("attempts") >= MAX_ATTEMPTS), "blocked")
        .otherwise("failed")
    )
    return out.select(key, state.alias("state"), "attempts").withColumn("delay_ms", F.when(F.col("state") == "failed", backoff_ms(F.col("attempts"))))


def machine_stream(events: DataFrame, key: str = "url") -> DataFrame:
    """Streaming form: the state of every key that had events in the batch; events of a batch apply in seq order."""

    def run(keys: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state, attempts = held.get if held.exists else ("queued", 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        for kind, status in rows[["kind", "status"]].itertuples(index=False):
            state, attempts = step((state, attempts), kind, None if pd.isna(status) else int(status))
        held.update((state, attempts))
        yield pd.DataFrame({key: [keys[0]], "state": [state], "attempts": [attempts]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, state string, attempts int", "state string, attempts int", "update", "NoTimeout")


def fold_stream(log: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands each micro-batch of the upsert log, already folded, to merge."""
    return log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, epoch: merge(fold_upserts(df), epoch)).start()


def parse_stream(pages: DataFrame, parse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Starts incremental parsing: each page file is parsed once, as the checkpoint remembers."""
    return parse(pages).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def jobs(requests: DataFrame) -> DataFrame:
    """Discovery requests with their idempotent id: equal queries give one job."""
    return requests.withColumn("job_id", F.substring(F.sha2(F.lower(F.trim("query")), 256), 1, 32)).dropDuplicates(["job_id"])


def due(state: Column, next_attempt: Column, now: Column) -> Column:
    return state.isin("queued", "failed") & (next_attempt.isNull() | (next_attempt <= now))
