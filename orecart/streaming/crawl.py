"""Crawling a page corpus: level by level as joins, or as a stream with state and timers per domain.

Both forms admit the same pages: a URL once, only where the domain's robots rules let it, in order of
depth, priority and URL, at most so many a domain. The batch form is a loop over depths; the stream keeps
for each domain its visited URLs and those that wait, and a timer gives a page its turn after the
domain's delay, or once more after a failure, with growing pauses. What a fetch finds goes back to the
stream as rows, so its micro-batches are the levels.

Defined cases: a page that the corpus does not hold fails as any other and is tried again; 403, 429 and
503 end at once; a null URL or domain is no request; of a URL asked for twice the least depth and priority
count; an empty corpus lets all seeds fail.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from orecart.functions import url as U
from orecart.streaming.targets import BLOCKED_STATUS, MAX_ATTEMPTS, step

# Pages of a domain, depth of links, pause between two pages of a domain, first and longest pause after a failure.
PAGES_PER_DOMAIN, MAX_DEPTH, DELAY_MS, BACKOFF_MS, LONGEST_MS = 8, 1, 2_000, 2_000, 30_000


def robots_rules(files: DataFrame) -> DataFrame:
    """domain, allow, pattern for all agents, from robots files (domain, text): the lines of the groups that name `*`.

    Lines after one agent line or several belong to all of them, up to the next agent line.
    """
    line = F.regexp_extract(F.trim(F.regexp_replace("line", "#.*$", "")), r"(?i)^(user-agent|allow|disallow)\s*:\s*(.*)$", 1)
    value = F.trim(F.regexp_extract(F.trim(F.regexp_replace("line", "#.*$", "")), r"(?i)^(user-agent|allow|disallow)\s*:\s*(.*)$", 2))
    lines = files.select("domain", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line")).select("domain", "n", F.lower(line).alias("kind"), value.alias("value")).where("kind <> ''")
    w = Window.partitionBy("domain").orderBy("n")
    starts = (F.col("kind") == "user-agent") & (F.coalesce(F.lag("kind").over(w), F.lit("")) != "user-agent")
    grouped = lines.withColumn("group", F.sum(starts.cast("int")).over(w))
    ours = F.max(F.when((F.col("kind") == "user-agent") & (F.col("value") == "*"), 1)).over(Window.partitionBy("domain", "group"))
    return grouped.withColumn("ours", ours).where("ours = 1 AND kind <> 'user-agent' AND value <> ''").select("domain", (F.col("kind") == "allow").alias("allow"), F.col("value").alias("pattern")).distinct()


def allowed(requests: DataFrame, robots: DataFrame) -> DataFrame:
    """Requests that the longest matching rule of their domain allows; of equally long ones an allowing rule counts, without any the request is allowed."""
    literal = F.regexp_replace(F.regexp_replace("pattern", r"([\\.^$|?+()\[\]{}])", r"\\$1"), r"\*", ".*")
    rules = robots.select(F.col("domain").alias("__d"), "allow", F.length("pattern").alias("__n"), F.concat(F.lit("^"), F.regexp_replace(literal, r"\\\$$", r"\$")).alias("__p"))
    path = F.concat(U._part(F.col("url"), 3), U._part(F.col("url"), 4))
    asked = requests.select("domain", "url").distinct().withColumn("__path", F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))
    met = asked.join(rules, (F.col("domain") == F.col("__d")) & F.expr("__path RLIKE __p"))
    barred = met.groupBy("domain", "url").agg(F.max_by("allow", F.struct("__n", "allow")).alias("allow")).where("NOT allow").select("domain", "url")
    return requests.join(barred, ["domain", "url"], "left_anti")


def _wanted(requests: DataFrame, robots: DataFrame) -> DataFrame:
    once = requests.where("domain IS NOT NULL AND url IS NOT NULL").groupBy("domain", "url").agg(F.min("priority").alias("priority"))
    return allowed(once, robots)


def found_links(fetched: DataFrame, pages: DataFrame, links: DataFrame) -> DataFrame:
    """domain, url, priority of the same-domain links of pages that were read. links: src, url, domain, priority."""
    read = fetched.select("domain", "url").join(pages.where("status = 200").select("url"), "url")
    return read.withColumnRenamed("url", "src").join(links.withColumnRenamed("domain", "to"), "src").where("domain = to").select("domain", "url", "priority")


def crawl(pages: DataFrame, links: DataFrame, seeds: DataFrame, robots: DataFrame, max_depth: int = MAX_DEPTH, per_domain: int = PAGES_PER_DOMAIN) -> DataFrame:
    """domain, url, depth, state, attempts of all pages admitted. pages: url, status; seeds: domain, url, priority.

    A level ranks its requests within each domain behind the pages that the domain has already; the tables of the levels are cut off by checkpoints.
    """
    asked, done = seeds.select("domain", "url", "priority"), None
    for depth in range(max_depth + 1):
        fresh = _wanted(asked, robots)
        if done is None:
            fresh = fresh.withColumn("used", F.lit(0))
        else:
            used = done.groupBy("domain").agg(F.count("*").alias("used"))
            fresh = fresh.join(done.select("domain", "url"), ["domain", "url"], "left_anti").join(used, "domain", "left").fillna(0, ["used"])
        place = F.row_number().over(Window.partitionBy("domain").orderBy("priority", "url"))
        level = fresh.withColumn("place", place).where(F.col("place") + F.col("used") <= per_domain).select("domain", "url", F.lit(depth).alias("depth")).checkpoint()
        done = level if done is None else done.unionByName(level)
        asked = found_links(level, pages, links)
    status = done.join(pages.select("url", "status"), "url", "left")
    state = F.when(F.col("status") == 200, "done").otherwise("blocked")
    attempts = F.when(F.col("status") == 200, 0).when(F.col("status").isin(*BLOCKED_STATUS), 1).otherwise(MAX_ATTEMPTS)
    return status.select("domain", "url", "depth", state.alias("state"), attempts.alias("attempts"))


EVENT = "domain string, kind string, url string, depth int, priority long, attempt int, status int"
ORDER = "domain string, kind string, url string, depth int, attempt int, state string"


class Domain(StatefulProcessor):
    """One domain's crawl: which URLs it has taken up, and which wait for their time."""

    def __init__(self, per_domain: int, delay_ms: int, backoff_ms: int, longest_ms: int) -> None:
        self.per_domain, self.delay_ms, self.backoff_ms, self.longest_ms = per_domain, delay_ms, backoff_ms, longest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.visited = handle.getMapState("visited", "url string", "depth int, attempts int")
        self.waiting = handle.getMapState("waiting", "url string", "due long")
        self.counts = handle.getValueState("counts", "pages int, free_at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        events = pd.concat(list(rows))
        pages, free_at = self.counts.get() if self.counts.exists() else (0, 0)
        for e in events[events["kind"] == "outcome"].itertuples(index=False):
            depth, attempts = self.visited.getValue((e.url,))
            if attempts != e.attempt:  # an outcome that came twice
                continue
            state, attempts = step(("fetching", attempts), "done" if e.status == 200 else "failed", int(e.status))
            self.visited.updateValue((e.url,), (depth, attempts if state != "done" else -1))
            if state == "failed":
                self._wait(e.url, now + min(self.backoff_ms << (attempts - 1), self.longest_ms))
            else:
                out.append((key[0], "final", e.url, depth, attempts, state))
        asked = events[events["kind"] == "request"].sort_values(["depth", "priority", "url"]).drop_duplicates("url")
        for e in asked.itertuples(index=False):
            if pages < self.per_domain and not self.visited.containsKey((e.url,)):
                pages += 1
                self.visited.updateValue((e.url,), (int(e.depth), 0))
                due = max(now, free_at)
                free_at = due + self.delay_ms
                if due > now:
                    self._wait(e.url, due)
                else:
                    out.append((key[0], "fetch", e.url, int(e.depth), 0, None))
        self.counts.update((pages, free_at))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for (url,) in sorted(url for url, due in self.waiting.iterator() if due[0] <= at):
            depth, attempts = self.visited.getValue((url,))
            out.append((key[0], "fetch", url, depth, attempts, None))
            self.waiting.removeKey((url,))
        yield self._frame(out)

    def _wait(self, url: str, due: int) -> None:
        self.waiting.updateValue((url,), (due,))
        self.handle.registerTimer(due)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[x.split()[0] for x in ORDER.split(", ")])


def crawl_stream(spark: SparkSession, pages: DataFrame, links: DataFrame, seeds: DataFrame, robots: DataFrame, folder: str, max_depth: int = MAX_DEPTH, per_domain: int = PAGES_PER_DOMAIN, delay_ms: int = DELAY_MS, backoff_ms: int = BACKOFF_MS):
    """Starts the stream; finished pages are written to folder/done as Parquet (the columns of crawl()). Needs the RocksDB state store.

    folder/events takes the seeds, and what each micro-batch's fetches find: links of the next depth, and outcomes. A batch that is
    run again replaces its files, and a row that comes twice changes nothing.
    """
    inbox, names = f"{folder}/events", [x.split()[0] for x in EVENT.split(", ")]
    empty = {"depth": F.lit(0), "attempt": F.lit(0), "status": F.lit(None).cast("int")}
    _wanted(seeds, robots).withColumns({"kind": F.lit("request"), **empty}).select(*names).write.json(f"{inbox}/seeds")

    def fetch(batch: DataFrame, epoch: int) -> None:
        rows = batch.persist()
        asked = rows.where("kind = 'fetch'").join(pages.select("url", "status"), "url", "left").withColumn("status", F.coalesce("status", F.lit(404)))
        outcome = asked.select("domain", F.lit("outcome").alias("kind"), "url", "depth", F.lit(0).cast("long").alias("priority"), "attempt", "status")
        depths = rows.where(F.col("kind") == "fetch").select("domain", F.col("url").alias("src"), (F.col("depth") + 1).alias("depth")).where(F.col("depth") <= max_depth)
        read = depths.join(pages.where("status = 200").select(F.col("url").alias("src")), "src").join(links.withColumnRenamed("domain", "to"), "src").where("domain = to")
        more = read.groupBy("domain", "url").agg(F.min(F.struct("depth", "priority")).alias("at")).select("domain", "url", "at.*")
        more = allowed(more, robots).withColumns({"kind": F.lit("request"), "attempt": F.lit(0), "status": F.lit(None).cast("int")})
        outcome.unionByName(more.select(*names)).write.mode("overwrite").json(f"{inbox}/batch-{epoch}")
        rows.where("kind = 'final'").select("domain", "url", "depth", "state", F.col("attempt").alias("attempts")).write.mode("overwrite").parquet(f"{folder}/done/batch-{epoch}")
        rows.unpersist()

    events = spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").json(inbox)
    orders = events.groupBy("domain").transformWithStateInPandas(Domain(per_domain, delay_ms, backoff_ms, LONGEST_MS), ORDER, "Append", "ProcessingTime")
    return orders.writeStream.foreachBatch(fetch).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="0 seconds").start()

