"""Calls of a text provider over a table of prompts: budget, one call per distinct prompt, checked JSON, named failures."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orecart.functions import prompts as P
from orecart.functions.text import error_category, sha256

ANSWER = "attempted boolean, ok boolean, answer string, error string"
# How a company stands to a technology.
RELATIONSHIPS = ["uses", "offers", "integrates_with", "implements", "mentions", "unknown"]
SIGNAL = "technology string, relationship string, evidence_ids array<string>, explanation string"
COMPANY = f"company_name string, legal_name string, country string, headquarters string, industries array<string>, products_services array<string>, technology_signals array<struct<{SIGNAL.replace(' ', ':').replace(',:', ',')}>>, company_description string"


def ask(rows: DataFrame, call: Callable[[str], str] | None, most: int | None = 50, run: str = "run_id", order: str = "seq", cache: DataFrame | None = None) -> DataFrame:
    """rows (run, order, prompt) with attempted, ok, answer (a JSON object), error and category.

    Equal prompts of a run are one call; answers of the cache (key, answer) cost none; calls beyond the
    run's budget (None: no budget) are not made. call takes a prompt and returns text; without one nothing is asked. A
    failure is an answer that names its category, and the row stays.
    """
    keyed = rows.withColumn("key", sha256(F.coalesce("prompt", F.lit(""))))
    one = keyed.groupBy(run, "key").agg(F.min(order).alias("__first"), F.first(F.coalesce("prompt", F.lit(""))).alias("prompt"))
    if cache is not None:
        one = one.join(cache.select("key", F.col("answer").alias("__held")).dropDuplicates(["key"]), "key", "left")
    else:
        one = one.withColumn("__held", F.lit(None).cast("string"))
    due = one.where("__held IS NULL").withColumn("allowed", F.lit(True))
    if most is not None:  # keys alone are numbered, and of each run's no more than its budget leave a task
        place = F.row_number().over(Window.partitionBy(run).orderBy("__first", "key"))
        first = due.select(run, "key", "__first").withColumn("__n", place).where(F.col("__n") <= most).select(F.col(run).alias("__run"), F.col("key").alias("__key"))
        due = due.drop("allowed").join(first, F.col(run).eqNullSafe(F.col("__run")) & (F.col("key") == F.col("__key")), "left").withColumn("allowed", F.col("__key").isNotNull()).drop("__run", "__key")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, prompt, allowed in frame[["key", "prompt", "allowed"]].itertuples(index=False):
                if call is None:
                    out.append((key, False, False, None, "disabled", None))
                elif not allowed:
                    out.append((key, False, False, None, "call budget reached", None))
                else:
                    out.append((key, True, *_answer(call, prompt)))
            yield pd.DataFrame(out, columns=["key", "attempted", "ok", "answer", "error", "status"]).assign(**{run: frame[run].to_numpy()})

    kind = rows.schema[run].dataType.simpleString()
    asked = due.select("key", "prompt", "allowed", run).mapInPandas(work, f"key string, {ANSWER}, status int, {run} {kind}").checkpoint()  # a call is made once
    held = one.where("__held IS NOT NULL").select("key", F.lit(False).alias("attempted"), F.lit(True).alias("ok"), F.col("__held").alias("answer"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("int").alias("status"), run)
    category = F.when(F.col("ok"), F.lit(None).cast("string")).when(~F.col("attempted"), F.when(F.col("error") == "disabled", "disabled").otherwise("limit")).when(F.col("error").startswith("not JSON"), "parse").otherwise(error_category(F.col("status"), F.col("error")))
    answers = asked.unionByName(held).withColumn("category", category).drop("status").withColumnsRenamed({run: "__run", "key": "__key"})
    found = keyed.join(answers, F.col(run).eqNullSafe(F.col("__run")) & (F.col("key") == F.col("__key")))
    return found.select(run, "key", *[c for c in keyed.columns if c not in (run, "key")], *[c for c in answers.columns if c not in ("__run", "__key")])


def _answer(call: Callable[[str], str], prompt: str) -> tuple[bool, str | None, str | None, int | None]:
    try:
        text = call(prompt)
    except Exception as e:  # noqa: BLE001  a provider may fail in any way
        return False, None, f"{type(e).__name__}: {e}", getattr(e, "status", None)
    try:
        found = json.loads(text)
    except (TypeError, ValueError):
        found = None
    return (True, json.dumps(found), None, None) if isinstance(found, dict) else (False, None, "not JSON: an object is needed", None)


def _words(values: Column) -> Column:
    return F.array_compact(F.coalesce(values, F.array().cast("array<string>")))


def _signals(company: Column, sent: Column) -> Column:
    """The answer's signals, each with why it does not count (null if it does): a technology, a known relationship and evidence are needed, and all evidence must be among what was sent."""
    known = F.transform(F.sequence(F.lit(1), F.greatest(F.size(sent), F.lit(1))), lambda n: n.cast("string"))
    given = F.array_compact(F.coalesce(company["technology_signals"], F.array().cast(f"array<struct<{SIGNAL.replace(' ', ':').replace(',:', ',')}>>")))

    def one(s: Column) -> Column:
        ids = F.array_distinct(F.transform(_words(s["evidence_ids"]), lambda x: F.trim(x)))
        reason = (
            F.when(F.trim(F.coalesce(s["technology"], F.lit(""))) == "", "no technology")
            .when(~F.coalesce(s["relationship"].isin(RELATIONSHIPS), F.lit(False)), "unknown relationship")
            .when(F.size(ids) == 0, "no evidence")
            .when((F.size(sent) == 0) | (F.size(F.array_except(ids, known)) > 0), "evidence not sent")
        )
        return F.struct(F.trim(s["technology"]).alias("technology"), s["relationship"].alias("relationship"), ids.alias("evidence_ids"), F.coalesce(s["explanation"], F.lit("")).alias("explanation"), reason.alias("reason"))

    return F.transform(given, one)


def checked(rows: DataFrame, answer: str = "answer", sent: str = "page_ids") -> DataFrame:
    """rows with company (COMPANY, null where there is no answer) and rejected_signals, from answers and the evidence sent (evidence n is the n-th of the list).

    Fields of another type or absent are empty. A signal that does not hold is taken out of the company and kept, with its reason, beside it.
    """
    found = rows.withColumn("__c", F.from_json(answer, COMPANY)).withColumn("__s", _signals(F.col("__c"), F.col(sent)))
    text = [F.trim(F.coalesce(F.col(f"__c.{n}"), F.lit(""))).alias(n) for n in ("company_name", "legal_name", "country", "headquarters")]
    lists = [_words(F.col(f"__c.{n}")).alias(n) for n in ("industries", "products_services")]
    good = F.transform(F.filter("__s", lambda s: s["reason"].isNull()), lambda s: s.dropFields("reason"))
    company = F.struct(*text, *lists, good.alias("technology_signals"), F.trim(F.coalesce("__c.company_description", F.lit(""))).alias("company_description"))
    return found.withColumn("company", F.when(F.col(answer).isNotNull(), company)).withColumn("rejected_signals", F.filter("__s", lambda s: s["reason"].isNotNull())).drop("__c", "__s")


def companies(pages: DataFrame, terms: list[str], call: Callable[[str], str] | None, most: int | None = 50, length: int | None = 8000) -> DataFrame:
    """domain, page_ids, company (COMPANY), rejected_signals and the call's columns: the provider reads each domain's best pages, `length` characters of each (None: all).

    pages: as prompts.evidence takes them.
    """
    found = P.evidence(pages, terms, most=length).withColumn("run_id", F.lit(0)).withColumn("seq", F.col("domain"))
    rows = found.select("domain", "page_ids", "run_id", "seq", F.concat(F.lit(P.PROMPTS["company"] + "\n\n"), "evidence").alias("prompt"))
    return checked(ask(rows, call, most)).drop("run_id", "seq", "prompt")
