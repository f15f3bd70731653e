"""The provider's budget, cache, checks and failures."""

import json

from pyspark.sql import functions as F

from orecart.functions.text import sha256
from orecart.operators import provider


def answer(prompt):
    if "fail" in prompt:
        error = OSError("busy")
        error.status = 429
        raise error
    if "slow" in prompt:
        raise TimeoutError("too slow")
    return "[1]" if "list" in prompt else "nonsense" if "bad" in prompt else '{"company_name": "Acme"}'


def test_ask(spark):
    texts = ["good", "good", "fail", "slow", "bad", "list", "held", None, "late", "later"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 99, "good")], "run_id int, seq int, prompt string")
    cache = spark.createDataFrame([("held", '{"a": 1}')], "p string, answer string").select(sha256(F.col("p")).alias("key"), "answer")
    got = {(r.run_id, r.seq): r for r in provider.ask(rows, answer, most=6, cache=cache).collect()}
    assert len(got) == len(texts) + 1
    assert [got[1, i].category for i in range(10)] == [None, None, "rate_limit", "timeout", "parse", "parse", None, None, "limit", "limit"]
    assert got[1, 0].ok and got[1, 1].ok and got[2, 99].ok and not got[1, 6].attempted and got[1, 6].answer == '{"a": 1}'
    assert {r.category for r in provider.ask(rows, None).collect()} == {"disabled"}


def test_companies_by_evidence(spark):
    pages = spark.createDataFrame([("a.test", 1, "https://a.test/", "<title>A</title>", "pumps"), ("b.test", 2, "https://b.test/", "<title>B</title>", "fail")], "domain string, page_id long, url string, html string, text string")
    got = {r.domain: r for r in provider.companies(pages, ["pump"], answer).collect()}
    assert got["a.test"].company.company_name == "Acme" and got["a.test"].page_ids == [1]
    assert got["b.test"].company is None and got["b.test"].category == "rate_limit"


def test_signals_are_held_to_the_evidence_sent(spark):
    signals = [
        {"technology": " SAP ", "relationship": "uses", "evidence_ids": ["1", " 2", "1"], "explanation": "said"},
        {"technology": "CRM", "relationship": "uses", "evidence_ids": [2]},
        {"technology": "ERP", "relationship": "likes", "evidence_ids": ["1"]},
        {"technology": "IoT", "relationship": "offers", "evidence_ids": []},
        {"technology": "AI", "relationship": "offers", "evidence_ids": ["1", "3"]},
        {"technology": "", "relationship": "offers", "evidence_ids": ["1"]},
        {"technology": "X", "relationship": None, "evidence_ids": ["1"]},
        None,
    ]
    whole = json.dumps({"company_name": " Acme ", "industries": ["a", None], "products_services": 3, "technology_signals": signals})
    rows = spark.createDataFrame([(1, whole, [7, 8]), (2, "{}", [7]), (3, None, [7]), (4, whole, []), (5, '{"technology_signals": "none"}', [7])], "n int, answer string, page_ids array<long>")
    got = {r.n: r for r in provider.checked(rows).collect()}
    kept = [(s.technology, s.relationship, s.evidence_ids, s.explanation) for s in got[1].company.technology_signals]
    assert kept == [("SAP", "uses", ["1", "2"], "said"), ("CRM", "uses", ["2"], "")]
    assert [(s.technology, s.reason) for s in got[1].rejected_signals] == [("ERP", "unknown relationship"), ("IoT", "no evidence"), ("AI", "evidence not sent"), ("", "no technology"), ("X", "unknown relationship")]
    assert (got[1].company.company_name, got[1].company.industries, got[1].company.products_services, got[1].company.country) == ("Acme", ["a"], [], "")
    assert got[2].company.technology_signals == [] and got[2].rejected_signals == [] and got[3].company is None and got[3].rejected_signals == []
    assert got[4].company.technology_signals == [] and len(got[4].rejected_signals) == 7
    assert got[5].company is not None and got[5].rejected_signals == []


def test_budget_by_order_and_without_one(spark):
    rows = spark.createDataFrame([(run, i, f"p{i % 7}") for run in (1, 2, None) for i in range(20)], "run_id int, seq int, prompt string")
    got = provider.ask(rows, answer, most=3).collect()
    assert len(got) == 60 and {(r.run_id, r.prompt) for r in got if r.category != "limit"} == {(run, p) for run in (1, 2, None) for p in ("p0", "p1", "p2")}
    assert {r.category for r in provider.ask(rows.withColumn("prompt", F.lit("good")), answer, most=None).collect()} == {None}
    assert {r.category for r in provider.ask(rows, answer, most=0).collect()} == {"limit"}
