"""Run control, configuration, reports, tables, prompts."""

import io
import json

import pytest
from pyspark.sql import functions as F

from orecart.functions import html as H
from orecart.functions import prompts
from orecart.operators import control, links, planning
from orecart.plans.engine import Engine
from orecart.sources import sinks


def test_channel_takes_the_first_healthy_backend_and_probes_again_once():
    down = {"a"}

    def call(name):
        def run(x):
            if name in down:
                raise OSError(f"{name} is down")
            return f"{name}:{x}"

        return run

    def sick():
        raise OSError("no route")

    c = control.Channel("search", [("x", sick, call("x")), ("a", lambda: "a" not in down, call("a")), ("b", lambda: True, call("b"))])
    assert c.run(1) == "b:1" and c.status()["active"] == "b" and c.last_error == "no route"
    down.clear()
    down.add("b")
    assert c.run(2) == "a:2"
    down.add("a")
    with pytest.raises(OSError, match="is down"):
        control.Channel("search", [("a", lambda: "a" not in down or True, call("a"))]).run(3)
    with pytest.raises(RuntimeError, match="no working backend"):
        control.Channel("search", [("a", lambda: False, call("a"))]).run(3)


def test_config_and_log():
    c = control.Config.read({"ORECART_SEARCH_PAGES": "3", "ORECART_BYPASS_CACHE": "yes", "OTHER": "1"})
    assert (c.search_pages, c.bypass_cache, c.cache_days) == (3, True, 30)
    for bad in ({"ORECART_CACHE_DAYS": "-1"}, {"ORECART_CACHE_DAYS": "soon"}, {"ORECART_BYPASS_CACHE": "2"}):
        with pytest.raises(ValueError, match="ORECART_"):
            control.Config.read(bad)
    out = io.StringIO()
    log = control.Log("info", out, run="r1")
    log.write("debug", "unseen")
    log.write("warn", "seen", n=2)
    (line,) = [json.loads(x) for x in out.getvalue().splitlines()]
    assert (line["level"], line["message"], line["run"], line["n"]) == ("warn", "seen", "r1", 2)


def test_memo_asks_once(spark):
    asked = []

    def call(keys):
        asked.extend(r.k for r in keys.collect())
        return keys.withColumn("v", F.length("k"))

    rows = spark.createDataFrame([("a",), ("a",), ("bb",), (None,)], "k string")
    assert sorted((r.k or "", r.v) for r in control.memoized(rows, "k", call).collect()) == [("", None), ("a", 1), ("a", 1), ("bb", 2)]
    assert sorted(asked) == ["a", "bb"]


def test_guard_counts_bytes(spark):
    df = spark.createDataFrame([("text/html", "é" * 5), ("text/html", "é" * 6), (None, None), ("image/png", "x")], "t string, b string")
    assert [r[0] for r in df.select(control.acceptable(F.col("t"), F.col("b"), 10)).collect()] == [True, False, True, False]


def test_report_text_and_tables(spark):
    row = "domain string, confidence double, contacts array<struct<full_name:string,title:string,email:string>>"
    text = sinks.console_report(spark.createDataFrame([("a.test", 0.5, [("Jo Ray", "CEO", None)]), ("b.test", None, None)], row))
    assert text == "1. a.test (50 %)\n   - Jo Ray, CEO\n2. b.test (0 %)"
    assert sinks.migrate(spark, "orecart_t") == sinks.migrate(spark, "orecart_t")
    assert {r.tableName for r in spark.sql("SHOW TABLES IN orecart_t").collect()} == set(sinks.TABLES)
    spark.sql("DROP DATABASE orecart_t CASCADE")


def test_markdown_of_pages():
    html = "<title>A &amp; B</title><script>x</script><h1>Head</h1><p>One <b>bold</b> text</p><p>One bold text</p><ul><li>item one</li><li>ab</li></ul><a href='/x'>go</a><a href='/y'></a><form><p>hidden</p></form>"
    assert H.to_markdown(html) == "# A & B\n# Head\nOne bold text\nitem one\n[go](/x)"
    assert H.to_markdown(None) == "" and H.to_markdown("<p>open <p>next") == "open next\nnext"


def test_prompts_and_evidence(spark):
    pages = spark.createDataFrame([("d", 1, "https://d.test/about", "<title>About</title>", "we make pumps"), ("d", 2, "https://d.test/z", "<title>Z</title>", None)], "domain string, page_id long, url string, html string, text string")
    (r,) = prompts.evidence(pages, ["pump"]).collect()
    assert r.page_ids == [1, 2] and r.evidence.startswith("[EVIDENCE 1]\nURL: https://d.test/about\nTITLE: About\n\nwe make pumps")
    assert set(prompts.PROMPTS) == {"company", "contact"}


def test_directory_pages_of_other_hosts_and_assets(spark):
    rows = [("/members/1",), ("https://x.test/members/2",), ("/members/3.pdf",), ("/page/2?utm_source=a",), ("/home",), ("mailto:a@b.c",), (None,)]
    df = spark.createDataFrame([(1, 1, i, "https://dir.test/list", h) for i, (h,) in enumerate(rows)], "source_id long, page_id long, seq long, page_url string, href string")
    assert [r.url for r in links.directory_pages(df).orderBy("nth").collect()] == ["https://dir.test/members/1", "https://dir.test/page/2"]


def test_second_round_does_not_approve_a_domain_twice(spark):
    icp = {"company_types": ["Pumps"], "location": "Pune"}
    first = planning.search_plan("pump makers", icp)["search_queries"]
    second = planning.fresh_queries(first, planning.supplementary("pump makers", icp)) or ["none"]
    rows = [(first[0], 1, 1, "https://a.test/", "A", "s", "e"), (first[0], 1, 2, "https://b.test/", "B", "s", "e"), (second[0], 1, 1, "https://a.test/other", "A2", "s", "e"), (second[0], 1, 2, "https://c.test/", "C", "s", "e")]
    results = spark.createDataFrame(rows, "query string, page int, position int, url string, title string, snippet string, engine string")
    answer = lambda want: [{"domain": w["domain"], "type": "company", "is_company_website": True, "matches_search_plan": True} for w in want]
    out = Engine(spark, answer, target_count=5).discover(results, "pump makers", icp).where("status = 'approved'").collect()
    assert len({r.domain for r in out}) == len(out) >= 2
