"""Suffix rules: the join against a plain search, the pattern of a short list against the join, the file format."""

import random

from pyspark.sql import functions as F

from orecart import rules as R
from orecart.functions import url as U
from orecart.operators import domains as D


def slow(host, rules):
    if host.replace(".", "").isdigit() and host.count(".") == 3 or ":" in host:
        return host
    labels = host.split(".")
    size = 1
    for i in range(len(labels)):
        end = ".".join(labels[i:])
        if f"!{end}" in rules:
            size = len(labels) - i - 1
            break
        if end in rules or ("*." + ".".join(labels[i + 1 :]) in rules and i + 1 < len(labels)):
            size = max(size, len(labels) - i)
    return host if size >= len(labels) else ".".join(labels[-size - 1 :])


KNOWN = {
    "acme.firm.in": "acme.firm.in", "www.acme.firm.in": "acme.firm.in", "other.firm.in": "other.firm.in", "firm.in": "firm.in", "x.me.uk": "x.me.uk", "sub.foo.gen.in": "foo.gen.in",
    "a.co.de": "co.de", "b.c.ck": "b.c.ck", "a.b.c.ck": "b.c.ck", "c.ck": "c.ck", "ck": "ck", "www.ck": "www.ck", "a.www.ck": "www.ck", "y.x.sch.uk": "y.x.sch.uk", "x.sch.uk": "x.sch.uk",
    "localhost": "localhost", "10.0.0.1": "10.0.0.1", "[::1]": "[::1]", "a.b.example.com": "example.com", "co.in": "co.in",
}


def hosts():
    rnd = random.Random(7)
    pool = ["a", "b", "www", "co", "com", "in", "uk", "ck", "sch", "me", "firm", "bd", "de", "zz", "net"]
    return [*KNOWN, *{".".join(rnd.choice(pool) for _ in range(rnd.randint(1, 5))) for _ in range(600)}]


def test_join_equals_a_search_over_suffixes(spark):
    table = [*R.SUFFIX_RULES, "com", "in", "uk", "!b.co.bd", "a.b.www.zz", "com"]
    df = spark.createDataFrame([(h,) for h in [*hosts(), None]], "host string")
    got = {r.host: r.domain for r in D.domains(df, spark.createDataFrame([(x,) for x in [*table, None]], "rule string")).collect()}
    assert got == {h: slow(h, set(table)) for h in hosts()}
    assert {h: got[h] for h in KNOWN} == KNOWN


def test_pattern_equals_the_join(spark):
    df = spark.createDataFrame([(h,) for h in hosts()], "host string")
    table = spark.createDataFrame([(x,) for x in R.SUFFIX_RULES], "rule string")
    both = D.domains(df, table).withColumn("short", U.registrable(F.col("host")))
    assert both.where("NOT domain <=> short").collect() == []


def test_rules_of_a_file_and_rows_of_a_table(spark, tmp_path):
    (tmp_path / "list.dat").write_text("// list\n// ===BEGIN ICANN DOMAINS===\ncom\nCO.in  // note\n\n*.ck\n!www.ck\n// ===BEGIN PRIVATE DOMAINS===\nblog.com\n")
    path = str(tmp_path / "list.dat")
    assert {r.rule for r in D.read_rules(spark, path).collect()} == {"com", "co.in", "*.ck", "!www.ck"}
    assert {r.rule for r in D.read_rules(spark, path, private=True).collect()} == {"com", "co.in", "*.ck", "!www.ck", "blog.com"}
    rows = spark.createDataFrame([(1, "https://x.blog.com/a", "d"), (2, "https://y.blog.com/", "e"), (3, None, "f")], "id int, url string, HOST string")
    for private, want in ((False, ["blog.com", "blog.com", None]), (True, ["x.blog.com", "y.blog.com", None])):
        out = D.with_domain(rows, U.hostname(F.col("url")), D.read_rules(spark, path, private)).orderBy("id").collect()
        assert [r.domain or None for r in out] == want
    assert D.with_domain(rows.limit(0), F.col("url"), D.read_rules(spark, path)).count() == 0
