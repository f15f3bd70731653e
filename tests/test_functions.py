"""Column functions against tables of cases."""

import pytest
from pyspark.sql import functions as F

from orecart.functions import contact as C
from orecart.functions import company as M
from orecart.functions import names as N
from orecart.functions import text as T
from orecart.functions import url as U


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def many(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select("i", fn(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_normalized_urls(spark):
    given = ["HTTP://WWW.Example.com/a/b//?utm_source=x&q=1#frag", "https://example.com", "ftp://x.com/", "nonsense", None, "https://user@a.co.in:443/x/?gclid=1"]
    assert many(spark, given, U.normalized) == ["http://example.com/a/b?q=1", "https://example.com/", None, None, None, "https://a.co.in/x"]


def test_normalizing_twice_changes_nothing(spark):
    given = ["http://www.a.com/x/?b=1&utm_term=z", "https://b.org///", "http://c.net:8080/p?q"]
    once = many(spark, given, U.normalized)
    assert many(spark, once, U.normalized) == once


def test_registrable_domains(spark):
    assert many(spark, ["a.b.example.com", "x.y.co.in", "co.in", "10.0.0.1", "localhost"], U.registrable) == ["example.com", "y.co.in", "co.in", "10.0.0.1", "localhost"]


@pytest.mark.parametrize(("host", "blocked"), [("linkedin.com", True), ("jobs.linkedin.com", True), ("notlinkedin.com", False), ("mit.edu", True), ("x.ac.in", True), ("example.com", False)])
def test_blocked_hosts(spark, host, blocked):
    assert one(spark, U.is_blocked(F.lit(host))) is blocked


def test_listicle_titles(spark):
    given = ["Top 10 ERP tools", "12 vendors in India", "A vs B", "Acme Solar", "", "List of firms"]
    assert many(spark, given, U.is_listicle) == [True, True, True, False, False, True]


def test_dropped_urls(spark):
    given = ["https://a.com/x.pdf", "https://a.com/page/2", "https://a.com/?page=2", "https://a.com/wp-admin/x", "https://a.com/cart", "https://a.com/about", "bad"]
    assert many(spark, given, U.is_dropped) == [True, True, True, True, True, False, True]


def test_resolved_links(spark):
    rows = spark.createDataFrame([("about", "https://a.com/x/y"), ("/p", "https://a.com/x/y"), ("#t", "https://a.com/"), ("mailto:a@b.c", "https://a.com/"), ("//b.com/z", "https://a.com/"), ("?q=1", "https://a.com/x")], "h string, p string")
    assert [r[0] for r in rows.select(U.resolve(F.col("h"), F.col("p"))).collect()] == ["https://a.com/x/about", "https://a.com/p", None, None, "https://b.com/z", "https://a.com/x?q=1"]


def test_word_bounds_are_ascii(spark):
    assert one(spark, T.matches(F.lit("éabout"), r"\babout\b")) is True
    assert one(spark, T.matches(F.lit("xabout"), r"\babout\b")) is False


def test_list_values(spark):
    assert one(spark, T.list_values(F.lit(" a, b;c\n,1 0"))) == ["a", "b", "c", "1 0"]


def test_role_mailboxes(spark):
    assert many(spark, ["info@a.com", "no-reply@a.com", "asha@a.com", "hrithik@a.com", "x", None], C.is_role_email) == [True, True, False, True, False, False]


def test_emails_and_phones(spark):
    assert many(spark, [" Asha@A.Com ", "bad@", None], C.normalize_email) == ["asha@a.com", None, None]
    assert many(spark, ["+1 (202) 555-0100", "12", None], C.normalize_phone) == ["+12025550100", None, None]


def test_roles(spark):
    given = ["Co-Founder & CEO", "Founder", "CEO", "Head of Engineering", "Marketing Manager", "VP Sales", "General Counsel", "Director", "Gardener", ""]
    assert many(spark, given, C.normalize_role) == ["cofounder", "founder", "ceo", "technology_leader", "marketing_leader", "sales_leader", "operations_leader", "executive", "other", None]


def test_plausible_names(spark):
    given = ["Asha Rao", "John van der Berg", "Sales Team", "About Us", "While We Grow", "asha rao", "A B C D E F", "Rao, Asha", "Visit example.com", None]
    assert many(spark, given, N.is_plausible) == [True, True, False, False, False, False, False, True, False, False]


def test_contact_confidence(spark):
    assert one(spark, C.confidence(F.lit("Asha Rao"), F.lit("asha@a.com"), F.lit(None).cast("string"), F.lit("CEO"))) == 0.8
    assert one(spark, C.confidence(F.lit("Asha Rao"), F.lit("info@a.com"), F.lit(None).cast("string"), F.lit(""))) == 0.35


def test_legal_keys(spark):
    assert many(spark, ["Acme Solar Private Limited", "Acme Solar Pvt. Ltd.", "ACME SOLAR LLP", None], M.legal_key) == ["acmesolar", "acmesolar", "acmesolar", ""]


def test_fuzzy_names(spark):
    pairs = [("Asha Rao", "Asha K Rao", True), ("Jon Smith", "John Smith", True), ("Asha Rao", "Ravi Kumar", False), ("", "Asha Rao", False)]
    rows = spark.createDataFrame(pairs, "a string, b string, w boolean")
    assert rows.where(N.fuzzy_match(F.col("a"), F.col("b")) != F.col("w")).count() == 0


def test_backoff(spark):
    assert [one(spark, T.backoff_ms(F.lit(n))) for n in (0, 1, 2, 5, 9)] == [2000, 2000, 4000, 30000, 30000]
