"""The composed entry points."""

import datetime

from orecart.operators import serve
from orecart.plans.engine import Engine


def test_discover_extract_report(spark):
    queries = Engine(spark).plan("solar users")["search_queries"]
    rows = [(queries[0], 1, i + 1, f"https://firm{i}.com/", f"Firm {i}", "s", "e") for i in range(4)] + [(queries[1], 1, 1, "https://firm0.com/x", "Firm", "s", "e"), (queries[0], 1, 9, "https://linkedin.com/a", "x", "", "")]
    results = spark.createDataFrame(rows, "query string, page int, position int, url string, title string, snippet string, engine string")
    engine = Engine(spark, lambda want: [{"domain": w["domain"], "type": "company", "is_company_website": True, "matches_search_plan": None} for w in want])
    decided = engine.discover(results, "solar users")
    assert {(r.domain, r.status) for r in decided.collect()} == {(f"firm{i}.com", "approved") for i in range(4)}

    pages = spark.createDataFrame([(1, "https://firm0.com/", "<title>Home | Firm Zero</title><p>We run solar software for many plants across the whole wide country.</p><body>solar platform erp</body>"), (2, "https://firm0.com/team", '<div class="member"><h3>Asha Rao</h3><p class="role">CEO</p></div>'), (3, "https://other.com/", "<p>x</p>")], "page_id long, url string, html string")
    records, contacts = engine.extract(pages, {"product_or_technology": "solar"}, {"company_types": ["solar software"]}, decided)
    assert {(r.domain, r.qualification_status) for r in records.where("archetype = 'homepage'").collect()} == {("firm0.com", "qualified")}
    firms, totals = engine.report(records, contacts)
    assert [(r.domain, [c.full_name for c in r.contacts]) for r in firms.collect()] == [("firm0.com", ["Asha Rao"])]
    assert totals.first().leadership_contacts == 1


def test_search_and_dashboard(spark):
    now = datetime.datetime(2024, 1, 1)
    row = lambda i, ref, body, kind="company", product=None, status="review": (i, 1, "website", ref, kind, body, 0.5, "pending", status, [], "r", product, None, now + datetime.timedelta(i))
    records = spark.createDataFrame([row(1, "https://www.acme.com/a", '{"company_description": "solar plants"}'), row(2, "https://acme.com/b", '{"company_description": "solar"}', status="qualified"), row(3, "https://solar.io", '{"x": "plants"}'), row(4, "c", "{}", "contact")], serve.RECORD)
    engine = Engine(spark)
    assert [r.id for r in engine.search(records, "Solar plants").collect()] == [3, 1]
    assert engine.search(records, "  ").count() == 0
    s = serve.summary(records).first()
    assert (s.companies, s.contacts, s.qualified, s.review) == (2, 1, 1, 1)
    assert [r.id for r in serve.visible(records).collect()] == [4, 3, 2]
