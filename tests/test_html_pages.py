"""Bad pages through the functions and the registered queries: bad parts are skipped, the page's row stays."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orecart.functions import company as M
from orecart.functions import html as H
from orecart.operators import extract
from orecart.plans import queries as Q

GOOD = '<title>Our team</title><body><p>We are a team.</p><div class="member"><h3>Asha Rao</h3><p class="role">CEO</p><a href="mailto:asha@firm.com">m</a></div></body>'
DEEP_JSON = '<script type="application/ld+json">' + '{"a":' * 30_000 + "1" + "}" * 30_000 + "</script>"
ODD_PEOPLE = """<script type="application/ld+json">[{"@type": "Person", "name": "Ravi Iyer", "url": ["https://linkedin.com/in/ravi", {"@id": "x"}, 3]},
{"@type": ["Thing", "Person"], "name": {"a": 1}, "url": {"@id": "y"}}, {"@type": "Person", "name": "Meera Nair", "url": {"b": 2}, "email": ["m@x.com"]}]</script>"""
BAD = ["<![foo[x]]>", "<![%temp[", "<![CDATA[ x ]]>", "<![if !IE]>", "<![endif]>", "<!doctype [<!ELEMENT a", "<!-", "<?php", "</", "&#xFFFFFFFF;", "<a href='x", "<![", "\0"]


@pytest.mark.parametrize("bad", BAD)
def test_bad_markup_leaves_the_rest_of_the_page(bad):
    assert [p["full_name"] for p in H.contact_parts(GOOD + bad)] == ["Asha Rao"]
    assert H.company_parts(GOOD + bad)["title"] == "Our team" and "# Our team" in H.to_markdown(GOOD + bad)
    H.contact_parts(bad + GOOD)
    assert H.company_parts(f"<title>T</title>{bad}>{GOOD}")["title"] == "T"


def test_structured_data_counts_strings_only():
    got = [(p["full_name"], p["email"], p["profile_urls"]) for p in H.contact_parts(ODD_PEOPLE + DEEP_JSON)]
    assert got == [("Ravi Iyer", "", ["https://linkedin.com/in/ravi"]), ("", "", []), ("Meera Nair", "", [])]
    assert H.structured("{") is None and H.structured(None) is None


def test_deep_pages_take_linear_time():
    deep = "<div>" * 60_000 + "<p>in</p>" + "</span>" * 60_000 + "</div>" * 60_000
    assert H.company_parts(deep + "<p>out</p>")["description"] == "in"
    assert H.contact_parts(deep) == []


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("pages")
    pages = [GOOD, None, "", GOOD + "".join(BAD), ODD_PEOPLE + GOOD, DEEP_JSON + GOOD, *[b + GOOD for b in BAD]]
    spark.createDataFrame([(i, f"https://firm{i}.com/about", h) for i, h in enumerate(pages)], "page_id long, url string, html string").write.parquet(str(out / "pages.parquet"))
    return str(out), len(pages)


@pytest.mark.parametrize("name", ["company_extract", "html_markdown", "page_links_topk"])
def test_registered_queries_survive_bad_pages(spark, sf, name):
    rows = Q.QUERIES[name](spark, sf[0]).collect()
    assert name == "page_links_topk" or {r.page_id for r in rows} == set(range(sf[1]))


def test_contacts_of_bad_pages(spark, sf):
    found = extract.contacts(spark.read.parquet(f"{sf[0]}/pages.parquet")).toPandas()
    assert isinstance(found, pd.DataFrame) and {"Asha Rao", "Ravi Iyer", "Meera Nair"} <= set(found["full_name"])


RICH = '<html><head><title>Acme | Home</title><meta property="og:site_name" content="Acme Robotics"><meta name="description" content="Acme Robotics builds warehouse robots and automation software for large manufacturing companies."></head><body><h1>About us</h1><p>Our platform for manufacturing.</p><a href="mailto:info@acme.com">m</a><a href="tel:+91 98765 43210">t</a></body></html>'
SPARSE = "<html><head><title>Tiny - Home</title></head><body><p>Hi.</p></body></html>"


def test_company_fields_of_known_pages(spark):
    pages = spark.createDataFrame([(1, "https://acme.com/about", RICH), (2, "https://tiny.in/about", SPARSE)], "page_id long, url string, html string")
    got = {r.page_id: r for r in extract.companies(pages).collect()}
    one, two = got[1].payload, got[2].payload
    assert (got[1].tier, got[1].confidence, one.company_name, one.role_emails, one.company_phones) == ("deterministic", 0.9, "Acme Robotics", ["info@acme.com"], ["+919876543210"])
    assert one.company_description.startswith("Acme Robotics builds warehouse robots") and (one.industries, one.products_services) == (["manufacturing"], ["platform"])
    assert (got[2].confidence, two.company_name, two.company_description) == (0.5, "Home", "Hi.")


WORDS = ["AI", "solar", "machine  learning", "cloud", "we build", "x", "#", "[", "services for many large customers abroad", "", "Σap"]


def _random_page(rng: random.Random) -> str:
    out = []
    for _ in range(rng.randrange(14)):
        tag = rng.choice(["p", "li", "h1", "h2", "td", "a", "div", "svg", "title", "b", "script"])
        out += [f'<{tag} href="/{rng.choice(["", "erp", "iot"])}">' if tag == "a" else f"<{tag}>", rng.choice(WORDS), rng.choice(["", " ", f"</{tag}>", "</p>", "</div>"])]
    return "".join(out)


def test_company_fields_equal_those_of_the_markdown_lines():
    rng, filled = random.Random(5), 0
    for _ in range(3000):
        page = _random_page(rng)
        markdown = H.to_markdown(page)
        lines = markdown.split("\n")
        text = [x for x in lines if x and x[0] not in "#["]
        got = H.page_fields(page, M.TERMS)
        assert got["md_heading"] == next((x[2:] for x in lines if x.startswith("# ")), ""), page
        assert got["md_text"] == next((x for x in text if len(x) >= 30), text[0] if text else ""), page
        assert got["md_terms"] == [t for t in M.TERMS if t in markdown.lower()], page
        assert got["title"] == H.company_parts(page)["title"]
        filled += bool(got["md_terms"])
    assert filled > 500


def test_unclosed_blocks_take_linear_time():
    page = "<title>Deep</title>" + "<p>solar words for a long page " * 20_000
    got = H.page_fields(page, M.TERMS)
    assert got["md_terms"] == ["solar"] and got["md_text"].startswith("solar words") and got["md_heading"] == "Deep"


def test_tier_two_wins_where_it_is_surer_and_callbacks_see_their_own_pages(spark):
    hidden = "<title>Firm</title><body><form>Only a form</form><p>A short one.</p><p>This second block is long enough to be a description of it.</p></body>"
    pages = spark.createDataFrame([(1, "https://firm.in/about", hidden), (2, "https://acme.com/about", RICH)], "page_id long, url string, html string")
    got = {r.page_id: (r.tier, r.confidence, r.payload.company_description) for r in extract.companies(pages).collect()}
    assert got[1] == ("markdown", 0.65, "This second block is long enough to be a description of it.") and got[2][0] == "deterministic"
    other = {r.page_id: r for r in extract.companies(pages, markdown=H.with_markdown, provider=lambda low: low.withColumn("confidence", F.lit(0.9))).collect()}
    assert (other[1].tier, other[1].confidence, other[1].payload.company_description) == ("llm", 0.9, got[1][2])
    assert (other[2].tier, other[2].payload) == ("deterministic", {r.page_id: r for r in extract.companies(pages).collect()}[2].payload)


def test_contacts_as_a_table_function(spark):
    H.register(spark)
    spark.createDataFrame([(1, GOOD), (2, None), (3, ODD_PEOPLE)], "page_id long, html string").createOrReplaceTempView("contact_pages")
    rows = spark.sql("SELECT p.page_id, c.full_name, c.title, c.profile_urls FROM contact_pages p, LATERAL extract_contacts(p.html) c").collect()
    assert sorted((r.page_id, r.full_name, r.title, r.profile_urls) for r in rows) == [(1, "Asha Rao", "CEO", []), (3, "", "", []), (3, "Meera Nair", "", []), (3, "Ravi Iyer", "", ["https://linkedin.com/in/ravi"])]
