"""Operators on small tables, against hand-made or brute-force results."""

import random

from pyspark.sql import functions as F

from orecart.functions import html as H
from orecart.operators import dedupe, extract, links, matching, planning, qualify, relevance, resolve, serve
from orecart.sources import sinks, tables
from orecart.streaming import targets


def test_reject_chain(spark):
    rows = [(1, "https://a.com/x", "A", ""), (2, "https://a.com/x/", "A", ""), (3, "x", "", ""), (4, "https://a.com/f.pdf", "", ""), (5, "https://g2.com/a", "", ""), (6, "https://b.com", "Top 5 tools", ""), (7, "https://b.com/search?q=1", "", "")]
    out = relevance.filter_candidates(spark.createDataFrame(rows, "seq int, url string, title string, snippet string"))
    assert {r.seq: r.reason_code for r in out.collect()} == {1: None, 2: "duplicate_url", 3: "malformed_url", 4: "non_html_asset", 5: "excluded_domain", 6: "listicle_title", 7: "search_result_page"}


def test_rank_candidates_retries_then_reviews(spark):
    rows = spark.createDataFrame([(i, f"https://d{i}.com/", "t", "s") for i in range(3)], "seq int, url string, title string, snippet string")

    def answer(want):
        return [{"domain": w["domain"], "type": "company", "is_company_website": True, "matches_search_plan": w["domain"] != "d1.com"} for w in want]

    got = {r.domain: (r.status, r.reason_code) for r in relevance.rank_candidates(rows, answer).collect()}
    assert got == {"d0.com": ("approved", "matches_search_plan"), "d1.com": ("rejected", "not_matching_search_plan"), "d2.com": ("approved", "matches_search_plan")}
    silent = relevance.rank_candidates(rows, lambda want: [])
    assert {(r.status, r.reason_code) for r in silent.collect()} == {("review", "provider_failed")}


def test_batches_number_rows_in_order(spark):
    rows = spark.range(1000).select((F.col("id") * 3).alias("seq"))
    got = {r.seq: r.batch for r in relevance.batches(rows, "seq", 25).collect()}
    assert all(got[3 * i] == i // 25 for i in range(1000))


def test_link_archetypes(spark):
    rows = [("https://a.com/leadership-team", "", "leadership", "high"), ("https://a.com/x", "Our People", "team", "high"), ("https://a.com/privacy-policy", "", "privacy", "low"), ("https://a.com/zzz", "read", "generic", "generic"), ("https://a.com/about/founders", "", "founders", "high")]
    df = spark.createDataFrame(rows, "u string, a string, k string, t string").withColumn("f", links.infer_archetype(F.col("u"), F.col("a"), F.lit("")))
    assert df.where("f.archetype <> k OR f.tier <> t").count() == 0


def test_page_links_prefer_anchor_text_and_same_domain(spark):
    html = '<a href="/about"></a><a href="/about">About</a><a href="https://sub.a.com/team">Team</a><a href="https://b.com/">x</a><a href="/f.pdf">f</a>'
    p = spark.createDataFrame([(1, "https://a.com/", html, "")], "page_id int, page_url string, html string, title string").withColumn("depth", F.lit(0))
    out = links.page_links(links.anchors(p)).orderBy("rank").collect()
    assert [(r.url, r.anchor_text) for r in out] == [("https://a.com/about", "About"), ("https://sub.a.com/team", "Team")]


def test_frontier_stops_at_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {tuple(r) for r in links.frontier(edges, seeds, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}


CARD = '<div class="team"><div class="member"><h3>Asha Rao</h3><p class="role">CEO</p><a href="mailto:asha@firm.com">m</a></div></div>'


def test_contacts_from_team_page(spark):
    p = spark.createDataFrame([(7, "https://firm.com/team", f"<title>Our team</title>{CARD}")], "page_id long, url string, html string")
    (r,) = extract.contacts(p).collect()
    assert (r.full_name, r.title, r.role_category, r.email, r.confidence, r.page_ids) == ("Asha Rao", "CEO", "ceo", "asha@firm.com", 0.8, [7])


def test_contacts_ignore_labels(spark):
    p = spark.createDataFrame([(1, "https://firm.com/team", '<div class="member"><h3>Contact Us</h3></div>')], "page_id long, url string, html string")
    assert extract.contacts(p).count() == 0


def test_company_tiers(spark):
    rich = '<title>Home | Acme</title><meta name="description" content="Acme makes solar panels and inverters for large plants in many places."><body>solar software platform erp</body>'
    p = spark.createDataFrame([(1, "https://acme.com/", rich), (2, "https://poor.com/", "<p>x</p>"), (3, "https://poor.com/careers", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.tier, r.payload.company_name, r.status) for r in extract.companies(p).collect()}
    assert got[1] == ("deterministic", "Acme", "pending") and got[2][1] == "poor" and 3 not in got


def test_markdown_drops_scripts_and_repeats():
    assert H.to_markdown("<title>T</title><script>x</script><p>Same line</p><p>Same line</p>") == "# T\nSame line"


def test_ld_persons_are_found_at_any_depth():
    data = {"@graph": [{"@type": ["Person", "X"], "name": "A"}, {"a": {"b": [{"@type": "Person", "name": "B"}]}}]}
    assert [p["name"] for p in H.ld_persons(data)] == ["A", "B"]


def test_enrich_equals_scoring_every_pair(spark):
    names = ["Sapient", "SAP", "SAP Private Limited", "ibmindia", "Q", "X SAP", "A.B. & C", "the a.b. & c group", "日本電気株式", "日本電気株式会社", "Acme Solar", "acme", "ab", "Abc", "Tata Steel Limited", "tata", "", "é", None]
    domains = ["ibm.com", "", "q.in", "acme.com", None]
    companies = spark.createDataFrame([(i, n, domains[i % 5]) for i, n in enumerate(names * 2)], "company_id long, name string, domain string")
    for score, kept in ((matching.org_score(F.col("candidate_name"), F.col("candidate_name"), F.lit(""), F.col("company_name"), F.col("company_domain")), names), (matching.registry_score(F.col("candidate_name"), F.lit(""), F.col("company_name"), F.lit(""), F.col("company_domain")), names)):
        for some in (kept, kept[1:6], ["é", "", "zz"], ["ibmindia"]):
            candidates = spark.createDataFrame([(i, n, "") for i, n in enumerate(some)], "candidate_id long, name string, domain string")
            every = companies.selectExpr("company_id", "name AS company_name", "domain AS company_domain").crossJoin(candidates.selectExpr("candidate_id", "name AS candidate_name")).withColumn("score", score).where("score >= 0.6")
            want = matching.best_match(every, "company_id", "score", "candidate_id")
            got = matching.enrich(companies, candidates, score)
            columns = ["company_id", "candidate_id", "score"]
            assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def person(seq, name, **more):
    base = {"seq": seq, "scope": 1, "name": name, "name_key": name.lower(), "email": None, "phone": None, "profile_urls": [], "source_urls": [], "page_ids": [], "source_refs": [], "titles": [], "role_category": None, "sources": ["website"], "company_domain": "a.com", "confidence": 0.5}
    return {**base, **more}


def test_people_merge_and_review(spark):
    rows = [person(1, "Asha Rao", email="asha@a.com"), person(2, "A Rao", email="asha@a.com", sources=["github"], titles=["CEO"]), person(3, "Asha K Rao", company_domain=None), person(4, "Other Person", email="info@a.com"), person(5, "Someone Else", email="info@a.com")]
    merged, review = resolve.dedupe_people(spark.createDataFrame(rows, f"seq long, scope int, {resolve.PERSON}"))
    got = {r.name: r for r in merged.collect()}
    assert len(got) == 4 and got["A Rao"].sources == ["website", "github"]
    assert {(r.left_name, r.right_name) for r in review.collect()} == {("Asha Rao", "Asha K Rao")}


def test_short_names_with_one_edit_meet(spark):
    names = ["maria", "mania", "marla", "maia", "xaria", "mariq", "mar", "ab de", "abcde", "abde", "bcde"]
    people = spark.createDataFrame([person(i, n) for i, n in enumerate(names)], f"seq long, scope int, {resolve.PERSON}")
    got = {(r.a.seq, r.b.seq) for r in resolve.person_pairs(people).collect()}
    a, b = people.select(F.col("seq").alias("i"), F.col("name").alias("x")), people.select(F.col("seq").alias("j"), F.col("name").alias("y"))
    want = {(r.i, r.j) for r in a.crossJoin(b).where("i < j AND levenshtein(x, y) * 5 <= greatest(length(x), length(y))").collect()}
    assert got == want and (0, 1) in got


def test_conflicts_split_a_component(spark):
    rows = [person(1, "Asha Rao", email="a@a.com"), person(2, "Asha Rao"), person(3, "Asha Rao", email="b@a.com")]
    merged, _ = resolve.dedupe_people(spark.createDataFrame(rows, f"seq long, scope int, {resolve.PERSON}"))
    assert sorted(r.email for r in merged.collect()) == ["a@a.com", "b@a.com"]


def slow_contacts(rows):
    groups = []
    for c in rows:
        hit = next((g for g in groups if any((m["email"] and m["email"] == c["email"]) or (m["phone"] and m["phone"] == c["phone"]) or (m["full_name"] and m["full_name"].lower() == c["full_name"].lower()) for m in g)), None)
        groups.append([c]) if hit is None else hit.append(c)
    return sorted(tuple(sorted(m["page_ids"][0] for m in g)) for g in groups)


def test_contact_dedupe_equals_scan(spark):
    rnd = random.Random(5)
    schema = "domain string, seq long, full_name string, first_name string, last_name string, title string, role_category string, email string, phone string, profile_urls array<string>, source_url string, source_urls array<string>, page_ids array<bigint>, confidence double"
    rows, want = [], []
    for d in range(6):
        own = [{"full_name": rnd.choice(["Asha Rao", "asha rao", "Bo Li", ""]), "email": rnd.choice([None, "a@x.y", "b@x.y"]), "phone": rnd.choice([None, "1234567", "7654321"]), "page_ids": [i]} for i in range(14)]
        want += [(f"d{d}", g) for g in slow_contacts(own)]
        rows += [(f"d{d}", i, c["full_name"], "", "", "", None, c["email"], c["phone"], [], "", [], c["page_ids"], 0.1) for i, c in enumerate(own)]
    got = [(r.domain, tuple(sorted(r.page_ids))) for r in resolve.dedupe_contacts(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got) == sorted(want)


def test_components_equal_union_find(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)]
    root = list(range(60))
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    nodes = spark.range(60).select(F.col("id").alias("node"))
    assert {r.node: r.root for r in resolve.components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()} == dict(enumerate(root))


def test_scores_of_organisations_and_registry(spark):
    lit = lambda x: F.lit(x)
    row = spark.range(1).select(
        matching.org_score(lit("acmesolar"), lit("Acme"), lit(""), lit("Acme Solar"), lit("acmesolar.com")),
        matching.org_score(lit("zzz"), lit(""), lit(""), lit("Acme Solar"), lit("acme.com")),
        matching.registry_score(lit("ACME SOLAR PRIVATE LIMITED"), lit("C1"), lit("Acme Solar"), lit(""), lit("acme.com")),
        matching.registry_score(lit("Other"), lit("C1"), lit("Acme Solar"), lit("c1"), lit("acme.com")),
    ).first()
    assert tuple(row) == (0.95, 0.0, 0.9, 0.95)


def test_qualification_gates(spark):
    from orecart.functions import company as M

    icp, plan = {"company_types": ["solar epc"]}, {"product_or_technology": "sap", "relationship": "uses"}
    cases = [("Acme", "solar epc firm using sap", "qualified"), ("Acme", "solar epc firm, sap", "review"), ("Acme", "a news magazine on solar epc", "not_qualified"), ("", "solar epc sap", "review"), ("", "solar epc", "not_qualified"), ("Acme", "bakery", "not_qualified")]
    df = spark.createDataFrame(cases, "n string, d string, want string").withColumn("p", M.payload(F.col("n"), F.col("d"), F.lit("")))
    out = df.withColumn("got", qualify.qualify(F.col("p"), plan, icp)["status"])
    assert out.where("got <> want").count() == 0


def test_search_plan():
    plan = planning.search_plan("sap users", {"name": "Tool", "company_types": "a, b", "location": "India"})
    assert len(plan["search_queries"]) == 8 and plan["relationship"] == "needs" and plan["industry"] == "a, b"
    assert planning.fresh_queries(["a"], ["a", "b"]) == ["b"]
    assert planning.dorks({})[1] == 'inurl:careers "companies"'


def test_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(rnd.randrange(12), i, rnd.choice(["fetching", "failed", "done", "failed", "suppressed"]), rnd.choice([403, 500])) for i in range(300)]
    schema = "url long, seq long, kind string, status int"
    df = spark.createDataFrame(rows, schema)
    for k in range(3):
        df.where(f"seq >= {k * 100} AND seq < {(k + 1) * 100}").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
    latest = {}

    def keep(batch, epoch):
        latest.update({r.url: (r.state, r.attempts) for r in batch.collect()})

    for k in range(3):
        spark.read.parquet(str(tmp_path / f"in{k}")).write.mode("append").parquet(str(tmp_path / "src"))
        s = spark.readStream.schema(schema).parquet(str(tmp_path / "src"))
        targets.machine_stream(s).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    assert latest == {r.url: (r.state, r.attempts) for r in targets.machine(df).collect()}


def test_fold_keeps_state_and_latest_values(spark):
    cols = "url string, seq int, priority int, depth int, priority_score double, occurrences int, matched_queries array<string>, domain string, source_type string, discovered_by string, title string, anchor_text string, archetype string, base_url string, parent_url string, priority_reason string, product_id string, product_name string, state string, attempts int, next_attempt_at timestamp"
    a = ("u", 1, 5, 1, 1.0, 1, ["q1"], "d", "w", "s1", "T", "", "about", "b", None, None, None, None, "done", 2, None)
    b = ("u", 2, 3, 2, None, 2, ["q2", "q1"], "d", "w", "s2", "", "x", "", None, "p", None, None, None, "queued", 0, None)
    (r,) = targets.fold_upserts(spark.createDataFrame([a, b], cols)).collect()
    assert (r.priority, r.depth, r.priority_score, r.occurrences, r.matched_queries, r.discovered_by, r.title, r.archetype, r.base_url, r.parent_url, r.state, r.attempts) == (3, 1, 1.0, 3, ["q1", "q2"], "s2", "T", "about", "b", "p", "done", 2)


def test_sinks_and_scans(spark, tmp_path):
    p = spark.createDataFrame([(1, "https://www.a.com/x/", "<p>")], "id long, url string, html string")
    sinks.append_pages(p, str(tmp_path / "pages"))
    (r,) = spark.read.parquet(str(tmp_path / "pages")).collect()
    assert r.url == "https://a.com/x" and r.domain == "a.com" and len(r.content_hash) == 64
    sinks.save_report({"a": 1}, str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text() == '{\n  "a": 1\n}'
    assert tables.search_cache(spark, str(tmp_path / "none")).count() == 0


def test_sitemaps(spark):
    files = spark.createDataFrame([("https://a.com/i.xml", "<sitemapindex><sitemap><loc>https://a.com/s.xml</loc></sitemap></sitemapindex>"), ("https://a.com/s.xml", "<urlset><url><loc>https://a.com/p10</loc></url><url><loc>https://b.com/x</loc></url><url><loc>https://a.com/f.pdf</loc></url></urlset>")], "url string, xml string")
    roots = spark.createDataFrame([("https://a.com/i.xml", "a.com")], "url string, domain string")
    assert [r.url for r in tables.sitemap_pages(files, roots).collect()] == ["https://a.com/p10"]


def test_dedupe_by_domain_keeps_first_of_equals(spark):
    rows = [("a", 1, 2, ["x"]), ("a", 2, 1, ["y"]), ("a", 3, 1, ["x", "z"])]
    (r,) = dedupe.dedupe_by_domain(spark.createDataFrame(rows, "domain string, seq int, priority int, matched_queries array<string>")).collect()
    assert (r.seq, r.matched_queries, r.occurrences) == (2, ["x", "y", "z"], 3)


def test_report(spark):
    companies = spark.createDataFrame([("a", 0.5, 1), ("b", 0.9, 2)], "domain string, confidence double, seq int")
    people = spark.createDataFrame([("a", float(i), i, "ceo") for i in range(8)], "domain string, confidence double, seq int, role_category string")
    rows, totals = serve.report(companies, people)
    got = rows.collect()
    assert [r.domain for r in got] == ["b", "a"] and [c.seq for c in got[1].contacts] == [7, 6, 5, 4, 3] and got[0].contacts is None
    assert totals.first().total_contacts == 8


def test_targets_take_the_references_default(spark):
    rows = spark.range(10_050).select("id", (F.col("id") % 3).alias("priority"))
    assert tables.targets(rows).count() == 10_000
