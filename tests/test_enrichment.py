"""Enrichment against a full scoring of all pairs, and the people that accepted matches carry."""

from pyspark.sql import functions as F

from orecart import rules
from orecart.operators import enrichment, matching, resolve


def firms(spark):
    rows = [(1, "Acme Pumps", "acmepumps.com"), (2, "Zed", "zed.io"), (3, "North Wind Energy", "northwind.com"), (4, "Quill", "quill.test"), (5, "Lone Firm", "lone.test")]
    return spark.createDataFrame(rows, "company_id long, name string, domain string")


def test_code_host_equals_a_scoring_of_all_pairs(spark):
    orgs = [("acmepumps", "Acme", None), ("zedtools", "Zed Tools", ""), ("energy-north-wind", None, "by North Wind Energy, open data"), ("other", "Quill & Sons", None), ("x", "", "nothing")]
    orgs = spark.createDataFrame(orgs, "login string, name string, description string")
    pairs = firms(spark).crossJoin(orgs.select("login", F.col("name").alias("shown"), "description"))
    scored = pairs.withColumn("score", matching.org_score(F.col("login"), F.col("shown"), F.col("description"), F.col("name"), F.col("domain"))).where(F.col("score") >= rules.MINIMUM)
    want = {}
    for r in scored.collect():
        want[r.company_id] = min(want.get(r.company_id, (0, "")), (-r.score, r.login))
    found = enrichment.code_host(firms(spark), orgs)
    got = {r.company_id: (-r.confidence, r.entity_id) for r in found.collect() if r.entity_id}
    assert got == want and len(got) >= 3
    assert {r.reason for r in found.where("entity_id IS NULL").collect()} == {"no match"}
    listed = spark.createDataFrame([("acmepumps", 1, "jo", "Jo Ray", None), ("acmepumps", 2, "li", None, "https://github.com/li"), ("other", 3, "no", "No One", None)], "org_login string, seq long, login string, name string, html_url string")
    people = {r.seq: r for r in enrichment.members(found, listed).collect()}
    assert set(people) == {1, 2} and people[1].scope == 1 and people[1].source_refs == ["github:jo", "github:org:acmepumps"] and people[2].name == "li"


def test_registry_statuses_and_merged_people(spark):
    own = firms(spark).withColumn("cin", F.when(F.col("company_id") == 4, "N9").when(F.col("company_id") == 5, "N8"))
    listed = spark.createDataFrame([("N1", "Acme Pumps Private Limited"), ("N2", "Zed Holdings"), ("N9", "Quill LLP")], "cin string, name string")
    found = {r.company_id: r for r in enrichment.registry(own, listed, listed.where("cin <> 'N2'")).collect()}
    assert [(found[i].status, found[i].reason) for i in range(1, 6)] == [("pending", "name"), ("review", "weak match"), ("review", "no match"), ("pending", "number"), ("review", "number not found")]
    records = enrichment.registry(own, listed, listed)
    directors = spark.createDataFrame([("N1", 10, "7", "Jo Ray", "Director"), ("N2", 11, "8", "Un Sure", "Director")], "cin string, seq long, din string, name string, designation string")
    people = enrichment.directors(records, directors)
    site = people.withColumn("seq", F.lit(1).cast("long")).withColumn("sources", F.array(F.lit("website"))).withColumn("email", F.lit("jo@acmepumps.com"))
    merged, review = resolve.dedupe_people(people.unionByName(site))
    (one,) = merged.collect()
    assert one.sources == ["website", "mca"] and one.titles == ["Director"] and one.email == "jo@acmepumps.com" and review.count() == 0


def test_person_pairs_equal_all_pairs_of_short_names(spark):
    import random

    from orecart.functions.names import fuzzy_match, name_key

    rnd = random.Random(13)
    names = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 13))) + rnd.choice(["", " a", " bo", " cab"]) for _ in range(170)}
    none = F.lit(None).cast("string")
    n = spark.createDataFrame([(i, x) for i, x in enumerate(sorted(names))], "seq long, name string")
    people = n.select("seq", "name", name_key(F.col("name")).alias("name_key"), none.alias("email"), none.alias("phone"), F.array().cast("array<string>").alias("profile_urls"), none.alias("company_domain"), F.lit(1).alias("scope"))
    got = {(r.a.seq, r.b.seq) for r in resolve.person_pairs(people).collect()}
    a, b = n.select(F.col("seq").alias("x"), F.col("name").alias("p")), n.select(F.col("seq").alias("y"), F.col("name").alias("q"))
    every = a.crossJoin(b).where("x < y").where((name_key(F.col("p")) == name_key(F.col("q"))) | fuzzy_match(F.col("p"), F.col("q")))
    assert got == {(r.x, r.y) for r in every.collect()} and len(got) > 50
