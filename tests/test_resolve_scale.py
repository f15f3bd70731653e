"""People and contacts against sequential versions; large components and companies."""

import random
from collections import Counter

from pyspark.sql import functions as F

from orecart.operators import resolve
from tests.test_operators import person

CONTACTS = "domain string, seq long, full_name string, first_name string, last_name string, title string, role_category string, email string, phone string, profile_urls array<string>, source_url string, source_urls array<string>, page_ids array<bigint>, confidence double"
VALUES = ["full_name", "first_name", "last_name", "title", "role_category", "email", "phone"]


def slow_contacts(rows):
    groups = []
    for c in rows:
        meets = lambda m: (m["email"] and m["email"] == c["email"]) or (m["phone"] and m["phone"] == c["phone"]) or (m["full_name"] and c["full_name"] and m["full_name"].lower() == c["full_name"].lower()) or set(m["profile_urls"] or []) & set(c["profile_urls"] or [])  # noqa: B023, E731
        hit = next((g for g in groups if any(meets(m) for m in g)), None)
        groups.append([c]) if hit is None else hit.append(c)
    out = Counter()
    for g in groups:
        best = max(range(len(g)), key=lambda i: (g[i]["confidence"] or 0, bool(g[i]["full_name"]), -i))
        row = {c: g[best][c] or next((r[c] for r in g if r[c]), g[best][c]) for c in VALUES}
        lists = [tuple(dict.fromkeys(v for r in g for v in (r[c] or []))) for c in ("profile_urls", "source_urls", "page_ids")]
        out[(*row.values(), g[best]["source_url"], *lists)] += 1
    return out


def held(df):
    return Counter((*(r[c] for c in VALUES), r.source_url, *(tuple(r[c]) for c in ("profile_urls", "source_urls", "page_ids"))) for r in df.collect())


def contact(rnd, domain, i, names):
    some = lambda *v: rnd.choice(v)
    return {"domain": domain, "seq": i, "full_name": rnd.choice(names), "first_name": some("", "A", None), "last_name": "", "title": some("", "CEO", None), "role_category": some(None, "ceo"), "email": some(None, "", f"m{rnd.randrange(40)}"), "phone": some(None, None, f"p{rnd.randrange(30)}"), "profile_urls": some([], None, [f"u{rnd.randrange(30)}", f"u{rnd.randrange(30)}"]), "source_url": f"s{i}", "source_urls": some([], [f"s{i % 7}", "s1"]), "page_ids": some(None, [i % 9, i]), "confidence": some(None, 0.3, 0.9)}


def test_contacts_equal_a_scan(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK", 16)
    rnd = random.Random(11)
    rows = [contact(rnd, d, i * 10 + k, ["", None, *[f"Name {j}" for j in range(n)], "NAME 1"]) for k, (d, n, m) in enumerate((("a", 60, 120), ("b", 3, 60), (None, 20, 40))) for i in range(m)]
    want = sum((slow_contacts(sorted((r for r in rows if r["domain"] == d), key=lambda r: r["seq"])) for d in ("a", "b", None)), Counter())
    df = spark.createDataFrame([tuple(r.values()) for r in rows], CONTACTS).repartition(5)
    assert held(resolve.dedupe_contacts(df)) == want
    assert resolve.dedupe_contacts(df.limit(0)).count() == 0


def test_a_company_of_many_contacts_and_long_chains(spark):
    n = 30_000
    keyed = spark.range(n).select(F.lit("d").alias("scope"), "id", F.explode(F.array(F.floor(F.col("id") / 2), F.floor((F.col("id") + 1) / 2) + n)).alias("k")).select("scope", F.when(F.col("id") < n // 2, "hot").otherwise(F.col("k").cast("string")).alias("key"), F.col("id").alias("n"))
    got = resolve.first_owners(keyed).groupBy("owner").count().collect()
    assert {r.owner: r["count"] for r in got} == {0: n // 2, n // 2: n // 2}


def slow_people(rows):
    """First fit over all pairs within each component of people that are the same."""
    phones = Counter((r["company_domain"] or "", r["phone"]) for r in rows if r["phone"])
    known = {p for (_, p), c in phones.items() if c == 1}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    def compare(a, b):
        phone = lambda r: r["phone"] if r["phone"] in known else None
        if a["company_domain"] and b["company_domain"] and a["company_domain"] != b["company_domain"]:
            return "distinct"
        for x, y in ((a["email"], b["email"]), (phone(a), phone(b))):
            if x and y and x != y:
                return "distinct"
        if (a["email"] and b["email"]) or (phone(a) and phone(b)) or set(a["profile_urls"]) & set(b["profile_urls"]) or (a["name_key"] and a["name_key"] == b["name_key"]):
            return "same"
        x, y = a["name_key"], b["name_key"]
        s, t = sorted((x.split(), y.split()), key=len)
        near = distance(x, y) * 5 <= max(len(x), len(y)) or (len(s) >= 2 and set(s) <= set(t))
        return "review" if x and y and near else "distinct"

    root = {r["seq"]: r["seq"] for r in rows}
    for _ in rows:
        for a in rows:
            for b in rows:
                if a["seq"] < b["seq"] and compare(a, b) == "same":
                    root[a["seq"]] = root[b["seq"]] = min(root[a["seq"]], root[b["seq"]])
    out = []
    for top in set(root.values()):
        parts = []
        for r in sorted((r for r in rows if root[r["seq"]] == top), key=lambda r: r["seq"]):
            part = next((p for p in parts if all(compare(x, r) != "distinct" for x in p)), None)
            parts.append([r]) if part is None else part.append(r)
        out += [tuple(sorted(r["seq"] for r in p)) for p in parts]
    return sorted(out)


def test_people_equal_first_fit_over_all_pairs(spark):
    rnd = random.Random(21)
    names = ["asha rao", "asha r rao", "asha roa", "bo li", "bo lee", "jo ray", ""]
    rows = [person(i, rnd.choice(names), email=rnd.choice([None, None, "x@a.com", "y@a.com", "z@a.com"]), phone=rnd.choice([None, None, "111", "222", "333", "444"]), profile_urls=rnd.choice([[], [], ["u1"], ["u2", "u1"], ["u3"]]), company_domain=rnd.choice([None, "a.com", "a.com", "b.com"]), page_ids=[i]) for i in range(45)]
    merged, _ = resolve.dedupe_people(spark.createDataFrame(rows, f"seq long, scope int, {resolve.PERSON}").repartition(3))
    assert sorted(tuple(sorted(r.page_ids)) for r in merged.collect()) == slow_people(rows)


def test_a_component_of_very_many_people(spark):
    n = 100_000
    many = spark.range(n).selectExpr("id seq", "1 scope", "'Asha Rao' name", "'asha rao' name_key", "if(id % 5 = 0, null, concat('m', id % 5, '@a.com')) email", "cast(null as string) phone", "cast(array() as array<string>) profile_urls", "array('s') source_urls", "array(id) page_ids", "array('r') source_refs", "array('CEO') titles", "'ceo' role_category", "array('website') sources", "'a.com' company_domain", "0.5 confidence")
    merged, review = resolve.dedupe_people(many.repartition(4))
    assert sorted((r.email, len(r.page_ids)) for r in merged.collect()) == [("m1@a.com", 2 * n // 5), *[(f"m{i}@a.com", n // 5) for i in (2, 3, 4)]]
    assert review.count() == 0
