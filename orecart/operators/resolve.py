"""People across sources: comparison, components, conflicts, merging; contacts within a company."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orecart import rules
from orecart.functions import contact as C
from orecart.functions import url as U
from orecart.functions.names import fuzzy_match, name_key, name_tokens, split_name
from orecart.operators.dedupe import unique_phones
from orecart.operators.relevance import numbered

PERSON = "name string, name_key string, email string, phone string, profile_urls array<string>, source_urls array<string>, page_ids array<bigint>, source_refs array<string>, titles array<string>, role_category string, sources array<string>, company_domain string, confidence double"


def _none() -> Column:
    return F.lit(None).cast("string")


def _strings(*columns: Column) -> Column:
    return F.filter(F.array(*columns), lambda x: F.coalesce(x, F.lit("")) != "")


def people_from_contacts(contacts: DataFrame) -> DataFrame:
    name = F.trim(F.coalesce("full_name", F.lit("")))
    urls = F.when(F.size("source_urls") > 0, F.col("source_urls")).otherwise(_strings(F.col("source_url")))
    return contacts.select("seq", name.alias("name"), name_key(name).alias("name_key"), C.normalize_email(F.col("email")).alias("email"), C.normalize_phone(F.col("phone")).alias("phone"), F.transform("profile_urls", U.profile_url).alias("profile_urls"), urls.alias("source_urls"), "page_ids", urls.alias("source_refs"), _strings(F.col("title")).alias("titles"), "role_category", F.array(F.lit("website")).alias("sources"), F.nullif(U.hostname(F.get(urls, F.lit(0))), F.lit("")).alias("company_domain"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def people_from_members(members: DataFrame, *keep: str) -> DataFrame:
    """members: seq, login, name, html_url, org_login, confidence; the columns `keep` stay."""
    link = F.coalesce(F.nullif("html_url", F.lit("")), F.concat(F.lit("https://github.com/"), F.col("login")))
    name = F.trim(F.coalesce(F.nullif("name", F.lit("")), "login", F.lit("")))
    refs = F.array_compact(F.array(F.concat(F.lit("github:"), F.col("login")), F.concat(F.lit("github:org:"), F.col("org_login"))))
    empty = F.array().cast("array<bigint>")
    return members.select(*keep, "seq", name.alias("name"), name_key(name).alias("name_key"), _none().alias("email"), _none().alias("phone"), _strings(U.profile_url(link)).alias("profile_urls"), _strings(link).alias("source_urls"), empty.alias("page_ids"), refs.alias("source_refs"), F.array().cast("array<string>").alias("titles"), _none().alias("role_category"), F.array(F.lit("github")).alias("sources"), _none().alias("company_domain"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def people_from_directors(directors: DataFrame, *keep: str) -> DataFrame:
    """directors: seq, din, name, designation, cin, confidence; the columns `keep` stay."""
    name = F.trim(F.coalesce("name", F.lit("")))
    refs = F.array_compact(F.array(F.concat(F.lit("mca:din:"), F.col("din")), F.concat(F.lit("mca:cin:"), F.col("cin"))))
    none, empty = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    return directors.select(*keep, "seq", name.alias("name"), name_key(name).alias("name_key"), _none().alias("email"), _none().alias("phone"), none.alias("profile_urls"), none.alias("source_urls"), empty.alias("page_ids"), refs.alias("source_refs"), _strings(F.col("designation")).alias("titles"), _none().alias("role_category"), F.array(F.lit("mca")).alias("sources"), _none().alias("company_domain"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def compare(a: str, b: str) -> Column:
    """same, review or distinct for two person structs with phone_id, the phone if it identifies."""
    x, y = (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))
    ea, eb = C.identity_email(x("email")), C.identity_email(y("email"))
    differ = lambda p, q: p.isNotNull() & q.isNotNull() & (p != q)
    domains = (F.coalesce(x("company_domain"), F.lit("")) != "") & (F.coalesce(y("company_domain"), F.lit("")) != "") & (x("company_domain") != y("company_domain"))
    return (
        F.when(domains | differ(ea, eb) | differ(x("phone_id"), y("phone_id")), "distinct")
        .when(ea.isNotNull() & eb.isNotNull(), "same")
        .when(x("phone_id").isNotNull() & y("phone_id").isNotNull(), "same")
        .when(F.coalesce(F.arrays_overlap(x("profile_urls"), y("profile_urls")), F.lit(False)), "same")
        .when((x("name_key") != "") & (x("name_key") == y("name_key")), "same")
        .when(fuzzy_match(x("name"), y("name")), "review")
        .otherwise("distinct")
    )


def person_pairs(people: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, a, b, verdict) of pairs that are the same or for review, a.seq < b.seq.

    Pairs meet on a shared key: mailbox, identifying phone, profile URL, name key, a name token, a
    3-gram of the name key, or the first two characters of a key of 4 or 5. At an edit distance
    d <= len/5 one of d + 1 pieces of the longer key stays whole: it has 3 characters or more, except
    where a key of 5 is edited in its last 3; then the first 2 stay. So no fuzzy pair is lost.
    """
    return _pairs(_with_phone_id(people), scope)


def _with_phone_id(people: DataFrame) -> DataFrame:
    return people.join(unique_phones(people).withColumn("phone_id", F.col("phone")), "phone", "left")


def _pairs(known: DataFrame, scope: str) -> DataFrame:
    person = F.struct("seq", *[c for c in known.columns if c not in ("seq", scope)])
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("name_key") - 2)), lambda i: F.concat(F.lit("g:"), F.substr("name_key", i, F.lit(3))))
    starts = F.when(F.length("name_key").between(4, 5), F.array(F.concat(F.lit("h:"), F.substr("name_key", F.lit(1), F.lit(2))))).otherwise(F.array().cast("array<string>"))
    tagged = lambda tag, arr: F.transform(arr, lambda v: F.concat(F.lit(tag), v))
    keys = F.array_distinct(F.concat(tagged("e:", F.array_compact(F.array(C.identity_email(F.col("email"))))), tagged("p:", F.array_compact(F.array("phone_id"))), tagged("u:", F.col("profile_urls")), tagged("n:", F.array("name_key")), tagged("t:", name_tokens(F.col("name"))), grams, starts))
    rows = known.select(scope, "seq", F.explode(keys).alias("key"))
    met = rows.withColumnRenamed("seq", "sa").join(rows.withColumnRenamed("seq", "sb"), [scope, "key"]).where("sa < sb").select(scope, "sa", "sb").distinct()
    a = known.select(scope, F.col("seq").alias("sa"), person.alias("a"))
    pairs = met.join(a, [scope, "sa"]).join(a.withColumnsRenamed({"sa": "sb", "a": "b"}), [scope, "sb"])
    return pairs.withColumn("verdict", compare("a", "b")).where("verdict <> 'distinct'").select(scope, "a", "b", "verdict")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): least node reachable. Labels take the least neighbour's label, then that label's label, until none changes."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = nodes.select("node", F.col("node").alias("root"))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        low = labels.join(near, labels["node"] == near["a"], "left").select("node", "root", F.least("root", "near").alias("low"))
        hop = labels.select(F.col("node").alias("mid"), F.col("root").alias("hop"))
        moved = low.join(hop, low["low"] == hop["mid"]).select("node", F.col("root").alias("was"), F.least("low", "hop").alias("root")).checkpoint()
        labels = moved.select("node", "root")
        if not moved.where("was <> root").limit(1).count():
            return labels


def split_conflicts(members: DataFrame, friends: DataFrame) -> DataFrame:
    """(root, node, part): members in order, each put into the first part that holds no one distinct from it.

    members: root, node; friends: root, a, b (a < b), the pairs that are not distinct. All other pairs of a component are, and are
    never listed: a part holds no foe of a member if the member's friends are all of it. A component streams through one task in
    node order, which keeps a part number for each node and a size for each part.
    """
    rows = members.join(friends.withColumnsRenamed({"b": "node", "a": "friend"}), ["root", "node"], "left").select("root", "node", "friend")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, parts, sizes = None, {}, []
        node, known = None, Counter()

        def place() -> tuple[int, int, int]:
            part = min((p for p, n in known.items() if n == sizes[p]), default=len(sizes))
            if part == len(sizes):
                sizes.append(0)
            sizes[part] += 1
            parts[node] = part
            return root, node, part

        for batch in batches:
            out = []
            for r, n, friend in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (r, n) != (root, node):
                    if node is not None:
                        out.append(place())
                    if r != root:
                        parts, sizes = {}, []
                    root, node, known = r, n, Counter()
                if friend is not None:
                    known[parts[friend]] += 1
            yield _placed(out)
        if node is not None:
            yield _placed([place()])

    return rows.repartition("root").sortWithinPartitions("root", "node", "friend").mapInArrow(run, "root long, node long, part int")


def _placed(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["root", "node", "part"])


def merge_people(grouped: DataFrame, key: list[str]) -> DataFrame:
    """One person per group: best name, first non-empty values in order, distinct unions, known source order, highest confidence."""
    rank = F.when(F.coalesce("email", F.lit("")) != "", 4).otherwise(0) + F.when(F.size("titles") > 0, 2).otherwise(0) + F.size(name_tokens(F.col("name")))
    first = lambda c: F.min_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col("seq")))
    union = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("seq").alias("s"), F.col(c).alias("v")))), lambda x: x["v"]))).alias(c)
    out = grouped.groupBy(*key).agg(F.max_by("name", F.struct(rank, -F.col("seq"))).alias("name"), first("email").alias("email"), first("phone").alias("phone"), first("role_category").alias("role_category"), *[union(c) for c in ("profile_urls", "source_urls", "page_ids", "source_refs", "titles")], F.flatten(F.collect_set("sources")).alias("found"), F.max("confidence").alias("confidence"))
    order = F.array(*[F.lit(s) for s in rules.SOURCE_ORDER])
    return out.withColumn("sources", F.filter(order, lambda s: F.array_contains("found", s))).drop("found").withColumn("name_key", name_key(F.col("name"))).select("*", split_name(F.col("name")).alias("names")).select("*", "names.*").drop("names")


def dedupe_people(people: DataFrame, scope: str = "scope") -> tuple[DataFrame, DataFrame]:
    """(merged people, review pairs). people: the columns of PERSON with seq and a scope of one company.

    People of one scope with equal identifiers, name and company domain compare alike with everyone and are the same if any of these is set, so
    the first of them stands for all in the comparison; review pairs are pairs of such first ones.
    """
    known = _with_phone_id(people)
    alike = {"__e": C.identity_email(F.col("email")), "__u": F.array_sort(F.array_distinct(F.coalesce("profile_urls", F.array().cast("array<string>")))), "__d": F.coalesce("company_domain", F.lit("")), "__s": F.col(scope)}
    some = F.col("__e").isNotNull() | F.col("phone_id").isNotNull() | (F.size("__u") > 0) | (F.coalesce("name_key", F.lit("")) != "")
    marked = known.withColumns(alike).withColumn("__own", F.when(~some, F.col("seq")))
    by = ["__s", "__e", "phone_id", "__u", "__d", "name_key", "name", "__own"]
    stands = marked.groupBy(*by).agg(F.min("seq").alias("rep"))
    same_as = reduce(lambda a, b: a & b, [marked[c].eqNullSafe(stands[c]) for c in by])
    reps = marked.join(stands, same_as).select(F.col("seq").alias("node"), "rep").checkpoint()
    firsts = known.join(reps.where("node = rep").select(F.col("node").alias("seq")), "seq", "left_semi")
    pairs = _pairs(firsts, scope).checkpoint()
    ids = pairs.select(F.col("a.seq").alias("a"), F.col("b.seq").alias("b"), "verdict")
    roots = components(firsts.select(F.col("seq").alias("node")), ids.where("verdict = 'same'").select("a", "b")).checkpoint()
    large = roots.groupBy("root").count().where("count > 2").select("root")
    friends = ids.select("a", "b").join(roots.withColumnRenamed("node", "a"), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("to")), "b").where("root = to").select("root", "a", "b")
    split = split_conflicts(roots.join(large, "root", "left_semi").select("root", "node"), friends.join(large, "root", "left_semi").select("root", "a", "b"))
    parts = roots.join(split, ["root", "node"], "left").select("root", F.col("node").alias("rep"), F.coalesce("part", F.lit(0)).alias("part"))
    merged = merge_people(people.withColumnRenamed("seq", "node").join(reps.join(parts, "rep").drop("rep"), "node").withColumn("seq", F.col("node")), ["root", "part"])
    return merged, pairs.where("verdict = 'review'").select(F.lit("fuzzy-name").alias("reason"), F.col("a.name").alias("left_name"), F.col("b.name").alias("right_name"))


CONTACT = "domain string, full_name string, first_name string, last_name string, title string, role_category string, email string, phone string, profile_urls array<string>, source_url string, source_urls array<string>, page_ids array<bigint>"


#: Contacts of a key are chained within blocks of so many numbers first, so that a key that very many share is no single window.
BLOCK = 65_536


def first_owners(keyed: DataFrame) -> DataFrame:
    """(n, owner): contacts in order of n, each joining the group of the least owner among earlier contacts that share a key; without any it starts one.

    keyed: scope, key, n. Owners are what descends from a contact, over keys to earlier ones, as far as it goes; a key's contacts are
    chained one to the one before, which reaches them all. Labels take the least label of the contact before in any key, then that label's label, until none changes.
    """
    rows = keyed.select("scope", "key", "n").distinct().withColumn("block", F.floor(F.col("n") / BLOCK)).checkpoint()
    inside = rows.withColumn("prev", F.lag("n").over(Window.partitionBy("scope", "key", "block").orderBy("n")))
    ends = rows.groupBy("scope", "key", "block").agg(F.min("n").alias("n"), F.max("n").alias("last"))
    across = ends.withColumn("prev", F.lag("last").over(Window.partitionBy("scope", "key").orderBy("block"))).select("n", "prev")
    edges = inside.select("n", "prev").unionByName(across).where("prev IS NOT NULL").distinct().checkpoint()
    labels = rows.select("n").distinct().withColumn("owner", F.col("n"))
    while True:
        near = edges.join(labels.withColumnsRenamed({"n": "prev", "owner": "found"}), "prev").groupBy("n").agg(F.min("found").alias("near"))
        low = labels.join(near, "n", "left").select("n", F.col("owner").alias("was"), F.least("owner", "near").alias("low"))
        hop = labels.select(F.col("n").alias("low"), F.col("owner").alias("hop"))
        moved = low.join(hop, "low").select("n", "was", F.least("low", "hop").alias("owner")).checkpoint()
        labels = moved.select("n", "owner")
        if not moved.where("was <> owner").limit(1).count():
            return labels


def dedupe_contacts(contacts: DataFrame) -> DataFrame:
    """First fit within a company: a contact joins the first group that has its mailbox, phone, name or a profile URL; groups never fuse.

    Of a group stay the best row's values (most confident, then named, then first), gaps filled by the first row that has them, and
    the lists' distinct values in order. A null list is empty; contacts without any key stay alone.
    """
    own = numbered(contacts, "seq", "n").withColumn("n", F.col("n").cast("long")).checkpoint()
    tagged = lambda tag, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(tag), c))
    urls = F.transform(F.coalesce("profile_urls", F.array().cast("array<string>")), lambda u: tagged("u:", u))
    keys = F.array_compact(F.concat(F.array(tagged("e:", F.col("email")), tagged("p:", F.col("phone")), tagged("n:", F.lower("full_name"))), urls))
    owners = first_owners(own.select(F.col("domain").alias("scope"), F.explode(keys).alias("key"), "n"))
    grouped = own.join(owners, "n", "left").withColumn("owner", F.coalesce("owner", "n"))
    values = ["full_name", "first_name", "last_name", "title", "role_category", "email", "phone"]
    lists = {"profile_urls": "string", "source_urls": "string", "page_ids": "long"}
    set_ = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    best = F.max_by(F.struct(*values, "source_url"), F.struct(F.coalesce("confidence", F.lit(0.0)), set_("full_name"), -F.col("n"))).alias("best")
    one = grouped.groupBy("owner").agg(F.first("domain").alias("domain"), best, *[F.min_by(c, F.when(set_(c), F.col("n"))).alias(c) for c in values])
    each = [grouped.select("owner", F.lit(c).alias("list"), "n", F.posexplode(F.col(c).cast("array<string>")).alias("pos", "value")) for c in lists]
    seen = reduce(lambda a, b: a.unionByName(b), each).groupBy("owner", "list", "value").agg(F.min(F.struct("n", "pos")).alias("at"))
    in_order = lambda c, kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == c, F.struct("at", "value")))), lambda x: x["value"].cast(kind)).alias(c)
    united = seen.groupBy("owner").agg(*[in_order(c, kind) for c, kind in lists.items()])
    rows = one.join(united, "owner", "left")
    filled = [F.coalesce(F.when(F.col(f"best.{c}") != "", F.col(f"best.{c}")), F.col(c), F.col(f"best.{c}")).alias(c) for c in values]
    out = rows.select("domain", *filled, F.col("best.source_url").alias("source_url"), *[F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c) for c, kind in lists.items()])
    return out.select(*[x.split()[0] for x in CONTACT.split(", ")]).withColumn("confidence", C.confidence(F.col("full_name"), F.col("email"), F.col("phone"), F.col("title")))
