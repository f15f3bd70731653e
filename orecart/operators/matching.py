"""Matching companies with code-hosting organisations and registry entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orecart import rules
from orecart.functions.company import legal_key, slug
from orecart.functions.text import tokens
from orecart.functions.url import domain_stem


def _overlap(a: Column, b: Column) -> Column:
    """Hundredths by shared tokens; tokens that repeat in a count each time."""
    n = F.size(F.filter(a, lambda t: F.array_contains(b, t)))
    return F.when((F.size(a) > 0) & (n >= F.least(F.lit(2), F.size(a))), 50 + n * 10).otherwise(0)


def org_score(login: Column, display: Column, description: Column, company: Column, domain: Column) -> Column:
    """Likeness of an organisation and a company, 0 to 1 in hundredths."""
    account, key, stem = slug(login), slug(company), slug(domain_stem(domain))
    name = F.lower(F.trim(F.coalesce(company, F.lit(""))))
    same = ((key != "") & (account == key)) | ((stem != "") & (account == stem))
    part = (F.length(key) >= 4) & (account.contains(key) | key.contains(account))
    text = F.length(name) >= 4
    said = text & (F.lower(F.trim(F.coalesce(display, F.lit("")))).contains(name) | F.lower(F.trim(F.coalesce(description, F.lit("")))).contains(name))
    points = F.greatest(F.when(same, 95).otherwise(0), F.when(part, 70).otherwise(0), F.when(said, 60).otherwise(0), _overlap(tokens(name, True), tokens(account, True)))
    return F.least(F.lit(100), points) / F.lit(100.0)


def registry_score(candidate: Column, candidate_cin: Column, company: Column, cin: Column, domain: Column) -> Column:
    """Likeness of a registry entry and a company, 0 to 1 in hundredths."""
    key, other, stem = legal_key(company), legal_key(candidate), slug(domain_stem(domain))
    same_cin = (F.coalesce(cin, F.lit("")) != "") & F.coalesce(F.lower(cin) == F.lower(candidate_cin), F.lit(False))
    named = F.when((key != "") & (other != "") & (key == other), 90).when((F.length(key) >= 4) & (other != "") & (key.contains(other) | other.contains(key)), 70).otherwise(0)
    points = F.greatest(F.when(same_cin, 95).otherwise(0), named, F.when((stem != "") & other.contains(stem), 70).otherwise(0), _overlap(tokens(company, True), tokens(candidate, True)))
    return F.least(F.lit(100), points) / F.lit(100.0)


def band(score: Column) -> Column:
    return F.when(score >= rules.ACCEPT, "accepted").when(score >= rules.MINIMUM, "review").otherwise("rejected")


def _windows(s: Column, size: int) -> Column:
    """Substrings of one length."""
    return F.when(F.length(s) >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - (size - 1))), lambda i: F.substr(s, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def _shared_blocks(name: Column, stem: Column) -> Column:
    """Tokens, and 4-grams of the keys and the stem for containment of four characters or more."""
    grams = lambda s: F.when(F.length(s) >= 4, _windows(s, 4)).otherwise(F.array(s))
    return F.concat(tokens(name, True), grams(slug(name)), grams(legal_key(name)), grams(stem))


def _tagged(tag: str, values: Column) -> Column:
    return F.transform(F.filter(values, lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: F.concat(F.lit(tag), x))


def _short(*values: Column) -> Column:
    return F.filter(F.array(*values), lambda x: F.length(x).between(1, 3))


def company_blocks(name: Column, domain: Column) -> Column:
    """Keys of which a company shares one with every candidate that scores.

    Short keys meet apart from the others: "k:" candidates' keys of up to 3 characters within a company key of 4 or more,
    "d:" the company's stem of up to 3 within a candidate key, "r:" names with a key of up to 3 within the written name,
    "e:" candidates without a key, which every company key of 4 or more contains.
    """
    key, legal, stem = slug(name), legal_key(name), slug(domain_stem(domain))
    text = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    none = F.array().cast("array<string>")
    grams = F.flatten(F.array(*[F.when(F.length(k) >= 4, _windows(k, size)).otherwise(none) for k in (key, legal) for size in (1, 2, 3)]))
    said = F.when((F.length(key) < 4) & (F.length(text) >= 4), F.array(F.substr(text, F.lit(1), F.lit(4)))).otherwise(none)
    empty = F.when(F.length(key) >= 4, F.array(F.lit("e:"))).otherwise(none)
    return F.array_distinct(F.concat(F.filter(_shared_blocks(name, stem), lambda x: F.coalesce(x, F.lit("")) != ""), _tagged("k:", grams), _tagged("d:", _short(stem)), _tagged("r:", said), empty))


def candidate_blocks(name: Column) -> Column:
    """The counterpart of company_blocks, without "e:"."""
    key, legal = slug(name), legal_key(name)
    text = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    grams = F.flatten(F.array(*[_windows(legal, size) for size in (1, 2, 3)]))
    said = F.filter(_windows(text, 4), lambda x: x.rlike("[^a-z0-9]"))
    return F.array_distinct(F.concat(F.filter(_shared_blocks(name, F.lit("")), lambda x: F.coalesce(x, F.lit("")) != ""), _tagged("k:", _short(key, legal)), _tagged("d:", grams), _tagged("r:", said)))


def best_match(pairs: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """The highest score per key, ties to the smallest order value."""
    w = Window.partitionBy(key).orderBy(F.desc(score), order)
    return pairs.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def technology_hints(repos: DataFrame, key: str, language: str, topics: str) -> DataFrame:
    """Per key: languages with repository counts, most first, and distinct topics."""
    counts = repos.where(F.coalesce(language, F.lit("")) != "").groupBy(key, language).agg(F.count("*").alias("repositories"))
    langs = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("repositories")).alias("n"), F.col(language).alias("language")))).alias("x"))
    langs = langs.select(key, F.transform("x", lambda s: F.struct(s["language"].alias("language"), (-s["n"]).alias("repositories"))).alias("languages"))
    tops = repos.select(key, F.explode(topics).alias("t")).groupBy(key).agg(F.array_sort(F.collect_set("t")).alias("topics"))
    return langs.join(tops, key, "full_outer")


def met(companies: DataFrame, candidates: DataFrame) -> DataFrame:
    """(company_id, candidate_id) that share a block. Ids alone meet; names follow."""
    left = companies.select("company_id", F.explode(company_blocks(F.col("name"), F.col("domain"))).alias("block"))
    right = candidates.select("candidate_id", F.explode(candidate_blocks(F.col("name"))).alias("block"))
    # Candidates without a key all score alike with a company, so the first of them stands for all.
    blank = candidates.where(slug(F.col("name")) == "").orderBy("candidate_id").limit(1).select("candidate_id", F.lit("e:").alias("block"))
    return left.join(right.union(blank), "block").select("company_id", "candidate_id").distinct()


def enrich(companies: DataFrame, candidates: DataFrame, score: Column) -> DataFrame:
    """Best candidate per company with its band. Weak matches keep the record for review but carry no people.

    companies: company_id, name, domain; candidates: candidate_id, name, domain. Pairs meet on shared blocks, which lose no pair that org_score or registry_score (without CIN and description) puts first.
    """
    named = companies.select("company_id", F.col("name").alias("company_name"), F.col("domain").alias("company_domain"))
    pairs = met(companies, candidates).join(named, "company_id").join(candidates.select("candidate_id", F.col("name").alias("candidate_name")), "candidate_id").withColumn("score", score).where(F.col("score") >= rules.MINIMUM)
    return best_match(pairs, "company_id", "score", "candidate_id").withColumn("band", band(F.col("score"))).withColumn("carries_people", F.col("band") == "accepted")
