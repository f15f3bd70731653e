"""Qualification of company profiles against a customer profile and a search plan."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from orecart import rules
from orecart.functions.company import profile_text
from orecart.functions.text import ascii_bounds, guarded, let, literals, matches


def listed(value: Sequence[str] | str | None) -> list[str]:
    parts = re.split(r"[,;\n]", value) if isinstance(value, str) else list(value or [])
    return [p.strip() for p in map(str, parts) if p.strip()]


def words(text: str | None, stop: Sequence[str], least: int = 3) -> list[str]:
    found = re.sub(r"[^a-z0-9\s-]", " ", (text or "").lower()).split()
    return list(dict.fromkeys(w for w in found if len(w) >= least and w not in stop))


def _verdict(status: str | Column, reason: str | None = None, evidence: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    s = F.lit(status) if isinstance(status, str) else status
    return F.struct(s.alias("status"), (F.array(F.lit(reason)) if reason else none).alias("reasons"), (F.array(evidence) if evidence is not None else none).alias("evidence"))


def _joined(prefix: str, terms: Column) -> Column:
    return F.concat(F.lit(prefix), F.array_join(terms, ", "))


def product_fit(profile: Column, icp: Mapping) -> Column:
    return let(F.lower(profile_text(profile)), lambda text: _product_fit(profile, text, icp))


def _product_fit(profile: Column, text: Column, icp: Mapping) -> Column:
    phrases = list(dict.fromkeys([*listed(icp.get("company_types") or icp.get("companyTypes")), *listed(icp.get("industries"))]))
    terms = list(dict.fromkeys(t for p in phrases for t in words(p, rules.PLAN_STOP_WORDS) if t not in rules.ICP_STOP_WORDS))
    exact = F.filter(literals(phrases), lambda p: text.contains(F.lower(p)))
    some = F.filter(literals(terms), lambda t: text.contains(t))
    out = F.when(F.coalesce(profile["company_name"], F.lit("")) == "", _verdict("review", "missing company name"))
    out = out.when(guarded(text, rules.NON_COMPANY_STEMS, rules.NON_COMPANY), _verdict("not_qualified", "not a real operating company", F.lit("non-company signal detected")))
    if not phrases:
        return out.otherwise(_verdict("review", "product ICP has no target company types or industries"))
    return (
        out.when(F.size(exact) > 0, _verdict("qualified", None, _joined("matches target type: ", exact)))
        .when(F.size(some) >= 2, _verdict("qualified", None, _joined("matches target terms: ", some)))
        .when(F.size(some) == 1, _verdict("review", "partial match to product ICP", _joined("matches target term: ", some)))
        .otherwise(_verdict("not_qualified", "does not match product ICP"))
    )


def plan_terms(plan: Mapping) -> list[str]:
    return list(dict.fromkeys(t for k in ("product_or_technology", "industry", "target_description") for t in words(plan.get(k), rules.PLAN_STOP_WORDS)))


def plan_fit(profile: Column, plan: Mapping | None) -> Column:
    if not plan:
        return _verdict("review", "missing search plan")
    terms = plan_terms(plan)
    if not terms:
        return _verdict("review", "no search plan terms")
    return let(F.lower(profile_text(profile)), lambda text: _plan_fit(profile, text, plan, terms))


def _plan_fit(profile: Column, text: Column, plan: Mapping, terms: list[str]) -> Column:
    content = (F.coalesce(profile["company_description"], F.lit("")) != "") | (F.size(profile["industries"]) > 0) | (F.size(profile["products_services"]) > 0)
    found = F.filter(literals(terms), lambda t: text.contains(t))
    matched = _joined("matches: ", found)
    out = F.when(~content, _verdict("review", "no profile evidence")).when(F.size(found) == 0, _verdict("not_qualified", "does not match search plan"))
    if plan.get("relationship") != "uses":
        return out.otherwise(_verdict("qualified", None, matched))
    signals = profile["technology_signals"]
    offers = F.transform(F.filter(signals, lambda s: s["relationship"].isin("offers", "implements")), lambda s: F.lower(s["technology"]))
    sold = F.filter(found, lambda t: F.exists(offers, lambda o: o.contains(t)))
    usage = matches(text, rules.USAGE_PHRASES)

    def used(term: Column) -> Column:
        signal = F.exists(signals, lambda s: s["relationship"].isin("uses", "integrates_with") & F.lower(s["technology"]).contains(term))
        word = reduce(lambda a, t: a.when(term == t, matches(text, rf"\b{re.escape(t)}\b")), terms[1:], F.when(term == terms[0], matches(text, rf"\b{re.escape(terms[0])}\b"))).otherwise(F.lit(False))
        return signal | (word & usage)

    using = F.filter(found, used)
    both = F.struct(F.lit("qualified").alias("status"), F.array().cast("array<string>").alias("reasons"), F.array(matched, _joined("uses: ", using)).alias("evidence"))
    return out.when(F.size(sold) > 0, _verdict("not_qualified", "sells the target technology", _joined("offers: ", sold))).when(F.size(using) > 0, both).otherwise(_verdict("review", "mentions technology but no evidence of use", matched))


def geography(profile: Column, icp: Mapping, plan: Mapping | None, domain: Column) -> Column:
    """Only the first target counts."""
    targets = [*listed(icp.get("geography") or icp.get("locations")), *listed(icp.get("location")), *listed((plan or {}).get("location"))]
    if not targets:
        return _verdict("qualified")
    target = targets[0]
    text = F.concat_ws(" ", profile["country"], profile["headquarters"], profile["company_description"])
    india = bool(re.search(r"\bindia\b", target, re.IGNORECASE))
    in_text = matches(text, r"\b(india|indian)\b" if india else rf"\b{re.escape(target)}\b")
    in_phone = F.exists(profile["company_phones"], lambda p: p.rlike(ascii_bounds(r"^\s*\+91\b"))) if india else F.lit(False)
    in_domain = F.coalesce(domain, F.lit("")).rlike(r"(?i)(?:^|\.)[a-z0-9-]+\.in$") if india else F.lit(False)
    evidence = F.array_compact(F.array(F.when(in_text, f"location mentions {target}"), F.when(in_phone, "company phone uses India country code +91"), F.when(in_domain, "company website uses the .in country domain")))
    good = F.struct(F.lit("qualified").alias("status"), F.array().cast("array<string>").alias("reasons"), evidence.alias("evidence"))
    return F.when(in_text | in_phone | in_domain, good).otherwise(_verdict("review", f"no {target} location evidence on the company profile"))


def buyer_role(profile: Column, icp: Mapping) -> Column:
    roles = listed(icp.get("buyer_roles") or icp.get("buyerRoles"))
    if not roles:
        return _verdict("qualified")
    text = F.lower(profile_text(profile))

    def pattern(role: str) -> str:
        body = re.sub("co-founder", "co[- ]?founder", r"\s+".join(re.escape(w).replace(r"\-", "-") for w in role.lower().split()), flags=re.IGNORECASE)
        return rf"\b{body[:-1]}(?:y|ies)\b" if body.endswith("y") else rf"\b{body}(?:s|es)?\b"

    def stem(role: str) -> str:
        """The longest run of letters that every spelling of the role holds."""
        return max(re.split(r"[^a-z0-9]+", role.lower().removesuffix("y")), key=len)

    def close(text: Column) -> Column:
        found = F.array_compact(F.array(*[F.when(guarded(text, [stem(r)], pattern(r)), F.lit(r)) for r in roles]))
        return _roles(found)

    return let(text, close)


def _roles(found: Column) -> Column:
    return F.when(F.size(found) > 0, _verdict("qualified", None, _joined("company profile mentions buyer role: ", found))).otherwise(_verdict("review", "target buyer role is not identified on the company profile"))


def qualify(profile: Column, plan: Mapping | None = None, icp: Mapping | None = None, domain: Column | None = None) -> Column:
    """struct(status, reasons, evidence): stops at the first gate that fails; any review gives review."""
    icp, domain = icp or {}, domain if domain is not None else F.lit("")
    gates = F.struct(product_fit(profile, icp).alias("a"), plan_fit(profile, plan).alias("b"), geography(profile, icp, plan, domain).alias("c"), buyer_role(profile, icp).alias("d"))
    merged = lambda status, *vs: F.struct(status.alias("status"), F.flatten(F.array(*[v["reasons"] for v in vs])).alias("reasons"), F.flatten(F.array(*[v["evidence"] for v in vs])).alias("evidence"))

    def close(v: Column) -> Column:
        a, b, c, d = (v[k] for k in "abcd")
        review = reduce(lambda x, y: x | (y["status"] == "review"), (b, c, d), a["status"] == "review")
        return (
            F.when(a["status"] == "not_qualified", merged(F.lit("not_qualified"), a))
            .when(b["status"] == "not_qualified", merged(F.lit("not_qualified"), a, b))
            .otherwise(merged(F.when(review, "review").otherwise("qualified"), a, b, c, d))
        )

    return let(gates, close)


def first_signal(text: Column, signals: Sequence[tuple[str, str]], ignore_case: bool = False) -> Column:
    """Label of the first signal whose pattern occurs."""
    return F.coalesce(*[F.when(matches(text, p, ignore_case), F.lit(label)) for label, p in signals])


def operating_company(profile: Column) -> Column:
    """The permanent profile of buyers of business automation; its patterns are case-sensitive."""
    text = F.concat_ws(" ", profile["company_name"], profile["company_description"], profile["industries"], profile["products_services"])
    offers = F.transform(F.filter(profile["technology_signals"], lambda s: s["relationship"].isin("offers", "implements")), lambda s: s["technology"])
    bad, vendor, benefit = first_signal(text, rules.NON_COMPANY_SIGNALS), first_signal(text, rules.VENDOR_SIGNALS), first_signal(text, rules.BENEFIT_SIGNALS)
    return (
        F.when(F.coalesce(profile["company_name"], F.lit("")) == "", _verdict("review", "missing company name"))
        .when(bad.isNotNull(), _verdict("not_qualified", "not a real operating company", bad))
        .when(F.size(offers) > 0, _verdict("not_qualified", "sells business automation", _joined("offers/implements: ", offers)))
        .when(vendor.isNotNull(), _verdict("not_qualified", "service/technology vendor", vendor))
        .when(benefit.isNull(), _verdict("review", "no business-process operations detected"))
        .otherwise(_verdict("qualified", None, benefit))
    )


def should_deep_crawl(verdict: Column) -> Column:
    return verdict["status"] == "qualified"


def expert_services(profile: Column) -> Column:
    """The profile of expert-service firms: every business signal found is evidence."""
    text = profile_text(profile)
    labels = lambda prefix, rows: F.array_compact(F.array(*[F.when(matches(text, p), F.lit(f"{prefix}: {label}")) for label, p in rows]))
    business, buyers = labels("business fit", rules.EXPERT_BUSINESS), labels("buyer/company signal", rules.EXPERT_BUYERS)
    none = F.array().cast("array<string>")
    found = lambda status, reasons: F.struct(F.lit(status).alias("status"), reasons.alias("reasons"), F.concat(business, buyers).alias("evidence"))
    return (
        F.when(F.coalesce(profile["company_name"], F.lit("")) == "", _verdict("review", "missing company name"))
        .when(matches(text, rules.EXPERT_NON_COMPANY), _verdict("not_qualified", "not a real operating company", F.lit("non-company signal detected")))
        .when(F.size(business) == 0, found("review", F.array(F.lit("no target business type detected"))))
        .otherwise(found("qualified", none))
    )
