"""HTML as Arrow-batched functions: a light tree on html.parser, companies, contacts, Markdown.

These are the engine's only Python row code; everything after the extraction is Column work.
"""

from __future__ import annotations

import contextlib
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

from orecart import rules

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Classes of person cards, names, titles, bylines.
CARD = {"team", "team-member", "member", "person", "people", "staff", "leadership", "founder", "founders", "executive", "director", "employee"}
NAME, JOB = {"name"}, {"title", "role", "position", "job-title", "jobtitle", "designation"}
BYLINE = ["byline", "author", "post-author", "article-author", "author-name"]
PROFILE = re.compile(r"(linkedin\.com|twitter\.com|x\.com|github\.com|crunchbase\.com)", re.IGNORECASE)
_HINT = re.compile(rules.ROLE_HINT, re.IGNORECASE | re.ASCII)


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def strings(self) -> Iterator[str]:
        """Pieces of text below this one, in document order."""
        todo = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            else:
                todo.extend(reversed(x.children))

    def text(self) -> str:
        return "".join(self.strings())

    def walk(self) -> Iterator[Node]:
        """Elements below this one, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            x = todo.pop()
            yield x
            todo.extend(c for c in reversed(x.children) if isinstance(c, Node))

    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def parents(self) -> Iterator[Node]:
        x = self.parent
        while x is not None:
            yield x
            x = x.parent


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)
        self.open: Counter[str] = Counter()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        x = self.at if self.open[tag] else None
        while x is not None and x.parent is not None:
            self.open[x.tag] -= 1
            if x.tag == tag:
                self.at = x.parent
                return
            x = x.parent

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Marked sections are comments, whatever their keyword."""
        return self.parse_bogus_comment(i, 0)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    """The page's tree; where the parser gives up, the tree up to there."""
    builder = _Builder()
    with contextlib.suppress(AssertionError, ValueError, RecursionError):
        builder.feed(html or "")
        builder.close()
    return builder.root


def clean(text: str | None) -> str:
    return re.sub(r"\s+", " ", text or "").strip()


def first(nodes: Iterator[Node], default: str = "") -> str:
    return next((clean(n.text()) for n in nodes), default)


HIDDEN = {"script", "style", "noscript", "iframe", "svg", "form"}
BLOCK = {"p", "li", "blockquote", "td", "th"}
HEADING = {f"h{i}" for i in range(1, 7)}


def visible(root: Node) -> list[Node]:
    """The tree's elements in order, after what Markdown does not show has been cut out of it."""
    todo = [root]
    while todo:
        x = todo.pop()
        x.children = [c for c in x.children if isinstance(c, str) or c.tag not in HIDDEN]
        todo.extend(c for c in x.children if isinstance(c, Node))
    return list(root.walk())


def to_markdown(html: str | None) -> str:
    """Title, headings, text blocks and links as lines; equal lines once."""
    nodes, lines = visible(parse(html)), []
    if title := first(n for n in nodes if n.tag == "title"):
        lines.append(f"# {title}")
    lines += [f"{'#' * int(n.tag[1])} {t}" for n in nodes if n.tag in HEADING and (t := clean(n.text()))]
    lines += [t for n in nodes if n.tag in BLOCK and len(t := clean(n.text())) > 2]
    lines += [f"[{t}]({n.attrs['href']})" for n in nodes if n.tag == "a" and n.attrs.get("href") and (t := clean(n.text()))]
    return "\n".join(dict.fromkeys(lines))


def terms_in(text: str, terms: Sequence[str]) -> list[str]:
    """The terms (lower case) that occur in the text."""
    low = text.lower()
    return [t for t in terms if t in low]


def _outermost(nodes: Iterable[Node], tags: set[str]) -> Iterator[Node]:
    """The elements of these tags that stand in no other of them."""
    inside: set[int] = set()
    for n in nodes:
        if n.parent is not None and id(n.parent) in inside:
            inside.add(id(n))
        elif n.tag in tags:
            inside.add(id(n))
            yield n


def markdown_fields(nodes: list[Node], terms: Sequence[str]) -> dict:
    """What the company rules read of a page's Markdown, without its lines being put together: the first top heading, the first text line (the first of 30
    characters, else the first), the terms that occur.

    Text within a block stands in the outer block's line too, so terms are looked for once in each outermost block: broken markup that nests
    every block in the one before costs no square.
    """
    lines = [(n, mark) for n in nodes if n.tag in BLOCK and (mark := next((y[0] for x in n.strings() if (y := x.strip())), ""))]
    heading = first(n for n in nodes if n.tag == "title") or next((t for n in nodes if n.tag == "h1" and (t := clean(n.text()))), "")
    heading = heading or next((t[2:] for n, mark in lines if mark == "#" and (t := clean(n.text())).startswith("# ")), "")
    some = text = ""
    for n, mark in lines:
        if mark not in "#[" and len(t := clean(n.text())) > 2:
            some = some or t
            if len(t) >= 30:
                text = t
                break
    blocks = [t for n in _outermost(nodes, BLOCK) if len(t := clean(n.text())) > 2]
    parts = [heading, *blocks, *(clean(n.text()) for n in _outermost(nodes, HEADING))]
    links = [n for n in nodes if n.tag == "a" and n.attrs.get("href") and any(x.strip() for x in n.strings())]
    parts += [n.attrs["href"] for n in links] + [clean(n.text()) for n in _outermost(links, {"a"})]
    return {"md_heading": heading, "md_text": text or some, "md_terms": terms_in("\n".join(parts), terms)}


def page_fields(html: str | None, terms: Sequence[str] = ()) -> dict:
    """Both company tiers' fields from one parse of the page."""
    root = parse(html)
    return company_parts(root, terms) | markdown_fields(visible(root), terms)


def company_parts(html: str | Node | None, terms: Sequence[str] = ()) -> dict:
    """Raw fields from which the company payload is built, of a page or its tree."""
    nodes = list((root := html if isinstance(html, Node) else parse(html)).walk())
    meta = {(n.attrs.get("property") or n.attrs.get("name") or "").lower(): n.attrs.get("content") for n in reversed(nodes) if n.tag == "meta"}
    mails = [n.attrs["href"][7:] for n in nodes if n.tag == "a" and n.attrs.get("href", "").lower().startswith("mailto:")]
    phones = [n.attrs["href"][4:] for n in nodes if n.tag == "a" and n.attrs.get("href", "").lower().startswith("tel:")]
    body = next((n for n in nodes if n.tag == "body"), root)
    return {
        "site_name": clean(meta.get("og:site_name")) or clean(meta.get("application-name")),
        "title": first(n for n in nodes if n.tag == "title"),
        "description": clean(meta.get("description")) or clean(meta.get("og:description")) or first(n for n in nodes if n.tag == "p"),
        "terms": terms_in(body.text(), terms),
        "emails": [clean(m) for m in mails],
        "phones": phones,
    }


def structured(text: str | None) -> object:
    """JSON of a script element; None where it cannot be read or nests too deep."""
    try:
        return json.loads(text or "")
    except (ValueError, RecursionError):
        return None


def _string(value: object) -> str:
    return value if isinstance(value, str) else ""


def _strings(value: object) -> list[str]:
    return [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, str) and x]


def ld_persons(data: object) -> Iterator[dict]:
    todo = [data]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo.extend(reversed(x))
        elif isinstance(x, dict):
            kind = x.get("@type")
            if kind == "Person" or (isinstance(kind, list) and "Person" in kind):
                yield x
            todo.extend(v for v in reversed(list(x.values())) if isinstance(v, (dict, list)))


def _is_card(n: Node) -> bool:
    return bool(n.classes() & CARD) or "Person" in n.attrs.get("itemtype", "")


def _card(el: Node) -> dict:
    inner = list(el.walk())
    name = first(n for n in inner if re.fullmatch("h[1-6]", n.tag) or n.classes() & NAME or n.attrs.get("itemprop") == "name")
    name = name or clean(el.attrs.get("aria-label") or next((n.attrs["aria-label"] for n in inner if n.attrs.get("aria-label")), ""))
    title = first(n for n in inner if n.classes() & JOB or n.attrs.get("itemprop") == "jobTitle")
    title = title or next((t for n in inner if n.tag in ("p", "span", "div") and (t := clean(n.text())) and len(t) <= 60 and _HINT.search(t)), "")
    href = lambda prefix: next((clean(n.attrs["href"][len(prefix) :]) for n in inner if n.tag == "a" and n.attrs.get("href", "").startswith(prefix)), "")
    return {"full_name": name, "title": title, "email": href("mailto:"), "phone": href("tel:"), "profile_urls": [n.attrs["href"] for n in inner if n.tag == "a" and PROFILE.search(n.attrs.get("href", ""))]}


def contact_parts(html: str | None) -> list[dict]:
    """Person candidates in order: structured data, leaf cards, mail and phone links outside cards, byline. Names are checked later, as Columns.

    Of structured data only strings count: other values are as good as absent, a list of URLs gives its strings.
    """
    nodes, out = list(parse(html).walk()), []
    for n in nodes:
        if n.tag == "script" and n.attrs.get("type") == "application/ld+json":
            people = ld_persons(structured(n.text()))
            out += [{"full_name": _string(p.get("name")), "title": _string(p.get("jobTitle")), "email": _string(p.get("email")), "phone": _string(p.get("telephone")), "profile_urls": _strings(p.get("url"))} for p in people]
    out += [_card(n) for n in nodes if _is_card(n) and not any(_is_card(x) for x in n.walk())]
    for n in nodes:
        href = n.attrs.get("href", "")
        if n.tag != "a" or not href.startswith(("mailto:", "tel:")) or any(_is_card(x) for x in n.parents()):
            continue
        person = _card(next((x for x in (n, *n.parents()) if x.tag in ("li", "p", "div", "td", "tr")), n))
        if href.startswith("mailto:"):
            person["email"] = href[7:]
        else:
            person["phone"] = person["phone"] or href[4:]
        person["full_name"] = person["full_name"] or clean(n.text())
        out.append(person)
    for css in [*BYLINE, None]:
        el = next((n for n in nodes if (css in n.classes() if css else n.attrs.get("rel") == "author" or (n.tag == "meta" and n.attrs.get("name") == "author"))), None)
        if el is None:
            continue
        text = re.sub(r"^(by|written by|author)\s*[:|-]?\s*", "", clean(el.attrs.get("content") or el.text()), flags=re.IGNORECASE)
        text = re.split(r"\d{4}", re.split(r"\s+\|\s+|\s+[–—-]\s+", text)[0])[0].strip()
        if text and len(text) <= 80 and "@" not in text:
            name, _, title = (x.strip() for x in text.partition(","))
            out.append({"full_name": name, "title": title if _HINT.search(title) else "", "email": "", "phone": "", "profile_urls": []})
            break
    return out


_COMPANY = "site_name string, title string, description string, terms array<string>, emails array<string>, phones array<string>, md_heading string, md_text string, md_terms array<string>"
_CONTACTS = "array<struct<full_name:string,title:string,email:string,phone:string,profile_urls:array<string>>>"


def markdown_udf():
    @pandas_udf("string")
    def run(html: pd.Series) -> pd.Series:
        return html.map(to_markdown)

    return run


def page_udf(terms: Sequence[str]):
    """page_fields of every page; neither its body nor its Markdown leaves the worker."""
    columns = [x.split()[0] for x in _COMPANY.split(", ")]

    @pandas_udf(_COMPANY)
    def run(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_fields(h, terms) for h in html], columns=columns)

    return run


def contacts_udf():
    @pandas_udf(_CONTACTS)
    def run(html: pd.Series) -> pd.Series:
        return html.map(contact_parts)

    return run


@udtf(returnType=_CONTACTS[len("array<struct<") : -2])
class ExtractContacts:
    """Person candidates of a page as rows, for SQL: SELECT ... FROM pages, LATERAL extract_contacts(html)."""

    def eval(self, html: str | None) -> Iterator[tuple]:
        for p in contact_parts(html):
            yield p["full_name"], p["title"], p["email"], p["phone"], p["profile_urls"]


def register(spark: SparkSession) -> None:
    """Make extract_contacts known to the session's SQL."""
    spark.udtf.register("extract_contacts", ExtractContacts)


def ld_persons_udf():
    @pandas_udf("array<string>")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda x: [_string(p.get("name")) for p in ld_persons(structured(x))])

    return run


def with_markdown(pages: DataFrame) -> DataFrame:
    return pages.withColumn("markdown", markdown_udf()(F.col("html")))
