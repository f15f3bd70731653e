"""Queries against their SQL on small tables with the rows that larger tables bring."""

import duckdb
import pytest

from orecart.functions import html as H
from orecart.plans import queries as Q


@pytest.fixture()
def same(spark, tmp_path):
    """Writes the tables, runs a query and its SQL, returns the rows of both."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, (schema, rows) in tables.items():
            path = str(tmp_path / f"{table}.parquet")
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
        done = con.execute(Q.ORACLE_SQL[name])
        names = [c[0] for c in done.description]
        return sorted((tuple(r[n] for n in names) for r in Q.QUERIES[name](spark, str(tmp_path)).collect()), key=repr), sorted(done.fetchall(), key=repr)

    return run


TITLES = ["ores&&&amp", "ores &amp; &copy; &middot; oil", 'token = &quot;73ab&quot;', "&amp;copy; &lt;b&gt; &#65;&#x42; &eacute;", "&copy 2020", "R&D &", "&amp;amp;"]
HREFS = ["/a", "/a?x=1&y=2", "/a?x=1&amp;y=2&copy;&quot;&z", "&", "/a?copy=1&copy=2"]


def test_entities_in_titles_and_links(same):
    pages = [(i, f"https://firm{i}.com/", f'<html><head><title>{t}</title></head><body><p>{t}</p><a href="{h}">to {t}</a> <a href="/b">b</a></body></html>') for i, (t, h) in enumerate((t, h) for t in TITLES for h in HREFS)]
    got, want = same("html_markdown", pages=("page_id long, url string, html string", pages))
    assert got == want and len(got) == len(TITLES) * len(HREFS)


def test_markdown_itself_decodes_every_entity():
    assert H.to_markdown('<title>a &quot;b&quot; &amp</title><a href="/a?x=1&amp;y=2">c&nbsp;&eacute;</a>') == '# a "b" &\n[c é](/a?x=1&y=2)'


def test_best_company_where_keys_outweigh_cents(same):
    customers = [(1, 3, 99.99), (200_000, 3, 100.0), (7, 4, -5.0), (8, 4, -5.0), (900_000, 5, 50.0), (2, 5, 49.0)]
    orders = [(10 + i, k, 1000.0 + i // 2) for i, k in enumerate([1, 200_000, 200_000, 1, 1, 1, 200_000, 900_000])]
    tables = {"customer": ("c_custkey long, c_nationkey int, c_acctbal double", customers), "orders": ("o_orderkey long, o_custkey long, o_totalprice double", orders)}
    got, want = same("report_top5", **tables)
    assert len(want) == 7 and (3, 1, 100.0) in {x[:3] for x in want}
    assert got == want
