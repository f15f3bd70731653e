"""The crawl as joins against a plain loop, the stream against the joins, timers, robots rules."""

import random
import time

import pytest
from pyspark.sql import functions as F

from orecart.session import shared_folder
from orecart.streaming import crawl as C

ROBOTS = "User-agent: other\nDisallow: /\n\nuser-agent: *  # all\nUser-Agent: x\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\nDisallow:\nSitemap: https://a/b.xml\n\nUser-agent: y\nDisallow: /z"


def corpus():
    rnd = random.Random(3)
    urls = [f"https://d{d}.com/{rnd.choice(['', 'private/', 'private/open/'])}p{i}{rnd.choice(['', '.pdf', '.pdf?x=1'])}" for d in range(6) for i in range(14)]
    status = {u: rnd.choice([200, 200, 200, 200, 500, 403]) for u in urls if rnd.random() < 0.9}
    domain = lambda u: u.split("/")[2]
    links = [(u, v, domain(v), rnd.randint(0, 3)) for u in urls for v in rnd.sample(urls, 25)]
    seeds = [(domain(u), u, i) for i, u in enumerate(urls) if u.split("/p")[-1][0] in "01" or "p2" in u]
    return status, links, [*seeds, seeds[0], (None, "https://x.com/", 1), ("d0.com", None, 1)]


def may(url):
    path = "/" + url.split("/", 3)[3]
    rules = [(8, False, path.startswith("/private")), (13, True, path.startswith("/private/open")), (7, False, path.endswith(".pdf"))]
    return max(((n, a) for n, a, hit in rules if hit), default=(0, True))[1]


def slow(status, links, seeds, depth, most):
    done, asked = {}, [(d, u, p) for d, u, p in seeds if d and u]
    for level in range(depth + 1):
        fresh = {}
        for d, u, p in asked:
            if (d, u) not in done and may(u):
                fresh[d, u] = min(p, fresh.get((d, u), p))
        taken = []
        for (d, u), _ in sorted(fresh.items(), key=lambda x: (x[1], x[0][1])):
            if sum(k[0] == d for k in done) < most:
                s = status.get(u)
                done[d, u] = (level, "done" if s == 200 else "blocked", 0 if s == 200 else 1 if s == 403 else 3)
                taken.append((d, u))
        asked = [(d, v, p) for d, u in taken if status.get(u) == 200 for s, v, to, p in links if s == u and to == d]
    return done


@pytest.fixture(scope="module")
def frames(spark):
    status, links, seeds = corpus()
    return (
        spark.createDataFrame(list(status.items()), "url string, status int"),
        spark.createDataFrame(links, "src string, url string, domain string, priority long"),
        spark.createDataFrame(seeds, "domain string, url string, priority long"),
        C.robots_rules(spark.createDataFrame([(f"d{d}.com", ROBOTS) for d in range(6)] + [("e.com", None)], "domain string, text string")),
    )


def held(df):
    return {(r.domain, r.url): (r.depth, r.state, r.attempts) for r in df.collect()}


@pytest.mark.parametrize(("depth", "most"), [(0, 8), (1, 4), (2, 8), (3, 100)])
def test_levels_equal_a_plain_loop(frames, depth, most):
    assert held(C.crawl(*frames, max_depth=depth, per_domain=most)) == slow(*corpus(), depth, most)


def test_robots_rules(spark, frames):
    rules = {(r.allow, r.pattern) for r in frames[3].where("domain = 'd1.com'").collect()}
    assert rules == {(False, "/private"), (True, "/private/open"), (False, "/*.pdf$")}
    asked = spark.createDataFrame([("d1.com", u) for u in ("https://d1.com", "https://d1.com/private/x", "https://d1.com/private/open/x", "https://d1.com/a.pdf", "https://d1.com/a.pdf?b", "https://d1.com/z")] + [("free.com", "https://free.com/private")], "domain string, url string")
    assert {r.url for r in C.allowed(asked, frames[3]).collect()} == {"https://d1.com", "https://d1.com/private/open/x", "https://d1.com/a.pdf?b", "https://d1.com/z", "https://free.com/private"}


def test_the_stream_equals_the_levels_and_its_timers_fire(spark, frames):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = shared_folder(spark)
    want = {k: v for k, v in slow(*corpus(), 1, 5).items()}
    assert any(n == 3 for _, _, n in want.values())  # these need two timers each
    query = C.crawl_stream(spark, *frames, folder, max_depth=1, per_domain=5, delay_ms=0, backoff_ms=50)
    try:
        got, end = {}, time.time() + 150
        while len(got) < len(want) and time.time() < end:
            time.sleep(2)
            assert query.exception() is None
            try:
                got = held(spark.read.option("recursiveFileLookup", "true").schema("domain string, url string, depth int, state string, attempts int").parquet(f"{folder}/done"))
            except Exception as e:  # noqa: BLE001 no batch has ended yet
                assert "PATH_NOT_FOUND" in str(e) or "FAILED_READ_FILE" in str(e)
    finally:
        query.stop()
    assert got == want


def test_empty_tables(spark, frames):
    none = [f.limit(0) for f in frames]
    assert C.crawl(*none).count() == 0
    assert {v[1] for v in held(C.crawl(none[0], none[1], frames[2], frames[3])).values()} == {"blocked"}
    assert frames[0].select(F.count("*")).first()[0] > 0
