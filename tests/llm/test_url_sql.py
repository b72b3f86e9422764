"""The URL filter beside its SQL on pages whose hosts link: hubs, chains, circles and hosts without pages."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from oracle_check import compare
from placewise.llm import url_filter

COLUMNS = ["page_id", "host", "path", "rule", "verdict"]


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", 0.5) for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string, host string, rule string, trust double")


def link(*urls):
    return " ".join(f'<a href="{u}">' for u in urls)


def graph():
    """A hub of blocked pages, a chain into it, a circle, trusted linkers, uncrawled hosts, and random links."""
    rng = random.Random(7)
    rows = [("http://bad.net/es/1", link("http://c0.org/")), ("http://bad.net/en/", ""), ("http://worse.net/fr/", link("http://bad.net/es/1"))]
    rows += [(f"http://fan{i}.org/p", link("http://bad.net/es/1", *["http://fine.org/"] * (i % 2))) for i in range(20)]
    rows += [(f"http://c{i}.org/", link(f"http://c{i + 1}.org/")) for i in range(14)] + [("http://c14.org/", link("http://worse.net/fr/"))]
    rows += [("http://ring1.org/", link("http://ring2.org/")), ("http://ring2.org/", link("http://ring1.org/", "http://gone.net/es/"))]
    rows += [("http://shop.com/", link("http://friend.org/")), ("http://friend.org/", link("//gone.net/fr/x", "http://Gone.net/ok")), ("http://example.com/en/2", link("http://c3.org/"))]
    hosts = [f"r{i}.{t}" for i in range(15) for t in ("org", "net", "com")]
    for _ in range(120):
        url = f"http://{rng.choice(hosts)}/{rng.choice(['es', 'fr', 'en'])}/{rng.randint(0, 3)}"
        rows.append((url, link(*(f"http://{rng.choice(hosts)}/{rng.choice(['es/', 'en/', ''])}" for _ in range(rng.randint(0, 4))))))
    return rows + [(None, link("http://bad.net/es/")), ("nonsense", None), ("http://fan1.org/p", None)]


@pytest.fixture(scope="module")
def made(spark):
    pages = pages_of(spark, graph())
    return pages, url_filter.judged(pages, url_filter.rule_table(spark))


def test_equals_its_sql(spark, made):
    pages, found = made
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url", "html").toArrow())
    assert compare(found.select(*COLUMNS), con, url_filter.OP5_SQL) == ""
    rows = {r.host: r for r in found.collect()}
    assert rows["fan0.org"].verdict == "block" and rows["fan1.org"].verdict == "allow" and rows["c14.org"].verdict == "block"
    verdicts = {h: r.verdict for h, r in rows.items() if r.rule is None}
    assert set(verdicts.values()) == {"allow", "block"}


def test_the_sql_tells_other_methods_apart(spark, made, monkeypatch):
    """With another damping the code's verdicts leave the SQL."""
    pages, _ = made
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url", "html").toArrow())
    monkeypatch.setattr(url_filter, "LEAST", 0.0001)
    assert compare(url_filter.judged(pages, url_filter.rule_table(spark)).select(*COLUMNS), con, url_filter.OP5_SQL) != ""


def test_odd_pages(spark):
    rules = url_filter.rule_table(spark)
    long_host = "a." * 30000 + "net"
    found = url_filter.judged(pages_of(spark, [(f"http://{long_host}/es/", None), ("http://" + "b" * 50000, ""), ("http://x.com/", "word " * 50000)]), rules).collect()
    assert {(r.rule, r.verdict) for r in found} == {("net/es/", "block"), (None, "allow"), ("com/", "allow")}
    assert url_filter.judged(pages_of(spark, graph()).limit(0), rules).count() == 0
    assert url_filter.judged(pages_of(spark, [("http://x.net/es/", None)]), rules.where(F.lit(False))).first().verdict == "allow"
