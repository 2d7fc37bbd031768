import random

import duckdb
import pytest

from gritstone.llm import url_filter as F
from tests.llm.fixtures import clashing


def brute(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:n], rest[n:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]), len(r[1]), r[2] == "allow"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


def test_random_rules(spark):
    rng = random.Random(4)
    labels, parts = ["a", "b", "ab", "net", "com", ""], ["", "/", "/en", "/en/", "/e", "/en/x/", "/de/"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = [(host(), rng.choice(parts), rng.choice(["allow", "block"])) for _ in range(60)]
    urls = [f"http{rng.choice(['', 's'])}://{host()}{rng.choice(parts)}{rng.choice(['', '?q=/en/', '#x://y'])}" for _ in range(1500)]
    urls = [u.replace("net", "NET") if rng.random() < 0.1 else u for u in urls] + ["http://hot.a.net/en/x"] * 500 + [None, "", "no scheme/en", "://", "x://a.net"]
    pages = clashing(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").repartition(5))
    table = spark.createDataFrame(rules + rules[:5], "host string, path string, verdict string")
    got = {r["id"]: tuple(r)[1:] for r in F.filter_urls(pages, table, default="block").collect()}
    assert got == {k: brute(u, rules, "block") for k, u in enumerate(urls)}


def test_sql(spark, sf):
    got = sorted(map(tuple, F.op5(spark.read.parquet(f"{sf}/pages.parquet")).collect()))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert got == sorted(c.execute(F.OP5_SQL).fetchall())


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_empty(spark, rows):
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    assert [tuple(r) for r in F.op5(pages).collect()] == [(None, "", "", None, "allow") for _ in rows]
