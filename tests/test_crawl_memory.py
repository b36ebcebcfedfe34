import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from findling.functions import urls
from findling.operators import memory
from findling.sources import crawl


@pytest.mark.parametrize(
    ("base", "href", "want"),
    [
        ("http://a.b/x/y?q=1", "/z#top", "http://a.b/z"), ("http://a.b/x/y", "z", "http://a.b/x/z"), ("http://a.b/x/y", "../z", "http://a.b/z"),
        ("http://a.b/x/y/w", "./../z/.", "http://a.b/x/z/"), ("http://a.b", "z", "http://a.b/z"), ("https://a.b/x", "//c.d/e", "https://c.d/e"), ("http://a.b/x?p=1", "?p=2", "http://a.b/x?p=2"),
        ("http://a.b/x", "../../..", "http://a.b/"), ("http://a.b/x", "mailto:me@a.b", None), ("http://a.b/x", "#top", None), ("http://a.b/x", "", None), ("http://a.b/x", None, None), ("http://a.b/x", "http://c.d", "http://c.d"),
    ],
)
def test_resolve(spark, base, href, want):
    rows = spark.createDataFrame([(base, href)], "b string, h string")
    assert rows.select(urls.resolve(F.col("b"), F.col("h"))).first()[0] == want


def test_page_links(spark):
    html = """<a href="/b">1</a><A class=x  HREF = '/c#p'>2</A><link href="/style"><a data-href="/no">3</a><a href="/b">4</a><a href="//">5</a><a href='q"'>6</a>"""
    pages = spark.createDataFrame([("http://s.t/a#x", html), (None, html), ("http://s.t/e", None), ("http://s.t/l", "<a " * 200_000)], "url string, html string")
    got = [tuple(r) for r in crawl.page_links(pages).orderBy("position").collect()]
    assert got == [("http://s.t/a", "http://s.t/b", 0), ("http://s.t/a", "http://s.t/c", 1), ("http://s.t/a", 'http://s.t/q"', 4)]


def plain(links, start, depth, most, scope):
    order, ways = {start: 0}, {}
    for src, dst, position in sorted(links, key=lambda r: (r[2], r[1])):
        if dst.startswith(scope):
            ways.setdefault(src, []).append(dst)
    queue = deque([start])
    while queue:
        at = queue.popleft()
        if order[at] == depth:
            continue
        for dst in ways.get(at, ()):
            if dst not in order and len(order) < most:
                order[dst] = order[at] + 1
                queue.append(dst)
    return list(order.items())


@pytest.mark.parametrize("most", [1, 7, 30, 10_000])
def test_crawl_is_a_plain_search(spark, most):
    draw = random.Random(most)
    links = {(f"http://s/{draw.randrange(60)}", f"http://{draw.choice('sst')}/{draw.randrange(60)}"): draw.randrange(5) for _ in range(180)}
    rows = [(a, b, p) for (a, b), p in links.items()]
    df = spark.createDataFrame(rows, "src string, dst string, position int")
    got = crawl.crawl(df, "http://s/0", 4, most).orderBy("place").collect()
    want = plain(rows, "http://s/0", 4, most, "http://s/")
    assert [(r["url"], r["depth"]) for r in got] == want and [r["place"] for r in got] == list(range(len(want)))
    if most == 10_000:
        assert {(r["url"], r["depth"]) for r in crawl.crawl(df, "http://s/0", 4).collect()} == set(want)


def test_crawl_of_nothing(spark):
    none = spark.createDataFrame([], "src string, dst string, position int")
    assert [tuple(r) for r in crawl.crawl(none, "http://s/a/b", 3, 5).collect()] == [("http://s/a/b", 0, 0)]
    with pytest.raises(ValueError):
        crawl.crawl(none, "http://s/", 3, 0)
    assert crawl.scope_of("http://s/a/b") == "http://s/a" and crawl.scope_of("http://s") == "http://s"


HELD = [("u", 1, "likes tea", [1.0, 0.0]), ("u", 2, "lives in Rome", [0.0, 1.0]), ("v", 3, "likes tea", [1.0, 0.0]), ("u", 4, "empty", None), (None, 5, "nobody's", [1.0, 0.0])]
HELD_SCHEMA, FACT_SCHEMA = "user_id string, memory_id long, content string, embedding array<double>", "user_id string, fact_id long, content string, embedding array<double>, forget boolean"


def test_memory_adds_replaces_and_removes(spark):
    facts = [
        ("u", 11, "likes coffee", [1.0, 0.05], False), ("u", 12, "likes cocoa", [1.0, 0.1], None), ("u", 13, "lives in Rome", [0.0, 2.0], False), ("u", 14, "has a cat", [-1.0, 0.0], False),
        ("u", 15, "has a cat", [-1.0, 0.0], False), ("u", 16, "a bird", [-1.0, -1.0], True), ("v", 17, "tea", [1.0, 0.0], True), ("w", 18, "new here", [1.0, 0.0], False), (None, 19, "x", [1.0, 0.0], False),
        ("u", 20, "no vector", None, False), ("u", 21, None, [0.0, 0.0], False),
    ]
    held, new = spark.createDataFrame(HELD, HELD_SCHEMA), spark.createDataFrame(facts, FACT_SCHEMA)
    acts = {r["fact_id"]: (r["action"], r["memory_id"]) for r in memory.decide(held, new, 0.9).collect()}
    assert acts == {11: ("NONE", 1), 12: ("UPDATE", 1), 13: ("NONE", 2), 14: ("ADD", None), 15: ("NONE", None), 16: ("NONE", None), 17: ("DELETE", 3), 18: ("ADD", None), 20: ("ADD", None), 21: ("ADD", None)}
    after = memory.remember(held, new, 0.9)
    assert {(r["user_id"], r["memory_id"], r["content"]) for r in after.collect()} == {
        ("u", 1, "likes cocoa"), ("u", 2, "lives in Rome"), ("u", 4, "empty"), (None, 5, "nobody's"), ("u", 14, "has a cat"), ("w", 18, "new here"), ("u", 20, "no vector"), ("u", 21, None),
    }
    assert [r["memory_id"] for r in memory.recall(after, "u", [1.0, 0.1], 1).collect()] == [1]
    assert memory.forget_user(after, "u").count() == 2
    # The same facts once more change nothing but what they can't know.
    assert {r["action"] for r in memory.decide(after, new.filter("fact_id IN (12, 13, 14)"), 0.9).collect()} == {"NONE"}
    assert memory.decide(held.limit(0), new, 0.9).filter("action = 'ADD'").count() == 7
    assert memory.remember(held, new.limit(0), 0.9).count() == len(HELD)


def test_memories_of_a_large_user_are_met_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(memory, "BLOCK", 7)
    rng = np.random.default_rng(3)
    users = ["hot"] * 60 + ["a", "b"] * 5
    held = [(u, i, str(i), list(map(float, rng.integers(-2, 3, 3)))) for i, u in enumerate(users)]
    facts = [(u, 1000 + i, str(i), list(map(float, rng.integers(-2, 3, 3))), False) for i, u in enumerate(users)]
    got = {r[0]: (r[1], round(r[2], 6)) for r in memory.nearest_memories(spark.createDataFrame(held, HELD_SCHEMA), spark.createDataFrame(facts, FACT_SCHEMA), 0.8).collect()}
    want = {}
    for u, f, _, x, _ in facts:
        near = [(-round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 9), m) for w, m, _, y in held if w == u and any(x) and any(y)]
        if near and -min(near)[0] >= 0.8:
            want[f] = (min(near)[1], round(-min(near)[0], 6))
    assert got == want
