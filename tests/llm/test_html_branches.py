"""Main-text extraction where names decide: one result whatever the number of pages, and the text against brute force."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import html_extract as H
from docloom.llm.url_filter import host_of

SCHEMA = "page_id bigint, url string, html string"


def page(i: int) -> str:
    return (
        f"<body><div class='story-side'>Story {i}</div><div class=sidebar>Side {i}</div><article><h1>Title {i}</h1><p>Body {i}</p>"
        f"<div class=legal><p>Law {i}</p></div><p class=search>Search {i}</p><div class='ad box'>Buy {i}</div></article><div id=cookie-notice>Cookies {i}</div></body>"
    )


@pytest.mark.parametrize("n", [1, 30, 100, 600])
def test_one_result_at_every_number_of_pages(spark, n):
    rows = spark.createDataFrame([(i, f"http://a.org/{i}", page(i)) for i in range(n)], SCHEMA)
    got = {r["page_id"]: r["text"] for r in H.extract_text(rows, names_decide=True).collect()}
    assert got == {i: f"Story {i}\nTitle {i}\nBody {i}\nLaw {i}\nSearch {i}" for i in range(n)}


def expected(rows: list[tuple[int, str, str]], hosts: dict[int, int]) -> dict[int, tuple[str, int]]:
    """Importances over all pages by their definitions, then each page's blocks in order."""
    distinct = {(hosts[i], repr(H.parse(h))): H.parse(h) for i, _, h in rows}
    texts, runs = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int))
    held = defaultdict(int)
    for (host, _), (blocks, children) in distinct.items():
        for path, text in {(p, t) for p, t, _ in blocks}:
            texts[host, path][text] += 1
        for path in {p for p, _, _ in blocks}:
            held[host, path] += 1
        for path, run in children.items():
            runs[host, path][run] += 1
    importance = {}
    for key, by in texts.items():
        m = held[key]
        importance[key] = 1 - np.mean([np.log(n) for n in by.values()]) / np.log(m) if m > 1 else 1.0
        if key in runs:
            total = sum(runs[key].values())
            importance[key] = max(importance[key], -sum(n / total * np.log(n / total) for n in runs[key].values()) / np.log(total) if total > 1 else 1.0)
    low = set()
    for host, path in importance:
        branch = path.rpartition("/")[0]
        below = [k for k in importance if k[0] == host and (k[1].startswith(branch + "/"))]
        trust = max(held[k] * importance[k] / (held[k] + H.PLAIN) for k in below) + H.PLAIN / (max(held[k] for k in below) + H.PLAIN)
        m = held[host, path]
        if importance[host, path] < 1 and (m * importance[host, path] + H.PLAIN * trust) / (m + H.PLAIN) < H.MIN_IMPORTANCE:
            low.add((host, path))
    out = {}
    for i, _, h in rows:
        blocks = [(p, t) for p, t, gone in H.parse(h)[0] if not gone]
        stay = [(p, t) for p, t in blocks if not H.named_out(p)]
        left = [t for p, t in stay if (hosts[i], p) not in low]
        out[i] = "\n".join(left or [t for _, t in stay]), sum((hosts[i], p) in low for p, _ in blocks) if left else 0
    return out


def test_text_against_brute_force(spark):
    rng = np.random.default_rng(8)

    def part(i):
        return rng.choice([
            "<div class=ad>Buy now</div>", f"<div class=teaser><p>Offer {rng.integers(3)}</p><b>more</b></div>", "<p>same</p>", f"<p>own {i}</p>",
            f"<section><p>a</p><div class=x{rng.integers(12)}><p>links</p></div></section>", f"<article><p>Text {i}</p><div class=side-by-side>Table {i}</div></article>",
        ])

    rows = [(i, f"http://s{i % 3}.org/{i}", "<body>" + "".join(part(i) for _ in range(rng.integers(1, 7)))) for i in range(240)]
    rows += [(1000 + i, f"http://s0.org/copy{i}", rows[0][2]) for i in range(5)]
    frame = spark.createDataFrame(rows, SCHEMA)
    hosts = {r["page_id"]: r["h"] for r in frame.select("page_id", F.xxhash64(host_of(F.col("url"))).alias("h")).collect()}
    wanted = expected(rows, hosts)
    assert sum(n for _, n in wanted.values()) > 100
    for sent in (1000, 0):
        got = {r["page_id"]: (r["text"], r["n_removed"]) for r in H.extract_text(frame, names_decide=True, max_sent=sent).collect()}
        assert got == wanted


def test_a_rare_node_shares_the_fate_of_its_branch(spark):
    """Links seen on three pages with one text go with a branch that is the same on all others, and stay in one with an article."""
    rows = []
    for i in range(90):
        rare = f"<p class=r{i // 3}>See {i // 3}</p>"
        rows.append((i, f"http://a.org/{i}", f"<body><div class=links><p>Home</p><p>Home</p>{rare}</div><div class=story><p>Story {i}</p>{rare}</div></body>"))
    got = {r["page_id"]: r["text"] for r in H.extract_text(spark.createDataFrame(rows, SCHEMA), names_decide=True).collect()}
    assert got == {i: f"Story {i}\nSee {i // 3}" for i in range(90)}


def test_odd_rows_where_names_decide(spark):
    rows = [(1, "http://a.org/", None), (2, None, ""), (None, "", "no markup at all"), (3, "x", "<div class=sidebar>only a side</div>"), (3, "x", "<div class=sidebar>only a side</div>")]
    got = H.extract_text(spark.createDataFrame(rows, SCHEMA).withColumn("above", F.lit(1)).withColumn("Text", F.lit(2)), names_decide=True).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got) == [(0, "no markup at all"), (1, ""), (2, ""), (3, ""), (3, "")]
    assert H.extract_text(spark.createDataFrame([], SCHEMA), names_decide=True).count() == 0
