"""Page layout and Markdown splitting against plain definitions."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import chunking as CH, layout as L
from docloom.plans import layout_queries as Q

SF = "/root/testdata/sf0.001"


def test_layout_against_joined_pages(spark):
    texts = {1: ["  one \n\n two", "", None, "drei ß\n"], 2: ["", " ", "late"], 3: [None], 4: ["a", "b", "c"]}
    rows = [(k, n, t) for k, pages in texts.items() for n, t in enumerate(pages)]
    random.Random(1).shuffle(rows)
    pages = spark.createDataFrame(rows, "doc_id bigint, page bigint, text string")
    got = {r["doc_id"]: (r["text"], r["page_starts"]) for r in L.page_layouts(pages).collect()}
    for k, raw in texts.items():
        joined, starts = "", []
        for t in raw:
            joined += "\n\n" if joined else ""
            starts.append(len(joined.encode()))
            joined += "\n".join(x.strip() for x in (t or "").split("\n") if x.strip())
        assert got[k] == (joined, starts)
    assert L.page_layouts(pages.where("false")).count() == 0


def test_span_pages_cross_breaks(spark):
    spans = spark.createDataFrame([([0, 12, 20], a, b) for a, b in ((0, 12), (0, 13), (11, 21), (12, 12), (25, 30))], "s array<bigint>, a bigint, b bigint")
    first, last = L.span_pages(F.col("s"), F.col("a"), F.col("b"))
    assert [tuple(r) for r in spans.select(first, last).collect()] == [(1, 1), (1, 2), (1, 3), (2, 2), (3, 3)]


def slow_fences(text):
    """Line by line: a mark of three or more opens, one at least as long without a word after it closes."""
    out, at, opened = [], 0, None
    for line in text.splitlines(keepends=True):
        bare = line.rstrip("\n")
        inner = bare.lstrip(" ")
        mark = inner[: len(inner) - len(inner.lstrip(inner[:1]))] if inner[:1] in ("`", "~") and inner else ""
        if len(bare) - len(inner) <= 3 and len(mark) >= 3:
            rest = inner[len(mark) :]
            if opened is None:
                if mark[0] == "~" or "`" not in rest:
                    opened = (at, mark)
            elif mark[0] == opened[1][0] and len(mark) >= len(opened[1]) and not rest.strip(" \t"):
                out.append((opened[0], at + len(line)))
                opened = None
        at += len(line)
    return out + ([(opened[0], len(text))] if opened else [])


def markdown(rng):
    parts = ["# Top\n", "## Part\n\n", "#nohead\n", "words and more words here. And a sentence.\n", "\n\n", "- item one\n", "2. item two\n", "```py\n# no heading\n\n- no item\n```\n", "~~~\ncode\n\n```\n~~~\n", "````\n```\n\n````\n", "```\n", "ünï " * 30 + "\n", "x" * 90 + "\n"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))


@pytest.mark.parametrize("size", [30, 80, 300])
def test_markdown_spans(size):
    rng = random.Random(size)
    for _ in range(150):
        text = markdown(rng)
        code = CH.fences(text)
        assert code == slow_fences(text)
        found = CH.spans(text, size, levels=CH.markdown_levels(text))
        assert all(0 < b - a <= size for a, b in found) and all(b <= c for (_, b), (c, _) in zip(found, found[1:]))
        covered = {p for a, b in found for p in range(a, b)}
        assert all(c.isspace() for p, c in enumerate(text) if p not in covered)
        for a, b in code:  # a fence that fits is whole in one chunk
            while text[b - 1].isspace():
                b -= 1
            if b - a <= size:
                assert sum(c < b and d > a for c, d in found) == 1


def test_markdown_is_cut_before_headings_then_items():
    text = "# A\n\nalpha alpha\n\n## B\n\nbeta\n\n```\n# not one\n\nx\n```\n\n# C\n\n- one one\n- two two\n- three"
    cut = lambda size: [text[a:b] for a, b in CH.spans(text, size, levels=CH.markdown_levels(text))]
    assert cut(60) == ["# A\n\nalpha alpha\n\n## B\n\nbeta\n\n```\n# not one\n\nx\n```", "# C\n\n- one one\n- two two\n- three"]
    assert cut(40) == ["# A\n\nalpha alpha", "## B\n\nbeta\n\n```\n# not one\n\nx\n```", "# C\n\n- one one\n- two two\n- three"]
    assert cut(20) == ["# A\n\nalpha alpha", "## B\n\nbeta", "```\n# not one\n\nx\n```", "# C", "- one one\n- two two", "- three"]


def test_source_chunks_by_type(spark):
    layouts = {r["doc_id"]: r for r in L.page_layouts(Q.pages(spark, SF), markdown=Q.kind().isin(*CH.MARKDOWN_TYPES)).collect()}
    found = Q.i2(spark, SF).collect()
    assert {r["doc_id"] for r in found} == {k for k, r in layouts.items() if r["text"].strip()}
    for r in found:
        raw, starts = layouts[r["doc_id"]]["text"].encode(), layouts[r["doc_id"]]["page_starts"]
        assert raw[r["start"] : r["end"]].decode() == r["content"]
        assert r["parent_start"] <= r["start"] < r["end"] <= r["parent_end"]
        assert len(raw[r["parent_start"] : r["parent_end"]].decode()) <= (2048 if r["kind"] in ("markdown", "docx") else 1024)
        pages = [n for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(raw) + 1]), 1) if a < r["end"] and b > r["start"]]
        assert (r["first_page"], r["last_page"]) == ((pages[0], pages[-1]) if r["kind"] == "pdf" else (None, None))
