"""Page cleaning and cover density against small cases."""

import random

from pyspark.sql import functions as F

from docloom.functions import cleaning as CL
from docloom.operators import retrieval as R


def test_cleaning(spark):
    cases = {
        "": "",
        "a­b​c d": "abc d",
        "![x](y.png)Text\n  https://a.b/c.jpg?w=1  \nMore": "Text\n\nMore",
        "[Home](/) > [Docs](/d)\nBody": "Body",
        "[1](a) [2](b)\nBody [3](c)": "Body 3",
        "[Episode 1 / 2\nTitle 3 min de lecture](u)Body": "Body",
        "At 0:00 / 3:21 and 12:30 Watch later•Live•": "At  and",
        "SUBSCRIBE\n\n\n\nDonate Read 5 min. read": "Read",
        "[← Back](u) π tags here\n3 épisodes": "",
        r"a\_b \\ c": "a_b  c",
        "[Alone](u)\nSee [the page](u) now\n## ** \n .\nEnd": "See the page now\n\nEnd",
        "x\n x \nx\n\n\n\n\ny\r\ny": "x\n\ny",
        "**Comment le quantique change la face du monde**\nend": "end",
    }
    rows = spark.createDataFrame(list(cases.items()), "page string, want string")
    found = rows.select("page", CL.clean_scraped(F.col("page")).alias("got"), "want").collect()
    assert [tuple(r) for r in found if r["got"] != r["want"]] == []
    assert spark.createDataFrame([(None,)], "page string").select(CL.clean_scraped(F.col("page"))).first()[0] is None


def covers(tokens, terms):
    """All windows that hold every term and of which no smaller window does."""
    n = len(tokens)
    full = lambda i, j: set(terms) <= set(tokens[i : j + 1])
    found = [(i, j) for i in range(n) for j in range(i, n) if full(i, j) and not full(i + 1, j) and not full(i, j - 1)]
    return sum(0.1 / (1 + sum(t not in terms for t in tokens[i : j + 1])) for i, j in found)


def test_cover_density(spark):
    rng = random.Random(7)
    texts = [[rng.choice("abcdefg") for _ in range(rng.randrange(0, 30))] for _ in range(60)]
    asked = [["a"], ["a", "b"], ["c", "a", "c"], ["a", "b", "c", "d"], []]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, tokens array<string>")
    questions = spark.createDataFrame(list(enumerate(asked)), "question long, tokens array<string>")
    got = {(r["question"], r["chunk_id"]): r["score"] for r in R.cover_density(chunks, questions).collect()}
    want = {(q, c): round(covers(t, a), 6) for q, a in enumerate(asked) for c, t in enumerate(texts) if a and set(a) <= set(t)}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)
