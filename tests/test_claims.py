"""Numbers, claim support and code spans against tables of cases."""

import re

import pytest
from pyspark.sql import functions as F

from docloom.functions import claims as C

NUMBERS = {
    ".5 -0,25": ["0.5", "-0.25"], "0.5 -0.25": ["0.5", "-0.25"], "1,001.500": ["1001.5"], "1001.5": ["1001.5"], "1,001": ["1.001"], "1 001": ["1001"], "1.002": ["1.002"],
    "1,234,567": ["1234567"], "1.234.567,89": ["1234567.89"], "12'345.6": ["12345.6"], "1_000": ["1000"], "007": ["7"], "-0": ["0"], "+5": ["5"], "-5": ["-5"], "5-3": ["5", "3"],
    "--5": ["-5"], "1,2,3": ["literal:1,2,3"], "12,34,567": ["literal:12,34,567"], "-1.2.3": ["literal:-1.2.3"], "1234,567": ["1234.567"], "0.000": ["0"], "-0.5": ["-0.5"], "3.": ["3"], "a1b22": ["1", "22"], "5..5": ["5", "0.5"], "10 20": ["literal:10 20"],
    "one hundred and twenty three": ["123"], "two thousand and five": ["2005"], "a dozen eggs": ["12"], "three dozen": ["36"], "quatre vingt dix sept": ["97"], "quatre": ["4"], "deux cent mille": ["200000"], "soixante et onze": ["71"],
    "four score and seven": ["87"], "one and then two": ["1", "2"], "one and 5": ["5", "1"], "million": ["1000000"], "five billion trillion": ["1005000000000"], "1\u00a0001\u202f002": ["1001002"], "million trillion trillion trillion zero": ["3000001000000"], " ".join(["hundred"] * 12): [], "and one": ["1"], "twenty one of two": ["21", "2"], "zero": ["0"], "Thirty-Two": ["32"], "": [], "no number": [],
}


def test_number_values(spark):
    df = spark.createDataFrame([(k,) for k in NUMBERS] + [(None,)], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", C.number_values(F.col("t")).alias("v")).collect()}
    assert got.pop(None) is None
    assert {k: v for k, v in got.items() if v != NUMBERS[k]} == {}


SUPPORT = [
    ("The retry budget is four attempts", "The retry budget is four attempts before the job fails.", True),
    ("The retry budget is five attempts", "The retry budget is four attempts before the job fails.", False),
    ("The retry budget is 5 attempts", "The retry budget is four attempts before the job fails.", False),
    ("The retry budget is 4 attempts", "The retry budget is four attempts before the job fails.", True),
    ("The temperature is -5 degrees", "The temperature is 5 degrees during the test.", False),
    ("The temperature is -5 degrees", "The temperature is -5 degrees during the test.", True),
    ("The retry budget is 1,001 attempts", "The retry budget is 1,002 attempts before failure.", False),
    ("The retry budget is 1001 attempts", "The retry budget is 1 001 attempts before failure.", True),
    ("The retry budget is 1001 attempts", "The retry budget is 1,001 attempts before failure.", False),
    ("The retry budget is a dozen attempts", "The retry budget is thirteen attempts before failure.", False),
    ("The job does not fail after four attempts", "The retry budget is four attempts before the job fails.", False),
    ("The service stores retry budget while database replication permanently changes unrelated ownership semantics", "The service stores retry budget policy in a queue.", False),
    ("four", "four", False),
    ("", "anything", False),
    ("It cannot be seen", "It cannot be seen", True),
]


def test_claim_support(spark):
    df = spark.createDataFrame(SUPPORT, "claim string, evidence string, want boolean")
    assert [tuple(r) for r in df.where(C.supported(F.col("claim"), F.col("evidence")) != F.col("want")).collect()] == []


@pytest.mark.parametrize("text", ["before `code [0] here` after", "é `x` ```\ncode [1]\n```\nafter [2]", "```python\nopen [1]", "``", "````\na\n```` b `c", "a ` b", "```x``` y\n```\nz", "", "```\n```", "`a``b`", "x ``` y"])
def test_code_ranges(spark, text):
    data, i, want = text.encode(), 0, []
    while i < len(data):  # byte by byte
        if data[i : i + 3] == b"```":
            line = data.find(b"\n", i)
            close = data.find(b"\n```", line) if line >= 0 else -1
            end = len(data) if close < 0 else data.find(b"\n", close + 1)
            end = len(data) if end < 0 else end
        elif data[i : i + 1] == b"`":
            end = data.find(b"`", i + 1) + 1 or len(data)
        else:
            i += 1
            continue
        want.append((i, end))
        i = end
    got = spark.createDataFrame([(text,)], "t string").select(C.code_ranges(F.col("t")).alias("r")).first()["r"]
    assert [tuple(x) for x in got] == want
    assert re.sub(C.CODE, "", text).encode() == b"".join(data[a:b] for a, b in zip([0, *(e for _, e in want)], [*(s for s, _ in want), len(data)], strict=True))


def test_span_ownership(spark):
    rows = [(0, 0, 0, 4, None, None, True), (0, 0, 120, 124, 4, 5, True), (0, 0, 900, 100, None, None, False), (0, 0, 0, 4, 7, 3, False), (0, 0, 0, 4, None, 3, False), (0, 0, None, None, None, None, False), (0, 0, 100, 105, None, None, False), (1, 0, 0, 4, None, None, False), (0, None, 0, 4, 1, None, False)]
    df = spark.createDataFrame(rows, "chunk int, position int, start int, stop int, page int, last int, want boolean")
    own = C.owns_chunk(*[F.col(c) for c in ("chunk", "position", "start", "stop", "page", "last")], F.lit("text"))
    assert df.where(own != F.col("want")).count() == 0
