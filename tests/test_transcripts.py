"""Character references, caption tracks and transcripts on small made-up inputs."""

import pytest
from pyspark.sql import functions as F

from docloom.sources import transcripts as S

CASES = [
    ("a &amp; b &lt;c&gt; &quot;d&quot; &apos;e&apos;", "a & b <c> \"d\" 'e'"),
    ("it&#39;s &#x41;&#x1F600;&#128512; &#233;", "it's A\U0001f600\U0001f600 é"),
    ("&amp;lt; &amp;#38;", "&lt; &#38;"),
    ("&#0000065; &#x000041;", "A A"),
    ("a & b && c &", "a & b && c &"),
    ("", ""),
    ("line\n&#10;\n&unfinished", "line\n\n\n&unfinished"),
]
UNKNOWN = ["&nbsp;", "&#0;", "&#xD800;", "&#x110000;", "&#99999999999999999999;", "&AMP;", "&#X41;"]


def test_references(spark):
    rows = spark.createDataFrame([(t, e) for t, e in CASES], "t string, e string").withColumn("got", S.resolve_entities(F.col("t"))).collect()
    assert [r["got"] for r in rows] == [r["e"] for r in rows]
    rows = spark.createDataFrame([(t,) for t in UNKNOWN[:-1]], "t string").select("t", S.resolve_entities(F.concat(F.lit("x"), "t", F.lit("y"))).alias("kept"), S.resolve_entities(F.concat(F.lit("x"), "t", F.lit("y")), keep_unknown=False).alias("gone")).collect()
    assert all(r["kept"] == f"x{r['t']}y" and r["gone"] == "xy" for r in rows)
    assert spark.range(1).select(S.resolve_entities(F.lit(None).cast("string"))).first()[0] is None


TRACK = "array<struct<url: string, language: string, kind: string>>"


@pytest.mark.parametrize(
    ("tracks", "url"),
    [
        ([("a", "en", None), ("b", "fr", "asr"), ("c", "fr", "manual")], "c"),
        ([("a", "en", None), ("b", "fr", "asr")], "b"),
        ([("a", "en", "asr"), ("b", "de", None), ("c", "en", None)], "c"),
        ([("a", "de", "asr"), ("b", "es", None), ("c", "it", None)], "b"),
        ([("a", "de", "asr"), ("b", None, "asr")], "a"),
        ([], None),
        (None, None),
    ],
)
def test_track_choice(spark, tracks, url):
    row = spark.createDataFrame([(tracks,)], f"t {TRACK}").select(S.caption_track(F.col("t"), [F.lit("fr"), F.lit("en")])["url"]).first()
    assert row[0] == url


def test_snippets(spark):
    xml = """<?xml version="1.0"?><transcript><text start="1.5" dur="2">it&#39;s <b>bold</b>&nbsp;</text><text start="x">  two\nlines </text><text/><text start="9"> &#32; </text>
<text dur='4' start='3'><!-- no -->three<![CDATA[gone]]></text><texts>other</texts></transcript>"""
    json = '{"events": [{"tStartMs": 1500, "dDurationMs": 20, "segs": [{"utf8": " a"}, {"x": 1}, {"utf8": "b\\n"}]}, {"tStartMs": 3}, {"segs": []}, {"segs": [{"utf8": " "}]}, {"segs": [{"utf8": "c"}]}]}'
    files = spark.createDataFrame([(1, xml), (2, json), (3, "{broken"), (4, ""), (5, None), (6, "<transcript><text>open"), (7, "{}")], "id int, body string")
    got = [tuple(r) for r in S.transcript_snippets(files, "id", "body").orderBy("id", "position").collect()]
    assert got == [(1, 0, 1.5, 2.0, "it's bold"), (1, 1, 0.0, 0.0, "two\nlines"), (1, 2, 3.0, 4.0, "three"), (2, 0, 1.5, 0.02, "ab"), (2, 1, 0.0, 0.0, "c")]
