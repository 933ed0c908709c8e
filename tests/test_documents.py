"""Readers, chunker, citations and index against small made-up inputs and properties."""

import io
import zipfile

import pyarrow as pa
import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions.batches import portions
from docloom.functions import chunking as CH, citations as CI, claims as CL, text as X
from docloom.operators import ann, retrieval as R
from docloom.plans import document_queries, registry  # noqa: F401
from docloom.sources import extract as S

SF = "/root/testdata/sf0.01"


def pack(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/").replace("_", "."), body)
    return out.getvalue()


def test_docx_epub_and_broken_files(spark):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    docx = pack(word__document_xml=f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t><w:t>text</w:t></w:r></w:p></w:body></w:document>')
    epub = pack(**{"META-INF__container_xml": '<c><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></c>', "OPS__p_opf": '<package><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>', "OPS__a_xhtml": "<html><body><h1>A</h1><p>one</p></body></html>", "OPS__b_xhtml": "<body><p>two &amp; three</p></body>"})
    files = spark.createDataFrame([("d", bytearray(docx)), ("x", bytearray(b"no zip"))], "path string, content binary")
    got = {r["path"]: r for r in S.extract(files, S.docx_text).collect()}
    assert got["d"]["text"] == "## Head\n\nSome text" and got["x"]["text"] is None and "BadZipFile" in got["x"]["error"]
    assert S.epub_text(epub) == "two & three\n\n---\n\n# A\none"


@pytest.mark.parametrize("size", [40, 256, 1024])
def test_spans_cover_all_but_white_space(spark, size):
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect():
        text = r["text"]
        found = CH.spans(text, size)
        assert all(0 < b - a <= size for a, b in found)
        assert all(b <= c for (_, b), (c, _) in zip(found, found[1:]))
        assert "".join(text[a:b] for a, b in found).replace(" ", "").replace("\n", "") == "".join(text.split())
        for _, a, b, c, d in CH.chunk_text(text, 1024):
            assert a <= c < d <= b and d - c <= CH.CHILD


def test_no_span_violations(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert CH.span_violations(docs, CH.chunk_documents(docs)).isEmpty()
    planted = docs.where(r"doc_id % 50 = 7 AND text RLIKE '\\S'").count()
    assert registry.QUERIES["i8_span_violations"](spark, SF).count() == planted > 0


def test_index_recall(spark):
    rows = registry.QUERIES["r28_ann_benchmark"](spark, SF).collect()
    assert [r["selectivity"] for r in sorted(rows, reverse=True)] == [1, 0.1, 0.01]
    assert all(r["hits"] == r["expected"] == r["returned"] and r["misplaced"] == 0 and r["under_fifth"] for r in rows)


def test_hash_embedding_is_unit_length():
    assert abs(sum(x * x for x in ann.hash_embedding("Some words, some more")) - 1) < 1e-9
    assert not any(ann.hash_embedding(None))


def test_filtered_search_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, [float(x) for x in rng.normal(size=33) + (i % 5)]) for i in range(900)] + [(900, 0, None), (901, 5, [0.0] * 33), (902, None, [1.0] * 33)]
    rows += [(1000 + i, 1, rows[1][2]) for i in range(30)]  # ties
    vectors = spark.createDataFrame(rows, "chunk_id bigint, scope bigint, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, s, rows[i][2]) for i, s in ((1, 1), (2, 2), (7, 0), (8, 5), (9, 77), (900, 0))], "question bigint, scope bigint, embedding array<double>")
    found, work = ann.filtered_search(ann.encode(vectors), vectors, asked, 7)
    exact = R.dense_topk(vectors, asked, 7)
    assert sorted(map(tuple, found.select("question", "chunk_id", "rank").collect())) == sorted(map(tuple, exact.select("question", "chunk_id", "rank").collect()))
    read = {r["question"]: r["read"] for r in work.collect()}
    assert read[2] < 250 and read[7] < 250 and read[8] == 1 and 9 not in read


def test_markers_and_support(spark):
    row = spark.range(1).select(CI.markers(F.lit("a [2] `[3]` [2][9] [1]"), F.lit(4)).alias("m"), CL.supported(F.lit("It grew 12 percent quickly"), F.lit("It quickly grew by 12 percent")).alias("s"), CL.supported(F.lit("It never grew"), F.lit("It grew")).alias("n")).first()
    assert (row["m"], row["s"], row["n"]) == ([2, 1], True, False)


def test_transcript_sections(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 59, "b"), (1, 61, "c"), (1, 6100, "d")], "k int, start int, text string")
    assert S.transcript_sections(rows, "k").first()["markdown"] == "## [00:00]\n[00:00] a\n[00:59] b\n\n## [01:01]\n[01:01] c\n\n## [101:40]\n[101:40] d"


def test_video_ids(spark):
    urls = {"https://www.youtube.com/watch?v=abcdefghijk&t=1": "abcdefghijk", "https://youtu.be/abcdefghijk": "abcdefghijk", "https://m.youtube.com/shorts/abcdefghijk/x": "abcdefghijk", "https://youtube.com/watch?v=short": None, "https://example.com/watch?v=abcdefghijk": None}
    got = {r["u"]: r["v"] for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", X.video_id(F.col("u")).alias("v")).collect()}
    assert got == urls


def test_transcripts_hold_whole_turns(spark):
    from docloom.plans import document_queries  # noqa: F401
    from docloom.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    made = {r["conv_id"]: r["markdown"] for r in QUERIES["s12_transcript_sections"](spark, sf).collect()}
    turns = spark.read.parquet(f"{sf}/conversations.parquet").where("text IS NOT NULL").collect()
    assert all(r["text"] in made[r["conv_id"]] for r in turns if made[r["conv_id"]] is not None)


def test_texts_are_cut_in_portions_of_a_bounded_size(spark):
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(["one two. " * 100] * 399 + ["x" * 50_000])], names=["key", "text"])
    parts = list(portions(batch, "text", 20_000))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert all(p.column("text").nbytes <= 25_000 or p.num_rows == 1 for p in parts[:-1]) and len(parts) > 20
    docs = spark.createDataFrame([(i, f"{i} some words. " * 200) for i in range(600)], "doc_id bigint, text string").coalesce(1)
    one = {(r.doc_id, r.chunk_index, r.content) for r in CH.chunk_documents(docs.where("doc_id < 3")).collect()}
    assert one == {(r.doc_id, r.chunk_index, r.content) for r in CH.chunk_documents(docs).where("doc_id < 3").collect()}
    assert CH.chunk_documents(docs).select("doc_id").distinct().count() == 600
