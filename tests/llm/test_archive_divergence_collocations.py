"""WARC archives, the source divergence audit and collocation mining, on odd and planted rows."""

import hashlib
import io
import struct
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import Row, functions as F

from docloom.llm import collocations, divergence, warc_archive
from docloom.llm.common import SMALL_ROWS, lookup, scratch, shared_dir

PAGE = "page_id bigint, url string, html string"
BODY = "<html><body>" + "one page that many urls serve " * 8 + "</body></html>"


def archived(spark, rows, **columns):
    pages = spark.createDataFrame(rows, PAGE).withColumns(columns)
    index = warc_archive.write_archives(pages, shared_dir(spark))
    return index, warc_archive.read_archives(index).collect()


def by_sql(spark, sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.sql(sql)


def test_archives_round_trip(spark):
    rows = [(4, "http://a/4", BODY), (2, "http://a/b c\r\n%41", BODY), (7, None, BODY), (5, "http://a/5", None), (6, "", ""), (8, "http://a/8", "short"), (9, "u", "short"), (None, "n", BODY), (2, "http://a/2", BODY), (3, "z", "\0é\U0001f600\r\n\r\nWARC/1.1\r\n" * 9), (1, "big", "x" * 3_000_000), (11, "long", "<p>" + "y z " * 200_000)]
    index, found = archived(spark, rows, path=F.lit("clash"), digest=F.lit("clash"), row=F.lit("clash"), order=F.lit("clash"))
    assert len(found) == len(rows) == index.count()
    payload = {(r[0], (r[2] or "").encode()) for r in rows}
    assert {(None if r.page_id is None else int(r.page_id), r.payload) for r in found if r.record_type == "response"} <= payload
    assert sorted(r.url or "" for r in found) == sorted(r[1] or "" for r in rows)
    same = [r for r in found if r.payload_digest == hashlib.sha256(BODY.encode()).hexdigest()]
    assert Counter((r.record_type, r.page_id, r.refers_to) for r in same) == Counter({("response", "2", None): 1, ("revisit", "2", "2"): 1, ("revisit", "4", "2"): 1, ("revisit", "7", "2"): 1, ("revisit", None, "2"): 1})
    assert all(r.payload_bytes == len(BODY.encode()) for r in same)
    assert sum(r.record_type == "response" for r in found) == len(rows) - 4
    assert len({r.record_id for r in found}) == len(rows)


def test_archives_agree_with_sql(spark):
    rows = [(i % 90, f"http://h/{i}", BODY if i % 3 == 0 else f"{BODY}{i % 40}" if i % 3 == 1 else "tiny" * (i % 5)) for i in range(300)]
    pages = spark.createDataFrame(rows, PAGE)
    index = warc_archive.write_archives(pages, shared_dir(spark))
    found = warc_archive.read_archives(index, with_payload=False).select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, by_sql(spark, warc_archive.OP11_SQL, pages=pages).fetchall()))


def test_archive_has_a_leading_dictionary_and_single_records(spark):
    rows = [(i, f"http://h/{i}", f"<html><body>{'menu of the site and its many links ' * 20}<p>{hashlib.sha256(str(i).encode()).hexdigest()}</p></body></html>") for i in range(800)]
    index, found = archived(spark, rows)
    path = index.first().path
    data = open(path.removeprefix("file:"), "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    trained = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    assert trained[:4] == struct.pack("<I", 0xEC30A437)
    for row in index.where(F.col("path") == path).limit(5).collect():
        headers, block = warc_archive.read_record(row.path, row.offset, row.length)
        assert headers["warc-record-id"] == f"<{row.record_id}>"
        assert hashlib.sha256(block.partition(b"\r\n\r\n")[2]).hexdigest() == headers["warc-payload-digest"].removeprefix("sha256:")
    bare = [zstandard.ZstdCompressor(level=warc_archive.LEVEL).compress(warc_archive.record("response", r.record_id, r.url, r.payload_digest, r.payload_bytes, r.payload, "1970-01-01T00:00:00Z")) for r in found]
    assert sum(r.length for r in index.collect()) + size < 0.7 * sum(map(len, bare))


def test_damaged_archives_are_refused():
    good = warc_archive.record("response", "urn:docloom:1:" + "0" * 64, None, "0" * 64, 3, b"abc", "1970-01-01T00:00:00Z")
    ((headers, block),) = warc_archive.parse(io.BytesIO(good))
    with pytest.raises(ValueError, match="digest"):
        warc_archive._row("x", headers, block, True)
    with pytest.raises(ValueError, match="cut off"):
        list(warc_archive.parse(io.BytesIO(good[:-6])))


def test_no_pages_give_no_archive(spark):
    assert archived(spark, [])[1] == []


DOC = "doc_id bigint, text string, lang string, source string"
WORDS = ["Alpha", "beta", "gamma", "Δέλτα", "naïve", "été", "zz", "Q"]
DOCS = (
    [(i, " ".join(WORDS[(i * 7 + j * j) % 8] for j in range(5 + i % 23)), ("en", "de", None)[i % 3], ("s1", "s2", "", None, "S1")[i % 5]) for i in range(150)]
    + [(1, None, "en", "only null"), (None, "", None, None), (2, "123 .. !", "fr", "numbers"), (3, "12 34", "fr", "digits"), (4, "once upon a time", "fr", "x"), (5, "aLpha " * 20_000, "en", "s1")]
    + [(9, "same words again", "en", "copies")] * 12
)


@pytest.mark.parametrize("entries", [5, divergence.MAX_ENTRIES])
def test_divergence_on_odd_rows(spark, entries):
    docs = spark.createDataFrame(DOCS, DOC).repartition(5)
    found = divergence.audit_sources(docs.withColumns({"term": F.lit("clash"), "n": F.lit("clash"), "v": F.lit(1), "value": F.lit(1), "row": F.lit(2)}), max_entries=entries)
    expected = by_sql(spark, divergence.OP12_SQL, documents=docs)
    assert sorted(map(repr, map(tuple, found.select(expected.columns).collect()))) == sorted(map(repr, expected.fetchall()))
    assert divergence.audit_sources(docs.where("false")).collect() == []


def test_radix_selection_takes_ties_by_bytes(spark):
    items = [f"{'p' * 40}{chr(97 + i % 7)}{'é' * (i % 3)}{i}" for i in range(400)] + ["p", "", "\U0001f600", "é" * 30]
    rows = [("a", 5, x) for x in items] + [("a", 9, "nine"), ("a", 2**40, "big")] + [("b", i, str(i)) for i in range(4)] + [("c", 0, x) for x in items]
    stored_rows = spark.createDataFrame(rows, "g string, value bigint, item string")
    with scratch(spark) as stored:
        found = {(r.g, r.rank, r.value, r.item) for r in divergence.radix_top_k(stored(stored_rows), ["g"], 10, stored).collect()}
    expected = set()
    for g in "abc":
        own = sorted(((-v, x.encode(), v, x) for h, v, x in rows if h == g))[:10]
        expected |= {(g, i, v, x) for i, (_, _, v, x) in enumerate(own, 1)}
    assert found == expected


PIECES = ["New York City is big", "he saw New York City", "new york, city", "of the of the of the", "x\ty  z", "a b a b a", "naïve café Société générale", "end.of;piece:here!and?there\x0bthen\x0cnow\rso"]


@pytest.mark.parametrize("block", [64, collocations.BLOCK_BYTES])
def test_collocations_on_odd_rows(spark, block):
    rows = [(i, PIECES[i % 8] + (" " if i % 3 else ". ") + PIECES[(i * 5) % 8], (None, "en", "und", "de")[i % 4], "s") for i in range(160)]
    rows += [(1, None, "en", "s"), (2, "", None, "s"), (3, " \t\n.,", "fr", "s"), (4, "w " * 5000, "fr", "s"), (None, "A" * 50_000, "en", "s")]
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    clash = {c: F.lit("clash") for c in ("block", "n", "a", "id", "words", "rank")}
    found = collocations.mine_collocations(docs.withColumns(clash), block_bytes=block)
    expected = by_sql(spark, collocations.OP13_SQL, documents=docs)
    assert sorted(map(repr, map(tuple, found.select(expected.columns).collect()))) == sorted(map(repr, expected.fetchall()))
    assert found.count() > 20


def test_longer_collocations_against_counting(spark):
    rows = [Row(text=" ".join("abcde"[(i + j * j) % 5] for j in range(40)), lang="en") for i in range(12)]
    with scratch(spark) as stored:
        levels, _ = collocations.frequent_phrases(spark.createDataFrame(rows), 5, 10, stored)
        words = {r.id: r.word for r in levels[0].collect()}
        found = {" ".join(words[i] for i in r.ids): (r.f, list(r.heads), list(r.tails)) for level in levels for r in level.collect()}
    counts = Counter(" ".join(r.text.split()[i : i + m]) for r in rows for m in range(1, 6) for i in range(41 - m))
    expected = {p: n for p, n in counts.items() if n >= 10}
    assert {p: f for p, (f, *_) in found.items()} == expected
    for p, (_, heads, tails) in found.items():
        w = p.split()
        assert heads == [counts[" ".join(w[:k])] for k in range(1, len(w))]
        assert tails == [counts[" ".join(w[-k:])] for k in range(1, len(w))]


def test_pairs_of_a_block_are_sent_in_parts():
    words = np.random.default_rng(13).integers(0, 5_000, 600_000)
    counts = np.bincount(words)
    steps = collocations.pack(np.argsort(words, kind="stable").astype(np.int32), counts).astype(np.int32)
    ids = np.arange(len(counts)) * 3 + 2**40
    tracemalloc.start()
    rows = [b.num_rows for b in collocations.key_batches(7, ids, counts.astype(np.int32), steps)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(rows) <= collocations.PART < sum(rows)
    assert most < 24e6  # with all pairs at once, 8 arrays of 64 bits for each position
    found, at = Counter(), 0
    for batch in collocations.key_batches(7, ids, counts.astype(np.int32), steps):
        assert batch.column("i").to_pylist() == list(range(at, at := at + batch.num_rows))
        for prefix, suffix, n in zip(*(batch.column(c).to_pylist() for c in ("prefix", "suffix", "n")), strict=True):
            found[(prefix - 2**40) // 3, (suffix - 2**40) // 3] += n
    assert found == Counter(zip(words[:-1].tolist(), words[1:].tolist(), strict=True))


def test_one_phrase_may_fill_a_part():
    steps = np.array([0] + [1] * 999, np.int32)
    (prefix, suffix, n, at), *rest = collocations.extended(np.array([1000], np.int32), steps, part=64)
    assert (prefix.tolist(), suffix.tolist(), n.tolist(), at.tolist(), rest) == ([0], [0], [999], list(range(999)), [])
    assert list(collocations.extended(np.array([], np.int32), np.array([], np.int32))) == []


@pytest.mark.parametrize("words", [3, 4])
def test_blocks_are_read_across_batches(spark, words):
    rows = [Row(text=" ".join("abcdefgh"[(i * i + j * j * 3) % 8] for j in range(60)), lang="en" if i % 2 else "de") for i in range(24)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "5")
    try:
        with scratch(spark) as stored:
            levels, _ = collocations.frequent_phrases(spark.createDataFrame(rows), words, 10, stored, block_bytes=600)
            spelled = {r.id: r.word for r in levels[0].collect()}
            found = Counter({(r.lang, " ".join(spelled[i] for i in r.ids)): r.f for level in levels for r in level.collect()})
    finally:
        spark.conf.set(key, before)
    counts = Counter((r.lang, " ".join(r.text.split()[i : i + m])) for r in rows for m in range(1, words + 1) for i in range(61 - m))
    assert found == Counter({p: n for p, n in counts.items() if n >= 10})


def test_text_held_by_a_task_does_not_grow_with_languages(spark):
    rows = [(i, "nineteen characters", f"lang{i % 40}", "s") for i in range(80)]
    blocks = collocations.word_lists(spark.createDataFrame(rows, DOC).coalesce(1), block_bytes=64).select("lang", "n").collect()
    assert len(blocks) > 40
    total = Counter()
    for r in blocks:
        total[r.lang] += r.n
    assert total == Counter({f"lang{i}": 4 for i in range(40)})


def test_rows_of_blocks_are_few_in_a_file(spark):
    with scratch(spark) as stored:
        table = stored(spark.range(0, 9, 1, 1), collocations.BLOCKS_A_FILE)
        assert len(table.inputFiles()) == 3 and table.count() == 9


def test_lookup_without_salts_copies_nothing(spark):
    with scratch(spark) as stored:
        dims = stored(spark.range(SMALL_ROWS + 1).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value")))
        found = lookup(spark.range(50).withColumnRenamed("id", "key"), dims, ["key"], salts=1)
        assert sorted(map(tuple, found.collect())) == [(i, 2 * i) for i in range(50)]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "Generate" not in plan


def test_collocations_of_nothing(spark):
    assert collocations.mine_collocations(spark.createDataFrame([], DOC)).collect() == []


def test_lookup_of_a_large_table_broadcasts_nothing(spark):
    facts = spark.range(50).withColumnRenamed("id", "key")
    with scratch(spark) as stored:
        dims = stored(spark.range(SMALL_ROWS + 1).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value")))
        found = lookup(facts, dims, ["key"])
        assert sorted(map(tuple, found.collect())) == [(i, 2 * i) for i in range(50)]
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
