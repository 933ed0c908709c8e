"""Source divergence audit (operator 12): how far each source's words are from those of the other sources of its language.

1. Tasks count terms and documents by (lang, source) in bounded dictionaries;
   one shuffle by (lang, term) adds the counts up and finds the kept terms.
2. A group gives a term the proportion p = 1 + (SCALE * (count + 2)) div (N + 2 V).
   Every term that a group does not have has the same p, its baseline.
3. Divergence of two sources is a sum over all kept terms, taken sparsely: V
   times the value of the two baselines, a correction for each term that one of
   them has (by its distinct counts, as the other is at its baseline), and one
   for each term that both have (a join by term).
4. The terms that stand out in a group are its k largest values, found by radix
   selection: histograms over digits of the value's bits give each group's kth
   value, and rows that tie with it are told apart by histograms over UTF-8
   bytes. Only what is selected is sorted.

Defined results: null text, lang or source count as ''; each row is a document,
also one of a repeated id; a group without terms still has its pairs; a
language without kept terms gives pairs of value 0; an empty table gives none.
Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docloom.llm.common import lookup, materialize, scratch, slices, table

#: A term is kept in a language if so many of its documents have it.
MIN_DOCS = 10
#: Proportions are whole numbers of this scale, with SMOOTH added to every count.
SCALE, SMOOTH = 1_000_000_000, 2
#: Terms listed for each group.
TOP_TERMS = 10
#: Distinct (lang, source, term) that a task holds before it hands them on.
MAX_ENTRIES = 400_000
#: Bits of a value, and bytes of a tied item, that one histogram tells apart.
DIGIT_BITS, DIGIT_BYTES = 10, 2
TERM = re.compile(rb"[a-z\x80-\xff]+")

PARTIAL = "lang string, source string, term binary, n bigint, docs bigint"


def _count(batches: Iterator[pa.RecordBatch], max_entries: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
    words: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in words.items():
            own = docs[lang, source]
            terms = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()), pa.array(list(found.values()), pa.int64()), pa.array([own[t] for t in terms], pa.int64())],
                schema=schema,
            )
        words.clear()
        docs.clear()

    for whole in batches:
        for batch in slices(whole, "text"):
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                key = lang, source
                if key not in words:
                    words[key], docs[key] = Counter(), Counter()
                found = TERM.findall(text.lower())  # bytes.lower() changes A-Z only
                before = len(words[key])
                words[key].update(found)
                words[key][None] += 0  # the group occurs, with terms or without
                docs[key].update(set(found))
                held += len(words[key]) - before
                if held > max_entries:
                    yield from flush()
                    held = 0
    yield from flush()


def proportion(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * v)), exact also where the product passes 64 bits."""
    made = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(19,0)")
    return F.call_function("div", made, (total + SMOOTH * v).cast("decimal(19,0)")) + 1


def divergence(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); proportions are below 2^31, so 64 bits hold the square."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """lang, source, term, n, total, once: counts of kept terms, total over the language, once true in one row of a (lang, term).

    Each group has one more row with a null term.
    """
    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = plain.mapInArrow(lambda batches: _count(batches, max_entries), PARTIAL).repartition("lang", "term")
    counts = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    seen = counts.withColumns({"total": F.sum("n").over(same), "df": F.sum("docs").over(same), "once": F.col("source") == F.min("source").over(same)})
    return seen.where(F.col("term").isNull() | (F.col("df") >= min_docs)).select("lang", "source", F.col("term").cast("string").alias("term"), "n", "total", "once")


def group_sizes(counts: DataFrame) -> DataFrame:
    """lang, source, total, v, lang_total, base: N of the group and of its language, the language's V, the group's proportion of a term it has not."""
    of_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = counts.groupBy("lang").agg(F.count_if(F.col("once") & F.col("term").isNotNull()).alias("v"), F.sum("n").alias("lang_total"))
    both = of_group.join(of_lang, "lang")
    return both.withColumn("base", F.when(F.col("v") > 0, proportion(F.lit(0), F.col("total"), F.col("v"))))


def source_pairs(sparse: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value for the sources a < b of each language; ``sparse`` has p and base of the terms that occur."""
    left = groups.select("lang", "v", F.col("source").alias("a"), F.col("base").alias("base_a"))
    right = groups.select("lang", F.col("source").alias("b"), F.col("base").alias("base_b"))
    level = left.join(right, "lang").where("a < b").select("lang", "a", "b", F.coalesce(F.col("v") * divergence("base_a", "base_b"), F.lit(0)).alias("value"))

    heights = sparse.groupBy("lang", "source", "p", "base").agg(F.count("*").alias("terms"))
    alone = heights.join(right, "lang").where("source <> b")
    one = alone.select("lang", F.least("source", "b").alias("a"), F.greatest("source", "b").alias("b"), (F.col("terms") * (divergence("p", "base_b") - divergence("base", "base_b"))).alias("value"))

    x = sparse.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p"), F.col("base").alias("p0"))
    y = sparse.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("q"), F.col("base").alias("q0"))
    shared = x.join(y, ["lang", "term"]).where("a < b")
    two = shared.select("lang", "a", "b", (divergence("p", "q") - divergence("p", "q0") - divergence("p0", "q") + divergence("p0", "q0")).alias("value"))
    return level.unionByName(one).unionByName(two).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def common_prefix(a: str, b: str) -> Column:
    """Bytes that two binary columns have in common from their start, by doubling steps."""
    steps = f"transform(sequence(0, CAST(floor(log2(greatest(length({a}), 1))) AS INT)), k -> shiftleft(1, k))"
    return F.expr(f"aggregate(reverse({steps}), 0, (n, s) -> CASE WHEN n + s <= least(length({a}), length({b})) AND substring({a}, 1, n + s) = substring({b}, 1, n + s) THEN n + s ELSE n END)")


def radix_top_k(rows: DataFrame, group: list[str], k: int, stored: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` (``group``, value, item) with ``rank`` up to ``k`` by value descending, item ascending in UTF-8 bytes.

    ``rows`` is a stored table; values are longs from 0 up, groups and items
    are not null. No step sorts a group: what it reads of one is a histogram of
    at most 2^DIGIT_BITS values or 2^(8 DIGIT_BYTES) prefixes.
    """
    top = rows.agg(F.max("value")).first()[0]
    if top is None:
        return rows.withColumn("rank", F.lit(0)).where("false")
    before = lambda *order: Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = stored(rows.select(*group).distinct().withColumns({"prefix": F.lit(0).cast("long"), "need": F.lit(k).cast("long"), "tied": F.lit(0).cast("long")}))

    def chosen(hist: DataFrame, order: Column) -> DataFrame:
        """Of each group's bins the one in which the needed count is reached, or the last; need becomes what it must give."""
        run = hist.withColumns({"run": F.sum("n").over(before(order)), "all": F.sum("n").over(Window.partitionBy(*group))})
        return run.where("run - n < need AND (run >= need OR run = all)").withColumns({"need": F.col("need") - (F.col("run") - F.col("n")), "tied": F.col("n")})

    for shift in reversed(range(0, max(top.bit_length(), 1), DIGIT_BITS)):
        alike = lookup(rows, state, group).where(F.expr(f"shiftright(value, {min(shift + DIGIT_BITS, 63)}) = prefix"))
        hist = alike.groupBy(*group, "prefix", "need", F.expr(f"shiftright(value, {shift}) & {2**DIGIT_BITS - 1}").alias("digit")).agg(F.count("*").alias("n"))
        state = stored(chosen(hist, F.col("digit").desc()).select(*group, F.expr(f"prefix * {2**DIGIT_BITS} + digit").alias("prefix"), "need", "tied"))

    bytes_of = F.encode("item", "utf-8")
    kth = state.select(*group, F.col("prefix").alias("kth"), "need", "tied")
    ties = kth.where("tied > need")
    if ties.isEmpty():
        limits = kth.select(*group, "kth", F.lit(None).cast("binary").alias("bound"))
    else:
        bounds = tie_bounds(stored(lookup(rows, ties, group).where("value = kth").select(*group, "need", bytes_of.alias("b"))), group, chosen, stored)
        limits = stored(kth.select(*group, "kth").join(bounds, group, "left"))
    picked = lookup(rows, limits, group).where((F.col("value") > F.col("kth")) | ((F.col("value") == F.col("kth")) & (F.col("bound").isNull() | (bytes_of <= F.col("bound")))))
    order = Window.partitionBy(*group).orderBy(F.col("value").desc(), "item")
    return picked.select(*group, "value", "item").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def tie_bounds(equal: DataFrame, group: list[str], chosen: Callable[[DataFrame, Column], DataFrame], stored: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Of rows that tie with their group's kth value (``group``, need, b), the last b that is still selected, as ``bound``.

    Each round reads the bytes behind what a group's open rows have in common,
    so it always tells some of them apart.
    """
    ends = equal.groupBy(*group, "need").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    undecided, bounds = stored(ends.withColumn("at", common_prefix("lo", "hi"))), None
    while not undecided.isEmpty():
        alike = lookup(equal.drop("need"), undecided, group).where("b >= lo AND b <= hi")
        hist = alike.groupBy(*group, "need", F.expr(f"substring(b, at + 1, {DIGIT_BYTES})").alias("digit")).agg(F.count("*").alias("n"), F.min("b").alias("lo"), F.max("b").alias("hi"))
        state = stored(chosen(hist, F.col("digit")).select(*group, "need", "tied", "lo", "hi", common_prefix("lo", "hi").alias("at")))
        again = (F.col("tied") > F.col("need")) & (F.col("lo") < F.col("hi"))
        decided = state.where(~again).select(*group, F.col("hi").alias("bound"))
        bounds = decided if bounds is None else bounds.unionByName(decided)
        undecided = state.where(again).drop("tied")
    return bounds


def audit_sources(docs: DataFrame, top: int = TOP_TERMS, min_docs: int = MIN_DOCS, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (lang, source, text).

    part ``pair``: the divergence from each other source of the language, all
    ranks; part ``term``: the ``top`` terms that stand out against the language.
    """
    with scratch(docs.sparkSession) as stored:
        counts = stored(kept_counts(docs, min_docs, max_entries))
        groups = stored(group_sizes(counts))
        terms = counts.where("term IS NOT NULL").withColumnRenamed("total", "in_lang")
        sparse = stored(lookup(terms, groups, ["lang", "source"]).select("lang", "source", "term", "base", proportion(F.col("n"), F.col("total"), F.col("v")).alias("p"), proportion(F.col("in_lang"), F.col("lang_total"), F.col("v")).alias("q")))
        half = stored(source_pairs(sparse, groups))
        both = half.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(half.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
        pairs = both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
        out = sparse.where("p > q").select("lang", "source", divergence("p", "q").alias("value"), F.col("term").alias("item"))
        ranked = radix_top_k(stored(out), ["lang", "source"], top, stored)
        columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
        return materialize(stored(columns(pairs, "pair")).unionByName(stored(columns(ranked, "term"))))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of every source of ``documents``."""
    return audit_sources(table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, source, r, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT d.lang, d.source, any_value(v) AS v, coalesce(any_value(s.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) d
    LEFT JOIN langs USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) s ON s.lang = d.lang AND s.source = d.source GROUP BY d.lang, d.source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS count,
    CAST(1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {SMOOTH})) // (g.n + {SMOOTH} * g.v) AS BIGINT) AS p,
    CAST(1 + ({SCALE}::HUGEINT * (kept.total + {SMOOTH})) // (langs.n + {SMOOTH} * g.v) AS BIGINT) AS q
    FROM g JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
s AS (SELECT a.lang, a.source, b.source AS other, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
f AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0) AS value
    FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.other = h.source),
x AS (SELECT lang, source, part, item, value FROM f UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE count > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
