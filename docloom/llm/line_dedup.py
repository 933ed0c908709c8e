"""Near-duplicate line removal by a deletion-neighbourhood join (operator 7), in built-in functions only.

Words are runs other than white space, lower-cased. A line is removed if an
earlier line of the corpus, by (document id, place in the text), is within its
edit bound: equal, or, where the longer one has ten words or more, one word
inserted, deleted or replaced (one edit in ten words; in shorter lines one word
is a tenth of the line or more). The earliest line of its kind is kept.

1. Equal lines are one class, kept at its earliest place.
2. One edit leaves the first or the last half of a line unchanged, so only
   classes that share a half with another class can have a neighbour.
3. Each of those emits hashed keys: itself, and itself without each word. Lines
   of one key with the same word left out differ by a replacement; a line that
   equals another's key differs by an insertion. Both are found by grouping
   keys and taking the earliest line, so no pairs of a group are formed.
4. Each line is compared word by word with the earlier line that was found. If
   they are unlike, as a hash was shared by chance, the line is compared with
   every earlier line that it shares a key with.

Defined results: null texts stay null and have no lines; lines without words
always stay; a null id comes first in the order; rows equal in id and text
are one document and are treated alike; other columns are carried through. The
result reads the table of removed places, which stays in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docloom.llm.common import materialize, scratch, table, unused

#: The edit bound is one word where the longer of two lines has so many words, else none.
MIN_WORDS = 10
BLANK = r"[\\x20\\x09-\\x0D]+"
WORDS = f"filter(split(lower(x), '{BLANK}'), y -> y <> '')"
#: Whether a text whose words are parted by single blanks has more words than n.
MORE = "octet_length(substring_index(norm, ' ', {n})) < octet_length(norm)"
#: Half length for m words: 5, 10, 20, ... with twice that at most m, and 5 for lines that a line of MIN_WORDS may be cut to. Words are counted in very long lines only.
HALF = f"CASE WHEN NOT {MORE.format(n=MIN_WORDS - 2)} THEN NULL {' '.join(f'WHEN NOT {MORE.format(n=4 * h - 1)} THEN {h}' for h in (5, 10, 20, 40))} ELSE CAST(5 * pow(2, floor(log2(size(split(norm, ' ')) / 10.0D))) AS INT) END"


def line_keys(docs: DataFrame) -> DataFrame:
    """id, th, pos, line, halves of each line with a word; line is the hash of its words.

    halves has (hash, whether it is the first half, its words h), and is null for
    short lines. A line whose neighbours may be shorter has the halves of the next shorter length too.
    """
    half = lambda h: f"named_struct('half', xxhash64(1, {h}, substring_index(norm, ' ', {h})), 'head', true, 'h', {h}), named_struct('half', xxhash64(2, {h}, substring_index(norm, ' ', -{h})), 'head', false, 'h', {h})"
    other = F.expr(" OR ".join(f"contains(text, {blank})" for blank in ("'  '", "'\\t'", "'\\r'", "chr(11)", "chr(12)")))
    inside = BLANK.replace("x09-", "x09\\\\x0B-")  # white space but for line ends
    plain = F.when(other, F.expr(f"regexp_replace(text, '{inside}', ' ')")).otherwise(F.col("text"))
    lines = docs.select("id", "th", F.posexplode(F.split(F.lower(plain), "\n")).alias("pos", "norm"))
    clean = lines.withColumn("norm", F.trim("norm")).where("norm <> ''")
    sized = clean.withColumn("h", F.expr(HALF))
    halves = f"CASE WHEN h IS NULL THEN NULL WHEN h > 5 AND NOT {MORE.format(n='2 * h')} THEN array({half('h')}, {half('CAST(h / 2 AS INT)')}) ELSE array({half('h')}) END"
    return sized.select("id", "th", "pos", F.xxhash64("norm").alias("line"), F.expr(halves).alias("halves"))


def active_lines(classes: DataFrame) -> DataFrame:
    """line, first, skip_head, skip_tail of the classes that share a half with another class.

    An edit lies outside of the shared half, so words in it need not be left
    out: the first skip_head ones, or the last skip_tail ones.
    """
    halves = classes.where("halves IS NOT NULL").select("line", F.inline("halves"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1")
    found = halves.join(shared.select("half"), "half", "left_semi").groupBy("line").agg(F.bool_and("head").alias("heads"), F.bool_or("head").alias("head"), F.min("h").alias("h"))
    sides = found.select("line", F.when(F.col("heads"), F.col("h")).otherwise(0).alias("skip_head"), F.when(F.col("head"), 0).otherwise(F.col("h")).alias("skip_tail"))
    return classes.select("line", "first").join(sides, "line")


def active_words(docs: DataFrame, active: DataFrame) -> DataFrame:
    """ord, line, w, skip_head, skip_tail: the words of every active class, from its earliest place; ord rises in the order of those places."""
    places = active.groupBy(F.col("first.id").alias("pid"), F.col("first.th").alias("pth")).agg(F.collect_list(F.struct("first.pos", "line", "skip_head", "skip_tail")).alias("places"))
    found = docs.join(places, F.col("id").eqNullSafe(F.col("pid")) & (F.col("th") == F.col("pth"))).dropDuplicates(["id", "th"])
    words = f"transform(array(split(text, '\\n')), l -> transform(places, p -> named_struct('place', p, 'w', transform(array(l[p.pos]), x -> {WORDS})[0])))[0]"
    rows = found.select("id", "th", F.expr(f"inline({words})")).orderBy("id", "th", "place.pos")
    return rows.select(F.monotonically_increasing_id().alias("ord"), "place.line", "place.skip_head", "place.skip_tail", "w")


def with_keys(words: DataFrame) -> DataFrame:
    """``words`` with keys: that of the line itself, then of the line without each word that may be left out (none in lines under MIN_WORDS).

    A key is the exclusive or of the hashes of all words with their places, so
    it has 64 bits and depends on order. From one gap to the next a single
    place changes; the changes are summed up by doubling steps.
    """
    at = lambda i, x: f"xxhash64({i}, {x})"
    first = f"aggregate(slice(w, 2, size(w)), named_struct('i', 0, 'key', 0L), (a, x) -> named_struct('i', a.i + 1, 'key', a.key ^ {at('a.i + 1', 'x')}), a -> a.key)"
    changes = f"transform(w, (x, i) -> CASE WHEN i = 0 THEN {first} ELSE {at('i', 'w[i - 1]')} ^ {at('i', 'x')} END)"
    steps = "transform(sequence(0, CAST(floor(log2(greatest(size(w) - 1, 1))) AS INT)), k -> shiftleft(1, k))"
    cut = f"aggregate({steps}, {changes}, (a, k) -> transform(a, (x, i) -> x ^ coalesce(get(a, i - k), 0L)))"
    keys = f"transform(array({cut}), g -> concat(array(g[size(w) - 1] ^ {at('size(w)', 'w[size(w) - 1]')}), CASE WHEN size(w) < {MIN_WORDS} THEN CAST(array() AS ARRAY<BIGINT>) ELSE slice(g, 1 + skip_head, size(w) - skip_head - skip_tail) END))[0]"
    return words.withColumn("keys", F.expr(keys))


def neighbourhood(words: DataFrame) -> DataFrame:
    """ord, key, gap: gap 0 for the line itself, i for the line without its i-th word."""
    return words.select("ord", "skip_head", F.posexplode("keys").alias("gap", "key")).select("ord", "key", F.when(F.col("gap") > 0, F.col("gap") + F.col("skip_head")).otherwise(0).alias("gap"))


def earlier_neighbours(keys: DataFrame) -> DataFrame:
    """ord and the earliest line of those that share a key with it in a matching place and come before it."""
    groups = keys.groupBy("key", "gap").agg(F.min("ord").alias("earliest"), F.count("*").alias("n"))
    whole = groups.where("gap = 0").select("key", F.col("earliest").alias("whole"))
    cut = groups.where("gap > 0").groupBy("key").agg(F.min("earliest").alias("cut"))
    replaced = keys.join(groups.where("gap > 0 AND n > 1").select("key", "gap", "earliest"), ["key", "gap"]).select("ord", "earliest")
    shorter = keys.where("gap > 0").join(whole, "key").select("ord", F.col("whole").alias("earliest"))
    longer = keys.where("gap = 0").join(cut, "key").select("ord", F.col("cut").alias("earliest"))
    return replaced.union(shorter).union(longer).where("earliest < ord").groupBy("ord").agg(F.min("earliest").alias("earliest"))


def within_one_edit(a: str, b: str) -> Column:
    """Whether two word arrays differ by one inserted, deleted or replaced word at most."""
    same = lambda x, y: f"transform(array(array_position(zip_with({x}, {y}, (p, q) -> p <=> q), false)), n -> CASE WHEN n = 0 THEN size({a}) ELSE CAST(n AS INT) - 1 END)[0]"
    return F.expr(f"abs(size({a}) - size({b})) <= 1 AND {same(a, b)} + {same(f'reverse({a})', f'reverse({b})')} >= greatest(size({a}), size({b})) - 1")


def all_earlier(keys: DataFrame, lines: DataFrame) -> DataFrame:
    """ord of ``lines`` and every line that shares a key with it in a matching place and comes before it."""
    others = keys.select(F.col("ord").alias("earliest"), "key", F.col("gap").alias("there"))
    return keys.join(lines, "ord").join(others, "key").where("earliest < ord AND (gap = there OR gap = 0 OR there = 0)").select("ord", "earliest").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", made: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with the text without removed lines, and the numbers of lines and of removed lines (both long) under the names ``made``."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    with scratch(docs.sparkSession) as stored:
        lines = stored(line_keys(texts))
        classes = stored(lines.groupBy("line").agg(F.min(F.struct("id", "th", "pos")).alias("first"), F.any_value("halves").alias("halves"), F.count("*").alias("n")))
        words = stored(with_keys(active_words(texts, active_lines(classes))))
        keys = neighbourhood(words)

        def checked(found: DataFrame) -> DataFrame:
            pairs = found.join(words.select("ord", "line", "w"), "ord").join(words.select(F.col("ord").alias("earliest"), F.col("w").alias("v")), "earliest")
            return stored(pairs.select("ord", "line", within_one_edit("w", "v").alias("near")))

        first = checked(earlier_neighbours(keys))
        near, failed = first.where("near").select("line"), first.where("NOT near").select("ord")
        if not failed.isEmpty():  # two unlike lines had one key: their other candidates are not known
            near = near.union(checked(all_earlier(keys, failed)).where("near").select("line")).distinct()

        doomed = classes.join(near.withColumn("near", F.lit(True)), "line", "left").where("n > 1 OR near").select("line", "first", F.coalesce("near", F.lit(False)).alias("near"))
        removed = lines.select("id", "th", "pos", "line").join(doomed, "line").where("near OR NOT (first <=> struct(id, th, pos))")
        gone = materialize(removed.groupBy("id", "th").agg(F.collect_set("pos").alias("gone")))
    return without_lines(docs, gone, id_col, text_col, made)


def without_lines(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, made: tuple[str, str]) -> DataFrame:
    """``docs`` without the lines at the places ``gone`` of (id, th)."""
    of, th, places = unused("id"), unused("th"), unused("gone")
    kept = [c for c in docs.columns if c.lower() not in {m.lower() for m in made}]
    text = F.col(f"`{text_col}`")
    renamed = gone.select(F.col("id").alias(of), F.col("th").alias(th), F.col("gone").alias(places))
    both = docs.select(*[F.col(f"`{c}`") for c in kept]).join(renamed, F.col(f"`{id_col}`").eqNullSafe(F.col(of)) & (F.xxhash64(text) == F.col(th)), "left")
    left = F.expr(f"transform(array(split(`{text_col}`, '\\n')), l -> array_join(transform(array_except(sequence(0, size(l) - 1), {places}), i -> l[i]), '\\n'))[0]")
    out = both.withColumns(
        {
            made[0]: F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.split(text, "\n"))).cast("long"),
            made[1]: F.coalesce(F.size(places), F.lit(0)).cast("long"),
            text_col: F.when(F.col(places).isNull(), text).otherwise(left),
        }
    )
    return out.select(*[F.col(f"`{c}`") for c in kept], *made)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and removed lines of every document, and a digest of the text that is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


OP7_SQL = rf"""
WITH l AS (
  SELECT doc_id, pos, x, list_filter(regexp_split_to_array(lower(x), '[\x20\x09-\x0D]+'), lambda y: y <> '') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)),
o AS (SELECT row_number() OVER (ORDER BY doc_id, pos) AS o, * FROM l WHERE len(w) > 0),
k AS (SELECT o, 0 AS gap, w AS v, len(w) >= {MIN_WORDS - 1} AS long FROM o
      UNION ALL SELECT o, i, list_concat(list_slice(w, 1, i - 1), list_slice(w, i + 1, len(w))), true FROM (SELECT o, w, unnest(range(1, len(w) + 1)) AS i FROM o WHERE len(w) >= {MIN_WORDS})),
g AS (SELECT v, gap, long, min(o) AS m FROM k GROUP BY v, gap, long),
c AS (SELECT v, min(m) FILTER (gap = 0) AS whole, min(m) FILTER (gap > 0) AS cut FROM g WHERE long GROUP BY v),
gone AS (SELECT DISTINCT k.o FROM k JOIN g USING (v, gap, long) LEFT JOIN c ON c.v = k.v AND k.long
         WHERE g.m < k.o OR (k.gap > 0 AND c.whole < k.o) OR (k.gap = 0 AND c.cut < k.o)),
kept AS (SELECT l.doc_id, l.pos, l.x, gone.o IS NOT NULL AS dead FROM l LEFT JOIN o USING (doc_id, pos) LEFT JOIN gone ON gone.o = o.o)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, sha256(CASE WHEN d.text IS NOT NULL THEN coalesce(t, '') END) AS text_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (dead) AS r, string_agg(x, chr(10) ORDER BY pos) FILTER (NOT dead) AS t FROM kept GROUP BY doc_id) USING (doc_id)
"""
