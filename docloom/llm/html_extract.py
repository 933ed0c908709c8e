"""Main-text extraction with a site style tree (operator 4).

Each page is parsed into text blocks with the path of block elements above them
(tag, classes, and whether the markup hints at no article). Same-host pages are
merged by path: a style node is a path of one host, its pages are those that
hold it, its content features are the distinct texts found there, its
presentation is the sequence of block elements it contains. Pages of a host
that are equal in blocks and paths count as one page.

* Content importance of a node: 1 - mean of log(n) / log(m) over its texts, for
  a text on n of the node's m pages; 1 if every page has its own texts, 0 if all
  share them.
* Presentation importance of a node: the entropy, to the base m, of its child
  sequences over its m pages.
* A node's importance is the larger of both. Where pages are few, belief takes
  the place of evidence: (m * importance + k * belief) / (m + k), with belief 0
  for paths whose markup hints at menus, notices, adverts and the like (k =
  200), 1/2 if these lie inside of an article or main element (k = 50), and 1
  for all others (k = 20).

Blocks of nodes below MIN_IMPORTANCE are removed from each page. Besides, what
markup excludes by its meaning goes without being judged: scripts, styles,
menus, forms, page headers and footers, hidden elements, and reader comments,
whose texts are as varied as an article's. A page of which nothing would be
left keeps what its markup does not exclude.

With ``names_decide`` (as op4 does) a hint never outweighs a text, whatever the
number of pages. The tree judges every node without regard to names. What it
leaves goes by meaning in boxes with a class or id made of hint words alone,
outside of article and main elements, and in those named as adverts anywhere;
other hints count for nothing. The belief in a node is then the importance of
the branch that it hangs from, which is that of its most important node: the
largest m * importance / (m + k) of the nodes with text below, plus k / (M + k)
for what M, the most pages of one of them, leave open (k = PLAIN). So a rare
node shares its branch's fate, and a branch of low nodes goes as a whole. A node of which every
page has its own text stays. What was taken out by meaning never comes back.

Statistics are aggregated over 64-bit node hashes (host and path). The low nodes
go to every task if they are at most MAX_SENT_NODES; beyond that they are joined
to the pages that hold them.

Defined results: null or empty html gives an empty text; repeated rows are
extracted each on its own; a null url, or one without a host, is a site of its
own; columns named like the new ones, in any case, are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from docloom.llm.common import append_columns, slices, table, unused
from docloom.llm.url_filter import host_of

MIN_IMPORTANCE = 0.7
#: Pages that belief counts for: hinted paths, hinted paths in an article, others.
HINTED, HINTED_INSIDE, PLAIN = 200, 50, 20
#: Low nodes sent to every task, 8 bytes each; more of them are joined instead.
MAX_SENT_NODES = 2_000_000
#: Element names of HTML, by what they mean for a text's blocks.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button head title".split())
OUTSIDE = frozenset("nav footer aside form menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words in classes and ids that name reader comments, and those that hint at no article.
COMMENTS = frozenset("comment comments commentlist discussion disqus replies respond".split())
HINTS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar side menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar topbar masthead footer foot header share sharing social related recommended recommendations widget form search skip copyright legal disclaimer tags".split())
#: Those hints that name an advert.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored".split())
TOKEN = re.compile(
    r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|$)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
WORD = re.compile(r"[a-z]+")
#: An open element of these ends when one of those begins.
ENDS = {"p": BLOCKS, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"})}


def describe(tag: str, attributes: str, inside: bool) -> tuple[str, bool]:
    """The element's step in a style path, and whether its meaning takes it out of the article.

    "!" marks a hint, "!!" a name made of hints alone, "!!!" one with an advert among them.
    """
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    names = [set(WORD.findall(name)) for name in f"{found.get('class', '')} {found.get('id', '')}".lower().split()] if tag not in ("html", "body", "main") else []
    words = set().union(*names)
    sure = [name for name in names if name and name <= HINTS]
    out = tag in OUTSIDE or tag == "header" and not inside or "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES or bool(words & COMMENTS)
    return ".".join([tag, *sorted(found.get("class", "").lower().split())]) + "!" * (bool(words & HINTS) + bool(sure) + any(name & ADVERTS for name in sure)), out


def parse(text: str | None) -> tuple[list[tuple[str, str, bool]], dict[str, str]]:
    """Blocks (path, text, taken out by meaning), and path -> child sequence of inner nodes."""
    blocks: list[tuple[str, str, bool]] = []
    children: dict[str, list[str]] = {}
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]  # tag, path, out, in an article
    pending: list[str] = []
    text = text or ""
    at = 0

    def flush() -> None:
        if pending:
            clean = " ".join(html.unescape("".join(pending)).split())
            pending.clear()
            if clean:
                blocks.append((stack[-1][1], clean, stack[-1][2]))

    while at < len(text):
        m = TOKEN.search(text, at)
        if m is None:
            pending.append(text[at:])
            break
        pending.append(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                pending.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if not m[1] and tag in RAW:
            found = re.compile(f"</{tag}", re.I | re.A).search(text, at)
            end = found.start() if found else -1
            close = text.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else len(text) if tag in ("script", "style") or end >= 0 else at
            continue
        if tag not in BLOCKS:
            if tag == "br":
                pending.append(" ")
            continue
        flush()
        if m[1]:
            if any(x[0] == tag for x in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        while stack[-1][0] in ENDS and tag in ENDS[stack[-1][0]]:
            stack.pop()
        if tag in VOID:
            continue
        _, path, out, inside = stack[-1]
        step, no = describe(tag, m[3], inside)
        children.setdefault(path, []).append(step)
        stack.append((tag, f"{path}/{step}", out or no, inside or tag in ("article", "main")))
    flush()
    runs = {p: "/".join(c for k, c in enumerate(seq) if not k or seq[k - 1] != c) for p, seq in children.items()}
    return blocks, runs


def belief(path: str) -> tuple[float, int]:
    """What is thought of a path before any page is seen, and the number of pages that this counts for."""
    steps = path.split("/")
    if not any(step.endswith("!") for step in steps):
        return 1.0, PLAIN
    inside = next((k for k, step in enumerate(steps) if step.split(".")[0].rstrip("!") in ("article", "main")), len(steps))
    return (0.0, HINTED) if any(step.endswith("!") for step in steps[: inside + 1]) else (0.5, HINTED_INSIDE)


def named_out(path: str) -> bool:
    """Whether a box above is named as no part of an article: an advert anywhere, other names outside of article and main."""
    for step in path.split("/"):
        if step.endswith("!!"):
            return True
        if step.split(".")[0].rstrip("!") in ("article", "main"):
            return "!!!" in path
    return False


def node_hash(host: int, path: str) -> int:
    """The node of a path in a host, as a signed 64-bit integer."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(path, host % (1 << 64))).view(np.int64))


def text_hash(text: str) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(text)).view(np.int64))


FEATURE = T.StructType([T.StructField("node", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("feature", T.LongType()), T.StructField("first", T.IntegerType())])


def page_features(host: int, text: str | None) -> tuple[int, list[dict]]:
    """A hash of a page's blocks and paths, and its features: (node, kind, feature, first).

    kind is the path's belief (0 plain, 1 hinted in an article, 2 hinted) for a
    text, and that plus 3 for a child sequence; first is 1 on one text of each
    node, so that its sum counts the node's pages. Kind 6 gives the branches that
    a node with text hangs from, and first marks the nearest.
    """
    blocks, runs = parse(text)
    kinds = {PLAIN: 0, HINTED_INSIDE: 1, HINTED: 2}
    out, seen = [], set()
    for path, feature in dict.fromkeys((path, text_hash(clean)) for path, clean, _ in blocks):
        out.append({"node": node_hash(host, path), "kind": kinds[belief(path)[1]], "feature": feature, "first": int(path not in seen)})
        seen.add(path)
    out += [{"node": node_hash(host, path), "kind": 3 + kinds[belief(path)[1]], "feature": text_hash(run), "first": 1} for path, run in runs.items()]
    for path in seen:
        above = path
        while above:
            above = above.rpartition("/")[0]
            out.append({"node": node_hash(host, path), "kind": 6, "feature": node_hash(host, above), "first": int(above == path.rpartition("/")[0])})
    whole = xxhash.xxh3_64_intdigest(repr((blocks, runs)), host % (1 << 64))
    return int(np.uint64(whole).view(np.int64)), out


def features_of(pages: DataFrame, host: Column, html_col: str) -> DataFrame:
    """page (a hash of host, blocks and paths) and features of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.list_(pa.struct([("node", pa.int64()), ("kind", pa.int32()), ("feature", pa.int64()), ("first", pa.int32())]))
        for whole in batches:
            for batch in slices(whole, "html"):
                made = [page_features(h, t) for h, t in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], types)], names=["page", "features"])

    schema = T.StructType([T.StructField("page", T.LongType()), T.StructField("features", T.ArrayType(FEATURE))])
    return pages.select(host.alias("host"), F.col(f"`{html_col}`").alias("html")).mapInArrow(run, schema)


def style_nodes(features: DataFrame) -> DataFrame:
    """``style_tree`` with a row of kind 6 for each node with text: all branches that it hangs from, and the nearest."""
    distinct = features.groupBy("page").agg(F.first("features").alias("features"))
    counts = distinct.select(F.inline("features")).groupBy("node", "kind", "feature").agg(F.count("*").alias("n"), F.sum("first").alias("first"))
    nodes = counts.groupBy("node", "kind").agg(F.sum("first").alias("m"), F.avg(F.log("n")).alias("spread"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.collect_set(F.when(F.col("kind") == 6, F.col("feature"))).alias("above"), F.max(F.when((F.col("kind") == 6) & (F.col("first") > 0), F.col("feature"))).alias("nearest"))
    m = F.col("m").cast("double")
    importance = F.when(m < 2, 1.0).when(F.col("kind") < 3, 1 - F.col("spread") / F.log(m)).otherwise(1 - F.col("nlogn") / (m * F.log(m)))
    return nodes.select("node", "kind", "m", importance.alias("importance"), "above", "nearest")


def style_tree(features: DataFrame) -> DataFrame:
    """node, kind, m and importance of the content (kind 0 to 2) and the presentation (3 to 5) of every style node, from ``features_of``.

    Equal pages of a host are one; partial sums keep a hot site from meeting in one task.
    """
    return style_nodes(features).where("kind < 6").select("node", "kind", "m", "importance")


def low_nodes(tree: DataFrame, min_importance: float) -> DataFrame:
    """node: those with a text whose importance, tempered by belief, is below the threshold."""
    kind = F.col("kind") % 3
    k = F.when(kind == 2, HINTED).when(kind == 1, HINTED_INSIDE).otherwise(PLAIN)
    thought = F.when(kind == 2, 0.0).when(kind == 1, 0.5).otherwise(1.0)
    tempered = (F.col("m") * F.col("importance") + k * thought) / (F.col("m") + k)
    nodes = tree.select("node", "kind", tempered.alias("importance")).groupBy("node").agg(F.max("importance").alias("importance"), F.min("kind").alias("kind"))
    return nodes.where((F.col("kind") < 3) & (F.col("importance") < min_importance)).select("node")


def low_branches(nodes: DataFrame, min_importance: float) -> DataFrame:
    """node: those with a text whose importance, tempered by that of their branch, is below the threshold, from ``style_nodes``.

    A node has as many branches as its path has steps, so nothing grows with the pages here.
    """
    is_text, is_edge = F.col("kind") < 3, F.col("kind") == 6
    leaves = nodes.groupBy("node").agg(
        F.max(F.when(~is_edge, F.col("importance"))).alias("importance"),
        F.max(F.when(is_text, F.col("m"))).alias("m"),
        F.max(F.when(is_edge, F.col("above"))).alias("above"),
        F.max("nearest").alias("nearest"),
    ).where("m IS NOT NULL")
    branches = leaves.select(F.explode("above").alias("branch"), "m", "importance").groupBy("branch").agg((F.max(F.col("m") * F.col("importance") / (F.col("m") + PLAIN)) + PLAIN / (F.max("m") + PLAIN)).alias("trust"))
    judged = leaves.where("importance < 1").join(branches, F.col("nearest") == F.col("branch"), "left")
    tempered = (F.col("m") * F.col("importance") + PLAIN * F.coalesce("trust", F.lit(1.0))) / (F.col("m") + PLAIN)
    return judged.where(tempered < min_importance).select("node")


def main_text(host: int, text: str | None, low, names_decide: bool = False) -> tuple[str, int]:
    """The blocks that are left, joined, and the number of those that the style tree removed."""
    blocks = [(path, clean) for path, clean, out in parse(text)[0] if not out]
    if names_decide:
        stay = [(path, clean) for path, clean in blocks if not named_out(path)]
        left = [clean for path, clean in stay if node_hash(host, path) not in low]
        return "\n".join(left or [clean for _, clean in stay]), sum(node_hash(host, path) in low for path, _ in blocks) if left else 0
    left = [clean for path, clean in blocks if node_hash(host, path) not in low] or [clean for _, clean in blocks]
    return "\n".join(left), len(blocks) - len(left)


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_importance: float = MIN_IMPORTANCE, max_sent: int = MAX_SENT_NODES, names_decide: bool = False) -> DataFrame:
    """``pages`` without html, with the main text, and n_removed: blocks that the style tree removed.

    ``names_decide``: boxes go by whole names of their meaning at once, and hints
    weigh against no text; otherwise hints are beliefs that pages must outweigh.
    """
    host = F.xxhash64(host_of(F.col(f"`{url_col}`")))
    features = features_of(pages, host, html_col)
    nodes = style_nodes(features).persist()
    low = (low_branches(nodes, min_importance) if names_decide else low_nodes(nodes.where("kind < 6"), min_importance)).persist()
    try:
        sent = low.count() <= max_sent
        known = frozenset(low.toArrow().column("node").to_pylist()) if sent else frozenset()  # at most max_sent
    finally:
        low.unpersist()
        nodes.unpersist()
    body, of, own = unused("html"), unused("host"), unused("low")
    names = {"text", "n_removed", html_col.lower()}
    kept = [c for c in pages.columns if c.lower() not in names]
    source = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias(of), F.col(f"`{html_col}`").alias(body))
    if sent:
        source = source.withColumn(own, F.lit(None).cast("array<bigint>"))
    else:
        source = with_low_nodes(source, low, of, body, own)
    shared = pages.sparkSession.sparkContext.broadcast(known)
    fields = [T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = shared.value
        for whole in batches:
            for batch in slices(whole, body):
                columns = (batch.column(c).to_pylist() for c in (of, body, own))
                made = [main_text(h, t, everywhere if lows is None else frozenset(lows), names_decide) for h, t, lows in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=[*kept, "text", "n_removed"])

    return source.mapInArrow(run, T.StructType([source.schema[c] for c in kept] + fields))


def with_low_nodes(source: DataFrame, low: DataFrame, of: str, body: str, own: str) -> DataFrame:
    """``source`` with the low nodes that each page holds, joined by hashes of host and html."""

    def make():
        return lambda texts: [[list({path for path, _, out in parse(t)[0] if not out}) for t in texts]]

    key, html_hash = unused("key"), F.xxhash64(of, body)
    texts = source.select(F.col(of).alias("host"), html_hash.alias("key"), F.col(body).alias("html")).dropDuplicates(["key"])
    paths = append_columns(texts, "html", [T.StructField("paths", T.ArrayType(T.StringType()))], make, drop=("html",))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [[node_hash(h, p) for p in found] for h, found in zip(batch.column("host").to_pylist(), batch.column("paths").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(nodes, pa.list_(pa.int64()))], names=["key", "nodes"])

    held = paths.mapInArrow(hashed, "key bigint, nodes array<bigint>").select("key", F.explode("nodes").alias("node"))
    lows = held.join(low, "node", "left_semi").groupBy("key").agg(F.collect_set("node").alias(own)).withColumnRenamed("key", key)
    joined = source.join(lows, html_hash == F.col(key), "left").drop(key)
    return joined.withColumn(own, F.coalesce(F.col(own), F.array().cast("array<bigint>")))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages, names_decide=True).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_removed")
