"""URL filters: rules, then a logistic regression on hashed character n-grams (operator 2).

The model is trained from a small labelled URL table with built-in functions:
n-grams of host and path are hashed to buckets, and Spark's own logistic
regression is fitted to the buckets' vectors. The weights become one literal array, so scoring is a projection without join or shuffle. The labelled
table is made from word lists, without reference to any other table's hosts: a
fifth of its rows are unwanted, which is the base rate that an unknown url gets.
Held-out rows, with other hosts and paths, set the score at which a url is blocked.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule, and is scored like any other; repeated rows are scored each
on its own. The labelled table must be small (MAX_LABELLED rows at most).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from zlib import crc32

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docloom.llm.common import table

BUCKETS = 1 << 13
GRAM_SIZES = (3, 4, 5)
STEPS, PENALTY = 40, 1e-4
#: The labelled table is read into one task; more rows than this are refused.
MAX_LABELLED = 2_000
#: Held-out urls of the wanted kind that may be blocked, as a share.
MAX_FALSE = 0.005


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)

#: Words that made-up hosts of the labelled table are about.
UNWANTED = """
casino poker roulette blackjack slots jackpot betting bookmaker sportsbook lottery gambling wager viagra cialis
pharmacy pills steroids slimming escorts porn xxx webcams sexchat nudes hentai payday loans debtfix doubler giveaway
prize winner warez keygen cracked torrents nulled serials replica knockoff adserver clicktrack popunder bannerads
malware phishing spam bulkmail linkfarm doorway
"""
WANTED = """
library gardening newspaper weather compiler university kitchen museum council travel chess physics transport
archive poetry birds textbook recipes hospital orchestra theatre language farmers hiking journal school woodwork
astronomy encyclopedia railway standards teachers festival lighthouse spa bakery biology software painting geology
football choir parliament history chemistry village harbour sailing forest river mountain island castle market
bookshop cinema concert dance design drawing economics education energy engineering family fashion film fishing
flowers folklore furniture geography glass grammar guitar health horses housing insects jazz justice kids
knitting lakes law letters logic maps maths medicine memory mills minerals motors music nature networks
novels nursery ocean opera optics orchard parks pets philosophy photos piano planets plants pottery printing
psychology puzzles radio reading robots rocks roses running science sculpture seeds shipping singing skating
snow soil songs space sports statistics stories students sugar swimming tea tennis textiles tools towns trains
trees valley vets violin volcano walking water whales wildlife wine winter wood wool writing yoga zoology
"""
#: What hosts and paths of both kinds are made with, so that it carries no weight.
STARTS = ("", "my", "the", "best-", "new", "all-", "world", "top", "local-", "e", "24", "our", "real-")
ENDS = ("", "s", "-online", "hub", "-world", "24", "net", "-club", "zone", "-info", "city")
DOMAINS = ("www.{}.invalid", "{}.invalid", "blog.{}.test", "m.{}.invalid", "{}.co.test")
PATHS = ("/", "/en/{}", "/fr/{}.html", "/index.html", "/es/{}/", "/blog/20{}/post", "/de/{}?page=2", "/about", "/products/item-{}", "/a/b/c{}.php?id=7", "/wiki/Page_{}")


URLS_EACH = 7


def labelled_rows() -> list[tuple[str, int, bool]]:
    """(url, label, held out) of the small labelled table: 1 is unwanted. Each word has URLS_EACH urls; one of them is held out, with another host and path."""
    out = []
    for words, label in ((UNWANTED.split(), 1), (WANTED.split(), 0)):
        for k, word in enumerate(words):
            for at, n in enumerate(crc32(f"{word}{at}".encode()) for at in range(URLS_EACH)):
                host = DOMAINS[n % len(DOMAINS)].format(STARTS[n // 7 % len(STARTS)] + word + ENDS[n // 101 % len(ENDS)])
                out.append((f"http{'s' * (n % 2)}://{host}{PATHS[n // 1009 % len(PATHS)].format(n % 9000)}", label, at == 0))
    return out


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...], field: str) -> Column:
    """A field of the longest rule that fits the host or a parent domain and the path's start; else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, field))).otherwise(out)
    return out


def buckets(host: Column, path: Column, n: int = BUCKETS, sizes: tuple[int, ...] = GRAM_SIZES) -> Column:
    """The distinct hash buckets of the n-grams of ``^host|path$``, in time proportional to their length."""
    text = F.concat(F.lit("^"), host, F.lit("|"), F.lower(path), F.lit("$"))

    def grams(chars: Column, size: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(chars) - size, F.lit(0)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(*[F.get(chars, i + k) for k in range(size)]), F.lit(n)).cast("int"))

    return F.transform(F.array(F.split(text, "")), lambda chars: F.array_distinct(F.concat(*[grams(chars, size) for size in sizes])))[0]


def literal_array(values) -> Column:
    return F.expr(f"array({','.join(f'{v!r}D' for v in values)})")


@dataclass(frozen=True)
class UrlModel:
    weights: tuple[float, ...]
    bias: float
    block_at: float = 0.5

    def score(self, host: Column, path: Column) -> Column:
        """The chance that a url is unwanted; its features are scaled to unit length."""
        weights = literal_array(self.weights)
        total = lambda b: F.aggregate(b, F.lit(0.0), lambda s, k: s + weights[k]) / F.sqrt(F.size(b))
        margin = F.transform(F.array(buckets(host, path, len(self.weights))), total)[0] + self.bias
        return 1 / (1 + F.exp(-margin))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", steps: int = STEPS, penalty: float = PENALTY) -> UrlModel:
    """Fit by Spark's logistic regression; rows without a label are left out. A table of one label gives its share."""
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.col(label_col).cast("double").alias("label"), buckets(host_of(F.col(url_col)), path_of(F.col(url_col))).cast("array<string>").alias("terms"))
    rows = rows.limit(MAX_LABELLED + 1).repartition(1).cache()  # a small table
    try:
        counts = rows.agg(F.count("*").alias("n"), F.avg("label").alias("share")).first()
        if not 0 < counts["n"] <= MAX_LABELLED:
            raise ValueError(f"the labelled table must have 1 to {MAX_LABELLED} rows")
        if counts["share"] in (0.0, 1.0):
            return UrlModel((0.0,) * BUCKETS, 30.0 if counts["share"] else -30.0)
        vectors = CountVectorizer(inputCol="terms", outputCol="counts", vocabSize=BUCKETS, binary=True).fit(rows)
        features = Normalizer(inputCol="counts", outputCol="features").transform(vectors.transform(rows))
        fitted = LogisticRegression(maxIter=steps, regParam=penalty, standardization=False).fit(features)
    finally:
        rows.unpersist()
    weights = [0.0] * BUCKETS
    for bucket, weight in zip(vectors.vocabulary, fitted.coefficients.toArray(), strict=True):
        weights[int(bucket)] = round(float(weight), 6)
    return UrlModel(tuple(weights), float(fitted.intercept))


def calibrated(model: UrlModel, held_out: DataFrame, url_col: str = "url", label_col: str = "label", max_false: float = MAX_FALSE) -> UrlModel:
    """``model`` with a score to block at: half way between even odds and the score that all but ``max_false`` of the held-out wanted urls stay below.

    Urls of words that the table does not have vary more than its own, hence the margin.
    """
    url = F.col(url_col)
    wanted = held_out.where(F.col(label_col) == 0).select(model.score(host_of(url), path_of(url)).alias("score"))
    limit = wanted.agg(F.percentile("score", F.lit(1 - max_false)).alias("score")).first()["score"]
    return replace(model, block_at=(0.5 + limit) / 2 if limit is not None else 0.5)


def filter_urls(pages: DataFrame, model: UrlModel, rules: tuple[Rule, ...] = RULES, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, score and verdict (a rule's, else the model's); columns of these names, in any case, are replaced."""
    made = {"host", "path", "rule", "score", "verdict"}
    url = F.col(f"`{url_col}`")
    split = pages.drop(*[c for c in pages.columns if c.lower() in made]).withColumns({"host": host_of(url), "path": path_of(url)})
    host, path = F.col("host"), F.col("path")
    scored = split.withColumns({"rule": rule_of(host, path, rules, "name"), "score": model.score(host, path)})
    return scored.withColumn("verdict", F.coalesce(rule_of(host, path, rules, "verdict"), F.when(F.col("score") >= model.block_at, "block").otherwise("allow")))


def labelled_urls(spark: SparkSession, held_out: bool = False) -> DataFrame:
    """url and label of the labelled table's rows for training, or of those held out."""
    text = "\n".join(f"{label} {url}" for url, label, held in labelled_rows() if held == held_out)
    rows = spark.range(1).select(F.explode(F.split(F.lit(text), "\n")).alias("row"))
    return rows.select(F.substring_index("row", " ", -1).alias("url"), F.substring_index("row", " ", 1).cast("int").alias("label"))


_fitted: dict[str, UrlModel] = {}


def default_model(spark: SparkSession) -> UrlModel:
    """The model of the labelled table, which is fixed: it is fitted once in each driver process."""
    if "default" not in _fitted:
        _fitted["default"] = calibrated(train(labelled_urls(spark)), labelled_urls(spark, held_out=True))
    return _fitted["default"]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, default_model(spark)).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))
