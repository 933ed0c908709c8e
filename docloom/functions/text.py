"""Text functions as column expressions, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Acknowledgements that carry nothing worth remembering.
TRIVIAL = [
    "ok", "okay", "yes", "no", "yep", "nope", "sure", "thanks", "thank you", "merci", "oui", "non", "d'accord", "ok merci",
    "parfait", "super", "great", "got it", "understood", "noted", "cool", "awesome", "nice", "good", "fine", "alright", "right",
]
#: Words by which a question refers to what was said before.
MARKERS = [
    " it ", " its ", " this ", " that ", " these ", " those ", " them ", " they ", " their ", " he ", " she ", " him ", " her ",
    "the same", "the previous", "the last", "the above", "compared to", "compare with", "what about", "how about",
    " il ", " elle ", " ils ", " elles ", " ce ", " cet ", " cette ", " ces ", " celui ", " celle ", " ceux ", " celles ",
    " le même", " la même", " les mêmes", " précédent", " dernier", " ci-dessus", "par rapport", "et pour", "qu'en est",
]
#: Error categories in the order of precedence, with the words that tell them.
ERRORS = [
    ("ocr_error", ["ocr"]),
    ("pdf_parse_error", ["pdf"]),
    ("embedding_error", ["embedding"]),
    ("timeout", ["timeout", "timed out"]),
    ("chunking_error", ["chunk"]),
    ("extraction_error", ["extract", "scrape", "firecrawl"]),
    ("validation_error", ["size", "too large", "empty"]),
]
LOCALES = ["fr", "de", "es"]


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def unix_lines(text: Column) -> Column:
    """Without NUL and form feed, with one kind of line end."""
    return F.regexp_replace(F.regexp_replace(text, "[\\x00\\f]", ""), r"\r\n?", "\n")


def sanitize(text: Column) -> Column:
    """Delete what is neither a letter, a number nor white space, and collapse blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def lexical_tokens(text: Column) -> Column:
    """Lower-cased words of the sanitised text."""
    return F.filter(F.split(F.lower(sanitize(text)), " "), lambda x: x != "")


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and numbers."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def plain_clean(text: Column) -> Column:
    """Trimmed lines without blank ones, after unifying line ends."""
    return compact_lines(unix_lines(text))


def markdown_clean(text: Column) -> Column:
    """Lines trimmed at their ends; one blank line between lines goes, two or more become one."""
    bare = F.regexp_replace(F.regexp_replace(unix_lines(text), r"[ \t]+(\n|$)", "$1"), r"^\n+|\s+$", "")
    marked = F.regexp_replace(F.regexp_replace(bare, r"\n{3,}", "\x01"), r"\n\n", "\n")
    return F.replace(marked, F.lit("\x01"), F.lit("\n\n"))


def compact_lines(text: Column) -> Column:
    """Drop blank lines and trim the others."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), "\n")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def query_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def stable_uuid(text: Column) -> Column:
    """A version-4 shaped UUID from the first 16 bytes of SHA-256."""
    h = F.sha2(text, 256)
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def truncate(text: Column, size: int) -> Column:
    """At most ``size`` characters, the last three of them dots if anything was cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 3), F.lit("..."))).otherwise(text)


def truncate_at_word(text: Column, size: int) -> Column:
    """Cut at the last blank or comma within ``size`` characters and add an ellipsis."""
    head = F.substring(text, 1, size)
    cut = F.regexp_extract(head, r"(?s)^(.*)[ ,]", 1)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.when(cut == "", head).otherwise(cut), F.lit("…")))


def xml_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for char, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def heading(line: Column) -> Column:
    """The text of an ATX heading of level 1 to 4, else null."""
    found = F.trim(F.regexp_extract(line, r"^\s*#{1,4} (.*)$", 1))
    return F.when(found != "", found)


def keywords(text: Column, min_bytes: int = 5) -> Column:
    """Sorted distinct words of at least ``min_bytes`` bytes."""
    bare = F.transform(F.split(F.lower(text), r"\s+"), lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda x: F.octet_length(x) >= min_bytes)))


def topic_overlap(words: Column, content: Column) -> Column:
    low = F.lower(content)
    return F.exists(words, lambda w: F.contains(low, w))


def strip_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?", ""), r"```$", ""))


def contextualize(prefix: Column, content: Column) -> Column:
    return F.when(F.coalesce(F.trim(prefix), F.lit("")) == "", content).otherwise(F.concat(prefix, F.lit("\n\n"), content))


def minutes_seconds(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("bigint")
    return F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60)


def locale(code: Column) -> Column:
    out = F.lit("en")
    for known in LOCALES:
        out = F.when(code.startswith(known), known).otherwise(out)
    return out


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def error_category(message: Column) -> Column:
    """The first category whose words occur in an error message."""
    low = F.lower(message)
    out = F.lit("unknown_error")
    for name, words in reversed(ERRORS):
        out = F.when(contains_any(low, words), name).otherwise(out)
    return out


def video_id(url: Column) -> Column:
    """The eleven-character id of a video url, else null."""
    host = F.regexp_extract(url, r"^https?://(?:www\.|m\.)?([^/?#]+)", 1)
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    watch = F.when(path.startswith("/watch"), F.regexp_extract(url, r"[?&]v=([^&#]*)", 1)).otherwise(F.regexp_extract(path, r"^/(?:embed|shorts|live)/([^/]+)", 1))
    found = F.when(host == "youtube.com", watch).when(host == "youtu.be", F.regexp_extract(path, "^/([^/]+)", 1))
    return F.when(found.rlike(r"^[A-Za-z0-9_-]{11}$"), found)


def citation_url(video: Column, start: Column) -> Column:
    """The address of a video at a time in seconds; null without either."""
    return F.concat(F.lit("https://youtube.com/watch?v="), video, F.lit("&t="), F.floor(start).cast("string"))


#: How files of the kinds begin that are taken; zip holds documents and books.
MAGIC = {"pdf": b"%PDF-", "zip": b"PK\x03\x04"}


def file_kind(data: Column) -> Column:
    """The kind that the first bytes of a file tell, or null."""
    return F.coalesce(*[F.when(F.substring(data, 1, len(first)) == F.lit(first), kind) for kind, first in MAGIC.items()])


def is_trivial(message: Column, min_bytes: int = 20) -> Column:
    letters = F.lower(F.trim(F.regexp_replace(message, r"[^\p{L}\s]", "")))
    return (F.octet_length(strip(message)) < min_bytes) | letters.isin(*TRIVIAL)


def needs_rewrite(message: Column, min_bytes: int = 60) -> Column:
    """Whether a question leans on earlier turns: it is short, or holds a referring word."""
    return (F.octet_length(message) < min_bytes) | contains_any(F.lower(message), MARKERS)


def token_estimate(text: Column) -> Column:
    """Rounded-up token estimate of a client-side limiter: four bytes a token and a tenth more."""
    return F.ceil(F.octet_length(text) / F.lit(4.0) * F.lit(1.1)).cast("bigint")


def question_lines(text: Column, limit: int = 3, most: int = 200) -> Column:
    """The first lines that end in a question mark and have at most ``most`` bytes."""
    lines = F.transform(F.split(text, "\n"), strip)
    return F.slice(F.filter(lines, lambda q: q.endswith("?") & (F.octet_length(q) <= most)), 1, limit)
