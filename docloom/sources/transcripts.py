"""Caption tracks and transcripts: the choice of a track, XML and JSON transcripts as rows, and character references, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docloom.functions.text import strip

# The entities that XML predefines.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_PARTS = r"(?s)[^&]+|&(?:#[0-9]+|#x[0-9a-fA-F]+|[A-Za-z_][A-Za-z0-9_.-]*);|&"
_JSON = "struct<events: array<struct<tStartMs: bigint, dDurationMs: bigint, segs: array<struct<utf8: string>>>>>"


def resolve_entities(text: Column, keep_unknown: bool = True) -> Column:
    """Text with numeric character references and XML's own entities resolved, each once.

    A reference that is none of these, or to no character (0, a surrogate,
    beyond U+10FFFF), stays as it is written or goes; a lone ampersand stays.
    Null is null.
    """

    def resolved(part: Column) -> Column:
        name = F.regexp_extract(part, r"^&(.*);$", 1)
        digits = F.when(name.startswith("#x"), F.conv(F.substring(name, 3, 1 << 20), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 1 << 20))
        # more than seven figures are no character; leading zeros are none of them
        short = F.regexp_replace(digits, "^0+", "")
        code = F.when((F.length(short) > 0) & (F.length(short) <= 7), short.try_cast("bigint"))
        is_char = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.when(is_char, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        known = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))[name]
        return F.when(~part.startswith("&") | (F.length(part) == 1), part).otherwise(F.coalesce(char, known, part if keep_unknown else F.lit("")))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PARTS), 0), resolved), "")


def caption_track(tracks: Column, languages: list[Column]) -> Column:
    """The track to read, of an array of structs with language and kind: for each wanted language one that a person wrote, then any; then the first that a person wrote, then the first. Null without tracks."""
    manual = lambda t: ~t["kind"].eqNullSafe("asr")
    first = lambda keep: F.get(F.filter(tracks, keep), F.lit(0))

    def of(language: Column) -> list[Column]:
        return [first(lambda t: (t["language"] == language) & manual(t)), first(lambda t: t["language"] == language)]

    return F.coalesce(*(found for language in languages for found in of(language)), first(manual), F.get(tracks, F.lit(0)))


def _xml_snippets(content: Column) -> Column:
    elements = F.regexp_extract_all(content, F.lit(r"(?s)<text(?:\s[^>]*)?(?<!/)>.*?</text\s*>"), 0)

    def snippet(element: Column) -> Column:
        head = F.regexp_extract(element, r"(?s)^<text([^>]*)>", 1)
        seconds = lambda name: F.coalesce(F.regexp_extract(head, rf"\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1).try_cast("double"), F.lit(0.0))
        body = F.regexp_extract(element, r"(?s)^<text[^>]*>(.*)</text\s*>$", 1)
        plain = F.regexp_replace(body, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[^>]*>", "")
        return F.struct(seconds("start").alias("start"), seconds("dur").alias("duration"), strip(resolve_entities(plain, keep_unknown=False)).alias("text"))

    return F.transform(elements, snippet)


def _json_snippets(content: Column) -> Column:
    def snippet(event: Column) -> Column:
        text = F.array_join(F.transform(event["segs"], lambda s: F.coalesce(s["utf8"], F.lit(""))), "")
        seconds = lambda name: F.coalesce(event[name], F.lit(0)) / 1000.0
        return F.struct(seconds("tStartMs").alias("start"), seconds("dDurationMs").alias("duration"), strip(text).alias("text"))

    return F.transform(F.filter(F.from_json(content, _JSON)["events"], lambda e: F.size(e["segs"]) > 0), snippet)


def transcript_snippets(files: DataFrame, key: str, content: str) -> DataFrame:
    """key, position, start, duration, text of every snippet of XML or JSON transcripts.

    What begins with a brace is read as JSON. Times that cannot be read are 0,
    snippets without a visible character go, positions count the others from 0.
    A null, empty or broken transcript gives no rows.
    """
    text = F.col(content)
    both = F.when(F.ltrim(text).startswith("{"), _json_snippets(text)).otherwise(_xml_snippets(text))
    said = F.filter(both, lambda s: F.length(s["text"]) > 0)
    return files.select(key, F.posexplode(said).alias("position", "s")).select(key, "position", "s.start", "s.duration", "s.text")
