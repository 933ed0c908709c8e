"""Whether rendered evidence keeps hostile passages inside of their elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docloom.functions.text import strip
from docloom.operators.grounding import REGION_CLOSE, REGION_OPEN

#: The entities that the renderer writes, the ampersand last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def xml_unescape(text: Column) -> Column:
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def occurrences(text: Column, part: str) -> Column:
    return F.size(F.split(text, rf"\Q{part}\E", -1)) - 1


def isolation_violations(regions: DataFrame, key: str) -> DataFrame:
    """key, property for each property that a region of evidence breaks.

    ``regions`` has key, evidence (as ``grounding.evidence`` renders it) and bodies,
    the array of its passages in order. A null passage counts as empty.

    * one_region: one opening and one closing tag
    * nothing_outside: the region begins and ends with these tags
    * one_element_each: as many source and content elements as passages
    * escaped: no passage with markup stands there as it is
    * reads_back: the contents, read again, are the passages
    """
    text, bodies = F.coalesce("evidence", F.lit("")), F.transform("bodies", lambda b: strip(F.coalesce(b, F.lit(""))))
    n = F.size("bodies")
    back = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<content>\n(.*?)\n</content>"), 1), xml_unescape)
    raw = F.exists(bodies, lambda b: F.contains(b, F.lit("<")) & F.contains(text, b))
    rules = {
        "one_region": (occurrences(text, REGION_OPEN) != 1) | (occurrences(text, REGION_CLOSE) != 1),
        "nothing_outside": ~F.startswith(text, F.lit(REGION_OPEN)) | (F.instr(text, REGION_CLOSE) != F.length(text) - len(REGION_CLOSE) + 1),
        "one_element_each": (occurrences(text, "</content>") != n) | (occurrences(text, "<source ") != n) | (occurrences(text, "</source>") != n),
        "escaped": raw,
        "reads_back": back != bodies,
    }
    found = F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules.items()]))
    return regions.select(key, F.explode(found).alias("property"))
