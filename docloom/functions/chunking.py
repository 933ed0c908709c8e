"""Parent and child chunks with exact byte spans.

Text is cut at the highest level (blank lines, lines, sentences, words,
characters) whose pieces fit the size; neighbours are merged up to the size and
trimmed. Child chunks of one parent may overlap by whole words. Markdown is cut
before its headings first, from the highest to the lowest, then between blocks,
then before list items; a code fence is one block, cut by lines only if it
exceeds the size itself.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from docloom.functions.batches import portions
from docloom.functions.layout import span_pages

PARENT_SIZES = {"markdown": 2048, "docx": 2048, "epub": 2048, "youtube": 2048}
PARENT_DEFAULT, CHILD, OVERLAP = 1024, 256, 25
#: Bytes of text that a task cuts at once: its chunks are Python objects of many times that.
TEXT_BYTES = 1 << 20
#: Source types that hold Markdown.
MARKDOWN_TYPES = ("markdown", "docx", "epub", "youtube")
LEVELS = [re.compile(r"\n[ \t]*\n\s*"), re.compile(r"\n"), re.compile(r"(?<=[.!?])\s+"), re.compile(r"\s+")]


FENCE = re.compile(r"^ {0,3}(`{3,}(?=[^`\n]*$)|~{3,})[^\n]*\n?", re.M)
HEADING = re.compile(r"^ {0,3}(#{1,6})(?=[ \t]|$)", re.M)
ITEM = re.compile(r"^[ \t]*(?:[-*+]|[0-9]{1,9}[.)])(?=[ \t])", re.M)


def fences(text: str) -> list[tuple[int, int]]:
    """Spans of code fences, with their marks; one that is not closed goes to the end."""
    out, at = [], 0
    while found := FENCE.search(text, at):
        mark = found[1]
        close = re.compile(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*(?:\n|\Z)", re.M).search(text, found.end())
        at = close.end() if close else len(text)
        out.append((found.start(), at))
        if at == len(text):
            break
    return out


def markdown_levels(text: str) -> list:
    """Places to cut Markdown at, from the highest level to the lowest: six of headings, blocks, list items, then ``LEVELS``."""
    code = fences(text)
    starts = [a for a, _ in code]

    def outside(places: list[int]) -> list[int]:
        return [p for p in places if not (k := bisect_right(starts, p)) or p >= code[k - 1][1]]

    headings = [(len(m[1]), m.start()) for m in HEADING.finditer(text)]
    by_depth = [outside([p for depth, p in headings if depth <= top]) for top in range(1, 7)]
    blocks = sorted({*by_depth[-1], *outside([m.end() for m in LEVELS[0].finditer(text)]), *(p for span in code for p in span)})
    items = sorted({*blocks, *outside([m.start() for m in ITEM.finditer(text)])})
    return [*by_depth, blocks, items, *LEVELS[1:]]


def places(level, text: str, start: int, end: int) -> list[int]:
    """Where a level cuts between start and end: its own sorted places, or the ends of its matches."""
    if isinstance(level, list):
        return level[bisect_right(level, start) : bisect_left(level, end)]
    return [m.end() for m in level.finditer(text, start, end)]


def spans(text: str, size: int, start: int = 0, end: int | None = None, level: int = 0, levels: list = LEVELS) -> list[tuple[int, int]]:
    """Character spans of at most ``size`` characters that cover all but white space."""
    end = len(text) if end is None else end
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    if start == end:
        return []
    if end - start <= size:
        return [(start, end)]
    if level == len(levels):
        return [(a, min(a + size, end)) for a in range(start, end, size)]
    cuts = [start, *places(levels[level], text, start, end), end]
    out: list[tuple[int, int]] = []
    begin = start
    for left, right in zip(cuts, cuts[1:]):
        if len(text[begin:right].rstrip()) <= size:
            continue
        if left > begin:
            out += spans(text, size, begin, left, level + 1, levels)
        begin = left
    return out + spans(text, size, begin, end, level + 1, levels)


def overlapped(text: str, found: list[tuple[int, int]], overlap: int, size: int) -> list[tuple[int, int]]:
    """Each span but the first, begun earlier by up to ``overlap`` characters at a word, within the size."""
    out = found[:1]
    for (before, _), (start, end) in zip(found, found[1:]):
        low = max(before + 1, start - overlap, end - size)
        word = re.compile(r"(?<=\s)\S").search(text, low, start) if low < start else None
        out.append((word.start() if word else start, end))
    return out


def chunk_text(text: str, parent_size: int, child_size: int = CHILD, overlap: int = OVERLAP, markdown: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(parent index, parent start, parent end, child start, child end) in characters; a parent within a child's size is not cut."""
    out = []
    levels = markdown_levels(text) if markdown else LEVELS
    for number, (a, b) in enumerate(spans(text, parent_size, levels=levels)):
        children = [(a, b)] if b - a <= child_size else overlapped(text, spans(text, child_size, a, b, levels=levels), overlap, child_size)
        out += [(number, a, b, c, d) for c, d in children]
    return out


CHUNK = T.StructType([T.StructField("parent", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("parent_start", "parent_end", "start", "end")), T.StructField("content", T.StringType())])


CHUNK_ARROW = pa.list_(pa.struct([("parent", pa.int32()), *((n, pa.int64()) for n in ("parent_start", "parent_end", "start", "end")), ("content", pa.string())]))


def chunk_rows(body: str | None, parent_size: int, markdown: bool = False) -> list[dict]:
    """The chunks of one text, with spans in bytes of UTF-8; a null text has none."""
    body = body or ""
    sizes = [0]
    if body.isascii():
        at = lambda p: p
    else:
        for c in body:
            sizes.append(sizes[-1] + len(c.encode()))
        at = sizes.__getitem__
    return [{"parent": n, "parent_start": at(a), "parent_end": at(b), "start": at(c), "end": at(d), "content": body[c:d]} for n, a, b, c, d in chunk_text(body, parent_size, markdown=markdown)]


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", parent_size: int = PARENT_DEFAULT) -> DataFrame:
    """key, chunk_index, parent, byte spans, content, content_hash of every chunk of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text", TEXT_BYTES):
                rows = [chunk_rows(body, parent_size) for body in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(rows, CHUNK_ARROW)], names=["key", "chunks"])

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    made = source.mapInArrow(run, T.StructType([source.schema["key"], T.StructField("chunks", T.ArrayType(CHUNK))]))
    out = made.select(F.col("key").alias(key), F.posexplode("chunks").alias("chunk_index", "c"))
    return out.select(key, "chunk_index", "c.*").withColumn("content_hash", F.sha2("content", 256))


def chunk_sources(layouts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks of ``layout.page_layouts``, with sizes and cuts by source type, and the first and last page of each.

    ``layouts`` has key, kind, paginated, text, page_starts. A kind that is null or
    unknown is cut as plain text; without pages, first_page and last_page are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text", TEXT_BYTES):
                pairs = zip(part.column("text").to_pylist(), part.column("kind").to_pylist(), strict=True)
                rows = [chunk_rows(body, PARENT_SIZES.get(kind, PARENT_DEFAULT), kind in MARKDOWN_TYPES) for body, kind in pairs]
                kept = [part.column(c) for c in ("key", "kind", "paginated", "page_starts")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, CHUNK_ARROW)], names=["key", "kind", "paginated", "page_starts", "chunks"])

    source = layouts.select(F.col(key).alias("key"), "kind", "paginated", "page_starts", "text")
    made = source.mapInArrow(run, T.StructType([*source.schema.fields[:4], T.StructField("chunks", T.ArrayType(CHUNK))]))
    out = made.select(F.col("key").alias(key), "kind", "paginated", "page_starts", F.posexplode("chunks").alias("chunk_index", "c")).select("*", "c.*")
    first, last = span_pages(F.col("page_starts"), F.col("start"), F.col("end"))
    numbered = [F.when(F.col("paginated"), p).alias(n) for p, n in ((first, "first_page"), (last, "last_page"))]
    return out.select(key, "kind", "chunk_index", "parent", "parent_start", "parent_end", "start", "end", *numbered, "content", F.sha2("content", 256).alias("content_hash"))


def span_violations(docs: DataFrame, chunks: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk_index of chunks whose span does not give back their content."""
    both = chunks.join(docs.select(key, F.encode(text, "UTF-8").alias("raw")), key)
    cut = F.substring(F.col("raw"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return both.where(cut != F.encode("content", "UTF-8")).select(key, "chunk_index")
