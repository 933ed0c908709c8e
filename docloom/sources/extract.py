"""Readers of document formats: each maps a binaryFile or text DataFrame to text rows inside tasks."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Source types and their aliases.
SOURCE_TYPES = {"pdf": "pdf", "docx": "docx", "epub": "epub", "text": "text", "txt": "text", "markdown": "markdown", "md": "markdown", "web": "web", "url": "web", "youtube": "youtube", "yt": "youtube"}
MAX_UNZIPPED = 200 << 20
BREAKS = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6"}


def source_type(name: F.Column) -> F.Column:
    """The canonical source type of a name or alias in any case, else null."""
    pairs = [x for k, v in SOURCE_TYPES.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[F.lower(F.trim(name))]


class BodyText(HTMLParser):
    """Text nodes trimmed and joined by blanks, headings marked, a line end after each block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if re.fullmatch("h[1-6]", tag):
            self.out.append("\n" + "#" * int(tag[1]) + " ")
        elif tag == "br":
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in BREAKS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.out.append(" ".join(data.split()) + " ")


def html_text(html: str | None) -> str:
    parser = BodyText()
    body = re.search(r"(?is)<body[^>]*>(.*)", html or "")
    parser.feed(body[1] if body else html or "")
    parser.close()
    lines = (" ".join(line.split()) for line in "".join(parser.out).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def unzip(data: bytes) -> zipfile.ZipFile:
    archive = zipfile.ZipFile(io.BytesIO(data))
    if sum(i.file_size for i in archive.infolist()) > MAX_UNZIPPED:
        raise ValueError("the archive unpacks to too much data")
    return archive


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX file; heading styles become Markdown headings, list items get a dash."""
    out = []
    for p in ElementTree.fromstring(unzip(data).read("word/document.xml")).iter():
        if local(p) != "p":
            continue
        style = next((v for e in p.iter() if local(e) == "pStyle" for k, v in e.attrib.items() if k.endswith("val")), "")
        text = "".join(e.text or "" if local(e) == "t" else "\t" if local(e) == "tab" else "" for e in p.iter()).strip()
        level = re.fullmatch(r"(?:Heading|Titre)([1-6])", style)
        prefix = "#" * int(level[1]) + " " if level else "# " if style == "Title" else "- " if "List" in style or any(local(e) == "numPr" for e in p.iter()) else ""
        if text:
            out.append(prefix + text)
    return "\n\n".join(out)


def epub_text(data: bytes) -> str:
    """Chapters of an EPUB file in spine order, separated by rules."""
    archive = unzip(data)
    root = next(e.attrib["full-path"] for e in ElementTree.fromstring(archive.read("META-INF/container.xml")).iter() if local(e) == "rootfile")
    package = ElementTree.fromstring(archive.read(root))
    files = {e.attrib["id"]: e.attrib["href"] for e in package.iter() if local(e) == "item"}
    spine = [files[e.attrib["idref"]] for e in package.iter() if local(e) == "itemref" and e.attrib["idref"] in files]
    chapters = (html_text(archive.read(posixpath.normpath(posixpath.join(posixpath.dirname(root), name))).decode("utf-8", "replace")) for name in spine)
    return "\n\n---\n\n".join(c for c in chapters if c)


def extract(files: DataFrame, reader: Callable[[bytes], str], content: str = "content", key: str = "path") -> DataFrame:
    """key, text, error of every file of a binaryFile DataFrame; a file that cannot be read has a null text and says why."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for data in frame["content"]:
                try:
                    rows.append((reader(bytes(data)), None))
                except (ValueError, KeyError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({"key": frame["key"], "text": [r[0] for r in rows], "error": [r[1] for r in rows]})

    return files.select(F.col(key).alias("key"), F.col(content).alias("content")).mapInPandas(run, "key string, text string, error string").withColumnRenamed("key", key)


def html_column(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and the body text of every page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "text": [html_text(h) for h in frame[html]]})

    return pages.select(key, html).mapInPandas(run, f"{key} bigint, text string")


def transcript_sections(snippets: DataFrame, key: str, seconds: int = 60) -> DataFrame:
    """key, markdown: sections of a transcript, each opened by the first snippet after the last one's end.

    snippets: key, start, text. One transcript is one row of bounded size.
    """
    ordered = snippets.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("s"))
    stamp = lambda x: f"format_string('[%02d:%02d]', CAST(floor({x} / 60) AS BIGINT), CAST({x} AS BIGINT) % 60)"
    step = f"""(a, x) -> CASE WHEN a.until IS NULL OR x.start >= a.until
      THEN named_struct('until', x.start + {float(seconds)}D, 'out', concat(a.out, CASE WHEN a.out = '' THEN '' ELSE '\\n\\n' END, '## ', {stamp('x.start')}, '\\n', {stamp('x.start')}, ' ', x.text))
      ELSE named_struct('until', a.until, 'out', concat(a.out, '\\n', {stamp('x.start')}, ' ', x.text)) END"""
    return ordered.select(key, F.expr(f"aggregate(transform(s, x -> named_struct('start', CAST(x.start AS DOUBLE), 'text', x.text)), named_struct('until', CAST(NULL AS DOUBLE), 'out', ''), {step}, a -> a.out)").alias("markdown"))
