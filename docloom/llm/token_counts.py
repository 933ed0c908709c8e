"""Exact token counts at every prefix (operator 8).

A text is cut into the pieces of the byte-level pre-tokenizer. Inside a piece a
dynamic program over its prefixes finds, for every prefix, the one last token
that can end a valid byte-pair encoding of it: token ``t`` may follow the last
token ``s`` of the remaining prefix if and only if encoding ``s + t`` alone
gives back ``[s, t]``. The count of a prefix is one more than that of the
prefix it extends. Piece results are kept in a bounded cache, so a repeated
word costs one lookup. Counts at every prefix answer truncation and budget
questions without encoding again; a prefix that ends where the pre-tokenizer
would part the text otherwise adds the few characters since the last safe cut.

Defined results: a null text counts as empty (0 bytes, 0 tokens). The string of
a special token inside a text counts as that one token, as the library does by
default. Prefixes end between characters.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left

import numpy as np
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from tokenizers.pre_tokenizers import ByteLevel

from docloom.llm.common import append_columns, table

#: Pieces and token pairs remembered by one Python worker.
CACHE_ENTRIES = 400_000
#: A place before a blank and a letter, or at the first letter of a line, always begins a piece.
SAFE_CUT = re.compile(r" (?=[A-Za-z])|(?<=\S\n)(?=[A-Za-z])")
#: Tokens by which a prefix that ends inside of a piece can have fewer than those that end before it.
SLACK = 32
#: The token budget of the registered query.
LIMIT = 1024
#: Unicode white space, as the library's pre-tokenizer takes it.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Texts without these hold no character on which regex engines of different age differ.
BEYOND_LATIN = re.compile(r"[^\x00-\u052f]")
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def newer_characters() -> str:
    """Letters and numbers that are newer than Python's own tables: the two regex engines may differ on them."""
    known = regex.compile(r"[\p{L}\p{N}]")
    return "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn" and known.match(c))


def byte_alphabet() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PieceCounts(dict):
    """piece -> the token count of all of it; fills itself by dynamic programming."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.suffixes = {token[i:] for token in ranks for i in range(1, len(token))}
        self.merge = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their bytes are merged on their own."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= 2 * CACHE_ENTRIES:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return found

    def prefixes(self, data: bytes) -> list[int]:
        """Token counts of data[:0], data[:1], ... data."""
        find, ends, pairs = self.ranks.get, self.suffixes, self.pairs.get
        counts, last, begin = [0], [-1], 0
        for end in range(1, len(data) + 1):
            token = find(data[begin:end])  # most often the last token just grows
            if token is None or begin and not (pairs((last[begin], token)) or self.compatible(last[begin], token)):
                for begin in range(end - 1, -1, -1):
                    part = data[begin:end]
                    token = find(part)
                    if token is not None and (not begin or pairs((last[begin], token)) or self.compatible(last[begin], token)):
                        break
                    if part not in ends:
                        raise ValueError("a byte is not in the vocabulary")
            counts.append(counts[begin] + 1)
            last.append(token)
        return counts

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        count = self.prefixes(piece.encode())[-1]
        if len(piece) <= 64:
            self[piece] = count
        return count


class PrefixCounter:
    """Token counts of texts and of all their prefixes under a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        special = [t["content"] for t in spec["added_tokens"]]
        ranks = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merged = [ranks[as_bytes("".join(m.split(" ") if isinstance(m, str) else m))] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids must be in the order of the merges")
        self.pieces = PieceCounts(ranks)
        self.newer = re.compile(f"[{newer_characters()}]")
        self.library = ByteLevel(add_prefix_space=False, use_regex=True)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

    def segments(self, text: str) -> list[tuple[int, int, bool]]:
        """(start, end, is a special token) of the parts of a text."""
        out, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            out += [(at, m.start(), False), (m.start(), m.end(), True)]
            at = m.end()
        return out + [(at, len(text), False)]

    def total(self, text: str | None) -> int:
        """Tokens of the whole text: the last entry of counts(text)."""
        if not text:
            return 0
        get = self.pieces.__getitem__
        return sum(1 if special else sum(map(get, self.split(text[start:end]))) for start, end, special in self.segments(text))

    def split(self, text: str) -> list[str]:
        """The pre-tokenizer's pieces of a text without special tokens."""
        if not BEYOND_LATIN.search(text) or not self.newer.search(text):
            return PIECE.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def counts(self, text: str | None) -> np.ndarray:
        """counts[p] is the number of tokens of text[:p] on its own, for every p from 0 to len(text)."""
        text = text or ""
        out, base = np.zeros(len(text) + 1, dtype=np.int64), 0
        for start, end, special in self.segments(text):
            if special:
                cut = self.safe_cut(text, start)
                for p in range(start + 1, end):  # cut inside, the string is ordinary text that joins what is before it
                    out[p] = out[cut] + self.total(text[cut:p])
                out[end] = base = base + 1
                continue
            blank_from = None
            at = end_of = start
            for piece in self.split(text[start:end]):
                at, end_of = end_of, end_of + len(piece)
                inside = self.pieces.prefixes(piece.encode())
                blank = not piece.strip()
                n = 1
                if piece[0] == "'" and len(piece) > 2 or blank_from is not None and not blank:
                    # a cut contraction, or white space that a cut joins to the run before it
                    n = len(piece) if piece[0] == "'" else 2
                    for p in range(1, n):
                        joined = blank_from is not None and p == 1
                        out[at + p] = (out[blank_from] if joined else base) + self.ordinary(text[blank_from if joined else at : at + p])
                elif blank and blank_from is not None:
                    n = len(piece) + 1
                    for p in range(1, n):
                        out[at + p] = out[blank_from] + self.pieces[text[blank_from : at + p]]
                size = np.cumsum([len(c.encode()) for c in piece])
                for p in range(n, len(piece) + 1):
                    out[at + p] = base + inside[size[p - 1]]
                blank_from = (at if blank_from is None else blank_from) if blank else None
                base += inside[-1]
        return out

    def safe_cut(self, text: str, end: int) -> int:
        """The last place before ``end`` at which what precedes and what follows are encoded apart, however the text goes on."""
        found, back = None, 256
        while found is None and back < 2 * end:
            for found in SAFE_CUT.finditer(text, max(0, end - back), end):
                pass
            back *= 2
        return found.start() if found else 0

    def ordinary(self, text: str) -> int:
        return sum(map(self.pieces.__getitem__, self.split(text)))

    def fit(self, text: str | None, budget: int) -> int:
        """The longest prefix, in characters, that has at most ``budget`` tokens.

        The counts at the ends of pieces are stored until they pass the budget by
        so much that no longer prefix can come back below it. The counts of all
        prefixes are asked for from the last safe cut before the budget only.
        """
        text = text or ""
        ends, totals = [0], [0]
        passed = None  # the start of the first piece that ends above the budget
        for start, end, special in self.segments(text):
            for piece in (text[start:end],) if special else self.split(text[start:end]):
                totals.append(totals[-1] + (1 if special else self.pieces[piece]))
                if passed is None and totals[-1] > budget:
                    passed = ends[-1]
                ends.append(ends[-1] + len(piece))
                if totals[-1] > budget + SLACK:
                    break
            if totals[-1] > budget + SLACK:
                break
        if passed is None:
            return len(text)
        cut = self.safe_cut(text, passed)
        base = totals[bisect_left(ends, cut)]
        return cut + int(np.flatnonzero(base + self.counts(text[cut : ends[-1]]) <= budget)[-1])


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of a vocabulary file, loaded once in each Python worker."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(docs: DataFrame, text_col: str = "text", path: str | None = None, budget: int | None = None, store_prefixes: bool = False, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_bytes`` and ``n_tokens`` of each whole text.

    ``store_prefixes`` adds ``prefix_counts`` (array of the counts of every
    prefix, by characters); ``budget`` adds ``fit_chars``, the longest prefix of
    at most so many tokens.
    """
    path = path or default_vocabulary()
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("prefix_counts", T.ArrayType(T.LongType()))] * store_prefixes
    fields += [T.StructField("fit_chars", T.LongType())] * (budget is not None)

    def make():
        model = counter(path)

        def work(texts):
            totals = [model.total(t) for t in texts]
            out = [[len((t or "").encode()) for t in texts], totals]
            if store_prefixes:
                out.append([model.counts(t).tolist() for t in texts])
            if budget is not None:
                out.append([len(t or "") if n <= budget else model.fit(t, budget) for t, n in zip(texts, totals, strict=True)])
            return out

        return work

    return append_columns(docs, text_col, fields, make, drop=() if keep_text else (text_col,))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of every document, whether they exceed LIMIT, and the longest prefix (in characters) that does not."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, budget=LIMIT, keep_text=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "fit_chars")
