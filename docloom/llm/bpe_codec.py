"""Byte-level BPE encoding and decoding (operator 5).

Texts are encoded with the tiktoken library from a local rank file. Long texts
are first cut at boundaries where the pre-tokenizer cannot join the two sides,
so a text of any length is encoded in bounded pieces with unchanged ids.

Defined results: a null text counts as empty and gives no ids; repeated rows
are encoded each on its own; an id that is not in the ranks raises on decoding.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession, types as T

from docloom.llm.common import append_columns, table

#: Texts longer than this many characters are cut at safe boundaries.
PIECE_CHARS = 1 << 16
#: A blank before a letter or ASCII digit always starts a match of the pattern:
#: no alternative has a blank after its first character unless it is white space
#: only, and those leave the last blank before a word to the word. A single line
#: end before a letter is a match of its own. A letter after one of the listed
#: signs starts a match too (the apostrophe, which contractions have, is not one
#: of them), so texts that write without blanks are cut as well.
SAFE = re.compile(r" (?=[^\W\d_]|[0-9])|(?<=\S\n)(?=[^\W\d_])|(?<=[!-&(-/:-@\[-^`{-~。、，．！？；：·])(?=[^\W\d_])")

_codecs: dict[tuple[str, str], tiktoken.Encoding] = {}


def default_ranks() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def codec(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, loaded once in each Python worker."""
    key = (ranks_path, pattern)
    if key not in _codecs:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _codecs[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _codecs[key]


def safe_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Cut a text into pieces of about ``size`` characters whose encodings concatenate to that of the text.

    A run without a safe boundary stays whole.
    """
    out, start = [], 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    out.append(text[start:])
    return out


def encode_text(encoding: tiktoken.Encoding, text: str | None, size: int = PIECE_CHARS) -> bytes:
    """The ids of a text as packed little-endian unsigned 32-bit integers."""
    if not text:
        return b""
    return b"".join(np.asarray(encoding.encode_ordinary(p), dtype="<u4").tobytes() for p in safe_pieces(text, size))


def encode_documents(docs: DataFrame, text_col: str = "text", ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``ids``: each text's token ids, packed as little-endian unsigned 32-bit integers."""
    path = ranks_path or default_ranks()

    def make():
        encoding = codec(path, pattern)
        return lambda texts: [[encode_text(encoding, t) for t in texts]]

    return append_columns(docs, text_col, [T.StructField("ids", T.BinaryType())], make, drop=() if keep_text else (text_col,))


def decode_documents(encoded: DataFrame, ids_col: str = "ids", ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``encoded`` with ``decoded``: the raw bytes of each row's packed ids, never passed through a string."""
    path = ranks_path or default_ranks()

    def make():
        encoding = codec(path, pattern)
        return lambda packed: [[b"".join(decoded(encoding, p)) for p in packed]]

    return append_columns(encoded, ids_col, [T.StructField("decoded", T.BinaryType())], make)


def decoded(encoding: tiktoken.Encoding, packed: bytes | None) -> Iterator[bytes]:
    """The raw bytes of packed ids, PIECE_CHARS ids at a time."""
    ids = np.frombuffer(packed or b"", dtype="<u4")
    for start in range(0, len(ids), PIECE_CHARS):
        yield encoding.decode_bytes(ids[start : start + PIECE_CHARS].tolist())


DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def digest_documents(docs: DataFrame, text_col: str = "text", ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, keep_text: bool = False) -> DataFrame:
    """``docs`` with n_tokens and the digests of each text's packed ids and of the bytes they decode to.

    A text is encoded, and its ids decoded, piece by piece in one pass: ids leave
    the task as digests only, so a very long text takes no more memory than one of its pieces.
    """
    path = ranks_path or default_ranks()

    def make():
        encoding = codec(path, pattern)

        def work(texts):
            out: list[list] = [[], [], []]
            for text in texts:
                n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
                for piece in safe_pieces(text or ""):
                    packed = encode_text(encoding, piece)
                    n += len(packed) // 4
                    of_ids.update(packed)
                    for part in decoded(encoding, packed):
                        of_bytes.update(part)
                for column, value in zip(out, (n, of_ids.hexdigest(), of_bytes.hexdigest()), strict=True):
                    column.append(value)
            return out

        return work

    return append_columns(docs, text_col, DIGESTS, make, drop=() if keep_text else (text_col,))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and of their decoding."""
    return digest_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
