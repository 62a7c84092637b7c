"""Byte-level BPE with a local rank file, by the tiktoken library.

Long texts are cut before white space that follows other characters, and where
an ASCII letter or digit is followed by an ASCII character of another kind: no
match of the pattern spans such a place, so the pieces encode to what the
whole would. A single run of letters, digits or signs is one match, and one
piece whatever its length. Decoding joins the raw bytes of the ids, which gives the text back even
where one character is spread over several ids.

Defined results: null counts as empty, and an empty text has no ids. Each row
is encoded on its own, repeated ones and those with a null id too, so there is
no shuffle and no state; a table without rows gives none.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from glossarium.llm.common import id_and_text, per_row

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Texts beyond so many characters are encoded piece by piece.
PIECE_CHARS = 65536
#: Runs of white space from this length on are matched here, as the regular expression would.
LONG_SPACE = 4096
ADDED = "n_tokens long, ids_sha256 string, decoded_sha256 string"
#: White space as the pattern's \\s has it (Unicode's White_Space).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(rf"(?<=[^{_SPACE}])(?=[{_SPACE}])|(?<=[A-Za-z])(?=[!-@\[-`{{-~])|(?<=[0-9])(?=[!-/:-~])")
_RUN = re.compile(rf"[{_SPACE}]{{{LONG_SPACE},}}")


@functools.lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about limit characters or more, cut only where no match of the pattern can span."""
    start = 0
    while len(text) - start > limit:
        found = _SAFE.search(text, start + limit)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode(text: str | None, enc: tiktoken.Encoding) -> list[int]:
    if not text:
        return []
    if len(text) < LONG_SPACE:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    start = 0
    for run in _RUN.finditer(text):  # the pattern takes such a run but for its last character, or all of it at the end
        end = run.end() - (run.end() < len(text))
        for piece in pieces(text[start : run.start()]):
            ids += enc.encode_ordinary(piece)
        ids += enc._encode_single_piece(text[run.start() : end])
        start = end
    for piece in pieces(text[start:]):
        ids += enc.encode_ordinary(piece)
    return ids


def byte_bpe(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number and digest of each text's ids, and the digest of the bytes they decode to.

    path names a rank file that every executor has; with_ids adds the ids
    themselves and the decoded bytes.
    """
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def task():
        enc = encoder(path, pattern)

        def make(texts: list) -> Iterator[tuple]:
            for text in texts:
                ids = encode(text, enc)
                raw = enc.decode_bytes(ids)
                row = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest())
                yield (*row, ids, raw) if with_ids else row

        return make

    return per_row(id_and_text(docs, id_col, text_col), task, ADDED + ", ids array<long>, decoded binary" * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(spark.read.parquet(f"{sf_dir}/documents.parquet"))
