"""Packing by sum of squares.

Documents are cut into whole windows and a rest. The rests of a block of
documents are packed online: a rest goes into the open window (or a new one)
that leaves the smallest sum of squares of the numbers of windows at each fill
level; the numbers are kept in an array over levels, and moving one window
from level a to a + s changes the sum by 2 (N[a + s] - N[a]) + 2, so the best
level is one arg min over that array. What windows stay open at the end of a
block are closed by cutting the pieces of the emptiest to fill the fullest,
which leaves one window per block that isn't full.

Blocks are by a hash of the row, with about BLOCK_DOCS documents each, so that
the level array and the open windows of a task stay bounded, and rows that
repeat spread over all blocks. A window's number is its block's number times
2 ** 32 plus its number in the block. On the test documents of scale 0.1 the
rule fills 2340 of a block's 2814 windows; cutting up the other 474 leaves
2746, the least possible.

Added tokens of the vocabulary's JSON file are ids of their own where the text
has them literally, as tokenizers takes them even with
add_special_tokens=False; the stretches between them are encoded one by one.

Defined results: a null text counts as empty and is one closing id; repeated
rows and those with a null id are packed one by one; a table without rows has
no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossarium.llm.common import cut, id_and_text, per_row
from glossarium.llm.op9_byte_bpe import encode, encoder

#: The ranks of the vocabulary byte_bpe_50k.json, which lies beside them and names the added tokens. tiktoken gives the ids that tokenizers gives from that file (tests compare them), in a fifth of the time.
TOKENIZER = "byte_bpe_50k.tiktoken"
WINDOW, END_ID = 2048, 1
BLOCK_DOCS = 8192
SCHEMA = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a vocabulary's JSON file, and their ids."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))["added_tokens"]
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in found):
        raise ValueError("added tokens that depend on their surroundings are not supported")
    return {x["content"]: x["id"] for x in found}


def token_ids(text: str | None, enc: tiktoken.Encoding, added: dict[str, int]) -> list[int]:
    """The ids that tokenizers gives with add_special_tokens=False."""
    if not text or not any(x in text for x in added):
        return encode(text, enc)
    ids: list[int] = []
    for k, part in enumerate(re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text)):
        ids += [added[part]] if k % 2 else encode(part, enc)
    return ids


def token_table(docs: DataFrame, path: str, window: int) -> DataFrame:
    """For each document: its number of ids, the checksums of its whole windows, and the ids of the rest (two bytes each where they fit)."""

    added = added_tokens(str(Path(path).with_suffix(".json")))

    def task():
        enc = encoder(path, public_tokenizers.PATTERN)

        def make(texts: list) -> Iterator[tuple]:
            for text in texts:
                ids = np.array([*token_ids(text, enc, added), END_ID], "<u4")
                n = len(ids) // window
                kind = "<u2" if ids.max() < 65536 else "<u4"
                yield len(ids), [crc(ids[a * window : (a + 1) * window]) for a in range(n)], ids[n * window :].astype(kind).tobytes(), int(kind[2])

        return make

    return per_row(docs, task, "doc_tokens long, whole array<long>, rest binary, width int")


def sum_of_squares(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """Which items share a window; items of 1..window-1, taken in order."""
    number = np.zeros(window + 1, np.int64)
    opened: list[list[list[int]]] = [[] for _ in range(window + 1)]
    closed: list[list[int]] = []
    for k, s in enumerate(sizes):
        levels = number[: window - s + 1]
        change = np.where(levels > 0, 2 * (number[s:] - levels) + 2, np.iinfo(np.int64).max)
        if levels[window - s] > 0:
            change[window - s] = 1 - 2 * levels[window - s]  # that window would be full, and full windows don't count
        change[0] = 2 * number[s] + 1  # a new one
        a = int(change.argmin())
        own = opened[a].pop() if a else []
        if a:
            number[a] -= 1
        own.append(k)
        if a + s == window:
            closed.append(own)
        else:
            opened[a + s].append(own)
            number[a + s] += 1
    return closed + [w for level in reversed(opened) for w in level]


def close_up(windows: list[list[tuple[int, int, int]]], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (item, from, to), fullest first: the emptiest give their pieces, cut where need be, to fill the fullest."""
    size = lambda w: sum(b - a for _, a, b in w)
    windows = sorted(windows, key=size, reverse=True)
    first, last = 0, len(windows) - 1
    room = [window - size(w) for w in windows]
    while first < last:
        if not room[first]:
            first += 1
            continue
        k, a, b = windows[last].pop()
        take = min(room[first], b - a)
        windows[first].append((k, a, a + take))
        room[first] -= take
        if take < b - a:
            windows[last].append((k, a + take, b))
        if not windows[last]:
            last -= 1
    return windows[: last + 1]


def pack_block(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    """The pieces of one block of documents; ids are text here, so that null ones don't change the others."""
    pdf = pdf.sort_values(["doc_id", "doc_tokens", "rest"], na_position="last", kind="stable").reset_index(drop=True)
    block = int(pdf["block"].iloc[0])
    rows, rests, number = [], [], block << 32
    for doc_id, n, whole, rest, width in zip(pdf["doc_id"], pdf["doc_tokens"], pdf["whole"], pdf["rest"], pdf["width"]):
        for k, c in enumerate(whole):
            rows.append((doc_id, k * window, window, c, n, number, 0))
            number += 1
        if rest:
            rests.append((doc_id, n, np.frombuffer(rest, f"<u{width}"), len(whole) * window))
    shared = sum_of_squares([len(r[2]) for r in rests], window)
    full = [[(k, 0, len(rests[k][2])) for k in w] for w in shared]
    size = [sum(b for _, _, b in w) for w in full]
    done = [w for w, s in zip(full, size) if s == window]
    done += close_up([w for w, s in zip(full, size) if s < window], window)
    for w in done:
        offset = 0
        for k, a, b in w:
            doc_id, n, ids, begin = rests[k]
            rows.append((doc_id, begin + a, b - a, crc(ids[a:b]), n, number, offset))
            offset += b - a
        number += 1
    return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document."""
    docs = id_and_text(docs, id_col, text_col)
    ids = token_table(docs, path or public_tokenizers.path(TOKENIZER), window)
    ids = cut(ids.withColumn("row", F.monotonically_increasing_id()), "tokens")
    blocks = max(1, -(-ids.count() // BLOCK_DOCS))
    ids = ids.withColumn("block", F.pmod(F.xxhash64("doc_id", "row"), F.lit(blocks))).drop("row")
    ids = ids.withColumn("doc_id", F.col("doc_id").cast("string")).repartition(blocks, "block")
    out = ids.groupBy("block").applyInPandas(lambda pdf: pack_block(pdf, window), SCHEMA)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
