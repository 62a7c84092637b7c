"""Quality rules by compression bands.

A text is compressed with zstandard as a whole and in fixed chunks. Text that
shrinks far more than prose of its length repeats itself; text that hardly
shrinks is noise. The limits depend on the length, because short texts shrink
less than long ones of the same kind.

Defined results: null or empty text has no words and fails the base rules;
repeated rows and rows with a null id are judged one by one; an empty table
gives an empty result. Each row is judged on its own, so there is no shuffle and no state.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession

from glossarium.llm.common import WORD, WS, id_and_text, per_row


@dataclass(frozen=True)
class Bands:
    """(from so many UTF-8 bytes, least ratio, greatest ratio) in rising order, for whole texts."""

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 3.0),
        (128, 0.9, 2.6),
        (256, 1.2, 2.1),
        (512, 1.25, 2.2),
        (1024, 1.35, 2.3),
        (2048, 1.45, 2.4),
        (4096, 1.5, 2.5),
        (8192, 1.5, 2.6),
        (16384, 1.5, 2.7),
        (32768, 1.5, 2.8),
        (65536, 1.5, 3.0),
        (1 << 18, 1.5, 3.4),
        (1 << 20, 1.5, 4.0),
    )
    #: Every chunk of chunk_bytes is held to chunk_low..chunk_high, the last one too, which ends with the text; at most max_bad_chunks of them may miss it.
    chunk_bytes: int = 4096
    chunk_low: float = 1.4
    chunk_high: float = 2.7
    max_bad_chunks: float = 0.2
    level: int = 3


#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, whole_ratio double, bad_chunks double"


def repeated_words(words: Sequence[str]) -> int:
    """Words inside a window of three words that the text has at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[str, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    if len(ids) < 1 << 21:
        tri = (w[:-2] << 42) | (w[1:-1] << 21) | w[2:]
    else:
        pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
        tri = pair[:-1] * len(ids) + w[2:]
    order = np.argsort(tri, kind="stable")
    same = tri[order[1:]] == tri[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def band(bands: Bands, n_bytes: int) -> tuple[float, float]:
    low, high = 0.0, float("inf")
    for least, a, b in bands.whole:
        if n_bytes >= least:
            low, high = a, b
    return low, high


def ratios(data: bytes, bands: Bands, squeeze: zstandard.ZstdCompressor) -> tuple[float, float]:
    """The ratio of the whole, and the share of chunks outside the limits of chunks. A text shorter than a chunk has none: its band is for its length."""
    if not data:
        return 0.0, 0.0
    whole = len(data) / len(squeeze.compress(data))
    size = bands.chunk_bytes
    begins = [*range(0, len(data) - size + 1, size)]
    if begins and len(data) % size:
        begins.append(len(data) - size)
    bad = 0
    for a in begins:
        r = size / len(squeeze.compress(data[a : a + size]))
        bad += not bands.chunk_low <= r <= bands.chunk_high
    return whole, bad / len(begins) if begins else 0.0


def judge(text: str | None, bands: Bands, squeeze: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(WS)]
    repeat = repeated_words(words)
    failed = n < 50 or 100 * repeat > 50 * n
    data = text.encode("utf-8", "surrogatepass")
    whole, bad = ratios(data, bands, squeeze)
    low, high = band(bands, len(data))
    kept = not failed and low <= whole <= high and bad <= bands.max_bad_chunks
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, failed, kept, whole, bad


def compression_bands(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its counts, its ratios and whether it stays."""

    def task():
        squeeze = zstandard.ZstdCompressor(level=bands.level)
        return lambda texts: (judge(t, bands, squeeze) for t in texts)

    return per_row(id_and_text(docs, id_col, text_col), task, ADDED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(spark.read.parquet(f"{sf_dir}/documents.parquet"))
