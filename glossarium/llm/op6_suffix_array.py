"""Repeated passages by suffix arrays, built with the difference-cover algorithm.

Sorting every suffix of a large corpus as rows would move each byte dozens of
times (figures in README), so the sort is kept for where it decides something:

1. Every 100-byte string is assigned to its least 32-gram by hash (the
   leftmost of equals), which depends on the string alone. The strings of a
   document that share one make an interval. A Bloom filter of the 32-grams
   that the corpus has twice tells the others; their strings repeat nowhere.
2. The other intervals are grouped by their bytes; all but the first of a
   group are covered.
3. The first ones whose 32-gram has other intervals too are brought together
   by 32-gram. Strings whose rolling hash occurs once there differ from all
   others. What is left is sorted by the difference cover (sampled triples,
   names, recursion, merge), and adjacent suffixes are compared byte by byte
   over 100 bytes. Each string but the first of its class is covered. Equal
   strings have one 32-gram, so the parts are sorted apart from each other.
   The strings of a 32-gram that very many different intervals share (the
   edges of a passage that very many documents have) are grouped by their
   bytes instead, as step 2 does it, so that no task holds such a 32-gram.
4. Documents get their covered strings back and lose those bytes. Only
   documents that hold the first place of something repeated need a list;
   what else a document has of the repeated 32-grams is covered.

Hashes only tell apart what surely differs; whatever is taken for equal has
equal bytes.

Defined results: a null text is empty; texts under 100 bytes lose nothing; an
empty table gives none. A document is a doc_id with a text. A null doc_id
comes after all others. Texts that share a doc_id (or the null id) are
documents of their own, ordered by the SHA-256 of the text; rows that repeat
both doc_id and text are one document and are treated alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossarium.llm.common import cut, id_and_text, per_row, slices, uncut, with_key
from glossarium.llm.suffix_array import equal_prefixes
from glossarium.llm.two_bloom import Known, meet, repeated_alone, shortened, twice_seen

#: Bytes of a repeat, of the hashed grams in it, and grams in it.
LENGTH, GRAM = 100, 32
GRAMS = LENGTH - GRAM + 1


@dataclass(frozen=True)
class Rule:
    #: Most positions of the Bloom filters of 32-grams.
    bits: int = 1 << 28
    #: Most positions of the filter of documents that need a list.
    doc_bits: int = 1 << 26
    #: The strings of a 32-gram with more different intervals than this are grouped by their bytes.
    gather: int = 1500
    #: About so many strings are sorted together.
    part: int = 100_000


_WEIGHTS = np.random.default_rng(6).integers(1, 1 << 63, GRAM, np.int64).astype(np.uint64) | np.uint64(1)
_TABLE = np.random.default_rng(7).integers(0, 1 << 32, 256, np.int64).astype(np.uint32)


def grams(b: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the 32 bytes from each position on."""
    h, size = _TABLE[b], 1
    for mul in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1):
        h = h[:-size] * np.uint32(mul) + h[size:]
        h ^= h >> np.uint32(15)
        size *= 2
    return h


#: Long texts are read in segments of so many strings, and short ones together in blocks of so many bytes.
SEGMENT, BLOCK = 1 << 20, 1 << 18


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def block_intervals(b: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of the stretches (starts, sizes) of b, each of 100 bytes at least: first and last string's start, the gram's place, and a 64-bit hash of the gram."""
    h = grams(b)
    low = sliding(h, GRAMS, np.minimum)
    valid = np.zeros(len(low) + 2, bool)  # one more at either end
    edge = np.zeros(len(b) + 1, np.int8)
    edge[starts] += 1
    edge[starts + sizes - LENGTH + 1] -= 1
    valid[1:-1] = np.cumsum(edge[: len(low)], dtype=np.int8)
    inside, changes = valid[1:-1], np.concatenate([[True], low[1:] != low[:-1], [True]])
    begin = np.nonzero(inside & (changes[:-1] | ~valid[:-2]))[0]
    end = np.nonzero(inside & (changes[1:] | ~valid[2:]))[0]
    # places that hold the least value of some string
    padded = np.zeros(len(low) + 2 * (GRAMS - 1), np.uint32)
    padded[GRAMS - 1 : GRAMS - 1 + len(low)] = low * inside
    places = np.nonzero(h == sliding(padded, GRAMS, np.maximum))[0]
    # each interval's leftmost such place; an interval that holds several is cut behind each
    both, number = np.unique(np.concatenate([low[begin], h[places]]), return_inverse=True)
    keys = np.sort((number[len(begin) :] << 32) | places)
    number = number[: len(begin)]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(begin):
        k = keys[np.searchsorted(keys, (number << 32) | begin)] & 0xFFFFFFFF
        stop = np.minimum(end, k)
        found.append((begin, stop, k))
        more = stop < end
        begin, end, number = stop[more] + 1, end[more], number[more]
    lo, hi, k = (np.concatenate(x) for x in zip(*found))
    if len(found) > 1:
        order = np.argsort(lo, kind="stable")
        lo, hi, k = lo[order], hi[order], k[order]
    code = np.zeros(len(k), np.uint64)
    for j in range(GRAM):
        code += (b[k + j].astype(np.uint64) + np.uint64(1)) * _WEIGHTS[j]
    code ^= code >> np.uint64(29)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    return lo, hi, k, code ^ (code >> np.uint64(32))


def intervals(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, first string's start, last one's, gram's place, hash of the gram) of each interval of the texts, in order."""
    out: list[tuple[np.ndarray, ...]] = []
    own: list[int] = []
    shift: list[int] = []
    parts: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if parts:
            sizes = np.array([len(x) for x in parts])
            starts = np.cumsum(sizes) - sizes
            lo, hi, k, code = block_intervals(np.frombuffer(b"".join(parts), np.uint8), starts, sizes)
            at = np.searchsorted(starts, lo, "right") - 1
            move = np.array(shift)[at] - starts[at]
            out.append((np.array(own)[at], lo + move, hi + move, k + move, code))
            own.clear(), shift.clear(), parts.clear()
            size = 0

    for i, data in enumerate(texts):
        for a in range(0, len(data) - LENGTH + 1, SEGMENT):
            part = data[a : a + SEGMENT + LENGTH - 1] if len(data) > SEGMENT else data
            own.append(i)
            shift.append(a)
            parts.append(part)
            size += len(part)
            if size >= BLOCK:
                flush()
    flush()
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def gram_hashes(pdf: pd.DataFrame) -> np.ndarray:
    """The 32-grams' hashes of all intervals, text by text for bounded memory."""
    out, part, size = [np.zeros(0, np.uint64)], [], 0
    for text in pdf["text"]:
        part.append(as_bytes(text))
        size += len(part[-1])
        if size >= BLOCK:
            out.append(intervals(part)[4])
            part, size = [], 0
    return np.concatenate([*out, intervals(part)[4]])


def place():
    """A place as a struct that orders by document and start; null ids come last."""
    return F.struct(F.col("doc").isNull().alias("nul"), "doc", "th", "lo")


def suspects(docs: DataFrame, known: Known) -> DataFrame:
    """Intervals (gram, bytes; doc, th, lo) of docs (doc_id, th, text) whose gram may occur elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                texts = [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
                own, lo, hi, _, code = intervals(texts)
                ok = known.has(code)
                own, lo, hi = own[ok], lo[ok], hi[ok]
                spans = [texts[i][x:y] for i, x, y in zip(own.tolist(), lo.tolist(), (hi + LENGTH).tolist())]
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays([pa.array(code[ok].view(np.int64)), pa.array(spans, pa.binary()), part.column("doc_id").take(at), part.column("th").take(at), pa.array(lo)], names=["gram", "bytes", "doc", "th", "lo"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "gram long, bytes binary, doc long, th binary, lo long")


def covered_strings(doc: np.ndarray, lo: np.ndarray, n: np.ndarray, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of the strings of these intervals: document and start of each that an earlier place has too."""
    sizes = n + LENGTH - 1
    starts = np.cumsum(sizes) - sizes
    t = np.frombuffer(b"".join(spans), np.uint8)
    own = np.repeat(np.arange(len(n)), n)
    at = starts[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    # strings whose hash is alone here occur once
    h, size, done = (t.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1, 0
    parts = []
    for mul in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9, 0):
        if LENGTH & size:
            parts.append((h, done))
            done += size
        if mul and 2 * size <= LENGTH:
            h = h[:-size] * np.uint64(mul) + h[size:]
            h ^= h >> np.uint64(29)
            size *= 2
        else:
            break
    code = np.zeros(len(at), np.uint64)
    for x, shift in parts:
        code = code * np.uint64(0x9FB21C651E98DF25) + x[at + shift]
        code ^= code >> np.uint64(32)
    _, inverse, times = np.unique(code, return_inverse=True, return_counts=True)
    twice = times[inverse] > 1
    own, at = own[twice], at[twice]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # runs of such strings, without repeats of a run: those are covered as a whole
    cut_at = np.concatenate([[0], np.nonzero((np.diff(at) != 1) | (np.diff(own) != 0))[0] + 1])
    ends = np.concatenate([cut_at[1:], [len(at)]])
    first_of: dict[bytes, int] = {}
    data = t.tobytes()
    where_doc, where_lo = doc[own], lo[own] + at - starts[own]
    by_place = sorted(range(len(cut_at)), key=lambda k: (where_doc[cut_at[k]], where_lo[cut_at[k]]))
    gone = np.zeros(len(at), bool)
    kept = []
    for k in by_place:
        a, e = cut_at[k], ends[k]
        if first_of.setdefault(data[at[a] : at[e - 1] + LENGTH], k) == k:
            kept.append(k)
        else:
            gone[a:e] = True
    text = b"".join(data[at[cut_at[k]] : at[ends[k] - 1] + LENGTH] for k in kept)
    count = np.array([ends[k] - cut_at[k] for k in kept])
    begin = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
    index = np.concatenate([np.arange(cut_at[k], ends[k]) for k in kept])
    place = np.repeat(begin, count) + np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count)
    same = equal_prefixes(np.frombuffer(text, np.uint8), place, LENGTH)
    order = np.lexsort((where_lo[index], where_doc[index], same))
    again = np.concatenate([[False], same[order[1:]] == same[order[:-1]]])
    gone[index[order[again]]] = True
    return where_doc[gone], where_lo[gone]


def sorted_strings(rows: DataFrame, part: int) -> DataFrame:
    """Covered strings (doc, th, at) of first intervals (gram, bytes, place) that are partitioned and ordered by gram; some 32-grams at a time."""

    def covered(pdf: pd.DataFrame) -> pd.DataFrame:
        places = list(zip(pdf["nul"], (x or 0 for x in pdf["doc"]), pdf["th"], pdf["lo"]))
        pdf = pdf.take(sorted(range(len(pdf)), key=places.__getitem__))
        spans = list(pdf["bytes"])
        own, at = covered_strings(np.arange(len(pdf)), np.zeros(len(pdf), np.int64), np.array([len(x) - LENGTH + 1 for x in spans]), spans)
        return pd.DataFrame({"doc": pdf["doc"].to_numpy()[own], "th": pdf["th"].to_numpy()[own], "at": pdf["lo"].to_numpy()[own] + at})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            for piece in slices(batch, "bytes"):
                pdf = piece.to_pandas(integer_object_nulls=True).astype({"doc": object})
                held.append(pdf)
                size += strings(pdf)
                if size >= part:
                    have = pd.concat(held, ignore_index=True)
                    last = have["gram"].to_numpy() == have["gram"].iat[-1]
                    if not last.all():
                        yield out(covered(have[~last]))
                        held = [have[last]]
                        size = strings(held[0])
        if held:
            yield out(covered(pd.concat(held, ignore_index=True)))

    def strings(pdf: pd.DataFrame) -> int:
        return int(pdf["bytes"].map(len).sum()) - (LENGTH - 1) * len(pdf)

    def out(pdf: pd.DataFrame) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pdf["doc"].tolist(), pa.int64()), pa.array(pdf["th"].tolist(), pa.binary()), pa.array(pdf["at"].to_numpy(np.int64))], names=["doc", "th", "at"])

    return rows.mapInArrow(run, "doc long, th binary, at long")


def grouped_strings(rows: DataFrame) -> DataFrame:
    """The same for 32-grams with very many first intervals: their strings are grouped by bytes, with sums before the shuffle."""
    strings = rows.select("bytes", "nul", "doc", "th", "lo", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - LENGTH)).alias("k"))
    strings = strings.select(F.expr(f"substring(bytes, k + 1, {LENGTH})").alias("s"), F.struct("nul", "doc", "th", (F.col("lo") + F.col("k")).alias("lo")).alias("place"))
    first = strings.groupBy("s").agg(F.min("place").alias("place")).select("place.doc", "place.th", F.col("place.lo").alias("at"), F.lit(1).alias("first"))
    every = rows.select("doc", "th", F.explode(F.sequence("lo", F.col("lo") + F.octet_length("bytes") - LENGTH)).alias("at"), F.lit(0).alias("first"))
    # places of one document only meet here; a place of several intervals is covered if no interval of its 32-gram has it first
    seen = every.unionByName(first).groupBy("doc", "th", "at").agg(F.max("first").alias("first"))
    return seen.filter("first = 0").select("doc", "th", "at")


def removals(docs: DataFrame, rule: Rule = Rule()) -> tuple[DataFrame, Known]:
    """For documents (doc_id, th, key, text): (doc_id, th, key, firsts, at), the starts of first intervals and of covered strings in them, for documents that have any; and the filter of the 32-grams that repeat."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    once = repeated_alone(docs.select("text"), gram_hashes, size * 2 // GRAMS, rule.bits)  # a 32-gram is the least of some 35 neighbours
    seen = suspects(docs, once)
    firsts = seen.groupBy("gram", "bytes").agg(F.min(place()).alias("place"), F.count("*").alias("rows"))
    firsts = cut(firsts.select("gram", "bytes", "rows", "place.nul", "place.doc", "place.th", "place.lo"), "firsts")
    counts = firsts.groupBy("gram").agg(F.sum("rows").alias("rows"), F.count("*").alias("spans")).filter("rows > 1")
    counts = cut(counts, "grams")
    # grams that do repeat, and passed the first filter: what it denies is in no list
    found = twice_seen(counts.select("gram"), lambda pdf: shortened(pdf["gram"].to_numpy().view(np.uint64)), once.bits, once=True)
    found = np.frombuffer(once.held.value, np.uint8) & np.frombuffer(found, np.uint8)
    known = Known(spark.sparkContext.broadcast(found.tobytes()), once.bits, short=True)
    once.destroy()

    several = firsts.drop("rows").join(counts.filter(f"spans > 1 AND spans <= {rule.gather}").select("gram"), "gram")
    hot = F.broadcast(counts.filter(f"spans > {rule.gather}").select("gram"))  # firsts / gather grams at most
    covered = sorted_strings(several.repartition("gram").sortWithinPartitions("gram"), rule.part)
    covered = covered.unionByName(grouped_strings(firsts.drop("rows").join(hot, "gram")))
    covered = covered.groupBy("doc", "th").agg(F.collect_list("at").alias("at"))  # no more than a document's own bytes

    own = firsts.select("doc", "th", "lo", "gram").filter(known.maybe(F.col("gram"))).groupBy("doc", "th").agg(F.collect_list("lo").alias("firsts"))
    same = own["doc"].eqNullSafe(covered["doc"]) & (own["th"] == covered["th"])
    out = own.join(covered, same, "left").select(own["doc"].alias("doc_id"), own["th"], "firsts", "at")
    out = cut(out.withColumn("key", F.xxhash64("doc_id", "th")), "removals")
    uncut(firsts, counts)
    return out, known


def marks(texts: list[bytes], firsts, at, known: Known) -> Iterator[np.ndarray]:
    """For each text, which bytes go."""
    own, lo, hi, _, code = intervals(texts)
    gone = known.has(code)
    ends = np.searchsorted(own, np.arange(1, len(texts) + 1))
    a = 0
    for k, data in enumerate(texts):
        change = np.zeros(len(data) + 1, np.int32)
        mine, x, y = gone[a : ends[k]], lo[a : ends[k]], hi[a : ends[k]]
        a = ends[k]
        if firsts[k]:
            mine = mine & ~np.isin(x, firsts[k])
        np.add.at(change, x[mine], 1)
        np.add.at(change, y[mine] + LENGTH, -1)
        if at[k]:
            places = np.asarray(at[k])
            np.add.at(change, places, 1)
            np.add.at(change, places + LENGTH, -1)
        yield np.cumsum(change[:-1]) > 0


def runs(mask: np.ndarray) -> int:
    return int((np.diff(np.concatenate([[False], mask]).astype(np.int8)) == 1).sum())


def without_repeats(text: str | None, mask: np.ndarray) -> str:
    """The text without the characters all of whose bytes are marked."""
    if not mask.any():
        return text or ""
    b = np.frombuffer(as_bytes(text), np.uint8)
    head = np.nonzero((b & 0xC0) != 0x80)[0]
    whole = np.logical_and.reduceat(mask, head)
    keep = np.repeat(~whole, np.diff(np.concatenate([head, [len(b)]])))
    return b[keep].tobytes().decode("utf-8", "surrogatepass")


def with_removals(docs: DataFrame, rule: Rule) -> tuple[DataFrame, Known]:
    """docs (doc_id, text, and more) with firsts and at, and the filter of 32-grams. Texts of documents that hold no first place aren't moved."""
    docs = with_key(docs)
    found, known = removals(docs, rule)
    return meet(docs, found, rule.doc_bits), known


def repeated_bytes(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its bytes, those removed and in how many runs, and the digest of the rest."""
    joined, known = with_removals(id_and_text(docs, id_col, text_col), rule)

    def make(texts: list, firsts: list, at: list) -> Iterator[tuple]:
        texts = list(map(as_bytes, texts))
        for data, mask in zip(texts, marks(texts, firsts, at, known)):
            kept = np.frombuffer(data, np.uint8)[~mask].tobytes() if mask.any() else data
            yield len(data), int(mask.sum()), runs(mask), hashlib.sha256(kept).hexdigest()

    return per_row(joined, lambda: make, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", read=("text", "firsts", "at"))


def texts_without_repeats(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text of each row without its repeats, cut at whole characters."""
    names = [f"c{k}" for k in range(len(docs.columns))]  # further columns can't clash with those needed here
    plain = docs.toDF(*names)
    text, doc = names[docs.columns.index(text_col)], names[docs.columns.index(id_col)]
    keep = [c for c in names if c != text]
    rows = plain.select(*keep, F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    joined, known = with_removals(rows, rule)

    def make(texts: list, firsts: list, at: list) -> Iterator[tuple]:
        for t, mask in zip(texts, marks(list(map(as_bytes, texts)), firsts, at, known)):
            yield (without_repeats(t, mask),)

    made = per_row(joined, lambda: make, f"{text} string", keep=keep, read=("text", "firsts", "at"))
    return made.select(*names).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple[int, int, int, str]]:
    """The same for each row by a table of all strings, for tests and small inputs."""
    seen: set[bytes] = set()
    done: dict[tuple, tuple[int, int, int, str]] = {}
    as_key = lambda doc, text: (doc is None, doc or 0, hashlib.sha256(as_bytes(text)).digest())
    for doc, text in sorted(rows, key=lambda r: as_key(*r)):
        if as_key(doc, text) in done:
            continue
        b = as_bytes(text)
        mask = np.zeros(len(b), bool)
        for k in range(len(b) - LENGTH + 1):
            s = b[k : k + LENGTH]
            if s in seen:
                mask[k : k + LENGTH] = True
            else:
                seen.add(s)
        done[as_key(doc, text)] = (len(b), int(mask.sum()), runs(mask), hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest())
    return [done[as_key(doc, text)] for doc, text in rows]
