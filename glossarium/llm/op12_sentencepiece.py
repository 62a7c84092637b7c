"""SentencePiece encoding of BPE models by vectorised merge rounds, and decoding.

A text is normalised as the model says and cut wherever two neighbouring
characters stand together in no piece of the vocabulary: no merge can span such
a place, so the parts, here called words, merge on their own. The distinct new
words of a slice of texts become one flat numpy array of symbols, and rounds
merge all of them at once: every neighbouring pair gets the rank of the piece it
would make, each word its least rank by a segmented minimum, and the pairs of
that rank merge from the left, up to the first after which a neighbour would
come earlier than the next of them. That is the order in which the library
takes them from its queue (best score, then leftmost), so the ids are the same.
Merged symbols are compacted away, and a word leaves the arrays once it has no
pair. Words over LONG symbols merge in that order from a heap instead, for a
round there would cost as much as the whole word for as little as one merge.

Symbols that are not in the vocabulary become the ids of their UTF-8 bytes.

Defined results: null counts as empty, and an empty text has no ids. Each row
is encoded on its own, repeated ones and those with a null id too, so there is
no shuffle and no state between tasks; a table without rows gives none. Models
without byte pieces, of another kind than BPE or with pieces given by their
users are refused.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from glossarium.llm.common import id_and_text, per_row

MODEL = "piece_bpe_32k.model"
ADDED = "n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Words of more symbols merge from a heap.
LONG = 2048
#: So many words of earlier slices are remembered by a task.
REMEMBERED = 400_000
NONE = np.iinfo(np.int64).max
#: Fixed numbers of the model's format: kinds of pieces and of models.
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
BPE = 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield number, data[at : at + size]
        at += size


class Model:
    """Ranks of pieces and pairs. A symbol is a number: that of a piece, or of a character that is no piece beyond them."""

    def __init__(self, path: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            message = list(fields(f.read()))
        if dict(x for n, v in message if n == 2 for x in fields(v) if isinstance(x[1], int)).get(3) != BPE:
            raise ValueError("the model is of another kind than BPE")
        made = [dict(fields(v)) for n, v in message if n == 1]
        pieces = [(x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)) for x in made]
        if any(kind == USER_DEFINED for _, _, kind in pieces):
            raise ValueError("pieces given by users are not supported")
        self.bytes = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        if len(self.bytes) != 256:
            raise ValueError("the model has no pieces for bytes")
        if any(kind not in (NORMAL, BYTE) for _, _, kind in pieces[3:]):
            raise ValueError("unused pieces are not supported")
        self.normal = {p: k for k, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        scores = sorted({pieces[k][1] for k in self.normal.values()}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        chars = sorted({c for p in self.normal for c in p})
        #: Class of a code point: 0 where no piece has it.
        self.classes = np.zeros(0x110000, np.int64)
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        #: Which classes stand together in a piece: a bit map, for there are some thousand classes.
        self.together = np.zeros(self.width * self.width, bool)
        self.together[[self.classes[ord(a)] * self.width + self.classes[ord(b)] for p in self.normal for a, b in zip(p, p[1:])]] = True
        # characters that are no piece of their own but part of one, and those outside
        self.symbols = dict(self.normal)
        for c in chars:
            self.symbols.setdefault(c, len(pieces) + len(self.symbols))
        self.outside = max([*self.symbols.values(), len(pieces)]) + 1
        self.base = self.outside + 0x110000
        pairs = {}
        for p, k in self.normal.items():
            for cut in range(1, len(p)):
                a, b = self.symbols.get(p[:cut]), self.symbols.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = (order[pieces[k][1]], k)
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = np.append(keys, NONE)
        self.pair_rank = np.append(np.array([pairs[k][0] for k in keys.tolist()], np.int64), NONE)
        self.pair_made = np.append(np.array([pairs[k][1] for k in keys.tolist()], np.int64), -1)
        self.pairs = pairs
        #: The symbol of each code point.
        self.first = np.arange(0x110000) + self.outside
        self.first[[ord(c) for c in chars]] = [self.symbols[c] for c in chars]
        self.n_pieces = len(pieces)
        self.chars = {v: k for k, v in self.symbols.items() if len(k) == 1}

    def words(self, text: str) -> list[str]:
        """The normalised text, cut at every place that no merge can span."""
        if not text:
            return []
        found = self.classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        cut = np.nonzero(~self.together[found[:-1] * self.width + found[1:]])[0] + 1
        ends = [0, *cut.tolist(), len(text)]
        return [text[a:b] for a, b in zip(ends, ends[1:])]

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the piece that each pair makes (NONE where it makes none), and the piece."""
        key = left * self.base + right
        at = np.searchsorted(self.pair_keys, key)
        there = self.pair_keys[at] == key
        return np.where(there, self.pair_rank[at], NONE), np.where(there, self.pair_made[at], -1)

    def ids(self, symbol: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of symbols that no longer merge, in order, and the owner of each."""
        odd = np.unique(symbol[symbol >= self.n_pieces])
        if not len(odd):
            return symbol, owner
        chars = [self.chars[s] if s < self.outside else chr(s - self.outside) for s in odd.tolist()]
        raw = [[self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] for c in chars]
        size = np.array([len(x) for x in raw])
        begin = np.append(0, np.cumsum(size))
        at = np.searchsorted(odd, symbol)
        at[at == len(odd)] = 0
        is_odd = odd[at] == symbol
        times = np.where(is_odd, size[at], 1)
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        flat = np.array([i for x in raw for i in x])
        byte = flat[np.minimum(np.repeat(begin[at], times) + inside, len(flat) - 1)]
        return np.where(np.repeat(is_odd, times), byte, np.repeat(symbol, times)), np.repeat(owner, times)

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one word after the other, and how many each has."""
        parts = self._rounds([w if len(w) <= LONG else "" for w in words])
        for k, w in enumerate(words):
            if len(w) > LONG:
                symbol = np.array(self._heap(w), np.int64)
                parts.append((symbol, np.full(len(symbol), k)))
        symbol, word = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(word, kind="stable")
        ids, owner = self.ids(symbol[order], word[order])
        return ids, np.bincount(owner, minlength=len(words))

    def _symbols(self, text: str) -> np.ndarray:
        return self.first[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]

    def _rounds(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(symbols, their words) of words that merge no further, as rounds find them."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        symbol = self._symbols("".join(words))
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])

        def ranks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of the pairs that begin at these places, none over the end of a word."""
            right = np.minimum(at + 1, len(symbol) - 1)
            rank, made = self.rank(symbol[at], symbol[right])
            rank[(word[at] != word[right]) | (at == right)] = NONE
            return rank, made

        rank, made = ranks(np.arange(len(symbol)))
        while len(symbol):
            begins = np.nonzero(np.append(True, word[1:] != word[:-1]))[0]
            size = np.diff(np.append(begins, len(word)))
            least = np.minimum.reduceat(rank, begins)
            over = np.repeat(least == NONE, size)
            if over.any():
                out.append((symbol[over], word[over]))
                symbol, word, rank, made = symbol[~over], word[~over], rank[~over], made[~over]
                least, size = least[least != NONE], size[least != NONE]
                if not len(symbol):
                    break
            # pairs of the least rank, from the left, without those that share a symbol with the one before
            at = np.nonzero(rank == np.repeat(least, size))[0]
            run = np.append(True, np.diff(at) != 1)
            inside = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            odd = inside % 2 == 0
            at, adjoins = at[odd], (inside[odd] > 0)
            new = made[at]
            # the pairs that a merge makes with its neighbours, as they stand at that time
            left, right = np.maximum(at - 1, 0), np.minimum(at + 2, len(symbol) - 1)
            before = np.where(adjoins, np.append(-1, new[:-1]), symbol[left])
            worse = rank[at]
            disturbs = (at > 0) & (word[left] == word[at]) & (self.rank(before, new)[0] <= worse)
            disturbs |= (at + 2 < len(symbol)) & (word[right] == word[at]) & (self.rank(new, symbol[right])[0] <= worse)
            # of each word, those up to the first that disturbs
            earlier = np.cumsum(disturbs) - disturbs
            starts = np.append(True, word[at][1:] != word[at][:-1])
            base = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
            chosen = earlier == earlier[base]
            at, new = at[chosen], new[chosen]
            symbol[at] = new
            stays = np.ones(len(symbol), bool)
            stays[at + 1] = False
            symbol, word, rank, made = symbol[stays], word[stays], rank[stays], made[stays]
            at -= np.arange(len(at))
            touched = np.zeros(len(symbol), bool)
            touched[at] = touched[at[at > 0] - 1] = True
            at = np.nonzero(touched)[0]
            rank[at], made[at] = ranks(at)
        return out

    def _heap(self, word: str) -> list[int]:
        """One long word, merged pair by pair in the same order."""
        symbol = self._symbols(word).tolist()
        after, before = list(range(1, len(symbol) + 1)), list(range(-1, len(symbol) - 1))
        queue: list[tuple[int, int, int, int, int]] = []

        def look(a: int) -> None:
            b = after[a]
            found = self.pairs.get(symbol[a] * self.base + symbol[b]) if b < len(symbol) else None
            if found:
                heapq.heappush(queue, (found[0], a, symbol[a], symbol[b], found[1]))

        for a in range(len(symbol) - 1):
            look(a)
        while queue:
            _, a, left, right, made = heapq.heappop(queue)
            b = after[a]
            if symbol[a] != left or b >= len(symbol) or symbol[b] != right:
                continue
            symbol[a], symbol[b] = made, -1
            after[a] = after[b]
            if after[a] < len(symbol):
                before[after[a]] = a
            look(a)
            if before[a] >= 0:
                look(before[a])
        return [s for s in symbol if s >= 0]


@functools.lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Encoder:
    """Encodes lists of texts and remembers words; one for each task."""

    def __init__(self, path: str) -> None:
        self.model = model(path)
        self.names = [str(k) for k in range(self.model.n_pieces)]
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.flat, self.begin = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text."""
        if len(self.known) > REMEMBERED:
            self.forget()
        old, number = len(self.known), self.known.__getitem__
        found = [np.array(list(map(number, self.model.words(self.model.library.normalize(t)))), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        if len(self.known) > old:
            ids, size = self.model.merged(list(itertools.islice(self.known, old, None)))
            self.begin = np.append(self.begin, len(self.flat) + np.cumsum(size))
            self.flat = np.append(self.flat, ids)
        for at in found:
            size = self.begin[at + 1] - self.begin[at]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            yield self.flat[np.repeat(self.begin[at], size) + inside].tolist()

    def digested(self, texts: list[str | None], with_ids: bool) -> Iterator[tuple]:
        for ids in self.encode(texts):
            decoded = self.model.library.decode(ids)
            row = (len(ids), hashlib.sha256(",".join([self.names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            yield (*row, ids, decoded) if with_ids else row


def sentence_pieces(docs: DataFrame, path: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number and digest of each text's ids, and the digest of the text they decode to.

    path names a model that every executor has; with_ids adds the ids
    themselves and the decoded text.
    """
    path = path or public_tokenizers.path(MODEL)

    def task():
        encoder = Encoder(path)
        return lambda texts: encoder.digested(texts, with_ids)

    return per_row(id_and_text(docs, id_col, text_col), task, ADDED + ", ids array<long>, decoded string" * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
