"""Evaluation passages in training text, found by an FM-index of every training shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Consecutive words that an item and a document must share.
WORDS = 16
#: Words of a shard's index; a longer document is indexed in overlapping pieces.
SHARD_WORDS = 1_000_000
#: Words of evaluation items searched for in one pass; more items make more passes.
PASS_WORDS = 2_000_000
#: Occurrences, each with its item, that are put together at once.
OCCURRENCES = 2_000_000
#: Every so manieth text position keeps its suffix position.
SAMPLED = 16


def words_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The words of all texts and the number of the text each belongs to.

    Words are the pieces between whitespace in lower case, reduced to letters and digits; empty ones are dropped.
    Null texts have none.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.cast(texts, pa.large_string())
    bare = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}\s\p{Z}\x0b\x1c-\x1f\x{85}]+", "")
    split = pc.utf8_split_whitespace(bare)
    flat, parent = pc.list_flatten(split), pc.list_parent_indices(split)
    some = pc.not_equal(flat, "")
    return pc.filter(parent, some).to_numpy(), pc.filter(flat, some)


class BitRanks:
    """Bits with constant-time counts of ones before a position."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletTree:
    """Counts of any symbol before any position of a sequence, one bit vector per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        self.levels, self.zeros = [], []
        for level in range(self.depth - 1, -1, -1):
            bits = (symbols >> level) & 1
            self.levels.append(BitRanks(bits))
            self.zeros.append(int((bits == 0).sum()))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        # Where each symbol's run starts in the last order.
        self.start = np.searchsorted(self._reversed(symbols), self._reversed(np.arange(size)), side="left")

    def _reversed(self, s: np.ndarray) -> np.ndarray:
        """Symbols in the last order sort by their bits from the lowest to the highest."""
        out = np.zeros_like(s)
        for level in range(self.depth):
            out = (out << 1) | ((s >> level) & 1)
        return out

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        i = i.copy()
        for n, level in enumerate(self.levels):
            bit = (symbol >> (self.depth - 1 - n)) & 1
            ones = level.ones(i)
            i = np.where(bit == 1, self.zeros[n] + ones, i - ones)
        return i - self.start[symbol]

    def access(self, i: np.ndarray) -> np.ndarray:
        i, symbol = i.copy(), np.zeros_like(i)
        for n, level in enumerate(self.levels):
            bit = level.get(i)
            ones = level.ones(i)
            symbol = (symbol << 1) | bit
            i = np.where(bit == 1, self.zeros[n] + ones, i - ones)
        return symbol


class FMIndex:
    """Self-index of a sequence of positive symbols cut into runs by zeros (one follows every run)."""

    def __init__(self, text: np.ndarray, size: int):
        self.text_len, self.size = len(text), size
        order = self._suffixes(text)
        before = text[order - 1]  # the text ends with a zero, so the first suffix wraps to one
        self.tree = WaveletTree(before.astype(np.int64), size)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])[:size]
        # A run's start is sampled too: stepping back beyond it is never needed.
        self.kept = BitRanks(((order % SAMPLED == 0) | (before == 0)).astype(np.uint8))
        self.samples = order[(order % SAMPLED == 0) | (before == 0)]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling; zeros differ from each other by their places."""
        n = len(text)
        ends = text == 0
        rank = text.astype(np.int64) + int(ends.sum())
        rank[ends] = np.arange(int(ends.sum()))
        step = 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[:-step] = rank[step:] + 1 if step < n else 0
            key = rank * (n + int(rank.max()) + 2) + ahead
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank, step = new, step * 2
            if rank[order[-1]] == n - 1 or step >= n:
                return order

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one row of the suffixes that start with each phrase, all phrases stepping back together."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.text_len, np.int64)
        alive = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column]
            a = self.first[symbol] + self.tree.rank(symbol, low[alive])
            b = self.first[symbol] + self.tree.rank(symbol, high[alive])
            low[alive], high[alive] = a, b
            alive = alive[b > a]
            if not len(alive):
                break
        dead = np.ones(len(phrases), bool)
        dead[alive] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to the nearest sampled one."""
        rows, out, steps = rows.copy(), np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        alive = np.arange(len(rows))
        while len(alive):
            kept = self.kept.get(rows[alive]) == 1
            done = alive[kept]
            out[done] = self.samples[self.kept.ones(rows[done])] + steps[done]
            alive = alive[~kept]
            symbol = self.tree.access(rows[alive])
            rows[alive] = self.first[symbol] + self.tree.rank(symbol, rows[alive])
            steps[alive] += 1
        return out


class Phrases:
    """All runs of ``WORDS`` words of the items, each once, with the items that have it."""

    def __init__(self, item_ids: np.ndarray, texts: pa.Array, width: int = WORDS):
        parent, words = words_of(texts)
        self.vocabulary = pc.unique(words)
        codes = pc.index_in(words, value_set=self.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.arange(max(0, len(codes) - width + 1))
        at = at[parent[at] == parent[at + width - 1]] if len(at) else at
        windows = codes[at[:, None] + np.arange(width)] if len(at) else np.zeros((0, width), np.int64)
        self.width = width
        self.phrases, which = np.unique(windows, axis=0, return_inverse=True) if len(at) else (windows, np.zeros(0, int))
        pairs = np.unique(np.stack([which.ravel(), item_ids[parent[at]]]), axis=1) if len(at) else np.zeros((2, 0), int)
        self.item = pairs[1]
        self.item_from = np.searchsorted(pairs[0], np.arange(len(self.phrases) + 1))


class Shard:
    """Documents' words as one text with its FM-index; it knows nothing of the items.

    ``docs`` and ``places`` say of every piece of text, by its start, whose it is and at which word of the document it begins.
    """

    def __init__(self, pieces: list[tuple[pa.Array, int, int]]):
        words = pa.concat_arrays([p[0] for p in pieces]).dictionary_encode()
        self.vocabulary = words.dictionary
        codes = words.indices.to_numpy().astype(np.int64) + 1
        sizes = np.array([len(p[0]) for p in pieces])
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        text = np.zeros(len(codes) + len(pieces), np.int64)
        text[np.arange(len(codes)) + np.repeat(np.arange(len(pieces)), sizes)] = codes
        self.docs, self.places = np.array([p[1] for p in pieces]), np.array([p[2] for p in pieces])
        self.index = FMIndex(text, len(self.vocabulary) + 1)

    def spans(self, phrases: Phrases) -> Iterator[pa.RecordBatch]:
        """Spans of words that repeat phrases, some occurrences at a time; a phrase with a word the shard lacks cannot occur."""
        known = pc.fill_null(pc.index_in(phrases.vocabulary, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        own = known[phrases.phrases]
        there = np.flatnonzero((own > 0).all(1))
        if not len(there):
            return
        low, high = self.index.search(own[there])
        hit = np.flatnonzero(high > low)
        many = (high - low)[hit] * np.diff(phrases.item_from)[there[hit]]
        turn = (np.cumsum(many) - many) // OCCURRENCES
        for t in np.unique(turn):
            some = hit[turn == t]
            yield self._located(phrases, there[some], low[some], high[some])

    def _located(self, phrases: Phrases, which: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
        many = high - low
        phrase = np.repeat(which, many)
        at = self.index.locate(np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many))
        piece = np.searchsorted(self.starts, at, side="right") - 1
        word = self.places[piece] + at - self.starts[piece]
        per = phrases.item_from[phrase + 1] - phrases.item_from[phrase]
        item = phrases.item[np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(phrases.item_from[phrase], per)]
        doc, word = np.repeat(self.docs[piece], per), np.repeat(word, per)
        order = np.lexsort((word, item, doc))
        doc, item, word = doc[order], item[order], word[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (word[1:] > word[:-1] + phrases.width)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(new)) - 1
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[first], pa.int64()), pa.array(item[first], pa.int64()), pa.array(word[first], pa.int64()), pa.array(word[last] + phrases.width, pa.int64())],
            ["doc_id", "item_id", "first_word", "end_word"],
        )


def shards(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Shard]:
    """Shards of about ``SHARD_WORDS`` words of all documents with at least ``width``; a longer document is cut in pieces that overlap by ``width - 1`` words."""
    held: list[tuple[pa.Array, int, int]] = []
    size = 0
    for b in batches:
        parent, words = words_of(b.column("text"))
        docs = b.column("doc_id").to_numpy(zero_copy_only=False)
        cut = np.searchsorted(parent, np.arange(len(docs) + 1))
        for d in np.flatnonzero(np.diff(cut) >= width):
            n = cut[d + 1] - cut[d]
            for place in range(0, max(1, n - width + 1), SHARD_WORDS):
                piece = words.slice(cut[d] + place, min(n - place, SHARD_WORDS + width - 1))
                held.append((piece, docs[d], place))
                size += len(piece) + 1
                if size >= SHARD_WORDS:
                    yield Shard(held)
                    held, size = [], 0
    if held:
        yield Shard(held)


def leaked_spans(documents: DataFrame, items: DataFrame, width: int = WORDS) -> DataFrame:
    """``doc_id, item_id, first_word, end_word``: merged spans of document words that repeat ``width`` or more words of an item.

    ``documents`` has ``doc_id, text``, ``items`` has ``item_id, text``. Every task turns its documents into
    shards, builds an FM-index of all words of each and searches all phrases of the items in it at once, stepping
    back through the ranks of a wavelet tree; occurrences are located by sampled suffix positions.
    Documents are never shuffled; only spans leave a task. Items are broadcast in groups of at most
    ``PASS_WORDS`` words, each searched in its own pass over the documents and taken back before the next.

    Null and empty texts and items shorter than ``width`` words match nothing. Equal documents each
    come out. Very long texts are indexed in pieces that overlap by ``width - 1`` words, so no
    passage is lost; their spans are joined again.
    """
    spark = documents.sparkSession
    sized = items.select("item_id", "text", F.coalesce(F.size(F.split("text", r"\s+")), F.lit(0)).alias("n"))
    total = sized.agg(F.sum("n")).collect()[0][0] or 0
    passes = int(total // PASS_WORDS) + 1
    found = None
    for turn in range(passes):
        part = sized.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == turn).select("item_id", "text").toArrow()
        shared = spark.sparkContext.broadcast(Phrases(part["item_id"].to_numpy(), part["text"], width))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            if len(phrases.phrases):
                for shard in shards(batches, phrases.width):
                    yield from shard.spans(phrases)

        one = documents.select("doc_id", "text").mapInArrow(search, "doc_id long, item_id long, first_word long, end_word long")
        if passes > 1:
            one = materialize(one, "p8-spans")
            shared.unpersist()
        found = one if found is None else found.unionByName(one)
    w = Window.partitionBy("doc_id", "item_id").orderBy("first_word")
    reach = found.withColumn("reach", F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    part = reach.withColumn("span", F.sum((F.coalesce(F.col("first_word") > F.col("reach"), F.lit(True))).cast("int")).over(w))
    return part.groupBy("doc_id", "item_id", "span").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word")).drop("span")
