"""Benchmark decontamination: a BM25 index of test items, searched with every training passage by block-max WAND.

Impacts are divided by the item's score for its own text, so 1 means that a passage holds all of an item. Items of like
length share an index. For each, every document is cut into passages that overlap by half and are at least twice as long
as its longest item, so each whole occurrence of an item lies in one passage, and a long item does not make passages
long for short ones. A passage retrieves all items that score THRESHOLD or more. Retrieved items
are then verified on the passage: five-word shingles of the whole item, and words of its question and of its answer
(the last sentence, with at least ANSWER_WORDS words), must occur there.

Before the search, a passage's bound for each of BLOCKS ranges of items is added up for a whole batch with numpy; the
search then visits only ranges whose bound reaches the threshold. The index goes to executors in slices of at most
SLICE_BYTES of item text; a larger benchmark takes one pass for each slice. Document frequencies and the average length
are those of the whole benchmark in every slice and index, so its size and cuts do not change a score.

Defined results: null or empty texts and items match nothing; an item without a word matches nothing; items with null
identifiers are left out; repeated rows give repeated results; an empty table on either side gives an empty table.
Case and punctuation do not count: words are runs of ASCII letters and digits and of all bytes from 128 on.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Words, arrow_map, by_pieces, materialise, rolling

K1, B = 1.2, 0.75
THRESHOLD = 0.6
SHINGLE, MIN_OVERLAP = 5, 0.8
ANSWER_WORDS = 5
BLOCKS = 32
SLICE_BYTES = 16 << 20
#: Passages have so many words at least; items of up to MIN_PASSAGE * LENGTH_STEP**k words share an index.
MIN_PASSAGE, LENGTH_STEP = 64, 4

BLANKS = np.ones(256, bool)
BLANKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def lowered(text: str | None) -> bytes:
    return (text or "").lower().encode()


def word_hashes(text: str | None) -> np.ndarray:
    return Words([lowered(text)], BLANKS).hashes(lower=False)


class Item:
    """A test item as verification needs it."""

    def __init__(self, item_id: int, text: str):
        self.item_id = item_id
        self.words = word_hashes(text)
        self.width = min(SHINGLE, len(self.words))
        self.shingles = np.unique(rolling(self.words, self.width))
        answer_words = max(len(word_hashes(SENTENCE.split(text.strip())[-1])), min(ANSWER_WORDS, len(self.words)))
        self.answer = np.unique(self.words[-answer_words:])
        self.question = np.unique(self.words[:-answer_words]) if answer_words < len(self.words) else self.answer

    def verify(self, passage: np.ndarray) -> tuple[float, float, float]:
        """Shares of the item's shingles, of its question's words and of its answer's words that the passage holds."""
        share = lambda part, whole: float(np.isin(part, whole).mean())
        return share(self.shingles, rolling(passage, self.width)), share(self.question, passage), share(self.answer, passage)


@dataclass
class Corpus:
    """Statistics of a whole benchmark: items with a word, their mean length, and how many hold each term (sorted)."""

    items: int
    average: float
    terms: np.ndarray
    df: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Corpus:
        """From all texts at once."""
        words = [w for w in map(word_hashes, texts) if len(w)]
        terms, df = np.unique(np.concatenate([np.unique(w) for w in words]) if words else np.zeros(0, np.uint64), return_counts=True)
        return cls(len(words), float(np.mean([len(w) for w in words])) if words else 1.0, terms, df)


class Index:
    """Inverted index with block maxima. Items are numbered in order; a block is a range of numbers."""

    def __init__(self, items: list[tuple[int, str]], corpus: Corpus | None = None):
        corpus = corpus or Corpus.of([t for _, t in items])
        self.items = [i for i in (Item(k, t) for k, t in sorted(items)) if len(i.words)]
        n = len(self.items)
        self.passage = max(MIN_PASSAGE, 2 * max((len(i.words) for i in self.items), default=0))
        self.block_size = max(1, -(-n // BLOCKS))
        self.blocks = -(-n // self.block_size) if n else 0
        counts = [np.unique(i.words, return_counts=True) for i in self.items]
        self.terms = np.unique(np.concatenate([c[0] for c in counts])) if counts else np.zeros(0, np.uint64)
        df = corpus.df[np.searchsorted(corpus.terms, self.terms)] if n else np.zeros(0)
        idf = np.log1p((corpus.items - df + 0.5) / (df + 0.5))
        average = corpus.average
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        self.maxima = np.zeros((len(self.terms) + 1, self.blocks), np.float32)
        for number, (terms, tf) in enumerate(counts):
            at = np.searchsorted(self.terms, terms)
            weight = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(self.items[number].words) / average))
            weight /= weight.sum()
            for t, w in zip(at.tolist(), weight.tolist(), strict=True):
                postings[t].append((number, w))
            b = number // self.block_size
            self.maxima[at, b] = np.maximum(self.maxima[at, b], weight * (1 + 1e-6))
        self.numbers = [[p[0] for p in ps] for ps in postings]
        self.weights = [[p[1] for p in ps] for ps in postings]
        self.block_top = self.maxima.tolist()
        self.top = [max(row, default=0.0) for row in self.block_top]

    def bounds(self, terms: np.ndarray, half: np.ndarray, halves: int) -> np.ndarray:
        """An upper bound of any item's score for each run of words and block; term len(self.terms) is unknown."""
        out = np.zeros((halves, self.blocks), np.float32)
        if len(terms):
            where = np.flatnonzero(np.concatenate(([True], half[1:] != half[:-1])))
            out[half[where]] = np.add.reduceat(self.maxima[terms], where, axis=0)
        return out

    def search(self, terms: list[int], open_blocks: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All (item number, score) with score >= threshold for a query of distinct terms, by block-max WAND."""
        least, size = threshold - 1e-9, self.block_size
        found: list[tuple[int, float]] = []
        opened = np.flatnonzero(open_blocks).tolist()
        if not opened:
            return found
        cursors = []  # item, place in the postings, term; an item of -1 is the end
        for t in terms:
            cursors.append(self._advance([self.numbers[t][0], 0, t], opened[0] * size))
        while True:
            cursors = sorted(c for c in cursors if c[0] >= 0)
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.top[c[2]]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            block = item // size
            if not open_blocks[block]:
                later = bisect_left(opened, block)
                if later == len(opened):
                    return found
                for c in cursors:
                    self._advance(c, opened[later] * size)
                continue
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            if sum(self.block_top[c[2]][block] for c in cursors[: pivot + 1]) < least:
                # No item of this block scores enough with these terms: go on after it, or at the next term's item.
                to = (block + 1) * size
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                for c in cursors[: pivot + 1]:
                    self._advance(c, to)
            elif cursors[0][0] == item:
                score = sum(self.weights[c[2]][c[1]] for c in cursors[: pivot + 1])
                if score >= least:
                    found.append((item, score))
                for c in cursors[: pivot + 1]:
                    self._advance(c, item + 1)
            else:
                for c in cursors[:pivot]:
                    self._advance(c, item)

    def _advance(self, cursor: list[int], to: int) -> list[int]:
        """Move to the first posting whose item is at least `to`."""
        numbers = self.numbers[cursor[2]]
        cursor[1] = at = bisect_left(numbers, to, cursor[1])
        cursor[0] = numbers[at] if at < len(numbers) else -1
        return cursor


def indexes(items: list[tuple[int, str]], corpus: Corpus | None = None) -> list[Index]:
    """An index for each class of lengths, by factors of LENGTH_STEP."""
    corpus = corpus or Corpus.of([t for _, t in items])
    classes: dict[int, list[tuple[int, str]]] = {}
    for k, text in items:
        n, step = len(word_hashes(text)), 0
        while n > MIN_PASSAGE * LENGTH_STEP**step:
            step += 1
        classes.setdefault(step, []).append((k, text))
    return [Index(classes[step], corpus) for step in sorted(classes)]


def search_all(own: list[Index], texts: list[bytes]) -> list[tuple[int, int, float, float, float, float]]:
    return sorted(x for index in own for x in search_texts(index, texts))


def search_texts(index: Index, texts: list[bytes], threshold: float = THRESHOLD) -> list[tuple[int, int, float, float, float, float]]:
    """(text number, item, score, overlaps) of verified matches, the best passage for each text and item."""
    if not index.items:
        return []
    w = Words(texts, BLANKS)
    hashes = w.hashes(lower=False)
    at = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    term = np.where(index.terms[at] == hashes, at, len(index.terms))
    stride = index.passage // 2
    halves_of = np.maximum(1, -(-w.count // stride))
    first_half = np.concatenate(([0], np.cumsum(halves_of)))
    half = first_half[w.text] + (np.arange(len(hashes)) - w.first[w.text]) // stride
    # Each term once in each half: a bound that counts it in both halves still is one.
    known = term < len(index.terms)
    pairs = np.unique(half[known] * (len(index.terms) + 1) + term[known])
    single = index.bounds(pairs % (len(index.terms) + 1), pairs // (len(index.terms) + 1), int(first_half[-1]))
    follows = np.ones(len(single), bool)
    follows[first_half[1:] - 1] = False  # a text's last half has no other after it
    both = single.copy()
    both[:-1][follows[:-1]] += single[1:][follows[:-1]]
    open_blocks = both >= threshold - 1e-6
    text_of_half = np.repeat(np.arange(len(texts)), halves_of)
    best: dict[tuple[int, int], tuple] = {}
    for h in np.flatnonzero(open_blocks.any(1)).tolist():
        k = int(text_of_half[h])
        a = int(w.first[k] + (h - first_half[k]) * stride)
        b = min(a + 2 * stride, int(w.first[k + 1]))
        terms = np.unique(term[a:b])
        terms = terms[terms < len(index.terms)].tolist()
        for number, score in index.search(terms, open_blocks[h], threshold):
            item = index.items[number]
            whole, question, answer = item.verify(hashes[a:b])
            if min(whole, question, answer) >= MIN_OVERLAP:
                best[k, item.item_id] = max(best.get((k, item.item_id), ()), (score, whole, question, answer))
    return [(k, item, *v) for (k, item), v in sorted(best.items())]


def slices(benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[list[tuple[int, str]], Corpus]]:
    """The items in slices of bounded size, each read on its own, with the whole benchmark's statistics of its terms."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if total <= slice_bytes:
        own = [tuple(r) for r in items.collect()]
        yield own, Corpus.of([t for _, t in own])
        return
    n = -(-2 * total // slice_bytes)
    items = items.withColumn("slice", F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_pieces(batches, "text"):
            words = [word_hashes(t) for t in batch.column(0).to_pylist()]
            sets = [np.unique(w) for w in words]
            sizes = [len(x) for x in sets]
            every = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(np.repeat(batch.column(1).to_numpy(), sizes)), pa.array(np.repeat([len(w) for w in words], sizes)), pa.array(np.concatenate([np.zeros(0, bool), *(np.arange(k) == 0 for k in sizes)]))], names=["term", "slice", "length", "first"])

    terms = materialise(arrow_map(items.select("text", "slice"), run, "term long, slice int, length long, first boolean"), "benchmark-terms")
    count, average = terms.where("first").agg(F.count(F.lit(1)), F.avg("length")).first()
    df = materialise(terms.select("term", "slice").distinct().join(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term"), "benchmark-frequencies")
    for k in range(n):
        known = sorted((r["term"] & 0xFFFFFFFFFFFFFFFF, r["df"]) for r in df.where(F.col("slice") == k).collect())
        corpus = Corpus(count, average or 1.0, np.array([t for t, _ in known], np.uint64), np.array([d for _, d in known], np.int64))
        yield [tuple(r) for r in items.where(F.col("slice") == k).select("item_id", "text").collect()], corpus


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, score, overlap, question_overlap, answer_overlap."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
    rows = documents.select("doc_id", "text")

    def searcher(own: list[Index]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in by_pieces(batches, "text", 2 << 20):
                found = search_all(own, [lowered(t) for t in batch.column(1).to_pylist()])
                if found:
                    columns = list(zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0])), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[2:])], names=["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

        return run

    out = None
    for items, corpus in slices(benchmark):
        part = arrow_map(rows, searcher(indexes(items, corpus)), schema)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item, in one pass and without a shuffle; null identifiers make no difference."""
    out = documents
    for items, corpus in slices(benchmark):
        out = arrow_map(out, _cleaner(indexes(items, corpus)), documents.schema)
    return out


def _cleaner(own: list[Index]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_pieces(batches, "text", 2 << 20):
            hit = {k for k, *_ in search_all(own, [lowered(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()])}
            yield batch.filter(pa.array([k not in hit for k in range(batch.num_rows)], pa.bool_()))

    return run


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
