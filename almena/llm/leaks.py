"""Evaluation texts leaking into training text: BM25 index of the test items, block-max WAND, exact check.

The test items are indexed, the training passages are the queries: every window of
``run`` words of every document. The query is conjunctive (a term that an item lacks
rules the item out), and the threshold of an item is the smallest BM25 score that any
of its own runs has, so a passage that is such a run scores at least that and nothing
is lost. The index is inverted: posting lists of (term, item, impact) and of (term,
block of items, greatest impact). As in block-max WAND, upper bounds decide first: the
greatest impact of each term over all items; then the blocks on the shortest list of the
passage, which must be on the lists of all its terms with enough impact together; then
the items of those blocks likewise. What reaches its item's threshold is checked word by
word. All passages of a batch go through each step together.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almena.llm.tokens import worker_store
from almena.llm.words import words

RUN = 12
K1, B = 1.2, 0.75
#: Items per block of the index.
BLOCK = 16
#: Postings of an index that travels with the tasks (12 bytes each): more are searched in further passes over the documents.
POSTINGS = 4_000_000
#: Distinct pieces of text whose words a worker remembers.
MEMO = 400_000
#: Words of documents handled together.
WORDS_AT_ONCE = 2_000_000


class _Lists:
    """Posting lists: per term the numbers of its items or blocks in order, and their impacts."""

    def __init__(self, term: np.ndarray, at: np.ndarray, impact: np.ndarray, terms: int, width: int):
        key, first = np.unique(term.astype(np.int64) * width + at, return_index=True)
        self.width, self.key, self.impact = width, key, impact[first]
        self.begin = np.searchsorted(key, np.arange(terms + 1, dtype=np.int64) * width)
        self.length = np.diff(self.begin)

    def scores(self, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sum of the impacts of each row of terms (0: none) at a number; minus infinity where a list lacks it."""
        key = terms.astype(np.int64) * self.width + at[:, None]
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        found = self.key[place] == key
        impact = np.where(found, self.impact[place], -np.inf)
        return np.where(terms > 0, impact, 0).sum(axis=1)

    def numbers(self, terms: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of every posting of each row's term, or of those from ``low`` up to ``high``."""
        begin, end = (self.begin[terms], self.begin[terms + 1]) if low is None else (np.searchsorted(self.key, terms.astype(np.int64) * self.width + x) for x in (low, high))
        size = end - begin
        row = np.repeat(np.arange(len(terms)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        return row, self.key[place] - terms[row].astype(np.int64) * self.width


class Index:
    """Inverted BM25 index of test items with greatest impacts by block and overall."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN):
        kept = [(i, w) for i, w in ((i, words(t)) for i, t in items if t) if len(w) >= run]
        self.run = run
        self.items = np.array([i for i, _ in kept], dtype=np.int64)
        frequency = Counter(t for _, w in kept for t in set(w))
        self.terms = {t: k + 1 for k, t in enumerate(sorted(frequency))}
        n, v = len(kept), len(self.terms) + 1
        mean = sum(len(w) for _, w in kept) / max(1, n)
        self.threshold = np.full(max(1, n), np.inf)
        self.runs: list[set[bytes]] = []
        term, item, impact = [], [], []
        for k, (_, w) in enumerate(kept):
            norm = K1 * (1 - B + B * len(w) / mean)
            own = {}
            for t, tf in Counter(w).items():
                idf = math.log(1 + (n - frequency[t] + 0.5) / (frequency[t] + 0.5))
                own[self.terms[t]] = idf * tf * (K1 + 1) / (tf + norm)
            term += own
            item += [k] * len(own)
            impact += own.values()
            ids = [self.terms[t] for t in w]
            windows = np.lib.stride_tricks.sliding_window_view(np.array(ids, dtype=np.int32), run)
            # a hair below, for sums in another order
            self.threshold[k] = min(sum(own[t] for t in set(ids[x : x + run])) for x in range(len(ids) - run + 1)) - 1e-3
            self.runs.append({x.tobytes() for x in windows})
        term, item, impact = np.array(term, dtype=np.int64), np.array(item, dtype=np.int64), np.array(impact, dtype=np.float64)
        self.by_item = _Lists(term, item, impact, v, max(1, n))
        strongest = np.lexsort((-impact, item // BLOCK, term))  # the first of each block has its greatest impact
        self.by_block = _Lists(term[strongest], item[strongest] // BLOCK, impact[strongest], v, -(-max(1, n) // BLOCK))
        self.block_threshold = np.minimum.reduceat(self.threshold, np.arange(0, len(self.threshold), BLOCK))
        self.term_max = np.zeros(v)
        np.maximum.at(self.term_max, term, impact)
        self.key = hash((tuple(self.items), tuple(self.terms)))

    def encode(self, text: str) -> bytes:
        """Term numbers of the words of a text (0: in no item), as 32-bit integers."""
        store = worker_store()
        memo = store.get(("leaks", self.key))
        if memo is None:
            memo = store["leaks", self.key] = _Memo(self.terms)
        return b"".join(map(memo.__getitem__, text.split()))

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, int]]:
        """(number of the text, number of the item) of every run found; pairs may repeat."""
        run = self.run
        if not len(self.items) or not texts:
            return
        gap = np.zeros(1, dtype=np.int32).tobytes()
        ids = np.frombuffer(gap.join(texts), dtype=np.int32)
        if len(ids) < run:
            return
        ends = np.cumsum([len(t) // 4 + 1 for t in texts])
        total = np.concatenate(([0.0], np.cumsum(self.term_max[ids])))
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        possible = (known[run:] - known[:-run] == run) & (total[run:] - total[:-run] >= self.block_threshold.min() - 1e-6)
        starts = np.flatnonzero(possible)
        for part in np.array_split(starts, max(1, len(starts) // 65_536)):
            if not len(part):
                continue
            passages = np.sort(ids[part[:, None] + np.arange(run)], axis=1)
            rarest = passages[np.arange(len(part)), self.by_block.length[passages].argmin(axis=1)]
            passages[:, 1:][passages[:, 1:] == passages[:, :-1]] = 0
            row, block = self.by_block.numbers(rarest)
            fits = self.by_block.scores(passages[row], block) >= self.block_threshold[block]
            row, block = row[fits], block[fits]
            at, item = self.by_item.numbers(rarest[row], block * BLOCK, np.minimum((block + 1) * BLOCK, self.by_item.width))
            row = row[at]
            fits = self.by_item.scores(passages[row], item) >= self.threshold[item]
            for x, k in zip(part[row[fits]], item[fits]):
                if ids[x : x + run].tobytes() in self.runs[k]:
                    yield int(np.searchsorted(ends, x, side="right")), int(k)


class _Memo(dict):
    """Encoded words of a piece of text without white space."""

    def __init__(self, terms: dict[str, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        coded = np.array([self.terms.get(w, 0) for w in words(piece)], dtype=np.int32).tobytes()
        if len(piece) <= 64:
            self[piece] = coded
        return coded


def _indexes(rows: Iterable, run: int, most: int) -> Iterator[Index]:
    """Indexes of consecutive items, each of at most ``most`` postings or of one item."""
    some, size = [], 0
    for r in rows:
        n = len(set(words(r["text"] or "")))
        if some and size + n > most:
            yield Index(some, run)
            some, size = [], 0
        some.append((r["item_id"], r["text"]))
        size += n
    if some:
        yield Index(some, run)


def find_leaks(documents: DataFrame, items: DataFrame, run: int = RUN, most: int = POSTINGS) -> DataFrame:
    """Documents that hold at least ``run`` consecutive words of a test item: doc_id, item_id.

    Each pair appears once. Null and empty texts hold nothing; items of fewer words
    cannot be found. The index travels with the task; items beyond ``most`` postings are
    searched in further passes, so its size is bounded however many there are.
    """
    spark = documents.sparkSession
    found = None
    texts = documents.select(F.col("doc_id").cast("long"), "text")
    rows = items.select(F.col("item_id").cast("long"), "text").filter("item_id IS NOT NULL").dropDuplicates(["item_id", "text"]).orderBy("item_id", "text")
    for index in _indexes(rows.toLocalIterator(), run, most):

        def search(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, coded, size, pairs = batch.column(0).to_pylist(), [], 0, set()
                doc_of = []
                for doc, text in zip(ids, batch.column(1).to_pylist()):
                    if text:
                        doc_of.append(doc)
                        coded.append(index.encode(text))
                        size += len(coded[-1]) // 4
                    if size >= WORDS_AT_ONCE:
                        pairs |= {(doc_of[d], int(index.items[k])) for d, k in index.search(coded)}
                        doc_of, coded, size = [], [], 0
                pairs |= {(doc_of[d], int(index.items[k])) for d, k in index.search(coded)}
                docs, hits = zip(*sorted(pairs, key=repr)) if pairs else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hits, pa.int64())], names=["doc_id", "item_id"])

        part = texts.mapInArrow(search, "doc_id long, item_id long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long")
    return found.distinct()
