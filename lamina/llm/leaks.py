"""Evaluation texts that appear, wholly or in part, in training documents.

Words are runs of letters and digits, equal if ``Folding.same_word`` says so. Training documents
are scanned once, in shards of bounded size inside one Arrow map, without a shuffle. In each shard

1. ranks of 1, 2, 4, ... words are made by doubling; every test suffix is binary-searched among
   the shard's suffixes, which gives the interval of those that agree with it in ``min_words`` words
   (a class). Suffixes outside all common classes cannot match and are dropped;
2. what is left, training and test, is doubled on until the order of the suffixes is complete:
   the suffix array;
3. for each document and item of a class, every suffix of the one that has fewer is binary-searched
   in the other's part of the array; the longest match is with one of its two neighbours there, its
   length is read off the ranks. Matches that go on to the left are dropped, since the longer one is
   found elsewhere; the longest one of each document and item is reported with its location.

Work for a document and item grows with the fewer of their suffixes in a class, never with the
product, however often either repeats itself.

Order and search use coarse words, in which look-alike letters and letters alike in the other case
are one. An exact check of the reported match follows: if its words are not the same after all,
that document and item are compared word by word, so nothing is lost and nothing false is kept.

The test items are read in blocks of at most ``block_words`` words, each broadcast, so that the size of a
broadcast is bounded whatever the size of the test set; of several blocks each is run and released
before the next is read. Null, empty and short texts (fewer than ``min_words`` words) match nothing.
Repeated documents are reported each, repeated items too. Rows without a key are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import block_by_block
from .fold import Folding, folding

MIN_WORDS = 12
SHARD_WORDS = 1_000_000
BLOCK_WORDS = 1_000_000
#: Suffixes of one document and item that are compared at a time (some 100 bytes each).
PAIR_ROWS = 1_000_000
_TEXT = "text that is read"


def words(text: str | None) -> list[str]:
    """The coarse words of a text."""
    return folding().coarse_words(text)


def rest_of_stretch(ids: np.ndarray) -> np.ndarray:
    """How many words follow from each place to the next 0."""
    ends = np.flatnonzero(ids == 0)
    return ends[np.searchsorted(ends, np.arange(len(ids)))] - np.arange(len(ids))


def doubled(ids: np.ndarray, rest: np.ndarray, limit: int | None = None) -> list[np.ndarray]:
    """Ranks of the first 1, 2, 4, ... words of each suffix (shorter ones at the end of a stretch),
    up to ``limit`` words, or until no longer prefix tells suffixes apart. The last is the order of
    the suffixes: with ``limit`` None that of whole suffixes."""
    ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
    width, kinds = 1, int(ranks[0].max(initial=0)) + 1
    while width < min(int(rest.max(initial=0)), limit or len(ids)):
        rank = ranks[-1]
        after = np.zeros(len(ids), np.int64)
        far = np.flatnonzero(rest > width)
        after[far] = rank[far + width]
        rank = np.unique(rank * kinds + after, return_inverse=True)[1].astype(np.int64)
        ranks.append(rank)
        width, kinds = 2 * width, int(rank.max()) + 1
    return ranks


def first_words(ranks: list[np.ndarray], rest: np.ndarray, n: int) -> np.ndarray:
    """A number for the first ``n`` words of each suffix; -1 where there are fewer."""
    key, taken = None, 0
    for i in range(n.bit_length()):
        if n >> i & 1:
            at = np.minimum(np.arange(len(rest)) + taken, len(rest) - 1)
            part = ranks[i][at] if i < len(ranks) else np.zeros(len(rest), np.int64)
            key = part if key is None else np.unique(key * (int(part.max(initial=0)) + 1) + part, return_inverse=True)[1]
            taken += 1 << i
    return np.where(rest >= n, key, -1)


def common_length(ranks: list[np.ndarray], rest: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words in which the suffixes at ``a`` and ``b`` agree."""
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for i in range(len(ranks) - 1, -1, -1):
        same = (ranks[i][a] == ranks[i][b]) & (rest[a] >= 1 << i) & (rest[b] >= 1 << i)
        step = np.where(same, 1 << i, 0)
        a, b, out = a + step, b + step, out + step
    return out


class Stream:
    """Words of several owners as one array: numbers with a 0 behind each stretch, owner and place."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, place: np.ndarray):
        self.ids, self.owner, self.place = ids, owner, place

    @classmethod
    def of(cls, rows: list[list[int]], least: int = 1) -> "Stream":
        """Stretches of at least ``least`` words without a 0."""
        size = np.array([len(r) + 1 for r in rows], np.int64)
        if not len(size):
            return cls(*(np.zeros(0, np.int64) for _ in range(3)))
        ids = np.fromiter((x for r in rows for x in (*r, 0)), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(rows)), size)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
        whole = cls(ids, owner, place)
        return whole.only(rest_of_stretch(ids) >= 1, least)

    def only(self, covered: np.ndarray, least: int = 1) -> "Stream":
        """The stretches of covered places, if of ``least`` words, each with a 0 behind it."""
        edge = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= least
        starts, ends = starts[long], ends[long]
        size = ends - starts + 1
        at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        at = np.minimum(at, len(self.ids) - 1)
        ids = self.ids[at].copy()
        ids[np.cumsum(size) - 1] = 0
        return Stream(ids, self.owner[at], self.place[at])

    def __add__(self, other: "Stream") -> "Stream":
        return Stream(*(np.concatenate([getattr(self, c), getattr(other, c)]) for c in ("ids", "owner", "place")))


def _covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Places inside ``n`` words from some start."""
    change = np.zeros(len(starts) + n, np.int64)
    at = np.flatnonzero(starts)
    change[at] = 1
    np.add.at(change, at + n, -1)
    return np.cumsum(change)[: len(starts)] > 0


def _pairs(few: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All combinations of the entries of ``few`` and ``many`` that have the same number; both sorted."""
    lo, hi = np.searchsorted(many, few, "left"), np.searchsorted(many, few, "right")
    n = hi - lo
    a = np.repeat(np.arange(len(few)), n)
    return a, np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(a))


class _Side:
    """Suffixes of documents (or items) in common classes, grouped by class and owner, in suffix order."""

    def __init__(self, at: np.ndarray, klass: np.ndarray, owner: np.ndarray, rank: np.ndarray):
        order = np.lexsort((at, rank, owner, klass))
        self.at, self.rank = at[order], rank[order]
        klass, owner = klass[order], owner[order]
        starts = np.flatnonzero(np.r_[True, (klass[1:] != klass[:-1]) | (owner[1:] != owner[:-1])])
        self.start, self.stop = starts, np.r_[starts[1:], len(at)]
        self.klass, self.owner = klass[starts], owner[starts]
        self.group = np.repeat(np.arange(len(starts)), self.stop - self.start)

    @property
    def size(self) -> np.ndarray:
        return self.stop - self.start


def _neighbours(asking: _Side, groups: np.ndarray, array: _Side, targets: np.ndarray, top: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Binary search of every suffix of ``groups`` of one side in the groups ``targets`` of the
    other: (entry of ``groups``, own place, place of a neighbour)."""
    size = asking.size[groups]
    first = np.cumsum(size) - size
    key = array.group * top + array.rank
    begin = 0
    while begin < len(groups):
        end = max(begin + 1, int(np.searchsorted(first, first[begin] + PAIR_ROWS, "right")) - 1) if first[-1] - first[begin] >= PAIR_ROWS else len(groups)
        n = size[begin:end]
        entry = np.repeat(np.arange(begin, end), n)
        own = np.repeat(asking.start[groups[begin:end]] - (np.cumsum(n) - n), n) + np.arange(len(entry))
        target = targets[entry]
        spot = np.searchsorted(key, target * top + asking.rank[own])
        for near in (spot - 1, spot):
            inside = (near >= array.start[target]) & (near < array.stop[target])
            yield entry[inside], asking.at[own[inside]], array.at[near[inside]]
        begin = end


def longest_matches(docs: Stream, test: Stream, n: int) -> np.ndarray:
    """Rows (owner in ``docs``, owner in ``test``, words, place in the document, place in the
    item): the longest match of each document and item. Of several equally long ones it is one that
    stands next to the other side's in the order of suffixes, which depends on these two texts alone."""
    none = np.zeros((0, 5), np.int64)
    both = docs + test
    if not len(docs.ids) or not len(test.ids):
        return none
    rest = rest_of_stretch(both.ids)
    klass = first_words(doubled(both.ids, rest, n), rest, n)
    split = len(docs.ids)
    common = np.intersect1d(klass[:split], klass[split:])
    alive = np.isin(klass, common[common >= 0])
    if not alive.any():
        return none
    covered = _covered(alive, n) & (both.ids > 0)
    docs, test = docs.only(covered[:split]), test.only(covered[split:])
    both, split = docs + test, len(docs.ids)
    rest = rest_of_stretch(both.ids)
    ranks = doubled(both.ids, rest)
    klass = first_words(ranks, rest, n)
    at = np.flatnonzero(klass >= 0)
    order, top = ranks[-1], int(ranks[-1].max()) + 1
    d, t = (_Side(x, klass[x], both.owner[x], order[x]) for x in (at[at < split], at[at >= split]))
    a, b = _pairs(d.klass, t.klass)
    fewer = d.size[a] <= t.size[b]
    best: list[np.ndarray] = []
    for asking, array, own, other, of_docs in ((d, t, a[fewer], b[fewer], True), (t, d, b[~fewer], a[~fewer], False)):
        if not len(own):
            continue
        for _, x, y in _neighbours(asking, own, array, other, top):
            p, q = (x, y) if of_docs else (y, x)
            before = both.ids[np.maximum(p - 1, 0)]
            goes_left = (p > 0) & (q > split) & (before > 0) & (before == both.ids[np.maximum(q - 1, 0)])
            p, q = p[~goes_left], q[~goes_left]
            length = common_length(ranks, rest, p, q)
            long = length >= n
            p, q, length = p[long], q[long], length[long]
            rows = np.stack([both.owner[p], both.owner[q], length, both.place[p], both.place[q]], 1)
            best.append(_first_of_pairs(rows))
    return _first_of_pairs(np.concatenate(best)) if best else none


def _first_of_pairs(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort((rows[:, 4], rows[:, 3], -rows[:, 2], rows[:, 1], rows[:, 0]))]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[keep]


def exact_match(fold: Folding, doc: list[str], item: list[str]) -> tuple[int, int, int]:
    """Words, place in the document, place in the item of the longest match under ``same_word``;
    one row of the table of common suffixes at a time."""
    kinds = list(dict.fromkeys(doc))
    number = {w: i for i, w in enumerate(kinds)}
    at = np.array([number[w] for w in doc], np.int64)
    known: dict[str, np.ndarray] = {}
    run, best = np.zeros(len(doc) + 1, np.int64), (0, 0, 0)
    for j, w in enumerate(item):
        if w not in known:
            known[w] = np.array([fold.same_word(w, x) for x in kinds], bool)
        run[1:] = np.where(known[w][at], run[:-1] + 1, 0)
        i = int(run.argmax())
        if run[i] > best[0]:
            n = int(run[i])
            best = n, i - n, j + 1 - n
    return best


class TestSet:
    """A block of items: vocabulary of coarse words, their stream, and the texts for the check."""

    __test__ = False

    def __init__(self, fold: Folding, items: list[tuple[int, str]], n: int):
        self.fold, self.n = fold, n
        self.keys = [k for k, _ in items]
        self.texts = [t for _, t in items]
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        self.stream = Stream.of([[number(w, len(self.vocabulary) + 1) for w in fold.coarse_words(t)] for _, t in items], n)

    def matches(self, docs: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(place in ``docs``, item key, words, place in the document, place in the item)."""
        number = self.vocabulary.get
        rows = longest_matches(Stream.of([[number(w, 0) for w in self.fold.coarse_words(t)] for t in docs], self.n), self.stream, self.n)
        out, written = [], {}
        for d, i, size, p, q in rows.tolist():
            doc = written.get(d)
            if doc is None:
                written = {d: (doc := self.fold.words(docs[d]))}  # rows come by document
            item = self.fold.words(self.texts[i])
            if not all(map(self.fold.same_word, doc[p : p + size], item[q : q + size])):
                size, p, q = exact_match(self.fold, doc, item)
            if size >= self.n:
                out.append((d, self.keys[i], size, p, q))
        return out


def _blocks(items: DataFrame, key: str, text: str, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """Test items in blocks of bounded size, one block on the driver at a time."""
    block, n = [], 0
    rows = items.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{text}`").alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    for r in rows.toLocalIterator():
        block.append((r.k, r.t))
        n += 1 + r.t.count(" ")
        if n >= block_words:
            yield block
            block, n = [], 0
    if block:
        yield block


def verbatim_matches(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, min_words: int = MIN_WORDS, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc key, item key (bigint), n_words, doc_word, item_word: the longest verbatim match of
    each document and item, if of at least ``min_words`` words; places count words from 0. If both
    keys have one name, the item's is prefixed with ``item_``."""
    spark, fold = docs.sparkSession, folding()
    own_key, item_key = item_key, item_key if item_key != doc_key else f"item_{item_key}"
    rows = docs.select(F.col(f"`{doc_key}`").alias(doc_key), F.col(f"`{doc_text}`").alias(_TEXT)).where(f"`{doc_key}` IS NOT NULL AND `{_TEXT}` <> ''")
    schema = f"`{doc_key}` {dict(rows.dtypes)[doc_key]}, `{item_key}` bigint, n_words bigint, doc_word bigint, item_word bigint"

    def search(shared) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys: list[pa.Array] = []
            texts: list[str] = []
            size = 0

            def flush() -> pa.RecordBatch:
                cols = list(zip(*shared.value.matches(texts))) or [()] * 5
                own = pa.concat_arrays(keys).take(pa.array(cols[0], pa.int64()))
                return pa.RecordBatch.from_arrays([own, *(pa.array(c, pa.int64()) for c in cols[1:])], names=[doc_key, item_key, "n_words", "doc_word", "item_word"])

            for b in batches:
                begin = 0
                own = b.column(1).to_pylist()
                for i, t in enumerate(own, 1):
                    size += 1 + len(t) // 5
                    if size >= shard_words or i == len(own):
                        keys.append(b.column(0).slice(begin, i - begin))
                        texts += own[begin:i]
                        begin = i
                    if size >= shard_words:
                        yield flush()
                        keys, texts, size = [], [], 0
            if texts:
                yield flush()

        return rows.mapInArrow(work, schema)

    tests = (TestSet(fold, block, min_words) for block in _blocks(items, own_key, item_text, block_words))
    found = block_by_block(spark, tests, search)
    return spark.createDataFrame([], schema) if found is None else found


def remove_affected(docs: DataFrame, doc_key: str, matches: DataFrame) -> DataFrame:
    """The documents without those that hold a match; rows without a key stay."""
    return docs.join(matches.select(doc_key).distinct(), doc_key, "left_anti")
