"""Encoding of a corpus with a public byte-level tokenizer.

Texts of at most ``leaf_chars`` characters are encoded in place, in Arrow batches, without a
shuffle. Longer ones are halved until the pieces are that short; the pieces are encoded in
parallel and concatenated pairwise as a tree. Around each join a window is encoded again: it
begins at a split point of the left side that no later character can change, and grows to the
right until one of its split points is one of the right side too. From there both sides agree
for good, because the split pattern never looks back. If one unsplit run spans the join, its two
encodings are joined below the pattern: a window of tokens around the seam is encoded again and
grows until the token pairs at both of its edges encode to themselves, which makes the whole
sequence the encoding of the run. The result equals the encoding of the undivided text.

Null and empty texts have an empty list of ids. No special tokens are added, and their spelling
in a text is ordinary text. Rows with a null key keep it.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("LAMINA_TOKENIZERS", "/opt/tokenizers")
LEAF_CHARS = 4096
ANCHORS = 32
#: Longest run (characters) that is encoded again as a whole at a join.
RUN_CHARS = 512
# Fixed value: the split pattern of the vocabulary's public tokenizer, and the same with white
# space spelled out for the library that reports positions.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WHITE = r"\t-\r\x20\x85\xa0  -     　"

_codecs: dict[str, "Codec"] = {}


class Codec:
    """A rank-file vocabulary; one a worker process."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.enc = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN.replace(r"[^\s\p{L}", rf"[^{_WHITE}\p{{L}}").replace(r"(?!\S)", rf"(?![^{_WHITE}])").replace(r"\s", f"[{_WHITE}]"))
        self.bytes_of = {v: k for k, v in ranks.items()}

    @classmethod
    def at(cls, path: str) -> "Codec":
        if path not in _codecs:
            _codecs[path] = cls(path)
        return _codecs[path]

    def encode(self, text: str) -> list[int]:
        return self.enc.encode_ordinary(text)

    def run(self, data: bytes) -> list[int]:
        """Below the split pattern."""
        return self.enc._core_bpe.encode_single_piece(data) if data else []

    def join_runs(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of one run from those of its two parts."""
        if not a or not b:
            return [*a, *b]
        raw, i = self.bytes_of, 1
        fits = lambda x, y: self.run(raw[x] + raw[y]) == [x, y]
        while True:
            left, right = max(0, len(a) - i), min(len(b), i)
            mid = self.run(b"".join(raw[t] for t in a[left:]) + b"".join(raw[t] for t in b[:right]))
            if (left == 0 or fits(a[left - 1], mid[0])) and (right == len(b) or fits(mid[-1], b[right])):
                return [*a[:left], *mid, *b[right:]]
            i *= 2


class Node:
    """An encoded stretch of text: ids, and anchors (character, token) where a split starts."""

    def __init__(self, text: str, ids: list[int], head: list[tuple[int, int]], tail: list[tuple[int, int]]):
        self.text, self.ids, self.head, self.tail = text, ids, head, tail


def leaf(codec: Codec, text: str, ids: list[int] | None = None) -> Node:
    ids = codec.encode(text) if ids is None else ids
    size = lambda s, e: len(codec.run(text[s:e].encode()))
    starts = [m.start() for m in codec.split.finditer(text)]
    first, last = starts[:ANCHORS], starts[-ANCHORS:]
    head = [(0, 0)] if first else []
    for s, e in zip(first, first[1:]):
        head.append((e, head[-1][1] + size(s, e)))
    tail = [(last[-1], len(ids) - size(last[-1], len(text)))] if len(last) > 1 else head[:]
    for e, s in zip(last[:0:-1], last[-2::-1]):
        tail.append((s, tail[-1][1] - size(s, e)))
    return Node(text, ids, head, sorted(tail))


def join(codec: Codec, a: Node, b: Node) -> Node:
    if not a.text or not b.text:
        return a if a.text else b
    text, off = a.text + b.text, len(a.text)
    a_at, b_at = dict(a.tail), dict(b.head)
    # nothing appended can change what lies before a split point three characters from the end
    start = max((c for c in a_at if c <= off - 3), default=0)
    kept = a_at.get(start, 0)
    size, end = RUN_CHARS, None
    while end is None:
        stop, splits = min(len(text), off + size), []
        for m in codec.split.finditer(text[start:stop]):
            s, e = m.start() + start, m.end() + start
            if e > stop - 3 and stop < len(text):
                break
            splits.append((s, e))
            if e - off in b_at or e == len(text):
                end = e
                break
        size *= 4
    mid: list[int] = []
    for s, e in splits:
        whole_b = b.ids if e == len(text) and len(b.head) == 1 else b.ids[: b_at[e - off]] if len(b.head) > 1 and e - off == b.head[1][0] else None
        if s < off < e and e - s > RUN_CHARS and s in a_at and whole_b is not None:
            mid += codec.join_runs(a.ids[a_at[s] :], whole_b)
        else:
            mid += codec.run(text[s:e].encode())
    cut = end - off
    rest = b_at.get(cut, len(b.ids))
    grow = kept + len(mid) - rest
    spots = [x for x in {*a.head, *a.tail} if x[0] <= start]
    spots += [(c + off, t + grow) for c, t in {*b.head, *b.tail} if c >= cut]
    spots.sort()
    first = spots[:ANCHORS]
    if len(a.head) < ANCHORS or first[-1][0] > start:  # the run of first splits may have a gap after the join
        first = [x for x in first if x[0] <= start] or spots[:1]
    return Node(text, [*a.ids[:kept], *mid, *b.ids[rest:]], first, spots[-ANCHORS:])


def join_tree(codec: Codec, nodes: list[Node]) -> Node:
    while len(nodes) > 1:
        nodes = [join(codec, *nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0]


def _lists(rows: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate([np.asarray(r, dtype=np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k.tiktoken", tokenizers: str = TOKENIZERS, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """key and ids (array<int>), one row for each row of ``df``."""
    path = os.path.join(tokenizers, vocabulary)
    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    kind = dict(rows.dtypes)["k"]

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(path)
        for b in batches:
            ids = [codec.encode(t) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids)], names=["k", "ids"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(path)
        for b in batches:
            ids = [codec.encode(t) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("k", "row_id", "no", "t")), _lists(ids)], names=["k", "row_id", "no", "t", "ids"])

    def whole(group: pa.Table) -> pa.Table:
        codec = Codec.at(path)
        group = group.sort_by("no")
        nodes = [leaf(codec, t, i) for t, i in zip(group.column("t").to_pylist(), group.column("ids").to_pylist())]
        return pa.table({"k": group.column("k")[:1].combine_chunks(), "ids": _lists([join_tree(codec, nodes).ids])})

    short = rows.where(f"t IS NULL OR length(t) <= {leaf_chars}").mapInArrow(direct, f"k {kind}, ids array<int>")
    # the number of a row within its file partition: the same in every attempt of a task
    long = rows.where(f"length(t) > {leaf_chars}").withColumn("row_id", F.monotonically_increasing_id())
    long = long.withColumn("len", F.length("t").cast("bigint")).withColumn("n", F.expr(f"cast(pow(2, ceil(log2(len / {leaf_chars}.0D))) as bigint)"))
    parts = long.select("k", "row_id", "len", "n", "t", F.explode(F.expr("sequence(0L, n - 1)")).alias("no")).select(
        "k", "row_id", "no",
        F.expr("substring(t, cast(no * len div n as int) + 1, cast((no + 1) * len div n - no * len div n as int))").alias("t"),
    )
    encoded = parts.repartition("row_id", "no").mapInArrow(leaves, f"k {kind}, row_id bigint, no bigint, t string, ids array<int>")
    joined = encoded.groupBy("row_id").applyInArrow(whole, f"k {kind}, ids array<int>")
    return short.unionByName(joined).withColumnRenamed("k", key)


def tree_depth(chars: int, leaf_chars: int = LEAF_CHARS) -> int:
    """Joins on the way from a leaf to the whole text."""
    return max(0, math.ceil(math.log2(chars / leaf_chars))) if chars > leaf_chars else 0
