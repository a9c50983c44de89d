"""Benchmark passages in training texts, found with suffix arrays over the training words.

Each task cuts its documents into shards.  A shard's suffix array holds, in sorted order, every suffix that a benchmark
could match: its words are numbered by the benchmark's vocabulary, and a suffix that leaves the vocabulary before the
shortest window ends is not kept.  Every benchmark suffix is binary-searched in every shard; the range found gives all
places where its window occurs verbatim.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumbre.llm import scan

#: benchmark words that one pass carries to the tasks; a larger benchmark takes several passes
BLOCK_WORDS = 2_000_000
FIELDS = [("n_words", "long"), ("spans", "array<struct<start:long,length:long>>"), ("items", "array<{item}>"), ("longest", "long")]


class Block:
    """Windows of some benchmark items: their words as ranks of a sorted vocabulary of word hashes, as sortable keys."""

    def __init__(self, items: list, texts: list, window: int):
        column = pa.array(texts, pa.string())
        self.window, self.items = window, items
        parts = list(scan.words(column, scan.ALNUM, lower=True))
        hashes = np.concatenate([p.hashes for p in parts]) if parts else np.zeros(0, np.uint64)
        owner = np.concatenate([p.doc + p.first for p in parts]) if parts else np.zeros(0, np.int64)
        size = np.bincount(owner, minlength=len(items))
        self.vocabulary = np.unique(hashes)
        ranks = np.searchsorted(self.vocabulary, hashes) + 1
        first = np.concatenate([[0], np.cumsum(size)])[owner] if len(owner) else owner
        width = np.minimum(size, window)[owner] if len(owner) else owner
        at = np.flatnonzero(np.arange(len(hashes)) - first + width <= size[owner]) if len(owner) else owner
        keys = suffix_keys(ranks, at, width[at], window)
        self.keys, inverse = np.unique(keys, return_inverse=True)
        self.widths = np.zeros(len(self.keys), np.int64)
        self.widths[inverse] = width[at]
        self.shortest = int(self.widths.min()) if len(self.widths) else window
        pairs = np.unique(np.stack([inverse, owner[at]], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        self.item_of, self.item_at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.keys) + 1))


def suffix_keys(ranks: np.ndarray, at: np.ndarray, width: np.ndarray, window: int) -> np.ndarray:
    """The first ``width`` ranks from each place as byte strings that sort like the suffixes (rank 0 ends a suffix)."""
    padded = np.concatenate([ranks, np.zeros(window, ranks.dtype)])
    table = padded[at[:, None] + np.arange(window)] if len(at) else np.zeros((0, window), np.int64)
    ended = (np.arange(window) >= width[:, None]) | (np.cumsum(table == 0, axis=1) > 0)
    table = np.where(ended, 0, table).astype(">u4")
    return np.ascontiguousarray(table).view(f"S{4 * window}").ravel()


def search(block: Block, words: scan.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window number, first word, length) of each occurrence in the shard."""
    none = np.zeros(0, np.int64)
    if not len(block.keys) or not len(words.hashes):
        return none, none, none
    place = np.searchsorted(block.vocabulary, words.hashes)
    place[place == len(block.vocabulary)] = 0
    ranks = np.where(block.vocabulary[place] == words.hashes, place + 1, 0)
    n = len(ranks)
    stop = (ranks == 0)
    last = np.append(words.doc[1:] != words.doc[:-1], True)
    # the first word at or after each that the suffix cannot pass
    barrier = np.where(stop, np.arange(n), np.where(last, np.arange(n) + 1, n))
    reach = np.minimum.accumulate(barrier[::-1])[::-1] - np.arange(n)
    at = np.flatnonzero(reach >= block.shortest)
    if not len(at):
        return none, none, none
    keys = suffix_keys(ranks, at, np.minimum(reach[at], block.window), block.window)
    order = np.argsort(keys, kind="stable")
    suffixes, keys = at[order], keys[order]
    low = np.searchsorted(keys, block.keys, "left")
    above = np.array([k[:4 * int(w)].ljust(4 * int(w), b"\0") + b"\xff" * (4 * (block.window - int(w))) for k, w in zip(block.keys, block.widths)], f"S{4 * block.window}") \
        if block.shortest < block.window else block.keys
    high = np.searchsorted(keys, above, "right")
    found = np.flatnonzero(high > low)
    count = (high - low)[found]
    which = np.repeat(found, count)
    rows = np.repeat(low[found] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    return which, suffixes[rows], block.widths[which]


def contaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id",
                 item_text: str = "text", window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (runs of words inside any occurrence of a benchmark window: first word and
    length), ``items`` (distinct items with occurring windows, sorted) and ``longest`` (words of the longest span).

    A window is ``window`` consecutive words of an item, or the whole of a shorter item.  Null and empty texts have no
    words; an item without words has no window; items that are null in ``item_column`` keep a null in ``items``; equal rows get
    equal results.  Columns of the names above are replaced.  The benchmark is carried to the tasks in blocks of
    ``block_words`` words at most (one longer item makes a block), each searched over all rows.
    """
    item_type = benchmark.schema[item_column].dataType
    kind = item_type.simpleString()
    fields = [(n, t.format(item=kind)) for n, t in FIELDS]
    out, first = docs, True
    for block in blocks(benchmark, item_column, item_text, window, block_words):
        out = _pass(out, block, text_column, fields, to_arrow_type(item_type), first)
        first = False
    return _pass(out, Block([], [], window), text_column, fields, to_arrow_type(item_type), True) if first else out


def blocks(benchmark: DataFrame, item_column: str, item_text: str, window: int, block_words: int):
    """The benchmark, streamed to the driver a partition at a time and cut into blocks."""
    items, texts, size = [], [], 0
    rows = benchmark.select(F.col(item_column).alias("i"), F.col(item_text).cast("string").alias("t")).toLocalIterator()
    for row in rows:
        n = len((row["t"] or "").split())
        if items and size + n > block_words:
            yield Block(items, texts, window)
            items, texts, size = [], [], 0
        items.append(row["i"])
        texts.append(row["t"])
        size += n
    if items:
        yield Block(items, texts, window)


def merged(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of runs: sorted, disjoint starts and ends; runs that touch become one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate((starts + lengths)[order])
    fresh = np.append(True, starts[1:] > ends[:-1]) if len(starts) else np.zeros(0, bool)
    last = np.append(fresh[1:], True) if len(starts) else fresh
    return starts[fresh], ends[last]


def _pass(docs: DataFrame, block: Block, text_column: str, fields: list, item_type: pa.DataType, first: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)
    past = {n: f"earlier {n}" for n in ("spans", "items")}
    if not first:
        docs = docs.withColumnsRenamed(past)

    def run(batch: pa.RecordBatch) -> list:
        known = shared.value
        names = batch.schema.names
        counts, spans, items, longest = [], [], [], []
        earlier = None if first else tuple(batch.column(names.index(n)).to_pylist() for n in past.values())
        for words in scan.words(batch.column(names.index(text_column)), scan.ALNUM, lower=True):
            size = words.counts()
            begin = np.concatenate([[0], np.cumsum(size)])
            which, start, length = search(known, words)
            doc = words.doc[start]
            low, high = merged(start + doc, length)  # one place between documents keeps their runs apart
            begin = begin + np.arange(words.rows + 1)
            hits = np.searchsorted(low, begin)
            # the windows of each document, then the items that have them
            pairs = np.unique(np.stack([doc, which], axis=1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
            edge = np.searchsorted(pairs[:, 0], np.arange(words.rows + 1))
            for r in range(words.rows):
                a, b = low[hits[r]:hits[r + 1]] - begin[r], high[hits[r]:hits[r + 1]] - begin[r]
                own = {int(i) for w in pairs[edge[r]:edge[r + 1], 1] for i in known.item_of[known.item_at[w]:known.item_at[w + 1]]}
                own = {known.items[i] for i in own}
                if earlier is not None:
                    runs = earlier[0][words.first + r]
                    a, b = merged(np.concatenate([a, [p["start"] for p in runs]]).astype(np.int64), np.concatenate([b - a, [p["length"] for p in runs]]).astype(np.int64))
                    own |= set(earlier[1][words.first + r])
                counts.append(int(size[r]))
                spans.append([{"start": int(x), "length": int(y - x)} for x, y in zip(a, b)])
                items.append(sorted(own, key=lambda v: (v is None, v)))
                longest.append(int((b - a).max()) if len(a) else 0)
        return [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                pa.array(items, pa.list_(item_type)), pa.array(longest, pa.int64())]

    return scan.append_columns(docs, run, fields).drop(*past.values())


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with the columns of ``docs``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_column).cast("string").alias("text"))
    return contaminated(rows, benchmark, "text", **options).where(F.size("spans") == 0).select("row.*")
