"""Word runs that occur more than once in a corpus, found by doubling the window length level by level.

Level 1 looks at half windows.  Of the half windows inside a window the one with the smallest hash stands for it, so
equal windows are stood for by equal half windows, and a small share of all places is looked at.  A window whose half
window occurs once in the corpus cannot repeat; only the others are extended to the full length and counted again.
Windows that repeat are extended to twice their length, as long as any survive, if the longest repeats are asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from lumbre.llm import scan, tally
from lumbre.session import cut_lineage


def _least(hashes: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest of ``width`` consecutive values from each place, the first of equal ones."""
    at = np.arange(len(hashes))
    step, low = 1, hashes
    while step * 2 <= width:
        take = low[step:] < low[:-step]
        at = np.where(take, at[step:], at[:-step])
        low = np.where(take, low[step:], low[:-step])
        step *= 2
    rest = width - step
    if rest:
        take = low[rest:] < low[:-rest]
        at = np.where(take, at[rest:], at[:-rest])
    return at


def _anchors(words: scan.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the windows, the half window that stands for each, and the hashes of half windows."""
    half = (window + 1) // 2
    inner, _ = scan.windows(words.hashes, words.doc, half)
    n = len(words.hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), inner
    starts = np.flatnonzero(words.doc[:n] == words.doc[window - 1:])
    return starts, _least(inner, window - half + 1)[:n][starts], inner


def _level_one(table: pa.Table, window: int) -> np.ndarray:
    found = []
    for words in scan.words(table.column("text"), scan.NOT_SPACE):
        _, anchor, inner = _anchors(words, window)
        found.append(inner[np.unique(anchor)])
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _level_two(table: pa.Table, window: int, repeated: np.ndarray) -> np.ndarray:
    found = []
    for words in scan.words(table.column("text"), scan.NOT_SPACE):
        starts, anchor, inner = _anchors(words, window)
        starts = starts[_member(repeated, inner[anchor])]
        found.append(scan.run_hashes(words.hashes, starts, starts + window))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _member(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def _repeats(docs: DataFrame, window: int, n: int) -> DataFrame:
    """Notes of both levels for each bucket: totals of the full windows, and of the half windows as passenger."""
    ranges = max(64, n // 4)

    def one(table):
        return tally.unique(_level_one(table, window))

    def two(table, totals):
        keys, _ = tally.unique(_level_one(table, window))
        return tally.unique(_level_two(table, window, keys[totals > 1]))

    first = tally.add_up(tally.send(docs, one, ranges))
    return tally.add_up(tally.send_on(docs, first, two, ranges))


def _repeated(table: pa.Table, window: int, totals: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """Sorted hashes of the windows of a bucket that occur more than once in the corpus."""
    halves, _ = tally.unique(_level_one(table, window))
    keys, _ = tally.unique(_level_two(table, window, halves[(before if before is not None else np.zeros(len(halves))) > 1]))
    return keys[totals > 1]


def mark_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, rows_per_bucket: int = tally.ROWS_PER_BUCKET) -> DataFrame:
    """``docs`` without the words of windows that also start anywhere else.

    Words are runs of characters other than space and tab to carriage return.  A window is ``window`` consecutive words of
    one document; every window whose word sequence starts at another place of any document, the same one included, is
    covered, as judged on the input.  Returns the columns of ``docs`` with ``n_words``, ``n_removed`` and ``kept`` (the other
    words, joined by one space) in place of columns of these names.  A null text has no words; a null key is a key like any
    other; equal rows are copies of each other; texts of fewer words than a window are kept whole.
    """
    names = ("n_words", "n_removed", "kept")
    passed = [c for c in docs.columns if c not in names]
    # all columns travel as one struct, so that no name can clash
    d, n = tally.bucketed(docs.select(F.struct(*[F.col(f"`{c}`") for c in passed]).alias("row"), F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")),
                          "key", "text", rows_per_bucket)
    d = d.select("bucket", "row", "text")
    notes = _repeats(d, window, n)
    schema = StructType([d.schema["row"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])
    arrow = to_arrow_schema(schema)

    def finish(table: pa.Table, totals: np.ndarray, before: np.ndarray | None) -> pa.Table:
        if not table.num_rows:
            return arrow.empty_table()
        repeated = _repeated(table, window, totals, before)
        n_words, n_removed, kept = [], [], []
        for words in scan.words(table.column("text"), scan.NOT_SPACE):
            hashes, whole = scan.windows(words.hashes, words.doc, window)
            hit = np.flatnonzero(whole & _member(repeated, hashes))
            cover = np.zeros(len(words.hashes) + 1, np.int64)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + window, -1)
            keep = np.cumsum(cover[:-1]) == 0
            size = words.counts()
            edges = np.concatenate([[0], np.cumsum(size)])
            n_words += size.tolist()
            gone = np.concatenate([[0], np.cumsum(~keep)])
            n_removed += (gone[edges[1:]] - gone[edges[:-1]]).tolist()
            kept += _joined(words, keep, edges)
        return pa.Table.from_arrays([table.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], schema=arrow)

    return tally.deliver(d, notes, finish, schema).select("row.*", *names)


def _joined(words: scan.Words, keep: np.ndarray, edges: np.ndarray) -> list[str]:
    """The kept words of each document, joined by one space."""
    starts, ends = words.starts[keep], words.ends[keep]
    size = ends - starts + 1
    total = np.concatenate([[0], np.cumsum(size)])
    out = np.full(total[-1], 32, np.uint8)
    source = np.repeat(starts - total[:-1], size) + np.arange(total[-1])
    letter = np.ones(total[-1], bool)
    letter[total[1:] - 1] = False
    out[letter] = words.data[source[letter]]
    text = out.tobytes()
    before = np.concatenate([[0], np.cumsum(keep)])[edges]
    at = total[before]
    return [text[a:max(a, b - 1)].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]


def longest_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, rows_per_bucket: int = tally.ROWS_PER_BUCKET) -> DataFrame:
    """For each document the longest doubled window length (``window``, 2 x, 4 x ...) of which one repeats: ``key``, ``longest`` (0: none).

    Each level extends the windows that repeat at the length before: a window of twice the length is a candidate if both its
    halves repeat.  Levels go on until no candidates survive.
    """
    d, n = tally.bucketed(docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")), "key", "text", rows_per_bucket)
    d = d.select("bucket", "key", "text")
    state = StructType([StructField("bucket", LongType()), StructField("keys", BinaryType()), StructField("longest", BinaryType()), StructField("left", LongType())])
    arrow = to_arrow_schema(state)
    rows = StructType([StructField("key", docs.schema[key].dataType), StructField("longest", LongType())])

    def grown(table, repeated, length):
        """Hashes of the windows of twice the length both halves of which repeat, and the rows that have repeats of this length."""
        found, has = [], []
        for words in scan.words(table.column("text"), scan.NOT_SPACE):
            hashes, whole = scan.windows(words.hashes, words.doc, length)
            hit = whole & _member(repeated, hashes)
            has.append(np.bincount(words.doc[:len(hit)][hit], minlength=words.rows) > 0)
            longer = np.flatnonzero(hit[:-length] & hit[length:] & (words.doc[:len(hit) - length] == words.doc[length:len(hit)])) if len(hit) > length else np.zeros(0, np.int64)
            found.append(scan.run_hashes(words.hashes, longer, longer + 2 * length))
        return np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate(has) if has else np.zeros(0, bool)

    def begin(table, totals, before):
        if not table.num_rows:
            return arrow.empty_table()
        repeated = _repeated(table, window, totals, before)
        _, has = grown(table, repeated, window)
        return pa.Table.from_pylist([{"bucket": tally.bucket_of(table), "keys": repeated.tobytes(), "longest": np.where(has, window, 0).astype("<u8").tobytes(), "left": len(repeated)}], arrow)

    # rows of a bucket stand in a fixed order, so that a level's notes fit them
    d = cut_lineage(d, "repeats")
    order = lambda t: t.sort_by([("key", "ascending"), ("text", "ascending")])
    current = cut_lineage(tally.deliver(d, _repeats(d, window, n), lambda t, a, b: begin(order(t), a, b), state), "level")
    length = window
    while not current.where("left > 0").isEmpty():
        push, advance = _doubling(order, grown, length, max(64, n // 4), arrow)
        totals = tally.add_up(d.groupBy("bucket").cogroup(current.groupBy("bucket")).applyInArrow(push, tally.NOTES))
        notes = totals.select("bucket", F.lit("total").alias("kind"), "range", "keys", "counts").unionByName(
            current.select("bucket", F.lit("state").alias("kind"), F.lit(-1).cast("long").alias("range"), "keys", F.col("longest").alias("counts")))
        current = cut_lineage(d.groupBy("bucket").cogroup(notes.groupBy("bucket")).applyInArrow(advance, state), "level")
        length *= 2

    def told(left, right):
        left = order(left)
        return pa.table([left.column("key"), pa.array(np.frombuffer(right.column("longest")[0].as_py(), "<u8").astype(np.int64))], schema=to_arrow_schema(rows))

    return d.groupBy("bucket").cogroup(current.groupBy("bucket")).applyInArrow(told, rows).withColumnRenamed("key", key)


def _doubling(order, grown, length: int, ranges: int, arrow: pa.Schema):
    """The two steps of a level: send the windows of twice the length, keep those that repeat."""
    def push(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, _ = grown(order(left), np.frombuffer(right.column("keys")[0].as_py(), np.uint64), length)
        return tally.noted(tally.bucket_of(left), *tally.unique(keys), ranges)

    def advance(left: pa.Table, right: pa.Table) -> pa.Table:
        left, kinds = order(left), right.column("kind").to_pylist()
        at = kinds.index("state")
        keys, _ = tally.unique(grown(left, np.frombuffer(right.column("keys")[at].as_py(), np.uint64), length)[0])
        parts = sorted((r, c) for k, r, c in zip(kinds, right.column("range").to_pylist(), right.column("counts").to_pylist()) if k == "total")
        totals = np.concatenate([tally.read_numbers(c) for _, c in parts]) if parts else np.zeros(0, np.uint64)
        keys = keys[totals > 1]
        _, has = grown(left, keys, 2 * length)
        longest = np.where(has, 2 * length, np.frombuffer(right.column("counts")[at].as_py(), "<u8"))
        return pa.Table.from_pylist([{"bucket": tally.bucket_of(left), "keys": keys.tobytes(), "longest": longest.astype("<u8").tobytes(), "left": len(keys)}], arrow)

    return push, advance
