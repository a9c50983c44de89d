"""Phrase collocations by prefix-free parsing.

A text is a sequence of words with borders between its pieces.  Wherever the hash of two neighbouring words says so, a chunk begins;
a chunk goes on over the first words of the next one, as many as a phrase has but one, so every phrase that starts in a chunk lies
in it.  Equal passages give equal chunks: the dictionary of different chunks with their parse frequencies stands for the corpus.
Phrases are counted inside the different chunks, weighted by frequency, each by the chunk in which it starts, so overlaps count once.

Counts add up over 96-bit hashes, length by length: a bucket of the dictionary sends each of its different words once to the word's range
and gets the total back, then so for longer phrases, each only where both its parts of one word less reached the threshold.  The
bucket of the smallest number that holds a phrase reaching the threshold then says its words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumbre.llm import scan
from lumbre.llm.tally import numbers, read_numbers
from lumbre.session import cut_lineage

#: one chunk begins every ``EVERY`` words on average and none goes on beyond ``LONGEST``; bytes of text for a bucket
EVERY, LONGEST, BUCKET_BYTES = 16, 4096, 1 << 22
#: in a chunk's text: between words, between pieces, before the words that belong to the next chunk (none of them occurs in a word)
SPACE, PIECE, NEXT = 32, 10, 13
WORD, BORDER = np.ones(256, bool), np.zeros(256, bool)
BORDER[[*b".,;:!?", 10, 11, 12, 13]] = True
WORD[BORDER] = WORD[[9, 32]] = False
_NOTE = pa.schema([("bucket", pa.int64()), ("range", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("speaks", pa.binary())])
NOTES = "bucket long, range long, keys binary, counts binary, speaks binary"
CHUNKS = "bucket long, lang string, chunks binary"
_KEY = np.dtype([("a", "<u8"), ("b", "<u4")])


def word_chunks(words: scan.Words, size: int):
    """Row, text and a hash of the words of each chunk.  A separator goes before every word of the text."""
    n = len(words.starts)
    ends_before = np.concatenate([[0], words.ends[:-1]])
    borders = np.concatenate([[0], np.cumsum(BORDER[words.data])])
    document = np.append(True, words.doc[1:] != words.doc[:-1])
    piece = document | (borders[words.starts] != borders[ends_before])
    cut = document.copy()
    cut[1:] |= scan.mix(words.hashes[:-1] ^ scan.mix(words.hashes[1:])) % np.uint64(EVERY) == 0
    starts = np.flatnonzero(cut)
    long = np.diff(np.append(starts, n))
    if long.max() > LONGEST:
        starts = np.concatenate([np.arange(s, s + k, LONGEST) for s, k in zip(starts, long)])
    stops = np.append(starts[1:], n)
    number = np.cumsum(piece)
    over = np.minimum(stops + size - 1, n)  # words of the next chunk, as far as the piece of the last own word goes
    while True:
        beyond = (over > stops) & (number[np.maximum(over - 1, 0)] != number[stops - 1])
        if not beyond.any():
            break
        over -= beyond
    held = over - starts
    take = np.arange(int(held.sum())) + np.repeat(starts - (np.cumsum(held) - held), held)
    lead = np.full(len(take), SPACE, np.uint8)
    lead[piece[take]] = PIECE
    at = np.cumsum(held) - held
    lead[at] = SPACE
    tail = over > stops
    lead[(at + stops - starts)[tail]] = NEXT
    lengths = (words.ends - words.starts)[take]
    to = np.cumsum(lengths + 1) - (lengths + 1)
    text = np.empty(int((lengths + 1).sum()), np.uint8)
    inside = np.arange(len(text)) - np.repeat(to, lengths + 1) - 1
    head = inside < 0
    text[head] = lead
    text[~head] = words.data[(np.repeat(words.starts[take], lengths + 1) + inside)[~head]]
    edges = np.append(to[at], len(text))
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(text.tobytes())])
    return words.doc[starts], out, scan.run_hashes(words.hashes, starts, over)


def chunk_rows(batches, size: int, n: int):
    """(bucket, lang, chunks): the different chunks of a batch with their counts, those of one bucket and language packed together."""
    kinds = pa.schema([("bucket", pa.int64()), ("lang", pa.string()), ("chunks", pa.binary())])
    for batch in batches:
        parts, langs = [], batch.column("lang")
        for words in scan.words(batch.column("text"), WORD, lower=True):
            if len(words.starts):
                row, chunks, hashes = word_chunks(words, size)
                parts.append(pa.table({"bucket": (hashes % np.uint64(n)).astype(np.int64), "lang": langs.slice(words.first, words.rows).take(pa.array(row)), "chunk": chunks}))
        if parts:
            table = pa.concat_tables(parts).group_by(["bucket", "lang", "chunk"]).aggregate([([], "count_all")]).sort_by([("bucket", "ascending"), ("lang", "ascending")])
            bucket, lang = table.column("bucket").to_numpy(), table.column("lang").combine_chunks().dictionary_encode()
            lang = lang.combine_chunks() if isinstance(lang, pa.ChunkedArray) else lang
            code = lang.indices.to_numpy()
            first = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (code[1:] != code[:-1])))
            data, offsets = binary(table.column("chunk"))
            counts = table.column("count_all").to_numpy()
            blobs = [packed(data[offsets[i]:offsets[j]], np.diff(offsets[i:j + 1]), counts[i:j]) for i, j in zip(first, np.append(first[1:], len(bucket)))]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), lang.dictionary.take(pa.array(code[first])).cast(pa.string()), pa.array(blobs, pa.binary())], schema=kinds)
        del parts
    scan.release()


def packed(text: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> bytes:
    """Chunks end to end, with the length and count of each, compressed."""
    parts = [numbers(lengths), numbers(counts), text.tobytes()]
    whole = b"".join(len(x).to_bytes(8, "little") for x in parts[:2]) + b"".join(parts)
    return len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    whole = pa.decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    a, b = int.from_bytes(whole[:8], "little"), int.from_bytes(whole[8:16], "little")
    return whole[16 + a + b:], read_numbers(whole[16:16 + a]), read_numbers(whole[16 + a:16 + a + b])


def binary(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a binary column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


class Dictionary:
    """The different chunks of a bucket: words with two hashes each, what may start a phrase, and how often.

    ``weight`` of a word is the parse frequency of its chunk if the chunk owns it, else 0.
    """

    def __init__(self, table: pa.Table):
        texts, lengths, counts = zip(*(unpacked(b) for b in table.column("chunks").to_pylist()))
        lengths, counts, owner = np.concatenate(lengths), np.concatenate(counts).astype(np.int64), np.repeat(np.arange(len(lengths)), [len(x) for x in lengths])
        edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(b"".join(texts))])
        table = pa.table({"lang": table.column("lang").take(pa.array(owner)), "chunk": chunks, "freq": counts})
        table = table.group_by(["lang", "chunk"]).aggregate([("freq", "sum")]).sort_by([("lang", "ascending"), ("chunk", "ascending")])
        self.langs = table.column("lang").combine_chunks().dictionary_encode()
        self.langs = self.langs.combine_chunks() if isinstance(self.langs, pa.ChunkedArray) else self.langs
        freq = table.column("freq_sum").to_numpy()
        self.data, offsets = binary(table.column("chunk"))
        separator = (self.data == SPACE) | (self.data == PIECE) | (self.data == NEXT)
        first = offsets[:-1]  # a chunk begins with a separator
        self.starts = np.flatnonzero(separator) + 1
        self.ends = np.append(self.starts[1:] - 1, len(self.data))
        chunk = np.searchsorted(first, self.starts, "right") - 1
        lead = self.data[self.starts - 1]
        new = np.append(True, chunk[1:] != chunk[:-1])
        self.joined = ~(new | (lead == PIECE))  # goes on from the word before it
        marks = np.cumsum(lead == NEXT)
        own = marks - marks[np.flatnonzero(new)][np.cumsum(new) - 1] == 0
        self.weight = np.where(own, freq[chunk], 0).astype(np.uint64)
        self.lang = self.langs.indices.to_numpy()[chunk]
        # different words are hashed once; a word stands here behind its separator, all separators alike
        text, edges = np.where(separator, np.uint8(SPACE), self.data), np.append(self.starts - 1, len(self.data))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(text)]).dictionary_encode()
        data, offsets = binary(words.dictionary)
        place = words.indices.to_numpy()
        seeds = [np.frombuffer(name.encode(), np.uint8) for name in self.langs.dictionary.to_pylist()]
        self.hashes = []
        for values in (scan._VALUES, _OTHER):
            seed = np.array([int(scan.run_hashes(values[s], np.array([0]), np.array([len(s)]))[0]) for s in seeds] or [0], np.uint64)
            self.hashes.append(scan.mix(scan.run_hashes(values[data], offsets[:-1], offsets[1:])[place] + scan.mix(~seed)[self.lang]))

    def phrases(self, k: int, before: np.ndarray | None = None, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Places where phrases of ``k`` words stand in a chunk, and their keys; given the totals of phrases of one word less by
        place, only those whose two such parts have ``least`` or more.  Those that a chunk does not own have weight 0."""
        fits = np.ones(len(self.starts), bool)
        for i in range(1, k):
            fits &= np.append(self.joined[i:], np.zeros(min(i, len(fits)), bool))
        if before is not None:
            common = before >= least
            fits &= common & np.append(common[1:], False)
        at = np.flatnonzero(fits)
        key = np.empty(len(at), _KEY)
        for name, h in zip(("a", "b"), self.hashes):
            value = h[at]
            for i in range(1, k):
                value = scan.mix(value + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(3) + h[at + i]
            key[name] = scan.mix(value) & np.uint64((1 << 8 * _KEY[name].itemsize) - 1)
        return at, key

    def text(self, at: int, k: int) -> str:
        return " ".join(self.data[self.starts[i]:self.ends[i]].tobytes().decode("utf-8", "replace") for i in range(at, at + k))


_OTHER = np.random.default_rng(20250311).integers(1, 1 << 63, 256, dtype=np.uint64)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each different one begins in it."""
    order = np.argsort(keys["a"])
    a, b = keys["a"][order], keys["b"][order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():  # two keys that share their first half
        order = np.lexsort((keys["b"], keys["a"]))
        a, b = keys["a"][order], keys["b"][order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return order, np.flatnonzero(np.append(True, ~same)) if len(keys) else np.zeros(0, np.int64)


def key_bytes(keys: np.ndarray) -> bytes:
    """Sorted keys with like bytes side by side, of which the highest hardly change and so compress away."""
    return np.ascontiguousarray(keys["a"]).view(np.uint8).reshape(-1, 8).T[::-1].tobytes() + np.ascontiguousarray(keys["b"]).tobytes()


def read_keys(data: bytes) -> np.ndarray:
    n = len(data) // _KEY.itemsize
    keys = np.empty(n, _KEY)
    keys["a"] = np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n).reshape(8, n)[::-1].T).view("<u8").ravel()
    keys["b"] = np.frombuffer(data, "<u4", n, 8 * n)
    return keys


def notes(bucket: int, keys: np.ndarray, weights: np.ndarray, ranges: int, passenger: bytes | None = None) -> pa.Table:
    """Each different key once with its weight, cut at the borders of ranges; a passenger travels under a range of its own."""
    order, first = grouped(keys)
    own, sums = keys[order][first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]
    place = ((own["a"] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    used, at = np.unique(place, return_index=True)
    cuts = np.append(at, len(own))
    rows = [(bucket, int(r), key_bytes(own[a:b]), numbers(sums[a:b]), b"") for r, a, b in zip(used, cuts[:-1], cuts[1:])]
    if passenger is not None:
        rows.append((bucket, -1 - bucket, passenger, b"", b""))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, _NOTE.types)], schema=_NOTE)


def total(sent: DataFrame) -> DataFrame:
    """Totals of each range go back to the buckets, in the order of the keys sent; the smallest bucket that holds a key is told to speak."""
    def run(table: pa.Table) -> pa.Table:
        if table.column("range")[0].as_py() < 0:
            return table
        buckets = table.column("bucket").to_numpy()
        by = np.argsort(buckets, kind="stable")  # rows in the order of buckets, so that the first of equal keys is the smallest
        table = table.take(pa.array(by))
        blobs = [read_keys(b) for b in table.column("keys").to_pylist()]
        counts = np.concatenate([read_numbers(b) for b in table.column("counts").to_pylist()])
        keys, sizes = np.concatenate(blobs), [len(b) for b in blobs]
        order, first = grouped(keys)
        sums = np.add.reduceat(counts[order], first)
        totals, speaks = np.empty(len(keys), np.uint64), np.zeros(len(keys), bool)
        totals[order] = np.repeat(sums, np.diff(np.append(first, len(keys))))
        if len(keys):
            speaks[np.minimum.reduceat(order, first)] = True
        ends = np.cumsum(sizes)
        return pa.Table.from_arrays([table.column("bucket"), table.column("range"), pa.array([b""] * len(sizes), pa.binary()), pa.array([numbers(totals[e - s:e]) for s, e in zip(sizes, ends)], pa.binary()),
                                     pa.array([np.packbits(speaks[e - s:e]).tobytes() for s, e in zip(sizes, ends)], pa.binary())], schema=_NOTE)
    return sent.groupBy("range").applyInArrow(run, NOTES)


def received(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length so far: totals and who speaks, in the order of the keys sent."""
    rows = sorted(zip(table.column("range").to_pylist(), table.column("counts").to_pylist(), table.column("speaks").to_pylist(), table.column("keys").to_pylist()))
    got = [(read_numbers(c), s) for r, c, s, _ in rows if r >= 0]
    totals = np.concatenate([c for c, _ in got]) if got else np.zeros(0, np.uint64)
    speaks = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=len(c)) for c, s in got]).astype(bool) if got else np.zeros(0, bool)
    blob = next((k for r, _, _, k in rows if r < 0), b"")
    levels = []
    while blob:
        n, m = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
        before = read_numbers(blob[16:16 + n])
        levels.append((before, np.unpackbits(np.frombuffer(blob, np.uint8, m, 16 + n), count=len(before)).astype(bool)))
        blob = blob[16 + n + m:]
    return [*levels, (totals, speaks)]


def passenger(levels: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    parts = [(numbers(t), np.packbits(s).tobytes()) for t, s in levels]
    return b"".join(len(a).to_bytes(8, "little") + len(b).to_bytes(8, "little") + a + b for a, b in parts)


def frequent(docs: DataFrame, least: int, size: int = 3, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(lang, k, phrase, f): phrases of up to ``size`` words that occur ``least`` times or oftener in a language.

    Rows with a null phrase and k = 0 hold numbers of words of a language, to be added up.
    """
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(volume / bucket_bytes))
    chunks = docs.mapInArrow(lambda batches: chunk_rows(batches, size, n), CHUNKS)
    by_bucket = lambda df: df.groupBy("bucket")

    def walked(words: Dictionary, levels: list):
        """For each length whose totals are known: length, places in the order of keys, first of each key, totals, who speaks; at last the totals by place."""
        before = None
        for k, (totals, speaks) in enumerate(levels, 1):
            at, keys = words.phrases(k, before, least)
            order, first = grouped(keys)
            before = np.zeros(len(words.starts), np.uint64)
            before[at[order]] = np.repeat(totals, np.diff(np.append(first, len(order))))
            yield k, at[order], first, totals, speaks, before

    def send(table: pa.Table, levels: list) -> pa.Table:
        words, before = Dictionary(table), None
        for *_, before in walked(words, levels):
            pass
        at, keys = words.phrases(len(levels) + 1, before, least)
        out = notes(table.column("bucket")[0].as_py(), keys, words.weight[at], n, passenger(levels) if levels else None)
        del words, at, keys, before
        scan.release()
        return out

    def send_on(left: pa.Table, right: pa.Table) -> pa.Table:
        return send(left, received(right)) if left.num_rows else _NOTE.empty_table()

    def say(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows:
            words = Dictionary(left)
            names = words.langs.dictionary.to_pylist()
            counts = np.zeros(len(names), np.int64)
            np.add.at(counts, words.lang, words.weight.astype(np.int64))
            rows += [(name, 0, None, int(c)) for name, c in zip(names, counts)]
            for k, at, first, totals, speaks, _ in walked(words, received(right)):
                rows += [(names[words.lang[at[first[i]]]], k, words.text(at[first[i]], k), int(totals[i])) for i in np.flatnonzero(speaks & (totals >= least))]
        return pa.table([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64())],
                        names=["lang", "k", "phrase", "f"])

    back = total(by_bucket(chunks).applyInArrow(lambda table: send(table, []), NOTES))
    for _ in range(size - 1):
        back = total(by_bucket(chunks).cogroup(by_bucket(back)).applyInArrow(send_on, NOTES))
    return by_bucket(chunks).cogroup(by_bucket(back)).applyInArrow(say, "lang string, k int, phrase string, f long")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, covered: int = 50, top: int = 2000, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The ``top`` phrases of two or three words of each language by how far their parts keep together.

    A phrase of ``a`` >= ``least`` occurrences is cut after each of its words: the score of a cut is a * a * 1,000,000 over the product of the parts'
    occurrences (floored), that of the phrase its lowest cut, ties to the earlier one.  A phrase whose words lie in a longer candidate
    that occurs ``covered`` per cent as often, or oftener, is left out.  Returns lang, rank, phrase, a, l, r (occurrences of the
    cut's parts), n (words of the language) and score.  A null text is empty, a null language ``und``; an empty table gives no rows.
    """
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    grams = cut_lineage(frequent(docs, least, bucket_bytes=bucket_bytes), "phrases")
    counts = grams.where("k > 0").select("lang", "phrase", "f")
    sizes = grams.where("k = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    phrases = grams.where("k > 1").select("lang", "phrase", F.col("f").alias("a"), "k", F.split("phrase", " ").alias("w"))
    part = lambda a, b: F.concat_ws(" ", F.slice("w", a, b))
    cuts = phrases.select("lang", "phrase", "a", F.col("k").alias("size"), "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("(cast(a as decimal(19, 0)) * cast(a as decimal(19, 0)) * cast(1000000 as decimal(7, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = phrases.where("k = 3").select("lang", "a", F.explode(F.array(part(F.lit(1), F.lit(2)), part(F.lit(2), F.lit(2)))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    kept = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    return kept.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
