"""Packing of documents into token sequences by the sum-of-squares rule.

Every task packs the rows it reads, online and without a shuffle.  A document's token ids fill whole windows first;
what remains goes into the open window whose new fill level keeps the sum of squared counts of partially filled windows
lowest.  The state is one counter per level.  When more than ``max_open`` windows are open, and at the end of a task,
the emptiest open windows are cut up to fill the fullest, so that memory is bounded and one window at most is left; that
one is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.llm import scan

# Characters with the Unicode property White_Space (fixed values).
WHITE_SPACE = {9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
OTHER, LETTER, NUMBER, SPACE, UNASSIGNED, UNKNOWN = 0, 1, 2, 3, 4, 255
MAX_CACHED = 300_000

PIECES = "sequence_id long, offset long, start long, length long, doc_tokens long, ids binary"


def _kind(code: int) -> int:
    if code in WHITE_SPACE:
        return SPACE
    category = unicodedata.category(chr(code))
    return UNASSIGNED if category == "Cn" else {"L": LETTER, "N": NUMBER}.get(category[0], OTHER)


def merges_by_rank(path: str) -> dict[bytes, int] | None:
    """Token bytes and ids of a byte-level BPE file, if its ids rise in the order of its merges; else none."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(plain)))}
    vocabulary = model.get("vocab", {})
    merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model.get("merges", [])]
    if model.get("type") != "BPE" or merged != sorted(merged) or not all(c in vocabulary for c in byte) or any(vocabulary[c] >= merged[0] for c in byte):
        return None
    known = set(merged) | {vocabulary[c] for c in byte}
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if i in known}


class Encoder:
    """Ids of whole texts by a byte-level BPE tokenizer.

    Such a tokenizer encodes each pre-token (a word with the space before it, a number, punctuation, white space) by
    itself, so texts are cut into pre-tokens with numpy and each different one is encoded once: by the merges of the file
    in order of rank, which tiktoken applies faster, or by the tokenizer where its ids do not follow the merges.  Texts with
    characters that this Python's Unicode does not know are left to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        ranks = merges_by_rank(path)
        self.split = ranks[b"\0"] if ranks else None
        if ranks:
            import tiktoken

            self.merges = tiktoken.Encoding("pre-tokens", pat_str=r"\x00|[^\x00]+", mergeable_ranks=ranks, special_tokens={})
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.clear()

    def clear(self) -> None:
        self.known, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def cut(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where pre-tokens start, texts standing behind each other at ``bounds``."""
        kinds = self.kinds[codes]
        if (new := codes[kinds == UNKNOWN]).size:
            for code in np.unique(new):
                self.kinds[code] = _kind(int(code))
            kinds = self.kinds[codes]
        n = len(codes)
        fresh = np.zeros(n + 1, bool)
        fresh[bounds] = True
        start = fresh[:-1].copy()
        start[1:] |= kinds[1:] != kinds[:-1]
        after = np.flatnonzero((kinds[1:] != SPACE) & (kinds[:-1] == SPACE) & ~fresh[1:-1]) + 1
        start[after - 1] = True
        start[after[codes[after - 1] == 32]] = False
        quote = np.flatnonzero((codes[:-1] == 39) & start[:-1] & (kinds[1:] == LETTER) & ~fresh[1:-1])
        if quote.size:
            one, two = codes[quote + 1], np.where((quote + 2 < n) & ~fresh[np.minimum(quote + 2, n)], codes[np.minimum(quote + 2, n - 1)], 0)
            length = np.where(np.isin(one, [115, 116, 109, 100]), 2, 0)  # 's 't 'm 'd
            length = np.where(((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108), 3, length)  # 're 've 'll
            quote, length = quote[length > 0], length[length > 0]
            start[quote + 1] = False
            more = quote + length < n
            start[quote[more] + length[more]] = True
        return np.flatnonzero(start)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Ids of each text (UTF-8 ``data`` cut at ``bounds``)."""
        text = data.tobytes().decode("utf-8", "replace")
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(codes):
            return [np.zeros(0, np.uint32)] * (len(bounds) - 1)
        places = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
        starts = self.cut(codes, places)
        ends = np.append(starts[1:], len(codes))
        hashes = scan.run_hashes(scan.mix(codes.astype(np.uint64) + np.uint64(1)), starts, ends)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, unique)
        found = at < len(self.known)
        found[found] = self.known[at[found]] == unique[found]
        if not found.all():
            self.learn(unique[~found], [text[starts[i]:ends[i]] for i in first[~found]])
            at = np.searchsorted(self.known, unique)
        size = self.size[at][inverse]
        total = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(self.at[at][inverse] - total[:-1], size)
        source += np.arange(total[-1])
        ids = self.ids[source]
        if len(self.known) > MAX_CACHED:
            self.keep(at)
        at = total[np.searchsorted(starts, places)]
        out = [ids[a:b] for a, b in zip(at[:-1], at[1:])]
        for row in np.unique(np.searchsorted(places, np.flatnonzero(self.kinds[codes] == UNASSIGNED), "right") - 1):
            out[row] = self.whole(text[places[row]:places[row + 1]])
        return out

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        if self.split is None or any("\0" in t for t in texts):
            got = [self.whole(t) for t in texts]
            flat, size = np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got))
        else:
            flat = np.array(self.merges.encode_ordinary("\0".join(texts)), np.uint32)
            stops = np.append(np.flatnonzero(flat == self.split), len(flat))
            size = np.diff(np.append(-1, stops)) - 1
            flat = np.delete(flat, stops[:-1])
        at = len(self.ids) + np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        self.ids = np.concatenate([self.ids, flat])
        place = np.searchsorted(self.known, hashes)
        self.known, self.at, self.size = (np.insert(old, place, new) for old, new in ((self.known, hashes), (self.at, at), (self.size, size)))

    def keep(self, at: np.ndarray) -> None:
        """Forget all pre-tokens but those of the last texts."""
        size = self.size[at]
        total = np.concatenate([[0], np.cumsum(size)])
        self.ids = self.ids[np.repeat(self.at[at] - total[:-1], size) + np.arange(total[-1])]
        self.known, self.at, self.size = self.known[at], total[:-1], size


class SumOfSquares:
    """Open windows by fill level; ``place`` chooses the level, ``finish`` empties the state.

    A piece is (row, start, ids); full and finished windows are handed to ``emit`` as lists of pieces.
    """

    def __init__(self, length: int, emit, max_open: int = 1024):
        self.length, self.emit, self.max_open = length, emit, max_open
        self.levels = np.zeros(length + 1, np.int64)
        self.open: list[list] = [[] for _ in range(length)]
        self.count = 0

    def place(self, piece: tuple) -> None:
        """Sum of squares after placing s: a window at level h moves to h + s, or a new one starts at s; full windows leave."""
        s = len(piece[2])
        if s == self.length:
            self.emit([piece])
            return
        n = self.levels
        at = np.flatnonzero(n[1:self.length - s + 1]) + 1
        change = np.where(at + s < self.length, 2 * (n[at + s] - n[at]) + 2, 1 - 2 * n[at])
        fresh = 2 * n[s] + 1
        best = int(at[np.argmin(change)]) if len(at) and change.min() <= fresh else 0
        window = self.open[best].pop() if best else []
        if best:
            n[best] -= 1
            self.count -= 1
        window.append(piece)
        self.put(window, best + s)
        if self.count > self.max_open:
            self.merge(self.max_open // 2)

    def put(self, window: list, level: int) -> None:
        if level == self.length:
            self.emit(window)
        elif level:
            self.open[level].append(window)
            self.levels[level] += 1
            self.count += 1

    def take(self, level: int) -> list:
        self.levels[level] -= 1
        self.count -= 1
        return self.open[level].pop()

    def merge(self, most: int) -> None:
        """Fill the fullest windows with pieces cut from the emptiest until ``most`` are open."""
        while self.count > max(most, 1):
            used = np.flatnonzero(self.levels)
            high = int(used[-1])
            window = self.take(high)
            low = int(np.flatnonzero(self.levels)[0])
            donor, moved = self.take(low), 0
            while donor and high + moved < self.length:
                row, start, ids = donor.pop()
                cut = min(len(ids), self.length - high - moved)
                window.append((row, start, ids[:cut]))
                if cut < len(ids):
                    donor.append((row, start + cut, ids[cut:]))
                moved += cut
            self.put(window, high + moved)
            self.put(donor, low - moved)

    def finish(self) -> None:
        self.merge(1)
        for level in np.flatnonzero(self.levels):
            pieces, left = self.take(int(level)), int(level)
            while left:
                room = 1 << (left.bit_length() - 1)
                left, window = left - room, []
                while room:
                    row, start, ids = pieces.pop()
                    cut = min(room, len(ids))
                    window.append((row, start, ids[:cut]))
                    if cut < len(ids):
                        pieces.append((row, start + cut, ids[cut:]))
                    room -= cut
                self.emit(window)


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", length: int = 2048,
         end_id: int = 1, max_open: int = 1024) -> DataFrame:
    """One row for each piece of a document: ``id_column``, ``start`` (its document's ids before it), ``length``,
    ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence, and ``ids`` (little-endian unsigned 32-bit).

    A null text is an empty one, and an empty text is the end id alone.  Rows are packed as they are read, so equal rows
    are packed as often as they occur; ids may be null.  No rows give no pieces.  Columns other than the two are not read.
    Sequences are ``length`` long but for the last of a task, whose lengths are powers of two.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encoder, rows, state = Encoder(tokenizer), [], {"next": 0}

        def emit(window: list) -> None:
            offset = 0
            for (key, tokens), start, ids in window:
                rows.append((key, (task << 36) + state["next"], offset, start, len(ids), tokens, ids.tobytes()))
                offset += len(ids)
            state["next"] += 1

        def drain() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 7
            rows.clear()
            kinds = [schema.field(i).type for i in range(7)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], schema=schema)

        packer, schema = SumOfSquares(length, emit, max_open), None
        for batch in batches:
            if schema is None:
                schema = pa.schema([("doc_id", batch.schema.field(0).type), *((n, pa.int64()) for n in ("sequence_id", "offset", "start", "length", "doc_tokens")),
                                    ("ids", pa.binary())])
            keys = batch.column(0).to_pylist()
            data, offsets = scan.text_column(batch.column(1))
            for lo, hi in scan.chunks(offsets):
                ids = encoder.encode(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                for row in range(lo, hi):
                    own = np.append(ids[row - lo], np.uint32(end_id)).astype("<u4")
                    name = (keys[row], len(own))
                    whole = len(own) - len(own) % length
                    for start in range(0, whole, length):
                        emit([(name, start, own[start:start + length])])
                    if whole < len(own):
                        packer.place((name, whole, own[whole:].copy()))
                if len(rows) >= 2000:
                    yield drain()
        if schema is not None:
            packer.finish()
            yield drain()

    out = source.mapInArrow(run, f"doc_id {kind}, {PIECES}")
    return out.withColumnRenamed("doc_id", id_column)
