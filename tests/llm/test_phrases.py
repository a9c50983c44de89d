"""Phrase counts and scores against plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from lumbre.llm import phrases, scan

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, covered=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        kept = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            score, _, l, r = min(((10**6 * a * a) // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            inside = [b for q, b in counts.items() if len(q) == 3 and len(p) == 2 and b >= least and p in (q[:2], q[1:])]
            if all(100 * b < covered * a for b in inside):
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def test_documents(spark, documents):
    rows = [(r.text, r.lang) for r in documents.select("text", "lang").collect()]
    got = phrases.collocations(documents.repartition(7), bucket_bytes=40_000)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_odd_rows(spark):
    pick = np.random.default_rng(3)
    long = " ".join(pick.choice(["red", "Blue", "green,", "ß", "日本"], 20_000))
    rows = [(None, "en"), ("", "en"), (" \t ", None), ("es es en es", "en"), ("en en es", "es"), ("a b c. " * 30, None), ("a b c. " * 30, "und"), (long, "en"), ("same " * 20_000, "en"), ("x\x0by\x0cz w\x01v w\x01v " * 12, ""),
            *[("one hot passage of words", "en")] * 40, *[("of the cat! of the cat? of the dog", "xx")] * 11]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], "text string, lang string, chunk string, freq string, bucket long")
    assert sorted(map(tuple, phrases.collocations(df, bucket_bytes=5000).collect())) == brute(rows)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_overlaps_are_counted_once():
    """Every phrase starts in one chunk that holds all of it, whatever the cuts."""
    pick = np.random.default_rng(4)
    text = "".join(pick.choice(["aa ", "b ", "ccc ", "d. ", "ee,"], 5000))
    table = pa.table({"lang": ["en"], "text": [text]})
    words = phrases.Dictionary(pa.Table.from_batches(list(phrases.chunk_rows(table.to_batches(), 3, 1))))
    want = Counter()
    for piece in re.split("[.,]", text):
        w = piece.split()
        for k in (1, 2, 3):
            want.update(" ".join(w[i:i + k]) for i in range(len(w) - k + 1))
    got = Counter()
    for k in (1, 2, 3):
        at, _ = words.phrases(k)
        for i in at:
            got[words.text(i, k)] += int(words.weight[i])
    assert got == want and len(words.starts) < 5000


def test_keys_that_share_a_half():
    keys = np.array([(5, 1), (5, 2), (5, 1), (7, 0), (5, 2), (5, 1)], phrases._KEY)
    order, first = phrases.grouped(keys)
    assert np.diff(np.append(first, 6)).tolist() == [3, 2, 1]
    assert [tuple(k) for k in keys[order][first]] == [(5, 1), (5, 2), (7, 0)]


def test_packed_keys_and_chunks():
    pick = np.random.default_rng(7)
    keys = np.empty(1000, phrases._KEY)
    keys["a"], keys["b"] = np.sort(pick.integers(0, 1 << 63, 1000)), pick.integers(0, 1 << 32, 1000)
    assert (phrases.read_keys(phrases.key_bytes(keys)) == keys).all() and len(phrases.read_keys(phrases.key_bytes(keys[:0]))) == 0
    text = np.frombuffer(b" one two three", np.uint8)
    got = phrases.unpacked(phrases.packed(text, np.array([4, 10]), np.array([1, 70_000])))
    assert got[0] == text.tobytes() and got[1].tolist() == [4, 10] and got[2].tolist() == [1, 70_000]


def test_numbers_of_any_size():
    for values in ([], [0, 255], [256], [1 << 20, 3], [1 << 40, 1]):
        got = phrases.read_numbers(phrases.numbers(np.array(values, np.uint64)))
        assert got.tolist() == values
    assert scan.CHUNK_BYTES
