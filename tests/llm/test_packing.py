import random
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lumbre.llm import packing
from lumbre.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(tokenizer_path())


def encoded(encoder, texts):
    parts = [t.encode() for t in texts]
    return encoder.encode(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64))


def test_ids_are_the_tokenizers(encoder):
    pick, bits = random.Random(3), ["a", "B", "é", "'", "'s", "'re", "'ll", "s", "t", " ", "  ", "\n", "\t", "1", "٣", "!", "?", "\u00a0", "\u3000", "\0", "<|endoftext|>", "𝒳", "ß", "\x1c", "the", "\u1c89", "日本"]
    for _ in range(400):
        texts = ["".join(pick.choice(bits) for _ in range(pick.randint(0, 14))) for _ in range(pick.randint(1, 6))]
        for text, ids in zip(texts, encoded(encoder, texts)):
            assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_forgetting_changes_nothing(encoder, monkeypatch):
    texts = [" ".join(f"w{i * k}" for i in range(50)) for k in range(1, 30)]
    before = [x.tolist() for x in encoded(encoder, texts)]
    monkeypatch.setattr(packing, "MAX_CACHED", 10)
    assert [x.tolist() for t in texts for x in encoded(encoder, [t])] == before


@pytest.mark.parametrize("most", [4, 1024])
def test_windows_are_full_and_pieces_whole(most):
    pick, out, length = random.Random(1), [], 64
    packer = packing.SumOfSquares(length, out.append, most)
    sizes = [pick.randint(1, length) for _ in range(500)] + [33] * 100
    for n, s in enumerate(sizes):
        packer.place((n, 0, np.arange(s)))
        assert packer.count <= most + 1
    packer.finish()
    got = defaultdict(list)
    for window in out:
        total = sum(len(ids) for _, _, ids in window)
        assert total == length or total & (total - 1) == 0
        for n, start, ids in window:
            assert ids.tolist() == list(range(start, start + len(ids)))
            got[n] += ids.tolist()
    assert all(sorted(got[n]) == list(range(s)) for n, s in enumerate(sizes))
    assert sum(1 for w in out if sum(len(x[2]) for x in w) < length) <= 6


def test_place_lowers_the_sum_of_squares():
    packer = packing.SumOfSquares(10, lambda w: None)
    for s in (6, 6, 3):
        packer.place((0, 0, np.arange(s)))
    # two windows at 6: moving one to 9 gives 1 + 1, a new one at 3 would give 4 + 1
    assert packer.levels[6] == 1 and packer.levels[9] == 1


def test_odd_rows(spark, odd):
    rows = packing.pack(odd, tokenizer_path()).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = sorted(repr((r["doc_id"], len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1)) for r in odd.collect())
    pieces, whole = defaultdict(int), []
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and r["length"] > 0
        if r["start"] == 0:
            whole.append(repr((r["doc_id"], r["doc_tokens"])))
        pieces[r["sequence_id"]] += r["length"]
    assert sorted(whole) == want and max(pieces.values()) <= 2048
    assert sum(r["length"] for r in rows) == sum(int(w.rstrip(")").split()[-1]) for w in want)


def test_no_rows(no_rows):
    assert packing.pack(no_rows, tokenizer_path()).collect() == []


def test_the_query_equals_the_tokenizer_over_a_table(spark, documents):
    """Every id of every document lies in exactly one piece, at the place that the piece says."""
    import zlib

    from lumbre.llm.queries import QUERIES
    tokenizer, pieces, windows = Tokenizer.from_file(tokenizer_path()), defaultdict(list), defaultdict(list)
    for r in QUERIES["op3_packing"](spark, "/root/testdata/sf0.001").collect():
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for d in documents.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces.pop(d["doc_id"]), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not pieces
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    padding = sum(2048 - t for t in (sum(n for _, n in held) for held in windows.values()) if t & (t - 1))
    assert padding < 0.02 * sum(n for held in windows.values() for _, n in held)
