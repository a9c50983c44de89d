import numpy as np
import pytest
from pyspark.sql import functions as F

from lumbre.llm import quality, toxicity
from lumbre.llm.queries import held_out

BASE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{BASE}/labels.parquet")


def held(scored, labels, label, at):
    rows = scored.where(held_out()).join(labels, "doc_id").select(label, (F.col("score") >= at).cast("int").alias("p")).collect()
    return np.array([r[label] for r in rows]), np.array([r["p"] for r in rows])


def test_toxicity_on_held_out_documents(tables):
    docs, labels = tables
    y, p = held(toxicity.score(docs, toxicity.fit(docs, labels.where(~held_out()))), labels, "toxic", 0.7)
    assert (y == p).mean() > 0.97 and p[y == 0].mean() < 0.01 and p[y == 1].mean() > 0.8


def test_quality_on_held_out_documents(tables):
    docs, labels = tables
    model = quality.fit(docs, labels.where(~held_out()))
    y, p = held(quality.score(docs, model), labels, "quality", 0.5)
    assert (y == p).mean() > 0.98 and 0 < len(model.rules) < 200


def test_viterbi_restores_disguised_words(tables):
    model = toxicity.language_model(toxicity.trigram_counts(tables[0], "text"))
    for spelling, word in (("1d10t", "idiot"), ("m0r0n", "moron"), ("s t u p i d", "stupid"), ("looooser", "loser"), ("p@thetic", "pathetic"), ("i.d.i.o.t", "idiot"), ("tr4sh", "trash"), ("stuuupiiid", "stupid")):
        assert word in toxicity.viterbi(spelling, model)[0].split(), spelling


def test_disguised_words_count(spark):
    clean, toxic = [f"a quiet day number {i} by the river" for i in range(60)], [f"you are an idiot and a moron number {i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(clean + toxic + ["you are an 1d10t and a m0r0n", "what a i d i o t m o r o n", "quiet river"])), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(120)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).where("doc_id >= 120").collect()}
    assert got[120]["score"] > 0.7 and {"idiot", "moron"} <= set(got[120]["restored"]) and got[122]["score"] < 0.3


def test_odd_rows(spark, odd, no_rows):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (5, 0), (6, 1), (7, 0)], "doc_id long, label int")
    for module in (toxicity, quality):
        for some in (labels, labels.limit(0), labels.where("label = 1")):
            model = module.fit(odd, some, label="label")
            rows = module.score(odd, model)
            assert set(odd.columns) <= set(rows.columns)
            got = rows.select("doc_id", "text", "score").collect()
            assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
            assert len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1
        assert module.score(no_rows, model).collect() == []
        assert module.score(no_rows, module.fit(no_rows, labels, label="label")).collect() == []


def test_compiled_rules_equal_the_model(spark):
    rules = quality.Rules(0.5, [(("chars", True, 3.0),), (("chars", False, 10.0), ("words", True, 1.0))], [1.0, -2.0])
    rows = spark.createDataFrame([("ab",), ("a b c d",), ("a b c d e f g h",), (None,)], "t string")
    got = [r["s"] for r in quality.with_statistics(rows, "t").select("t", rules.column().alias("s")).collect()]
    sig = lambda x: 1 / (1 + np.exp(-x))
    assert got == pytest.approx([sig(0.5), sig(-0.5), sig(1.5), sig(0.5)])


def test_lasso_keeps_the_rule_that_matters():
    pick = np.random.default_rng(0)
    x = (pick.random((400, 20)) > 0.5).astype(float)
    b, w = quality.lasso(x, x[:, 3], 0.02)
    assert np.argmax(np.abs(w)) == 3 and (w != 0).sum() <= 3


def likeliest(spelling, model):
    """All readings of a spelling by walking every path of its lattice, with the cost of the cheapest path to each."""
    found = {}

    def walk(steps, p, q, cost, said):
        if not steps:
            found[said] = min(cost, found.get(said, np.inf))
            return
        for out, more in steps[0]:
            a, b, add = p, q, more
            for byte in out.encode():
                s = int(toxicity._SYMBOL[byte])
                if s == 0 and b == 0:
                    continue
                add -= float(model[a, b, s])
                a, b = (0, 0) if s == 0 else (b, s)
            walk(steps[1:], a, b, cost + add, said + out)
    walk([*toxicity.lattice(spelling), [(" ", 0.0)]], 0, 0, 0.0, "")
    return found


def test_viterbi_finds_the_cheapest_reading():
    pick = np.random.default_rng(9)
    model = toxicity.language_model(pick.integers(0, 300, 64 ** 3).astype(float))
    for _ in range(150):
        spelling = "".join(pick.choice(list("abil0134$!. -5t"), pick.integers(1, 8)))
        costs = likeliest(spelling, model)
        said = toxicity.viterbi(spelling, model)
        assert costs[said[0]] == pytest.approx(min(costs.values())), spelling
        assert [costs[s] for s in said] == sorted(costs[s] for s in said)


def test_very_long_words_take_time_in_proportion():
    import time
    pick = np.random.default_rng(10)
    model = toxicity.language_model(pick.integers(0, 300, 64 ** 3).astype(float))
    took = []
    for n in (20_000, 80_000):
        word = "".join(pick.choice(list("abcdefghijklmnop0123456789"), n))
        start = time.process_time()
        assert len(toxicity.viterbi(word, model)[0]) > n / 2
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0]


def test_scores_equal_plain_python(spark, documents):
    """Evidence of each document from its different words one by one, whatever is beside it in a batch."""
    import re

    import pyarrow as pa
    from lumbre.llm import scan
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = toxicity.fit(documents, labels, least_z=1.5)
    known = dict(zip(model.features.tolist(), model.weights.tolist()))
    assert known

    def weight(word):
        words = next(scan.words(pa.array([word]), toxicity._WORD, lower=True))
        return max((known[h] for h in toxicity._hashed(words, words.doc)[1].tolist() if h in known), default=0.0)

    got = {r["doc_id"]: r for r in toxicity._evidence(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("t")), model, ["doc_id"], words=True).select("doc_id", "evidence", "restored").collect()}
    for r in documents.select("doc_id", "text").collect():
        text = r["text"] or ""
        lower = text.translate({i: i + 32 for i in range(65, 91)})
        words = set(re.findall(r"[a-z0-9\x80-\U0010ffff]+", lower)) | set(got[r["doc_id"]]["restored"])
        assert got[r["doc_id"]]["evidence"] == pytest.approx(sum(weight(w) for w in words), abs=1e-6)
