"""Toxicity of texts whose words may be disguised.

Words written with look-alike characters, spaced out or with repeated letters are restored by a noisy channel: each
spelling is a lattice of the letters it may stand for, and a Viterbi search under a character trigram model of the corpus
finds the likeliest readings.  A document is scored by the words and word beginnings, as written and as restored, that
labelled toxic documents hold more often than others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.llm import scan

# What a character may stand for (fixed values of common look-alikes).
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e"}
SEPARATORS = " .-_*~'"
DISGUISE, REPEAT, JOIN, SPLIT, DROP = 0.7, 0.7, 1.0, 2.0, 3.0
READINGS = 4
#: longest spelling whose readings a task remembers
REMEMBERED = 64
SYMBOLS = 64
PREFIXES = (4, 5, 6)

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27 + np.arange(128) % (SYMBOLS - 27)
_LETTER = _SYMBOL > 0
_WORD = _LETTER.copy()
_WORD[48:58] = True
_ANY, _INNER, _SEP = (np.zeros(256, bool) for _ in range(3))
_ANY[[ord(c) for c in "01345789@$"]] = True
_INNER[[ord(c) for c in "!|+("]] = True
_SEP[[ord(c) for c in ".-_*~'"]] = True


@dataclass
class Model:
    """Log probabilities of trigrams of symbols, weights of hashed features, and the calibration from evidence to score."""

    trigrams: np.ndarray
    features: np.ndarray
    weights: np.ndarray
    evidence: np.ndarray
    scores: np.ndarray


def trigram_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Character trigrams of all texts; words are apart by symbol 0.  The table has SYMBOLS ** 3 cells at any corpus size."""
    def run(batches):
        total = np.zeros(SYMBOLS ** 3, np.int64)
        for batch in batches:
            data, offsets = scan.text_column(batch.column(0))
            for lo, hi in scan.chunks(offsets):
                s = np.concatenate([[0], _SYMBOL[data[offsets[lo]:offsets[hi]]], [0]])
                s = s[np.append(True, (s[1:] > 0) | (s[:-1] > 0))]
                if len(s) > 2:
                    total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS ** 3)
                    # a word's second letter follows the boundary and the first: (0, 0, a) counts first letters
                    total += np.bincount(s[1:][s[:-1] == 0], minlength=SYMBOLS ** 3)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["cell", "n"])

    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS ** 3)
    for r in rows:
        counts[r["cell"]] = r["n"]
    return counts


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of the third symbol after two, smoothed by that after one."""
    c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pairs = c.sum(axis=0)
    shorter = (pairs + 1) / (pairs.sum(axis=1, keepdims=True) + SYMBOLS)
    return np.log((c + 5 * shorter) / (c.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


def lattice(spelling: str) -> list[list[tuple[str, float]]]:
    """For each run of one character what it may stand for, and at what cost."""
    steps, k = [], 0
    while k < len(spelling):
        c, run = spelling[k], 1
        while k + run < len(spelling) and spelling[k + run] == c:
            run += 1
        k += run
        if c in SEPARATORS:
            steps.append([("", JOIN), (" ", SPLIT)])
            continue
        letters = LEET.get(c, c if c.isalpha() else "")
        extra = DISGUISE if c in LEET else 0.0
        if not letters:
            steps.append([(" ", DROP)])
        elif run == 1:
            steps.append([(x, extra) for x in letters])
        else:
            steps.append([(x * m, extra + (REPEAT if run > 2 or m == 1 else 0.0)) for x in letters for m in (1, 2)])
    return steps


def viterbi(spelling: str, model: np.ndarray, best: int = READINGS) -> list[str]:
    """The likeliest readings of a spelling, best first.  A state is the last two symbols; each keeps its best few paths.

    A path is a chain of back-pointers with a hash of what it says, so a step costs the same however long the spelling is.
    """
    states: dict[tuple[int, int], list[tuple]] = {(0, 0): [(0.0, 0, None, "")]}
    for step in [*lattice(spelling), [(" ", 0.0)]]:
        after: dict[tuple[int, int], list[tuple]] = {}
        for (a, b), paths in states.items():
            for out, cost in step:
                p, q, add = a, b, cost
                for byte in out.encode():
                    s = int(_SYMBOL[byte])
                    if s == 0 and q == 0:
                        continue
                    add -= float(model[p, q, s])
                    p, q = (0, 0) if s == 0 else (q, s)
                told = after.setdefault((p, q), [])
                for path in paths:
                    said = path[1]
                    for c in out:
                        said = (said * 1_000_003 + ord(c) + 1) % _PRIME
                    told.append((path[0] + add, said, path, out))
        states = {}
        for key, paths in after.items():
            if len(paths) > 1:
                paths.sort(key=_rank)
                kept: list[tuple] = []
                for path in paths:
                    if all(path[1] != x[1] for x in kept):
                        kept.append(path)
                        if len(kept) == best:
                            break
                paths = kept
            states[key] = paths
    return [_said(path) for path in sorted((p for paths in states.values() for p in paths), key=_rank)[:best]]


_PRIME = (1 << 61) - 1


def _rank(path: tuple) -> tuple:
    return path[0], path[1]


def _said(path: tuple) -> str:
    out = []
    while path is not None:
        out.append(path[3])
        path = path[2]
    return "".join(reversed(out))


def disguised(words: scan.Words) -> list[tuple[int, str]]:
    """(row, spelling) of words that may be disguised: look-alikes among letters, three equal letters, single letters apart."""
    data, starts, ends = words.data, words.starts, words.ends
    if not len(starts):
        return []
    total = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    letters, anywhere, inner, apart = total(_LETTER[data]), total(_ANY[data]), total(_INNER[data]), total(_SEP[data])
    n_letters = letters[ends] - letters[starts]
    leet = (anywhere[ends] - anywhere[starts]) + (inner[ends - 1] - inner[starts])
    triple = np.zeros(len(data), bool)
    if len(data) > 2:
        triple[:-2] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTER[data[:-2]]
    triples = total(triple)
    seps = apart[ends - 1] - apart[np.minimum(starts + 1, ends)]
    odd = (n_letters > 0) & ((leet > 0) | (triples[ends] > triples[starts]) | (seps > 1) & (n_letters + leet <= seps + 2))
    found = [(int(words.doc[i]), data[starts[i]:ends[i]].tobytes().decode("utf-8", "replace")) for i in np.flatnonzero(odd)]
    single = (ends - starts == 1) & (_LETTER[data[starts]] | _ANY[data[starts]])
    run = np.flatnonzero(single)
    if len(run) > 2:
        fresh = np.append(True, (np.diff(run) > 1) | (words.doc[run[1:]] != words.doc[run[:-1]]))
        first = np.flatnonzero(fresh)
        for a, b in zip(first, np.append(first[1:], len(run))):
            if b - a > 2:
                found.append((int(words.doc[run[a]]), " ".join(chr(data[starts[i]]) for i in run[a:b])))
    return found


def features(column, model: np.ndarray | None, memory: dict | None = None):
    """For each chunk of rows: (first row, rows, row of each feature, hashes of the feature and of its word, restored words by row).

    Features of a word are the word and its beginnings of 4, 5 and 6 bytes.
    """
    memory = {} if memory is None else memory
    for raw, words in zip(scan.words(column, scan.NOT_SPACE, lower=True), scan.words(column, _WORD, lower=True)):
        restored: dict[int, set[str]] = {}
        if model is not None:
            for row, spelling in disguised(raw):
                found = memory.get(spelling)
                if found is None:
                    found = {w for said in viterbi(spelling.strip(".,;:?!\"'()"), model) for w in said.split() if len(w) > 2}
                    if len(spelling) <= REMEMBERED:
                        if len(memory) > 20_000:
                            memory.clear()
                        memory[spelling] = found
                if found:
                    restored.setdefault(row, set()).update(found)
        said = [(row, w) for row, found in sorted(restored.items()) for w in sorted(found)]
        extra = next(scan.words(pa.array([w for _, w in said], pa.string()), _WORD, size=1 << 40), None) if said else None
        parts = [_hashed(words, words.doc)]
        if extra is not None:
            parts.append(_hashed(extra, np.array([row for row, _ in said])[extra.doc]))
        yield words.first, words.rows, *(np.concatenate(x) for x in zip(*parts)), restored


def _hashed(words: scan.Words, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, hashes, owner = [row], [words.hashes], [words.hashes]
    for k in PREFIXES:
        long = np.flatnonzero(words.ends - words.starts > k)
        rows.append(row[long])
        hashes.append(scan.mix(scan.run_hashes(scan._VALUES[words.data], words.starts[long], words.starts[long] + k) + np.uint64(k)))
        owner.append(words.hashes[long])
    return np.concatenate(rows), np.concatenate(hashes), np.concatenate(owner)


def evidence(rows: int, row: np.ndarray, hashes: np.ndarray, owner: np.ndarray, known: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum over a row's different words of the largest weight among the word's features."""
    if not len(known) or not len(hashes):
        return np.zeros(rows)
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    hit = np.flatnonzero(known[at] == hashes)
    row, owner, weight = row[hit], owner[hit], weights[at[hit]]
    order = np.lexsort((-weight, owner, row))
    row, owner, weight = row[order], owner[order], weight[order]
    first = np.append(True, (row[1:] != row[:-1]) | (owner[1:] != owner[:-1])) if len(row) else np.zeros(0, bool)
    return np.bincount(row[first], weights=weight[first], minlength=rows).astype(float)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most_labelled: int = 40_000, least_z: float = 3.5,
        most_features: int = 20_000) -> Model:
    """Learn from ``labels`` (``key``, ``label`` 0 or 1; rows with nulls are left out).

    The character model counts all documents.  The classifier is fit on at most ``most_labelled`` labelled rows (chosen by hash): of the
    ``most_features`` features most surely tied to toxicity by a likelihood-ratio test, those are kept, the surest first, that still
    explain toxic documents which fewer than three kept ones explain, so that words which only keep company with toxic ones drop out.
    """
    spark = docs.sparkSession
    trigrams = language_model(trigram_counts(docs, text))
    chosen = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k IS NOT NULL AND y IS NOT NULL").distinct()
    chosen = chosen.orderBy(F.xxhash64("k"), "k", "y").limit(most_labelled)
    train = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(F.broadcast(chosen), "k").select("t", "y")
    shared = spark.sparkContext.broadcast(trigrams)

    def count(batches):
        memory: dict = {}
        for batch in batches:
            y = np.array(batch.column(1).to_pylist())
            for first, n, row, hashes, _, _ in features(batch.column(0), shared.value, memory):
                pairs = np.unique(np.stack([hashes, row.astype(np.uint64)], axis=1), axis=0) if len(hashes) else np.zeros((0, 2), np.uint64)
                toxic = y[first + pairs[:, 1].astype(np.int64)]
                unique, at = np.unique(pairs[:, 0], return_inverse=True)
                pos = np.bincount(at, weights=toxic, minlength=len(unique)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(pos), pa.array(np.bincount(at, minlength=len(unique)) - pos)], names=["f", "pos", "neg"])

    total = train.agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).first()
    p, n = float(total["p"] or 0), float(total["n"] or 0)
    sums = train.mapInArrow(count, "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos > 2")
    odds = F.log((F.col("pos") + 0.5) / (p + 1)) - F.log((F.col("neg") + 0.5) / (n + 1))
    # signed root of the likelihood ratio against the share of toxic documents
    ratio = lambda c, share: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col("pos") + F.col("neg")) * share))).otherwise(0.0)
    fair = p / max(p + n, 1.0)
    sums = sums.withColumn("w", odds).withColumn("z", F.sqrt(2 * F.greatest(F.lit(0.0), ratio("pos", fair) + ratio("neg", 1 - fair)))).where((F.col("z") > least_z) & (F.col("w") > 0)) \
        if 0 < fair < 1 else sums.withColumn("w", F.lit(0.0)).withColumn("z", F.lit(0.0)).limit(0)
    kept = sums.orderBy(F.desc("z"), "f").limit(most_features).select("f", "w").toPandas()
    known = kept["f"].to_numpy(np.int64).view(np.uint64) if len(kept) else np.zeros(0, np.uint64)
    order = np.argsort(known)
    known, weights = known[order], kept["w"].to_numpy(float)[order] if len(kept) else np.zeros(0)
    if len(known):
        chosen_features = covering(_held(train, trigrams, known), known, least_z)
        known, weights = known[chosen_features], weights[chosen_features]
    model = Model(trigrams, known, weights, np.zeros(1), np.full(1, p / max(p + n, 1)))
    # evidence in steps of a half, and the share of toxic documents in each, made monotone
    bins = _evidence(train, model, ["y"]).groupBy(F.least(F.round(F.col("evidence") * 2), F.lit(200.0)).alias("b")).agg(F.sum("y").alias("p"), F.count("*").alias("n")).orderBy("b").collect()
    if bins:
        model.evidence, model.scores = isotonic(np.array([r["b"] / 2 for r in bins]), np.array([float(r["p"]) for r in bins]), np.array([float(r["n"]) for r in bins]), (p + 1) / (p + n + 2))
    return model


def _held(train: DataFrame, trigrams: np.ndarray, known: np.ndarray) -> list:
    """(label, which known features the document holds) of the labelled rows, which are bounded in number."""
    shared = train.sparkSession.sparkContext.broadcast((trigrams, known))

    def run(batches):
        memory: dict = {}
        for batch in batches:
            y, held = batch.column(1), [[] for _ in range(batch.num_rows)]
            for first, _, row, hashes, _, _ in features(batch.column(0), shared.value[0], memory):
                at = np.searchsorted(shared.value[1], hashes)
                at[at == len(shared.value[1])] = 0
                hit = shared.value[1][at] == hashes
                for r, f in np.unique(np.stack([row[hit], at[hit]], axis=1), axis=0).tolist():
                    held[first + r].append(f)
            yield pa.RecordBatch.from_arrays([y.cast(pa.int32()), pa.array(held, pa.list_(pa.int32()))], names=["y", "held"])

    return train.mapInArrow(run, "y int, held array<int>").collect()


def covering(rows: list, known: np.ndarray, least_z: float, deep: int = 3) -> np.ndarray:
    """Sequential covering: take the feature with the largest likelihood ratio on what is left, leave out what is explained ``deep`` times."""
    y = np.array([r["y"] for r in rows], np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r["held"]) for r in rows])
    feature = np.array([f for r in rows for f in r["held"]], np.int64)
    by_doc = np.searchsorted(doc, np.arange(len(rows) + 1))
    order = np.argsort(feature, kind="stable")
    by_feature = np.searchsorted(feature[order], np.arange(len(known) + 1))
    pos = np.bincount(feature[y[doc] == 1], minlength=len(known)).astype(float)
    neg = np.bincount(feature[y[doc] == 0], minlength=len(known)).astype(float)
    left, negatives, times, taken = float(y.sum()), float((y == 0).sum()), np.zeros(len(rows), np.int64), []
    while left:
        share = left / (left + negatives)
        n = np.maximum(pos + neg, 1e-9)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(pos > 0, pos * np.log(pos / (n * share)), 0) + np.where(neg > 0, neg * np.log(neg / (n * (1 - share))), 0)
        gain[pos <= n * share] = 0
        best = int(np.argmax(gain))
        if np.sqrt(2 * gain[best]) < least_z:
            break
        taken.append(best)
        for d in doc[order[by_feature[best]:by_feature[best + 1]]]:
            times[d] += 1
            if y[d] and times[d] == deep:
                left -= 1
                np.subtract.at(pos, feature[by_doc[d]:by_doc[d + 1]], 1)
        pos[best] = neg[best] = 0
    return np.array(sorted(taken), np.int64)


def isotonic(x: np.ndarray, pos: np.ndarray, n: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing shares (pool adjacent violators), each with two rows of the prior."""
    blocks: list[list] = []
    for v, a, b in zip(x, pos, n):
        blocks.append([[v], a, b])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    score = np.array([(a + 2 * prior) / (b + 2) for vs, a, b in blocks for _ in vs])
    return np.array([v for vs, _, _ in blocks for v in vs]), np.maximum.accumulate(score)


def _evidence(docs: DataFrame, model: Model, kept: list[str], text: str = "t", words: bool = False, inside: str | None = None) -> DataFrame:
    """``kept`` columns with ``evidence``; the text is a column, or a field of the struct column ``inside`` (and so sent once)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    memory: dict = {}

    def run(batch: pa.RecordBatch) -> list:
        m = shared.value
        column = batch.column(batch.schema.names.index(inside or text))
        if inside:
            column = column.field(text).cast(pa.string())
        total, found = [], []
        for _, rows, row, hashes, owner, restored in features(column, m.trigrams, memory):
            total.append(evidence(rows, row, hashes, owner, m.features, m.weights))
            if words:
                found += [sorted(restored.get(r, ())) for r in range(rows)]
        return [pa.array(np.concatenate(total)), *([pa.array(found, pa.list_(pa.string()))] if words else [])]

    return scan.append_columns(docs.select(*([] if inside else [text]), *kept), run, [("evidence", "double"), *([("restored", "array<string>")] if words else [])])


def _calibrated(model: Model):
    """Evidence as a score."""
    x, y = [float(v) for v in model.evidence], [float(v) for v in model.scores]
    shown = F.lit(y[0])
    for k in range(1, len(x)):
        if y[k] > y[k - 1]:
            shown = F.when(F.col("evidence") >= (x[k] + x[k - 1]) / 2, F.lit(y[k])).otherwise(shown)
    # evidence orders documents of one step
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), shown + F.lit(1e-4) * F.tanh(F.col("evidence") / 20)))


def below(docs: DataFrame, model: Model, threshold: float, text: str = "text") -> DataFrame:
    """The documents whose score is below ``threshold``, as they are."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return _evidence(rows, model, ["row"], text, inside="row").where(_calibrated(model) < threshold).select("row.*")


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: likelier toxic) and ``restored`` (words read out of disguised spellings, sorted).

    Null and empty texts have no evidence and get the score of such texts; equal texts get equal scores; columns named
    ``score`` or ``restored`` are replaced.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("score", "restored")]).alias("row"))
    found = _evidence(rows, model, ["row"], text, words=True, inside="row")
    return found.select("row.*", _calibrated(model).alias("score"), "restored")
