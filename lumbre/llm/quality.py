"""Quality of texts by a sparse ensemble of rules.

Shallow trees are grown over statistics of labelled texts; every path from a root to a node is a rule, a conjunction of
comparisons.  A logistic model over the rules with an L1 penalty keeps few of them, and these are compiled into one
Spark column expression, so that scoring runs in the JVM over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "*#$%&|@^~<>{}[]=_+\\/"
STATISTICS = ("chars", "words", "word_length", "distinct", "letters", "digits", "upper", "symbols", "pipes", "commas", "stops", "lines", "line_words", "short")


def with_statistics(df: DataFrame, text: str) -> DataFrame:
    """``df`` with one column for each of STATISTICS; shares of nothing are 0.  A null text is an empty one."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    left = lambda characters: F.char_length("__t") - F.char_length(F.translate("__t", characters, ""))
    share = lambda x, of: (x / F.greatest(of, F.lit(1))).cast("double")
    out = df.withColumn("__t", t).withColumn("__w", F.split(F.regexp_replace("__t", r"^\s+|\s+$", ""), r"\s+"))
    blank = F.col("__w")[0] == ""
    out = out.withColumns({"__n": F.char_length("__t"), "__k": F.when(blank, 0).otherwise(F.size("__w")), "__u": F.when(blank, 0).otherwise(F.size(F.array_distinct("__w"))),
                           "__l": left("\n") + 1})
    n, k = F.col("__n"), F.col("__k")
    return out.withColumns({
        "chars": n.cast("double"), "words": k.cast("double"), "word_length": share(n, k), "distinct": share(F.col("__u"), k),
        "letters": share(F.char_length(F.regexp_replace("__t", r"\P{L}+", "")), n), "digits": share(left("0123456789"), n),
        "upper": share(left("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), k), "symbols": share(left(SYMBOLS), k), "pipes": share(left("|"), k), "commas": share(left(","), k),
        "stops": share(left(".!?"), k), "lines": F.col("__l").cast("double"), "line_words": share(k, F.col("__l")),
        "short": share(F.regexp_count("__t", F.lit(r"(?<!\p{L})\p{L}{1,3}(?!\p{L})")), k)}).drop("__t", "__w", "__n", "__k", "__u", "__l")


@dataclass
class Rules:
    """Conjunctions of (statistic, is greater, threshold), their weights and the intercept."""

    intercept: float = 0.0
    rules: list[tuple[tuple[str, bool, float], ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self) -> Column:
        """The score over the statistics' columns."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            held = F.lit(True)
            for name, greater, threshold in rule:
                held = held & ((F.col(name) > threshold) if greater else (F.col(name) <= threshold))
            total = total + F.when(held, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int, tries: int) -> list[tuple[tuple[int, bool, float], ...]]:
    """Paths of one tree; each node splits one of ``tries`` random statistics at the quantile that lowers squared error most."""
    paths, stack = [], [((), np.arange(len(y)))]
    while stack:
        path, rows = stack.pop()
        if path:
            paths.append(path)
        if len(path) == depth or len(rows) < 2 * least:
            continue
        best = None
        for j in rng.choice(x.shape[1], min(tries, x.shape[1]), replace=False):
            v, r = x[rows, j], y[rows]
            order = np.argsort(v, kind="stable")
            v, sums = v[order], np.cumsum(r[order])
            n = np.arange(1, len(v))
            gain = sums[:-1] ** 2 / n + (sums[-1] - sums[:-1]) ** 2 / (len(v) - n)
            gain[(v[1:] == v[:-1]) | (n < least) | (len(v) - n < least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > sums[-1] ** 2 / len(v) + 1e-9 and (best is None or gain[k] > best[0]):
                best = (gain[k], j, (v[k] + v[k + 1]) / 2)
        if best:
            _, j, threshold = best
            right = x[rows, j] > threshold
            stack += [(path + ((int(j), False, float(threshold)),), rows[~right]), (path + ((int(j), True, float(threshold)),), rows[right])]
    return paths


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all but the intercept, by accelerated proximal gradient steps."""
    n, m = x.shape
    full = np.hstack([np.ones((n, 1)), x])
    v = np.ones(m + 1)
    for _ in range(30):  # largest curvature by power iteration
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / float(v @ (full.T @ (full @ v)))
    w = z = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ z, -30, 30)))
        step = z - rate * (full.T @ (p - y)) / n
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new[0] = step[0]
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = new + (t - 1) / s * (new - w), new, s
    return float(w[0]), w[1:]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most_labelled: int = 20_000,
        trees: int = 40, depth: int = 3, least: int = 5, penalty: float = 1e-3, seed: int = 7) -> Rules:
    """Learn from at most ``most_labelled`` rows of ``labels`` (``key``, ``label`` 0 or 1, nulls left out), chosen by hash."""
    chosen = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k IS NOT NULL AND y IS NOT NULL").distinct()
    chosen = chosen.orderBy(F.xxhash64("k"), "k", "y").limit(most_labelled)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").select("t", "y")
    pdf = with_statistics(rows, "t").select("y", *STATISTICS).toPandas()
    x, y = pdf[list(STATISTICS)].to_numpy(float), pdf["y"].to_numpy(float)
    share = (y.sum() + 1) / (len(y) + 2)
    plain = Rules(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return plain
    order = np.lexsort((*x.T, y))  # the order of rows read does not matter
    x, y = x[order], y[order]
    rng, found, residual = np.random.default_rng(seed), {}, y - y.mean()
    for n in range(trees):
        rows = rng.choice(len(y), max(2, len(y) // 2), replace=False)
        target = residual if n % 2 else y - y.mean()
        paths = grow(x[rows], target[rows], rng, depth, least, tries=6)
        for path in paths:
            found[path] = _holds(x, path)
        if n % 2 and paths:  # half the trees look at what is left unexplained
            matrix = np.stack([found[p] for p in paths], axis=1).astype(float)
            residual = residual - 0.1 * (matrix @ np.linalg.lstsq(matrix, residual, rcond=None)[0])
    rules, kept = [], set()
    for path, held in found.items():
        mark = held.tobytes()
        if mark not in kept and 0 < held.sum() < len(y):
            kept.add(mark)
            rules.append(path)
    if not rules:
        return plain
    matrix = np.stack([found[p] for p in rules], axis=1).astype(float)
    intercept, weights = lasso(matrix, y, penalty)
    used = [i for i in range(len(rules)) if weights[i]]
    return Rules(intercept, [tuple((STATISTICS[j], g, t) for j, g, t in rules[i]) for i in used], [float(weights[i]) for i in used])


def _holds(x: np.ndarray, path: tuple) -> np.ndarray:
    held = np.ones(len(x), bool)
    for j, greater, threshold in path:
        held &= (x[:, j] > threshold) == greater
    return held


def score(docs: DataFrame, model: Rules, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: likelier good).

    Null and empty texts have the statistics of an empty text; equal texts have equal scores; a column named ``score`` is
    replaced; other columns keep their names, as statistics are computed beside them.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "score"]).alias("row"), F.col(text).alias("t"))
    return with_statistics(rows, "t").select("row", model.column().alias("score")).select("row.*", "score")
