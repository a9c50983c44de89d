"""Text search over distinct texts: by words, by vector, both, and how good it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lumbre.functions.text import fold, occurrences, spaced_words, stemmed, word_count
from lumbre.session import cut_lineage

K1, B = 1.2, 0.75
# Weight of words and of meaning in the mix.
WEIGHTS = (0.3, 0.7)
MIN_THEME_FORMS = 3
THEME_LEAD = 2
MAX_RANK = 5
RANK_LEAD = 3
DIMENSIONS = 64


def _terms(spark, query: str, stem: bool) -> list[str]:
    """Distinct words of the query, normalised like the texts (one tiny row, evaluated while planning)."""
    words = spaced_words(F.lit(query))
    words = stemmed(words) if stem else words
    return sorted(set(spark.range(1).select(words.alias("w")).first()["w"].split()))


def word_counts(docs: DataFrame, id_column: str, text: str, variants: dict[str, tuple[list[str], bool]]) -> DataFrame:
    """Length of each text and how often each query word occurs in it: a few numbers per text, from one reading of it.

    ``variants`` names lists of words, each to be looked up in plain or in stemmed text.
    """
    spaced = docs.select(id_column, spaced_words(F.col(text)).alias("_plain"))
    if any(stem for _, stem in variants.values()):
        spaced = spaced.withColumn("_stem", stemmed(F.col("_plain")))
    counts = []
    for name, (terms, stem) in variants.items():
        words = F.col("_stem" if stem else "_plain")
        counts.append(F.struct(word_count(words).alias("len"), F.array(*[occurrences(words, t) for t in terms]).cast("array<double>").alias("tf")).alias(name))
    return spaced.select(id_column, *counts)


def _score(counts: DataFrame, id_column: str, name: str, n_terms: int) -> DataFrame:
    """BM25 of every text; the collection statistics are one aggregate that feeds the scores as a scalar."""
    tf = lambda i: F.get(F.col(f"{name}.tf"), i)
    stats = counts.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg(f"{name}.len").alias("avg"),
                                F.array(*[F.count_if(tf(i) > 0) for i in range(n_terms)]).alias("df")).alias("s")).scalar()
    scored = counts.withColumn("_s", stats)
    score = F.lit(0.0)
    for i in range(n_terms):
        df_i = F.get(F.col("_s.df"), i)
        idf = F.log(1 + (F.col("_s.n") - df_i + 0.5) / (df_i + 0.5))
        score = score + idf * tf(i) * (K1 + 1) / (tf(i) + K1 * (1 - B + B * F.col(f"{name}.len") / F.col("_s.avg")))
    return scored.select(id_column, score.alias("score"))


def _leaders(scored: DataFrame, id_column: str, n: int) -> DataFrame:
    # Texts without any of the words score 0; they go after the limit, so the filter does not repeat the counts.
    return scored.orderBy(F.desc("score"), F.asc(id_column)).limit(n).where(F.col("score") > 0)


def words_only(counts: DataFrame, id_column: str, name: str, n: int) -> DataFrame:
    """Top ``n`` by the words of one variant of ``word_counts`` that looks up a single word."""
    return _leaders(_score(counts, id_column, name, 1), id_column, n)


def bm25(docs: DataFrame, id_column: str, text: str, query: str, n: int = 5, stem: bool = False) -> DataFrame:
    """Top ``n`` texts for a query by BM25.

    Words are counted inside each row and only the counts are kept, in a table
    that both the statistics and the scores read; no posting is shuffled.
    """
    terms = _terms(docs.sparkSession, query, stem)
    counts = cut_lineage(word_counts(docs, id_column, text, {"w": (terms, stem)}), "words")
    return _leaders(_score(counts, id_column, "w", len(terms)), id_column, n)


def lexical(docs: DataFrame, id_column: str, text: str, query: str, n: int = 5) -> DataFrame:
    """Plain and stemmed words together, from one reading of the texts: each takes the better of its two scores."""
    plain, stems = _terms(docs.sparkSession, query, False), _terms(docs.sparkSession, query, True)
    counts = cut_lineage(word_counts(docs, id_column, text, {"p": (plain, False), "s": (stems, True)}), "words")
    both = _leaders(_score(counts, id_column, "p", len(plain)), id_column, n).unionByName(_leaders(_score(counts, id_column, "s", len(stems)), id_column, n))
    return both.groupBy(id_column).agg(F.max("score").alias("score")).orderBy(F.desc("score"), F.asc(id_column)).limit(n)


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def vector_top(vectors: DataFrame, id_column: str, vector: str, query: list[float], k: int = 10) -> DataFrame:
    """Top ``k`` by inner product with one query vector."""
    return vectors.select(id_column, dot(F.col(vector), F.lit([float(x) for x in query])).alias("score")).where(F.col("score").isNotNull()) \
        .orderBy(F.desc("score"), F.asc(id_column)).limit(k)


def vector_top_many(vectors: DataFrame, id_column: str, vector: str, queries: dict[str, list[float]], k: int = 10) -> DataFrame:
    """Top ``k`` for each of a short list of query vectors in one scan; each task keeps only its own leaders."""
    asked = F.array(*[F.struct(F.lit(name).alias("query"), F.array(*map(F.lit, v)).alias("q")) for name, v in queries.items()])
    scored = vectors.select(id_column, F.col(vector).alias("_v"), F.explode(asked).alias("_a")) \
        .select("_a.query", id_column, dot(F.col("_v"), F.col("_a.q")).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc(id_column))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hash_cells(texts: DataFrame, id_column: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, cell, n): each text as a bag of hashed stems, for when no model supplies vectors.

    Counted per text and cell before the shuffle, so a text sends at most ``dimensions`` rows however long it is.
    """
    words = F.explode(F.split(F.trim(stemmed(spaced_words(F.col(text)))), " +")).alias("word")
    return texts.select(id_column, words).where(F.col("word") != "") \
        .groupBy(id_column, F.pmod(F.xxhash64("word"), F.lit(dimensions)).cast("int").alias("cell")).agg(F.count(F.lit(1)).cast("double").alias("n"))


def hash_weights(texts: DataFrame, id_column: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, cell, weight) with weights normalised to length 1."""
    cells = hash_cells(texts, id_column, text, dimensions)
    norms = cells.groupBy(id_column).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("_norm"))
    return cells.join(norms, id_column).select(id_column, "cell", (F.col("n") / F.col("_norm")).alias("weight"))


def hash_vectors(texts: DataFrame, id_column: str, text: str, dimensions: int = DIMENSIONS, out: str = "embedding") -> DataFrame:
    """The same as one array per text."""
    entries = hash_weights(texts, id_column, text, dimensions).groupBy(id_column).agg(F.map_from_entries(F.collect_list(F.struct("cell", "weight"))).alias("m"))
    return entries.select(id_column, F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)),
                                                 lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias(out))


def hashed_top(texts: DataFrame, id_column: str, text: str, query: str, k: int = 10, dimensions: int = DIMENSIONS) -> DataFrame:
    """Top ``k`` by inner product of the hashed texts with the hashed query."""
    asked = hash_weights(texts.sparkSession.range(1).select(F.lit(0).alias("q"), F.lit(query).alias("t")), "q", "t", dimensions)
    # The query has as many cells as dimensions at most, so it is broadcast.
    q = F.broadcast(asked.select("cell", F.col("weight").alias("q")))
    # Product and norm come out of one aggregation over the cells of each text.
    score = F.sum(F.col("n") * F.coalesce("q", F.lit(0.0))) / F.sqrt(F.sum(F.col("n") * F.col("n")))
    return hash_cells(texts, id_column, text, dimensions).join(q, "cell", "left").groupBy(id_column).agg(score.alias("score")) \
        .orderBy(F.desc("score"), F.asc(id_column)).limit(k)


def embed(df: DataFrame, text: str, encode, dimensions: int, out: str = "embedding", batch: int = 100) -> DataFrame:
    """Vectors from a user's ``encode(list[str]) -> list[list[float]]``, in batches inside Arrow tasks."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(frames):
        for frame in frames:
            texts = frame[text].tolist()
            vectors = []
            for i in range(0, len(texts), batch):
                vectors += [list(map(float, v)) for v in encode(texts[i:i + batch])]
            yield frame.assign(**{out: vectors})
    return df.mapInPandas(run, schema)


def _min_max(scored: DataFrame, name: str) -> DataFrame:
    """Scores of a short list rescaled to 0–1; a list of one (or of equal scores) is all 1."""
    bounds = scored.agg(F.struct(F.min("score").alias("lo"), F.max("score").alias("hi"))).scalar()
    s = scored.withColumn("_b", bounds)
    span = F.col("_b.hi") - F.col("_b.lo")
    return s.withColumn(name, F.when(span == 0, F.lit(1.0)).otherwise((F.col("score") - F.col("_b.lo")) / span)).drop("_b", "score")


def hybrid(words: DataFrame, meaning: DataFrame, id_column: str, n: int = 5, weights: tuple[float, float] = WEIGHTS) -> DataFrame:
    """Both top lists normalised and mixed; a text missing from one list gets 0 there."""
    both = _min_max(words, "w").join(_min_max(meaning, "m"), id_column, "full_outer")
    mixed = (F.coalesce("w", F.lit(0.0)) * weights[0] + F.coalesce("m", F.lit(0.0)) * weights[1]) / sum(weights)
    return both.select(id_column, mixed.alias("score")).orderBy(F.desc("score"), F.asc(id_column)).limit(n)


def list_size(n: int) -> int:
    """How many hits each side contributes to a mix of ``n``."""
    return max(n, 10)


def ranked(results: DataFrame, by: list[str] = ()) -> DataFrame:
    """A short result list with its rank, 1 first."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("id"))
    return results.withColumn("rank", F.row_number().over(w))


def finds_target(targets: DataFrame, lexical_ranks: DataFrame, hybrid_ranks: DataFrame) -> DataFrame:
    """Searches that show the difference: the target among the first five of the mix, and absent or three places lower by words.

    ``targets``: query, id. The ranks: query, id, rank.
    """
    h = hybrid_ranks.select("query", "id", F.col("rank").alias("hybrid_rank"))
    lx = lexical_ranks.select("query", "id", F.col("rank").alias("lexical_rank"))
    counts = lexical_ranks.groupBy("query").agg(F.count(F.lit(1)).alias("lexical_hits"))
    joined = targets.join(h, ["query", "id"]).join(lx, ["query", "id"], "left").join(counts, "query", "left")
    return joined.where((F.col("hybrid_rank") <= MAX_RANK)
                        & (F.col("lexical_rank").isNull() | (F.col("lexical_rank") >= F.col("hybrid_rank") + RANK_LEAD)))


def pick_searches(proven: DataFrame, n: int) -> DataFrame:
    """Best first: high in the mix, absent or low by words."""
    return proven.orderBy("hybrid_rank", F.desc(F.coalesce("lexical_rank", F.lit(99))), "lexical_hits", "query").limit(n)


def is_variant(text: Column, other: Column) -> Column:
    """``x, control`` is the same form as ``x``."""
    return fold(text).startswith(F.concat(fold(other), F.lit(",")))


def theme_coverage(forms: DataFrame, semantic: DataFrame, words: DataFrame) -> DataFrame:
    """Forms of each theme found by meaning and by words; themes with three found and a lead of two.

    ``forms``: theme, text. The hits: theme, text. Lists are a few dozen rows per theme.
    """
    def form_keys(c: Column) -> Column:
        return F.array(F.concat(F.lit("="), c), F.concat(F.lit("~"), fold(c)))

    def hit_keys(c: Column) -> Column:
        # The hit itself, and everything before each of its commas: what it may be a variant of.
        parts = F.split(fold(c), ",")
        cuts = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
        heads = F.transform(cuts, lambda i: F.concat(F.lit("~"), F.array_join(F.slice(parts, F.lit(1), i), ",")))
        return F.array_union(F.array(F.concat(F.lit("="), c)), heads)

    def found(hits: DataFrame, name: str) -> DataFrame:
        h = hits.select("theme", F.explode(hit_keys(F.col("text"))).alias("key")).distinct()
        f = forms.select("theme", "text", F.explode(form_keys(F.col("text"))).alias("key"))
        return f.join(h, ["theme", "key"], "left_semi").select("theme", "text").distinct().withColumn(name, F.lit(1))
    both = forms.join(found(semantic, "s"), ["theme", "text"], "left").join(found(words, "w"), ["theme", "text"], "left")
    return both.groupBy("theme").agg(F.coalesce(F.sum("s"), F.lit(0)).alias("by_meaning"), F.coalesce(F.sum("w"), F.lit(0)).alias("by_words")) \
        .where((F.col("by_meaning") >= MIN_THEME_FORMS) & (F.col("by_meaning") - F.col("by_words") >= THEME_LEAD))


def valid_themes(themes: DataFrame, texts: DataFrame) -> DataFrame:
    """Themes (theme, forms array) whose forms are known texts, without variants, three or more, and not a repeat of an earlier theme.

    A repeat shares two forms or more with a theme before it.
    """
    forms = themes.select("theme", F.posexplode(F.array_distinct("forms")).alias("pos", "form"))
    known = forms.join(texts.select(fold(F.col("text")).alias("_k"), F.col("text").alias("known")).dropDuplicates(["_k"]),
                       fold(F.col("form")) == F.col("_k"))
    lists = known.groupBy("theme").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "known"))), lambda s: s["known"]).alias("f"))
    kept = F.aggregate("f", F.array().cast("array<string>"), lambda acc, x: F.when(
        F.exists(acc, lambda y: (y == x) | is_variant(x, y) | is_variant(y, x)), acc).otherwise(F.array_append(acc, x)))
    clean = lists.select("theme", kept.alias("forms")).where(F.size("forms") >= MIN_THEME_FORMS)
    # Proposals are a handful; they are accepted one by one, in order, against those already accepted.
    item = F.struct("theme", "forms")
    accepted = F.aggregate(F.array_sort(F.collect_list(item)), F.array().cast("array<struct<theme:string,forms:array<string>>>"),
                           lambda acc, t: F.when(F.exists(acc, lambda a: F.size(F.array_intersect(a["forms"], t["forms"])) >= 2), acc)
                           .otherwise(F.array_append(acc, t)))
    return clean.agg(accepted.alias("a")).select(F.explode("a").alias("t")).select("t.*")


def relevance(judged: DataFrame, k: int = 10, relevant: float = 0.5) -> DataFrame:
    """NDCG, precision and average precision at ``k`` per query, from (query, rank, rating).

    The ideal order uses all ratings of the query, found or not (rank NULL).
    """
    by_rating = Window.partitionBy("query").orderBy(F.desc("rating"), F.asc_nulls_last("rank"))
    by_rank = Window.partitionBy("query").orderBy(F.asc_nulls_last("rank"))
    gain = lambda r, p: (F.pow(F.lit(2.0), r) - 1) / F.log2(p + 1)
    hit = F.col("rank").isNotNull() & (F.col("rank") <= k)
    good = (F.col("rating") >= relevant)
    df = judged.withColumns({"_ideal": F.row_number().over(by_rating),
                             "_good": F.sum(F.when(hit & good, 1).otherwise(0)).over(by_rank.rowsBetween(Window.unboundedPreceding, 0))})
    dcg = F.sum(F.when(hit, gain(F.col("rating"), F.col("rank"))).otherwise(0.0))
    ideal = F.sum(F.when(F.col("_ideal") <= k, gain(F.col("rating"), F.col("_ideal"))).otherwise(0.0))
    precision_sum = F.sum(F.when(hit & good, F.col("_good") / F.col("rank")).otherwise(0.0))
    return df.groupBy("query").agg(
        (dcg / F.nullif(ideal, F.lit(0.0))).alias("ndcg"),
        (F.count_if(hit & good) / F.nullif(F.count_if(hit), F.lit(0))).alias("precision"),
        (precision_sum / F.nullif(F.count_if(good), F.lit(0))).alias("average_precision"))
