"""Text search over documents, conversations and embeddings."""

from functools import reduce

from pyspark.sql import functions as F

from lumbre.functions import text as tx
from lumbre.operators import search as sr, text_index as ti
from lumbre.queries.registry import query
from lumbre.session import cut_lineage, scratch_path

WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
ASK = "other than with the ing"
_TERMS = ("ing", "other", "than", "the", "with")
_TF = ", ".join(f"len(list_filter(w, lambda x: x = '{q}')) AS tf{i}" for i, q in enumerate(_TERMS))
_DF = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(_TERMS)))
_SCORE = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avg))" for i in range(len(_TERMS)))


@query("SR1 F18 A25", f"""WITH b AS (SELECT doc_id, len(w) AS len, {_TF} FROM (SELECT doc_id, {WORDS} AS w FROM documents)),
s AS (SELECT count(*) AS n, avg(len) AS avg, {_DF} FROM b)
SELECT doc_id, round({_SCORE}, 6) AS score FROM b, s WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(_TERMS)))} ORDER BY {_SCORE} DESC, doc_id LIMIT 10""")
def bm25_topk(t):
    return sr.bm25(t.spread("documents", "doc_id", "text"), "doc_id", "text", ASK, 10).withColumn("score", F.round("score", 6))


_STEMMED = "list_transform({}, lambda x: CASE WHEN length(x) >= 5 THEN regexp_replace(x, '^(.*?)(?:" + tx._ENDINGS + r")$', '\1') ELSE x END)"
_STEM = f"list_filter({_STEMMED}, lambda x: x <> '')"


@query("SR1 F18", f"""WITH d AS (SELECT doc_id, {WORDS} AS w, regexp_split_to_array('{ASK}', ' ') AS asked FROM documents),
f AS (SELECT doc_id, 'p' AS field, w, asked AS q FROM d UNION ALL SELECT doc_id, 's', {_STEMMED.format("w")}, {_STEMMED.format("asked")} FROM d), z AS (SELECT field, count(*) AS n, avg(len(w)) AS mean FROM f GROUP BY 1),
p AS (SELECT doc_id, field, len(w) AS len, term, len(list_filter(w, lambda x: x = term)) AS tf FROM (SELECT doc_id, field, w, unnest(list_distinct(q)) AS term FROM f)),
h AS (SELECT field, term, count(*) AS df FROM p WHERE tf > 0 GROUP BY ALL),
s AS (SELECT doc_id, field, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS s FROM p JOIN h USING (field, term) JOIN z USING (field) WHERE tf > 0 GROUP BY ALL),
l AS (SELECT doc_id, s FROM s QUALIFY row_number() OVER (PARTITION BY field ORDER BY s DESC, doc_id) <= 10)
SELECT doc_id, round(max(s), 6) AS score FROM l GROUP BY 1 ORDER BY max(s) DESC, doc_id LIMIT 10""")
def lexical_topk(t):
    return sr.lexical(t.documents, "doc_id", "text", ASK, 10).withColumn("score", F.round("score", 6))


# the index is made over the whole table and asked afterwards; ties go by the text's digest
def _index_sql(fields: dict[str, tuple[str, str]]) -> str:
    parts = " UNION ALL ".join(f"SELECT sha256(text) AS text_id, '{name}' AS field, {expr} AS w, {asked} AS q FROM d" for name, (expr, asked) in fields.items())
    return f"""WITH d AS (SELECT text, {WORDS} AS w, list_distinct(regexp_split_to_array('{ASK}', ' ')) AS asked FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
f AS ({parts}), z AS (SELECT field, count(*) AS n, avg(len(w)) AS mean FROM f GROUP BY 1),
p AS (SELECT text_id, field, len(w) AS len, q AS term, len(list_filter(w, lambda x: x = q)) AS tf FROM (SELECT text_id, field, w, unnest(list_distinct(q)) AS q FROM f)),
h AS (SELECT field, term, count(*) AS df FROM p WHERE tf > 0 GROUP BY ALL),
s AS (SELECT text_id, field, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS s FROM p JOIN h USING (field, term) JOIN z USING (field) WHERE tf > 0 GROUP BY ALL),
b AS (SELECT text_id, max(s) AS score FROM s GROUP BY 1 ORDER BY round(max(s), 9) DESC, text_id LIMIT 10)
SELECT b.text_id, (SELECT min(doc_id) FROM documents WHERE sha256(text) = b.text_id) AS id, (SELECT count(*) FROM documents WHERE sha256(text) = b.text_id) AS count, round(score, 6) AS score FROM b"""


def _asked_index(t, fields):
    index = ti.TextIndex(t.spark, scratch_path(t.spark, "text-index")).build(t.documents, "doc_id", "text", fields)
    return index.search(ASK, 10, fields).withColumn("score", F.round("score", 6))


@query("SR1 A25 X7", _index_sql({"words": ("w", "asked")}))
def indexed_search(t):
    return _asked_index(t, {"words": ti.plain_words})


@query("F18 SR1 A25", _index_sql({"words": ("w", "asked"), "stems": (_STEM.format("w"), _STEM.format("asked"))}))
def indexed_search_fields(t):
    return _asked_index(t, ti.FIELDS)


@query("SR2", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, e), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS score FROM embeddings, q
ORDER BY list_sum(list_transform(list_zip(embedding, e), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) DESC, vec_id LIMIT 10""")
def vector_topk(t):
    q = t.embeddings.where("vec_id = 0").first()["embedding"]
    return sr.vector_top(t.embeddings, "vec_id", "embedding", q, 10).withColumn("score", F.round("score", 6))


@query("SR2", """WITH q AS (SELECT 'q' || vec_id AS query, embedding AS e FROM embeddings WHERE vec_id IN (1, 2, 3)),
s AS (SELECT query, vec_id, list_sum(list_transform(list_zip(embedding, e), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS score FROM embeddings, q)
SELECT query, vec_id, rank FROM (SELECT query, vec_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5""")
def vector_topk_many(t):
    asked = {f"q{r['vec_id']}": [float(x) for x in r["embedding"]] for r in t.embeddings.where("vec_id IN (1, 2, 3)").collect()}
    return sr.vector_top_many(t.embeddings, "vec_id", "embedding", asked, 5).select("query", "vec_id", "rank")


@query("SR3 D5")
def hybrid_topk(t):
    docs = t.spread("documents", "doc_id", "text")
    k = sr.list_size(10)
    words = sr.lexical(docs, "doc_id", "text", ASK, k)
    meaning = sr.hashed_top(docs, "doc_id", "text", ASK, k)
    return sr.hybrid(words, meaning, "doc_id", 10)


_DOT = "list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
_COUNTED = f"""b AS (SELECT doc_id, len(w) AS len, {_TF} FROM (SELECT doc_id, {WORDS} AS w FROM documents)), s AS (SELECT count(*) AS n, avg(len) AS avg, {_DF} FROM b)"""


@query("SR3 SR1 SR2", f"""WITH {_COUNTED},
w AS (SELECT doc_id, {_SCORE} AS s FROM b, s WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(_TERMS)))} ORDER BY 2 DESC, 1 LIMIT 10),
m AS (SELECT v.vec_id AS doc_id, {_DOT} AS s FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY 2 DESC, 1 LIMIT 10),
x AS (SELECT doc_id, CASE WHEN max(s) OVER () = min(s) OVER () THEN 1 ELSE (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) END AS w FROM w),
y AS (SELECT doc_id, CASE WHEN max(s) OVER () = min(s) OVER () THEN 1 ELSE (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) END AS m FROM m)
SELECT doc_id, round(0.3 * coalesce(w, 0) + 0.7 * coalesce(m, 0), 6) AS score FROM x FULL JOIN y USING (doc_id) ORDER BY 0.3 * coalesce(w, 0) + 0.7 * coalesce(m, 0) DESC, doc_id LIMIT 5""")
def hybrid_merge(t):
    words = sr.bm25(t.documents, "doc_id", "text", ASK, 10)
    q = t.embeddings.where("vec_id = 0").first()["embedding"]
    meaning = sr.vector_top(t.embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", q, 10)
    return sr.hybrid(words, meaning, "doc_id", 5).withColumn("score", F.round("score", 6))


def _one_term(i: int) -> str:
    return f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avg))"


_LISTS = " UNION ALL ".join(f"(SELECT 'q{i}' AS query, doc_id AS id, {_one_term(i)} AS s FROM b, s WHERE tf{i} > 0 ORDER BY 3 DESC, 2 LIMIT 50)" for i in range(len(_TERMS)))
_SPAN = "CASE WHEN max(s) OVER p = min(s) OVER p THEN 1 ELSE (s - min(s) OVER p) / (max(s) OVER p - min(s) OVER p) END"


# question i is a word and the vector of row i; targets are the twenty rows nearest in meaning
@query("SR4 W11 O5 SR2 SR3", f"""WITH {_COUNTED}, lex AS ({_LISTS}),
sem AS (SELECT 'q' || q.vec_id AS query, v.vec_id AS id, {_DOT} AS s FROM embeddings v, (SELECT vec_id, embedding FROM embeddings WHERE vec_id < 5) q
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, v.vec_id) <= 50),
x AS (SELECT query, id, {_SPAN} AS w FROM lex WINDOW p AS (PARTITION BY query)), y AS (SELECT query, id, {_SPAN} AS m FROM sem WINDOW p AS (PARTITION BY query)),
h AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY 0.3 * coalesce(w, 0) + 0.7 * coalesce(m, 0) DESC, id) AS hybrid_rank FROM x FULL JOIN y USING (query, id)),
l AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS lexical_rank, count(*) OVER (PARTITION BY query) AS hits FROM lex),
t AS (SELECT query, id FROM sem QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, id) <= 20)
SELECT query, id, CAST(hybrid_rank AS INTEGER) AS hybrid_rank, CAST(coalesce(lexical_rank, -1) AS INTEGER) AS lexical_rank FROM t JOIN h USING (query, id) LEFT JOIN l USING (query, id)
WHERE hybrid_rank <= 5 AND (lexical_rank IS NULL OR lexical_rank >= hybrid_rank + 3)""")
def searches_that_show(t):
    counts = cut_lineage(sr.word_counts(t.documents, "doc_id", "text", {f"q{i}": ([w], False) for i, w in enumerate(_TERMS)}), "words")
    vectors = t.embeddings.withColumnRenamed("vec_id", "doc_id")
    asked = {f"q{r['vec_id']}": [float(x) for x in r["embedding"]] for r in t.embeddings.where("vec_id < 5").collect()}
    lists = {q: (sr.words_only(counts, "doc_id", q, 50), sr.vector_top(vectors, "doc_id", "embedding", v, 50)) for q, v in sorted(asked.items())}
    named = lambda df, q: df.select(F.lit(q).alias("query"), F.col("doc_id").alias("id"), "score")
    union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    lexical = sr.ranked(union([named(w, q) for q, (w, _) in lists.items()]), ["query"])
    meaning = sr.ranked(union([named(m, q) for q, (_, m) in lists.items()]), ["query"])
    mixed = sr.ranked(union([named(sr.hybrid(w, m, "doc_id", 100), q) for q, (w, m) in lists.items()]), ["query"])
    proven = sr.finds_target(meaning.where("rank <= 20").select("query", "id"), lexical, mixed)
    return proven.select("query", "id", "hybrid_rank", F.coalesce("lexical_rank", F.lit(-1)).alias("lexical_rank"))


@query("SR6", """WITH j AS (SELECT 'q' || (doc_id % 20) AS query, doc_id, quality * 1.0 AS rating, CAST(row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id) AS INTEGER) AS rank FROM labels),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rating DESC, rank) AS ideal, sum(CASE WHEN rank <= 10 AND rating >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY query ORDER BY rank ROWS UNBOUNDED PRECEDING) AS good FROM j)
SELECT query, round(sum(CASE WHEN rank <= 10 THEN (pow(2, rating) - 1) / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN ideal <= 10 THEN (pow(2, rating) - 1) / log2(ideal + 1) ELSE 0 END), 6) AS ndcg,
round(count(*) FILTER (WHERE rank <= 10 AND rating >= 0.5) / count(*) FILTER (WHERE rank <= 10), 6) AS precision,
round(sum(CASE WHEN rank <= 10 AND rating >= 0.5 THEN good / rank ELSE 0 END) / count(*) FILTER (WHERE rating >= 0.5), 6) AS average_precision FROM k GROUP BY 1""")
def relevance_metrics(t):
    ranked = sr.ranked(t.labels.select(F.concat(F.lit("q"), (F.col("doc_id") % 20).cast("string")).alias("query"), F.col("doc_id").alias("id"),
                                       F.col("quality").cast("double").alias("rating"), (-F.col("doc_id")).cast("double").alias("score")), ["query"])
    return sr.relevance(ranked.select("query", "rank", "rating")).select("query", *[F.round(c, 6).alias(c) for c in ("ndcg", "precision", "average_precision")])


@query("N5 N6", "SELECT p_partkey, upper(p_name) AS spaced FROM part")
def readable_codes(t):
    code = F.concat(F.regexp_replace(F.upper("p_name"), " ", "_"), F.lit(""))
    return t.part.select("p_partkey", tx.readable(code).alias("spaced"))


@query("N6 SR7", "SELECT CASE WHEN 2 * count(*) FILTER (WHERE len(string_split(p_name, ' ')) >= 2) >= count(*) THEN 1 ELSE 0 END AS phrases, 0 AS codes FROM part")
def phrase_share(t):
    return t.part.agg(tx.share_at_least_half(tx.is_phrase(F.col("p_name")), F.col("p_name")).cast("int").alias("phrases"),
                      tx.share_at_least_half(tx.is_worded_code(F.col("p_type")), F.col("p_type")).cast("int").alias("codes"))


@query("N4", """SELECT doc_id, trim(regexp_replace(regexp_replace(translate(lower(text), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy'), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g')) AS folded
FROM documents""".replace("AS folded", "AS f").replace("SELECT doc_id,", "SELECT doc_id, md5(") .replace(" AS f\n", ") AS digest\n"))
def folded_texts(t):
    return t.spread("documents", "doc_id", "text").select("doc_id", F.md5(tx.fold(F.col("text"))).alias("digest"))


# a theme for every last word of a part name; proposals that repeat one, or have too few forms, go
@query("SR5 SR8 U4", """WITH n AS (SELECT p_name AS text, string_split(p_name, ' ')[-1] AS theme, count(*) FILTER (WHERE p_size > 20) AS large, avg(p_size) AS mean FROM part GROUP BY 1)
SELECT theme, CAST(count(*) FILTER (WHERE large >= 3) AS INTEGER) AS by_meaning, CAST(count(*) FILTER (WHERE mean > 25.5) AS INTEGER) AS by_words FROM n GROUP BY 1
HAVING count(*) >= 3 AND count(*) FILTER (WHERE large >= 3) >= 3 AND count(*) FILTER (WHERE large >= 3) - count(*) FILTER (WHERE mean > 25.5) >= 2""")
def theme_coverage(t):
    theme = F.element_at(F.split("p_name", " "), -1)
    names = t.part.groupBy(F.col("p_name").alias("text"), theme.alias("theme")).agg(F.count_if(F.col("p_size") > 20).alias("large"), F.avg("p_size").alias("mean"))
    lists = names.groupBy("theme").agg(F.array_sort(F.collect_list("text")).alias("forms"))
    repeats = lists.select(F.concat(F.lit("~ "), "theme").alias("theme"), F.slice("forms", 1, 3).alias("forms"))
    few = lists.select(F.concat(F.lit("  "), "theme").alias("theme"), F.array(F.get("forms", F.lit(0)), F.concat(F.get("forms", F.lit(0)), F.lit(", spare")), F.lit("no such part")).alias("forms"))
    valid = sr.valid_themes(lists.unionByName(repeats).unionByName(few), names.select("text"))
    forms = valid.select("theme", F.explode("forms").alias("text"))
    found = sr.theme_coverage(forms, names.where("large >= 3").select("theme", F.concat("text", F.lit(", control")).alias("text")), names.where("mean > 25.5").select("theme", "text"))
    return found.select("theme", F.col("by_meaning").cast("int").alias("by_meaning"), F.col("by_words").cast("int").alias("by_words"))
