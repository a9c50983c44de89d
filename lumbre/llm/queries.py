"""Named queries of the operators, each next to its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.llm import (conversations, decontamination, fingerprints, impact_index, jaccard, language_model, negatives, packing, phrases, quality, substrings,
                        toxicity, urls)
from lumbre.session import configure, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, base: str) -> DataFrame:
            return fn(configure(spark), base)
        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql.strip()
        return fn
    return add


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op3_packing(spark, base):
    pieces = packing.pack(table(spark, base, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{WORD}'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{WORD}') AS w FROM benchmark),
size AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
item AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM size, unnest(range(1, len(w) - k + 2)) AS t(i)),
widths AS (SELECT DISTINCT k FROM item),
hit AS (SELECT d.doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, widths, unnest(range(1, len(w) - k + 2)) AS t(i)
        WHERE array_to_string(w[i:i + k - 1], ' ') IN (SELECT g FROM item WHERE item.k = widths.k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM hit, unnest(range(i, i + k)) AS t(p) GROUP BY 1),
items AS (SELECT DISTINCT doc_id, item_id FROM hit JOIN item USING (k, g)),
named AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM items GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)""")
def op5_benchmark_decontamination(spark, base):
    docs = table(spark, base, "documents").select("doc_id", "text")
    found = decontamination.contaminated(docs, table(spark, base, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


@query(r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>'), ':' || chr(10), '\:' || chr(10)) AS esc FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
       CAST(sum(length(role) + length(esc) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""")
def op9_chat_formatting(spark, base):
    rows = table(spark, base, "conversations").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    events = rows.unionByName(more).withColumns({"kind": F.lit("message"), "msg_id": F.lit(None).cast("string")})
    return conversations.digest(conversations.render(conversations.fold(events, sequence="turn")))


_SPACED = r"[^\x20\x09-\x0D]+"


@query(rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_SPACED}'), []) AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS t(i)),
r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM g WHERE h IN (SELECT h FROM r))),
per AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY 1),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(ps), 0) AS m, list_filter(w, lambda x, i: NOT coalesce(list_contains(ps, i), false)) AS kept FROM d LEFT JOIN per USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""")
def op4_substring_dedup(spark, base):
    marked = substrings.mark_repeats(table(spark, base, "documents").select("doc_id", "text"))
    return marked.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query(rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_SPACED}'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM d, unnest(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""")
def op7_ngram_jaccard_join(spark, base):
    return jaccard.near_duplicates(table(spark, base, "documents").select("doc_id", "text"))


def held_out(column: str = "doc_id", parts: int = 3, part: int = 1):
    """Whether the row is kept back from learning: crc32 of the key as text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string")) % parts == part


@query()
def op2_toxicity(spark, base):
    docs = table(spark, base, "documents").select("doc_id", "text")
    labels = table(spark, base, "labels").where(~held_out())
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query()
def op8_quality_classifier(spark, base):
    docs = table(spark, base, "documents").select("doc_id", "text")
    labels = table(spark, base, "labels").where(~held_out())
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def _url_sql(depth: int = 10) -> str:
    """The same rules and the same tree, a few common tables for each level; paths of the test tables are not as deep."""
    fits = [(r, v, f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')") for r, v in sorted(RULES, key=lambda x: -len(x[0]))]
    rule, verdict = (f"CASE {' '.join(f"WHEN {c} THEN '{x[k]}'" for *x, c in fits)} END" for k in (0, 1))
    out = [rf"""u AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, {_LOWER.replace('text', "regexp_extract(rest, '^[^/?#]*')", 1)} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
bad AS (SELECT doc_id, max(CAST(quality = 0 OR toxic = 1 AS BIGINT)) AS bad FROM labels GROUP BY 1),
w AS (SELECT v.*, bad, regexp_replace(path, '[0-9]+', '<n>', 'g') AS wild FROM v LEFT JOIN bad ON doc_id = TRY_CAST(regexp_extract(path, '([0-9]{{1,18}})[^0-9/]*/?$', 1) AS BIGINT)),
q0 AS (SELECT host, regexp_replace(wild, '^/', '') AS shape, '' AS node, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM w GROUP BY 1, 2)"""]
    for k in range(depth):
        piece = f"split_part(shape, '/', {k + 1})"
        out.append(f"""s{k} AS (SELECT *, CASE WHEN len(string_split(shape, '/')) > {k} THEN {piece} ELSE '$' END AS seg FROM q{k}),
c{k} AS (SELECT host, node, seg, sum(n) AS n, sum(labelled) AS l, sum(bad) AS b FROM s{k} GROUP BY ALL),
z{k} AS (SELECT *, (sum(b) OVER p + 0.5) / (sum(l) OVER p + 1) AS r FROM c{k} WINDOW p AS (PARTITION BY host, node)),
a{k} AS (SELECT host, node, seg FROM z{k} WHERE seg <> '$' AND n >= 5 AND abs(b - l * r) / sqrt(greatest(l, 1) * r * (1 - r)) >= 2.58),
q{k + 1} AS (SELECT host, shape, node || CASE WHEN seg = '$' THEN '' WHEN (host, node, seg) IN (SELECT (host, node, seg) FROM a{k}) THEN '/' || seg ELSE '/*' END AS node, n, labelled, bad FROM s{k})""")
    out.append(f"""g AS (SELECT (coalesce(sum(bad), 0) + 1.0) / (coalesce(sum(labelled), 0) + 2.0) AS g FROM q{depth}),
h AS (SELECT host, sum(labelled) AS hl, sum(bad) AS hb FROM q{depth} GROUP BY 1),
f AS (SELECT host, node, 1 - (sum(bad) + 5 * (any_value(hb) + 5 * any_value(g)) / (any_value(hl) + 5)) / (sum(labelled) + 5) AS purity FROM q{depth} JOIN h USING (host), g GROUP BY 1, 2),
t AS (SELECT host, shape, purity FROM q{depth} JOIN f USING (host, node))""")
    return f"""WITH {', '.join(out)}
SELECT page_id, w.host, path, {rule.replace('host', 'w.host')} AS rule, coalesce({verdict.replace('host', 'w.host')}, CASE WHEN purity < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM w LEFT JOIN t ON t.host = w.host AND t.shape = regexp_replace(wild, '^/', '')"""


# paths here hold no UUIDs or hexadecimal strings, so the SQL has the wildcard of numbers alone
@query(_url_sql())
def op1_url_filters(spark, base):
    # a page's label is that of the document its path ends with: bad if of low quality or toxic
    pages = table(spark, base, "pages").select("page_id", "url")
    _, path = urls.host_and_path(F.col("url"))
    pages = pages.withColumn("doc_id", F.regexp_extract(path, r"([0-9]{1,18})[^0-9/]*/?$", 1).try_cast("long"))
    bad = table(spark, base, "labels").groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("long")).alias("bad"))
    judged = urls.judge(pages.join(bad, "doc_id", "left").drop("doc_id"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query()
def op10_document_fingerprints(spark, base):
    return fingerprints.compare_with_next(table(spark, base, "documents").select("doc_id", "text"))


_TOKENS = rf"list_concat(coalesce(regexp_extract_all({_LOWER}, '{_SPACED}'), []), ['\n'])"


@query()
def op6_lm_scoring(spark, base):
    docs = table(spark, base, "documents").select("doc_id", "text")
    return language_model.score(docs, ~held_out(parts=7, part=2))


_VECTORS = """
WITH v AS (SELECT vec_id, label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)"""


@query(rf"""{_VECTORS},
l AS (SELECT vec_id, e, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM v WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM l a, l c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
""")
def op12_hard_negatives(spark, base):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, base, "embeddings"), label, F.col("id") % 100 == 0)


@query(rf"""{_VECTORS}
SELECT q.vec_id AS query_id, (row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id))::INT AS rank,
  c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id QUALIFY rank <= 5
""")
def op13_exact_topk(spark, base):
    return impact_index.topk(table(spark, base, "embeddings"), F.col("id") % 50 == 0)


@query(r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
size AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM w, range(1, 4) AS t(k), unnest(range(1, len(w) - k + 2)) AS u(i) GROUP BY ALL),
c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 10),
cut AS (SELECT c.lang, c.size, phrase, a, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest FROM c, range(1, 3) AS t(k) WHERE k < c.size),
s AS (SELECT cut.lang, cut.size, cut.phrase, a, cut.k, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut JOIN g x ON x.lang = cut.lang AND x.phrase = head AND x.k = cut.k JOIN g y ON y.lang = cut.lang AND y.phrase = rest AND y.k = cut.size - cut.k),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE size = 3) GROUP BY ALL)
SELECT m.lang, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, m.phrase) AS rank, m.phrase, a, l, r, n, score
FROM m JOIN size USING (lang) LEFT JOIN inside ON inside.lang = m.lang AND inside.phrase = m.phrase
WHERE longer IS NULL OR 100 * longer < 50 * a QUALIFY rank <= 2000
""")
def op11_phrase_collocations(spark, base):
    return phrases.collocations(table(spark, base, "documents"))
