"""I-Match fingerprints of texts, in DataFrame operations alone.

The lexicon holds the terms whose share of documents lies in a band of inverse document frequency.  It has random
subsets of three sizes; of each, the distinct terms of a text in it are sorted and hashed.  The fingerprint is the list of
these hashes.  A change to a text changes the hashes of those subsets alone that hold a term which came or went, so the
share of equal ones measures likeness; small subsets serve long texts and large ones short texts.  The terms of a text
outside the band have random subsets of their own, which count where a text has hardly any term in the band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbre.session import cut_lineage

#: (a subset holds one term in so many, number of subsets)
SUBSETS = ((16, 16), (128, 24), (1024, 24))
#: the same for the terms outside the lexicon
OWN = ((8, 8), (64, 12), (512, 12))
EMPTY = "...."


def terms(text: Column) -> Column:
    """Distinct terms: runs of letters and digits, lower-cased."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def lexicon(docs: DataFrame, text: str = "text", low: float = 0.001, high: float = 0.1) -> DataFrame:
    """(``term`` as a hash, ``subset``) for terms in ``low`` to ``high`` of all different texts, once for each subset that holds them.

    Its size is bounded at any corpus size: a term takes at least ``low`` of the texts, so there are at most 1 / ``low`` times as many
    terms as a text has on average.
    """
    total = docs.select(F.xxhash64(text).alias("b")).distinct().count()
    seen = docs.select(text).distinct().select(F.explode(terms(F.col(text))).alias("w")).select(F.xxhash64("w").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    kept = seen.where((F.col("df") >= low * total) & (F.col("df") <= max(high * total, 2)))
    return cut_lineage(kept.select("term", F.explode(_places(SUBSETS, 0)).alias("subset")), "lexicon")


def _places(subsets, first: int) -> Column:
    """The subsets, numbered from ``first``, that hold ``term``."""
    places = []
    for every, count in subsets:
        place = F.pmod(F.xxhash64("term", F.lit(every)), F.lit(every)).cast("int")
        places.append(F.when(place < count, place + first))
        first += count
    return F.array_compact(F.array(*places))


def _joined(signatures: Column) -> Column:
    """The fingerprint out of a map from subset to hash."""
    n = sum(count for _, count in SUBSETS + OWN)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at(signatures, i), F.lit(EMPTY))), "")


def fingerprint(rows: DataFrame, known: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """``rows`` with ``fingerprint_<text>`` for each of the columns ``texts``; ``keys`` (never null) tell rows apart and partition them: a join or grouping by them moves no text.

    The hashes of the lexicon's subsets come first, then those of the subsets of other terms.  A text without terms (null, empty,
    odd) has the hash of its whole text after ``~`` as fingerprint.
    """
    which = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), terms(F.coalesce(F.col(t), F.lit(""))).alias("terms")) for i, t in enumerate(texts)]))
    held = rows.select(*keys, which.alias("x")).select(*keys, "x.which", F.explode("x.terms").alias("w")).select(*keys, "which", F.xxhash64("w").alias("term"))
    held = held.join(F.broadcast(known), "term", "left")  # bounded, see lexicon()
    own = _places(OWN, sum(count for _, count in SUBSETS))
    held = held.select(*keys, "which", "term", F.explode(F.when(F.col("subset").isNotNull(), F.array("subset")).otherwise(own)).alias("subset"))
    sign = F.lpad(F.right(F.hex(F.xxhash64(F.array_sort(F.collect_set("term")))), F.lit(4)), 4, "0")
    signed = held.groupBy(*keys, "which", "subset").agg(sign.alias("sign"))
    per = signed.groupBy(*keys).agg(*[F.map_from_entries(F.collect_list(F.when(F.col("which") == i, F.struct("subset", "sign")))).alias(f"m{i}") for i in range(len(texts))])
    per = per.withColumnsRenamed({k: f"own_{k}" for k in keys})
    out = rows.join(per, [F.col(k) == F.col(f"own_{k}") for k in keys], "left").drop(*[f"own_{k}" for k in keys])
    for i, t in enumerate(texts):
        plain = F.concat(F.lit("~"), F.md5(F.coalesce(F.col(t), F.lit(""))))
        out = out.withColumn(f"fingerprint_{t}", F.when(F.size(F.coalesce(f"m{i}", F.create_map())) > 0, _joined(F.col(f"m{i}"))).otherwise(plain))
    return out.drop(*[f"m{i}" for i in range(len(texts))])


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: of the subset size at which the two agree most, the share of equal hashes among the subsets that hold a term of either.

    A size counts if three subsets or more hold a term, or if no size has three.  If one of the two has terms in fewer than three of the
    lexicon's largest subsets, the subsets of other terms count beside the lexicon's.  Equal fingerprints alone have likeness 1; a
    fingerprint of a text without terms is like its equal alone.
    """
    def compared(first: int, count: int) -> Column:
        """Subsets that hold a term of either, of ``a``, of ``b``, and equal ones."""
        def add(s: Column, i: Column) -> Column:
            x, y = F.substring(a, i * 4 + 1, 4), F.substring(b, i * 4 + 1, 4)
            one = lambda c: F.when(c, 1).otherwise(0)
            return F.struct((s["n"] + one((x != EMPTY) | (y != EMPTY))).alias("n"), (s["a"] + one(x != EMPTY)).alias("a"), (s["b"] + one(y != EMPTY)).alias("b"),
                            (s["same"] + one((x == y) & (x != EMPTY))).alias("same"))
        return F.aggregate(F.sequence(F.lit(first), F.lit(first + count - 1)), F.struct(*[F.lit(0).alias(c) for c in ("n", "a", "b", "same")]), add)

    def agreed(sizes: list[tuple[Column, Column]]) -> Column:
        firm = F.greatest(*[F.when(n >= 3, same / n) for n, same in sizes])
        weak = F.greatest(*[F.when(n > 0, same / n) for n, same in sizes])
        return F.coalesce(firm, weak, F.lit(0.0))

    parts, first = [], 0
    for _, count in SUBSETS + OWN:
        parts.append(compared(first, count))
        first += count
    lexical, other = parts[:len(SUBSETS)], parts[len(SUBSETS):]
    thin = F.least(lexical[0]["a"], lexical[0]["b"]) < 3
    share = F.when(thin, agreed([(x["n"] + y["n"], x["same"] + y["same"]) for x, y in zip(lexical, other)])).otherwise(agreed([(x["n"], x["same"]) for x in lexical]))
    odd = F.startswith(a, F.lit("~")) | F.startswith(b, F.lit("~"))
    return F.when(a == b, 1.0).when(odd, 0.0).otherwise(F.least(share, F.lit(0.999))).cast("double")


def followers(ids: DataFrame, key: str, tie: str) -> DataFrame:
    """Distinct rows of ``ids`` with the next one's key and tie (``next_...``) in ascending order, after the last the first; nulls come first.

    Rows are dealt by ranges of the key, and one row per range ties the ranges together.
    """
    order = F.struct(F.col(key).isNotNull().alias("some"), F.col(key).alias("key"), F.col(tie).alias("tie"))
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in ids.columns if c not in (key, tie)]
    dealt = cut_lineage(ids.distinct().repartitionByRange(n, F.col(key).asc_nulls_first()).withColumn("range", F.spark_partition_id()), "order")
    firsts = dealt.groupBy("range").agg(F.min(order).alias("first"))
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(Window.orderBy("range")), F.min("first").over(Window.partitionBy())).alias("after"))
    row = dealt.withColumn("following", F.lead(order).over(Window.partitionBy("range").orderBy(F.col(key).asc_nulls_first(), tie)))
    row = row.join(firsts, "range").withColumn("following", F.coalesce("following", "after"))
    return row.select(key, tie, *rest, F.col("following.key").alias(f"next_{key}"), F.col("following.tie").alias(f"next_{tie}"))


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", low: float = 0.001, high: float = 0.1) -> DataFrame:
    """``key``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next`` of every row.

    The edited text has its last quarter (``n_chars`` / 4 code points, rounded down) replaced by the first as many of the next
    document's (by ``key``; rows of one key by a hash of the text), or all of it if shorter.  A null text is empty; equal rows count
    as one document in the order and have equal results; the only document of a table is its own next.
    """
    # two hashes tell documents apart; equal rows share them
    d = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    d = d.select("key", F.xxhash64(F.col("key").isNull(), "key").alias("a"), F.xxhash64("text").alias("b"), "text")
    known = lexicon(d, "text", low, high)
    chain = followers(d.select("key", "b", F.char_length("text").alias("n")), "key", "b")
    need = cut_lineage(chain.select(*[F.xxhash64(F.col(k).isNull(), k).alias(n) for k, n in (("key", "to_a"), ("next_key", "a"))], F.col("b").alias("to_b"), F.col("next_b").alias("b"),
                                    F.floor(F.col("n") / 4).cast("int").alias("quarter")), "chain")
    lent = d.select("a", "b", "text").join(need, ["a", "b"]).select("to_a", "to_b", "quarter", F.expr("left(text, quarter)").alias("lent"))
    lent = lent.groupBy(F.col("to_a").alias("a"), F.col("to_b").alias("b")).agg(F.max("quarter").alias("quarter"), F.max("lent").alias("lent"))
    edited = d.select("a", "b", "text").join(lent, ["a", "b"])
    edited = edited.select("a", "b", "text", F.concat(F.expr("left(text, char_length(text) - quarter)"), "lent").alias("edited"))
    made = fingerprint(edited, known, ["a", "b"], ["text", "edited"])
    made = cut_lineage(made.select("a", "b", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("fingerprint_text").alias("fingerprint"),
                                   F.col("fingerprint_edited").alias("edited_fingerprint")).dropDuplicates(["a", "b"]), "fingerprints")
    following = made.select("a", "b", F.col("fingerprint").alias("next")).join(need, ["a", "b"]).select(F.col("to_a").alias("a"), F.col("to_b").alias("b"), "next")
    out = made.join(following, ["a", "b"]).withColumns({"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("next"))})
    return d.select("key", "a", "b").join(out.drop("next"), ["a", "b"]).drop("a", "b").withColumnRenamed("key", key)
