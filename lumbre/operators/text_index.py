"""An inverted index over distinct texts, kept as tables, from which a question reads the postings of its own words alone.

``texts`` has a row for each distinct text with its number, how many rows have it and the least of their ids; ``postings`` has rows of
(field, term, numbers, tfs, lengths): a term's texts among those that one task read together, so that a word is told once for many texts.
They lie in folders by a hash of the term, sorted by term inside, so that a question prunes folders and skips row groups; a frequent
term's rows are spread over slices.  ``fields`` has the number of texts and their mean length.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumbre.functions.text import spaced_words, stemmed
from lumbre.operators.search import B, K1

#: texts for which a folder gets one more slice, so what a task sorts and writes does not grow with their number
SLICE_TEXTS = 200_000
#: bytes of words that a task takes together
BLOCK_BYTES = 16 << 20
LISTS = "field string, term string, numbers array<bigint>, tfs array<int>, lengths array<int>, words bigint"


def plain_words(text: Column) -> Column:
    return F.filter(F.split(F.trim(spaced_words(text)), " +"), lambda w: w != "")


def stems(text: Column) -> Column:
    return F.filter(F.split(F.trim(stemmed(spaced_words(text))), " +"), lambda w: w != "")


#: a field of the index: the words of the text as they are, or their stems
FIELDS: dict[str, Callable[[Column], Column]] = {"words": plain_words, "stems": stems}


@dataclass
class TextIndex:
    spark: SparkSession
    path: str
    buckets: int = 64

    def build(self, docs: DataFrame, id_column: str, text: str, fields: dict[str, Callable[[Column], Column]] | None = None) -> TextIndex:
        """Write the index of ``docs``: null texts have no part; texts are distinct by their characters."""
        fields = fields or FIELDS
        rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(id_column).alias("id"))
        texts = rows.groupBy("text").agg(F.count(F.lit(1)).alias("count"), F.min("id").alias("id"))
        texts.withColumns({"text_id": F.sha2("text", 256), "number": F.monotonically_increasing_id()}).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/texts")
        texts = self.texts()
        n = texts.count()
        slices = max(1, math.ceil(n / SLICE_TEXTS))
        split = texts.select("number", *[words_of(F.col("text")).alias(name) for name, words_of in fields.items()])
        # a text's words are counted where it is read; a term's lists meet in its folder, slice by slice
        lists = split.mapInArrow(_term_lists(list(fields)), LISTS)
        placed = lists.withColumns({"bucket": self._bucket(F.col("term")), "_slice": F.pmod(F.xxhash64("term", F.get("numbers", F.lit(0))), F.lit(slices))})
        placed = placed.repartition(self.buckets * slices, "bucket", "_slice") if slices > 1 else placed.repartition("bucket")
        placed.drop("_slice").sortWithinPartitions("bucket", "term").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/postings")
        held = self._lists().groupBy("field").agg(F.sum("words").alias("words"))
        names = self.spark.createDataFrame([(name,) for name in fields], "field string")
        sizes = names.join(held, "field", "left").select("field", F.lit(n).cast("bigint").alias("texts"), F.try_divide(F.coalesce("words", F.lit(0)), F.lit(n)).alias("mean"))
        sizes.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/fields")
        return self

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")

    def _lists(self) -> DataFrame:
        return self.spark.read.schema(f"{LISTS}, bucket int").parquet(f"{self.path}/postings")

    def lists(self, terms: dict[str, list[str]]) -> DataFrame:
        """Lists of the given words of each field: folders and row groups without them are not read."""
        asked = sorted({w for words in terms.values() for w in words})
        rows = self._lists()
        if not asked:
            return rows.limit(0)
        folders = sorted({r[0] for r in self.spark.createDataFrame([(w,) for w in asked], "term string").select(self._bucket(F.col("term"))).collect()})
        fits = F.lit(False)
        for field, words in terms.items():
            fits = fits | ((F.col("field") == field) & F.col("term").isin(*words)) if words else fits
        return rows.where(F.col("bucket").isin(*folders) & F.col("term").isin(*asked) & fits)

    def postings(self, terms: dict[str, list[str]]) -> DataFrame:
        """(field, term, number, tf, length) of the given words of each field, a row for each text that has the word."""
        each = F.explode(F.arrays_zip("numbers", "tfs", "lengths")).alias("p")
        return self.lists(terms).select("field", "term", each).select("field", "term", F.col("p.numbers").alias("number"), F.col("p.tfs").alias("tf"), F.col("p.lengths").alias("length"))

    def terms(self, question: str, fields: dict[str, Callable[[Column], Column]]) -> dict[str, list[str]]:
        """The question's different words as each field has them (one tiny row, evaluated while planning)."""
        row = self.spark.range(1).select(*[F.array_sort(F.array_distinct(f(F.lit(question)))).alias(name) for name, f in fields.items()]).first()
        return {name: list(row[name]) for name in fields}

    def scores(self, question: str, fields: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
        """(number, score): BM25 of every text that has a word of the question; of several fields the best one counts."""
        terms = self.terms(question, fields or FIELDS)
        sizes = F.broadcast(self.spark.read.parquet(f"{self.path}/fields"))  # a row for each field
        held = F.broadcast(self.lists(terms).groupBy("field", "term").agg(F.sum(F.size("numbers")).alias("df")))  # a row for each word of the question
        rows = self.postings(terms).join(held, ["field", "term"]).join(sizes, "field")
        idf = F.log(1 + (F.col("texts") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        return rows.groupBy("number", "field").agg(F.sum(part).alias("s")).groupBy("number").agg(F.max("s").alias("score"))

    def search(self, question: str, n: int = 5, fields: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
        """The ``n`` best texts: id (the least of the rows that have the text), count, score.  Scores equal to nine places tie: the smaller ``text_id`` first."""
        scored = self.scores(question, fields).withColumn("_s", F.round("score", 9))
        least = scored.orderBy(F.desc("_s")).limit(n).agg(F.min("_s")).scalar()
        shown = self.texts().join(scored.where(F.col("_s") >= least), "number")
        return shown.select("id", "count", "text_id", "score", "_s").orderBy(F.desc("_s"), "text_id").limit(n).drop("_s")


def _term_lists(names: list[str]):
    """Arrow batches of texts (number, a list of words for each field) to rows of ``LISTS``, a block of texts at a time."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def lists(block: pa.Table):
        number = block.column("number").combine_chunks().to_numpy()
        for name in names:
            words = block.column(name).combine_chunks()
            if isinstance(words, pa.ChunkedArray):
                words = pa.concat_arrays(words.chunks)
            terms = pc.list_flatten(words).dictionary_encode()
            if not len(terms):
                continue
            length = pc.list_value_length(words).to_numpy()
            place, tf = np.unique(terms.indices.to_numpy().astype(np.int64) * len(number) + pc.list_parent_indices(words).to_numpy(), return_counts=True)
            code, text = np.divmod(place, len(number))
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            ends = pa.array(np.r_[starts, len(code)].astype(np.int32))
            of = lambda values, kind: pa.ListArray.from_arrays(ends, pa.array(values, kind))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(starts), pa.string()), terms.dictionary.take(pa.array(code[starts])).cast(pa.string()), of(number[text], pa.int64()),
                 of(tf.astype(np.int32), pa.int32()), of(length[text].astype(np.int32), pa.int32()), pa.array(np.add.reduceat(tf, starts), pa.int64())],
                ["field", "term", "numbers", "tfs", "lengths", "words"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield from lists(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from lists(pa.Table.from_batches(held))
    return run
