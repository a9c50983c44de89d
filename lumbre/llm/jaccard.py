"""Documents whose sets of word shingles are alike, joined with signature trees.

Equal sets are one class.  Classes that may be alike are brought together first: linked sets share many of the smallest
shingle hashes, so the rarest of those (prefix filter over their counts in the corpus) meet in a key.  Connected keys make a
group, and a group, or a shard of it, is joined in one task by a signature tree: leaves are sets, every node holds the
OR of its bitmaps, the range of its set sizes and how many shingles share a bit at most.  Two trees are walked down
together; a pair of nodes goes on only if the largest overlap that its bitmaps allow reaches what its sizes ask for.
What remains is compared exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from lumbre.llm import scan, tally
from lumbre.llm.components import components
from lumbre.session import cut_lineage

#: smallest hashes of a set that take part in bringing sets together, and how many of them linked sets share at least
SKETCH, SHARED = 96, 40
#: sets compared in one task
SHARD = 2000
LEADERS = 4
FANOUT = 8
BITS = 1024


def shingle_sets(table: pa.Table, size: int):
    """(row, sorted distinct shingle hashes) of each text; fewer words than ``size`` are one shingle."""
    for words in scan.words(table.column("text"), scan.NOT_SPACE, lower=True):
        counts = words.counts()
        edges = np.concatenate([[0], np.cumsum(counts)])
        grams, _ = scan.windows(words.hashes, words.doc, size)
        for r in range(words.rows):
            a, b = edges[r], edges[r + 1]
            if b - a >= size:
                own = np.sort(grams[a:b - size + 1])
                own = own[np.append(True, own[1:] != own[:-1])]
            else:
                own = scan.run_hashes(words.hashes, np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64)
            yield words.first + r, own


def _classes(table: pa.Table, size: int):
    """Class id and size of each row, and the sets of the first row of each class."""
    ids, counts, first = [], [], {}
    for row, own in shingle_sets(table, size):
        name = hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None
        ids.append(name)
        counts.append(len(own))
        if name is not None and name not in first:
            first[name] = (row, own)
    return ids, counts, first


def needed(n: int, percent: int) -> int:
    """Sketch hashes that a set of ``n`` shingles shares at least with any set that it links with.

    Sets so small that both sketches hold all shingles share ``percent`` of theirs.  Of larger ones the smallest hashes of
    the union are a random sample of SKETCH, each in both sets with probability of at least ``percent``; at 80 per cent fewer
    than SHARED are common with probability below 1e-14.
    """
    whole = SKETCH * percent // 100
    if n <= whole:
        return max(1, -(-n * percent // 100))
    return max(1, min(n, SKETCH) * SHARED * percent // (SKETCH * 80))


class Tree:
    """Signature tree over sets: level 0 are the sets, each further level joins FANOUT nodes."""

    def __init__(self, sets: list[np.ndarray]):
        n = len(sets)
        self.sets, self.sizes = sets, np.array([len(s) for s in sets], np.int64)
        self.order = np.lexsort(([int(s[0]) for s in sets], self.sizes))
        owner = np.repeat(np.arange(n), self.sizes)
        bit = (np.concatenate(sets) % np.uint64(BITS)).astype(np.int64)
        table = np.zeros((n, BITS), bool)
        table[owner, bit] = True
        maps = np.packbits(table, axis=1).view(np.uint64)
        spare = self.sizes - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        o = self.order
        self.levels = [(maps[o], self.sizes[o], self.sizes[o], spare[o])]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, spare = self.levels[-1]
            cuts = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, cuts, axis=0), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(spare, cuts)))


def _possible(a, b, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets below the node pairs may link: overlap o needs 100 o >= percent * (sizes - o)."""
    keep = (b[1][j] * percent <= a[2][i] * 100) & (a[1][i] * percent <= b[2][j] * 100)
    i, j = i[keep], j[keep]
    common = np.bitwise_count(a[0][i] & b[0][j]).sum(axis=1).astype(np.int64) + np.minimum(a[3][i], b[3][j])
    keep[keep] = common * (100 + percent) >= percent * (a[1][i] + b[1][j])
    return keep


def candidate_pairs(left: Tree, right: Tree, percent: int, block: int = 100_000):
    """Pairs of sets that the trees cannot tell apart, as index arrays; a tree with itself gives each pair once."""
    same = left is right
    depth = max(len(left.levels), len(right.levels)) - 1
    stack = [(depth, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > block:
            half = len(i) // 2
            stack += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
            continue
        a, b = left.levels[min(level, len(left.levels) - 1)], right.levels[min(level, len(right.levels) - 1)]
        keep = _possible(a, b, i, j, percent)
        i, j = i[keep], j[keep]
        if level == 0:
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield left.order[i], right.order[j]
            continue
        grow = lambda x, tree: x[:, None] * FANOUT + np.arange(FANOUT) if level <= len(tree.levels) - 1 else x[:, None]
        ci, cj = grow(i, left), grow(j, right)
        ni, nj = len(left.levels[min(level - 1, len(left.levels) - 1)][1]), len(right.levels[min(level - 1, len(right.levels) - 1)][1])
        ii, jj = np.repeat(ci, cj.shape[1], axis=1).ravel(), np.tile(cj, (1, ci.shape[1])).ravel()
        ok = (ii < ni) & (jj < nj)
        if same:
            ok &= ii <= jj
        if ok.any():
            stack.append((level - 1, ii[ok], jj[ok]))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def spanning_links(sets: list[np.ndarray], visitors: list[np.ndarray], labels: list, percent: int) -> list[tuple[int, int]]:
    """Links between sets (numbers from 0; visitors follow the own ones) that join all that are linked.

    Equal labels are joined already.  Pairs of visitors are compared as well only with own sets.
    """
    n = len(sets)
    parent = np.arange(n + len(visitors))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    seen: dict = {}
    for k, label in enumerate(labels):
        if label is not None:
            parent[find(k)] = find(seen.setdefault(label, k))
    links = []

    def verify(pairs, a, b, shift):
        for i, j in pairs:
            roots = np.array([find(x) for x in range(len(parent))]) if len(i) > 50 else None
            if roots is not None:
                apart = roots[i] != roots[j + shift]
                i, j = i[apart], j[apart]
            for x, y in zip(i.tolist(), j.tolist()):
                rx, ry = find(x), find(y + shift)
                if rx != ry:
                    o = overlap(a[x], b[y])
                    if 100 * o >= percent * (len(a[x]) + len(b[y]) - o):
                        parent[max(rx, ry)] = min(rx, ry)
                        links.append((x, y + shift))

    if sets:
        tree = Tree(sets)
        if not visitors or labels == [None] * len(labels):
            verify(candidate_pairs(tree, tree, percent), sets, sets, 0)
        if visitors:
            verify(candidate_pairs(tree, Tree(visitors), percent), sets, visitors, n)
    return links


def joined(names: list[bytes], links: list[tuple[int, int]]) -> list[bytes]:
    """The smallest name each is joined with."""
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in links:
        x, y = find(x), find(y)
        if names[y] < names[x]:
            x, y = y, x
        parent[y] = x
    return [names[find(x)] for x in range(len(names))]


def link_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80,
                 rows_per_bucket: int = tally.ROWS_PER_BUCKET, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """Every row's (``key``, ``text_hash``, ``n_shingles``, ``class``), and the classes' (``node``, ``root``) where linked ones have one root."""
    d, n = tally.bucketed(docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")), "key", "text", rows_per_bucket)
    d = d.select("bucket", "key", F.xxhash64("text").alias("text_hash"), "text")
    sketches = lambda first: tally.unique(np.concatenate([s[:SKETCH] for _, s in first.values()]) if first else np.zeros(0, np.uint64))
    notes = tally.add_up(tally.send(d, lambda t: sketches(_classes(t, size)[2]), max(64, n // 4)))
    schema = StructType([StructField("key", docs.schema[key].dataType), StructField("text_hash", LongType()), StructField("n_shingles", LongType()), StructField("class", BinaryType()),
                         StructField("keys", ArrayType(LongType())), StructField("shingles", BinaryType())])
    arrow = to_arrow_schema(schema)

    def finish(table: pa.Table, totals: np.ndarray, _) -> pa.Table:
        if not table.num_rows:
            return arrow.empty_table()
        ids, counts, first = _classes(table, size)
        known, _ = sketches(first)
        keys, sets = [None] * len(ids), [None] * len(ids)
        for row, own in first.values():
            sketch, least = own[:SKETCH], needed(len(own), percent)
            total = totals[np.searchsorted(known, sketch)]
            if (total > 1).sum() >= least:
                rarest = np.lexsort((sketch, total))[:len(sketch) - least + 1]
                rarest = rarest[total[rarest] > 1]
                if len(rarest):
                    keys[row], sets[row] = sketch[rarest].view(np.int64).tolist(), own.tobytes()
        return pa.Table.from_arrays([table.column("key"), table.column("text_hash"), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())], schema=arrow)

    rows = cut_lineage(tally.deliver(d, notes, finish, schema), "classes")
    wanted = rows.where("keys IS NOT NULL")
    # classes that share a key
    held = wanted.select("class", F.explode("keys").alias("k")).distinct()
    leaders = held.groupBy("k").agg(F.min("class").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = components(held.join(leaders, "k").select("class", "leader"), "class", "leader")
    big = groups.groupBy("root").agg(F.count("*").alias("n")).withColumn("shards", F.ceil(F.col("n") / shard).cast("int"))
    # one set of each class of a group of several
    sets = wanted.select("class", "shingles").join(groups.withColumnRenamed("node", "class"), "class").groupBy("class", "root").agg(F.first("shingles").alias("shingles"))
    sets = cut_lineage(sets.join(big, "root").withColumn("shard", F.pmod(F.xxhash64("class"), F.col("shards"))), "sets")
    own = sets.select("root", "shard", "shards", F.lit(0).alias("block"), "class", "shingles", F.lit(None).cast("binary").alias("label"), F.lit(False).alias("visitor"))
    links = cut_lineage(_compare(own.unionByName(_leaders(sets)), percent), "links")
    # a group of one shard is done; shards of larger ones are tied together
    done, tied = links.where("NOT tied").select(F.col("b").alias("node"), F.col("a").alias("root")), links.where("tied").select("a", "b")
    if not sets.where("shards > 1").isEmpty():
        more = cut_lineage(_compare(_rest(sets, components(tied, "a", "b"), shard), percent), "links")
        done = done.unionByName(components(tied.unionByName(more.select("a", "b")), "a", "b"))
    return rows.drop("keys", "shingles"), done


def _leaders(sets: DataFrame) -> DataFrame:
    """A few sets of each group of several shards, sent to all of its shards, so that most links between shards are found at once."""
    many = sets.where("shards > 1")
    few = many.where(F.col("shard") < LEADERS).groupBy("root", "shard").agg(F.min("class").alias("class")).select("root", "class")
    return (many.drop("shard").join(few, ["root", "class"]).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("shards") - 1).cast("long"))))
            .select("root", "shard", "shards", F.lit(0).alias("block"), "class", "shingles", F.lit(None).cast("binary").alias("label"), F.lit(True).alias("visitor")))


def _rest(sets: DataFrame, joined: DataFrame, shard: int) -> DataFrame:
    """Groups of several shards again: sets outside a group's largest component visit all shards, in blocks.

    Two sets that are not joined yet are not both in the largest component, so one of them visits the other's shard.
    """
    many = sets.where("shards > 1").join(joined.withColumnRenamed("root", "label"), F.col("class") == F.col("node"), "left").drop("node").withColumn("label", F.coalesce("label", "class"))
    per = many.groupBy("root", "label").agg(F.count("*").alias("m"))
    main = per.groupBy("root").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("all"))
    main = main.select("root", F.col("top.label").alias("main"), F.ceil((F.col("all") - F.col("top.m")) / shard).cast("int").alias("blocks")).where("blocks > 0")
    many = cut_lineage(many.join(main, "root"), "rest")
    own = many.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    visit = (many.where("label <> main").withColumn("block", F.pmod(F.xxhash64("class", F.lit(1)), F.col("blocks")).cast("int"))
             .drop("shard").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("shards") - 1).cast("long")))))
    columns = lambda x, v: x.select("root", "shard", "shards", "block", "class", "shingles", "label", F.lit(v).alias("visitor"))
    return columns(own, False).unionByName(columns(visit, True))


def _compare(rows: DataFrame, percent: int) -> DataFrame:
    """What each task joins: stars (``a``, the first class; ``b``, another), and whether its group has other shards (``tied``)."""
    arrow = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("tied", pa.bool_())])

    def run(table: pa.Table) -> pa.Table:
        visitor = table.column("visitor").to_pylist()
        order = sorted(range(table.num_rows), key=lambda i: visitor[i])
        names, labels = table.column("class").to_pylist(), table.column("label").to_pylist()
        sets = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
        n = visitor.count(False)
        first = joined([names[i] for i in order], spanning_links([sets[i] for i in order[:n]], [sets[i] for i in order[n:]], [labels[i] for i in order], percent))
        stars = [(a, names[i]) for i, a in zip(order, first) if a != names[i]]
        return pa.table([pa.array([a for a, _ in stars], pa.binary()), pa.array([b for _, b in stars], pa.binary()), pa.array([table.column("shards")[0].as_py() > 1] * len(stars), pa.bool_())], schema=arrow)

    return rows.groupBy("root", "shard", "block").applyInArrow(run, "a binary, b binary, tied boolean")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """For each row ``key``, ``n_shingles`` and ``component_id`` (the smallest key reachable by links, its own included).

    Texts are lower-cased (A-Z); words are runs of characters other than space and tab to carriage return; a set holds the
    distinct shingles of ``size`` words, or the whole of fewer words.  Sets link when 100 * intersection >= percent * union.
    Rows without words (null, empty, blank) have an empty set and are linked with nothing.  Null keys are never the
    smallest; rows of one key are rows like others; equal rows are linked.
    """
    rows, roots = link_classes(docs, key, text, **options)
    least = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("key").alias("least"))
    named = least.join(roots, F.col("class") == F.col("node"), "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("class", "component_id")
    out = rows.join(named, "class", "left")
    return out.select(F.col("key").alias(key), "n_shingles", F.when(F.col("class").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, one of each group of linked ones: that with the smallest key, of equal keys one of them.

    Rows without words are linked with nothing and stay.  Columns are those of ``docs``.
    """
    rows, roots = link_classes(docs, key, text, **options)
    rows = rows.join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "text_hash")).alias("first")
    keep = rows.where("class IS NOT NULL").groupBy("root").agg(first).select("first.key", "first.text_hash", F.lit(True).alias("once"))
    keep = keep.union(rows.where("class IS NULL").select("key", "text_hash", F.lit(False)).distinct())
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_hash"))
    keep = keep.select(F.col("key").alias("k"), F.col("text_hash").alias("h"), "once")
    d = d.join(keep, d["key"].eqNullSafe(keep["k"]) & (d["text_hash"] == keep["h"]))
    d = d.withColumn("n", F.row_number().over(Window.partitionBy("key", "text_hash").orderBy("once")))
    return d.where("NOT once OR n = 1").select("row.*")
