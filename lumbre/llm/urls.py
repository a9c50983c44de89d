"""URL verdicts: allow and block rules first, then a tree of path templates learnt per host.

All steps are DataFrame operations.  Paths are first generalised by the shape of their segments (numbers, hexadecimal
strings, UUIDs become wildcards), which leaves few different ones per host.  The tree then grows level by level from the
root: under each node a branch stays apart if it has support and its share of bad labels differs from its parent's beyond
chance; all others, rare or statistically alike, are merged into one wildcard branch.  It grows as deep as a node can still
split, which takes pages with both labels.  A leaf is a template; it is rejected if its labelled purity, smoothed towards its host's and that towards all hosts', is too low.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbre.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and path (then up to ``?``, ``#`` or the end).

    A null url, or one without ``://``, has neither: both are empty.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict, or nulls.

    A rule is a host and a path, like ``example.com/en/``; it fits the host and all subdomains if the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: len(r[0])):
        own, slash, start = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + start))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """A path without its first slash, with variable parts as wildcards."""
    wild = F.regexp_replace(path, r"(?<=/)[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?=[/.]|$)", "<uuid>")
    wild = F.regexp_replace(wild, r"(?<=/)(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{8,}(?=[/.]|$)", "<hex>")
    wild = F.regexp_replace(wild, r"[0-9]+", "<n>")
    return F.regexp_replace(wild, "^/", "")


def _live(q: DataFrame, level: int, support: int) -> DataFrame:
    """Rows of nodes that may still split: they have both labels, without which no branch differs, and enough deeper pages.

    ``chain`` is the last of the node's deeper paths, ``common`` up to which segment a row goes along with it from ``level`` on.
    """
    deep = F.size("parts") > level
    nodes = q.groupBy("host", "node").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"), F.sum(F.when(deep, F.col("n"))).alias("deeper"), F.max(F.when(deep, F.col("parts"))).alias("chain"))
    nodes = nodes.where((F.col("b") > 0) & (F.col("b") < F.col("l")) & (F.col("deeper") >= support)).select("host", "node", "chain")
    rest = lambda c: F.slice(c, F.lit(level + 1), F.greatest(F.size(c) - level, F.lit(0)))
    same = F.array_position(F.zip_with(rest("parts"), rest("chain"), lambda x, y: x.eqNullSafe(y)), False)
    return q.join(nodes, ["host", "node"]).withColumn("common", F.when(same == 0, F.size("parts")).otherwise(level + same - 1).cast("int"))


def _differs(n, labelled, bad, of_labelled, of_bad, support: int, least_z: float):
    """Whether a child has pages enough and another share of bad ones than its parent, beyond chance."""
    rate = (of_bad + 0.5) / (of_labelled + 1)
    z = F.abs(bad - labelled * rate) / F.sqrt(F.greatest(labelled, F.lit(1)) * rate * (1 - rate))
    return (n >= support) & (z >= least_z)


def _chained(q: DataFrame, live: DataFrame, level: int, until: int, support: int, least_z: float) -> DataFrame:
    """All levels up to ``until`` at once: there, nodes have one child each, beside the pages that end.

    A child is told from its parent only at levels where pages end; what both hold follows from how many pages are how deep.
    """
    depths = live.groupBy("host", "node", F.size("parts").alias("depth")).agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    deeper = Window.partitionBy("host", "node").orderBy(F.desc("depth"))
    upto, beyond = deeper.rowsBetween(Window.unboundedPreceding, 0), deeper.rowsBetween(Window.unboundedPreceding, -1)
    child = [F.coalesce(F.sum(c).over(beyond), F.lit(0)) for c in ("n", "l", "b")]
    apart = _differs(*child, F.sum("l").over(upto), F.sum("b").over(upto), support, least_z)
    marks = depths.where(F.col("depth") >= level).withColumn("apart", apart).where(F.col("apart") & (F.col("depth") < until))
    marks = marks.groupBy("host", "node").agg(F.collect_set("depth").alias("apart"))
    last = F.least(F.size("parts"), F.lit(until))
    steps = F.transform(F.sequence(F.lit(level), last - 1), lambda j: F.when(F.coalesce(F.array_contains("apart", j), F.lit(False)), F.concat(F.lit("/"), F.get("parts", j))).otherwise("/*"))
    walked = F.when(last > level, F.concat("node", F.array_join(steps, ""))).otherwise(F.col("node"))
    return q.join(marks, ["host", "node"], "left").withColumn("node", walked).drop("apart")


def _branched(q: DataFrame, level: int, support: int, least_z: float) -> DataFrame:
    """One level at which nodes have several children: those that differ stand apart, the others merge."""
    q = q.withColumn("segment", F.when(F.size("parts") > level, F.get("parts", F.lit(level))).otherwise(END))
    child = q.groupBy("host", "node", "segment").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
    parent = child.groupBy("host", "node").agg(F.sum("labelled").alias("pl"), F.sum("bad").alias("pb"))
    differs = _differs(F.col("n"), F.col("labelled"), F.col("bad"), F.col("pl"), F.col("pb"), support, least_z)
    apart = child.join(parent, ["host", "node"]).where(differs & (F.col("segment") != END))
    q = q.join(apart.select("host", "node", "segment", F.lit(True).alias("apart")), ["host", "node", "segment"], "left")
    step = F.when(F.col("segment") == END, F.lit("")).when(F.col("apart"), F.concat(F.lit("/"), "segment")).otherwise("/*")
    return q.withColumn("node", F.concat("node", step)).drop("segment", "apart")


def templates(pages: DataFrame, support: int = 5, least_z: float = 2.58, smoothing: float = 5.0) -> DataFrame:
    """(``host``, ``shape``, ``template``, ``purity``, ``labelled``) of ``pages`` with ``host``, ``path``, ``bad`` (0, 1 or null: no label).

    ``shape`` is the text of ``shape()``, the key that a page finds its template by.  The tree grows level by level; levels at which no
    node has two children beside the pages that end are taken together, so a path may have any number of segments.
    """
    own = F.col("bad").cast("long")
    sums = lambda *names: [F.sum(n).alias(n) for n in names]
    q = pages.select("host", shape(F.col("path")).alias("shape"), own.alias("bad"))
    q = q.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    q = cut_lineage(q.withColumns({"node": F.lit(""), "parts": F.split("shape", "/")}), "shapes")

    level = 0
    while True:
        live = _live(q, level, support)
        told = live.agg(F.count("*").alias("nodes"), F.min(F.when(F.col("common") < F.size("parts"), F.col("common"))).alias("branch"), F.max(F.size("chain")).alias("end")).first()
        if not told["nodes"]:
            break
        branch = told["end"] if told["branch"] is None else told["branch"]
        if branch > level:
            q = _chained(q, live, level, branch, support, least_z)
        if told["branch"] is not None:
            q = _branched(q, branch, support, least_z)
        q, level = cut_lineage(q, "templates"), branch + (told["branch"] is not None)
    q = q.withColumn("node", F.concat("node", F.repeat(F.lit("/*"), F.greatest(F.size("parts") - level, F.lit(0)))))
    hosts = q.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("bad").alias("hb"))
    total = q.agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).first()
    everywhere = ((total["b"] or 0) + 1.0) / ((total["l"] or 0) + 2.0)
    leaves = q.groupBy("host", "node").agg(*sums("labelled", "bad")).join(hosts, "host")
    prior = (F.col("hb") + smoothing * everywhere) / (F.col("hl") + smoothing)
    leaves = leaves.select("host", "node", "labelled", (1 - (F.col("bad") + smoothing * prior) / (F.col("labelled") + smoothing)).alias("purity"))
    return q.select("host", "node", "shape").join(leaves, ["host", "node"]).select("host", "shape", F.col("node").alias("template"), "purity", "labelled")


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", bad: str = "bad", least_purity: float = 0.5, **options) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` (allow or block), ``template`` and ``purity``; columns of these names are replaced.

    A rule's verdict goes before the template's.  Rows are kept as they are, repeated ones too; a null or relative url has an
    empty host and path, which have a template like others; nulls in ``bad`` are pages without a label.
    """
    names = ("host", "path", "rule", "verdict", "template", "purity")
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in names]).alias("row"), F.col(url).cast("string").alias("url"), F.col(bad).cast("long").alias("bad"))
    rows = rows.select("row", "bad", host.alias("host"), path.alias("path"))
    known = templates(rows, **options)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"shape": shape(F.col("path")), "rule": rule, "verdict": verdict})
    out = rows.join(known, ["host", "shape"], "left")
    learnt = F.when(F.col("purity") < least_purity, "block").otherwise("allow")
    return out.select("row.*", "host", "path", "rule", F.coalesce("verdict", learnt).alias("verdict"), "template", "purity")
