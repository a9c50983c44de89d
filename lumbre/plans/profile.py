"""Column profile and type inference over a whole table, one row per column.

The table is unpivoted to (column, value) and aggregated; every type test is a
boolean aggregate, so the result does not depend on how rows are partitioned.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window

from lumbre.functions import dates, missing, net, numbers
from lumbre.session import cut_lineage
from lumbre.sources.readers import spread

TOP_VALUES = 8
MAX_ENUM_VALUES = 15
PIECES_A_CORE = 4

# Name rules (regexes over the column name).
ID_NAME = (r"(?i)((^|_)(id|ids|code|codigo|cod|nro|num|number|numero|zip|cp|dni|cuit|cuil|phone|telefono|tel|cuenta|"
           r"account|card|tarjeta|sku|ean|isbn|legajo|patente|serial|hash|uuid|guid)(_|$|\d))|id$")
TIME_NAME = (r"(?i)(^|_)(ts|time|timestamp|fecha|date|datetime|hora|created|updated|momento|event_time|fecha_hora|"
             r"fechahora)(_|$)")
CLOCK_NAME = r"(?i)(^|_)(time|hora)(_|$)"
DATE_HEAD = r"^(?:\d{1,4}[-/]|\d{8}-|\d{14})"  # how the shapes of ``dates.DATE_FORMATS`` begin
CLOCK = r"^\d{1,2}:\d{2}(:\d{2})?$"


def melt(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(position, column, value) with the value as text."""
    names = columns or df.columns
    cells = F.array(*[F.struct(F.lit(df.columns.index(n)).alias("position"), F.lit(n).alias("column"),
                               F.col(f"`{n}`").cast("string").alias("value")) for n in names])
    return df.select(F.explode(cells).alias("cell")).select("cell.*")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """How often each value of each column occurs (missing texts become NULL)."""
    return melt(df, columns).withColumn("value", missing.clean(F.col("value"))) \
        .groupBy("position", "column", "value").agg(F.count(F.lit(1)).alias("n"))


def _native(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return "nested"
    return "text"


# Names of the answers, in the order of their bits.
_TESTS = ("bool", "long_bool", "zero_code", "body", "hint_point", "hint_comma", "point", "ip",
          *[f"{stem}_{tag}" for tag in "pc" for stem in ("reads", "whole", "fraction", "dirty")],
          *[f"date_{i}" for i in range(len(dates.DATE_FORMATS))], *[f"epoch_{name}" for name, _ in dates.EPOCHS])


def _tests(t: Column, b: Column, point: Column, comma: Column) -> dict[str, Column]:
    """Yes/no questions about one trimmed value, its numeric body and the number it is under each decimal mark."""
    low = F.lower(t)
    out = {
        "bool": low.isin("true", "false", "yes", "no", "y", "n", "t", "f"), "long_bool": low.isin("true", "false", "yes", "no"),
        "zero_code": t.rlike(r"^0\d+$"), "body": b.isNotNull(), "hint_point": numbers.body_hints_point(b),
        "hint_comma": numbers.body_hints_comma(b), "point": b.contains("."), "ip": net.is_ip(t),
    }
    for d, tag, value in ((".", "p", point), (",", "c", comma)):
        out |= {f"reads_{tag}": value.isNotNull(), f"whole_{tag}": value == F.floor(value), f"fraction_{tag}": b.contains(d),
                f"dirty_{tag}": numbers.needs_cleaning(t, d)}
    # Every date begins in one of a few ways: one cheap look spares the rest.
    out |= {f"date_{i}": F.when(F.col("datelike"), dates.parse(t, f.name).isNotNull()) for i, f in enumerate(dates.DATE_FORMATS)}
    out |= {f"epoch_{name}": t.rlike(f"^{shape}$") for name, shape in dates.EPOCHS}
    return out


def _with_bits(values: DataFrame) -> DataFrame:
    """All answers about each value packed into one number: bit_and over a column says "every", bit_or says "some"."""
    staged = values.withColumns({"b": numbers.body(F.col("value")), "datelike": F.col("value").rlike(DATE_HEAD)}) \
        .withColumns({"point": numbers.body_value(F.col("b"), "."), "comma": numbers.body_value(F.col("b"), ",")})
    tests, bits = _packed(id(SparkContext._gateway))
    return staged.select("column", "value", "n", *tests).select("column", "value", "n", bits)


@lru_cache(maxsize=1)
def _packed(_gateway: int) -> tuple[list[Column], Column]:
    """The questions as one column each, and their sum; built once, since they do not depend on the table.

    Separate columns, added up in a projection of their own, keep each generated method small.
    """
    answers = _tests(F.col("value"), F.col("b"), F.col("point"), F.col("comma"))
    zero = F.lit(0).cast("bigint")
    tests = [F.when(F.coalesce(answers[n], F.lit(False)), F.lit(2 ** i).cast("bigint")).otherwise(zero).alias(f"t{i}") for i, n in enumerate(_TESTS)]
    return tests, sum((F.col(f"t{i}") for i in range(1, len(tests))), F.col("t0")).alias("bits")


def profile(df: DataFrame, table: str = "", exact: bool = True) -> DataFrame:
    """One row per column: counts, top values, type, date format, number locale, dimension.

    ``exact=False`` counts distinct values and top values with mergeable
    sketches; only the different texts of text columns are shuffled then.
    """
    kinds = {f.name: _native(f.dataType) for f in df.schema.fields}
    if exact:
        # Counted once and kept: three aggregates read it.
        values = cut_lineage(value_counts(df), "profile")
        weight = F.col("n")
    else:
        values = melt(df).withColumn("value", missing.clean(F.col("value")))
        weight = F.lit(1).cast("bigint")
    filled = F.col("value").isNotNull()
    counts = values.groupBy("position", "column").agg(
        F.sum(weight).alias("rows"), F.coalesce(F.sum(F.when(~filled, weight)), F.lit(0)).alias("empties"),
        (F.count(F.when(filled, F.lit(1))) if exact else F.approx_count_distinct("value")).alias("distinct"))
    if exact:
        w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
        top = values.where(filled).withColumn("r", F.row_number().over(w)).where(F.col("r") <= TOP_VALUES) \
            .groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda s: s["value"]).alias("frequent"))
    else:
        top = values.where(filled).groupBy("column").agg(
            F.transform(F.expr(f"approx_top_k(value, {TOP_VALUES})"), lambda s: s["item"]).alias("frequent"))
    # Only columns that arrive as text, or as integers named like a time (they may be epochs), need their values read.
    read = [n for n, k in kinds.items() if k == "text" or (k == "integer" and re.search(TIME_NAME, n))]
    texts = values.where(F.col("column").isin(*read) & filled).select("column", F.trim("value").alias("value"), weight.alias("n"))
    if not exact:
        # Reading a value costs far more than counting it, so each different text is read once.
        texts = texts.groupBy("column", "value").agg(F.sum("n").alias("n"))
    # Few bytes take long here, so they are not left in the few pieces that their size asks for.
    texts = spread(texts, PIECES_A_CORE * df.sparkSession.sparkContext.defaultParallelism)
    bits = _with_bits(texts).groupBy("column").agg(
        F.bit_and("bits").alias("every"), F.bit_or("bits").alias("some"), F.sum(F.length("value") * F.col("n")).alias("length"),
        F.sum(F.when(F.col("value").contains(" "), F.col("n"))).alias("spaced"), F.min(numbers.unit_mark(F.col("value"))).alias("unit"))
    kind_map = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    decided = _decide(counts.join(top, "column", "left").join(bits, "column", "left").withColumn("native", kind_map[F.col("column")]), table)
    # One row per column of the table: metadata, kept as such so that rules over it plan as over any small table.
    return df.sparkSession.createDataFrame(decided.collect(), decided.schema)


def _decide(p: DataFrame, table: str) -> DataFrame:
    """The precedence of types, as one projection over the packed answers."""
    name, native = F.col("column"), F.col("native")
    order = {n: i for i, n in enumerate(_TESTS)}
    bit = lambda column, n: F.coalesce(F.getbit(column, F.lit(order[n])) == 1, F.lit(False))
    every, some = (lambda n: bit(F.col("every"), n)), (lambda n: bit(F.col("some"), n))
    text = native == "text"
    is_id, is_time = name.rlike(ID_NAME), name.rlike(TIME_NAME)
    date_chain = reduce(lambda acc, i: acc.when(every(f"date_{i}"), F.lit(dates.DATE_FORMATS[i].name)),
                        range(1, len(dates.DATE_FORMATS)), F.when(every("date_0"), F.lit(dates.DATE_FORMATS[0].name)))
    epoch_chain = F.when(is_time & every("epoch_UNIX_MS"), F.lit("UNIX_MS")).when(is_time & every("epoch_UNIX"), F.lit("UNIX"))
    decimal = F.when(~every("body") | (some("hint_point") & some("hint_comma")), None).when(some("hint_point"), F.lit(".")) \
        .when(some("hint_comma"), F.lit(",")).when(some("point"), F.lit(",")).otherwise(F.lit("."))
    filled = F.col("rows") - F.col("empties")
    # Settled step by step in columns of their own, so that no expression is repeated inside another.
    p = p.withColumns({"_decimal": F.when((decimal == ".") & every("reads_p"), F.lit(".")).when((decimal == ",") & every("reads_c"), F.lit(",")),
                       "_date": F.when(text & ~every("bool"), F.coalesce(date_chain, epoch_chain)).when(native == "integer", epoch_chain),
                       "_free": (F.col("length") / filled > 60) & (F.coalesce(F.col("spaced"), F.lit(0)) > F.floor(filled / 2))})
    decimal, date_format = F.col("_decimal"), F.col("_date")
    by_decimal = lambda test: F.when(decimal == ".", test("p")).otherwise(test("c"))
    number = F.when(by_decimal(lambda d: some(f"fraction_{d}") | ~every(f"whole_{d}")), F.lit("float")).otherwise(F.lit("integer"))
    kind = F.when(filled == 0, F.lit("string")).when(native == "boolean", F.lit("boolean")) \
        .when(native == "nested", F.lit("string")) \
        .when(is_id & (native != "date"), F.lit("string")) \
        .when(native == "date", F.lit("date")) \
        .when((native == "integer") & date_format.isNotNull(), F.lit("date")) \
        .when(native.isin("integer", "float"), native) \
        .when(every("bool") & some("long_bool"), F.lit("boolean")) \
        .when(date_format.isNotNull(), F.lit("date")) \
        .when(some("zero_code"), F.lit("string")) \
        .when(decimal.isNotNull(), number) \
        .when(every("ip"), F.lit("ip")) \
        .when(F.col("_free"), F.lit("text")).otherwise(F.lit("string"))
    p = p.withColumn("_kind", kind).withColumn("_dirty", by_decimal(lambda d: some(f"dirty_{d}")))
    kind = F.col("_kind")
    typed = p.select(
        F.lit(table).alias("table"), "position", "column", "native", "rows", "empties", "distinct",
        F.coalesce("frequent", F.array().cast("array<string>")).alias("frequent"), kind.alias("type"),
        F.when(kind == "date", date_format).alias("date_format"),
        F.when(kind.isin("integer", "float") & text, decimal).alias("decimal"),
        F.when(kind.isin("integer", "float") & text, F.col("_dirty")).otherwise(F.lit(False)).alias("clean_number"),
        F.when(kind.isin("integer", "float"), F.col("unit")).alias("unit"),
        (F.col("length") / filled).alias("mean_length"))
    return typed.withColumn("dimension", dimension(F.col("type"), name, F.col("rows"), F.col("empties"), F.col("distinct")))


def dimension(kind: Column, name: Column, rows: Column, empties: Column, distinct: Column) -> Column:
    """Worth grouping by: not an id, and not (nearly) one value per row."""
    filled = F.greatest(F.lit(1), rows - empties)
    return kind.isin("string", "boolean") & (distinct > 0) & ~((kind == "string") & name.rlike(ID_NAME)) \
        & ~((rows >= 10) & (distinct >= 0.9 * filled)) & ((distinct <= 60) | (distinct < 0.5 * filled))


def enums(df: DataFrame, columns: list[str], limit: int = MAX_ENUM_VALUES) -> DataFrame:
    """Values of the columns with few of them, fewest first. Never more than ``limit`` values in a list."""
    values = value_counts(df, columns).where(F.col("value").isNotNull())
    sizes = values.groupBy("column").agg(F.count(F.lit(1)).alias("distinct")).where(F.col("distinct") <= limit)
    return values.join(sizes, "column").groupBy("column", "distinct") \
        .agg(F.array_sort(F.collect_list("value")).alias("values")).orderBy("distinct", "column")


def event_time(p: DataFrame) -> DataFrame:
    """One row: the date column of the event, a time-like name first."""
    is_time = F.col("column").rlike(TIME_NAME)
    return p.where(F.col("type") == "date").agg(
        F.min_by("column", F.struct((~is_time).alias("a"), F.col("position"))).alias("event_time"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed between two profiles: missing, extra, changed or empty columns; compatible ones left out.

    A text column accepts anything and a decimal one accepts integers.
    """
    a = before.select("column", *[F.col(c).alias(f"a_{c}") for c in ("type", "date_format", "decimal", "clean_number")])
    b = after.select("column", *[F.col(c).alias(f"b_{c}") for c in ("type", "date_format", "decimal", "clean_number", "rows", "empties")])
    both = a.join(b, "column", "full_outer")
    spelled = lambda t, f: F.when(f.isNotNull(), F.concat(t, F.lit(" ("), f, F.lit(")"))).otherwise(t)
    numeric = lambda c: c.isin("integer", "float")
    dirty = numeric(F.col("a_type")) & numeric(F.col("b_type")) & F.col("b_clean_number") \
        & (~F.col("a_clean_number") | ~F.col("a_decimal").eqNullSafe(F.col("b_decimal")))
    accepts = F.col("a_type").isin("string", "text") | ((F.col("a_type") == "float") & numeric(F.col("b_type")))
    was, now = spelled(F.col("a_type"), F.col("a_date_format")), spelled(F.col("b_type"), F.col("b_date_format"))
    change = F.when(F.col("b_type").isNull(), F.lit("missing")).when(F.col("a_type").isNull(), F.lit("extra")) \
        .when(F.col("b_empties") >= F.col("b_rows"), F.lit("empty")).when(dirty, F.lit("changed")) \
        .when(~accepts & (was != now), F.lit("changed"))
    return both.select("column", change.alias("change"), was.alias("before"), now.alias("after")).where(change.isNotNull())


def plan_rows(p: DataFrame) -> list[dict]:
    """The profile as driver metadata: one small row per column."""
    return [r.asDict() for r in p.select("column", "type", "date_format", "decimal", "clean_number", "native")
            .orderBy("position").collect()]


def typed_column(c: Column, row: dict, zone: str | None = dates.DEFAULT_ZONE) -> Column:
    """A text column under the type its profile row decided; what does not read becomes NULL."""
    if row["native"] != "text":
        return c
    c = missing.clean(c)
    if row["type"] in ("integer", "float"):
        number = numbers.parse(c, row["decimal"] or ".")
        return number.try_cast("bigint") if row["type"] == "integer" else number
    if row["type"] == "boolean":
        return F.when(F.lower(F.trim(c)).isin("true", "yes", "y", "t"), True).when(c.isNotNull(), False)
    if row["type"] == "date":
        return dates.parse(c, row["date_format"], zone)
    return c


def apply_plan(df: DataFrame, rows: list[dict], zone: str | None = dates.DEFAULT_ZONE) -> DataFrame:
    """Every column typed, plus ``parse_errors`` naming the fields that were present but did not read."""
    raw = {r["column"]: F.col(f"`{r['column']}`") for r in rows}
    bad = [F.when(missing.clean(raw[r["column"]]).isNotNull() & typed_column(raw[r["column"]], r, zone).isNull(), F.lit(r["column"]))
           for r in rows if r["native"] == "text"]
    errors = F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")
    others = [F.col(f"`{c}`") for c in df.columns if c not in raw]
    return df.select(*others, *[typed_column(raw[r["column"]], r, zone).alias(r["column"]) for r in rows],
                     errors.alias("parse_errors"))


def verify(typed: DataFrame) -> DataFrame:
    """One row: how many rows read completely and how many did not."""
    ok = F.size("parse_errors") == 0
    return typed.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))


def problems(typed: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` rows that did not read, for showing."""
    return typed.where(F.size("parse_errors") > 0).limit(n)


def coverage(df: DataFrame, text: str, dimensions: list[str], keep: float = 0.5) -> DataFrame:
    """Share of the rows with text that carry each dimension; those at ``keep`` or above."""
    with_text = df.where(F.col(text).isNotNull())
    shares = with_text.agg(*[F.avg(F.col(d).isNotNull().cast("int")).alias(d) for d in dimensions])
    long = shares.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("coverage"))
                                             for d in dimensions])).alias("s")).select("s.*")
    return long.where(F.col("coverage") >= keep)


def volume(lines: DataFrame, value: str = "value", by: Column | None = None) -> DataFrame:
    """Average bytes per event and total bytes, per day if a day column is given."""
    aggs = [F.count(F.lit(1)).alias("events"), F.avg(F.octet_length(value)).alias("bytes_per_event"),
            F.sum(F.octet_length(value)).alias("bytes")]
    return lines.groupBy(by.alias("day")).agg(*aggs) if by is not None else lines.agg(*aggs)
