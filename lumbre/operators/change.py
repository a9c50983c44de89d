"""What changed between an interval and the period before it."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

MIN_BASELINE = dt.timedelta(hours=24)
POINT_MARGIN = dt.timedelta(hours=1)
# Fixed value: coordinates explain nothing even when they change.
COORDINATE = r"(?i)(^|[._])(lat|latitud|latitude|lon|lng|long|longitud|longitude|geo|geo_location|location|coordenadas)($|[._])"


@dataclass(frozen=True)
class Comparison:
    """An interval and the baseline that ends where it starts."""

    start: dt.datetime
    end: dt.datetime
    baseline_start: dt.datetime

    @classmethod
    def of(cls, start: dt.datetime, end: dt.datetime, times: int = 3, least: dt.timedelta = MIN_BASELINE) -> Comparison:
        """The baseline is ``times`` as long as the interval, ``least`` at the shortest."""
        if not start < end:
            raise ValueError("the interval must end after it starts; Comparison.around() takes a point")
        return cls(start, end, start - max(least, times * (end - start)))

    @classmethod
    def around(cls, point: dt.datetime, margin: dt.timedelta = POINT_MARGIN, **options) -> Comparison:
        return cls.of(point - margin, point + margin, **options)


def time_literal(df: DataFrame, ts: str, at: dt.datetime):
    """A literal of the column's own timestamp type, so that the comparison reaches the scan."""
    kind = "timestamp_ntz" if df.schema[ts].dataType.typeName() == "timestamp_ntz" else "timestamp"
    return F.expr(f"{kind}'{at.strftime('%Y-%m-%d %H:%M:%S.%f')}'")


def between(df: DataFrame, ts: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Half-open time range."""
    return df.where((F.col(ts) >= time_literal(df, ts, start)) & (F.col(ts) < time_literal(df, ts, end)))


def label_windows(df: DataFrame, ts: str, w: Comparison) -> DataFrame:
    """Rows of both windows with ``selected`` telling them apart: one contiguous range, one scan."""
    both = between(df, ts, w.baseline_start, w.end)
    return both.withColumn("selected", F.col(ts) >= time_literal(df, ts, w.start))


def value_shares(labelled: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, selection, base): share of each value in each window; base is NULL where the window is empty."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields])
    counts = labelled.select("selected", F.explode(cells).alias("c")).select("selected", "c.*").where(F.col("value").isNotNull()) \
        .groupBy("field", "value").agg(F.count_if("selected").alias("s"), F.count_if(~F.col("selected")).alias("b"))
    totals = counts.groupBy("field").agg(F.sum("s").alias("ts"), F.sum("b").alias("tb"))
    return counts.join(totals, "field").select(
        "field", "value", (F.col("s") / F.nullif("ts", F.lit(0))).alias("selection"), (F.col("b") / F.nullif("tb", F.lit(0))).alias("base"))


def distribution_changes(shares: DataFrame, n: int = 6) -> DataFrame:
    """Fields by how much their distribution moved (half the sum of differences) with the value that moved most.

    Coordinates are out, and so is a derived ``x_falla`` when ``x`` itself is there.
    """
    diff = F.abs(F.col("selection") - F.col("base"))
    moved = shares.where(F.col("selection").isNotNull() & F.col("base").isNotNull() & ~F.col("field").rlike(COORDINATE))
    # Ties on the size of the move go to the smaller value.
    fields = moved.groupBy("field").agg(
        (F.sum(diff) / 2).alias("divergence"),
        F.min_by(F.struct("value", "selection", "base"), F.struct((-diff).alias("d"), F.col("value"))).alias("top"))
    known = fields.select(F.concat("field", F.lit("_falla")).alias("field"))
    return fields.join(known, "field", "left_anti").where(F.col("divergence") > 0) \
        .select("field", F.col("top.value").alias("value"), F.col("top.selection").alias("selection"),
                F.col("top.base").alias("base"), "divergence") \
        .orderBy(F.desc("divergence"), "field").limit(n)


def pattern_changes(shares: DataFrame, field: str, n: int = 6) -> DataFrame:
    """Values of a field whose share rose: new ones first by share, then by lift."""
    rose = shares.where((F.col("field") == field) & (F.coalesce("selection", F.lit(0.0)) > F.coalesce("base", F.lit(0.0))))
    new = F.coalesce("base", F.lit(0.0)) == 0
    lift = F.when(~new, F.col("selection") / F.col("base"))
    return rose.withColumns({"is_new": new, "lift": lift}) \
        .orderBy(F.desc("is_new"), F.desc(F.when(F.col("is_new"), F.col("selection")).otherwise(F.col("lift"))), "value").limit(n) \
        .select("value", "selection", "base", "lift", "is_new")


def change_table(changes: DataFrame, field: str | None = None) -> DataFrame:
    """Whole percentages, for showing."""
    name = F.lit(field) if field else F.col("field")
    return changes.select(F.col("value").alias("valor"), name.alias("campo"),
                          F.round(100 * F.coalesce("selection", F.lit(0.0))).cast("bigint").alias("pct_intervalo"),
                          F.round(100 * F.coalesce("base", F.lit(0.0))).cast("bigint").alias("pct_antes"))
