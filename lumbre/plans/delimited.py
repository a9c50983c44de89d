"""Delimited lines: choosing the separator, spotting the header, reading the cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumbre.functions import dates, missing, numbers

SEPARATORS = (",", ";", "\t", "|")
_QUOTED = r'"(?:[^"]|"")*"'


def cells(c: Column, separator: str = ",") -> Column:
    """Array of cells; quotes protect separators and a doubled quote is a quote."""
    sep = "\\" + separator if separator == "|" else separator
    bare = rf"[^{sep}]*"
    # Each cell is matched together with the separator before it, so empty cells count.
    found = F.regexp_extract_all(F.concat(F.lit(separator), c), F.lit(rf"{sep}\s*({_QUOTED}|{bare})\s*(?={sep}|$)"), 1)
    return F.transform(found, lambda x: F.when(
        x.rlike(r'^"[\s\S]*"$'), F.regexp_replace(F.regexp_replace(x, r'^"([\s\S]*)"$', "$1"), '""', '"')).otherwise(x))


def separator_shares(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row per separator: commonest number of columns, its share, and whether cells look like pairs."""
    line = F.col(value)
    stacked = lines.where(F.trim(line) != "").select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("separator"), F.lit(i).alias("rank"), F.size(cells(line, s)).alias("columns"),
                 F.size(F.filter(cells(line, s), lambda x: x.rlike(r"^\s*[A-Za-z_][\w.\-]*="))).alias("pairs"))
        for i, s in enumerate(SEPARATORS)])).alias("s")).select("s.*")
    counted = stacked.groupBy("separator", "rank", "columns").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("pairs") >= F.greatest(F.lit(2), F.floor(F.col("columns") / 2))).alias("paired"))
    return counted.groupBy("separator", "rank").agg(
        F.max_by("columns", F.struct("n", -F.col("columns"))).alias("columns"), F.max("n").alias("n"),
        F.sum("n").alias("lines"), F.sum("paired").alias("paired"))


def choose_separator(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row with the winning separator and its number of columns, none if nothing is consistent.

    Consistent means two columns or more on 90 % of the lines; the most columns win.
    """
    ok = (F.col("columns") >= 2) & (F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("lines") * 0.9))) \
        & (F.col("paired") * 2 < F.col("lines"))
    return separator_shares(lines, value).where(ok).orderBy(F.desc("columns"), "rank").limit(1) \
        .select("separator", "columns")


def _is_data(c: Column) -> Column:
    date_like = F.coalesce(*[dates.parse(c, f.name) for f in dates.DATE_FORMATS]).isNotNull()
    return numbers.body(c).isNotNull() | (c.rlike(r"^\s*\d") & date_like)


def looks_like_header(lines: DataFrame, header: str, separator: str = ",", value: str = "value") -> DataFrame:
    """One row ``is_header``: only text in the first line, and some column that changes nature below it."""
    first = F.transform(cells(F.lit(header), separator), F.trim)
    texts = ~F.exists(first, lambda x: missing.is_missing(x) | _is_data(x))
    rest = lines.where((F.col(value) != header) & (F.trim(F.col(value)) != "")) \
        .select(F.posexplode(F.transform(cells(F.col(value), separator), F.trim)).alias("i", "cell"))
    per_column = rest.groupBy("i").agg(
        F.count_if(~missing.is_missing(F.col("cell"))).alias("filled"),
        F.coalesce(F.bool_and(F.when(~missing.is_missing(F.col("cell")), _is_data(F.col("cell")))), F.lit(False)).alias("data"),
        F.bool_or(F.col("cell") == F.get(first, F.col("i"))).alias("repeats"))
    return per_column.agg(
        (F.first(texts) & (F.coalesce(F.bool_or("data"), F.lit(False)) | ~F.coalesce(F.bool_or("repeats"), F.lit(False))))
        .alias("is_header"))


def drop_header(lines: DataFrame, header: str, value: str = "value") -> DataFrame:
    """Without the header, blank and comment lines."""
    line = F.trim(F.col(value))
    return lines.where((line != "") & (line != header.strip()) & ~line.startswith("#"))


def parse_lines(lines: DataFrame, columns: list[str], separator: str = ",", value: str = "value") -> DataFrame:
    """Named columns through the CSV reader's own parser; empty cells are NULL.

    A line with more or fewer cells than columns is flagged in ``parse_errors`` and kept in ``raw_line``.
    """
    schema = ", ".join(f"`{c}` string" for c in (*columns, "_odd"))
    parsed = F.from_csv(F.col(value), F.lit(schema), {"sep": separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_odd"})
    kept = [c for c in lines.columns if c != value]
    row = lines.select(*kept, parsed.alias("_row"))
    errors = F.array_compact(F.array(F.when(F.col("_row._odd").isNotNull(), F.lit("_csv_cells"))))
    return row.select(*kept, *[F.nullif(F.trim(F.col(f"_row.`{c}`")), F.lit("")).alias(c) for c in columns],
                      F.col("_row._odd").alias("raw_line"), errors.alias("parse_errors"))
