"""Raw sources: text, CSV, JSON lines, relational tables, Kafka, and records that span several lines."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lumbre.functions import dates
from lumbre.functions.text import strip_line
from lumbre.operators.scan import chunked_scan

# What the first line of an event looks like: a date of a known format (bracketed or not), a day of a log's month, a syslog priority, a CEF header.
_LOG_DAYS = (r"\d{1,2}/[A-Z][a-z]{2}/\d{4}", r"[A-Z][a-z]{2}\s+\d{1,2}\s\d{2}:\d{2}")
EVENT_START = rf"^(?:\[?(?:{'|'.join(d.shape for d in dates.DATE_FORMATS if not d.shape.startswith(chr(92) + 'd{1'))}|{'|'.join(_LOG_DAYS)})|<\d{{1,3}}>|CEF:)"


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8", comments: bool = True, metadata: bool = False) -> DataFrame:
    """One row per line of every file under a prefix, ``.gz`` included.

    Empty files and folder markers are skipped; so are blank lines and, with
    ``comments``, lines starting with ``#``. Lines end with a line feed byte;
    their bytes are decoded from ``encoding``, control characters included.
    """
    raw = spark.read.text(path)
    value = F.col("value") if encoding.upper() in ("UTF-8", "UTF8") else F.decode(F.col("value").cast("binary"), encoding)
    columns = [strip_line(value).alias("value")]
    if metadata:
        columns += [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("line_no")]
    lines = raw.where(F.col("_metadata.file_size") > 0).select(*columns).where(F.col("value") != "")
    return lines.where(~F.ltrim("value").startswith("#")) if comments else lines


def stream_lines(spark: SparkSession, path: str, archive: str | None = None, max_files: int | None = None) -> DataFrame:
    """The same as a stream of arriving files; finished ones move to ``archive`` if given."""
    reader = spark.readStream.format("text")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.load(path).select(strip_line(F.col("value")).alias("value")).where(F.col("value") != "")


def spread(df: DataFrame, parts: int) -> DataFrame:
    """In ``parts`` even pieces, for a source that cannot be split (a gzip file) and work that is heavy per row. The caller decides."""
    return df.repartition(parts)


def sample_lines(lines: DataFrame, n: int = 200, cut: bool = False) -> DataFrame:
    """A look at the source: the first ``n`` non-empty lines of its files, in their order.

    ``lines`` as ``read_lines(..., metadata=True)`` gives them.  With ``cut`` the files were read up to some byte only, so the last
    line of each is likely a part of one and is left out.
    """
    whole = lines.where(F.trim("value") != "")
    if cut:
        ends = lines.groupBy("file").agg(F.max("line_no").alias("_last"))
        whole = whole.join(ends, "file").where(F.col("line_no") < F.col("_last")).drop("_last")
    return whole.orderBy("file", "line_no").limit(n)


def spread_sample(df: DataFrame, order: str, n: int) -> DataFrame:
    """``n`` rows spread evenly over the order of a numeric column: one per slice of its range.

    Slices come from the range of the column, so no global sort is needed.
    """
    bounds = df.agg(F.struct(F.min(order).alias("lo"), F.max(order).alias("hi")).alias("b")).scalar()
    width = F.greatest((F.col("_b.hi") - F.col("_b.lo") + 1) / F.lit(float(n)), F.lit(1e-9))
    sliced = df.withColumn("_b", bounds).withColumn("_slice", F.floor((F.col(order) - F.col("_b.lo")) / width)).drop("_b")
    row = F.struct(*df.columns)
    return sliced.groupBy("_slice").agg(F.min_by(row, order).alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = False, multiline: bool = False) -> DataFrame:
    """Delimited files under a declared schema. Bad values NULL the field, the raw row lands in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("sep", sep).option("quote", '"').option("escape", '"') \
        .option("header", str(header).lower()).option("multiLine", str(multiline).lower()).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_corrupt_record").csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line; a document indented over several lines does not read and shows up as corrupt rows."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def beats_fields(c: Column) -> dict[str, Column]:
    """Raw line and origin of a Beats JSON event."""
    leaf = lambda p: F.get_json_object(c, p)
    return {"value": leaf("$.message"), "host": F.coalesce(leaf("$.host.name"), leaf("$.agent.hostname")),
            "file": leaf("$.log.file.path"), "shipper": leaf("$.agent.type"), "sent_at": leaf("$['@timestamp']").try_cast("timestamp")}


def kafka_options(servers: str, topics: list[str], user: str | None = None, password: str | None = None,
                  starting: str = "earliest") -> dict[str, str]:
    options = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": starting, "failOnDataLoss": "false"}
    if user:
        options |= {"kafka.security.protocol": "SASL_SSL", "kafka.sasl.mechanism": "PLAIN",
                    "kafka.sasl.jaas.config": "org.apache.kafka.common.security.plain.PlainLoginModule required "
                                              f'username="{user}" password="{password}";'}
    return options


def read_kafka(spark: SparkSession, options: dict[str, str], schema: str | None = None, stream: bool = True) -> DataFrame:
    """Topic records as text lines, or parsed with ``schema`` when they are JSON. Needs the Kafka package on the classpath."""
    reader = (spark.readStream if stream else spark.read).format("kafka").options(**options)
    rows = reader.load().select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("received_at"))
    return rows.withColumn("data", F.from_json("value", schema)) if schema else rows


def read_jdbc_since(spark: SparkSession, url: str, table: str, tracking: str, last_value: int | None = None, driver: str | None = None,
                    bounds: tuple[int, int] | None = None, partitions: int = 1) -> DataFrame:
    """Rows beyond the tracking column's stored value. The predicate is pushed to the database; with ``bounds`` the read is parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if driver:
        reader = reader.option("driver", driver)
    if bounds:
        reader = reader.option("partitionColumn", tracking).option("lowerBound", str(bounds[0])) \
            .option("upperBound", str(bounds[1])).option("numPartitions", str(partitions))
    df = reader.load()
    return df.where(F.col(tracking) > last_value) if last_value is not None else df


def high_water_mark(df: DataFrame, tracking: str) -> int | None:
    return df.agg(F.max(tracking)).first()[0]


# how many lines are held as a list at once
_LINES_AT_ONCE = 1 << 13


def assemble_records(lines: DataFrame, is_start: Column, part: list[str], order: str, value: str = "value",
                     max_lines: int | None = None) -> DataFrame:
    """Lines joined into records: a start line and the continuations after it.

    ``part`` names what a record cannot cross except to continue the previous
    block: ``[file]`` or ``[file, block]`` with the block last. Lines before
    the first start of a file stay records of their own, flagged in
    ``parse_errors``. A record has any number of lines; a caller who would
    rather have runaway records in pieces gives ``max_lines``, and each piece
    is flagged.
    """
    flagged, max_lines = max_lines is not None, max_lines or 1 << 62
    file, block = part[:-1] if len(part) > 1 else part, part[-1] if len(part) > 1 else None
    lines = lines.withColumn("_start", F.coalesce(is_start, F.lit(False)).cast("int"))
    local = Window.partitionBy(*part).orderBy(order)
    marked = lines.withColumns({"_n": F.sum("_start").over(local.rowsBetween(Window.unboundedPreceding, 0)),
                                "_i": F.row_number().over(local)})
    if block:
        blocks = lines.groupBy(*part).agg(F.sum("_start").alias("_starts"), F.count(F.lit(1)).alias("_len"))
        prior = Window.partitionBy(*file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        carried = blocks.withColumn("_at", F.when(F.col("_starts") > 0, F.struct(F.col(block).alias("b"), F.col("_starts").alias("n")))) \
            .select(*part, F.last("_at", ignorenulls=True).over(prior).alias("_prev"))
        marked = marked.join(carried, part)
        home = F.when(F.col("_n") > 0, F.struct(F.col(block).alias("b"), F.col("_n").alias("n"))).otherwise(F.col("_prev"))
    else:
        home = F.when(F.col("_n") > 0, F.struct(F.lit(0).cast("bigint").alias("b"), F.col("_n").alias("n")))
    # Without a start the line is its own record.
    loose = F.struct(F.lit(-1).cast("bigint").alias("b"), F.col("_i").cast("bigint").alias("n"))
    rec = marked.withColumn("_home", home).withColumn("_loose", F.col("_home").isNull()) \
        .withColumn("_home", F.when(F.col("_loose"), loose).otherwise(
            F.struct(F.col("_home.b").cast("bigint").alias("b"), F.col("_home.n").cast("bigint").alias("n"))))
    first_line = F.min("_i").over(Window.partitionBy(*part, "_home"))
    rec = rec.withColumn("_piece", F.floor((F.col("_i") - first_line) / max_lines))
    # A piece is cut inside its block and joined by slices, so no list is longer than a slice, however long the record is.
    rec = rec.withColumn("_slice", F.floor((F.col("_i") - first_line) % max_lines / _LINES_AT_ONCE))
    piece = [*file, "_home", *([block] if block else []), "_piece"]
    slices = rec.groupBy(*piece, "_slice").agg(
        F.when(F.count(value) > 0, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda s: s["v"]), "\n")).alias("_text"),
        F.count(F.lit(1)).alias("_size"), F.bool_or("_loose").alias("_loose"))
    # Pieces of one record: those of its first block and, when short, the heads of the blocks after it.
    rank = Window.partitionBy(*file, "_home").orderBy(*piece[len(file) + 1:], "_slice")
    sizes = slices.withColumn("_before", F.coalesce(F.sum("_size").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = F.floor(F.min("_before").over(Window.partitionBy(*piece)) / max_lines)
    joined = sizes.withColumn("_cut", cut).groupBy(*file, "_home", "_cut").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_before").alias("b"), F.col("_text").alias("t")))), lambda s: s["t"]), "\n").alias(value),
        F.sum("_size").alias("lines"), F.bool_or("_loose").alias("_loose"))
    errors = F.array_compact(F.array(F.when(F.col("_loose"), F.lit("_no_record_start")),
                                     F.when(F.lit(flagged) & ((F.col("_cut") > 0) | (F.col("lines") >= max_lines)), F.lit("_record_cut"))))
    return joined.select(*file, F.concat_ws(":", "_home.b", "_home.n", "_cut").alias("record"), value, "lines", errors.alias("parse_errors"))


def has_continuations(lines: DataFrame, start: str = EVENT_START, value: str = "value") -> DataFrame:
    """One row: some non-blank lines do not look like the start of an event although others do."""
    begins = F.col(value).rlike(start)
    return lines.where(F.trim(value) != "").agg(
        (F.bool_or(begins) & F.bool_or(~begins)).alias("multiline"), F.count_if(~begins).alias("continuations"))


_UUID = "-".join(f"[0-9a-fA-F]{{{n}}}" for n in (8, 4, 4, 4, 12))
_CLASSES = (("U", r"\p{Lu}", "[A-Z]"), ("L", r"\p{Ll}", "[a-z]"), ("D", r"\d", r"\d"))


def _first_token(value: Column, separator: str) -> Column:
    """The first cell of the first line, without the quotes around it."""
    line = F.substring_index(value, "\n", 1)
    token = F.trim(F.substring_index(line, separator, 1))
    return F.when(line.contains(separator), F.regexp_replace(token, '^"|"$', ""))


def _token_shape(token: Column) -> Column:
    """The character classes of a token, one letter each; other characters stand for themselves."""
    shape = token
    for letter, rx, _ in _CLASSES:
        # classes become control characters first, so that their letters are not read again
        shape = F.regexp_replace(shape, rx, chr(ord(letter) - 64))
    return shape


def _shape_pattern(shape: str) -> str | None:
    """A regular expression of a shape, if it is more than free text may look like: four characters, one of them a digit."""
    if len(shape) < 4 or chr(ord("D") - 64) not in shape or any(c.isalpha() for c in shape):
        return None
    out, names = "", {chr(ord(letter) - 64): rx for letter, _, rx in _CLASSES}
    for c, run in itertools.groupby(shape):
        n, rx = len(list(run)), names.get(c) or re.escape(c)
        out += rx if n == 1 else f"{rx}{{{n}}}"
    return out


def start_candidates(records: DataFrame, separator: str = ",", value: str = "value") -> list[str]:
    """How the first cells of all records look, the most specific first: an id of fixed form, a date of a known format, a shape, a number.

    Lengths and shapes come out of the data, in one aggregation.
    """
    token = _first_token(F.col(value), separator)
    fits = lambda rx: F.bool_and(F.coalesce(F.col("_t").rlike(f"^(?:{rx})$"), F.lit(False)))
    hexes = F.col("_t").rlike("^[0-9a-fA-F]{8,}$")
    row = records.select(token.alias("_t")).select("_t", _token_shape(F.col("_t")).alias("_s")).agg(
        fits(_UUID).alias("uuid"), F.bool_and(F.coalesce(hexes, F.lit(False))).alias("hex"), F.min(F.length("_t")).alias("lo"), F.max(F.length("_t")).alias("hi"),
        F.min("_s").alias("first"), F.max("_s").alias("last"), F.count_if(F.col("_t").isNull() | (F.col("_t") == "")).alias("without"), fits(r"\d+").alias("digits"),
        *[fits(d.shape).alias(f"d{i}") for i, d in enumerate(dates.DATE_FORMATS)]).first()
    if row["without"] or row["lo"] is None:
        return []
    shape = _shape_pattern(row["first"]) if row["first"] == row["last"] else None
    found = [_UUID if row["uuid"] else None, f"[0-9a-fA-F]{{{row['lo']}}}" if row["hex"] and row["lo"] == row["hi"] and not row["digits"] else None,
             *[d.shape if row[f"d{i}"] else None for i, d in enumerate(dates.DATE_FORMATS)], shape, r"\d+" if row["digits"] else None]
    return [f for f in found if f]


def record_start(records: DataFrame, separator: str = ",", value: str = "value") -> DataFrame:
    """One row: the first start regex that fits the first line of every record and none of its continuations."""
    sep = {"|": r"\|", "\t": r"\t"}.get(separator, separator)
    lines = F.split(F.col(value), "\n")
    options = []
    for shape in start_candidates(records, separator, value):
        rx = rf'^"?{shape}"?{sep}'
        fits = F.get(lines, 0).rlike(rx) & ~F.exists(F.slice(lines, F.lit(2), F.size(lines)), lambda x: x.rlike(rx))  # noqa: B023
        options.append(F.when(F.bool_and(fits), F.lit(rx)))
    return records.agg(F.coalesce(*options, F.lit(None).cast("string")).alias("start"))


def quoted_records(lines: DataFrame, part: list[str], order: str, value: str = "value") -> DataFrame:
    """Records of a delimited text with line breaks inside quotes: a line starts one when the quotes before it are balanced.

    The running number of quotes is carried from block to block; an unfinished tail is kept and flagged in ``parse_errors``.
    """
    file, block = (part[:-1], F.col(part[-1])) if len(part) > 1 else (part, F.lit(0))
    quotes = F.length(value) - F.length(F.replace(F.col(value), F.lit('"'), F.lit("")))
    counted = lines.withColumn("_q", quotes)
    running = chunked_scan(counted, file, order, block, _run=("sum", "_q"))
    marked = running.withColumn("_open", (F.col("_run") - F.col("_q")) % 2 == 1).drop("_q", "_run")
    joined = assemble_records(marked, ~F.col("_open"), part, order, value)
    unfinished = F.when(quotes % 2 == 1, F.array(F.lit("_record_unfinished"))).otherwise(F.array().cast("array<string>"))
    return joined.withColumn("parse_errors", F.concat("parse_errors", unfinished))


def decode_avro(c: Column, schema: str) -> Column:
    """Avro payloads; needs the spark-avro package."""
    from pyspark.sql.avro.functions import from_avro
    return from_avro(c, schema)


def decode_protobuf(c: Column, message: str, descriptor: str) -> Column:
    """Protobuf payloads; needs the spark-protobuf package."""
    from pyspark.sql.protobuf.functions import from_protobuf
    return from_protobuf(c, message, descriptor)


def cloud_trail_records(df: DataFrame, value: str = "value") -> DataFrame:
    """One row per record of an audit file whose JSON holds a ``Records`` array."""
    return df.select(F.explode_outer(F.from_json(F.get_json_object(value, "$.Records"), "array<string>")).alias(value))


def split_json_array(df: DataFrame, value: str = "value") -> DataFrame:
    """An array becomes one row per item; a single object passes through."""
    is_array = F.ltrim(value).startswith("[")
    items = F.when(is_array, F.from_json(F.col(value), "array<string>")).otherwise(F.array(F.col(value)))
    others = [c for c in df.columns if c != value]
    return df.select(*others, F.explode_outer(items).alias(value))


def bulk_actions(lines: DataFrame, order: str, value: str = "value") -> DataFrame:
    """Bulk-format lines: an action line is followed by its document. Pairs by parity of a line number."""
    n = F.col(order)
    action = F.when(n % 2 == 0, F.col(value))
    return lines.groupBy(F.floor(n / 2).alias("pair")).agg(F.max(action).alias("action"), F.max(F.when(n % 2 == 1, F.col(value))).alias("document"))


# The layout of a flow export packet of version 5, name and bytes of each field in order.
FLOW_HEADER = (("version", 2), ("count", 2), ("uptime_ms", 4), ("seconds", 4), ("nanoseconds", 4), ("sequence", 4), ("engine_type", 1), ("engine_id", 1), ("sampling", 2))
FLOW_RECORD = (("source", 4), ("destination", 4), ("next_hop", 4), ("input", 2), ("output", 2), ("packets", 4), ("octets", 4), ("first_ms", 4), ("last_ms", 4), ("source_port", 2),
               ("destination_port", 2), ("pad1", 1), ("tcp_flags", 1), ("protocol", 1), ("tos", 1), ("source_as", 2), ("destination_as", 2), ("source_mask", 1), ("destination_mask", 1), ("pad2", 2))
_ADDRESSES = ("source", "destination", "next_hop")


def _fields(payload: Column, start: Column, layout) -> list[Column]:
    """Big-endian numbers of a fixed layout that begins at the byte ``start`` (from 0)."""
    out, at = [], 0
    for name, size in layout:
        number = F.conv(F.hex(F.substring(payload, start + (at + 1), F.lit(size))), 16, 10).cast("bigint")
        if name in _ADDRESSES:
            octets = [F.floor(number / 256 ** k).cast("bigint") % 256 for k in (3, 2, 1, 0)]
            number = F.concat_ws(".", *[o.cast("string") for o in octets])
        if not name.startswith("pad"):
            out.append(number.alias(name))
        at += size
    return out


def flow_records(df: DataFrame, payload: str = "value") -> DataFrame:
    """One row for each flow of the packets of version 5 in a binary column: ``packet`` (sequence, seconds, whole) and the flow's fields.

    A packet that is cut off has the flows that are whole, and ``whole`` false; payloads of other versions give one row with
    ``whole`` false and no flow.
    """
    head, one = sum(n for _, n in FLOW_HEADER), sum(n for _, n in FLOW_RECORD)
    others = [c for c in df.columns if c != payload]
    header = df.select(*others, F.col(payload).alias("_p"), F.struct(*_fields(F.col(payload), F.lit(0), FLOW_HEADER)).alias("_h"))
    held = F.greatest(F.lit(0), F.least(F.col("_h.count"), F.floor((F.length("_p") - head) / one)))
    is_five = F.coalesce((F.col("_h.version") == 5) & (F.length("_p") >= head), F.lit(False))
    places = F.when(is_five & (held > 0), F.sequence(F.lit(0).cast("bigint"), held.cast("bigint") - 1))
    rows = header.withColumns({"packet": F.struct(F.col("_h.sequence").alias("sequence"), F.col("_h.seconds").alias("seconds"), (is_five & (held == F.col("_h.count"))).alias("whole")), "_i": places})
    rows = rows.select(*others, "packet", "_p", F.explode_outer("_i").alias("_i"))
    return rows.select(*others, "packet", *_fields(F.col("_p"), (F.col("_i") * one + head).cast("int"), FLOW_RECORD))
