"""Chat logs as events, folded into final messages and rendered with a loss mask.

A log holds events of conversations, ordered by a sequence number.  ``fold`` gives one row per message after all deltas,
edits and regenerations; ``render`` writes each message in a template that marks turns, with control strings inside texts
escaped; ``parse`` reads rendered pieces back.  Formatting and reading happen where the rows are; what runs along a
conversation (the last message id, numbers, offsets) is scanned by slices of the sequence, and only its digest is one stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumbre.llm import scan
from lumbre.operators.scan import chunked_scan

HEAD, BREAK, END, MASKED = "### ", ":\n", "</turn>\n", "assistant"
# A backslash stands before every control string, and before every backslash, inside a role or a text.
_CONTROL = re.compile(r"\\|### |</turn>|:\n")
_ESCAPED = re.compile(r"\\(\\|### |</turn>|:\n)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def fold(events: DataFrame, conversation: str = "conv_id", sequence: str = "seq", kind: str = "kind", message: str = "msg_id",
         role: str = "role", text: str = "text") -> DataFrame:
    """Final messages: the conversation column, ``position`` (sequence number of its first event), ``role``, ``text``.

    Kinds: ``message`` (or null) sets role and text, ``edit`` replaces the text, ``regenerate`` empties it and starts it anew
    with its own text, ``delta`` appends.  An event without a message id belongs to the message before it in its
    conversation.  Texts are joined in order of sequence number, ties by kind and text; null texts are empty; a repeated
    event (equal in all columns) counts once, but messages without an id are all kept.  Events before the first message of a conversation make one of their own.
    The role is that of the first event that has one, else empty.  A null conversation is a conversation.
    """
    e = events.select(F.col(conversation).alias("conv"), F.col(sequence).cast("long").alias("seq"), F.coalesce(F.col(kind), F.lit("message")).alias("kind"),
                      F.col(message).cast("string").alias("msg"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    e = e.groupBy(*e.columns).agg(F.count("*").alias("n"))
    e = e.withColumn("n", F.when(F.col("msg").isNull() & (F.col("kind") == "message"), F.col("n")).otherwise(F.lit(1)))
    # an event without an id takes the id of the last one before it that has one, by slices of the sequence
    own = F.when(F.col("msg").isNull() & (F.col("kind") == "message"), F.concat(F.lit("#"), F.col("seq").cast("string"), F.lit("/"), F.xxhash64("role", "text").cast("string"))).otherwise(F.concat(F.lit("="), "msg"))
    e = e.withColumns({"own": own, "_key": _key(), "_order": F.struct("seq", "kind", "text", "role")})
    e = chunked_scan(e, ["_key"], "_order", _slice("seq"), _msg=("last", "own")).withColumn("msg", F.coalesce("_msg", F.lit(""))).drop("_msg", "own", "_key", "_order")
    starts = F.col("kind") != "delta"
    last = e.groupBy("conv", "msg").agg(F.max(F.when(starts, F.col("seq"))).alias("reset"))
    e = e.join(last.withColumnRenamed("conv", "c").withColumnRenamed("msg", "m"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("msg") == F.col("m")), "left")
    live = (F.col("reset").isNull() | F.col("seq").isNull() | (F.col("seq") >= F.col("reset")))
    part = F.when(live, F.struct("seq", (F.col("kind") == "delta").alias("later"), "text"))
    said = F.aggregate(F.array_sort(F.collect_list(part)), F.lit(""), lambda done, x: F.when(x["later"], F.concat(done, x["text"])).otherwise(x["text"]))
    first = F.min_by("role", F.when(F.col("role").isNotNull(), F.struct(F.coalesce("seq", F.lit(-(1 << 63))), "role")))
    return (e.groupBy("conv", "msg").agg(F.min("seq").alias("position"), F.coalesce(first, F.lit("")).alias("role"), said.alias("text"), F.max("n").alias("n"))
            .select(F.col("conv").alias(conversation), "position", "msg", "role", "text", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")).drop("copy"))


#: sequence numbers in one slice of a conversation
SLICE = 4096


def _key():
    """The conversation as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))


def _slice(position: str):
    return F.floor(F.coalesce(F.col(position), F.lit(-(1 << 62))) / SLICE)


def render(messages: DataFrame, conversation: str = "conv_id", masked: str = MASKED) -> DataFrame:
    """One piece for each message of ``fold``: the conversation column, ``piece`` (from 0), ``formatted``, ``offset`` (code points of the
    pieces before it), ``loss_start`` and ``loss_length`` (code points of ``formatted`` under the loss mask; 0 if none).

    A conversation's output is its pieces in order.  Only texts of the role ``masked`` are under the mask, whole.  Messages are
    formatted where they are; numbers and offsets are running sums over slices, so a long conversation is many tasks' work.
    """
    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
            head, body = HEAD + escape(role) + BREAK, escape(text)
            out.append((head + body + END, len(head) if role == masked else 0, len(body) if role == masked else 0, len(head) + len(body) + len(END)))
        columns = list(zip(*out)) if out else [()] * 4
        return [pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]]

    rows = messages.select(F.col(conversation).alias("conv"), "position", "msg", "role", "text")
    same = F.row_number().over(Window.partitionBy("conv", "position", "msg").orderBy("role", "text"))  # copies of a message without id
    rows = rows.withColumn("copy", same)
    rows = scan.append_columns(rows, run, [("formatted", "string"), ("loss_start", "long"), ("loss_length", "long"), ("length", "long")]).drop("role", "text")
    rows = rows.withColumns({"_key": _key(), "_order": F.struct("position", "msg", "copy"), "one": F.lit(1)})
    rows = chunked_scan(rows, ["_key"], "_order", _slice("position"), piece=("sum", "one"), upto=("sum", "length"))
    return rows.select(F.col("conv").alias(conversation), (F.col("piece") - 1).alias("piece"), "formatted", (F.col("upto") - F.col("length")).alias("offset"), "loss_start", "loss_length")


_TURN = re.compile(r"### ((?:[^\\#<:]|\\(?:\\|### |</turn>|:\n)|\\|#(?!## )|<(?!/turn>)|:(?!\n))*):\n((?:[^\\#<:]|\\(?:\\|### |</turn>|:\n)|\\|#(?!## )|<(?!/turn>)|:(?!\n))*)</turn>\n", re.S)


def parse(piece: str) -> tuple[str, str, int, int]:
    """Role, text, and where the escaped text stands in a rendered piece."""
    found = _TURN.fullmatch(piece)
    if not found:
        raise ValueError(f"not a rendered turn: {piece[:80]!r}")
    return unescape(found[1]), unescape(found[2]), found.start(2), found.end(2)


def digest(pieces: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Read rendered pieces back: turns, digest of all turns, and length and digest of the texts under the loss mask, by conversation.

    Pieces are read where they are.  A digest takes its bytes in order, so what is left to one task a conversation is to sort them
    (which spills) and to hash.
    """
    kind = pieces.schema[conversation].dataType

    def read(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for formatted, start, length in zip(*(batch.column(c).to_pylist() for c in ("formatted", "loss_start", "loss_length"))):
            role, text, _, _ = parse(formatted)
            under = unescape(formatted[start:start + length])
            out.append((f"{role}\n{text}\n".encode(), under.encode(), len(under), len(formatted)))
        columns = list(zip(*out)) if out else [()] * 4
        return [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())]

    rows = pieces.select(F.col(conversation).alias("conv"), "piece", "formatted", "loss_start", "loss_length")
    rows = scan.append_columns(rows, read, [("turn", "binary"), ("under", "binary"), ("n_under", "long"), ("n_formatted", "long")]).select("conv", "piece", "turn", "under", "n_under", "n_formatted")
    rows = rows.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "piece")
    names = ("conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    schema = pa.schema(list(zip(names, (to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))))

    def run(batches) -> Iterator[pa.RecordBatch]:
        state, out = None, []

        def close():
            if state:
                out.append((state["conv"], state["n"], state["turns"].hexdigest(), state["loss"], state["masked"].hexdigest(), state["chars"]))

        def drain():
            columns = list(zip(*out)) if out else [()] * 6
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        for batch in batches:
            for conv, _, turn, under, n_under, n_formatted in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != state["conv"]:
                    close()
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": 0, "masked": hashlib.sha256(), "chars": 0}
                state["n"] += 1
                state["turns"].update(turn)
                state["masked"].update(under)
                state["loss"] += n_under
                state["chars"] += n_formatted
            yield drain()
        close()
        yield drain()

    out = rows.mapInArrow(run, f"conv {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("conv", conversation)
