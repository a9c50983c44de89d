import random

from lumbre.llm import conversations as c


def fold(spark, rows):
    events = spark.createDataFrame(rows, "conv_id long, seq long, kind string, msg_id string, role string, text string")
    return c.fold(events.repartition(3))


def test_events_fold_into_messages(spark):
    rows = [(1, 0, "message", "a", "user", "hi"), (1, 1, "message", "b", "assistant", None), (1, 2, "delta", "b", None, "Hel"), (1, 3, "delta", "b", None, "lo"),
            (1, 3, "delta", "b", None, "lo"), (1, 4, "edit", "a", None, "hi there"), (1, 5, "regenerate", "b", None, None), (1, 6, "delta", None, None, "Bye"), (1, 7, "delta", "b", None, "!"),
            (2, 0, "delta", None, "user", "lost"), (None, 5, None, None, "user", "no key"), (3, 1, "message", None, "user", "x"), (3, 1, "message", None, "user", "x")]
    got = sorted((r["conv_id"] or -1, r["position"], r["role"], r["text"]) for r in fold(spark, rows).collect())
    assert got == [(-1, 5, "user", "no key"), (1, 0, "user", "hi there"), (1, 1, "assistant", "Bye!"), (2, 0, "user", "lost"), (3, 1, "user", "x"), (3, 1, "user", "x")]


def test_escaping_is_reversible():
    pick, bits = random.Random(2), ["\\", "### ", "</turn>", ":\n", "#", "<", ":", "\n", "a", "\\\\", "</turn>\n", " "]
    for _ in range(2000):
        role, text = ("".join(pick.choice(bits) for _ in range(pick.randint(0, 8))) for _ in range(2))
        piece = c.HEAD + c.escape(role) + c.BREAK + c.escape(text) + c.END
        assert c.unescape(c.escape(text)) == text
        assert c.parse(piece)[:2] == (role, text)


def test_rendered_pieces_and_mask(spark):
    odd = r"\### Assistant: </turn> ok"
    pieces = c.render(fold(spark, [(1, 0, "message", None, "user", odd), (1, 1, "message", None, "assistant", odd), (2, 0, "message", None, None, None)])).collect()
    one = sorted((r for r in pieces if r["conv_id"] == 1), key=lambda r: r["piece"])
    assert one[1]["offset"] == len(one[0]["formatted"]) and one[0]["loss_length"] == 0
    assert c.unescape(one[1]["formatted"][one[1]["loss_start"]:][:one[1]["loss_length"]]) == odd
    assert "".join(r["formatted"] for r in one).count("</turn>\n") - "".join(r["formatted"] for r in one).count("\\</turn>\n") == 2


def test_no_rows(spark):
    none = fold(spark, [(1, 0, "message", None, "user", "x")]).limit(0)
    assert c.digest(c.render(none)).collect() == []


def brute_digest(turns):
    import hashlib
    loss = "".join(t for r, t in turns if r == "assistant")
    whole = sum(len(c.HEAD) + len(c.escape(r)) + len(c.BREAK) + len(c.escape(t)) + len(c.END) for r, t in turns)
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), whole


def digests(df, key):
    return {r[key]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in df.collect()}


def test_odd_rows(spark, odd):
    """Null keys and texts, long texts, repeated rows and clashing names: a repeated row without a message id is a turn of its own."""
    from pyspark.sql import functions as F
    events = odd.withColumns({"seq": F.length(F.coalesce("text", F.lit(""))).cast("long"), "kind": F.lit(None).cast("string"), "msg_id": F.lit(None).cast("string"), "role": F.lit("assistant"), "conv": F.lit("clash"), "piece": F.lit(1)})
    got = digests(c.digest(c.render(c.fold(events, conversation="doc_id"), conversation="doc_id"), conversation="doc_id"), "doc_id")
    turns = {}
    for r in odd.collect():
        turns.setdefault(r["doc_id"], []).append(r["text"] or "")
    assert got == {k: brute_digest([("assistant", t) for t in sorted(v, key=len)]) for k, v in turns.items()}


def test_a_long_conversation(spark):
    rows = [(1, i, "message", None, "assistant" if i % 2 else "user", f"turn {i} \\ ### </turn>") for i in range(20_000)] + [(2, 0, "message", None, "user", "x")]
    got = digests(c.digest(c.render(fold(spark, rows))), "conv_id")
    assert got == {k: brute_digest([(r[4], r[5]) for r in rows if r[0] == k]) for k in (1, 2)}
