import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lumbre.llm import fingerprints, urls
from lumbre.llm.queries import QUERIES, RULES

BASE = "/root/testdata/sf0.001"


def brute_url(u):
    host = path = ""
    if u and "://" in u:
        x = u.split("://", 1)[1]
        k = min([x.find(c) for c in "/?#" if c in x] + [len(x)])
        host, y = x[:k], x[k:]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        path = y[:min([y.find(c) for c in "?#" if c in y] + [len(y)])]
    fits = [(len(r), r, v) for r, v in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules(spark):
    made = ["https://WWW.Example.com/en/1?x#y", "http://example.com/en/", "http://a.example.com/en/b", "http://x.net/fr/1", "http://net/es/", "http://x.net/de/1", "x.com/a", None, "", "a://b.com",
            "a://b.com?q=/x", "://é.COM/ü", "http://notexample.com/en/1", "http://com/x", "http://h.com//a", "ftp://u@h.com:80/p"]
    rows = spark.createDataFrame([(i, u, None) for i, u in enumerate(made)], "page_id long, url string, bad int")
    for r in urls.judge(rows, RULES).collect():
        host, path, rule, verdict = brute_url(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or "allow")


def test_all_pages(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{BASE}/pages.parquet").collect()}
    got = QUERIES["op1_url_filters"](spark, BASE).collect()
    assert len(got) == len(pages)
    for r in got:
        want = brute_url(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == want[:3] and r["verdict"] in ("allow", "block") and want[3] in (None, r["verdict"])


def test_templates_block_what_is_bad(spark):
    rows = [(f"http://h.org/news/{i}", 0) for i in range(40)] + [(f"http://h.org/spam/{i}.html", 1) for i in range(40)] + [(f"http://h.org/spam/{i}", None) for i in range(900, 910)]
    rows += [(f"http://h.org/{w}/x", 0) for w in ("a", "b", "c")] + [(f"http://other.org/{i}", None) for i in range(20)]
    got = urls.judge(spark.createDataFrame(rows, "url string, bad int"), []).collect()
    by = {r["url"]: r for r in got}
    assert len(got) == len(rows)
    assert by["http://h.org/spam/905"]["verdict"] == "block" and by["http://h.org/news/3"]["verdict"] == "allow" and by["http://other.org/3"]["verdict"] == "allow"
    assert by["http://h.org/a/x"]["template"] == by["http://h.org/b/x"]["template"] == "/*/*"
    assert by["http://h.org/news/3"]["template"] == by["http://h.org/news/30"]["template"]


def test_a_small_section_of_a_large_host_splits(spark):
    rows = [(f"http://h.org/{chr(97 + k % 26)}{chr(97 + k // 26)}/{i}", 0) for k in range(60) for i in range(60)] + [(f"http://h.org/worst/{i}", 1) for i in range(30)]
    got = urls.judge(spark.createDataFrame(rows, "url string, bad int"), []).collect()
    assert {r["verdict"] for r in got if r["bad"]} == {"block"} and {r["verdict"] for r in got if not r["bad"]} == {"allow"}


def test_the_tree_grows_to_the_segment_that_differs(spark):
    tails = [a + b for a in "cdefghij" for b in "klmno"]
    rows = [(f"http://h.org/a/b/c/d/e/{kind}/{t}", bad) for kind, bad in (("good", 0), ("worst", 1)) for t in tails]
    got = urls.judge(spark.createDataFrame(rows, "url string, bad int"), []).collect()
    assert {r["template"] for r in got} == {"/*/*/*/*/*/good/*", "/*/*/*/*/*/worst/*"}
    assert all((r["verdict"] == "block") == bool(r["bad"]) for r in got)


def test_url_odd_rows(odd):
    rows = odd.withColumn("url", F.concat(F.lit("http://h.org/"), "text")).withColumn("bad", F.lit(None).cast("int"))
    got = urls.judge(rows, RULES)
    assert got.count() == odd.count() and {"row", "key", "t", "kept"} <= set(got.columns)
    assert urls.judge(rows.limit(0), RULES).collect() == []


def test_fingerprints(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in QUERIES["op10_document_fingerprints"](spark, BASE).collect()}
    assert len(got) == len(docs)
    by_text = {}
    for k, (i, t) in enumerate(docs):
        n, nxt = len(t), docs[(k + 1) % len(docs)]
        edited = t[:n - n // 4] + nxt[1][:n // 4]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_next"] <= 1 and (r["near_next"] == 1) == (r["fingerprint"] == got[nxt[0]]["fingerprint"])
    assert sum(r["near_edited"] for r in got.values()) / len(got) > 0.4 > 0.1 > sum(r["near_next"] for r in got.values()) / len(got)


def test_fingerprints_of_odd_rows(odd, no_rows, spark):
    rows = fingerprints.compare_with_next(odd).collect()
    assert len(rows) == odd.count()
    same = [r for r in rows if r["doc_id"] == 1]
    assert len(same) == 2 and same[0] == same[1]
    blank = {r["doc_id"]: r for r in rows if r["doc_id"] in (2, 3)}
    assert blank[2]["fingerprint"] == blank[3]["fingerprint"] and blank[2]["near_next"] == 1
    assert fingerprints.compare_with_next(no_rows).collect() == []
    one = fingerprints.compare_with_next(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).collect()[0]
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def _mixed(spark, hot):
    """Texts of many subjects, with the texts ``hot`` between them."""
    pick = random.Random(6)
    pool = [f"term{i}" for i in range(400)]
    texts = [*hot, *(" ".join(pick.sample(pool, 40)) for _ in range(60))]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_copies_do_not_push_terms_out_of_the_lexicon(spark):
    hot = " ".join(f"hot{i}" for i in range(40))
    known = {r["term"] for r in fingerprints.lexicon(_mixed(spark, [hot] * 30)).collect()}
    assert {r["h"] for r in spark.createDataFrame([(w,) for w in hot.split()], "w string").select(F.xxhash64("w").alias("h")).collect()} <= known


@pytest.mark.parametrize("copies, options", [(30, {}), (2, {"low": 0.1, "high": 0.9})])
def test_near_copies_with_terms_outside_the_lexicon(spark, copies, options):
    shared = [f"hot{i}" for i in range(60)]
    hot = [" ".join(w for j, w in enumerate(shared) if j != i) for i in range(copies)]
    got = {r["doc_id"]: r for r in fingerprints.compare_with_next(_mixed(spark, hot), **options).collect()}
    assert all(got[i]["near_next"] > 0.5 for i in range(copies - 1)) and all(got[i]["near_edited"] > 0.2 for i in range(copies))
    assert sum(got[i]["near_next"] for i in range(copies - 1, copies + 59)) / 60 < 0.2


@pytest.mark.parametrize("name", ["op1_url_filters", "op10_document_fingerprints"])
def test_no_python_in_the_plans(spark, name):
    import io
    from contextlib import redirect_stdout

    out = io.StringIO()
    with redirect_stdout(out):
        QUERIES[name](spark, BASE).explain()
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue()


def brute_templates(rows, support=5, least_z=2.58):
    """The tree level by level, in plain Python: {(host, shape): template}."""
    live = {}
    for host, shape, n, labelled, bad in rows:
        live[host, shape] = [shape.split("/"), "", n, labelled, bad]
    for level in range(max((len(x[0]) for x in live.values()), default=0)):
        nodes = {}
        for key, x in live.items():
            if len(x[0]) >= level:
                nodes.setdefault((key[0], x[1]), []).append(x)
        for members in nodes.values():
            pl, pb = sum(x[3] for x in members), sum(x[4] for x in members)
            rate = (pb + 0.5) / (pl + 1)
            groups = {}
            for x in members:
                if len(x[0]) > level:
                    groups.setdefault(x[0][level], []).append(x)
            for segment, group in groups.items():
                n, lab, b = (sum(x[i] for x in group) for i in (2, 3, 4))
                apart = n >= support and abs(b - lab * rate) / (max(lab, 1) * rate * (1 - rate)) ** 0.5 >= least_z
                for x in group:
                    x[1] += "/" + (segment if apart else "*")
    return {key: x[1] for key, x in live.items()}


def test_trees_equal_a_plain_one(spark):
    """Branches at several depths, chains with ends on the way, shapes that end early."""
    pick, rows = random.Random(11), []
    for i in range(1500):
        host = pick.choice(["a.org", "b.org"])
        depth = pick.randint(1, 6)
        path = [pick.choice("pqr")] + ["s"] * (depth - 1) if pick.random() < 0.5 else [pick.choice("pqrst") for _ in range(depth)]
        bad = None if pick.random() < 0.3 else int(pick.random() < (0.8 if "q" in path or len(path) > 4 else 0.1))
        rows.append((host, "/" + "/".join(path), bad))
    sums = {}
    for host, path, bad in rows:
        x = sums.setdefault((host, path[1:]), [0, 0, 0])
        x[0], x[1], x[2] = x[0] + 1, x[1] + (bad is not None), x[2] + (bad or 0)
    want = brute_templates([(*k, *v) for k, v in sums.items()])
    got = {(r["host"], r["shape"]): r["template"] for r in urls.templates(spark.createDataFrame(rows, "host string, path string, bad int")).collect()}
    assert got == want and len(set(want.values())) > 10


def test_a_path_of_very_many_segments(spark):
    """A trap in which every page links to a deeper one takes few jobs."""
    rows = [("h.org", "/" + "/".join(["loop"] * n), int(n > 1000)) for n in range(1, 2001, 7)] + [("h.org", f"/fine/{i}", 0) for i in range(30)]
    spark.sparkContext.setJobGroup("trap", "a spider trap")
    got = urls.templates(spark.createDataFrame(rows, "host string, path string, bad int")).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("trap")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 100 and len(got) == len({p for _, p, _ in rows}) - 29
    sums = {}
    for host, path, bad in rows:
        x = sums.setdefault((host, path[1:].replace("fine/" + path.rsplit("/", 1)[1], "fine/<n>") if "fine" in path else path[1:]), [0, 0, 0])
        x[0], x[1], x[2] = x[0] + 1, x[1] + 1, x[2] + bad
    want = brute_templates([(*k, *v) for k, v in sums.items()])
    assert {(r["host"], r["shape"]): r["template"] for r in got} == want
