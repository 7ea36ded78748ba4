"""Unit tables, properties and edge cases of the core library."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketlens.functions import exprs as X
from docketlens.operators import concentration, labelling, ordering, persistence, salted, sampling
from docketlens.plans import registry
from docketlens.plans.hot_keys import docket_totals
from docketlens.sources import harvest
from tests.conftest import CLASHING


def column(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_bins(spark):
    got = column(spark, [(n,) for n in (0, 10, 11, 100, 101, 1000, 1001, 10000, 10001, None)], "n long", X.comment_bin("n"))
    assert got == ["0-10", "0-10", "11-100", "11-100", "101-1000", "101-1000", "1001-10000", "1001-10000", "10000+", "10000+"]
    assert column(spark, [(n,) for n in (0, 1, 2, 6, 11, 51, 101, None)], "n long", X.volume_bin("n")) == [None, "1", "2-5", "6-10", "11-50", "51-100", "100+", None]
    assert column(spark, [(n,) for n in (9.9, 10.0, 25.0, 40.0, 60.0, None)], "n double", X.engagement_level("n")) == [0, 1, 2, 3, 4, 0]


def test_channel(spark):
    rows = [("x", None), (None, None), ("", ""), (None, "https://www.Regulations.gov/a"), (None, "https://ecfs.fcc.gov"), (None, "https://efiling.ferc.gov"), (None, "https://www.sec.gov/comments/1"), (None, "mailto:a@b.c"), (None, "http://x"), (None, "ftp://x")]
    assert column(spark, rows, "r string, u string", X.submission_channel("r", "u")) == ["regs.gov", "unknown", "unknown", "regs.gov", "fcc-ecfs", "ferc-portal", "sec-portal", "email", "other-portal", "unknown"]


def test_author_rules(spark):
    rows = [
        ("Acme Inc", None, None, None, None), ("Acme Inc", "", "", "", ""), (None, "A", "B", "EPA", None), (None, "A", None, None, "Business"), (None, "A", None, None, "INDIVIDUAL"),
        ("State University", "A", None, None, None), ("Smith Consulting", None, "B", None, None), ("Plain", "A", None, None, None), (None, None, None, None, None), ("Lincoln", None, None, None, None),
    ]
    org = X.WRITTEN_ORGANIZATION
    assert column(spark, rows, "o string, f string, l string, g string, t string", X.author_rule("o", "f", "l", "g", "t")) == [org, org, X.EXPERT, org, X.CITIZEN, X.EXPERT, X.EXPERT, None, None, org]


def test_hierarchy_and_replies(spark):
    rows = [(None,), ("",), ("A",), ("A, B",), ("A,B , C",)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "a string").select(X.main_agency("a"), X.sub_agency("a")).collect()]
    assert got == [("Unknown", None), ("Unknown", None), ("A", None), ("A", "B"), ("A", "B, C")]
    assert column(spark, [("Org.",), (None,), ("",), ("not undecided, citizen",), ("an EXPERT",), ("lobbyist",), ("?",)], "r string", X.reply_label("r")) == [X.WRITTEN_ORGANIZATION, X.UNDECIDED, X.UNDECIDED, X.UNDECIDED, X.EXPERT, X.LOBBYIST, X.UNDECIDED]


def test_text_functions(spark):
    rows = [(" a\n", None), (None, None), (" \t", "None"), ("x", "y")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(X.combined_text("a", "b")).collect()] == ["a", "", "", "x\n\ny"]
    assert [r[0] for r in df.select(X.has_text("a", "b")).collect()] == [True, False, True, True]
    assert column(spark, [("The Élan cat, a_dog will run",)], "t string", X.tokens("t")) == [["cat", "run"]]


def test_sample_size(spark):
    rows = [(5, 5), (9, 9), (10, 10), (25, 24), (100, 80), (384, 193), (1000, 278), (10000, 370), (100000, 383), (0, 0), (-1, 0)]
    got = column(spark, [(n,) for n, _ in rows], "n long", X.sample_size(F.col("n")))
    assert got == [k for _, k in rows]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=0, max_size=40))
def test_gini_and_thresholds(spark, counts):
    df = spark.createDataFrame([(c,) for c in counts], "c long")
    row = concentration.gini(concentration.value_counts(df, "c")).first()
    total, n = sum(counts), len(counts)
    if total <= 0:
        want = 0.0
    elif n == 1:
        want = 1.0
    else:
        y, run = [], 0
        for c in sorted(counts):
            run += c
            y.append(run / total)
        want = 1 - 2 * sum((a + b) / 2 for a, b in zip(y, y[1:])) / (n - 1)
    assert math.isclose(row["gini"], want, abs_tol=1e-9)
    if total > 0:
        t = concentration.thresholds(concentration.value_counts(df, "c")).first()
        run, y = 0, []
        for c in sorted(counts, reverse=True):
            run += c
            y.append(run)
        for p in (50, 80, 90, 95):
            k = min(sum(v < total * (p / 100) for v in y) + 1, n)
            assert math.isclose(t[f"docs_share_for_{p}pct_comments"], k / n)
        for p in (1, 5, 10):
            assert math.isclose(t[f"coverage_top_{p}pct_docs"], y[math.ceil(p / 100 * n) - 1] / total)


def test_ranked_and_smoothed(spark):
    rows = [(i, float(i % 7)) for i in range(101)]
    df = ordering.ranked(spark.createDataFrame(rows, "k long, v double").repartition(5), [F.col("k")], ["v"])
    got = {r["k"]: (r["rank"], r["cum_v"]) for r in df.collect()}
    assert all(got[i] == (i + 1, sum(v for _, v in rows[: i + 1])) for i in range(101))
    s = {r["rank"]: r["smooth_v"] for r in ordering.smoothed(df, ["v"], 0.05).collect()}
    clamp = lambda i: rows[min(max(i, 0), 100)][1]
    assert all(math.isclose(s[i + 1], sum(clamp(j) for j in range(i - 2, i + 3)) / 5) for i in range(101))
    assert ordering.ranked(df.select("k", "v").where("false"), [F.col("k")], ["v"]).count() == 0


def test_draws_are_exact_and_reproducible(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("k"))
    a = sampling.draw_per_group(df, ["g"], "k", F.lit(50)).collect()
    b = sampling.draw_per_group(df.repartition(7), ["g"], "k", F.lit(50)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 150
    assert sampling.weighted_draw(df.withColumn("w", F.lit(1.0)), "k", "w", 20).count() == 20


def test_salted_totals(spark, comments):
    rows = [{"document_number": "hot" if i % 3 else f"d{i}", "comment_id": f"c{i // 2}", "comment_text": "x" * (i % 5) or None, "posted_date": f"2020-01-{1 + i % 28:02d}", **{c: "z" for c in CLASHING}} for i in range(900)]
    rows += [{"comment_id": None}, {"document_number": "d0", "comment_id": None, "comment_text": "long " * 20000}]
    dockets = spark.createDataFrame([("hot", 5, "x"), ("d0", None, "y")], "document_number string, comment_count long, n string")
    got = {r["document_number"]: r for r in docket_totals(comments(rows, CLASHING), dockets).collect()}
    plain = {}
    for r in rows:
        if r.get("document_number"):
            plain.setdefault(r["document_number"], {}).setdefault(r.get("comment_id") or "", []).append(len(r.get("comment_text") or ""))
    assert got.keys() == plain.keys()
    for key, by_id in plain.items():
        assert (got[key]["n_rows"], got[key]["n_comments"], got[key]["text_chars"]) == (sum(map(len, by_id.values())), len(by_id), sum(map(max, by_id.values())))
    assert got["hot"]["comment_count"] == 5 and got["d0"]["longest_text"] == 100000
    assert docket_totals(comments([]), dockets).count() == 0
    assert salted.heavy_keys(comments(rows), "document_number", 0.5).collect()[0][0] == "hot"


def test_persistence(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", "x", 1.0), ("c", "3", 2.0), ("c", "4", 2.0), (None, "5", 1.0)], "k string, v string, w double")
    rows = {(r["k"], r["v"]) for r in persistence.evolved_union(old, new).collect()}
    assert ("c", 3) in rows and ("b", None) in rows
    kept = persistence.keep_first(old, new.select("k", F.col("v").try_cast("int").alias("v")), "k").collect()
    assert sorted((r["k"], r["v"]) for r in kept) == [("a", 1), ("b", 2), ("c", 3)]


def test_limiter_and_keys():
    now = [0.0]

    def sleep(s):
        now[0] += s

    limiter = harvest.KeyLimiter(harvest.parse_keys("a:60,b:120"), clock=lambda: now[0], sleep=sleep)
    used = [limiter.acquire() for _ in range(6)]
    assert set(used) == {"a", "b"}
    limiter.report("b", 403)
    assert limiter.acquire() == "a"
    limiter.report("a", 429, 500)
    before = now[0]
    limiter.acquire()
    assert now[0] - before <= 121
    limiter.report("a", 401)
    with pytest.raises(RuntimeError):
        limiter.acquire()
    assert harvest.parse_keys(None) == [] and harvest.parse_keys("k, j:7") == [("k", 1000), ("j", 7)]


def test_labelling_retries(spark, comments):
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        raise OSError

    assert labelling.with_retries(flaky, "x", 3, sleep=lambda s: None) == "ERROR: retries_exhausted" and len(calls) == 3
    table = comments([{"comment_id": "1", "comment_text": "Our members object"}, {"comment_id": "2", "comment_text": " "}, {"comment_id": "3", "comment_text": "x" * 5000}])
    got = {r["comment_id"]: r for r in labelling.label(table, labelling.KeyWords()).collect()}
    assert got.keys() == {"1", "3"} and got["1"]["category"] == X.WRITTEN_ORGANIZATION and len(got["3"]["prompt_used"]) == 3000
    structured = labelling.label_structured(table, lambda p: '{"category": "expert", "confidence": 0.9}').first()
    assert structured["category"] == X.EXPERT and structured["confidence"] == 0.9


def test_command_line_and_pdf(spark, data, tmp_path):
    from docketlens.__main__ import run

    told = run(spark, ["sl2_top_three", "no_such_query"], data, str(tmp_path), "json", True)
    assert told["sl2_top_three"] == "ok" and told["no_such_query"].startswith("KeyError")
    assert spark.read.json(f"{tmp_path}/sl2_top_three").count() == 3
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf/a.pdf").write_bytes(b"%PDF-1.7 body")
    (tmp_path / "pdf/b.pdf").write_bytes(b"<html>no</html>")
    files = spark.read.format("binaryFile").load(str(tmp_path / "pdf"))
    texts = {r["path"][-5:]: r["text"] for r in harvest.extract_pdf_text(files, lambda b: f"{len(b)} bytes").collect()}
    assert texts == {"a.pdf": "13 bytes", "b.pdf": None}


def test_document_vectors_have_full_size(spark, data):
    from docketlens.plans import registry

    df = registry.queries()["sm6_document_vectors"](spark, data)
    rows = df.limit(20).collect()
    assert df.columns == ["comment_id", "vector"] and rows
    assert all(len(r["vector"]) == 300 for r in rows)


def test_document_vectors_are_trained_in_parts(spark, monkeypatch):
    """Parts trained side by side give one model that tells two vocabularies apart, however the rows lie; each word has its context right at the edges of texts."""
    import random

    import numpy as np

    from docketlens.operators import density

    rng = random.Random(5)
    words = ["".join(rng.choices("bcdfghjklm", k=6)) for _ in range(60)]
    texts = [(i, " ".join(rng.choices(words[:30] if i % 2 else words[30:], k=30))) for i in range(400)] + [(400, "seldom here"), (401, ""), (402, None)]
    rows = spark.createDataFrame(texts, "id long, text string")
    monkeypatch.setattr(density, "PART_WORDS", 4000)
    got = [{r["id"]: np.array(r["vector"]) for r in density.document_vectors(df, "id", "text", size=16, rounds=10).collect()} for df in (rows.repartition(3), rows.coalesce(1))]
    assert all(len(g) == len(texts) for g in got) and all(np.allclose(got[0][i], got[1][i], atol=1e-4) for i in got[0])
    assert all(abs(np.linalg.norm(v) - (i < 400)) < 1e-9 for i, v in got[0].items())
    near = np.array([got[0][i] for i in range(400)]) @ got[0][1]
    assert near[1::2].min() > near[::2].max()
    unknown = density.document_vectors(spark.createDataFrame([(1, "each word once"), (2, None)], "id long, text string"), "id", "text", size=4)
    assert sorted(map(tuple, unknown.collect())) == [(1, [0.0] * 4), (2, [0.0] * 4)]
    # One round moves only words that stand in a context: a text of one word has none, and no context passes the edge of a text.
    inner, outer, before = np.ones((4, 8), np.float32), np.zeros((4, 8), np.float32), np.ones((4, 8), np.float32)
    outer[1:] = 0.5
    monkeypatch.setattr(density, "THIN", 1e9)
    density.train_words(np.array([0, 1, 2, 3]), np.array([1, 2, 1]), np.array([1, 1, 1, 1]), inner, outer, 5, (0.1, 0.1), [1])
    assert (inner[[0, 3]] == before[[0, 3]]).all() and (inner[[1, 2]] != before[[1, 2]]).all()


def test_neighbours_are_exact_in_blocks(spark, monkeypatch):
    import random

    from docketlens.operators import density

    rng = random.Random(1)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(300)], "id long, vector array<float>")
    whole = {r["id"]: r["distance"] for r in density.mean_neighbour_distance(vectors, 10).collect()}
    monkeypatch.setattr(density, "SENT_BYTES", 0)
    monkeypatch.setattr(density, "BLOCK_BYTES", 20000, raising=False)
    blocks = {r["id"]: r["distance"] for r in density.mean_neighbour_distance(vectors, 10).collect()}
    assert blocks.keys() == whole.keys() and all(abs(blocks[i] - whole[i]) < 1e-5 for i in whole)


def test_csv_keeps_carriage_returns(spark, tmp_path):
    from docketlens.plans import registry

    texts = ["a\r\nb", "a\rb", "\rfirst", "last\r", 'say "x"\r, y', "plain", "two\nlines", None]
    schema = "comment_id string, comment_text string, attachment_count long, has_attachments boolean"
    rows = [(str(i), t, i, True) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/comments_raw.parquet")
    got = registry.queries()["src9_csv_round_trip"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_cursor_keeps_rows_at_page_edges(spark, tmp_path):
    """Pages that end inside a date and inside an id, NULL dates and repeated rows; a stopped stream goes on where it was."""
    rows = [("2020-01-01", "a", "d1"), ("2020-01-01", "a", "d2"), ("2020-01-01", "a", "d3"), ("2020-01-01", "b", "d1"), (None, "c", None), (None, "c", "d1"), ("2021-05-05", "d", None), ("2021-05-05", "d", None), ("2020-01-01", None, "d9")]
    spark.createDataFrame(rows, "posted_date string, comment_id string, document_number string").write.parquet(f"{tmp_path}/list")
    harvest.register(spark)

    def pull():
        stream = spark.readStream.format("docket_comments").option("path", f"{tmp_path}/list").option("page", "2").load()
        started = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        started.processAllAvailable()
        started.stop()
        return sorted((tuple(r) for r in spark.read.schema("posted_date string, comment_id string, document_number string").parquet(f"{tmp_path}/out").collect()), key=str)

    want = {r for r in rows if r[1]}
    assert pull() == sorted(want, key=str)
    more = ("2022-01-01", "e", "d1")
    spark.createDataFrame([more], "posted_date string, comment_id string, document_number string").write.mode("append").parquet(f"{tmp_path}/list")
    assert pull() == sorted(want | {more}, key=str)


def test_cursor_reads_its_list_once(tmp_path, monkeypatch):
    """Not once a page: pages follow from sorted runs, in order over the runs; a sent reader replays any stretch."""
    import pickle
    import random
    from types import SimpleNamespace

    import pyarrow as pa
    import pyarrow.dataset
    import pyarrow.parquet

    rng, names = random.Random(3), ("posted_date", "comment_id", "document_number")
    rows = [(rng.choice([None, "", "2020-01-01", "2021-01-01"]), rng.choice([None, "", "a", "é", "𝒂", *map(str, range(40))]), rng.choice([None, "", "d1", "d2"])) for _ in range(900)]
    for i in range(3):
        pa.parquet.write_table(pa.table({n: pa.array([r[k] for r in rows[i * 300 : i * 300 + 300]], pa.string()) for k, n in enumerate(names)}), f"{tmp_path}/{i}.parquet")
    opened, whole = [], pa.dataset.dataset
    monkeypatch.setattr(pa.dataset, "dataset", lambda *a, **k: SimpleNamespace(to_batches=lambda **x: opened.append(1) or d.to_batches(**x), files=d.files, filesystem=d.filesystem) if (d := whole(*a, **k)) else None)
    monkeypatch.setattr(harvest.CommentCursor, "RUN", 250, raising=False)
    want = sorted({(r[1], r[0], r[2]) for r in rows if r[1]}, key=lambda r: harvest.CommentCursor._key((r[1], r[0], r[2])))
    for options, most in (({"page": "7"}, 7), ({"page": "7", "pages": "3"}, 21)):
        opened.clear()
        cursor = harvest.CommentCursor({"path": str(tmp_path)} | options)
        at, got, stops = cursor.initialOffset(), [], []
        while True:
            page, end = cursor.read(at)
            if not (page := list(page)):
                break
            assert len(page) <= most
            at, got, stops = end, got + page, [*stops, (at, end, page)]
        assert got == want and len(stops) == -(-len(want) // most) and len(opened) == 1
        sent = pickle.loads(pickle.dumps(cursor))
        assert all(list(sent.readBetweenOffsets(a, b)) == page for a, b, page in stops[:3])
        assert list(cursor.read(stops[1][0])[0]) == stops[1][2]


def test_year_of_calendars_is_a_setting(spark, data):
    spark.conf.set("docketlens.year", "2019")
    try:
        assert {str(r[0])[:4] for r in registry.queries()["jn13_calendar_spine"](spark, data).select("dt").collect()} == {"2019"}
    finally:
        spark.conf.unset("docketlens.year")


def test_structured_replies(comments):
    rows = [{"comment_id": str(i), "comment_text": t} for i, t in enumerate(("Our members object", "on behalf of clients", "nothing", "speaking for my family"))]
    got = {r["comment_id"]: (r["confidence"], r["error"]) for r in labelling.label_structured(comments(rows), labelling.StructuredKeyWords()).collect()}
    assert got == {"0": (0.9, None), "1": (0.0, "invalid reply"), "2": (0.0, "invalid reply"), "3": (0.9, None)}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from docketlens.session import shared_dir

    conf = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
