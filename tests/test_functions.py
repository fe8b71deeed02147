"""Tables of values for the scalar functions and the operators whose order decides."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions import text as T
from tessera.operators import anchoring, parse
from tessera.operators import audit as A
from tessera.operators import ledger as L
from tessera.operators import records as R


def values(spark, rows, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, s string")
    return [r[0] for r in df.select("i", make(F.col("s")).alias("v")).orderBy("i").select("v").collect()]


def test_parse_number(spark):
    given = ["1,200", "1,950 ft²", "0.20 gpm/ft²", "2 1/2", '2-1/2"', "-1/2", "30%", ".5", "", "abc", "$5.00", None, "1/0"]
    want = [1200, 1950, 0.2, 2.5, 2.5, -0.5, 30, 0.5, None, None, None, None, None]
    got = values(spark, given, N.parse_number)
    assert [None if v is None else float(v) for v in got] == want


def test_signature(spark):
    assert values(spark, ["M-101", "FP101", "E2.1", "A--1", "-A1", "A1.", "M#1", "", None], T.id_signature) == ["A1 - D", "A2 D", "A1 D . D", None, None, "A1 D", None, None, None]


def test_sheet_id_keeps_o_and_zero(spark):
    assert values(spark, [" (m‑1O1). ", "M-101"], T.sheet_id) == ["M-1O1", "M-101"]


def test_non_sheet(spark):
    assert values(spark, ["NFPA 13", "RFI-7", "480V", "120/208V", "12", "M-101", ""], T.is_non_sheet) == [True, True, True, True, True, False, True]


def test_measurements(spark):
    assert values(spark, ['2 1/2 in and 2-1/2" pipe', "500 GPM", "M-101 in"], lambda c: F.array_join(T.measurements(c), ",")) == ["21/2in", "500gpm", ""]


def test_editions(spark):
    assert values(spark, ["NFPA 13, 2016 and 2019 CBC, NFPA 13-2016", "none"], lambda c: F.array_join(T.editions(c), ";")) == ["NFPA 13 2016;CBC 2019", ""]


def test_redact_before_cut(spark):
    text = "x" * 290 + " token=abcdefghijklmnop"
    assert "abcdef" not in values(spark, [text], T.sanitize)[0]


def test_csv_safe(spark):
    assert values(spark, ["=1", " +x", "-1", "@a", "a=1", None], T.csv_safe) == ["'=1", "' +x", "'-1", "'@a", "a=1", None]


def test_section_class(spark):
    assert values(spark, ["Coordination conflicts", "Duct sizes", "Remarks", None], T.section_class) == ["conflict", "dimensions", "other", "other"]


def test_tolerance(spark):
    df = spark.sql("SELECT CAST(100 AS DECIMAL(30,10)) a, CAST(101 AS DECIMAL(30,10)) b, CAST(102 AS DECIMAL(30,10)) c, CAST(115 AS DECIMAL(30,10)) d")
    a, b, c, d = (F.col(x) for x in "abcd")
    assert df.select(N.agrees(a, b), N.agrees(a, c), N.severity_of_gap(a, c), N.severity_of_gap(a, d)).first()[:] == (True, False, "low", "high")


def test_complete_link_is_not_transitive(spark):
    rows = spark.createDataFrame([("s", 1, "aa bb cc dd ee"), ("s", 2, "aa bb cc dd ff"), ("s", 3, "bb cc dd ff gg"), ("t", 4, "aa bb cc dd ee"), ("s", 5, "")], "k string, o int, t string")
    got = {r.o: r.cluster for r in L.complete_link(rows, "k", "o", "t", 0.6).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_similar_pairs_prefix_filter_loses_nothing(spark):
    import itertools
    import random

    random.seed(3)
    texts = [" ".join(random.sample([f"w{i}" for i in range(14)], random.randint(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "k int, id int, t string")
    got = {(r.a, r.b) for r in L.similar_pairs(df, "k", "id", "t", 0.6).collect()}
    sets = [set(t.split()) for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(60), 2) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6}
    assert got == want


def test_duplicate_predicate_blocks_conflicting_signatures(spark):
    kind = "struct<text:string,source_quote:string,category:string>"
    rows = [(("pump P-1 flow 500 gpm on plan", "", "code"), ("pump P-1 flow 550 gpm on plan", "", "code")), (("valve detail missing tag note", "", "code"), ("valve detail missing tag note here", "", "question"))]
    df = spark.createDataFrame(rows, f"a {kind}, b {kind}")
    assert [r[0] for r in df.select(L.is_duplicate("a", "b")).collect()] == [False, True]


def test_duplicate_places(spark):
    kind = "struct<text:string,source_quote:string,category:string,x0:double,y0:double,x1:double,y1:double>"
    one = lambda t, q, x: (t, q, "code", x, 0.0, x + 10, 10.0)
    rows = [(one("alpha beta", "QUOTE  a", 0.0), one("gamma delta", "quote a", 2.0)), (one("alpha beta", "quote a", 0.0), one("gamma delta", "quote a", 8.0))]
    df = spark.createDataFrame(rows, f"a {kind}, b {kind}")
    assert [r[0] for r in df.select(L.is_duplicate("a", "b", rects=True)).collect()] == [True, False]


def test_post_anchor_fold(spark):
    rows = [("s", "i1", "aa bb cc dd", "q", "low"), ("s", "i2", "aa bb cc dd", "longer", "low"), ("s", "i3", "ee ff", "", "high")]
    got = {r.id: r.cluster for r in L.post_anchor_fold(spark.createDataFrame(rows, "k string, id string, text string, source_quote string, severity string"), "k").collect()}
    assert got == {"i2": 1, "i1": 1, "i3": 3}


def test_numbering_is_dense(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("v"))
    got = L.number_rows(spark, df, ["v"]).orderBy("v").collect()
    assert [r.n for r in got] == list(range(1, 5001))


@pytest.mark.parametrize(
    "quote,tile,want",
    [
        ("TYP DETAIL 5", (0, 1), ("EXACT", "exact")), ("TYP DETAIL 5", None, ("EXACT", "exact_ambiguous")), ("", (1, 1), ("TILE", "tile")), ("", None, ("UNANCHORED", "no_quote_no_tile")),
        ("no such words at all", None, ("UNANCHORED", "quote_not_found")), ("alpha beta gamma delta epsilon zeta ETA", None, ("FUZZY", "fuzzy_window")), ("xx yy alpha beta gamma qq rr ss", None, ("FUZZY", "fuzzy_subphrase")),
    ],
)
def test_anchor_ladder(quote, tile, want):
    import pandas as pd

    text = "TYP DETAIL 5 alpha beta gamma delta epsilon zeta theta TYP DETAIL 5".split()
    words = pd.DataFrame([(i * 60.0, 10.0, i * 60.0 + 50, 24.0, t) for i, t in enumerate(text)], columns=["x0", "y0", "x1", "y1", "text"])
    assert anchoring.place(anchoring.Page(words), quote, tile, 792.0, 612.0, 2, 2)[:2] == want


def test_blocks_and_json():
    text = "a\n```json\n{\"x\": [1, 2,],}\n```\nb\n```\n{\"y\": \"a,}\""
    found = parse.scan_blocks(text)
    assert [(b[3], b[4]) for b in found] == [("json", True), ("", False)]
    assert parse.repaired_json(found[0][1]) == '{"x": [1, 2]}'
    assert parse.repaired_json('{"y": "a,}"}') == '{"y": "a,}"}'
    assert parse.repaired_json("none") is None


def test_poison_cost(spark):
    rows = [("a", 1, 1, "1.5", True), ("a", 1, 1, None, True), ("b", 1, 1, "2.0", True), ("b", 1, 1, None, False)]
    df = spark.createDataFrame(rows, "family string, input_tokens long, output_tokens long, cost string, billable boolean").withColumn("cost", F.col("cost").cast("decimal(36,12)"))
    got = {r.family: r.cost for r in R.rollup_usage(df, "family").collect()}
    assert got["a"] is None and got[None] is None and float(got["b"]) == 2.0


def test_detect_sheet_id_joins_fragments(spark):
    rows = [("p", 0, 10.0, 10.0, 60.0, 24.0, "A-1", 800.0, 600.0), ("p", 1, 700.0, 570.0, 720.0, 584.0, "M-", 800.0, 600.0), ("p", 2, 720.5, 570.0, 745.0, 584.0, "101", 800.0, 600.0)]
    df = spark.createDataFrame(rows, "page string, ordinal int, x0 double, y0 double, x1 double, y1 double, text string, page_w double, page_h double")
    assert [r.sheet_id for r in A.detect_sheet_ids(df, ["page"]).collect()] == ["M-101"]


def test_poll_machine():
    from tessera.streaming.polling import step

    s = (0.0, -1, 0.0, 0, "")
    s = step(s, 0, "running", 1)
    s = step(s, 1800, "running", 1)
    assert s[4] == ""
    assert step(s, 3600, "running", 1)[4] == "stalled"
    assert step(s, 3600, "ended", 1)[4] == "ended"
    e = s
    for i in range(10):
        e = step(e, 1801 + i, "error", 0)
    assert e[4] == "poll_failed"


def test_poll_stream(spark, tmp_path):
    from tessera.streaming.polling import poll_outcomes

    src = tmp_path / "in"
    rows = [("j1", "2024-01-01 00:00:00", "running", 1), ("j1", "2024-01-01 00:10:00", "ended", 5), ("j2", "2024-01-01 00:00:00", "running", 1), ("j2", "2024-01-01 02:00:00", "running", 1)]
    df = spark.createDataFrame(rows, "job string, at string, status string, done long").withColumn("at", F.col("at").cast("timestamp"))
    df.write.json(str(src))
    stream = spark.readStream.schema("job string, at timestamp, status string, done long").json(str(src))
    q = poll_outcomes(stream).writeStream.format("memory").queryName("outcomes").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    import time

    until = time.time() + 90
    while spark.table("outcomes").count() < 2 and time.time() < until:  # a stream with timers never is out of batches
        time.sleep(1)
    q.stop()
    assert {(r.job, r.outcome) for r in spark.table("outcomes").collect()} == {("j1", "ended"), ("j2", "stalled")}


def test_poll_timer():
    """A job that no poll reaches any more ends by the clock; a finished job's state goes."""
    from tessera.streaming import polling as P

    class State:
        def __init__(self, value, now):
            self.get, self.now, self.exists, self.hasTimedOut, self.wait = value, now, value is not None, True, None

        def getCurrentProcessingTimeMs(self):  # noqa: N802
            return self.now * 1000

        def update(self, value):
            self.get = value

        def remove(self):
            self.exists = False

        def setTimeoutDuration(self, ms):  # noqa: N802
            self.wait = ms

    for now, outcome in ((3600, "stalled"), (20_000, "detached")):
        s = State((0.0, 3, 0.0, 0, ""), now)
        out = list(P.watch(("j",), iter([]), s))
        assert out[0].iloc[0]["outcome"] == outcome and s.get[4] == outcome and s.wait == 1000 * P.DETACH_SECONDS
    s = State((0.0, 3, 0.0, 0, "ended"), 99_999)
    assert list(P.watch(("j",), iter([]), s)) == [] and not s.exists


def test_words_source(spark, tmp_path):
    import json

    from tessera.sources.files import WordsSource

    (tmp_path / "a.jsonl").write_text(json.dumps({"page": 0, "words": [[0, 0, 10, 10, "M-101", 0, 0, 0], [12, 0, 30, 10, "PLAN", 0, 0, 1]]}) + "\n")
    spark.dataSource.register(WordsSource)
    got = spark.read.format("tessera_words").load(str(tmp_path)).orderBy("ordinal").collect()
    assert [(r.ordinal, r.text) for r in got] == [(0, "M-101"), (1, "PLAN")]


def test_sinks_and_profiles(spark, tmp_path):
    from tessera.sources import files

    files.write_csv(spark.createDataFrame([("=1", 1)], "a string, b int"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["a"] == "'=1"
    for where, item in (("one", "built in"), ("two", "mine")):
        (tmp_path / where).mkdir()
        (tmp_path / where / "fire.md").write_text(f"---\nname: fire\ndisciplines: fp, m\n---\n- {item}\n")
    got = files.profiles(spark, str(tmp_path / "one"), str(tmp_path / "two")).collect()
    assert [(r.name, r.disciplines, r["items"]) for r in got] == [("fire", ["fp", "m"], ["mine"])]
    inv = files.file_inventory(spark, str(tmp_path / "one"), "*.md").collect()
    assert len(inv) == 1 and len(inv[0].sha) == 64
