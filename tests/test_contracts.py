"""External-call contract, attempts, and the small stateful helpers."""

from pyspark.sql import functions as F

from tessera.operators import contracts as C


def test_calls_retry_and_isolate_errors(spark):
    def client(p):
        if p == "boom":
            raise ValueError("bad row")
        if p == "slow":
            raise TimeoutError("again")
        return p.upper(), len(p), 1

    got = {r.id: r for r in C.call_rows(spark.createDataFrame([(1, "ok"), (2, "boom"), (3, "slow")], "id int, p string"), "id", "p", client, tries=3).collect()}
    assert (got[1].reply, got[1].attempts, got[1].error) == ("OK", 1, None)
    assert (got[2].reply, got[2].attempts, got[2].error) == (None, 1, "bad row")
    assert (got[3].attempts, got[3].error) == (3, "again")


def test_latest_success_and_breaks(spark):
    df = spark.createDataFrame([("a", 1, "x", "e"), ("a", 2, "ok", None), ("a", 3, "ok", None), ("b", 1, "x", "e"), ("b", 2, "x", "e"), ("b", 3, "x", "e"), ("b", 4, "x", "f")], "k string, attempt int, s string, err string")
    assert [(r.k, r.attempt) for r in C.latest_success(df, "k", F.col("s") == "ok").collect()] == [("a", 3)]
    assert [(r.k, r.broke_at) for r in C.circuit_breaks(df, "k", "attempt", F.col("s") == "x", "err").collect()] == [("b", 3)]


def test_block_pairs_meet_all(spark):
    got = C.block_pairs(spark.range(25), ["id"], 10).groupBy("pair_a", "pair_b").agg(F.collect_set("id").alias("s")).collect()
    met = {(a, b) for r in got for a in r.s for b in r.s}
    assert len(met) == 25 * 25 and {(r.pair_a, r.pair_b) for r in got} == {(0, 1), (0, 2), (1, 2)}


def test_lines_and_boxes(spark):
    words = spark.createDataFrame([("p", 0.0, 0.0, 10.0, 10.0), ("p", 20.0, 2.0, 30.0, 12.0), ("p", 0.0, 30.0, 10.0, 40.0)], "page string, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.line_no for r in C.group_lines(words, "page").collect()) == [0, 0, 1]
    boxes = spark.createDataFrame([("p", 1, 60.0, 40.0), ("p", 2, 60.0, 40.0), ("p", 3, 90.0, 40.0)], "page string, o int, w double, h double")
    assert {r.o: (r.x, r.y) for r in C.pack_boxes(boxes, "page", "o", 100.0, 100.0).collect()} == {1: (0.0, 0.0), 2: (0.0, 40.0), 3: (None, None)}


def test_calculator_and_windows():
    assert [C.calculate(x) for x in ("1+2*3", "(1+2)*-3", "0.1+0.2", "1/0", "2**3", "abc", "")] == [7.0, -9.0, 0.3, None, None, None, None]
    assert C.edition_windows("aaa 2019 bbb 2020 " + "c" * 100 + " 2021", r"20\d\d", 10) == ["aaa 2019 bbb 2020 ", "c" * 9 + " 2021"]


def test_plans_and_accounting(spark):
    items = spark.createDataFrame([("a", 1, "Check pumps"), ("a", 2, "check PUMPS"), ("b", 1, "x" * 300), ("b", 2, "Doors"), ("c", 1, "Tail")], "slug string, ord int, item string")
    kept, dropped = C.sanitized_plans(items, most=2)
    assert [r.item for r in kept.collect()] == ["Check pumps", "Doors"] and dropped.first()[0] == 3
    got = C.harvest_accounting(items.select("ord"), spark.createDataFrame([(1, "MATCHED")], "ord int, o string"), "ord", "o").collect()
    assert {r.outcome: r.n for r in got} == {"MATCHED": 1, "MISSING": 1}
