"""Streaming jobs: replays, pruned reads, published totals; first occurrences without a sort."""
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from knightshift.operators import puzzles as P
from knightshift.streaming import jobs as ST

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
HEAD = ["PuzzleId", "FEN", "Moves", "Rating", "Popularity"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _land(folder, name, ids):
    with open(f"{folder}/{name}", "w") as f:
        f.write("".join(f"{i},{START},e2e4 e7e5,{1500 + k},90\n" for k, i in enumerate(ids)))


def test_ingest_adds_each_id_once_and_reads_its_buckets_only(spark):
    d = tempfile.mkdtemp(prefix="ks-st1-")
    landing, sink = tempfile.mkdtemp(prefix="ks-land-"), f"{d}/out"
    run = lambda ck: ST.ingest_stream(spark, landing, sink, f"{d}/{ck}", 1000, 80, HEAD, buckets=8)
    _land(landing, "a", ["p1", "p2", "p1", "p3"])
    run("ck")
    _land(landing, "b", ["p3", "p4", "p4"])
    run("ck")
    run("ck")                                                     # nothing landed: nothing added
    stored = lambda: sorted((r.puzzle_id, r.rating) for r in spark.read.parquet(sink).collect())
    assert stored() == [("p1", 1500), ("p2", 1501), ("p3", 1503), ("p4", 1501)]
    assert spark.read.parquet(f"{sink}-ids").count() == 4
    one = spark.createDataFrame([("p4",), ("new",)], "puzzle_id string")
    hits = ST.stored_hits(spark, f"{sink}-ids", one, 99, 8)
    assert [r.puzzle_id for r in hits.collect()] == ["p4"]
    plan = _plan(hits)
    wanted = {r[0] for r in one.select(ST.id_bucket("puzzle_id", 8)).collect()}
    pruned = re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN \(([\d,]+)\)", plan)
    assert {int(x) for x in pruned[1].split(",")} == wanted and len(wanted) == 2
    # a batch that was cut off after its write is run again under its number: its own ids do not count as stored
    assert [r.puzzle_id for r in ST.stored_hits(spark, f"{sink}-ids", one, 1, 8).collect()] == []


def test_bucketed_puzzles_are_not_shuffled(spark):
    puzzles = ST.bucketed_puzzles(spark.createDataFrame([(f"p{i}", "f", "e2e4", i) for i in range(50)], "puzzle_id string, fen string, solution string, rating int"), 8)
    answers = spark.createDataFrame([("r", f"p{i}", "e2e4", 1, 1.0, 1.0, "E") for i in range(50)],
                                    "run_id string, puzzle_id string, engine_move string, depth int, nps double, elapsed_seconds double, engine string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = ST.score_answers(puzzles, answers)
        plan = _plan(scored)
        assert plan.count("Exchange") == 1 and scored.count() == 50
        puzzle_side = plan[plan.index("FileScan parquet") - 300:plan.index("FileScan parquet")]
        assert "Bucketed: true" in plan and "Exchange" not in puzzle_side.split("Sort")[-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_totals_change_only_when_published(spark, monkeypatch):
    sink = tempfile.mkdtemp(prefix="ks-st3-")
    totals = lambda rows: spark.createDataFrame(rows, ST.TOTALS)
    now = lambda: sorted(tuple(r) for r in ST.read_totals(spark, sink).collect())
    assert now() == []
    ST.publish_totals(totals([("a", 5, 1), ("b", 2, 2)]), 0, sink, every=2)
    ST.publish_totals(totals([("a", 9, 3)]), 1, sink, every=2)                    # only the engine that changed
    assert now() == [("a", 9, 3), ("b", 2, 2)] and spark.read.parquet(f"{sink}/versions/version=1").count() == 1
    broken = spark.createDataFrame([("b", 9, 9)], ST.TOTALS)
    with monkeypatch.context() as m:                                               # the writer dies before it points
        m.setattr(ST, "_totals", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ST.publish_totals(broken, 2, sink, every=2)
    assert spark.read.parquet(f"{sink}/versions").where("version = 2").count() == 1
    assert now() == [("a", 9, 3), ("b", 2, 2)]
    for _ in range(2):                                                             # run again, and once more
        ST.publish_totals(broken, 2, sink, every=2)
        assert now() == [("a", 9, 3), ("b", 9, 9)]
    ST.publish_totals(totals([("c", 1, 0)]), 3, sink, every=2)
    assert now() == [("a", 9, 3), ("b", 9, 9), ("c", 1, 0)]
    assert spark.read.parquet(f"{sink}/snapshots/version=2").count() == 2


def test_first_occurrence_sorts_no_rows(spark):
    rows = [("f2", 0, i, f"p{i % 7}", f"late {i}") for i in range(40)] + [("f1", b, b + i, f"p{i % 9}", f"{b} {i}") for b in (0, 100) for i in range(20)]
    df = spark.createDataFrame(rows, "file string, block long, seq long, puzzle_id string, text string")
    got = {r.puzzle_id: r.text for r in P.dedupe_first(df).collect()}
    best = {}
    for r in sorted(rows):
        best.setdefault(r[3], r[4])
    assert got == best
    plan = _plan(P.dedupe_first(df))
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
    assert "min(__order" in plan and all(re.match(r"file#\d+ ASC NULLS FIRST, block#", x) for x in re.findall(r" Sort \[([^\]]*)", plan))   # only blocks are sorted
