"""Stored layouts: row groups that a lookup reads, catalog tables, incremental loads, sketches; order of reports."""
import glob
import tempfile
import threading

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from knightshift import schemas
from knightshift.operators import normalize as N
from knightshift.operators import rollups as R
from knightshift.operators import scoring as S
from knightshift.operators import sketches as SK
from knightshift.plans import q_layouts as Q
from knightshift.plans.model_fixture import model_tables
from knightshift.sinks import files as K
from knightshift.sources.pgn import lookup_match


def _groups(path, columns, values):
    """Row groups of a table, and those whose statistics of all columns meet the values."""
    total = met = 0
    for name in glob.glob(f"{path.removeprefix('file:')}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            total += 1
            stats = [meta.row_group(g).column(at[c]).statistics for c in columns]
            met += all(s.has_min_max and s.min <= v <= s.max for s, v in zip(stats, values))
    return total, met


@pytest.mark.parametrize("name,table,columns", schemas.INDEXES)
def test_a_lookup_reads_few_row_groups(spark, tmp_path, name, table, columns):
    df = model_tables(spark, SF_MID)[table]
    path = str(tmp_path / name)
    K.write_clustered(df, path, columns, schemas.PRIMARY_KEYS[table])
    total, met = _groups(path, columns, Q.LOOKUPS[name])
    share = df.where(" AND ".join(f"{c} = {Q._sql(v)}" for c, v in zip(columns, Q.LOOKUPS[name]))).count() / df.count()
    assert total >= 8 and met <= share * total + 2
    rows = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{path}/*.parquet")]
    assert max(rows) <= 2.5 * sum(rows) / len(rows)              # a value that most rows share spreads over files


def _rows_of_files(path):
    return [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{path}/*.parquet")]


def test_files_of_a_layout_grow_in_number_not_in_rows(spark, tmp_path, monkeypatch):
    """A value that nine of ten rows share, null values and rows that repeat: all rows, in files of bounded size, sorted by the column."""
    monkeypatch.setattr(K, "ROWS_PER_FILE", 500)
    df = spark.range(20_000).selectExpr("CASE WHEN id % 10 > 0 THEN 'b' WHEN id % 20 = 0 THEN 'a' END AS c", "id div 2 AS k")
    path = str(tmp_path / "t")
    K.write_clustered(df, path, ["c"], ["k"])
    rows = _rows_of_files(path)
    assert sum(rows) == 20_000 and max(rows) <= 2.5 * 500
    assert spark.read.parquet(path).exceptAll(df).isEmpty() and df.exceptAll(spark.read.parquet(path)).isEmpty()
    for f in glob.glob(f"{path}/*.parquet"):
        values = pq.read_table(f, columns=["c"])["c"].to_pylist()
        assert values == sorted(values, key=lambda v: (v is not None, v or ""))
    assert _groups(path, ["k"], [7])[1] <= 3                     # files are ranges of the key, too


def test_an_empty_table_has_a_layout(spark, tmp_path):
    path = str(tmp_path / "t")
    K.write_clustered(spark.createDataFrame([], "c string, k long"), path, ["c"], ["k"])
    assert spark.read.parquet(path).count() == 0


def test_index_tables_are_written_side_by_side(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    columns = {c for *_, cs in schemas.INDEXES for c in cs}
    spark.createDataFrame([(None,) * len(columns)], ", ".join(f"{c} string" for c in columns)).write.parquet(path)
    two = threading.Barrier(2)
    asked = []

    def stored(spark, d, name):
        asked.append(name)
        if len(asked) <= 2:
            two.wait(20)                                         # the first one goes on when the second has begun
        return path

    monkeypatch.setattr(Q, "indexed_table", stored)
    assert {r.index_name: r.found for r in Q.q_index_lookups(spark, SF_MID).collect()} == {x[0]: 0 for x in schemas.INDEXES}
    assert sorted(asked) == sorted(x[0] for x in schemas.INDEXES)


def test_tables_are_registered_again_after_new_files(spark, tmp_path):
    path = str(tmp_path / "t")
    part = lambda i: spark.createDataFrame([(i, f"r{i}")], "x int, run string").write.mode("append").partitionBy("run").parquet(path)
    part(1)
    K.register_tables(spark, {"results": path}, "ks_test_layouts")
    part(2)
    K.register_tables(spark, {"results": path}, "ks_test_layouts")
    assert sorted(tuple(r) for r in spark.sql("SELECT run, x FROM ks_test_layouts.results").collect()) == [("r1", 1), ("r2", 2)]
    plan = spark.sql("SELECT x FROM ks_test_layouts.results WHERE run = 'r2'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan


def test_a_load_run_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "dim")
    rows = lambda *r: spark.createDataFrame(r, "k string, v int")
    stored = lambda: sorted((r.k, r.v, r.load) for r in spark.read.parquet(path).collect())
    N.merge_rows(rows(("a", 2), ("a", 1), ("b", 3), (None, 9)), path, ["k"], "one")
    assert stored() == [("a", 1, "one"), ("b", 3, "one")]
    for _ in range(2):                                          # cut off and run again, or simply repeated
        N.merge_rows(rows(("a", 7), ("c", 4)), path, ["k"], "two")
        assert stored() == [("a", 1, "one"), ("b", 3, "one"), ("c", 4, "two")]
    N.merge_rows(rows(("a", 7), ("c", 5)), path, ["k"], "three")
    assert stored() == [("a", 1, "one"), ("b", 3, "one"), ("c", 4, "two")]


def test_sketches_of_new_shards_only_and_within_their_error(spark, tmp_path):
    path = str(tmp_path / "sk")
    evals = spark.range(60_000).select((F.col("id") % 30).alias("shard"), F.lit("e").alias("engine"), F.concat(F.lit("p"), F.col("id") % 25_000).alias("puzzle_id"),
                                       (F.col("id") * 7919 % 101).cast("int").alias("depth"))
    SK.sketch_shards(evals.where("shard < 20"), path, "one")
    SK.sketch_shards(evals, path, "two")
    SK.sketch_shards(evals, path, "two")
    sketches = SK.read_sketches(spark, path)
    assert sketches.count() == 30 and sketches.where("load = 'two'").count() == 10
    got = SK.merged(sketches, ["engine"]).collect()[0]
    assert got.n == 60_000 and abs(got.ids - 25_000) <= 4 * SK.HLL_ERROR * 25_000
    for p in (25, 50, 75, 90):
        assert abs(got[f"p{p}"] - p * 1.01) <= 101 * SK.KLL_RANK_ERROR + 1


def test_reports_are_in_order(spark):
    """L1: accuracy, then speed, both falling; L4: shards by name."""
    rows = [("slow", i < 2, 5.0) for i in range(4)] + [("fast", i < 2, 9.0) for i in range(4)] + [("best", True, 1.0)]
    evals = spark.createDataFrame([("r", f"p{k}", e, ok, 3, nps, 0.1, 1500) for k, (e, ok, nps) in enumerate(rows)],
                                  "run_id string, puzzle_id string, engine string, is_correct boolean, depth int, nps double, elapsed_seconds double, rating int")
    assert [r.engine for r in R.engine_rollup(evals).collect()] == ["best", "fast", "slow"]
    shards = spark.createDataFrame([("r", "e", f"p{i}", f"shard_{i % 3:03}.parquet", i) for i in (5, 0, 4, 1, 3, 2)],
                                   "run_id string, engine string, puzzle_id string, shard string, pos int")
    taken = S.limit_per_engine(shards, 4).orderBy("taken").collect()
    assert [r.puzzle_id for r in taken] == ["p0", "p3", "p1", "p4"]


def test_a_table_without_its_text_column_is_refused(spark):
    with pytest.raises(ValueError, match="moves_pgn"):
        lookup_match(spark.createDataFrame([("m", 1)], "match_id string, game_no int"), "m")
    with pytest.raises(FileNotFoundError):
        lookup_match(spark.createDataFrame([("m", "x")], "match_id string, moves_pgn string"), "none")


def test_one_time_stamp_a_job_where_an_answer_has_none(spark):
    puzzles = spark.createDataFrame([("p", "f", "e2e4", 1)], "puzzle_id string, fen string, solution string, rating int")
    answers = spark.createDataFrame([("r", "p", "e2e4", 1, 1.0, 1.0, "E", None), ("s", "p", "e2e4", 1, 1.0, 1.0, "E", "2020")],
                                    "run_id string, puzzle_id string, engine_move string, depth int, nps double, elapsed_seconds double, engine string, evaluated_at string")
    got = {r.run_id: r.evaluated_at for r in S.score_answers(puzzles, answers, "2026").collect()}
    assert got == {"r": "2026", "s": "2020"}
    assert {r.evaluated_at for r in S.score_answers(puzzles, answers.drop("evaluated_at"), "2026").collect()} == {"2026"}
