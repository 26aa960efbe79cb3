"""Plan properties that matter at scale: pushdown, pruning, broadcast bounds, no Python UDF."""
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_pushed_and_columns_pruned(spark):
    df = spark.read.parquet(f"{SF_SMALL}/events.parquet").where("event_type = 'click'").select("event_id")
    p = _plan(df)
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in p
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in p


@pytest.mark.parametrize("name", ["engine_rollup", "rollup_3nf", "engine_agreement", "game_facts", "check_fk",
                                  "score_answers", "depth_percentiles", "accuracy_by_theme"])
def test_no_python_in_batch_plans(spark, name):
    p = _plan(E.queries()[name](spark, SF_SMALL))
    for op in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert op not in p


def test_rollup_is_partial_aggregate(spark):
    p = _plan(E.queries()["engine_rollup"](spark, SF_SMALL))
    assert "partial_count" in p or "partial_sum" in p


def test_dimension_broadcast_checked(spark):
    from knightshift.plans.joins import bounded_broadcast
    asked = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    ten = spark.range(10)          # eight bytes a number and sixteen a row
    assert asked(bounded_broadcast(ten, 240)) and not asked(bounded_broadcast(ten, 239))
    texts = spark.createDataFrame([("é" * 100, None), (None, [1, 2])], "t string, a array<int>")
    size = 2 * 16 + 200 + len('{"a":[1,2]}') + len("{}")
    assert asked(bounded_broadcast(texts, size)) and not asked(bounded_broadcast(texts, size - 1))
    assert asked(bounded_broadcast(ten.where("id < 0"), 0))


def test_measuring_moves_one_sum_a_task(spark):
    """Rows are summed where they are: only partial sums meet in the last task."""
    from knightshift.plans.joins import measured
    p = _plan(measured(spark.range(0, 1000, 1, 8)))
    assert "Limit" not in p and "SinglePartition" in p
    below = p[p.index("SinglePartition"):]
    assert "partial_sum" in below[:below.index("Range")]


def test_running_totals_window_is_chunked(spark, monkeypatch):
    """The running accuracy window is partitioned by (engine, chunk), never by the engine alone."""
    import knightshift.operators.ordered as O
    monkeypatch.setattr(O, "ROWS_PER_CHUNK", 100)     # the small table behaves like a large one
    p = _plan(E.queries()["running_accuracy"](spark, SF_SMALL))
    assert "hashpartitioning(engine" in p and "__chunk" in p
    assert "BroadcastHashJoin" in p          # the per-chunk offsets are small and broadcast


def test_game_numbers_do_not_shuffle_games(spark):
    """Whole games come from the cut table as they are; only the pieces at block borders are brought together."""
    from knightshift.operators import matches as M
    from knightshift.plans.pgn_fixture import pgn_files
    from knightshift.sources.pgn import read_games_text
    p = _plan(M.parse_games(read_games_text(spark, pgn_files(spark, SF_SMALL))))
    assert p.count("Exchange") == 1 and "SortMergeJoin" not in p and "isnotnull(whole" in p


def test_result_reads_prune_partitions_and_columns(spark):
    p = _plan(E.queries()["results_partition"](spark, SF_SMALL))
    assert "PartitionFilters: [isnotnull(run_id" in p and "(run_id" in p and "(engine_id" in p
    assert "ReadSchema: struct<puzzle_id:string,engine_move:string,is_correct:boolean>" in p


def test_stored_ids_read_one_column(spark):
    p = _plan(E.queries()["src_existing_ids"](spark, SF_SMALL))
    assert "ReadSchema: struct<puzzle_id:string>" in p


def test_a_side_above_the_bound_is_not_broadcast_by_its_file_size(spark, tmp_path):
    from knightshift.operators.scoring import resume_pending, score_answers
    rows = 60_000                                    # a small file whose columns are far wider than it
    spark.range(rows).selectExpr("id", "concat('p', id) AS puzzle_id").write.parquet(str(tmp_path / "ids"))
    ids = spark.read.parquet(str(tmp_path / "ids"))
    wide = ids.selectExpr("puzzle_id", "repeat('8/', 400) AS fen", "'e2e4' AS solution", "1500 AS rating")
    answers = ids.selectExpr("'r' AS run_id", "puzzle_id", "'e2e4' AS engine_move", "1 AS depth", "1.0D AS nps", "0.1D AS elapsed_seconds", "'E 1' AS engine")
    scored = score_answers(wide, answers)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(scored) and "SortMergeJoin" in plan(scored)
    assert scored.where("is_correct").count() == rows
    work = answers.selectExpr("run_id", "repeat(engine, 300) AS engine", "puzzle_id")
    pending = resume_pending(work, work)
    assert "BroadcastHashJoin" not in plan(pending) and pending.count() == 0


def test_many_parts_of_one_file_are_spread_over_tasks(spark, tmp_path, monkeypatch):
    from knightshift.plans import fixtures as fx
    part = "CASE WHEN id % 10 = 0 THEN NULL ELSE id END AS p_partkey"
    spark.range(1_000).selectExpr(part, "concat('n', id) AS p_name").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    whole = sorted(map(str, fx.fx_evals(spark, str(tmp_path)).collect()))
    assert len(whole) == 8_000
    monkeypatch.setattr(fx, "PARTS_PER_TASK", 100)
    evals = fx.fx_evals(spark, str(tmp_path))
    assert evals.rdd.getNumPartitions() == 10 and sorted(map(str, evals.collect())) == whole
