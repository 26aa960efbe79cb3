"""Resuming interrupted shards at a row index."""
from knightshift.operators import scoring as S
from knightshift.sources import runs as RUNS


def _shards(spark):
    return spark.createDataFrame([(f"p{i}", i // 4, i, 1000 + i % 3 * 500) for i in range(20)], "puzzle_id string, shard long, pos long, rating int")


def _plan_of(spark):
    return spark.createDataFrame([("r", "e", s) for s in range(5)], "run_id string, engine_id string, shard long")


def test_rows_start_behind_the_last_index(spark, tmp_path):
    folder = str(tmp_path / "ck")
    docs = {0: '{"run_id": "r", "last_index": 2, "results": [{"run_id": "r", "puzzle_id": "p0"}, {"run_id": "r", "puzzle_id": "p1"}]}',
            1: '{"run_id": "r", "last_index": 3, "results": [', 2: '{"run_id": "r"}', 3: '{"run_id": "r", "last_index": 99, "results": []}'}
    for shard, text in docs.items():
        spark.createDataFrame([(text,)], "value string").write.text(f"{folder}/engine_id=e/shard={shard}")
    state = RUNS.read_checkpoint_state(spark, folder)
    assert sorted((r.shard, r.last_index, len(r.results)) for r in state.collect()) == [(0, 2, 2), (2, 0, 0), (3, 99, 0)]
    done = _plan_of(spark).where("shard = 4")
    got = sorted((r.shard, r["index"], r.puzzle_id) for r in S.resume_rows(_shards(spark), _plan_of(spark), state, done).collect())
    assert got == [(0, 2, "p2"), (0, 3, "p3"), *[(1, i, f"p{4 + i}") for i in range(4)], *[(2, i, f"p{8 + i}") for i in range(4)]]
    held = sorted((r.shard, r["index"], r.puzzle_id) for r in RUNS.checkpoint_results(state).collect())
    assert held == [(0, 0, "p0"), (0, 1, "p1")]


def test_rows_are_counted_behind_the_filters(spark):
    none = _plan_of(spark).limit(0)
    state = spark.createDataFrame([("r", "e", 1, 1)], "run_id string, engine_id string, shard long, last_index int")
    got = sorted((r.shard, r["index"], r.puzzle_id) for r in S.resume_rows(_shards(spark), _plan_of(spark).where("shard < 2"), state, none, 1500, 2).collect())
    assert got == [(0, 0, "p1"), (0, 1, "p2"), (1, 1, "p5")]


def test_finished_shards_meet_no_puzzle(spark):
    """The plan is cut to open shards by a broadcast before the join, and the puzzles meet it by a broadcast."""
    none = spark.createDataFrame([], "run_id string, engine_id string, shard long, last_index int")
    rows = S.resume_rows(_shards(spark), _plan_of(spark), none, _plan_of(spark).where("shard > 1"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 3 and "SortMergeJoin" not in plan and "LeftAnti" in plan


def test_recovered_rows_and_new_ones_stand_side_by_side(spark):
    old = spark.createDataFrame([("r", "e", 0, 0, "p0", True)], "run_id string, engine_id string, shard long, index long, puzzle_id string, is_correct boolean")
    new = spark.createDataFrame([("r", "e", 0, 1, "p1")], "run_id string, engine_id string, shard long, index long, puzzle_id string")
    assert sorted((r["index"], r.puzzle_id, r.is_correct, r.recovered) for r in S.resumed_results(old, new).collect()) == [(0, "p0", True, True), (1, "p1", None, False)]


def test_many_checkpoints_of_an_engine_in_a_file(spark, tmp_path, monkeypatch):
    import glob
    from knightshift.plans import q_scoring as Q
    text = ['{"run_id": "r", "shard": 0, "last_index": 2, "results": [{"run_id": "r", "puzzle_id": "p0"}]}',
            '{"run_id": "r", "shard": 1, "last_index": 3, "results": [', '{"run_id": "r", "shard": 2}']
    spark.createDataFrame([(t,) for t in text], "value string").coalesce(1).write.text(f"{tmp_path}/ck/engine_id=e")
    state = RUNS.read_checkpoint_state(spark, f"{tmp_path}/ck")
    assert sorted((r.engine_id, r.shard, r.last_index, len(r.results)) for r in state.collect()) == [("e", 0, 2, 1), ("e", 2, 0, 0)]
    monkeypatch.setattr(Q, "scratch_path", lambda s, name: f"{tmp_path}/query")
    spark.range(2_000).selectExpr("id AS p_partkey", "'n' AS p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert Q.q_resume_from_checkpoints(spark, str(tmp_path)).where("recovered").count() > 0
    assert len(glob.glob(f"{tmp_path}/query/engine_id=*/*")) <= 64         # not one for each of 100 shards and engine
    assert not glob.glob(f"{tmp_path}/query/engine_id=*/shard=*")


def test_answers_are_not_sent_through_the_driver(spark, tmp_path, monkeypatch):
    """The planner goes by the size of the part file, of which every row becomes eight answers: they meet the work list by sort-merge."""
    from knightshift.plans import q_scoring as Q
    monkeypatch.setattr(Q, "scratch_path", lambda s, name: f"{tmp_path}/query")
    spark.range(200).selectExpr("id AS p_partkey", "'n' AS p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    plan = Q.q_resume_from_checkpoints(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x and "puzzle_id" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)
