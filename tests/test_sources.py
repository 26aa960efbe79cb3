"""Sources on multi-split files: game numbering in file order and transcript positions."""
import os
import tempfile

from pyspark.sql import functions as F

from knightshift.operators import matches as M
from knightshift.sources.pgn import read_games_text


def _pgn(i):
    return (f'[Event "m"]\n[Site "game {i}"]\n[White "Lc0"]\n[Black "Reckless"]\n[Result "1-0"]\n\n'
            f'1. e4 {{+0.{10 + i % 80}/{i % 30 + 1} 0.{10 + i % 80}s}} e5 {{book}} 2. Nf3 1-0\n\n')


def test_game_numbers_across_splits(spark):
    d = tempfile.mkdtemp(prefix="ks-pgn-")
    os.makedirs(f"{d}/match_id=m1")
    with open(f"{d}/match_id=m1/a.pgn", "w") as f:
        f.write("".join(_pgn(i) for i in range(1, 3001)))
    with open(f"{d}/match_id=m1/b.pgn", "w") as f:
        f.write("".join(_pgn(i) for i in range(3001, 4001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")     # many splits per file
    try:
        games = read_games_text(spark, d)
        p = M.parse_games(games)
        got = p.select("game_no", F.regexp_extract(M.header("pgn", "Site"), r"(\d+)$", 1).cast("long").alias("src"),
                       F.size("moves").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 4000
    assert all(r.game_no == r.src for r in got)
    assert all(r.n == 3 for r in got)


def test_zstd_dump_with_spread(spark):
    import zstandard
    from knightshift.operators import puzzles as P
    from knightshift.sources.puzzles import read_puzzle_dump
    d = tempfile.mkdtemp(prefix="ks-zst-")
    start = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
    lines = ["PuzzleId,FEN,Moves,Rating,Popularity"]
    lines += [f"z{i},{start},e2e4 e7e5,{1000 + i},{i % 150 - 20}" for i in range(600)]
    lines += ["z5,bad,e2e4 e7e5,2000,90", "short,row"]
    with open(f"{d}/dump.csv.zst", "wb") as f:
        f.write(zstandard.ZstdCompressor().compress(("\n".join(lines) + "\n").encode()))
    raw = read_puzzle_dump(spark, f"{d}/dump.csv.zst", partitions=4)
    c = P.classify_dump(raw, min_rating=1200, popularity_min=80)
    got = {r.status: r.n for r in c.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    exp_ok = sum(1 for i in range(600) if 1000 + i >= 1200 and i % 150 - 20 >= 80)
    assert got["accepted"] == exp_ok and got["short_row"] == 1 and got["bad_position"] == 1
    first = P.dedupe_first(P.accepted(c)).where(F.col("puzzle_id") == "z5").collect()
    assert len(first) == 0 or first[0].rating == 1005      # the first z5 line wins over the later one


def test_manifest_defaults_and_explicit_null(spark):
    from knightshift.sources.runs import read_manifests
    d = tempfile.mkdtemp(prefix="ks-man-")
    with open(f"{d}/a_meta.json", "w") as f:
        f.write('{\n  "run_id": "a",\n  "movetime_ms": 100,\n  "min_rating": null\n}\n')
    with open(f"{d}/b_meta.json", "w") as f:
        f.write('{"run_id": "b", "engines": ["X"], "concurrency": 3}')
    with open(f"{d}/c_meta.json", "w") as f:
        f.write('{"run_id": "c", ')                       # broken: skipped
    rows = {r.run_id: r for r in read_manifests(spark, f"{d}/*_meta.json").collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"].movetime_ms == 100 and rows["a"].min_rating is None and rows["a"].concurrency == 1
    assert rows["a"].engines == ["Stockfish 18", "Pawnocchio 2.0.1", "Reckless 0.9.0", "Lc0 v0.32.1"]
    assert rows["b"].movetime_ms == 500 and rows["b"].engines == ["X"] and rows["b"].concurrency == 3


def test_transcript_defaults(spark):
    from knightshift.sources.transcript import parse_transcript, read_transcripts
    d = tempfile.mkdtemp(prefix="ks-tr-")
    os.makedirs(f"{d}/session=s1")
    with open(f"{d}/session=s1/t.txt", "w") as f:
        f.write("info depth 5 nps 100\ninfo depth 7 nps bad\nbestmove e2e4 ponder e7e5\n"
                "info string nothing\nbestmove\n"
                "info depth 3 nps 10\n")                  # no bestmove: stopped, no move
    got = sorted(tuple(r) for r in parse_transcript(read_transcripts(spark, d)).collect())
    assert got == [("s1", 1, "e2e4", 7, 100.0), ("s1", 2, "", 0, 0.0), ("s1", 3, "", 3, 10.0)]


def test_positions_are_counted_by_question(spark):
    from knightshift.sources.transcript import parse_transcript, read_transcripts
    d = tempfile.mkdtemp(prefix="ks-go-")
    sessions = {
        "dies": "id name X\ngo movetime 9\n",                                       # before any info
        "twice": "go\ninfo depth 4 nps 1\ngo\ninfo depth 6\nbestmove a1a2\n",       # two questions, one answer
        "tail": "go\ninfo depth 5\nbestmove e2e4\ninfo string bye\ninfo depth 99\n", # text behind the last answer
        "late": "go\nbestmove a1a2\ninfo depth 7 nps 3\ngo\nbestmove b1b2\nbestmove c1c2\n",   # read with the next question
        "plain": "info depth 5\nbestmove e2e4\ninfo string bye\n",                  # logged without questions
        "stops": "bestmove e2e4\ninfo nps 8\ngoing\n",
    }
    for name, text in sessions.items():
        os.makedirs(f"{d}/session={name}")
        with open(f"{d}/session={name}/t.txt", "w") as f:
            f.write(text)
    got = sorted(tuple(r) for r in parse_transcript(read_transcripts(spark, d)).collect())
    assert got == sorted([
        ("dies", 1, "", 0, 0.0), ("twice", 1, "", 4, 1.0), ("twice", 2, "a1a2", 6, 0.0), ("tail", 1, "e2e4", 5, 0.0),
        ("late", 1, "a1a2", 0, 0.0), ("late", 2, "b1b2", 7, 3.0), ("plain", 1, "e2e4", 5, 0.0),
        ("stops", 1, "e2e4", 0, 0.0), ("stops", 2, "", 0, 8.0)])


def test_shards_cut_by_record_count(spark):
    from knightshift.sinks.files import write_shards
    d = tempfile.mkdtemp(prefix="ks-sh-")
    df = spark.range(1000).selectExpr("concat('p', id) AS puzzle_id", "'x' AS fen").repartition(3)
    write_shards(df, f"{d}/s", shard_size=300)
    counts = spark.read.parquet(f"{d}/s").groupBy(F.col("_metadata.file_name")).count().collect()
    assert sum(r["count"] for r in counts) == 1000 and max(r["count"] for r in counts) <= 300


def test_repeated_tag_keeps_last_value(spark):
    d = tempfile.mkdtemp(prefix="ks-tag-")
    os.makedirs(f"{d}/match_id=m")
    with open(f"{d}/match_id=m/g.pgn", "w") as f:
        f.write('[Event "m"]\n[White "A"]\n[Black "B"]\n[Result "*"]\n[Result "1-0"]\n\n1. e4 e5 1-0\n\n')
    r = M.parse_games(read_games_text(spark, d)).collect()[0]
    assert (r.white, r.black, r.result, r.game_no) == ("A", "B", "1-0", 1)


def _games(spark, files):
    d = tempfile.mkdtemp(prefix="ks-odd-")
    os.makedirs(f"{d}/match_id=m1")
    for name, text in files.items():
        with open(f"{d}/match_id=m1/{name}", "w", newline="") as f:
            f.write(text)
    return read_games_text(spark, d)


def _moves(spark, movetext, head='[Event "m"]\n'):
    r = M.parse_games(_games(spark, {"a.pgn": f"{head}\n{movetext}\n"})).collect()[0]
    return [(m.move_san, m.comment, m.depth, m.seconds) for m in r.moves], r.plies


def test_no_game_is_dropped_and_numbers_have_no_gap(spark):
    odd = '[Event "m \\"cup\\" 2"]\n[Site "game {0}"]\n\n1. e4 *\n\n'
    plain = '[Event "m"]\n[Site "game {0}"]\n\n1. e4 *\n\n'
    games = _games(spark, {"a.pgn": "\ufeff; preamble\n" + plain.format(1) + odd.format(2) + plain.format(3),
                           "b.pgn": odd.format(4) + plain.format(5)})
    got = sorted((r.game_no, r.site) for r in M.parse_games(games).select("game_no", M.header("pgn", "Site").alias("site")).collect())
    assert got == [(i, f"game {i}") for i in range(1, 6)]
    ids = M.game_table(M.parse_games(games), "a", "b", "t").select("game_id").collect()
    assert sorted(r.game_id for r in ids) == [f"m1_g{i}" for i in range(1, 6)]


def _cut(spark, files, split=None):
    """(game_no, text) of the games of some files, read in blocks of ``split`` bytes."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        return sorted((r.game_no, r.pgn) for r in _games(spark, files).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_tags_inside_comments_cut_no_game(spark):
    one = '[Event "A"]\n[White "B"]\n\n1. e4 {as in [Event "Old"] } e5 2. Nf3'
    two = '[White "C"]\n[Black "D"]\n\n1. d4 {a comment over lines\n\n[Event "none"]\n[White "none"]\n\nends} d5 *'
    three = "1. c4 c5"                               # moves without any tag are a game
    files = {"a.pgn": f"{one}\n\n{two}\n\n\n{three}\n"}
    for split in (None, 40):                         # block borders inside comments, tags and blank lines
        assert _cut(spark, files, split) == [(1, one), (2, two), (3, three)]
    parsed = sorted((r.game_no, r.white, r.plies) for r in M.parse_games(_games(spark, files)).select("game_no", "white", "plies").collect())
    assert parsed == [(1, "B", 3), (2, "C", 2), (3, None, 2)]


def test_what_ends_a_game(spark):
    head, more = '[Event "A"]', '[Site "x"]'
    cases = [
        (f"{head}\n\n{more}\n\n1. e4 *\n", 1),                # one blank line between tags
        (f"{head}\n\n\n1. e4 *\n", 1),                        # two before the moves
        (f"{head}\n\n\n{more}\n\n1. e4 *\n", 2),             # tags after two blank lines begin a game
        (f"{head}\n1. e4 e5\n2. d4 *\n{head}\n1. c4\n", 2),   # tags right behind moves, too
        (f"{head}\n\n1. e4 *\n \t\n2. d4\n", 2),              # moves behind a blank line are another game
        (f"% escaped\n; note {{\n{head}\n; {{ no comment\n\n1. e4 ; {{ nor here\n\n{head}\n\n1. d4\n", 2),
        (f"{head}\n\n1. e4 {{never closed\n\n{head}\n\n1. d4\n", 1),
        (f"{head}\n[Broken tag\n{more}\n\n1. e4 }} e5 {{a}} {{b\n}} c5\n\n1. d4", 2),
        ("\n\n \n% only this\n", 0), ("", 0),
    ]
    d = tempfile.mkdtemp(prefix="ks-ends-")
    for k, (text, _) in enumerate(cases):
        os.makedirs(f"{d}/match_id={k}")
        with open(f"{d}/match_id={k}/a.pgn", "w") as f:
            f.write(text)
    got = {int(r.match_id): r["count"] for r in read_games_text(spark, d).groupBy("match_id").count().collect()}
    assert got == {k: n for k, (_, n) in enumerate(cases) if n}


def test_any_blocks_cut_the_same_games(spark):
    """Random lines: every block size gives what one pass over the whole file gives."""
    import random
    rng = random.Random(6)
    lines = ['[Event "m"]', '[White "a{"]', "[Bad", "", "", " ", "1. e4 {x", "} e5 {", "} ; {", "% p", "; q }", "2. d4 d5", "{a} {b}", "{", "}", "é {ü}"]
    files = {f"{k}.pgn": "".join(rng.choice(lines) + rng.choice(["\n", "\n", "\r\n"]) for _ in range(90)) for k in "ab"}
    whole = _cut(spark, files)
    assert len(whole) > 10 and [n for n, _ in whole] == list(range(1, len(whole) + 1))
    for split in (33, 200):
        assert _cut(spark, files, split) == whole


def test_variations_of_any_depth_are_left_out(spark):
    got, plies = _moves(spark, "1. e4 (1. d4 (1. c4 (1. b3 (1. a3 a6) b6) c5) d5) e5 2. Nf3")
    assert [m[0] for m in got] == ["e4", "e5", "Nf3"] and plies == 3


def test_comments_are_whole_and_all_kept(spark):
    got, _ = _moves(spark, "1. e4 {+0.10/8 1.0s; book} e5 {bad (} 2. Nf3 {fine )} {book} {+0.20/9 2.5s} Nc6 ; Bb5 {x}\n3. Bb5 (3. d4 {+9/9 9s}) {after [x]} $3 {$4}")
    assert got == [("e4", "+0.10/8 1.0s; book", 8, 1.0), ("e5", "bad (", None, None),
                   ("Nf3", "fine ) book +0.20/9 2.5s", 9, 2.5), ("Nc6", "", None, None), ("Bb5", "after [x] $4", None, None)]
    assert _moves(spark, "{intro} *") == ([], 0)


def test_annotating_twice_changes_nothing(spark):
    text = '[Event "m"]\r\n[White "a"]\r\n[WhiteAvgDepth "99.0"]\r\n\r\n1. e4 {+0.10/8 1.0s TAGS_PLACEHOLDER} e5 *\r\n'
    one = M.annotate(M.parse_games(_games(spark, {"a.pgn": text}))).collect()[0].annotated_pgn
    assert one.count("WhiteAvgDepth") == 1 and '[WhiteAvgDepth "8.0"]' in one and "TAGS_PLACEHOLDER}" in one
    assert one.index("[Annotator") < one.index("\n\n1. e4")
    two = M.annotate(M.parse_games(_games(spark, {"a.pgn": one}))).collect()[0].annotated_pgn
    assert one == two
    stored = M.game_table(M.parse_games(_games(spark, {"a.pgn": text})), "a", "b", "t").collect()[0].moves_pgn
    assert '[WhiteAvgDepth "8.0"]' in stored and "BlackAvgDepth" not in stored and "[Annotator" in stored


def test_dump_headers_in_any_order_and_per_file(spark):
    from knightshift.sources.puzzles import read_puzzle_dump
    d = tempfile.mkdtemp(prefix="ks-head-")
    start = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
    with open(f"{d}/a.csv", "w") as f:
        f.write(f"Rating,PuzzleId,FEN,Moves\n1500,a1,{start},e2e4 e7e5\n")
    one = read_puzzle_dump(spark, f"{d}/a.csv").collect()
    assert [(r.PuzzleId, r.Rating, r.FEN) for r in one] == [("a1", "1500", start)]
    with open(f"{d}/b.csv", "w") as f:
        f.write(f"PuzzleId,FEN,Moves,Rating,Popularity\nb1,{start},e2e4 e7e5,1600,7\n")
    both = sorted((r.PuzzleId, r.Rating, r.Popularity, r.n_fields, r.n_header) for r in read_puzzle_dump(spark, f"{d}/*.csv").collect())
    assert both == [("a1", "1500", "100", 4, 4), ("b1", "1600", "7", 5, 5)]


def test_only_a_missing_path_reads_as_empty(spark):
    import pytest
    from knightshift.sources.puzzles import read_results
    kind = spark.createDataFrame([], "a string").schema
    d = tempfile.mkdtemp(prefix="ks-none-")
    assert read_results(spark, f"{d}/none/*", schema=kind).count() == 0
    with pytest.raises(Exception):
        read_results(spark, "nosuchscheme://x/y", schema=kind).count()


def test_manifests_are_written_once(spark):
    from knightshift.sinks.files import next_shard, write_manifests, write_shards
    d = tempfile.mkdtemp(prefix="ks-reg-")
    m = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "run_id string, n int")
    assert write_manifests(m, f"{d}/m") == 2 and write_manifests(m, f"{d}/m") == 0
    assert next_shard(spark, f"{d}/s") == 0
    write_shards(spark.createDataFrame([("x", "f", 4)], "puzzle_id string, fen string, shard int"), f"{d}/s", 10, numbered=True)
    assert next_shard(spark, f"{d}/s") == 5


def test_board_is_not_worked_out_for_refused_rows(spark):
    from knightshift.operators import puzzles as P
    raw = spark.createDataFrame([("f", 0, i, 4, 4, f"p{i}", "bad", "e2e4 e7e5", "900") for i in range(5)],
                                "file string, block long, seq long, n_fields int, n_header int, PuzzleId string, FEN string, Moves string, Rating string")
    assert {r.status for r in P.classify_dump(raw, 1000, 0).collect()} == {"below_rating"}
    assert {r.status for r in P.classify_dump(raw, 100, 0).collect()} == {"bad_position"}
    assert P.accepted_dump(raw, 1000, 0).count() == 0
    plan = P.screen(raw, 1000, 0).where("status is null")._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" not in plan


def test_running_stream_continues_without_python(spark):
    from knightshift.streaming.jobs import running_stream
    d = tempfile.mkdtemp(prefix="ks-st4-")
    kind = "engine string, ts long, event_id long, is_correct boolean"
    rows = [("hot" if i % 4 else None, i, i, i % 3 == 0) for i in range(400)]
    for part in (rows[:250], rows[250:]):
        df = spark.createDataFrame(part, kind)
        df.coalesce(1).write.mode("append").parquet(f"{d}/in")
        running_stream(spark, f"{d}/in", df.schema, f"{d}/out", f"{d}/ck")
    got = {r.event_id: (r.processed, r.solved_so_far) for r in spark.read.parquet(f"{d}/out").collect()}
    seen = {}
    for e, _, i, ok in rows:
        n, s = seen.get(e, (0, 0))
        seen[e] = (n + 1, s + ok)
        assert got[i] == seen[e]


def test_summaries_of_many_files_compose_in_a_stream(spark):
    from knightshift.sources.pgn import _composed
    to = lambda s: [s] * 6
    rows = [(f"m{f % 3}", f"f{f:04d}", b, to(b + 1) if b < 2 else [5, 4, 3, 2, 1, 0], [10 * b + s for s in range(6)])
            for f in range(500) for b in (2, 0, 1)]
    composed = _composed(spark.createDataFrame(rows, "match_id string, file string, block long, ends array<int>, games array<long>"))
    assert "FlatMapGroups" not in composed._jdf.queryExecution().executedPlan().toString()
    got = {(r["match_id"], r["file"], r["block"]): (r["state"], r["games"]) for r in composed.collect()}
    assert got == {(f"m{f % 3}", f"f{f:04d}", b): (b, 11 * b) for f in range(500) for b in range(3)}


def test_games_are_ordered_before_they_are_parsed(spark, tmp_path):
    """The range partitioner evaluates its input twice."""
    from knightshift.operators import matches as M
    from knightshift.sinks.files import in_match_order
    raw = spark.createDataFrame([("m", n, f'[White "Lc0"]\n[Result "1-0"]\n\n1. e4 {{+0.1/{n} 1s}} 1-0') for n in (3, 1, 2)], "match_id string, game_no long, pgn string")
    raw.write.parquet(str(tmp_path / "raw"))
    plan = M.annotate(M.parse_games(in_match_order(spark.read.parquet(str(tmp_path / "raw")))))._jdf.queryExecution().executedPlan().toString()
    assert "regexp" in plan and "regexp" not in plan[plan.index("rangepartitioning"):]
    _, games = M.store_games(spark.read.parquet(str(tmp_path / "raw")), str(tmp_path / "db"), "Lc0", "Reckless", "1+0", 2, "t")
    assert sorted(r["total_plies"] * 10 + r["game_no"] for r in spark.read.parquet(games).collect()) == [11, 12, 13]


def test_match_files_grow_instead_of_their_number(spark, monkeypatch):
    import os
    from knightshift.plans import pgn_fixture as PF
    from knightshift.session import scratch_path
    SF_SMALL = "/root/testdata/sf0.001"
    count = lambda path: sum(f.endswith(".txt") for _, _, fs in os.walk(path.removeprefix("file:")) for f in fs)

    def fresh(session, key, build):
        path = scratch_path(session, "pgn-test")
        build(path)
        return path

    monkeypatch.setattr(PF, "landed", fresh)
    monkeypatch.setattr(PF, "GAMES_PER_FILE", 1)
    games = PF.fx.table(spark, SF_SMALL, "orders").count()
    assert count(PF.pgn_files(spark, SF_SMALL)) == games <= PF.FILES
    monkeypatch.setattr(PF, "FILES", 1)
    assert count(PF.pgn_files(spark, SF_SMALL)) < games / 2


def test_transcript_text_is_read_once(spark, tmp_path):
    from knightshift.sources.transcript import parse_transcript, read_transcripts
    text = ["go depth 3", "info string noise", "noise", "info depth 2 nps 10", "bestmove e2e4", "info string late", "", "go depth 3", "bestmove a1b1"]
    spark.createDataFrame([(t,) for t in text], "line string").coalesce(1).write.text(f"{tmp_path}/session=s")
    answers = parse_transcript(read_transcripts(spark, str(tmp_path)))
    assert "FileScan text" not in answers._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, answers.collect())) == [("s", 1, "e2e4", 2, 10.0), ("s", 2, "a1b1", 0, 0.0)]


def test_blocks_inside_a_long_comment(spark):
    """Blocks that begin in a comment and go on in it for longer than their heads are cut again from their true state."""
    from knightshift.sources import pgn
    one = '[Event "A"]\n\n1. e4 {' + "\n".join(["x y", "[Event \"no\"]", "", "% z"] * 600) + "} e5"
    two, three = '[Event "B"]\n\n1. d4 {' + "\n".join(f"c {i}" for i in range(900)) + "} d5 *", '[Event "C"]\n\n1. c4 *'
    files = {"a.pgn": f"{one}\n\n{two}\n\n{three}\n", "b.pgn": f"{three}\n\n{two}\n"}
    whole = _cut(spark, files)
    assert whole == [(1, one), (2, two), (3, three), (4, three), (5, two)]
    for split in (300, 3000):
        cuts = []
        stored, pgn.cut_lineage = pgn.cut_lineage, lambda df, name: cuts.append(name) or stored(df, name)
        try:
            assert _cut(spark, files, split) == whole
        finally:
            pgn.cut_lineage = stored
        assert ("again-pieces" in cuts) == (split == 3000)


def test_match_text_is_scanned_once(spark, monkeypatch):
    from knightshift.sources import pgn
    plans = []
    stored = pgn.cut_lineage
    monkeypatch.setattr(pgn, "cut_lineage", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, name))
    games = _games(spark, {"a.pgn": "".join(_pgn(i) for i in range(1, 20))})
    plans.append(games._jdf.queryExecution().executedPlan().toString())
    assert games.count() == 19 and sum(p.count("FileScan text") for p in plans) == 1


def test_moves_are_shuffled_once_and_text_is_made_behind_the_ranges(spark):
    from knightshift.plans import pgn_fixture as PF
    plan = PF.pgn_games(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "Join" not in plan[plan.index("rangepartitioning"):]
    moves = plan[plan.index("collect_list"):]
    assert moves.count("Exchange hashpartitioning") == 1 and "partial_collect_list" in moves


def test_headers_are_read_together_as_one_by_one(spark):
    texts = ['[A "1"]\n[A "2"]\n[B "x"]\n\n1. e4 {\n[C "no"]}', '\n [B \t "q \\"z\\" ]"] \n[Bx "n"]\n[C ""]', '[A "1"] [B "2"]\n[C\n"3"]\n\n1. d4', "1. c4", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "pgn string")
    names = {"one": "A", "two": "B", "three": "C"}
    apart = df.select("pgn", *[M.header("pgn", n).alias(k) for k, n in names.items()])
    assert sorted(map(repr, M.with_headers(df, "pgn", names).collect())) == sorted(map(repr, apart.collect()))
    p = M.with_headers(spark.createDataFrame([("",)], "pgn string"), "pgn", names)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("regexp_extract(") == 1 and p.count("regexp_extract_all(") == 2


def test_stored_games_meet_their_matches_without_a_shuffle(spark, monkeypatch):
    from knightshift.plans import q_matches as Q
    plan = Q.q_write_matches(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_shared_steps_of_fixed_are_behind_no_condition(spark):
    """Side averages that are null give no line, and their text is not worked out in a branch of its own."""
    from knightshift.functions.columns import fixed
    df = spark.createDataFrame([(None, 0.25, -1.05, 2.675), (3.0, None, 0.05, 0.0005)], "a double, b double, c double, d double")
    got = df.select(*[fixed(c, n).alias(c) for c, n in (("a", 1), ("b", 1), ("c", 1), ("d", 3))]).collect()
    assert [tuple(r) for r in got] == [(None, f"{0.25:.1f}", f"{-1.05:.1f}", f"{2.675:.3f}"), (f"{3.0:.1f}", None, f"{0.05:.1f}", f"{0.0005:.3f}")]
    sides = df.toDF("white_avg_depth", "black_avg_depth", "white_avg_movetime_sec", "black_avg_movetime_sec")
    lines = sides.select(M.telemetry_lines(False).alias("t"))
    assert "isnotnull" not in lines._jdf.queryExecution().analyzed().toString().lower()
    assert sorted(r.t.count("[") for r in lines.collect()) == [4, 4]
    assert {r.t.count("[") for r in sides.select(M.telemetry_lines(True).alias("t")).collect()} == {5}
