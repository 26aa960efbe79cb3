"""Match text (PGN) source: many games per file, one record per game.

A game begins at a tag line that does not go on with a header block, or at a
move line after the blank line that ended the game before.  Tag lines and blank
lines inside a ``{comment}`` are comment text.  What a line means so depends on all
lines before it; a file is still read by many tasks, block by block:

1. every block is read once and says, for each state in which it may begin, in which
   state it ends and how many games begin in it (a transition summary of a few
   numbers).  Paths from all states but that inside a comment meet at its first tag
   or text line: the lines up to there, its head, go into the summary, and the games
   behind are cut at once, numbered from the head on;
2. the summaries of a file, in block order, compose to the true state at the
   beginning of each block, and the counts to the number of games before it, which
   are added to the numbers of its games.  The heads are cut from the true states;
3. a block that begins inside a comment, whose lines mean something else for longer
   than its head, is read again from its true state.

The first and the last game of a block may go on in other blocks: only these pieces,
a few a block, are brought together.

The cut games are written as a table in the shared folder, so that the text is
scanned once whatever is done with the games.  Lines are looked at in Arrow
batches; no line is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.joins import fits
from ..session import cut_lineage, discard

BLOCK = ["match_id", "file", "block"]
PIECE = "match_id string, file string, block long, part int, game_no long, whole boolean, value string"
PIECES = [c.split()[0] for c in PIECE.split(", ")]
INSIDE = 5                           # the state inside a comment
SCANNED = f"{PIECE}, ends array<int>, games array<long>, head array<string>, head_games array<long>, met boolean"


def _scanner():
    """The line automaton, as functions that travel to the tasks whole.

    States at the beginning of a line: outside any game, after a tag line, after one or two blank lines behind the
    tags, in the moves, inside a comment.
    """
    OUTSIDE, TAGS, BLANK_1, BLANK_2, MOVES, COMMENT = range(6)
    LINE_KINDS = BLANK, ESCAPE, TAG, BRACKET, TEXT = range(5)
    TOGETHER = 256                   # lines of a head after which a path from inside a comment may stay apart
    STARTS = 8                       # added to the state behind a line at which a game begins

    def after(state: int, kind: int, opened: bool, kept: bool) -> int:
        """State behind a line; ``opened``, ``kept``: it ends inside a comment if it began outside, or inside, of one."""
        moves = COMMENT if opened else MOVES
        if state == COMMENT:
            return COMMENT if kept else MOVES
        if kind == ESCAPE:
            return state
        if kind == BLANK:
            return {TAGS: BLANK_1, BLANK_1: BLANK_2}.get(state, OUTSIDE)
        if kind == TAG or kind == BRACKET and state in (TAGS, BLANK_1):
            return TAGS if state in (TAGS, BLANK_1) else TAGS + STARTS
        return moves + STARTS if state == OUTSIDE else moves

    table = [[after(s, k, bool(o), bool(c)) for k in LINE_KINDS for o in (0, 1) for c in (0, 1)] for s in range(6)]

    # next state, whether a game begins, whether the line belongs to none
    rules = [[(s % STARTS, s >= STARTS, s == OUTSIDE or c // 4 == ESCAPE and state != COMMENT) for c, s in enumerate(row)] for state, row in enumerate(table)]

    def opens(lines):
        """Whether each line ends inside a comment, if it begins outside of one."""
        import pyarrow.compute as pc
        return pc.match_substring(pc.replace_substring_regex(lines, r"\{[^}]*\}|;.*", ""), "{").to_numpy(zero_copy_only=False)

    def codes(lines) -> list[int]:
        """Kind of each line and what it does to comments, as one small number."""
        import numpy as np
        import pyarrow.compute as pc
        kind = pc.if_else(pc.match_substring_regex(lines, r"^\s*$"), BLANK,
                          pc.if_else(pc.match_substring_regex(lines, r"^[%;]"), ESCAPE,
                                     pc.if_else(pc.match_substring_regex(lines, r'^\s*\[[A-Za-z0-9][A-Za-z0-9_+#=:-]*\s+".*"\]\s*$'), TAG,
                                                pc.if_else(pc.starts_with(lines, "["), BRACKET, TEXT))))
        out = 4 * kind.to_numpy(zero_copy_only=False).astype(np.int64) + 1      # no brace: a comment stays open, none is opened
        braces = np.flatnonzero(pc.match_substring_regex(lines, r"[{}]").to_numpy(zero_copy_only=False))
        if len(braces):
            text = lines.take(braces)
            kept = ~pc.match_substring(text, "}").to_numpy(zero_copy_only=False) | opens(pc.replace_substring_regex(text, r"^[^}]*\}", ""))
            out[braces] += 2 * opens(text) + kept - 1
        return out.tolist()

    def bare(lines, first: bool):
        """Lines without nulls; a byte order mark before the first line of a file goes."""
        import pyarrow as pa
        import pyarrow.compute as pc
        lines = pc.fill_null(lines.cast(pa.string()), "")
        if first and len(lines):
            return pa.concat_arrays([pa.array([lines[0].as_py().lstrip("\ufeff")], lines.type), lines[1:]])
        return lines

    def runs(batch):
        """Consecutive rows of one block: ((match, file, block), first row, end)."""
        import numpy as np
        import pyarrow.compute as pc
        n = len(batch)
        if not n:
            return
        new = [pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in (batch.column("file"), batch.column("block"))]
        firsts = [0, *(np.flatnonzero(new[0] | new[1]) + 1).tolist(), n]
        for a, z in zip(firsts, firsts[1:]):
            yield tuple(batch.column(c)[a].as_py() for c in ("match_id", "file", "block")), a, z

    def steps(state: int, lines: list[int]):
        """State behind the lines, places of those that begin a game, and of those that belong to none."""
        begin, drop = [], []
        for i, c in enumerate(lines):
            state, begins, dropped = rules[state][c]
            if begins:
                begin.append(i)
            if dropped:
                drop.append(i)
        return state, begin, drop

    class Cutter:
        """Games of the lines of a block that come from ``state`` on, numbered from ``game_no``.

        What stands before the first game's first line, and the last game, which may go on, are not ``whole``.
        """

        def __init__(self, key, part, state, game_no):
            self.key, self.part, self.state, self.game_no, self.text, self.first = key, part, state, game_no, [], True

        def rows(self, values, game_no, whole):
            import pyarrow as pa
            n = len(values)
            columns = [*(pa.repeat(pa.scalar(v, kind), n) for v, kind in zip(self.key, (pa.string(), pa.string(), pa.int64()))),
                       pa.repeat(pa.scalar(self.part, pa.int32()), n), pa.array(game_no, pa.int64()), pa.repeat(whole, n), values]
            return pa.RecordBatch.from_arrays(columns, names=["match_id", "file", "block", "part", "game_no", "whole", "value"])

        def add(self, lines, kinds):
            """Rows of the games that end before the last of these lines."""
            import numpy as np
            import pyarrow as pa
            import pyarrow.compute as pc
            self.state, begin, drop = steps(self.state, kinds)
            if drop:
                keep = np.ones(len(lines), bool)
                keep[drop] = False
                lines = lines.filter(pa.array(keep))
                begin = (np.asarray(begin, np.int64) - np.searchsorted(drop, begin)).tolist()
            borders = [0, *begin, len(lines)]
            games = pc.binary_join(pa.ListArray.from_arrays(pa.array(borders, pa.int32()), lines), "\n")
            if borders[1]:
                self.text.append(games[0].as_py())
            if not begin:
                return
            if self.text:
                yield self.rows(pa.array(["\n".join(self.text)], pa.string()), [self.game_no], not self.first)
            if len(begin) > 1:
                yield self.rows(games[1:-1], np.arange(1, len(begin)) + self.game_no, True)
            self.text, self.first, self.game_no = [games[-1].as_py()], False, self.game_no + len(begin)

        def end(self):
            import pyarrow as pa
            if self.text:
                yield self.rows(pa.array(["\n".join(self.text)], pa.string()), [self.game_no], False)

    def scan(batches):
        """Games behind each block's head, and a row a block: for each state in which it may begin the state in which it ends and the
        games that begin in it, in all and in its head; the head's lines, and whether all paths have met in it."""
        import pyarrow as pa

        piece = pa.schema([("match_id", pa.string()), ("file", pa.string()), ("block", pa.int64()), ("part", pa.int32()),
                           ("game_no", pa.int64()), ("whole", pa.bool_()), ("value", pa.string())])
        schema = pa.schema([*piece, ("ends", pa.list_(pa.int32())), ("games", pa.list_(pa.int64())), ("head", pa.list_(pa.string())),
                            ("head_games", pa.list_(pa.int64())), ("met", pa.bool_())])
        now, ends, games, head, head_games, met, body = None, [], [], [], [], False, None

        def filled(batch):
            nothing = [pa.nulls(len(batch), f.type) for f in list(schema)[len(piece):]]
            return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in piece), *nothing], schema=schema)

        def finished():
            if body:
                yield from map(filled, body.end())
            yield pa.RecordBatch.from_pylist([{"match_id": now[0], "file": now[1], "block": now[2], "ends": ends, "games": games, "head": head,
                                               "head_games": head_games if body else games, "met": met or body is None}], schema)

        for batch in batches:
            for key, a, z in runs(batch):
                new = key != now
                if new:
                    if now is not None:
                        yield from finished()
                    now, ends, games, head, head_games, met, body = key, list(range(6)), [0] * 6, [], [], False, None
                lines = bare(batch.column("value").slice(a, z - a), new and key[2] == 0)
                kinds = codes(lines)
                n = 0
                while body is None and n < len(kinds):
                    ends = [table[s][kinds[n]] for s in ends]
                    games = [g + (s >= STARTS) for g, s in zip(games, ends)]
                    ends = [s % STARTS for s in ends]
                    n += 1
                    met = len(set(ends)) == 1
                    if met or len(head) + n >= TOGETHER and len(set(ends[:COMMENT])) == 1:
                        body, head_games = Cutter(key, 1, ends[0], 0), games
                head = head + lines[:n].to_pylist() if n else head
                if n < len(kinds):
                    kinds, before = kinds[n:], body.game_no
                    if ends[COMMENT] != body.state:             # the path from inside a comment goes on by itself
                        inside, begin, _ = steps(ends[COMMENT], kinds)
                    yield from map(filled, body.add(lines[n:], kinds))
                    more = body.game_no - before
                    apart = ends[COMMENT] != ends[0]
                    games = [*(g + more for g in games[:COMMENT]), games[COMMENT] + (len(begin) if apart else more)]
                    ends = [*[body.state] * COMMENT, inside if apart else body.state]
        if now is not None:
            yield from finished()

    def cut(batches):
        """Games of each block, from its true state ``state`` and with ``before`` games before it."""
        now, games = None, None
        for batch in batches:
            for key, a, z in runs(batch):
                new = key != now
                if new:
                    if now is not None:
                        yield from games.end()
                    now, games = key, Cutter(key, 1, batch.column("state")[a].as_py(), batch.column("before")[a].as_py())
                lines = bare(batch.column("value").slice(a, z - a), new and key[2] == 0)
                yield from games.add(lines, codes(lines))
        if now is not None:
            yield from games.end()

    def heads(batches):
        """Pieces of the blocks' heads, from their true states: none is whole."""
        import pyarrow as pa
        import pyarrow.compute as pc
        for batch in batches:
            for i in range(len(batch)):
                key = tuple(batch.column(c)[i].as_py() for c in ("match_id", "file", "block"))
                games = Cutter(key, 0, batch.column("state")[i].as_py(), batch.column("before")[i].as_py())
                lines = batch.column("head")[i].values
                for rows in [*games.add(lines, codes(lines)), *games.end()]:
                    yield rows.set_column(5, "whole", pc.and_(rows.column("whole"), False))

    return scan, cut, heads


def _composed(blocks: DataFrame) -> DataFrame:
    """Blocks with ``state``, in which they begin, and ``games``, how many begin in them: a file's summaries in order.

    The files of a task go by one after the other, so that many small files cost no more than a few large ones.
    """
    kept = [f for f in blocks.schema.fields if f.name not in (*BLOCK, "ends", "games")]
    names = [f.name for f in kept]

    def compose(batches):
        import pyarrow as pa

        now, state = None, 0
        for batch in batches:
            states, games = [], []
            for file, ends, counts in zip(*(batch.column(c).to_pylist() for c in ("file", "ends", "games"))):
                if file != now:
                    now, state = file, 0
                states.append(state)
                games.append(counts[state])
                state = ends[state]
            yield pa.RecordBatch.from_arrays([batch.column("match_id"), batch.column("file"), batch.column("block"),
                                              pa.array(states, pa.int32()), pa.array(games, pa.int64()), *map(batch.column, names)],
                                             names=["match_id", "file", "block", "state", "games", *names])

    in_order = blocks.repartition("file").sortWithinPartitions("file", "block")
    return in_order.mapInArrow(compose, ", ".join(["match_id string, file string, block long, state int, games long",
                                                   *(f"{f.name} {f.dataType.simpleString()}" for f in kept)]))


def _meet(rows: DataFrame, blocks: DataFrame) -> tuple[DataFrame, bool]:
    """``rows`` with what their block has to say; whether the blocks were few enough to be sent to them."""
    sent = fits(blocks)
    own = blocks.withColumnsRenamed({"match_id": "b_match", "file": "b_file", "block": "b_block"})
    j = rows.join(F.broadcast(own) if sent else own.hint("merge"), (F.col("file") == F.col("b_file")) & (F.col("block") == F.col("b_block")))
    return j.drop("b_match", "b_file", "b_block"), sent


def read_games_text(spark: SparkSession, path: str, match_from_path: bool = True) -> DataFrame:
    """One row per game text: (match_id, file, game_no, pgn); ``game_no`` counts the games of a match.

    Files are taken in the order of their paths.  ``%`` lines and whole-line ``;`` comments are left out, lines end in
    a line feed, blank lines around a game go.
    """
    lines = (spark.read.text(path)
             .select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")))
    if "match_id" not in lines.columns:
        found = F.regexp_extract("file", r"match_id=([^/]+)", 1) if match_from_path else F.lit(None).cast("string")
        lines = lines.withColumn("match_id", found)
    lines = lines.select(F.col("match_id").cast("string").alias("match_id"), "file", "block", "value")
    scan, cut, heads = _scanner()
    scanned = cut_lineage(lines.mapInArrow(scan, SCANNED), "game-pieces")
    before = Window.partitionBy("match_id").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = _composed(scanned.where("ends IS NOT NULL").select(*BLOCK, "ends", "games", "head", "head_games", "met"))
    blocks = cut_lineage(blocks.select(*BLOCK, "state", F.coalesce(F.sum("games").over(before), F.lit(0)).alias("before"), "head",
                                       F.get("head_games", F.col("state")).alias("in_head"), F.expr(f"state = {INSIDE} AND NOT met").alias("again")), "text-blocks")
    body, _ = _meet(scanned.where("ends IS NULL").select(*PIECES), blocks.where("NOT again").select(*BLOCK, "before", "in_head"))
    pieces = body.withColumn("game_no", F.col("game_no") + F.col("before") + F.col("in_head")).select(*PIECES)
    pieces = pieces.unionByName(blocks.where("NOT again AND size(head) > 0").select(*BLOCK, "state", "before", "head").mapInArrow(heads, PIECE))
    pieces = cut_lineage(pieces, "numbered-pieces")      # whoever reads the games finds them numbered
    discard(scanned)
    if not blocks.where("again").isEmpty():
        joined, sent = _meet(lines.withColumn("seq", F.monotonically_increasing_id()), blocks.where("again").select(*BLOCK, "state", "before"))
        if not sent:             # too many blocks to send: the lines meet theirs by shuffle and go back in order
            joined = joined.repartition("file", "block").sortWithinPartitions("file", "block", "seq")
        pieces = pieces.unionByName(cut_lineage(joined.select(*BLOCK, "state", "before", "value").mapInArrow(cut, PIECE), "again-pieces"))
    joint = (pieces.where("NOT whole").groupBy("match_id", "game_no")
             .agg(F.min("file").alias("file"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "block", "part", "value"))), lambda x: x["value"]), "\n").alias("value")))
    games = pieces.where("whole").select("match_id", "file", "game_no", "value").unionByName(joint.select("match_id", "file", "game_no", "value"))
    return games.select("match_id", "file", "game_no", F.regexp_replace("value", r"\s+$", "").alias("pgn"))


def lookup_match(games: DataFrame, match_id: str, column: str = "moves_pgn") -> DataFrame:
    """S9 + S10: games of ``match_id``; else of the first match whose id contains it.

    ``games`` should be the stored game table, whose files are sorted by match:
    the filter then reads the row groups of one match only.  Raises when nothing
    matches or the stored text column is missing.
    """
    if column not in games.columns:
        raise ValueError(f"table does not contain stored {column} column")
    exact = games.where(F.col("match_id") == match_id)
    if exact.limit(1).count() > 0:
        return exact
    first = (games.where(F.col("match_id").contains(match_id))
             .agg(F.min("match_id").alias("m")).collect()[0]["m"])
    if first is None:
        raise FileNotFoundError(f"no match found for id {match_id}")
    return games.where(F.col("match_id") == first)
