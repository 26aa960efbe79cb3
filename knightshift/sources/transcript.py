"""Engine transcripts (S12): the text of an engine session, one file (or directory)
per session, turned into one answer per position asked.

A ``go`` line asks; the answer is the first ``bestmove`` line before the next
``go``.  A question without one (the engine stopped, or was asked again) has an
empty move, which counts as wrong.  Depth and speed are the last values printed
on ``info`` lines up to the answer (a value that does not parse keeps the one
before); lines printed after an answer are read with the next question, and with
none if there is no further ``go``.

A session that was logged without its ``go`` lines is cut at the ``bestmove``
lines; text behind the last one is an unanswered question only if it reports a
search (a depth or a speed).

Lines are numbered per session with the balanced running count, so a session of
any length is split over many tasks; what follows works on one row an answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordered import running_totals
from ..plans.joins import bounded_broadcast
from ..session import cut_lineage


def read_transcripts(spark: SparkSession, path: str, session_from_path: bool = True) -> DataFrame:
    """Lines with (session, file, block, seq) order keys."""
    df = (spark.read.text(path)
          .select("*", F.col("_metadata.file_path").alias("file"),
                  F.col("_metadata.file_block_start").alias("block"),
                  F.monotonically_increasing_id().alias("seq")))
    if "session" not in df.columns:
        df = df.withColumn("session", F.col("file") if not session_from_path else
                           F.regexp_extract("file", r"session=([^/]+)", 1))
    return df.select("session", "file", "block", "seq", F.col("value").alias("line"))


def _value_after(tokens, word: str):
    pos = F.array_position(tokens, word)
    return F.when(pos > 0, F.try_element_at(tokens, (pos + 1).cast("int")))


def parse_transcript(lines: DataFrame) -> DataFrame:
    """(session, position, bestmove, depth, nps) per position asked."""
    line = F.col("line")
    is_info, is_best = line.contains("info"), line.contains("bestmove")
    says = lines.withColumn("line", F.trim("line")).where(is_info | is_best | line.startswith("go"))
    tokens = F.col("tokens")
    x = says.withColumn("tokens", F.split(line, r"\s+")).select(
        "session", "file", "block", "seq", (tokens[0] == "go").alias("is_go"), is_best.alias("is_best"),
        F.when(is_info, _value_after(tokens, "depth").try_cast("int")).alias("depth_v"),
        F.when(is_info, _value_after(tokens, "nps").try_cast("double")).alias("nps_v"),
        F.when(is_best, F.coalesce(F.try_element_at(tokens, F.lit(2)), F.lit(""))).alias("move"))
    # lines that neither ask, nor answer, nor report a value leave every count and value as it is; stored, the others are read twice
    x = cut_lineage(x.where("is_go OR is_best OR depth_v IS NOT NULL OR nps_v IS NOT NULL"), "transcript-lines")
    # file blocks are natural, bounded chunks of the line order: no sampling pass
    numbered = running_totals(x, ["session"], ["file", "block", "seq"],
                              {"go": F.col("is_go").cast("bigint"), "best": F.col("is_best").cast("bigint")},
                              row_number="line_no", chunk_by=["file", "block"])
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("line_no", F.col(c).alias("v")))).alias(c)
    # runs of lines between two marks: behind ``go`` number ``go``, with ``best`` answers before them
    runs = numbered.withColumn("best", F.col("best") - F.col("is_best").cast("bigint")).groupBy("session", "go", "best").agg(
        last("depth_v"), last("nps_v"), F.max("move").alias("move"))
    runs = cut_lineage(runs, "transcript-runs")
    asked = runs.groupBy(F.col("session").alias("__s")).agg(F.max("go").alias("asked"))
    runs = runs.join(bounded_broadcast(asked), F.col("session").eqNullSafe(F.col("__s"))).drop("__s")
    behind = (F.col("go") == 0) | (F.col("best") > F.min("best").over(Window.partitionBy("session", "go")))
    by_question = runs.where("asked > 0").withColumn("behind", behind).select(
        "session", "asked", "depth_v", "nps_v", F.when(~F.col("behind"), F.col("move")).alias("move"),
        (F.col("go") + F.col("behind").cast("bigint")).alias("position"))
    reported = F.col("move").isNotNull() | F.col("depth_v").isNotNull() | F.col("nps_v").isNotNull()
    by_answer = runs.where((F.col("asked") == 0) & reported).select("session", "asked", "depth_v", "nps_v", "move", (F.col("best") + 1).alias("position"))
    per = by_question.unionByName(by_answer).where("asked = 0 OR position <= asked").groupBy("session", "position").agg(
        F.max("depth_v").alias("depth"), F.max("nps_v").alias("nps"), F.max("move").alias("bestmove"))
    return per.select("session", "position", F.coalesce("bestmove", F.lit("")).alias("bestmove"),
                      F.coalesce("depth.v", F.lit(0)).alias("depth"), F.coalesce("nps.v", F.lit(0.0)).alias("nps"))
