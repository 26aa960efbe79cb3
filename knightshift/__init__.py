"""knightshift: Spark-native analytics over engine benchmark data.

Subpackages:
  sources    puzzle dumps, CSV, shards, results, manifests, checkpoints, match text, transcripts
  functions  per-row rules as column expressions (scoring, telemetry, FEN moves, SAN notation)
  operators  DataFrame-to-DataFrame jobs (ingest, scoring, rollups, matches, moves, checks)
  sinks      Parquet tables, CSV and match-text exports
  streaming  Structured Streaming forms of the incremental jobs
  plans      query registry, adapters over the test tables, join planning helpers
"""

__version__ = "0.1.0"
