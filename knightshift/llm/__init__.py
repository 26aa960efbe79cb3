"""Operators of a training-data pipeline.

    token_counts        token counts with a whole-token shortcut
    quality_rules       line-frequency quality rules (DataFrame functions only)
    ngram_join          exact n-gram Jaccard join
    packing             optimal length buckets
    mixing              mixing sources to target weights
    exact_dedup         extendible-hash index of whole texts
    pii                 weak-supervision personal-data spans (DataFrame functions only)
    warc                archive writer and chunked record reader
    toxicity            multiple-instance toxicity model
    quality_classifier  supervised subword embeddings

``queries`` holds one thin ``opN_*`` query for each and, where SQL can say it, its DuckDB SQL.
"""
