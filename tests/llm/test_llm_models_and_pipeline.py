"""Toxicity, quality classifier and the pipeline."""
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import empty_docs, hostile_docs, jaccard_components, words
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_SMALL
from knightshift.llm import packing, quality_classifier, toxicity
from knightshift.llm.common import fit_sample, held_out, ship_package, table
from knightshift.llm.queries import QUERIES
from knightshift.llm.textblocks import blocks, char_ngrams, find_words

SF_LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def test_held_out_fold_is_crc32(spark):
    got = {r[0]: r[1] for r in spark.range(500).select("id", held_out(F.col("id"))).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(500)}


def test_a_long_text_does_not_end_the_sample(spark):
    ids = [i for i in range(1, 41) if zlib.crc32(str(i).encode()) % 5]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    place = spark.createDataFrame([(i,) for i in ids], "doc_id long").orderBy(F.xxhash64("doc_id", F.lit(17))).collect()
    order = [r["doc_id"] for r in place]
    sample_of = lambda docs, most: [(r["text"], r["y"]) for r in fit_sample(docs, labels, "toxic", 8_000, most).orderBy("turn", "doc_id").collect()]
    for size, fits in ((2_000, False), (900, True)):
        docs = spark.createDataFrame([(i, "z" * size if i == order[0] else f"text {i:04}") for i in ids], "doc_id long, text string")
        got = sample_of(docs, 1_000 + 9 * len(ids))
        short = [(f"text {i:04}", i % 2) for i in order[1:]]
        assert got == ([("z" * size, order[0] % 2)] if fits else []) + short
    docs = spark.createDataFrame([(i, "z" * 900 if i == order[0] else f"text {i:04}") for i in ids], "doc_id long, text string")
    assert [t for t, _ in sample_of(docs, 900)] == [f"text {i:04}" for i in order[1:]]


def accuracy(spark, name, label):
    scored = QUERIES[name](spark, SF_LARGE).join(table(spark, SF_LARGE, "labels"), "doc_id").where("held_out")
    rows = scored.select("score", "predicted", label).collect()
    y = np.array([r[label] for r in rows])
    said = np.array([r["predicted"] for r in rows])
    assert all(0 <= r["score"] <= 1 for r in rows)
    return (said == y).mean(), said[y == 1].mean(), 1 - said[y == 0].mean()


def test_toxicity_held_out_accuracy(spark):
    right, caught, left_alone = accuracy(spark, "op9_toxicity", "toxic")
    assert right > 0.97 and caught > 0.8 and left_alone > 0.98


def test_quality_held_out_accuracy(spark):
    right, good, bad = accuracy(spark, "op10_quality", "quality")
    assert right > 0.97 and good > 0.98 and bad > 0.9


def test_toxicity_points_to_the_offending_sentence():
    rng = np.random.default_rng(1)
    calm = [f"word{i}" for i in range(50)]
    sentence = lambda extra=(): " ".join([*rng.choice(calm, 8), *extra])
    sample = []
    for i in range(300):
        bad = i % 3 == 0
        parts = [sentence() for _ in range(rng.integers(2, 8))]
        if bad:
            parts[rng.integers(len(parts))] += f" vile{i % 7}thing"
        sample.append((". ".join(parts), int(bad)))
    model = toxicity.train(sample)
    text = "Über word1 word2 word3. word4 vile99thing word5! word6 word7"
    block = next(blocks(pa.array([text, "", "word1 word2"], pa.large_string())))
    scores, spans = toxicity.score_block(model, block, 0.5)
    assert scores[0] > 0.5 > scores[2] and scores[1] == 0
    assert [text[s["start"]:s["end"]] for s in spans[0]] == ["word4 vile99thing word5"] and spans[1] == spans[2] == []


def test_noisy_or_combines_sentences():
    p = np.array([0.5, 0.5, 0.2])
    assert np.allclose(toxicity.noisy_or(p, np.array([0, 0, 2]), 3), [0.75, 0, 0.2])


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality_classifier, "quality")])
def test_models_on_hostile_rows(spark, module, label):
    docs = hostile_docs(spark)               # its column named score is replaced
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (3, 0, 1), (7, None, None), (None, 1, 1), (8, 1, 0), (99, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    scored = module.score(docs, module.fit(docs, labels))
    rows = scored.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())
    none = module.fit(docs, labels.limit(0))
    assert module.score(empty_docs(spark), none).count() == 0
    assert module.score(docs, none).count() == docs.count()


def test_fit_sample_is_bounded_and_leaves_the_fold_out(spark):
    docs, labels = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels")
    assert fit_sample(docs, labels, "toxic", 20, 1 << 30).count() == 20
    small = fit_sample(docs, labels, "toxic", 1000, 50_000).collect()
    assert sum(len(r["text"].encode()) for r in small) <= 50_000 and small
    every = fit_sample(docs, labels, "toxic", 10_000, 1 << 30).collect()
    known = {r["doc_id"]: r["toxic"] for r in labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.where("text IS NOT NULL").collect()}
    assert {(r["doc_id"], r["y"], r["text"]) for r in every} == {(d, y, texts[d]) for d, y in known.items() if d in texts}


def test_fit_sample_moves_no_text_before_the_choice(spark):
    """The running size is taken over ids and sizes: no window in the plan has a text in it."""
    plan = fit_sample(table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels"), "toxic", 100, 9000)._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window"):]
    assert "octet_length(text" in window and "min(text" not in window


def test_a_model_is_fitted_in_a_task_as_on_the_driver(spark):
    docs, labels = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels")
    rows = sorted(fit_sample(docs, labels, "toxic", 8_000, 32 << 20).collect(), key=lambda r: (r["turn"], r["doc_id"]))
    there, here = toxicity.fit(docs, labels), toxicity.train([(r["text"], r["y"]) for r in rows])
    assert there.bias == here.bias and np.array_equal(there.weight, here.weight)


def test_character_windows_equal_plain_python():
    texts = ["Über den Wörtern", "", "日本 語テキスト", "a", "😀é x", "plain words here", "ñ"]
    for n in (2, 4):
        groups = {}
        for some in (texts, texts[5:6]):          # alike whether the block has longer characters or not
            block = next(blocks(pa.array(some, pa.large_string())))
            hashed, doc = char_ngrams(block, find_words(block).mask, n)
            expected = []
            for i, t in enumerate(some):
                for k in range(len(t) - n + 1):
                    w = t[k:k + n]
                    inner = [c != " " for c in w]
                    if all(inner[1:-1]) and (inner[0] or inner[-1]) and (n > 2 or all(inner)):
                        expected.append((i, w))
            assert doc.tolist() == [i for i, _ in expected]
            for h, (_, w) in zip(hashed.tolist(), expected):
                assert groups.setdefault(w, h) == h
        assert len(set(groups.values())) == len(groups)


def test_pipeline_stages_against_brute_force(spark):
    docs = table(spark, SF_SMALL, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "ngram join", "mixing", "packing"]
    calm = stages["toxicity"](spark, docs, SF_SMALL)
    scores = {r["doc_id"]: r["score"] for r in QUERIES["op9_toxicity"](spark, SF_SMALL).collect()}
    rows = {r["doc_id"]: r for r in calm.collect()}
    assert calm.columns == docs.columns and rows.keys() == {d for d, s in scores.items() if s < 0.5}
    single = stages["exact dedup"](spark, calm, SF_SMALL)
    best = {}
    for d, r in rows.items():
        best[r["text"]] = max(d, best.get(r["text"], d))
    kept = {r["doc_id"]: r for r in single.collect()}
    assert single.columns == docs.columns and kept.keys() == set(best.values())
    assert all(tuple(kept[d]) == tuple(rows[d]) for d in kept)
    unique = stages["ngram join"](spark, single, SF_SMALL)
    own = {r["doc_id"]: r for r in unique.collect()}
    expected = jaccard_components([(d, r["text"]) for d, r in kept.items()])
    assert unique.columns == docs.columns and own.keys() == {c for _, _, c in expected}
    mixed = stages["mixing"](spark, unique, SF_SMALL)
    copies = [tuple(r) for r in mixed.collect()]
    assert mixed.columns == docs.columns and set(copies) <= {tuple(r) for r in own.values()}
    total = sum(len(words(r["text"])) for r in own.values())
    assert abs(sum(len(words(c[1])) for c in copies) - 1.5 * total) < 0.02 * total
    packed = stages["packing"](spark, mixed, SF_SMALL)
    held = lambda t: max(len(words(t)), -(-len((t or "").encode()) // packing.TOKEN_BYTES))
    assert packed.agg(F.sum("length")).first()[0] == sum(held(c[1]) for c in copies)


def hostile_folder(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_runs_on_hostile_rows(spark, tmp_path):
    """Nulls, ties, repeated rows and clashing columns pass every stage; copies and near copies leave one row each."""
    docs = hostile_docs(spark)
    folder = hostile_folder(spark, str(tmp_path), docs)
    now = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, folder)
        if name != "packing":
            assert now.columns == docs.columns
            assert now.exceptAll(before).count() == 0 or name == "mixing"      # mixing may repeat rows, none is made up
        if name == "exact dedup":
            texts = [r["text"] or "" for r in now.collect()]
            assert len(texts) == len(set(texts)) == len({r["text"] or "" for r in before.collect()})
        if name == "ngram join":
            expected = {c for _, _, c in jaccard_components([(r["doc_id"], r["text"]) for r in before.collect()])}
            assert {r["doc_id"] for r in now.collect()} == expected
    assert now.count() > 0


def test_pipeline_runs_on_empty_tables(spark, tmp_path):
    folder = hostile_folder(spark, str(tmp_path), hostile_docs(spark).limit(0))
    assert corpus_pipeline.run(spark, folder).count() == 0
