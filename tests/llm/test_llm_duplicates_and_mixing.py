"""Exact dedup, n-gram join, mixing, packing, WARC."""
import hashlib
import io
import random

import duckdb
import numpy as np
import pytest
from llm_cases import empty_docs, hostile_docs, jaccard_components, ordered, prose, rows_of, words
from pyspark.sql import functions as F

from conftest import SF_SMALL
from knightshift.llm import exact_dedup, mixing, ngram_join, packing, token_counts, warc
from knightshift.llm.common import ship_package
from knightshift.llm.queries import ORACLES, QUERIES, tokenizer_file


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["op2_quality_rules", "op4_packing", "op6_exact_dedup", "op8_warc"])
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    cur = duck.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df, *columns) == ordered(cur.fetchall())


def expected_groups(rows):
    by_text = {}
    for d, t in rows:
        by_text.setdefault(t or "", []).append(d)
    out = []
    for d, t in rows:
        own = by_text[t or ""]
        known = [x for x in own if x is not None]
        out.append((d, max(known) if known else None, len(own), hashlib.sha256((t or "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("capacity", [exact_dedup.CAPACITY, 1])
def test_exact_dedup_edges(spark, capacity):
    docs = hostile_docs(spark)
    found = exact_dedup.assign(docs, capacity=capacity)
    own = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(found, "doc_id", "keep_id", "group_size", "text_sha256") == ordered(expected_groups(own))
    kept = found.where("kept").collect()
    assert sorted(r["text_sha256"] for r in kept) == sorted({hashlib.sha256((t or "").encode()).hexdigest() for _, t in own})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)
    rows = exact_dedup.kept_rows(docs, capacity=capacity)
    assert rows.columns == docs.columns
    assert rows_of(rows, "doc_id") == ordered([(r["doc_id"],) for r in kept])
    assert rows_of(rows.where("text is not null"), *docs.columns) == rows_of(docs.where("text is not null").join(
        rows.select("doc_id", F.sha2("text", 256).alias("__s")).distinct(), ["doc_id"], "left_semi").distinct().where(
        "doc_id is not null"), *docs.columns)
    assert exact_dedup.assign(empty_docs(spark)).count() == 0 and exact_dedup.kept_rows(empty_docs(spark)).count() == 0


def test_directory_doubles_and_keeps_key_ranges():
    rng = np.random.default_rng(2)
    loads = rng.integers(0, 20, 1 << 16)
    loads[40_000] = 10_000_000                                   # one key that no split can part
    directory = exact_dedup.Directory(loads, 50_000)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, 5_000)
    at = directory.bucket(keys)
    top = keys.view(np.uint64) >> np.uint64(64 - 16)
    order = np.argsort(top)
    assert (np.diff(np.searchsorted(np.unique(at), at[order])) != 0).sum() == len(np.unique(at)) - 1   # ranges are whole
    held = np.bincount(directory.bucket((np.arange(1 << 16).astype(np.uint64) << np.uint64(48)).view(np.int64)),
                       weights=loads, minlength=directory.n_buckets)
    assert (held > 50_000).sum() == 1 and directory.depth == 16
    assert exact_dedup.Directory(np.zeros(1 << 16), 1).n_buckets == 1


def test_chain_compares_bytes(spark):
    """Two texts under one key stay apart."""
    rows = [(0, 77, "s1", 2, 2, "one", 0), (0, 77, "s2", 1, 3, "two", 1), (0, 77, "s1", 1, 9, "one", 2), (0, 77, "s3", 4, None, "", 3)]
    index = spark.createDataFrame(rows, "__bucket int, __key long, __sha string, __n long, __top long, __text string, __entry long")
    got = rows_of(exact_dedup.groups(index), "__gkey", "__gsha", "__keep", "__size")
    assert got == [(77, "s1", 9, 3), (77, "s2", 3, 1), (77, "s3", None, 4)]


def test_every_file_of_the_index_gets_its_buckets(spark):
    for buckets, files in ((1, 1), (40, 40), (50, 7)):
        numbers = exact_dedup.bucket_numbers(spark, buckets, files)
        assert len(set(numbers.tolist())) == buckets
        dealt = spark.createDataFrame([(int(n),) for n in numbers], "n int").select(F.pmod(F.hash("n"), F.lit(files)).alias("f")).collect()
        assert [r["f"] for r in dealt] == [b % files for b in range(buckets)]


def test_a_text_that_most_rows_share_gathers_no_ids(spark):
    """A hot group's rows meet its size and largest id by a join; alike when the groups are too many to broadcast."""
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(900)] + [(890, "the same text"), (None, "the same text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    small, large = (rows_of(exact_dedup.assign(docs, max_bytes=bound), "doc_id", "keep_id", "group_size", "text_sha256") for bound in (1 << 20, 0))
    assert small == large == ordered(expected_groups(rows))
    assert exact_dedup.assign(docs).where("kept").count() == 301
    assert "__ids" not in exact_dedup.ENTRY.names


def near_copies(rng, n_groups=12, size=9):
    rows = []
    for g in range(n_groups):
        base = prose(rng, rng.choice([4, 5, 6, 12, 60, 200])).split()
        for _ in range(rng.randint(1, size)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = f"new{rng.randint(0, 10**6)}"
            if rng.random() < 0.2:
                own = own[:max(1, int(len(own) * rng.uniform(0.7, 1)))]
            rows.append((len(rows) * 7 % 1009, " ".join(own).upper() if rng.random() < 0.1 else " ".join(own)))
    passage = prose(rng, 60)
    rows += [(2000 + i, f"{prose(rng, 10)} {passage} {prose(rng, rng.randint(1, 30))}") for i in range(30)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_equals_all_pairs(spark, seed):
    rows = near_copies(random.Random(seed))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = rows_of(ngram_join.components(docs), "doc_id", "n_shingles", "component_id")
    expected = jaccard_components(rows)
    assert got == ordered(expected)
    kept = {r["doc_id"] for r in ngram_join.one_of_each(docs).collect()}
    assert kept == {c for _, _, c in expected} and len({c for _, _, c in expected}) < len(rows)


def test_ngram_join_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(QUERIES["op3_ngram_jaccard"](spark, SF_SMALL), "doc_id", "n_shingles", "component_id")
    assert got == ordered(jaccard_components(rows))


def test_ngram_join_edges(spark):
    docs = hostile_docs(spark)
    own = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(ngram_join.components(docs), "doc_id", "n_shingles", "component_id") == ordered(jaccard_components(own))
    assert ngram_join.one_of_each(docs).columns == docs.columns
    assert ngram_join.components(empty_docs(spark)).count() == 0


def test_components_close_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (300, 200)]
    random.Random(4).shuffle(edges)
    got = {r["cls"]: r["root"] for r in ngram_join.close(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 102: 100, 300: 200}
    assert ngram_join.close(spark.createDataFrame([], "a long, b long")).count() == 0


def test_filters_never_drop_a_pair_at_the_threshold(spark):
    rows = [(n, m) for n in range(1, 60) for m in range(1, 60)]
    df = spark.createDataFrame(rows, "n long, m long").select("n", "m", ngram_join.overlap_needed(F.col("n"), F.col("m"), 75).alias("k"))
    for n, m, k in df.collect():
        assert k == min(i for i in range(0, n + m + 1) if 100 * i >= 75 * (n + m - i))


def filled_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, 10.0 * sum(sizes.values()) + 1
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(2 * sizes[s], mid * w[s]) for s in sizes) < 1.5 * sum(sizes.values()):
            low = mid
        else:
            high = mid
    return {s: min(2 * sizes[s], high * w[s]) for s in sizes}


def check_mix(docs, found):
    own = [(r["doc_id"], r["source"], len(words(r["text"]))) for r in docs.select("doc_id", "source", "text").collect()]
    sizes = {}
    for _, s, n in own:
        sizes[s] = sizes.get(s, 0) + n
    goal = filled_targets(sizes)
    rows = found.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in rows) == sorted((d is None, d or 0, n) for d, _, n in own)
    by_id = {(d, n): s for d, s, n in own}
    taken = {s: 0 for s in sizes}
    for r in rows:
        s = by_id[r["doc_id"], r["size"]]
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - goal[s]) <= 1e-6 * max(1, goal[s])
        assert 0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    return taken, goal


def test_mixing_documents_meets_targets_and_repeats(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    taken, goal = check_mix(docs, QUERIES["op5_mixing"](spark, SF_SMALL))
    smallest = {}
    for r in docs.select("source", "text").collect():
        smallest[r["source"]] = min(smallest.get(r["source"], 10**9), len(words(r["text"])))
    assert all(abs(taken[s] - goal[s]) <= max(smallest[s], 0.01 * goal[s]) for s in goal)
    again = mixing.mix(docs.repartition(7))
    assert rows_of(again, "doc_id", "taken") == rows_of(QUERIES["op5_mixing"](spark, SF_SMALL), "doc_id", "taken")
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    want = {r["doc_id"]: r["taken"] // r["size"] for r in again.collect() if r["taken"]}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want


def test_mixing_edges(spark):
    docs = hostile_docs(spark)
    check_mix(docs, mixing.mix(docs))
    assert mixing.mixed_rows(docs).columns == docs.columns
    assert mixing.mix(empty_docs(spark)).count() == 0 and mixing.mixed_rows(empty_docs(spark)).count() == 0


def test_mixing_splits_a_hot_length(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 7)
    docs = spark.createDataFrame([(i, "one two three", "a" if i < 90 else "b") for i in range(120)], "doc_id long, text string, source string")
    taken, goal = check_mix(docs, mixing.mix(docs))
    assert all(abs(taken[s] - goal[s]) <= 3 for s in goal)


def test_fit_reaches_budgets():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 60, 8))
        counts = rng.integers(0, 5, len(lengths))
        sums = {0}
        for x, c in zip(lengths, counts):
            sums = {s + k * int(x) for s in sums for k in range(c + 1)}
        for budget in rng.integers(0, (lengths * counts).sum() + 2, 6):
            take = mixing.knapsack(lengths, counts, int(budget))
            assert (take <= counts).all() and (lengths * take).sum() == max(s for s in sums if s <= budget)
            near = mixing.fit(lengths, counts, int(budget))
            assert (near <= counts).all() and (near >= 0).all() and (lengths * near).sum() <= budget


@pytest.mark.parametrize("scale", [1, 100, 10_000])
def test_fit_reaches_budgets_beside_dominating_documents(scale):
    short = np.arange(100, 800, 100)
    cases = [((280_000,), 630_000), ((280_000,), 300_000), ((100_000, 60_000, 50_000), 615_000)]
    for long, budget in cases:       # the short texts hold 420,000 words
        lengths = np.array([*(short * scale), *sorted(x * scale for x in long)])
        counts = np.array([150] * len(short) + [1] * len(long))
        take = mixing.fit(lengths, counts, budget * scale)
        assert (take >= 0).all() and (take <= counts).all()
        assert (lengths * take).sum() == budget * scale
    # no short texts: 10 + 3 of 10, 6, 5 and 3 is the one exact fit
    lengths, counts = np.array([3, 5, 6, 10]) * 50_000 * scale, np.ones(4, dtype=np.int64)
    assert mixing.fit(lengths, counts, 13 * 50_000 * scale).tolist() == [1, 0, 0, 1]


def test_fit_is_the_nearest_sum_of_small_tables():
    rng = np.random.default_rng(7)
    for _ in range(60):
        lengths = np.unique(np.append(rng.integers(1, 60, 6), rng.integers(200, 900, 2)))
        counts = rng.integers(0, 4, len(lengths))
        sums = {0}
        for x, c in zip(lengths, counts):
            sums = {s + k * int(x) for s in sums for k in range(c + 1)}
        for budget in rng.integers(0, (lengths * counts).sum() + 2, 6):
            assert (lengths * mixing.fit(lengths, counts, int(budget))).sum() == max(s for s in sums if s <= budget)


def test_mixing_takes_a_dominating_document(spark):
    rows = [(0, "long " * 2800, "a")] + [(i, "word " * 7, "a") for i in range(1, 601)] + [(1000, "other " * 5413, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, goal = check_mix(docs, mixing.mix(docs))
    assert abs(taken["a"] - goal["a"]) <= 7


def all_boundaries(histogram, buckets):
    from itertools import combinations
    lengths = sorted(histogram)
    k = min(buckets, len(lengths))
    cost = lambda cut: sum(c * (min(z for z in cut if z >= x) - x) for x, c in histogram.items())
    return min(cost([*cut, lengths[-1]]) for cut in combinations(lengths[:-1], k - 1))


def test_boundaries_are_optimal():
    rng = random.Random(6)
    for _ in range(40):
        histogram = {rng.randint(0, 40): rng.randint(1, 9) for _ in range(rng.randint(1, 9))}
        buckets = rng.randint(1, 5)
        cut = packing.boundaries(histogram, buckets)
        assert len(cut) == min(buckets, len(histogram))
        assert sum(c * (min(z for z in cut if z >= x) - x) for x, c in histogram.items()) == all_boundaries(histogram, buckets)
    assert packing.boundaries({}, 3) == []


def held_tokens(text):
    return max(len(words(text)), -(-len((text or "").encode()) // packing.TOKEN_BYTES))


@pytest.mark.parametrize("chunk", [packing.CHUNK, 5])
def test_packing_keeps_every_token(spark, chunk):
    docs = hostile_docs(spark)
    rows = packing.pack(docs, max_len=50, budget=120, buckets=3, chunk_rows=chunk).collect()
    n = {}
    for r in rows:
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + r["length"]
        assert r["length"] <= 50 and r["padding"] == r["bucket_len"] - r["length"] >= 0
    own = {}
    for r in docs.select("doc_id", "text").collect():
        own[r["doc_id"]] = own.get(r["doc_id"], 0) + held_tokens(r["text"])
    assert n == own
    batches = {}
    for r in rows:
        batches.setdefault((r["bucket_len"], r["chunk"], r["batch"]), []).append(r["slot"])
    for (width, _, _), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= max(1, 120 // max(1, width))
    assert len([r for r in rows if r["doc_id"] == 11]) == 100            # 20,000 letters without a blank are cut
    assert packing.pack(empty_docs(spark)).count() == 0


def test_batches_hold_a_budget_of_counted_tokens(spark):
    """Exact token counts given as the length."""
    pytest.importorskip("tokenizers")
    counted = token_counts.count_tokens(hostile_docs(spark), tokenizer_file(), into="n_tokens")
    own = {r["doc_id"]: r["n_tokens"] for r in counted.where("doc_id > 6").collect()}
    rows = packing.pack(counted.where("doc_id > 6"), length=F.col("n_tokens"), max_len=400, budget=1000, buckets=4).collect()
    total, batches = {}, {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
        key = (r["bucket_len"], r["chunk"], r["batch"])
        batches[key] = batches.get(key, 0) + r["bucket_len"]
    assert total == own and all(v <= 1000 for v in batches.values()) and own[11] > 1


PAGES = "page_id long, url string, html string, score string, id string, chunk int"


def test_warc_round_trip_edges(spark):
    big = "é" * 200_000
    rows = [(1, "http://a/\r\nx", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
            (7, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" + "y" * 200 + "\r\n\r\n"), (8, "u", "z" * 99), (9, "u", "z" * 99),
            (10, "u", "z" * 100), (-3, "u", "z" * 100), (12, "u", "q" * 300), (12, "v", "q" * 300), (None, None, None), (None, "n", "w" * 150)]
    pages = spark.createDataFrame([(*r, "clash", "clash", 0) for r in rows], PAGES)
    got = rows_of(warc.round_trip(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    first, seen, expected = {}, set(), []
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        again = html in first and (i != first[html] or (i, html) in seen)
        seen.add((i, html))
        body = (html or "").encode()
        expected.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    assert got == ordered(expected)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_chunks_carry_digests():
    row = {"id": 5, "url": "http://x", "payload_bytes": 10, "payload_digest": "d", "record_type": "response", "refers_to": None}
    data = warc._head(row) + b"0123456789\r\n\r\n"
    rows = list(warc.stream_records(warc._Lines(io.BytesIO(data * 2), 7), size=4))
    assert [(r[0], r[5], r[6], r[8], r[9]) for r in rows[:3]] == [(5, 0, 4, False, b"0123"), (5, 1, 8, False, b"4567"), (5, 2, 10, True, b"89")]
    assert rows[2][7] == hashlib.sha256(b"0123456789").hexdigest() and rows[1][7] == hashlib.sha256(b"01234567").hexdigest()
    assert len(rows) == 6
    with pytest.raises(ValueError):
        list(warc.stream_records(warc._Lines(io.BytesIO(data[:-8]), 7), size=4))


def test_few_partners_of_a_list_are_bounded_and_links_among_all_of_them(spark):
    rows = [(7, c, 100, 0, 600, c) for c in range(600)]                  # one list of 600 classes, all of one parity sketch
    posted = spark.createDataFrame(rows, "token long, cls long, n int, pos int, k long, root long")
    signatures = posted.selectExpr("cls", "array_repeat(0L, 8) AS sig")
    few = ngram_join.remaining_pairs(posted, signatures, 75, 4)
    every = ngram_join.remaining_pairs(posted, signatures, 75)
    assert every.count() == 600 * 599 // 2 and 600 <= few.count() <= 600 * 20
    assert few.where("a >= b").count() == 0 and few.distinct().count() == few.count()
    assert few.join(every, ["a", "b", "n", "m"], "left_anti").count() == 0


def test_crowd_is_the_list_of_an_average_posting(spark):
    rows = [(7, c, 9, 0, 30, c) for c in range(30)] + [(8, c, 9, 0, 10, c) for c in range(10)] + [(9, c, 9, 0, 50, 1) for c in range(50)]
    posted = spark.createDataFrame(rows, "token long, cls long, n int, pos int, k long, root long")
    assert ngram_join.crowd(posted) == 25 and ngram_join.crowd(posted.where("token = 9")) == 0
