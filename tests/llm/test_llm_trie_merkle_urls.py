"""Prefix trie, Merkle manifest and URL filter."""
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from urllib.parse import quote

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from llm_cases import empty_docs, hostile_docs, ordered, rows_of, words
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from knightshift.llm import merkle, prefix_trie, url_filter
from knightshift.llm.common import join_groups, ship_package
from knightshift.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def same_as_sql(spark, name, table, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cur = con.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df, *columns) == ordered(cur.fetchall())


# ------------------------------------------------------------------- merkle

def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(hashes):
    """Top of a list of hashes, and each one's (left, right) siblings level by level."""
    paths, spot, now = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(now) > 1:
        for i, p in enumerate(spot):
            run = p - p % 8
            paths[i].append(("".join(now[run:p]), "".join(now[p + 1:run + 8])))
            spot[i] = p // 8
        now = [sha("".join(now[k:k + 8])) for k in range(0, len(now), 8)]
    return (now[0] if now else None), paths


def merkle_by_hand(rows):
    lower = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m.group(0).lower(), t)
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        tampered = lower(text) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else text
        leaf, changed = (sha("".join(map(framed, (doc_id, source, lang, n_chars, t)))) for t in (text, tampered))
        groups[lang].append((doc_id, leaf, changed))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    tops = {g: climb([r[1] for r in groups[g]]) for g in langs}
    root, upper = climb([tops[g][0] for g in langs])
    out = []
    for g, above in zip(langs, upper):
        for (doc_id, leaf, changed), path in zip(groups[g], tops[g][1]):
            whole, folded = path + above, changed
            for left, right in whole:
                folded = sha(left + folded + right)
            out.append((doc_id, leaf, tops[g][0], root, sha("".join(a + b for a, b in whole)), folded, folded == root))
    return ordered(out)


MERKLE = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def audited(docs):
    small = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.small_letters(F.col("text"))).otherwise(F.col("text"))
    return rows_of(merkle.audit(docs, small), *MERKLE)


def test_merkle_equals_sql(spark):
    same_as_sql(spark, "op12_merkle", "documents", SF_SMALL)


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_merkle_equals_brute_force_at_any_block_border(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rng = random.Random(block)
    sizes = {"en": 600, "de": 65, "fr": 9, "es": 8, "one": 1, None: 64, "Z": 2, "é": 3, "": 1}
    rows = [(rng.randint(-50, 10 ** 6), f"Text {rng.random()} É", g, rng.choice(["a", None]), rng.choice([None, 3])) for g, n in sizes.items() for _ in range(n)]
    rng.shuffle(rows)
    got = audited(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert got == merkle_by_hand(rows)
    assert {r[6] for r in got} == {True, False}


def test_merkle_edge_rows(spark):
    docs = hostile_docs(spark)
    assert audited(docs) == merkle_by_hand([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    assert audited(empty_docs(spark)) == []


def test_merkle_numbers_a_hot_group_in_slices(spark, monkeypatch):
    import knightshift.operators.ordered as O
    monkeypatch.setattr(O, "ROWS_PER_CHUNK", 50)
    rows = [(i * 7919 % 4001, f"T{i}", "en" if i % 5 else "de", "s", i) for i in range(500)]
    assert audited(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")) == merkle_by_hand(rows)


def test_merkle_nodes_hold_every_level(spark):
    docs = spark.createDataFrame([(i, "en", sha(str(i))) for i in range(100)], "n long, grp string, h string")
    tree = merkle.build(docs, ["n"])
    count = {(r["tree"], r["level"]): r["count"] for r in merkle.nodes(tree).groupBy("tree", "level").count().collect()}
    assert count == {("group", 0): 100, ("group", 1): 13, ("group", 2): 2, ("whole", 0): 1}


# --------------------------------------------------------------------- trie

def trie_by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            framed_turn = f"{len((role or '').encode())}:{role or ''}{text or ''}"
            own[conv].append(((turn is not None, turn or 0, hashlib.md5(framed_turn.encode()).hexdigest()), (role or "", text or "")))
    turns = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - int(math.fmod(c, 20))
        built[c] = turns.get(donor, [])[:h] + turns[c][h:]
    members, enders = defaultdict(list), defaultdict(list)
    for c, seq in built.items():
        enders[tuple(seq)].append(c)
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        value = (len(who) - 1) * (len(words(node[-1][1])) if node else 0)
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += value
    return ordered([(min(who), len(node), min(members[node[:-1]]) if node else None, len(who), children[node], leaves[node], saved[node],
                     sha(",".join(map(str, sorted(enders[node]))))) for node, who in members.items()])


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TURNS = "conv_id long, turn long, role string, text string"


def test_trie_equals_sql(spark):
    same_as_sql(spark, "op11_prefix_trie", "conversations", SF_SMALL)


@pytest.mark.parametrize("seed,shard_rows", [(1, 1), (2, 3), (3, 100_000)])
def test_trie_equals_brute_force_in_any_shards(spark, monkeypatch, seed, shard_rows):
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "IDS", 2)
    rng = random.Random(seed)
    rows = []
    for c in range(70):
        conv = rng.choice([c, -c, c * 20])
        said = ["a b", "a b", "a  b c", "É", ""][: rng.randint(1, 5)]
        rows += [(conv, t, rng.choice(["user", "user", "system"]), rng.choice(said)) for t in range(rng.choice([1, 1, 2, 3, 5, 12]))]
    same = [(t, "user", f"copied {t // 2}") for t in range(9)]
    rows += [(1000 + k, *t) for k in range(12) for t in same[:9 - k % 2]]      # copies, and a prefix of them
    rng.shuffle(rows)
    assert rows_of(prefix_trie.trie(spark.createDataFrame(rows, TURNS)), *TRIE) == trie_by_hand(rows)


def test_trie_edge_rows(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, 1, "a", "x" * 50_000), (None, 1, "user", "lost"),
            (40, 0, "user", "one two"), (41, 0, "user", "one two"), (42, 0, "x", "y"), (43, 5, "user", "one two"), (43, 5, "user", "one"), (-7, -3, "", "\t\n"),
            *[(60, t, "user", f"turn {t}") for t in range(600)], *[(3, t, "user", f"turn {t}") for t in range(500)]]
    turns = spark.createDataFrame(rows, TURNS)
    for name in ("depth", "a", "b", "rep", "place", "words", "g"):
        turns = turns.withColumn(name, F.lit("clash"))
    assert rows_of(prefix_trie.trie(turns), *TRIE) == trie_by_hand(rows)
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0


def test_parentheses_close_where_a_stack_says():
    rng = random.Random(5)
    for n in (1, 2, 70, 5000):
        depth = [0]
        while len(depth) < n:
            depth.append(rng.randint(1, min(depth[-1] + 1, 40)) if rng.random() < 0.6 else depth[-1] + 1)
        tree = prefix_trie.Parens(np.array(depth))
        close = tree.findclose()
        end = [next((j for j in range(i + 1, n) if depth[j] <= depth[i]), n) for i in range(n)]
        assert tree.ends(close).tolist() == end
        leaf = [i + 1 == n or depth[i + 1] <= depth[i] for i in range(n)]
        value = np.array([rng.randint(0, 99) for _ in range(n)])
        some = range(0, n, max(1, n // 200))
        leaves, least = tree.leaves(close), prefix_trie.subtree_minima(value, np.array(end))
        assert [int(leaves[i]) for i in some] == [sum(leaf[i:end[i]]) for i in some]
        assert [int(least[i]) for i in some] == [int(value[i:end[i]].min()) for i in some]
        up = tree.parents()
        assert all(up[i] == max((j for j in range(i) if depth[j] == depth[i] - 1), default=-1) for i in range(0, n, max(1, n // 200)))


# --------------------------------------------------------------- URL filter

def judged_by_hand(url):
    """host, path and rule."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m.group(0).lower(), host)
    fit = [h + p for _, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit, key=len, default=None)


ODD_URLS = [None, "", "no scheme", "http://", "http://a.Net/x", "https://NET/", "http://example.net/en/1?x://y", "http://xexample.net/en/", "http://a.example.net/EN/",
            "http://a.example.com/de/#q", "http://a.example.com/de", "http://é.org/fr/ü?a=1&b=2", "://org/fr/", "http://net", "http://net?/", "http://u@b.net:80/", "a://b://c.net/",
            "http://line\nbreak.net/p\nq?z", "http://a.org/fr/" + "9" * 50_000, "http://İ.net/"]


def test_url_rules_equal_brute_force(spark):
    rows = [(i, u, "clash", "clash") for i, u in enumerate(ODD_URLS * 2)] + [(None, "http://x.net/", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, score string")
    got = rows_of(url_filter.judge(pages), "page_id", "host", "path", "rule")
    assert got == ordered([(i, *judged_by_hand(u)) for i, u, _, _ in rows])
    by_rule = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    for r in url_filter.judge(pages).collect():
        assert r["verdict"] == by_rule.get(r["rule"], "block" if r["score"] > 0.5 else "allow")
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_query_judges_every_page(spark):
    pages = spark.read.parquet(f"{SF_MID}/pages.parquet").select("page_id", "url").collect()
    got = QUERIES["op13_url_filter"](spark, SF_MID)
    assert rows_of(got, "page_id", "host", "path", "rule") == ordered([(p["page_id"], *judged_by_hand(p["url"])) for p in pages])
    again = QUERIES["op13_url_filter"](spark, SF_MID)
    assert rows_of(got, "page_id", "verdict", "score") == rows_of(again, "page_id", "verdict", "score")


def test_url_without_labels_is_allowed(spark):
    pages = spark.createDataFrame([(1, "http://a.xy/"), (2, "http://b.xy/c?d")], "page_id long, url string")
    assert {(r["score"], r["verdict"]) for r in url_filter.judge(pages).collect()} == {(0.5, "allow")}


def test_url_trees_learn_a_lexical_rule_on_held_out_urls(spark):
    rng = random.Random(8)
    rows = []
    for i in range(4000):
        bad = rng.random() < 0.4
        host = "-".join(rng.choice(["cheap", "win", "pills", "track"]) for _ in range(2)) if bad else rng.choice(["news", "river", "stone", "blog"]) + str(rng.randint(1, 3))
        path = "/".join(str(rng.randint(10 ** 6, 10 ** 9)) if bad else rng.choice(["about", "story", quote("été")]) for _ in range(rng.randint(1, 4)))
        query = "?" + "&".join(f"k{j}={rng.randint(0, 9)}" for j in range(rng.randint(1, 6))) if bad or rng.random() < 0.3 else ""
        rows.append((i, f"http://{host}.xy{rng.randint(0, 30)}.info/{path}{query}", int(bad), None if i % 4 == 0 else int(bad)))
    pages = spark.createDataFrame(rows, "page_id long, url string, truth int, label int")
    got = url_filter.judge(pages, labels=F.col("label"), max_urls=1000)
    held = [(r["truth"], r["verdict"]) for r in got.where("label IS NULL").collect()]
    assert len(held) == 1000 and sum((v == "block") == (t == 1) for t, v in held) >= 970


def test_url_features_and_scores_equal_plain_python():
    urls = [u or "" for u in ODD_URLS]
    parts = [judged_by_hand(u)[:2] for u in urls]
    query = [re.search(r"(?s)^[^?#]*\?([^#]*)", u).group(1) if re.search(r"(?s)^[^?#]*\?([^#]*)", u) else "" for u in urls]
    column = lambda v: pa.array(v, pa.string())
    x = url_filter.features(column(urls), column([h for h, _ in parts]), column([p for _, p in parts]), column(query),
                            pa.array([3] * len(urls)), pa.array([2] * len(urls)), pa.array([0.5] * len(urls)))

    def entropy(text):
        raw = text.encode()
        return -sum(raw.count(b) / len(raw) * math.log2(raw.count(b) / len(raw)) for b in set(raw)) if raw else 0.0

    share = lambda t: sum(c in "0123456789" for c in t) / max(1, len(t.encode()))
    for row, u, (h, p), q in zip(x, urls, parts, query):
        want = [len(u.encode()), len(h.encode()), len(p.encode()), p.count("/"), h.count(".") + 1 if h else 0, share(u), share(h), h.count("-"),
                entropy(u), entropy(h), q.count("&") + 1 if q else 0, math.log(4), math.log(3), 0.5]
        assert np.allclose(row, want)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(400, 5)), rng.random(400)
    model = url_filter.train(x, (y < 1 / (1 + np.exp(-3 * x[:, 0]))).astype(float), rounds=12, depth=3)

    def walk(tree, row):
        at = 0
        while at < len(tree.feature):
            at = 2 * at + 1 + (row[tree.feature[at]] > tree.limit[at])
        return tree.value[at - len(tree.feature)]

    z = [model.bias + sum(walk(t, row) for t in model.trees) for row in x]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.array(z))))


def test_groups_join_alike_below_and_above_the_broadcast_bound(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"g{i}", i) for i in range(900)] + [(None, 5)], "k string, v int")
    groups = rows.where("k IS NOT NULL").groupBy("k").count().select(F.col("k").alias("g"), "count")
    same = F.col("k") == F.col("g")
    small, large = (rows_of(join_groups(rows, groups, same, "g", "count", 901, bound), "k", "v", "count") for bound in (1 << 20, 0))
    assert small == large and len(small) == 900
