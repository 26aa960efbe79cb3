"""Token counts, quality rules and personal data."""
import hashlib
import random
import re

import duckdb
import pytest
from llm_cases import empty_docs, hostile_docs, ordered, rows_of
from pyspark.sql import functions as F

from conftest import SF_SMALL
from knightshift.llm import pii, quality_rules, token_counts
from knightshift.llm.common import ship_package
from knightshift.llm.queries import ORACLES, QUERIES, tokenizer_file


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(tokenizer_file())


def library_counts(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts_match_the_library_on_documents(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op1_token_counts"](spark, SF_SMALL).collect()}
    assert got.keys() == docs.keys()
    expected = dict(zip(docs, library_counts(library, docs.values())))
    for d, text in docs.items():
        assert (got[d]["n_tokens"], got[d]["n_bytes"]) == (expected[d], len(text.encode()))
        assert got[d]["over_limit"] == (expected[d] > 1024)


def test_token_counts_match_the_library_on_odd_strings(library):
    counter = token_counts.Counter(token_counts.prove(tokenizer_file()))
    rng = random.Random(1)
    alphabet = "ab c'sdLl\n\t  1,é中\x85\xa0 😀́#"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [t + "<|endoftext|>" + t for t in texts[:300]] + ["<|endoftext|>" * 3, "a" * 5000, "é" * 999, " " * 50, "x \n y  z", "don't I'll WE'RE"]
    assert [counter.count(t) for t in texts] == library_counts(library, texts)


def test_proved_strings_are_single_tokens(library):
    proof = token_counts.prove(tokenizer_file())
    some = sorted(proof.whole)[::50]
    assert len(proof.whole) > 40_000
    assert library_counts(library, some) == [1] * len(some)


def test_token_counts_edge_rows(spark, library):
    docs = hostile_docs(spark)
    got = rows_of(token_counts.count_tokens(docs, tokenizer_file(), into="n_tokens"), "doc_id", "n_tokens", "score")
    own = docs.select("doc_id", "text").collect()
    assert got == ordered([(r["doc_id"], n, "clash") for r, n in zip(own, library_counts(library, [r["text"] for r in own]))])
    assert token_counts.count_tokens(empty_docs(spark), tokenizer_file()).count() == 0


def duck(tmp_path, df, name="documents"):
    path = str(tmp_path / name)
    df.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return con


def same_as_sql(spark, con, name, df):
    cur = con.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df, *columns) == ordered(cur.fetchall())


@pytest.mark.parametrize("many", [False, True])
def test_quality_rules_equal_sql(spark, tmp_path, many):
    docs = hostile_docs(spark) if not many else spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    if many:   # a line that every document of two hosts shares, and near-empty documents around it
        line = "a shared footer that every page of this host repeats again"
        docs = docs.withColumn("text", F.concat_ws("\n", F.substring("text", 1, 150), F.lit(line)))
        docs = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(line + "\nq"), F.col("doc_id"))).otherwise(F.col("text")))
        docs = docs.withColumn("source", F.when(F.col("doc_id") % 2 == 0, "a").otherwise(F.lit(None)))
    df = quality_rules.judge(docs)
    if many:
        found = df.agg(F.sum((F.col("removed_words") > 0).cast("int")), F.sum((~F.col("kept") & ~F.col("base_failed")).cast("int"))).first()
        assert found[0] > 100 and found[1] > 20
    same_as_sql(spark, duck(tmp_path, docs), "op2_quality_rules", df)


RULE_DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def pages_of(host, n, start=0, footer="a footer line that is the same on every page", times=40):
    """``n`` pages of a host of five lines of their own, the first ``times`` with a footer."""
    own = lambda i: "\n".join(" ".join(f"w{i}k{k}n{j}" for j in range(9)) for k in range(5))
    return [(start + i, own(start + i) + ("\n" + footer if i < times else ""), "en", host, 1) for i in range(n)]


def test_a_footer_goes_from_a_host_of_any_size(spark):
    rows = [r for j, (host, n) in enumerate((("a", 60), ("b", 600), (None, 3000))) for r in pages_of(host, n, j * 10_000)]
    got = quality_rules.judge(spark.createDataFrame(rows, RULE_DOCS))
    found = {r["host"]: (r["hit"], r["kept"]) for r in got.groupBy(F.floor(F.col("doc_id") / 10_000).alias("host")).agg(
        F.sum((F.col("removed_words") == 10).cast("int")).alias("hit"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()}
    assert found == {0: (40, 60), 1: (40, 600), 2: (40, 3000)}
    rare = quality_rules.judge(spark.createDataFrame(pages_of("a", 60, times=10), RULE_DOCS))     # ten documents are not more than ten
    assert rare.where("removed_words > 0").count() == 0
    shared = quality_rules.judge(spark.createDataFrame(rows, RULE_DOCS), max_share_percent=5)      # a share is another limit if asked for
    assert shared.where("removed_words > 0").count() == 80


def test_a_page_copied_many_times_is_rejected_with_its_copies(spark):
    copies = [(i, "the same long copied text stands here in one line of words\nand one more line of eleven others as much alike in all", "en", "a", 1) for i in range(500)]
    docs = spark.createDataFrame(copies + pages_of("a", 20, 1000, times=0), RULE_DOCS)
    got = quality_rules.judge(docs)
    assert got.where("kept").count() == 20 and got.where("removed_words = n_words").count() == 500
    assert quality_rules.judge(docs, fold_equal=True).where("kept").count() == 520               # equal texts as one document
    assert quality_rules.judge(empty_docs(spark)).count() == 0


def test_lines_join_alike_below_and_above_the_broadcast_bound(spark):
    docs = spark.createDataFrame(pages_of("a", 200) + pages_of(None, 300, 1000, "another footer", 300), RULE_DOCS)
    small, large = (rows_of(quality_rules.judge(docs, max_bytes=bound), "doc_id", "kept", "removed_words") for bound in (1 << 20, 0))
    assert small == large and sum(r[2] for r in small) == 40 * 10 + 300 * 2


def test_quality_rules_use_no_python(spark):
    plan = quality_rules.judge(hostile_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for kind, pattern, low, high in (("card", CARD, 13, 19), ("phone", PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if low <= len(digits) <= high and (kind == "phone" or luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return out


def odd_personal(rng):
    parts = ["a@b.co", "x.y+z@mail.example.org", "a@b..c", "@", "a@b.c_d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "010.000.0.255",
             "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "123456789012345678901234567890", "+49 (30) 123-4567",
             "+1 2", "+1", "00 49 30 1234567", "(555) 123-4567", "555-123-4567", "me [at] site [dot] org", " ", "  ", "-", ".", "é😀", "tel ", "\n", "+"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))


def test_pii_base_spans_equal_plain_patterns(spark):
    rng = random.Random(8)
    texts = [odd_personal(rng) for _ in range(800)] + [None, "", "7" * 60_000, "1 " * 30_000, "a." * 30_000 + "@" + "b." * 3_000 + "c", "a" * 60_000 + "@"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.summary(docs).collect()}
    assert len(got) == len(texts)
    extra = 0
    for i, t in enumerate(texts):
        base = base_spans(t)
        joined = ",".join(f"{k}:{a}:{z}" for k, a, z in base)
        r = got[i]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS], t
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        spans = [s for s in r["spans"].split(",") if s]
        assert set(joined.split(",") if joined else []) <= set(spans)
        order = [(pii.KINDS.index(k), int(a), int(z)) for k, a, z in (s.split(":") for s in spans)]
        assert order == sorted(order)
        extra += len(spans) - len(base)
    assert extra > 0    # the method finds more than the base rules


def test_pii_documents_edges_and_plan(spark):
    docs = hostile_docs(spark)
    got = rows_of(pii.summary(docs), "doc_id", "n_email", "n_ip", "n_card", "n_phone")
    own = docs.select("doc_id", "text").collect()
    assert got == ordered([(r["doc_id"], *[sum(x[0] == k for x in base_spans(r["text"])) for k in pii.KINDS]) for r in own])
    assert pii.summary(empty_docs(spark)).count() == 0
    real = pii.summary(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in real.collect():
        joined = ",".join(f"{k}:{a}:{z}" for k, a, z in base_spans(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
    assert not re.search("Python|Pandas|Arrow", real._jdf.queryExecution().executedPlan().toString())


def test_reliabilities_separate_two_classes():
    good, bad = (1, 1, 1, 1, None), (0, 0, 0, None, 0)
    post = pii.reliabilities([(0, good, 90), (0, bad, 40), (0, (1, 1, None, None, None), 10)])
    assert post[0, good] > 0.9 > 0.1 > post[0, bad] and post[0, (1, 1, None, None, None)] > 0.5


def labelled_texts(rng, n):
    """Texts with one candidate each: (text, start, end, personal)."""
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: rng.choice(["ana", "joe.roe", "max-m", "k_lee"]) + digits(2)
    cases = [
        (lambda: ("please write to ", f"{name()} [at] mail{digits(1)}.com"), True),
        (lambda: ("contact: ", f"{name()}(at)site{digits(2)}.org"), True),
        (lambda: ("my phone is ", f"0049 30 {digits(7)}"), True),
        (lambda: ("call me at ", f"({rng.randint(200, 989)}) 555-{digits(4)}"), True),
        (lambda: ("mobile ", f"{rng.randint(200, 989)}-555-{digits(4)}"), True),
        (lambda: ("order ", f"{rng.randint(200, 989)}.{digits(3)}.{digits(20)}"), False),
        (lambda: ("serial ", f"{rng.randint(200, 989)}-{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}"), False),
        (lambda: ("version ", f"300.{digits(3)}.1.2"), False),
        (lambda: ("isbn ", f"{rng.randint(200, 989)}-{digits(1)}-{digits(4)}-{digits(4)}-{digits(9)}"), False),
        (lambda: ("invoice ", f"9{digits(22)}"), False),
    ]
    out = []
    for i in range(n):
        make, personal = cases[i % len(cases)]
        before, span = make()
        text = f"Some words stand here, {before}{span} , and more words follow it."
        start = text.index(span)
        out.append((text, start, start + len(span), personal))
    return out


def test_added_spans_agree_with_labels(spark):
    """Precision and recall of the spans that the method adds to the base rules', over labelled texts."""
    rows = labelled_texts(random.Random(4), 2000)
    docs = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)], "doc_id long, text string")
    got = {}
    for r in pii.summary(docs).select("doc_id", "spans").collect():
        got[r["doc_id"]] = {tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s}
    hit = sum((start, end) in got[i] for i, (_, start, end, personal) in enumerate(rows) if personal)
    false = sum(bool(got[i]) for i, (*_, personal) in enumerate(rows) if not personal)
    assert hit >= 0.9 * sum(p for *_, p in rows) and hit / max(1, hit + false) >= 0.9


def test_gazetteers_come_from_a_file(spark, tmp_path):
    path = str(tmp_path / "gazetteers.txt")
    with open(path, "w") as f:
        f.write("mail_end test\nmail_end EXAMPLE\n\nreserved_net 10\nnothing x\n")
    read = pii.read_gazetteers(spark, path)
    assert read.mail_end == {"test", "example"} and read.reserved_net == {"10"} and read.calling_code == pii.Gazetteers().calling_code
    cases = [("a@b.test", 1), ("a@b.com", 0), ("10.0.0.1", 0), ("127.0.0.1", 1)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    _, found = pii.located(docs, "doc_id", "text")
    votes = {r["match"]: r["v_gazetteer"] for r in pii.judged(found, read).collect()}
    assert votes == dict(cases)
    plain = {r["match"]: r["v_gazetteer"] for r in pii.judged(found).collect()}
    assert plain == {"a@b.test": 0, "a@b.com": 1, "10.0.0.1": 1, "127.0.0.1": 0}
