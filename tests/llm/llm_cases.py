"""Small hostile tables and brute-force versions shared by the tests of the training-data operators."""
import random
import re
from collections import Counter

from pyspark.sql import functions as F

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def prose(rng, n):
    return " ".join(rng.choice(["stone", "river", "Über", "été", "cloud", "ñandú", "path", "42", "green,"]) + str(rng.randint(0, 60)) for _ in range(n))


def hostile_docs(spark):
    """Nulls in every column, empty and blank texts, a long text, ties, repeated rows, line breaks, clashing columns."""
    rng = random.Random(3)
    base = prose(rng, 120)
    near = base.replace("stone", "stones", 1)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "b", 1), (2, base, "en", "b", 1), (3, near, None, None, None),
        (4, None, "en", "a", 0), (5, "", "en", "a", 0), (6, " \t\n ", None, "b", 3), (None, base, "en", "a", 1),
        (None, None, None, None, None), (7, prose(rng, 30_000), "en", "a", 9), (8, "one two", "en", "c", 7),
        (9, "one  two", "en", "c", 7), (10, "A line here\nA line here\n\n a LINE here\nmore words to come now", "en", "c", 7),
        (11, "x" * 20_000, "en", "b", 1), (12, "1 " * 5_000, "en", "b", 1), (13, "日本語 テキスト 😀 " * 10, "ja", "é", 1),
        (-14, "<|endoftext|> a@b.co, +49 (30) 123-4567 and 10.0.0.255; 4111 1111 1111 1111 end", "en", "", 1),
    ]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    for name in ("score", "kept", "size", "row", "kind", "id", "n", "target", "h", "cls", "host", "label", "chunk"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def rows_of(df, *columns):
    got = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(got, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def ordered(rows):
    return sorted(rows, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group(0).lower(), text or "")


def jaccard_components(rows, percent=75, n=5):
    """(doc_id, set size, smallest id reachable) by comparing all pairs that share a shingle."""
    sets, holders = [], {}
    for i, (_, text) in enumerate(rows):
        w = words(lower(text))
        own = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        sets.append(own)
        for s in own:
            holders.setdefault(s, []).append(i)
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in enumerate(sets):
        for j, common in Counter(j for s in own for j in holders[s] if j < i).items():
            if 100 * common >= percent * (len(own) + len(sets[j]) - common):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]
