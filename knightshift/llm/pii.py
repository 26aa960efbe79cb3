"""Personal-data spans by weak supervision (DataFrame functions only).

Base rules find emails, IP addresses, card numbers and phone numbers; what they
accept always stays.  Wider patterns add candidates: written-out emails, national
phone numbers, and what the base patterns match but their checks refuse.

Every candidate is voted on by labelers: the strict rule, a format rule, a
gazetteer (mail domains, reserved networks, card issuers, calling codes) and two
context word lists.  Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is, without any label, and gives each
pattern a probability; a logistic span classifier for each kind is then trained on
features of the candidates with these probabilities as soft labels, and decides
which further candidates become spans.  The gazetteers can be read from a file.

Only counts by vote and feature pattern reach the driver; their number is fixed
by the labelers and features (``PATTERNS`` at most), whatever the input.
Texts are scanned once, by the JVM's regular expressions, in a form that neither
backtracks through a run nor recurses once per character; starts come from
the lengths of the matches and of the text between them.

Edge cases: null and empty texts have no span; very long texts are scanned whole;
overlapping candidates never replace a base span; repeated rows and null ids are
kept; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knightshift.session import cut_lineage

from .quality_rules import let

KINDS = ("email", "ip", "card", "phone")

# Base patterns, equal to the plain ones in what they match.  A run is entered at its start (or where the last match
# ended), possessive quantifiers do not give back, and repeated groups match in blocks, so that a long run stays cheap.
_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?>(?:\.{_LABEL}++){{1,250}})+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?>(?>(?:[\x20-]?[0-9]){1,250}){1,250})+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++\x20?(?:\[at\]|\(at\)|\{{at\}})\x20?{_LABEL}++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?{_LABEL}++){{1,8}}",
    "phone": r"(?<![0-9+().-])(?:00[1-9]|\([0-9]{3}\)|[0-9]{3}(?=[\x20.-]))[\x20().0-9-]{7,40}[0-9](?![0-9])",
}
#: What a text must contain before a base pattern is tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
CONTEXT = 32

# Default gazetteers and context words.
MAIL_ENDS = ("com org net edu gov info io de fr es uk eu us ch at it nl be pl br jp cn in ru au ca").split()
RESERVED_NETS = [str(n) for n in (0, 127, *range(224, 256))]
CARD_ISSUERS = ["4", *(str(n) for n in (*range(51, 56), *range(22, 28), 34, 37, 65, 35, 30, 36, 38)), "6011"]
CALLING_CODES = ["1", "7", *(str(n) for n in (20, 27, *range(30, 35), 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98))]
FOR_WORDS = {
    "email": r"(?i)(e-?mail|mail|contact|kontakt|correo|courriel|write|schreib)",
    "ip": r"(?i)(\bip\b|host|server|address|adresse|login|client|from)",
    "card": r"(?i)(card|karte|carte|tarjeta|visa|master|credit|payment|iban)",
    "phone": r"(?i)(\btel|phone|fon\b|call|fax|mobil|handy|cell|whatsapp|tél|llame)",
}
AGAINST_WORDS = r"(?i)(version|isbn|order|invoice|figure|fig[.]|chapter|section|serial|article|sku|page|vol[.]|build)\W*$"


@dataclass(frozen=True)
class Gazetteers:
    """Lists that the gazetteer labeler looks up: ends of mail domains, first numbers of reserved networks, first digits of
    card issuers and calling codes."""
    mail_end: frozenset[str] = frozenset(MAIL_ENDS)
    reserved_net: frozenset[str] = frozenset(RESERVED_NETS)
    card_issuer: frozenset[str] = frozenset(CARD_ISSUERS)
    calling_code: frozenset[str] = frozenset(CALLING_CODES)

    def known(self, match: Column, digits: Column) -> dict[str, Column]:
        """Whether a candidate's network, issuer or country is a known one, by kind."""
        begins = lambda text, entries: reduce(lambda a, b: a | b, [
            F.left(text, F.lit(n)).isin(sorted(e for e in entries if len(e) == n)) for n in sorted({len(e) for e in entries})], F.lit(False))
        code = F.regexp_replace(digits, "^00", "")
        return {"email": F.lower(F.regexp_extract(match, r"[.]([A-Za-z0-9-]+)$", 1)).isin(sorted(self.mail_end)),
                "ip": ~F.regexp_extract(match, r"^0*([0-9]+)[.]", 1).isin(sorted(self.reserved_net)),
                "card": begins(digits, self.card_issuer),
                "phone": F.when(match.rlike(r"^(\+|00)"), begins(code, self.calling_code))}


def read_gazetteers(spark: SparkSession, path: str, most: int = 100_000) -> Gazetteers:
    """Gazetteers from text lines ``name entry`` (names as in ``Gazetteers``, at most ``most`` lines); names not in the file keep their default."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.get(parts, F.lit(0)).alias("name"), F.lower(F.get(parts, F.lit(1))).alias("entry")).where("entry IS NOT NULL").limit(most).collect()
    read = {f.name: frozenset(r["entry"] for r in rows if r["name"] == f.name) for f in fields(Gazetteers)}
    return Gazetteers(**{name: entries for name, entries in read.items() if entries})


LABELERS = ("v_rule", "v_format", "v_gazetteer", "v_for", "v_against")
#: Where the estimation starts: how often a labeler says yes and no, of what is not personal and of what is.  The words and
#: sizes against a span, and the strict rule, are trusted more than the others.
START = {"v_rule": ((0.05, 0.6), (0.5, 0.1)), "v_format": ((0.3, 0.5), (0.6, 0.2)), "v_gazetteer": ((0.2, 0.4), (0.5, 0.2)),
         "v_for": ((0.1, 0.01), (0.6, 0.01)), "v_against": ((0.01, 0.7), (0.01, 0.05))}
FEATURES = ("f_rule", "f_shape", "f_alone", "f_known", "f_word", "f_doubt", "f_long")
PATTERNS = len(KINDS) * (3 ** len(LABELERS)) * (2 ** len(FEATURES))
SPAN = "struct<kind:int,base:boolean,idx:int,match:string,gap:int,left:string,right:string>"


def candidates_of(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """Array of the pattern's matches: text, characters since the previous match, neighbouring text."""
    def build(found: Column) -> Column:
        def rows(between: Column) -> Column:
            return F.transform(found, lambda m, i: F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"), i.alias("idx"), m.alias("match"),
                F.length(F.get(between, i)).alias("gap"), F.right(F.get(between, i), F.lit(CONTEXT)).alias("left"),
                F.left(F.get(between, i + 1), F.lit(CONTEXT)).alias("right")))
        return F.when(F.size(found) == 0, F.array().cast(f"array<{SPAN}>")).otherwise(let(F.split(text, pattern, -1), rows))

    scan = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), build).cast(f"array<{SPAN}>")
    if base and kind in NEEDS:
        scan = F.when(F.contains(text, F.lit(NEEDS[kind])), scan).otherwise(F.array().cast(f"array<{SPAN}>"))
    return scan


def luhn(digits: Column) -> Column:
    """The Luhn check of a digit string."""
    def part(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 1, twice).otherwise(d)
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + part(i))
    return total % 10 == 0


def located(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``row`` and ``id``; candidates with start and end).  The scan is written, so ``row`` is fixed."""
    body = F.coalesce(F.col(text), F.lit(""))
    every = F.concat(*[candidates_of(F.col("t"), k, p, True) for k, p in BASE.items()],
                     *[candidates_of(F.col("t"), k, p, False) for k, p in WIDE.items()])
    rows = cut_lineage(docs.select(F.col(id_col).alias("id"), body.alias("t"))
                       .select(F.monotonically_increasing_id().alias("row"), "id", every.alias("found")), "pii-scan")
    found = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("c")).select("row", "c.*")
    order = Window.partitionBy("row", "kind", "base").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(order).cast("int")
    return rows.select("row", "id"), found.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))


def judged(found: DataFrame, gazetteers: Gazetteers = Gazetteers()) -> DataFrame:
    """Candidates with the base verdict, the labelers' votes (1, 0, null: abstains) and 0/1 features."""
    m, digits = F.col("match"), F.regexp_replace("match", "[^0-9]", "")
    octet = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    n = F.length(digits)

    def per_kind(values: dict[str, Column]) -> Column:
        out = F.when(F.col("kind") == 0, values["email"])
        for i, k in enumerate(KINDS[1:], 1):
            out = out.when(F.col("kind") == i, values[k])
        return out

    card_size = (n >= 13) & (n <= 19)
    strict = F.col("base") & per_kind({
        "email": F.lit(True), "ip": m.rlike(rf"^{octet}(\.{octet}){{3}}$"),
        "card": F.when(card_size, luhn(digits)).otherwise(False), "phone": (n >= 9) & (n <= 15)})
    shape = per_kind({
        "email": m.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)*[.][A-Za-z]{2,10}$"),
        "ip": m.rlike(r"^(0|[1-9][0-9]{0,2})([.](0|[1-9][0-9]{0,2})){3}$"),
        "card": m.rlike(r"^([0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\3[0-9]{5})$"),
        "phone": m.rlike(r"^(\+|00)?[0-9]{0,3}[ .-]?\(?[0-9]{1,4}\)?([ .-]?[0-9]{2,4}){2,5}$")})
    known = per_kind(gazetteers.known(m, digits))
    for_it = per_kind({k: F.col("left").rlike(w) for k, w in FOR_WORDS.items()})
    against = F.col("left").rlike(AGAINST_WORDS)
    alone = ~F.col("left").rlike(r"[A-Za-z0-9]$") & ~F.col("right").rlike("^[A-Za-z0-9]")
    vote = lambda c: c.cast("int")
    only = lambda c, v: F.when(c, v)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    too_long = per_kind({"email": F.length(m) > 80, "ip": F.length(m) > 15, "card": ~card_size, "phone": (n < 7) | (n > 15)})
    return (found.withColumn("strict", strict)
            .withColumns({"v_rule": F.when(F.col("base"), vote(F.col("strict"))), "v_format": vote(shape), "v_gazetteer": vote(known),
                          "v_for": only(for_it, 1), "v_against": only(against | too_long, 0)})
            .withColumns({"f_rule": flag(F.col("strict")), "f_shape": flag(shape), "f_alone": flag(alone), "f_known": flag(known),
                          "f_word": flag(for_it), "f_doubt": flag(against), "f_long": flag(too_long)}))


def reliabilities(patterns: list[tuple[int, tuple, int]], rounds: int = 30) -> dict[tuple[int, tuple], float]:
    """Probability that a candidate is personal data, by kind and votes, by expectation-maximisation.

    Each labeler has, for either class, a probability of each of its answers (yes, no, abstains); the start is
    ``START``, and counts are smoothed.
    """
    answers = (1, 0, None)
    prior = {k: 0.5 for k, _, _ in patterns}
    said = {c: [dict(zip(answers, (*START[v][c], 1 - sum(START[v][c])))) for v in LABELERS] for c in (0, 1)}
    post: dict[tuple[int, tuple], float] = {}
    for _ in range(rounds):
        for kind, votes, _ in patterns:
            like = [math.log(prior[kind] if c else 1 - prior[kind]) + sum(math.log(said[c][j][v]) for j, v in enumerate(votes)) for c in (0, 1)]
            post[kind, votes] = 1 / (1 + math.exp(min(60.0, like[0] - like[1])))
        for kind in prior:
            mass = [(n, post[k, v]) for k, v, n in patterns if k == kind]
            prior[kind] = (1 + sum(n * p for n, p in mass)) / (2 + sum(n for n, _ in mass))
        for c in (0, 1):
            weight = lambda k, v: post[k, v] if c else 1 - post[k, v]
            for j in range(len(LABELERS)):
                count = {a: 1.0 + sum(n * weight(k, v) for k, v, n in patterns if v[j] == a) for a in answers}
                said[c][j] = {a: x / sum(count.values()) for a, x in count.items()}
    return post


def train(patterns: list[tuple[tuple, float, int]], rounds: int = 400, rate: float = 0.5, l2: float = 1e-3) -> list[float]:
    """Logistic weights (bias first) for feature patterns with soft labels and counts."""
    w = [0.0] * (1 + len(FEATURES))
    total = sum(n for _, _, n in patterns) or 1
    for _ in range(rounds):
        grad = [l2 * x for x in w]
        for x, y, n in patterns:
            z = w[0] + sum(a * b for a, b in zip(w[1:], x))
            push = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * n / total
            grad[0] += push
            for j, a in enumerate(x):
                grad[j + 1] += push * a
        w = [a - rate * g for a, g in zip(w, grad)]
    return w


def classifier(votes: DataFrame) -> Column:
    """Fit reliabilities and a span classifier for each kind on ``judged`` candidates; returns the probability as a column."""
    rows = votes.groupBy("kind", *LABELERS, *FEATURES).agg(F.count("*").alias("n")).collect()   # at most PATTERNS rows
    by_vote: dict[tuple[int, tuple], int] = {}
    for r in rows:
        key = (r["kind"], tuple(r[v] for v in LABELERS))
        by_vote[key] = by_vote.get(key, 0) + r["n"]
    post = reliabilities(sorted(((k, v, n) for (k, v), n in by_vote.items()), key=str))
    out = F.lit(0.0)
    for kind in range(len(KINDS)):
        soft = sorted(((tuple(r[f] for f in FEATURES), post[kind, tuple(r[v] for v in LABELERS)], r["n"]) for r in rows if r["kind"] == kind), key=str)
        w = train(soft)
        z = sum((F.col(f) * F.lit(round(x, 9)) for f, x in zip(FEATURES, w[1:])), F.lit(round(w[0], 9)))
        out = F.when(F.col("kind") == kind, 1 / (1 + F.exp(-z))).otherwise(out)
    return out


def spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", limit: float = 0.5,
          gazetteers: Gazetteers = Gazetteers()) -> tuple[DataFrame, DataFrame]:
    """(rows with ``row`` and ``id``; spans with row, kind, start, end, match, strict, probability).

    Strict spans are the base rules' own; others scored ``limit`` or more and overlap no strict span.
    """
    rows, found = located(docs, id_col, text)
    votes = cut_lineage(judged(found, gazetteers), "pii-votes")
    scored = votes.withColumn("probability", classifier(votes))
    upto = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row").orderBy("start", "end").rowsBetween(0, Window.unboundedFollowing)
    ends = F.max(F.when(F.col("strict"), F.col("end"))).over(upto)
    begins = F.min(F.when(F.col("strict"), F.col("start"))).over(after)
    clear = (F.coalesce(ends, F.lit(-1)) <= F.col("start")) & (F.coalesce(begins, F.lit(2**31 - 1)) >= F.col("end"))
    out = (scored.withColumn("clear", clear).where(F.col("strict") | (F.col("clear") & (F.col("probability") >= limit)))
           .select("row", "kind", "start", "end", "match", "strict", "probability"))
    return rows, out


def summary(docs: DataFrame, id_col: str = "doc_id", text: str = "text", gazetteers: Gazetteers = Gazetteers()) -> DataFrame:
    """One row per input row: id, base counts by kind, base_sha256 and spans."""
    rows, found = spans(docs, id_col, text, gazetteers=gazetteers)
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(only: Column | None) -> Column:
        span = F.struct("kind", "start", "end")
        all_of = F.collect_set(F.when(only, span) if only is not None else span)
        return F.array_join(F.transform(F.sort_array(all_of), lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.count(F.when(F.col("strict") & (F.col("kind") == i), 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    per_row = found.groupBy("row").agg(*counts, joined(F.col("strict")).alias("base"), joined(None).alias("spans"))
    out = rows.join(per_row, "row", "left")
    return out.select(F.col("id").alias(id_col), *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
                      F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
                      F.coalesce("spans", F.lit("")).alias("spans"))
