"""Exact n-gram Jaccard join with rare-first prefix filtering.

A text's set holds the distinct 64-bit hashes of its five-word shingles (one
shingle of all words if there are fewer).  Texts of equal sets form a class; the
join runs between classes, named by a 64-bit digest of the set.

1. *Survey* (one pass over the texts): set size, class and parity sketch of every
   document; and frequent shingles: each run of ``RUN`` shingles counts those it
   holds more than once, the counts are summed over all runs, and the
   ``HEAVY`` largest are known by their counts from then on.
2. *Rare first* (a second pass): every set is ordered by these counts (0 for all
   other shingles), then by hash.  Two sets that reach the threshold share a
   shingle in their prefixes of n - ceil(t n) + 1 shingles.  The prefixes travel
   once, as packed arrays dealt by shingle (frequent ones by shingle and class, so
   that no list gathers in one task); shingles of one class alone are left out,
   the others are *postings*.  Of lists of the same classes one is kept: a
   pair's bounds hold at any common shingle.
3. *Candidates* come from joining postings on the shingle, under the length
   filter, the positional filter and a first suffix filter on 512 parities.  To
   keep a large group of near copies linear, three rounds link each class only
   to the nearest of the leaders of its lists, and a fourth to a few classes of each
   list, others in every list; the last round then takes the remaining pairs whose
   classes are still in different components, long lists in blocks, each pair at its
   first common list.  Links inside a component cannot change it.
4. *Verification*, once per pair: a suffix filter (parities in proportion to the
   set: two sets differ in at least as many shingles as in parities) drops hopeless
   pairs; the sets of the others are built from their texts and intersected.

Components are closed by joins on (node, label) pairs, over the components that
a round has linked.  All intermediate tables are written below
``spark.checkpoint.dir`` and deleted once used.  Nothing is capped: a pair is
left out only if a filter proves it below the threshold or its classes are
already connected; the frequent shingles steer the order only.

Edge cases: null, empty and wordless texts have the empty set and link with
nothing, so each is its own component; very long texts are read whole; repeated
rows share their class; a null id takes the smallest id of its component (null
if it has none); an empty table gives an empty result.  Extra columns are
ignored by ``components`` and pass through ``one_of_each``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knightshift.plans.joins import bounded_broadcast
from knightshift.session import cut_lineage, discard

from .common import join_groups
from .textblocks import LOWER, blocks, find_words, hash_words, mix, split_offsets

SHINGLE = 5
PERCENT = 75
RUN = 2_000_000                  # shingles among which repeated ones are counted
HEAVY = 1 << 20                  # frequent shingles whose counts order the sets (12 MB in every task)
LEAST_BITS = 512                 # parities of the smallest sketch, a power of two
PACK = 1 << 18                   # prefix shingles packed at a time
PER_TASK = 1_000_000             # prefix shingles of one range of shingles
SETS = 500_000                   # shingles of the sets handed back at a time
LIST_BLOCK = 1024                # classes of a list that one key of the last round holds
PAIRS_PER_TASK = 20_000_000
FEW = 4                          # classes of a list that every other meets before all remaining pairs are taken
CROWD = 200                      # classes of an average posting's list from which that round is worth its passes
LEADER_ROUNDS = (0, 0x5DEECE66D1234567, 0x2545F4914F6CDD1D)
BROADCAST_BYTES = 64 << 20       # of a broadcast side, measured

_U = np.uint64
_STEP = mix(np.arange(1, SHINGLE + 1, dtype=_U)) | _U(1)
POSTING = np.dtype([("token", "<i8"), ("cls", "<i8"), ("n", "<i4"), ("pos", "<i4")])


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for block in blocks(texts):
        lower = LOWER[block.data]
        words = find_words(block)
        h = hash_words(lower, words)
        cut = split_offsets(words.doc, block.n)
        n = len(h) - SHINGLE + 1
        whole = mix(sum((h[k:k + n] * _STEP[k] for k in range(SHINGLE)), _U(SHINGLE))) if n > 0 else h[:0]
        for i in range(block.n):
            a, z = cut[i], cut[i + 1]
            if z - a >= SHINGLE:
                yield np.unique(whole[a:z - SHINGLE + 1])
            elif z > a:
                yield mix(np.array([np.sum(h[a:z] * _STEP[:z - a]) + _U(z - a)], dtype=_U))
            else:
                yield h[:0]


def class_of(own: np.ndarray) -> int:
    """Signed 64-bit digest of a set."""
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def parities(own: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of a power of two of hash classes, at least two a shingle, as 64-bit words."""
    bits = max(LEAST_BITS, 1 << int(np.ceil(np.log2(max(1, 2 * len(own))))))
    odd = np.bincount((own & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def survey(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Rows (kind 0: id, class, set size, parities) of all documents and (kind 1: shingle, -, count) of every run.

    A task counts a class's shingles once and gives its parities once; the counts steer the order only, so a
    class that several tasks count does no harm.
    """
    names = ["kind", "id", "cls", "n", "sig"]

    def repeated(held: list[np.ndarray]) -> pa.RecordBatch:
        own = np.sort(np.concatenate(held)) if held else np.zeros(0, _U)
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(own)))
        token, count = own[first[count > 1]], count[count > 1]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(token)), pa.int8()), pa.array(token.view(np.int64)), pa.array(np.zeros(len(token)), pa.int64()),
                                           pa.array(count, pa.int64()), pa.nulls(len(token), pa.list_(pa.int64()))], names=names)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            classes, sizes, signs = [], [], []
            for own in shingle_sets(batch.column(1)):
                name = class_of(own)
                new = len(own) > 0 and name not in seen
                classes.append(name)
                sizes.append(len(own))
                signs.append(parities(own) if new else None)
                if new:
                    seen.add(name)
                    held.append(own)
                    size += len(own)
                    if size >= RUN:
                        yield repeated(held)
                        held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes)), pa.int8()), batch.column(0), pa.array(classes, pa.int64()),
                                              pa.array(sizes, pa.int64()), pa.array(signs, pa.list_(pa.int64()))], names=names)
        yield repeated(held)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(look, "kind byte, id long, cls long, n long, sig array<long>")


def frequent(surveyed: DataFrame, most: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of the largest counts, at most ``most``, sorted by hash, and their counts."""
    counts = cut_lineage(surveyed.where("kind = 1").groupBy(F.col("id").alias("token")).agg(F.sum("n").alias("n")), "shingle-counts")
    how_many, least = 0, None
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).limit(100_000).toLocalIterator():
        how_many += r["count"]
        if how_many > most:
            break
        least = r["n"]
    if least is None:
        return np.zeros(0, _U), np.zeros(0, np.int32)
    table = counts.where(F.col("n") >= least).toArrow()
    token, n = table.column("token").to_numpy().view(_U), np.minimum(table.column("n").to_numpy(), (1 << 31) - 1).astype(np.int32)
    discard(counts)
    order = np.argsort(token)
    return token[order], n[order]


def prefix(own: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """The rare-first prefix of a set, and how many of its shingles are not frequent."""
    n = len(own)
    length = n - -(-percent * n // 100) + 1 if n else 0
    keys, counts = heavy
    if not len(keys):
        return own[:length], length
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    known = keys[at] == own
    light = own[~known][:length]
    if len(light) == length:
        return light, length
    rest = own[known]
    return np.concatenate((light, rest[np.lexsort((rest, counts[at[known]]))[:length - len(light)]])), len(light)


def packed_prefixes(docs: DataFrame, text: str, heavy: tuple[np.ndarray, np.ndarray], ranges: int, percent: int) -> DataFrame:
    """Prefixes of each class, once per task and class, as arrays of POSTING dealt into ``ranges``.

    Rows (range, frequent, data): a shingle that is not frequent lies in one range, the postings of a frequent one in all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def flush(tokens: list, light: list, names: list, sizes: list) -> Iterator[pa.RecordBatch]:
        each = np.array([len(t) for t in tokens], dtype=np.int64)
        if not each.sum():
            return
        out = np.empty(int(each.sum()), POSTING)
        out["token"] = np.concatenate(tokens).view(np.int64)
        out["cls"], out["n"] = np.repeat(np.array(names, np.int64), each), np.repeat(np.array(sizes, np.int32), each)
        out["pos"] = np.arange(len(out)) - np.repeat(np.cumsum(each) - each, each)
        often = out["pos"] >= np.repeat(np.array(light, np.int64), each)
        key = np.where(often, mix(out["token"].view(_U) ^ mix(out["cls"].view(_U))), out["token"].view(_U))
        bucket = ((key >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64) * 2 + often
        order = np.argsort(bucket, kind="stable")
        out, bucket = out[order], bucket[order]
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        data = [out[a:z].tobytes() for a, z in zip(first, np.append(first[1:], len(out)))]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[first] // 2, pa.int32()), pa.array(bucket[first] % 2 == 1), pa.array(data, pa.binary())],
                                         names=["range", "frequent", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        tokens, light, names, sizes, held = [], [], [], [], 0
        for batch in batches:
            for own in shingle_sets(batch.column(0)):
                name = class_of(own)
                if name in seen or not len(own):
                    continue
                seen.add(name)
                first, plain = prefix(own, shared.value, percent)
                tokens.append(first)
                light.append(plain)
                names.append(name)
                sizes.append(len(own))
                held += len(first)
                if held >= PACK:
                    yield from flush(tokens, light, names, sizes)
                    tokens, light, names, sizes, held = [], [], [], [], 0
        yield from flush(tokens, light, names, sizes)

    return docs.select(F.col(text).alias("text")).mapInArrow(pack, "range int, frequent boolean, data binary")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: distinct postings of the frequent shingles, and of the others that more than one class holds."""
    held: dict[bool, list[np.ndarray]] = {False: [], True: []}
    for batch in batches:
        for often, data in zip(batch.column(1).to_pylist(), batch.column(2)):
            held[often].append(np.frombuffer(data.as_buffer(), POSTING).copy())
    for often, parts in held.items():
        if not parts:
            continue
        own = np.concatenate(parts)
        parts.clear()
        own = own[np.lexsort((own["cls"], own["token"]))]
        fresh = np.concatenate(([True], (own["token"][1:] != own["token"][:-1]) | (own["cls"][1:] != own["cls"][:-1])))
        own = own[fresh]
        if not often:
            same = own["token"][1:] == own["token"][:-1]
            own = own[np.append(same, False) | np.append(False, same)]
        for a in range(0, len(own), 100_000):
            part = own[a:a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part[c])) for c in POSTING.names], names=list(POSTING.names))


def postings_of(docs: DataFrame, text: str, surveyed: DataFrame, percent: int) -> DataFrame:
    """Rows (token, cls, n, pos, k): prefix shingles of more than one class, one list of each set of classes; k classes each."""
    heavy = frequent(surveyed)
    total = surveyed.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * (100 - percent) // 100
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, -(-total // PER_TASK), min(tasks, total // 10_000))
    packs = packed_prefixes(docs, text, heavy, ranges, percent).repartitionById(ranges, F.col("range"))
    every = cut_lineage(packs.mapInArrow(unpacked, "token long, cls long, n int, pos int"), "postings")
    sign = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), F.col("cls")))
    lists = every.groupBy("token").agg(F.count(F.lit(1)).alias("k"), sign(1).alias("x"), sign(2).alias("y")).where("k > 1")
    kept = cut_lineage(lists.groupBy("k", "x", "y").agg(F.min("token").alias("kept")).select("kept", "k"), "lists")
    out = cut_lineage(join_groups(every, kept, F.col("token") == F.col("kept"), "kept", "k", every.count(), BROADCAST_BYTES)
                      .select("token", "cls", "n", "pos", "k"), "one-of-equal-lists")
    discard(every, kept)
    return out


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, sets, held = [], [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "own"])

    for batch in batches:
        for own in shingle_sets(batch.column(0)):
            if len(own):
                names.append(class_of(own))
                sets.append(own.view(np.int64))
                held += len(own)
            if held >= SETS:
                yield flush()
                names, sets, held = [], [], 0
    yield flush()


def of_classes(docs: DataFrame, id_col: str, text: str, wanted: DataFrame, build, schema: str) -> DataFrame:
    """``build`` over one text of each class in ``wanted`` (rep: a document of the class, cls)."""
    own = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text).alias("text"))
    reps = wanted.select("rep").where(F.col("rep").isNotNull()).distinct()
    rows = own.where(F.col("rep").isNotNull()).join(bounded_broadcast(reps, BROADCAST_BYTES), "rep", "left_semi")
    if wanted.where(F.col("rep").isNull()).limit(1).count():       # classes of null ids only
        rows = rows.unionByName(own.where(F.col("rep").isNull()))
    made = rows.select("text").mapInArrow(build, schema)
    return made.join(bounded_broadcast(wanted.select("cls"), BROADCAST_BYTES), "cls", "left_semi")


def overlap_needed(n: Column | str, m: Column | str, percent: int) -> Column:
    """The smallest intersection of sets of n and m shingles (columns or their names) that reaches the threshold."""
    n, m = (F.col(c) if isinstance(c, str) else c for c in (n, m))
    return F.call_function("div", (n + m) * F.lit(percent).cast("long") + F.lit(99 + percent), F.lit(100 + percent).cast("long"))


def may_reach(a: str, b: str, percent: int) -> Column:
    """Length filter and positional filter for a common prefix shingle."""
    n, m, i, j = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.pos"), F.col(f"{b}.pos")
    length = F.least(n, m) * F.lit(100).cast("long") >= F.greatest(n, m) * F.lit(percent).cast("long")
    bound = F.least(i, j) + 1 + F.least(n - i, m - j) - 1
    return length & (bound >= overlap_needed(f"{a}.n", f"{b}.n", percent))


def with_roots(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Postings with the component (``root``) of their class."""
    if labels is None:
        return postings.withColumn("root", F.col("cls"))
    return postings.join(labels, "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def mixed_lists(posted: DataFrame, rank: Column) -> DataFrame:
    """Lists of more than one component: (list, classes, lead), the leader being the class of the least ``rank``."""
    lead = F.min(F.struct(rank.alias("r"), "cls", "n", "pos", "root"))
    return (posted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("k").alias("classes"), lead.alias("lead"))
            .where("lo <> hi").select(F.col("token").alias("list"), "classes", "lead"))


def leader_pairs(posted: DataFrame, seed: int, percent: int) -> DataFrame:
    """Each class of a posting list with the list's seeded leader, if they lie in different components: (a, b the leader, n, m)."""
    lists = cut_lineage(mixed_lists(posted, F.col("cls").bitwiseXOR(F.lit(seed))), "leaders")
    joined = join_groups(posted, lists, F.col("token") == F.col("list"), "list", "classes", posted.count(), BROADCAST_BYTES)
    x = joined.select(F.struct("cls", "n", "pos", "root").alias("x"), F.col("lead").alias("y"))
    return (x.where((F.col("x.root") != F.col("y.root")) & may_reach("x", "y", percent))
            .select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m")).distinct())


def remaining_pairs(posted: DataFrame, signatures: DataFrame, percent: int, few: int | None = None) -> DataFrame:
    """All pairs of a posting list that lie in different components and pass the filters, each at its first common list.

    A list of more than ``LIST_BLOCK`` classes is cut into blocks; every class meets every block, in a task of its own.
    With ``few``, a class meets about so many classes of each list only, others in every list.
    """
    lists = cut_lineage(mixed_lists(posted, F.lit(0)).select("list", "classes"), "mixed-lists")
    own = join_groups(posted, lists, F.col("token") == F.col("list"), "list", "classes", posted.count(), BROADCAST_BYTES)
    own = cut_lineage(own.select("token", "cls", "n", "pos", "root", "classes", F.ceil(F.col("classes") / LIST_BLOCK).cast("int").alias("parts")), "mixed-postings")
    held = own.groupBy("cls").agg(F.collect_list("token").alias("lists"))          # at most the class's prefix
    words = F.expr(f"transform(sequence(0, {LEAST_BITS // 64 - 1}), j -> aggregate(sequence(j, size(sig) - 1, {LEAST_BITS // 64}), 0L, (x, i) -> x ^ sig[i]))")
    known = signatures.select("cls", words.alias("w")).select("cls", *[F.col("w")[j].alias(f"w{j}") for j in range(LEAST_BITS // 64)])
    rows = cut_lineage(own.join(known.join(held, "cls"), "cls"), "signed-postings")
    part = F.pmod(F.xxhash64("cls"), F.col("parts").cast("long")).cast("int")
    # the work is in the pairs looked at, not in the bytes: the tasks are set by their number
    looked_at = lists.agg(F.coalesce(F.sum(F.col("classes") * F.col("classes")), F.lit(0))).first()[0]
    tasks = max(int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-looked_at // PAIRS_PER_TASK))
    left = rows.withColumn("part", part).repartition(tasks, "token", "part")
    right = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).repartition(tasks, "token", "part")
    x, y = left.alias("x"), right.alias("y")
    once = (F.col("x.cls") < F.col("y.cls")) & (F.array_min(F.array_intersect("x.lists", "y.lists")) == F.col("x.token"))
    if few is not None:
        y = right.where(F.pmod(F.xxhash64("token", "cls"), F.col("classes")) < few).alias("y")
        once = F.col("x.cls") != F.col("y.cls")
    apart = sum((F.bit_count(F.col(f"x.w{j}").bitwiseXOR(F.col(f"y.w{j}"))) for j in range(1, LEAST_BITS // 64)),
                F.bit_count(F.col("x.w0").bitwiseXOR(F.col("y.w0"))))
    n, m = F.col("x.n"), F.col("y.n")
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.part") == F.col("y.part"))
                   & (F.col("x.root") != F.col("y.root")) & may_reach("x", "y", percent)
                   & (apart <= n + m - 2 * overlap_needed("x.n", "y.n", percent)) & once)
    pairs = pairs.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), n.alias("n"), m.alias("m"))
    if few is not None:
        lower = F.col("a") < F.col("b")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(lower, F.col("n")).otherwise(F.col("m")).alias("n"),
                             F.when(lower, F.col("m")).otherwise(F.col("n")).alias("m")).distinct()
    out = cut_lineage(pairs, "pairs")
    discard(lists, own, rows)
    return out


def crowd(posted: DataFrame) -> float:
    """Classes that a posting shares its list with, on average over the postings of mixed lists."""
    of = mixed_lists(posted, F.lit(0)).agg(F.sum(F.col("classes") * F.col("classes")).alias("pairs"), F.sum("classes").alias("n")).first()
    return of["pairs"] / of["n"] if of["n"] else 0.0


def hopeful_pairs(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Suffix filter: pairs whose parities allow an intersection that reaches the threshold, with their distance (``apart``).

    Of two sketches the longer, twice as long at most at this threshold, is folded; longer ones still prove nothing.
    """
    need = overlap_needed("n", "m", percent)
    apart = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    half = lambda p: F.zip_with(F.slice(p, F.lit(1), (F.size(p) / 2).cast("int")), F.slice(p, (F.size(p) / 2 + 1).cast("int"), (F.size(p) / 2).cast("int")),
                                lambda x, y: x.bitwiseXOR(y))
    p, q = F.col("p"), F.col("q")
    distance = (F.when(F.size(p) == F.size(q), apart(p, q)).when(F.size(p) == 2 * F.size(q), apart(half(p), q))
                .when(F.size(q) == 2 * F.size(p), apart(p, half(q))).otherwise(F.lit(0)))
    return (pairs.join(signatures.select(F.col("cls").alias("a"), F.col("sig").alias("p")), "a")
            .join(signatures.select(F.col("cls").alias("b"), F.col("sig").alias("q")), "b")
            .select("a", "b", "n", "m", distance.alias("apart")).where(F.col("apart") <= F.col("n") + F.col("m") - 2 * need))


def verified(hopeful: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The intersection of each pair's sets: pairs (a, b) that reach the threshold.

    The pairs are sent to the sets if they measure small; a set travels once per pair to its partner ``b``, whose
    own set is sent to all tasks if it has very many partners.
    """
    need = overlap_needed("n", "m", percent)
    sent = bounded_broadcast(hopeful, BROADCAST_BYTES)
    first = sets.join(sent, F.col("cls") == F.col("a")).select("a", "b", "n", "m", F.col("own").alias("s"))
    asked = hopeful.groupBy("b").agg(F.count(F.lit(1)).alias("asked"))
    second = sets.join(bounded_broadcast(asked, BROADCAST_BYTES), F.col("cls") == F.col("b")).select(F.col("b").alias("partner"), "asked", F.col("own").alias("t"))
    met = join_groups(first, second, F.col("b") == F.col("partner"), "partner", "asked", hopeful.count(), BROADCAST_BYTES // 4)
    return met.where(F.size(F.array_intersect("s", "t")) >= need).select("a", "b")


def close(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b): rows (cls, root), root the smallest class of the component.

    Edges shrink to (node, label) pairs by alternating large-star and small-star steps, so that a chain of any
    length closes in a logarithmic number of rounds; each round is two joins over the edges left.
    """
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
                 .where("u <> v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.explode(F.array(F.struct("v", F.col("m").alias("w")),
                                                               F.struct(F.col("u").alias("v"), F.col("m").alias("w")))).alias("e"))
                 .select(F.col("e.v").alias("u"), F.col("e.w").alias("v")).where("u <> v").distinct())
        now = cut_lineage(small, "edges")
        single = now.groupBy("u").count().where("count > 1").limit(1).count() == 0
        if single and now.join(now.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count() == 0:
            return now.select(F.col("u").alias("cls"), F.col("v").alias("root"))   # every edge leads to a root


def relabelled(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """Labels (cls, root) after the links ``found``: only the components that they join are closed anew."""
    if labels is None:
        return close(found)
    root = lambda side, name: labels.select(F.col("cls").alias(side), F.col("root").alias(name))
    between = (found.join(root("a", "ra"), "a", "left").join(root("b", "rb"), "b", "left")
               .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct())
    moved = close(between)
    old = labels.join(moved.select(F.col("cls").alias("root"), F.col("root").alias("top")), "root", "left")
    return cut_lineage(old.select("cls", F.coalesce("top", "root").alias("root")).unionByName(moved), "labels")


def components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links)."""
    surveyed = cut_lineage(survey(docs, id_col, text), "survey")
    members = surveyed.where("kind = 0").select("id", "cls", "n")
    postings = postings_of(docs, text, surveyed, percent)
    listed = cut_lineage(postings.select("cls").distinct(), "listed")
    candidate = bounded_broadcast(listed, BROADCAST_BYTES)
    wanted = cut_lineage(members.join(candidate, "cls").groupBy("cls").agg(F.min("id").alias("rep")), "candidates")
    signatures = cut_lineage(surveyed.where("sig IS NOT NULL").select("cls", "sig").join(candidate, "cls", "left_semi")
                             .dropDuplicates(["cls"]), "signatures")

    tried, labels = None, None
    for seed, few in (*((s, None) for s in LEADER_ROUNDS), (None, FEW), (None, None)):
        now = with_roots(postings, labels)
        if few is not None and crowd(now) < CROWD:
            continue
        pairs = remaining_pairs(now, signatures, percent, few) if seed is None else leader_pairs(now, seed, percent)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti").join(tried.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
        hopeful = hopeful_pairs(pairs, signatures, percent)
        if seed is not None:      # of the leaders of its lists a class tries the nearest
            nearest = hopeful.groupBy("a").agg(F.min_by(F.struct("b", "n", "m"), F.struct("apart", "b")).alias("x"))
            hopeful = nearest.select("a", "x.*")
        hopeful = cut_lineage(hopeful.select("a", "b", "n", "m"), "hopeful")
        needed = cut_lineage(hopeful.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(wanted, "cls"), "needed")
        sets = cut_lineage(of_classes(docs, id_col, text, needed, sets_of, "cls long, own array<long>").dropDuplicates(["cls"]), "sets")
        found = cut_lineage(verified(hopeful, sets, percent), "links")
        discard(sets, needed)
        labels = relabelled(labels, found)
        tried = hopeful.select("a", "b") if tried is None else tried.unionByName(hopeful.select("a", "b"))

    # classes first, so that a class of very many copies meets its component's smallest id without a shuffle of its rows
    classes = cut_lineage(members.where("n > 0").groupBy("cls").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("k"))
                          .join(labels, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "classes")
    smallest = classes.groupBy(F.col("root").alias("top")).agg(F.min("least").alias("component_id"))
    linked = classes.join(smallest, F.col("root") == F.col("top")).select(F.col("cls").alias("of"), "k", "component_id")
    discard(postings, listed, wanted, signatures)
    own = join_groups(members.where("n > 0"), cut_lineage(linked, "component-ids"), F.col("cls") == F.col("of"), "of", "k", members.count(), BROADCAST_BYTES)
    alone = members.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return own.select("id", "n", "component_id").unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, columns unchanged (null ids stay)."""
    found = components(docs, id_col, text, percent)
    drop = cut_lineage(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__drop")).distinct(),
                       "near-copies")
    return docs.join(bounded_broadcast(drop, BROADCAST_BYTES), docs[id_col] == F.col("__drop"), "left_anti")
