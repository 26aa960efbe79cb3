"""Token counts of byte-level BPE with a whole-token shortcut.

Offline (once, on the driver) every vocabulary string that reads as text is
tried as a pre-token of its own: if the pre-tokenizer leaves it whole and the
merges turn it into exactly one token, it is *proved whole*.  At run time a
text is cut into pre-tokens; those in the proved set count as one token each
without merging, and only the rest go through the merge rules (with a bounded
cache per worker, because words repeat).

Special tokens listed in the tokenizer file are cut out first and count as one
token each, which is the library's default for special strings inside a text.

The proof (at most one entry per vocabulary string and merge rule, a size
fixed by the vocabulary) is broadcast; texts stay where they are, nothing is
shuffled.

Edge cases: null and empty texts have 0 bytes and 0 tokens; very long texts
and pre-tokens are counted whole (merging is n log n in the pre-token); null
ids and repeated rows pass through; an empty table gives an empty result.
Other columns pass through; the new column has the name given.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that cuts text into pre-tokens before byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same cuts, tried in the order in which they are likely: no letter or number branch can begin at an apostrophe.
CUT = regex.compile(r" ?\p{L}+| ?\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A blank beside other white space, or at the end: there a pre-token may hold several blanks.
RUN = regex.compile(r" \s|\s | $")

CACHE = 400_000
SHORT = 48


def byte_of_char() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the other bytes follow from U+0100 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in own}
    rest = [b for b in range(256) if b not in set(own)]
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


#: Token numbers fit in so many bits; a pair's key is both numbers, a rule is its rank and the number it makes.
ID_BITS = 20
_ID = (1 << ID_BITS) - 1
_NONE = 1 << 62


@dataclass
class Proof:
    """Merge rules by pair, the numbers of single bytes, the proved strings and the special strings."""
    rules: dict[int, int]
    byte_ids: list[int]
    whole: frozenset[str] = frozenset()
    special: tuple[str, ...] = ()


def merge_short(proof: Proof, piece: bytes) -> int:
    """Tokens of a short pre-token: apply the lowest-ranked rule, leftmost first, until none applies."""
    rule, byte_ids = proof.rules.get, proof.byte_ids
    ids = [byte_ids[b] for b in piece]
    due = [rule(a << ID_BITS | b, _NONE) for a, b in zip(ids, ids[1:])]
    while due:
        first = min(due)
        if first == _NONE:
            break
        i = due.index(first)
        ids[i] = first & _ID
        del ids[i + 1], due[i]
        if i:
            due[i - 1] = rule(ids[i - 1] << ID_BITS | ids[i], _NONE)
        if i < len(due):
            due[i] = rule(ids[i] << ID_BITS | ids[i + 1], _NONE)
    return len(ids)


def merge_long(proof: Proof, piece: bytes) -> int:
    """The same with a heap of due rules over a linked list."""
    n, rule = len(piece), proof.rules.get
    ids = [proof.byte_ids[b] for b in piece]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rule(ids[i] << ID_BITS | ids[i + 1]))]
    heapq.heapify(heap)
    left = n
    while heap:
        made, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = made & _ID, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        left -= 1
        for x in (before[i], i):
            y = after[x] if x >= 0 else n
            if y < n and (r := rule(ids[x] << ID_BITS | ids[y])):
                heapq.heappush(heap, (r, x, ids[x], ids[y]))
    return left


def merged(proof: Proof, piece: bytes) -> int:
    return merge_short(proof, piece) if len(piece) <= SHORT else merge_long(proof, piece)


def prove(path: str) -> Proof:
    """Read a byte-level BPE tokenizer file and prove its whole strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, raw = spec["model"], byte_of_char()
    if model["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"]:
        raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
    number = model["vocab"]
    if max(number.values(), default=0) > _ID:
        raise ValueError(f"{path}: more than {_ID} tokens")
    rules = {}
    for rank, pair in enumerate(model["merges"], 1):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        rules[number[a] << ID_BITS | number[b]] = rank << ID_BITS | number[a + b]
    byte_ids = [0] * 256
    for char, b in raw.items():
        byte_ids[b] = number[char]
    special = tuple(sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True))
    proof, whole = Proof(rules, byte_ids, special=special), set()
    for name in number:
        if name in special:
            continue
        piece = bytes(raw[c] for c in name)
        try:
            text = piece.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if CUT.findall(text) == [text] and merged(proof, piece) == 1:
            whole.add(text)
    proof.whole = frozenset(whole)
    return proof


class _Remember(dict):
    """Counts asked for before; ``find`` gives those that are not known.

    At most ``2 * CACHE`` keys of at most ``SHORT`` characters are held: the younger half is consulted first,
    and when it is full it becomes the older half.
    """

    def __init__(self, find: Callable[[str], int]):
        super().__init__()
        self.find, self.older = find, {}

    def __missing__(self, key: str) -> int:
        n = self.older.get(key) or self.find(key)
        if len(key) <= SHORT:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[key] = n
        return n


class Counter:
    """Counts texts; one is kept for each worker and proof, so that what it remembers lasts from task to task.

    A text whose blanks all stand alone between other characters is cut at the blanks first: no pre-token
    crosses such a blank, so the counts of the chunks (blank and following run) add up.
    """

    def __init__(self, proof: Proof):
        self.proof, self.whole = proof, proof.whole.__contains__
        self.rest = _Remember(lambda piece: merged(proof, piece.encode("utf-8")))
        self.chunk = _Remember(lambda run: self.pieces(" " + run))
        self.special = regex.compile("|".join(map(regex.escape, proof.special))) if proof.special else None

    def pieces(self, text: str) -> int:
        """Proved pre-tokens count one each, the rest are merged."""
        found = CUT.findall(text)
        rest = [p for p in found if not self.whole(p)]
        return len(found) - len(rest) + sum(map(self.rest.__getitem__, rest))

    def plain(self, text: str) -> int:
        if RUN.search(text):
            return self.pieces(text)
        first, *runs = text.split(" ")
        return self.pieces(first) + sum(map(self.chunk.__getitem__, runs))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_kept: list[Counter] = []


def counter_of(proof: Proof) -> Counter:
    if not _kept or _kept[0].proof is not proof:
        _kept[:] = [Counter(proof)]
    return _kept[0]


def count_tokens(docs: DataFrame, path: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of each whole text for the tokenizer file at ``path``."""
    shared = docs.sparkSession.sparkContext.broadcast(prove(path))

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = counter_of(shared.value)
        for col in batches:
            yield pa.array([counter.count(t.as_py()) for t in col], type=pa.int64())

    return docs.withColumn(into, count(F.col(text)))
