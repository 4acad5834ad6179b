"""Best-fit packing of tokenised documents into sequences by bin completion.

How pieces can share sequences depends on their lengths alone, so the search runs on the histogram of lengths,
which has at most ``capacity`` entries however large the corpus is. It is a branch and bound: a node completes one
sequence around the longest piece left, its children are the undominated fillings of the sequence's rest and the
numbers of times each is used. The first child is the filling of the greatest worth, where a piece of n tokens is
worth n (1 + steep n / capacity): like waste, but long pieces that are hard to place later count for more. The
others follow by rising waste. A branch is cut when its waste, or the lower bound of what is left, exceeds what a
solution better than the incumbent allows; incumbents are best-fit decreasing of the whole and of the nodes' rests.
Each worth in ``STEEP`` is first followed straight down, then the tree is searched in depth, until the lower
bound is reached, the tree is spent or the one budget, ``work``, is: lengths offered to a filling. The bound comes
back with the patterns, so that what the budget may have cost is known.

The outcome is a short list of patterns with their numbers of uses. Spark does the rest: it tokenises
in map tasks, ranks pieces of equal length in salted groups, and looks up each rank's place in the patterns.
"""

from __future__ import annotations

import json
import logging
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockyard.llm.shared import cut, table

CAPACITY, END = 1024, 2
#: How much more long pieces are worth, by descent; lengths that the search may offer to fillings in all.
STEEP, WORK = (0.4, 0.2, 0.1, 0.8), 600_000
Pattern = tuple[tuple[int, ...], int]
log = logging.getLogger(__name__)


class Encoder:
    """Token ids of a tokenizer file: just those of ``tokenizers``' own encoding without special tokens added.

    A byte-level BPE file whose ids follow its merges, without a normaliser, is encoded by tiktoken with the file's own
    vocabulary, which gives the same ids in less than half the time. Texts that hold the string of an added token, or
    so much white space in a row that tiktoken's pattern gives up, and all other files go to ``tokenizers``.
    """

    #: The pattern of byte-level pre-tokens, written so that it needs no backtracking within a run.
    PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    #: How byte-level BPE writes bytes as characters: those that print stand for themselves, the others follow 255.
    PRINT = [*range(33, 127), *range(161, 173), *range(174, 256)]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        added = [a["content"] for a in told.get("added_tokens") or []]
        self.odd = re.compile("|".join([r"\s{100000}", *map(re.escape, added)]))
        self.fast = self._fast(told)

    def _fast(self, told: dict):
        import tiktoken

        model, pre = told["model"], told["pre_tokenizer"] or {}
        plain = {"add_prefix_space": False, "use_regex": True, "type": "ByteLevel"}
        if told["normalizer"] or model["type"] != "BPE" or any(pre.get(k) != v for k, v in plain.items()):
            return None
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [vocabulary[a + b] for a, b in merges]
        if order != sorted(order) or len(order) + 256 != len(vocabulary):
            return None
        byte = {chr(b): b for b in self.PRINT} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(self.PRINT)))}
        ranks = {bytes(byte[c] for c in token): n for token, n in vocabulary.items()}
        return tiktoken.Encoding("file", pat_str=self.PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.fast is None or self.odd.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    end: int = END,
    text: str = "text",
    key: str = "doc_id",
    with_ids: bool = False,
) -> DataFrame:
    """Tokenise and cut: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``).

    A document is its ids and then ``end``; a longer one than ``capacity`` is cut so that only its first piece
    may be shorter. A null or empty text is the id ``end`` alone. Whole texts are read, whatever their length. Rows
    without an id and repeated rows are each cut on their own; an empty table gives an empty result; other columns
    are not read, so their names can't clash.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).ids
        for batch in batches:
            rows = []
            for k, t in zip(batch["id"], batch["text"]):
                ids = np.array([*encode(t), end], dtype="<u4")
                first = len(ids) % capacity or capacity
                for n, at in enumerate([0, *range(first, len(ids), capacity)]):
                    own = ids[at : first if n == 0 else at + capacity]
                    row = (k, n, at, len(own), zlib.crc32(own.tobytes()))
                    rows.append((*row, own.astype("int64")) if with_ids else row)
            yield pd.DataFrame(rows, columns=names)

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return rows.mapInPandas(made, schema).withColumnRenamed("id", key)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram: like bins are handled together."""
    bins: dict[int, list[list]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in bins if r >= length), default=None)
            if room is None:
                fit = capacity // length
                whole, rest = divmod(left, fit)
                for n, uses in ((fit, whole), (rest, 1)):
                    if n and uses:
                        bins.setdefault(capacity - n * length, []).append([(length,) * n, uses])
                break
            like = bins[room]
            pattern, uses = like.pop()
            if not like:
                del bins[room]
            n = min(room // length, left)
            full = min(uses, left // n)
            if full:
                bins.setdefault(room - n * length, []).append([pattern + (length,) * n, full])
            if uses > full:
                bins.setdefault(room, []).append([pattern, uses - full])
            left -= full * n
            if not full:  # unreachable while n <= left; kept as a guard against an endless loop
                raise AssertionError("no progress")
    return [(p, uses) for like in bins.values() for p, uses in like]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and, over thresholds k, the bound of pieces too large to share a sequence."""
    n = np.zeros(capacity + 2)
    for length, c in counts.items():
        n[length] = c
    number, volume = np.cumsum(n), np.cumsum(n * np.arange(capacity + 2))
    half = capacity // 2
    k = np.arange(half + 1)
    big = number[capacity] - number[capacity - k]
    middle = number[capacity - k] - number[half]
    free = middle * capacity - (volume[capacity - k] - volume[half])
    small = volume[half] - np.where(k > 0, volume[k - 1], 0)
    return int(max((big + middle + np.ceil(np.maximum(0, small - free) / capacity)).max(), math.ceil(volume[capacity] / capacity)))


class Budget:
    """What is left of the search's work."""

    def __init__(self, work: int):
        self.left = work


def worthiest(room: int, left: dict[int, int], worth: np.ndarray, budget: Budget) -> tuple[int, ...]:
    """The filling of ``room`` of the greatest worth: a knapsack over the lengths left, as often as they are left."""
    lots = []
    for n, c in left.items():
        if n <= room:
            c, k = min(c, room // n), 1
            while c:
                lots.append((n, min(k, c)))
                c -= lots[-1][1]
                k *= 2
    budget.left -= len(lots)
    best, taken = np.zeros(room + 1), np.zeros((len(lots), room + 1), dtype=bool)
    for i, (n, k) in enumerate(lots):
        more = best[: -n * k] + k * worth[n]
        taken[i, n * k :] = more > best[n * k :] + 1e-9
        np.maximum(best[n * k :], more, out=best[n * k :])
    at, out = int(best.argmax()), []
    for i in range(len(lots) - 1, -1, -1):
        if taken[i, at]:
            n, k = lots[i]
            out += [n] * k
            at -= n * k
    return tuple(sorted(out, reverse=True))


def fillings(room: int, left: dict[int, int], budget: Budget) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room`` by rising waste, longer pieces first among equals.

    A filling is dominated if a piece that is left could take the place of one or more of its pieces and the sum
    would grow, or stay with fewer pieces: the rest then finds room wherever that piece did. Sums are whole numbers,
    so sets of sums are bits of one number, shifted to add a length.
    """
    lengths = [n for n in sorted(left, reverse=True) if n <= room]
    if not lengths:
        yield ()
        return
    whole = (1 << (room + 1)) - 1
    reach = [1] * (len(lengths) + 1)  # sums that the lengths from here on can make
    for i in range(len(lengths) - 1, -1, -1):
        n, bits, k = lengths[i], reach[i + 1], 1
        c = min(left[n], room // n)
        while c:
            bits |= (bits << n * min(k, c)) & whole
            c -= min(k, c)
            k *= 2
        reach[i] = bits

    def below(bits: int, waste: int) -> int:
        """Sums that are at most ``waste`` smaller than one of ``bits``."""
        done = 1
        while done <= waste:
            step = min(done, waste + 1 - done)
            bits |= bits >> step
            done += step
        return bits

    def search(i: int, rest: int, chosen: tuple, one: int, several: int, free: int, waste: int) -> Iterator[tuple[int, ...]]:
        """``one`` and ``several``: sums of one and of more pieces chosen; ``free``: lengths of which some are left."""
        if not rest:
            yield chosen
            return
        for j in range(i, len(lengths)):
            budget.left -= 1
            if budget.left <= 0 or not reach[j] >> rest & 1:
                return
            n = lengths[j]
            options, now = [], (rest, chosen, one, several, free)
            for k in range(1, min(left[n], rest // n) + 1):
                got, grown, single, more, still = now
                more |= (single << n) | (more << n)
                single |= 1 << n
                still &= ~(1 << n) if k == left[n] else -1
                if more & below(still, waste) or (waste and single & below(still >> 1, waste - 1)):
                    break
                now = (got - n, (*grown, n), single, more, still)
                options.append(now)
            for got, *state in reversed(options):
                yield from search(j + 1, got, *state, waste)

    longest = lengths[0]
    for s in range(room, longest, -1):
        yield from search(0, s, (), 0, 0, sum(1 << n for n in lengths), room - s)
        if budget.left <= 0:
            break
    yield (longest,)


class Search:
    """Bin completion on a histogram, from best-fit decreasing as the first incumbent."""

    def __init__(self, counts: dict[int, int], capacity: int, work: int):
        self.capacity, self.budget = capacity, Budget(work)
        self.counts = {n: c for n, c in sorted(counts.items(), reverse=True) if c}
        self.total = sum(n * c for n, c in self.counts.items())
        self.bound = lower_bound(self.counts, capacity)
        self.best = best_fit(self.counts, capacity)
        self.uses = sum(u for _, u in self.best)

    def offer(self, used: int, path, left: dict[int, int]) -> None:
        """Best-fit of what is left, after the patterns of ``path``, as an incumbent."""
        tail = best_fit(left, self.capacity)
        if (uses := used + sum(u for _, u in tail)) < self.uses:
            self.uses, self.best = uses, tail
            while path:
                self.best.append(path[0])
                path = path[1]

    def children(self, node, worth: np.ndarray, straight: bool) -> Iterator:
        """A node: what is left (longest first), sequences used, their waste, patterns so far (linked backwards), and the
        fillings around the longest piece that other branches cover."""
        left, used, waste, path, others = node
        longest = next(iter(left))
        rest = {n: c - (n == longest) for n, c in left.items() if c > (n == longest)}
        first = worthiest(self.capacity - longest, rest, worth, self.budget)
        seen = set(others)

        def ordered() -> Iterator[tuple[int, ...]]:
            yield first
            if not straight:
                yield from fillings(self.capacity - longest, rest, self.budget)

        for f in ordered():
            lost = self.capacity - longest - sum(f)
            if waste + lost > (self.uses - 1) * self.capacity - self.total:
                if f is first and not straight:
                    continue
                return  # the waste only grows
            if f in seen:
                continue
            pattern = (longest, *f)
            most = min(left[n] // pattern.count(n) for n in set(pattern))
            for times in range(most, 0, -1):
                after = dict(left)
                for n in set(pattern):
                    after[n] -= times * pattern.count(n)
                    if not after[n]:
                        del after[n]
                same = frozenset(seen | {f}) if times < most else frozenset()
                yield after, used + times, waste + times * lost, ((pattern, times), path), same
                if straight:
                    return
            seen.add(f)

    def descend(self, steep: float, straight: bool) -> None:
        """Search the tree in depth; ``straight`` follows first children alone."""
        x = np.arange(self.capacity + 1) / self.capacity
        worth = x * (1 + steep * x)
        stack = [self.children((self.counts, 0, 0, None, frozenset()), worth, straight)] if self.counts else []
        while stack and self.uses > self.bound and self.budget.left > 0:
            node = next(stack[-1], None)
            if node is None:
                stack.pop()
                continue
            left, used, waste, path, _ = node
            self.budget.left -= len(left) + 1
            if waste > (self.uses - 1) * self.capacity - self.total or used + lower_bound(left, self.capacity) >= self.uses:
                continue
            if not left or len(stack) % 16 == 0 or len(left) < 32:
                self.offer(used, path, left)
            if left:
                stack.append(self.children(node, worth, straight))


def complete(counts: dict[int, int], capacity: int, work: int = WORK) -> tuple[list[Pattern], int]:
    """Patterns with their numbers of uses that hold all pieces of the histogram, and a lower bound of the uses."""
    search = Search(counts, capacity, work)
    for steep in STEEP:
        search.descend(steep, True)
    search.descend(STEEP[0], False)
    return search.best, search.bound


def pack(parts: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", work: int = WORK) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    Each sequence holds its pieces gapless from 0. Repeated pieces and pieces without an id are packed each on their
    own; an empty input gives an empty result. Other columns stay; ``sequence_id`` and ``offset`` replace columns of
    these names. How many sequences there are, and the lower bound, goes to the log.
    """
    parts = cut(parts)
    sizes = parts.groupBy("length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in sizes.collect()}  # at most ``capacity`` rows
    patterns, bound = complete(histogram, capacity, work)
    log.info("%d sequences, lower bound %d", sum(u for _, u in patterns), bound)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for pattern, uses in patterns:
        at = 0
        for n in pattern:
            slots.setdefault(n, []).append((uses, base, at))
            at += n
        base += uses
    places = {}
    for n, own in slots.items():
        u, b, o = (np.array(x, dtype="int64") for x in zip(*own))
        places[n] = (np.cumsum(u) - u, b, o)

    @F.pandas_udf(T.StructType([T.StructField("s", T.LongType()), T.StructField("o", T.LongType())]))
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s, o = np.zeros(len(length), dtype="int64"), np.zeros(len(length), dtype="int64")
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for n in np.unique(lengths):
            mine = np.flatnonzero(lengths == n)
            starts, bases, offsets = places[int(n)]
            at = np.searchsorted(starts, ranks[mine], side="right") - 1
            s[mine], o[mine] = bases[at] + ranks[mine] - starts[at], offsets[at]
        return pd.DataFrame({"s": s, "o": o})

    # Ranks within a length: a salt for each root of its number of pieces keeps groups small, and counts by length and
    # salt, as many again, say where each group begins. The salt follows the row's place in the checkpoint.
    row = F.struct(*[F.col(c) for c in parts.columns])
    own = parts.select(row.alias("_p"), F.col("length").alias("_l"), F.monotonically_increasing_id().alias("_row"))
    salts = sizes.select(F.col("length").alias("_l"), F.ceil(F.sqrt("n") / 4).alias("_salts"))
    salted = own.join(F.broadcast(salts), "_l").withColumn("_salt", F.pmod(F.xxhash64("_row"), "_salts"))
    groups = salted.groupBy("_l", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_l").orderBy("_salt")) - F.col("_n")
    begins = groups.select("_l", "_salt", before.alias("_before"))
    order = Window.partitionBy("_l", "_salt").orderBy("_row")
    ranked = salted.withColumn("_rank", F.row_number().over(order) - 1).join(begins, ["_l", "_salt"])
    put = ranked.withColumn("_place", place("_l", F.col("_before") + F.col("_rank")))
    kept = [F.col("_p")[c].alias(c) for c in parts.columns if c not in ("sequence_id", "offset")]
    return put.select(*kept, F.col("_place.s").alias("sequence_id"), F.col("_place.o").alias("offset"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
