"""Phrase collocations by Rabin-Karp fingerprints.

Texts are lower-cased (A to Z), split into pieces and words. A task takes its texts in lots of about ``LOT`` words of all
languages, numbers the words of the lot and hashes every n-gram at once with prefix polynomials modulo 2^64: with
P[i] the sum of code[j] * B^j for j < i, the polynomial of the words i to i + n - 1 is (P[i + n] - P[i]) / B^i.

Pass 1 counts fingerprints only: each lot hands on its distinct fingerprints, sorted and cut into ranges, as packed
arrays; a range is summed in one task. Two phrases with one fingerprint can only make a count too high, so a phrase
whose fingerprint counts less than ``least`` is infrequent for certain. The fingerprints that are left set bits of a map
of at most 2^``MAP_BITS`` bits, whatever the corpus: a fuller map lets more through, it loses nothing.

Pass 2 hashes the same n-grams; those the map lets through are grouped by fingerprint, each with a pointer to its first
occurrence in the lot. Every occurrence is compared with the words at that pointer, collisions are told apart, and only
then a phrase is written out, with its count. So counts are of texts, exactly; scores are computed on whole numbers.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dockyard.llm.shared import cut, table

#: Words of a lot; fingerprints of a range, about; bits of the map at most, and for each frequent fingerprint.
LOT, RANGE, MAP_BITS, BITS_EACH = 1_000_000, 2_000_000, 28, 16
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Ends pieces and texts; no byte of UTF-8.
END = b"\xff"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + 10 * END)


def split(text: str) -> list[bytes]:
    """Words, and ``END`` where a piece ends."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).replace(END, b" " + END + b" ").split(b" ")


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (one to one)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """B^j and B^-j modulo 2^64, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n, b, dtype=np.uint64)], dtype=np.uint64) for b in (BASE, INVERSE))
        return self.up[:n], self.down[:n]


def lots(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[list[bytes], dict[str, np.ndarray]]]:
    """The words of a lot by number (0 is ``END``) and, by language, its texts as numbers, each with an ``END`` behind."""

    def fresh():
        return defaultdict(count(1).__next__, {END: 0, b"": -1}), defaultdict(list)

    numbers, held = fresh()
    total = 0
    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"]):
            words = split(text)
            words.append(END)
            ids = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
            held[lang].append(ids[ids >= 0])
            total += len(words)
            if total >= size:
                yield _words(numbers), {k: np.concatenate(v) for k, v in held.items()}
                (numbers, held), total = fresh(), 0
    if total:
        yield _words(numbers), {k: np.concatenate(v) for k, v in held.items()}


def _words(numbers: dict[bytes, int]) -> list[bytes]:
    out = [w for w, i in numbers.items() if i >= 0]
    assert numbers[out[-1]] == len(out) - 1
    return out


def fingerprints(words: list[bytes], by_lang: dict[str, np.ndarray], longest: int, powers: Powers):
    """Yields language, n, the position of each n-gram and its fingerprint."""
    codes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
    for lang, ids in by_lang.items():
        up, down = powers.of(len(ids))
        prefix = np.r_[np.uint64(0), np.cumsum(codes[ids] * up, dtype=np.uint64)]
        ends = np.r_[0, np.cumsum(ids == 0)]
        seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
        for n in range(1, longest + 1):
            if len(ids) >= n:
                at = np.flatnonzero(ends[n:] == ends[:-n])
                poly = (prefix[at + n] - prefix[at]) * down[at]
                yield lang, n, at, mix(poly ^ mix(np.array([(seed + n) % 2**64], dtype=np.uint64)))


def _planes(x: np.ndarray) -> bytes:
    """Sorted numbers by significance of their bytes: those that agree lie together, so blocks compress."""
    return x.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(">u8").ravel().astype(np.uint64)


def phrases(docs: DataFrame, longest: int = 3, least: int = 10, text: str = "text", lang: str = "lang", lot: int = LOT) -> DataFrame:
    """Exact counts of frequent phrases: ``lang`` (null: ``und``), ``k`` (words), ``phrase`` and ``a`` (occurrences).

    Phrases of 1 to ``longest`` words that occur ``least`` times or more, overlaps included, within pieces; one row a
    language with ``k`` 0 and an empty phrase has the number of all its words. Null and empty texts count nothing; texts of
    any length are read whole; repeated rows count each. An empty table gives no rows; other columns are not read.
    """
    if not 1 <= least <= 255:
        raise ValueError("least must be from 1 to 255")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    top = min(MAP_BITS - 3, max(0, math.ceil(math.log2(max(1, longest * chars / 5 / RANGE)))))  # 2^top ranges

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for words, by_lang in lots(batches, lot):
            parts = defaultdict(list)
            for _, size, _, fp in fingerprints(words, by_lang, longest, powers):
                parts[size].append(fp)
            for size in sorted(parts):
                fp, n = np.unique(np.concatenate(parts.pop(size)), return_counts=True)
                n = np.minimum(n, least).astype(np.uint8)  # only whether the sum reaches it matters
                borders = np.searchsorted(fp, np.arange(1 << top, dtype=np.uint64) << np.uint64(64 - top)) if top else np.zeros(1, int)
                out = [(b, _planes(fp[i:j]), n[i:j].tobytes()) for b, (i, j) in enumerate(zip(borders, [*borders[1:], len(fp)])) if j > i]
                yield pd.DataFrame(out, columns=["bucket", "fps", "ns"])

    def frequent(group: pd.DataFrame) -> pd.DataFrame:
        fp, n = np.concatenate([_numbers(x) for x in group["fps"]]), np.concatenate([np.frombuffer(x, np.uint8) for x in group["ns"]])
        order = np.argsort(fp)
        fp = fp[order]
        first = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]])
        kept = fp[first][np.add.reduceat(n[order].astype(np.int64), first) >= least]
        return pd.DataFrame({"bucket": group["bucket"].iloc[:1], "n": [len(kept)], "fps": [_planes(kept)]})

    counts = rows.mapInPandas(counted, "bucket int, fps binary, ns binary")
    known = cut(counts.groupBy("bucket").applyInPandas(frequent, "bucket int, n long, fps binary"))
    total = known.agg(F.sum("n")).first()[0] or 0
    wide = max(top + 3, min(MAP_BITS, math.ceil(math.log2(BITS_EACH * max(1, total)))), 3)
    parts = min(top, 10)

    def bits(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1 << (wide - parts), dtype=bool)
        for raw in group["fps"]:
            own[(_numbers(raw) >> np.uint64(64 - wide)).astype(np.int64) & (len(own) - 1)] = True
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(own).tobytes()]})

    # At most 2^parts rows, 2^MAP_BITS bits in all.
    made = known.groupBy(F.shiftright("bucket", top - parts).alias("part")).applyInPandas(bits, "part int, bits binary").collect()
    width = 1 << (wide - parts - 3) if wide - parts >= 3 else 1
    whole = np.zeros(width << parts, dtype=np.uint8)
    for r in made:
        whole[r.part * width : (r.part + 1) * width] = np.frombuffer(r.bits, np.uint8)
    sent = spark.sparkContext.broadcast(whole)

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, map_ = Powers(), sent.value
        for words, by_lang in lots(batches, lot):
            names = ["lang", "k", "phrase", "a"]
            yield pd.DataFrame([(k, 0, "", int((ids > 0).sum())) for k, ids in by_lang.items()], columns=names)
            for tag, n, at, fp in fingerprints(words, by_lang, longest, powers):
                bit = fp >> np.uint64(64 - wide)
                hit = (map_[(bit >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8))) & 1 > 0
                found = occurrences(by_lang[tag], n, at[hit], fp[hit])
                yield pd.DataFrame([(tag, n, b" ".join([words[i] for i in p]).decode("utf-8", "surrogatepass"), c) for p, c in found], columns=names)

    summed = rows.mapInPandas(written, "lang string, k int, phrase string, a long").groupBy("lang", "k", "phrase").agg(F.sum("a").alias("a"))
    return summed.where((F.col("k") == 0) | (F.col("a") >= least))


def occurrences(ids: np.ndarray, n: int, at: np.ndarray, fp: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Phrases (as numbers of words) and their counts, from positions and fingerprints.

    Of each fingerprint the first position is the pointer: all others are compared with its words. Where one differs, the
    phrases that share the fingerprint are counted apart.
    """
    if not len(at):
        return []
    order = np.argsort(fp, kind="stable")
    at, fp = at[order], fp[order]
    first = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]])
    counts = np.diff(np.r_[first, len(fp)])
    found = np.stack([ids[at + j] for j in range(n)], axis=1)
    same = (found == np.repeat(found[first], counts, axis=0)).all(1)
    right = np.logical_and.reduceat(same, first)
    out = list(zip(map(tuple, found[first[right]].tolist()), counts[right].tolist()))
    for i, c in zip(first[~right], counts[~right]):
        out += Counter(map(tuple, found[i : i + c].tolist())).items()
    return out


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, cover: int = 50, top: int = 2000, **names) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language by the score of their weakest cut.

    With a occurrences, l of the words before a cut and r of those behind it, a cut's score is 1,000,000 a^2 / (l r), rounded
    down; the lowest counts, and the first such cut. A phrase is dropped if a longer frequent one holds it and occurs at
    least ``cover`` percent as often. Columns ``lang``, ``rank`` (from 1; by score and a falling, then by the bytes
    of the phrase), ``phrase``, ``a``, ``l``, ``r``, ``n`` (all words of the language) and ``score``. Null, empty and
    very long texts, repeated rows and empty tables: see ``phrases``.
    """
    found = cut(phrases(docs, longest, least, **names))
    own = found.where("k >= 2").select("lang", "k", "phrase", "a")
    words, dec = F.split("phrase", " "), "decimal(14,0)"
    cuts = own.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "a", "j",
        F.array_join(F.slice(words, F.lit(1), F.col("j")), " ").alias("before"),
        F.array_join(F.slice(words, F.col("j") + 1, F.col("k")), " ").alias("behind"),
    )
    one = found.where("k >= 1")
    met = cuts.join(one.select("lang", F.col("phrase").alias("before"), F.col("a").alias("l")), ["lang", "before"])
    met = met.join(one.select("lang", F.col("phrase").alias("behind"), F.col("a").alias("r")), ["lang", "behind"])
    score = F.expr(f"(cast(a as {dec}) * cast(a as {dec}) * 1000000bd) div (cast(l as {dec}) * cast(r as {dec}))")
    weakest = F.min(F.struct(score.alias("score"), "j", "l", "r")).alias("w")
    scored = met.groupBy("lang", "phrase").agg(F.first("a").alias("a"), weakest).select("lang", "phrase", "a", "w.l", "w.r", "w.score")
    inner = F.explode(F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"))
    within = own.where("k >= 3").select("lang", "a", inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(within, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < cover * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = found.where("k = 0").select("lang", F.col("a").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
o AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS ks(k)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS a FROM o GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
cuts AS (SELECT c.*, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS before,
                array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS behind
         FROM c, (VALUES (1), (2)) AS js(j) WHERE j < k),
s AS (SELECT cuts.lang, cuts.phrase, cuts.k, cuts.a, j, x.a AS l, y.a AS r,
             ((1000000::HUGEINT * cuts.a * cuts.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
      FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = before JOIN f y ON y.lang = cuts.lang AND y.phrase = behind),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, phrase, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '),
                                          array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS part FROM c WHERE k = 3),
kept AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM longer WHERE longer.lang = b.lang AND part = b.phrase AND 100 * longer.a >= 50 * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
