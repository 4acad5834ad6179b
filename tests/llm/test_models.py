"""Toxicity, mixing, packing and the pipeline on small made tables."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from dockyard.llm import mixing, packing, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
BAD = ["vilefoo", "vilebar", "grotmus", "grotnix"]


@pytest.fixture(scope="module")
def corpus(spark):
    random.seed(5)
    vocabulary = {lang: [lang + "".join(random.choice("abcdefghij") for _ in range(random.randint(1, 5))) for _ in range(400)] for lang in ("en", "de")}
    docs, labels = [], []
    for i in range(700):
        lang = "en" if i % 3 else "de"
        words = [random.choice(vocabulary[lang]) for _ in range(random.randint(20, 90))]
        toxic, quality = int(i % 5 == 0), int(i % 4 > 0)
        if toxic:
            for _ in range(random.randint(2, 5)):
                words.insert(random.randrange(len(words)), random.choice(BAD))
        if not quality:
            words = [w.upper() + "x!!" for w in words]
        text = " ".join(words)
        docs.append((i, text, lang, f"src{i % 7}", len(text)))
        if i % 2 or toxic:
            labels.append((i, quality, toxic))
    docs += [(1000, None, "en", "src0", None), (1001, "", None, None, 0), (1002, "call 212-555-0100 " + " ".join(docs[1][1].split()[::-1]), "en", "src1", 9), (1003, docs[2][1], "en", "src1", 9)]
    docs += [(None, "no id here", "en", "src2", 10), docs[3], docs[3]]
    labels += [(None, 1, 0), (5, None, None), (1, 1, 0)]
    return spark.createDataFrame(docs, DOCS).cache(), spark.createDataFrame(labels, LABELS).cache()


def test_toxicity_held_out(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    truth = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    held = out.join(truth, "doc_id").where((toxicity.fold(F.col("doc_id")) == 0) & F.col("toxic").isNotNull()).dropDuplicates(["doc_id"]).collect()
    hits = Counter((r.toxic, r.predicted) for r in held)
    assert hits[1, 1] >= 0.85 * (hits[1, 1] + hits[1, 0]) and hits[0, 1] <= 0.05 * (hits[0, 0] + hits[0, 1]), hits
    empty = out.where("doc_id in (1000, 1001)").collect()
    assert [r.predicted for r in empty] == [0, 0]


def test_toxicity_ignores_held_out_labels(spark, corpus):
    docs, labels = corpus
    changed = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(docs, x) for x in (labels, changed))
    assert a.words == b.words and np.allclose(a.weights, b.weights)


def plain_scores(docs, labels):
    """The models written out: dictionaries over all documents, nothing distributed."""
    known = {}
    for r in labels:
        if r.doc_id is not None and r.toxic is not None:
            known[r.doc_id] = max(known.get(r.doc_id, 0), int(r.toxic > 0))
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    cut = lambda t: toxicity.WORD.findall(t.lower()) if t else []
    least = {}
    for r in docs:
        if known.get(r.doc_id) is not None and fold(r.doc_id):
            at = (r.text, known[r.doc_id])
            least[at] = min(least.get(at, r.doc_id), r.doc_id)
    used = {(t, y, i) for (t, y), i in least.items()}
    fitted, curve = [(cut(t), y) for t, y, i in used if fold(i) < 4], [(cut(t), y) for t, y, i in used if fold(i) == 4]
    tokens, files = [Counter(), Counter(), Counter()], [Counter(), Counter(), Counter()]
    n = Counter(y for _, y in fitted)
    for w, y in fitted:
        for kind, terms in ((0, [x[:4] for x in set(w)]), (1, w), (2, list(zip(["", *w], w)))):
            tokens[kind].update((y, x) for x in terms)
            files[kind].update((y, x) for x in set(terms))

    def telling(kind, bar):
        out = set()
        for x in {x for _, x in files[kind]}:
            d = [files[kind][y, x] for y in (0, 1)]
            g = sum(2 * o * np.log(o * sum(n.values()) / (k * n[y])) for y in (0, 1) for o, k in ((d[y], sum(d)), (n[y] - d[y], sum(n.values()) - sum(d))) if o)
            if g >= bar:
                out.add(x)
        return out

    df = Counter(x for (_, x), c in files[1].items() for _ in range(c))
    bar = max(12.0, 2 * np.log(max(1, sum(c >= 5 for c in df.values()))))
    words, prefixes, pairs = telling(1, bar), telling(0, bar), telling(2, 3 * bar)
    every = {x for r in docs for x in cut(r.text)}
    begin = Counter(x[:4] for x in every)

    class Side:
        def __init__(self, y):
            own = lambda c: max(c - 0.75, 0.0)
            kinds = {x for c, x in tokens[1] if c == y}
            starts, stands = Counter(x[:4] for x in kinds), Counter(w for c, (_, w) in tokens[2] if c == y)
            self.p = {x: own(starts[x]) / len(kinds) for x in prefixes}
            self.w = {x: own(stands[x]) / sum(stands.values()) for x in words}
            after = Counter()
            for (c, (v, _)), k in tokens[2].items():
                after[v] += k * (c == y)
            self.vw = {(v, w): own(tokens[2][y, (v, w)]) / max(1, after[v]) for v, w in pairs}
            rest = lambda q: max(1e-6, 1 - sum(q))
            self.lp, self.lw = rest(self.p.values()), rest(self.w.values())
            self.lv = {v: rest(q for (u, _), q in self.vw.items() if u == v) for v, _ in pairs}

        def prob(self, v, w):
            p = self.p.get(w[:4], 0.0) + self.lp * max(1, begin[w[:4]]) / len(every)
            q = self.w.get(w, 0.0) + self.lw * p / max(1, begin[w[:4]])
            return self.vw.get((v, w), 0.0) + self.lv[v] * q if v in self.lv else q

    sides = [Side(0), Side(1)]
    mean = lambda w: sum(np.log(sides[1].prob(v, x) / sides[0].prob(v, x)) for v, x in zip(["", *w], w)) / (100 + len(w))
    seen = sorted((mean(w), y) for w, y in curve)
    x, y = np.array([a for a, _ in seen]), np.array([float(b) for _, b in seen])
    z = np.c_[(x - x.mean()) / (x.std() + 1e-9), np.ones(len(x))]
    a = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ a))
        a -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2), z.T @ (p - y) + 0.1 * a)
    a[1] = min(a[1], -a[0] * (1e-3 - x.mean()) / (x.std() + 1e-9))
    return lambda text: 1 / (1 + np.exp(-(a[0] * (mean(cut(text)) - x.mean()) / (x.std() + 1e-9) + a[1]))), pairs


def test_toxicity_equals_plain_models(spark, corpus):
    docs, labels = corpus
    more = spark.createDataFrame([(4000 + i, f"quiet words before vilefoo grotmus stand{i} here", "en", "s", 1) for i in range(150)], DOCS)
    docs, labels = docs.unionByName(more), labels.unionByName(spark.createDataFrame([(4000 + i, 1, 1) for i in range(150)], LABELS))
    rows = docs.collect()
    plain, pairs = plain_scores(rows, labels.collect())
    assert pairs
    got = {(r.doc_id, r.text): r.s for r in docs.select("doc_id", "text", toxicity.scorer(toxicity.fit(docs, labels))(F.col("text")).alias("s")).collect()}
    assert max(abs(got[r.doc_id, r.text] - plain(r.text)) for r in rows) < 1e-9


def test_toxicity_without_a_class(spark, corpus):
    docs, labels = corpus
    few = docs.limit(5)
    assert {r.score for r in toxicity.score(few, toxicity.fit(few, labels.where("toxic = 0"))).collect()} == {0.0}
    assert {r.score for r in toxicity.score(few, toxicity.fit(few, labels.limit(0))).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_mixing(spark, corpus):
    docs, labels = corpus
    targets = {"de-0": 0.05, "de-1": 0.45, "en-0": 0.1, "en-1": 0.4}
    out = mixing.mix(docs, mixing.labelled_domains(docs, labels), targets).cache()
    assert out.count() == docs.count() and out.where("rate < 0 or rate is null or copies < 0").count() == 0
    rows = out.collect()
    total = sum(r.tokens for r in rows)
    for d, share in targets.items():
        got = sum(r.tokens * r.posteriors[d] * r.rate for r in rows)
        assert abs(got / total - share) < 0.02, (d, got / total)
    assert all(abs(sum(r.posteriors.values()) - 1) < 1e-9 for r in rows)
    lang = {r.doc_id: r.lang for r in docs.collect()}
    right = [max(r.posteriors, key=r.posteriors.get)[:2] == lang[r.doc_id] for r in rows if r.tokens > 5 and r.doc_id is not None]
    assert np.mean(right) > 0.98
    assert sum(r.tokens * r.copies for r in rows) == pytest.approx(sum(r.tokens * r.rate for r in rows), rel=0.1)
    kept = mixing.mix(docs, mixing.labelled_domains(docs, labels), targets, budget=1.5, least=1.0)
    assert kept.where("rate < 1 or copies < 1").count() == 0
    assert mixing.mix(docs.limit(0), mixing.labelled_domains(docs, labels), targets).count() == 0
    assert mixing.mix(docs, mixing.labelled_domains(docs, labels.limit(0)), targets).count() == docs.count()


def test_rates_agree_with_plain_projected_gradient(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.3] * 3, 200)
    t = rng.integers(0, 300, 200).astype(float)
    df = spark.createDataFrame([(float(a), *map(float, b)) for a, b in zip(t, p)], "tokens double, p0 double, p1 double, p2 double")
    want = np.array([0.6, 0.3, 0.1])
    rated, (before, after) = mixing.rates(df, list(want), close=0.0, rounds=25)
    start = (p * t[:, None]).sum(0)
    r = np.ones(200)
    for _ in range(25):
        now = (p * (t * r)[:, None]).sum(0)
        r = np.maximum(0, r - ((p @ ((now - want * t.sum()) / start)) + 0.05 * (r - 1)) / 1.05)
    got = sorted((x.tokens, x.p0, x.rate) for x in rated.collect())
    assert np.allclose([g[2] for g in got], [x[2] for x in sorted(zip(t, p[:, 0], r))], atol=1e-9)
    assert np.allclose(before, start)


@pytest.mark.parametrize("want,least,budget", [([0.6, 0.3, 0.1], 0.0, 1.0), ([0.9, 0.05, 0.05], 0.0, 1.0), ([0.5, 0.25, 0.25], 1.0, 2.0)])
def test_rates_in_the_gram_metric(spark, want, least, budget):
    """The steps that the query takes, against the same steps on arrays, and the totals against the targets."""
    rng = np.random.default_rng(6)
    p, t = rng.dirichlet([0.3] * 3, 400), rng.integers(0, 300, 400).astype(float)
    df = spark.createDataFrame([(i, float(a), *map(float, b)) for i, (a, b) in enumerate(zip(t, p))], "i int, tokens double, p0 double, p1 double, p2 double")
    rate, (before, after), off = mixing.reach(df, want, budget=budget, least=least, every=2)
    got = np.array([x.r for x in df.select("i", rate.alias("r")).orderBy("i").collect()])
    assert off <= 1e-3 and got.min() >= least and np.allclose(got[t == 0], 1.0)
    goal = np.array(want) * t.sum() * budget
    assert np.allclose((p * (t * got)[:, None]).sum(0), after) and (np.abs(after - goal) <= 1e-3 * goal).all()
    whole = (p * t[:, None]).T @ p
    gram, r = whole, np.ones(400)
    cost = lambda s: (s - goal) @ np.linalg.inv(whole) @ (s - goal)
    for _ in range(100):
        s = p.T @ (t * r)
        if (np.abs(s - goal) <= 1e-3 * goal).all():
            break
        y, a = np.linalg.solve(gram + 1e-6 * whole, s - goal), 1.0
        while cost(p.T @ (t * np.maximum(least, r - a * (p @ y)))) >= cost(s) * (1 - 1e-4 * a):
            a /= 2
        r = np.maximum(least, r - a * (p @ y))
        gram = (p * (t * (r > least))[:, None]).T @ p
    assert np.allclose(got[t > 0], r[t > 0], atol=1e-6)
    if (r > least).all():  # nothing at its bound: no rates are nearer to 1 that have these totals
        assert np.allclose(r - 1, p @ np.linalg.lstsq(p, r - 1, rcond=None)[0], atol=1e-9)


def test_mixing_reaches_each_target(spark, corpus, caplog):
    docs, labels = corpus
    for targets in ({"de-0": 0.005, "de-1": 0.195, "en-0": 0.015, "en-1": 0.785}, {"de-0": 0.3, "de-1": 0.3, "en-0": 0.3, "en-1": 0.1}):
        rows = mixing.mix(docs, mixing.labelled_domains(docs, labels), targets).collect()
        total = sum(r.tokens for r in rows)
        for d, share in targets.items():
            got = sum(r.tokens * r.posteriors[d] * r.rate for r in rows) / total
            assert abs(got / share - 1) < 2e-3, (d, got)
    assert not caplog.records
    mixing.mix(docs, mixing.labelled_domains(docs, labels), {"de-0": 0.01, "en-1": 0.98, "fr-1": 0.01}, budget=1.0, least=1.0)
    assert "fr-1" in caplog.text and "not reached" in caplog.text


def test_encoder_equals_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    texts = ["a  b\n\n c\t d", "it's I'LL  we've ²½ ٣ x y 你好  ", "   ", "é" * 50, "x" * 5000, "\x1c x \x85 y", "café naïve \U0001f600!",
             "hello <|endoftext|> x", "<|endoftext|><|endoftext|>", "a<|endoftext", " " * 120_000 + "x", "\n" * 7 + "y \t z\r\n", "don't 'LL 'x '"]
    texts += [k.replace("Ġ", " ") for k in list(whole.get_vocab())[::50]]
    for t in texts:
        assert packing.encoder(path).ids(t) == whole.encode(t, add_special_tokens=False).ids


def test_packing(spark, corpus):
    docs = corpus[0].unionByName(spark.createDataFrame([(2000, "long words here " * 3000, "en", "s", 1)], DOCS))
    parts = packing.pieces(docs, with_ids=True)
    out = packing.pack(parts).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    want = Counter()
    for (k, t), n in texts.items():
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for i, a in enumerate([0, *range(first, len(ids), 1024)]):
            own = ids[a : first if i == 0 else a + 1024]
            want[k, i, a, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())] += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in out)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    bound = packing.lower_bound(Counter(r.length for r in out), 1024)
    assert bound <= len(sequences) <= bound + 1
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0


def test_bin_completion_is_optimal_on_small_cases():
    random.seed(7)

    def best(items, capacity):
        items, answer = sorted(items, reverse=True), len(items)

        def place(i, bins):
            nonlocal answer
            if len(bins) >= answer:
                return
            if i == len(items):
                answer = len(bins)
                return
            for j, room in sorted({r: j for j, r in enumerate(bins)}.items()):
                if j >= items[i]:
                    bins[room] -= items[i]
                    place(i + 1, bins)
                    bins[room] += items[i]
            place(i + 1, [*bins, capacity - items[i]])

        place(0, [])
        return answer

    for _ in range(150):
        items = [random.randint(1, 20) for _ in range(random.randint(1, 9))]
        found, bound = packing.complete(Counter(items), 20)
        assert bound <= best(items, 20)
        assert sum(u for _, u in found) == best(items, 20), items
        used = Counter()
        for pattern, u in found:
            assert sum(pattern) <= 20
            for n in pattern:
                used[n] += u
        assert used == Counter(items)
    assert packing.complete({}, 20) == ([], 0)


def test_bin_completion_beats_best_fit():
    """Where best-fit decreasing wastes sequences the search comes down to the lower bound."""
    lengths = Counter(np.random.default_rng(3).integers(100, 700, 500).tolist())
    found, bound = packing.complete(lengths, 1024, 300_000)
    assert bound == sum(u for _, u in found) < sum(u for _, u in packing.best_fit(lengths, 1024))
    many = {n: c * 10**9 for n, c in lengths.items()}  # counts of a large corpus change nothing in the time it takes
    found, bound = packing.complete(many, 1024, 300_000)
    used = Counter()
    for pattern, u in found:
        assert sum(pattern) <= 1024
        for n in pattern:
            used[n] += u
    assert used == many and sum(u for _, u in found) <= bound * 1.005


def test_fillings_are_the_undominated_ones():
    def dominated(b, a, room):
        """Whether the pieces of b fit into those of a, a being another filling."""
        def fits(rest, free):
            return not rest or any(f >= rest[0] and fits(rest[1:], free[:i] + [f - rest[0]] + free[i + 1 :]) for i, f in enumerate(free))
        return a != b and sum(a) <= room and fits(sorted(b, reverse=True), list(a))

    random.seed(8)
    for _ in range(60):
        items, room = Counter(random.randint(1, 9) for _ in range(random.randint(1, 7))), random.randint(1, 14)
        every = {()}
        for n, c in items.items():
            every |= {tuple(sorted((*f, *[n] * k), reverse=True)) for f in every for k in range(1, c + 1)}
        every = [f for f in every if sum(f) <= room]
        found = list(packing.fillings(room, dict(items), packing.Budget(10**6)))
        assert len(set(found)) == len(found) and set(found) <= set(every)
        assert [sum(f) for f in found] == sorted((sum(f) for f in found), reverse=True)
        for f in every:  # what is left out fits into one that is not
            assert f in found or any(dominated(f, a, room) for a in found), (items, room, f, found)


def test_pipeline(spark, corpus, tmp_path):
    docs, labels = corpus
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "pii_pseudonyms", "source_mixing", "best_fit_packing"]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        seen[name] = now = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert now.columns == docs.columns
    model = toxicity.fit(docs, labels)
    clean = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    assert {r.doc_id for r in seen["toxicity"].collect()} == clean
    kept = Counter(r.doc_id for r in seen["minhash_near_dedup"].collect())
    assert set(kept) == clean - {1003} and max(kept.values()) == 1  # 1003 has the text of 2, 3 came three times
    private = {r.doc_id: r for r in seen["pii_pseudonyms"].collect()}
    assert "212-555-0100" not in private[1002].text and private[1002].n_chars == len(private[1002].text)
    mixed = Counter(r.doc_id for r in seen["source_mixing"].collect())
    assert set(mixed) == set(kept)
    assert {r.doc_id for r in seen["best_fit_packing"].collect()} == set(mixed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["best_fit_packing"].count()


def test_mixing_stage_reaches_targets(spark, corpus, tmp_path):
    corpus[0].where("doc_id < 1000").dropDuplicates(["doc_id"]).write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    corpus[1].write.parquet(str(tmp_path / "labels.parquet"))
    staged = corpus_pipeline.mixing_stage(spark, docs, str(tmp_path))
    plan = staged._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Exchange" in x and "Broadcast" not in x], plan  # texts stay where they are
    out = staged.groupBy("doc_id").count()
    domains = sorted(mixing.TARGETS)
    model = mixing.classifier(docs, mixing.labelled_domains(docs, corpus[1]), domains)
    members = mixing.memberships(docs, model).drop("row")
    met = members.join(out, members["id"] == out["doc_id"])
    seen = {d: k for k, d in enumerate(sorted(mixing.TARGETS)) if d[:2] in ("de", "en")}
    sums = met.agg(*[F.sum(F.col(f"p{k}") * F.col("tokens") * F.col("count")).alias(d) for d, k in seen.items()]).first()
    scale = sum(mixing.TARGETS[d] for d in seen)
    for d in seen:  # copies are whole numbers, so their totals stray a little from the expected ones
        assert abs(sums[d] / sum(sums) / (mixing.TARGETS[d] / scale) - 1) < 0.05, (d, sums)


def test_posteriors_equal_plain_naive_bayes(spark, corpus):
    """The classifier against naive Bayes written out, on words that are told apart by name instead of by bucket."""
    docs, labels = corpus[0].where("doc_id < 60").dropDuplicates(["doc_id"]), corpus[1]
    domains, buckets = ["de-0", "de-1", "en-0", "en-1"], 4096
    labelled = mixing.labelled_domains(docs, labels)
    model = mixing.classifier(docs, labelled, domains, buckets=buckets)
    got = {r.id: [r[f"p{k}"] for k in range(4)] for r in mixing.memberships(docs, model).collect()}
    words = {r.doc_id: r.b for r in docs.select("doc_id", F.transform(mixing._words(F.col("text")), lambda w: mixing._bucket(w, buckets)).alias("b")).collect()}
    label = {}
    for r in labelled.collect():
        label[r.doc_id] = min(label.get(r.doc_id, "z"), r.domain)
    counts = {d: Counter(b for i, own in label.items() if own == d for b in words[i]) for d in domains}
    pool = Counter(b for c in counts.values() for b in c.elements())
    total = sum(pool.values())
    for i, bs in words.items():
        logs = []
        for d in domains:
            prior = (sum(x == d for x in label.values()) + 1) / (len(label) + 4)
            full = sum(counts[d].values())
            logs.append(np.log(prior) + sum(np.log((counts[d][b] + 50 * (base := (pool[b] + 1) / (total + buckets))) / (full + 50) / base) for b in bs))
        p = np.exp(np.array(logs) - max(logs))
        assert np.allclose(got[i], p / p.sum(), atol=1e-9), i


CLASHES = ["_t", "_keep", "row", "kinds", "n_replaced", "_copies", "_id", "_time", "id", "draw", "tokens", "t", "weights", "buckets", "copies", "time",
           "rate", "score", "n", "f", "g", "w", "bands", "kept", "component_id", "md5", "length", "piece", "_salt", "_rank", "sequence_id", "offset", "p0", "y", "c", "b"]


def test_stages_take_odd_tables(spark, corpus, tmp_path):
    """Clashing names, a very long text, repeated rows and, at last, an empty table go through each stage."""
    corpus[1].write.parquet(str(tmp_path / "labels.parquet"))
    long = spark.createDataFrame([(3000, "enabc " * 1_700_000, "en", "s", 1), (3000, "enabc " * 1_700_000, "en", "s", 2)], DOCS)
    docs = corpus[0].where("doc_id < 300 or doc_id >= 1000 or doc_id is null").unionByName(long)
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])
    docs.write.parquet(str(tmp_path / "start"))
    for first in (spark.read.parquet(str(tmp_path / "start")), spark.read.parquet(str(tmp_path / "start")).limit(0)):
        now, size = first, first.count()
        for name, stage in corpus_pipeline.STAGES:
            out, at = stage(spark, now, str(tmp_path)), str(tmp_path / f"{name}-{size}")
            out.write.parquet(at)
            now = spark.read.parquet(at)
            if name != "best_fit_packing":
                assert now.columns == docs.columns and {tuple(r) for r in now.select(*CLASHES).distinct().collect()} <= {tuple(range(len(CLASHES)))}
                assert bool(size) == (now.where("doc_id = 3000").count() > 0) == (now.where("doc_id is null").count() > 0)
            if name == "minhash_near_dedup" and size:
                assert now.where("doc_id = 3000").count() == 1
        assert bool(size) == (now.count() > 0)
