"""Vector search and near-dedup, URL filters and licences against brute force."""

import math
import random

import numpy as np
import pytest

from dockyard.llm import embedding_dedup, licences, minhash, topk, url_filter
from dockyard.llm.shared import components

NAN, INF = float("nan"), float("inf")


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (10, 9), (9, 10), (7, 1), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: v for k, v in found.items() if k < 100} == {1: 1, 2: 1, 3: 1, 7: 1, 9: 9, 10: 9}
    assert {v for k, v in found.items() if k >= 100} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_links(rows, least):
    ok = {}
    for i, v, y in rows:
        if i is not None and y is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, set()).add((tuple(x / max(map(abs, v)) for x in v), y))  # scaled, as squares may overflow
    near = {i: set() for i in ok}
    for i in ok:
        for j in ok:
            for a, y in ok[i]:
                for b, z in ok[j]:
                    if i != j and y == z and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                        near[i].add(j)
    comp = {}
    for i in sorted(near):
        if i not in comp:
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in comp:
                    comp[x] = i
                    stack += near[x]
    return near, comp


def test_embedding_dedup(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(12):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((len(rows), (base + 0.12 * rng.standard_normal(16)).tolist(), int(c % 3)))
    base = rng.standard_normal(16)
    for _ in range(300):  # one large group, more than a chunk
        rows.append((len(rows), (base + 0.02 * rng.standard_normal(16)).tolist(), 1))
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [NAN] * 16, 1), (n + 3, [1.0, INF], 1), (n + 4, [None, 1.0], 1), (n + 5, base.tolist(), None)]
    rows += [(n + 6, [], 1), (n + 7, [1.0, 2.0], 1), (n + 8, [2.0, 4.0], 1), (n + 8, [2.0, 4.0], 1), (None, [1.0, 2.0], 1), (n + 9, [1e300, 2e300], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, component string")
    out = embedding_dedup.near_vectors(df).collect()
    assert len(out) == len(rows)
    near, comp = brute_links(rows, 0.98)
    for r in out:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert r.n_links == len(near.get(r.vec_id, ())) and r.component_id == comp.get(r.vec_id, r.vec_id), r
            assert r.kept == (r.vec_id == r.component_id)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_embedding_dedup_hot_label(spark):
    """A label in a cone, with more copies of a vector than a window holds, against brute force."""
    rng = np.random.default_rng(8)
    middle, vectors = 3 * rng.standard_normal(32), []
    for _ in range(2000):  # pairs a little over the threshold among vectors of typical cosine 0.9
        base, way = middle + rng.standard_normal(32), rng.standard_normal(32)
        vectors += [base, base + 0.19 * np.linalg.norm(base) / np.linalg.norm(way) * way]
    vectors += [vectors[0]] * 150 + [vectors[2]] * 90
    ids = [*range(len(vectors)), -1, -1]
    vectors += [vectors[0], vectors[2]]  # one id with both
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, label int")
    x = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (np.array(ids)[:, None] != np.array(ids)[None, :])
    component = np.array(ids)
    while True:
        least = np.where(near, component[None, :], component[:, None]).min(1)
        least[-2:] = least[-2:].min()
        if (least == component).all():
            break
        component = least
    links = near.sum(1)
    links[-2:] = links[-2:].sum()
    want = {i: (n, c) for i, n, c in zip(ids, links.tolist(), component.tolist())}
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df).collect()}
    assert [(i, got[i], want[i]) for i in want if got[i] != want[i]] == []


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(8) * rng.exponential()).tolist()) for i in range(300)]
    rows += [(300, rows[7][1]), (301, rows[7][1]), (302, None), (303, [NAN] * 8), (304, [None] * 8), (305, [0.0] * 8), (306, [1.0, -1.0]), (307, [])]
    rows += [(308, [1e20] * 8), (7, rows[7][1]), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [0, 7, 50, 302, 303, 305, 306, 307, 308]
    out = topk.top_products(df, df.where(df["vec_id"].isin(asked)), 5, block=64)
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ints = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q in asked:
        if q not in ints:
            assert q not in got
            continue
        score = {c: sum(a * b for a, b in zip(ints[q], v)) for c, v in ints.items() if c != q}
        top = (1 << 63) - 1
        score = {c: max(-top - 1, min(top, s)) for c, s in score.items()}
        want = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert sorted(got[q]) == [(k + 1, c, s) for k, (c, s) in enumerate(want)], q
    assert topk.top_products(df.limit(0), df).count() == 0


def jaccard(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


@pytest.mark.parametrize("width", [2, 5])
def test_minhash(spark, width):
    random.seed(3)
    word = lambda: "".join(random.choice("abcdefg") for _ in range(3))
    texts = []
    for size in [1, 2, 3, 8, 40, 120, 300] * 4:
        base = [word() for _ in range(size)]
        texts.append(" ".join(base))
        for _ in range(6):
            w = list(base)
            for _ in range(random.randint(0, max(1, size // 25))):
                w[random.randrange(len(w))] = word()
            texts.append(random.choice([" ", "\n", "  "]).join(w).upper() if random.random() < 0.3 else " ".join(w))
    base = [word() for _ in range(60)]
    for _ in range(80):  # a large group of near copies around the threshold
        w = list(base)
        for _ in range(random.randint(1, 5)):
            w[random.randrange(60)] = word()
        texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)]
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "é"), (n + 6, "É"), (n + 7, "x" * 100_000), (0, texts[0]), (None, texts[0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    out = minhash.near_duplicates(df, width=width).collect()
    assert len(out) == len(rows)

    def grams(t):
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = {i: grams(t) for i, t in rows if i is not None}
    comp = {}
    for i in sorted(sets):
        if i not in comp:
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in comp:
                    comp[x] = i
                    stack += [y for y in sets if y not in comp and sets[x] and sets[y] and jaccard(sets[x], sets[y])]
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), comp[r.doc_id]), r
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    for n in (3, 60, 600):
        a, b = x[:n], x[n // 3 : n + n // 3]
        share = np.mean([(minhash.sketch(minhash._mix(a ^ s), 160) == minhash.sketch(minhash._mix(b ^ s), 160)).mean() for s in minhash.seeds(20, 9)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(share - true) < 0.08
    assert (minhash.sketch(x[:1], 160) != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_urls(spark):
    urls = ["http://www.example.com/en/1", "https://a.example.com/en/1?q=/fr/", "http://EXAMPLE.com/en", "http://x.net/fr/", "http://net/es/x", "http://net.com",
            "http://x.com/", "http://x.com", "http://ads-track.example.com", "http://b.ads-track.example.org/q", "ftp://m.spam-farm.example.org?x", None, "", "nourl", "://", "http://x.com#/",
            "http://com./", "http://a.com:80/", "http://u@b.com/x", "http://" + "a." * 300 + "net/fr/x"]
    df = spark.createDataFrame([(i, u, i) for i, u in enumerate(urls)] + [(0, urls[0], 0)], "page_id long, url string, rule int")
    out = url_filter.filter_urls(df).collect()
    assert len(out) == len(urls) + 1
    for r in out:
        u = urls[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = min((rest.split(c, 1)[0] for c in "/?#"), key=len)
        path = min((rest[len(host) :].split(c, 1)[0] for c in "?#"), key=len)
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda f: len(f[0]), default=(None, None))
        listed = any(host == h or host.endswith("." + h) for h in url_filter.BLOCKED_HOSTS)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[0], best[1] or ("block" if listed else "allow")), u
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    keys = [f"k{i}" for i in range(3000)]
    listed, universe = spark.createDataFrame([(k,) for k in keys[::7]], "key string"), spark.createDataFrame([(k,) for k in keys], "key string")
    c = url_filter.cascade(listed, universe)
    assert len(c.levels) > 1
    held = {r.key for r in universe.where(c.holds(universe["key"])).collect()}
    assert held == set(keys[::7])


def test_licences(spark):
    mit = licences.TEMPLATES[4][1]
    texts = ["x y.\nLicensed under CC BY-NC 4.0.\nz", "Some words. RELEASED under the  MIT license! More words.", mit.replace(", ", ",\n"), f"Intro\n\n{mit}\n\nEnd", "no licence here",
             None, "", "licensed", "Licensed under the Apache License, Version 2.0. Released under the MIT License.", "word " * 50_000 + ". Released under the MIT License."]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, matches int")
    out = {r.doc_id: r.matches for r in licences.scan_licences(df).collect()}
    best = {i: m[0].licence if m else None for i, m in out.items()}
    assert best == {0: "CC-BY-NC-4.0", 1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: None, 6: None, 7: None, 8: "Apache-2.0", 9: "MIT"}
    assert [m.licence for m in out[8]] == ["Apache-2.0", "MIT"] and out[0][0].dice == 1.0
    for i, t in enumerate(texts):  # every segment by brute force
        import re

        pieces = [t or "", *re.split(r"\n[ \t\r]*\n", t or ""), *(t or "").split("\n"), *re.sub(r"([.!?])[ \t\r]+", r"\1\n", t or "").split("\n")]
        want = set()
        for s in {" ".join(licences.words_of(p)) for p in pieces}:
            g = set(licences.bigrams_of(s))
            for name, text in licences.TEMPLATES:
                h = set(licences.bigrams_of(text))
                if g and 2 * len(g & h) / (len(g) + len(h)) >= 0.8:
                    want.add((name, s))
        assert {(m.licence, m.segment) for m in out[i]} == want, i
    assert licences.scan_licences(df.limit(0)).count() == 0


def test_long_lists_of_hosts(spark):
    hosts = [f"h{i}.example.net" for i in range(200_000)]
    pages = spark.range(4000).selectExpr("id AS page_id", "concat('http://a.h', id * 100, '.example.net/x') AS url")
    out = url_filter.filter_urls(pages, rules=(), blocked_hosts=hosts).collect()
    assert len(out) == 4000
    assert all(r.verdict == ("block" if r.page_id < 2000 else "allow") and r.rule is None for r in out)
