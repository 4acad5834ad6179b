"""Lagged descriptors of worked sequences."""

import numpy as np

from dockyard.functions import descriptors as D


def plain(seq):
    own = [D.RESIDUES.index(c) for c in seq.upper() if c in D.RESIDUES]
    return own, [np.array(t)[own] for t in D.PROPERTIES.values()]


SEQS = {1: "MKVLAAGIVGLCLA", 2: "acdefxx-ghiklmnpqrstvwy", 3: "AAAA", 4: "", 5: None, 6: "W"}


def test_autocorrelations(spark):
    df = spark.createDataFrame([(k, s, 0, 1) for k, s in SEQS.items()], "id int, seq string, lag int, n int")
    got = {(r.id, r.lag): r for r in D.autocorrelations(df, "id", "seq", lags=5).collect()}
    assert set(got) == {(k, d) for k, s in SEQS.items() if s for d in range(1, 6) if len(plain(s)[0]) > d}
    for (k, d), r in got.items():
        p = plain(SEQS[k])[1][0]
        n, c = len(p), p - p.mean()
        assert abs(r.moreau_broto - (p[:-d] * p[d:]).mean()) < 1e-9
        if k == 3:
            assert r.moran is None and r.geary is None
            continue
        assert abs(r.moran - (c[:-d] * c[d:]).mean() / (c**2).mean()) < 1e-9
        assert abs(r.geary - ((p[:-d] - p[d:]) ** 2).mean() / 2 / ((c**2).sum() / (n - 1))) < 1e-9


def test_pseudo_compositions(spark):
    df = spark.createDataFrame(list(SEQS.items()), "id int, seq string")
    for kind in ("theta", "coupling", "amphiphilic"):
        got = {r.id: np.array(r.x) for r in D.pseudo_composition(df, "id", "seq", 3, 0.1, kind).collect()}
        assert set(got) == {1, 2, 3}
        for k, x in got.items():
            own, p = plain(SEQS[k])
            f = np.bincount(own, minlength=20) / len(own)
            lags = [[(q[:-d], q[d:]) for q in p] for d in (1, 2, 3)]
            t = {
                "theta": [np.mean([(a - b) ** 2 for a, b in row]) for row in lags],
                "coupling": [sum(((a - b) ** 2).sum() for a, b in row) for row in lags],
                "amphiphilic": [(a * b).mean() for row in lags for a, b in row[:2]],
            }[kind]
            scale = 1 + 0.1 * sum(t)
            assert np.allclose(x, np.r_[f / scale, 0.1 * np.array(t) / scale])
            if kind != "amphiphilic":
                assert abs(x.sum() - 1) < 1e-9


def test_fixed_values():
    assert all(len(t) == 20 and abs(sum(t)) < 1e-6 for t in D.PROPERTIES.values())
