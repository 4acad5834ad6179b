"""Encoders with vector states against dense arrays, and structures that are parsed once."""

import numpy as np

from dockyard.functions import encoders as G
from dockyard.functions import smiles


def graphs(seed=1, sizes=(5, 1, 7), width=3, bonds=2):
    rng = np.random.default_rng(seed)
    out = []
    for n in sizes:
        a = np.triu((rng.random((n, n)) < 0.4).astype(float), 1)
        a += a.T
        w = rng.standard_normal((n, n, bonds))
        out.append((rng.standard_normal((n, width)), a, (w + w.transpose(1, 0, 2)) / 2))
    return out


def tables(spark, made):
    nodes = [(g, i, h[i].tolist()) for g, (h, _, _) in enumerate(made) for i in range(len(h))]
    edges = [(g, i, j, float(a[i, j]), w[i, j].tolist()) for g, (h, a, w) in enumerate(made) for i in range(len(h)) for j in range(len(h)) if a[i, j]]
    return (
        spark.createDataFrame(nodes, "g long, id int, h array<double>"),
        spark.createDataFrame(edges, "g long, i int, j int, a double, w array<double>"),
    )


def dense(df, column="h"):
    out = {}
    for r in df.orderBy("g", "id").collect():
        out.setdefault(r.g, []).append(r[column])
    return {g: np.array(v) for g, v in out.items()}


def test_message_passing(spark):
    made, rng = graphs(), np.random.default_rng(2)
    nodes, edges = tables(spark, made)
    w1, w2, b, wb = rng.standard_normal((3, 4)), rng.standard_normal((3, 4)), rng.standard_normal(4), rng.standard_normal((2, 4))
    got = dense(G.message_passing(nodes, edges, w1, w2, b, wb))
    for g, (h, a, w) in enumerate(made):
        expected = np.maximum(0, h @ w1 + a @ (h @ w2) + a.sum(1, keepdims=True) * b + np.einsum("ij,ijk->ik", a, w) @ wb)
        assert np.allclose(got[g], expected)


def test_attention_heads(spark):
    made, rng = graphs(3), np.random.default_rng(4)
    nodes, edges = tables(spark, made)
    heads = [(rng.standard_normal((3, 2)), rng.standard_normal(2), rng.standard_normal(2)) for _ in range(2)]
    bias = [rng.standard_normal(2) for _ in heads]
    both = {how: dense(G.attention(nodes, edges, heads, bias, how)) for how in ("concat", "average")}
    for g, (h, a, _) in enumerate(made):
        outs = []
        for (w, x, y), b in zip(heads, bias):
            v = h @ w
            e = (v @ x)[:, None] + (v @ y)[None]
            e = np.where(e >= 0, e, 0.2 * e) + np.where(a + np.eye(len(h)) > 0, 0, -np.inf)
            p = np.exp(e - e.max(1, keepdims=True))
            outs.append(p / p.sum(1, keepdims=True) @ v + b)
        assert np.allclose(both["concat"][g], np.maximum(0, np.concatenate(outs, 1)))
        assert np.allclose(both["average"][g], np.maximum(0, np.mean(outs, 0)))


def test_pooling_and_link_loss(spark):
    made, rng = graphs(5), np.random.default_rng(6)
    nodes, edges = tables(spark, made)
    s1, s2 = rng.standard_normal((3, 2)), rng.standard_normal((3, 2))
    shares = G.assignment(nodes, edges, s1, s2).cache()
    states, weights = G.pooled(nodes, edges, shares, 3, 2)
    loss = {r.g: r.loss for r in G.link_loss(edges, shares, 2).collect()}
    small, cells = dense(states), {(r.g, r.i, r.j): r.a for r in weights.collect()}
    for g, (h, a, _) in enumerate(made):
        raw = np.maximum(0, h @ s1 + a @ (h @ s2))
        s = np.exp(raw - raw.max(1, keepdims=True))
        s /= s.sum(1, keepdims=True)
        assert np.allclose(small[g], s.T @ h)
        whole = s.T @ a @ s
        assert all(abs(cells.get((g, i, j), 0) - whole[i, j]) < 1e-9 for i in range(2) for j in range(2))
        assert abs(loss[g] - np.linalg.norm(a - s @ s.T)) < 1e-9
    again = dense(G.message_passing(states, weights, rng.standard_normal((3, 2)), rng.standard_normal((3, 2))))
    assert again[0].shape == (2, 2)  # the smaller graph is a graph


def test_readout_and_combination(spark):
    made = graphs(7)
    nodes, _ = tables(spark, made)
    parts = [G.readout(nodes, 3, "sum"), G.readout(nodes, 3, "max")]
    for how, f in (("sum", lambda x, y: x + y), ("concat", lambda x, y: np.r_[x, y]), ("last", lambda x, y: y)):
        got = {r.g: np.array(r.h) for r in G.combined(parts, [3, 3], how).collect()}
        for g, (h, _, _) in enumerate(made):
            assert np.allclose(got[g], f(h.sum(0), h.max(0)))


def test_structures_are_parsed_once(spark):
    df = spark.createDataFrame([(1, "CCO"), (2, "c1ccccc1N"), (3, "not a structure"), (4, None), (5, ""), (6, "C")], "mol_id long, s string")
    read = smiles.read(df, "mol_id", "s")
    old_atoms, old_bonds = smiles.atoms_and_bonds(df, "mol_id", "s")
    assert sorted(map(tuple, read.atoms.collect())) == sorted(map(tuple, old_atoms.collect()))
    assert sorted(map(tuple, read.bonds.collect())) == sorted(map(tuple, old_bonds.collect()))
    assert {r.mol_id for r in read.rejects.collect()} == {3, 4, 5}
    plan = read.atoms._jdf.queryExecution().executedPlan().toString()
    assert "UDTF" not in plan and "Python" not in plan  # what follows reads the one pass


def test_large_graphs_stay(spark):
    df = spark.createDataFrame([(1, "CCO"), (2, "CCCCCC")], "mol_id long, s string")
    read = smiles.read(df, "mol_id", "s")
    got = {r.mol_id: (r.n, r.nodes is None, r.edges is None) for r in smiles.dense(read.atoms, read.bonds, 4).collect()}
    assert got == {1: (3, False, False), 2: (6, True, True)}


def broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_strings_are_dealt_and_atoms_stay_where_they_are(spark):
    """One small file of strings is not one task's; its atoms, of which Spark knows no size, are not sent to all tasks."""
    df = spark.createDataFrame([(n, "C" * (n % 5 + 1)) for n in range(50)], "mol_id long, s string").coalesce(1)
    assert all(t.rdd.getNumPartitions() > 1 for t in smiles.atoms_and_bonds(df, "mol_id", "s"))
    read = smiles.read(df, "mol_id", "s")
    assert broadcasts(smiles.fingerprints(read.atoms, read.bonds)) == 0 and broadcasts(smiles.dense(read.atoms, read.bonds, 5)) == 0
    assert smiles.dense(read.atoms, read.bonds, 5).where("size(nodes) = 5 and size(edges[4]) = 5").count() == 50


def test_states_are_not_broadcast(spark):
    nodes, edges = tables(spark, graphs(7))
    w = np.ones((3, 3))
    shares = G.assignment(nodes, edges, w, w)
    small, cells = G.pooled(nodes, edges, shares, 3, 3)
    made = [G.message_passing(nodes, edges, w, w), G.attention(nodes, edges, [(w, w[0], w[0])]), shares, small, cells, G.link_loss(edges, shares, 3), G.combined([G.readout(nodes, 3), G.readout(small, 3)], [3, 3])]
    assert [broadcasts(df) for df in made] == [0] * 7
