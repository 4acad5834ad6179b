"""Molecular graphs from line notation: atoms and bonds of a structure string.

Covers the organic subset, brackets (isotope, chirality, hydrogens, charge), bonds, branches, ring closures and
disconnected parts. Atom attributes are one-hot groups (element 11, degree 6, hydrogens 5) and charge, ring and
aromatic flags: 25 numbers. Bonds have 8: type one-hot 4, aromatic, conjugated, ring, constant. The seven computed
descriptors of a chemistry toolkit are not derived. A string that can't be read gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockyard.operators.lineage import kept

# Usual valences, and the atomic numbers of the element groups (the last one is for all others).
VALENCE = {"B": 3, "C": 4, "N": 3, "O": 2, "P": 3, "S": 2, "F": 1, "Cl": 1, "Br": 1, "I": 1}
NUMBER = {"B": 5, "C": 6, "N": 7, "O": 8, "F": 9, "P": 15, "S": 16, "Cl": 17, "Br": 35, "I": 53}
GROUPS = [5, 6, 7, 8, 9, 15, 16, 17, 35, 53, 999]
ORDER = {"-": 1.0, "/": 1.0, "\\": 1.0, "=": 2.0, "#": 3.0, ":": 1.5}
TOKEN = re.compile(r"\[(?P<iso>\d+)?(?P<sym>[A-Z][a-z]?|[a-z]{1,2})(?P<chi>@{1,2})?(?P<h>H\d*)?(?P<chg>[+-]+\d*|[+-]\d+)?(?::\d+)?\]|(?P<org>Cl|Br|[BCNOPSFI]|[bcnops])|(?P<bond>[-=#:/\\])|(?P<ring>%\d\d|\d)|(?P<par>[()])|(?P<dot>\.)")


def parse(text: str) -> tuple[list[dict], list[tuple[int, int, float]]] | None:
    """Atoms and bonds (i < j, order; 1.5 for aromatic), or None if the string is not valid."""
    atoms, bonds, stack, rings = [], [], [], {}
    last, order, at = None, None, 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            return None
        at = m.end()
        if m["par"] == "(":
            stack.append(last)
        elif m["par"]:
            if not stack:
                return None
            last = stack.pop()
        elif m["dot"]:
            last, order = None, None
        elif m["bond"]:
            order = ORDER[m["bond"]]
        elif m["ring"]:
            if last is None:
                return None
            if m["ring"] in rings:
                other, o = rings.pop(m["ring"])
                both = atoms[other]["aromatic"] and atoms[last]["aromatic"]
                bonds.append((other, last, order or o or (1.5 if both else 1.0)))
            else:
                rings[m["ring"]] = (last, order)
            order = None
        else:
            symbol = m["org"] or m["sym"]
            charge = m["chg"] or ""
            digits = re.search(r"\d+", charge)
            size = int(digits[0]) if digits else len(charge)
            h = None if m["org"] else 0 if not m["h"] else int(m["h"][1:] or 1)
            atoms.append({"symbol": symbol.capitalize(), "aromatic": symbol.islower(), "charge": -size if "-" in charge else size, "h": h})
            if last is not None:
                both = atoms[last]["aromatic"] and symbol.islower()
                bonds.append((last, len(atoms) - 1, order or (1.5 if both else 1.0)))
            last, order = len(atoms) - 1, None
    return None if stack or rings or not atoms else (atoms, bonds)


def ring_bonds(n: int, bonds: list[tuple[int, int, float]]) -> list[bool]:
    """Which bonds lie on a cycle: those that are no bridge of the graph."""
    near: dict[int, list[tuple[int, int]]] = {i: [] for i in range(n)}
    for k, (i, j, _) in enumerate(bonds):
        near[i].append((j, k))
        near[j].append((i, k))
    seen, low, found, bridge = {}, {}, 0, set()
    for root in range(n):
        if root in seen:
            continue
        seen[root] = low[root] = found
        found += 1
        stack = [(root, -1, iter(near[root]))]
        while stack:
            node, by, rest = stack[-1]
            for other, k in rest:
                if k == by:
                    continue
                if other in seen:
                    low[node] = min(low[node], seen[other])
                else:
                    seen[other] = low[other] = found
                    found += 1
                    stack.append((other, k, iter(near[other])))
                    break
            else:
                stack.pop()
                if stack:
                    up = stack[-1][0]
                    low[up] = min(low[up], low[node])
                    if low[node] > seen[up]:
                        bridge.add(by)
    return [k not in bridge for k in range(len(bonds))]


def graph(text: str | None) -> tuple[list[list[float]], list[tuple[int, int, list[float]]]]:
    """Attributes of the atoms, and of the bonds in both directions."""
    found = parse(text) if text else None
    if not found:
        return [], []
    atoms, bonds = found
    in_ring = ring_bonds(len(atoms), bonds)
    degree, used, ringed = [0] * len(atoms), [0.0] * len(atoms), [False] * len(atoms)
    double = [False] * len(atoms)
    for (i, j, o), r in zip(bonds, in_ring):
        for x in (i, j):
            degree[x] += 1
            used[x] += o
            ringed[x] |= r
            double[x] |= o > 1
    out = []
    for a, d, u, r in zip(atoms, degree, used, ringed):
        h = a["h"] if a["h"] is not None else max(0, int(VALENCE.get(a["symbol"], 0) - u))
        number = NUMBER.get(a["symbol"], 999)
        one = lambda v, options: [float(v == o or (v not in options and o == options[-1])) for o in options]
        out.append([*one(number, GROUPS), *one(d, [0, 1, 2, 3, 4, 5]), *one(h, [0, 1, 2, 3, 4]), float(a["charge"]), float(r), float(a["aromatic"])])
    edges = []
    for (i, j, o), r in zip(bonds, in_ring):
        conjugated = o == 1.5 or (o == 1.0 and double[i] and double[j])
        attrs = [*(float(o == x) for x in (1.0, 1.5, 2.0, 3.0)), float(o == 1.5), float(conjugated), float(r), 1.0]
        edges += [(i, j, attrs), (j, i, attrs)]
    return out, edges


@lru_cache(maxsize=20_000)
def _packed(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Atoms' attributes, bonds' ends and bonds' attributes as arrays; a string that comes again in a task is parsed once."""
    atoms, bonds = graph(text)
    ends = np.array([b[:2] for b in bonds], dtype=np.int32).reshape(-1, 2)
    return np.array(atoms, dtype=np.float32).reshape(-1, 25), ends, np.array([b[2] for b in bonds], dtype=np.float32).reshape(-1, 8)


KINDS = ("atom", "bond", "reject")


def rows_of(df: DataFrame, key: str, smiles: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Rows ``mol_id``, ``kind``, ``i``, ``j``, ``attrs`` of the structure strings: their atoms, their bonds in both directions, or one
    row that a string can't be read; only the wanted ``kinds`` are made. The strings are dealt to tasks first, as a file of
    many of them is small and would be one task's."""
    rows = df.select(F.col(key).alias("mol_id"), F.col(smiles).alias("s"))
    kind = dict(rows.dtypes)["mol_id"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 1000) for at in range(0, whole.num_rows, 1000)):
                found = [_packed(s) for s in b.column(1).to_pylist()]
                for name in kinds:
                    count = np.array([len(f[0]) == 0 if name == "reject" else len(f[0 if name == "atom" else 1]) for f in found], dtype=np.int64)
                    n = int(count.sum())
                    if not n:
                        continue
                    none = pa.nulls(n, pa.int32())
                    if name == "atom":
                        i, j, attrs = pa.array(np.concatenate([np.arange(c, dtype=np.int32) for c in count])), none, np.concatenate([f[0] for f in found])
                    elif name == "bond":
                        ends = np.concatenate([f[1] for f in found])
                        i, j, attrs = pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy()), np.concatenate([f[2] for f in found])
                    else:
                        i, j, attrs = none, none, None
                    listed = pa.nulls(n, pa.list_(pa.float32())) if attrs is None else pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * attrs.shape[1], attrs.ravel())
                    ids = b.column(0).take(pa.array(np.repeat(np.arange(len(count)), count)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([name]).take(pa.array(np.zeros(n, dtype=np.int64))), i, j, listed], ["mol_id", "kind", "i", "j", "attrs"])

    dealt = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "mol_id")
    return dealt.mapInArrow(made, f"mol_id {kind}, kind string, i int, j int, attrs array<float>")


def atoms_and_bonds(df: DataFrame, key: str, smiles: str) -> tuple[DataFrame, DataFrame]:
    """Tables ``atom`` (mol_id, i, attrs) and ``bond`` (mol_id, i, j, attrs; both directions), each a pass of its own that stores nothing."""
    return rows_of(df, key, smiles, ("atom",)).select("mol_id", "i", "attrs"), rows_of(df, key, smiles, ("bond",)).select("mol_id", "i", "j", "attrs")


@dataclass
class Structures:
    """``atoms`` (mol_id, i, attrs), ``bonds`` (mol_id, i, j, attrs) and ``rejects`` (mol_id) of one pass over the strings."""

    atoms: DataFrame
    bonds: DataFrame
    rejects: DataFrame


def read(df: DataFrame, key: str, smiles: str) -> Structures:
    """Parse each string once and keep the rows of all three kinds as a table, whose size Spark knows."""
    found = kept(rows_of(df, key, smiles))
    own = lambda kind: found.where(F.col("kind") == kind)
    return Structures(own("atom").select("mol_id", "i", "attrs"), own("bond").select("mol_id", "i", "j", "attrs"), own("reject").select("mol_id"))


def fingerprints(atoms: DataFrame, bonds: DataFrame, radius: int = 2, size: int = 1024) -> DataFrame:
    """Circular fingerprints of the graphs: ``mol_id``, ``bit`` and ``n``, how many environments of atoms fall on the bit.

    An atom's first code hashes its attributes; in each round a code is hashed with the sorted codes of its neighbours and
    the kinds of their bonds, a join and an aggregate whose groups are an atom's few neighbours. Codes of all rounds are
    counted by their remainder; the binary fingerprint is the set of bits. Atoms are never broadcast: their compressed files are
    far smaller than their rows.
    """
    now = atoms.select("mol_id", "i", F.xxhash64(F.lit(0), F.col("attrs").cast("array<string>")).alias("code"))
    every = now
    kinds = bonds.select("mol_id", "i", "j", F.slice("attrs", 1, 4).cast("array<string>").alias("kind"))
    for r in range(1, radius + 1):
        other = now.select("mol_id", F.col("i").alias("j"), F.col("code").alias("near"))
        told = kinds.join(other.hint("merge"), ["mol_id", "j"]).groupBy("mol_id", "i").agg(F.sort_array(F.collect_list(F.xxhash64("kind", "near"))).alias("around"))
        now = now.join(told.hint("merge"), ["mol_id", "i"], "left").select("mol_id", "i", F.xxhash64(F.lit(r), "code", "around").alias("code"))
        every = every.unionByName(now)
    return every.groupBy("mol_id", F.pmod("code", F.lit(size)).cast("int").alias("bit")).agg(F.count("*").alias("n"))


def dense(atoms: DataFrame, bonds: DataFrame, n_atoms: int, mode: int = 0) -> DataFrame:
    """Tensors of graphs for dense consumers: ``mol_id``, ``n``, ``nodes`` (n_atoms x 25) and ``edges``, both padded with zeros.

    ``edges`` is the adjacency matrix (mode 0), the same with ones on the diagonal of the atoms there are (1), or has the
    8 attributes of each bond in its cells (2). ``n`` is the number of atoms; where it is over ``n_atoms`` both tensors are null.
    """
    own = atoms.groupBy("mol_id").agg(F.collect_list(F.struct("i", "attrs")).alias("a"))
    met = bonds.groupBy("mol_id").agg(F.collect_list(F.struct("i", "j", "attrs")).alias("b"))
    both = own.join(met.hint("merge"), "mol_id", "left").select("mol_id", "a", F.coalesce("b", F.expr("cast(array() AS array<struct<i: int, j: int, attrs: array<float>>>)")).alias("b"))
    kind, depth = dict(both.dtypes)["mol_id"], 8 if mode == 2 else 0

    def parts(column: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
        """The row that each entry belongs to, and the entries."""
        return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), column.flatten()

    def nested(v: np.ndarray, missing: np.ndarray) -> pa.ListArray:
        """Arrays of fixed shapes, null where ``missing``."""
        out = pa.array(v.ravel())
        for k in range(v.ndim - 1, 0, -1):
            out = pa.ListArray.from_arrays(pa.array(np.arange(int(np.prod(v.shape[:k])) + 1, dtype=np.int32) * v.shape[k]), out, mask=pa.array(missing) if k == 1 else None)
        return out

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                ids, a, b = (pa.concat_arrays([c]) for c in whole.slice(at, 256).columns)
                n = np.diff(a.offsets.to_numpy())
                fits = n <= n_atoms
                nodes = np.zeros((len(n), n_atoms, 25), dtype=np.float32)
                edges = np.zeros((len(n), n_atoms, n_atoms, *[8] * (depth > 0)), dtype=np.float32)
                row, entry = parts(a)
                i, on = entry.field("i").to_numpy(), fits[row]
                nodes[row[on], i[on]] = entry.field("attrs").flatten().to_numpy().reshape(-1, 25)[on]
                if mode == 1:
                    edges[row[on], i[on], i[on]] = 1
                row, entry = parts(b)
                i, j, on = entry.field("i").to_numpy(), entry.field("j").to_numpy(), fits[row]
                edges[row[on], i[on], j[on]] = entry.field("attrs").flatten().to_numpy().reshape(-1, 8)[on] if depth else 1
                yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), nested(nodes, ~fits), nested(edges, ~fits)], ["mol_id", "n", "nodes", "edges"])

    deep = "array<array<array<float>>>" if depth else "array<array<float>>"
    return both.mapInArrow(made, f"mol_id {kind}, n long, nodes array<array<float>>, edges {deep}")


def rejects(df: DataFrame, key: str, smiles: str) -> DataFrame:
    """How many structure strings there are, and how many of them can't be read, as one row; no atoms are made."""
    bad = rows_of(df, key, smiles, ("reject",)).agg(F.count("*").alias("n_rejected"))
    return df.agg(F.count("*").alias("n")).join(bad)
