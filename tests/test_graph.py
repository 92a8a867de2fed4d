"""Components and reachability against plain search, in one block and over many."""

import random

import pytest

from orbitable.operators import graph as og


def search(bonds, start, without):
    near = {}
    for a, b in bonds:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, todo = {start}, [start]
    while todo:
        for n in near.get(todo.pop(), ()):
            if n != without and n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


def bond_rows(spark, molecules):
    return spark.createDataFrame([(m, a, b, 1.0) for m, pairs in molecules.items() for a, b in pairs], "mol_id string, a int, b int, dist double").repartition(4)


def atom_rows(spark, sizes):
    return spark.createDataFrame([(m, i, "C") for m, n in sizes.items() for i in range(1, n + 1)], "mol_id string, atom_idx int, element string")


@pytest.mark.parametrize("block", [4, 4096])
def test_components_equal_search(spark, block):
    rng = random.Random(3)
    molecules = {f"m{i}": [(rng.randint(1, 60), rng.randint(1, 60)) for _ in range(rng.choice([3, 30, 55]))] for i in range(12)}
    molecules["star"] = [(50, i) for i in range(1, 50)]
    molecules["down"] = [(i + 1, i) for i in range(1, 90)]
    molecules["loop"] = [(7, 7)]
    got = {}
    for r in og.components(bond_rows(spark, molecules), block=block).collect():
        assert (r["mol_id"], r["atom_idx"]) not in got
        got[r["mol_id"], r["atom_idx"]] = r["component"]
    want = {}
    for m, pairs in molecules.items():
        for atom in {x for a, b in pairs if a != b for x in (a, b)}:
            want[m, atom] = min(search(pairs, atom, None))
    assert got == want


def test_chain_of_10000_atoms_takes_few_rounds(spark, monkeypatch):
    order = list(range(1, 10_001))
    random.Random(1).shuffle(order)
    edges = bond_rows(spark, {"chain": list(zip(order, order[1:]))})
    calls = []
    whole = og._unsettled
    monkeypatch.setattr(og, "_unsettled", lambda *args: calls.append(1) or whole(*args))
    got = og.components(edges, block=16).collect()
    assert len(got) == 10_000 and {r["component"] for r in got} == {1} and len(calls) < 20


def test_reachable_over_bases(spark):
    rng = random.Random(8)
    molecules = {f"m{i}": [(rng.randint(1, 20), rng.randint(1, 20)) for _ in range(14)] for i in range(20)}
    bases = [(1, 2), (5, 9), (3, 30)]
    got = {}
    for r in og.reachable(atom_rows(spark, dict.fromkeys(molecules, 20)), bond_rows(spark, molecules), bases).collect():
        got.setdefault((r["mol_id"], r["spec_id"]), []).append(r["atom_idx"])
    want = {(m, i): sorted({s, *search(pairs, d, s)}) for m, pairs in molecules.items() for i, (s, d) in enumerate(bases, 1) if d <= 20}
    assert {k: sorted(v) for k, v in got.items()} == want
    depths = og.reachable_depths(atom_rows(spark, dict.fromkeys(molecules, 20)), bond_rows(spark, molecules), bases).collect()
    assert sorted((r["mol_id"], r["spec_id"], r["atom_idx"]) for r in depths) == sorted((*k, a) for k, v in want.items() for a in v)


def test_no_bonds(spark):
    none = bond_rows(spark, {"x": [(1, 2)]}).where("a > 5")
    got = og.reachable(atom_rows(spark, {"x": 3}), none, [(1, 2)]).collect()
    assert sorted(r["atom_idx"] for r in got) == [1, 2]
