"""Secondary structure against an independent version in numpy, on built helices and strands."""

import math
import random

import numpy as np
import pytest

from foldframe.operators import features, secondary, structure
from foldframe.sources.readers import structure_lines


def place(a, b, c, length, angle, torsion):
    """The point at ``length`` from c, with the angle at c and the torsion around b-c."""
    bc = (c - b) / np.linalg.norm(c - b)
    n = np.cross(b - a, bc)
    n /= np.linalg.norm(n)
    m = np.cross(n, bc)
    x, y, z = -length * math.cos(angle), length * math.sin(angle) * math.cos(torsion), length * math.sin(angle) * math.sin(torsion)
    return c + x * bc + y * m + z * n


def built(torsions):
    """(n, ca, c, o) of each residue of a chain with the given (phi, psi) in degrees."""
    rad = math.radians
    n, ca, c = np.array([0.0, 0, 0]), np.array([1.458, 0, 0]), np.array([2.0, 1.42, 0])
    out = []
    for k, (_, psi) in enumerate(torsions):
        o = place(n, ca, c, 1.231, rad(120.5), rad(psi + 180))
        out.append([n, ca, c, o])
        if k + 1 < len(torsions):
            n2 = place(n, ca, c, 1.329, rad(116.2), rad(psi))
            ca2 = place(ca, c, n2, 1.458, rad(121.7), rad(180))
            c2 = place(c, n2, ca2, 1.525, rad(111.0), rad(torsions[k + 1][0]))
            n, ca, c = n2, ca2, c2
    return np.array(out)


def brute(chains, prolines=(), n_best=2):
    """Codes of all residues; ``chains`` are arrays of backbones, numbered one after the other."""
    atoms = np.concatenate(chains)
    start = set(np.cumsum([0, *map(len, chains)])[:-1].tolist())
    size = len(atoms)
    seg = np.zeros(size, int)
    h = [None] * size
    for i in range(size):
        linked = i and i not in start and np.linalg.norm(atoms[i - 1][2] - atoms[i][0]) <= 2.5
        seg[i] = (seg[i - 1] if i else 0) + (not linked)
        if linked and i not in prolines:
            v = atoms[i - 1][2] - atoms[i - 1][3]
            h[i] = atoms[i][0] + v / np.linalg.norm(v)
    bond = set()
    for j in range(size):
        found = []
        for i in range(size):
            if h[j] is None or i in (j, j - 1) or np.linalg.norm(atoms[i][1] - atoms[j][1]) > 9:
                continue
            d = [np.linalg.norm(p - q) for p, q in ((atoms[i][3], atoms[j][0]), (atoms[i][2], h[j]), (atoms[i][3], h[j]), (atoms[i][2], atoms[j][0]))]
            e = -9.9 if min(d) < 0.5 else 27.888 * (1 / d[0] + 1 / d[1] - 1 / d[2] - 1 / d[3])
            if e < -0.5:
                found.append((e, i))
        bond |= {(i, j) for _, i in sorted(found)[:n_best]}
    turn = {n: {i for i, j in bond if j == i + n and seg[i] == seg[j]} for n in (3, 4, 5)}
    code = ["C"] * size
    inner = [0 < i < size - 1 and seg[i - 1] == seg[i] == seg[i + 1] for i in range(size)]
    met = {}
    for i in range(size):
        for j in range(i + 3, size):
            if inner[i] and inner[j]:
                if {(i, j), (j, i)} <= bond or {(i - 1, j + 1), (j - 1, i + 1)} <= bond:
                    met.setdefault((i, j), set()).add(-1)
                if {(i - 1, j), (j, i + 1)} <= bond or {(j - 1, i), (i, j + 1)} <= bond:
                    met.setdefault((i, j), set()).add(1)
    flat = {x for p in met for x in p}
    for (i, j), turns in met.items():
        for (k, m), others in met.items():
            for t in turns & others:
                x, y = k - i, t * (m - j)
                if x >= 1 and y >= 1 and (x, y) != (1, 1) and max(x, y) <= 5 and min(x, y) <= 2 and seg[i] == seg[k] and seg[j] == seg[m]:
                    flat |= {*range(i, k + 1), *range(min(j, m), max(j, m) + 1)}
    for i in flat:
        code[i] = "E"
    for i in turn[4]:
        if i - 1 in turn[4]:
            code[i : i + 4] = ["H"] * 4
    for n in (3, 5):
        new = [range(i, i + n) for i in turn[n] if i - 1 in turn[n] and all(code[k] == "C" for k in range(i, i + n))]
        for r in new:
            for k in r:
                code[k] = "H"
    return "".join(code), bond


def pdb(chains, names=None, skip=()):
    out, serial, k = [], 0, 0
    for number, chain in enumerate(chains):
        for r, residue in enumerate(chain):
            name = (names or {}).get(k, "ALA")
            for atom, xyz in zip(("N", "CA", "C", "O"), residue, strict=True):
                if (k, atom) not in skip:
                    serial += 1
                    out.append(f"ATOM  {serial:5} {atom:<4} {name} {'AB'[number]}{r + 1:4}    {xyz[0]:8.3f}{xyz[1]:8.3f}{xyz[2]:8.3f}{1:6.2f}{50:6.2f}          {atom[0]:>2}")
            k += 1
    return "\n".join(out)


def residues_of(spark, texts):
    lines = structure_lines(spark.createDataFrame([*texts.items()], "structure_id string, value string"))
    return structure.residues_of(structure.parse_atoms(lines))


def codes(spark, texts):
    found = {}
    for r in secondary.assign(residues_of(spark, texts)).collect():
        found.setdefault(r.structure_id, {})[r.residue] = r.dssp
    return found


def sheets(count, seed):
    """Pairs of strands in random places that make bonds by chance, parallel or not."""
    r, out = random.Random(seed), []
    strand = np.round(built([(-125, 130)] * 9), 3)
    middle = strand.reshape(-1, 3).mean(0)
    while len(out) < count:
        q = np.array([r.gauss(0, 1) for _ in range(4)])
        w, x, y, z = q / np.linalg.norm(q)
        turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
        way = np.array([r.gauss(0, 1) for _ in range(3)])
        other = np.round((strand - middle) @ turn.T + middle + way / np.linalg.norm(way) * r.uniform(4.2, 5.4), 3)
        if len(brute([strand, other])[1]) >= 2:
            out.append([strand, other])
    return out


def test_helix_strand_and_sheets_equal_brute_force(spark):
    chains = {"helix": [built([(-57, -47)] * 16)], "tight": [built([(-49, -26)] * 14)], "wide": [built([(-57, -70)] * 16)], "strand": [built([(-120, 130)] * 10)]}
    chains |= {f"sheet{k}": c for k, c in enumerate(sheets(10, 3))}
    chains = {k: [np.round(c, 3) for c in v] for k, v in chains.items()}
    got = codes(spark, {k: pdb(v) for k, v in chains.items()})
    assert {k: "".join(v[i] for i in sorted(v)) for k, v in got.items()} == {k: brute(v)[0] for k, v in chains.items()}
    helix = "".join(got["helix"][i] for i in range(16))
    assert helix == "C" + "H" * 14 + "C" and "H" in got["tight"].values() and set(got["strand"].values()) == {"C"}


def test_known_hairpin(spark):
    """Two strands moved until their bonds are those of a sheet."""
    found = [c for c in sheets(60, 11) if "E" in brute(c)[0]]
    assert found
    got = codes(spark, {f"s{k}": pdb(c) for k, c in enumerate(found)})
    assert {k: "".join(v[i] for i in sorted(v)) for k, v in got.items()} == {f"s{k}": brute(c)[0] for k, c in enumerate(found)}


def test_broken_chains_missing_atoms_and_prolines(spark):
    helix = np.round(built([(-57, -47)] * 20), 3)
    far = helix.copy()
    far[10:] += 30
    got = codes(spark, {"proline": pdb([helix], {8: "PRO"}), "gap": pdb([far]), "missing": pdb([helix], skip={(9, "O")}), "two": pdb([helix[:10], helix[10:]]), "none": pdb([helix], skip={(k, "CA") for k in range(20)})})
    text = {k: "".join(v.get(i, "-") for i in range(20)) for k, v in got.items()}
    assert text["proline"] == brute([helix], {8})[0] and text["gap"] == brute([far])[0] == "CHHHHHHHHCCHHHHHHHHC"
    assert text["missing"][9] == "-" and text["missing"] == (brute([helix[:9]])[0] + "-" + brute([helix[10:]])[0])
    assert text["two"] == brute([helix[:10], helix[10:]])[0] and "none" not in text
    assert secondary.assign(residues_of(spark, {"x": ""})).count() == 0


def test_touching_atoms_have_the_strongest_energy(spark):
    from pyspark.sql import functions as F

    p = lambda x: F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    row = spark.range(1).select(secondary.bond_energy(p(0), p(1), p(0.2), p(3)).alias("a"), secondary.bond_energy(p(0), p(-1.2), p(2.9), p(1.9)).alias("b")).first()
    assert row.a == -9.9 and row.b == pytest.approx(27.888 * (1 / 2.9 + 1 / 3.1 - 1 / 1.9 - 1 / 4.1))


def test_features_carry_codes_and_mask(spark):
    text = {"/p/a.pdb": pdb([np.round(built([(-57, -47)] * 16), 3)], skip={(15, "O")})}
    lines = structure_lines(spark.createDataFrame([*text.items()], "structure_id string, value string"))
    manifest = spark.createDataFrame([("a", "A" * 16, "/p/a.pdb", 0)], "protein_id string, sequence string, pdb_path string, ord long")
    rows, qc = features.extract_features(manifest, lines, dssp=secondary.assign)
    got = sorted((r.sequence_pos_1based, r.dssp, r.dssp_mask) for r in rows.collect())
    assert [g[2] for g in got] == [1] * 15 + [0] and got[5][1] == "H" and got[15][1] is None and qc.first().dssp_reason == "ok"
    plain, _ = features.extract_features(manifest, lines, sasa=False)
    again = features.augment_features(plain, manifest, lines, sasa=False, dssp=secondary.assign)[0]
    assert sorted((r.sequence_pos_1based, r.dssp, r.dssp_mask or 0) for r in again.collect()) == got
