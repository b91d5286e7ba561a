import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foldframe import cli
from foldframe.functions import sequences
from foldframe.operators import features as X
from foldframe.operators import contacts, sasa, structure
from foldframe.plans import queries
from foldframe.schemas import AUGMENT_QC_COLUMNS, EXTRACT_QC_COLUMNS, FEATURE_COLUMNS, KEY_COLUMNS
from foldframe.sources import readers, writers
from foldframe.streaming.ingest import ingest_structures

TOY = [
    ("GLY", 1, "N", 0, 0, 0, 0.5), ("GLY", 1, "CA", 1, 0, 0, 0.5), ("GLY", 1, "C", 1.5, 1, 0, 0.5), ("GLY", 1, "O", 1.5, 2, 0, 0.5),
    ("ALA", 2, "N", 2.5, 1, 0, 0.7), ("ALA", 2, "CA", 3, 2, 0, 0.7), ("ALA", 2, "C", 4, 2, 0, 0.7), ("ALA", 2, "O", 4.5, 3, 0, 0.7), ("ALA", 2, "CB", 3, 2, 1.5, 0.7),
]


def atom(i, res, seq, name, x, y, z, b, kind="ATOM  ", alt=" ", chain="A", element=None):
    return f"{kind}{i:5d} {name:<4}{alt}{res} {chain}{seq:4d}    {x:8.3f}{y:8.3f}{z:8.3f}{1.0:6.2f}{b:6.2f}          {element or name[0]:>2}"


def lines(spark, rows, sid="toy.pdb"):
    return readers.structure_lines(spark.createDataFrame([(sid, "\n".join(rows))], "structure_id string, value string"))


def toy(spark):
    return lines(spark, [atom(i, *r) for i, r in enumerate(TOY)] + ["TER", "END"])


def proteins(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, protein_id string, entity_id string, sequence string, pdb_path string")


def test_parse_rules(spark):
    text = [atom(1, "MSE", 5, "N", 0, 0, 0, 1, kind="HETATM"), atom(2, "MSE", 5, "N", 9, 0, 0, 1), atom(3, "ALA", 5, "CA", 1, 0, 0, 1), atom(4, "GLY", 6, "CA", 1, 0, 0, 1, alt="B"), atom(5, "HOH", 7, "O", 1, 0, 0, 1), atom(6, "GLY", 8, "CA", 1, 0, 0, 1).replace("   1.000", "   1d   ", 1), "ATOM", atom(7, "GLY", 9, "CA", 2, 0, 0, 1, chain=" ")]
    atoms = structure.parse_atoms(lines(spark, text)).collect()
    got = {(a.resseq, a.name): a for a in atoms}
    assert set(got) == {(5, "N"), (5, "CA"), (9, "CA")}
    assert got[5, "N"].x == 9.0 and got[5, "N"].resname == got[5, "CA"].resname == "MSE" and got[9, "CA"].chain == "A"
    seq = structure.structure_sequences(structure.residues_of(structure.parse_atoms(lines(spark, text)))).first()
    assert (seq.pdb_sequence, seq.pdb_length) == ("MG", 2)


@pytest.fixture
def many_vectors(spark, tmp_path):
    """A folder with vectors whose residue numbers need more than four digits, in three groups of ids."""
    r = np.random.default_rng(11)
    ids = [*range(0, 60), *range(69_960, 70_060), *range(8_561_360, 8_561_420)]
    rows = [(i, [float(v) for v in r.normal(0, 0.1, 12)], k % 3) for k, i in enumerate(ids)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def sql_rows(name, folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    found = con.sql(queries.ORACLE_SQL[name])
    return found.columns, sorted(found.fetchall(), key=str)


@pytest.mark.parametrize("name", ["pdb_parse", "structure_sequences", "centroid_spread"])
def test_residue_numbers_beyond_four_digits(spark, many_vectors, name):
    columns, want = sql_rows(name, many_vectors)
    got = sorted((tuple(row) for row in queries.QUERIES[name](spark, many_vectors).select(*columns).collect()), key=str)
    assert got == want and len(want) > 2


def test_residue_fields(spark):
    numbers = [-999, -1, 0, 9_999, 10_000, 10_001, 1_223_055, 1_223_056, 2_436_111]
    df = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", sequences.residue_field(F.col("n")).alias("field"))
    got = df.select("n", "field", sequences.residue_number(F.col("field")).alias("back")).collect()
    assert [r.field for r in got] == ["-999", "-1", "0", "9999", "A000", "A001", "ZZZZ", "a000", "zzzz"] and [r.back for r in got] == numbers
    assert [r[0] for r in spark.createDataFrame([("A0a0",), ("  x ",), ("",)], "t string").select(sequences.residue_number(F.col("t"))).collect()] == [None] * 3
    with pytest.raises(Exception, match="2436112"):
        spark.createDataFrame([(2_436_112,)], "n long").select(sequences.residue_field(F.col("n"))).collect()


def test_toy_features(spark):
    table, qc = X.extract_features(proteins(spark, [("toy", "1", "GA", "toy.pdb"), ("gone", "1", "GA", "none.pdb"), ("far", "1", "WWWW", "toy.pdb")]), toy(spark))
    assert table.columns == KEY_COLUMNS + FEATURE_COLUMNS and len(table.columns) == 46 and qc.columns == EXTRACT_QC_COLUMNS
    rows = {(r.protein_id, r.sequence_pos_1based): r for r in table.collect()}
    gly, ala = rows["toy", 1], rows["toy", 2]
    assert (gly.sidechain_centroid_mask, gly.sidechain_geometry_mask, ala.sidechain_centroid_mask, ala.sidechain_geometry_mask, ala.chi1_mask) == (0, 0, 1, 1, 0)
    assert (gly.contact_count_4a, gly.contact_count_8a, gly.packing_density_8a, ala.packing_density_8a) == (1, 1, 5, 4)
    assert (ala.sidechain_centroid_x, ala.sidechain_centroid_y, ala.sidechain_centroid_z, ala.ca_to_sidechain_centroid_distance, ala.sidechain_spread) == (3, 2, 1.5, 1.5, 0)
    assert (gly.plddt, ala.plddt) == pytest.approx((0.5, 0.7)) and (gly.residue_chemical_class, ala.residue_chemical_class) == ("special", "hydrophobic")
    assert (gly.hydrophobic_contact_count, ala.hydrophobic_contact_count, gly.salt_bridge_count, gly.hydrogen_bond_count) == (1, 0, 0, 0)
    assert gly.sasa_mask == 1 and gly.core_surface_flag == "surface" and gly.dssp is None and gly.dssp_mask == 0
    assert ("gone", 1) not in rows and rows["far", 1].feature_valid_mask == 0 and rows["far", 1].chi1_mask is None
    q = {r.protein_id: r for r in qc.collect()}
    assert (q["toy"].alignment_status, q["gone"].alignment_reason, q["far"].alignment_status) == ("pass", "pdb_not_found", "fail")


def test_augment(spark):
    features = spark.createDataFrame([("missing", 1, 1), ("toy", 1, 1), ("toy", 2, 1)], "protein_id string, sequence_pos_1based int, feature_valid_mask int")
    m = proteins(spark, [("toy", "1", "WW", "other.pdb"), ("toy", "1", "GA", "toy.pdb")])  # the last row holds
    out, qc = X.augment_features(features, m, toy(spark))
    assert qc.columns == AUGMENT_QC_COLUMNS and sorted((r.protein_id, r.status, r.reason) for r in qc.collect()) == [("missing", "fail", "missing_manifest_row"), ("toy", "ok", "ok")]
    rows = {(r.protein_id, r.sequence_pos_1based): r for r in out.collect()}
    assert len(rows) == 3 and rows["toy", 2].sasa_mask == 1 and rows["missing", 1].sasa_mask is None


def test_grid_join_equals_brute_force(spark, partitions):
    r = np.random.default_rng(2)
    xyz = r.uniform(-15, 15, (300, 3))
    item = r.integers(0, 60, 300)
    df = spark.createDataFrame([("s", int(k), *map(float, p)) for k, p in zip(item, xyz, strict=True)], "structure_id string, residue int, x double, y double, z double")
    want = {}
    for a in range(300):
        for b in range(300):
            if item[a] < item[b] and (d := float(np.sqrt(((xyz[a] - xyz[b]) ** 2).sum()))) <= 8:
                want[int(item[a]), int(item[b])] = min(d, want.get((int(item[a]), int(item[b])), 99))
    for got in partitions(lambda: {(x.i, x.j): x.dist for x in structure.close_pairs(df, ["structure_id"], "residue").collect()}):
        assert got == pytest.approx(want)


def test_contacts_by_blocks_equal_brute_force(spark, partitions):
    r = np.random.default_rng(4)
    letters = "AVRKHDEFYSTGCNQW"
    rows, size = [], {}
    for i in range(150):
        atoms = [(k, f"C{k}", *(float(v) for v in r.normal(0, 9, 3).round(3)), 1.0, "H" if k == 3 else "C", False, True) for k in range(i % 5)]
        rows.append(("s", i, letters[i % len(letters)], atoms))
        size[i] = len(atoms)
    rows.append(("t", 0, "A", [(0, "CA", 0.0, 0.0, 0.0, 1.0, "C", False, True)]))
    df = spark.createDataFrame(rows, "structure_id string, residue int, aa string, atoms array<struct<first_line:int,name:string,x:double,y:double,z:double,bfactor:double,element:string,hetero:boolean,side:boolean>>")
    positive, negative, aromatic = "KRH", "DE", "FYWH"
    want = {("t", 0): [0] * 10}
    for _, i, a, mine in rows[:150]:
        near = []
        for _, j, b, other in rows[:150]:
            apart = [np.sqrt((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 + (p[4] - q[4]) ** 2) for p in mine for q in other if "H" not in (p[6], q[6])]
            if i != j and apart and min(apart) <= 8:
                near.append((min(apart), b, size[j]))
        salt = sum((a in positive and b in negative) or (a in negative and b in positive) for _, b, _ in near)
        pi = sum((a in positive and b in aromatic) or (a in aromatic and b in positive) for _, b, _ in near)
        want["s", i] = [sum(d <= v for d, _, _ in near) for v in (4, 6, 8)] + [sum(n for _, _, n in near)] + [sum(b in kind for _, b, _ in near) for kind in ("AVILMFYW", "STNQC", "DEKRH", "FYWH")] + [salt, pi]
    for block, span in ((7, 3), (1000, 4)):
        for got in partitions(lambda: {(x.structure_id, x.residue): list(x)[2:] for x in contacts.contact_features(df, block, span).collect()}):  # noqa: B023
            assert got == want


def test_contact_limits_are_those_of_the_rounded_root():
    for reach in (4.0, 6.0, 8.0):
        limit = contacts.square_limit(reach)
        assert np.sqrt(limit) <= reach < np.sqrt(np.nextafter(limit, np.inf))


@pytest.mark.parametrize("name", ["packing_density", "contacts_threshold", "interaction_counts"])
def test_contact_queries_beyond_four_digits(spark, many_vectors, name):
    columns, want = sql_rows(name, many_vectors)
    assert sorted((tuple(row) for row in queries.QUERIES[name](spark, many_vectors).select(*columns).collect()), key=str) == want


def test_disulfide_and_torsions(spark):
    rows = [atom(1, "CYS", 1, "N", 0, 0, 0, 1), atom(2, "CYS", 1, "CA", 1, 0, 0, 1), atom(3, "CYS", 1, "CB", 1, 1, 0, 1), atom(4, "CYS", 1, "SG", 1, 1, 1, 1), atom(5, "CYS", 9, "SG", 1, 1, 3, 1, chain="B"), atom(6, "LYS", 12, "NZ", 1, 4, 3, 1, chain="B"), atom(7, "ASP", 13, "OD1", 1, 5, 3, 1, chain="B")]
    atoms, residues = X.atoms_and_residues(lines(spark, rows))
    got = {r.residue: r for r in X.residue_features(atoms, residues, sasa=False).collect()}
    assert got[0].disulfide_flag == got[1].disulfide_flag == 1 and got[2].disulfide_flag == 0
    assert got[0].chi1_mask == 1 and abs(got[0].chi1_sin) == pytest.approx(1) and got[1].chi1_mask == 0 and got[1].chi1_sin is None
    assert got[2].salt_bridge_count == got[3].salt_bridge_count == 1


def test_areas():
    one = sasa.atom_areas(np.zeros((1, 3)), ["C"], 400)
    assert one[0] == pytest.approx(4 * np.pi * 3.1**2)
    two = sasa.atom_areas(np.array([[0, 0, 0], [3.1, 0, 0]]), ["C", "C"], 4000)
    assert two[0] == pytest.approx(4 * np.pi * 3.1**2 * 0.75, rel=0.01)  # a cap of height r/2 is hidden
    assert len(sasa.atom_areas(np.zeros((0, 3)), [])) == 0


def test_areas_of_crowded_atoms_equal_brute_force():
    r = np.random.default_rng(8)
    xyz, elements = r.normal(0, 2.5, (700, 3)).round(3), r.choice(["C", "N", "O", "S", "ZN"], 700).tolist()
    radius = np.array([sasa.RADII.get(e, sasa.OTHER_RADIUS) for e in elements]) + sasa.PROBE
    want = np.zeros(700)
    for i in range(700):
        near = np.flatnonzero((np.arange(700) != i) & (((xyz - xyz[i]) ** 2).sum(1) < (radius + radius[i]) ** 2))
        dots = xyz[i] + radius[i] * sasa.sphere_points(60)
        want[i] = (((dots[:, None] - xyz[near]) ** 2).sum(2) > radius[near] ** 2).all(1).mean() * 4 * np.pi * radius[i] ** 2
    assert np.array_equal(sasa.atom_areas(xyz, elements, 60), want) and (want > 0).any() and (want == 0).any()
    some = np.arange(700) % 3 == 0
    assert np.array_equal(sasa.atom_areas(xyz, elements, 60, some), np.where(some, want, 0))


def test_areas_of_crowded_atoms_look_at_few_neighbours(monkeypatch):
    """Four times the atoms in the same space: the distances looked at grow like the atoms, not like their square."""
    r, seen = np.random.default_rng(9), []
    near = sasa.Cells.near
    monkeypatch.setattr(sasa.Cells, "near", lambda self, i: (found := near(self, i), seen.append(len(found)))[0])
    sums = []
    for n in (2_000, 8_000):
        seen.clear()
        sasa.atom_areas(r.normal(0, 3, (n, 3)), ["C"] * n)
        sums.append(sum(seen))
    assert sums[1] < 8 * sums[0]


def test_paths(spark):
    m = spark.createDataFrame([("p", None, None), ("q", "/x/q.pdb", "a.pdb"), ("r", None, "sub/b.pdb"), ("t", None, "sub/c.pdb")], "protein_id string, pdb_path string, pdb_filename string")
    got = lambda df: {r.protein_id: r.pdb_path for r in df.collect()}
    assert got(readers.resolve_structure_paths(m, "/base")) == {"p": "/base/p.pdb", "q": "/x/q.pdb", "r": "/base/sub/b.pdb", "t": "/base/sub/c.pdb"}
    have = spark.createDataFrame([("/root/b.pdb",)], "structure_id string")
    assert got(readers.resolve_structure_paths(m, "/base", "/root", have)) == {"p": "/root/p.pdb", "q": "/x/q.pdb", "r": "/root/b.pdb", "t": "/root/sub/c.pdb"}


def test_areas_of_a_cut_structure_are_those_of_the_whole(spark):
    r = np.random.default_rng(5)
    points = r.uniform(-60, 60, (1500, 3))
    rows = [("s", i // 5, "A", f"C{i % 5}" if i % 7 else "CA", str(r.choice(["C", "N", "O", "S", "ZN"])), False, *map(float, xyz)) for i, xyz in enumerate(points)]
    rows += [("t", i, "G", "CA", "C", i == 2, float(i), 0.0, 0.0) for i in range(4)]
    atoms = spark.createDataFrame(rows, "structure_id string, residue int, aa string, name string, element string, hetero boolean, x double, y double, z double")
    whole = {(v.structure_id, v.residue): v for v in sasa.residue_areas(atoms, 40).collect()}
    parts = {(v.structure_id, v.residue): v for v in sasa.residue_areas(atoms, 40, large=100).collect()}
    assert whole.keys() == parts.keys() and len(whole) == 303
    assert all(abs(whole[k].total_sasa - parts[k].total_sasa) < 1e-9 and abs(whole[k].sidechain_sasa - parts[k].sidechain_sasa) < 1e-9 for k in whole)
    blocks = sasa.with_blocks(atoms, large=100, edge=30.0)
    assert blocks.where("own").count() == len(rows) and blocks.where("structure_id = 's'").groupBy("block").count().agg(F.max("count")).first()[0] < 120


def test_streaming_ingest_resumes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.pdb").write_text("\n".join(atom(i, *r) for i, r in enumerate(TOY)))
        ingest_structures(spark, str(tmp_path / "in"), str(tmp_path / "atoms"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "atoms")).groupBy("structure_id").agg(F.count("*").alias("n")).select("n").distinct().collect()[0].n == 9
    assert spark.read.parquet(str(tmp_path / "atoms")).count() == 18


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_commands_of_structures(spark, tmp_path, scheme, monkeypatch):
    """Plain paths and URIs; nested, absolute and missing files; commits of two proteins; resuming adds what is new and nothing twice."""
    text = "\n".join(atom(i, *r) for i, r in enumerate(TOY))
    root, away = tmp_path / "pdb", tmp_path / "away"
    (root / "sub").mkdir(parents=True)
    away.mkdir()
    for path in (root / "flat.pdb", root / "sub" / "deep.pdb", root / "p3.pdb", away / "x.ent", root / "late.pdb"):
        path.write_text(text)
    given = ["p0,GA,other/flat.pdb", "p1,GA,sub/deep.pdb", f"p2,GA,{away}/x.ent", "p3,GA,", "gone,GA,none.pdb"]
    manifest, out, qc, more = (f"{scheme}{tmp_path}/{n}" for n in ("m.csv", "features", "qc", "more"))
    command = ["extract-sidechain-features", "--manifest", manifest, "--out", out, "--out-qc", qc, "--pdb-root", f"{scheme}{root}", "--checkpoint-every", "2"]
    write = lambda lines: (tmp_path / "m.csv").write_text("protein_id,sequence,pdb_path\n" + "\n".join(lines) + "\n")

    def state():
        found, checked = (readers.read_table(spark, p) for p in (out, qc))
        return sorted((r.protein_id, int(r.sequence_pos_1based)) for r in found.collect()), sorted((r.protein_id, r.alignment_reason) for r in checked.collect())

    write(given)
    whole, writes = writers.write_part, []

    def failing(df, path, name):
        writes.append(path)
        if len(writes) == 4:  # the QC of the second commit, whose features are there
            raise OSError("disk gone")
        whole(df, path, name)

    monkeypatch.setattr(writers, "write_part", failing)
    with pytest.raises(OSError, match="disk gone"):
        cli.main(command, spark)
    monkeypatch.setattr(writers, "write_part", whole)
    assert len(state()[0]) == 8 and len(state()[1]) == 2
    cli.main([*command, "--resume"], spark)
    first = state()
    assert first == ([(f"p{i}", k) for i in range(4) for k in (1, 2)], [("gone", "pdb_not_found")] + [(f"p{i}", "ok") for i in range(4)])
    cli.main([*command, "--resume"], spark)
    assert state() == first
    write([*given, "p5,GA,late.pdb"])
    cli.main([*command, "--resume"], spark)
    assert state() == (first[0] + [("p5", 1), ("p5", 2)], first[1] + [("p5", "ok")])
    augment = ["augment-dssp-sasa", "--features", out, "--manifest", manifest, "--pdb-root", f"{scheme}{root}", "--out", more, "--out-qc", f"{more}-qc", "--checkpoint-every", "3"]
    for extra in ([], ["--resume"]):
        cli.main([*augment, *extra], spark)
        found = readers.read_table(spark, more)
        assert found.count() == 10 and {r.sasa_mask for r in found.collect()} == {"1"} and readers.read_table(spark, f"{more}-qc").count() == 5
    cli.main(command, spark)  # from the start again
    assert state() == (first[0] + [("p5", 1), ("p5", 2)], first[1] + [("p5", "ok")])
    (tmp_path / "l.csv").write_text("protein_id,sequence_pos_1based,label,eval_mask\np0,1,1,1\np5,2,0,1\n")
    cli.main(["build-dataset", "--features", more, "--labels", str(tmp_path / "l.csv"), "--out", str(tmp_path / "data")], spark)
    assert readers.read_table(spark, str(tmp_path / "data")).where("eval_mask = 1").count() == 2
