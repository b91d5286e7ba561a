"""Fixed-width structure text to atoms, residues, close pairs and per-residue geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chemistry import BACKBONE, THREE_TO_ONE, chi_atoms, one_letter
from ..functions.sequences import dihedral, residue_number

FLOAT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
REACH = 8.0  # no threshold is larger


def _number(text: Column) -> Column:
    return F.when(text.rlike(FLOAT), F.trim(text)).try_cast("double")


def parse_atoms(lines: DataFrame) -> DataFrame:
    """Atoms of structures given as (structure_id, line_no, line).

    One row per (structure, residue, atom name): of repeated names the last line's values at the first line's place;
    a residue's name is that of its first line.  Residue numbers from 10,000 on are hybrid-36 (A000 to zzzz).  Lines
    with a number that cannot be read are left out.
    """
    at = lambda start, size: F.substring("line", start, size)
    resname = F.upper(F.trim(at(18, 3)))
    rows = lines.where(F.substring("line", 1, 6).isin("ATOM  ", "HETATM") & F.trim(at(17, 1)).isin("", "A") & resname.isin(*THREE_TO_ONE))
    name = F.trim(at(13, 4))
    rows = rows.select(
        "structure_id", "line_no", name.alias("name"), resname.alias("resname"), F.coalesce(F.nullif(F.trim(at(22, 1)), F.lit("")), F.lit("A")).alias("chain"),
        residue_number(at(23, 4)).alias("resseq"), F.trim(at(27, 1)).alias("icode"),
        *(_number(at(s, n)).alias(c) for c, s, n in (("x", 31, 8), ("y", 39, 8), ("z", 47, 8), ("bfactor", 61, 6))),
        F.upper(F.coalesce(F.nullif(F.trim(at(77, 2)), F.lit("")), F.substring(name, 1, 1))).alias("element"), (F.substring("line", 1, 6) == "HETATM").alias("hetero"),
    ).dropna(subset=["resseq", "x", "y", "z", "bfactor"])
    residue = ["structure_id", "chain", "resseq", "icode"]
    atoms = rows.groupBy(*residue, "name").agg(F.max_by(F.struct("x", "y", "z", "bfactor", "element", "hetero"), "line_no").alias("v"), F.min("line_no").alias("first_line"), F.min_by("resname", "line_no").alias("resname"))
    own = Window.partitionBy(*residue)
    return atoms.withColumn("resname", F.first("resname").over(own.orderBy("first_line"))).withColumn("residue_line", F.min("first_line").over(own)).select(*residue, "resname", "residue_line", "first_line", "name", "v.*")


def residues_of(atoms: DataFrame) -> DataFrame:
    """Residues with their index in the structure, letter, and atoms as an array in file order."""
    side = ~F.col("name").isin(*BACKBONE) & (F.col("element") != "H")
    atom = F.struct("first_line", "name", "x", "y", "z", "bfactor", "element", "hetero", side.alias("side"))
    grouped = atoms.groupBy("structure_id", "chain", "resseq", "icode", "resname", "residue_line").agg(F.array_sort(F.collect_list(atom)).alias("atoms"), F.max("hetero").alias("hetero"))
    index = F.row_number().over(Window.partitionBy("structure_id").orderBy("residue_line")) - 1
    return grouped.withColumn("residue", index).withColumn("aa", one_letter(F.col("resname"))).withColumn("residue_id", F.concat("chain", F.lit(":"), F.col("resseq").cast("string"), "icode")).drop("residue_line")


def structure_sequences(residues: DataFrame) -> DataFrame:
    """structure_id, sequence over all chains, number of residues."""
    letters = F.array_sort(F.collect_list(F.struct("residue", "aa")))
    return residues.groupBy("structure_id").agg(F.concat_ws("", F.transform(letters, lambda s: s["aa"])).alias("pdb_sequence"), F.count("*").cast("int").alias("pdb_length"))


def close_pairs(points: DataFrame, keys: list[str], item: str, reach: float = REACH) -> DataFrame:
    """(keys, i, j, dist): least distance of every two items (i < j) within ``reach``, by a grid join.

    Space is cut into cubes of edge ``reach``; one side is sent to the 27 cubes around it, so that points meet by an
    equality of cubes, never all with all.
    """
    cell = [F.floor(F.col(c) / reach).cast("int").alias(f"_c{c}") for c in "xyz"]
    base = points.select(*keys, F.col(item).alias("_item"), "x", "y", "z", *cell)
    offsets = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip("abc", (a, b, c), strict=True))) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1))))
    left = base.select(*keys, F.col("_item").alias("i"), *(F.col(c).alias(f"{c}1") for c in "xyz"), "_cx", "_cy", "_cz", offsets.alias("_o"))
    left = left.select(*keys, "i", "x1", "y1", "z1", (F.col("_cx") + F.col("_o.a")).alias("_cx"), (F.col("_cy") + F.col("_o.b")).alias("_cy"), (F.col("_cz") + F.col("_o.c")).alias("_cz"))
    right = base.select(*keys, F.col("_item").alias("j"), *(F.col(c).alias(f"{c}2") for c in "xyz"), "_cx", "_cy", "_cz")
    d = F.sqrt(sum(((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in "xyz"), F.lit(0.0)))
    met = left.join(right, [*keys, "_cx", "_cy", "_cz"]).where("i < j").withColumn("dist", d).where(F.col("dist") <= reach)
    return met.groupBy(*keys, "i", "j").agg(F.min("dist").alias("dist"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(*(F.col({"i": "j", "j": "i"}.get(c, c)).alias(c) for c in pairs.columns)))


def disulfides(atoms_with_residue: DataFrame, reach: float = 2.3) -> DataFrame:
    """(structure_id, residue) of cysteines whose SG is within ``reach`` of another's."""
    sg = atoms_with_residue.where("aa = 'C' and name = 'SG'")
    return both_ways(close_pairs(sg, ["structure_id"], "residue", reach)).select("structure_id", F.col("i").alias("residue"), F.lit(1).alias("disulfide_flag")).distinct()


def geometry_features(residues: DataFrame) -> DataFrame:
    """Side-chain centroid and spread, CA distance, mean B factor, and torsions, from a residue's own atoms."""
    side = F.filter("atoms", lambda a: a["side"])
    mean = lambda arr, c: F.aggregate(arr, F.lit(0.0), lambda acc, a: acc + a[c]) / F.size(arr)
    df = residues.withColumn("_side", side).withColumn("_by", F.map_from_entries(F.transform("atoms", lambda a: F.struct(a["name"], F.struct(a["x"].alias("x"), a["y"].alias("y"), a["z"].alias("z"))))))
    has = (F.size("_side") > 0) & (F.col("aa") != "G")
    for c in "xyz":
        df = df.withColumn(f"sidechain_centroid_{c}", F.when(has, mean(F.col("_side"), c)))
    centre = {c: F.col(f"sidechain_centroid_{c}") for c in "xyz"}
    square = lambda p: sum(((p[c] - centre[c]) * (p[c] - centre[c]) for c in "xyz"), F.lit(0.0))
    ca = F.element_at("_by", "CA")
    df = df.withColumn("sidechain_spread", F.when(has, F.sqrt(F.aggregate("_side", F.lit(0.0), lambda acc, a: acc + square(a)) / F.size("_side"))))
    df = df.withColumn("ca_to_sidechain_centroid_distance", F.when(has, F.sqrt(square(ca)))).withColumn("sidechain_centroid_mask", has.cast("int")).withColumn("sidechain_geometry_mask", (has & ca.isNotNull()).cast("int"))
    df = df.withColumn("sidechain_heavy_atom_count", F.size("_side")).withColumn("plddt", mean(F.col("atoms"), "bfactor"))
    for k in range(1, 5):
        points = F.transform(chi_atoms(F.col("resname"), k), lambda n: F.element_at("_by", n))
        df = df.withColumn("_p", F.when(~F.exists(points, lambda p: p.isNull()), points))
        angle = dihedral([tuple(F.get("_p", F.lit(i))[c] for c in "xyz") for i in range(4)])
        df = df.withColumn("_angle", angle).withColumn(f"chi{k}_sin", F.sin("_angle")).withColumn(f"chi{k}_cos", F.cos("_angle")).withColumn(f"chi{k}_mask", F.col("_p").isNotNull().cast("int"))
    return df.drop("_side", "_by", "_p", "_angle", "atoms")
