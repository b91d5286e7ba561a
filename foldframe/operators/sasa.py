"""Solvent-accessible area by sphere points (Shrake and Rupley 1973), one structure at a time in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chemistry import BACKBONE, max_asa

# Van der Waals radii in angstrom.
RADII = {"H": 1.2, "C": 1.7, "N": 1.55, "O": 1.52, "F": 1.47, "P": 1.8, "S": 1.8, "SE": 1.9, "CL": 1.75}
OTHER_RADIUS, PROBE = 2.0, 1.4

#: Atoms beyond which a structure is cut, and the edge of its cubes in angstrom (some 11,000 atoms of a protein).
LARGE, EDGE = 20_000, 48.0
#: Mean atoms of a cell above which a finer grid is laid, and neighbours that the dots of an atom meet at once.
CROWD, CHUNK = 4, 32


def sphere_points(n: int) -> np.ndarray:
    """``n`` points spread over the unit sphere along a golden spiral."""
    k = np.arange(n)
    z = 1 - (2 * k + 1) / n
    turn = k * np.pi * (3 - np.sqrt(5))
    r = np.sqrt(1 - z * z)
    return np.stack([r * np.cos(turn), r * np.sin(turn), z], 1)


class Cells:
    """Atoms by cubes of an edge; the atoms of a cube and of the 26 around it are found once."""

    def __init__(self, xyz: np.ndarray, edge: float):
        self.cell = np.floor(xyz / edge).astype(int)
        order = np.lexsort(self.cell.T)
        starts = np.flatnonzero(np.r_[True, (np.diff(self.cell[order], axis=0) != 0).any(1)])
        self.where = dict(zip(map(tuple, self.cell[order[starts]].tolist()), np.split(order, starts[1:]), strict=True))
        self.around: dict[tuple, np.ndarray] = {}

    def near(self, i: int) -> np.ndarray:
        a, b, c = at = tuple(self.cell[i].tolist())
        if at not in self.around:
            self.around[at] = np.concatenate([self.where[k] for x in (a - 1, a, a + 1) for y in (b - 1, b, b + 1) for z in (c - 1, c, c + 1) if (k := (x, y, z)) in self.where])
        return self.around[at]


def atom_areas(xyz: np.ndarray, elements: list[str], points: int = 100, wanted: np.ndarray | None = None) -> np.ndarray:
    """Accessible area of each atom (of those ``wanted``, others have 0).

    Neighbours come from grids of cells, finest first: a dot that one neighbour covers is not looked at again, so an atom
    that is shut in by the next few ends there, and only what is left free meets all that can touch it.
    """
    radius = np.array([RADII.get(e, OTHER_RADIUS) for e in elements]) + PROBE
    out = np.zeros(len(xyz))
    if not len(xyz):
        return out
    edge, sphere = 2 * radius.max(), sphere_points(points)
    grids = [Cells(xyz, edge)]
    while len(xyz) > CROWD * len(grids[-1].where) and edge > 0.1:
        edge /= 2
        grids.append(Cells(xyz, edge))
    for i in range(len(xyz)) if wanted is None else np.flatnonzero(wanted).tolist():
        dots = xyz[i] + radius[i] * sphere
        for grid in reversed(grids):
            near = grid.near(i)
            near = near[near != i]
            apart = ((xyz[near] - xyz[i]) ** 2).sum(1)
            touch = apart < (radius[near] + radius[i]) ** 2
            near = near[touch][np.argsort(apart[touch], kind="stable")]
            for k in range(0, len(near), CHUNK):
                part = near[k : k + CHUNK]
                dots = dots[(((dots[:, None] - xyz[part]) ** 2).sum(2) > radius[part] ** 2).all(1)]
                if not len(dots):
                    break
            if not len(dots):
                break
        out[i] = len(dots) / points * 4 * np.pi * radius[i] ** 2
    return out


def with_blocks(atoms: DataFrame, large: int = LARGE, edge: float = EDGE) -> DataFrame:
    """``atoms`` with the ``block`` in which each is needed, and whether it is ``own`` there.

    A structure of up to ``large`` atoms is one block.  A larger one is cut into cubes; an atom is its own cube's, and is
    copied to those that it is so near to that it could touch an atom there, which at most seven are.
    """
    sizes = atoms.groupBy("structure_id").agg((F.count("*") > large).alias("_cut"))
    halo = 2 * (max(*RADII.values(), OTHER_RADIUS) + PROBE)
    cut = atoms.join(sizes, "structure_id")
    cell = lambda c, shift=0.0: F.floor((F.col(c) + shift) / edge).cast("long")
    for c in "xyz":
        cut = cut.withColumn(f"_b{c}", F.explode(F.when(F.col("_cut"), F.sequence(cell(c, -halo), cell(c, halo))).otherwise(F.array(F.lit(0).cast("long")))))
    own = ~F.col("_cut") | ((F.col("_bx") == cell("x")) & (F.col("_by") == cell("y")) & (F.col("_bz") == cell("z")))
    return cut.withColumn("own", own).withColumn("block", F.struct("_bx", "_by", "_bz")).drop("_cut", "_bx", "_by", "_bz")


def residue_areas(atoms_with_residue: DataFrame, points: int = 100, large: int = LARGE) -> DataFrame:
    """structure_id, residue, total_sasa, sidechain_sasa, relative_sasa, core_surface_flag; hetero residues have none.

    An atom's area depends on the atoms that it can touch alone, so blocks of a large structure give what the whole does.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["residue", "name"])
        area = atom_areas(group[["x", "y", "z"]].to_numpy(float), group.element.tolist(), points, group.own.to_numpy(bool))
        return group[["structure_id", "residue", "aa", "name", "element", "hetero"]].assign(area=area)[group.own.to_numpy(bool)]

    atoms = with_blocks(atoms_with_residue.select("structure_id", "residue", "aa", "name", "element", "hetero", "x", "y", "z"), large)
    # Work is not in proportion to bytes, so blocks are dealt over all partitions, which adaptive execution would join.
    width = int(atoms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = atoms.repartition(width, "structure_id", "block").groupBy("structure_id", "block").applyInPandas(one, "structure_id string, residue int, aa string, name string, element string, hetero boolean, area double")
    heavy = rows.where("element <> 'H' and not hetero")
    summed = heavy.groupBy("structure_id", "residue", "aa").agg(F.sum("area").alias("total_sasa"), F.coalesce(F.sum(F.when(~F.col("name").isin(*BACKBONE), F.col("area"))), F.lit(0.0)).alias("sidechain_sasa"))
    share = F.col("total_sasa") / max_asa(F.col("aa"))
    return summed.withColumn("relative_sasa", share).withColumn("core_surface_flag", F.when(share < 0.2, "core").otherwise("surface")).drop("aa")
