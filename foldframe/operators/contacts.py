"""Contact, packing and interaction counts of residues, by blocks of residues: pairs are counted, never made into rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chemistry import SETS, in_set
from .structure import REACH

#: Residues of a block, and blocks whose residues are held beside one as its neighbours.
BLOCK, SPAN = 8_192, 4
#: Distances that are looked at together.
CELLS = 262_144

THRESHOLDS = (4.0, 6.0, REACH)
# What is summed over the neighbours of a residue: letters in a set.
KINDS = {name: SETS[name] for name in ("hydrophobic", "polar", "charged", "aromatic", "positive", "negative")} | {"positive_or_aromatic": SETS["positive"] | SETS["aromatic"]}
COUNTS = [f"contact_count_{r:.0f}a" for r in THRESHOLDS] + ["packing_density_8a", *KINDS]


def square_limit(reach: float) -> float:
    """The largest square whose root, as a double, is within ``reach``."""
    limit = np.float64(reach) ** 2
    while np.sqrt(np.nextafter(limit, np.inf)) <= reach:
        limit = np.nextafter(limit, np.inf)
    return float(limit)


class Residues:
    """Residues by falling number of atoms, so that those with a k-th atom are the first ones."""

    def __init__(self, residue: np.ndarray, starts: np.ndarray, xyz: np.ndarray, values: np.ndarray | None = None):
        size = np.diff(starts)
        order = np.argsort(-size, kind="stable")
        self.residue, self.values = residue[order], None if values is None else values[order]
        first, size = starts[:-1][order], size[order]
        #: For each k, the k-th atoms.
        self.layers = [xyz[first[: np.searchsorted(-size, -k)] + k] for k in range(size[0] if len(size) else 0)]
        self.low, self.high = (f.reduceat(xyz, starts[:-1])[order] if len(size) else xyz for f in (np.minimum, np.maximum))

    def near(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return ((self.low <= high + REACH) & (self.high >= low - REACH)).all(1)


def least_squares(mine: Residues, others: list[list[np.ndarray]]) -> np.ndarray:
    """The least squared distance of the atoms of each residue to those of each other one, x, y and z of which are apart."""
    best = None
    for here in mine.layers:
        for there in others:
            total = here[:, :1] - there[0]
            total *= total
            step = np.empty_like(total)
            for c in (1, 2):
                np.subtract(here[:, c, None], there[c], out=step)
                step *= step
                total += step
            if best is None:
                best = total
            else:
                part = best[: len(here), : len(there[0])]
                np.minimum(part, total, out=part)
    return best


def count_contacts(residue: np.ndarray, starts: np.ndarray, xyz: np.ndarray, others: Residues) -> np.ndarray:
    """For each residue the ``COUNTS`` over ``others``; its own atoms are xyz[starts[k]:starts[k + 1]]."""
    out = np.zeros((len(residue), len(COUNTS)), np.int64)
    limits, rows = [square_limit(r) for r in THRESHOLDS], int(np.clip(CELLS // max(1, len(others.residue)), 8, 64))
    for at in range(0, len(residue), rows):
        end = min(at + rows, len(residue))
        atoms = xyz[starts[at] : starts[end]]
        mine = Residues(np.arange(at, end), starts[at : end + 1] - starts[at], atoms)
        near = others.near(atoms.min(0), atoms.max(0))
        if not near.any():
            continue
        best = least_squares(mine, [[np.compress(near[: len(layer)], layer[:, c]) for c in range(3)] for layer in others.layers])
        best[residue[mine.residue][:, None] == others.residue[near]] = np.inf
        met = best <= limits[2]
        # Sums of a block stay below 2 ** 24, so they are whole in 32 bits.
        out[mine.residue] = np.column_stack([np.count_nonzero(best <= v, axis=1) for v in limits[:2]] + [np.count_nonzero(met, axis=1), np.rint(met.astype(np.float32) @ others.values[near])])
    return out


def _side(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residue numbers, first atoms and coordinates."""
    xyz = part.column("xyz").combine_chunks()
    starts = np.concatenate([[0], np.cumsum(xyz.value_lengths().to_numpy(zero_copy_only=False))]) // 3
    return part.column("residue").to_numpy(), starts, xyz.flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)


def _count(part: pa.Table) -> pa.Table:
    """Counts of the residues of one block over those of one span of blocks."""
    sides = [part.filter(pc.equal(part.column("own"), own)).sort_by("residue") for own in (True, False)]
    letters = sides[1].column("aa").to_pylist()
    values = np.array([sides[1].column("n_atoms").to_numpy(), *([a in kind for a in letters] for kind in KINDS.values())], np.float32).T
    others = Residues(*_side(sides[1]), values)
    residue, starts, xyz = _side(sides[0])
    found = count_contacts(residue, starts, xyz, others)
    columns = {"structure_id": sides[0].column("structure_id"), "residue": pa.array(residue, pa.int32())} | {name: pa.array(found[:, k]) for k, name in enumerate(COUNTS)}
    return pa.table(columns)


def contact_features(residues: DataFrame, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """Contact, packing and interaction counts; residues without neighbours count 0.

    Two residues are as far apart as their closest heavy atoms, over all chains of a structure.  Residues are cut into
    blocks in the order of the file; a block meets the spans of blocks whose boxes are near its own, and a task holds one
    block and one span.  So memory is bounded however many pairs there are, and rows grow with residues, not with pairs.
    """
    xyz = F.flatten(F.transform(F.filter("atoms", lambda a: a["element"] != "H"), lambda a: F.array(*(a[c] for c in "xyz"))))
    rows = residues.select("structure_id", F.col("residue").cast("int").alias("residue"), "aa", F.size("atoms").alias("n_atoms"), xyz.alias("xyz")).where(F.size("xyz") > 0)
    rows = rows.withColumn("_b", F.floor(F.col("residue") / block).cast("int")).withColumn("_s", F.floor(F.col("residue") / (block * span)).cast("int"))
    along = lambda k: F.filter("xyz", lambda v, i: i % 3 == k)
    ends = [f"{end}{k}" for k in range(3) for end in ("low", "high")]
    boxes = rows.select("structure_id", "_b", "_s", *(f(along(k)).alias(f"{end}{k}") for k in range(3) for end, f in (("low", F.array_min), ("high", F.array_max))))
    box = lambda by: boxes.groupBy("structure_id", by).agg(*((F.min if c.startswith("low") else F.max)(c).alias(c) for c in ends))
    spans = box("_s").withColumnsRenamed({c: f"_{c}" for c in ends})
    near = [(F.col(f"low{k}") <= F.col(f"_high{k}") + REACH) & (F.col(f"high{k}") >= F.col(f"_low{k}") - REACH) for k in range(3)]
    meets = box("_b").join(spans, "structure_id").where(near[0] & near[1] & near[2]).select("structure_id", "_b", "_s")
    sides = rows.drop("_s").join(meets, ["structure_id", "_b"]).withColumn("own", F.lit(True)).unionByName(rows.drop("_b").join(meets, ["structure_id", "_s"]).withColumn("own", F.lit(False)))
    # Work grows with pairs, not with bytes, so groups are dealt over all partitions, which adaptive execution would join.
    keys, width = ["structure_id", "_b", "_s"], int(residues.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = sides.repartition(width, *keys).groupBy(*keys).applyInArrow(_count, "structure_id string, residue int, " + ", ".join(f"{c} long" for c in COUNTS))
    summed = parts.groupBy("structure_id", "residue").agg(*(F.sum(c).alias(c) for c in COUNTS))
    df = residues.select("structure_id", "residue", "aa").join(summed, ["structure_id", "residue"], "left").fillna(0, COUNTS)
    positive, negative, aromatic = (in_set(F.col("aa"), name) for name in ("positive", "negative", "aromatic"))
    salt = F.when(positive, F.col("negative")).when(negative, F.col("positive")).otherwise(0)
    pi = F.when(positive & aromatic, F.col("positive_or_aromatic")).when(positive, F.col("aromatic")).when(aromatic, F.col("positive")).otherwise(0)
    names = [F.col(c).alias(f"{c}_contact_count") for c in ("hydrophobic", "polar", "charged", "aromatic")]
    return df.select("structure_id", "residue", *COUNTS[:4], *names, salt.alias("salt_bridge_count"), pi.alias("cation_pi_count"))
