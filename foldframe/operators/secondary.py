"""Secondary structure from backbone hydrogen bonds (Kabsch and Sander 1983), as joins and windows over residues.

A hydrogen is placed on every backbone nitrogen, the energy of each near pair of a carbonyl and an amide decides which
are bonded, and bonds make turns and bridges.  Turns make helices, bridges (and the bulges between them) make strands.
Pairs come from the grid join of ``structure.close_pairs``, patterns from equi-joins of bonds with bonds, so a structure
of any size is dealt over tasks; only the order of residues along a structure is a window over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import distance
from ..sources.shared import checkpointed
from .structure import both_ways, close_pairs

# Partial charges times the factor of the energy in kcal/mol, bounds of a bond and of the search, in angstrom.
COUPLING, BONDED, STRONGEST = 0.42 * 0.20 * 332, -0.5, -9.9
NEAR, TOUCHING, LONGEST_BOND, NH_LENGTH = 9.0, 0.5, 2.5, 1.0
BEST = 2  # bonds of an amide


def backbone(residues: DataFrame, longest_bond: float = LONGEST_BOND) -> DataFrame:
    """structure_id, residue, n, ca, c, o, h, segment, inner of the residues that have all four backbone atoms.

    A segment ends where the next residue is of another chain, lacks an atom, or is too far away.  ``h`` is null for
    the first residue of a segment and for proline; ``inner`` is true between two others of the segment.
    """
    point = lambda name: F.element_at("_by", name)
    by = F.map_from_entries(F.transform("atoms", lambda a: F.struct(a["name"], F.struct(a["x"].alias("x"), a["y"].alias("y"), a["z"].alias("z")))))
    rows = residues.select("structure_id", "chain", "residue", "resname", by.alias("_by")).select("structure_id", "chain", "residue", "resname", *(point(a.upper()).alias(a) for a in ("n", "ca", "c", "o")))
    along = Window.partitionBy("structure_id").orderBy("residue")
    last = F.lag(F.struct("chain", "residue", "c", "o")).over(along)
    rows = rows.dropna(subset=["n", "ca", "c", "o"]).withColumn("_p", last)
    bonded = F.coalesce((F.col("_p.chain") == F.col("chain")) & (F.col("_p.residue") + 1 == F.col("residue")) & (distance(F.col("_p.c"), F.col("n")) <= longest_bond), F.lit(False))
    rows = rows.withColumn("_bonded", bonded)
    co = distance(F.col("_p.c"), F.col("_p.o"))
    place = F.struct(*((F.col(f"n.{x}") + NH_LENGTH * (F.col(f"_p.c.{x}") - F.col(f"_p.o.{x}")) / co).alias(x) for x in "xyz"))
    rows = rows.withColumn("h", F.when(F.col("_bonded") & (F.col("resname") != "PRO") & (co > 0), place))
    rows = rows.withColumn("segment", F.sum((~F.col("_bonded")).cast("int")).over(along)).withColumn("inner", F.col("_bonded") & F.coalesce(F.lead("_bonded").over(along), F.lit(False)))
    return rows.select("structure_id", "residue", "n", "ca", "c", "o", "h", "segment", "inner")


def bond_energy(o: Column, c: Column, n: Column, h: Column) -> Column:
    """Energy in kcal/mol of a carbonyl (``c``, ``o``) and an amide (``n``, ``h``); atoms that touch have the strongest."""
    apart = [distance(o, n), distance(c, h), distance(o, h), distance(c, n)]
    energy = COUPLING * (1 / apart[0] + 1 / apart[1] - 1 / apart[2] - 1 / apart[3])
    return F.when(F.least(*apart) < TOUCHING, STRONGEST).otherwise(energy)


def bond_energies(chain: DataFrame) -> DataFrame:
    """(structure_id, acceptor, donor, energy) of every pair of residues with near CA atoms, but a donor's own and last
    neighbour along the chain.  ``chain`` is a written ``backbone`` table."""
    cas = chain.select("structure_id", "residue", "ca.*")
    pairs = both_ways(close_pairs(cas, ["structure_id"], "residue", NEAR)).select("structure_id", F.col("i").alias("acceptor"), F.col("j").alias("donor"))
    donors = chain.where("h is not null").select("structure_id", F.col("residue").alias("donor"), F.col("n").alias("dn"), F.col("h").alias("dh"))
    acceptors = chain.select("structure_id", F.col("residue").alias("acceptor"), F.col("c").alias("ac"), F.col("o").alias("ao"))
    met = pairs.where("acceptor <> donor - 1").join(donors, ["structure_id", "donor"]).join(acceptors, ["structure_id", "acceptor"])
    return met.select("structure_id", "acceptor", "donor", bond_energy(F.col("ao"), F.col("ac"), F.col("dn"), F.col("dh")).alias("energy"))


def hydrogen_bonds(chain: DataFrame) -> DataFrame:
    """(structure_id, acceptor, donor): of each amide the two best bonds."""
    rank = F.row_number().over(Window.partitionBy("structure_id", "donor").orderBy("energy", "acceptor"))
    return bond_energies(chain).where(F.col("energy") < BONDED).withColumn("_rank", rank).where(F.col("_rank") <= BEST).select("structure_id", "acceptor", "donor")


def helices(bonds: DataFrame, chain: DataFrame, n: int) -> DataFrame:
    """(structure_id, start, residue): the ``n`` residues from every second of two turns in a row."""
    part = chain.select("structure_id", "residue", "segment")
    ends = lambda name: part.select("structure_id", F.col("residue").alias(name), F.col("segment").alias(f"_{name}"))
    turns = bonds.where(F.col("donor") == F.col("acceptor") + n).join(ends("acceptor"), ["structure_id", "acceptor"]).join(ends("donor"), ["structure_id", "donor"])
    turns = turns.where("_acceptor = _donor").select("structure_id", F.col("acceptor").alias("start"))
    second = turns.join(turns.select("structure_id", (F.col("start") + 1).alias("start")), ["structure_id", "start"])
    return second.select("structure_id", "start", F.explode(F.sequence(F.col("start"), F.col("start") + n - 1)).alias("residue"))


def bridges(bonds: DataFrame, chain: DataFrame) -> DataFrame:
    """(structure_id, i, j, turn) with i < j: bridge partners; ``turn`` is 1 in parallel and -1 in antiparallel strands."""
    a, d = F.col("acceptor"), F.col("donor")
    probe = lambda i, j, turn, accepts, gives: F.struct(i.alias("i"), j.alias("j"), F.lit(turn).alias("turn"), accepts.alias("acceptor"), gives.alias("donor"))
    probes = F.array(probe(a, d, -1, d, a), probe(a + 1, d - 1, -1, d - 2, a + 2), probe(a + 1, d, 1, d, a + 2))
    found = bonds.select("structure_id", F.explode(probes).alias("p")).select("structure_id", "p.*").join(bonds, ["structure_id", "acceptor", "donor"], "left_semi")
    found = found.select("structure_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "turn").where("j - i >= 3").distinct()
    inner = chain.where("inner").select("structure_id", "residue", "segment")
    for side in "ij":
        found = found.join(inner.select("structure_id", F.col("residue").alias(side), F.col("segment").alias(f"segment_{side}")), ["structure_id", side])
    return found


def strands(met: DataFrame) -> DataFrame:
    """(structure_id, residue) of bridge partners, and of the residues of a bulge: between two bridges of one kind and
    direction with at most one residue more on one side and at most four on the other."""
    steps = [(x, y) for x in range(1, 6) for y in range(1, 6) if (x, y) != (1, 1) and min(x, y) <= 2]
    step = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps)))
    keys = ["structure_id", "segment_i", "segment_j", "turn", "i", "j"]
    ahead = met.select("structure_id", "segment_i", "segment_j", "turn", F.col("i").alias("i0"), F.col("j").alias("j0"), step.alias("s"))
    ahead = ahead.withColumn("i", F.col("i0") + F.col("s.x")).withColumn("j", F.col("j0") + F.col("turn") * F.col("s.y")).where("i < j")
    linked = ahead.join(met.select(*keys), keys, "left_semi")
    between = F.concat(F.sequence("i0", "i"), F.sequence(F.least("j0", "j"), F.greatest("j0", "j")))
    own = met.select("structure_id", F.explode(F.array("i", "j")).alias("residue"))
    return own.unionByName(linked.select("structure_id", F.explode(between).alias("residue"))).distinct()


def assign(residues: DataFrame) -> DataFrame:
    """(structure_id, residue, dssp): H, E or C for every residue that has all four backbone atoms; others have no row.

    An alpha helix comes before a strand, a strand before helices of three and of five, which count only where all of
    their residues are free.  An empty table has no rows.
    """
    chain = checkpointed(backbone(residues))
    bonds = checkpointed(hydrogen_bonds(chain))
    key = ["structure_id", "residue"]
    codes = helices(bonds, chain, 4).select(*key).distinct().withColumn("code", F.lit("H"))
    flat = strands(checkpointed(bridges(bonds, chain)))
    codes = checkpointed(codes.unionByName(flat.join(codes, key, "left_anti").withColumn("code", F.lit("E"))))
    for n in (3, 5):
        taken = codes.select(*key, F.lit(1).alias("_taken"))
        turns = helices(bonds, chain, n).join(taken, key, "left")
        free = turns.groupBy("structure_id", "start").agg(F.count("_taken").alias("k"), F.collect_list("residue").alias("r")).where("k = 0")  # n residues at most
        codes = checkpointed(codes.unionByName(free.select("structure_id", F.explode("r").alias("residue")).distinct().withColumn("code", F.lit("H"))))
    return chain.select(*key).join(codes, key, "left").select(*key, F.coalesce("code", F.lit("C")).alias("dssp"))
