"""Per-residue feature tables aligned to manifest sequences, and their augmentation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chemistry import chemical_class
from ..functions.sequences import c_tag_length, clean_sequence, entity_after_marker, n_tag_length, render_tags
from ..schemas import AUGMENT_QC_COLUMNS, EXTRACT_QC_COLUMNS, as_features, only, require_columns
from ..sources.shared import checkpointed
from .align import evaluate_alignments
from .contacts import contact_features
from .rows import one_per_key
from .sasa import residue_areas
from .structure import disulfides, geometry_features, parse_atoms, residues_of, structure_sequences

NO_DSSP = "dssp_failed:ModuleNotFoundError"
NO_SASA = "sasa_failed:ModuleNotFoundError"
#: A secondary-structure back end maps residues to (structure_id, residue, dssp); without one every code is missing.
Backend = Callable[[DataFrame], DataFrame]


def with_protein(manifest: DataFrame) -> DataFrame:
    require_columns(manifest, {"protein_id", "sequence"}, "Manifest missing required columns")
    pid = F.col("protein_id").cast("string")
    entity = F.col("entity_id").cast("string") if "entity_id" in manifest.columns else entity_after_marker(pid)
    keep = [c for c in ("pdb_path", "ord") if c in manifest.columns]
    return manifest.select(pid.alias("protein_id"), entity.alias("entity_id"), clean_sequence(F.col("sequence")).alias("sequence"), *keep)


def atoms_and_residues(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(atoms with their residue, residues), both read from one table: the text is parsed once for all features."""
    residues = checkpointed(residues_of(parse_atoms(lines)))
    return residues.select("structure_id", "chain", "resseq", "icode", "resname", "residue", "aa", F.explode("atoms").alias("_a")).select("*", "_a.*").drop("_a"), residues


def residue_features(atoms: DataFrame, residues: DataFrame, sasa: bool = True, dssp: Backend | None = None) -> DataFrame:
    """(structure_id, residue, ...) all features of every residue of every structure."""
    key = ["structure_id", "residue"]
    df = geometry_features(residues).join(contact_features(residues), key).join(disulfides(atoms), key, "left")
    df = df.withColumn("disulfide_flag", F.coalesce("disulfide_flag", F.lit(0))).withColumn("hydrogen_bond_count", F.lit(0)).withColumn("residue_chemical_class", chemical_class(F.col("aa")))
    if sasa:
        df = df.join(residue_areas(atoms), key, "left").withColumn("sasa_mask", F.col("total_sasa").isNotNull().cast("int"))
    else:
        df = df.withColumn("sasa_mask", F.lit(0))
    if dssp is not None:
        return df.join(dssp(residues), key, "left").withColumn("dssp_mask", F.col("dssp").isNotNull().cast("int"))
    return df.withColumn("dssp", F.lit(None).cast("string")).withColumn("dssp_mask", F.lit(0))


def extract_features(manifest: DataFrame, lines: DataFrame, sasa: bool = True, dssp: Backend | None = None, min_coverage: float = 0.9, min_identity: float = 0.9, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(feature table, extract QC).

    ``manifest`` has a column ``pdb_path`` that names a ``structure_id`` of ``lines``.  A protein without structure is
    in the QC only; one whose structure does not align has rows with all features null; so have residues in a
    terminal tag, without partner, or of another letter.  ``files`` (structure_id), if given, spares a scan of ``lines``.
    """
    proteins = with_protein(manifest)
    atoms, residues = atoms_and_residues(lines)
    known = (lines if files is None else files).select(F.col("structure_id").alias("pdb_path")).distinct()
    sequences = structure_sequences(residues).withColumnRenamed("structure_id", "pdb_path")
    found = proteins.join(known, "pdb_path").join(sequences, "pdb_path", "left").fillna({"pdb_sequence": "", "pdb_length": 0})
    aligned = checkpointed(evaluate_alignments(found, "sequence", "pdb_sequence", min_coverage, min_identity).withColumn("_row", F.monotonically_increasing_id()))  # for both tables
    passed = F.col("status") == "pass"
    qc = aligned.select(
        "protein_id", "pdb_path", F.length("sequence").alias("manifest_length"), "pdb_length", F.col("status").alias("alignment_status"), F.col("reason").alias("alignment_reason"), "identity",
        F.col("label_coverage").alias("coverage"), render_tags(F.col("sequence")).alias("histag_spans"), F.when(passed, "ok" if dssp else NO_DSSP).alias("dssp_reason"), F.when(passed, "ok" if sasa else NO_SASA).alias("sasa_reason"),
    )
    missing = proteins.join(known, "pdb_path", "left_anti").select("protein_id", "pdb_path", F.lit("fail").alias("alignment_status"), F.lit("pdb_not_found").alias("alignment_reason"))
    letters = F.filter(F.split("sequence", ""), lambda c: c != "")
    rows = aligned.select("_row", "protein_id", "entity_id", "pdb_path", F.posexplode(letters).alias("_i", "amino_acid"))
    # Letters meet their residues by a join: a map in each letter's row would make rows of the square of a sequence.
    tags = F.struct(n_tag_length(F.col("sequence")).alias("first"), (F.length("sequence") - c_tag_length(F.col("sequence"))).alias("end"), F.col("alignment.pairs").alias("pairs"))
    placed = F.transform(F.array(tags), lambda s: F.filter(s["pairs"], lambda p: (p["a"] >= s["first"]) & (p["a"] < s["end"])))[0]
    places = aligned.where(passed).select("_row", F.explode(placed).alias("_p")).select("_row", F.col("_p.a").alias("_i"), F.col("_p.b").alias("_residue"))
    rows = rows.join(places, ["_row", "_i"], "left").drop("_row")
    features = residue_features(atoms, residues, sasa, dssp).withColumnsRenamed({"structure_id": "_structure", "residue": "_r", "aa": "_aa"})
    joined = rows.join(features, (F.col("pdb_path") == F.col("_structure")) & (F.col("_residue") == F.col("_r")) & (F.col("amino_acid") == F.col("_aa")), "left")
    table = joined.withColumn("sequence_pos_1based", F.col("_i") + 1).withColumn("feature_valid_mask", F.col("_r").isNotNull().cast("int"))
    return as_features(table), only(qc.unionByName(missing, allowMissingColumns=True), EXTRACT_QC_COLUMNS)


def augment_features(features: DataFrame, manifest: DataFrame, lines: DataFrame, sasa: bool = True, dssp: Backend | None = None, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(features with secondary structure and areas filled in, augment QC); failures pass rows through unchanged.

    Of repeated manifest rows the last holds.  ``manifest`` needs ``ord`` and ``pdb_path``.
    """
    proteins = one_per_key(with_protein(manifest), ["protein_id"], "ord", last=True)
    atoms, residues = atoms_and_residues(lines)
    known = (lines if files is None else files).select(F.col("structure_id").alias("pdb_path")).distinct().withColumn("_known", F.lit(True))
    sequences = structure_sequences(residues).withColumnRenamed("structure_id", "pdb_path")
    groups = features.select(F.col("protein_id").cast("string").alias("protein_id")).distinct()
    state = groups.join(proteins, "protein_id", "left").join(known, "pdb_path", "left").join(sequences, "pdb_path", "left").fillna({"pdb_sequence": ""})
    there = checkpointed(evaluate_alignments(state.where("_known"), "sequence", "pdb_sequence"))
    ok = F.col("status") == "pass"
    qc = there.select(
        "protein_id", F.when(ok, "ok").otherwise("fail").alias("status"), "reason", "pdb_path", F.when(~ok, F.col("identity")).alias("identity"), F.when(~ok, F.col("label_coverage")).alias("coverage"),
        F.when(ok, "ok" if dssp else NO_DSSP).alias("dssp_reason"), F.when(ok, "ok" if sasa else NO_SASA).alias("sasa_reason"),
    )
    absent = state.where("_known is null").select("protein_id", F.lit("fail").alias("status"), F.when(F.col("sequence").isNull(), "missing_manifest_row").otherwise("pdb_not_found").alias("reason"), "pdb_path")
    new: DataFrame | None = None
    if sasa:
        new = residue_areas(atoms)
    if dssp is not None:
        codes = dssp(residues)
        new = codes if new is None else new.join(codes, ["structure_id", "residue"], "full")
    out = features
    if new is not None:
        names = [c for c in new.columns if c not in ("structure_id", "residue")]
        places = there.where(ok).select(F.col("protein_id").alias("_p"), "pdb_path", F.explode("alignment.pairs").alias("_pair")).select("_p", "pdb_path", (F.col("_pair.a") + 1).alias("_pos"), F.col("_pair.b").alias("residue"))
        values = places.join(new.withColumnRenamed("structure_id", "pdb_path"), ["pdb_path", "residue"]).select("_p", "_pos", *(F.col(c).alias(f"_new_{c}") for c in names))
        valid = F.col("feature_valid_mask") == 1 if "feature_valid_mask" in features.columns else F.lit(False)
        out = features.join(values, (F.col("protein_id").cast("string") == F.col("_p")) & (F.col("sequence_pos_1based") == F.col("_pos")) & valid, "left")
        for c in names:
            out = out.withColumn(c, F.coalesce(f"_new_{c}", F.col(c)) if c in features.columns else F.col(f"_new_{c}"))
        for mask, source in (("sasa_mask", "total_sasa"), ("dssp_mask", "dssp")):
            if source in names:
                old = F.col(mask) if mask in features.columns else F.lit(None).cast("int")
                out = out.withColumn(mask, F.when(F.col(f"_new_{source}").isNotNull(), 1).otherwise(old))
        out = out.drop("_p", "_pos", *(f"_new_{c}" for c in names))
    return out, only(qc.unionByName(absent, allowMissingColumns=True), AUGMENT_QC_COLUMNS)
