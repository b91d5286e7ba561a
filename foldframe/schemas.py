"""Contract schemas and the checks that guard them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHI_COLUMNS = [f"chi{i}_{part}" for i in range(1, 5) for part in ("sin", "cos", "mask")]
KEY_COLUMNS = ["protein_id", "entity_id", "sequence_pos_1based", "amino_acid", "feature_valid_mask"]

# The column names and their order are the data contract.
FEATURE_COLUMNS = [
    "residue_chemical_class", "sidechain_heavy_atom_count", "sidechain_centroid_x", "sidechain_centroid_y", "sidechain_centroid_z",
    "sidechain_centroid_mask", "ca_to_sidechain_centroid_distance", "sidechain_spread", "sidechain_geometry_mask",
    "contact_count_4a", "contact_count_6a", "contact_count_8a", "packing_density_8a",
    "hydrophobic_contact_count", "polar_contact_count", "charged_contact_count", "aromatic_contact_count", "salt_bridge_count", "cation_pi_count",
    "hydrogen_bond_count", "disulfide_flag", "plddt", "total_sasa", "sidechain_sasa", "relative_sasa", "sasa_mask", "core_surface_flag", "dssp", "dssp_mask",
] + CHI_COLUMNS
EXTRACT_QC_COLUMNS = ["protein_id", "pdb_path", "manifest_length", "pdb_length", "alignment_status", "alignment_reason", "identity", "coverage", "histag_spans", "dssp_reason", "sasa_reason"]
AUGMENT_QC_COLUMNS = ["protein_id", "status", "reason", "pdb_path", "identity", "coverage", "dssp_reason", "sasa_reason"]
LABEL_COLUMNS = ["label_source", "source_entry_id", "protein_id", "entity_id", "sequence_pos_1based", "aa", "raw_label_token", "label", "label_type", "eval_mask"]
MATCH_COLUMNS = ["source_entry_id", "protein_id", "entity_id", "status", "reason", "label_coverage", "identity", "matched_label_positions", "reliable_label_positions", "mismatches", "label_length", "target_length", "histag_spans", "candidates_passing"]

TEXT_COLUMNS = {"residue_chemical_class", "core_surface_flag", "dssp"}
WHOLE_COLUMNS = {
    "sidechain_heavy_atom_count", "sidechain_centroid_mask", "sidechain_geometry_mask", "contact_count_4a", "contact_count_6a", "contact_count_8a", "packing_density_8a",
    "hydrophobic_contact_count", "polar_contact_count", "charged_contact_count", "aromatic_contact_count", "salt_bridge_count", "cation_pi_count", "hydrogen_bond_count",
    "disulfide_flag", "sasa_mask", "dssp_mask", "chi1_mask", "chi2_mask", "chi3_mask", "chi4_mask",
}


def feature_type(name: str) -> T.DataType:
    return T.StringType() if name in TEXT_COLUMNS else T.IntegerType() if name in WHOLE_COLUMNS else T.DoubleType()


def require_columns(df: DataFrame | Iterable[str], wanted: Iterable[str], message: str = "missing required columns") -> None:
    """Raise a ValueError that names the missing columns in sorted order."""
    present = set(df.columns if isinstance(df, DataFrame) else df)
    missing = sorted(set(wanted) - present)
    if missing:
        raise ValueError(f"{message}: {missing}")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def as_features(df: DataFrame) -> DataFrame:
    """Exactly the feature table's columns, in order and of the contract's types; absent ones are null."""
    have = set(df.columns)
    typed = [(F.col(c) if c in have else F.lit(None)).cast(feature_type(c)).alias(c) for c in FEATURE_COLUMNS]
    return df.select("protein_id", "entity_id", F.col("sequence_pos_1based").cast("int").alias("sequence_pos_1based"), "amino_acid", F.col("feature_valid_mask").cast("int").alias("feature_valid_mask"), *typed)


def only(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` in order, null where absent."""
    have = set(df.columns)
    return df.select(*((F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in columns))
