"""Residue chemistry as literal maps and predicates; everything stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Residue names, classes, maximum accessible areas (Tien et al. 2013) and side-chain torsion atoms.
THREE_TO_ONE = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L",
    "LYS": "K", "MET": "M", "MSE": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
CHEMICAL_CLASS = {
    "A": "hydrophobic", "V": "hydrophobic", "I": "hydrophobic", "L": "hydrophobic", "M": "hydrophobic",
    "F": "aromatic", "Y": "aromatic", "W": "aromatic",
    "S": "polar", "T": "polar", "N": "polar", "Q": "polar", "C": "polar",
    "G": "special", "P": "special", "D": "negative", "E": "negative", "K": "positive", "R": "positive", "H": "positive",
}
SETS = {
    "hydrophobic": {"A", "V", "I", "L", "M", "F", "Y", "W"},
    "polar": {"S", "T", "N", "Q", "C"},
    "charged": {"D", "E", "K", "R", "H"},
    "aromatic": {"F", "Y", "W", "H"},
    "positive": {"K", "R", "H"},
    "negative": {"D", "E"},
}
MAX_ASA = {
    "A": 129.0, "R": 274.0, "N": 195.0, "D": 193.0, "C": 167.0, "Q": 225.0, "E": 223.0, "G": 104.0, "H": 224.0, "I": 197.0,
    "L": 201.0, "K": 236.0, "M": 224.0, "F": 240.0, "P": 159.0, "S": 155.0, "T": 172.0, "W": 285.0, "Y": 263.0, "V": 174.0,
}
#: The four atoms of each side-chain torsion, chi1 first.
CHI_ATOMS = {
    "ARG": [
        ("N", "CA", "CB", "CG"),
        ("CA", "CB", "CG", "CD"),
        ("CB", "CG", "CD", "NE"),
        ("CG", "CD", "NE", "CZ"),
    ],
    "ASN": [
        ("N", "CA", "CB", "CG"),
        ("CA", "CB", "CG", "OD1"),
    ],
    "ASP": [
        ("N", "CA", "CB", "CG"),
        ("CA", "CB", "CG", "OD1"),
    ],
    "CYS": [
        ("N", "CA", "CB", "SG"),
    ],
    "GLN": [
        ("N", "CA", "CB", "CG"),
        ("CA", "CB", "CG", "CD"),
        ("CB", "CG", "CD", "OE1"),
    ],
    "GLU": [
        ("N", "CA", "CB", "CG"),
        ("CA", "CB", "CG", "CD"),
        ("CB", "CG", "CD", "OE1"),
    ],
    "HIS": [
        ("N", "CA", "CB", "CG"),
        ("CA", "CB", "CG", "ND1"),
    ],
    "ILE": [
        ("N", "CA", "CB", "CG1"),
        ("CA", "CB", "CG1", "CD1"),
    ],
    "LEU": [
        ("N", "CA", "CB", "CG"),
        ("CA", "CB", "CG", "CD1"),
    ],
    "LYS": [
        ("N", "CA", "CB", "CG"),
        ("CA", "CB", "CG", "CD"),
        ("CB", "CG", "CD", "CE"),
        ("CG", "CD", "CE", "NZ"),
    ],
    "MET": [
        ("N", "CA", "CB", "CG"),
        ("CA", "CB", "CG", "SD"),
        ("CB", "CG", "SD", "CE"),
    ],
    "PHE": [
        ("N", "CA", "CB", "CG"),
        ("CA", "CB", "CG", "CD1"),
    ],
    "PRO": [
        ("N", "CA", "CB", "CG"),
        ("CA", "CB", "CG", "CD"),
    ],
    "SER": [
        ("N", "CA", "CB", "OG"),
    ],
    "THR": [
        ("N", "CA", "CB", "OG1"),
    ],
    "TRP": [
        ("N", "CA", "CB", "CG"),
        ("CA", "CB", "CG", "CD1"),
    ],
    "TYR": [
        ("N", "CA", "CB", "CG"),
        ("CA", "CB", "CG", "CD1"),
    ],
    "VAL": [
        ("N", "CA", "CB", "CG1"),
    ],
}
BACKBONE = ["N", "CA", "C", "O", "OXT"]


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def one_letter(resname: Column) -> Column:
    return F.coalesce(_lookup(THREE_TO_ONE, F.upper(resname)), F.lit("X"))


def chemical_class(aa: Column) -> Column:
    return F.coalesce(_lookup(CHEMICAL_CLASS, aa), F.lit("unknown"))


def in_set(aa: Column, name: str) -> Column:
    return aa.isin(*SETS[name])


def max_asa(aa: Column) -> Column:
    return _lookup(MAX_ASA, aa)


def chi_atoms(resname: Column, chi: int) -> Column:
    """The four atom names of a torsion, null where the residue has none."""
    names = {r: torsions[chi - 1] for r, torsions in CHI_ATOMS.items() if len(torsions) >= chi}
    return F.element_at(F.create_map(*(x for r, n in names.items() for x in (F.lit(r), F.array(*map(F.lit, n))))), F.upper(resname))
