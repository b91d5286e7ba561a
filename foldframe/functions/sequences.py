"""Column expressions over sequences, labels and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_sequence(c: Column) -> Column:
    return F.upper(F.replace(c, F.lit(" "), F.lit("")))


def clean_labels(c: Column) -> Column:
    """Blanks go, case stays: p and P are different tokens."""
    return F.replace(c, F.lit(" "), F.lit(""))


def clean_id(c: Column) -> Column:
    """Ids compare as text; a number that was read as a float loses its ``.0``."""
    return F.regexp_replace(c.cast("string"), r"^(-?\d+)\.0$", "$1")


def n_tag_length(seq: Column, least: int = 6) -> Column:
    first = F.upper(F.substring(seq, 1, least))
    return F.when(first != "H" * least, 0).otherwise(F.length(F.regexp_extract(F.upper(seq), f"^H{{{least},}}", 0)))


def c_tag_length(seq: Column, least: int = 6) -> Column:
    # A tag stands in the last letters (a line end of up to two may follow); few texts need the scan of all.
    last = F.upper(F.substring(seq, -(least + 2), least + 2))
    return F.when(~F.contains(last, F.lit("H" * least)), 0).otherwise(F.length(F.regexp_extract(F.upper(seq), f"H{{{least},}}$", 0)))


def tag_spans(seq: Column, least: int = 6) -> Column:
    """Terminal poly-H spans, 0-based and half open; null where there is none.  All H sets both."""
    n, c, size = n_tag_length(seq, least), c_tag_length(seq, least), F.length(seq)
    return F.struct(F.when(n > 0, F.lit(0)).alias("n_start"), F.when(n > 0, n).alias("n_end"), F.when(c > 0, size - c).alias("c_start"), F.when(c > 0, size).alias("c_end"))


def in_tag(seq: Column, position0: Column, least: int = 6) -> Column:
    return (position0 < n_tag_length(seq, least)) | (position0 >= F.length(seq) - c_tag_length(seq, least))


def render_tags(seq: Column, least: int = 6) -> Column:
    """Spans as N:1-6;C:13-19 (1-based, inclusive), empty without tags."""
    n, c, size = n_tag_length(seq, least), c_tag_length(seq, least), F.length(seq)
    return F.concat_ws(";", F.when(n > 0, F.concat(F.lit("N:1-"), n.cast("string"))), F.when(c > 0, F.concat(F.lit("C:"), (size - c + 1).cast("string"), F.lit("-"), size.cast("string"))))


def strip_tags(seq: Column, least: int = 6) -> Column:
    n, c = n_tag_length(seq, least), c_tag_length(seq, least)
    return F.substring(seq, n + 1, F.greatest(F.length(seq) - n - c, F.lit(0)))


def token_label(token: Column, include_unsuppressed: bool = False) -> Column:
    return F.when(token.isin("X", "."), 1).when(token == "A", 0).when(token == "Y", int(include_unsuppressed))


def entity_from_id(protein_id: Column) -> Column:
    """Digits after a final ``_entity``, else null."""
    return F.nullif(F.regexp_extract(protein_id.cast("string"), r"_entity(\d+)$", 1), F.lit(""))


def entity_after_marker(protein_id: Column) -> Column:
    """All that follows the last ``_entity``, else empty."""
    return F.when(F.contains(protein_id, F.lit("_entity")), F.element_at(F.split(protein_id, "_entity"), -1)).otherwise("")


def numeric(c: Column) -> Column:
    """A number, or null for text that is none and for NaN."""
    value = F.when(F.trim(c.cast("string")).rlike(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI]nf(inity)?)$"), c.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


#: Residue numbers of four columns: decimal, then base 36 from A000, then base 36 from a000 (hybrid-36).
_A000, _UPPER, _LOWER, _END = 10 * 36**3, 10_000, 10_000 + 26 * 36**3, 10_000 + 52 * 36**3


def residue_field(number: Column) -> Column:
    """A residue number in the four columns that structure files have for it; one beyond hybrid-36 is an error."""
    coded = lambda first: F.conv((number - first + _A000).cast("string"), 10, 36)
    too_large = F.raise_error(F.concat(F.lit("no four columns hold residue number "), number.cast("string")))
    return F.when(number < _UPPER, number.cast("string")).when(number < _LOWER, coded(_UPPER)).when(number < _END, F.lower(coded(_LOWER))).when(number.isNotNull(), too_large)


def residue_number(field: Column) -> Column:
    """The number that ``residue_field`` wrote, null for anything else."""
    coded = lambda first: F.conv(field, 36, 10).cast("int") - _A000 + first
    plain = F.when(field.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(field)).try_cast("int")
    return F.when(field.rlike("^[A-Z][0-9A-Z]{3}$"), coded(_UPPER)).when(field.rlike("^[a-z][0-9a-z]{3}$"), coded(_LOWER)).otherwise(plain)


def quick_ratio(a: Column, b: Column) -> Column:
    """Twice the size of the common character multiset over both lengths (1 for two empty texts)."""
    times = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    common = F.aggregate(F.array_distinct(F.filter(F.split(a, ""), lambda c: c != "")), F.lit(0), lambda acc, c: acc + F.least(times(a, c), times(b, c)))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * common / total)


def shares_kmer(label: Column, target: Column, k: int = 6) -> Column:
    """Does any k-mer of the label occur in the target?  A label below k letters shares by definition."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(label) - (k - 1), F.lit(1)))
    return F.when(F.length(label) < k, True).otherwise(F.exists(starts, lambda i: F.contains(target, F.substring(label, i, k))))


def distance(a: Column, b: Column) -> Column:
    """Distance of two points (structs with x, y, z)."""
    return F.sqrt(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in "xyz"), F.lit(0.0)))


def dihedral(p: list[tuple[Column, Column, Column]]) -> Column:
    """Torsion angle of four points given as (x, y, z) columns."""
    minus = lambda a, b: tuple(x - y for x, y in zip(a, b, strict=True))
    dot = lambda a, b: sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))
    b0, b1, b2 = minus(p[0], p[1]), minus(p[2], p[1]), minus(p[3], p[2])
    norm = F.sqrt(dot(b1, b1))
    u = tuple(c / norm for c in b1)
    s0, s2 = dot(b0, u), dot(b2, u)
    v, w = tuple(x - s0 * c for x, c in zip(b0, u, strict=True)), tuple(x - s2 * c for x, c in zip(b2, u, strict=True))
    cross = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    return F.atan2(dot(cross, w), dot(v, w))
