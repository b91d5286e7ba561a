"""Protein-shaped inputs derived from the driver's tables, whole tables and whole values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequences import residue_field

RESIDUES = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split()
ATOMS = "N CA C O CB SG CG".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def residue_letters(c: Column) -> Column:
    """The letters of a text that name residues, in upper case."""
    return F.upper(F.regexp_replace(c, "[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]+", ""))


def tagged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as sequences with terminal H runs of changing length."""
    part = table(spark, sf_dir, "part")
    n, c = (F.col("p_size") % 12).cast("int"), (F.col("p_partkey") % 9).cast("int")
    seq = F.concat(F.expr("repeat('H', cast(p_size % 12 as int))"), residue_letters(F.col("p_name")), F.expr("repeat('H', cast(p_partkey % 9 as int))"))
    return part.select("p_partkey", seq.alias("seq"), n.alias("n"), c.alias("c"))


def name_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part name as a label sequence, with a token for each letter; ``ord`` is its first key."""
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("ord"))
    seq = residue_letters(F.col("p_name"))
    return names.select("ord", F.col("p_name").alias("entry_ID"), seq.alias("sequence"), F.translate(seq, "ACDEFGHIKLMNPQRSTVWY", "AXY.AXY.AXY.AXY.AXYp").alias("label"))


def type_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of part name and type as an entity."""
    part = table(spark, sf_dir, "part").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("ord"))
    return part.select(F.concat("p_name", F.lit("/"), "p_type").alias("protein_id"), residue_letters(F.concat("p_name", "p_type")).alias("sequence"), "ord")


def name_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part name as an entity, with a terminal tag."""
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("ord"))
    return names.select(F.col("p_name").alias("protein_id"), F.concat(residue_letters(F.col("p_name")), F.lit("HHHHHHH")).alias("sequence"), "ord")


def vector_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-width atom lines: a structure per label, an atom per vector, seven atoms a residue."""
    v = table(spark, sf_dir, "embeddings")
    name = F.element_at(F.array(*map(F.lit, ATOMS)), (F.col("vec_id") % 7 + 1).cast("int"))
    residue = F.floor(F.col("vec_id") / 7)
    resname = F.element_at(F.array(*map(F.lit, RESIDUES)), (residue % 20 + 1).cast("int"))
    xyz = [F.col("embedding")[i].cast("double") * 40 for i in range(3)]
    line = F.format_string("ATOM  %5d %-4s %3s A%4s    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", F.col("vec_id") % 100000, name, resname, residue_field(residue), *xyz, F.lit(1.0), F.lit(50.0), F.substring(name, 1, 1))
    return v.select(F.concat(F.lit("s"), F.col("label").cast("string")).alias("structure_id"), F.col("vec_id").alias("line_no"), line.alias("line"))


def cysteine_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a cysteine of one sulphur atom; structures hold up to 10,000 vectors of a label."""
    v = table(spark, sf_dir, "embeddings")
    xyz = [F.col("embedding")[i].cast("double") * 40 for i in range(3)]
    line = F.format_string("ATOM  %5d %-4s %3s A%4d    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", F.col("vec_id") % 100000, F.lit("SG"), F.lit("CYS"), F.col("vec_id") % 10000, *xyz, F.lit(1.0), F.lit(50.0), F.lit("S"))
    structure_id = F.concat(F.lit("s"), F.col("label").cast("string"), F.lit("-"), F.floor(F.col("vec_id") / 10000).cast("string"))
    return v.select(structure_id.alias("structure_id"), F.col("vec_id").alias("line_no"), line.alias("line"))


def backbone_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a residue, whose first twelve components are its backbone; every fifth is a proline.

    Structures hold the vectors of a label among 1,000 ids.
    """
    v = table(spark, sf_dir, "embeddings").where("label is not null")
    atoms = F.array(*(F.struct(F.lit(name).alias("name"), *((F.col("embedding")[3 * k + j].cast("double") * 40).alias(c) for j, c in enumerate("xyz"))) for k, name in enumerate(ATOMS[:4])))
    structure_id = F.concat(F.lit("s"), F.col("label").cast("string"), F.lit("-"), F.floor(F.col("vec_id") / 1000).cast("string"))
    rows = v.select(structure_id.alias("structure_id"), F.lit("A").alias("chain"), "vec_id", F.when(F.col("vec_id") % 5 == 0, "PRO").otherwise("ALA").alias("resname"), atoms.alias("atoms"))
    return rows.withColumn("residue", (F.row_number().over(Window.partitionBy("structure_id").orderBy("vec_id")) - 1).cast("int"))
