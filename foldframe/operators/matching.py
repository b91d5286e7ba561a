"""Attaching position-aligned labels to exactly one entity, or to none (fail closed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import clean_id, clean_labels, clean_sequence, entity_from_id, in_tag, quick_ratio, strip_tags, token_label
from ..schemas import LABEL_COLUMNS, MATCH_COLUMNS, require_columns
from ..sources.shared import checkpointed
from .align import evaluate_alignments

BUCKET = 32  # letters of length per bucket of the band join
TOP = 250


def prepare_manifest(manifest: DataFrame, raw_sequence: bool = False) -> DataFrame:
    """protein_id, entity_id, target, stripped, m_ord.  Needs ``ord``, the row's place in the file."""
    require_columns(manifest, {"protein_id", "sequence"}, "Manifest missing required columns")
    entity = clean_id(F.col("entity_id")) if "entity_id" in manifest.columns else entity_from_id(F.col("protein_id"))
    clean = clean_sequence(F.col("sequence"))
    return manifest.select(F.col("protein_id").cast("string").alias("protein_id"), entity.alias("entity_id"), (F.col("sequence") if raw_sequence else clean).alias("target"), strip_tags(clean).alias("stripped"), F.col("ord").alias("m_ord"))


def prepare_labels(labels: DataFrame) -> DataFrame:
    """label_id, source_entry_id, sequence, label_string, wanted_entity.  Needs ``ord``."""
    wanted = clean_id(F.col("entity_id")) if "entity_id" in labels.columns else F.lit(None).cast("string")
    return labels.select(F.col("ord").alias("label_id"), F.col("entry_ID").cast("string").alias("source_entry_id"), clean_sequence(F.col("sequence")).alias("sequence"), clean_labels(F.col("label")).alias("label_string"), wanted.alias("wanted_entity"))


def candidates_by_entity(labels: DataFrame, manifest: DataFrame) -> DataFrame:
    named = labels.where(F.col("wanted_entity").isNotNull())
    return named.join(manifest, F.col("wanted_entity") == F.col("entity_id")).withColumn("c_ord", F.col("m_ord"))


def candidates_exact(labels: DataFrame, manifest: DataFrame) -> DataFrame:
    """Equal sequences once terminal tags are gone."""
    return labels.withColumn("_s", strip_tags(F.col("sequence"))).join(manifest, F.col("_s") == F.col("stripped")).drop("_s").withColumn("c_ord", F.col("m_ord"))


def _bounds(size: Column) -> tuple[Column, Column]:
    """The least and the greatest length of an entity in the band of a label of ``size`` letters."""
    return F.greatest(F.lit(1), F.floor(size * 0.75)).cast("int"), (F.floor(size * 1.35) + 25).cast("int")


def _bands(labels: DataFrame) -> DataFrame:
    """``labels``, a row for each bucket of lengths (``_b``) that its band ``_low`` to ``_high`` touches."""
    low, high = _bounds(F.length("sequence"))
    left = labels.withColumn("_low", low).withColumn("_high", high)
    return left.withColumn("_b", F.explode(F.sequence((F.col("_low") / BUCKET).cast("int"), (F.col("_high") / BUCKET).cast("int"))))


def length_band(labels: DataFrame, manifest: DataFrame) -> DataFrame:
    """All entities whose stripped length is within the label's band: an equi-join on buckets of lengths."""
    right = manifest.withColumn("_b", (F.length("stripped") / BUCKET).cast("int"))
    return _bands(labels).join(right, "_b").where(F.length("stripped").between(F.col("_low"), F.col("_high"))).drop("_b", "_low", "_high")


def with_band_size(labels: DataFrame, manifest: DataFrame) -> DataFrame:
    """``labels`` with ``_n``, the number of entities in their band (0 if none).

    Lengths are counted, not pairs: the join is one of distinct lengths with distinct lengths.
    """
    lengths = manifest.groupBy(F.length("stripped").alias("_length")).agg(F.count("*").alias("_count")).withColumn("_b", (F.col("_length") / BUCKET).cast("int"))
    shapes = _bands(labels.groupBy(F.length("sequence").alias("_size")).agg(F.first("sequence").alias("sequence"))).drop("sequence")
    sums = shapes.join(lengths, "_b").where(F.col("_length").between(F.col("_low"), F.col("_high"))).groupBy("_size").agg(F.sum("_count").alias("_n"))
    return labels.withColumn("_size", F.length("sequence")).join(sums, "_size", "left").drop("_size").withColumn("_n", F.coalesce("_n", F.lit(0)))


def most_similar(scored: DataFrame, score: str, tie: str, top: int) -> DataFrame:
    """The ``top`` best rows of each label by ``score``, then ``tie``, with their rank as ``c_ord``."""
    rank = F.row_number().over(Window.partitionBy("label_id").orderBy(F.desc(score), tie))
    return scored.withColumn("c_ord", rank.cast("long")).where(F.col("c_ord") <= top)


def _words(sequence: Column, k: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(sequence) - k + 1), lambda i: F.substring(sequence, i, F.lit(k))))


def pairs_by_word(labels: DataFrame, manifest: DataFrame, k: int = 6) -> DataFrame:
    """The pairs of ``length_band`` that share a word of ``k`` letters, from an index of words; no other pair is a row.

    Only words, lengths and row numbers meet; a frequent word is split by adaptive execution.  A label of fewer letters
    shares by definition, so its pairs are the whole band.
    """
    short = F.length("sequence") < k
    left = labels.where(~short).select("label_id", *(bound.alias(name) for bound, name in zip(_bounds(F.length("sequence")), ("_low", "_high"), strict=True)), F.explode(_words(F.col("sequence"), k)).alias("_word"))
    right = manifest.where(F.length("stripped") >= k).select("m_ord", F.length("stripped").alias("_size"), F.explode(_words(F.col("stripped"), k)).alias("_word"))
    met = left.join(right, "_word").where(F.col("_size").between(F.col("_low"), F.col("_high"))).select("label_id", "m_ord").distinct()
    return labels.join(met, "label_id").join(manifest, "m_ord").select(*labels.columns, *manifest.columns).unionByName(length_band(labels.where(short), manifest))


def candidates_band(labels: DataFrame, manifest: DataFrame) -> DataFrame:
    """The entities of the label's length band.

    Where a label has more than ``TOP`` of them, only those that share a 6-mer and more than half of their letters,
    and of these the ``TOP`` most similar, stay.
    """
    sized = with_band_size(labels, manifest)
    few = length_band(sized.where(F.col("_n") <= TOP), manifest).withColumn("c_ord", F.col("m_ord")).drop("_n")
    scored = pairs_by_word(sized.where(F.col("_n") > TOP), manifest).withColumn("_score", quick_ratio(F.col("sequence"), F.col("stripped"))).where("_score > 0.5")
    return few.unionByName(most_similar(scored, "_score", "m_ord", TOP).drop("_n", "_score"))


def entity_candidates(labels: DataFrame, manifest: DataFrame) -> DataFrame:
    """An explicit entity replaces the search; exact hits replace the band."""
    free = labels.where(F.col("wanted_entity").isNull())
    exact = candidates_exact(free, manifest)
    rest = free.join(exact.select("label_id").distinct(), "label_id", "left_anti")
    return candidates_by_entity(labels, manifest).unionByName(exact).unionByName(candidates_band(rest, manifest))


_METRICS = ["label_coverage", "identity", "matched_label_positions", "reliable_label_positions", "mismatches", "label_length", "target_length", "histag_spans", "reason", "protein_id", "entity_id"]


def resolve_matches(labels: DataFrame, evaluated: DataFrame) -> DataFrame:
    """One row per label: mapped to the only candidate that passes, else ambiguous or unmapped, never attached."""
    found = F.struct(*_METRICS)
    passing = F.col("status") == "pass"
    best = evaluated.groupBy("label_id").agg(
        F.count_if(passing).alias("candidates_passing"),
        F.min_by(F.when(passing, found), F.when(passing, F.col("c_ord"))).alias("first_pass"),
        F.max_by(found, F.struct("label_coverage", "identity", -F.col("c_ord"))).alias("best"),
    )
    df = labels.join(best, "label_id", "left").withColumn("candidates_passing", F.coalesce("candidates_passing", F.lit(0)))
    n, chosen = F.col("candidates_passing"), F.coalesce("first_pass", "best")
    status = F.when(n == 1, "mapped").when(n > 1, "ambiguous").otherwise("unmapped")
    reason = F.when(n == 1, "ok").when(n > 1, "multiple_entities_pass").otherwise(F.coalesce(F.col("best.reason"), F.lit("no_candidate_entities")))
    zero = {"label_coverage": 0.0, "identity": 0.0, "histag_spans": ""}
    metric = lambda c: F.coalesce(chosen[c], F.length("sequence") if c == "label_length" else F.lit(zero.get(c, 0)))
    return df.select(
        "label_id", "source_entry_id", F.when(n == 1, chosen["protein_id"]).alias("protein_id"), F.when(n == 1, chosen["entity_id"]).alias("entity_id"),
        status.alias("status"), reason.alias("reason"), *(metric(c).alias(c) for c in _METRICS[:8]), n.cast("int").alias("candidates_passing"),
    )


def match_entities(labels: DataFrame, manifest: DataFrame, min_coverage: float = 0.9, min_identity: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(label QC, evaluated candidates); the candidates are written with their alignments, so nothing is aligned twice."""
    pairs = entity_candidates(labels, manifest).drop("stripped")
    evaluated = checkpointed(evaluate_alignments(pairs, "sequence", "target", min_coverage, min_identity))
    return resolve_matches(labels, evaluated), evaluated


def label_rows(matches: DataFrame, evaluated: DataFrame, include_unsuppressed: bool = False, source: str = "dyna1_relaxdb_cpmg", kind: str = "cpmg") -> DataFrame:
    """One row per label position of mapped labels; positions that the alignment leaves out have no place."""
    won = evaluated.where(F.col("status") == "pass").drop("status", "reason").join(matches.where("status = 'mapped'").select("label_id"), "label_id", "left_semi")
    chars = F.filter(F.split("sequence", ""), lambda c: c != "")
    df = won.withColumn("_map", F.map_from_entries("alignment.pairs")).select("*", F.posexplode(chars).alias("_i", "aa"))
    at, raw = F.element_at("_map", F.col("_i")), F.substring("label_string", F.col("_i") + 1, F.lit(1))
    reliable = at.isNotNull() & ~in_tag(F.col("target"), at) & (F.upper(F.substring("target", at + 1, F.lit(1))) == F.upper("aa"))
    label = token_label(raw, include_unsuppressed)
    return df.select(
        F.lit(source).alias("label_source"), "source_entry_id", "protein_id", "entity_id", (at + 1).alias("sequence_pos_1based"), "aa", raw.alias("raw_label_token"),
        label.alias("label"), F.lit(kind).alias("label_type"), F.coalesce((reliable & label.isNotNull()).cast("int"), F.lit(0)).alias("eval_mask"),
    )


def import_labels(labels: DataFrame, manifest: DataFrame, min_coverage: float = 0.9, min_identity: float = 0.9, include_unsuppressed: bool = False, raw_sequence: bool = False) -> tuple[DataFrame, DataFrame]:
    """(label table, label QC).  Labels whose cleaned strings differ in length are refused."""
    ready = prepare_labels(labels)
    bad = ready.where(F.length("sequence") != F.length("label_string")).select("source_entry_id", F.length("sequence"), F.length("label_string")).limit(5).collect()
    if bad:
        raise ValueError(f"sequence/label length mismatch: {[tuple(r) for r in bad]}")
    matches, evaluated = match_entities(ready, prepare_manifest(manifest, raw_sequence), min_coverage, min_identity)
    return label_rows(matches, evaluated, include_unsuppressed).select(*LABEL_COLUMNS), matches.select(*MATCH_COLUMNS)
