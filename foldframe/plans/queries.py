"""Registered queries over the driver's tables, one or more for each operator family, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chemistry, sequences
from ..operators import align, clustering, contacts, dataset, embeddings, features, matching, rows, sasa, secondary, structure, training
from ..schemas import MATCH_COLUMNS
from ..sources.readers import resolve_structure_paths
from ..sources.shared import checkpointed
from ..sources.writers import fasta_record
from .inputs import backbone_residues, cysteine_lines, name_labels, name_manifest, residue_letters, table, tagged_parts, type_manifest, vector_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# Fragments that several SQL texts share.
AA = "regexp_replace(upper(regexp_replace({}, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g')"
TAGGED = f"SELECT p_partkey, repeat('H', (p_size % 12)::INT) || {AA.format('p_name')} || repeat('H', (p_partkey % 9)::INT) AS seq FROM part"
LABELS = f"SELECT p_name, {AA.format('p_name')} AS sequence FROM (SELECT DISTINCT p_name FROM part)"
MANIFEST = f"SELECT p_name || '/' || p_type AS protein_id, {AA.format("p_name || p_type")} AS target FROM (SELECT DISTINCT p_name, p_type FROM part)"
ATOM_SQL = """SELECT 's' || label AS structure_id, vec_id, (vec_id // 7) AS resseq, ['N','CA','C','O','CB','SG','CG'][vec_id % 7 + 1] AS name,
    ['A','R','N','D','C','Q','E','G','H','I','L','K','M','F','P','S','T','W','Y','V'][(vec_id // 7) % 20 + 1] AS aa,
    printf('%8.3f', embedding[1]::DOUBLE * 40)::DOUBLE AS x, printf('%8.3f', embedding[2]::DOUBLE * 40)::DOUBLE AS y, printf('%8.3f', embedding[3]::DOUBLE * 40)::DOUBLE AS z FROM embeddings"""
PAIRS_SQL = f"""atoms AS ({ATOM_SQL}),
    pairs AS (SELECT a.structure_id, a.resseq AS i, b.resseq AS j, any_value(a.aa) AS ai, any_value(b.aa) AS aj,
              min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) AS dist
              FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id AND a.resseq <> b.resseq GROUP BY 1, 2, 3),
    sizes AS (SELECT structure_id, resseq, any_value(aa) AS aa, count(*) AS n FROM atoms GROUP BY 1, 2)"""
METRICS_SQL = """g AS (SELECT grp, score, sum(label) AS tp, count(*) AS n FROM r GROUP BY 1, 2),
    w AS (SELECT *, sum(tp) OVER (PARTITION BY grp ORDER BY score DESC) AS ctp, sum(n) OVER (PARTITION BY grp ORDER BY score DESC) AS cn FROM g),
    s AS (SELECT grp, sum(tp) AS p, sum(n) AS n, sum((n - tp) * (ctp - tp / 2)) AS u, sum(tp * ctp / cn) AS ap FROM w GROUP BY 1)"""


@query("SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic, CAST(coalesce(l.quality, 0) AS INT) AS eval_mask FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_labels_left(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("eval_mask", F.col("quality"))
    return dataset.join_labels(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), labels, ["doc_id"])


@query(f"""WITH r AS (SELECT d.lang AS grp, d.n_chars::DOUBLE AS score, l.quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL
    UNION ALL SELECT '', d.n_chars::DOUBLE, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id), {METRICS_SQL}
    SELECT CASE WHEN grp = '' THEN 'overall' ELSE 'per_protein' END AS "group", grp AS protein_id,
    round(CASE WHEN p > 0 AND n > p THEN u / (p * (n - p)) END, 6) AS AUROC, round(CASE WHEN p > 0 THEN ap / p ELSE 0.0 END, 6) AS AUPRC,
    round(CASE WHEN p > 0 THEN ap / p ELSE 0.0 END - p / n, 6) AS AUPRC_norm, round(p / n, 6) AS baseline FROM s""")
def rank_metrics_grouped(spark, sf_dir):
    joined = dataset.join_labels(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels").withColumn("eval_mask", F.lit(1)), ["doc_id"])
    found = dataset.ranking_metrics(joined.withColumn("label", F.col("quality")).withColumn("score", F.col("n_chars")), F.col("lang"))
    return rounded(found, "AUROC", "AUPRC", "AUPRC_norm", "baseline")


@query(f"""WITH r AS (SELECT lang AS grp, n_chars::DOUBLE AS score, 0 AS label FROM documents UNION ALL SELECT '', n_chars::DOUBLE, 0 FROM documents), {METRICS_SQL}
    SELECT CASE WHEN grp = '' THEN 'overall' ELSE 'per_protein' END AS "group", grp AS protein_id, CAST(NULL AS DOUBLE) AS AUROC, 0.0::DOUBLE AS AUPRC FROM s""")
def rank_metrics_one_class(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang"), F.lit(0).alias("label"), F.col("n_chars").alias("score"), F.lit(1).alias("eval_mask"))
    return dataset.ranking_metrics(docs, F.col("lang")).select("group", "protein_id", "AUROC", "AUPRC")


@query("SELECT doc_id, quality, toxic FROM labels WHERE toxic = 1")
def masked_rows(spark, sf_dir):
    return rows.masked(table(spark, sf_dir, "labels").withColumn("eval_mask", F.col("toxic"))).drop("eval_mask")


_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std" for c in _COLUMNS) + " FROM lineitem")
def normalizer_fit(spark, sf_dir):
    found = dataset.normalizer_stats(table(spark, sf_dir, "lineitem"), _COLUMNS)
    return rounded(found, *found.columns)


@query("""WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM orders)
    SELECT o_orderkey, round((o_totalprice - m) / d, 6) AS o_totalprice FROM orders, s""")
def normalizer_transform(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rounded(dataset.fit_normalizer(orders, ["o_totalprice"]).transform(orders), "o_totalprice")


@query("SELECT event_id, try_cast(nullif(regexp_extract(props, '\"k\": *([0-9.]+)', 1), '') AS DOUBLE) AS k FROM events")
def numeric_coerce(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", sequences.numeric(F.regexp_extract("props", '"k": *([0-9.]+)', 1)).alias("k"))


@query(f"SELECT doc_id, length(s)::INT AS size, md5(s) AS digest FROM (SELECT doc_id, upper(replace({AA.format('text')}, ' ', '')) AS s FROM documents)")
def seq_clean(spark, sf_dir):
    seq = sequences.clean_sequence(residue_letters(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(seq).alias("size"), F.md5(seq).alias("digest"))


@query(f"""SELECT p_partkey, CASE WHEN n > 0 THEN 0 END AS n_start, CASE WHEN n > 0 THEN n END AS n_end, CASE WHEN c > 0 THEN length(seq) - c END AS c_start, CASE WHEN c > 0 THEN length(seq) END AS c_end,
    concat_ws(';', CASE WHEN n > 0 THEN 'N:1-' || n END, CASE WHEN c > 0 THEN 'C:' || (length(seq) - c + 1) || '-' || length(seq) END) AS spans, (3 < n OR 3 >= length(seq) - c) AS fourth_in_tag
    FROM (SELECT *, length(regexp_extract(seq, '^H{{6,}}')) AS n, length(regexp_extract(seq, 'H{{6,}}$')) AS c FROM ({TAGGED}))""")
def histag_spans(spark, sf_dir):
    seq = F.col("seq")
    return tagged_parts(spark, sf_dir).select("p_partkey", sequences.tag_spans(seq).alias("t"), sequences.render_tags(seq).alias("spans"), sequences.in_tag(seq, F.lit(3)).alias("fourth_in_tag")).select("p_partkey", *(F.col(f"t.{c}").cast("long").alias(c) for c in ("n_start", "n_end", "c_start", "c_end")), "spans", "fourth_in_tag")


@query(f"""SELECT p_partkey, CASE WHEN seq ~ '^H+$' AND length(seq) >= 6 THEN '' ELSE regexp_replace(regexp_replace(seq, '^H{{6,}}', ''), 'H{{6,}}$', '') END AS stripped FROM ({TAGGED})""")
def histag_strip(spark, sf_dir):
    return tagged_parts(spark, sf_dir).select("p_partkey", sequences.strip_tags(F.col("seq")).alias("stripped"))


@query(f"""SELECT p_name, i::INT AS pos, t AS token, CASE WHEN t IN ('X', '.') THEN 1 WHEN t IN ('A', 'Y') THEN 0 END AS label, CASE WHEN t IN ('X', '.', 'Y') THEN 1 WHEN t = 'A' THEN 0 END AS unsuppressed
    FROM (SELECT p_name, unnest(range(1, length(s) + 1)) AS i, unnest(string_split(s, '')) AS t FROM (SELECT p_name, translate(sequence, 'ACDEFGHIKLMNPQRSTVWY', 'AXY.AXY.AXY.AXY.AXYp') AS s FROM ({LABELS})))""")
def token_labels_long(spark, sf_dir):
    long = name_labels(spark, sf_dir).select(F.col("entry_ID").alias("p_name"), F.posexplode(F.split("label", "")).alias("i", "token"))
    return long.select("p_name", (F.col("i") + 1).alias("pos"), "token", sequences.token_label(F.col("token")).alias("label"), sequences.token_label(F.col("token"), True).alias("unsuppressed"))


def _labels_and_manifest(spark, sf_dir):
    return matching.prepare_labels(name_labels(spark, sf_dir)), matching.prepare_manifest(type_manifest(spark, sf_dir))


@query(f"""WITH s AS (SELECT p_partkey, regexp_replace(regexp_replace(seq, '^H{{6,}}', ''), 'H{{6,}}$', '') AS stripped FROM ({TAGGED}))
    SELECT p_partkey, min(p_partkey) OVER (PARTITION BY stripped) AS class_id, count(*) OVER (PARTITION BY stripped) AS class_size FROM s""")
def candidate_exact(spark, sf_dir):
    """Every part meets the one entity of its stripped sequence: two parts are equal if they have the same class_id."""
    parts = tagged_parts(spark, sf_dir)
    labels = parts.select("p_partkey", F.col("seq").alias("sequence"))
    classes = parts.groupBy(sequences.strip_tags(F.col("seq")).alias("stripped")).agg(F.min("p_partkey").alias("m_ord"), F.count("*").alias("class_size"))
    return matching.candidates_exact(labels, classes).select("p_partkey", F.col("m_ord").alias("class_id"), "class_size")


@query(f"""SELECT l.p_name, m.p_name AS protein_id FROM ({LABELS}) l JOIN ({LABELS}) m ON length(m.sequence) BETWEEN greatest(1, floor(length(l.sequence) * 0.75)) AND floor(length(l.sequence) * 1.35) + 25""")
def candidate_band(spark, sf_dir):
    labels, manifest = matching.prepare_labels(name_labels(spark, sf_dir)), matching.prepare_manifest(name_manifest(spark, sf_dir))
    return matching.candidates_band(labels, manifest).select(F.col("source_entry_id").alias("p_name"), "protein_id")


_COUNTS = " + ".join(f"least(length(a) - length(replace(a, '{c}', '')), length(b) - length(replace(b, '{c}', '')))" for c in "ACDEFGHIKLMNPQRSTVWY")


# Every entity of a label's length band, whole.
BAND = f"""SELECT l.p_name, m.protein_id, l.sequence AS a, m.target AS b FROM ({LABELS}) l JOIN (SELECT *, regexp_replace(regexp_replace(target, '^H{{6,}}', ''), 'H{{6,}}$', '') AS stripped FROM ({MANIFEST})) m
    ON length(m.stripped) BETWEEN greatest(1, floor(length(l.sequence) * 0.75)) AND floor(length(l.sequence) * 1.35) + 25"""


def _band(spark, sf_dir):
    return matching.length_band(*_labels_and_manifest(spark, sf_dir))


@query(f"""WITH p AS ({BAND}),
    s AS (SELECT p_name, protein_id, round(2.0 * ({_COUNTS}) / (length(a) + length(b)), 6) AS score FROM p)
    SELECT p_name, protein_id, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY score DESC, protein_id) AS rn FROM s WHERE score > 0.5) WHERE rn <= 5""")
def quick_ratio_topk(spark, sf_dir):
    scored = _band(spark, sf_dir).withColumn("score", F.round(sequences.quick_ratio(F.col("sequence"), F.col("target")), 6)).where("score > 0.5")
    return matching.most_similar(scored, "score", "protein_id", 5).select(F.col("source_entry_id").alias("p_name"), "protein_id", "score", F.col("c_ord").alias("rn"))


@query(f"""SELECT p_name, protein_id, (length(a) < 6 OR list_bool_or(list_transform(range(1, greatest(length(a) - 4, 2)), lambda i: contains(b, substr(a, i, 6))))) AS shared FROM ({BAND})""")
def kmer_share(spark, sf_dir):
    return _band(spark, sf_dir).select(F.col("source_entry_id").alias("p_name"), "protein_id", sequences.shares_kmer(F.col("sequence"), F.col("target")).alias("shared"))


@query(f"""WITH RECURSIVE p AS ({BAND}),
    dp AS (SELECT p_name, protein_id, a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda j: -2 * j) AS row FROM p
      UNION ALL SELECT p_name, protein_id, a, b, i + 1, list_transform(range(0, length(b) + 1), lambda j: -2 * j + list_max(list_transform(range(0, j + 1), lambda k: 2 * k +
        CASE WHEN k = 0 THEN -2 * (i + 1) ELSE greatest(row[k] + CASE WHEN substr(a, i + 1, 1) = substr(b, k, 1) THEN 2 ELSE -1 END, row[k + 1] - 2) END)))
      FROM dp WHERE i < length(a))
    SELECT p_name, protein_id, row[length(b) + 1]::INT AS score FROM dp WHERE i = length(a)""")
def align_score(spark, sf_dir):
    pairs = _band(spark, sf_dir).select("source_entry_id", "protein_id", "sequence", "target")
    return align.align_pairs(pairs, "sequence", "target").select(F.col("source_entry_id").alias("p_name"), "protein_id", "alignment.score")


_STRIP = "regexp_replace(regexp_replace({}, '^H{{6,}}', ''), 'H{{6,}}$', '')"
# Of pairs p (p_name, protein_id, a, b): the score matrix row by row, the way back through it, and what is read off it.
_QC = f"""dp AS MATERIALIZED (SELECT p_name, protein_id, a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda j: -2 * j) AS row FROM p
      UNION ALL SELECT p_name, protein_id, a, b, i + 1, list_transform(range(0, length(b) + 1), lambda j: -2 * j + list_max(list_transform(range(0, j + 1), lambda k: 2 * k +
        CASE WHEN k = 0 THEN -2 * (i + 1) ELSE greatest(row[k] + CASE WHEN substr(a, i + 1, 1) = substr(b, k, 1) THEN 2 ELSE -1 END, row[k + 1] - 2) END)))
      FROM dp WHERE i < length(a)),
    back AS MATERIALIZED (SELECT p_name, protein_id, a, b, length(a)::INT AS i, length(b)::INT AS j, []::STRUCT(a INT, b INT)[] AS pairs FROM p
      UNION ALL SELECT p_name, protein_id, a, b, CASE WHEN move = 'left' THEN i ELSE i - 1 END, CASE WHEN move = 'up' THEN j ELSE j - 1 END, CASE WHEN move = 'both' THEN list_append(pairs, {{'a': i, 'b': j}}) ELSE pairs END
      FROM (SELECT t.*, CASE WHEN t.i > 0 AND t.j > 0 AND here.row[t.j + 1] = above.row[t.j] + CASE WHEN substr(t.a, t.i, 1) = substr(t.b, t.j, 1) THEN 2 ELSE -1 END THEN 'both'
                             WHEN t.i > 0 AND (t.j = 0 OR here.row[t.j + 1] = above.row[t.j + 1] - 2) THEN 'up' ELSE 'left' END AS move
            FROM back t JOIN dp here ON here.p_name = t.p_name AND here.protein_id = t.protein_id AND here.i = t.i LEFT JOIN dp above ON above.p_name = t.p_name AND above.protein_id = t.protein_id AND above.i = t.i - 1 WHERE t.i > 0 OR t.j > 0)),
    ends AS (SELECT *, length(regexp_extract(b, '^H{{6,}}')) AS n, length(regexp_extract(b, 'H{{6,}}$')) AS c FROM back WHERE i = 0 AND j = 0),
    free AS (SELECT *, list_filter(pairs, lambda x: x.b > n AND x.b <= length(b) - c) AS outside FROM ends),
    sums AS (SELECT *, len(list_filter(outside, lambda x: substr(a, x.a, 1) = substr(b, x.b, 1)))::INT AS reliable_label_positions FROM free),
    shares AS (SELECT *, len(pairs)::INT AS matched_label_positions, (len(outside) - reliable_label_positions)::INT AS mismatches, length(a)::INT AS label_length, length(b)::INT AS target_length,
      CASE WHEN length(a) > 0 THEN reliable_label_positions / length(a) ELSE 0.0 END::DOUBLE AS label_coverage, CASE WHEN len(outside) > 0 THEN reliable_label_positions / len(outside) ELSE 0.0 END::DOUBLE AS identity,
      concat_ws(';', CASE WHEN n > 0 THEN 'N:1-' || n END, CASE WHEN c > 0 THEN 'C:' || (length(b) - c + 1) || '-' || length(b) END) AS histag_spans FROM sums),
    qc AS (SELECT *, CASE WHEN label_length = 0 THEN 'empty_label_sequence' WHEN label_coverage < 0.9 THEN 'low_label_coverage' WHEN identity < 0.9 THEN 'low_identity' WHEN mismatches > 0 THEN 'mismatched_evaluated_residues' ELSE 'ok' END AS reason FROM shares)"""
_QC_COLUMNS = ["label_coverage", "identity", "matched_label_positions", "reliable_label_positions", "mismatches", "label_length", "target_length", "histag_spans"]


@query(f"""WITH RECURSIVE p AS ({BAND}), {_QC}, names AS (SELECT p_name, min(p_partkey) AS label_id FROM part GROUP BY 1), entities AS (SELECT p_name || '/' || p_type AS protein_id, min(p_partkey) AS m_ord FROM part GROUP BY 1)
    SELECT label_id, p_name AS source_entry_id, a AS sequence, translate(a, 'ACDEFGHIKLMNPQRSTVWY', 'AXY.AXY.AXY.AXY.AXYp') AS label_string, NULL::VARCHAR AS wanted_entity, protein_id, NULL::VARCHAR AS entity_id, b AS target, {_STRIP.format("b")} AS stripped, m_ord,
      {', '.join(_QC_COLUMNS)}, reason, CASE WHEN reason = 'ok' THEN 'pass' ELSE 'fail' END AS status FROM qc JOIN names USING (p_name) JOIN entities USING (protein_id)""")
def alignment_qc(spark, sf_dir):
    return align.evaluate_alignments(_band(spark, sf_dir), "sequence", "target").drop("alignment")


def _match_sql(entities: str) -> str:
    """CTEs of the candidates of each label among ``entities`` (protein_id, target, ord), their checks, and one decision a label."""
    return f"""l AS (SELECT p_name, {AA.format("p_name")} AS a FROM (SELECT DISTINCT p_name FROM part)),
    m AS (SELECT protein_id, target AS b, {_STRIP.format("target")} AS stripped, ord FROM ({entities})),
    exact AS (SELECT p_name, protein_id, a, b, ord AS rank FROM l JOIN m ON {_STRIP.format("a")} = stripped),
    band AS (SELECT *, count(*) OVER (PARTITION BY p_name) AS many FROM l JOIN m ON length(stripped) BETWEEN greatest(1, floor(length(a) * 0.75)) AND floor(length(a) * 1.35) + 25 WHERE p_name NOT IN (SELECT p_name FROM exact)),
    alike AS (SELECT p_name, protein_id, a, b, row_number() OVER (PARTITION BY p_name ORDER BY score DESC, ord) AS rank FROM (SELECT *, 2.0::DOUBLE * ({_COUNTS.replace("(b", "(stripped")}) / (length(a) + length(stripped)) AS score FROM band
      WHERE many > 250 AND (length(a) < 6 OR list_bool_or(list_transform(range(1, greatest(length(a) - 4, 2)), lambda i: contains(stripped, substr(a, i, 6)))))) WHERE score > 0.5),
    p AS MATERIALIZED (FROM exact UNION ALL SELECT p_name, protein_id, a, b, ord FROM band WHERE many <= 250 UNION ALL FROM alike WHERE rank <= 250),
    {_QC},
    ranked AS (SELECT qc.*, p.rank, count(*) FILTER (reason = 'ok') OVER (PARTITION BY p_name) AS passing,
      row_number() OVER (PARTITION BY p_name ORDER BY reason <> 'ok', CASE WHEN reason = 'ok' THEN p.rank END, label_coverage DESC, identity DESC, p.rank) AS place FROM qc JOIN p USING (p_name, protein_id)),
    decided AS (SELECT p_name AS source_entry_id, CASE WHEN passing = 1 THEN protein_id END AS protein_id, NULL::VARCHAR AS entity_id, CASE WHEN passing = 1 THEN 'mapped' WHEN passing > 1 THEN 'ambiguous' ELSE 'unmapped' END AS status,
      CASE WHEN passing > 1 THEN 'multiple_entities_pass' ELSE coalesce(reason, 'no_candidate_entities') END AS reason,
      coalesce(label_coverage, 0) AS label_coverage, coalesce(identity, 0) AS identity, coalesce(matched_label_positions, 0) AS matched_label_positions, coalesce(reliable_label_positions, 0) AS reliable_label_positions, coalesce(mismatches, 0) AS mismatches,
      length(l.a)::INT AS label_length, coalesce(target_length, 0) AS target_length, coalesce(histag_spans, '') AS histag_spans, coalesce(passing, 0)::INT AS candidates_passing, pairs, l.a, b
      FROM l LEFT JOIN (FROM ranked WHERE place = 1) r USING (p_name))"""


_PAIR_ENTITIES = f"SELECT p_name || '/' || p_type AS protein_id, {AA.format("p_name || p_type")} AS target, min(p_partkey) AS ord FROM part GROUP BY p_name, p_type"
_NAME_ENTITIES = f"SELECT p_name AS protein_id, {AA.format('p_name')} || 'HHHHHHH' AS target, min(p_partkey) AS ord FROM part GROUP BY p_name"


@query(f"WITH RECURSIVE {_match_sql(_PAIR_ENTITIES)} SELECT {', '.join(MATCH_COLUMNS)} FROM decided")
def match_entities(spark, sf_dir):
    return matching.match_entities(*_labels_and_manifest(spark, sf_dir))[0].select(*MATCH_COLUMNS)


@query(f"""WITH RECURSIVE {_match_sql(_NAME_ENTITIES)},
    letters AS (SELECT *, unnest(range(1, length(a) + 1))::INT AS i, translate(a, 'ACDEFGHIKLMNPQRSTVWY', 'AXY.AXY.AXY.AXY.AXYp') AS tokens FROM decided WHERE status = 'mapped'),
    placed AS (SELECT *, list_filter(pairs, lambda x: x.a = i)[1].b AS spot, substr(a, i, 1) AS aa, substr(tokens, i, 1) AS raw_label_token FROM letters),
    named AS (SELECT *, CASE WHEN raw_label_token IN ('X', '.') THEN 1 WHEN raw_label_token IN ('A', 'Y') THEN 0 END AS label,
      spot > length(regexp_extract(b, '^H{{6,}}')) AND spot <= length(b) - length(regexp_extract(b, 'H{{6,}}$')) AND substr(b, spot, 1) = aa AS reliable FROM placed)
    SELECT 'dyna1_relaxdb_cpmg' AS label_source, source_entry_id, protein_id, entity_id, spot AS sequence_pos_1based, aa, raw_label_token, label, 'cpmg' AS label_type, coalesce((reliable AND label IS NOT NULL)::INT, 0) AS eval_mask FROM named""")
def import_labels(spark, sf_dir):
    return matching.import_labels(name_labels(spark, sf_dir), name_manifest(spark, sf_dir))[0]


@query()
def cluster_sequences(spark, sf_dir):
    return clustering.cluster_sequences(type_manifest(spark, sf_dir))


@query("""WITH c AS (SELECT n_name AS cluster, row_number() OVER (ORDER BY md5('13:' || n_name)) - 1 AS r, count(*) OVER () AS n FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9990))
    SELECT CAST(c_custkey AS VARCHAR) AS protein_id, n_name AS cluster, CASE WHEN c.cluster IS NULL THEN 'excluded_eval_similar' WHEN r < round_even(n * 0.1, 0) THEN 'test' WHEN r < 2 * round_even(n * 0.1, 0) THEN 'val' ELSE 'train' END AS split
    FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN c ON c.cluster = n_name""")
def cluster_split_hash(spark, sf_dir):
    return _splits(spark, sf_dir, "hash")


@query()
def cluster_split_exact(spark, sf_dir):
    return _splits(spark, sf_dir, "exact")


def _clusters(spark, sf_dir):
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    clusters = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(F.col("n_name").alias("cluster"), F.col("c_custkey").alias("protein_id"))
    return clusters, customer.where("c_acctbal > 9990").select(F.col("c_custkey").alias("protein_id"))


def _splits(spark, sf_dir, mode):
    clusters, held = _clusters(spark, sf_dir)
    return dataset.cluster_splits(clusters, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("protein_id")), held, mode=mode)


@query("SELECT DISTINCT n_name AS cluster FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9990")
def contaminated_clusters(spark, sf_dir):
    clusters, held = _clusters(spark, sf_dir)
    return dataset.contaminated_clusters(clusters.withColumn("protein_id", F.col("protein_id").cast("string")), held)


@query(f"SELECT structure_id, 'A' AS chain, resseq::INT AS resseq, name, x, y, z, aa FROM ({ATOM_SQL})")
def pdb_parse(spark, sf_dir):
    return structure.parse_atoms(vector_lines(spark, sf_dir)).select("structure_id", "chain", "resseq", "name", "x", "y", "z", chemistry.one_letter(F.col("resname")).alias("aa"))


@query(f"SELECT structure_id, string_agg(aa, '' ORDER BY v) AS pdb_sequence, count(*)::INT AS pdb_length FROM (SELECT structure_id, resseq, any_value(aa) AS aa, min(vec_id) AS v FROM ({ATOM_SQL}) GROUP BY 1, 2) GROUP BY 1")
def structure_sequences(spark, sf_dir):
    return structure.structure_sequences(structure.residues_of(structure.parse_atoms(vector_lines(spark, sf_dir))))


def _contact_counts(spark, sf_dir):
    _, residues = features.atoms_and_residues(vector_lines(spark, sf_dir))
    found = contacts.contact_features(residues)
    return found.join(residues.select("structure_id", "residue", "resseq"), ["structure_id", "residue"])


@query(f"""WITH {PAIRS_SQL} SELECT s.structure_id, s.resseq::INT AS resseq, count(*) FILTER (dist <= 4) AS contact_count_4a, count(*) FILTER (dist <= 6) AS contact_count_6a, count(*) FILTER (dist <= 8) AS contact_count_8a
    FROM sizes s LEFT JOIN pairs p ON s.structure_id = p.structure_id AND s.resseq = p.i GROUP BY 1, 2""")
def contacts_threshold(spark, sf_dir):
    return _contact_counts(spark, sf_dir).select("structure_id", "resseq", "contact_count_4a", "contact_count_6a", "contact_count_8a")


@query(f"""WITH {PAIRS_SQL} SELECT s.structure_id, s.resseq::INT AS resseq, count(*) FILTER (contains('AVILMFYW', aj)) AS hydrophobic_contact_count, count(*) FILTER (contains('STNQC', aj)) AS polar_contact_count,
    count(*) FILTER (contains('DEKRH', aj)) AS charged_contact_count, count(*) FILTER (contains('FYWH', aj)) AS aromatic_contact_count,
    count(*) FILTER ((contains('KRH', ai) AND contains('DE', aj)) OR (contains('DE', ai) AND contains('KRH', aj))) AS salt_bridge_count,
    count(*) FILTER ((contains('KRH', ai) AND contains('FYWH', aj)) OR (contains('FYWH', ai) AND contains('KRH', aj))) AS cation_pi_count
    FROM sizes s LEFT JOIN pairs p ON s.structure_id = p.structure_id AND s.resseq = p.i AND dist <= 8 GROUP BY 1, 2""")
def interaction_counts(spark, sf_dir):
    return _contact_counts(spark, sf_dir).select("structure_id", "resseq", *(f"{c}_contact_count" for c in ("hydrophobic", "polar", "charged", "aromatic")), "salt_bridge_count", "cation_pi_count")


@query(f"""WITH {PAIRS_SQL} SELECT s.structure_id, s.resseq::INT AS resseq, coalesce(sum(t.n), 0)::BIGINT AS packing_density_8a
    FROM sizes s LEFT JOIN pairs p ON s.structure_id = p.structure_id AND s.resseq = p.i AND dist <= 8 LEFT JOIN sizes t ON t.structure_id = p.structure_id AND t.resseq = p.j GROUP BY 1, 2""")
def packing_density(spark, sf_dir):
    return _contact_counts(spark, sf_dir).select("structure_id", "resseq", "packing_density_8a")


@query("""WITH atoms AS (SELECT 's' || label || '-' || vec_id // 10000 AS structure_id, vec_id, printf('%8.3f', embedding[1]::DOUBLE * 40)::DOUBLE AS x, printf('%8.3f', embedding[2]::DOUBLE * 40)::DOUBLE AS y, printf('%8.3f', embedding[3]::DOUBLE * 40)::DOUBLE AS z FROM embeddings)
    SELECT DISTINCT a.structure_id, (a.vec_id % 10000)::INT AS resseq FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id AND a.vec_id <> b.vec_id
    WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 2.3""")
def disulfide_pairs(spark, sf_dir):
    atoms, residues = features.atoms_and_residues(cysteine_lines(spark, sf_dir))
    return structure.disulfides(atoms).join(residues, ["structure_id", "residue"]).select("structure_id", "resseq")


@query(f"""WITH a AS (SELECT * FROM ({ATOM_SQL}) WHERE name NOT IN ('N', 'CA', 'C', 'O') AND aa <> 'G'),
    s AS (SELECT structure_id, resseq, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS spread, count(*)::INT AS n FROM a GROUP BY 1, 2)
    SELECT structure_id, resseq::INT AS resseq, n AS sidechain_heavy_atom_count, round(cx, 5) AS sidechain_centroid_x, round(cy, 5) AS sidechain_centroid_y, round(cz, 5) AS sidechain_centroid_z, round(spread, 5) AS sidechain_spread FROM s""")
def centroid_spread(spark, sf_dir):
    _, residues = features.atoms_and_residues(vector_lines(spark, sf_dir))
    cols = ["sidechain_centroid_x", "sidechain_centroid_y", "sidechain_centroid_z", "sidechain_spread"]
    return rounded(structure.geometry_features(residues).where("sidechain_centroid_mask = 1").select("structure_id", "resseq", "sidechain_heavy_atom_count", *cols), *cols, places=5)


_Q = {f"{a}{k}": f"embedding[{4 * k + j + 1}]::DOUBLE" for k in range(4) for j, a in enumerate("xyz")}
_CROSS = lambda p, q: [f"({p}y*{q}z-{p}z*{q}y)", f"({p}z*{q}x-{p}x*{q}z)", f"({p}x*{q}y-{p}y*{q}x)"]


@query(f"""WITH p AS (SELECT vec_id, {", ".join(f"{v} AS {k}" for k, v in _Q.items())} FROM embeddings),
    b AS (SELECT vec_id, {", ".join(f"{a}0-{a}1 AS b0{a}, {a}2-{a}1 AS b1{a}, {a}3-{a}2 AS b2{a}" for a in "xyz")} FROM p),
    u AS (SELECT *, {", ".join(f"b1{a}/sqrt(b1x*b1x+b1y*b1y+b1z*b1z) AS u{a}" for a in "xyz")} FROM b),
    d AS (SELECT *, b0x*ux+b0y*uy+b0z*uz AS s0, b2x*ux+b2y*uy+b2z*uz AS s2 FROM u),
    v AS (SELECT vec_id, ux, uy, uz, {", ".join(f"b0{a}-s0*u{a} AS v{a}, b2{a}-s2*u{a} AS w{a}" for a in "xyz")} FROM d),
    t AS (SELECT vec_id, atan2({"+".join(f"{c}*w{a}" for c, a in zip(_CROSS("u", "v"), "xyz", strict=True))}, vx*wx+vy*wy+vz*wz) AS angle FROM v)
    SELECT vec_id, round(sin(angle), 6) AS sine, round(cos(angle), 6) AS cosine FROM t""")
def dihedral_sincos(spark, sf_dir):
    points = [tuple(F.col("embedding")[4 * k + j].cast("double") for j in range(3)) for k in range(4)]
    angle = sequences.dihedral(points)
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", F.sin(angle).alias("sine"), F.cos(angle).alias("cosine")), "sine", "cosine")


@query()
def residue_areas(spark, sf_dir):
    atoms, _ = features.atoms_and_residues(vector_lines(spark, sf_dir))
    return sasa.residue_areas(atoms)


def _structure_manifest(spark, sf_dir):
    found = structure.structure_sequences(features.atoms_and_residues(vector_lines(spark, sf_dir))[1])
    return found.select(F.col("structure_id").alias("protein_id"), F.col("pdb_sequence").alias("sequence"), F.col("structure_id").alias("pdb_path"), F.lit(0).alias("ord"))


@query()
def extract_features(spark, sf_dir):
    return features.extract_features(_structure_manifest(spark, sf_dir), vector_lines(spark, sf_dir))[0]


_CHI1 = "CASE WHEN aa IN ('R','N','D','Q','E','H','L','K','M','F','P','W','Y') THEN 'CG' WHEN aa = 'C' THEN 'SG' END"
_GEOMETRY = ["sidechain_centroid_x", "sidechain_centroid_y", "sidechain_centroid_z", "ca_to_sidechain_centroid_distance", "sidechain_spread", "plddt", "chi1_sin", "chi1_cos"]
_COUNTED = ["contact_count_4a", "contact_count_6a", "contact_count_8a", "packing_density_8a", "hydrophobic_contact_count", "polar_contact_count", "charged_contact_count", "aromatic_contact_count", "salt_bridge_count", "cation_pi_count"]


# Each protein has the sequence of its structure, so its letters are the residues, but in terminal tags.
@query(f"""WITH {PAIRS_SQL},
    places AS (SELECT structure_id, resseq, any_value(aa) AS aa, row_number() OVER (PARTITION BY structure_id ORDER BY min(vec_id))::INT AS pos FROM atoms GROUP BY 1, 2),
    chains AS (SELECT structure_id, string_agg(aa, '' ORDER BY pos) AS seq, count(*) AS size FROM places GROUP BY 1),
    ends AS (SELECT *, length(regexp_extract(seq, '^H{{6,}}')) AS n, length(regexp_extract(seq, 'H{{6,}}$')) AS c FROM chains),
    side AS (SELECT structure_id, resseq, count(*)::INT AS heavy, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS spread FROM atoms WHERE name NOT IN ('N', 'CA', 'C', 'O') GROUP BY 1, 2),
    alpha AS (SELECT structure_id, resseq, x, y, z FROM atoms WHERE name = 'CA'),
    met AS (SELECT structure_id, i, count(*) FILTER (dist <= 4) AS contact_count_4a, count(*) FILTER (dist <= 6) AS contact_count_6a, count(*) FILTER (dist <= 8) AS contact_count_8a, sum(t.n) FILTER (dist <= 8) AS packing_density_8a,
      {", ".join(f"count(*) FILTER (dist <= 8 AND contains('{letters}', aj)) AS {name}_contact_count" for name, letters in (("hydrophobic", "AVILMFYW"), ("polar", "STNQC"), ("charged", "DEKRH"), ("aromatic", "FYWH")))},
      count(*) FILTER (dist <= 8 AND ((contains('KRH', ai) AND contains('DE', aj)) OR (contains('DE', ai) AND contains('KRH', aj)))) AS salt_bridge_count,
      count(*) FILTER (dist <= 8 AND ((contains('KRH', ai) AND contains('FYWH', aj)) OR (contains('FYWH', ai) AND contains('KRH', aj)))) AS cation_pi_count
      FROM pairs p JOIN (SELECT structure_id AS s, resseq AS r, n FROM sizes) t ON t.s = p.structure_id AND t.r = p.j GROUP BY 1, 2),
    sulphur AS (SELECT structure_id, resseq, x, y, z FROM atoms WHERE name = 'SG' AND aa = 'C'),
    bound AS (SELECT DISTINCT a.structure_id, a.resseq FROM sulphur a JOIN sulphur b ON a.structure_id = b.structure_id AND a.resseq <> b.resseq WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 2.3),
    four AS (SELECT structure_id, resseq, {", ".join(f"max({c}) FILTER (name = {name}) AS {c}{k}" for k, name in enumerate(("'N'", "'CA'", "'CB'", _CHI1)) for c in "xyz")} FROM atoms GROUP BY 1, 2),
    b AS (SELECT structure_id, resseq, {", ".join(f"{a}0-{a}1 AS b0{a}, {a}2-{a}1 AS b1{a}, {a}3-{a}2 AS b2{a}" for a in "xyz")} FROM four WHERE x0 + x1 + x2 + x3 IS NOT NULL),
    u AS (SELECT *, {", ".join(f"b1{a}/sqrt(b1x*b1x+b1y*b1y+b1z*b1z) AS u{a}" for a in "xyz")} FROM b),
    d AS (SELECT *, b0x*ux+b0y*uy+b0z*uz AS s0, b2x*ux+b2y*uy+b2z*uz AS s2 FROM u),
    v AS (SELECT structure_id, resseq, ux, uy, uz, {", ".join(f"b0{a}-s0*u{a} AS v{a}, b2{a}-s2*u{a} AS w{a}" for a in "xyz")} FROM d),
    chi AS (SELECT structure_id, resseq, atan2({"+".join(f"{c}*w{a}" for c, a in zip(_CROSS("u", "v"), "xyz", strict=True))}, vx*wx+vy*wy+vz*wz) AS angle FROM v),
    f AS (SELECT p.structure_id, p.pos, p.aa, coalesce(heavy, 0) AS heavy, heavy > 0 AND p.aa <> 'G' AS has, cx, cy, cz, spread, a.x IS NOT NULL AS ca, sqrt((a.x-cx)*(a.x-cx)+(a.y-cy)*(a.y-cy)+(a.z-cz)*(a.z-cz)) AS far,
      {", ".join(f"coalesce({c}, 0)::INT AS {c}" for c in _COUNTED)}, (b.resseq IS NOT NULL)::INT AS disulfide_flag, angle
      FROM places p LEFT JOIN side s USING (structure_id, resseq) LEFT JOIN alpha a USING (structure_id, resseq) LEFT JOIN met m ON m.structure_id = p.structure_id AND m.i = p.resseq LEFT JOIN bound b ON b.structure_id = p.structure_id AND b.resseq = p.resseq LEFT JOIN chi ON chi.structure_id = p.structure_id AND chi.resseq = p.resseq
      JOIN ends e ON e.structure_id = p.structure_id WHERE greatest(size - n - c, 0) / size >= 0.9 AND p.pos > n AND p.pos <= size - c)
    SELECT p.structure_id AS protein_id, '' AS entity_id, p.pos AS sequence_pos_1based, p.aa AS amino_acid, (f.pos IS NOT NULL)::INT AS feature_valid_mask,
      CASE WHEN f.pos IS NULL THEN NULL WHEN contains('AVILM', f.aa) THEN 'hydrophobic' WHEN contains('FYW', f.aa) THEN 'aromatic' WHEN contains('STNQC', f.aa) THEN 'polar' WHEN contains('GP', f.aa) THEN 'special' WHEN contains('DE', f.aa) THEN 'negative' ELSE 'positive' END AS residue_chemical_class,
      heavy AS sidechain_heavy_atom_count, CASE WHEN has THEN round(cx, 5) END AS sidechain_centroid_x, CASE WHEN has THEN round(cy, 5) END AS sidechain_centroid_y, CASE WHEN has THEN round(cz, 5) END AS sidechain_centroid_z,
      CASE WHEN f.pos IS NOT NULL THEN coalesce(has, false)::INT END AS sidechain_centroid_mask, CASE WHEN has THEN round(far, 5) END AS ca_to_sidechain_centroid_distance, CASE WHEN has THEN round(spread, 5) END AS sidechain_spread,
      CASE WHEN f.pos IS NOT NULL THEN coalesce(has AND ca, false)::INT END AS sidechain_geometry_mask, {", ".join(_COUNTED)}, CASE WHEN f.pos IS NOT NULL THEN 0 END AS hydrogen_bond_count, disulfide_flag,
      CASE WHEN f.pos IS NOT NULL THEN 50.0::DOUBLE END AS plddt, CASE WHEN f.pos IS NOT NULL THEN 0 END AS sasa_mask, round(sin(angle), 5) AS chi1_sin, round(cos(angle), 5) AS chi1_cos, CASE WHEN f.pos IS NOT NULL THEN (angle IS NOT NULL)::INT END AS chi1_mask
    FROM places p LEFT JOIN f ON f.structure_id = p.structure_id AND f.pos = p.pos""")
def extract_geometry(spark, sf_dir):
    """Features of every residue without areas; the structures have no atoms beyond chi1."""
    found, _ = features.extract_features(_structure_manifest(spark, sf_dir), vector_lines(spark, sf_dir), sasa=False)
    absent = [c for c in found.columns if c in ("total_sasa", "sidechain_sasa", "relative_sasa", "core_surface_flag", "dssp", "dssp_mask") or c[:4] in ("chi2", "chi3", "chi4")]
    return rounded(found.drop(*absent), *_GEOMETRY, places=5)


# Each protein has the sequence of its structure, and a text aligned with itself pairs every letter with itself.
@query(f"""WITH s AS (SELECT structure_id AS protein_id, string_agg(aa, '' ORDER BY v) AS seq FROM (SELECT structure_id, resseq, any_value(aa) AS aa, min(vec_id) AS v FROM ({ATOM_SQL}) GROUP BY 1, 2) GROUP BY 1),
    t AS (SELECT *, length(seq)::INT AS size, length(regexp_extract(seq, '^H{{6,}}')) AS n, length(regexp_extract(seq, 'H{{6,}}$')) AS c FROM s),
    q AS (SELECT *, greatest(size - n - c, 0) / size AS coverage, (size > n + c)::INT::DOUBLE AS identity FROM t)
    SELECT protein_id, protein_id AS pdb_path, size AS manifest_length, size AS pdb_length, CASE WHEN coverage >= 0.9 THEN 'pass' ELSE 'fail' END AS alignment_status, CASE WHEN coverage >= 0.9 THEN 'ok' ELSE 'low_label_coverage' END AS alignment_reason,
      identity, coverage, concat_ws(';', CASE WHEN n > 0 THEN 'N:1-' || n END, CASE WHEN c > 0 THEN 'C:' || (size - c + 1) || '-' || size END) AS histag_spans,
      CASE WHEN coverage >= 0.9 THEN 'dssp_failed:ModuleNotFoundError' END AS dssp_reason, CASE WHEN coverage >= 0.9 THEN 'ok' END AS sasa_reason FROM q""")
def extract_features_qc(spark, sf_dir):
    return features.extract_features(_structure_manifest(spark, sf_dir), vector_lines(spark, sf_dir))[1]


@query()
def augment_features(spark, sf_dir):
    plain, _ = features.extract_features(_structure_manifest(spark, sf_dir), vector_lines(spark, sf_dir), sasa=False)
    return features.augment_features(plain, _structure_manifest(spark, sf_dir), vector_lines(spark, sf_dir))[0]


@query("""SELECT p_partkey, CASE letter WHEN 'A' THEN 'hydrophobic' WHEN 'V' THEN 'hydrophobic' WHEN 'I' THEN 'hydrophobic' WHEN 'L' THEN 'hydrophobic' WHEN 'M' THEN 'hydrophobic' WHEN 'F' THEN 'aromatic' WHEN 'Y' THEN 'aromatic' WHEN 'W' THEN 'aromatic'
    WHEN 'S' THEN 'polar' WHEN 'T' THEN 'polar' WHEN 'N' THEN 'polar' WHEN 'Q' THEN 'polar' WHEN 'C' THEN 'polar' WHEN 'G' THEN 'special' WHEN 'P' THEN 'special' WHEN 'D' THEN 'negative' WHEN 'E' THEN 'negative' WHEN 'K' THEN 'positive' WHEN 'R' THEN 'positive' WHEN 'H' THEN 'positive' ELSE 'unknown' END AS class,
    contains('AVILMFYW', letter) AS hydrophobic, contains('FYWH', letter) AS aromatic FROM (SELECT p_partkey, upper(substr(p_name, 1, 1)) AS letter FROM part)""")
def residue_classes(spark, sf_dir):
    letter = F.upper(F.substring("p_name", 1, 1))
    return table(spark, sf_dir, "part").select("p_partkey", chemistry.chemical_class(letter).alias("class"), chemistry.in_set(letter, "hydrophobic").alias("hydrophobic"), chemistry.in_set(letter, "aromatic").alias("aromatic"))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) AS row_index FROM orders QUALIFY row_index >= 2 AND row_index < 9002 AND row_index < 14000 AND (row_index - 2) % 3 = 1")
def row_select_shard(spark, sf_dir):
    indexed = rows.dense_index(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])
    return rows.select_rows(indexed, "row_index", limit=14000, start=2, count=9000, shard_index=1, num_shards=3).withColumn("row_index", F.col("row_index").cast("long"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def resume_anti(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return rows.resume(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), done, "c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def train_semi(spark, sf_dir):
    train = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return rows.members(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), train, "o_custkey")


@query("SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1")
def first_last_dedup(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    first = rows.one_per_key(events, ["user_id"], "event_id").select("user_id", F.col("event_type").alias("first_type"))
    return first.join(rows.one_per_key(events, ["user_id"], "event_id", last=True).select("user_id", F.col("event_type").alias("last_type")), "user_id")


@query("""SELECT page_id, CASE WHEN starts_with(g, '/') THEN g ELSE '/data/' || g END AS pdb_path FROM (SELECT page_id, coalesce(CASE WHEN page_id % 3 = 0 THEN url END, CASE WHEN page_id % 3 = 1 THEN '/abs/' || page_id END, page_id || '.pdb') AS g FROM pages)""")
def path_resolve(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").alias("protein_id"), F.expr("case when page_id % 3 = 0 then url end").alias("pdb_path"), F.expr("case when page_id % 3 = 1 then concat('/abs/', page_id) end").alias("pdb_filename"))
    return resolve_structure_paths(pages, "/data").select("page_id", "pdb_path")


@query("""SELECT vec_id, i::INT AS place, round(list_concat(embedding, [vec_id::FLOAT, label::FLOAT])[i + 1]::DOUBLE, 6) AS value
    FROM (SELECT vec_id, label, embedding, unnest(range(0, len(embedding) + 2)) AS i FROM embeddings)""")
def embedding_join_concat(spark, sf_dir):
    """Every element of the joined model inputs."""
    v = table(spark, sf_dir, "embeddings")
    data = v.select(F.col("vec_id").alias("protein_id"), F.lit(1).alias("sequence_pos_1based"), F.col("vec_id").alias("label"), F.col("vec_id").cast("double").alias("f1"), F.col("label").cast("double").alias("f2"))
    emb = v.select(F.col("vec_id").alias("protein_id"), F.lit(1).alias("position"), "embedding")
    x = training.model_inputs(data, ["f1", "f2"], "fusion", emb)
    return x.select(F.col("y").cast("long").alias("vec_id"), F.posexplode("x").alias("place", "v")).select("vec_id", "place", F.round(F.col("v").cast("double"), 6).alias("value"))


# A number of 16 bits has eleven significant binary digits, fewer below 2 ** -14.
@query("""SELECT vec_id, i::INT AS place, CASE WHEN x = 0 THEN 0 ELSE round_even(x * scale, 0) / scale END AS value
    FROM (SELECT *, pow(2::DOUBLE, 10 - greatest(floor(log2(abs(CASE WHEN x = 0 THEN 1 ELSE x END))), -14)) AS scale FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings))""")
def half_precision(spark, sf_dir):
    """Every component as it comes back from 16 bits."""

    @F.pandas_udf("array<float>")
    def half(x):
        return pd.Series([embeddings.half_precision(v) for v in x])

    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(half("embedding")).alias("place", "v")).select("vec_id", "place", F.col("v").cast("double").alias("value"))


_POINTS = ", ".join(f"embedding[{3 * k + j + 1}]::DOUBLE * 40 AS {a}{c}" for k, a in enumerate(("n", "m", "c", "o")) for j, c in enumerate("xyz"))
_APART = lambda p, q: "sqrt(" + " + ".join(f"({p}{c} - {q}{c}) * ({p}{c} - {q}{c})" for c in "xyz") + ")"


@query(f"""WITH v AS (SELECT 's' || label || '-' || vec_id // 1000 AS structure_id, vec_id, {_POINTS} FROM embeddings WHERE label IS NOT NULL),
    r AS (SELECT *, (row_number() OVER w - 1)::INT AS residue, {", ".join(f"lag({a}{c}) OVER w AS p{a}{c}" for a in "co" for c in "xyz")} FROM v WINDOW w AS (PARTITION BY structure_id ORDER BY vec_id)),
    h AS (SELECT *, {", ".join(f"n{c} + (pc{c} - po{c}) / {_APART('pc', 'po')} AS h{c}" for c in "xyz")} FROM r WHERE residue > 0 AND vec_id % 5 <> 0),
    t AS (SELECT a.structure_id, a.residue AS acceptor, h.residue AS donor, {_APART("a.o", "h.n")} AS oxn, {_APART("a.c", "h.h")} AS cxh, {_APART("a.o", "h.h")} AS oxh, {_APART("a.c", "h.n")} AS cxn
      FROM h JOIN r a ON a.structure_id = h.structure_id AND a.residue <> h.residue AND a.residue <> h.residue - 1 WHERE {_APART("a.m", "h.m")} <= 9)
    SELECT structure_id, acceptor, donor, round(CASE WHEN least(oxn, cxh, oxh, cxn) < 0.5 THEN -9.9::DOUBLE ELSE 27.888::DOUBLE * (1 / oxn + 1 / cxh - 1 / oxh - 1 / cxn) END, 5) AS energy FROM t""")
def backbone_bonds(spark, sf_dir):
    """Energy of every near pair of a carbonyl and an amide, with all neighbours along a chain taken as bonded."""
    chain = checkpointed(secondary.backbone(backbone_residues(spark, sf_dir), longest_bond=1e9))
    return rounded(secondary.bond_energies(chain), "energy", places=5)


@query()
def secondary_structure(spark, sf_dir):
    return secondary.assign(backbone_residues(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, l_shipdate, CASE WHEN l_returnflag = 'N' THEN l_quantity END AS l_quantity FROM lineitem")
def shard_union(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    new = line.where("l_returnflag = 'N'").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    return rows.union_all([new, line.where("l_returnflag <> 'N'").select("l_orderkey", "l_linenumber", "l_shipdate")])


@query("SELECT DISTINCT o_custkey AS custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderstatus")
    return rows.resume(orders.select("custkey").distinct(), orders.where("o_orderstatus = 'P'"), "custkey")


@query("SELECT conv_id, turn, nullif(regexp_extract(role || '_entity' || turn, '_entity([0-9]+)$', 1), '') AS entity_id, '>' || conv_id || chr(10) || text AS fasta FROM conversations")
def entity_ids_and_fasta(spark, sf_dir):
    pid = F.concat("role", F.lit("_entity"), F.col("turn").cast("string"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sequences.entity_from_id(pid).alias("entity_id"), fasta_record("conv_id", "text").alias("fasta"))


@query()
def train_perceptron(spark, sf_dir):
    """History of a side-chain model on rows of lineitem (label: returned or not)."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("protein_id"), (F.col("l_returnflag") == "R").cast("int").alias("label"), *_COLUMNS)
    ready = dataset.fit_normalizer(line, _COLUMNS).transform(line)
    _, history = training.fit_perceptron(training.model_inputs(ready, _COLUMNS, "sidechain", None), epochs=2)
    return spark.createDataFrame([(h["epoch"], h["loss"]) for h in history], "epoch int, loss double")
