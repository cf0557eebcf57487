"""Queries on spectra, adducts and text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.functions.scalars import charge_of_adduct
from spectrail.catalog.mass_sql import evidence as evidence_sql
from spectrail.catalog.mass_sql import rows_of
from spectrail.operators.adducts import adduct_differences, adduct_universe, universe_rows, ion_mz, mass_of_formula, neutral_mass, possible_losses, with_parsed_adducts
from spectrail.operators.intervals import Tolerance
from spectrail.operators.masses import evidence_hypotheses
from spectrail.operators.scoring import LAYER
from spectrail.operators.spectra import aligned_cosine, annotate_spectra, clean_spectra, combine_replicates, entropy, is_sanitized, packed_index, sanitize, score_histogram, similarity, similarity_edges, total, with_isolated
from spectrail.sources.sinks import merge_rows, mztab_tables, section_lines, to_json_rows
from spectrail.sources.text import mgf_block, mztab_features, parse_mgf, parse_mztab, parse_sdf, section_rows
from spectrail.session import cut, table


def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as spectra: places are m/z, absolute values intensities, the label the precursor."""
    peaks = F.transform("embedding", lambda v, i: F.struct((i + 1).cast("double").alias("mz"), F.abs(v).cast("double").alias("intensity")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("feature_id"), (F.size("embedding") + F.col("label") + 2.0).alias("precursor_mz"), F.col("label"), peaks.alias("peaks"))


def spectral_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spectra(spark, sf_dir).select("feature_id", F.round(entropy(F.col("peaks")), 6).alias("entropy"))


def _same_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _spectra(spark, sf_dir)
    b = a.select(F.col("feature_id").alias("other"), "label", F.col("peaks").alias("other_peaks"), F.col("precursor_mz").alias("other_mz"))
    return a.join(b, "label").where("feature_id < other")


def cosine_sqrt_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of square-rooted intensities, for aligned spectra of one label, without leaving the JVM."""
    return _same_label(spark, sf_dir).select("feature_id", "other", F.round(aligned_cosine(F.col("peaks"), F.col("other_peaks")), 6).alias("score"))


def shifted_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel with moved peaks: each spectrum against the next one by id, whose precursor mostly differs, so that peaks pair as they are or moved."""
    a = _spectra(spark, sf_dir)
    b = a.select(F.col("feature_id").alias("other"), F.col("peaks").alias("other_peaks"), F.col("precursor_mz").alias("other_mz"))
    s = similarity("gnps", 0.01, 10.0)("peaks", "other_peaks", "precursor_mz", "other_mz")
    return a.join(b, F.col("other") == F.col("feature_id") + 1).select("feature_id", "other", s.alias("s")).select("feature_id", "other", F.round("s.score", 6).alias("score"))


def entropy_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = similarity("entropy", 0.01, 10.0)("peaks", "other_peaks", "precursor_mz", "other_mz")
    return _same_label(spark, sf_dir).select("feature_id", "other", F.round(s["score"], 6).alias("score"))


def spectra_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spectra(spark, sf_dir)
    edges = similarity_edges(rows, "gnps", threshold=0.9, least_matches=2)
    return with_isolated(edges.select("feature_source", "feature_target", F.round("candidate_score_similarity", 6).alias("candidate_score_similarity"), "matches"), rows)


def spectra_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spectra(spark, sf_dir).withColumn("adduct", F.lit("[M+H]+"))
    library = rows.select(F.col("feature_id").alias("spectrum_id"), F.concat(F.lit("S"), "label").alias("structure"), "precursor_mz", "peaks", "adduct")
    return annotate_spectra(rows, library, Tolerance(10.0, 0.01), 0.9).select("feature_id", "structure", "spectrum_id", "candidate_adduct_match_mode")


def spectrum_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring places closer than 1.5 merge into one peak."""
    rows = _spectra(spark, sf_dir).withColumn("peaks", F.filter("peaks", lambda p: p["intensity"] > 0))
    clean = rows.withColumn("clean", sanitize(F.col("peaks"), 0.5, 0.0))
    return clean.select("feature_id", F.size("clean").cast("long").alias("n"), F.round(total(F.col("clean")), 5).alias("sum"), is_sanitized(F.col("clean"), 0.5, 0.0).alias("ok"))


def spectra_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = clean_spectra(_spectra(spark, sf_dir), "peaks", cutoff=0.1, least=3)
    return clean.select("feature_id", F.size("peaks").cast("long").alias("n"), F.round(F.array_max(F.transform("peaks", lambda p: p["intensity"])), 6).alias("top"))


def spectra_dynamic_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks that are left by each spectrum's own cut-off."""
    return clean_spectra(_spectra(spark, sf_dir), "peaks").select("feature_id", F.size("peaks").cast("long").alias("n"))


def replicate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spectra of a label as one."""
    one = combine_replicates(_spectra(spark, sf_dir).withColumn("feature_id", F.col("label")))
    return one.select(F.col("feature_id").alias("label"), F.size("peaks").cast("long").alias("n"), F.round(total(F.col("peaks")), 3).alias("sum"))


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_histogram(table(spark, sf_dir, "clean_chemo").where("score_weighted_chemo BETWEEN 0 AND 1 AND NOT isnan(score_weighted_chemo)"), "score_weighted_chemo")


def distance_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("i"))
    return n.join(F.broadcast(n.withColumnRenamed("i", "j")), F.col("i") < F.col("j")).select("i", "j", packed_index(F.col("i"), F.col("j"), 25).cast("long").alias("place"))


# adducts


def _ions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_parsed_adducts(table(spark, sf_dir, "clean_chemo").select("candidate_id", "candidate_adduct", (F.col("candidate_structure_error_mz") + 400).alias("mz")), "candidate_adduct")


def adduct_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ions(spark, sf_dir).groupBy("candidate_adduct").agg(*[F.first(c).alias(c) for c in ("n_mer", "n_iso", "n_charges", "charge")], F.round(F.first("los_add_clu"), 5).alias("los_add_clu"), F.count("*").alias("n"))
    return rows


def adduct_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ions(spark, sf_dir).select("candidate_id", F.round(neutral_mass(F.col("mz")), 4).alias("mass"))


def adduct_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """m/z of the mass of each ion: the ion's own again."""
    rows = _ions(spark, sf_dir).withColumn("m", neutral_mass(F.col("mz")))
    return rows.where("m IS NOT NULL").select("candidate_id", F.round(ion_mz(F.col("m")), 6).alias("mz"))


def adduct_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "clean_chemo").select("candidate_id", charge_of_adduct(F.col("candidate_adduct")).alias("charge"))


#: Ways to write adducts, to be brought to one.
NOTATIONS = ["[M+H]+", "[M+NH4]+", "[M+H-H2O]+", "[M-H2O+H]+", "[M+ACN+H]+", "[2M+Na]+", "[M+2H]2+", "[M+2H]+2", "[M+1+H]+", "[M+FA-H]-", "[M+NH4-NH3]+", "[M+H]+*", "[M]+", "garbage", "[M+H]+/[M+Na]+"]


def adduct_notation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_parsed_adducts(spark.createDataFrame([(x,) for x in NOTATIONS], "adduct string"), "adduct").select("adduct", "canonical", "state_key")


def adduct_universe_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adduct_universe(spark, {"H": 1, "Na": 1, "K": 1, "H4N": 1}, [1, 2], [1, 2], ["C2H3N", "CH4O"], ["H2O", "H3N"])


def adduct_pair_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adduct_differences(adduct_universe(spark, {"H": 1, "Na": 1, "K": 1}, [1], [1], [], ["H2O"]), 0.001).select("group1", "group2", F.round("distance", 6).alias("distance"))


def formula_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "structures_metadata").select(F.col("structure_molecular_formula").alias("formula")).where("formula IS NOT NULL").distinct()
    return rows.select("formula", F.round(mass_of_formula("formula"), 4).alias("mass"))


def loss_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose formula holds the atoms that a loss of ten waters takes."""
    rows = table(spark, sf_dir, "structures_metadata").select("metadata_id", F.col("structure_molecular_formula").alias("formula")).withColumn("adduct", F.lit("[M-10H2O+H]+"))
    return possible_losses(rows, "adduct", "formula").select("metadata_id")


def evidence_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ion hypotheses of events (values as m/z, users as samples) that the library's masses and neighbours support."""
    events = table(spark, sf_dir, "events")
    features = events.select(F.col("event_id").alias("feature_id"), F.col("user_id").alias("sample"), (F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).alias("rt"), (F.col("value") + 100).alias("mz"))
    adducts = adduct_universe(spark, {"H": 1, "Na": 1, "K": 1}, [1], [1, 2], [], ["H2O"])
    library = table(spark, sf_dir, "structures_metadata").select(F.col("structure_exact_mass").alias("exact_mass"))
    return evidence_hypotheses(features, adducts, library, Tolerance(10.0, 0.01), 600.0).select("feature_id", "adduct", "exact_mass", "n_peers", "tier")


# text


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON and back."""
    rows = to_json_rows(table(spark, sf_dir, "supplier"))
    return rows.select(F.from_json("json", "s_suppkey bigint, s_name string, s_acctbal double").alias("r")).select("r.*")


def prefix_dispatch_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "structures_names").select("name_id", F.concat(F.substring("structure_inchikey", 1, 3), "structure_name").alias("line")).where("line IS NOT NULL")
    return section_rows(lines, "name_id", "line", 3).select("prefix", "rest", F.col("place").cast("long").alias("place"))


def mgf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra as MGF text and read again."""
    rows = _spectra(spark, sf_dir).withColumn("feature_id", F.col("feature_id").cast("string"))
    blocks = rows.select(F.regexp_replace(mgf_block(F.col("feature_id"), F.col("precursor_mz"), F.lit(-1), F.col("label") / 2, F.col("peaks")), "END IONS$", "").alias("value"))
    read = parse_mgf(blocks)
    return read.select(F.col("feature_id").cast("long").alias("feature_id"), "precursor_mz", "charge", F.round("rt", 6).alias("rt"), F.size("peaks").cast("long").alias("n"))


def sdf_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "structures_stereo").where("structure_name IS NOT NULL AND structure_inchikey IS NOT NULL")
    blocks = rows.select(F.concat(F.lit("mol\n> <DATABASE_ID>\n"), F.col("stereo_id").cast("string"), F.lit("\n\n> <INCHI_KEY>\n"), F.trim(F.regexp_replace("structure_inchikey", "\\s", "")), F.lit("\n\n")).alias("value"))
    return parse_sdf(blocks, {"id": ["HMDB_ID", "DATABASE_ID"], "inchikey": ["INCHI_KEY"]})


def _mztab_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of the best candidates, as numbered lines."""
    best = table(spark, sf_dir, "clean_chemo").where("feature_id IS NOT NULL AND score_weighted_chemo IS NOT NULL AND NOT isnan(score_weighted_chemo)").groupBy("feature_id").agg(F.max(F.struct("score_weighted_chemo", F.col("candidate_id").alias("i"), F.col(LAYER).alias("l"), F.col("candidate_structure_name").alias("n"), F.col("candidate_adduct").alias("a"), F.when(~F.isnan("candidate_structure_error_mz"), F.col("candidate_structure_error_mz")).alias("e"))).alias("b"))
    results = best.select("feature_id", (F.coalesce("b.e", F.lit(0.0)) + 400).alias("mz"), (F.col("b.score_weighted_chemo") * 10).alias("rt"), F.col("b.a").alias("adduct"), F.col("b.l").alias("structure"), F.col("b.n").alias("name"), F.lit(None).cast("string").alias("formula"), F.lit(None).cast("string").alias("smiles"), F.col("b.score_weighted_chemo").alias("score"), F.lit(1).alias("rank"))
    tables = mztab_tables(results)
    parts = spark.createDataFrame([(0, 0, "MTD\tmzTab-version\t2.0.0-M"), (0, 1, "MTD title\ttest")], "part int, place int, value string").withColumn("s", F.lit(0))
    for n, (name, head, row, order) in enumerate((("sml", "SMH", "SML", "SML_ID"), ("smf", "SFH", "SMF", "SMF_ID"), ("sme", "SEH", "SME", "SME_ID")), 1):
        parts = parts.unionByName(section_lines(tables[name], head, row, [order]).withColumn("s", F.lit(n)))
    return cut(parts.select((F.col("s") * 10_000_000 + F.col("part") * 5_000_000 + F.col("place")).alias("n"), "value"))


def mztab_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of an mzTab-M document written from candidates and read again."""
    smf = parse_mztab(_mztab_lines(spark, sf_dir))["smf"]
    return smf.select(F.col("opt_global_feature_id").alias("feature_id"), F.col("adduct_ion").alias("adduct"), F.col("exp_mass_to_charge").cast("double").alias("mz"))


def mztab_to_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the document's summary rows: one per structure, with the m/z, time and adduct of its first feature."""
    found = mztab_features(parse_mztab(_mztab_lines(spark, sf_dir)))
    return found.select("feature_id", F.round("mz", 6).alias("mz"), F.round("rt", 6).alias("rt"), "adduct")


def mztab_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_mztab(_mztab_lines(spark, sf_dir))["metadata"]


def mztab_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two documents by a stable key, references united."""
    stereo = table(spark, sf_dir, "structures_stereo").where("structure_inchikey_no_stereo IS NOT NULL")

    def side(name: str) -> DataFrame:
        own = stereo.where(F.col("library") == name)
        return own.groupBy(F.col("structure_inchikey_no_stereo").alias("k")).agg(F.array_join(F.array_sort(F.collect_set(F.col("stereo_id").cast("string"))), "|").alias("refs"), F.min("structure_smiles").alias("smiles"))

    return merge_rows(side("florabase"), side("mycoindex"), ["k"], ["refs"])


QUERIES = {
    "spectral_entropy": spectral_entropy,
    "cosine_sqrt_similarity": cosine_sqrt_similarity,
    "shifted_similarity": shifted_similarity,
    "entropy_similarity": entropy_similarity_pairs,
    "spectra_edges": spectra_edges,
    "spectra_annotation": spectra_annotation,
    "spectrum_sanitize": spectrum_sanitize,
    "spectra_cleaning": spectra_cleaning,
    "spectra_dynamic_cutoff": spectra_dynamic_cutoff,
    "replicate_merge": replicate_merge,
    "score_histogram": histogram,
    "distance_index": distance_index,
    "adduct_parse": adduct_parse,
    "adduct_masses": adduct_masses,
    "adduct_round_trip": adduct_round_trip,
    "adduct_charges": adduct_charges,
    "adduct_notation": adduct_notation,
    "adduct_universe": adduct_universe_positive,
    "adduct_pair_differences": adduct_pair_differences,
    "formula_masses": formula_masses,
    "loss_feasibility": loss_feasibility,
    "evidence_engine": evidence_engine,
    "json_props": json_props,
    "json_rows": json_rows,
    "prefix_dispatch_text": prefix_dispatch_text,
    "mgf_round_trip": mgf_round_trip,
    "sdf_records": sdf_records,
    "mztab_round_trip": mztab_round_trip,
    "mztab_features": mztab_to_features,
    "mztab_metadata": mztab_metadata,
    "mztab_merge": mztab_merge,
}

_P = "p AS (SELECT vec_id, label, i + 1 AS mz, abs(embedding[i + 1])::DOUBLE AS v FROM embeddings, LATERAL (SELECT unnest(range(len(embedding))) AS i))"
_COS = f"""{_P}, t AS (SELECT vec_id, label, sum(v) AS s FROM p GROUP BY 1, 2)"""
_MODS = {"[M+H]+": (1, 1, 1.00782503223), "[M+Na]+": (1, 1, 22.989769282), "[M+K]+": (1, 1, 38.9637064864), "[M+NH4]+": (1, 1, 18.03437413335), "[M-H2O+H]+": (1, 1, -17.00273965155 + 0.0), "[2M+H]+": (2, 1, 1.00782503223), "[M-H]-": (1, -1, -1.00782503223), "[M+Cl]-": (1, -1, 34.968852682), "[M+FA-H]-": (1, -1, 43.98982923914)}
_MODS["[M-H2O+H]+"] = (1, 1, 1.00782503223 - (2 * 1.00782503223 + 15.99491461957))
_MODS["[M+FA-H]-"] = (1, -1, 12.0 + 1.00782503223 + 2 * 15.99491461957 - 1.00782503223)
_MOD_ROWS = "VALUES " + ", ".join(f"('{a}', {n}, {z}, {m!r}::DOUBLE)" for a, (n, z, m) in _MODS.items())
SQL = {
    "spectral_entropy": f"WITH {_COS} SELECT p.vec_id AS feature_id, round(-sum(v / s * ln(v / s)), 6) AS entropy FROM p JOIN t USING (vec_id) WHERE v > 0 GROUP BY 1",
    "cosine_sqrt_similarity": f"WITH {_COS} SELECT a.vec_id AS feature_id, b.vec_id AS other, round(sum(sqrt(a.v * b.v)) / sqrt(any_value(x.s) * any_value(y.s)), 6) AS score FROM p a JOIN p b ON a.label = b.label AND a.mz = b.mz AND a.vec_id < b.vec_id JOIN t x ON x.vec_id = a.vec_id JOIN t y ON y.vec_id = b.vec_id GROUP BY 1, 2",
    # Peaks pair at equal places or at places moved by the precursors' difference d: chains in which each edge excludes its neighbours, so the best sum comes by going along.
    "shifted_similarity": f"""WITH RECURSIVE {_COS}, n AS (SELECT a.vec_id AS a, b.vec_id AS b, b.label - a.label AS d, x.s * y.s AS t, len(a.embedding) AS m FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN t x ON x.vec_id = a.vec_id JOIN t y ON y.vec_id = b.vec_id),
z AS (SELECT n.a, n.b, sum(sqrt(p.v * q.v / n.t)) AS score FROM n JOIN p ON p.vec_id = n.a JOIN p q ON q.vec_id = n.b AND q.mz = p.mz WHERE d = 0 GROUP BY 1, 2),
e AS (SELECT n.a, n.b, abs(d) AS d, (p.mz - 1) % abs(d) AS r, 2 * ((CASE WHEN d > 0 THEN p.mz ELSE m + 1 - p.mz END - 1) // abs(d)) AS k0, p.mz AS i, q.mz AS j, sqrt(p.v * q.v / n.t) AS w, CASE WHEN q.mz = p.mz THEN 0 ELSE 1 END AS moved FROM n JOIN p ON p.vec_id = n.a JOIN p q ON q.vec_id = n.b AND (q.mz = p.mz OR q.mz = p.mz + n.d) WHERE d <> 0),
o AS (SELECT a, b, r, w, row_number() OVER (PARTITION BY a, b, r ORDER BY k0 + moved) AS k FROM e),
g AS (SELECT a, b, r, k, w AS m1, 0::DOUBLE AS m2 FROM o WHERE k = 1 UNION ALL SELECT o.a, o.b, o.r, o.k, greatest(g.m1, g.m2 + o.w), g.m1 FROM g JOIN o ON o.a = g.a AND o.b = g.b AND o.r = g.r AND o.k = g.k + 1),
u AS (SELECT a, b, r, max(m1) AS m FROM g GROUP BY 1, 2, 3)
SELECT a AS feature_id, b AS other, round(sum(m), 6) AS score FROM (SELECT a, b, m FROM u UNION ALL SELECT a, b, score FROM z) GROUP BY 1, 2""",
    "spectrum_sanitize": f"WITH {_P} SELECT vec_id AS feature_id, count(*) FILTER (v > 0) AS n, round(sum(v), 5) AS sum, true AS ok FROM p GROUP BY 1",
    "spectra_cleaning": f"WITH {_P}, k AS (SELECT * FROM p WHERE v >= 0.1) SELECT vec_id AS feature_id, count(*) AS n, round(max(v) / sum(v), 6) AS top FROM k GROUP BY 1 HAVING count(*) >= 3",
    "replicate_merge": f"WITH {_P} SELECT label, count(DISTINCT mz) FILTER (v > 0) AS n, round(sum(v), 3) AS sum FROM p GROUP BY 1",
    "score_histogram": "SELECT CAST(least(floor(score_weighted_chemo * 10), 9) AS INT) AS bin, count(*) AS n FROM clean_chemo WHERE score_weighted_chemo BETWEEN 0 AND 1 AND NOT isnan(score_weighted_chemo) GROUP BY 1",
    "distance_index": "WITH n AS (SELECT n_nationkey + 1 AS i FROM nation), p AS (SELECT a.i, b.i AS j FROM n a JOIN n b ON a.i < b.i) SELECT i, j, row_number() OVER (ORDER BY i, j) AS place FROM p",
    "adduct_parse": f"WITH m(a, n_mer, z, d) AS ({_MOD_ROWS}) SELECT candidate_adduct, CAST(n_mer AS INT) AS n_mer, CASE WHEN z IS NOT NULL THEN 0::INT END AS n_iso, CAST(abs(z) AS INT) AS n_charges, CAST(sign(z) AS INT) AS charge, round(d, 5) AS los_add_clu, n FROM (SELECT candidate_adduct, count(*) AS n FROM clean_chemo GROUP BY 1) LEFT JOIN m ON a = candidate_adduct",
    "adduct_masses": f"WITH m(a, n_mer, z, d) AS ({_MOD_ROWS}) SELECT candidate_id, round((candidate_structure_error_mz + 400 - d + z * 0.000548579909065) / n_mer, 4) AS mass FROM clean_chemo LEFT JOIN m ON a = candidate_adduct",
    "adduct_round_trip": "SELECT candidate_id, round(candidate_structure_error_mz + 400, 6) AS mz FROM clean_chemo WHERE candidate_adduct IS NOT NULL AND candidate_structure_error_mz IS NOT NULL",
    "adduct_charges": "SELECT candidate_id, CASE WHEN candidate_adduct LIKE '%-' THEN -1 WHEN candidate_adduct LIKE '%+' THEN 1 END::INT AS charge FROM clean_chemo",
    "json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events",
    "json_rows": "SELECT s_suppkey, s_name, s_acctbal FROM supplier",
    "prefix_dispatch_text": "WITH l AS (SELECT name_id, substr(structure_inchikey, 1, 3) || structure_name AS line FROM structures_names) SELECT substr(line, 1, 3) AS prefix, substr(line, 4) AS rest, row_number() OVER (PARTITION BY substr(line, 1, 3) ORDER BY name_id) AS place FROM l WHERE line IS NOT NULL",
    "mgf_round_trip": f"WITH {_P}, k AS (SELECT vec_id, any_value(label) AS label, count(*) AS n FROM p GROUP BY 1) SELECT vec_id AS feature_id, (SELECT max(len(embedding)) FROM embeddings) + label + 2.0::DOUBLE AS precursor_mz, -1 AS charge, round(label / 2, 6) AS rt, n FROM k",
    "sdf_records": "SELECT stereo_id::VARCHAR AS id, regexp_replace(structure_inchikey, '\\s', '', 'g') AS inchikey FROM structures_stereo WHERE structure_name IS NOT NULL AND structure_inchikey IS NOT NULL",
    "mztab_round_trip": f"WITH b AS (SELECT feature_id, candidate_adduct AS a, {LAYER} AS l, coalesce(CASE WHEN NOT isnan(candidate_structure_error_mz) THEN candidate_structure_error_mz END, 0) + 400 AS mz, score_weighted_chemo * 10 AS rt FROM clean_chemo WHERE feature_id IS NOT NULL AND NOT isnan(score_weighted_chemo) QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY score_weighted_chemo DESC, candidate_id DESC) = 1) SELECT feature_id, a AS adduct, mz FROM b",
    "mztab_features": f"WITH b AS (SELECT feature_id, candidate_adduct AS a, {LAYER} AS l, coalesce(CASE WHEN NOT isnan(candidate_structure_error_mz) THEN candidate_structure_error_mz END, 0) + 400 AS mz, score_weighted_chemo * 10 AS rt FROM clean_chemo WHERE feature_id IS NOT NULL AND NOT isnan(score_weighted_chemo) QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY score_weighted_chemo DESC, candidate_id DESC) = 1), g AS (SELECT l, arg_min(mz, feature_id) AS mz, arg_min(rt, feature_id) AS rt, min(a) AS a FROM b GROUP BY l), n AS (SELECT *, row_number() OVER (ORDER BY l NULLS LAST) AS i FROM g) SELECT i::VARCHAR AS feature_id, round(mz, 6) AS mz, round(rt, 6) AS rt, a AS adduct FROM n",
    "mztab_metadata": "SELECT key, value FROM (VALUES ('mzTab-version', '2.0.0-M'), ('title', 'test')) t(key, value)",
    "mztab_merge": """WITH s AS (SELECT structure_inchikey_no_stereo AS k, library, string_agg(DISTINCT stereo_id::VARCHAR, '|') AS x, min(structure_smiles) AS smiles FROM structures_stereo WHERE structure_inchikey_no_stereo IS NOT NULL AND library IN ('florabase', 'mycoindex') GROUP BY 1, 2),
r AS (SELECT structure_inchikey_no_stereo AS k, string_agg(DISTINCT stereo_id::VARCHAR, '|' ORDER BY stereo_id::VARCHAR) AS refs FROM structures_stereo WHERE structure_inchikey_no_stereo IS NOT NULL AND library IN ('florabase', 'mycoindex') GROUP BY 1)
SELECT k, refs, coalesce(max(smiles) FILTER (library = 'mycoindex'), max(smiles) FILTER (library = 'florabase')) AS smiles FROM r JOIN s USING (k) GROUP BY 1, 2""",
}
#: Masses of the commonest isotopes.
_ELEMENTS = [("C", 12.0), ("H", 1.00782503223), ("N", 14.00307400443), ("O", 15.99491461957), ("P", 30.97376199842), ("S", 31.9720711744), ("F", 18.99840316273), ("Cl", 34.968852682), ("Br", 78.9183376), ("I", 126.9044719)]
_ATOMS = "SELECT formula, regexp_extract(u, '^[A-Z][a-z]?') AS e, coalesce(try_cast(nullif(regexp_extract(u, '\\d+$'), '') AS INT), 1) AS n FROM (SELECT formula, unnest(regexp_extract_all(formula, '[A-Z][a-z]?\\d*')) AS u FROM f)"
_EVENT_FEATURES = "ft AS (SELECT event_id AS f, user_id AS s, epoch_us(ts) / 60000000 AS rt, value + 100 AS mz FROM events)"
_UNIVERSE = universe_rows({"H": 1, "Na": 1, "K": 1}, [1], [1, 2], [], ["H2O"])
SQL["spectra_annotation"] = f"""WITH {_COS}, s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label, count(*) AS n, sum(sqrt(p.v * q.v)) / sqrt(any_value(x.s) * any_value(y.s)) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label JOIN p ON p.vec_id = a.vec_id JOIN p q ON q.vec_id = b.vec_id AND q.mz = p.mz JOIN t x ON x.vec_id = a.vec_id JOIN t y ON y.vec_id = b.vec_id GROUP BY 1, 2, 3)
SELECT a AS feature_id, 'S' || label AS structure, b AS spectrum_id, 'exact_adduct' AS candidate_adduct_match_mode FROM s WHERE score >= 0.9 QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(score, 9) DESC, n DESC, b) = 1"""
SQL["formula_masses"] = f"""WITH f AS (SELECT DISTINCT structure_molecular_formula AS formula FROM structures_metadata WHERE structure_molecular_formula IS NOT NULL), a AS ({_ATOMS}), m(e, w) AS (VALUES {", ".join(f"('{e}', {w!r}::DOUBLE)" for e, w in _ELEMENTS)})
SELECT f.formula, round(sum(n * w), 4) AS mass FROM f LEFT JOIN a ON a.formula = f.formula LEFT JOIN m ON m.e = a.e GROUP BY 1"""
SQL["loss_feasibility"] = f"""WITH f AS (SELECT DISTINCT structure_molecular_formula AS formula FROM structures_metadata WHERE structure_molecular_formula IS NOT NULL), a AS ({_ATOMS}), k AS (SELECT formula, sum(n) FILTER (e = 'H') AS h, sum(n) FILTER (e = 'O') AS o FROM a GROUP BY 1)
SELECT metadata_id FROM structures_metadata LEFT JOIN k ON formula = structure_molecular_formula WHERE structure_molecular_formula IS NULL OR NOT regexp_full_match(structure_molecular_formula, '([A-Z][a-z]?\\d*)+') OR (coalesce(h, 0) >= 20 AND coalesce(o, 0) >= 10)"""
SQL["evidence_engine"] = f"""WITH {_EVENT_FEATURES}, un(x, n, z, am, tier) AS (VALUES {rows_of(_UNIVERSE)}), lib AS (SELECT DISTINCT structure_exact_mass AS em FROM structures_metadata WHERE structure_exact_mass > 0), {evidence_sql("ft", 10.0, 0.01, 600.0)}
SELECT f AS feature_id, x AS adduct, em AS exact_mass, CAST(peers AS INT) AS n_peers, tier FROM ev"""
_EVEN = """q AS (SELECT vec_id, label, mz, v / s AS w FROM p JOIN t USING (vec_id, label) WHERE v > 0), h AS (SELECT vec_id, -sum(w * ln(w)) AS e FROM q GROUP BY 1),
u AS (SELECT q.vec_id, label, mz, CASE WHEN e < 3 THEN pow(w, 0.25 + e * 0.25) ELSE w END AS w FROM q JOIN h USING (vec_id)), n AS (SELECT vec_id, sum(w) AS s FROM u GROUP BY 1), k AS (SELECT u.vec_id, label, mz, w / s AS w FROM u JOIN n USING (vec_id))"""
SQL["entropy_similarity"] = f"""WITH {_COS}, {_EVEN} SELECT a.vec_id AS feature_id, b.vec_id AS other, round(sum((a.w + b.w) * ln(a.w + b.w) - a.w * ln(a.w) - b.w * ln(b.w)) / ln(4), 6) AS score
FROM k a JOIN k b ON a.label = b.label AND a.mz = b.mz AND a.vec_id < b.vec_id GROUP BY 1, 2"""
SQL["spectra_dynamic_cutoff"] = f"""WITH {_P}, k AS (SELECT vec_id, v FROM p WHERE v > 0), m AS (SELECT vec_id, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.05) AS low FROM k GROUP BY 1), d AS (SELECT vec_id, quantile_cont(abs(v - med), 0.5) AS mad FROM k JOIN m USING (vec_id) GROUP BY 1)
SELECT vec_id AS feature_id, count(*) AS n FROM k JOIN m USING (vec_id) JOIN d USING (vec_id) WHERE v >= CASE WHEN med - 2 * 1.4826 * mad > 0 THEN med - 2 * 1.4826 * mad ELSE low END GROUP BY 1"""
SQL["adduct_pair_differences"] = """WITH c(e, w) AS (VALUES ('H', 1.00782503223::DOUBLE), ('Na', 22.989769282::DOUBLE), ('K', 38.9637064864::DOUBLE)), l(t, w) AS (VALUES ('', 0::DOUBLE), ('-H2O', 2 * 1.00782503223::DOUBLE + 15.99491461957::DOUBLE)),
u AS (SELECT '[M' || t || '+' || e || ']+' AS x, c.w - l.w AS w FROM c, l) SELECT a.x AS group1, b.x AS group2, round(b.w - a.w, 6) AS distance FROM u a JOIN u b ON a.w < b.w AND b.w - a.w >= 0.001"""
