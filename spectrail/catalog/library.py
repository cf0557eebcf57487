"""Queries on biological and chemical evidence and on structure-organism libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.functions.scalars import chemont_id, collapse_first_seen
from spectrail.operators.libraries import (
    ORGANISM_RANKS, assemble_library, enrich_structures, exploded, exploded_together, merge_libraries, pair_keys, pivot_xrefs, rt_library, split_pairs,
    standardized_smiles, structure_stereo, supplement_from_cache, taxonomic_filter,
)
from spectrail.operators.scoring import LAYER
from spectrail.operators.taxonomy import BIO_RANKS, biological_scores, chemical_scores, label_levels, neighbour_votes, organism_lookup, predicted_classes, voting_edges
from spectrail.session import table

_CLA = ["cla_01kin", "cla_02sup", "cla_03cla", "cla_04dirpar"]
_NPC = ["npc_01pat", "npc_02sup", "npc_03cla"]
LEVELS = ["cla_02sup", "cla_03cla", "npc_01pat", "npc_03cla"]


def _sop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "structure_organism_pairs")


def _samples(spark: SparkSession, sf_dir: str, ranks: list[str]) -> DataFrame:
    """Candidate layers with the sample organisms of weight_bio and their ranks."""
    bio = table(spark, sf_dir, "weight_bio").select(F.col(LAYER).alias("structure"), "sample_organism_name").where("structure IS NOT NULL AND sample_organism_name IS NOT NULL").distinct()
    ref = table(spark, sf_dir, "organism_reference").select(F.col("organism_name").alias("sample_organism_name"), *[F.col(f"organism_taxonomy_{r}").alias(f"sample_{r}") for r in ranks])
    return bio.join(ref, "sample_organism_name")


def _organisms(spark: SparkSession, sf_dir: str, ranks: list[str]) -> DataFrame:
    return table(spark, sf_dir, "organism_reference").select("organism_name", *[F.col(f"organism_taxonomy_{r}").alias(f"candidate_{r}") for r in ranks])


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sop(spark, sf_dir).select(F.col("structure_inchikey_connectivity_layer").alias("structure"), "organism_name")


def bio_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return biological_scores(_pairs(spark, sf_dir), _samples(spark, sf_dir, list(BIO_RANKS)), _organisms(spark, sf_dir, list(BIO_RANKS)))


def bio_score_multi_organism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample cells that hold all organisms of a structure's samples."""
    ranks = {"06family": 0.6, "08genus": 0.8, "01domain": 0.1}
    one = _samples(spark, sf_dir, list(ranks))
    cells = one.groupBy("structure").agg(*[F.array_join(F.array_sort(F.collect_set(c)), " $ ").alias(c) for c in ("sample_organism_name", *[f"sample_{r}" for r in ranks])])
    organisms = _organisms(spark, sf_dir, list(ranks))
    return biological_scores(_pairs(spark, sf_dir), cells, organisms, {"01domain": 0.1, "06family": 0.6, "08genus": 0.8}, collapsed=True)


def _class_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with one class of each level for their layer."""
    classes = _sop(spark, sf_dir).where("structure_inchikey_connectivity_layer IS NOT NULL").groupBy(F.col("structure_inchikey_connectivity_layer").alias(LAYER)).agg(*[F.min(f"structure_tax_{x}").alias(f"candidate_structure_tax_{x}") for x in LEVELS])
    bio = table(spark, sf_dir, "weight_bio").where(f"feature_id IS NOT NULL AND {LAYER} IS NOT NULL").groupBy("feature_id", LAYER).agg(F.max(F.when(~F.isnan("score_biological"), F.col("score_biological"))).alias("score_weighted_bio"))
    return bio.join(classes, LAYER)


def _network(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "annotate_masses_hypothesis").where("feature_id IS NOT NULL AND feature_id_dest IS NOT NULL")
    return rows.select(F.col("feature_id").alias("feature_source"), F.col("feature_id_dest").alias("feature_target"), F.col("delta").alias("feature_spectrum_entropy"))


def neighbour_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = neighbour_votes(voting_edges(_network(spark, sf_dir)), _class_annotations(spark, sf_dir), "score_weighted_bio", LEVELS, least=0.2)
    return votes.select("feature_source", "level", "val", F.round("consistency", 6).alias("consistency"), F.round("score", 6).alias("score"))


def chem_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _class_annotations(spark, sf_dir)
    predicted = rows.groupBy("feature_id").agg(*[F.max(f"candidate_structure_tax_{x}").alias(f"feature_pred_tax_{x}_val") for x in LEVELS])
    weights = {"cla_02sup": 0.25, "cla_03cla": 0.5, "npc_01pat": 0.75, "npc_03cla": 1.0}
    return chemical_scores(rows.join(predicted, "feature_id"), weights).select("feature_id", LAYER, "score_chemical")


def predicted_class_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by the structure or by the neighbours, whichever scores higher."""
    rows = _class_annotations(spark, sf_dir)
    votes = neighbour_votes(voting_edges(_network(spark, sf_dir)), rows, "score_weighted_bio", LEVELS)
    joined = rows.join(predicted_classes(votes, LEVELS), "feature_id", "left")
    return label_levels(joined, LEVELS, "score_weighted_bio").select("feature_id", LAYER, *[f"label_{x}" for x in LEVELS])


def organism_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    sop = _sop(spark, sf_dir)
    pairs = sop.select(F.col("structure_inchikey").alias("structure"), "organism_name", F.col("reference_doi").alias("reference"))
    organisms = table(spark, sf_dir, "organism_reference").select("organism_name", *[f"organism_taxonomy_{r}" for r in ORGANISM_RANKS])
    wanted = sop.where("organism_taxonomy_06family IS NOT NULL AND structure_inchikey IS NOT NULL").groupBy(F.col("structure_inchikey").alias("structure")).agg(F.min("organism_taxonomy_06family").alias("taxon"))
    return organism_lookup(pairs, organisms, wanted)


def sop_keys_doi_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_keys(_sop(spark, sf_dir))


def sop_stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_stereo(_sop(spark, sf_dir)).drop("structure_name")


def sop_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_pairs(_sop(spark, sf_dir))["str_met"]


def sop_organisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_pairs(_sop(spark, sf_dir))["org_tax_ott"]


def sop_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_pairs(_sop(spark, sf_dir))["str_tax_cla"]


def sop_pathways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_pairs(_sop(spark, sf_dir))["str_tax_npc"]


def sop_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each structure, distinct without regard to case."""
    return structure_stereo(_sop(spark, sf_dir)).select("structure_inchikey", "structure_name")


def library_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair keys with the normalised tables joined back."""
    t = split_pairs(_sop(spark, sf_dir))
    joined = assemble_library(t["key"], [t["str_stereo"].select("structure_inchikey", "structure_xlogp"), t["str_tax_cla"].select("structure_inchikey", "structure_tax_cla_01kin"), t["org_tax_ott"].select("organism_name", "organism_taxonomy_06family")])
    return joined.groupBy("structure_tax_cla_01kin", "organism_taxonomy_06family").agg(F.count("*").alias("n"), F.max("structure_xlogp").alias("xlogp"))


def library_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rows of two libraries with different columns."""
    a = _sop(spark, sf_dir).select("structure_inchikey", "structure_name")
    b = table(spark, sf_dir, "structures_stereo").select("structure_inchikey", "structure_tag")
    return merge_libraries([a, b]).groupBy((F.col("structure_tag").isNull()).alias("untagged")).agg(F.count("*").alias("n"))


def taxon_filter_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomic_filter(_sop(spark, sf_dir).select("organism_name", "pair_id"), table(spark, sf_dir, "organism_reference"), "organism_taxonomy_06family", "^(Ba|Br|Py).*ceae$").select("pair_id")


def cache_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _sop(spark, sf_dir).where("organism_name IS NOT NULL").select("organism_name").distinct().withColumn("family", F.lit("own"))
    cache = table(spark, sf_dir, "organism_reference").select(F.col("organism_name").alias("name"), F.col("organism_taxonomy_06family").alias("fam"))
    return supplement_from_cache(own, cache, "organism_name", {"name": "organism_name", "fam": "family"})


def metadata_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sop(spark, sf_dir).select("pair_id", "structure_inchikey", "structure_inchikey_connectivity_layer", "structure_name", "structure_xlogp")
    stereo = table(spark, sf_dir, "structures_stereo")
    a = stereo.where("structure_inchikey IS NOT NULL").groupBy("structure_inchikey").agg(F.min("structure_name").alias("structure_name"), F.min(F.when(~F.isnan("structure_xlogp"), F.col("structure_xlogp"))).alias("structure_xlogp"))
    b = stereo.where("structure_inchikey_connectivity_layer IS NOT NULL").groupBy("structure_inchikey_connectivity_layer").agg(F.max("structure_name").alias("structure_name"), F.max(F.when(~F.isnan("structure_xlogp"), F.col("structure_xlogp"))).alias("structure_xlogp"))
    return enrich_structures(rows, [("structure_inchikey", a), ("structure_inchikey_connectivity_layer", b)], ["structure_name", "structure_xlogp"]).select("pair_id", "structure_name", "structure_xlogp")


def xref_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    xrefs = table(spark, sf_dir, "structures_stereo").select(F.col("structure_inchikey_connectivity_layer").alias("inchikey"), F.col("library").alias("prefix"), F.col("stereo_id").cast("string").alias("id")).where("inchikey IS NOT NULL")
    return pivot_xrefs(xrefs, ["bulkimport", "florabase", "leafnotes", "mycoindex"])


def explode_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(table(spark, sf_dir, "structures_stereo").select("stereo_id", "structure_tag"), "structure_tag", ";")


def explode_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "structures_stereo").groupBy("structure_inchikey_no_stereo").agg(F.array_join(F.array_sort(F.collect_set("library")), " $ ").alias("libraries"), F.array_join(F.array_sort(F.collect_set(F.col("stereo_id").cast("string"))), " $ ").alias("ids"))
    return exploded_together(cells.where("structure_inchikey_no_stereo IS NOT NULL"), ["libraries", "ids"])


def retention_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "structures_stereo").select(F.col("structure_xlogp").alias("rt"), "structure_inchikey").where("NOT isnan(rt)")
    return rt_library(rows, "seconds", "predicted").select(F.round("rt", 6).alias("rt"), LAYER, "type").distinct()


def chemont_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sop(spark, sf_dir).select("pair_id", chemont_id(F.regexp_replace("structure_tax_cla_chemontid", "^CHEMONTID:", "C")).alias("chemont"))


def names_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each structure in the order in which they came."""
    return table(spark, sf_dir, "structures_names").where("structure_inchikey IS NOT NULL").groupBy("structure_inchikey").agg(collapse_first_seen(F.col("name_id"), F.col("structure_name")).alias("names"))


def smiles_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures standardised through the cache of known ones."""
    cache = table(spark, sf_dir, "structures_stereo").where("structure_smiles IS NOT NULL").groupBy("structure_smiles").agg(F.min("structure_smiles_no_stereo").alias("canonical"))
    return standardized_smiles(_sop(spark, sf_dir).select("pair_id", "structure_smiles"), "structure_smiles", cache).select("pair_id", "canonical")


QUERIES = {
    "bio_score": bio_score,
    "bio_score_multi_organism": bio_score_multi_organism,
    "neighbour_vote": neighbour_vote,
    "chem_score": chem_score,
    "predicted_class_labels": predicted_class_labels,
    "organism_lookup": organism_references,
    "sop_keys_doi_rule": sop_keys_doi_rule,
    "sop_stereo": sop_stereo,
    "sop_metadata": sop_metadata,
    "sop_organisms": sop_organisms,
    "sop_classes": sop_classes,
    "sop_pathways": sop_pathways,
    "sop_names": sop_names,
    "library_assembly": library_assembly,
    "library_merge": library_merge,
    "taxon_filter_regex": taxon_filter_regex,
    "cache_supplement": cache_supplement,
    "metadata_enrichment": metadata_enrichment,
    "xref_pivot": xref_pivot,
    "explode_multi": explode_multi,
    "explode_parallel": explode_parallel,
    "rt_library": retention_library,
    "chemont_ids": chemont_ids,
    "names_in_order": names_in_order,
    "smiles_cache": smiles_cache,
}

_RANK = "organism_taxonomy_{}"
_PAIRS = "p AS (SELECT DISTINCT structure_inchikey_connectivity_layer AS s, organism_name AS o FROM structure_organism_pairs WHERE structure_inchikey_connectivity_layer IS NOT NULL AND organism_name IS NOT NULL)"
_SAMPLES = f"w AS (SELECT DISTINCT {LAYER} AS s, sample_organism_name AS n FROM weight_bio WHERE {LAYER} IS NOT NULL AND sample_organism_name IS NOT NULL)"


def _best(ranks: dict[str, float], match: str) -> tuple[str, str]:
    cases = ", ".join("CASE WHEN {c} IS NOT NULL AND {s} IS NOT NULL AND {c} <> 'notClassified' AND {s} <> 'ND' AND {m} THEN {v}::DOUBLE END".format(c=f'c."organism_taxonomy_{r}"', s=f's."organism_taxonomy_{r}"', m=match.format(c=f'c."organism_taxonomy_{r}"', s=f's."organism_taxonomy_{r}"'), v=v) for r, v in ranks.items())
    closest = " ".join(f'WHEN score = {v}::DOUBLE THEN c."organism_taxonomy_{r}"' for r, v in ranks.items())
    return f"greatest({cases})", f"CASE {closest} END"


_SCORE, _CLOSEST = _best(BIO_RANKS, "{c} = {s}")
_MANY, _MANY_CLOSEST = _best({"01domain": 0.1, "06family": 0.6, "08genus": 0.8}, "contains({s}, {c})")
_ANN = f"""cl AS (SELECT structure_inchikey_connectivity_layer AS l, {", ".join(f"min(structure_tax_{x}) AS {x}" for x in LEVELS)} FROM structure_organism_pairs WHERE structure_inchikey_connectivity_layer IS NOT NULL GROUP BY 1),
b AS (SELECT feature_id AS f, {LAYER} AS l, max(score_biological) FILTER (NOT isnan(score_biological)) AS sc FROM weight_bio WHERE feature_id IS NOT NULL AND {LAYER} IS NOT NULL GROUP BY 1, 2),
ann AS (SELECT * FROM b JOIN cl USING (l))"""
_VOTE = f"""{_ANN}, e0 AS (SELECT DISTINCT feature_id AS s, feature_id_dest AS t FROM annotate_masses_hypothesis WHERE feature_id <> feature_id_dest AND delta > 0),
e AS (SELECT * FROM e0 QUALIFY count(*) OVER (PARTITION BY s) >= 2), nt AS (SELECT s, count(DISTINCT t) AS n FROM e WHERE t IN (SELECT f FROM ann) GROUP BY s),
long AS (UNPIVOT (SELECT f, sc, {", ".join(LEVELS)} FROM ann) ON {", ".join(LEVELS)} INTO NAME level VALUE val), own AS (SELECT f, level, val, max(sc) AS sc FROM long GROUP BY 1, 2, 3),
cnt AS (SELECT e.s, level, val, count(*) AS k FROM e JOIN own ON e.t = own.f GROUP BY 1, 2, 3),
v AS (SELECT cnt.s, cnt.level, cnt.val, k / n AS consistency, k / n * own.sc AS score FROM cnt JOIN nt USING (s) LEFT JOIN own ON cnt.s = own.f AND cnt.level = own.level AND cnt.val = own.val),
win AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY s, level ORDER BY score DESC NULLS LAST, val) = 1)"""


def _set(c: str) -> str:
    return f"string_agg(DISTINCT trim({c}), ' $ ' ORDER BY trim({c})) FILTER (trim({c}) <> '')"


_CHEMONT = "'CHEMONTID:' || lpad(regexp_extract({0}, '(\\d+)\\s*$', 1), 7, '0')"
_ID = _CHEMONT.format("structure_tax_cla_chemontid")
SQL = {
    "bio_score": f"""WITH {_PAIRS}, {_SAMPLES}, m AS (SELECT p.s AS st, n, o, {_SCORE} AS score, c.organism_name AS cn FROM p JOIN w USING (s) JOIN organism_reference c ON c.organism_name = o JOIN organism_reference s ON s.organism_name = n),
k AS (SELECT m.*, {_CLOSEST} AS closest FROM m JOIN organism_reference c ON c.organism_name = m.o)
SELECT st AS structure, n AS sample_organism_name, (max((score, closest)))[1] AS score_biological, (max((score, closest)))[2] AS closest FROM k WHERE closest IS NOT NULL GROUP BY 1, 2""",
    "bio_score_multi_organism": f"""WITH {_PAIRS}, {_SAMPLES}, cell AS (SELECT s AS st, string_agg(DISTINCT n, ' $ ' ORDER BY n) AS n, {", ".join(f'string_agg(DISTINCT "organism_taxonomy_{r}", {chr(39)} $ {chr(39)} ORDER BY "organism_taxonomy_{r}") AS "organism_taxonomy_{r}"' for r in ("01domain", "06family", "08genus"))} FROM w JOIN organism_reference ON organism_name = n GROUP BY s),
one AS (SELECT * FROM cell QUALIFY row_number() OVER (PARTITION BY n) = 1), m AS (SELECT DISTINCT cell.st, cell.n, o FROM cell JOIN p ON p.s = cell.st),
k AS (SELECT m.st, m.n, m.o, {_MANY} AS score FROM m JOIN one s ON s.n = m.n JOIN organism_reference c ON c.organism_name = m.o), z AS (SELECT k.*, {_MANY_CLOSEST} AS closest FROM k JOIN organism_reference c ON c.organism_name = k.o)
SELECT st AS structure, n AS sample_organism_name, (max((score, closest)))[1] AS score_biological, (max((score, closest)))[2] AS closest FROM z WHERE closest IS NOT NULL GROUP BY 1, 2""",
    "neighbour_vote": f"WITH {_VOTE} SELECT s AS feature_source, level, CASE WHEN score IS NULL THEN NULL WHEN score >= 0.2 THEN val ELSE 'notConsistent' END AS val, round(consistency, 6) AS consistency, round(score, 6) AS score FROM win",
    "chem_score": f"""WITH {_ANN}, pr AS (SELECT f, {", ".join(f"max({x}) AS p_{x}" for x in LEVELS)} FROM ann GROUP BY f)
SELECT f AS feature_id, l AS {LAYER}, greatest({", ".join(f"CASE WHEN {x} IS NOT NULL AND p_{x} IS NOT NULL AND {x} <> 'notClassified' AND contains(p_{x}, {x}) THEN {v}::DOUBLE END" for x, v in zip(LEVELS, (0.25, 0.5, 0.75, 1.0), strict=True))}, 0::DOUBLE) AS score_chemical FROM ann JOIN pr USING (f)""",
    "organism_lookup": f"""WITH w AS (SELECT structure_inchikey AS s, min(organism_taxonomy_06family) AS taxon FROM structure_organism_pairs WHERE organism_taxonomy_06family IS NOT NULL AND structure_inchikey IS NOT NULL GROUP BY 1),
l AS (SELECT DISTINCT organism_name, taxon FROM (UNPIVOT organism_reference ON {", ".join(f'"organism_taxonomy_{r}"' for r in ORGANISM_RANKS)} INTO NAME rank VALUE taxon))
SELECT w.s AS structure, w.taxon, string_agg(DISTINCT reference_doi, ' $ ' ORDER BY reference_doi) AS "references" FROM w JOIN structure_organism_pairs p ON p.structure_inchikey = w.s JOIN l ON l.organism_name = p.organism_name AND l.taxon = w.taxon WHERE reference_doi IS NOT NULL GROUP BY 1, 2""",
    "sop_keys_doi_rule": """WITH k AS (SELECT DISTINCT structure_inchikey, organism_name, reference_doi FROM structure_organism_pairs)
SELECT * FROM k QUALIFY reference_doi IS NOT NULL OR count(*) OVER (PARTITION BY structure_inchikey, organism_name) = 1""",
    "sop_stereo": f"SELECT structure_inchikey, min(structure_smiles) AS structure_smiles, min(structure_xlogp) AS structure_xlogp, {_set('structure_tag')} AS structure_tag FROM structure_organism_pairs WHERE structure_inchikey IS NOT NULL GROUP BY 1",
    "sop_metadata": """SELECT substr(structure_inchikey, 1, 14) || '-' || right(structure_inchikey, 1) AS structure_inchikey_no_stereo, structure_molecular_formula, structure_exact_mass FROM structure_organism_pairs WHERE structure_inchikey IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY substr(structure_inchikey, 1, 14) || '-' || right(structure_inchikey, 1) ORDER BY structure_exact_mass NULLS LAST, structure_molecular_formula NULLS LAST) = 1""",
    "sop_organisms": "SELECT organism_name, min(organism_taxonomy_ottid) AS organism_taxonomy_ottid, " + ", ".join(f"coalesce(min(organism_taxonomy_{r}), 'notClassified') AS organism_taxonomy_{r}" for r in ORGANISM_RANKS) + " FROM structure_organism_pairs WHERE organism_name IS NOT NULL GROUP BY 1",
    "sop_classes": f"WITH x AS (SELECT * REPLACE ({_ID} AS structure_tax_cla_chemontid) FROM structure_organism_pairs WHERE structure_inchikey IS NOT NULL) SELECT structure_inchikey, " + ", ".join(f"coalesce({_set(c)}, 'notClassified') AS {c}" for c in ("structure_tax_cla_chemontid", *[f"structure_tax_{x}" for x in _CLA])) + " FROM x GROUP BY 1",
    "sop_pathways": "SELECT structure_smiles, " + ", ".join(f"coalesce({_set(f'structure_tax_{x}')}, 'notClassified') AS structure_tax_{x}" for x in _NPC) + " FROM structure_organism_pairs WHERE structure_smiles IS NOT NULL GROUP BY 1",
    "sop_names": """WITH n AS (SELECT structure_inchikey, lower(trim(structure_name)) AS k, min(trim(structure_name)) AS v FROM structure_organism_pairs WHERE structure_inchikey IS NOT NULL AND trim(structure_name) <> '' GROUP BY 1, 2),
s AS (SELECT DISTINCT structure_inchikey FROM structure_organism_pairs WHERE structure_inchikey IS NOT NULL) SELECT structure_inchikey, string_agg(v, ' $ ' ORDER BY v) AS structure_name FROM s LEFT JOIN n USING (structure_inchikey) GROUP BY 1""",
    "library_assembly": f"""WITH k AS (SELECT DISTINCT structure_inchikey, organism_name, reference_doi FROM structure_organism_pairs), q AS (SELECT * FROM k QUALIFY reference_doi IS NOT NULL OR count(*) OVER (PARTITION BY structure_inchikey, organism_name) = 1),
s AS (SELECT structure_inchikey, min(structure_xlogp) AS x, coalesce({_set('structure_tax_cla_01kin')}, 'notClassified') AS kin FROM structure_organism_pairs WHERE structure_inchikey IS NOT NULL GROUP BY 1),
o AS (SELECT organism_name, coalesce(min(organism_taxonomy_06family), 'notClassified') AS fam FROM structure_organism_pairs WHERE organism_name IS NOT NULL GROUP BY 1)
SELECT kin AS structure_tax_cla_01kin, fam AS organism_taxonomy_06family, count(*) AS n, max(x) AS xlogp FROM q LEFT JOIN s USING (structure_inchikey) LEFT JOIN o USING (organism_name) GROUP BY 1, 2""",
    "library_merge": "SELECT structure_tag IS NULL AS untagged, count(*) AS n FROM (SELECT structure_inchikey, structure_name, NULL AS structure_tag FROM structure_organism_pairs UNION SELECT structure_inchikey, NULL, structure_tag FROM structures_stereo) GROUP BY 1",
    "taxon_filter_regex": "SELECT pair_id FROM structure_organism_pairs WHERE organism_name IN (SELECT organism_name FROM organism_reference WHERE regexp_matches(organism_taxonomy_06family, '^(Ba|Br|Py).*ceae$'))",
    "cache_supplement": "WITH o AS (SELECT DISTINCT organism_name, 'own' AS family FROM structure_organism_pairs WHERE organism_name IS NOT NULL) SELECT * FROM o UNION ALL SELECT organism_name, organism_taxonomy_06family FROM organism_reference WHERE organism_name NOT IN (SELECT organism_name FROM o)",
    "metadata_enrichment": """WITH a AS (SELECT structure_inchikey AS k, min(structure_name) AS n, min(structure_xlogp) FILTER (NOT isnan(structure_xlogp)) AS x FROM structures_stereo WHERE structure_inchikey IS NOT NULL GROUP BY 1),
b AS (SELECT structure_inchikey_connectivity_layer AS k, max(structure_name) AS n, max(structure_xlogp) FILTER (NOT isnan(structure_xlogp)) AS x FROM structures_stereo WHERE structure_inchikey_connectivity_layer IS NOT NULL GROUP BY 1)
SELECT pair_id, coalesce(p.structure_name, a.n, b.n) AS structure_name, coalesce(p.structure_xlogp, a.x, b.x) AS structure_xlogp FROM structure_organism_pairs p LEFT JOIN a ON p.structure_inchikey = a.k LEFT JOIN b ON p.structure_inchikey_connectivity_layer = b.k""",
    "xref_pivot": "SELECT structure_inchikey_connectivity_layer AS inchikey, " + ", ".join(f"string_agg(DISTINCT stereo_id::VARCHAR, ' $ ' ORDER BY stereo_id::VARCHAR) FILTER (library = '{p}') AS {p}" for p in ("bulkimport", "florabase", "leafnotes", "mycoindex")) + " FROM structures_stereo WHERE structure_inchikey_connectivity_layer IS NOT NULL GROUP BY 1",
    "explode_multi": """WITH p AS (SELECT stereo_id, trim(unnest(str_split(structure_tag, ';'))) AS structure_tag FROM structures_stereo WHERE structure_tag IS NOT NULL), k AS (SELECT * FROM p WHERE structure_tag <> '')
SELECT stereo_id, k.structure_tag FROM structures_stereo s LEFT JOIN k USING (stereo_id)""",
    "explode_parallel": """WITH c AS (SELECT structure_inchikey_no_stereo, list_sort(list(DISTINCT library)) AS a, list_sort(list(DISTINCT stereo_id::VARCHAR)) AS b FROM structures_stereo WHERE structure_inchikey_no_stereo IS NOT NULL GROUP BY 1)
SELECT structure_inchikey_no_stereo, a[i] AS libraries, b[i] AS ids FROM c, LATERAL (SELECT unnest(generate_series(1, greatest(len(a), len(b)))) AS i)""",
    "rt_library": f"SELECT DISTINCT round(structure_xlogp / 60, 6) AS rt, substr(structure_inchikey, 1, 14) AS {LAYER}, 'predicted' AS type FROM structures_stereo WHERE NOT isnan(structure_xlogp) AND structure_inchikey IS NOT NULL",
    "chemont_ids": "SELECT pair_id, structure_tax_cla_chemontid AS chemont FROM structure_organism_pairs",
    "names_in_order": """WITH f AS (SELECT structure_inchikey, trim(structure_name, ' ') AS v, min(name_id) AS o FROM structures_names WHERE structure_inchikey IS NOT NULL AND trim(structure_name, ' ') <> '' GROUP BY 1, 2), s AS (SELECT DISTINCT structure_inchikey FROM structures_names WHERE structure_inchikey IS NOT NULL)
SELECT structure_inchikey, string_agg(v, ' $ ' ORDER BY o) AS names FROM s LEFT JOIN f USING (structure_inchikey) GROUP BY 1""",
    "smiles_cache": "WITH c AS (SELECT structure_smiles, min(structure_smiles_no_stereo) AS canonical FROM structures_stereo WHERE structure_smiles IS NOT NULL GROUP BY 1) SELECT pair_id, canonical FROM structure_organism_pairs LEFT JOIN c USING (structure_smiles)",
}


def _label(x: str) -> str:
    other = f"CASE WHEN p_{x} NOT IN ('notConsistent', 'empty') THEN q_{x} END"
    own = f"CASE WHEN {x} IS NOT NULL THEN sc END"
    return f"CASE WHEN coalesce({own} >= {other}, {own} IS NOT NULL) THEN {x} WHEN {other} IS NOT NULL THEN p_{x} END AS label_{x}"


SQL["predicted_class_labels"] = f"""WITH {_VOTE}, pr AS (SELECT s AS f, {", ".join(f"max(val) FILTER (level = '{x}' AND score >= 0) AS p_{x}, max(score) FILTER (level = '{x}') AS q_{x}" for x in LEVELS)} FROM win GROUP BY 1)
SELECT f AS feature_id, l AS {LAYER}, {", ".join(map(_label, LEVELS))} FROM ann LEFT JOIN pr USING (f)"""
