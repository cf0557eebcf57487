"""Queries of the llm operators over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.llm.components import linked_groups
from spectrail.llm.contamination import find_leaks
from spectrail.llm.duplicates import collapse_formatting, find_copies
from spectrail.llm.language import cross_parse, find_segments, fit, label_code
from spectrail.llm.name_matching import match_names
from spectrail.llm.rank_fusion import rank_items, undisputed_firsts
from spectrail.llm.survivorship import surviving_values
from spectrail.llm.tokenizer import encode_corpus
from spectrail.llm.top_items import top_items
from spectrail.operators.orphans import tidy_key
from spectrail.session import table

# 2: duplicates hidden by formatting differences


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each further way in which a name of a structure is written, with the first record of that name."""
    found = find_copies(table(spark, sf_dir, "structures_names"), "structure_inchikey", "structure_name", "name_id")
    return found.select(F.col("first_id").alias("first_name_id"), F.col("id").alias("name_id"))


def p2_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per name of a structure with the number of its copies and spellings."""
    g = collapse_formatting(table(spark, sf_dir, "structures_names"), "structure_inchikey", "structure_name", "name_id")
    return g.select(F.col("scope").alias("structure_inchikey"), F.col("first_id").alias("first_name_id"), "n_copies", "n_spellings")



# 3: consolidating pairwise matches into groups


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature with the smallest feature of its group."""
    groups = linked_groups(table(spark, sf_dir, "annotate_masses_hypothesis"), "feature_id", "feature_id_dest")
    return groups.select("group_id", F.col("member").alias("feature_id"))


def p3_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of linked features by their size."""
    return p3_found(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("n_features")).groupBy("n_features").agg(F.count("*").alias("n_groups"))


_P3 = """
WITH RECURSIVE e AS (
  SELECT feature_id AS a, feature_id_dest AS b FROM annotate_masses_hypothesis WHERE feature_id <> feature_id_dest
  UNION SELECT feature_id_dest, feature_id FROM annotate_masses_hypothesis WHERE feature_id <> feature_id_dest),
v AS (SELECT feature_id AS f FROM annotate_masses_hypothesis WHERE feature_id IS NOT NULL
  UNION SELECT feature_id_dest FROM annotate_masses_hypothesis WHERE feature_id_dest IS NOT NULL),
reach AS (SELECT f, f AS g FROM v UNION SELECT e.b, r.g FROM reach r JOIN e ON e.a = r.f WHERE r.g < e.b),
groups AS (SELECT min(g) AS group_id, f AS feature_id FROM reach GROUP BY f)
"""

# 4: best representative of each duplicate group


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    stereo, trust = table(spark, sf_dir, "structures_stereo"), table(spark, sf_dir, "library_trust").select("library", "trust_rank")
    return surviving_values(stereo, tidy_key(F.col("structure_inchikey")), "stereo_id", "added_at", "library", trust, ["structure_xlogp", "structure_name", "structure_tag"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each structure with several records, the record that gives each field."""
    names = {"structure_xlogp__from": "xlogp_from", "structure_name__from": "name_from", "structure_tag__from": "tag_from"}
    return _survivors(spark, sf_dir).select(F.col("key").alias("structure_inchikey"), *[F.col(a).alias(b) for a, b in names.items()])


def p4_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of each structure with several records, built field by field."""
    return _survivors(spark, sf_dir).select(F.col("key").alias("structure_inchikey"), "n_records", "structure_xlogp", "structure_name", "structure_tag")


_P4_KEY = r"upper(regexp_replace(structure_inchikey, '^\s+|\s+$', '', 'g'))"
_P4_TEXT = r"regexp_matches({0}, '[\p{{L}}\p{{N}}]') AND lower(trim({0}, E' \t\n\r')) NOT IN ('na', 'n/a', 'nan', 'nd', 'null', 'none', 'empty', 'unknown', 'notclassified')"
_P4 = f"""
WITH s AS (SELECT {_P4_KEY} AS k, t.stereo_id, t.added_at, t.structure_xlogp, t.structure_name, t.structure_tag, coalesce(l.trust_rank, 2147483647) AS trust
  FROM structures_stereo t LEFT JOIN library_trust l USING (library) WHERE structure_inchikey IS NOT NULL),
many AS (SELECT k, count(*) AS n FROM s GROUP BY k HAVING count(*) > 1),
x AS (SELECT k, stereo_id, structure_xlogp, row_number() OVER (PARTITION BY k ORDER BY trust, added_at DESC, stereo_id) AS r FROM s WHERE NOT isnan(structure_xlogp)),
n AS (SELECT k, stereo_id, structure_name, row_number() OVER (PARTITION BY k ORDER BY trust, added_at DESC, stereo_id) AS r FROM s WHERE {_P4_TEXT.format("structure_name")}),
g AS (SELECT k, stereo_id, structure_tag, row_number() OVER (PARTITION BY k ORDER BY trust, added_at DESC, stereo_id) AS r FROM s WHERE {_P4_TEXT.format("structure_tag")})
SELECT @ FROM many LEFT JOIN x ON many.k = x.k AND x.r = 1 LEFT JOIN n ON many.k = n.k AND n.r = 1 LEFT JOIN g ON many.k = g.k AND g.r = 1
"""

# 5: one ranking from several differently scaled scores

_SCORES = ["score_weighted_chemo", "candidate_score_pseudo_initial", "score_biological"]
_LAYER = "candidate_structure_inchikey_connectivity_layer"


def _scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct structures of each feature with the highest of each of their scores."""

    def high(c: str):
        return F.max(F.when(~F.isnan(c), F.col(c))).alias(c)

    chemo = table(spark, sf_dir, "clean_chemo").where("feature_id IS NOT NULL").groupBy("feature_id", _LAYER).agg(high(_SCORES[0]), high(_SCORES[1]))
    bio = table(spark, sf_dir, "weight_bio").where("feature_id IS NOT NULL").groupBy(F.col("feature_id").alias("f"), F.col(_LAYER).alias("l")).agg(high(_SCORES[2]))
    items = chemo.join(bio, (F.col("feature_id") == F.col("f")) & F.col(_LAYER).eqNullSafe(F.col("l")), "left")
    return items.select(F.col("feature_id").alias("g"), F.col(_LAYER).alias("item"), *_SCORES)


def p5_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every structure of a feature with its place in the one ranking, by robust rank aggregation over the whole tables."""
    ranked = rank_items(_scored_items(spark, sf_dir), _SCORES)[0]
    return ranked.select(F.col("g").alias("feature_id"), F.col("item").alias(_LAYER), F.round("rho", 6).alias("rho"), F.col("rank").cast("long").alias("place"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features' undisputed firsts."""
    firsts = undisputed_firsts(_scored_items(spark, sf_dir), _SCORES)
    return firsts.select(F.col("g").alias("feature_id"), F.col("item").alias(_LAYER))


_P5 = f"""
WITH c AS (SELECT feature_id AS f, {_LAYER} AS l, max(score_weighted_chemo) FILTER (NOT isnan(score_weighted_chemo)) AS s1,
    max(candidate_score_pseudo_initial) FILTER (NOT isnan(candidate_score_pseudo_initial)) AS s2 FROM clean_chemo WHERE feature_id IS NOT NULL GROUP BY 1, 2),
b AS (SELECT feature_id AS f, {_LAYER} AS l, max(score_biological) FILTER (NOT isnan(score_biological)) AS s3 FROM weight_bio GROUP BY 1, 2),
i AS (SELECT c.f, c.l, coalesce(s1, '-infinity'::DOUBLE) AS s1, coalesce(s2, '-infinity'::DOUBLE) AS s2, coalesce(s3, '-infinity'::DOUBLE) AS s3
  FROM c LEFT JOIN b ON c.f = b.f AND c.l IS NOT DISTINCT FROM b.l)
"""
_P5_METHOD = (
    _P5
    + f"""
, r AS (SELECT f, l, list_sort([
    (count(*) OVER (PARTITION BY f) - rank() OVER (PARTITION BY f ORDER BY s1) + 1) / count(*) OVER (PARTITION BY f),
    (count(*) OVER (PARTITION BY f) - rank() OVER (PARTITION BY f ORDER BY s2) + 1) / count(*) OVER (PARTITION BY f),
    (count(*) OVER (PARTITION BY f) - rank() OVER (PARTITION BY f ORDER BY s3) + 1) / count(*) OVER (PARTITION BY f)]) AS x FROM i),
p AS (SELECT f, l, round(least(1.0, 3 * least(3*x[1]*pow(1-x[1],2) + 3*pow(x[1],2)*(1-x[1]) + pow(x[1],3), 3*pow(x[2],2)*(1-x[2]) + pow(x[2],3), pow(x[3],3))), 12) AS rho FROM r)
SELECT f AS feature_id, l AS {_LAYER}, round(rho, 6) AS rho, rank() OVER (PARTITION BY f ORDER BY rho) AS place FROM p
"""
)

# 6: top N items within every group


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every feature."""
    return top_items(table(spark, sf_dir, "clean_chemo"), "feature_id", "score_weighted_chemo", "candidate_id", 5).select("feature_id", "candidate_id")


_P6 = """
SELECT feature_id, candidate_id FROM clean_chemo WHERE feature_id IS NOT NULL AND NOT isnan(score_weighted_chemo)
QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY score_weighted_chemo DESC, candidate_id) <= 5
"""

# 7: mapping free-entered values to a canonical list


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed organism name that isn't itself in the list, with the entry it stands for, how that was found and how similar they are."""
    return match_names(table(spark, sf_dir, "taxonomy"), "taxonomy_id", "organism_name", table(spark, sf_dir, "organism_reference"), "ref_id", "organism_name")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of each typed organism name, -1 if it stands for none."""
    return p7_matches(spark, sf_dir).select("taxonomy_id", "ref_id")


def p7_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values that stand for no entry, with their number of rows."""
    return p7_matches(spark, sf_dir).where("ref_id = -1").groupBy("organism_name").agg(F.count("*").alias("n_rows"))


# 8: encoding of the whole corpus with a public tokenizer


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


# 9: evaluation texts leaking into training text


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items that they hold whole, altered or re-parameterised, with the words of the passage."""
    return find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items of which they hold a passage."""
    return p9_leaks(spark, sf_dir).where("kind IN ('exact', 'altered')").select("doc_id", "item_id")


# 10: missing or wrong document language labels


def p10_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document parsed whole against every language: phrases, the language with the fewest, confidence."""
    docs = table(spark, sf_dir, "documents")
    return cross_parse(docs, "doc_id", "text", fit(docs, "doc_id", "text", "lang"))


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment in one language with a confidence."""
    docs = table(spark, sf_dir, "documents")
    return find_segments(docs, "doc_id", "text", fit(docs, "doc_id", "text", "lang"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of each document that has several, or one that its label doesn't name."""
    segments = p10_segments(spark, sf_dir).groupBy("doc_id").agg(F.collect_set("lang").alias("langs"))
    labels = table(spark, sf_dir, "documents").select("doc_id", label_code(F.col("lang")).alias("code"))
    cases = segments.join(labels, "doc_id").where((F.size("langs") > 1) | F.col("code").isNull() | (F.col("langs")[0] != F.col("code")))
    return cases.select("doc_id", F.explode("langs").alias("lang"))


QUERIES = {
    "p2_found": p2_found,
    "p2_collapsed": p2_collapsed,
    "p3_found": p3_found,
    "p3_sizes": p3_sizes,
    "p4_found": p4_found,
    "p4_survivors": p4_survivors,
    "p5_method": p5_method,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_matches": p7_matches,
    "p7_unmatched": p7_unmatched,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
    "p10_found": p10_found,
    "p10_method": p10_method,
    "p10_segments": p10_segments,
}
SQL = {
    "p3_found": _P3 + "SELECT * FROM groups",
    "p3_sizes": _P3 + "SELECT n AS n_features, count(*) AS n_groups FROM (SELECT group_id, count(*) AS n FROM groups GROUP BY 1) GROUP BY 1",
    "p4_found": _P4.replace("@", "many.k AS structure_inchikey, coalesce(x.stereo_id, -1) AS xlogp_from, coalesce(n.stereo_id, -1) AS name_from, coalesce(g.stereo_id, -1) AS tag_from"),
    "p4_survivors": _P4.replace("@", "many.k AS structure_inchikey, many.n AS n_records, x.structure_xlogp, n.structure_name, g.structure_tag"),
    "p5_found": _P5
    + f"""SELECT a.f AS feature_id, a.l AS {_LAYER} FROM i a JOIN i o ON a.f = o.f AND a.l IS DISTINCT FROM o.l
GROUP BY 1, 2 HAVING bool_and((CAST(a.s1 > o.s1 AS INT) + CAST(a.s2 > o.s2 AS INT) + CAST(a.s3 > o.s3 AS INT)) >= 2)""",
    "p5_method": _P5_METHOD,
    "p6_found": _P6,
}
