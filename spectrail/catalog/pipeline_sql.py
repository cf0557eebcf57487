"""SQL of the scoring pipeline over the test tables: every step as a common table expression."""

from __future__ import annotations

from spectrail.catalog.library import _CLOSEST, _PAIRS, _SCORE
from spectrail.operators.scoring import ANCHOR_NOTE, LAYER, PROMOTED_NOTE
from spectrail.operators.taxonomy import BIO_RANKS

#: Class levels that the test queries use, with their weights.
LEVELS = {"cla_02sup": 0.428571, "cla_03cla": 0.714286, "npc_01pat": 0.285714, "npc_03cla": 0.857143}


def _d(x: float) -> str:
    return f"{x!r}::DOUBLE"


def _weighted(values: list[str], weights: list[float]) -> str:
    return "(" + " + ".join(f"coalesce({v}, 0::DOUBLE) * {_d(w)}" for v, w in zip(values, weights, strict=True)) + f") / {_d(sum(weights))}"


def _labels(system: str) -> str:
    """Columns own_, said_ and top_ of a class system."""
    deep = sorted((x for x in LEVELS if x.startswith(system)), reverse=True)
    own = ", ".join(f"CASE WHEN trim({x}) NOT IN ('', 'notClassified', 'empty', 'N/A', 'null') THEN trim({x}) END" for x in deep)
    said = {x: f"CASE WHEN p_{x} <> 'notClassified' THEN q_{x} * {_d(LEVELS[x])} END" for x in deep}
    top = f"greatest({', '.join(said.values())})"
    label = f"coalesce({', '.join(f'CASE WHEN {w} = {top} THEN p_{x} END' for x, w in said.items())})"
    return f"coalesce({own}) AS own_{system}, {label} AS said_{system}, {top} AS top_{system}"


def _best_label(system: str) -> str:
    return f"""o_{system} AS (SELECT f, own_{system} AS l, fin AS s FROM lb WHERE own_{system} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY f ORDER BY fin DESC NULLS LAST, own_{system}) = 1),
p_{system} AS (SELECT f, said_{system} AS l, top_{system} AS s FROM lb WHERE said_{system} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY f ORDER BY top_{system} DESC, said_{system}) = 1)"""


_SIM, _CONF = "CASE WHEN NOT isnan(candidate_score_similarity) THEN candidate_score_similarity END", "CASE WHEN NOT isnan(score_weighted_chemo) THEN score_weighted_chemo END"
_RANKED = f"""WITH RECURSIVE c0 AS (SELECT candidate_id, feature_id AS f, {LAYER} AS l, candidate_adduct AS ad, {_SIM} AS sim, {_CONF} AS cf,
  CASE WHEN NOT isnan(candidate_structure_error_mz) THEN round_even(candidate_structure_error_mz, 1) + 400 END AS nm FROM clean_chemo WHERE feature_id IS NOT NULL AND {LAYER} IS NOT NULL),
sp AS (SELECT candidate_id, f, l, ad, sim, nm FROM c0 QUALIFY row_number() OVER (PARTITION BY f, l ORDER BY sim DESC NULLS LAST, candidate_id) = 1),
fp AS (SELECT f, l, max(cf) AS conf FROM c0 GROUP BY 1, 2),
kn AS (SELECT structure_inchikey_connectivity_layer AS l, {", ".join(f"min(structure_tax_{x}) AS {x}" for x in LEVELS)}, min(structure_exact_mass) AS em FROM structure_organism_pairs WHERE structure_inchikey_connectivity_layer IS NOT NULL GROUP BY 1),
sm AS (SELECT feature_id AS f, min(sample_organism_name) AS n FROM weight_bio WHERE feature_id IS NOT NULL GROUP BY 1),
r AS (SELECT * FROM sp JOIN fp USING (f, l) LEFT JOIN sm USING (f) LEFT JOIN kn USING (l)),
{_PAIRS}, w AS (SELECT DISTINCT l AS s, n FROM r WHERE n IS NOT NULL),
bm AS (SELECT p.s AS st, n, o, {_SCORE} AS score FROM p JOIN w USING (s) JOIN organism_reference c ON c.organism_name = o JOIN organism_reference s ON s.organism_name = n),
bk AS (SELECT m.*, {_CLOSEST} AS closest FROM bm m JOIN organism_reference c ON c.organism_name = m.o),
bio AS (SELECT st AS l, n, (max((score, closest)))[1] AS bio, (max((score, closest)))[2] AS closest FROM bk WHERE closest IS NOT NULL GROUP BY 1, 2),
b0 AS (SELECT r.*, bio, closest, coalesce((sim + conf) / 2, sim, conf) AS ini FROM r LEFT JOIN bio USING (l, n)),
b AS MATERIALIZED (SELECT *, {_weighted(["bio", "ini"], [0.4, 0.3])} AS swb FROM b0),
hy AS (SELECT feature_id AS s, feature_id_dest AS t, delta FROM annotate_masses_hypothesis WHERE feature_id IS NOT NULL AND feature_id_dest IS NOT NULL),
e0 AS (SELECT s, t, delta FROM hy QUALIFY row_number() OVER (PARTITION BY s ORDER BY 1 / (1 + delta) DESC NULLS LAST, t) <= 16),
e1 AS (SELECT DISTINCT s, t FROM e0 WHERE s <> t AND delta > 0), e2 AS MATERIALIZED (SELECT * FROM e1 WHERE s IN (SELECT s FROM e1 GROUP BY s HAVING count(*) >= 2)),
lg AS ({" UNION ALL ".join(f"SELECT f, swb, '{x}' AS level, {x} AS val FROM b WHERE {x} IS NOT NULL" for x in LEVELS)}),
own AS MATERIALIZED (SELECT f, level, val, max(swb) AS s FROM lg GROUP BY 1, 2, 3),
tot AS (SELECT s, count(DISTINCT t) AS n FROM e2 WHERE t IN (SELECT f FROM b) GROUP BY 1),
cnt AS (SELECT e2.s, level, val, count(*) AS n FROM e2 JOIN own ON own.f = e2.t GROUP BY 1, 2, 3),
vt AS (SELECT cnt.s, cnt.level, cnt.val, cnt.n / tot.n AS cons, cnt.n / tot.n * o.s AS score FROM cnt JOIN tot ON cnt.s = tot.s LEFT JOIN own o ON o.f = cnt.s AND o.level = cnt.level AND o.val = cnt.val),
win AS (SELECT s, level, CASE WHEN score IS NOT NULL THEN CASE WHEN score >= 0 THEN val ELSE 'notConsistent' END END AS val, score FROM vt QUALIFY row_number() OVER (PARTITION BY s, level ORDER BY score DESC NULLS LAST, val) = 1),
pr AS (SELECT s AS f, {", ".join(f"max(val) FILTER (level = '{x}') AS p_{x}, max(score) FILTER (level = '{x}') AS q_{x}" for x in LEVELS)} FROM win GROUP BY 1),
ch AS (SELECT b.*, {", ".join(f"p_{x}, q_{x}" for x in LEVELS)}, greatest({", ".join(f"CASE WHEN {x} <> 'notClassified' AND contains(p_{x}, {x}) THEN {_d(v)} END" for x, v in LEVELS.items())}, 0::DOUBLE) AS chem FROM b LEFT JOIN pr USING (f)),
fn AS (SELECT *, {_weighted(["bio", "chem", "ini"], [0.4, 0.2, 0.3])} AS fin FROM ch WHERE sim IS NOT NULL OR bio >= 0 OR chem >= 0),
rk AS (SELECT *, rank() OVER (PARTITION BY f ORDER BY greatest(fin, 0) DESC) AS rk FROM fn),
vx AS (SELECT s AS v FROM hy UNION SELECT t FROM hy), ds AS (SELECT s AS a, t AS b FROM hy WHERE s <> t UNION SELECT t, s FROM hy WHERE s <> t),
reach AS (SELECT v AS f, v AS g FROM vx UNION SELECT ds.b, x.g FROM reach x JOIN ds ON ds.a = x.f WHERE x.g < ds.b), cp AS (SELECT f, min(g) AS c FROM reach GROUP BY 1),
g AS MATERIALIZED (SELECT rk.*, cp.c, round_even(coalesce(em, nm), 4) AS m, sim IS NOT NULL OR coalesce(conf, 0) > 0 AS ms2 FROM rk LEFT JOIN cp USING (f)),
an AS (SELECT c, m, f AS af, l AS al FROM g WHERE rk = 1 AND c IS NOT NULL AND m IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c, m ORDER BY NOT ms2, -fin, f, l) = 1),
h1 AS (SELECT g.*, af, al, coalesce(l = al, false) AS isa FROM g LEFT JOIN an ON g.c = an.c AND g.m = an.m), h2 AS (SELECT *, bool_or(isa) OVER (PARTITION BY f, c, m) AS ing FROM h1),
h3 AS (SELECT *, ing AND coalesce(bool_or(ing AND rk = 1 AND NOT ms2 AND NOT isa) OVER (PARTITION BY f), false) AS turn FROM h2),
h4 AS (SELECT * EXCLUDE (rk), CASE WHEN turn THEN row_number() OVER (PARTITION BY f, c, m ORDER BY isa DESC, rk, l) ELSE rk END AS fr FROM h3), h5 AS (SELECT *, coalesce(isa AND fr = 1 AND f <> af, false) AS promoted FROM h4),
t1 AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY f, ad, fr) AS sz FROM h5),
ht AS (SELECT DISTINCT t.f, t.l FROM t1 t JOIN t1 a ON a.l = t.l WHERE t.sz > 1 AND a.sz = 1 AND a.fr = 1 AND a.f <> t.f AND t.nm BETWEEN a.nm - 0.005::DOUBLE AND a.nm + 0.005::DOUBLE),
t2 AS (SELECT t1.*, ht.f IS NOT NULL AS hit FROM t1 LEFT JOIN ht ON ht.f = t1.f AND ht.l = t1.l), t3 AS (SELECT *, bool_or(hit) OVER (PARTITION BY f, ad, fr) AS anyhit FROM t2),
t4 AS (SELECT *, count(*) OVER (PARTITION BY f, ad, fr) AS size, row_number() OVER (PARTITION BY f, ad, fr ORDER BY sim DESC NULLS LAST, conf DESC NULLS LAST, promoted DESC, fin DESC NULLS LAST, ini DESC NULLS LAST, candidate_id) AS i FROM t3 WHERE NOT anyhit OR hit),
fu AS MATERIALIZED (SELECT *, coalesce(CASE WHEN hit THEN '{ANCHOR_NOTE}' WHEN promoted THEN '{PROMOTED_NOTE}' END, CASE WHEN size > 7 THEN 'Sampled 7 of ' || size || ' tied candidates' END) AS note, count(*) OVER (PARTITION BY f) AS held FROM t4 WHERE i <= 7),
lk AS (SELECT DISTINCT organism_name, taxon FROM (UNPIVOT organism_reference ON {", ".join(f'"organism_taxonomy_{x}"' for x in BIO_RANKS)} INTO NAME rank VALUE taxon)),
rf AS (SELECT w.l, w.closest, string_agg(DISTINCT reference_doi, ' $ ' ORDER BY reference_doi) AS reference FROM (SELECT DISTINCT l, closest FROM fu WHERE closest IS NOT NULL) w
  JOIN structure_organism_pairs o ON o.structure_inchikey_connectivity_layer = w.l JOIN lk ON lk.organism_name = o.organism_name AND lk.taxon = w.closest WHERE reference_doi IS NOT NULL GROUP BY 1, 2),
fi AS (SELECT * FROM fu WHERE (bio >= 0.8 OR ini >= 0.9 OR fin >= 0.75) AND ((conf IS NULL AND sim IS NULL) OR conf >= 0.4 OR sim >= 0.4) QUALIFY row_number() OVER (PARTITION BY f ORDER BY fr, candidate_id) = 1)"""
_OUT = f"SELECT candidate_id, f AS feature_id, x.l AS {LAYER}, bio AS score_biological, chem AS score_chemical, round(fin, 9) AS score, fr AS rank_final, promoted, note AS annotation_note, c AS component_id, held AS candidates_evaluated, held AS candidates_best, x.closest, reference"
SQL = {
    "weighted_full": f"{_RANKED} {_OUT} FROM fu x LEFT JOIN rf ON rf.l = x.l AND rf.closest = x.closest",
    "weighted_filtered": f"{_RANKED} {_OUT} FROM fi x LEFT JOIN rf ON rf.l = x.l AND rf.closest = x.closest",
    "weighted_mini": f"""{_RANKED}, lb AS (SELECT *, {_labels("cla")}, {_labels("npc")} FROM fu), {_best_label("cla")}, {_best_label("npc")}, u AS (SELECT f, max(held) AS held FROM fu GROUP BY 1)
SELECT u.f AS feature_id, candidate_id, ad AS candidate_adduct, true AS has_inchikey, CASE WHEN coalesce(oc.s >= pc.s, pc.f IS NULL) THEN oc.l ELSE pc.l END AS label_classyfire, round(CASE WHEN NOT coalesce(oc.s >= pc.s, pc.f IS NULL) THEN pc.s END, 6) AS score_classyfire,
  CASE WHEN coalesce(o.s >= p.s, p.f IS NULL) THEN o.l ELSE p.l END AS label_npclassifier, round(CASE WHEN NOT coalesce(o.s >= p.s, p.f IS NULL) THEN p.s END, 6) AS score_npclassifier, u.held AS candidates_evaluated
FROM u LEFT JOIN fi ON fi.f = u.f LEFT JOIN o_cla oc ON oc.f = u.f LEFT JOIN p_cla pc ON pc.f = u.f LEFT JOIN o_npc o ON o.f = u.f LEFT JOIN p_npc p ON p.f = u.f""",
}
