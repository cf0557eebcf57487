"""SQL of the annotation by mass over the test tables: every step as a common table expression."""

from __future__ import annotations

from spectrail.operators.adducts import ELECTRON, universe_rows
from spectrail.operators.masses import SOURCES

#: Masses of molecules that ions gather or lose.
CLUSTERS = [(17.026549, "H3N"), (32.026215, "CH4O")]
LOSSES = [(18.010565, "H2O"), (43.989829, "CO2")]
UNIVERSE = ({"H": 1, "Na": 1, "K": 1}, [1], [1, 2], [], ["H2O"])
PPM, DALTON, RT, BASELINE = 150.0, 0.03, 1_440.0, ("[M+H]+", "[M+Na]+")


def _d(x: float) -> str:
    return f"{x!r}::DOUBLE"


def rows_of(rows: list[tuple]) -> str:
    """Rows as SQL values."""
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else _d(v) if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)


def near(a: str, b: str) -> str:
    """Whether a mass agrees with a median within ppm or Dalton."""
    return f"(abs({a} - {b}) <= {_d(DALTON)} OR abs({a} - {b}) * 1e6 / {b} <= {_d(PPM)})"


def evidence(features: str, ppm: float, dalton: float, gap: float, prefix: str = "") -> str:
    """The evidence engine over features(f, s, rt, mz), un(x, n, z, am, tier) and lib(em)."""
    return f"""{prefix}i AS (SELECT f, s, rt, mz, x, tier, (abs(z) * mz - am + z * {_d(ELECTRON)}) / n AS mass FROM {features}, un),
{prefix}j AS (SELECT i.*, em FROM {prefix}i i JOIN lib ON i.mass > 0 AND i.mass BETWEEN em - greatest(em * {_d(ppm * 1e-6)}, {_d(dalton)}) AND em + greatest(em * {_d(ppm * 1e-6)}, {_d(dalton)}) QUALIFY row_number() OVER (PARTITION BY f, s, x ORDER BY abs(mass - em), em) = 1),
{prefix}k AS (SELECT *, CASE WHEN rt - lag(rt) OVER (PARTITION BY s, em ORDER BY rt, f, x) <= {_d(gap)} THEN 0 ELSE 1 END AS new FROM {prefix}j),
{prefix}l AS (SELECT *, sum(new) OVER (PARTITION BY s, em ORDER BY rt, f, x ROWS UNBOUNDED PRECEDING) AS cl FROM {prefix}k),
{prefix}m AS (SELECT s, em, cl, count(DISTINCT x) AS peers FROM {prefix}l GROUP BY 1, 2, 3),
{prefix}ev AS (SELECT l.*, peers FROM {prefix}l l JOIN {prefix}m USING (s, em, cl) WHERE tier = 0 OR peers >= 2)"""


_ROUNDS = ", ".join(
    f"""d{k} AS MATERIALIZED (SELECT f, quantile_cont(mass, 0.5) AS v FROM (SELECT f, mass FROM e{k - 1} UNION ALL SELECT g, mass FROM e{k - 1}) GROUP BY f),
e{k} AS MATERIALIZED (SELECT e.* FROM e{k - 1} e JOIN d{k} p ON e.f = p.f JOIN d{k} q ON e.g = q.f WHERE {near("mass", "p.v")} AND {near("mass", "q.v")})"""
    for k in range(1, 11)
)
_ORDER = "list_position([" + ", ".join(f"'{x}'" for x in SOURCES) + "], source)"
_FIRST = f"QUALIFY row_number() OVER (PARTITION BY f, x ORDER BY {_ORDER}, mass NULLS LAST) = 1"


def atoms(element: str) -> str:
    """Number of atoms of C, H or O in a formula."""
    plain = "replace(formula, 'Cl', 'X')" if element == "C" else "formula"
    return f"CASE WHEN regexp_matches({plain}, '{element}(\\d*)') THEN coalesce(try_cast(nullif(regexp_extract({plain}, '{element}(\\d*)', 1), '') AS INT), 1) ELSE 0 END"


def _lost(text: str) -> str:
    return f"(length(x) - length(replace(x, '-{text}', ''))) / {len(text) + 1}"


_SQL = f"""WITH RECURSIVE ft AS (SELECT CAST(event_id AS VARCHAR) AS f, user_id AS s, epoch_us(ts) / 60000000 AS rt, value + 150 AS mz FROM events),
un(x, n, z, am, tier) AS (VALUES {rows_of(universe_rows(*UNIVERSE))}), lib AS (SELECT DISTINCT structure_exact_mass AS em FROM structures_metadata WHERE structure_inchikey_no_stereo IS NOT NULL AND structure_exact_mass > 0),
pa AS MATERIALIZED (SELECT a.f, b.f AS g, b.mz - a.mz AS d, (a.mz + b.mz) / 2 * {_d(PPM * 1e-6)} AS w FROM ft a JOIN ft b ON a.s = b.s AND b.rt BETWEEN a.rt - {_d(RT)} AND a.rt + {_d(RT)} AND a.f <> b.f AND b.mz >= a.mz),
df AS (SELECT DISTINCT b.am - a.am AS dist, a.x AS x1, b.x AS x2 FROM un a JOIN un b ON a.am < b.am AND a.x <> b.x WHERE a.n = 1 AND b.n = 1 AND b.am - a.am >= {_d(PPM * 1e-6 * 2_000)}),
r0 AS MATERIALIZED (SELECT DISTINCT f, x1 AS x, x2 AS y, g FROM pa JOIN df ON dist BETWEEN d - w AND d + w),
sp0 AS (SELECT f, x, count(*) AS n FROM (SELECT f, x, g FROM r0 UNION SELECT g, y, f FROM r0) GROUP BY 1, 2), dg AS (SELECT f, count(*) AS n FROM (SELECT f, g FROM r0 UNION SELECT g, f FROM r0) GROUP BY 1), hp AS (SELECT f, g, count(*) AS n FROM r0 GROUP BY 1, 2),
e0 AS MATERIALIZED (SELECT DISTINCT r0.f, r0.x, r0.y, r0.g, (ft.mz - un.am + un.z * {_d(ELECTRON)}) / un.n AS mass FROM r0 JOIN hp USING (f, g) JOIN sp0 a ON a.f = r0.f AND a.x = r0.x JOIN sp0 b ON b.f = r0.g AND b.x = r0.y JOIN dg p ON p.f = r0.f JOIN dg q ON q.f = r0.g JOIN ft ON ft.f = r0.f JOIN un ON un.x = r0.x
  WHERE NOT (hp.n > 1 OR p.n >= 3 OR q.n >= 3) OR a.n >= 2 OR b.n >= 2),
{_ROUNDS},
cl(dist, label) AS (VALUES {rows_of(CLUSTERS)}), ls(dist, label) AS (VALUES {rows_of(LOSSES)}),
mo AS (SELECT DISTINCT f, g, label, 'cluster' AS kind FROM pa JOIN cl ON dist BETWEEN d - w AND d + w UNION ALL SELECT DISTINCT f, g, label, 'loss' FROM pa JOIN ls ON dist BETWEEN d - w AND d + w),
sc AS (SELECT f, label, count(*) AS n FROM mo GROUP BY 1, 2), md AS MATERIALIZED (SELECT f, g, label, kind FROM mo JOIN sc USING (f, label) QUALIFY row_number() OVER (PARTITION BY f, g ORDER BY n DESC, kind DESC, label) = 1),
{evidence("ft", PPM, DALTON, RT)},
bs AS MATERIALIZED (SELECT f, x, mass, 'pair' AS source FROM e10 UNION ALL SELECT g, y, mass, 'pair' FROM e10 UNION ALL SELECT f, x, mass, 'evidence' FROM ev),
kn AS MATERIALIZED (SELECT f, x, mass FROM bs {_FIRST}),
al AS (SELECT * FROM bs UNION ALL SELECT f, x, (abs(z) * mz - am + z * {_d(ELECTRON)}) / n, 'baseline' FROM ft, un WHERE x IN {BASELINE}
  UNION ALL SELECT md.g, regexp_extract(x, '^(\\[\\d*M)', 1) || '+' || label || regexp_replace(x, '^\\[\\d*M', ''), mass, 'cluster' FROM md JOIN kn ON kn.f = md.f WHERE kind = 'cluster'
  UNION ALL SELECT md.f, regexp_extract(x, '^(\\[\\d*M)', 1) || '-' || label || regexp_replace(x, '^\\[\\d*M', ''), mass, 'loss' FROM md JOIN kn ON kn.f = md.g WHERE kind = 'loss'),
hy AS MATERIALIZED (SELECT * FROM al {_FIRST}),
sp AS (SELECT f, x, count(*) AS n FROM (SELECT f, x, g FROM e10 UNION SELECT g, y, f FROM e10) GROUP BY 1, 2), hs AS (SELECT hy.*, coalesce(n, 0) AS n FROM hy LEFT JOIN sp USING (f, x)), pn AS (SELECT *, max(n) OVER (PARTITION BY f) AS top FROM hs),
mt AS (SELECT f, x, mass, source, n, em, em - mass AS err FROM pn JOIN lib ON abs(em - mass) <= {_d(DALTON)} AND abs(em - mass) * 1e6 / greatest(em, mass) <= {_d(PPM)} WHERE top = 0 OR n > 0),
nm AS (SELECT f, x FROM e10 UNION SELECT g, y FROM e10),
ag AS (SELECT mt.* FROM mt WHERE source IN ('preassigned', 'evidence', 'cluster', 'loss') OR EXISTS (SELECT 1 FROM nm WHERE nm.f = mt.f AND nm.x = mt.x) OR NOT EXISTS (SELECT 1 FROM nm WHERE nm.f = mt.f)),
st AS (SELECT DISTINCT structure_inchikey_no_stereo AS t, structure_exact_mass AS em, structure_molecular_formula AS formula FROM structures_metadata WHERE structure_inchikey_no_stereo IS NOT NULL),
an AS MATERIALIZED (SELECT DISTINCT f, x, t, source, n, em, err, formula FROM ag JOIN st USING (em) WHERE formula IS NULL OR (CASE WHEN x LIKE '[2M%' THEN 2 ELSE 1 END * ({atoms("O")}) >= {_lost("H2O")} + 2 * {_lost("CO2")}
  AND CASE WHEN x LIKE '[2M%' THEN 2 ELSE 1 END * ({atoms("H")}) >= 2 * {_lost("H2O")} AND CASE WHEN x LIKE '[2M%' THEN 2 ELSE 1 END * ({atoms("C")}) >= {_lost("CO2")})),
ds AS (SELECT f AS a, g AS b FROM e10 UNION SELECT g, f FROM e10), reach AS (SELECT a AS f, a AS g FROM ds UNION SELECT ds.b, r.g FROM reach r JOIN ds ON ds.a = r.f WHERE r.g < ds.b), cp AS (SELECT f, min(g) AS c FROM reach GROUP BY 1),
pg AS (SELECT DISTINCT o.f, k.t FROM kn o JOIN cp oc ON oc.f = o.f JOIN cp kc ON kc.c = oc.c JOIN an k ON k.f = kc.f WHERE o.f NOT IN (SELECT f FROM an) AND abs(o.mass - k.em) <= greatest(greatest(o.mass, k.em) * {_d(PPM * 1e-6)}, {_d(DALTON)}))
SELECT f AS feature_id, x AS adduct, t AS structure, source, n AS adduct_support, em AS exact_mass, round(err, 7) AS error_mz FROM an UNION ALL SELECT f, NULL, t, 'propagated', NULL, NULL, NULL FROM pg"""

SQL = {"mass_annotations": _SQL}
