"""Adducts and formulas: parsing, mass arithmetic, notation and the universe of possible ions.

Text is parsed once per distinct adduct and joined back; the arithmetic on parsed columns stays in the JVM.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import combinations_with_replacement

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from spectrail.session import bounded, cut

#: Masses of the electron and of an isotope step, in Dalton.
ELECTRON, ISOTOPE_STEP = 0.000548579909065, 1.0033548378
#: Monoisotopic masses of the elements.
ELEMENTS = {
    "H": 1.00782503223, "Li": 7.0160034366, "B": 11.00930536, "C": 12.0, "N": 14.00307400443, "O": 15.99491461957, "F": 18.99840316273,
    "Na": 22.989769282, "Mg": 23.985041697, "Al": 26.98153853, "Si": 27.97692653465, "P": 30.97376199842, "S": 31.9720711744,
    "Cl": 34.968852682, "K": 38.9637064864, "Ca": 39.962590863, "Cr": 51.94050623, "Mn": 54.93804391, "Fe": 55.93493633,
    "Co": 58.93319429, "Ni": 57.93534241, "Cu": 62.92959772, "Zn": 63.92914201, "Se": 79.9165218, "Br": 78.9183376, "Ag": 106.9050916, "I": 126.9044719,
}
#: Formulas behind the names of solvents and acids in adducts.
SOLVENTS = {
    "Acetate": "C2H3O2", "ACN": "C2H3N", "CH3COO": "C2H3O2", "FA": "CHO2", "HAc": "C2H4O2", "Hac": "C2H4O2", "HFA": "CH2O2", "IsoProp": "C3H8O",
    "MeOH": "CH4O", "EtOH": "C2H6O", "DMSO": "C2H6OS", "DMF": "C3H7NO", "MeCN": "C2H3N", "NH4": "H4N", "TFA": "C2HF3O2", "NH3": "H3N",
}
_SOLVENT = re.compile(rf"([+-]\d*)({'|'.join(sorted(SOLVENTS, key=len, reverse=True))})(?=[+\-\]]|$)")
_ADDUCT = re.compile(r"\[(\d*)M(?![a-z])([+-]?\d+(?![A-Z\d]))?((?:[+-]\d*[A-Z][A-Za-z0-9]*)*)\](\d*)([+-])?")
_PART = re.compile(r"([+-])(\d*)([A-Z][A-Za-z0-9]*)")
_ATOM = re.compile(r"([A-Z][a-z]?)(\d*)")
_FORMULA = re.compile(r"(?:[A-Z][a-z]?\d*)+")


@lru_cache(maxsize=100_000)
def atoms(formula: str) -> dict[str, int] | None:
    """Number of atoms by element; None if it is no formula of known elements."""
    if not formula or not _FORMULA.fullmatch(formula):
        return None
    found: Counter = Counter()
    for element, n in _ATOM.findall(formula):
        if element not in ELEMENTS:
            return None
        found[element] += int(n or 1)
    return dict(found)


def formula_mass(formula: str) -> float | None:
    """Monoisotopic mass of a formula."""
    counts = atoms(formula)
    return None if counts is None else sum(ELEMENTS[e] * n for e, n in counts.items())


def hill(counts: dict[str, int]) -> str:
    """Formula in Hill order: carbon, hydrogen, then by name."""
    order = sorted((e for e, n in counts.items() if n > 0), key=lambda e: ({"C": 0, "H": 1}.get(e, 2), e))
    return "".join(e + (str(counts[e]) if counts[e] > 1 else "") for e in order)


def subtract(formula: str, part: str) -> str | None:
    """What is left of a formula without a part; None if the part isn't in it."""
    a, b = atoms(formula), atoms(part)
    if a is None or b is None or any(a.get(e, 0) < n for e, n in b.items()):
        return None
    return hill({e: n - b.get(e, 0) for e, n in a.items()})


def normal_form(adduct: str) -> str:
    """An adduct without comments, blanks and radical marks, its charge before the sign and its solvents as formulas."""
    text = re.sub(r"\s+", "", re.sub(r" \(.*?\)", "", adduct))
    text = re.sub(r"([+-])[*.]+$", r"\1", text)
    text = re.sub(r"\]([+-])(\d+)$", r"]\2\1", text)
    return _SOLVENT.sub(lambda m: m[1] + SOLVENTS[m[2]], text)


@lru_cache(maxsize=100_000)
def parse_adduct(adduct: str | None) -> tuple[int, int, float, int, int] | None:
    """(molecules, isotope shift, mass of the modifications, charges, sign); None if it can't be read. Of alternatives parted by / or | the first readable one counts."""
    if not adduct:
        return None
    for text in re.split(r"[/|]", adduct):
        m = _ADDUCT.fullmatch(normal_form(text.strip()))
        if not m:
            continue
        mass, good = 0.0, True
        for sign, n, formula in _PART.findall(m[3] or ""):
            one = formula_mass(formula)
            good = good and one is not None
            mass += (1 if sign == "+" else -1) * int(n or 1) * (one or 0.0)
        if good:
            return int(m[1] or 1), abs(int(m[2] or 0)), mass, int(m[4] or 1), -1 if m[5] == "-" else 1
    return None


def modifications(adduct: str) -> dict[str, int] | None:
    """Net number of each modification formula of an adduct."""
    m = _ADDUCT.fullmatch(normal_form(adduct))
    if not m:
        return None
    net: Counter = Counter()
    for sign, n, formula in _PART.findall(m[3] or ""):
        net[formula] += (1 if sign == "+" else -1) * int(n or 1)
    return {f: n for f, n in net.items() if n}


def without_ammonium_pairs(net: dict[str, int]) -> dict[str, int]:
    """Ammonium gained with a loss that holds ammonia is a proton with the rest of the loss."""
    net = dict(net)
    while net.get("H4N", 0) > 0:
        for formula in sorted(f for f, n in net.items() if n < 0):
            rest = subtract(formula, "H3N")
            if rest is not None:
                for f, n in ((formula, 1), ("H4N", -1), ("H", 1), *([(rest, -1)] if rest else [])):
                    net[f] = net.get(f, 0) + n
                net = {f: n for f, n in net.items() if n}
                break
        else:
            break
    return net


@lru_cache(maxsize=100_000)
def canonical_adduct(adduct: str | None) -> str | None:
    """One notation for equal ions: losses first, then gains, each by name; text that can't be read stays as it is."""
    if not adduct:
        return adduct
    parsed, text = parse_adduct(adduct), normal_form(re.split(r"[/|]", adduct)[0].strip())
    net = modifications(text)
    if parsed is None or net is None:
        return adduct
    net = without_ammonium_pairs(net)
    n, iso, _, z, sign = parsed
    parts = "".join(f"{'+' if k > 0 else '-'}{abs(k) if abs(k) > 1 else ''}{f}" for f, k in sorted(net.items(), key=lambda x: (x[1] > 0, x[0])))
    return f"[{n if n > 1 else ''}M{f'+{iso}' if iso else ''}{parts}]{z if z > 1 else ''}{'+' if sign > 0 else '-'}"


def state_key(adduct: str | None) -> str | None:
    """Key of an ion state: charges, molecules, isotopes and mass of the modifications; the text itself if it can't be read."""
    if adduct is None:
        return None
    p = parse_adduct(adduct)
    return f"raw:{adduct}" if p is None else f"z:{p[3]}|m:{p[0]}|i:{p[1]}|d:{p[2]:.6f}"


PARSED = StructType([StructField(n, t) for n, t in (("n_mer", IntegerType()), ("n_iso", IntegerType()), ("los_add_clu", DoubleType()), ("n_charges", IntegerType()), ("charge", IntegerType()), ("canonical", StringType()), ("state_key", StringType()))])


@F.pandas_udf(PARSED)
def _parse(column: pd.Series) -> pd.DataFrame:
    rows = [((parse_adduct(x) or (0, 0, 0.0, 0, 0)) + (canonical_adduct(x), state_key(x))) for x in (None if pd.isna(v) else v for v in column)]
    return pd.DataFrame(rows, columns=[f.name for f in PARSED.fields])


def with_parsed_adducts(df: DataFrame, adduct: str) -> DataFrame:
    """Adds the parsed columns of each adduct (all 0 if it can't be read): distinct texts are parsed and joined back. A null adduct has nulls."""
    distinct = df.select(F.col(adduct).alias("__a")).where("__a IS NOT NULL").distinct()
    parsed = cut(distinct.withColumn("__p", _parse("__a")).select("__a", "__p.*"))
    return df.join(bounded(parsed), df[adduct] == F.col("__a"), "left").drop("__a")


def neutral_mass(mz: Column) -> Column:
    """Mass of the molecule behind an ion, from its m/z and the parsed columns; null if the adduct can't be read."""
    z = F.col("n_charges") * F.col("charge")
    mass = (F.col("n_charges") * (mz - F.col("n_iso") * ISOTOPE_STEP) - F.col("los_add_clu") + z * ELECTRON) / F.col("n_mer")
    return F.when(F.col("n_mer") > 0, mass)


def ion_mz(mass: Column) -> Column:
    """m/z of an ion, from the mass of its molecule and the parsed columns; the inverse of neutral_mass."""
    z = F.col("n_charges") * F.col("charge")
    return F.when(F.col("n_mer") > 0, (F.col("n_mer") * mass + F.col("los_add_clu") - z * ELECTRON) / F.col("n_charges") + F.col("n_iso") * ISOTOPE_STEP)


@F.pandas_udf(DoubleType())
def mass_of_formula(column: pd.Series) -> pd.Series:
    """Monoisotopic mass of each formula; null if it can't be read."""
    return column.map(lambda f: None if pd.isna(f) else formula_mass(f)).astype("float64")


def loss_is_possible(adduct: str, formula: str | None) -> bool:
    """Whether a formula holds the atoms that an adduct's losses take (times the molecules in it); an unknown formula may."""
    net, have = modifications(adduct), atoms(formula or "")
    parsed = parse_adduct(adduct)
    if net is None or have is None or parsed is None:
        return True
    need: Counter = Counter()
    for f, n in net.items():
        if n < 0 and f != "H":
            for e, k in (atoms(f) or {}).items():
                need[e] += -n * k
    return all(have.get(e, 0) * parsed[0] >= n for e, n in need.items())


def possible_losses(df: DataFrame, adduct: str, formula: str) -> DataFrame:
    """Rows whose formula can give up what the adduct loses; distinct pairs are checked once."""
    pairs = df.select(F.col(adduct).alias("__a"), F.col(formula).alias("__f")).distinct().where("__a IS NOT NULL AND __f IS NOT NULL")

    @F.pandas_udf(IntegerType())
    def ok(a: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series([int(loss_is_possible(x, y)) for x, y in zip(a, f, strict=True)], dtype="int32")

    bad = pairs.withColumn("__ok", ok("__a", "__f")).where("__ok = 0").select("__a", "__f")
    return df.join(bad, (df[adduct] == bad["__a"]) & (df[formula] == bad["__f"]), "left_anti")


def universe_rows(carriers: dict[str, int], charges: list[int], molecules: list[int], clusters: list[str], losses: list[str], most_clusters: int = 1, most_losses: int = 1) -> list[tuple]:
    """All ions of integer compositions: (adduct, n_mer, z, adduct_mass, tier).

    carriers: formula with the charge it brings (a negative mode's proton is H with -1). tier counts what goes beyond one
    plain molecule with one carrier. Ions that come out twice are kept once.
    """
    rows: dict[str, tuple] = {}
    names = sorted(carriers)
    for z in charges:
        for size in range(1, abs(z) + 1):
            for combo in combinations_with_replacement(names, size):
                if sum(carriers[c] for c in combo) != z:
                    continue
                for n in molecules:
                    for c in range(most_clusters + 1):
                        for cluster in combinations_with_replacement(clusters, c):
                            for k in range(most_losses + 1):
                                for loss in combinations_with_replacement(losses, k):
                                    net: Counter = Counter(cluster)
                                    net.subtract(Counter(loss))
                                    for carrier in combo:
                                        net[carrier] += -1 if z < 0 and carrier == "H" else 1
                                    net = Counter({f: v for f, v in net.items() if v})
                                    text = "".join(f"{'+' if v > 0 else '-'}{abs(v) if abs(v) > 1 else ''}{f}" for f, v in sorted(net.items(), key=lambda x: (x[1] > 0, x[0])))
                                    adduct = f"[{n if n > 1 else ''}M{text}]{abs(z) if abs(z) > 1 else ''}{'+' if z > 0 else '-'}"
                                    mass = sum(formula_mass(f) * v for f, v in net.items())
                                    tier = (n > 1) + (len(set(combo)) > 1) + bool(c) + bool(k)
                                    rows.setdefault(adduct, (adduct, n, z, mass, int(tier)))
    return list(rows.values())


def adduct_universe(spark: SparkSession, carriers: dict[str, int], charges: list[int], molecules: list[int], clusters: list[str], losses: list[str], most_clusters: int = 1, most_losses: int = 1) -> DataFrame:
    """universe_rows as a table; its size hangs on the parameters alone."""
    rows = universe_rows(carriers, charges, molecules, clusters, losses, most_clusters, most_losses)
    return spark.createDataFrame(rows, "adduct string, n_mer int, z int, adduct_mass double, tier int")


def adduct_differences(adducts: DataFrame, least: float) -> DataFrame:
    """(distance, group1, group2) of each two adducts with at least that difference of mass; adducts: adduct, adduct_mass, a small table."""
    a = adducts.select(F.col("adduct").alias("group1"), F.col("adduct_mass").alias("m1")).distinct()
    b = adducts.select(F.col("adduct").alias("group2"), F.col("adduct_mass").alias("m2")).distinct()
    pairs = a.join(F.broadcast(b), (F.col("m1") < F.col("m2")) & (F.col("group1") != F.col("group2")))
    return pairs.select((F.col("m2") - F.col("m1")).alias("distance"), "group1", "group2").where(F.col("distance") >= least).distinct()
