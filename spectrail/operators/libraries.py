"""Structure-organism libraries: splitting, merging, enrichment and cross references."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from spectrail.functions.scalars import NOT_CLASSIFIED, chemont_id, collapse_names, collapse_sorted, no_stereo_key
from spectrail.operators.keys import first_row, null_safe_join, union_all
from spectrail.session import bounded, cut

ORGANISM_RANKS = ["01domain", "02kingdom", "03phylum", "04class", "05order", "06family", "07tribe", "08genus", "09species", "10varietas"]


def pair_keys(sop: DataFrame) -> DataFrame:
    """Distinct (structure_inchikey, organism_name, reference_doi); a null reference is dropped if the pair has another row."""
    keys = sop.select("structure_inchikey", "organism_name", "reference_doi").distinct()
    n = F.count("*").over(Window.partitionBy("structure_inchikey", "organism_name"))
    return keys.withColumn("__n", n).where(F.col("reference_doi").isNotNull() | (F.col("__n") == 1)).drop("__n")


def organism_taxonomy(sop: DataFrame) -> DataFrame:
    """One row per organism: the first of each rank by order, notClassified where there is none."""
    ranks = [f"organism_taxonomy_{r}" for r in ORGANISM_RANKS]
    first = [F.coalesce(F.min(c), F.lit(NOT_CLASSIFIED)).alias(c) for c in ranks]
    return sop.where("organism_name IS NOT NULL").groupBy("organism_name").agg(F.min("organism_taxonomy_ottid").alias("organism_taxonomy_ottid"), *first)


def structure_stereo(sop: DataFrame) -> DataFrame:
    """One row per InChIKey: smallest SMILES and logP, names distinct without regard to case, tags distinct."""
    return sop.where("structure_inchikey IS NOT NULL").groupBy("structure_inchikey").agg(
        F.min("structure_smiles").alias("structure_smiles"),
        F.min("structure_xlogp").alias("structure_xlogp"),
        collapse_names(F.col("structure_name")).alias("structure_name"),
        collapse_sorted(F.col("structure_tag")).alias("structure_tag"),
    )


def structure_metadata(sop: DataFrame) -> DataFrame:
    """One row per key without stereo layer: formula and exact mass of the first row by mass and formula."""
    keyed = sop.where("structure_inchikey IS NOT NULL").select(no_stereo_key(F.col("structure_inchikey")).alias("structure_inchikey_no_stereo"), "structure_molecular_formula", "structure_exact_mass")
    return first_row(keyed, ["structure_inchikey_no_stereo"], [F.col("structure_exact_mass").asc_nulls_last(), F.col("structure_molecular_formula").asc_nulls_last()])


def structure_classes(sop: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key: distinct classes of each column, joined; notClassified where there is none."""
    return sop.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.coalesce(collapse_sorted(F.col(c)), F.lit(NOT_CLASSIFIED)).alias(c) for c in columns])


def split_pairs(sop: DataFrame) -> dict[str, DataFrame]:
    """The normalised tables of a structure-organism library."""
    cla = ["structure_tax_cla_01kin", "structure_tax_cla_02sup", "structure_tax_cla_03cla", "structure_tax_cla_04dirpar"]
    npc = ["structure_tax_npc_01pat", "structure_tax_npc_02sup", "structure_tax_npc_03cla"]
    ids = sop.withColumn("structure_tax_cla_chemontid", chemont_id(F.col("structure_tax_cla_chemontid")))
    return {
        "key": pair_keys(sop),
        "org_tax_ott": organism_taxonomy(sop),
        "str_stereo": structure_stereo(sop),
        "str_met": structure_metadata(sop),
        "str_tax_npc": structure_classes(sop, "structure_smiles", npc),
        "str_tax_cla": structure_classes(ids, "structure_inchikey", ["structure_tax_cla_chemontid", *cla]),
    }


def merge_libraries(libraries: list[DataFrame]) -> DataFrame:
    """Union of libraries by column name, without repeated rows."""
    return union_all(*libraries).distinct()


def assemble_library(pairs: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """Pairs with each table's new columns, joined on the columns both have (null matches null); each table has one row per key."""
    for t in tables:
        on = [c for c in pairs.columns if c in t.columns]
        pairs = null_safe_join(pairs, t, on)
    return pairs


def taxonomic_filter(pairs: DataFrame, organisms: DataFrame, level: str, pattern: str, must_match: bool = False) -> DataFrame:
    """Pairs of organisms whose name at the level matches the pattern. must_match: no organism at all is an error."""
    kept = cut(organisms.where(F.col(level).rlike(pattern)).select("organism_name").distinct())
    if must_match and kept.isEmpty():
        raise ValueError(f"no organism has a {level} that matches {pattern}")
    return pairs.join(bounded(kept), "organism_name", "left_semi")


def completed_organisms(organisms: DataFrame, known: DataFrame) -> DataFrame:
    """Organisms with the ranks that they lack (null or not classified) taken from known ones of the same name; those that only `known` has stay out."""
    ranks = [c for c in organisms.columns if c != "organism_name" and c in known.columns]
    one = first_row(known.select("organism_name", *ranks), ["organism_name"], [F.col(c).asc_nulls_last() for c in ranks]).withColumnsRenamed({c: f"__{c}" for c in ranks})
    joined = organisms.join(one, "organism_name", "left")
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit(NOT_CLASSIFIED)), F.nullif(F.col(f"__{c}"), F.lit(NOT_CLASSIFIED)), F.col(c)) for c in ranks}
    return joined.withColumns(filled).drop(*[f"__{c}" for c in ranks])


def prepared_library(libraries: list[DataFrame], organisms: DataFrame | None = None, classes: list[tuple[str, DataFrame]] | None = None, level: str | None = None, pattern: str | None = None) -> dict[str, DataFrame]:
    """Libraries as one: united, split into normalised tables, organisms completed and classes filled from caches, reduced to a taxon.

    organisms: known organisms with organism_taxonomy_<rank>; classes: lookups (key, table with one row per key) for the
    class tables; level, pattern: a rank column and what its names must match, an error if none does.
    """
    tables = split_pairs(merge_libraries(libraries))
    if organisms is not None:
        tables["org_tax_ott"] = completed_organisms(tables["org_tax_ott"], organisms)
    for name in ("str_tax_npc", "str_tax_cla"):
        for key, lookup in classes or []:
            if key in tables[name].columns:
                columns = [c for c in tables[name].columns if c != key and c in lookup.columns]
                blank = tables[name].withColumns({c: F.nullif(F.col(c), F.lit(NOT_CLASSIFIED)) for c in columns})
                tables[name] = enrich_structures(blank, [(key, lookup)], columns).fillna(NOT_CLASSIFIED, columns)
    if level is not None:
        tables["key"] = taxonomic_filter(tables["key"], tables["org_tax_ott"], level, pattern or "", must_match=True)
    return tables


#: Columns of library files by those of the common model.
LIBRARY_COLUMNS = {
    "lotus": {"structure_inchikey": "structure_inchikey", "structure_smiles": "structure_smiles", "structure_name": "structure_nameTraditional", "organism_name": "organism_name", "reference_doi": "reference_doi", "structure_exact_mass": "structure_exact_mass", "structure_xlogp": "structure_xlogp", "structure_molecular_formula": "structure_molecular_formula"},
    "ecmdb": {"structure_inchikey": "moldb_inchikey", "structure_smiles": "moldb_smiles", "structure_name": "name", "structure_molecular_formula": "moldb_formula", "structure_exact_mass": "moldb_mono_mass", "structure_xlogp": "moldb_logp"},
    "pubchemlite": {"structure_inchikey": "InChIKey", "structure_smiles": "SMILES", "structure_name": "CompoundName", "structure_molecular_formula": "MolecularFormula", "structure_exact_mass": "MonoisotopicMass", "structure_xlogp": "XLogP"},
    "bigg": {"structure_inchikey": "inchi_key", "structure_name": "name", "structure_molecular_formula": "formula"},
}


def library_pairs(df: DataFrame, kind: str, organism: str | None = None) -> DataFrame:
    """A library file's rows under the common model: numbers cast, lacking columns null; organism: the one that all rows are of, where the file names none."""
    from spectrail.operators.keys import conform

    renamed = df.select(*[F.col(f"`{old}`").alias(new) for new, old in LIBRARY_COLUMNS[kind].items() if old in df.columns])
    if organism is not None:
        renamed = renamed.withColumn("organism_name", F.lit(organism))
    names = ["structure_inchikey", "structure_smiles", "structure_name", "structure_molecular_formula", "structure_tag", "organism_name", "reference_doi"]
    fields = [StructField(c, StringType()) for c in names] + [StructField(c, DoubleType()) for c in ("structure_exact_mass", "structure_xlogp")]
    return conform(renamed, StructType(fields)).where("structure_inchikey IS NOT NULL").distinct()


def looked_up(names: DataFrame, column: str, fetch: Callable[[list[str]], dict[str, str]], batch: int = 100, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """(column, found): what `fetch` gives for each distinct name, asked in batches; a name without an answer is asked again by its first word.

    fetch may fail: it is tried again after twice the time each, and its last error ends the job. Null names aren't asked.
    """
    from time import sleep

    def ask(wanted: list[str]) -> dict[str, str]:
        for k in range(tries):
            try:
                return fetch(wanted)
            except OSError:
                if k == tries - 1:
                    raise
                sleep(wait * 2**k)
        return {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                own = list(pdf[column].iloc[k : k + batch])
                found = ask(own)
                lost = {n: n.split()[0] for n in own if n not in found and len(n.split()) > 1}
                again = ask(sorted(set(lost.values()))) if lost else {}
                yield pd.DataFrame({column: own, "found": [found.get(n, again.get(lost.get(n, ""))) for n in own]}, dtype=object)

    return names.select(column).where(F.col(column).isNotNull()).distinct().mapInPandas(run, f"{column} string, found string")


def supplement_from_cache(table: DataFrame, cache: DataFrame, key: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Adds the cache's rows of keys that the table lacks. aliases: the cache's column names to the table's."""
    rows = cache.withColumnsRenamed(aliases or {})
    have = [c for c in table.columns if c in rows.columns]
    rows = first_row(rows.select(*have).where(F.col(key).isNotNull()), [key], [F.col(c).asc_nulls_last() for c in have])
    return table.unionByName(rows.join(table.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def enrich_structures(df: DataFrame, stages: list[tuple[str, DataFrame]], columns: list[str]) -> DataFrame:
    """Fills missing values of the columns by one lookup after the other (key, table with one row per key); a present value is never replaced."""
    for key, lookup in stages:
        have = [c for c in columns if c in lookup.columns]
        names = {c: f"__{c}" for c in have}
        df = df.join(lookup.select(key, *have).withColumnsRenamed(names), key, "left").withColumns({c: F.coalesce(F.col(c), F.col(n)) for c, n in names.items()}).drop(*names.values())
    return df


def pivot_xrefs(xrefs: DataFrame, prefixes: list[str] | None = None) -> DataFrame:
    """One column per prefix with a structure's distinct ids, joined; prefixes: a known list spares the pass that finds them."""
    wide = xrefs.groupBy("inchikey").pivot("prefix", prefixes) if prefixes else xrefs.groupBy("inchikey").pivot("prefix")
    wide = wide.agg(F.collect_set("id"))
    return wide.select("inchikey", *[F.nullif(F.array_join(F.array_sort(c), " $ "), F.lit("")).alias(c) for c in wide.columns if c != "inchikey"])


def rt_library(rows: DataFrame, unit: str, kind: str) -> DataFrame:
    """Retention-time library in minutes: distinct (rt, structure layer, type)."""
    rt = F.col("rt").try_cast("double")
    return rows.select(
        (rt / 60 if unit == "seconds" else rt).alias("rt"),
        F.substring("structure_inchikey", 1, 14).alias("candidate_structure_inchikey_connectivity_layer"),
        F.lit(kind).alias("type"),
    ).where("rt IS NOT NULL AND candidate_structure_inchikey_connectivity_layer IS NOT NULL").distinct()


def exploded(df: DataFrame, column: str, separator: str = r"\|") -> DataFrame:
    """One row per part of a cell with several values, trimmed, blanks left out; a null cell keeps its row."""
    parts = F.filter(F.transform(F.split(F.col(column), separator), lambda x: F.trim(x)), lambda x: x != "")
    return df.withColumn(column, F.explode_outer(F.when(F.col(column).isNotNull(), parts)))


def exploded_together(df: DataFrame, columns: list[str], separator: str = r" \$ ") -> DataFrame:
    """Parallel cells with several values to rows; shorter ones are filled up with nulls."""
    arrays = df.withColumns({c: F.split(F.col(c), separator) for c in columns})
    zipped = arrays.withColumn("__z", F.explode_outer(F.arrays_zip(*columns)))
    return zipped.withColumns({c: F.col(f"__z.{c}") for c in columns}).drop("__z")


def standardized_smiles(df: DataFrame, column: str, cache: DataFrame, standardize=None) -> DataFrame:
    """Joins each SMILES with its standard form: from the cache, else from standardize (a mapInPandas function over the distinct new ones) if given."""
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    known = cache.join(distinct, column, "left_semi")
    if standardize is not None:
        known = known.unionByName(distinct.join(cache.select(column), column, "left_anti").mapInPandas(standardize, cache.schema))
    return df.join(known, column, "left")


