"""Writers: delimited text, Parquet and mzTab-M."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrail.operators.keys import union_all


def write_delimited(df: DataFrame, path: str, compressed: bool = True) -> None:
    """Tab-separated text with empty cells for nulls, as many files as partitions."""
    cells = [F.concat_ws("|", F.col(c)).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*cells).write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="", emptyValue="", compression="gzip" if compressed else "none")


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """The form of tables between steps."""
    (df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")).parquet(path)


def section_lines(df: DataFrame, head: str, row: str, order: list[str]) -> DataFrame:
    """One section of mzTab-M text: (part, place, value), its header first, nulls as the text null."""
    cells = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]+", " "), F.lit("null")) for c in df.columns]
    rows = df.select(F.lit(1).alias("part"), F.row_number().over(Window.orderBy(*order)).alias("place"), F.concat_ws("\t", F.lit(row), *cells).alias("value"))
    header = df.sparkSession.createDataFrame([(0, 0, "\t".join([head, *df.columns]))], "part int, place int, value string")
    return header.unionByName(rows)


def mztab_tables(results: DataFrame) -> dict[str, DataFrame]:
    """Summary, feature and evidence rows of annotated results.

    results: feature_id, mz, rt, adduct, structure, name, formula, smiles, score, rank. Features and evidences are numbered
    in the order of feature ids; an evidence refers to its feature, a summary to its features and evidences.
    """
    f = F.dense_rank().over(Window.orderBy("feature_id"))
    e = F.row_number().over(Window.orderBy("feature_id", F.col("rank").asc_nulls_last(), "structure"))
    numbered = results.withColumn("SMF_ID", f).withColumn("SME_ID", F.when(F.col("structure").isNotNull(), e))
    smf = numbered.groupBy("SMF_ID").agg(
        F.array_join(F.array_sort(F.collect_set("SME_ID")), "|").alias("SME_ID_REFS"), F.min("adduct").alias("adduct_ion"), F.min("mz").alias("exp_mass_to_charge"), (F.min("rt") * 60).alias("retention_time_in_seconds"), F.min("feature_id").alias("opt_global_feature_id")
    )
    sme = numbered.where("SME_ID IS NOT NULL").select("SME_ID", F.col("feature_id").alias("evidence_input_id"), F.col("structure").alias("database_identifier"), F.col("formula").alias("chemical_formula"), "smiles", F.col("name").alias("chemical_name"), F.col("adduct").alias("adduct_ion"), F.col("mz").alias("exp_mass_to_charge"), "score", "rank")
    sml = numbered.where("rank = 1 OR structure IS NULL").groupBy("structure").agg(
        F.array_join(F.array_sort(F.collect_set("SMF_ID")), "|").alias("SMF_ID_REFS"), F.array_join(F.array_sort(F.collect_set("adduct")), "|").alias("adduct_ions"), F.min("formula").alias("chemical_formula"), F.min("name").alias("chemical_name"), F.max("score").alias("best_id_confidence_value")
    )
    sml = sml.withColumn("SML_ID", F.row_number().over(Window.orderBy(F.col("structure").asc_nulls_last())))
    return {"sml": sml.select("SML_ID", *[c for c in sml.columns if c != "SML_ID"]), "smf": smf, "sme": sme}


def write_mztab(results: DataFrame, metadata: dict[str, str], path: str) -> None:
    """An mzTab-M text file. Its sections are ordered, so it is written by one task: results of one study, not a whole archive."""
    spark = results.sparkSession
    tables = mztab_tables(results)
    meta = spark.createDataFrame([(0, i, f"MTD\t{k}\t{v}") for i, (k, v) in enumerate(metadata.items())], "part int, place int, value string")
    parts = [meta.withColumn("section", F.lit(0))]
    for n, (name, head, row, order) in enumerate((("sml", "SMH", "SML", "SML_ID"), ("smf", "SFH", "SMF", "SMF_ID"), ("sme", "SEH", "SME", "SME_ID")), 1):
        parts.append(section_lines(tables[name], head, row, [order]).withColumn("section", F.lit(n)))
    union_all(*parts).orderBy("section", "part", "place").coalesce(1).select("value").write.mode("overwrite").text(path)


def union_refs(a: Column, b: Column) -> Column:
    """References of two cells, each once, in order."""
    parts = F.array_union(F.coalesce(F.split(a, r"\|"), F.array()), F.coalesce(F.split(b, r"\|"), F.array()))
    return F.nullif(F.array_join(F.array_sort(F.filter(parts, lambda x: x != "")), "|"), F.lit(""))


def merge_rows(base: DataFrame, new: DataFrame, key: list[str], refs: list[str]) -> DataFrame:
    """Rows of both tables by a stable key: new values win where there are any, references are united."""
    renamed = new.withColumnsRenamed({c: f"__{c}" for c in new.columns if c not in key})
    both = base.join(renamed, key, "full")
    columns = [c for c in base.columns if c not in key] + [c for c in new.columns if c not in key and c not in base.columns]

    def merged(c: str) -> Column:
        if c not in base.columns:
            return F.col(f"__{c}").alias(c)
        if c not in new.columns:
            return F.col(c)
        return (union_refs(F.col(c), F.col(f"__{c}")) if c in refs else F.coalesce(F.col(f"__{c}"), F.col(c))).alias(c)

    return both.select(*key, *[merged(c) for c in columns])


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row, nulls left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
