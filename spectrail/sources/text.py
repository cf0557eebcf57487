"""Readers of delimited, spectrum, structure and mzTab-M text.

A parser takes the text as a DataFrame, so files of any size are split among tasks and tests need no files.
"""

from __future__ import annotations

import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectrail.functions.scalars import NULL_TEXTS


def read_delimited(spark: SparkSession, path: str | list[str], separator: str | None = None, columns: list[str] | None = None, required: list[str] | None = None) -> DataFrame:
    """All-string table from a CSV or TSV file (gzip by its name), marks for null read as null; only the wanted columns are kept."""
    separator = separator or ("," if ".csv" in str(path) else "\t")
    df = spark.read.csv(path, sep=separator, header=True, inferSchema=False, nullValue="", enforceSchema=False)
    missing = [c for c in required or [] if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    df = df.select(*[c for c in df.columns if columns is None or c in columns])
    return df.select(*[F.when(~F.col(f"`{c}`").isin(NULL_TEXTS), F.col(f"`{c}`")).alias(c) for c in df.columns])


def _header(block: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?im)^\s*{name}\s*[=:][ \t]*(.*)$", 1)), F.lit(""))


def _peaks(block: Column) -> Column:
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^\s*\d+(\.\d+)?([eE][+-]?\d+)?[\s;,]+\d"))
    pairs = F.transform(lines, lambda x: F.split(F.trim(x), r"[\s;,]+"))
    peaks = F.transform(pairs, lambda x: F.struct(F.get(x, F.lit(0)).try_cast("double").alias("mz"), F.get(x, F.lit(1)).try_cast("double").alias("intensity")))
    return F.array_sort(F.filter(peaks, lambda p: p["mz"].isNotNull() & p["intensity"].isNotNull()))


def charge_number(text: Column) -> Column:
    """Signed charge from forms such as 1+, -2 or 2."""
    n = F.regexp_extract(text, r"(\d+)", 1).try_cast("int")
    return F.when(text.contains("-"), -n).otherwise(n)


def parse_mgf(blocks: DataFrame) -> DataFrame:
    """Spectra of MGF text cut at END IONS (column value): feature_id, title, precursor_mz, adduct, ms_level, charge, rt (minutes), name, inchikey, smiles, peaks.

    Headers may come in any order, peaks too; the feature's id falls back to the title. Blocks without BEGIN IONS are no spectra.
    """
    b = F.col("value")
    rows = blocks.where(b.contains("BEGIN IONS"))
    return rows.select(
        F.coalesce(_header(b, "FEATURE_ID"), _header(b, "SCANS"), F.nullif(F.regexp_extract(_header(b, "TITLE"), r"id[=:_ ]*(\S+)", 1), F.lit("")), _header(b, "TITLE")).alias("feature_id"),
        _header(b, "TITLE").alias("title"),
        F.split(F.coalesce(_header(b, "PEPMASS"), _header(b, "PRECURSOR_MZ")), r"\s+")[0].try_cast("double").alias("precursor_mz"),
        F.coalesce(_header(b, "ADDUCT"), _header(b, "ION")).alias("adduct"),
        F.coalesce(_header(b, "MSLEVEL"), _header(b, "MS_LEVEL")).try_cast("int").alias("ms_level"),
        charge_number(_header(b, "CHARGE")).alias("charge"),
        (_header(b, "RTINSECONDS").try_cast("double") / 60).alias("rt"),
        _header(b, "NAME").alias("name"),
        _header(b, "INCHIKEY").alias("inchikey"),
        _header(b, "SMILES").alias("smiles"),
        _peaks(b).alias("peaks"),
    )


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """Spectra of an MGF file."""
    return parse_mgf(spark.read.text(path, lineSep="END IONS"))


def parse_msp(blocks: DataFrame) -> DataFrame:
    """Spectra of MSP text cut at blank lines (column value): name, precursor_mz, adduct, inchikey, smiles, peaks."""
    b = F.col("value")
    return blocks.where(b.rlike(r"(?im)^\s*NAME\s*:")).select(
        _header(b, "NAME").alias("name"),
        _header(b, "PRECURSORMZ").try_cast("double").alias("precursor_mz"),
        F.coalesce(_header(b, "PRECURSORTYPE"), _header(b, "PRECURSOR_TYPE")).alias("adduct"),
        _header(b, "INCHIKEY").alias("inchikey"),
        _header(b, "SMILES").alias("smiles"),
        _peaks(b).alias("peaks"),
    )


def read_msp(spark: SparkSession, path: str) -> DataFrame:
    """Spectra of an MSP file."""
    return parse_msp(spark.read.text(path, lineSep="\n\n"))


def mgf_block(feature_id: Column, precursor: Column, charge: Column, rt_minutes: Column, peaks: Column) -> Column:
    """One spectrum as MGF text."""
    lines = F.transform(peaks, lambda p: F.concat(p["mz"].cast("string"), F.lit(" "), p["intensity"].cast("string")))
    sign = F.concat(F.abs(charge).cast("string"), F.when(charge < 0, "-").otherwise("+"))
    head = F.concat_ws("\n", F.lit("BEGIN IONS"), F.concat(F.lit("FEATURE_ID="), feature_id), F.concat(F.lit("PEPMASS="), precursor.cast("string")), F.concat(F.lit("CHARGE="), sign), F.concat(F.lit("RTINSECONDS="), (rt_minutes * 60).cast("string")))
    return F.concat(head, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\nEND IONS"))


def parse_sdf(blocks: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """Records of SDF text cut at $$$$ (column value): for each field the first of its header names that has a value."""
    b = F.col("value")

    def get(name: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract(b, rf"(?m)^>\s*<{name}>.*\r?\n(.*)$", 1)), F.lit(""))

    return blocks.where(b.contains("> <")).select(*[F.coalesce(*[get(n) for n in names]).alias(field) for field, names in fields.items()])


def read_sdf(spark: SparkSession, path: str, fields: dict[str, list[str]]) -> DataFrame:
    """Records of an SDF file."""
    return parse_sdf(spark.read.text(path, lineSep="$$$$"), fields)


#: Header and row prefixes of the sections of mzTab-M text.
MZTAB = {"sml": ("SMH", "SML"), "smf": ("SFH", "SMF"), "sme": ("SEH", "SME")}


def parse_mztab(lines: DataFrame) -> dict[str, DataFrame]:
    """Sections of mzTab-M text (columns value, and n for the order of lines): metadata, sml, smf, sme, comments.

    Rows shorter than their header are filled with nulls; repeated header names get a number; the text null is null. Only
    the header lines come to the driver.
    """
    text = lines.select("n", F.regexp_replace(F.regexp_replace("value", "^\\ufeff", ""), r"^(MTD|SMH|SML|SFH|SMF|SEH|SME|COM) +", "$1\t").alias("value")).withColumn("cells", F.split("value", "\t"))
    kind = F.col("cells")[0]
    out = {
        "metadata": text.where(kind == "MTD").select(F.get("cells", F.lit(1)).alias("key"), F.nullif(F.get("cells", F.lit(2)), F.lit("null")).alias("value")),
        "comments": text.where(kind == "COM").select("n", F.array_join(F.slice("cells", 2, 10_000), "\t").alias("comment")),
    }
    heads = {r.cells[0]: r.cells[1:] for r in text.where(kind.isin([h for h, _ in MZTAB.values()])).select("cells").collect()}
    for name, (head, row) in MZTAB.items():
        seen: dict[str, int] = {}
        columns = []
        for c in heads.get(head, []):
            seen[c] = seen.get(c, 0) + 1
            columns.append(c if seen[c] == 1 else f"{c}_{seen[c]}")
        cells = [F.nullif(F.nullif(F.trim(F.get("cells", F.lit(i + 1))), F.lit("null")), F.lit("")).alias(c) for i, c in enumerate(columns)]
        out[name] = text.where(kind == row).select(*(cells or [F.lit(None).cast("string").alias("id")]))
    return out


def read_mztab(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Sections of an mzTab-M text file."""
    return parse_mztab(spark.read.text(path).withColumn("n", F.monotonically_increasing_id()))


def read_mztab_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Sections of an mzTab-M JSON file: metadata as key and value, and one table per row array."""
    doc = spark.read.json(path, multiLine=True)
    names = {"smallMoleculeSummary": "sml", "smallMoleculeFeature": "smf", "smallMoleculeEvidence": "sme"}
    rows = dict(doc.dtypes)  # an empty row array has no columns
    out = {short: doc.select(F.explode(long).alias("r")).select("r.*") for long, short in names.items() if rows.get(long, "").startswith("array<struct<")}
    meta = [f.name for f in doc.select("metadata.*").schema.fields]
    out["metadata"] = doc.select("metadata.*").select(*[F.to_json(F.struct(F.col(c).alias("v"))).alias(c) for c in meta]).unpivot([], meta, "key", "value").withColumn("value", F.get_json_object("value", "$.v"))
    return out


def mztab_features(tables: dict[str, DataFrame]) -> DataFrame:
    """Features of an mzTab-M document: those of its summary rows, filled from their first feature row (m/z, adduct, time in minutes)."""
    smf = tables["smf"].select(F.col("SMF_ID").alias("ref"), F.col("exp_mass_to_charge").try_cast("double").alias("mz"), (F.col("retention_time_in_seconds").try_cast("double") / 60).alias("rt"), F.col("adduct_ion").alias("adduct"))
    sml = tables["sml"]
    if sml.isEmpty():
        return smf.withColumnRenamed("ref", "feature_id")
    first = sml.select(F.col("SML_ID").alias("feature_id"), F.split("SMF_ID_REFS", r"\s*\|\s*")[0].alias("ref"), (F.split("adduct_ions", r"\s*\|\s*")[0] if "adduct_ions" in sml.columns else F.lit(None).cast("string")).alias("own_adduct"))
    return first.join(smf, "ref", "left").select("feature_id", "rt", "mz", F.coalesce("own_adduct", "adduct").alias("adduct"))


def _unzipped(name: str):
    """A function that gives the lines of all members of that file name in zip archives (path, content) as (member, n, value)."""

    def run(batches):
        import io

        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in (m for m in z.namelist() if m.rsplit("/", 1)[-1] == name):
                        with z.open(m) as raw:
                            lines = [x.rstrip("\r\n") for x in io.TextIOWrapper(raw, "utf-8")]
                        yield pd.DataFrame({"member": f"{path}!{m}", "n": range(len(lines)), "value": lines})

    return run


def read_sirius(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table of fingerprint-search exports, from a directory or a zip archive (or several by a pattern); None if it isn't there.

    Archives are read by the workers as binary files, one a task; only the header line comes to the driver. Cells are text,
    marks for null read as null; members whose columns are in another order are read by their own header.
    """
    if not path.endswith(".zip"):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(path).select("path")
        found = [r.path for r in files.limit(10_000).collect()]
        return read_delimited(spark, found, "\t") if found else None
    lines = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_unzipped(name), "member string, n long, value string")
    heads = lines.where("n = 0").select("value").distinct().collect()
    if not heads:
        return None
    columns = list(dict.fromkeys(c for r in heads for c in r.value.split("\t")))
    head = lines.where("n = 0").select("member", F.split("value", "\t").alias("names"))
    rows = lines.where("n > 0 AND value <> ''").join(head, "member").withColumn("cells", F.split("value", "\t"))

    def cell(c: str) -> Column:
        text = F.get("cells", (F.array_position("names", c) - 1).cast("int"))
        return F.when((F.array_position("names", c) > 0) & ~text.isin(NULL_TEXTS), text).alias(c)

    return rows.select(*[cell(c) for c in columns])


def read_bigg(spark: SparkSession, path: str) -> DataFrame:
    """Metabolites of a BiGG JSON model: id, name, formula, inchi_key (the first of several)."""
    doc = spark.read.json(path, multiLine=True).select(F.explode("metabolites").alias("m"))
    fields = doc.select("m.*")
    notes = fields.select("annotation.*").columns if "annotation" in fields.columns else []
    key = "inchi_key" if "inchi_key" in notes else None
    kind = dict(fields.select("annotation.*").dtypes).get(key, "string") if key else "string"
    inchi = F.lit(None).cast("string") if key is None else F.get(f"annotation.{key}", F.lit(0)) if kind.startswith("array") else F.col(f"annotation.{key}")
    return fields.select("id", "name", *(["formula"] if "formula" in fields.columns else [F.lit(None).cast("string").alias("formula")]), inchi.alias("inchi_key"))


def harmonized_spectra(spectra: DataFrame, polarity: str | None = None, level: int | None = None) -> DataFrame:
    """Spectra of one polarity (the sign of the charge, else the adduct's last sign; unknown ones stay) and one MS level (unknown ones stay)."""
    out = spectra
    if polarity is not None:
        want = 1 if polarity == "pos" else -1
        said = F.when(F.col("adduct").rlike(r"\+$"), 1).when(F.col("adduct").rlike(r"-$"), -1) if "adduct" in spectra.columns else F.lit(None).cast("int")
        sign = F.coalesce(F.signum("charge").cast("int"), said) if "charge" in spectra.columns else said
        out = out.where(sign.isNull() | (sign == want))
    if level is not None and "ms_level" in spectra.columns:
        out = out.where(F.col("ms_level").isNull() | (F.col("ms_level") == level))
    return out


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text with an order that holds within it."""
    return spark.read.text(path).withColumn("n", F.monotonically_increasing_id())


def section_rows(lines: DataFrame, order: str, text: str, prefix_length: int) -> DataFrame:
    """Lines by their prefix: (prefix, rest, place within the prefix)."""
    return lines.select(F.substring(text, 1, prefix_length).alias("prefix"), F.expr(f"substring({text}, {prefix_length + 1})").alias("rest"), F.row_number().over(Window.partitionBy(F.substring(text, 1, prefix_length)).orderBy(order)).alias("place"))
