"""Adapters from upstream tools' tables to the candidate model, and reports on inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrail.operators.keys import first_row, union_all
from spectrail.operators.scoring import LAYER

_S, _P = "candidate_structure_", "feature_pred_tax_"
#: Columns of the model by those of each upstream tool.
MODELS = {
    "gnps": {
        "feature_id": "#Scan#", "candidate_adduct": "Adduct", "candidate_library": "LibraryName", f"{_S}name": "Compound_Name", "candidate_score_similarity": "MQScore",
        "candidate_count_similarity_peaks_matched": "SharedPeaks", f"{_S}smiles_no_stereo": "Smiles", f"{_S}tax_npc_01pat": "npclassifier_pathway",
        f"{_S}tax_npc_02sup": "npclassifier_superclass", f"{_S}tax_npc_03cla": "npclassifier_class", f"{_S}tax_cla_02sup": "superclass", f"{_S}tax_cla_03cla": "class", f"{_S}tax_cla_04dirpar": "subclass",
    },
    "mzmine": {"feature_id": "id", f"{_S}name": "compound_name", f"{_S}smiles_no_stereo": "smiles", "candidate_adduct": "adduct", "candidate_score_similarity": "score"},
    "sirius_structures": {
        "feature_id": "mappingFeatureId", "candidate_adduct": "adduct", f"{_S}name": "name", f"{_S}smiles_no_stereo": "smiles", f"{_S}molecular_formula": "molecularFormula",
        "candidate_score_sirius_confidence": "ConfidenceScoreApproximate", "candidate_score_sirius_csi": "CSI.FingerIDScore", "candidate_score_sirius_msnovelist": "ModelScore",
    },
    "sirius_formulas": {
        "feature_id": "mappingFeatureId", "candidate_adduct": "adduct", f"{_S}molecular_formula": "molecularFormula", "candidate_score_sirius_zodiac": "ZodiacScore", "candidate_score_sirius_sirius": "SiriusScore",
        "candidate_score_sirius_tree": "TreeScore", "candidate_score_sirius_isotope": "IsotopeScore", "candidate_score_sirius_intensity": "explainedIntensity", "candidate_count_sirius_peaks_explained": "numExplainedPeaks",
    },
    "sirius_classes": {
        "feature_id": "mappingFeatureId", "candidate_adduct": "adduct", f"{_S}molecular_formula": "molecularFormula", f"{_P}npc_01pat_val": "NPC.pathway", f"{_P}npc_01pat_score": "NPC.pathway.Probability",
        f"{_P}npc_02sup_val": "NPC.superclass", f"{_P}npc_02sup_score": "NPC.superclass.Probability", f"{_P}npc_03cla_val": "NPC.class", f"{_P}npc_03cla_score": "NPC.class.Probability",
        f"{_P}cla_02sup_val": "ClassyFire.superclass", f"{_P}cla_02sup_score": "ClassyFire.superclass.probability", f"{_P}cla_03cla_val": "ClassyFire.class", f"{_P}cla_03cla_score": "ClassyFire.class.Probability",
        f"{_P}cla_04dirpar_val": "ClassyFire.most.specific.class", f"{_P}cla_04dirpar_score": "ClassyFire.most.specific.class.Probability",
    },
}
#: The name under which a tool's rows appear if they name no library themselves.
LIBRARIES = {"mzmine": "mzmine", "sirius_structures": "SIRIUS"}


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def to_model(df: DataFrame, tool: str) -> DataFrame:
    """A tool's table under the model's column names: numbers cast, blanks in adducts removed, columns that it lacks left out, repeated rows dropped."""
    model = {new: old for new, old in MODELS[tool].items() if old in df.columns}

    def cast(new: str, c: Column) -> Column:
        if new == "candidate_adduct":
            return F.regexp_replace(c, r"\s+", "")
        number = new.startswith(("candidate_score_", "candidate_count_")) or new.endswith("_score")
        return c.try_cast("int" if "_count_" in new else "double") if number else c

    extra = []
    if tool == "gnps" and {"MZErrorPPM", "Precursor_MZ"} <= set(df.columns):
        extra.append((F.col("MZErrorPPM").try_cast("double") * 1e-6 * F.col("Precursor_MZ").try_cast("double")).alias("candidate_structure_error_mz"))
    if tool in LIBRARIES:
        extra.append(F.lit(LIBRARIES[tool]).alias("candidate_library"))
    return df.select(*[cast(new, _quoted(old)).alias(new) for new, old in model.items()], *extra).distinct()


def assemble_fingerprint_tables(structures: DataFrame, formulas: DataFrame, classes: DataFrame, de_novo: DataFrame, most_analog_error: float = 0.01) -> DataFrame:
    """Structure candidates with the best formula row and classes of their feature, and de-novo rows of features that have no structure.

    All tables follow the model; candidates whose m/z error exceeds the limit are analogs and go; an unknown error is taken
    from the formula row.
    """
    keys = ["feature_id", "candidate_structure_molecular_formula"]
    best = first_row(formulas, keys, [F.col("candidate_score_sirius_zodiac").desc_nulls_last(), F.col("candidate_adduct").asc_nulls_last()]).drop("candidate_adduct")
    if "candidate_structure_error_mz" in best.columns:
        best = best.withColumnRenamed("candidate_structure_error_mz", "__formula_error")
    rows = union_all(structures, de_novo.join(structures.select("feature_id").distinct(), "feature_id", "left_anti"))
    joined = rows.join(best, keys, "left")
    error = [F.col(c) for c in ("candidate_structure_error_mz", "__formula_error") if c in joined.columns]
    joined = joined.withColumn("candidate_structure_error_mz", F.coalesce(*error) if error else F.lit(None).cast("double")).drop("__formula_error")
    one = first_row(classes, ["feature_id"], [F.col("candidate_adduct").asc_nulls_last()]).drop("candidate_adduct", "candidate_structure_molecular_formula")
    limit = F.col("candidate_structure_error_mz").isNull() | (F.abs("candidate_structure_error_mz") <= most_analog_error)
    return joined.where(limit).join(one, "feature_id", "left")


def merge_edges(mass_edges: DataFrame, entropies: DataFrame, spectral_edges: DataFrame) -> DataFrame:
    """Edges of both kinds with the entropy of their source: full joins on (source, target), a missing target being the source itself."""
    ends = ["feature_source", "feature_target"]
    both = mass_edges.join(spectral_edges, ends, "full").join(entropies, "feature_source", "full")
    return both.withColumn("feature_target", F.coalesce("feature_target", "feature_source")).distinct()


def spectral_library(spectra: DataFrame, polarity: str) -> tuple[DataFrame, DataFrame]:
    """Library spectra of one polarity (by the sign of their charge, unknown ones included), and the structures that they name."""
    sign = F.col("charge") > 0 if polarity == "pos" else F.col("charge") < 0
    own = spectra.where(F.col("charge").isNull() | sign)
    structures = own.where("inchikey IS NOT NULL OR smiles IS NOT NULL").select(F.col("inchikey").alias("structure_inchikey"), F.col("smiles").alias("structure_smiles"), F.col("name").alias("structure_name"), F.substring("inchikey", 1, 14).alias(LAYER)).distinct()
    return own, structures


def report_mgf(lines: DataFrame) -> DataFrame:
    """(spectra, ended, with_peaks, issue) of MGF text, one row; lines: value."""
    counts = lines.agg(
        F.count_if(F.col("value").rlike("(?i)^BEGIN IONS")).alias("spectra"), F.count_if(F.col("value").rlike("(?i)^END IONS")).alias("ended"), F.count_if(F.col("value").rlike("^[0-9]")).alias("peaks")
    )
    issue = F.when(F.col("spectra") == 0, "no spectra").when(F.col("spectra") != F.col("ended"), "unequal numbers of beginnings and ends").when(F.col("peaks") == 0, "no peaks")
    return counts.withColumn("issue", issue)


def report_table(df: DataFrame, key: str) -> DataFrame:
    """(rows, distinct_keys, missing_keys, repeated_keys) of a table, one row."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(key).alias("distinct_keys"), F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("missing_keys"), F.count_if(F.col(key).isNotNull() & (F.col("n") > 1)).alias("repeated_keys")
    )


def report_mismatches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: (key, side); null keys are left out."""
    a, b = (t.select(key).where(F.col(key).isNotNull()).distinct() for t in (left, right))
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))
