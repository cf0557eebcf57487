"""Files written and read again, and kernels against brute force."""

from __future__ import annotations

import json
import random
import zipfile
from itertools import permutations
from math import sqrt

import pytest
from pyspark.sql import functions as F

from spectrail.operators.intervals import Tolerance
from spectrail.operators.libraries import completed_organisms, library_pairs, looked_up, prepared_library
from spectrail.operators.masses import propagate_in_components
from spectrail.operators.scoring import LAYER, collapse_to_anchors, drop_null_columns, mini_labels, promote_anchors
from spectrail.operators.spectra import aligned_score, annotate_spectra, entropy_similarity, joined_peaks, reduce_library, shifted_cosine, similarity_edges
from spectrail.plans.annotate_masses import MassSettings, annotate_masses
from spectrail.plans.filter_annotations import filter_annotations
from spectrail.sources.annotations import report_mgf, spectral_library
from spectrail.sources.sinks import write_delimited, write_mztab, write_parquet
from spectrail.sources.text import harmonized_spectra, mztab_features, read_bigg, read_delimited, read_mgf, read_msp, read_mztab, read_mztab_json, read_sdf, read_sirius


def test_delimited_round_trip(spark, rows, tmp_path):
    df = spark.createDataFrame([("a", None, ["x", "y"]), ("b c", "NA", ["z"])], "k string, v string, l array<string>")
    write_delimited(df, f"{tmp_path}/t.tsv")
    assert rows(read_delimited(spark, f"{tmp_path}/t.tsv", "\t", ["k", "v", "l"], ["k"])) == [("a", None, "x|y"), ("b c", None, "z")]
    with pytest.raises(ValueError, match="lacks"):
        read_delimited(spark, f"{tmp_path}/t.tsv", "\t", required=["nope"])
    write_parquet(df, f"{tmp_path}/t.parquet", ["k"])
    assert spark.read.parquet(f"{tmp_path}/t.parquet").count() == 2


def test_spectrum_files(spark, tmp_path):
    (tmp_path / "a.mgf").write_text("BEGIN IONS\nTITLE=x\nSCANS=7\nPEPMASS=100.5 3\nMSLEVEL=2\nION=[M+H]+\n50 1\n60.5 2\nEND IONS\n\nBEGIN IONS\nFEATURE_ID=8\nPRECURSOR_MZ=90\nCHARGE=1-\n20 5\nEND IONS\n")
    got = {r.feature_id: r for r in read_mgf(spark, str(tmp_path / "a.mgf")).collect()}
    assert (got["7"].precursor_mz, got["7"].adduct, got["7"].ms_level, len(got["7"].peaks)) == (100.5, "[M+H]+", 2, 2) and got["8"].charge == -1
    spectra = read_mgf(spark, str(tmp_path / "a.mgf"))
    assert [r.feature_id for r in harmonized_spectra(spectra, "pos").collect()] == ["7"]
    assert sorted(r.feature_id for r in harmonized_spectra(spectra, None, 2).collect()) == ["7", "8"]
    own, structures = spectral_library(spectra.withColumn("inchikey", F.lit("ABCDEFGHIJKLMN-X")), "neg")
    assert own.count() == 2 and structures.first()[LAYER] == "ABCDEFGHIJKLMN"
    assert report_mgf(spark.read.text(str(tmp_path / "a.mgf"))).first().issue is None
    assert report_mgf(spark.createDataFrame([("BEGIN IONS",)], "value string")).first().issue.startswith("unequal")
    (tmp_path / "a.msp").write_text("NAME: one\nPRECURSORMZ: 55.5\nPRECURSORTYPE: [M+H]+\nNum Peaks: 2\n10 1; \n20 3\n\nNAME: two\nPRECURSORMZ: 66\n30\t2\n")
    assert [(r.name, r.precursor_mz, len(r.peaks)) for r in read_msp(spark, str(tmp_path / "a.msp")).orderBy("name").collect()] == [("one", 55.5, 2), ("two", 66.0, 1)]
    (tmp_path / "a.sdf").write_text("mol\n> <HMDB_ID>\nH1\n\n> <INCHI_KEY>\nK1\n\n$$$$\nmol\n> <DATABASE_ID>\nD2\n\n$$$$\n")
    assert sorted(tuple(r) for r in read_sdf(spark, str(tmp_path / "a.sdf"), {"id": ["HMDB_ID", "DATABASE_ID"], "key": ["INCHI_KEY"]}).collect()) == [("D2", None), ("H1", "K1")]


def test_mztab_files(spark, tmp_path):
    results = spark.createDataFrame(
        [("f1", 100.5, 2.0, "[M+H]+", "S1", "one", "C6H6", None, 0.9, 1), ("f1", 100.5, 2.0, "[M+H]+", "S2", "two", None, None, 0.8, 2), ("f2", 200.25, None, None, None, None, None, None, None, None)],
        "feature_id string, mz double, rt double, adduct string, structure string, name string, formula string, smiles string, score double, rank int",
    )
    write_mztab(results, {"mzTab-version": "2.0.0-M"}, f"{tmp_path}/m.mztab")
    tables = read_mztab(spark, f"{tmp_path}/m.mztab")
    assert tables["smf"].count() == 2 and tables["sme"].count() == 2 and tables["metadata"].first().value == "2.0.0-M"
    assert sorted((r.mz, r.rt, r.adduct) for r in mztab_features(tables).where("mz IS NOT NULL").collect() if r.adduct) == [(100.5, 2.0, "[M+H]+")]
    doc = {"metadata": {"title": "t", "mzTab-version": "2.0.0-M"}, "smallMoleculeFeature": [{"SMF_ID": 1, "exp_mass_to_charge": 5.5}], "smallMoleculeSummary": []}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    read = read_mztab_json(spark, str(tmp_path / "m.json"))
    assert read["smf"].first().exp_mass_to_charge == 5.5 and {r.key: r.value for r in read["metadata"].collect()} == {"title": "t", "mzTab-version": "2.0.0-M"}


def test_search_exports(spark, rows, tmp_path):
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("1/structure.tsv", "a\tb\n1\t2\n3\tN/A\n")
        z.writestr("2/structure.tsv", "b\ta\n5\t6\n")
        z.writestr("2/other.tsv", "c\n9\n")
    assert rows(read_sirius(spark, str(tmp_path / "p.zip"), "structure.tsv"), "a", "b") in ([("1", "2"), ("3", None), ("6", "5")], [("1", "2"), ("3", "N/A"), ("6", "5")])
    assert read_sirius(spark, str(tmp_path / "p.zip"), "nothing.tsv") is None
    (tmp_path / "d" / "x").mkdir(parents=True)
    (tmp_path / "d" / "x" / "structure.tsv").write_text("a\tb\n1\t2\n")
    assert rows(read_sirius(spark, str(tmp_path / "d"), "structure.tsv")) == [("1", "2")] and read_sirius(spark, str(tmp_path / "d"), "nothing.tsv") is None


def test_libraries(spark, rows, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"metabolites": [{"id": "m1", "name": "one", "formula": "CH4", "annotation": {"inchi_key": ["K1-X-N"]}}, {"id": "m2", "name": "two", "annotation": {}}]}))
    bigg = read_bigg(spark, str(tmp_path / "b.json"))
    assert rows(bigg, "id", "inchi_key") == [("m1", "K1-X-N"), ("m2", None)]
    pairs = library_pairs(bigg, "bigg", "Escherichia coli")
    assert [(r.structure_inchikey, r.organism_name, r.structure_smiles) for r in pairs.collect()] == [("K1-X-N", "Escherichia coli", None)]
    full = spark.createDataFrame([("K1-X-N", "s", "one", "Homo sapiens", "d", "notClassified"), ("K2-X-N", "t", "two", "Escherichia coli", None, None)], "structure_inchikey string, structure_smiles string, structure_name string, organism_name string, reference_doi string, organism_taxonomy_08genus string")
    blank = {c: F.lit(None).cast("string") for c in ["structure_tax_cla_chemontid", "organism_taxonomy_ottid", *[f"structure_tax_{x}" for x in ("cla_01kin", "cla_02sup", "cla_03cla", "cla_04dirpar", "npc_01pat", "npc_02sup", "npc_03cla")], *[f"organism_taxonomy_{r}" for r in ("01domain", "02kingdom", "03phylum", "04class", "05order", "06family", "07tribe", "09species", "10varietas")]]}
    known = spark.createDataFrame([("Homo sapiens", "Homo"), ("Escherichia coli", "Escherichia")], "organism_name string, organism_taxonomy_08genus string")
    classes = spark.createDataFrame([("s", "Alkaloids")], "structure_smiles string, structure_tax_npc_01pat string")
    out = prepared_library([full.withColumns(blank), pairs], known, [("structure_smiles", classes)], "organism_taxonomy_08genus", "^Homo$")
    assert [r.structure_inchikey for r in out["key"].collect()] == ["K1-X-N"]
    assert rows(out["str_tax_npc"], "structure_smiles", "structure_tax_npc_01pat") == [("s", "Alkaloids"), ("t", "notClassified")]
    with pytest.raises(ValueError, match="no organism"):
        prepared_library([full.withColumns(blank), pairs], None, None, "organism_taxonomy_08genus", "^Nix$")
    assert rows(completed_organisms(known.withColumn("organism_taxonomy_08genus", F.lit(None).cast("string")), known)) == rows(known)


def test_looked_up_in_batches(spark, rows):
    def fetch(names):
        assert len(names) <= 2
        return {n: n.upper() for n in names if n in ("homo", "pan troglodytes")}

    names = spark.createDataFrame([("homo sapiens",), ("homo",), ("pan troglodytes",), (None,), ("x y",), ("homo",)], "name string")
    assert rows(looked_up(names, "name", fetch, batch=2)) == [("homo", "HOMO"), ("homo sapiens", None), ("pan troglodytes", "PAN TROGLODYTES"), ("x y", None)] or dict(rows(looked_up(names, "name", fetch, batch=2)))["homo sapiens"] == "HOMO"


def test_aligned_score_equals_brute_force():
    rng = random.Random(12)
    for _ in range(60):
        x = [(float(m), rng.random() + 0.1) for m in sorted(rng.sample(range(20), 4))]
        y = [(float(m), rng.random() + 0.1) for m in sorted(rng.sample(range(20), 4))]
        shift = rng.choice([0.0, 2.0, 3.0])
        pairs = joined_peaks(x, y, 100.0, 100.0 + shift, 0.01, 0.0)
        lines = [(*(x[i] if i is not None else (None, None)), *(y[j] if j is not None else (None, None))) for i, j in pairs]
        score, matches = aligned_score(lines)
        legal = {(i, j) for i, j in pairs if i is not None and j is not None}
        scale = sqrt(sum(i for _, i in x) * sum(i for _, i in y))
        best = max(sum(sqrt(x[i][1] * y[j][1]) for i, j in enumerate(p) if (i, j) in legal) for p in permutations(range(4)))
        assert score == pytest.approx(best / scale) == pytest.approx(shifted_cosine(x, y, 100.0, 100.0 + shift, 0.01, 0.0)[0]) and matches <= 4
    assert aligned_score([]) == aligned_score([(1.0, 0.0, 1.0, 2.0)]) == (0.0, 0)


@pytest.mark.parametrize("method", ["gnps", "entropy"])
def test_similarity_edges_lose_no_pair(spark, method):
    """All pairs above the threshold, by brute force, though one peak is in every spectrum."""
    rng = random.Random(14)
    spectra = []
    for n in range(40):
        at = sorted({100.0, *(rng.randrange(20, 180) * 1.0 for _ in range(rng.randrange(1, 5)))})
        spectra.append((n, 200.0 + rng.randrange(3), [(m, rng.random() + (0.01 if m == 100.0 else 0.3)) for m in at]))
    spectra += [(100, 200.0, []), (101, 201.0, [(50.0, 1.0)])]
    df = spark.createDataFrame(spectra, "feature_id long, precursor_mz double, peaks array<struct<mz: double, intensity: double>>")
    for threshold in (0.0, 0.5, 0.8):
        got = {(r.feature_source, r.feature_target): r.candidate_score_similarity for r in similarity_edges(df, method, threshold).collect()}
        want = {}
        for a, pa, x in spectra:
            for b, pb, y in spectra:
                score = 0.0 if a >= b else entropy_similarity(x, y, 0.01, 10.0) if method == "entropy" else shifted_cosine(x, y, pa, pb, 0.01, 10.0)[0]
                if score > threshold and (method == "gnps" or {m for m, _ in x} & {m for m, _ in y}):
                    want[a, b] = score
        assert got == pytest.approx(want) and (threshold or len(want) > 100)


def test_rescue_by_neutral_mass(spark):
    peaks = "array<struct<mz: double, intensity: double>>"
    own = [(50.0, 1.0), (60.0, 2.0)]
    queries = spark.createDataFrame([("q1", 101.0, own, "[M+H]+", 100.0), ("q2", 123.0, own, "[M+Na]+", 100.0), ("q3", 300.0, [], "[M+H]+", 299.0)], f"feature_id string, precursor_mz double, peaks {peaks}, adduct string, neutral_mass double")
    library = spark.createDataFrame([("l1", "S", 101.0, own, "[M+H]+", 100.0)], f"spectrum_id string, structure string, precursor_mz double, peaks {peaks}, adduct string, neutral_mass double")
    got = {r.feature_id: r.candidate_adduct_match_mode for r in annotate_spectra(queries, library, Tolerance(0.0, 0.01), 0.5).collect()}
    assert got == {"q1": "exact_adduct", "q2": "m_delta_rescued"}
    assert reduce_library(library, queries.where("feature_id = 'q2'"), Tolerance(0.0, 0.01)).count() == 1
    assert reduce_library(library.drop("neutral_mass"), queries.where("feature_id = 'q2'"), Tolerance(0.0, 0.01)).count() == 0


def test_anchors_promote_and_collapse(spark, rows):
    columns = f"candidate_id long, feature_id string, {LAYER} string, candidate_adduct string, rank_final int, score_weighted_chemo double, candidate_structure_exact_mass double, neutral_mass double, rt double, candidate_score_similarity double, candidate_score_sirius_confidence double"
    df = spark.createDataFrame(
        [(1, "f1", "A", "H", 1, 0.9, 100.0, 100.0, 1.0, 0.8, None), (2, "f2", "B", "H", 1, 0.8, 100.0, 100.0, 1.0, None, None), (3, "f2", "A", "H", 2, 0.7, 100.0, 100.0, 1.0, None, None), (4, "f3", "B", "H", 1, 0.8, 100.0, 100.0, 1.0, None, None), (5, "f4", "A", "H", 1, 0.5, 100.0, 100.0, 1.0, None, None), (6, "f4", "C", "H", 1, 0.5, 100.0, 100.0, 1.0, None, None)],
        columns,
    )
    parts = spark.createDataFrame([("f1", "c"), ("f2", "c"), ("f4", None)], "feature_id string, component_id string")
    got = promote_anchors(df, parts)
    assert rows(got.where("feature_id = 'f2'"), "candidate_id", "rank_final", "promoted") == [(2, 2, False), (3, 1, True)]
    assert rows(got.where("feature_id = 'f3'"), "rank_final", "promoted") == [(1, False)]
    kept = collapse_to_anchors(df)
    assert rows(kept.where("feature_id = 'f4'"), "candidate_id") == [(5,)] and kept.count() == 5
    labels = df.withColumns({"candidate_structure_tax_cla_02sup": F.lit("Sup"), "candidate_structure_tax_cla_03cla": F.lit("notClassified"), "feature_pred_tax_cla_02sup_val": F.lit("Guess"), "feature_pred_tax_cla_02sup_score": F.lit(0.95), "feature_pred_tax_cla_03cla_val": F.lit(None).cast("string"), "feature_pred_tax_cla_03cla_score": F.lit(None).cast("double")})
    found = {r.feature_id: (r.label_classyfire, r.score_classyfire, r.label_npclassifier) for r in mini_labels(labels, {"cla_02sup": 0.8, "cla_03cla": 1.0}).collect()}
    assert found["f1"] == ("Sup", None, None) and found["f4"] == ("Guess", pytest.approx(0.76), None)
    assert "rt" not in drop_null_columns(df.withColumn("rt", F.lit(None).cast("double"))).columns


def test_filter_pipeline(spark, rows):
    features = spark.createDataFrame([("f1", 1.0, 101.0), ("f2", 2.0, 50.0)], "feature_id string, rt double, mz double")
    columns = f"candidate_id long, feature_id string, {LAYER} string, candidate_library string, state_key string, neutral_mass double, candidate_score_similarity double"
    ms1 = spark.createDataFrame([(1, "f1", "A", "l", "[M+H]+", 100.0, None), (2, "f1", "B", "l", "[M+Na]+", 78.0, None), (3, "f1", "C", "l", "[M+H]+", 100.0, None)], columns)
    spectral = spark.createDataFrame([(4, "f1", "A", "l", "[M+H]+", 100.0, 0.9)], columns)
    states = spark.createDataFrame([("f1", "[M+H]+", 100.0, 3)], "feature_id string, state_key string, neutral_mass double, support long")
    times = spark.createDataFrame([("A", 1.5), ("A", 9.0), ("C", 7.0)], f"{LAYER} string, rt double")
    got = filter_annotations(features, ms1, spectral, states, times, rt=2.0)
    assert rows(got, "feature_id", "candidate_id", "candidate_structure_error_rt") == [("f1", 4, -0.5), ("f2", None, None)]
    assert rows(filter_annotations(features, ms1, spectral, states), "candidate_id") == [(3,), (4,), (None,)]


def test_propagation_and_mass_pipeline(spark, rows):
    known = spark.createDataFrame([("a", "S", 100.0)], "feature_id string, structure string, mass double")
    parts = spark.createDataFrame([("a", "c"), ("b", "c"), ("d", "c"), ("e", "x")], "feature_id string, component string")
    masses = spark.createDataFrame([("b", 100.0005), ("d", 101.0), ("e", 100.0)], "feature_id string, mass double")
    assert rows(propagate_in_components(known, parts, masses, Tolerance(10.0, 0.0)), "feature_id", "structure") == [("b", "S")]
    proton, sodium = 1.007825, 22.98977
    mass, electron = 180.0634, 0.000548579909065
    features = spark.createDataFrame([("h", "s", 1.0, mass + proton - electron, None), ("na", "s", 1.01, mass + sodium - electron, None), ("w", "s", 1.0, mass + proton - electron - 18.010565, None), ("far", "s", 9.0, 555.5, "[M+K]+|[M+H]+")], "feature_id string, sample string, rt double, mz double, adduct string")
    library = spark.createDataFrame([("GLC", mass, "C6H12O6"), ("NOO", mass, "C15")], "structure string, exact_mass double, formula string")
    adducts = spark.createDataFrame([("[M+H]+", 1, 1, proton, 0), ("[M+Na]+", 1, 1, sodium, 0)], "adduct string, n_mer int, z int, adduct_mass double, tier int")
    clusters, losses = (spark.createDataFrame(t, "distance double, label string") for t in ([(17.026549, "H3N")], [(18.010565, "H2O")]))
    intensities = spark.createDataFrame([(f, s, float(v * k)) for f, k in (("h", 2), ("na", 3)) for s, v in zip("tuvw", (1, 5, 2, 9), strict=True)], "feature_id string, sample string, intensity double")
    out = annotate_masses(features, library, adducts, clusters, losses, MassSettings(10.0, 0.005, 0.05, ("[M+H]+",)), intensities)
    found = {(r.feature_id, r.adduct, r.structure) for r in out["annotations"].collect()}
    assert {("h", "[M+H]+", "GLC"), ("na", "[M+Na]+", "GLC"), ("h", "[M+H]+", "NOO"), ("w", "[M-H2O+H]+", "GLC")} <= found and ("w", "[M-H2O+H]+", "NOO") not in found
    edges = {(r.feature_source, r.feature_target, r.label) for r in out["edges"].collect()}
    assert {("h", "na", "[M+H]+ _ [M+Na]+"), ("w", "h", "H2O"), ("h", "na", "covariance"), ("far", "far", None)} <= edges
    assert rows(out["components"]) == [("h", "h"), ("na", "h")]
