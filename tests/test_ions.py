"""Adducts, formulas, spectra and text sources."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from spectrail.operators.adducts import canonical_adduct, formula_mass, loss_is_possible, parse_adduct, subtract
from spectrail.operators.spectra import _best_matching, cleaned_peaks, combine_replicates, entropy, entropy_similarity, matched_peaks, merged_peaks, shifted_cosine, similarity_edges
from spectrail.sources.sinks import merge_rows, write_delimited
from spectrail.sources.text import parse_mgf, parse_msp, parse_mztab, read_delimited


def test_adducts():
    assert parse_adduct("[2M+Na]+")[:2] == (2, 0) and parse_adduct("[M+2H]+2")[3:] == (2, 1)
    assert parse_adduct("[M-H2O+H]+")[2] == pytest.approx(1.00782503223 - 18.0105646863, abs=1e-6)
    assert parse_adduct("garbage") is None and parse_adduct(None) is None and parse_adduct("junk/[M+H]+") is not None
    assert canonical_adduct("[M+H-H2O]+") == canonical_adduct("[M-H2O+H]+")
    assert canonical_adduct("[M+NH4-NH3]+") == "[M+H]+"
    assert parse_adduct("[M+1+H]+")[1] == 1


def test_formulas():
    assert formula_mass("C6H12O6") == pytest.approx(180.0633881)
    assert formula_mass("Xx2") is None and subtract("H4N", "H3N") == "H" and subtract("H2O", "H3N") is None
    assert loss_is_possible("[M-H2O+H]+", "C6H12O6") and not loss_is_possible("[M-H2O+H]+", "C6H12") and loss_is_possible("[M-H2O+H]+", None)


def test_similarity_of_a_spectrum_with_itself_and_shifted():
    x = [(50.0, 1.0), (75.0, 4.0), (120.0, 2.0)]
    score, n, forward, reverse = shifted_cosine(x, x, 200.0, 200.0, 0.01, 10.0)
    assert (round(score, 12), n, forward, reverse) == (1.0, 3, 1.0, 1.0)
    moved = [(m + 14.0, i) for m, i in x]
    assert shifted_cosine(x, moved, 200.0, 214.0, 0.01, 10.0)[:2] == pytest.approx((1.0, 3))
    assert shifted_cosine([], x, 1.0, 2.0, 0.01, 10.0) == (0.0, 0, 0.0, 0.0)
    assert entropy_similarity(x, x, 0.01, 10.0) == pytest.approx(1.0) and entropy_similarity(x, [(500.0, 1.0)], 0.01, 10.0) == 0.0


def test_matching_is_the_best_one():
    rng = random.Random(7)
    for _ in range(200):
        w = {(i, j): rng.random() for i in range(4) for j in range(4) if rng.random() < 0.6}
        got = _best_matching(w)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        best = 0.0
        for k in range(5):
            for some in itertools.combinations(w, k):
                if len({i for i, _ in some}) == len({j for _, j in some}) == k:
                    best = max(best, sum(w[p] for p in some))
        assert sum(w[p] for p in got) == pytest.approx(best)


def test_peaks():
    assert merged_peaks([(100.0, 1.0), (100.005, 3.0), (200.0, float("nan")), (-1.0, 2.0)], 0.01, 0.0) == [(pytest.approx(100.00375), 4.0)]
    assert matched_peaks([1.0, 2.0, 3.0], [1.005, 2.9], 0.01, 0.0) == 1
    assert cleaned_peaks([], None, None, 0.01) == [] and sum(i for _, i in cleaned_peaks([(1.0, 5.0), (2.0, 6.0), (9.0, 7.0)], 0.0, 5.0, 0.01)) == pytest.approx(1.0)


def test_entropy_and_edges(spark, rows):
    df = spark.createDataFrame([("a", 100.0, [(50.0, 1.0), (60.0, 1.0)]), ("b", 114.0, [(64.0, 1.0), (74.0, 1.0)]), ("c", 100.0, [(10.0, 1.0)])], "feature_id string, precursor_mz double, peaks array<struct<mz:double,intensity:double>>")
    assert [round(r[0], 6) for r in df.select(entropy(F.col("peaks"))).collect()] == [0.693147, 0.693147, 0.0]
    assert [(r.feature_source, r.feature_target, r.matches) for r in similarity_edges(df, threshold=0.5).collect()] == [("a", "b", 2)]
    assert combine_replicates(df.withColumn("feature_id", F.lit("x"))).select(F.size("peaks")).first()[0] == 5


def test_mgf_in_any_order(spark):
    text = "BEGIN IONS\nTITLE=spec id=F7\nPEPMASS=150.5 100\nCHARGE=1-\nRTINSECONDS=90\n120.5 3\n100.1 1e2\n"
    turned = "100.1 1e2\n120.5 3\nRTINSECONDS=90\nCHARGE=1-\nPEPMASS=150.5 100\nTITLE=spec id=F7\nBEGIN IONS\n"
    got = parse_mgf(spark.createDataFrame([(text,), (turned,), ("\n",)], "value string")).collect()
    assert [(r.feature_id, r.precursor_mz, r.charge, r.rt, [tuple(p) for p in r.peaks]) for r in got] == [("F7", 150.5, -1, 1.5, [(100.1, 100.0), (120.5, 3.0)])] * 2


def test_msp(spark):
    got = parse_msp(spark.createDataFrame([("NAME: x\nPRECURSORMZ: 10.5\nNum Peaks: 1\n5.5 7\n",)], "value string")).first()
    assert (got.name, got.precursor_mz, [tuple(p) for p in got.peaks]) == ("x", 10.5, [(5.5, 7.0)])


def test_mztab_ragged_rows(spark):
    lines = ["﻿MTD\ttitle\tx", "SMH\tSML_ID\tname\tname", "SML 1\ta", "SML\t2\tnull\tb", "COM\tnote"]
    t = parse_mztab(spark.createDataFrame(list(enumerate(lines)), "n int, value string"))
    assert [tuple(r) for r in t["sml"].orderBy("SML_ID").collect()] == [("1", "a", None), ("2", None, "b")]
    assert t["metadata"].first().value == "x" and t["sme"].count() == 0


def test_delimited_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([("1", None), ("2", "a b"), (None, "NA")], "k string, v string")
    write_delimited(df, str(tmp_path / "t.tsv"))
    assert rows(read_delimited(spark, str(tmp_path / "t.tsv"), "\t")) == rows(spark.createDataFrame([("1", None), ("2", "a b"), (None, None)], "k string, v string"))


def test_merge_rows_unites_references(spark, rows):
    a = spark.createDataFrame([("k", "1|2", "old"), ("m", None, "x")], "k string, refs string, v string")
    b = spark.createDataFrame([("k", "2|3", None), ("n", "9", "new")], "k string, refs string, v string")
    assert rows(merge_rows(a, b, ["k"], ["refs"])) == [("k", "1|2|3", "old"), ("m", None, "x"), ("n", "9", "new")]
