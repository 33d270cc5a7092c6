import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlode.functions import text as t
from gridlode.plans import QUERIES


def check(spark, rows, kind, f):
    df = spark.createDataFrame(rows, f"raw string, want {kind}").select("*", f(F.col("raw")).alias("got"))
    assert [(r.raw, r.got) for r in df.collect()] == [(r.raw, r.want) for r in df.collect()]


LABELS = [
    ("TABLE III", "Table III"), ("Tab. 1", "Table 1"), ("表 2.3", "表2.3"), ("附表 4", "附表4"), ("Table 1A: Results", "Table 1A"), ("Table 1(a). Summary of findings", "Table 1(a)"), ("Table A-1. Description", "Table A-1"),
    ("Table 3 - continued", "Table 3"), ("4.9", "表4.9"), ("Table 2 - Method and results", "Table 2"), ("", ""), ("Supplementary Table S1", "Supplementary Table S1"), ("extended  data table 2", "Extended Data Table 2"), ("表一", "表一"),
    ("TABLE ２. x", "Table 2"), ("Table S1", "Table S1"), (None, ""),
]


def test_labels(spark):
    check(spark, LABELS, "string", t.canonical_label)


def test_merge_keys(spark):
    rows = [("01", "01"), ("007", "007"), ("25.0", "25"), ("13.00", "13"), ("0.0", "0"), ("+007", "007"), ("-5", "-5"), (" A ", "a"), ("nan", ""), ("12.50", "12.5"), ("-0.50", "-0.5"), (".5", "0.5"), ("123456789012345678901", "123456789012345678901"), (None, "")]
    check(spark, rows, "string", t.merge_key)


def test_data_values(spark):
    rows = [("12.5", True), ("<0.01", True), ("n.d.", True), ("Na", False), ("SiO2", False), ("12.34 ± 0.56", True), ("12.34(56)", True), ("ppm", False), ("Sample A", False), ("", False), ("1σ", True), ("NA", True), (None, False), ("1.2e-4", True), ("5%", False)]
    check(spark, rows, "boolean", t.is_data_value)


def test_numbers_keep_codes(spark):
    rows = [("1,234.5", 1234.5), ("007", None), ("1234567890123456", None), ("12f", None), ("1e3", 1000.0), ("", None), (None, None), ("-0.5", -0.5)]
    check(spark, rows, "double", t.guarded_number)
    check(spark, [("12", "int"), ("1.0", "float"), ("007", "text"), (" ", "empty"), (None, "empty")], "string", t.number_kind)


def test_formulas(spark):
    check(spark, [("=1+1", "'=1+1"), ("-5", "-5"), ("@x", "'@x"), ("-001", "'-001"), ("ok", "ok"), (None, None)], "string", t.escape_formula)


def test_ids(spark):
    check(spark, [("10.48550/arXiv.2301.12345", "2301.12345"), ("https://arxiv.org/html/2301.12345v1", "2301.12345v1"), ("https://ar5iv.labs.arxiv.org/html/2301.12345", "2301.12345"), ("arXiv:2301.12345", "2301.12345"), ("math/0211159", "math/0211159"), ("x", None)], "string", t.arxiv_id)
    check(spark, [("see pmc1234567.", "PMC1234567"), ("PMC12", None)], "string", t.pmc_id)
    check(spark, [("https://doi.org/10.1000/ab.c).", "10.1000/ab.c)"), ("none", None)], "string", t.doi)


def test_urls(spark):
    check(spark, [("https://www.nature.com/x", "springer"), ("https://kns.cnki.net/a", "cnki"), ("", "none"), (None, "none"), ("http://a.org/b", "general"), ("https://x.wiley.com", "wiley")], "string", t.publisher)
    check(spark, [("https://a.b/c.PDF?x=1", True), ("https://a.b/c", False)], "boolean", t.looks_like_pdf)
    check(spark, [("https://10.1000/x", "https://doi.org/10.1000/x"), ("https://pubs.acs.org/doi/abs/10.1/y", "https://pubs.acs.org/doi/full/10.1/y"), ("https://a.b/doi/abs/1", "https://a.b/doi/abs/1")], "string", t.full_text_url)


def test_markup_noise(spark):
    check(spark, [("$\\mathrm{SiO}_{2}$", "SiO₂"), ("a \\pm b", "a ± b"), ("  x  y \n z ", "x y\nz"), ("10^{3}", "10³")], "string", t.clean_markup_noise)
    check(spark, [("SiO₂ (wt%)", "sio2"), ("2σ err", "2sigmaerr"), ("Age (Ma)", "age")], "string", t.column_key)


def test_page_ranges(spark):
    df = spark.createDataFrame([("1-3,5", ), ("2,2,1",), ("x",)], "raw string").select(t.parse_page_ranges(F.col("raw")).alias("p"))
    assert [r.p for r in df.collect()] == [[0, 1, 2, 4], [0, 1], []]


@pytest.mark.parametrize(("text", "want"), [("Table S3", True), ("Appendix 2", True), ("SI Table 1", True), ("Si_ppm", False), ("Samples S1-S5", False), ("S1", True), ("附表 1", True), ("Table 3", False)])
def test_supplementary(spark, text, want):
    check(spark, [(text, want)], "boolean", t.is_supplementary)


def numbers_of(text):
    """N3 in plain Python."""
    s = re.sub(r"(?<=\d),(?=\d)", "", text or "")
    s = re.sub(r"(?<=\d)\s*[-–~至到]\s*(?=\d)", " ", s)
    return [f"{float(x):g}" for x in re.findall(r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?", s)]


def number_texts():
    rng = np.random.default_rng(3)
    texts = ["1,234.5", "-5 +7", "1e-3", "10-20", "10 – 20", "3~4 5至6 7\u00a0到\u30008", "1,2,3", "-0 -0.0 +0", "1e999 -1e999 1e-999 -1e-999", "99999.95 999999.5 0.0001 0.00001", "１２.5", "a1b2-3", "", None, "x", "4111 1111-1111"]
    texts += [" ".join(str(n) for n in rng.integers(10**k, 10 ** (k + 1), 40)) for k in range(18)] + ["9" * n for n in range(14, 60)]
    # seven digits that end in 5: the double's own side of the middle decides, half to even
    return texts + [" ".join(f"{n}5"[:k] + "." + f"{n}5"[k:] for n in rng.integers(100_000, 999_999, 60)) for k in range(1, 7)] + [" ".join(f"{n}5e{k}" for n in rng.integers(100_000, 999_999, 30)) for k in range(-20, 16)]


def test_numeric_tokens_are_those_of_plain_python(spark, tmp_path):
    texts = number_texts()
    rows = spark.createDataFrame([(str(i % 3), x) for i, x in enumerate(texts)], "source string, text string")
    got = rows.select("text", t.numeric_tokens(F.col("text")).alias("got")).collect()
    assert all((r.got or []) == numbers_of(r.text) for r in got), [(a, b) for r in got for a, b in zip(r.got or [], numbers_of(r.text), strict=False) if a != b][:5]
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter((str(i % 3), x) for i, text in enumerate(texts) for x in numbers_of(text))
    assert {(r.source, r.value): r.n for r in QUERIES["q80_all_numeric_tokens"](spark, str(tmp_path)).collect()} == want
