"""The cases with a stated expectation: forms, compatibility, brands, companies, packs."""

import pytest
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import rules

FORMS = [("PAN 40 TAB", "solid_oral"), ("AUGMENTIN INJ 1.2GM", "injectable"), ("CALPOL SYRUP 60ML", "liquid_oral"), ("BETADINE CREAM 20GM", "topical"), ("ASTHALIN INHALER", "inhaler_respiratory"), ("CIPRODEX EAR DROPS", "eye_ear_nasal"), ("PAN 40", "")]
COMPATIBLE = [("PAN 40 TAB", "PAN 40 TAB", True), ("PAN 40 TAB", "PAN INJ", False), ("CALPOL TAB", "CALPOL SYRUP", False), ("BETADINE CREAM", "BETADINE INJ", False), ("ASTHALIN INH", "ASTHALIN TAB", False), ("PAN 40", "PAN 40 TAB", True), ("PAN 40 TAB", "PAN 40 TABLET", True)]
BRANDS = [("augmentin", "amoxyclav", True), ("crocin", "paracetamol", True), ("crocin", "dolo", True), ("pan", "pantop", True), ("pan", "omez", False), ("ecosprin", "aspirin", True), ("azithral", "azee", True), ("randomdrug", "otherdrug", False)]
COMPANIES = [("DR REDDY", "Hetero", False), ("DR REDDY", "DR. REDDYS LABORATORIES", True), ("DR.REDDY'S", "DR REDDY", True), ("CADILA", "ZYDUS CADILA HEALTHCARE", True), ("ZYDUS CADILA", "CADILA PHARMACEUTICALS", True), ("ABBOTT INDIA LTD", "ABBOTT", True), ("HETERO HEALTHCARE", "HETERO", True), ("WALLACE", "WALLACE PHARMA", True), ("", "Hetero", True), ("DR REDDY", "", True), ("--", "WALLACE", True), ("SERDIA", "SERDIA PHARMACEUTICALS", True), ("DR MOREPEN", "DR REDDY", False)]
PACKS = [("strip of 10 tablets", "10", "tab"), ("bottle of 100 ml Syrup", "100", "ml"), ("tube of 20 gm Cream", "20", "gm"), ("10S", "10", "tab"), ("10 S", "10", "tab"), ("S10", "10", "tab"), ("100ML", "100", "ml"), ("1*15", "15", "tab"), ("3*10 TAB", "10", "tab"), ("1PS", "1", "pc"), ("4 TAB", "4", "tab"), ("1*15G", "15", "gm"), ("", "", "")]


def test_forms(spark):
    df = spark.createDataFrame(FORMS, "t string, e string")
    assert df.filter(T.form("t") != F.col("e")).collect() == []


def test_form_compatibility(spark):
    df = spark.createDataFrame(COMPATIBLE, "a string, b string, e boolean")
    assert df.filter(rules.forms_compatible("a", "b") != F.col("e")).collect() == []


def test_brand_equivalence(spark):
    df = spark.createDataFrame(BRANDS, "a string, b string, e boolean")
    assert df.filter(rules.brands_equivalent("a", "b") != F.col("e")).collect() == []


def test_companies(spark):
    df = spark.createDataFrame(COMPANIES, "a string, b string, e boolean")
    # DR MOREPEN and DR REDDY share only the short word DR, and their letters are unlike
    assert [tuple(r) for r in df.withColumn("got", rules.companies_compatible("a", "b")).filter("got != e").collect()] == []


def test_packs(spark):
    df = spark.createDataFrame(PACKS, "t string, q string, u string").withColumn("p", T.pack("t"))
    assert df.filter("p.qty != q or p.unit != u").collect() == []


@pytest.mark.parametrize(
    "fn,text,want",
    [
        (T.search_form, "RS-PAN40 TAB", "rs pan 40"),
        (T.match_form, "001 PAN 40 TAB", "pan 40"),
        (T.match_form, "36 D CAPS", "36 d"),
        (T.old_match_form, "36 D CAPS", "d"),
        (T.raw_query, "DOLO650. TAB", "DOLO 650 TAB"),
        (T.browser_form, "DOLO-650 1.5 TAB", "dolo 650 15"),
        (T.strength, "AUGMENTIN 500/125MG TAB", "500/125MG"),
        (T.strength, "PAN 40", "40"),
        (T.strength, "PAN 8", ""),
        (T.strength, None, ""),
        (T.without_thoughts, "<think>\nno\n</think>\n\nyes", "yes"),
        (T.company, "ABBOTT INDIA LTD", "abbott"),
        (T.company, "Pharma Ltd", "pharma ltd"),
    ],
)
def test_text(spark, fn, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(fn("t")).first()[0] == want


def test_numbers(spark):
    df = spark.createDataFrame([("PAN 40MG 10 TAB 1 2MG 2.50",)], "t string")
    assert sorted(df.select(T.dose_numbers("t")).first()[0]) == ["2", "2.5", "40"]
