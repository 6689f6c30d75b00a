"""Table-driven cases of the cleaning, phonetic and similarity functions."""

from datetime import date

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from kinweave.functions import fields as C, phonetic, similarity as S, text as T


def values(spark, rows, expression):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, v string" if not isinstance(rows[0], tuple) else "i int, v string, w string")
    return [r[0] for r in df.select(expression.alias("x"), "i").orderBy("i").select("x").collect()]


@pytest.fixture(autouse=True)
def columns(spark):
    globals().update(V=F.col("v"), W=F.col("w"))  # columns need a session


def test_text(spark):
    assert values(spark, ["José Müller", "Straße", "Ærø", "日本x", None], T.to_ascii(V)) == ["Jose Muller", "Strasse", "AEro", "x", None]
    assert values(spark, ["maryAnn", "McDonald"], T.split_camel(V)) == ["mary Ann", "Mc Donald"]
    assert values(spark, ["007 OAK", "0 OAK", "000", "OAK 007"], T.strip_leading_zeros(V)) == ["7 OAK", "0 OAK", "0", "OAK 007"]
    assert values(spark, [" a \t b ", ""], T.collapse(V)) == ["a b", ""]


def test_names(spark):
    got = values(spark, ["Dr  joséMaria  Iii", "unknown", "ID4567", "12345", "Baby Boy Lee", "test", "Mary-Ann O'Neil", "", None, "DO NOT USE"], C.first_name(V))
    assert [(r.value, r.invalid, r.suffix) for r in got] == [
        ("JOSE MARIA", False, "III"), (None, False, None), ("ID", True, None), (None, True, None), ("BABY BOY LEE", True, None), ("TEST", True, None),
        ("MARY-ANN O'NEIL", False, None), (None, False, None), (None, False, None), ("DO NOT USE", True, None),
    ]
    assert [r.value for r in values(spark, ["Dr Who", "Oakley Jr", "V"], C.last_name(V))] == ["DR WHO", "OAKLEY", "V"]
    assert [r.value for r in values(spark, ["NMI", "-", "Q.", "n/a"], C.middle_name(V))] == [None, None, "Q", None]
    assert values(spark, ["Jr.", "3rd", "esq", None, "iv"], C.suffix(V)) == ["JR", "III", None, None, "IV"]


def test_dates(spark):
    got = values(spark, ["1900-01-01", "1900-01-02", "3/4/1985", "Mar 4, 1985", "2026-01-01", "2026-01-02", "soon", None], C.birth_date(V, date(2026, 1, 1)))
    assert got == [None, date(1900, 1, 2), date(1985, 3, 4), date(1985, 3, 4), date(2026, 1, 1), None, None, None]


@pytest.mark.parametrize(
    "raw, clean",
    [("219-09-9999", None), ("536-22-8145", "536228145"), ("36228145", "036228145"), ("123456789", None), ("987654321", None), ("000-12-3456", None), ("666-12-3456", None), ("912-34-5678", None), ("536-00-8145", None), ("536-22-0000", None), ("111-11-1112", None), ("12", None), (None, None), ("536536536", None)],
)
def test_government_id(spark, raw, clean):
    df = spark.createDataFrame([(raw,)], "v string")
    assert df.select(C.government_id(V)).first()[0] == clean


def test_contacts(spark):
    assert values(spark, ["1 (312) 662-1234", "312-555-0142", "555-662-1234", "211-662-1234", "312-162-1234", "3126621234x", None], C.phone(V)) == ["3126621234", None, None, None, None, "3126621234", None]
    assert values(spark, [" A.Lee @Mail.Test2 ", "noemail@x.yz", "ab@x.yz", "nope", "lee@example.com", "test1@x.yz", None], C.email(V)) == ["a.lee@mail.test2", None, None, None, None, None, None]
    assert [(r.base, r.ext) for r in values(spark, ["2139", "60601-1234", "99999", "12345", "123", None], C.postal_code(V))] == [("02139", None), ("60601", "1234"), (None, None), (None, None), (None, None), (None, None)]
    assert values(spark, ["illinois", "IL", "5", "36", "zz", "na", None], C.state(V)) == ["IL", "IL", "CA", "OH", None, None, None]
    assert [(r.value, r.invalid) for r in values(spark, ["00012 north MAIN Street", "Homeless", "?", "do not use"], C.address_line1(V))] == [("12 N MAIN ST", False), (None, False), (None, False), ("DO NOT USE", True)]
    assert values(spark, ["Male", "x", "other"], C.sex(V)) == ["MALE", None, "OTHER"]
    assert values(spark, ["{'b', 'a'}", "[1,2]", "set()", ""], C.parse_value_set(V)) == [["a", "b"], ["1", "2"], [], []]


def test_clean_records(spark):
    rows = [("1", "Ann", "Lee", "536-22-8145", "60601", "CA"), ("2", "baby boy", None, None, "60601", "IL"), ("3", None, "", None, None, None)]
    got = {r["rec_id"]: r for r in C.clean_records(spark.createDataFrame(rows, "rec_id string, first string, last string, gov_id string, postal string, state string"), date(2026, 1, 1)).collect()}
    assert (got["1"]["is_valid"], got["1"]["postal"], got["1"]["state"], got["1"]["gov_id4"]) == (True, None, None, "8145")
    assert not got["2"]["is_valid"] and got["2"]["postal"] == "60601" and not got["3"]["is_valid"]
    again = C.raw_names(C.raw_names(spark.createDataFrame(rows, "rec_id string, first string, last string, gov_id string, postal string, state string")))
    assert "first_raw" in again.columns and "first_raw_raw" not in again.columns


@pytest.mark.parametrize("a, b", [("SMITH", "SMYTH"), ("GARCIA", "GARSIA"), ("JOHNSON", "JONSON"), ("SCHMIDT", "SHMIDT"), ("THOMPSON", "TOMPSON"), ("GONZALEZ", "GONZALES"), ("SANCHEZ", "SANCHES")])
def test_double_metaphone_variants(a, b):
    assert phonetic.double_metaphone(a) == phonetic.double_metaphone(b)


def test_phonetics(spark):
    assert phonetic.double_metaphone("THOMPSON") == "TMPSN" and phonetic.double_metaphone("KNIGHT") == "NT" and phonetic.double_metaphone("") is None
    assert phonetic.metaphone("KNIGHT") == "NT" and phonetic.metaphone("PHILLIPS") == "FLPS"
    assert len({phonetic.double_metaphone(n) for n in ("SMITH", "GARCIA", "CHEN", "PATEL")}) == 4
    assert values(spark, ["ROBERT", "RUPERT", "", None, "MICHAEL", "MIKHAIL"], phonetic.soundex(V)) == ["R163", "R163", None, None, "M240", "M240"]


@settings(max_examples=200, deadline=None)
@given(st.text("ABCD", max_size=8), st.text("ABCD", max_size=8))
def test_jaro_winkler_against_duckdb(a, b):
    import duckdb

    if a and b:
        assert S.jaro_winkler(a, b) == pytest.approx(duckdb.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0], abs=1e-9)


def test_similarity(spark):
    near = values(spark, [("MEAGAN", "MEGAN"), ("GARCIA", "GRACIA"), ("ABCD", "BADC"), ("A", "B"), ("", ""), ("A", None)], S.within_one_edit(V, W))
    assert near == [True, True, False, True, True, None]
    assert values(spark, [("abc", "abd"), ("", ""), (None, "a")], S.levenshtein_similarity(V, W)) == [pytest.approx(2 / 3), 1.0, None]
    assert values(spark, [("12345", "12945"), ("12", "1234")], S.digit_agreement(V, W)) == [0.8, 0.5]
    assert values(spark, [("a", "a"), ("a", "b"), (None, "b")], S.same_or_missing(V, W)) == ["same", "different", "missing"]
    assert values(spark, [("1980-03-04", "1980-04-03"), ("1980-03-04", "1980-03-05"), (None, "1980-01-01")], S.dates_match(V.cast("date"), W.cast("date"))) == [True, False, False]
