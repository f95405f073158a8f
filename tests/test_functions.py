import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayline.functions import dates, fuzzy, lexical, numeric, units
from assayline.operators import readout


def column(spark, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r.v for r in df.select("i", expr(F.col("t")).alias("v")).orderBy("i").collect()]


def plain_label(s):
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.category(c).startswith("M"))
    return " ".join(s.lower().replace("ς", "σ").split())


LABELS = ["Αιμοσφαιρίνη  (HGB)", "ΟΥΡΙΑΣ", "Έως 200", "µg μg", "É à ü ß ñ", "x10³/µL", "", "  a\tb ", "ΐΰώ", "Ångström"]


def test_label_forms_agree(spark):
    assert column(spark, LABELS, lexical.normalise_label) == [plain_label(x) for x in LABELS]
    rare = ["ﬁ①", "½ ĳ ŉ ǆ", "℃ № ™ … ﬀ", "Ｈｂ", "𝐀𝔹", "Йод", "한", "ſ", "a\u0301b", "㎎/㎗", "ﷺ"]
    assert column(spark, rare[:6] + rare[7:], lexical.normalise_label) == [plain_label(x) for x in rare[:6] + rare[7:]]


def test_every_character_of_the_tables_folds_alike(spark):
    chars = [c for c in lexical._FROM + "".join(lexical._LONGER) if not c.isspace()]
    assert column(spark, ["a" + c + "b" for c in chars], lexical.normalise_label) == [plain_label("a" + c + "b") for c in chars]


def test_abbreviations_fold_look_alikes(spark):
    assert column(spark, ["(ΜΟΝΟ%)", "( HGB )", "ΝΕUT#"], lexical.normalise_abbreviation) == ["(mono%)", "(hgb)", "neut#"]
    assert [lexical.fold_abbreviation(t) for t in ("(ΜΟΝΟ%)", "( HGB )", "ΝΕUT#")] == ["(mono%)", "(hgb)", "neut#"] and [lexical.fold_label(x) for x in LABELS] == [plain_label(x) for x in LABELS]


def test_identifiers(spark):
    t = ["id 01018099901 and Χ01018099901", "0101809990123", "mail a.b@c.gr or x@y", "call 2101234567 or +30 6971234567, 697 123 4567", "nothing"]
    got = column(spark, t, lexical.identifiers)
    assert [[(f.kind, f.found) for f in r] for r in got[:3]] == [[("national-id", "01018099901")] * 2, [], [("email", "a.b@c.gr")]]
    assert [f.kind for f in got[3]] == ["phone"] * 3 and got[4] == []


def test_scrub_touches_only_what_holds_a_finding(spark):
    df = spark.createDataFrame([("a  b", ["x"]), ("a x  b x", ["x"]), ("x", ["x"])], "t string, f array<string>")
    assert [r.v for r in df.select(lexical.scrub(F.col("t"), F.col("f")).alias("v")).collect()] == ["a  b", "a b", ""]


@pytest.mark.parametrize("text,want", [("6,93", (6.93, None, False)), ("≤5", (5.0, "<=", False)), ("< 1.03", (1.03, "<", False)), ("1.234", (1.234, None, True)), ("0.123", (0.123, None, False)), ("1e5", None), ("<=3", None), ("", None)])
def test_numbers(spark, text, want):
    got = column(spark, [text], numeric.parse_number)[0]
    assert (got and tuple(got)) == want


def test_ranges(spark):
    text = ["4.0 - 11.0", "4,5–5,9", "10 — 2", "< 5", "≤5.5", ">= 60", "<= 3", "> 1,2", "Έως 200", "έως200", "μέχρι 35", "7", "-2 - 3", "<1 - 2", "4 - 5 foo"]
    want = [("closed", 4.0, 11.0, None), ("closed", 4.5, 5.9, None), None, ("maxOnly", None, 5.0, "<"), ("maxOnly", None, 5.5, "<="), None, None, ("minOnly", 1.2, None, ">"),
            ("maxOnly", None, 200.0, "<="), None, ("maxOnly", None, 35.0, "<="), None, ("closed", -2.0, 3.0, None), None, None]
    assert [r and tuple(r) for r in column(spark, text, numeric.parse_range)] == want
    assert [readout.interval(t.split()) for t in text] == want


def test_units_fold_alike(spark):
    text = ["mg/dl", " mg / dL", "μmol/l", "k/μl", "Κ/μL", "Μ/μl", "gr/dl", "fl", "x10^3/μL", "%", "u/L", "k/ml", "foo l"]
    assert column(spark, text, units.normalise_unit) == [units.fold_unit(t) for t in text]


def test_dates(spark):
    got = column(spark, ["31-12-2024", "31-02-2024", "1-2-2024", " 01-01-2020 ", "2024-01-01", "29-02-2024"], dates.parse_document_date)
    assert [str(d) if d else None for d in got] == ["2024-12-31", None, None, "2020-01-01", None, "2024-02-29"]


def full_osa(a, b):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9), st.integers(-1, 4))
def test_bounded_osa(a, b, bound):
    assert fuzzy.osa(a, b, bound) == min(full_osa(a, b), max(0, bound) + 1)


def test_osa_inside_the_jvm(spark):
    rng, rows = random.Random(0), [(None, "a", 1), ("a", None, 1)]
    for _ in range(400):
        a = [rng.choice("abcdé") for _ in range(rng.choice([0, 1, 2, 5, 8, 20, 61, 62, 70]))]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, max(0, len(b) - 2))
            b[at:at + 2] = rng.choice([b[at:at + 2][::-1], b[at:at + 1], [*b[at:at + 2], "x"], ["y", *b[at + 1:at + 2]]])
        rows.append(("".join(a), "".join(b), rng.randint(-1, 4)))
    df = spark.createDataFrame(rows, "a string, b string, n int")
    got = df.select("a", "b", "n", fuzzy.osa_distance(F.col("a"), F.col("b"), F.col("n")).alias("d"))
    assert all(r.d == (None if r.a is None or r.b is None else fuzzy.osa(r.a, r.b, r.n)) for r in got.collect())
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_conversion_divides_back(spark):
    c = units.conversions(spark).where("marker_key = 'glucose'").collect()
    assert {(r.from_unit, r.to_unit, r.forward) for r in c} == {("mg/dL", "mmol/L", True), ("mmol/L", "mg/dL", False)}
    v = spark.range(1).select(units.convert(F.lit(5.0), F.lit(0.05551), F.lit(False)).alias("v")).first().v
    assert v == 5 / 0.05551


@pytest.mark.parametrize("tokens,known,want", [
    (["6,90", "3,9", "-", "10,5"], True, (6.9, None, ("closed", 3.9, 10.5, None), [])),
    (["0,9", "<5"], True, (0.9, None, ("maxOnly", None, 5.0, "<"), [])),
    (["<1.03", "0-5"], True, (1.03, "<", ("closed", 0.0, 5.0, None), [])),
    (["<", "1.03"], False, (1.03, "<", None, ["ambiguous-role"])),
    (["1.234"], True, (1.234, None, None, ["ambiguous-thousands"])),
    (["7", "10", "-", "2"], True, (7.0, None, None, ["unparsed-range"])),
    (["5", "Έως", "200"], True, (5.0, None, ("maxOnly", None, 200.0, "<="), [])),
    (["10", "-", "2", "<5"], False, (None, None, None, ["unparsed-range"])),
    (["10", "-", "2", "4", "-", "5"], True, (None, None, None, ["unparsed-range"])),
    (["4", "-", "5", "10", "-", "2"], True, (None, None, ("closed", 4.0, 5.0, None), [])),
    (["7", "4.0", "-", "10.0", "foo"], True, (7.0, None, None, ["unparsed-range"])),
    (["7", "4.0", "-", "10.0", "k/μl"], True, (7.0, None, ("closed", 4.0, 10.0, None), [])),
    (["<", "1.03", "mg/L", "<", "5"], False, (1.03, "<", ("maxOnly", None, 5.0, "<"), [])),
    (["3-5", "<", "1.03"], False, (1.03, None, None, ["unparsed-range"])),
    (["12,345"], False, (12.345, None, None, ["ambiguous-thousands"]))])
def test_roles(tokens, known, want):
    got = readout.roles(tokens, known)
    assert (got.value, got.comparator, got.bounds, got.flags) == want


def test_regions_bound_tails_and_units():
    got = readout.roles(["3-5", "<", "1.03"], False, [1, 2, 2])
    assert (got.value, got.bounds, got.flags) == (None, ("closed", 3.0, 5.0, None), [])
    assert readout.roles(["5", "mg", "/", "dL", "x"]).unit == "mg / dL" and readout.roles(["5", "mg/dL"], False, [1, 2]).unit is None
    assert readout.roles(["5", "foo", "bar"]).unit == "foo" and readout.split_glued("5,5mg/dL") == ["5,5", "mg/dL"] and readout.split_glued("5%") == ["5", "%"]


def test_registry_faults(tmp_path):
    import json

    from assayline.functions import registry

    assert registry.faults(registry.MARKERS) == []
    bad = [registry.Marker("a b", "A"), registry.Marker("x", " X"), registry.Marker("x", "Y", aliases=["a"]), registry.Marker("z", "Z", unit="mg/dl"), registry.Marker("w", "W", plausible=(2, 1))]
    assert [f.split(":")[0] for f in registry.faults(bad)] == ["a b", "x", "x", "x", "z", "w"]
    (tmp_path / "r.json").write_text(json.dumps([{"key": "crp", "en": "C-reactive protein", "unit": "mg/L", "plausible": [0, 1000]}]))
    assert registry.load(str(tmp_path / "r.json"))[0].plausible == (0, 1000)
    (tmp_path / "r.json").write_text(json.dumps([{"key": "crp", "en": "", "unit": "mg/L"}]))
    with pytest.raises(ValueError):
        registry.load(str(tmp_path / "r.json"))


def test_categorical_and_missing():
    assert readout.read(["Αρνητικό"], [True], False)[2:11:8] == ("Αρνητικό", "categorical")
    assert readout.read(["Αρνητικό", "<10", "x"], [True] * 3)[10] == "value" and readout.read(["Ίχνη", "Αρνητικό"], [True, False])[2:4] == ("Ίχνη", "Αρνητικό")
    assert readout.read(["%"], [False])[10] == "missing"
    assert readout.read(["-"], [True], False)[10] == "missing" and readout.read([], [], True)[10] == "missing"
