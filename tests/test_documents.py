import random

from pyspark.sql import functions as F

from assayline.functions.registry import MARKERS, names
from assayline.operators import extract, intake, layout, match, profile


def brute_rows(items):
    out, open_row = [], []
    for it in items:
        if open_row and any(abs(it["y"] + it["h"] / 2 - m["y"] - m["h"] / 2) < 0.6 * min(it["h"], m["h"]) for m in open_row):
            open_row.append(it)
        else:
            open_row = [it]
            out.append(open_row)
    return [n for n, r in enumerate(out, 1) for _ in r]


def test_row_sweep(spark):
    rng, rows = random.Random(1), []
    for page in range(1, 201):
        items = sorted(({"x": rng.random(), "y": rng.random() * 0.1, "w": 0.1, "h": rng.choice([0.01, 0.014, 0.03])} for _ in range(15)), key=lambda i: (i["y"], i["x"]))
        rows += [("s", page, n, f"t{n}", i["x"], i["y"], i["w"], i["h"], no) for n, (i, no) in enumerate(zip(items, brute_rows(items)))]
    df = spark.createDataFrame(rows, "source_id string, page int, item int, text string, x double, y double, w double, h double, want int")
    got = {(r.page, r.item): r.row_no for r in layout.cluster_rows(df).collect()}
    before = 0
    for page in range(1, 201):
        want = {r[2]: before + r[8] for r in rows if r[1] == page}
        assert {i: got[page, i] for i in want} == want
        before = max(want.values())


LINE = 0.0141


def document(rows, source="d"):
    """Items of a valid document whose table has the given rows: (label parts, value, unit, range), a part being text or (text, x, below)."""
    items = [(1, extract.TITLE, 0.283, 0.119, 0.3)]
    for i, m in enumerate(extract.METADATA):
        items += [(1, f"{m}:", 0.131, 0.2 + 0.02 * i, 0.1), (1, {extract.COLLECTED: "05-03-2024", extract.RESULTED: "07-03-2024"}.get(m, "A1"), 0.371, 0.2 + 0.02 * i, 0.1)]
    x = {"label": 0.131, "value": 0.3837, "unit": 0.5101, "range": 0.6364, "notes": 0.7628}
    items += [(2, h, x[r], 0.12, 0.1) for r, h in extract.HEADINGS.items()]
    for i, (label, *cells) in enumerate(rows):
        y = 0.16 + 0.04 * i
        for part in label if isinstance(label, list) else [label]:
            text, left, down = part if isinstance(part, tuple) else (part, x["label"], 0.0)
            items += [(2, text, left, y + down, 0.1)] if text else []
        items += [(2, c, x[r], y, 0.05) for r, c in zip(("value", "unit", "range"), cells) if c]
    return [(source, page, n, text, left, top, w, LINE) for n, (page, text, left, top, w) in enumerate(items, 1)]


ITEMS = "source_id string, page int, item int, text string, x double, y double, w double, h double"


def test_an_english_layout(spark):
    rows = [("Haemoglobin (HGB)", "13,4", "g/dL", "12 - 16"), (["RBC", ("WBC", 0.25, 0.0)], "5", "10^3/µL", "4 - 10"), ("Haemoglobin Platelets", "", "", "9 - 9"), ("Glucose", "<70", "mg/dL", ""),
            ("Unheard of", "7", "", ""), ("", "8", "mg/dL", ""), ("just words", "and more", "", ""), ("Platelets", "-", "%", ""), ("PCT MPV", "1.234", "", "x")]
    got = extract.parse(spark.createDataFrame(document(rows), ITEMS)).orderBy("source_order").collect()
    assert [(r.marker_key, r.status, r.value, r.confidence, r.flags) for r in got] == [
        ("haemoglobin", "value", 13.4, "high", []), ("rbc", "missing", None, "low", ["competing-anchor"]), ("wbc", "value", 5.0, "medium", ["competing-anchor"]),
        ("haemoglobin", "missing", None, "low", ["competing-anchor"]), ("plt", "missing", None, "low", ["competing-anchor"]), ("glucose", "value", 70.0, "medium", []), ("x:unheard-of", "value", 7.0, "low", []),
        ("plt", "missing", None, "low", []), ("pct", "value", 1.234, "low", ["ambiguous-thousands", "competing-anchor"]), ("mpv", "value", 1.234, "low", ["ambiguous-thousands", "implausible-value", "competing-anchor"])]
    first = got[0]
    assert (str(first.collected_date), str(first.result_date), first.source_order) == ("2024-03-05", "2024-03-07", 0)
    assert len(first.item_ids) == 3 and first.box_left == 0.131 and first.box_right == 0.6364 + 0.05 and first.text_start is None  # marker, value and range; the unit has its column
    assert (got[2].comparator, got[5].comparator) == (None, "<") and (got[1].text_start, got[1].text_end) == (0, 3) and (got[4].text_start, got[4].text_end) == (12, 21)


def test_a_greek_layout_with_wrapped_labels_and_sections(spark):
    wrapped = lambda a, b: [(a, 0.131, -0.0065), (b, 0.131, 0.0065)]
    rows = [("Γενική αίματος", "", "", ""), (wrapped("Ερυθρά", "αιμοσφαίρια(RBC)"), "4,5", "10^6/µL", "4 - 6"), (wrapped("Άγνωστος", "δείκτης"), "3", "%", ""), ("Βιοχημικές", "", "", ""), ("Σάκχαρο", "Ίχνη", "", "Αρνητικό"),
            (wrapped("Non - HDL - C", "(Non - HDL - C)"), "100", "mg/dL", "")]
    got = extract.parse(spark.createDataFrame(document(rows), ITEMS)).orderBy("source_order").collect()
    assert [(r.marker_key, r.label, r.tier, r.section, r.status) for r in got] == [
        ("rbc", "(RBC)", "T1", "Γενική αίματος", "value"), ("x:αγνωστοσ-δεικτησ", "Άγνωστος δείκτης", None, "Γενική αίματος", "value"), ("glucose", "Σάκχαρο", "T2", "Βιοχημικές", "categorical"),
        ("x:non-hdl-c-non-hdl-c", "Non - HDL - C (Non - HDL - C)", None, "Βιοχημικές", "value")]
    assert (got[2].text_value, got[2].categorical_reference, got[2].unit) == ("Ίχνη", "Αρνητικό", None)


def test_rejected_and_empty_documents_give_no_rows(spark):
    damaged = [r for r in document([("Glucose", "5", "mg/dL", "")]) if r[3] != extract.TITLE]
    assert extract.parse(spark.createDataFrame(damaged, ITEMS)).count() == 0
    assert extract.parse(spark.createDataFrame([], ITEMS)).count() == 0


def test_contained_by_automaton_and_by_words_agree(spark):
    rng = random.Random(5)
    words = ["alpha", "béta", "gamma", "de lta", "e", ""]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) if i % 9 else None) for i in range(200)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))) for i in range(40)] + [(99, None)], "item_id int, alias string")
    rows = lambda most: sorted(tuple(r) for r in match.contained(docs, items, most).collect())
    norm = lambda t: " ".join((t or "").replace("é", "e").split())
    want = sorted((d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if norm(i.alias) and f" {norm(i.alias)} " in f" {norm(d.text)} ")
    assert rows(1 << 20) == rows(0) == want and want


def test_nearest_names_need_no_nested_loop(spark):
    from assayline.functions import fuzzy

    rng = random.Random(6)
    text = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(3, 9)))
    texts, known = sorted({text() for _ in range(150)}), sorted({text() for _ in range(40)})
    a, b = spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(t,) for t in known], "k string")
    near = match.nearest(a, b, "t", "k")
    bound = lambda t: 0 if len(t) < 5 else 1 if len(t) <= 7 else 2
    assert {tuple(r) for r in near.collect()} == {(t, k, fuzzy.osa(t, k, bound(t))) for t in texts for k in known if fuzzy.osa(t, k, bound(t)) <= bound(t)}
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_registry_names_are_unique(spark):
    n = names(spark)
    assert n.groupBy("kind", "norm").agg(F.countDistinct("marker_key").alias("n")).where("n > 1").count() == 0
    assert len(MARKERS) == n.select("marker_key").distinct().count()


def test_greedy_and_overlay(spark):
    s = spark.createDataFrame([(1, 0, 5, "a"), (1, 0, 2, "b"), (1, 5, 6, "a"), (1, 6, 7, "b")], "row int, start int, stop int, marker string")
    assert {(r.start, r.marker) for r in match.greedy(s, "row").collect()} == {(0, "a"), (6, "b")}
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "id int, v string")
    assert {tuple(r) for r in profile.overlay(a, b, "id").collect()} == {(1, "x", "kept"), (2, "z", "updated"), (3, "w", "added")}
    assert {r.id: r.outcome for r in profile.merge_plan(a, b, "id").collect()} == {2: "report-id", 3: "addition"}


def test_stream_and_batch_phases_agree(spark, tmp_path):
    from assayline.streaming import phases

    rows = [(c, t, random.Random(c * 7 + t).choice([*phases.ACTIONS, "noise"])) for c in range(20) for t in range(40)]
    df = spark.createDataFrame(rows, "session long, place long, action string")
    want = {}
    for c in range(20):
        state, n = ("idle", False), 0
        for _, _, a in (r for r in rows if r[0] == c):
            if a in phases.ACTIONS:
                state, n = phases.step(*state, a), n + 1
        want[c] = (c, *state, n)
    df.write.parquet(f"{tmp_path}/in")
    stream = phases.follow(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("phases_out").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("phases_out").collect()} == {tuple(r) for r in phases.fold(df).collect()} == set(want.values())


def test_long_sessions_fold_in_pieces(spark, monkeypatch):
    from assayline.streaming import phases

    df = spark.createDataFrame([(1, i, phases.ACTIONS[i * 5 % 11]) for i in range(500)], "session long, place long, action string")
    whole = phases.fold(df).collect()
    monkeypatch.setattr(phases, "PIECE", 7)
    assert phases.fold(df).collect() == whole


def test_drifting_fragments_do_not_chain_and_sources_stay_apart(spark):
    rows = [("a", 1, i, f"t{i}", 10.0 * i, 700 + 0.008 * i, 10.0, 9.0, -2.0) for i in range(4)] + [("b", 1, 4, "13", 40.0, 700.0, 10.0, 9.0, -2.0), ("b", 1, 5, "", 50.0, 700.0, 1.0, 9.0, -2.0)]
    df = spark.createDataFrame(rows, "source_id string, page int, frag int, text string, x double, baseline double, w double, ascent double, descent double")
    assert sorted((r.source_id, r.item, r.text) for r in intake.rejoin(df).collect()) == [("a", 1, "t0t1"), ("a", 2, "t2t3"), ("b", 1, "13")]


def test_sections_settle_ties(spark):
    from assayline.functions.registry import Marker

    two = [Marker("serum-albumen", "Albumen a"), Marker("urine-albumen", "Albumen b", section="Urine")]
    schema = "source_id string, row_no int, section string, items array<struct<x double, y double, item int, text string, w double, h double>>"
    rows = spark.createDataFrame([("s", i, sec, [(0.1, 0.2, 1, "Albumen c", 0.1, 0.01)]) for i, sec in enumerate(["URINE", "Blood", None])], schema)
    assert {(r.row_no, r.marker) for r in extract.anchors(rows, registry=two).collect()} == {(0, "urine-albumen")}


def test_a_share_is_never_near_a_count(spark):
    texts = ["Neutrophils #", "Lymphocytes #", "Neutrophils %", "Monocytez %"]
    rows = spark.createDataFrame([("s", i, [(0.1, 0.2, 1, t, 0.1, 0.01)]) for i, t in enumerate(texts)], "source_id string, row_no int, items array<struct<x double, y double, item int, text string, w double, h double>>")
    got = {r.row_no: (r.marker, r.tier) for r in extract.anchors(rows).collect()}
    assert got == {2: ("neutrophils-percent", "T2"), 3: ("monocytes-percent", "T4")}
