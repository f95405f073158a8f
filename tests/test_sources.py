import json
import time

import pytest
from pyspark.sql import functions as F

from assayline.sources import adapters, profile_store, text_items
from assayline.streaming import progress

COLUMNS = "report_id string, marker_key string, status string, value double, range_kind string, range_min double, range_max double"
GOOD = [("r1", "wbc", "value", 6.9, "closed", 4.0, 11.0), ("r1", "x:abc", "missing", None, None, None, None)]


def test_store_keeps_the_last_whole_version(spark, tmp_path):
    store = profile_store.ProfileStore(spark, f"file://{tmp_path}/db")
    assert store.load() is None
    store.replace(spark.createDataFrame(GOOD, COLUMNS))
    store.replace(spark.createDataFrame(GOOD[:1], COLUMNS))
    assert store.load().count() == 1 and store._versions() == [2]
    (tmp_path / "db" / "v3").mkdir()  # a write that never finished
    assert store.load().count() == 1 and store.repair() == 1 and store.repair() == 0
    with pytest.raises(ValueError, match="value-missing"):
        store.replace(spark.createDataFrame([("r2", "wbc", "value", None, None, None, None)], COLUMNS))
    assert store.load().count() == 1
    spark.createDataFrame([("r2", "", "value", 1.0, None, None, None)], COLUMNS).write.parquet(f"file://{tmp_path}/db/v9")
    with pytest.raises(ValueError):
        store.load()
    (tmp_path / "cache-1").mkdir()
    store.drop("cache-")
    assert store.load() is None and not (tmp_path / "cache-1").exists()


def test_preview_writes_nothing(spark):
    a, b = spark.createDataFrame([("1", 1), ("2", 2)], "report_id string, v int"), spark.createDataFrame([("1", 1), ("2", 3), ("4", 4)], "report_id string, v int")
    assert {r.outcome: r.n for r in profile_store.preview(a, b).collect()} == {"duplicate": 1, "report-id": 1, "addition": 1}


def _scan(name):
    item = {"id": "p1-f1", "text": "Hb", "x": 0.1, "y": 0.2, "w": 0.1, "h": 0.01}
    return {"sourceId": name, "pageCount": 1, "fragmented": {"pages": [[item, item | {"text": ""}]]}}


def test_corpus_and_adapters(spark, tmp_path):
    for split, lab in (("training", "a"), ("holdout", "b")):
        d = tmp_path / "corpus" / split / lab
        d.mkdir(parents=True)
        (d / "textitems.json").write_text(json.dumps(_scan(lab)))
        (d / "expected.json").write_text(json.dumps({"sourceId": lab, "rows": [{"markerKey": "wbc", "label": "WBC", "status": "value", "value": 5.0, "referenceRange": {"kind": "closed", "min": 1, "max": 9}}]}))
    items, expected = text_items.read_corpus(spark, f"file://{tmp_path}/corpus")
    assert {(r.split, r.laboratory, r.source_id) for r in items.collect()} == {("training", "a", "a"), ("holdout", "b", "b")}
    assert {(r.laboratory, r.marker_key, r.value, r.range_max) for r in expected.collect()} == {("a", "wbc", 5.0, 9.0), ("b", "wbc", 5.0, 9.0)}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "ok.json").write_text(json.dumps(_scan("ok")))
    (tmp_path / "in" / "bad.json").write_text("{")
    (tmp_path / "in" / "photo.jpg").write_bytes(b"\xff\xd8")
    got = {r.source_id: (r.page, r.item, r.text, r.failure) for r in adapters.read(spark, f"file://{tmp_path}/in").collect()}
    assert got == {"ok.json": (1, 1, "Hb", None), "bad.json": (None, None, None, "decode-failed"), "photo.jpg": (None, None, None, "unsupported-type")}


def test_progress_and_cancelling_between_sources(spark, tmp_path):
    done = []

    def write(name, df):
        done.append(name)
        return df.count()

    sources = [(n, spark.range(k)) for n, k in (("a", 3), ("b", 4), ("c", 5))]
    assert list(progress.each_source(spark, sources, write, cancelled=lambda: len(done) == 2)) == [("a", 0, 0), ("a", 3, 3), ("b", 0, 0), ("b", 4, 4), ("cancelled", 0, 0)]
    spark.range(5).write.parquet(f"{tmp_path}/s")
    with progress.watched(spark) as seen:
        q = spark.readStream.schema("id long").parquet(f"{tmp_path}/s").select(F.col("id")).writeStream.format("memory").queryName("progress_out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(60)
        for _ in range(50):
            if seen.ended:
                break
            time.sleep(0.1)
    assert sum(n for _, _, n in seen.events) == 5 and seen.started == seen.ended


def test_validated_profiles_name_the_first_broken_rule(spark):
    import copy
    import json

    from assayline.sources import profile_file

    def m(key, **change):
        return {"markerKey": key, "status": "value", "value": 1.5, "comparator": None, "unit": "mg/dL", "referenceRange": {"kind": "closed", "min": 1, "max": 5}, "sourceOrder": 0, **change}

    def report(id_, date="2024-02-29", time=None, ms=()):
        return {"id": id_, "collectedAt": {"date": date, "time": time, "precision": "minute" if time else "day"}, "measurements": list(ms)}

    good = {"schemaVersion": 1, "id": "p", "reports": [report("a", ms=[m("hb"), m("x:odd", label="some label", status="categorical", value=None, unit=None, referenceRange=None, textValue="traces", categoricalReference="none")]), report("b", "2024-03-01", "08:00"), report("c", "2024-03-01", "09:30")]}
    one = lambda **change: {**good, "reports": [report("a", ms=[m("hb"), m("plt", **change)])]}
    at = "profile.reports[0].measurements[1]"
    cases = {
        "good": (good, None, None), "no object": ([1], "profile", "object"), "schema": ({**good, "schemaVersion": "1"}, "profile.schemaVersion", "schema-version"), "no id": ({k: v for k, v in good.items() if k != "id"}, "profile.id", "id"),
        "reports": ({**good, "reports": {}}, "profile.reports", "array"), "report": ({**good, "reports": [5]}, "profile.reports[0]", "object"), "date": ({**good, "reports": [report("a", "2023-02-29")]}, "profile.reports[0].collectedAt.date", "date"),
        "time": ({**good, "reports": [report("a", time="24:00")]}, "profile.reports[0].collectedAt.time", "time"), "first of two": ({**good, "id": "", "reports": [report("", "x")]}, "profile.id", "id"),
        "number": (one(value="5"), f"{at}.value", "number"), "missing unit": ({**good, "reports": [report("a", ms=[{k: v for k, v in m("hb").items() if k != "unit"}])]}, "profile.reports[0].measurements[0].unit", "string"),
        "comparator": (one(comparator="="), f"{at}.comparator", "comparator"), "direction": (one(referenceRange={"kind": "minOnly", "min": 1, "comparator": "<"}), f"{at}.referenceRange.comparator", "range-direction"),
        "order": (one(sourceOrder=1.5), f"{at}.sourceOrder", "whole-number"), "words": (one(status="categorical", textValue=" "), f"{at}.textValue", "text-missing"), "unit of words": (one(status="categorical", value=None, textValue="x"), f"{at}.unit", "null-when-categorical"),
        "text": (one(textValue="x"), f"{at}.textValue", "only-when-categorical"), "missing": (one(status="missing"), f"{at}.value", "null-when-missing"), "label": (one(label="x"), f"{at}.label", "label-on-known-key"),
        "twice": ({**good, "reports": [report("a", ms=[m("hb"), m("hb")])]}, "profile.reports[0].measurements", "repeated-marker"), "same id": ({**good, "reports": [report("a"), report("a", "2024-03-01")]}, "profile.reports[1].id", "repeated-report"),
        "same time": ({**good, "reports": [report("a", time="08:00"), report("b", time="08:00")]}, "profile.reports[1].collectedAt.time", "same-time"), "same day": ({**good, "reports": [report("a", time="08:00"), report("b")]}, "profile.reports[1].collectedAt", "same-day"),
        "phone": ({**good, "reports": [report("a", ms=[m("x:a", label="call 6912345678")])]}, "profile.reports[a].measurements[x:a].label", "label-phone"), "lines": ({**good, "reports": [report("a", ms=[m("x:a", label="two\nlines")])]}, "profile.reports[a].measurements[x:a].label", "label-control-characters"),
        "many": ({**good, "reports": [report("a", ms=[m(f"k{i}") for i in range(1001)])]}, "profile.reports[0].measurements", "too-many")}
    files = [(n, json.dumps({"format": profile_file.FORMAT, "v": 1, "profile": copy.deepcopy(p)}).encode()) for n, (p, _, _) in cases.items()]
    files += [("cut", b'{"format"'), ("bytes", b"\xff{}"), ("other", b'{"format": "x"}'), ("list", b"[]"), ("later", json.dumps({"format": profile_file.FORMAT, "v": 2}).encode()), ("text version", json.dumps({"format": profile_file.FORMAT, "v": "1"}).encode())]
    got = {r.name: r for r in profile_file.read_validated(spark.createDataFrame(files, "name string, content binary"), "name").collect()}
    assert {n: (got[n].path, got[n].rule) for n in cases} == {n: (p, r) for n, (_, p, r) in cases.items()}
    assert {n: got[n].outcome for n in ("good", "many", "cut", "bytes", "other", "list", "later", "text version")} == {
        "good": "ok", "many": "invalid-profile", "cut": "not-json", "bytes": "not-utf8", "other": "not-a-profile", "list": "not-a-profile", "later": "version", "text version": "version"}


def test_what_a_report_breaks_is_told_once_not_for_each_of_its_measurements(spark):
    from assayline.operators.validate import violations

    plan = violations(spark.sql("SELECT 1 AS id, parse_json('{}') AS v FROM range(1)"), "id")._jdf.queryExecution().optimizedPlan().toString()
    spread = plan.index("Generate posexplode(measurements")
    assert "array_distinct" not in plan[:spread]
    assert "array_distinct" in plan[spread:]
