"""What surrounds editing: external plans, registries and runs, sessions and named masks, paths and checks."""

import json
import time

import pytest
from pyspark.sql import functions as F

from pixelloom.functions import names
from pixelloom.functions.codec import checksum, decode_text, encode_bytes
from pixelloom.operators import rasterize, remap
from pixelloom.operators import workspace as w
from pixelloom.plans import external, registry
from pixelloom.plans.ops import InvalidOperation, duplicated, op, plan
from pixelloom.sources import documents, selections

GOOD = {"summary": "Fine", "confidence": 0.7, "warnings": [], "operations": [{"type": "brightness", "amount": 0.1}, {"type": "denoise", "strength": 0.3, "preserve_edges": 0.8}]}


def test_external_plans(spark):
    bad = {
        "not json": "{", "order": GOOD | {"operations": GOOD["operations"][::-1]}, "twice": GOOD | {"operations": GOOD["operations"][:1] * 2}, "extra": GOOD | {"why": 1},
        "deep": GOOD | {"operations": [{"type": "brightness", "amount": 0.1, "radius": 3}]}, "range": GOOD | {"operations": [{"type": "brightness", "amount": 9}]},
        "kind": GOOD | {"operations": [{"type": "crop"}]}, "none": GOOD | {"operations": []}, "sure": GOOD | {"confidence": 2}, "blank": GOOD | {"summary": " "}, "warned": GOOD | {"warnings": ["x"] * 9},
        "grey": GOOD | {"operations": [{"type": "saturation", "amount": 0.2}, {"type": "grayscale"}]}, "missing": {"summary": "x"}, "list": [1],
    }
    rows = [("good", json.dumps(GOOD)), *((k, v if isinstance(v, str) else json.dumps(v)) for k, v in bad.items()), ("null", None)]
    got = {r.name: r for r in external.check_texts(spark.createDataFrame(rows, "name string, value string")).collect()}
    assert got["good"].valid and not got["good"].errors and json.loads(got["good"].operations)[0]["amount"] == 0.1
    assert not any(r.valid or r.operations for k, r in got.items() if k != "good")
    assert got["extra"].rejected == ["why"] and got["deep"].rejected == ["operations[0].radius"] and len(got["order"].errors) == 1
    assert external.check(json.dumps(GOOD), 1)[0] and external.check(json.dumps(GOOD), 9)[0]


def test_registry_and_runs(spark):
    r = registry.standard()
    assert r.current("engine").name == "deterministic" and r.select("engine", "packed", ["offline"]).name == "packed"
    text = r.to_json()
    again = registry.standard()
    again.restore(text)
    assert again.snapshot() == r.snapshot() and ("planner", "rules", True, ["offline"]) in r.snapshot()
    for wrong in ("{}", "[]", json.dumps({"schemaVersion": 2}), " " * 40_000):
        with pytest.raises(ValueError):
            again.restore(wrong)
    with pytest.raises(registry.Unavailable):
        r.select("engine", "packed", ["network"])
    with pytest.raises(ValueError):
        r.register("rules", "planner", print)
    assert registry.Run(spark, lambda: spark.range(10).count()).result() == 10
    slow = lambda: spark.range(0, 4, 1, 4).mapInPandas(lambda it: (time.sleep(60) or b for b in it), "id bigint").count()
    began = time.monotonic()
    with pytest.raises(registry.Cancelled):
        registry.Run(spark, slow, timeout_s=2).result()
    run = registry.Run(spark, slow)
    time.sleep(1)
    run.cancel()
    with pytest.raises(registry.Cancelled):
        run.result()
    assert time.monotonic() - began < 50


def snapshot(data, width, height):
    kind, text = encode_bytes(data)
    return {"version": 1, "width": width, "height": height, "encoding": kind, "data": text, "checksum": checksum(data)}


def test_sessions(spark):
    s, t = snapshot(bytes(range(12)), 4, 3), "2024-05-01T10:00:00Z"
    mask = {"id": "m1", "name": "Sky", "mask": s, "visible": True, "locked": False, "createdAt": t, "modifiedAt": t}
    two = selections.fresh("doc", 4, 3) | {"activeMask": s, "namedMasks": [mask], "tool": "wand", "updatedAt": t}
    assert selections.saved(two) and selections.parsed(json.dumps(two), "doc", 4, 3) == (two, "read")
    one = {"schemaVersion": 1, "documentKey": "doc", "tool": "brush", "mode": "odd", "activeMask": s | {"checksum": "x"}, "namedMasks": [mask, mask, mask | {"id": "m2"}, {"id": 3}], "panelCollapsed": True}
    state, how = selections.parsed(json.dumps(one), "doc", 4, 3)
    assert how == "migrated" and state["tool"] == "brush" and state["mode"] == "replace" and state["activeMask"] is None and [m["id"] for m in state["namedMasks"]] == ["m1", "m2"]
    wrong = [two | {"canvasWidth": 5}, two | {"namedMasks": [mask, mask]}, two | {"tool": "saw"}, two | {"updatedAt": "soon"}, {"schemaVersion": 3, "documentKey": "doc"}, two | {"documentKey": "other"}]
    rows = [("doc", 4, 3, json.dumps(v)) for v in (two, one, *wrong)] + [("doc", 4, 3, None), ("doc", 4, 3, "[")]
    got = [r.how for r in selections.read_sessions(spark.createDataFrame(rows, "key string, width int, height int, value string")).collect()]
    assert sorted(got) == sorted(["read", "migrated", *["fresh"] * 8]) and selections.saved(two | {"tool": "saw"}) is None


def test_named_masks():
    e, s = selections.edited, snapshot(b"\0" * 4, 2, 2)
    m = e(e([], "create", "a", ("  Sky ", s)), "create", "b", ("", s))
    assert [x["name"] for x in m] == ["Sky", "Mask 2"] and e(m, "create", "c", ("x", None)) == m
    assert [x["id"] for x in e(m, "move", "b", -1)] == ["b", "a"] and e(m, "move", "b", 1) == m
    copy = e(e(m, "toggle", "a", "locked"), "duplicate", "a", "c")
    assert [(x["id"], x["name"], x["locked"]) for x in copy] == [("a", "Sky", True), ("c", "Sky Copy", False), ("b", "Mask 2", False)]
    assert e(copy, "replace", "a", {"new": 1}) == copy and e(copy, "replace", "b", {"new": 1})[2]["mask"] == {"new": 1}
    assert [x["id"] for x in e(m, "delete", "a")] == ["b"] and e(m, "rename", "b", " ")[1]["name"] == "Mask 1" and e(m, "delete", "zz") == m
    with pytest.raises(ValueError):
        e(m, "paint", "a")


def test_paths_and_endpoints(spark):
    paths = {" C:\\A\\.\\b\\..\\C.PNG ": "c:/a/c.png", "/a//b/../../../x": "/x", "a/../../b": "../b", "../../q/..": "../..", "/": "/", "": "", "é/Ü": "é/ü"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.q for r in df.select("p", F.expr(names.source_path("p")).alias("q")).collect()} == paths
    good = {"http://localhost": True, " http://127.0.0.1:11434/ ": True, "http://[::1]:80": True, "http://[::1]:70000": False, "https://localhost": False, "http://a@localhost": False, "http://localhost/x": False, "http://localhost?q": False, "http://evil.org": False}
    df = spark.createDataFrame([(p,) for p in good], "p string")
    assert {r.p: r.q for r in df.select("p", F.expr(names.loopback("p")).alias("q")).collect()} == good
    def fnv(text):
        h = 0xCBF29CE484222325
        for unit in (text.encode("utf-16-be")[k : k + 2] for k in range(0, len(text.encode("utf-16-be")), 2)):
            for b in (unit[1], unit[0]):
                h = ((h ^ b) * 0x100000001B3) % 2**64
        return f"{h:016x}"
    texts = ["/a/é😀.png", "x", ""]
    df = spark.createDataFrame([(p,) for p in texts], "p string")
    assert {r.p: r.k for r in df.select("p", F.expr(names.document_key("p", "7", "9")).alias("k")).collect()} == {p: f"7x9-{fnv(p + chr(0) + '7x9')}" for p in texts}
    assert df.select(F.expr(names.pair_fingerprint("p")).alias("k")).filter("k like '0:%'").first().k == "0:811c9dc59e3779b9"


def test_geometry_checks_and_brushes(spark):
    fold = op("lens_correction", distortion=-0.16, vignetting=0, chromatic_aberration=0)
    remap.check_geometry(fold, 100, 50)
    for bad in (((0.5, 0.5), (0.500001, 0.5), (0.500001, 0.500001), (0.5, 0.500001)),):
        with pytest.raises(InvalidOperation):
            remap.Chain(10, 10, (op("perspective", corners=bad),))
    with pytest.raises(InvalidOperation):
        op("perspective", corners=((0.9, 0), (0.1, 0), (1, 1), (0, 1)))
    with pytest.raises(InvalidOperation):
        op("hsl", master=(0, 2, 0))
    with pytest.raises(InvalidOperation):
        op("curves", rgb=((0.1, 0), (1, 1)))
    p = plan(op("grayscale"), op("sepia"))
    assert [o.type for o in duplicated(p, 0).ops] == ["grayscale", "grayscale", "sepia"]
    assert len(rasterize.resolved_samples([(1, 1, 4, 1)], 10, 10)) == 1
    for bad in ([(0, 0, 1, 1), (1e9, 0, 1, 1)], [(0, 0, 1000, 1), (900, 900, 1000, 1)] * 40):
        with pytest.raises(ValueError):
            rasterize.resolved_samples(bad, 4000, 4000)
    g = rasterize.grid(spark, 1, 8, 8)
    for kind, points in (("polygon", [(0, 0), (1, 1)]), ("star", [(0, 0)]), ("ellipse", [(0, 0)] * 3)):
        with pytest.raises(ValueError):
            rasterize.shape(g, kind, points, 8, 8)
    assert rasterize.shape(g, "rectangle", [(1, 1), (4, 4)], 8, 8).count() == 64


def test_batch_remap_is_all_or_nothing(spark):
    rows = [(m, y, x, 9) for m in (1, 2) for y in range(4) for x in range(6)]
    m = spark.createDataFrame(rows, "mask_id bigint, y int, x int, cov int")
    old, new = remap.Chain(6, 4), remap.Chain(6, 4, (op("rotate", degrees=90),))
    assert remap.remap_batch(m, old, new).count() == 48
    for wrong in (m.filter("not (mask_id = 2 and x = 0 and y = 0)"), m.unionByName(m.limit(1)), m.withColumn("x", F.col("x") + 1)):
        with pytest.raises(ValueError):
            remap.remap_batch(wrong, old, new)
    asked, got = spark.createDataFrame([("a",), ("b",)], "key string"), spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    assert sorted(r.v for r in remap.remapped(asked, got).collect()) == [1, 2]
    for wrong in (got.filter("key = 'a'"), got.unionByName(got.limit(1)), got.withColumn("key", F.concat("key", F.lit("x")))):
        with pytest.raises(Exception, match="key"):
            remap.remapped(asked, wrong).collect()


def test_files(spark, tmp_path):
    files = spark.createDataFrame([("a.txt", bytearray(b"12")), ("b.txt", bytearray(b"12345"))], "name string, content binary")
    assert sorted(documents.write_files(files, f"file://{tmp_path}/out").collect()) == [("a.txt", 2), ("b.txt", 5)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.txt", "b.txt"]
    got = {r.path[-5:]: (r.content, r.error) for r in documents.bounded_files(spark, f"{tmp_path}/out", 3).collect()}
    assert got["a.txt"] == (b"12", None) and got["b.txt"] == (None, "larger than 3 bytes")
    with pytest.raises(Exception, match="file name"):
        documents.write_files(files.withColumn("name", F.lit("../x")), f"file://{tmp_path}/out").collect()
    assert decode_text(*encode_bytes(b"\1" * 50), 50) == b"\1" * 50


def test_progress_and_debounce(spark):
    rows = [(1, 1, 0.2, "running"), (1, 2, 0.1, "running"), (1, 3, 9.0, "cancelled"), (1, 4, 0.9, "completed"), (2, 1, 0.5, "completed")]
    got = [(r.k, r.n, r.shown, r.shown_state) for r in w.progress(spark.createDataFrame(rows, "k int, n int, share double, state string"), "k", "n", "share", "state").orderBy("k", "n").collect()]
    assert got == [(1, 1, 0.2, "running"), (1, 2, 0.2, "running"), (1, 3, 1.0, "cancelled"), (1, 4, 1.0, "cancelled"), (2, 1, 1.0, "completed")]
