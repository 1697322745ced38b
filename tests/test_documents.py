"""Mask files, manifests, model files and camera models."""

import json
import struct

import pytest

from pixelloom.functions import codec
from pixelloom.sources import documents as d
from tests.test_golden import grid

GOOD = {"schemaVersion": 1, "name": "A planner", "version": "1.0.0", "type": "planner", "provider": "local-x", "entry": "adapters/x.disabled", "memoryEstimateMb": 128, "capabilities": ["one", "two"]}


def test_manifests():
    assert d.manifest_error(json.dumps(GOOD)) is None
    wrong = [{"schemaVersion": 2}, {"name": " "}, {"version": "1"}, {"version": "1.x"}, {"type": "other"}, {"provider": "a b"}, {"entry": "/etc/x"}, {"entry": "a/../b"}, {"entry": "C:\\x"}, {"memoryEstimateMb": 10**6}, {"capabilities": ["One", "one"]}, {"capabilities": ["a b"]}, {"more": 1}]
    for w in wrong:
        assert d.manifest_error(json.dumps(GOOD | w)), w
    assert d.manifest_error("{") and d.manifest_error("[]") and d.manifest_error(json.dumps({k: v for k, v in GOOD.items() if k != "name"}))
    assert d.manifest_error(json.dumps(GOOD | {"name": "x" * 70000}))


def test_folder_scans(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps(GOOD))
    (tmp_path / "a.json").write_text("{")
    (tmp_path / "m.onnx").write_bytes(b"x" * 1048577)
    (tmp_path / "m.txt").write_text("no")
    got = d.scan_manifests(spark, str(tmp_path)).collect()
    assert [(r.path[-6:], r.valid) for r in got] == [("a.json", False), ("b.json", True)]
    m = d.discover_models(spark, [str(tmp_path)]).collect()
    assert [(r.name, r.format, r.memory_estimate_mb) for r in m] == [("m.onnx", "ONNX", 3)]
    with pytest.raises(ValueError):
        d.discover_models(spark, ["x"] * 9)


def test_mask_files(spark, tmp_path):
    s = codec.snapshots(grid(spark, [[0, 0, 255], [255, 7, 7]])).first().asDict()
    s.pop("mask_id")
    (tmp_path / "ok.json").write_text(d.mask_document("a-mask", "1", "One", s, sourceTool="wand"))
    (tmp_path / "sum.json").write_text(d.mask_document("a-mask", "1", "One", s | {"checksum": "fnv1a64:0"}))
    (tmp_path / "tag.json").write_text(d.mask_document("b-mask", "1", "One", s))
    (tmp_path / "name.json").write_text(d.mask_document("a-mask", "1", " ", s))
    (tmp_path / "no.json").write_text("[]")
    got = {r.path.rpartition("/")[2]: r for r in d.read_mask_files(spark, str(tmp_path), "a-mask").collect()}
    assert bytes(got["ok.json"].cov) == bytes([0, 0, 255, 255, 7, 7]) and got["ok.json"].error is None and (got["ok.json"].width, got["ok.json"].height) == (3, 2)
    assert all(got[k].error for k in ("sum.json", "tag.json", "name.json", "no.json"))


@pytest.mark.parametrize("order, mark", [("<", b"II"), (">", b"MM")])
def test_camera_model(order, mark):
    name = b"Camera One\0"
    tiff = mark + struct.pack(order + "HIH", 42, 8, 1) + struct.pack(order + "HHII", 0x0110, 2, len(name), 26) + b"\0" * 4 + name
    body = b"Exif\0\0" + tiff
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xd9"
    assert d.camera_model(jpeg) == "Camera One"
    assert d.camera_model(jpeg[:40]) is None and d.camera_model(b"") is None and d.camera_model(b"\x89PNG") is None
