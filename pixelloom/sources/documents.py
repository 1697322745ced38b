"""Small documents around pictures: mask files, plug-in manifests, model files, camera models.

Documents that fail a check are rows with an ``error``; they stop nothing else. Nothing that a document names is run.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import checksum, decode_text
from ..functions.scratch import written

MOST_MANIFESTS, MOST_MANIFEST_BYTES, MOST_FOLDERS, MOST_MODELS = 64, 64 << 10, 8, 256
#: Endings of model files, and the kinds of plug-ins; fixed values.
MODEL_ENDINGS = ("onnx", "safetensors", "pth", "pt", "bin")
PLUGIN_KINDS = ("planner", "restoration_engine")
MANIFEST_FIELDS = {"schemaVersion": int, "name": str, "version": str, "type": str, "provider": str, "entry": str, "memoryEstimateMb": int, "capabilities": list}
#: The longest mask that is decoded, and the most of a JPEG that is searched for a camera.
MOST_MASK_PIXELS, MOST_EXIF = 100_000_000, 8 << 20


def _texts(spark: SparkSession, path: str, ending: str) -> DataFrame:
    raw = spark.read.format("binaryFile").load(path)
    return raw.filter(F.lower("path").endswith("." + ending)).select("path", "length", F.col("content").cast("string").alias("value"))


def read_mask_files(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(path, id, name, width, height, cov, error) of the mask files of a folder whose format is ``tag``, version 1.

    cov holds the coverage bytes, row by row. Unknown fields are let through; ids, names and metadata have limits.
    """

    def run(batches: Iterator):
        import pandas as pd

        for b in batches:
            rows = []
            for p, v in zip(b["path"], b["value"], strict=True):
                try:
                    d = json.loads(v)
                    if d["format"] != tag or d["version"] != 1 or d["mask"].get("version") != 1:
                        raise ValueError("not a mask file of this version")
                    meta = d.get("metadata", {})
                    short = [(d["id"], 128), (d["name"], 120)]
                    if any(not s.strip() or len(s.encode()) > n for s, n in short) or any(len((meta.get(k) or "").encode()) > n for k, n in (("createdAt", 128), ("modifiedAt", 128), ("sourceTool", 120))):
                        raise ValueError("mask identity, name or metadata is invalid")
                    m = d["mask"]
                    if m["width"] < 1 or m["height"] < 1 or m["width"] * m["height"] > MOST_MASK_PIXELS:
                        raise ValueError("mask is too large")
                    cov = decode_text(m["encoding"], m["data"], m["width"] * m["height"])
                    if checksum(cov) != m["checksum"]:
                        raise ValueError("mask checksum differs")
                    rows.append((p, d["id"], d["name"], m["width"], m["height"], cov, None))
                except (ValueError, KeyError, TypeError, AttributeError) as e:
                    rows.append((p, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            out = pd.DataFrame(rows, columns=["path", "id", "name", "width", "height", "cov", "error"])
            yield out.astype({"width": "Int32", "height": "Int32"})

    return _texts(spark, path, "json").mapInPandas(run, "path string, id string, name string, width int, height int, cov binary, error string")


def filesystem(uri: str):
    """A file system and a path in it for a URI."""
    from urllib.parse import urlsplit

    from pyarrow import fs

    if urlsplit(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlsplit(uri).path
    return fs.FileSystem.from_uri(uri)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes files (name, content) below a folder that all machines share and returns (name, length), one row a file.

    A file is written beside its place and then moved there, so that none is ever seen half written; a task that runs again
    puts the same content there. Names with a separator are an error.
    """

    def run(batches: Iterator):
        import uuid

        system, base = filesystem(folder)
        system.create_dir(base, recursive=True)
        for b in batches:
            for name, content in zip(b["name"], b["content"], strict=True):
                if not name or "/" in name or "\\" in name:
                    raise ValueError(f"not a file name: {name}")
                beside = f"{base}/.{uuid.uuid4().hex}.part"
                with system.open_output_stream(beside) as out:
                    out.write(bytes(content))
                system.move(beside, f"{base}/{name}")
            yield b[["name"]].assign(length=[len(c) for c in b["content"]])

    return written(files.select("name", "content").mapInPandas(run, "name string, length bigint"), "files")


def write_mask_files(snapshots: DataFrame, folder: str, tag: str, created: str = "", source_tool: str = "") -> DataFrame:
    """Writes a JSON mask file for each snapshot (mask_id, .., as functions.codec.snapshots gives them); returns (name, length)."""

    def run(batches: Iterator):
        import pandas as pd

        for b in batches:
            names, bodies = [], []
            for r in b.to_dict("records"):
                snap = {"version": int(r["version"]), "width": int(r["width"]), "height": int(r["height"]), "encoding": r["encoding"], "data": r["data"], "checksum": r["checksum"]}
                names.append(f"mask-{r['mask_id']}.json")
                bodies.append(mask_document(tag, str(r["mask_id"]), f"Mask {r['mask_id']}", snap, createdAt=created, modifiedAt=created, sourceTool=source_tool).encode())
            yield pd.DataFrame({"name": names, "content": bodies})

    return write_files(snapshots.mapInPandas(run, "name string, content binary"), folder)


def write_mask_pngs(masks: DataFrame, folder: str) -> DataFrame:
    """Writes packed masks (mask_id, width, height, cov) as grey PNG files of 8 bits; returns (name, length)."""
    from .rasters import png_bytes

    def run(batches: Iterator):
        for b in batches:
            body = [png_bytes(w, h, bytes(d), 1) for w, h, d in zip(b["width"], b["height"], b["cov"], strict=True)]
            yield b[[]].assign(name=[f"mask-{k}.png" for k in b["mask_id"]], content=body)

    return write_files(masks.select("mask_id", "width", "height", "cov").mapInPandas(run, "name string, content binary"), folder)


def read_mask_pngs(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, cov) of a folder's pictures as masks: their luminance in 8 bits, transparent pixels empty."""
    from ..operators.packed import light, mapped, rounded
    from .rasters import read_images

    import_ = lambda px: ((rounded(light(px)).astype("uint16") * px[..., 3] + 127) // 255)
    return mapped(read_images(spark, path), "data", 4, import_).withColumnRenamed("data", "cov")


def bounded_files(spark: SparkSession, path: str, most: int) -> DataFrame:
    """(path, length, content, error) of a folder's files; one of more than ``most`` bytes has no content but an error."""
    raw = spark.read.format("binaryFile").load(path)
    small = F.col("length") <= most
    return raw.select("path", "length", F.when(small, F.col("content")).alias("content"), F.when(~small, F.lit(f"larger than {most} bytes")).alias("error"))


def mask_document(tag: str, id_: str, name: str, snapshot: dict, **metadata: str) -> str:
    """The JSON of a mask file; snapshot as functions.codec.snapshots gives it."""
    return json.dumps({"format": tag, "version": 1, "id": id_, "name": name, "mask": snapshot, "metadata": metadata})


def manifest_error(text: str) -> str | None:
    """What is wrong with a plug-in manifest, if anything. Unknown fields are."""
    if len(text.encode()) > MOST_MANIFEST_BYTES:
        return "larger than 64 KiB"
    try:
        d = json.loads(text)
    except ValueError:
        return "not JSON"
    if not isinstance(d, dict) or set(d) - set(MANIFEST_FIELDS) or set(MANIFEST_FIELDS) - set(d) - {"capabilities"}:
        return "fields are missing or unknown"
    if any(k in d and (not isinstance(d[k], t) or isinstance(d[k], bool)) for k, t in MANIFEST_FIELDS.items()):
        return "a field has the wrong type"
    word = re.compile(r"[A-Za-z0-9_.-]+")
    caps = d.get("capabilities", [])
    parts = re.split(r"[\\/]", d["entry"])
    for bad, why in (
        (d["schemaVersion"] != 1, "schemaVersion must be 1"),
        (d["type"] not in PLUGIN_KINDS, "unknown type"),
        (not d["name"].strip() or len(d["name"].encode()) > 80, "name must have 1 to 80 characters"),
        (not re.fullmatch(r"[0-9]{1,6}(\.[0-9]{1,6}){1,2}", d["version"]), "version must have numeric segments"),
        (not word.fullmatch(d["provider"]) or len(d["provider"]) > 80, "provider must be an identifier"),
        (not d["entry"].strip() or len(d["entry"].encode()) > 260 or not parts[0] or parts[0].endswith(":") or ".." in parts, "entry must be a relative path without parents"),
        (not 0 <= d["memoryEstimateMb"] <= 262_144, "memoryEstimateMb is beyond 256 GiB"),
        (len(caps) > 32 or not all(isinstance(c, str) and word.fullmatch(c) and len(c) <= 64 for c in caps), "capabilities must be identifiers, at most 32"),
        (len({str(c).lower() for c in caps}) < len(caps), "capabilities must not repeat"),
    ):
        if bad:
            return why
    return None


def scan_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(path, valid, error) of the first 64 JSON files of a folder in the order of their paths. They are only read."""

    def run(batches: Iterator):
        for b in batches:
            found = [manifest_error(v) for v in b["value"]]
            yield b[["path"]].assign(valid=[e is None for e in found], error=found)

    first = _texts(spark, path, "json").select("path", "value").orderBy("path").limit(MOST_MANIFESTS)
    return first.mapInPandas(run, "path string, valid boolean, error string")


def discover_models(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path, name, format, file_size_bytes, memory_estimate_mb) of model files, folder by folder, 256 at most.

    Only names and sizes are looked at; memory is taken as twice the size, rounded up.
    """
    if len(folders) > MOST_FOLDERS:
        raise ValueError(f"at most {MOST_FOLDERS} folders")
    out = None
    for k, folder in enumerate(folders):
        d = spark.read.format("binaryFile").load(folder).select("path", "length").withColumn("_k", F.lit(k))
        out = d if out is None else out.unionByName(d)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = out.withColumn("_e", ending).filter(F.col("_e").isin(*MODEL_ENDINGS)).orderBy("_k", "path").limit(MOST_MODELS)
    return known.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.upper("_e").alias("format"), F.col("length").alias("file_size_bytes"), F.expr("(2 * length + 1048575) div 1048576").alias("memory_estimate_mb"))


def camera_model(data: bytes) -> str | None:
    """The camera model (tag 0x0110) in the first directory of a JPEG's EXIF block, in either byte order."""
    data = data[:MOST_EXIF]
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if size < 2:
            return None
        if data[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
            return _ascii_tag(body[6:], 0x0110)
        at += 2 + size
    return None


def _ascii_tag(tiff: bytes, tag: int) -> str | None:
    order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
    if order is None:
        return None
    num = lambda p, n: int.from_bytes(tiff[p : p + n], order)
    if num(2, 2) != 42:
        return None
    first = num(4, 4)
    for k in range(num(first, 2)):
        p = first + 2 + 12 * k
        if p + 12 > len(tiff):
            return None
        if num(p, 2) == tag and num(p + 2, 2) == 2:
            n = num(p + 4, 4)
            start = p + 8 if n <= 4 else num(p + 8, 4)
            if start + n > len(tiff):
                return None
            return tiff[start : start + n].split(b"\0")[0].decode("utf-8", "replace").strip() or None
    return None


def camera_models(spark: SparkSession, path: str) -> DataFrame:
    """(path, camera_model) of a folder's JPEG files."""

    def run(batches: Iterator):
        for b in batches:
            yield b[["path"]].assign(camera_model=[camera_model(bytes(d)) for d in b["content"]])

    raw = spark.read.format("binaryFile").load(path).filter(F.lower("path").rlike(r"\.jpe?g$"))
    return raw.select("path", "content").mapInPandas(run, "path string, camera_model string")
