"""Mask snapshots: run lengths, base64 without padding, and the FNV-1a checksum."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RAW, RLE = "base64_u8", "base64_rle_u8"
#: Start and factor of 64-bit FNV-1a; fixed values.
FNV_START, FNV_FACTOR = 0xCBF29CE484222325, 0x100000001B3


def runs(m: DataFrame) -> DataFrame:
    """(mask_id, run, cov, n): runs of equal coverage in row-major order; a run's number counts from 0."""
    w = Window.partitionBy("mask_id").orderBy("y", "x")
    q = m.withColumn("new", F.when(F.lag("cov").over(w) == F.col("cov"), 0).otherwise(1))
    q = q.withColumn("run", F.sum("new").over(w) - 1)
    return q.groupBy("mask_id", "run").agg(F.max("cov").alias("cov"), F.count("*").alias("n"))


def from_runs(r: DataFrame, width: int) -> DataFrame:
    """The mask of its runs."""
    w = Window.partitionBy("mask_id").orderBy("run")
    q = r.withColumn("begin", F.sum("n").over(w) - F.col("n")).withColumn("at", F.explode(F.expr("sequence(begin, begin + n - 1)")))
    return q.select("mask_id", F.expr(f"cast(at div {width} as int)").alias("y"), F.expr(f"cast(at % {width} as int)").alias("x"), "cov")


def checksum(data: bytes) -> str:
    """FNV-1a in passes over all bytes instead of steps from byte to byte.

    An exclusive or with a byte changes a sum by d, which depends on the sum's lowest byte only; with all d the result is a
    polynomial in the factor. Of the lowest byte, bit j at every place follows from the bits below it and a running exclusive
    or, as the factor is odd.
    """
    a = np.frombuffer(data, np.uint8)
    start, factor = np.uint8(FNV_START & 0xFF), np.uint8(FNV_FACTOR & 0xFF)
    low = np.zeros(len(a), np.uint8)  # the sum's lowest byte before each step, bit by bit
    for j in range(8):
        bit, below = np.uint8(1 << j), np.uint8((1 << j) - 1)
        flips = (a ^ (((low ^ a) & below) * factor)) & bit
        own = np.empty(len(a) + 1, np.uint8)
        own[0] = start & bit
        own[1:] = flips
        low |= np.bitwise_xor.accumulate(own)[:-1]
    d = ((low ^ a).astype(np.int16) - low).astype(np.int64).view(np.uint64)
    size, h = 1 << 14, FNV_START
    powers = np.cumprod(np.full(size, FNV_FACTOR, np.uint64))  # of 1, 2, ..
    for at in range(0, len(d), size):
        part = d[at : at + size]
        h = (h * int(powers[len(part) - 1]) + int((part * powers[: len(part)][::-1]).sum())) & 0xFFFFFFFFFFFFFFFF
    return f"fnv1a64:{h:016x}"


def encode_bytes(data: bytes) -> tuple[str, str]:
    """Encoding and text of coverage bytes: run lengths if they are shorter."""
    a = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, int)
    lengths = np.diff(np.append(edges, len(a))).astype("<u4")
    packed = np.empty(len(edges), np.dtype([("v", "u1"), ("n", "<u4")]))
    packed["v"], packed["n"] = a[edges], lengths
    short = packed.tobytes()
    kind, body = (RLE, short) if len(short) < len(data) else (RAW, data)
    return kind, base64.b64encode(body).decode().rstrip("=")


def decode_text(kind: str, text: str, size: int) -> bytes:
    """Coverage bytes; ValueError if the text is not canonical, or does not give size bytes."""
    body = base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    if base64.b64encode(body).decode().rstrip("=") != text:
        raise ValueError("mask data is not canonical base64")
    if kind == RLE:
        if not body or len(body) % 5:
            raise ValueError("run-length mask data is malformed")
        r = np.frombuffer(body, np.dtype([("v", "u1"), ("n", "<u4")]))
        if (r["n"] == 0).any() or int(r["n"].sum(dtype=np.int64)) != size:
            raise ValueError("run-length mask data does not match its dimensions")
        return np.repeat(r["v"], r["n"]).tobytes()
    if kind != RAW:
        raise ValueError("unknown mask encoding")
    if len(body) != size:
        raise ValueError("mask data does not match its dimensions")
    return body


def joined_lines(m: DataFrame) -> DataFrame:
    """(mask_id, width, height, cov) of long masks: hexadecimal text is joined by scanlines, then by masks, and read once."""
    px = m.groupBy("mask_id", "y").agg(F.expr("array_sort(collect_list(struct(x, cov)))").alias("v"))
    line = px.select("mask_id", "y", F.size("v").alias("width"), F.expr("array_join(transform(v, q -> lpad(hex(q.cov), 2, '0')), '')").alias("line"))
    blob = line.groupBy("mask_id").agg(F.max("width").alias("width"), F.count("*").cast("int").alias("height"), F.expr("array_sort(collect_list(struct(y, line)))").alias("v"))
    return blob.select("mask_id", "width", "height", F.expr("unhex(array_join(transform(v, q -> q.line), ''))").alias("cov"))


def spread_bytes(packed: DataFrame, key: str, column: str, names: tuple[str, ...], marked: bool = False) -> DataFrame:
    """(key, y, x, names..) of packed rows (key, width, height, column), a million places to a batch at most.

    If ``marked``, rows may have one byte more a place, which is 0 where there is nothing.
    """
    import pyarrow as pa

    kind = packed.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for k, w, h, data in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if not data.is_valid:
                    continue
                flat, step = np.frombuffer(data.as_buffer(), np.uint8), max(1, 1_000_000 // max(1, w))
                marks = marked and len(flat) > h * w * len(names)
                a = flat.reshape(h, w, len(names) + marks)
                for y in range(0, h, step):
                    part = a[y : y + step]
                    n = part.shape[0] * w
                    ys, xs = np.repeat(np.arange(y, y + part.shape[0], dtype=np.int32), w), np.tile(np.arange(w, dtype=np.int32), part.shape[0])
                    values = [part[..., c].ravel().astype(np.int32) for c in range(len(names))]
                    if marks:
                        there = part[..., -1].ravel() != 0
                        n, ys, xs, values = int(there.sum()), ys[there], xs[there], [v[there] for v in values]
                    yield pa.RecordBatch.from_arrays([pa.repeat(k, n), pa.array(ys), pa.array(xs), *map(pa.array, values)], [key, "y", "x", *names])

    return packed.select(key, "width", "height", column).mapInArrow(run, f"`{key}` {kind}, y int, x int, " + ", ".join(f"{c} int" for c in names))


def snapshots(m: DataFrame, size: tuple[int, int] | None = None) -> DataFrame:
    """(mask_id, version, width, height, encoding, data, checksum) of masks; rows are joined before whole masks are.

    ``size`` is what the snapshots state as width and height, else each mask's own. Data are the places that there are, so the
    snapshot of a mask that lacks some states more than it holds, and from_snapshots rejects it.
    """
    blob = joined_lines(m)
    if size:
        blob = blob.withColumns({"width": F.lit(size[0]), "height": F.lit(size[1])})

    def run(batches: Iterator):
        import pandas as pd

        for b in batches:
            coded = [encode_bytes(bytes(d)) for d in b["cov"]]
            yield pd.DataFrame({"mask_id": b["mask_id"], "version": 1, "width": b["width"], "height": b["height"], "encoding": [c[0] for c in coded], "data": [c[1] for c in coded], "checksum": [checksum(bytes(d)) for d in b["cov"]]})

    return blob.mapInPandas(run, "mask_id bigint, version int, width int, height int, encoding string, data string, checksum string")


def from_snapshots(s: DataFrame) -> DataFrame:
    """Masks of snapshots; a snapshot that fails a check fails the job."""

    def run(batches: Iterator):
        for b in batches:
            out = []
            for v, w, h, kind, text, check in zip(b["version"], b["width"], b["height"], b["encoding"], b["data"], b["checksum"], strict=True):
                data = decode_text(kind, text, w * h)
                if v != 1 or checksum(data) != check:
                    raise ValueError("mask snapshot of another version or with another checksum")
                out.append(data)
            yield b[["mask_id", "width", "height"]].assign(cov=out)

    raw = s.mapInPandas(run, "mask_id bigint, width int, height int, cov binary")
    return spread_bytes(raw, "mask_id", "cov", ("cov",))
