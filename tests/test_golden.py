"""Stated values of single operations, and laws that hold for any picture."""

import pytest

from pixelloom.functions import codec
from pixelloom.operators import aggregate, geometry, mask, planner, point, rasterize, regions, window
from pixelloom.plans import compiler
from pixelloom.plans.ops import op, plan
from pixelloom.sources import rasters

PX = ["image_id", "y", "x", "r", "g", "b", "a"]


def picture(spark, rows):
    """rows of pixels (r, g, b, a)."""
    return spark.createDataFrame([(1, y, x, *p) for y, row in enumerate(rows) for x, p in enumerate(row)], "image_id bigint, y int, x int, r int, g int, b int, a int")


def grid(spark, rows):
    return spark.createDataFrame([(1, y, x, v) for y, row in enumerate(rows) for x, v in enumerate(row)], "mask_id bigint, y int, x int, cov int")


def rows(df):
    at = {(r.y, r.x): (r.r, r.g, r.b, r.a) for r in df.collect()}
    h, w = max(k[0] for k in at) + 1, max(k[1] for k in at) + 1
    return [[at[y, x] for x in range(w)] for y in range(h)]


def covs(df):
    at = {(r.y, r.x): r.cov for r in df.collect()}
    h, w = max(k[0] for k in at) + 1, max(k[1] for k in at) + 1
    return [[at[y, x] for x in range(w)] for y in range(h)]


def pattern(spark, w=16, h=12):
    return picture(spark, [[(x * 13 % 256, y * 17 % 256, (x + y) * 7 % 256, 173) for x in range(w)] for y in range(h)])


@pytest.mark.parametrize(
    "operation, before, after",
    [
        (op("brightness", amount=0.1), (240, 10, 30, 77), (255, 36, 56, 77)),
        (op("sepia"), (100, 150, 200, 37), (192, 171, 134, 37)),
        (op("levels", input_black=20, input_white=240, gamma=1.0, output_black=10, output_white=210), (20, 120, 240, 9), (10, 101, 210, 9)),
        (op("white_point", red=100, green=120, blue=200), (100, 120, 200, 5), (255, 255, 255, 5)),
        (op("black_point", red=10, green=20, blue=30), (100, 120, 200, 5), (90, 100, 170, 5)),
    ],
)
def test_single_pixel(spark, operation, before, after):
    assert rows(compiler.apply_plan(picture(spark, [[before]]), plan(operation), 1, 1)) == [[after]]


def test_desaturated_is_grey(spark):
    p = picture(spark, [[(200, 100, 25, 41)]])
    assert rows(point.saturation(p, -1.0)) == rows(point.grayscale(p))


def test_turns(spark):
    r, b = (255, 0, 0, 1), (0, 0, 255, 2)
    p = picture(spark, [[r, b]])
    assert rows(geometry.rotate(p, 90, 2, 1)) == [[r], [b]]
    q = picture(spark, [[(10, 20, 30, 1), (40, 50, 60, 2)]])
    assert rows(compiler.apply_plan(q, plan(op("rotate", degrees=270), op("brightness", amount=0.1)), 2, 1)) == [[(66, 76, 86, 2)], [(36, 46, 56, 1)]]
    p = pattern(spark)
    four = compiler.apply_plan(p, plan(*[op("rotate", degrees=90)] * 4), 16, 12)
    assert rows(four) == rows(p)
    assert rows(geometry.reflect_horizontal(geometry.reflect_horizontal(p, 16), 16)) == rows(p)


def test_crop(spark):
    p = pattern(spark)
    out = rows(geometry.crop(p, 0.25, 0.25, 0.5, 0.5, 16, 12))
    assert (len(out[0]), len(out), out[0][0]) == (8, 6, rows(p)[3][4])
    assert rows(geometry.crop(p, 0, 0, 1, 1, 16, 12)) == rows(p)


def test_masked_brightness(spark):
    p = picture(spark, [[(10, 20, 30, 255)] * 3])
    m = {"m": grid(spark, [[0, 128, 255]])}
    out = compiler.apply_plan(p, plan(op("masked", operation=op("brightness", amount=0.2), mask="m")), 3, 1, m)
    assert [v[:3] for v in rows(out)[0]] == [(10, 20, 30), (36, 46, 56), (61, 71, 81)]


def test_decontaminate(spark):
    p = picture(spark, [[(200, 20, 20, 41), (120, 20, 120, 42), (20, 20, 220, 43)]])
    m = {"m": grid(spark, [[255, 128, 0]])}
    o = op("masked", operation=op("decontaminate_colors", strength=1.0, radius=1), mask="m")
    assert rows(compiler.apply_plan(p, plan(o), 3, 1, m))[0] == [(200, 20, 20, 41), (200, 20, 20, 42), (20, 20, 220, 43)]
    back = op("masked", operation=op("decontaminate_colors", strength=1.0, radius=1), mask="m", invert=True)
    assert rows(compiler.apply_plan(p, plan(back), 3, 1, m))[0][1] == (20, 20, 220, 42)


def test_neutral_parameters_change_nothing(spark):
    p = pattern(spark)
    for o in (op("brightness", amount=0), op("saturation", amount=0), op("denoise", strength=0, preserve_edges=0.5), op("hsl"), op("temperature_tint", temperature=0, tint=0), op("perspective", corners=((0, 0), (1, 0), (1, 1), (0, 1)))):
        got, want = rows(compiler.apply_plan(p, plan(o), 16, 12)), rows(p)
        assert max(abs(a - b) for r, s in zip(got, want, strict=True) for u, v in zip(r, s, strict=True) for a, b in zip(u, v, strict=True)) <= 1


def test_compose(spark):
    a = grid(spark, [[128]])
    want = {"replace": 128, "add": 128, "subtract": 64, "intersect": 64}
    assert {m: covs(mask.compose(a, a, m))[0][0] for m in want} == want
    assert covs(mask.compose(None, a, "subtract")) == [[0]] and covs(mask.compose(None, a, "add")) == [[128]]
    b, c = grid(spark, [[0, 255, 0, 255]]), grid(spark, [[0, 0, 255, 255]])
    assert covs(mask.compose(b, c, "add")) == [[0, 255, 255, 255]]
    assert covs(mask.compose(b, c, "intersect")) == [[0, 0, 0, 255]]
    assert covs(mask.compose(b, c, "subtract")) == [[0, 255, 0, 0]]
    with pytest.raises(ValueError):
        mask.compose(a, a, "xor")


@pytest.mark.parametrize("radius", [1, 2, 3, 7, 40])
def test_windows_against_plain_python(spark, radius):
    v = [[(x * 37 + y * 91) % 256 for x in range(13)] for y in range(9)]

    def passes(f):
        a = [[f(r[max(0, x - radius) : x + radius + 1]) for x in range(len(r))] for r in v]
        t = [list(c) for c in zip(*a, strict=True)]
        t = [[f(r[max(0, x - radius) : x + radius + 1]) for x in range(len(r))] for r in t]
        return [list(c) for c in zip(*t, strict=True)]

    m = grid(spark, v)
    assert covs(mask.expand(m, radius)) == passes(max)
    assert covs(mask.shrink(m, radius)) == passes(min)
    assert covs(mask.feather(m, radius)) == passes(lambda s: sum(s) // len(s))

    def blurred(v):
        at = lambda r, k: r[max(0, min(len(r) - 1, k))]
        one = lambda v: [[sum(at(r, x + o) for o in range(-radius, radius + 1)) // (2 * radius + 1) for x in range(len(r))] for r in v]
        return [list(c) for c in zip(*one([list(c) for c in zip(*one(v), strict=True)]), strict=True)]

    got = window.box_blur(m.withColumnRenamed("cov", "v"), "v", radius, "cov", "mask_id")
    assert covs(got) == blurred(v)


def test_histogram_counts(spark):
    p = picture(spark, [[(0, 0, 0, 0), (255, 255, 255, 255), (255, 0, 0, 9), (100, 100, 100, 9)]])
    h = {(r.channel, r.bin): r.n for r in aggregate.histogram(p).collect()}
    assert h["luminance", 54] == 1 and h["red", 255] == 2 and sum(n for (c, _), n in h.items() if c == "luminance") == 4
    c = aggregate.clipping(p).first()
    assert (c.shadow_clipping, c.highlight_clipping, c.pixel_count) == (2, 2, 4)


def test_hues(spark):
    colours = [(255, 0, 0), (255, 255, 0), (0, 255, 0), (0, 255, 255), (0, 0, 255), (255, 0, 255)]
    got = {r.x: r.hue for r in point.with_hsv(picture(spark, [[(*c, 255) for c in colours]])).collect()}
    assert [got[k] for k in range(6)] == [0, 60, 120, 180, 240, 300]


def test_transparent_picture_has_an_empty_analysis(spark):
    r = aggregate.analysis(picture(spark, [[(9, 9, 9, 0)]])).first()
    assert (r.average_luminance, r.dominant, r.likely_document) == (0.0, "neutral", False)
    assert rows(aggregate.auto_white_balance(picture(spark, [[(9, 9, 9, 0)]]), 0.5)) == [[(9, 9, 9, 0)]]


def test_mask_resample(spark):
    out = covs(geometry.resample_mask(grid(spark, [[0, 255], [255, 0]]), 2, 2, 4, 4))
    assert [out[0][0], out[0][3], out[3][0], out[3][3]] == [0, 255, 255, 0]


def test_wand_connectivity(spark):
    w, k = (255, 255, 255, 255), (0, 0, 0, 255)
    p = picture(spark, [[w, k, k], [k, w, k], [k, k, w]])
    assert covs(regions.wand_region(p, (0, 0), 0.1, False))[1][1] == 0
    assert covs(regions.wand_region(p, (0, 0), 0.1, False, eight=True))[1][1] == 255
    spiral = [[w if (x % 4 != 3 or y in (0, 12)[x // 4 % 2 : x // 4 % 2 + 1]) else k for x in range(15)] for y in range(13)]
    assert sum(v == 255 for r in covs(regions.wand_region(picture(spark, spiral), (0, 6), 0.1, False)) for v in r) == sum(v == w for r in spiral for v in r)


def test_holes_and_islands(spark):
    ring = [[255] * 5, [255, 0, 0, 0, 255], [255, 0, 255, 0, 255], [255, 0, 0, 0, 255], [255] * 5, [0, 0, 0, 0, 0]]
    assert covs(regions.fill_holes(grid(spark, ring)))[:5] == [[255] * 5] * 5
    assert covs(regions.remove_islands(grid(spark, ring), 2))[2][2] == 0
    assert covs(regions.remove_islands(grid(spark, ring), 1))[2][2] == 255


def test_shapes(spark):
    g = rasterize.grid(spark, 1, 4, 4)
    assert covs(rasterize.rectangle(g, 4, 4, (0.5, 0), (2, 1)))[0] == [128, 255, 0, 0]
    square = covs(rasterize.polygon(g, ((1, 1), (3, 1), (3, 3), (1, 3))))
    assert square == [[0] * 4, [0, 255, 255, 0], [0, 255, 255, 0], [0] * 4]
    dot = covs(rasterize.brush(g, 4, 4, ((2, 2),), 2.0, 1.0, 1.0))
    assert dot[1][1] == 255 and dot[0][0] == 0
    assert rasterize.simplify([(0, 0), (0.1, 0), (1, 0), (1.1, 0), (2, 0)], 0.5) == [(0, 0), (1, 0), (2, 0)]


def test_codec(spark):
    assert codec.checksum(bytes([0, 255, 128, 255])) == "fnv1a64:" + format(codec_fnv([0, 255, 128, 255]), "016x")
    for data in (bytes(16), bytes(range(16)), b"\x07" * 300):
        kind, text = codec.encode_bytes(data)
        assert codec.decode_text(kind, text, len(data)) == data and "=" not in text
        with pytest.raises(ValueError):
            codec.decode_text(kind, text, len(data) + 1)
    assert codec.encode_bytes(bytes(16))[0] == codec.RLE and codec.encode_bytes(bytes(range(16)))[0] == codec.RAW
    m = grid(spark, [[0, 0, 255], [255, 7, 7]])
    assert covs(codec.from_snapshots(codec.snapshots(m))) == covs(m)


def codec_fnv(values):
    h = 14695981039346656037
    for v in values:
        h = (h ^ v) * 1099511628211 % 2**64
    return h


def test_png_round_trip(spark, tmp_path):
    p = pattern(spark, 5, 4)
    png = rasters.with_png(rasters.pack(p)).first().png
    (tmp_path / "one.png").write_bytes(png)
    (tmp_path / "broken.png").write_bytes(b"no picture")
    assert rows(rasters.unpack(rasters.read_images(spark, str(tmp_path)).selectExpr("1L as image_id", "width", "height", "data"))) == rows(p)
    assert rasters.header_size(png) == ("png", 5, 4)
    from pixelloom.operators import batch

    log = {r.path.rpartition("/")[2]: r for r in batch.run_folder(spark, str(tmp_path), plan(op("reflect_horizontal")), "{name}-{index}").collect()}
    assert log["one.png"].status == "ok" and log["broken.png"].status == "failed" and log["one.png"].target == "one-0002.png"


def test_all_files_are_planned(spark):
    from pixelloom.operators import batch

    names = [f"/in/{'Ab'[k % 2]}{k}.png" for k in range(10_050)]
    got = batch.planned(spark.createDataFrame([(n,) for n in names + names[:5]], "path string").repartition(7), spark.createDataFrame([("b1.png",)], "target string"), "{name}", "lossless", "w").collect()
    order = sorted(names, key=lambda n: (n.lower(), n))
    assert sorted((r.idx, r.path) for r in got) == list(enumerate(order))
    assert [r.path for r in got if r.status != "run"] == ["/in/b1.png"]
    none = spark.createDataFrame([], "path string")
    assert batch.planned(none, none.toDF("target"), "{name}", "lossless", "w").count() == 0


def test_workflows(spark):
    import json

    from pixelloom.operators import batch

    docs = [{"id": "one", "name": "One", "operations": [{"type": "grayscale"}], "other": 1}, {"id": "two", "name": "Two", "operations": [{"type": "gamma", "value": 9}]}, {"schemaVersion": 7, "id": "x", "name": "x"}]
    got = batch.read_workflows(spark.createDataFrame([(json.dumps(d),) for d in docs] + [("{",)], "value string")).collect()
    assert [r.error is None for r in got] == [True, False, False, False] and got[0].favorite is False


def test_planner_rules(spark):
    a = spark.createDataFrame([(0.48, 0.06, 0.08, "neutral", False)], "lum double, con double, noise double, dominant string, likely_document boolean")
    asked = ["make it brighter", "too dark and too bright", "hello", "  ", "x" * 1001, "JPEG-artifacts!", "keep colors", "old photo"]
    req = spark.createDataFrame(list(enumerate(asked)), "request_id bigint, text string")
    got = {r.request_id: r for r in planner.plans(req, a).collect()}
    assert got[0].operations == "brightness:amount=0.08" and got[0].confidence == 0.61
    assert [got[k].status for k in (1, 2, 3, 4)] == ["conflict", "no_match", "invalid", "invalid"]
    assert [o.split(":")[0] for o in got[5].operations.split(";")] == ["deblock", "denoise"]
    assert got[6].operations.startswith("local_contrast:strength=0.24")
    assert [o.split(":")[0] for o in got[7].operations.split(";")] == ["auto_white_balance", "local_contrast", "denoise", "edge_aware_sharpen"]


def test_sessions_as_a_stream(spark, tmp_path):
    from pixelloom.streaming import sessions

    rows_ = [("d", 0.0), ("d", 0.3), ("d", 1.5), ("e", 0.1)]
    df = spark.createDataFrame(rows_, "doc string, s double").selectExpr("doc", "timestamp_millis(cast(s * 1000 as bigint)) as ts")
    assert sorted(r.n_events for r in sessions.coalesced(df, ["doc"], "ts", 500).collect()) == [1, 1, 2]
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = sessions.streaming_sessions(stream, ["doc"], "ts", 500).writeStream.outputMode("complete").format("memory").queryName("sess").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n_events for r in spark.sql("select * from sess").collect()) == [1, 1, 2]
