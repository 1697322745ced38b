"""All raster queries of the engine by name, and the SQL that gives the same rows.

Queries run over pictures and masks derived from the table embeddings (sources.rasters), and over events, orders and
part where an operation is about order or names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalog_sql as S
from . import plan_sql, workspace_catalog
from .functions import codec
from .functions.codec import spread_bytes
from .functions.shipping import ship
from .operators import aggregate, geometry, kernels, mask, overlay, packed, planner, point, rasterize, regions, window
from .plans import compiler, presets
from .plans.ops import op, plan
from .sources.rasters import HEIGHT as H
from .sources.rasters import WIDTH as W
from .sources.rasters import embedding_masks, embedding_pixels, pack, unpack
from .streaming import sessions

PX = ["image_id", "y", "x", "r", "g", "b", "a"]
MK = ["mask_id", "y", "x", "cov"]
FOUND: dict[str, tuple] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    FOUND[name] = (query, sql)


def _px(name: str, f, sql: str | None = None) -> None:
    _add(name, lambda spark, d: f(embedding_pixels(spark, d)).select(*PX), sql)


def _mk(name: str, f, sql: str | None = None) -> None:
    _add(name, lambda spark, d: f(embedding_masks(spark, d)).select(*MK), sql)


def _second_mask(spark, d) -> DataFrame:
    return embedding_pixels(spark, d).select(F.col("image_id").alias("mask_id"), "y", "x", F.col("g").alias("cov"))


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def _stepped(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Nearest decimal by one multiplication and one division, which engines do alike."""
    return df.withColumns({c: F.expr(f"floor(cast({c} as double) * {10.0**digits}D + 0.5D) / {10.0**digits}D") for c in columns})


CURVES = op("curves", rgb=presets.CURVES["contrast"], red=presets.CURVES["matte"], green=((0, 0), (1, 1)), blue=presets.CURVES["bright"])
LEVELS = op("levels", input_black=20, input_white=240, gamma=1.3, output_black=10, output_white=230)
MASTER, BANDS = (15.0, 0.1, -0.05), {"red": (10.0, 0.2, 0.1), "green": (-20.0, -0.3, 0.05), "blue": (5.0, 0.15, -0.1)}
CORNERS = ((0.05, 0.02), (0.97, 0.06), (0.93, 0.98), (0.02, 0.9))
POLYGON = ((3.2, 2.1), (17.5, 6.3), (12.4, 30.7), (19.8, 44.2), (6.1, 38.6), (1.4, 21.9))
STROKE, DIAMETER, HARDNESS, OPACITY = ((3.0, 4.0), (15.5, 12.25), (8.0, 40.0)), 6.0, 0.5, 0.8
SAMPLES = [(5, 5), (12, 30)]
WAND, SEED = (127, 127, 127, 255), (10, 25)


def _register() -> None:
    a = presets.PRESETS["fix_dark"].ops
    bt, gt, ct = (point.channel_tables(o)[0] for o in a)
    _add("preset_fix_dark", lambda s, d: aggregate.luminance_histogram(compiler.apply_plan(embedding_pixels(s, d), presets.PRESETS["fix_dark"], W, H)), S.fix_dark(bt, gt, ct))

    # points
    _px("pt_brightness", lambda p: point.brightness(p, 0.14), S.brightness(0.14))
    _px("pt_contrast", lambda p: point.contrast(p, 0.08), S.contrast(0.08))
    _px("pt_saturation", lambda p: point.saturation(p, 0.25), S.saturation(0.25))
    _px("pt_gamma_lut", lambda p: point.apply_tables(p, point.channel_tables(op("gamma", value=1.18))), S.tables([gt] * 3))
    _px("pt_grayscale", point.grayscale, S.grayscale())
    _px("pt_sepia", point.sepia, S.sepia())
    _px("pt_curves", lambda p: point.apply_tables(p, point.channel_tables(CURVES)), S.tables(point.channel_tables(CURVES)))
    _px("pt_levels", lambda p: point.apply_tables(p, point.channel_tables(LEVELS)), S.tables(point.channel_tables(LEVELS)))
    _px("pt_white_point", lambda p: compiler.apply_plan(p, plan(op("white_point", red=200, green=220, blue=180)), W, H), S.white_point((200, 220, 180)))
    _px("pt_black_point", lambda p: compiler.apply_plan(p, plan(op("black_point", red=20, green=30, blue=10)), W, H), S.black_point((20, 30, 10)))
    _px("pt_temperature_tint", lambda p: point.temperature_tint(p, 0.3, -0.2), S.temperature_tint(0.3, -0.2))
    _px("pt_selective_color", lambda p: point.selective_color(p, 30.0, 60.0, 0.2, -0.1, 0.3, 0.15), S.selective(30.0, 60.0, (0.2, -0.1, 0.3), 0.15))
    _px("pt_hsl", lambda p: point.hsl(p, master=MASTER, **BANDS), S.hsl_adjust(MASTER, BANDS))
    _add("hsv_inspect", lambda s, d: _stepped(_stepped(point.with_hsv(embedding_pixels(s, d)), 3, "hue"), 5, "sat", "val").select("image_id", "y", "x", "hue", "sat", "val"), S.hsv())
    _px("flatten_white", lambda p: point.flatten_on_white(p).withColumns({c: F.col(c).cast("int") for c in "rgb"}), S.flatten())

    # masks
    _add("mask_blend", lambda s, d: mask.blend(embedding_pixels(s, d), point.brightness(embedding_pixels(s, d), 0.2), embedding_masks(s, d)).select(*PX), S.blend(0.2))
    _add("mask_blend_inverted", lambda s, d: compiler.apply_plan(embedding_pixels(s, d), plan(op("masked", operation=op("brightness", amount=0.2), mask="m", invert=True)), W, H, {"m": embedding_masks(s, d)}).select(*PX), S.blend(0.2, True))
    for mode, e in {"replace": "n.cov", "add": "greatest(b.cov, n.cov)", "subtract": "(b.cov * (255 - n.cov) + 127) // 255", "intersect": "(b.cov * n.cov + 127) // 255"}.items():
        _add(f"mask_compose_{mode}", lambda s, d, m=mode: mask.compose(embedding_masks(s, d), _second_mask(s, d), m).select(*MK), S.compose(e))
    _add("mask_union", lambda s, d: mask.union(embedding_masks(s, d).unionByName(_second_mask(s, d)), "mask_id").select(*MK), S.compose("greatest(b.cov, n.cov)"))
    _mk("mask_invert", mask.invert, S.mask_point("255 - cov"))
    _mk("mask_select_all", mask.select_all, S.mask_point("255"))
    _mk("mask_deselect", mask.deselect, S.mask_point("0"))
    _mk("mask_contrast", lambda m: mask.contrast(m, 1.7), S.mask_contrast(1.7))
    _mk("mask_feather", lambda m: mask.feather(window.clustered(m, key="mask_id"), 3), S.feather(3))
    _mk("mask_expand", lambda m: mask.expand(window.clustered(m, key="mask_id"), 2), S.morph(2, True))
    _mk("mask_contract", lambda m: mask.shrink(window.clustered(m, key="mask_id"), 2), S.morph(2, False))
    _mk("mask_expand_wide", lambda m: mask.expand(window.clustered(m, key="mask_id"), 24), S.morph(24, True))
    _mk("mask_smooth", lambda m: mask.smooth(window.clustered(m, key="mask_id"), 2), S.smooth(2))
    _mk("mask_border", lambda m: mask.border(window.clustered(m, key="mask_id"), 1), S.border(1))
    _mk("mask_refine", lambda m: mask.refine(window.clustered(m, key="mask_id"), 1, 2, 0.2, -1), S.refine(1, 2, 0.2, -1))
    _add("mask_diagnostics", lambda s, d: _rounded(aggregate.mask_diagnostics(embedding_masks(s, d)), 9, "average_coverage"), S.diagnostics().replace("avg(cov) / 255 as", "round(avg(cov) / 255, 9) as"))
    _add("mask_align_edges", lambda s, d: mask.align_to_edges(embedding_masks(s, d), embedding_pixels(s, d), 0.7).select(*MK), S.align(0.7))
    _mk("mask_resample", lambda m: geometry.resample_mask(m, W, H, 42, 100), S.resample(42, 100))
    _mk("thumb_area", lambda m: aggregate.area_thumbnail(m, W, H, 8, 20), S.thumbnail(8, 20))
    _add("rle_encode", lambda s, d: codec.runs(embedding_masks(s, d)).withColumn("run", F.col("run").cast("bigint")), S.rle())
    _mk("rle_round_trip", lambda m: codec.from_runs(codec.runs(m), W), S.mask_point("cov"))
    _mk("snapshot_round_trip", lambda m: codec.from_snapshots(codec.snapshots(m)), S.mask_point("cov"))
    _add("decontaminate", lambda s, d: mask.decontaminate(embedding_pixels(s, d), embedding_masks(s, d, 6.0), 0.6, 2).select(*PX), S.decontaminate_sql(0.6, 2))

    # statistics
    _add("hist_rgb", lambda s, d: aggregate.histogram(embedding_pixels(s, d)), S.histogram())
    _add("hist_full", lambda s, d: aggregate.histogram(embedding_pixels(s, d), zeros=True), S.histogram_full())
    _add("hist_luma", lambda s, d: aggregate.luminance_histogram(embedding_pixels(s, d)), S.luminance_histogram())
    _add("hist_clipping", lambda s, d: aggregate.clipping(embedding_pixels(s, d)), S.clipping())
    _add("trimmed_mean", lambda s, d: _stepped(aggregate.trimmed_means(embedding_pixels(s, d)), 3, "mean"), S.trimmed_mean())
    _px("white_balance", lambda p: aggregate.auto_white_balance(p, 0.66), S.white_balance(0.66))
    _add("percentile_spread", lambda s, d: _rounded(aggregate.percentiles(embedding_pixels(s, d)), 5, "spread"), S.percentile())
    _add("color_cast", lambda s, d: _rounded(aggregate.colour_cast(embedding_pixels(s, d)), 5, "average_luminance", "red_bias", "green_bias", "blue_bias"), S.colour_cast())
    _add("laplacian_stats", lambda s, d: _rounded(aggregate.spatial(window.clustered(embedding_pixels(s, d))), 6, "noise", "sharpness", "local_contrast", "edge_density"), S.spatial())
    _add(
        "analysis_row",
        lambda s, d: _rounded(_rounded(aggregate.analysis(window.clustered(embedding_pixels(s, d))), 5, "average_luminance", "luminance_spread"), 6, "noise", "sharpness", "local_contrast", "edge_density", "white_background_ratio").drop("red_bias", "green_bias", "blue_bias"),
        S.analysis(),
    )

    # neighbourhoods
    _add("box_blur", lambda s, d: window.box_blur(window.clustered(embedding_pixels(s, d)).withColumn("l", F.expr(_luma())), "l", 2, "v", size=(W, H)).select("image_id", "y", "x", "v"), S.box_blur(2))
    _px("local_contrast", lambda p: window.local_contrast(window.clustered(p), 0.32, 8, 1.4, (W, H)), S.local_contrast(0.32, 8, 1.4))
    _px("edge_sharpen", lambda p: window.edge_aware_sharpen(window.clustered(p), 0.46, 1.2, 0.035, (W, H)), S.sharpen(0.46, 1.2, 0.035))
    _px("mild_deblur", lambda p: window.mild_deblur(window.clustered(p), 0.38, 1.2, (W, H)), S.mild_deblur(0.38, 1.2))
    _px("uneven_lighting", lambda p: window.uneven_lighting(window.clustered(p), 0.62, 6.0, (W, H)), S.uneven(0.62, 6.0))
    _px("deblock", lambda p: window.deblock(window.clustered(p), 0.58), S.deblock(0.58))
    _px("denoise3", lambda p: window.denoise(window.clustered(p), 0.34, 0.84, (W, H)), S.denoise(0.34, 0.84))
    _px("denoise5", lambda p: window.denoise(window.clustered(p), 0.8, 0.7, (W, H)), S.denoise(0.8, 0.7))
    _px("gaussian_blur", lambda p: window.gaussian_blur(window.clustered(p), 1.0, (W, H)), S.gaussian(1.0))
    _px("sharpen", lambda p: window.sharpen(window.clustered(p), 0.45, (W, H)), S.unsharp(0.45))
    _px("document_enhance", lambda p: compiler.apply_plan(p, presets.PRESETS["document_grayscale"], W, H), S.document(0.76, True))
    _px("conservative_restore", lambda p: compiler.apply_plan(p, presets.PRESETS["conservative_restore"], W, H), S.chain(S.white_balance(0.42), S.local_contrast(0.26, 40, 1.25), S.denoise(0.22, 0.86), S.sharpen(0.3, 1.1, 0.04)))

    # geometry
    _px("geo_reflect", lambda p: geometry.reflect_horizontal(p, W), S.reflect())
    for deg in (90, 180, 270):
        _px(f"geo_rotate{deg}", lambda p, v=deg: geometry.rotate(p, v, W, H), S.rotate(deg))
    _px("geo_crop", lambda p: geometry.crop(p, 0.25, 0.1, 0.5, 0.6, W, H), S.crop(*geometry.crop_box(0.25, 0.1, 0.5, 0.6, W, H)))
    _px("geo_straighten", lambda p: geometry.straighten(p, 7.0, W, H), S.straighten(7.0))
    _px("geo_perspective", lambda p: geometry.perspective(p, CORNERS, W, H), S.perspective(CORNERS))
    _px("geo_lens", lambda p: geometry.lens_correction(p, 0.08, -0.3, 0.02, W, H), S.lens(0.08, -0.3, 0.02))
    for name, o, sql in (
        ("deblock", op("deblock", strength=0.58), S.deblock(0.58)), ("denoise", op("denoise", strength=0.34, preserve_edges=0.84), S.denoise(0.34, 0.84)), ("white_balance", op("auto_white_balance", strength=0.66), S.white_balance(0.66)),
        ("local_contrast", op("local_contrast", strength=0.32, tile_size=8, clip_limit=1.4), S.local_contrast(0.32, 8, 1.4)), ("mild_deblur", op("mild_deblur", strength=0.38, radius=1.2), S.mild_deblur(0.38, 1.2)),
        ("uneven_lighting", op("uneven_lighting_correction", strength=0.62, radius=6), S.uneven(0.62, 6.0)), ("document", op("document_enhance", strength=0.76, grayscale=True), S.document(0.76, True)),
        ("straighten", op("straighten", degrees=7), S.straighten(7.0)), ("perspective", op("perspective", corners=CORNERS), S.perspective(CORNERS)), ("rotate90", op("rotate", degrees=90), S.rotate(90)),
        ("lens", op("lens_correction", distortion=0.08, vignetting=-0.3, chromatic_aberration=0.02), S.lens(0.08, -0.3, 0.02)),
    ):
        _px(f"packed_{name}", lambda p, v=o: unpack(packed.apply_packed(pack(p, (W, H)), v)), sql)
    masks = lambda f: lambda m: spread_bytes(f(kernels.pack_masks(m)), "mask_id", "cov", ("cov",))
    _mk("packed_fill_holes", masks(packed.fill_holes), S.fill_holes())
    _mk("packed_remove_islands", masks(lambda m: packed.remove_islands(m, 6)), S.remove_islands(6))
    _mk("packed_thumbnail", masks(lambda m: packed.thumbnail(m, 8, 20)), S.thumbnail(8, 20))
    for eight, tolerance in ((False, 0.2), (True, 0.15)):
        wand = lambda s, d, e=eight, t=tolerance: spread_bytes(packed.wand(pack(embedding_pixels(s, d)), SEED, t, eight=e).withColumnRenamed("image_id", "mask_id"), "mask_id", "cov", ("cov",)).select(*MK)
        _add(f"packed_wand{8 if eight else 4}", wand, S.wand_region(SEED, tolerance, eight) if eight else S.wand_region(SEED, tolerance))
    _px("pack_round_trip", lambda p: unpack(pack(p)), f"{S.P} select * from pix")

    # shapes and selections
    g = lambda s: rasterize.grid(s, 1, W, H)
    _add("rast_rectangle", lambda s, d: rasterize.rectangle(g(s), W, H, (16.3, 40.75), (2.6, 5.2)), S.rectangle(W, H, 2.6, 5.2, 16.3, 40.75))
    _add("rast_ellipse", lambda s, d: rasterize.ellipse(g(s), W, H, (2.0, 4.0), (19.0, 45.0)), S.ellipse(W, H, 10.5, 24.5, 8.5, 20.5))
    _add("rast_polygon", lambda s, d: rasterize.polygon(g(s), POLYGON), S.polygon(W, H, POLYGON))
    _add("rast_freehand", lambda s, d: rasterize.freehand(g(s), POLYGON), S.polygon(W, H, POLYGON))
    _add("rast_brush", lambda s, d: rasterize.brush(g(s), W, H, STROKE, DIAMETER, HARDNESS, OPACITY), S.dabs(W, H, rasterize.brush_samples(STROKE, DIAMETER, OPACITY), HARDNESS))
    _add("wand_global", lambda s, d: mask.wand_everywhere(embedding_pixels(s, d), WAND, 0.08).select(*MK), S.wand_global(WAND, 0.08))
    _add("wand_contiguous", lambda s, d: regions.wand_region(embedding_pixels(s, d), SEED, 0.2), S.wand_region(SEED, 0.2))
    _add("wand_contiguous8", lambda s, d: regions.wand_region(embedding_pixels(s, d), SEED, 0.15, eight=True), S.wand_region(SEED, 0.15, True))
    _add("color_range", lambda s, d: mask.color_range(embedding_pixels(s, d), SAMPLES, 0.12, 0.8, 0.6, 0.7).select(*MK), S.color_range(SAMPLES, 0.12, 0.8, 0.6, 0.7, mask.linear_table()))
    _mk("fill_holes", regions.fill_holes, S.fill_holes())
    _mk("remove_islands", lambda m: regions.remove_islands(m, 6), S.remove_islands(6))

    for mode in overlay.MODES:
        _add(f"overlay_{mode}", lambda s, d, v=mode: overlay.overlay(embedding_masks(s, d), W, H, 30, 40, v, (200, 30, 90), 0.6, 3), S.overlay(30, 40, mode, (200, 30, 90), 0.6, 3))
    _add("brush_pressure", _pressure, S.PRESSURE)

    # plans, time and names
    _add("plan_rules", _plan_rules, plan_sql.rules(REQUESTS))
    _add("plan_validate", lambda s, d: planner.check_plans(_plan_rules(s, d)).groupBy("status", "valid").agg(F.count("*").alias("n")), plan_sql.checked(REQUESTS))
    _add("history_sessions", lambda s, d: sessions.coalesced(s.read.parquet(f"{d}/events.parquet"), ["user_id", "event_type"], "ts", 12 * 3_600_000, "event_id"), S.SESSIONS)
    _add("embedded_reconcile", _reconcile, S.RECONCILE)
    _add("latest_request", lambda s, d: sessions.latest_requests(s.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id"), S.LATEST)
    _add("history_timeline", lambda s, d: sessions.timeline(s.read.parquet(f"{d}/events.parquet").select("event_id", "user_id"), "user_id", "event_id", 3), S.TIMELINE)
    _add("batch_skip_existing", _batch_names, S.BATCH)
    _add("workflow_search", _workflow_search, S.SEARCH)
    workspace_catalog.register(_add)


def _luma() -> str:
    from .functions.color import luma, u8

    return u8(luma())


#: Requests that each touch one rule or a few; fixed values.
REQUESTS = (
    "make it brighter", "this is too bright", "too dark and too bright", "yellow indoor lighting", "washed out", "harsh contrast", "grainy", "jpeg artifacts", "slight blur",
    "sharpen", "page shadow", "scan of a receipt in black and white", "old photo", "keep colors", "improve without changing colors, please", "hello there", "   ",
    "Old photo: faded, noisy!! and blurry; lift   shadows", "keep colors but fix the yellow, make text crisper",
)


def _analyses(p: DataFrame) -> DataFrame:
    a = aggregate.analysis(window.clustered(p))
    r = _rounded(a, 4, "average_luminance", "local_contrast", "noise")
    return r.select("image_id", F.col("average_luminance").alias("lum"), F.col("local_contrast").alias("con"), "noise", "dominant", "likely_document")


def _plan_rules(spark, d: str) -> DataFrame:
    asked = F.element_at(F.lit(list(REQUESTS)), F.expr(f"cast((image_id * 7 + k) % {len(REQUESTS)} as int) + 1"))
    p = embedding_pixels(spark, d)
    a = _analyses(p)
    req = p.select("image_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(REQUESTS) - 1))))
    req = req.select("image_id", F.expr("image_id * 100 + k").alias("request_id"), asked.alias("text"))
    return planner.plans(req, a)


def _pressure(spark, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return overlay.pressed(e.select("event_id", F.expr("case when event_type in ('click', 'view') then 'pen' else 'mouse' end").alias("pointer"), (F.col("value") / 100).alias("pressure")), 48.0, 0.9).select("event_id", "diameter", "opacity")


def _reconcile(spark, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    o = spark.read.parquet(f"{d}/orders.parquet")
    o = o.select(F.col("o_custkey").alias("plan_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("bigint").alias("idx"), F.col("o_orderpriority").alias("sig"))
    return sessions.reconcile(o.filter("idx % 2 = 1"), o.filter("idx % 2 = 0"))


def _batch_names(spark, d: str) -> DataFrame:
    from .operators import batch

    p = spark.read.parquet(f"{d}/part.parquet")
    files = p.select(F.expr("concat('/in/', translate(p_name, ' ', '#'), '_', cast(p_partkey div 2 as string), case when p_partkey % 2 = 0 then '.PNG' else '.jpeg' end)").alias("path"))
    there = p.filter("p_partkey % 10 = 3").select(F.expr("concat(translate(p_name, ' ', '_'), '_', cast(p_partkey div 2 as string), '-out.png')").alias("target"))
    return batch.planned(files, there, "{name}-out", "lossless", "w")


def _workflow_search(spark, d: str) -> DataFrame:
    from .operators import batch

    p = spark.read.parquet(f"{d}/part.parquet")
    w = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("folder"), (F.col("p_size") > 40).alias("favorite"))
    return batch.search(w, "AN")


def queries():
    if not FOUND:
        _register()
    return {k: _with_code(v[0]) for k, v in FOUND.items()}


def _with_code(query):
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def oracle_sql():
    if not FOUND:
        _register()
    return {k: v[1] for k, v in FOUND.items() if v[1]}
