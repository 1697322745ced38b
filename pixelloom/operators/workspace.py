"""What surrounds editing, as tables: observations, inspection, comparisons, shortcuts, histories, progress, batch reports, and
checks of options, external plans and geometry. Rows that fail a check say why; they stop nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.color import div, f32, u8
from ..functions.names import quoted

MOST_OBSERVATIONS, MOST_RECENT, MOST_PROMPT = 4, 25, 1000
MOST_FAILURES, MOST_SAMPLES, MS_A_FILE = 100, 12, 250
MOST_WORKERS, MOST_TEMPLATE = 8, 180


def observations(analyses: DataFrame) -> DataFrame:
    """(image_id, observations) of analysis rows (aggregate.analysis): at most four findings, in their order."""
    found = [
        ("average_luminance < 0.34", "Image appears slightly dark"),
        ("average_luminance > 0.78", "Image appears quite bright"),
        ("dominant = 'warm'", "Warm color cast detected"),
        ("dominant = 'cool'", "Cool color cast detected"),
        ("dominant = 'green'", "Green color cast detected"),
        ("noise > 0.24", "Moderate high-frequency noise estimate"),
        ("sharpness < 0.025 and luminance_spread > 0.15", "Image may be slightly soft"),
        ("local_contrast < 0.035 and luminance_spread > 0.1", "Local contrast appears restrained"),
        ("likely_document", "Possible photographed document"),
    ]
    listed = ", ".join(f"case when {c} then {quoted(t)} end" for c, t in found)
    out = f"transform(array(filter(array({listed}), x -> x is not null)), a -> if(size(a) = 0, array('No strong restoration need detected'), slice(a, 1, {MOST_OBSERVATIONS})))[0]"
    return analyses.select("image_id", F.expr(out).alias("observations"))


def inspected(p: DataFrame, x: int, y: int, apply=None) -> DataFrame:
    """The pixels at one place of every picture, through ``apply``, a chain of point operations.

    The filter stands before the chain: point operations need no other pixels.
    """
    at = p.filter((F.col("x") == x) & (F.col("y") == y))
    return at if apply is None else apply(at)


def picked_point(p: DataFrame, x: int, y: int, white: bool) -> DataFrame:
    """Every picture with the white (or black) point taken from its own pixel there.

    A pixel with a zero channel cannot be a white point; its picture stays as it is, as does one without such a pixel.
    """
    bad = "least(_pr, _pg, _pb) = 0" if white else "false"
    pick = inspected(p, x, y).select("image_id", *[F.col(c).alias(f"_p{c}") for c in "rgb"])
    new = (lambda c: div(f"{f32(c)} * {f32(255.0)}", f32(f"_p{c}"))) if white else (lambda c: f"{f32(c)} - {f32(f'_p{c}')}")
    moved = lambda c: f"case when _pr is null or {bad} then {c} else {u8(new(c))} end"
    return p.join(pick, "image_id", "left").select("image_id", "y", "x", *[F.expr(moved(c)).alias(c) for c in "rgb"], "a")


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """(image_id, y, x, dr, dg, db): absolute differences of the pixels that both have."""
    b = after.select("image_id", "y", "x", *[F.col(c).alias(f"_{c}") for c in "rgb"])
    return before.join(b, ["image_id", "y", "x"]).select("image_id", "y", "x", *[F.abs(F.col(c) - F.col(f"_{c}")).alias(f"d{c}") for c in "rgb"])


def histogram_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """(image_id, channel, bin, n_before, n_after) of two histograms (image_id, channel, bin, n)."""
    keys = ["image_id", "channel", "bin"]
    out = before.withColumnRenamed("n", "n_before").join(after.withColumnRenamed("n", "n_after"), keys, "full")
    return out.select(*keys, F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))


def shortcut_key(keys: str) -> str:
    """SQL: lower case without blanks, empty parts between plus signs left out; a lone + or - stays."""
    bare = f"regexp_replace(lower({keys}), '\\\\s+', '')"
    return f"if({bare} in ('+', '-'), {bare}, array_join(filter(split({bare}, '[+]'), x -> x != ''), '+'))"


def shortcut_conflicts(bindings: DataFrame) -> DataFrame:
    """(set_id, place, action, problem) of bindings (set_id, place, action, keys) that have no key, or one taken before."""
    q = bindings.withColumn("_key", F.expr(shortcut_key("coalesce(keys, '')")))
    first = F.first(F.struct("place", "action")).over(Window.partitionBy("set_id", "_key").orderBy("place"))
    q = q.withColumn("_first", first)
    problem = "case when _key = '' then concat(action, ' has no shortcut.') when _first.place < place then concat(_first.action, ' and ', action, ' both use ', keys, '.') end"
    return q.withColumn("problem", F.expr(problem)).filter("problem is not null").select("set_id", "place", "action", "problem")


def recent_requests(asked: DataFrame) -> DataFrame:
    """(user_id, place, prompt, provider) of requests (user_id, at, prompt, provider): the latest 25 of each user.

    A request is known by its text, whatever the case, and its provider; the last spelling counts. Blank ones are left out.
    """
    q = asked.withColumn("prompt", F.expr(f"left(trim(prompt), {MOST_PROMPT})")).filter("prompt != ''")
    last = q.groupBy("user_id", F.lower("prompt").alias("_key"), "provider").agg(F.max(F.struct("at", "prompt")).alias("last"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last.at")))
    return last.withColumn("place", place).filter(F.col("place") <= MOST_RECENT).select("user_id", "place", F.col("last.prompt").alias("prompt"), "provider")


def debounced(events: DataFrame, key: str, at: str, wait_ms: int, *ties: str) -> DataFrame:
    """events that are followed by none of their key within wait_ms: those that a trailing debounce lets through."""
    following = F.lead(at).over(Window.partitionBy(key).orderBy(at, *ties))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp_ltz")) if isinstance(c, str) else c
    q = events.withColumn("_next", following)
    return q.filter(F.col("_next").isNull() | (us("_next") - us(at) >= wait_ms * 1000)).drop("_next")


def progress(updates: DataFrame, key: str, order: str, share: str, state: str) -> DataFrame:
    """updates with ``shown`` and ``shown_state``: a share that never falls, and the first end state, which nothing replaces."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.when(F.col(state).isin("completed", "cancelled", "failed"), F.col(state))
    ended = F.first(end, ignorenulls=True).over(w)
    before = F.first(end, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(share)))
    counted = F.when(before.isNull(), F.when(F.col(state) == "completed", 1.0).otherwise(clipped))
    q = updates.withColumns({"shown_state": F.coalesce(ended, F.col(state)), "_counted": counted})
    return q.withColumn("shown", F.max("_counted").over(w)).drop("_counted")


def geometry_intent(changed: str, pending: str, active: str, running: str, following: str, cancelled: str = "false") -> str:
    """SQL: what a new geometry edit does to a waiting one: queue, cancel_pending or reject. Keys match if both are there."""
    same = lambda a: f"coalesce({a} != '' and {a} = {following}, false)"
    return f"case when {cancelled} then 'reject' when {running} and {same(active)} then 'queue' when {same(pending)} then if({changed}, 'queue', 'cancel_pending') else 'reject' end"


def drag_bounds(x0: str, y0: str, x1: str, y1: str, width: int, height: int, fixed_aspect: bool = False, from_centre: bool = False) -> dict[str, Column]:
    """left, top, right and bottom of a drag from (x0, y0) to (x1, y1), within the picture."""
    dx, dy = f"({x1} - {x0})", f"({y1} - {y0})"
    if fixed_aspect:
        size = f"greatest(abs({dx}), abs({dy}))"
        dx, dy = (f"(if({d} < 0, -1, 1) * {size})" for d in (dx, dy))
    if from_centre:
        ends = (f"{x0} - abs({dx})", f"{y0} - abs({dy})", f"{x0} + abs({dx})", f"{y0} + abs({dy})")
    else:
        ends = (f"least({x0}, {x0} + {dx})", f"least({y0}, {y0} + {dy})", f"greatest({x0}, {x0} + {dx})", f"greatest({y0}, {y0} + {dy})")
    limits = ("greatest(0D, {})", "greatest(0D, {})", f"least({float(width)!r}D, {{}})", f"least({float(height)!r}D, {{}})")
    return {k: F.expr(v.format(e)) for k, e, v in zip(("left", "top", "right", "bottom"), ends, limits, strict=True)}


def confidence_label(c: str) -> str:
    return f"case when {c} >= 0.78 then 'High' when {c} >= 0.55 then 'Medium' else 'Low' end"


#: Range, step and noun of the one value that a plan's step shows; fixed values.
CONTROLS = {
    "brightness": (-0.5, 0.5, "amount"), "contrast": (-0.5, 0.5, "amount"), "saturation": (-1.0, 1.0, "amount"), "auto_white_balance": (0.0, 1.0, "strength"), "denoise": (0.0, 1.0, "strength"),
    "deblock": (0.0, 1.0, "strength"), "mild_deblur": (0.0, 1.0, "strength"), "document_enhance": (0.0, 1.0, "strength"), "uneven_lighting_correction": (0.0, 1.0, "strength"),
    "local_contrast": (0.0, 1.0, "strength"), "edge_aware_sharpen": (0.0, 2.0, "strength"),
}


def value_controls(plans: DataFrame) -> DataFrame:
    """(request_id, place, type, value, low, high, noun) of the steps of plans (request_id, operations)."""
    step = plans.filter("operations is not null").select("request_id", F.posexplode(F.split("operations", ";")).alias("place", "step"))
    q = step.select("request_id", "place", F.expr("split(step, ':')[0]").alias("type"), F.expr("str_to_map(split(step, ':')[1], ',', '=')").alias("_p"))
    pick = lambda k: F.expr("case type " + " ".join(f"when '{t}' then {v[k]!r}{'D' if k < 2 else ''}" for t, v in CONTROLS.items()) + " end")
    return q.select("request_id", "place", "type", pick(2).alias("noun"), pick(0).alias("low"), pick(1).alias("high"), "_p").withColumn("value", F.expr("cast(_p[noun] as double)")).drop("_p").filter("noun is not null")


def merged_capabilities(sets: DataFrame, key: str, one: str, two: str) -> DataFrame:
    """(key, capabilities): both lists' entries once each, sorted."""
    none = "cast(array() as array<string>)"
    return sets.select(key, F.expr(f"array_sort(array_union(coalesce({one}, {none}), coalesce({two}, {none})))").alias("capabilities"))


def batch_preview(planned: DataFrame) -> DataFrame:
    """One row: discovered, skipped_existing, estimated_ms and the first twelve targets of planned files (idx, target, status)."""
    few = F.expr(f"transform(array_sort(collect_list(case when idx < {MOST_SAMPLES} then struct(idx, target) end)), x -> x.target)").alias("sample_outputs")
    return planned.agg(F.count("*").alias("discovered"), F.count_if(F.col("status") == "skipped").alias("skipped_existing"), (F.count("*") * MS_A_FILE).alias("estimated_ms"), few)


def batch_status(log: DataFrame, elapsed_ms: int) -> DataFrame:
    """One row of counters of a log (status), with the time that the rest will take at the pace so far."""
    n = lambda s: F.count_if(F.col("status") == s)
    q = log.agg(F.count("*").alias("discovered"), n("ok").alias("completed"), n("skipped").alias("skipped"), n("failed").alias("failed"))
    done = "completed + skipped + failed"
    return q.withColumn("estimated_remaining_ms", F.expr(f"case when {done} > 0 then ({elapsed_ms} div ({done})) * (discovered - ({done})) end"))


def batch_log(log: DataFrame) -> DataFrame:
    """(idx, line): a log's lines, tabs between; OK and SKIPPED with both paths, FAILED with the reason."""
    line = "case status when 'ok' then concat_ws('\\t', 'OK', path, target) when 'skipped' then concat_ws('\\t', 'SKIPPED', path, target) when 'failed' then concat_ws('\\t', 'FAILED', path, coalesce(error, 'no output name')) end"
    return log.select("idx", F.expr(line).alias("line")).filter("line is not null")


def options_error(source: str, target: str, workers: str, template: str) -> str:
    """SQL: what is wrong with a batch's options, or null."""
    blank = lambda c: f"coalesce(trim({c}), '') = ''"
    return (
        f"case when {blank(source)} or {blank(target)} then 'input and output folders are required' when {workers} is null or {workers} not between 1 and {MOST_WORKERS} then 'worker count is out of range' "
        f"when {blank(template)} or octet_length({template}) > {MOST_TEMPLATE} or {template} rlike '[/\\\\\\\\]' then 'filename template is empty, too long, or contains a path separator' end"
    )


def output_error(source: str, target: str) -> str:
    """SQL: what is wrong with an output path, or null: it must be absolute, name a known picture, and not be the source."""
    known = f"lower({target}) rlike '[^/][.](png|jpg|jpeg|webp)$'"
    return f"case when {target} is null or not startswith({target}, '/') or endswith({target}, '/') then 'not an absolute file path' when not {known} then 'unknown ending' when {target} = {source} then 'would replace its source' end"


def layout_error(version: str, name: str, left: str, right: str, scale: str) -> str:
    """SQL: what is wrong with a workspace's layout, or null."""
    return f"case when {version} != 1 then 'unsupported version' when trim({name}) = '' or {left} not between 180 and 800 or {right} not between 240 and 900 or {scale} not between 0.75 and 2.0 then 'dimensions or scale are invalid' end"


def mean_times(samples: DataFrame, key: str, ns: str) -> DataFrame:
    """(key, samples, mean_ns): whole nanoseconds."""
    return samples.groupBy(key).agg(F.count(ns).alias("samples"), F.expr(f"sum({ns}) div count({ns})").alias("mean_ns"))
