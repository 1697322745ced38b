"""Requests in words, and what is known of a picture, to plans: rules as data, evaluated as SQL over requests x analyses.

A rule fires if one of its phrases occurs in the normalised request (as a substring); rules are tried in order and the first
operation of a type wins. Operations are then put in the order of their stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_REQUEST, MOST_OPERATIONS, MOST_WARNINGS = 1000, 8, 8
#: Pictures that requests without one of their own are put to.
MOST_SHARED = 1000

#: Phrases of each condition; fixed values.
PHRASES = {
    "lighter": ("too dark", "underexposed", "brighten", "brighter", "lighter", "increase brightness", "lift shadows"),
    "darker": ("too bright", "overexposed", "darken", "darker", "dim this", "reduce brightness"),
    "keep": ("without changing colors", "keep colors", "preserve colors"),
    "keep_improve": ("improve without changing colors", "improve while preserving colors"),
    "color": ("yellow", "warm cast", "too warm", "blue cast", "too blue", "too cool", "indoor lighting", "white balance", "colors more natural", "natural colors"),
    "weak": ("washed out", "flat", "faded", "weak contrast", "bring out", "more readable"),
    "harsh": ("too much contrast", "harsh contrast", "reduce contrast"),
    "noise": ("grainy", "noisy", "reduce noise", "remove noise", "sensor noise"),
    "jpeg": ("compression", "jpeg", "blocky", "blocking artifacts", "jpeg artifacts"),
    "blur": ("blurry", "blurred", "soft", "slight blur", "camera shake"),
    "sharpen": ("sharpen", "more detail", "crisper", "clearer edges"),
    "uneven": ("uneven lighting", "uneven illumination", "page shadow", "lighting gradient", "shadow across"),
    "document": ("document", "receipt", "scan", "reading", "writing", "handwriting", "notes", "worksheet", "whiteboard", "text"),
    "gray": ("grayscale", "black and white", "monochrome"),
    "old": ("old photo", "old scan", "aged photo", "restore photo"),
}
#: Stage of each operation in a finished plan; fixed values.
STAGES = {
    "auto_white_balance": 10, "uneven_lighting_correction": 20, "document_enhance": 25, "brightness": 30, "contrast": 35, "local_contrast": 40,
    "deblock": 50, "denoise": 55, "mild_deblur": 60, "edge_aware_sharpen": 65,
}

#: Rules in order: condition over flags, whether it counts as a match, and operations (condition, type, parameters). Thresholds,
#: parameters and their order are fixed values.
#: lum, con, noise, dominant and likely_document are of the picture.
RULES: list[tuple[str, bool, list[tuple[str, str, str]]]] = [
    ("keep and keep_improve", True, [("true", "local_contrast", "strength=0.22,tile_size=40,clip_limit=1.15")]),
    ("lighter", True, [
        ("lum < 0.30", "brightness", "amount=0.14"), ("lum >= 0.30 and lum < 0.72", "brightness", "amount=0.08"),
        ("lum >= 0.72", "local_contrast", "strength=0.24,tile_size=32,clip_limit=1.2"),
    ]),
    ("darker", True, [
        ("lum > 0.78", "brightness", "amount=-0.14"), ("lum > 0.25 and lum <= 0.78", "brightness", "amount=-0.08"),
        ("lum <= 0.25", "local_contrast", "strength=0.18,tile_size=32,clip_limit=1.1"),
    ]),
    ("color", True, [("not keep and dominant = 'neutral'", "auto_white_balance", "strength=0.38"), ("not keep and dominant != 'neutral'", "auto_white_balance", "strength=0.66")]),
    ("weak", True, [("con < 0.04", "local_contrast", "strength=0.46,tile_size=32,clip_limit=1.35"), ("con >= 0.04", "local_contrast", "strength=0.32,tile_size=32,clip_limit=1.35")]),
    ("harsh", True, [("true", "contrast", "amount=-0.16")]),
    ("noise_", True, [("noise > 0.20", "denoise", "strength=0.52,preserve_edges=0.84"), ("noise <= 0.20", "denoise", "strength=0.34,preserve_edges=0.84")]),
    ("jpeg", True, [("true", "deblock", "strength=0.56"), ("true", "denoise", "strength=0.16,preserve_edges=0.9")]),
    ("blur", True, [("noise > 0.18", "denoise", "strength=0.22,preserve_edges=0.88"), ("true", "mild_deblur", "strength=0.36,radius=1.2")]),
    ("sharpen", True, [("noise > 0.15", "edge_aware_sharpen", "strength=0.3,radius=1.0,threshold=0.055"), ("noise <= 0.15", "edge_aware_sharpen", "strength=0.3,radius=1.0,threshold=0.035")]),
    ("uneven", True, [("true", "uneven_lighting_correction", "strength=0.64,radius=44.0")]),
    ("document", True, [
        ("likely_document and gray", "document_enhance", "strength=0.72,grayscale=true"), ("likely_document and not gray", "document_enhance", "strength=0.72,grayscale=false"),
        ("not likely_document and gray", "document_enhance", "strength=0.62,grayscale=true"), ("not likely_document and not gray", "document_enhance", "strength=0.62,grayscale=false"),
    ]),
    ("old", True, [
        ("not keep", "auto_white_balance", "strength=0.42"), ("true", "local_contrast", "strength=0.3,tile_size=40,clip_limit=1.25"),
        ("true", "denoise", "strength=0.24,preserve_edges=0.86"), ("true", "edge_aware_sharpen", "strength=0.26,radius=1.1,threshold=0.045"),
    ]),
]
#: If colours are to be kept and nothing else came of it.
FALLBACK = [("true", "local_contrast", "strength=0.24,tile_size=32,clip_limit=1.2"), ("noise > 0.12", "denoise", "strength=0.2,preserve_edges=0.88")]


def normalised(text: str) -> str:
    """SQL: lower case, runs of anything but letters and digits as single spaces, none at the ends."""
    return f"trim(regexp_replace(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '))"


#: What is told about a step, by type and, for an amount, its sign; fixed values.
EXPLANATIONS = {
    ("brightness", "-"): "Reduces global luminance by a bounded amount.",
    ("brightness", "+"): "Raises global luminance by a bounded amount.",
    ("contrast", "-"): "Softens the global difference between light and dark tones.",
    ("contrast", "+"): "Increases the global difference between light and dark tones.",
    ("auto_white_balance", ""): "Uses trimmed channel statistics to reduce a broad color cast.",
    ("local_contrast", ""): "Improves nearby brightness differences without globally increasing contrast.",
    ("denoise", ""): "Reduces small pixel variation while weighting major edges more strongly.",
    ("deblock", ""): "Softens selected 8×8 boundary discontinuities conservatively.",
    ("edge_aware_sharpen", ""): "Raises contrast at captured edges while thresholding flatter regions.",
    ("mild_deblur", ""): "Applies bounded clarity restoration for slight softness; it does not recreate detail.",
    ("document_enhance", ""): "Runs a fixed, documented sequence for page lighting, contrast, noise, and text edges.",
    ("uneven_lighting_correction", ""): "Normalizes broad illumination variation using a low-frequency luminance estimate.",
}
#: Names of steps in a summary, where they are not the type itself; fixed values.
LABELS = {
    "auto_white_balance": "auto white balance", "local_contrast": "local contrast", "deblock": "JPEG cleanup", "edge_aware_sharpen": "edge-aware sharpen", "mild_deblur": "mild deblur",
    "document_enhance": "document enhance", "uneven_lighting_correction": "uneven lighting",
}
#: Conditions and texts of warnings, in the order of the rules; fixed values.
WARNINGS = [
    ("lighter and lum >= 0.72", "The image already appears bright, so the plan does not increase global brightness."),
    ("darker and lum <= 0.25", "The image already appears dark, so the plan does not reduce global brightness."),
    ("color and keep", "Color correction was omitted because the request asks to preserve colors."),
    ("jpeg", "JPEG cleanup can reduce visible blocks but cannot restore discarded data."),
    ("blur", "Mild Deblur improves captured edge contrast; it cannot recover missing information."),
    ("sharpen and noise > 0.15", "Sharpening is thresholded because the analysis estimates visible noise."),
    ("document", "Document enhancement increases local contrast and may reduce photographic realism."),
]
OMITTED = "The request matched more edits than the safe plan limit; lower-priority steps were omitted."
DOCUMENT_SUMMARY, SUMMARY = "Improve readability using a reviewable deterministic document plan.", "Apply a conservative deterministic plan using "


def plans(requests: DataFrame, analyses: DataFrame, explained: bool = False) -> DataFrame:
    """(request_id, image_id, status, operations, confidence) of each request for its picture.

    requests: (request_id, image_id, text); analyses: (image_id, lum, con, noise, dominant, likely_document). Where
    not both have an image_id, requests go to every analysis, of which there may then be MOST_SHARED. operations are "type:parameters" in order of stage. status is ok, conflict, no_match or invalid (an empty or too long request).
    Plans that are ``explained`` also have summary, explanations (one a step) and warnings.
    """
    q = requests.withColumn("norm", F.expr(normalised("coalesce(text, '')")))
    q = q.withColumns({("noise_" if n == "noise" else n): F.expr(" or ".join(f"contains(norm, '{p}')" for p in phrases)) for n, phrases in PHRASES.items()})
    if "image_id" in q.columns and "image_id" in analyses.columns:
        q = q.join(analyses, "image_id")
    elif analyses.limit(MOST_SHARED + 1).count() <= MOST_SHARED:
        q = q.crossJoin(F.broadcast(analyses))
    else:
        raise ValueError(f"requests for more than {MOST_SHARED} pictures must name their own")
    item = lambda rule, cond, kind, params: f"case when ({rule}) and ({cond}) then named_struct('stage', {STAGES[kind]}, 'type', '{kind}', 'params', '{params}') end"
    listed = [item(r, c, k, p) for r, _, ops in RULES for c, k, p in ops]
    q = q.withColumn("ops", F.expr(f"filter(array({', '.join(listed)}), o -> o is not null)"))
    matches = " + ".join(f"cast(({r}) as int)" for r, counts, _ in RULES if counts)
    q = q.withColumn("matches", F.expr(matches)).withColumn("fell", F.expr("keep and size(ops) = 0"))
    fallback = ", ".join(item("fell", c, k, p) for c, k, p in FALLBACK)
    q = q.withColumn("ops", F.expr(f"if(fell, filter(array({fallback}), o -> o is not null), ops)"))
    # the first of a type stays, at its place; then by stage, places breaking ties
    q = q.withColumn("ops", F.expr("filter(transform(ops, (o, i) -> named_struct('stage', o.stage, 'at', i, 'type', o.type, 'params', o.params)), o -> array_position(transform(ops, x -> x.type), o.type) = o.at + 1)"))
    q = q.withColumn("found", F.size("ops")).withColumn("ops", F.expr(f"slice(array_sort(ops), 1, {MOST_OPERATIONS})"))
    status = f"case when trim(coalesce(text, '')) = '' or char_length(trim(text)) > {MOST_REQUEST} then 'invalid' when lighter and darker then 'conflict' when size(ops) = 0 then 'no_match' else 'ok' end"
    q = q.withColumn("status", F.expr(status))
    keep = [c for c in ("request_id", "image_id") if c in q.columns]
    return q.select(
        *keep, "status",
        F.expr("case when status = 'ok' then array_join(transform(ops, o -> concat(o.type, ':', o.params)), ';') end").alias("operations"),
        F.expr("case when status = 'ok' then round(least(0.92D, 0.52D + least(matches + cast(fell as int), 4) * 0.09D), 4) end").alias("confidence"),
        *(_told() if explained else []),
    )


def _told() -> list:
    """Columns with what is told about a plan's steps."""
    text = lambda v: "'" + v.replace("'", "\\'") + "'"
    sign = "case when startswith(o.params, 'amount=-') then '-' when startswith(o.params, 'amount=') then '+' else '' end"
    each = " ".join(f"when o.type = '{k}' and {sign} = '{s}' then {text(v)}" for (k, s), v in EXPLANATIONS.items())
    label = "case o.type " + " ".join(f"when '{k}' then {text(v)}" for k, v in LABELS.items()) + " else o.type end"
    summary = f"if(document, {text(DOCUMENT_SUMMARY)}, concat({text(SUMMARY)}, array_join(transform(ops, o -> {label}), ', '), '.'))"
    raised = ", ".join([*[f"case when {c} then {text(v)} end" for c, v in WARNINGS], f"case when found > {MOST_OPERATIONS} then {text(OMITTED)} end"])
    warnings = f"slice(filter(array({raised}), w -> w is not null), 1, {MOST_WARNINGS})"
    told = {"summary": summary, "explanations": f"transform(ops, o -> case {each} end)", "warnings": warnings}
    return [F.expr(f"case when status = 'ok' then {e} end").alias(k) for k, e in told.items()]


def check_plans(p: DataFrame) -> DataFrame:
    """plans with ``valid``: not empty nor too long, types unique, stages never falling, no saturation of a grey result."""
    kinds = "transform(split(operations, ';'), o -> split(o, ':')[0])"
    stage = "element_at(map(" + ", ".join(f"'{k}', {v}" for k, v in STAGES.items()) + "), k)"
    stages = f"transform({kinds}, k -> {stage})"
    ok = f"operations is not null and size({kinds}) between 1 and {MOST_OPERATIONS} and size(array_distinct({kinds})) = size({kinds}) and array_sort({stages}) = {stages} and not (contains(operations, 'saturation:') and (array_contains({kinds}, 'grayscale') or contains(operations, 'grayscale=true')))"
    return p.withColumn("valid", F.expr(ok))
