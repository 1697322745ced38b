"""The rules from requests to plans as DuckDB SQL, with their own statement of phrases, conditions and parameters."""

from __future__ import annotations

from . import catalog_sql as S

#: What a request must contain, as alternatives; fixed values.
FLAGS = """
  regexp_matches(norm, 'too dark|underexposed|brighten|brighter|lighter|increase brightness|lift shadows') as up,
  regexp_matches(norm, 'too bright|overexposed|darken|darker|dim this|reduce brightness') as down,
  regexp_matches(norm, 'without changing colors|keep colors|preserve colors') as same,
  regexp_matches(norm, 'improve without changing colors|improve while preserving colors') as better,
  regexp_matches(norm, 'yellow|warm cast|too warm|blue cast|too blue|too cool|indoor lighting|white balance|colors more natural|natural colors') as tint,
  regexp_matches(norm, 'washed out|flat|faded|weak contrast|bring out|more readable') as dull,
  regexp_matches(norm, 'too much contrast|harsh contrast|reduce contrast') as hard,
  regexp_matches(norm, 'grainy|noisy|reduce noise|remove noise|sensor noise') as grain,
  regexp_matches(norm, 'compression|jpeg|blocky|blocking artifacts|jpeg artifacts') as blocks,
  regexp_matches(norm, 'blurry|blurred|soft|slight blur|camera shake') as shaken,
  regexp_matches(norm, 'sharpen|more detail|crisper|clearer edges') as crisp,
  regexp_matches(norm, 'uneven lighting|uneven illumination|page shadow|lighting gradient|shadow across') as shade,
  regexp_matches(norm, 'document|receipt|scan|reading|writing|handwriting|notes|worksheet|whiteboard|text') as page,
  regexp_matches(norm, 'grayscale|black and white|monochrome') as grey,
  regexp_matches(norm, 'old photo|old scan|aged photo|restore photo') as aged"""

#: Condition, stage, operation and parameters of every step that a rule can emit, in the order of the rules; fixed values.
STEPS = (
    ("same and better", 40, "local_contrast", "strength=0.22,tile_size=40,clip_limit=1.15"),
    ("up and lum < 0.30", 30, "brightness", "amount=0.14"),
    ("up and lum >= 0.30 and lum < 0.72", 30, "brightness", "amount=0.08"),
    ("up and lum >= 0.72", 40, "local_contrast", "strength=0.24,tile_size=32,clip_limit=1.2"),
    ("down and lum > 0.78", 30, "brightness", "amount=-0.14"),
    ("down and lum > 0.25 and lum <= 0.78", 30, "brightness", "amount=-0.08"),
    ("down and lum <= 0.25", 40, "local_contrast", "strength=0.18,tile_size=32,clip_limit=1.1"),
    ("tint and not same and dominant = 'neutral'", 10, "auto_white_balance", "strength=0.38"),
    ("tint and not same and dominant <> 'neutral'", 10, "auto_white_balance", "strength=0.66"),
    ("dull and con < 0.04", 40, "local_contrast", "strength=0.46,tile_size=32,clip_limit=1.35"),
    ("dull and con >= 0.04", 40, "local_contrast", "strength=0.32,tile_size=32,clip_limit=1.35"),
    ("hard", 35, "contrast", "amount=-0.16"),
    ("grain and noise > 0.20", 55, "denoise", "strength=0.52,preserve_edges=0.84"),
    ("grain and noise <= 0.20", 55, "denoise", "strength=0.34,preserve_edges=0.84"),
    ("blocks", 50, "deblock", "strength=0.56"),
    ("blocks", 55, "denoise", "strength=0.16,preserve_edges=0.9"),
    ("shaken and noise > 0.18", 55, "denoise", "strength=0.22,preserve_edges=0.88"),
    ("shaken", 60, "mild_deblur", "strength=0.36,radius=1.2"),
    ("crisp and noise > 0.15", 65, "edge_aware_sharpen", "strength=0.3,radius=1.0,threshold=0.055"),
    ("crisp and noise <= 0.15", 65, "edge_aware_sharpen", "strength=0.3,radius=1.0,threshold=0.035"),
    ("shade", 20, "uneven_lighting_correction", "strength=0.64,radius=44.0"),
    ("page and likely_document and grey", 25, "document_enhance", "strength=0.72,grayscale=true"),
    ("page and likely_document and not grey", 25, "document_enhance", "strength=0.72,grayscale=false"),
    ("page and not likely_document and grey", 25, "document_enhance", "strength=0.62,grayscale=true"),
    ("page and not likely_document and not grey", 25, "document_enhance", "strength=0.62,grayscale=false"),
    ("aged and not same", 10, "auto_white_balance", "strength=0.42"),
    ("aged", 40, "local_contrast", "strength=0.3,tile_size=40,clip_limit=1.25"),
    ("aged", 55, "denoise", "strength=0.24,preserve_edges=0.86"),
    ("aged", 65, "edge_aware_sharpen", "strength=0.26,radius=1.1,threshold=0.045"),
)
LAST_RESORT = (("true", 40, "local_contrast", "strength=0.24,tile_size=32,clip_limit=1.2"), ("noise > 0.12", 55, "denoise", "strength=0.2,preserve_edges=0.88"))
#: What is said about a step, and its name in summaries; fixed values.
SAID = {
    "brightness+": "Raises global luminance by a bounded amount.",
    "brightness-": "Reduces global luminance by a bounded amount.",
    "contrast-": "Softens the global difference between light and dark tones.",
    "auto_white_balance": "Uses trimmed channel statistics to reduce a broad color cast.",
    "local_contrast": "Improves nearby brightness differences without globally increasing contrast.",
    "denoise": "Reduces small pixel variation while weighting major edges more strongly.",
    "deblock": "Softens selected 8×8 boundary discontinuities conservatively.",
    "edge_aware_sharpen": "Raises contrast at captured edges while thresholding flatter regions.",
    "mild_deblur": "Applies bounded clarity restoration for slight softness; it does not recreate detail.",
    "document_enhance": "Runs a fixed, documented sequence for page lighting, contrast, noise, and text edges.",
    "uneven_lighting_correction": "Normalizes broad illumination variation using a low-frequency luminance estimate.",
}
NAMES = {"auto_white_balance": "auto white balance", "local_contrast": "local contrast", "deblock": "JPEG cleanup", "edge_aware_sharpen": "edge-aware sharpen", "mild_deblur": "mild deblur", "document_enhance": "document enhance", "uneven_lighting_correction": "uneven lighting"}
#: Warnings in the order of the rules; fixed values.
WARNED = (
    ("up and lum >= 0.72", "The image already appears bright, so the plan does not increase global brightness."),
    ("down and lum <= 0.25", "The image already appears dark, so the plan does not reduce global brightness."),
    ("tint and same", "Color correction was omitted because the request asks to preserve colors."),
    ("blocks", "JPEG cleanup can reduce visible blocks but cannot restore discarded data."),
    ("shaken", "Mild Deblur improves captured edge contrast; it cannot recover missing information."),
    ("crisp and noise > 0.15", "Sharpening is thresholded because the analysis estimates visible noise."),
    ("page", "Document enhancement increases local contrast and may reduce photographic realism."),
)
_CUT = "The request matched more edits than the safe plan limit; lower-priority steps were omitted."


def statement(requests: str, columns: str) -> str:
    """columns of plans (alias t) over the rows of ``requests`` (request_id, image_id, text), which may use ``an``."""
    head, _, _ = S.analysis().removeprefix("with ").rpartition("\nselect ")
    parts = [f"select request_id, {k} as pos, {stage} as stage, '{kind}' as kind, '{params}' as params from fl where {cond}" for k, (cond, stage, kind, params) in enumerate(STEPS)]
    rest = [f"select request_id, {100 + k}, {stage}, '{kind}', '{params}' from fell where {cond}" for k, (cond, stage, kind, params) in enumerate(LAST_RESORT)]
    said = " ".join(f"when kind || case when contains(params, 'amount=-') then '-' when starts_with(params, 'amount=') then '+' else '' end = '{k}' then '{v}'" for k, v in SAID.items())
    name = "case kind " + " ".join(f"when '{k}' then '{v}'" for k, v in NAMES.items()) + " else kind end"
    warned = ", ".join(f"case when {c} then '{w}' end" for c, w in WARNED)
    rules = " + ".join(f"cast({c} as integer)" for c in ("(same and better)", "up", "down", "tint", "dull", "hard", "grain", "blocks", "shaken", "crisp", "shade", "page", "aged"))
    return f"""with {head},
an as (select image_id, round(average_luminance, 4) as lum, round(local_contrast, 4) as con, round(noise, 4) as noise, dominant,
  (wb >= 0.30 and edge_density >= 0.015 and spread >= 0.20) as likely_document from cst join spa using (image_id) join pc using (image_id) join wh using (image_id)),
req as ({requests}),
nm as (select *, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as norm from req),
fl as (select *, {FLAGS} from nm join an using (image_id)),
s0 as ({' union all '.join(parts)}),
fell as (select * from fl where same and request_id not in (select request_id from s0)),
s1 as (select * from s0 union all {' union all '.join(rest)}),
s2 as (select *, row_number() over (partition by request_id, kind order by pos) as nth from s1),
s3 as (select *, row_number() over (partition by request_id order by stage, pos) as place, count(*) over (partition by request_id) as n from s2 where nth = 1),
pl as (select request_id, any_value(n) as n, string_agg(kind || ':' || params, ';' order by place) as operations, list(case {said} end order by place) as explanations, string_agg({name}, ', ' order by place) as names
  from s3 where place <= 8 group by request_id),
t as (select fl.request_id, fl.image_id, case when trim(fl.text) = '' or length(trim(fl.text)) > 1000 then 'invalid' when up and down then 'conflict' when pl.request_id is null then 'no_match' else 'ok' end as status,
  pl.operations, pl.explanations, case when page then 'Improve readability using a reviewable deterministic document plan.' else 'Apply a conservative deterministic plan using ' || pl.names || '.' end as summary,
  list_filter([{warned}, case when pl.n > 8 then '{_CUT}' end], lambda w: w is not null)[1:8] as warnings,
  round(least(0.92e0, 0.52e0 + least({rules} + case when x.asked is null then 0 else 1 end, 4) * 0.09e0), 4) as confidence
  from fl left join pl using (request_id) left join (select request_id as asked from fell) x on x.asked = fl.request_id)
select {columns} from t"""


def rules(texts: tuple[str, ...]) -> str:
    """Plans of canned requests for every picture, as the query plan_rules gives them."""
    listed = ", ".join("'" + t.replace("'", "''") + "'" for t in texts)
    req = f"select image_id, image_id * 100 + k as request_id, list_extract([{listed}], cast((image_id * 7 + k) % {len(texts)} as integer) + 1) as text from an, range({len(texts)}) r(k)"
    return statement(req, "request_id, image_id, status, case when status = 'ok' then operations end as operations, case when status = 'ok' then confidence end as confidence")


def checked(texts: tuple[str, ...]) -> str:
    """How many plans there are of each status, and whether they are valid: such plans as the rules make always are."""
    return f"select status, status = 'ok' as valid, count(*) as n from ({rules(texts)}) group by all"


ASKED = "select conv_id % 10 as image_id, conv_id * 1000 + turn as request_id, case when conv_id % 3 = 0 then 'make it crisper, the text is too dark. ' || text else text end as text from conversations"


def conversations() -> str:
    """Plans with all that is said about them, of all turns of conversations."""
    ok = lambda c: f"case when status = 'ok' then {c} end as {c}"
    told = lambda c: f"case when status = 'ok' then array_to_string({c}, ' | ') end as {c}"
    return statement(ASKED, f"request_id, image_id, status, {ok('operations')}, {ok('confidence')}, {ok('summary')}, {told('explanations')}, {told('warnings')}")
