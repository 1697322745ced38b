"""The queries of the catalog as DuckDB SQL, written on their own: no expression is shared with the Spark side except byte
tables, which are values."""

from __future__ import annotations

W, H = 21, 50


def n(v) -> str:
    """A single-precision number."""
    return f"cast({float(v)!r} as float)" if "e" in repr(float(v)) else f"cast({float(v)!r}e0 as float)"


def f(e: str) -> str:
    return f"cast({e} as float)"


def u8(e: str) -> str:
    return f"cast(greatest(0e0, least(255e0, floor(cast({e} as double) + 0.5e0))) as integer)"


def lum(r="r", g="g", b="b") -> str:
    return f"({n(0.2126)} * {f(r)} + {n(0.7152)} * {f(g)} + {n(0.0722)} * {f(b)})"


def clamp(e: str, lo: str, hi: str) -> str:
    return f"greatest({lo}, least({hi}, {e}))"


def tab(table, c: str) -> str:
    return f"cast(list_extract([{', '.join(map(str, table))}], {c} + 1) as integer)"


_q = lambda k: f"cast(greatest(0e0, least(255e0, floor((cast(embedding[3 * x + {k + 1}] as double) + 0.5e0) * 255e0))) as integer)"
PIX = f"""pix as (
  select cast(vec_id // {H} as bigint) as image_id, cast(vec_id % {H} as integer) as y, cast(x as integer) as x, {_q(0)} as r, {_q(1)} as g, {_q(2)} as b,
    cast(case when (x + vec_id % {H}) % 7 = 0 then 0 when (3 * x + vec_id % {H}) % 5 = 0 then 128 else 255 end as integer) as a
  from embeddings, range({W}) t(x))"""
MSK = "msk as (select image_id as mask_id, y, x, cast(greatest(0e0, least(255e0, floor((r - 127.5e0) * 3e0 + 127.5e0))) as integer) as cov from pix)"
MSK2 = "msk2 as (select image_id as mask_id, y, x, g as cov from pix)"
P, M, MM = f"with {PIX}", f"with {PIX}, {MSK}", f"with {PIX}, {MSK}, {MSK2}"


def point(r: str, g: str, b: str, where: str = "") -> str:
    return f"{P} select image_id, y, x, {r} as r, {g} as g, {b} as b, a from pix {where}"


def each(e) -> str:
    return point(*[e(c, k) for k, c in enumerate("rgb")])


def brightness(v):
    return each(lambda c, _: u8(f"{f(c)} + {n(v)} * {n(255)}"))


def contrast(v):
    return each(lambda c, _: u8(f"({f(c)} - {n(127.5)}) * ({n(1)} + {n(v)}) + {n(127.5)}"))


def saturation(v):
    return each(lambda c, _: u8(f"{lum()} + ({f(c)} - {lum()}) * ({n(1)} + {n(v)})"))


def grayscale():
    return each(lambda c, _: u8(lum()))


def sepia():
    rows = ((0.393, 0.769, 0.189), (0.349, 0.686, 0.168), (0.272, 0.534, 0.131))
    return each(lambda c, k: u8(" + ".join(f"{n(w)} * {f(x)}" for w, x in zip(rows[k], "rgb", strict=True))))


def tables(t):
    return each(lambda c, k: tab(t[k], c))


def white_point(v):
    return each(lambda c, k: u8(f"{f(c)} * {n(255)} / {n(max(v[k], 1))}"))


def black_point(v):
    return each(lambda c, k: u8(f"{f(c)} - {n(v[k])}"))


def temperature_tint(t, i):
    gains = (f"({n(1)} + {n(t)} * {n(0.25)} + {n(i)} * {n(0.05)})", f"({n(1)} - {n(i)} * {n(0.18)})", f"({n(1)} - {n(t)} * {n(0.25)} + {n(i)} * {n(0.05)})")
    return each(lambda c, k: u8(f"{f(c)} * {gains[k]}"))


_UNIT = f"unit as (select *, {f('r')} / {n(255)} as fr, {f('g')} / {n(255)} as fg, {f('b')} / {n(255)} as fb from pix), ext as (select *, greatest(fr, fg, fb) as hi, least(fr, fg, fb) as lo, greatest(fr, fg, fb) - least(fr, fg, fb) as d from unit)"
_EPS = n(1.1920928955078125e-07)


def _hue(unit: str) -> str:
    return (
        f"case when d <= {_EPS} then {n(0)} when hi = fr then {unit} * (case when (fg - fb) / d < 0 then (fg - fb) / d + {n(6)} else (fg - fb) / d end) "
        f"when hi = fg then {unit} * ((fb - fr) / d + {n(2)}) else {unit} * ((fr - fg) / d + {n(4)}) end"
    )


_HSL = f"""{_UNIT}, hsl0 as (select *, (hi + lo) * {n(0.5)} as light, {_hue(n(60))} as hue from ext),
hsl as (select *, case when d <= {_EPS} then {n(0)} else d / greatest({n(1)} - abs({n(2)} * light - {n(1)}), {_EPS}) end as sat from hsl0)"""


def hsv():
    near = lambda e, k: f"floor(cast({e} as double) * {k}e0 + 0.5e0) / {k}e0"
    return f"with {PIX}, {_UNIT} select image_id, y, x, {near(_hue(n(60)), 1000)} as hue, {near(f'case when hi <= {_EPS} then {n(0)} else d / hi end', 100000)} as sat, {near('hi', 100000)} as val from ext"


def _away(c) -> str:
    return f"least(abs(hue - {n(c)}), {n(360)} - abs(hue - {n(c)}))"


def selective(hue, width, v, black):
    w = clamp(f"{n(1)} - {_away(hue)} / {n(width)}", n(0), n(1))
    e = lambda c, k: u8(f"{f(c)} * ({n(1)} - {n(v[k])} * w) * ({n(1)} - {n(black)} * w)")
    return f"with {PIX}, {_HSL}, q as (select *, {w} as w from hsl) select image_id, y, x, {e('r', 0)} as r, {e('g', 1)} as g, {e('b', 2)} as b, a from q"


def hsl_adjust(master, bands):
    centres = {"red": 0, "yellow": 60, "green": 120, "cyan": 180, "blue": 240, "magenta": 300}
    near = "case " + " ".join(f"when {_away(c)} <= least({', '.join(_away(o) for o in centres.values())}) then {k}" for k, c in enumerate(centres.values())) + " end"
    val = lambda j: "case k " + " ".join(f"when {k} then {n(bands.get(b, (0, 0, 0))[j])}" for k, b in enumerate(centres)) + " end * w"
    turned = f"(hue + {n(master[0])} + {val(0)})"
    return f"""with {PIX}, {_HSL}, a1 as (select *, {near} as k, least({', '.join(_away(o) for o in centres.values())}) as away from hsl),
a2 as (select *, {clamp(f"{n(1)} - away / {n(60)}", n(0), n(1))} as w from a1),
a3 as (select *, case when {turned} < 0 then {turned} + {n(360)} when {turned} >= {n(360)} then {turned} - {n(360)} else {turned} end as h2,
  {clamp(f"sat * ({n(1)} + {n(master[1])} + {val(1)})", n(0), n(1))} as s2, {clamp(f"light + {n(master[2])} * {n(0.5)} + {val(2)} * {n(0.5)}", n(0), n(1))} as l2 from a2),
a4 as (select *, ({n(1)} - abs({n(2)} * l2 - {n(1)})) * s2 as c2, h2 / {n(60)} as sec from a3),
a5 as (select *, c2 * ({n(1)} - abs((sec - {n(2)} * cast(floor(sec / {n(2)}) as float)) - {n(1)})) as k2, l2 - c2 * {n(0.5)} as o2, cast(floor(sec) as integer) as i2 from a4)
select image_id, y, x, {u8(f"((case i2 when 0 then c2 when 1 then k2 when 2 then {n(0)} when 3 then {n(0)} when 4 then k2 else c2 end) + o2) * {n(255)}")} as r,
 {u8(f"((case i2 when 0 then k2 when 1 then c2 when 2 then c2 when 3 then k2 else {n(0)} end) + o2) * {n(255)}")} as g,
 {u8(f"((case i2 when 0 then {n(0)} when 1 then {n(0)} when 2 then k2 when 3 then c2 when 4 then c2 else k2 end) + o2) * {n(255)}")} as b, a from a5"""


def flatten():
    e = lambda c: f"cast(({c} * a + 255 * (255 - a) + 127) // 255 as integer) as {c}"
    return f"{P} select image_id, y, x, {e('r')}, {e('g')}, {e('b')}, cast(255 as integer) as a from pix"


def blend(v, inverse=False):
    k = "(255 - cov)" if inverse else "cov"
    new = u8  # noqa: F841
    e = lambda c: f"cast(({c} * (255 - {k}) + {u8(f'{f(c)} + {n(v)} * {n(255)}')} * {k} + 127) // 255 as integer) as {c}"
    return f"{M} select image_id, p.y, p.x, {e('r')}, {e('g')}, {e('b')}, a from pix p join msk m on m.mask_id = p.image_id and m.y = p.y and m.x = p.x"


def compose(e):
    return f"{MM} select b.mask_id, b.y, b.x, cast({e} as integer) as cov from msk b join msk2 n on n.mask_id = b.mask_id and n.y = b.y and n.x = b.x"


def mask_point(e):
    return f"{M} select mask_id, y, x, cast({e} as integer) as cov from msk"


def mask_contrast(k):
    return mask_point(u8(f"({f('cov')} - {n(127.5)}) * {n(k)} + {n(127.5)}"))


def _frame(src, out, agg, r):
    """agg over frames along x, then y; e.g. sum(v) over w // count(*) over w."""
    step = lambda s, o, part, order: f"{o} as (select mask_id, y, x, cast({agg} as integer) as cov from {s} window w as (partition by mask_id, {part} order by {order} rows between {r} preceding and {r} following))"
    return f"{step(src, out + '_x', 'y', 'x')}, {step(out + '_x', out, 'x', 'y')}"


MEAN, MAX, MIN = "sum(cov) over w // count(*) over w", "max(cov) over w", "min(cov) over w"


def _contrasted(src, out, k):
    return f"{out} as (select mask_id, y, x, {u8(f'({f(chr(99) + chr(111) + chr(118))} - {n(127.5)}) * {n(k)} + {n(127.5)}')} as cov from {src})"


def feather(r):
    return f"{M}, {_frame('msk', 'o', MEAN, r)} select * from o"


def morph(r, largest):
    return f"{M}, {_frame('msk', 'o', MAX if largest else MIN, r)} select * from o"


def smooth(r):
    return f"{M}, {_frame('msk', 's', MEAN, r)}, {_contrasted('s', 'o', 1.8)} select * from o"


def border(r):
    return f"{M}, {_frame('msk', 'a', MAX, r)}, {_frame('msk', 'b', MIN, r)} select a.mask_id, a.y, a.x, greatest(0, a.cov - b.cov) as cov from a join b using (mask_id, y, x)"


def refine(smooth_r, feather_r, k, shift):
    import numpy as np

    factor = float(np.float32(1) + np.float32(k) * np.float32(3))
    return (
        f"{M}, {_frame('msk', 's0', MEAN, smooth_r)}, {_contrasted('s0', 's1', 1.8)}, {_frame('s1', 's2', MAX if shift > 0 else MIN, abs(shift))}, "
        f"{_frame('s2', 's3', MEAN, feather_r)}, {_contrasted('s3', 'o', factor)} select * from o"
    )


def diagnostics():
    return f"""{M} select mask_id, count(*) filter (cov > 0) as selected, count(*) filter (cov = 255) as fully_selected, avg(cov) / 255 as average_coverage,
 min(x) filter (cov > 0) as "left", min(y) filter (cov > 0) as top, max(x) filter (cov > 0) + 1 as "right", max(y) filter (cov > 0) + 1 as bottom from msk group by mask_id"""


def histogram():
    return f"""{P}, l as (select image_id, 'red' as channel, r as bin from pix union all select image_id, 'green', g from pix union all select image_id, 'blue', b from pix
 union all select image_id, 'luminance', {u8(lum())} from pix) select image_id, channel, bin, count(*) as n from l group by all"""


def histogram_full():
    return f"""{P}, l as (select image_id, 'red' as channel, r as bin from pix union all select image_id, 'green', g from pix union all select image_id, 'blue', b from pix
 union all select image_id, 'luminance', {u8(lum())} from pix), c as (select image_id, channel, bin, count(*) as n from l group by all),
 g as (select distinct image_id, channel, cast(v as integer) as bin from l, range(256) t(v)) select image_id, channel, bin, coalesce(n, 0) as n from g left join c using (image_id, channel, bin)"""


def luminance_histogram(src=PIX, name="pix"):
    return f"with {src} select image_id, {u8(lum())} as bin, count(*) as n from {name} group by all"


def fix_dark(bt, gt, ct):
    t = [ct[gt[bt[v]]] for v in range(256)]
    step = f"{PIX}, done as (select image_id, y, x, {tab(t, 'r')} as r, {tab(t, 'g')} as g, {tab(t, 'b')} as b, a from pix)"
    return luminance_histogram(step, "done")


def clipping():
    return f"""{P} select image_id, count(*) filter (r = 0 or g = 0 or b = 0) as shadow_clipping, count(*) filter (r = 255 or g = 255 or b = 255) as highlight_clipping,
 count(*) as pixel_count from pix group by image_id"""


_TRIM = """vis as (select image_id, 'r' as channel, r as v from pix where a != 0 union all select image_id, 'g', g from pix where a != 0 union all select image_id, 'b', b from pix where a != 0),
ranked as (select image_id, channel, v, row_number() over (partition by image_id, channel order by v) as k, count(*) over (partition by image_id, channel) as c from vis),
tm as (select image_id, channel, cast(cast(sum(v) as bigint) as float) / cast(count(*) as float) as mean from ranked where k > c // 20 and k <= c - c // 20 group by all)"""


def trimmed_mean():
    return f"{P}, {_TRIM} select image_id, channel, floor(cast(mean as double) * 1000e0 + 0.5e0) / 1000e0 as mean from tm"


def white_balance(s):
    g = lambda c: f"case when {c} <= {n(1)} then {n(1)} else greatest({n(0.67)}, least({n(1.5)}, target / {c})) end"
    weigh = lambda a, b, c: f"{n(0.2126)} * {a} + {n(0.7152)} * {b} + {n(0.0722)} * {c}"
    fin = lambda c: f"greatest({n(0.67)}, least({n(1.5)}, g{c} / whole))"
    new = lambda c: f"case when p.a = 0 or f{c} is null then p.{c} else {u8(f'{f(chr(112) + chr(46) + c)} * ({n(1)} + (f{c} - {n(1)}) * {n(s)})')} end as {c}"
    return f"""{P}, {_TRIM}, m as (select image_id, max(mean) filter (channel = 'r') as mr, max(mean) filter (channel = 'g') as mg, max(mean) filter (channel = 'b') as mb from tm group by image_id),
t as (select *, {weigh('mr', 'mg', 'mb')} as target from m), g0 as (select *, {g('mr')} as gr, {g('mg')} as gg, {g('mb')} as gb from t where target > {_EPS}),
g1 as (select *, {weigh('gr', 'gg', 'gb')} as whole from g0), g2 as (select image_id, {fin('r')} as fr, {fin('g')} as fg, {fin('b')} as fb from g1)
select image_id, p.y, p.x, {new('r')}, {new('g')}, {new('b')}, p.a from pix p left join g2 using (image_id)"""


def percentile():
    return f"""{P}, h as (select image_id, {u8(lum())} as bin from pix where a != 0),
r as (select image_id, bin, row_number() over (partition by image_id order by bin) as k, count(*) over (partition by image_id) as c from h),
q as (select image_id, min(bin) filter (k >= greatest(1, cast(floor(cast(cast(c as float) * {n(0.05)} as double) + 0.5e0) as bigint))) as low,
 min(bin) filter (k >= greatest(1, cast(floor(cast(cast(c as float) * {n(0.95)} as double) + 0.5e0) as bigint))) as high from r group by image_id)
select image_id, low, high, round(cast(cast(greatest(0, high - low) as float) / {n(255)} as double), 5) as spread from q"""


_CAST = f"""cst0 as (select image_id, avg(cast({lum()} as double)) / 255 as average_luminance, cast(avg(r) / 255 as float) as mr, cast(avg(g) / 255 as float) as mg, cast(avg(b) / 255 as float) as mb
 from pix where a != 0 group by image_id),
cst1 as (select *, {n(0.2126)} * mr + {n(0.7152)} * mg + {n(0.0722)} * mb as neutral from cst0), cst2 as (select image_id, average_luminance, mr - neutral as rb, mg - neutral as gb, mb - neutral as bb from cst1),
cst as (select *, case when greatest(rb, gb, bb) - least(rb, gb, bb) < {n(0.035)} then 'neutral' when rb >= greatest(gb, bb) and bb <= least(rb, gb) then 'warm'
 when bb >= greatest(rb, gb) and rb <= least(gb, bb) then 'cool' when gb >= greatest(rb, bb) then 'green' else 'mixed' end as dominant from cst2)"""


def colour_cast():
    r = lambda c, o: f"round(cast({c} as double), 5) as {o}"
    return f"{P}, {_CAST} select image_id, {r('average_luminance', 'average_luminance')}, {r('rb', 'red_bias')}, {r('gb', 'green_bias')}, {r('bb', 'blue_bias')}, dominant from cst"


_SPATIAL = f"""l0 as (select image_id, y, x, a, {lum()} as l from pix),
sp as (select c.image_id, abs(c.l - ({n(0)} + w.l + e.l + nn.l + s.l) / {n(4)}) as away, {n(4)} * c.l - ({n(0)} + w.l + e.l + nn.l + s.l) as lap from l0 c
 join l0 w on w.image_id = c.image_id and w.y = c.y and w.x = c.x - 1 join l0 e on e.image_id = c.image_id and e.y = c.y and e.x = c.x + 1
 join l0 nn on nn.image_id = c.image_id and nn.y = c.y - 1 and nn.x = c.x join l0 s on s.image_id = c.image_id and s.y = c.y + 1 and s.x = c.x where c.a != 0),
spa as (select image_id, coalesce(least(1e0, avg(cast(away as double)) filter (away <= {n(20)}) / 32), 0e0) as noise, least(1e0, sqrt(avg(cast(lap * lap as double)) / (255e0 * 255 * 4))) as sharpness,
 least(1e0, avg(cast(away / {n(255)} as double))) as local_contrast, count(*) filter (away > {n(20)}) / cast(count(*) as double) as edge_density from sp group by image_id)"""


def spatial():
    return f"{P}, {_SPATIAL} select image_id, round(noise, 6) as noise, round(sharpness, 6) as sharpness, round(local_contrast, 6) as local_contrast, round(edge_density, 6) as edge_density from spa"


def analysis():
    return f"""{P}, {_SPATIAL}, {_CAST}, pc as ({percentile().removeprefix(P + ', ').replace('h as', 'with h as', 1)}),
wh as (select image_id, count(*) filter ({lum()} >= {n(210)} and greatest(r, g, b) - least(r, g, b) <= 28) / cast(count(*) as double) as wb from pix where a != 0 group by image_id)
select image_id, round(average_luminance, 5) as average_luminance, spread as luminance_spread, dominant, round(noise, 6) as noise, round(sharpness, 6) as sharpness,
 round(local_contrast, 6) as local_contrast, round(edge_density, 6) as edge_density, round(wb, 6) as white_background_ratio, (wb >= 0.30 and edge_density >= 0.015 and spread >= 0.20) as likely_document
from cst join spa using (image_id) join pc using (image_id) join wh using (image_id)"""


def _blur(src: str, out: str, r: int) -> str:
    """Means over clamped places through row and column lists."""
    at = lambda v, m: f"arr[greatest(1, least({m}, {v} + o + 1))]"
    one = lambda s, o, part, order, m: (
        f"{o}_l as (select image_id, {part}, list(v order by {order}) as arr from {s} group by all), "
        f"{o} as (select s.image_id, s.y, s.x, cast(cast(list_sum(list_transform(range(-{r}, {r + 1}), lambda o: {at('s.' + order, m)})) as bigint) // {2 * r + 1} as integer) as v "
        f"from {s} s join {o}_l l on l.image_id = s.image_id and l.{part} = s.{part})"
    )
    return f"{one(src, out + 'h', 'y', 'x', W)}, {one(out + 'h', out, 'x', 'y', H)}"


def box_blur(r):
    return f"{P}, lm as (select image_id, y, x, {u8(lum())} as v from pix), {_blur('lm', 'o', r)} select * from o"


def _adjusted(src: str, near: str, out: str, wanted: str) -> str:
    e = lambda c: f"case when a = 0 then {c} else {u8(f'{f(c)} + delta')} end as {c}"
    return f"{out}_d as (select p.*, {clamp(wanted, n(0), n(255))} - {lum()} as delta from {src} p join {near} q using (image_id, y, x)), {out} as (select image_id, y, x, {e('r')}, {e('g')}, {e('b')}, a from {out}_d)"


def _luma_of(src, out):
    return f"{out} as (select image_id, y, x, {u8(lum())} as v from {src})"


def _sharpened(src, out, s, radius, thr):
    r = int(min(4, max(1, int(radius + 0.5))))
    most = f"({n(24)} + {n(s)} * {n(20)})"
    d = f"({lum()} - {f('v')})"
    step = clamp(f"{d} * {n(s)}", f"-{most}", most)
    return f"{_luma_of(src, out + 'lm')}, {_blur(out + 'lm', out + 'bl', r)}, {_adjusted(src, out + 'bl', out, f'{lum()} + case when abs({d}) >= {n(thr)} * {n(255)} then {step} else {n(0)} end')}"


def local_contrast(s, tile, clip):
    most = f"({n(12)} * {n(clip)})"
    return f"{P}, {_luma_of('pix', 'lm')}, {_blur('lm', 'bl', max(1, tile // 2))}, {_adjusted('pix', 'bl', 'o', f'{lum()} + ' + clamp(f'{lum()} - ' + f('v'), '-' + most, most) + f' * {n(s)}')} select * from o"


def sharpen(s, radius, thr):
    return f"{P}, {_sharpened('pix', 'o', s, radius, thr)} select * from o"


def mild_deblur(s, radius):
    import numpy as np

    g = np.float32
    return f"{P}, {_sharpened('pix', 'one', float(g(s) * g(0.72)), radius, 0.025)}, {_sharpened('one', 'o', float(g(s) * g(0.28)), max(float(g(radius) * g(0.6)), 0.5), 0.04)} select * from o"


def uneven(s, radius):
    r = int(min(96, max(4, int(radius + 0.5))))
    near = f"nr as (select b.image_id, b.y, b.x, b.v, m.t from bl b join (select image_id, avg(v) as t from lm join pix using (image_id, y, x) where a != 0 group by image_id) m using (image_id))"
    gain = clamp(f"({f('t')} - {f('v')}) * {n(s)}", f"-{n(72)}", n(72))
    return f"{P}, {_luma_of('pix', 'lm')}, {_blur('lm', 'bl', r)}, {near}, {_adjusted('pix', 'nr', 'o', f'{lum()} + {gain}')} select * from o"


def deblock(s):
    import numpy as np

    bl = n(float(np.float32(s) * np.float32(0.38)))
    q = lambda t: f"{n(0.2126)} * {f(t + '.r')} + {n(0.7152)} * {f(t + '.g')} + {n(0.0722)} * {f(t + '.b')}"
    ok = lambda t: f"({t}.image_id is not null and p.a != 0 and {t}.a != 0 and abs(({q('p')}) - ({q(t)})) >= {n(4)} and abs(({q('p')}) - ({q(t)})) <= {n(80)})"
    mix = lambda t, c: u8(f"{f('p.' + c)} + (cast(p.{c} + {t}.{c} as float) / {n(2)} - {f('p.' + c)}) * {bl}")
    e = lambda c: f"case when {ok('v')} then {mix('v', c)} when {ok('h')} then {mix('h', c)} else p.{c} end as {c}"
    partner = lambda v: f"case when p.{v} % 8 = 7 then p.{v} + 1 when p.{v} % 8 = 0 and p.{v} > 0 then p.{v} - 1 end"
    return f"""{P} select p.image_id, p.y, p.x, {e('r')}, {e('g')}, {e('b')}, p.a from pix p
left join pix h on h.image_id = p.image_id and h.y = p.y and h.x = {partner('x')} left join pix v on v.image_id = p.image_id and v.x = p.x and v.y = {partner('y')}"""


def _in_order(start: str, value: str) -> str:
    """A sum from start, place by place, in the type of both."""
    return f"list_reduce(list_prepend({start}, list({value} order by k)), lambda u, v: u + v)"


def denoise(s, keep):
    import numpy as np

    g = np.float32
    r = 2 if s > 0.65 else 1
    scale = n(float(g(8) + (g(1) - g(keep)) * g(64)))
    offs = ", ".join(f"({k}, {i}, {j}, {n(float(g(1) / g(1 + i * i + j * j)))})" for k, (j, i) in enumerate((j, i) for j in range(-r, r + 1) for i in range(-r, r + 1)))
    far = f"(({n(0)} + abs({f('p.r')} - {f('q.r')}) + abs({f('p.g')} - {f('q.g')}) + abs({f('p.b')} - {f('q.b')})) / {n(3)})"
    w = f"case when q.a = 0 then {n(0)} else o.w * ({n(1)} / ({n(1)} + {far} / {scale})) end"
    e = lambda c: f"case when a = 0 or total <= {_EPS} then {c} else {u8(f'{f(c)} + (s{c} / total - {f(c)}) * {n(s)}')} end as {c}"
    return f"""{P}, o(k, i, j, w) as (values {offs}),
near as (select p.image_id, p.y, p.x, k, q.r as nr, q.g as ng, q.b as nb, {w} as w from pix p, o, pix q where q.image_id = p.image_id and q.x = greatest(0, least({W - 1}, p.x + o.i)) and q.y = greatest(0, least({H - 1}, p.y + o.j))),
sums as (select image_id, y, x, {_in_order(n(0), 'w')} as total, {', '.join(f"{_in_order(n(0), f'{f(f"n{c}")} * w')} as s{c}" for c in 'rgb')} from near group by image_id, y, x)
select image_id, y, x, {e('r')}, {e('g')}, {e('b')}, a from pix join sums using (image_id, y, x)"""


def decontaminate_sql(s, r):
    import numpy as np

    k = int(np.floor(np.float32(s) * np.float32(65535) + np.float32(0.5)))
    near = lambda c: f"((t{c} + tw // 2) // tw)"
    e = lambda c: f"cast(case when tw is null or tw = 0 then q.{c} else (q.{c} * {65535 - k} + {near(c)} * {k} + 32767) // 65535 end as integer) as {c}"
    total = lambda c: f"cast(sum(cast({c} as bigint) * k * w) as bigint) as t{c}"
    wide = "cast(greatest(0e0, least(255e0, floor((p.r - 127.5e0) * 6e0 + 127.5e0))) as integer)"
    return f"""{P}, q as (select p.*, {wide} as k from pix p),
pr as (select e.image_id, e.y, e.x, f.k, f.r, f.g, f.b, {r * r + 1} - (e.x - f.x) * (e.x - f.x) - (e.y - f.y) * (e.y - f.y) as w
 from q e join q f on f.image_id = e.image_id and f.x between e.x - {r} and e.x + {r} and f.y between e.y - {r} and e.y + {r} where e.k > 0 and e.k < 224 and f.k >= 224 and f.a != 0),
s as (select image_id, y, x, cast(sum(cast(k as bigint) * w) as bigint) as tw, {total('r')}, {total('g')}, {total('b')} from pr where w >= 1 group by all)
select q.image_id, q.y, q.x, {e('r')}, {e('g')}, {e('b')}, q.a from q left join s using (image_id, y, x)"""


def reflect():
    return f"{P} select image_id, y, cast({W - 1} - x as integer) as x, r, g, b, a from pix"


def rotate(d):
    nx, ny = {90: (f"{H - 1} - y", "x"), 180: (f"{W - 1} - x", f"{H - 1} - y"), 270: ("y", f"{W - 1} - x")}[d]
    return f"{P} select image_id, cast({ny} as integer) as y, cast({nx} as integer) as x, r, g, b, a from pix"


def crop(left, top, w, h):
    return f"{P} select image_id, cast(y - {top} as integer) as y, cast(x - {left} as integer) as x, r, g, b, a from pix where x between {left} and {left + w - 1} and y between {top} and {top + h - 1}"


def _bilinear(sx: str, sy: str) -> str:
    v = lambda c: u8(f"({f('p00.' + c)} * ({n(1)} - fx) + {f('p10.' + c)} * fx) * ({n(1)} - fy) + ({f('p01.' + c)} * ({n(1)} - fx) + {f('p11.' + c)} * fx) * fy")
    e = lambda c: f"case when o.inside then {v(c)} else 0 end as {c}"
    corner = lambda a, i, j: f"left join pix {a} on o.inside and {a}.image_id = o.image_id and {a}.x = least(o.l + {i}, {W - 1}) and {a}.y = least(o.t + {j}, {H - 1})"
    return f"""{P}, g as (select image_id, y, x, {f(sx)} as sx, {f(sy)} as sy from pix),
o as (select *, sx >= 0 and sy >= 0 and sx <= {n(W - 1)} and sy <= {n(H - 1)} as inside, cast(floor(sx) as integer) as l, cast(floor(sy) as integer) as t, sx - cast(floor(sx) as float) as fx, sy - cast(floor(sy) as float) as fy from g)
select o.image_id, o.y, o.x, {e('r')}, {e('g')}, {e('b')}, {e('a')} from o {corner('p00', 0, 0)} {corner('p10', 1, 0)} {corner('p01', 0, 1)} {corner('p11', 1, 1)}"""


def straighten(degrees):
    import math

    import numpy as np

    a = np.float32(math.radians(degrees))
    s, c, mx, my = n(float(np.sin(a))), n(float(np.cos(a))), n((W - 1) * 0.5), n((H - 1) * 0.5)
    dx, dy = f"({f('x')} - {mx})", f"({f('y')} - {my})"
    return _bilinear(f"{mx} + {dx} * {c} + {dy} * {s}", f"{my} - {dx} * {s} + {dy} * {c}")


def perspective(corners):
    tl, tr, br, bl = corners
    u, v = f"({f('x')} / {n(W - 1)})", f"({f('y')} / {n(H - 1)})"
    mix = lambda a, b, t: f"({a} + ({b} - {a}) * {t})"
    at = lambda k: mix(mix(n(tl[k]), n(tr[k]), u), mix(n(bl[k]), n(br[k]), u), v)
    return _bilinear(f"{at(0)} * {n(W - 1)}", f"{at(1)} * {n(H - 1)}")


def resample(nw, nh):
    kx, ky = W / nw, H / nh
    return f"""{M}, g as (select mask_id, cast(yy as integer) as y, cast(xx as integer) as x, greatest(0e0, least({W - 1}e0, (xx + 0.5e0) * {kx!r}e0 - 0.5e0)) as sx, greatest(0e0, least({H - 1}e0, (yy + 0.5e0) * {ky!r}e0 - 0.5e0)) as sy
 from (select distinct mask_id from msk), range({nw}) a(xx), range({nh}) b(yy)), o as (select *, floor(sx) as l, floor(sy) as t, sx - floor(sx) as fx, sy - floor(sy) as fy from g)
select o.mask_id, o.y, o.x, cast(floor((a.cov * (1e0 - fx) + b.cov * fx) * (1e0 - fy) + (c.cov * (1e0 - fx) + d.cov * fx) * fy + 0.5e0) as integer) as cov from o
 join msk a on a.mask_id = o.mask_id and a.x = l and a.y = t join msk b on b.mask_id = o.mask_id and b.x = least(l + 1, {W - 1}) and b.y = t
 join msk c on c.mask_id = o.mask_id and c.x = l and c.y = least(t + 1, {H - 1}) join msk d on d.mask_id = o.mask_id and d.x = least(l + 1, {W - 1}) and d.y = least(t + 1, {H - 1})"""


def _grid(w, h):
    return f"with g as (select cast(1 as bigint) as mask_id, cast(yy as integer) as y, cast(xx as integer) as x from range({h}) a(yy), range({w}) b(xx))"


def rectangle(w, h, left, top, right, bottom):
    part = lambda v, lo, hi: clamp(f"least({n(hi)}, {f(v)} + {n(1)}) - greatest({n(lo)}, {f(v)})", n(0), n(1))
    return f"{_grid(w, h)} select mask_id, y, x, {u8(part('x', left, right) + ' * ' + part('y', top, bottom) + ' * ' + n(255))} as cov from g"


def ellipse(w, h, cx, cy, rx, ry):
    dx, dy = f"(({f('x')} + cast(o as float) - {n(cx)}) / {n(rx)})", f"(({f('y')} + cast(q as float) - {n(cy)}) / {n(ry)})"
    return f"{_grid(w, h)} select mask_id, y, x, cast((count(*) filter ({dx} * {dx} + {dy} * {dy} <= {n(1)}) * 255 + 8) // 16 as integer) as cov from g, unnest([0.125e0, 0.375e0, 0.625e0, 0.875e0]) t(o), unnest([0.125e0, 0.375e0, 0.625e0, 0.875e0]) u(q) group by all"


def polygon(w, h, points):
    edges = ", ".join(f"({n(a[0])}, {n(a[1])}, {n(b[0])}, {n(b[1])})" for a, b in zip(points, [points[-1], *points[:-1]], strict=True))
    sy, sx = f"({f('y')} + cast(q as float))", f"({f('x')} + cast(o as float))"
    return f"""{_grid(w, h)}, e(x1, y1, x2, y2) as (values {edges}), s as (select * from g, unnest([0.125e0, 0.375e0, 0.625e0, 0.875e0]) t(o), unnest([0.125e0, 0.375e0, 0.625e0, 0.875e0]) u(q)),
h as (select mask_id, y, x, o, q, count(e.x1) % 2 as inside from s left join e on (y1 > {sy}) != (y2 > {sy}) and (x2 - x1) * ({sy} - y1) / (y2 - y1) + x1 <= {sx} group by all)
select mask_id, y, x, cast((sum(inside) * 255 + 8) // 16 as integer) as cov from h group by all"""


def dabs(w, h, samples, hardness):
    rows = ", ".join(f"({n(x)}, {n(y)}, {n(d)} / {n(2)}, {n(o)})" for x, y, d, o in samples)
    gx, gy = f"({f('x')} + {n(0.5)} - cx)", f"({f('y')} + {n(0.5)} - cy)"
    fall = f"case when dist <= r * {n(hardness)} or r * {n(hardness)} >= r then {n(1)} else {n(1)} - (dist - r * {n(hardness)}) / (r - r * {n(hardness)}) end"
    return f"""{_grid(w, h)}, s(cx, cy, r, op) as (values {rows}), d as (select mask_id, y, x, r, op, cast(sqrt(cast({gx} as double) * {gx} + cast({gy} as double) * {gy}) as float) as dist from g, s)
select mask_id, y, x, coalesce(max({u8(f'{n(255)} * op * ({fall})')}) filter (dist <= r), 0) as cov from d group by all"""


def _wand_cov(d, tol, anti):
    import numpy as np

    t = np.float32(tol)
    soft = min(np.float32(1), t + np.float32(0.08 if anti else 0))
    ramp = u8(f"{n(255)} * ({n(1)} - ({d} - {n(float(t))}) / {n(float(soft - t))})")
    return f"case when {d} <= {n(float(t))} then 255 when {d} >= {n(float(soft))} then 0 else {ramp} end", n(float(soft)), n(float(t))


def _wand_dist(s):
    part = lambda c, v: f"abs({f(c)} - {f(v)}) / {n(255)}"
    return f"case when p.a = 0 or {s[3]} = 0 then {part('p.a', s[3])} else greatest({part('p.r', s[0])}, {part('p.g', s[1])}, {part('p.b', s[2])}, {part('p.a', s[3])}) end"


def wand_global(sample, tol):
    cov, _, _ = _wand_cov("d", tol, True)
    return f"{P}, q as (select image_id, y, x, {_wand_dist([str(v) for v in sample])} as d from pix p) select image_id as mask_id, y, x, cast({cov} as integer) as cov from q"


def wand_region(seed, tol, eight=False):
    cov, soft, t = _wand_cov("d", tol, True)
    near = "abs(q.x - r.x) <= 1 and abs(q.y - r.y) <= 1" if eight else "abs(q.x - r.x) + abs(q.y - r.y) <= 1"
    return f"""with recursive {PIX}, q as (select p.image_id, p.y, p.x, {_wand_dist(['s.r', 's.g', 's.b', 's.a'])} as d from pix p join pix s on s.image_id = p.image_id and s.x = {seed[0]} and s.y = {seed[1]}),
r(image_id, y, x, d) as (select * from q where x = {seed[0]} and y = {seed[1]} union select q.image_id, q.y, q.x, q.d from r join q on q.image_id = r.image_id and {near} where r.d <= {t} and q.d <= {soft})
select q.image_id as mask_id, q.y, q.x, cast(case when r.image_id is null then 0 else {cov.replace('d ', 'q.d ')} end as integer) as cov from q left join r using (image_id, y, x)"""


def fill_holes():
    return f"""with recursive {PIX}, {MSK}, low as (select mask_id, y, x from msk where cov < 128),
r(mask_id, y, x) as (select * from low where y in (0, {H - 1}) or x in (0, {W - 1}) union select l.mask_id, l.y, l.x from r join low l on l.mask_id = r.mask_id and abs(l.x - r.x) + abs(l.y - r.y) = 1)
select m.mask_id, m.y, m.x, case when m.cov < 128 and r.mask_id is null then 255 else m.cov end as cov from msk m left join r using (mask_id, y, x)"""


def remove_islands(least):
    return f"""with recursive {PIX}, {MSK}, up as (select mask_id, y, x, y * {W} + x as k from msk where cov >= 128),
r(mask_id, y, x, k) as (select mask_id, y, x, k from up union select u.mask_id, u.y, u.x, r.k from r join up u on u.mask_id = r.mask_id and abs(u.x - r.x) + abs(u.y - r.y) = 1),
s as (select mask_id, y, x, count(*) as size from r group by all)
select m.mask_id, m.y, m.x, case when s.size < {least} then 0 else m.cov end as cov from msk m left join s using (mask_id, y, x)"""


def color_range(points, tol, lw, hw, sw, table):
    import numpy as np

    g = np.float32
    lin = ", ".join(f"{v!r}" if "e" in repr(v) else f"{v!r}e0" for v in table)
    t = g(tol)
    soft = min(g(1), t + g(0.1))
    total = n(float(np.sqrt(g(hw) + g(sw) + g(lw))))
    dh = f"(least(abs(q.hue - s.hue), {n(1)} - abs(q.hue - s.hue)) * {n(2)} * least({n(1)}, least(q.sat, s.sat)) * {n(hw)})"
    ds, dl = f"(abs(q.sat - s.sat) * {n(sw)})", f"(cast(sqrt(cast(abs(q.lum - s.lum) as double)) as float) * {n(lw)})"
    ramp = u8(f"{n(255)} * ({n(1)} - (d - {n(float(t))}) / {n(float(soft - t))})")
    where = " or ".join(f"(x = {x} and y = {y})" for x, y in points)
    return f"""{P}, unit as (select *, cast(list_extract([{lin}], r + 1) as float) as fr, cast(list_extract([{lin}], g + 1) as float) as fg, cast(list_extract([{lin}], b + 1) as float) as fb from pix),
ext as (select *, greatest(fr, fg, fb) as hi, least(fr, fg, fb) as lo, greatest(fr, fg, fb) - least(fr, fg, fb) as d from unit),
q as (select image_id, y, x, a, case when hi <= {_EPS} then {n(0)} else d / hi end as sat, ({_hue(n(1))}) / {n(6)} as hue, {n(0.2126)} * fr + {n(0.7152)} * fg + {n(0.0722)} * fb as lum from ext),
m as (select q.image_id, q.y, q.x, q.a, min(cast(sqrt(cast({dh} * {dh} + {ds} * {ds} + {dl} * {dl} as double)) as float) / {total}) as d from q join (select * from q where {where}) s on s.image_id = q.image_id group by all)
select image_id as mask_id, y, x, cast(case when a = 0 then 0 else ((case when d <= {n(float(t))} then 255 when d >= {n(float(soft))} then 0 else {ramp} end) * a + 127) // 255 end as integer) as cov from m"""


def rle():
    return f"""{M}, a as (select *, case when lag(cov) over w = cov then 0 else 1 end as new from msk window w as (partition by mask_id order by y, x)),
b as (select *, cast(sum(new) over (partition by mask_id order by y, x) - 1 as bigint) as run from a) select mask_id, run, max(cov) as cov, count(*) as n from b group by all"""


def thumbnail(nw, nh):
    sx, sy = W / nw, H / nh
    part = lambda v, c, s: f"greatest(0e0, least({v} + 1e0, ({c} + 1) * {s!r}e0) - greatest(cast({v} as double), {c} * {s!r}e0))"
    return f"""{M}, q as (select mask_id, cast(cy as integer) as ny, cast(cx as integer) as nx, cov, {part('x', 'cx', sx)} * {part('y', 'cy', sy)} as w from msk, range({nw}) a(cx), range({nh}) b(cy))
select mask_id, ny as y, nx as x, cast(floor(round(sum(w * cov) / sum(w), 6) + 0.5e0) as integer) as cov from q where w > 0 group by all"""


def align(s):
    l = f"case when a = 0 then {n(0)} else {lum()} * {f('a')} / {n(255)} end"  # noqa: E741
    at = {"nw": (-1, -1), "no": (0, -1), "ne": (1, -1), "we": (-1, 0), "ea": (1, 0), "sw": (-1, 1), "so": (0, 1), "se": (1, 1)}
    joins = " ".join(f"left join lm {k} on {k}.image_id = c.image_id and {k}.x = c.x + {i} and {k}.y = c.y + {j}" for k, (i, j) in at.items())
    gx = f"(- nw.l + ne.l - {n(2)} * we.l + {n(2)} * ea.l - sw.l + se.l)"
    gy = f"(- nw.l - {n(2)} * no.l - ne.l + sw.l + {n(2)} * so.l + se.l)"
    g = f"(cast(least(1020e0, sqrt(cast({gx} as double) * {gx} + cast({gy} as double) * {gy})) as float) / {n(1020)})"
    edge = " or ".join(["c.cov between 1 and 254", *[f"({k}.cov >= 128) != (c.cov >= 128)" for k in ("we", "ea", "no", "so")]])
    new = u8(f"({f('c.cov')} - {n(127.5)}) * ({n(1)} + {n(s)} * {g} * {n(3)}) + {n(127.5)}")
    return f"""{M}, lm as (select p.image_id, p.y, p.x, {l} as l, cov from pix p join msk m on m.mask_id = p.image_id and m.y = p.y and m.x = p.x)
select c.image_id as mask_id, c.y, c.x, case when nw.l is not null and se.l is not null and ({edge}) then {new} else c.cov end as cov from lm c {joins}"""


SESSIONS = """with a as (select *, lag(ts) over (partition by user_id, event_type order by ts, event_id) as prev from events),
b as (select *, case when prev is null or ts - prev > interval 12 hour then 1 else 0 end as new from a),
c as (select *, cast(sum(new) over (partition by user_id, event_type order by ts, event_id) as bigint) as session from b)
select user_id, event_type, session, count(*) as n_events, min(ts) as first_ts, max(ts) as last_ts from c group by all"""

RECONCILE = """with o as (select o_custkey as plan_id, cast(row_number() over (partition by o_custkey order by o_orderkey) as bigint) as idx, o_orderpriority as sig, o_orderdate from orders),
old as (select *, row_number() over (partition by plan_id, sig order by idx) as rn from o where idx % 2 = 1), new as (select *, row_number() over (partition by plan_id, sig order by idx) as rn from o where idx % 2 = 0)
select n.plan_id, n.idx, n.sig, coalesce(old.idx, -1) as old_idx from new n left join old using (plan_id, sig, rn)"""

LATEST = "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by user_id"

TIMELINE = "with a as (select event_id, user_id, cast(row_number() over (partition by user_id order by event_id desc) - 1 as integer) as depth from events) select * from a where depth < 3"

BATCH = """with u as (select distinct '/in/' || replace(p_name, ' ', '#') || '_' || cast(p_partkey // 2 as varchar) || case when p_partkey % 2 = 0 then '.PNG' else '.jpeg' end as path from part),
i as (select path, cast(row_number() over (order by lower(path), path) - 1 as integer) as idx from u),
t as (select *, replace(regexp_replace(string_split(path, '/')[3], '[.][^.]*$', ''), '#', '_') || '-out.png' as target from i),
x as (select distinct replace(p_name, ' ', '_') || '_' || cast(p_partkey // 2 as varchar) || '-out.png' as target, true as there from part where p_partkey % 10 = 3),
c as (select t.*, there, row_number() over (partition by t.target order by idx) as claim from t left join x using (target))
select idx, path, target, case when there or claim > 1 then 'skipped' else 'run' end as status from c"""

SEARCH = """select p_partkey as id, p_name as name, p_type as description, p_brand as folder, p_size > 40 as favorite from part
where contains(lower(p_name), 'an') or contains(lower(p_type), 'an') or contains(lower(p_brand), 'an')"""


def overlay(w, h, mode, color, opacity, frame):
    near = lambda e: f"cast(floor({e} + 0.5e0) as integer)"
    o = f"{float(opacity)!r}e0"
    edge = "(coalesce(l.cov >= 128, false) != (m.cov >= 128) or coalesce(r.cov >= 128, false) != (m.cov >= 128) or coalesce(u.cov >= 128, false) != (m.cov >= 128) or coalesce(d.cov >= 128, false) != (m.cov >= 128))"
    ant = f"case when {edge} and (g.x + g.y + {frame}) % 8 < 4 then 255 else 0 end"
    px = {
        "marching_ants": (ant, ant, ant, f"case when {edge} then 255 else 0 end"), "color": (*map(str, color), near(f"m.cov * {o}")), "grayscale": ("m.cov", "m.cov", "m.cov", near(f"255 * {o}")),
        "mask_only": ("m.cov", "m.cov", "m.cov", "255"), "white": ("255", "255", "255", near(f"(255 - m.cov) * {o}")), "black": ("0", "0", "0", near(f"(255 - m.cov) * {o}")),
    }[mode]
    join = lambda k, dx, dy: f"left join msk {k} on {k}.mask_id = m.mask_id and {k}.x = m.x + {dx} and {k}.y = m.y + {dy}"
    return f"""{M}, g as (select cast(yy as integer) as y, cast(xx as integer) as x, least({H - 1}, cast(floor((yy + 0.5e0) * {H}e0 / {h}e0) as integer)) as sy, least({W - 1}, cast(floor((xx + 0.5e0) * {W}e0 / {w}e0) as integer)) as sx from range({h}) a(yy), range({w}) b(xx))
select m.mask_id, g.y, g.x, {', '.join(f'cast({e} as integer) as {c}' for c, e in zip('rgba', px, strict=True))} from g join msk m on m.x = sx and m.y = sy {join('l', -1, 0)} {join('r', 1, 0)} {join('u', 0, -1)} {join('d', 0, 1)}"""


PRESSURE = """with p as (select event_id, event_type in ('click', 'view') and value is not null as pen, greatest(0e0, least(1e0, value / 100)) as p from events)
select event_id, case when pen then floor(greatest(1e0, least(512e0, 48e0 * (0.35e0 + (1e0 - 0.35e0) * p))) * 1000000e0 + 0.5e0) / 1000000e0 else 48e0 end as diameter,
 case when pen then floor(greatest(0.01e0, least(1e0, 0.9e0 * (0.25e0 + (1e0 - 0.25e0) * p))) * 1000000e0 + 0.5e0) / 1000000e0 else 0.9e0 end as opacity from p"""


def chain(*steps):
    """The last of several statements over pix, each over the rows of the one before."""
    out = steps[0]
    for step in steps[1:]:
        assert step.startswith(P)
        out = f"with pix as materialized ({out})" + step.removeprefix(P)
    return out


def _gauss(deviation):
    """Statements across and z (down): weighted sums of the pixels within three deviations, edges continued."""
    import math

    reach = max(1, math.ceil(3 * deviation))
    raw = [math.exp(-0.5 * (k / deviation) ** 2) for k in range(-reach, reach + 1)]
    weight = [f"{v / sum(raw)!r}e0" for v in raw]

    offs = ", ".join(f"({k}, {k - reach}, {w})" for k, w in enumerate(weight))

    def axis(src, out, c, most, other):
        total = lambda v: _in_order("0e0", f"cast(q.{v} as double) * o.w")
        near = f"from {src} p, o, {src} q where q.image_id = p.image_id and q.{other} = p.{other} and q.{c} = greatest(0, least({most}, p.{c} + o.i))"
        return f"{out} as materialized (select p.image_id, p.y, p.x, {', '.join(f'{total(v)} as {v}' for v in 'rgba')} {near} group by p.image_id, p.y, p.x)"

    return f"o(k, i, w) as (values {offs}), {axis('pix', 'across', 'x', W - 1, 'y')}, {axis('across', 'z', 'y', H - 1, 'x')}"


def gaussian(deviation):
    return f"{P}, {_gauss(deviation)} select image_id, y, x, {', '.join(f'{u8(c)} as {c}' for c in 'rgba')} from z"


def unsharp(strength):
    e = lambda c: u8(f"{f(f'p.{c}')} + ({f(f'p.{c}')} - {f(u8(f'z.{c}'))}) * {n(strength)}") + f" as {c}"
    return f"{P}, {_gauss(1.2)} select image_id, y, x, {e('r')}, {e('g')}, {e('b')}, p.a from pix p join z using (image_id, y, x)"


def document(strength, gray):
    """The fixed chain for pages, from the statements of its parts."""
    import numpy as np

    s = lambda v: float(np.float32(strength) * np.float32(v))
    steps = [white_balance(s(0.45)), uneven(s(0.78), 32.0), local_contrast(s(0.72), 32, 1.6), denoise(s(0.22), 0.85), sharpen(s(0.55), 1.0, 0.025)]
    return chain(*steps, *([grayscale()] if gray else []))


def lens(distortion, vignetting, aberration):
    """Red, green and blue sampled where each lies, then light by the distance from the middle."""
    mx, my = n((W - 1) * 0.5), n((H - 1) * 0.5)
    wx, wy = n(max(1.0, (W - 1) * 0.5)), n(max(1.0, (H - 1) * 0.5))
    nx, ny = f"(({f('x')} - {mx}) / {wx})", f"(({f('y')} - {my}) / {wy})"
    parts = [f"d0 as (select image_id, y, x, {nx} as nx, {ny} as ny from pix)", "d1 as (select *, nx * nx + ny * ny as r2 from d0)"]
    bend = f"({n(1)} + {n(distortion)} * r2)"
    parts.append(f"d2 as (select *, {mx} + nx * {bend} * {wx} as px, {my} + ny * {bend} * {wy} as py, {n(aberration)} * r2 * {n(2)} as sh from d1)")
    for tag, sign in (("r", " + "), ("g", None), ("b", " - ")):
        sx, sy = ("px", "py") if sign is None else (f"px{sign}nx * sh", f"py{sign}ny * sh")
        parts.append(f"at_{tag} as (select image_id, y, x, {f(sx)} as sx, {f(sy)} as sy from d2)")
        parts.append(f"in_{tag} as (select *, sx >= 0 and sy >= 0 and sx <= {n(W - 1)} and sy <= {n(H - 1)} as inside, cast(floor(sx) as integer) as l, cast(floor(sy) as integer) as t, sx - cast(floor(sx) as float) as fx, sy - cast(floor(sy) as float) as fy from at_{tag})")
        v = lambda c: u8(f"({f('p00.' + c)} * ({n(1)} - fx) + {f('p10.' + c)} * fx) * ({n(1)} - fy) + ({f('p01.' + c)} * ({n(1)} - fx) + {f('p11.' + c)} * fx) * fy")
        corner = lambda a, i, j: f"left join pix {a} on o.inside and {a}.image_id = o.image_id and {a}.x = least(o.l + {i}, {W - 1}) and {a}.y = least(o.t + {j}, {H - 1})"
        values = ", ".join(f"case when o.inside then {v(c)} else 0 end as {c}" for c in {tag, "a"})
        parts.append(f"s_{tag} as (select o.image_id, o.y, o.x, {values} from in_{tag} o {corner('p00', 0, 0)} {corner('p10', 1, 0)} {corner('p01', 0, 1)} {corner('p11', 1, 1)})")
    lit = lambda t: u8(f"{f(f's_{t}.{t}')} * greatest({n(0)}, {n(1)} + {n(vignetting)} * r2)") + f" as {t}"
    return f"""{P}, {', '.join(parts)} select image_id, y, x, {lit('r')}, {lit('g')}, {lit('b')}, s_g.a from d1
join s_r using (image_id, y, x) join s_g using (image_id, y, x) join s_b using (image_id, y, x)"""
