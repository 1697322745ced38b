"""Validation, rewriting, JSON and history of plans."""

import pytest

from pixelloom.operators import point
from pixelloom.plans import compiler, presets
from pixelloom.plans.ops import RANGES, History, InvalidOperation, Op, from_json, moved, op, plan, plan_from_json, removed, replaced

GOOD = {
    "brightness": {"amount": 0.1}, "contrast": {"amount": -0.5}, "gamma": {"value": 1.0}, "sharpen": {"strength": 2.0}, "levels": {"input_black": 0, "input_white": 255, "gamma": 1.0, "output_black": 0, "output_white": 255},
    "crop": {"x": 0.0, "y": 0.0, "width": 1.0, "height": 1.0}, "straighten": {"degrees": -45}, "denoise": {"strength": 1.0, "preserve_edges": 0.0},
}


@pytest.mark.parametrize("kind", GOOD)
def test_good_operations(kind):
    assert op(kind, **GOOD[kind]).type == kind


@pytest.mark.parametrize("kind", [k for k in GOOD if k in RANGES])
def test_out_of_range(kind):
    for name, (low, high) in RANGES[kind].items():
        for v in (low - 1, high + 1, float("nan"), "x", None):
            with pytest.raises(InvalidOperation):
                op(kind, **GOOD[kind] | {name: v})


@pytest.mark.parametrize("bad", [{"type": "nothing"}, {"type": "brightness"}, {"type": "brightness", "amount": 0, "more": 1}, {"type": "rotate", "degrees": 45}, {"type": "curves", "rgb": [[0, 0]]}, {"type": "perspective", "corners": [[0, 0]]}, 3])
def test_bad_json(bad):
    import json

    with pytest.raises(InvalidOperation):
        from_json(json.dumps(bad))


def test_masks_hold_one_plain_operation():
    inner = op("brightness", amount=0.2)
    assert op("masked", operation=inner, mask="m").operation == inner
    for wrong in (op("reflect_horizontal"), op("masked", operation=inner, mask="m"), None):
        with pytest.raises(InvalidOperation):
            op("masked", operation=wrong, mask="m")
    with pytest.raises(InvalidOperation):
        plan(op("decontaminate_colors", strength=0.5, radius=2))


def test_json_round_trip():
    for p in presets.PRESETS.values():
        assert plan_from_json(p.to_json()) == p
    p = plan(op("masked", operation=op("contrast", amount=0.1), mask="m", invert=True), op("crop", x=0.1, y=0.1, width=0.5, height=0.5))
    assert plan_from_json(p.to_json()) == p


def test_rewrite_fuses_tables_and_drops_identities():
    steps = compiler.rewrite(plan(op("brightness", amount=0.14), op("sharpen", strength=0), op("gamma", value=1.18), op("contrast", amount=0.08), op("grayscale"), op("gamma", value=1)))
    assert [s.type for s in steps] == ["tables", "grayscale"]
    b, g, c = (point.channel_tables(o)[0] for o in presets.PRESETS["fix_dark"].ops)
    assert list(steps[0].red) == [c[g[b[v]]] for v in range(256)]
    assert compiler.rewrite(plan(op("mild_deblur", strength=0, radius=1.0))) == []


def test_sizes_and_geometry_only():
    p = plan(op("brightness", amount=0.1), op("rotate", degrees=90), op("crop", x=0.25, y=0.25, width=0.5, height=0.5))
    assert compiler.stage_sizes(p, 16, 12) == [(16, 12), (16, 12), (12, 16), (6, 8)]
    assert [o.type for o in compiler.geometry_only(p).ops] == ["rotate", "crop"]


def test_edits_and_history():
    a, b = op("brightness", amount=0.1), op("contrast", amount=0.1)
    p = plan(a, b)
    assert replaced(p, op("brightness", amount=0.2)).ops[0].amount == 0.2
    assert replaced(plan(b), a).ops == (b, a)
    assert moved(p, 0, 1).ops == (b, a) and removed(p, 0).ops == (b,)
    h = History(plan(), most=2)
    for q in (plan(a), plan(b), p, p):
        h.commit(q)
    assert [h.undo(), h.undo(), h.undo()] == [plan(b), plan(a), plan(a)] and h.redo() == plan(b)
    assert isinstance(a, Op)


def test_crop_ratios():
    from pixelloom.operators.overlay import crop_of_ratio

    assert crop_of_ratio(16, 9, "square") == ((1 - 9 / 16) / 2, 0.0, 9 / 16, 1.0)
    assert crop_of_ratio(9, 16, "square") == (0.0, (1 - 9 / 16) / 2, 1.0, 9 / 16)
    assert crop_of_ratio(5, 4, "original") == (0.0, 0.0, 1.0, 1.0)
