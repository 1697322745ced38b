"""Chains of geometry: maps and their inverses, and masks carried between chains."""

import numpy as np
import pytest

from pixelloom.operators import geometry
from pixelloom.operators.remap import Chain, backward, forward, remap_masks
from pixelloom.plans.ops import op
from tests.test_golden import covs, grid

STEPS = [
    op("reflect_horizontal"), op("rotate", degrees=90), op("rotate", degrees=180), op("rotate", degrees=270), op("crop", x=0.1, y=0.2, width=0.7, height=0.6), op("straighten", degrees=11.0),
    op("perspective", corners=((0.05, 0.02), (0.97, 0.06), (0.93, 0.98), (0.02, 0.9))), op("lens_correction", distortion=0.12, vignetting=0.0, chromatic_aberration=0.0), op("lens_correction", distortion=-0.1, vignetting=0.0, chromatic_aberration=0.0),
]


@pytest.mark.parametrize("step", STEPS, ids=lambda o: f"{o.type}")
def test_forward_undoes_backward(step):
    w, h = 33, 21
    nw, nh = Chain(w, h, (step,)).sizes[-1]
    y, x = (v.ravel().astype(float) for v in np.indices((nh, nw)))
    bx, by = backward(step, x, y, w, h)
    fx, fy = forward(step, bx, by, w, h)
    ok = ~np.isnan(fx)
    assert ok.mean() > 0.95 and np.abs(fx - x)[ok].max() < 1e-6 and np.abs(fy - y)[ok].max() < 1e-6


def made(spark, w=8, h=6):
    return grid(spark, [[(x * 31 + y * 47) % 256 for x in range(w)] for y in range(h)])


def test_same_chain_keeps_masks(spark):
    m = made(spark)
    assert covs(remap_masks(m, Chain(8, 6), Chain(8, 6))) == covs(m)
    c = Chain(8, 6, (op("straighten", degrees=9.0),))
    assert covs(remap_masks(m, c, c)) == covs(m)


def test_exact_moves(spark):
    m = made(spark)
    turned = remap_masks(m, Chain(8, 6), Chain(8, 6, (op("rotate", degrees=90),)))
    want = geometry.rotate(m.withColumnRenamed("mask_id", "image_id"), 90, 8, 6)
    assert covs(turned) == covs(want)
    back = remap_masks(turned, Chain(8, 6, (op("rotate", degrees=90),)), Chain(8, 6))
    assert covs(back) == covs(m)


def test_crop_loses_and_resampling_keeps(spark):
    m = made(spark)
    box = op("crop", x=0.25, y=0.0, width=0.5, height=1.0)
    cut = remap_masks(m, Chain(8, 6), Chain(8, 6, (box,)))
    again = covs(remap_masks(cut, Chain(8, 6, (box,)), Chain(8, 6)))
    whole = covs(m)
    assert [r[2:6] for r in again] == [r[2:6] for r in whole] and all(r[0] == 0 and r[7] == 0 for r in again)
    full = grid(spark, [[255] * 8] * 6)
    bent = covs(remap_masks(full, Chain(8, 6), Chain(8, 6, (op("lens_correction", distortion=-0.1, vignetting=0.0, chromatic_aberration=0.0),))))
    assert bent[3][4] == 255
