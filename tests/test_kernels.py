"""Packed kernels give what the window forms give."""

import pytest

from pixelloom.operators import aggregate, kernels, mask, point
from pixelloom.plans.ops import op
from pixelloom.sources.rasters import pack, unpack
from tests.test_golden import covs, grid, pattern, rows


def made(spark):
    return grid(spark, [[(x * 37 + y * 91) % 256 for x in range(13)] for y in range(9)])


def plane(df):
    r = df.first()
    return [list(r.cov[k * r.width : (k + 1) * r.width]) for k in range(r.height)]


@pytest.mark.parametrize("radius", [0, 1, 2, 5, 30])
def test_frames(spark, radius):
    m = made(spark)
    packed = kernels.pack_masks(m)
    assert plane(packed) == covs(m)
    assert plane(kernels.feather(packed, radius)) == covs(mask.feather(m, radius))
    assert plane(kernels.expand(packed, radius)) == covs(mask.expand(m, radius))
    assert plane(kernels.shrink(packed, radius)) == covs(mask.shrink(m, radius))


def test_refine(spark):
    m = made(spark)
    for args in ((1, 2, 0.2, -1), (0, 0, 0.0, 2), (2, 0, -0.4, 0)):
        assert plane(kernels.refine(kernels.pack_masks(m), *args)) == covs(mask.refine(m, *args))


def test_channels_and_histograms(spark):
    p = pattern(spark)
    a, b = op("brightness", amount=0.1), op("gamma", value=1.4)
    want = rows(point.apply_tables(point.apply_tables(p, point.channel_tables(a)), point.channel_tables(b)))
    assert rows(unpack(kernels.channelwise(pack(p), a, b))) == want
    key = lambda d: sorted(tuple(r) for r in d.select("image_id", "channel", "bin", "n").collect())
    assert key(kernels.histograms(pack(p))) == key(aggregate.histogram(p))
    with pytest.raises(ValueError):
        kernels.channelwise(pack(p), op("grayscale"))
