"""Named plans and curves; their parameters are fixed values."""

from __future__ import annotations

from .ops import Plan, op, plan


def _lc(strength, tile_size, clip_limit):
    return op("local_contrast", strength=strength, tile_size=tile_size, clip_limit=clip_limit)


def _dn(strength, preserve_edges):
    return op("denoise", strength=strength, preserve_edges=preserve_edges)


def _es(strength, radius, threshold):
    return op("edge_aware_sharpen", strength=strength, radius=radius, threshold=threshold)


PRESETS: dict[str, Plan] = {
    "fix_dark": plan(op("brightness", amount=0.14), op("gamma", value=1.18), op("contrast", amount=0.08)),
    "readability": plan(op("grayscale"), op("contrast", amount=0.28), op("sharpen", strength=0.45)),
    "mild_enhance": plan(op("contrast", amount=0.08), op("saturation", amount=0.1), op("sharpen", strength=0.24)),
    "soft_contrast": plan(op("contrast", amount=-0.18), op("brightness", amount=0.03)),
    "black_white": plan(op("grayscale")),
    "indoor_lighting": plan(op("auto_white_balance", strength=0.72), _lc(0.32, 32, 1.4)),
    "old_scan": plan(op("uneven_lighting_correction", strength=0.62, radius=40), _dn(0.28, 0.82), _es(0.46, 1.2, 0.035)),
    "jpeg_cleanup": plan(op("deblock", strength=0.58), _dn(0.18, 0.88)),
    "mild_detail": plan(op("mild_deblur", strength=0.38, radius=1.2), _es(0.22, 0.9, 0.045)),
    "document_color": plan(op("document_enhance", strength=0.72, grayscale=False)),
    "document_grayscale": plan(op("document_enhance", strength=0.76, grayscale=True)),
    "uneven_lighting": plan(op("uneven_lighting_correction", strength=0.7, radius=48)),
    "conservative_restore": plan(op("auto_white_balance", strength=0.42), _lc(0.26, 40, 1.25), _dn(0.22, 0.86), _es(0.3, 1.1, 0.04)),
}
CURVES: dict[str, tuple] = {
    "linear": ((0, 0), (1, 1)),
    "contrast": ((0, 0), (0.25, 0.18), (0.75, 0.82), (1, 1)),
    "matte": ((0, 0.08), (0.5, 0.52), (1, 0.96)),
    "bright": ((0, 0), (0.4, 0.58), (1, 1)),
}
