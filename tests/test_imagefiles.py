"""JPEG and WebP files that this engine writes, read by other means."""

import numpy as np
import pytest

from pixelloom.functions import imagefiles as files


def picture(w, h, seed=1):
    rnd = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    px = np.stack([120 + 80 * np.sin(x / 9), 100 + 90 * np.cos(y / 7), 60 + 2 * x + y], -1)
    return np.clip(px + rnd.normal(0, 3, px.shape), 0, 255).astype(np.uint8)


def test_prefix_codes():
    rnd = np.random.default_rng(2)
    for most in (4, 7, 15):
        counts = (rnd.pareto(0.6, 14) * 10).astype(int) + 1
        n = files.code_lengths(counts, most)
        assert n.max() <= most and sum(2.0 ** -float(v) for v in n) <= 1
        codes = files.codes_of(n)
        words = [f"{c:0{k}b}" for c, k in zip(codes, n, strict=True)]
        assert not any(a != b and b.startswith(a) for a in words for b in words)
    assert files.code_lengths(np.array([0, 5, 0]), 15).tolist() == [0, 1, 0]


def test_jpeg_is_read_back(spark, tmp_path):
    from pixelloom.sources.rasters import header_size, read_images

    sizes = {"a": (64, 48, 95), "b": (37, 29, 82), "c": (1, 1, 90), "d": (8, 9, 30)}
    made = {}
    for name, (w, h, q) in sizes.items():
        made[name] = picture(w, h)
        raw = files.jpeg_bytes(w, h, made[name], q)
        assert header_size(raw) == ("jpeg", w, h)
        (tmp_path / f"{name}.jpg").write_bytes(raw)
    flat = np.full((20, 20, 3), (10, 200, 90), np.uint8)
    made["flat"], sizes["flat"] = flat, (20, 20, 90)
    (tmp_path / "flat.jpg").write_bytes(files.jpeg_bytes(20, 20, flat, 90))
    got = {r.path.rpartition("/")[2].split(".")[0]: r for r in read_images(spark, str(tmp_path)).collect()}
    assert set(got) == set(made)
    for name, want in made.items():
        w, h, q = sizes[name]
        px = np.frombuffer(got[name].data, np.uint8).reshape(h, w, 4)[..., :3].astype(int)
        assert np.abs(px - want).mean() < (3 if q >= 82 else 12), name
    with pytest.raises(ValueError):
        files.jpeg_bytes(1, 1, flat[:1, :1], 0)


def read_webp(raw):
    """A reader of the parts of lossless WebP that the writer uses."""
    assert raw[:4] == b"RIFF" and int.from_bytes(raw[4:8], "little") == len(raw) - 8 and raw[8:16] == b"WEBPVP8L"
    body = raw[20 : 20 + int.from_bytes(raw[16:20], "little")]
    bits = np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little").tolist()
    at = 8

    def take(n):
        nonlocal at
        v = sum(b << k for k, b in enumerate(bits[at : at + n]))
        at += n
        return v

    def tree(lengths):
        code, out = 0, {}
        for n in range(1, 16):
            for s, k in enumerate(lengths):
                if k == n:
                    out[n, code] = s
                    code += 1
            code <<= 1
        return out

    def symbol(t):
        if len(t) == 1:
            return next(iter(t.values()))
        n = code = 0
        while (n, code) not in t:
            code = code << 1 | take(1)
            n += 1
        return t[n, code]

    assert body[0] == 0x2F
    w, h = take(14) + 1, take(14) + 1
    alpha, version = take(1), take(3)
    assert version == 0 and take(3) == 0
    trees = []
    for size in (280, 256, 256, 256, 40):
        if take(1):
            n, wide = take(1) + 1, take(1)
            found = [take(8 if wide else 1)] + ([take(8)] if n == 2 else [])
            trees.append({(0, 0): found[0]} if n == 1 else {(1, 0): found[0], (1, 1): found[1]})
        else:
            order = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
            own = [0] * 19
            for k in range(take(4) + 4):
                own[order[k]] = take(3)
            assert take(1) == 0
            t = tree(own)
            trees.append(tree([symbol(t) for _ in range(size)]))
    out = np.empty((h * w, 4), np.uint8)
    for k in range(h * w):
        out[k, [1, 0, 2, 3]] = [symbol(t) for t in trees[:4]]
    return w, h, alpha, out.reshape(h, w, 4)


@pytest.mark.parametrize("case", ["noise", "flat", "two", "clear"])
def test_webp_is_lossless(case):
    from pixelloom.sources.rasters import header_size

    px = np.concatenate([picture(31, 17), np.full((17, 31, 1), 255, np.uint8)], 2)
    if case == "flat":
        px[:] = (1, 2, 3, 255)
    elif case == "two":
        px[..., 0], px[..., 1] = np.where(np.arange(31) % 2, 7, 200), 9
    elif case == "clear":
        px[..., 3] = np.random.default_rng(4).integers(0, 256, (17, 31))
    raw = files.webp_bytes(31, 17, px)
    assert header_size(raw) == ("webp", 31, 17)
    w, h, alpha, got = read_webp(raw)
    assert (w, h, alpha) == (31, 17, int(case == "clear")) and (got == px).all()
