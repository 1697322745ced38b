"""The corpus operators against plain Python over a small table with odd rows: nulls, empty, blank and long texts, ties,
repeated rows, no rows, and other columns with clashing names."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from pixelloom.llm import bpe, jaccard_join, line_dedup, packing, pii, quality, queries, sharding, site_quality, warc, weighted_sampling  # noqa: E402
from pixelloom.llm.components import components  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def made_texts():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    out = [None, "", " \n\t\n", "one", "one two three", "ONE Two three", "a\n\nb\n", "x" * 3000, "word " * 400, "é😀 ñ　z's don't WE'LL  12² <|endoftext|> \r\n"]
    shared = "This very line is found in many documents, is it not"
    for k in range(60):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(5, 120))]
        lines = [" ".join(words[i : i + 15]) for i in range(0, len(words), 15)]
        if k % 3 == 0:
            lines.insert(rnd.randint(0, len(lines)), ("  " + shared.upper() + "\t") if k % 2 else shared)
        out.append("\n".join(lines))
        if k % 10 == 0:
            out.append(out[-1])
            out.append(out[-1].replace(words[0], "changed", 1))
    base = [rnd.choice(vocabulary) for _ in range(80)]
    for k in range(90):  # a large group of near copies
        near = list(base)
        near[rnd.randrange(80)] = f"edit{k}"
        out.append(" ".join(near))
    out.append("mail a@b.co or +1 (499) 555-6503, card 4111 1111 1111 1111, ip 10.0.0.255 and 999.1.1.1, IBAN GB82 WEST 1234 5698 7654 32")
    return out


TEXTS = made_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ("en", "de", "xx", None)[k % 4], f"src{k % 3}" if k % 5 else None, "clash", 7) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, h1 string, ids int").repartition(5).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows and ids, and rows without an id."""
    rows = [(1, "same text of this row, twenty"), (1, "same text of this row, twenty"), (1, "another"), (None, "no id here"), (None, None), (5, "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def no_rows(df):
    return df.filter(F.lit(False))


# 1
def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "x"), (3, None, "x"), (4, "u v", "x"), (None, "q", "x"), (9, "http://a/", "é" * 9000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = f"file://{tmp_path}/w"
    made = warc.write_archives(pages, folder, roll_bytes=200)
    got = warc.read_archives(made, folder).collect()
    assert len(got) == 7 and all(r.reason is None for r in got) and made.count() > 1
    by = {r.record_id: r for r in got}
    assert by["<urn:x-page:4>"].warc_type == "response" and by["<urn:x-page:3>"].refers_to == "<urn:x-page:4>" and by["<urn:x-page:1>"].refers_to == "<urn:x-page:2>"
    assert by["<urn:x-page:9>"].payload.decode() == "é" * 9000 and by["<urn:x-page:3>"].payload_length == 1
    assert warc.read_archives(warc.write_archives(no_rows(pages), f"file://{tmp_path}/e"), f"file://{tmp_path}/e").count() == 0


@pytest.mark.parametrize("zipped", [False, True])
def test_warc_salvage(zipped):
    import io

    recs = [warc.record_bytes(k, f"http://x/{k}", (b"p%d " % k) * 80, None if k % 2 else 7) for k in range(8)]

    def gz(b):
        c = zlib.compressobj(1, 8, 31)
        return c.compress(b) + c.flush()

    parts = [gz(r) if zipped else r for r in recs]
    whole = b"".join(parts)
    assert [x[0] for x in warc.salvage(io.BytesIO(whole))] == ["record"] * 8
    assert list(warc.salvage(io.BytesIO(b""))) == []
    rnd = random.Random(3)
    for _ in range(40):
        bad = bytearray(whole)
        for _ in range(rnd.randint(1, 3)):
            at = rnd.randrange(len(bad))
            if rnd.random() < 0.5:
                bad[at : at + rnd.randint(1, 40)] = rnd.randbytes(rnd.randint(0, 40))
            else:
                del bad[at : at + rnd.randint(1, 60)]
        out = list(warc.salvage(io.BytesIO(bytes(bad))))
        at = 0
        for x in out:  # records and gaps tile the file
            assert x[1] == at
            at += x[2]
        assert at == len(bad)
        intact = sum(bytes(bad).count(p) for p in parts)
        assert sum(x[0] == "record" for x in out) >= intact


# 2
def jaccard(a, b):
    k = set(a) | set(b)
    return sum(min(a[x], b[x]) for x in k) / sum(max(a[x], b[x]) for x in k) if k else 1.0


def test_weighted_sampling(spark, docs, odd):
    got = {r.doc_id: r for r in weighted_sampling.edited_pairs(docs).collect()}
    off = []
    for k, t in enumerate(TEXTS):
        t, nxt = t or "", TEXTS[(k + 1) % len(TEXTS)] or ""
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        assert got[k].n_chars == len(t) and got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off += [got[k].near_edited - jaccard(Counter(WORD.findall(t)), Counter(WORD.findall(edited))), got[k].near_next - jaccard(Counter(WORD.findall(t)), Counter(WORD.findall(nxt)))]
    assert np.sqrt(np.mean(np.square(off))) < 0.12
    prints = {}
    for k, t in enumerate(TEXTS):
        prints.setdefault(t or "", set()).add(got[k].fingerprint)
    assert all(len(v) == 1 for v in prints.values())
    alone = {r.doc_id: r.fingerprint for r in weighted_sampling.fingerprints(docs).collect()}
    assert alone == {k: r.fingerprint for k, r in got.items()}
    assert weighted_sampling.edited_pairs(odd).count() == 6 and weighted_sampling.edited_pairs(no_rows(odd)).count() == 0
    one = weighted_sampling.edited_pairs(odd.filter("text = 'another'")).first()
    assert one.near_next == 1.0


def test_weighted_sampling_is_unbiased(spark):
    """Pairs with words of their own, so that errors are independent: samples agree as often as the similarity says."""
    rnd, rows, want = random.Random(8), [], []
    for k in range(150):
        a = [f"w{k}_{rnd.randrange(12)}" for _ in range(rnd.randint(5, 60))]
        b = [w for w in a if rnd.random() < 0.7] + [f"w{k}_{rnd.randrange(20)}" for _ in range(rnd.randint(0, 30))]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        want.append(jaccard(Counter(a), Counter(b)))
    got = {r.doc_id: r.samples for r in weighted_sampling.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    near = [np.mean([x == y for x, y in zip(got[2 * k], got[2 * k + 1], strict=True)]) for k in range(150)]
    assert abs(np.mean(near) - np.mean(want)) < 0.02 and np.sqrt(np.mean(np.square(np.subtract(near, want)))) < 0.1


# 3
def reference_encoder(name):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, docs, odd):
    name = "byte_bpe_multi_50k.tiktoken"
    ref = reference_encoder(name)
    out = bpe.decode_documents(bpe.encode_documents(docs, P.path(name)), P.path(name)).collect()
    for r in out:
        want = ref.encode_ordinary(TEXTS[r.doc_id] or "")
        assert list(r.ids) == want and bytes(r.decoded) == (TEXTS[r.doc_id] or "").encode() and r.h1 == "clash"
    for r in bpe.digest_documents(odd, P.path(name), ["doc_id"]).collect():
        assert r.n_tokens >= 0 and len(r.ids_sha256) == 64
    assert bpe.encode_documents(no_rows(docs), P.path(name)).count() == 0


def test_bpe_fuzz():
    import pyarrow as pa

    from pixelloom.llm import textbatch as tb

    name = "byte_bpe_multi_50k.tiktoken"
    ref, mine, rnd = reference_encoder(name), bpe.encoder(P.path(name)), random.Random(1)
    alphabet = ["'", "s", "t", "re", "r", "v", "e", "ve", "ll", "l", "m", "d", " ", "  ", "\n", "\t", "1", "²", "a", "é", "中", "!", "''", "😀", "　", "S", "\r\n", "\x1c", "́", "Ⅷ"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(4000)] + ["ab" * 2000 + " " * 500, "'" * 300]
    got = [ids for _, _, d, o in tb.text_runs(pa.array(texts)) for ids in mine.encode(d, o)]
    assert all(g == ref.encode_ordinary(t) and mine.decode(g) == t.encode() for g, t in zip(got, texts, strict=True))


# 4
def test_line_dedup(spark, docs, odd):
    holders, seen = {}, {}
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOW)
    for k, t in enumerate(TEXTS):
        for s in (t or "").split("\n"):
            if len(key(s)) >= 20:
                seen.setdefault(key(s), set()).add(k)
    holders = {s: max(v) for s, v in seen.items() if len(v) >= 3}
    assert holders
    for batches, fanout in ((1, 4), (4, 4), (5, 2)):
        got = {r.doc_id: r for r in line_dedup.dedup_lines(docs, batches=batches, fanout=fanout).collect()}
        for k, t in enumerate(TEXTS):
            lines = (t or "").split("\n")
            kept = [s for s in lines if holders.get(key(s), k) == k]
            assert (got[k].text, got[k].n_lines, got[k].n_dropped, got[k].h1) == ("\n".join(kept), len(lines), len(lines) - len(kept), "clash")
    assert sorted(r.n_dropped for r in line_dedup.dedup_lines(odd, min_docs=1).collect()) == [0] * 6
    assert line_dedup.dedup_lines(no_rows(docs)).count() == 0


# 5
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(int(c) for c in reversed(d))) % 10 == 0


def base_spans(t):
    ok = {
        "email": lambda m, d: True, "ip": lambda m, d: all(int(x) <= 255 for x in m.split(".")), "card": lambda m, d: 12 <= len(d) <= 19 and luhn(d), "phone": lambda m, d: 9 <= len(d) <= 15,
    }
    found = [(m.start(), k, n, m.end()) for k, (n, p) in enumerate(BASE.items()) for m in re.finditer(p, t) if ok[n](m[0], re.sub("[^0-9]", "", m[0]))]
    return ",".join(f"{n}:{s}:{e}" for s, _, n, e in sorted(found))


def test_pii(spark):
    rnd = random.Random(2)
    bits = ["a@b.c", "_d@e.f", "é", "😀", " ", "-", ".", "@", "1", "22", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (499) 555-6503", "+", "(", ")", "10.0.0.1", "x.y", "GB82WEST12345698765432", "%", "\n"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(600)] + [*TEXTS, "9" * 5000 + " " + "1 " * 3000 + "@" + "a" * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    for r in pii.find_pii(df).collect():
        got = ",".join(f"{s.kind}:{s.start}:{s.stop}" for s in r.pii if s.kind in BASE)
        assert got == base_spans(texts[r.doc_id] or "")
    one = spark.createDataFrame([(TEXTS[-1],), (None,), ("call 555-123-4567",), ("order 555-123-4567",)], "text string")
    out = [r.text for r in pii.redact(one).collect()]
    assert out[0] == "mail [EMAIL] or [PHONE], card [CARD], ip [IP] and 999.1.1.1, IBAN [IBAN]" and out[1:] == [None, "call [TEL]", "order 555-123-4567"]
    assert pii.find_pii(no_rows(df)).count() == 0


def test_pii_iban_with_text_behind(spark):
    de, gb, no = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"
    texts = {
        f"IBAN {de} Please pay": [de], f"IBAN {de} BIC COBADEFF": [de], f"IBAN {de} 2024 x": [de], f"é account {gb} A1 9 B": [gb], f"bank {no} 7": [no],
        f"iban {de} {gb} {no} END": [de, gb, no], f"iban {de}.": [de], f"iban AB12 3456 7890 1234 {de} OK": [de], f"iban {de[:-1]}1 Please": [],
        f"iban {de}X": [], f"iban X{de}": [], f"iban {de}\nPLEASE": [de], "iban QQ50 0000 0000 0000 001 x": ["QQ50 0000 0000 0000 001"],
    }
    for r in pii.find_pii(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
        assert [r.text[s.start : s.stop] for s in r.pii if s.kind == "iban"] == texts[r.text], r.text


# 6
@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64, 65, 1000])
def test_feistel_is_a_permutation(spark, n):
    got = [r[0] for r in spark.range(n).selectExpr(sharding.permuted("id", max(n, 1), 3)).collect()]
    assert sorted(got) == list(range(n))
    if n == 1000:
        assert got != sorted(got) and got != [r[0] for r in spark.range(n).selectExpr(sharding.permuted("id", n, 4)).collect()]


def test_sharding(spark, docs, odd):
    got = sharding.feistel_shards(docs, 8).collect()
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.feistel_shards(docs.repartition(2), 8).collect()}
    for r in got:
        raw = (TEXTS[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and again[r.doc_id] == (r.shard, r.slot)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s, c in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(c))
    assert sorted(r.row_number for r in sharding.feistel_shards(odd, 2).collect()) == list(range(6))
    assert sharding.feistel_shards(no_rows(docs), 8).count() == 0


# 7
def test_prior_strength():
    assert site_quality.prior_strength(0, 0, 0, 0) == site_quality.MOST_PRIOR
    rnd = np.random.default_rng(1)
    rates = rnd.beta(8, 2, 400)
    n = np.full(400, 200.0)
    good = rnd.binomial(200, rates)
    mean = good.sum() / n.sum()
    got = site_quality.prior_strength(good.sum(), n.sum(), (n * (good / n - mean) ** 2).sum(), 400)
    assert 7 < got < 14  # 8 + 2 made them


def test_site_quality(spark, docs):
    labels = docs.selectExpr("doc_id", "cast(length(coalesce(text, '')) > 60 as int) as quality").filter("doc_id % 2 = 0")
    out = site_quality.site_quality(docs, labels).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.quality <= 1 and 0 < r.path_rate < 1 for r in out)
    held = [(r.quality > 0.5, len(TEXTS[r.doc_id] or "") > 60) for r in out if r.doc_id % 2]
    assert np.mean([a == b for a, b in held]) > 0.85
    few = site_quality.site_quality(docs, no_rows(labels)).collect()
    assert {round(r.doc_score, 6) for r in few} == {0.5}
    assert site_quality.site_quality(no_rows(docs), labels).count() == 0


@needs_tables
def test_site_quality_held_out(spark):
    d = "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else SF
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = site_quality.site_quality(spark.read.parquet(f"{d}/documents.parquet"), labels.filter("doc_id % 3 != 0"))
    held = out.drop("kept").withColumnRenamed("quality", "score").join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and np.mean([g >= site_quality.KEEP_FROM for g in good]) > 0.97


# 8
def shingles(t):
    w = WORD.findall((t or "").translate(LOW))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                u, v = sorted((top(i), top(j)))
                parent[v] = u
    return [(len(s), top(k)) for k, s in enumerate(sets)]


@pytest.mark.parametrize("long, block, hot, split", [(32, 1024, 1000, 50_000), (4, 16, 1000, 50_000), (8, 16, 30, 10)])
def test_jaccard_join(spark, docs, odd, monkeypatch, long, block, hot, split):
    for name, value in (("LONG", long), ("BLOCK", block), ("HOT_LEAST", hot), ("SPLIT", split), ("HELD", 2000), ("PER_COUNT", 1000)):
        monkeypatch.setattr(jaccard_join, name, value)
    want = brute_components(TEXTS)
    assert max(Counter(c for _, c in want).values()) > 40
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()}
    assert [got[k] for k in range(len(TEXTS))] == want
    rows = jaccard_join.near_duplicates(odd).collect()
    assert len(rows) == 6 and jaccard_join.near_duplicates(no_rows(docs)).count() == 0


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(80)]
    parent = {}

    def top(k):
        parent.setdefault(k, k)
        while parent[k] != k:
            k = parent[k]
        return k

    for u, v in edges:
        parent[top(u)] = top(v)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert set(got) == {k for e in edges if e[0] != e[1] for k in e}
    groups = {}
    for k in got:
        groups.setdefault(top(k), set()).add(got[k])
    assert all(len(v) == 1 for v in groups.values()) and len({next(iter(v)) for v in groups.values()}) == len(groups)


# 9
def counted(t):
    w, dup, seen = WORD.findall(t or ""), 0, set()
    for s in (t or "").split("\n"):
        if WORD.search(s):
            dup += s in seen
            seen.add(s)
    c, hit = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), [False] * len(w)
    for i in range(len(w) - 7):
        if c[tuple(w[i : i + 8])] > 1:
            hit[i : i + 8] = [True] * 8
    return len(w), sum(map(len, w)), sum((t or "").count(x) for x in "#*$%&|<>"), dup, sum(hit)


def test_quality(spark, docs):
    for r in quality.quality(docs).collect():
        n = counted(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (r.kept and r.base_failed) and r.h1 == "clash"
    p, q = np.array([3.0, 1.0]) / 4, np.array([1.0, 1.0]) / 2
    m = (p + q) / 2
    want = np.sqrt((sum(p * np.log2(p / m)) + sum(q * np.log2(q / m))) / 2)
    assert quality.js_distance(np.array([[3, 1], [0, 0]]), q).round(9).tolist() == [round(float(want), 9), 0.0]
    assert quality.keep_good(docs).columns == docs.columns and quality.quality(no_rows(docs)).count() == 0


@needs_tables
def test_quality_keeps_good_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    kept = quality.quality(d, carry=["doc_id"]).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.kept or r.base_failed for r in kept if r.quality == 1)
    assert sum(not r.kept for r in kept if r.quality == 0) >= sum(r.quality == 0 for r in kept) * 0.7


@pytest.mark.parametrize("lang", [*quality.LANGS, None])
@pytest.mark.parametrize("n", [40, 200, 2000, 50000])
def test_quality_misses_common_words(lang, n):
    rnd = random.Random(n)
    letters = "abcdefghilmnoprstuv" * 2 + "é" * (lang != "en")
    odd = ["".join(rnd.choice(letters) for _ in range(rnd.randint(3, 8))) + ("." if k % 9 == 0 else "") for k in range(n)]
    odd = [w.capitalize() if k % (4 if lang == "de" else 20) == 0 else w for k, w in enumerate(odd)]
    words = quality.COMMON_WORDS[lang or "fr"].split()[::2]
    prose = [rnd.choice(words) if k % 4 == 1 else w for k, w in enumerate(odd)]
    raw = [" ".join(x).encode() for x in (odd, prose)]
    out = quality.measures(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), [lang] * 2)
    assert not out["base_failed"].any() and (out["js_chars"] < quality.MOST_CHARS).all() and out["diverges"].tolist() == [True, False]
    assert quality.missing_distance(np.array([0]), np.array([0]), 0.3).tolist() == [0.0]


# 10
def test_packing(spark, docs, odd):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.pack(docs, path).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for k, t in enumerate(TEXTS):
        want = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[k], key=lambda r: r.start)
        assert b"".join(r.ids for r in pieces) == want.tobytes() and {r.doc_tokens for r in pieces} == {len(want)}
        assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
    for s in by_seq.values():
        s.sort(key=lambda r: r.offset)
        total = sum(r.length for r in s)
        assert [r.offset for r in s] == np.cumsum([0] + [r.length for r in s])[:-1].tolist() and total <= 1024 and total & (total - 1) == 0
    assert packing.pack(no_rows(docs), path).count() == 0 and packing.pack(odd, path).count() >= 6


@needs_tables
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_registered(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in queries.ORACLES:
        c = duckdb.connect()
        for t in ("documents", "pages", "labels"):
            c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = c.sql(queries.ORACLES[name]).df()
        cols = sorted(want.columns)
        clean = lambda d: d[cols].astype(object).where(d[cols].notna(), None).sort_values(cols).astype(str).reset_index(drop=True)
        assert sorted(got.columns) == cols and clean(got).equals(clean(want))
