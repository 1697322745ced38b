"""Odd rows and brute force for the corpus operators: very long texts, shared and missing ids, damaged archives, other
languages, and the columns that queries return."""

import hashlib
import io
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from pixelloom.llm import bpe, jaccard_join, line_dedup, packing, pii, quality, sharding, site_quality, warc, weighted_sampling  # noqa: E402
from tests.llm.test_corpus_ops import BASE, TEXTS, base_spans, counted, jaccard, reference_encoder, shingles  # noqa: E402


def table(spark, texts, **more):
    rows = [(k, t, *[v[k] for v in more.values()]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(["doc_id bigint, text string", *[f"{k} string" for k in more]]))


# 1
def gz(b):
    c = zlib.compressobj(1, 8, 31)
    return c.compress(b) + c.flush()


def test_warc_long_headers_and_payloads(spark, tmp_path):
    rows = [(1, "http://a/" + "u" * 1_000_000, "short"), (2, "http://b", "é" * 1_500_000), (3, "line\r\n\r\nbreak " * 20_000, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = f"file://{tmp_path}/w"
    got = {r.record_id: r for r in warc.read_archives(warc.write_archives(pages, folder), folder).collect()}
    assert all(r.reason is None for r in got.values()) and len(got) == 3
    assert got["<urn:x-page:1>"].target_uri == rows[0][1] and got["<urn:x-page:2>"].payload.decode() == rows[1][2]
    assert got["<urn:x-page:3>"].target_uri == " ".join(rows[2][1].split()) and got["<urn:x-page:3>"].payload == b""


def test_warc_shared_members_and_digests():
    recs = [warc.record_bytes(k, f"http://x/{k}", b"payload %d" % k, None) for k in range(4)]
    out = list(warc.salvage(io.BytesIO(gz(recs[0] + recs[1]) + gz(recs[2]))))
    assert [x[0] for x in out] == ["record"] * 3 and [x[2] > 0 for x in out] == [True, False, True]
    torn = recs[0] + recs[1].replace(b"payload 1", b"payload 9") + recs[2]
    assert [x[0] for x in warc.salvage(io.BytesIO(gz(torn)))] == ["record", "gap", "record"]
    wrong = recs[3].replace(warc.payload_digest(b"payload 3").encode(), b"A" * 32, 1)
    assert [x[0] for x in warc.salvage(io.BytesIO(wrong + recs[0]))] == ["gap", "record"]
    assert [x[0] for x in warc.salvage(io.BytesIO(gz(b"") + gz(recs[0])))] == ["gap", "record"]
    endless = b"WARC/1.1\r\n" + b"a: b\r\n" * 50_000
    assert [x[0] for x in warc.salvage(io.BytesIO(endless + gz(recs[1])))] == ["gap", "record"]


def test_warc_gap_is_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "record_bytes", lambda *a: b"WARC/1.1\r\nno colon\r\n\r\n")
    spark.createDataFrame([(1, "u", "x")], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    made = warc.write_archives(spark.read.parquet(f"{tmp_path}/pages.parquet"), f"file://{tmp_path}/w")
    assert [r.reason for r in warc.read_archives(made, f"file://{tmp_path}/w").collect()] != [None]


# 2
def test_weighted_sampling_long_text(spark):
    rnd = random.Random(3)
    long = " ".join(f"w{rnd.randrange(5000)}" for _ in range(150_000))
    texts = [long, long + " tail", "x" * 200_000, "abc def\n" + "y" * 3, None]
    got = {r.doc_id: r for r in weighted_sampling.edited_pairs(table(spark, texts)).collect()}
    assert got[0].near_next > 0.9 and got[3].n_chars == 11
    for k, t in enumerate(texts):
        nxt = texts[(k + 1) % len(texts)] or ""
        edited = (t or "")[: len(t or "") - len(t or "") // 4] + nxt[: len(t or "") // 4]
        alone = weighted_sampling.fingerprints(table(spark, [edited])).first().fingerprint
        assert got[k].edited_fingerprint == alone, k
    assert jaccard(Counter("a b".split()), Counter("a b".split())) == 1


# 3
def test_bpe_offsets(spark):
    name = "byte_bpe_multi_50k.tiktoken"
    ref = reference_encoder(name)
    texts = [*TEXTS[:20], " " * 300_000, "\n" * 100_000, "ab" * 100_000, "é😀 " * 20_000]
    rows = bpe.encode_documents(table(spark, texts, ids=["clash"] * len(texts)), P.path(name)).collect()
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r.offsets[0] == 0 and r.offsets[-1] == len(raw) and len(r.offsets) == len(r.ids) + 1
        if len(raw) < 200_000 and raw.strip():
            assert list(r.ids) == ref.encode_ordinary(raw.decode())
        a, b = len(r.ids) // 3, 2 * len(r.ids) // 3
        assert bpe.encoder(P.path(name)).decode(r.ids[a:b], r.offsets[a : b + 1]) == raw[r.offsets[a] : r.offsets[b]]
    with pytest.raises(ValueError):
        bpe.encoder(P.path(name)).decode([1, 2], [0, 1, 100])
    for r in bpe.digest_documents(table(spark, texts[:20]), P.path(name), ["doc_id"]).collect():
        ids = ref.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


# 4
def test_line_dedup_long_texts(spark):
    line = "a line of more than twenty code points"
    texts = ["\n".join([line] + [f"own line number {k} of the text {j}" for j in range(30_000)]) for k in range(3)] + ["z" * 500_000, "\n" * 50_000]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(table(spark, texts, n_lines=["x"] * 5)).collect()}
    assert [got[k].n_dropped for k in range(5)] == [1, 1, 0, 0, 0] and got[4].n_lines == 50_001
    assert got[2].text == texts[2] and got[3].text == texts[3]


# 5
def test_pii_query_columns(spark, tmp_path):
    texts = [t or "" for t in TEXTS[-8:]] + ["a@b.co " * 300 + "+1 499 555 6503 " * 50, "hotel 555-123-4567", "555-123-4567 is my phone", 'token = "bc0a5302762f37969011b69180d661037b374f6e"', ""]
    table(spark, [*texts, None]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in pii.op5_pii_spans(spark, str(tmp_path)).collect()}
    for k, t in enumerate([*texts, ""]):
        want = base_spans(t)
        assert rows[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [rows[k][f"n_{x}"] for x in BASE] == [sum(s.startswith(x + ":") for s in want.split(",")) for x in BASE]
        listed = [s for s in rows[k].spans.split(",") if s]
        assert [s for s in listed if s.split(":")[0] in BASE] == [s for s in want.split(",") if s] and len(rows[k].scores) == len(listed)
    at = len(TEXTS[-8:])
    assert [rows[at + 1].spans, rows[at + 2].spans, rows[at + 3].spans] == ["", "tel:0:12", "secret:9:49"]


def test_pii_context_scores(spark):
    near = {"call 555-123-4567": True, "calling 555-123-4567": False, "basically 555-123-4567": False, "555-123-4567, tel": True, "x" * 45 + " 555-123-4567 " + "y" * 45 + " tel": False, "phones: 555-123-4567": True}
    got = {r.text: len(r.pii) > 0 for r in pii.find_pii(spark.createDataFrame([(t,) for t in near], "text string")).collect()}
    assert got == near


def test_redaction_of_overlaps_and_long_texts(spark):
    rnd = random.Random(6)
    bits = ["a@10.0.0.1", "+10.0.0.1 499 555 65", "4111 1111 1111 1111", "é😀", " mail ", "tel 555-123-4567", "x" * 5000, "\n", ""]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(150)] + ["a@b.co " * 20_000, None]
    df = table(spark, texts, pii=["clash"] * len(texts))
    spans = {r.doc_id: r.pii for r in pii.find_pii(df).collect()}
    for r in pii.redact(df).collect():
        t, out, at = texts[r.doc_id], "", 0
        for s in spans[r.doc_id]:
            if s.start >= at:
                out += t[at : s.start] + f"[{s.kind.upper()}]"
            at = max(at, s.stop)
        assert r.text == (None if t is None else out + t[at:]) and r.pii == "clash"


# 6
def test_feistel_in_plain_python(spark):
    xxhash = pytest.importorskip("xxhash")

    def hashed(*values):
        h = 42
        for v in values:
            h = xxhash.xxh64(struct.pack("<q", v), seed=h).intdigest()
        return h - (1 << 64) if h >> 63 else h

    def place(k, n, seed):
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            x, y, m, o = k // b, k % b, a, b
            for key in sharding.ROUND_KEYS:
                x, y, m, o = y, (x + hashed(y, key ^ seed) % m) % m, o, m
            k = x * b + y
            if k < n:
                return k

    for n, seed in ((97, 0), (500, 7)):
        got = [r[0] for r in spark.range(n).selectExpr(sharding.permuted("id", n, seed)).collect()]
        assert got == [place(k, n, seed) for k in range(n)]


def test_shards_of_rows_without_ids(spark):
    rows = [(None, f"text {k}", 1) for k in range(300)] + [(7, "same", 2)] * 60
    got = sharding.feistel_shards(spark.createDataFrame(rows, "doc_id bigint, text string, slot int"), 8).collect()
    assert sorted(r.row_number for r in got) == list(range(360)) and sorted(Counter(r.shard for r in got).values()) == [45] * 8


# 7
def test_site_quality_by_hand(spark):
    """Rates and verdicts from the formulas, in plain Python, given the scores of documents."""
    rnd = random.Random(11)
    rows, labels = [], []
    for k in range(240):
        host, path = rnd.choice(["a", "b", "c", None]), rnd.choice(["x", "y", None])
        rows.append((k, " ".join(rnd.choice(["the", "of", "zq"]) for _ in range(rnd.randint(5, 60))), host, path))
        if k % 3:
            labels.append((k, int(rnd.random() < {"a": 0.9, "b": 0.4, "c": 0.7, None: 0.5}[host])))
    labels += [(3, None), (999, 1), (5, 7)]
    docs = spark.createDataFrame(rows + [rows[0]], "doc_id bigint, text string, source string, lang string")
    got = site_quality.site_quality(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    good = {k: v for k, v in labels if v in (0, 1) and k < 240 and k % 3}
    known = [(r[2] or "", r[3] or "", good[r[0]]) for r in [*rows, rows[0]] if r[0] in good]
    rate = min(max(np.mean([g for *_, g in known]), 1e-3), 1 - 1e-3)

    def level(key, parent):
        groups = defaultdict(list)
        for h, p, g in known:
            groups[key(h, p)].append(g)
        squares = sum(len(v) * (np.mean(v) - parent(k)) ** 2 for k, v in groups.items())
        strength = site_quality.prior_strength(sum(map(sum, groups.values())), len(known), squares, len(groups))
        return {k: (sum(v) + parent(k) * strength) / (len(v) + strength) for k, v in groups.items()}

    hosts = level(lambda h, p: h, lambda k: rate)
    paths = level(lambda h, p: (h, p), lambda k: hosts[k[0]])
    logit = lambda p: math.log(p / (1 - p))
    assert len(got) == 241
    for r in got:
        h = hosts.get(r.host, rate)
        p = paths.get((r.host, r.path), h)
        z = logit(r.doc_score) + site_quality.SITE_WEIGHT * (logit(p) - logit(rate))
        assert abs(r.host_rate - h) < 1e-9 and abs(r.path_rate - p) < 1e-9
        assert abs(r.quality - 1 / (1 + math.exp(-z))) < 1e-6 and r.kept == (r.quality >= site_quality.KEEP_FROM)


def test_site_quality_repeated_and_missing_ids(spark):
    rows = [(1, "some words here " * 9, "h", "p")] * 50 + [(None, "none", None, None), (2, "x" * 100_000, "h", "q"), (3, None, "h", "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").withColumn("value", F.lit("clash"))
    got = site_quality.site_quality(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")).collect()
    assert len(got) == 53 and len({r.quality for r in got if r.doc_id == 1}) == 1


# 8
def test_jaccard_keeps_one_row(spark):
    words = [f"w{k}" for k in range(60)]
    a, b = " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(4, a), (4, a), (2, b), (None, b), (7, "unlike text of its own here"), (7, "another unlike text is this"), (None, "no id one two three"), (None, "no id four five six"), (9, ""), (9, ""), (9, None), (1, "A b"), (3, "a B")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, th string")
    got = sorted([(r.doc_id or 0, r.text or "") for r in jaccard_join.keep_one(docs).collect()])
    assert got == sorted([(2, b), (7, rows[4][1]), (7, rows[5][1]), (0, rows[6][1]), (0, rows[7][1]), (9, ""), (9, ""), (9, ""), (1, "A b")])
    once = jaccard_join.keep_one(spark.createDataFrame([(5, a)] * 20 + [(None, b)] * 7, "doc_id bigint, text string")).collect()
    assert [(r.doc_id, r.text) for r in once] == [(5, a)]
    assert jaccard_join.keep_one(docs.filter("false")).count() == 0 and jaccard_join.keep_one(docs).columns == docs.columns


def test_jaccard_long_texts(spark):
    rnd = random.Random(9)
    long = [f"w{rnd.randrange(10**6)}" for _ in range(60_000)]
    near = list(long)
    near[30_000] = "changed"
    texts = [" ".join(long), " ".join(near), " ".join(long[:40_000]), "x" * 300_000, "x" * 300_000]
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(table(spark, texts)).collect()}
    assert [got[k].component_id for k in range(5)] == [0, 0, 2, 3, 3]
    assert [got[k].n_shingles for k in range(5)] == [len(shingles(t)) for t in texts]


# 9
def test_quality_other_languages(spark):
    zh = "天地玄黄宇宙洪荒日月盈昃辰宿列张 " * 30
    ru = "слово за слово и дело пошло быстрее чем думали все вокруг " * 2 + " ".join(f"слово{k}" for k in range(60))
    texts, langs = [zh + " ".join(map(chr, range(0x4E00, 0x4E60))), ru, ru, "the cat sat on the mat of " * 3 + " ".join(f"word{chr(97 + k % 26)}" for k in range(60))], ["zh", "ru", None, "EN-us"]
    got = {r.doc_id: r for r in quality.quality(table(spark, texts, lang=langs)).collect()}
    assert [got[k].has_reference for k in range(4)] == [False, False, False, True] and not any(got[k].diverges for k in range(3))


def test_quality_learned_references(spark):
    rnd = random.Random(5)
    filler = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8)))
    prose = lambda: " ".join(rnd.choice(["zu", "ko", "mi"]) if k % 3 == 0 else filler() for k in range(150))
    texts = [prose() for _ in range(80)] + [" ".join(filler() for _ in range(150)) for _ in range(10)] + [prose() for _ in range(10)] + [None]
    docs = table(spark, texts, lang=["xx-Y"] * 95 + ["yy"] * 5 + [None])
    labels = spark.createDataFrame([(k, 1) for k in range(80)] + [(99, 1), (80, 0), (1, 1)], "doc_id bigint, quality int")
    refs = quality.learned_references(docs, labels, n_words=3)
    assert refs.langs == ("xx",) and 0.3 < 1 - refs.words["xx"][-1] < 0.36 and len(refs.hashes) == 6
    got = {r.doc_id: r for r in quality.quality(docs, references=refs).collect()}
    assert not any(got[k].diverges for k in [*range(80), *range(90, 100)]) and all(got[k].diverges for k in range(80, 90))
    assert [got[k].has_reference for k in (0, 97, 100)] == [True, False, True]
    none = quality.learned_references(docs, labels.filter("false"))
    assert none.langs == () and not any(r.diverges or r.has_reference for r in quality.quality(docs, references=none).collect())
    assert quality.keep_good(docs, references=refs).count() == 90


def js(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m, strict=True) if a > 0)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def test_quality_verdict_by_hand(spark):
    rnd = random.Random(4)
    made = []
    for _ in range(120):
        words = [rnd.choice(["the", "of", "and", "The", "der", "die", "zzq", "12", "#x$", "é", "naïve", "word,"]) for _ in range(rnd.randint(10, 120))]
        made.append(" ".join(words))
    langs = [("en", "de", "fr", "es")[k % 4] for k in range(len(made))]
    for r in quality.quality(table(spark, made, lang=langs)).collect():
        t, n = made[r.doc_id], counted(made[r.doc_id])
        kinds = [0] * 7
        for c in t:
            kinds[0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t\n\x0b\x0c\r" else 4 if c in ".,;:!?'\"()-" else 5 if c < "\x80" else 6] += 1
        ref = quality.CHAR_SHARES[r.lang]
        far = js([x / len(t) for x in kinds], [x / sum(ref) for x in ref])
        shares = {w: int(v) / 1000 for w, v in zip(quality.COMMON_WORDS[r.lang].split()[::2], quality.COMMON_WORDS[r.lang].split()[1::2], strict=True)}
        names = list(dict.fromkeys(w for s in quality.COMMON_WORDS.values() for w in s.split()[::2]))
        found = Counter(w if w in names else w[0].lower() + w[1:] for w in t.split(" ") if w in names or (w[:1].isupper() and w[0].lower() + w[1:] in names))
        p = [found[w] / n[0] for w in names]
        q = [shares.get(w, 0) for w in names]
        words = js([*p, 1 - sum(p)], [*q, 1 - sum(q)])
        missing = []
        for s in quality.COMMON_WORDS.values():
            own = dict(zip(s.split()[::2], map(int, s.split()[1::2]), strict=True))
            share, have = sum(own.values()) / 1000, sum(found[w] for w in own) / n[0]
            missing.append(js([have, 1 - have], [share, 1 - share]) if have < share else 0)
        assert abs(r.js_chars - far) < 1e-9 and abs(r.js_words - words) < 1e-9 and abs(r.js_missing - min(missing)) < 1e-9
        slack = quality.SLACK / math.sqrt(n[0])
        odd = (len(t) >= quality.GUARD_CHARS and far > quality.MOST_CHARS + slack) or (
            n[0] >= quality.GUARD_WORDS and (words > quality.MOST_WORDS + slack or min(missing) > quality.MOST_MISSING + quality.MISSING_SLACK / math.sqrt(n[0])))
        assert r.diverges == odd and r.kept == (not odd and not r.base_failed)


# 10
def test_packing_of_long_runs(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = [" " * 1_200_000, "\n" * 1_100_000, "a" * 300_000, "a " * 200_000, None, "<|endoftext|> " * 3]
    docs = table(spark, texts, start=["clash"] * 6)
    rows = packing.pack(docs, path).collect()
    for k, t in enumerate(texts):
        want = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert b"".join(r.ids for r in sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)) == want


# the pipeline's stages
def test_pipeline_stages_with_odd_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    prose = lambda k: " ".join(("the", "cat", "of", "and", "to", f"word{k}", "in", "a", "house", f"thing{k * 7 % 11}")[j % 10] + ("" if j % 9 else ".") for j in range(60))
    fine = [re.sub("cat", f"c{chr(97 + k)}t", prose(k)) + f" {k} " + " ".join(f"{chr(97 + k)}{chr(97 + j)}x the" for j in range(12)) for k in range(6)]
    rows = [(1, fine[0]), (1, fine[1]), (None, fine[2]), (None, fine[3]), (None, fine[3]), (2, None), (3, ""), (4, fine[4] + " mail a@b.co"), (5, fine[5])]
    docs = spark.createDataFrame([(*r, "kept", 5) for r in rows], "doc_id bigint, text string, kept string, n_lines int")
    for name, stage in pipeline.STAGES:
        empty = stage(spark, docs.filter("false"), str(tmp_path))
        assert empty.count() == 0
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == list(pipeline.COLUMNS) and [f.dataType.simpleString() for f in out.schema.fields] == list(pipeline.COLUMNS.values())
        if name == "near_duplicates":
            assert sorted(r.text or "" for r in out.collect()) == sorted(["", "", *fine[:4], rows[7][1], fine[5]])
        elif name in ("line_dedup", "pii"):
            assert out.count() == len(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = pipeline.run(spark, str(tmp_path)).select("doc_id", "doc_tokens").distinct().count()
    assert kept >= 5
