"""run() against its stages done in plain Python, on the small table."""

import hashlib
import os

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm.test_corpus_ops import LOW, SF, brute_components  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_pipeline(spark):
    from tokenizers import Tokenizer

    from pixelloom.llm import pii, quality

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    table = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality.quality(table).filter("kept").collect()}
    texts = {r.doc_id: r.text for r in table.collect() if r.doc_id in good}
    seen = {}
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOW)
    for k, t in texts.items():
        for s in t.split("\n"):
            if len(key(s)) >= 20:
                seen.setdefault(key(s), set()).add(k)
    holders = {s: max(v) for s, v in seen.items() if len(v) >= 3}
    texts = {k: "\n".join(s for s in t.split("\n") if holders.get(key(s), k) == k) for k, t in texts.items()}
    order = sorted(texts)
    kept = [order[i] for i, (_, c) in enumerate(brute_components([texts[k] for k in order])) if c == i]
    left = spark.createDataFrame([(k, texts[k]) for k in kept], "doc_id bigint, text string")
    want = {r.doc_id: hashlib.sha256(np.array([*tok.encode(r.text, add_special_tokens=False).ids, 0], "<u4").tobytes()).hexdigest() for r in pii.redact(left).collect()}
    got = {}
    for r in sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, hashlib.sha256()).update(r.ids)
    assert {k: h.hexdigest() for k, h in got.items()} == want and len(corpus_pipeline.STAGES) == 5
