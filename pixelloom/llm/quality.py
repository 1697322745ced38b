"""Quality rules by distribution divergence.

A text's character classes and common words are held against references of its language with the Jensen-Shannon
distance (base 2, 0 to 1), once the text is long enough for a histogram to mean something; shorter texts, and texts
in a language without a reference, pass these tests. All other words have most of the mass in the histogram of words, so that a text without common words is
not far in it; a second distance, of the two shares common and other alone, is for those. Counting rules for tiny and repetitive texts come first. The work is one pass of numpy over Arrow
batches without any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbatch as tb
from .common import table, tidied

MIN_WORDS, REPEAT_WIDTH, REPEAT_PERCENT = 20, 8, 30
#: From so many code points, and words, on the histograms count.
GUARD_CHARS, GUARD_WORDS = 80, 40
#: The largest distances that pass in a text of n words are these plus SLACK / sqrt(n), for the noise of few words.
MOST_CHARS, MOST_WORDS, SLACK = 0.16, 0.41, 0.9
#: The same for texts with fewer common words than prose. A text without any is at 0.37 to 0.45 and fails at every
#: length from GUARD_WORDS on.
MOST_MISSING, MISSING_SLACK = 0.22, 0.2
SYMBOLS = b"#*$%&|<>"

#: Shares of lower-case letters, capitals, digits, blanks, sentence punctuation, other ASCII signs and code points
#: beyond ASCII in ordinary prose; fixed values.
CHAR_SHARES = {
    "en": (0.785, 0.025, 0.005, 0.160, 0.020, 0.004, 0.001),
    "de": (0.770, 0.050, 0.005, 0.135, 0.020, 0.004, 0.016),
    "fr": (0.765, 0.022, 0.005, 0.155, 0.020, 0.004, 0.029),
    "es": (0.780, 0.022, 0.005, 0.155, 0.018, 0.004, 0.016),
}
#: The most common words of each language with their shares of all words in prose, in per mille; fixed values.
COMMON_WORDS = {
    "en": "the 60 of 33 and 29 to 26 a 23 in 21 that 11 is 10 was 10 it 9 for 9 on 7 with 7 as 7 be 6 by 5 at 5 are 5 this 5 or 4",
    "de": "der 35 die 33 und 28 in 18 den 11 von 11 zu 11 das 10 mit 9 sich 8 des 8 auf 8 für 8 ist 8 im 7 dem 7 nicht 7 ein 7 eine 6 als 6",
    "fr": "de 50 la 33 le 26 et 24 les 22 des 20 en 16 un 13 du 13 une 12 que 10 est 10 dans 9 qui 8 par 8 pour 8 au 7 sur 6 pas 5 avec 4",
    "es": "de 62 la 38 que 29 el 29 en 26 y 25 a 20 los 17 se 12 del 12 las 11 un 10 por 10 con 9 no 9 una 9 su 8 para 7 es 7 al 6",
}
LANGS = tuple(CHAR_SHARES)
#: Languages that references are learned for.
MOST_LANGS = 64
#: A text without a language is held against the nearest reference, unless more than this share of its code points (blanks
#: aside) is beyond ASCII: then it is in another script, for which there is none.
MOST_FOREIGN = 0.5

_CLASS = np.full(256, 5, np.uint8)
_CLASS[[*range(0x61, 0x7B)]], _CLASS[[*range(0x41, 0x5B)]], _CLASS[[*range(0x30, 0x3A)]] = 0, 1, 2
_CLASS[tb.BLANK] = 3
_CLASS[[*b".,;:!?'\"()-"]] = 4
_CLASS[0x80:0xC0], _CLASS[0xC0:] = 7, 6  # 7: the further bytes of a code point


class References:
    """Shares by language of classes and of common words (the last for all other words), the sorted hashes of all common
    words as they are and with a capital, and each hash's number of the word."""

    def __init__(self, chars: dict[str, tuple], words: dict[str, dict[str, float]]):
        names = list(dict.fromkeys(w for own in words.values() for w in own))
        hashes, number = [], []
        for k, w in enumerate(names):
            for form in {w, w[0].upper() + w[1:]}:
                raw = np.frombuffer(form.encode(), np.uint8)
                hashes.append(tb.Hashes(raw).of(np.array([0]), np.array([len(raw)]))[0])
                number.append(k)
        order = np.argsort(np.array(hashes, np.uint64))
        self.hashes, self.number, self.langs = np.array(hashes, np.uint64)[order], np.array(number, np.int64)[order], tuple(chars)
        self.chars, self.words = {lang: np.array(v, float) / sum(v) for lang, v in chars.items()}, {}
        for lang in chars:
            q = np.zeros(len(names) + 1)
            for w, share in words.get(lang, {}).items():
                q[names.index(w)] = share
            q[-1] = 1 - q.sum()
            self.words[lang] = q


@cache
def fixed_references() -> References:
    words = {lang: {w: int(n) / 1000 for w, n in zip(s.split()[::2], s.split()[1::2], strict=True)} for lang, s in COMMON_WORDS.items()}
    return References(CHAR_SHARES, words)


def learned_references(docs: DataFrame, labels: DataFrame, least_docs: int = 50, n_words: int = 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> References:
    """References of the languages that have ``least_docs`` documents labelled good, of their whole texts by grouped aggregation.

    The driver gets seven sums and n_words words a language, MOST_LANGS languages with the most such documents at most. Languages
    without, and null ones, have none.
    """
    from pyspark.sql import functions as F

    lang = F.expr(f"lower(split(replace(`{lang_col}`, '_', '-'), '-')[0])").alias("lang")
    good = docs.join(labels.filter("quality = 1").select(F.col("doc_id").alias(id_col)).distinct(), id_col, "left_semi").select(lang, F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    left = lambda pattern: f"char_length(regexp_replace(text, r'{pattern}', ''))"
    kinds = [left(k) for k in ("[^a-z]", "[^A-Z]", "[^0-9]", r"[^\x20\x09-\x0D]", r"[^.,;:!?\x27\x22()-]")]
    beyond, whole = left(r"[\x00-\x7F]"), "char_length(text)"
    sums = good.groupBy("lang").agg(F.count("*").alias("docs"), *[F.expr(f"sum({k})") for k in (*kinds, f"{whole} - ({' + '.join(kinds)}) - {beyond}", beyond)])
    rows = sums.filter(F.col("docs") >= least_docs).orderBy(F.desc("docs"), "lang").limit(MOST_LANGS).collect()
    chars = {r[0]: tuple(max(float(v), 1e-9) for v in r[2:]) for r in rows if sum(r[2:])}
    said = good.filter(F.col("lang").isin(list(chars))).select("lang", F.explode(F.expr(r"filter(split(text, r'[\x20\x09-\x0D]+'), w -> w != '')")).alias("word"))
    counts = said.groupBy("lang", F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    from pyspark.sql.window import Window

    total = F.sum("n").over(Window.partitionBy("lang"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumns({"share": F.col("n") / total, "place": place}).filter(F.col("place") <= n_words)
    words: dict[str, dict[str, float]] = {}
    for r in top.collect():
        words.setdefault(r["lang"], {})[r["word"]] = r["share"]
    return References(chars, words)


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to the reference shares; 0 for rows without counts."""
    total = counts.sum(1, keepdims=True)
    p = counts / np.maximum(total, 1)
    m = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(reference > 0, reference * np.log2(reference / m), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 0.0)


def missing_distance(n_common: np.ndarray, n_words: np.ndarray, share: float) -> np.ndarray:
    """Jensen-Shannon distance of the shares of common and other words to a reference's; 0 with no fewer than there."""
    both = np.stack([n_common, n_words - n_common], 1)
    return np.where(n_common < share * n_words, js_distance(both, np.array([share, 1 - share])), 0.0)


def measures(data: np.ndarray, offsets: np.ndarray, langs: list, references: References | None = None) -> dict[str, np.ndarray]:
    """All columns of quality() for a run of texts."""
    n, refs = len(offsets) - 1, references or fixed_references()
    starts, ends, row = tb.words(data, offsets)
    hashes = tb.Hashes(data)
    h = hashes.of(starts, ends)
    n_words = np.bincount(row, minlength=n)
    lead = (data & 0xC0) != 0x80
    inside = ~tb.BLANK[data]
    out = {"n_words": n_words, "word_chars": tb.per_text(lead & inside, offsets)}
    out["n_symbols"] = tb.per_text(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)), offsets)

    ls, le, lrow = tb.lines(data, offsets)
    filled = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le, lrow = ls[filled], le[filled], lrow[filled]
    lh = hashes.of(ls, le)
    order = np.lexsort((lh, lrow))
    same = np.zeros(len(order), bool)
    if len(order):
        same[1:] = (lrow[order][1:] == lrow[order][:-1]) & (lh[order][1:] == lh[order][:-1])
    out["n_dup_lines"] = np.bincount(lrow[order][same], minlength=n)

    wh, at = tb.windows(h, row, REPEAT_WIDTH)
    key = tb.mixed(wh + row[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(key)
    k = key[order]
    twin = np.zeros(len(k), bool)
    if len(k):
        twin[1:] = k[1:] == k[:-1]
        twin[:-1] |= twin[1:]
    steps = np.zeros(len(h) + 1, np.int64)
    hit = at[order[twin]]
    steps[hit] += 1
    steps[hit + REPEAT_WIDTH] -= 1
    out["n_repeat_words"] = np.bincount(row[np.cumsum(steps[:-1]) > 0], minlength=n)

    kinds = _CLASS[data]
    classes = np.stack([tb.per_text(kinds == k, offsets) for k in range(7)], 1)
    char_refs, word_refs, known, number = refs.chars, refs.words, refs.hashes, refs.number
    place = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
    is_known = known[place] == h if len(known) else np.zeros(len(h), bool)
    common = np.zeros((n, 1 + (number.max() + 1 if len(number) else 0)), np.int64)
    np.add.at(common, (row[is_known], number[place[is_known]]), 1)
    common[:, -1] = n_words - common.sum(1)
    out["js_chars"], out["js_words"], out["js_missing"] = np.ones(n), np.ones(n), np.ones(n)
    named = np.array([None if x is None else x.lower().replace("_", "-").partition("-")[0] for x in langs], object)
    foreign = classes[:, 6] > MOST_FOREIGN * np.maximum(classes.sum(1) - classes[:, 3], 1)
    out["has_reference"] = np.array([x in refs.langs if x is not None else not f and bool(refs.langs) for x, f in zip(named, foreign, strict=True)], bool)
    for ref in refs.langs:  # without a reference of its own a text is measured by the nearest one
        mine = np.array([x == ref or x not in refs.langs for x in named], bool)
        if mine.any():
            out["js_chars"][mine] = np.minimum(out["js_chars"][mine], js_distance(classes[mine], char_refs[ref]))
            out["js_words"][mine] = np.minimum(out["js_words"][mine], js_distance(common[mine], word_refs[ref]))
        # the nearest reference for all: texts in two languages have few words of their own one
        out["js_missing"] = np.minimum(out["js_missing"], missing_distance(common[:, :-1][:, word_refs[ref][:-1] > 0].sum(1), n_words, 1 - word_refs[ref][-1]))
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * n_words)
    slack = SLACK / np.sqrt(np.maximum(n_words, 1))
    odd_chars = (classes.sum(1) >= GUARD_CHARS) & (out["js_chars"] > MOST_CHARS + slack)
    odd_words = (out["js_words"] > MOST_WORDS + slack) | (out["js_missing"] > MOST_MISSING + MISSING_SLACK / np.sqrt(np.maximum(n_words, 1)))
    out["diverges"] = out["has_reference"] & (odd_chars | ((n_words >= GUARD_WORDS) & odd_words))
    out["kept"] = ~out["base_failed"] & ~out["diverges"]
    return out


COLUMNS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "js_chars": pa.float64(), "js_words": pa.float64(), "js_missing": pa.float64(), "has_reference": pa.bool_(), "base_failed": pa.bool_(), "diverges": pa.bool_(), "kept": pa.bool_(),
}
_SQL = {pa.int64(): "bigint", pa.float64(): "double", pa.bool_(): "boolean"}


def _pass(batches: Iterator[pa.RecordBatch], only_kept: bool, references: References | None = None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        text, lang = batch.column(names.index("__pl_text")), batch.column(names.index("__pl_lang")).to_pylist()
        parts = []
        for a, b, data, offs in tb.text_runs(text):
            parts.append(measures(data, offs, lang[a:b], references))
        found = {k: pa.array(np.concatenate([p[k] for p in parts]) if parts else [], t) for k, t in COLUMNS.items()}
        rest = [k for k, x in enumerate(names) if x not in ("__pl_text", "__pl_lang")]
        if only_kept:
            out = pa.RecordBatch.from_arrays([batch.column(k) for k in rest], [names[k] for k in rest])
            yield out.filter(found["kept"])
        else:
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in rest] + list(found.values()), [names[k] for k in rest] + list(found))


def quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None, references: References | None = None) -> DataFrame:
    """The columns ``carry`` (by default all) of docs with the measures and the verdict ``kept``.

    Words are runs without blanks; a null text is empty and, having under MIN_WORDS words, fails. A language is the part of
    ``lang`` before its region, in any case. One without a reference gets no verdict (has_reference is false, the distances
    are to the nearest reference); a null language, or a table without that column, is held against the nearest one unless
    the text is in another script. ``references`` are the fixed ones unless others are given (learned_references). Texts below the guards pass the divergence tests; texts of any length are used whole.
    Repeated rows are judged alike. Columns of docs named like a measure are replaced. An empty table gives an empty result.
    """
    own = [c for c in (docs.columns if carry is None else carry) if c.lower() not in COLUMNS]
    lang = docs[lang_col].cast("string") if lang_col in docs.columns else None
    from pyspark.sql import functions as F

    given = docs.select(*own, docs[text_col].alias("__pl_text"), (F.lit(None).cast("string") if lang is None else lang).alias("__pl_lang"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields if f.name in own]
    return given.mapInArrow(lambda b: tidied(_pass(b, False, references)), ", ".join(kinds + [f"{k} {_SQL[t]}" for k, t in COLUMNS.items()]))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", references: References | None = None) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; as quality(), null and empty texts go."""
    from pyspark.sql import functions as F

    lang = docs[lang_col].cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    given = docs.withColumns({"__pl_text": docs[text_col], "__pl_lang": lang})
    return given.mapInArrow(lambda b: tidied(_pass(b, True, references)), docs.schema)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "js_chars", "js_words"]
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), carry=["doc_id"]).select(*names)
