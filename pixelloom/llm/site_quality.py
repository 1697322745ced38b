"""Quality classifier with hierarchical empirical Bayes over documents, hosts and paths.

A document's own evidence is a logistic model over length-free statistics of its text, fitted on a bounded sample of the
labelled rows. Sites add theirs: labels are counted by host and by path (grouped aggregation), each level's rate is
shrunk towards the level above with a Beta prior, global -> host -> path, whose strength is estimated from the spread of
the groups (method of moments), so a site with few labels stays near its parent. The posterior log-odds of the path,
relative to the global rate, are added to the document's.

Group tables are joined by host and path after salting the documents, so that a host with a third of all rows is no
single task's; labels are counted with partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import table, tidied
from .quality import measures

#: The most labelled rows that the document model is fitted on; they are those with the least hash of the id.
FIT_ROWS = 8_000
#: Bounds of the prior strength, in labelled documents, and how much of a site's log-odds counts.
LEAST_PRIOR, MOST_PRIOR, SITE_WEIGHT = 2.0, 200.0, 0.5
#: Documents at or above this probability of good quality are kept.
KEEP_FROM = 0.25
SALTS = 16
FEATURES = ("js_chars", "js_words", "repeated", "duplicate_lines", "symbols", "word_length", "log_words", "tiny", "distinct")


def features(data: np.ndarray, offsets: np.ndarray, langs: list) -> np.ndarray:
    """FEATURES of each of a run of texts."""
    m = measures(data, offsets, langs)
    n = np.maximum(m["n_words"], 1)
    starts, ends, row = tb.words(data, offsets)
    h = tb.mixed(tb.Hashes(data).of(starts, ends) + row.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    _, first = np.unique(h, return_index=True)
    distinct = np.bincount(row[first], minlength=len(n))
    lines = tb.per_text(data == 10, offsets) + 1
    return np.stack(
        [
            m["js_chars"], m["js_words"], m["n_repeat_words"] / n, m["n_dup_lines"] / lines, m["n_symbols"] / np.maximum(m["word_chars"], 1),
            np.minimum(m["word_chars"] / n, 30) / 10, np.log1p(m["n_words"]) / 10, (m["n_words"] < 20).astype(float), distinct / n,
        ], 1,
    )


def _scored(given: DataFrame, names: list[str], ddl: str, score) -> DataFrame:
    """given (names.., __pl_text, __pl_lang) with what score(matrix) makes of each text's features."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            k = batch.num_columns - 2
            langs, parts = batch.column(k + 1).to_pylist(), []
            for a, b, data, offs in tb.text_runs(batch.column(k)):
                parts.append(features(data, offs, langs[a:b]))
            x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], score(x)], [*batch.schema.names[:k], "value"])

    return given.mapInArrow(lambda b: tidied(run(b)), ddl)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; scale of x is taken care of by the caller."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * np.r_[0, w[1:]]
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.diag(np.r_[1e-9, np.ones(len(w) - 1)])
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-9:
            break
    return w


def prior_strength(good: float, n: float, sum_sq: float, groups: float) -> float:
    """Strength of a Beta prior from groups' label counts: total good, total n, sum of n (rate - mean)**2, and their number.

    The between-group variance left after the binomial one gives rate (1 - rate) / variance - 1, kept within bounds.
    """
    if groups < 2 or n <= 0:
        return MOST_PRIOR
    rate = good / n
    spread = rate * (1 - rate)
    if spread <= 0:
        return MOST_PRIOR
    between = (sum_sq - spread * (groups - 1)) / max(n - n / groups, 1e-9)
    return float(np.clip(spread / between - 1, LEAST_PRIOR, MOST_PRIOR)) if between > 0 else MOST_PRIOR


def _level(labelled: DataFrame, keys: list[str], parent: str) -> tuple[DataFrame, float]:
    """Label counts by keys, with the parent's rate, and the prior strength of the level."""
    groups = labelled.groupBy(*keys).agg(F.sum("good").alias("good"), F.count("*").cast("double").alias("n"), F.first(parent).alias("parent"))
    s = groups.agg(F.sum("good"), F.sum("n"), F.sum(F.expr("n * pow(good / n - parent, 2)")), F.count("*")).first()
    return groups, prior_strength(*[float(v or 0) for v in s])


def site_quality(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, host, path, doc_score, host_rate, path_rate, quality, kept) of every row of docs.

    labels (doc_id, quality) has 1 for good and 0 for bad; rows with other values or without a document are left
    out, and of several labels of an id the mean counts. Null hosts and paths are groups of their own; groups without
    labels have their parent's rate. A null text is empty. Without both kinds of labels doc_score is the
    global rate. Repeated rows are scored alike; of rows that share a labelled id the one with the least text is fitted on.
    Texts of any length are used whole; other columns are not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    lang = docs[lang_col].cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    base = docs.select(
        docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[host_col].cast("string"), F.lit("")).alias("host"), F.coalesce(docs[path_col].cast("string"), F.lit("")).alias("path"),
        docs[text_col].alias("__pl_text"), lang.alias("__pl_lang"),
    )
    good = labels.filter("quality in (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg("quality").alias("good"))
    known = base.select("doc_id", "host", "path").join(good, "doc_id")

    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    sample = base.join(F.broadcast(chosen), "doc_id")  # at most FIT_ROWS ids
    # of rows that share an id the least text is fitted on, so there are no more rows than ids
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("__pl_text", "__pl_lang", "good")).alias("x")).select("x.good", "x.__pl_text", "x.__pl_lang")
    rows = _scored(sample, ["good"], "good double, value array<double>", lambda x: pa.array(list(x), pa.list_(pa.float64()))).collect()
    y, x = np.array([r.good for r in rows]), np.array([r.value for r in rows]).reshape(len(rows), len(FEATURES))
    total = known.agg(F.avg("good"), F.count("*")).first()
    rate = float(total[0]) if total[1] else 0.5
    rate = min(max(rate, 1e-3), 1 - 1e-3)
    logit = lambda p: np.log(p / (1 - p))
    if len(y) and 0 < y.mean() < 1:
        mean, scale = x.mean(0), x.std(0) + 1e-6
        w = fit_logistic((x - mean) / scale, y)
    else:
        mean, scale, w = np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.r_[logit(rate), np.zeros(len(FEATURES))]

    hosts, host_prior = _level(known.withColumn("above", F.lit(rate)), ["host"], "above")
    hosts = hosts.select("host", ((F.col("good") + rate * host_prior) / (F.col("n") + host_prior)).alias("host_rate"))
    salted = known.withColumn("salt", _salt()).join(_spread(hosts), ["host", "salt"])
    paths, path_prior = _level(salted, ["host", "path"], "host_rate")
    paths = paths.select("host", "path", ((F.col("good") + F.col("parent") * path_prior) / (F.col("n") + path_prior)).alias("path_rate"))

    z = _scored(base, ["doc_id", "host", "path"], "doc_id bigint, host string, path string, value double", lambda x: pa.array(w[0] + ((x - mean) / scale) @ w[1:], pa.float64()))
    out = z.withColumn("salt", _salt()).join(_spread(hosts), ["host", "salt"], "left").join(_spread(paths), ["host", "path", "salt"], "left")
    out = out.withColumn("host_rate", F.coalesce("host_rate", F.lit(rate))).withColumn("path_rate", F.coalesce("path_rate", "host_rate"))
    sum_ = f"value + {SITE_WEIGHT} * (ln(path_rate / (1 - path_rate)) - {float(logit(rate))!r})"
    out = out.withColumn("quality", F.expr(f"1 / (1 + exp(-greatest(-30D, least(30D, {sum_}))))"))
    return out.select("doc_id", "host", "path", F.expr("1 / (1 + exp(-greatest(-30D, least(30D, value))))").alias("doc_score"), "host_rate", "path_rate", "quality", (F.col("quality") >= KEEP_FROM).alias("kept"))


def _salt():
    return F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")


def _spread(groups: DataFrame) -> DataFrame:
    return groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def op7_site_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's scores and verdict; hosts are the sources, paths the languages within them."""
    return site_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
