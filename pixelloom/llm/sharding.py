"""Reproducible shuffle and sharding: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered from 0 to N-1 by content alone (hash bucket of id, size and checksum, then these), so the
numbering does not depend on files, partitions or executors. A mixed-radix Feistel network over [0, a*b), where
a*b is the smallest near-square product >= N, permutes the numbers; a value beyond N-1 is sent through the
network again until it lands inside (cycle walking). Position p goes to shard ``p % shards`` and slot
``p // shards``: counts are at most one apart and slots have no gaps, and both can be computed for any
row number without looking at other rows.

Only built-in functions run on the rows. The single shuffle carries (id, size, checksum), never the text.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Odd constants that tell the rounds apart; their number must be even.
ROUND_KEYS = (0x51ED270B, 0x2545F491, 0x6C62272E, 0x1B873593, 0x7FEB352D, 0x5BD1E995)
#: A walk that leaves [0, N) so often in a row is reported as an error; with a*b - N < a it has a chance
#: below N**-16 for large N and cannot happen for N <= 256.
MOST_STEPS = 33
#: Rows to a numbering bucket, and the most buckets; the driver sees one count per bucket.
ROWS_PER_BUCKET, MOST_BUCKETS = 50_000, 16_384


def radices(n: int) -> tuple[int, int]:
    """a, b with a*b >= n and a*b - n < a: the domain of the network for n rows."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _network(p: str, a: int, b: int, seed: int) -> str:
    keys = ", ".join(f"{k ^ seed}L" for k in ROUND_KEYS)
    return (
        f"aggregate(array({keys}), named_struct('x', ({p}) div {b}L, 'y', ({p}) % {b}L, 'm', {a}L, 'o', {b}L), "
        "(s, k) -> named_struct('x', s.y, 'y', (s.x + pmod(xxhash64(s.y, k), s.m)) % s.m, 'm', s.o, 'o', s.m), "
        f"s -> s.x * {b}L + s.y)"
    )


def permuted(number: str, n: int, seed: int = 0) -> str:
    """SQL for the place of row ``number`` (a column name) among n rows."""
    a, b = radices(n)
    walk = _network("w", a, b, seed)
    inside = (
        f"aggregate(sequence(1, {MOST_STEPS}), {_network(number, a, b, seed)}, "
        f"(w, i) -> if(w < {n}L, w, {walk}))"
    )
    return f"transform(array({inside}), w -> if(w < {n}L, w, cast(raise_error('cycle walk too long') as bigint)))[0]"


def row_numbers(df: DataFrame, id_col: str, *ties: str) -> tuple[DataFrame, int]:
    """df with ``row_number`` 0..N-1, and N.

    The number follows from content: bucket of the hash of id and ``ties``, then id (nulls first), then ``ties``; so rows
    that share an id, or have none, are many buckets' work. Fully equal rows take consecutive numbers. The driver gathers one count per bucket, at most MOST_BUCKETS of them.
    """
    n = df.count()
    buckets = 1 << max(4, min(MOST_BUCKETS, -(-n // ROWS_PER_BUCKET)).bit_length())
    keyed = df.withColumn("_bucket", F.pmod(F.xxhash64(id_col, *ties), F.lit(buckets)).cast("int"))
    counts = dict(keyed.groupBy("_bucket").count().collect())
    starts, at = [], 0
    for k in range(buckets):
        starts.append(at)
        at += counts.get(k, 0)
    w = Window.partitionBy("_bucket").orderBy(F.col(id_col).asc_nulls_first(), *[F.col(t).asc_nulls_first() for t in ties])
    first = F.element_at(F.lit(starts).cast("array<bigint>"), F.col("_bucket") + 1)
    return keyed.withColumn("row_number", first + F.row_number().over(w) - 1).drop("_bucket"), n


def feistel_shards(docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, position, shard, slot of every row.

    size is the UTF-8 length plus 1 and text_crc32 the unsigned CRC-32; a null text counts as empty, a null id
    is a value like any other and comes first. Repeated rows each get a place of their own. An empty table
    gives an empty result. Other columns of docs, whatever their names, are not looked at.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    numbered, n = row_numbers(narrow, "doc_id", "size", "text_crc32")
    return (
        numbered.withColumn("position", F.expr(permuted("row_number", max(n, 1), seed)))
        .withColumn("shard", (F.col("position") % shards).cast("int"))
        .withColumn("slot", F.expr(f"position div {shards}"))
    )


def op6_feistel_shards(spark, sf_dir: str) -> DataFrame:
    """The contract's digest: all documents into shards 0 to 7 under the law of rows."""
    from .common import table

    return feistel_shards(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )
