"""Line dedup over the whole corpus with levelled sorted runs of line hashes.

Lines are reduced once to (document, position, 128-bit key hash) rows. Batches of documents, from the largest ids
down, are aggregated into sorted runs and added to a store of levels: each batch is merge-anti-joined with the
runs there, so a key enters with its holder only in the batch that shows it first (the largest document that has
it), later batches add to its count, and ``fanout`` runs of a level are compacted into one of the next. Keys in
enough documents then lose their lines everywhere but in the holder.

Only built-in functions are used. Text is shuffled once, to meet the positions it loses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, fresh_path, table, text_or_empty, written

#: White space taken off both ends of a line, and the letters that are lowered; fixed values.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key's rows are dealt to this many parts when they meet the keys to drop.
SALTS = 16


class LineRuns:
    """Levelled runs of (h1, h2, n_docs, holder), each sorted by key and kept as a table in the shared folder.

    ``holder`` is set in the one run that showed the key first. ``add`` wants batches without common documents,
    in the order in which holders take precedence.
    """

    def __init__(self, spark, fanout: int = 4):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]

    def _write(self, df: DataFrame, level: int) -> None:
        path = fresh_path(self.spark, f"run{level}")
        df.sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self.spark.read.schema(df.schema).parquet(path))

    def rows(self) -> DataFrame | None:
        """All runs' rows; a key may have several."""
        runs = [r for level in self.levels for r in level]
        out = None
        for r in runs:
            out = r if out is None else out.unionByName(r)
        return out

    def merged(self) -> DataFrame | None:
        """One row for each key."""
        rows = self.rows()
        return rows if rows is None else _merge(rows)

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2, did). Its keys not in the runs enter with a holder, the others with a count only."""
        new = batch.groupBy("h1", "h2").agg(F.countDistinct("did").alias("n_docs"), F.max("did").alias("holder"))
        there = self.rows()
        if there is not None:
            known = there.filter("holder is not null").select("h1", "h2", F.lit(True).alias("known"))
            new = new.join(known.hint("merge"), ["h1", "h2"], "left").select(
                "h1", "h2", "n_docs", F.when(F.col("known").isNull(), F.col("holder")).alias("holder")
            )
        self._write(new, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            out = runs[0]
            for r in runs[1:]:
                out = out.unionByName(r)
            self._write(_merge(out), level + 1)
            level += 1


def _merge(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"))


def _key(line):
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(did, th, pos, h1, h2) of each line whose key has min_chars code points; the key's hash has 128 bits."""
    lines = docs.select("did", "th", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("pos", "line"))
    keyed = lines.filter(F.char_length("line") >= min_chars).select("did", "th", "pos", _key(F.col("line")).alias("key"))
    return keyed.filter(F.char_length("key") >= min_chars).select(
        "did", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2")
    )


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ``text`` cut down to its kept lines, plus n_lines and n_dropped.

    A line's key is the line without the blanks at its ends, A-Z lowered. Keys of at least ``min_chars`` code
    points found in at least ``min_docs`` documents (distinct ids) lose all their lines except in the largest id
    that has them; within that document every one of them stays. Null or empty texts are one empty line; a text
    without lines to drop stays as it is (a null text becomes empty). Rows without an id count as one document
    below all others. Repeated rows are cut alike. All other columns stay; ``n_lines`` and ``n_dropped`` of the
    input are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = docs.drop("n_lines", "n_dropped")
    base = own.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("did"), text_or_empty(text_col).alias("text"))
    narrow = base.select("did", F.xxhash64("text").alias("th"), "text")
    bounds = own.select(F.percentile_approx(id_col, [k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    batch = F.lit(0)
    for b in bounds or []:
        batch = batch + F.when(F.col("did") <= b, 1).otherwise(0)  # the largest ids are batch 0
    rows = written(line_rows(narrow, min_chars).withColumn("batch", batch), "lines", "batch")
    runs = LineRuns(spark, fanout)
    for k in range(batches):
        runs.add(rows.filter(F.col("batch") == k))
    doomed = runs.merged().filter(F.col("n_docs") >= min_docs)
    doomed = doomed.select("h1", "h2", "holder", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    lost = (
        rows.withColumn("salt", F.pmod(F.xxhash64("did", "pos"), F.lit(SALTS)).cast("int"))
        .join(doomed, ["h1", "h2", "salt"])
        .filter("did != holder")
        .groupBy("did", "th")
        .agg(F.collect_set("pos").alias("__pl_lost"))
    )
    keyed = own.withColumns({"__pl_did": F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)), "__pl_th": F.xxhash64(text_or_empty(text_col))})
    lost = lost.select(F.col("did").alias("__pl_did"), F.col("th").alias("__pl_th"), "__pl_lost")
    lines = F.split(text_or_empty(text_col), "\n", -1)
    joined = keyed.join(lost, ["__pl_did", "__pl_th"], "left").withColumn("__pl_lines", lines)
    return joined.withColumns(
        {
            text_col: F.when(F.col("__pl_lost").isNull(), text_or_empty(text_col)).otherwise(
                F.expr("array_join(transform(array_except(sequence(0, size(__pl_lines) - 1), __pl_lost), i -> __pl_lines[i]), '\n')")
            ),
            "n_lines": F.size("__pl_lines").cast("bigint"),
            "n_dropped": F.coalesce(F.size("__pl_lost"), F.lit(0)).cast("bigint"),
        }
    ).select(*[c for c in own.columns], "n_lines", "n_dropped")


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of every document after line dedup."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
with lines as (
  select doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents)
), doomed as (
  select key, max(doc_id) as holder from lines where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), marked as (
  select l.doc_id, l.pos, l.line, (d.key is not null and l.doc_id != d.holder) as gone
  from lines l left join doomed d on l.key = d.key
)
select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""
