"""Document fingerprints by consistent weighted sampling.

A text's terms are its words, weighted by how often they occur. For each of SAMPLES samples a term draws, from hashes of
the term and the sample alone, r and c from Gamma(2, 1) and b from [0, 1); with weight w it takes t = floor(ln w / r + b)
and competes with ln a = ln c - r (t - b + 1). The least wins, and (term, t) is the sample. Two texts agree in a sample
with the probability of their generalised Jaccard similarity, sum(min) / sum(max) of the weights.

Only built-in functions run, all of them compiled: samples are columns, and a sample's candidates are single
numbers (ln a in fixed point above a hash of (term, t)), so that a plain minimum picks the winner. A document's word
counts are formed within the task that has its text; the one shuffle of texts brings neighbours together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NO_ID, table, text_or_empty

#: Samples of a fingerprint, drawn in groups: a row of a term is repeated for each group and has a few columns, which
#: keeps the compiled code small.
SAMPLES, GROUP = 32, 2
#: Fixed point of ln a: values from -OFFSET on, 2**-SHIFT apart, in 31 bits.
OFFSET, SHIFT = 90.0, 24
#: Rows to a range of ids, and the most ranges.
ROWS_PER_RANGE, MOST_RANGES = 500, 16_384
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def neighbours(docs: DataFrame) -> DataFrame:
    """docs (did, text) dealt by ranges of ids: columns range, ghost, did, text.

    Each range also gets, as ghosts, the first rows of the next one (the last range those of the first), so that every
    row's successor in the order of ids is in its own range. Ranges begin at ids that occur; their number follows
    the row count, and finding a row's range is a search in a list of fixed size.
    """
    n = docs.count()
    ranges = max(1, min(MOST_RANGES, n // ROWS_PER_RANGE))
    found = docs.select(F.min("did"), F.percentile_approx("did", [k / ranges for k in range(ranges)], 100 * ranges)).first()
    bounds = sorted({found[0], *(found[1] or [])} - {None}) or [0]
    listed = F.lit(bounds).cast("array<bigint>")
    # the last bound that is not above the id, by halving
    middle = "cast((s.lo + s.hi) div 2 as int)"
    search = (
        f"aggregate(sequence(1, {len(bounds).bit_length()}), named_struct('lo', 0, 'hi', {len(bounds)}), (s, i) -> if(s.hi - s.lo <= 1, s, "
        f"if(element_at(bounds, {middle} + 1) <= did, named_struct('lo', {middle}, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {middle}))), s -> s.lo)"
    )
    placed = docs.withColumn("bounds", listed).withColumn("own", F.expr(search))
    own = "named_struct('range', own, 'ghost', false)"
    ghost = f"named_struct('range', pmod(own - 1, {len(bounds)}), 'ghost', true)"
    homes = F.expr(f"if(element_at(bounds, own + 1) = did, array({own}, {ghost}), array({own}))")
    return placed.select(F.explode(homes).alias("h"), "did", "text").select("h.range", "h.ghost", "did", "text")


def _uniform(bits: str) -> str:
    """(0, 1) from the low 31 bits."""
    return f"((({bits}) & 2147483647L) + 0.5D) * {2.0**-31!r}D"


def _draws(j: int) -> dict[str, str]:
    """r, ln c and b of sample j of a group, for the term's and group's number hg."""
    one, two, three = (f"xxhash64(hg, {3 * j + i})" for i in range(3))
    high = lambda x: f"shiftrightunsigned({x}, 32)"
    return {
        f"r{j}": f"-ln({_uniform(one)} * {_uniform(high(one))})",
        f"c{j}": f"ln(-ln({_uniform(two)} * {_uniform(high(two))}))",
        f"b{j}": _uniform(three),
    }


def _candidate(j: int, log_weight: str) -> str:
    """ln a of sample j in fixed point above 32 bits of (term, t); null for a term that the text lacks."""
    t = f"floor({log_weight} / r{j} + b{j})"
    value = f"cast(greatest(0D, least({2.0**31 - 1}D, (c{j} - r{j} * ({t} - b{j} + 1) + {OFFSET}D) * {2.0**SHIFT}D)) as bigint)"
    return f"if({log_weight} is not null, shiftleft({value}, 32) | (xxhash64(hg, {t}) & 4294967295L), null)"


def _samples(words: DataFrame, *keys: str) -> DataFrame:
    """keys and the sample arrays s0 and s1 for rows (keys, h, w0, w1): a term's hash and its two weights."""
    groups = SAMPLES // GROUP
    words = words.select(*keys, "h", F.expr("ln(w0)").alias("l0"), F.expr("ln(w1)").alias("l1"))  # of 0: null
    rows = words.withColumn("g", F.explode(F.array(*[F.lit(k) for k in range(groups)])))
    rows = rows.withColumn("hg", F.expr("xxhash64(h, g)"))
    rows = rows.withColumns({k: F.expr(e) for j in range(GROUP) for k, e in _draws(j).items()})
    rows = rows.withColumns({f"k{j}": F.expr(_candidate(j, "l0")) for j in range(GROUP)})
    rows = rows.withColumns({f"m{j}": F.expr(f"if(l0 <=> l1, k{j}, {_candidate(j, 'l1')})") for j in range(GROUP)})
    least = rows.groupBy(*keys, "g").agg(*[F.min(f"{v}{j}").alias(f"{v}{j}") for v in "km" for j in range(GROUP)])
    of = lambda v: ", ".join(f"coalesce({v}{j} & 4294967295L, -1L)" for j in range(GROUP))
    listed = least.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("g", F.expr(f"array({of('k')})").alias("k"), F.expr(f"array({of('m')})").alias("m")))).alias("all"))
    return listed.select(*keys, F.expr("flatten(transform(all, x -> x.k))").alias("s0"), F.expr("flatten(transform(all, x -> x.m))").alias("s1"))


def _likeness(one: str, two: str) -> str:
    """The share of equal samples."""
    return f"aggregate(zip_with({one}, {two}, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x) / {float(SAMPLES)}D"


def _hex(samples: str) -> str:
    return f"array_join(transform({samples}, x -> if(x < 0, '', lpad(lower(hex(x)), 8, '0'))), '')"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, samples) of every row: SAMPLES times 8 hexadecimal digits, and the same as numbers.

    Words are runs without blanks, case counts. A null, empty or blank text has no words: its fingerprint is empty, its
    samples are all -1, and it is like other texts without words only. Texts are used whole; repeated rows have equal
    fingerprints. Other columns are not looked at; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    words = rows.select("row", "doc_id", F.explode_outer(F.expr(_words("text"))).alias("word"))
    counts = words.groupBy("row", "doc_id", F.xxhash64("word").alias("h")).agg(F.count("word").alias("w0")).withColumn("w1", F.col("w0"))
    return _samples(counts, "row", "doc_id").select("doc_id", F.expr(_hex("s0")).alias("fingerprint"), F.col("s0").alias("samples"))


def _words(text: str) -> str:
    return f"filter(split({text}, r'{BLANK}+'), x -> x != '')"


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint beside that of its edited text and of the next row, as op2 returns them.

    The edited text has its last n_chars div 4 code points replaced by the first as many, or all, of the next text in the
    order of (id, text hash); the last row's next is the first. A null id comes before all others. A table of one row
    is its own next.
    """
    given = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("did"), text_or_empty(text_col).alias("text"))
    w = Window.partitionBy("range").orderBy("ghost", "did", F.xxhash64("text"))
    rows = neighbours(given).select(
        "range", "ghost", "did", "text", F.row_number().over(w).alias("rid"), F.coalesce(F.lead("text").over(w), F.lit("")).alias("next")
    )
    rows = rows.withColumn("n_chars", F.char_length("text").cast("bigint"))
    rows = rows.withColumn("head", F.expr("substring(text, 1, cast(n_chars - n_chars div 4 as int))")).withColumn("tail", F.expr("substring(next, 1, cast(n_chars div 4 as int))"))
    meta = rows.filter("not ghost").select("range", "rid", "did", "n_chars", F.sha2(F.concat("head", "tail").cast("binary"), 256).alias("edited_sha256"))
    # words of both texts are told apart from those of one: the head up to its last blank is in both
    both = rows.withColumn("both", F.expr(f"regexp_replace(head, r'(?<!{WORD}){WORD}++\\z', '')"))
    rest = "cast(char_length(both) + 1 as int)"
    parts = both.select("range", "rid", F.expr(
        f"explode(array(named_struct('v', 3, 't', both), named_struct('v', 1, 't', substring(text, {rest})), "
        f"named_struct('v', 2, 't', concat(substring(head, {rest}), tail))))").alias("p"))
    words = parts.select("range", "rid", F.col("p.v").alias("v"), F.explode_outer(F.split("p.t", BLANK + "+")).alias("word"))
    words = words.select("range", "rid", F.expr("if(word = '', null, xxhash64(word))").alias("h"), F.expr("v & 1").alias("v0"), F.expr("v div 2").alias("v1"))
    counts = words.groupBy("range", "rid", "h").agg(F.sum("v0").alias("w0"), F.sum("v1").alias("w1"))
    counts = counts.select("range", "rid", "h", *[F.when(F.col("h").isNotNull(), F.col(c)).otherwise(0).alias(c) for c in ("w0", "w1")])
    found = _samples(counts, "range", "rid")
    found = found.withColumn("s2", F.lead("s0").over(Window.partitionBy("range").orderBy("rid")))
    out = meta.join(found, ["range", "rid"])
    return out.select(
        F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), "n_chars", "edited_sha256",
        F.expr(_hex("s0")).alias("fingerprint"), F.expr(_hex("s1")).alias("edited_fingerprint"),
        F.expr(_likeness("s0", "s1")).alias("near_edited"), F.expr(_likeness("s0", "s2")).alias("near_next"),
    )


def op2_weighted_sampling(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    return edited_pairs(table(spark, sf_dir, "documents"))
