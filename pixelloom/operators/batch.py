"""A plan over a folder of pictures: scan, name outputs, skip what is there, run, write, and log every file."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scratch import written

#: File name endings and JPEG qualities of the export profiles; fixed values.
EXTENSIONS = {"web": "jpg", "print": "jpg", "high_jpeg": "jpg", "maximum_compression": "webp", "archive": "png", "lossless": "png"}
JPEG_QUALITY = {"web": 82, "print": 95, "high_jpeg": 95}
MOST_NAME = 180


def jpeg_quality(profile: str) -> int:
    return JPEG_QUALITY.get(profile, 90)


def output_name(name: str, index: str, template: str, extension: str, workflow: str) -> str:
    """SQL for the file name a template gives: {name} {index} {ext} {workflow}; odd characters become underscores.

    name is the input's file name and index its number from 0.
    """
    stem = f"regexp_replace({name}, '[.][^.]*$', '')"
    quoted = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    filled = f"replace(replace(replace(replace({quoted(template)}, '{{name}}', {stem}), '{{index}}', lpad(cast({index} + 1 as string), greatest(4, length(cast({index} + 1 as string))), '0')), '{{ext}}', {quoted(extension)}), '{{workflow}}', {quoted(workflow)})"
    clean = f"regexp_replace({filled}, '[^\\\\p{{L}}\\\\p{{N}} ._-]', '_')"
    return f"left(trim(BOTH ' .' FROM {clean}), {MOST_NAME})"


def planned(files: DataFrame, existing: DataFrame, template: str, profile: str, workflow: str) -> DataFrame:
    """(idx, path, target, status) of files (path): numbered by lower-cased path; run, skipped, or failed for no name.

    A target that exists, or that a file before claims, is skipped. existing: (target). All files are numbered, however
    many: those of each range of names by themselves, from the count of files in the ranges before. The ranges are
    written first, as another run might draw them elsewhere.
    """
    ext = EXTENSIONS[profile]
    dealt = files.select("path").distinct().repartitionByRange(F.lower("path"), "path").withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "files")
    before, total = {}, 0
    for k, n in sorted(tuple(r) for r in dealt.groupBy("_range").count().collect()):
        before[k], total = total, total + n
    start = F.lit([before.get(k, 0) for k in range(max(before, default=0) + 1)])[F.col("_range")]
    order = Window.partitionBy("_range").orderBy(F.lower("path"), "path")
    q = dealt.withColumn("idx", (start + F.row_number().over(order) - 1).cast("int")).drop("_range")
    q = q.withColumn("_base", F.expr(output_name("element_at(split(path, '/'), -1)", "idx", template, ext, workflow)))
    q = q.withColumn("target", F.expr(f"case when _base = '' then null else concat(regexp_replace(_base, '[.][^.]*$', ''), '.{ext}') end")).drop("_base")
    q = q.join(existing.select("target").distinct().withColumn("_there", F.lit(True)), "target", "left")
    claim = F.row_number().over(Window.partitionBy("target").orderBy("idx"))
    q = q.withColumn("_claim", claim)
    status = F.when(F.col("target").isNull(), "failed").when(F.col("_there").isNotNull() | (F.col("_claim") > 1), "skipped").otherwise("run")
    return q.select("idx", "path", "target", status.alias("status"))


#: Sizes of pictures that a plan without packed forms is compiled for, one by one; more are an error.
MOST_SIZES = 1000


def run_folder(
    spark: SparkSession, source: str, plan, template: str = "{name}", profile: str = "lossless", workflow: str = "", existing: DataFrame | None = None, overwrite: bool = False, dry_run: bool = False
) -> DataFrame:
    """(idx, path, target, status, error, file): each file's picture after the plan, encoded as the profile says.

    A file that does not decode is failed and stops no other. Plans whose operations all have packed forms run over pictures of
    any sizes in one pass; others are compiled for each size, of which there may be MOST_SIZES. With ``overwrite`` targets that
    exist are written again (one that a file before claims is still skipped); a dry run decodes nothing and leaves the status at run.
    """
    from ..plans.compiler import apply_plan
    from ..sources import rasters
    from . import packed

    files = rasters.file_metadata(spark, source).select("path")
    known = existing if existing is not None and not overwrite else spark.createDataFrame([], "target string")
    todo = planned(files, known, template, profile, workflow)
    _encoded = lambda done: rasters.with_file(done, profile)
    nothing = F.lit(None).cast("binary").alias("file")
    error = lambda s: F.when(s == "failed", F.when(F.col("target").isNull(), "no output name").otherwise("cannot decode")).alias("error")
    if dry_run:
        return todo.select("idx", "path", "target", "status", error(F.col("status")), nothing)
    # the two readers spell a local path differently
    same = F.xxhash64(F.regexp_replace("path", "^file:/+", "/"))
    decoded = rasters.read_images(spark, source).withColumn("image_id", same)
    out, log = None, todo.withColumn("image_id", same)
    wanted = decoded.join(log.filter("status = 'run'").select("image_id"), "image_id", "left_semi")
    if all(packed.has_kernel(o) for o in plan.ops):
        out = _encoded(packed.apply_packed(wanted.select("image_id", "width", "height", "data"), *plan.ops))
    else:
        sizes = [tuple(r) for r in wanted.select("width", "height").distinct().limit(MOST_SIZES + 1).collect()]
        if len(sizes) > MOST_SIZES:
            raise ValueError(f"pictures of more than {MOST_SIZES} sizes need a plan of packed forms")
        for w, h in sizes:
            p = rasters.unpack(wanted.filter((F.col("width") == w) & (F.col("height") == h)))
            done = _encoded(rasters.pack(apply_plan(p, plan, w, h)))
            out = done if out is None else out.unionByName(done)
    if out is None:
        status = F.when(F.col("status") == "run", "failed").otherwise(F.col("status"))
        return log.select("idx", "path", "target", status.alias("status"), error(status), nothing)
    q = log.join(out.select("image_id", "file"), "image_id", "left")
    status = F.when((F.col("status") == "run") & F.col("file").isNull(), "failed").when(F.col("status") == "run", "ok").otherwise(F.col("status"))
    return q.select("idx", "path", "target", status.alias("status"), error(status), F.when(status == "ok", F.col("file")).alias("file"))


def counters(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count("*").alias("n"))


WORKFLOW_FIELDS = "id string, name string, description string, folder string, favorite boolean, operations string, createdAt string, updatedAt string"


def read_workflows(lines: DataFrame) -> DataFrame:
    """Workflows of JSON documents (value): fields with defaults, and ``error`` for what is wrong with one.

    Unknown fields are let through; operations must be valid ones.
    """
    from ..plans.ops import InvalidOperation, plan_from_json

    def run(batches: Iterator):
        import pandas as pd

        for b in batches:
            rows = []
            for v in b["value"]:
                try:
                    d = json.loads(v)
                    if d.get("schemaVersion", 1) != 1:
                        raise InvalidOperation("unknown schema version")
                    if not str(d.get("id", "")).strip() or not str(d.get("name", "")).strip():
                        raise InvalidOperation("a workflow needs an id and a name")
                    p = plan_from_json(json.dumps(d.get("operations", [])))
                    rows.append((d["id"], d["name"], d.get("description", ""), d.get("folder", ""), bool(d.get("favorite", False)), p.to_json(), d.get("createdAt"), d.get("updatedAt"), None))
                except (ValueError, AttributeError, TypeError) as e:
                    rows.append((*[None] * 8, str(e)[:200]))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in (WORKFLOW_FIELDS + ", error string").split(", ")])

    return lines.select("value").mapInPandas(run, WORKFLOW_FIELDS + ", error string")


def search(workflows: DataFrame, query: str) -> DataFrame:
    """Those with the query in name, description or folder, whatever the case; favourites first, then folder and name."""
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(query.strip().lower()))
    return workflows.filter(has("name") | has("description") | has("folder")).orderBy(F.desc("favorite"), "folder", "name")
