"""Source trees: listing, ignore rules, labels, decoding."""

from __future__ import annotations

import os
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import base, suffix
from ..model import EXTENSIONS, LARGEST, NAMED, SKIPPED_DIRS

LISTING = "path string, kind string, size bigint, mtime double"


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """Everything under root, which the driver must reach, with POSIX paths relative to it; links are not followed."""
    rows, todo = [], [""]
    while todo:
        at = todo.pop()
        with os.scandir(os.path.join(root, at)) as entries:
            for e in entries:
                path = f"{at}/{e.name}" if at else e.name
                if e.is_symlink():
                    rows.append((path, "symlink", 0, 0.0))
                elif e.is_dir(follow_symlinks=False):
                    todo.append(path)
                elif e.is_file(follow_symlinks=False):
                    s = e.stat(follow_symlinks=False)
                    rows.append((path, "file", s.st_size, s.st_mtime))
    return spark.createDataFrame(rows, LISTING)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """The same for any file system that Spark reads, in parallel and with content; links cannot be told there. Filters on
    size and mtime are applied before a file's content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = root.split("://")[-1].strip("/") + "/"
    rel = F.expr("path").substr(F.locate(below, F.col("path")) + F.lit(len(below)), F.length("path"))
    return files.select(rel.alias("path"), F.lit("file").alias("kind"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), "content")


def load_ignore(spark: SparkSession, root: str, name: str = ".graphignore") -> list[str]:
    """Lines of the ignore file that are neither blank nor comments; none without the file."""
    at = os.path.join(root, name)
    if not os.path.exists(at):
        return []
    # not by spark.read, which passes over files whose names begin with a dot
    with open(at, encoding="utf-8", errors="replace") as f:
        return [p for p in map(str.strip, f) if p and not p.startswith("#")]


def is_ignored(path: str, patterns: list[str]) -> bool:
    """S3: a glob that fits from the right, or, for patterns that end with a slash, a plain prefix."""
    at = PurePosixPath(path)
    return any(at.match(p) or (p[-1:] == "/" and path.startswith(p.rstrip("/"))) for p in patterns)


def load_subprojects(path: str) -> dict[str, str]:
    """Names and paths from a YAML file, in order; none without the file. YAML needs its library, JSON is always read."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        doc = yaml.safe_load(text)
    except ImportError:
        import json

        doc = json.loads(text)
    return {k: v["path"] for k, v in ((doc or {}).get("subprojects") or {}).items()}


def language(path: str = "path") -> Column:
    """By name, then by extension, else other."""
    p = F.col(path)
    names = F.coalesce(*[F.when(base(p) == k, F.lit(v)) for k, v in NAMED.items()])
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(names, F.try_element_at(table, suffix(p)), F.lit("other"))


def classify(listing: DataFrame, subprojects: dict[str, str] | None = None, ignore: list[str] | None = None, largest: int = LARGEST) -> DataFrame:
    """The listing with language, subproject and why a row is skipped (null: it is a source file)."""
    parts = F.split("path", "/")
    hit = F.arrays_overlap(parts, F.array(*map(F.lit, sorted(SKIPPED_DIRS))))
    lang = language()
    why = F.when(F.col("kind") != "file", "not_a_file").when(hit, "skipped_dir").when(lang == "other", "unknown").when(F.col("size") > largest, "too_large")
    if ignore:
        patterns = list(ignore)
        ignored = F.pandas_udf(lambda s: s.map(lambda x: is_ignored(x, patterns)), "boolean")
        why = why.when(ignored(F.col("path")), "ignored")
    label = F.lit("")
    for name, at in reversed(list((subprojects or {}).items())):
        at = PurePosixPath(at).as_posix()
        inside = F.lit(True) if at in ("", ".") else F.col("path").startswith(at.rstrip("/") + "/")
        label = F.when(inside, F.lit(name)).otherwise(label)
    return listing.withColumn("language", lang).withColumn("subproject", label).withColumn("skipped", why)


def source_files(classified: DataFrame) -> DataFrame:
    """The files to be indexed, with file_seq: their order by path components."""
    keep = classified.filter("skipped is null").drop("skipped", "kind")
    order = keep.select("path").orderBy(F.split("path", "/")).rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])).toDF("path string, file_seq bigint")
    return keep.join(order, "path")


def skip_stats(classified: DataFrame) -> DataFrame:
    """(skipped, files): how many files each rule left out, and the skipped directories met."""
    dirs = F.array_intersect(F.split("path", "/"), F.array(*map(F.lit, sorted(SKIPPED_DIRS))))
    return classified.filter("skipped is not null").groupBy("skipped").agg(F.count("*").alias("files"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(dirs)))).alias("dirs"))


def languages(classified: DataFrame) -> DataFrame:
    """Source files by language, most first."""
    return classified.filter("skipped is null").groupBy("language").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "language")


def with_content(files: DataFrame, root: str) -> DataFrame:
    """Text of each file, decoded with replacement; null and readable false where it cannot be read. Each task reads its
    own files, so root must be reachable from all of them."""

    def read(frames):
        for f in frames:
            out = []
            for p in f["path"]:
                try:
                    with open(os.path.join(root, p), "rb") as h:
                        out.append(h.read().decode("utf-8", "replace"))
                except OSError:
                    out.append(None)
            yield f.assign(content=out)

    schema = ", ".join(f"`{n}` {t}" for n, t in files.dtypes) + ", content string"
    return files.mapInPandas(read, schema).withColumn("readable", F.col("content").isNotNull())
