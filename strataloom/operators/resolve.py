"""Resolution of references to files: first match of candidates, unique stems and basenames, test targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions import scalars as S


def candidates(base: Column, extensions: Sequence[str]) -> Column:
    """Paths to try for a normalised reference, in order."""
    more = F.when(S.suffix(base) == "", F.array(*[F.concat(base, F.lit(e)) for e in extensions], *[F.concat(base, F.lit("/index" + e)) for e in extensions], F.concat(base, F.lit("/__init__.py"))))
    return F.array_distinct(F.concat(F.array(base), F.coalesce(more, F.array().cast("array<string>"))))


def relative_base(source: Column, reference: Column) -> Column:
    """Normalised path of a reference in a file; null for URLs, empty references and paths that leave the root."""
    r = F.regexp_replace(F.trim(reference), r"[#?].*$", "")
    local = (r != "") & ~F.startswith(r, F.lit(fixed.FOREIGN_SCHEMES[0]))
    for scheme in fixed.FOREIGN_SCHEMES[1:]:
        local = local & ~F.startswith(r, F.lit(scheme))
    return F.when(local, S.normalize_path(F.when(F.startswith(r, F.lit("/")), r).otherwise(F.concat_ws("/", S.parent(source), r))))


def first_match(references: DataFrame, paths: DataFrame, extensions: Sequence[str]) -> DataFrame:
    """references(source, reference) with target: the first candidate that is a path, else null."""
    tried = references.withColumn("_base", relative_base(F.col("source"), F.col("reference")))
    flat = tried.select("source", "reference", F.posexplode(candidates(F.col("_base"), extensions)).alias("_at", "path"))
    found = flat.join(paths.select("path"), "path").groupBy("source", "reference").agg(F.min_by("path", "_at").alias("target"))
    return references.join(found, ["source", "reference"], "left")


def unique_by(paths: DataFrame, key: Column) -> DataFrame:
    """(key, path) of keys that exactly one path has."""
    return paths.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).filter("n = 1").select("key", "path")


def by_unique_stem(names: DataFrame, paths: DataFrame) -> DataFrame:
    """names(source, name) with the only path whose stem is the last part of the dotted name."""
    index = unique_by(paths, F.lower(S.stem(F.col("path"))))
    return names.withColumn("key", F.lower(F.regexp_replace(F.col("name"), r"^.*(\.|::|/)", ""))).join(index.withColumnRenamed("path", "target"), "key", "left").drop("key")


def python_modules(modules: DataFrame, paths: DataFrame) -> DataFrame:
    """modules(source, module, level) with each path that a prefix resolves it to: every prefix gives its first candidate."""
    up = F.expr("array_join(slice(split(source, '/'), 1, greatest(size(split(source, '/')) - 1 - greatest(level - 1, 0), 0)), '/')")
    prefixes = F.when(F.col("level") > 0, F.array(up)).otherwise(F.array(F.lit(""), F.lit("src"), F.lit("lib"), F.lit("app")))
    flat = modules.withColumn("_prefix", F.explode(prefixes)).withColumn("_base", S.normalize_path(F.concat_ws("/", "_prefix", F.replace(F.col("module"), F.lit("."), F.lit("/")))))
    tried = flat.select("source", "module", "level", "_prefix", F.posexplode(candidates(F.col("_base"), [".py"])).alias("_at", "path"))
    return tried.join(paths.select("path"), "path").groupBy("source", "module", "level", "_prefix").agg(F.min_by("path", "_at").alias("target")).select("source", "module", "level", "target").distinct()


def tested_names(path: Column) -> Column:
    """Names of the files that a test file may be about; none for other files."""
    name = S.basename(path)
    return F.filter(
        F.array(F.when(F.startswith(name, F.lit("test_")) & (S.suffix(path) == ".py"), F.substring(name, 6, 1000)), F.when(F.contains(name, F.lit(".test.")), F.regexp_replace(name, r"\.test\.(?!.*\.test\.)", ".")), F.when(F.contains(name, F.lit(".spec.")), F.regexp_replace(name, r"\.spec\.(?!.*\.spec\.)", "."))),
        lambda x: x.isNotNull(),
    )


def test_targets(paths: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """(source, target): the file that a test file is about, most shared path parts first, then the shallowest, then by name.

    Files meet only if they agree in the columns ``within``, which the result has too.
    """
    tests = paths.select(*within, F.col("path").alias("source"), F.explode(tested_names(F.col("path"))).alias("name"))
    index = paths.select(*within, F.col("path").alias("target"), S.basename(F.col("path")).alias("name"))
    shared = F.size(F.array_intersect(F.split("source", "/"), F.split("target", "/")))
    order = Window.partitionBy(*within, "source").orderBy(shared.desc(), F.size(F.split("target", "/")), "target")
    return tests.join(index, [*within, "name"]).withColumn("_place", F.row_number().over(order)).filter("_place = 1").select(*within, "source", "target")
