"""References between files: what each one tries, what resolves it, and how edges follow from a change set alone.

What a reference resolves to depends on its folder and its text alone, so the references of a folder that say the same are one
question, resolved once. The state of a scan is the narrow facts of the files, the answers and the targets of tests. A full scan
fills them from all facts; a later one drops changed and deleted files, adds new and changed ones, and resolves again only the
questions that are new or try a key that moved.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S
from ..operators import resolve
from ..runtime import stored
from ..sources import rules

FILE = ["project_id", "source"]
REFERENCE = [*FILE, "relation", "how", "value"]
QUESTION = ["project_id", "folder", "how", "language", "value"]
KEY = ["project_id", "kind", "key"]
EDGE = [*FILE, "relation", "target"]
BY_NAME, PATH_GROUPS = -1, 4


@dataclass
class State:
    """files(project_id, path, references, external, module): narrow facts of every file; ``module`` is what a go.mod says.

    answers(project_id, folder, how, language, value, targets): what each question resolves to, empty if nothing. tests(project_id,
    source, target): what test files are about. The other tables follow from these three and are not written.
    """

    files: DataFrame
    answers: DataFrame
    tests: DataFrame

    def stored(self) -> State:
        """The same state in tables of a working folder."""
        return State(*[stored(getattr(self, f.name), f"state-{f.name}") for f in fields(self)])

    @property
    def refs(self) -> DataFrame:
        """(project_id, source, relation, how, value, root): every reference, with the package it names if nothing resolves it."""
        return refs_of(self.files).drop("language", "folder")

    @property
    def tries(self) -> DataFrame:
        """(project_id, folder, how, language, value, g, at, kind, key, module): the keys a question looks for.

        Attempts of a group g >= 0 are paths, of which the first counts; those of group -1 are unique names, which count if no
        path does. ``module`` must be the project's own.
        """
        return tries_of(questions(self.files))

    @property
    def names(self) -> DataFrame:
        """(project_id, kind, key, path): the keys a file answers to."""
        return names_of(self.files)

    @property
    def modules(self) -> DataFrame:
        """(project_id, module): what each go.mod says."""
        return modules_of(self.files)

    @property
    def links(self) -> DataFrame:
        """(project_id, source, relation, how, value, target): references that resolve."""
        found = _raw(self.files).join(self.answers.hint("shuffle_hash"), QUESTION).select(*REFERENCE, F.explode("targets").alias("target"))
        return found.distinct().unionByName(_about(self.tests).select(*FILE, "relation", F.lit("test").alias("how"), F.lit("").alias("value"), "target"))

    def edges(self) -> DataFrame:
        """(project_id, source, relation, target) without edges of a file to itself."""
        found = _raw(self.files).join(self.answers.hint("shuffle_hash"), QUESTION).select(*FILE, "relation", F.explode("targets").alias("target"))
        return found.unionByName(_about(self.tests)).filter("source <> target").distinct()

    def packages(self) -> DataFrame:
        """(project_id, path, external): the packages that a file's extractor found or its unresolved references name, 100 at most."""
        loose = refs_of(self.files).filter("root <> ''").join(self.answers.filter("size(targets) > 0"), QUESTION, "left_anti")
        return loose.groupBy("project_id", F.col("source").alias("path")).agg(F.slice(F.array_sort(F.collect_set("root")), 1, 100).alias("external"))


def _about(tests: DataFrame) -> DataFrame:
    return tests.select(*FILE, F.lit("tests").alias("relation"), "target")


def _extensions() -> Column:
    """Extensions to try for a reference, by how and in which language it was written."""
    out = F.when(F.col("how") == "document", F.array(*map(F.lit, fixed.MARKDOWN_EXTENSIONS))).when(F.col("how") == "structured", F.array(*map(F.lit, rules.STRUCTURED_EXTENSIONS[1:])))
    for name, rule in rules.RULES.items():
        if rule["extensions"]:
            out = out.when(F.col("language") == name, F.array(*map(F.lit, rule["extensions"])))
    return F.coalesce(out, F.array().cast("array<string>"))


def _attempts(base: Column, extensions: Column) -> Column:
    """Paths to try for a normalised path, in order; only the path itself if it has an extension."""
    more = F.concat(F.transform(extensions, lambda e: F.concat(base, e)), F.transform(extensions, lambda e: F.concat(base, F.lit("/index"), e)), F.array(F.concat(base, F.lit("/__init__.py"))))
    return F.when(base.isNotNull(), F.concat(F.array(base), F.when(S.suffix(base) == "", more).otherwise(F.array().cast("array<string>"))))


def _entry(kind: str | Column, key: Column, module: Column | None = None) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), key.alias("key"), (F.lit(None).cast("string") if module is None else module).alias("module"))


def _raw(files: DataFrame, *more: str) -> DataFrame:
    """(project_id, source, relation, how, value, language, folder) of every reference, with columns ``more`` of its file."""
    how = F.substring_index("r.how", ":", 1)
    language = F.substring_index(F.substring(F.col("r.how"), F.length(how) + 2, F.length("r.how")), ":", 1)
    folder = F.substring(F.col("path"), F.lit(1), F.greatest(F.length("path") - F.length(F.substring_index("path", "/", -1)) - 1, F.lit(0)))
    said = files.select("project_id", F.col("path").alias("source"), folder.alias("folder"), *more, F.explode("references").alias("r"))
    return said.select(*FILE, "r.relation", how.alias("how"), "r.value", language.alias("language"), "folder", *more)


def questions(files: DataFrame) -> DataFrame:
    """What the references of some files ask for, each question once."""
    return _raw(files).select(*QUESTION).distinct()


def files_of(facts: DataFrame) -> DataFrame:
    """``State.files`` of some facts."""
    return facts.select("project_id", "path", "references", "external", F.when(F.col("path") == "go.mod", F.get_json_object("metadata", "$.module")).alias("module"))


def _dotted() -> Column:
    return F.startswith("value", F.lit(".")) | F.startswith("value", F.lit("/"))


def refs_of(files: DataFrame) -> DataFrame:
    """``State.refs`` of some files, with language and folder."""
    value, how, x = F.col("value"), F.col("how"), F.split("value", r"\|")
    package = F.when(F.startswith(value, F.lit("@")), F.array_join(F.slice(F.split(value, "/"), 1, 2), "/")).otherwise(F.split(value, "/").getItem(0))
    root = F.when(how == "python", F.when(x.getItem(0).try_cast("int") == 0, F.get(x, F.lit(2)))).when(how == "qualified", F.regexp_extract(value, r"^(\w+)", 1)).when(how.isin("system", "go"), value).when((how == "module") & ~_dotted(), package)
    # A Rust path that begins in its own crate is no package.
    named = F.when(~((how == "qualified") & root.isin("crate", "self", "super", "std")), root)
    own = files.select("project_id", F.col("path").alias("source"), F.lit("").alias("relation"), F.lit("external").alias("how"), F.explode("external").alias("value")).withColumns({"root": F.col("value"), "language": F.lit(""), "folder": F.lit("")})
    return _raw(files).select(*REFERENCE, named.alias("root"), "language", "folder").unionByName(own)


def tries_of(r: DataFrame) -> DataFrame:
    """``State.tries`` of some questions."""
    value, how, folder = F.col("value"), F.col("how"), F.col("folder")
    join = lambda *parts: F.concat_ws("/", *[F.when(x != "", x) for x in parts])

    local = F.regexp_replace(value, "[#?].*$", "")
    foreign = F.lit(False)
    for scheme in fixed.FOREIGN_SCHEMES:
        foreign = foreign | F.startswith(value, F.lit(scheme))
    base = S.normalize_path(F.when(F.startswith(local, F.lit("/")), local).otherwise(join(folder, local)))
    by_path = F.when(~foreign & (local != ""), F.array(_attempts(base, _extensions())))
    x = F.split(value, r"\|")
    level, module = x.getItem(0).try_cast("int"), F.replace(F.get(x, F.lit(1)), F.lit("."), F.lit("/"))
    depth = F.when(folder == "", 0).otherwise(F.size(F.split(folder, "/")))
    above = F.array_join(F.slice(F.split(folder, "/"), F.lit(1), F.greatest(depth - F.greatest(level - 1, F.lit(0)), F.lit(0))), "/")
    prefixes = F.when(level > 0, F.array(above)).otherwise(F.array(F.lit(""), F.lit("src"), F.lit("lib"), F.lit("app")))
    python = F.transform(prefixes, lambda q: _attempts(S.normalize_path(F.concat_ws("/", F.when(q != "", q), module)), F.array(F.lit(".py"))))
    rust = F.array(F.array(join(folder, F.concat(value, F.lit(".rs"))), join(folder, F.concat(value, F.lit("/mod.rs")))))
    groups = F.when(how == "python", python).when(how == "rust_module", rust).when(how.isin("document", "structured", "relative") | ((how == "module") & _dotted()), by_path)
    paths = r.select(*QUESTION, F.posexplode(groups).alias("g", "attempts")).select(*QUESTION, "g", F.posexplode("attempts").alias("at", "key")).select(*QUESTION, "g", "at", F.lit("path").alias("kind"), "key", F.lit(None).cast("string").alias("module"))

    ref = F.lower(S.basename(value))
    last = F.lower(F.regexp_replace(F.regexp_replace(F.split(value, r"::\{").getItem(0), r"\.\*$", ""), r"^.*(\.|::|/)", ""))
    # Which module a Go project is follows from another file, so an import is tried under every module that it may be of.
    p = F.split(value, "/")
    go = F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda k: _entry("go", F.lower(F.array_join(F.slice(p, k + 1, F.size(p)), "/")), F.array_join(F.slice(p, F.lit(1), k), "/"))))
    wanted = F.when(how == "document", F.array(_entry("name", ref), _entry("stem", F.regexp_replace(ref, r"(?<=.)\.[^.]+$", "")))).when(how == "qualified", F.array(_entry(F.concat(F.lit("stem:"), "language"), last))).when(how == "go", go)
    names = r.select(*QUESTION, F.lit(BY_NAME).alias("g"), F.posexplode(wanted).alias("at", "e")).select(*QUESTION, "g", "at", "e.*")

    return paths.unionByName(names)


def names_of(paths: DataFrame) -> DataFrame:
    """``State.names`` of paths(project_id, path)."""
    path, name, stem = F.col("path"), F.lower("own"), F.col("stem")
    paths = paths.select("project_id", "path", F.substring_index("path", "/", -1).alias("own"), F.lower(S.stem(path)).alias("stem"), S.suffix(path).alias("suffix"))
    entry = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    tails = F.split(F.lower(S.parent(path)), "/")
    go = F.when((F.col("suffix") == ".go") & ~F.endswith("path", F.lit("_test.go")), F.transform(F.sequence(F.lit(1), F.size(tails)), lambda k: F.struct(F.lit("go").alias("kind"), F.array_join(F.slice(tails, k, F.size(tails)), "/").alias("key"))))
    by_language = [F.when(F.col("suffix").isin(rules.RULES[n]["suffixes"]), entry(f"stem:{n}", stem)) for n in ("java", "rust")]
    every = F.filter(F.array(entry("path", path), entry("file", F.col("own")), entry("name", name), entry("stem", stem), *by_language), lambda e: e.isNotNull())
    return paths.select("project_id", "path", F.explode(F.concat(every, F.coalesce(go, F.array().cast("array<struct<kind:string,key:string>>")))).alias("e")).select("project_id", "e.kind", "e.key", "path")


def modules_of(files: DataFrame) -> DataFrame:
    """``State.modules`` of some files."""
    return files.filter("module IS NOT NULL").select("project_id", "module")


def unique(names: DataFrame) -> DataFrame:
    """(project_id, kind, key, target) of keys that exactly one file answers to."""
    return names.filter("kind <> 'file'").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("target")).filter("n = 1").drop("n")


def answers_of(asked: DataFrame, files: DataFrame) -> DataFrame:
    """``State.answers`` of the questions ``asked`` among all files."""
    tries = tries_of(asked)
    usable = tries.filter("kind <> 'go'").unionByName(tries.filter("kind = 'go'").join(modules_of(files), ["project_id", "module"], "left_semi").select(tries.columns))
    # Names that nobody asks for are most; they go before the rest are sorted.
    names = names_of(files).join(usable.select(*KEY).distinct().hint("shuffle_hash"), KEY, "left_semi")
    hits = usable.join(unique(names), KEY)
    first = lambda g: F.min_by("target", F.when(F.col("g") == g, F.col("at")))
    best = hits.groupBy(*QUESTION).agg(F.array_compact(F.array(*[first(g) for g in range(PATH_GROUPS)])).alias("by_path"), first(BY_NAME).alias("by_name"))
    targets = F.when(F.size("by_path") > 0, F.array_distinct("by_path")).otherwise(F.array("by_name"))
    return asked.join(best, QUESTION, "left").select(*QUESTION, F.when(F.col("by_path").isNotNull(), targets).otherwise(F.array().cast("array<string>")).alias("targets"))


def tests_of(files: DataFrame) -> DataFrame:
    """``State.tests`` of all files: which file a test is about depends on all files of the name."""
    asked = files.select("project_id", F.col("path").alias("source"), F.explode(resolve.tested_names(F.col("path"))).alias("name"))
    named = files.select("project_id", "path", S.basename(F.col("path")).alias("name")).join(asked.select("project_id", "name").distinct().hint("shuffle_hash"), ["project_id", "name"], "left_semi")
    about = named.select("project_id", "path").unionByName(asked.select("project_id", F.col("source").alias("path"))).distinct()
    return resolve.test_targets(about, ["project_id"]).join(asked.select(*FILE).distinct(), FILE, "left_semi").select(*FILE, "target")


def state(facts: DataFrame) -> State:
    """The state of all facts(project_id, path, references, external, metadata)."""
    files = files_of(facts)
    return State(files, answers_of(stored(questions(files), "asked"), files), tests_of(files))


@dataclass
class Difference:
    """sources(project_id, source): files that are new or changed, or have a reference with another answer. edges(…, change): every edge before and after, deleted, inserted or kept."""

    sources: DataFrame
    edges: DataFrame

    @property
    def deleted(self) -> DataFrame:
        return self.edges.filter("change = 'deleted'").drop("change")

    @property
    def inserted(self) -> DataFrame:
        return self.edges.filter("change = 'inserted'").drop("change")


def update(old: State, fresh: DataFrame, changes: DataFrame) -> tuple[State, Difference]:
    """(state, difference) after changes(project_id, path, change); ``fresh`` are the facts of new and changed files alone.

    Equal to ``state`` of all facts. A question is resolved again if it is new, or if it tries a key that moved: a name or path of a file
    that came or went, another module. Facts of other files are not needed. A change set that is empty changes nothing; one that names a
    file twice is an error of the caller. ``old`` is only read; the new state is written by ``stored``, if there is a next scan.
    """
    one, place = changes.select("project_id", "path", "change"), ["project_id", "path"]
    marked = old.files.join(one.filter("change <> 'new'").select(*place, F.lit(True).alias("gone")), place, "left").withColumn("stays", F.col("gone").isNull())
    new = files_of(fresh)
    files = marked.filter("stays").select(new.columns).unionByName(new)

    moved = names_of(one.filter("change <> 'changed'")).select(*KEY).distinct()
    was, now = old.modules, modules_of(files)
    said = was.exceptAll(now).unionByName(now.exceptAll(was))
    tries = tries_of(old.answers.select(*QUESTION))
    touched = tries.join(moved.hint("shuffle_hash"), KEY, "left_semi").select(*QUESTION).unionByName(tries.filter("kind = 'go'").join(said, ["project_id", "module"], "left_semi").select(*QUESTION))
    again = stored(touched.unionByName(questions(new)).distinct(), "asked")
    found = answers_of(again, files).withColumnRenamed("targets", "now")
    both = stored(old.answers.withColumnRenamed("targets", "was").join(found, QUESTION, "full").select(*QUESTION, "was", F.coalesce("now", "was").alias("now")), "answers")
    tests = stored(tests_of(files), "tests")

    refs = _raw(marked, "stays").withColumn("stood", F.lit(True)).unionByName(_raw(new).withColumns({"stays": F.lit(True), "stood": F.lit(False)}))
    answered = refs.join(both.hint("shuffle_hash"), QUESTION)
    none = F.array().cast("array<struct<target:string,held:int>>")
    ends = lambda c, held: F.transform(c, lambda t: F.struct(t.alias("target"), F.lit(held).alias("held")))
    # Of each edge one bit for before and one for after.
    held = F.when(F.col("stood") & F.col("stays") & (F.col("was") == F.col("now")), ends("now", 3)).otherwise(F.concat(F.when(F.col("stood"), ends("was", 1)).otherwise(none), F.when(F.col("stays"), ends("now", 2)).otherwise(none)))
    every = answered.select(*FILE, "relation", F.explode(held).alias("e")).select(*FILE, "relation", "e.target", "e.held")
    every = every.unionByName(_about(old.tests).withColumn("held", F.lit(1))).unionByName(_about(tests).withColumn("held", F.lit(2))).filter("source <> target")
    change = F.when(F.col("held") == 3, "kept").when(F.col("held") == 1, "deleted").otherwise("inserted")
    edges = every.groupBy(*EDGE).agg(F.bit_or("held").alias("held")).select(*EDGE, change.alias("change"))

    other = answered.filter("stood AND stays AND NOT (was <=> now)").select(*FILE)
    about = old.tests.exceptAll(tests).unionByName(tests.exceptAll(old.tests)).select(*FILE).join(files.select("project_id", F.col("path").alias("source")), FILE, "left_semi")
    sources = other.unionByName(about).unionByName(new.select("project_id", F.col("path").alias("source"))).distinct()
    asked = both.join(questions(files), QUESTION, "left_semi").select(*QUESTION, F.col("now").alias("targets"))
    return State(files, asked, tests), Difference(sources, edges)
