"""A Markdown vault of a graph: notes of concepts, tasks and the project, and an index, as rows and as text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CONCEPT_TASKS, PROJECT_TASKS, NAME = 20, 50, 120


def note_name(label: Column, key: Column) -> Column:
    """A file name for a note: the label without characters that paths or links give a meaning, and a tail of the key's hash."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(label, r'[\\/:*?"<>|#^\[\]\x00-\x1f]+', " "), r"\s+", " "))
    return F.concat(F.substring(F.when(plain == "", "note").otherwise(plain), 1, NAME), F.lit("-"), F.substring(F.sha2(key, 256), 1, 8))


def wiki_link(name: Column, label: Column) -> Column:
    return F.concat(F.lit("[["), name, F.lit("|"), F.regexp_replace(label, r"[\[\]|]", " "), F.lit("]]"))


def file_link(root: Column, path: Column) -> Column:
    """A link to a file by its URI."""
    return F.concat(F.lit("["), path, F.lit("](file://"), F.replace(F.url_encode(F.concat_ws("/", root, path)), F.lit("%2F"), F.lit("/")), F.lit(")"))


def _lines(df: DataFrame, key: str, line: Column, order: list, limit: int | None, name: str) -> DataFrame:
    """The lines of each key in order, at most ``limit``, as one text."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    some = df.select(key, line.alias("line"), place.alias("p"))
    if limit is not None:
        some = some.filter(F.col("p") <= limit)
    return some.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda x: x["line"]), "\n").alias(name))


def notes(project: str, root: str, concepts: DataFrame, files: DataFrame, relations: DataFrame, tasks: DataFrame, affects: DataFrame) -> DataFrame:
    """(folder, note, body) of one project.

    concepts(key, label), files(key, path) of concepts, relations(source, relation, target) between concepts, tasks(task, title,
    status, created_at, summary), affects(task, key). A concept lists its files, its relations and its newest tasks.
    """
    c = concepts.select("key", "label", note_name(F.col("label"), F.col("key")).alias("note"))
    t = tasks.withColumn("note", note_name(F.col("title"), F.col("task")))
    own_files = _lines(files, "key", F.concat(F.lit("- "), file_link(F.lit(root), F.col("path"))), ["path"], None, "files")
    to = relations.join(c.select(F.col("key").alias("target"), F.col("label").alias("l"), F.col("note").alias("n")), "target").withColumnRenamed("source", "key")
    own_relations = _lines(to, "key", F.concat(F.lit("- "), "relation", F.lit(" "), wiki_link(F.col("n"), F.col("l"))), ["relation", "l", "target"], None, "links")
    task_line = F.concat(F.lit("- "), wiki_link(F.col("note"), F.col("title")), F.lit(" "), "status")
    newest = [F.desc("created_at"), F.col("task")]
    own_tasks = _lines(affects.join(t, "task"), "key", task_line, newest, CONCEPT_TASKS, "tasks")
    full = c.join(own_files, "key", "left").join(own_relations, "key", "left").join(own_tasks, "key", "left")
    part = lambda title, col: F.when(F.col(col).isNotNull(), F.concat(F.lit(f"## {title}\n"), F.col(col)))
    concept_notes = full.select(F.lit("concepts").alias("folder"), "note", F.concat_ws("\n\n", F.concat(F.lit("# "), "label"), part("Files", "files"), part("Relations", "links"), part("Tasks", "tasks")).alias("body"))
    touched = _lines(affects.join(c, "key"), "task", F.concat(F.lit("- "), wiki_link(F.col("note"), F.col("label"))), ["label", "key"], None, "concepts")
    summary = F.when(F.trim("summary") != "", F.col("summary"))
    task_notes = t.join(touched, "task", "left").select(F.lit("tasks").alias("folder"), "note", F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), F.concat(F.lit("Status: "), "status"), summary, part("Concepts", "concepts")).alias("body"))
    one = lambda df, line, order, limit, name: _lines(df.withColumn("_k", F.lit(project)), "_k", line, order, limit, name)
    listed = one(c, F.concat(F.lit("- "), wiki_link(F.col("note"), F.col("label"))), ["label", "key"], None, "concepts")
    recent = one(t.orderBy(*newest).limit(PROJECT_TASKS), task_line, newest, PROJECT_TASKS, "tasks")
    home = concepts.sparkSession.createDataFrame([(project,)], "_k string").join(listed, "_k", "left").join(recent, "_k", "left")
    index = home.select(F.lit("").alias("folder"), F.lit("index").alias("note"), F.concat_ws("\n\n", F.concat(F.lit("# "), "_k"), part("Concepts", "concepts"), part("Tasks", "tasks")).alias("body"))
    return concept_notes.unionByName(task_notes).unionByName(index)


def write(rows: DataFrame, folder: str) -> None:
    """Replace a vault: a folder of text for each note, so any number of tasks can write and nothing of an older vault stays."""
    where = F.when(F.col("folder") == "", "project").otherwise(F.col("folder"))
    rows.select(where.alias("folder"), "note", F.col("body").alias("value")).write.mode("overwrite").partitionBy("folder", "note").text(folder)
