"""Human corrections: last write per slot, application in phases, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S


def slot(action: Column, subject: Column, relation: Column, obj: Column, value: Column) -> Column:
    """The slot in which corrections replace each other."""
    family = (
        F.when(action.isin("accept_concept", "reject_concept"), "decision").when(action.isin("add_edge", "accept_edge", "reject_edge"), "edge")
        .when(action.isin("map_file", "unmap_file"), "file").otherwise(action)
    )
    triple = action.isin("add_edge", "accept_edge", "reject_edge", "map_file", "unmap_file")
    none = F.lit("")
    return S.stable_id("", family, subject, F.when(triple, relation).otherwise(none), F.when(triple, obj).otherwise(none), F.when(action == "add_alias", value).otherwise(none))


def last_per_slot(log: DataFrame) -> DataFrame:
    """log(seq, action, subject_key, relation, object_key, value): the standing corrections with order_seq, their place of application.

    A row of the action ``remove`` clears the slot that its other columns name, ``value`` being the removed action (for an alias, the
    alias stands in ``object_key``). What is written again later takes a new place: an alias that of its first write since.
    """
    removes = F.col("action") == "remove"
    action = F.when(removes, F.col("value")).otherwise(F.col("action"))
    value = F.when(removes, F.col("object_key")).otherwise(F.col("value"))
    keyed = log.withColumn("slot", slot(action, *[F.col(c) for c in ("subject_key", "relation", "object_key")], value))
    upto = Window.partitionBy("slot").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    life = keyed.withColumn("_life", F.count(F.when(removes, 1)).over(upto))  # how many removes came before
    place = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("seq")))
    first = F.min(F.when(~removes, F.col("seq"))).over(Window.partitionBy("slot", "_life"))
    return life.withColumn("_p", place).withColumn("order_seq", F.when(F.col("action") == "add_alias", first).otherwise(F.col("seq"))).filter("_p = 1 AND action <> 'remove'").drop("_p", "_life")


def apply_edges(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Edges without rejected ones and with accepted or added ones; both have source, relation, target, decisions also action."""
    keys = ["source", "relation", "target"]
    no = decisions.filter(F.col("action") == "reject_edge").select(*keys)
    yes = decisions.filter(F.col("action").isin("add_edge", "accept_edge")).select(*keys).distinct()
    left = edges.join(no, keys, "left_anti").join(yes, keys, "left_anti")
    return left.select(*keys, "confidence", "origin").unionByName(yes.select(*keys, F.lit(1.0).alias("confidence"), F.lit("human-overlay").alias("origin")))


def merge_map(merges: list[tuple[str, str]]) -> dict[str, str]:
    """Final concept of each merged one; merges apply in order, and one that would close a ring is ignored. Corrections are few and human."""
    to: dict[str, str] = {}

    def end(x: str) -> str:
        while x in to:
            x = to[x]
        return x

    for a, b in merges:
        a, b = end(a), end(b)
        if a != b:
            to[a] = b
    return {a: end(a) for a in to}


def repoint(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges(source, relation, target, n) with merged(old, new) ends replaced, loops gone and equal edges added up."""
    a = merged.select(F.col("old").alias("source"), F.col("new").alias("_a"))
    b = merged.select(F.col("old").alias("target"), F.col("new").alias("_b"))
    moved = edges.join(a, "source", "left").join(b, "target", "left").select(F.coalesce("_a", "source").alias("source"), "relation", F.coalesce("_b", "target").alias("target"), "n")
    return moved.filter("source <> target").groupBy("source", "relation", "target").agg(F.sum("n").alias("n"))


def review_queue(concepts: DataFrame, edges: DataFrame, decisions: DataFrame, limit: int | None) -> DataFrame:
    """Candidates for review, undecided and unsure first: concepts(key, confidence, active), edges(source, relation, target, confidence), decisions(slot_key, action)."""
    c = concepts.filter("active").select(F.lit("concept").alias("kind"), F.col("key").alias("subject"), F.lit("").alias("relation"), F.lit("").alias("object"), "confidence")
    e = edges.filter(~F.col("relation").isin("contains", "merged_into")).select(F.lit("edge").alias("kind"), F.col("source").alias("subject"), "relation", F.col("target").alias("object"), "confidence")
    keyed = c.unionByName(e).withColumn("slot_key", F.concat_ws("|", "kind", "subject", "relation", "object"))
    out = keyed.join(decisions.select("slot_key", "action"), "slot_key", "left").withColumn("decided", F.col("action").isNotNull())
    out = out.orderBy("decided", "confidence", "kind", "subject", "relation", "object").select("kind", "subject", "relation", "object", "confidence", "decided", F.coalesce("action", F.lit("")).alias("action"))
    return out if limit is None else out.limit(limit)


CONCEPT_ACTIONS = ["create_concept", "rename_concept", "merge_concept", "add_alias", "accept_concept", "reject_concept"]
EDGE_ACTIONS = ["add_edge", "accept_edge", "reject_edge"]
FILE_ACTIONS = ["map_file", "unmap_file"]


def checked(log: DataFrame) -> DataFrame:
    """Corrections in normal form, with the error of those that can't be applied: concepts by their slug, files relative with slashes, a default relation."""
    action = F.col("action")
    concept = lambda c: S.slug(F.coalesce(F.col(c), F.lit("")))
    path = S.loose_path(F.trim("object_key"))
    subject = F.when(action.isin(*CONCEPT_ACTIONS, *EDGE_ACTIONS, *FILE_ACTIONS), concept("subject_key")).otherwise(F.trim("subject_key"))
    obj = F.when(action.isin("merge_concept", *EDGE_ACTIONS), concept("object_key")).when(action.isin(FILE_ACTIONS), path).otherwise(F.trim("object_key"))
    relation = F.when(action.isin(FILE_ACTIONS) & (F.trim("relation") == ""), F.lit("implemented_by")).otherwise(F.trim("relation"))
    out = log.withColumns({"subject_key": subject, "relation": relation, "object_key": obj, "value": F.trim("value")})
    error = (
        F.when(~action.isin(*CONCEPT_ACTIONS, *EDGE_ACTIONS, *FILE_ACTIONS), "unknown action").when(F.col("subject_key") == "", "no subject")
        .when(action.isin("create_concept", "rename_concept", "add_alias") & (F.col("value") == ""), "no value").when((action == "merge_concept") & ((F.col("object_key") == "") | (F.col("object_key") == F.col("subject_key"))), "no other concept")
        .when(action.isin(EDGE_ACTIONS) & ((F.col("relation") == "") | (F.col("object_key") == "")), "no relation or concept").when(action.isin(FILE_ACTIONS) & (F.col("object_key") == ""), "no file")
    )
    return out.withColumn("error", error)


def apply_concepts(concepts: DataFrame, standing: DataFrame, merged: DataFrame) -> DataFrame:
    """concepts(key, label, active, aliases, confidence, source) after corrections; standing as ``last_per_slot`` gives it, merged(old, new).

    Concepts are created first. Of the rest the last rename gives the label, aliases follow each other without repeats, the last
    accept or reject decides about activity, and a merged concept is inactive and names its heir.
    """
    key = F.col("subject_key").alias("key")
    one = lambda action, name: standing.filter(F.col("action").isin(action)).groupBy(key).agg(F.max_by(F.struct("action", "value"), "order_seq").alias(name))
    new = standing.filter("action = 'create_concept'").groupBy(key).agg(F.max_by("value", "order_seq").alias("made"))
    more = standing.filter("action = 'add_alias'").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("order_seq", "value"))), lambda x: x["value"]).alias("more"))
    all_keys = concepts.join(new, "key", "full")
    out = all_keys.join(one(["rename_concept"], "rename"), "key", "left").join(more, "key", "left").join(one(["accept_concept", "reject_concept"], "decision"), "key", "left").join(merged.select(F.col("old").alias("key"), F.col("new").alias("merged_into")), "key", "left")
    touched = F.col("made").isNotNull() | F.col("rename").isNotNull() | F.col("more").isNotNull() | F.col("decision").isNotNull() | F.col("merged_into").isNotNull()
    none = F.array().cast("array<string>")
    return out.select(
        "key", F.coalesce("rename.value", "made", "label").alias("label"),
        F.when(F.col("merged_into").isNotNull(), False).when(F.col("decision.action") == "reject_concept", False).when(F.col("decision.action") == "accept_concept", True).when(F.col("made").isNotNull(), True).otherwise(F.col("active")).alias("active"),
        F.array_distinct(F.concat(F.coalesce("aliases", none), F.coalesce("more", none))).alias("aliases"),
        F.when(touched, 1.0).otherwise(F.col("confidence")).alias("confidence"), F.when(touched, "human-overlay").otherwise(F.col("source")).alias("source"), touched.alias("human_reviewed"),
        F.when(F.col("decision.action") == "accept_concept", "accepted").when(F.col("decision.action") == "reject_concept", "rejected").alias("review_decision"), "merged_into",
    )


def apply_all(concepts: DataFrame, edges: DataFrame, files: DataFrame, standing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(concepts, edges) with all standing corrections applied in their phases.

    edges(layer, source, relation, target, target_kind, data): layer 2 joins concepts, or concepts and files; layer 3 has ``affects``
    edges of tasks. files(path) are the known files. Merge chains are few and written by people: they resolve on the driver, and
    one join rewrites all ends. A rejected concept loses its edges; rejected edges and unmapped files go next; what was
    accepted, added or mapped comes last and needs its concepts and its file to exist.
    """
    known = concepts.select("key").unionByName(standing.filter("action = 'create_concept'").select(F.col("subject_key").alias("key"))).distinct()
    some = standing.filter("action = 'merge_concept'").join(known.withColumnRenamed("key", "subject_key"), "subject_key", "left_semi").join(known.withColumnRenamed("key", "object_key"), "object_key", "left_semi")
    to = merge_map([(r.subject_key, r.object_key) for r in some.orderBy("order_seq").select("subject_key", "object_key").collect()])
    spark = concepts.sparkSession
    merged = spark.createDataFrame(list(to.items()), "old string, new string")
    after = apply_concepts(concepts, standing, merged)

    rejected = standing.filter("action = 'reject_concept'").select(F.col("subject_key").alias("key"))
    concept_end = F.col("target_kind") == "concept"
    cut = edges.join(rejected.withColumnRenamed("key", "source"), ["source"], "left_semi").filter("layer = 2")
    back = edges.filter(concept_end & (F.col("layer") == 2)).join(rejected.withColumnRenamed("key", "target"), ["target"], "left_semi")
    keys = ["layer", "source", "relation", "target", "target_kind"]
    left = edges.join(cut.select(*keys).unionByName(back.select(*keys)).distinct(), keys, "left_anti")

    a = merged.select(F.col("old").alias("source"), F.col("new").alias("_a"))
    b = merged.select(F.col("old").alias("target"), F.lit("concept").alias("target_kind"), F.col("new").alias("_b"))
    moved = left.join(a, "source", "left").join(b, ["target", "target_kind"], "left")
    from_key = F.coalesce(F.when(F.col("_b").isNotNull(), F.col("target")), F.when((F.col("layer") == 2) & F.col("_a").isNotNull(), F.col("source")))
    source = F.when(F.col("layer") == 2, F.coalesce("_a", "source")).otherwise(F.col("source"))
    flat = moved.select("layer", source.alias("source"), "relation", F.coalesce("_b", "target").alias("target"), "target_kind", "data", from_key.alias("merged_from"))
    flat = flat.filter(~(concept_end & (F.col("source") == F.col("target"))))
    # Of edges that a merge makes equal one stays, the human one.
    flat = flat.groupBy(*keys).agg(F.min_by("data", F.struct(F.col("merged_from").isNull(), "data")).alias("data"), F.max("merged_from").alias("merged_from"))
    flat = flat.unionByName(merged.select(F.lit(2).alias("layer"), F.col("old").alias("source"), F.lit("merged_into").alias("relation"), F.col("new").alias("target"), F.lit("concept").alias("target_kind"), F.lit("{}").alias("data"), F.col("old").alias("merged_from")))

    triple = [F.lit(2).alias("layer"), F.col("subject_key").alias("source"), "relation", F.col("object_key").alias("target")]
    kind = F.when(F.col("action").isin(FILE_ACTIONS), "file").otherwise("concept").alias("target_kind")
    no = standing.filter(F.col("action").isin("reject_edge", "unmap_file")).select(*triple, kind)
    yes = standing.filter(F.col("action").isin("add_edge", "accept_edge", "map_file"))
    yes = yes.join(after.select(F.col("key").alias("subject_key")), "subject_key", "left_semi")
    ends = after.select(F.col("key").alias("object_key"), F.lit(False).alias("_f")).unionByName(files.select(F.col("path").alias("object_key"), F.lit(True).alias("_f")))
    yes = yes.withColumn("_f", F.col("action") == "map_file").join(ends, ["object_key", "_f"], "left_semi")
    decided = F.when(F.col("action") == "accept_edge", "accepted").when(F.col("action") == "add_edge", "manual")
    yes = yes.select(*triple, kind, decided.alias("review_decision")).distinct()
    kept = flat.join(no, keys, "left_anti").join(yes.select(*keys), keys, "left_anti")
    old = flat.join(yes.select(*keys), keys, "left_semi").select(*keys, "data", "merged_from")
    human = yes.join(old, keys, "left").select(*keys, F.coalesce("data", F.lit("{}")).alias("data"), "merged_from", F.lit(True).alias("human"), "review_decision")
    return after, kept.select(*keys, "data", "merged_from", F.col("merged_from").isNotNull().alias("human"), F.lit(None).cast("string").alias("review_decision")).unionByName(human)


def decide(candidates: DataFrame, verdict: str, seq: int) -> DataFrame:
    """Corrections that accept or reject candidates of ``review_queue``, numbered from ``seq``."""
    if verdict not in ("accept", "reject"):
        raise ValueError(f"no such verdict: {verdict}")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("kind", "subject", "relation", "object"))  # a page of a human's decisions
    return candidates.select((place + F.lit(seq - 1)).cast("long").alias("seq"), F.concat(F.lit(f"{verdict}_"), "kind").alias("action"), F.col("subject").alias("subject_key"), "relation", F.col("object").alias("object_key"), F.lit("").alias("value"))
