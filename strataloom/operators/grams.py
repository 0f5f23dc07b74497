"""Substring search by an index of grams: an equi-join on the rarest gram of a pattern, then a check of the text itself.

A gram is ``GRAM`` characters in lower case; a shorter pattern is its own gram. Every text that holds a pattern holds all its
grams, so the texts that hold the rarest one are all candidates. Grams that many texts hold are dealt out over parts, with the
patterns that wait for them copied to each part; the plan has no nested loop at any size of either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stored

GRAM = 3
PART_ROWS = 100_000


def grams(text: Column, size: int = GRAM) -> Column:
    """Distinct grams of a text, by one pass over it."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def index(texts: DataFrame, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(gram, id) of texts(id, text); store it to search the same texts again."""
    return texts.select("id", F.explode(F.concat(*[grams(F.col("text"), n) for n in sizes])).alias("gram"))


def asked(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """The rows of ``index`` whose gram a pattern of patterns(pattern) has, written once: a search reads them more than once."""
    return stored(index(texts).join(_wanted(patterns), "gram", "left_semi"), "grams")


def _wanted(patterns: DataFrame) -> DataFrame:
    return patterns.select(F.explode(F.when(F.length("pattern") >= GRAM, grams(F.col("pattern"))).otherwise(F.array(F.lower("pattern")))).alias("gram")).distinct()


def selective(patterns: DataFrame, counts: DataFrame) -> DataFrame:
    """patterns(pattern) with their rarest gram and the number of its texts, from counts(gram, n); patterns with a gram that no text holds are left out."""
    size = F.least(F.length("pattern"), F.lit(GRAM))
    own = patterns.select("pattern", F.explode(F.when(size == GRAM, grams(F.col("pattern"))).otherwise(F.array(F.lower("pattern")))).alias("gram"))
    met = own.join(counts, "gram", "left")
    best = met.groupBy("pattern").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.min(F.struct("n", "gram")).alias("best"))
    return best.filter("missing = 0").select("pattern", "best.gram", "best.n")


def candidates(postings: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, pattern): texts that may hold a pattern. patterns(pattern) are distinct, of two characters or more."""
    known = postings.join(_wanted(patterns), "gram", "left_semi")
    chosen = selective(patterns, known.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    parts = F.ceil(F.col("n") / PART_ROWS).cast("int")
    waiting = chosen.select("pattern", "gram", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    hot = chosen.select("gram", parts.alias("parts")).distinct()
    return known.join(hot, "gram").select("id", "gram", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")).join(waiting, ["gram", "part"]).select("id", "pattern")


def containing(texts: DataFrame, patterns: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """(id, pattern) of every text of texts(id, text) that holds a pattern of patterns(pattern), without case; ids are unique.

    Nulls hold nothing; patterns of fewer than two characters are left out.
    """
    some = patterns.select("pattern").filter(F.length("pattern") >= 2).distinct()
    found = candidates(index(texts) if postings is None else postings, some)
    return found.join(texts.select("id", "text"), "id").filter(F.contains(F.lower("text"), F.lower("pattern"))).select("id", "pattern")
