"""How filters interact: which of them removes what, in every order.

Each document gets a bit for every filter that it fails. The filter "same
text as a document of a smaller id" is an existential self-join: a left-semi
join on the text's hash, the exact text and a smaller id. Its ids are united
with those that fail the other filters, and the documents of each part are
counted by their combination of bits; a filter order is then read off these
counts, whatever the number of documents.

Only texts whose hash occurs under two ids enter the self-join, and its
right side is aggregated first to one row for each text with the smallest
id, so however many copies a text has, a row meets one row. Both sides of
the join are written tables, so adaptive execution splits the partition of a
text that holds a great share of the rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subscope.llm.common import stored

# maximal runs of anything but ASCII white space are words
_SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def repeated_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text a row of a smaller id has too. Nulls
    count as empty texts; a row without id neither repeats another nor is
    repeated, and rows of one id do not repeat each other."""
    rows = docs.where(F.col(id_col).isNotNull()).withColumns(
        {"_text": F.coalesce(F.col(text_col), F.lit(""))}).withColumn("_hash", F.xxhash64("_text"))
    spread = rows.groupBy("_hash").agg(F.min(id_col).alias("_low"), F.max(id_col).alias("_high"))
    shared = stored(spread.where("_low < _high").select("_hash"), "shared-hashes")
    candidates = stored(rows.join(shared, "_hash", "left_semi"), "copy-candidates")
    first = stored(candidates.groupBy("_hash", "_text").agg(F.min(id_col).alias("_first")), "first-copies")
    same = (candidates["_hash"] == first["_hash"]) & (candidates["_text"] == first["_text"])
    return candidates.join(first, same & (first["_first"] < candidates[id_col]), "left_semi").drop("_text", "_hash")


def failures(docs: DataFrame, filters: dict[str, Column], repeated: str | None = None, part: Column | None = None,
             id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``filters`` maps a letter to its failure condition over the columns of
    ``docs`` (null: not failed); ``repeated`` is the letter of the filter on
    repeated texts. Returns the rows by part, (part, n), and the failing
    rows, (part, id, bits, n): equal ids, texts and parts share one row with
    their number ``n``. Bits count from the first letter in alphabetical
    order."""
    letters = sorted([*filters, *([repeated] if repeated else [])])
    docs = docs.withColumn("_part", F.coalesce(part if part is not None else F.lit(""), F.lit("")))
    bits = F.lit(0)
    for letter, failed in filters.items():
        bits = bits + F.when(failed, 1 << letters.index(letter)).otherwise(0)
    key = [F.col("_part").alias("part"), F.col(id_col).alias("id"),
           F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash")]
    # exploded, not filtered: a filter would move below and compute the bits twice
    found = docs.select(*key, F.explode(F.filter(F.array(bits), lambda b: b > 0)).alias("bits"), F.lit(0).alias("source"))
    if repeated:
        found = found.union(repeated_texts(docs.select("_part", id_col, text_col), id_col, text_col).select(
            *key, F.lit(1 << letters.index(repeated)), F.lit(1)))
    # equal rows fail alike, so each source has all of them or none
    rows = found.groupBy("part", "id", "hash").agg(
        F.bit_or("bits").alias("bits"),
        F.greatest(F.sum(F.lit(1) - F.col("source")), F.sum("source")).alias("n"))
    total = docs.groupBy(F.col("_part").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return total, rows.select("part", "id", "bits", "n")


def combinations(total: DataFrame, failing: DataFrame, marks: DataFrame) -> DataFrame:
    """(part, bits, n, good, toxic): the documents of each combination, that
    of no failure included; ``marks`` (id, good, toxic: booleans) may have
    ids more than once (one true row suffices) and need not have all."""
    own = marks.where(F.col("id").isNotNull()).groupBy("id").agg(
        F.max(F.coalesce("good", F.lit(False))).alias("good"), F.max(F.coalesce("toxic", F.lit(False))).alias("toxic"))
    by = stored(failing.join(own, "id", "left").groupBy("part", "bits").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")), "filter-combinations")
    failed = by.groupBy("part").agg(F.sum("n").alias("failed"))
    clean = total.join(failed, "part", "left").select(
        "part", F.lit(0).alias("bits"), (F.col("n") - F.coalesce("failed", F.lit(0))).alias("n"),
        F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return by.unionByName(clean)


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """For every part, order of the filters and step: what the step's filter
    keeps and removes, what fails it but is gone already, what fails it
    alone, the good and toxic documents it removes, and the sum of what it
    removes over all orders (``shapley``)."""
    letters = "".join(sorted(letters))
    orders = ", ".join("'" + "".join(o) + "'" for o in permutations(letters))
    rows = counts.select("*", F.expr(f"explode(array({orders}))").alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))

    def mask(some: Column) -> Column:
        return sum((F.when(F.instr(some, x) > 0, 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))

    rows = rows.withColumns({"own": mask(F.substring("filter_order", F.col("step"), F.lit(1))),
                             "upto": mask(F.substring("filter_order", F.lit(1), F.col("step")))})
    bits, own, before = F.col("bits"), F.col("own"), F.col("upto") - F.col("own")
    fails, alive = bits.bitwiseAND(own) > 0, bits.bitwiseAND(before) == 0

    def total(condition: Column, what: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(what)).otherwise(0)).cast("long")

    out = rows.groupBy("part", "filter_order", "step", "own").agg(
        total(bits.bitwiseAND(F.col("upto")) == 0).alias("kept"),
        total(fails & alive).alias("removed"),
        total(fails & ~alive).alias("redundant"),
        total(bits == own).alias("unique_fails"),
        total(fails & alive, "good").alias("good_lost"),
        total(fails & alive, "toxic").alias("toxic_lost"))
    everywhere = Window.partitionBy("part", "own")  # one row an order
    return out.withColumn("shapley", F.sum("removed").over(everywhere)).drop("own")


def measures(text: Column) -> Column:
    """struct<words, distinct, capitals, chars, markup> of a text, null as empty."""
    text = F.coalesce(text, F.lit(""))
    sizes = F.transform(F.array(words(text)), lambda w: F.struct(  # a lambda's variable is computed once
        F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    return F.struct(sizes["words"].alias("words"), sizes["distinct"].alias("distinct"),
                    F.regexp_count(text, F.lit("[A-Z]")).alias("capitals"), F.char_length(text).alias("chars"),
                    text.rlike(r"[#$%&*|]").alias("markup"))


def quality_filters(m: Column) -> dict[str, Column]:
    """Few words (A), few different ones (B), many capitals (C), markup (D),
    from the measures of a text."""
    return {
        "A": m["words"] < 100,
        "B": 100 * m["distinct"] < 80 * m["words"],
        "C": 100 * m["capitals"] > 10 * m["chars"],
        "D": m["markup"],
    }


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """The interactions of the four filters of :func:`quality_filters` and of
    repeated texts (E) in every part. ``labels`` has quality and toxic by
    id. Null parts count as the empty one; an empty table gives no rows."""
    base = docs.select(id_col, text_col, part_col, measures(F.col(text_col)).alias("_measures"))
    total, failing = failures(base, quality_filters(F.col("_measures")), "E", F.col(part_col), id_col, text_col)
    marks = labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good"),
                          (F.col("toxic") == 1).alias("toxic"))
    return interactions(combinations(total, stored(failing, "failing"), marks), "ABCDE")
