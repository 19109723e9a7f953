"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is cut into words at white space. A run of ``k`` words is a closed
syncmer if, of the ``k - s + 1`` runs of ``s`` words in it, one with the least
hash stands first or last. That depends on the run alone, so equal passages
give equal anchors wherever they stand. A fingerprint is the ``size`` least
32-bit hashes of a text's anchors; the likeness of two is the share of common
hashes among the ``size`` least of both, which estimates the Jaccard
similarity of the anchor sets and is exact for texts with fewer anchors.
A text without an anchor has the hash of its whole word sequence as anchor;
one without words (or null) has none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S, SIZE = 5, 2, 128


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once (a lambda's variable; a plain
    alias could be inlined into the inner lambdas and computed per element)."""
    return F.transform(F.array(value), body)[0]


def _syncmers(h: Column, k: int, s: int, give: Callable[[Column, Column], Column]) -> Column:
    """``give(position, hash)`` of each closed syncmer of word hashes ``h``."""
    w = k - s + 1
    n = F.size(h)

    def at_edge(g: Column, i: Column) -> Column:
        edges = F.least(g[i], g[i + (w - 1)])
        inner = [g[i + j] for j in range(1, w - 1)]
        return edges <= (F.least(*inner) if len(inner) > 1 else inner[0]) if inner else F.lit(True)

    def run(i: Column) -> Column:
        return F.xxhash64(*[h[i + j] for j in range(k)])

    found = _let(
        F.transform(F.sequence(F.lit(0), n - s), lambda i: F.xxhash64(*[h[i + j] for j in range(s)])),
        lambda g: F.transform(
            F.filter(F.sequence(F.lit(0), n - k), lambda i: at_edge(g, i)), lambda i: give(i, run(i))))
    whole = F.array(give(F.lit(0), F.xxhash64(h)))
    return F.when(n == 0, F.slice(whole, 1, 0)).when(n < k, whole).otherwise(
        _let(found, lambda a: F.when(F.size(a) > 0, a).otherwise(whole)))


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), ""), lambda x: F.xxhash64(x))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<position int, hash bigint>>: the anchors for positional
    matching, in text order (positions count words)."""
    return _let(word_hashes(text), lambda h: _syncmers(
        h, k, s, lambda i, x: F.struct(i.alias("position"), x.alias("hash"))))


def sketch(text: Column, k: int = K, s: int = S, size: int = SIZE) -> Column:
    """array<int>: the ``size`` least distinct anchor hashes, ascending."""
    hashes = _let(word_hashes(text), lambda h: _syncmers(h, k, s, lambda i, x: F.shiftright(x, 32).cast("int")))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def as_text(sk: Column) -> Column:
    """A sketch as lowercase hex, eight digits a hash."""
    return F.array_join(
        F.transform(sk, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"))), "")


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """0 to 1; two empty sketches are alike (1), an empty and another not."""
    return _let(
        F.slice(F.sort_array(F.array_union(a, b)), 1, size),
        lambda u: F.when(F.size(u) == 0, 1.0).otherwise(
            F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def _bucket(value: Column, bounds: list[int]) -> Column:
    """Number of bounds below ``value`` (null: 0), found in two levels."""
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i: i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(g[-1]).cast("long") for g in groups])
    inner = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups])
    return F.when(value.isNull(), 0).otherwise(_let(
        F.least(F.size(F.filter(heads, lambda x: x < value)), F.lit(len(groups) - 1)),
        lambda g: g * step + F.size(F.filter(inner[g], lambda x: x < value))))


def with_next(docs: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text",
              buckets: int | None = None) -> DataFrame:
    """``columns`` of every document and, as ``next_<column>``, those of the
    next one in descending id (nulls last, then by text); after the last
    comes the first.

    Documents are dealt over id ranges, and each range is ordered by itself.
    The range bounds are ids of the table, so the first document of a range
    is known without looking into it: its row is sent to the range before it
    too (the very first one's to the last range)."""
    n = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(
        F.percentile_approx(id_col, [(i + 1) / n for i in range(n - 1)] or [0.5], 50 * n).alias("q"),
        F.max(id_col).alias("top")).first()
    bounds = sorted({*(cuts.q or []), *([] if cuts.top is None else [cuts.top])}) or [0]
    own = _bucket(F.col(id_col), bounds)
    is_bound = F.array_contains(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col(id_col))
    also = F.when(F.col(id_col) == bounds[-1], 0).when(is_bound, own + 1)
    rows = docs.select(*columns, F.explode(F.filter(F.array(
        F.struct(own.alias("at"), F.lit(0).alias("guest")),
        F.struct(also.alias("at"), F.lit(1).alias("guest"))), lambda x: x["at"].isNotNull())).alias("_place"))
    order = Window.partitionBy("_place.at").orderBy(
        F.col("_place.guest"), F.col(id_col).desc_nulls_last(), F.col(text_col))
    return rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns if c != id_col]).where(
        "_place.guest = 0").drop("_place")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S,
                        size: int = SIZE) -> DataFrame:
    """Every text's fingerprint, that of its edited text (the last third of
    its code points replaced by the first as many of the next document's, or
    all it has) and their likeness; also the likeness to the next document.

    A null text is empty. Repeated rows stay. If no document has an id, the
    last one's next text is empty."""
    base = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumnRenamed(id_col, "doc_id").withColumn("sk", sketch(F.col("text"), k, s, size))
    d = with_next(base, ["doc_id", "text", "sk"])
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    d = d.select(
        "doc_id", n.cast("long").alias("n_chars"), "sk",
        F.coalesce("next_sk", F.array().cast("array<int>")).alias("next_sk"),
        F.concat(F.substring("text", F.lit(1), n - cut),
                 F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut)).alias("edited"))
    d = d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sk", "next_sk",
                 sketch(F.col("edited"), k, s, size).alias("edited_sk"))
    return d.select(
        F.col("doc_id").alias(id_col), "n_chars", "edited_sha256", as_text(F.col("sk")).alias("fingerprint"),
        as_text(F.col("edited_sk")).alias("edited_fingerprint"),
        likeness(F.col("sk"), F.col("edited_sk"), size).alias("near_edited"),
        likeness(F.col("sk"), F.col("next_sk"), size).alias("near_next"))
