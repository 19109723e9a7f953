"""Small document tables with the awkward cases every operator must take."""

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark: SparkSession, rows) -> DataFrame:
    """rows: (doc_id, text) or full document rows."""
    full = [r if len(r) == 5 else (r[0], r[1], "en", "src0", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(rng, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
