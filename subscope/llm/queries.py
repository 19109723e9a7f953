"""The registered queries of the text operators and their DuckDB SQL.

Each query applies one operator with production parameters to its whole
table and derives the digest columns of its contract from what the operator
returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subscope.llm import (
    decontaminate,
    filter_audit,
    hosts,
    langid,
    lexical,
    licenses,
    linededup,
    packing,
    quality,
    repeats,
    secret_scan,
    simhash,
    syncmers,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page labels are the rows of ``labels`` whose id is the page's:
    good is quality 1 and not toxic."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"),
        ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    return hosts.judge(table(spark, sf_dir, "pages"), labels, RULES)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", F.size("lines_removed").cast("long").alias("n_removed"), "lines_removed",
                       F.sha2("text", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), length=2048).drop("ids")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.train(documents, quality.good_labels(table(spark, sf_dir, "labels")))
    return quality.score(documents, model).select("doc_id", "content_score", "metadata_score", "quality", "accepted")


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_passages(table(spark, sf_dir, "documents"), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses_by_document(licenses.license_hits(table(spark, sf_dir, "documents")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))

    def joined(spans) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    return found.select("doc_id", *[count(kind) for kind in secret_scan.BASE],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_syncmer_fingerprints": op1_syncmer_fingerprints,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_url_reputation": op3_url_reputation,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_language_id": op6_language_id,
    "op7_pack_sequences": op7_pack_sequences,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_license_scan": op10_license_scan,
    "op11_filter_audit": op11_filter_audit,
    "op12_secret_scan": op12_secret_scan,
    "op13_ranked_search": op13_ranked_search,
}

# one level of the shrinkage: prior strength by the method of moments
_STRENGTH = """
{name} AS (
  SELECT u.*, 1 / least(greatest(coalesce((
           SELECT (sum(pow(k - n * m, 2)) - sum(n * m * (1 - m))) / nullif(sum(n * (n - 1) * m * (1 - m)), 0)
           FROM {units}), 0), 1e-4), 0.9999) - 1 AS c
  FROM {units} u)"""

_OP3 = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut),
p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM parts),
marks AS (
  SELECT doc_id, bool_and(quality = 1 AND coalesce(toxic, 0) = 0) AS good FROM labels GROUP BY doc_id),
by_host AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix,
         count(good) AS n, count(*) FILTER (WHERE good) AS k
  FROM p LEFT JOIN marks ON marks.doc_id = p.page_id GROUP BY ALL),
s0 AS (
  SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM by_host) AS m FROM by_host GROUP BY suffix),
""" + _STRENGTH.format(name="s1", units="s0").strip() + """,
d0 AS (
  SELECT domain, sum(h.n) AS n, sum(h.k) AS k, any_value((s1.c * s1.m + s1.k) / (s1.c + s1.n)) AS m
  FROM by_host h JOIN s1 USING (suffix) GROUP BY domain),
""" + _STRENGTH.format(name="d1", units="d0").strip() + """,
h0 AS (
  SELECT h.host, h.n, h.k, (d1.c * d1.m + d1.k) / (d1.c + d1.n) AS m FROM by_host h JOIN d1 USING (domain)),
""" + _STRENGTH.format(name="h1", units="h0").strip() + """,
post AS (
  SELECT host, (c * m + k) / (c + n) AS mean, c + n AS size FROM h1),
rules(rule, host_part, path_part, action) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'),
  ('net/fr/', 'net', '/fr/', 'block')),
hit AS (
  SELECT p.host, p.path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM (SELECT DISTINCT host, path FROM p) p JOIN rules
    ON (p.host = host_part OR ends_with(p.host, '.' || host_part)) AND starts_with(p.path, path_part)
  GROUP BY ALL)
SELECT p.page_id, p.host, p.path, hit.rule,
       coalesce(hit.action, CASE WHEN mean + 1.645 * sqrt(mean * (1 - mean) / (size + 1)) < 0.5 THEN 'block' ELSE 'allow' END)
         AS verdict, round(mean, 6) AS reputation
FROM p JOIN post USING (host) LEFT JOIN hit ON hit.host = p.host AND hit.path = p.path"""

# every shingle of every text, joined on the shingle
_OP5 = r"""
WITH item AS (
  SELECT item_id, w, least(5, len(w)) AS k FROM (
    SELECT item_id, list_filter(string_split_regex(lower(text), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM benchmark)
  WHERE len(w) > 0),
wanted AS (
  SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM item),
size AS (SELECT item_id, count(*) AS item_shingles FROM wanted GROUP BY item_id),
doc AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents),
held AS (
  SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM doc, (SELECT DISTINCT k FROM item))
SELECT doc_id, item_id, count(*) AS shared, item_shingles, count(*) / item_shingles AS containment
FROM held JOIN wanted USING (k, s) JOIN size USING (item_id)
GROUP BY doc_id, item_id, item_shingles HAVING count(*) >= 0.8 * item_shingles - 1e-9"""

# every order of the five filters, step by step
_OP11 = r"""
WITH base AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
earliest AS (SELECT text, min(doc_id) AS lowest FROM base GROUP BY text),
marks AS (
  SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text)
                 THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN lowest < doc_id THEN 'E' ELSE '' END AS bad
  FROM base JOIN earliest USING (text) LEFT JOIN marks USING (doc_id)),
c AS (
  SELECT part, bad, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM f GROUP BY ALL),
letter(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letter a JOIN letter b ON b.l <> a.l JOIN letter c ON c.l NOT IN (a.l, b.l)
  JOIN letter d ON d.l NOT IN (a.l, b.l, c.l) JOIN letter e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
steps AS (
  SELECT filter_order, unnest([1, 2, 3, 4, 5])::INT AS step FROM orders),
placed AS (
  SELECT *, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM steps),
out AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN bad = '' OR translate(bad, before || own, '') = bad THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN contains(bad, own) AND translate(bad, before, '') = bad THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN contains(bad, own) AND translate(bad, before, '') <> bad THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN bad = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN contains(bad, own) AND translate(bad, before, '') = bad THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN contains(bad, own) AND translate(bad, before, '') = bad THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, placed GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM out"""

# spans from the lengths of the pieces between matches; a token's checksum
# (reflected CRC-32) and its base-62 digits are folds over lists
_OP12_KINDS = [
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""",
     r"""length(regexp_extract(m, '^[A-Za-z_]+?(?:[dDtTnNyY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6"""),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", "[0-9a-f]+", "length(m) >= 24"),
    ("github", "gh[pousr]_[A-Za-z0-9]+", "length(m) = 40 AND {checked}"),
    ("npm", "npm_[A-Za-z0-9]+", "length(m) = 40 AND {checked}"),
]
_OP12_CHECKED = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(m[5:34], ''), lambda x: ascii(x)::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
                             lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT)
    = list_reduce(list_prepend(0::UBIGINT, list_transform(string_split(m[35:40], ''), lambda x:
        (strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', x) - 1)::UBIGINT)), lambda a, b: a * 62 + b)"""


def _op12_kind(number: int, kind: str, pattern: str, kept: str) -> str:
    return f"""
  SELECT doc_id, row, {number} AS k, '{kind}' AS kind, start, start + length(m) AS stop FROM (
    SELECT doc_id, row, m, list_sum(list_transform(pieces[:i], lambda x: length(x)))::BIGINT
           + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0)::BIGINT AS start
    FROM (SELECT doc_id, row, ms, pieces, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m FROM (
      SELECT doc_id, row, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS pieces
      FROM docs)))
  WHERE {kept.replace("{checked}", _OP12_CHECKED)}"""


_OP12 = """
WITH docs AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
spans AS (""" + " UNION ALL ".join(_op12_kind(i, *k) for i, k in enumerate(_OP12_KINDS)) + """),
per AS (
  SELECT row, count(*) FILTER (WHERE k = 0) AS a, count(*) FILTER (WHERE k = 1) AS b, count(*) FILTER (WHERE k = 2) AS c,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (WHERE k < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans
  FROM spans GROUP BY row)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (row)"""

_OP13 = r"""
WITH doc AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
item AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
asked AS (
  SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(w) AS term FROM item) GROUP BY ALL),
size AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM doc WHERE len(w) > 0),
held AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM doc)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, size GROUP BY term, n_docs),
scored AS (
  SELECT item, item_id, row, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM held JOIN weight USING (term) JOIN asked USING (term), size GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20"""

ORACLE_SQL: dict[str, str] = {
    "op3_url_reputation": _OP3,
    "op5_decontamination": _OP5,
    "op11_filter_audit": _OP11,
    "op12_secret_scan": _OP12,
    "op13_ranked_search": _OP13,
}
