"""The registered queries of the ten operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "_dedup.n_lines", "_dedup.n_removed", "_dedup.n_spans", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, p, l[p + 1] || chr(10) || l[p + 2] || chr(10) || l[p + 3] AS g,
         trim(l[p + 1]) = '' AND trim(l[p + 2]) = '' AND trim(l[p + 3]) = '' AS blank
  FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS p FROM l WHERE len(l) >= 3)),
later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS r FROM w WHERE NOT blank) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS q FROM later),
spans AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (b IS NULL OR b < q - 1) AS n_spans
  FROM (SELECT doc_id, q, lag(q) OVER (PARTITION BY doc_id ORDER BY q) AS b FROM gone) GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(x, chr(10) ORDER BY q) AS t
  FROM (SELECT doc_id, unnest(l) AS x, unnest(range(0, len(l))) AS q FROM l) ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT l.doc_id, coalesce(len(l.l), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(t, '')) AS kept_sha256
FROM l LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 13) AS size FROM b WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM bs)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw USING (size, g)),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kernels import crc_mod
    from .langid import fit, identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 4) == 2
    found = identify(docs, fit(docs.where(~held_out)))
    return found.withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kernels import crc_mod
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod("doc_id", 4) == 2
    found = score(docs, fit(docs, table(spark, sf_dir, "labels").where(~held_out), "toxic"))
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_sentences", F.size("offending").alias("n_offending")
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("cluster_id"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kernels import crc_mod
    from .quality import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod("doc_id", 3) == 1
    found = score(docs, fit(docs, table(spark, sf_dir, "labels").where(~held_out), "quality"))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "top_passage")


#: The rules of op5: (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def _parse(url: str) -> str:
    low = f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"{low} AS host, coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path"


def _judge() -> str:
    whens = "\n".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return f"CASE {whens} END"


def url_sql(more_links: str = "") -> str:
    return f"""
WITH RECURSIVE rules(rule, verdict) AS (VALUES {", ".join(f"('{h}{p}', '{v}')" for v, h, p in URL_RULES)}),
p AS (SELECT *, {_judge()} AS rule FROM (SELECT page_id, url, html, {_parse("url")} FROM pages)),
tags AS (
  SELECT url, host, path, regexp_extract(t, '(?is)href\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS link
  FROM (SELECT url, host, path, unnest(regexp_extract_all(html, '(?is)<link\\b[^>]*>')) AS t FROM p) WHERE regexp_matches(t, '(?is)rel\\s*=\\s*["'']?canonical')
  UNION ALL
  SELECT url, host, path, regexp_extract(t, '(?is)url\\s*=\\s*["'']?([^"''\\s>;]+)', 1)
  FROM (SELECT url, host, path, unnest(regexp_extract_all(html, '(?is)<meta\\b[^>]*>')) AS t FROM p) WHERE regexp_matches(t, '(?is)http-equiv\\s*=\\s*["'']?refresh')),
links AS (
  SELECT url AS a, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN ':' || link WHEN starts_with(link, '/') THEN '://' || host || link
                   ELSE '://' || host || coalesce(nullif(regexp_extract(path, '(?s)^(.*/)', 1), ''), '/') || link END AS b
  FROM (SELECT url, host, path, replace(link, '&amp;', '&') AS link FROM tags WHERE link <> ''){more_links}),
nodes AS (
  SELECT url, CASE WHEN contains(url, '://') THEN '://' || host || path || regexp_extract(url, '(?s)^.*?://[^?#]*(\\?[^#]*)', 1) ELSE url END AS node, {_judge()} AS rule
  FROM (SELECT url, {_parse("url")} FROM (SELECT url FROM pages UNION SELECT b FROM links) WHERE url IS NOT NULL)),
edges AS (SELECT x.node AS a, y.node AS b FROM links JOIN nodes x ON links.a = x.url JOIN nodes y ON links.b = y.url),
reach(a, b) AS (SELECT node, node FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN (SELECT a, b FROM edges UNION SELECT b, a FROM edges) e ON r.b = e.a),
said AS (
  SELECT r.a AS node, bool_or(verdict = 'allow') AS allowed, bool_or(verdict = 'block') AS blocked
  FROM reach r JOIN nodes n ON r.b = n.node JOIN rules USING (rule) GROUP BY r.a)
SELECT page_id, p.host, p.path, p.rule, coalesce(rules.verdict, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN rules USING (rule) LEFT JOIN (SELECT DISTINCT url, node FROM nodes) n ON p.url = n.url LEFT JOIN said USING (node)
"""


OP5_SQL = url_sql()


def redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites that moved: each page redirects to the first page whose host begins with the same label, whatever follows it.

    So the components, and not the rules alone, decide on many pages.
    """
    from .urlfilter import filter_urls, host

    pages = table(spark, sf_dir, "pages")
    site = F.split_part(host(F.col("url")), F.lit("."), F.lit(1))
    first = pages.where("url IS NOT NULL").groupBy(site.alias("s")).agg(F.min(F.struct("page_id", "url")).getField("url").alias("to_url"))
    moved = pages.select(F.col("url").alias("from_url"), site.alias("s")).join(first, "s").select("from_url", "to_url")
    return filter_urls(pages, URL_RULES, moved)


REDIRECT_SQL = url_sql("""
  UNION ALL SELECT url, first(url) OVER (PARTITION BY split_part(host, '.', 1) ORDER BY page_id, url) FROM p WHERE url IS NOT NULL""")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix aims at: sizes and targets, and whether each source's words taken are within a hundredth and a block of its target."""
    from pyspark.sql import Window

    from .mixing import mix_sources

    found = mix_sources(table(spark, sf_dir, "documents"))
    of = Window.partitionBy("source")
    near = F.abs(F.sum("taken").over(of) - F.col("target")) <= 0.01 * F.col("target") + 64
    return found.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("taken") <= 3 * F.col("size")).alias("bounded"), near.alias("near_target"))


MIX_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
level(i, u) AS (
  SELECT 0, 0::DOUBLE
  UNION ALL SELECT i + 1, (SELECT (sum(source_size) - coalesce(sum(3 * source_size) FILTER (w * u > 3 * source_size), 0)) / sum(w) FILTER (w * u <= 3 * source_size) FROM s)
  FROM level WHERE i < 40 AND u IS NOT NULL)
SELECT doc_id, size, source_size, round(least(w * (SELECT max(u) FROM level), 3 * source_size), 3) AS target, true AS bounded, true AS near_target
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
"""


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdedup import dedup_substrings

    found = dedup_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CASE WHEN len(c.e) = 0 THEN 0 ELSE list_inner_product(q.e, c.e) END::BIGINT AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 10
"""


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_mix_sources": op4_mix_sources,
    "op5_url_filter": op5_url_filter,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_topk": op7_topk,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality": op9_quality,
    "op10_language_id": op10_language_id,
    "redirect_equivalence": redirect_equivalence,
    "mix_targets": mix_targets,
}
SQL = {"op2_line_dedup": OP2_SQL, "op3_decontaminate": OP3_SQL, "op5_url_filter": OP5_SQL, "op7_topk": OP7_SQL, "redirect_equivalence": REDIRECT_SQL, "mix_targets": MIX_SQL}
