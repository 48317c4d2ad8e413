"""One thin query per training-data operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, langid, lm, media, minhash, packing, quality, urlfilter, warc
from .common import materialise

RANKS = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again by the byte-level ranks."""
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    ids = bpe.encode_column(table(spark, sf_dir, "documents"), path, pattern)
    return bpe.decode_column(ids, path, pattern).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op2_media_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a transport stream, read back and described."""
    stored = media.encode_column(table(spark, sf_dir, "documents"))
    back = media.decode_column(stored, ["doc_id", "n_bytes"])
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "pts",
        "random_access",
    )


def captures_and_changes(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Days on which the pages were fetched, and a dated list, both derived from the table.

    The tables hold neither, so digests of ids and hosts stand in for them: every page has a
    day in 2023, every third host is listed once, some of these are removed and listed again,
    and each registrable domain (example.*) is listed for a month.
    """
    number = lambda c, at: F.conv(F.substring(F.md5(c), at, 6), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2023-01-01").cast("date"), n.cast("int"))
    text = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    captures = pages.select("page_id", "url", day(number(text, 1) % 365).alias("day"))
    hosts = pages.select(urlfilter.host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    h = F.col("host")
    start = number(h, 1) % 200
    change = lambda name, entry, action, n, when: F.struct(F.lit(name).alias("list_name"), entry.alias("entry"), F.lit(action).alias("action"), day(n).alias("day"), when.alias("real"))
    listed, removed = number(h, 7) % 3 == 0, number(h, 13) % 2 == 0
    logged = F.array(
        change("hosts", h, "add", start, listed),
        change("hosts", h, "remove", start + 40, listed & removed),
        change("hosts", h, "add", start + 90, listed & removed & (number(h, 19) % 2 == 0)),
    )
    changes = hosts.select(F.explode(logged).alias("c")).select("c.*").filter("real").drop("real")
    domain = F.element_at(urlfilter.suffixes(h), -1)
    domains = hosts.select(domain.alias("entry")).distinct()
    month = number(F.col("entry"), 1) % 300
    both = F.array(change("domains", F.col("entry"), "add", month, F.lit(True)), change("domains", F.col("entry"), "remove", month + 30, F.lit(True)))
    return captures, changes.unionByName(domains.select(F.explode(both).alias("c")).select("c.*").drop("real"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the list entries in force on the day of its capture."""
    captures, changes = captures_and_changes(table(spark, sf_dir, "pages"))
    return urlfilter.judge(captures, changes).select("page_id", "url", "day", "host", "listed", "n_entries", "entry", F.array_join("lists", ",").alias("lists"))


def op4_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log-probability under the recurrent model and under the counts."""
    return lm.score_documents(table(spark, sf_dir, "documents"), lm.held_out_column)


def op7_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: x != ""))
    return html.text_column(table(spark, sf_dir, "pages")).select("page_id", "text", F.length("text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in sequences of several lengths."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document, by shingles of two words."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, and whether rules and their learnt accuracies keep it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", quality.features(F.col("text")).alias("f"))
    counted = materialise(docs.select("doc_id", "f.*"), "quality")
    model = quality.fit(counted)
    posterior, failed = model.posterior(F.col), quality.base_failed(F.col)
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (posterior >= 0.5)).alias("kept"), posterior.alias("posterior"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, held_out=langid.held_out_column())
    found = docs.select("doc_id", langid.held_out_column().alias("held_out"), model.column(F.col("text")).alias("f"))
    return found.select("doc_id", "held_out", F.col("f.lang").alias("lang_pred"), F.col("f.score").alias("score"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    page = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS BIGINT)")
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


OP3_SQL = r"""
WITH c AS (
  SELECT page_id, url, DATE '2023-01-01' + CAST(('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 6))::INT % 365 AS INT) AS day,
         rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]*\]|[^/?#:@]*)', 1)), '.') AS host
  FROM pages
), h AS (
  SELECT DISTINCT host FROM c WHERE host <> ''
), s AS (
  SELECT host, unnest(CASE WHEN regexp_matches(host, '^([0-9.]+|\[.*)$') OR len(string_split(host, '.')) < 2 THEN [host]
    ELSE list_transform(range(1, len(string_split(host, '.'))), lambda i: array_to_string(string_split(host, '.')[i:], '.')) END) AS entry FROM h
), n AS (
  SELECT host, ('0x' || substr(md5(host), 1, 6))::INT % 200 AS start, ('0x' || substr(md5(host), 7, 6))::INT % 3 = 0 AS listed,
         ('0x' || substr(md5(host), 13, 6))::INT % 2 = 0 AS removed, ('0x' || substr(md5(host), 19, 6))::INT % 2 = 0 AS again FROM h
), d AS (
  SELECT DISTINCT last_value(entry) OVER (PARTITION BY host ORDER BY length(entry) DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS entry FROM s
), held AS (
  SELECT 'hosts' AS list_name, host AS entry, DATE '2023-01-01' + start AS a, CASE WHEN removed THEN DATE '2023-01-01' + (start + 40) END AS b FROM n WHERE listed
  UNION ALL SELECT 'hosts', host, DATE '2023-01-01' + (start + 90), NULL FROM n WHERE listed AND removed AND again
  UNION ALL SELECT 'domains', entry, DATE '2023-01-01' + ('0x' || substr(md5(entry), 1, 6))::INT % 300, DATE '2023-01-01' + (('0x' || substr(md5(entry), 1, 6))::INT % 300 + 30) FROM d
), found AS (
  SELECT DISTINCT c.host, c.day, held.list_name, held.entry FROM (SELECT DISTINCT host, day FROM c) c JOIN s ON s.host = c.host JOIN held ON held.entry = s.entry AND c.day >= a AND (b IS NULL OR c.day < b)
), v AS (
  SELECT host, day, count(DISTINCT entry) AS n_entries, arg_max(entry, length(entry)) AS entry, string_agg(DISTINCT list_name, ',' ORDER BY list_name) AS lists FROM found GROUP BY host, day
)
SELECT page_id, url, CAST(c.day AS DATE) AS day, c.host, v.entry IS NOT NULL AS listed, CAST(coalesce(n_entries, 0) AS BIGINT) AS n_entries, v.entry, coalesce(lists, '') AS lists
FROM c LEFT JOIN v ON v.host = c.host AND v.day = c.day
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), both_ways AS (
  SELECT a, b FROM e UNION SELECT b, a FROM e
), reach(id, r) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT reach.id, b FROM reach JOIN both_ways ON a = r
)
SELECT w.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id, w.doc_id = min(r) AS kept
FROM w JOIN reach ON reach.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""

OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages
), d AS (
  SELECT page_id, keeper, strlen(html) AS n,
         list_reduce(list_transform(string_split(sha1(html), ''),
           lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
                [instr('0123456789abcdef', c)]), lambda a, b: a || b) AS bits
  FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
            + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) + 1 AS INT), 1)), lambda a, b: a || b) AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM d
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_media_column": op2_media_column,
    "op3_url_filter": op3_url_filter,
    "op4_gated_lm": op4_gated_lm,
    "op5_circulant_minhash": op5_circulant_minhash,
    "op6_weak_supervision": op6_weak_supervision,
    "op7_html_layout": op7_html_layout,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_language_id": op9_language_id,
    "op10_warc": op10_warc,
}
SQL: dict[str, str] = {"op3_url_filter": OP3_SQL, "op5_circulant_minhash": OP5_SQL, "op10_warc": OP10_SQL}
