"""The queries opN_<name> and their SQL. Each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, mixing, near_dedup, pii, quality, secrets_scan, sharding, suffix_dedup, token_counts, warc
from .common import written


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = suffix_dedup.without_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = decontaminate.marked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, class_size."""
    return near_dedup.classes(documents(spark, sf_dir)).drop("_node")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_tokens."""
    return token_counts.token_counts(documents(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows, found = secrets_scan.scanned(documents(spark, sf_dir)), F.col("found")
    base = secrets_scan.KINDS[:3]
    counts = [F.size(secrets_scan.of_kinds(found, k)).cast("long").alias(f"n_{k}") for k in base]
    digest = F.sha2(secrets_scan.span_list(secrets_scan.of_kinds(found, *base)), 256)
    return rows.select("doc_id", *counts, digest.alias("base_sha256"), secrets_scan.span_list(found).alias("spans"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    out = mixing.with_copies(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_ppl, lang."""
    scores = written(quality.measured(documents(spark, sf_dir)), "quality")
    return quality.judged(scores).drop("text_key", "short_log_ppl")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))  # here, so that no text is shuffled
    out = sharding.assign_shards(documents(spark, sf_dir).select("doc_id", "text", crc.alias("text_crc32")))
    none = F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", none)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = pii.with_spans(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.expr(f"CAST(size(filter(base, s -> s.no = {no})) AS BIGINT)").alias(f"n_{k}") for no, (k, _, _) in enumerate(pii.BASE)]
    return found.select("doc_id", *counts, F.sha2(pii.span_list(F.col("base")), 256).alias("base_sha256"), pii.span_list(F.col("spans")).alias("spans"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    archives = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read_archives(spark, archives)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


ORACLE_SQL = {
    "op2_decontaminate": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
iw AS (SELECT item_id, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, list_slice(w, i + 1, i + 10) AS win FROM iw),
sizes AS (SELECT DISTINCT len(win) AS n FROM win),
dp AS (SELECT r, unnest(range(0, len(w))) AS p, w FROM d WHERE len(w) > 0),
dw AS (SELECT r, p, n, list_slice(w, p + 1, p + n) AS win FROM dp, sizes WHERE p + n <= len(w)),
hits AS (SELECT r, p, n, item_id FROM dw JOIN win USING (win)),
hp AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hp USING (r) LEFT JOIN hi USING (r)
""",
    "op6_mixing": r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS src, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS hash,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT none, src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1, 2),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY none, src) - 1) % 3 AS weight, 3 * source_size AS cap FROM s),
l AS (SELECT *, sum(source_size) OVER () AS total,
             coalesce(sum(cap) OVER before, 0) AS cap_before,
             sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left
      FROM w WINDOW before AS (ORDER BY cap / weight, none, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap / weight < (total - cap_before) / weight_left AS full_ FROM l),
t AS (SELECT none, src, source_size, CASE WHEN full_ OR rest_weight = 0 THEN CAST(cap AS DOUBLE)
             ELSE CAST(rest AS DOUBLE) * weight / rest_weight END AS target
      FROM (SELECT *, total - coalesce(sum(CASE WHEN full_ THEN cap END) OVER (), 0) AS rest,
                   sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER () AS rest_weight FROM f)),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each,
             row_number() OVER (PARTITION BY d.none, d.src ORDER BY hash, size) - 1 AS rank
      FROM d JOIN t USING (none, src)),
c AS (SELECT *, CAST(floor((rank + 1) * each + o.x) - floor(rank * each + o.x) AS BIGINT) AS copies
      FROM r, (SELECT unnest([{offsets}]) AS o)),
g AS (SELECT none, src, o, row_number() OVER (PARTITION BY none, src ORDER BY abs(sum(size * copies) - target), o.i) AS best
      FROM c GROUP BY none, src, target, o)
SELECT doc_id, size, source_size, target, size * copies AS taken FROM c JOIN g USING (none, src, o) WHERE best = 1
""",
    "op8_sharding": None,
    "op10_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN strlen(html) >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(html) >= 100 AND page_id > first THEN first END AS refers_to FROM f
""",
}


def oracle_sql() -> dict[str, str]:
    offsets = ", ".join(f"{{'i': {i}, 'x': CAST({x!r} AS DOUBLE)}}" for i, x in enumerate(mixing.offsets(6)))
    return {k: sql.replace("{offsets}", offsets) for k, sql in ORACLE_SQL.items() if sql}
