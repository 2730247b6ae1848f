"""The operators of this subpackage applied to their whole tables, and SQL for what SQL can express."""

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.llm import (
    byte_bpe,
    exact_dedup,
    fill_middle,
    line_dedup,
    near_dedup,
    packing,
    pii,
    quality,
    secret_scan,
    sharding,
    token_alignment,
    toxicity,
    warc,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listed(spans: str, keep=None) -> Column:
    """``kind:start:end`` of spans, joined by commas in their order."""
    chosen = F.filter(spans, keep) if keep else F.col(spans)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def hex_sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def how_many(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(how_many("secrets", kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        hex_sha256(listed("secrets", lambda s: s.kind.isin("assign", "access", "hex"))).alias("base_sha256"),
        listed("secrets").alias("spans"),
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, back="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        hex_sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = exact_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("deleted").cast("long").alias("n_deleted"),
        F.array_join(F.col("deleted").cast("array<string>"), ",").alias("deleted"),
        hex_sha256(F.coalesce("text", F.lit(""))).alias("clean_sha256"),
    )


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("digest")


def op7_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def packed(docs: DataFrame) -> DataFrame:
    """The pieces of all documents with their slots and a checksum in place of the ids."""
    encoded = packing.token_ids(docs, public_tokenizers.path("word_bpe_49k.json"))
    cut = packing.pieces(encoded).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(cut)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op9_semi_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(how_many("personal", kind).alias(f"n_{kind}") for kind in pii.BASE),
        hex_sha256(listed("personal", lambda s: s.kind.isin(*pii.BASE))).alias("base_sha256"),
        listed("personal").alias("spans"),
    )


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.read_archive(spark, warc.write_archive(pages), pages)


OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment.link_statistics(table(spark, sf_dir, "documents"), *paths, public_tokenizers.PATTERN)


def op12_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        hex_sha256(F.col("output")).alias("output_sha256"),
        hex_sha256(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::varchar, '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units,
  ('0x' || h[1:8])::bigint AS h1, ('0x' || h[9:16])::bigint AS h2, ('0x' || h[17:24])::bigint AS h3, ('0x' || h[25:32])::bigint AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
       WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
  array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
         ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_kd_sharding": op4_kd_sharding,
    "op5_line_winnowing": op5_line_winnowing,
    "op6_order_minhash": op6_order_minhash,
    "op7_quality_outliers": op7_quality_outliers,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_semi_crf_pii": op9_semi_crf_pii,
    "op10_warc_index": op10_warc_index,
    "op11_token_alignment": op11_token_alignment,
    "op12_toxicity_trees": op12_toxicity_trees,
    "op13_fill_middle": op13_fill_middle,
}

SQL = {"op3_exact_dedup": OP3_SQL, "op10_warc_index": OP10_SQL, "op13_fill_middle": OP13_SQL}
