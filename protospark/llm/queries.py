"""Queries of this subpackage for the driver, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embeddings, langid, licenses, mixing, packing, quality, sharding, simhash, tokenbin
from .common import cut, new_path, spread, word_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mixing.mix(sized).select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s),
c AS (SELECT *, source_size * 3 AS cap, (source_size * 3)::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER o, 0)::DOUBLE) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0))::DOUBLE AS lev
      FROM c WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN z IS NULL OR ratio < z THEN cap::DOUBLE ELSE weight * z END AS target,
             CASE WHEN z IS NULL OR ratio < z THEN 3.0::DOUBLE WHEN source_size > 0 THEN weight * z / source_size ELSE 0 END AS rate
      FROM l, (SELECT arg_min(lev, ratio) AS z FROM l WHERE lev <= ratio)),
r AS (SELECT d.*, t.source_size, t.target, t.rate, ('0x' || substr(md5('7|' || coalesce('s' || d.source, 'n')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u,
             row_number() OVER (PARTITION BY d.source ORDER BY h >= '8', CASE WHEN h >= '8' THEN -class ELSE class END, h, size) - 1 AS k
      FROM (SELECT *, CASE WHEN size < 8 THEN size ELSE length(bin(size)) * 8 + (size >> (length(bin(size)) - 4)) - 8 END AS class FROM d) d
      JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, CAST((floor(rate * (k + 1) + u) - floor(rate * k + u)) AS BIGINT) AS copies FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM x
"""


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    # quarters of a power of two
    bits = F.length(F.bin("size"))
    quarter = bits * 4 + F.expr("shiftright(size, cast(length(bin(size)) as int) - 3)") - 4
    coded = sharding.codes(cut(docs), [F.col("source"), F.col("lang"), quarter])
    out = sharding.shard(coded, [F.col("code0"), F.col("code1"), F.col("code2")], 24, group="text_hash")
    return out.select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    found = spread(docs.select("doc_id", "text")).select("doc_id", quality.judge(model, F.col("text")).alias("q"))
    return found.select("doc_id", *[f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")])


def held_out(key: str = "doc_id"):
    """Whether the key's remainder is 2; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out()))
    found = spread(docs.select("doc_id", "text")).select("doc_id", held_out().alias("held_out"), langid.identify(model, F.col("text")).alias("l"))
    return found.select("doc_id", "held_out", F.col("l.lang").alias("lang_pred"), "l.score", "l.cosine", "l.rejected")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_tokenbin(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark)
    tokenbin.write(table(spark, sf_dir, "documents"), out, tokenizer_path())
    return tokenbin.checksums(spark, out).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.col("crc").alias("ids_crc32"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("key").eqNullSafe(F.col("component")).alias("kept"))


OP2_SQL = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
g AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e WHERE label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
h AS (SELECT vec_id, label, list_transform(v, lambda x: x / n) AS u FROM g WHERE n > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM h a JOIN h b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.u, b.u) >= 0.93),
c AS (WITH RECURSIVE r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a) SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.a = vec_id
"""


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit(chat.END + chat.START + "assistant ok")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(own)
    return chat.digest(cut(chat.windows(talks))).withColumnRenamed("conv", "conv_id")


OP7_SQL = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS n FROM t),
c AS (SELECT conv_id, role, text, k, n + length(role) + 24 AS chars, (n + 3) // 4 + 5 AS cost, k = 1 AND role = 'system' AND (n + 3) // 4 + 5 <= 512 AS head FROM n),
h AS (SELECT *, max(CASE WHEN head THEN cost ELSE 0 END) OVER w AS hcost, max(CASE WHEN head THEN chars ELSE 0 END) OVER w AS hchars FROM c WINDOW w AS (PARTITION BY conv_id)),
l AS (SELECT *, CASE WHEN NOT lag(head, 1) OVER w THEN lag(cost, 1) OVER w END AS c1, CASE WHEN NOT lag(head, 2) OVER w THEN lag(cost, 2) OVER w END AS c2,
             CASE WHEN NOT lag(head, 3) OVER w THEN lag(cost, 3) OVER w END AS c3, CASE WHEN NOT lag(head, 4) OVER w THEN lag(cost, 4) OVER w END AS c4,
             lag(chars, 1) OVER w AS s1, lag(chars, 2) OVER w AS s2, lag(chars, 3) OVER w AS s3, lag(chars, 4) OVER w AS s4, least(256, 1024 - hcost - cost) AS most
      FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
a AS (SELECT *, CASE WHEN c1 + c2 + c3 + c4 <= most THEN 4 WHEN c1 + c2 + c3 <= most THEN 3 WHEN c1 + c2 <= most THEN 2 WHEN c1 <= most THEN 1 ELSE 0 END AS r FROM l),
g AS (SELECT conv_id, k, cost, chars, head, hcost, hchars, CASE r WHEN 0 THEN 0 WHEN 1 THEN c1 WHEN 2 THEN c1 + c2 WHEN 3 THEN c1 + c2 + c3 ELSE c1 + c2 + c3 + c4 END AS again,
             CASE r WHEN 0 THEN 0 WHEN 1 THEN s1 WHEN 2 THEN s1 + s2 WHEN 3 THEN s1 + s2 + s3 ELSE s1 + s2 + s3 + s4 END AS repeated FROM a),
f AS (SELECT conv_id, min(k) AS k FROM g WHERE NOT head GROUP BY conv_id),
w AS (SELECT g.conv_id, g.k, 1024 - hcost - cost AS room, 1 AS win, CAST(chars + hchars AS BIGINT) AS chars FROM g JOIN f ON g.conv_id IS NOT DISTINCT FROM f.conv_id AND g.k = f.k
      UNION ALL SELECT g.conv_id, g.k, CASE WHEN g.cost > w.room THEN 1024 - g.hcost - g.again ELSE w.room END - g.cost, CASE WHEN g.cost > w.room THEN w.win + 1 ELSE w.win END,
             g.chars + CASE WHEN g.cost > w.room THEN g.hchars + g.repeated ELSE 0 END FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.k = w.k + 1),
o AS (SELECT conv_id, sum(chars) AS chars FROM w GROUP BY conv_id)
SELECT CAST(c.conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(coalesce(any_value(o.chars), sum(c.chars)) AS BIGINT) AS formatted_chars
FROM c LEFT JOIN o ON c.conv_id IS NOT DISTINCT FROM o.conv_id GROUP BY c.conv_id
"""


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", licenses.licenses(F.col("text")).alias("spans"))
    return found.select("doc_id", F.size("spans").cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct("spans.license")), ";").alias("licenses"), "spans")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (word_count(F.col("text")) + 1).alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("cluster"))
    return packing.pack(cut(docs), F.col("size"), F.col("source"), F.col("cluster")).withColumnRenamed("key", "doc_id")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_embeddings": op2_embeddings,
    "op3_tokenbin": op3_tokenbin,
    "op4_quality": op4_quality,
    "op5_sharding": op5_sharding,
    "op6_simhash": op6_simhash,
    "op7_chat": op7_chat,
    "op8_licenses": op8_licenses,
    "op9_packing": op9_packing,
    "op10_langid": op10_langid,
}
ORACLES = {"op1_mixing": OP1_SQL, "op2_embeddings": OP2_SQL, "op7_chat": OP7_SQL}
