"""The operators over the tables of a data folder, as queries, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesselon.llm import chat, store, trie


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    store.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselon.llm import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~langid.held_out())
    return langid.predict(docs, model).withColumn("held_out", langid.held_out()).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselon.llm import pii

    return pii.detect(table(spark, sf_dir, "documents"))


def op9_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselon.llm import wordbpe

    return wordbpe.encode_all(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), digests=True)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselon.llm import media

    return media.store_and_read(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselon.llm import chat, store

    return chat.rotate(table(spark, sf_dir, "conversations"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselon.llm import topk

    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselon.llm import htmltext

    return htmltext.extract(table(spark, sf_dir, "pages"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselon.llm import warc

    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselon.llm import minhash

    return minhash.groups(table(spark, sf_dir, "documents"), width=4, similar=80)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselon.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselon.llm import simhash

    return simhash.groups(table(spark, sf_dir, "documents"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselon.llm import align

    return align.summary(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefixes(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_chat": op2_chat,
    "op3_topk": op3_topk,
    "op4_main_text": op4_main_text,
    "op5_warc": op5_warc,
    "op6_minhash": op6_minhash,
    "op7_packing": op7_packing,
    "op8_langid": op8_langid,
    "op9_word_bpe": op9_word_bpe,
    "op10_pii": op10_pii,
    "op11_simhash": op11_simhash,
    "op12_align": op12_align,
    "op13_trie": op13_trie,
}

#: Queries that SQL can express.
ORACLES: dict[str, str] = {
    "op2_chat": chat.SQL,
    "op13_trie": trie.SQL,
    "op5_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT payload_digest AS g, max(page_id) AS m FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN m > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m > page_id THEN m END AS refers_to
FROM d LEFT JOIN m ON g = payload_digest AND payload_bytes >= 1000""",
    "op3_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x : CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda p : p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 20""",
}
