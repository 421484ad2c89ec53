"""Queries of what must hold for operators' results, each with SQL, where SQL can't express the results themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, minhash, packing, simple8b
from .common import table


def op3_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tokens, faults): the tokens that each document's pieces cover, and its pieces that lie in a bin that is over-full, has a gap or overlap, or holds a source twice."""
    pieces = packing.op3_bestfit_pack(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    bins = pieces.groupBy("shard", "bin").agg(F.sum("length").alias("total"), F.max(F.col("bin_offset") + F.col("length")).alias("end"), F.count("source").alias("some"), F.countDistinct("source").alias("kinds"))
    fault = (F.col("total") > packing.CAPACITY) | (F.col("total") != F.col("end")) | (F.col("some") != F.col("kinds"))
    return pieces.join(bins, ["shard", "bin"]).groupBy("doc_id").agg(F.sum("length").alias("tokens"), F.count_if(fault).alias("faults"))


OP3_COVERAGE_SQL = rf"""
WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '{packing.TOKEN}')) AS tokens FROM documents)
SELECT doc_id, tokens::BIGINT AS tokens, 0::BIGINT AS faults FROM t WHERE tokens > 0
"""


def op5_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text_md5, docs, groups): equal texts with a word in them all lie in one group."""
    texts = table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"[\p{L}\p{N}]")).select("doc_id", F.md5("text").alias("text_md5"))
    return texts.join(minhash.op5_minhash_dedup(spark, sf_dir), "doc_id").groupBy("text_md5").agg(F.count("*").alias("docs"), F.countDistinct("group_id").alias("groups"))


OP5_COPIES_SQL = r"SELECT md5(text) AS text_md5, count(*) AS docs, 1::BIGINT AS groups FROM documents WHERE regexp_matches(text, '[\p{L}\p{N}]') GROUP BY 1"


def op6_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_suppkey, n, blocks, ids_md5): the parts that each supplier shipped, coded and decoded, in how many blocks, and a digest of what came back."""
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    lists = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["l_partkey"]).alias("ids"))
    coded = lists.select("l_suppkey", simple8b.coder()("ids").alias("p")).select("l_suppkey", F.col("p.n").alias("n"), F.col("p.words").alias("words"), F.col("p.offsets").alias("offsets"))
    back = F.array_join(F.transform(simple8b.unpacker()("n", "words", "offsets"), lambda x: x.cast("string")), ",")
    return coded.select("l_suppkey", "n", F.size("offsets").alias("blocks"), F.md5(back).alias("ids_md5"))


OP6_INTEGERS_SQL = f"""
SELECT l_suppkey, count(*)::INTEGER AS n, ceil(count(*) / {simple8b.BLOCK})::INTEGER AS blocks,
  md5(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice)) AS ids_md5 FROM lineitem GROUP BY l_suppkey
"""


def op8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text_md5): of what each document's ids decode to."""
    return bpe.op8_bpe(spark, sf_dir).select("doc_id", F.md5("text").alias("text_md5"))


OP8_DECODED_SQL = "SELECT doc_id, md5(text) AS text_md5 FROM documents"


def op10_g711(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, codec, n_samples, pcm_md5) of the mu-law and A-law rows, expanded but not resampled."""
    media = audio.page_audio(spark, sf_dir).filter(F.col("codec") != "ima")
    got = audio.decode_audio(media, audio.SOURCE, audio.SOURCE, id_col="page_id")
    return got.select("page_id", "codec", "n_samples", F.md5("pcm").alias("pcm_md5"))


OP10_G711_SQL = """
WITH m AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'ulaw' ELSE 'alaw' END AS codec, regexp_extract_all(hex(encode(html)), '..') AS h FROM pages WHERE page_id % 3 <> 2),
x AS (SELECT page_id, codec, unnest(h) AS two, generate_subscripts(h, 1) AS i FROM m),
b AS (SELECT page_id, codec, i, CASE codec WHEN 'ulaw' THEN 255 - ('0x' || two)::INTEGER ELSE xor(('0x' || two)::INTEGER, 85) END AS c FROM x),
s AS (SELECT page_id, codec, i, CASE codec
  WHEN 'ulaw' THEN (CASE WHEN c & 128 > 0 THEN -1 ELSE 1 END) * ((((c & 15) * 8 + 132) << ((c >> 4) & 7)) - 132)
  ELSE (CASE WHEN c & 128 > 0 THEN 1 ELSE -1 END) * (CASE WHEN (c >> 4) & 7 = 0 THEN (c & 15) * 16 + 8 ELSE ((c & 15) * 16 + 264) << (((c >> 4) & 7) - 1) END) END AS v FROM b)
SELECT page_id, codec, count(*) AS n_samples, md5(unhex(string_agg(printf('%02x%02x', (v + 65536) % 256, ((v + 65536) // 256) % 256), '' ORDER BY i))) AS pcm_md5 FROM s GROUP BY page_id, codec
"""

QUERIES = {f.__name__: f for f in (op3_coverage, op5_copies, op6_integers, op8_decoded, op10_g711)}
ORACLES = {"op3_coverage": OP3_COVERAGE_SQL, "op5_copies": OP5_COPIES_SQL, "op6_integers": OP6_INTEGERS_SQL, "op8_decoded": OP8_DECODED_SQL, "op10_g711": OP10_G711_SQL}
