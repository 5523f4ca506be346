"""The queries of this subpackage, by name: each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.llm import fingerprint, graph, language, lines, lm, mixing, neardup, packing, sharding, toxicity
from segloom.llm.tables import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language.in_fold(F.col("doc_id"), 4, 2)
    known = language.prototypes(docs.where(~held_out))
    return language.identify(docs.select("doc_id", "text"), *known).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.near_classes(fingerprint.compared_with_next(table(spark, sf_dir, "documents")))


def op4_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = language.in_fold(F.col("doc_id"), 3, 1)
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, packing.special_tokens(public_tokenizers.path("byte_bpe_50k.json")))


def op7_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), language.in_fold(F.col("doc_id"), 10, 0))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs).select("doc_id", "source", "mix_size", "mix_source_size", "mix_target", "mix_copies")
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.col("mix_copies").alias("copies"))


def op10_robust_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_minmax_near_dedup, op3_simhash_fingerprints, op4_fuzzy_line_dedup, op5_toxicity, op6_best_fit_packing, op7_ppm_scoring, op8_sharding, op9_mixing, op10_robust_graph_search)}
#: Checksums byte by byte over the table that eight shifts make of each byte.
SHARDING_SQL = """with crcs as (select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as crc from (select unnest(range(256)) as i)),
texts as (select doc_id, coalesce(text, '') as text from documents),
parts as (select doc_id, strlen(text) + 8 as size, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: cast('0x' || x as bigint)) as bytes from texts),
sized as (select doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32 from parts, crcs),
placed as (select *, sum(size) over (order by doc_id nulls first, size, text_crc32 rows unbounded preceding) as upto, sum(size) over () as every, row_number() over (order by doc_id nulls first, size, text_crc32) as place from sized),
cut as (select *, cast((2 * upto - size) * 24 // (2 * every) as integer) as shard from placed)
select doc_id, size, text_crc32, 'bytes' as law, shard, place - min(place) over (partition by shard) as slot, cast(null as integer) as grown_shard from cut"""

#: All pairs that share a shingle, compared on their whole sets, and what they reach.
NEAR_DEDUP_SQL = """with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
shingles as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as both_ from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * both_ >= 75 * (x.n + y.n - both_)),
edges as (select a, b from links union all select b, a from links),
reached(node, other) as (select doc_id, doc_id from words union select r.node, e.b from reached r join edges e on e.a = r.other)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from words left join sizes using (doc_id) join (select node as doc_id, min(other) as component_id from reached group by node) using (doc_id)"""

ORACLES: dict[str, str] = {"op2_minmax_near_dedup": NEAR_DEDUP_SQL, "op8_sharding": SHARDING_SQL}
