"""The registered queries of this subpackage: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, divergence, html_text, language, lexical, line_dedup, mixing, near_dedup, packing, quality, sharding, token_records
from .common import table


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), keep_text=False)


def op5_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_records.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("text_hash")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op10_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op11_wide_term_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_cost")


def op13_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_hilbert_shards,
        op2_compression_quality,
        op3_circulant_minhash,
        op4_line_dedup,
        op5_language_gru,
        op6_token_records,
        op7_hierarchical_mix,
        op8_decontaminate,
        op9_host_paths,
        op10_multi_index_hashing,
        op11_wide_term_vectors,
        op12_cost_balanced_packing,
        op13_block_max_wand,
    )
}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_LINES_SQL = f"""
with numbered as (select doc_id, coalesce(doc_id, 9223372036854775807) as id, string_split(coalesce(text, ''), chr(10)) as lines, row_number() over () as rid from documents),
cut as (select rid, doc_id, id, unnest(lines) as line, unnest(range(len(lines))) as pos from numbered),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_LOWER}) as key from cut),
owners as (select key, min(id) as owner from keyed where length(key) >= {line_dedup.MIN_CHARS} group by key),
marked as (select k.*, coalesce(owner <> id, false) as gone from keyed k left join owners using (key))
select doc_id, count(*) as n_lines, cast(count_if(gone) as bigint) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256 from marked group by rid, doc_id"""

_WINDOWS_SQL = f"""
with iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
wins as (select distinct item_id, list_slice(w, i, i + least({decontaminate.SIZE}, len(w)) - 1) as win from (select *, unnest(range(1, len(w) - least({decontaminate.SIZE}, len(w)) + 2)) as i from iw where len(w) > 0) x),
dw as (select doc_id, row_number() over () as rid, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
places as (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, (select distinct len(win) as n from wins) l where len(w) >= n),
met as (select rid, i, n, item_id from (select rid, i, n, list_slice(w, i, i + n - 1) as win from places) p join wins using (win)),
hit as (select rid, count(distinct place) as n_hit from (select rid, unnest(range(i, i + n)) as place from (select distinct rid, i, n from met) m) x group by rid),
named as (select rid, count(*) as n_items, string_agg(name, ',' order by name) as names from (select distinct rid, cast(item_id as varchar) as name from met where item_id is not null) x group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join hit using (rid) left join named using (rid)"""

_NEAR_SQL = f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x20\\x09-\\x0D]+') as w from documents),
sh as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d),
n as (select doc_id, count(*) as n from sh group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b using (s) where a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= {near_dedup.THRESHOLD} * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id as node, doc_id as root from documents union select b, root from reach join both_ways on node = a),
named as (select node as doc_id, min(root) as component_id from reach group by node)
select doc_id, coalesce(n, 0) as n_shingles, component_id, component_id = doc_id as kept from named left join n using (doc_id)"""

ORACLE_SQL: dict[str, str] = {"op1_hilbert_shards": sharding.oracle_sql(), "op3_circulant_minhash": _NEAR_SQL, "op4_line_dedup": _LINES_SQL, "op7_hierarchical_mix": mixing.oracle_sql(), "op8_decontaminate": _WINDOWS_SQL, "op11_wide_term_vectors": divergence.oracle_sql(), "op13_block_max_wand": lexical.oracle_sql()}
