"""The registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, exact_dedup, html_text, license_scan, line_dedup, packing, quality, sharding, simhash, spotsigs


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_bpe_prefix_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir))


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.against_edits(_documents(spark, sf_dir))


def op4_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_documents(spark, sf_dir))


OP4_SQL = """
with row as (
  select doc_id, strlen(coalesce(text, ''))::bigint as n_bytes,
         lpad(bin(('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint), 60, '0') as bits
  from documents
), node as (
  select doc_id, n_bytes, d::int as depth, substr(bits, 1, d) as shard,
         sum(n_bytes) over (partition by d, substr(bits, 1, d))::bigint as shard_bytes,
         count(*) over (partition by d, substr(bits, 1, d)) as shard_docs
  from row, range(0, 61) r(d)
)
select doc_id, n_bytes, shard, depth, shard_bytes, shard_docs, shard_bytes > 1048576 as oversize
from node
where shard_bytes <= 1048576 or shard_docs = 1
qualify row_number() over (partition by doc_id order by depth) = 1
"""


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op6_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir))


def op8_chunk_recipe_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_documents(spark, sf_dir))


OP8_SQL = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents
)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by norm) as group_size,
       first_value(doc_id) over w = doc_id as kept,
       sha256(norm) as text_sha256
from t window w as (partition by norm order by n desc, doc_id rows between unbounded preceding and unbounded following)
"""


def op9_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.duplicates(_documents(spark, sf_dir))


OP9_SQL = r"""
with row as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as raw,
         unnest(range(len(string_split(coalesce(text, ''), chr(10)))))::int as line_no
  from documents
), line as (
  select doc_id, line_no, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as line from row
), class as (
  select line, min({'d': doc_id, 'l': line_no}) as first, count(*) as n, length(line) as m,
         least(2, length(line) // 10) as t
  from line where line != '' group by line
), link as (
  select a.line as x, a.first as fx, b.line as y, b.first as fy
  from class a join class b on b.m between a.m and a.m + 2 and a.t >= 1 and a.line != b.line and (a.m < b.m or a.line < b.line)
  where (contains(b.line, substr(a.line, 1, (a.m // 3)::bigint)) or contains(b.line, substr(a.line, (a.m // 3 + 1)::bigint, (a.m // 3)::bigint))
         or contains(b.line, substr(a.line, (2 * (a.m // 3) + 1)::bigint, (a.m // 3)::bigint)))
    and levenshtein(a.line, b.line) <= a.t
), ends as (
  select x, fx, fy from link union all select y, fy, fx from link
), linked as (
  select x, count(*) as n_links, bool_or(fy < fx) as late from ends group by x
)
select line.doc_id, line.line_no, first.d as class_id, first.l as class_line, coalesce(n, 0) as n_copies, coalesce(n_links, 0) as n_links,
       line.line = '' or (not coalesce(late, false) and first.d = doc_id and first.l = line_no) as kept
from line left join class on class.line = line.line left join linked on linked.x = line.line
"""


def op10_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


QUERIES = {
    "op1_co_training": op1_co_training,
    "op2_bpe_prefix_tables": op2_bpe_prefix_tables,
    "op3_spotsigs": op3_spotsigs,
    "op4_extendible_hashing": op4_extendible_hashing,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_tree_scoring": op6_tree_scoring,
    "op7_license_windows": op7_license_windows,
    "op8_chunk_recipe_dedup": op8_chunk_recipe_dedup,
    "op9_line_edit_join": op9_line_edit_join,
    "op10_simhash_pivots": op10_simhash_pivots,
}
ORACLES = {
    "op4_extendible_hashing": OP4_SQL,
    "op7_license_windows": license_scan.scan_sql(),
    "op8_chunk_recipe_dedup": OP8_SQL,
    "op9_line_edit_join": OP9_SQL,
}
