"""The queries of this package, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression_bands, cotraining, decontamination, hpylm, jaccard_join, language_id, license_scan, packing, secret_scan, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def tokenizer() -> tuple[str, str, str]:
    """Paths of the public vocabulary (both readings) and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"), _fold(4) == 2)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands.compression_rules(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.records(warc.round_trip(_table(spark, sf_dir, "pages"), with_data=False)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), *tokenizer())


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(_table(spark, sf_dir, "documents"), _fold(10) == 0)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_quality_classifier, op3_compression_bands, op4_warc, op5_packing, op6_decontamination,
        op7_license_scan, op8_jaccard_join, op9_lm_scoring, op10_secret_scan, pipeline,
    )
}

#: The words that each mask takes, and its length: for items of ten words or more, and for those of five to nine.
_SEEDS = (((0, 1, 3, 4, 7, 8, 9), 10), ((0, 1, 2, 5, 7, 8, 9), 10), ((0, 1, 2, 3), 4), ((0, 1, 3, 4), 5), ((0, 2, 3, 4), 5), ((0, 1, 2, 4), 5))


def _seed(name: str, at: str, taken: tuple[int, ...]) -> str:
    return "concat_ws(' ', " + ", ".join(f"{name}[{at} + {k + 1}]" for k in taken) + ")"


def _decontamination_sql() -> str:
    """The same definition over word strings: spaced seeds, then a stretch of 13 words, 80 percent equal; an item of
    fewer than five words must be the whole document."""
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

    def seeds(table: str, key: str, whose: tuple[str, str]) -> str:
        made = [f"select {key}, w, pos, {m} as mask, {_seed('w', 'pos', taken)} as seed from (select {key}, w, unnest(range(0, len(w) - {span - 1})) as pos from {table} where len(w) >= {span} and {whose[m > 1]})" for m, (taken, span) in enumerate(_SEEDS)]
        return " union all ".join(made)

    return f"""
with d as (select doc_id, {words} as w from documents where doc_id is not null),
b as (select item_id, {words} as w from benchmark where item_id is not null),
ds as ({seeds("d", "doc_id", ("true", "exists (select 1 from b where len(b.w) between 5 and 9)"))}), bs as ({seeds("b", "item_id", ("true", "len(w) between 5 and 9"))}),
met as (select ds.doc_id, bs.item_id, ds.pos as da, bs.pos as ba, ds.w as dw, bs.w as bw, greatest(0, least(bs.pos - 2, len(bs.w) - 13)) as f
  from ds join bs on ds.mask = bs.mask and ds.seed = bs.seed),
cmp as (select doc_id, item_id, least(13, len(bw) - f) as n,
  len(list_filter(range(0, least(13, len(bw) - f)), lambda i: da - ba + f + i >= 0 and dw[da - ba + f + i + 1] = bw[f + i + 1])) as eq from met),
hit as (select doc_id, count(distinct item_id) as n from (select doc_id, item_id from cmp where eq * 100 >= 80 * n
  union all select doc_id, item_id from d join b on d.w = b.w and len(b.w) between 1 and 4) group by doc_id)
select doc_id, hit.n is not null as contaminated, coalesce(hit.n, 0)::bigint as n_items from documents left join hit using (doc_id)
"""


_JACCARD_SQL = r"""
with recursive w as materialized (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as materialized (select distinct doc_id, sh from (select doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as sh from w)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by all),
links as materialized (select x, y from pairs join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
reach(x, y) as (select doc_id, doc_id from n union select r.x, l.y from reach r join links l on l.x = r.y)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(r.c, w.doc_id)::bigint as component_id, coalesce(l.k, 0)::bigint as n_links
from w left join n using (doc_id) left join (select x, min(y) as c from reach group by x) r on r.x = w.doc_id left join (select x, count(*) as k from links group by x) l on l.x = w.doc_id
"""

ORACLE_SQL = {"op6_decontamination": _decontamination_sql(), "op8_jaccard_join": _JACCARD_SQL}
