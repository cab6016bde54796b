"""The dealt queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontam, langid, lbl, neardup, packing, pii, quality, simhash, spelling, toxicity, urlfilter, warc

#: Rules of the url query.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Stands for a secret that a deployment would supply.
PII_KEY = "marlstone-surrogates"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def block_list(pages: DataFrame) -> DataFrame:
    """Stands for a supplied list: three of sixteen of the folders that pages lie in, by MD5, and a key a page that no page has."""
    host, path = urlfilter.host_of(F.col("url")), urlfilter.path_of(F.col("url"))
    folders = pages.select(F.concat(host, F.regexp_extract(path, "(?s)^(/.*/|/)", 1)).alias("key")).where("key rlike '^[^/]+/'").where(F.substring(F.md5("key"), 1, 1).isin("0", "1", "2"))
    return folders.union(pages.select(F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".listed.example.com/")))).distinct()


def op5_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judge(pages, RULES, block_list(pages))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_lbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.score(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, counts=True)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_langid, op2_warc, op3_neardup, op4_decontam, op5_urlfilter, op6_toxicity, op7_lbl, op8_packing, op9_quality, op10_pii, op11_simhash, op12_spelling, op13_alignment, pipeline)}

ORACLE_SQL = {
    "op2_warc": """
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
        f as (select d, min(page_id) as first from p where n >= 100 group by d)
        select p.page_id, n as payload_bytes, p.d as payload_digest,
               case when f.first is null or f.first = p.page_id then 'response' else 'revisit' end as record_type,
               case when f.first <> p.page_id then f.first end as refers_to
        from p left join f on p.d = f.d and p.n >= 100""",
    "op4_decontam": r"""
        with dw as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
        bw as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
        bg as (select distinct item_id, len(w) as whole, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as g
               from bw, unnest(range(1, greatest(len(w) - 8, 2))) as t(i) where len(w) > 0),
        sizes as (select distinct n from bg),
        dg as (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as g from dw, sizes, unnest(range(1, len(w) - n + 2)) as t(i) where len(w) >= n),
        hits as (select dg.doc_id, dg.i, dg.n, bg.item_id from dg join bg on dg.g = bg.g and dg.n = bg.n),
        words as (select doc_id, count(distinct p) as n_hit from hits, unnest(range(i, i + n)) as t(p) group by doc_id),
        items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as s from hits group by doc_id)
        select dw.doc_id, cast(len(dw.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from dw left join words using (doc_id) left join items using (doc_id)""",
    "op5_urlfilter": r"""
        with u as (select page_id,
                     translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                     coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
        rules(rule, h, p, v) as (values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
        folders as (select distinct host, regexp_extract(path, '(?s)^(/.*/|/)', 1) as p from u where host <> '' and starts_with(path, '/')),
        listed(h, p) as (select host, p from folders where substr(md5(host || p), 1, 1) in ('0', '1', '2') union all select 'page-' || page_id || '.listed.example.com', '/' from pages),
        r as (select u.*, (select rule from rules where (u.host = h or ends_with(u.host, '.' || h)) and starts_with(u.path, p) order by length(rule) desc limit 1) as rule from u)
        select page_id, host, path, r.rule,
               coalesce((select v from rules x where x.rule = r.rule),
                        case when exists (select 1 from listed where (r.host = h or ends_with(r.host, '.' || h)) and starts_with(r.path, p)) then 'block' else 'allow' end) as verdict
        from r""",
}
