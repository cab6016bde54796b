"""Named queries over the driver's tables, one an operator, with equivalent SQL.

documents stand for files (``source/doc_id.txt``; source is the author, lang the type), pages for HTML files, benchmark
for queries, embeddings for the vector store (a vector's id is its document's), events for a log of changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions.vectors import cosine_distance, distance_score
from marlstone.operators import bm25, chunk, fuse, metadata, tables, vector
from marlstone.plans.retriever import Retriever, ranked
from marlstone.sources import extract, scan

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def note(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def files(spark: SparkSession, d: str, *more: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.col("source").alias("doc_author"), F.col("lang").alias("doc_type"), F.lit("txt").alias("file_type"), *more)


FILES = "(select concat(source, '/', doc_id, '.txt') as file_path, source as doc_author, lang as doc_type, 'txt' as file_type, doc_id, text, n_chars from documents)"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

# ---- scans


@query("""select url, case when regexp_matches(b, '^\\.*[^.].*\\.[^.]*$') then lower(regexp_extract(b, '^\\.*[^.].*\\.([^.]*)$', 1))
                    when regexp_matches(b, '^\\..') then lower(substr(b, 2)) else '' end as extension
           from (select url, list_last(string_split(url, '/')) as b from pages)""")
def file_extension(spark, d):
    return table(spark, d, "pages").select("url", X.file_extension(F.col("url")).alias("extension"))


@query("""with p as (select concat('docs/', source, '/', case doc_id % 7 when 0 then '.hidden/' when 1 then 'node_modules/' else '' end, doc_id,
                     case doc_id % 5 when 0 then '.txt' when 1 then '.PDF' when 2 then '.tmp' when 3 then '.exe' else '~' end) as file_path, n_chars from documents)
           select file_path, n_chars as length from p
           where doc_ok(file_path) and not regexp_matches(file_path, '(^|/)(\\.|node_modules)') """.replace("doc_ok(file_path)", "lower(regexp_extract(file_path, '\\.([^./]*)$', 1)) in ('hwp','hwpx','pdf','docx','pptx','xlsx','xls','csv','txt','md','html','htm','rtf','pages','numbers','key')"))
def scan_supported(spark, d):
    docs = table(spark, d, "documents")
    kind = F.col("doc_id") % 5
    folder = F.when(F.col("doc_id") % 7 == 0, ".hidden/").when(F.col("doc_id") % 7 == 1, "node_modules/").otherwise("")
    suffix = F.when(kind == 0, ".txt").when(kind == 1, ".PDF").when(kind == 2, ".tmp").when(kind == 3, ".exe").otherwise("~")
    found = docs.select(F.concat(F.lit("docs/"), "source", F.lit("/"), folder, F.col("doc_id").cast("string"), suffix).alias("file_path"), F.col("n_chars").alias("length"))
    return scan.select_files(found)


@query(r"""select page_id, regexp_matches(list_last(string_split(url, '/')), '^\..*|^~\$.*|.*~$|.*\.tmp$|.*__pycache__.*|.*\.git.*|.*node_modules.*|Thumbs\.db|desktop\.ini|^\d+#') as excluded from pages""")
def exclude_pattern(spark, d):
    return table(spark, d, "pages").select("page_id", scan.excluded(X.base_name(F.col("url")), (r"^\d+#", "(broken")).alias("excluded"))


@query("""select concat(source, '/', doc_id, '.txt') as file_path, n_chars as length from documents
           where not regexp_matches(concat(source, '/', doc_id, '.txt'), 'src1\\d/') and n_chars <= 104857600""")
def full_index_scan(spark, d):
    found = files(spark, d, F.col("n_chars").alias("length")).select("file_path", "length")
    return scan.select_files_full(found, (r"src1\d/",))


# ---- text


@query(r"select doc_id, cast(len(regexp_extract_all(text, '\S+')) as bigint) as n_tokens from documents")
def tokenize_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("select doc_id, case when length(text) > 500 then substr(text, 1, 500) || '...' else text end as preview, substr(text, 1, 200) || '...' as short from documents")
def preview(spark, d):
    return table(spark, d, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"), X.preview(F.col("text"), 200, True).alias("short"))


@query("""select concat_ws('-', count(*), sum(cast('0x' || substr(sha256(file_path), 1, 15) as hugeint)), sum(cast('0x' || substr(sha256(file_path), 16, 15) as hugeint))) as set_hash from """ + FILES)
def set_hash(spark, d):
    return files(spark, d).agg(X.set_hash(F.col("file_path")).alias("set_hash"))


@query("select sha256(string_agg(file_path, chr(10) order by file_path)) as ids_hash, count(*) as n from " + FILES)
def ids_hash(spark, d):
    return files(spark, d).agg(X.ids_hash(F.col("file_path")).alias("ids_hash"), F.count("*").alias("n"))


@query("select file_path, sha256(concat(file_path, ':', doc_id, '.5')) as content_hash from " + FILES)
def content_hash(spark, d):
    return files(spark, d, "doc_id").select("file_path", X.content_hash(F.col("file_path"), F.col("doc_id") + F.lit(0.5)).alias("content_hash"))


# ---- chunks

UNITS = rf"""
    paras as (select doc_id, unnest(l) as p, generate_subscripts(l, 1) as i from (select doc_id, string_split(text, chr(10) || chr(10)) as l from documents)),
    stripped as (select doc_id, i, {STRIP.format('p')} as p from paras where {STRIP.format('p')} <> ''),
    cut as (select doc_id, i, unnest(l) as u, generate_subscripts(l, 1) as j from (
        select doc_id, i, case when length(p) > 800 then list_filter(list_transform(regexp_extract_all(p, '[^.!?]*[.!?]|[^.!?]+$'), lambda s: regexp_replace({STRIP.format('s')}, '\s+([.!?])$', '\1')), lambda s: s <> '') else [p] end as l from stripped)),
    force(doc_id, i, j, k, piece, rest) as (
        select doc_id, i, j, 0, '', u from cut where length(u) > 800
        union all
        select doc_id, i, j, k + 1,
               case when length(rest) <= 800 then rest else {STRIP.format('substr(rest, 1, c)')} end,
               case when length(rest) <= 800 then '' else {STRIP.format('substr(rest, c + 1)')} end
        from (select *, case when strpos(reverse(substr(rest, 1, 800)), ' ') between 1 and 799 then 800 - strpos(reverse(substr(rest, 1, 800)), ' ') else 800 end as c from force where rest <> '')),
    units as (select doc_id, i, j, 0 as k, u, false as alone from cut where length(u) <= 800 union all select doc_id, i, j, k, piece, true from force where k > 0),
    lists as (select doc_id, list({{'out': []::varchar[], 'cur': '', 'u': u, 'alone': alone}} order by i, j, k) as l from units group by doc_id),
    folded as (select doc_id, list_reduce(list_prepend({{'out': []::varchar[], 'cur': '', 'u': '', 'alone': false}}, l), lambda a, b:
        case when b.alone then {{'out': a.out || (case when a.cur <> '' then [a.cur] else [] end) || [b.u], 'cur': '', 'u': '', 'alone': false}}
             when length(a.cur) + length(b.u) <= 800 then {{'out': a.out, 'cur': a.cur || b.u, 'u': '', 'alone': false}}
             else {{'out': a.out || (case when a.cur <> '' then [a.cur] else [] end), 'cur': b.u, 'u': '', 'alone': false}} end) as r from lists),
    packed as (select doc_id, r.out || (case when r.cur <> '' then [r.cur] else [] end) as c from folded),
    chunked as (select doc_id, unnest(list_transform(range(1, len(c) + 1), lambda k: {{'k': cast(k - 1 as int), 'n': cast(len(c) as int), 'plain': c[k], 'text': case when k > 1 then right(c[k - 1], 100) || c[k] else c[k] end}})) as x from packed)
"""


@query(f"with recursive {UNITS} select doc_id, x.k as chunk_index, x.plain as chunk from chunked")
def chunk_pack(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(chunk.chunks(F.col("text"), 800, 0)).alias("chunk_index", "chunk"))


@query(f"with recursive {UNITS} select doc_id, x.k as chunk_index, x.text as chunk, length(x.text) as n_chars from chunked")
def chunk_overlap(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(chunk.chunks(F.col("text"), 800, 100)).alias("chunk_index", "chunk")).withColumn("n_chars", F.length("chunk"))


@query(f"with recursive {UNITS} select concat(doc_id, '_', substr(sha256(f.file_path), 1, 12), '_', x.k) as chunk_id, f.file_path, x.k as chunk_index, x.n as total_chunks from chunked join {FILES} f using (doc_id)")
def chunk_ids(spark, d):
    return chunk.exploded(files(spark, d, "text"), F.col("file_path"), F.col("text")).select("chunk_id", "file_path", "chunk_index", "total_chunks")


@query(f"with recursive {UNITS} select d.doc_id, coalesce(len(c), 0) as n_chunks from documents d left join packed using (doc_id)")
def chunk_count_per_doc(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(chunk.chunks(F.col("text"))).cast("long").alias("n_chunks"))


@query(f"with recursive {UNITS} select doc_id, x.k as chunk_index, x.text as chunk from chunked")
def chunk_table_function(spark, d):
    chunk.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("marlstone_documents")
    return spark.sql("select doc_id, chunk_index, chunk from marlstone_documents, lateral chunk_text(text, 800, 100)")


@query(rf"""select doc_id, cast(len(l) as bigint) as n_sentences, coalesce(l[1], '') as first, coalesce(l[len(l)], '') as last from (
    select doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$'), lambda s: regexp_replace({STRIP.format('s')}, '\s+([.!?])$', '\1')), lambda s: s <> '') as l from documents)""")
def sentence_split(spark, d):
    made = table(spark, d, "documents").select("doc_id", chunk.sentence_array(F.col("text")).alias("s"))
    return made.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.coalesce(F.get("s", F.lit(0)), F.lit("")).alias("first"), F.coalesce(F.get("s", F.size("s") - 1), F.lit("")).alias("last"))


@query(rf"""select doc_id, cast(len(l) as bigint) as n_paragraphs, coalesce(l[len(l)], '') as last from (
    select doc_id, list_filter(list_transform(string_split(replace(text, chr(10), ' ' || chr(10) || chr(10)), chr(10) || chr(10)), lambda s: {STRIP.format('s')}), lambda s: s <> '') as l from documents)""")
def paragraph_split(spark, d):
    spaced = F.replace("text", F.lit("\n"), F.lit(" \n\n"))  # the documents have no empty lines
    made = table(spark, d, "documents").select("doc_id", chunk.paragraph_array(spaced).alias("p"))
    return made.select("doc_id", F.size("p").cast("long").alias("n_paragraphs"), F.coalesce(F.get("p", F.size("p") - 1), F.lit("")).alias("last"))


@query(rf"select doc_id, {STRIP.format('text')} <> '' as kept from documents where {STRIP.format('text')} <> ''")
def blank_chunk_filter(spark, d):
    return table(spark, d, "documents").where(chunk.not_blank(F.col("text"))).select("doc_id", F.lit(True).alias("kept"))


# ---- formats

HTML_SQL = r"""select page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(t, '[\n\r\x0B\x0C]|  '), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''), ' ') as text from (
    select page_id, replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?s)<[^>]*>', '', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&#39;', ''''), '&amp;', '&') as t from pages)"""


@query(HTML_SQL)
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", extract.html_text(F.col("html")).alias("text"))


@query(HTML_SQL)
def extract_html(spark, d):
    pages = table(spark, d, "pages").select("page_id", extract.extracted(F.encode("html", "utf-8"), F.lit("page.html")).alias("e"))
    return pages.select("page_id", F.col("e.text").alias("text"))


@query(r"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(r, '\\[a-z]+\d*\s?', '', 'g'), '\\[^a-z0-9\s]', '', 'g'), '[{}]', '', 'g'), '\s+', ' ', 'g')) as text
           from (select doc_id, concat('{\rtf1\ansi {\b ', source, '} \par ', text, ' \*\end}') as r from documents)""")
def rtf_strip(spark, d):
    made = F.concat(F.lit("{\\rtf1\\ansi {\\b "), "source", F.lit("} \\par "), "text", F.lit(" \\*\\end}"))
    return table(spark, d, "documents").select("doc_id", extract.rtf_text(made).alias("text"))


@query("select doc_id, concat('id: ', doc_id, ', lang: ', lang, ', source: ', source) as text, true as success from documents")
def csv_rows(spark, d):
    made = F.concat(F.lit("id,lang,source,none\n"), F.col("doc_id").cast("string"), F.lit(","), "lang", F.lit(","), "source", F.lit(",\n"))
    e = table(spark, d, "documents").select("doc_id", extract.extracted(F.encode(made, "utf-8"), F.lit("rows.csv")).alias("e"))
    return e.select("doc_id", F.col("e.text").alias("text"), F.col("e.success").alias("success"))


# ---- metadata


@query(rf"""select doc_id, coalesce(list_filter(list_transform(string_split(substr(text, 1, 1000), chr(10)), lambda s: {STRIP.format('s')}),
              lambda s: length(s) between 5 and 100 and not regexp_matches(lower(s), '보안|대외비|비밀|일반|confidential|internal'))[1], '') as title from documents""")
def title_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", metadata.title_of(F.substring("text", 1, 1000)).alias("title"))


@query("select o_orderkey, coalesce(strftime(try_strptime(case when o_orderkey % 9 = 0 then '2024-13-40' else strftime(o_orderdate, '%Y-%m-%d') end, '%Y-%m-%d'), '%Y-%m-%d'), '') as doc_date, concat('Clerk ', o_custkey) as author from orders")
def date_extract(spark, d):
    o = table(spark, d, "orders")
    stamp = F.when(F.col("o_orderkey") % 9 == 0, F.lit("2024-13-40")).when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy. M. d")).otherwise(F.date_format("o_orderdate", "yyyy년 MM월 dd일"))
    page = F.concat(F.lit("Order\n작성자 : Clerk "), F.col("o_custkey").cast("string"), F.lit("\n작성일: "), stamp, F.lit("\nend"))
    return o.select("o_orderkey", metadata.date_of(page).alias("doc_date"), metadata.author_of(page).alias("author"))


@query("select p_partkey, case when p_size % 4 = 0 then '계획서' when p_size % 4 = 1 then '회의록' when p_size % 4 = 2 then '가이드' else '' end as doc_type from part")
def doc_type_case(spark, d):
    k = F.col("p_size") % 4
    page = F.concat("p_name", F.when(k == 0, " 사업계획 계획서").when(k == 1, " 백서 회의록").when(k == 2, " 가이드").otherwise(" x"))
    return table(spark, d, "part").select("p_partkey", metadata.doc_type_of(page).alias("doc_type"))


@query("select c_custkey, case when c_custkey % 3 = 0 then c_name when c_custkey % 3 = 1 then c_mktsegment else '' end as author, c_name as title from customer")
def metadata_coalesce(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey") % 3
    props = F.create_map(F.lit(" Author "), F.when(k == 0, F.col("c_name")).otherwise(" "), F.lit("creator"), F.when(k == 1, F.col("c_mktsegment")).otherwise(""), F.lit("TITLE"), F.concat(F.col("c_name"), F.lit("  ")))
    return c.select("c_custkey", metadata.property_of(props, "doc_author").alias("author"), metadata.property_of(props, "doc_title").alias("title"))


@query(rf"""select doc_id, case when doc_id % 2 = 0 then source else coalesce(list_filter(list_transform(string_split(substr(text, 1, 1000), chr(10)), lambda s: {STRIP.format('s')}),
              lambda s: length(s) between 5 and 100 and not regexp_matches(lower(s), '보안|대외비|비밀|일반|confidential|internal'))[1], '') end as doc_title,
              case when doc_id % 3 = 0 then lang else '' end as doc_author, concat(doc_id, '.TXT') as file_name, 'TXT' as file_type, concat(source, '/', doc_id, '.TXT') as relative_path, n_chars as file_size, '1970-01-01 00:00:01' as fs_modified from documents""")
def metadata_precedence(spark, d):
    docs = table(spark, d, "documents")
    props = F.create_map(F.lit("title"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(""), F.lit("author"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(""))
    rows = docs.select("doc_id", F.concat(F.lit("/root/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".TXT")).alias("file_path"), F.col("text").alias("first_chunk"), props.alias("properties"), F.col("n_chars").alias("length"), F.lit(1.0).alias("mtime"))
    return metadata.file_metadata(rows, root="/root").select("doc_id", "doc_title", "doc_author", "file_name", "file_type", "relative_path", "file_size", "fs_modified")


@query("""select doc_id, case when doc_id % 4 = 0 then concat('[2024-01 | ', source, ' | ', lang, ' | ', doc_id, '.txt] ')
                 when doc_id % 4 = 1 then concat('[', source, ' | ', doc_id, '.txt] ')
                 when doc_id % 4 = 2 then concat('[', doc_id, '.txt] ') else concat('[2023-12 | ', substr(text, 1, 50), ' | ', doc_id, '.txt] ') end as prefix from documents""")
def context_prefix(spark, d):
    k = F.col("doc_id") % 4
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    title = F.when(k == 0, F.col("source")).when(k == 3, F.col("text")).otherwise("")
    made = metadata.context_prefix(title, F.when(k == 0, F.col("lang")).otherwise(""), F.when(k == 0, "2024-01-15").otherwise(""), F.when(k == 3, "2023-12-01 10:00:00").otherwise(""), name, F.when(k == 1, F.concat("source", F.lit("/"), name)).otherwise(name))
    return table(spark, d, "documents").select("doc_id", made.alias("prefix"))


# ---- keyword search

TOKENS = r"tok as (select doc_id, unnest(regexp_extract_all(text, '\S+')) as term from documents), dl as (select doc_id, cast(len(regexp_extract_all(text, '\S+')) as double) as dl from documents), tf as (select doc_id, term, cast(count(*) as double) as tf from tok group by all), df as (select term, count(*) as df from tf group by term), c as (select count(*) as n, avg(dl) as avgdl from dl)"


def _bm25_sql(queries: str, n: int, paper: bool = False) -> str:
    floor = "1.0" if paper else "0.0"
    tail = "select q, doc_id, round(score, 9) as score from s" if paper else "select d.q, d.doc_id, round(coalesce(score, 0) + base, 9) as score from (select b.q, b.base, documents.doc_id from b, documents) d left join s on s.q = d.q and s.doc_id = d.doc_id"
    return rf"""{TOKENS}, q as ({queries}), qt as (select q, unnest(regexp_extract_all(t, '\S+')) as term from q),
        w as (select q, term, count(*) * ln((n + 1.0) / df) as w from qt join df using (term), c group by q, term, n, df),
        b as (select q, sum(w) as base from w group by q),
        s as (select q, doc_id, sum(w * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) + {floor})) as score from w join tf using (term) join dl using (doc_id), c group by q, doc_id),
        ranked as (select *, row_number() over (partition by q order by score desc, doc_id) as rank from ({tail}) where score > 0),
        bm as (select q, doc_id, score, rank from ranked where rank <= {n})"""


FIRST = "select 0 as q, text as t from benchmark where item_id = (select min(item_id) from benchmark)"


def corpus(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def first_query(spark, d) -> DataFrame:
    """One row: the benchmark's first passage."""
    b = table(spark, d, "benchmark")
    return b.orderBy("item_id").limit(1).select(F.lit(0).alias("query_id"), "text")


@query(rf"with {TOKENS} select term, df, round(ln((n + 1.0) / df), 6) as idf from df, c")
def bm25_terms(spark, d):
    index = bm25.build(corpus(spark, d))
    return index.terms.select("term", "df", F.round(bm25.idf(F.col("df"), index.n), 6).alias("idf"))


@query(f"with {_bm25_sql(FIRST, 50)} select doc_id, round(score, 6) as score, cast(rank as int) as rank from bm")
def bm25_topk(spark, d):
    found = bm25.search(bm25.build(corpus(spark, d), queries=first_query(spark, d)), first_query(spark, d), 50)
    return found.select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"with {_bm25_sql(FIRST, 50, True)} select doc_id, round(score, 6) as score, cast(rank as int) as rank from bm")
def bm25_topk_paper(spark, d):
    found = bm25.search(bm25.build(corpus(spark, d), queries=first_query(spark, d)), first_query(spark, d), 50, "paper")
    return found.select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"with {_bm25_sql('select item_id as q, text as t from benchmark', 10)} select q as item_id, doc_id, round(score, 6) as score, cast(rank as int) as rank from bm")
def bm25_batch(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = bm25.search(bm25.build(corpus(spark, d), queries=asked), asked, 10)
    return found.select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"with {_bm25_sql(FIRST, 50)} select doc_id, round(score, 6) as score, cast(rank as int) as rank from bm")
def bm25_incremental_add(spark, d):
    docs, asked = corpus(spark, d), first_query(spark, d)
    old = bm25.build(docs.where("chunk_id % 3 <> 0"), queries=asked)
    found = bm25.search(bm25.add(old, docs.where("chunk_id % 3 = 0"), queries=asked), asked, 50)
    return found.select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


# ---- vector search

DISTANCE = "round(1.0 - list_cosine_similarity(cast(e.embedding as double[]), cast(x.embedding as double[])), 9)"
FIRST_VECTOR = "(select embedding from embeddings order by vec_id limit 1)"


def store(spark, d, how: str = "left") -> DataFrame:
    """The vectors with the texts and attributes of the documents of the same ids, where there are such; or all of both."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    f = files(spark, d, F.col("doc_id").alias("chunk_id"), "text")
    return e.join(f, "chunk_id", how)


def first_vector(spark, d) -> list:
    return table(spark, d, "embeddings").orderBy("vec_id").first()["embedding"]


@query(f"select e.vec_id, round({DISTANCE}, 6) as distance, round(greatest(0, 1 - {DISTANCE}), 6) as score from embeddings e, {FIRST_VECTOR} x order by {DISTANCE}, e.vec_id limit 50")
def vector_topk(spark, d):
    found = vector.top(table(spark, d, "embeddings"), first_vector(spark, d), 50, id_col="vec_id")
    return found.select("vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query(f"select e.vec_id, e.label, round({DISTANCE}, 6) as distance from embeddings e, {FIRST_VECTOR} x where label = 3 order by {DISTANCE}, e.vec_id limit 50")
def vector_topk_filtered(spark, d):
    found = vector.top(table(spark, d, "embeddings"), first_vector(spark, d), 50, F.col("label") == 3, ("label",), "vec_id")
    return found.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(f"""select query_id, vec_id, round(distance, 6) as distance, cast(rank as int) as rank from (
    select x.vec_id as query_id, e.vec_id, {DISTANCE} as distance, row_number() over (partition by x.vec_id order by {DISTANCE}, e.vec_id) as rank
    from embeddings e, embeddings x where x.vec_id % 100 = 0) where rank <= 10""")
def vector_batch(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.batch_top(e, asked, 10, id_col="vec_id").select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query(f"select e.vec_id, round(greatest(0.0, 1 - {DISTANCE}), 6) as score from embeddings e, {FIRST_VECTOR} x where greatest(0.0, 1 - {DISTANCE}) >= 0.1")
def distance_score_filter(spark, d):
    return vector.within(table(spark, d, "embeddings"), first_vector(spark, d), 0.1, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("select concat(source, '/', doc_id, '.txt') as file_path from documents where source = 'src3' and lang = 'en'")
def metadata_filter(spark, d):
    return files(spark, d).where(vector.predicate({"author": "src3", "doc_type": "en", "file_type": None})).select("file_path")


# ---- fusion


def _sides(spark, d, where=None):
    near = vector.top(store(spark, d), first_vector(spark, d), 50, where)
    near = ranked(near.select("chunk_id", "score", "distance"), "distance").drop("distance")
    words = bm25.search(bm25.build(corpus(spark, d), queries=first_query(spark, d)), first_query(spark, d), 50).select("chunk_id", "score", "rank")
    return near, words


def _rrf_sql(where: str = "true") -> str:
    return f"""with {_bm25_sql(FIRST, 50)},
        v as (select vec_id as doc_id, dist, row_number() over (order by dist, vec_id) as rank from (select e.vec_id, {DISTANCE} as dist from embeddings e left join {FILES} f on f.doc_id = e.vec_id, {FIRST_VECTOR} x where {where} order by dist, e.vec_id limit 50)),
        fused as (select coalesce(v.doc_id, bm.doc_id) as doc_id, coalesce(1.0 / (60.0 + v.rank), 0.0) + coalesce(1.0 / (60.0 + bm.rank), 0.0) as rrf, v.rank as vr, bm.rank as br, case when v.doc_id is null then bm.score else greatest(0.0, 1 - v.dist) end as score
                  from v full join bm on v.doc_id = bm.doc_id),
        top as (select * from fused order by rrf desc, vr asc nulls last, br asc nulls last, doc_id limit 20)"""


@query(_rrf_sql() + " select doc_id, round(rrf, 9) as rrf_score, round(score, 6) as score, cast(vr as int) as vector_rank, cast(br as int) as bm25_rank from top")
def rrf_fuse(spark, d):
    hits = fuse.rrf(*_sides(spark, d), by=None)
    return hits.select(F.col("chunk_id").alias("doc_id"), F.round("rrf_score", 9).alias("rrf_score"), F.round("score", 6).alias("score"), "vector_rank", "bm25_rank")


HYBRID_TAIL = " select t.doc_id, case when length(d.text) > 500 then substr(d.text, 1, 500) || '...' else d.text end as preview, round(rrf, 9) as rrf_score, round(score, 6) as score from top t join documents d on d.doc_id = t.doc_id order by rrf desc, vr asc nulls last, br asc nulls last limit 10"


def hybrid_hits(spark, d, filters=None, n: int = 10) -> DataFrame:
    asked = first_query(spark, d)
    r = Retriever(store(spark, d, "full"), bm25.build(corpus(spark, d), queries=asked))
    hits = r.search(asked.first()["text"], n, filters, first_vector(spark, d))
    return hits.select(F.col("chunk_id").alias("doc_id"), "preview", F.round("rrf_score", 9).alias("rrf_score"), F.round("score", 6).alias("score"))


@query(_rrf_sql() + HYBRID_TAIL)
def hybrid_search(spark, d):
    return hybrid_hits(spark, d)


@query(_rrf_sql("f.doc_type = 'fr'") + HYBRID_TAIL)
def hybrid_filtered(spark, d):
    return hybrid_hits(spark, d, {"doc_type": "fr"})


@query(f"with {_bm25_sql(FIRST, 50)} select bm.doc_id, d.text from bm join documents d on bm.doc_id = d.doc_id where d.text is not null")
def hydrate_text(spark, d):
    words = bm25.search(bm25.build(corpus(spark, d), queries=first_query(spark, d)), first_query(spark, d), 50).select("chunk_id", "rank")
    return fuse.hydrate(words, corpus(spark, d)).select(F.col("chunk_id").alias("doc_id"), "text")


@query(_rrf_sql() + " select t.doc_id, cast(row_number() over (order by rrf desc, vr asc nulls last, br asc nulls last, t.doc_id) as int) as rank from top t join documents d on d.doc_id = t.doc_id order by rank limit 5")
def rerank_passthrough(spark, d):
    hits = ranked(fuse.rrf(*_sides(spark, d), by=None), F.desc("rrf_score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("bm25_rank"))
    return fuse.rerank(fuse.hydrate(hits, corpus(spark, d)), "", 5).select(F.col("chunk_id").alias("doc_id"), "rank")


@query(f"select vec_id as doc_id, file_path, doc_type from embeddings left join {FILES} f on f.doc_id = vec_id where doc_type = 'de' and label < 5")
def filtered_store_scan(spark, d):
    s = store(spark, d).where(vector.predicate({"doc_type": "de"}) & (F.col("label") < 5))
    return s.select(F.col("chunk_id").alias("doc_id"), "file_path", "doc_type")


# ---- tables

DISK = f"(select file_path, n_chars + case when doc_id % 10 = 0 then 0.5 else 0 end as mtime, doc_id from {FILES} where doc_id % 11 <> 0)"
TRACKED = f"(select file_path, cast(n_chars as double) as file_mtime, doc_id, doc_id % 3 <> 0 as is_indexed, case when doc_id % 6 = 0 then 'bad' end as error_msg, sha256(file_path) as content_hash from {FILES} where doc_id % 13 <> 0)"


def disk(spark, d) -> DataFrame:
    f = files(spark, d, "n_chars", "doc_id").where("doc_id % 11 <> 0")
    return f.select("file_path", "doc_id", (F.col("n_chars") + F.when(F.col("doc_id") % 10 == 0, 0.5).otherwise(0.0)).alias("mtime"))


def tracked(spark, d) -> DataFrame:
    f = files(spark, d, "n_chars", "doc_id").where("doc_id % 13 <> 0")
    return f.select("file_path", "doc_id", F.col("n_chars").cast("double").alias("file_mtime"), (F.col("doc_id") % 3 != 0).alias("is_indexed"), F.when(F.col("doc_id") % 6 == 0, "bad").alias("error_msg"), F.sha2("file_path", 256).alias("content_hash"))


@query(f"""select file_path, case when t.doc_id is null then 'new' when d.doc_id is null then 'deleted' else 'changed' end as change
            from {DISK} d full join {TRACKED} t using (file_path) where t.doc_id is null or d.doc_id is null or mtime <> file_mtime""")
def snapshot_diff(spark, d):
    return tables.snapshot_diff(disk(spark, d), tracked(spark, d))


@query(f"""with f as (select file_path, case when doc_id % 5 = 0 then 'x' else sha256(file_path) end as content_hash from {FILES})
            select * from f where not exists (select 1 from {TRACKED} t where t.is_indexed and t.file_path = f.file_path and t.content_hash = f.content_hash)""")
def skip_unchanged(spark, d):
    f = files(spark, d, "doc_id").select("file_path", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.sha2("file_path", 256)).alias("content_hash"))
    return tables.skip_unchanged(f, tracked(spark, d))


STALE = "(select l_orderkey, l_linenumber, concat(l_orderkey, '_', l_linenumber) as chunk_id from lineitem)"


@query(f"select distinct chunk_id, l_orderkey as file_path from {STALE} s where l_orderkey % 2 = 0 and l_linenumber > 3 and exists (select 1 from {STALE} n where n.l_orderkey = s.l_orderkey and n.l_linenumber <= 3) and not exists (select 1 from {STALE} n where n.l_linenumber <= 3 and n.chunk_id = s.chunk_id)")
def stale_chunks(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_path"), "l_linenumber", F.concat_ws("_", "l_orderkey", "l_linenumber").alias("chunk_id"))
    new = lines.where("file_path % 2 = 0 and l_linenumber <= 3")
    return tables.stale(lines.select("file_path", "chunk_id"), new).distinct()


@query(f"select file_path from {FILES} where doc_author not in ('src3', 'src5')")
def delete_by_file(spark, d):
    f = files(spark, d)
    return tables.delete_files(f, f.where(F.col("doc_author").isin("src3", "src5"))).select("file_path")


@query("select user_id, event_id, event_type, round(value, 6) as value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def upsert_latest(spark, d):
    e = table(spark, d, "events")
    return tables.latest(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@query(f"select doc_id, doc_author from {FILES} where doc_id % 2 = 1 union all select doc_id, 'new' from {FILES} where doc_id % 2 = 0")
def upsert_chunks(spark, d):
    rows = files(spark, d, "doc_id").select("doc_id", "doc_author")
    return tables.upsert(rows, rows.where("doc_id % 2 = 0").withColumn("doc_author", F.lit("new")), "doc_id")


@query(f"""with e as (select file_path, 'broken' as error from {FILES} where doc_id % 4 = 0)
            select coalesce(t.file_path, e.file_path) as file_path, coalesce(file_mtime, 0.0) as file_mtime, coalesce(is_indexed, false) as is_indexed, coalesce(e.error, t.error_msg) as error_msg, coalesce(content_hash, '') as content_hash
            from {TRACKED} t full join e on e.file_path = t.file_path""")
def record_error_merge(spark, d):
    errors = files(spark, d, "doc_id").where("doc_id % 4 = 0").select("file_path", F.lit("broken").alias("error_msg"))
    return tables.record_errors(tracked(spark, d).drop("doc_id"), errors)


@query(f"select count(*) as total, count(*) filter (is_indexed) as indexed, count(*) filter (not is_indexed and error_msg is not null) as failed, count(*) filter (not is_indexed and error_msg is null) as pending from {TRACKED}")
def tracker_stats(spark, d):
    return tables.tracker_stats(tracked(spark, d))


@query(f"select count(*) as documents, count(distinct file_path) as files from {FILES} join lineitem on l_orderkey % 100 = doc_id")
def store_stats(spark, d):
    lines = table(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("doc_id"))
    return tables.store_stats(files(spark, d, "doc_id").join(lines, "doc_id"))


@query("""with r as (select case when event_type = 'click' then 'failed' when event_type = 'view' then 'skipped' else 'success' end as status, cast(floor(value) as bigint) as n from events)
           select count(*) filter (status = 'success') as success, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'skipped') as skipped, coalesce(sum(n) filter (status = 'success'), 0) as chunks,
                  round(count(*) filter (status = 'success') * 100.0 / nullif(count(*) filter (status <> 'skipped'), 0), 6) as success_rate from r""")
def run_summary(spark, d):
    e = table(spark, d, "events")
    return tables.run_summary(e.select(F.when(F.col("event_type") == "click", "failed").when(F.col("event_type") == "view", "skipped").otherwise("success").alias("status"), F.floor("value").alias("n_chunks")))


@query("select concat('conv/', conv_id) as file_path, turn as chunk_index, role as doc_author, text, (select count(distinct conv_id) from conversations c where exists (select 1 from conversations x where x.conv_id = c.conv_id and x.role = 'user')) as total_matched from (select *, row_number() over (partition by conv_id order by turn) as n from conversations where role = 'user') where n = 1 order by file_path limit 20")
def list_documents(spark, d):
    c = table(spark, d, "conversations").select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("file_path"), F.col("turn").alias("chunk_index"), F.col("role").alias("doc_author"), "text")
    return tables.list_documents(c, vector.predicate({"author": "user"}, listing=True), 20)


@query(f"""with recursive {UNITS}, longest as (select doc_id from documents order by n_chars desc, doc_id limit 1), own as (select x.* from chunked join longest using (doc_id))
            select count(*) as total_chunks, sum(length(text)) as total_chars, string_agg(text, chr(10) order by k) filter (k between 5 and 14) as content, count(*) > 15 as has_more, case when count(*) > 15 then 15 end as next_offset from (select unnest(x, max_depth := 1) from (select x from chunked join longest using (doc_id)))""")
def get_document_page(spark, d):
    f = files(spark, d, "doc_id", "n_chars", "text")
    longest = f.orderBy(F.desc("n_chars"), "doc_id").first()
    own = chunk.exploded(f.where(F.col("file_path") == longest["file_path"]), F.col("file_path"), F.col("text"))
    return tables.document_page(own, longest["file_path"], 5, 10)


@query()
def embed_hash(spark, d):
    from marlstone.operators.embed import HashEmbedder, embedded

    return table(spark, d, "documents").select("doc_id", embedded(F.col("text"), HashEmbedder()).alias("embedding"))
