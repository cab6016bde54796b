"""Named queries that write or run something: formats, saved indexes, index rounds on a folder of files, tools, streams."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.api import Engine, contained
from marlstone.functions import text as X
from marlstone.functions.vectors import dot
from marlstone.operators import bm25, fuse, morphemes, proximity, semantic, tables, vector
from marlstone.operators.ann import VectorIndex
from marlstone.operators.embed import HashEmbedder, ModelEmbedder, embedded
from marlstone.operators.keywords import KeywordIndex
from marlstone.operators.snapshot import Snapshot
from marlstone.plans.catalog import DISTANCE, FIRST, FIRST_VECTOR, STRIP, TRACKED, UNITS, _bm25_sql, corpus, first_query, first_vector, query, store, table, tracked
from marlstone.plans.indexing import Indexer
from marlstone.plans.retriever import Retriever
from marlstone.session import no_shuffle_kept, work_dir
from marlstone.sources import extract, scan, writers
from marlstone.streaming import incremental, watch

# ---- paths


@query(r"select page_id, nfc_normalize(replace(replace(url, 'a', 'a' || chr(776)), 'o', 'o' || chr(770))) as path from pages")
def path_nfc(spark, d):
    split = F.replace(F.replace("url", F.lit("a"), F.lit("a\u0308")), F.lit("o"), F.lit("o\u0302"))
    return table(spark, d, "pages").select("page_id", X.nfc(split).alias("path"))


@query("select doc_id, doc_id % 5 in (1, 2, 4) as inside from documents")
def path_containment(spark, d):
    k = F.col("doc_id") % 5
    tail = F.when(k == 0, "/../../etc/passwd").when(k == 1, "/./a.txt").when(k == 2, "/x/../b.txt").when(k == 3, "/../../root2/a.txt").otherwise("/../c//d.txt")
    return table(spark, d, "documents").select("doc_id", contained(F.concat(F.lit("/root/"), "source", tail), "/root/").alias("inside"))


# ---- formats


def _read(spark, d, name, made) -> DataFrame:
    """What the extractors read of files that are made of documents."""
    e = table(spark, d, "documents").select("doc_id", extract.extracted(made, name).alias("e"))
    return e.select("doc_id", F.col("e.text").alias("text"), F.col("e.success").alias("success"))


LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda s: {STRIP.format('s')}), lambda s: s <> '')"


@query(f"select doc_id, case when {STRIP.format('text')} = '' then '' else text end as text, {STRIP.format('text')} <> '' as success from documents")
def extract_txt(spark, d):
    """UTF-8 with and without a mark, UTF-16; .txt and .md."""
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, F.encode("text", "utf-8")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "utf-8"))).otherwise(F.encode("text", "utf-16"))
    return _read(spark, d, F.when(F.col("doc_id") % 2 == 0, "a.txt").otherwise("b.MD"), raw)


@query("select doc_id, '한글 문서 ' || doc_id as text, true as success from documents")
def extract_korean_code_page(spark, d):
    raw = writers.written(lambda i: f"한글 문서 {i}".encode("cp949"), F.col("doc_id"))
    return _read(spark, d, F.lit("a.txt"), raw)


@query(f"select doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda s: {STRIP.format('s')} <> ''), chr(10)) || chr(10) || chr(10) || '[Table]' || chr(10) || lang || ' | ' || source || chr(10) as text, true as success from documents where {STRIP.format('text')} <> ''")
def extract_docx(spark, d):
    raw = writers.written(lambda t, a, b: writers.docx(t, [a, b]), F.col("text"), F.col("lang"), F.col("source"))
    return _read(spark, d, F.lit("a.docx"), raw).join(table(spark, d, "documents").where(X.strip(F.col("text")) != "").select("doc_id"), "doc_id", "left_semi")


@query("select doc_id, chr(10) || '--- Slide 1 ---' || chr(10) || source || chr(10) || chr(10) || '--- Slide 2 ---' || chr(10) || lang || ' ' || doc_id as text, true as success from documents")
def extract_pptx(spark, d):
    raw = writers.written(lambda a, b, i: writers.pptx([a, f"{b} {i}"]), F.col("source"), F.col("lang"), F.col("doc_id"))
    return _read(spark, d, F.lit("a.pptx"), raw)


@query("select doc_id, chr(10) || '[Sheet: S]' || chr(10) || 'Headers: id, from' || chr(10) || 'id: ' || doc_id || ', from: ' || source || chr(10) || 'from: ' || lang as text, true as success from documents")
def extract_xlsx(spark, d):
    raw = writers.written(lambda i, a, b: writers.xlsx("S", [["id", "from"], [str(i), a], ["", b]]), F.col("doc_id"), F.col("source"), F.col("lang"))
    return _read(spark, d, F.lit("a.xlsx"), raw)


HEAD = "repeat('한글 문서 ', 12) || 'x'"


@query(f"select doc_id, {HEAD} || ' ' || source || ' ' || lang as text, true as success from documents")
def extract_hwpx(spark, d):
    raw = writers.written(lambda a, b: writers.hwpx(["한글 문서 " * 12 + "x", a, b]), F.col("source"), F.col("lang"))
    return _read(spark, d, F.when(F.col("doc_id") % 2 == 0, "a.hwpx").otherwise("a.hwp"), raw)


@query(rf"select doc_id, rtrim(regexp_replace({HEAD} || chr(10) || array_to_string({LINES}, chr(10)), '[ \t]+', ' ', 'g'), chr(10)) as text, true as success from documents")
def extract_hwp(spark, d):
    """Compound file, deflated section, paragraph records, long ones among them."""
    raw = writers.written(lambda t: writers.hwp(["한글 문서 " * 12 + "x", *t.replace("\t", " ").split("\n")]), F.col("text"))
    return _read(spark, d, F.lit("a.hwp"), raw)


@query(f"select doc_id, {HEAD} || doc_id as text, true as success from documents")
def extract_hwp_bytes(spark, d):
    """Neither a compound file nor an archive: legible runs."""
    raw = writers.written(lambda i: b"\x00\x01\x02" + ("한글 문서 " * 12 + f"x{i}").encode() + b"\x00\xff", F.col("doc_id"))
    return _read(spark, d, F.lit("a.hwp"), raw)


@query("select doc_id, source || ' ' || lang as text, true as success from documents")
def extract_bundles(spark, d):
    k = F.col("doc_id") % 3
    raw = writers.written(writers.bundle, F.col("source"), F.col("lang"))
    return _read(spark, d, F.when(k == 0, "a.pages").when(k == 1, "a.numbers").otherwise("a.key"), raw)


@query("select doc_id, source || ' 가 x' as text, true as success from documents")
def extract_rtf(spark, d):
    """Characters by number, and half a surrogate pair, which is dropped."""
    raw = F.encode(F.concat(F.lit("{\\rtf1\\ansi {\\b "), "source", F.lit("} \\u44032? \\u-10240?x}")), "utf-8")
    return _read(spark, d, F.lit("a.rtf"), raw)


@dataclass
class _Sheets:
    """Stands for an engine that reads images: the pages of a file are what form feeds part."""

    name: str = "sheets"

    def pages(self, raw: bytes, dpi: int, most: int):
        yield from raw.decode().split("\f")[:most]


@query("select doc_id, source || chr(10) || '--- Page Break ---' || chr(10) || lang as text, 'ocr_sheets' as method from documents where doc_id % 2 = 0 union all select doc_id, '', null from documents where doc_id % 2 = 1")
def extract_images(spark, d):
    """A PDF without text goes to the engine for images; blank pages are left out, and a file of these alone fails."""
    raw = F.encode(F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit("\f  \f"), "lang")).otherwise(" \f"), "utf-8")
    e = table(spark, d, "documents").select("doc_id", extract.extracted(raw, F.lit("a.pdf"), extract.readers(_Sheets())).alias("e"))
    return e.select("doc_id", F.col("e.text").alias("text"), F.col("e.metadata")["method"].alias("method"))


@query("select doc_id, false as success, case doc_id % 3 when 0 then 'unsupported format: exe' when 1 then 'empty file' else 'no text found' end as error from documents")
def extract_failures(spark, d):
    """A format that is unknown, a file without a byte, one of as many blanks as the document has characters."""
    k = F.col("doc_id") % 3
    raw = F.encode(F.when(k == 0, F.col("text")).when(k == 1, "").otherwise(F.repeat(F.lit(" "), F.length("text"))), "utf-8")
    e = table(spark, d, "documents").select("doc_id", extract.extracted(raw, F.when(k == 0, "a.exe").when(k == 1, "a.docx").otherwise("a.txt")).alias("e"))
    return e.select("doc_id", F.col("e.success").alias("success"), F.col("e.error").alias("error"))


# ---- embedding


class _Lengths:
    """Stands for a model: a text's vector is its length and its words; a batch of more than one long text is too much for it."""

    def encode(self, texts, batch_size):
        if len(texts) > 1 and max(map(len, texts)) > 2000:
            raise RuntimeError("Invalid buffer size")
        return [[float(len(t)), float(len(t.split()))] for t in texts]


@query(r"select doc_id, cast(length(text) as double) as a, cast(len(regexp_extract_all(text, '\S+')) as double) as b from documents")
def embed_model(spark, d):
    """A model behind the adapter, loaded in the workers; batches that are too large are done text by text."""
    model = ModelEmbedder("lengths", 8, 2, lambda name: _Lengths())
    e = table(spark, d, "documents").select("doc_id", embedded(F.col("text"), model).alias("e"))
    return e.select("doc_id", F.col("e")[0].cast("double").alias("a"), F.col("e")[1].cast("double").alias("b"))


# ---- search


@query(f"with {_bm25_sql(FIRST, 300)} select doc_id, round(score, 6) as score, cast(rank as int) as rank from bm")
def bm25_wide(spark, d):
    """More hits than documents that match: the rest follow in id order."""
    found = bm25.search(bm25.build(corpus(spark, d), queries=first_query(spark, d)), first_query(spark, d), 300)
    return found.select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"with {_bm25_sql(FIRST, 50)} select doc_id, round(score, 6) as score, cast(rank as int) as rank from bm")
def bm25_saved(spark, d):
    """A saved index of two thirds, read back, with the last third added."""
    docs, path = corpus(spark, d), f"{work_dir(spark)}/bm25-{uuid.uuid4().hex}"
    bm25.save(bm25.build(docs.where("chunk_id % 3 <> 0")), path, "first")
    assert bm25.load(spark, path, "other") is None
    index = bm25.add(bm25.load(spark, path, "first"), docs.where("chunk_id % 3 = 0"))
    found = bm25.search(index, first_query(spark, d), 50)
    return found.select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"with {_bm25_sql(FIRST, 50)} select doc_id, round(score, 6) as score, cast(rank as int) as rank from bm")
def bm25_add_small(spark, d):
    """Half of the documents after the other half, without knowing the queries beforehand."""
    docs = corpus(spark, d)
    index = bm25.add(bm25.build(docs.where("chunk_id % 2 = 0")), docs.where("chunk_id % 2 = 1"))
    found = bm25.search(index, first_query(spark, d), 50)
    return found.select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def _runs(spark, d) -> KeywordIndex:
    """A kept index after three runs: all but one source; that one comes and another goes; the other comes back."""
    docs = corpus(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source"), "chunk_id")
    some = lambda *sources: docs.where(F.col("source").isin(*sources)).select("chunk_id", "text")
    index = KeywordIndex(spark, f"{work_dir(spark)}/keywords-{uuid.uuid4().hex}", id_type="long")
    index.append(docs.where("source <> 'src3'").select("chunk_id", "text"), some(), "1")
    index.append(some("src3"), some("src5"), "2")
    index.append(some("src5"), some(), "3")
    return index


@query(f"with {_bm25_sql(FIRST, 50)} select doc_id, round(score, 6) as score, cast(rank as int) as rank from bm")
def bm25_segments(spark, d):
    found = _runs(spark, d).search(first_query(spark, d), 50)
    return found.select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"with {_bm25_sql('select item_id as q, text as t from benchmark', 10, True)} select q as item_id, doc_id, round(score, 6) as score, cast(rank as int) as rank from bm")
def bm25_segments_batch(spark, d):
    """All passages of the benchmark at once, matched words alone."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = _runs(spark, d).search(asked, 10, "paper")
    return found.select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query("select count(*) as n_queries, true as found_nine_of_ten, true as distances_exact, true as lists_skipped from embeddings where vec_id % 100 = 0")
def vector_lists(spark, d):
    """Every hundredth vector against all, by the index in lists: its recall, held against the exact search."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    index = VectorIndex(spark, f"{work_dir(spark)}/vectors-{uuid.uuid4().hex}", id_type="long")
    index.build(rows, "1")
    asked = rows.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    got, want = index.batch(asked, 10), vector.batch_top(rows, asked, 10).select("query_id", "chunk_id", F.col("distance").alias("true"))
    both = want.join(got, ["query_id", "chunk_id"], "left").agg((F.count("distance") >= 0.9 * F.count("*")).alias("found_nine_of_ten"), F.coalesce(F.bool_and(F.abs(F.col("distance") - F.col("true")) < 1e-6), F.lit(True)).alias("distances_exact"))
    m = index.manifest()
    return asked.agg(F.count("*").alias("n_queries")).join(F.broadcast(both), how="full").withColumn("lists_skipped", F.lit(m["probes"] < len(index._model(m)["centers"])))


@query(r"select doc_id, cast(len(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda s: s <> '')) as bigint) as n_tokens from documents where regexp_matches(lower(text), '[a-z]')")
def tokenizer_hook(spark, d):
    """Another tokenizer than white space, as an expression."""
    split = X.tokenizer(lambda t: re.findall("[a-z]+", t.lower()))
    return table(spark, d, "documents").where(F.lower("text").rlike("[a-z]")).select("doc_id", F.size(split(F.col("text"))).cast("long").alias("n_tokens"))


@query(r"""with w as (select unnest(regexp_extract_all(lower(text), '\p{L}+')) as word from documents), c as (select word, count(*) as n from w where length(word) <= 24 group by word),
    p as (select left(word, k) as l, substr(word, k + 1) as r, n from c, unnest(range(greatest(1, length(word) - 4), length(word) + 1)) as t(k)),
    b as (select 'S' as tag, l as form, n from p union all select 'E', r, n from p where r <> '')
    select tag, form, count(*) as types, cast(sum(n) as bigint) as n, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 5) as entropy from b group by tag, form""")
def morpheme_sides(spark, d):
    """What stands on the other side of every beginning and end of the words: the counts behind stems, endings and particles."""
    found = morphemes.sides(morphemes.word_counts(table(spark, d, "documents")))
    return found.withColumn("entropy", F.round("entropy", 5))


@query()
def morpheme_stems(spark, d):
    """The stems that search keeps of each document, by the lexicon of all documents."""
    docs = table(spark, d, "documents")
    split = morphemes.splitter(morphemes.learn(docs))
    return docs.select("doc_id", F.size(split(F.col("text"))).cast("long").alias("n_stems"))


NEAR = f"select e.vec_id as doc_id, {DISTANCE} as dist, d.text from embeddings e join documents d on d.doc_id = e.vec_id, {FIRST_VECTOR} x order by dist, e.vec_id limit 40"


@query(f"select doc_id, round(greatest(0.0, 1 - dist), 6) as score, cast(row_number() over (order by dist, doc_id) as int) as rank from ({NEAR}) where greatest(0.0, 1 - dist) >= 0.1")
def min_score_filter(spark, d):
    """Vectors alone, with a least score."""
    hits = Retriever(store(spark, d, "inner"), mode="vector_only").search("any", 40, query_vector=first_vector(spark, d), min_score=0.1)
    return hits.select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"select doc_id, cast(length(text) as double) as rerank_score from ({NEAR}) order by rerank_score desc, dist, doc_id limit 10")
def rerank_scored(spark, d):
    hits = Retriever(store(spark, d, "inner"), mode="vector_only").search("any", 40, query_vector=first_vector(spark, d))
    best = fuse.rerank(hits.drop("rerank_score", "rerank_error"), "any", 10, lambda q, texts: [len(t) for t in texts])
    return best.select(F.col("chunk_id").alias("doc_id"), "rerank_score")


@query(f"select file_path, file_mtime, content_hash from {TRACKED} where is_indexed and file_path = (select min(file_path) from {TRACKED} where is_indexed)")
def tracker_lookup(spark, d):
    rows = tables.indexed_files(tracked(spark, d))
    return tables.by_path(rows, rows.agg(F.min("file_path")).first()[0])


@query("select count(*) as n_documents, true as ndcg_up_by_a_twentieth from documents")
def rerank_learned(spark, d):
    """A reranker learned on passages of the documents, held against the keyword order on other passages."""
    docs, kept = corpus(spark, d), []

    def judged(salt: int) -> DataFrame:
        asked = proximity.passages(docs, 300, 6, salt).persist()
        hits = bm25.batch_top(docs, asked, 20).select("query_id", "chunk_id", "rank").persist()
        kept.extend((asked, hits))
        return proximity.judged(asked, hits, docs)

    held = proximity.reranked(judged(12), proximity.learn(judged(11))).persist()
    up = proximity.gain(held, "new_rank") - proximity.gain(held, "rank")
    for rows in (held, *kept):
        rows.unpersist()
    return docs.agg(F.count("*").alias("n_documents")).withColumn("ndcg_up_by_a_twentieth", F.lit(up >= 0.05))


@query("select count(*) as n_pairs, true as nearer_by_four_tenths from documents a join documents b on b.doc_id = a.doc_id + 1")
def embed_semantic(spark, d):
    """The halves of one document are nearer each other than those of two documents, by an embedding learned from all of them."""
    docs = table(spark, d, "documents")
    learned = semantic.fit(docs, f"{work_dir(spark)}/associations-{uuid.uuid4().hex}", dim=32)
    first, second = semantic.halves(F.col("text"))
    path = f"{work_dir(spark)}/halves-{uuid.uuid4().hex}"
    docs.select("doc_id", embedded(first, learned).alias("a"), embedded(second, learned).alias("b")).write.parquet(path)
    own = spark.read.parquet(path)  # read from both sides of the join
    next_ = own.select((F.col("doc_id") - 1).alias("doc_id"), F.col("b").alias("c"))
    margin = F.avg(dot(F.col("a"), F.col("b"))) - F.avg(dot(F.col("a"), F.col("c")))
    return own.join(next_, "doc_id").agg(F.count("*").alias("n_pairs"), (margin >= 0.4).alias("nearer_by_four_tenths"))


# ---- a folder of files, indexed


def _folder(spark: SparkSession, d: str) -> str:
    """A new folder with a text file a source, of its documents in id order."""
    path = f"{work_dir(spark)}/tree-{uuid.uuid4().hex}"
    _put(table(spark, d, "documents"), path)
    return path


def _put(docs: DataFrame, path: str) -> None:
    with no_shuffle_kept(docs.sparkSession):
        docs.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "text").write.mode("append").partitionBy("source").text(path)


def _local(path: str) -> str:
    return re.sub("^file:/*", "/", path)


def _indexer(spark, d) -> Indexer:
    path = _folder(spark, d)
    # a source is one file however large the table, and the SQL leaves none out; the default would, from 100 MB on
    return Indexer(spark, _local(path), path + "-home", HashEmbedder(), prefix=False, buckets=8, max_mb=1 << 20)


def _source(c="file_path"):
    return F.regexp_extract(c, "source=([^/]*)/", 1).alias("source")


def _units(made: str) -> str:
    return f"src as ({made}), " + UNITS.replace("from documents", "from src")


WHOLE = "select source as doc_id, string_agg(text, chr(10) order by doc_id) || chr(10) as text from documents group by source"


@query("select source, cast(sum(octet_length(encode(text)) + 1) as bigint) as length, 'txt' as extension from documents group by source")
def scan_folder(spark, d):
    """A listing off the file system: sizes, without a file being opened."""
    return scan.scan(spark, _local(_folder(spark, d))).select(_source(), "length", X.file_extension(F.col("file_path")).alias("extension"))


AGAIN = f"{WHOLE} having source = 'src7' union all select 'more', string_agg(text, chr(10) order by doc_id) || chr(10) from documents where source = 'src5' and doc_id % 3 = 0"


@query(f"""with recursive {_units(WHOLE + ' union all select * from (' + AGAIN.replace("select source as doc_id", "select source || '*' as doc_id") + ')')},
    n as (select doc_id, cast(len(c) as bigint) as n from packed)
    select 1 as round, (select count(*) from src where doc_id like 'src%' and doc_id not like '%*') as success, 0 as failed, (select sum(n) from n where doc_id like 'src%' and doc_id not like '%*') as chunks, (select sum(n) from n where doc_id like 'src%' and doc_id not like '%*') as stored
    union all select 2, 2, 0, (select sum(n) from n where doc_id like '%*' or doc_id = 'more'), (select sum(n) from n where doc_id not like '%*' and doc_id <> 'src3')
    union all select 3, 0, 0, 0, (select sum(n) from n where doc_id not like '%*' and doc_id <> 'src3')""")
def index_round(spark, d):
    """Three runs: all files are new; then one is new, one changed, one deleted; then none."""
    indexer, rows = _indexer(spark, d), []

    def run(k: int) -> None:
        s = indexer.incremental(f"t{k}").first()
        rows.append((k, s["success"], s["failed"], s["chunks"], indexer.store.read().count()))

    run(1)
    _mutate(spark, d, indexer.home.removesuffix("-home"))
    run(2)
    run(3)
    return spark.createDataFrame(rows, "round int, success long, failed long, chunks long, stored long")


@query(f"""with recursive {_units(WHOLE)}, one as (select doc_id, x.k as k, x.n as n, x.text as t from chunked)
    select o.doc_id as source, k as chunk_index, n as total_chunks, t as text, 'txt' as file_type,
           coalesce(list_filter(list_transform(string_split((select substr(f.t, 1, 1000) from one f where f.doc_id = o.doc_id and f.k = 0), chr(10)), lambda s: {STRIP.format('s')}),
              lambda s: length(s) between 5 and 100 and not regexp_matches(lower(s), '보안|대외비|비밀|일반|confidential|internal'))[1], '') as doc_title,
           (select octet_length(encode(text)) from src where src.doc_id = o.doc_id) as file_size
    from one o where {STRIP.format('t')} <> ''""")
def index_chunks(spark, d):
    """What a run stores: chunks with their file's metadata."""
    indexer = _indexer(spark, d)
    indexer.incremental("t")
    return indexer.store.read().select(_source(), "chunk_index", "total_chunks", "text", "file_type", "doc_title", "file_size")


@query(f"""with recursive {_units(WHOLE)}, own as (select x.* from (select x from chunked where doc_id = 'src2'))
    select count(*) as total_chunks, sum(length(text)) as total_chars, string_agg(text, chr(10) order by k) filter (k between 1 and 2) as content, count(*) > 3 as has_more, case when count(*) > 3 then 3 end as next_offset from own""")
def tool_get_document(spark, d):
    indexer = _indexer(spark, d)
    path = next(r[0] for r in scan.scan(spark, indexer.root).select("file_path").collect() if "source=src2/" in r[0])
    return Engine(indexer).get_document(path, 1, 2)


@query(f"""with recursive {_units(WHOLE)} select (select count(*) from src) as total, (select count(*) from src) as indexed, 0 as failed, 0 as pending,
    (select sum(len(c)) from packed) as documents, (select count(*) from packed) as files""")
def tool_get_stats(spark, d):
    engine = Engine(_indexer(spark, d), mode="vector_only")
    engine.reindex("t")
    return engine.get_stats()


@query("select source, 'txt' as file_type, count(*) over () as total_matched from (select distinct source from documents) order by source limit 7")
def tool_list_documents(spark, d):
    engine = Engine(_indexer(spark, d), mode="vector_only")
    engine.reindex("t")
    return engine.list_documents(file_type=".TXT", limit=7).select(_source(), "file_type", "total_matched")


@query()
def tool_search_documents(spark, d):
    """Both sides, off the stored vectors and the saved keyword index."""
    engine = Engine(_indexer(spark, d))
    engine.reindex("t")
    return engine.search_documents(first_query(spark, d).first()["text"], 10).select("text", "preview", "score", "rrf_score", "rank")


@query("select * from (values ('search_documents', true), ('get_document', true), ('list_documents', false), ('reindex', false), ('get_stats', false), ('nothing', true)) as t(tool, failed)")
def rpc_envelopes(spark, d):
    """Calls without arguments: two lack one, one is unknown, three are answered."""
    from marlstone.server import TOOLS, Server

    root = f"{work_dir(spark)}/tree-{uuid.uuid4().hex}"
    _put(table(spark, d, "documents"), root)
    server = Server(Engine(Indexer(spark, _local(root), root + "-home", HashEmbedder(), buckets=8), mode="vector_only"))
    replies = [(t, server.answer({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": t}})) for t in [*(t["name"] for t in TOOLS), "nothing"]]
    return spark.createDataFrame([(t, r["result"]["isError"]) for t, r in replies], "tool string, failed boolean")


@query(f"""with recursive {_units(WHOLE + " having source <> 'src3'")}, parts as (select row_number() over () as doc_id, x.text as text from chunked where x.text <> ''),
    {re.sub("[(]?documents[)]?", lambda m: m.group().replace("documents", "parts"), _bm25_sql(FIRST, 20))} select cast(rank as int) as rank, round(score, 6) as score from bm""")
def index_search(spark, d):
    """Two runs, a source deleted and one touched between them, and a search off the segments that the runs have kept."""
    engine = Engine(_indexer(spark, d))
    engine.reindex("t1")
    _mutate(spark, d, engine.indexer.root, False)
    engine.reindex("t2")
    found = engine.keywords.search(first_query(spark, d), 20)
    return found.select("rank", F.round("score", 6).alias("score"))


@query("select doc_id, text as before, text || '!' as after from documents")
def read_during_change(spark, d):
    """A table read after it was changed, by a reader that held it before, and by one that did not."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    target = Snapshot(spark, f"{work_dir(spark)}/versions-{uuid.uuid4().hex}", docs.schema, "doc_id", 8, retention=0.0)
    target.write(docs)
    with target.lease() as held:
        target.change(docs, lambda old: old.withColumn("text", F.concat("text", F.lit("!"))))
        out = held.withColumnRenamed("text", "before").join(target.read().withColumnRenamed("text", "after"), "doc_id")
        path = f"{target.path}-seen"
        out.write.parquet(path)
    return spark.read.parquet(path)


@query("select doc_id, case when doc_id = (select max(doc_id) from documents) then 'mine' else text end as text from documents union all select -1, 'new'")
def upsert_one(spark, d):
    """One known row and one unknown one put in, each touching a bucket."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    target = Snapshot(spark, f"{work_dir(spark)}/one-{uuid.uuid4().hex}", docs.schema, "doc_id", 8)
    target.write(docs)
    last = docs.agg(F.max("doc_id")).first()[0]
    for row in ((last, "mine"), (-1, "new")):
        one = spark.createDataFrame([row], docs.schema)
        target.change(one, lambda old, one=one: tables.upsert(old, one, "doc_id"))
    return target.read()


# ---- streams


def _mutate(spark, d, root: str, more: bool = True) -> None:
    """A source goes, another is touched, and (if wanted) a third gets a file."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/source=src3"), True)
    for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/source=src7")):
        fs.setTimes(f.getPath(), 1_700_000_000_000, -1)
    if more:
        _put(table(spark, d, "documents").where("source = 'src5' and doc_id % 3 = 0"), root)


@query("select source, case source when 'src3' then 'deleted' when 'src7' then 'changed' else 'new' end as change, case when source in ('src3', 'src7') then sum(octet_length(encode(text)) + 1) else sum(octet_length(encode(text)) + 1) filter (doc_id % 3 = 0) end::bigint as length from documents where source in ('src3', 'src5', 'src7') group by source")
def stream_diff(spark, d):
    """What the second listing of a folder tells: a source deleted, one rewritten, one with a file more. Also equal to the batch."""
    root, path = _local(_folder(spark, d)), f"{work_dir(spark)}/diff-{uuid.uuid4().hex}"
    target = Snapshot(spark, f"{path}/seen", T.StructType([T.StructField("file_path", T.StringType()), T.StructField("mtime", T.DoubleType())]), buckets=4)

    def step(name: str) -> None:
        watched = watch.changes(spark, root).writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/checkpoint-all")
        watched.trigger(availableNow=True).start().awaitTermination()

    step("told")
    before = scan.scan(spark, root).select("file_path", F.col("mtime").alias("file_mtime"))
    before.write.parquet(f"{path}/before")
    first = spark.read.schema(watch.CHANGED).parquet(f"{path}/told").inputFiles()
    _mutate(spark, d, root)
    step("told")
    told = spark.read.schema(watch.CHANGED).parquet(f"{path}/told").where(~F.input_file_name().isin(first) if first else F.lit(True))
    batch = tables.snapshot_diff(scan.scan(spark, root), spark.read.parquet(f"{path}/before"))
    same = told.join(batch, ["file_path", "change"], "full").count() == batch.count() == told.count()
    return told.where(F.lit(same)).select(_source(), "change", "length")


@query("select source, count(*) over (partition by source) as n_files from (select distinct source from documents where source <> 'src3')")
def stream_keeps_index(spark, d):
    """An index kept equal to a folder by a stream: what is deleted goes, what is rewritten stays once."""
    indexer = _indexer(spark, d)
    for k in range(2):
        watch.keep(indexer, indexer.home + "-watch").awaitTermination()
        if not k:
            _mutate(spark, d, indexer.root, False)
    return indexer.store.read().groupBy(_source()).agg(F.count_distinct("file_path").alias("n_files"))


@query(f"with recursive {_units(WHOLE)} select doc_id as source, cast(len(c) as bigint) as n_chunks from packed")
def stream_index(spark, d):
    indexer = _indexer(spark, d)
    incremental.index_stream(indexer, indexer.home + "-checkpoint", "*.txt").awaitTermination()
    return indexer.store.read().groupBy(_source()).agg(F.count("*").alias("n_chunks"))


def _events(spark, d) -> DataFrame:
    return spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("select user_id, event_id, event_type, round(value, 6) as value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def stream_upsert(spark, d):
    path = f"{work_dir(spark)}/latest-{uuid.uuid4().hex}"
    target = Snapshot(spark, path, table(spark, d, "events").schema, "user_id", 8)
    incremental.upsert_stream(_events(spark, d), target, "user_id", ["ts", "event_id"], path + "-checkpoint").awaitTermination()
    return target.read().select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_windows(spark, d):
    """Windowed counts of the whole stream; the windows are few, and kept in memory."""
    name = f"windows_{uuid.uuid4().hex}"
    q = incremental.event_counts(_events(spark, d)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{work_dir(spark)}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("select source, false as is_indexed, 'OSError: no luck' as error_msg from (select distinct source from documents)")
def index_failures(spark, d):
    """A reader that fails on every file: each is a row of the tracker with its reason."""

    def unlucky(raw: bytes):
        raise OSError("no luck")

    indexer = _indexer(spark, d)
    indexer.readers = extract.readers(more={"txt": unlucky})
    indexer.incremental("t")
    return indexer.tracker.read().select(_source(), "is_indexed", "error_msg")
