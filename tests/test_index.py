"""What an index keeps: listings, opened files, versions of tables, segments of postings."""

from __future__ import annotations

import os
import random
import re
import threading
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.api import Engine
from marlstone.operators import bm25, chunk, embed, vector
from marlstone.operators.ann import VectorIndex
from marlstone.operators.embed import HashEmbedder, _gram_hashes
from marlstone.operators.keywords import KeywordIndex
from marlstone.operators.snapshot import Conflict, Snapshot, fingerprint
from marlstone.plans.indexing import Indexer
from marlstone.schema import TRACKER
from marlstone.sources import extract, scan, tree
from marlstone.streaming import watch

# ---- listing and opening


def put(path, text="some words here", at=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    if at:
        os.utime(path, (at, at))


def test_walk_enters_no_excluded_folder(spark, tmp_path):
    root = tmp_path / "in"
    for name in ("a.txt", "sub/b.md", "sub/deep/er/c.csv", "_odd/d.txt", "e.exe", ".f.txt", "g.txt~"):
        put(root / name)
    for k in range(50):
        put(root / f"node_modules/m{k}/x{k}.txt")
    (root / "loop").symlink_to(root)
    (root / "same.txt").symlink_to(root / "a.txt")
    (root / "broken.txt").symlink_to(root / "nothing")
    (root / "empty").mkdir()
    listed = []
    found = scan.files(spark, str(root), keep=lambda level, depth: listed.append(level.persist()) or listed[-1])
    names = {os.path.relpath(r["place"], root) for r in found.collect()}
    assert names == {"a.txt", "sub/b.md", "sub/deep/er/c.csv", "_odd/d.txt", "e.exe", ".f.txt", "g.txt~", "same.txt"}
    seen = {r["place"] for level in listed for r in level.collect()}
    assert str(root / "node_modules") in seen and not any("/m1" in p for p in seen)  # seen by name, never listed
    assert len(listed) == 4
    good = {os.path.relpath(r["file_path"], root) for r in scan.scan(spark, str(root)).collect()}
    assert good == {"a.txt", "sub/b.md", "sub/deep/er/c.csv", "_odd/d.txt", "same.txt"}
    assert len(scan.files(spark, str(root), None).collect()) == 8 + 50
    assert [r["length"] for r in scan.files(spark, str(root / "a.txt")).collect()] == [15]
    assert scan.files(spark, str(root / "empty")).collect() == [] == scan.files(spark, str(tmp_path / "none")).collect()


def test_unreadable_places_are_rows(spark, tmp_path):
    put(tmp_path / "a.txt")
    rows = tree.listed(spark.createDataFrame([(str(tmp_path),), (str(tmp_path / "gone"),)], "place string")).collect()
    assert {(os.path.basename(r["place"]), r["error"] is None) for r in rows} == {("a.txt", True), ("gone", False)}
    assert tree.content(str(tmp_path / "gone"), 9)[1].startswith("FileNotFoundError")
    assert tree.content(str(tmp_path / "a.txt"), 9) == (None, "larger than 9 bytes")
    assert tree.content(f"file://{tmp_path}/a.txt", 99) == (b"some words here", None)


def test_a_limit_costs_no_memory(spark, tmp_path):
    """A limit far above what files hold, and above the memory there is, is nothing that a read asks for."""
    put(tmp_path / "a.txt")
    for most in (1 << 40, 1 << 60):
        assert tree.content(str(tmp_path / "a.txt"), most) == (b"some words here", None)
        assert tree.content(str(tmp_path / "a.txt"), most, 4) == (b"some words here", None)
    assert tree.content(str(tmp_path / "a.txt"), 15, 4)[0] == b"some words here" and tree.content(str(tmp_path / "a.txt"), 14, 4) == (None, "larger than 14 bytes")
    (found,) = extract.extract_files(scan.files(spark, str(tmp_path / "a.txt"), None), max_mb=1 << 40).collect()
    assert found["extraction"]["text"] == "some words here"

    def unlucky(raw: bytes):
        raise OSError("no luck")

    (failed,) = extract.chunk_files(scan.files(spark, str(tmp_path / "a.txt"), None), 800, 100, extract.readers(more={"txt": unlucky}), 1 << 40).collect()
    assert failed["error"] == "OSError: no luck" and not failed["success"]


def spy(folder):
    """A reader that leaves a trace of every file it is given: the bytes read."""

    def read(raw: bytes) -> extract.Extracted:
        (folder / f"{os.getpid()}-{random.random()}").write_bytes(raw)
        return extract.plain(raw)

    return read


def test_a_run_opens_what_changed_and_nothing_else(spark, tmp_path):
    root, seen = tmp_path / "in", tmp_path / "seen"
    for k in range(4):
        put(root / f"f{k}.txt", f"text number {k} " * (k + 1))
    put(root / "node_modules/huge.txt", "x" * 5000)
    seen.mkdir()
    indexer = Indexer(spark, str(root), str(tmp_path / "home"), HashEmbedder(), prefix=False, buckets=4, readers=extract.readers(more={"txt": spy(seen)}))
    s = indexer.incremental("t1").first()
    assert (s["success"], s["failed"]) == (4, 0) and len(os.listdir(seen)) == 4
    for name in ("f0.txt", "f1.txt"):  # no files any more, and to open one is to wait for ever
        os.remove(root / name)
        os.mkfifo(root / name)
    at = os.stat(root / "f3.txt").st_mtime_ns  # unchanged by its time, and no reader could make anything of it
    (root / "f3.txt").write_bytes(b"\xff\xfe\x00")
    os.utime(root / "f3.txt", ns=(at, at))
    put(root / "big.txt", "y" * (2 << 20))
    put(root / "new.txt", "fresh words")
    put(root / "f2.txt", "changed words", at=1_700_000_000)
    for name in os.listdir(seen):
        os.remove(seen / name)
    indexer.max_mb = 1
    s = indexer.incremental("t2").first()
    assert (s["success"], s["failed"]) == (2, 0)
    assert sorted((seen / n).read_bytes() for n in os.listdir(seen)) == [b"changed words", b"fresh words"]
    left = {os.path.basename(r["file_path"]) for r in indexer.store.read().select("file_path").distinct().collect()}
    assert left == {"f2.txt", "f3.txt", "new.txt"}  # what is no regular file any more counts as gone
    assert os.listdir(tmp_path / "home" / "runs") == []


def test_files_that_vanish_or_grow_are_failures(spark, tmp_path):
    put(tmp_path / "in/a.txt")
    put(tmp_path / "in/b.txt", "z" * (2 << 20))
    listing = spark.createDataFrame([(str(tmp_path / "in" / n), str(tmp_path / "in" / n), 1.0, 3) for n in ("a.txt", "b.txt", "gone.txt")], "file_path string, place string, mtime double, length long")
    got = {os.path.basename(r["file_path"]): (r["extraction"]["success"], r["extraction"]["error"]) for r in extract.extract_files(listing, max_mb=1).collect()}
    assert got["a.txt"] == (True, None) and got["b.txt"][1] == "larger than 1048576 bytes" and got["gone.txt"][1].startswith("FileNotFoundError")


# ---- versions


def rows_of(spark, n, stamp="a"):
    return spark.createDataFrame([(f"p{i}", float(i), "h", stamp, True, None, "m") for i in range(n)], TRACKER)


def test_a_reader_keeps_its_version(spark, tmp_path):
    s = Snapshot(spark, str(tmp_path / "t"), TRACKER, buckets=4, retention=0.0)
    s.write(rows_of(spark, 20))
    with s.lease() as held:
        s.change(rows_of(spark, 20), lambda old: old.withColumn("last_indexed", F.lit("b")))
        s.change(rows_of(spark, 20), lambda old: old.withColumn("last_indexed", F.lit("c")))
        assert {r[0] for r in held.select("last_indexed").collect()} == {"a"}
        assert {r[0] for r in s.read().select("last_indexed").collect()} == {"c"}
    assert s.vacuum(0.0) > 0
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND|FILE_NOT_EXIST"):
        held.select("last_indexed").collect()
    assert s.read().count() == 20
    # without a lease the retention keeps it
    s.retention = 3600.0
    plain = s.read()
    s.change(rows_of(spark, 20), lambda old: old.limit(0))
    assert plain.count() == 20 and s.read().count() == 0 and s.vacuum() == 0
    s.folder.put("_leases/x.json", {"version": 1, "until": 5.0})
    s.vacuum(0.0)
    assert s.folder.names("_leases") == [] and s.versions() == [s.latest().number]


def test_two_writers(spark, tmp_path):
    """The second publishes on the first's state: again if they touch the same buckets, else with what it has written."""
    made = [Snapshot(spark, str(tmp_path / "t"), TRACKER, buckets=64) for _ in range(2)]
    made[0].write(rows_of(spark, 40))
    place = {r["file_path"]: r["b"] for r in rows_of(spark, 40).select("file_path", made[0]._bucket().alias("b")).collect()}
    other = next(k for k in place if place[k] != place["p0"])
    for theirs, retries in (("p0", 1), (other, 0)):
        calls = []

        def mine(old, calls=calls, theirs=theirs):
            if not calls:  # the other one comes first
                key = rows_of(spark, 40).where(F.col("file_path") == theirs)
                made[1].change(key, lambda rows: rows.withColumn("error_msg", F.when(F.col("file_path") == theirs, F.concat(F.coalesce("error_msg", F.lit("")), F.lit("x"))).otherwise(F.col("error_msg"))))
            calls.append(1)
            return old.withColumn("content_hash", F.when(F.col("file_path") == "p0", F.concat("content_hash", F.lit("!"))).otherwise(F.col("content_hash")))

        made[0].retries = 0
        made[0].change(rows_of(spark, 1), mine)
        assert made[0].retries == retries == len(calls) - 1
    found = {r["file_path"]: (r["content_hash"], r["error_msg"]) for r in made[0].read().collect()}
    assert found["p0"] == ("h!!", "x") and found[other] == ("h", "x") and len(found) == 40


def test_writers_at_once(spark, tmp_path):
    s = [Snapshot(spark, str(tmp_path / "t"), TRACKER, buckets=1, attempts=30) for _ in range(4)]
    s[0].write(rows_of(spark, 1))
    errors = []

    def add(k):
        try:
            s[k].change(rows_of(spark, 1), lambda old: old.unionByName(rows_of(spark, 1, f"w{k}")))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and sorted(r["last_indexed"] for r in s[0].read().collect()) == ["a", "w0", "w1", "w2", "w3"]
    never = Snapshot(spark, str(tmp_path / "t"), TRACKER, buckets=1, attempts=0)
    with pytest.raises(Conflict):
        never.write(rows_of(spark, 1))


# ---- keyword segments


def texts(n, seed=0):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    return [(f"c{seed}-{i:04d}", " ".join(rnd.choices(words, [1 / (k + 1) for k in range(60)], k=rnd.randint(0, 25)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, text string")


def same_hits(spark, index, rows, asked, n=10, digits=7):
    queries = spark.createDataFrame(asked, "query_id int, text string")
    full = bm25.build(frame(spark, rows))
    for mode in ("library", "paper"):
        want = sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], digits)) for r in bm25.search(full, queries, n, mode).collect())
        got = sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], digits)) for r in index.search(queries, n, mode).collect())
        assert got == want, mode


ASKED = [(1, "w0 w3"), (2, "w59 w40 w40"), (3, "w7"), (4, "nothing known"), (5, ""), (6, "w58 nothing"), (7, "w1 w2 w3 w4 w5")]


def test_segments_equal_a_full_build(spark, tmp_path):
    """Runs that add, delete, bring back and change chunks, with merges on the way."""
    index = KeywordIndex(spark, str(tmp_path / "k"), fan=3, spread_from=150)
    now: dict[str, str] = {}
    rnd = random.Random(5)
    for run in range(8):
        came = dict(texts(300 if run == 0 else 20, run))
        gone = rnd.sample(sorted(now), min(len(now), 25))
        back = {k: now[k] + " w59 w9" for k in gone[:10]}
        removed = [(k, now.pop(k)) for k in gone]
        came |= back
        now |= came
        index.append(frame(spark, list(came.items())), frame(spark, removed), f"run{run}")
        assert index.n == len(now) and index.fingerprint() == f"run{run}"
        if run in (0, 3, 7):
            same_hits(spark, index, list(now.items()), ASKED)
    m = index.manifest()
    assert len(m["segments"]) < 5 and m["gone"]
    assert index.avgdl == pytest.approx(sum(len(t.split()) for t in now.values()) / len(now))
    index.append(frame(spark, []), frame(spark, [(k, now.pop(k)) for k in sorted(now)[:200]]), "less")  # so much is dead that all is merged
    assert index.manifest()["gone"] == [] and len(index.manifest()["segments"]) == 1
    same_hits(spark, index, list(now.items()), ASKED)
    index.append(frame(spark, []), frame(spark, list(now.items())), "none")
    assert index.n == 0 and index.search(spark.createDataFrame(ASKED, "query_id int, text string")).collect() == []


def test_search_reads_few_blocks_and_row_groups(spark, tmp_path):
    rows = [(f"c{i:05d}", "common " * (1 + (i // 128 == 7) * 5) + f"filler{i % 500} w{i}") for i in range(3000)]
    index = KeywordIndex(spark, str(tmp_path / "k"), spread_from=1000)
    index.build(frame(spark, rows), "f")
    same_hits(spark, index, rows, [(1, "common w17"), (2, "common")], 5)
    asked = [r for r in spark.createDataFrame([("common", 0)], "term string, bucket int").collect()]
    plan = index._asked(index.manifest(), asked)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(term,common)" in plan and "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    scored = []
    real = KeywordIndex._scored

    def watch(self, m, rows, weighed, blocks, *rest):
        scored.append(len(blocks))
        return real(self, m, rows, weighed, blocks, *rest)

    index._scored = watch.__get__(index)
    best = index.search(spark.createDataFrame([(1, "common")], "query_id int, text string"), 5).collect()
    assert {int(r["chunk_id"][1:]) // 128 for r in best} == {7}
    assert scored == [5, 0] and index.postings().where("term = 'common'").count() >= 24  # of 24 blocks


@pytest.mark.parametrize("run_words", [1 << 20, 700])
def test_no_row_a_word_and_chunk_is_staged(spark, tmp_path, run_words):
    """What a build stages is a row a chunk, and a row a term in each run of a task; the postings are those of plain counts."""
    rows = [(f"c{i:04d}", None if i == 7 else " ".join(f"w{(i * j * j) % 61}" for j in range(i % 80)) + " all" * (i % 3)) for i in range(700)]
    index = KeywordIndex(spark, str(tmp_path / "k"), spread_from=100, run_words=run_words)
    staged = []
    index.folder.delete = lambda path: staged.append(spark.read.parquet(f"{index.path}/{path}").count()) if path.startswith("staged/") else None
    index.build(frame(spark, rows), "f")
    counts = {(c, w): n for c, t in rows for w, n in Counter((t or "").split()).items()}
    runs = 4 if run_words > 700 else 40  # of 4 tasks, more or less
    assert staged[0] <= len(rows) + 62 * runs < len(counts)
    m = index.manifest()
    docs = {(r["block"], r["at"]): r for r in index._docs(m).collect()}
    assert len(docs) == len(rows) and all(r["dl"] == len((dict(rows)[r["chunk_id"]] or "").split()) for r in docs.values())
    got = {}
    for r in index.postings().collect():
        own = [docs[r["block"], at] for at in r["ats"]]
        assert r["n"] == len(own) == len(r["tfs"]) and r["max_tf"] == max(r["tfs"]) and r["min_dl"] == min(d["dl"] for d in own)
        got |= {(d["chunk_id"], r["term"]): tf for d, tf in zip(own, r["tfs"], strict=True)}
    assert got == counts


def test_a_runs_shuffle_files_go_with_its_jobs(spark, tmp_path):
    put(tmp_path / "in/a.txt", "apple pear")
    indexer = Indexer(spark, str(tmp_path / "in"), str(tmp_path / "home"), HashEmbedder(), prefix=False, buckets=4)
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x.rsplit("/", 1)[-1] for x in local.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before, name = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_before = spark.conf.get(name)
    with indexer._stage() as folder:
        indexer._staged(spark.range(1000).repartition("id"), f"{folder}/x")
        assert not files() - before
    assert spark.conf.get(name) == set_before


def test_the_engine_appends_segments(spark, tmp_path):
    root = tmp_path / "in"
    for k in range(12):
        put(root / f"f{k}.txt", f"apple pear{k} " * 5 + "\n\n" + f"plum{k}")
    engine = Engine(Indexer(spark, str(root), str(tmp_path / "home"), HashEmbedder(), prefix=False, buckets=4))
    engine.reindex("t1")
    (first,) = engine.keywords.manifest()["segments"]
    put(root / "f3.txt", "apple quince", at=1_700_000_000)
    os.remove(root / "f5.txt")
    engine.reindex("t2")
    m = engine.keywords.manifest()
    assert [s["n"] for s in m["segments"]] == [first["n"], 1] and m["segments"][0] == first  # one small segment more
    state = engine.indexer.store.latest()
    assert engine.keywords.fingerprint() == fingerprint(state.folders)
    chunks = [(r["chunk_id"], r["text"]) for r in engine.indexer.store.read().collect()]
    same_hits(spark, engine._index(), chunks, [(1, "apple quince"), (2, "plum5 pear3"), (3, "pear7")])
    assert engine.keywords.manifest() == m  # searches build nothing
    # a store that changed behind the index is told, and the index built anew
    engine.indexer.on_change = None
    put(root / "f20.txt", "apple medlar")
    engine.reindex("t3")
    assert engine.search_documents("medlar", 1).first()["text"] == "apple medlar"
    assert len(engine.keywords.manifest()["segments"]) == 1


# ---- vectors in lists


def clustered(n, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 1, (20, dim))
    return [(f"v{seed}-{i:05d}", [float(x) for x in centers[i % 20] + rng.normal(0, 0.5, dim)], ["txt", "md"][i % 3 == 0]) for i in range(n)]


def recall(got, want):
    a, b = ({(r["query_id"], r["chunk_id"]) for r in rows} for rows in (got, want))
    return len(a & b) / len(b)


def test_lists_keep_true_neighbours(spark, tmp_path):
    schema = "chunk_id string, embedding array<float>, file_type string"
    store = spark.createDataFrame([*clustered(3000), ("none", None, "txt"), ("zero", [0.0] * 24, "txt")], schema)
    index = VectorIndex(spark, str(tmp_path / "v"), keep=("file_type",), sample=2000)
    index.build(store, "f")
    m = index.manifest()
    assert index.n == 3001 and m["probes"] < len(index._model(m)["centers"]) == 54
    asked = spark.createDataFrame([(i, v) for i, (_, v, _) in enumerate(clustered(60, seed=1)[::2])], "query_id int, embedding array<double>")
    assert recall(index.batch(asked, 10).collect(), vector.batch_top(store, asked, 10).collect()) >= 0.9
    everything = index.batch(asked, 10, probes=54).collect()
    exact = {(r["query_id"], r["chunk_id"]): (r["distance"], r["score"]) for r in vector.batch_top(store, asked, 10).collect()}
    assert all((r["distance"], r["score"]) == exact[r["query_id"], r["chunk_id"]] for r in everything if (r["query_id"], r["chunk_id"]) in exact)
    # a filter holds within the lists
    where = F.col("file_type") == "md"
    assert recall(index.batch(asked, 10, where).collect(), vector.batch_top(store, asked, 10, where).collect()) >= 0.9
    plan = index.batch(asked, 10, where, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "list" in plan.split("PartitionFilters")[1].split("]")[0] and "EqualTo(file_type,md)" in plan
    # rows come and go
    came, gone = clustered(400, seed=2), store.where("chunk_id < 'v1-00500'")
    index.append(spark.createDataFrame(came, schema), gone, "g")
    now = store.join(gone, "chunk_id", "left_anti").unionByName(spark.createDataFrame(came, schema))
    assert index.n == now.where("embedding is not null").count() and index.fingerprint() == "g"
    asked = spark.createDataFrame([(i, v) for i, (_, v, _) in enumerate(came[:30])], "query_id int, embedding array<double>")
    found = index.batch(asked, 10, block=7).collect()
    assert recall(found, vector.batch_top(now, asked, 10).collect()) >= 0.9
    assert not {r["chunk_id"] for r in found} & {r[0] for r in gone.select("chunk_id").collect()}
    assert index.top(came[0][1], 1).first()["chunk_id"] == came[0][0]
    index.append(spark.createDataFrame(came[:1], schema), spark.createDataFrame(came[:1], schema), "h")
    assert index.top(came[0][1], 1).first()["chunk_id"] == came[0][0]


def test_empty_and_tiny_vector_indexes(spark, tmp_path):
    schema = "chunk_id string, embedding array<float>"
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(spark.createDataFrame([], schema), "e")
    assert index.top([1.0, 0.0], 3).collect() == [] and index.n == 0
    index.build(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0])], schema), "f")
    assert [(r["chunk_id"], r["distance"]) for r in index.top([2.0, 0.0], 2).collect()] == [("a", 0.0), ("c", 0.0)]


def test_the_engine_searches_lists(spark, tmp_path):
    for k in range(30):
        put(tmp_path / f"in/f{k}.txt", f"apple pear{k} " * 5)
    engine = Engine(Indexer(spark, str(tmp_path / "in"), str(tmp_path / "home"), HashEmbedder(), prefix=False, buckets=4), mode="vector_only", approximate=True)
    engine.reindex("t1")
    exact = Engine(engine.indexer, mode="vector_only")
    for _ in range(2):
        got, want = ([(r["text"], round(r["score"], 6)) for r in e.search_documents("pear7 apple", 3).collect()] for e in (engine, exact))
        assert got == want
        engine.indexer.on_change = engine._follow
        put(tmp_path / "in/g.txt", "pear7 apple again")
        os.remove(tmp_path / "in/f3.txt") if (tmp_path / "in/f3.txt").exists() else None
        engine.reindex("t2")
        assert engine.vectors.fingerprint() == engine.indexer.store.state()


# ---- streams of changes


def test_stream_of_changes_equals_the_batch_difference(spark, tmp_path):
    root = tmp_path / "in"
    for name in ("a.txt", "b.txt", "sub/c.txt", "sub/x/d.md", "node_modules/e.txt", "f.exe"):
        put(root / name, name)
    home = Indexer(spark, str(root), str(tmp_path / "home"), HashEmbedder(), prefix=False, buckets=4)
    other = Indexer(spark, str(root), str(tmp_path / "other"), HashEmbedder(), prefix=False, buckets=4)

    def both():
        q = watch.keep(home, str(tmp_path / "cp"))
        assert q.awaitTermination(180) and q.exception() is None
        other.incremental()
        got, want = ({(r["file_path"], r["chunk_index"], r["text"], r["doc_title"], r["file_size"]) for r in i.store.read().collect()} for i in (home, other))
        assert got == want
        assert {r["file_path"] for r in home.tracker.read().collect()} == {r["file_path"] for r in other.tracker.read().collect()}
        return {os.path.relpath(p, root) for p, *_ in got}

    assert both() == {"a.txt", "b.txt", "sub/c.txt", "sub/x/d.md"}
    os.remove(root / "b.txt")
    put(root / "sub/c.txt", "rewritten", at=1_700_000_000)
    put(root / "g.txt", "g")
    assert both() == {"a.txt", "g.txt", "sub/c.txt", "sub/x/d.md"}
    os.remove(root / "g.txt")
    put(root / "b.txt", "back again")
    assert both() == {"a.txt", "b.txt", "sub/c.txt", "sub/x/d.md"}


def test_a_root_that_is_gone_deletes_nothing(tmp_path):
    reader = watch.ListingReader(str(tmp_path / "none"), [], 4)
    with pytest.raises(OSError, match="cannot be listed"):
        reader.partitions({"at": 0}, reader.latestOffset())


def test_subtrees_list_every_file_once(tmp_path):
    for k in range(3):
        for j in range(3):
            put(tmp_path / f"d{k}/e{j}/f.txt")
        put(tmp_path / f"d{k}/g.txt")
    put(tmp_path / "h.txt")
    put(tmp_path / "skip/i.txt")
    for n in (1, 2, 5, 50):
        reader = watch.ListingReader(str(tmp_path), ["^skip$"], n)
        parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
        found = [os.path.relpath(p, tmp_path) for part in parts for p, *_ in reader.read(part)]
        assert sorted(found) == sorted([f"d{k}/e{j}/f.txt" for k in range(3) for j in range(3)] + [f"d{k}/g.txt" for k in range(3)] + ["h.txt"])


def test_a_large_file_is_cut_in_blocks(spark, tmp_path):
    """Chunks and reasons of files read in blocks are those of whole ones, and no row of what a run stages is longer than a chunk."""
    text = "Ein Satz von vielen. Noch einer! 했 습니다. " * 60_000  # more than two blocks
    for name, raw in (("utf8.txt", text.encode()), ("mark.md", b"\xef\xbb\xbf" + text.encode()), ("wide.txt", text.encode("utf-16")), ("korean.txt", text.encode("cp949")), ("latin.txt", b"caf\xe9 \xff. " * 9), ("empty.txt", b""), ("blank.txt", b" \n"), ("broken.txt", b"\xff\xfe\x00")):
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "large.txt").write_bytes(b"x. " * (3 << 20))
    files = scan.scan(spark, str(tmp_path))
    found = extract.chunk_files(files, 800, 100, max_mb=8).collect()
    whole = {r["file_path"]: r["extraction"] for r in extract.extract_files(files, max_mb=8).collect()}
    for path, e in whole.items():
        rows = sorted((r for r in found if r["file_path"] == path and r["chunk_index"] is not None), key=lambda r: r["chunk_index"])
        last = next(r for r in found if r["file_path"] == path and r["chunk_index"] is None)
        assert [r["chunk_text"] for r in rows] == chunk.split(e["text"], 800, 100), path
        assert (last["success"], last["error"], last["total_chunks"]) == (e["success"], e["error"], len(rows)), path
    assert max(len(r["chunk_text"] or "") for r in found) <= 900 and len(found) > 10_000


def test_hashes_of_words_met_before_sum_as_those_of_new_ones():
    texts = ["many words, many Words", "", None, "other words " * 5000, " ".join(f"w{k}" for k in range(20_000))]
    e = HashEmbedder(16)
    first, again = e.embed(texts), e.embed(texts)
    for row, text in zip(first, texts, strict=True):
        hashes = np.array([h for w in re.findall(r"\w+", (text or "").lower()) for h in _gram_hashes(w)], np.uint64)
        want = np.bincount((hashes % np.uint64(16)).astype(int), np.where(hashes >> np.uint64(63), 1.0, -1.0), 16)
        assert np.allclose(row, want / (np.linalg.norm(want) or 1), atol=1e-6)
    assert (first == again).all() and (HashEmbedder(16).embed(texts[::-1])[::-1] == first).all()


def test_words_of_a_large_vocabulary_are_hashed_once(monkeypatch):
    made, plain = [], embed._gram_hashes
    monkeypatch.setattr(embed, "_gram_hashes", lambda w: made.append(w) or plain(w))
    texts = [" ".join(f"w{k}" for k in range(i, i + 100)) for i in range(0, 100_000, 100)]
    e = HashEmbedder(64)
    assert (e.embed(texts) == e.embed(texts)).all() and len(made) == len(set(made)) == 100_000


def test_codes_that_tell_little_leave_more_candidates(spark, tmp_path):
    """Vectors without any structure, a code of two bytes: nine tenths of the true neighbours are found all the same."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(3000, 32)))], "chunk_id long, embedding array<float>")
    index = VectorIndex(spark, str(tmp_path / "v"), id_type="long", parts=2)
    index.build(rows, "1")
    asked = rows.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    want = {(r["query_id"], r["chunk_id"]) for r in vector.batch_top(rows, asked, 10).collect()}
    got = {(r["query_id"], r["chunk_id"]) for r in index.batch(asked, 10).collect()}
    assert index.manifest()["refine"] > index.refine and len(want & got) >= 0.9 * len(want)
