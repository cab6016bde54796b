from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.operators import chunk

SENTENCE = st.text(alphabet="ab 다요.!?", min_size=0, max_size=60)


def test_short_paragraphs_are_glued():
    assert chunk.split("one\n\ntwo", 800, 0) == ["onetwo"]


def test_sentences():
    assert chunk.sentences("Das ist foo . Und 3.14 ja") == ["Das ist foo.", "Und 3.", "14 ja"]
    assert chunk.sentences("했 습니다. 네") == ["했습니다.", "네"]
    assert chunk.sentences("   ") == [""]


def test_forced_split_prefers_spaces():
    assert chunk.split("aaa bbb ccc ddd", 8, 0) == ["aaa bbb", "ccc ddd"]
    assert chunk.split("abcdefghij", 4, 0) == ["abcd", "efgh", "ij"]


def test_forced_pieces_stand_alone():
    assert chunk.split("ab. " + "x" * 12 + ". cd.", 8, 0) == ["ab.", "xxxxxxxx", "xxxx.", "cd."]


def test_overlap_is_of_the_packed_chunk():
    assert chunk.overlapped(["abcdef", "gh", "ij"], 4) == ["abcdef", "cdefgh", "ghij"]
    assert chunk.overlapped(["abc"], 4) == ["abc"]


def test_nothing():
    assert chunk.split(None) == [] and chunk.split(" \n\n ") == []


@settings(max_examples=300, deadline=None)
@given(st.lists(SENTENCE, max_size=12), st.integers(3, 30), st.integers(0, 10))
def test_properties(parts, size, overlap):
    text = "".join(parts)
    plain = chunk.split(text, size, 0)
    assert all(0 < len(c) <= size for c in plain)
    assert "".join("".join(plain).split()) == "".join(text.split())
    full = chunk.split(text, size, overlap)
    assert len(full) == len(plain) and all(len(c) <= size + overlap for c in full)


def test_spark_forms_agree(spark):
    chunk.register(spark)
    texts = ["a. " * 500, "", "b" * 2000, None, "x\n\ny"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    from pyspark.sql import functions as F

    arrays = {r[0]: r[1] for r in df.select("i", chunk.chunks(F.col("text"), 800, 100)).collect()}
    df.createOrReplaceTempView("chunk_docs")
    rows = spark.sql("select i, chunk_index, chunk from chunk_docs, lateral chunk_text(text, 800, 100) order by i, chunk_index").collect()
    for i, t in enumerate(texts):
        assert arrays[i] == chunk.split(t) == [r[2] for r in rows if r[0] == i]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text(alphabet="ab 다요습니세.!?\n", max_size=40), max_size=12), st.integers(1, 7), st.integers(3, 30), st.integers(0, 10))
def test_a_text_in_pieces_is_cut_as_the_whole(parts, step, size, overlap):
    text = "".join(parts)
    pieces = [text[i : i + step] for i in range(0, len(text), step)]
    assert list(chunk.stream(pieces, size, overlap)) == chunk.split(text, size, overlap)
