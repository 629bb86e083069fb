"""Column functions on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from evidence_engine.functions import text, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "tokens"),
    [("Hello, World_1!", ["hello", "world_1"]), ("检索", ["检索", "检索"]), ("字", ["字"]), ("AI检", ["ai检", "ai", "i检"]), ("", []), ("²①", ["²①"]), ("a·b", ["a", "b"])],
)
def test_tokenize(spark, given, tokens):
    assert one(spark, text.tokenize(F.lit(given))) == tokens


def test_forms(spark):
    assert one(spark, text.strip(F.lit("　\t a b \n"))) == "a b"
    assert one(spark, text.without_space(F.lit(" A　b\n"))) == "ab"
    assert one(spark, text.alnum_or_han(F.lit("A-b 检!"))) == "ab检"
    assert one(spark, text.char_grams(F.lit("视频中 abcdea"), ("视频中",))) == ["abcd", "bcde", "cdea"]
    assert one(spark, text.char_grams(F.lit("abc"))) == []
    assert one(spark, text.searchable_text(F.lit(" hi "), F.lit("  "))) == "[ASR] hi"
    assert one(spark, text.searchable_text(F.lit(None).cast("string"), F.lit("cap"))) == "[视觉] cap"
    assert one(spark, text.video_of_segment(F.lit("a_b_0001"))) == "a_b"
    assert one(spark, text.frame_identifier(F.lit("v"), F.lit(17.0), F.lit("p.jpg"))) == __import__("hashlib").sha256(b"v\x0017.000\x00p.jpg").hexdigest()[:24]
    assert one(spark, text.safe_filename(F.lit(7), F.lit("..a b?c"), F.lit(".exe"))) == "007_a_b_c.webm"
    assert one(spark, text.json_array_in(F.lit("x [1, 2] y"))) == "[1, 2]"
    assert one(spark, text.rerank_document(F.lit("s"), F.lit(1.0), F.lit(2.5), F.lit("t"))) == "Segment ID: s\nTime: 1.000-2.500 seconds\nt"


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vectors.normalize(v)) == [0.6, 0.8] and one(spark, vectors.norm(v)) == 5.0
    with pytest.raises(Exception, match="no direction"):
        one(spark, vectors.normalize(F.array(F.lit(0.0), F.lit(0.0))))
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 5.0])], "k int, v array<float>")
    assert {r["k"]: r["v"] for r in vectors.mean_by(df, "k", "v").collect()} == {1: [2.0, 3.0], 2: [5.0, 5.0]}
    bits = spark.createDataFrame([([float(i % 7) for i in range(64)],)], "v array<float>").select(vectors.sign_hash(F.col("v")).alias("h")).first()["h"]
    values = [float(i % 7) for i in range(64)]
    median = sorted(values)[31] / 2 + sorted(values)[32] / 2
    assert bits & (2**64 - 1) == int("".join("1" if x > median else "0" for x in values), 2)
    assert one(spark, vectors.hamming(F.lit(5), F.lit(6))) == 2 and math.isclose(one(spark, vectors.dot(v, v)), 25.0)


def test_char_grams_go_through_a_text_once(spark):
    """A text of 40,000 characters, which took over a minute when every place cut the text anew."""
    import time

    long = "".join(chr(97 + (i * i // 7 + i) % 26) for i in range(40_000))
    df = spark.createDataFrame([(long,)], "t string").select(text.char_grams(F.col("t"), ("the",)).alias("g"))
    began = time.perf_counter()
    got = df.first()[0]
    left = long.replace("the", "")
    assert set(got) == {left[i : i + 4] for i in range(len(left) - 3)} and len(got) == len(set(got))
    assert time.perf_counter() - began < 20
    assert one(spark, text.char_grams(F.lit(None).cast("string"))) == []


def test_sign_hash_sorts_a_vector_once(spark):
    """20,000 vectors; 10,256 took 24 s when every component sorted the vector anew."""
    import time

    v = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (F.pmod(F.xxhash64("id", i), F.lit(1000)) / 1000).cast("float"))
    df = spark.range(0, 20_000, 1, 4).select("id", v.alias("v"))
    began = time.perf_counter()
    got = df.select("v", vectors.sign_hash(F.col("v")).alias("h")).where("id % 500 = 0").collect()
    assert df.agg(F.bit_xor(vectors.sign_hash(F.col("v")))).first()[0] is not None
    assert time.perf_counter() - began < 10
    for r in got:
        mid = sorted(r["v"])
        assert r["h"] & ((1 << 64) - 1) == int("".join("1" if x > (mid[31] + mid[32]) / 2 else "0" for x in r["v"]), 2)
