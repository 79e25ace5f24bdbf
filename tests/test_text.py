import math

import pytest
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.plans import schema as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("q", "name", "score"), [("tide", "tide", 1.0), ("load", "load_spring_tides", 0.9), ("table", "tide_table", 0.9), ("tide", "spring_tide_tables_x", 0.5 + 0.4 * 4 / 20), ("é", "aéb", 0.5 + 0.4 * 2 / 4)])
def test_literal_score(spark, q, name, score):
    assert one(spark, X.literal_score(F.lit(q), F.lit(name))) == pytest.approx(score)


def test_query_words():
    assert X.query_words("or ebb NOT flow and moon Near") == ["ebb", "flow", "moon"]
    assert X.query_words("tide_table/2024 harbour!") == ["tide_table", "2024", "harbour"]
    assert X.query_words("AND OR NOT near") == []
    assert len(X.query_words(" ".join("abcdefghijklmn"))) == 10
    assert X.query_words("日本go") == ["日", "本", "go"]


@pytest.mark.parametrize(("raw", "score"), [(-5.0, 1 - 1 / 6), (-10.0, 1 - 1 / 11), (0.0, 0.5), (0.0005, 0.5)])
def test_bm25_normal(spark, raw, score):
    assert one(spark, X.bm25_normal(F.lit(raw))) == pytest.approx(score)


def test_vector(spark):
    assert one(spark, X.vector_tokens(F.lit("my a load_tide_table é"))) == ["my", "load_tide_table", "é"]
    pair = lambda a, b: one(spark, X.cosine_with(X.hash_vector(X.vector_tokens(F.lit(a))), X.query_vector(b)))
    assert pair("spring tide table load", "load spring table") > 0.4
    assert pair("spring tide table load", "paint wooden fence") < 0.4
    assert pair("same words same", "same words same") == pytest.approx(1.0)
    assert X.query_vector("a ! ?") is None


@pytest.mark.parametrize(("text", "tokens"), [("one two three four", 6), ("", 0), ("  a\tb\nc ", 4)])
def test_token_estimate(spark, text, tokens):
    assert one(spark, X.token_estimate(F.lit(text))) == tokens == math.ceil(4 * len(text.split()) / 3)


@pytest.mark.parametrize(("text", "start", "end", "part"), [("a\nb\nc\n", 2, 3, "b\nc"), ("a\r\nb", None, None, "a\nb"), ("a\nb", 0, 0, "a\nb"), ("a\nb", 5, 9, ""), ("a\nb\nc", 2, 99, "b\nc"), ("", 1, 1, ""), ("a\nb\nc", 3, 2, "")])
def test_lines(spark, text, start, end, part):
    assert one(spark, X.line_slice(F.lit(text), F.lit(start).cast("int"), F.lit(end).cast("int"))) == part


def test_line_count(spark):
    assert [one(spark, X.count_lines(F.lit(t))) for t in ("", "a", "a\n", "a\n\n", "a\r\nb")] == [0, 1, 1, 2, 2]


def test_fts_tokens(spark):
    assert one(spark, X.fts_tokens(F.lit("My_Func É東京 x1"))) == ["my", "func", "e", "東", "京", "x1"]
    assert X.fts_phrase("My_Func") == ["my", "func"]


@pytest.mark.parametrize(("text", "seconds"), [("24h", 86400), ("7d", 604800), ("1h", 3600), ("all", None), ("yesterday", None)])
def test_since(text, seconds):
    assert X.parse_since(text) == seconds


def test_types(spark):
    assert S.parse_type("mystery", S.NODE_TYPES, S.NODE_DEFAULT) == "concept"
    assert S.parse_type("calls", S.EDGE_TYPES, S.EDGE_DEFAULT) == "calls"
    assert one(spark, S.typed(F.lit("unknown_type"), S.FACT_TYPES, S.FACT_DEFAULT)) == "decision"
    assert one(spark, X.percent(F.lit(93.5185))) == "93.5%"
