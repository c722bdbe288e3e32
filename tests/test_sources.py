"""Readers, writers and exports go there and back."""

from datetime import datetime

import pytest

from penprint.functions.arrays import parse_time
from penprint.operators import features
from penprint.sources import corpus
from pyspark.sql import functions as F


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'dice "hola", y\nsalta', "a"), (2, "ñ,;", "b")]
    df = spark.createDataFrame(rows, "id long, text string, author string")
    corpus.write_corpus(df, str(tmp_path / "c"), "csv")
    back = corpus.read_corpus(spark, str(tmp_path / "c"), "id long, text string, author string", "csv")
    assert sorted(map(tuple, back.collect())) == rows


def test_compute_only_when_missing(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for refresh in (False, False, True):
        assert corpus.read_or_compute(spark, str(tmp_path / "t"), compute, refresh).count() == 3
    assert len(calls) == 2


def test_author_export(spark, tmp_path):
    rows = [(i, "train", f"@user{i % 2}", f"a < b & {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, s string, label string, text string")
    parts = corpus.author_documents(df, "s", "label", "id", "text", part_characters=60).collect()
    assert len(parts) > 2 and sorted(i for r in parts for i in r["ids"]) == list(range(40))
    corpus.export_author_documents(df, str(tmp_path), "one", "s", "label", "id", "text")
    back = spark.read.format("xml").option("rowTag", "author").load(str(tmp_path / "task=one/split=train/texts"))
    assert sorted(t for r in back.collect() for t in r["document"]) == sorted(r[3] for r in rows)


def test_date_bounds_reach_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, datetime(2020, 1, 1)), (2, datetime(2020, 12, 31, 23, 59)), (3, datetime(2021, 1, 1))], "id long, ts timestamp_ntz")
    df.write.parquet(str(tmp_path / "d"))
    kept = corpus.date_range(spark.read.parquet(str(tmp_path / "d")), "ts", "2020-01-01", "2020-12-31")
    assert sorted(r["id"] for r in kept.collect()) == [1, 2]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_vocabulary_is_stored(spark, tmp_path):
    vocabulary = features.fit_vocabulary(spark.createDataFrame([("a b a",)], "t string"), "t", num_words=9)
    vocabulary.save(str(tmp_path / "v"))
    back = features.Vocabulary.load(spark, str(tmp_path / "v"))
    assert (back.documents, back.maxlen, back.num_words) == (1, 3, 9)
    assert sorted(map(tuple, back.table.collect())) == sorted(map(tuple, vocabulary.table.collect()))


def test_a_table_without_a_success_mark_is_computed_again(spark, tmp_path):
    corpus.write_corpus(spark.range(2), str(tmp_path / "t"))
    (tmp_path / "t" / "_SUCCESS").rename(tmp_path / "gone")
    assert corpus.read_or_compute(spark, str(tmp_path / "t"), lambda: spark.range(5)).count() == 5


def test_strict_times_follow_the_pattern(spark):
    df = spark.createDataFrame([("02.01.2020",)], "w string")
    assert df.select(parse_time(F.col("w"), "dd.MM.yyyy", strict=True)).first()[0] == datetime(2020, 1, 2)
    with pytest.raises(Exception, match="CANNOT_PARSE"):
        df.select(parse_time(F.col("w"), strict=True)).collect()


def test_counts_and_helpers_come_back(spark, tmp_path):
    table = spark.createDataFrame([("a", 3), ("b", 1)], "author string, count long")
    corpus.export_counts({"authors": table, "again": table.where("count > 1")}, str(tmp_path))
    back = corpus.read_helper(spark, str(tmp_path / "authors"), "author string, count long")
    assert sorted(map(tuple, back.collect())) == [("a", 3), ("b", 1)]
    assert corpus.read_helper(spark, str(tmp_path / "again"), table.schema).count() == 1


def test_unreadable_times_are_null(spark):
    df = spark.createDataFrame([("2020/01/02 03:04:05",), ("no",)], "w string").select(parse_time(F.col("w")).alias("t"))
    assert [r["t"] for r in df.collect()] == [datetime(2020, 1, 2, 3, 4, 5), None]
