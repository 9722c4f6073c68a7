from pyspark.sql import functions as F

from talweg.operators import stats, tables


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_updates(spark):
    base = spark.createDataFrame([("1", "a", 1), ("2", "b", None)], "id string, name string, n int")
    patch = spark.createDataFrame([("1", None, 5), ("9", "x", 9)], "id string, name string, n int")
    assert rows(tables.update(base, patch), "id", "name", "n") == [("1", "a", 5), ("2", "b", None)]
    assert rows(tables.update(base, patch, allowed=["name"]).fillna(0), "id", "n") == [("1", 1), ("2", 0)]
    flags = spark.createDataFrame([("1", None, True)], "id string, name string, has_name boolean")
    assert rows(tables.update_present(base, flags), "id", "name")[0] == ("1", None)
    filled = tables.fill_empty(base, spark.createDataFrame([("1", "z", 7), ("2", " ", 8)], "id string, name string, n int"), "id", replace=["name"])
    assert rows(filled, "id", "name", "n") == [("1", "z", 1), ("2", "b", 8)]


def test_delete_synchronise_replace(spark, tmp_path):
    base = spark.createDataFrame([("1", "a", 1), ("1", "b", 2), ("2", "a", 3)], "job string, kind string, n int")
    assert rows(tables.delete(base, spark.createDataFrame([("1", "a"), ("1", "a")], "job string, kind string")), "job", "kind") == [("1", "b"), ("2", "a")]
    want = spark.createDataFrame([("1", "a", 9), ("1", "c", 4)], "job string, kind string, n int")
    assert rows(tables.synchronise(base, want, ["job"], "kind"), "job", "kind", "n") == [("1", "a", 9), ("1", "c", 4), ("2", "a", 3)]
    gone = spark.createDataFrame([("1", None, None)], "job string, kind string, n int")
    assert rows(tables.synchronise(base, gone, ["job"], "kind"), "job", "kind") == [("2", "a")]
    path = str(tmp_path / "t")
    tables.replace_partitions(base, path, "job")
    tables.replace_partitions(want, path, "job")
    assert rows(spark.read.parquet(path), "job", "kind") == [(1, "a"), (1, "c"), (2, "a")]


def test_lists(spark):
    df = spark.createDataFrame([("1", "Ann", " A@X.y ", None, 1), ("2", None, None, "an", 2), ("3", "Bob", "a@x.y", "x", 3)], "id string, name string, email string, summary string, updated_at int")
    assert rows(df.where(tables.contains_any("AN", "name", "email", "summary")), "id") == [("1",), ("2",)]
    assert rows(df.where(tables.contains_any("b_b", "name")), "id") == [("3",)]
    assert tables.lookup_email(df, "A@x.Y ").first()["id"] == "3"
    assert rows(tables.page(df, [F.asc("id")], 1, 1), "id") == [("2",)]
    assert rows(df.where(tables.all_of(None, F.col("updated_at") >= 2)), "id") == [("2",), ("3",)]
    asked = spark.createDataFrame([(0, "3"), (1, "9"), (2, "3"), (3, "1")], "position int, id string")
    assert [r["id"] for r in tables.in_order(asked, df).collect()] == ["3", "3", "1"]
    assert rows(tables.by_ids(df, asked.limit(0)), "id") == []
    nested = spark.createDataFrame([("1", ["Kafka"]), ("2", None)], "id string, skills array<string>")
    assert rows(nested.where(tables.json_contains("skills", "kAfKa")), "id") == [("1",)]
    newest = tables.newest(df.withColumn("k", F.lit("k")), "k", "updated_at", "id")
    assert newest.first()["id"] == "3"
    added = tables.insert(df.select("id", "email").limit(0), df.select("id", "email")).fillna("none")
    assert rows(added, "id", "email") == [("1", "a@x.y"), ("2", "none"), ("3", "a@x.y")]
    assert tables.first_of(df, "email", F.col("updated_at") > 1, [F.asc("updated_at")]).count() == 2


def test_stats(spark):
    log = spark.createDataFrame([(1, "completed", 0.0, 10, "m"), (2, "completed", 0.0, None, None), (3, "pending", 9.0, 1, "m"), (4, "failed", None, 1, "k")], "id int, status string, score double, duration_ms int, model string").withColumn("ts", F.lit("2024-01-01 10:30:00").cast("timestamp"))
    s = stats.evaluation_statistics(log, ["score"]).first()
    assert (s["completed_count"], s["pending_count"], s["failed_count"], s["avg_score"], s["avg_duration_ms"]) == (2, 1, 1, None, 10.0)
    empty = stats.usage_summary(log.limit(0), "ts", ["id"], ["id"]).first()
    assert (empty["row_count"], empty["sum_id"], empty["avg_id"], empty["period_start"]) == (0, 0, 0.0, None)
    assert stats.usage_by_time(log, "ts", ["id"], "other").count() == 1
    assert rows(stats.distribution(log, "model", "id", unknown="unknown"), "model", "sum_id") == [("k", 4), ("m", 4), ("unknown", 2)]
    hit = stats.alerts(log, {"score": 1.0, "duration_ms": 5.0}, "ts", "id").collect()
    assert [(r["id"], r["violated"]) for r in hit] == [(1, ["score"]), (2, ["score"])]
    assert [r["model"] for r in stats.distinct_values(log, "model").collect()] == ["k", "m"]
    assert stats.trends(log, "ts", ["score"], "hour").first()["row_count"] == 4
