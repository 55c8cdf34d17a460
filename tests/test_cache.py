"""The bucketed order cache against merging everything."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tallyweave.operators import enrich
from tallyweave.sinks import cache

SHAPE = "order_id string, vtex_store string, status string, fetched_at timestamp_ntz"


def _answers(spark, ids, mark, day):
    rows = [(i, f"{mark} {i}", "found") for i in ids]
    at = F.lit(f"2025-01-{day:02}").cast("timestamp_ntz")
    return spark.createDataFrame(rows, "order_id string, vtex_store string, status string").withColumn("fetched_at", at)


def _content(df):
    return Counter(tuple(r) for r in df.select("order_id", "vtex_store", "status", "fetched_at").collect())


def _files(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_updates_rewrite_the_touched_buckets(spark, tmp_path):
    path = tmp_path / "cache"
    first = _answers(spark, [str(i) for i in range(10_000)] + ["abc", "x-y"], "old", 1)
    assert len(cache.update_cache(str(path), first, span=100)) == 102
    before = _files(path)
    # one in a hundred: the latest orders, one with a suffix, one of them older than what is known
    fresh = _answers(spark, [str(i) for i in range(9900, 9999)] + ["9901-02"], "new", 2)
    assert cache.update_cache(str(path), fresh, span=100) == ["n99"]
    after = _files(path)
    assert len(set(before) - set(after)) == len(set(after) - set(before)) == 1
    assert all(after[p] == t for p, t in before.items() if p in after)
    schema = first.schema
    assert _content(cache.read_cache(spark, str(path), schema)) == _content(enrich.upsert_cache(first, fresh))


def test_any_order_of_updates_keeps_the_latest_answer(spark, tmp_path):
    rng = random.Random(4)
    path, schema = str(tmp_path / "cache"), None
    merged = None
    for day in (3, 1, 2):
        fresh = _answers(spark, {str(rng.randrange(300)) for _ in range(120)} | {f"k{day % 2}"}, f"d{day}", day)
        cache.update_cache(path, fresh, span=50)
        merged = fresh if merged is None else enrich.upsert_cache(merged, fresh)
        schema = fresh.schema
    assert _content(cache.read_cache(spark, path, schema)) == _content(merged)
    cache.update_cache(path, fresh, span=50)  # repeated after a failure
    assert _content(cache.read_cache(spark, path, schema)) == _content(merged)


def test_an_absent_cache_is_empty(spark, tmp_path):
    assert cache.read_cache(spark, str(tmp_path / "none"), _answers(spark, ["1"], "a", 1).schema).count() == 0


def test_only_touched_folders_are_read(spark, tmp_path):
    path = str(tmp_path / "cache")
    first = _answers(spark, [str(i) for i in range(500)], "old", 1)
    cache.update_cache(path, first, span=100)
    pruned = cache.read_cache(spark, path, first.schema).where(F.col(cache.BUCKET).isin(["n3"]))
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "cache_bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert pruned.count() == 100
