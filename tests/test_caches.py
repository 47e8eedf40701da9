"""Caches and session stores as state: rows of plain loops, over restarts between batches."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from cadenza.streaming import caches
from cadenza.streaming.pipelines import drain

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def keyed_state(spark):
    name, provider = caches.STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    yield
    spark.conf.set(name, before)


def _run(spark, tmp_path, batches, schema, query):
    """The rows of a query that is started anew for every batch."""
    out, log = [], tmp_path / "log"
    log.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(log))
        stream = spark.readStream.schema(schema).parquet(str(log))
        drain(query(stream), lambda df, _: out.extend(tuple(r) for r in df.collect()), str(tmp_path / "check"))
    return out


def _times(rng, n, most_s):
    return sorted(rng.sample(range(most_s), n))


def test_cached_lookups(spark, tmp_path, keyed_state):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), START + timedelta(seconds=s)) for s in _times(rng, 120, 40_000)]
    rows[60:60] = [(None, START), ("a", None)]
    got = _run(spark, tmp_path, [rows[:50], rows[50:90], rows[90:]], "key string, ts timestamp", lambda s: caches.cached_lookups(s, 3_000_000))
    stored, want = {}, []
    for key, ts in rows:
        if key is None or ts is None:
            continue
        at = int(ts.timestamp() * 1000)
        hit = key in stored and at - stored[key] <= 3_000_000
        if not hit:
            stored[key] = at
        want.append((key, at, hit))
    assert sorted(got) == sorted(want) and {w[2] for w in want} == {True, False}
    batch = spark.createDataFrame([(k, a) for k, a, _ in want], "key string, at_ms bigint")
    totals = caches.cache_hits(batch, 3_000_000).groupBy("key").agg(F.sum("hits").alias("h"), F.sum("lookups").alias("n")).collect()
    assert {r["key"]: (r["h"], r["n"]) for r in totals} == {k: (sum(w[2] for w in want if w[0] == k), sum(w[0] == k for w in want)) for k in "abc"}


@pytest.mark.parametrize("sweep_ms", [0, 500_000])
def test_evicted_stream(spark, tmp_path, keyed_state, sweep_ms):
    rng = random.Random(sweep_ms)
    rows = [(rng.choice("xxy"), rng.choice("abcdefg"), START + timedelta(seconds=s)) for s in _times(rng, 150, 30_000)]
    got = _run(spark, tmp_path, [rows[:70], rows[70:80], rows[80:]], "store string, session string, ts timestamp", lambda s: caches.evicted_stream(s, 3, 1_500_000, sweep_ms))
    live, swept, want = {"x": {}, "y": {}}, {"x": 0, "y": 0}, []
    for store, session, ts in rows:
        at, own = int(ts.timestamp() * 1000), live[store]

        def sweep():
            for s in [s for s in own if at - own[s] > 1_500_000]:  # noqa: B023
                want.append((store, s, own.pop(s), "ttl"))  # noqa: B023
            while len(own) > 3:  # noqa: B023
                s = min(own, key=own.get)  # noqa: B023
                want.append((store, s, own.pop(s), "lru"))  # noqa: B023

        if sweep_ms <= 0 or at - swept[store] >= sweep_ms:
            swept[store] = at
            sweep()
        new = session not in own
        own[session] = at
        if new and len(own) > 3:
            sweep()
    assert sorted(got) == sorted(want) and {w[3] for w in want} == {"ttl", "lru"}
