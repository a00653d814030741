"""Histories that stand idle: emptied by a timer, begun afresh after a gap, late rows left out, state kept over a restart."""

import datetime as dt

import pytest

from folio.streaming import streams as L

SCHEMA = "tenant_id string, employee_id long, seq long, role string, content string, ts timestamp, version int"
START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, L.STATE_STORE)
    yield
    spark.conf.set(name, before)


def feed(spark, tmp_path, rows, ttl=100, kept=3):
    """One file and one start of the stream: it goes on from its checkpoint."""
    data = [("t", who, seq, "user", f"m{seq}", START + dt.timedelta(seconds=at), 7) for who, seq, at in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    L.history_stream(stream, str(tmp_path / "out"), str(tmp_path / "log"), kept, ttl, "10 seconds").awaitTermination()
    out: dict[int, list[int]] = {}
    for r in L.history(spark, str(tmp_path / "out")).collect():
        out.setdefault(r.employee_id, []).append(r.seq)
    return {k: sorted(v) for k, v in out.items()}


def test_idle_keys_are_emptied_and_the_state_outlives_a_restart(spark, store, tmp_path):
    assert feed(spark, tmp_path, [(1, 1, 0), (1, 2, 5), (2, 3, 0), (1, 4, 6), (1, 5, 7)]) == {1: [2, 4, 5], 2: [3]}
    assert feed(spark, tmp_path, [(1, 6, 60)]) == {1: [4, 5, 6], 2: [3]}  # what came before the restart is still there
    assert feed(spark, tmp_path, [(3, 7, 150)]) == {1: [4, 5, 6], 3: [7]}  # time is 140: 2 stood idle from 0, 1 only from 60
    assert feed(spark, tmp_path, [(2, 8, 151), (3, 9, 152)]) == {1: [4, 5, 6], 2: [8], 3: [7, 9]}
    # Time is 142: a row of 100 is late and left out, one of 145 is not; rows of a key come in any order.
    assert feed(spark, tmp_path, [(2, 10, 100), (2, 11, 153), (2, 12, 145)])[2] == [8, 11, 12]
    assert feed(spark, tmp_path, [(4, 13, 1000)]) == {4: [13]}


def test_a_gap_within_a_batch_begins_afresh(spark, store, tmp_path):
    assert feed(spark, tmp_path, [(1, 1, 0), (1, 2, 99), (1, 4, 300), (1, 3, 199)], ttl=100) == {1: [4]}
    assert feed(spark, tmp_path / "b", [(1, 1, 0), (1, 2, 99), (1, 3, 198)], ttl=100, kept=40) == {1: [1, 2, 3]}
