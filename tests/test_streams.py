"""Streams that are stopped and started again, and state with timers over files in any order."""

import random

import pytest
from pyspark.sql import functions as F

from quire.streaming import stateful, timers

SCHEMA = "k long, t timestamp, e long, r boolean"


@pytest.fixture
def shuffled(spark, tmp_path):
    """Events of few keys in twelve files, whose times overlap in any way."""
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randint(0, 50_000), i, rng.random() < 0.1) for i in range(600)]
    rng.shuffle(rows)
    for i in range(12):
        df = spark.createDataFrame(rows[i * 50 : (i + 1) * 50], "k long, s long, e long, r boolean")
        df.select("k", F.timestamp_seconds("s").alias("t"), "e", "r").coalesce(1).write.parquet(str(tmp_path / "in" / f"part-{i}"))
    return rows, str(tmp_path)


def brute(rows, step, until):
    found = []
    for key in {r[0] for r in rows} - {None}:
        kept = 0
        for _, s, e, r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            kept, ok = step(kept, s * 1000, r)
            if s <= until:
                found.append((key, e, ok))
    return sorted(found)


def run(spark, path, step, folder=None, files=1):
    stream = stateful.event_stream(spark, f"{path}/in/part-", spark.read.parquet(f"{path}/in/part-0").schema, files=files)
    work = timers.answered(stream, "k", "t", "e", F.col("r"), step, "60000 seconds")
    return sorted(map(tuple, stateful.drained(work, f"t{random.random()}".replace(".", ""), folder).collect()))


def close(spark, path, name, at=200_000):
    """A late event of a key of its own moves the watermark past all others."""
    spark.createDataFrame([(99, at, 10_000, False)], "k long, s long, e long, r boolean").select("k", F.timestamp_seconds("s").alias("t"), "e", "r").coalesce(1).write.parquet(f"{path}/in/part-{name}")


@pytest.mark.parametrize("step", [timers.revocation(900_000), timers.in_flight(2_000_000)])
def test_answers_are_those_of_all_events_in_order(spark, shuffled, step):
    rows, path = shuffled
    close(spark, path, "z")
    assert run(spark, path, step, files=5) == brute(rows, step, 140_000)


def test_a_stream_that_is_started_again_loses_and_repeats_nothing(spark, shuffled):
    rows, path = shuffled
    folder, step = f"{path}/work", timers.in_flight(2_000_000)
    assert run(spark, path, step, folder, files=6) == []
    close(spark, path, "z")
    first = run(spark, path, step, folder, files=6)
    assert first == brute(rows, step, 140_000) and run(spark, path, step, folder, files=6) == first


def test_a_batch_that_failed_is_replaced(spark, shuffled):
    """The step fails after a batch was written in part; the stream goes on in its folder, with its tokens."""
    rows, path = shuffled
    whole = stateful.event_stream(spark, f"{path}/in/part-", spark.read.parquet(f"{path}/in/part-0").schema, files=4)
    work = stateful.token_bucket(whole, "k", "t", "e", 1 / 600, 3.0)
    folder, good = f"{path}/bucket", work.step

    def failing(batch, number, at):
        found = good(batch, number, at)
        if number == 1:
            found.limit(3).write.parquet(f"{at}/batch-1")
            raise ValueError("the machine is gone")
        return found

    work.step = failing
    with pytest.raises(Exception, match="gone"):
        stateful.drained(work, "bucket_a", folder)
    work.step = good
    found = sorted(map(tuple, stateful.drained(work, "bucket_b", folder).collect()), key=str)
    again = sorted(map(tuple, stateful.drained(stateful.token_bucket(whole, "k", "t", "e", 1 / 600, 3.0), "bucket_c").collect()), key=str)
    assert len(found) == 600 and found == again


def test_settings_of_the_session_stay(spark, shuffled):
    before = spark.conf.get(timers.PROVIDER, None)
    run(spark, shuffled[1], timers.revocation(1000), files=12)
    assert spark.conf.get(timers.PROVIDER, None) == before


def test_a_key_costs_few_calls_of_its_state():
    """Each call of a key's state is a round trip of its own."""
    from unittest.mock import MagicMock

    import pandas as pd

    from quire.streaming import timers

    made = timers.InOrder(timers.in_flight(10))
    made.init(handle := MagicMock())
    made.waiting, made.kept, clock = MagicMock(), MagicMock(), MagicMock()
    rows = pd.DataFrame({"ms": [5, 7], "event": [1, 2], "marks": [False, False]})
    assert not list(made.handleInputRows((3,), iter([rows]), clock))
    made.waiting.appendList.assert_called_once_with([(5, 1, False), (7, 2, False)])
    made.waiting.get.return_value, made.kept.get.return_value = iter([(5, 1, False), (7, 2, False)]), None
    clock.getCurrentWatermarkInMs.return_value = 100
    found = pd.concat(made.handleExpiredTimer((3,), clock, None))
    assert found.values.tolist() == [[3, 1, True], [3, 2, False]] and [str(t) for t in found.dtypes] == ["int64", "int64", "bool"]
    assert len(made.waiting.mock_calls) + len(made.kept.mock_calls) <= 4
    handle.registerTimer.assert_called_once_with(5)
