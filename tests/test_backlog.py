"""Rows are held back until there are enough or they have waited long enough, across restarts."""

import pytest

from radloom.streaming.backlog import HoldBack, with_ticks, without_ticks
from radloom.streaming.microbatch import read_events, run


class Clock:
    now = 1000.0

    def __call__(self):
        return self.now


@pytest.fixture
def hold(tmp_path):
    return HoldBack(str(tmp_path / "backlog"), at_least=5, at_most=60, clock=Clock())


@pytest.fixture
def seen():
    return []


def into(seen):
    return lambda df, number: seen.append((number, sorted(r.id for r in df.collect())))


def test_released_by_size(spark, hold, seen):
    arrive = hold.handler(into(seen))
    for n, (lo, hi) in enumerate([(0, 3), (3, 4), (4, 4), (4, 9), (9, 11)]):
        arrive(spark.range(lo, hi), n)
    assert seen == [(0, list(range(9)))]
    assert sum(w["rows"] for w in hold.waiting(spark).values()) == 2
    assert hold.tidy(spark) == 4 and hold.tidy(spark) == 0


def test_released_by_age(spark, hold, seen):
    arrive = hold.handler(into(seen))
    arrive(spark.range(2), 0)
    hold.clock.now += 59
    arrive(spark.range(2, 3), 1)
    assert not seen and not hold.release_due(spark, into(seen))
    hold.clock.now += 1  # the oldest row counts
    assert hold.release_due(spark, into(seen)) and seen == [(0, [0, 1, 2])]
    hold.clock.now += 1000
    arrive(spark.range(0), 2)
    assert len(seen) == 1 and not hold.release_due(spark, into(seen))


def test_a_break_between_release_and_handler_repeats_the_same_release(spark, hold, seen):
    def broken(df, number):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        hold.handler(broken)(spark.range(6), 0)
    again = HoldBack(hold.path, 5, 60, hold.clock)  # a new run
    again.handler(into(seen))(spark.range(6), 0)  # the stream repeats the batch
    again.handler(into(seen))(spark.range(6, 7), 1)
    assert seen == [(0, list(range(6)))] and sum(w["rows"] for w in again.waiting(spark).values()) == 1


def test_a_stream_over_two_runs(spark, hold, seen, tmp_path):
    source = tmp_path / "in"
    for lo, hi, released in ((0, 3, []), (3, 6, [(0, list(range(6)))])):
        spark.range(lo, hi).coalesce(1).write.mode("append").json(str(source))
        run(read_events(spark, str(source), spark.range(1).schema), hold.handler(into(seen)), str(tmp_path / "checkpoint")).awaitTermination(60)
        assert seen == released


def test_ticks_release_old_rows_while_nothing_arrives(spark, tmp_path, seen):
    import time

    hold = HoldBack(str(tmp_path / "backlog"), at_least=100, at_most=2)
    spark.range(3).coalesce(1).write.json(str(tmp_path / "in"))
    stream = with_ticks(read_events(spark, str(tmp_path / "in"), spark.range(1).schema))
    query = run(stream, without_ticks(hold.handler(into(seen))), str(tmp_path / "checkpoint"), every="1 second")
    try:
        end = time.time() + 60
        while not seen and time.time() < end:
            time.sleep(0.5)
    finally:
        query.stop()
    assert seen == [(0, [0, 1, 2])]
