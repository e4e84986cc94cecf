"""Late rows and closed sessions, with one file to a trigger."""

import datetime
import os

from fathomline.streaming import dialogue, twins, voyage_join

DAY = datetime.datetime(2024, 3, 1)


def events_of(spark, folder, batches):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    for i, hours in enumerate(batches):
        rows = [(100 * i + j, DAY + datetime.timedelta(hours=h), user, "view", 1.0, None) for j, (user, h) in enumerate(hours)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/events.parquet/{i}")
        # files are read in the order of their times
        for f in (folder / "events.parquet" / str(i)).glob("part-*.parquet"):
            f.rename(folder / "events.parquet" / f"{i}.parquet")
            os.utime(folder / "events.parquet" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return twins.events_stream(spark, str(folder), files_per_trigger=1)


def test_sessions_close_once_and_late_rows_are_dropped(spark, tmp_path):
    # user 1: a session, and two more events of it that come in time; user 2's event at hour 1 comes two days late
    stream = events_of(spark, tmp_path, [[(1, 0), (1, 3)], [(1, 8), (1, 13)], [(3, 60)], [(3, 61)], [(2, 1), (3, 62)], [(3, 120)]])
    got = {(r["user_id"], r["n"]) for r in twins.appended(twins.sessions(stream)).collect()}
    assert got == {(1, 4), (3, 3)}


def test_repeats_within_the_watermark(spark, tmp_path):
    stream = events_of(spark, tmp_path, [[(1, 0), (1, 0), (2, 0)], [(1, 0), (2, 1)], [(1, 9)], [(1, 0)]])
    got = sorted((r["user_id"], (r["minute"] - DAY).total_seconds() / 3600) for r in twins.appended(twins.first_of_minute(stream)).collect())
    assert got == [(1, 0), (1, 9), (2, 0), (2, 1)]


def turns_of(spark, folder, files):
    """Files of (conv_id, turn, role, characters), a day apart."""
    for i, rows in enumerate(files):
        made = [(c, t, role, None if n is None else "x" * n) for c, t, role, n in rows]
        spark.createDataFrame(made, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet/{i}")
        for f in (folder / "conversations.parquet" / str(i)).glob("part-*.parquet"):
            target = folder / "conversations.parquet" / f"{i}.parquet"
            f.rename(target)
            os.utime(target, (1_700_000_000 + 86_400 * i, 1_700_000_000 + 86_400 * i))
    return dialogue.turns_stream(spark, str(folder), files_per_trigger=1)


def test_dialogues_go_on_and_late_turns_change_nothing(spark, tmp_path):
    files = [
        [(1, 0, "user", 80), (1, 1, "assistant", 5), (2, 0, "user", 5), (2, 0, "user", None), (None, 0, "user", 5), (3, None, "user", 5)],
        [(1, 3, "user", 10), (1, 2, "user", 70)],
        [(1, 1, "user", 90), (2, 1, "assistant", 3)],
        [(2, 2, "user", 5), (1, 4, "user", 5), (1, 4, "assistant", 5)],
    ]
    got = {(r["conv_id"], r["turn"], r["last_question"], r["n_asked"], r["n_answered"], r["late"]) for r in dialogue.folded(turns_of(spark, tmp_path, files)).collect()}
    # the row of turn 4 that sorts first by role is the assistant's, as in the batch query
    assert got == {(1, 0, None, 0, 0, False), (2, 0, None, 0, 0, False), (1, 2, 0, 1, 1, False), (1, 3, 2, 2, 1, False), (1, 1, 2, 3, 1, True), (2, 2, None, 1, 1, False)}


def test_idle_dialogues_are_forgotten(spark, tmp_path):
    files = [[(1, 0, "user", 80), (2, 0, "user", 80)], [(2, 1, "user", 5)], [(2, 2, "user", 5)], [(2, 3, "user", 5)], [(2, 4, "user", 5)], [(1, 1, "user", 5), (2, 5, "user", 5)]]
    rows = dialogue.folded(turns_of(spark, tmp_path, files), idle_ms=36 * 3_600_000).collect()
    last = {r["conv_id"]: (r["last_question"], r["n_asked"]) for r in sorted(rows, key=lambda r: r["turn"])}
    assert last == {1: (None, 0), 2: (0, 5)}


def test_the_log_joins_its_voyages_and_late_rows_are_kept_apart(spark, tmp_path):
    # hours since the start; the last file brings a row four days late, and one a day late
    stream = events_of(spark, tmp_path, [[(1, 0), (1, 5), (2, 3), (2, 3)], [(1, 30), (1, 100)], [(1, 4), (1, 90), (3, 100)]])
    hour = lambda h: DAY + datetime.timedelta(hours=h)
    rows = [(1, 1, hour(0), hour(30)), (1, 2, hour(5), hour(95)), (2, 1, hour(3), hour(3)), (2, 2, hour(9), hour(4)), (3, 1, hour(101), hour(102)), (None, 1, hour(0), hour(9))]
    voyages = spark.createDataFrame(rows, "vessel bigint, voyage bigint, start_ts timestamp, end_ts timestamp")
    joined, late = voyage_join.joined_log(stream, voyages, f"{tmp_path}/work")
    at = lambda r: round((r["ts"] - DAY).total_seconds() / 3600)
    assert sorted((r["vessel"], r["voyage"], at(r)) for r in joined.collect()) == [(1, 1, 0), (1, 1, 5), (1, 1, 30), (1, 2, 5), (1, 2, 30), (1, 2, 90), (2, 1, 3), (2, 1, 3)]
    assert [(r["vessel"], at(r)) for r in late.collect()] == [(1, 4)]
