"""Streams that go by event time: nothing may depend on how rows fell into batches, and state must end."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fiatscan.operators import rates
from fiatscan.streaming import kept, runner, stateful, timed

START = pd.Timestamp("2024-01-01")


def stored(folder, rows, files):
    """Rows as a table `t` of so many files, to be read in their order."""
    (folder / "t.parquet").mkdir()
    size = -(-len(rows) // files)
    for k in range(files):
        rows.iloc[size * k : size * (k + 1)].to_parquet(folder / f"t.parquet/part-{k}.parquet", coerce_timestamps="us")


def disordered(n=400, seed=5):
    """Rows a few seconds apart on average, each up to 20 seconds out of order, with gaps, ties and missing flags."""
    rng, at, rows = random.Random(seed), 0.0, []
    for k in range(n):
        at += rng.choice([0, 1, 2, 3, 40 if k % 37 == 0 else 1])
        rows.append((at + rng.random() * 20, k, rng.choice("ab"), rng.choice("xy"), round(rng.random(), 3), rng.choice([True, False, False, None]), rng.random() < 0.6))
    table = pd.DataFrame(rows, columns=["at", "event_id", "asset", "fiat", "rate", "stale", "is_event"])
    table["ts"] = START + pd.to_timedelta(table.pop("at").round(), unit="s")
    return table


@pytest.mark.parametrize("files", [1, 5])
def test_as_of_stream_equals_a_plain_search(spark, tmp_path, files):
    rows = disordered()
    stored(tmp_path, rows, files)
    stream = runner.read_stored(spark, str(tmp_path), "t", max_files=1)
    events = stream.where("is_event").select("event_id", "asset", "fiat", "ts", F.lit("é").alias("note"))
    got = runner.drain(timed.as_of(events, stream.where("not is_event"), ["asset", "fiat"], "30 seconds", spread=3), "as-of").collect()
    end = rows["ts"].max() - pd.Timedelta(seconds=30)
    ticks = rows[~rows["is_event"]]
    want = {}
    for e in rows[rows["is_event"] & (rows["ts"] < end)].itertuples():
        before = ticks[(ticks["asset"] == e.asset) & (ticks["fiat"] == e.fiat) & (ticks["ts"] <= e.ts)].sort_values(["ts", "event_id"])
        want[e.event_id] = (before["rate"].iloc[-1], before["ts"].iloc[-1].to_pydatetime()) if len(before) else (None, None)
    assert {r.event_id: (r.rate, r.tick_ts) for r in got} == want and len(got) == len(want) > 100
    assert {r.note for r in got} == {"é"} and any(v[0] is None for v in want.values())


def test_as_of_stream_takes_rows_without_time_and_empty_tables(spark, tmp_path):
    rows = disordered(20)
    rows.loc[[2, 3], "ts"] = pd.NaT
    rows["is_event"] = [k % 2 == 0 for k in range(20)]
    stored(tmp_path, rows, 1)
    stream = runner.read_stored(spark, str(tmp_path), "t")
    events = stream.where("is_event").select("event_id", "asset", "fiat", "ts")
    got = runner.drain(timed.as_of(events, stream.where("not is_event"), ["asset", "fiat"], "0 seconds"), "as-of").collect()
    assert [(r.rate, r.tick_ts) for r in got if r.event_id == 2] == [(None, None)] and len(got) > 5
    assert runner.drain(timed.as_of(events.where("false"), stream.where("false"), ["asset", "fiat"]), "none").count() == 0


@pytest.mark.parametrize("files", [1, 5])
def test_stale_rates_equal_gaps(spark, tmp_path, files):
    rows = disordered()
    rows.loc[7, "ts"] = pd.NaT
    stored(tmp_path, rows, files)
    stream = runner.read_stored(spark, str(tmp_path), "t", max_files=1)
    got = sorted((r.asset, r.fiat, r.last_ts, r.stale_ts) for r in runner.drain(timed.stale_rates(stream, 15, "30 seconds"), "stale").collect())
    end, want, limit = rows["ts"].max() - pd.Timedelta(seconds=30), [], pd.Timedelta(seconds=15)
    for (asset, fiat), part in rows[rows["stale"].ne(True) & rows["ts"].notna()].groupby(["asset", "fiat"]):
        times = sorted(set(part["ts"]))
        for a, b in zip(times, [*times[1:], pd.Timestamp.max]):
            if b - a > limit and a + limit < end:
                want.append((asset, fiat, a.to_pydatetime(), (a + limit).to_pydatetime()))
    assert got == sorted(want) and len(want) > 10


def test_idle_sessions_end_and_start_afresh(spark, tmp_path):
    at = lambda s: START + pd.Timedelta(seconds=s)
    rows = pd.DataFrame([(1, 1, at(0), 1.5, "EUR"), (2, 2, at(5), 2.5, "EUR"), (2, 3, at(40), 2.5, "EUR"), (3, 4, at(200), 3.5, "EUR"), (1, 5, at(260), 1.5, "EUR"), (1, 6, at(300), 1.5, "EUR"), (9, 7, at(900), 1.0, "EUR")], columns=["session_id", "seq", "ts", "amount", "currency"])
    table = spark.createDataFrame(rows)
    ended = []

    def run(idle_s, name):
        base = f"{tmp_path}/{name}"

        def start(stream):
            ended.append(runner._started(stateful.stable_prices(stream, idle_s, "1 second"), base))
            return ended[-1]

        runner.feed(table, "ts", start, name, slices=3)
        return sorted(r.seq for r in spark.read.parquet(f"{base}/rows").collect())

    assert run(None, "kept") == [3, 5]
    held = ended[-1].lastProgress["stateOperators"][0]["numRowsTotal"]
    assert run(60, "idle") == [3, 6]
    assert held == 4 and ended[-1].lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_idle_caches_and_frames_start_afresh(spark, tmp_path):
    rows = pd.DataFrame({"session_id": [1, 1, 1], "instance_id": [1, 1, 1], "seq": [1, 2, 3], "frame_id": [1, 2, 3], "width": 2, "height": 2, "fetch_ok": [True, False, False], "ts": [START + pd.Timedelta(seconds=s) for s in (0, 10, 500)], "gray": [[0, 0, 0, 0], [9, 9, 9, 9], [99, 99, 99, 99]]})
    stored(tmp_path, rows, 1)
    stream = runner.read_stored(spark, str(tmp_path), "t")
    assert [r.status for r in runner.drain(stateful.cache_replay(stream, 60, 100), "c").orderBy("seq").collect()] == ["fetched", "cached", "error"]
    frames = stream.withColumns({c: F.col(c).cast("int") for c in ("width", "height")}).withColumn("gray", F.col("gray").cast("array<int>"))
    assert [r.motion for r in runner.drain(stateful.frame_gate(frames, 100), "g").orderBy("frame_id").collect()] == [0.0, 9.0, 0.0]


def test_kept_rates_survive_a_batch_that_runs_again(spark, tmp_path):
    table = spark.createDataFrame(disordered(60)).withColumn("stale", F.coalesce("stale", F.lit(False)))
    path = f"{tmp_path}/latest"
    assert kept.read_latest(spark, path).count() == 0
    parts = [table.where(f"event_id % 3 = {k}") for k in range(3)]
    for k in (0, 1, 1, 2, 2):
        kept.merge(parts[k], k, path)
    assert kept.versions(spark, path) == [1, 2]
    plain = lambda df: sorted(map(tuple, df.select("asset", "fiat", "ts", "rate", "stale").collect()))
    want = table.groupBy("asset", "fiat").agg(F.max(F.struct(F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "rate", "stale")).alias("t")).select("asset", "fiat", "t.*")
    assert plain(kept.read_latest(spark, path)) == plain(want)
    assert rates.latest(kept.read_latest(spark, path), F.max("ts")).count() == 4
