import datetime
import os
import subprocess
import sys
from pathlib import Path

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillon.plans import registry
from quillon.sources import tables
from quillon.streaming import tracks


def test_sessions_are_those_of_the_batch(spark, sf_dir):
    runs = registry.queries()
    streamed = {tuple(r) for r in runs["t03_stream_sessions"](spark, sf_dir).collect()}
    batch = {tuple(r) for r in runs["t03_session_windows"](spark, sf_dir).select("path", "start_us", "end_us", "n").collect()}
    last = max(r[2] for r in batch)
    assert streamed <= batch and all(r[2] > last - 7 * 3_600_000_000 for r in batch - streamed)


STORE = "spark.sql.streaming.stateStore.providerClass"


def _filtered(spark, sf_dir, tmp_path, order, late):
    """The filter over three files in order of time whose modification times are as given, and a last row that closes all."""
    rows = pq.read_table(f"{sf_dir}/events.parquet").sort_by("ts")
    for i, when in enumerate(order):
        pq.write_table(rows.slice(i * len(rows) // 3, (i + 1) * len(rows) // 3 - i * len(rows) // 3), tmp_path / f"events-{i}.parquet")
        os.utime(tmp_path / f"events-{i}.parquet", (when, when))
    last = rows.slice(0, 1)
    last = last.set_column(last.schema.get_field_index("user_id"), "user_id", pa.array([-1], pa.int64()))
    last = last.set_column(last.schema.get_field_index("ts"), "ts", pa.array([datetime.datetime(2030, 1, 1)], last.schema.field("ts").type))
    pq.write_table(last, tmp_path / "events-9.parquet")
    os.utime(tmp_path / "events-9.parquet", (2e9, 2e9))
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return tracks.drained(tracks.filtered(tracks.observation_stream(spark, str(tmp_path)), late), f"{tmp_path}/out").toPandas()
    finally:
        spark.conf.unset(STORE)


@pytest.mark.parametrize("order", [(1e9, 1.1e9, 1.2e9), (1e9, 1.2e9, 1.1e9), (1.2e9, 1.1e9, 1e9), (1e9, 1e9, 1e9)])
def test_filter_with_state_whatever_the_order_of_files(spark, sf_dir, tmp_path, order):
    got = _filtered(spark, sf_dir, tmp_path, order, "60 days")
    batch = tables.observations(spark, sf_dir).toPandas()
    want = pd.concat([tracks.filter_in_batch(g) for _, g in batch.groupby("path")])
    both = got.merge(want, on=["path", "id"], suffixes=("", "_w"))
    assert len(both) == len(got) == len(want) and not got["late"].any()
    assert (abs(both["level"] - both["level_w"]) < 1e-6).all() and (abs(both["rate"] - both["rate_w"]) < 1e-6).all() and (both["taken"] == both["taken_w"]).all()
    assert both["level"].abs().max() < 1e6


def test_late_rows_come_out_marked(spark, sf_dir, tmp_path):
    got = _filtered(spark, sf_dir, tmp_path, (1.1e9, 1.2e9, 1e9), "1 hour")
    rows = tables.observations(spark, sf_dir).toPandas().merge(got, on=["path", "id", "t_us"])
    assert len(rows) == len(got) == 1000 and 0 < rows["late"].sum() < 500
    assert rows.loc[rows["late"], "level"].isna().all() and rows.loc[~rows["late"], "level"].notna().all()
    # what isn't late is what the filter gives for these rows alone
    want = pd.concat([tracks.filter_in_batch(g) for _, g in rows[~rows["late"]].groupby("path")])
    both = rows.merge(want, on=["path", "id"], suffixes=("", "_w"))
    assert len(both) == len(want) and (abs(both["level"] - both["level_w"]) < 1e-6).all()


def test_filter_from_another_folder(tmp_path):
    """The query runs where the package is found by the driver alone."""
    root = Path(__file__).resolve().parent.parent
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').config('spark.sql.session.timeZone', 'UTC').config('spark.checkpoint.dir', 'file://{tmp_path}/shared').getOrCreate()
import __spark_entry__
assert __spark_entry__.queries()['t04_stream_filter'](spark, '/root/testdata/sf0.001').count() > 900
print('ran')
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ran" in run.stdout, run.stderr[-3000:]


def test_paths_without_rows_to_give_out_give_no_frame():
    class Held:
        def get(self):
            return None

    class Waiting:
        def get(self):
            return iter(())

        def put(self, rows):
            self.rows = rows

    class Timers:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 0

        def registerTimer(self, at):  # noqa: N802
            self.at = at

    work = tracks.TrackFilter()
    work.track, work.waiting, work.handle = Held(), Waiting(), Timers()
    work.track.exists = work.waiting.exists = lambda: False
    frame = tracks.pd.DataFrame({"t_us": [5_000_000, 2_000_000], "id": [1, 2], "cents": [3, 4]})
    assert list(work.handleInputRows((7,), iter([frame]), Timers())) == []
    assert work.waiting.rows == [(2_000_000, 2, 4.0), (5_000_000, 1, 3.0)] and work.handle.at == 2001
