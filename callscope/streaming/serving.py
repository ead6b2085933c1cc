"""Serving tables: the dashboard's reports, written after every ingest batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from callscope.functions.timing import window_seconds
from callscope.plans import logs as log_reports
from callscope.plans import metrics
from callscope.sources.tables import Warehouse

REFRESH = "15 seconds"
WINDOWS = ("1h", "24h", "7d")


def refresh(path: str, windows: Sequence[str] = WINDOWS, as_of=None):
    """An `after_batch` function for `run_ingest`; use it with `every=REFRESH`.

    Each refresh fills `refresh=<batch>` folders and then writes `_complete/refresh=<batch>`; a reader
    takes the newest refresh that is named there.  The rollup is read once, for the widest window.  Percentiles come from
    the histograms that ingest stores, so of the log a refresh reads the hours that windows begin in, and
    the latest hours, once, for the newest rows.
    """

    def write(warehouse: Warehouse, batch_id: int) -> None:
        widest = max(windows, key=window_seconds)
        rollup = warehouse.rollup(widest, as_of).persist()
        newest = log_reports.recent_logs(warehouse.newest_logs(log_reports.DEFAULT_LIMIT, widest, as_of)).persist()
        try:
            for window in windows:
                tables = {
                    "overview": metrics.overview(rollup, window, as_of),
                    "timeseries": metrics.timeseries(rollup, window, as_of),
                    "by_provider": metrics.by_provider(rollup, window, as_of),
                    "percentiles": metrics.percentiles_of(warehouse.values(window, as_of)),
                    "recent_logs": log_reports.recent_logs(metrics.log_window(newest, window, as_of)),
                }
                for name, table in tables.items():
                    target = f"{path}/{name}/window={window}/refresh={batch_id}"
                    table.write.mode("overwrite").parquet(target)
        finally:
            rollup.unpersist()
            newest.unpersist()
        done = warehouse.spark.range(1).select(F.current_timestamp().alias("at"))
        done.write.mode("overwrite").parquet(f"{path}/_complete/refresh={batch_id}")

    return write
