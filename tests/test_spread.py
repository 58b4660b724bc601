"""A table of one row group is read by one task; costly work on its rows is not left there."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracelake import driver_io as D
from tracelake import fixtures as X

ROWS, USERS = 4000, 50


@pytest.fixture(scope="module")
def one_group(tmp_path_factory):
    folder = tmp_path_factory.mktemp("one_group")
    at = [datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=37 * i) for i in range(ROWS)]
    columns = {"event_id": range(ROWS), "ts": pa.array(at, pa.timestamp("us")), "user_id": [i % USERS for i in range(ROWS)], "event_type": [("error", "view", "signup")[i % 3] for i in range(ROWS)], "value": [1.0] * ROWS, "props": ["{}"] * ROWS}
    pq.write_table(pa.table(columns), folder / "events.parquet")
    return str(folder)


def tasks(df):
    """Rows of each task that makes some."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


@pytest.mark.parametrize("query", [X.event_log_requests, D.otlp_log_proto_round_trip, D.flatten_otlp_logs])
def test_requests_of_one_row_group_are_made_in_many_tasks(spark, one_group, query):
    found = tasks(query(spark, one_group))
    assert sum(found) == ROWS and len(found) >= X.MIN_TASKS and max(found) < 3 * ROWS / len(found), found


def test_sharded_decode_is_not_held_to_few_tasks(spark, one_group, monkeypatch):
    """Requests are decoded in as many tasks as they were encoded in."""
    seen, parse = [], D.otlp_proto.parse_log_requests
    monkeypatch.setattr(D.otlp_proto, "parse_log_requests", lambda bodies: seen.extend(tasks(bodies)) or parse(bodies))
    got = D.sharded_decode(spark, one_group).collect()
    assert sum(seen) == ROWS and len(seen) >= X.MIN_TASKS, seen
    assert [tuple(r) for r in got] == [(ROWS - ROWS // 5, USERS - USERS // 5, 0)]
