"""Builders shared by the tests."""

from tracelake.schema import LOGS, SPANS


def span(trace, span_id, name="op", start=0, end=1, fields=(), parent=None):
    return (trace, span_id, parent, name, start, end, end, [{"name": n, "value": v} for n, v in fields])


def svc(name):
    return ("resource_attr:service.name", name)


def spans_df(spark, rows):
    return spark.createDataFrame(rows, SPANS)


def log(log_id, time, severity="INFO", number=9, body="b", fields=(), trace=None, observed=None, span_id=None):
    return (log_id, time, observed, number, severity, body, trace, span_id, [{"name": n, "value": v} for n, v in fields])


def logs_df(spark, rows):
    return spark.createDataFrame(rows, LOGS)
