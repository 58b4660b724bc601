"""Search requests and the three small filter grammars, parsed in plain Python on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

from tracelake.schema import MAX_LONG, SERVICE, SPAN

DEFAULT_LIMIT, MAX_JAEGER_LIMIT = 20, 1000


class BadRequest(ValueError):
    """The request can't be understood (HTTP status 400)."""


@dataclass(frozen=True)
class FieldFilter:
    name: str
    value: str


@dataclass(frozen=True)
class TraceSearch:
    """Traces whose window overlaps [start, end] and that hold every named thing on some span; limit None is no limit."""

    start_unix_nano: int = 0
    end_unix_nano: int = MAX_LONG
    service_name: str | None = None
    operation_name: str | None = None
    field_filters: tuple[FieldFilter, ...] = ()
    limit: int | None = DEFAULT_LIMIT


@dataclass(frozen=True)
class LogSearch:
    start_unix_nano: int = 0
    end_unix_nano: int = MAX_LONG
    service_name: str | None = None
    severity_text: str | None = None
    field_filters: tuple[FieldFilter, ...] = ()
    limit: int | None = DEFAULT_LIMIT


@dataclass(frozen=True)
class TempoSearch:
    search: TraceSearch
    limit: int | None = DEFAULT_LIMIT
    substrings: tuple[tuple[str, str], ...] = field(default=())


def saturating(value: int | None, factor: int, default: int) -> int:
    """value * factor, kept within 64 bits."""
    return default if value is None else max(-MAX_LONG - 1, min(MAX_LONG, value * factor))


def parse_field_filter(text: str) -> FieldFilter:
    """name=value, split at the first sign; both sides trimmed and not empty."""
    name, sign, value = text.partition("=")
    if not sign or not name.strip() or not value.strip():
        raise BadRequest(f"invalid field_filter: {text}")
    return FieldFilter(name.strip(), value.strip())


# fixed values of the tag vocabulary
_TAG_ALIASES = {
    "service.name": SERVICE, "trace:rootService": SERVICE, "name": "name", "trace:rootName": "name", "duration": "duration", "trace:duration": "duration",
    "traceDuration": "duration", "status": "status_code", "status.code": "status_code", "statusCode": "status_code", "statusMessage": "status_message",
    "status_message": "status_message", "status.message": "status_message",
}


def tag_to_field(tag: str) -> str:
    """The field that a Tempo tag name stands for."""
    tag = tag.strip().lstrip(".")
    for scope, prefix in (("resource.", "resource_attr:"), ("span.", SPAN)):
        if tag.startswith(scope):
            return prefix + tag[len(scope) :]
    return _TAG_ALIASES.get(tag, SPAN + tag)


def parse_traceql(text: str) -> tuple[FieldFilter, ...]:
    """{name=value && ...}: equality pairs only. Empty braces, blank ones included, match everything."""
    body = text.strip().lstrip("{").rstrip("}")
    if not body.strip():
        return ()
    out = []
    for part in body.split("&&"):
        name, sign, value = part.partition("=")
        name, value = name.strip().lstrip("."), value.strip().strip('"')
        if not sign or not name or not value:
            raise BadRequest(f"unsupported TraceQL query: {part}")
        out.append(FieldFilter(tag_to_field(name), value))
    return tuple(out)


def parse_tags(text: str) -> tuple[tuple[str, str], ...]:
    """k=v pairs parted by white space; values match as substrings."""
    out = []
    for part in text.split():
        name, sign, value = part.partition("=")
        value = value.strip().strip('"')
        if not sign or not value:
            raise BadRequest(f"invalid tags filter: {text}")
        out.append((tag_to_field(name), value))
    return tuple(out)


def native_search(start: int | None = None, end: int | None = None, service: str | None = None, operation: str | None = None, field_filter: str | list[str] | None = None, limit: int | None = None) -> TraceSearch:
    """Nanoseconds; limit 20 unless given."""
    filters = [field_filter] if isinstance(field_filter, str) else field_filter or []
    return TraceSearch(saturating(start, 1, 0), saturating(end, 1, MAX_LONG), service, operation, tuple(parse_field_filter(f) for f in filters), DEFAULT_LIMIT if limit is None else limit)


def jaeger_search(service: str | None, operation: str | None = None, start: int | None = None, end: int | None = None, limit: int | None = None) -> TraceSearch:
    """Microseconds; a service is required and the limit is at most 1000."""
    if not service:
        raise BadRequest("service name is required")
    limit = DEFAULT_LIMIT if limit is None else limit
    if limit > MAX_JAEGER_LIMIT:
        raise BadRequest(f"limit should be not higher than {MAX_JAEGER_LIMIT}")
    return TraceSearch(saturating(start, 1000, 0), saturating(end, 1000, MAX_LONG), service, operation, (), limit)


def tempo_search(q: str | None = None, tags: str | None = None, start: int | None = None, end: int | None = None, limit: int | None = None) -> TempoSearch:
    """Seconds; a query that isn't blank makes tags be ignored."""
    lo, hi = saturating(start, 1_000_000_000, 0), saturating(end, 1_000_000_000, MAX_LONG)
    limit = DEFAULT_LIMIT if limit is None else limit
    if q and q.strip():
        return TempoSearch(TraceSearch(lo, hi, field_filters=parse_traceql(q), limit=None), limit)
    return TempoSearch(TraceSearch(lo, hi, limit=None), limit, parse_tags(tags) if tags else ())
