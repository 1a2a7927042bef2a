"""The small languages of queries: minimum-should-match and field boosts."""

from __future__ import annotations

import re
from collections.abc import Iterable


def _whole(text: str) -> int:
    if not re.fullmatch(r"\s*[+-]?\d+\s*", text):
        raise ValueError(f"not a whole number: {text!r}")
    return int(text)


def _simple(clauses: int, spec: str) -> int:
    if spec.endswith("%"):
        part = clauses * _whole(spec[:-1]) / 100
        wanted = clauses + int(part) if part < 0 else int(part)
    else:
        n = _whole(spec)
        wanted = clauses + n if n < 0 else n
    return max(0, min(clauses, wanted))


def minimum_should_match(clauses: int, spec: str | int | None) -> int:
    """How many of `clauses` must match: 3, -2, 75%, -25%, or conditions such as "2<-25% 9<-3".

    Percentages are cut towards zero. A condition a<x holds for more than a clauses; the last that holds counts, all
    clauses must match where none does, and the first that fails ends the reading.
    """
    text = re.sub(r"\s*<\s*", "<", str(1 if spec is None else spec).strip())
    if "<" not in text:
        return _simple(clauses, text)
    result = clauses
    for condition in text.split():
        bound, sign, value = condition.partition("<")
        if not sign:
            raise ValueError(f"a condition needs a bound and a value: {condition!r}")
        if clauses <= _whole(bound):
            break
        result = minimum_should_match(clauses, value)
    return result


def field_boosts(fields: str | Iterable[str] | None) -> dict[str, float | None]:
    """{"title": 2.0, "body": None} of ["title^2", "body"]; a bare string is one field."""
    listed = [fields] if isinstance(fields, str) else list(fields or [])
    out: dict[str, float | None] = {}
    for x in listed:
        name, sign, boost = x.partition("^")
        out[name] = float(boost) if sign else None
    return out
