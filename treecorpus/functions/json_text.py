"""JSON text: canonical form, fragments, deep equality."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from treecorpus.functions.goal_ids import REDACTED, SAFE_TEXT


def compact_json(text: Column) -> Column:
    """Keys sorted, no spaces; null when the text is not JSON. Stays in generated code."""
    return F.to_json(F.try_parse_json(text))


def json_equal(left: Column, right: Column) -> Column:
    """Deep equality whatever the key order; null when either side is not JSON."""
    return compact_json(left) == compact_json(right)


@F.pandas_udf(T.StringType())
def pretty_json(text: pd.Series) -> pd.Series:
    """Keys sorted, two-space indent."""
    return text.map(lambda t: None if t is None else json.dumps(json.loads(t) or {}, indent=2, sort_keys=True))


@F.pandas_udf(T.StringType())
def pretty_json_value(text: pd.Series) -> pd.Series:
    """As :func:`pretty_json`, but empty values keep their own type."""
    return text.map(lambda t: None if t is None else json.dumps(json.loads(t), indent=2, sort_keys=True))


@F.pandas_udf(T.StringType())
def spaced_json(text: pd.Series) -> pd.Series:
    """Keys sorted, one line, default separators."""
    return text.map(lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True))


_SAFE = re.compile(SAFE_TEXT.replace(r"\z", r"\Z"))


def _redact(value):
    if isinstance(value, dict):
        return {k: _redact(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_redact(v) for v in value]
    if isinstance(value, str) and not _SAFE.match(value):
        return REDACTED
    return value


@F.pandas_udf(T.StringType())
def safe_payload(text: pd.Series) -> pd.Series:
    """The JSON value with every unsafe string inside it redacted."""
    return text.map(lambda t: None if t is None else json.dumps(_redact(json.loads(t)), sort_keys=True))


# Words of key names whose values are hidden.
SECRET_KEY = r"(?i)password|token|secret|api[_-]?key|x[_-]?auth"


def redact_map(values: Column) -> Column:
    return F.transform_values(values, lambda k, v: F.when(k.rlike(SECRET_KEY), F.lit("<redacted>")).otherwise(v))


_OUTSIDE = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}\[\]]', re.S)
_CLOSER = {"{": "}", "[": "]"}


def first_fragment(text: str) -> str | None:
    """The first balanced object or array outside quotes."""
    start, due = None, []
    for token in _OUTSIDE.finditer(text):
        mark = token.group()
        if mark in _CLOSER:
            start = token.start() if start is None else start
            due.append(_CLOSER[mark])
        elif mark in ("}", "]") and start is not None:
            if mark != due.pop():
                return None
            if not due:
                return text[start: token.end()]
    return None


def strip_fence(text: str) -> str:
    """The inside of one code fence that wraps the whole text."""
    lines = text.strip().splitlines()
    if len(lines) >= 3 and lines[0].startswith("```") and lines[-1].strip() == "```":
        return "\n".join(lines[1:-1]).strip()
    return text.strip()


def _plain_numbers(value):
    """Whole floats as integers, so that equal values have equal text."""
    if isinstance(value, dict):
        return {k: _plain_numbers(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain_numbers(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() else value


def read_json(text: str | None) -> tuple[str | None, str]:
    """Canonical JSON of a text and the way it was read, or None and the failure."""
    if text is None:
        return None, "missing prediction"
    bare = strip_fence(text)
    tries = [(lambda: bare, "fenced" if text.lstrip().startswith("```") else "parsed"),
             (lambda: first_fragment(bare), "fragment")]
    failure = "prediction is not JSON"
    for pick, way in tries:
        piece = pick()
        if piece is None:
            continue
        try:
            value = _plain_numbers(json.loads(piece))
        except ValueError:
            if way == "fragment":
                failure = "prediction JSON parse failed"
            continue
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False), way
    return None, failure
