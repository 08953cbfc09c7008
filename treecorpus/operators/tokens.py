"""Token arrays: windows, packing, masks, length statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

import numpy as np
import pandas as pd


def chunk_tokens(rows: DataFrame, max_len: int, overlap: int, pad: int = 0, ids: str = "input_ids") -> DataFrame:
    """One row per window: ``chunk, input_ids, attention_mask``.

    A list that fits gives one unpadded window. Longer ones slide by ``max_len - overlap`` (at
    least 1) and stop at the first window that reaches the end; only the last is padded.
    """
    stride = max(1, max_len - overlap)
    n = F.size(ids)
    last = F.when(n <= max_len, 0).otherwise(F.ceil((n - max_len) / stride)).cast("int")
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    window = F.slice(F.col(ids), F.col("chunk") * stride + 1, F.lit(max_len))
    rows = rows.withColumns({"window": window, "long": n > max_len})
    gap = F.when(F.col("long"), max_len - F.size("window")).otherwise(0)
    return rows.withColumns({
        ids: F.concat("window", F.array_repeat(F.lit(pad), gap)),
        "attention_mask": F.concat(F.array_repeat(F.lit(1), F.size("window")), F.array_repeat(F.lit(0), gap)),
    }).drop("window", "long")


def pack_prompt_completion(rows: DataFrame, max_len: int, pad: int = 0) -> DataFrame:
    """Pack ``prompt_ids`` and ``completion_ids``: the prompt's tail, the completion's head.

    Labels are -100 on prompt and padding. Rows without completion tokens get an ``error``.
    """
    if max_len < 2:
        raise ValueError("packing needs max_len >= 2")
    np_, nc = F.size("prompt_ids"), F.size("completion_ids")
    head = F.least(F.greatest(nc, F.lit(1)), F.when(np_ > 0, max_len - 1).otherwise(max_len))
    rows = rows.withColumn("n_c", F.least(head, nc)).withColumn("n_p", F.least(max_len - head, np_))
    rows = rows.withColumns({
        "p": F.slice(F.col("prompt_ids"), F.greatest(np_ - F.col("n_p") + 1, F.lit(1)), F.col("n_p")),
        "c": F.slice(F.col("completion_ids"), F.lit(1), F.col("n_c")),
        "gap": max_len - F.col("n_c") - F.col("n_p")})
    fill = lambda value, count: F.array_repeat(F.lit(value), count)
    return rows.withColumns({
        "input_ids": F.concat("p", "c", fill(pad, F.col("gap"))),
        "attention_mask": F.concat(fill(1, F.col("n_p") + F.col("n_c")), fill(0, F.col("gap"))),
        "labels": F.concat(fill(-100, F.col("n_p")), "c", fill(-100, F.col("gap"))),
        "error": F.when(nc == 0, "completion has no tokens"),
    }).drop("p", "c", "gap", "n_c", "n_p")


def mask_new_tokens(ids: Column, first_new: int, size: int) -> Column:
    """1 where the id is one of the ids added to the vocabulary."""
    return F.transform(ids, lambda x: F.when((x >= first_new) & (x < size), 1).otherwise(0))


def _starts(ids: np.ndarray, pattern: list[int]) -> np.ndarray:
    if len(ids) < len(pattern) or not pattern:
        return np.empty(0, dtype=int)
    view = np.lib.stride_tricks.sliding_window_view(ids, len(pattern))
    return np.flatnonzero((view == np.asarray(pattern)).all(axis=1))


def _filled(n: int, spans, keep_all: bool) -> list[int]:
    mask = np.zeros(n, dtype=np.int32)
    for start, stop in spans:
        mask[start:stop] = 1
    if keep_all and not mask.any():
        mask[:] = 1
    return mask.tolist()


def span_mask(ids, target: list[int], ends: list[list[int]], keep_all: bool) -> list[int]:
    """From each target through the first terminator after it; a target without one is left out."""
    ids = np.asarray(ids)
    width = max(map(len, ends))
    begins: dict[int, int] = {}  # where a terminator ends: where the shortest such one starts
    for end in ends:
        for s in _starts(ids, end):
            begins[int(s) + len(end)] = max(int(s), begins.get(int(s) + len(end), 0))
    closing = np.asarray(sorted(begins), dtype=int)
    last_begin = begins.get(len(ids), -1)
    spans = []
    for start in _starts(ids, target):
        after = int(start) + len(target)
        # Terminators are looked for in windows of the longest one's width that begin after the
        # target; at the end of the list the windows get shorter.
        fits = closing[(closing - width >= after) | ((closing == len(ids)) & (last_begin >= after))]
        if len(fits):
            spans.append((int(start), int(fits.min())))
    return _filled(len(ids), spans, keep_all)


def section_mask(ids, target: list[int], start: list[int], end: list[int], keep_all: bool) -> list[int]:
    """From each target through the end token that balances it."""
    ids = np.asarray(ids)
    change = np.zeros(len(ids) + 1, dtype=int)
    change[_starts(ids, start)] += 1
    change[_starts(ids, end)] -= 1
    spans = []
    for at in _starts(ids, target):
        after = int(at) + len(start)
        depth = 1 + np.cumsum(change[after:len(ids)])
        closed = np.flatnonzero(depth == 0)
        if len(closed):
            spans.append((int(at), after + int(closed[0]) + len(end)))
    return _filled(len(ids), spans, keep_all)


def mask_key_value_span(ids: Column, target: list[int], ends: list[list[int]], keep_all: bool = False) -> Column:
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def mask(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else span_mask(r, target, ends, keep_all))

    return mask(ids)


def mask_section(ids: Column, target: list[int], start: list[int], end: list[int], keep_all: bool = False) -> Column:
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def mask(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else section_mask(r, target, start, end, keep_all))

    return mask(ids)


# Named masks: which spans to keep, given the token ids of the marks (see mask_key_value_span
# and mask_section).
PRESETS = {
    "odata_id": ("span", "id_key", ["object_close"]),
    "allowed_value": ("span", "allowable_key", ["array_close"]),
    "target": ("span", "target_value", ["object_close"]),
    "target_key": ("span", "target_key", ["object_close"]),
    "json_object": ("section", "object_open", ["object_close"]),
    "json_array": ("section", "array_open", ["array_close"]),
    "api_prefix": ("span", "api_prefix", ["object_close"]),
}


def mask_preset(ids: Column, name: str, marks: dict[str, list[int]], keep_all: bool = False) -> Column:
    kind, target, ends = PRESETS[name]
    if kind == "section":
        return mask_section(ids, marks[target], marks[target], marks[ends[0]], keep_all)
    return mask_key_value_span(ids, marks[target], [marks[e] for e in ends], keep_all)


def length_stats(rows: DataFrame, by: list[str], ids: str = "input_ids", mask: str = "attention_mask") -> DataFrame:
    """Mean and greatest length, and the share of padding."""
    used = F.aggregate(F.col(mask), F.lit(0), lambda a, x: a + x)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.size(ids)).alias("mean_length"), F.max(F.size(ids)).alias("max_length"),
        (1 - F.sum(used) / F.sum(F.size(ids))).alias("padding_share"))
