"""Exact dedup of repeated byte strings over all documents by a sparse enhanced suffix array.

1. Anchors: the least hash of the grams in every ``LENGTH``-byte window is an anchor (winnowing), so
   two equal windows hold the same anchor at the same place. Only anchors are sorted, about one in 31.
2. Anchors are sorted by (gram, whole context, document, place). Of those with equal contexts all but
   the first are covered on both sides as far as any window with this anchor reaches. What is left are
   the first ones of groups with several contexts: near the edges of repeats.
3. For these the text after the anchor is a suffix of a sparse suffix array. The common-prefix
   interval tree of every group and the diversity of its left extensions give all maximal repeats.
   A group of very many contexts is not held in one task: its windows are sorted one by one, by hash.
4. The spans are cut out of each document.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from treecorpus.llm.common import cut, id_of, release, slices, small_batches, small_broadcasts, utf8
from treecorpus.llm.repeats import covered_by_earlier

#: Bytes of a repeated string, of a gram, and how far before an anchor a window can start.
LENGTH, GRAM = 100, 32
BEFORE = LENGTH - GRAM
#: Bytes that are scanned at once, and what a part of a long text shares with its neighbours.
TOGETHER, MARGIN = 1 << 20, 4 * LENGTH
#: Contexts of one gram that one task sorts; larger groups are split by window.
GROUP = 16_384


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte value, and powers of an odd base and of its inverse, modulo 2**64."""
    table = np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15
    up, down = (np.full(n + 1, b, np.uint64) for b in (base, pow(base, -1, 2**64)))
    up[0] = down[0] = 1
    return table, np.cumprod(up), np.cumprod(down)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[:-(width - size)], x[width - size:]) if width > size else x


def find_anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, gram hash, context hash) of the anchors of the texts data[starts:ends]."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < LENGTH:
        return none, none, none, none
    table, up, down = _powers(1 << max(20, int(n).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * up[:n], out=total[1:])
    grams = _mix((total[GRAM:] - total[:-GRAM]) * down[:n - GRAM + 1])
    least = (grams >> np.uint64(32)).astype(np.uint32)
    lengths = ends - starts
    closed = np.repeat(lengths < LENGTH, lengths)[:len(least)]
    tail = (ends[:, None] - np.arange(1, GRAM)).ravel()
    tail = tail[(tail >= np.repeat(starts, GRAM - 1)) & (tail < len(least))]
    closed[tail] = True  # grams that would run into the next text
    least[closed] = np.uint32(2**32 - 1)
    width = BEFORE + 1
    if len(least) < width:
        return none, none, none, none
    lowest = _sliding(least, width, np.minimum)
    edge = np.zeros(BEFORE, np.uint32)
    chosen = np.flatnonzero((_sliding(np.r_[edge, lowest, edge], width, np.maximum) == least) & ~closed)
    text = np.searchsorted(starts, chosen, side="right") - 1
    low = np.maximum(chosen - BEFORE, starts[text])
    high = np.minimum(chosen + LENGTH, ends[text])
    context = _mix((total[high] - total[low]) * down[low] + _mix(
        (chosen - low).astype(np.uint64) * np.uint64(1024) + (high - chosen).astype(np.uint64)))
    return text, chosen - starts[text], grams[chosen].view(np.int64), context.view(np.int64)


def _scan(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of several texts; a very long text is scanned in parts that overlap."""
    short = [i for i, x in enumerate(texts) if len(x) <= 4 * TOGETHER]
    if short:
        lengths = np.array([len(texts[i]) for i in short])
        ends = np.cumsum(lengths)
        text, place, gram, context = find_anchors(
            np.frombuffer(b"".join(texts[i] for i in short), np.uint8), ends - lengths, ends)
        yield np.array(short)[text], place, gram, context
    for i, x in enumerate(texts):
        if len(x) > 4 * TOGETHER:
            for start in range(0, len(x), TOGETHER):
                a, b = max(0, start - MARGIN), min(len(x), start + TOGETHER + MARGIN)
                part = np.frombuffer(x[a:b], np.uint8)
                text, place, gram, context = find_anchors(part, np.array([0]), np.array([len(part)]))
                own = (place + a >= start) & (place + a < start + TOGETHER)
                yield text[own] + i, place[own] + a, gram[own], context[own]


def _first_of_equals(gram, context, doc, at) -> pa.RecordBatch:
    """Rows of one slice, of which only the first with the same gram and context goes to its gram.

    The others are known to be covered: ``at`` is inverted and the row goes anywhere. A gram that
    fills a third of the table so sends each task's first row only. Repeated rows are dropped.
    """
    order = np.lexsort((at, doc, context, gram))
    gram, context, doc, at = gram[order], context[order], doc[order], at[order]
    again = np.zeros(len(at), bool)
    again[1:] = (gram[1:] == gram[:-1]) & (context[1:] == context[:-1])
    keep = np.ones(len(at), bool)
    keep[1:] = ~(again[1:] & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1]))
    gram = np.where(again, _mix(at.view(np.uint64) + doc.view(np.uint64)).view(np.int64), gram)
    at = np.where(again, ~at, at)
    return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (gram, context, doc, at)], ["gram", "context", "doc", "at"])


def _anchors(batches):
    """Rows ``gram, context, doc, at`` of all anchors."""
    for batch in batches:
        texts = utf8(batch.column("text"))
        ids = batch.column("doc").to_numpy()
        digests = batch.column("digest").to_numpy()
        for a, b in slices([len(x) for x in texts], TOGETHER):
            for text, place, gram, context in _scan(texts[a:b]):
                yield _first_of_equals(gram, context, ids[a:b][text], (digests[a:b][text] << 32) | place)


ANCHOR_TYPE = "gram long, context long, doc long, at long"
FOUND_TYPE = "doc long, at long, gram long, kind int"
#: What a found place is: covered on both sides, or the first of its context in a group of several.
COVERED, FIRST = 0, 1


def _classify(batches):
    """A stream sorted by (gram, context, doc, at) as ``doc, at, gram, kind``, in bounded memory."""
    held = np.zeros((4, 0), np.int64)  # the last first of the gram that is still open
    several = False  # whether its group has shown several contexts, so that ``held`` is out already

    def found(rows, kind):
        n = rows.shape[1]
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[2]), pa.array(rows[3]), pa.array(rows[0]), pa.array(np.full(n, kind, np.int32))], ["doc", "at", "gram", "kind"])

    last = held
    for batch in batches:
        rows = np.array([batch.column(i).to_numpy() for i in range(4)])
        known = rows[3] < 0
        if known.any():
            covered = rows[:, known]
            covered[3] = ~covered[3]
            yield found(covered, COVERED)
            rows = rows[:, ~known]
        if not rows.shape[1]:
            continue
        joined = np.concatenate([last, rows], axis=1)  # compare with the row before the batch
        same_gram = np.r_[False, joined[0, 1:] == joined[0, :-1]]
        same_context = same_gram & np.r_[False, joined[1, 1:] == joined[1, :-1]]
        same_row = same_context & np.r_[False, (joined[2:, 1:] == joined[2:, :-1]).all(axis=0)]
        skip = last.shape[1]
        last = joined[:, -1:]
        same_gram, same_context, same_row = same_gram[skip:], same_context[skip:], same_row[skip:]
        yield found(rows[:, same_context & ~same_row], COVERED)
        # Firsts of contexts, with the one that is held in front.
        firsts = rows[:, ~same_context]
        opens = ~same_gram[~same_context]
        front = held.shape[1]
        firsts = np.concatenate([held, firsts], axis=1)
        if not firsts.shape[1]:
            continue
        opens = np.r_[np.ones(front, bool), opens]
        opens[:1] = True
        group = np.cumsum(opens) - 1
        sizes = np.bincount(group)
        many = sizes[group] > 1
        if front and several:
            many[group == 0] = True
            many[0] = False  # out already
        yield found(firsts[:, many], FIRST)
        several = bool(sizes[-1] > 1 or (several and front and group[-1] == 0))
        held = firsts[:, -1:]


def _contexts(batches):
    """The text around the firsts: ``gram, doc, at, before, text`` (``before``: bytes before the anchor)."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            text, high = row["text"].encode(), row["digest"] << 32
            for place, gram in zip(row["places"], row["grams"]):
                low = max(0, place - BEFORE)
                out.append((gram, row["doc"], high | place, place - low, text[low:place + LENGTH]))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                ["gram", "doc", "at", "before", "text"])


CONTEXT_TYPE = "gram long, doc long, at long, before int, text binary"
SPAN_TYPE = "doc long, digest long, low int, high int"


def _span_batch(spans: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*spans), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc", "digest", "low", "high"])


def _repeat_spans(batches):
    """Spans that earlier occurrences cover, from contexts sorted by (gram, doc, at)."""
    gram, members, spans = None, [], []

    def close():
        if len(members) > 1:
            before = [text[:n][::-1] for _, _, n, text in members]
            after = [text[n:] for _, _, n, text in members]
            for i, (low, high) in covered_by_earlier(before, after, LENGTH).items():
                doc, at, _, _ = members[i]
                place = at & 0xFFFFFFFF
                spans.append((doc, at >> 32, place - low, place + high))

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != gram:
                close()
                gram, members = row[0], []
            if not members or members[-1][:2] != row[1:3]:  # else a repeated row
                members.append(row[1:])
        if len(spans) > 10_000:
            yield _span_batch(spans)
            spans.clear()
    close()
    if spans:
        yield _span_batch(spans)


def _windows(batches):
    """Every window around the firsts of split groups, as ``gram, context`` (its hash), ``doc`` and ``at`` (its start)."""
    for batch in batches:
        hashes, doc, at = [], [], []
        for row in batch.to_pylist():
            text, high = row["text"].encode(), row["digest"] << 32
            for place in row["places"]:
                for start in range(max(0, place - BEFORE), min(place, len(text) - LENGTH) + 1):
                    hashes.append(hashlib.blake2b(text[start:start + LENGTH], digest_size=16).digest())
                    doc.append(row["doc"])
                    at.append(high | start)
                if len(at) > 50_000:
                    halves = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                    yield _first_of_equals(halves[:, 0], halves[:, 1], np.array(doc), np.array(at))
                    hashes, doc, at = [], [], []
        if at:
            halves = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield _first_of_equals(halves[:, 0], halves[:, 1], np.array(doc), np.array(at))


def _cut_out(as_text: bool, carried: bool):
    def run(batches):
        return _cut_batches(batches, as_text, carried)

    return run


def _cut_batches(batches, as_text: bool, carried: bool):
    for batch in batches:
        texts = utf8(batch.column("text"))
        out = []
        places, lows, highs = (batch.column(c).to_pylist() for c in ("covered", "lows", "highs"))
        for text, covered, low, high in zip(texts, places, lows, highs):
            n = len(text)
            covered = np.array(covered or [], dtype=np.int64)
            low = np.r_[np.maximum(covered - BEFORE, 0), np.array(low or [], dtype=np.int64)]
            high = np.r_[np.minimum(covered + LENGTH, n), np.array(high or [], dtype=np.int64)]
            order = np.argsort(low, kind="stable")
            low, high = low[order], np.maximum.accumulate(high[order]) if len(high) else high
            opens = np.flatnonzero(np.r_[True, low[1:] > high[:-1]]) if len(low) else np.zeros(0, np.int64)
            first, last = low[opens], high[np.r_[opens[1:] - 1, len(low) - 1]] if len(low) else high
            kept = b"".join(text[a:b] for a, b in zip([0, *last.tolist()], [*first.tolist(), n]))
            out.append((n, n - len(kept), len(first), kept))
        n, gone, spans, kept = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("digest"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
             pa.array(spans, pa.int64()),
             pa.array([x.decode(errors="ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary()),
             *([batch.column("carry")] if carried else [])],
            ["doc", "digest", "n_bytes", "n_removed", "n_spans", "kept", *(["carry"] if carried else [])])


def digest_of(text):
    """31 bits of the text's hash: tells rows with the same id and other texts apart."""
    return F.xxhash64(text).bitwiseAND(F.lit(2**31 - 1).cast("long"))


def remove_repeats(docs: DataFrame, group: int = GROUP, id: str = "doc_id", text: str = "text",
                   carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """``doc, digest, n_bytes, n_removed, n_spans, kept`` (the bytes that stay) of every row.

    With ``carry`` a struct of these columns comes along as ``carry``. With ``as_text`` what stays is a
    string without the characters of which only some bytes do.

    Every byte covered by a string of ``LENGTH`` bytes that also starts earlier (in a smaller id, or
    further ahead in the same document; overlaps count) is removed; strings are judged on the input.
    Texts are UTF-8 bytes, null is empty, texts shorter than ``LENGTH`` stay whole. A row without an
    id comes last (``common.NO_ID``). Rows with the same id and text are one document and share its
    result; rows with the same id and other texts are documents of their own, in the order of
    ``digest_of``. Other columns play no part.
    """
    spark = docs.sparkSession
    small_batches(spark, 20_000, "8m")
    small_broadcasts(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    along = [F.struct(*carry).alias("carry")] if carry else []
    base = docs.select(id_of(id).alias("doc"), digest_of(body).alias("digest"), body.alias("text"), *along)
    # The same columns go through every join with the texts, so that Spark shuffles these once.
    found = cut(
        base.select("doc", "digest", "text").mapInArrow(_anchors, ANCHOR_TYPE).repartition("gram").sortWithinPartitions("gram", "context", "doc", "at")
        .mapInArrow(_classify, FOUND_TYPE), "anchors")
    release(spark)
    firsts = found.filter(F.col("kind") == FIRST)
    hot = cut(firsts.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > group).select("gram"), "hot-grams")
    split = hot.count() > 0
    found = found.join(hot.withColumn("hot", F.lit(True)), "gram", "left") if split else found.withColumn("hot", F.lit(None).cast("boolean"))
    place = F.col("at").bitwiseAND(F.lit(2**32 - 1).cast("long")).cast("int")
    is_first, is_hot = F.col("kind") == FIRST, F.coalesce("hot", F.lit(False))

    def listed(condition, value):
        return F.collect_list(F.when(condition, value))

    places = cut(found.groupBy("doc", F.shiftright("at", 32).alias("digest")).agg(
        listed(~is_first, place).alias("covered"),
        listed(is_first & ~is_hot, F.struct(place.alias("place"), "gram")).alias("firsts"),
        listed(is_first & is_hot, F.struct(place.alias("place"), "gram")).alias("hot_firsts")), "places")
    release(spark)

    def around(which):
        wanted = places.filter(F.size(which) > 0).select(
            "doc", "digest", F.col(which)["place"].alias("places"), F.col(which)["gram"].alias("grams"))
        return base.join(wanted, ["doc", "digest"])

    spans = around("firsts").mapInArrow(_contexts, CONTEXT_TYPE).repartition("gram").sortWithinPartitions(
        "gram", "doc", "at").mapInArrow(_repeat_spans, SPAN_TYPE)
    if split:
        windows = around("hot_firsts").mapInArrow(_windows, ANCHOR_TYPE).repartition("gram").sortWithinPartitions(
            "gram", "context", "doc", "at").mapInArrow(_classify, FOUND_TYPE)
        later = windows.filter(F.col("kind") == COVERED)
        spans = spans.union(later.select("doc", F.shiftright("at", 32).alias("digest"), place.alias("low"), (place + LENGTH).alias("high")))
    spans = spans.groupBy("doc", "digest").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))
    return (
        base.join(places.select("doc", "digest", "covered"), ["doc", "digest"], "left").join(spans, ["doc", "digest"], "left")
        .mapInArrow(_cut_out(as_text, bool(carry)), "doc long, digest long, n_bytes long, n_removed long, n_spans long, kept "
                    + ("string" if as_text else "binary") + (f", carry {base.schema['carry'].dataType.simpleString()}" if carry else "")))


def without_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut out of its texts; all other columns stay as they are."""
    others = tuple(c for c in docs.columns if c != text)
    done = remove_repeats(docs, text=text, carry=others, as_text=True)
    return done.select(*[F.col("kept").alias(c) if c == text else F.col("carry")[c].alias(c) for c in docs.columns])
