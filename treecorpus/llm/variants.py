"""Spelling variants: sorted word lists scanned with banded edit rows that shared prefixes have in common."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from treecorpus.llm.common import cut, small_batches, utf8

#: Words in a block of a sorted list, and words of it that are scanned for at a time.
BLOCK, AT_ONCE = 4096, 2048
#: Blocks that one task of the sort cuts.
PER_TASK = 8
#: Different words counted in a task before they are handed on.
HELD = 200_000
#: A longer text is walked run by run instead of as one list.
LONG = 1 << 22

_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def runs(text: str) -> Counter:
    """How often each maximal run of letters occurs, A-Z lower-cased."""
    low = text.encode().lower().decode()  # on bytes: A-Z only
    return Counter(_RUN.findall(low) if len(low) < LONG else (m.group() for m in _RUN.finditer(low)))


def word_counts(docs: DataFrame, slip: int | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: the occurrences of every run of letters, A-Z lower-cased, over whole texts.

    With ``slip``, a run loses a code point in those documents where ``slip`` divides the crc32 of
    ``<id>:<run>`` (see the contract). Null texts have no runs, a null id is written as nothing; runs
    that lose their only code point are no words.
    """
    small_batches(docs.sparkSession)

    def hand_on(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for doc, raw in zip(batch.column("id").to_pylist(), utf8(batch.column("text"))):
                found = runs(raw.decode())
                if slip is None:
                    total.update(found)
                else:
                    ahead, get = zlib.crc32(f"{doc}:".encode()), total.get
                    for word, n in found.items():
                        h = zlib.crc32(word.encode(), ahead)
                        if h % slip == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                        total[word] = get(word, 0) + n
                if len(total) > HELD:
                    yield hand_on(total)
                    total = Counter()
        yield hand_on(total)

    named = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    return named.mapInArrow(count, "word string, n long").filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


class Words:
    """A list of words as one array of code points."""

    def __init__(self, words: list[str]):
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.at = np.cumsum(self.lengths) - self.lengths

    def code(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The code points at these places, -1 outside the word."""
        inside = (place >= 0) & (place < self.lengths[word])
        out = np.full(len(word), -1, np.int64)
        out[inside] = self.codes[(self.at[word] + place)[inside]]
        return out

    def shared(self) -> np.ndarray:
        """The length of the prefix that each word shares with the one before; 0 for the first."""
        out = np.zeros(len(self.lengths), np.int64)
        open_, depth = np.arange(1, len(out)), 0
        while len(open_):
            a = self.code(open_ - 1, np.full(len(open_), depth))
            open_ = open_[(a >= 0) & (a == self.code(open_, np.full(len(open_), depth)))]
            out[open_] += 1
            depth += 1
        return out


def one_edit(asked: Words, listed: Words, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in ``asked``, place in the sorted ``listed``) of words that are exactly one edit apart and share ``start`` code points.

    The list is scanned for all asked words together, one code point deeper at a time. Words that
    share a prefix have the same edit-matrix rows up to there, so a row is worked out once for the
    range of the list that shares the prefix, and the next row only where the list's common prefixes
    (``shared``) end and the range falls apart. A row is three cells wide, since cells further from
    the diagonal are over one edit; a range whose row has no cell of at most one edit is skipped whole.
    """
    n = len(listed.lengths)
    shared = listed.shared()
    shared[:1] = -1
    hits = []
    for first in range(0, len(asked.lengths), AT_ONCE):
        word = np.arange(first, min(first + AT_ONCE, len(asked.lengths)))
        low, high = np.zeros(len(word), np.int64), np.full(len(word), n)
        row = np.tile(np.array([2, 0, 1], np.int8), (len(word), 1))  # cells depth - 1, depth, depth + 1
        depth = 0
        while len(word):
            # Where the ranges fall apart: the next code point of each part is that of its first word.
            starts = np.flatnonzero(shared <= depth)
            begin, end = np.searchsorted(starts, low), np.searchsorted(starts, high)
            parts = end - begin
            of = np.repeat(np.arange(len(word)), parts)
            child = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts) + np.repeat(begin, parts)
            word, row = word[of], row[of]
            low, high = starts[child], np.r_[starts, n][child + 1]
            new = listed.codes[listed.at[low] + depth]
            mine = np.empty_like(row)
            differs = [asked.code(word, np.full(len(word), depth + k)) != new for k in (-1, 0, 1)]
            mine[:, 0] = np.minimum(row[:, 0] + differs[0], row[:, 1] + 1)
            mine[:, 1] = np.minimum(np.minimum(row[:, 1] + differs[1], row[:, 2] + 1), mine[:, 0] + 1)
            mine[:, 2] = np.minimum(row[:, 2] + differs[2], mine[:, 1] + 1)
            depth += 1
            left = asked.lengths[word] - depth  # cells behind the word's end are no cells
            mine[left < 0, 1] = 2
            mine[left < 1, 2] = 2
            mine[left < -1, 0] = 2
            live = mine[:, 1] == 0 if depth <= start else mine.min(axis=1) < 2
            word, row, low, high, left = word[live], np.minimum(mine[live], 2), low[live], high[live], left[live]
            ends = listed.lengths[low] == depth  # the first of a range may end here, and no other
            done = ends & (np.abs(left) < 2)
            done[done] = row[done, left[done] + 1] == 1
            hits.append((word[done], low[done]))
            low = low + ends
            live = low < high
            word, row, low, high = word[live], row[live], low[live], high[live]
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*hits))


def _blocks(words: DataFrame, half: int) -> DataFrame:
    """``block, side, spelt, ns, heads, prefix``: the words in order (side 0), and by their reversal (side 1), cut into blocks."""
    spark = words.sparkSession
    entries = words.select(F.lit(0).alias("side"), F.col("word").alias("spelt"), "n").union(
        words.select(F.lit(1), F.reverse("word"), "n"))
    tasks = max(1, -(-2 * words.count() // (BLOCK * PER_TASK)))
    small_batches(spark, BLOCK)

    def pack(batches):
        def block(side, spelt, ns):
            return pa.RecordBatch.from_pylist([{
                "side": side, "spelt": spelt, "ns": ns, "heads": sorted({w[:half] for w in spelt}), "prefix": commonprefix([spelt[0], spelt[-1]])}],
                schema=schema)

        schema = pa.schema([("side", pa.int32()), ("spelt", pa.list_(pa.string())), ("ns", pa.list_(pa.int64())), ("heads", pa.list_(pa.string())),
                            ("prefix", pa.string())])
        side, spelt, ns = 0, [], []
        for batch in batches:
            for s, w, n in zip(*(batch.column(c).to_pylist() for c in ("side", "spelt", "n"))):
                if spelt and (s != side or len(spelt) == BLOCK):
                    yield block(side, spelt, ns)
                    spelt, ns = [], []
                side = s
                spelt.append(w)
                ns.append(n)
        if spelt:
            yield block(side, spelt, ns)

    packed = entries.repartitionByRange(tasks, "side", "spelt").sortWithinPartitions("side", "spelt").mapInArrow(
        pack, "side int, spelt array<string>, ns array<long>, heads array<string>, prefix string")
    return cut(cut(packed, "word-blocks").withColumn("block", F.monotonically_increasing_id()), "word-blocks")


def _met(blocks: DataFrame) -> DataFrame:
    """Pairs of blocks of one side that share a head and may hold near words: ``x, y``, y null for a block with itself.

    A block of a sorted list is a range: all its words share what its first and last word share.
    Words one edit apart have equally long prefixes at most two edits apart, so ranges whose prefixes
    are further apart are skipped.
    """
    light = blocks.select("side", F.explode("heads").alias("head"), "block", F.col("prefix").alias("p"))
    pairs = light.select("side", "head", F.col("block").alias("i"), "p").join(
        light.select("side", "head", F.col("block").alias("j"), F.col("p").alias("q")), ["side", "head"]).filter("i <= j")
    near = F.levenshtein(F.expr("left(p, least(length(p), length(q)))"), F.expr("left(q, least(length(p), length(q)))"), 2)
    pairs = cut(pairs.filter(near >= 0).select("side", "i", "j").distinct(), "block-pairs")
    held = F.struct("spelt", "ns")
    x = blocks.select(F.col("block").alias("i"), held.alias("x"))
    y = blocks.select(F.col("block").alias("j"), held.alias("y"))
    return pairs.filter("i = j").join(x, "i").select("side", "x", F.lit(None).cast(y.schema["y"].dataType).alias("y")).union(
        pairs.filter("i < j").join(x, "i").join(y, "j").select("side", "x", "y"))


def near_words(words: DataFrame, least: int) -> DataFrame:
    """``word, n_near, best``: how many words of ``words (word, n)`` are one edit away, and the most frequent as ``struct<less, word>``.

    ``words`` holds different words of at least ``least`` code points. ``best.less`` is minus its count;
    ties go to the first in code-point order. One edit leaves the first or the last half of ``least``
    code points as they are, so a word meets the sorted list under its own head, and the list of
    reversed words under its tail; what shares both counts on the first side. Blocks give a count and
    the best of each word, never pairs.
    """
    half = least // 2
    met = _met(_blocks(words, half))
    small_batches(words.sparkSession, 16)

    def run(batches):
        for batch in batches:
            for side, x, y in zip(batch.column("side").to_pylist(), batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                spelt, ns = list(x["spelt"]), list(x["ns"])
                a = Words(spelt)
                if y is None:
                    one, other = one_edit(a, a, half)
                else:
                    one, other = one_edit(a, Words(y["spelt"]), half)
                    one, other = np.r_[one, other + len(spelt)], np.r_[other + len(spelt), one]
                    spelt, ns = spelt + y["spelt"], ns + y["ns"]
                if side:
                    spelt = [w[::-1] for w in spelt]
                    heads = np.unique([w[:half] for w in spelt], return_inverse=True)[1]
                    new = heads[one] != heads[other]
                    one, other = one[new], other[new]
                if not len(one):
                    continue
                place = np.empty(len(spelt), np.int64)
                place[sorted(range(len(spelt)), key=spelt.__getitem__)] = np.arange(len(spelt))
                ns = np.array(ns, np.int64)
                order = np.lexsort((place[other], -ns[other], one))
                one, other = one[order], other[order]
                found, at, count = np.unique(one, return_index=True, return_counts=True)
                best = other[at]
                yield pa.RecordBatch.from_arrays([
                    pa.array([spelt[i] for i in found]), pa.array(count.astype(np.int64)), pa.array(-ns[best]), pa.array([spelt[i] for i in best])],
                    ["word", "near", "less", "other"])

    found = met.mapInArrow(run, "word string, near long, less long, other string")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", F.col("other").alias("word"))).alias("best"))


def _roots(links: DataFrame) -> DataFrame:
    """``word, root`` of every word with a form: forms followed to the last, in steps that double.

    A form is several times as frequent as its word, so chains are as long as the logarithm of the
    largest count at most, and the rounds as its logarithm.
    """
    at = cut(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = cut(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def group_variants(words: DataFrame, least: int = 6, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``words (word, n)`` with at least ``least`` code points.

    Two words are near if one inserted, deleted or replaced code point makes one of the other. The
    form of a word is its near word of largest n (ties: first in code-point order) if that is at least
    ``ratio`` times its own, else null; the root follows forms to the last. Rows that repeat a word
    are added up, null words are left out, shorter words too; other columns play no part; no words give
    no rows. Words of any length work: a scan goes as deep as its longest word that still has company.
    """
    counted = cut(words.filter(F.char_length("word") >= least).groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    near = cut(near_words(counted, least), "near-words")
    formed = counted.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.word").alias("form"), (-F.col("best.less")).alias("form_n"))
    fits = F.coalesce(F.col("form_n") >= F.col("n").cast("decimal(38,0)") * ratio, F.lit(False))
    formed = cut(formed.select("word", "n", "n_near", F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")), "forms")
    roots = _roots(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, slip: int | None = None, least: int = 6, often: int = 5, ratio: int = 5,
                      id: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`group_variants` over the runs of letters that occur at least ``often`` times in whole texts.

    Null and empty texts have none; repeated rows count again; very long texts are counted run by run.
    """
    counts = word_counts(docs, slip, id, text)
    return group_variants(counts.filter((F.col("n") >= often) & (F.char_length("word") >= least)), least, ratio)
