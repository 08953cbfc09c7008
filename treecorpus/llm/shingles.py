"""Near copies by the exact similarity of their word shingles: SimHash and its deletion variants, prefix lists, verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from treecorpus.llm.common import cut, discard, fresh, id_of, release, small_batches, small_broadcasts, utf8
from treecorpus.llm.components import components, spanning
from treecorpus.llm.simhash import AT_ONCE as HASHES, links as print_links

#: The least similarity is LEAST / OUT_OF; whole numbers, so that no rounding decides.
LEAST, OUT_OF = 4, 5
#: Bits in which two SimHashes may differ to make a candidate.
DISTANCE = 3
#: Bits of a parity fingerprint, and of the one that candidates are held against before their sets are joined.
BITS, WIDE = 2048, 8192
#: Most bits of a long text's own fingerprint, and bytes of fingerprints that are compared at once.
WIDEST, COMPARED = 1 << 17, 1 << 21
#: Nodes in a block, and shingles of all nodes whose sets meet; of a block pair at most AT_ONCE pairs of
#: fingerprints are compared at once, and WORDS different shingles.
BLOCK, FULL, AT_ONCE, WORDS = 1024, 1 << 20, 1 << 15, 4096
#: Texts from which the order of the shingles is learned, and shingles that it moves to the end.
SAMPLE, COMMON = 4096, 1 << 16

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int = 5, seed: int = 42) -> np.ndarray:
    """The 64-bit hashes of the text's distinct word shingles, in ascending order."""
    words = text.lower().split()  # on bytes: A-Z, and the ASCII white space
    n = min(len(words), width)
    if not n:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))
    total = len(words) - n + 1
    out = np.full(total, n, np.uint64)
    for i in range(n):
        out = _mixed(out * _B + hashes[i:i + total])
    return np.unique(out)


def name_of(found: np.ndarray) -> int:
    """One signed long for a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 7)).view(np.int64))


def simhash(found: np.ndarray) -> int:
    """A signed long: each of 64 bits is set if it is set in over half the set's hashes; zero for no shingles."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(found), HASHES):
        part = np.ascontiguousarray(found[a:a + HASHES], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view("<i8")[0])


def parity(found: np.ndarray, bits: int = BITS) -> bytes:
    """A bit is set if an odd number of shingles fall on it.

    A shingle that only one of two sets has flips one bit, so two fingerprints never differ in more
    bits than the sets differ in shingles.
    """
    hits = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((hits & 1).astype(np.uint8), bitorder="little").tobytes()


def wide_parity(found: np.ndarray) -> bytes | None:
    """The parity fingerprint of a text with so many shingles that ``BITS`` tell nothing apart: two to four bits for each."""
    bits = min(1 << (2 * len(found) - 1).bit_length(), WIDEST) if len(found) else 0
    return parity(found, bits) if bits > BITS else None


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """Rows of fingerprints as the narrower ones of ``width`` 64-bit words that :func:`parity` would give."""
    return np.bitwise_xor.reduce(words.reshape(len(words), -1, width), axis=1)


def prefix(found: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 shingles by (rank, hash): two sets that are 0.8 alike share one of them."""
    n = len(found)
    if not n:
        return found
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        rank = np.where(common[at] == found, ranks[at], 0)
    return found[np.lexsort((found, rank))][:n - -(-LEAST * n // OUT_OF) + 1]


def _sets(docs: DataFrame, width: int, id: str, text: str) -> DataFrame:
    """``doc, node, shingles, n, parity`` of every row, the parity fingerprint being the wide one."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = [shingles(x, width) for x in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc"), pa.array([name_of(s) for s in found], pa.int64()),
                pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())), pa.array([len(s) for s in found], pa.int64()),
                pa.array([parity(s, WIDE) for s in found], pa.binary())], ["doc", "node", "shingles", "n", "parity"])

    return docs.select(id_of(id).alias("doc"), F.col(text).alias("text")).mapInArrow(
        run, "doc long, node long, shingles array<long>, n long, parity binary")


def _common(docs: DataFrame, width: int, id: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the shingles that are frequent in a sample, by hash.

    They come last in the prefix order, which keeps the lists of prefixes short. Any order gives the
    same links, so the sample decides nothing but the time.
    """
    every = max(1, docs.count() // SAMPLE)
    # Hash of id and text: rows that share an id are not all in or all out of the sample.
    few = docs.filter(F.pmod(F.xxhash64(id, text), F.lit(every)) == 0).dropDuplicates([text])
    counts = _sets(few, width, id, text).select(F.explode("shingles").alias("key")).groupBy("key").count().filter("count > 2")
    rows = counts.orderBy(F.desc("count"), "key").limit(COMMON).collect()
    keys = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r[1] for r in rows], np.int64)[order]


def _rows(docs: DataFrame, width: int, id: str, text: str) -> DataFrame:
    """``doc, node, n, prefix, parity, wide, print`` of every row."""
    common, ranks = _common(docs, width, id, text)
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = [shingles(x, width) for x in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc"), pa.array([name_of(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()),
                pa.array([prefix(s, common, ranks).view(np.int64) for s in found], pa.list_(pa.int64())),
                pa.array([parity(s) for s in found], pa.binary()), pa.array([wide_parity(s) for s in found], pa.binary()),
                pa.array([simhash(s) for s in found], pa.int64())], ["doc", "node", "n", "prefix", "parity", "wide", "print"])

    return docs.select(id_of(id).alias("doc"), F.col(text).alias("text")).mapInArrow(
        run, "doc long, node long, n long, prefix array<long>, parity binary, wide binary, print long")


def _alike(nodes: DataFrame) -> DataFrame:
    """``a, b``: candidates by SimHash. Nodes of one print meet its least node, and least nodes meet along the links of prints.

    Prints link at ``DISTANCE`` or fewer bits by their deletion variants, which give spanning edges (:func:`simhash.links`),
    so there are fewer candidates than nodes and prints with edges together.
    """
    least = cut(nodes.groupBy("print").agg(F.min("node").alias("a")), "near-prints")
    same = nodes.select("node", "print").join(least, "print").filter("node <> a").select("a", F.col("node").alias("b"))
    near = print_links(least.select("print"), DISTANCE)
    near = near.join(least.select(F.col("print").alias("src"), "a"), "src").join(
        least.select(F.col("print").alias("dst"), F.col("a").alias("b")), "dst").select("a", "b")
    return cut(same.union(near), "near-alike")


def _sizes_allow(a: str, b: str) -> Column:
    return OUT_OF * F.least(a, b) >= LEAST * F.greatest(a, b)


def _may_link(differing, n_a, n_b):
    """What 0.8 allows: sets of n_a and n_b shingles that differ in at most (n_a + n_b) / 9."""
    return (OUT_OF + LEAST) * differing <= (OUT_OF - LEAST) * (n_a + n_b)


def _close(pairs: DataFrame, nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """The ``a, b`` of ``pairs`` whose parity fingerprints allow a link."""
    small_batches(pairs.sparkSession)
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("y"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, bits // 64) for c in "xy")
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            good = _may_link(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64), n_a, n_b)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(run, "a long, b long")


def _sets_of(asked: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, id: str, text: str) -> DataFrame:
    """:func:`_sets` of the ``asked (node)``, made again from one text each."""
    asked = cut(nodes.select("node", "doc").join(asked.distinct(), "node"), "near-asked")
    name = fresh(docs, "wanted")
    texts = docs.join(asked.select(F.col("doc").alias(name)).distinct(), id_of(id) == F.col(name), "left_semi")
    sets = _sets(texts, width, id, text).drop("doc").join(asked.select("node"), "node", "left_semi").dropDuplicates(["node"])
    return cut(sets, "near-sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingle sets are 0.8 alike, as edges ``src, dst``."""
    pairs = cut(_close(pairs, sets, WIDE), "near-pairs")  # long texts that the short fingerprint cannot tell apart go here
    small_batches(pairs.sparkSession, 256)

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                both = len(np.intersect1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True))
                good.append(OUT_OF * both >= LEAST * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_())).rename_columns(["src", "dst"])

    return pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(
        run, "src long, dst long")


def _in_common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many numbers each array of ``x`` shares with each of ``y``; no array holds a number twice."""
    out = np.zeros((len(x), len(y)), np.float32)
    flat = [np.concatenate(part) if part else np.zeros(0, np.int64) for part in (x, y)]
    owner = [np.repeat(np.arange(len(part)), [len(a) for a in part]) for part in (x, y)]
    both = np.intersect1d(*flat)
    at = [np.searchsorted(both, f) for f in flat]
    kept = [(i < len(both)) & (both[np.minimum(i, len(both) - 1)] == f) if len(both) else np.zeros(len(f), bool) for i, f in zip(at, flat)]
    at, owner = [i[k] for i, k in zip(at, kept)], [o[k] for o, k in zip(owner, kept)]
    for start in range(0, len(both), WORDS):
        part = []
        for i, o, rows in zip(at, owner, (len(x), len(y))):
            here = (i >= start) & (i < start + WORDS)
            has = np.zeros((rows, min(WORDS, len(both) - start)), np.float32)
            has[o[here], i[here] - start] = 1
            part.append(has)
        out += part[0] @ part[1].T
    return out


def _across(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """``key, i, j, node, component``: the nodes that may link to another component in a block pair of a list.

    ``hits`` is ``key, node, component``. Lists are compared in blocks. Two nodes may link if their
    components differ and their fingerprints allow it. What comes out is nodes, however many pairs
    they make.
    """
    held = hits.groupBy("key").agg(F.count("*").alias("m"), F.min("component").alias("p"), F.max("component").alias("q"))
    held = cut(held.filter("m > 2 and p <> q").select("key", F.ceil(F.col("m") / BLOCK).cast("long").alias("blocks")), "near-lists")
    members = hits.join(held, "key").join(nodes.select("node", "n", "parity"), "node")
    listed = F.collect_list(F.struct("node", "n", "component", "parity"))
    # A list of one block meets itself and needs no join.
    zero = F.lit(0).cast("long")
    single = members.filter("blocks = 1").groupBy("key").agg(listed.alias("x")).select("key", zero.alias("i"), zero.alias("j"), "x", F.col("x").alias("y"))
    held = held.filter("blocks > 1")
    filled = cut(members.filter("blocks > 1").groupBy("key", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")).agg(
        listed.alias("of")), "near-blocks")
    todo = held.select("key", "blocks", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("i"))
    todo = todo.select("key", "i", F.explode(F.sequence(F.col("i"), F.col("blocks") - 1)).alias("j"))
    met = todo.join(filled.select("key", F.col("block").alias("i"), F.col("of").alias("x")), ["key", "i"]).join(
        filled.select("key", F.col("block").alias("j"), F.col("of").alias("y")), ["key", "j"]).select("key", "i", "j", "x", "y")
    met = single.union(met)
    small_batches(hits.sparkSession, 256)

    def columns(value):
        value = value.values
        node, n, component = (value.field(c).to_numpy() for c in ("node", "n", "component"))
        return node, n, component, np.frombuffer(b"".join(value.field("parity").to_pylist()), np.uint64).reshape(-1, BITS // 64)

    def run(batches):
        for batch in batches:
            for key, i, j, one, other in zip(*(batch.column(c) for c in ("key", "i", "j", "x", "y"))):
                node_x, n_x, c_x, x = columns(one)
                node_y, n_y, c_y, y = columns(other)
                small, large = np.minimum(n_x[:, None], n_y[None, :]), np.maximum(n_x[:, None], n_y[None, :])
                rows, cols = np.nonzero((c_x[:, None] != c_y[None, :]) & (OUT_OF * small >= LEAST * large))
                in_x, in_y = np.zeros(len(node_x), bool), np.zeros(len(node_y), bool)
                for s in range(0, len(rows), AT_ONCE):
                    r, c = rows[s:s + AT_ONCE], cols[s:s + AT_ONCE]
                    good = _may_link(np.bitwise_count(x[r] ^ y[c]).sum(axis=1, dtype=np.int64), n_x[r], n_y[c])
                    in_x[r[good]] = True
                    in_y[c[good]] = True
                if in_x.any():
                    nodes, at = np.unique(np.r_[node_x[in_x], node_y[in_y]], return_index=True)
                    same = [pa.array([v.as_py()] * len(nodes), pa.int64()) for v in (key, i, j)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(nodes), pa.array(np.r_[c_x[in_x], c_y[in_y]][at])], ["key", "i", "j", "node", "component"])

    return met.mapInArrow(run, "key long, i long, j long, node long, component long")


def _paired(asked: DataFrame, sizes: DataFrame) -> DataFrame:
    """``asked (key, i, j, node, component)`` with ``s, t``: groups of more than ``FULL`` shingles fall into parts that meet in pairs."""
    sized = asked.join(sizes, "node")
    parts = sized.groupBy("key", "i", "j").agg(F.ceil(F.sum("n") / FULL).cast("long").alias("parts"))
    own = sized.drop("n").join(parts, ["key", "i", "j"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("parts"), F.lit(1)) - 1)).alias("other")
    # Written, so that Spark knows how few they are before it shuffles what they are joined with.
    return cut(own.select("key", "i", "j", "node", "component", "own", other).select(
        "key", "i", "j", F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"), "node", "component"), "near-groups")


def _met(asked: DataFrame, held: DataFrame, column: str) -> DataFrame:
    """The groups of ``asked`` as lists ``of`` node, component and what ``held (node, column)`` has of the node."""
    small_batches(asked.sparkSession, 64)
    group = ["key", "i", "j", "s", "t"]
    return asked.join(held.select("node", F.col(column).alias("held")), "node").groupBy(*group).agg(
        F.collect_list(F.struct("node", "component", "held")).alias("of"))


def _items(value):
    items = value.values
    return items.field("node").to_numpy(), items.field("component").to_numpy(), [a.values.to_numpy() for a in items.field("held")]


def _links_possible(component: np.ndarray, n: np.ndarray, prints: list[bytes]) -> np.ndarray:
    """Which nodes have one of another component next to them whose fingerprint, each as wide as its text is long, allows a link."""
    widths, out = np.array([len(p) // 8 for p in prints]), np.zeros(len(n), bool)
    for width in np.unique(widths):  # pairs whose narrower fingerprint has so many words; the other is folded
        held = np.flatnonzero(widths >= width)
        words = np.stack([folded(np.frombuffer(prints[i], np.uint64)[None, :], width)[0] for i in held])
        own_n, own, narrow = n[held], component[held], widths[held] == width
        for r in np.flatnonzero(narrow):
            c = np.flatnonzero((own != own[r]) & (OUT_OF * np.minimum(own_n, own_n[r]) >= LEAST * np.maximum(own_n, own_n[r])))
            step = max(1, COMPARED // (8 * int(width)))
            for at in (c[s:s + step] for s in range(0, len(c), step)):
                at = at[_may_link(np.bitwise_count(words[at] ^ words[r]).sum(axis=1, dtype=np.int64), own_n[at], own_n[r])]
                out[held[at]] = True
                out[held[r]] |= len(at) > 0
    return out


def _still_possible(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``asked`` that may link to another of their block pair by the wide fingerprints.

    Long texts pass the short fingerprints whatever they say; here they go before their prefixes and
    shingle sets travel, which take many times as much.
    """

    def run(batches):
        for batch in batches:
            for key, i, j, value in zip(batch.column("key").to_pylist(), batch.column("i").to_pylist(), batch.column("j").to_pylist(), batch.column("of")):
                items = value.values
                node, component, held = (items.field(c) for c in ("node", "component", "held"))
                node, component = node.to_numpy(), component.to_numpy()
                good = _links_possible(component, held.field("n").to_numpy(), held.field("print").to_pylist())
                if good.any():
                    n = int(good.sum())
                    yield pa.RecordBatch.from_arrays([*[pa.array([v] * n, pa.int64()) for v in (key, i, j)], pa.array(node[good]), pa.array(component[good])],
                                                     ["key", "i", "j", "node", "component"])

    held = nodes.select("node", F.struct("n", F.coalesce("wide", "parity").alias("print")).alias("wide"))
    met = _met(_paired(asked, nodes.select("node", "n")), held, "wide").select("key", "i", "j", "of")
    return met.mapInArrow(run, "key long, i long, j long, node long, component long").distinct()


def _first_lists(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``asked`` that have a node of another component next to them with which they share no list of a smaller key.

    A pair that may link is looked at in the first of the lists it shares, so the shingle sets need not
    travel to the others.
    """

    def run(batches):
        for batch in batches:
            for key, i, j, value in zip(batch.column("key").to_pylist(), batch.column("i").to_pylist(), batch.column("j").to_pylist(), batch.column("of")):
                node, component, prefixes = _items(value)
                ahead = [p[p < key] for p in prefixes]
                new = ((component[:, None] != component[None, :]) & (_in_common(ahead, ahead) == 0)).any(axis=1)
                if new.any():
                    n = int(new.sum())
                    yield pa.RecordBatch.from_arrays([*[pa.array([v] * n, pa.int64()) for v in (key, i, j)], pa.array(node[new]), pa.array(component[new])],
                                                     ["key", "i", "j", "node", "component"])

    met = _met(_paired(asked, nodes.select("node", "n")), nodes, "prefix").select("key", "i", "j", "of")
    return met.mapInArrow(run, "key long, i long, j long, node long, component long").distinct()


def _spanned(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges ``src, dst`` that join the components which the nodes ``asked (key, i, j, node, component)`` of a block pair link.

    Every group has the shingle sets of its nodes and counts what they share; of the links only
    spanning edges go on.
    """

    def run(batches):
        for batch in batches:
            for value in batch.column("of"):
                node, component, found = _items(value)
                n = np.array([len(a) for a in found], np.float64)
                both = _in_common(found, found).astype(np.float64)
                link = (component[:, None] != component[None, :]) & (OUT_OF * both >= LEAST * (n[:, None] + n[None, :] - both))
                if link.any():
                    names = np.r_[node, node]
                    a, b = spanning(link)
                    yield pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], ["src", "dst"])

    met = _met(_paired(asked, sets.select("node", "n")), sets, "shingles")
    return met.select("of").mapInArrow(run, "src long, dst long").filter("src <> dst")


def near_duplicates(docs: DataFrame, width: int = 5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, node, component`` of every row; ids never null, the component is its least id.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space. Two texts link if the sets
    of their shingles of ``width`` words have at least 0.8 of their union in common; a shorter text is
    one shingle, texts without words (null, empty) are equal. Candidates come from SimHashes of the
    shingles whose deletion variants meet. What differs in more bits is found too: a linked pair shares
    a shingle of its prefixes. First every node meets the least node of each of its lists; then what
    lists still bring together from two components is compared in blocks, which give spanning edges
    and no pairs. Candidates pass the parity fingerprints, which lose no link, and are verified by
    their shingles. Copies are one node; texts of any length are hashed whole; other columns play no
    part.
    """
    small_broadcasts(docs.sparkSession)
    release(docs.sparkSession)
    whole = cut(_rows(docs, width, id, text), "near-rows")
    nodes = cut(whole.groupBy("node").agg(F.min("doc").alias("doc"), *[F.first(c).alias(c) for c in ("n", "prefix", "parity", "wide", "print")]), "near-nodes")
    rows = cut(whole.select("doc", "node"), "near-names")
    discard(whole)
    alike = _alike(nodes)
    release(docs.sparkSession)
    entries = nodes.select("node", "n", F.explode("prefix").alias("key"))
    keys = entries.groupBy("key").agg(F.min(F.struct("node", "n")).alias("least"), F.count("*").alias("m")).filter("m > 1")
    keys = cut(keys.select("key", F.col("least.node").alias("a"), F.col("least.n").alias("n_a")), "near-keys")
    # Entries have a row per shingle of a prefix, which Spark does not count when it sizes them.
    release(docs.sparkSession)
    hits = cut(entries.hint("merge").join(keys, "key"), "near-hits")
    release(docs.sparkSession)
    stars = hits.filter((F.col("node") != F.col("a")) & _sizes_allow("n", "n_a")).select("a", F.col("node").alias("b")).distinct()
    stars = cut(_close(stars.union(alike).distinct(), nodes), "near-stars")
    sets = _sets_of(stars.select(F.col("a").alias("node")).union(stars.select("b")), nodes, docs, width, id, text)
    links = cut(_verified(stars, sets), "near-links")
    discard(sets)
    found = cut(components(links), "near-first")
    release(docs.sparkSession)
    labelled = cut(hits.select("key", "node").join(found, "node", "left").select(
        "key", "node", F.coalesce("root", "node").alias("component")), "near-labelled")
    discard(hits)
    release(docs.sparkSession)
    maybe = cut(_across(labelled, nodes), "near-maybe")
    release(docs.sparkSession)
    more = cut(_first_lists(cut(_still_possible(maybe, nodes), "near-possible"), nodes), "near-more")
    release(docs.sparkSession)
    links = links.union(_spanned(more, _sets_of(more.select("node"), nodes, docs, width, id, text)))
    found = cut(components(links), "near-all")
    rooted = nodes.join(found, "node", "left").select("node", "doc", F.coalesce("root", "node").alias("root"))
    least = cut(rooted.groupBy("root").agg(F.min("doc").alias("component")), "near-least")
    named = cut(rooted.join(least, "root").select("node", "component"), "near-components")
    return rows.select("doc", "node").join(named, "node").select("doc", "node", "component")


def drop_near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its component; of rows with one id all stay together.

    Texts are read as by :func:`near_duplicates`, whatever their length; no rows give no rows. All columns
    come out as they are, whatever their names.
    """
    found, name = near_duplicates(docs, width), fresh(docs, "gone")
    gone = found.filter(F.col("doc") != F.col("component")).select(F.col("doc").alias(name)).distinct()
    return docs.join(gone, id_of("doc_id") == F.col(name), "left_anti")
