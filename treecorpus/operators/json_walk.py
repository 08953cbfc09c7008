"""The JSON walk: one row per value of a body, in document order.

Everything the tree operators ask of a body is a filter over this table. VARIANT sorts keys and
cannot give document order, so the walk parses text in an Arrow stage (narrow, no shuffle).
Bodies repeat a few shapes, so all that depends only on the place of a value (path, key, filters
on them) is worked out once per place and joined in by Arrow; selectors are applied inside the
stage, and only the columns asked for leave it.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LEAF_COLUMNS = {
    "ord": ("int", pa.int32()), "parent_ord": ("int", pa.int32()),
    "path": ("string", pa.string()), "slot_path": ("string", pa.string()), "key": ("string", pa.string()),
    "parent_key": ("string", pa.string()), "top_key": ("string", pa.string()),
    "seg": ("array<string>", pa.list_(pa.string())),
    "json_type": ("string", pa.string()), "value": ("string", pa.string()),
    "sibling_value": ("string", pa.string()), "sibling_type": ("string", pa.string()),
    "shared": ("boolean", pa.bool_()),
}
BY_PLACE = ("path", "slot_path", "key", "parent_key", "top_key", "seg")
ALLOWABLE = "@Redfish.AllowableValues"
FLUSH_ROWS = 50_000
MAX_PLACES = 200_000

KINDS = {str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null", dict: "object",
         list: "array"}


def value_text(value) -> str | None:
    """Scalars as plain text, containers as JSON text."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value) if isinstance(value, (dict, list)) else str(value)


class Place:
    """One place in the bodies: the keys that lead to it, with list levels marked in the path."""

    __slots__ = ("index", "path", "slot_path", "key", "parent_key", "top_key", "seg", "kept", "annotation", "members",
                 "item")

    def __init__(self, places: list, path="", slot_path="", key=None, parent_key=None, seg=(), keep=None):
        self.index, self.path, self.slot_path, self.key, self.parent_key = len(places), path, slot_path, key, parent_key
        self.seg, self.top_key = list(seg), seg[0] if seg else None
        self.kept = keep is None or keep(self)
        self.annotation = key is not None and key.endswith(ALLOWABLE)
        self.members, self.item = {}, None
        places.append(self)

    def member(self, name: str, places: list, keep) -> "Place":
        join = lambda base: f"{base}.{name}" if base else name
        place = Place(places, join(self.path), join(self.slot_path), name, self.key, (*self.seg, name), keep)
        self.members[name] = place
        return place

    def items(self, places: list, keep) -> "Place":
        self.item = Place(places, self.path + "[]", self.slot_path, None, self.key, tuple(self.seg), keep)
        return self.item


class Walker:
    """Collects the rows of decoded bodies column by column."""

    def __init__(self, keep: Callable[[Place], bool] | None):
        self.keep = keep
        self.forget()

    def forget(self):
        self.places: list[Place] = []
        self.root = Place(self.places, keep=self.keep)
        self.clear()

    def clear(self):
        self.record, self.ord, self.parent, self.place = [], [], [], []
        self.kind, self.text, self.near, self.near_kind, self.shared = [], [], [], [], []

    def walk(self, body, record: int) -> None:
        """Depth first, on an explicit stack, so that no nesting is too deep."""
        places, keep = self.places, self.keep
        order = 0
        stack = [(body, None, self.root, None)]
        while stack:
            value, parent, place, holder = stack.pop()
            kind = KINDS[type(value)]
            if place.kept:
                text = near = near_kind = None
                if kind == "string":
                    text = value
                elif kind not in ("object", "array", "null"):
                    text = str(value)
                elif kind == "array" and place.annotation:
                    # An allowable-value list carries its text and the property it describes.
                    text = json.dumps(value)
                    described = holder.get(place.key[: -len(ALLOWABLE)])
                    near, near_kind = value_text(described), KINDS[type(described)]
                self.record.append(record)
                self.ord.append(order)
                self.parent.append(parent)
                self.place.append(place.index)
                self.kind.append(kind)
                self.text.append(text)
                self.near.append(near)
                self.near_kind.append(near_kind)
            if kind == "object":
                members = place.members
                for name in reversed(value):
                    stack.append((value[name], order, members.get(name) or place.member(name, places, keep), value))
            elif kind == "array" and value:
                item = place.item or place.items(places, keep)
                for entry in reversed(value):
                    stack.append((entry, order, item, None))
            order += 1

    def mark_shared(self) -> None:
        """Fill ``shared`` for the rows of the last record: whether its kept values have the path of another, or an allowable-value list."""
        here = [self.places[at] for at in self.place[len(self.shared):]]
        paths = [place.path for place in here]
        if any(place.annotation for place in here):
            self.shared += [True] * len(here)
        elif len(set(paths)) == len(paths):
            self.shared += [False] * len(here)
        else:
            count = Counter(paths)
            self.shared += [count[path] > 1 for path in paths]

    def batch(self, carried: dict, fields: Sequence[str]) -> pa.RecordBatch:
        own = {"ord": self.ord, "parent_ord": self.parent, "json_type": self.kind, "value": self.text,
               "sibling_value": self.near, "sibling_type": self.near_kind, "shared": self.shared}
        rows, at = pa.array(self.record, pa.int32()), pa.array(self.place, pa.int32())
        arrays = [column.take(rows) for column in carried.values()]
        for name in fields:
            kind = LEAF_COLUMNS[name][1]
            if name in BY_PLACE:
                arrays.append(pa.array([getattr(p, name) for p in self.places], kind).take(at))
            else:
                arrays.append(pa.array(own[name], kind))
        out = pa.RecordBatch.from_arrays(arrays, [*carried, *fields])
        self.clear()
        if len(self.places) > MAX_PLACES:
            self.forget()
        return out


def decode(text: str):
    """The value of a JSON text; lone surrogates, which no column can hold, become U+FFFD.

    Raises ValueError for what is not JSON, for integers beyond Python's digit limit, and for
    nesting beyond the parser's depth.
    """
    try:
        value = json.loads(text)
        if "\\ud" in text.lower():
            whole = json.dumps(value, ensure_ascii=False).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
            value = json.loads(whole)
    except RecursionError:
        raise ValueError("too deep") from None
    return value


def unreadable(records: DataFrame, carry: Sequence[str] = ("url", "seq"), body: str = "body") -> DataFrame:
    """``carry`` and ``reason`` of the bodies that :func:`json_walk` leaves out: missing, too deep, or malformed."""

    def stage(batches):
        for batch in batches:
            reasons = []
            for text in batch.column(body).to_pylist():
                reason = "missing" if text is None else None
                try:
                    if text is not None:
                        decode(text)
                except ValueError as error:
                    reason = "too deep" if str(error) == "too deep" else "malformed"
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(reasons, pa.string())], [*carry, "reason"])

    shape = [f"`{c}` {records.schema[c].dataType.simpleString()}" for c in carry]
    return records.select(*carry, body).mapInArrow(stage, ", ".join([*shape, "reason string"])).filter("reason is not null")


def mentions(*texts: str, body: str = "body") -> Column:
    """Whether a raw body may hold one of the texts: a body with escapes may spell them otherwise, so it passes too."""
    found = F.col(body).contains("\\")
    for text in texts:
        found = found | F.col(body).contains(text)
    return found


def json_walk(
    records: DataFrame,
    carry: Sequence[str] = ("url", "seq"),
    body: str = "body",
    keys: Sequence[str] | None = None,
    annotations: bool = False,
    keep: Callable[[Place], bool] | None = None,
    fields: Sequence[str] = tuple(LEAF_COLUMNS),
) -> DataFrame:
    """Walk ``body`` of every record; ``fields`` of :data:`LEAF_COLUMNS` come out.

    ``keys`` keeps only values held under those keys; ``annotations`` only non-empty
    allowable-value lists; ``keep`` is any test of a place. Bodies that cannot be read give no rows here;
    :func:`unreadable` lists them.
    """
    source = records.select(*carry, body)
    test = keep
    # Selections are also made as substring tests on the raw text, before Python sees the row.
    # An escaped key would not match literally, so rows with escapes always go through.
    if keys is not None:
        wanted = frozenset(keys)
        literal = F.col(body).contains("\\u")
        for key in sorted(wanted):
            literal = literal | F.col(body).contains(f'"{key}"')
        source = source.filter(literal)
        test = lambda place: place.key in wanted
    elif annotations:
        source = source.filter(F.col(body).contains(ALLOWABLE) | F.col(body).contains("\\u"))
        test = lambda place: place.key is not None and place.key.endswith(ALLOWABLE)

    def stage(batches):
        walker = Walker(test)
        for batch in batches:
            carried = {c: batch.column(c) for c in carry}
            for position, text in enumerate(batch.column(body).to_pylist()):
                try:
                    value = decode(text) if text is not None else None
                except ValueError:
                    continue
                if value is None:
                    continue
                walker.walk(value, position)
                if "shared" in fields:
                    walker.mark_shared()
                if len(walker.ord) >= FLUSH_ROWS:
                    yield walker.batch(carried, fields)
            if walker.ord:
                yield walker.batch(carried, fields)

    shape = [f"`{c}` {records.schema[c].dataType.simpleString()}" for c in carry]
    shape += [f"{name} {LEAF_COLUMNS[name][0]}" for name in fields]
    leaves = source.mapInArrow(stage, ", ".join(shape))
    return leaves.filter("json_type = 'array' and value <> '[]'") if annotations else leaves


def is_scalar() -> Column:
    return F.col("json_type").isin("string", "integer", "number", "boolean")


def value_at_path(leaves: DataFrame, paths: DataFrame, on: Sequence[str] = ("url",)) -> DataFrame:
    """Left lookup of ``paths(on…, path)`` in the walk; arrays stop the lookup (null)."""
    found = leaves.filter(~F.col("path").contains("[]") & (F.col("path") != "")).select(
        *on, "path", F.col("value").alias("found_value"), F.col("json_type").alias("found_type")
    )
    return paths.join(found, [*on, "path"], "left")


def fingerprints(leaves: DataFrame, record: str = "url") -> DataFrame:
    """``record, ord, path, digest`` of every value of the walk: equal digests for equal values, whatever the order of keys.

    ``leaves`` are a whole :func:`json_walk` with ``ord, parent_ord, key, path, json_type, value`` of one body per
    ``record``. A scalar's digest is made of its type and text (integers and floats are one class, by
    their value as a double), an object's of its keys and their digests in key order, a list's of its
    items' in place. Digests go up one level of nesting a round, from values whose members are all
    known; every round is written, so the plan stays small. Members of one value stand in one row.
    """
    from treecorpus.session import scratch_path

    spark = leaves.sparkSession

    def written(frame, name):
        path = scratch_path(spark, name)
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    number = F.col("json_type").isin("integer", "number")
    text = F.when(number, F.coalesce(F.expr("cast(try_cast(value as double) as string)"), "value")).otherwise(F.coalesce("value", F.lit("")))
    nodes = written(leaves.select(record, "ord", "parent_ord", "key", "path", "json_type", text.alias("text")), "nodes")
    kids = nodes.filter("parent_ord is not null").groupBy(record, F.col("parent_ord").alias("ord")).agg(F.count("*").alias("n"))
    if not kids.join(nodes.select(record, "ord"), [record, "ord"], "left_anti").isEmpty():
        raise ValueError("the walk is not whole: some values' parents are missing")
    nodes = nodes.join(kids, [record, "ord"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    container = F.col("json_type").isin("object", "array")
    kind = F.when(number, "number").otherwise(F.col("json_type"))
    alone = F.when(container, F.md5(F.concat("json_type", F.lit(":")))).otherwise(F.md5(F.concat(kind, F.lit(":"), "text")))
    fresh = written(nodes.filter("n = 0").withColumn("digest", alone), "digests")
    waiting = written(nodes.filter("n > 0"), "waiting")
    held = known = fresh
    while not waiting.isEmpty():
        # An object's members go by key, a list's (without keys) by place.
        members = held.filter("parent_ord is not null").groupBy(record, F.col("parent_ord").alias("ord")).agg(
            F.count("*").alias("m"), F.array_sort(F.collect_list(F.struct("key", F.col("ord").alias("at"), "digest"))).alias("members"))
        ready = waiting.join(members, [record, "ord"]).filter("m = n")
        listed = F.array_join(F.transform("members", lambda x: F.concat(
            F.coalesce(F.concat(F.length(x["key"]).cast("string"), F.lit(" "), x["key"], F.lit("=")), F.lit("")), x["digest"])), ",")
        fresh = written(ready.withColumn("digest", F.md5(F.concat("json_type", F.lit(":"), listed))).drop("m", "members"), "digests")
        if fresh.isEmpty():
            raise ValueError("values that are members of themselves")
        known = known.unionByName(fresh)
        waiting = written(waiting.join(fresh.select(record, "ord"), [record, "ord"], "left_anti"), "waiting")
        # What went into a value is not looked at again.
        used = fresh.select(record, F.col("ord").alias("parent_ord"))
        held = written(held.join(used, [record, "parent_ord"], "left_anti").unionByName(fresh, allowMissingColumns=True), "held")
    return known.select(record, "ord", "path", "digest")


def register_sql(spark: SparkSession, name: str = "json_walk") -> None:
    """Make the walk a table function of the session: ``SELECT … FROM t, LATERAL json_walk(t.body)``.

    Its rows are those of :func:`json_walk`, with all columns, in document order. A body that cannot be
    read, or is null, has none. Places that bodies share are worked out once per task.
    """
    shape = ", ".join(f"{column} {kind}" for column, (kind, _) in LEAF_COLUMNS.items())

    class Walk:
        def __init__(self):
            self.walker = Walker(None)

        def eval(self, body: str):
            try:
                value = decode(body) if body is not None else None
            except ValueError:
                return
            if value is None:
                return
            walker = self.walker
            walker.walk(value, 0)
            walker.mark_shared()
            places = [walker.places[at] for at in walker.place]
            own = {"ord": walker.ord, "parent_ord": walker.parent, "json_type": walker.kind, "value": walker.text,
                   "sibling_value": walker.near, "sibling_type": walker.near_kind, "shared": walker.shared}
            rows = list(zip(*[[getattr(p, c) for p in places] if c in BY_PLACE else own[c] for c in LEAF_COLUMNS]))
            walker.clear()
            if len(walker.places) > MAX_PLACES:
                walker.forget()
            yield from rows

    spark.udtf.register(name, F.udtf(Walk, returnType=shape, useArrow=False))
