"""A trie of conversation prefixes, as double arrays per range of paths.

A path is the string of a conversation's turn keys, 20 bytes each (two hashes of
role and text, and the size of the text).  Equal paths are counted first, then
distinct paths are sorted into ranges of about ``RANGE_TURNS`` turns.  Paths with
a common prefix are neighbours, so a range is a prefix shard that no common
prefix can make larger than others.

A task packs the turns of its range into dense ids and its paths into a double
array: from node ``s`` the turn with dense id ``c`` leads to slot ``BASE[s] + c``
if ``CHECK`` of that slot is ``s``.  It walks its paths through the arrays and
adds up what its nodes have.

Nodes on the first and the last path of a range may have more paths elsewhere.
They are all that ranges share, and come out as partial rows.  A last pass reads
them in order, with a stack of open nodes, and merges what they have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelmill.operators.scale import cut_lineage

#: Turns of distinct paths that one double array holds, about 200 bytes each while it is built.
RANGE_TURNS = 200_000
#: Bytes of a turn in a path: two hashes and a size.
KEY = 20
#: Bytes of it that say which turn it is.
NAME = 16

_ENDS = "path_key binary, ends_sha256 string"
_NODES = (
    "shard int, side int, depth int, conv_id long, parent long, parent_side int, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, name binary, bytes long"
)
_MERGED = "node long, parent_node long, depth int, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, shard int, side int"
_TAKEN = 8
EMPTY = hashlib.sha256().hexdigest()


def _keyed(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, key``: the turns of every conversation in order, without their texts.

    By turn, nulls first; turns of one number by a hash of role and text.  Null
    roles and texts are empty.  Rows without ``conv_id`` belong to no
    conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    one, two = F.xxhash64(role, text), F.xxhash64(F.lit(1), role, text)
    hexed = F.concat(F.lpad(F.hex(one), 16, "0"), F.lpad(F.hex(two), 16, "0"), F.lpad(F.hex(F.octet_length(text)), 8, "0"))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), hexed.alias("key"))
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    return rows.withColumn("pos", F.row_number().over(in_order)).drop("turn")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, path``: a path for every conversation ``c``.

    The first ``h`` turns of conversation ``c - c % 5``, then its own after its
    first ``h``; ``h`` is the CRC-32 of ``c`` in decimal, modulo 9.  At most
    eight turns of a conversation go to others, so nothing multiplies.  A path
    is gathered as 40 characters a turn.
    """
    keyed = cut_lineage(_keyed(turns))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (_TAKEN + 1)).cast("int")
    convs = keyed.filter("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), taken.alias("h"))
    own = keyed.withColumn("h", taken).select("conv_id", F.when(F.col("pos") > F.col("h"), F.struct(F.lit(1).alias("part"), "pos", "key")).alias("turn"))
    first = keyed.filter((F.col("pos") <= _TAKEN) & (F.col("conv_id") % 5 == 0)).select(F.col("conv_id").alias("base"), "pos", "key")
    others = convs.join(first, "base").filter("pos <= h").select("conv_id", F.struct(F.lit(0).alias("part"), "pos", "key").alias("turn"))
    # Turns of its own that a conversation does not keep are null, and lists leave nulls out.
    listed = own.unionByName(others).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return listed.select("conv_id", F.unhex(F.array_join(F.col("turns.key"), "")).alias("path"))


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest = None, None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        keys, ends = zip(*rows) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends, pa.string())], names=["path_key", "ends_sha256"])

    for batch in batches:
        done = []
        for key, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
            if key != now:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(str(conv_id).encode())
            else:
                digest.update(f",{conv_id}".encode())
        yield batch_of(done)
    if now is not None:
        yield batch_of([(now, digest.hexdigest())])


def paths(convs: DataFrame) -> DataFrame:
    """``path, n, least, ends_sha256`` of every distinct path of :func:`rebuilt`.

    Equal paths are added up before they are shuffled.  The digest of their ids
    is one chain, so the ids of a path stream through a task, eight bytes each.
    """
    key = F.unhex(F.md5("path"))
    ends = convs.select(key.alias("path_key"), "conv_id").repartition("path_key").sortWithinPartitions("path_key", "conv_id").mapInArrow(_ended, _ENDS)
    distinct = convs.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    return distinct.withColumn("path_key", key).join(ends, "path_key").select("path", "n", "least", "ends_sha256")


class DoubleArray:
    """The nodes of sorted paths, in arrays ``base`` and ``check``; node 0 is the root.

    ``order`` has the slots level by level, ``level`` where each level starts.
    """

    def __init__(self, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        names = np.ascontiguousarray(keys[:, :NAME]).view(f"V{NAME}").ravel() if len(keys) else np.empty(0, f"V{NAME}")
        _, first, turn = np.unique(names, return_index=True, return_inverse=True)
        # Ids by first use: siblings that are met nowhere else have neighbouring ids and fill neighbouring slots.
        depth = np.arange(len(keys)) - np.repeat(starts, lengths)
        use = np.lexsort((first, depth[first])) if len(first) else first
        dense = np.empty(len(first), np.int64)
        dense[use] = np.arange(len(first))
        self.turn = dense[turn]
        self.starts, self.lengths = starts, lengths
        self.base, self.check = np.zeros(16, np.int64), np.full(16, -1, np.int64)
        self.check[0] = 0
        self.free_from, self.end = 1, 1
        self.order, self.level = [np.zeros(1, np.int64)], [0, 1]
        self._build()

    def _reserve(self, size: int) -> None:
        if size > len(self.base):
            more = max(size, 2 * len(self.base)) - len(self.base)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _place(self, ids: np.ndarray) -> int:
        """A base at which all the slots of sorted ``ids`` are free: the first of a few holes that fits, else the end."""
        at = self.free_from
        for _ in range(16):
            while at < self.end and self.check[at] >= 0:
                at += 1
            if at >= self.end:
                break
            slots = ids + (at - ids[0])
            inside = slots[slots < self.end]
            if (self.check[inside] < 0).all():
                return at - int(ids[0])
            at += 1
        return self.end - int(ids[0])

    def _build(self) -> None:
        open_paths = np.flatnonzero(self.lengths > 0)
        now = np.zeros(len(open_paths), np.int64)
        d = 0
        while len(open_paths):
            ids = self.turn[self.starts[open_paths] + d]
            by = np.lexsort((ids, now))
            s, c = now[by], ids[by]
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])])
            parents, children = s[new], c[new]
            cuts = np.concatenate([[0], np.flatnonzero(parents[1:] != parents[:-1]) + 1, [len(parents)]])
            slots = np.empty(len(parents), np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                base = self._place(children[a:b])
                slots[a:b] = children[a:b] + base
                last = int(slots[b - 1]) + 1
                self._reserve(last)
                self.base[parents[a]] = base
                self.check[slots[a:b]] = parents[a]
                self.end = max(self.end, last)
                while self.free_from < self.end and self.check[self.free_from] >= 0:
                    self.free_from += 1
            self.order.append(slots)
            self.level.append(self.level[-1] + len(slots))
            now_by = slots[np.cumsum(new) - 1]
            now = np.empty_like(now_by)
            now[by] = now_by
            d += 1
            more = self.lengths[open_paths] > d
            open_paths, now = open_paths[more], now[more]

    def walk(self, first: int, depth: int) -> np.ndarray:
        """The slots of the path whose turns start at ``first``, down to ``depth``, by the arrays alone."""
        out = np.zeros(depth + 1, np.int64)
        for d in range(depth):
            slot = self.base[out[d]] + self.turn[first + d]
            if not (0 <= slot < self.end and self.check[slot] == out[d]):
                raise LookupError("this path is not in the trie")
            out[d + 1] = slot
        return out


def _shard_rows(shard: int, rows: list[tuple[bytes, int, int, str]]) -> dict[str, list]:
    """The nodes of one range of sorted distinct paths; those on its first and last path are partial (``side`` 0 and 1, else -1)."""
    lengths = np.array([len(r[0]) // KEY for r in rows], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    keys = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(-1, KEY)
    sizes = keys[:, NAME:].astype(np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1], np.int64)
    trie = DoubleArray(keys, starts, lengths)
    n_slots = trie.end
    n, least = np.zeros(n_slots, np.int64), np.full(n_slots, 2**63 - 1, np.int64)
    own, leaves, saved = (np.zeros(n_slots, np.int64) for _ in range(3))
    depth, where = np.zeros(n_slots, np.int64), np.zeros(n_slots, np.int64)
    side, ends = np.full(n_slots, -1, np.int64), {}
    count, low = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
    # All paths at once, a turn deeper each time.
    now, alive = np.zeros(len(rows), np.int64), np.arange(len(rows))
    d = 0
    while True:
        np.add.at(n, now, count[alive])
        np.minimum.at(least, now, low[alive])
        depth[now] = d
        for k in np.flatnonzero(lengths[alive] == d).tolist():
            ends[int(now[k])] = rows[alive[k]][3]
        more = lengths[alive] > d
        alive, now = alive[more], now[more]
        if not len(alive):
            break
        turns = starts[alive] + d
        slots = trie.base[now] + trie.turn[turns]
        if not (trie.check[slots] == now).all():
            raise LookupError("a path is not in its trie")
        where[slots] = turns
        now, d = slots, d + 1
    for k, mark in ((len(rows) - 1, 1), (0, 0)):
        side[trie.walk(int(starts[k]), int(lengths[k]))] = mark
    order = np.concatenate(trie.order)
    below = order[1:]
    parent = trie.check
    whole = side[below] < 0
    children = np.bincount(parent[below[whole]], minlength=n_slots)
    size = np.zeros(n_slots, np.int64)
    size[below] = sizes[where[below]]
    own[below[whole]] = (n[below[whole]] - 1) * size[below[whole]]
    saved += own
    childless = below[whole & (np.bincount(parent[below], minlength=n_slots)[below] == 0)]
    leaves[childless] = 1
    for a, b in zip(trie.level[-2:0:-1], trie.level[:1:-1]):
        level = order[a:b]
        # A partial node gives nothing to a partial parent here: the pass over all ranges adds that.
        up = level[side[level] < 0]
        np.add.at(leaves, parent[up], leaves[up])
        np.add.at(saved, parent[up], saved[up])
    out = order.tolist()
    up_side = side[parent[order]]
    return {
        "shard": [shard] * len(out), "side": side[order].tolist(), "depth": depth[order].tolist(), "conv_id": least[order].tolist(),
        "parent": [None if d == 0 else p for d, p in zip(depth[order].tolist(), least[parent[order]].tolist())],
        "parent_side": up_side.tolist(), "n_convs": n[order].tolist(), "n_children": children[order].tolist(), "n_leaves": leaves[order].tolist(),
        "saved_tokens": saved[order].tolist(), "ends_sha256": [ends.get(s, EMPTY) for s in out],
        "name": [keys[w, :NAME].tobytes() if s and e >= 0 else None for s, w, e in zip(out, where[order].tolist(), side[order].tolist())],
        "bytes": size[order].tolist(),
    }


def _arrow(columns: dict[str, list], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c.split()[0]], kinds[c.split()[1]]) for c in schema.split(", ")], names=[c.split()[0] for c in schema.split(", ")])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
    if rows:
        yield _arrow(_shard_rows(TaskContext.get().partitionId(), rows), _NODES)


class _Open:
    """A node of the merging pass whose paths may go on."""

    def __init__(self, node: int, parent: int | None, depth: int, name: bytes | None):
        self.node, self.parent, self.depth, self.name = node, parent, depth, name
        self.conv_id, self.n, self.children, self.leaves, self.saved, self.bytes, self.ends = 2**63 - 1, 0, 0, 0, 0, 0, EMPTY

    def add(self, row: dict) -> None:
        self.conv_id = min(self.conv_id, row["conv_id"])
        self.n += row["n_convs"]
        self.children += row["n_children"]
        self.leaves += row["n_leaves"]
        self.saved += row["saved_tokens"]
        self.bytes = row["bytes"]
        if row["ends_sha256"] != EMPTY:
            self.ends = row["ends_sha256"]


def merge(partial: Iterator[dict]) -> Iterator[dict]:
    """Nodes that ranges share, from their partial rows by (shard, side, depth).

    Gives a row per node once its last range has passed, and before that a row
    for each partial one, which tells the node it belongs to.  Only the nodes of
    one path are open at a time.
    """
    stack: list[_Open] = []
    made = 0

    def close() -> dict:
        x = stack.pop()
        x.saved += (x.n - 1) * x.bytes if x.depth else 0
        x.leaves += not x.children
        if stack:
            stack[-1].leaves += x.leaves
            stack[-1].saved += x.saved
        return {"node": x.node, "parent_node": x.parent, "depth": x.depth, "conv_id": x.conv_id, "n_convs": x.n, "n_children": x.children, "n_leaves": x.leaves,
                "saved_tokens": x.saved, "ends_sha256": x.ends, "shard": None, "side": None}

    for row in partial:
        d = row["depth"]
        if d >= len(stack) or d and stack[d].name != row["name"]:
            while len(stack) > d:
                yield close()
            if stack:
                stack[-1].children += 1
            stack.append(_Open(made, stack[-1].node if stack else None, d, row["name"]))
            made += 1
        stack[d].add(row)
        yield {"node": stack[d].node, "parent_node": None, "depth": d, "conv_id": None, "n_convs": None, "n_children": None, "n_leaves": None,
               "saved_tokens": None, "ends_sha256": None, "shard": row["shard"], "side": row["side"]}
    while stack:
        yield close()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _MERGED.split(", ")]

    def rows() -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    out: list[dict] = []
    for row in merge(rows()):
        out.append(row)
        if len(out) == 10_000:
            yield _arrow({n: [r[n] for r in out] for n in names}, _MERGED)
            out = []
    if out:
        yield _arrow({n: [r[n] for r in out] for n in names}, _MERGED)


def nodes(distinct: DataFrame, range_turns: int = RANGE_TURNS) -> DataFrame:
    """The nodes of the trie of distinct paths (:func:`paths`), a row each.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.  Ranges hold about ``range_turns`` turns, and
    their number follows from the paths, not from a setting.
    """
    frozen = cut_lineage(distinct)
    turns = frozen.agg(F.sum(F.octet_length("path") / KEY)).first()[0] or 0
    ranges = max(1, -(-int(turns) // range_turns))
    packed = cut_lineage(frozen.repartitionByRange(ranges, "path").sortWithinPartitions("path").mapInArrow(_packed, _NODES))
    # Two paths of each range: their rows pass one task, in the order of the ranges.
    partial = packed.filter("side >= 0").repartition(1).sortWithinPartitions("shard", "side", "depth")
    found = cut_lineage(partial.mapInArrow(_merged, _MERGED))
    shared = found.filter("shard is null").drop("shard", "side")
    parents = shared.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    upper = shared.join(parents, "parent_node", "left").select(*columns)
    # A node of one range below a shared one takes the conversation of the merged parent.
    known = found.filter("shard is not null").select("node", "shard", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"))
    of = known.join(shared.select("node", F.col("conv_id").alias("merged")), "node").drop("node")
    lower = packed.filter("side < 0").join(of, ["shard", "parent_side", "depth"], "left")
    return lower.withColumn("parent_conv_id", F.coalesce("merged", "parent")).select(*columns).unionByName(upper)


def prefix_trie(turns: DataFrame, range_turns: int = RANGE_TURNS) -> DataFrame:
    """The nodes of all rebuilt conversations of ``turns`` (``conv_id, turn, role, text``); other columns do not matter.

    Repeated rows are turns of their own.  An empty table gives no nodes.
    """
    return nodes(paths(cut_lineage(rebuilt(turns))), range_turns)
