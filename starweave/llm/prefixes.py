"""Trie of conversation prefixes, built as adaptive radix trees.

A turn is an id of ``WIDTH`` bytes: 16 of the SHA-256 of role and text, and
the length of the text, both big-endian.  A conversation is its turns' ids
end to end, so the order of keys is the order of a walk through the trie.

Keys are sorted into ranges.  A task cuts its range into blocks and builds an
adaptive radix tree of each: nodes of 4, 16, 48 or 256 children that grow as
they fill, and compressed paths.  Only bytes at which a turn ends are nodes
of the trie.  A node that is no prefix of a block's first or last key has all
its members there and is done; the others, one path on each side, go on as a
record of a few numbers for each depth.  Records of neighbours are merged, 64
at a time, until one is left.  So memory is that of a block and two paths,
and neither a common first turn nor a common conversation is ever in one task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from starweave.llm.common import staged

#: Bytes of a turn's id, and those of them that hold the length of its text.
WIDTH, LENGTH = 20, 4
#: Rows and bytes of keys of which one tree is made; records that are merged at a time.
BLOCK_ROWS, BLOCK_BYTES, FAN_IN = 16_384, 8 << 20, 64
#: The SHA-256 of no ids.
NO_ENDS = hashlib.sha256(b"").hexdigest()

_SCHEMA = (
    "kind string, conv_id long, depth long, parent_conv_id long, parent_ref binary, ref binary, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, ids string, part long, first binary, last binary, "
    "left array<long>, right array<long>"
)


class Radix:
    """A node of an adaptive radix tree."""

    __slots__ = ("path", "layout", "slots", "kids", "value")

    def __init__(self, path: bytes, value=None):
        self.path, self.value = path, value
        self.layout, self.slots, self.kids = 4, bytearray(), []

    def find(self, byte: int) -> Radix | None:
        if self.layout <= 16:
            at = bisect_left(self.slots, byte)
            return self.kids[at] if at < len(self.slots) and self.slots[at] == byte else None
        if self.layout == 48:
            return self.kids[self.slots[byte] - 1] if self.slots[byte] else None
        return self.kids[byte]

    def add(self, byte: int, kid: Radix) -> None:
        if self.layout < 256 and len(self.kids) == self.layout:
            self._grow()
        if self.layout <= 16:
            at = bisect_left(self.slots, byte)
            self.slots.insert(at, byte)
            self.kids.insert(at, kid)
        elif self.layout == 48:
            self.kids.append(kid)
            self.slots[byte] = len(self.kids)
        else:
            self.kids[byte] = kid

    def _grow(self) -> None:
        """4 and 16 hold sorted bytes, 48 the place of each byte's child, 256 a child for each byte."""
        held = list(zip(self.slots, self.kids)) if self.layout <= 16 else [(b, self.kids[s - 1]) for b, s in enumerate(self.slots) if s]
        self.layout = {4: 16, 16: 48, 48: 256}[self.layout]
        if self.layout == 48:
            self.slots = bytearray(256)
            for i, (byte, _) in enumerate(held):
                self.slots[byte] = i + 1
        elif self.layout == 256:
            self.slots, self.kids = bytearray(), [None] * 256
            for byte, kid in held:
                self.kids[byte] = kid

    def children(self) -> list[Radix]:
        """In the order of their bytes."""
        if self.layout <= 16:
            return list(self.kids)
        if self.layout == 48:
            return [self.kids[s - 1] for s in self.slots if s]
        return [k for k in self.kids if k is not None]

    def insert(self, key: bytes, value) -> None:
        node, at = self, 0
        while True:
            path = node.path
            same = len(path)
            if key[at : at + same] != path:
                same = next((i for i, (a, b) in enumerate(zip(path, key[at:])) if a != b), min(same, len(key) - at))
                lower = Radix(path[same + 1 :], node.value)
                lower.layout, lower.slots, lower.kids = node.layout, node.slots, node.kids
                node.path, node.value = path[:same], None
                node.layout, node.slots, node.kids = 4, bytearray(), []
                node.add(path[same], lower)
            at += same
            if at == len(key):
                node.value = value
                return
            kid = node.find(key[at])
            if kid is None:
                node.add(key[at], Radix(key[at + 1 :], value))
                return
            node, at = kid, at + 1


def _refs(key: bytes) -> list[bytes]:
    """A digest of every prefix of whole turns."""
    running, found = hashlib.sha256(), []
    for at in range(0, len(key) + 1, WIDTH):
        found.append(running.digest())
        running.update(key[at : at + WIDTH])
    return found


def _text_bytes(key: bytes, depth: int) -> int:
    return int.from_bytes(key[depth * WIDTH - LENGTH : depth * WIDTH], "big") if depth else 0


def _same_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // WIDTH
    if a[: n * WIDTH] == b[: n * WIDTH]:
        return n
    return next(d for d in range(n) if a[d * WIDTH : (d + 1) * WIDTH] != b[d * WIDTH : (d + 1) * WIDTH])


def _digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


class Path:
    """The open nodes along a first and a last key, as ranges of keys are joined from left to right.

    An open node is ``[members, smallest member, done children, their
    leaves, their saved tokens]``; what is done does not come again.
    """

    def __init__(self):
        self.first = self.last = None
        self.left, self.path, self.done = [], [], []

    def _close(self, depth: int) -> None:
        """Nodes deeper than ``depth`` get no more members, save for those on the first key's path."""
        refs = _refs(self.last) if len(self.path) > depth + 1 else []
        for d in range(len(self.path) - 1, depth, -1):
            node = self.path.pop()
            if d < len(self.left) and self.left[d] is node:
                continue
            self._finish(node, d, self.last, refs, self.path[d - 1] if d else None)

    def _finish(self, node, d, key, refs, parent) -> None:
        n, least, children, leaves, saved = node
        leaves, saved = leaves or 1, saved + (n - 1) * _text_bytes(key, d)
        self.done.append((least, d, None, refs[d - 1] if d else None, refs[d], n, children, leaves, saved, None))
        if parent is not None:
            parent[2] += 1
            parent[3] += leaves
            parent[4] += saved

    def _merge(self, mine, other) -> None:
        mine[0] += other[0]
        mine[1] = min(mine[1], other[1])
        for i in (2, 3, 4):
            mine[i] += other[i]

    def add(self, first: bytes, last: bytes, left: list, right: list) -> None:
        """A range behind all before it: nodes on its first key's path, and further ones on its last key's."""
        if self.first is None:
            self.first, self.left = first, left
            self.path = list(left)
        else:
            same = _same_turns(self.last, first)
            self._close(same)
            for d in range(same + 1):
                self._merge(self.path[d], left[d])
            self.path += left[same + 1 :]
        self.last = first
        self._close(_same_turns(first, last))
        self.path += right
        self.last = last

    def record(self) -> tuple:
        """The same as arguments of :meth:`add`."""
        return self.first, self.last, self.left, self.path[_same_turns(self.first, self.last) + 1 :]

    def finish(self) -> None:
        """Nothing follows: all open nodes are done."""
        self._close(_same_turns(self.first, self.last))
        refs = _refs(self.first)
        for d in range(len(self.left) - 1, -1, -1):
            self._finish(self.left[d], d, self.first, refs, self.left[d - 1] if d else None)

    def take(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


def tree_of(runs: list[tuple[bytes, list[int]]]) -> tuple[list[tuple], list[tuple], tuple]:
    """Nodes that are done, ``(ref, ids)`` of conversations that end at open ones, and the record of the open ones.

    ``runs`` are sorted different keys with the sorted ids of their conversations.
    """
    root = Radix(b"")
    for key, ids in runs:
        root.insert(key, (key, ids))
    first, last = runs[0][0], runs[-1][0]
    refs = _refs(first), _refs(last)
    common = _same_turns(first, last)
    left, right = [None] * (len(first) // WIDTH + 1), [None] * (len(last) // WIDTH + 1)
    done: list[list] = []
    ends: list[tuple] = []
    # (node, bytes above it, may be on a boundary, state of its children)
    stack = [[root, 0, True, None, 0]]
    results: list = []  # summaries of finished nodes, on a stack
    while stack:
        frame = stack[-1]
        node, above, edge, kids, at = frame
        if kids is None:
            kids = frame[3] = node.children()
        if at < len(kids):
            frame[4] += 1
            stack.append([kids[at], above + len(node.path) + 1, edge and at in (0, len(kids) - 1), None, 0])
            continue
        stack.pop()
        n, least, children, leaves, saved, waiting, key = 0, None, 0, 0, 0, [], None
        for _ in kids:
            n_, least_, children_, leaves_, saved_, waiting_, key = results.pop()
            n, children, leaves, saved = n + n_, children + children_, leaves + leaves_, saved + saved_
            least = least_ if least is None else min(least, least_)
            waiting = waiting_ + waiting if len(waiting) < len(waiting_) else waiting + waiting_
        ids = None
        if node.value is not None:
            key, ids = node.value
            n, least = n + len(ids), ids[0] if least is None else min(least, ids[0])
        end = above + len(node.path)
        top = 0 if node is root else (above - 1) // WIDTH + 1  # the least depth that ends in this node's bytes
        for d in range(end // WIDTH, top - 1, -1):
            own = ids if d * WIDTH == end else None
            on = [edge and key.startswith(k[: d * WIDTH]) and len(k) >= d * WIDTH for k in (first, last)]
            if any(on):
                side = 0 if on[0] else 1
                ref = refs[side][d]
                (left, right)[side][d] = [n, least, children, leaves, saved]
                for i in waiting:
                    done[i][3] = ref
                if own is not None:
                    ends.append((ref, own))
                waiting, children, leaves, saved = [], 0, 0, 0
                continue
            leaves, saved = leaves or 1, saved + (n - 1) * _text_bytes(key, d)
            for i in waiting:
                done[i][2] = least
            waiting = [len(done)]
            done.append([least, d, None, None, None, n, children, leaves, saved, NO_ENDS if own is None else _digest(own)])
            children = 1
        results.append((n, least, children, leaves, saved, waiting, key))
    return done, ends, (first, last, left, right[common + 1 :])


def _flat(nodes: list) -> list[int]:
    return [x for node in nodes for x in node]


def _nodes(flat: list[int]) -> list[list[int]]:
    return [list(flat[i : i + 5]) for i in range(0, len(flat), 5)]


_NODE = ("conv_id", "depth", "parent_conv_id", "parent_ref", "ref", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
_ARROW = pa.schema([
    ("kind", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_ref", pa.binary()),
    ("ref", pa.binary()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("ends_sha256", pa.string()), ("ids", pa.string()), ("part", pa.int64()), ("first", pa.binary()), ("last", pa.binary()),
    ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64())),
])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _node_rows(done: list) -> list[dict]:
    return [{"kind": "node", **dict(zip(_NODE, d))} for d in done]


def _record_row(path: Path, part: int) -> dict:
    first, last, left, right = path.record()
    return {"kind": "record", "part": part, "first": first, "last": last, "left": _flat(left), "right": _flat(right)}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, list[int]]]]:
    """Sorted ``key, id`` rows as blocks of runs; a block may cut a run."""
    runs, rows, size = [], 0, 0
    for batch in batches:
        for key, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if runs and runs[-1][0] == key:
                runs[-1][1].append(number)
            else:
                runs.append((key, [number]))
                size += len(key)
            rows += 1
            if rows >= BLOCK_ROWS or size >= BLOCK_BYTES:
                yield runs
                runs, rows, size = [], 0, 0
    if runs:
        yield runs


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    path = Path()
    for runs in _blocks(batches):
        done, ends, record = tree_of(runs)
        path.add(*record)
        rows = _node_rows(done) + _node_rows(path.take())
        rows += [{"kind": "ends", "ref": ref, "conv_id": ids[0], "ids": ",".join(map(str, ids))} for ref, ids in ends]
        yield _batch(rows)
    if path.first is not None:
        yield _batch([_record_row(path, TaskContext.get().partitionId())])


def _joined(final: bool):
    """Join the records of a group, which come one after the other; finish the last group of all."""

    def run(batches):
        path, group = Path(), None
        for batch in batches:
            for r in batch.to_pylist():
                if group is not None and r["group"] != group:
                    yield _batch(_node_rows(path.take()) + [_record_row(path, group)])
                    path = Path()
                group = r["group"]
                path.add(r["first"], r["last"], _nodes(r["left"]), _nodes(r["right"]))
                if len(path.done) > 10_000:
                    yield _batch(_node_rows(path.take()))
        if group is not None:
            if final:
                path.finish()
            yield _batch(_node_rows(path.take()) + ([] if final else [_record_row(path, group)]))

    return run


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each ref from its lists of ids, which come in order; only one list is held."""
    ref = running = None
    for batch in batches:
        refs, found = [], []
        for r, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if r != ref:
                if ref is not None:
                    refs.append(ref)
                    found.append(running.hexdigest())
                ref, running = r, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(refs, pa.binary()), pa.array(found, pa.string())], names=["ref", "hashed"])
    if ref is not None:
        yield pa.RecordBatch.from_arrays([pa.array([ref], pa.binary()), pa.array([running.hexdigest()], pa.string())], names=["ref", "hashed"])


def turn_id(role: Column, text: Column) -> Column:
    """The id of a turn as hexadecimal digits; null counts as empty."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return F.concat(F.substring(digest, 1, 2 * (WIDTH - LENGTH)), F.lpad(F.hex(F.octet_length(text).cast("long")), 2 * LENGTH, "0"))


def turn_sequences(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id, turns``: each conversation's turn ids in order, null first, equal numbers by id.

    Equal rows are turns of their own.  Rows without a conversation's id are
    left out.  Texts do not leave their task; a conversation is one row of
    40 bytes a turn.
    """
    said = F.struct(F.col(turn_col).alias("turn"), turn_id(F.col(role_col), F.col(text_col)).alias("said"))
    ordered = conversations.where(F.col(conv_col).isNotNull()).groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(said)).alias("turns"))
    return ordered.select("conv_id", F.col("turns.said").alias("turns"))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie over ``conv_id, turns``, one row each.

    ``conv_id`` is the smallest member, ``parent_conv_id`` that of the
    parent (the root has none), ``n_convs`` the members, ``n_children`` and
    ``n_leaves`` count children and childless nodes of the subtree,
    ``saved_tokens`` sums members but one times bytes of the last text over
    the subtree, ``ends_sha256`` digests the ids of those that end here.  A
    conversation without turns ends at the root.  Null turns are none; ids
    are different and not null.  Without conversations there is no node.
    """
    keys = sequences.select(F.unhex(F.array_join("turns", "")).alias("key"), "conv_id").select(F.coalesce("key", F.lit(b"")).alias("key"), "conv_id")
    keys = staged(keys, "prefix-keys")
    ranges = keys.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    built = staged(ranges.mapInArrow(_build, _SCHEMA), "prefix-trees")
    done = [built.where("kind = 'node'")]
    records = built.where("kind = 'record'")
    while (most := records.agg(F.max("part")).first()[0]) is not None:
        groups = records.select(F.floor(F.col("part") / FAN_IN).alias("group"), "part", "first", "last", "left", "right")
        groups = groups.repartition("group").sortWithinPartitions("group", "part")
        joined = staged(groups.mapInArrow(_joined(most < FAN_IN), _SCHEMA), "prefix-paths")
        done.append(joined.where("kind = 'node'"))
        records = joined.where("kind = 'record'")
        if most < FAN_IN:
            break
    nodes = done[0]
    for more in done[1:]:
        nodes = nodes.unionByName(more)
    lists = built.where("kind = 'ends'").select("ref", "ids", "conv_id").repartition("ref").sortWithinPartitions("ref", "conv_id")
    ends = lists.select("ref", "ids").mapInArrow(_hash_ends, "ref binary, hashed string")
    # what was open in some block is known by its ref; few nodes are
    opened = nodes.where("ref is not null").select(F.col("ref").alias("parent_ref"), F.col("conv_id").alias("_parent"))
    return (
        nodes.join(opened, "parent_ref", "left").join(ends, "ref", "left")
        .select(
            "conv_id", "depth", F.coalesce("parent_conv_id", "_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
            "saved_tokens", F.coalesce("ends_sha256", "hashed", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
    )
