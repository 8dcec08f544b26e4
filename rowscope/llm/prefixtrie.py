"""Prefix trie of conversations: balanced parentheses per shard, shared spines merged.

A conversation is a path of turns; a turn is the 128-bit digest of its role and text.
The paths are range-partitioned in lexicographic order (copies of one path are split by
conversation), and every partition is cut into shards of at most ``SHARD_TURNS`` turns
(one longer path is a shard alone). In sorted order the trie of a shard is written as
balanced parentheses in one pass over the common prefix lengths. Over their running
excess lie blocks of ``BLOCK`` places and a tree of block minima (range min-max):
*findclose* goes out of the block, up and down that tree and into the block it names,
and delimits each node's subtree. Rank over the pairs "()" counts the leaves in it, and
cumulative sums in preorder give its savings.

Only the nodes on the first and the last path of a shard can occur in other shards.
These two spines leave the shard as paths with their own sums; the spines of all
shards are paths of a smaller trie, built by the same operator, level by level, until
one shard is left (two paths of each shard enter the next level, ``FAN`` paths a task).

Defined results: null role or text is the empty text; turns are ordered by number, null
first, equal numbers by digest; rows without conv_id belong to no conversation and are
left out; an empty table has no node, not even a root; repeated rows are turns of their
own. A conversation is one row of 40 bytes a turn, without its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscope.llm._text import bounded_batches
from rowscope.session import reliable_checkpoint, shuffle_partitions

SHARD_TURNS = 1 << 18
FAN = 4096
BLOCK = 64
_WIDTH = 16  # bytes of a turn's digest
_SUMS = ("n", "kids", "leaves", "saved")


def find_close(bits: np.ndarray, opens: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Place of the parenthesis that closes each of ``opens`` (bits: 1 opens, 0 closes)."""
    n = len(bits)
    excess = np.cumsum(np.where(bits == 1, 1, -1))
    blocks = -(-n // block)
    width = 1 << max(0, (blocks - 1).bit_length())
    low = np.full(2 * width, np.iinfo(np.int64).max)
    padded = np.full(blocks * block, np.iinfo(np.int64).max)
    padded[:n] = excess
    low[width: width + blocks] = padded.reshape(blocks, block).min(axis=1)
    at = width
    while at > 1:
        low[at // 2: at] = np.minimum(low[at: 2 * at: 2], low[at + 1: 2 * at: 2])
        at //= 2
    goal = excess[opens] - 1
    out = np.full(len(opens), -1, np.int64)

    def scan(who: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Look for the goal from ``start`` to the end of its block; who found none is returned."""
        pos = start.copy()
        while len(who):
            inside = (pos < n) & ((pos % block != 0) | (pos == start))
            who_in, p = who[inside], pos[inside]
            hit = excess[p] == goal[who_in]
            out[who_in[hit]] = p[hit]
            missed.append(who[~inside])
            who, pos, start = who_in[~hit], p[~hit] + 1, start[inside][~hit]
        return np.concatenate(missed)

    missed: list[np.ndarray] = []
    who = np.arange(len(opens))
    start = opens + 1
    fresh = start % block == 0  # the search begins with the next block
    rest = np.concatenate([scan(who[~fresh], start[~fresh]), who[fresh]]) if (~fresh).any() else who
    if not len(rest):
        return out
    node = width + (start[rest] - 1) // block  # the block left behind
    going = np.ones(len(rest), bool)
    found = np.zeros(len(rest), np.int64)
    while going.any():  # up, until a right neighbour reaches down to the goal
        g = np.flatnonzero(going)
        is_left = node[g] % 2 == 0
        ok = np.zeros(len(g), bool)
        ok[is_left] = low[node[g][is_left] + 1] <= goal[rest[g[is_left]]]
        found[g[ok]] = node[g[ok]] + 1
        node[g] //= 2
        going[g[ok]] = False
    while (down := found < width).any():  # down, to the first block that reaches it
        d = np.flatnonzero(down)
        first = 2 * found[d]
        found[d] = np.where(low[first] <= goal[rest[d]], first, first + 1)
    missed = []
    scan(rest, (found - width) * block)
    return out


class _Paths:
    """Sorted paths of a shard as flat arrays; ``off`` bounds each path's turns, and every path has an entry for the root."""

    def __init__(self, batch: pa.Table):
        batch = batch.combine_chunks()
        self.rows = batch.num_rows
        seq = batch.column("seq").combine_chunks()
        ends = np.frombuffer(seq.buffers()[1], np.int32)[seq.offset: seq.offset + self.rows + 1].astype(np.int64)
        raw = seq.buffers()[2]
        self.raw = bytes(raw[ends[0]: ends[-1]]) if raw is not None else b""
        self.size = np.diff(ends) // _WIDTH
        self.off = np.concatenate([[0], np.cumsum(self.size)])
        self.turn = np.frombuffer(self.raw, np.uint64).reshape(-1, 2)
        self.conv = batch.column("conv_id").to_numpy()
        self.chars = _flat(batch, "chars")
        self.sums = {k: _flat(batch, k) for k in _SUMS} | {"low": _flat(batch, "low")}

    def shared(self) -> np.ndarray:
        """Turns that each path has in common with the one before it (0 for the first)."""
        out = np.zeros(self.rows, np.int64)
        if self.rows < 2 or not len(self.turn):
            return out
        row = np.repeat(np.arange(self.rows), self.size)
        depth = np.arange(len(row)) - self.off[row]
        before = np.maximum(row - 1, 0)
        can = (row > 0) & (depth < self.size[before])
        other = np.where(can, self.off[before] + depth, 0)
        same = can & (self.turn == self.turn[other]).all(axis=1)
        some = np.flatnonzero(self.size)
        out[some] = np.minimum.reduceat(np.where(same, self.size[row], depth), self.off[:-1][some])
        out[0] = 0
        return out


def _flat(table: pa.Table, name: str) -> np.ndarray | None:
    """The values of a list column, or None where the level has none."""
    col = table.column(name).combine_chunks()
    if col.null_count == len(col):
        return None
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def build(paths: _Paths) -> dict:
    """The trie of sorted paths: preorder arrays of its nodes, the root first."""
    shared, size, rows = paths.shared(), paths.size, paths.rows
    fresh = size - shared  # nodes that a path adds
    total = int(fresh.sum()) + 1
    first = 1 + np.concatenate([[0], np.cumsum(fresh)[:-1]])
    # the node of every (path, depth), depth 0 the root
    node_of = np.zeros(int(size.sum()) + rows, np.int64)
    start = paths.off[:-1] + np.arange(rows)
    parent = np.full(total, -1, np.int64)
    stack = np.zeros(int(size.max(initial=0)) + 1, np.int64)
    for i, (a, s, k, f) in enumerate(zip(start.tolist(), shared.tolist(), size.tolist(), first.tolist(), strict=True)):
        if k > s:
            stack[s + 1: k + 1] = range(f, f + k - s)
            parent[f] = stack[s]
            parent[f + 1: f + k - s] = np.arange(f, f + k - s - 1)
        node_of[a: a + k + 1] = stack[: k + 1]
    depth = np.zeros(total, np.int64)
    lead = np.repeat(np.arange(rows), fresh)  # the path that made each node but the root
    depth[1:] = np.arange(total - 1) + 1 - first[lead] + shared[lead] + 1
    # parentheses: close what the next path does not share, open what it adds
    closes = np.append(size[:-1] - shared[1:], size[-1] + 1)
    bits = np.ones(2 * total, np.uint8)
    ends = 1 + np.cumsum(fresh) + np.cumsum(closes) - closes
    span = np.repeat(ends - (np.cumsum(closes) - closes), closes) + np.arange(int(closes.sum()))
    bits[span] = 0
    opens = np.flatnonzero(bits)
    close = find_close(bits, opens)
    after = np.arange(total) + (close - opens + 1) // 2  # end of the subtree in preorder
    chars = np.zeros(total, np.int64)
    chars[1:] = paths.chars[paths.off[lead] + depth[1:] - 1] if total > 1 else 0
    given = paths.sums["n"] is not None
    low = np.full(total, np.iinfo(np.int64).max)
    own = {k: np.zeros(total, np.int64) for k in _SUMS}
    if given:
        for k in _SUMS:
            np.add.at(own[k], node_of, paths.sums[k])
        np.minimum.at(low, node_of, paths.sums["low"])
    else:
        own["n"] = np.bincount(node_of, minlength=total)
        np.minimum.at(low, node_of, np.repeat(paths.conv, size + 1))
    pairs = np.concatenate([[0], np.cumsum((bits[:-1] == 1) & (bits[1:] == 0))])
    bare = pairs[close] - pairs[opens]  # leaves of this trie in the subtree
    kids = own["kids"] + np.bincount(parent[1:], minlength=total)
    return {"total": total, "node_of": node_of, "start": start, "size": size, "parent": parent, "depth": depth, "opens": opens,
            "close": close, "after": after, "chars": chars, "n": own["n"], "low": low, "kids": kids, "own": own, "bare": bare,
            "last": node_of[start + size]}


def _cumulative(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def _ids_hash(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


_NODES = ("kind int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
          "saved_tokens bigint, ends_sha256 string, key binary, parent_key binary, seq binary, chars array<bigint>, "
          "low array<bigint>, n array<bigint>, kids array<bigint>, leaves array<bigint>, saved array<bigint>")
#: Kinds of rows that a shard gives: its finished nodes, its two spines, and the conversations that end on a spine.
NODE, SPINE, END = 0, 1, 2
_LISTS = ("chars", "low", *_SUMS)


def _schema() -> pa.Schema:
    whole, lists = pa.int64(), pa.list_(pa.int64())
    return pa.schema([("kind", pa.int32())] + [(c, whole) for c in (
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
        + [("ends_sha256", pa.string())] + [(c, pa.binary()) for c in ("key", "parent_key", "seq")] + [(c, lists) for c in _LISTS])


def _rows(kind: int, count: int, /, **cols) -> pa.RecordBatch:
    schema = _schema()
    arrays = []
    for f in schema:
        if f.name == "kind":
            arrays.append(pa.array(np.full(count, kind, np.int32)))
        elif f.name in cols:
            arrays.append(pa.array(cols[f.name], f.type))
        else:
            arrays.append(pa.nulls(count, f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _prefix_keys(raw: bytes, turns: int) -> list[bytes]:
    """Digest of every prefix of a path, the empty one first."""
    h = hashlib.md5()
    out = [h.digest()]
    for d in range(turns):
        h.update(raw[_WIDTH * d: _WIDTH * (d + 1)])
        out.append(h.copy().digest())
    return out


def _shard(paths: _Paths, level: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Finished nodes, spines and ends of one shard; the only shard of the last level has no spine."""
    t = build(paths)
    total, parent = t["total"], t["parent"]
    spine = np.zeros(total, bool)
    first_path = t["node_of"][t["start"][0]: t["start"][0] + t["size"][0] + 1]
    last_path = t["node_of"][t["start"][-1]: t["start"][-1] + t["size"][-1] + 1]
    if not last:
        spine[first_path] = True
        spine[last_path] = True
    done = ~spine
    saving = np.where(done, np.maximum(t["n"] - 1, 0) * t["chars"], 0) + t["own"]["saved"]
    cs = _cumulative(saving)
    at = np.arange(total)
    saved = cs[t["after"]] - cs[at]
    # leaves: "()" of this trie less those open to growth (on a spine or with finished children elsewhere), plus the sums brought along
    closed = t["close"] == t["opens"] + 1
    brought = _cumulative(t["own"]["leaves"] - (closed & (spine | (t["own"]["kids"] > 0))))
    leaves = t["bare"] + brought[t["after"]] - brought[at]
    keys: dict[int, bytes] = {}
    size, off = paths.size, paths.off
    if level:  # every node here lies on spines of shards: it is known by its key
        for i in range(paths.rows):
            lo = _WIDTH * int(off[i])
            made = _prefix_keys(paths.raw[lo: lo + _WIDTH * int(size[i])], int(size[i]))
            keys.update(zip(t["node_of"][t["start"][i]: t["start"][i] + size[i] + 1].tolist(), made, strict=True))
    elif not last:
        for i, nodes in ((0, first_path), (paths.rows - 1, last_path)):
            lo = _WIDTH * int(off[i])
            made = _prefix_keys(paths.raw[lo: lo + _WIDTH * int(size[i])], int(size[i]))
            keys.update(zip(nodes.tolist(), made, strict=True))
    ids = np.flatnonzero(done)
    if len(ids):
        up = parent[ids]
        away = (up >= 0) & spine[np.maximum(up, 0)]
        up_low = np.where((up >= 0) & ~away, t["low"][np.maximum(up, 0)], 0)
        ends: list = [None] * len(ids)
        if not level:
            empty = hashlib.sha256(b"").hexdigest()
            ends = [empty] * len(ids)
            place = np.cumsum(done) - 1
            cut = np.flatnonzero(np.append(True, t["last"][1:] != t["last"][:-1]))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), paths.rows], strict=True):
                node = t["last"][a]
                if done[node]:
                    ends[place[node]] = _ids_hash(np.sort(paths.conv[a:b]))
        for a in range(0, len(ids), 8192):
            part = ids[a: a + 8192]
            sl = slice(a, a + 8192)
            yield _rows(NODE, len(part), conv_id=t["low"][part], depth=t["depth"][part],
                        parent_conv_id=pa.array(up_low[sl], mask=(up[sl] < 0) | away[sl]), n_convs=t["n"][part],
                        n_children=t["kids"][part], n_leaves=leaves[part], saved_tokens=saved[part], ends_sha256=ends[sl],
                        key=[keys[i] if level or last and i in keys else None for i in part.tolist()],
                        parent_key=[keys[u] if g else None for u, g in zip(up[sl].tolist(), away[sl].tolist(), strict=True)])
    if last:
        return
    if not level:  # conversations that end on a spine, hashed once all shards' are together
        open_end = np.flatnonzero(spine[t["last"]])
        for a in range(0, len(open_end), 8192):
            part = open_end[a: a + 8192]
            yield _rows(END, len(part), conv_id=paths.conv[part], key=[keys[i] for i in t["last"][part].tolist()])
    # what a spine node brings to the next level: its members here, and the sums of the finished subtrees that hang on it
    hung = done & (parent >= 0) & spine[np.maximum(parent, 0)]
    bring = {"n": t["n"], "low": t["low"]}
    for k, own, whole in (("kids", t["own"]["kids"], np.ones(total, np.int64)), ("leaves", t["own"]["leaves"], leaves),
                          ("saved", t["own"]["saved"], saved)):
        bring[k] = own.copy()
        np.add.at(bring[k], parent[hung], whole[hung])
    twice = int((first_path[: len(last_path)] == last_path[: len(first_path)]).sum())
    for i, nodes, from_ in ((0, first_path, 0), (paths.rows - 1, last_path, twice)):
        if i == 0 and from_ or from_ == len(nodes):
            continue
        lo = _WIDTH * int(off[i])
        cols = {k: bring[k][nodes].copy() for k in (*_SUMS, "low")}
        for k in _SUMS:
            cols[k][:from_] = 0
        yield _rows(SPINE, 1, conv_id=[int(paths.conv[i])], seq=[paths.raw[lo: lo + _WIDTH * int(size[i])]],
                    chars=[t["chars"][nodes[1:]]], **{k: [v] for k, v in cols.items()})


def _level(paths: DataFrame, parts: int, level: int, shard_turns: int) -> DataFrame:
    """Shards of the sorted paths; a level in one partition is a single shard and the last."""
    last = parts == 1 and level > 0

    def run(batches):
        held, turns = [], 0
        for batch in batches:
            sizes = (pa.compute.binary_length(batch.column("seq")).to_numpy() // _WIDTH + 1).tolist()
            a = 0
            for i, s in enumerate(sizes):
                if turns and turns + s > shard_turns and not last:
                    if i > a:
                        held.append(batch.slice(a, i - a))
                    yield from _shard(_Paths(pa.Table.from_batches(held)), level, last)
                    held, turns, a = [], 0, i
                turns += s
            if a < len(sizes):
                held.append(batch.slice(a))
        if held:
            yield from _shard(_Paths(pa.Table.from_batches(held)), level, last)

    dealt = paths.repartitionByRange(parts, "seq", "conv_id") if parts > 1 else paths.coalesce(1)
    return dealt.sortWithinPartitions("seq", "conv_id").mapInArrow(run, _NODES)


def _end_hashes(rows: DataFrame) -> DataFrame:
    """key, ends_sha256: the ids of each key in order, streamed through the hash."""

    def run(batches):
        now, h = None, None
        out: list[tuple[bytes, str]] = []
        for batch in batches:
            for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        out.append((now, h.hexdigest()))
                    now, h = key, hashlib.sha256(str(conv).encode())
                else:
                    h.update(b",%d" % conv)
            if len(out) > 4096:
                yield _pairs(out)
                out = []
        if now is not None:
            out.append((now, h.hexdigest()))
        if out:
            yield _pairs(out)

    def _pairs(out):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([v for _, v in out])],
                                          names=["key", "ends_sha256"])

    return rows.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key binary, ends_sha256 string")


def rebuilt_paths(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text", every: int = 100, most: int = 6) -> DataFrame:
    """conv_id, seq (digests of the turns, joined), chars: every conversation with the first
    h = crc32(conv_id) % most turns replaced by those of conversation conv_id - conv_id % every."""
    col = lambda c: F.col(f"`{c}`")
    role, text = (F.coalesce(col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.where(col(conv_col).isNotNull()).select(
        col(conv_col).cast("bigint").alias("conv_id"), col(turn_col).alias("turn"),
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("d"),
        F.char_length(text).cast("bigint").alias("n"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "d", "n"))).alias("turns"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % F.lit(most)).cast("int")
    bases = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"),
                                                              F.slice("turns", 1, most - 1).alias("lead"))
    both = convs.withColumn("base", F.expr(f"conv_id - conv_id % {every}")).join(bases, "base", "left").withColumn("h", h)
    none = F.array().cast("array<struct<turn:bigint,d:string,n:bigint>>")
    cast = "array<struct<turn:bigint,d:string,n:bigint>>"
    lead = F.coalesce(F.slice(F.col("lead").cast(cast), F.lit(1), F.col("h")), none)
    own = F.slice(F.col("turns").cast(cast), F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    path = both.select("conv_id", F.concat(lead, own).alias("p"))
    return path.select("conv_id", F.unhex(F.array_join("p.d", "")).alias("seq"), F.col("p.n").alias("chars"))


def trie(paths: DataFrame, parts: int | None = None, shard_turns: int = SHARD_TURNS, fan: int = FAN) -> DataFrame:
    """Nodes of the trie of ``paths`` (conv_id, seq, chars): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    bounded_batches(paths)
    parts = parts or shuffle_partitions(paths.sparkSession)
    none = F.lit(None).cast("array<bigint>")
    names = ["conv_id", "seq", "chars", "low", *_SUMS]
    now = reliable_checkpoint(paths.select("conv_id", "seq", "chars", none.alias("low"), *[none.alias(k) for k in _SUMS]))
    levels, level = [], 0
    while True:
        made = reliable_checkpoint(_level(now, parts, level, shard_turns))
        levels.append(made)
        if level and parts == 1:
            break
        now = made.where(F.col("kind") == SPINE).select(*names)
        parts = 1 if (n := now.count()) <= fan else min(-(-n // fan), max(1, parts // 2))
        level += 1
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = levels[0].where(F.col("kind") == NODE)
    upper = levels[1].where(F.col("kind") == NODE)
    for made in levels[2:]:
        upper = upper.unionByName(made.where(F.col("kind") == NODE))
    ends = _end_hashes(levels[0].where(F.col("kind") == END).select("key", "conv_id"))
    upper = upper.drop("ends_sha256").join(ends, "key", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    heads = upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("head"))
    nodes = inner.select(*cols, "parent_key").unionByName(upper.select(*cols, "parent_key"))
    settled = nodes.where(F.col("parent_key").isNull()).select(*cols)
    hanging = nodes.where(F.col("parent_key").isNotNull()).join(heads, "parent_key").withColumn("parent_conv_id", F.col("head"))
    return settled.unionByName(hanging.select(*cols))


def prefix_trie(conversations: DataFrame, **options) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return trie(rebuilt_paths(conversations), **options)
