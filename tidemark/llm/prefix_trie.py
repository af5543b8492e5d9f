"""The prefix trie of conversations, encoded shard by shard as balanced parentheses.

A conversation is a path of turns, each the digest of (role, text). Distinct paths, in
order of their digests, are dealt into ranges, and a range is cut into shards of at most
NODES nodes. A shard writes its trie as balanced parentheses in preorder, with a tree of
least excesses over blocks (range min-max): findclose delimits a node's subtree, the rank
of pairs "()" counts its leaves, and differences of cumulative arrays give its members
and savings. Nodes on the first and last path of a shard, the spines, may lie in other
shards as well; what hangs below each spine node is summed up and handed on, and the
spines, sorted, form a smaller trie that is built in the same way, until one shard holds
all that is left. So every task holds NODES nodes or one path, and no path is long:

Paths are cut into bands of BAND turns. A longer conversation hangs on by the last node
of each band as a tree of its own, told apart by the digest of all its turns before;
bands are built from the deepest up, and the totals of a tree's root are added where it
hangs. Conversations of at most BAND turns need one pass.

Defined results: turns are ordered by (turn with nulls first, role, digest), null role
and text are empty; rows without a conv_id belong to no conversation; equal rows are two
turns; an empty table gives an empty trie; other columns of the input are left out.
Turns and paths are compared by 128 bits of SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, staged

WIDTH = 32  #: characters of a turn's digest
NODES = 200_000  #: nodes of a shard, or one path's
BAND = 1024  #: turns of a path that are built together
BLOCK = 64  #: parentheses of a block
FAR = 2**62


class Parentheses:
    """A forest in preorder as balanced parentheses (1 opens, 0 closes), with least excesses over blocks."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(bits.astype(np.int64) * 2 - 1)
        blocks = max(1, -(-len(bits) // BLOCK))
        leaves = 1 << (blocks - 1).bit_length()
        padded = np.full(leaves * BLOCK, FAR)
        padded[: len(bits)] = self.excess
        self.grid = padded.reshape(leaves, BLOCK)
        least = [self.grid.min(axis=1)]
        while len(least[-1]) > 1:
            least.append(least[-1].reshape(-1, 2).min(axis=1))
        self.least = least  # from blocks up to the root
        self.opens = np.flatnonzero(bits)

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The position of the parenthesis that closes each opening one."""
        goal = self.excess[at] - 1
        out = np.full(len(at), -1)
        block, inside = at // BLOCK, at % BLOCK
        hit = (self.grid[block] <= goal[:, None]) & (np.arange(BLOCK)[None, :] > inside[:, None])
        here = hit.any(axis=1)
        out[here] = block[here] * BLOCK + hit[here].argmax(axis=1)
        left = np.flatnonzero(~here)
        if not len(left):
            return out
        # up, until a block to the right on some level goes as low as the goal
        spot, level, wanted = block[left], np.zeros(len(left), np.int64), goal[left]
        rising = np.ones(len(left), bool)
        for k, least in enumerate(self.least):
            side = np.minimum(spot ^ 1, len(least) - 1)
            good = rising & (spot % 2 == 0) & (side > spot) & (least[side] <= wanted)
            spot[good], level[good] = side[good], k
            rising &= ~good
            spot[rising] //= 2
        # and down to the first such block
        for k in range(len(self.least) - 1, 0, -1):
            down = level == k
            child = spot[down] * 2
            spot[down] = np.where(self.least[k - 1][child] <= wanted[down], child, child + 1)
            level[down] = k - 1
        out[left] = spot * BLOCK + (self.grid[spot] <= wanted[:, None]).argmax(axis=1)
        return out

    def leaf_ranks(self) -> np.ndarray:
        """How many pairs "()" begin before each position."""
        pairs = np.zeros(len(self.bits) + 1, np.int64)
        pairs[1:-1] = np.cumsum((self.bits[:-1] == 1) & (self.bits[1:] == 0))
        pairs[-1:] = pairs[-2:-1]
        return pairs


def _least_between(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The least value of each stretch values[first : first + size], by a table of powers of two."""
    table, step = [values], 1
    while step * 2 <= len(values):
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
        step *= 2
    level = np.frexp(size)[1] - 1
    out = np.empty(len(first), values.dtype)
    for k in np.unique(level):
        of = level == k
        out[of] = np.minimum(table[k][first[of]], table[k][first[of] + size[of] - (1 << k)])
    return out


#: A path and, for each of its nodes, what hangs there beside the path: amounts below it, and the digest of its ends.
_HUNG = ("n", "leaves", "saved", "children", "low")
PATH = "key string, size array<long>, n array<long>, leaves array<long>, saved array<long>, children array<long>, low array<long>, ends array<string>"
NODE = "depth int, conv_id long, parent long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, id string, above string, tree string"


def _ids(key: str) -> list[str]:
    """A digest of each prefix of a path."""
    h, out = hashlib.sha256(), []
    for k in range(0, len(key), WIDTH):
        h.update(key[k : k + WIDTH].encode())
        out.append(h.copy().hexdigest()[:WIDTH])
    return out


def build(paths: list[dict], final: bool, named: bool) -> tuple[list[dict], list[dict]]:
    """Nodes that are complete and, unless `final`, the spines, of a run of sorted paths.

    named: nodes get the ids by which nodes of other shards know them as parents.
    """
    path: list[int] = []
    depth, parent, counts, where = [], [], [0], []
    before = ""
    for p in paths:
        key, same = p["key"], 0
        top = min(len(key), len(before))
        while same < top and key[same : same + WIDTH] == before[same : same + WIDTH]:
            same += WIDTH
        same //= WIDTH
        length, first = len(key) // WIDTH, len(depth)
        counts[-1] = len(path) - same
        del path[same:]
        for d in range(same, length):
            parent.append(path[-1] if path else -1)
            path.append(len(depth))
            depth.append(d + 1)
        counts += [len(depth) - first, 0]
        where.append(np.array(path, np.int64))
        before = key
    counts[-1] = len(path)
    total = len(depth)
    depth, parent, flat = np.array(depth), np.array(parent), np.concatenate(where)
    tree = Parentheses(np.repeat(np.arange(len(counts)) % 2, counts).astype(np.int8))
    size = (tree.findclose(tree.opens) - tree.opens + 1) // 2
    node, hung = np.arange(total), {}
    for c in _HUNG:
        values = np.concatenate([np.asarray(p[c], np.int64) for p in paths])
        hung[c] = np.full(total, FAR) if c == "low" else np.zeros(total, np.int64)
        (np.minimum if c == "low" else np.add).at(hung[c], flat, values)
    tokens = np.zeros(total, np.int64)
    tokens[flat] = np.concatenate([np.asarray(p["size"], np.int64) for p in paths])
    ends = {int(w[k]): e for w, p in zip(where, paths, strict=True) for k, e in enumerate(p["ends"]) if e is not None}

    def below(x: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(x)])
        return c[node + size] - c[node]

    spine = np.zeros(total, bool)
    if not final:
        spine[where[0]] = spine[where[-1]] = True
    own = ~spine
    n, low = below(hung["n"]), _least_between(hung["low"], node, size)
    n_children = hung["children"] + np.bincount(parent[parent >= 0], minlength=total)
    # pairs "()" are leaves unless something else hangs there or they are on a spine
    leaf = (size == 1) & (hung["children"] == 0)
    ranks = tree.leaf_ranks()
    n_leaves = ranks[tree.opens + 2 * size - 1] - ranks[tree.opens] - below((size == 1) & ~(leaf & own)) + below(hung["leaves"])
    saved = below(np.where(own, (n - 1) * tokens, 0) + hung["saved"])

    named_nodes = {}
    if named or not final:
        for w, p in zip(where, paths, strict=True) if named else ((where[0], paths[0]), (where[-1], paths[-1])):
            named_nodes |= dict(zip(w.tolist(), _ids(p["key"]), strict=True))
    roots = {int(w[0]): p["key"][:WIDTH] for w, p in zip(where, paths, strict=True)}
    out = []
    for v in np.flatnonzero(own).tolist():
        up = int(parent[v])
        known = up < 0 or own[up]
        out.append({
            "depth": int(depth[v]), "conv_id": int(low[v]), "parent": None if up < 0 or not known else int(low[up]),
            "n_convs": int(n[v]), "n_children": int(n_children[v]), "n_leaves": int(n_leaves[v]), "saved_tokens": int(saved[v]),
            "ends_sha256": ends.get(v), "id": named_nodes.get(v) if named else None,
            "above": None if known else named_nodes[up], "tree": roots.get(v),
        })
    if final:
        return out, []
    handed, done = [], set()
    under = parent[spine & (parent >= 0)], np.flatnonzero(spine & (parent >= 0))
    rest = {}
    for c, x in (("n", n), ("leaves", n_leaves), ("saved", saved)):
        rest[c] = x.copy()
        np.subtract.at(rest[c], under[0], x[under[1]])
    rest["children"] = n_children.copy()
    np.subtract.at(rest["children"], under[0], 1)
    for w, p in ((where[0], paths[0]), (where[-1], paths[-1]))[: min(2, len(paths))]:
        fresh = np.array([v not in done for v in w.tolist()])
        done |= set(w.tolist())
        row = {c: np.where(fresh, rest[c][w], 0).tolist() for c in rest}
        row |= {"key": p["key"], "size": tokens[w].tolist(), "low": np.where(fresh, low[w], FAR).tolist()}
        row["ends"] = [ends.get(v) if f else None for v, f in zip(w.tolist(), fresh, strict=True)]
        handed.append(row)
    return out, handed


_NODE = pa.schema([
    ("depth", pa.int32()), *[(c, pa.int64()) for c in ("conv_id", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens")],
    *[(c, pa.string()) for c in ("ends_sha256", "id", "above", "tree")],
])
_PATH = pa.schema([
    ("key", pa.string()), *[(c, pa.list_(pa.int64())) for c in ("size", "n", "leaves", "saved", "children", "low")], ("ends", pa.list_(pa.string())),
])


def _shards(paths: DataFrame, final: bool, named: bool, nodes: int) -> DataFrame:
    """Runs build() on runs of at most `nodes` nodes of each partition's paths."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(run):
            done, handed = build(run, final, named)
            a, b = pa.Table.from_pylist(done, _NODE), pa.Table.from_pylist(handed, _PATH)
            for x, other in ((a, _PATH), (b, _NODE)):
                for t in x.to_batches():
                    columns = dict(zip(t.schema.names, t.columns, strict=True)) | {f.name: pa.nulls(t.num_rows, f.type) for f in other}
                    yield pa.RecordBatch.from_arrays([columns[f.name] for f in [*_NODE, *_PATH]], schema=pa.schema([*_NODE, *_PATH]))

        run, held = [], 0
        for batch in batches:
            for p in batch.to_pylist():
                if run and held + len(p["key"]) // WIDTH > nodes and not final:
                    yield from made(run)
                    run, held = [], 0
                run.append(p)
                held += len(p["key"]) // WIDTH
        if run:
            yield from made(run)

    return paths.mapInArrow(go, f"{NODE}, {PATH}")


def _trie(paths: DataFrame, nodes: int) -> DataFrame:
    """The nodes (NODE) of distinct paths (PATH), shard by shard and then spine by spine."""
    done, before = [], None
    while True:
        held = paths.agg(F.sum(F.length("key") / WIDTH).alias("nodes"), F.count("*").alias("paths")).first()
        # spines that don't halve are as few as shards and partitions
        final = (held.nodes or 0) <= nodes or before is not None and held.paths * 2 > before
        dealt = paths.repartition(1) if final else paths.repartitionByRange("key")
        made = staged(_shards(dealt.sortWithinPartitions("key"), final, bool(done), nodes), "trie")
        done.append(made.filter("key is null").select(*_NODE.names))
        if final:
            break
        paths, before = made.filter("key is not null").select(*_PATH.names), held.paths
    found = done[0]
    for d in done[1:]:
        found = found.union(d)
    # parents on a spine were not complete when their children were; nodes with ids are the spines'
    spine = found.filter("id is not null").select(F.col("id").alias("above"), F.col("conv_id").alias("up"))
    late = found.filter("above is not null").join(spine, "above").withColumn("parent", F.col("up"))
    return found.filter("above is null").unionByName(late.drop("up")).drop("above", "id")


def positions(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest, size (bytes of the text) of each turn.

    Turns are dealt by ranges of their order, so a long conversation spans tasks; a range
    numbers its turns, and one row a range and conversation says where the next range goes on.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = only(conversations, "conv_id", "turn", "role", "text").filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.left(F.sha2(F.concat_ws(":", F.length(role), role, text), 256), F.lit(WIDTH)).alias("digest"), F.octet_length(text).cast("long").alias("size"),
    )
    order = ("conv_id", "turn", "role", "digest")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, reached = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ids = np.asarray(batch.column("conv_id"))
            if not len(ids):
                continue
            first = np.concatenate([[True], ids[1:] != ids[:-1]])
            start = np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
            k = np.arange(len(ids)) - start + 1
            if ids[0] == last:
                k[: np.argmin(np.append(ids == last, False))] += reached
            last, reached = ids[-1], int(k[-1])
            columns = [batch.column("conv_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(k), batch.column("digest"), batch.column("size")]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "k", "digest", "size"])

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = staged(ranged.mapInArrow(number, "conv_id long, part int, k long, digest string, size long"), "turns")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy("conv_id", "part").agg(F.max("k").alias("n"))
    # a conversation that goes on in a range is the range's first, so there are fewer of them than ranges
    offset = counts.withColumn("offset", F.sum("n").over(earlier)).filter("offset is not null").drop("n")
    found = numbered.join(F.broadcast(offset), ["conv_id", "part"], "left")
    return found.select("conv_id", (F.col("k") + F.coalesce("offset", F.lit(0))).alias("pos"), "digest", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (as of positions()) of conversations that begin as the first one of their five does, and conv_id, n_turns.

    Conversation c takes the first crc32(c) % 9 turns of c - c % 5, then its own turns after as many.
    """
    lengths = staged(turns.groupBy("conv_id").agg(F.max("pos").alias("own")), "lengths")
    convs = lengths.withColumns({"head": F.crc32(F.col("conv_id").cast("string")) % 9, "base": F.col("conv_id") - F.col("conv_id") % 5})
    convs = convs.join(lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left")
    convs = convs.withColumn("taken", F.least("head", F.coalesce("there", F.lit(0))))
    convs = staged(convs.withColumn("n_turns", F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))), "convs")
    heads = turns.filter("pos <= 8").withColumnRenamed("conv_id", "base")
    front = convs.select("conv_id", "base", "taken").join(heads, "base").filter("pos <= taken").select("conv_id", "pos", "digest", "size")
    back = turns.join(convs.select("conv_id", "head", "taken"), "conv_id").filter("pos > head")
    back = back.select("conv_id", (F.col("pos") - F.col("head") + F.col("taken")).alias("pos"), "digest", "size")
    return front.union(back), convs.select("conv_id", "n_turns")


def _ends(ending: DataFrame) -> DataFrame:
    """path, ends_sha256: the digest of the ids (ascending, comma-joined) of the conversations that end there."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, sha = None, None
        for batch in batches:
            out = []
            for p, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if p == path:
                    sha.update(f",{c}".encode())
                    continue
                if path is not None:
                    out.append((path, sha.hexdigest()))
                path, sha = p, hashlib.sha256(str(c).encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in (0, 1)], ["path", "ends_sha256"])
        if path is not None:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([sha.hexdigest()])], ["path", "ends_sha256"])

    dealt = ending.select("path", "conv_id").repartition("path").sortWithinPartitions("path", "conv_id")
    return dealt.mapInArrow(go, "path string, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, band: int = BAND, nodes: int = NODES) -> DataFrame:
    """One row a node of the trie of turns (conv_id, pos from 1, digest, size); convs: conv_id, n_turns, even of those with none.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 (of the ids of the conversations that end at the node).
    """
    root = "0" * WIDTH
    convs = convs.withColumn("last", F.greatest(F.floor((F.col("n_turns") - 1) / band), F.lit(0)).cast("int"))
    bands = (convs.agg(F.max("last")).first()[0] or 0) + 1
    rows = turns.withColumn("band", F.floor((F.col("pos") - 1) / band).cast("int"))
    parts = rows.groupBy("conv_id", "band").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "size"))).alias("path"))
    parts = parts.select("conv_id", "band", F.array_join("path.digest", "").alias("turns"), F.col("path.size").alias("size"))
    parts = convs.join(parts, "conv_id", "left").withColumns({"band": F.coalesce("band", F.lit(0)), "turns": F.coalesce("turns", F.lit(""))})
    if bands > 1:
        # what tells the trees of deeper bands apart: sums of digests of all bands before, so that they run along a conversation
        digest = F.sha2(F.concat_ws(":", "band", "turns"), 256)
        halves = [F.conv(F.substring(digest, s, 15), 16, 10).cast("decimal(38,0)") for s in (1, 16)]
        before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
        after = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)

        def name(w, of):
            return F.left(F.sha2(F.concat_ws(":", of, *[F.sum(h).over(w) for h in halves]), 256), F.lit(WIDTH))

        parts = parts.withColumns({"tree": F.when(F.col("band") == 0, root).otherwise(name(before, F.col("band"))), "after": name(after, F.col("band") + 1)})
    else:
        parts = parts.withColumns({"tree": F.lit(root), "after": F.lit(None).cast("string")})
    parts = parts.withColumns({"key": F.concat("tree", "turns"), "ends": F.col("band") == F.col("last")}).withColumn("path", F.sha2("key", 256))
    parts = staged(parts.withColumn("after", F.when(~F.col("ends"), F.col("after"))), "paths")
    units = parts.groupBy("band", "key", "path").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("low"), F.first("size").alias("size"), F.max("after").alias("after"), F.first("tree").alias("tree"),
    )
    units = staged(units.join(_ends(parts.filter("ends")), "path", "left"), "units")
    schema = ", ".join(f"{c} long" for c in ("n_children", "n_leaves", "saved_tokens"))
    spark, out = turns.sparkSession, None
    totals = spark.createDataFrame([], f"after string, {schema}")
    for k in range(bands - 1, -1, -1):
        these = units.filter(F.col("band") == k)
        hanging = these.filter("after is not null").join(totals, "after")
        these = these.filter("after is null").unionByName(hanging, allowMissingColumns=True)
        if k:
            up = units.filter((F.col("band") == k - 1) & F.col("after").isNotNull()).select(F.col("after").alias("tree"), F.col("low").alias("top"))
            these = these.join(up, "tree")
        else:
            these = these.withColumn("top", F.lit(FAR))
        length = F.when(F.col("size").isNull(), 0).otherwise(F.size("size"))

        def only_last(x, fill=0, first=None, length=length):
            rest = F.array_repeat(F.lit(fill).cast("long"), length.cast("int"))
            if first is None:
                return F.concat(rest, F.array(x.cast("long")))
            # the tree's root is also the end of the path that it hangs on
            inner = F.array_repeat(F.lit(fill).cast("long"), (length - 1).cast("int"))
            return F.when(length == 0, F.array(F.least(x, first))).otherwise(F.concat(F.array(first), inner, F.array(x)))

        paths = these.select(
            "key", F.concat(F.array(F.lit(0).cast("long")), F.coalesce("size", F.array().cast("array<long>"))).alias("size"),
            only_last(F.col("n")).alias("n"), only_last(F.coalesce("n_leaves", F.lit(0))).alias("leaves"),
            only_last(F.coalesce("saved_tokens", F.lit(0))).alias("saved"), only_last(F.coalesce("n_children", F.lit(0))).alias("children"),
            only_last(F.col("low"), FAR, F.col("top")).alias("low"),
            F.concat(F.array_repeat(F.lit(None).cast("string"), length.cast("int")), F.array("ends_sha256")).alias("ends"),
        )
        found = _trie(staged(paths, "keys"), nodes)
        if bands > 1:
            found = staged(found, "nodes")
        totals = found.filter("depth = 1").select(F.col("tree").alias("after"), "n_children", "n_leaves", "saved_tokens")
        shown = (found.filter("depth > 1") if k else found).withColumn("depth", (F.col("depth") + (k * band - 1)).cast("long"))
        out = shown if out is None else out.unionByName(shown)
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
