"""The trie of conversations by their turns, from sorted turn-id matrices.

A turn's id is the 128-bit digest of its role and text; texts go no further than
the scan. Conversations, as arrays of turn ids, are dealt into range shards by
those arrays, then conv_id, so that members of a node lie next to each other and
a crowd of equal conversations spreads over several shards. Inside a shard:

* ids become ranks, conversations rows of matrices padded with 0, ``BLOCK`` turns
  wide (rows without so many turns are in no further block); ``numpy.lexsort``
  orders them, the deepest block first, its rank being the last key of the next;
* comparing each row with the one above and OR-accumulating the differences along
  the turns gives the marks where a node of each depth starts;
* ``reduceat`` over those starts sums up every depth, from the deepest to the root.

Nodes on the path of a shard's first or last row may go on in other shards. They
are given out as partial rows, without their own share in the sums of their
subtree; what all shards found is added per node, its own share is then counted
once, and flows up along the paths (of a path, the nodes that no earlier path has
are its end, so a sum along the path suffices). Partial rows number two paths a
shard. Ends of such nodes travel as blocks of conversation ids and are digested
in order, one block at a time.

A task holds the turn ids (24 bytes a turn) of its shard; one conversation's turn
ids must fit a task.

Defined cases: turns of one conversation are read by turn, null first, repeated
turns by their digest, and all count; null role or text is empty; rows without
conv_id belong to no conversation; an empty table has no node, not even a root;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

BLOCK = 16
#: Conversation ids in one block of a crossing node's ends.
ENDS_BLOCK = 1 << 16
#: Rows of the crossing nodes' numbers (24 bytes each) that may be broadcast.
BROADCAST_ROWS = 200_000

_FIELDS = [("kind", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
           ("parent_path", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
           ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("path", pa.int64()), ("words", pa.int64()),
           ("node", pa.binary()), ("parent", pa.binary()), ("block", pa.int64()), ("ids", pa.binary())]
_SCHEMA = ", ".join(f"{n} {({pa.int32(): 'int', pa.int64(): 'long', pa.string(): 'string', pa.binary(): 'binary'})[t]}" for n, t in _FIELDS)
NODE, PARTIAL, ENDS = 0, 1, 2


def turn_arrays(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """(conv_id, turns: array of (id binary(16), words long)) in turn order."""
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    one = F.struct(turns[turn_col].isNotNull().alias("known"), turns[turn_col].alias("turn"),
                   F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("id"),
                   F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"))
    return (turns.where(turns[conv_col].isNotNull()).select(turns[conv_col].cast("long").alias("conv_id"), one.alias("one"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("all"))
            .select("conv_id", F.transform("all", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns")))


def with_borrowed_heads(convs: DataFrame, every: int = 20, upto: int = 4) -> DataFrame:
    """Each conversation c begins with the first h turns of c - c % every, in place
    of its own first h; h is the crc32 of its decimal number modulo ``upto``."""
    heads = (convs.where(F.col("conv_id") % every == 0)
             .select(F.col("conv_id").alias("lender"), F.slice("turns", 1, upto - 1).alias("head")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % upto).cast("int")
    own = convs.withColumn("h", h).withColumn("lender", F.col("conv_id") - F.col("conv_id") % every)
    none = F.filter("turns", lambda _: F.lit(False))
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), F.lit(1), F.greatest(F.col("h"), F.lit(1)))).otherwise(none)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(heads, "lender", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _order(ranks: np.ndarray, offs: np.ndarray, lens: np.ndarray, conv: np.ndarray) -> tuple[np.ndarray, list]:
    """Rows in order of their turn ids, then number; and the blocks' matrices."""
    n_blocks = -(-int(lens.max(initial=0)) // BLOCK)
    blocks: list[tuple[np.ndarray, np.ndarray]] = []
    deeper, rank = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in reversed(range(n_blocks)):
        rows = np.flatnonzero(lens > b * BLOCK)
        at = offs[rows, None] + b * BLOCK + np.arange(BLOCK)
        inside = b * BLOCK + np.arange(BLOCK) < lens[rows, None]
        m = np.zeros((len(rows), BLOCK), np.int64)
        m[inside] = ranks[at[inside]]
        last = np.zeros(len(rows), np.int64)
        last[np.searchsorted(rows, deeper)] = rank
        order = np.lexsort((last, *m.T[::-1]))
        sm, sl = m[order], last[order]
        change = np.ones(len(rows), bool)
        change[1:] = (sm[1:] != sm[:-1]).any(axis=1) | (sl[1:] != sl[:-1])
        rank = np.empty(len(rows), np.int64)
        rank[order] = np.cumsum(change)
        deeper = rows
        blocks.append((rows, m))
    first = np.zeros(len(lens), np.int64)
    first[deeper] = rank
    return np.lexsort((conv, first)), blocks[::-1]


def _levels(order: np.ndarray, lens: np.ndarray, blocks: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per depth from 1: places (in order) of the rows that have so many turns,
    and the marks of those that start a node."""
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    carry, above = np.zeros(len(order), bool), np.arange(len(order))
    for b, (rows, m) in enumerate(blocks):
        sort = np.argsort(place[rows])
        at, m = place[rows][sort], m[sort]
        # what changed up to here against the row above, if that row is still there
        known = np.searchsorted(above, at)
        start = carry[known] | (known == 0)
        still = np.isin(above, at)
        start |= ~still[np.maximum(known - 1, 0)]
        diff = np.zeros(m.shape, bool)
        diff[1:] = m[1:] != m[:-1]
        diff[:, 0] |= start
        acc = np.logical_or.accumulate(diff, axis=1)
        for c in range(BLOCK):
            has = m[:, c] != 0
            if not has.any():
                break
            yield at[has], acc[has, c]
        carry, above = acc[:, -1], at


def _sums_by(parent: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` over ascending ``parent`` numbers below n."""
    out = np.zeros(n, np.int64)
    if len(parent):
        cut = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        out[parent[cut]] = np.add.reduceat(values, cut)
    return out


def _path_keys(ids: list[bytes]) -> list[bytes]:
    """A key for every prefix, the empty one included."""
    h, out = hashlib.sha256(), []
    for one in [b"", *ids]:
        h.update(one)
        out.append(h.digest()[:16])
    return out


def shard_trie(conv: np.ndarray, offs: np.ndarray, lens: np.ndarray, ids: np.ndarray, words: np.ndarray,
               shard: int) -> dict[str, list]:
    """Nodes, partial rows and blocks of ends of one shard; ``ids`` are the turns'
    digests as an (n, 2) array of unsigned big-endian halves."""
    out: dict[str, list] = {name: [] for name, _ in _FIELDS}

    def put(n: int, **cols) -> None:
        for name, _ in _FIELDS:
            given = cols.get(name)
            out[name].extend(given if isinstance(given, list) else [given] * n)

    by_id = np.lexsort((ids[:, 1], ids[:, 0]))
    sorted_ids = ids[by_id]
    new = np.ones(len(ids), bool)
    new[1:] = (sorted_ids[1:] != sorted_ids[:-1]).any(axis=1)
    ranks = np.empty(len(ids), np.int64)
    ranks[by_id] = np.cumsum(new)
    order, blocks = _order(ranks, offs, lens, conv)
    conv, offs, slens = conv[order], offs[order], lens[order]

    # depth by depth: places, node of each place, first place and parent of each node
    levels = [(np.arange(len(conv)), np.zeros(len(conv), np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    for at, marks in _levels(order, lens, blocks):
        up_at, up_node = levels[-1][:2]
        node = np.cumsum(marks) - 1
        begin = np.flatnonzero(marks)
        levels.append((at, node, begin, up_node[np.searchsorted(up_at, at[begin])]))
    paths = [2 * shard, 2 * shard + 1]
    ends_of_path = [0, len(conv) - 1]
    raw = np.ascontiguousarray(ids).astype(">u8").tobytes()
    keys = [_path_keys([raw[16 * k:16 * k + 16] for k in range(offs[r], offs[r] + slens[r])]) for r in ends_of_path]

    below = (np.zeros(0, np.int64),) * 4  # parents, own and subtree sums of the next depth: children, leaves, saved
    for depth in reversed(range(len(levels))):
        at, node, begin, up = levels[depth]
        n = len(begin)
        parents, shown, leaves, saved = below
        children = _sums_by(parents, shown, n)
        n_convs = np.diff(np.concatenate([begin, [len(at)]]))
        least = np.minimum.reduceat(conv[at], begin)
        word = words[offs[at[begin]] + depth - 1] if depth else np.zeros(n, np.int64)
        crossing = np.zeros(n, bool)
        on_path = [(p, int(node[0 if e == 0 else -1])) for e, p in enumerate(paths) if slens[ends_of_path[e]] >= depth]
        crossing[[k for _, k in on_path]] = True
        sub_leaves = _sums_by(parents, leaves, n) + ((children == 0) & ~crossing)
        sub_saved = _sums_by(parents, saved, n) + np.where(crossing, 0, (n_convs - 1) * word)
        enders = slens[at] == depth
        n_ends = np.add.reduceat(enders.astype(np.int64), begin)
        # nodes that end in this shard
        inner = np.flatnonzero(~crossing)
        if depth and len(inner):
            p_at, p_node, p_begin, _ = levels[depth - 1]
            parent_path = np.full(len(p_begin), -1, np.int64)
            for e, p in reversed(list(enumerate(paths))):
                if slens[ends_of_path[e]] >= depth - 1:
                    parent_path[p_node[0 if e == 0 else -1]] = p
            p_least = np.minimum.reduceat(conv[p_at], p_begin)[up[inner]]
            p_cross = parent_path[up[inner]]
            digests = [hashlib.sha256(b",".join(b"%d" % c for c in conv[at[b:b + k]].tolist())).hexdigest()
                       for b, k in zip(begin[inner].tolist(), n_ends[inner].tolist())]
            put(len(inner), kind=NODE, conv_id=least[inner].tolist(), depth=depth,
                parent_conv_id=[None if c >= 0 else q for q, c in zip(p_least.tolist(), p_cross.tolist())],
                parent_path=[c if c >= 0 else None for c in p_cross.tolist()], n_convs=n_convs[inner].tolist(),
                n_children=children[inner].tolist(), n_leaves=sub_leaves[inner].tolist(),
                saved_tokens=sub_saved[inner].tolist(), ends_sha256=digests)
        # nodes that may go on elsewhere: what both paths share is given once
        for e, (p, k) in enumerate(on_path):
            again = e == 1 and on_path[0][1] == k
            key = keys[p - paths[0]]
            put(1, kind=PARTIAL, path=p, depth=depth, node=key[depth], parent=key[depth - 1] if depth else None,
                words=int(word[k]), conv_id=int(least[k]), n_convs=0 if again else int(n_convs[k]),
                n_children=0 if again else int(children[k]), n_leaves=0 if again else int(sub_leaves[k]),
                saved_tokens=0 if again else int(sub_saved[k]))
            if not again:
                mine = np.sort(conv[at[begin[k]:begin[k] + n_ends[k]]])
                for block, a in enumerate(range(0, len(mine), ENDS_BLOCK)):
                    put(1, kind=ENDS, path=p, depth=depth, node=key[depth], block=block,
                        ids=mine[a:a + ENDS_BLOCK].astype("<i8").tobytes())
        below = (up, (~crossing).astype(np.int64), sub_leaves, sub_saved)
    return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got).combine_chunks()
    conv = t.column("conv_id").combine_chunks().to_numpy(zero_copy_only=False)
    key, words = (t.column(c).combine_chunks() for c in ("key", "words"))
    lens = np.diff(words.offsets.to_numpy()).astype(np.int64)
    offs = np.cumsum(lens) - lens
    flat = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    # the keys' bytes lie one after the other: 16 a turn
    ids = np.frombuffer(b"".join(key.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
    cols = shard_trie(conv.astype(np.int64), offs, lens, ids, flat, TaskContext.get().partitionId())
    n = len(cols["kind"])
    for a in range(0, n, 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(cols[c][a:a + 20_000], k) for c, k in _FIELDS], names=[c for c, _ in _FIELDS])


def _digest_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order of node, path and number -> one digest a node."""
    now, h, done = None, None, []
    for batch in batches:
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = b",".join(b"%d" % c for c in np.frombuffer(ids, "<i8").tolist())
            if node != now:
                if h:
                    done.append((now, h.hexdigest()))
                now, h = node, hashlib.sha256(text)
            else:
                h.update(b"," + text)
    if h:
        done.append((now, h.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])],
                                         names=["node", "ends_sha256"])


def trie(convs: DataFrame) -> DataFrame:
    """Nodes of the trie of (conv_id, turns): conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = convs.sparkSession
    keyed = convs.select("conv_id", F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "").alias("hex"),
                         F.col("turns.words").alias("words")).select("conv_id", F.unhex("hex").alias("key"), "words")
    found = written(keyed.repartitionByRange("key", "conv_id").mapInArrow(_shards, _SCHEMA), "trie-shards")

    partial = found.where(F.col("kind") == PARTIAL)
    sums = partial.groupBy("node").agg(
        F.min("depth").alias("depth"), F.first("parent").alias("parent"), F.first("words").alias("words"),
        F.min("path").alias("owner"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("inner_children"), F.sum("n_leaves").alias("inner_leaves"),
        F.sum("saved_tokens").alias("inner_saved"))
    sums = written(sums, "trie-crossing")
    more = sums.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("crossing_children"))
    nodes = sums.join(more, "node", "left").withColumn("n_children", F.col("inner_children") + F.coalesce("crossing_children", F.lit(0)))
    # a node's own leaf and savings, counted on the first path that has it, flow up that path
    own = partial.select("path", "depth", "node").join(nodes.select(
        "node", "owner", (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("own_saved")), "node")
    mine = F.col("path") == F.col("owner")
    from pyspark.sql import Window
    up = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    flow = (own.select("node", F.sum(F.when(mine, F.col("leaf")).otherwise(0)).over(up).alias("leaves"),
                       F.sum(F.when(mine, F.col("own_saved")).otherwise(0)).over(up).alias("saved"))
            .groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    ends = (found.where(F.col("kind") == ENDS).select("node", "path", "block", "ids").repartition("node")
            .sortWithinPartitions("node", "path", "block").select("node", "ids")
            .mapInArrow(_digest_blocks, "node binary, ends_sha256 string"))
    parents = sums.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    crossing = (nodes.join(flow, "node").join(ends, "node", "left").join(parents, "parent", "left")
                .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                        (F.col("inner_leaves") + F.col("leaves")).alias("n_leaves"),
                        (F.col("inner_saved") + F.col("saved")).alias("saved_tokens"),
                        F.coalesce("ends_sha256", none).alias("ends_sha256")))

    inner = found.where(F.col("kind") == NODE).withColumn("parent_depth", F.col("depth") - 1)
    tops = partial.select("path", "depth", "node").join(sums.select("node", F.col("conv_id").alias("top")), "node").select(
        F.col("path").alias("parent_path"), F.col("depth").alias("parent_depth"), "top")
    tops = written(tops, "trie-tops")
    if tops.count() <= BROADCAST_ROWS:
        tops = F.broadcast(tops)
    inner = inner.join(tops, ["parent_path", "parent_depth"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "top"))
    return inner.select(*crossing.columns).unionByName(crossing)
