"""The prefix trie of conversations, built from sorted neighbours.

Distinct sequences of turns are sorted; the longest common prefix (LCP) of each pair of
neighbours is an edge. Union-find takes the edges of a partition in descending depth: every
merge of two components is a branching node, and what a component held below it is complete.
Nodes that reach over a partition's border are left open: they contract to one partial row per
partition and node, and partial rows of one node are merged by their key. A sequence is cut into
pieces of at most ``PIECE_TURNS`` turns; the tries of later pieces hang below the ends of earlier
ones and are built first. So no row, task or message grows with a conversation or a group of copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leaguelens.llm.common import crc_bucket
from leaguelens.operators.common import number_rows
from leaguelens.session import checkpointed

PIECE_TURNS = 1 << 15
DIGEST = 16  # bytes that stand for a turn
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, pos, digest, words): every turn at its place from 0; a null role or text is empty.

    Null turns come first; turns of one number are ordered by a digest of role and text.
    """
    said, spoken = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text, role))
    # the length keeps role and text apart
    whole = F.concat(F.octet_length(spoken).cast("string"), F.lit(":"), spoken, said)
    narrow = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * DIGEST).alias("digest"),
        F.regexp_count(said, F.lit(WORD)).cast("long").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    return number_rows(narrow, "conv", order, "pos").select("conv", (F.col("pos") - 1).alias("pos"), "digest", "words")


def rebuilt(turns: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """Turns of the rebuilt conversations: the first h of the family's first conversation, then the own after h.

    The family's first conversation is c - c % ``family``, h is crc32(c) % ``heads``.
    """
    h = crc_bucket(F.col("conv"), heads).cast("long")
    own = turns.withColumn("h", h)
    base = F.col("conv") - F.col("conv") % family
    first = turns.where(F.col("pos") < heads - 1).select(
        F.col("conv").alias("base"), F.col("pos").alias("at"), F.col("digest").alias("d"), F.col("words").alias("w")
    )
    ids = own.select("conv", "h").distinct().withColumn("base", base).where("h > 0")
    given = ids.join(first, "base").where("at < h").select("conv", F.col("at").alias("pos"), F.col("d").alias("digest"), F.col("w").alias("words"))
    lengths = given.groupBy("conv").agg(F.count(F.lit(1)).alias("given"))
    rest = own.where("pos >= h").join(lengths, "conv", "left")
    rest = rest.select("conv", (F.col("pos") - F.col("h") + F.coalesce("given", F.lit(0))).alias("pos"), "digest", "words")
    return given.unionByName(rest)


def _listed(name: str) -> Column:
    return F.transform("turns", lambda t: t[name])


def pieces(turns: DataFrame, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """(conv, piece, path, words, size, above, ending): each conversation's turns, cut into pieces.

    ``path`` joins the digests of the turns, ``above`` stands for all earlier pieces (empty
    for the first) and ``ending`` for the sequence up to the end of this one.
    """
    cut = turns.withColumn("piece", F.floor(F.col("pos") / piece_turns))
    held = cut.groupBy("conv", "piece").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))).alias("turns"))
    rows = held.select(
        "conv", "piece", F.unhex(F.array_join(_listed("digest"), "")).alias("path"), _listed("words").alias("words"), F.size("turns").alias("size")
    )
    rows = checkpointed(rows.withColumn("own", F.sha2("path", 256)))
    many = rows.where("piece > 0").select("conv").distinct()
    chain = rows.join(many, "conv", "left_semi").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("piece", "own"))).alias("all"))
    upto = chain.select("conv", F.explode("all").alias("x"), "all").select(
        "conv",
        F.col("x.piece").alias("piece"),
        F.sha2(F.array_join(F.transform(F.slice("all", F.lit(1), (F.col("x.piece") + 1).cast("int")), lambda p: p["own"]), ""), 256).alias("ending"),
    )
    rows = rows.join(upto, ["conv", "piece"], "left").withColumn("ending", F.coalesce("ending", F.sha2("own", 256)))
    before = upto.select("conv", (F.col("piece") + 1).alias("piece"), F.col("ending").alias("above"))
    return rows.join(before, ["conv", "piece"], "left").withColumn("above", F.coalesce("above", F.lit(""))).drop("own")


def _list_digests(batches):
    """SHA-256 of the comma-joined ids of each ending; rows come sorted by (ending, conv)."""
    ending, state = None, None
    for batch in batches:
        names, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        done = []
        for name, conv in zip(names, ids, strict=True):
            if name != ending:
                if state is not None:
                    done.append((ending, state.hexdigest()))
                ending, state = name, hashlib.sha256(str(conv).encode())
            else:
                state.update(b",%d" % conv)
        yield _pairs(done)
    if state is not None:
        yield _pairs([(ending, state.hexdigest())])


def _pairs(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["ending", "ends"])


def list_digests(ends: DataFrame) -> DataFrame:
    """(ending, ends): the digest of the sorted ids (conv) of each ending.

    The digest is a chain over its ids, so one task reads the ids of an ending in
    sorted order, one Arrow batch at a time, and holds nothing else.
    """
    ordered = ends.select("ending", "conv").repartition("ending").sortWithinPartitions("ending", "conv")
    return ordered.mapInArrow(_list_digests, "ending string, ends string")


# --- the trie of one partition -------------------------------------------------------------

ROW = (
    "part int, last boolean, depth long, key binary, parent_key binary, parent long, word long, first long, "
    "n long, children long, leaves long, saved long, ends string, above string"
)
NAMES = [x.split()[0] for x in ROW.split(", ")]


def common_turns(a: bytes, b: bytes) -> int:
    """The number of whole turns that two paths have in common from their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // DIGEST


class Forest:
    """Components of sorted distinct sequences, merged along LCP edges in descending depth.

    Place k < m is sequence k; every branching node that a merge creates takes a further place.
    A place holds the chain of nodes from just below ``bottom`` down to ``top``; its values are
    those of the lowest. ``left`` and ``right`` are the LCPs with the neighbouring partitions.
    """

    def __init__(self, size: list, n: list, first: list, below: list, lcp: list, left: int, right: int, words: np.ndarray):
        m = len(size)
        self.m, self.left, self.right = m, left, right
        self.row, self.top, self.bottom = list(range(m)), list(size), [0] * m
        self.low, self.high = list(range(m)), list(range(m))
        self.n, self.first, self.parent = list(n), list(first), [-1] * m
        self.kids, self.saved = [b[0] for b in below], [b[2] for b in below]
        after = lcp[1:] + [right]
        # a sequence is a leaf if none below continues it and its neighbour does not
        self.leaves = [b[1] if b[0] else int(after[k] < size[k]) for k, b in enumerate(below)]
        self.at = np.r_[0, np.cumsum(size)[:-1]].tolist() if m else []
        self.sums = np.r_[0, np.cumsum(words)]
        self.up = list(range(m))
        edges = sorted((k for k in range(1, m) if lcp[k]), key=lambda k: -lcp[k])
        for k in edges:
            self._merge(k - 1, k, lcp[k])

    def _root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k

    def limit(self, k: int) -> int:
        """Nodes of this place down to this depth reach over a border of the partition."""
        left = self.left if self.low[k] == 0 else 0
        right = self.right if self.high[k] == self.m - 1 else 0
        return min(self.top[k], max(left, right))

    def _close(self, k: int, depth: int, parent: int) -> None:
        """Hang the chain of place ``k`` below the node at ``depth``: what is complete goes to it."""
        self.bottom[k], self.parent[k], self.up[k] = depth, parent, parent
        start = max(depth, self.limit(k))
        self.saved[parent] += self.saved[k] + (self.n[k] - 1) * self.words(k, start)
        self.kids[parent] += start == depth
        self.leaves[parent] += self.leaves[k]
        self.n[parent] += self.n[k]
        self.first[parent] = min(self.first[parent], self.first[k])
        self.high[parent] = max(self.high[parent], self.high[k])

    def words(self, k: int, above: int) -> int:
        """Words of the chain's turns below depth ``above``."""
        at = self.at[self.row[k]]
        return int(self.sums[at + self.top[k]] - self.sums[at + above])

    def _merge(self, left: int, right: int, depth: int) -> None:
        a, b = self._root(left), self._root(right)
        if self.top[a] > depth:
            node = len(self.top)
            for values, value in (
                (self.row, self.row[a]), (self.top, depth), (self.bottom, 0), (self.low, self.low[a]), (self.high, self.high[a]),
                (self.n, 0), (self.first, self.first[a]), (self.parent, -1), (self.kids, 0), (self.saved, 0), (self.leaves, 0), (self.up, node),
            ):
                values.append(value)
            self._close(a, depth, node)
            a = node
        self._close(b, depth, a)


def _rows(forest: Forest, part: int, ends: list, aboves: list, keys_left: list, keys_right: list) -> pa.RecordBatch:
    """All nodes of a partition: the complete ones, and partial rows of those that reach over its border."""
    f = forest
    top, bottom = np.array(f.top), np.array(f.bottom)
    limit = np.array([f.limit(k) for k in range(len(f.top))])
    row, n, first = np.array(f.row), np.array(f.n), np.array(f.first)
    lowest = np.maximum(bottom, limit)
    count = np.maximum(0, top - lowest)
    place = np.repeat(np.arange(len(top)), count)
    depth = lowest[place] + 1 + np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
    at = np.array(f.at)[row[place]]
    saved = np.array(f.saved)[place] + (n[place] - 1) * (f.sums[at + top[place]] - f.sums[at + depth - 1])
    ending = depth == top[place]
    kids = np.where(ending, np.array(f.kids)[place], 1)

    def key(k, d):
        return keys_left[d] if f.low[k] == 0 and d <= f.left else keys_right[d]

    parent, parent_key = first[place].tolist(), [None] * len(place)
    for x in np.flatnonzero(depth == lowest[place] + 1).tolist():  # the upper end of every chain
        k, d = int(place[x]), int(depth[x]) - 1
        if d > f.bottom[k]:
            parent[x], parent_key[x] = None, key(k, d)
        elif d == 0:
            parent[x] = None
        elif d <= limit[f.parent[k]]:
            parent[x], parent_key[x] = None, key(f.parent[k], d)
        else:
            parent[x] = f.first[f.parent[k]]
    closed = {
        "part": [None] * len(place), "last": [None] * len(place), "depth": depth.tolist(), "key": [None] * len(place),
        "parent_key": parent_key, "parent": parent, "word": [None] * len(place), "first": first[place].tolist(),
        "n": n[place].tolist(), "children": kids.tolist(), "leaves": np.array(f.leaves)[place].tolist(), "saved": saved.tolist(),
        "ends": [ends[k] if e and k < f.m else None for k, e in zip(place.tolist(), ending.tolist(), strict=True)],
        "above": [aboves[r] if d == 1 else None for r, d in zip(row[place].tolist(), depth.tolist(), strict=True)],
    }
    for k in np.flatnonzero(limit > bottom).tolist():
        for d in range(f.bottom[k] + 1, int(limit[k]) + 1):
            at = f.at[f.row[k]]
            lower = d == f.top[k]
            values = (
                part, f.high[k] == f.m - 1 and d <= f.right, d, key(k, d), key(k, d - 1) if d > 1 else None, None,
                int(f.sums[at + d] - f.sums[at + d - 1]), f.first[k], f.n[k],
                f.kids[k] if lower else int(d == limit[k]), f.leaves[k],
                f.saved[k] + (f.n[k] - 1) * f.words(k, int(limit[k])),
                ends[k] if lower and k < f.m else None, aboves[f.row[k]] if d == 1 else None,
            )
            for name, value in zip(NAMES, values, strict=True):
                closed[name].append(value)
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in ROW.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(closed[c], kinds[t]) for c, t in fields], names=NAMES)


def _keys(above: str, path: bytes, depth: int) -> list:
    """Keys of the nodes from depth 0 to ``depth`` along a path."""
    state, out = hashlib.sha256(above.encode()), [None]
    for d in range(depth):
        state.update(path[d * DIGEST : (d + 1) * DIGEST])
        out.append(state.digest()[:DIGEST])
    return out


def _tries(borders: dict[int, tuple[int, int]]):
    def run(batches):
        part, previous, start = None, None, None
        size, n, first, below, lcp, ends, aboves, words = [], [], [], [], [], [], [], []
        for batch in batches:
            for above, path in zip(batch.column("above").to_pylist(), batch.column("path").to_pylist(), strict=True):
                start = start or (above, path)
                same = previous is not None and previous[0] == above
                lcp.append(common_turns(previous[1], path) if same else 0)
                previous = (above, path)
                aboves.append(above)
            columns = (batch.column(c).to_pylist() for c in ("size", "n", "first", "ends"))
            for held, more in zip((size, n, first, ends), columns, strict=True):
                held += more
            below += zip(*(batch.column(c).to_pylist() for c in ("kids", "leaves", "saved")), strict=True)
            words.append(batch.column("words").flatten().to_numpy())
            part = batch.column("part")[0].as_py() if batch.num_rows else part
        if part is None:
            return
        left, right = borders[part]
        forest = Forest(size, n, first, below, lcp, left, right, np.concatenate(words))
        rows = _rows(forest, part, ends, aboves, _keys(*start, left), _keys(*previous, right))
        for at in range(0, rows.num_rows, 4096):
            yield rows.slice(at, 4096)

    return run


def _ends_of_parts(batches):
    start, previous, part = None, None, None
    for batch in batches:
        if batch.num_rows:
            rows = batch.select(["above", "path", "part"])
            start = start or rows.slice(0, 1).to_pylist()[0]
            previous = rows.slice(rows.num_rows - 1, 1).to_pylist()[0]
            part = previous["part"]
    if part is not None:
        values = ([part], [start["above"]], [start["path"]], [previous["above"]], [previous["path"]])
        kinds = (pa.int32(), pa.string(), pa.binary(), pa.string(), pa.binary())
        names = ["part", "above", "path", "last_above", "last_path"]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)


def _border_lcps(batches):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            out.append(common_turns(r["before"], r["path"]) if r["before_above"] == r["above"] else 0)
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(out, pa.int32())], names=["part", "lcp"])


def borders(ordered: DataFrame) -> dict[int, tuple[int, int]]:
    """LCPs with the sequences before and after each partition that holds rows: two numbers a partition."""
    found = ordered.mapInArrow(_ends_of_parts, "part int, above string, path binary, last_above string, last_path binary")
    along = W.orderBy("part")  # one row per partition
    found = found.select(
        "part", "above", "path", F.lag("last_above").over(along).alias("before_above"), F.lag("last_path").over(along).alias("before")
    )
    lcps = sorted((r["part"], r["lcp"]) for r in found.mapInArrow(_border_lcps, "part int, lcp int").collect())
    return {part: (lcp, lcps[k + 1][1] if k + 1 < len(lcps) else 0) for k, (part, lcp) in enumerate(lcps)}


def trie(sequences: DataFrame) -> DataFrame:
    """All nodes of the tries over distinct sequences, one trie for each value of ``above``.

    ``sequences``: above, path, words, size, n (members), first (smallest member), ends, and of
    what hangs below its end: kids, leaves, saved.
    """
    ordered = sequences.repartitionByRange("above", "path").sortWithinPartitions("above", "path")
    ordered = checkpointed(ordered.withColumn("part", F.spark_partition_id()))
    rows = checkpointed(ordered.mapInArrow(_tries(borders(ordered)), ROW))
    closed, partial = rows.where("part is null"), rows.where("part is not null")
    merged = partial.groupBy("key").agg(
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
        *[F.max(c).alias(c) for c in ("depth", "word", "parent_key", "ends", "above")],
        F.min("first").alias("first"),
        F.min("part").alias("owner"),
    )
    merged = checkpointed(merged)
    # what open nodes save is counted where the node is first met, at the lower end of that partition
    chain = partial.where("last").join(merged.select("key", F.col("n").alias("members"), "owner"), "key")
    term = F.when(F.col("part") == F.col("owner"), (F.col("members") - 1) * F.col("word")).otherwise(0)
    below = F.sum(term).over(W.partitionBy("part").orderBy(F.desc("depth")))
    open_saved = chain.withColumn("more", below).groupBy("key").agg(F.sum("more").alias("more"))
    open_kids = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("open"))
    whole = merged.join(open_saved, "key", "left").join(open_kids, "key", "left")
    whole = whole.withColumn("saved", F.col("saved") + F.coalesce("more", F.lit(0)))
    whole = whole.withColumn("children", F.col("children") + F.coalesce("open", F.lit(0))).withColumn("parent", F.lit(None).cast("long"))
    columns = ["depth", "parent_key", "parent", "first", "n", "children", "leaves", "saved", "ends", "above"]
    nodes = closed.select(columns).unionByName(whole.select(columns))
    parents = merged.select(F.col("key").alias("parent_key"), F.col("first").alias("upper"))
    nodes = nodes.join(parents, "parent_key", "left")
    return nodes.withColumn("parent", F.coalesce("parent", "upper")).drop("upper", "parent_key")


def prefix_trie(
    conversations: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    family: int = 20,
    heads: int = 4,
    piece_turns: int = PIECE_TURNS,
) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations, see ``rebuilt``.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (words that a shared prefix saves, over the node's subtree), ends_sha256 (of the sorted ids of
    the members that end here). Null turns come first; equal turn numbers are ordered by content;
    repeated rows are repeated turns. Rows with a null id belong to no conversation and are not
    read; other columns neither. An empty table has no nodes, not even a root.
    """
    turns = checkpointed(turns_of(conversations, conv, turn, role, text))
    ids = turns.select("conv").distinct()
    rows = checkpointed(pieces(rebuilt(turns, family, heads), piece_turns))
    lasts = rows.groupBy("conv").agg(F.max_by("ending", "piece").alias("ending"))
    lasts = ids.join(lasts, "conv", "left").select(F.coalesce("ending", F.lit("")).alias("ending"), "conv")
    ends = checkpointed(list_digests(lasts))
    sequences = rows.groupBy("piece", "above", "ending").agg(
        F.first("path").alias("path"), F.first("words").alias("words"), F.first("size").alias("size"),
        F.count(F.lit(1)).alias("n"), F.min("conv").alias("first"),
    )
    sequences = checkpointed(sequences.join(ends, "ending", "left"))
    levels = sequences.agg(F.max("piece")).first()[0]
    out, hanging = [], None
    for piece in range(-1 if levels is None else levels, -1, -1):
        level = sequences.where(F.col("piece") == piece).drop("piece")
        if hanging is None:
            level = level.select("*", *[F.lit(0).cast("long").alias(c) for c in ("kids", "leaves", "saved")])
        else:
            level = level.join(hanging, "ending", "left").fillna(0, ["kids", "leaves", "saved"])
        nodes = checkpointed(trie(level.drop("ending")))
        hanging = nodes.where("depth = 1").groupBy(F.col("above").alias("ending")).agg(
            F.count(F.lit(1)).alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
        )
        if piece:
            over = sequences.where(F.col("piece") == piece - 1).select(F.col("ending").alias("above"), F.col("first").alias("upper"))
            nodes = nodes.join(over, "above", "left").withColumn("parent", F.coalesce("parent", "upper")).drop("upper")
        out.append(nodes.withColumn("depth", F.col("depth") + piece * piece_turns).withColumn("top", F.lit(piece == 0)))
    root = ids.agg(F.min("conv").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 0").withColumn("depth", F.lit(0).cast("long"))
    below = (hanging if hanging is not None else ends.select("ending", *[F.lit(0).cast("long").alias(c) for c in ("kids", "leaves", "saved")])).where("ending = ''")
    root = root.withColumn("ending", F.lit("")).join(below.dropDuplicates(["ending"]), "ending", "left").join(ends, "ending", "left")
    smallest = ids.agg(F.min("conv").alias("smallest"))
    rows = root.select(
        F.col("first").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.coalesce("kids", F.lit(0)).alias("n_children"), F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1)).alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
    )
    for nodes in out:
        nodes = nodes.withColumn("smallest", smallest.scalar())
        parent = F.when(F.col("top") & (F.col("depth") == 1), F.col("smallest")).otherwise(F.col("parent"))
        rows = rows.unionByName(
            nodes.select(
                F.col("first").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"),
                F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
            )
        )
    return rows
