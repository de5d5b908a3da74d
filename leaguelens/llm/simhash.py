"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints that differ in at most three bits agree in at least one of four
blocks of 16 bits. For each block there is one trie whose first 16 levels are
that block: pairs of nodes that differ there are pruned at once. Below, pairs of
nodes are traversed together, level by level; each pair carries the bits in
which its two sides differ so far and is dropped once they exceed the budget.
Subtrees with many fingerprints are cut, across tasks, into the pairs of their
own subtrees that are still within the budget.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaguelens.llm.common import components, in_batches, local_stars, one_row_each, text_digest
from leaguelens.session import checkpointed

BUDGET = 3
BLOCKS = BUDGET + 1
BLOCK_BITS = 64 // BLOCKS
REST_BITS = 64 - BLOCK_BITS
STEP_BITS = 4
SUBTREE_ROWS = 20_000
PAIRS_AT_ONCE = 1 << 20
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash of the lower-cased word shingles of a text.

    Only A-Z are lowered. Words are split at ASCII white space. A text of fewer
    words than a shingle has its whole sequence as the only shingle; without
    words the fingerprint is zero.
    """
    parts = text.lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), 42)
    line = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(parts) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    hash64 = xxhash.xxh64_intdigest
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        hashes = np.array(
            [hash64(line[s:e], 42) for s, e in zip(starts[at : at + SHINGLES_AT_ONCE], ends[at : at + SHINGLES_AT_ONCE])],
            np.uint64,
        )
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint of every whole text as a signed long; a null text counts as empty."""
    kind = docs.schema[key].dataType.simpleString()

    def make():
        def step(batch):
            fps = [_signed(fingerprint(t.as_buffer().to_pybytes())) if t.is_valid else 0 for t in batch.column(1)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["key", "fp"])

        return step

    narrow = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    return in_batches(narrow, make, f"key {kind}, fp long")


def _rotated(fp, block: int):
    """The fingerprint with ``block`` in front."""
    turn = block * BLOCK_BITS
    return F.shiftleft(fp, turn).bitwiseOR(F.shiftrightunsigned(fp, 64 - turn)) if turn else fp


def _split(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Cut the subtree pairs in ``hot`` into pairs of subtrees ``STEP_BITS`` further down, within the budget.

    A row goes to every pair of its own next bits with others that keep the
    differing bits of the pair within the budget.
    """
    bits = F.col("depth") + F.lit(STEP_BITS)
    mine = F.call_function("shiftrightunsigned", F.col("turned"), F.lit(64) - bits)
    mine = mine.bitwiseAND(F.lit((1 << STEP_BITS) - 1).cast("long"))
    within = F.filter(
        F.sequence(F.lit(0), F.lit((1 << STEP_BITS) - 1)),
        lambda m: F.col("differ") + F.bit_count(m) <= BUDGET,
    )
    cut = (
        rows.join(hot, ["block", "a", "b"], "left_semi")
        .withColumn("mine", mine)
        .withColumn("mask", F.explode(within))
        .withColumn("other", F.col("mine").bitwiseXOR(F.col("mask").cast("long")))
    )
    # a pair of a node with itself holds each pair of children once
    alone = F.col("a") == F.col("b")
    left = F.when(alone, F.col("mine") <= F.col("other")).otherwise(F.col("side") == 0)
    own, far = F.col("mine"), F.col("other")

    def down(node, child):
        return F.shiftleft(node, STEP_BITS).bitwiseOR(child).cast("long")

    return cut.select(
        "block",
        down(F.col("a"), F.when(left, own).otherwise(far)).alias("a"),
        down(F.col("b"), F.when(left, far).otherwise(own)).alias("b"),
        F.when(left, 0).otherwise(1).alias("side"),
        bits.alias("depth"),
        (F.col("differ") + F.bit_count("mask")).cast("long").alias("differ"),
        "turned",
        "id",
    )


def _leaf_pairs(fp, lo_a, hi_a, lo_b, hi_b):
    """Index pairs of the ranges within the budget; ranges equal on both sides give each pair once."""
    size_b = hi_b - lo_b
    count = (hi_a - lo_a) * size_b
    place = np.repeat(np.arange(len(count)), count)
    inner = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
    i = lo_a[place] + inner // size_b[place]
    j = lo_b[place] + inner % size_b[place]
    keep = (np.bitwise_count(fp[i] ^ fp[j]) <= BUDGET) & ((lo_a[place] != lo_b[place]) | (i < j))
    return i[keep], j[keep]


def traverse(fp: np.ndarray, roots: list[tuple[np.ndarray, ...]], leaf: int = 64):
    """Yield index pairs within the budget below the given pairs of nodes.

    ``fp`` is sorted within every node. A root is (low, high, low, high, depth,
    differ) of arrays: the two ranges, the bits above and those that differ.
    """
    stack = list(roots)
    while stack:
        lo_a, hi_a, lo_b, hi_b, depth, differ = stack.pop()
        if len(lo_a) > PAIRS_AT_ONCE // leaf:
            half = len(lo_a) // 2
            whole = (lo_a, hi_a, lo_b, hi_b, depth, differ)
            stack += [tuple(x[:half] for x in whole), tuple(x[half:] for x in whole)]
            continue
        small = ((hi_a - lo_a) * (hi_b - lo_b) <= leaf) | (depth >= 64)
        if small.any():
            yield _leaf_pairs(fp, lo_a[small], hi_a[small], lo_b[small], hi_b[small])
        big = ~small
        if not big.any():
            continue
        lo_a, hi_a, lo_b, hi_b, depth, differ = (x[big] for x in (lo_a, hi_a, lo_b, hi_b, depth, differ))
        bit = np.uint64(1) << (63 - depth).astype(np.uint64)
        mid_a, mid_b = _middle(fp, lo_a, hi_a, bit), _middle(fp, lo_b, hi_b, bit)
        same = lo_a == lo_b
        children = []
        for x in (0, 1):
            for y in (0, 1):
                la, ha = (lo_a, mid_a) if x == 0 else (mid_a, hi_a)
                lb, hb = (lo_b, mid_b) if y == 0 else (mid_b, hi_b)
                far = differ + (x != y)
                keep = (la < ha) & (lb < hb) & (far <= BUDGET)
                if x > y:
                    keep &= ~same
                children.append((la[keep], ha[keep], lb[keep], hb[keep], depth[keep] + 1, far[keep]))
        stack.append(tuple(np.concatenate(x) for x in zip(*children, strict=True)))


def _middle(fp, low, high, bit):
    """First index of each sorted range whose fingerprint has the bit."""
    low, high = low.copy(), high.copy()
    while True:
        go = low < high
        if not go.any():
            return low
        mid = (low + high) // 2
        probe = np.where(go, mid, 0)
        has = (fp[probe] & bit) != 0
        high = np.where(go & has, mid, high)
        low = np.where(go & ~has, mid + 1, low)


def _joined(table: pa.Table):
    """Links found in whole groups of sorted rows, as stars of ids."""
    block, a, b, side = (table.column(x).to_numpy() for x in ("block", "a", "b", "side"))
    fp = table.column("turned").to_numpy().view(np.uint64)
    ids = table.column("id").to_numpy()
    depth, differ = table.column("depth").to_numpy().astype(np.int64), table.column("differ").to_numpy().astype(np.int64)
    new = np.r_[True, (block[1:] != block[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    low = np.flatnonzero(new)
    high = np.r_[low[1:], len(fp)]
    turn = low + np.add.reduceat((side == 0).astype(np.int64), low)
    alone = a[low] == b[low]
    root = (low, np.where(alone, high, turn), np.where(alone, low, turn), high, depth[low], differ[low])
    held = (root[0] < root[1]) & (root[2] < root[3])
    label = np.arange(len(fp))
    for i, j in traverse(fp, [tuple(x[held] for x in root)]):
        if len(i):
            top = local_stars(len(label), np.r_[i, np.arange(len(label))], np.r_[j, label])
            label = top
    # the label is an index; the smallest id of each label is the star's centre
    centre = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(centre, label, ids)
    centre = centre[label]
    out = centre != ids
    return pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(centre[out])], names=["u", "v"])


def _trie_join(batches):
    """Cut the sorted rows of a task at group borders and join each part."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < SUBTREE_ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        block, a, b = (table.column(x).to_numpy() for x in ("block", "a", "b"))
        last = np.flatnonzero((block != block[-1]) | (a != a[-1]) | (b != b[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield _joined(table.slice(0, cut))
        held, rows = table.slice(cut).to_batches(), table.num_rows - cut
    if rows:
        yield _joined(pa.Table.from_batches(held).combine_chunks())


def links(prints: DataFrame, subtree_rows: int = SUBTREE_ROWS) -> DataFrame:
    """(u, v) stars that join all ids whose fingerprints differ in at most ``BUDGET`` bits.

    ``prints`` holds distinct fingerprints: (fp, id).
    """
    turned = F.array(*[F.struct(F.lit(k).alias("block"), _rotated(F.col("fp"), k).alias("turned")) for k in range(BLOCKS)])
    node = F.shiftrightunsigned("x.turned", REST_BITS)
    rows = prints.select("id", F.explode(turned).alias("x")).select(
        F.col("x.block").alias("block"),
        node.alias("a"),
        node.alias("b"),
        F.lit(0).alias("side"),
        F.lit(BLOCK_BITS).alias("depth"),
        F.lit(0).cast("long").alias("differ"),
        F.col("x.turned").alias("turned"),
        "id",
    )
    parts = []
    while True:
        hot = rows.groupBy("block", "a", "b", "depth").count().where(f"count > {subtree_rows} and depth < 64")
        hot = checkpointed(hot.select("block", "a", "b"))
        if hot.isEmpty():
            break
        parts.append(rows.join(hot, ["block", "a", "b"], "left_anti"))
        rows = checkpointed(_split(rows, hot))
    for part in parts:
        rows = rows.unionByName(part)
    keys = ["block", "depth", "a", "b"]
    return (
        rows.repartition(*keys)
        .sortWithinPartitions(*keys, "side", F.expr("turned ^ bigint('-9223372036854775808')"))
        .mapInArrow(_trie_join, "u long, v long")
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, fingerprint (16 hex digits), component_id.

    Rows link when their fingerprints differ in at most three bits, whatever
    their texts; null and empty texts have fingerprint zero and link like any
    other. ``component_id`` is the smallest key reachable, the row's own
    included. Repeated rows stay repeated; a null key never becomes a component
    unless its whole component has null keys. Other columns are ignored. An
    empty table gives an empty result.
    """
    prints = checkpointed(with_fingerprints(docs, key, text))
    classes = prints.groupBy("fp").agg(F.min("key").alias("first"))
    classes = checkpointed(classes.withColumn("id", F.col("fp")))
    groups = components(links(classes.select("fp", "id")), "u", "v")
    of = (
        classes.join(groups, classes["id"] == groups["node"], "left")
        .select("fp", "first", F.coalesce("component", "fp").alias("root"))
    )
    roots = of.groupBy("root").agg(F.min("first").alias("component_id"))
    of = of.join(roots, "root").select("fp", "component_id")
    return prints.join(of, "fp").select(
        F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, see ``one_row_each``."""
    texts = docs.select(text_digest(F.col(text)).alias("id"), F.col(text).alias("text"))
    groups = near_duplicates(texts, "id", "text").select("id", F.col("component_id").alias("root")).distinct()
    return one_row_each(docs, groups, key, text)
