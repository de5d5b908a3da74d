"""Near copies: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from the SimHash trie join over five-word shingles and, since three bits
find only about half of the pairs at 0.8, from ``BANDS`` keys, each a hash of ``ROWS``
MinHash values. Texts that share a key are candidates, and candidates are linked only by
an exact comparison of their shingles. Two texts at similarity s share no key with
probability (1 - s^4)^24: 3e-6 at 0.8, less above.

A group is first joined by stars: every text is compared with the least of its fingerprint
and of some of its keys. What is left are keys that hold several groups. There, blocks of texts are
compared inside tasks, first by their MinHash values, which rule out what is surely less
alike, then exactly; the texts of a crowd bring their shingles once per pair of blocks.
Tasks give stars, so no pair is ever a row.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaguelens.llm import simhash
from leaguelens.llm.common import components, in_batches, local_stars, one_row_each, text_digest
from leaguelens.session import checkpointed

WORDS = 5
SIMILAR = (4, 5)  # linked if the share of common shingles is 4/5 or more
BANDS = 24
ROWS = 4
CENTRE_BANDS = (1, 4)
SHINGLES_AT_ONCE = 4096
BLOCK_ROWS = 512  # texts of a crowd that are compared with as many others at once
BLOCK_SHINGLES = 1 << 19
# the share of equal MinHash values of a pair at 0.8 is hardly ever 4.5 standard deviations less
LIKELY = 0.8 - 4.5 * (0.8 * 0.2 / (BANDS * ROWS)) ** 0.5
CHUNK_ROWS = 20_000

_random = np.random.default_rng(5)
FACTORS = _random.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
TERMS = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, lowered and split as in ``simhash``.

    A text of fewer words than a shingle has its whole sequence as the only one.
    """
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(parts) - words + 1].tolist()
    hash64 = xxhash.xxh64_intdigest
    hashes = (hash64(line[s:e], 42) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True))
    return np.unique(np.fromiter(hashes, np.uint64, len(starts)))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The MinHash values of a set of shingles; all empty sets have the same."""
    low = hashes.astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), SHINGLES_AT_ONCE):
        mixed = low[at : at + SHINGLES_AT_ONCE, None] * FACTORS + TERMS
        np.minimum(least, mixed.min(axis=0), out=least)
    return least


def bands(least: np.ndarray) -> list[int]:
    """The keys of the MinHash values of a set."""
    keys = [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of shingles, as a signed long."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have the similarity of near copies; two empty ones are alike."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    part, whole = SIMILAR
    return common * whole >= (len(a) + len(b) - common) * part


def _texts(batch: pa.RecordBatch):
    return [t.as_buffer().to_pybytes() for t in batch.column(1)]


def _with_bands(texts: DataFrame) -> DataFrame:
    """(id, n, fp, keys, sig) of (id, text): distinct shingles, SimHash, keys of the bands, low bits of the MinHash values."""

    def make():
        def step(batch):
            sets = [shingles(t) for t in _texts(batch)]
            least = [minima(x) for x in sets]
            columns = [
                batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(map(fingerprint, sets), pa.int64()),
                pa.array(map(bands, least), pa.list_(pa.int64())), pa.array([x.astype(np.uint16).tobytes() for x in least], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["id", "n", "fp", "keys", "sig"])

        return step

    return in_batches(texts, make, "id binary, n long, fp long, keys array<long>, sig binary")


def _with_shingles(texts: DataFrame) -> DataFrame:
    def make():
        def step(batch):
            held = pa.array([shingles(t).tobytes() for t in _texts(batch)], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column(0), held], names=["id", "held"])

        return step

    return in_batches(texts, make, "id binary, held binary")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose shingles are similar."""

    def make():
        def step(batch):
            a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3))
            keep = pa.array(list(map(similar, a, b)), pa.bool_())
            return batch.select(["u", "v"]).filter(keep)

        return step

    held = pairs.join(sets.select(F.col("id").alias("u"), F.col("held").alias("a")), "u")
    held = held.join(sets.select(F.col("id").alias("v"), F.col("held").alias("b")), "v")
    return in_batches(held.select("u", "v", "a", "b"), make, "u binary, v binary")


def _sizes_allow(a: str, b: str) -> Column:
    """Sets of more different sizes than this cannot be similar."""
    return F.least(a, b) * SIMILAR[1] >= F.greatest(a, b) * SIMILAR[0]


def _to_centres(rows: DataFrame, upto: int) -> DataFrame:
    """Pairs of each text with the least text of its keys in the first bands, unless in one group."""
    rows = rows.where(F.col("band") < upto)
    centres = rows.groupBy("key").agg(F.min(F.struct("id", "n", "label")).alias("c"))
    apart = rows.join(centres, "key").where((F.col("label") != F.col("c.label")) & _sizes_allow("n", "c.n"))
    return apart.select(F.col("c.id").alias("u"), F.col("id").alias("v")).distinct()


def _by_fingerprint(marked: DataFrame) -> DataFrame:
    """Pairs of each text with the least of its fingerprint, and of the least texts of fingerprints that the trie join links."""
    classes = checkpointed(marked.groupBy("fp").agg(F.min("id").alias("first")))
    same = marked.join(classes, "fp").where("id <> first").select(F.col("first").alias("u"), F.col("id").alias("v"))
    near = simhash.links(classes.select("fp", F.col("fp").alias("id")))
    left, right = (classes.select(F.col("fp").alias(c), F.col("first").alias(f"t{c}")) for c in ("u", "v"))
    near = near.join(left, "u").join(right, "v").select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v"))
    return same.unionByName(near).distinct()


def _block_pairs(rows: DataFrame, group: str) -> DataFrame:
    """Each row once for every pair of blocks of its group that its own is in: bi, bj, side.

    Rows of one label need no comparison among themselves. Those of the group's largest label
    have blocks of their own, which only meet the blocks of the others.
    """
    per = rows.groupBy(group, "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    top = F.struct("c", "label")
    sizes = per.groupBy(group).agg(
        F.max_by("label", top).alias("main"), F.max("c").alias("cm"), F.sum("c").alias("ca"), F.max_by("w", top).alias("wm"), F.sum("w").alias("wa")
    )

    def blocks(count, weight):
        return F.greatest(F.ceil(count / BLOCK_ROWS), F.ceil(weight / BLOCK_SHINGLES)).cast("int")

    sizes = sizes.where("ca > cm").select(
        group, "main", blocks(F.col("cm"), F.col("wm")).alias("nm"), blocks(F.col("ca") - F.col("cm"), F.col("wa") - F.col("wm")).alias("no")
    )
    place, largest = F.xxhash64(F.lit("block"), "id"), F.col("label") == F.col("main")
    own = F.when(largest, F.col("no") + F.pmod(place, F.col("nm"))).otherwise(F.pmod(place, F.col("no"))).cast("int")
    upto = F.when(largest, F.col("no")).otherwise(F.col("no") + F.col("nm"))
    dealt = rows.join(sizes, group).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), upto - 1)))
    return dealt.select(
        *rows.columns, F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), (F.col("own") > F.col("other")).cast("int").alias("side")
    )


def _grouped(rows: DataFrame, group: str, compare) -> DataFrame:
    """Stars (u, v) that ``compare`` finds in each pair of blocks: (side, id, label, n, sig, held) to places i, j."""

    def part(table: pa.Table):
        names = table.column(0).to_numpy(zero_copy_only=False) if table.schema[0].type != pa.binary() else np.array(table.column(0).to_pylist(), object)
        bi, bj, side = (table.column(c).to_numpy() for c in ("bi", "bj", "side"))
        ids = table.column("id").to_pylist()
        known = {x: k for k, x in enumerate(sorted(set(table.column("label").to_pylist())))}
        label = np.array([known[x] for x in table.column("label").to_pylist()])
        n = table.column("n").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(ids), -1)
        held = table.column("held") if "held" in table.column_names else None
        new = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
        us, vs = [], []
        for low, high in zip(new.tolist(), [*new[1:].tolist(), len(ids)], strict=True):
            turn = low + int((side[low:high] == 0).sum())
            left, right = np.arange(low, turn), np.arange(low if bi[low] == bj[low] else turn, high)
            if not len(left) or not len(right) or (label[low:high] == label[low]).all():
                continue
            i, j = compare(left, right, label, n, sig, held)
            if len(i):
                star = local_stars(high - low, i - low, j - low)
                least = {}
                for k in range(high - low):
                    c = int(star[k])
                    least[c] = min(least.get(c, ids[low + k]), ids[low + k])
                for k in range(high - low):
                    centre = least[int(star[k])]
                    if centre != ids[low + k]:
                        us.append(centre)
                        vs.append(ids[low + k])
        return pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])

    def run(batches):
        kept, size = [], 0
        for batch in batches:
            kept.append(batch)
            size += batch.num_rows
            if size < CHUNK_ROWS and sum(b.nbytes for b in kept) < 64 << 20:
                continue
            table = pa.Table.from_batches(kept).combine_chunks()
            last = table.select([0, table.column_names.index("bi"), table.column_names.index("bj")]).slice(size - 1).to_pylist()[0]
            same = np.ones(size, bool)
            for c, value in last.items():
                same &= np.array([x == value for x in table.column(c).to_pylist()])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield part(table.slice(0, cut))
            kept, size = table.slice(cut).to_batches(), size - cut
        if size:
            yield part(pa.Table.from_batches(kept).combine_chunks())

    order = [group, "bi", "bj"]
    columns = [group, "bi", "bj", "side", *[c for c in rows.columns if c not in (group, "bi", "bj", "side")]]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*columns).repartition(parts, *order).sortWithinPartitions(*order, "side")
    return dealt.mapInArrow(run, "u binary, v binary")


def _likely(left, right, label, n, sig, held=None):
    """Places of pairs in different groups whose sizes and MinHash values allow a near copy."""
    part, whole = SIMILAR
    out_i, out_j = [], []
    for at in range(0, len(left), 64):
        x = left[at : at + 64]
        a, b = n[x][:, None], n[right][None, :]
        good = (label[x][:, None] != label[right][None, :]) & (np.minimum(a, b) * whole >= np.maximum(a, b) * part)
        i, j = np.nonzero(good)
        for start in range(0, len(i), 1 << 17):
            p, q = x[i[start : start + (1 << 17)]], right[j[start : start + (1 << 17)]]
            near = (sig[p] == sig[q]).mean(axis=1) >= LIKELY
            out_i.append(p[near])
            out_j.append(q[near])
    i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_i, out_j))
    return i, j


def _exactly(left, right, label, n, sig, held):
    """Of the likely pairs those whose shingles are similar."""
    i, j = _likely(left, right, label, n, sig)
    if not len(i):
        return i, j
    rows = np.unique(np.r_[left, right])
    sets = [np.frombuffer(x, np.uint64) for x in held.take(pa.array(rows)).to_pylist()]
    size = np.array([len(x) for x in sets])
    place = np.repeat(np.arange(len(rows)), size)
    shingle, which = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(which, kind="stable")
    owner = place[order]  # the texts of each shingle, one list after the other
    start = np.r_[0, np.cumsum(np.bincount(which, minlength=len(shingle)))]
    first = np.r_[0, np.cumsum(size)]
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    near = np.zeros(len(i), bool)
    part, whole = SIMILAR
    cuts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(i)], strict=True):
        k = int(np.searchsorted(rows, i[low]))
        mine = which[first[k] : first[k + 1]]
        counts = start[mine + 1] - start[mine]
        lists = np.repeat(start[mine] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(int(counts.sum())) if len(mine) else np.empty(0, np.int64)
        common = np.bincount(owner[lists], minlength=len(rows))
        other = np.searchsorted(rows, j[low:high])
        both = common[other]
        near[low:high] = both * whole >= (size[k] + size[other] - both) * part
    return i[near], j[near]


def _across(rows: DataFrame, about: DataFrame, sets: DataFrame) -> DataFrame:
    """Stars of the links between texts that share a key but are in different groups yet: rows of (key, id, label)."""
    mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    open_rows = rows.join(mixed, "key", "left_semi").join(about, "id").select("key", "id", "label", "n", "sig")
    likely = checkpointed(_grouped(_block_pairs(open_rows, "key"), "key", _likely))
    if likely.isEmpty():
        return likely
    crowd = components(likely, "u", "v").select(F.col("node").alias("id"), F.col("component").alias("crowd"))
    texts = crowd.join(rows.select("id", "label").distinct(), "id").join(about, "id")
    texts = checkpointed(texts.select("crowd", "id", "label", "n", "sig"))
    dealt = _block_pairs(texts, "crowd").join(sets, "id")
    return checkpointed(_grouped(dealt, "crowd", _exactly))


def groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, root) of every distinct text that has near copies: the digest of the text and of its group's least.

    Groups are connected by links; a null text counts as empty.
    """
    texts = docs.select(text_digest(F.col(text)).alias("id"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))
    marked = _with_bands(texts).groupBy("id").agg(*[F.first(c).alias(c) for c in ("n", "fp", "keys", "sig")])
    marked = checkpointed(marked)
    rows = marked.select("id", "n", F.posexplode("keys").alias("band", "key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    rows = checkpointed(rows.join(shared, "key", "left_semi"))
    start = checkpointed(_by_fingerprint(marked))
    wanted = rows.select("id").union(start.select("u")).union(start.select("v")).distinct()
    once = texts.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
    sets = checkpointed(_with_shingles(once))
    about = marked.select("id", "n", "sig")
    found, tried, joined = [], [], None
    for pairs in (start, *CENTRE_BANDS, None):
        labelled = rows.withColumn("label", F.col("id"))
        if joined is not None:
            labelled = rows.join(joined, "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root")
        if pairs is None:
            new = _across(checkpointed(labelled.select("key", "id", "label")), about, sets)
        else:
            if pairs is not start:
                pairs = _to_centres(labelled, pairs)
                pairs = checkpointed(pairs.join(reduce(DataFrame.union, tried), ["u", "v"], "left_anti"))
            tried.append(pairs)
            new = checkpointed(_alike(pairs, sets))
        if new.isEmpty():
            continue
        found.append(new)
        joined = components(reduce(DataFrame.union, found), "u", "v").select(F.col("node").alias("id"), F.col("component").alias("root"))
    return joined if joined is not None else rows.select("id", F.col("id").alias("root")).limit(0)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies, see ``one_row_each``; a text without near copies is a group of its own."""
    return one_row_each(docs, groups(docs, text), key, text)
