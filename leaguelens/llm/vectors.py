"""Near-duplicate vectors by randomised binary codes.

A random rotation turns every unit vector into one sign bit for each of its
dimensions (padded with zeros to make the code long enough). With the stored
product of a vector and its own code, the product of that code and another vector
gives an unbiased estimate of the cosine and a confidence bound. Only pairs whose
upper bound reaches the threshold are computed again, exactly and in double
precision; no link rests on an estimate.

Vectors are dealt to cells of the nearest of a bounded number of centres, and
probe the cells beyond borders that a near vector is likely to cross. Cells are
cut into blocks, and each task compares two blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaguelens.llm.common import components, in_batches, local_stars, send, spread_hash
from leaguelens.session import checkpointed

THRESHOLD = 0.95
CODE_BITS = 128
BOUND = 4.0  # standard deviations of an estimate that still count as possible
REACH = 3.5  # standard deviations within which a near vector is looked for across a border
SAMPLE_VALUES = 1 << 20  # numbers in the sample that places the centres
CENTRES = 2048
CELL_ROWS = 512
BLOCK_ROWS = 1024
LENGTHS = 64  # lengths of vectors that get cells of their own
ROUNDS = 4
CELLS_AT_ONCE = 1 << 20


def rotation(bits: int) -> np.ndarray:
    """A random rotation, the same in every task."""
    turn, upper = np.linalg.qr(np.random.default_rng(bits).standard_normal((bits, bits)))
    return (turn * np.sign(np.diag(upper))).astype(np.float32)


def code_bits(dims: int) -> int:
    return max(CODE_BITS, -(-dims // 8) * 8)


def encode(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated vectors, and each vector's product with its own code."""
    turned = units.astype(np.float32) @ turn[: units.shape[1]]
    factor = np.abs(turned).sum(1) / np.sqrt(np.float32(len(turn)))
    return np.packbits(turned > 0, axis=1), factor


def estimates(codes: np.ndarray, factor: np.ndarray, units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the cosines of the coded vectors (rows) and ``units`` (columns), and their error bounds."""
    signs = np.unpackbits(codes, axis=1)[:, : len(turn)].astype(np.float32) * 2 - 1
    turned = units.astype(np.float32) @ turn[: units.shape[1]]
    product = signs @ turned.T / np.sqrt(np.float32(len(turn)))
    error = BOUND * np.sqrt(np.maximum(0, 1 - factor**2) / (factor**2 * (len(turn) - 1)))
    return product / factor[:, None], error[:, None]


def near_pairs(left: dict, right: dict, turn: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose exact cosine reaches the threshold, among those that the bounds leave."""
    rows, cols = [], []
    step = max(1, CELLS_AT_ONCE // max(1, len(right["x"])))
    for at in range(0, len(left["x"]), step):
        part = slice(at, at + step)
        guess, error = estimates(left["code"][part], left["factor"][part], right["unit"], turn)
        i, j = np.nonzero(guess + error >= threshold)
        if not len(i):
            continue
        used_i, used_j = np.unique(i), np.unique(j)
        exact = left["x"][part][used_i] @ right["x"][used_j].T
        exact /= left["norm"][part][used_i][:, None] * right["norm"][used_j][None, :]
        true = exact[np.searchsorted(used_i, i), np.searchsorted(used_j, j)] >= threshold
        rows.append(i[true] + at)
        cols.append(j[true])
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (none, none)


def _centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres of ``count`` cells by a few rounds of spherical k-means."""
    centres = sample[np.random.default_rng(11).choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        nearest = np.concatenate([(sample[k : k + 4096] @ centres.T).argmax(1) for k in range(0, len(sample), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, nearest, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 0, total / np.where(size > 0, size, 1), centres)
    return centres.astype(np.float32)


def _units(flat: np.ndarray, dims: int) -> np.ndarray:
    x = flat.reshape(-1, dims).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _probes(unit: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The nearest cell of each vector, and the others that a vector at the threshold is likely to lie in."""
    product = unit.astype(np.float32) @ centres.T
    home = product.argmax(1)
    best = product[np.arange(len(unit)), home]
    between = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 1e-12))[home]
    reach = REACH * np.sqrt((2 - 2 * threshold) / unit.shape[1])
    near = (best[:, None] - product) / between <= reach
    near[np.arange(len(unit)), home] = False
    return home, [np.flatnonzero(row).astype(np.int32) for row in near]


def _assigned(vectors: DataFrame, fitted, threshold: float) -> DataFrame:
    """Each vector with its code, factor, home cell and probed cells."""

    def make():
        def step(batch):
            lists = batch.column(1)
            width = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            homes, probes = np.zeros(len(width), np.int32), [None] * len(width)
            codes, factors = [b""] * len(width), np.zeros(len(width))
            values, starts = lists.flatten().to_numpy(), np.cumsum(width) - width
            for dims in np.unique(width):
                rows = np.flatnonzero(width == dims)
                unit = _units(values[starts[rows][:, None] + np.arange(dims)], dims)
                code, factor = encode(unit, rotation(code_bits(dims)))
                centres = fitted.value.get(int(dims))
                home, probe = _probes(unit, centres, threshold) if centres is not None else (0, [()] * len(rows))
                homes[rows] = home
                factors[rows] = factor
                for k, row in enumerate(rows):
                    codes[row], probes[row] = code[k].tobytes(), probe[k]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0), lists, batch.column(2), pa.array(width, pa.int32()), pa.array(homes),
                    pa.array(probes, pa.list_(pa.int32())), pa.array(codes, pa.binary()), pa.array(factors, pa.float32()),
                ],
                names=["id", "x", "copies", "dims", "home", "probes", "code", "factor"],
            )

        return step

    schema = "id long, x array<double>, copies long, dims int, home int, probes array<int>, code binary, factor float"
    return in_batches(vectors.select("id", "x", "copies"), make, schema)


def _compare(threshold: float):
    """The links between the two sides of a block pair: sums by vector, and stars."""

    def run(table):
        side = table.column("side").to_numpy()
        dims = table.column("dims")[0].as_py()
        alone = table.column("bi")[0].as_py() == table.column("bj")[0].as_py() and not table.column("guest")[0].as_py()
        turn = rotation(code_bits(dims))
        ids, copies, home = (table.column(c).to_numpy() for c in ("id", "copies", "home"))
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        norm = np.linalg.norm(x, axis=1)
        code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        all_rows = {
            "x": x, "norm": norm, "unit": x / norm[:, None], "code": code, "factor": table.column("factor").to_numpy(),
        }
        left = np.flatnonzero(side == 0)
        right = left if alone else np.flatnonzero(side == 1)
        none = pa.table({"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "star": np.zeros(0, np.int64)})
        if not len(left) or not len(right):
            return none
        at = lambda rows: {k: v[rows] for k, v in all_rows.items()}
        i, j = near_pairs(at(left), at(right), turn, threshold)
        i, j = left[i], right[j]
        if alone:
            i, j = i[i < j], j[i < j]
        elif len(i) and table.column("guest")[0].as_py():
            # two vectors that probe each other's cells meet twice; the lower cell counts
            probes = table.column("probes").to_pylist()
            seen = {(int(r), int(h)) for r in np.unique(i) for h in probes[r]}
            low = np.minimum(home[i], home[j])
            twice = np.fromiter(((int(a), int(b)) in seen for a, b in zip(i, home[j])), bool, len(i))
            i, j = i[~twice | (home[i] == low)], j[~twice | (home[i] == low)]
        if not len(i):
            return none
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        label = local_stars(len(ids), i, j)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        used = np.flatnonzero(links)
        return pa.table({"id": ids[used], "links": links[used].astype(np.int64), "star": least[label[used]]})

    return run


def links(vectors: DataFrame, threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, links, star) parts: links of each vector counted in ``copies``, and stars that join linked vectors.

    ``vectors`` has distinct ids, no zero vector and no vector twice: (id, x, copies).
    """
    spark = vectors.sparkSession
    lengths = vectors.groupBy(F.size("x").alias("dims")).count().where("count > 1").orderBy(F.desc("count")).limit(LENGTHS)
    fitted = {}
    for dims, rows in lengths.collect():
        most = max(1, SAMPLE_VALUES // dims)
        part = vectors.where((F.size("x") == dims) & (spread_hash(F.col("id")) < min(1.0, most / rows))).select("id", "x")
        part = part.orderBy("id").limit(2 * most).select("x").toArrow().column("x").combine_chunks()
        if len(part):
            sample = _units(part.flatten().to_numpy(), dims).astype(np.float32)
            fitted[dims] = _centres(sample, min(CENTRES, max(1, rows // cell_rows)))
    cells = checkpointed(_assigned(vectors, send(spark, fitted), threshold))

    mine = cells.withColumn("cell", F.col("home")).withColumn("guest", F.lit(False))
    guests = cells.withColumn("cell", F.explode("probes")).withColumn("guest", F.lit(True))
    # cells and their sizes are as many as there are centres
    sizes = (
        cells.groupBy("dims", F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("hosts"))
        .join(guests.groupBy("dims", "cell").agg(F.count(F.lit(1)).alias("guests")), ["dims", "cell"], "left")
        .select(
            "dims", "cell",
            F.ceil(F.col("hosts") / block_rows).cast("int").alias("nb"),
            F.ceil(F.coalesce("guests", F.lit(0)) / block_rows).cast("int").alias("ng"),
        )
    )
    sizes = checkpointed(sizes)
    block = lambda n: F.pmod(F.xxhash64(F.lit("block"), "id"), n).cast("int")
    row = ["id", "x", "copies", "dims", "home", "probes", "code", "factor", "cell"]

    def pair(guest, bi, bj, side):
        return F.struct(
            F.lit(guest).alias("guest"), bi.cast("int").alias("bi"), bj.cast("int").alias("bj"), side.cast("int").alias("side")
        )

    own, upto = F.col("own"), lambda n: F.sequence(F.lit(0), n - 1)
    zero = F.lit(0)
    hosts = mine.join(sizes, ["dims", "cell"]).withColumn("own", block(F.col("nb"))).select(
        *row,
        F.explode(
            F.concat(
                F.transform(
                    upto(F.col("nb")),
                    lambda k: pair(False, F.least(own, k), F.greatest(own, k), F.when(own <= k, 0).otherwise(1)),
                ),
                F.when(F.col("ng") > 0, F.transform(upto(F.greatest("ng", F.lit(1))), lambda k: pair(True, own, k, zero)))
                .otherwise(F.array().cast("array<struct<guest:boolean,bi:int,bj:int,side:int>>")),
            )
        ).alias("p"),
    )
    visits = guests.join(sizes, ["dims", "cell"]).withColumn("own", block(F.col("ng"))).select(
        *row, F.explode(F.transform(upto(F.col("nb")), lambda k: pair(True, k, own, F.lit(1)))).alias("p")
    )
    both = hosts.unionByName(visits).select(*row, "p.guest", "p.bi", "p.bj", "p.side")
    return both.groupBy("dims", "cell", "guest", "bi", "bj").applyInArrow(_compare(threshold), "id long, links long, star long")


def near_duplicates(table: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``table``: key, n_links, component_id, kept.

    Two rows link when the cosine of their vectors, in double precision, is
    ``threshold`` or more. Vectors that are null, empty, zero, or hold a null or
    non-finite component, and vectors of different lengths, link with nothing.
    Equal vectors, and so repeated rows, link with each other and count each.
    ``component_id`` is the smallest key reachable; rows with a null key have
    themselves as component. Other columns are ignored; an empty table gives an
    empty result.
    """
    x = F.col(vector).cast("array<double>")
    norm = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    sound = (
        F.col(key).isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        & (norm > 0) & (norm < float("inf"))
    )
    rows = table.select(F.col(key).cast("long").alias("key"), F.when(F.coalesce(sound, F.lit(False)), x).alias("x"))
    rows = checkpointed(rows)
    distinct = rows.where("x is not null").groupBy("x").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"))
    # the same key may stand for several vectors, so vectors have ids of their own
    distinct = checkpointed(distinct.withColumn("id", F.monotonically_increasing_id()))
    parts = checkpointed(links(distinct.select("id", "x", "copies"), threshold))
    sums = parts.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(parts.select("id", "star").distinct(), "id", "star")
    of = (
        distinct.join(sums, "id", "left").join(groups, distinct["id"] == groups["node"], "left")
        .select("x", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("root"))
    )
    roots = of.groupBy("root").agg(F.min("first").alias("component_id"))
    of = of.join(roots, "root").select("x", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.join(of, "x", "left")
    component = F.coalesce("component_id", "key")
    return linked.select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"),
    )
