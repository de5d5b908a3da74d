"""Document fingerprints by one-permutation MinHash.

Each shingle of five words is hashed once. The upper bits of the hash name a bin, and
each bin keeps its least hash. Empty bins take the value of the first filled bin in an
order of their own (optimal densification). The low-order bits of all bins, packed into
longs, are the fingerprint; equal bits of two fingerprints estimate the Jaccard
similarity of their shingles once chance agreement is taken off.

All of it is column expressions; no row leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 8  # kept of each bin
LANES = 64 // LOW_BITS
WORDS = BINS // LANES
TRIES = 4
LANE_ENDS = sum(1 << (LOW_BITS * k) for k in range(LANES))

CHUNK_ROWS = 500
CHUNKS = 4096
CHUNK_GROUPS = 64


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shift(kind: str, value: Column, bits: Column) -> Column:
    return F.call_function(kind, value, bits.cast("int"))


def _orders() -> tuple[list[int], list[int]]:
    """For each bin an odd step and a start: the order in which it asks other bins."""
    draw = np.random.default_rng(BINS)
    return (draw.integers(0, BINS // 2, BINS) * 2 + 1).tolist(), draw.integers(0, BINS, BINS).tolist()


def _constants(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def shingle_hashes(text: Column) -> Column:
    """A hash of each run of five words; fewer words are one shingle, none are no shingle."""
    words = F.array_remove(F.split(text, r"\s+"), "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        place = F.sequence(F.lit(0), F.greatest(F.size(h) - SHINGLE, F.lit(0)))
        each = F.transform(place, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))
        return F.when(F.size(h) > 0, each).otherwise(F.array().cast("array<bigint>"))

    return _let(hashes, runs)


def _bin(x: Column) -> Column:
    """The bin of a hash; bins ascend with signed hashes."""
    return F.shiftright(x, 64 - BIN_BITS).cast("int") + BINS // 2


def _pack(filled: Column) -> Column:
    def word(w: Column) -> Column:
        out = None
        for k in range(LANES):
            low = F.shiftleft(F.get(filled, w * LANES + k).bitwiseAND(F.lit((1 << LOW_BITS) - 1).cast("long")), LOW_BITS * k)
            out = low if out is None else out.bitwiseOR(low)
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), word)


def _densified(least: Column, low_half: Column, high_half: Column) -> Column:
    """The value of every bin, from the least hashes of the filled bins in ascending order."""
    half = BINS // 2
    step, start = _orders()
    steps, starts = _constants(step), _constants(start)
    undo = _constants([pow(a, -1, BINS) for a in step])
    one, mask = F.lit(1).cast("long"), F.lit(BINS - 1)

    def side(b: Column) -> Column:
        return F.when(b < half, low_half).otherwise(high_half)

    def has(b: Column) -> Column:
        return _shift("shiftrightunsigned", side(b), b.bitwiseAND(F.lit(half - 1))).bitwiseAND(one) == 1

    def value(b: Column) -> Column:
        above = _shift("shiftleft", -one, b.bitwiseAND(F.lit(half - 1)))
        below = F.bit_count(side(b).bitwiseAND(F.bitwise_not(above)))
        return F.get(least, below + F.when(b < half, 0).otherwise(F.bit_count(low_half)))

    def asked(b: Column, k: Column) -> Column:
        return (F.get(starts, b) + F.get(steps, b) * k).bitwiseAND(mask)

    def nearest(b: Column) -> Column:
        """The filled bin that ``b`` asks first."""
        turn = F.array_min(
            F.transform(least, lambda x: ((_bin(x) - F.get(starts, b) + BINS) * F.get(undo, b)).bitwiseAND(mask))
        )
        return asked(b, turn)

    def source(b: Column) -> Column:
        out = F.when(has(b), b)
        for k in range(TRIES):
            out = out.when(has(asked(b, F.lit(k))), asked(b, F.lit(k)))
        return out.otherwise(nearest(b))

    return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: _let(source(b), value))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the fingerprint of a text as longs; an empty array if it has no word.

    The steps are columns of their own, as later ones use them more than once.
    """
    none = F.array().cast("array<bigint>")
    df = df.withColumn("__sorted", F.sort_array(shingle_hashes(F.coalesce(F.col(text), F.lit("")))))
    before = lambda i: F.get("__sorted", i - 1)
    first = F.filter("__sorted", lambda x, i: (i == 0) | (_bin(x) != _bin(before(i))))
    df = df.withColumn("__least", first).drop("__sorted")

    def half(k: int) -> Column:
        def add(m: Column, x: Column) -> Column:
            bit = _shift("shiftleft", F.lit(1).cast("long"), _bin(x).bitwiseAND(F.lit(BINS // 2 - 1)))
            return F.when(F.shiftright(_bin(x), BIN_BITS - 1) == k, m.bitwiseOR(bit)).otherwise(m)

        return F.aggregate("__least", F.lit(0).cast("long"), add)

    df = df.withColumns({"__low": half(0), "__high": half(1)})
    least = F.col("__least")
    all_bins = F.when(F.size(least) == BINS, least).otherwise(_densified(least, F.col("__low"), F.col("__high")))
    df = df.withColumn("__filled", all_bins)
    packed = F.when(F.size("__least") > 0, _pack(F.col("__filled"))).otherwise(none)
    return df.withColumn(out, packed).drop("__least", "__low", "__high", "__filled")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, chance agreement taken off, 0 to 1."""

    def differing(x: Column, y: Column) -> Column:
        def folded(k: int) -> Callable[[Column], Column]:
            return lambda v: v.bitwiseOR(F.shiftrightunsigned(v, k))

        bits = x.bitwiseXOR(y)
        for k in (4, 2, 1):
            bits = _let(bits, folded(k))
        return F.bit_count(bits.bitwiseAND(F.lit(LANE_ENDS).cast("long")))

    apart = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-LOW_BITS
    share = (1 - apart / F.lit(float(BINS)) - chance) / (1 - chance)
    empty = (F.size(a) == 0).cast("int") + (F.size(b) == 0).cast("int")
    return F.when(empty == 2, 1.0).when(empty == 1, 0.0).otherwise(F.greatest(share, F.lit(0.0)))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(df: DataFrame, key: str, take: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``next_`` columns of the row with the next smaller key; after the last comes the first.

    Keys are cut into chunks at a bounded number of existing keys. The row at the head
    of a chunk is also sent to the chunk before it, so each chunk is numbered by itself.
    Equal keys are ordered by a hash of what is taken; null keys come last.
    """
    rows, top = df.agg(F.count(F.lit(1)), F.max(key)).first()
    chunks = int(max(1, min(CHUNKS, rows // chunk_rows)))
    shares = [k / chunks for k in range(1, chunks)]
    cuts = df.agg(F.percentile_approx(key, shares, 10 * CHUNKS)).first()[0] if shares and top is not None else []
    bounds = sorted({*(cuts or []), *([top] if top is not None else [])})
    groups = [bounds[k : k + CHUNK_GROUPS] for k in range(0, len(bounds), CHUNK_GROUPS)]
    kind = df.schema[key].dataType.simpleString()
    if not bounds:
        located = df.withColumn("__chunk", F.lit(0)).withColumn("__head", F.lit(False))
    else:
        ends = F.array(*[F.lit(g[-1]).cast(kind) for g in groups])
        inner = F.array(*[F.array(*[F.lit(x).cast(kind) for x in g]) for g in groups])
        below = lambda bounds: F.size(F.filter(bounds, lambda x: x < F.col(key)))
        located = df.withColumn("__group", F.when(F.col(key).isNull(), 0).otherwise(below(ends)))
        in_group = F.when(F.col(key).isNull(), 0).otherwise(below(F.get(inner, F.col("__group"))))
        located = located.withColumn("__in", in_group)
        head = F.coalesce(F.get(F.get(inner, F.col("__group")), F.col("__in")) == F.col(key), F.lit(False))
        located = located.withColumn("__chunk", F.col("__group") * CHUNK_GROUPS + F.col("__in")).withColumn("__head", head)
        located = located.drop("__group", "__in")
    last = len(bounds) - 1
    other = F.when(F.col("__chunk") == last, 0).otherwise(F.col("__chunk") + 1)
    own = F.struct(F.col("__chunk").alias("chunk"), F.lit(False).alias("ghost"))
    ghost = F.struct(other.alias("chunk"), F.lit(True).alias("ghost"))
    dealt = located.withColumn("__to", F.explode(F.when(F.col("__head"), F.array(own, ghost)).otherwise(F.array(own))))
    dealt = dealt.select(*df.columns, "__to.chunk", "__to.ghost")
    order = W.partitionBy("chunk").orderBy("ghost", F.desc_nulls_last(key), F.xxhash64(*take))
    out = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in take})
    return out.where(~F.col("ghost")).drop("chunk", "ghost")


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text counts as empty, and a document alone follows itself. A text without a
    word has the empty fingerprint, which is like itself only. Repeated rows stay
    repeated and have equal fingerprints. Other columns are ignored; an empty table
    gives an empty result.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(with_fingerprint(rows, "text", "print"), "key", ["text", "print"])
    size = F.length("text")
    cut = F.floor(size / 3).cast("int")
    following = F.coalesce("next_text", F.lit(""))
    edited = F.concat(F.substring("text", F.lit(1), size - cut), F.substring(following, F.lit(1), cut))
    rows = rows.withColumn("n_chars", size.cast("long")).withColumn("edited", edited).drop("text", "next_text")
    rows = with_fingerprint(rows, "edited", "edited_print")
    return rows.select(
        F.col("key").alias(key),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.coalesce("next_print", F.array().cast("array<bigint>"))).alias("near_next"),
    )
