"""Collocations: phrases of two or three words that stick together, counted by double-array tries.

Words are named by 64-bit hashes that are checked to be free of collisions. Candidates are
screened level by level: only pairs of frequent words, and triples of two frequent pairs, are
looked at, each filter a bitmap of fixed size that may let too much through but never too little.
The candidates are cut into tries of at most ``TRIE_PHRASES`` phrases. Each trie is broadcast in
turn; numpy moves the states of all text positions on together, level by level, and counts the
accepting states they reach. Counts of all parts of the text are then summed.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leaguelens.llm.common import prepare, send
from leaguelens.session import checkpointed

LEAST = 10  # occurrences of a candidate
COVER = (50, 100)  # a phrase goes if a longer one makes up this share of it
TOP = 2000
TRIE_PHRASES = 4_000_000
BITS = 27  # of a filter: 16 MB
HELD_WORDS = 500_000  # distinct words that a task holds at once
STREAM = 1 << 21  # positions of a stream that are treated together
BLOCK = 1 << 16  # counts that are summed together
SLICE = 1 << 20  # bytes of a text that are split at once
BREAK = b";"
_TO_BREAK = bytes.maketrans(b".,:!?\n\x0b\x0c\r", BREAK * 9)
UNKNOWN = "und"


def words_of(text: bytes):
    """Lists of the words of a text, with ``BREAK`` between pieces; long texts come in several lists."""
    text = text.lower().translate(_TO_BREAK)
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):  # a slice ends where a word does
            ends = [x for x in (text.find(c, end) for c in (b" ", b"\t", BREAK)) if x >= 0]
            end = min(ends, default=len(text))
        yield text[at:end].replace(BREAK, b" ; ").split()
        at = end


class Codes(dict):
    """Words of one language and their codes, worked out once each and forgotten when there are too many."""

    def __init__(self, code, lang: str, salt: int):
        super().__init__()
        self.code, self.seed = code, lang_seed(lang, salt)

    def __missing__(self, word: bytes):
        value = 0 if word == BREAK else self.code(word_hash(word, self.seed))
        self[word] = value
        return value


def lang_seed(lang: str, salt: int) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), salt)


def word_hash(word: bytes, seed: int) -> int:
    """Never zero, which stands for a break."""
    return xxhash.xxh64_intdigest(word, seed) or 1


def streams(batches, code, salt: int):
    """Arrays of word codes of the texts of all batches, mixed languages in turn; zero between texts and pieces.

    Each array but the first of a language begins with the last two codes of the one before, so
    every phrase lies whole in one of them; (array, overlap) says how many codes were seen before.
    """
    held: dict[str, list] = {}
    sizes: Counter = Counter()
    tails: dict[str, np.ndarray] = {}
    codes: dict[str, Codes] = {}

    def flush(lang):
        new = np.concatenate(held.pop(lang))
        sizes.pop(lang)
        tail = tails.get(lang, np.empty(0, np.uint64))
        whole = np.concatenate([tail, new])
        tails[lang] = whole[-2:]
        return whole, len(tail)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            known = codes.get(lang)
            if known is None:
                known = codes[lang] = Codes(code, lang, salt)
            for words in words_of(text.as_buffer().to_pybytes()):
                held.setdefault(lang, []).append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
                sizes[lang] += len(words)
                if sizes[lang] >= STREAM:
                    yield flush(lang)
            held.setdefault(lang, []).append(np.zeros(1, np.uint64))
            sizes[lang] += 1
        if sum(map(len, codes.values())) > HELD_WORDS or len(codes) > 1000:
            for lang in list(held):
                yield flush(lang)
            codes.clear()
            tails.clear()  # every text ends with a break
    for lang in list(held):
        yield flush(lang)


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text")
    )


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _count_words(salt: int):
    def run(batches):
        counts: dict[str, Counter] = {}

        def out():
            for lang, found in counts.items():
                found.pop(BREAK, None)
                seed, words = lang_seed(lang, salt), list(found)
                hashes = np.fromiter((word_hash(w, seed) for w in words), np.uint64, len(words))
                for at in range(0, len(words), 4096):
                    part = words[at : at + 4096]
                    sums = pa.array([found[w] for w in part], pa.int64())
                    columns = [pa.array([lang] * len(part)), pa.array(part, pa.binary()), _signed(hashes[at : at + 4096]), sums]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "h", "f"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = counts.setdefault(lang, Counter())
                for words in words_of(text.as_buffer().to_pybytes()):
                    found.update(words)
            if sum(map(len, counts.values())) > HELD_WORDS:
                yield from out()
        yield from out()

    return run


def count_words(texts: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, h, f) of all words and the salt with which no two of them share a hash."""
    salt = 0
    while True:
        rows = texts.mapInArrow(_count_words(salt), "lang string, word binary, h long, f long")
        words = checkpointed(rows.groupBy("lang", "word", "h").agg(F.sum("f").alias("f")))
        if words.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
            return words, salt
        salt += 1


def _pair_mark(a, b):
    """One hash of two, in numpy; ``_pair_mark_sql`` is the same for columns."""
    return a ^ ((b << np.uint64(23)) | (b >> np.uint64(41)))


def _pair_mark_sql(a: str, b: str) -> Column:
    return F.col(a).bitwiseXOR(F.shiftleft(F.col(b), 23).bitwiseOR(F.shiftrightunsigned(F.col(b), 41)))


class Filter:
    """A bitmap of fixed size over hashes: whatever was put in is found, some of the rest too."""

    def __init__(self, marks: DataFrame, mark: Column):
        bit = F.shiftrightunsigned(mark, 64 - BITS)
        rows = marks.select(F.shiftright(bit, 15).alias("block"), bit.bitwiseAND(F.lit((1 << 15) - 1).cast("long")).alias("at"))
        found = rows.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
        self.bytes = np.zeros(1 << (BITS - 3), np.uint8)
        for r in found:
            self.bytes[r["block"] << 12 : (r["block"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes >> np.uint64(64 - BITS)
        return (self.bytes[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def holds_one(self, h: int) -> bool:
        bit = h >> (64 - BITS)
        return bool(self.bytes[bit >> 3] >> (bit & 7) & 1)


def _distinct(columns: list[np.ndarray]):
    """Distinct rows of several arrays and how often each occurs."""
    mark = columns[0].copy()
    for k, c in enumerate(columns[1:]):
        mark = mark * np.uint64(0x9E3779B97F4A7C15) + (c ^ (c >> np.uint64(29 + k)))
    order = np.argsort(mark)
    mark, columns = mark[order], [c[order] for c in columns]
    same = mark[1:] == mark[:-1]
    equal = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    if (same != equal).any():  # two rows share a mark: sort by the rows themselves
        order = np.lexsort(columns)
        columns = [c[order] for c in columns]
        equal = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    first = np.flatnonzero(np.r_[True, ~equal]) if len(mark) else np.empty(0, np.int64)
    return [c[first] for c in columns], np.diff(np.r_[first, len(mark)])


def _screen(words, pairs, salt: int):
    """Occurring pairs of frequent words, or triples of two frequent pairs where ``pairs`` is given, with their counts."""

    def run(batches):
        known = words.value

        def code(h):
            return h if known.holds_one(h) else 0

        for codes, seen in streams(batches, code, salt):
            if pairs is None:
                new = max(0, seen - 1)
                a, b = codes[new:-1], codes[new + 1 :]
                keep = (a != 0) & (b != 0)
                columns = [a[keep], b[keep]]
            else:
                a, b = codes[:-1], codes[1:]
                near = (a != 0) & (b != 0)
                near[near] = pairs.value.holds(_pair_mark(a[near], b[near]))
                at = np.flatnonzero(near[:-1] & near[1:])
                columns = [codes[at], codes[at + 1], codes[at + 2]]
            columns, counts = _distinct(columns)
            for at in range(0, len(counts), 1 << 16):
                rows = [_signed(c[at : at + (1 << 16)]) for c in columns] + [pa.array(counts[at : at + (1 << 16)], pa.int64())]
                yield pa.RecordBatch.from_arrays(rows, names=["h1", "h2", "h3", "f"][: len(columns)] + ["f"])

    return run


def candidates(texts: DataFrame, words: DataFrame, salt: int, least: int) -> DataFrame:
    """(h1, h2, h3): phrases that may be frequent, none that is left out; h3 is zero for pairs."""
    spark = texts.sparkSession
    frequent = send(spark, Filter(words.where(F.col("f") >= least), F.col("h")))
    found = texts.mapInArrow(_screen(frequent, None, salt), "h1 long, h2 long, f long")
    pairs = checkpointed(found.groupBy("h1", "h2").agg(F.sum("f").alias("f")).where(F.col("f") >= least).select("h1", "h2"))
    near = send(spark, Filter(pairs, _pair_mark_sql("h1", "h2")))
    found = texts.mapInArrow(_screen(frequent, near, salt), "h1 long, h2 long, h3 long, f long")
    triples = found.groupBy("h1", "h2", "h3").agg(F.sum("f").alias("f")).where(F.col("f") >= least).select("h1", "h2", "h3")
    return checkpointed(pairs.withColumn("h3", F.lit(0).cast("long")).unionByName(triples))


class Trie:
    """A double-array trie over the bytes of word numbers: from state s, byte c leads to t = base[s] + c if check[t] is s.

    Words are numbered by their sorted hashes from 0; a number has ``width`` bytes. State 0 is the root.
    """

    def __init__(self, h1: np.ndarray, h2: np.ndarray, h3: np.ndarray):
        self.words = np.unique(np.concatenate([h1, h2, h3[h3 != 0]]))
        self.width = max(1, -(-max(0, len(self.words) - 1).bit_length() // 8))
        numbers = [np.searchsorted(self.words, h).astype(np.int64) for h in (h1, h2, h3)]
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.check[0] = 0
        self.end = self.hint = 1  # places from ``end`` on are free
        self.size = 256  # of the families that look for room from ``hint``
        self.state = np.zeros(len(h1), np.int64)
        for level in range(3 * self.width):
            word, byte = divmod(level, self.width)
            live = np.flatnonzero(h3 != 0) if word == 2 else np.arange(len(h1))
            step = (numbers[word][live] >> (8 * (self.width - 1 - byte))) & 255
            nodes, which = np.unique(self.state[live] * 256 + step, return_inverse=True)
            self.state[live] = self._place(nodes >> 8, nodes & 255)[which]
        self.base, self.check = self.base[: self.end].astype(np.int32), self.check[: self.end].astype(np.int32)

    def _reserve(self, size: int):
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.r_[self.base, np.zeros(more, np.int64)]
            self.check = np.r_[self.check, np.full(more, -1, np.int64)]

    def _place(self, parents: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Places for (parent, step), sorted; families first, then only children into the gaps left."""
        places = np.empty(len(steps), np.int64)
        start = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]]) if len(parents) else np.empty(0, np.int64)
        count = np.diff(np.r_[start, len(parents)])
        many = np.flatnonzero(count > 1)
        self.size, self.hint = 256, 1
        for k in many[np.argsort(-count[many], kind="stable")].tolist():
            s, e = start[k], start[k] + count[k]
            offsets = steps[s:e] - steps[s]
            at = self._room(offsets)
            places[s:e] = at + offsets
            self.check[places[s:e]] = parents[s]
            self.base[parents[s]] = at - steps[s]
            self.end = max(self.end, at + int(offsets[-1]) + 1)
        single = start[count == 1]
        gaps = np.flatnonzero(self.check[: self.end] < 0)[: len(single)]
        self._reserve(self.end + len(single) + 512)
        at = np.r_[gaps, self.end + np.arange(len(single) - len(gaps))]
        places[single] = at
        self.check[at] = parents[single]
        self.base[parents[single]] = at - steps[single]
        self.end = max(self.end, int(at.max(initial=0)) + 1)
        return places

    def _room(self, offsets: np.ndarray) -> int:
        """A place from which all offsets are free: among the gaps, else behind all places."""
        self._reserve(self.end + 1024)
        if 2 * len(offsets) <= self.size:  # smaller families find room where larger ones did not
            self.size, self.hint = len(offsets), 1
        for _ in range(8):
            gaps = np.flatnonzero(self.check[self.hint : self.hint + 1024] < 0) + self.hint
            gaps = gaps[gaps < self.end][:256]
            if len(gaps):
                free = (self.check[gaps[:, None] + offsets] < 0).all(axis=1)
                if free.any():
                    return int(gaps[np.argmax(free)])
            if self.hint + 1024 >= self.end:
                break
            self.hint += 1024  # crowded: left to smaller ones
        return self.end

    def pack(self) -> dict:
        return {"words": self.words.tobytes(), "base": self.base.tobytes(), "check": self.check.tobytes()}


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    h1, h2, h3 = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2", "h3"))
    trie = Trie(h1, h2, h3)
    packed = {k: [v] for k, v in trie.pack().items()}
    states = np.rec.fromarrays([trie.state, h1, h2, h3])
    return pd.DataFrame({"trie": [key[0]], **packed, "states": [np.stack([trie.state.astype(np.uint64), h1, h2, h3]).tobytes()], "n": [len(states)]})


def _states(batches):
    for batch in batches:
        for number, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = np.frombuffer(packed, np.int64).reshape(4, -1)
            for at in range(0, rows.shape[1], 1 << 16):
                part = rows[:, at : at + (1 << 16)]
                columns = [pa.array(np.full(part.shape[1], number), pa.int32())] + [pa.array(np.ascontiguousarray(x)) for x in part]
                yield pa.RecordBatch.from_arrays(columns, names=["trie", "state", "h1", "h2", "h3"])


def _walk(sent, salt: int):
    """Count the accepting states that the positions of the texts reach."""

    def run(batches):
        words, base, check = (np.frombuffer(sent.value[k], t) for k, t in (("words", np.uint64), ("base", np.int32), ("check", np.int32)))
        counts = np.zeros(len(check), np.int64)

        def code(h):
            at = int(np.searchsorted(words, np.uint64(h)))
            return at + 1 if at < len(words) and int(words[at]) == h else 0

        width = max(1, -(-max(0, len(words) - 1).bit_length() // 8))
        for codes, seen in streams(batches, code, salt):
            numbers = codes.astype(np.int64) - 1
            at = np.flatnonzero(codes)
            state = np.zeros(len(at), np.int64)
            for level in range(3):
                inside = at + level < len(codes)
                at, state = at[inside], state[inside]
                inside = codes[at + level] != 0
                at, state = at[inside], state[inside]
                for byte in range(width):
                    to = base[state] + ((numbers[at + level] >> (8 * (width - 1 - byte))) & 255)
                    good = (to > 0) & (to < len(check))
                    good[good] = check[to[good]] == state[good]
                    at, state = at[good], to[good]
                if level:
                    new = state[at + level >= seen]  # those that end before were counted with the last array
                    counts += np.bincount(new, minlength=len(counts))
        for start in range(0, len(counts), BLOCK):
            part = counts[start : start + BLOCK]
            if part.any():
                packed = part.astype(np.uint32 if part.max() < 1 << 32 else np.int64).tobytes()
                columns = [pa.array([start], pa.int64()), pa.array([len(part)], pa.int32()), pa.array([packed], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "size", "counts"])

    return run


def _sums(batches):
    """(state, f) of the counts of all parts of the text, which come sorted by block; one block is held at a time."""
    current, total = None, None
    for batch in batches:
        for block, size, packed in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if block != current:
                if total is not None:
                    yield from _found(current, total)
                current, total = block, np.zeros(size, np.int64)
            total += np.frombuffer(packed, np.uint32 if len(packed) == 4 * size else np.int64)
    if total is not None:
        yield from _found(current, total)


def _found(block: int, total: np.ndarray):
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(block + at, pa.int64()), pa.array(total[at])], names=["state", "f"])


def count_phrases(texts: DataFrame, phrases: DataFrame, salt: int, trie_phrases: int = TRIE_PHRASES) -> DataFrame:
    """(h1, h2, h3, f): the occurrences of every candidate, counted by tries, one at a time."""
    total = phrases.count()
    tries = max(1, -(-total // trie_phrases))
    dealt = phrases.withColumn("trie", F.pmod(F.xxhash64("h1", "h2"), F.lit(tries)).cast("int"))
    built = dealt.groupBy("trie").applyInPandas(_build, "trie int, words binary, base binary, check binary, states binary, n long")
    built = checkpointed(built)
    states = built.select("trie", "states").mapInArrow(_states, "trie int, state long, h1 long, h2 long, h3 long")
    out = None
    for number in range(tries):
        packed = built.where(F.col("trie") == number).select("words", "base", "check").first()
        if packed is None:
            continue
        sent = send(texts.sparkSession, {k: bytes(v) for k, v in packed.asDict().items()})
        parts = texts.mapInArrow(_walk(sent, salt), "block long, size int, counts binary")
        counts = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_sums, "state long, f long")
        counts = checkpointed(counts)
        sent.unpersist()
        counts = counts.join(states.where(F.col("trie") == number), "state").select("h1", "h2", "h3", "f")
        out = counts if out is None else out.unionByName(counts)
    return checkpointed(out) if out is not None else phrases.withColumn("f", F.lit(0).cast("long"))


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), exact for counts below 10^14."""
    return F.expr(
        f"(cast(1000000 as decimal(7,0)) * (cast({a} as decimal(14,0)) * cast({a} as decimal(14,0))))"
        f" div (cast({left} as decimal(14,0)) * cast({right} as decimal(14,0)))"
    )


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int | None = TOP, trie_phrases: int = TRIE_PHRASES
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of each language that hold together most.

    Only A-Z are lowered. Phrases do not cross the characters ``.,;:!?`` and line ends, words are
    split at blanks and tabs. A phrase occurs ``least`` times or more; its score is that of its
    weakest cut. Phrases that a longer candidate mostly consists of are left out. Null texts have
    no words; a null language is ``und``. Ties go by occurrences, then by the phrase's bytes, so no
    two rows tie. Repeated rows count each time; other columns are not read; an empty table
    gives an empty result.
    """
    prepare(docs.sparkSession)
    texts = _texts(docs, text, lang)
    words, salt = count_words(texts)
    counts = count_phrases(texts, candidates(texts, words, salt, least), salt, trie_phrases).where(F.col("f") >= least)
    single = words.select("h", F.col("f").alias("w"))
    pairs = counts.where("h3 = 0").select("h1", "h2", F.col("f").alias("a"))
    triples = counts.where("h3 <> 0").select("h1", "h2", "h3", F.col("f").alias("a"))

    def word(k: int) -> DataFrame:
        return single.select(F.col("h").alias(f"h{k}"), F.col("w").alias(f"f{k}"))

    cut = F.struct(_score("a", "f1", "f2").alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("f2").alias("r"))
    two = pairs.join(word(1), "h1").join(word(2), "h2").withColumn("cut", cut)
    longer = [triples.select(F.col(x).alias("h1"), F.col(y).alias("h2"), "a") for x, y in (("h1", "h2"), ("h2", "h3"))]
    longer = longer[0].unionByName(longer[1]).groupBy("h1", "h2").agg(F.max("a").alias("longer"))
    part, whole = COVER
    two = two.join(longer, ["h1", "h2"], "left").where(F.col("longer").isNull() | (F.col("longer") * whole < F.col("a") * part))
    front = pairs.select("h1", "h2", F.col("a").alias("f12"))
    back = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("f23"))
    three = triples.join(word(1), "h1").join(word(3), "h3").join(front, ["h1", "h2"]).join(back, ["h2", "h3"])
    cuts = [
        F.struct(_score("a", x, y).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r"))
        for k, x, y in ((1, "f1", "f23"), (2, "f12", "f3"))
    ]
    three = three.withColumn("cut", F.least(*cuts))
    columns = ["h1", "h2", "h3", "a", "cut"]
    scored = two.withColumn("h3", F.lit(0).cast("long")).select(columns).unionByName(three.select(columns))
    for k in (1, 2, 3):
        named = words.select(F.col("h").alias(f"h{k}"), F.col("word").cast("string").alias(f"w{k}"), *([F.col("lang").alias("lang")] if k == 1 else []))
        scored = scored.join(named, f"h{k}", "left" if k == 3 else "inner")
    rows = scored.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
