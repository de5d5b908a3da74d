import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from leaguelens.llm import prefix_trie
from leaguelens.llm.queries import ORACLE, QUERIES
from tests.llm.frames import SMALL
from tests.oracle import compare, connect

SCHEMA = "conv_id long, turn long, role string, text string"


def _brute(rows, family=20, heads=4):
    conv = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            conv[c].append(((turn is not None, turn or 0), digest, role, text))
    conv = {c: [(role, text) for _, _, role, text in sorted(v)] for c, v in conv.items()}
    built = {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = conv.get(c - c % family, [])[:h] + own[h:]
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = {}
    for k in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        ends = ",".join(map(str, sorted(c for c in members[k] if len(built[c]) == len(k))))
        out[k] = (
            min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]),
            sum(out[x][5] for x in kids[k]) or 1, sum(out[x][6] for x in kids[k]) + (len(members[k]) - 1) * words,
            hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(map(repr, out.values()))


def _made(seed):
    rng = random.Random(seed)
    rows = [
        (c, t, rng.choice(["user", "bot", None]), rng.choice(["a b", "c", None, "x  y\tz"]))
        for c in range(60)
        for t in range(rng.randint(1, 6))
    ]
    # a null id, a null turn, repeated turns, a hot group of copies, one long conversation
    rows += [(None, 1, "a", "b"), (61, None, "user", "q"), (61, 1, "user", "q"), (61, 1, "user", "q")]
    rows += [(200 + c, t, "user", "copy") for c in range(40) for t in range(4)]
    return rows + [(300, t, "user", f"turn {t % 7} " * 3) for t in range(10)]


@pytest.mark.parametrize(("piece_turns", "parts"), [(prefix_trie.PIECE_TURNS, 11), (4, 5)])
def test_nodes_against_brute_force(spark, piece_turns, parts):
    rows = _made(piece_turns)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many borders
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        nodes = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), piece_turns=piece_turns).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(repr(tuple(r)) for r in nodes) == _brute(rows)


def test_extra_columns_and_empty_tables(spark):
    rows = _made(5)[:40]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = sorted(map(repr, prefix_trie.prefix_trie(df).collect()))
    clash = df.select("*", *[F.lit("c").alias(c) for c in ("pos", "digest", "words", "piece", "above", "part", "n", "first", "ending")])
    assert sorted(map(repr, prefix_trie.prefix_trie(clash).collect())) == plain
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0
    turnless = spark.createDataFrame([(62, 0, "user", "all of it is replaced")], SCHEMA)  # h is 1 and there is no 60
    (root,) = prefix_trie.prefix_trie(turnless).collect()
    assert (root.conv_id, root.depth, root.n_leaves, root.ends_sha256) == (62, 0, 1, hashlib.sha256(b"62").hexdigest())


def test_query_against_sql(spark):
    assert compare(QUERIES["op11_prefix_trie"](spark, SMALL), connect(SMALL), ORACLE["op11_prefix_trie"]) == []
