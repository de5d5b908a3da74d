import collections
import re

import numpy as np
import pytest

from leaguelens.llm import phrases
from leaguelens.llm.queries import ORACLE, QUERIES
from tests.llm.frames import SMALL, TEXTS, documents
from tests.oracle import compare, connect

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _brute(rows, least, top):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= 50 * found[q]}
        kept = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


ROWS = [
    *TEXTS,
    *[(k, f"New York City is big; new york city, isn't it? W{k % 7} of the\tof  the end\x0bof the", "en" if k % 2 else None) for k in range(40)],
    *[(k, "aé bé aé bé aé bé \U0001f600 \U0001f600  ", "el") for k in range(20)],
]


@pytest.mark.parametrize("trie_phrases", [phrases.TRIE_PHRASES, 3])
@pytest.mark.parametrize("top", [2000, 4])
def test_against_brute_force(spark, monkeypatch, trie_phrases, top):
    monkeypatch.setattr(phrases, "SLICE", 50)
    monkeypatch.setattr(phrases, "BLOCK", 7)
    rows = phrases.collocations(documents(spark, ROWS), least=10, top=top, trie_phrases=trie_phrases).collect()
    assert sorted(map(tuple, rows)) == _brute(ROWS, 10, top)


def test_streams_lose_no_phrase(monkeypatch):
    monkeypatch.setattr(phrases, "STREAM", 4)
    monkeypatch.setattr(phrases, "HELD_WORDS", 3)
    import pyarrow as pa

    texts = [b"a b c d e f g h i j k", b"", b"x y", b"a b. c d"]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array(texts, pa.binary())], names=["lang", "text"])
    code = {phrases.word_hash(w, phrases.lang_seed("en", 0)): k + 1 for k, w in enumerate(b"abcdefghijkxy".decode())}
    code = {phrases.word_hash(bytes([c]), phrases.lang_seed("en", 0)): c for c in b"abcdefghijkxy"}
    for length in (2, 3):
        got = collections.Counter()
        for codes, seen in phrases.streams([batch, batch], code.__getitem__, 0):
            for k in range(len(codes) - length + 1):
                part = bytes(codes[k : k + length].astype(np.uint8).tolist())
                if k + length > seen and 0 not in part:
                    got[part] += 1
        want = collections.Counter()
        for piece in [b"abcdefghijk", b"xy", b"ab", b"cd"] * 2:
            want.update(piece[k : k + length] for k in range(len(piece) - length + 1))
        assert got == want


def test_trie_holds_what_was_put_in():
    rng = np.random.default_rng(3)
    words = rng.integers(1, 1 << 63, 300, dtype=np.uint64)
    rows = {(a, b, 0) for a, b in zip(rng.choice(words, 900), rng.choice(words, 900), strict=True)}
    rows |= {(a, b, c) for (a, b, _), c in zip(sorted(rows), rng.choice(words, len(rows)), strict=True) if c % 3}
    h = [np.array(x, np.uint64) for x in zip(*sorted(rows), strict=True)]
    trie = phrases.Trie(*h)
    assert len(set(trie.state.tolist())) == len(rows)
    number = {int(w): k for k, w in enumerate(trie.words)}
    for a, b, c, state in zip(*h, trie.state, strict=True):
        at = 0
        for w in (a, b, c)[: 3 if c else 2]:
            for byte in number[int(w)].to_bytes(trie.width, "big"):
                to = int(trie.base[at]) + byte
                assert trie.check[to] == at
                at = to
        assert at == state


def test_filters_lose_nothing(spark):
    marks = spark.range(5000).selectExpr("xxhash64(id) as h")
    held = phrases.Filter(marks, marks["h"])
    hashes = np.array([r.h for r in marks.collect()], np.int64).view(np.uint64)
    assert held.holds(hashes).all() and all(held.holds_one(int(h)) for h in hashes[:100])
    assert held.holds(hashes ^ np.uint64(1 << 40)).mean() < 0.01


def test_shared_hashes_are_met_with_another_salt(spark, monkeypatch):
    plain = phrases.word_hash

    def clumsy(word, seed):
        return 7 if seed == phrases.lang_seed("en", 0) and word in (b"moon", b"sun") else plain(word, seed)

    texts = phrases._texts(documents(spark), "text", "lang")
    counts = [phrases._count_words(0), phrases._count_words(1)]
    monkeypatch.setattr(phrases, "_count_words", lambda salt: _clumsy_count(counts[salt], salt))
    words, salt = phrases.count_words(texts)
    assert salt == 1 and words.where("word = cast('moon' as binary)").first()["f"] == 3


def _clumsy_count(run, salt):
    def worse(batches):
        import pyarrow as pa

        for b in run(batches):
            h = pa.array([7] * b.num_rows, pa.int64()) if salt == 0 else b.column(2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), h, b.column(3)], names=["lang", "word", "h", "f"])

    return worse


def test_empty_table(spark):
    assert phrases.collocations(documents(spark).limit(0)).count() == 0


def test_query_against_sql(spark):
    assert compare(QUERIES["op12_phrases"](spark, SMALL), connect(SMALL), ORACLE["op12_phrases"]) == []
