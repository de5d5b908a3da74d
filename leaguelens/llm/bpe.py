"""Byte-pair encoding and decoding by a pair occurrence index.

The distinct words of a part of a task's texts lie in one array of symbols. An index
maps each pair of neighbours to all its positions; the ranks that occur are applied
in ascending order, each to all its positions at once, and the pairs that a merge
creates are added to the index. The tokenizer file gives the normalisation, the word
borders, the vocabulary and the merges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leaguelens.llm.common import in_batches

# A part of a task's texts ends at either bound.
PIECES_AT_ONCE = 300_000
BYTES_AT_ONCE = 32 << 20
FEW = 24

# White space as Unicode defines it; str.split() also splits at four separators.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

# How byte-level tokens write bytes: printable ones as themselves, the others from U+0100 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LEVEL = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in PRINTABLE)}

SEPARATORS = re.compile("[\x1c-\x1f]")
BLANK = chr(BYTE_LEVEL[0x20])
ENDINGS = ".,;:!?"


def byte_level(word: str) -> str:
    """A word as byte-level tokens write it."""
    return word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LEVEL)


class Merges:
    """The vocabulary and the ranked merges of a tokenizer file."""

    def __init__(self, model: dict):
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        self.left = np.array([self.ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([self.ids[b] for _, b in pairs], np.int64)
        self.made = np.array([self.ids[a + b] for a, b in pairs], np.int32)
        self.size = max(self.ids.values()) + 1
        keys = self.left * self.size + self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        # A merge may make a pair of lower rank than its own; such ranks take one position of a word at a time.
        first = np.full(self.size, len(pairs))
        np.minimum.at(first, self.left, np.arange(len(pairs)))
        np.minimum.at(first, self.right, np.arange(len(pairs)))
        self.careful = first[self.made] < np.arange(len(pairs))
        single = {t: k for t, k in self.ids.items() if len(t.removesuffix(self.end) or t) == 1}
        high = 2 + max(ord(t[0]) for t in single)  # the last place stands for characters outside the vocabulary
        self.tables = np.full((2, high), -1, np.int32)
        for text, k in single.items():
            ends = bool(self.end) and len(text) > 1
            self.tables[int(ends), ord(text[0])] = k
        if not self.end:
            self.tables[1] = self.tables[0]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for none."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The characters of all words as ids, a word's last one with the end mark, and the number of each word.

        Characters outside the vocabulary are left out.
        """
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), size)
        plain, ending = self.tables
        codes = np.minimum(codes, len(plain) - 1)
        sym = plain[codes]
        last = np.cumsum(size)[size > 0] - 1
        sym[last] = ending[codes[last]]
        return sym[sym >= 0], word[sym >= 0]


def encode_words(words: list[str], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of the words one after the other, and each word's number of tokens."""
    sym, word = merges.symbols(words)
    nxt, prv = np.arange(1, len(sym) + 1, dtype=np.int32), np.arange(-1, len(sym) - 1, dtype=np.int32)
    border = np.flatnonzero(word[1:] != word[:-1])
    nxt[border] = -1
    nxt[-1:] = -1
    prv[border + 1] = -1

    # the index: positions of each rank
    at = np.flatnonzero(nxt >= 0)
    rank = merges.ranks(sym[at], sym[at + 1])
    at, rank = at[rank >= 0], rank[rank >= 0]
    order = np.argsort(rank, kind="stable")
    at, rank = at[order], rank[order]
    active, begin = np.unique(rank, return_index=True)
    index: dict[int, list] = {r: [p] for r, p in zip(active.tolist(), np.split(at, begin[1:]), strict=True)} if len(at) else {}
    heap = list(index)
    heapq.heapify(heap)

    def add(ranks: np.ndarray, places: np.ndarray) -> None:
        if len(ranks) > FEW:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            groups = zip(ranks[np.r_[0, cut]].tolist(), np.split(places, cut), strict=True)
        else:
            groups = zip(ranks.tolist(), places.tolist(), strict=True)
        for r, p in groups:
            if r in index:
                index[r].append(p)
            else:
                index[r] = [p]
                heapq.heappush(heap, r)

    while heap:
        r = heapq.heappop(heap)
        pos = np.hstack(index.pop(r))
        a, b = merges.left[r], merges.right[r]
        q = nxt[pos]
        good = (sym[pos] == a) & (q >= 0) & (sym[q] == b)
        pos = pos[good]
        if not len(pos):
            continue
        if a == b or merges.careful[r]:
            pos = np.unique(pos)
        if merges.careful[r]:  # the first of each word; the others come again
            head = np.r_[True, word[pos[1:]] != word[pos[:-1]]]
            rest, pos = pos[~head], pos[head]
            if len(rest):
                index[r] = [rest]
                heapq.heappush(heap, r)
        elif a == b:  # of a run of overlapping pairs, every other one
            head = np.r_[True, nxt[pos[:-1]] != pos[1:]]
            step = np.arange(len(pos)) - np.maximum.accumulate(np.where(head, np.arange(len(pos)), 0))
            pos = pos[step % 2 == 0]
        q = nxt[pos]
        sym[pos] = merges.made[r]
        sym[q] = -1
        after = nxt[q]
        nxt[pos] = after
        inner = after >= 0
        prv[after[inner]] = pos[inner]
        before = prv[pos]
        has = before >= 0
        places = np.concatenate([pos[inner], before[has]])
        if len(places):
            ranks = merges.ranks(sym[places], sym[nxt[places]])
            add(ranks[ranks >= 0], places[ranks >= 0])
    alive = sym >= 0
    return sym[alive], np.bincount(word[alive], minlength=len(words))


class Codec:
    """Encodes and decodes whole texts with the tokenizer of a file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.merges = Merges(spec["model"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.token = [""] * max(self.merges.size, 1 + max(self.special.values(), default=-1))
        for text, k in [*self.merges.ids.items(), *self.special.items()]:
            self.token[k] = text

    def words(self, piece: str) -> list[str | int]:
        """The words of a piece without white space as the tokenizer's own rules give them; special tokens as ids."""
        body, mark = (piece[:-1], piece[-1]) if piece[-1] in ENDINGS else (piece, "")
        # letters below U+0100 are their own normal form, are lowered one by one and make one word
        if body.isalpha() and (body.isascii() or max(body) < "\u0100"):
            word = byte_level(body.lower())
            return [word, mark] if mark else [word]
        out = []
        for part in self.cut.split(piece) if self.cut else [piece]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                norm = self.library.normalizer.normalize_str(part)
                out += [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)]
        return out

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the pieces one after the other, and each piece's number of tokens."""
        known = numbering()
        used, count = array("i"), array("i")
        for piece in pieces:
            words = self.words(piece)
            count.append(len(words))
            used.extend(map(known.__getitem__, words))
        tokens, size = encode_words([w if isinstance(w, str) else "" for w in known], self.merges)
        special = [(k, w) for k, w in enumerate(known) if isinstance(w, int)]
        if special:
            rows, ids = (np.array(x) for x in zip(*special, strict=True))
            tokens = np.insert(tokens, (np.cumsum(size) - size)[rows], ids)
            size[rows] = 1
        used, count = np.frombuffer(used, np.int32), np.frombuffer(count, np.int32)
        flat = gather(tokens, size, np.cumsum(size) - size, used)
        ends = np.r_[0, np.cumsum(size[used])][np.cumsum(count)]
        return flat, np.diff(ends, prepend=0)

    def decode(self, ids) -> str:
        """The tokens, special ones too, joined by blanks: this file has no decoder."""
        return " ".join([self.token[k] for k in ids])


def numbering() -> defaultdict:
    """A dictionary that numbers its keys as they come."""
    known = defaultdict()
    known.default_factory = known.__len__
    return known


def gather(flat: np.ndarray, size: np.ndarray, start: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The segments named by ``pick`` of an array cut into segments, one after the other."""
    length = size[pick]
    place = np.repeat(start[pick] - (np.cumsum(length) - length), length)
    return flat[place + np.arange(len(place))]


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


class Part:
    """Texts of a task whose distinct pieces are encoded together."""

    def __init__(self, coder: Codec):
        self.coder = coder
        self.known = numbering()
        self.texts: list[np.ndarray] = []
        self.keys: list[pa.Array] = []
        self.bytes = 0

    def add(self, keys: pa.Array, texts: list[str | None]) -> None:
        known = self.known
        for text in texts:
            text = text or ""
            pieces = text.split() if not SEPARATORS.search(text) else [p for p in SPACE.split(text) if p]
            self.texts.append(np.fromiter(map(known.__getitem__, pieces), np.int32, len(pieces)))
            self.bytes += len(text)
        self.keys.append(keys)

    @property
    def full(self) -> bool:
        return len(self.known) >= PIECES_AT_ONCE or self.bytes >= BYTES_AT_ONCE

    def encoded(self):
        """The ids of each text, and what they decode to."""
        tokens, size = self.coder.encode_pieces(list(self.known))
        tokens, ends = tokens.astype("<u4"), np.cumsum(size)
        start, all_ids = ends - size, tokens.tolist()
        said = [self.coder.decode(all_ids[a:b]) for a, b in zip(start.tolist(), ends.tolist(), strict=True)]
        for pieces in self.texts:
            text = " ".join(map(said.__getitem__, pieces.tolist()))
            yield gather(tokens, size, start, pieces), text


def _in_parts(path: str, row, fields: dict[str, pa.DataType]):
    """Encode a task's texts in parts of bounded size; ``row`` makes the values of ``fields`` from ids and decoded text."""

    def run(batches):
        coder = codec(path)
        part = Part(coder)

        def flush():
            keys = pa.concat_arrays(part.keys)
            columns = zip(*[row(ids, said) for ids, said in part.encoded()], strict=True)
            arrays = [pa.array(c, kind) for c, kind in zip(columns, fields.values(), strict=True)]
            return pa.RecordBatch.from_arrays([keys, *arrays], names=["key", *fields])

        for batch in batches:
            if batch.num_rows:
                part.add(batch.column(0), batch.column(1).to_pylist())
            if part.full:
                yield flush()
                part = Part(coder)
        if part.texts:
            yield flush()

    return run


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the token ids of every whole text, without added special tokens; a null text has none."""
    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(F.col(key), F.col(text))
    run = _in_parts(path, lambda ids, _: (ids.astype(np.int32).tolist(),), {"ids": pa.list_(pa.int32())})
    return narrow.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the text of every row's ids, special tokens included; null ids give an empty text."""
    kind = tokens.schema[key].dataType.simpleString()

    def make():
        coder = codec(path)

        def step(batch):
            said = [coder.decode(x or []) for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], names=[key, "text"])

        return step

    return in_batches(tokens.select(F.col(key), F.col(ids)), make, f"`{key}` {kind}, text string")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded.

    Null and empty texts have no tokens and decode to an empty text. Repeated rows
    are encoded once in a part and reported each. An empty table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    fields = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    run = _in_parts(path, lambda ids, said: (len(ids), sha(ids.tobytes()), sha(said.encode())), fields)
    narrow = docs.select(F.col(key), F.col(text))
    out = narrow.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)
