"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

Texts are split by the tokenizer's pattern and their distinct words (the pattern's matches) are found in bounded
blocks of text. Each distinct word becomes one row: its bytes, each as the id of its byte, and the ranks of the merges that
can occur in it (tokens among its parts), ascending. A fold (``aggregate``) in the JVM applies them in that order by the
literal rank map, which gives the pair that a rank merges and the token it makes. Ids are written as characters of three
bytes, so that a merge is one replacement in a string. The texts' ids follow from their words' ids. Decoding
concatenates the binary pieces of the ids.

Why ascending ranks suffice: in a sound vocabulary the bytes of every token, merged alone, end as that token, by ever higher
ranks. What happens between two borders that no merge crosses doesn't depend on what stands outside, so a pair of a
rank below the last merge's can't arise, and a token is made from one pair only. ``Ranks`` checks each token and refuses
a vocabulary that isn't sound.

Blocks are formed within input partitions, so nothing is shuffled, no word can be hot and memory is bounded by a block.

Defined cases: a null or empty text has no ids; invalid or unusual characters are bytes like any; repeated rows are
rows of their own; extra columns are ignored. Words of any length are folded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm._shared import documents_of, lean, slices

#: Code points of text in a block, whose distinct words are merged once, and words and bytes of a row batch to the fold.
BLOCK_CHARS, BATCH_WORDS, BATCH_BYTES = 4_000_000, 10_000, 1 << 18
#: Characters of three UTF-8 bytes, but surrogates: the first one, and how many there are.
FIRST, SURROGATES, MOST_IDS = 0x800, (0xD800, 0xE000), 0x10000 - 0x800 - 0x800
#: Slots for each edge of the trie.
ROOM = 4
NAMES = ["block", "word", "merges", "doc_id", "codes"]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[bytes, ...]:
    """Bytes of each id, by rank."""
    with open(path, "rb") as f:
        rows = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, filter(bytes.strip, f)))
    if [r for r, _ in rows] != list(range(len(rows))) or len(rows) > MOST_IDS:
        raise ValueError(f"ranks must be 0, 1, 2, ... and at most {MOST_IDS}")
    return tuple(b for _, b in rows)


def last_pair(token: bytes, of: dict[bytes, int]) -> tuple[int, int] | None:
    """The two ids whose merge makes the token, when its bytes are merged by ever higher ranks; None if they don't end as the token."""
    parts, before = [token[i : i + 1] for i in range(len(token))], -1
    while len(parts) > 2:
        rank, i = min((of.get(parts[i] + parts[i + 1], len(of)), i) for i in range(len(parts) - 1))
        if rank == len(of) or rank < before:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        before = rank
    return (of[parts[0]], of[parts[1]]) if of[token] > before else None


def chars(ids: np.ndarray) -> np.ndarray:
    """(n, 3) bytes: each id as a character."""
    c = ids.astype(np.int64) + FIRST
    c += (c >= SURROGATES[0]) * (SURROGATES[1] - SURROGATES[0])
    return np.stack([0xE0 | c >> 12, 0x80 | c >> 6 & 63, 0x80 | c & 63], 1).astype(np.uint8)


def ids_of(data: np.ndarray) -> np.ndarray:
    """The ids of such characters."""
    b = data.reshape(-1, 3).astype(np.int32)
    c = (b[:, 0] & 15) << 12 | (b[:, 1] & 63) << 6 | b[:, 2] & 63
    c -= FIRST
    c[c >= SURROGATES[1] - FIRST] -= SURROGATES[1] - SURROGATES[0]
    return c


class Trie:
    """The vocabulary's bytes by row displacement: a node's children lie in ``slots`` from ``shift[node]``, each with its parent."""

    def __init__(self, vocab: tuple[bytes, ...]):
        children: list[dict[int, int]] = [{}]
        rank = [-1]
        for r, t in enumerate(vocab):
            at = 0
            for b in t:
                to = children[at].get(b)
                if to is None:
                    to = children[at][b] = len(children)
                    children.append({})
                    rank.append(-1)
                at = to
            rank[at] = r
        rng = np.random.default_rng(5)
        self.rank, self.shift = np.array(rank, np.int32), np.zeros(len(children), np.int32)
        self.parent, self.child = (np.full(ROOM * len(children) + 256, -1, np.int32) for _ in range(2))
        for node in sorted(range(len(children)), key=lambda i: -len(children[i])):
            keys = np.array(sorted(children[node]), np.int64)
            while len(keys):
                shift = int(rng.integers(ROOM * len(children)))
                if (self.parent[shift + keys] < 0).all():
                    self.shift[node], self.parent[shift + keys] = shift, node
                    self.child[shift + keys] = [children[node][k] for k in keys.tolist()]
                    break

    def parts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """word << 16 | rank of the tokens of two bytes or more within each word, ascending and distinct. ``ends``: offsets of the words."""
        word = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        at, stop = np.arange(len(data)), ends[1:][word]
        node, found = np.zeros(len(data), np.int32), []
        length = 0
        while len(at):
            slot = self.shift[node] + data[at + length]
            there = self.parent[slot] == node
            at, node = at[there], self.child[slot[there]]
            length += 1
            token = self.rank[node]
            if length > 1:
                hit = token >= 0
                found.append(word[at[hit]] << 16 | token[hit])
            more = at + length < stop[at]
            at, node = at[more], node[more]
        if not found:
            return np.zeros(0, np.int64)
        out = np.sort(np.concatenate(found))
        return out[np.r_[True, out[1:] != out[:-1]]] if len(out) else out


class Ranks:
    """The vocabulary as literal columns and as the trie that finds a word's merges."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        of = {b: i for i, b in enumerate(self.vocab)}
        if len(of) != len(self.vocab) or any(bytes([b]) not in of for b in range(256)):
            raise ValueError("tokens must be distinct, and each byte must be one")
        self.byte_ids = np.array([of[bytes([b])] for b in range(256)], np.int64)
        pairs = [last_pair(t, of) if len(t) > 1 else (i, i) for i, t in enumerate(self.vocab)]
        if None in pairs:
            raise ValueError(f"rank {pairs.index(None)} can't be made by ever higher ranks")
        self.pairs = np.array(pairs, np.int64)

    def merged(self, word: Column, merges: Column) -> Column:
        """The word's characters after its merges, given those of its bytes: the lowest rank first, from left to right."""
        ids = np.arange(len(self.vocab))
        pair, token = _strings(np.concatenate([chars(self.pairs[:, 0]), chars(self.pairs[:, 1])], 1)), _strings(chars(ids))
        return F.aggregate(merges, word, lambda s, r: F.replace(s, F.get(pair, r), F.get(token, r)))


def _strings(data: np.ndarray) -> Column:
    """A literal array, one string for each row of bytes: the optimizer folds the split."""
    return F.split(F.lit(",".join(bytes(x).decode() for x in data)), ",")


def _blocks(pattern: str, byte_ids: np.ndarray, trie: Trie):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, known = regex.compile(pattern).findall, {}
        docs: list[tuple[int, bytes]] = []
        size, block, char_of = 0, 0, chars(byte_ids)

        def words(texts: list[bytes]) -> pa.RecordBatch:
            data = np.frombuffer(b"".join(texts), np.uint8)
            ends = np.zeros(len(texts) + 1, np.int64)
            np.cumsum([len(t) for t in texts], out=ends[1:])
            parts = trie.parts(data, ends)
            per = np.searchsorted(parts, np.arange(len(texts) + 1) << 16).astype(np.int32)
            merges = pa.ListArray.from_arrays(pa.array(per), pa.array((parts & 0xFFFF).astype(np.int32)))
            word = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(3 * ends), pa.py_buffer(char_of[data].tobytes()))
            n = len(texts)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), word.cast(pa.string()), merges, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=NAMES)

        def out() -> Iterator[pa.RecordBatch]:
            part, held = [], 0
            for w in known:
                part.append(w.encode())
                held += len(part[-1])
                if len(part) >= BATCH_WORDS or held >= BATCH_BYTES:
                    yield words(part)
                    part, held = [], 0
            if part:
                yield words(part)
            known.clear()
            for a in range(0, len(docs), 1000):
                some = docs[a : a + 1000]
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(pa.int32())), pa.array([d for d, _ in some], pa.int64()), pa.array([c for _, c in some], pa.binary())], names=NAMES)
            docs.clear()

        for batch in slices(batches):
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                pieces = find(text or "")
                for p in pieces:
                    if p not in known:
                        known[p] = len(known)
                docs.append((doc, np.fromiter(map(known.__getitem__, pieces), np.int32, len(pieces)).tobytes()))
                size += len(text or "")
                if size >= BLOCK_CHARS:
                    yield from out()
                    size, block = 0, block + 1
        if docs:
            yield from out()

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of the texts from the characters of their block's words; the words of a block come before its texts."""
    block, flat, sizes = -1, [], []
    ids = start = length = None
    for batch in batches:
        blocks, is_doc = batch["block"].to_numpy(), batch["codes"].is_valid().to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (is_doc[1:] != is_doc[:-1]), True])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if blocks[a] != block:
                block, flat, sizes, ids = blocks[a], [], [], None
            part = batch.slice(a, b - a)
            if not is_doc[a]:
                col = part["merged"].cast(pa.large_string())
                offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
                flat.append(ids_of(np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]]))
                sizes.append(np.diff(offs) // 3)
                continue
            if ids is None:
                ids = np.concatenate(flat) if flat else np.zeros(0, np.int32)
                length = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
                start = np.cumsum(length) - length
                flat, sizes = [], []
            for c in range(0, part.num_rows, 200):
                some = part.slice(c, 200)
                each = [np.frombuffer(x, np.int32) for x in some["codes"].to_pylist()]
                codes = np.concatenate(each)
                n = length[codes]
                ends = np.cumsum(n)
                out = ids[np.repeat(start[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
                per_doc = np.r_[0, ends][np.r_[0, np.cumsum([len(x) for x in each])]].astype(np.int32)
                yield pa.RecordBatch.from_arrays([some["doc_id"], pa.ListArray.from_arrays(pa.array(per_doc), pa.array(out))], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int> of every whole text."""
    ranks = Ranks(path)
    rows = documents_of(docs).mapInArrow(lean(_blocks(pattern, ranks.byte_ids, Trie(ranks.vocab))), "block long, word string, merges array<int>, doc_id long, codes binary")
    rows = rows.select("block", "doc_id", "codes", ranks.merged(F.col("word"), F.col("merges")).alias("merged"))
    return rows.mapInArrow(lean(_texts), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds decoded (binary): the pieces of the ids, joined. In hexadecimal while joining, as Spark joins strings only."""
    pieces = F.split(F.lit(",".join(b.hex() for b in vocabulary(path))), ",")
    return encoded.withColumn("decoded", F.unhex(F.array_join(F.transform("ids", lambda i: F.get(pieces, i)), "")))


def digest(decoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
