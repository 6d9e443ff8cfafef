"""Operator 1: byte-level BPE encoding and decoding.

Distinct pre-tokens of a batch are bucketed by length into padded numpy matrices of token ids. Each round, every row merges
its leftmost pair of least rank: ranks of pairs come from a hash table over (left id, right id), the merged column is
closed up, only the two pairs beside it are looked up again, and rows without a pair left are taken out. Ids of parts of
text are kept in a bounded cache for each worker, so a frequent word is merged once. There is no shuffle.

A bucket of words over LONG bytes is a matrix of one row, where a round merges every place of the least rank, from the left and
without overlaps. That is the same as long as no merge makes a pair of that rank or less; a round where one does is done again with
its leftmost place alone.

Defined results: null and empty texts have no ids and decode to nothing; very long texts and pre-tokens are taken whole, in memory
of some arrays of their length; of equal ranks in a word the leftmost goes first; rows that repeat are encoded each; a null doc_id is
kept; an empty table gives no rows; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import table, text_batches
from quillmark.llm.hashing import HashTable
from quillmark.llm.pieces import PartCache, claim, slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LONG = 256
_NONE = np.int32(2**31 - 1)


class Codec:
    """Encoder and decoder for a file of ranks (base64 token, blank, rank)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.split = regex.compile(pattern).findall
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        found = [(self.ranks[t[:i]] << 32 | self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.pairs = HashTable(np.array([k for k, _ in found], np.uint64), np.array([r for _, r in found], np.int32))
        self.parts = PartCache(self._encode_parts)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where it doesn't merge or a side is padding (-1)."""
        ok = (left >= 0) & (right >= 0)
        key = (left.astype(np.int64).clip(0) << 32 | right.astype(np.int64).clip(0)).astype(np.uint64)
        got = self.pairs.get(key.ravel()).reshape(key.shape)
        return np.where(ok & (got >= 0), got, _NONE).astype(np.int32)

    def merge_matrix(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of about equal length."""
        size = np.array([len(w) for w in words])
        width = int(size.max())
        ids = np.full((len(words), width), -1, np.int32)
        ids[np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        done: list[bytes] = [b""] * len(words)
        row = np.arange(len(words))
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        while len(row):
            j = rank.argmin(axis=1)
            all_rows = np.arange(len(row))
            least = rank[all_rows, j]
            ended = np.flatnonzero(least == _NONE)
            if len(ended):
                for r, line in zip(row[ended].tolist(), ids[ended]):
                    done[r] = line[line >= 0].astype("<u4").tobytes()
                go = np.flatnonzero(least != _NONE)
                ids, rank, row, j, least = ids[go], rank[go], row[go], j[go], least[go]
                if not len(row):
                    break
                used = int((ids >= 0).sum(axis=1).max())
                ids, rank = ids[:, :used], rank[:, : used - 1]
                all_rows = np.arange(len(row))
            ids[all_rows, j] = least
            width = ids.shape[1]
            if width == 2:
                ids, rank = ids[:, :1].copy(), np.full((len(row), 1), _NONE)
                continue
            col = np.arange(width - 1)
            ids = np.take_along_axis(ids, col + (col > j[:, None]), axis=1)  # the merged pair's right side goes
            last = np.arange(width - 2)
            rank = np.take_along_axis(rank, last + (last >= j[:, None]), axis=1)
            for at in (j - 1, j):
                ok = np.flatnonzero((at >= 0) & (at < width - 2))
                a = at[ok]
                rank[ok, a] = self._rank(ids[ok, a], ids[ok, a + 1])
        return done

    def merge_long(self, word: bytes) -> bytes:
        """Ids of one long word."""
        ids = self.byte[np.frombuffer(word, np.uint8)]
        rank = self._rank(ids[:-1], ids[1:])
        while len(rank) and (least := rank.min()) != _NONE:
            at = np.flatnonzero(rank == least)
            run = np.cumsum(np.concatenate([[True], np.diff(at) != 1]))  # of places side by side every second one overlaps the one before
            at = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0]
            merged, new, lowest = self._merged(ids, rank, at, least)
            if lowest <= least and len(at) > 1:
                merged, new, _ = self._merged(ids, rank, at[:1], least)
            ids, rank = merged, new
        return ids.astype("<u4").tobytes()

    def _merged(self, ids: np.ndarray, rank: np.ndarray, at: np.ndarray, token: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, ranks of pairs, least rank of a new pair) after the pairs at `at` became a token."""
        ids = ids.copy()
        ids[at] = token
        ids = np.delete(ids, at + 1)
        rank = np.delete(rank, at)
        near = at - np.arange(len(at))  # places of the merged ids
        near = np.unique(np.concatenate([near - 1, near]))
        near = near[(near >= 0) & (near < len(rank))]
        rank[near] = self._rank(ids[near], ids[near + 1])
        return ids, rank, rank[near].min(initial=_NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token: its own id if it is a token, else by merging."""
        out: list = [None] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            r = self.ranks.get(w)
            if r is not None:
                out[i] = r.to_bytes(4, "little")
            elif len(w) > LONG:
                out[i] = self.merge_long(w)
            else:
                buckets.setdefault((len(w) + 3) // 4, []).append(i)
        for b, at in buckets.items():
            step = max(1, 2_000_000 // (4 * b))
            for k in range(0, len(at), step):
                some = at[k:k + step]
                for i, x in zip(some, self.merge_matrix([words[i] for i in some])):
                    out[i] = x
        return out

    def _encode_parts(self, texts: list[str]) -> list[bytes]:
        cut = [self.split(t) for t in texts]
        words = list({w for ws in cut for w in ws})
        ids = dict(zip(words, self.merge([w.encode() for w in words])))
        return [b"".join(map(ids.__getitem__, ws)) for ws in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        return self.parts.encode(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def codec(path: str, pattern: str) -> Codec:
    """One for each worker."""
    return Codec(path, pattern)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian unsigned 32-bit integers, and the bytes that they decode to."""
    path = path or public_tokenizers.path(VOCABULARY)
    text_batches(docs.sparkSession)

    def run(batches):
        claim("bpe", codec.cache_clear)
        c = codec(path, pattern)
        for rows, texts in slices(batches):
            ids = c.encode(texts)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.binary())], names=["doc_id", "ids", "decoded"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents")).select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
