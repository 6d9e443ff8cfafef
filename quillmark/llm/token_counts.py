"""Operator 8: token counts by a linear longest-match automaton.

The vocabulary's byte strings form a trie. Each node has a failure link and a popped-token count, both made once: where no
child goes on with the next byte, the tokens that greedy longest-first matching has surely completed are counted (popped)
and matching goes on at the failure node, so each byte is read once and no piece is ever built. The automaton steps all
distinct new words of a batch together, one byte column at a time, and word counts are kept in a bounded cache.

A word is a maximal run without white space (str.split()); it is matched with one blank before it, as byte-level
vocabularies mark a word's begin. Every single byte must be a token, so every word has a tokenisation.

Defined results: null, empty and white texts have 0 words and 0 tokens; very long texts and words are stepped like any other; of
tokens that match at a place the longest is taken, so there are no ties; repeated rows are counted each; a null doc_id is kept; an
empty table gives no rows; other columns are not read, so their names can't clash. There is no shuffle.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import table, text_batches
from quillmark.llm.hashing import HashTable
from quillmark.llm.pieces import claim, slices

VOCABULARY = "byte_bpe_50k.tiktoken"


class Automaton:
    """Trie with failure links f, popped counts and counts at the end of a word. Node 0 is the root."""

    LONGEST, MOST = 48, 300_000

    def __init__(self, tokens: list[bytes]):
        children: list[dict[int, int]] = [{}]
        is_token = [False]
        for t in tokens:
            at = 0
            for b in t:
                nxt = children[at].get(b)
                if nxt is None:
                    nxt = children[at][b] = len(children)
                    children.append({})
                    is_token.append(False)
                at = nxt
            is_token[at] = True
        if any(b not in children[0] or not is_token[children[0][b]] for b in range(256)):
            raise ValueError("every single byte must be a token")
        fail, pops = [0] * len(children), [0] * len(children)
        level = [0]
        while level:
            below = []
            for u in level:
                for b, v in children[u].items():
                    below.append(v)
                    if is_token[v]:
                        fail[v], pops[v] = 0, 1
                        continue
                    z, n = fail[u], pops[u]  # u isn't the root: its children are tokens
                    while b not in children[z]:
                        z, n = fail[z], n + pops[z]
                    fail[v], pops[v] = children[z][b], n
            level = below
        ends = [0] * len(children)
        for v in sorted(range(1, len(children)), key=self._depths(children).__getitem__):
            ends[v] = pops[v] + ends[fail[v]]
        self.fail, self.pops, self.ends = (np.array(x, np.int32) for x in (fail, pops, ends))
        self.step = HashTable(np.array([u << 8 | b for u, c in enumerate(children) for b in c], np.uint64), np.array([v for c in children for v in c.values()], np.int32))
        self.kept: dict[str, int] = {}

    @staticmethod
    def _depths(children) -> list[int]:
        depth = [0] * len(children)
        for u, c in enumerate(children):  # children have larger numbers than their parent
            for v in c.values():
                depth[v] = depth[u] + 1
        return depth

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word."""
        out = np.zeros(len(words), np.int64)
        size = np.array([len(w) for w in words])
        order = np.argsort(-size, kind="stable")
        begin = 0
        while begin < len(order):  # buckets of words of at least half the longest one's length
            width = int(size[order[begin]])
            if width == 0:
                break
            end = begin + int((size[order[begin:begin + max(1, 4_000_000 // width)]] * 2 > width).sum())
            at = order[begin:end]
            length = size[at]
            data = np.zeros((len(at), width), np.uint8)
            data[np.arange(width) < length[:, None]] = np.frombuffer(b"".join(words[i] for i in at), np.uint8)
            state, n = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
            live = len(at)
            for c in range(width):
                while length[live - 1] <= c:  # sorted by length: the shorter ones end first
                    live -= 1
                byte = data[:live, c].astype(np.uint64)
                nxt = self.step.get(state[:live].astype(np.uint64) << np.uint64(8) | byte)
                miss = np.flatnonzero(nxt < 0)
                while len(miss):
                    s = state[miss]
                    n[miss] += self.pops[s]
                    state[miss] = self.fail[s]
                    nxt[miss] = self.step.get(state[miss].astype(np.uint64) << np.uint64(8) | byte[miss])
                    miss = miss[nxt[miss] < 0]
                state[:live] = nxt
            out[at] = n + self.ends[state]
            begin = end
        return out

    def count(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Words and tokens of each text."""
        if len(self.kept) > self.MOST:
            self.kept.clear()
        cut = [t.split() for t in texts]
        new = list({w for ws in cut for w in ws if w not in self.kept})
        self.kept.update(zip(new, self.lengths([b" " + w.encode() for w in new]).tolist()))
        got = [sum(map(self.kept.__getitem__, ws)) for ws in cut]
        for w in new:
            if len(w) > self.LONGEST:
                del self.kept[w]
        return [len(ws) for ws in cut], got


@cache
def automaton(path: str) -> Automaton:
    with open(path, "rb") as f:
        return Automaton([base64.b64decode(a) for a, _ in map(bytes.split, f)])


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens): one row per input row."""
    path = path or public_tokenizers.path(VOCABULARY)
    text_batches(docs.sparkSession)

    def run(batches):
        claim("token_counts", automaton.cache_clear)
        a = automaton(path)
        for rows, texts in slices(batches):
            words, tokens = a.count(texts)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
