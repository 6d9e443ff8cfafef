"""Operator 6: removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a LENGTH-byte string that covers it also starts in a document with a smaller doc_id. Sorting every suffix would
move fifty times the input, so the sort takes a sparse set of suffixes that loses no match: those that begin at anchors.
A position is an anchor if its K-byte string has the least hash of any LENGTH-byte window around it; equal windows
have their anchors at equal places, so every repeated window is seen from an anchor within its first LENGTH - K bytes.

1. Documents are gathered in chunks of about CHUNK bytes (compressed rows, cut into the shared folder).
2. Of each chunk the hashes of anchors' K-byte strings, with the least and greatest doc_id, go sorted and
   delta-coded to hash buckets. A bucket tells each chunk which of its hashes are held by two documents at least.
3. Only those anchors' suffixes are sorted: a key is LENGTH bytes from the anchor and then, reversed, the LENGTH - K
   bytes before it. Equal keys of a chunk are combined (all but the least doc_id are covered by it, which needs no
   exchange). The sorted runs are front-coded (length of the prefix shared with the key before, and the rest), cut at range
   splitters and exchanged.
   A range of more than SHARE bytes of text is split by the anchors' hashes: equal K bytes stay together, and each part of a
   sorted run is sorted. So neither the number of tasks nor a task's share is bounded by the splitters.
4. Each range merges its runs with a loser tree over (key, known common prefix with the last winner): keys whose known
   prefixes differ are ordered by these alone, others are compared from the known prefix on. The merge yields the
   common-prefix lengths of neighbours, and from them, for each of the LENGTH - K + 1 windows around an anchor, the
   groups of equal windows and their least doc_id. A key's answer is one bit per window.
5. Chunks turn the bits into covered bytes.

Splitters come from a bounded sample (about SAMPLE strings of K bytes reach the driver); they only place the cuts.

Defined results: null and empty texts have 0 bytes and nothing removed; texts under LENGTH bytes lose nothing; very long
texts are handled in blocks; rows that repeat a doc_id never remove from each other, but lose what a smaller doc_id has; a
null doc_id counts as the greatest; ties can't arise, as only a smaller doc_id takes bytes away; an empty table gives no rows; other
columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from quillmark.llm.common import cut, rested, table, text_batches, text_bytes
from quillmark.llm.pieces import claim, release

LENGTH, K = 50, 20
LEFT = LENGTH - K
WIDTH = LENGTH + LEFT
CHUNK = 2 << 20
BLOCK = 1 << 17
#: Bytes of text for each hash bucket and each range of suffixes.
SHARE = 8 << 20
#: Positions drawn for splitters, and most splitters; ranges are split by hashes beyond.
SAMPLE, SPLITTERS = 100_000, 10_000
LAST = 2**63 - 1
_TABLE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64, endpoint=False)
_BASE = 0xD1B54A32D192ED03
_UP = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(BLOCK + 4 * LENGTH, np.uint64(_BASE))]))
_DOWN = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(BLOCK + 4 * LENGTH, np.uint64(pow(_BASE, -1, 2**64)))]))


def _squeeze(x: np.ndarray) -> bytes:
    """A compressed array: bytes of equal weight together."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _swell(b: bytes, kind) -> np.ndarray:
    d = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    w = np.dtype(kind).itemsize
    return np.ascontiguousarray(d.reshape(w, len(d) // w).T).view(kind).ravel()


# 1: chunks

def _chunks(docs: DataFrame, rate: float) -> DataFrame:
    """(chunk_id, data, sample): packed rows, and some K-byte strings."""

    def run(batches):
        claim("suffix")
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0
        rng = np.random.default_rng(part)

        def pack():
            nonlocal made, held, size
            rows = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as w:
                w.write_table(rows)
            data, _ = _bytes(rows)
            draw = rng.binomial(max(0, len(data) - K), min(1.0, rate)) if len(data) > K else 0
            at = rng.integers(0, max(1, len(data) - K), draw)
            row = pa.RecordBatch.from_arrays([pa.array([part << 32 | made], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([b"".join(data[i:i + K].tobytes() for i in at)], pa.binary())], names=["chunk_id", "data", "sample"])
            made, held, size = made + 1, [], 0
            return row

        for batch in batches:
            n = batch.column("text").fill_null("").cast(pa.large_binary())
            ends = np.frombuffer(n.buffers()[1], np.int64)[n.offset:n.offset + len(n) + 1]
            a = 0
            while a < len(n):  # rows up to the chunk's size, one at least
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK - size, side="right")) - 1)
                b = min(b, len(n))
                held.append(batch.slice(a, b - a))
                size += int(ends[b] - ends[a])
                a = b
                if size >= CHUNK * 3 // 4:
                    yield pack()
        if held:
            yield pack()
        release()

    return docs.mapInArrow(run, "chunk_id long, data binary, sample binary")


def _rows(data: pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def _bytes(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, and where each begins (with the end)."""
    text = rows.column("text").combine_chunks() if isinstance(rows.column("text"), pa.ChunkedArray) else rows.column("text")
    if isinstance(text, pa.ChunkedArray):
        text = text.chunk(0) if text.num_chunks else pa.array([], pa.string())
    text = text.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None and len(text.buffers()[2]) else np.zeros(0, np.uint8)
    return data[ends[0]:ends[-1]], ends - ends[0]


def _ids(rows: pa.Table) -> np.ndarray:
    return rows.column("doc_id").combine_chunks().cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


# 2: anchors

def _slide(a: np.ndarray, w: int, f) -> np.ndarray:
    """f over each w neighbours."""
    s = 1
    while 2 * s <= w:
        a = f(a[:-s], a[s:])
        s *= 2
    return f(a[: len(a) - (w - s)], a[w - s:]) if w > s else a


def anchors(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes of their K bytes) of all anchors; windows lie inside one document."""
    n, w = len(data), LEFT + 1
    at, hashes = [], []
    for a in range(0, max(0, n - LENGTH + 1) + LEFT, BLOCK):
        b = min(a + BLOCK, n - K + 1)
        if b <= a:
            break
        lo, hi = max(0, a - LEFT), min(n - K + 1, b + LEFT)  # hashes that any window around the block holds
        x = data[lo: hi + K - 1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[x] * _UP[: len(x)], dtype=np.uint64)])
        h = (sums[K:] - sums[:-K]) * _DOWN[: len(x) - K + 1]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(29))
        if len(h) < w:
            continue
        least = _slide(h, w, np.minimum)  # of the windows that begin at lo, lo + 1 ...
        j = np.arange(lo, lo + len(least))
        whole = start[np.searchsorted(start, j, side="right")] >= j + LENGTH if len(start) < 64 else _inside(start, lo, len(least))
        least = np.where(whole, least, np.uint64(0))
        pad = np.zeros(w - 1, np.uint64)
        best = _slide(np.concatenate([pad, least, pad]), w, np.maximum)[: len(h)]
        hit = np.flatnonzero((best == h) & (best > 0))
        hit = hit[(hit + lo >= a) & (hit + lo < b)]
        at.append(hit + lo)
        hashes.append(h[hit])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(at), np.concatenate(hashes)


def _inside(start: np.ndarray, lo: int, n: int) -> np.ndarray:
    """Whether the windows at lo ... lo + n - 1 end inside their document."""
    out = np.ones(n, bool)
    for e in start[np.searchsorted(start, lo, side="right"): np.searchsorted(start, lo + n + LENGTH, side="right")].tolist():
        out[max(0, e - LENGTH + 1 - lo): max(0, e - lo)] = False
    return out


def _shared(chunks: DataFrame, buckets: int) -> DataFrame:
    """(chunk_id, bucket, hashes): the lower halves of a chunk's hashes that two documents have at least."""

    def send(batches):
        for batch in batches:
            for chunk, data in zip(batch.column("chunk_id").to_pylist(), batch.column("data")):
                rows = _rows(data.as_buffer())
                text, start = _bytes(rows)
                at, h = anchors(text, start)
                if not len(at):
                    continue
                doc = _ids(rows)[np.searchsorted(start, at, side="right") - 1]
                bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                low = h.astype(np.uint32)
                order = np.argsort(bucket << 32 | low.astype(np.int64), kind="stable")
                bucket, low, doc = bucket[order], low[order], doc[order]
                first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1])]))
                least, most = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
                bucket, low = bucket[first], low[first]
                edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                out = [(int(bucket[x]), _squeeze(np.diff(low[x:y], prepend=np.uint32(0))), _squeeze(least[x:y]), _squeeze(most[x:y] - least[x:y])) for x, y in zip(edge[:-1], edge[1:])]
                b, l, d, m = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array([chunk] * len(b), pa.int64()), pa.array(l, pa.binary()), pa.array(d, pa.binary()), pa.array(m, pa.binary())], names=["bucket", "chunk_id", "low", "least", "more"])
        release()

    def answer(key, part):
        lows = [np.cumsum(_swell(b, np.uint32), dtype=np.uint32) for b in part["low"]]
        low = np.concatenate(lows)
        least = np.concatenate([_swell(b, np.int64) for b in part["least"]])
        most = least + np.concatenate([_swell(b, np.int64) for b in part["more"]])
        order = np.argsort(low, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], low[order][1:] != low[order][:-1]]))
        two = np.minimum.reduceat(least[order], first) != np.maximum.reduceat(most[order], first)
        held = np.empty(len(low), bool)
        held[order] = np.repeat(two, np.diff(np.append(first, len(low))))
        out, at = [], 0
        for chunk, l in zip(part["chunk_id"], lows):
            mine = l[held[at: at + len(l)]]
            at += len(l)
            if len(mine):
                out.append((chunk, key[0], _squeeze(np.diff(mine, prepend=np.uint32(0)))))
        release()
        return pd.DataFrame(out, columns=["chunk_id", "bucket", "hashes"])

    sent = chunks.select("chunk_id", "data").mapInArrow(send, "bucket int, chunk_id long, low binary, least binary, more binary")
    return sent.groupBy("bucket").applyInPandas(answer, "chunk_id long, bucket int, hashes binary")


# 3: runs

def _keys(data: np.ndarray, start: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key bytes, right length, left length) for anchors at `at`; beyond the document's ends keys are zero."""
    doc = np.searchsorted(start, at, side="right") - 1
    right = np.minimum(start[doc + 1] - at, LENGTH).astype(np.uint8)
    left = np.minimum(at - start[doc], LEFT).astype(np.uint8)
    col = np.concatenate([np.arange(LENGTH), -1 - np.arange(LEFT)])
    keys = np.empty((len(at), WIDTH), np.uint8)
    for a in range(0, len(at), 10_000):  # the matrix of places is eight times as large as the keys
        b = a + 10_000
        keys[a:b] = data[np.clip(at[a:b, None] + col, 0, len(data) - 1)]
    keys[:, :LENGTH][np.arange(LENGTH, dtype=np.uint8) >= right[:, None]] = 0
    keys[:, LENGTH:][np.arange(LEFT, dtype=np.uint8) >= left[:, None]] = 0
    return keys, right, left


def _sorted(keys: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Order of the rows of a byte matrix, then by the other columns."""
    pad = -keys.shape[1] % 8
    words = np.ascontiguousarray(np.pad(keys, ((0, 0), (0, pad)))).view(">u8").astype(np.uint64)
    return np.lexsort((*more[::-1], *words.T[::-1]))


def _common(keys: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the row before; 0 for the first."""
    out = np.zeros(len(keys), np.uint8)
    if len(keys) > 1:
        differ = keys[1:] != keys[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), keys.shape[1])
    return out


def _runs(chunks: DataFrame, shared: DataFrame, buckets: int, splitters: list[bytes], parts: int = 1) -> DataFrame:
    """(range, chunk_id, run): front-coded runs, each range in so many parts; a negative range holds what a chunk knows by itself."""
    ranges = (len(splitters) + 1) * parts
    heard = shared.groupBy("chunk_id").agg(F.collect_list(F.struct("bucket", "hashes")).alias("heard"))  # one row per bucket at most
    joined = chunks.select("chunk_id", "data").join(heard, "chunk_id")

    def send(batches):
        edges = np.frombuffer(b"".join(splitters), f"S{K}") if splitters else np.zeros(0, f"S{K}")
        for batch in batches:
            for chunk, data, heard in zip(batch.column("chunk_id").to_pylist(), batch.column("data"), batch.column("heard")):
                rows, heard = _rows(data.as_buffer()), heard.as_py()
                text, start = _bytes(rows)
                at, h = anchors(text, start)
                bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                known = np.sort(np.concatenate([np.int64(x["bucket"]) << 32 | np.cumsum(_swell(x["hashes"], np.uint32), dtype=np.uint32).astype(np.int64) for x in heard]))
                mine = bucket << 32 | h.astype(np.uint32).astype(np.int64)
                place = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                at, h = at[known[place] == mine], h[known[place] == mine]
                if not len(at):
                    continue
                keys, right, left = _keys(text, start, at)
                doc = _ids(rows)[np.searchsorted(start, at, side="right") - 1]
                part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                order = _sorted(keys, right, left, doc, at)
                keys, right, left, doc, at, part = keys[order], right[order], left[order], doc[order], at[order], part[order]
                new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1) | (right[1:] != right[:-1]) | (left[1:] != left[:-1])])
                first = np.flatnonzero(new)
                group = np.cumsum(new) - 1
                wait = doc == doc[first][group]  # rows of the least doc_id wait for the merge; the others are covered by it
                local = (_squeeze(at[~wait].astype(np.uint32)), _squeeze(right[~wait]), _squeeze(left[~wait]), _squeeze(at[wait].astype(np.uint32)), _squeeze(group[wait].astype(np.uint32)))
                out = [(-1 - chunk % ranges, chunk, *local)]
                keys, right, left, doc, part = keys[first], right[first], left[first], doc[first], part[first]
                goes = np.searchsorted(edges, np.ascontiguousarray(keys[:, :K]).view(f"S{K}").ravel(), side="right") * parts + part
                dealt = np.argsort(goes, kind="stable")  # a range's part keeps the order
                cuts = np.flatnonzero(np.concatenate([[True], goes[dealt][1:] != goes[dealt][:-1], [True]]))
                for x, y in zip(cuts[:-1], cuts[1:]):
                    own = dealt[x:y]
                    c = _common(keys[own])
                    rest = keys[own][np.arange(WIDTH) >= c[:, None]]
                    out.append((int(goes[own[0]]), chunk, _squeeze(c), zstandard.ZstdCompressor(level=6).compress(rest.tobytes()), _squeeze(np.stack([right[own], left[own]], axis=1).ravel()), _squeeze(doc[own]), _squeeze(own.astype(np.uint32))))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["range", "chunk_id", "a", "b", "c", "d", "e"])
        release()

    return joined.mapInArrow(send, "range int, chunk_id long, a binary, b binary, c binary, d binary, e binary")


# 4: merge

class LoserTree:
    """k-way merge of sorted runs of equally long byte strings, each with the prefix that a string shares with the one before.

    Every string in the tree carries the length of the prefix that it shares with the last winner of its path. At a
    match the longer shared prefix wins without a look at the strings; with equal ones only the bytes behind it are compared.
    """

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs = runs
        self.k = 1
        while self.k < len(runs):
            self.k *= 2

    def merge(self) -> tuple[list[int], list[int]]:
        """(run of each output, prefix that it shares with the output before)."""
        runs, k = self.runs, self.k
        total = sum(len(r[0]) for r in runs)
        key: list = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
        known = [0] * k
        step = [0] * k
        lose = [0] * k

        def play(a: int, b: int) -> tuple[int, int]:
            """(winner, loser)."""
            x, y = key[a], key[b]
            if y is None:
                return a, b
            if x is None:
                return b, a
            h = known[a]
            if h != known[b]:
                return (a, b) if h > known[b] else (b, a)
            s, t = x[h:], y[h:]
            if s == t:
                a, b = (a, b) if a < b else (b, a)
                known[b] = len(x)
                return a, b
            rest = int.from_bytes(s, "big") ^ int.from_bytes(t, "big")
            n = h + len(s) - (rest.bit_length() + 7) // 8
            if s < t:
                known[b] = n
                return a, b
            known[a] = n
            return b, a

        win = list(range(k))
        width = k
        while width > 1:  # the first round: winners of each level
            nxt = []
            for i in range(0, width, 2):
                w, l = play(win[i], win[i + 1])
                lose[(width + i) // 2] = l
                nxt.append(w)
            win, width = nxt, width // 2
        w = win[0]
        out, shares = [], []
        for _ in range(total):
            out.append(w)
            shares.append(known[w])
            step[w] += 1
            i = step[w]
            strings, common = runs[w]
            if i < len(strings):
                key[w], known[w] = strings[i], common[i]
            else:
                key[w] = None
            node = (w + k) // 2
            while node:
                o = lose[node]
                y = key[o]
                if y is not None:
                    x = key[w]
                    if x is None or known[o] > known[w]:
                        lose[node], w = w, o
                    elif known[o] == known[w]:
                        w, lose[node] = play(w, o)
                node //= 2
        return out, shares


def _front_decode(common: np.ndarray, rest: bytes) -> np.ndarray:
    """The rows of a front-coded run."""
    n = len(common)
    out = np.zeros((n, WIDTH), np.uint8)
    own = np.arange(WIDTH) >= common[:, None]
    out[own] = np.frombuffer(rest, np.uint8)
    for c in range(WIDTH):  # a shared byte is that of the last row which has its own there
        src = np.maximum.accumulate(np.where(own[:, c], np.arange(n), 0))
        out[:, c] = out[src, c]
    return out


def _window_bits(keys: np.ndarray, common: np.ndarray, right: np.ndarray, left: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each sorted key, bit l is set if the window from l bytes before the anchor has an equal one in a smaller doc_id."""
    n = len(keys)
    bits = np.zeros(n, np.uint32)
    group = np.cumsum(common < K)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    some = np.flatnonzero(np.repeat(several, np.diff(np.append(first, n))))
    if not len(some):
        return bits
    before = keys[some][:, LENGTH:]
    order = _sorted(before)
    shares = _common(before[order])
    doc_s, right_s, left_s = doc[some], right[some], left[some]
    for l in range(LEFT + 1):
        ok = np.flatnonzero((right_s >= LENGTH - l) & (left_s >= l))
        if not len(ok):
            continue
        run = np.cumsum(common < LENGTH - l)[some][ok]  # equal bytes from the anchor on
        back = np.empty(len(some), np.int64)
        back[order] = np.cumsum(shares < l)  # equal bytes before it
        key = run.astype(np.int64) << 32 | back[ok]
        o = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], key[o][1:] != key[o][:-1]]))
        d = doc_s[ok][o]
        least = np.repeat(np.minimum.reduceat(d, head), np.diff(np.append(head, len(o))))
        bits[some[ok[o]]] |= np.where(d > least, np.uint32(1 << l), np.uint32(0))
    return bits


def _merged(runs: DataFrame) -> DataFrame:
    """(chunk_id, kind, a ... e): 0 for what a chunk knows by itself, 1 for (group, bits) of its waiting keys."""

    def merge(key, part):
        if key[0] < 0:
            return pd.DataFrame({"chunk_id": part["chunk_id"], "kind": 0, **{c: part[c] for c in "abcde"}})
        keys, lists, rights, lefts, docs, refs, sizes = [], [], [], [], [], [], []
        for r in part.itertuples():
            common = _swell(r.a, np.uint8)
            m = _front_decode(common, zstandard.ZstdDecompressor().decompress(r.b))
            raw = m.tobytes()
            lists.append(([raw[i:i + WIDTH] for i in range(0, len(raw), WIDTH)], common.tolist()))
            both = _swell(r.c, np.uint8).reshape(-1, 2)
            keys.append(m)
            rights.append(both[:, 0])
            lefts.append(both[:, 1])
            docs.append(_swell(r.d, np.int64))
            refs.append(_swell(r.e, np.uint32))
            sizes.append(len(m))
        run, shares = LoserTree(lists).merge()
        lists.clear()
        run = np.array(run, np.int64)
        base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at = np.empty(len(run), np.int64)
        order = np.argsort(run, kind="stable")
        at[order] = np.arange(len(run))  # outputs of one run come in its order
        all_keys, right, left, doc, ref = (np.concatenate(x) for x in (keys, rights, lefts, docs, refs))
        bits = np.zeros(len(run), np.uint32)
        bits[at] = _window_bits(all_keys[at], np.array(shares, np.int64), right[at], left[at], doc[at])
        out = []
        for chunk, x, n in zip(part["chunk_id"], base.tolist(), sizes):
            b = bits[x:x + n]
            hit = b > 0
            if hit.any():
                out.append((chunk, 1, _squeeze(ref[x:x + n][hit]), _squeeze(b[hit]), None, None, None))
        release()
        return pd.DataFrame(out, columns=["chunk_id", "kind", *"abcde"])

    return runs.groupBy("range").applyInPandas(merge, "chunk_id long, kind int, a binary, b binary, c binary, d binary, e binary")


# 5: removal

def _cover(n: int, news: list[dict]) -> np.ndarray:
    """Which of a chunk's bytes go."""
    local = next((x for x in news if x["kind"] == 0), None)
    if local is None:
        return np.zeros(n, bool)
    at, right, left = _swell(local["a"], np.uint32).astype(np.int64), _swell(local["b"], np.uint8).astype(np.int64), _swell(local["c"], np.uint8).astype(np.int64)
    ok = right + left >= LENGTH
    begins, ends = [(at - left)[ok]], [(at + right)[ok]]
    wait, group = _swell(local["d"], np.uint32).astype(np.int64), _swell(local["e"], np.uint32).astype(np.int64)
    bits = np.zeros(int(group.max()) + 1 if len(group) else 0, np.uint32)
    for x in news:
        if x["kind"] == 1:
            bits[_swell(x["a"], np.uint32).astype(np.int64)] = _swell(x["b"], np.uint32)
    mine = bits[group]
    wait, mine = wait[mine > 0], mine[mine > 0]
    for l in range(LEFT + 1):
        p = wait[(mine >> np.uint32(l)) & np.uint32(1) > 0] - l
        begins.append(p)
        ends.append(p + LENGTH)
    change = np.bincount(np.concatenate(begins), minlength=n + 1) - np.bincount(np.concatenate(ends), minlength=n + 1)
    return np.cumsum(change)[:n] > 0


def _helpers(docs: DataFrame) -> list[str]:
    """Names of the columns that removed() adds: _bytes, _spans, _kept and _text, or with more underscores where docs has one of them."""
    taken, mark = {c.lower() for c in docs.columns}, "_"
    while any(f"{mark}{n}" in taken for n in ("bytes", "spans", "kept", "text")):
        mark += "_"
    return [f"{mark}{n}" for n in ("bytes", "spans", "kept", "text")]


def removed(docs: DataFrame) -> DataFrame:
    """docs with _bytes, _spans (array of begin and end in bytes), _kept (the remaining bytes) and _text (what is left of a text that lost
    bytes, without characters cut in two; else null); see _helpers() for docs with columns of these names."""
    text_batches(docs.sparkSession)
    rested(docs.sparkSession)
    names = _helpers(docs)
    size = text_bytes(docs)
    tasks = max(12, size // SHARE)
    ranges = min(tasks, SPLITTERS)
    chunks = cut(_chunks(docs, min(1.0, SAMPLE / max(1, size))))
    rows = chunks.where(F.octet_length("sample") > 0).select("sample").collect()  # about SAMPLE strings at most
    drawn = sorted({s for r in rows for i in range(0, len(r["sample"]), K) if not (s := bytes(r["sample"][i:i + K])).endswith(b"\0")})
    splitters = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else []
    merged = _merged(_runs(chunks, _shared(chunks, tasks), tasks, splitters, -(-tasks // ranges)))
    news = merged.groupBy("chunk_id").agg(F.collect_list(F.struct("kind", "a", "b", "c", "d", "e")).alias("news"))  # a row per range at most
    joined = chunks.select("chunk_id", "data").join(news, "chunk_id", "left").select("data", "news")

    def finish(batches):
        for batch in batches:
            for data, news in zip(batch.column("data"), batch.column("news")):
                rows, news = _rows(data.as_buffer()), news.as_py()
                text, start = _bytes(rows)
                gone = _cover(len(text), news or [])
                spans, kept, clean = [], [], []
                for a, b in zip(start[:-1].tolist(), start[1:].tolist()):
                    own = gone[a:b]
                    if own.any():
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                        spans.append([{"begin": x, "end": y} for x, y in zip(edge[0::2].tolist(), edge[1::2].tolist())])
                        kept.append(text[a:b][~own].tobytes())
                        clean.append(kept[-1].decode("utf-8", "ignore"))
                    else:
                        spans.append([])
                        clean.append(None)
                        kept.append(text[a:b].tobytes())
                extra = [pa.array(np.diff(start), pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()), pa.array(clean, pa.string())]
                for name, col in zip(names, extra):
                    rows = rows.append_column(name, col)
                yield from rows.to_batches(max_chunksize=500)
        release()

    span = StructType([StructField("begin", LongType()), StructField("end", LongType())])
    schema = StructType([*docs.schema.fields, *(StructField(n, t) for n, t in zip(names, (LongType(), ArrayType(span), BinaryType(), StringType())))])
    return joined.mapInArrow(finish, schema)


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes taken out of their texts; a character that lost some of its bytes goes. All rows stay."""
    _, spans, _, text = _helpers(docs)
    lost = F.size(f"`{spans}`") > 0
    clean = {"text": F.when(lost, F.col(f"`{text}`")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        clean["n_chars"] = F.when(lost, F.length(clean["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return removed(docs).select(*(clean.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    found = removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_bytes").alias("n_bytes"), (F.col("_bytes") - F.octet_length("_kept")).cast("long").alias("n_removed"),
                        F.size("_spans").cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))
