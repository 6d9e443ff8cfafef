"""Operator 2: bulk-synchronous best-fit packing.

Documents are tokenised and cut into pieces (Python, Arrow batches); the pieces are thin rows. Pieces and gaps (the room left
in every sequence that is open) are two distributed tables, and packing goes in rounds:

1. The pieces are range-sorted by (length, doc_id, piece) once, the gaps by (gap, sequence) in every round, and cut into the
   shared checkpoint folder. Each partition counts its rows by size. As the order is a range order, that is at most (sizes +
   partitions) rows; their running sums give each piece and each gap its rank among those of its size.
2. The successor sweep goes over the sizes, longest pieces first: the successor of a length is the least gap that holds it.
   Pieces that want the same gaps are told apart by rank: the pieces with the lowest ranks get the gaps with the lowest ranks,
   as many pieces a gap as it holds. A gap is taken once in a round. Where neither a free gap nor one that this round has
   left over holds a piece, sequences are opened. The sweep has an entry for a range of ranks, not for a piece, so a round's
   entries depend on the capacity and not on the number of documents.
3. Every partition of gaps looks its ranks up in the sweep's entries, notes what its gaps take, and updates them. Gaps that hold no
   waiting piece go. A gap that took pieces of a length has less than that length left, so it at least halves: there
   are few rounds (28 on 0.5 GB). They repeat until no piece waits.
4. What the gaps took, as (length, rank, sequence, offset), joins the pieces on (length, rank), where every key is one row.

Defined results: null and empty texts are one token (the closing id); texts over the capacity are cut into pieces of the
capacity, where the first one has the remainder; ties in length go by doc_id and piece (a null doc_id first), rows equal in
these in any order; repeated rows are packed each; an empty table gives no rows; a null doc_id is packed like any other; an added
token's string in a text is that token, as the tokenizers library has it; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_left
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import Kept, cut, table, text_batches
from quillmark.llm.pieces import claim, slices

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 2048
END = 0
#: Gaps of one task where there are many, and least rows of one where there are few.
GAPS, FEW_GAPS = 200_000, 20_000


def _ranked(spec: dict):
    """A tiktoken encoding with the ids of a trained byte-level BPE file, or None if the file is of another kind.

    In such a vocabulary ids are merge ranks, and a token's parts always meet as its own merge, so merging by rank of the joined bytes
    gives the same ids as the merge list.
    """
    import tiktoken

    model, cutter = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or spec["normalizer"] or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True) or model.get("dropout"):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]  # bytes that stand for themselves
    as_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(as_byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if merged != sorted(merged):
        return None
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def encoder(path: str):
    """A function from texts to their ids, as the tokenizers library has them, little-endian unsigned 32-bit.

    A byte-level vocabulary is applied by ranks, which is faster; texts that hold an added token's string go through the
    library. That both split texts alike at every code point is tested.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    spec = json.loads(tokenizer.to_str())
    ranked, added = _ranked(spec), [t["content"] for t in spec["added_tokens"]]

    def ids(text: str) -> bytes:
        if ranked is None or any(t in text for t in added):
            return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", ranked.encode_ordinary(text)).tobytes()

    return lambda texts: [ids(t) for t in texts]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids): every document's ids and the closing id, cut to the capacity."""
    path = path or public_tokenizers.path(VOCABULARY)
    text_batches(docs.sparkSession)
    close = np.array([end], "<u4").tobytes()

    def run(batches):
        claim("packing", encoder.cache_clear)
        e = encoder(path)
        for rows, texts in slices(batches):
            out = []
            for key, ids in zip(rows.column("doc_id").to_pylist(), e(texts)):
                ids += close
                n = len(ids) // 4
                first = n % capacity or capacity
                edges = [0, *range(first, n + 1, capacity)]
                out += [(key, i, x, y - x, ids[4 * x:4 * y]) for i, (x, y) in enumerate(zip(edges, edges[1:]))]
            k, i, x, n, ids = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(i, pa.int32()), pa.array(x, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def sweep(waiting: dict[int, int], free: dict[int, int], capacity: int = CAPACITY, placed: dict[int, int] | None = None) -> tuple[list[tuple[int, int, int, list[tuple[int, int, int]]]], int]:
    """One round: (entries, sequences to open) for the waiting pieces by length and the free gaps by size; placed: the ranks of each length that earlier rounds took.

    An entry (gap, first, many, runs) says that of the gaps of a size those with ranks first, first + 1 ... take the runs; a run
    (length, rank, take) is that each of them takes so many pieces of a length, ranks counted on from one gap to the next.
    """
    lengths = sorted((n for n in waiting if waiting[n]), reverse=True)
    left, rank, free = dict(waiting), {n: (placed or {}).get(n, 0) for n in lengths}, dict(free)
    used, entries, opened, most_left = dict.fromkeys(free, 0), [], 0, 0
    sizes = sorted(g for g in free if free[g])
    for i, length in enumerate(lengths):
        while left[length]:
            at = bisect_left(sizes, length)  # the successor
            if at == len(sizes):
                if most_left >= length:  # a gap that this round has left over: the next round's
                    break
                more = -(-left[length] // (capacity // length))
                opened, free[capacity] = opened + more, free.get(capacity, 0) + more
                used.setdefault(capacity, 0)
                sizes.append(capacity)
                continue
            gap = sizes[at]
            fit = gap // length
            many = min(free[gap] - used[gap], left[length] // fit)
            runs, room = [], gap
            if many:
                runs.append((length, rank[length], fit))
                room -= fit * length
            else:  # too few pieces of this length for one gap: it goes on with the next lengths while they fit
                many = 1
                for n in lengths[i:]:
                    take = min(left[n], room // n)
                    if take:
                        runs.append((n, rank[n], take))
                        room -= take * n
                    if take < left[n]:
                        break
            for n, _, take in runs:
                left[n] -= take * many
                rank[n] += take * many
            entries.append((gap, used[gap], many, runs))
            most_left = max(most_left, room)
            used[gap] += many
            if used[gap] == free[gap]:
                sizes.pop(at)
    return entries, opened


class _Sorted:
    """A table range-sorted by a size and more columns, where every row can tell its rank among those of its size."""

    def __init__(self, rows: DataFrame, n: int, size: str, *ties: str):
        self.size = size
        self.kept = Kept(rows.repartitionByRange(n, size, *ties).sortWithinPartitions(size, *ties).withColumn("part", F.spark_partition_id()), task_rows=FEW_GAPS)

        def count(batches):
            held: dict[int, int] = {}  # by part and size
            for b in batches:
                for x, k in zip(*(v.tolist() for v in np.unique(b.column(1).to_numpy().astype(np.int64) << 32 | b.column(0).to_numpy(), return_counts=True))):
                    held[x] = held.get(x, 0) + k
            at = np.array(list(held), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 32, pa.int32()), pa.array(at & 0xFFFFFFFF), pa.array(list(held.values()), pa.int64())], names=["part", "size", "n"])

        self.before, self.total = {}, {}
        for part, x, k in sorted(map(tuple, self.kept.df.select(F.col(size).cast("long"), "part").mapInArrow(count, "part int, size long, n long").collect())):  # sizes + partitions rows at most
            self.before.setdefault(part, {})[x] = self.total.get(x, 0)
            self.total[x] = self.total.get(x, 0) + k

    def ranked(self, then, schema: str) -> DataFrame:
        """then(batch with rank) of every batch."""
        sc = self.kept.df.sparkSession.sparkContext
        send, size = sc.broadcast(self.before), self.size

        def run(batches):
            seen: dict[int, int] = {}  # by part and size
            for batch in batches:
                if len(batch):
                    at, inverse, many = np.unique(batch["part"].to_numpy(np.int64) << 32 | batch[size].to_numpy(np.int64), return_inverse=True, return_counts=True)
                    own = batch.groupby(inverse).cumcount().to_numpy(np.int64)
                    base = []
                    for x, k in zip(at.tolist(), many.tolist()):
                        n = seen.get(x)
                        if n is None:
                            n = send.value[x >> 32][x & 0xFFFFFFFF]
                        base.append(n)
                        seen[x] = n + k
                    batch["rank"] = own + np.array(base, np.int64)[inverse]
                    yield then(batch)

        return self.kept.df.mapInPandas(run, schema)


def _taking(entries: list, capacity: int):
    """What a batch of ranked gaps takes: (seq, gap that is left, entry or -1, k-th gap of the entry, offset)."""
    at = sorted(range(len(entries)), key=lambda e: entries[e][:2])
    number = np.array(at, np.int64)
    gap, first, many = (np.array([entries[e][c] for e in at], np.int64) for c in range(3))
    used = np.array([sum(n * take for n, _, take in entries[e][3]) for e in at], np.int64)
    key = gap << 44 | first

    def then(batch):
        g, rank = batch["gap"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
        i = np.searchsorted(key, g << 44 | rank, side="right") - 1
        j = np.maximum(i, 0)
        k = rank - first[j]
        hit = (i >= 0) & (gap[j] == g) & (k < many[j])
        return pd.DataFrame({"seq": batch["seq"], "gap": g - np.where(hit, used[j], 0), "entry": np.where(hit, number[j], -1), "k": np.where(hit, k, 0), "offset": capacity - g})

    return then


def _given(entries: list):
    """(length, rank, sequence_id, offset) of every piece that a batch of gaps took."""

    def run(batches):
        for batch in batches:
            out = []
            for e, part in batch.groupby("entry"):
                seq, k, offset = (part[c].to_numpy(np.int64) for c in ("seq", "k", "offset"))
                for length, rank, take in entries[int(e)][3]:
                    step = np.arange(take)
                    out.append(pd.DataFrame({"length": length, "rank": (rank + k[:, None] * take + step).ravel(), "sequence_id": np.repeat(seq, take), "offset": (offset[:, None] + step * length).ravel()}))
                    offset = offset + take * length
            if out:
                yield pd.concat(out)

    return run


def pack(thin: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """thin (doc_id, piece, length and others) with sequence_id and offset."""
    spark = thin.sparkSession
    thin = cut(thin)
    ordered = _Sorted(thin, max(4, thin.rdd.getNumPartitions()), "length", "doc_id", "piece")
    waiting, placed, free, gaps, opened, given = dict(ordered.total), {}, {}, None, 0, None
    while waiting:
        entries, more = sweep(waiting, free, capacity, placed)
        fresh = spark.range(opened, opened + more).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("gap"))
        rows = fresh if gaps is None else gaps.where(F.col("gap") >= min(waiting)).union(fresh)
        opened, free[capacity] = opened + more, free.get(capacity, 0) + more
        n = sum(free.values())
        sorted_gaps = _Sorted(rows, max(min(8, -(-n // FEW_GAPS)), -(-n // GAPS)), "gap", "seq")
        taken = sorted_gaps.ranked(_taking(entries, capacity), "seq long, gap long, entry long, k long, offset long")
        gaps = taken.select("seq", "gap")
        own = taken.where("entry >= 0").mapInPandas(_given(entries), "length long, rank long, sequence_id long, offset long")
        given = own if given is None else given.union(own)
        for gap, _, many, runs in entries:
            room = gap - sum(n * take for n, _, take in runs)
            free[gap] -= many
            free[room] = free.get(room, 0) + many
            for n, _, take in runs:
                waiting[n] -= take * many
                placed[n] = placed.get(n, 0) + take * many
        waiting = {n: k for n, k in waiting.items() if k}
        free = {g: k for g, k in free.items() if k and waiting and g >= min(waiting)}
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in thin.schema.fields)
    named = ordered.ranked(lambda batch: batch.drop(columns="part"), kinds + ", rank long")
    if given is None:
        return named.drop("rank").withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    return named.join(given, ["length", "rank"]).select(*thin.columns, "sequence_id", "offset")


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    thin = pieces(docs, path, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(thin, capacity)


def sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, n_tokens, doc_ids, ids): the packed sequences themselves, each at most the capacity."""
    rows = pack(pieces(docs, path, capacity), capacity)
    held = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return rows.groupBy("sequence_id").agg(held.alias("held"), F.sum("length").alias("n_tokens")).select(
        "sequence_id", "n_tokens", F.col("held.doc_id").alias("doc_ids"), F.expr("unhex(array_join(transform(held, x -> hex(x.ids)), ''))").alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
