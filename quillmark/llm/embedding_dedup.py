"""Operator 7: near-duplicate embeddings by a pivot-permutation index.

1. Equal vectors of a label form one class (grouping on the vector itself, combined map-side), weighted by its size.
2. Pivots are a documented sample of vectors: PIVOTS_PER_ROOT * sqrt(rows), FEWEST at least, so that lists grow as slowly as their number;
   PIVOT_BYTES bounds what is sent. Every class is described by its permutation, the ids of its NEAREST nearest pivots in order, and
   posted to the inverted lists (label, pivot) of the first LISTED of them.
3. A list is dealt into blocks of about BLOCK classes, and every pair of blocks of a list is one group, so a list that
   holds a third of all rows is many groups and none of them is larger than two blocks.
4. In a group, shared-pivot counts of all its pairs come from one product of 0/1 matrices over the whole permutations; pairs that share
   at least SHARED pivots are candidates, each taken in the first list that has both only; they are verified by cosine in double
   precision.
5. A group returns a row per class, never its pairs: the weight of the links it found, and a root of its local component.
   Sums give the number of links, and the roots are edges for the distributed component search.

No list, block or candidate is capped. The index covers every row; its recall against brute force is tested (at least 0.9).

Defined results: a vector that is null, empty, zero or holds null or non-finite components, or whose label is null, links with
nothing: n_links 0, its own component, kept. Vectors of different lengths never link. A null vec_id takes no part in links.
Rows that repeat a vec_id count as rows of their own in n_links. Of pivots that are equally near the one with the least number comes
first. An empty table gives no rows. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import components, cut, table

THRESHOLD = 0.93
NEAREST, LISTED, SHARED = 10, 5, 3
PIVOTS_PER_ROOT, FEWEST = 1.0, 64
#: Most bytes of pivots that are sent to the executors.
PIVOT_BYTES = 64 << 20
BLOCK = 512


def _usable():
    v = F.col("embedding")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    return F.col("label").isNotNull() & F.col("vec_id").isNotNull() & fine


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square is lost
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pivots(classes: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Unit pivots by dimension; n classes. At most PIVOT_BYTES of vectors reach the driver."""
    width = classes.agg(F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()[0]
    want = int(min(PIVOT_BYTES // (8 * width), max(FEWEST, PIVOTS_PER_ROOT * n ** 0.5)))
    draw = F.pmod(F.xxhash64("cid", F.lit("pivot")), F.lit(1 << 30))
    rows = classes.where(draw < float(1 << 30) * min(1.0, 1.5 * want / max(1, n))).select("cid", "embedding").orderBy(F.xxhash64("cid", F.lit("order")), "cid").limit(want).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["embedding"]), []).append(r["embedding"])
    return {d: _unit(vs) for d, vs in by.items()}


def _group(a: pd.DataFrame, b: pd.DataFrame | None, pivot: int, threshold: float) -> pd.DataFrame:
    """(cid, links, root) for the classes of one block, or of two blocks against each other."""
    both = a if b is None else pd.concat([a, b])
    names, inverse = np.unique(np.concatenate(both["near"].to_list()), return_inverse=True)
    marks = np.zeros((len(both), len(names)), np.float32)
    marks[np.repeat(np.arange(len(both)), both["near"].map(len)), inverse] = 1
    cid, weight, x = both["cid"].to_numpy(np.int64), both["size"].to_numpy(np.int64), _unit(both["embedding"])
    k = len(a)
    left, right = (slice(0, k), slice(0, k)) if b is None else (slice(0, k), slice(k, None))
    early = np.zeros_like(marks)  # lists before this one
    listed = both["near"].map(lambda v: v[:LISTED]).to_list()
    early[np.repeat(np.arange(len(both)), [len(v) for v in listed]), np.searchsorted(names, np.concatenate(listed))] = 1
    early = early[:, : np.searchsorted(names, pivot)]
    shared = marks[left] @ marks[right].T
    link = (shared >= np.minimum(SHARED, len(both["near"].iloc[0]))) & (early[left] @ early[right].T == 0) & (x[left] @ x[right].T >= threshold)
    if b is None:
        np.fill_diagonal(link, False)
    links = np.zeros(len(both), np.int64)
    links[left] += link @ weight[right]
    if b is not None:
        links[right] += weight[left] @ link
    i, j = np.nonzero(link)
    j = j + (0 if b is None else k)
    root = cid.copy()
    while len(i):  # least id along the links
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        if (new == root).all():
            break
        root = new
    some = links > 0
    return pd.DataFrame({"cid": cid[some], "links": links[some], "root": root[some]})


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label"))
    good = rows.where(_usable())
    classes = cut(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("size")))
    n = classes.count()
    send = rows.sparkSession.sparkContext.broadcast(pivots(classes, n))

    def describe(batches):
        for batch in batches:
            dims = batch["embedding"].map(len)
            for d, part in batch.groupby(dims):
                p = send.value.get(int(d))
                if p is None:  # a length that no pivot has: one list for all of it
                    near = [[0]] * len(part)
                else:
                    cos = _unit(part["embedding"]) @ p.T
                    m = min(NEAREST, len(p))
                    top = np.sort(np.argpartition(-cos, m - 1, axis=1)[:, :m], axis=1)
                    order = np.argsort(-np.take_along_axis(cos, top, axis=1), axis=1, kind="stable")
                    near = np.take_along_axis(top, order, axis=1).astype(np.int32).tolist()
                yield pd.DataFrame({"cid": part["cid"], "size": part["size"], "label": part["label"], "dim": int(d), "embedding": part["embedding"], "near": near})

    kind = dict(classes.dtypes)
    described = cut(classes.mapInPandas(describe, f"cid long, size long, label {kind['label']}, dim int, embedding {kind['embedding']}, near array<int>"))
    posted = described.withColumn("pivot", F.explode(F.slice("near", 1, LISTED)))
    lists = posted.groupBy("label", "dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    dealt = posted.join(lists, ["label", "dim", "pivot"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "dim", "pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "size", "embedding", "near")

    def match(key, part):
        _, _, pivot, i, j = key
        if i == j:
            return _group(part, None, int(pivot), threshold)
        return _group(part[part["own"] == i], part[part["own"] == j], int(pivot), threshold)

    found = cut(dealt.groupBy("label", "dim", "pivot", "i", "j").applyInPandas(match, "cid long, links long, root long"))
    roots = components(classes.select(F.col("cid").alias("id")), found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    by = classes.join(links, "cid", "left").join(roots.withColumnRenamed("id", "cid"), "cid").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.col("root").alias("component_id"))
    linked = good.join(by, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
