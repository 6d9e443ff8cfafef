"""Pieces that several operators share: reading, cutting lineage, partition counts, components."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillmark.session import table  # noqa: F401  (the operators' reader)


def text_of(name: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def folder(spark) -> str:
    """The shared checkpoint folder of the session. Where it is unset, a session of one process makes its own; on a cluster that is an error, as a machine's folder isn't shared."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = path or tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into the shared checkpoint folder, without its lineage."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of thin tables that one task reads at least.
TASK_ROWS = 50_000


class Kept:
    """A table cut into the shared folder, with its rows and about its bytes, counted as it was written. A small one is read by few tasks."""

    def __init__(self, df: DataFrame, width: Column | int = 48, task_rows: int = TASK_ROWS):
        seen = Observation()
        whole = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.lit(width) if isinstance(width, int) else width), F.lit(0)).cast("long").alias("bytes")))
        self.rows, self.bytes = seen.get["n"], seen.get["bytes"]  # a task that is run again may count twice, so these are no less than the truth
        self._path = whole._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
        self.parts = whole.rdd.getNumPartitions()
        few = max(8, -(-self.rows // task_rows)) if task_rows else self.parts  # 0: its partitions stay as they are
        self.df = whole.coalesce(few) if few < self.parts else whole

    def drop(self) -> None:
        """Deletes the files: nothing may read the table any more."""
        session = self.df.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(self._path)
        path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows of an Arrow batch of texts, where the session has the default of ten times as many.
ARROW_ROWS = 1000


def text_batches(spark) -> None:
    """Smaller Arrow batches for tables of texts: ten thousand long rows would be held twice, by the JVM and by Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(ARROW_ROWS))


def freed(spark) -> None:
    """Lets Spark remove the shuffle files that nothing refers to any more; it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def rested(spark) -> None:
    """Asks the executors' JVMs for a full collection: a heap that the operators before have grown shrinks before Python workers need the memory.

    One task for each core, so that about every executor gets one; nothing depends on it.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet into the shared checkpoint folder and read again, so that later reads take only their columns."""
    path = f"{folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text_of()).cast("long")), F.lit(0))).first()[0]


#: Most bytes of a table that is broadcast, counted as rows times their width; larger ones are shuffled. A plan may hold a dozen of them
#: at once, and the driver builds each as a hash table of about three times these bytes.
BROADCAST_BYTES = 8 << 20
#: Rows of one key over which they are dealt to several tasks, and the number of these, where a table is too large to be broadcast.
HOT_ROWS, SALTS = 100_000, 32


def hot_keys(counts: DataFrame, on: str, count: str, size: int | None = None) -> Kept | bool:
    """(on): the keys of counts (on, count) with over HOT_ROWS rows, at most one for each HOT_ROWS rows of the table counted. False if the table of about size bytes that they are for will be broadcast."""
    return False if size is not None and size <= BROADCAST_BYTES else Kept(counts.where(F.col(count) > HOT_ROWS).select(on), 32)


def spread(rows: DataFrame, found: DataFrame, size: int, on: str, how: str = "inner", hot: Kept | bool = True) -> DataFrame:
    """rows joined with found, a table of about size bytes: broadcast under the bound, else shuffled, the rows of hot keys over salts.

    hot: those keys of rows, where they are known; True: they are counted here; False: a key has few rows by what it is.
    """
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(found), on, how)
    if hot is True:
        hot = hot_keys(rows.groupBy(on).agg(F.count(F.lit(1)).alias("_n")), on, "_n")
    if not hot or not hot.rows:
        return rows.join(found, on, how)
    marked = bounded(hot).withColumn("_hot", F.lit(True))
    salted = found.join(marked, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("_hot"), SALTS - 1).otherwise(0)))).drop("_hot")
    salt = F.pmod(F.xxhash64(*(c for c, t in rows.dtypes if "<" not in t)), F.lit(SALTS)).cast("int")
    dealt = rows.join(marked, on, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    return dealt.join(salted, [on, "_salt"], how).drop("_salt")


#: A sieve's slices have so many bits (64 KB each), and there are at most so many of them: 8 MB.
SLICE_BITS, SLICES = 1 << 19, 128


def sifted(rows: DataFrame, found: Kept, on: str) -> DataFrame:
    """rows without most of those whose key is not in found, a table over the broadcast bound: before a shuffled inner or semi join, so that
    what no row of found meets is not moved. A smaller found will be broadcast, and nothing is done.

    found's keys set three bits each in a broadcast Bloom filter, at 10 bits a key or more up to 8 MB, beyond which it lets more rows pass. No row that found has is lost.
    """
    if found.bytes <= BROADCAST_BYTES:
        return rows
    slices = 1
    while slices < SLICES and slices * SLICE_BITS < 10 * found.rows:
        slices *= 2
    words = SLICE_BITS // 64
    part = f"CAST(_h & {slices - 1} AS INT)"  # 7 bits of the hash for the slice, three times 19 for the bits
    places = [f"CAST(shiftrightunsigned(_h, {k}) & {SLICE_BITS - 1} AS INT)" for k in (7, 26, 45)]
    keys = found.df.select(F.xxhash64(on).alias("_h"))
    at = keys.select(F.expr(part).alias("p"), F.explode(F.array(*map(F.expr, places))).alias("at"))
    marks = at.selectExpr(f"p * {words}L + shiftright(at, 6) AS w", "shiftleft(1L, at & 63) AS b")
    every = found.df.sparkSession.range(0, slices * words, 1, max(1, slices // 16)).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    whole = marks.union(every).groupBy("w").agg(F.bit_or("b").alias("b"))
    sieve = whole.groupBy(F.expr(f"CAST(w DIV {words} AS INT)").alias("_p")).agg(F.sort_array(F.collect_list(F.struct("w", "b"))).alias("s")).select("_p", F.col("s.b").alias("_bits"))
    passes = F.expr(" AND ".join(f"getbit(get(_bits, shiftright({x}, 6)), {x} & 63) = 1" for x in places))
    hashed = rows.withColumn("_h", F.xxhash64(on))
    return hashed.join(F.broadcast(sieve), (F.expr(part) == F.col("_p")) & passes).select(*rows.columns)


#: Most edges whose components one task finds; more of them are first contracted by distributed rounds.
TASK_EDGES = 1_000_000


def _least_of(edges: DataFrame) -> DataFrame:
    """(x, p) for all ends of at most TASK_EDGES edges, in one task."""

    def run(batches):
        pairs = [b for b in batches if b.num_rows]
        if not pairs:
            return
        a, b = (np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in pairs]) for i in (0, 1))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b, root = at[:len(a)], at[len(a):], np.arange(len(ids))
        while True:  # each round the larger root of an edge hooks to the smaller, and pointers are jumped to their end
            ra, rb = root[a], root[b]
            if (ra == rb).all():
                break
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["x", "p"])

    return edges.coalesce(1).mapInArrow(run, "x long, p long")


def merged_labels(edges: DataFrame) -> Kept | None:
    """(x, p): for every end x of the undirected edges (a, b) of long ids, the least id p that it reaches; None without edges.

    While there are more than TASK_EDGES edges, a round gives every end of an edge the least label around it, jumps pointers to the roots, and
    relabels the edges, of which those inside a tree go; of the ends at most half are left. A hub that holds many edges is aggregated map-side (a
    minimum), and labels are joined over salted ids. The edges that are left, a bounded number, are one task's work. None reach the driver.
    """
    links = Kept(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    moved = None
    while links.rows:
        if links.rows <= TASK_EDGES:
            hook = Kept(_least_of(links.df))
        else:
            both = links.df.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.df.select(F.col("b"), F.col("a")))
            hook = Kept(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("p")))  # a label is never above its id: a forest
            jumped = 1
            while jumped:  # each jump halves the way to a tree's root
                up = spread(hook.df, hook.df.select(F.col("x").alias("p"), F.col("p").alias("pp")), hook.bytes, "p", "left")
                up = Kept(up.select("x", F.coalesce("pp", "p").alias("p"), (F.coalesce("pp", "p") < F.col("p")).cast("int").alias("c")), F.col("c"))
                hook.drop()
                hook, jumped = up, up.bytes
                hook.df, hook.bytes = up.df.select("x", "p"), 48 * up.rows
        old = links
        if moved is None:
            moved = hook
        else:
            up = spread(moved.df, hook.df.select(F.col("x").alias("p"), F.col("p").alias("pp")), hook.bytes, "p", "left")
            moved = Kept(up.select("x", F.coalesce("pp", "p").alias("p")))
        if old.rows <= TASK_EDGES:
            break
        one = spread(links.df, hook.df.select(F.col("x").alias("a"), F.col("p").alias("ra")), hook.bytes, "a")
        two = spread(one, hook.df.select(F.col("x").alias("b"), F.col("p").alias("rb")), hook.bytes, "b")
        links = Kept(two.where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        old.drop()
    links.drop()
    return moved


def relabelled(rows: DataFrame, column: str, moved: Kept | None) -> DataFrame:
    """rows with the labels in a column replaced by those that they were merged into."""
    if moved is None:
        return rows
    new = moved.df.select(F.col("x").alias(column), F.col("p").alias("_p"))
    return spread(rows, new, moved.bytes, column, "left").withColumn(column, F.coalesce("_p", column)).drop("_p")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable from each node over undirected edges (a, b) of long ids."""
    return relabelled(nodes.select(F.col("id").cast("long").alias("id"), F.col("id").cast("long").alias("root")), "root", merged_labels(edges)).select("id", "root")


def bounded(found: Kept, *columns: str) -> DataFrame:
    """A table (some of its columns), marked for broadcast if it is under the bound."""
    df = found.df.select(*columns) if columns else found.df
    return F.broadcast(df) if found.bytes <= BROADCAST_BYTES else df


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in dropped (doc_id); rows without a doc_id stay. Texts move only if the list is large."""
    return docs.join(bounded(Kept(dropped, 32)), "doc_id", "left_anti")
