"""Operator 9: toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first (case, homoglyphs, digit and sign substitutions) and reduced to words. The lexicon holds words and
word beginnings; each weight is the smoothed log odds of document frequencies among labelled rows. All entries are matched
in one pass of the automaton; a word counts once, with its largest weight, unless it stands in an exception phrase. The
sum of weights is normalised by length, and a logistic curve over (log sum, density) turns it into a score.

Fitting reads a bounded sample of labelled rows, about FIT_ROWS of each class chosen by a hash of doc_id, and never a
held-out row (crc32 of doc_id as text, mod 5, is 0). A sampled row weighs as many rows of its class as it stands for, so a
score means the same with and without sampling. The lexicon and its exceptions are all entries and phrases of that sample that
pass MIN_DF and the odds, so what is sent to the executors is bounded by the sample alone. Scoring reads all rows and whole texts,
and shuffles nothing.

Defined results: null and empty texts score as the curve does at zero weight; very long texts are matched whole, in time linear in
their length; without labels of both classes, or without an entry, every score is 0.0; of labels that repeat a doc_id the
largest counts, null labels don't count; a null doc_id is not held out and never fitted; repeated rows are scored each;
entries of equal weight at one place count once; empty tables of documents give no rows, empty labels scores of 0.0; columns
other than doc_id and text are not read by the query, and carried along by reject().
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import cut, table, text_batches
from quillmark.llm.pieces import claim, slices

FIT_ROWS = 10_000
#: Least document frequency among toxic rows, and least log odds, of an entry.
MIN_DF, MIN_ODDS = 4, 3.0
PREFIXES = (4, 5, 6)
#: Added to the words of a text where its density is taken, so that one word in three isn't all.
SMOOTH = 10.0
#: Lookalikes of Latin letters (Cyrillic, Greek, full-width) and signs and digits that stand for them.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ɡ": "g", "ⅼ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
              "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ı": "i"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
FOLD = str.maketrans(LOOKALIKES | DIGITS | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {c: None for c in "​‌‍­"})
WORD = re.compile(r"[^\W\d_]+")


def folded(text: str) -> list[str]:
    return WORD.findall(text.lower().translate(FOLD))


def entries(words: list[str]) -> set[str]:
    """Candidate entries of a text: its words, and their beginnings; a blank marks a word's edge."""
    own = set(words)
    return {f" {w} " for w in own} | {f" {w[:n]}" for w in own for n in PREFIXES if len(w) > n}


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: list[str], curve: tuple[float, ...] | None):
        import ahocorasick

        self.weights, self.exceptions, self.curve = weights, exceptions, curve
        self.automaton = ahocorasick.Automaton()
        for e, w in weights.items():
            self.automaton.add_word(e, (len(e), w))
        for e in exceptions:
            self.automaton.add_word(f" {e} ", (len(e) + 2, None))
        if weights:
            self.automaton.make_automaton()

    def features(self, text: str) -> tuple[float, float]:
        """(log of the weights' sum, weights' sum by length)."""
        words = folded(text)
        if not words or not self.weights:
            return 0.0, 0.0
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w) in self.automaton.iter(" " + " ".join(words) + " "):
            at = end - n + 1
            if w is None:
                spared.append((at, end))
            elif w > best.get(at, 0.0):
                best[at] = w
        total, until, k = 0.0, -1, 0
        spared.sort()
        for at in sorted(best):  # the phrases that begin at or before a match reach to until
            while k < len(spared) and spared[k][0] <= at:
                until = max(until, spared[k][1])
                k += 1
            if at >= until:
                total += best[at]
        return float(np.log1p(total)), total / (len(words) + SMOOTH)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(texts))
        x = np.array([self.features(t) for t in texts]).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ np.array(self.curve[1:]), -40, 40)))


@cache
def _lexicon(weights: tuple, exceptions: tuple, curve: tuple | None) -> Lexicon:
    return Lexicon(dict(weights), list(exceptions), curve)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Newton steps with a small ridge; rows count by their weight."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        ridge = np.diag([1e-6] + [1e-1] * x.shape[1])
        step = np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + ridge, a.T @ (weight * (y - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def _counted(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e for (e, _), _ in found], pa.string()), pa.array([t for (_, t), _ in found], pa.int32()), pa.array([n for _, n in found], pa.int64())], names=["entry", "toxic", "n"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[tuple, tuple, tuple | None]:
    """(weights, exception phrases, curve) from the labelled rows that are not held out."""
    text_batches(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {int(r["toxic"]): r["n"] for r in known.where("toxic IN (0, 1)").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return (), (), None
    draw, full = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), float(1 << 30)
    at = F.when(F.col("toxic") == 1, min(full, full * rows / n[1])).when(F.col("toxic") == 0, min(full, full * rows / n[0]))
    few = known.where(draw < at)  # about 2 * rows at most
    drawn = {int(r["toxic"]): r["n"] for r in few.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    stands = [n[k] / drawn.get(k, n[k]) for k in (0, 1)]  # rows of a class that one sampled row stands for
    sample = cut(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "text"))

    def count(batches):
        claim("toxicity", _lexicon.cache_clear)
        for rows, texts in slices(batches):
            df: dict[tuple[str, int], int] = {}
            total = [0, 0]
            for toxic, text in zip(rows.column("toxic").to_pylist(), texts):
                total[toxic] += 1
                for e in entries(folded(text)):
                    df[e, toxic] = df.get((e, toxic), 0) + 1
            yield _counted([*df.items(), (("", 0), total[0]), (("", 1), total[1])])

    by = sample.mapInArrow(count, "entry string, toxic int, n long").groupBy("entry").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    seen = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = (seen.get(1, 0), seen.get(0, 0))
    likely = (F.col("t") + 0.5) * (size[1] + 1) >= float(np.exp(MIN_ODDS - 1e-6)) * (F.col("c") + 0.5) * (size[0] + 1)
    top = by.where(F.col("t") >= MIN_DF).where((F.col("entry") != "") & likely).collect()  # entries of the sample
    weights = {}
    for r in top:
        odds = float(np.log((r["t"] + 0.5) / (size[0] + 1)) - np.log((r["c"] + 0.5) / (size[1] + 1)))
        if odds >= MIN_ODDS:
            weights[r["entry"]] = odds
    if not weights:
        return (), (), None
    fixed = tuple(sorted(weights.items()))

    def phrases(batches):  # pairs of words of which one is in the lexicon: those at home in clean texts are exceptions
        for rows, texts in slices(batches):
            df: dict[tuple[str, int], int] = {}
            for toxic, text in zip(rows.column("toxic").to_pylist(), texts):
                words = folded(text)
                hit = [any(e in weights for e in (f" {w} ", *(f" {w[:n]}" for n in PREFIXES if len(w) > n))) for w in words]
                for p in {f"{words[i]} {words[i + 1]}" for i in range(len(words) - 1) if hit[i] or hit[i + 1]}:
                    df[p, toxic] = df.get((p, toxic), 0) + 1
            yield _counted(list(df.items()))

    pairs = sample.mapInArrow(phrases, "entry string, toxic int, n long").groupBy("entry").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    spared = tuple(sorted(r["entry"] for r in pairs.where((F.col("c") >= MIN_DF) & (F.col("c") * stands[0] > F.col("t") * stands[1])).collect()))

    def measure(batches):
        lexicon = _lexicon(fixed, spared, None)
        for rows, texts in slices(batches):
            x = [lexicon.features(t) for t in texts]
            yield pa.RecordBatch.from_arrays([rows.column("toxic"), pa.array([v[0] for v in x]), pa.array([v[1] for v in x])], names=["y", "a", "b"])

    seen = sample.mapInArrow(measure, "y int, a double, b double").toPandas()  # three numbers for each fitted row
    y = seen["y"].to_numpy(float)
    return fixed, spared, _logistic(seen[["a", "b"]].to_numpy(float), y, np.where(y == 1, stands[1], stands[0]))


def scored(docs: DataFrame, model: tuple) -> DataFrame:
    """docs with score (0 to 1)."""
    send = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        claim("toxicity", _lexicon.cache_clear)
        lexicon = _lexicon(*send.value)
        for rows, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(lexicon.scores(texts))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per input row."""
    return scored(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic; all columns stay. Rows are scored and filtered where they are, with no join."""
    send = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def fine(batches):
        claim("toxicity", _lexicon.cache_clear)
        lexicon = _lexicon(*send.value)
        for rows, texts in slices(batches):
            yield rows.filter(pa.array(lexicon.scores(texts) < 0.5))

    return docs.mapInArrow(fine, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
