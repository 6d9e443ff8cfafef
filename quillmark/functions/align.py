"""Sequence alignment by the standard library's matcher, as Arrow-batched functions; the engine's only stateful Python."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

_OP = StructType([StructField("op", StringType()), *(StructField(c, IntegerType()) for c in ("i1", "i2", "j1", "j2"))])


@F.pandas_udf(ArrayType(_OP))
def opcodes(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit operations between two token arrays."""
    return pd.Series([[{"op": o, "i1": i1, "i2": i2, "j1": j1, "j2": j2} for o, i1, i2, j1, j2 in difflib.SequenceMatcher(a=list(x), b=list(y), autojunk=False).get_opcodes()] for x, y in zip(a, b)])


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two strings, with the matcher's own rule for frequent characters."""
    return pd.Series([difflib.SequenceMatcher(a=x or "", b=y or "").ratio() for x, y in zip(a, b)])


@F.pandas_udf(ArrayType(StringType()))
def resegmented(a: pd.Series, b: pd.Series) -> pd.Series:
    """Tokens b, parted as a parts them wherever a difference between the two is equal when joined."""

    def one(x, y):
        out = []
        for op, i1, i2, j1, j2 in difflib.SequenceMatcher(a=x, b=y, autojunk=False).get_opcodes():
            out += x[i1:i2] if op != "equal" and "".join(x[i1:i2]) == "".join(y[j1:j2]) else y[j1:j2]
        return out

    return pd.Series([one(list(x), list(y)) for x, y in zip(a, b)], dtype=object)


#: Pairs of word lists that are looked at together.
_PAIRS = 500


@F.arrow_udf(DoubleType())
def kept_share(a: pa.Array, b: pa.Array) -> pa.Array:
    """Share of the words of list a, repeated ones counted each time, that list b has too; null for an empty one."""
    out = [np.zeros(0)]
    for k in range(0, len(a), _PAIRS):
        one, two = a.slice(k, _PAIRS), b.slice(k, _PAIRS)
        n, m = (np.asarray(x.value_lengths()) for x in (one, two))
        codes = pa.concat_arrays([one.flatten(), two.flatten()]).dictionary_encode()
        top, codes = len(codes.dictionary), codes.indices.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        hit = np.isin(row * top + codes[: n.sum()], np.repeat(np.arange(len(m)), m) * top + codes[n.sum():])
        with np.errstate(invalid="ignore"):
            out.append(np.bincount(row[hit], minlength=len(n)) / n)
    share = np.concatenate(out)
    return pa.array(share, pa.float64(), mask=np.isnan(share))
