"""Cutting texts at safe places, so that what a tokenizer does to each part can be kept and used again.

A blank (U+0020) followed by a character that is not white space always begins a new match of the byte-level pattern
(public_tokenizers.PATTERN): the blank joins what follows. So a text is cut before every such blank, and each part's ids
are those that it has inside the whole text.
"""

from __future__ import annotations

import ctypes
import gc
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_UNSAFE = re.compile(r"\x20(?:\s|\Z)")


def parts(text: str) -> list[str]:
    """Parts of a text; all but the first stand without the blank that they begin with."""
    cut = text.split(" ")
    if _UNSAFE.search(text) is None:
        return cut
    out = [cut[0]]
    for p in cut[1:]:  # a blank before white space or at the end is no place to cut
        if p == "" or p[0].isspace():
            out[-1] += " " + p
        else:
            out.append(p)
    return out


class PartCache:
    """Ids of parts, little-endian unsigned 32-bit, kept up to a bound of entries and of part length."""

    LONGEST, MOST = 48, 500_000

    def __init__(self, encode_many):
        self.encode_many = encode_many  # list of strings -> list of bytes
        self.kept: dict[str, bytes] = {}  # parts with their blank left out

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.kept) > self.MOST:
            self.kept.clear()
        kept, longest = self.kept, self.LONGEST
        cut = [parts(t) if t else [] for t in texts]
        new = {p for ps in cut for p in ps[1:] if p not in kept}
        head = {ps[0] for ps in cut if ps}
        long = {p for p in new if len(p) > longest}
        order = list(new)
        at_head = list(head)
        got = self.encode_many([" " + p for p in order] + at_head)
        fresh = dict(zip(order, got))
        first = dict(zip(at_head, got[len(order):]))
        kept.update(fresh)
        out = []
        for ps in cut:
            out.append(first[ps[0]] + b"".join(map(kept.__getitem__, ps[1:])) if ps else b"")
        for p in long:
            del kept[p]
        return out


SLICE = 1 << 20
_kept: dict = {}


def claim(owner: str, clear=None) -> None:
    """Tells a Python worker whose tables it holds: those that other operators left in it are dropped first."""
    others = [k for k in _kept if k != owner]
    for k in others:
        _kept.pop(k)()
    if clear is not None:
        _kept[owner] = clear
    if others:
        gc.collect()
        release()


def slices(batches, column: str = "text", most: int = SLICE):
    """(rows, texts): each Arrow batch in slices of about so many bytes of text, null as empty.

    Only a slice's texts are Python strings at a time; when the batches end, freed memory goes back to the system.
    """
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, side="right")))
            rows = batch.slice(a, b - a)
            yield rows, rows.column(column).fill_null("").to_pylist()
            a = b
    release()


def release() -> None:
    """Gives freed memory back, so that the worker's next stage doesn't find it taken."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
