"""Posting list codecs as Arrow functions over numpy: Varbyte (7 bits a byte, the last byte marked), Simple9 and raw 32-bit.

Simple9 packs values below 2^28 into 32-bit words of a four-bit selector and as many equal fields as fit. Values that a codec
can't hold raise ValueError.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of Simple9: how many fields a word has and how many bits each, by selector.
FIELDS = [(28, 1), (14, 2), (9, 3), (7, 4), (5, 5), (4, 7), (3, 9), (2, 14), (1, 28)]


def varbyte_pack(values) -> bytes:
    v = np.asarray(values, np.int64)
    if len(v) and v.min() < 0:
        raise ValueError("Varbyte holds values from 0 on")
    if not len(v):
        return b""
    # Bytes a value takes; its lowest seven bits come last, with the mark.
    sizes = np.ones(len(v), np.int64)
    for k in range(1, 9):
        sizes += v >> (7 * k) > 0
    ends = np.cumsum(sizes)
    out = np.empty(ends[-1], np.uint8)
    for k in range(int(sizes.max())):
        has = sizes > k
        out[ends[has] - 1 - k] = (v[has] >> (7 * k)) & 127 | (128 if k == 0 else 0)
    return out.tobytes()


def varbyte_unpack(raw: bytes) -> list[int]:
    b = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(b & 128)
    sizes = np.diff(ends, prepend=-1)
    out = np.zeros(len(ends), np.int64)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        out[has] |= (b[ends[has] - k].astype(np.int64) & 127) << (7 * k)
    return out.tolist()


def simple9_pack(values) -> bytes:
    v = np.asarray(values, np.int64)
    if len(v) and (v.min() < 0 or v.max() >= 1 << 28):
        raise ValueError("Simple9 holds values from 0 to 2^28 - 1")
    # For each selector: how far from each place all values fit into its fields.
    bits = np.maximum(1, np.ceil(np.log2(v + 1.0)).astype(np.int64)) if len(v) else v
    words, at = [], 0
    reach = []
    for _, width in FIELDS:
        wide = np.append(np.flatnonzero(bits > width), len(v))
        reach.append(wide)
    while at < len(v):
        for selector, (count, width) in enumerate(FIELDS):
            until = reach[selector][np.searchsorted(reach[selector], at)]
            # The last word may be short; its other fields are never read, as the list's length is stored.
            take = min(count, len(v) - at)
            if until - at >= take:
                word = selector << 28
                for k in range(take):
                    word |= int(v[at + k]) << (k * width)
                words.append(word)
                at += take
                break
    return np.array([len(v), *words], "<u4").tobytes()


def simple9_unpack(raw: bytes) -> list[int]:
    w = np.frombuffer(raw, "<u4").astype(np.int64)
    total, w = int(w[0]), w[1:]
    selector = w >> 28
    counts = np.array([c for c, _ in FIELDS])[selector]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.int64)
    for s, (count, width) in enumerate(FIELDS):
        own = np.flatnonzero(selector == s)
        for k in range(count):
            out[starts[own] + k] = (w[own] >> (k * width)) & ((1 << width) - 1)
    return out[:total].tolist()


def raw_pack(values) -> bytes:
    v = np.asarray(values, np.int64)
    if len(v) and (v.min() < 0 or v.max() >= 1 << 32):
        raise ValueError("raw words hold values from 0 to 2^32 - 1")
    return v.astype("<u4").tobytes()


def raw_unpack(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


CODECS = {"varbyte": (varbyte_pack, varbyte_unpack), "simple9": (simple9_pack, simple9_unpack), "raw": (raw_pack, raw_unpack)}


def _arrow(one, kind: str):
    import pyarrow as pa

    to = pa.binary() if kind == "binary" else pa.list_(pa.int64())
    return F.arrow_udf(lambda a: pa.array([None if x is None else one(x) for x in a.to_pylist()], to), kind)


def pack(column: str | Column, codec: str = "varbyte") -> Column:
    """array<long> of values from 0 as bytes."""
    return _arrow(CODECS[codec][0], "binary")(F.col(column).cast("array<long>") if isinstance(column, str) else column)


def unpack(column: str | Column, codec: str = "varbyte") -> Column:
    return _arrow(CODECS[codec][1], "array<bigint>")(F.col(column) if isinstance(column, str) else column)


def unpack_by(codec: str | Column, packed: str | Column) -> Column:
    """unpack() where a column names each row's codec."""
    import pyarrow as pa

    def run(names, values):
        made = [None if x is None else CODECS[c][1](x) for c, x in zip(names.to_pylist(), values.to_pylist(), strict=True)]
        return pa.array(made, pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<bigint>")(codec, packed)
