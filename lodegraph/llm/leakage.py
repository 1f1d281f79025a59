"""Passages of evaluation items in a corpus, also edited ones.

Windows of an item's size get a SimHash fingerprint in which every word weighs as many five-word
shingles as hold it, so that a window's distance follows its shingles. Fingerprints are cut into
BLOCKS blocks: two within RADIUS have a block in which they differ by one bit at most. Item windows are a table
keyed by (size, block number, block value), with every value one bit away; windows of documents whose
value is in it, known from a bitmap of bounded size, are joined to it. What is within the radius is verified by the exact
weighted similarity of its shingles. Both sides are tables; no loop runs over items.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.workspace import broadcast_if_small, materialize

#: Words of a passage; items with fewer words must occur as a whole. Words of a shingle.
PASSAGE, SHINGLE = 15, 5
#: Blocks of 32 bits of a fingerprint, and the radius within which all fingerprints are found: one bit for each block, and what is left.
BLOCKS, BITS = 3, 32
RADIUS = 2 * BLOCKS - 1
#: Windows of items up to which a bitmap of their keys is sent to the executors, its bits for each key, and its least and largest size in bits.
MAP_WINDOWS, MAP_BITS, MAP_LEAST, MAP_MOST = 2_000_000, 128, 1 << 22, 1 << 28
#: Positions for which fingerprints are made at a time, so that memory doesn't depend on text length.
CHUNK = 65_536

_WORD = re.compile(r"[^\W_]+")
_PRINTS = [f"p{b}" for b in range(BLOCKS)]


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters or digits of the lower-cased text."""
    return _WORD.findall(text.lower()) if text else []


def _votes(words: list[str]) -> np.ndarray:
    """One row of votes (+1 or -1) for each word, from its hash."""
    digests = b"".join(xxhash.xxh128_digest(w)[: BLOCKS * BITS // 8] for w in words)
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(len(words), -1), axis=1)
    return bits.astype(np.int16) * 2 - 1


def _sums(rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``size`` neighbouring rows. Totals may wrap; their differences don't."""
    total = np.zeros((len(rows) + 1, rows.shape[1]), np.int16)
    np.cumsum(rows, axis=0, out=total[1:])
    return total[size:] - total[:-size]


def fingerprints(votes: np.ndarray, sizes: list[int], shingle: int = SHINGLE) -> dict[int, np.ndarray]:
    """By size of a window: BLOCKS 32-bit numbers for every window, bit by bit the majority of its words' weighted votes."""
    shingles: dict[int, np.ndarray] = {}
    out = {}
    for size in sizes:
        short = min(shingle, size)
        if len(votes) < size:
            out[size] = np.empty((0, BLOCKS), np.uint32)
            continue
        if short not in shingles:
            shingles[short] = _sums(votes, short)
        out[size] = np.packbits(_sums(shingles[short], size - short + 1) > 0, axis=1).view(">u4").astype(np.uint32)
    return out


def shingle_similarity(a: str, b: str, size: int = SHINGLE) -> float:
    """Weighted Jaccard similarity of the shingles, with their multiplicities, of two windows of words."""
    x, y = a.split(" "), b.split(" ")
    size = min(size, len(x), len(y))
    p, q = (Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) for w in (x, y))
    common = sum((p & q).values())
    return common / (sum(p.values()) + sum(q.values()) - common)


def _slots(values: np.ndarray, block: int, size: int) -> np.ndarray:
    """The places of block values in a bitmap of ``size`` bits, a power of two."""
    mixed = (values.astype(np.uint64) + np.uint64((block + 1) << 32)) * np.uint64(0x9E3779B97F4A7C15)
    return mixed >> np.uint64(64 - int(size).bit_length() + 1)


def _bitmap(prints: np.ndarray) -> tuple[np.ndarray, int]:
    """A bitmap of the block values of fingerprints and of all values one bit away."""
    size = min(max(1 << int(len(prints) * BLOCKS * (BITS + 1) * MAP_BITS - 1).bit_length(), MAP_LEAST), MAP_MOST)
    bits = np.zeros(size >> 3, np.uint8)
    for block in range(BLOCKS):
        for flip in [0, *(1 << k for k in range(BITS))]:
            slots = _slots(prints[:, block] ^ np.uint32(flip), block, size)
            np.bitwise_or.at(bits, slots >> np.uint64(3), np.uint8(1) << (slots & np.uint64(7)).astype(np.uint8))
    return bits, size


_maps: dict[str, dict[int, tuple[np.ndarray, int]]] = {}


def _maps_of(key: str, prints: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, int]]:
    """The bitmaps by size of a window, made once in each worker."""
    if key not in _maps:
        _maps.clear()
        _maps[key] = {size: _bitmap(p) for size, p in prints.items()}
    return _maps[key]


def _windows(texts: list[str], sizes: list[int], keep: dict[int, tuple[np.ndarray, int]] | None) -> Iterator[tuple[int, int, np.ndarray, str, int]]:
    """(text, size, fingerprint, words, block) for each window and block whose value is in the bitmap of ``keep``; without it, for each window once."""
    words, starts = [], [0]
    for text in texts:
        words += words_of(text)
        starts.append(len(words))
    if not words:
        return
    codes, unique = pd.factorize(np.array(words, dtype=object))
    votes, ends, most = _votes(list(unique)), np.array(starts), max(sizes)
    for at in range(0, len(words), CHUNK):
        prints = fingerprints(votes[codes[at : at + CHUNK + most - 1]], sizes)
        for size in sizes:
            own = prints[size][:CHUNK]
            doc = np.searchsorted(ends, np.arange(at, at + len(own)), "right") - 1
            whole = np.arange(at, at + len(own)) + size <= ends[doc + 1]  # a window doesn't run into the next document
            for block in range(BLOCKS if keep is not None else 1):
                hit = whole
                if keep is not None:
                    bits, n = keep[size]
                    slots = _slots(own[:, block], block, n)
                    hit = whole & ((bits[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 > 0)
                for i in np.flatnonzero(hit):
                    yield int(doc[i]), size, own[i], " ".join(words[at + i : at + i + size]), block


def _table(rows: list[tuple], ids: list, id_type: pa.DataType, id: str) -> pa.RecordBatch:
    columns = [pa.array([ids[r[0]] for r in rows], id_type), pa.array([r[1] for r in rows], pa.int32())]
    columns += [pa.array([int(np.int32(np.uint32(r[2][b]))) for r in rows], pa.int32()) for b in range(BLOCKS)]
    columns += [pa.array([r[3] for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=[id, "size", *_PRINTS, "words", "block"])


def _schema(id: str, kind: str) -> str:
    return f"`{id}` {kind}, size int, {', '.join(f'{p} int' for p in _PRINTS)}, words string, block int"


def _item_windows(items: DataFrame, item: str, text: str, passage: int) -> DataFrame:
    """(item, size, fingerprint, words) of each window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_size: dict[int, list[int]] = {}
            texts = batch.column(1).to_pylist()
            for i, t in enumerate(texts):
                size = min(passage, len(words_of(t)))
                if size:
                    by_size.setdefault(size, []).append(i)
            ids = batch.column(0).to_pylist()
            for size, own in by_size.items():
                yield _table(list(_windows([texts[i] for i in own], [size], None)), [ids[i] for i in own], batch.schema.field(0).type, item)

    kind = items.schema[item].dataType.simpleString()
    return items.filter(F.length(text) > 0).select(item, text).mapInArrow(run, _schema(item, kind)).drop("block").distinct()


def _document_windows(docs: DataFrame, id: str, text: str, sizes: list[int], prints: dict[int, np.ndarray] | None, key: str) -> DataFrame:
    """(id, size, fingerprint, words, block) of the windows whose block is in the items' bitmap; without one, of all."""
    shared = docs.sparkSession.sparkContext.broadcast(prints)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = _maps_of(key, shared.value) if shared.value is not None else None
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for row in _windows(batch.column(1).to_pylist(), sizes, keep):
                rows += [row] if keep is not None else [(*row[:4], b) for b in range(BLOCKS)]
                if len(rows) >= CHUNK:
                    yield _table(rows, ids, batch.schema.field(0).type, id)
                    rows = []
            yield _table(rows, ids, batch.schema.field(0).type, id)

    kind = docs.schema[id].dataType.simpleString()
    return docs.filter(F.length(text) > 0).select(id, text).mapInArrow(run, _schema(id, kind))


def _similarity(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([1.0 if p == q else shingle_similarity(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

    return similar(a, b)


def leaked_passages(docs: DataFrame, items: DataFrame, *, id: str = "doc_id", item: str = "item_id", text: str = "text", passage: int = PASSAGE, radius: int = RADIUS, similarity: float = 0.8) -> DataFrame:
    """(id, item, similarity, exact): documents that contain a passage of an item, edited ones too.

    A passage is a window of ``passage`` words, or a whole item of fewer. A document holds it if one of its own windows of
    that many words has a fingerprint within ``radius`` of the passage's and the weighted similarity of
    their five-word shingles reaches ``similarity``; the greatest is given, and ``exact`` tells whether some window has the very words.
    Windows within the radius are all found. Null and empty texts contain nothing, and an item
    without words is never found. Repeated documents and items with one id count as one.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius must be from 0 to {RADIUS}")
    windows = materialize(_item_windows(items, item, text, passage))
    own = materialize(windows.drop(item).distinct())
    sizes = [r[0] for r in own.select("size").distinct().collect()]  # at most ``passage`` numbers
    kinds = docs.schema[id].dataType.simpleString(), items.schema[item].dataType.simpleString()
    if not sizes:
        return docs.sparkSession.createDataFrame([], f"`{id}` {kinds[0]}, `{item}` {kinds[1]}, similarity double, exact boolean")
    prints = None
    if own.limit(MAP_WINDOWS + 1).count() <= MAP_WINDOWS:
        rows = own.select("size", *_PRINTS).distinct().toPandas()
        prints = {int(n): np.ascontiguousarray(g[_PRINTS].to_numpy(np.int32)).view(np.uint32) for n, g in rows.groupby("size")}
    found = materialize(_document_windows(docs, id, text, sizes, prints, own.inputFiles()[0]))
    # The table of keys: block values of item windows and those one bit away.
    flips = F.array(*[F.lit(0), *[F.lit(int(np.int32(np.uint32(1 << k)))) for k in range(BITS)]])
    blocks = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.col(p).alias("value")) for b, p in enumerate(_PRINTS)])).alias("b")
    keys = own.select("size", F.col("words").alias("passage"), *[F.col(p).alias(f"i_{p}") for p in _PRINTS], blocks)
    keys = keys.select("size", "passage", *[f"i_{p}" for p in _PRINTS], "b.block", F.explode(F.transform(flips, lambda f: F.col("b.value").bitwiseXOR(f))).alias("value"))
    value = F.element_at(F.array(*_PRINTS), F.col("block") + 1)
    # A window that many documents hold is compared once.
    distance = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"i_{p}"))) for p in _PRINTS), F.lit(0))
    near = found.drop(id).distinct().withColumn("value", value).join(keys, ["size", "block", "value"]).filter(distance <= radius).select("words", "passage").distinct()
    near = materialize(near.withColumn("similarity", _similarity(F.col("words"), F.col("passage"))).filter(F.col("similarity") >= similarity))
    hits = found.select(id, "words").join(broadcast_if_small(near), "words").select(id, "passage", "similarity", (F.col("words") == F.col("passage")).alias("exact"))
    most = [F.max("similarity").alias("similarity"), F.bool_or("exact").alias("exact")]
    hits = hits.groupBy(id, "passage").agg(*most)
    names = windows.select(item, F.col("words").alias("passage"))
    return hits.join(broadcast_if_small(names), "passage").groupBy(id, item).agg(*most)


def leaked_items(docs: DataFrame, items: DataFrame, *, id: str = "doc_id", item: str = "item_id", **more: object) -> DataFrame:
    """(id, item) of ``leaked_passages`` that hold a passage word by word; edited passages are found and compared like others, and left out here."""
    return leaked_passages(docs, items, id=id, item=item, **more).filter("exact").select(id, item)
