"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint of 64 bits is mapped to the number of set bits in each of 32 segments of two bits. The Manhattan distance
of two such vectors never exceeds the number of differing bits. Two fingerprints within ``DISTANCE`` = 4 bits are thus
within 4 of each other as vectors, hence within 2 in the first or in the second half of their segments. The range join
runs on the grid of each half: a vector is entered in its own cell and in all cells at distance 1, so two vectors within
2 share a cell. Pairs that share a cell are verified bit by bit. No link is lost and none is added.

Equal fingerprints are one node from the start, so copies are never compared. A task reads cells in order, compares
within a cell and gives only a spanning forest of what it found; pairs never become rows. A very full cell is first
divided by the five bit blocks of which two close fingerprints share one.

Null and empty texts have fingerprint zero and are linked like any other. Rows without a doc_id take part; a component
takes the smallest id it has, null if it has none. Repeated rows stay rows. Columns but ``doc_id`` and the text are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from prevuelo.llm.graph import components
from prevuelo.llm.store import free, prepare, written

WORDS, SEED, DISTANCE = 4, 42, 4

#: Rows that a task looks at together, and the length from which a cell is divided.
CHUNK, FULL = 200_000, 4_000
_STEP = 100_000  # shingles hashed at a time
_POWERS = 3 ** np.arange(16, dtype=np.int64)
_HALF = 3**16
_SEGMENTS = np.arange(0, 64, 2, dtype=np.uint64)


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    whole = b" ".join(parts)
    blanks = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
    starts = [0, *(blanks + 1).tolist()]
    ends = [*blanks.tolist(), len(whole)][min(words, len(parts)) - 1 :]
    digest = xxhash.xxh64_intdigest
    sums, n = np.zeros(64, np.int64), len(ends)
    for i in range(0, n, _STEP):
        hashes = np.array([digest(whole[a:b], seed) for a, b in zip(starts[i : i + _STEP], ends[i : i + _STEP])], "<u8")
        sums += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, *keep): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64()), *b.columns[2:]], ["doc_id", "fp", *keep])

    prepare(df.sparkSession)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *keep)
    out = StructType([StructField("doc_id", LongType()), StructField("fp", LongType()), *[df.schema[k] for k in keep]])
    return rows.mapInArrow(run, out)


def cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, fingerprint) entries of fingerprints in both grids."""
    found, owners = [], []
    pairs = (fps[:, None] >> _SEGMENTS) & np.uint64(3)
    counts = np.bitwise_count(pairs).astype(np.int64)
    for half in (0, 1):
        own = counts[:, 16 * half : 16 * half + 16]
        base = own @ _POWERS + half * _HALF
        found.append(base)
        owners.append(np.arange(len(fps)))
        for step, room in ((1, own < 2), (-1, own > 0)):
            i, j = np.nonzero(room)
            found.append(base[i] + step * _POWERS[j])
            owners.append(i)
    return np.concatenate(found), fps[np.concatenate(owners)]


def close_pairs(keys: np.ndarray, fps: np.ndarray, distance: int, divide: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs with equal keys and at most ``distance`` differing bits; ``keys`` are sorted."""
    out = []
    if divide:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        full = sizes > FULL
        for a, n in zip(starts[full].tolist(), sizes[full].tolist()):
            mine = fps[a : a + n]
            for shift, width in ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12)):
                block = (mine >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                order = np.argsort(block, kind="stable")
                out += [(a + order[x], a + order[y]) for x, y in close_pairs(block[order], mine[order], distance, False)]
        at = np.flatnonzero(~np.repeat(full, sizes))
    else:
        at = np.arange(len(keys))
    step = 1
    while True:
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            return out
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= distance]
        if len(near):
            out.append((near, near + step))
        step += 1


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each value to the smallest value that the links (a, b) reach from it."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints ``fp`` as all pairs within ``distance`` do; at most 4."""
    if not 0 <= distance <= 4:
        raise ValueError("the grid finds distances up to 4")

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, fp = cells(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(fp.view(np.int64), pa.int64())], ["cell", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(cell: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            pairs = close_pairs(cell, fp, distance)
            if pairs:
                a, b = (np.concatenate(x) for x in zip(*pairs))
                u, v = forest(fp[a], fp[b])
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()) for x in (u, v)], ["u", "v"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)))
            size += b.num_rows
            if size >= CHUNK:
                cell, fp = (np.concatenate(x) for x in zip(*held))
                whole = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
                yield from found(cell[:whole], fp[:whole])
                held, size = [(cell[whole:], fp[whole:])], 0
        if held:
            yield from found(*(np.concatenate(x) for x in zip(*held)))

    entered = distinct.select("fp").mapInArrow(enter, "cell long, fp long")
    return entered.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "u long, v long")


def groups(df: DataFrame, distance: int = DISTANCE, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, root, component_id, *keep): root is the component's smallest fingerprint as a node."""
    rows = written(fingerprints(df, doc_id, text, keep), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct, distance))
    nodes = distinct.join(found, distinct["fp"] == found["node"], "left")
    nodes = written(nodes.select("fp", "least", F.coalesce("component", "fp").alias("root")), "nodes")
    ids = written(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = written(nodes.join(ids, "root").select("fp", "root", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "fp", "root", "component_id", *keep)


def op9(df: DataFrame) -> DataFrame:
    return groups(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame) -> DataFrame:
    """All columns of one row of each group: that with the smallest doc_id; of rows sharing it, the first by text.

    A group whose rows all lack an id keeps the first by text. An id may occur with several texts, in several groups.
    """
    number, key = free(df, "_number"), free(df, "_key")
    # a row's id and text in few bytes, never null, so that rows can be joined by them
    flags = [F.when(F.col(c).isNull(), "00").otherwise("01") for c in ("doc_id", "text")]
    rows = df.withColumn(number, F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    rows = rows.withColumn(key, F.unhex(F.concat(*flags, F.md5(F.coalesce("text", F.lit(""))))))
    found = groups(rows.select("doc_id", "text", key), keep=(key,))
    heads = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    heads = written(heads.select("root", F.coalesce("doc_id", F.lit(0)).alias(number), key).distinct(), "heads")
    first = heads.groupBy("root").agg(F.min(number).alias(number), F.min(key).alias(key), F.max(key).alias("_last"))
    kept = first.where(F.col(key) == F.col("_last")).select(number, key)
    # groups in which several texts share the smallest id; only their texts are compared
    tied = written(heads.join(first.where(F.col(key) != F.col("_last")).select("root"), "root"), "tied")
    if not tied.isEmpty():
        texts = rows.select(number, key, "text").join(tied, [number, key])
        least = texts.groupBy("root").agg(F.min(F.struct("text", number, key)).alias("_least"))
        kept = kept.unionByName(least.select(f"_least.{number}", f"_least.{key}"))
    return rows.dropDuplicates([number, key]).join(kept, [number, key]).select(*df.columns)
