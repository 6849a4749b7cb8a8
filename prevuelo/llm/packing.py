"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces of documents are packed into sequences. Pieces that fill a sequence alone are done. The rest are dealt by hash
into blocks of about ``BLOCK`` pieces, so blocks grow in number, not in size. Each block is evolved on ``ISLANDS``
islands, a task each: a child takes whole well-filled bins of one parent, drops the other parent's bins that hold any of
the same pieces, and best-fits the displaced pieces, longest first. Between epochs the elite of each island moves to
the next one. The best island's bins count; the pieces of bins with more than ``WASTE`` free places of all blocks are
dealt again into fewer blocks, until one block is left or no bin was saved.

A document is its ids and the end id 0, so a null or empty text is one piece of length 1. Repeated rows and rows without
a doc_id are documents of their own. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from prevuelo.llm.store import prepare, written
from prevuelo.llm.tokens import encoder

CAPACITY, END = 2048, 0
BLOCK, ISLANDS, EPOCHS, POPULATION, CHILDREN = 4_000, 2, 2, 3, 6
WASTE = 2

Bins = list[list[int]]


class Packing:
    """Open bins by free room; finds the tightest bin by a bit mask of rooms."""

    def __init__(self, sizes: list[int], capacity: int, bins: Bins = ()):
        self.sizes, self.capacity = sizes, capacity
        self.rooms: dict[int, Bins] = {}
        self.mask = 0
        for b in bins:
            self._put(b, capacity - sum([sizes[i] for i in b]))

    def _put(self, items: list[int], room: int) -> None:
        at = self.rooms.setdefault(room, [])
        at.append(items)
        self.mask |= 1 << room

    def add(self, item: int) -> None:
        size = self.sizes[item]
        fits = self.mask >> size
        if not fits:
            self._put([item], self.capacity - size)
            return
        room = size + (fits & -fits).bit_length() - 1
        at = self.rooms[room]
        items = at.pop()
        if not at:
            self.mask ^= 1 << room
        self._put([*items, item], room - size)

    def bins(self) -> Bins:
        return [b for at in self.rooms.values() for b in at]


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: Bins = ()) -> Bins:
    """Add ``items`` to ``bins`` in the given order, each to the tightest bin that takes it."""
    packing = Packing(sizes, capacity, bins)
    for i in items:
        packing.add(i)
    return packing.bins()


def fitness(bins: Bins, sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; then the more uneven filling, which leaves room to save a bin."""
    return -len(bins), sum([(sum([sizes[i] for i in b]) / capacity) ** 2 for b in bins]) / max(1, len(bins))


def crossover(taker: Bins, giver: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """Whole well-filled bins of ``giver`` in ``taker``; displaced items are best-fitted, longest first."""
    full = [b for b in giver if sum([sizes[i] for i in b]) >= capacity - WASTE] or giver
    share = rng.uniform(0.2, 0.6)
    injected = [b for b in full if rng.random() < share]
    inside = {i for b in injected for i in b}
    kept, displaced = injected, []
    for b in taker:
        if inside.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in inside]
    # the emptiest bins are opened too, so their items can go where they fit better
    kept.sort(key=lambda b: sum([sizes[i] for i in b]))
    opened = kept[: max(1, len(kept) // 50)]
    displaced += [i for b in opened for i in b if len(kept) > 1]
    kept = kept[len(opened) :] if len(kept) > 1 else kept
    displaced.sort(key=lambda i: (-sizes[i], i))
    return best_fit(displaced, sizes, capacity, kept)


def evolve(sizes: list[int], capacity: int, population: list[Bins], children: int, seed: int) -> list[Bins]:
    """The population after ``children`` crossovers, best first."""
    rng = random.Random(seed)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    if not population:
        population = [best_fit(order, sizes, capacity)]
    while len(population) < POPULATION:
        noisy = sorted(order, key=lambda i: -sizes[i] * rng.uniform(0.85, 1.0))
        population.append(best_fit(noisy, sizes, capacity))
    rate = lambda b: fitness(b, sizes, capacity)
    rated = sorted(((rate(b), k, b) for k, b in enumerate(population)), reverse=True)[:POPULATION]
    for k in range(children):
        a, b = rng.sample(range(len(rated)), 2)
        child = crossover(rated[min(a, b)][2], rated[max(a, b)][2], sizes, capacity, rng)
        rated = sorted([*rated, (rate(child), POPULATION + k, child)], key=lambda r: r[:2], reverse=True)[:POPULATION]
    return [b for _, _, b in rated]


def pieces(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; only documents over the capacity are cut."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = end_id.to_bytes(4, "little")
        for b in batches:
            rows = []
            for doc, raw in zip(b.column(0).to_pylist(), encoder(tokenizer).encode(b.column(1).to_pylist())):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cells = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cells, kinds)], names)

    prepare(df.sparkSession)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


_PLACED = StructType([StructField("uid", LongType()), StructField("head", LongType()), StructField("at", LongType()), StructField("room", IntegerType())])


def place(items: DataFrame, capacity: int, level: int) -> DataFrame:
    """(uid, head, at, room) of ``items`` (uid, length), each shorter than the capacity.

    ``head`` is the smallest uid of the bin, ``at`` the place in it, ``room`` what the bin has free.
    """
    n = items.count()
    blocks = max(1, -(-n // BLOCK))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks)))
    elite = "block long, island int, rank int, size int, fill double, uids array<long>, sizes array<int>, bins array<int>"

    def population(table: pa.Table) -> tuple[list[int], list[int], list[Bins]]:
        """Uids, sizes and bins of the rows of an island; rows of one block share uids and sizes."""
        rows = table.sort_by([("size", "ascending"), ("fill", "descending"), ("island", "ascending"), ("rank", "ascending")]).to_pylist()
        found = []
        for r in rows:
            bins: dict[int, list[int]] = {}
            for i, k in enumerate(r["bins"]):
                bins.setdefault(k, []).append(i)
            if list(bins.values()) not in found:
                found.append(list(bins.values()))
        return rows[0]["uids"], rows[0]["sizes"], found

    def elites(block: int, island: int, uids: list[int], sizes: list[int], best: list[Bins]) -> pa.Table:
        rows = []
        for rank, bins in enumerate(best[:2]):
            of = [0] * len(sizes)
            for k, b in enumerate(bins):
                for i in b:
                    of[i] = k
            size, fill = fitness(bins, sizes, capacity)
            rows.append((block, island, rank, -size, fill, uids, sizes, of))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = ["block", "island", "rank", "size", "fill", "uids", "sizes", "bins"]
        return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    def first(key: tuple, table: pa.Table) -> pa.Table:
        block, island = (k.as_py() for k in key)
        table = table.sort_by("uid")
        uids, sizes = table["uid"].to_pylist(), [int(x) for x in table["length"].to_pylist()]
        return elites(block, island, uids, sizes, evolve(sizes, capacity, [], CHILDREN, block * 31 + island))

    def later(key: tuple, table: pa.Table) -> pa.Table:
        block, island = (k.as_py() for k in key)
        uids, sizes, found = population(table)
        return elites(block, island, uids, sizes, evolve(sizes, capacity, found, CHILDREN, block * 37 + island))

    def final(table: pa.Table) -> pa.Table:
        uids, sizes, found = population(table)
        rows = []
        for b in found[0]:
            b = sorted(b, key=lambda i: uids[i])
            at, room = 0, capacity - sum(sizes[i] for i in b)
            for i in b:
                rows.append((uids[i], uids[b[0]], at, room))
                at += sizes[i]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], _PLACED.fieldNames())

    islands = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    found = islands.groupBy("block", "island").applyInArrow(first, elite)
    for _ in range(EPOCHS - 1):
        # an elite stays at home and also goes to the next island
        moved = found.withColumn("to", F.explode(F.array(F.col("island"), ((F.col("island") + 1) % ISLANDS).cast("int"))))
        moved = moved.select("block", F.col("to").alias("island"), "rank", "size", "fill", "uids", "sizes", "bins")
        found = moved.groupBy("block", "island").applyInArrow(later, elite)
    return found.groupBy("block").applyInArrow(final, _PLACED)


def _bins(placed: DataFrame) -> int:
    return placed.where("uid = head").count()


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (any columns and ``length``) with sequence_id and offset; no sequence is longer than the capacity."""
    found = written(found.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    rest = found.where(F.col("length") < capacity).select(F.col("_uid").alias("uid"), "length")
    done, level, loose = [], 0, None
    while True:
        placed = written(place(rest, capacity, level), "placed")
        if loose is not None and _bins(placed) >= _bins(loose):
            done.append(loose)  # dealing again saved nothing
            break
        loose = placed.where(F.col("room") > WASTE)
        if placed.count() <= BLOCK:
            done.append(placed)
            break
        done.append(placed.where(F.col("room") <= WASTE))
        rest = written(loose.select("uid").join(rest, "uid"), "loose")
        level += 1
    places = done[0]
    for more in done[1:]:
        places = places.unionByName(more)
    out = found.join(places.select(F.col("uid").alias("_uid"), "head", "at"), "_uid", "left")
    return out.select(
        *[c for c in found.columns if c != "_uid"],
        F.coalesce("head", "_uid").alias("sequence_id"),
        F.coalesce("at", F.lit(0).cast("long")).alias("offset"),
    )


def op4(df: DataFrame, tokenizer: str) -> DataFrame:
    return pack(pieces(df, tokenizer))
