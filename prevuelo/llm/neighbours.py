"""Embedding near-duplicates by collision-counting projections.

Vectors are compared within one label only. Each is scaled to length 1 and projected on ``PROJECTIONS`` random lines. For
a query vector, the window of a line is centred on its own projection; a pair collides on a line if one lies in the
other's window. Pairs that collide on at least ``threshold`` lines are verified by their exact cosine. A pair at the
wanted cosine c differs on a line by a normal of deviation sqrt(2 - 2c), so the number of its collisions is binomial, and
the threshold is the largest count that at least ``RECALL`` of such pairs reach; closer pairs collide more often.

Equal vectors of a label are one point with a weight, so copies are never compared. The points of a label are sorted along
the first line and cut into blocks of about ``BLOCK``; a pair of blocks is one task's unit, so a label with a third of all
rows is many units. Blocks whose ranges on the first line are further apart than any pair at c (beyond ``RECALL``) are not
paired. A unit gives, per point, the summed weight of its links, and a spanning forest of the links: pairs never become
rows.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with nothing:
no links, their own component, kept. Vectors of different lengths do not link. Repeated vec_ids are rows of their own and
links between them count; a component takes the smallest vec_id it has. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prevuelo.llm.graph import components
from prevuelo.llm.simhash import forest
from prevuelo.llm.store import prepare, written

COSINE, PROJECTIONS, RECALL, BLOCK, SEED = 0.93, 48, 0.9995, 1024, 11
#: Half of a window, in deviations of a pair at the wanted cosine.
WINDOW = 1.5


def lines(dims: int) -> np.ndarray:
    """The projections' directions, the same in every task."""
    return np.random.default_rng([SEED, dims]).normal(size=(dims, PROJECTIONS))


def calibrated(cosine: float, recall: float = RECALL) -> tuple[float, int]:
    """Half of the window, and the number of collisions that ``recall`` of the pairs at ``cosine`` reach."""
    deviation = math.sqrt(2 - 2 * cosine)
    p = math.erf(WINDOW / math.sqrt(2))
    tail, count = 0.0, 0
    for k in range(PROJECTIONS + 1):
        tail += math.comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k)
        if tail > 1 - recall:
            break
        count = k + 1
    return WINDOW * deviation, count


def collisions(a: np.ndarray, b: np.ndarray, half: float) -> np.ndarray:
    """Lines on which each row of ``a`` has each row of ``b`` in its window; projections in columns."""
    count = np.zeros((len(a), len(b)), np.uint8)
    kind = np.uint16 if len(b) < 2**16 else np.uint32
    unit = half / 4096
    x, y = (np.clip(np.rint(m / unit), -(2**29), 2**29).astype(np.int32) for m in (a, b))
    for k in range(a.shape[1]):
        order = np.argsort(y[:, k], kind="stable")
        column = y[order, k]
        # the sorted line: a query's window is a run
        first = np.searchsorted(column, x[:, k] - 4097, "left")
        width = np.searchsorted(column, x[:, k] + 4097, "right") - first
        place = np.empty(len(order), kind)
        place[order] = np.arange(len(order), dtype=kind)
        # unsigned: what lies before the run wraps round and is too far as well
        count += place - first.astype(kind)[:, None] < width.astype(kind)[:, None]
    return count


def verified(a: np.ndarray, b: np.ndarray, cosine: float, half: float, least: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b) of the linked pairs; with ``same`` each pair of different rows once."""
    norm_a, norm_b = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    directions = lines(a.shape[1])
    count = collisions((a / norm_a[:, None]) @ directions, (b / norm_b[:, None]) @ directions, half)
    i, j = np.nonzero(np.triu(count, 1) >= least if same else count >= least)
    found_i, found_j = [], []
    for at in range(0, len(i), 100_000):
        p, q = i[at : at + 100_000], j[at : at + 100_000]
        ok = np.einsum("ij,ij->i", a[p], b[q]) / (norm_a[p] * norm_b[q]) >= cosine
        found_i.append(p[ok])
        found_j.append(q[ok])
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (i, j)


def points(df: DataFrame) -> DataFrame:
    """(label, dims, vector binary, weight, least vec_id, point): the different usable vectors of each label."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = df.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad & F.exists("embedding", lambda x: x != 0))
    # -0.0 + 0.0 is 0.0, so equal vectors are equal arrays
    same = usable.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("vector"))
    return same.groupBy("label", "vector").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))


def linked(nodes: DataFrame, cosine: float) -> DataFrame:
    """Rows (u, v, n): ``n`` more rows link to point ``u`` (v null), or a link of the spanning forest (n null)."""
    half, least = calibrated(cosine)
    reach = 3.5 * math.sqrt(2 - 2 * cosine)

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value = []
            for v in b.column(1).to_pylist():
                v = np.array(v)
                value.append(float((v / np.sqrt((v * v).sum())) @ lines(len(v))[:, 0]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(value, pa.float64())], ["point", "line"])

    def unit(table: pa.Table) -> pa.Table:
        sides = []
        left, right = table["left"][0].as_py(), table["right"][0].as_py()
        for side in dict.fromkeys((left, right)):
            mine = table.filter(pa.compute.equal(table["slab"], side)).sort_by("point")
            vectors = mine["vector"].combine_chunks()
            n = mine.num_rows
            data = vectors.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            sides.append((mine["point"].to_numpy(), mine["weight"].to_numpy(), data))
        (pa_, wa, a), (pb, wb, b) = sides[0], sides[-1]
        i, j = verified(a, b, cosine, half, least, left == right)
        total = np.bincount(i, wb[j], len(pa_)).astype(np.int64)
        other = np.bincount(j, wa[i], len(pb)).astype(np.int64)
        u, v = forest(pa_[i], pb[j])
        who = np.concatenate([pa_[total > 0], pb[other > 0]])
        n = np.concatenate([total[total > 0], other[other > 0]])
        nulls = lambda k, kind: pa.nulls(k, kind)
        return pa.table(
            {
                "u": pa.concat_arrays([pa.array(who, pa.int64()), pa.array(u, pa.int64())]),
                "v": pa.concat_arrays([nulls(len(who), pa.int64()), pa.array(v, pa.int64())]),
                "n": pa.concat_arrays([pa.array(n, pa.int64()), nulls(len(u), pa.int64())]),
            }
        )

    on_line = written(nodes.select("point", "vector").mapInArrow(along, "point long, line double"), "lines")
    keyed = nodes.select("point", "label", F.size("vector").alias("dims"))
    # slabs of equal length on the first line hold about BLOCK points; a fuller one is cut by hash
    width = written(
        keyed.join(on_line, "point").groupBy("label", "dims").agg(F.count("*").alias("n"), F.min("line").alias("low"), F.max("line").alias("high")),
        "widths",
    )
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK))
    placed = keyed.join(on_line, "point").join(width, ["label", "dims"])
    step = F.greatest((F.col("high") - F.col("low")) / parts, F.lit(1e-9))
    placed = placed.withColumn("slab", F.least(parts - 1, F.floor((F.col("line") - F.col("low")) / step)))
    sizes = written(placed.groupBy("label", "dims", "slab").agg(F.count("*").alias("held"), F.min("line").alias("a"), F.max("line").alias("b")), "slabs")
    cut = F.greatest(F.lit(1), F.ceil(F.col("held") / BLOCK))
    blocks = sizes.withColumn("cut", cut)
    named = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1)))
    named = named.select("label", "dims", F.struct("slab", "part").alias("id"), "a", "b")
    # block ids, not rows: as many as there are points / BLOCK
    one, two = named.alias("x"), named.alias("y")
    pairs = one.join(
        two,
        F.expr(f"x.label = y.label AND x.dims = y.dims AND x.id <= y.id AND y.a - x.b <= {reach} AND x.a - y.b <= {reach}"),
    ).select(F.col("x.label").alias("label"), F.col("x.dims").alias("dims"), F.col("x.id").alias("left"), F.col("y.id").alias("right"))
    pairs = written(pairs, "pairs")
    wanted = pairs.withColumn("id", F.col("left")).unionByName(pairs.where("left <> right").withColumn("id", F.col("right")))
    members = placed.join(blocks.select("label", "dims", "slab", "cut"), ["label", "dims", "slab"])
    members = members.select("point", "label", "dims", F.struct("slab", F.pmod(F.xxhash64("point"), F.col("cut")).alias("part")).alias("id"))
    rows = members.join(nodes.select("point", "vector", "weight"), "point").join(wanted, ["label", "dims", "id"])
    text = lambda c: F.concat_ws(".", f"{c}.slab", f"{c}.part").alias(c)
    rows = rows.select("label", "dims", text("left"), text("right"), F.concat_ws(".", "id.slab", "id.part").alias("slab"), "point", "vector", "weight")
    return rows.groupBy("label", "dims", "left", "right").applyInArrow(unit, "u long, v long, n long")


def near(df: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    prepare(df.sparkSession)
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    nodes = written(points(rows).withColumn("point", F.monotonically_increasing_id()), "points")
    found = written(linked(nodes, cosine), "links")
    counts = found.where("n IS NOT NULL").groupBy(F.col("u").alias("point")).agg(F.sum("n").alias("more"))
    joined = components(found.where("v IS NOT NULL").select("u", "v"))
    nodes = nodes.join(counts, "point", "left").join(joined.withColumnRenamed("node", "point"), "point", "left")
    nodes = nodes.withColumn("root", F.coalesce("component", "point"))
    nodes = written(nodes.select("label", "vector", "root", "least", (F.coalesce("more", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "nodes")
    ids = written(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    named = written(nodes.join(ids, "root").select("label", "vector", "n_links", "component_id"), "named")
    same = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    keyed = rows.select("vec_id", "label", same.alias("vector"))
    out = keyed.join(named, ["label", "vector"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def op7(df: DataFrame) -> DataFrame:
    return near(df)
