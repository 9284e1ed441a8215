"""Most similar vectors for every vector: shifted Hilbert orderings of projected vectors.

Each ordering turns the vectors by its own random rotation, keeps the first ``dims`` coordinates, shifts and quantises
them and sorts the vectors along a Hilbert curve. Spark range-partitions every ordering by its key; what is moved is the key,
a number and a short code of the vector, a byte per entry. In each partition a vector is compared, by its code, with the
``window`` vectors before and after it; the windows that a cut between two partitions divides are merged from the edges of
both. The best of all orderings are merged and reranked once by exact cosine. Every vector is indexed; only pairs that no
ordering brings near are missed.

A window says little about a vector in a dense group larger than itself: keys tell its members apart badly or not at all.
Vectors whose windows are crowded are therefore compared exactly with all vectors of their length, in tiles; on demand, so
are those whose windows hold nothing near.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from folioframe.operators.skew import lookup
from folioframe.stash import Stash


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points given by non-negative integer coordinates below 2 ** bits.

    ``cells``: points x dimensions, dimensions * bits <= 63. The usual transpose form: undo the excess work per bit
    from the top, Gray-encode, then interleave the bits.
    """
    axes = [cells[:, j].astype(np.int64) for j in range(cells.shape[1])]
    top = 1 << (bits - 1)
    bit = top
    while bit > 1:
        below = bit - 1
        for j, axis in enumerate(axes):
            inverted = (axis & bit) != 0
            swap = np.where(inverted, 0, (axes[0] ^ axis) & below)
            if j:
                axes[j] = axis ^ swap
            axes[0] = axes[0] ^ np.where(inverted, below, swap if j else 0)
        bit >>= 1
    for j in range(1, len(axes)):
        axes[j] = axes[j] ^ axes[j - 1]
    flip = np.zeros_like(axes[0])
    bit = top
    while bit > 1:
        flip ^= np.where((axes[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    key = np.zeros_like(axes[0])
    for shift in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ flip) >> shift) & 1)
    return key


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and unit vectors of the usable rows; scaled by the largest entry first, so that squares neither vanish nor overflow."""
    for batch in batches:
        lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        for width in np.unique(lengths[lengths > 0]):
            part = batch.filter(pa.array(lengths == width))
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(width))  # nulls become NaN
            top = np.abs(flat).max(axis=1)
            ok = np.isfinite(flat).all(axis=1) & (top > 0)
            flat = flat[ok] / top[ok][:, None]
            unit = (flat / np.linalg.norm(flat, axis=1)[:, None]).astype(np.float32) + np.float32(0)  # no negative zeros
            offsets = pa.array(np.arange(len(unit) + 1, dtype=np.int32) * int(width))
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(ok)), pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))], names=["id", "unit"])


_KEYED = "width int, ordering int, key bigint, num bigint, asked boolean, code binary"
_NEAR = "num bigint, other bigint, cosine double, cut int, place int, curve bigint, asked boolean, code binary"


def _binary(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _codes(column: pa.Array) -> np.ndarray:
    """Unit vectors from codes of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), -1).astype(np.float32)
    return raw / np.linalg.norm(raw, axis=1)[:, None]


def _keyed(orderings: int, dims: int, bits: int, seed: int):
    frames: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def frame(width: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if width not in frames:
            made = []
            for o in range(orderings):
                rng = np.random.default_rng([seed, width, o])
                turn = np.linalg.qr(rng.standard_normal((width, width)))[0][:, : min(dims, width)]
                made.append((turn.astype(np.float32), rng.uniform(0, 1, min(dims, width))))
            frames[width] = made
        return frames[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(lengths):
                part = batch.filter(pa.array(lengths == width))
                unit = _matrix(part.column(2), int(width))
                code = _binary(np.rint(unit * (127 / np.abs(unit).max(axis=1))[:, None]).astype(np.int8))
                for o, (turn, shift) in enumerate(frame(int(width))):
                    # coordinates of a turned unit vector are about normal with deviation 1 / sqrt(width)
                    near_uniform = 1 / (1 + np.exp(-1.702 * np.sqrt(width) * (unit @ turn)))
                    cells = np.clip(((near_uniform * 0.9 + 0.1 * shift) * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, width, np.int32)), pa.array(np.full(n, o, np.int32)), pa.array(hilbert_keys(cells, bits)), part.column(0), part.column(1), code],
                        names=["width", "ordering", "key", "num", "asked", "code"],
                    )

    return run


def _near(num, other=None, cosine=None, cut=None, place=None, curve=None, asked=None, code=None) -> pa.RecordBatch:
    n = len(num)
    kinds = (other, pa.int64()), (cosine, pa.float64()), (cut, pa.int32()), (place, pa.int32()), (curve, pa.int64()), (asked, pa.bool_()), (code, pa.binary())
    made = [pa.nulls(n, kind) if x is None else x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in kinds]
    return pa.RecordBatch.from_arrays([pa.array(num, pa.int64()), *made], names=[f.split()[0] for f in _NEAR.split(", ")])


def _best(unit: np.ndarray, num: np.ndarray, asked: np.ndarray, window: int, keep: int, least: float, dense: float, crowd: int, apart: int | None = None, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The ``keep`` best of the window around each asked vector; with ``apart`` only across that place. A crowded vector is told by a row without another."""
    n = len(unit)
    for a in range(0, n, rows):
        b = min(n, a + rows)
        c, d = max(0, a - window), min(n, b + window)
        cos = unit[a:b] @ unit[c:d].T
        mine, others = np.arange(a, b)[:, None], np.arange(c, d)[None, :]
        hidden = (np.abs(mine - others) > window) | (mine == others)
        if apart is not None:
            hidden |= (mine < apart) == (others < apart)
        cos[hidden] = -2
        cos = cos[asked[a:b]]
        own = np.arange(a, b)[asked[a:b]]
        if not len(own):
            continue
        crowded = own[(cos >= dense).sum(axis=1) >= crowd]
        if len(crowded):
            yield _near(num[crowded])
        m = min(keep, d - c)
        best = np.argpartition(-cos, m - 1, axis=1)[:, :m]
        value = np.take_along_axis(cos, best, 1).ravel()
        ok = value >= max(least, -1.5)
        yield _near(num[np.repeat(own, m)[ok]], num[best.ravel()[ok] + c], value[ok].astype(np.float64))


def _windows(window: int, keep: int, least: float, dense: float, crowd: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None  # one range partition, its size is bounded
        if table is None or not table.num_rows:
            return
        here = TaskContext.get().partitionId()
        curve = table.column("width").to_numpy().astype(np.int64) * 1000 + table.column("ordering").to_numpy()
        num, asked = table.column("num").to_numpy(), table.column("asked").to_numpy()
        starts = np.flatnonzero(np.r_[True, curve[1:] != curve[:-1]])
        for lo, hi in zip(starts, np.r_[starts[1:], len(curve)]):
            yield from _best(_codes(table.column("code").slice(lo, hi - lo)), num[lo:hi], asked[lo:hi], window, keep, least, dense, crowd)
        # the edges go to the cuts before and after this partition; places below 0 lie before the cut
        n, edge = len(num), min(window, len(num))
        code = table.column("code").combine_chunks()
        code = code.chunk(0) if isinstance(code, pa.ChunkedArray) else code
        for cut, first, place in ((here - 1, 0, np.arange(edge)), (here, n - edge, np.arange(-edge, 0))):
            part = slice(first, first + edge)
            yield _near(num[part], cut=np.full(edge, cut, np.int32), place=place.astype(np.int32), curve=curve[part], asked=asked[part], code=code.slice(first, edge))

    return run


def _over_cuts(window: int, keep: int, least: float, dense: float, crowd: int):
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("place")
        curve, place = part.column("curve").to_numpy(), part.column("place").to_numpy()
        out = []
        for c in np.unique(curve):
            rows = part.filter(pa.array(curve == c))
            at = int((place[curve == c] < 0).sum())
            if 0 < at < rows.num_rows:
                out += _best(_codes(rows.column("code")), rows.column("num").to_numpy(), rows.column("asked").to_numpy(), window, keep, least, dense, crowd, at)
        return pa.Table.from_batches(out or [_near([])]).select(["num", "other", "cosine"])

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cls, other, u, v -> cls, other, cosine."""
    for batch in batches:
        widths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        for width in np.unique(widths):
            part = batch.filter(pa.array(widths == width))
            u, v = (_matrix(part.column(i), int(width)).astype(np.float64) for i in (2, 3))
            cos = np.einsum("ij,ij->i", u, v) / (np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cos)], names=["cls", "other", "cosine"])


def _tiles(k: int, least: float, rows: int = 256, spare: int = 16):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            width = int(left.column("width")[0].as_py())
            mine, others = left.column("cls").to_pylist(), np.array(right.column("cls").to_pylist(), object)
            q, u = (_matrix(t.column("unit").chunk(0), width) for t in (left, right))
            at = {c: i for i, c in enumerate(others)}
            own = np.array([at.get(c, -1) for c in mine])
            m = min(len(u), k + spare)
            for a in range(0, len(q), rows):
                part = q[a : a + rows].astype(np.float64)
                cos = q[a : a + rows] @ u.T
                here = np.flatnonzero(own[a : a + rows] >= 0)
                cos[here, own[a : a + rows][here]] = -2
                some = np.argpartition(-cos, m - 1, axis=1)[:, :m]
                # vectors of a dense group differ in digits that single precision no longer has
                full = u[some].astype(np.float64)
                exact = np.einsum("ij,ikj->ik", part, full) / (np.linalg.norm(part, axis=1)[:, None] * np.linalg.norm(full, axis=2))
                exact[np.take_along_axis(cos, some, 1) < -1.5] = -2
                for i, (values, places) in enumerate(zip(exact, some)):
                    best = sorted(zip(-values, others[places]))[:k]
                    out += [(mine[a + i], o, -v) for v, o in best if -v >= max(least, -1.5)]
        cls, other, cosine = zip(*out) if out else ((), (), ())
        return pa.table({"cls": pa.array(cls, pa.string()), "other": pa.array(other, pa.string()), "cosine": pa.array(cosine, pa.float64())})

    return run


def exact_neighbours(queries: DataFrame, base: DataFrame, k: int, least: float, tile_rows: int = 16_384) -> DataFrame:
    """The ``k`` nearest of ``base`` (cls, unit) for each of ``queries`` (the same) within each pair of tiles: cls, other, cosine.

    Rows are cut into tiles by hash, and every tile of queries meets every tile of the base of its width, so a task
    holds two tiles however large the tables are; the work is the product of both sizes.
    """
    across, down = (max(1, -(-df.count() // tile_rows)) for df in (base, queries))
    spread = lambda df, mine, n, other, m: df.select(
        "cls", "unit", F.size("unit").alias("width"), F.pmod(F.xxhash64("cls"), F.lit(n)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)
    )
    left, right = spread(queries, "row", down, "col", across), spread(base, "col", across, "row", down)
    return left.groupBy("width", "row", "col").cogroup(right.groupBy("width", "row", "col")).applyInArrow(_tiles(k, least), "cls string, other string, cosine double")


def nearest_neighbours(
    rows: DataFrame, *, id_col: str = "id", vector_col: str = "vector", k: int = 5, min_cosine: float = -1.0, queries: Column | None = None, exact_below: float | None = None,
    orderings: int = 14, window: int = 96, dims: int = 12, bits: int = 4, seed: int = 7, partition_rows: int = 40_000, dense: float = 0.8, spare: int = 5,
) -> DataFrame:
    """For each id its ``k`` most similar other ids by cosine: id, ``other``, ``cosine``, ``rank``.

    Vectors that are null, empty, all zero, or hold a null, NaN or infinite value are unusable and neither query nor
    neighbour; vectors of different length are not compared. A repeated id counts once (its greatest vector by array
    order, if they differ). Ids with exactly the same direction form one class: it is indexed once and its members
    are each other's nearest, so a class of any size is no hot key. Ties of cosine are ordered by id. Fewer than k
    others, or only others below ``min_cosine``, give fewer rows.

    ``queries``, a condition on the column ``id``, says which ids are answered; all are indexed, and all answered without it.

    A vector that in some ordering has a quarter of ``window`` (2k at least) vectors of cosine ``dense`` or more beside it lies in
    a crowd; its neighbours are found exactly (``exact_neighbours``), which costs crowded vectors times all vectors. So are,
    with ``exact_below``, those of vectors whose k-th neighbour in the windows is less similar than that: far neighbours are as many as
    the directions are, and no ordering brings them near. Without it such vectors keep what the windows hold.
    ``spare``: so many candidates beyond k are reranked exactly, as codes are rounded.
    """
    spark = rows.sparkSession
    stash = Stash(spark)
    raw = rows.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    unit = raw.mapInArrow(_unit, "id string, unit array<float>")
    data = unit.groupBy("id").agg(F.max("unit").alias("unit")).withColumn("h", F.xxhash64("unit"))
    data = stash.put(data.withColumn("asked", F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))))
    alike = stash.put(data.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    classes, total = None, data.count()
    base = data.select(F.col("id").alias("cls"), "unit", "asked")
    if not alike.isEmpty():
        some, single = lookup(data, alike, "h", "n", total, "left_semi"), lookup(data, alike, "h", "n", total, "left_anti")
        classes = stash.put(some.groupBy("unit").agg(F.min("id").alias("cls"), F.max("asked").alias("asked"), F.count(F.lit(1)).alias("n")))
        base = classes.select("cls", "unit", "asked").unionByName(single.select(F.col("id").alias("cls"), "unit", "asked"))
    base = stash.put(base.withColumn("num", F.monotonically_increasing_id()))
    size = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("unit")).alias("width")).first()
    # a task holds one range partition: partition_rows codes of 64 numbers, fewer of longer ones, but more than a few windows
    each = max(4 * window, partition_rows * 64 // max(64, size["width"] or 64))
    parts = max(1, -(-size["n"] * orderings // each))
    keyed = base.select("num", "asked", "unit").mapInArrow(_keyed(orderings, dims, bits, seed), _KEYED)
    ordered = keyed.repartitionByRange(parts, "width", "ordering", "key", "num").sortWithinPartitions("width", "ordering", "key", "num")
    options = (window, k + spare, min_cosine - 0.02, dense, max(2 * k, window // 4))  # a rounded cosine is off by some thousandths
    found = stash.put(ordered.mapInArrow(_windows(*options), _NEAR))
    over = found.where("cut is not null").groupBy("cut").applyInArrow(_over_cuts(*options), "num bigint, other bigint, cosine double")
    near = found.where("cut is null").select("num", "other", "cosine").unionByName(over)
    # at most 2 * orderings * (k + spare) entries per vector
    entry = F.struct((-F.col("cosine")).alias("d"), F.col("other").alias("num"))
    told = near.groupBy("num", "other").agg(F.max("cosine").alias("cosine")).groupBy("num").agg(
        F.slice(F.array_sort(F.collect_list(F.when(F.col("other").isNotNull(), entry))), 1, k + spare).alias("best"), F.max(F.col("other").isNull()).alias("exact")
    )
    if exact_below is not None:
        weak = F.coalesce(-F.get("best", k - 1)["d"] < exact_below, F.lit(True))
        told = base.where("asked").select("num").join(told, "num", "left").withColumn("exact", F.coalesce("exact", F.lit(False)) | weak)
    told = stash.put(told)
    pairs = told.where("not exact").select("num", F.explode("best").alias("b")).select("num", F.col("b.num").alias("other"))
    one, two = base.select("num", "cls", F.col("unit").alias("u")), base.select(F.col("num").alias("other"), F.col("cls").alias("ocls"), F.col("unit").alias("v"))
    exact = pairs.join(one, "num").join(two, "other").select("cls", F.col("ocls").alias("other"), "u", "v").mapInArrow(_exact, "cls string, other string, cosine double")
    crowded = told.where("exact").select("num")
    if not crowded.isEmpty():
        asking = stash.put(base.join(crowded, "num", "left_semi").select("cls", "unit"))
        exact = exact.unionByName(exact_neighbours(asking, base.select("cls", "unit"), k, min_cosine))
    named = F.struct((-F.col("cosine")).alias("d"), F.col("other").alias("id"))
    merged = exact.groupBy("cls").agg(F.slice(F.array_sort(F.collect_list(named)), 1, k).alias("best"))  # k + spare, or k a tile
    repeated = classes is not None
    if repeated:
        merged = stash.put(merged)
    if repeated:
        members = lookup(some.select("id", "unit"), classes.select("unit", "cls", "n"), "unit", "n", total).select("cls", "id")
        # the first k + 1 of a class in two steps, so a class of any size is no single group
        salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
        for group in (["cls", "salt"], ["cls"]):
            salted = salted.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy("id"))).where(F.col("r") <= k + 1)
        heads = stash.put(salted.select("cls", "id"))
        wide = merged.select("cls", F.explode("best").alias("b")).select("cls", F.col("b.d").alias("d"), F.col("b.id").alias("ocls"))
        grown = wide.join(heads.withColumnRenamed("cls", "ocls"), "ocls", "left").select("cls", "d", F.coalesce("id", "ocls").alias("id"))
        own = heads.select("cls", F.lit(-1.0).alias("d"), "id")
        best = grown.unionByName(own).groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("d", "id"))).alias("best"))
        all_members = members.unionByName(single.select(F.col("id").alias("cls"), "id"))
        best = best.join(classes.select("cls", "n"), "cls", "left").select("cls", F.coalesce("n", F.lit(1)).alias("n"), F.slice("best", 1, k + 1).alias("best"))
        joined = lookup(all_members, stash.put(best), "cls", "n", total)
        merged = joined.select("id", F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k).alias("best"))
    else:
        merged = merged.withColumnRenamed("cls", "id")
    if queries is not None:
        merged = merged.where(F.coalesce(queries, F.lit(False)))
    out = merged.select(F.col("id"), F.posexplode("best").alias("pos", "b"))
    return out.select(
        F.col("id").alias(id_col), F.col("b.id").alias("other"), (-F.col("b.d")).alias("cosine"), (F.col("pos") + 1).alias("rank")
    ).where(F.col("cosine") >= min_cosine)


def similar_pairs(neighbours: DataFrame, id_col: str = "id") -> DataFrame:
    """Unordered pairs (``id_a`` < ``id_b``) of which one is a neighbour of the other, once each."""
    return neighbours.select(F.least(id_col, "other").alias("id_a"), F.greatest(id_col, "other").alias("id_b")).distinct()
