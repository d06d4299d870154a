"""Near-duplicate vectors: a pigeonhole join over rotated low-dimensional blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats.llm.common import as_key, hex_hash, settled
from fieldstats.llm.components import components

#: Vectors the rotation is learned from, at most, chosen by hash; any rotation gives the same links.
ROTATION_SAMPLE = 4_096
#: Rows of a tile's side.
TILE = 4_096
#: Added to each block's budget, for the rounding of distances.
SLACK = 1e-6
#: Rows of a tile compared at once, and pairs verified at once.
_STRIP, _PAIRS = 512, 100_000


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``_id``, ``vector`` and its ``_key`` for vectors that can link.

    Left out: null ids, null and zero vectors, and those with a null or non-finite component.
    """
    v = F.col("vector")
    zero = F.lit(0).cast(vectors.schema[vector_col].dataType.elementType)
    return (
        vectors.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{vector_col}`").alias("vector"))
        .filter(
            F.col("_id").isNotNull()
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
            & F.exists(v, lambda x: x != 0)
        )
        .withColumn("vector", F.transform(v, lambda x: x + zero))
        .withColumn("_key", F.sha2(F.col("vector").cast("string"), 256))
    )


class Rotation:
    """An orthonormal basis, its blocks, and the blocks' budgets of squared distance.

    Unit vectors with cosine c are 2 - 2c apart, squared. The basis sorts directions by
    energy; each block gets the part of 2 - 2c that its energy is of the whole, so the
    budgets sum to 2 - 2c and a linked pair keeps at least one of them.
    """

    def __init__(self, sample: np.ndarray, cosine: float, block: int) -> None:
        energy, basis = np.linalg.eigh(sample.T @ sample)
        energy, basis = np.maximum(energy[::-1], 0), basis[:, ::-1]
        self.basis = np.ascontiguousarray(basis)
        self.cosine = cosine
        self.blocks = [(i, min(i + block, len(energy))) for i in range(0, len(energy), block)]
        share = np.array([energy[a:b].sum() for a, b in self.blocks]) / energy.sum()
        self.budgets = (2 - 2 * cosine) * share + SLACK
        self.widths = np.sqrt(self.budgets) * (1 + 1e-9)

    def cells(self, units: np.ndarray) -> np.ndarray:
        """Per block, in which stretch of its leading axis a vector lies."""
        lead = units @ self.basis[:, [a for a, _ in self.blocks]]
        return np.floor(lead / self.widths).astype(np.int64)


def _units(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _pairs(left: np.ndarray, right: np.ndarray, rotation: Rotation, block: int, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of a tile whose first block within budget is ``block``."""
    turned_l, turned_r = left @ rotation.basis, right @ rotation.basis
    a, b = rotation.blocks[block]
    low_l, low_r = turned_l[:, a:b].astype(np.float32), turned_r[:, a:b].astype(np.float32)
    size_l, size_r = (low_l**2).sum(1), (low_r**2).sum(1)
    limit = np.float32(rotation.budgets[block] + 1e-5)
    for at in range(0, len(left), _STRIP):
        strip = slice(at, at + _STRIP)
        near = low_l[strip] @ low_r.T
        near *= -2
        near += size_l[strip, None]
        near += size_r[None, :]
        found = np.flatnonzero(near.ravel() <= limit)
        for part in range(0, len(found), _PAIRS):
            x, y = np.divmod(found[part : part + _PAIRS], len(right))
            x += at
            if within:
                x, y = x[x < y], y[x < y]
            linked = np.einsum("ij,ij->i", left[x], right[y]) >= rotation.cosine
            x, y = x[linked], y[linked]
            gap = (turned_l[x] - turned_r[y]) ** 2
            inside = np.stack([gap[:, i:j].sum(1) for i, j in rotation.blocks], 1) <= rotation.budgets
            first = inside.argmax(1) == block
            x, y = x[first & inside[:, block]], y[first & inside[:, block]]
            if len(x):
                yield x, y


def _compare(tile: pa.Table, rotation: Rotation) -> pa.Table:
    """Per vector its number of links in the tile, and edges that connect what is linked."""
    key = tile.column("tile")[0].as_py()
    block, within = key >> 56, tile.column("side")[0].as_py() == 2
    side = tile.column("side").to_numpy()
    units = _units(tile.column("vector"))
    reps, copies = tile.column("rep").to_numpy(), tile.column("copies").to_numpy()
    left = np.flatnonzero(side != 1)
    right = left if within else np.flatnonzero(side == 1)
    links, root = np.zeros(len(reps), np.int64), np.arange(len(reps))
    for x, y in _pairs(units[left], units[right], rotation, block, within):
        x, y = left[x], right[y]
        np.add.at(links, x, copies[y])
        np.add.at(links, y, copies[x])
        a, b = np.concatenate([x, np.arange(len(root))]), np.concatenate([y, root])
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
    have, joined = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(root)))
    return pa.table(
        {
            "a": pa.array(np.concatenate([reps[have], reps[joined]])),
            "n": pa.array(np.concatenate([links[have], np.zeros(len(joined), np.int64)])),
            "b": pa.array(np.concatenate([reps[have], reps[root[joined]]])),
        }
    )


def linked_tiles(reps: DataFrame, rotation: Rotation, tile: int = TILE) -> DataFrame:
    """Rows (a, n, b): a has n more links; a and b are connected.

    In each block, the leading axis is cut in stretches as long as the block's budget
    reaches, so a pair within budget lies in one stretch or in two neighbours. A stretch
    is dealt out by hash in chunks of about ``tile`` vectors, and each two chunks that can
    hold pairs meet in one tile: a vector is sent once for each chunk it meets. A pair is
    counted in the first block that keeps its budget, so the tiles' counts add up. What the
    driver holds is one count per block and stretch, 2 / sqrt(SLACK) a block at most.
    """

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = rotation.cells(_units(batch.column(0)))
                for block in range(cells.shape[1]):
                    cell, n = np.unique(cells[:, block], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), block)), pa.array(cell), pa.array(n)], names=["block", "cell", "n"])

    counted = reps.select("vector").mapInArrow(stretches, "block long, cell long, n long").groupBy("block", "cell").agg(F.sum("n").alias("n")).collect()
    chunks = {(r["block"], r["cell"]): -(-r["n"] // tile) for r in counted}
    lowest = min((c for _, c in chunks), default=0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = rotation.cells(_units(batch.column(3)))
            draw = batch.column(2).to_numpy()
            rows, tiles, sides = [], [], []
            for i in range(len(cells)):
                for block, cell in enumerate(cells[i].tolist()):
                    own = chunks[block, cell]
                    mine = int(draw[i] % own)
                    head = (block << 56) | ((cell - lowest) << 41)
                    for other in range(own):
                        low, high = min(mine, other), max(mine, other)
                        tiles.append(head | (low << 20) | high)
                        sides.append(2 if low == high else 0 if mine == low else 1)
                    for other in range(chunks.get((block, cell + 1), 0)):
                        tiles.append(head | (1 << 40) | (mine << 20) | other)
                        sides.append(0)
                    for other in range(chunks.get((block, cell - 1), 0)):
                        tiles.append(((block << 56) | ((cell - 1 - lowest) << 41)) | (1 << 40) | (other << 20) | mine)
                        sides.append(1)
                    rows += [i] * (len(tiles) - len(rows))
                if len(rows) >= 20_000 or i == len(cells) - 1:
                    sent = batch.take(pa.array(rows, pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tiles, pa.int64()), pa.array(sides, pa.int32()), sent.column(0), sent.column(1), sent.column(3)],
                        names=["tile", "side", "rep", "copies", "vector"],
                    )
                    rows, tiles, sides = [], [], []

    kind = reps.schema["vector"].dataType.simpleString()
    dealt = reps.select("rep", "copies", F.pmod(F.xxhash64("rep"), F.lit(1 << 31)).alias("draw"), "vector").mapInArrow(
        deal, f"tile long, side int, rep long, copies long, vector {kind}"
    )
    return dealt.groupBy("tile").applyInArrow(lambda t: _compare(t, rotation), "a long, n long, b long")


def near_groups(
    vectors: DataFrame, id_col: str, vector_col: str, cosine: float = 0.9, block: int = 16, tile: int = TILE
) -> DataFrame:
    """Per row: id, ``n_links``, ``component_id``, ``kept`` (id is its component's smallest).

    Equal vectors are folded first and linked by count; the rest goes through
    ``linked_tiles``, where candidates of each block are verified by cosine in double
    precision. Every pair with ``cosine`` or more is found, whatever the rotation. Only
    vectors of the same length can link, so each length with two different vectors has its
    own rotation and tiles, one length after the other. Rows that
    ``usable`` leaves out link with nothing and are their own component; a row that
    repeats id and vector counts as one more copy. An empty table gives an empty table.
    """
    known = usable(vectors, id_col, vector_col)
    folded = settled(
        known.groupBy("vector").agg(F.min("_id").alias("rep"), F.count("*").alias("copies"), F.min("_key").alias("_key"))
    )
    plain = vectors.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{vector_col}`").alias("vector"))
    links = parts = None
    for length in [r["length"] for r in folded.groupBy(F.size("vector").alias("length")).count().orderBy("length").collect() if r["count"] > 1]:
        reps = folded.filter(F.size("vector") == length)
        sample = (
            reps.orderBy(hex_hash(as_key("rep"), "rotation")).limit(ROTATION_SAMPLE).select("vector").toArrow().column("vector")
        )
        found = settled(linked_tiles(reps, Rotation(_units(sample), cosine, block), tile))
        own = F.lit(length).alias("length")
        linked = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n")).select(own, "rep", "n")
        joined = components(found.filter(F.col("a") != F.col("b")).select("a", "b")).select(own, F.col("id").alias("rep"), "component_id")
        links, parts = (linked, joined) if links is None else (links.unionByName(linked), parts.unionByName(joined))
    groups = folded.select("_key", "rep", "copies", F.size("vector").alias("length"))
    if links is None:
        groups = groups.withColumns({"n": F.lit(0).cast("long"), "component_id": F.col("rep")})
    else:
        groups = (
            groups.join(links, ["length", "rep"], "left")
            .join(parts, ["length", "rep"], "left")
            .select("_key", "rep", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component_id", "rep").alias("component_id"))
        )
    zero = F.lit(0).cast(vectors.schema[vector_col].dataType.elementType)
    return (
        plain.select("_id", F.sha2(F.transform("vector", lambda x: x + zero).cast("string"), 256).alias("_key"))
        .join(groups.filter(F.col("_key").isNotNull()), "_key", "left")
        .select(
            F.col("_id").alias(id_col),
            F.when(F.col("_id").isNull(), F.lit(0)).otherwise(F.coalesce(F.col("copies") - 1 + F.col("n"), F.lit(0))).cast("long").alias("n_links"),
            F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id")).alias("component_id"),
            F.col("_id").eqNullSafe(F.coalesce("component_id", "_id")).alias("kept"),
        )
    )
