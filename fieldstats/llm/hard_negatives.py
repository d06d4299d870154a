"""Hard negatives by exact integer scores, multiplied in a residue number system."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstats.llm.common import as_key, settled

#: Chunks the rows are dealt to at least, and the rows of a chunk beyond that.
CHUNKS, CHUNK_ROWS = 32, 65_536
#: Components multiplied at once: 64 products of symmetric residues below 512 stay exact in float32.
_DEPTH = 64
#: Scores held at once.
_SCORES = 2_000_000


def _primes(below: int) -> list[int]:
    return [p for p in range(below - 1, 2, -1) if all(p % q for q in range(2, int(p**0.5) + 1))]


#: All odd primes whose symmetric residues allow exact sums of ``_DEPTH`` products, largest first.
PRIMES = _primes(1024)


def primes_for(bound: float) -> list[int]:
    """The fewest of the largest primes whose product tells apart all scores up to ``bound``."""
    chosen, product = [], 1
    for p in PRIMES:
        chosen.append(p)
        product *= p
        if product > 2 * int(bound) + 1:
            return chosen
    raise ValueError(f"no primes left for scores up to {bound}")


def residues(components: np.ndarray, prime: int) -> np.ndarray:
    """Whole numbers (as doubles of any size) by their symmetric residue, in float32."""
    r = np.fmod(components, prime)
    half = prime // 2
    return np.where(r > half, r - prime, np.where(r < -half, r + prime, r)).astype(np.float32)


def residue_product(left: np.ndarray, right: np.ndarray, prime: int) -> np.ndarray:
    """``left @ right.T`` modulo the prime, from residues, in 0 .. prime - 1."""
    total = np.zeros((len(left), len(right)), np.int32)
    for at in range(0, left.shape[1], _DEPTH):
        total += (left[:, at : at + _DEPTH] @ right[:, at : at + _DEPTH].T).astype(np.int32) % prime
    return total % prime


def reconstruct(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Signed numbers from their residues (Chinese remainders, mixed radix).

    64-bit while the primes' product allows it, else Python's whole numbers.
    """
    product = reduce(lambda a, b: a * b, primes)
    kind = np.int64 if product < 1 << 62 else object
    digits: list[np.ndarray] = []
    for part, p in zip(parts, primes):
        digit, scale = part.astype(np.int64), 1
        for d, q in zip(digits, primes):
            digit = (digit - d * scale) % p
            scale = scale * q % p
        digits.append(digit * pow(scale, -1, p) % p)
    value = digits[-1].astype(kind)
    for digit, p in zip(digits[-2::-1], primes[-2::-1]):
        value = value * p + digit
    return np.where(value > product // 2, value - product, value)


class Chunk:
    """Rows of one length: ids in order (null last), labels, components and their residues."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, labels: np.ndarray, components: np.ndarray) -> None:
        order = np.lexsort((ids, ~known))
        self.ids, self.known, self.labels, self.components = ids[order], known[order], labels[order], components[order]
        self.norm = float(np.sqrt((self.components**2).sum(1)).max())
        self.parts: dict[int, np.ndarray] = {}

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        # Cauchy and Schwarz, and room for the rounding of both norms.
        bound = self.norm * float(np.sqrt((anchors**2).sum(1)).max()) * (1 + 1e-6) + 1
        primes = primes_for(bound)
        parts = []
        for p in primes:
            if p not in self.parts:
                self.parts[p] = residues(self.components, p)
            parts.append(residue_product(residues(anchors, p), self.parts[p], p))
        return reconstruct(parts, primes)

    def ordered(self, scores: np.ndarray) -> np.ndarray:
        """One number a row that sorts by score, then by smaller id."""
        n = len(self.ids)
        if scores.dtype != object and n * (int(np.abs(scores).max(initial=0)) + 1) >= 1 << 62:
            scores = scores.astype(object)
        return scores * n + np.arange(n - 1, -1, -1)

    def first(self, ordered: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, row) of the first ``k`` allowed rows of each anchor."""
        n = ordered.shape[1]
        if ordered.dtype == object:
            low = min(ordered.min(), 0) - 1
            masked = np.where(allowed, ordered, low)
            best = np.argsort(masked, axis=1)[:, ::-1][:, :k]
        else:
            low = np.iinfo(np.int64).min
            masked = np.where(allowed, ordered, low)
            best = np.argpartition(masked, n - k, axis=1)[:, n - k :] if n > k else np.tile(np.arange(n), (len(masked), 1))
        anchor = np.repeat(np.arange(len(masked)), best.shape[1])
        row = best.ravel()
        taken = masked[anchor, row] > low
        return anchor[taken], row[taken]


def _components(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles from bytes; the width is what ``dim`` components of a row leave."""
    out = np.empty((len(column), dim))
    for i, value in enumerate(column.to_pylist()):
        out[i] = np.frombuffer(value, {2: "<i2", 4: "<i4", 8: "<f8"}[len(value) // dim])
    return out


def _unlike_before(rows: tuple[np.ndarray, ...], last: tuple[np.ndarray, ...] | None) -> np.ndarray:
    """Which rows differ from the row ahead of them; equal rows come one after the other."""
    fresh = np.zeros(len(rows[0]), bool)
    fresh[0] = last is None
    for values, before in zip(rows, last or rows):
        fresh[0] |= bool((values[0] != before[-1]).any())
        unlike = values[1:] != values[:-1]
        fresh[1:] |= unlike if unlike.ndim == 1 else unlike.any(1)
    return fresh


def _encode(scale: float):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            ends = np.cumsum(sizes)
            made, kept = [], []
            for i, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
                row = flat[end - size : end]
                if np.isfinite(row).all():
                    most = np.abs(row).max()
                    made.append(row.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8").tobytes())
                    kept.append(i)
            names = [n for n in batch.schema.names if n != "vector"]
            rest = batch.select(names).take(pa.array(kept, pa.int32()))
            dims = pa.array(sizes[kept].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*rest.columns, dims, pa.array(made, pa.binary())], names=[*names, "dim", "components"])

    return encode


def _search(k: int, windows: tuple[int, int] | None):
    """Rows of a chunk stream in first, then the anchors it is searched for.

    Without ``windows``, each anchor's first ``k`` other rows of its label; with (low, high)
    in percent, the first ``k`` of other labels whose score is that part of each positive's.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, chunk = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("dim", "chunk", "side")], 1)
            bounds = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(marks)]
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    continue
                dim, number, side = marks[a].tolist()
                part = batch.slice(a, b - a)
                ids = part.column("id")
                rows = (
                    ids.fill_null(0).to_numpy(),
                    np.array(ids.is_valid()),
                    part.column("label").to_numpy(),
                    _components(part.column("components"), dim),
                )
                if (dim, number) != key:
                    key, waiting, chunk = (dim, number), [], None
                if side == 0:
                    fresh = _unlike_before(rows, waiting[-1] if waiting else None)
                    if fresh.any():
                        waiting.append(tuple(x[fresh] for x in rows))
                elif waiting or chunk:
                    if chunk is None:
                        chunk, waiting = Chunk(*[np.concatenate(x) for x in zip(*waiting)]), []
                    step = max(1, _SCORES // len(chunk.ids))
                    for at in range(0, b - a, step):
                        yield found(chunk, part.slice(at, step), *[x[at : at + step] for x in rows])

    def found(chunk: Chunk, part: pa.RecordBatch, ids: np.ndarray, known: np.ndarray, labels: np.ndarray, components: np.ndarray) -> pa.RecordBatch:
        scores = chunk.scores(components)
        ordered = chunk.ordered(scores)
        same = labels[:, None] == chunk.labels[None, :]
        if windows is None:
            own = (ids[:, None] == chunk.ids[None, :]) & known[:, None] & chunk.known[None, :]
            hits = [(0, *chunk.first(ordered, same & ~own, k))]
        else:
            hits = []
            wanted = part.column("positives").to_pylist()
            for place in range(max(map(len, wanted), default=0)):
                goals = [w[place]["score"] if place < len(w) else None for w in wanted]
                low = np.array([1 if g is None else -(-windows[0] * g // 100) for g in goals], scores.dtype)
                high = np.array([0 if g is None else windows[1] * g // 100 for g in goals], scores.dtype)
                inside = ~same & (scores >= low[:, None]) & (scores <= high[:, None])
                hits.append((place, *chunk.first(ordered, inside, k)))
        place = np.concatenate([np.full(len(a), p, np.int32) for p, a, _ in hits] or [np.zeros(0, np.int32)])
        at = np.concatenate([a for _, a, _ in hits] or [np.zeros(0, np.int64)])
        row = np.concatenate([r for _, _, r in hits] or [np.zeros(0, np.int64)])
        return pa.RecordBatch.from_arrays(
            [
                part.column("anchor").take(pa.array(at)),
                pa.array(place),
                pa.array(chunk.ids[row], mask=~chunk.known[row]),
                # A score that no long holds ends the job here.
                pa.array([int(s) for s in scores[at, row]], pa.int64()),
            ],
            names=["anchor", "place", "id", "score"],
        )

    return search


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    id_col: str,
    vector_col: str,
    label_col: str,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: float = 256.0,
    chunks: int = CHUNKS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Per anchor and positive, the best rows of other labels in a window of scores.

    Columns: ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``,
    ``positive_score``, ``negative_score``. Components become floor(scale * x); a score is
    the whole-number inner product with the anchor; higher scores come first, ties by
    smaller id, a null id last. An anchor's positives are its first ``positives`` other
    rows of its label; its negatives score ``low`` to ``high`` percent of the positive.

    Rows with a null label, a null vector, or a component that is null or not finite (as
    such or times ``scale``) take no part, nor do empty vectors; a null id is no anchor. Rows
    can only be partners of anchors with as many components. Rows equal in id, label and
    components are one row; no row with the anchor's own id is "other". Scores are exact
    whatever their size; one in the result that a long cannot hold ends the job.

    Rows are dealt evenly, whatever their labels, to ``chunks`` chunks, or more once these
    would pass ``chunk_rows`` rows; every anchor visits every chunk, and a task holds one
    chunk and a strip of scores. What leaves a chunk is each anchor's best few.
    """
    v = F.col("vector")
    zero = F.lit(0).cast(vectors.schema[vector_col].dataType.elementType)
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{label_col}`").cast("long").alias("label"),
        F.col(f"`{vector_col}`").alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    ).filter(
        F.col("label").isNotNull()
        & v.isNotNull()
        & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ).withColumn("vector", F.transform(v, lambda x: x + zero))
    fields = "id long, label long, is_anchor boolean, dim int, components binary"
    encoded = rows.select("id", "label", "is_anchor", "vector").mapInArrow(_encode(scale), fields)
    anchors = settled(
        encoded.filter(F.col("is_anchor") & F.col("id").isNotNull()).drop("is_anchor").distinct()
    ).withColumn("anchor", F.monotonically_increasing_id())
    parts = max(chunks, -(-rows.count() // chunk_rows))
    # Equal rows get to one chunk, one after the other, and are folded there.
    spread = F.xxhash64(as_key("id", "label"), "components")
    none = "array<struct<id: bigint, score: bigint>>"
    dealt = encoded.select(
        "dim",
        F.pmod(spread, F.lit(parts)).cast("int").alias("chunk"),
        F.lit(0).alias("side"),
        F.lit(None).cast("long").alias("anchor"),
        "id",
        "label",
        "components",
        F.lit(None).cast(none).alias("positives"),
    )

    def searched(asked: DataFrame, k: int, windows: tuple[int, int] | None) -> DataFrame:
        visits = asked.select(
            "dim",
            F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("chunk"),
            F.lit(1).alias("side"),
            "anchor",
            "id",
            "label",
            "components",
            "positives",
        )
        streams = dealt.unionByName(visits).repartition("dim", "chunk").sortWithinPartitions("dim", "chunk", "side", "id", "label", "components")
        return streams.mapInArrow(_search(k, windows), "anchor long, place int, id long, score long")

    alone = searched(anchors.withColumn("positives", F.lit(None).cast(none)), positives, None)
    best = settled(
        _first(alone, ["anchor"], positives)
        .groupBy("anchor")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("best"))
        .select("anchor", F.transform("best", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("positives"))
    )
    asked = anchors.join(best, "anchor")
    hard = _first(searched(asked, negatives, (low, high)), ["anchor", "place"], negatives)
    chosen = F.get("positives", F.col("place"))
    return (
        hard.withColumnRenamed("id", "_negative")
        .join(anchors.select("anchor", F.col("id").alias("_anchor")), "anchor")
        .join(best, "anchor")
        .select(
            F.col("_anchor").alias("anchor_id"),
            chosen["id"].alias("positive_id"),
            "rank",
            F.col("_negative").alias("negative_id"),
            chosen["score"].alias("positive_score"),
            F.col("score").alias("negative_score"),
        )
    )
