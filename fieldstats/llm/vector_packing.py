"""Vector bin packing of examples under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats.llm.byte_tokens import ByteTokens
from fieldstats.llm.common import settled

#: Examples that one task packs together; what is left over in its last bin is all it wastes.
TOGETHER = 8_192
#: Texts whose pieces are sent on together.
_TEXTS = 128


class Limits(NamedTuple):
    """What one sequence may hold: tokens, segments (pieces), tokens that bear loss."""

    tokens: int
    segments: int
    loss: int


class Shapes:
    """The distinct (tokens, loss) shapes of the examples that wait, with the examples of each."""

    def __init__(self, tokens: np.ndarray, loss: np.ndarray) -> None:
        self.at: dict[tuple[int, int], int] = {}
        self.waiting: list[list[tuple[int, int]]] = []
        self.size = np.zeros((0, 2))
        self.left = np.zeros(2)
        for i in np.lexsort((np.arange(len(tokens)), -loss, -tokens))[::-1].tolist():
            self.put(int(tokens[i]), int(loss[i]), (i, 0))

    def put(self, tokens: int, loss: int, example: tuple[int, int]) -> None:
        shape = self.at.setdefault((tokens, loss), len(self.waiting))
        if shape == len(self.waiting):
            self.waiting.append([])
            if shape == len(self.size):
                self.size = np.concatenate([self.size, np.full((max(64, shape), 2), np.inf)])
        self.waiting[shape].append(example)
        self.size[shape] = tokens, loss
        self.left += tokens, loss

    def take(self, shape: int) -> tuple[tuple[int, int], int, int]:
        tokens, loss = self.size[shape]
        example = self.waiting[shape].pop()
        self.left -= tokens, loss
        if not self.waiting[shape]:
            self.size[shape] = np.inf
        return example, int(tokens), int(loss)


def fill(tokens: np.ndarray, loss: np.ndarray, limits: Limits, least_cut: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """Rows (example, start, length, bin, offset) by the dot-product heuristic.

    One bin is open at a time. Of the examples that fit, it takes the one whose demand has
    the largest dot product with the room that is left, each dimension weighed by how much
    of it all waiting examples still ask for; as every piece is one segment, segments take
    part through the room only and add the same to each. An example beyond a limit by itself
    gets a bin of its own. With ``least_cut``, a bin that no example fits and that has at
    least so many tokens of room takes the first tokens of one that is too long, whose rest
    waits on; there, all but a piece's first token bear loss.
    """
    shapes = Shapes(tokens, loss)
    whole = np.array([limits.tokens, limits.loss], float)
    rows: list[tuple[int, int, int, int, int]] = []
    waiting, bins = len(tokens), 0
    while waiting:
        room, segments, offset = whole.copy(), limits.segments, 0
        while segments and waiting:
            fits = (shapes.size <= room).all(1)
            share = shapes.left / whole
            with np.errstate(invalid="ignore"):
                score = np.where(fits, (shapes.size / whole) @ (share * room / whole), -1.0)
            best = int(score.argmax())
            if score[best] >= 0:
                (example, start), length, own = shapes.take(best)
                waiting -= 1
            elif segments == limits.segments:
                best = int(np.where(np.isfinite(shapes.size[:, 0]), shapes.size[:, 0], -1).argmax())
                (example, start), length, own = shapes.take(best)
                waiting -= 1
                segments = 1
            elif least_cut and min(room[0], room[1] + 1) >= least_cut:
                length = int(min(room[0], room[1] + 1))
                best = int(np.where(np.isfinite(shapes.size[:, 0]), shapes.size[:, 0], -1).argmax())
                (example, start), full, _ = shapes.take(best)
                shapes.put(full - length, full - length - 1, (example, start + length))
                own = length - 1
            else:
                break
            rows.append((example, start, length, bins, offset))
            room -= length, own
            segments -= 1
            offset += length
        bins += 1
    return rows


def _bucketed(rows: DataFrame, together: int) -> DataFrame:
    """``rows`` (settled) numbered, and dealt evenly to buckets of about ``together``."""
    buckets = max(1, -(-rows.count() // together))
    return rows.withColumn("_row", F.monotonically_increasing_id()).withColumn(
        "_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets))
    )


def pack_examples(examples: DataFrame, id_col: str, tokens_col: str, loss_col: str, limits: Limits, together: int = TOGETHER) -> DataFrame:
    """Whole examples in sequences: id, ``tokens``, ``loss``, ``sequence_id``, ``segment``, ``offset``, ``fits``.

    ``tokens`` and ``loss`` count an example's tokens and those among them that bear loss
    (null: 0); nothing is cut. ``offset`` is the place of the first token, ``segment`` that of
    the example, both from 0. ``fits`` is false for an example that is beyond a limit alone and
    is alone in its sequence. Examples are dealt to buckets of about ``together`` rows whatever
    their ids, so repeated ids and rows are examples of their own and no bucket is hot; each
    task packs its own. An empty table gives an empty table.
    """
    count = lambda c: F.greatest(F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0)), F.lit(0))
    picked = examples.select(F.col(f"`{id_col}`").alias("_id"), count(tokens_col).alias("tokens"), count(loss_col).alias("loss"))
    kind = picked.schema["_id"].dataType.simpleString()

    def pack(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by("_row")
        tokens, loss = bucket.column("tokens").to_numpy(), bucket.column("loss").to_numpy()
        at, _, _, bins, offsets = np.array(fill(tokens, loss, limits), np.int64).reshape(-1, 5).T
        first = np.searchsorted(bins, bins)
        base = bucket.column("_bucket")[0].as_py() << 32
        fits = (tokens[at] <= limits.tokens) & (loss[at] <= limits.loss)
        return pa.table(
            {
                "_id": bucket.column("_id").take(pa.array(at)),
                "tokens": tokens[at],
                "loss": loss[at],
                "sequence_id": base + bins,
                "segment": (np.arange(len(at)) - first).astype(np.int32),
                "offset": offsets,
                "fits": fits,
            }
        )

    schema = f"_id {kind}, tokens long, loss long, sequence_id long, segment int, offset long, fits boolean"
    return _bucketed(settled(picked), together).groupBy("_bucket").applyInArrow(pack, schema).withColumnRenamed("_id", id_col)


def _wide(ids: bytes, length: int) -> bytes:
    """Ids as 32-bit bytes, from 16-bit ones if that is what ``length`` ids are kept in."""
    return ids if len(ids) == 4 * length else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def _remainders(
    df: DataFrame, id_col: str, text_col: str, path: str, capacity: int, end_id: int, keep_ids: bool
) -> DataFrame:
    """Per document its pieces of ``capacity`` ids and what is left.

    Columns ``_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``ids``: of what is
    left in 16 bits each where they fit; whole pieces keep theirs only if asked to, in 32.
    """

    def narrow(ids: bytes) -> bytes:
        wide = np.frombuffer(ids, "<u4")
        return wide.astype("<u2").tobytes() if wide.max() < 1 << 16 else ids

    end = np.array([end_id], "<u4").tobytes()
    kind = df.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ByteTokens.of(path)
        for batch in batches:
            for first in range(0, batch.num_rows, _TEXTS):
                rows: list[list] = [[], [], [], [], [], []]
                for i, text in enumerate(batch.column(1).slice(first, _TEXTS), first):
                    ids = tokens.ids(text.as_py() or "") + end
                    for at in range(0, len(ids), 4 * capacity):
                        part = ids[at : at + 4 * capacity]
                        n = len(part) // 4
                        kept = narrow(part) if n < capacity else part if keep_ids else None
                        for column, value in zip(rows, (i, at // 4, n, zlib.crc32(part), len(ids) // 4, kept)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows[0], pa.int32())), *[pa.array(r, pa.int64()) for r in rows[1:5]], pa.array(rows[5], pa.binary())],
                    names=["_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
                )

    picked = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return picked.mapInArrow(cut, f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def pack_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    tokenizer_path: str,
    limits: Limits = Limits(2048, 256, 2047),
    end_id: int = 1,
    least_cut: int = 16,
    together: int = TOGETHER,
    keep_ids: bool = False,
) -> DataFrame:
    """Documents' pieces in sequences of at most ``limits``, with next to no padding.

    Columns: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``
    and, if asked for, the pieces' ``ids`` as little-endian 32-bit bytes. A document's ids end
    with ``end_id``; a null or empty text is that id alone. Pieces as long as a sequence are one
    by themselves; the rest of each document is packed with others by ``fill``, cut only where a
    sequence would else have ``least_cut`` tokens of room or more. Documents are dealt to buckets
    whatever their ids: repeated ids, rows and texts are documents of their own. Each bucket's
    last sequence may be short. An empty table gives an empty table.
    """
    if limits.tokens < 1 or limits.segments < 1 or limits.loss < limits.tokens - 1:
        raise ValueError("a sequence must hold one piece as long as itself, all of it but its first token bearing loss")
    pieces = settled(_remainders(df, id_col, text_col, tokenizer_path, limits.tokens, end_id, keep_ids))
    kind = pieces.schema["_id"].dataType.simpleString()
    names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else [])]

    def pack(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by("_row")
        tokens, begin = bucket.column("length").to_numpy(), bucket.column("start").to_numpy()
        at, starts, lengths, bins, offsets = np.array(fill(tokens, tokens - 1, limits, least_cut), np.int64).reshape(-1, 5).T
        ids = [_wide(x, n) for x, n in zip(bucket.column("ids").to_pylist(), tokens.tolist())]
        parts = [ids[i][4 * s : 4 * (s + n)] for i, s, n in zip(at.tolist(), starts.tolist(), lengths.tolist())]
        where = pa.array(at)
        out = {
            "_id": bucket.column("_id").take(where),
            "start": begin[at] + starts,
            "length": lengths,
            "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
            "doc_tokens": bucket.column("doc_tokens").take(where),
            "sequence_id": (bucket.column("_bucket")[0].as_py() << 32) + bins,
            "offset": offsets,
            "ids": pa.array(parts, pa.binary()),
        }
        return pa.table({n: out[n] for n in names})

    schema = f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if keep_ids else "")
    rest = _bucketed(pieces.filter(F.col("length") < limits.tokens), together).groupBy("_bucket").applyInArrow(pack, schema)
    # Whole pieces count down from -1, so that no number is given twice.
    whole = pieces.filter(F.col("length") == limits.tokens).withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )
    return rest.unionByName(whole.select(*names)).withColumnRenamed("_id", id_col)
