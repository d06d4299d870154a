"""Repeated word windows across documents, found behind a count-min sketch of their anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstats.llm.bytes_of import as_signed, run_hashes, sliding_minimum, text_pieces, word_hashes
from fieldstats.llm.common import IdFilter, settled

#: Rows of the count-min sketch. An anchor's counters, one a row, lie in one block of 64 a row.
SKETCH_ROWS = 3
#: Counters a row for each counted anchor, so that the sketch is as full at any size.
COUNTERS_PER_ANCHOR = 16
#: Anchors that a stretch of the sketch, merged in one task, holds on average.
STRETCH_ANCHORS = 1 << 17
#: Anchors a task counts before it gives its sketch out, and partitions merged at once.
COUNTED_AT_ONCE, MERGED_AT_ONCE = 1 << 21, 256
#: Groups with over 1 / this of all repeated windows are hot: fewer than this many.
HOT_SHARE = 1_000
#: Words of an anchor, at most the window's.
ANCHOR_WORDS = 20


def _anchors(words: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For each window its anchor: the smallest hash among its runs of ``anchor`` words.

    Equal windows have equal anchors, so a window is repeated at most as often as its anchor.
    """
    return sliding_minimum(run_hashes(words, anchor), window - anchor + 1)


def _texts(column: pa.Array, window: int, anchor: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, word hashes, second hashes, anchors by window) of each text."""
    for first, data, offsets in text_pieces(column):
        words, at = word_hashes(data, offsets, lower=False)
        again, _ = word_hashes(data, offsets, lower=False, seed=0x5851F42D)
        least = _anchors(words, window, anchor)
        for i in range(len(offsets) - 1):
            a, b = at[i], at[i + 1]
            yield first + i, words[a:b], again[a:b], least[a : max(a, b - window + 1)]


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def survey_texts(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """Per row of (``_id``, ``_xx``, ``_text``): words, a digest of the word sequence, its
    hash as kept text, and its distinct anchors as ``cells`` (63 bits)."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, cells, shas = [], [], [], [], []
            for _, words, again, least in _texts(batch.column(2), window, anchor):
                n.append(len(words))
                weights = np.arange(1, 2 * len(words), 2, dtype=np.uint64)
                one.append(int(as_signed((words * weights).sum(keepdims=True))[0]))
                two.append(int(as_signed((again * weights).sum(keepdims=True))[0]))
                if len(least):
                    changed = np.ones(len(least), bool)
                    changed[1:] = least[1:] != least[:-1]
                    least = np.unique(least[changed] >> np.uint64(1))
                cells.append(as_signed(least))
            for text in batch.column(2):
                shas.append(_sha((text.as_py() or "").encode().split()))
            edges = np.cumsum([0, *map(len, cells)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(n, pa.int64()),
                    pa.array(one, pa.int64()),
                    pa.array(two, pa.int64()),
                    pa.array(shas, pa.string()),
                    pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([np.zeros(0, np.int64), *cells]))),
                ],
                names=["_id", "_xx", "n_words", "_one", "_two", "_sha", "cells"],
            )

    return rows.mapInArrow(survey, "_id long, _xx long, n_words long, _one long, _two long, _sha string, cells array<long>")


class Sketch:
    """A count-min sketch of anchors, spread over ``stretches`` of its blocks.

    A block has 64 counters in each of ``SKETCH_ROWS`` rows; an anchor's hash names its block
    and one counter a row there. Counters say none, one or more, which is all that is asked.
    Tasks count the anchors of their partition; these sketches are merged by adding counters,
    up to ``MERGED_AT_ONCE`` partitions at a time, stretch by stretch. An anchor's estimate is the
    least of its counters, never below its count.
    """

    def __init__(self, anchors: int, width: int | None = None) -> None:
        counters = width or COUNTERS_PER_ANCHOR * anchors
        self.blocks = max(1, -(-counters // 64))
        stretches = min(self.blocks, max(1, anchors // STRETCH_ANCHORS))
        self.span = -(-self.blocks // stretches) * SKETCH_ROWS * 64
        #: A counter's place in its stretch, doubled, plus one where it counts more than one.
        self.kind = np.uint32 if 2 * self.span < 1 << 32 else np.uint64

    def counters(self, anchors: np.ndarray) -> np.ndarray:
        """Numbers of all counters of the anchors."""
        block = (anchors >> 18) % self.blocks * SKETCH_ROWS
        return np.concatenate([(block + r) * 64 + (anchors >> 6 * r & 63) for r in range(SKETCH_ROWS)])

    def of_partitions(self, rows: DataFrame) -> DataFrame:
        """``stretch``, ``part`` (number of the partition) and ``counts`` of the column ``cells``."""

        def given(held: list[np.ndarray], part: int) -> pa.RecordBatch:
            counter, n = np.unique(self.counters(np.concatenate(held)), return_counts=True)
            stretch, first = np.unique(counter // self.span, return_index=True)
            packed = ((counter % self.span) * 2 + (n > 1)).astype(self.kind)
            counts = [x.tobytes() for x in np.split(packed, first[1:])]
            return pa.RecordBatch.from_arrays(
                [pa.array(stretch), pa.array(np.full(len(stretch), part)), pa.array(counts, pa.binary())], names=["stretch", "part", "counts"]
            )

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, held = TaskContext.get().partitionId(), []
            for batch in batches:
                held.append(batch.column(0).flatten().to_numpy())
                if sum(map(len, held)) >= COUNTED_AT_ONCE:
                    yield given(held, part)
                    held = []
            if sum(map(len, held)):
                yield given(held, part)

        return rows.select("cells").mapInArrow(count, "stretch long, part long, counts binary")

    def _added(self, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The counters of a stretch that are set, and whether they count more than one."""
        packed = np.frombuffer(b"".join(table.column("counts").to_pylist()), self.kind)
        place, which = np.unique(packed >> self.kind(1), return_inverse=True)
        return place, np.bincount(which, 1 + (packed & self.kind(1)), len(place)) > 1

    def merged(self, parts: DataFrame, most: int) -> DataFrame:
        """``_block`` and a row's counters above one as bits, for blocks that have any in each row.

        ``most`` is the largest ``part``.
        """

        def add(table: pa.Table) -> pa.Table:
            place, more = self._added(table)
            counts = (place * self.kind(2) + more.astype(self.kind)).tobytes()
            return pa.table({"stretch": table.column("stretch")[:1], "part": table.column("part")[:1], "counts": pa.array([counts], pa.binary())})

        def bits(table: pa.Table) -> pa.Table:
            place, more = self._added(table)
            place = place[more].astype(np.int64)
            block, which = np.unique(place // (64 * SKETCH_ROWS), return_inverse=True)
            held = np.zeros((SKETCH_ROWS, len(block)), np.uint64)
            np.bitwise_or.at(held, (place // 64 % SKETCH_ROWS, which), np.uint64(1) << (place % 64).astype(np.uint64))
            full = (held > 0).all(0)
            first = table.column("stretch")[0].as_py() * (self.span // (64 * SKETCH_ROWS))
            return pa.table({"_block": first + block[full]} | {f"_bits{r}": as_signed(held[r][full]) for r in range(SKETCH_ROWS)})

        while most >= MERGED_AT_ONCE:
            most //= MERGED_AT_ONCE
            parts = parts.withColumn("part", F.floor(F.col("part") / MERGED_AT_ONCE))
            parts = parts.groupBy("stretch", "part").applyInArrow(add, "stretch long, part long, counts binary")
        columns = ", ".join(f"_bits{r} long" for r in range(SKETCH_ROWS))
        return parts.groupBy("stretch").applyInArrow(bits, f"_block long, {columns}")

    def block_of(self, anchor: Column) -> Column:
        return F.shiftright(anchor, 18) % F.lit(self.blocks)

    def above_one(self, anchor: str) -> Column:
        """Whether the estimate of the column, on a row of its block, is above one."""
        rows = [f"shiftright(_bits{r}, cast(shiftright({anchor}, {6 * r}) & 63 as int)) & 1 = 1" for r in range(SKETCH_ROWS)]
        return F.expr(" and ".join(rows))


def flagged_windows(flagged: DataFrame, window: int, anchor: int) -> DataFrame:
    """Windows whose anchor's cell is flagged: id, place and a 128-bit hash of their words.

    ``flagged`` has ``_id``, ``_xx``, ``_text`` and the flagged ``cells``.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, xx = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for row, words, again, least in _texts(batch.column(2), window, anchor):
                own = batch.column(3)[row].values.to_numpy().view(np.uint64)
                at = np.flatnonzero(np.isin(least >> np.uint64(1), own))
                one, two = run_hashes(words, window), run_hashes(again, window, 0xC2B2AE3D)
                for column, values in zip(
                    out, (np.full(len(at), ids[row]), np.full(len(at), xx[row]), at.astype(np.int32), as_signed(one[at]), as_signed(two[at]))
                ):
                    column.append(values)
                if len(out[0]) == 200 or row == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["_id", "_xx", "at", "_h1", "_h2"])
                    out = [[], [], [], [], []]

    return flagged.select("_id", "_xx", "_text", "cells").mapInArrow(
        windows, "_id long, _xx long, at int, _h1 long, _h2 long"
    )


def _cut(rows: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """Texts without the words under the windows ``at``: counts, hash and, if asked, text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, texts = [], [], []
            for text, places in zip(batch.column(2), batch.column(3)):
                words = (text.as_py() or "").encode().split()
                step = np.zeros(len(words) + 1, np.int32)
                at = np.asarray(places.as_py(), np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + window, -1)
                gone = np.cumsum(step[:-1]) > 0
                kept = [w for w, g in zip(words, gone) if not g]
                removed.append(int(gone.sum()))
                shas.append(_sha(kept))
                texts.append(b" ".join(kept).decode() if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())],
                names=["_id", "_xx", "_removed", "_cut_sha", "_cut_text"],
            )

    return rows.select("_id", "_xx", "_text", "places").mapInArrow(
        cut, "_id long, _xx long, _removed long, _cut_sha string, _cut_text string"
    )


def remove_repeats(
    df: DataFrame, id_col: str, text_col: str, window: int = 50, anchor: int = ANCHOR_WORDS, width: int | None = None, keep_text: bool = False
) -> DataFrame:
    """Per document: id, ``n_words``, ``n_removed``, ``kept_sha256`` (and ``kept_text``).

    A word goes if a window of ``window`` words over it also starts in a document with a
    smaller id. Documents of equal words are folded first: all but those with the smallest
    id lose everything. Then two passes. In the first every text is reduced to the anchors of its
    windows; partitions count them in count-min sketches, which are merged (``Sketch``). A window
    is in no more documents than the estimate of its anchor, so an estimate of one rules out
    its windows for good. In the second, texts with other anchors give those windows' 128-bit
    hashes, and grouping by them finds the smallest id exactly. Nothing that is repeated is lost.
    ``width`` is the counters of a row; unset, it follows the counted anchors.

    Counts and minima are combined before each shuffle. The joins that hand them back have
    one row per block, window or text on one side, and exchanges of their own, so that Spark
    can split what is hot; hot groups of windows, fewer than ``HOT_SHARE``, are broadcast and their
    windows dealt by place.

    Null texts have no words. Null ids rank behind all others. Rows that repeat an id are no
    repeats of each other; repeated rows get equal results. Texts shorter than the window, and
    empty tables, pass unchanged.
    """
    last = (1 << 63) - 1
    anchor = min(anchor, window)
    rows = df.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(last)).alias("_id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("_xx"),
        F.col(f"`{text_col}`").alias("_text"),
    )
    survey = settled(survey_texts(rows, window, anchor))
    by_words = F.concat_ws(":", "n_words", F.hex("_one"), F.hex("_two"))
    long_ones = survey.filter(F.col("n_words") >= window)
    first = (
        long_ones.groupBy("n_words", "_one", "_two").agg(F.min("_id").alias("_first")).select(by_words.alias("_words"), "_first")
    )
    folded = settled(
        long_ones.withColumn("_words", by_words)
        .join(first, "_words")
        .select("_id", "_xx", "_first", F.when(F.col("_id") == F.col("_first"), F.col("cells")).alias("cells"))
    )
    counted = folded.filter(F.col("cells").isNotNull())
    sizes = counted.select(F.size("cells").alias("_n"), F.spark_partition_id().alias("_part"))
    size = sizes.agg(F.sum("_n").alias("anchors"), F.max("_part").alias("most")).first()
    sketch = Sketch(size["anchors"] or 0, width)
    repeated = sketch.merged(sketch.of_partitions(counted), size["most"] or 0)
    cells = counted.select("_id", "_xx", F.explode("cells").alias("_cell"))
    flagged = settled(
        cells.withColumn("_block", sketch.block_of(F.col("_cell")))
        .join(repeated, "_block")
        .filter(sketch.above_one("_cell"))
        .groupBy("_id", "_xx")
        .agg(F.collect_list("_cell").alias("cells"))
    )
    passing = rows.filter(IdFilter(flagged, "_id").may_hold(F.col("_id")))
    with_text = settled(flagged.join(passing, ["_id", "_xx"]).dropDuplicates(["_id", "_xx"]))
    windows = flagged_windows(with_text, window, anchor)
    groups = settled(
        windows.groupBy("_h1", "_h2")
        .agg(F.min("_id").alias("_least"), F.max("_id").alias("_most"), F.count("*").alias("_n"))
        .filter(F.col("_least") < F.col("_most"))
        .select(F.col("_h1").alias("_g1"), F.col("_h2").alias("_g2"), "_least", "_n")
    )
    total = groups.agg(F.sum("_n")).first()[0] or 0
    hot = groups.filter(F.col("_n") * HOT_SHARE > total).select(
        F.col("_g1").alias("_h1"), F.col("_g2").alias("_h2"), F.col("_least").alias("_hot_least")
    )
    # A hot window has its minimum by now; its key is its place, so that it is dealt anywhere.
    dealt = windows.join(F.broadcast(hot), ["_h1", "_h2"], "left").withColumn(
        "_g1", F.when(F.col("_hot_least").isNull(), F.col("_h1")).otherwise(F.xxhash64("_id", "_xx", "at"))
    ).withColumn("_g2", F.when(F.col("_hot_least").isNull(), F.col("_h2")).otherwise(F.lit(0)))
    places = (
        dealt.join(groups.select("_g1", "_g2", "_least"), ["_g1", "_g2"], "left")
        .filter(F.col("_id") > F.coalesce("_hot_least", "_least"))
        .groupBy("_id", "_xx")
        .agg(F.collect_set("at").alias("places"))
    )
    cut = _cut(places.join(with_text.drop("cells"), ["_id", "_xx"]), window, keep_text)
    copies = folded.filter(F.col("_id") > F.col("_first")).select("_id", "_xx", F.lit(True).alias("_copy")).distinct()
    ids = survey.drop("cells").join(copies, ["_id", "_xx"], "left").join(cut, ["_id", "_xx"], "left")
    gone = F.lit(hashlib.sha256(b"").hexdigest())
    out = ids.select(
        F.when(F.col("_id") != last, F.col("_id")).cast(df.schema[id_col].dataType).alias(id_col),
        "n_words",
        F.when(F.col("_copy"), F.col("n_words")).otherwise(F.coalesce("_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("_copy"), gone).otherwise(F.coalesce("_cut_sha", "_sha")).alias("kept_sha256"),
        *([F.when(F.col("_copy"), F.lit("")).otherwise(F.col("_cut_text")).alias("changed_text")] if keep_text else []),
    )
    return out
