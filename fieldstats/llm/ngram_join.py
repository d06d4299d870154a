"""Near-duplicate texts: exact Jaccard join of word shingles through count vectors."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats.llm.bytes_of import as_signed, mixed, run_hashes, text_pieces, word_hashes
from fieldstats.llm.common import IdFilter, gathered
from fieldstats.llm.components import components, joined
from fieldstats.llm.count_tree import CountTree

U = np.uint64
#: Groups that shingles are hashed into: coordinates of a count vector.
GROUPS = 64
#: Finer groups of which only the parity of the count is kept: a power of two, at least twice as
#: many as shingles. With fewer than half as many as shingles they rule out no pair; sets larger
#: than ``MOST_PARITIES`` are bounded by these first, then by as many as they need.
LEAST_PARITIES, MOST_PARITIES = 512, 16_384
#: Words of parities that are compared at once.
_WORDS_AT_ONCE = 500_000
#: Members of a cell that one task compares with as many others.
CHUNK = 2_048
#: Keys that one task brings together, and keys that a task holds before it gives them out.
KEYS_PER_BUCKET, _KEYS_AT_ONCE = 500_000, 500_000
#: Bytes of shingle sets that a task holds before it gives them out.
_SET_BYTES_AT_ONCE = 4_000_000
#: Rows of ``points`` in a partition: a few thousand bytes each.
_POINTS_TOGETHER = 5_000
#: Members of a cell in one row.
_MEMBERS = 1_000
#: Upper ends of the size classes grow by this factor.
_GROWTH = 1.5


class Threshold:
    """Jaccard similarity of at least num / den, in whole numbers.

    For sets of sizes a and b, similar ones differ in at most (a + b) (den - num) / (den +
    num) elements, and share at least (a + b) num / (den + num).
    """

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        ends, x = [], 1.0
        while x < 1e12:
            if not ends or int(x) > ends[-1]:
                ends.append(int(x))
            x *= _GROWTH
        self.ends = ends
        self.differ = [2 * e * (den - num) // (den + num) for e in ends]
        #: Blocks of a class: so many more than sets can differ in that next to no set has too
        #: many empty ones, whose keys hold nothing and are shared by unlike sets.
        self.blocks = [d + 3 + d // 4 for d in self.differ]

    def classes(self, size: int) -> list[int]:
        """The own class of a set of this size and those that larger similar sets can have."""
        own = bisect_left(self.ends, size)
        out = [own]
        while size * self.den >= self.num * (self.ends[out[-1]] + 1):
            out.append(out[-1] + 1)
        return [c for c in out if self.differ[c]]

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least overlap that sets of sizes a and b must have."""
        return -(-(a + b) * self.num // (self.num + self.den))


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of k-word shingles) of each text, A-Z lower-cased.

    Fewer than k words are one shingle; no words are none.
    """
    for first, data, offsets in text_pieces(column):
        words, at = word_hashes(data, offsets, lower=True)
        runs = run_hashes(words, k)
        for i in range(len(offsets) - 1):
            a, b = at[i], at[i + 1]
            if b - a >= k:
                yield first + i, np.unique(runs[a : b - k + 1])
            else:
                yield first + i, run_hashes(words[a:b], b - a) if b > a else runs[:0]


def cell_keys(shingles: np.ndarray, threshold: Threshold) -> np.ndarray:
    """Keys of the cells of a set: similar but unequal sets have one in common.

    A class cuts the range of hashes in more blocks than similar sets can differ in, so
    some block of both holds the same shingles; its key is a hash of class, block and those
    shingles. As long as more blocks hold something than sets can differ in, that
    block can be chosen among these; a set with fewer adds keys for its empty blocks.
    """
    keys = []
    spread = mixed(shingles)
    for c in threshold.classes(len(shingles)):
        m = threshold.blocks[c]
        block = ((shingles >> U(32)) * U(m)) >> U(32)
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        names = block[starts] + (U(c) << U(40))
        keys.append(mixed(np.add.reduceat(spread, starts) + mixed(names + U(1))))
        if len(starts) <= threshold.differ[c]:
            empty = np.setdiff1d(np.arange(m, dtype=U), block[starts])
            keys.append(mixed(mixed(empty + (U(c) << U(40)) + U(1))))
    return np.concatenate(keys) if keys else shingles[:0]


def survey_sets(rows: DataFrame, k: int) -> DataFrame:
    """Per row of (``_id``, ``_text``): set size and a 128-bit digest of the set."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two = [], [], []
            for _, s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                one.append(_digest(s))
                two.append(int(as_signed(mixed(s * U(0xA24BAED4963EE407) + U(1)).sum(keepdims=True))[0]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())],
                names=["_id", "n", "_one", "_two"],
            )

    return rows.select("_id", "_text").mapInArrow(survey, "_id long, n long, _one long, _two long")


def _digest(shingles: np.ndarray) -> int:
    return int(as_signed(mixed(shingles).sum(keepdims=True))[0])


def set_cells(rows: DataFrame, k: int, threshold: Threshold, buckets: int, dealt_ids: IdFilter | None = None) -> DataFrame:
    """(``cell``, ``size``, ``one``): the members, by digest, of cells with several sets.

    With ``dealt_ids`` only rows whose ``_id`` it may hold are dealt.

    ``cell`` stands for all the cells that have these ``size`` members.

    A key is dealt to one of ``buckets`` by its upper bits; a task gives out, per bucket, one
    block of 11 bytes a key: 40 bits that tell keys of a bucket apart and 48 bits of the set's
    digest. Where such bits of different keys or sets agree, that only brings sets
    together that are compared in vain. Sets that a batch holds several times are given out
    once.
    """

    passed = dealt_ids.passing() if dealt_ids else lambda batch: batch

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(passed, batches):
            seen: set[int] = set()
            ones, keys, many = [], [], 0
            for row, s in shingle_sets(batch.column(0), k):
                one = _digest(s)
                if one not in seen:
                    seen.add(one)
                    own = cell_keys(s, threshold)
                    ones.append(np.full(len(own), one))
                    keys.append(own)
                    many += len(own)
                if many and (many > _KEYS_AT_ONCE or row == batch.num_rows - 1):
                    yield _blocks(np.concatenate(keys), np.concatenate(ones), buckets)
                    ones, keys, many = [], [], 0

    def meet(bucket: pa.Table) -> pa.Table:
        bytes_ = np.frombuffer(b"".join(x.as_buffer() for x in bucket.column("block")), np.uint8).reshape(-1, 11)
        pairs = np.zeros((2, len(bytes_), 8), np.uint8)
        pairs[0, :, :5], pairs[1, :, :6] = bytes_[:, :5], bytes_[:, 5:]
        keys, ones = pairs.view(U)[:, :, 0]
        order = np.lexsort((ones, keys))
        keys, ones = keys[order], ones[order]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (ones[1:] != ones[:-1])]
        keys, ones = keys[new], ones[new]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[starts, len(keys)])
        cell = np.add.reduceat(mixed(ones), starts) * U(3) + size.astype(U)
        # One cell of each membership, and those with a single set left out.
        _, once = np.unique(cell, return_index=True)
        once = once[size[once] > 1]
        raw = ones.view(np.uint8).reshape(-1, 8)[:, :6]
        rows = [
            (int(as_signed(cell[i : i + 1])[0]), int(size[i]), part, raw[at : min(at + _MEMBERS, starts[i] + size[i])].tobytes())
            for i in once
            for part, at in enumerate(range(starts[i], starts[i] + size[i], _MEMBERS))
        ]
        columns = list(zip(*rows)) or [[], [], [], []]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("cell", "size", "part", "ones"), columns, types)})

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = [_wide(x.as_buffer(), 6) for x in batch.column(2)]
            many = np.array([len(m) for m in members], np.int64)
            columns = [np.repeat(batch.column(i).to_numpy(), many) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), pa.array(np.concatenate([np.zeros(0, np.int64), *members]))], names=["cell", "size", "one"]
            )

    places = [dealt_ids.places(F.col("_id"))] if dealt_ids else []
    dealt = rows.select("_text", *places).mapInArrow(deal, "bucket long, block binary")
    cells = dealt.groupBy("bucket").applyInArrow(meet, "cell long, size long, part int, ones binary")
    once = cells.groupBy("cell", "size", "part").agg(F.any_value("ones").alias("ones"))
    return once.select("cell", "size", "ones").mapInArrow(told, "cell long, size long, one long")


def _wide(packed: pa.Buffer, bytes_each: int) -> np.ndarray:
    out = np.zeros((len(packed) // bytes_each, 8), np.uint8)
    out[:, :bytes_each] = np.frombuffer(packed, np.uint8).reshape(-1, bytes_each)
    return out.view(np.int64)[:, 0]


def _blocks(keys: np.ndarray, ones: np.ndarray, buckets: int) -> pa.RecordBatch:
    bucket = (((keys >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    block = np.empty((len(keys), 11), np.uint8)
    block[:, :5] = keys[order].view(np.uint8).reshape(-1, 8)[:, :5]
    block[:, 5:] = ones[order].view(np.uint8).reshape(-1, 8)[:, :6]
    bucket = bucket[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    edges = np.r_[starts, len(bucket)].astype(np.int32) * 11
    blob = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(block)])
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), blob], names=["bucket", "block"])


def packed_counts(shingles: np.ndarray) -> bytes:
    """The count vector of a set, in as few bytes a count as the largest needs."""
    counts = np.bincount((shingles % U(GROUPS)).astype(np.int64), minlength=GROUPS)
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def count_vectors(packed: list[pa.Buffer]) -> np.ndarray:
    """A row of counts for each of ``packed_counts``."""
    out = np.zeros((len(packed), GROUPS), np.int64)
    each = np.array([len(x) // GROUPS for x in packed], np.int64)
    for size in np.unique(each):
        rows = np.flatnonzero(each == size)
        out[rows] = np.frombuffer(b"".join(packed[i] for i in rows), f"u{size}").reshape(-1, GROUPS)
    return out


def packed_parities(shingles: np.ndarray, most: int) -> bytes:
    """The parities of a set, one bit for each group; with ``most`` groups at most."""
    groups = min(most, max(LEAST_PARITIES, 1 << (2 * len(shingles)).bit_length()))
    fine = np.bincount(((shingles >> U(20)) % U(groups)).astype(np.int64), minlength=groups)
    return np.packbits(fine & 1).tobytes()


class Parities:
    """What ``packed_parities`` gave out for several sets, of any numbers of groups."""

    def __init__(self, packed: list[pa.Buffer]) -> None:
        self.words = np.frombuffer(b"".join(packed), U)
        self.many = np.array([len(x) // 8 for x in packed], np.int64)
        self.starts = np.cumsum(self.many) - self.many

    def folded(self, rows: np.ndarray, width: int) -> np.ndarray:
        """The parities of these sets in ``width`` words: groups are joined, a power of two each."""
        out = np.zeros((len(rows), width), U)
        for at in range(0, int(self.many[rows].max(initial=0)), width):
            more = np.flatnonzero(self.many[rows] > at)
            out[more] ^= self.words[(self.starts[rows[more]] + at)[:, None] + np.arange(width)]
        return out

    def unlike(self, rows: np.ndarray, other: Parities, others: np.ndarray) -> np.ndarray:
        """For each two sets, how many groups have counts of unlike parity."""
        out = np.zeros(len(rows), np.int64)
        widths = np.minimum(self.many[rows], other.many[others])
        for width in np.unique(widths):
            all_at = np.flatnonzero(widths == width)
            step = max(1, _WORDS_AT_ONCE // int(width))
            for at in (all_at[i : i + step] for i in range(0, len(all_at), step)):
                bits = self.folded(rows[at], int(width)) ^ other.folded(others[at], int(width))
                out[at] = np.bitwise_count(bits).sum(1, dtype=np.int64)
        return out


def points(rows: DataFrame, k: int, wanted: DataFrame, whole: bool = True, most: int = MOST_PARITIES) -> DataFrame:
    """Per row of ``wanted`` (``_id`` and more): set size, shingle hashes (if ``whole``), count
    vector and parities (``most`` at most), as bytes.

    The texts themselves are not shuffled: a filter of the wanted ids goes to them, and only
    what passes is reduced to its set and meets the ids exactly.
    """
    names = ["_id", "n", *(["shingles"] if whole else []), "counts", "parity"]
    wanted_ids = IdFilter(wanted, "_id")
    passed = wanted_ids.passing()

    def given(ids: pa.Array, n: list, sets: list, counts: list, parity: list) -> pa.RecordBatch:
        blobs = [pa.array(x, pa.binary()) for x in ([sets] if whole else []) + [counts, parity]]
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), *blobs], names=names)

    def point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(passed, batches):
            n, sets, counts, parity = [], [], [], []
            first = held = 0
            for row, s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                if whole:
                    sets.append(s.tobytes())
                    held += s.nbytes
                counts.append(packed_counts(s))
                parity.append(packed_parities(s, most))
                if held >= _SET_BYTES_AT_ONCE or row == batch.num_rows - 1:
                    yield given(batch.column(0).slice(first, len(n)), n, sets, counts, parity)
                    n, sets, counts, parity = [], [], [], []
                    first, held = row + 1, 0

    kinds = {"_id": "long", "n": "long"}
    schema = ", ".join(f"{c} {kinds.get(c, 'binary')}" for c in names)
    return rows.select("_id", "_text", wanted_ids.places(F.col("_id"))).mapInArrow(point, schema).join(wanted, "_id")


def allowed(pairs: DataFrame, vectors: DataFrame, threshold: Threshold) -> DataFrame:
    """The pairs (a, b) that sizes, count vectors and parities do not rule out.

    Similar sets share at least ``need`` shingles, so the minima of their counts sum up to that,
    and groups with counts of unlike parity are no more than the sets differ in.
    """

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = lambda i: [x.as_buffer() for x in batch.column(i)]  # noqa: E731, B023
            n, m = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            need = threshold.shared(n, m)
            fit = np.minimum(n, m) >= need
            fit &= np.minimum(count_vectors(packed(3)), count_vectors(packed(6))).sum(1) >= need
            left = np.flatnonzero(fit)
            fit[left] = Parities(packed(4)).unlike(left, Parities(packed(7)), left) <= (n + m - 2 * need)[left]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(fit)) for c in batch.columns[:2]], names=["a", "b"])

    side = lambda c, end: vectors.select(F.col("_id").alias(c), *[F.col(x).alias(f"_{x}{end}") for x in ("n", "counts", "parity")])
    met = pairs.join(side("b", 2), "b").join(side("a", 1), "a")
    return met.select("a", "b", *[f"_{x}{end}" for end in (1, 2) for x in ("n", "counts", "parity")]).mapInArrow(bound, "a long, b long")


def sharpened(pairs: DataFrame, large: DataFrame, rows: DataFrame, k: int, threshold: Threshold) -> DataFrame:
    """The settled pairs (a, b) without those of two ``large`` sets that more parities rule out.

    ``large`` has the ``_id`` of sets that ``MOST_PARITIES`` bound loosely or not at all.
    """
    if large.isEmpty():
        return pairs
    both = pairs
    for c in ("a", "b"):
        both = both.join(large.select(F.col("_id").alias(c)), c, "left_semi")
    both = gathered(both.select("a", "b"))
    if both.isEmpty():
        return pairs
    vectors = gathered(points(rows, k, gathered(_ids(both)), whole=False, most=1 << 40), _POINTS_TOGETHER, parallel=True)
    return gathered(pairs.join(both, ["a", "b"], "left_anti").unionByName(allowed(both, vectors, threshold)))


def similar(pairs: DataFrame, threshold: Threshold) -> DataFrame:
    """The pairs (a, b) whose sets ``_x`` and ``_y`` are similar.

    Count vectors rule most others out before the shingles are compared.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), U), np.frombuffer(right[i].as_buffer(), U)
                need = int(threshold.shared(len(x), len(y)))
                if min(len(x), len(y)) < need:
                    continue
                cx = np.bincount((x % U(GROUPS)).astype(np.int64), minlength=GROUPS)
                cy = np.bincount((y % U(GROUPS)).astype(np.int64), minlength=GROUPS)
                if np.minimum(cx, cy).sum() >= need:
                    good[i] = len(np.intersect1d(x, y, assume_unique=True)) >= need
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], names=["a", "b"])

    return pairs.select("a", "b", "_x", "_y").mapInArrow(check, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, threshold: Threshold) -> DataFrame:
    """The similar ones of the settled pairs (a, b)."""
    x = sets.select(F.col("_id").alias("a"), F.col("shingles").alias("_x"))
    y = sets.select(F.col("_id").alias("b"), F.col("shingles").alias("_y"))
    return similar(pairs.join(y, "b").join(x, "a"), threshold)


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()


def _needed(sets: DataFrame, ids: DataFrame) -> DataFrame:
    return sets.filter(IdFilter(ids, "_id").may_hold(F.col("_id")))


def tree_pairs(members: DataFrame, threshold: Threshold) -> DataFrame:
    """Pairs (a, b) of a cell, in different components, that the count vectors allow.

    ``members`` has ``key``, ``size`` (of the cell), ``_id``, ``part`` (component so far), ``n``,
    ``counts`` and ``parity``. What the tree leaves is bounded once more: sets differ in at
    least as many shingles as groups have counts of unlike parity. A cell of more than ``CHUNK``
    members is cut in chunks by hash; each two of them meet in a task of their own.
    """
    chunks = F.ceil(F.col("size") / CHUNK)
    dealt = (
        members.withColumn("_chunk", F.pmod(F.xxhash64("_id"), chunks))
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
        .withColumn("tile", F.least("_chunk", "_other") * 1_000_000 + F.greatest("_chunk", "_other"))
        .select("key", "tile", "_chunk", "_id", "part", "n", "counts", "parity")
    )

    def search(tile: pa.Table) -> pa.Table:
        ids, part = tile.column("_id").to_numpy(), tile.column("part").to_numpy()
        size, chunk = tile.column("n").to_numpy(), tile.column("_chunk").to_numpy()
        packed = lambda name: [x.as_buffer() for x in tile.column(name)]
        tree = CountTree(count_vectors(packed("counts")).astype(np.int32), size)
        low, high = divmod(tile.column("tile")[0].as_py(), 1_000_000)
        x, y = tree.pairs(threshold)
        fit = part[x] != part[y]
        if low != high:
            fit &= chunk[x] != chunk[y]
        x, y = x[fit], y[fit]
        parities = Parities(packed("parity"))
        fit = np.zeros(len(x), bool)
        for at in range(0, len(x), 50_000):
            i, j = x[at : at + 50_000], y[at : at + 50_000]
            fit[at : at + 50_000] = parities.unlike(i, parities, j) <= size[i] + size[j] - 2 * threshold.shared(size[i], size[j])
        x, y = ids[x[fit]], ids[y[fit]]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return dealt.groupBy("key", "tile").applyInArrow(search, "a long, b long").distinct()


def near_texts(
    df: DataFrame, id_col: str, text_col: str, k: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (smallest id reachable by links).

    Two texts link when their sets of k-word shingles have Jaccard similarity num / den or
    more. No link is lost and none is guessed:

    1. Texts of equal sets are folded; the smallest id stands for them.
    2. Sets are dealt to cells (``cell_keys``), such that similar ones share one. The
       cells are the grid that divides the index among tasks; a set has as many as it can differ
       in, so a cell holds at most a small share of the rows even when a third of all texts
       are copies of one.
    3. In each cell the smallest id is compared with the others: bounded by the summed
       minima of their count vectors and by parities, then, if these allow it, verified on the
       shingles; first each text with the smallest id that is left to it, then what is still
       in different components. That connects most groups.
    4. Cells whose members are still in different components are searched by an R-tree over
       count vectors for pairs of different components, and what it finds is verified.

    Null texts have no words; texts without words have size 0 and link with nothing. Rows with a
    null id get a size, a null component and no links. Ids are taken for unique: rows that repeat an id and a text
    are copies of each other. Empty tables give empty results.
    """
    threshold = Threshold(num, den)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    survey = gathered(survey_sets(rows, k))
    full = survey.filter((F.col("n") > 0) & F.col("_id").isNotNull())
    folds = gathered(full.groupBy("n", "_one", "_two").agg(F.min("_id").alias("rep")))
    total = full.agg(F.sum("n")).first()[0] or 0
    buckets = 1 + int(total * 4 * (den - num) / (den + num) / KEYS_PER_BUCKET)
    # Copies stay at home: one text of each set is dealt.
    found = set_cells(rows.filter(F.col("_id").isNotNull()), k, threshold, buckets, IdFilter(folds, "rep"))
    short = folds.select(F.col("_one").bitwiseAND(F.lit((1 << 48) - 1)).alias("one"), F.col("rep").alias("_id"))
    members = gathered(found.join(short, "one").select("cell", "size", "_id"))
    lows = members.groupBy("cell").agg(F.min("_id").alias("a")).select((F.col("cell") + 0).alias("_cell"), "a")
    cells = members.join(lows, F.col("cell") == F.col("_cell")).select("a", F.col("_id").alias("b")).filter("a < b")
    stars = gathered(cells.distinct())
    # Whole sets are fetched only for pairs that the small vectors allow.
    vectors = gathered(points(rows, k, gathered(_ids(stars)), whole=False), _POINTS_TOGETHER, parallel=True)
    large = gathered(vectors.filter(F.col("n") > MOST_PARITIES).select("_id"))
    near = sharpened(gathered(allowed(stars, vectors, threshold)), large, rows, k, threshold)
    sets = gathered(points(rows, k, gathered(_ids(near))), _POINTS_TOGETHER, parallel=True)
    first = gathered(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    linked = verified(first, sets, threshold)
    parts = components(linked)
    root = lambda c: parts.select(F.col("id").alias(c), F.col("component_id").alias(f"_{c}"))
    apart = gathered(
        near.join(first, ["a", "b"], "left_anti")
        .join(root("a"), "a", "left")
        .join(root("b"), "b", "left")
        .filter(F.coalesce("_a", "a") != F.coalesce("_b", "b"))
        .select("a", "b")
    )
    # Only sets that these pairs may need are shuffled; the other pairs need next to all.
    needed = _needed(sets, apart.select(F.explode(F.array("a", "b")).alias("_id")))
    parts = joined(parts, verified(apart, needed, threshold))

    crowded = members.filter(F.col("size") > 2)
    placed = gathered(
        crowded.join(parts.withColumnRenamed("id", "_id"), "_id", "left").select(
            F.col("cell").alias("key"), "size", "_id", F.coalesce("component_id", "_id").alias("part")
        )
    )
    mixed_cells = (
        placed.groupBy("key")
        .agg(F.min("part").alias("_low"), F.max("part").alias("_high"))
        .filter(F.col("_low") < F.col("_high"))
        .select((F.col("key") + 0).alias("_key"))
    )
    open_members = placed.join(mixed_cells, F.col("key") == F.col("_key")).drop("_key")
    found = tree_pairs(open_members.join(vectors, "_id"), threshold)
    # Both name the smaller id a.
    found = sharpened(gathered(found.join(stars, ["a", "b"], "left_anti")), large, rows, k, threshold)
    more = verified(found, gathered(points(rows, k, gathered(_ids(found))), _POINTS_TOGETHER, parallel=True), threshold)
    whole = joined(parts, more).withColumnRenamed("id", "rep")
    by_set = F.concat_ws(":", "n", F.hex("_one"), F.hex("_two"))
    named = folds.join(whole, "rep", "left").select(by_set.alias("_set"), F.coalesce("component_id", "rep").alias("component_id"))
    alone = F.when(F.col("_id").isNotNull() & (F.col("n") > 0), by_set)
    return (
        survey.select("_id", "n", alone.alias("_set"))
        .join(named, "_set", "left")
        .select(
            F.col("_id").cast(df.schema[id_col].dataType).alias(id_col),
            F.col("n").alias("n_shingles"),
            F.coalesce("component_id", "_id").cast(df.schema[id_col].dataType).alias("component_id"),
        )
    )
