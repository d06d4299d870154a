"""Language by code length: prediction by partial matching over bytes, per language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstats.llm.bytes_of import text_pieces
from fieldstats.llm.common import as_key, gathered, hash_number, hex_hash
from fieldstats.sources.io import lookup_table

#: Labelled documents a language is learned from, at most about so many, chosen by hash.
SAMPLE_PER_LANGUAGE = 4_000
#: Bytes of the longest context.
ORDER = 4
#: Entries (a context and a byte behind it) of a language's tree, of all orders together.
MOST_ENTRIES = 200_000
#: Codes whose lengths a task remembers, and bytes worked on at once.
REMEMBERED, STEP = 200_000, 500_000
UNKNOWN = "und"
#: Contexts before the first byte.
_START = 10


def _low(code: np.ndarray, many: int) -> np.ndarray:
    """The last ``many`` bytes of each code."""
    return code & ((1 << 8 * many) - 1)


def context_codes(data: np.ndarray, starts: np.ndarray, order: int, at: int, stop: int) -> np.ndarray:
    """The bytes from ``at`` to ``stop``, each with the ``order`` before it in its text as one number.

    ``starts`` are the places where texts begin; a text begins after line breaks.
    """
    places = np.arange(at, stop)
    age = places - starts[np.searchsorted(starts, places, side="right") - 1]
    code = data[at:stop].astype(np.int64)
    for k in range(1, order + 1):
        before = np.full(stop - at, _START, np.int64)
        before[max(0, k - at) :] = data[max(at - k, 0) : max(stop - k, 0)]
        code |= np.where(age >= k, before, _START) << (8 * k)
    return code


def _starts(offsets: np.ndarray) -> np.ndarray:
    return offsets[:-1][offsets[:-1] < offsets[1:]]


def count_contexts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang``, ``level``, ``code`` (``level`` context bytes and a byte) and ``n`` over the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                texts = batch.column(1).filter(pa.array(langs == lang))
                for _, data, offsets in text_pieces(texts, STEP):
                    for at in range(0, len(data), STEP):
                        codes = context_codes(data, _starts(offsets), order, at, min(len(data), at + STEP))
                        code, n = np.unique(codes, return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n)], names=["lang", "code", "n"]
                        )

    longest = (
        labelled.select("lang", "text")
        .mapInArrow(count, "lang string, code long, n long")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
    )
    levels = F.array(
        *[F.struct(F.lit(d).alias("level"), F.col("code").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("code")) for d in range(order + 1)]
    )
    return longest.select("lang", "n", F.inline(levels)).groupBy("lang", "level", "code").agg(F.sum("n").alias("n"))


def commonest(counts: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """The entries of each language with the largest counts, at most ``most`` of them.

    All of a count stay or none, by the histogram of counts. A shorter context has counted
    at least what a longer one has, so what is kept is a tree: with each entry its suffixes.
    """
    below = Window.partitionBy("lang").orderBy(F.desc("n"))
    least = (
        counts.groupBy("lang", "n")
        .agg(F.count("*").alias("many"))
        .withColumn("many", F.sum("many").over(below))
        .filter(F.col("many") <= most)
        .groupBy("lang")
        .agg(F.min("n").alias("least"))
    )
    return counts.join(least, "lang").filter(F.col("n") >= F.col("least")).drop("least")


class ContextTree:
    """Frozen byte contexts of one language, up to ``order`` bytes, with method C escapes.

    A context with N counts of q bytes gives n / (N + q) to a byte that it has and q / (N + q)
    to the escape to the next shorter context, in which the bytes of the longer one are left
    out. Contexts that were never seen are passed without cost. Behind the empty context each
    remaining byte value is as likely. Only contexts that occur are held: per level the
    sorted contexts with their sums, and the sorted entries with their counts.
    """

    def __init__(self, level: np.ndarray, code: np.ndarray, n: np.ndarray, order: int) -> None:
        self.order = order
        self.codes, self.counts, self.contexts, self.total, self.kinds = [], [], [], [], []
        #: What is left of the next shorter context behind an escape: its counts and its bytes.
        self.left, self.left_kinds = [], []
        for d in range(order + 1):
            own = level == d
            by_code = np.argsort(code[own])
            codes, counts = code[own][by_code].astype(np.int64), n[own][by_code].astype(np.int64)
            contexts, first = np.unique(codes >> 8, return_index=True)
            total = np.add.reduceat(counts, first) if len(first) else counts
            kinds = np.diff(np.append(first, len(codes)))
            if d and len(codes):
                tried = np.add.reduceat(self.counts[-1][_find(self.codes[-1], _low(codes, d))], first)
                parent = _find(self.contexts[-1], _low(contexts, d - 1))
                self.left.append(self.total[-1][parent] - tried)
                self.left_kinds.append(self.kinds[-1][parent] - kinds)
            elif d:
                self.left.append(counts)
                self.left_kinds.append(counts)
            self.codes.append(codes)
            self.counts.append(counts)
            self.contexts.append(contexts)
            self.total.append(total)
            self.kinds.append(kinds)

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Exact code length of each byte behind its context."""
        out = np.zeros(len(codes))
        rows, longer = np.arange(len(codes)), np.full(len(codes), -1)
        for d in range(self.order, -1, -1):
            if not len(self.codes[d]):
                continue
            here = codes[rows]
            node, entry = _find(self.contexts[d], _low(here >> 8, d)), _find(self.codes[d], _low(here, d + 1))
            total, kinds = self.total[d][node], self.kinds[d][node]
            if d < self.order and len(self.codes[d + 1]):
                behind = longer >= 0
                total = np.where(behind, self.left[d][longer], total)
                kinds = np.where(behind, self.left_kinds[d][longer], kinds)
            hit, escape = entry >= 0, (entry < 0) & (node >= 0) & (total > 0)
            out[rows[hit]] += np.log2((total + kinds)[hit] / self.counts[d][entry[hit]])
            out[rows[escape]] += np.log2((total + kinds)[escape] / kinds[escape])
            rows, longer = rows[~hit], node[~hit]
        seen = len(self.codes[0])
        out[rows] += np.log2(max(256 - seen, 1))
        return out


def _find(ordered: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted number in an array in order without repeats, or -1."""
    at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
    return np.where(ordered[at] == wanted, at, -1)


class Model:
    """One tree per language, from columns (lang, level, code, n)."""

    def __init__(self, langs: np.ndarray, level: np.ndarray, code: np.ndarray, n: np.ndarray, order: int = ORDER) -> None:
        self.order = order
        self.languages, which = np.unique(np.asarray(langs, str), return_inverse=True)
        self.languages = self.languages.tolist()
        self.trees = [ContextTree(level[which == i], code[which == i], n[which == i], order) for i in range(len(self.languages))]


class Lengths:
    """Code lengths of texts in each language of a model; lengths of common codes are remembered."""

    def __init__(self, model: Model, most: int = REMEMBERED) -> None:
        self.model, self.most = model, most
        self.codes, self.bits = np.zeros(0, np.int64), np.zeros((0, len(model.languages)))

    def of_codes(self, codes: np.ndarray) -> np.ndarray:
        """bits[code, language] of distinct codes in order."""
        at = _find(self.codes, codes) if len(self.codes) else np.full(len(codes), -1)
        new = codes[at < 0]
        bits = np.stack([tree.bits(new) for tree in self.model.trees], 1)
        out = np.empty((len(codes), bits.shape[1]))
        out[at >= 0], out[at < 0] = self.bits[at[at >= 0]], bits
        if len(self.codes) + len(new) > self.most:
            self.codes, self.bits = codes[: self.most], out[: self.most]
        elif len(new):
            places = np.searchsorted(self.codes, new)
            self.codes, self.bits = np.insert(self.codes, places, new), np.insert(self.bits, places, bits, 0)
        return out

    def add(self, data: np.ndarray, offsets: np.ndarray, into: np.ndarray, step: int = STEP) -> None:
        """Adds to ``into`` the bits of each text in each language, ``step`` bytes at a time."""
        starts, rows = _starts(offsets), np.flatnonzero(offsets[:-1] < offsets[1:])
        for at in range(0, len(data), step):
            stop = min(len(data), at + step)
            codes, which = np.unique(context_codes(data, starts, self.model.order, at, stop), return_inverse=True)
            bits = self.of_codes(codes)
            a, b = np.searchsorted(starts, at, side="right") - 1, np.searchsorted(starts, stop)
            edges = np.maximum(starts[a:b], at) - at
            for k in range(bits.shape[1]):
                into[rows[a:b], k] += np.add.reduceat(bits[which, k], edges)


def fit(
    df: DataFrame,
    id_col: str,
    text_col: str,
    lang_col: str,
    sample_per_language: int = SAMPLE_PER_LANGUAGE,
    order: int = ORDER,
    most_entries: int = MOST_ENTRIES,
) -> Model:
    """Statistics of at most about ``sample_per_language`` documents a language, by hash.

    Null languages and null texts teach nothing. Whole texts are counted; of the counts,
    the ``most_entries`` commonest of a language are kept. The driver gets one count a
    language and these entries: with 100 languages, 20 million of about 30 bytes. Each Python
    worker holds as much.
    """
    known = df.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")
    ).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    # A local relation, whose size is known: it is broadcast, and the texts are not shuffled.
    shares = lookup_table(df.sparkSession, [(r["lang"], min(1.0, sample_per_language / r["n"])) for r in counts], "lang string, share double")
    draw = hash_number(hex_hash(as_key("_id"), "language")) / F.lit(float(2**52))
    chosen = known.join(shares, "lang").filter(draw < F.col("share"))
    kept = commonest(gathered(count_contexts(chosen, order)), most_entries).toArrow()
    return Model(*[kept.column(c).to_numpy() for c in ("lang", "level", "code", "n")], order)


def identify(df: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``bits_per_byte`` to the columns of ``df``.

    The language with the shortest code for the whole text wins, ties go to the first by
    name; ``score`` is its share among all languages' probabilities. Texts that are null or
    without a letter get ``und``, 0 and null, as all do when nothing was learned. Rows
    stay as they are, extra columns too; columns named like the results are replaced, and
    one named ``_letters`` is left out.
    """
    out = ["lang_pred", "score", "bits_per_byte"]
    kept = [c for c in df.columns if c not in (*out, "_letters")]
    rows = df.select(
        *[F.col(f"`{c}`") for c in kept],
        F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False)).alias("_letters"),
    )
    place = kept.index(text_col)

    shared = df.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lengths = Lengths(model) if model.languages else None
        for batch in batches:
            letters = batch.column(len(kept)).to_numpy(zero_copy_only=False).astype(bool)
            if lengths is None:
                letters[:] = False
            length = np.zeros((batch.num_rows, max(1, len(model.languages))))
            size = np.zeros(batch.num_rows, np.int64)
            for first, data, offsets in text_pieces(batch.column(place), STEP):
                many = len(offsets) - 1
                size[first : first + many] = np.diff(offsets)
                if lengths is not None and len(data):
                    lengths.add(data, offsets, length[first : first + many])
            best = length.argmin(1)
            least = length[np.arange(len(best)), best]
            score = 1 / np.exp2(np.maximum(least[:, None] - length, -1000)).sum(1)
            names = np.array(model.languages or [UNKNOWN], object)[best]
            names[~letters] = UNKNOWN
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(kept)],
                    pa.array(names, pa.string()),
                    pa.array(np.where(letters, score, 0.0)),
                    pa.array(np.where(letters, least / np.maximum(size, 1), 0.0), mask=~letters),
                ],
                names=[*kept, *out],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_letters")
    return rows.mapInArrow(judge, f"{schema}, lang_pred string, score double, bits_per_byte double")


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % folds
