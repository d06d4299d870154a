"""Repeated runs of lines: cut at content-defined places, or found whole line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstats.llm.common import computed, hash_number, settled

#: A chunk ends where the rolling hash over so many lines is divisible by the modulus.
ROLLING_LINES, MODULUS = 2, 3
#: Lines with a word that a chunk needs to be removed.
LEAST_LINES = 2
_OWN = ("_id", "_xx", "_text", "_lines", "_hashes", "_ends", "_chunks", "_stay", "_gone")
_RUNS_OWN = (*_OWN, "_filled", "_pairs", "_of", "_spans")
#: A line that holds a word.
_WORDY = r"[^\x20\x09-\x0D]"
_BLANKS = " \t\n\x0b\x0c\r"
#: Factor between a line and the one before it in the rolling hash.
_FACTOR = 31


def cut(texts: DataFrame) -> DataFrame:
    """Adds ``_lines`` and ``_ends``: the last line of each chunk.

    A line's hash is the first 32 bits of its md5; the rolling hash over a line and those
    before it depends on these lines alone, so a passage is cut alike wherever it stands
    and whatever lines come before it.
    """
    lines = computed(texts.drop("_lines"), _lines=F.split(F.coalesce("_text", F.lit("")), "\n", -1))
    hashed = computed(lines, _hashes=F.transform("_lines", lambda x: hash_number(F.md5(x), 8)))

    def rolling(h: Column, i: Column) -> Column:
        parts = [F.get(h, i - j) * F.lit(_FACTOR**j) for j in range(ROLLING_LINES)]
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        return total

    last = F.size("_hashes") - 1
    ends = F.filter(
        F.sequence(F.lit(0), last),
        lambda i: (i == last) | (F.coalesce(rolling(F.col("_hashes"), i) % MODULUS, F.lit(1)) == 0),
    )
    return computed(hashed, _ends=ends).drop("_hashes")


def chunked(texts: DataFrame) -> DataFrame:
    """Adds ``_lines`` and ``_chunks``: (k, start, many, filled, content) of each chunk of ``cut``."""

    def chunk(end: Column, k: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(F.get("_ends", k - 1) + 1)
        own = F.slice("_lines", start + 1, end - start + 1)
        return F.struct(
            k.alias("k"),
            start.alias("start"),
            (end - start + 1).alias("many"),
            F.size(F.filter(own, lambda x: x.rlike(_WORDY))).alias("filled"),
            F.array_join(own, "\n").alias("content"),
        )

    return computed(cut(texts), _chunks=F.transform("_ends", chunk)).drop("_ends")


def repeated_chunks(texts: DataFrame) -> DataFrame:
    """The chunks (``_id``, ``_xx``, ``k``, ``start``, ``end``) that an earlier place has byte by byte.

    ``start`` and ``end`` are the chunk's first and last line with a word.

    Only chunks with at least ``LEAST_LINES`` lines that hold a word count. Contents are
    grouped whole, combined before the shuffle; documents find out which of their chunks
    go through a digest that is proven to stand for one content (else the query
    fails). A hot chunk is one row on the groups' side, and its documents' side can be split.
    """
    chunks = (
        chunked(texts)
        .select("_id", "_xx", F.explode("_chunks").alias("c"))
        .select("_id", "_xx", "c.k", "c.start", "c.filled", "c.content")
        .filter(F.col("filled") >= LEAST_LINES)
        .withColumn("_digest", F.sha2("content", 256))
    )
    ends_in = lambda text: F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    content = F.col("content")
    start = F.col("start") + ends_in(content) - ends_in(F.ltrim(content, F.lit(_BLANKS)))
    end = F.col("start") + ends_in(F.rtrim(content, F.lit(_BLANKS)))
    place = F.struct("_id", "_xx", "k")
    groups = chunks.groupBy("_digest", "content").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    repeated = (
        groups.groupBy("_digest")
        .agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.count("*").alias("_contents"))
        .filter(F.col("_first") < F.col("_last"))
        .select(
            F.concat("_digest", F.lit("")).alias("_key"),
            F.when(F.col("_contents") == 1, F.col("_first"))
            .otherwise(F.raise_error(F.lit("two chunks share a digest")).cast("struct<_id:bigint,_xx:bigint,k:int>"))
            .alias("_first"),
        )
    )
    return (
        chunks.select("_id", "_xx", "k", start.alias("start"), end.alias("end"), F.concat("_digest", F.lit("")).alias("_key"))
        .join(repeated, "_key")
        .filter(place > F.col("_first"))
        .select("_id", "_xx", "k", "start", "end")
    )


def _keys(id_col: str, text_col: str) -> dict[str, Column]:
    """What tells a document apart; null ids rank behind all others."""
    return {
        "_id": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit((1 << 63) - 1)),
        "_xx": F.xxhash64(F.col(f"`{text_col}`")),
    }


def dedup_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with repeated chunks cut out of ``text_col``; adds ``n_lines``, ``n_removed``.

    Of chunks with equal bytes, each with at least ``LEAST_LINES`` lines that hold a
    word, the one in the document with the smallest id, there the first, stays (see
    ``repeated_chunks``).

    Null texts stay null with 0 lines; an empty text is one line. Null ids rank behind all
    others. Rows that repeat an id and text are the same document and keep the same lines.
    A document may lose all lines; it stays with an empty text. Columns of ``df`` named
    like the results are replaced; those named in ``_OWN`` are left out.

    A run at whose edges foreign lines share a chunk keeps these edges, and a run without a
    whole chunk stays; ``dedup_runs`` removes them too.
    """
    df = df.drop("n_lines", "n_removed", *_OWN)
    keys = _keys(id_col, text_col)
    texts = df.select(*[v.alias(k) for k, v in keys.items()], F.col(f"`{text_col}`").alias("_text"))
    gone = repeated_chunks(texts).groupBy("_id", "_xx").agg(F.collect_set("k").alias("_gone"))
    kept = df.withColumns(keys).join(gone, ["_id", "_xx"], "left")
    out = chunked(kept.withColumn("_text", F.col(f"`{text_col}`")))
    stay = F.filter("_chunks", lambda c: ~F.array_contains("_gone", c["k"]))
    found = F.col("_gone").isNotNull()
    lines_of = lambda cs: F.aggregate(cs, F.lit(0), lambda a, c: a + c["many"])
    out = computed(out, _stay=F.when(found, stay))
    return out.withColumns(
        {
            "n_lines": F.when(F.col("_text").isNull(), F.lit(0)).otherwise(F.size("_lines")),
            "n_removed": F.when(found, F.size("_lines") - lines_of(F.col("_stay"))).otherwise(F.lit(0)),
            text_col: F.when(found, F.array_join(F.transform("_stay", lambda c: c["content"]), "\n")).otherwise(F.col("_text")),
        }
    ).drop("_id", "_xx", "_gone", "_text", "_lines", "_chunks", "_stay")


def dedup_runs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` without the lines of repeated runs; adds ``n_lines``, ``n_removed``.

    A run is two or more lines with a word and the lines without one between them. It is
    repeated if an earlier place (document by id, then place in it) has the same bytes.
    First, chunks with content-defined ends that an earlier place has go whole (see
    ``repeated_chunks``). Then matches are extended line by line: of each two neighbouring
    lines with a word that do not both lie in such a chunk, those that an earlier place has
    go too. So a run goes up to its edges, whatever stands around it, a run without a whole
    chunk goes as well, and the earliest copy of every line stays. Where a pair overlaps its
    own first copy (a line three times in a row), the line of that copy stays.

    A chunk that goes holds no first copy of a pair: the earlier chunk has them all.

    Pairs are shuffled as SHA-256 digests without their text. Pairs of one digest that
    differ in length or in another hash end the query. Nulls, empty texts, repeated rows
    and columns are handled as in ``dedup_lines``.
    """
    df = df.drop("n_lines", "n_removed", *_RUNS_OWN)
    keys = _keys(id_col, text_col)
    texts = df.select(*[v.alias(k) for k, v in keys.items()], F.col(f"`{text_col}`").alias("_text"))
    whole = settled(repeated_chunks(texts))
    # The chunk of each line.
    many = lambda end, k: end - F.when(k == 0, F.lit(-1)).otherwise(F.get("_ends", k - 1))
    of = F.flatten(F.transform("_ends", lambda end, k: F.array_repeat(k, many(end, k))))
    lines = computed(cut(texts.filter(F.col("_text").isNotNull())), _of=of).drop("_text", "_ends")
    wordy = F.filter(
        F.transform("_lines", lambda x, i: F.when(x.rlike(_WORDY), i)), lambda i: i.isNotNull()
    )
    filled = computed(lines, _filled=wordy).filter(F.size("_filled") >= LEAST_LINES)

    def pair(start: Column, k: Column) -> Column:
        end = F.get("_filled", k + 1)
        content = F.array_join(F.slice("_lines", start + 1, end - start + 1), "\n")
        chunk = F.when(F.get("_of", start) == F.get("_of", end), F.get("_of", start))
        return F.struct(k.alias("k"), start.alias("start"), end.alias("end"), chunk.alias("chunk"), content.alias("content"))

    pairs = (
        computed(filled, _pairs=F.transform(F.slice("_filled", F.lit(1), F.size("_filled") - 1), pair))
        .select("_id", "_xx", F.explode("_pairs").alias("p"))
        .select("_id", "_xx", "p.k", "p.start", "p.end", "p.chunk", F.unhex(F.sha2("p.content", 256)).alias("_digest"),
                F.octet_length("p.content").alias("_bytes"), F.xxhash64("p.content").alias("_check"))
        .join(whole.select("_id", "_xx", F.col("k").alias("chunk")), ["_id", "_xx", "chunk"], "left_anti")
    )
    place = F.struct("_id", "_xx", "k")
    alike = (F.col("_least") == F.col("_most")) & (F.col("_short") == F.col("_long"))
    repeated = (
        pairs.groupBy("_digest")
        .agg(
            F.min(place).alias("_first"),
            F.max(place).alias("_last"),
            *[f(c).alias(n) for f, c, n in ((F.min, "_check", "_least"), (F.max, "_check", "_most"), (F.min, "_bytes", "_short"), (F.max, "_bytes", "_long"))],
        )
        .filter(F.col("_first") < F.col("_last"))
        .select(
            F.concat("_digest", F.unhex(F.lit(""))).alias("_key"),
            F.when(alike, F.col("_first"))
            .otherwise(F.raise_error(F.lit("two seeds share a digest")).cast("struct<_id:bigint,_xx:bigint,k:int>"))
            .alias("_first"),
        )
    )
    first = F.col("_first")
    own = (first["_id"] == F.col("_id")) & (first["_xx"] == F.col("_xx")) & (first["k"] == F.col("k") - 1)
    gone = (
        pairs.select("_id", "_xx", "k", "start", "end", F.concat("_digest", F.unhex(F.lit(""))).alias("_key"))
        .join(repeated, "_key")
        .filter(place > first)
        .select("_id", "_xx", (F.col("start") + own.cast("int")).alias("start"), "end")
        .unionByName(whole.select("_id", "_xx", "start", "end"))
        .groupBy("_id", "_xx")
        .agg(F.collect_set(F.struct("start", "end")).alias("_gone"))
    )
    out = computed(df.withColumns(keys).join(gone, ["_id", "_xx"], "left"), _lines=F.split(F.col(f"`{text_col}`"), "\n", -1))
    places = F.flatten(F.transform("_gone", lambda g: F.sequence(g["start"], g["end"])))
    out = computed(out, _stay=F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), places))
    found = F.col("_gone").isNotNull()
    return out.withColumns(
        {
            "n_lines": F.when(F.col("_lines").isNull(), F.lit(0)).otherwise(F.size("_lines")),
            "n_removed": F.when(found, F.size("_lines") - F.size("_stay")).otherwise(F.lit(0)),
            text_col: F.when(found, F.array_join(F.transform("_stay", lambda i: F.get("_lines", i)), "\n")).otherwise(F.col(f"`{text_col}`")),
        }
    ).drop("_id", "_xx", "_gone", "_lines", "_stay")
