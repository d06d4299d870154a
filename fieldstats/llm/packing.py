"""Best-fit packing of token pieces by minimum bin slack."""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats.llm.byte_tokens import LONG, byte_characters
from fieldstats.llm.common import as_key, hex_hash, running_start, settled

#: Fixed by the tokenizer files whose parts of words :class:`WordTokens` merges by number.
_WORDS, _END = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "</w>"
#: The same cuts where all white space is blanks; what is left between them are letters.
_CUT = regex.compile(r"'(?:s|t|re|ve|m|ll|d)|\p{N}|[^ \p{L}\p{N}]+")
#: White space other than the blank, of the characters that are not odd.
_GAPS = "\t\n\x0b\x0c\r\x85\xa0"
#: Characters on whose case, kind or composition versions of Unicode could disagree.
_ODD = re.compile("[^\x00-\u02ff\u0300-\u036f\u0400-\u0481\u048a-\u052f\u2010-\u2027\u2030-\u205e\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]")
#: Texts that are encoded before their pieces are cut.
_TOGETHER = 128


class WordTokens:
    """Ids of texts as little-endian 32-bit bytes, for tokenizers of lower-cased words.

    ``tokenizers`` reads the file and is what the ids are defined by. Such a tokenizer never
    joins what white space separates, lower-cases, and cuts words at digits and punctuation;
    the last byte of each part is a symbol of its own. Where the file says this and that tokens
    are numbered in the order of their merges, both of which is checked, parts are merged by
    number with the same vocabulary, by ``tiktoken``: a blank behind each part stands for
    its end. Nothing is remembered from text to text. A text goes to ``tokenizers`` whole if it
    holds an added token, a very long word or a character beyond ``_ODD``, and so does
    every text where the file says anything else.
    """

    _of: dict[str, WordTokens] = {}

    @classmethod
    def of(cls, path: str) -> WordTokens:
        """The one of this Python worker, which its later tasks find ready."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.added = [t["content"] for t in rules["added_tokens"]]
        self.merged_by_number = self._ranked(rules)

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(self.path)

    def _ranked(self, rules: dict):
        model = rules["model"]
        steps = (rules["normalizer"] or {}).get("normalizers", [])
        cuts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        options = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
        if (
            model["type"] != "BPE"
            or any(model.get(o) for o in options)
            or model.get("end_of_word_suffix") != _END
            or [n["type"] for n in steps] != ["NFC", "Replace", "Lowercase"]
            or (steps[1]["pattern"], steps[1]["content"]) != ({"Regex": r"\s+"}, " ")
            or [c["type"] for c in cuts] != ["Split", "ByteLevel"]
            or (cuts[0]["pattern"], cuts[0]["behavior"], cuts[0]["invert"]) != ({"Regex": _WORDS}, "Removed", True)
            or cuts[1]["add_prefix_space"]
            or cuts[1].get("use_regex", True)
            or any(t.get("normalized") for t in rules["added_tokens"])
        ):
            return None
        made = [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        numbered = sorted(model["vocab"].items(), key=lambda x: x[1])
        tokens = [token for token, _ in numbered if token not in self.added]
        byte_of = byte_characters()
        if {*tokens[:512]} != {*byte_of, *(c + _END for c in byte_of)} or tokens[512:] != made:
            return None
        import tiktoken

        ranks = {
            bytes(byte_of[c] for c in token.removesuffix(_END)) + b" " * token.endswith(_END): number
            for token, number in numbered
            if token not in self.added
        }
        return tiktoken.Encoding("ranked", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    def _is_plain(self, text: str) -> bool:
        if any(t in text for t in self.added):
            return False
        if not text.isascii() and _ODD.search(text):
            return False
        return len(text) < LONG or max(map(len, text.split()), default=0) < LONG

    def _ids(self, text: str) -> bytes:
        if not (self.merged_by_number and self._is_plain(text)):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = text.lower()
        for gap in _GAPS:
            text = text.replace(gap, " ")
        return array("I", self.merged_by_number.encode_ordinary(_CUT.sub(r" \g<0> ", text) + " ")).tobytes()

    def ids(self, texts: list[str | None]) -> list[bytes]:
        return [self._ids(t or "") for t in texts]


def token_pieces(
    df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, capacity: int, end_id: int, keep_ids: bool = False
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document, whose ids end with ``end_id``.

    Columns: id, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, the ``ids``
    as little-endian bytes. A null or empty text is a document of the end id alone.
    """
    end = np.array([end_id], "<u4").tobytes()
    kind = df.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens.of(tokenizer_path)
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for first in range(0, batch.num_rows, _TOGETHER):
                texts = batch.column(1).slice(first, _TOGETHER).to_pylist()
                for i, ids in enumerate(words.ids(texts), first):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for column, value in zip(rows, (i, piece, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows[0], pa.int32())),
                    pa.array(rows[1], pa.int32()),
                    pa.array(rows[2], pa.int64()),
                    pa.array(rows[3], pa.int64()),
                    pa.array(rows[4], pa.int64()),
                    *([pa.array(rows[5], pa.binary())] if keep_ids else []),
                ],
                names=[id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])],
            )

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    return df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text")).mapInArrow(cut, schema)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths, with how many of each, whose sum is the largest that ``room`` allows.

    Subset sums as the bits of one number, longest lengths first, each length in chunks of
    1, 2, 4 ... copies; it stops as soon as ``room`` itself is reached.
    """
    reach, steps, whole = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left:
            chunk = min(chunk, left)
            steps.append((length, chunk, reach))
            reach |= (reach << (length * chunk)) & whole
            left, chunk = left - chunk, chunk * 2
        if reach >> room:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, chunk, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + chunk
            at -= length * chunk
    return chosen


def bin_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, per bin, first bin, offset): which pieces go where.

    Minimum bin slack: the longest length left opens a bin, the fullest combination of
    the others joins it, and both are removed. A combination is taken as often as its
    lengths allow, so the work depends on the number of distinct lengths, at most
    ``capacity``, and not on the number of pieces.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    rows, bins = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fullest({k: n for k, n in left.items() if n}, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            rows.append((length, used[length], n, bins, offset))
            used[length] += n * times
            offset += n * length
            left[length] -= n * times
            if not left[length]:
                del left[length]
        bins += times
    return rows


def pack(pieces: DataFrame, id_col: str, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``: bins of ``capacity`` tokens, gapless from 0.

    What reaches the driver is the histogram of lengths (at most ``capacity`` rows); it
    sends back the plan. A piece finds its place by its rank among the pieces of its
    length; ranks come from running sums over hashed buckets, so that a length which a
    third of all pieces have is not sorted in one task. Pieces that repeat an id are
    pieces of their own. Without pieces there are no bins.
    """
    counts = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = np.array(sorted(bin_plan(counts, capacity)), np.int64).reshape(-1, 5)
    lengths, firsts, per, first_bin, offsets = plan.T
    size = np.int64(1) << 48
    keys = lengths * size + firsts
    keyed = pieces.withColumn("_key", hex_hash(as_key(id_col, "piece"), "pack")).withColumn("_bucket", F.substring("_key", 1, 2))
    ranked = running_start(keyed, ["length"], "_bucket", ["_key", "ids_crc32"], F.lit(1), "_rank").drop("_key", "_bucket")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rank, length = frame.pop("_rank").to_numpy(np.int64), frame["length"].to_numpy(np.int64)
            row = np.searchsorted(keys, length * size + rank, side="right") - 1
            copy, nth = np.divmod(rank - firsts[row], per[row])
            frame["sequence_id"] = first_bin[row] + copy
            frame["offset"] = offsets[row] + nth * length
            yield frame

    names = [c for c in ranked.columns if c != "_rank"]
    ranked = ranked.select(*names, "_rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInPandas(place, f"{schema}, sequence_id long, offset long")


def pack_documents(
    df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False
) -> DataFrame:
    """Tokenise, cut and pack; see ``token_pieces`` and ``pack``."""
    return pack(settled(token_pieces(df, id_col, text_col, tokenizer_path, capacity, end_id, keep_ids)), id_col, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """Per bin: ``sequence_id``, ``length`` and the joined ``ids`` (from ``keep_ids``)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
    )
