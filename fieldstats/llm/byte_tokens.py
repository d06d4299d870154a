"""Token ids of whole texts under byte-level BPE."""

from __future__ import annotations

import json
import os
import re
from array import array

#: Fixed by the byte-level tokenizers: where a text is cut before anything is merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters without a cut from which on merging by ranks, quadratic in them, is not used.
LONG = 20_000
_SPACES = re.compile(r"\s{%d}" % LONG)


def byte_characters() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte, and back.

    Printable Latin-1 characters stand for themselves, the others for those from 256 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """Ids as 32-bit bytes, little-endian as every platform of Spark is.

    ``tokenizers`` reads the file and is what the ids are defined by. Where the file says that
    tokens are numbered in the order of their merges, which is checked, merging by number
    gives the same ids in a third of the time, and that is done by ``tiktoken`` with the same
    vocabulary. A text goes to ``tokenizers`` whole if it holds one of the added tokens or a
    very long word or gap, and so does every text where the file says anything else.
    """

    _of: dict[str, ByteTokens] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merged_by_number = self._ranked(json.loads(self.tokenizer.to_str()))

    def _ranked(self, rules: dict):
        model, before = rules["model"], rules["pre_tokenizer"] or {}
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        if (
            rules["normalizer"] is not None
            or model["type"] != "BPE"
            or any(model.get(o) for o in options)
            or before.get("type") != "ByteLevel"
            or not before.get("use_regex", True)
            or before["add_prefix_space"]
        ):
            return None
        made = [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        numbered = sorted(model["vocab"].items(), key=lambda x: x[1])
        tokens = [token for token, _ in numbered if token not in self.added]
        byte_of = byte_characters()
        if {*tokens[:256]} != {*byte_of} or tokens[256:] != made:
            return None
        import tiktoken

        ranks = {bytes(byte_of[c] for c in token): number for token, number in numbered if token not in self.added}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, path: str) -> ByteTokens:
        """The one of this Python worker, which its later tasks find ready."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _is_plain(self, text: str) -> bool:
        if any(t in text for t in self.added):
            return False
        return len(text) < LONG or (max(map(len, text.split()), default=0) < LONG and not _SPACES.search(text))

    def ids(self, text: str) -> bytes:
        if self.merged_by_number and self._is_plain(text):
            return array("I", self.merged_by_number.encode_ordinary(text)).tobytes()
        return self.whole(text)
