"""Small tables with the awkward rows every operator must take."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, _key string, _text string, n long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def texts() -> list[tuple]:
    """(doc_id, text, lang, source): nulls, empties, copies, near copies, a long text."""
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(70)
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", None),
        (3, " \n\t ", None, "b"),
        (4, "One two", "en", "a"),
        (5, "one TWO", "de", "c"),
        (6, "... !!! 123", "en", "a"),
        (None, "no id but words " + passage, "en", "a"),
        (7, passage, "en", "b"),
        (8, prose(20) + "\n" + passage + "\n" + prose(20), "de", "b"),
        (9, "é ü ß ñ 日本 \u00a0x\x1cy", "de", None),
    ]
    base = prose(300)
    for i in range(12):
        words = base.split(" ")
        for at in draw.sample(range(300), i):
            words[at] = word()
        rows.append((20 + i, " ".join(words), "en", "d"))
    rows += [(40 + i, base.upper() if i % 2 else base, "en", "d") for i in range(6)]
    block = "\n".join(prose(8) for _ in range(30))
    for i in range(6):
        rows.append((60 + i, "\n".join([prose(6) for _ in range(i + 1)]) + "\n" + block + "\n" + prose(5), "de", "e"))
    rows += [(80, prose(60_000), "en", "a"), (81, "\n" * 50, "en", "a")]
    rows += [(90 + i, prose(draw.randint(1, 40)), draw.choice(["en", "de"]), "f") for i in range(30)]
    rows.append((90, rows[-30][1], "en", "f"))
    rows += [rows[3], rows[3]]
    return rows


def frame(spark, rows):
    """Rows as documents, with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame(
        [(*r, len(r[1] or ""), "shard", "key", "other", 5) for r in rows], SCHEMA
    ).repartition(3)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


class Groups:
    """Plain union-find; a group is named by its smallest member."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, x, y) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
