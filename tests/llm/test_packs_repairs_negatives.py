"""Vector packing, conversation repair and hard negatives against plain versions."""

from __future__ import annotations

import hashlib
import random
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstats.llm import conversation_repair, edit_lattice, hard_negatives, vector_packing
from fieldstats.llm.byte_tokens import ByteTokens
from fieldstats.llm.queries import tokenizer_path
from fieldstats.llm.vector_packing import Limits
from tests.llm.cases import frame, texts

BYTE_BPE = tokenizer_path("byte_bpe_50k.json")
ODD = [
    "",
    " ",
    "a  b\n\n c \n\nd\t e   \n",
    "<|endoftext|> it's <|endoftext|>x",
    "I'll can't 123abc!? (x) ...end. Größe, naïve; 日本語  x\x1cy\x85z w",
    "ends in spaces   ",
    "𝔘nicode ʼn ⅷ x² é.",
]


def test_ids_are_those_of_the_tokenizer():
    tokens, draw = ByteTokens(BYTE_BPE), random.Random(2)
    assert tokens.merged_by_number is not None
    given = ODD + [t or "" for _, t, *_ in texts()] + ["x" * 70_000, " \n" * 30_000, "ab " * 30_000]
    # Every kind of character next to every other.
    every = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 97 == 0)]
    draw.shuffle(every)
    given += ["".join(draw.choices(every, k=40)) + draw.choice([" ", "\n", "a", "1", "'s"]) for _ in range(3_000)]
    assigned = [c for c in every if unicodedata.category(c) != "Cn"]
    given += ["a" + c + " " + c + "1" + c + "\n" for c in assigned]
    for text in given:
        assert tokens.ids(text) == tokens.whole(text), text[:50]
    other = ByteTokens(tokenizer_path())
    assert other.merged_by_number is None and [other.ids(t) for t in ODD] == [other.whole(t) for t in ODD]


def test_fill_keeps_every_limit():
    draw = np.random.default_rng(3)
    tokens = draw.integers(1, 90, 400)
    loss = draw.integers(0, np.minimum(tokens, 30) + 1)
    limits = Limits(100, 5, 40)
    loss[:3] = 41
    rows = vector_packing.fill(tokens, loss, limits)
    assert sorted(r[0] for r in rows) == list(range(400)) and all(r[1] == 0 and r[2] == tokens[r[0]] for r in rows)
    bins = defaultdict(list)
    for example, _, length, number, offset in rows:
        assert offset == sum(x[1] for x in bins[number])
        bins[number].append((example, length))
    assert sorted(bins) == list(range(len(bins)))
    for own in bins.values():
        held = sum(tokens[e] for e, _ in own), len(own), sum(loss[e] for e, _ in own)
        assert all(h <= limit for h, limit in zip(held, limits)) or (len(own) == 1 and own[0][0] < 3)
    # No less than the scarcest dimension asks for, and little more.
    least = max(tokens.sum() / 100, loss.sum() / 40)
    assert least <= len(bins) <= 1.15 * least + 3


def test_fill_cuts_to_fill():
    tokens = np.array([70] * 30 + [3] * 4)
    rows = vector_packing.fill(tokens, tokens - 1, Limits(100, 8, 99), least_cut=5)
    parts = defaultdict(list)
    for example, start, length, *_ in rows:
        parts[example].append((start, length))
    for example, own in parts.items():
        ends = [0, *np.cumsum([n for _, n in sorted(own)]).tolist()]
        assert [s for s, _ in sorted(own)] == ends[:-1] and ends[-1] == tokens[example]
    filled = defaultdict(int)
    for _, _, length, number, _ in rows:
        filled[number] += length
    assert sum(1 for n in filled.values() if n <= 95) <= 1 and max(filled.values()) == 100


@pytest.mark.parametrize("limits,together", [(Limits(2048, 256, 2047), 8192), (Limits(64, 3, 63), 11)])
def test_pack_texts(spark, limits, together):
    rows = texts() + [(200 + i, t, "en", "a") for i, t in enumerate(ODD)]
    docs = frame(spark, rows).withColumn("start", F.lit(5)).withColumn("_row", F.lit("x"))
    got = vector_packing.pack_texts(docs, "doc_id", "text", BYTE_BPE, limits, together=together, keep_ids=True).collect()
    tokens = ByteTokens(BYTE_BPE)
    whole = sorted((-1 if i is None else i, tokens.whole(t or "") + np.array([1], "<u4").tobytes()) for i, t, *_ in rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        pieces[-1 if r.doc_id is None else r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i in {i for i, _ in whole}:
        # Every position of every document once; repeated ids are documents of their own.
        want = sorted((p, ids[4 * p : 4 * p + 4], len(ids) // 4) for j, ids in whole if j == i for p in range(len(ids) // 4))
        assert sorted((s + k, ids[4 * k : 4 * k + 4], n) for s, ids, n in pieces[i] for k in range(len(ids) // 4)) == want
    for own in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(own)]).tolist()]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= limits.tokens and len(own) <= limits.segments
    if together > len(rows):
        assert sum(r.length for r in got) / (limits.tokens * len(sequences)) > 0.97
    assert vector_packing.pack_texts(docs.limit(0), "doc_id", "text", BYTE_BPE).count() == 0


def test_pack_texts_needs_room():
    with pytest.raises(ValueError):
        vector_packing.pack_texts(None, "a", "b", BYTE_BPE, Limits(100, 5, 50))


def test_pack_examples(spark):
    """Instruction data: only answers bear loss, and that limit decides."""
    draw = random.Random(5)
    rows = [(i % 90, draw.randint(1, 60), draw.randint(0, 30), "x") for i in range(300)] + [(500, 200, 1, "x"), (None, None, None, "x"), (501, 5, None, "x")]
    frame_ = spark.createDataFrame(rows, "id long, tokens long, loss long, _bucket string").repartition(3)
    got = vector_packing.pack_examples(frame_, "id", "tokens", "loss", Limits(128, 6, 32), together=80).collect()
    key = lambda i, t, n: (-1 if i is None else i, t or 0, n or 0)
    assert sorted(key(r.id, r.tokens, r.loss) for r in got) == sorted(key(*r[:3]) for r in rows)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.segment)
        assert [r.segment for r in own] == list(range(len(own)))
        assert [r.offset for r in own] == [0, *np.cumsum([r.tokens for r in own]).tolist()][:-1]
        if all(r.fits for r in own):
            assert sum(r.tokens for r in own) <= 128 and len(own) <= 6 and sum(r.loss for r in own) <= 32
    assert [r.id for r in got if not r.fits] == [500]
    assert vector_packing.pack_examples(frame_.limit(0), "id", "tokens", "loss", Limits(128, 6, 32)).count() == 0


def _cheapest(turns: str, entry: int = 0, exits=(0, 3)):
    """The lattice one turn after the other."""

    def with_inserts(ways):
        for _ in range(3):
            for state, (cost, audit) in list(ways.items()):
                to, way = edit_lattice.NEXT[state], (cost + 3, audit + "I")
                ways[to] = min(ways.get(to, way), way)
        return ways

    ways = with_inserts({entry: (0, "")})
    for turn in turns:
        new = {}
        for state, (cost, audit) in ways.items():
            edits = [(state, "D", 4)]
            if turn != "x":
                extra = 3 * turn.isupper()
                edits.append((edit_lattice.NEXT[state], "R", 3 + extra))
                step = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(turn.lower(), {})
                if state in step:
                    edits.append((step[state], "K", extra))
            for to, letter, price in edits:
                way = (cost + price, audit + letter)
                new[to] = min(new.get(to, way), way)
        ways = with_inserts(new)
    return min((ways[e] for e in exits if e in ways), default=None)


def test_lattice_search():
    draw = random.Random(1)
    for _ in range(1_500):
        turns = "".join(draw.choice("suaoSUAOx") for _ in range(draw.randint(0, 9)))
        for entry in range(4):
            for exits in ((0, 3), (0,), (1,), (2,), (3,)):
                assert edit_lattice.search(turns, entry, exits) == _cheapest(turns, entry, exits), turns
        if turns:
            joined, size = edit_lattice.Joined(), draw.randint(1, 4)
            for at in range(0, len(turns), size):
                joined.join(edit_lattice.through(turns[at : at + size]))
            assert joined.best() == _cheapest(turns)


def _damaged(rows):
    for conv, turn, role, text in rows:
        say = lambda v: " " if v is None else str(v)
        draw = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        if draw == 1:
            text = ""
        elif draw == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif draw == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * {0: 0, 3: 2}.get(draw, 1)


def _repaired(rows, conv):
    own = [r[1:] for r in rows if r[0] == conv]
    own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, letters, counts = set(), "", dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    for _, role, text in own:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        letters += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        if fault:
            counts[fault] += 1
    counts["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
    turns = [t for t, *_ in own if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = _cheapest(letters)
    lines, at, kept = [], iter(own), []
    for letter in audit:
        _, role, text = next(at) if letter != "I" else (None, None, "")
        if letter != "D":
            led = bool(kept) and kept[0] == "s"
            by_place = "user" if (len(kept) - led) % 2 == 0 else "assistant"
            lines.append(f"{role if letter == 'K' else by_place}:{text}")
            kept.append(lines[-1][0])
    assert next(at, None) is None
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (conv, gaps, *counts.values(), cost, audit, sha)


def _conversations():
    draw = random.Random(11)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "sage", None, "User"]
    say = ["Yes.", "No!", "cut off", " ", "", None, "Why? \n", "x" * 3_000 + ".", "é "]
    rows = [(c, t, roles[t % 2] if draw.random() < 0.7 else draw.choice(roles), draw.choice(say) if draw.random() < 0.4 else f"Turn {c} {t}.") for c in range(60) for t in range(draw.randint(1, 9))]
    rows += [(None, t, "user" if t % 2 else "assistant", f"No name {t}.") for t in range(5)] + [(70, None, "system", "Be."), (70, None, None, "Who"), (70, 4, "user", "a."), (70, -3, "user", "b.")]
    rows += [(80, t // 3, roles[t % 3], draw.choice(say[:4])) for t in range(400)] + [(80, 9, "user", "Same.")] * 90
    rows += [(c, 0, "user", "Hi.") for c in range(90, 130)] + rows[:6]
    return rows


@pytest.mark.parametrize("piece_rows", [1_024, 4])
def test_repair(spark, piece_rows):
    rows = _conversations()
    frame_ = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, conv string").repartition(3)
    damaged = conversation_repair.damage(frame_, "conv_id", "turn", "role", "text")
    plain = list(_damaged(rows))
    assert sorted(map(repr, plain)) == sorted(repr(tuple(r)) for r in damaged.collect())
    every = frame_.select(F.col("conv_id").alias("conv"))
    got = conversation_repair.repair(damaged, every, piece_rows).collect()
    want = [_repaired(plain, conv) for conv in {r[0] for r in rows}]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert any(w[7] == "" for w in want)


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    damaged = conversation_repair.damage(none, "conv_id", "turn", "role", "text")
    assert conversation_repair.repair(damaged, none.select(F.col("conv_id").alias("conv"))).count() == 0
    one = spark.createDataFrame([(7,)], "conv long")
    got = conversation_repair.repair(damaged, one).collect()
    assert [tuple(r) for r in got] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("most", [600, 10**7, 10**15])
def test_residue_products_are_exact(most):
    draw = random.Random(most)
    left, right = ([[draw.randint(-most, most) for _ in range(150)] for _ in range(n)] for n in (4, 7))
    primes = hard_negatives.primes_for(150.0 * most * most)
    parts = [
        hard_negatives.residue_product(*(hard_negatives.residues(np.array(m, float), p) for m in (left, right)), p) for p in primes
    ]
    got = hard_negatives.reconstruct(parts, primes)
    assert got.tolist() == [[sum(int(float(a)) * int(float(b)) for a, b in zip(x, y)) for y in right] for x in left]


def _mined(rows):
    usable = {(i, label, tuple(int(np.floor(256 * np.float64(x))) for x in v)) for i, v, label in rows if label is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    order = lambda x: (-x[1], x[0] is None, x[0] or 0)
    out = []
    for i, label, v in usable:
        if i is None or i % 50:
            continue
        scored = [(j, sum(a * b for a, b in zip(v, w)), m) for j, m, w in usable if j != i and len(w) == len(v)]
        for j, goal, _ in sorted((s for s in scored if s[2] == label), key=order)[:5]:
            near = sorted((s for s in scored if s[2] != label and 50 * goal <= 100 * s[1] <= 95 * goal), key=order)[:3]
            out += [(i, j, rank, k, goal, score) for rank, (k, score, _) in enumerate(near, 1)]
    return out


@pytest.mark.parametrize("chunks,scale", [(1, 1), (7, 1), (3, 1e4)])
def test_mine(spark, chunks, scale):
    draw = np.random.default_rng(int(scale))
    vector = lambda: (np.round(scale * draw.normal(0.3, 1, 6), 2)).tolist()
    common = vector()
    rows = [(i, common if i % 3 == 0 else vector(), int(i % 4)) for i in range(240)]
    rows += [(300, [1.0, 2.0], 1), (301, [2.0, 1.0], 1), (302, [1.0, 1.0], 2), (303, [], 1), (350, None, 1), (400, [float("nan")] * 6, 1), (450, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 1), (500, vector(), None)]
    rows += [(None, common, 1), (None, vector(), 2), (600, [1e-310] * 6, 1), (650, [-0.0] * 6, 1)] + rows[:30] + [(50, vector(), 2), (7, [1e307] + [0.0] * 5, 3)]
    frame_ = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, v array<double>, label int, chunk string, anchor int").repartition(3)
    got = hard_negatives.mine(frame_, "vec_id", "v", "label", F.col("vec_id") % 50 == 0, chunks=chunks, chunk_rows=100).collect()
    want = _mined([r for r in rows if r[:1] != (7,) or r[1][0] < 1e300])
    assert len(want) > 30 and sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_mine_large_scores(spark):
    """Scores beyond 2^62 in between are exact; only the result must fit in a long."""
    rows = [(0, [1e6, 1.0], 1), (1, [1e6, 1.0], 1), (2, [7e5, 2.0], 2), (3, [6e5, 9.0], 2), (4, [1e14, 5.0], 3)]
    got = hard_negatives.mine(spark.createDataFrame(rows, "id long, v array<double>, label int"), "id", "v", "label", F.col("id") == 0).collect()
    assert sorted(map(tuple, got)) == sorted(_mined(rows))


def test_mine_nothing(spark):
    none = spark.createDataFrame([], "id long, v array<float>, label int")
    assert hard_negatives.mine(none, "id", "v", "label", F.col("id") == 0).count() == 0
