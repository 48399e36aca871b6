"""Chat formatting round trips and mixing quotas."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from recurra.llm import chat, mixing

TURNS = "conv_id long, turn long, role string, text string, formatted string"


def test_round_trip(spark):
    rng = random.Random(1)
    marks = ["<|im_end|>\n", "<|im_start|>", "</s>", "[INST]", "[/INST]", "<\\|", "<\\\\|x", "[\\INST]", "<<SYS>>", "<</SYS>>", "<", "|", "\\", "\n", "\u00e9", "<|nl|>", "<|image|>", "ab"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\nb", "<|x", None]), "".join(rng.choice(marks) for _ in range(rng.randrange(9))) or None, "clash") for c in range(60) for t in range(rng.randrange(1, 6))]
    rows += [(None, 0, "assistant", "null id", "x"), (7, None, "assistant", "null turn", "x"), (99, 1, "assistant", "same", "x"), (99, 1, "assistant", "same", "x")]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    got = {r.conv_id: r for r in chat.format_chats(df).select("conv_id", "n_turns", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("mask")).alias("loss")).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] is not None, r[3] or ""))
        assert [(t.role, t.text) for t in got[c].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert got[c].loss == "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c].formatted.count(chat.OPEN) == len(own) == got[c].n_turns
    assert chat.digest(df.limit(0)).count() == 0


def test_digest(spark):
    t = "</s>[INST] ok [/INST]"
    r = chat.digest(spark.createDataFrame([(-7, 0, "user", t, ""), (-7, 1, "assistant", t, "")], TURNS)).first()
    assert r.n_turns == 2 and r.loss_chars == len(t)
    assert r.turns_sha256 == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_typed_parts(spark):
    part = "struct<type:string,text:string,ref:string,tokens:int>"
    rows = [(1, 0, "user", None, [("text", "see <|image|> ", None, None), ("image", None, "a.png", 10), ("audio", None, "b.wav", None)]), (1, 1, "assistant", "ok", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, content array<{part}>")
    r = chat.format_chats(df).first()
    assert [(a.place, a.type, a.ref, a.tokens) for a in r.attachments] == [(1, "image", "a.png", 10), (2, "audio", "b.wav", chat.EXPANDS["audio"])]
    assert r.formatted.startswith("<|im_start|>user\nsee <\\|image|> <|image|><|audio|><|im_end|>\n")


def water(sizes, weights, share=1.5, most=2.0):
    target, left, open_ = {}, share * sum(sizes.values()), dict(weights)
    while open_:
        total = sum(open_.values())
        over = [s for s, w in open_.items() if left * w / total >= most * sizes[s]]
        if not over:
            return target | {s: left * w / total for s, w in open_.items()}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            del open_[s]
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    rng = random.Random(seed)
    sources = ["b", "a", "\u00e9", None, "Z", "empty", "tiny"]
    rows = []
    for i in range(400):
        s = rng.choice(sources[:5]) if rng.random() > 0.4 else "a"
        rows.append((i, " ".join("w" for _ in range(rng.randrange(120))), s, 0))
    rows += [(500, None, "empty", 0), (501, "", "empty", 0), (502, "one two three", "tiny", 0), (3, rows[3][1], rows[3][2], 0), (None, "x y", "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mixing.mix(df, shard_words=900).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]} and all(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(0.03 * want[s], 2)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    again = mixing.mix(df.repartition(7), shard_words=900).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(df.limit(0)).count() == 0


def test_sainte_lague(spark):
    rng = random.Random(3)
    for n in (0, 1, 7, 100, 1001):
        votes = {f"p{i}": rng.randrange(1, 10_000) for i in range(9)} | {"zero": 0}
        df = spark.createDataFrame([("g", k, v) for k, v in votes.items()], "g string, party string, v0 long")
        got = {r.party: r.quota for r in mixing.apportion(df, F.lit(n), F.col("v0"), ["g"], ["party"]).collect()}
        want = dict.fromkeys(votes, 0)
        for _ in range(n):
            top = max((p for p in votes if votes[p]), key=lambda p: (votes[p] / (2 * want[p] + 1), [-ord(c) for c in p]))
            want[top] += 1
        assert got == want


@pytest.mark.parametrize("most", [1, 4, 100])
def test_sainte_lague_without_sorting_a_whole_group(spark, most):
    rng = random.Random(most)
    rows = [(g, i, rng.choice([0, 5, rng.randrange(1, 3000)])) for g in ("a", "b", None) for i in range(400)] + [("none", 1, 0), ("one", 1, 9)]
    df = spark.createDataFrame(rows, "g string, party long, v0 long")
    seats = F.when(F.col("g") == "a", 700).when(F.col("g") == "b", 90).otherwise(33)
    whole = {(r.g, r.party): r.quota for r in mixing.apportion(df, seats, F.col("v0"), ["g"], ["g", "party"]).collect()}
    cut = {(r.g, r.party): r.quota for r in mixing.apportion(df, seats, F.col("v0"), ["g"], ["g", "party"], most=most).collect()}
    assert cut == whole and len(cut) == len(rows)
    for g, n in (("a", 700), ("b", 90), (None, 33), ("none", 0), ("one", 33)):
        assert sum(q for (own, _), q in cut.items() if own == g) == n
