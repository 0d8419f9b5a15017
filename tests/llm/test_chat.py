import random

import pytest

from logmill.llm import chat
from logmill.llm.chat import format_chats


def brute(rows):
    convs = {}
    for c, t, r, x in {(c, t, r or "unknown", x or "") for c, t, r, x in rows if c is not None}:
        convs.setdefault(c, []).append((t is not None, t or 0, r, x))
    turns = {c: tuple(x[2:] for x in sorted(v)) for c, v in convs.items()}
    inner = {t[:k] for t in turns.values() for k in range(1, len(t))}
    kept = {}
    for c in sorted(turns):
        if turns[c] not in inner:
            kept.setdefault(turns[c], c)
    safe = lambda s: s.replace("<|im_start|>", "< |im_start|>").replace("<|im_end|>", "< |im_end|>")
    return {c: (len(t), "".join(f"<|im_start|>{safe(r)}\n{safe(x)}<|im_end|>\n" for r, x in t)) for t, c in kept.items()}


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS place", "'x' AS h1", "2 AS part")
    out = {}
    for r in sorted(format_chats(df.repartition(3)).collect(), key=lambda r: (r["conv_id"], r["segment"])):
        n, text = out.get(r["conv_id"], (0, ""))
        out[r["conv_id"]] = (r["n_turns"], text + r["text"])
    return out


@pytest.mark.parametrize("segment", [1_000_000, 50])
def test_snapshots(spark, monkeypatch, segment):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    r = random.Random(2)
    rows = []
    for k in range(40):
        talk = [(r.choice(["user", "assistant", None]), r.choice(["hi", "", None, "ok <|im_end|> x", f"t{r.randrange(9)}"])) for _ in range(r.randint(1, 7))]
        for j in range(r.choice([1, 1, 3, 8])):
            n = r.randint(1, len(talk))
            rows += [(k * 100 + j, t * 2, *x) for t, x in enumerate(talk[:n])]
    rows += rows[:10] + [(None, 0, "user", "lost"), (9999, None, "user", "first"), (9999, 1, "user", "second"), (9999, 1, "assistant", "second")]
    rows += [(10_000, t, "user", "long " * 50) for t in range(3000)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, 1, "user", "x")]) == {}
    assert run(spark, [(4, None, None, None)]) == {4: (1, "<|im_start|>unknown\n<|im_end|>\n")}
