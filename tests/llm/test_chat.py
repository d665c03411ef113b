import hashlib
import random
import re

import pytest

from urlgauge.llm.chat import TOKEN, digest, loss_texts, read_back, spans, windows

TRICKY = [r"\### Assistant: </turn> ok", "<turn user>hi</turn>\n", "\\b\\e\\s\\g\\\\", "a > b </tu", "rn>\n", "", "é😀 ü", "<turn ", "</turn></turn>", "\n\n", "\\"]


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(30):
        turn = 0
        if rng.random() < 0.4:
            rows.append((conv, turn, "system", rng.choice([*TRICKY, "be good " * rng.randrange(60)])))
            turn += 1
        for _ in range(rng.randrange(12)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "assistant", "system", "odd > role", None]), rng.choice([*TRICKY, None, "word, " * rng.choice([1, 5, 20, 400])])))
            turn += rng.choice([1, 1, 1, 0])
    return [*rows, rows[-1], (None, 0, "assistant", "lost"), (None, None, "user", "x"), (99, 0, "system", "alone")]


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append(((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()), role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_round_trip(spark, seed):
    rows = conversations(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, span string, nth int")
    made = windows(df, budget=60, history=20).cache()
    assert sorted((tuple(r)[:5] for r in digest(made).collect()), key=str) == expected(rows)
    assert digest(made).agg({"formatted_chars": "sum"}).first()[0] == sum(len(r.text) for r in made.collect())


def test_windows_keep_to_the_budget(spark):
    budget, history = 60, 20
    df = spark.createDataFrame(conversations(3), "conv_id bigint, turn bigint, role string, text string")
    sizes = {(r.conv_id, r.span): [] for r in spans(df, budget, history).collect()}
    for r in spans(df, budget, history).collect():
        sizes[r.conv_id, r.span].append((r.tokens, r.fixed))
    count = lambda text: len(re.findall(TOKEN, text)) + 4
    for r in windows(df, budget, history).collect():
        lines = r.text.split("</turn>\n")[:-1]
        fixed = lines[0].startswith("<turn system>") and (r.repeated or sizes[r.conv_id, r.span][0][1])
        own = [n for n, f in sizes[r.conv_id, r.span] if not f]
        system = count(lines[0].partition(">")[2]) if fixed else 0
        room = max(budget - history - system, budget // 4)
        assert sum(own) <= room or len(own) == 1
        assert all(x.start + x.length <= len(r.text) for x in r.loss)
        if r.span:
            repeated = lines[bool(fixed) : r.repeated]
            assert sum(len(re.findall(TOKEN, x.partition(">")[2])) for x in repeated) <= history


def test_each_target_once(spark):
    df = spark.createDataFrame(conversations(4), "conv_id bigint, turn bigint, role string, text string")
    made = windows(df, 60, 20)
    said = [t for r in loss_texts(made).collect() for t in r.texts]
    want = [r.text or "" for r in df.collect() if r.role == "assistant"]
    assert sorted(said) == sorted(want)
    assert read_back(made).count() == df.count()


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert windows(df).count() == 0 and digest(windows(df)).count() == 0
