"""Layouts, escaping and the way back."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from mailgraph.llm import chat

PARTS = ["</s>", "[INST]", "[/INST]", "\\", "<", "[", "/s>", "INST]", " ", "\n", "é", "ok", "<\\/s>", "[\\\\INST]"]


def odd_texts(n):
    rng = random.Random(1)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 9))) for _ in range(n)]


def test_everything_comes_back(spark):
    texts = odd_texts(600)
    rows = [(n // 6, n % 6, ["user", "assistant", "a\nb</s>", "x [/INST", "", "system"][n % 6], t) for n, t in enumerate(texts)]
    rows += [(1000, 0, None, None), (1000, 0, None, None), (None, 1, "assistant", "z"), (1001, None, "assistant", "w " * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat.canonical(df.withColumn("mask", F.lit("clash")))
    formatted = chat.format_turns(turns).collect()
    template = chat.Template()
    want = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert len(formatted) == len(want)
    for row in formatted:
        assert chat.read_turns(row["formatted"], template) == want[row["conv_id"]]
        learned = chat.read_learned(row["formatted"], row["mask"], template)
        assert learned == [t for r, t in want[row["conv_id"]] if r == "assistant"]
        assert sum(m["length"] for m in row["mask"]) == len(row["formatted"])
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    for conv, said in want.items():
        text = "".join(f"{r}\n{t}\n" for r, t in said)
        assert back[conv]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert back[conv]["n_turns"] == len(said)
    assert chat.read_back(chat.format_turns(chat.canonical(df.limit(0)))).count() == 0


def test_layouts_give_the_same_turns(spark):
    want = [("user", "q"), ("assistant", "a")]
    messages = spark.createDataFrame([(1, want)], "conv_id long, messages array<struct<role:string,content:string>>")
    senders = spark.createDataFrame(
        [(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<from:string,value:string>>"
    )
    prompt = spark.createDataFrame([(1, "q", "a")], "conv_id long, prompt string, response string")
    instruction = spark.createDataFrame(
        [(1, "q", "", "a")], "conv_id long, instruction string, input string, output string"
    )
    for df in (messages, senders, prompt, instruction, prompt.withColumn("extra", F.lit(1))):
        row = chat.canonical(df).first()
        assert row["conv_id"] == 1 and [tuple(t) for t in row["turns"]] == want
    with pytest.raises(ValueError):
        chat.canonical(spark.range(1))


def test_json_records_pick_their_layout(spark):
    records = [
        {"conv_id": 1, "messages": [{"role": "user", "content": "q"}]},
        {"conv_id": 2, "prompt": "q", "response": None},
        {"conv_id": 3, "instruction": "do", "input": "this", "output": "done", "other": [1]},
        {"conv_id": 4, "system": "s", "prompt": "q", "response": "a"},
        {"x": 1},
    ]
    lines = [json.dumps(r) for r in records] + [None, "{broken"]
    df = spark.createDataFrame([(line,) for line in lines], "record string")
    out = {r["conv_id"]: r for r in chat.canonical_json(df, "record").collect()}
    assert [tuple(t) for t in out[1]["turns"]] == [("user", "q")]
    assert [tuple(t) for t in out[2]["turns"]] == [("user", "q"), ("assistant", "")]
    assert [tuple(t) for t in out[3]["turns"]] == [("user", "do\n\nthis"), ("assistant", "done")]
    assert out[4]["layout"] == "prompt with system" and len(out[4]["turns"]) == 3
    assert out[None]["turns"] is None and len(out) == 5


def test_fingerprints_differ_and_ignore_order():
    assert len(chat.layout_table()) == len(chat.LAYOUTS)
    a = chat.record_paths({"a": 1, "b": [{"c": "x"}, {"c": "y"}]})
    b = chat.record_paths({"b": [{"c": "z"}], "a": 2.5})
    assert chat.fingerprint(a) == chat.fingerprint(b) != chat.fingerprint(chat.record_paths({"a": "1"}))
