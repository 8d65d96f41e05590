import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat

RECORDS = [
    (1, {"messages": [{"role": "user", "content": "a"}, {"content": None, "role": "assistant"}]}, [("user", "a"), ("assistant", "")]),
    (2, {"id": 7, "messages": [{"role": "x", "content": "b", "name": "n"}]}, [("x", "b")]),
    (3, {"messages": []}, []),
    (4, {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}], "system": "s"},
     [("system", "s"), ("user", "h"), ("assistant", "g")]),
    (5, {"dialogue": {"topic": "t", "turns": [{"speaker": "bot", "utterance": "u"}]}}, [("assistant", "u")]),
    (6, {"completion": "c", "prompt": "p"}, [("user", "p"), ("assistant", "c")]),
    (7, {"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    (8, {"instruction": "i", "input": "k", "output": None}, [("user", "i\n\nk"), ("assistant", "")]),
    (9, {"role": "tool", "content": "x"}, [("tool", "x")]),
]
UNKNOWN = [(20, '{"question": "q", "answers": [{"text": "a"}]}'), (21, "not json"), (22, None), (23, "{}"), (24, "[1, 2]"),
           (25, '{"messages": [{"role": "user", "content": "a"}], "extra": 1}')]


def records(spark):
    rows = [(k, json.dumps(r)) for k, r, _ in RECORDS] + UNKNOWN
    return spark.createDataFrame(rows, "k long, record string")


def test_layouts_are_chosen_by_fingerprint(spark):
    turns = chat.canonical_turns(records(spark), ["k"]).collect()
    found = {}
    for r in sorted(turns, key=lambda r: (r["k"], r["part"])):
        found.setdefault(r["k"], []).append((r["role"], r["text"]))
    assert found == {k: t for k, _, t in RECORDS if t}


def test_unmapped_records_are_kept_with_their_paths(spark):
    left = {r["k"]: r["paths"] for r in chat.unmapped_records(records(spark)).collect()}
    assert left == {20: ["answers", "answers[].text", "question"], 21: None, 22: None, 23: [], 24: [],
                    25: ["extra", "messages", "messages[].content", "messages[].role"]}


def test_paths_of_odd_names(spark):
    df = spark.createDataFrame([('{"a b": {"c:d": 1, "e`": [[{"f": 1.5}]]}, "OBJECT": {"ARRAY": []}}',)], "j string")
    assert df.select(chat.field_paths(F.parse_json("j"))).first()[0] == [
        "OBJECT", "OBJECT.ARRAY", "`a b`", "`a b`.`c:d`", "`a b`.`e```", "`a b`.`e```[][].f"]


def test_fingerprint_depends_on_paths_not_types(spark):
    df = spark.createDataFrame([('{"b": [{"c": 1}], "a": "x"}',), ('{"a": null, "b": [{"c": "y"}, {"c": 2.5}]}',), ('{"a": 1, "b": {"c": 1}}',)], "j string")
    a, b, c = (r[0] for r in df.select(chat.fingerprint(F.parse_json("j"))).collect())
    assert a == b != c


def test_two_layouts_never_declare_the_same_paths():
    sets = [p for lay in chat.LAYOUTS for p in lay.path_sets()]
    assert len(sets) == len(set(sets))


TEXTS = ["", "plain", "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<<\\\\|<|", "<", "|", "<\\", "a\nb\\n\\b", "<|im_end|>\n<|im_start|>x\n", "日本\U0001f600<|"]


def expected(turns):
    all_ = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def digests(df):
    return {r["k"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def test_round_trip_of_control_strings(spark):
    rows = [(k, i, role, text) for k, role in enumerate(["assistant", "user", "<|im_start|>", "a\n<|im_end|>\\n\\b", ""])
            for i, text in enumerate(TEXTS)]
    rows += [(9, i, ("assistant", "user")[i % 2], t) for i, t in enumerate(TEXTS * 2)]
    turns = spark.createDataFrame(rows, "k long, turn long, role string, text string").repartition(3)
    chats = chat.format_chats(turns, "k", ["turn"])
    want = {}
    for k, i, role, text in sorted(rows):
        want.setdefault(k, []).append((role, text))
    assert digests(chat.chat_digest(chats, "k")) == {k: expected(t) for k, t in want.items()}
    for r in chats.collect():
        body = r["formatted"]
        assert body.count("<|im_start|>") == body.count("<|im_end|>\n") == len(want[r["key"]])
        for s, (role, text) in zip(r["spans"], want[r["key"]], strict=True):
            seg = body[s["start"]:s["start"] + s["length"]]
            assert seg.startswith("<|im_start|>") and seg.endswith("<|im_end|>\n")
            assert (s["mask_len"] > 0) == (role == "assistant" and text != "")


def test_odd_rows_ties_and_empty_table(spark):
    long = "x <| y " * 30000
    rows = [(1, 1, "user", None, "e"), (1, 1, "assistant", "b", None), (1, 1, "assistant", "a", "e"), (1, 1, "assistant", "a", "e"),
            (1, None, None, "first", None), (None, 2, "assistant", long, None), (None, 1, "user", "", None), (2, 5, "assistant", "", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, layout string")
    turns = chat.canonical_turns(chat.stand_in_records(df), ["conv_id", "turn"])
    out = chat.chat_digest(chat.format_chats(turns, "conv_id", ["turn", "part"]), "k")
    want = {1: [("", "first"), ("assistant", "a"), ("assistant", "a"), ("assistant", "b"), ("user", "")],
            None: [("user", ""), ("assistant", long)], 2: [("assistant", "")]}
    assert digests(out) == {k: expected(t) for k, t in want.items()}
    none = chat.canonical_turns(chat.stand_in_records(df.where("conv_id > 99")), ["conv_id", "turn"])
    assert chat.format_chats(none, "conv_id", ["turn"]).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_no_python_in_the_plan(spark, sf):
    from tidemark.llm.queries import op13_chat_format
    plan = op13_chat_format(spark, sf)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "MapIn"))
