import hashlib
import json
import random

from pyspark.sql import functions as F

from meterloom.llm import chat

TURNS = "conv_id long, turn long, role string, text string"
CONTROL = ["<s>", "</s>", "<|", "|>", "[INST]", "[/INST]"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def check(turns, out):
    """turns: {conv: [(role, text)]}; out: rows of digest."""
    got = {r["conv_id"]: r for r in out}
    assert set(got) == set(turns)
    for c, t in turns.items():
        r, loss = got[c], "".join(x for role, x in t if role == "assistant")
        assert r["n_turns"] == len(t)
        assert r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in t))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(0)
    bits = [*CONTROL, "\\", "\\\\", "$1", "\n", " ", "a", "é", "𝔘", "|", "<", ">", "[", "</s>\n", "<|user|>\n"]
    turns = {c: [(rng.choice(["user", "assistant", "system", "tool", "<|x|>\n", ""]), "".join(rng.choices(bits, k=rng.randint(0, 12)))) for _ in range(rng.randint(1, 6))] for c in range(150)}
    turns[500] = [("user", "x" * 100_000), ("assistant", "</s>" * 5000)]
    rows = [(c, i, r, x) for c, t in turns.items() for i, (r, x) in enumerate(t)]
    rng.shuffle(rows)
    f = chat.format_conversations(chat.canonical(spark.createDataFrame(rows, TURNS)))
    check(turns, chat.digest(f).collect())
    for r in f.collect():
        text, n = r["formatted"], len(turns[r["conv_id"]])
        assert text.count("</s>") == n and text.count("<|") == n and text.count("|>") == n
        assert not any(x in text for x in ("<s>", "[INST]", "[/INST]"))


def test_nulls_and_repeats(spark):
    rows = [(None, 0, "user", "a"), (None, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "assistant", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], TURNS + ", head int")
    out = chat.digest(chat.format_conversations(chat.canonical(df))).collect()
    check({None: [("", ""), ("user", "a")], 1: [("assistant", ""), ("user", "b"), ("user", "b")]}, out)
    assert chat.format_conversations(chat.canonical(df.limit(0))).count() == 0


def test_layouts_give_the_same_turns(spark):
    t = [("user", "question"), ("assistant", "answer")]
    records = [
        {"id": 1, "messages": [{"role": a, "content": b} for a, b in t]},
        {"id": 2, "conversations": [{"from": {"user": "human", "assistant": "gpt"}[a], "value": b} for a, b in t]},
        {"id": 3, "turns": [{"speaker": a, "text": b} for a, b in t]},
        {"id": 4, "prompt": "question", "response": "answer"},
        {"id": 5, "instruction": "question", "input": "", "output": "answer"},
        {"id": 6, "question": "question", "answer": "answer"},
    ]
    odd = ['{"strange": {"deep": 1}}', "[1, 2]", "not json", "null", '"text"']
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [(o,) for o in odd] + [(None,)], "record string")
    turns = chat.canonical(df)
    check({r["id"]: t for r in records}, chat.digest(chat.format_conversations(turns)).collect())
    assert chat.fingerprints(turns).where("layout is not null").agg(F.sum("n")).first()[0] == len(records)
    lost = turns.where("layout is null").select("fingerprint", "turns").collect()
    assert len(lost) == len(odd) + 1 and all(r["turns"] is None for r in lost)
    assert [r["fingerprint"] for r in lost if r["fingerprint"]] == [hashlib.md5(b"strange.deep").hexdigest()]
    table = spark.createDataFrame([(7, "question", "answer")], "id long, prompt string, completion string")
    check({7: t}, chat.digest(chat.format_conversations(chat.canonical(table))).collect())


def test_ids_that_are_no_numbers_keep_records_apart(spark):
    rows = chat.from_records(spark, [json.dumps({"id": i, "prompt": f"p{i}", "response": "r"}) for i in ("abc", "abd", 3, None, None)] + ['{"prompt": "p", "response": ""}'] * 2)
    got = sorted((str(r["conv_key"]), r["conv_id"], len(r["turns"])) for r in rows.collect())
    assert got == [("3", 3, 2), ("None", None, 1), ("None", None, 1), ("None", None, 2), ("None", None, 2), ("abc", None, 2), ("abd", None, 2)]
    table = spark.createDataFrame([("a", 0, "user", "x"), ("b", 0, "user", "y"), ("a", 1, "gpt", "z")], "conv_id string, turn long, role string, text string")
    assert sorted((r["conv_key"], len(r["turns"])) for r in chat.canonical(table).collect()) == [("a", 2), ("b", 1)]


def test_other_fields_and_outer_objects_do_not_matter(spark):
    said = [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": "a", "extra": {"x": [1, {"y": 2}]}}]
    records = [
        {"id": 1, "messages": said, "meta": {"a": 1, "b b": [1.5, None]}},
        {"id": 2, "data": {"messages": said}},
        {"data": {"id": 3, "sample": {"messages": said}}},
        {"id": 4, "messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "image", "url": "u"}]}]},
        {"id": 5, "payload": {"prompt": "q", "response": "a", "score": 2}},
    ]
    out = chat.from_records(spark, [json.dumps(r) for r in records])
    got = {r["conv_key"]: [(t["role"], t["text"]) for t in r["turns"] or ()] for r in out.collect()}
    want = [("user", "q"), ("assistant", "a")]
    assert got == {"1": want, "2": want, None: want, "4": want, "5": want}


def test_leaf_paths_are_those_of_the_json(spark):
    def plain(x, at=""):
        if isinstance(x, dict) and x:
            return {p for k, v in x.items() for p in plain(v, f"{at}.{k}" if at else k)}
        if isinstance(x, list) and x:
            return {p for v in x for p in plain(v, at + "[]")}
        return {at + "[]" if x == [] else at}

    values = [{"a": {"b": [{"c": 1, "d": ["x"]}], "e": 1.25}, "f": [[1]], "g": None, "h i": True}, {"a": [{"b": 1}, {"c": "2020-01-01"}], "z": 123456789012345678901234567890}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string")
    for r in df.select("i", chat.leaf_paths(F.parse_json("j")).alias("p")).collect():
        assert set(r["p"]) == plain(values[r["i"]])
