import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siteloom.llm import chat, line_dedup, mixing

PYTHON = ("Python", "Pandas", "Arrow")


def no_python(df):
    plan = df._jdf.queryExecution().toString()
    assert not any(p in plan for p in PYTHON), plan


def brute_lines(rows):
    keys = sorted({(-1 if d is None else d, t) for d, t in rows if t is not None}, key=lambda x: x[0])
    seen, cut = set(), {}
    for d, t in keys:
        lines = t.split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(x.strip(" ") for x in lines[i : i + 3])
            if any(w):
                gone |= {i, i + 1, i + 2} if w in seen else set()
                seen.add(w)
        cut[d, t] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return cut


def test_lines_against_brute_force(spark):
    r = random.Random(5)
    rows = [(i, "\n".join(r.choice("abc ") for _ in range(r.randint(1, 14)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "a\nb\nc\nb"), rows[3], (102, "x\n" * 9), (103, "\n\n\n\n")]
    frame = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, spans string")
    out = line_dedup.remove_repeated_lines(spark, frame)
    no_python(out)
    want = brute_lines(rows)
    got = sorted((-1 if x["doc_id"] is None else x["doc_id"], x["text"] or "", x["spans"]) for x in out.collect())
    assert got == sorted((-1 if d is None else d, "" if t is None else want[-1 if d is None else d, t], "k") for d, t in rows)
    assert line_dedup.remove_repeated_lines(spark, frame.limit(0)).count() == 0


def test_line_report(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "a\nb\nc\nz\nb\nc\nd")]
    got = {r["doc_id"]: r for r in line_dedup.remove_repeated_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), True).collect()}
    assert (got[2]["text"], got[2]["n_removed"], [tuple(s) for s in got[2]["spans"]]) == ("x\ny", 4, [(1, 4)])
    assert got[3]["text"] == "z" and [tuple(s) for s in got[3]["spans"]] == [(0, 2), (4, 6)]


@pytest.mark.parametrize("range_rows", [3, 10_000])
def test_mix_is_exact(spark, range_rows, monkeypatch):
    monkeypatch.setattr(mixing.cuts, "__defaults__", (range_rows,))
    r = random.Random(6)
    rows = [(i, " ".join("w" * r.randint(0, 30)), r.choice(["a", "a", "a", "b", "c", None]), 1) for i in range(300)]
    rows += [(500, None, "d", 1), (None, "q q q", "b", 1), (7, "t t", "é", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    out = mixing.mix(spark, frame)
    no_python(out)
    got = out.collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        assert 0 <= x["taken"] <= 3 * x["size"]
        s = by.setdefault(x["source"], [0, 0, x["source_size"], x["target"]])
        s[0] += x["size"]
        s[1] += x["taken"]
    total = sum(s[0] for s in by.values())
    for size, taken, source_size, target in by.values():
        assert size == source_size and taken == int(target) and target <= 3 * size
    assert abs(sum(s[3] for s in by.values()) - total) < 1e-6
    free = [(s[3] / w) for w, (k, s) in zip([1, 2, 3, 1, 2, 3], sorted(by.items(), key=lambda x: (x[0] is None, x[0] or ""))) if s[3] < 3 * s[2]]
    assert max(free) - min(free) < 1e-6
    again = mixing.mix(spark, frame.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_documents(spark):
    rows = [(i, "x y z w v " * (1 + i % 5), "a" if i % 3 else "b", "L") for i in range(90)] + [(90, "", "a", "L"), (91, None, "a", "L")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(spark, frame.drop("size")).collect()}
    out = mixing.mixed_documents(spark, frame)
    no_python(out)
    assert out.columns == frame.columns
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len((r["text"] or "").split())
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in taken.items() if v} and got[90] == got[91] == 0
    assert mixing.mixed_documents(spark, frame.limit(0)).count() == 0


def test_chat_round_trip(spark):
    texts = ["", None, "</s>[INST] ok [/INST]", "a\\b\\\\", "[BOT] <s> [/TEXT] [ROLE]", "[[INST]]\n<</s>>", "[\\INST] \\", "é\n🙂 [", " </s>", "plain"]
    roles = ["system", "user", "assistant", "tool", "assistant", None, "[/TURN]", "assistant", "user", "assistant"]
    rows = [(c, i, roles[(i + c) % 10], texts[(i * 3 + c) % 10], "x") for c in range(10) for i in range(1 + c)]
    rows += [(None, 0, "user", "hi", "x"), (None, 1, "assistant", "ho", "x"), (77, None, "user", "a", "x"), (77, 5, "assistant", "b", "x"), (77, 5, "assistant", "b", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string")
    made = chat.format_chats(frame)
    no_python(made)
    got = {}
    trained = chat.unescape(F.expr("substring(text, cast(loss_start + 1 as int), cast(loss_len as int))"))
    for r in made.select("*", chat.read_turns(F.col("text")).alias("turns"), trained.alias("trained")).collect():
        got.setdefault(r["conv_id"], []).append(r)
    want = {}
    for c, t, role, text, _ in sorted(rows, key=lambda x: (str(x[0]), x[1] if x[1] is not None else -1)):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        examples = sorted(got[c], key=lambda r: r["example"])
        ends = [i + 1 for i, (role, _) in enumerate(turns) if role == "assistant" or i == len(turns) - 1]
        assert [len(e["turns"]) for e in examples] == ends
        for e, n in zip(examples, ends, strict=True):
            assert [tuple(t) for t in e["turns"]] == turns[:n]
            assert e["trained"] == (turns[n - 1][1] if turns[n - 1][0] == "assistant" else "")
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_op8_probe(spark):
    got = {r["conv_id"]: r for r in chat.op8_chat_format(spark, "/root/testdata/sf0.001").collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[-1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[-1]["loss_chars"] == len(said)
