from __future__ import annotations

import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from callscope.llm import chat
from callscope.llm.queries import QUERIES

BITS = ["<", "</", "s>", "\\", "[", "/", "INST]", "ROLE]", "TURN]", "<SYS>>", "SYS>>", " ", "a", "\n", "[/INST]", "</s>", "<<SYS>>", "é"]
TEXT = st.lists(st.sampled_from(BITS), max_size=9).map("".join)
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), TEXT), TEXT), max_size=5))
def test_round_trip(turns):
    written, spans = chat.write_turns(turns)
    assert chat.read_turns(written) == turns
    assert [chat.unescape(written[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert not any(c in chat.escape(t) for _, t in turns for c in CONTROL)


def test_query_reads_back_what_went_in(spark, sf):
    by = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        by[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    by[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    rows = QUERIES["op9_reply_trees"](spark, sf).collect()
    assert {r["conv_id"] for r in rows} == by.keys() and len(rows) == len(by)
    for r in rows:
        turns = sorted(by[r["conv_id"]])
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_branches_are_ranked(spark):
    #       r - a - c        scores: c 1, d 9, e 5
    #         \ b - d ; b - e
    rows = [
        ("t", "r", None, "user", "hi", 0.0), ("t", "a", "r", "assistant", "A", 0.0), ("t", "b", "r", "assistant", "B", 0.0),
        ("t", "c", "a", "user", "C", 1.0), ("t", "d", "b", "user", "D", 9.0), ("t", "e", "b", "user", "E", 5.0), ("t", "e", "b", "user", "E", 5.0),
        ("u", "x", "gone", None, None, None), ("u", None, "x", "user", "lost", 1.0), ("v", "1", "2", "user", "", 0.0), ("v", "2", "1", "user", "", 0.0), ("v", "3", "1", "user", "leads into a cycle", 0.0),
    ]
    frame = spark.createDataFrame(rows, "tree string, node string, parent string, role string, text string, score double")
    got = chat.format_trees(frame, best=2).orderBy("tree", "rank").collect()
    assert [(r["tree"], r["leaf"], r["rank"], r["n_turns"]) for r in got] == [("t", "d", 1, 3), ("t", "e", 2, 3), ("u", "x", 1, 1)]
    assert chat.read_turns(got[0]["formatted"]) == [("user", "hi"), ("assistant", "B"), ("user", "D")]
    assert chat.read_turns(got[2]["formatted"]) == [("", "")]
    assert chat.format_trees(frame.limit(0)).count() == 0


def test_deep_paths_and_odd_rows(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(133)]
    rows += [(None, 0, "user", "no id"), (2, 0, None, None), (3, 5, "user", "tie b"), (3, 5, "user", "tie a"), (3, None, "user", "no turn")]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, score string")
    got = {r["tree"]: chat.read_turns(r["formatted"]) for r in chat.format_trees(chat.as_replies(frame)).collect()}
    assert got["1"] == [(r[2], r[3]) for r in rows[:133]]
    assert got[""] == [("user", "no id")] and got["2"] == [("", "")]
    assert got["3"] == [("user", "no turn"), ("user", "tie a"), ("user", "tie b")]
