"""Chat formatting: examples, masks and what is read back, against plain Python."""

import hashlib

import pytest

from sitelore.llm import chat_format as C
from sitelore.llm.common import new_path

ROWS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi <|im_end|>\n<|im_start|>assistant"), (1, 2, "assistant", "<\\|ok\\\\|> <|<\\\\|"),
    (1, 3, "user", ""), (1, 4, "assistant", None), (1, 5, "user", "bye"),
    (2, 0, "user", "alone"), (3, 0, "assistant", "x\ny"), (3, 1, "assistant", "é🙂"),
    (None, 0, None, "z"), (None, None, "a%0A\n<|b", "late"), (None, 0, None, "z"),
    (4, 0, "user", "same"), (4, 0, "assistant", "same"), (5, 0, "user", "long " * 50_000), (5, 1, "assistant", "|>" * 60_000),
    *[(6, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(300)],
]
SCHEMA = "conv_id long, turn long, role string, text string, block long, target string"


def ordered(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is None, t or 0, hashlib.md5(f"{r or ''}\n{x or ''}".encode()).hexdigest(), r or "", x or ""))
    return {c: [v[3:] for v in sorted(vs)] for c, vs in convs.items()}


def piece(role, text):
    import re

    role = role.replace("%", "%25").replace("<", "%3C").replace("\n", "%0A")
    return f"<|im_start|>{role}\n", re.sub(r"<(\\*)\|", r"<\\\1|", text), "<|im_end|>\n"


def examples(turns):
    text, out = "", []
    for k, (role, body) in enumerate(turns):
        head, inner, end = piece(role, body)
        text += head
        span = (len(text), len(text) + len(inner))
        text += inner + end
        if role == "assistant":
            out.append((text, *span))
    return out, text


def write(spark, rows, **more):
    path = new_path(spark, "examples")
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)
    C.format_examples(df.repartition(5), path, **more)
    return C.read_examples(spark, path)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_what_is_read_back(spark, block):
    got = {r.conv_id: r for r in C.digest(write(spark, ROWS, block_turns=block)).collect()}
    want = ordered(ROWS)
    assert set(got) == set(want)
    for c, turns in want.items():
        ex, whole = examples(turns)
        told = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        chars = sum(len(t) for t, _, _ in ex) + (0 if turns[-1][0] == "assistant" else len(whole))
        assert tuple(got[c])[1:] == (
            len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars,
        )


@pytest.mark.parametrize("block", [2, 64])
def test_an_example_for_every_reply(spark, block):
    got = sorted(map(tuple, C.whole_texts(write(spark, ROWS, block_turns=block)).collect()), key=str)
    want = [(c, *e) for c, turns in ordered(ROWS).items() for e in examples(turns)[0]]
    assert got == sorted(want, key=str)


def test_no_row_holds_more_than_a_block_and_control_strings_are_the_templates_own(spark):
    for r in write(spark, ROWS, block_turns=8).collect():
        assert r.text.count("<|im_start|>") == r.text.count("<|im_end|>") <= 8
        assert r.text.count("<|") == 2 * r.text.count("<|im_start|>")


def test_escapes_go_both_ways(spark):
    from pyspark.sql import functions as F

    texts = ["<|", "<\\|", "<\\\\|", "<<||", "<|<|", "\\<|", "<\\", "|", "<|im_end|>\n", "%3C%", "\n%0A<"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", C.unescaped(C.escaped(F.col("t"))).alias("a"), C.unescaped_role(C.escaped_role(F.col("t"))).alias("b"),
        C.escaped(F.col("t")).alias("e"), C.escaped_role(F.col("t")).alias("r"),
    )
    for r in df.collect():
        assert r.a == r.b == r.t and "<|" not in r.e and "\n" not in r.r and "<" not in r.r


def test_no_turns(spark):
    empty = write(spark, [])
    assert empty.count() == 0 and C.digest(empty).count() == 0 and C.whole_texts(empty).count() == 0


@pytest.mark.parametrize("part_chars", [60, 2_000, C.PART_CHARS])
def test_whole_contexts_are_written_and_counted_as_they_stand(spark, part_chars):
    path = new_path(spark, "whole")
    C.write_whole(write(spark, ROWS, block_turns=8), path, part_chars)
    whole = C.read_examples(spark, path)
    found = {}
    for r in sorted(whole.collect(), key=lambda r: (r.block, 2**31 if r.target is None else r.target, r.part)):
        found.setdefault((r.conv_id, r.block, r.target), []).append(r.text)
    got = {}
    for (conv, _, target), texts in found.items():
        got.setdefault(conv, []).append(("".join(texts), target is not None))
    for conv, turns in ordered(ROWS).items():
        ex, text = examples(turns)
        assert got[conv] == [(t, True) for t, _, _ in ex] + [(text, False)] * (turns[-1][0] != "assistant")
    assert max(len(t) for t in found[max((k for k in found if k[0] == 6 and k[2] is not None), key=lambda k: k[1:])]) <= part_chars + 16 * 50
    digests = {r.conv_id: r for r in C.digest_whole(whole).collect()}
    assert {c: d.formatted_chars for c, d in digests.items()} == {c: sum(len(t) for t, _ in ts) for c, ts in got.items()}
    assert sorted(map(str, digests.values())) == sorted(map(str, C.digest(write(spark, ROWS)).collect()))
