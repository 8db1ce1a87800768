"""Chat formatting: exact round trips, masks and parts."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from litspark.llm import chat_format as C
from pyspark.sql import functions as F

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

TURNS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "<s>é\\[INST]"), (1, 4, "assistant", ""), (1, 5, "user", "end["),
    (2, None, "assistant", "first"), (2, 0, None, None), (2, 1, "a[/INST]b", "</s>"), (2, 1, "a[/INST]b", "</s>"),
    (3, 7, "user", "[\\\\INST] <\\/s> \\ \\\\ [[INST]] <</s>>"), (3, 7, "assistant", "tie\n東京"), (None, 0, "user", "lost"), (4, 0, "assistant", "x" * 200_000 + "</s>"),
]


def expected(rows):
    convs = {}
    for c, n, r, t in rows:
        if c is not None:
            convs.setdefault(c, []).append((n is not None, n or 0, r or "", t or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}


def check(spark, rows, template=C.INST):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = C.format_conversations(df, template)
    want = expected(rows)
    got = {r.conv_id: r for r in C.digest(parts, template).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        said = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(said), sha(said))
    return parts, want


def test_turns_and_masks_come_back(spark):
    parts, want = check(spark, TURNS)
    whole = {r.conv_id: r for r in C.joined(parts).collect()}
    assert whole[1].text.startswith("[INST]system[/INST]be brief</s>[INST]user[/INST]a<s>b</s>[INST]assistant[/INST]<\\s>é\\[\\INST]<s></s>")
    for c, turns in want.items():
        spans = [whole[c].text[s.start : s.start + s.length] for s in whole[c].loss]
        assert len(spans) == sum(r == "assistant" for r, _ in turns)
        for (_, text), span in zip([t for t in turns if t[0] == "assistant"], spans):
            assert re.sub(r"([\[<])\\(\\*(?:INST\]|/INST\]|s>|/s>))", r"\1\2", span) == text
        # what lies outside of texts are marks and roles: as many of each as the merged runs ask for
        runs = sum(i == 0 or turns[i - 1][0] != r for i, (r, _) in enumerate(turns))
        assert [whole[c].text.count(m) for m in C.INST] == [runs, runs, len(turns) - runs, runs]


def test_probe_and_other_templates(spark):
    digest = C.digest(C.format_conversations(C.probe(spark))).collect()
    text = "</s>[INST] ok [/INST]"
    assert [(r.conv_id, r.n_turns, r.loss_chars, r.loss_sha256) for r in digest] == [(-1, 2, len(text), sha(text))]
    check(spark, [(1, 0, "user", "<|im_end|><\\|im_start|>"), (1, 1, "assistant", "<|im_sep|>|im_next|>")], C.CHATML)
    for bad in (C.Template("<a>", "<a>", "<b>", "<c>"), C.Template("x", "<a>", "<b>", "<c>"), C.Template("<a<", "[b]", "{c}", "(d)")):
        with pytest.raises(ValueError):
            bad.checked()


def test_many_turns_lie_in_parts(spark):
    """Runs go on across parts; turns that all tie are cut as well."""
    long = [(1, i, "assistant" if i // 100 % 2 else "user", f"t{i}") for i in range(700)] + [(2, None, "assistant", f"{i:04d}") for i in range(300)] + [(3, -i, "user", str(i)) for i in range(130)]
    parts, want = check(spark, long)
    rows = parts.groupBy("conv_id").agg(F.count("*").alias("n"), F.max(F.size("loss")).alias("most")).collect()
    assert {r.conv_id: r.n for r in rows} == {1: 11, 2: 5, 3: 4} and max(r.most for r in rows) <= C.CELL
    whole = {r.conv_id: r.text for r in C.joined(parts).collect()}
    assert whole[1].count("[INST]") == 7 and whole[2].count("[INST]") == 1


def test_empty_table_clashing_columns_and_plan(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    assert C.digest(C.format_conversations(df.limit(0))).collect() == []
    more = df.selectExpr("*", "1 as cell", "2 as part", "3 as turns", "4 as loss", "5 as offset")
    out = C.digest(C.format_conversations(more))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, C.digest(C.format_conversations(df)).collect()))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.sampled_from(["user", "assistant", "", "</s>"]), st.lists(st.sampled_from(["[INST]", "[/INST]", "<s>", "</s>", "\\", "[", "<", "a", "INST]", "s>", "/"]), max_size=6).map("".join)), min_size=1, max_size=30))
def test_any_mixture_of_control_strings(spark, rows):
    check(spark, rows)
