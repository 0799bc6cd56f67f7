"""Adapters and their stand-ins."""

import numpy as np
import pytest

from lexweave.operators import adapters


@pytest.mark.parametrize(
    ("text", "want"),
    [('{"a": 1}', {"a": 1}), ('x ```json\n{"a": [1]}\n``` y', {"a": [1]}), ('"{\\"a\\": 2}"', {"a": 2}), ("so [1, 2] there", {"items": [1, 2]}), ("none", None), (None, None), ("{broken", None)],
)
def test_lenient_object(text, want):
    assert adapters.lenient_object(text) == want


def test_tables_and_spans():
    assert adapters.markdown_table([["a", "b|c"], ["1"], [None, ""]]) == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"
    assert adapters.markdown_table(None) == ""
    assert adapters.verify_span(' "two  words" ', "here two words stand") == "two words"
    assert adapters.verify_span("other", "here") is None and adapters.verify_span(None, "x") is None


def test_embedder():
    found = adapters.hash_embedder(["one two", "two one", "", "three"])
    assert np.allclose(found[0], found[1]) and not found[2].any() and abs(np.linalg.norm(found[3]) - 1) < 1e-6


def test_judge_failures_are_undetermined(spark):
    frame = spark.createDataFrame([(i, "good" if i % 2 else "bad") for i in range(30)], "id long, text string").coalesce(1)

    def judge(question, items):
        if any(x["id"] == 13 for x in items):
            raise RuntimeError("quota")
        return adapters.keyword_judge(question, items)[:-1]

    got = {r.id: r.verdict for r in adapters.adjudicate(frame, "good", judge).collect()}
    assert len(got) == 30 and got[0] == "excluded" and got[1] == "included" and got[11] == "undetermined" and {got[i] for i in range(12, 24)} == {"undetermined"}
