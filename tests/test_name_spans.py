"""Spans of names against a plain masking, longest name first."""

import random

import pytest

from lexweave.operators.name_spans import name_spans


def masked(words, names):
    """Each name, longest first, takes the places that are still free, from the left; names of one length share an order by place."""
    free, found = [True] * len(words), []
    for n in sorted({len(w) for _, w in names if w}, reverse=True):
        of = {}
        for k, w in names:
            if len(w) == n:
                of.setdefault(tuple(w), set()).add(k)
        for at in range(len(words) - n + 1):
            if all(free[at : at + n]) and tuple(words[at : at + n]) in of:
                free[at : at + n] = [False] * n
                found += [(at, n, k) for k in of[tuple(words[at : at + n])]]
    return found


@pytest.mark.parametrize("broadcast", [True, False])
def test_spans_equal_a_masking_by_hand(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr("lexweave.operators.name_spans.BROADCAST_NAMES", 0)
    rng = random.Random(11)
    texts = [(d, [rng.choice("abcd") for _ in range(rng.choice([0, 1, 5, 60, 200]))]) for d in range(40)]
    names = [(k, [rng.choice("abcd") for _ in range(rng.choice([1, 2, 2, 3, 4, 6]))]) for k in range(30) if k % 5]
    names += [(100, names[0][1]), (101, []), (102, names[1][1]), (102, names[1][1])]
    frame = spark.createDataFrame([(d, " ".join(w).title() + "!") for d, w in texts] + [(77, None)], "id long, text string")
    listed = spark.createDataFrame([(k, "  ".join(w)) for k, w in names] + [(103, None)], "name_id long, name string")
    got = sorted(map(tuple, name_spans(frame, listed).collect()))
    assert got == sorted((d, *s) for d, w in texts for s in set(masked(w, names))) and len(got) > 300


def test_a_longer_name_hides_those_in_it(spark):
    texts = spark.createDataFrame([(1, "The Foreign Exchange Regulation Act, 1947 and the Exchange Act.")], "id long, text string")
    names = spark.createDataFrame([(1, "Foreign Exchange Regulation Act"), (2, "exchange"), (3, "act 1947"), (4, "Exchange Act")], "name_id long, name string")
    assert sorted(map(tuple, name_spans(texts, names).collect())) == [(1, 1, 4, 1), (1, 8, 2, 4)]


def test_nothing_to_find(spark):
    texts, names = spark.createDataFrame([], "id long, text string"), spark.createDataFrame([], "name_id long, name string")
    assert name_spans(texts, names).collect() == []
