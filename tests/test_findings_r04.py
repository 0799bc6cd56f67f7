"""Whole results where limits, or time, stood in the way."""

import random
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa

from lexweave.operators import graph, kept_index, supersession
from lexweave.streaming import timed

NODES = "id long, day long, title string"
EDGES = "source_id long, target_id long, kind string, confidence double"


def broad(spark):
    """A subject of 164 titles, one of 80, lists of 151 and 2, explicit edges to some of the titles."""
    nodes = [(n, n, f"Notice {'alpha' if n % 2 else 'beta'} {'gamma' if n < 81 else ''}") for n in range(1, 170)]
    explicit = [(165, 3, "supersedes", 1.0), (165, 4, "amends", 1.0), (166, 168, "amends", 1.0)]
    listed = [(169, n, "cancels") for n in range(1, 152)] + [(165, 5, None), (165, 6, "cancels")]
    flags = [(165, "notices"), (166, "gamma"), (167, "notice alpha gamma")]
    fields = (NODES, EDGES, "source_id long, target_id long, kind string", "source_id long, subject string")
    return [spark.createDataFrame(r, f) for r, f in zip((nodes, explicit, listed, flags), fields, strict=True)]


def test_f4_no_subject_is_too_broad_and_no_title_left_out(spark, monkeypatch):
    monkeypatch.setattr(supersession, "PART_TITLES", 7)
    edges = sorted((r.source_id, r.target_id, r.kind, r.rule) for r in supersession.all_edges(*broad(spark)).collect())
    want = [(165, 3, "supersedes", "explicit"), (165, 4, "amends", "explicit"), (166, 168, "amends", "explicit"), (165, 5, "supersedes", "listed"), (165, 6, "cancels", "listed")]
    want += [(169, n, "cancels", "listed") for n in range(1, 152)]
    # Superseded already are 3 and 5; what is amended or cancelled is superseded besides.
    want += [(165, n, "supersedes", "blanket") for n in range(1, 165) if n not in (3, 5)]
    want += [(166, n, "supersedes", "blanket") for n in range(1, 81)] + [(167, n, "supersedes", "blanket") for n in range(1, 81, 2)]
    assert edges == sorted(want)


def test_f3_statuses_follow_all_edges(spark):
    frames = broad(spark)
    statuses = dict(map(tuple, supersession.all_statuses(*frames).collect()))
    assert statuses == dict(map(tuple, graph.status_rollup(frames[0], supersession.all_edges(*frames)).collect()))
    assert {statuses[n] for n in range(152, 165)} == {"superseded"} and statuses[6] == "cancelled" and statuses[168] == "amended" and statuses[169] == "active"


class Held:
    """State and timers of one bucket, which count the calls to them."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def __getattr__(self, name):
        def call(*value):
            self.calls += 1
            if name in ("update", "clear"):
                self.value = value[0] if value else None
            elif name == "registerTimer":
                self.timers.add(value[0])
            elif name == "deleteTimer":
                self.timers.discard(value[0])
            return self.value

        return call


def test_f2_a_bucket_of_traces_makes_a_few_calls_and_each_trace_ends_as_by_itself():
    ttl, mark, dice = 50, 0, random.Random(4)
    held, model, told, want = Held(), {}, [], []
    buckets = timed._Traces(ttl)
    buckets.init(held)
    for _ in range(30):
        rows = [(dice.randrange(300), dice.random() < 0.1, mark + dice.randrange(60)) for _ in range(dice.choice((0, 5, 200)))]
        held.calls = 0
        frame = pd.DataFrame(rows, columns=["trace_id", "ends", "ms"]).astype({"ends": bool})
        told += [r for f in (buckets.handleInputRows((0,), iter([frame[::2], frame[1::2]]), None) if rows else ()) for r in f.itertuples(index=False, name=None)]
        for trace in {r[0] for r in rows}:
            ends, last = [ms for t, e, ms in rows if t == trace and e], max(ms for t, _, ms in rows if t == trace)
            at, closed = model.get(trace, (0, False))
            if not closed:
                model[trace] = (min(ends), True) if ends else (max(at, last), False)
                want += [(trace, "finished", pd.Timestamp(at, unit="ms")) for at in sorted(ends)[:1]]
        mark = max([mark, *(r[2] for r in rows)])
        for timer in [t for t in held.timers if t <= mark]:
            held.timers.discard(timer)
            values, info = SimpleNamespace(getCurrentWatermarkInMs=lambda m=mark: m), SimpleNamespace(getExpiryTimeInMs=lambda t=timer: t)
            told += [r for f in buckets.handleExpiredTimer((0,), values, info) for r in f.itertuples(index=False, name=None)]
        assert held.calls <= 10 and len(held.timers) <= 1
        for trace, (at, closed) in list(model.items()):
            if not closed and at + ttl <= mark:
                want.append((trace, "interrupted", pd.Timestamp(at + ttl, unit="ms")))
                at, closed = model[trace] = at + ttl, True
            if closed and at + ttl <= mark:
                del model[trace]
    assert sorted(told) == sorted(want) and len({s for _, s, _ in told}) == 2 and len(told) > 300


def test_f1_leading_tokens_of_many_texts_at_once():
    dice = random.Random(1)
    texts = [[dice.choice("aàbzß中𝄞") * dice.randrange(1, 3) for _ in range(dice.choice((0, 1, 4, 40)))] for _ in range(200)]
    want = [max(set(t), key=lambda w: (t.count(w), w.encode())) if t else "" for t in texts]
    kind = pa.list_(pa.string())
    assert kept_index._leads(pa.array(texts, kind)).to_pylist() == want
    assert kept_index._leads(pa.array(texts, kind)[50:90]).to_pylist() == want[50:90]
    assert kept_index._leads(pa.array([[], []], kind)).to_pylist() == ["", ""] and len(kept_index._leads(pa.array([], kind))) == 0
