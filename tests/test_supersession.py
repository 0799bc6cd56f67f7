"""Rules that add supersessions, against the same rules by plain loops."""

from lexweave.operators import graph, supersession

NODES = "id long, day long, title string"
EDGES = "source_id long, target_id long, kind string, confidence double"


def run(spark, nodes, explicit=(), listed=(), flags=(), confirm=None):
    frames = [spark.createDataFrame(list(r), f) for r, f in ((nodes, NODES), (explicit, EDGES), (listed, "source_id long, target_id long, kind string"), (flags, "source_id long, subject string"))]
    edges, review = supersession.supersessions(*frames, confirm)
    return sorted((r.source_id, r.target_id, r.kind, r.rule) for r in edges.collect()), sorted(map(tuple, review.collect())), frames[0], edges


def test_rules_in_order_with_their_provenance(spark):
    nodes = [(1, 1, "Capital Requirements for Banks"), (2, 2, "Capital requirement of banks, revised"), (3, 3, "Branch licences"), (4, 4, "Bank capital requirements"), (5, None, "Capital requirements banks"), (6, 9, "Capital requirements of all banks"), (7, 4, "Liquidity")]
    explicit = [(4, 1, "supersedes", 1.0), (4, 3, "amends", 1.0)]
    listed = [(4, 3, "cancels"), (4, 7, "cancels"), (4, 7, "supersedes"), (4, 4, "cancels"), (4, None, None), (7, 3, "amends")]
    flags = [(4, "capital requirement for banks"), (4, "capital requirement for banks"), (5, "capital"), (3, "  "), (99, "capital"), (7, "of the")]
    edges, review, frame, made = run(spark, nodes, explicit, listed, flags)
    assert edges == [(4, 1, "supersedes", "explicit"), (4, 2, "supersedes", "blanket"), (4, 3, "amends", "explicit"), (4, 7, "cancels", "listed"), (7, 3, "supersedes", "listed")]
    assert review == []
    statuses = dict(map(tuple, graph.status_rollup(frame, made).collect()))
    assert statuses == {1: "superseded", 2: "superseded", 3: "superseded", 4: "active", 5: "active", 6: "active", 7: "cancelled"}


def test_broad_subjects_and_long_lists_go_to_review(spark, monkeypatch):
    monkeypatch.setattr(supersession, "WORD_TITLES", 7)
    nodes = [(n, n, f"Notice {'alpha' if n % 2 else 'beta'} {'gamma' if n < 81 else ''}") for n in range(1, 170)]
    listed = [(169, n, "cancels") for n in range(1, 152)] + [(168, n, "cancels") for n in range(1, 151)]
    flags = [(165, "notices"), (166, "gamma"), (167, "notice alpha gamma"), (82, "notice"), (81, "notice")]
    edges, review, *_ = run(spark, nodes, listed=listed, flags=flags)
    assert review == [(82, "blanket", 81), (165, "blanket", 164), (169, "listed", 151)]
    by = lambda s: [t for source, t, _, _ in edges if source == s]
    assert by(168) == list(range(1, 151)) and by(169) == by(165) == by(82) == []
    # Eighty match each; the forty with the smallest ids of equal scores are shown.
    assert by(166) == list(range(2, 81, 2)) and by(81) == list(range(1, 80, 2)) and by(167) == list(range(1, 80, 2))
    some, _, *_ = run(spark, nodes, flags=flags, confirm=lambda best: best.where("target_id % 10 = 1"))
    assert [t for s, t, _, _ in some if s == 167] == [1, 11, 21, 31, 41, 51, 61, 71]


def test_no_rows(spark):
    assert run(spark, [])[:2] == ([], [])
