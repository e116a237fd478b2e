"""Items of a few tokens inside longer texts, against a plain scan over every shift."""

from jobsieve.llm import decontamination as D

FILL = "This filler sentence talks about nothing that any item of the list would mention today. " * 3
ITEMS = [
    (1, "What is 12 plus 7?"), (2, "Two plus two"), (3, "Why do cats purr when stroked at home by night?"), (4, "Nevermore"),
    (5, "Which river runs through the old capital and ends in the northern sea near the harbour?"), (6, "?!"), (7, None),
    (8, "Name the tallest tree that grows here"),
]
DOCS = [
    (1, FILL + "What is 12 plus 7? " + FILL), (2, FILL + "what is 40 plus 9, " + FILL), (3, FILL + "so two plus two is four. " + FILL),
    (4, FILL + "they ask why do cats purr when stroked and more of that. " + FILL), (5, FILL), (6, ""), (7, None), (8, "plus two"),
    (9, FILL + "quoth the raven nevermore. " + FILL), (10, "cats purr when stroked at home"), (11, FILL + ITEMS[4][1] + FILL),
    (12, "the tallest tree that grows"), (13, "the tallest tree was cut and that grows here"),
]


def plain(text):
    doc, out = D.tokens(text), []
    for item_id, item_text in ITEMS:
        item = D.tokens(item_text)
        best = D.evidence(doc, item, list(range(-len(item.kinds), len(doc.words) + 1)))
        if best:
            out.append((item_id, best[0], best[1], best[3], best[2], item.literal, best[2] == 0))
    return out


def test_short_items_in_longer_texts(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [tuple(r) for r in D.leaks(docs, items).collect()]
    assert sorted(got) == sorted((d, *r) for d, t in DOCS for r in plain(t))
    assert {(1, 1), (2, 1), (3, 2), (4, 3), (9, 4), (10, 3), (11, 5), (12, 8)} <= {r[:2] for r in got}
    assert {r.doc_id for r in D.clean_documents(docs, items).collect()} == {5, 6, 7, 8, 13}


def test_filter_changes_no_result(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    with_filter = sorted(map(tuple, D.leaks(docs, items).collect()))
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert with_filter == sorted(map(tuple, D.leaks(docs, items).collect()))
