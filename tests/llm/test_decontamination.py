"""Leaks against a plain scan over all shifts; changed numbers, names and units; odd rows."""

import pytest

from jobsieve.llm import decontamination as D

ITEMS = [
    (1, "On Monday a farmer called Alice sold 12 apples for 3 dollars each, then Alice bought 12 pears from Bob and walked 5 km home."),
    (2, "Which river runs through the old capital and ends in the northern sea near the harbour?"),
    (3, "Short item of six tokens only"), (4, None), (None, "An item without an id but with a text of enough words to be found again."),
    (5, "Two plus two"), (6, "3 + 4 = ?"), (7, "?!"),
]
CHANGED = ITEMS[0][1].replace("Alice", "Carol").replace("12", "40").replace("3 dollars", "9 euros").replace("5 km", "8 miles")
MIXED = "On Monday a farmer called Carol sold 40 apples for 9 dollars each, then Dave bought 41 pears from Emma and ran home."
FILL = "This filler sentence talks about nothing that any item of the list would mention today. " * 4
DOCS = [
    (1, FILL + ITEMS[0][1] + FILL), (2, FILL + "\n" + CHANGED + "\n" + FILL), (3, FILL), (4, None), (5, ""),
    (6, ITEMS[1][1].upper()), (7, "Which river runs through the old capital and then stops"), (8, "so: short ITEM of six tokens, only!"),
    (9, "word " * 60_000 + ITEMS[1][1]), (10, MIXED), (None, ITEMS[1][1]), (1, FILL + ITEMS[0][1] + FILL),
    (11, ITEMS[4][1]), (12, "two plus two two plus two"), (13, "He paid 3 4 5 times, and 3 + 4 is seven"),
    (14, "so 3 + 4 = ? is easy"), (15, "5 plus 7 and 8 plus 9"),
]


def plain(text, items=ITEMS):
    """All items that any shift shows."""
    doc, out = D.tokens(text), []
    for item_id, item_text in items:
        item = D.tokens(item_text)
        best = D.evidence(doc, item, list(range(-len(item.kinds), len(doc.words) + 1)))
        if best:
            out.append((item_id, best[0], best[1], best[3], best[2], item.literal, best[2] == 0))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(*d, 1) for d in DOCS], "doc_id long, text string, item_id int").repartition(3)
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_against_plain_scan(tables):
    got = [tuple(r) for r in D.leaks(*tables).collect()]
    want = [(d, *r) for d, t in DOCS for r in plain(t)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[0] for r in got} == {1, 2, 6, 8, 9, 10, 11, 12, 14, None} - ({10} if not plain(MIXED) else set())
    changed = next(r for r in got if r[0] == 2)
    assert changed[5] > 0 and not changed[7]
    literal = {r[:2] for r in got if r[6]}
    assert literal == {(12, 5), (14, 6)}


PROBES = [
    ("Alice has 12 apples. Bob gives 3 pears to Alice. Alice eats 2 of them. How many are left?",
     "Carol has 40 apples. Dave gives 9 pears to Carol. Carol eats 4 of them. How many are left?"),
    ("Last week a boy named Tom bought 12 red apples and his aunt Mary sold him 3 green ones for 2 dollars at the market.",
     "Last week a boy named Tom Reed bought 7 red apples and his aunt Ann sold him 5 green ones for 4 dollars at the market."),
    ("A sack of 5 kg costs 3 dollars while a sack of 9 kg costs 4 dollars in town.",
     "A sack of 7kg costs 8 dollars while a sack of 2kg costs 6 euros in town."),
    ("Every pupil reads 3 books in 5 weeks and writes 2 letters about them.",
     "Every pupil reads three books in two months and writes five letters about them."),
]


@pytest.mark.parametrize("item, text", PROBES)
def test_changed_questions_are_found(spark, item, text):
    docs = spark.createDataFrame([(1, FILL + text + FILL), (2, FILL)], "doc_id long, text string")
    (row,) = D.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert (row.doc_id, row.item_id, row.exact, row.literal) == (1, 7, False, False)
    assert row.n_changed > 1 and row.first_word <= len(FILL.split()) + 4


def test_slots_must_be_consistent():
    item = D.tokens(ITEMS[0][1])
    assert D.agreement(D.tokens(CHANGED), item, 0)[1] == len(item.kinds)
    found = D.agreement(D.tokens(MIXED), item, 0)
    assert found is None or found[1] < len(item.kinds)


def test_placeholders_alone_tell_nothing(spark):
    text = "In 1999 3 4 5 6 of 12 to Ann Lee 17 km. What is 2024 going to bring for the harbour? Tom 5 Bob 6 Eve 7."
    items = [(1, "3 + 4 = ?"), (2, "What is 12 plus 7?"), (3, "12 13 14"), (4, "Ann 3 Tom 4 Bob 9")]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert D.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert D.leaks(real, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_canonical_words():
    assert D.canonical("3,000.50")[0] == D.NUMBER and D.canonical("km.")[0] == D.UNIT and D.canonical("5kg")[0] == D.NUMBER
    assert D.canonical("Alice,") == (D.NAME, "alice") and D.canonical("Which") == ("which", "")
    assert D.canonical("LOUD") == ("loud", "") and D.canonical("--") == ("", "") and D.canonical("Seven")[0] == D.NUMBER
    folded = D.tokens("Tom Reed, Ann Lee paid 5 kg - 3 pounds")
    assert folded.kinds == [D.NAME, D.NAME, "paid", D.NUMBER] and folded.starts == [0, 2, 4, 5]


def test_clean_documents(tables):
    docs, items = tables
    clean = D.clean_documents(docs, items)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} >= {3, 4, 5, 7, 13, 15} and not {r.doc_id for r in clean.collect()} & {1, 2, 6, 9}
    assert D.leaks(docs.limit(0), items).count() == 0 and D.leaks(docs, items.limit(0)).count() == 0
