"""Rules against a plain Python version."""

import math
import random
import re
import unicodedata

import pytest

from jobsieve.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, lang string, kept string, row int, _text string"
SPACE = re.compile("[\x20\x09-\x0d]+")


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def base(text):
    text = text or ""
    w = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    seen, covered = {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i:i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered), failed)


def histograms(text, lang):
    text, kinds = text or "", [0] * 6
    for c in text:
        kind = unicodedata.category(c)
        at = (1 if kind == "Lu" else 0 if kind[0] == "L" else 2 if kind[0] == "N" else 3 if c in " \t\n\x0b\f\r"
              else 4 if c in "#*$%&|<>" else 5)
        kinds[at] += 1
    w, common = words_of(text), Q.LANGUAGES.get(lang, ())
    counts = [w.count(x) for x in common]
    counts.append(len(w) - sum(counts))
    share = lambda v: [x / sum(v) if sum(v) else 0.0 for x in v]
    return share(kinds), share(counts)


def distance(p, q):
    part = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
    return math.sqrt(max(0.0, sum(part(a, (a + b) / 2) + part(b, (a + b) / 2) for a, b in zip(p, q)) / 2))


_PICK = random.Random(4)
PROSE = " ".join(_PICK.choice("the of and to in is was for with on cat dog house rain door mat hat sits runs. green A".split())
                 for _ in range(220))
DOCS = [
    (1, PROSE, "en"),
    (2, " ".join(f"WORD{i}!!! SHOUT{i}!!!" for i in range(120)), "en"),
    (3, " ".join(f"thing{i} | stuff{i}" for i in range(300)), "en"),
    (4, "a b c d e f g h i j a b c d e\n\nx y\nx y\n \nx y", "en"),
    (5, None, "en"), (6, "", None), (7, "\n \t", "xx"), (8, "eins zwei drei", "de"),
    (9, "one two three four five six seven eight nine ten", None),
    (None, "ha ha ha ha ha ha ha ha ha ha ha ha", "en"), (9, "ä\x0bö ü é\x85e " * 3, "fr"),
    (10, "word " * 30_000, "en"), (11, " ".join(f"w{i}" for i in range(20_000)) + " w5 w6 w7 w8 w9", "es"),
    (1, "dup dup", "en"), (1, "dup dup", "en"),
    *[(20 + i, " ".join(_PICK.sample(PROSE.split(), 150)), "en") for i in range(8)],
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, "x", 1, "t") for d in DOCS], SCHEMA).repartition(3)


def key(row):
    return tuple((x is not None, x) for x in row)


def test_against_plain_version(spark, docs):
    refs = Q.references(docs)
    want = []
    for doc_id, text, lang in DOCS:
        b = base(text)
        lang = lang if lang in Q.LANGUAGES else ""
        classes, common = histograms(text, lang)
        far = len(text or "") >= Q.GUARD_CHARS and distance(classes, refs[lang]["classes"]) > Q.MAX_CLASS_DISTANCE
        far |= bool(lang) and b[0] >= Q.GUARD_WORDS and distance(common, refs[lang]["common"]) > Q.MAX_WORD_DISTANCE
        want.append((doc_id, *b, not b[5] and not far))
    out = Q.document_rules(docs)
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
           for r in out.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert want[0][-1] and not want[1][-1] and not want[2][-1]


def test_references_are_means(spark, docs):
    refs = Q.references(docs)
    rows = [histograms(t, "en") for _, t, lang in DOCS if lang == "en" and len(t or "") >= Q.GUARD_CHARS]
    mean = [sum(x) / len(rows) for x in zip(*[r[0] for r in rows])]
    assert refs["en"]["classes"] == pytest.approx(mean, abs=2e-6)
    assert len(refs["en"]["common"]) == len(Q.LANGUAGES["en"]) + 1


def test_kept_documents_keep_their_columns(spark, docs):
    out = Q.kept_documents(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    kept = {r.doc_id for r in out.collect()}
    assert 1 in kept and not kept & {2, 3, 4, 5, 6, 7, 10}
    assert Q.kept_documents(docs.limit(0)).count() == 0


def test_native(docs):
    plan = Q.document_rules(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
