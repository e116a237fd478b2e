"""Windows and chunks against plain loops, gradients against differences, scores against a plain run of network and memory."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from jobsieve.llm import pseudo_likelihood as L

LONG = "the cat sat on the mat and saw a small bird fly over old stone walls " * 400
DOCS = [(1, "Hello, world! É 12"), (2, None), (3, ""), (4, "a"), (None, "ab cd"), (5, LONG), (6, "\x00\x01 日本の猫 x"), (7, " \n\t"),
        (1, "Hello, world! É 12"), (8, "Hello, world! É 12"), (9, "other " * 30)]


def split(text):
    """Words of a text as bytes: runs without white space, cut around characters of scripts without spaces."""
    runs = re.findall(r"[ࠀ-\u1fff\u3000-\U0010ffff]|[^ \t\n\v\f\rࠀ-\u1fff\u3000-\U0010ffff]+", text or "")
    return [r.encode() for r in runs]


def digest(values):
    multiplier, h = int(L.MULTIPLIER), sum((v + 1) * pow(int(L.MULTIPLIER), k + 1, 2**64) for k, v in enumerate(values)) % 2**64
    h = (h ^ h >> 29) * multiplier % 2**64
    return h ^ h >> 32


def hashes(text):
    return [digest(w) for w in split(text)]


def plain_windows(text):
    t = [h // 2**20 % L.INPUTS for h in hashes(text)]
    at = lambda i: t[i] if 0 <= i < len(t) else L.EDGE
    return [(t[i] % L.TOKENS, *(at(i + k) for k in L.PLACES)) for i in range(len(t))]


def plain_chunks(text):
    """(first, chunk as words) of every chunk."""
    out, start, own = [], 0, hashes(text)
    for i, h in enumerate(own):
        if h % L.SPAN == 0 or i == len(own) - 1:
            out.append((start, tuple(own[start:i + 1])))
            start = i + 1
    return out


def plain_network(model, text):
    """Log-probability of every word, one at a time, over all tokens."""
    embed, scale, bias, classes, class_bias, inner, inner_bias = (p.astype(np.float64) for p in model.params)
    out = []
    for token, *around in plain_windows(text):
        hidden = np.tanh(sum(embed[a] * s for a, s in zip(around, scale)) + bias)
        outer = hidden @ classes + class_bias
        c, j = divmod(token, L.CLASSES)
        own = hidden @ inner[c] + inner_bias[c]
        out.append(outer[c] - math.log(np.exp(outer).sum()) + own[j] - math.log(np.exp(own).sum()))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, "x", 1) for d in DOCS], "doc_id long, text string, chunk string, row int").repartition(3)


def test_words():
    for text in ("a  b\nc", "日本 ok猫x’y", "猫", " ", "é\xa0ü \x0b\x00", "😀a😀 ", "ก b"):
        raw = text.encode()
        first, found = L.words(np.frombuffer(raw, np.uint8))
        assert found.tolist() == hashes(text) and all(raw[a:].startswith(w) for a, w in zip(first, split(text), strict=True))


@pytest.mark.parametrize("size", [1, 40, 1 << 22])
def test_windows_and_chunks(monkeypatch, size):
    monkeypatch.setattr(L, "BYTES", size)
    texts, seen, ids = [t for _, t in DOCS], [], {}
    for rows, first, own in L.batch_words(texts):
        tokens, around = L.windows(own, first)
        begin, value = L.chunks(own, first)
        ends = [*first[1:], len(own)]
        for r, a, b in zip(rows, first, ends):
            assert [(t, *x) for t, x in zip(tokens[a:b].tolist(), around[a:b].tolist())] == plain_windows(texts[r])
            inside = (begin >= a) & (begin < b)
            want = plain_chunks(texts[r])
            assert (begin[inside] - a).tolist() == [s for s, _ in want]
            for v, (_, chunk) in zip(value[inside].tolist(), want):
                assert ids.setdefault(chunk, v) == v
        seen += rows.tolist()
    assert seen == [i for i, t in enumerate(texts) if split(t)] and len(set(ids.values())) == len(ids)


def test_gradients():
    model, rng = L.Network(), np.random.default_rng(3)
    model.params = [p.astype(np.float64) for p in model.params]
    tokens, around = rng.integers(0, L.TOKENS, 30), rng.integers(0, L.INPUTS + 1, (30, len(L.PLACES)))
    grads, c = model.gradients(tokens, around), tokens[0] // L.CLASSES
    loss = lambda: -model.log_probabilities(tokens, around).mean()
    for k, at in ((0, (around[0, 0], 3)), (0, (around[4, 3], 9)), (1, (2, 5)), (2, (4,)), (3, (2, 7)), (4, (c,)),
                  (5, (c, 3, tokens[0] % L.CLASSES)), (6, (c, 1))):
        kept = model.params[k][at]
        model.params[k][at] = kept + 1e-5
        up = loss()
        model.params[k][at] = kept - 1e-5
        slope = (up - loss()) / 2e-5
        model.params[k][at] = kept
        assert grads[k][at] == pytest.approx(slope, abs=1e-6)


def test_scores(docs):
    model = L.train(docs)
    assert not np.array_equal(model.params[0], L.Network().params[0])
    places = Counter(chunk for _, t in DOCS for _, chunk in plain_chunks(t))
    want = []
    for doc, text in DOCS:
        logp, total = plain_network(model, text), 0.0
        by = {}
        for start, chunk in plain_chunks(text):
            by.setdefault(chunk, []).append(sum(logp[start:start + len(chunk)]))
        for chunk, parts in by.items():
            n, p = places[chunk] - 1, sum(parts) / len(parts)
            total += len(parts) * (math.log(n / (n + L.PRIOR) + L.PRIOR / (n + L.PRIOR) * math.exp(p)) if n else p)
        want.append((str(doc), len(logp), sum(logp), total))
    rows = L.scores(docs, model).collect()
    got = sorted((str(r.doc_id), r.n_tokens, r.network_log_likelihood, r.log_likelihood) for r in rows)
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], rel=1e-4, abs=1e-4)


def test_result(docs):
    rows = L.document_scores(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(DOCS) and all(by[k].mean_log_likelihood is None and by[k].log_likelihood == 0 for k in (2, 3, 7))
    # Found three times, against once.
    assert by[8].mean_log_likelihood > by[6].mean_log_likelihood


def test_learns_from_both_sides():
    # The middle of "a ? b" is always "c", of "d ? b" always "e", of "a ? f" always "g".
    own = np.array(hashes("a c b d e b a g f " * 200), np.uint64)
    tokens, around = L.windows(own, np.array([0]))
    trainer = L.Trainer(L.Network())
    for _ in range(150):
        trainer.add(tokens, around)
        trainer.finish()
    assert trainer.model.log_probabilities(tokens, around).mean() > np.log(0.5)


def test_empty_table(docs):
    assert L.document_scores(docs.limit(0)).count() == 0
