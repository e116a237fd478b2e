"""The pipeline's result against a plain run of its five stages."""

import hashlib
import struct
from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken
from test_near_dedup import kept_by_row
from test_quality_rules import base, distance, histograms
from test_quality_trees import walk

import corpus_pipeline
from jobsieve.llm import byte_bpe, decontamination, near_dedup, quality_rules, quality_trees

SF = "/root/testdata/sf0.001"


def passes_rules(refs, text, lang):
    b = base(text)
    lang = lang if lang in quality_rules.LANGUAGES else ""
    classes, common = histograms(text, lang)
    far = (len(text or "") >= quality_rules.GUARD_CHARS
           and distance(classes, refs[lang]["classes"]) > quality_rules.MAX_CLASS_DISTANCE)
    far |= (bool(lang) and b[0] >= quality_rules.GUARD_WORDS
            and distance(common, refs[lang]["common"]) > quality_rules.MAX_WORD_DISTANCE)
    return not b[5] and not far


def holds_item(text, items):
    doc = decontamination.tokens(text)
    for item in items:
        at = {}
        for i, k in enumerate(doc.words if item.literal else doc.kinds):
            at.setdefault(k, []).append(i)
        own = item.words if item.literal else item.kinds
        agree = Counter(i - j for j, k in enumerate(own) for i in at.get(k, ()))
        least = len(own) if item.literal else decontamination.least_run(len(own))
        if decontamination.evidence(doc, item, [s for s, n in agree.items() if n >= least]):
            return True
    return False


def test_run_against_plain_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = docs.where("doc_id < 40").selectExpr("doc_id + 5000 as doc_id", "concat(text, ' more') as text", "lang", "source", "n_chars")
    same_id = docs.where("doc_id between 40 and 60").selectExpr("doc_id + 60 as doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(7000, None, None, "x", 0), (7001, "", "en", None, 0), (None, "word " * 50_000, "en", "x", 5)], docs.schema)
    sf = str(tmp_path)
    docs.union(copies).union(same_id).union(odd).repartition(3).write.parquet(f"{sf}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{sf}/{name}.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]

    refs = quality_rules.references(docs)
    rows = [r for r in rows if passes_rules(refs, r[1], r[2])]
    first = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = quality_trees.train(first, labels)
    features = quality_trees.features([r[1] for r in rows]).astype(np.float32).astype(float)
    rows = [r for r, x in zip(rows, features) if walk(model, x) >= quality_trees.PREDICT_AT]
    kept = set(kept_by_row([r[:2] for r in rows], near_dedup.SHINGLE))
    assert len(kept) < len(rows)
    items = [decontamination.tokens(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = [r for r in rows if r[:2] in kept and not holds_item(r[1], items)]
    assert 50 < len(clean) < len(kept)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={},
                                mergeable_ranks=byte_bpe.vocabulary(byte_bpe.VOCABULARY).ranks)
    want = []
    for doc_id, text, lang, source in clean:
        ids = library.encode_ordinary(text)
        want.append((doc_id, lang, source, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    out = corpus_pipeline.run(spark, sf)
    got = [(r.doc_id, r.lang, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
