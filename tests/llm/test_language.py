"""Language ID against a plain kernel ridge regression, and its bounds."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from ledgerspark.llm import language

from .llm_cases import EDGES, prose

LETTERS = {"aa": "aeioulmn", "bb": "äöüßktzw", "cc": "xyzqvaei"}


def labelled(n, words=40):
    return [(k, prose(k, words, LETTERS[c]), c) for k in range(n) for c in [list(LETTERS)[k % 3]]]


def plain_scores(learned, marks, texts, orders, ridge):
    """Kernel matrices pair by pair, features by the inverse root, and one weighted ridge regression for each language."""
    seen = np.zeros(1 << language.HASH_BITS, bool)
    sets = lambda many: [set(language.grams(t, orders, seen).tolist()) for t in many]

    def kernel(left, right):
        return np.array([[len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b))) for b in right] for a in left])

    own = sets(marks)
    values, vectors = np.linalg.eigh(kernel(own, own))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    features = kernel(sets([t for t, _ in learned]), own) @ root
    langs = sorted({c for _, c in learned})
    weight = np.array([len(learned) / len(langs) / sum(x == c for _, x in learned) for _, c in learned])
    out = []
    for lang in langs:
        target = np.array([1.0 if c == lang else -1.0 for _, c in learned])
        a = (features * weight[:, None]).T @ features + ridge * np.eye(len(own))
        out.append(kernel(sets(texts), own) @ root @ np.linalg.solve(a, (features * weight[:, None]).T @ target))
    return langs, np.array(out).T


def test_scores_are_those_of_a_plain_version(docs):
    rows = labelled(60)
    frame = docs(*rows)
    sample = language.training_sample(frame, 300, 3)
    model = language.fit(sample, 5, 0.1, 3)
    ids = {r.doc_id for r in sample.collect()}
    learned = [(t, c) for k, t, c in rows if k in ids]
    assert ids == {r.doc_id for r in frame.where(language.in_training(F.col("doc_id"))).collect()}
    hashed = frame.withColumn("h", F.xxhash64("doc_id", F.xxhash64("text"))).where(F.col("doc_id").isin(list(ids))).orderBy("h").collect()
    marks = [r.text for c in sorted(LETTERS) for r in [x for x in hashed if x.lang == c][:5]]
    texts = [t for _, t in EDGES if t] + [t for _, t, _ in rows]
    langs, want = plain_scores(learned, marks, texts, 3, 0.1)
    got = language.scores(model, texts, np.zeros(1 << language.HASH_BITS, bool))
    assert model.classes == langs and np.abs(got - want).max() < 1e-4


def test_weights_that_are_not_folded_score_alike(docs, monkeypatch):
    sample = language.training_sample(docs(*labelled(40)), 300, 3)
    folded = language.fit(sample, 5, 0.1, 3)
    monkeypatch.setattr(language, "FOLD_BYTES", 0)
    plain = language.fit(sample, 5, 0.1, 3)
    texts = [t for _, t, _ in labelled(10)]
    seen = np.zeros(1 << language.HASH_BITS, bool)
    assert plain.mix is not None and np.abs(language.scores(folded, texts, seen) - language.scores(plain, texts, seen)).max() < 1e-4


def test_one_id_with_many_texts_does_not_grow_the_sample(docs):
    one, two = [k for k in range(20) if zlib.crc32(str(k).encode()) % 3 != 1][:2]
    rows = [(one, prose(k, 10), "aa") for k in range(3000)] + [(two, "same text again", "bb")] * 1000
    counts = {r["lang"]: r["count"] for r in language.training_sample(docs(*rows, extra=False), 300, 2).groupBy("lang").count().collect()}
    assert counts == {"aa": 300, "bb": 1}


def test_every_language_is_learned(docs):
    own = [f"{chr(0x4E00 + 40 * c)}{chr(0x4E01 + 40 * c)}{chr(0x4E02 + 40 * c)} " * 20 for c in range(520)]
    rows = [(3000 + 10 * c + k, own[c], f"l{c}") for c in range(520) for k in range(4)]
    got = language.identify(docs(*rows, extra=False)).collect()
    names = {3000 + 10 * c + k: f"l{c}" for c in range(520) for k in range(4)}
    learned = {r.doc_id // 10 for r in got if not r.held_out}
    right = sum(r.lang_pred == names[r.doc_id] for r in got if r.doc_id // 10 in learned)
    assert len({r.lang_pred for r in got}) > 500 and right > 0.95 * len(got)


def test_a_learned_model_meets_every_kind_of_row(docs):
    rows = labelled(60) + EDGES + [(None, prose(3, 40, LETTERS["aa"])), (7000, prose(9, 100_000, LETTERS["bb"])), (7001, "äöü"), (7001, "äöü")]
    frame = docs(*rows).selectExpr("*", "'x' AS letter", "'x' AS _letter", "'x' AS SCORE_", "'x' AS Lang_Pred_")
    got = language.identify(frame, 40, 10).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r, (doc_id, text, *_) in zip(sorted(got, key=lambda r: repr(r.doc_id)), sorted(rows, key=lambda r: repr(r[0])), strict=True):
        by_text.setdefault(doc_id, []).append(r)
    assert [r.lang_pred for r in by_text[7000]] == ["bb"] and len({tuple(r) for r in by_text[7001]}) == 1
    assert {r.held_out for r in by_text[None]} == {False} and {r.lang_pred for r in by_text[1] + by_text[2]} <= {"und", *LETTERS}
    kept = language.predict(frame, language.train(frame, 40, 10))
    assert kept.columns == [*[c for c in frame.columns if c not in ("lang_pred", "score")], "lang_pred", "score"] and {r._letter for r in kept.collect()} == {"x"}
