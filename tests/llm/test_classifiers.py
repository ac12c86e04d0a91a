import zlib
from collections import Counter

import numpy as np
import odd
import pytest
from quaywise.llm import langid, quality, toxicity
from quaywise.llm.tables import table

DATA = "/root/testdata/sf0.01"


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.mark.parametrize(("kind", "target", "n", "out"), [(toxicity, "toxic", 5, 0), (quality, "quality", 3, 1)])
def test_held_out_accuracy(spark, kind, target, n, out):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    got = {r.doc_id: r for r in kind.score(docs, kind.train(docs, labels)).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r[target] for r in labels.collect() if r[target] is not None}
    assert all(r.held_out == (fold(i, n) == out) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[i].predicted, y) for i, y in truth.items() if i in got and got[i].held_out]
    assert np.mean([p == y for p, y in held]) > max(0.93, 1 - np.mean([y for _, y in held]))


@pytest.mark.parametrize(("kind", "target"), [(toxicity, "toxic"), (quality, "quality")])
def test_only_training_labels_count(spark, kind, target):
    docs = table(spark, DATA, "documents").limit(300)
    labels = table(spark, DATA, "labels")
    model = kind.train(docs, labels)
    n, out = (5, 0) if target == "toxic" else (3, 1)
    changed = spark.createDataFrame([(r.doc_id, 1 - r[target] if fold(r.doc_id, n) == out else r[target]) for r in labels.collect()], f"doc_id long, {target} int")
    again = kind.train(docs, changed)
    assert np.array_equal(model[0], again[0]) and model[1] == again[1]


@pytest.mark.parametrize(("kind", "target"), [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows(spark, kind, target):
    docs = odd.docs(spark)
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(12)] + [(None, 1, "x"), (3, 0, "y"), (4, None, "y")], f"doc_id long, {target} int, text string")
    model = kind.train(docs, labels)
    got = kind.score(docs, model).collect()
    assert len(got) == len(odd.rows()) and all(0 <= r.score <= 1 for r in got)
    none = [r.score for r, row in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(odd.rows(), key=lambda r: (r[0] is None, r[0])), strict=True) if row[1] in (None, "")]
    assert len(set(none)) == 1
    assert kind.score(odd.empty(spark), model).collect() == []
    for nothing in (kind.train(docs, labels.where("1 = 0")), kind.train(odd.empty(spark), labels)):
        assert {r.score for r in kind.score(docs, nothing).collect()} == {0.5}


def test_toxicity_features_of_a_text_do_not_depend_on_its_batch():
    p = toxicity.ToxicityParams()
    keep = np.ones(1 << p.bits, bool)
    texts = ["idiot", "", "Ab", "a longer text, with words", "x"]
    alone = [next(toxicity._features([t], p, None))[1:] for t in texts]
    for k in (keep, None):
        for (f, x), (_, g, y) in zip(alone, toxicity._features(texts, p, k), strict=True):
            assert np.array_equal(f, g) and np.allclose(x, y)


def test_toxicity_strength_is_a_frequency():
    p = toxicity.ToxicityParams(orders=(3,))
    once, often, long = (next(toxicity._features([t], p, None))[2].max() for t in ("abc def", "abc abc abc", "abc" + " def" * 1000))
    assert once == 1 and often == 2 and 0 < long < 10


def test_quality_scores_do_not_depend_on_the_batch():
    p = quality.QualityParams()
    line = np.random.default_rng(1).normal(size=1 << p.bits).astype(np.float32)
    texts = ["one two two", "", "Ä ö", " ".join(odd.words(4, 300)), "z"]
    assert np.allclose(quality.scores(texts, line, 0.1, p), [quality.scores([t], line, 0.1, p)[0] for t in texts])


def plain_rank(text, known, ranks=400):
    letters = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not letters:
        return "und", 0.0
    s = " " + " ".join(letters) + " "
    counts = Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1))
    del counts[" "]
    number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    mine = sorted(map(number, counts), key=lambda g: g)
    by = {number(g): c for g, c in counts.items()}
    mine = sorted(mine, key=lambda g: (-by[g], g))[:ranks]
    apart = {x: sum(abs(known[x].index(g) - r) if g in known[x] else ranks for r, g in enumerate(mine)) for x in sorted(known)}
    best = min(apart, key=lambda x: (apart[x], x))
    return best, 1 - apart[best] / (ranks * len(mine))


def test_language_matches_brute_force_and_held_out_labels(spark):
    docs = table(spark, odd.DATA, "documents")
    known = langid.profiles(docs)
    assert sorted(known) == ["de", "en", "es", "fr"]
    got = {r.doc_id: r for r in langid.predict(docs, known).collect()}
    rows = docs.collect()
    for r in rows[:40]:
        lang, score = plain_rank(r.text, known)
        assert (got[r.doc_id].lang_pred, round(got[r.doc_id].score, 9)) == (lang, round(score, 9))
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in rows if fold(r.doc_id, 5) == 0]) > 0.9


def test_profiles_are_counts_over_all_training_documents(spark):
    rows = [(i, t, "en" if i % 2 else "de", None, None, None, None, None, None) for i, t in enumerate(["The cat sat.", "Der Hund, der bellt", "a 1 b", "ö", None, ""] * 3)]
    known = langid.profiles(odd.docs(spark, rows), langid.LanguageParams(ranks=50, held=5))
    for lang in ("en", "de"):
        counts = Counter()
        for i, t, x, *_ in rows:
            if x == lang and t and fold(i, 5):
                counts.update(langid.grams([t], (1, 2, 3)).tolist())
        assert known[lang] == sorted(counts, key=lambda g: (-counts[g], g))[:50]


def test_language_of_odd_rows(spark):
    known = langid.profiles(odd.docs(spark))
    got = langid.predict(odd.docs(spark), known).collect()
    assert len(got) == len(odd.rows())
    text = {r[0]: r[1] for r in odd.rows() if r[0] != 5}
    for r in got:
        if r.doc_id in text and r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or ""))
    assert langid.predict(odd.empty(spark), known).collect() == []
    assert {r.lang_pred for r in langid.predict(odd.docs(spark), langid.profiles(odd.empty(spark))).collect()} == {"und"}
