import random

import odd
import pytest
import sentencepiece
from pyspark.sql import functions as F
from quaywise.llm import sentencepieces as sp
from quaywise.llm.tables import table


@pytest.fixture(scope="module")
def model():
    return sp.load()


@pytest.fixture(scope="module")
def library():
    """The library with the same pieces and scores as a unigram model."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(sp.MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def plain_viterbi(text, model):
    """Best sum of scores by trying all pieces at all positions."""
    score = {p: s for p, _, s in model.pieces}
    worst = min(score.values()) - sp.PENALTY
    best = [0.0]
    for end in range(1, len(text) + 1):
        options = [best[end - n] + score[text[end - n : end]] for n in range(1, min(end, 20) + 1) if text[end - n : end] in score]
        if text[end - 1] not in score:
            options.append(best[end - 1] + worst)
        best.append(max(options))
    return best[-1]


def test_equals_the_library_and_the_best_score(spark, model, library):
    codec, score = sp.Codec(model), {i: s for _, i, s in model.pieces}
    lines = [line for r in table(spark, odd.DATA, "documents").limit(40).collect() for line in r.text.split("\n") if line]
    texts = [" ".join(t.split(" ")[:60]) for t in lines[:200]] + ["a", " hyphen-ated", "ümlaut", "x" * 50]
    for t in texts:
        ids = codec.encode(t)
        assert codec.decode(ids) == t
        if all(i in score for i in ids.tolist()):
            assert sum(score[i] for i in ids.tolist()) == plain_viterbi("▁" + t.replace(" ", "▁"), model)
    words = sorted({w for t in texts for w in t.split(" ") if w})[:600]
    for w in words:  # the library's lattice; its one-best shortcut misses the best path of some words
        ids, theirs = codec.encode(w).tolist(), library.nbest_encode_as_ids(w, 2)[0]
        if all(i in score for i in ids):
            assert ids == theirs or sum(map(score.get, ids)) == sum(map(score.get, theirs)), w
    for word in ["▁international", "▁thingoued", "▁▁▁x", "▁漢a"]:
        ids = codec.viterbi(word)
        if all(i in score for i in ids):
            assert sum(score[i] for i in ids) == plain_viterbi(word, model)


def test_round_trip_of_any_text(model):
    rng, codec = random.Random(4), sp.Codec(model)
    for _ in range(300):
        t = "".join(rng.choice("ab the \n\t▁é漢😀\0<s>0x41") for _ in range(rng.randrange(0, 40)))
        assert codec.decode(codec.encode(t)) == t


def test_words_are_forgotten_without_a_change(model, monkeypatch):
    t = " ".join(odd.words(6, 300))
    want = sp.Codec(model).encode(t).tolist()
    monkeypatch.setattr(sp, "HELD_WORDS", 3)
    assert sp.Codec(model).encode(t).tolist() == want


def test_odd_rows(spark, model):
    got = sp.round_trips(odd.docs(spark), model).collect()
    assert len(got) == len(odd.rows()) and all(r.same for r in got)
    assert sp.round_trips(odd.empty(spark), model).collect() == []
    rows = sp.decoded(sp.encoded(odd.docs(spark), model), model)
    assert rows.where(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0
    assert rows.where("coalesce(text, '') = '' and size(token_ids) <> 0").count() == 0
