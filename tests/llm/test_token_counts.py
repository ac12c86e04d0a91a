import random

import odd
import public_tokenizers
import pytest
from quaywise.llm import token_counts as tc
from quaywise.llm.tables import table
from tokenizers import Tokenizer

PARTS = ["a", "b", "the", " ", "  ", "\n", "'s", "'", "1", "22", "é", "漢", "😀", "<|endoftext|>", "<|endof", "text|>", ".", "!!", "　", "\x1c", "ll", "'ll", "\0"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(tc.VOCABULARY))


@pytest.fixture(scope="module")
def data():
    return tc.read()


@pytest.mark.parametrize(("chunk", "overlap"), [(7, 3), (16, 8), (40, 10), (100, 100)])
def test_spliced_ids_are_those_of_the_library(library, data, chunk, overlap):
    rng, codec = random.Random(chunk), tc.ByteBpe(data, True, chunk, overlap)
    for _ in range(600):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 120)))
        assert codec.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert codec.chunks > 600


def test_special_strings_as_plain_text(library, data):
    library.encode_special_tokens = True
    codec = tc.ByteBpe(data, False, 30, 10)
    for t in ("<|endoftext|>" * 20, "a <|endoftext|> b " * 9):
        assert codec.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids and 50256 not in codec.ids(t)
    library.encode_special_tokens = False


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 300_000, "ab " * 100_000, "漢" * 60_000, "x" * 40_000 + " y z" * 20_000, "'" * 50_000], ids=lambda t: t[:4])
def test_long_texts_and_wide_overlaps(library, data, text):
    codec = tc.ByteBpe(data)
    assert codec.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert codec.chunks > 2 and (codec.widened > 0) == (text[0] != "a" or text[1] == "a")


def test_both_engines_agree_on_every_code_point(library, data):
    codec = tc.ByteBpe(data)
    for at in range(0, 0x30000, 64):
        some = [chr(c) for c in range(at, at + 64) if not 0xD800 <= c < 0xE000]
        t = "".join(f"a{c}a 1{c}1 {c} {c}{c}b  {c}'s.{c}. " for c in some)
        assert codec.whole(t).tolist() == library.encode(t, add_special_tokens=False).ids, hex(at)


def test_query_counts_as_the_library(spark, library):
    docs = table(spark, odd.DATA, "documents")
    want = sorted((r.doc_id, len(r.text.encode()), (n := len(library.encode(r.text, add_special_tokens=False).ids)), n > 1024) for r in docs.collect())
    for how in ({}, {"chunk": 300, "overlap": 40}):
        assert sorted(tuple(r)[:4] for r in tc.token_counts(docs, **how).collect()) == want


def test_odd_rows(spark, library):
    got = tc.token_counts(odd.docs(spark), chunk=1000, overlap=50).collect()
    want = [(r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in odd.rows()]
    assert sorted((tuple(r)[:3] for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert tc.token_counts(odd.empty(spark)).collect() == []
    out = tc.counted(odd.docs(spark).withColumnRenamed("label", "a.b"), name="n")
    assert out.columns[-1] == "n" and out.count() == len(odd.rows())


def test_other_files_are_refused(data):
    with pytest.raises(ValueError):
        tc.ByteBpe(data.replace(b'"add_prefix_space":false', b'"add_prefix_space":true', 1).replace(b'"add_prefix_space": false', b'"add_prefix_space": true', 1))
