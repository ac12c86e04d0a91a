import hashlib
import random
from collections import Counter

import odd
import public_tokenizers
import pytest
import sentencepiece
from quaywise.llm import alignment, token_counts
from quaywise.llm.tables import table
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path(alignment.VOCABULARY))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.MODEL))


def spans(ids, bytes_of):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(bytes_of(i))))
        at += len(bytes_of(i))
    return out


def plain(rows, libraries):
    """Every token of A against every one of B, by their byte ranges."""
    a, b = libraries
    letters = token_counts.byte_of()
    bytes_a = lambda i: bytes(letters[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>"
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, count = [], Counter()
    for doc_id, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if b"".join(map(bytes_a, ids_a)) != raw or b"".join(map(bytes_b, ids_b)) != raw:
            ids_a = ids_b = []
        sa, sb = spans(ids_a, bytes_a), spans(ids_b, bytes_b)
        links, first = [], 0
        for i, s, e in sa:
            while first < len(sb) and sb[first][2] <= s:
                first += 1
            k = first
            while k < len(sb) and sb[k][1] < e:
                links.append((i, sb[k][0]))
                k += 1
        count.update(links)
        shared = {e for _, _, e in sa} & {e for _, _, e in sb}
        groups, ga, gb, j = [], [], [], 0
        for i, _, e in sa:
            ga.append(str(i))
            if e in shared:
                while sb[j][2] != e:
                    gb.append(str(sb[j][0]))
                    j += 1
                gb.append(str(sb[j][0]))
                j += 1
                groups.append(",".join(ga) + "|" + ",".join(gb))
                ga, gb = [], []
        docs.append((doc_id, len(ids_a), len(ids_b), groups, links))
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return [
        (d, na, nb, len(g), len(k), sum(count[x] == most[x[1]] for x in k), sum(count[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, na, nb, g, k in docs
    ]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("slice_pairs", [alignment.SLICE, 3000])
def test_query_matches_brute_force(spark, libraries, slice_pairs):
    docs = table(spark, odd.DATA, "documents").repartition(3)
    want = plain([(r.doc_id, r.text) for r in docs.collect()], libraries)
    out = alignment.aligned(docs, slice_pairs=slice_pairs)
    assert out.columns == "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert got(out) == sorted(want, key=repr)


def test_random_texts(spark, libraries, monkeypatch):
    rng = random.Random(8)
    parts = ["the", "ing", " ", "  ", "\n", "1999", "é", "漢字", "😀", "<s>", "<|endoftext|>", "<0x41>", ".", "'s", "\t", "▁", "\0", "Unbelievable", "   x"]
    rows = [(i, "".join(rng.choice(parts[: 15 if i % 5 else 19]) for _ in range(rng.randrange(0, 60)))) for i in range(200)]
    monkeypatch.setattr(alignment, "HELD", 40)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(alignment.aligned(df, slice_pairs=500)) == sorted(plain(rows, libraries), key=repr)


def test_windows_are_aligned_once():
    vocabulary, model = token_counts.read(), token_counts.read(alignment.MODEL)
    memo = alignment.Aligner(token_counts.bpe(vocabulary, False).bytes_of, alignment.pieces(model).bytes_of)
    text = "never gonna align " * 50
    ids = [token_counts.bpe(vocabulary, False).ids(" " + text)], alignment.pieces(model).ids([text])
    w = memo.windows(*ids)
    assert len(w.entries) >= 150 and len(memo.memo) <= 5


def test_long_texts_in_parts(libraries, monkeypatch):
    sp = alignment.Pieces(token_counts.read(alignment.MODEL))
    monkeypatch.setattr(alignment, "LONG", 50)
    rng = random.Random(2)
    for _ in range(50):
        t = "".join(rng.choice(["word", "other", " ", "   ", "\n", "é", "x" * 70]) for _ in range(rng.randrange(200)))
        assert sp.ids([t])[0].tolist() == libraries[1].encode(t)


def test_odd_rows(spark, libraries):
    rows = [r[:2] for r in odd.rows()]
    assert got(alignment.aligned(odd.docs(spark))) == sorted(plain(rows, libraries), key=repr)
    assert alignment.aligned(odd.empty(spark)).collect() == []
