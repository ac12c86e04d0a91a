import re
from collections import Counter, defaultdict

import corpus_pipeline as pipe
import odd
import test_jaccard
import test_mixing
from pyspark.sql import functions as F
from quaywise.llm import quality, sentencepieces
from quaywise.llm.tables import table


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_near(rows):
    """Of each component of texts with a five-word Jaccard similarity of 0.8 or more, by all pairs, the row of the smallest id."""
    kept = set(test_jaccard.plain_near([r[:2] for r in rows]))
    return [r for r in rows if r[0] in kept]


def plain_passages(rows, window=20):
    seen, out = set(), []
    for i, text, source in sorted(rows):
        ws = words(text)
        gone = [False] * len(ws)
        for p in range(len(ws) - window + 1):
            key = tuple(ws[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        out.append((i, " ".join(w for w, g in zip(ws, gone, strict=True) if not g), source))
    return out


def plain_mix(rows):
    taken, _ = test_mixing.plain(rows)
    size = {i: (n, t) for i, n, _, _, t in taken}
    return [(i, text) for i, text, _ in rows for _ in range(size[i][1] // size[i][0] if size[i][0] else 0)]


def test_whole_run_matches_brute_force(spark):
    docs = table(spark, odd.DATA, "documents")
    got = pipe.run(spark, odd.DATA)
    assert got.columns == [*docs.columns, "token_ids", "n_tokens"]
    model = quality.train(docs, table(spark, odd.DATA, "labels"))
    good = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in good]
    near = plain_near(rows)
    assert len(near) < len(rows)
    want = plain_mix(plain_passages(near))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)
    back = sentencepieces.decoded(got)
    assert back.where("decoded <> text or n_tokens <> size(token_ids) or n_chars <> char_length(text)").count() == 0


def test_good_documents_stay(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    kept = {r.doc_id for r in pipe.keep_quality(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    by = defaultdict(list)
    for r in labels.collect():
        by[r.quality].append(r.doc_id in kept)
    assert sum(by[1]) / len(by[1]) > 0.97 and sum(by[0]) / len(by[0]) < 0.35


def test_odd_rows_pass_every_stage(spark):
    docs = odd.docs(spark)
    for name, stage in pipe.STAGES[1:]:
        out = stage(spark, docs, odd.DATA)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        rows = out.collect()
        if name.startswith("2 "):
            assert Counter(r.text for r in rows if r.doc_id == 5).total() == 2  # a clean text under an id that is there stays
            assert sum(r.text in (None, "", " \t\n") for r in rows) == 1
        docs = spark.createDataFrame(rows, out.schema)
    for _, stage in pipe.STAGES:
        assert stage(spark, odd.empty(spark), odd.DATA).count() == 0


def test_documents_are_repeated_as_the_mix_says(spark):
    rows = [(i, "w " * (i % 9), "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text"))
    got = Counter(r.doc_id for r in pipe.mix_sources(spark, df, "").collect())
    assert got == Counter(i for i, _ in plain_mix(rows))
