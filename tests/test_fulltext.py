import math
import random
import re

import pytest
from pyspark.sql import functions as F
from quaywise.operators import fulltext as ft

DOCS = [
    (1, "Les offres fibre de Tunis sont disponibles. L'offre fibre optique coûte 45 dinars."),
    (2, "Le stock de modems est en rupture à Sfax"),
    (3, "Rupture de stock : commander les modems, puis relancer la fibre"),
    (4, "fibre fibre fibre"),
    (5, ""),
    (6, None),
    (7, "La procédure de commande des chevaux vapeur"),
    (8, "fibre et encore beaucoup de mots avant que le stock ne vienne, stock de fibre"),
]


def found(spark, text, docs=DOCS):
    index = ft.postings(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = ft.search(index, spark.createDataFrame([(0, text)], "query_id long, query_text string")).collect()
    return {r.doc_id: round(r.score, 6) for r in rows}


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("fibre", {1, 3, 4, 8}),
        ("stock rupture", {2, 3}),
        ('"rupture de stock"', {3}),
        ('"stock rupture"', set()),
        ('"rupture stock"', set()),  # a function word between keeps its place
        ("modems -sfax", {3}),
        ('modems -"rupture de stock"', {2}),
        ("tunis or sfax", {1, 2}),
        ("offre fibre OR stock modem", {1, 2, 3}),
        ("offres fibres", {1}),
        ("l'offre", {1}),
        ("cheval", {7}),
        ("commander", {3, 7}),
        ("de la", set()),
        ("", set()),
        ("-fibre", set()),
        ("or or", set()),
        ("FIBRE   Optique", {1}),
        ('"fibre', {1, 3, 4, 8}),
        ("absent or fibre optique", {1}),
        ("absent fibre", set()),
    ],
)
def test_what_is_found(spark, text, ids):
    assert set(found(spark, text)) == ids


def test_ranks_by_cover_density(spark):
    assert found(spark, "fibre") == {4: 0.3, 1: 0.2, 8: 0.2, 3: 0.1}
    # rupture 1, stock 3 (a function word between them)
    assert found(spark, "rupture stock")[3] == round(0.1 / 2, 6)
    # stock 2, modems 4, rupture 7
    assert found(spark, "stock modems rupture")[2] == round(0.1 / (1 + 5 - 2), 6)
    # fibre 1 ... stock 10, stock 13, fibre 15: the covers are 1-10 and 13-15
    assert found(spark, "fibre stock")[8] == round(0.1 / (1 + 9 - 1) + 0.1 / (1 + 2 - 1), 6)
    assert found(spark, "fibre or stock")[8] == 0.4


def plain_stem(w):
    if len(w) < 5:
        return w
    if w.endswith("x"):
        return w[:-3] + "al" if w.endswith("aux") else w[:-1]
    w = next(w[:k] for k in range(4, len(w) + 1) if re.fullmatch("é?e?r?s?", w[k:]))
    return w[:-1] if w[-1] == w[-2] else w


def test_stems(spark):
    words = "fibre fibres terres chevaux généraux heureux vendeurs vendre vendue vendues arrivées prévisions commander commande ville villes abonnement appelle réseau prix été".split()
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", ft.stemmed(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == {w: plain_stem(w) for w in words}


def plain(docs, query):
    """The rules anew: every stretch of a document is tried as a cover."""
    terms = lambda t: [(plain_stem(w), i) for i, w in enumerate(re.findall(r"\w+", t.lower()), 1) if w not in ft.STOP_WORDS]
    clauses = [[]]
    for item in re.findall(r'-?"[^"]*"|[^\s"]+', query.lower()):
        if item == "or":
            clauses.append([])
        elif t := terms(item):
            clauses[-1].append((item.startswith("-"), [(w, i - t[-1][1]) for w, i in t]))
    out = {}
    for doc_id, text in docs:
        at = {}
        for w, i in terms(text or ""):
            at.setdefault(w, set()).add(i)
        for clause in clauses:
            ends = lambda words: {i for i in at.get(words[-1][0], ()) if all(i + k in at.get(w, ()) for w, k in words)}
            if any(ends(words) for neg, words in clause if neg):
                continue
            items = [ends(words) for neg, words in clause if not neg]
            if not items or not all(items):
                continue
            seen = sorted((p, k) for k, places in enumerate(items) for p in places)
            covers = []
            for i in range(len(seen)):
                for j in range(i, len(seen)):
                    if {k for _, k in seen[i : j + 1]} == set(range(len(items))):
                        covers.append((i, j))
                        break
            covers = [(i, j) for i, j in covers if not any((x, y) != (i, j) and i <= x and y <= j for x, y in covers)]
            for i, j in covers:
                noise = seen[j][0] - seen[i][0] - (j - i)
                out[doc_id] = out.get(doc_id, 0) + 0.1 / (1 + (noise if noise >= 0 else math.floor((j - i) / 2)))
    return {k: round(v, 6) for k, v in out.items()}


def test_random_queries_match_plain_rules(spark):
    rng = random.Random(5)
    words = ["stock", "vente", "ventes", "fibre", "le", "de", "modem", "offre", "client"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))) for i in range(30)]
    queries = []
    for k in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            w = rng.choice([rng.choice(words), f'"{rng.choice(words)} {rng.choice(words)}"', "or", f'"{rng.choice(words)} de {rng.choice(words)}"'])
            parts.append(("-" if rng.random() < 0.15 and w != "or" else "") + w)
        queries.append((k, " ".join(parts)))
    index = ft.postings(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    got = {}
    for r in ft.matches(index, spark.createDataFrame(queries, "query_id long, query_text string")).collect():
        got.setdefault(r.query_id, {})[r.doc_id] = round(r.score, 6)
    for k, q in queries:
        assert got.get(k, {}) == plain(docs, q), q


def test_a_stored_index_gives_the_same(spark, tmp_path):
    index = ft.postings(spark.createDataFrame(DOCS, "doc_id long, text string"))
    ft.saved(index, str(tmp_path / "words"), buckets=4)
    queries = spark.createDataFrame([(0, "stock modems or tunis"), (1, "fibre")], "query_id long, query_text string")
    again = ft.search(spark.read.parquet(str(tmp_path / "words")), queries)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, ft.search(index, queries).collect()))
    assert ft.search(index.where("1 = 0"), queries).collect() == []


def test_searched_index_holds_the_words_of_queries_only(spark):
    docs = spark.createDataFrame([(1, "rouge vert bleu"), (2, "rouge jaune rouge"), (3, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(7, 'rouge -"vert bleu"')], "query_id long, query_text string")
    index = ft.postings(docs, queries)
    assert sorted((r.term, r.doc_id, r.places) for r in index.collect()) == sorted((r.term, r.doc_id, r.places) for r in ft.postings(docs).where("term <> 'jaune' and term <> 'jaun'").collect())
    assert [(r.query_id, r.doc_id) for r in ft.search(index, queries).collect()] == [(7, 2)]
