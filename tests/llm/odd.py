"""Documents with the cases that every operator has to bear, and small helpers."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, size long, block long"
DATA = "/root/testdata/sf0.001"


def words(seed: int, n: int, of: int = 400) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(2 + i % 5)) + str(i) for i in (rng.randrange(of) for _ in range(n))]


def rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties and repeated rows, one-word texts; extra columns whose names clash."""
    long = " ".join(words(1, 20_000))
    base = " ".join(words(2, 120))
    texts = [None, "", " \t\n", "one", "Zwei Wörter", base, base, base + " tail", base.upper(), long, "1234 !!! 5678", "a b ▁ c d \U0001f600", "x " * 300]
    out = [(i, t, ["en", "de", None][i % 3], ["a", None, "b"][i % 3], None if t is None else len(t), 0.5, "x", 7, 3) for i, t in enumerate(texts)]
    out.append(out[5])
    out.append((None, base, None, None, None, None, None, None, None))
    out.append((None, None, None, None, None, None, None, None, None))
    out.append((5, "another text under an id that is there", "en", "a", 38, 0.1, "x", 7, 3))
    return out


def docs(spark, some: list[tuple] | None = None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
