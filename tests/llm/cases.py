"""Shared cases of the operators' tests."""

from __future__ import annotations

import random

from pyspark.sql import types as T

WORDS = "ba be bi bo bu da de di do du fa fe fi fo fu ga ge gi go gu ka ke ki ko ku".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed: int = 1, size: int = 40) -> list[tuple[int, str]]:
    """Texts with exact copies, near copies, shared passages and repeated words."""
    rng = random.Random(seed)
    shared = [sentence(rng, 45) for _ in range(3)]
    texts = [sentence(rng, rng.randint(1, 120)) for _ in range(size)]
    for k in range(size // 4):
        words = texts[k].split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
        texts.append(texts[k])
        texts.append(f"{sentence(rng, 9)}\n{rng.choice(shared)}\t{sentence(rng, 7)}")
    texts += ["la lu " * 400, "la lu " * 300 + "end", "one", "", " \n ", "Ünï " * 150, "Ünï " * 150 + "x", sentence(rng, 9000)]
    rng.shuffle(texts)
    return [(k * 3 + 1, t) for k, t in enumerate(texts)]


def with_edges(rows: list[tuple[int, str]]) -> list[tuple[int | None, str | None]]:
    """Also null ids, null texts and repeated rows."""
    return [*rows, (None, None), (None, rows[0][1]), (None, rows[0][1]), (5000, None), (5001, None), rows[3], rows[3]]


def frame(spark, rows, extra: str = ""):
    """Documents as a frame; ``extra`` names further text columns."""
    names = extra.split()
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    fields += [T.StructField(n, T.StringType()) for n in names]
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], T.StructType(fields)).repartition(3)
