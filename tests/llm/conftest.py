import random

import pytest

ODD = [
    (1, "Plain words of a plain text, nothing else."),
    (2, None),
    (3, ""),
    (None, "A text without id, under the MIT License."),
    (5, "Plain words of a plain text, nothing else."),
    (5, "Plain words of a plain text, nothing else."),
    (6, "   \t\n  "),
    (7, "Ünï—cödé ñ 日本語 K x;   Σ"),
    (8, "word " * 30_000),
    (-9, "x"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(d, t, "en", 1, None, [1], "z") for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n int, spans string, items array<int>, set_id string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


def prose(n, seed, vocabulary=300):
    rng = random.Random(seed)
    words = [f"w{k}x" for k in range(vocabulary)]
    return [rng.choice(words) for _ in range(n)]
