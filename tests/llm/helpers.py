"""Small documents that hold the awkward cases every operator must stand."""

from __future__ import annotations

import random

ALPHABET = "the of and river stone light over under window garden summer Ça été straße señor 42 x".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(ALPHABET) + rng.choice(["", ",", ".", "s"]) for _ in range(n))


def awkward(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """(doc_id, text): nulls, empty and blank texts, a long one, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(seed)
    shared, base = prose(rng, 60), prose(rng, 200)
    words = base.split()
    docs: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, "  \n\t "), (4, "word"), (5, "Ünïcode wörds — “quoted” ☃"), (None, "a text without an id"), (6, "x " * 3000), (7, base), (8, base), (8, base)]
    for i in range(10, 24):
        near = list(words)
        for _ in range(i % 4):
            near[rng.randrange(len(near))] = "changed"
        docs.append((i, " ".join(near)))
    docs += [(i, f"{prose(rng, rng.randrange(0, 150))} {shared} {prose(rng, rng.randrange(0, 150))}") for i in range(30, 42)]
    docs += [(i, prose(rng, rng.randrange(1, 300))) for i in range(50, 70)]
    docs.append((90, prose(rng, 20_000)))
    docs.append((91, "\n".join(["the same line again and again"] * 30)))
    return docs


def frame(spark, docs, schema: str = "doc_id long, text string, lang string, source string, n_chars long, TEXT_2 string"):
    """``docs`` with the other columns of documents and one more."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in docs], schema)
