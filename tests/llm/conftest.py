from __future__ import annotations

import random

import pytest

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="session")
def messy_rows() -> list[tuple[int | None, str | None]]:
    """Texts with copies, near copies, shared passages, nulls, empties, odd white space, a very long text and repeated rows."""
    rng = random.Random(5)

    def prose(n: int) -> str:
        return " ".join(rng.choice(WORDS) for _ in range(n))
    base, passage = prose(300), prose(60)
    rows: list[tuple[int | None, str | None]] = [(i, prose(rng.randint(1, 250))) for i in range(60)]
    rows += [(100 + i, base) for i in range(12)]
    for i in range(12):
        words = base.split()
        words[rng.randrange(300)] = f"x{i}"
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, f"{prose(20)}\n{passage}\t {prose(20)}") for i in range(15)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "ONE"), (405, "one two"), (406, "a b c"), (407, "A  b\nc")]
    rows += [(500, prose(20_000)), (501, "dup dup dup " * 40), (502, "naïve café ☃ 𝒳 " * 30), (503, "x" * 5000)]
    rows += [(504, "line one here\nline two here\nline one here\n\n \nline one here" * 20), (505, "# $ % & " * 30 + prose(40))]
    rows += [(600, "same row twice with a few more words"), (600, "same row twice with a few more words")]
    rows += [(None, "no identifier " + prose(30))]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    """The rows in several partitions, with extra columns whose names clash with those that operators use."""
    df = spark.createDataFrame(messy_rows, "doc_id long, text string").repartition(5)
    for name in ("block", "bucket", "hash", "sha", "norm", "words", "lines", "n_words", "kept", "rep", "key", "n", "step", "parts",
                 "component", "node", "a", "b", "_keep", "sequence_id", "carry", "digest", "h", "kept_text", "start"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
