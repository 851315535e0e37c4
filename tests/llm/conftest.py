from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, line_host int, hit_doc_id_ int, dropped_doc_id string, key string, n_words int"


def words(rng: random.Random, n: int, vocabulary: int = 60) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def make_texts() -> list[tuple[int | None, str | None]]:
    """Null, empty, blank, short, copied, nearly copied, repetitive, odd and very long texts."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 70, 5000))
    rows: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, "  \n\t "), (3, "one"), (4, "two Words"), (5, "TWO words"), (6, "x" * 30_000), (7, "▁ literal▁mark 日本 é🙂\r\n\x00 end"), (8, "a a a a a a a a a a a a a a a a a a a a a a a a a")]
    for i in range(9, 40):
        text = " ".join(words(rng, rng.randrange(15, 260), 400))
        if i % 4 == 0:
            text += " " + passage
        if i % 5 == 0:
            text = text.replace(" ", "\n", 6) + "\nshared footer line\n\nshared footer line"
        rows.append((i, text))
    base = words(rng, 200, 3000)
    for i in range(40, 70):  # one original, copies, and near copies that drift apart
        own = list(base)
        for _ in range(i % 6):
            own[rng.randrange(len(own))] = f"edit{i}"
        rows.append((i, " ".join(own)))
    rows.append((70, " ".join(words(rng, 20_000, 9000))))
    rows += [(71, rows[30][1]), (71, rows[30][1]), (None, "no name " + passage), (-5, "negative name " + passage)]
    rows.append((72, "repeat me " * 40 + passage))
    return rows


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", None if k % 9 == 0 else f"s{k % 2}", len(t or ""), "c", k, k, "d", "k", k) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
