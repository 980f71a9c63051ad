import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _h long, key string, size long, shard int, node long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, repeated rows, nulls in each column, empty, blank and long texts; columns with the operators' own names."""
    rng = random.Random(3)
    base = [words(rng, n) for n in (40, 60, 80, 120, 3, 5, 1, 200)]
    near = base[3].split()
    near[60] = "changed"
    texts = [*base, base[0], base[1], " ".join(near), base[2] + " " + words(rng, 50), None, "", "  \n ", base[7] * 20, "ab " * 300, None, "", "Ünï cödé \U0001f600 text\tx"]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    out += [(None, base[4] + " null id", None, None, None), out[0], out[0]]
    return [(*r, 1, 2, "k", 3, 4, 5) for r in out]


@pytest.fixture(scope="session")
def odd(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
