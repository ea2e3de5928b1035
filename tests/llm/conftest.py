import pytest


@pytest.fixture()
def docs(spark):
    def make(rows, extra=False):
        kind = "doc_id long, text string, lang string, source string, n_chars long"
        rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
        if extra:
            kind += ", score double, size int, node string, kept string"
            rows = [(*r, 0.5, 1, "n", "k") for r in rows]
        return spark.createDataFrame(rows, kind)

    return make


@pytest.fixture(scope="session")
def words():
    import random

    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    return lambda n, seed: " ".join(random.Random(seed).choices(vocab, k=n))
