import pytest

#: A documents table with extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string, key int, start int, __size string"


@pytest.fixture(scope="session")
def table(spark):
    def make(rows):
        """rows: (doc_id, text[, lang[, source]])"""
        full = [(*r, *[None] * (4 - len(r)))[:4] + (0, -1, "x", 5, 6, "y") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


def words(seed, n, size=400):
    import random

    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


#: Null and blank texts, ties, repeated rows, null ids, a long text, and text beyond ASCII.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id here"), (5, "ÄÖ é \u2003x\x1fy ß"), (6, " ".join(words(1, 60_000))), (7, "a\nb\n a \n\nb\n"), (7, "other text, same id"),
]
