import random
import string

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame(list(enumerate(texts)), schema)


def prose(rng, n, vocabulary=400):
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(2 + i % 7)) for i in range(vocabulary)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def odd_rows(seed=5):
    """(id, text): nulls, empty and white texts, ties, repeated rows, a very long text."""
    rng = random.Random(seed)
    long = " ".join(prose(rng, 900))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, long), (7, long + " x"), (None, "null id text here"), (None, None)]
    return rows + [(8, "same row twice, same row twice"), (8, "same row twice, same row twice"), (9, "É ü 漢字 \U0001f600")]
