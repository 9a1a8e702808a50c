import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, key string, n int, label string, part string, _found string, edge long"


def made_texts(n=60, seed=1):
    """Random prose with near copies, exact copies and shared passages."""
    r = random.Random(seed)
    words = [f"w{r.randrange(400)}" for _ in range(400)]
    passage = " ".join(r.choice(words) for _ in range(40))
    out = []
    for i in range(n):
        if i % 7 == 3 and out:
            w = r.choice(out).split()
            for _ in range(max(1, len(w) // r.choice([8, 15, 30]))):
                if w:
                    w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w))
        elif i % 11 == 5:
            out.append(out[i // 2])
        elif i % 9 == 4:
            out.append(" ".join(r.choice(words) for _ in range(30)) + "\n" + passage + "\n" + " ".join(r.choice(words) for _ in range(20)))
        else:
            out.append(" ".join(r.choice(words).title() if r.random() < 0.1 else r.choice(words) for _ in range(r.randrange(1, 120))))
    return out


EDGES = [None, "", " \n\t", "one", "one", "a b c d", "a b c d e", "A B C D E", " x y z", "é ñ 日本 🙂", "x " * 5000, "y" * 20000, "dup dup dup dup dup dup dup dup dup dup dup dup dup dup dup dup"]


def rows():
    """(doc_id, text) with edge cases, repeated rows and rows without doc_id."""
    texts = made_texts() + EDGES
    out = list(enumerate(texts))
    return [*out, out[3], (4, texts[4]), (None, "no id at all here"), (None, None), (None, texts[0])]


@pytest.fixture(scope="session")
def docs(spark):
    """The rows as documents, with more columns whose names operators use themselves."""
    data = [(i, t, "en" if k % 3 else None, None if k % 5 == 0 else f"s{k % 4}", None, 1, "k", 2, "l", "p", "f", 9) for k, (i, t) in enumerate(rows())]
    return spark.createDataFrame(data, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
