import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, word string, token string, key long, shard int, n long, D_ string, h_ long, key_ string, t_ string, w_ int, node_ string, gone_ int, Kept string, stratum int"


def texts():
    """Odd and plain texts: near copies, repeats, empty, null, one word, no words, long, with benchmark passages."""
    rng = random.Random(1)
    words = ["the", "of", "and", "to"] * 5 + [f"w{i}" for i in range(400)] + ["Été", "ñandú", "ÀB", "漢字"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [say(rng.randint(60, 160)) for _ in range(25)]
    near = []
    for b in base[:8]:
        ws = b.split()
        ws[rng.randrange(len(ws))] = "changed"
        near.append(" ".join(ws))
    half = [" ".join(b.split()[: len(b.split()) // 2]) + " " + say(60) for b in base[:4]]
    odd = [None, "", "   \n\t ", "one", "One", "a b c d", "A B\tC\nD", "x " * 120, "line one here\n" * 30, say(9000), "é" * 5000, "### $$$ %%% " * 40, "SHOUT! LOUD! NOW! " * 30, "a  b\n\n c d  e\x1cf", "<|endoftext|> plain <|endoftext|>"]
    return base + near + half + odd + [base[0], base[0], "", None], say


@pytest.fixture(scope="session")
def docs(spark):
    got, _ = texts()
    more = ("d", 5, "k", "t", 6, "n", 7, "k", 8)
    rows = [(i, t, ["en", "fr", None][i % 3], "src0", None, 1, "w", "t", 2, 3, 4, *more) for i, t in enumerate(got)]
    rows += [rows[3], (None, got[2], "en", None, 5, 1, "w", "t", 2, 3, 4, *more), (None,) * 20]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    """Whether two lists of rows are equal in any order."""
    return sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))
