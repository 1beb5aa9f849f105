import random

import pytest

WORDS = "the of and to a in that it is was for on are with as be at one have this".split()


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): invented prose with copies, near copies, shared passages, odd white space, nulls, blanks and long texts."""
    rng = random.Random(3)
    vocabulary = WORDS + [f"w{k}" for k in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = prose(60)
    rows = [(k, prose(rng.randint(1, 120))) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(8)]
    base = prose(150).split()
    for k in range(25):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(1000)}"
        rows.append((200 + k, " ".join(copy)))
    rows += [(300 + k, f"{prose(20)}\n{shared}\t{prose(15)}") for k in range(6)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one two three"), (404, "One TWO three"), (405, "é x " * 30), (406, prose(4000)), (407, "same " * 200)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with extra columns, two of which clash with names the operators would like to use."""
    return spark.createDataFrame([(d, t, "x", f"s{d % 3}") for d, t in corpus], "doc_id long, text string, Hits string, source string").repartition(5)
