import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    """A documents table from (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, schema).repartition(3)


@pytest.fixture
def corpus():
    """Texts with copies, near copies, shared passages, nulls, blanks, one long text and runs of one word."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(70)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.choice([1, 3, 4, 8, 30, 120, 300]))]
        if i % 5 == 0:
            k = rng.randrange(len(w) + 1)
            w[k:k] = passage[: rng.choice([40, 49, 50, 60, 70])]
        rows.append((i, " ".join(w)))
    base = [word() for _ in range(150)]
    for i in range(60, 90):
        w = list(base)
        for _ in range(i % 6):
            w[rng.randrange(len(w))] = word()
        rows.append((i, ("\n" if i % 2 else "  ").join(w)))
    rows += [(90 + k, rows[k][1]) for k in range(6)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "a " * 130), (104, "x " + "a " * 90), (105, "a b " * 60), (106, "q " + "a b " * 40)]
    rows += [(107, " ".join(word() for _ in range(6000))), (108, "É " * 20 + "Ünder " * 40), (109, "One Two\x0bthree\x1cfour")]
    return rows
