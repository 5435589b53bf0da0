import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, bucket string, rep long, copies long"


def frame(spark, rows):
    """rows of (doc_id, text[, source]), with further columns whose names the operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 7, "r", "b", 1, 2) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Documents with exact and near copies, shared passages and lines, odd and empty ones, a long one and repeated rows."""
    rng = random.Random(3)
    passage, line = words(rng, 60), "A line that many documents share"
    rows = []
    for i in range(40):
        parts = [words(rng, rng.randrange(5, 80)) for _ in range(3)]
        if i % 5 == 0:
            parts.insert(1, passage)
        if i % 4 == 0:
            parts.insert(2, ("  " if i % 8 else "") + (line.upper() if i % 3 else line) + "\t")
        rows.append((i, "\n".join(parts)))
    base = words(rng, 120)
    for i in range(40, 60):
        w = base.split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(60, base), (61, base.upper()), (62, None), (63, ""), (64, " \t\n "), (65, "one two"), (66, "one two"), (67, "\n\n"), (68, words(rng, 30_000)), (None, "a null id " + passage), (70, "nul\0 and é \u2028 mixed\u00a0space"), (71, "same row"), (71, "same row")]
    return rows
