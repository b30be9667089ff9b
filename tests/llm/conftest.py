import random

import pytest


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls, empty, long and repeated rows, and columns with clashing names."""
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 5))) for _ in range(60)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base = [text(rnd.randrange(1, 60)) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i].replace(" ", "  \n", 2), "en", "s0") for i in range(6)]
    rows += [(200 + i, base[7] + " " + text(2), "fr", "s1") for i in range(5)]
    rows += [(300, None, None, None), (301, "", "en", "s1"), (302, " \t\n ", "en", None), (303, text(9000), "de", "s2"), (304, "x" * 30000, "de", "s2"), (None, "no id here at all", "en", "s0"), (305, "a", "en", "s0")]
    rows += [rows[3], rows[3], (303, None, "en", "s0")]
    df = spark.createDataFrame([(*r, 1, 2, 3, "k") for r in rows], "doc_id long, text string, lang string, source string, bucket int, copies int, n int, sig string")
    return df, rows


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
