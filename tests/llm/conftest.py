import random

import pytest

from proofmill.llm.common import prepared

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def ready(spark):
    return prepared(spark)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(["ba", "co", "di", "fu", "ge"]) + r.choice(["la", "mi", "no", "pu", "re"]) + r.choice(["", "s", "n", "t"]) for _ in range(n))


#: Columns that clash with names the operators use inside or return.
EXTRA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, kept boolean, matches string, ids string, spans string, digest string, label int, host string, path string, rep bigint, votes string, copies int, salt int, bins string"


def awkward_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    filled = lambda i, t: (i, t, "en", "s1", len(t or ""), 7, True, "m", "i", "s", "d", 1, "h", "p", 3, "v", 2, 1, "b")
    rows = [filled(i, prose(i, 120)) for i in range(6)]
    rows += [filled(6, rows[2][1]), filled(6, rows[2][1]), filled(7, None), filled(8, ""), filled(9, " \n\t "), filled(10, "one"), filled(11, prose(11, 60_000)), filled(11, "same id, other text")]
    rows += [(None, prose(3, 120)) + (None,) * 17, (12, prose(12, 30)) + (None,) * 17, (None,) * 19, filled(13, "x" * 200_000), filled(14, "a▁b \u0000 \U0001f600 é call +1 (803) 555-5351 or mail a.b@mail.example.com")]
    return rows


@pytest.fixture(scope="session")
def awkward(ready):
    return ready.createDataFrame(awkward_rows(), EXTRA)


@pytest.fixture(scope="session")
def nothing(ready):
    return ready.createDataFrame([], EXTRA)
