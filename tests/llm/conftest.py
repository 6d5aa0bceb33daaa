import os
import random
import sys

import pytest

from codecat.llm.stages import on_executors

# Tests here take helpers from one another by their plain names; last, so that the conftest of tests/ stays the one found.
sys.path.append(os.path.dirname(os.path.abspath(__file__)))

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="session")
def sp(spark):
    on_executors(spark)
    return spark


@pytest.fixture(scope="session")
def corpus(sp):
    """Rows with copies, near copies, shared passages, repeated rows, nulls, empties and a clashing extra column."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base, passage = [text(rng.randint(3, 260)) for _ in range(40)], text(60)
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(12):  # near copies, some above and some below the threshold
        words = base[i].split()
        for _ in range(1 + i // 3):
            words[rng.randrange(len(words))] = "CHANGED"
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, f"{text(20)}\n{passage} {text(30)}") for i in range(5)]
    rows += [(300, base[3]), (301, base[3].upper()), (3, base[3]), (302, None), (303, ""), (304, " \t\n"), (305, "one two"), (306, "One  two"),
             (307, "žluťoučký kůň " * 40), (308, "x" * 5000), (None, base[5]), (309, text(3000))]
    data = [(i, t, "en", f"s{(i or 0) % 3}" if i != 305 else None, "keep") for i, t in rows]
    return data, sp.createDataFrame(data, "doc_id long, text string, lang string, source string, tokens string").repartition(7)


@pytest.fixture(scope="session")
def empty(corpus):
    return corpus[1].where("false")
