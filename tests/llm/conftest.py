import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """(id, text) rows: near copies at both sides of the threshold, exact copies, a long
    list of near copies, common passages, empty, null, short and long texts."""
    rng = random.Random(5)
    word = [f"w{i}" for i in range(400)]

    def text(n):
        return " ".join(rng.choice(word) for _ in range(n))

    def edited(t, k):
        w = t.split()
        for _ in range(k):
            w[rng.randrange(len(w))] = rng.choice(word)
        return " ".join(w)

    rows = ["", None, "  \n\t ", "one two", "One  TWO", "one two three four five", "one two three four",
            "Éa éa b c d", "a b c d e f", "a b c d e"]
    passage = text(60)
    for _ in range(12):
        base = text(rng.randint(6, 300))
        rows += [base, base.upper(), base + " end"]
        rows += [edited(base, rng.randint(1, max(1, len(base.split()) // 30))) for _ in range(4)]
        rows.append(text(50) + " " + passage + " " + text(30))
    hub = text(200)
    rows += [edited(hub, rng.randint(0, 6)) for _ in range(60)]
    rows.append(text(20000))
    return list(enumerate(rows))
