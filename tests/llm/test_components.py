import random

from panelforge.llm.components import _state, components


def test_labels_of_random_graphs(spark):
    draw = random.Random(4)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)]
    pairs += [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5), (7, 9), (9, 7)]
    least = {n: n for pair in pairs for n in pair}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            changed |= (least[a], least[b]) != (low, low)
            least[a] = least[b] = low
    got = {
        r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()
    }
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == {n: least[n] for n in linked}


def test_rounds_are_compared_by_whole_hashes(spark):
    """Tables of equal size that differ in any row differ in their state."""
    rows = [(k, k + 1) for k in range(3000)]
    states = set()
    for change in range(40):
        own = [*rows[:change], (change, -1), *rows[change + 1 :]]
        states.add(_state(spark.createDataFrame(own, "a long, b long")))
    assert len(states) == 40
    assert max(len(str(abs(total))) for _, total in states) > 15
