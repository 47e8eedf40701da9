"""The subsequence of whole-row bits has the pairs of the plain table, and long lists stay in bounded memory."""

import random
import time
import tracemalloc

from cadenza.operators.subsequence import common_subsequence


def _table(script, heard):
    lengths = [[0] * (len(heard) + 1)]
    for word in script:
        row = [0]
        for j, other in enumerate(heard, 1):
            row.append(lengths[-1][j - 1] + 1 if word == other else max(lengths[-1][j], row[-1]))
        lengths.append(row)
    pairs, i, j = [], len(script), len(heard)
    while i and j:
        if script[i - 1] == heard[j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif lengths[i - 1][j] >= lengths[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def test_pairs_of_the_table():
    rng = random.Random(1)
    for _ in range(600):
        words = "abcdefghij"[: rng.randint(1, 10)]
        script, heard = ([rng.choice(words) for _ in range(rng.randint(0, 25))] for _ in range(2))
        assert common_subsequence(script, heard) == _table(script, heard)


def test_hearing_of_a_long_script():
    rng = random.Random(2)
    script = [f"w{int(rng.paretovariate(0.7)) % 4000}" for _ in range(40_000)]
    heard = [w if rng.random() < 0.9 else "noise" for w in script if rng.random() < 0.95]
    tracemalloc.start()
    began = time.time()
    pairs = common_subsequence(script, heard)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs) > 30_000 and all(script[i] == heard[j] for i, j in pairs) and pairs == sorted(pairs)
    assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
    # The plain table has 1.5 billion cells.
    assert peak < 120 << 20 and time.time() - began < 120
