import random
import re

import pytest

VOCABULARY = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so", "ti", "vu", "ze") for b in ("ban", "cor", "dil", "fen", "gus", "hal", "jor", "kim", "lap", "mon")]


@pytest.fixture
def prose():
    """A function from a seed and a number of words to a text."""

    def make(seed, n):
        rng = random.Random(seed)
        return " ".join(rng.choice(VOCABULARY) + str(rng.randint(0, 99)) for _ in range(n))

    return make


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
