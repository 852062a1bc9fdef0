"""Word salad with a seed."""

import random


def prose(seed: int, n: int, words=400) -> str:
    g = random.Random(seed)
    vocabulary = [f"w{i}x" for i in range(words)]
    return " ".join(g.choice(vocabulary) for _ in range(n))
