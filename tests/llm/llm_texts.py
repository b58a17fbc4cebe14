import random


def sentence(rng: random.Random, n: int, words=None) -> str:
    words = words or [a + b for a in ("ka", "lo", "mi", "ru", "te", "zo") for b in ("n", "r", "st", "ble", "", "ing")]
    return " ".join(rng.choice(words) for _ in range(n))
