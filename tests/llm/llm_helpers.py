"""Small generators the tests of this folder share."""

import random


def prose(seed: int, words: int, vocabulary: int = 300) -> str:
    rng = random.Random(seed)
    syllables = ["ta", "ri", "mo", "len", "qua", "ser", "dif", "no", "pel", "us", "ar", "in"]
    vocab = ["".join(random.Random(i).choices(syllables, k=1 + i % 3)) for i in range(vocabulary)]
    return " ".join(rng.choice(vocab) for _ in range(words))
