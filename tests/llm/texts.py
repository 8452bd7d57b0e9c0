"""Texts for the tests."""

import random

WORDS = "the of and a to in is that for it with as was on are be this from by an thing reation outher anded erst ingly shen wher ntion".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing", "er", str(r.randrange(50))]) for _ in range(n))


def twins(n=1024):
    """Two different words whose polynomials modulo 2**64 are the same, whatever the odd base."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))
