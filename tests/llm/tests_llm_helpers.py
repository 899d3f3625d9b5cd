import random

STEMS = ["wald", "fluss", "berg", "stern", "licht", "stein", "wolke", "baum", "feld", "see", "tal", "wind", "regen", "sonne", "mond"]


def sentence(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice(STEMS) for _ in range(rng.randint(1, 2))) for _ in range(n)]
    return " ".join(words).capitalize() + "."
