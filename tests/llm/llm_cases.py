"""Texts for the tests of this folder."""

import random


def prose(seed, words, alphabet="etaoinshrdlu"):
    own = random.Random(seed)
    return " ".join("".join(own.choices(alphabet, k=own.randint(1, 8))) for _ in range(words))


EDGES = [
    (1, None),
    (2, ""),
    (3, " \n\t\n"),
    (4, "Same text here, twice and more.\nSecond line."),
    (5, "Same text here, twice and more.\nSecond line."),
    (6, "x"),
    (7, "é́中文　 ABC\x0bdef ghi <|endoftext|> <|startoftext|>"),
    (8, prose(1, 30_000)),
    (9, "a" * 20_000),
    (10, "\U0001f600" * 300),
    (6, "another text with the same id"),
    (4, "Same text here, twice and more.\nSecond line."),
    (None, "no id"),
]
