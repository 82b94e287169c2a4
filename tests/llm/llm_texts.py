"""Texts for the tests of this folder."""

from __future__ import annotations

import random

WORDS = "the cat sat on a mat while rain fell over green hills and small towns near rivers where people walked slowly home after long days of work in fields full of corn barley oats".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(90)) if rng.random() < 0.3 else "") for _ in range(n))


#: Nulls, empty and blank texts, signs alone, repeated rows, a repeated id, a very long text and a very long word.
ODD = [(None, None), (None, "some words here"), (1, None), (2, ""), (3, " \n\t "), (4, "!!! ... 123"), (5, "same text again"), (5, "same text again"), (6, "same text again"), (7, prose(7, 60_000)), (8, "x" * 300_000), (9, "été ça 漢字 \U0001f600")]
