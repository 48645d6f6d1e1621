"""Plain helpers of the tests in this folder."""

from __future__ import annotations

import os
import random
import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from inkweave.scale import STEPS, shared_folder


def words(text: str | None, fold: bool = False) -> list[str]:
    text = text or ""
    if fold:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def prose(n: int, seed: float) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))


@contextmanager
def steps_since(spark: SparkSession) -> Iterator[list[str]]:
    """The labels of the step tables that a block leaves behind, known once it has ended."""
    folder = f"{shared_folder(spark)}/{STEPS}"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    left: list[str] = []
    yield left
    left += [name.rpartition("-")[0] for name in set(os.listdir(folder)) - before]
