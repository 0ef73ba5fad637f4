"""Deterministic bag-of-words embedding for everything that must be reproducible."""

from __future__ import annotations

import hashlib
import math
import re

import pandas as pd
from pyspark.sql import Column, functions as F

DIM = 128
_TOKEN = re.compile(r"[a-z0-9]+")


def bow_vector(text: str | None, dim: int = DIM, seen: dict | None = None) -> list[float]:
    """Counts of the tokens in the dimension given by their MD5, scaled to length one; empty text gives zeros."""
    seen = {} if seen is None else seen
    v = [0.0] * dim
    for t in _TOKEN.findall((text or "").lower()):
        at = seen.get(t)
        if at is None:
            at = seen[t] = int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim
        v[at] += 1.0
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def embed(c: Column, dim: int = DIM) -> Column:
    """Arrow-batched embedding of a text column."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        seen: dict = {}
        return s.map(lambda t: bow_vector(t, dim, seen))

    return run(c)
