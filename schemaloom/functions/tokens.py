"""Token counters by name: the offline one is built in; a BPE vocabulary's is made from its rank file."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest rank file, in bytes, that is shipped to the tasks with the function.
MOST_BYTES = 32 << 20


def bpe_counter(path: str, pattern: str) -> Callable[[Column], Column]:
    """A function from a text column to its number of tokens under a rank file, which the driver reads.

    The encoding is built once per task, not per batch. Null has no count.
    """
    with open(path, "rb") as f:
        raw = f.read()
    if len(raw) > MOST_BYTES:
        raise ValueError(f"a vocabulary of {len(raw)} bytes is over the bound of {MOST_BYTES}")

    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(t): int(i) for t, i in (x.split() for x in raw.splitlines() if x)}
        encode = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for texts in parts:
            yield pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int64")

    return F.pandas_udf(count, "long")
