"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: bytes of text that one vectorised pass inside a task works on
BLOCK_BYTES = 2_000_000


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` with about ``limit`` bytes each (a longer text
    is a range of its own), so that temporaries stay bounded in a task."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


#: rows of an Arrow batch that carries texts
BATCH_ROWS = 2_000


def small_batches(df: DataFrame) -> None:
    """Let the session send texts to Python in batches of at most BATCH_ROWS
    rows (unless it asks for fewer): whole texts are much larger than the rows
    that Spark's default is meant for."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))


def text_bytes(col: str) -> Column:
    """UTF-8 bytes of a text column; a null text is empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` carries."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_bucket(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def parts_for(rows: int, per_task: int) -> int:
    """Number of groups that keeps about ``per_task`` rows in each."""
    return max(1, math.ceil(rows / per_task))


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of the edges (a, b) held by one task: every node with its
    smallest reachable node (min-label hooking with pointer jumping)."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inv[: len(a)], inv[len(a):]
    label = np.arange(len(nodes))
    while True:
        lo = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], lo)
        np.minimum.at(new, label[v], lo)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new
