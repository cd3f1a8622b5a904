"""Filling fixed-capacity containers with items.

Bounded-space online best fit: a task keeps a fixed number of open bins in a bitset keyed by free space (an integer
whose bit f is set if some open bin has f tokens free). An item goes to the bin with the least room that still holds it,
found by a shift and the lowest set bit; if none does, the fullest bin closes and a new one opens. Memory is bounded by
the number of open bins whatever the input, nothing shuffles, and a lost task is packed again to the same result, since
a split of the input is read in the same order.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUT = "doc_id bigint, piece int, token_start bigint, token_end bigint, container_id string, container_kind string, capacity_tokens int"


class Bins:
    """Open bins for items up to ``capacity``. ``put`` gives the bins that closed: (number, used)."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: dict[int, list[int]] = defaultdict(list)

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def put(self, size: int) -> tuple[int, list[tuple[int, int]]]:
        """(number of the bin that took the item, bins closed before or by it)."""
        if not 0 <= size <= self.capacity:
            raise ValueError(f"an item of {size} can't go into {self.capacity}")
        closed = []
        room = self.bits >> size
        if room:
            free = (room & -room).bit_length() - 1 + size
            number = self._take(free)
        else:
            if self.open >= self.most_open:
                fullest = (self.bits & -self.bits).bit_length() - 1
                closed.append((self._take(fullest), self.capacity - fullest))
            number, free = self.made, self.capacity
            self.made += 1
        left = free - size
        if left == 0:
            closed.append((number, self.capacity))
        else:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, closed

    def close(self) -> list[tuple[int, int]]:
        rest = [(n, self.capacity - free) for free, numbers in self.by_free.items() for n in numbers]
        self.by_free.clear()
        self.bits = self.open = 0
        return rest


def load(path: str) -> tuple[str, dict[bytes, int]]:
    """(splitting pattern, ranks) of the tokenizer at ``path``, a file of ranks whose pattern is published beside it.
    Read by the driver."""
    import public_tokenizers

    with open(path, "rb") as f:
        return public_tokenizers.PATTERN, {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(loaded: tuple[str, dict[bytes, int]]):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=loaded[0], mergeable_ranks=loaded[1], special_tokens={})


def default_tokenizer() -> str:
    return os.path.join(os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


def pack(
    items: Iterable[tuple[int | None, int]], kinds: list[tuple[str, int]], most_open: int, prefix: str
) -> Iterator[tuple]:
    """Rows as in OUT for (id, tokens). A closed container becomes the smallest kind that holds what is in it; without
    any kind there is none."""
    if not kinds:
        yield from ((doc, 0, 0, size, None, None, None) for doc, size in items)
        return
    kinds = sorted(kinds, key=lambda k: (k[1], k[0]))
    sizes, top = [c for _, c in kinds], kinds[-1][1]
    bins, waiting = Bins(top, most_open), defaultdict(list)

    def leave(closed: list[tuple[int, int]]) -> Iterator[tuple]:
        for number, used in closed:
            kind, capacity = kinds[bisect.bisect_left(sizes, used)]
            for row in waiting.pop(number):
                yield (*row, f"{prefix}-{number}", kind, capacity)

    for doc, size in items:
        start, piece = 0, 0
        while True:
            end = min(size, start + top)
            number, closed = bins.put(end - start)
            waiting[number].append((doc, piece, start, end))
            yield from leave(closed)
            start, piece = end, piece + 1
            if start >= size:
                break
    yield from leave(bins.close())


def containers(
    docs: DataFrame, kinds: list[tuple[str, int]], tokenizer: str | None = None, most_open: int = 64,
    text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """The container of each text, or of each piece of a text longer than the largest container.

    Rows: doc_id, piece (0 first), token_start and token_end in the text's tokens, container_id, container_kind,
    capacity_tokens. A text within the largest capacity is never cut; a longer one is cut at every ``capacity`` tokens.
    Null and empty texts have no tokens and lie in any container. A null key stays null; repeated keys are texts of
    their own. Without a kind of any capacity no text has a container: one row each, container, kind and capacity null.
    Each task leaves at most ``most_open`` containers with room, each the smallest kind that holds its content. Which
    texts share a container follows from how the input is split into tasks: another spark.sql.files.maxPartitionBytes
    gives other containers, as good and as full. The tokenizer is read by the driver and broadcast (its size is that of
    its vocabulary).
    """
    kinds = [k for k in kinds if k[1] > 0]
    shared = docs.sparkSession.sparkContext.broadcast(load(tokenizer or default_tokenizer()))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        tok = encoder(shared.value)
        at = f"{TaskContext.get().partitionId():05d}"

        def items():
            for d in parts:
                for k, t in zip(d["k"].tolist(), d["t"].tolist(), strict=True):
                    yield (None if pd.isna(k) else int(k)), (len(tok.encode_ordinary(t)) if t else 0)

        batch = []
        for row in pack(items(), kinds, most_open, at):
            batch.append(row)
            if len(batch) == 20_000:
                yield frame(batch)
                batch = []
        if batch:
            yield frame(batch)

    names = [c.split()[0] for c in OUT.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        d = pd.DataFrame(rows, columns=names)
        return d.assign(doc_id=d["doc_id"].astype("Int64"), capacity_tokens=d["capacity_tokens"].astype("Int32"))

    return docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).mapInPandas(run, OUT)


def container_kinds(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """The kinds of a containers table, one for each capacity (of several the first by name): no more rows than there
    are capacities."""
    rows = spark.read.parquet(path).where("capacity_tokens > 0").groupBy("capacity_tokens").agg(
        F.min("container_kind").alias("kind")
    ).collect()
    return sorted(((r.kind, r.capacity_tokens) for r in rows), key=lambda k: (k[1], k[0]))
