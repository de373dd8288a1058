"""Problem 8: pack documents into containers of fixed capacity.

Bounded-space online best-fit: each task reads its documents once and keeps a fixed number of open containers. Their free
spaces are a bitset, so the container that fits tightest is the lowest set bit at or above the item's size; when nothing
fits and all places are taken, the fullest container closes. What is still open at the end of a task is an item of its
own for a second pass over far fewer tasks (one per 5 000 of them), so the waste does not grow with the number of tasks.

An item above the capacity is cut into full pieces and a rest; no other item is split. Pieces are token ranges.

Defined cases: null and empty texts have 0 tokens and go to any open container; repeated rows are packed each for itself;
an empty table gives no rows; other columns are left behind. Which container holds an item depends on the layout of the
files, the guarantees do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.keys import Carried
from foliant.llm import tokens
from foliant.session import cut

CAPACITY = 4096


class OpenBins:
    """At most `places` open containers; bit f of the set says that one with f units of free space is open."""

    def __init__(self, capacity: int, places: int, first: int = 0):
        self.capacity, self.places, self.next = capacity, places, first
        self.bits, self.count = 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _push(self, free: int, name: int) -> None:
        self.by_free.setdefault(free, []).append(name)
        self.bits |= 1 << free
        self.count += 1

    def _pop(self, free: int) -> int:
        names = self.by_free[free]
        name = names.pop()
        if not names:
            self.bits &= ~(1 << free)
        self.count -= 1
        return name

    def put(self, size: int) -> tuple[int, int | None]:
        """(container of an item of this size, container that closed for it)."""
        fitting = self.bits >> size
        closed = None
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            name = self._pop(free)
        else:
            if self.count >= self.places:
                closed = self._pop((self.bits & -self.bits).bit_length() - 1)
            free, name, self.next = self.capacity, self.next, self.next + 1
        if free == size:
            closed = name if closed is None else closed
            return name, closed  # exactly full: it needs no place
        self._push(free - size, name)
        return name, closed

    def open_names(self) -> set[int]:
        return {x for names in self.by_free.values() for x in names}


def _first_name() -> int:
    return TaskContext.get().partitionId() << 33


def pack(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, places: int = 256, vocabulary: str = tokens.RANKS) -> DataFrame:
    """(key, piece, tok_start, tok_end, container): token ranges of each item and where they went."""
    carried = Carried(df, [key])

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = OpenBins(capacity, places, _first_name())
        for batch in batches:
            at, no, begin, stop, where = [], [], [], [], []
            for i, body in enumerate(batch["t"]):
                size = tokens.count(body, vocabulary)
                for k, a in enumerate(range(0, max(size, 1), capacity)):
                    b = min(a + capacity, size)
                    at.append(i), no.append(k), begin.append(a), stop.append(b), where.append(bins.put(b - a)[0])
            yield pd.DataFrame({key: batch[key].iloc[at].to_numpy(), "piece": no, "tok_start": begin, "tok_end": stop, "container": where})

    rows = df.select(*carried.cols, F.col(text).alias("t"))
    placed = cut(rows.mapInPandas(first, f"{carried.schema}, piece int, tok_start int, tok_end int, container long"))
    used = placed.groupBy("container").agg(F.sum(F.col("tok_end") - F.col("tok_start")).cast("int").alias("used"))
    # every container with room for another of its like is an item of the second pass
    loose = used.filter(F.col("used") <= capacity // 2)

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = OpenBins(capacity, 16 * places, (1 << 62) + _first_name())
        for batch in batches:
            yield pd.DataFrame({"container": batch["container"], "joined": [bins.put(int(u))[0] for u in batch["used"]]})

    parts = max(1, loose.count() // 5000)
    moved = loose.repartition(parts, "container").sortWithinPartitions(F.desc("used"), "container").mapInPandas(second, "container long, joined long")
    return placed.join(moved, "container", "left").select(*carried.back, "piece", "tok_start", "tok_end", F.coalesce("joined", "container").alias("container"))
