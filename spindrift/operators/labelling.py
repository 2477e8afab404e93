"""Sequences labelled by the best-scoring path through a grammar of kinds.

Scores are Columns: an array of one score a kind for each item. Only the
dynamic programme itself runs in Arrow tasks, over all rows of a batch at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: A score that forbids a kind.
NEVER = -1e6


@dataclass(frozen=True)
class Grammar:
    """Kinds of items. ``follows`` has the kinds that may stand before each one
    and the bonus of doing so; "" is the beginning. ``last`` may end a sequence."""

    follows: dict[str, dict[str, float]]
    last: frozenset[str]

    @cached_property
    def kinds(self) -> list[str]:
        return list(self.follows)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bonuses of beginning, of (before, after), and of ending."""
        n = len(self.kinds)
        first, step = np.full(n, NEVER), np.full((n, n), NEVER)
        for at, kind in enumerate(self.kinds):
            for before, bonus in self.follows[kind].items():
                if before:
                    step[self.kinds.index(before), at] = bonus
                else:
                    first[at] = bonus
        return first, step, np.array([0.0 if k in self.last else NEVER for k in self.kinds])


def best_paths(scores: list[np.ndarray], grammar: Grammar) -> list[np.ndarray]:
    """Kinds, by number, of sequences of scores (items, kinds). Of equal paths
    the one of the kinds named first. Longest sequences first, so that each step
    takes all that are long enough together."""
    first, step, ending = grammar.tables()
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order], dtype=np.int64)
    found = [np.zeros(0, np.int64)] * len(scores)
    if not len(sizes) or not sizes[0]:
        return found
    # all items in one table, those of a sequence from its own row on
    flat = np.concatenate([scores[i] for i in order])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    total, back = np.zeros((0, len(first))), []
    for t in range(sizes[0]):
        live = int((sizes > t).sum())
        own = flat[begin[:live] + t]
        if not t:
            total = own + first
            continue
        ways = total[:live, :, None] + step
        back.append(ways.argmax(axis=1))
        total = np.concatenate([ways.max(axis=1) + own, total[live:]])
    at = (total + ending).argmax(axis=1)
    kinds = np.zeros(len(flat), np.int64)
    kinds[(begin + sizes - 1)[: len(total)]] = at
    for t in range(sizes[0] - 2, -1, -1):
        live = int((sizes > t + 1).sum())
        kinds[begin[:live] + t] = back[t][np.arange(live), kinds[begin[:live] + t + 1]]
    for row, i in enumerate(order[: len(total)]):
        found[i] = kinds[begin[row] : begin[row] + sizes[row]]
    return found


def labels(scores: Column, grammar: Grammar) -> Column:
    """Numbers of the kinds (array<int>) of an array of arrays of scores, one a
    kind in the grammar's order. A null or an empty array has none."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def run(column: pa.Array) -> pa.Array:
        width = len(grammar.kinds)
        column = column.fill_null([]) if column.null_count else column
        flat = column.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        edges = column.offsets.to_numpy()
        edges = edges - edges[0]
        paths = best_paths([flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], grammar)
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate([*paths, np.zeros(0, np.int64)]), pa.int32()))

    return run(scores)


def score_items(items: Column, grammar: Grammar, of: dict[str, Callable[[Column], Column]]) -> Column:
    """Scores of an array of items: for each kind of the grammar ``of`` gives an
    item's score as a double."""
    return F.transform(items, lambda item: F.array(*(of[k](item).cast("double") for k in grammar.kinds)))
