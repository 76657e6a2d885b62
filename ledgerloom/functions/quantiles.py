"""Exact, linearly interpolated quantiles of columns too large for one task.

The built-in exact ``percentile`` merges every distinct value in one task. Here, for columns of
any size, each wanted rank is closed in on with the built-in sketch, and exact counts decide which side of the sketch's values the
rank lies on, so the answer is exact whatever the sketch's error. A pass is one aggregate
that moves a bounded sketch per task, and each round cuts the open interval to a few
ten-thousandths of its rows. The first sketch rides along with the pass that counts rows,
and where a bracket must hold few rows the value is looked up in the pass that counts them,
so columns of up to some tens of millions of rows take two passes.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows inside a bracket that one task may look up; more are bracketed again.
GATHER_ROWS = 1 << 16
SKETCH_ACCURACY = 10_000
SKETCH_MARGIN = 3.0 / SKETCH_ACCURACY
# Share of the rows that can lie strictly inside a sketched bracket: its width and the
# sketch's guaranteed error at both ends, with room to spare.
BRACKET_SHARE = 10.0 / SKETCH_ACCURACY


@dataclass
class _Rank:
    """The ``rank``-th smallest value (from 0), known to lie strictly between ``lo`` and ``hi``."""

    column: str
    rank: int
    inside: int
    skipped: int = 0
    lo: float | None = None
    hi: float | None = None
    bracket: tuple[float, float] | None = None
    value: float | None = None

    def within(self) -> Column:
        c = F.col(self.column)
        test = c.isNotNull()
        if self.lo is not None:
            test = test & (c > F.lit(self.lo))
        if self.hi is not None:
            test = test & (c < F.lit(self.hi))
        return F.when(test, c)

    def narrow(self, counts: Sequence[int], between: float | None) -> None:
        """``counts``: rows of the open interval below, at, between and at the bracket's ends.

        ``between`` is the wanted value if it lies between them and was looked up as well.
        """
        a, b = self.bracket
        self.bracket = None
        pieces = [(self.lo, a), a, (a, b), b, (b, self.hi)]
        for i, (piece, size) in enumerate(zip(pieces, [*counts, self.inside - sum(counts)])):
            if self.rank < self.skipped + size:
                if isinstance(piece, tuple):
                    self.lo, self.hi = piece
                    self.inside = size
                    self.value = between if i == 2 else None
                else:
                    self.value = piece
                return
            self.skipped += size
        raise RuntimeError(f"column {self.column} changed between passes")


def exact_quantiles(
    df: DataFrame,
    probabilities: Mapping[str, Sequence[float]],
    extras: Mapping[str, Column] | None = None,
    gather_rows: int = GATHER_ROWS,
) -> tuple[dict[str, list[float | None]], dict[str, Any]]:
    """Quantiles per column, and the values of the ``extras`` aggregates from the first pass."""
    extras = dict(extras or {})
    first = df.agg(
        *[F.count(c).alias(f"n_{c}") for c in probabilities],
        *[_sketch(F.col(c), ps).alias(f"s_{c}") for c, ps in probabilities.items()],
        *[e.alias(name) for name, e in extras.items()],
    ).first()
    counted = {c: first[f"n_{c}"] for c in probabilities}
    results: dict[str, list[float | None]] = {c: [None] * len(ps) for c, ps in probabilities.items()}

    filled = [c for c in probabilities if counted[c]]
    ranks: dict[tuple[str, int], _Rank] = {}
    for c in filled:
        for i, p in enumerate(probabilities[c]):
            place = (counted[c] - 1) * p
            for k in {math.floor(place), math.ceil(place)}:
                bracket = tuple(first[f"s_{c}"][2 * i : 2 * i + 2])
                ranks.setdefault((c, k), _Rank(c, k, counted[c], bracket=bracket))
    _resolve(df, list(ranks.values()), gather_rows)
    for c in filled:
        for i, p in enumerate(probabilities[c]):
            place = (counted[c] - 1) * p
            low = ranks[c, math.floor(place)].value
            high = ranks[c, math.ceil(place)].value
            results[c][i] = low + (place - math.floor(place)) * (high - low)
    return results, {name: first[name] for name in extras}


def _sketch(values: Column, shares: Sequence[float]) -> Column:
    """For each share of the rows two values that most likely enclose the one wanted."""
    bounds = [
        end
        for share in shares
        for end in (max(0.0, share - SKETCH_MARGIN), min(1.0, share + SKETCH_MARGIN))
    ]
    return F.percentile_approx(values, bounds, SKETCH_ACCURACY)


def _resolve(df: DataFrame, ranks: list[_Rank], gather_rows: int) -> None:
    while open_ranks := [r for r in ranks if r.value is None]:
        asking = [r for r in open_ranks if r.bracket is None]
        if asking:
            asked = []
            for r in asking:
                if r.inside <= gather_rows:
                    held = F.array_sort(F.collect_list(r.within()))
                    asked.append(F.slice(held, r.rank - r.skipped + 1, 1))
                else:
                    asked.append(_sketch(r.within(), [(r.rank - r.skipped) / r.inside]))
            row = df.agg(*[e.alias(f"a{i}") for i, e in enumerate(asked)]).first()
            for r, answer in zip(asking, row):
                if r.inside <= gather_rows:
                    r.value = answer[0]
                else:
                    r.bracket = tuple(answer)

        wide = [r for r in open_ranks if r.bracket is not None]
        if not wide:
            continue
        counts = []
        for r in wide:
            v, (a, b) = r.within(), r.bracket
            between = (v > a) & (v < b)
            answer = F.lit(None).cast("double")
            if r.inside * BRACKET_SHARE <= gather_rows:
                held = F.array_sort(F.collect_list(F.when(between, v)))
                place = F.lit(r.rank - r.skipped) - F.count_if(v <= a)
                answer = F.get(held, F.greatest(place, F.lit(-1)).cast("int"))
            counts += [
                F.count_if(v < a),
                F.count_if(v == a),
                F.count_if(between),
                F.count_if((v == b) & F.lit(a != b)),
                answer,
            ]
        row = df.agg(*[e.alias(f"c{i}") for i, e in enumerate(counts)]).first()
        for i, r in enumerate(wide):
            *sizes, answer = row[5 * i : 5 * i + 5]
            r.narrow(sizes, answer)
