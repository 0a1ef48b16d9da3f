"""Greedy packing of panels into rows of twelve columns, in the order given."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import free_name

COLUMNS = 12
#: Widths of a run of switched-off panels by how many there are.
OFF_WIDTHS = {1: 12, 2: 6}


def pack(spans: Sequence[int], on: Sequence[bool]) -> list[tuple[int, int]]:
    """``(row, width)`` of each panel.

    A row closes when the next panel doesn't fit or is in the other state.
    Switched-off runs are of even width; what a row leaves over is shared, and
    what can't be shared evenly goes one each to the first of its panels.
    """
    n, wide = len(spans), list(spans)
    i = 0
    while i < n:
        j = i
        while j < n and on[j] == on[i]:
            j += 1
        if not on[i]:
            wide[i:j] = [OFF_WIDTHS.get(j - i, 4)] * (j - i)
        i = j
    taken = lambda m: min(COLUMNS, max(1, wide[m]))
    rows: list[list[int]] = []
    for k in range(n):
        fits = rows and on[rows[-1][0]] == on[k] and sum(taken(m) for m in rows[-1]) + taken(k) <= COLUMNS
        if fits:
            rows[-1].append(k)
        else:
            rows.append([k])
    out: list[tuple[int, int]] = [(0, 0)] * n
    for r, members in enumerate(rows):
        slack = COLUMNS - sum(taken(m) for m in members)
        each, rest = divmod(slack, len(members))
        for place, m in enumerate(members):
            out[m] = (r, wide[m] + each + (place < rest))
    return out


class Packer:
    """``pack`` over panels that come page by page, a page's in order, in blocks of any length.

    Rows never go across a run of panels of one state, so all that is held from
    block to block are the panels of the row that is open (the first three of a
    run that is switched off, whose widths its length decides).
    """

    def __init__(self) -> None:
        self.spans: list[int] = []
        self.on, self.row, self.long = False, 0, False
        self.places: list[tuple[int, int]] = []

    def close(self, spans: list[int]) -> None:
        """A row of these panels."""
        taken = [min(COLUMNS, max(1, s)) for s in spans]
        each, rest = divmod(COLUMNS - sum(taken), len(spans))
        self.places += [(self.row, s + each + (k < rest)) for k, s in enumerate(spans)]
        self.row += 1

    def end_run(self) -> None:
        held, self.spans = self.spans, []
        if not self.on and held:
            held = [4 if self.long else OFF_WIDTHS.get(len(held), 4)] * len(held)
        if held:
            self.close(held)
        self.long = False

    def add(self, first: bool, span: int, on: bool) -> None:
        if first or on != self.on:
            self.end_run()
            if first:
                self.row = 0
            self.on = on
        if on:
            if sum(min(COLUMNS, max(1, s)) for s in self.spans) + min(COLUMNS, max(1, span)) > COLUMNS:
                self.close(self.spans)
                self.spans = []
        elif len(self.spans) == 3:
            self.close([4] * 3)
            self.spans, self.long = [], True
        self.spans.append(span)

    def done(self) -> list[tuple[int, int]]:
        """``(row, width)`` of the panels that have a place since the last call."""
        out, self.places = self.places, []
        return out


def pack_rows(items: DataFrame, keys: Sequence[str] = (), order: str = "ord") -> DataFrame:
    """``row, width`` beside each panel ``ord, span, is_on`` of a page.

    A task walks through all pages of its partition, sorted, and holds a batch
    and the open row, whatever the number of pages and their lengths.
    """
    nth = free_name(items, "__nth")
    # The order of panels that it doesn't tell apart is settled here.
    placed = items.withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy(order))).sortWithinPartitions(*keys, nth)

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, left = Packer(), []

        def ready(places: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            """What has a place of the batches that wait, in their order."""
            at = 0
            while at < len(places):
                part = left[0].slice(0, len(places) - at)
                own = places[at : at + len(part)]
                at += len(part)
                left[0] = left[0].slice(len(part))
                if not len(left[0]):
                    left.pop(0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r for r, _ in own], pa.int64()), pa.array([w for _, w in own], pa.int64())], [*part.schema.names, "row", "width"])

        for batch in batches:
            if not len(batch):
                continue
            left.append(batch.drop_columns([nth]))
            for n, span, on in zip(*(batch.column(c).to_pylist() for c in (nth, "span", "is_on")), strict=True):
                packer.add(n == 1, span, on)
            yield from ready(packer.done())
        packer.end_run()
        yield from ready(packer.done())

    return placed.mapInArrow(run_task, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + ", row long, width long")
