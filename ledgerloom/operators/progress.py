"""How far each source has been searched: a mark that moves only on what joins it, and holes kept to be caught up."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType

from ledgerloom.sources.ship import ship

#: Days searched again before the mark, and the furthest an automatic run goes back.
OVERLAP, LOOKBACK = 3, 90

#: A run's days and what it says of itself.
RUN = ("today", "automatic", "since", "until", "ok", "own", "floor")


def _least(*x):
    return min((v for v in x if v is not None), default=None)


def _greatest(*x):
    return max((v for v in x if v is not None), default=None)


def _to(a, b) -> bool:
    return a is not None and b is not None and a <= b


def _asked(state: tuple, today, automatic, since, own) -> tuple:
    """(since, cut, hole_from, hole_until): where a run starts. An automatic one starts a little before the mark, at the
    source's own start if there is none; beyond ``LOOKBACK`` it is cut, and what it leaves out is a hole."""
    known, hole_from, hole_until = state
    start = own if known is None else known - OVERLAP
    bound = None if today is None else today - LOOKBACK
    if not automatic or start is None or bound is None or start >= bound:
        return since if automatic is False else start, False, hole_from, hole_until
    end = bound - 1 if hole_from is None or hole_until is None else max(hole_until, bound - 1)
    return bound, True, _least(hole_from, start), end


def _step(state: tuple, today, automatic, since, until, ok, own, floor) -> tuple:
    """(since, state): a run's start and the state after it. A search that joins what is known moves the mark, one that was cut
    moves it too, a first one that does not reach back to the source's own start pins it there; a search over a hole's first
    day shortens or ends it."""
    known = state[0]
    since, cut, hole_from, hole_until = _asked(state, today, automatic, since, own)
    if not ok:
        return since, (known, hole_from, hole_until)
    until = _least(until, today)
    joins = _to(since, known + 1) if known is not None else _to(since, own) and _to(own, until)
    if cut or joins:
        mark = until if cut or known is None else _greatest(known, until)
    else:
        mark = known if known is not None else _least(None if own is None else own + OVERLAP, today)
    first = None if hole_from is None else _greatest(hole_from, floor)
    if first is not None and _to(since, first) and _to(first, until):
        rest = hole_until if hole_until is not None else None if today is None else today - LOOKBACK - 1
        hole_from, hole_until = (None, None) if _to(rest, until) else (until + 1, hole_until)
    return since, (mark, hole_from, hole_until)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by source and order, one after another; only the state of the source at hand is kept."""
    source, run, state, begun = None, None, None, False
    for batch in batches:
        sources, runs = batch.column("source").to_pylist(), batch.column("run").to_pylist()
        starts = zip(*(batch.column(f"__{c}").to_pylist() for c in ("known", "from", "until")), strict=True)
        rows = zip(*(batch.column(c).to_pylist() for c in RUN), strict=True)
        kept, out = [], []
        for s, r, start, row in zip(sources, runs, starts, rows, strict=True):
            if not begun or s != source:
                source, state, begun = s, start, True
            elif r == run:
                kept.append(False)
                continue
            run = r
            since, state = _step(state, *row)
            kept.append(True)
            out.append((since, *state))
        mask = pa.array(kept, pa.bool_())
        days = zip(*out, strict=True) if out else ([],) * 4
        dates = [pa.array(d, pa.int32()).cast(pa.date32()) for d in days]
        names = ["source", "run", "since", "searched_until", "hole_from", "hole_until"]
        yield pa.RecordBatch.from_arrays([batch.column("source").filter(mask), batch.column("run").filter(mask), *dates], names=names)


def steps(runs: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """(source, run, since, searched_until, hole_from, hole_until): every run of the log, where it searched from and what was known
    after it.

    ``runs``: source, run (their order), today, automatic, since and until (asked for by a manual run; an automatic one has its
    until), ok (it ended without an error), own (the source's own start), floor (before it nothing can be searched; null: none).
    ``states``: source, searched_until, hole_from, hole_until to go on from. A run that fails moves nothing, but a hole that its
    start left is kept. A source's runs are folded in order, so they go through one task, as a sorted stream of which no more
    than a batch is held; of repeated runs one counts; empty logs give no rows.
    """
    day = lambda c: F.unix_date(F.col(c)).cast("int").alias(c)
    log = runs.select("source", F.col("run").cast("long").alias("run"), *(F.col(c) if c in ("automatic", "ok") else day(c) for c in RUN))
    begun = {"__known": "searched_until", "__from": "hole_from", "__until": "hole_until"}
    if states is None:
        log = log.withColumns({c: F.lit(None).cast("int") for c in begun})
    else:
        log = log.join(states.select("source", *(F.unix_date(c).cast("int").alias(n) for n, c in begun.items())), "source", "left")
    ship(runs.sparkSession)
    schema = StructType([runs.schema["source"], StructField("run", LongType()), *(StructField(c, DateType()) for c in ("since", "searched_until", "hole_from", "hole_until"))])
    return log.repartition("source").sortWithinPartitions("source", "run").mapInArrow(_folded, schema)


def last(done: DataFrame) -> DataFrame:
    """The state that each source is in after ``steps``."""
    return done.groupBy("source").agg(F.max_by(F.struct("searched_until", "hole_from", "hole_until"), "run").alias("x")).select("source", "x.*")
