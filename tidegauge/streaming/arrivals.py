"""Batches that arrive in parts: cell counts are kept per (model, batch) until the batch is whole, then graded once.

The state of a batch is one counter per feature and cell (a bin of the reference's range, or a category), in the state
store and not in memory. A batch is whole when it has as many rows as expected, when a row closes it, or when nothing
has arrived for a while. Rows are counted per Arrow batch before they are shuffled, so a batch with most of the stream's
rows sends its state a few counts per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidegauge.config import DriftConfig
from tidegauge.functions.columns import finite
from tidegauge.operators.drift_report import grade_rows, roles, with_verdict
from tidegauge.operators.two_sample import BATCH, FEATURE, VALUE, chi_square, share_distances
from tidegauge.session import checkpointed

MODEL, CELL = "model", "cell"
# Pseudo-features of the counts: all rows of a batch, and those that came after it was graded.
ROWS, LATE = "", "\x00late"
COUNTS = "model string, batch string, feature string, cell string, n long, expected long, closed boolean"
GRADED = "model string, batch string, feature string, cell string, n long"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BY_CELLS = ("psi", "jensenshannon", "chisquare")
BROADCAST_MODELS = 100_000  # ranges of so many models go to every task; those of more are joined by model


def ranges(reference: DataFrame, features: list[str]) -> DataFrame:
    """(model, lo_0, hi_0, …): the range of every numeric feature in a model's reference; one row per model."""
    ends = [
        f(finite(F.col(c).cast("double"))).alias(f"{n}_{i}")
        for i, c in enumerate(features)
        if c in roles(reference, features)["num"]
        for n, f in (("lo", F.min), ("hi", F.max))
    ]
    return reference.groupBy(F.col(MODEL).cast("string").alias(MODEL)).agg(F.count("*").alias("ref_rows"), *ends)


def kept_ranges(known: DataFrame) -> DataFrame:
    """The ranges computed once, not by every micro-batch. Up to BROADCAST_MODELS (counted) are broadcast, since a join by
    model would bring all rows of a model to one task."""
    kept = checkpointed(known)
    return F.broadcast(kept) if kept.count() <= BROADCAST_MODELS else kept


def celled(rows: DataFrame, known: DataFrame, features: list[str], numeric: list[str], bins: int, keep: list[str]) -> DataFrame:
    """(model, keep…, cell_0, cell_1, …): the cell of each feature in a row, null where it has no value.

    Rows of a model without a reference stay, with every number in the first bin.
    """
    def cell(i: int, name: str) -> Column:
        if name not in numeric:
            return F.col(name).cast("string")
        value, lo, hi = finite(F.col(name).cast("double")), F.col(f"lo_{i}"), F.col(f"hi_{i}")
        place = F.floor((value - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins)
        place = F.coalesce(F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)), F.lit(0))
        return F.when(value.isNotNull(), place.cast("string"))

    cells = [cell(i, c).alias(f"cell_{i}") for i, c in enumerate(features)]
    plain = rows.withColumn(MODEL, F.col(MODEL).cast("string"))
    return plain.join(known, MODEL, "left").select(MODEL, *keep, *cells)


def _counted(features: list[str]):
    """Counts of an Arrow batch: per feature and cell, and the rows with what closes their batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = pa.Table.from_batches([batch]), []
            whole = rows.group_by([MODEL, BATCH]).aggregate([([], "count_all"), ("expected", "max"), ("closed", "max")])
            found.append((whole, ROWS, pa.nulls(len(whole), pa.string()), whole["expected_max"], whole["closed_max"]))
            for i, name in enumerate(features):
                own = rows.filter(pc.is_valid(rows[f"cell_{i}"])).group_by([MODEL, BATCH, f"cell_{i}"]).aggregate([([], "count_all")])
                found.append((own, name, own[f"cell_{i}"], pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.bool_())))
            for part, name, cells, expected, closed in found:
                columns = [part[MODEL], part[BATCH], pa.repeat(name, len(part)), cells, part["count_all"], expected, closed]
                names = [MODEL, BATCH, FEATURE, CELL, "n", "expected", "closed"]
                yield from pa.Table.from_arrays(columns, names).combine_chunks().to_batches()

    return count


class Arrivals(StatefulProcessor):
    """Adds up the counts of a (model, batch) and hands them on once, when the batch is whole."""

    def __init__(self, idle_seconds: float | None = None):
        self.idle = None if idle_seconds is None else int(idle_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "feature string, cell string", "n long")
        self.status = handle.getValueState("status", "n long, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived, cells, expected, closed = 0, {}, None, False
        for part in rows:
            for feature, cell, n, most, end in zip(part["feature"], part["cell"], part["n"], part["expected"], part["closed"]):
                if feature == ROWS:
                    arrived += int(n)
                    expected = max(expected or 0, int(most)) if pd.notna(most) else expected
                    closed |= bool(end) if pd.notna(end) else False
                else:
                    cells[feature, cell] = cells.get((feature, cell), 0) + int(n)
        n, done = self.status.get() if self.status.exists() else (0, False)
        if done:
            yield self._table(key, [(LATE, None, arrived)])
            return
        for place, more in cells.items():
            self.counts.updateValue(place, ((self.counts.getValue(place)[0] if self.counts.containsKey(place) else 0) + more,))
        n += arrived
        self.status.update((n, False))
        if closed or (expected is not None and n >= expected):
            yield from self._close(key, n)
        elif self.idle is not None:
            self._forget_timers()
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, done = self.status.get()
        if not done:
            yield from self._close(key, n)

    def _close(self, key, n: int) -> Iterator[pd.DataFrame]:
        found = [(ROWS, None, n)]
        for (feature, cell), (count,) in self.counts.iterator():
            found.append((feature, cell, count))
            if len(found) == 10_000:
                yield self._table(key, found)
                found = []
        yield self._table(key, found)
        self.counts.clear()
        self._forget_timers()
        self.status.update((n, True))

    def _forget_timers(self) -> None:
        for timer in list(self.handle.listTimers()) if self.idle is not None else []:
            self.handle.deleteTimer(timer)

    @staticmethod
    def _table(key, found: list[tuple]) -> pd.DataFrame:
        table = pd.DataFrame(found, columns=[FEATURE, CELL, "n"])
        table.insert(0, BATCH, key[1])
        table.insert(0, MODEL, key[0])
        return table

    def close(self) -> None:
        pass


def reference_counts(reference: DataFrame, known: DataFrame, features: list[str], numeric: list[str], bins: int) -> DataFrame:
    """(model, feature, cell, n) of the references."""
    cells = celled(reference, known, features, numeric, bins, [])
    long = cells.select(MODEL, F.stack(F.lit(len(features)), *[x for i, c in enumerate(features) for x in (F.lit(c), F.col(f"cell_{i}"))]).alias(FEATURE, CELL))
    return long.where(F.col(CELL).isNotNull()).groupBy(MODEL, FEATURE, CELL).agg(F.count("*").alias("n"))


def graded(arrived: DataFrame, ref: DataFrame, features: list[str], numeric: list[str], config: DriftConfig) -> DataFrame:
    """(model, batch, row_count, feature, …, verdict): the graded features of whole batches from their counts."""
    counts, none = arrived.where(~F.col(FEATURE).isin(ROWS, LATE)), F.lit(0).cast("bigint")
    ref = ref.join(arrived.select(MODEL).distinct(), MODEL, "left_semi")
    own = F.struct(MODEL, FEATURE)  # a model's feature has its own reference
    both = ref.select(
        F.to_json(own).alias(FEATURE), F.lit(None).cast("string").alias(BATCH), F.col(CELL).alias(VALUE), F.col("n").alias("n_ref"),
        none.alias("n_cur"), F.col(FEATURE).isin(*numeric, "").alias("is_num"),
    ).unionByName(
        counts.select(
            F.to_json(own).alias(FEATURE), BATCH, F.col(CELL).alias(VALUE), none.alias("n_ref"), F.col("n").alias("n_cur"),
            F.col(FEATURE).isin(*numeric, "").alias("is_num"),
        )
    )
    scores = []
    for is_num, test in ((True, config.numeric_test), (False, config.categorical_test)):
        cells = both.where(F.col("is_num") == is_num).drop("is_num")
        out = chi_square(cells, config.unseen_expected) if test == "chisquare" else share_distances(cells, config.share_floor)
        scores.append(out.select(FEATURE, BATCH, F.col("p_value" if test == "chisquare" else test).alias("drift_score")))
    pair = F.from_json(F.col(FEATURE), "model string, feature string")
    scored = scores[0].unionByName(scores[1]).select(pair["model"].alias(MODEL), BATCH, pair["feature"].alias(FEATURE), "drift_score")
    plan = [
        F.struct(
            F.lit(c).alias(FEATURE),
            F.lit("num" if c in numeric else "cat").alias("column_type"),
            F.lit(config.numeric_test if c in numeric else config.categorical_test).alias("stattest_name"),
            F.lit(config.numeric_threshold if c in numeric else config.categorical_threshold).alias("stattest_threshold"),
        )
        for c in features
    ]
    whole = arrived.where((F.col(FEATURE) == ROWS) & (F.col("n") >= config.min_batch_size))
    here = counts.select(MODEL, BATCH, FEATURE).distinct().withColumn("here", F.lit(True))
    there = ref.select(MODEL, FEATURE).distinct().withColumn("there", F.lit(True))
    grid = (
        whole.select(MODEL, BATCH, F.col("n").alias("row_count"), F.inline(F.array(*plan)))
        .join(here, [MODEL, BATCH, FEATURE], "left")
        .join(there, [MODEL, FEATURE], "left")
        .withColumn("is_lost", F.col("here").isNotNull() != F.col("there").isNotNull())
        .drop("here", "there")
    )
    return with_verdict(grade_rows(grid, scored, [MODEL, BATCH, FEATURE], config), config, (MODEL, BATCH))


def monitor_arrivals(
    stream: DataFrame,
    reference: DataFrame,
    features: list[str],
    batch: str,
    history: str,
    checkpoint: str,
    config: DriftConfig,
    expected: str | None = None,
    closed: str | None = None,
    idle_seconds: float | None = None,
    name: str = "arrivals",
) -> StreamingQuery:
    """Start a query that grades each (model, batch) of ``stream`` once, as soon as it is whole.

    It stops when all that has arrived is handled; with ``idle_seconds`` it waits for more, until it is stopped.

    ``stream`` and ``reference`` have a column ``model``; every model is compared with its own reference rows, of which a
    range per feature is joined to the stream; ranges and cell counts of the reference are taken once, at the start. ``expected`` names a column with a batch's number of rows, ``closed`` a
    boolean column whose true ends a batch; with ``idle_seconds`` a batch also ends when nothing of it has come for so
    long. Tests must work on cells: psi, jensenshannon or chisquare, since a stream does not keep every value.

    A micro-batch writes ``history``/stream=``name``/epoch=<its number>, and only whole: when it is repeated after a
    failure, it replaces its own folder, so a replay writes nothing twice. Rows that come after their batch was graded
    change no record; their number is kept under ``history``-late. Rows without a model or batch belong to none.
    """
    for test in (config.numeric_test, config.categorical_test):
        if test not in BY_CELLS:
            raise ValueError(f"the {test} test needs every value of a batch; a stream keeps cells: {BY_CELLS}")
    spark = reference.sparkSession
    numeric = roles(reference, features)["num"]
    known = kept_ranges(ranges(reference, features))
    ref = checkpointed(reference_counts(reference, known, features, numeric, config.bins))
    rows = stream.where(F.col(MODEL).isNotNull() & F.col(batch).isNotNull()).withColumns(
        {
            BATCH: F.col(batch).cast("string"),
            "expected": F.lit(None).cast("long") if expected is None else F.col(expected).cast("long"),
            "closed": F.lit(None).cast("boolean") if closed is None else F.col(closed),
        }
    )
    cells = celled(rows, known, features, numeric, config.bins, [BATCH, "expected", "closed"])
    mode = "None" if idle_seconds is None else "ProcessingTime"
    arrived = (
        cells.mapInArrow(_counted(features), COUNTS)
        .groupBy(MODEL, BATCH)
        .transformWithStateInPandas(Arrivals(idle_seconds), GRADED, "Append", mode)
    )

    def handle(found: DataFrame, epoch: int) -> None:
        found.persist()
        try:
            if found.isEmpty():
                return
            place = f"stream={name}/epoch={epoch}"
            graded(found, ref, features, numeric, config).write.mode("overwrite").parquet(f"{history}/{place}")
            late = found.where(F.col(FEATURE) == LATE).select(MODEL, BATCH, F.col("n").alias("late_rows"))
            late.write.mode("overwrite").parquet(f"{history}-late/{place}")
        finally:
            found.unpersist()

    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        writer = arrived.writeStream.foreachBatch(handle).outputMode("append").option("checkpointLocation", checkpoint)
        once = {"availableNow": True} if idle_seconds is None else {"processingTime": "1 second"}
        return writer.trigger(**once).start()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
