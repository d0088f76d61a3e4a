"""Prefix scans over streams that are cut into ranges.

A window over one stream is one task. Here a stream's rows are cut into ranges of their
order, and a range is what a task sees: it works out its rows' values as far as its own
rows tell, and a summary of the range; the summaries, one row a range, are folded in
order; and what a range's predecessors (or successors) tell is joined to its rows. The
rows are read and shuffled once: windows, summaries and the join all keep a range
together, and what moves beside the rows is one row a range.

The values are such that summaries can be combined: the last or next value that is not
null, the greatest of all, running sums, and sums of the last few rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How much of its order a range covers: packets of a stream, seconds of its samples.
PACKETS, SECONDS = 4_000_000, 7 * 86_400


def dealt(rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` dealt out by a key of ranges. The number of tasks is the session's for
    shuffles: adaptive joining of small ones goes by compressed bytes, and repeated bytes
    would come together in a few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


@dataclass(frozen=True)
class Last:
    """The last value that is not null, before the row or with ``here`` up to it."""

    value: Column
    here: bool = False


@dataclass(frozen=True)
class Next:
    """The first value that is not null, behind the row or with ``here`` from it on."""

    value: Column
    here: bool = False


@dataclass(frozen=True)
class Most:
    """The greatest value of all rows of the key."""

    value: Column


@dataclass(frozen=True)
class Total:
    """The sum of the values up to the row."""

    value: Column


@dataclass(frozen=True)
class Trailing:
    """``total`` and ``n`` of the last ``rows`` rows, the row itself included."""

    value: Column
    rows: int


def lag(*columns: str) -> Last:
    """The row before, as a struct; nulls in it are values, no row before is null."""
    return Last(F.struct(*columns))


class Scan:
    """``rows`` by ``key`` in ``order``, whose first column is a whole number that is not
    null; ``span`` of it is a range. Ties of the order have to be told apart by its other
    columns. A null key is a key of its own."""

    def __init__(self, rows: DataFrame, key: list[str], order: list[str], span: int):
        place = F.floor(F.col(order[0]) / F.lit(span)).alias("_range")
        self.key, self.order, self.columns, self.dealt = key, order, rows.columns, rows.columns
        self.rows = rows.withColumn("_key", F.struct(*key, place)).repartition("_key")

    def add(self, **values) -> Scan:
        """The scan with a column for each of the values."""
        names = [f.name for f in self.rows.schema["_key"].dataType.fields]
        own, down = (W.partitionBy("_key").orderBy(*(o(c) for c in self.order)) for o in (F.asc, F.desc))
        # both branches below use every column that is shuffled, so they read one and the same shuffle
        everything = F.xxhash64(*self.dealt)
        over = W.partitionBy(*(f"_key.{c}" for c in names[:-1])).orderBy("_key._range")
        back = W.partitionBy(*(f"_key.{c}" for c in names[:-1])).orderBy(F.desc("_key._range"))
        before, behind = (w.rowsBetween(W.unboundedPreceding, -1) for w in (over, back))
        at = F.struct(*self.order)
        inside, summary, carried, result, tails = {}, [], {}, {}, []
        for name, v in values.items():
            i, s, c = f"_i_{name}", f"_s_{name}", f"_c_{name}"
            if isinstance(v, (Last, Next)):
                later = isinstance(v, Next)  # a window from the other end, whose frame grows row by row
                frame = (down if later else own).rowsBetween(W.unboundedPreceding, 0 if v.here else -1)
                inside[i] = F.last(v.value, ignorenulls=True).over(frame)
                summary.append((F.min_by if later else F.max_by)(v.value, F.when(v.value.isNotNull(), at)).alias(s))
                carried[c] = F.last(s, ignorenulls=True).over(behind if later else before)
                result[name] = F.coalesce(i, c)
            elif isinstance(v, Most):
                summary.append(F.max(v.value).alias(s))
                carried[c] = F.max(s).over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
                result[name] = F.col(c)
            elif isinstance(v, Total):
                inside[i] = F.sum(v.value).over(own.rowsBetween(W.unboundedPreceding, 0))
                summary.append(F.sum(v.value).alias(s))
                carried[c] = F.sum(s).over(before)
                result[name] = F.when(F.col(i).isNotNull() | F.col(c).isNotNull(), F.coalesce(i, F.lit(0)) + F.coalesce(c, F.lit(0)))
            else:
                tails.append((name, v))
                recent = own.rowsBetween(1 - v.rows, 0)
                inside |= {i: F.struct(F.sum(v.value).over(recent).alias("total"), F.count("*").over(recent).alias("n")), f"_n_{name}": F.row_number().over(own)}
                # a range has a row at least, so that many ranges have the rows that are missing
                carried[c] = F.flatten(F.collect_list(s).over(over.rowsBetween(1 - v.rows, -1)))
                missing = F.greatest(F.lit(0), F.lit(v.rows) - F.col(f"_n_{name}"))
                size = F.coalesce(F.size(c), F.lit(0))
                rest = F.slice(c, F.greatest(F.lit(1), size - missing + 1), F.least(missing, size))
                more = F.aggregate(rest, F.lit(None).cast("long"), lambda a, x: F.when(x.isNull(), a).otherwise(F.coalesce(a, F.lit(0)) + x))
                total = F.when(F.col(f"{i}.total").isNotNull() | more.isNotNull(), F.coalesce(F.col(f"{i}.total"), F.lit(0)) + F.coalesce(more, F.lit(0)))
                result[name] = F.struct(total.alias("total"), (F.col(f"{i}.n") + F.least(missing, size)).alias("n"))
        sums = self.rows.groupBy("_key").agg(F.bit_xor(everything).alias("_seen"), *summary)
        for name, v in tails:
            few = self.rows.select("_key", at.alias("_at"), v.value.alias("_v"), F.row_number().over(down).alias("_r")).where(F.col("_r") < v.rows)
            few = few.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias(f"_s_{name}"))
            sums = sums.join(few, "_key", "left")
        sums = sums.select("_key", "_seen", *(c.alias(n) for n, c in carried.items()))
        out = self.rows.withColumns(inside).join(sums, "_key").where(F.col("_seen").isNotNull() | (everything == 0))
        new = object.__new__(Scan)
        new.key, new.order, new.dealt, new.columns = self.key, self.order, self.dealt, [c for c in self.columns if c not in values] + list(values)
        new.rows = out.select("_key", *(c for c in self.columns if c not in values), *(e.alias(n) for n, e in result.items()))
        return new

    def done(self) -> DataFrame:
        """The rows with their columns and the added ones."""
        return self.rows.select(*self.columns)
