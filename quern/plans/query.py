"""A composable query over a DataFrame: filters, projections, flattening, joins, grouping, sets, order and positions,
terminals.

Every operator returns a new Query whose plan is an ordinary DataFrame plan; only terminals run it. Operators that
depend on positions need an order: ``order_by`` gives one, and where none is given an error says so. Indexes over a
whole ordered frame are made without gathering it in one task: rows are range-partitioned by the order, counted by
partition, and numbered from their partition's first index.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.blocks import block_at, blocks_of
from quern.plans.expr import Predicate, same, truth
from quern.session import materialise

#: A side of a join is broadcast without Spark's own estimate only if it is a local list of at most so many rows.
LOCAL_ROWS = 100_000


class EmptySequenceError(ValueError):
    """A terminal that needs a row found none."""


class CardinalityError(ValueError):
    """A terminal that allows one row found more."""


def _cond(p: Predicate | Column | str) -> Column:
    return p.filter() if isinstance(p, Predicate) else F.expr(p) if isinstance(p, str) else p


def _truth(p: Predicate | Column | str) -> Column:
    return p.column() if isinstance(p, Predicate) else truth(F.expr(p) if isinstance(p, str) else p)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def turned(c: Column) -> Column:
    """An order key the other way round, nulls included. A key without a direction ascends with nulls first."""
    node = c._jc.node()
    if not node.getClass().getSimpleName() == "SortOrder":
        return c.desc_nulls_last()
    key = type(c)(SparkSession.active()._jvm.org.apache.spark.sql.Column(node.child()))
    down, last = " DESC " in str(c), " NULLS LAST" in str(c)
    if down:
        return key.asc_nulls_first() if last else key.asc_nulls_last()
    return key.desc_nulls_first() if last else key.desc_nulls_last()


def indexed(df: DataFrame, order: Sequence[Column], name: str = "index") -> DataFrame:
    """``df`` with its position (bigint from 0) in ``order``.

    No task holds more than its range of the rows, the driver sees nothing. The ranges are written once: a second
    sampling could draw them elsewhere.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    rows = materialise(
        rows.withColumns({"__part": F.shiftright(at, 33), "__at": at.bitwiseAND(F.lit((1 << 33) - 1))}), "indexed"
    )
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    first = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    return rows.join(F.broadcast(first), "__part").withColumn(
        name, F.col("__first") + F.col("__at")
    ).drop("__part", "__at", "__first")


class Query:
    def __init__(self, df: DataFrame, order: Sequence[Column] = ()):
        self.df, self.order = df, list(order)

    def _new(self, df: DataFrame, keep_order: bool = False) -> Query:
        return Query(df, self.order if keep_order else ())

    def _ordered(self) -> list[Column]:
        if not self.order:
            raise ValueError("this operator depends on positions: give an order with order_by")
        return self.order

    def to_df(self) -> DataFrame:
        return self.df.orderBy(*self.order) if self.order else self.df

    # Filters and projections

    def where(self, p: Predicate | Column | str) -> Query:
        return self._new(self.df.where(_cond(p)), True)

    def where_indexed(self, test: Callable[[Column], Column]) -> Query:
        """``test`` gets the position."""
        i = indexed(self.df, self._ordered(), "__i")
        return self._new(i.where(test(F.col("__i"))).drop("__i"), True)

    def select(self, *cols: Column | str) -> Query:
        return self._new(self.df.select(*cols))

    def let(self, **cols: Column) -> Query:
        return self._new(self.df.withColumns(cols), True)

    def index(self, name: str = "index") -> Query:
        return self._new(indexed(self.df, self._ordered(), name), True)

    def select_many(
        self, array: Column | str, name: str, *keep: str, outer: bool = False, position: str | None = None
    ) -> Query:
        """One row per element, beside ``keep`` (all columns if none are named)."""
        base = [F.col(c) for c in keep] or [F.col("*")]
        if position:
            f = F.posexplode_outer if outer else F.posexplode
            return self._new(self.df.select(*base, f(_col(array)).alias(position, name)))
        return self._new(self.df.select(*base, (F.explode_outer if outer else F.explode)(_col(array)).alias(name)))

    def cast(self, **kinds: str) -> Query:
        return self._new(self.df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()}), True)

    def of_type(self, kind: Any, tag: str = "$type") -> Query:
        return self._new(self.df.where(F.col(f"`{tag}`") == kind), True)

    def default_if_empty(self, **values: Any) -> Query:
        """One row with ``values`` (else nulls) if there is none."""
        one = self.df.sparkSession.range(1).select(
            *(F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in self.df.schema)
        )
        return self._new(self.df.unionByName(one.where(~self.df.limit(1).select(F.lit(1).alias("x")).exists())))

    def select_many_with(
        self, work: Callable[..., Any], schema: str, *args: Column | str, keep: Sequence[str] = ()
    ) -> Query:
        """Escape hatch for flattening: ``work(*values)`` of each row yields tuples of ``schema``, each beside the row's
        ``keep``. Rows cross to Python in Arrow batches."""
        import pandas as pd
        from pyspark.sql import types as T

        names = [f"_a{k}" for k in range(len(args))]
        src = self.df.select(*keep, *(_col(c).alias(n) for c, n in zip(args, names, strict=True)))
        out = T.StructType([*(src.schema[k] for k in keep), *T.StructType.fromDDL(schema)])

        def run(parts):
            for d in parts:
                rows = [
                    (*own, *made) for own,
                    values in zip(
                        d[list(keep)].itertuples(index=False, name=None), d[names].itertuples(index=False, name=None),
                        strict=True
                    ) for made in work(*values)
                ]
                yield pd.DataFrame(rows, columns=out.names)

        return self._new(src.mapInPandas(run, out))

    def map_batches(self, work: Callable[[Any], Any], schema: str) -> Query:
        """Escape hatch for what no expression gives: ``work`` gets an iterator of pandas frames and yields such frames,
        in Arrow batches."""
        return self._new(self.df.mapInPandas(work, schema))

    def apply(self, f: Callable[..., Any], kind: str, *cols: Column | str, name: str = "value") -> Query:
        """Escape hatch for scalars: a function over pandas series as one more column."""
        return self._new(self.df.withColumn(name, F.pandas_udf(f, kind)(*cols)), True)

    # Joins

    def _on(self, other: DataFrame, keys: Sequence[tuple[str, str]], composite: bool | None) -> Column:
        """A single key never matches null; the components of a composite key do."""
        null_safe = len(keys) > 1 if composite is None else composite
        on = F.lit(True)
        for a, b in keys:
            left, right = F.col(f"l.{a}"), F.col(f"r.{b}")
            on = on & (left.eqNullSafe(right) if null_safe else left == right)
        return on

    def _joined(
        self, other: Query, keys: Sequence[tuple[str, str]] | Sequence[str] | str, how: str, composite: bool | None
    ) -> DataFrame:
        pairs = [(k, k) if isinstance(k, str) else k for k in ([keys] if isinstance(keys, str) else keys)]
        return self.df.alias("l").join(other.df.alias("r"), self._on(other.df, pairs, composite), how)

    def join(self, other: Query, keys: Any, *cols: Column | str, composite: bool | None = None) -> Query:
        """``cols`` refer to the sides as ``l.x`` and ``r.x``; the same holds for the other joins."""
        return self._new(self._joined(other, keys, "inner", composite).select(*cols))

    def left_join(self, other: Query, keys: Any, *cols: Column | str, composite: bool | None = None) -> Query:
        return self._new(self._joined(other, keys, "left", composite).select(*cols))

    def right_join(self, other: Query, keys: Any, *cols: Column | str, composite: bool | None = None) -> Query:
        return self._new(self._joined(other, keys, "right", composite).select(*cols))

    def semi_join(self, other: Query, keys: Any, composite: bool | None = None) -> Query:
        return self._new(self._joined(other, keys, "left_semi", composite), True)

    def anti_join(self, other: Query, keys: Any, composite: bool | None = None) -> Query:
        return self._new(self._joined(other, keys, "left_anti", composite), True)

    def theta_join(self, other: Query, on: Column, *cols: Column | str, equal: Sequence[tuple[str, str]] = ()) -> Query:
        """Any condition. ``equal`` pairs make it an equi join with a residual; without them one side must have at most
        LOCAL_ROWS rows: it is counted, then broadcast."""
        if equal:
            return self._new(
                self.df.alias("l").join(other.df.alias("r"), on & self._on(other.df, equal, False)).select(*cols)
            )
        left, right = self.df, other.df
        if right.limit(LOCAL_ROWS + 1).count() <= LOCAL_ROWS:
            right = F.broadcast(right)
        elif left.limit(LOCAL_ROWS + 1).count() <= LOCAL_ROWS:
            left = F.broadcast(left)
        else:
            raise ValueError(f"both sides have more than {LOCAL_ROWS} rows: name equal columns, or use range_join")
        return self._new(left.alias("l").join(right.alias("r"), on).select(*cols))

    def range_join(self, other: Query, point: str, low: str, high: str, width: float, *cols: Column | str) -> Query:
        """Rows whose ``point`` lies in [low, high] of ``other``, by hash. Numbers are counted in cells of ``width``; a
        range of any length is cut into a bounded number of aligned blocks of cells, and a point looks up the one block
        of each level that holds it. Nulls match nothing."""
        cell = lambda c: F.floor(F.col(c) / width)
        theirs = other.df.where(F.col(low) <= F.col(high)).withColumn(
            "_b", F.explode(blocks_of(cell(low), cell(high) + 1))
        ).select("*", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")).drop("_b")
        present = theirs.select("_level").distinct()
        levels = self.df.where(F.col(point).isNotNull()).select(
            "*", F.posexplode(block_at(cell(point))).alias("_level", "_block")
        )
        mine = levels.join(F.broadcast(present), "_level", "left_semi")  # at most one row per level
        on = (F.col("l._level") == F.col("r._level")) & (F.col("l._block") == F.col("r._block")) & (
            F.col(f"l.{point}") >= F.col(f"r.{low}")
        ) & (F.col(f"l.{point}") <= F.col(f"r.{high}"))
        return self._new(mine.alias("l").join(theirs.alias("r"), on).select(*cols))

    def join_local(self, rows: Sequence[Any], schema: str, keys: Any, *cols: Column | str) -> Query:
        """Join with a local list, broadcast if it has at most LOCAL_ROWS rows."""
        r = self.df.sparkSession.createDataFrame(list(rows), schema)
        return self.join(Query(F.broadcast(r) if len(rows) <= LOCAL_ROWS else r), keys, *cols)

    def group_join(self, other: Query, keys: Any, group: str, *elements: str, composite: bool | None = None) -> Query:
        """Every row once, with the array of its matches' ``elements``; an empty array if there are none. The array is
        one cell: for groups that fit one; where the group is only summed up, ``group_join_agg`` does it with no array
        at all."""
        pairs = [(k, k) if isinstance(k, str) else k for k in ([keys] if isinstance(keys, str) else keys)]
        g = other.df.groupBy(*(F.col(b).alias(b) for _, b in pairs)).agg(
            F.collect_list(F.struct(*elements)).alias("_g")
        )
        j = self.df.alias("l").join(g.alias("r"), self._on(g, pairs, composite), "left")
        empty = F.filter(
            F.array(F.struct(*(F.lit(None).cast(other.df.schema[e].dataType).alias(e) for e in elements))),
            lambda x: F.lit(False)
        )
        return self._new(j.select("l.*", F.coalesce("_g", empty).alias(group)))

    def group_join_agg(self, other: Query, keys: Any, composite: bool | None = None, **aggs: Column) -> Query:
        """Every row once, with aggregates of its matches: combined map-side before anything is shuffled, whatever the
        size of a group. Null where there is no match."""
        pairs = [(k, k) if isinstance(k, str) else k for k in ([keys] if isinstance(keys, str) else keys)]
        g = other.df.groupBy(*(F.col(b).alias(b) for _, b in pairs)).agg(*(c.alias(f"_g_{n}") for n, c in aggs.items()))
        j = self.df.alias("l").join(g.alias("r"), self._on(g, pairs, composite), "left")
        return self._new(j.select("l.*", *(F.col(f"_g_{n}").alias(n) for n in aggs)))

    # Groups and sets

    def group_by(self, *keys: Column | str) -> Grouped:
        return Grouped(self.df, [_col(k) for k in keys])

    def count_by(self, key: Column, name: str = "key") -> Query:
        return self._new(self.df.groupBy(key.alias(name)).agg(F.count("*").alias("count")))

    def aggregate_by(
        self, key: Column, seed: Column, step: Callable[[Column, Column], Column], value: Column, order: Column,
        name: str = "key", result: str = "value"
    ) -> Query:
        """Ordered fold of each group's values. The values of a group are held in one row: for groups of bounded
        size."""
        g = self.df.groupBy(key.alias(name)).agg(
            F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))).alias("_vs")
        )
        return self._new(g.select(name, F.aggregate("_vs", seed, lambda acc, x: step(acc, x["v"])).alias(result)))

    def distinct(self) -> Query:
        return self._new(self.df.distinct())

    def distinct_by(self, *keys: str) -> Query:
        """The first row of each key in the order. Spark's group limit leaves one row per key and task before the
        shuffle, so a hot key costs no more than any."""
        return self._new(_first_by(self.df, keys, self._ordered()))

    def concat(self, other: Query) -> Query:
        return self._new(self.df.union(other.df))

    def union(self, other: Query) -> Query:
        return self._new(self.df.union(other.df).distinct())

    def union_by(self, other: Query, *keys: str) -> Query:
        """The first row of each key, rows of this side before those of the other."""
        both = self.df.withColumn("_side", F.lit(0)).unionByName(other.df.withColumn("_side", F.lit(1)))
        return self._new(_first_by(both, keys, [F.col("_side"), *self._ordered()]).drop("_side"))

    def intersect(self, other: Query) -> Query:
        return self._new(self.df.intersect(other.df))

    def except_(self, other: Query) -> Query:
        return self._new(self.df.subtract(other.df))

    def intersect_by(self, other: Query, *keys: str) -> Query:
        return Query(self._joined(other, list(keys), "left_semi", True), self._ordered()).distinct_by(*keys)

    def except_by(self, other: Query, *keys: str) -> Query:
        return Query(self._joined(other, list(keys), "left_anti", True), self._ordered()).distinct_by(*keys)

    # Order and positions

    def order_by(self, *keys: Column | str) -> Query:
        """Ascending with nulls first, descending with nulls last, unless a key says otherwise."""
        return Query(self.df, [_col(k) for k in keys])

    def then_by(self, *keys: Column | str) -> Query:
        return Query(self.df, [*self._ordered(), *(_col(k) for k in keys)])

    def reverse(self, *keys: Column) -> Query:
        """The rows in the opposite order: each key of the order is turned round. ``keys`` name the turned ones, if
        given."""
        return Query(self.df, list(keys) or [turned(c) for c in self._ordered()])

    def shuffle(self, seed: int | None = None) -> Query:
        return Query(self.df, [F.rand(seed)] if seed is not None else [F.rand()])

    def take(self, n: int) -> Query:
        return self._new(self.to_df().limit(n), True)

    def skip(self, n: int) -> Query:
        return self._new(self.to_df().offset(n), True)

    def take_range(self, start: int, end: int) -> Query:
        return self._new(self.to_df().offset(start).limit(max(0, end - start)), True)

    def take_last(self, n: int) -> Query:
        return self._tail(lambda i, size: i >= size - n)

    def skip_last(self, n: int) -> Query:
        return self._tail(lambda i, size: i < size - n)

    def _tail(self, keep: Callable[[Column, Column], Column]) -> Query:
        size = self.df.agg(F.count("*").alias("n"))
        i = indexed(self.df, self._ordered(), "__i")
        return self._new(i.where(keep(F.col("__i"), size.scalar())).drop("__i"), True)

    def _while(self, p: Any, keep: Callable[[Column, Column], Column]) -> Query:
        i = indexed(self.df, self._ordered(), "__i")
        stop = i.where(~_truth(p)).agg(F.min("__i").alias("stop"))
        return self._new(i.where(keep(F.col("__i"), F.coalesce(stop.scalar(), F.lit((1 << 63) - 1)))).drop("__i"), True)

    def take_while(self, p: Any) -> Query:
        """Up to the first row that fails: its position is found by an aggregate, not by a window over all rows."""
        return self._while(p, lambda i, stop: i < stop)

    def skip_while(self, p: Any) -> Query:
        return self._while(p, lambda i, stop: i >= stop)

    def chunk(self, n: int, *elements: str, name: str = "items") -> Query:
        i = indexed(self.df, self._ordered(), "__i").withColumn("chunk", F.floor(F.col("__i") / n))
        g = i.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("__i", *elements))).alias("_x"))
        return self._new(
            g.select("chunk", F.transform("_x", lambda x: F.struct(*(x[e].alias(e) for e in elements))).alias(name))
        )

    def zip(self, other: Query, *cols: Column | str) -> Query:
        """Rows paired by position, as many as the shorter side has."""
        a, b = indexed(self.df, self._ordered(), "__i"), indexed(other.df, other._ordered(), "__i")
        return self._new(a.alias("l").join(b.alias("r"), F.col("l.__i") == F.col("r.__i")).select(*cols))

    def append(self, **row: Any) -> Query:
        return self._edge(1, row)

    def prepend(self, **row: Any) -> Query:
        return self._edge(-1, row)

    def _edge(self, side: int, row: dict[str, Any]) -> Query:
        one = self.df.sparkSession.range(1).select(
            *(F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in self.df.schema)
        )
        both = self.df.withColumn("_edge", F.lit(0)).unionByName(one.withColumn("_edge", F.lit(side)))
        return Query(both, [F.col("_edge"), *self.order])

    def top_by_group(self, n: int, *keys: str) -> Query:
        """The first ``n`` rows of each key in the order; Spark's group limit prunes each task before the shuffle."""
        w = Window.partitionBy(*keys).orderBy(*self._ordered())
        return self._new(self.df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r"), True)

    # Terminals

    def _some(self, n: int, p: Any = None, backwards: bool = False) -> list:
        q = self.where(p) if p is not None else self
        return q.to_df().limit(n).collect()

    def first(self, p: Any = None) -> Any:
        rows = self._some(1, p)
        if not rows:
            raise EmptySequenceError("no row")
        return rows[0]

    def first_or_default(self, p: Any = None, default: Any = None) -> Any:
        return next(iter(self._some(1, p)), default)

    def last(self, p: Any = None) -> Any:
        row = self.last_or_default(p)
        if row is None:
            raise EmptySequenceError("no row")
        return row

    def last_or_default(self, p: Any = None, default: Any = None) -> Any:
        q = self.where(p) if p is not None else self
        return next(iter(q.take_last(1).df.collect()), default)

    def single(self, p: Any = None) -> Any:
        rows = self._some(2, p)
        if not rows:
            raise EmptySequenceError("no row")
        if len(rows) > 1:
            raise CardinalityError("more than one row")
        return rows[0]

    def single_or_default(self, p: Any = None, default: Any = None) -> Any:
        rows = self._some(2, p)
        if len(rows) > 1:
            raise CardinalityError("more than one row")
        return rows[0] if rows else default

    def element_at(self, i: int) -> Any:
        """Negative positions count from the end."""
        row = self.element_at_or_default(i)
        if row is None:
            raise IndexError(i)
        return row

    def element_at_or_default(self, i: int, default: Any = None) -> Any:
        self._ordered()
        df = self.to_df().offset(i).limit(1) if i >= 0 else self._tail(lambda at, size: at == size + i).df
        return next(iter(df.collect()), default)

    def count(self, p: Any = None) -> int:
        return (self.where(p) if p is not None else self).df.count()

    def _agg(self, c: Column) -> Any:
        return self.df.agg(c.alias("x")).first()[0]

    def sum(self, c: Column | str) -> Any:
        """0 without values; whole numbers that leave their type's range are an error."""
        kind = self.df.select(_col(c).alias("x")).schema["x"].dataType
        total = self._agg(F.sum(_col(c)))
        if total is None:
            return 0
        bits = {"int": 31, "bigint": 63, "smallint": 15, "tinyint": 7}.get(kind.simpleString())
        if bits and not -(1 << bits) <= total < 1 << bits:
            raise OverflowError(total)
        return total

    def _needed(self, x: Any) -> Any:
        if x is None and self.df.isEmpty():
            raise EmptySequenceError("no row")
        return x

    def average(self, c: Column | str) -> Any:
        return self._needed(self._agg(F.avg(_col(c))))

    def min(self, c: Column | str) -> Any:
        return self._needed(self._agg(F.min(_col(c))))

    def max(self, c: Column | str) -> Any:
        return self._needed(self._agg(F.max(_col(c))))

    def min_by(self, key: Column | str) -> Any:
        """The row with the least known key; the first in the order among equals."""
        return Query(self.df.where(_col(key).isNotNull()), [_col(key).asc(), *self.order]).first()

    def max_by(self, key: Column | str) -> Any:
        return Query(self.df.where(_col(key).isNotNull()), [_col(key).desc(), *self.order]).first()

    def aggregate(self, seed: Column, step: Callable[[Column, Column], Column], value: Column) -> Any:
        """Ordered fold of all values by one task: its nature; a commuting step is better written as an aggregate."""
        order = F.struct(
            *(F.row_number().over(Window.orderBy(*self._ordered())).alias("o"),)
        ) if self.order else F.struct(F.lit(0).alias("o"))
        rows = self.df.select(order.alias("o"), value.alias("v"))
        got = rows.agg(
            F.aggregate(
                F.array_sort(F.collect_list(F.struct("o", "v"))), seed, lambda acc, x: step(acc, x["v"])
            ).alias("x")
        )
        return got.first()[0]

    def any(self, p: Any = None) -> bool:
        return not (self.where(p) if p is not None else self).df.isEmpty()

    def all(self, p: Any) -> bool:
        return self.df.where(~_truth(p)).isEmpty()

    def contains(self, **row: Any) -> bool:
        cond = F.lit(True)
        for k, v in row.items():
            cond = cond & same(F.col(k), F.lit(v))
        return not self.df.where(cond).isEmpty()

    def sequence_equal(self, other: Query) -> bool:
        a, b = indexed(self.df, self._ordered(), "__i"), indexed(other.df, other._ordered(), "__i")
        if a.columns != b.columns:
            return False
        pair = a.select(F.col("__i"), F.struct(*self.df.columns).alias("x")).join(
            b.select(F.col("__i"), F.struct(*other.df.columns).alias("y")), "__i", "full"
        )
        return pair.where(~F.col("x").eqNullSafe(F.col("y"))).isEmpty()

    def to_list(self) -> list:
        return self.to_df().collect()

    def to_pandas(self):
        return self.to_df().toPandas()

    def to_arrow(self):
        return self.to_df().toArrow()

    def to_dictionary(self, key: str) -> dict:
        out: dict = {}
        for r in self.to_list():
            if r[key] in out:
                raise CardinalityError(f"the key {r[key]!r} is there twice")
            out[r[key]] = r
        return out

    def to_lookup(self, key: str) -> dict[Any, list]:
        out: dict = {}
        for r in self.to_list():
            out.setdefault(r[key], []).append(r)
        return out

    def to_set(self) -> set:
        return set(self.distinct().df.collect())


def _first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


class Grouped:
    """Groups; a null key is a group, a constant key over no rows is none."""

    def __init__(self, df: DataFrame, keys: list[Column]):
        self.df, self.keys = df, keys

    def agg(self, *cols: Column) -> Query:
        return Query(self.df.groupBy(*self.keys).agg(*cols))

    def collect(self, name: str, *elements: str) -> Query:
        """The groups' elements as arrays: for groups of bounded size."""
        return self.agg(F.collect_list(F.struct(*elements)).alias(name))

    def top(self, n: int, key: str, *order: Column) -> Query:
        return Query(self.df, order).top_by_group(n, key)


def nan_low(c: Column | str) -> list[Column]:
    """Ascending order keys with null first, then NaN, then the numbers."""
    c = _col(c)
    return [c.isNotNull().asc(), F.isnan(c).desc(), c.asc()]


def sum_or_zero(c: Column | str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))
