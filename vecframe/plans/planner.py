"""(schema, DataFrame, query) to DataFrame: pure plans, so that any table can be searched."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecframe.functions import text, vectors
from vecframe.functions.expressions import expression
from vecframe.plans import queries as Q
from vecframe.plans.filters import WORDS, Affix, Fuzzy, Node, Phrase, Term, text_fields
from vecframe.plans.querylang import parse, rank_terms
from vecframe.runtime import broadcast_if, numbered
from vecframe.schema import Algorithm, Metric, SearchSchema, VectorField

KEY = "_key"
#: Rows that a top-k may hold in a task.
TOP_ROWS = 200_000
#: Reducers of the user's own, by name; see :func:`register_reducer`.
_REDUCERS: dict[str, Callable[..., Column]] = {}


def register_reducer(name: str, make: Callable[..., Column]) -> None:
    """Make a reducer of a name; ``make`` gets the columns of its properties and its constants, and gives an aggregate."""
    if not name or name.upper() != name:
        raise ValueError("the name of a reducer is in capitals")
    _REDUCERS[name] = make


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


class Planner:
    """Plans over one table with a key column; ties always end with the key, so results are the same every time."""

    def __init__(self, schema: SearchSchema, df: DataFrame, key: str = KEY) -> None:
        self.schema, self.df, self.key = schema, df, key

    # pieces

    def where(self, node: Node | None, df: DataFrame | None = None) -> DataFrame:
        df = self.df if df is None else df
        if node is None:
            return df
        asked = [n for leaf in node.leaves() if isinstance(leaf, (Term, Phrase, Affix, Fuzzy)) for n in text_fields(self.schema, leaf.field)]
        if len(asked) > len(set(asked)):  # several conditions on one text: its words are computed once
            df = df.withColumns({WORDS + n: text.words(F.col(n)) for n in sorted(set(asked))})
        rows = df.where(node.column(self.schema, _types(df)))
        return rows.drop(*[c for c in rows.columns if c.startswith(WORDS)])

    def vector_field(self, name: str, vector: Any, runtime: Q.Runtime | None = None, metric: Metric | None = None) -> tuple[VectorField, list[float]]:
        f = self.schema.resolve(name, "vector")
        assert isinstance(f, VectorField)
        if metric is not None and f.metric is not metric:
            raise ValueError(f"field {name} must have the metric {metric.value}")
        if runtime and (runtime.ef_runtime or runtime.epsilon is not None) and f.algorithm is not Algorithm.HNSW:
            raise ValueError(f"field {name} is not of type hnsw: runtime options don't apply")
        width = f.datatype.width
        if isinstance(vector, bytes):
            if len(vector) != f.dims * width:
                raise ValueError(f"field {name} needs {f.dims * width} bytes, not {len(vector)}")
            return f, vectors.decode(vector, f.datatype)
        if len(vector) != f.dims:
            raise ValueError(f"field {name} needs {f.dims} parts, not {len(vector)}")
        return f, list(vector)

    def _columns(self, names: tuple[str, ...]) -> list[Column]:
        known = set(self.df.columns)
        out = []
        for n in names:
            f = self.schema.find(n)
            column = f.column if f else n
            if column in known and column != self.key:
                out.append(F.col(column).alias(n))
            elif n == "id" or column == self.key:
                out.append(F.col(self.key).alias(n))
            else:
                raise ValueError(f"unknown field: {n}")
        return out

    def _project(self, df: DataFrame, names: tuple[str, ...], *more: str, whole: bool = False) -> DataFrame:
        if whole and not names:
            return df
        return df.select(self.key, *[c for n, c in zip(names, self._columns(names)) if n != self.key], *[m for m in more if m not in names])

    @staticmethod
    def _page(df: DataFrame, page: Q.Page) -> DataFrame:
        """A slice of ordered rows; one that reaches far is cut from numbered rows, for a task holds a top-k in memory."""
        if page.offset + page.limit > TOP_ROWS:
            rows = numbered(df, "_place").where((F.col("_place") >= page.offset) & (F.col("_place") < page.offset + page.limit))
            return rows.orderBy("_place").drop("_place")
        return (df.offset(page.offset) if page.offset else df).limit(page.limit)

    # search

    def search(self, query: Q.Query) -> DataFrame:
        return self._page(self.ranked(query), query.page)

    def ranked(self, query: Q.Query) -> DataFrame:
        """All rows of a query, in order and projected; a page is a slice of these."""
        if isinstance(query, Q.FilterQuery):
            return self._project(self.where(query.filter).orderBy(self.key), query.return_fields, whole=True)
        if isinstance(query, Q.TextQuery):
            node = parse(query.text)
            stop = self.schema.index.stopwords
            terms = [w for t in rank_terms(node) for w in text.analyze(t, stop)]
            weights = {f.column: f.weight for f in self.schema.of_kind("text")}
            rows = text.scored(self.where(node), self.df, weights, terms, clamp=self.schema.index.no_frequencies)
            rows = rows.orderBy(F.desc("_score"), self.key)
            return self._project(rows.drop("_score"), query.return_fields, whole=True)
        if isinstance(query, Q.MultiVectorQuery):
            return self._multi(query)
        return self._project(self.nearest(query), query.return_fields, query.score_alias)

    def nearest(self, query: Q.VectorQuery | Q.RangeQuery) -> DataFrame:
        """The rows of a vector query with their distance, nearest first, before any projection."""
        f, vector = self.vector_field(query.field, query.vector, query.runtime)
        node = query.whole_filter if isinstance(query, Q.HybridQuery) else query.filter
        alias = query.score_alias
        rows = self.where(node).withColumn(alias, vectors.distance_to(f.metric, F.col(f.column), vector)).where(F.col(alias).isNotNull() & ~F.isnan(alias))
        if isinstance(query, Q.RangeQuery):
            return rows.where(F.col(alias) <= F.lit(query.threshold)).orderBy(alias, self.key)
        return self._page(rows.orderBy(alias, self.key), Q.Page(0, query.top_k))

    def _multi(self, query: Q.MultiVectorQuery) -> DataFrame:
        parts = [self.vector_field(v.field, v.vector, query.runtime, Metric.COSINE) for v in query.vectors]
        scores = [f"_s{i}" for i in range(len(parts))]
        rows = self.where(query.filter)
        for s, (f, v) in zip(scores, parts):
            rows = rows.withColumn(s, vectors.distance_to(f.metric, F.col(f.column), v))
        slim = rows.select(self.key, *scores)
        best = [self._page(slim.where(F.col(s).isNotNull()).orderBy(s, self.key), Q.Page(0, query.top_k)).select(self.key, s) for s in scores]
        joined = reduce(lambda a, b: a.join(b, self.key), best)
        total = reduce(lambda a, b: a + b, [F.col(s) * F.lit(v.weight) for s, v in zip(scores, query.vectors)])
        ranked = joined.withColumn(query.score_alias, total)
        if query.return_fields:
            ranked = broadcast_if(ranked, query.top_k, 100).join(self.df.select(*dict.fromkeys([self.key, *[(self.schema.find(n).column if self.schema.find(n) else n) for n in query.return_fields if n != "id"]])), self.key)
        return self._project(ranked.orderBy(query.score_alias, *scores, self.key), query.return_fields, query.score_alias)

    # counts

    def count(self, query: Q.CountQuery) -> int:
        return self.where(query.filter).count()

    def total(self, query: Q.Query | Q.Aggregation) -> int:
        """The rows of a query on all its pages: matches, of a nearest query ``top_k`` at most, or groups."""
        if isinstance(query, (Q.AggregationQuery, Q.AggregateHybridQuery)):
            return self.aggregated(query).count()
        if isinstance(query, Q.TextQuery):
            return self.where(parse(query.text)).count()
        return self.ranked(query).count()

    # aggregation

    def aggregate(self, query: Q.Aggregation) -> DataFrame:
        return self._page(self.aggregated(query), query.page)

    def aggregated(self, query: Q.Aggregation) -> DataFrame:
        if isinstance(query, Q.AggregateHybridQuery):
            rows = self.nearest(query.hybrid)
        else:
            rows = self.where(parse(query.query))
        return self._pipeline(rows, query.pipeline)

    def _pipeline(self, rows: DataFrame, p: Q.Pipeline) -> DataFrame:
        applied: list[str] = []
        columns = list(rows.columns)

        def named(name: str) -> str:
            n = name.removeprefix("@")
            f = self.schema.find(n)
            if n not in applied and f is not None and f.column in columns:
                return f.column
            if n in applied or n in columns:
                return n
            raise ValueError(f"unknown property: {name}")

        resolve = lambda n: F.col(named(n))

        for a in p.apply:
            rows = rows.withColumn(a.alias, expression(a.expression, resolve))
            applied.append(a.alias)
        if p.group_by is not None:
            if any(r.name == "RANDOM_SAMPLE" for r in p.group_by.reducers):
                rows = rows.withColumn("_random", F.rand())
            keys = [resolve(n).alias(n) for n in p.group_by.properties]
            aggs = [reducer(r, named).alias(r.alias) for r in p.group_by.reducers]
            rows = rows.groupBy(*keys).agg(*aggs) if aggs else rows.select(*keys).distinct()
            ties = [n for n in p.group_by.properties]
            order = {n: F.col(n) for n in rows.columns}
        else:
            names = list(dict.fromkeys([*p.load, *applied, *[s.property for s in p.sort_by]]))
            rows = rows.select(self.key, *[resolve(n).alias(n) for n in names if n != self.key])
            ties = [self.key]
            order = {n: F.col(n) for n in rows.columns}
        for s in p.sort_by:
            if s.property not in order:
                raise ValueError(f"unknown property: {s.property}")
        sorts = [order[s.property].desc() if s.descending else order[s.property].asc() for s in p.sort_by]
        return rows.orderBy(*sorts, *ties) if sorts or ties else rows

    # batch search

    def nearest_join(self, queries: DataFrame, query_id: str, query_vector: str, field: str, k: int = 1, threshold: float | None = None, filter: Node | None = None) -> DataFrame:
        """(query_id, _key, distance): the ``k`` nearest documents of every row of ``queries``; see ``operators.nearest``."""
        from vecframe.operators.nearest import nearest_join

        f = self.schema.resolve(field, "vector")
        assert isinstance(f, VectorField)
        return nearest_join(queries, query_id, query_vector, self.where(filter), self.key, f.column, f.metric, f.dims, k, threshold)


def reducer(r: Q.Reducer, named: Callable[[str], str]) -> Column:
    """The aggregate column of a reducer; ``named`` gives the column of a property."""
    resolve = lambda n: F.col(named(n))
    value = lambda i: r.args[i] if i < len(r.args) else None
    prop = lambda i=0: resolve(value(i)) if isinstance(value(i), str) else F.lit(value(i))
    number = lambda i=0: prop(i).try_cast("double")
    if r.name != "COUNT" and not r.args:
        raise ValueError(f"{r.name} needs a property")
    if r.name == "COUNT":
        return F.count(F.lit(1))
    if r.name in ("SUM", "AVG"):
        return F.sum(number()) if r.name == "SUM" else F.avg(number())
    if r.name in ("MIN", "MAX"):
        return F.min(prop()) if r.name == "MIN" else F.max(prop())
    if r.name == "COUNT_DISTINCT":
        return F.count_distinct(prop())
    if r.name == "COUNT_DISTINCTISH":
        return F.approx_count_distinct(prop(), 0.01)
    if r.name == "TOLIST":
        return F.array_sort(F.collect_set(prop()))
    if r.name == "QUANTILE":
        if value(2) is not None:  # a stated error: a sketch of bounded size instead of the group's values
            return F.percentile_approx(number(), float(value(1)), max(1, int(1 / float(value(2)))))
        return F.expr(f"percentile_disc({float(value(1))!r}) within group (order by try_cast(`{named(value(0))}` as double))")
    if r.name == "STDDEV":
        return F.stddev_samp(number())
    if r.name == "FIRST_VALUE":
        if len(r.args) > 2:
            by = resolve(value(2))
            return F.max_by(prop(), by) if str(value(3) or "ASC").upper() == "DESC" else F.min_by(prop(), by)
        return F.first(prop(), ignorenulls=True)
    if r.name == "RANDOM_SAMPLE":
        return _sampled(prop(), int(value(1)))
    if r.name in _REDUCERS:
        return _REDUCERS[r.name](*(resolve(a) if isinstance(a, str) and a.startswith("@") else a for a in r.args))
    raise ValueError(f"unknown reducer: {r.name}")


def _sampled(value: Column, n: int) -> Column:
    """``n`` values of a group at random, fewer if it has fewer: those of the smallest numbers of ``_random``, in a heap of that size."""
    from pyspark.sql.internal import InternalFunction

    drawn = F.struct(F.col("_random"), value.alias("v"))
    return InternalFunction._invoke_internal_function_over_columns("collect_top_k", F.when(value.isNotNull(), drawn), F.lit(n), F.lit(True))["v"]


def top_per_key(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark limits each partition before it shuffles."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= k)
