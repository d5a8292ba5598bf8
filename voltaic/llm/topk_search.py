"""Exact top-k search by inner product: columnar branch and bound.

The vectors are packed into tiles in vertical layout (one run of values per dimension).
Queries (the rows whose id a stated number divides) form blocks, candidates form parts, and
each task takes one block and one part.  Dimensions are taken in the order of the queries'
mass, a block of them at a time; after each the score of a pair is at most what it has plus
the product of both remaining norms, and pairs below the query's k-th best score so far
are left out.  While many pairs live, the columns of the candidates are compacted; when few
do, the pairs themselves.  A part's best k of each query then meet by query.

Components are whole numbers and partial scores are exact (doubles below 2^53, otherwise
Python integers).  Scores beyond a long are held at its ends.

Results for odd input: vectors that are null or hold null or non-finite components take no
part (``vectors``), neither do rows without an id; a shorter vector has zeros in the missing
places; rows of the same id are rows of their own, as queries and as candidates, and a
query leaves out only its own row; ties go to the smaller id; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import padded, vector_rows, whole_batches

#: Dimensions taken at once.
DIMS = 16
#: Queries that meet a tile at once.
QUERY_ROWS = 64
_LONG = np.iinfo(np.int64)
PACKED = "query boolean, tile long, n int, dims int, ids binary, numbers binary, width int, values binary"


def _pack(matrix: np.ndarray) -> tuple[int, bytes]:
    """(bytes a value, values dimension by dimension) in the least width that holds them."""
    top = int(np.abs(matrix).max(initial=0))
    width = next(w for w, most in ((1, 127), (2, 32767), (4, 2 ** 31 - 1), (8, _LONG.max)) if top <= most)
    return width, np.ascontiguousarray(matrix.T).astype(f"<i{width}").tobytes()


def _unpack(row: dict) -> np.ndarray:
    """Values as an int64 array of (dimension, vector)."""
    return np.frombuffer(row["values"], f"<i{row['width']}").reshape(row["dims"], row["n"]).astype(np.int64)


def tiles(table: DataFrame, query_step: int, tile_rows: int) -> DataFrame:
    """The packed tiles (``PACKED``): of all vectors, and again of those that are queries.
    ``numbers`` tell rows of the same id apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        seen, tile = 0, part
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows(query: bool, ids: np.ndarray, numbers: np.ndarray, matrix: np.ndarray):
            width, values = _pack(matrix)
            return pa.RecordBatch.from_pylist([{
                "query": query, "tile": tile, "n": len(ids), "dims": matrix.shape[1], "ids": ids.astype("<i8").tobytes(),
                "numbers": numbers.astype("<i8").tobytes(), "width": width, "values": values}], schema=schema)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seen, tile
            dims = max(m.shape[1] for _, m in held)
            ids, matrix = np.concatenate([i for i, _ in held]), np.concatenate([padded(m, dims) for _, m in held])
            numbers = (part << 40) + seen + np.arange(len(ids))
            asks = ids % query_step == 0
            if asks.any():
                yield rows(True, ids[asks], numbers[asks], matrix[asks])
            yield rows(False, ids, numbers, matrix)
            seen, tile = seen + len(ids), tile + 1
            held.clear()

        for ids, matrix in whole_batches(batches, tile_rows):
            known = np.flatnonzero(np.asarray(ids.is_valid()))
            if len(known):
                held.append((ids.take(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.int64), matrix[known]))
            if sum(len(i) for i, _ in held) >= tile_rows:
                yield from flush()
        if held:
            yield from flush()

    schema = pa.schema([("query", pa.bool_()), ("tile", pa.int64()), ("n", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()),
                        ("numbers", pa.binary()), ("width", pa.int32()), ("values", pa.binary())])
    return vector_rows(table).mapInArrow(run, PACKED)


class Best:
    """The k best candidates so far of each query of a block."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, values: np.ndarray, k: int):
        self.ids, self.numbers, self.k = ids, numbers, k
        mass = (values.astype(np.float64) ** 2).sum(1)
        self.order = np.argsort(-mass, kind="stable")             # dimensions of most mass first
        self.values = values[self.order].T                        # a row a query
        self.top = int(np.abs(values).max(initial=0))
        self.floats = self.values.astype(np.float64)
        self.rest = self._rest(self.floats.T)
        self.score = np.full((len(ids), k), _LONG.min)
        self.found = np.full((len(ids), k), _LONG.max)
        self.filled = np.zeros(len(ids), np.int64)
        self.number_at = {int(x): i for i, x in enumerate(numbers)}

    @staticmethod
    def _rest(columns: np.ndarray) -> list[np.ndarray]:
        """Per block of dimensions, the norm of what comes after it."""
        squares = columns ** 2
        tail = np.cumsum(squares[::-1], 0)[::-1]
        ends = range(DIMS, columns.shape[0], DIMS)
        return [np.sqrt(tail[e]) for e in ends] + [np.zeros(columns.shape[1])]

    def meet(self, ids: np.ndarray, numbers: np.ndarray, values: np.ndarray) -> None:
        """A tile of candidates (``values`` by dimension) meets all queries."""
        dims = self.values.shape[1]
        if values.shape[0] > dims:
            values = values[:dims]                                # the queries have zeros there
        columns = np.zeros((dims, len(ids)), np.int64)
        columns[:values.shape[0]] = values
        columns = columns[self.order]
        exact = dims * max(self.top, 1) * max(int(np.abs(values).max(initial=0)), 1) < 1 << 53
        floats = columns.astype(np.float64)
        rest = self._rest(floats) if dims else []
        own = np.array([[self.number_at[x], j] for j, x in enumerate(numbers.tolist()) if x in self.number_at], np.int64).reshape(-1, 2)
        for a in range(0, len(self.ids), QUERY_ROWS):
            b = min(a + QUERY_ROWS, len(self.ids))
            mine = own[(own[:, 0] >= a) & (own[:, 0] < b)] - [a, 0]
            if exact and dims:
                q, c, score = self._bounded(a, b, floats, rest, mine)
            else:
                whole = np.clip(self.values[a:b].astype(object) @ columns.astype(object), _LONG.min, _LONG.max).astype(np.int64) \
                    if dims else np.zeros((b - a, len(ids)), np.int64)
                alive = np.ones(whole.shape, bool)
                alive[mine[:, 0], mine[:, 1]] = False
                q, c = np.nonzero(alive)
                score = whole[q, c]
            self._keep(a + q, score, ids[c])

    def _bounded(self, a: int, b: int, columns: np.ndarray, rest: list[np.ndarray], own: np.ndarray):
        """(query less ``a``, candidate, score) of the pairs that no bound leaves out."""
        limit = np.where(self.filled[a:b] == self.k, self.score[a:b, -1], -np.inf).astype(np.float64)
        queries, at = self.floats[a:b], np.arange(columns.shape[1])
        score = np.zeros((b - a, len(at)))
        outside = np.zeros(score.shape, bool)
        outside[own[:, 0], own[:, 1]] = True
        pairs = None
        for j, after in enumerate(rest):
            dims = slice(j * DIMS, (j + 1) * DIMS)
            mine = self.rest[j][a:b]
            if pairs is None:
                score += queries[:, dims] @ columns[dims][:, at]
                slack = mine[:, None] * after[at][None, :] * (1 + 1e-9) + 1e-6
                if len(at) > self.k and j < len(rest) - 1:
                    # k candidates reach their lower bounds for certain
                    least = np.where(outside, -np.inf, score - slack)
                    limit = np.maximum(limit, np.partition(least, len(at) - self.k, 1)[:, len(at) - self.k])
                alive = (score + slack >= limit[:, None]) & ~outside
                share = alive.mean()
                if share < 0.1:
                    q, c = np.nonzero(alive)
                    pairs = (q, at[c], score[q, c])
                elif share < 0.9:
                    cols = np.flatnonzero(alive.any(0))
                    if len(cols) < 0.75 * len(at):
                        at, score, outside = at[cols], score[:, cols], outside[:, cols]
            else:
                q, c, s = pairs
                s = s + np.einsum("ij,ij->i", queries[q, dims], columns[dims].T[c])
                live = s + mine[q] * after[c] * (1 + 1e-9) + 1e-6 >= limit[q]
                pairs = (q[live], c[live], s[live])
        if pairs is None:
            q, c = np.nonzero((score >= limit[:, None]) & ~outside)
            pairs = (q, at[c], score[q, c])
        q, c, s = pairs
        return q, c, np.rint(s).astype(np.int64)

    def _keep(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge new pairs into the best of their queries: score down, id up."""
        if not len(q):
            return
        some = np.unique(q)
        slot = np.arange(self.k)[None, :] < self.filled[some][:, None]
        old_q, old_at = np.repeat(some, self.k).reshape(-1, self.k)[slot], slot
        all_q = np.concatenate([old_q, q])
        all_s = np.concatenate([self.score[some][old_at], score])
        all_i = np.concatenate([self.found[some][old_at], ids])
        order = np.lexsort((all_i, ~all_s, all_q))                 # ~s orders as -s, without overflow
        all_q, all_s, all_i = all_q[order], all_s[order], all_i[order]
        starts = np.searchsorted(all_q, some)
        place = np.arange(len(all_q)) - np.repeat(starts, np.diff(np.append(starts, len(all_q))))
        kept = place < self.k
        self.score[all_q[kept], place[kept]] = all_s[kept]
        self.found[all_q[kept], place[kept]] = all_i[kept]
        self.filled[some] = np.minimum(np.diff(np.append(starts, len(all_q))), self.k)


def top_k(table: DataFrame, k: int = 20, query_step: int = 20, tile_rows: int = 2048, block_queries: int = 1 << 15,
          task_pairs: int = 1 << 32) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): of every row whose ``vec_id`` is a multiple of
    ``query_step`` the ``k`` candidates of highest inner product.

    Queries go in blocks of about ``block_queries``, candidates in parts, so that a task has
    at most about ``task_pairs`` pairs; every vector is sent once to each block of queries
    and every query once to each part."""
    spark = table.sparkSession
    n, asked = table.agg(F.count("vec_id"), F.count(F.when(F.col("vec_id") % query_step == 0, 1))).first()
    blocks = max(1, -(-asked // block_queries))
    cells = max(-(-n * asked // task_pairs), int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    parts = max(1, min(-(-cells // blocks), -(-n // tile_rows)))
    spread = F.when(F.col("query"), F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.pmod("tile", F.lit(blocks)) * parts + p)) \
        .otherwise(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b.cast("long") * parts + F.pmod("tile", F.lit(parts))))
    dealt = (tiles(table, query_step, tile_rows).select("*", F.explode(spread).alias("cell"))
             .repartitionById(blocks * parts, F.col("cell").cast("int")).sortWithinPartitions(F.col("query").desc(), "tile"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: list[dict] = []
        best = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                if row["query"]:
                    queries.append(row)
                    continue
                if best is None and queries:
                    dims = max(r["dims"] for r in queries)
                    best = Best(np.concatenate([np.frombuffer(r["ids"], "<i8") for r in queries]),
                                np.concatenate([np.frombuffer(r["numbers"], "<i8") for r in queries]),
                                np.concatenate([padded(_unpack(r).T, dims) for r in queries]).T, k)
                if best is not None:
                    best.meet(np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["numbers"], "<i8"), _unpack(row))
        if best is not None:
            slot = np.arange(k)[None, :] < best.filled[:, None]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(x, k).reshape(-1, k)[slot]) for x in (best.numbers, best.ids)] + [pa.array(best.found[slot]), pa.array(best.score[slot])],
                ["number", "query_id", "vec_id", "score"])

    found = dealt.mapInArrow(search, "number long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 20, query_step: int = 20) -> str:
    """DuckDB SQL of ``top_k`` for vectors of one size."""
    return f"""
with v as (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as xs from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.rid, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.xs, c.xs) as bigint) as score from v q join v c on q.rid <> c.rid where q.vec_id % {query_step} = 0),
r as (select *, row_number() over (partition by rid order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= {k}"""
