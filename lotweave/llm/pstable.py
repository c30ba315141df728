"""Nearest neighbours by multiprobe p-stable hashing.

Largest inner product is turned to least distance first: candidates are scaled by the largest norm
and get one more coordinate that brings them to length one, queries are scaled to length one and get
a zero.  Each table hashes a vector by HASHES projections on normal vectors, shifted and cut in slots
of WIDTH.  A query visits its own bucket and then perturbed ones, in order of their estimated chance:
moving a hash to the next slot up or down costs the squared distance to that slot's edge, and sets of
moves are taken by their summed cost.  Candidates met in any table are ranked by exact inner products.

Equal vectors are one class and are hashed once, with the least ids that a result can need.  A bucket's
candidates are cut in blocks, and so are the queries that probe it: each candidate block meets each
query block of the same bucket, and nothing else is copied.  Such pairs of blocks are dealt by a hash
to cells, as many as keep a cell's queries bounded; a task holds one cell's queries at a time and goes
through the candidates in batches.  Queries with too few candidates pass by slices of all rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotweave.llm.common import stored

TABLES = 8
HASHES = 4
WIDTH = 1.0
PROBES = 60
BLOCK = 4096  # classes of one bucket that one cell holds
QUERIES = 8192  # queries of one bucket, and of one cell, that are held together, about
SLICE = 32768  # classes of a slice that passing queries meet
PASSING = 512  # queries that pass by together
BATCH = 8192  # candidates scored together
SEED = 11


def projections(dim: int, tables: int = TABLES, hashes: int = HASHES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Normal directions (tables * hashes x dim + 1) and shifts in slots, the same for the same arguments."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((tables * hashes, dim + 1)), rng.random(tables * hashes)


def slots(unit: np.ndarray, directions: np.ndarray, shifts: np.ndarray, width: float) -> np.ndarray:
    """Real-valued slot of each vector under each projection; its floor is the hash."""
    return unit @ directions.T / width + shifts


def keys(hashed: np.ndarray, table: int = 0) -> np.ndarray:
    """One 64-bit key per row of a table's integer hashes."""
    out = np.full(len(hashed), 0x243F6A8885A308D3 + table, np.uint64)
    for column in hashed.astype(np.int64).T.view(np.uint64):
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def perturbations(hashes: int, probes: int) -> list[list[int]]:
    """The `probes` best sets of moves by expected cost, as places in the order of a query's own costs.

    With costs sorted, the j-th of 2 * hashes costs about j(j+1) for the nearer sides and mirrored for
    the farther ones; sets grow by shifting or extending their last place, cheapest first.  A set may
    not move one hash both ways (places j and 2 * hashes - 1 - j).
    """
    m = hashes
    cost = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    cost += [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    out: list[list[int]] = [[]]
    heap = [(cost[0], [0])]
    while heap and len(out) < probes:
        c, moves = heapq.heappop(heap)
        last = moves[-1]
        if all(2 * m - 1 - j not in moves for j in moves):
            out.append(moves)
        if last + 1 < 2 * m:
            heapq.heappush(heap, (c - cost[last] + cost[last + 1], [*moves[:-1], last + 1]))
            heapq.heappush(heap, (c + cost[last + 1], [*moves, last + 1]))
    return out


def probed(real: np.ndarray, sets: list[list[int]], table: int = 0) -> np.ndarray:
    """Keys of the buckets that each query visits in one table: rows of len(sets)."""
    n, m = real.shape
    low = np.floor(real)
    up = low + 1 - real  # distance to the next slot up
    costs = np.concatenate([real - low, up], axis=1) ** 2
    order = np.argsort(costs, axis=1, kind="stable")  # place -> move
    out = np.empty((n, len(sets)), np.int64)
    rows = np.arange(n)
    for k, moves in enumerate(sets):
        hashed = low.copy()
        for place in moves:
            move = order[:, place]
            hashed[rows, move % m] += np.where(move < m, -1, 1)
        out[:, k] = keys(hashed, table)
    return out


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id whose vector is not null, empty or zero and has finite numbers only."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return rows.filter(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def search(
    vectors: DataFrame, queries: DataFrame, neighbours: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES, block: int = BLOCK,
    queries_held: int = QUERIES,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's nearest found rows of `vectors`.

    `queries` has the same columns; a query is not its own neighbour.  Score is the inner product of
    the original vectors in double precision; ties go to the smaller id.  Rows with a null id, or a
    vector that is null, empty, zero or has null or non-finite parts, take no part, nor do vectors of
    another length than the most usual one.  Rows that repeat an id with the same vector count once.
    Where tables find fewer than `neighbours` candidates for a query, its answer is completed by
    comparing that query with all rows, in blocks.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c"), F.max(norm2).alias("top"))
    usual = lengths.orderBy(F.desc("c"), "n").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, top, keep = usual["n"], float(np.sqrt(usual["top"])), neighbours + 1  # one more: a query's own row
    # a class is a vector; of its ids no result needs more than the least `keep`.  Every task keeps so
    # many before rows move, so that one vector may be a large part of the table
    by_vector = Window.partitionBy("v").orderBy("id")
    least = rows.filter(F.size("v") == dim).distinct().withColumn("k", F.row_number().over(by_vector)).filter(F.col("k") <= keep)
    members = stored(least.withColumn("class", F.min("id").over(Window.partitionBy("v"))), "members")
    classes = members.filter("k = 1").select(F.col("id").alias("rep"), "v")
    asked = stored(usable(queries, id_col, vector_col).filter(F.size("v") == dim).distinct(), "asked")
    asks = stored(asked.groupBy("v").agg(F.min("id").alias("rep")).select("rep", "v"), "query-classes")

    near = stored(_ranked(_meet(*_buckets(classes, asks, dim, top, tables, hashes, width, probes, block, queries_held), keep), members, keep), "near")
    total = members.count()
    short = asks.join(near.filter(F.size("near") >= min(keep, total)), "rep", "left_anti")
    if not short.isEmpty():
        rest = _ranked(_against_all(classes, short, dim, keep), members, keep)
        near = near.join(short, "rep", "left_anti").union(rest)
    names = asked.join(asks.withColumnRenamed("rep", "query"), "v").select("id", "query")
    answered = names.join(near.withColumnRenamed("rep", "query"), "query").select(
        F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, neighbours).alias("near")
    )
    return answered.select("query_id", F.posexplode("near").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score")
    )


def _buckets(classes: DataFrame, asks: DataFrame, dim: int, top: float, tables: int, hashes: int, width: float, probes: int, block: int, queries_held: int):
    """Classes by bucket, and query classes by the buckets that they visit, dealt to cells."""
    directions, shifts = projections(dim, tables, hashes)
    sets = perturbations(hashes, probes)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = matrix(b.column(1)) / top
                unit = np.concatenate([v, np.sqrt(np.maximum(0.0, 1 - (v * v).sum(axis=1, keepdims=True)))], axis=1)
                real = np.floor(slots(unit, directions, shifts, width))
                for t in range(tables):
                    key = keys(real[:, t * hashes : (t + 1) * hashes], t)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key)], ["rep", "v", "bucket"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = matrix(b.column(1))
                unit = np.concatenate([v / np.linalg.norm(v, axis=1, keepdims=True), np.zeros((len(v), 1))], axis=1)
                real = slots(unit, directions, shifts, width)
                for t in range(tables):
                    found = probed(real[:, t * hashes : (t + 1) * hashes], sets, t)
                    limits = np.arange(len(v) + 1, dtype=np.int32) * len(sets)
                    lists = pa.ListArray.from_arrays(pa.array(limits), pa.array(found.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["rep", "v", "buckets"])

    of = classes.schema["v"].dataType.simpleString()
    laid = classes.mapInArrow(index, f"rep long, v {of}, bucket long")
    visits = asks.mapInArrow(visit, f"rep long, v {of}, buckets array<long>").select("rep", F.explode("buckets").alias("bucket"))
    # blocks of the buckets that hold candidates and are visited
    held_by = laid.groupBy("bucket").agg(F.count("*").alias("held"))
    blocks = held_by.join(visits.groupBy("bucket").agg(F.count("*").alias("asked")), "bucket").select(
        "bucket", F.ceil(F.col("held") / block).cast("int").alias("blocks"), F.ceil(F.col("asked") / queries_held).cast("int").alias("query_blocks"), "asked"
    )
    blocks = stored(blocks, "bucket-blocks")
    meetings = blocks.agg(F.coalesce(F.sum(F.col("asked") * F.col("blocks")), F.lit(0))).first()[0]
    parts = _parts(classes)
    cells = _cells(asks.count(), meetings, parts, queries_held)
    cell = F.pmod(F.xxhash64("bucket", "slice", "query_slice"), F.lit(cells)).cast("int")

    def own(limit: str, seed: int) -> Column:
        return F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(limit)).cast("int")

    def every(limit: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(limit) - 1))

    plain = blocks.drop("asked")
    sliced = visits.join(plain, "bucket").withColumn("slice", every("blocks")).withColumn("query_slice", own("query_blocks", 5))
    # a query's vector goes to a cell once, with the meetings that it has there
    met = F.xxhash64("bucket", "slice", "query_slice")
    lists = sliced.groupBy("rep", cell.alias("cell")).agg(F.collect_set(met).alias("buckets"))
    wanted = lists.join(asks, "rep").select("cell", F.lit(0).alias("kind"), "rep", "v", "buckets")
    held = laid.join(plain, "bucket").withColumn("slice", own("blocks", 0)).withColumn("query_slice", every("query_blocks"))
    held = held.select(cell.alias("cell"), F.lit(1).alias("kind"), "rep", "v", F.array(met).alias("buckets"))
    return held, wanted, parts


def _cells(queries: int, meetings: int, parts: int, held: int) -> int:
    """Cells of which one gets about `held` of the queries at most, if each goes to as many as it has meetings.

    A query is missing from a cell with probability exp(-its meetings / cells).
    """
    if queries <= held or not meetings:
        return parts
    return max(parts, int(-meetings / queries / np.log(1 - held / queries)) + 1)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _meet(held: DataFrame, wanted: DataFrame, parts: int, keep: int) -> DataFrame:
    """(query, class, score): in each cell, a query's `keep` nearest classes of the buckets that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, state, waiting = None, None, []
        for b in batches:
            at = 0
            cells, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            while at < b.num_rows:
                run_ = (cells[at:] == cells[at]) & (kinds[at:] == kinds[at])
                end = at + (len(run_) if run_.all() else int(run_.argmin()))
                if cells[at] != cell:
                    if state is not None:
                        yield from state.close(waiting)
                    cell, state, waiting = cells[at], Cell(keep), []
                part = b.slice(at, end - at)
                if kinds[at] == 0:
                    state.ask(part)
                else:
                    waiting.append(part)
                    if sum(len(w) for w in waiting) >= BATCH:
                        state.score(waiting)
                        waiting = []
                at = end
        if state is not None:
            yield from state.close(waiting)

    dealt = wanted.union(held).repartitionById(parts, F.pmod(F.col("cell"), F.lit(parts)).cast("int")).sortWithinPartitions("cell", "kind")
    return dealt.mapInArrow(run, "query long, class long, score double")


def _against_all(classes: DataFrame, asks: DataFrame, dim: int, keep: int, slice_rows: int = SLICE) -> DataFrame:
    """(query, class, score): each query's `keep` nearest classes of every slice of all classes.

    A task holds a slice of bounded size and lets the queries pass by, a few at a time.
    """
    slices = max(_parts(classes), -(-classes.count() // slice_rows))
    own = F.pmod(F.xxhash64("rep"), F.lit(slices)).cast("int")
    held = classes.select(own.alias("slice"), F.lit(0).alias("kind"), "rep", "v")
    passing = asks.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(1).alias("kind"), "rep", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reps, vectors = None, [], []
        for b in batches:
            slices_, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            turns = (np.flatnonzero((np.diff(slices_) != 0) | (np.diff(kinds) != 0)) + 1).tolist()
            for i, j in zip([0, *turns], [*turns, b.num_rows]):
                if i == j:
                    continue
                if slices_[i] != now:
                    now, reps, vectors = slices_[i], [], []
                part = b.slice(i, j - i)
                if kinds[i] == 0:
                    reps.append(part.column(2).to_numpy())
                    vectors.append(matrix(part.column(3)))
                elif reps:
                    reps, vectors = [np.concatenate(reps)], [np.concatenate(vectors)]
                    for at in range(0, len(part), PASSING):
                        yield from _passed(part.slice(at, PASSING), reps[0], vectors[0], keep)

    dealt = held.union(passing).repartitionById(slices, F.col("slice")).sortWithinPartitions("slice", "kind")
    return dealt.mapInArrow(run, "query long, class long, score double")


def _passed(queries: pa.RecordBatch, reps: np.ndarray, vectors: np.ndarray, keep: int) -> Iterator[pa.RecordBatch]:
    cell = Cell(keep)
    cell.hold(queries.column(2).to_numpy(), matrix(queries.column(3)))
    for at in range(0, len(reps), BATCH):
        cell.take(np.arange(len(cell.reps)), reps[at : at + BATCH], vectors[at : at + BATCH])
    yield from cell.close([])


class Cell:
    """The queries of one cell and their nearest classes so far."""

    def __init__(self, keep: int) -> None:
        self.keep, self.asked = keep, []
        self.reps = None

    def hold(self, reps: np.ndarray, vectors: np.ndarray) -> None:
        self.reps, self.v = reps, vectors
        self.scores = np.full((len(reps), self.keep), -np.inf)
        self.near = np.full((len(reps), self.keep), np.iinfo(np.int64).max)

    def ask(self, rows: pa.RecordBatch) -> None:
        self.asked.append(rows)

    def _ready(self) -> None:
        if self.reps is None:
            table = pa.Table.from_batches(self.asked).combine_chunks()
            self.hold(table["rep"].to_numpy(), matrix(table["v"].combine_chunks()))
            lists = table["buckets"].combine_chunks()
            owner = np.repeat(np.arange(len(self.reps)), np.diff(lists.offsets.to_numpy()))
            bucket = lists.flatten().to_numpy()
            order = np.argsort(bucket, kind="stable")
            names, first = np.unique(bucket[order], return_index=True)
            self.of = dict(zip(names.tolist(), np.split(owner[order], first[1:])))
            self.asked = []

    def score(self, rows: list[pa.RecordBatch]) -> None:
        if not self.asked and self.reps is None or not rows:
            return
        self._ready()
        table = pa.Table.from_batches(rows).combine_chunks()
        bucket = table["buckets"].combine_chunks().flatten().to_numpy()
        order = np.argsort(bucket, kind="stable")
        names, first = np.unique(bucket[order], return_index=True)
        reps, v = table["rep"].to_numpy(), matrix(table["v"].combine_chunks())
        for name, mine in zip(names.tolist(), np.split(order, first[1:])):
            who = self.of.get(name)
            for at in range(0, 0 if who is None else len(who), 1024):
                self.take(who[at : at + 1024], reps[mine], v[mine])

    def take(self, who: np.ndarray, reps: np.ndarray, v: np.ndarray) -> None:
        fresh = self.v[who] @ v.T
        worth = fresh >= self.scores[who, -1:]  # the least score kept so far
        some = np.flatnonzero(worth.any(axis=1))
        if not len(some):
            return
        who, fresh = who[some], fresh[some]
        both = np.concatenate([self.scores[who], fresh], axis=1)
        ids = np.concatenate([self.near[who], np.broadcast_to(reps, fresh.shape)], axis=1)
        # twice as many, as a class may come again out of another table's bucket; and all that are as
        # good as the last, so that ties are settled by the least id
        twice = min(2 * self.keep, both.shape[1])
        bar = np.partition(both, -twice, axis=1)[:, [-twice]]
        most = int((both >= bar).sum(axis=1).max())
        at = np.argpartition(-both, most - 1, axis=1)[:, :most]
        both, ids = np.take_along_axis(both, at, 1), np.take_along_axis(ids, at, 1)
        order = np.lexsort((ids, -both), axis=1)
        both, ids = np.take_along_axis(both, order, 1), np.take_along_axis(ids, order, 1)
        again = np.zeros(both.shape, bool)
        again[:, 1:] = ids[:, 1:] == ids[:, :-1]
        both[again], ids[again] = -np.inf, np.iinfo(np.int64).max
        order = np.argsort(again, axis=1, kind="stable")
        both, ids = np.take_along_axis(both, order, 1), np.take_along_axis(ids, order, 1)
        self.scores[who], self.near[who] = both[:, : self.keep], ids[:, : self.keep]

    def close(self, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        self.score(rows)
        if self.reps is not None:
            real = np.isfinite(self.scores)
            query = np.broadcast_to(self.reps[:, None], real.shape)[real]
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(self.near[real]), pa.array(self.scores[real])], ["query", "class", "score"])


def _ranked(best: DataFrame, members: DataFrame, keep: int) -> DataFrame:
    """rep and near: each query class's `keep` nearest ids as (far, id), far the negative exact score."""
    tops = best.groupBy("query", "class").agg(F.max("score").alias("score"))
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    first = tops.withColumn("k", F.row_number().over(by_query)).filter(F.col("k") <= keep).drop("k")
    each = first.join(members.select("class", "id"), "class")
    ids = each.groupBy("query", "id").agg(F.max("score").alias("score"))
    by_id = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    kept = ids.withColumn("k", F.row_number().over(by_id)).filter(F.col("k") <= keep)
    return kept.groupBy(F.col("query").alias("rep")).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "id"))).alias("near"))
