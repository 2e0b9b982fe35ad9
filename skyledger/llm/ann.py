"""Approximate nearest neighbours by cosine over robust-pruned directed graphs, one for each shard.

Every different vector is a node of one shard's graph. A shard's graph is built in batches: a greedy beam search for each
node of the batch proposes what it visited as neighbours, and robust pruning (Subramanya and others, "DiskANN", 2019)
keeps a neighbour only if none kept before it is nearer to it by the factor ``alpha``, so that edges stay diverse. Edges
are added in the other direction too, and lists that overflow are pruned again. Queries, in blocks, are a table in the
shared folder; a task holds a few shards, streams the blocks past them, all queries of a block in step, and hands on each
query's best. So neither shards nor queries are shuffled for the search. Distances in graphs are single precision, between
vectors that were brought to unit length in double precision; every node of a beam is then scored in double precision on
the original vectors.

Rows with equal vectors are one node, which carries the smallest k + 1 ids: no larger one can be among the k nearest.
Vectors of different length have no cosine: shards hold vectors of one length, and queries search those of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import file_system, one_task_each, shared_path, written

#: Nodes of a shard, about; of a block of queries, at most; shards that a task searches together.
SHARD, QUERIES, TOGETHER = 4096, 512, 8
DEGREE, SLACK, BUILD_BEAM, BEAM, ALPHA = 40, 56, 96, 128, 1.2
SALTS = 16


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that the largest component is between a half and one: cosines stay as they are, and no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors, found in double precision, as float32."""
    x = scaled(x)
    return np.ascontiguousarray(x / np.sqrt((x**2).sum(axis=1, keepdims=True)), dtype=np.float32)


class Graph:
    """Unit vectors (float32), neighbours by row (padded with -1) and the row at which searches enter."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray, entry: int):
        self.vectors, self.edges, self.entry = vectors, edges, entry

    @classmethod
    def build(cls, vectors: np.ndarray, degree: int = DEGREE, slack: int = SLACK, beam: int = BUILD_BEAM, alpha: float = ALPHA, batch: int = 256, seed: int = 5) -> Graph:
        n, x = len(vectors), unit(vectors)
        draw = np.random.default_rng(seed)
        edges = np.full((n, slack), -1, np.int32)
        if n > 1:
            first = min(degree // 2, n - 1)
            edges[:, :first] = (np.arange(n)[:, None] + draw.integers(1, n, (n, first))) % n
        graph = cls(x, edges, int((x @ x.mean(axis=0)).argmax()) if n else 0)
        order = draw.permutation(n)
        for at in range(0, n, batch):
            graph._insert(order[at : at + batch], degree, beam, alpha)
        return graph

    def _insert(self, rows: np.ndarray, degree: int, beam: int, alpha: float) -> None:
        found, _ = self.search(self.vectors[rows], beam)
        proposed = np.concatenate([found, self.edges[rows]], axis=1)
        self.edges[rows] = -1
        self.edges[rows, :degree] = kept = self._prune(rows, proposed, degree, alpha)
        source, target = np.repeat(rows, degree), kept.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, starts, counts = np.unique(target, return_index=True, return_counts=True)
        held = (self.edges[nodes] >= 0).sum(axis=1)
        wide = np.full((len(nodes), self.edges.shape[1] + counts.max(initial=0)), -1, np.int32)
        wide[:, : self.edges.shape[1]] = self.edges[nodes]  # neighbours fill a row from its left
        row = np.repeat(np.arange(len(nodes)), counts)
        wide[row, held[row] + np.arange(len(source)) - starts[row]] = source
        over = held + counts > self.edges.shape[1]
        self.edges[nodes[~over]] = wide[~over, : self.edges.shape[1]]
        if over.any():
            self.edges[nodes[over]] = -1
            self.edges[nodes[over], :degree] = self._prune(nodes[over], wide[over], degree, alpha)

    def _prune(self, rows: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
        """Of each row's proposed neighbours (repeats, itself and -1 allowed), those that robust pruning keeps, nearest first."""
        out = np.full((len(rows), degree), -1, np.int32)
        for at in range(0, len(rows), 256):
            some = rows[at : at + 256]
            c = np.sort(proposed[at : at + 256], axis=1)
            bad = (c < 0) | (c == some[:, None])
            bad[:, 1:] |= c[:, 1:] == c[:, :-1]
            v = self.vectors[c]
            own = np.where(bad, np.inf, 2 - 2 * np.einsum("qcd,qd->qc", v, self.vectors[some]))
            order = np.argsort(own, axis=1, kind="stable")
            c, own, v = np.take_along_axis(c, order, 1), np.take_along_axis(own, order, 1), np.take_along_axis(v, order[:, :, None], 1)
            between = (2 - 2 * (v @ v.transpose(0, 2, 1))) * alpha**2
            alive, q = np.isfinite(own), np.arange(len(some))
            for k in range(degree):
                pick = alive.argmax(axis=1)
                ok = alive[q, pick]
                if not ok.any():
                    break
                out[at : at + 256][ok, k] = c[q, pick][ok]
                alive &= ~((between[q, pick] <= own) & ok[:, None])
                alive[q, pick] = False
        return out

    def search(self, queries: np.ndarray, beam: int = BEAM, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The rows nearest to each unit query that a beam search finds, nearest first (padded with -1), and their squared distances."""
        n, beam = len(queries), max(1, min(beam, len(self.vectors)))
        # a beam's entry is one integer: distance bits, row, and whether it still has to be expanded
        keys = np.full((n, beam), np.iinfo(np.uint64).max, np.uint64)
        keys[:, 0] = self._keys(queries, np.full((n, 1), self.entry, np.int32))[:, 0]
        active = np.arange(n)
        while len(active):
            held = keys[active]
            open_ = (held & np.uint64(1) == 1) & (held != np.iinfo(np.uint64).max)
            going = open_.any(axis=1)
            active, held, open_ = active[going], held[going], open_[going]
            if not len(active):
                break
            chosen = open_ & (np.cumsum(open_, axis=1) <= width)
            place = np.argsort(~chosen, axis=1, kind="stable")[:, :width]
            real = np.take_along_axis(chosen, place, 1)
            rows = np.where(real, (np.take_along_axis(held, place, 1) >> np.uint64(1) & np.uint64(0x7FFFFFFF)).astype(np.int64), 0)
            near = np.where(real[:, :, None], self.edges[rows], -1).reshape(len(active), -1)
            held = held - chosen.astype(np.uint64)  # expanded from now on
            merged = np.sort(np.concatenate([held, self._keys(queries[active], near)], axis=1), axis=1)
            again = np.zeros(merged.shape, bool)
            again[:, 1:] = merged[:, 1:] >> np.uint64(1) == merged[:, :-1] >> np.uint64(1)
            merged[again] = np.iinfo(np.uint64).max
            keys[active] = np.sort(merged, axis=1)[:, :beam]
        missing = keys == np.iinfo(np.uint64).max
        rows = np.where(missing, -1, (keys >> np.uint64(1) & np.uint64(0x7FFFFFFF)).astype(np.int64)).astype(np.int32)
        return rows, np.where(missing, np.inf, (keys >> np.uint64(32)).astype(np.uint32).view(np.float32).reshape(keys.shape))

    def _keys(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        far = np.maximum(2 - 2 * np.einsum("qcd,qd->qc", self.vectors[rows], queries), 0).astype(np.float32)
        key = far.view(np.uint32).astype(np.uint64) << np.uint64(32) | rows.astype(np.uint64) << np.uint64(1) & np.uint64(0xFFFFFFFF) | np.uint64(1)
        return np.where(rows < 0, np.iinfo(np.uint64).max, key)


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part: no null, empty or zero vector, none with a null, NaN or infinite component, no null id."""
    v = F.col(vector_col).cast("array<double>")
    good = F.size(v).__gt__(0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), good.alias("good"))
    return rows.filter("good AND vec_id IS NOT NULL").drop("good")


def nodes(rows: DataFrame, k: int) -> DataFrame:
    """v, ids: each different vector with the smallest k + 1 ids of its rows. Salted, so that a very common vector meets in no task as a whole."""
    salted = Window.partitionBy("v", "salt").orderBy("vec_id")
    few = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).withColumn("place", F.row_number().over(salted)).filter(F.col("place") <= k + 1)
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def build_index(rows: DataFrame, k: int = 5, *, shard: int = SHARD) -> DataFrame:
    """The index, a table in the shared folder with one row per shard: n, dim, entry, ids and the ends of each node's, vectors (double), edges.

    rows: vec_id, v. A shard holds vectors of one length. Every row is in the index, through its vector's node.
    """
    every = written(nodes(rows, k), "ann-nodes")
    n = max(1, -(-every.count() // shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}  # by the vectors' length

        def close(v: list, ids: list) -> pa.RecordBatch:
            x = np.array(v, dtype=float)
            g = Graph.build(x)
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int64)
            flat = np.array([i for some in ids for i in some], np.int64)
            values = [flat.tobytes(), ends.tobytes(), x.tobytes(), g.edges.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([x.shape[1]]), pa.array([g.entry]), *(pa.array([b], pa.binary()) for b in values)], ["n", "dim", "entry", "ids", "ends", "vectors", "edges"])

        for b in batches:
            for v, ids in zip(b.column("v").to_pylist(), b.column("ids").to_pylist(), strict=True):
                vs, iss = held.setdefault(len(v), ([], []))
                vs.append(v)
                iss.append(ids)
                if len(vs) >= 2 * shard:
                    held[len(v)] = vs[shard:], iss[shard:]
                    yield close(vs[:shard], iss[:shard])
        for vs, iss in held.values():
            if vs:
                yield close(vs, iss)

    dealt = every.repartition(n)  # evenly, by turns: a shard's size is a property of the index and not of the session's partitions
    return written(dealt.mapInArrow(run, "n long, dim long, entry long, ids binary, ends binary, vectors binary, edges binary"), "ann-index")


def _blocks(rows: DataFrame, size: int) -> str:
    """Where the queries are, in blocks of up to ``size`` of one length: a folder of Parquet files with dim, q_ids, q_vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.array([len(v) for v in b.column("v").to_pylist()])
            for dim in np.unique(lengths):
                some = b.take(pa.array(np.flatnonzero(lengths == dim)))
                for at in range(0, some.num_rows, size):
                    part = some.slice(at, size)
                    ids, x = np.array(part.column("vec_id").to_pylist(), np.int64), np.array(part.column("v").to_pylist(), dtype=float)
                    yield pa.RecordBatch.from_arrays([pa.array([int(dim)]), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["dim", "q_ids", "q_vectors"])

    n, path = max(1, -(-rows.count() // size)), shared_path(rows.sparkSession, "ann-queries")
    rows.repartition(n).mapInArrow(run, "dim long, q_ids binary, q_vectors binary").write.parquet(path)
    return path


def _read_blocks(path: str) -> Iterator[dict]:
    """The blocks of the folder, one at a time, from any store."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, at = file_system(path)
    for info in sorted(files.get_file_info(fs.FileSelector(at)), key=lambda f: f.path):
        if info.path.endswith(".parquet"):
            with files.open_input_file(info.path) as f:
                for b in pq.ParquetFile(f).iter_batches(batch_size=1):
                    yield b.to_pylist()[0]


class Shard:
    def __init__(self, row: dict):
        self.dim, self.ids, self.ends = row["dim"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64)
        self.x = scaled(np.frombuffer(row["vectors"]).reshape(row["n"], -1))
        self.norm = np.sqrt((self.x**2).sum(axis=1))
        self.graph = Graph(unit(self.x), np.frombuffer(row["edges"], np.int32).reshape(row["n"], -1), row["entry"])

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, vec_id, score): the k best other ids of each query, or all there are."""
        rows, _ = self.graph.search(unit(q), beam)
        q = scaled(q)
        score = np.full(rows.shape, -np.inf)
        for at in range(0, len(q), 64):
            x = self.x[rows[at : at + 64]]
            dots = (x * q[at : at + 64, None]).sum(axis=2)
            score[at : at + 64] = dots / (self.norm[rows[at : at + 64]] * np.sqrt((q[at : at + 64] ** 2).sum(axis=1))[:, None])
        query, column = np.nonzero(rows >= 0)
        row, score = rows[query, column], score[query, column]
        count = np.diff(self.ends)[row]
        query, score = np.repeat(query, count), np.repeat(score, count)
        vec = self.ids[np.repeat(self.ends[row], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        other = q_ids[query] != vec
        return _best(query[other], vec[other], score[other], k)


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    top = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[top], vec[top], score[top]


def nearest(df: DataFrame, *, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by ``every``, among all rows but itself.

    score is the cosine in double precision of the original vectors; ties go to the smaller id. Rows whose vector is null,
    empty, zero, or holds null or non-finite components take no part; vectors are compared with those of their own length;
    with fewer than k others all of them are returned. Ids that repeat are one row if their vectors agree; else the nearest
    of an id's vectors counts.
    """
    rows = usable(df, id_col, vector_col)
    index = build_index(rows, k, shard=shard)
    path = _blocks(rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]), QUERIES)

    def search(shards: list[Shard]) -> Iterator[pa.RecordBatch]:
        for block in _read_blocks(path):
            q_ids, q = np.frombuffer(block["q_ids"], np.int64), np.frombuffer(block["q_vectors"]).reshape(-1, block["dim"])
            found = [s.search(q_ids, q, k, max(beam, k + 1)) for s in shards if s.dim == block["dim"]]
            if found:
                query, vec, score = _best(*map(np.concatenate, zip(*found, strict=True)), k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[query]), pa.array(vec), pa.array(score)], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: list[Shard] = []
        for b, at in ((b, at) for b in batches for at in range(b.num_rows)):
            shards.append(Shard({c: b.column(c)[at].as_py() for c in b.schema.names}))
            if len(shards) == TOGETHER:
                yield from search(shards)
                shards = []
        if shards:
            yield from search(shards)

    # one row of a few MB for each shard, dealt by turns, about TOGETHER to a task
    found = one_task_each(index, together=TOGETHER).mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
