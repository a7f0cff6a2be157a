"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .components import connected
from .sampling import hash_bound

ROW = "cell string, point long, home boolean, copies long, vector array<double>"
_ROW = pa.schema([("cell", pa.string()), ("point", pa.int64()), ("home", pa.bool_()), ("copies", pa.int64()), ("vector", pa.list_(pa.float64()))])
_CENTRES = pa.schema([("cell", pa.string()), ("centres", pa.list_(pa.float64()))])
_EDGES = pa.schema([("point", pa.int64()), ("near", pa.list_(pa.int64()))])
_FOUND = pa.schema([("point", pa.int64()), ("others", pa.int64()), ("root", pa.int64())])


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; each is first brought near 1 by a power of two, so that squares of very large or small components neither overflow nor vanish."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(sample: np.ndarray, k: int, rounds: int = 4, apart: float = 0.8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows of the sample, which is in a fixed order.

    Of centroids that are closer than `apart` the first stays, so a crowd of like vectors is not torn over many cells; its one large cell is then split into blocks.
    """
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (sample @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    alike = c @ c.T >= apart
    kept: list[int] = []
    for i in range(len(c)):
        if not alike[i, kept].any():
            kept.append(i)
    return c[kept]


def robust_prune(x: np.ndarray, degree: int, candidates: int, alpha: float, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Directed edges (from, to): of a row's nearest candidates, one is kept unless a kept one is nearer to it, by a factor alpha, than the row is."""
    n, m = len(x), min(candidates, len(x) - 1)
    src, dst = [], []
    if m < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in range(0, n, block):
        rows = np.arange(i, min(n, i + block))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -np.inf
        cand = np.argpartition(-sims, m - 1, axis=1)[:, :m]
        cand = np.take_along_axis(cand, np.argsort(-np.take_along_axis(sims, cand, 1), axis=1, kind="stable"), 1)
        own = np.maximum(0, 1 - np.take_along_axis(sims, cand, 1))
        v = x[cand]
        between = np.maximum(0, 1 - v @ v.transpose(0, 2, 1))
        alive, count = np.ones(cand.shape, bool), np.zeros(len(rows), int)
        kept = np.zeros(cand.shape, bool)
        for j in range(m):
            take = alive[:, j] & (count < degree)
            kept[:, j] = take
            count += take
            alive &= ~(take[:, None] & (alpha * between[:, j] <= own))
        r, c = np.nonzero(kept)
        src.append(rows[r])
        dst.append(cand[r, c])
    return np.concatenate(src), np.concatenate(dst)


def far_edges(n: int, each: int) -> tuple[np.ndarray, np.ndarray]:
    """A few edges of each row to rows anywhere, the same whenever they are made, so that groups of like rows hang together."""
    rng = np.random.default_rng(n)
    return np.repeat(np.arange(n), each), (np.repeat(np.arange(n), each) + rng.integers(1, max(n, 2), n * each)) % n


def adjacency(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of each row's neighbours, neighbours) of the edges and their reverses."""
    both = np.unique(np.concatenate([src * n + dst, dst * n + src]))
    return np.searchsorted(both // n, np.arange(n + 1)), both % n


def range_search(x: np.ndarray, start: np.ndarray, near: np.ndarray, queries: np.ndarray, least: float, beam: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) pairs with a similarity of `least` or more that a greedy search finds, a block of queries at a time.

    Each query walks from the medoids of a few centroids: open rows among the `beam` most similar seen are expanded, the best few at a time; all rows
    in range are expanded too, at once, so the search spreads until no neighbour of what it found is in range.
    """
    medoids = np.unique((x @ centroids(x, min(16, len(x))).T).argmax(0))
    n, degree = len(x), np.diff(start)
    widest = int(degree.max(initial=1))
    padded = np.full((n, widest), -1)
    padded[np.repeat(np.arange(n), degree), np.arange(len(near)) - np.repeat(start[:-1], degree)] = near
    few, whole = min(4, n), None
    for i in range(0, len(queries), block):
        q = queries[i : i + block]
        sims = np.full((len(q), n), -np.inf, np.float32)
        open_ = np.zeros((len(q), n), bool)
        sims[:, medoids] = x[q] @ x[medoids].T
        open_[:, medoids] = True
        active = np.arange(len(q))
        while len(active):
            s = sims[active]
            waiting = np.where(open_[active], s, -np.inf)
            inside = waiting >= least
            # rows in range first; a query that has none goes on with its best open rows that are among the beam
            lost = np.flatnonzero(~inside.any(1))
            if len(lost):
                k = min(beam, n) - 1
                bar = np.partition(s[lost], n - 1 - k, axis=1)[:, n - 1 - k]
                best = np.argpartition(waiting[lost], n - few, axis=1)[:, n - few :]
                value = np.take_along_axis(waiting[lost], best, 1)
                row, col = np.nonzero(np.isfinite(value) & (value >= bar[:, None]))
                inside[lost[row], best[row, col]] = True
            a, at = np.nonzero(inside)
            if not len(a):
                break
            open_[active[a], at] = False
            if len(a) * widest <= 1 << 20:
                to = padded[at]
                row, col = np.nonzero(to >= 0)
                seen = np.zeros((len(active), n), bool)
                seen[a[row], to[row, col]] = True
            else:  # a wide front: neighbours of all its rows by one product
                if whole is None:
                    whole = np.zeros((n, n), np.float32)
                    whole[np.repeat(np.arange(n), degree), near] = 1
                seen = inside.astype(np.float32) @ whole > 0
            seen &= ~np.isfinite(s)
            b, c = np.nonzero(seen)
            for j in range(0, len(b), 1 << 16):
                p, r = active[b[j : j + (1 << 16)]], c[j : j + (1 << 16)]
                sims[p, r] = np.einsum("ij,ij->i", x[q[p]], x[r])
            open_[active[b], c] = True
            active = active[inside.any(1)]
        a, b = np.nonzero(sims >= least)
        yield q[a], b


class Groups:
    """Connected rows, joined a batch of links at a time; root[i] is the smallest row that i is connected with."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def valid(vector: Column) -> Column:
    """Whether a vector has components, all of them finite, not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _split(rows: DataFrame, big: DataFrame, level: int, shard_rows: int, overlap: int, fan: int, rows_a_task: int = 20_000) -> DataFrame:
    """Rows of the cells in `big` (cell, n), dealt to child cells of their nearest centroids: at home to `overlap` of them, other copies to one.

    Centroids come from a sample of 64 rows for each, of one cell in one task; a cell's rows are dealt in tasks of bounded size.
    """
    large = rows.join(big, "cell")
    share = F.lit(-(2.0**63)) + F.lit(64.0 * fan * 2.0**64) / F.col("n")
    picked = large.filter(F.col("home") & (F.xxhash64("point", F.lit(level)).cast("double") < share)).select("cell", "n", "point", "vector")

    def train(t: pa.Table) -> pa.Table:
        t = t.sort_by("point")
        x = unit(matrix(t.column("vector")))
        k = min(fan, len(x), -(-overlap * t.column("n")[0].as_py() // shard_rows))
        return pa.table([t.column("cell").slice(0, 1), pa.array([centroids(x, k).ravel()], pa.list_(pa.float64()))], schema=_CENTRES)

    centres = picked.groupBy("cell").applyInArrow(train, "cell string, centres array<double>")
    tasks = F.ceil(F.col("n") / rows_a_task).cast("int")
    centres = centres.join(big, "cell").select("cell", "centres", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("task"))
    given = large.select("cell", F.pmod(F.xxhash64("point", F.lit(3)), tasks).cast("int").alias("task"), "point", "home", "copies", "vector")

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _ROW.empty_table()
        x = matrix(left.column("vector"))
        # a cell of which no row is in the sample stays as it is
        c = np.array(right.column("centres")[0].as_py()).reshape(-1, x.shape[1]) if right.num_rows else np.zeros((1, x.shape[1]))
        near = np.argsort(-(unit(x) @ c.T), axis=1, kind="stable")[:, : min(overlap, len(c))]
        home = left.column("home").to_numpy()
        cell = left.column("cell")[0].as_py()
        parts = []
        for j in range(near.shape[1]):
            at = np.flatnonzero(home) if j else np.arange(len(home))
            t = left.take(pa.array(at)).select(["point", "copies", "vector"])
            names = pa.array([f"{cell}/{k}" for k in near[at, j]], pa.string())
            parts.append(pa.table([names, t.column("point"), pa.array(home[at] & (j == 0)), t.column("copies"), t.column("vector")], schema=_ROW))
        return pa.concat_tables(parts)

    return given.groupBy("cell", "task").cogroup(centres.groupBy("cell", "task")).applyInArrow(deal, ROW)


def _dealt(points: DataFrame, shard_rows: int, overlap: int, fan: int) -> DataFrame:
    """Rows (shard, part, inner, home, point, copies, vector): each point in overlapping cells of up to 2 * shard_rows rows, one of them its home, labels and dimensions apart.

    Cells are split level by level into at most `fan` children, so no point is compared with more than `fan` centroids a level. A cell that cannot be split, as a
    crowd of like vectors, becomes blocks, each with two of its hash parts, so any two of its rows still meet in one.
    """
    rows = checkpointed(points.select(F.concat_ws("/", F.md5("label"), F.size("vector").cast("string")).alias("cell"), "point", F.lit(True).alias("home"), "copies", "vector"))
    done: list[DataFrame] = []
    levels, level = 1, 0
    while True:
        sizes = checkpointed(rows.groupBy("cell").agg(F.count("*").alias("n")))
        big = sizes.filter(F.col("n") > 2 * shard_rows)
        most = big.agg(F.max("n")).first()[0]
        if level == 0 and most:
            levels = max(1, math.ceil(math.log(most / shard_rows) / math.log(max(2, fan / (2 * overlap)))))
        if not most or level == levels:
            done.append(rows)
            break
        done.append(rows.join(big.select("cell"), "cell", "left_anti"))
        rows = checkpointed(_split(rows, big, level, shard_rows, overlap, fan))
        level += 1
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    parts = whole.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.when(F.col("n") > 2 * shard_rows, F.ceil(F.col("n") * 2 / shard_rows)).otherwise(1).cast("int").alias("parts"))
    cut = whole.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("point", F.lit(23)), F.col("parts")).cast("int"))
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != F.col("part")))
    each = cut.select("*", F.explode(others).alias("partner"))
    low, high = F.least("part", "partner"), F.greatest("part", "partner")
    # pairs inside a part count in one of its blocks: with part 0, or for part 0 with part 1
    inner = (F.col("parts") == 1) | (F.col("partner") == F.when(F.col("part") == 0, 1).otherwise(0))
    return each.select(F.concat_ws("-", "cell", low.cast("string"), high.cast("string")).alias("shard"), "part", inner.alias("inner"), "home", "point", "copies", "vector")


def linked(points: DataFrame, least: float, shard_rows: int, overlap: int, fan: int, degree: int, candidates: int, alpha: float, beam: int) -> DataFrame:
    """(point, others, root) for each point and shard: how many vectors it links with whose pair counts here, and a point that it is connected with.

    A point is searched for in its home cell only, where the copies of those near it lie too. Pairs are found by the graph search and kept if their cosine, in doubles, is `least` or more; they do not leave the task.
    """
    rows = checkpointed(_dealt(points, shard_rows, overlap, fan))

    def build(t: pa.Table) -> pa.Table:
        ids = t.column("point").to_numpy()
        pruned, far = robust_prune(unit(matrix(t.column("vector"))).astype(np.float32), degree, candidates, alpha), far_edges(len(ids), 4)
        start, near = adjacency(*(np.concatenate(x) for x in zip(pruned, far, strict=True)), len(ids))
        return pa.table([pa.array(ids), pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(ids[near]))], schema=_EDGES)

    lists = rows.groupBy("shard").applyInArrow(build, "point long, near array<long>")
    graph = checkpointed(lists.groupBy("point").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))

    def search(t: pa.Table) -> pa.Table:
        t = t.sort_by("point")
        queries = np.flatnonzero(t.column("home").to_numpy())
        if not len(queries):
            return _FOUND.empty_table()
        ids, copies = t.column("point").to_numpy(), t.column("copies").to_numpy()
        sure = unit(matrix(t.column("vector")))
        x = sure.astype(np.float32)
        near = t.column("near").combine_chunks()
        src = np.repeat(np.arange(len(ids)), np.diff(near.offsets.to_numpy()))
        to = near.flatten().to_numpy()
        at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
        here = (ids[at] == to) & (at != src)
        start, flat = adjacency(src[here], at[here], len(ids))
        part, inner = t.column("part").to_numpy(), t.column("inner").to_numpy()
        others, groups = np.zeros(len(ids), np.int64), Groups(len(ids))
        for a, b in range_search(x, start, flat, queries, least - 1e-4, beam):
            keep = a != b
            a, b = a[keep], b[keep]
            ok = np.zeros(len(a), bool)
            for i in range(0, len(a), 1 << 15):
                k = slice(i, i + (1 << 15))
                ok[k] = np.einsum("ij,ij->i", sure[a[k]], sure[b[k]]) >= least
            a, b = a[ok], b[ok]
            groups.add(a, b)
            counts = (part[a] != part[b]) | inner[a]
            others += np.bincount(a[counts], weights=copies[b[counts]], minlength=len(ids)).astype(np.int64)
        return pa.table([pa.array(ids), pa.array(others), pa.array(ids[groups.root])], schema=_FOUND)

    return rows.join(graph, "point").groupBy("shard").applyInArrow(search, "point long, others long, root long")


def _points(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vector, key) of the rows that can link; labels as text, so that any kind of label is compared as it is."""
    v, label = F.col(vector_col), F.col(label_col)
    if vectors.schema[label_col].dataType.typeName() in ("float", "double"):
        label = label + F.lit(0.0)  # -0.0 is 0.0
    ok = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & valid(v))
    rows = ok.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("string").alias("label"), v.cast("array<double>").alias("vector"), F.col(label_col).alias("given"))
    return rows.withColumn("key", F.concat_ws(":", F.xxhash64("label", "vector").cast("string"), F.xxhash64(F.lit(3), "label", "vector").cast("string")))


def dedup(
    vectors: DataFrame, least: float = 0.93, shard_rows: int = 1500, overlap: int = 3, fan: int = 32, degree: int = 24, candidates: int = 64, alpha: float = 1.2, beam: int = 32,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, and its label.

    Only vectors of one non-null label are compared. Those that are null, empty or zero, or hold null or non-finite components, link with nothing.
    Equal vectors of a label are one point of the graph. Vectors with different numbers of components never link. Rows that are equal in id, label and vector count as one
    vector and are each returned; rows with one id and different vectors are vectors of their own. A row without an id links with nothing and has a null component; an empty table
    gives no rows; other columns are dropped. audit() measures the recall.
    """
    points = _points(vectors, id_col, vector_col, label_col)
    same = points.select("vec_id", "key").distinct().groupBy("key").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    # the checkpoint fixes the numbers of the points
    same = checkpointed(same.withColumn("point", F.monotonically_increasing_id()))
    heads = points.join(same.select("key", F.col("low").alias("vec_id"), "copies", "point"), ["key", "vec_id"]).dropDuplicates(["point"])
    found = checkpointed(linked(checkpointed(heads.select("point", "label", "copies", "vector")), least, shard_rows, overlap, fan, degree, candidates, alpha, beam))
    comp = connected(found.filter("point <> root").select(F.col("point").alias("a"), F.col("root").alias("b")))
    own = same.join(found.groupBy("point").agg(F.sum("others").alias("others")), "point", "left").join(comp.withColumnRenamed("id", "point"), "point", "left")
    own = own.withColumn("component", F.coalesce("component", "point"))
    first = own.groupBy("component").agg(F.min("low").alias("component_id"))
    result = own.join(first, "component").select("key", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    a = points.join(result, "key").select("vec_id", "n_links", "component_id", F.col("given").alias("label"))
    alone = vectors.filter(F.col(id_col).isNull() | F.col(label_col).isNull() | ~valid(F.col(vector_col)))
    vec_id = F.col(id_col).cast("long")
    b = alone.select(vec_id.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), vec_id.alias("component_id"), F.col(label_col).alias("label"))
    out = a.unionByName(b)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))).select("vec_id", "n_links", "component_id", "kept", "label")


def audit(vectors: DataFrame, result: DataFrame, least: float = 0.93, queries: int = 500, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Recall of dedup(): for about `queries` vectors chosen by hash, links that brute force finds against all rows, and links that the result counts."""
    points = checkpointed(_points(vectors, id_col, vector_col, label_col).select("vec_id", "label", "vector").dropDuplicates(["vec_id"]))
    n = points.count()
    asked = points.filter(F.xxhash64("vec_id", F.lit(41)) <= hash_bound(n, queries)).select("vec_id", "label", "vector").collect()
    schema = pa.schema([("vec_id", pa.int64()), ("true", pa.int64())])

    def count(batches):
        for batch in batches:
            labels, sizes = batch.column("label").to_numpy(zero_copy_only=False), np.diff(batch.column("vector").offsets.to_numpy())
            rows, got = batch.column("vector"), []
            for r in asked:
                at = np.flatnonzero((labels == r["label"]) & (sizes == len(r["vector"])))
                x = matrix(rows.take(pa.array(at))) if len(at) else np.zeros((0, len(r["vector"])))
                sims = (unit(x) if len(x) else x) @ unit(np.array([r["vector"]]))[0]
                got.append(int((sims >= least).sum() - ((batch.column("vec_id").to_numpy()[at] == r["vec_id"]) & (sims >= least)).sum()))
            yield pa.RecordBatch.from_arrays([pa.array([r["vec_id"] for r in asked], pa.int64()), pa.array(got, pa.int64())], schema=schema)

    true = points.mapInArrow(count, "vec_id long, true long").groupBy("vec_id").agg(F.sum("true").alias("true"))
    return true.join(result.select("vec_id", "n_links").dropDuplicates(["vec_id"]), "vec_id").agg(F.sum("true").alias("true_links"), F.sum("n_links").alias("found_links"))
