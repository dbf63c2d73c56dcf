"""Vector search over blocks: exact k nearest neighbours, whitening, hubness, label inference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.scalar import round_up
from marlstone.operators.joins import small_side
from marlstone.operators.ranks import number_rows


def _blocks(df: DataFrame, vec: str, rows: int, by: str = "__id") -> tuple[DataFrame, int]:
    """Rows ``__id, __mark`` and a vector packed into blocks of about so many rows, dealt by ``by`` and sorted by it.

    Gives ``block, ids, marks, packed``, all binary (int64; float64 of unit length, zero vectors stay zero).
    """
    n = max(1, -(-df.count() // rows))
    placed = df.select("__id", "__mark", F.pmod(F.xxhash64(by), F.lit(n)).cast("int").alias("block"), F.col(vec).cast("array<double>").alias("v"))
    order = ["__id", "__mark"] if by == "__id" else ["__mark", "__id"]
    grouped = placed.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(*order, "v"))).alias("rows"))
    at = order.index("__id"), order.index("__mark")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows_ = batch.column(1)[i].values
                ids, marks = (rows_.field(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in at)
                m = rows_.field(2).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
                unit = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], *[pa.array([x.tobytes()]) for x in (ids, marks, unit)]], ["block", "ids", "marks", "packed"])

    return grouped.mapInArrow(pack, "block int, ids binary, marks binary, packed binary"), n


CELL_ROWS = 32_768  # rows of one side of a meeting at most, about
QUERIES, STEP = 256, 4_096  # queries and corpus rows that are multiplied at once


def _meetings(queries: DataFrame, blocks: int, corpus: DataFrame, others: int, block_rows: int, k: int, scale: float, apart: bool, items: bool = False) -> DataFrame:
    """The ``k`` best of each query within each stripe of the corpus: ``query, neighbour, similarity``.

    Blocks of both sides are gathered into stripes, and each stripe of queries meets each stripe of the
    corpus in one group. A row is sent once per stripe of the other side, and k rows a query and
    stripe come back. Stripes hold up to about ``CELL_ROWS`` rows, less in small tables, which have
    8 x 8 groups if they have as many blocks.
    """
    per = [min(max(1, CELL_ROWS // block_rows), max(1, n // 8)) for n in (blocks, others)]
    stripes = [-(-n // p) for n, p in zip((blocks, others), per)]
    stripe = [F.floor(F.col("block") / p).cast("int") for p in per]
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in stripes]
    mine = queries.select(stripe[0].alias("i"), every[1].alias("j"), "ids", "marks", "packed")
    theirs = corpus.select(every[0].alias("i"), stripe[1].alias("j"), *[F.col(c).alias(f"o{c}") for c in ("ids", "marks", "packed")])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        found = [none]
        if left.num_rows and right.num_rows:
            oids, omarks, packed = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in right.column(c)]) for c, t in (("oids", np.int64), ("omarks", np.int64), ("opacked", np.float64)))
            order = np.lexsort((oids, omarks) if items else (omarks, oids))
            packed = packed.reshape(len(oids), -1)[order]
            side = oids[order], omarks[order], packed, packed.astype(np.float32)
            for ids, marks, m in zip(*(left.column(c) for c in ("ids", "marks", "packed"))):
                ids, marks = (np.frombuffer(x.as_buffer(), np.int64) for x in (ids, marks))
                m = np.frombuffer(m.as_buffer(), np.float64).reshape(len(ids), -1)
                for at in range(0, len(ids), QUERIES):
                    part = slice(at, at + QUERIES)
                    found.append(_block_top(ids[part], marks[part], m[part], *side, k, scale, apart, items))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], ["query", "neighbour", "similarity"])

    return mine.groupBy("i", "j").cogroup(theirs.groupBy("i", "j")).applyInArrow(run, "query long, neighbour long, similarity double")


def _hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a mask with few hits, which looks at eight places at once."""
    flat = mask.ravel()
    even = len(flat) // 8 * 8
    at = (np.flatnonzero(flat[:even].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.divmod(np.r_[at[flat[at]], even + np.flatnonzero(flat[even:])], mask.shape[1])


def _block_top(ids, marks, mine, oids, omarks, others, others32, k: int, scale: float, apart: bool, items: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best neighbours of a block of queries among corpus rows in ascending order of their id (of their mark, with ``items``).

    The corpus is walked in steps. A similarity that rounds to no more than a query's kth best so far
    cannot enter, as ties go to the lower id, so only the few above it are rounded and ranked. They are
    sought in single precision, less the most that its rounding can take from the product of two unit
    vectors, and then computed in double precision.
    """
    mine32, margin = mine.astype(np.float32), (mine.shape[1] + 8) * 6e-8
    row, value, other = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    least = np.full(len(ids), -np.inf)  # the kth best in units of the last decimal
    if items:
        first = np.flatnonzero(np.r_[True, omarks[1:] != omarks[:-1]])
        ends = np.r_[first[1:], len(omarks)]
    at, step = 0, max(512, 4 * k)  # a short first step; the next ones are as long as all before, up to STEP
    space = np.empty(len(ids) * STEP, np.float32), np.empty(len(ids) * STEP, bool)
    while at < len(others):
        to = min(len(others), at + step)
        if items:  # a step ends with an item
            to = int(ends[np.searchsorted(ends, to)])
        names, keys = (oids[at:to], omarks[at:to]) if not items else (None, None)
        bound, r = least, None
        if at and not items:
            rough, over = space[0][: len(ids) * (to - at)].reshape(len(ids), -1), space[1][: len(ids) * (to - at)].reshape(len(ids), -1)
            np.matmul(mine32, others32[at:to].T, out=rough)
            r, c = _hits(np.greater_equal(rough, ((least + 0.5) / scale - margin).astype(np.float32)[:, None], out=over))
            if len(r) > rough.size // 32:  # many ties: the full product is cheaper
                r = None
            else:
                sims = np.einsum("ij,ij->i", mine[r], others[at + c])
        if r is None:
            sims = mine @ others[at:to].T
            if items:
                mid = (first >= at) & (first < to)
                sims = np.maximum.reduceat(sims, first[mid] - at, axis=1)
                names = keys = omarks[first[mid]]
            if not at and sims.shape[1] > k:  # the kth best of the first step bounds the start, equals included
                valid = np.where(np.isnan(sims) | (marks[:, None] == keys[None, :]) if apart else np.isnan(sims), -np.inf, sims)
                bound = np.floor(np.partition(valid, -k, axis=1)[:, -k] * scale + 0.5) - 1
            # A little below the bound, for the rounding of the product; the exact comparison follows.
            r, c = _hits(sims >= ((bound + 0.5) / scale - 1e-9)[:, None])
            sims = sims[r, c]
        v = np.floor(sims * scale + 0.5)
        ok = np.isfinite(v) & (v > bound[r])
        if apart:
            ok &= marks[r] != keys[c]
        r, c, v = r[ok], c[ok], v[ok]
        if len(r):
            r, v, o = np.r_[row, r], np.r_[value, v], np.r_[other, names[c]]
            # The sort is stable: what was found before has the lower ids and stays ahead of equals.
            order = np.lexsort((-v, r))
            r, v, o = r[order], v[order], o[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            keep = place < k
            row, value, other = r[keep], v[keep], o[keep]
            full = place[keep] == k - 1
            least[row[full]] = value[full]
        at, step = to, min(STEP, to)
    return ids[row], other, value / scale


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def knn_edges(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding", same: bool = False, decimals: int = 6, block_rows: int = 1024, apart: str | None = None) -> DataFrame:
    """The ``k`` most similar corpus rows of each query by cosine: ``query, neighbour, similarity, rank``.

    Stripes of queries meet stripes of the corpus as matrices; each meeting keeps its ``k`` best per
    query, so what is shuffled is k rows a query and corpus stripe, never all pairs. Similarities
    are rounded half up before ranking and ties go to the lower id. With ``same`` a row is not its
    own neighbour; with ``apart`` rows of one value of that column (an artist, a fold) are no
    neighbours, a null keeps only the row itself away. Ids must be longs; vectors of one length.
    """
    mark = F.when(F.col(apart).isNull(), F.col(id_col)).otherwise(F.xxhash64(apart)) if apart else F.col(id_col)
    q, nq = _blocks(queries.select(F.col(id_col).alias("__id"), mark.alias("__mark"), vec), vec, block_rows)
    c, nc = _blocks(corpus.select(F.col(id_col).alias("__id"), mark.alias("__mark"), vec), vec, block_rows)
    return _ranked(_meetings(q, nq, c, nc, block_rows, k, 10.0**decimals, same or apart is not None), k)


def knn_items(vectors: DataFrame, k: int, item: str, id_col: str = "vec_id", vec: str = "embedding", decimals: int = 6, block_rows: int = 1024) -> DataFrame:
    """The ``k`` other items most similar to each vector: ``query`` (a vector), ``neighbour`` (an item), ``similarity, rank``.

    An item is as similar to a vector as its most similar vector. All vectors of an item lie in one
    block, so each meeting of blocks brings its pairs down to items before it keeps the k best.
    Vectors of zero length are nobody's. Ids and items must be longs; items have bounded vectors.
    """
    real = vectors.filter(F.exists(vec, lambda x: x != 0)).select(F.col(id_col).alias("__id"), F.col(item).alias("__mark"), vec)
    packed, n = _blocks(real, vec, block_rows, "__mark")
    return _ranked(_meetings(packed, n, packed, n, block_rows, k, 10.0**decimals, True, True), k)


def best_vote(edges: DataFrame, vectors: DataFrame, labels: DataFrame, item: str, id_col: str, label: str) -> DataFrame:
    """``item, own, predicted, agreement, correct``: the majority among the neighbours of the vector that agrees best.

    ``edges`` as :func:`knn_items` gives them, ``labels`` a row per item. Votes that tie go to the label
    met first by rank; vectors that agree alike to the lower one. An item without a vector or a
    neighbour has no prediction, which is not correct.
    """
    named = edges.join(labels.select(F.col(item).alias("neighbour"), F.col(label).alias("__l")), "neighbour")
    counts = named.groupBy("query", "__l").agg(F.count("*").alias("n"), F.min("rank").alias("r"))
    per = counts.groupBy("query").agg(F.max(F.struct("n", (-F.col("r")).alias("r"), F.col("__l").alias("l"))).alias("w"), F.sum("n").alias("t"))
    owned = per.join(vectors.select(F.col(id_col).alias("query"), item), "query")
    best = owned.groupBy(item).agg(F.max(F.struct((F.col("w.n") / F.col("t")).alias("a"), (-F.col("query")).alias("q"), F.col("w.l").alias("l"))).alias("b"))
    out = labels.select(item, F.col(label).alias("own")).join(best, item, "left")
    return out.select(item, "own", F.col("b.l").alias("predicted"), F.coalesce("b.a", F.lit(0.0)).alias("agreement"), F.coalesce(F.col("b.l") == F.col("own"), F.lit(False)).alias("correct"))


def group_fold(group: Column, folds: int) -> Column:
    """A fold from 0 on for every value of a group, by its digest: a group is never on both sides, and no list of groups is needed."""
    return (F.conv(F.substring(F.md5(group.cast("string")), 1, 8), 16, 10).cast("long") % folds).cast("int")


def balanced_vote(edges: DataFrame, labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """``query, predicted``: each neighbour votes by the rarity of its class over its distance; ties by label.

    A class weighs all rows / (classes * its rows), a distance is 1 - similarity and 1e-10 at least.
    """
    rows = labels.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("__l")).agg(F.count("*").alias("n"))
    total = Window.partitionBy()
    weights = rows.select("__l", (F.sum("n").over(total) / (F.count("*").over(total) * F.col("n"))).alias("w"))
    named = edges.join(labels.select(F.col(id_col).alias("neighbour"), F.col(label).alias("__l")), "neighbour").join(small_side(weights, 100_000), "__l")
    votes = named.groupBy("query", "__l").agg(F.sum(F.col("w") / F.greatest(1 - F.col("similarity"), F.lit(1e-10))).alias("v"))
    # The same votes in another order of summing differ in their last digits: compare seven.
    scaled = F.floor(F.col("v") * 1e7 + 0.5)
    return votes.groupBy("query").agg(F.min(F.struct((-scaled).alias("v"), F.col("__l").alias("l")))["l"].alias("predicted"))


def fold_centroids(df: DataFrame, vec: str, fold: str, label: str, scale: bool = True) -> DataFrame:
    """``fold, label, mean, spread`` for each fold: the class means of the rows outside it, and how its dimensions spread there.

    Nothing of a fold's own rows goes into what judges them: sums of all rows less its own. With
    ``scale`` the spread is the standard deviation (1 where a dimension stands still), else 1.
    Everything is sums per (fold, label, dimension), pre-aggregated in each task.
    """
    wide = df.select(fold, label, F.posexplode(F.col(vec).cast("array<double>")).alias("d", "x"))
    sums = wide.groupBy(fold, label, "d").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    # Folds that lack a class still need its mean: every fold meets every class that occurs.
    whole = sums.groupBy(label, "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    folds = F.array_sort(F.collect_set(fold))
    every = whole.join(sums.groupBy("d").agg(folds.alias("f")), "d").select(F.explode("f").alias(fold), label, "d", "n", "s", "q")
    own = sums.select(fold, label, "d", F.col("n").alias("on"), F.col("s").alias("os"), F.col("q").alias("oq"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    rest = every.join(own, [fold, label, "d"], "left").select(fold, label, "d", (F.col("n") - zero("on")).alias("n"), (F.col("s") - zero("os")).alias("s"), (F.col("q") - zero("oq")).alias("q"))
    dim = Window.partitionBy(fold, "d")
    n, mean = F.sum("n").over(dim), F.sum("s").over(dim) / F.sum("n").over(dim)
    var = F.greatest(F.lit(0.0), F.sum("q").over(dim) / n - mean * mean)
    spread = F.when(var > 1e-12, F.sqrt(var)).otherwise(1.0) if scale else F.lit(1.0)
    placed = rest.withColumn("spread", spread).filter("n > 0").select(fold, label, "d", (F.col("s") / F.col("n")).alias("mean"), "spread")
    return placed.groupBy(fold, label).agg(F.array_sort(F.collect_list(F.struct("d", "mean", "spread"))).alias("c")).select(fold, label, F.transform("c", lambda x: x["mean"]).alias("mean"), F.transform("c", lambda x: x["spread"]).alias("spread"))


def nearest_centroid_cv(df: DataFrame, id_col: str, vec: str, group: str, label: str, folds: int = 5, scale: bool = True) -> DataFrame:
    """``id, fold, own, predicted`` of rows with a label, each judged by the class means of the other folds.

    Folds never share a group (:func:`group_fold`). Distances are in units of each dimension's spread
    outside the fold; ties go by label.
    """
    rows = df.filter(F.col(label).isNotNull()).select(F.col(id_col).alias("id"), group_fold(F.col(group), folds).alias("fold"), F.col(label).alias("own"), F.col(vec).cast("array<double>").alias("v"))
    means = fold_centroids(rows, "v", "fold", "own", scale).withColumnRenamed("own", "l")
    # A row per fold and class.
    met = rows.join(small_side(means, 100_000), "fold")
    parts = F.zip_with(F.zip_with("v", "mean", lambda a, b: a - b), "spread", lambda d, s: d / s * (d / s))
    distance = F.floor(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) * 1e6 + 0.5)
    return met.groupBy("id", "fold", "own").agg(F.min(F.struct(distance.alias("d"), F.col("l")))["l"].alias("predicted"))


def band_similarity(df: DataFrame, id_col: str, vec: str, group: str, reach: int = 9, inter: int = 10) -> DataFrame:
    """One row ``intra, intra_pairs, inter, inter_pairs, coherence``: the mean cosine of near members of a group against that across groups.

    Within a group the members i and j (by id) with j - i from 1 to ``reach`` count, so pairs grow in
    proportion to the rows; across two groups the first ``inter`` members of each, i with i. Nulls
    of any column and vectors of zero length are left out.
    """
    rows = df.filter(F.col(group).isNotNull() & F.exists(vec, lambda x: x != 0)).select(F.col(id_col).alias("id"), F.col(group).alias("g"), F.col(vec).cast("array<double>").alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("v", F.transform("v", lambda x: x / F.sqrt(dot(F.col("v"), F.col("v")))))
    placed = number_rows(rows, [F.col("id")], "i", ["g"])
    # Cells of ``reach`` members: a later one at most ``reach`` on lies in the same cell or the next.
    cell = F.floor(F.col("i") / reach)
    later = placed.select("g", F.col("i").alias("j"), F.col("v").alias("w"), F.explode(F.array(cell, cell - 1)).alias("cell"))
    near = placed.withColumn("cell", cell).join(later, ["g", "cell"]).filter((F.col("j") - F.col("i")).between(1, reach)).select("v", "w")
    heads = placed.filter(F.col("i") <= inter)
    a, b = heads.select("i", F.col("g").alias("a"), "v"), heads.select("i", F.col("g").alias("b"), F.col("v").alias("w"))
    across = a.join(b, "i").filter("a < b").select("v", "w")
    mean = lambda x, name: x.agg(F.avg(dot(F.col("v"), F.col("w"))).alias(name), F.count("*").alias(f"{name}_pairs"))
    return mean(near, "intra").join(mean(across, "inter")).withColumn("coherence", F.coalesce(F.col("intra") - F.col("inter"), F.lit(0.0)))


def vote(edges: DataFrame, labels: DataFrame, id_col: str, label: str, least: float = 0.6) -> DataFrame:
    """Majority label of each query's neighbours: ``query, predicted, second, agreement, refused``; ties by label."""
    named = edges.join(labels.select(F.col(id_col).alias("neighbour"), F.col(label).alias("__l")), "neighbour")
    counts = named.groupBy("query", "__l").agg(F.count("*").alias("__n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("__n")).alias("n"), F.col("__l").alias("l"))))
    out = counts.groupBy("query").agg(ranked.alias("r"), F.sum("__n").alias("t"))
    return out.select("query", F.col("r")[0]["l"].alias("predicted"), F.get("r", 1)["l"].alias("second"), (-F.col("r")[0]["n"] / F.col("t")).alias("agreement")).withColumn("refused", F.col("agreement") < least)


def weighted_vote(edges: DataFrame, labels: DataFrame, id_col: str, label: str, floor: float = 0.7, least: int = 3, agreement: float = 0.5) -> DataFrame:
    """The label with the most similarity among neighbours over ``floor``; needs ``least`` of them and half their count."""
    named = edges.filter(F.col("similarity") >= floor).join(labels.select(F.col(id_col).alias("neighbour"), F.col(label).alias("__l")), "neighbour")
    sums = named.groupBy("query", "__l").agg(F.sum("similarity").alias("w"), F.count("*").alias("n"))
    w = Window.partitionBy("query")
    ranked = sums.withColumns({"total": F.sum("n").over(w), "r": F.row_number().over(w.orderBy(F.desc("w"), "__l"))})
    out = ranked.groupBy("query").agg(F.max(F.when(F.col("r") == 1, F.col("__l"))).alias("winner"), F.max(F.when(F.col("r") == 2, F.col("__l"))).alias("second"), F.max(F.when(F.col("r") == 1, F.col("n") / F.col("total"))).alias("share"), F.max("total").alias("total"))
    return out.filter((F.col("total") >= least) & (F.col("share") >= agreement)).select("query", "winner", "second", F.col("total").cast("long").alias("neighbours"))


def principal_directions(df: DataFrame, vec: str, components: int, iterations: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Mean and top principal directions by power iteration with deflation, from one distributed pass.

    The d x d scatter matrix is summed per task and its rows then added up in a few tasks, each
    holding its share of the rows only; the driver gets d + 1 rows, however many tasks there were.
    Iteration starts at the first axis and stops when the direction stands still. An empty table
    has no mean and no directions.
    """

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cross, n = None, None, 0
        for b in batches:
            m = np.array(b.column(0).to_pylist(), np.float64)
            if not len(m):
                continue
            total = m.sum(axis=0) if total is None else total + m.sum(axis=0)
            cross = m.T @ m if cross is None else cross + m.T @ m
            n += len(m)
        for i, row in enumerate([total, *cross] if n else ()):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([n]), pa.array([row.tolist()])], ["i", "n", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for i, n, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                have = sums.setdefault(i, [0, 0.0])
                have[0] += n
                have[1] = have[1] + row.values.to_numpy()
        for i, (n, row) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([n]), pa.array([row.tolist()])], ["i", "n", "row"])

    kind = "i int, n long, row array<double>"
    parts = df.select(F.col(vec).cast("array<double>").alias("v")).mapInArrow(scatter, kind).repartition(32, "i").mapInArrow(add, kind).collect()
    if not parts:
        return np.zeros(0), np.zeros((0, 0))
    rows = np.array([p["row"] for p in sorted(parts, key=lambda p: p["i"])])
    n, mean = parts[0]["n"], rows[0] / parts[0]["n"]
    d = mean.size
    cov = rows[1:] - n * np.outer(mean, mean)
    found = []
    for _ in range(components):
        v = np.eye(d)[0]
        for _ in range(iterations):
            new = cov @ v
            norm = np.linalg.norm(new)
            if norm == 0:
                break
            new /= norm
            done = abs(new @ v) > 1 - 1e-6
            v = new
            if done:
                break
        found.append(v)
        cov = cov - (v @ cov @ v) * np.outer(v, v)
    return mean, np.array(found)


def whiten(df: DataFrame, vec: str, mean: np.ndarray, directions: np.ndarray) -> DataFrame:
    """Vectors without the mean and the leading directions (all but the top)."""

    @F.pandas_udf("array<double>")
    def apply(x: pd.Series) -> pd.Series:
        m = np.array(x.tolist(), np.float64) - mean
        return pd.Series((m - m @ directions.T @ directions).tolist())

    return df.withColumn(vec, apply(F.col(vec).cast("array<double>")))


def csls(edges: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """Re-rank by ``2 * cosine - r(query) - r(neighbour)``, r being the mean similarity to reference neighbours.

    ``reference``: edges of every row to the neighbours that r is the mean of.
    """
    r = reference.groupBy("query").agg(F.avg("similarity").alias("r"))
    scored = edges.join(r, "query").withColumnRenamed("r", "rq").join(r.withColumnsRenamed({"query": "neighbour", "r": "rc"}), "neighbour")
    scored = scored.select("query", "neighbour", round_up(2 * F.col("similarity") - F.col("rq") - F.col("rc"), 4).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "neighbour"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def labelled_pair_means(df: DataFrame, id_col: str, vec: str, label: str) -> DataFrame:
    """For each row and label the mean cosine to the other rows of that label: ``query, own, label, mean, n``.

    The mean of unit vectors' products is the product with their sum, so no pair is formed.
    """
    d = F.col(vec).cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    unit = df.select(F.col(id_col).alias("query"), F.col(label).alias("own"), F.transform(d, lambda x: x / norm).alias("u"))
    parts = unit.select("own", F.posexplode("u").alias("i", "x")).groupBy("own", "i").agg(F.sum("x").alias("s"))
    sums = parts.groupBy("own").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("a")).select(F.col("own").alias("label"), F.transform("a", lambda x: x["s"]).alias("sum"))
    sums = sums.join(unit.groupBy(F.col("own").alias("label")).agg(F.count("*").alias("m")), "label")
    met = unit.crossJoin(small_side(sums, 1_000))  # one row per label
    total = F.aggregate(F.zip_with("u", "sum", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    mine = F.col("own") == F.col("label")
    n = F.col("m") - mine.cast("long")
    return met.select("query", "own", "label", n.alias("n"), F.when(n > 0, (total - mine.cast("double")) / n).alias("mean"))


def silhouette(means: DataFrame) -> DataFrame:
    """Mean silhouette on cosine distance from :func:`labelled_pair_means`."""
    a = F.max(F.when(F.col("own") == F.col("label"), 1 - F.col("mean")))
    b = F.min(F.when(F.col("own") != F.col("label"), 1 - F.col("mean")))
    per = means.groupBy("query").agg(a.alias("a"), b.alias("b")).filter("a is not null and b is not null")
    return per.agg(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"), F.count("*").alias("n"))


def folds(df: DataFrame, label: str, order: str, k: int, name: str = "fold") -> DataFrame:
    """Stratified folds: rows of a label by id, dealt in turn."""
    return df.withColumn(name, ((F.row_number().over(Window.partitionBy(label).orderBy(order)) - 1) % k).cast("int"))


def bounded(column: Column, least: int, most: int) -> Column:
    return F.least(F.greatest(column, F.lit(least)), F.lit(most))


def best_of(queries: DataFrame, seeds: DataFrame, k: int, id_col: str, place: str, label: str, least: float = 0.6, vec: str = "embedding", places: int = 64) -> DataFrame:
    """``query, predicted, agreement, place, refused``: of an item's vectors the one whose neighbours agree most, the earliest among equals.

    ``queries`` has a row per item and place (0 to ``places`` - 1: the whole, then its sections).
    """
    one = queries.withColumn("__q", F.col(id_col) * places + F.col(place))
    edges = knn_edges(one.drop(id_col).withColumnRenamed("__q", id_col), seeds, k, id_col, vec)
    votes = vote(edges, seeds, id_col, label, least).select(F.floor(F.col("query") / places).alias("query"), F.pmod("query", F.lit(places)).alias("place"), "predicted", "agreement", "refused")
    best = votes.groupBy("query").agg(F.min(F.struct((-F.col("agreement")).alias("a"), "place", "predicted", "refused")).alias("b"))
    return best.select("query", "b.predicted", (-F.col("b.a")).alias("agreement"), "b.place", "b.refused")


def disputes(rows: DataFrame, k: int, id_col: str, label: str, flag: str, at: str, now: Column, least: float = 0.6, vec: str = "embedding") -> DataFrame:
    """Every disputed row with the consensus of its neighbours among the undisputed: ``query, label, consensus, agreement, agrees, age_days``.

    Without a vector or enough agreement the consensus is null; ``age_days`` is null without a vector's time.
    """
    flagged = F.col(flag).eqNullSafe("disputed")
    seeds = rows.filter(~flagged & F.col(label).isNotNull() & F.col(vec).isNotNull())
    asked = rows.filter(flagged)
    voted = vote(knn_edges(asked.filter(F.col(vec).isNotNull()), seeds, k, id_col, vec), seeds, id_col, label, least).filter(~F.col("refused"))
    age = F.round((now.cast("timestamp").cast("double") - F.col(at).cast("timestamp").cast("double")) / 86400).cast("long")
    out = asked.select(F.col(id_col).alias("query"), F.col(label).alias("label"), age.alias("age_days")).join(voted.select("query", F.col("predicted").alias("consensus"), "agreement"), "query", "left")
    return out.withColumn("agrees", F.coalesce(F.col("label") == F.col("consensus"), F.lit(False)))
