"""Operator 7: MinHash near-duplicates with odd sketches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import map_rows
from marlstone.llm.shingles import mix, shingle_set
from marlstone.operators.graph import connected_components
from marlstone.operators.joins import join_by_size
from marlstone.session import materialise, release


@dataclass(frozen=True)
class Params:
    """``words`` per shingle; links have ``100 * intersection >= percent * union``.

    24 bands of 4 samples miss a pair at similarity 0.8 with a chance of 3e-6. The sketch has 256
    bits over all 96 samples; a pair is verified if it differs in at most ``max_bits`` of them
    (estimated similarity 0.5). Of 400,000 simulated pairs each at similarity 0.80 and 0.82, with
    the sketch's collisions, none differed in more.
    """

    words: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 4
    star_rounds: int = 2

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def max_bits(self) -> int:
        low = max(0.0, self.percent / 100 - 0.3)
        return int(128 * (1 - np.exp(-2 * self.samples * (1 - low) / 128)))


def _samples(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(a.size, 2**64 - 1, np.uint64)
    for i in range(0, hashes.size, 1024):
        low = np.minimum(low, (hashes[i : i + 1024, None] * a + b).min(axis=0))
    return low


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """256 parities: each (position, sample) flips one bit, so a XOR keeps only the differing samples."""
    at = mix(samples + np.arange(samples.size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=256) & 1).astype(np.uint8)).view(np.int64)


def signatures(df: DataFrame, id_col: str, text_col: str, p: Params) -> DataFrame:
    """``doc_id, text_hash, n_shingles, node, bands, odd``; node (digest of the set) is null for an empty set."""
    import xxhash

    rng = np.random.default_rng(7)
    a = rng.integers(0, 2**63, p.samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, p.samples, dtype=np.uint64)
    label = np.arange(p.bands, dtype=np.uint64)[:, None]

    def run(ids: list, hashes: list, texts: list) -> list:
        sizes, nodes, bands, odds = [], [], [], []
        for text in texts:
            found = shingle_set(text, p.words)
            sizes.append(found.size)
            if not found.size:
                nodes.append(None), bands.append(None), odds.append(None)
                continue
            low = _samples(found, a, b)
            keys = low.reshape(p.bands, p.rows)
            key = mix(label[:, 0] + np.uint64(1))
            for i in range(p.rows):
                key = mix(key ^ keys[:, i])
            nodes.append(xxhash.xxh3_128_digest(found.tobytes()))
            bands.append(key.view(np.int64))
            odds.append(odd_sketch(low))
        return [ids, hashes, sizes, nodes, pa.array(bands, pa.list_(pa.int64())), pa.array(odds, pa.list_(pa.int64()))]

    source = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(source, ["doc_id", "text_hash", "text"], run, f"doc_id {kind}, text_hash long, n_shingles long, node binary, bands array<long>, odd array<long>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    def run(nodes: list, values: list) -> list:
        return [nodes, pa.array([shingle_set(t, words).view(np.int64) for t in values], pa.list_(pa.int64()))]

    return map_rows(texts, ["node", "text"], run, "node binary, shingles array<long>")


def _alike(x: Column, y: Column, p: Params) -> Column:
    """What a candidate pair must pass before its sets are read: sketches that agree, and sizes that can."""
    differ = sum((F.bit_count(x["odd"][i].bitwiseXOR(y["odd"][i])) for i in range(4)), F.lit(0))
    return (100 * F.least(x["n"], y["n"]) >= p.percent * F.greatest(x["n"], y["n"])) & (differ <= p.max_bits)


def _linked(both: Column, n_a: Column, n_b: Column, p: Params) -> Column:
    return 100 * both >= p.percent * (n_a + n_b - both)


def _with_sets(pairs: DataFrame, sets: DataFrame, end: str, other: str, name: str, share: int = 1000) -> DataFrame:
    """``pairs`` with the shingles of the node in ``end``. A node in many pairs, such as a leader, is split over tasks."""
    counts = pairs.groupBy(F.col(end).alias("node")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(counts.filter(F.col("n") > max(share, total // 100_000)).select("node", F.ceil(F.col("n") / share).cast("int").alias("parts")))
    salted = pairs.join(heavy.withColumnRenamed("node", end), end, "left").withColumn("salt", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(other), F.col("parts"))).otherwise(0).cast("int")).drop("parts")
    spread = sets.join(heavy, "node", "left").select(F.col("node").alias(end), F.col("shingles").alias(name), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
    return salted.join(spread, [end, "salt"]).drop("salt")


def _verified(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """Candidate pairs with the verdict on their full sets."""
    pairs = materialise(pairs)
    with_sets = _with_sets(_with_sets(pairs, sets, "a", "b", "sa"), sets, "b", "a", "sb")
    judged = materialise(with_sets.select("a", "b", "root_a", "root_b", _linked(F.size(F.array_intersect("sa", "sb")), F.col("n_a"), F.col("n_b"), p).alias("linked")))
    release(pairs)
    return judged


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``df``.

    Rows with equal shingle sets form a class and go on as one. Classes that share a band's
    bucket are candidates: each member is compared with a leader of its bucket, the one with the
    most links so far, for ``star_rounds`` rounds; members of buckets that still hold several
    components are compared across components only, where they share a rare shingle.
    So no group emits all its pairs, and no link between components is lost.
    Candidates pass the odd sketch and a size bound, then full sets are intersected.

    ``component_id`` is the least id reachable. An empty or null text is linked with nothing. A row
    with a null id keeps n_shingles, has a null component and is kept; it links no others.
    Repeated rows share their component; ``kept`` holds for each of them if it holds for the id.
    A very long text costs its worker about 40 times its size. An empty table gives no rows.
    """
    return _judged(df, id_col, text_col, params or Params()).drop("text_hash")


def _judged(df: DataFrame, id_col: str, text_col: str, p: Params) -> DataFrame:
    sig = materialise(signatures(df, id_col, text_col, p))
    ok = sig.filter("node is not null and doc_id is not null")
    nodes = materialise(ok.groupBy("node").agg(F.min("doc_id").alias("doc"), F.min(F.struct("doc_id", "text_hash"))["text_hash"].alias("text_hash"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("odd").alias("odd"), F.count("*").alias("copies")))
    texts = df.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    roots = materialise(nodes.select("node", "doc", "copies").join(_roots(nodes, texts, p), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "doc", "copies"))
    least = materialise(roots.groupBy("root").agg(F.min("doc").alias("component_id"), F.count("*").alias("n")))
    of_node = materialise(join_by_size(roots, least, ["root"]).select("node", "component_id", "copies"))
    release(nodes, roots, least)
    # Rows without an id or words have no partners, and no key to be joined by.
    alone = sig.filter("node is null or doc_id is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    out = join_by_size(ok.select("doc_id", "text_hash", "n_shingles", "node"), of_node, ["node"], "copies").select("doc_id", "text_hash", "n_shingles", "component_id").unionByName(alone)
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _cross_links(members: DataFrame, sets: DataFrame, p: Params, share: int = 1000) -> DataFrame:
    """Links (root_a, root_b) between ``members(node, root, n, odd)`` that lie in different components.

    A prefix-filtered join: shingles are ordered by how many of these documents have them, those
    of a single component first. Two linked sets have one in common among the first
    ``n - need + 1`` of each, ``need`` being the least intersection that a set of n allows. So
    documents meet on rare shingles only, and one with too many of its own meets nobody. Where a
    shingle falls in both orders bounds the intersection; sizes and odd sketches are compared next,
    and full sets last, once for each pair. A shingle with over ``share`` documents is split over tasks.
    """
    live = materialise(sets.join(members.groupBy("node").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.first("odd").alias("odd")), "node"))
    tokens = live.select("node", "root", F.explode("shingles").alias("s"))
    across = materialise(tokens.groupBy("s").agg(F.count("*").alias("c"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("s", "c", F.col("c").alias("rank")))
    shared = join_by_size(tokens.select("node", "s"), across, ["s"], "c").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rank", "s"))).alias("order"))
    need = F.ceil(F.lit(p.percent) * F.col("n") / 100).cast("int")
    before = F.col("n") - F.size("order")
    firsts = live.select("node", "root", "n", "odd").join(shared, "node").withColumn("left", F.col("n") - need + 1 - before).filter("left > 0")
    placed = firsts.select("node", "root", "n", "odd", before.alias("before"), F.posexplode(F.slice("order", F.lit(1), F.col("left"))).alias("i", "x"))
    placed = materialise(placed.select("x.s", "x.rank", "node", "root", "n", "odd", (F.col("n") - F.col("before") - F.col("i")).alias("rest")))
    parts = F.ceil(F.col("rank") / share).cast("int")
    one = F.struct("node", "root", "n", "odd", "rest")
    left = placed.select("s", F.pmod(F.xxhash64("node"), parts).cast("int").alias("salt"), one.alias("x"))
    right = placed.select("s", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), one.alias("y"))
    x, y = F.col("x"), F.col("y")
    pairs = left.join(right, ["s", "salt"]).filter((x["node"] < y["node"]) & (x["root"] != y["root"]))
    pairs = pairs.filter(_linked(F.least(x["rest"], y["rest"]), x["n"], y["n"], p)).filter(_alike(x, y, p))
    found = _verified(pairs.select(*[v[f].alias(g) for v, t in ((x, "a"), (y, "b")) for f, g in (("node", t), ("root", f"root_{t}"), ("n", f"n_{t}"))]).distinct(), sets, p)
    release(live, across, placed)
    return found.filter("linked")


def _roots(nodes: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """``node, root`` of the classes that share a bucket with another."""
    spread = nodes.select("node", F.explode("bands").alias("key"))
    shared = materialise(spread.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    members = materialise(spread.join(shared, "key", "left_semi"))
    state = materialise(nodes.select("node", "doc", "text_hash", F.col("n_shingles").alias("n"), "odd").join(members.select("node").distinct(), "node", "left_semi").withColumns({"root": F.col("node"), "degree": F.lit(0)}))
    wanted = texts.join(state.select("node", "doc", "text_hash"), ["doc", "text_hash"]).select("node", "text")
    sets = materialise(_sets(wanted, p.words).dropDuplicates(["node"]))
    step, failed = 0, None
    while True:
        last = step >= p.star_rounds
        placed = members.join(state, "node").select("key", "node", "doc", "root", "odd", "n", "degree")
        top = F.min(F.struct((-F.col("degree")).alias("fewer"), "doc", "node", "root", "odd", "n"))
        mixed = materialise(placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("size"), top.alias("leader")).filter("r0 <> r1").select("key", "leader", "size"))
        if mixed.isEmpty():
            return state.select("node", "root")
        met = join_by_size(placed, mixed, ["key"], "size")
        if last:
            fresh = _cross_links(met.select("node", "root", "n", "odd"), sets, p)
        else:
            pairs = met.filter("root <> leader.root").select(F.struct("node", "root", "odd", "n").alias("u"), F.struct("leader.node", "leader.root", "leader.odd", "leader.n").alias("v"))
            pairs = pairs.filter(_alike(F.col("u"), F.col("v"), p))
            swap = F.col("u.node") > F.col("v.node")
            pairs = pairs.select(F.when(swap, F.col("v")).otherwise(F.col("u")).alias("x"), F.when(swap, F.col("u")).otherwise(F.col("v")).alias("y"))
            pairs = pairs.select(*[F.col(f"{c}.{f}").alias(g) for c, s in (("x", "a"), ("y", "b")) for f, g in (("node", s), ("root", f"root_{s}"), ("n", f"n_{s}"))]).distinct()
            if failed is not None:
                pairs = pairs.join(failed, ["a", "b"], "left_anti")
            fresh = _verified(pairs, sets, p)
        # Components of components: only links found in this round, between the roots so far.
        joined = connected_components(fresh.filter("linked").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("new_root"))
        moved = materialise(state.groupBy("root").agg(F.count("*").alias("size")).join(joined, "root", "left").select("root", "size", F.coalesce("new_root", "root").alias("new_root")))
        state = join_by_size(state, moved, ["root"], "size").drop("root").withColumnRenamed("new_root", "root")
        if last:
            return state.select("node", "root")
        if joined.isEmpty():
            step = p.star_rounds
        else:
            step += 1
            more = fresh.filter("linked").select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").cast("int").alias("more"))
            state = materialise(state.join(more, "node", "left").withColumn("degree", F.col("degree") + F.coalesce("more", F.lit(0))).drop("more"))
        no = fresh.filter("not linked").select("a", "b")
        failed = no if failed is None else failed.unionByName(no)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params | None = None) -> DataFrame:
    """The rows of ``df`` with one document of each component: the one with the least id.

    A row goes by its id and text, so another row of the same id stays if its text is no copy.
    Rows with a null id, and those without words, stay; so do repeated rows of the document kept.
    """
    gone = _judged(df, id_col, text_col, params or Params()).filter("not kept").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__hash")).distinct()
    return df.join(gone, (F.col(id_col) == F.col("__gone")) & (F.xxhash64(text_col) == F.col("__hash")), "left_anti")
