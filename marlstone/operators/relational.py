"""Keyed joins, diffs and matches over any tables; every operator takes column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.joins import spread_join


def top_n_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key. Spark limits each task to ``n`` rows a key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The latest row of each key; ``order`` must break ties."""
    return top_n_by(df, keys, order, 1)


def latest_row_join(left: DataFrame, right: DataFrame, key: str, order: list[Column], how: str = "left") -> DataFrame:
    """Join with only the latest row of ``right`` for each key (a correlated ORDER BY .. LIMIT 1)."""
    return left.join(latest_by(right, [key], order), key, how)


def upsert(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changed rows replace those of the same key; new keys are added; missing columns become null."""
    kept = target.join(changes.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(changes, allowMissingColumns=True)


def insert_or_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not there yet are added; existing rows stay as they are."""
    fresh = rows.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def fill_upsert(target: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Upsert that fills without clobbering: a null in ``changes`` keeps the old value."""
    t, c = target.alias("t"), changes.alias("c")
    joined = t.join(c, F.col(f"t.{key}") == F.col(f"c.{key}"), "full_outer")
    return joined.select(F.coalesce(f"t.{key}", f"c.{key}").alias(key), *[F.coalesce(f"c.{x}", f"t.{x}").alias(x) for x in columns])


def upsert_by_rule(target: DataFrame, changes: DataFrame, keys: list[str], rules: dict[str, str], flags: dict[str, Column] | None = None) -> DataFrame:
    """Upsert on any number of keys with a rule per column of what a change does to a row that is there.

    ``replace`` takes the change, null or not; ``fill`` takes it unless it is null; ``keep`` leaves what
    is there, unless the column's condition in ``flags``, read from the change, is true. New keys take
    the change as it is. Keys are unique on either side; null keys equal each other.
    """
    t = target.select(*[F.col(k).alias(f"__t{k}") for k in keys], *[F.col(c).alias(f"__t_{c}") for c in rules], F.lit(True).alias("__old"))
    asked = {c: f.alias(f"__f_{c}") for c, f in (flags or {}).items()}
    c = changes.select(*keys, *rules, *asked.values(), F.lit(True).alias("__new"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__t{k}"))
    both = t.join(c, same, "full_outer")
    old, new = F.col("__old").isNotNull(), F.col("__new").isNotNull()

    def settled(name: str, rule: str) -> Column:
        was, now = F.col(f"__t_{name}"), F.col(name)
        if rule == "fill":
            merged = F.coalesce(now, was)
        elif rule == "keep":
            merged = F.when(F.coalesce(F.col(f"__f_{name}"), F.lit(False)), now).otherwise(was) if name in asked else was
        else:
            merged = now
        return F.when(old & new, merged).when(new, now).otherwise(was).alias(name)

    return both.select(*[F.when(new, F.col(k)).otherwise(F.col(f"__t{k}")).alias(k) for k in keys], *[settled(n, r) for n, r in rules.items()])


def mirror(target: DataFrame, seen: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """A mirror after a full scan: what was seen, and the stale rows that go."""
    return seen, target.join(seen.select(*keys), keys, "left_anti")


def source_diff(a: DataFrame, b: DataFrame, key: Column) -> DataFrame:
    """``key, side``: keys only in a, only in b, or shared."""
    left = a.select(key.alias("key")).filter("key is not null").distinct().withColumn("in_a", F.lit(True))
    right = b.select(key.alias("key")).filter("key is not null").distinct().withColumn("in_b", F.lit(True))
    both = left.join(right, "key", "full_outer")
    side = F.when(F.col("in_a").isNull(), "only_b").when(F.col("in_b").isNull(), "only_a").otherwise("shared")
    return both.select("key", side.alias("side"))


def two_key_diff(a: DataFrame, b: DataFrame, first: str, second: str, size: str) -> DataFrame:
    """Inventory diff: rows are matched on ``first``, the rest on ``second``; then sizes are compared.

    Gives ``change`` (added, removed, changed, same) and ``matched_by``. A second key that is null or
    repeats among the unmatched of a side matches nothing.
    """
    cols = lambda df, s: df.select(*[F.col(c).alias(f"{s}_{c}") for c in (first, second, size)])
    left, right = cols(a, "a"), cols(b, "b")
    exact = left.join(right, F.col(f"a_{first}") == F.col(f"b_{first}")).withColumn("matched_by", F.lit("first"))
    rest_a = left.join(right, F.col(f"a_{first}") == F.col(f"b_{first}"), "left_anti")
    rest_b = right.join(left, F.col(f"a_{first}") == F.col(f"b_{first}"), "left_anti")
    single = lambda df, c: df.join(df.filter(F.col(c).isNotNull()).groupBy(c).count().filter("count = 1").select(c), c, "left_semi")
    again = single(rest_a, f"a_{second}").join(single(rest_b, f"b_{second}"), F.col(f"a_{second}") == F.col(f"b_{second}")).withColumn("matched_by", F.lit("second"))
    gone = rest_a.join(again.select(f"a_{first}"), f"a_{first}", "left_anti")
    new = rest_b.join(again.select(f"b_{first}"), f"b_{first}", "left_anti")
    change = F.when(F.col(f"a_{size}").eqNullSafe(F.col(f"b_{size}")), "same").otherwise("changed")
    matched = exact.unionByName(again).withColumn("change", change)
    parts = matched.unionByName(gone.withColumn("change", F.lit("removed")), allowMissingColumns=True).unionByName(new.withColumn("change", F.lit("added")), allowMissingColumns=True)
    return parts.select("change", "matched_by", *[f"{s}_{c}" for s in "ab" for c in (first, second, size)])


def cascade_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tiers: list[tuple[str, Column, Column]]) -> DataFrame:
    """Match by the first tier that finds exactly one partner; a key that two rows share is void.

    ``tiers``: (name, key of the left row, key of the right row). Gives ``left_id, tier, match``.
    """
    out = left.select("*", *[k.alias(f"__l{i}") for i, (_, k, _) in enumerate(tiers)])
    for i, (_, _, key) in enumerate(tiers):
        index = right.select(key.alias(f"__l{i}"), F.col(right_id).alias("__r")).filter(F.col(f"__l{i}").isNotNull()).groupBy(f"__l{i}").agg(F.count("*").alias("__n"), F.min("__r").alias(f"__m{i}")).filter("__n = 1").drop("__n")
        out = out.join(index, f"__l{i}", "left")
    tier = F.coalesce(*[F.when(F.col(f"__m{i}").isNotNull(), F.lit(name)) for i, (name, _, _) in enumerate(tiers)], F.lit("none"))
    return out.select(left_id, tier.alias("tier"), F.coalesce(*[F.col(f"__m{i}") for i in range(len(tiers))]).alias("match"))


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, width: float, keys: list[str] | None = None, spread: bool = False) -> DataFrame:
    """Pairs with ``abs(left_value - right_value) <= width`` (and equal ``keys``).

    The range becomes an equi-join: values fall into cells as wide as the band, and the right
    side is repeated in the three cells around its own. Column names must not clash but for keys.
    With ``spread`` tasks follow the number of pairs (:func:`spread_join`), for cells of many rows.
    """
    keys = keys or []
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    a = left.withColumn("__cell", cell(left_value))
    b = right.withColumn("__cell", F.explode(F.array(*[cell(right_value) + d for d in (-1, 0, 1)])))
    on = [*keys, "__cell"]
    return (spread_join(a, b, on) if spread else a.join(b, on)).filter(F.abs(F.col(left_value) - F.col(right_value)) <= width).drop("__cell")


def band_count(df: DataFrame, value: str, factor: float = 0.94) -> DataFrame:
    """``neighbours``: rows x with value * factor < x < value / factor, the row itself included.

    Equal values are counted once and joined by geometric cells, so each meets only its neighbours.
    """
    step = -F.log(F.lit(factor))
    counts = df.filter(F.col(value) > 0).groupBy(value).agg(F.count("*").alias("__n")).withColumn("__cell", F.floor(F.log(value) / step).cast("long"))
    other = counts.select(F.col(value).alias("__v"), F.col("__n").alias("__m"), F.explode(F.array(*[F.col("__cell") + d for d in (-1, 0, 1)])).alias("__cell"))
    near = counts.join(other, "__cell").filter((F.col("__v") > F.col(value) * factor) & (F.col("__v") < F.col(value) / factor))
    return df.join(near.groupBy(value).agg(F.sum("__m").alias("neighbours")), value)


def nearest_match(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, right_id: str) -> DataFrame:
    """For each left row the nearest right row of its key; ties go to the earlier one.

    One ordered pass over the union of both sides: the last right time before and the first
    after each left row, so no pair is formed.
    """
    zone = [F.lit(None).cast(right.schema[right_id].dataType).alias("__id"), F.lit(None).cast(right.schema[right_time].dataType).alias("__at")]
    a = left.select(F.struct(*left.columns).alias("__row"), F.col(key).alias("__key"), F.col(left_time).alias("__t"), *zone)
    b = right.select(F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(key).alias("__key"), F.col(right_time).alias("__t"), F.col(right_id).alias("__id"), F.col(right_time).alias("__at"))
    both = a.unionByName(b).withColumn("__c", F.when(F.col("__at").isNotNull(), F.struct("__at", "__id")))
    w = Window.partitionBy("__key").orderBy("__t")
    before = F.max("__c").over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min("__c").over(w.rangeBetween(0, Window.unboundedFollowing))
    found = both.withColumns({"__b": before, "__a": after}).filter("__row is not null")
    first_of_before = F.col("__b")
    gap_b, gap_a = F.col("__t") - F.col("__b.__at"), F.col("__a.__at") - F.col("__t")
    pick = F.when(F.col("__a").isNull() | (gap_b <= gap_a), first_of_before).otherwise(F.col("__a"))
    return found.select("__row.*", pick["__id"].alias("nearest_id"), pick["__at"].alias("nearest_time"))


def interval_assign(points: DataFrame, intervals: DataFrame, key: str, time: str, start: str, end: str) -> DataFrame:
    """Each point with the interval of its key that holds it, ``start <= time < end``; intervals are disjoint.

    As in :func:`nearest_match`, the interval that began last is carried along an ordered pass.
    """
    cols = [c for c in intervals.columns if c != key]
    a = points.select(F.col(key).alias("__key"), F.col(time).alias("__t"), F.lit(1).alias("__o"), F.struct(*points.columns).alias("__p"), F.lit(None).cast(intervals.select(F.struct(*cols).alias("x")).schema["x"].dataType).alias("__i"))
    b = intervals.select(F.col(key).alias("__key"), F.col(start).alias("__t"), F.lit(0).alias("__o"), F.lit(None).cast(a.schema["__p"].dataType).alias("__p"), F.struct(*cols).alias("__i"))
    w = Window.partitionBy("__key").orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__i", F.last("__i", ignorenulls=True).over(w))
    return both.filter(F.col("__p").isNotNull() & (F.col("__t") < F.col(f"__i.{end}"))).select("__p.*", *[F.col(f"__i.{c}").alias(c) for c in cols])


def fk_check(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """``n_rows, n_missing``: children, and those whose parent does not exist (a null key counts)."""
    known = parent.select(F.col(parent_key).alias("__p")).distinct()
    joined = child.join(known, F.col(child_key) == F.col("__p"), "left")
    return joined.agg(F.count("*").alias("n_rows"), F.sum(F.col("__p").isNull().cast("long")).alias("n_missing"))


def ensure_columns(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """``df`` with every column of ``schema``; a missing one is null, so older tables stay readable."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in schema.items() if c not in df.columns])


def claims(findings: list[DataFrame], path: str) -> DataFrame:
    """Findings of ordered checks; a path that an earlier check has claimed is left out of later ones."""
    out = findings[0]
    for later in findings[1:]:
        out = out.unionByName(later.join(out.select(path).distinct(), path, "left_anti"))
    return out
