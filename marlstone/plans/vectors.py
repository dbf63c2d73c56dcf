"""Queries over embeddings and their evaluation. k-NN runs in blocks over all vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions.scalar import round_up
from marlstone.operators import evalstats as ev
from marlstone.operators import vectors as vc
from marlstone.operators.ranks import cumulative
from marlstone.plans.catalog import register, table
from marlstone.session import materialise

K = 5
_R = "floor(({}) * 10000 + 0.5) / 10000"
_V = "v AS (SELECT vec_id, label, vec_id % 7 AS artist, embedding::DOUBLE[] AS e FROM embeddings)"
_PAIRS = "p AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, a.label AS own, b.label AS l, a.artist AS aa, b.artist AS ba, floor(list_cosine_similarity(a.e, b.e) * 1e6 + 0.5) / 1e6 AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id)"


def _edges_sql(k: int = K, where: str = "true") -> str:
    return f"WITH {_V}, {_PAIRS}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS rank FROM p WHERE {where}) WHERE rank <= {k})"


_VOTE = "c AS (SELECT query, own, l, count(*) AS n FROM k GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, l) AS r, sum(n) OVER (PARTITION BY query) AS t FROM c), w AS (SELECT query, own, max(l) FILTER (r = 1) AS predicted, max(l) FILTER (r = 2) AS second, max(n / t) FILTER (r = 1) AS agreement FROM r GROUP BY 1, 2)"


def _edges(spark, sf, k: int = K):
    e = table(spark, sf, "embeddings")
    return vc.knn_edges(e, e, k, same=True)


def _votes(spark, sf, k: int = K, edges=None):
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    return vc.vote(_edges(spark, sf, k) if edges is None else edges, labels, "vec_id", "label").join(labels.withColumnsRenamed({"vec_id": "query", "label": "own"}), "query")


@register("knn_topk", _edges_sql() + "SELECT query, neighbour, floor(s * 10000 + 0.5) / 10000 AS similarity, rank FROM k")
def knn_topk(spark, sf):
    return _edges(spark, sf).select("query", "neighbour", round_up(F.col("similarity"), 4).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@register("knn_majority_vote", _edges_sql() + f", {_VOTE} SELECT query, predicted, agreement, agreement < 0.6 AS refused FROM w")
def knn_majority_vote(spark, sf):
    return _votes(spark, sf).select("query", "predicted", "agreement", "refused")


@register("loo_eval", _edges_sql() + f", {_VOTE} SELECT count(*) AS n, count(*) FILTER (agreement < 0.6) AS refused, count(*) FILTER (agreement >= 0.6 AND predicted = own) AS agree, count(*) FILTER (agreement >= 0.6 AND predicted <> own) AS disagree, count(*) FILTER (predicted = own) AS ungated, count(*) FILTER (predicted = own OR second = own) AS top2 FROM w")
def loo_eval(spark, sf):
    v = _votes(spark, sf)
    ok = F.col("predicted") == F.col("own")
    return v.agg(F.count("*").alias("n"), F.count_if("refused").alias("refused"), F.count_if(~F.col("refused") & ok).alias("agree"), F.count_if(~F.col("refused") & ~ok).alias("disagree"), F.count_if(ok).alias("ungated"), F.count_if(ok | F.coalesce(F.col("second") == F.col("own"), F.lit(False))).alias("top2"))


@register("loo_disjoint", _edges_sql(where="aa <> ba") + f", {_VOTE} SELECT count(*) AS n, count(*) FILTER (predicted = own) AS agree FROM w")
def loo_disjoint(spark, sf):
    """Neighbours of the same artist do not count."""
    e = table(spark, sf, "embeddings").withColumn("artist", F.col("vec_id") % 7)
    labels = e.select("vec_id", "label")
    edges = vc.knn_edges(e, e, K, apart="artist")
    v = vc.vote(edges, labels, "vec_id", "label").join(labels.withColumnsRenamed({"vec_id": "query", "label": "own"}), "query")
    return v.agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("own")).alias("agree"))


@register("dispute_flags", _edges_sql(3) + f", {_VOTE} SELECT query, own, predicted FROM w WHERE agreement = 1 AND predicted <> own")
def dispute_flags(spark, sf):
    return _votes(spark, sf, 3).filter("agreement = 1 AND predicted <> own").select("query", "own", "predicted")


@register("weighted_knn", _edges_sql(7) + f""", s AS (SELECT query, l, sum(s) AS w, count(*) AS n FROM k WHERE s >= 0.1 GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY w DESC, l) AS r, sum(n) OVER (PARTITION BY query) AS total FROM s)
SELECT query, max(l) FILTER (r = 1) AS winner, max(l) FILTER (r = 2) AS second, max(total)::BIGINT AS neighbours FROM t GROUP BY 1 HAVING max(total) >= 3 AND max(n / total) FILTER (r = 1) >= 0.5""")
def weighted_knn(spark, sf):
    return vc.weighted_vote(_edges(spark, sf, 7), table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", "label", 0.1)


@register("hubness", _edges_sql() + ", o AS (SELECT neighbour, count(*) AS n FROM k GROUP BY 1), s AS (SELECT list(n ORDER BY n) AS a, count(*) AS c, max(n) AS top, count(*) FILTER (n >= 10) AS hubs FROM o) SELECT c AS listed, top, hubs, a[floor(0.5 * c)::INT + 1] AS p50, a[floor(0.9 * c)::INT + 1] AS p90, a[floor(0.99 * c)::INT + 1] AS p99 FROM s")
def hubness(spark, sf):
    seen = _edges(spark, sf).groupBy("neighbour").agg(F.count("*").alias("n"))
    counts = materialise(seen.groupBy("n").agg(F.count("*").alias("c")))
    runs = cumulative(counts, "n", "c", "upto", "listed")
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("listed") * q), F.col("n")))
    hubs = F.sum(F.when(F.col("n") >= 10, F.col("c")).otherwise(0))
    return runs.agg(F.max("listed").alias("listed"), F.max("n").alias("top"), hubs.alias("hubs"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"))


@register("confusion_matrix", _edges_sql() + f", {_VOTE} SELECT own AS truth, predicted AS pred, count(*) AS n FROM w GROUP BY 1, 2")
def confusion_matrix(spark, sf):
    return ev.confusion(_votes(spark, sf), "own", "predicted")


@register("artist_overlap", _edges_sql() + f"SELECT {_R.format('avg((aa = ba)::INT)')} AS share FROM k")
def artist_overlap(spark, sf):
    return _edges(spark, sf).agg(round_up(F.avg((F.col("query") % 7 == F.col("neighbour") % 7).cast("int")), 4).alias("share"))


@register("precision_at_k", _edges_sql(10) + f"SELECT own AS label, {_R.format('avg((own = l)::INT)')} AS precision FROM k GROUP BY 1")
def precision_at_k(spark, sf):
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    named = _edges(spark, sf, 10).join(labels.withColumnsRenamed({"vec_id": "query"}), "query").join(labels.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("l")), "neighbour")
    return named.groupBy("label").agg(round_up(F.avg((F.col("label") == F.col("l")).cast("int")), 4).alias("precision"))


def _means(spark, sf):
    return vc.labelled_pair_means(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")


@register("cosine_gap", f"WITH {_V}, q AS (SELECT a.label = b.label AS same, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id < b.vec_id) SELECT {_R.format('avg(s) FILTER (same)')} AS intra, {_R.format('avg(s) FILTER (NOT same)')} AS inter FROM q")
def cosine_gap(spark, sf):
    same = F.col("own") == F.col("label")
    mean = lambda c: round_up(F.sum(F.when(c, F.col("mean") * F.col("n"))) / F.sum(F.when(c, F.col("n"))), 4)
    return _means(spark, sf).agg(mean(same).alias("intra"), mean(~same).alias("inter"))


@register("silhouette", f"""
WITH {_V}, q AS (SELECT a.vec_id, a.label AS own, b.label AS l, avg(1 - list_cosine_similarity(a.e, b.e)) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
s AS (SELECT vec_id, max(d) FILTER (own = l) AS a, min(d) FILTER (own <> l) AS b FROM q GROUP BY 1) SELECT {_R.format('avg((b - a) / greatest(a, b))')} AS silhouette, count(*) AS n FROM s WHERE a IS NOT NULL AND b IS NOT NULL""")
def silhouette(spark, sf):
    return vc.silhouette(_means(spark, sf)).select(round_up(F.col("silhouette"), 4).alias("silhouette"), "n")


@register("csls_topk", f"""
WITH {_V}, {_PAIRS}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS rank FROM p) WHERE rank <= 20),
rr AS (SELECT query, avg(s) AS r FROM k WHERE rank <= 10 GROUP BY 1),
c AS (SELECT k.query, k.neighbour, floor((2 * s - a.r - b.r) * 1e4 + 0.5) / 1e4 AS score FROM k JOIN rr a ON a.query = k.query JOIN rr b ON b.query = k.neighbour)
SELECT query, neighbour, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS rank FROM c) WHERE rank <= 5""")
def csls_topk(spark, sf):
    """Hubness-corrected neighbours; a vector's correction is its mean similarity to its ten nearest of all vectors."""
    edges = materialise(_edges(spark, sf, 20))
    return vc.csls(edges, edges.filter("rank <= 10"), K).withColumn("rank", F.col("rank").cast("long"))


@register("whitened_topk")
def whitened_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    mean, directions = vc.principal_directions(e, "embedding", 3)
    w = vc.whiten(e, "embedding", mean, directions)
    return vc.knn_edges(w, w, K, same=True).select("query", "neighbour", round_up(F.col("similarity"), 4).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@register("linear_probe")
def linear_probe(spark, sf):
    """Multinomial logistic regression over stratified folds; every row is predicted by a model that has not seen it."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    e = vc.folds(table(spark, sf, "embeddings"), "label", "vec_id", 3).withColumn("features", array_to_vector(F.col("embedding").cast("array<double>"))).withColumn("y", F.col("label").cast("double"))
    out = None
    for fold in range(3):
        model = LogisticRegression(featuresCol="features", labelCol="y", maxIter=50, regParam=1e-3).fit(e.filter(F.col("fold") != fold))
        part = model.transform(e.filter(F.col("fold") == fold)).select("vec_id", "label", F.col("prediction").cast("int").alias("predicted"), "fold")
        out = part if out is None else out.unionByName(part)
    return out


@register("stratified_folds", "SELECT vec_id, CAST((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 5 AS INT) AS fold FROM embeddings")
def stratified_folds(spark, sf):
    return vc.folds(table(spark, sf, "embeddings"), "label", "vec_id", 5).select("vec_id", "fold")


@register("accuracy_f1", _edges_sql() + f", {_VOTE}, t AS (SELECT own AS c, count(*) AS t, count(*) FILTER (own = predicted) AS tp FROM w GROUP BY 1), q AS (SELECT predicted AS c, count(*) AS p FROM w GROUP BY 1) SELECT {_R.format('sum(tp) / sum(t)')} AS accuracy, {_R.format('avg(2 * tp / (t + coalesce(p, 0)))')} AS macro_f1, count(*) AS classes FROM t LEFT JOIN q USING (c)")
def accuracy_f1(spark, sf):
    return ev.accuracy_f1(_votes(spark, sf), "own", "predicted").select(round_up(F.col("accuracy"), 4).alias("accuracy"), round_up(F.col("macro_f1"), 4).alias("macro_f1"), "classes")


@register("ece", _edges_sql() + f", {_VOTE}, b AS (SELECT least(floor(agreement * 10), 9) AS b, count(*) AS n, avg(agreement) AS c, avg((predicted = own)::INT) AS k FROM w GROUP BY 1) SELECT {_R.format('sum(n * abs(c - k)) / sum(n)')} AS ece FROM b")
def ece(spark, sf):
    return ev.calibration_error(_votes(spark, sf), F.col("agreement"), F.col("predicted") == F.col("own")).select(round_up(F.col("ece"), 4).alias("ece"))


@register("risk_coverage", _edges_sql() + f", {_VOTE}, g AS (SELECT unnest(range(0, 21)) AS step), a AS (SELECT count(*) AS total FROM w) SELECT step / 20 AS threshold, {_R.format('count(w.query) / any_value(total)')} AS coverage, {_R.format('avg((predicted = own)::INT)')} AS accuracy FROM g CROSS JOIN a LEFT JOIN w ON agreement + 1e-10 >= step / 20 GROUP BY step")
def risk_coverage(spark, sf):
    out = ev.risk_coverage(_votes(spark, sf), F.col("agreement"), F.col("predicted") == F.col("own"))
    return out.select("threshold", round_up(F.col("coverage"), 4).alias("coverage"), round_up(F.col("accuracy"), 4).alias("accuracy"))


def _run_sql(k: int) -> str:
    return f"k{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS rank FROM p) WHERE rank <= {k}), c{k} AS (SELECT query, own, l, count(*) AS n FROM k{k} GROUP BY 1, 2, 3), w{k} AS (SELECT query, arg_min(l, (-n, l)) = own AS ok FROM c{k} GROUP BY query, own)"


@register("mcnemar", f"""
WITH {_V}, {_PAIRS}, {_run_sql(3)}, {_run_sql(5)}, d AS (SELECT count(*) FILTER (w3.ok AND NOT w5.ok) AS b, count(*) FILTER (NOT w3.ok AND w5.ok) AS c FROM w3 JOIN w5 USING (query)),
x AS (SELECT b, c, CASE WHEN b + c > 0 THEN greatest(abs(b - c) - 1, 0) ** 2 / (b + c) ELSE 0 END AS chi FROM d), t AS (SELECT *, sqrt(chi / 2) AS z, 1 / (1 + 0.3275911 * sqrt(chi / 2)) AS t FROM x)
SELECT b, c, {_R.format('chi')} AS chi2, {_R.format('((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z)')} AS p FROM t""")
def mcnemar(spark, sf):
    """k = 3 against k = 5 on the same rows; the three nearest are the first of the five."""
    edges = materialise(_edges(spark, sf, 5))
    run = lambda k: _votes(spark, sf, k, edges.filter(F.col("rank") <= k)).select("query", (F.col("predicted") == F.col("own")).alias("correct"))
    out = ev.mcnemar(run(3), run(5), "query", "correct")
    return out.select("b", "c", round_up(F.col("chi2"), 4).alias("chi2"), round_up(F.col("p"), 4).alias("p"))


@register("bootstrap_ci")
def bootstrap_ci(spark, sf):
    out = ev.bootstrap_ci(_votes(spark, sf), "query", F.col("predicted") == F.col("own"))
    return out.select(round_up(F.col("low"), 4).alias("low"), round_up(F.col("high"), 4).alias("high"))


@register("spearman", f"""
WITH a AS (SELECT l_quantity AS q, l_extendedprice AS p FROM lineitem), r AS (SELECT rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2 AS rq, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rp FROM a) SELECT {_R.format('corr(rq, rp)')} AS rho FROM r""")
def spearman(spark, sf):
    return ev.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select(round_up(F.col("rho"), 4).alias("rho"))


@register("cohen_d", f"""
WITH x AS (SELECT avg(l_quantity) FILTER (l_returnflag = 'R') AS m1, avg(l_quantity) FILTER (l_returnflag <> 'R') AS m0, var_samp(l_quantity) FILTER (l_returnflag = 'R') AS s1, var_samp(l_quantity) FILTER (l_returnflag <> 'R') AS s0, count(*) FILTER (l_returnflag = 'R') AS n1, count(*) FILTER (l_returnflag <> 'R') AS n0 FROM lineitem)
SELECT {_R.format('(m1 - m0) / sqrt(((n0 - 1) * s0 + (n1 - 1) * s1) / (n0 + n1 - 2))')} AS d FROM x""")
def cohen_d(spark, sf):
    return ev.cohen_d(table(spark, sf, "lineitem"), F.col("l_returnflag") == "R", "l_quantity").select(round_up(F.col("d"), 4).alias("d"))


@register("holm", f"""
WITH p AS (SELECT s_suppkey, (s_suppkey % 97 + 1) / 9700.0 + s_suppkey / 1e9 AS p FROM supplier), r AS (SELECT s_suppkey, p, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p) + 1)) AS raw FROM p)
SELECT s_suppkey, {_R.format('max(raw) OVER (ORDER BY p)')} AS adjusted FROM r""")
def holm(spark, sf):
    p = table(spark, sf, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 97 + 1) / 9700.0 + F.col("s_suppkey") / 1e9).alias("p"))
    return ev.holm(p, "p").select("s_suppkey", round_up(F.col("adjusted"), 4).alias("adjusted"))


@register("baseline_compare", f"SELECT l_linestatus, {_R.format('avg((l_returnflag = chr(65))::INT)')} AS score, avg((l_returnflag = 'A')::INT) < 0.33 - 0.02 AS regressed FROM lineitem GROUP BY 1")
def baseline_compare(spark, sf):
    score = F.avg((F.col("l_returnflag") == "A").cast("int"))
    return table(spark, sf, "lineitem").groupBy("l_linestatus").agg(round_up(score, 4).alias("score"), (score < 0.33 - 0.02).alias("regressed"))


@register("pearson", f"SELECT {_R.format('corr(l_quantity, l_discount)')} AS r FROM lineitem")
def pearson(spark, sf):
    return table(spark, sf, "lineitem").agg(round_up(F.corr("l_quantity", "l_discount"), 4).alias("r"))


_ITEMS = "x AS (SELECT vec_id // 3 AS item, vec_id, CASE WHEN vec_id % 50 = 0 THEN list_transform(embedding, lambda y: 0)::DOUBLE[] ELSE embedding::DOUBLE[] END AS e FROM embeddings), l AS (SELECT vec_id // 3 AS item, label FROM embeddings WHERE vec_id % 3 = 0), z AS (SELECT * FROM x WHERE vec_id % 50 <> 0)"


@register("multi_vector_loo", f"""
WITH {_ITEMS}, p AS (SELECT a.item AS own_item, a.vec_id AS query, b.item AS neighbour, max(floor(list_cosine_similarity(a.e, b.e) * 1e6 + 0.5) / 1e6) AS s FROM z a JOIN z b ON a.item <> b.item GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS rank FROM p) WHERE rank <= 5),
c AS (SELECT own_item, query, label, count(*) AS n, min(rank) AS r FROM k JOIN l ON l.item = k.neighbour GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY query) AS t, row_number() OVER (PARTITION BY query ORDER BY n DESC, r) AS o FROM c),
b AS (SELECT own_item, label AS predicted, n / t AS agreement FROM w WHERE o = 1 QUALIFY row_number() OVER (PARTITION BY own_item ORDER BY n / t DESC, query) = 1)
SELECT l.item, label AS own, predicted, coalesce(floor(agreement * 10000 + 0.5) / 10000, 0) AS agreement, coalesce(predicted = label, false) AS correct FROM l LEFT JOIN b ON b.own_item = l.item""")
def multi_vector_loo(spark, sf):
    """Items of three vectors each, left out in turn; some vectors are zero."""
    e = table(spark, sf, "embeddings")
    vec = F.when(F.col("vec_id") % 50 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    vectors = e.select("vec_id", F.floor(F.col("vec_id") / 3).alias("item"), vec.alias("embedding"))
    labels = e.filter("vec_id % 3 = 0").select(F.floor(F.col("vec_id") / 3).alias("item"), "label")
    found = vc.best_vote(vc.knn_items(vectors, 5, "item"), vectors, labels, "item", "vec_id", "label")
    return found.withColumn("agreement", round_up(F.col("agreement"), 4))


_FOLD = "(('0x' || left(md5((vec_id % 23)::VARCHAR), 8))::BIGINT % 5)::INT"
_BALANCED = f"""WITH f AS (SELECT vec_id, label, {_FOLD} AS fold, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS query, a.label AS own, a.fold, b.vec_id AS neighbour, b.label AS l, floor(list_cosine_similarity(a.e, b.e) * 1e6 + 0.5) / 1e6 AS s FROM f a JOIN f b ON a.fold <> b.fold),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS rank FROM p) WHERE rank <= 5), n AS (SELECT label AS l, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS w FROM embeddings GROUP BY 1),
v AS (SELECT query, own, fold, l, sum(w / greatest(1 - s, 1e-10)) AS v FROM k JOIN n USING (l) GROUP BY ALL), b AS (SELECT query, own, fold, l AS predicted FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY floor(v * 1e7 + 0.5) DESC, l) = 1)"""


def _balanced(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("fold", vc.group_fold(F.col("vec_id") % 23, 5))
    voted = vc.balanced_vote(vc.knn_edges(e, e, 5, apart="fold"), e, "vec_id", "label")
    return voted.join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("own"), "fold"), "query")


@register("balanced_knn", f"{_BALANCED} SELECT query, own, fold, predicted FROM b")
def balanced_knn(spark, sf):
    """Groups of 23 stand on one side of every fold; a vote weighs by the rarity of its class and by nearness."""
    return _balanced(spark, sf).select("query", "own", "fold", "predicted")


@register("balanced_knn_eval", f"""{_BALANCED}, c AS (SELECT u.l AS label, count(*) FILTER (own = u.l) AS n, count(*) FILTER (own = u.l AND predicted = u.l) AS hit, count(*) FILTER (predicted = u.l) AS said FROM b, (SELECT own AS l FROM b UNION SELECT predicted FROM b) u GROUP BY 1)
SELECT label, n, {_R.format('CASE WHEN n > 0 THEN hit / n ELSE 0 END')} AS recall, {_R.format('CASE WHEN n + said > 0 THEN 2 * hit / (n + said) ELSE 0 END')} AS f1 FROM c""")
def balanced_knn_eval(spark, sf):
    """Recall and F1 of each class; their means are the macro figures."""
    b = _balanced(spark, sf)
    zero, one = F.lit(0), F.lit(1)
    owned = b.select(F.col("own").alias("label"), one.alias("n"), zero.alias("said"), (F.col("own") == F.col("predicted")).cast("int").alias("hit"))
    sides = owned.unionByName(b.select(F.col("predicted").alias("label"), zero.alias("n"), one.alias("said"), zero.alias("hit")))
    c = sides.groupBy("label").agg(F.sum("n").alias("n"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    return c.select("label", "n", round_up(F.when(F.col("n") > 0, F.col("hit") / F.col("n")).otherwise(0.0), 4).alias("recall"), round_up(2 * F.col("hit") / (F.col("n") + F.col("said")), 4).alias("f1"))


@register("group_cv", f"""
WITH f AS (SELECT vec_id, label, {_FOLD} AS fold, embedding::DOUBLE[] AS e FROM embeddings), x AS (SELECT vec_id, label, fold, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM f),
s AS (SELECT g.fold, d, sqrt(greatest(0, avg(x * x) - avg(x) * avg(x))) AS sd FROM x JOIN (SELECT DISTINCT fold FROM f) g ON g.fold <> x.fold GROUP BY ALL), m AS (SELECT g.fold, label AS l, d, avg(x) AS mean FROM x JOIN (SELECT DISTINCT fold FROM f) g ON g.fold <> x.fold GROUP BY ALL),
t AS (SELECT vec_id, x.fold, label, l, sum(((x - mean) / CASE WHEN sd * sd > 1e-12 THEN sd ELSE 1 END) ** 2) AS dist FROM x JOIN m ON m.fold = x.fold AND m.d = x.d JOIN s ON s.fold = x.fold AND s.d = x.d GROUP BY ALL)
SELECT vec_id AS id, fold, label AS own, l AS predicted FROM t QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY floor(dist * 1e6 + 0.5), l) = 1""")
def group_cv(spark, sf):
    return vc.nearest_centroid_cv(table(spark, sf, "embeddings").withColumn("g", F.col("vec_id") % 23), "vec_id", "embedding", "g", "label")


@register("band_similarity", f"""
WITH r AS (SELECT label, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings WHERE label IS NOT NULL), a AS (SELECT avg(list_cosine_similarity(x.e, y.e)) AS m, count(*) AS n FROM r x JOIN r y ON x.label = y.label AND y.i - x.i BETWEEN 1 AND 9),
b AS (SELECT avg(list_cosine_similarity(x.e, y.e)) AS m, count(*) AS n FROM r x JOIN r y ON x.label < y.label AND x.i = y.i AND x.i <= 10)
SELECT {_R.format('a.m')} AS intra, a.n AS intra_pairs, {_R.format('b.m')} AS inter, b.n AS inter_pairs, {_R.format('a.m - b.m')} AS coherence FROM a, b""")
def band_similarity(spark, sf):
    r = vc.band_similarity(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    return r.select(*[round_up(F.col(c), 4).alias(c) if c in ("intra", "inter", "coherence") else c for c in r.columns])
