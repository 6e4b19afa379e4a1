"""Mining queries: similarity, itemsets, recommenders, graphs, sketches, clustering, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltflow.operators import analytics, clustering, graph, itemsets, recommend, similarity, sketches
from siltflow.registry import query
from siltflow.tables import load

# ---------------------------------------------------------------- similarity
_SHINGLES = """w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id AS item, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i + 2], ' '))) AS token FROM w WHERE len(w) >= 3)"""
_JACCARD = """n AS (SELECT item, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.item AS a, b.item AS b, count(*) AS o FROM s a JOIN s b ON a.token = b.token AND a.item < b.item GROUP BY 1, 2),
j AS (SELECT a, b, o / (x.n + y.n - o) AS sim FROM o JOIN n x ON x.item = a JOIN n y ON y.item = b)"""


def _shingles(spark, sf_dir):
    return similarity.shingles(load(spark, sf_dir, "documents"), "doc_id", "text", 3)


@query("jaccard_exact", f"WITH {_SHINGLES}, {_JACCARD} SELECT a, b, round(sim, 6) AS sim FROM j WHERE sim >= 0.5")
def jaccard_exact(spark, sf_dir):
    return similarity.jaccard_join(_shingles(spark, sf_dir), 0.5).select("a", "b", F.round("sim", 6).alias("sim"))


def _token_number():
    return F.conv(F.substring(F.md5(F.col("token").cast("binary")), 1, 7), 16, 10).cast("long")


_MINS = ", ".join(f"min((x * {a} + {b}) % {similarity.PRIME})" for a, b in similarity.hash_coefficients(60))
_SIGNATURES = f"{_SHINGLES}, h AS (SELECT item, CAST('0x' || substr(md5(token), 1, 7) AS BIGINT) AS x FROM s), sig AS (SELECT item, [{_MINS}] AS sig FROM h GROUP BY 1)"
_CANDIDATES = f"""{_SIGNATURES}, band AS (SELECT item, i AS band, sig[2 * i + 1:2 * i + 2] AS key FROM sig, range(30) t(i)),
c AS (SELECT DISTINCT x.item AS a, y.item AS b FROM band x JOIN band y ON x.band = y.band AND x.key = y.key AND x.item < y.item)"""


@query("minhash_signature", f"WITH {_SIGNATURES} SELECT item, array_to_string(sig, ',') AS sig FROM sig")
def minhash_signature(spark, sf_dir):
    return similarity.minhash(_shingles(spark, sf_dir), _token_number()).select("item", F.array_join("sig", ",").alias("sig"))


@query("lsh_candidates", f"WITH {_CANDIDATES} SELECT a, b FROM c")
def lsh_candidates(spark, sf_dir):
    return similarity.candidates(similarity.minhash(_shingles(spark, sf_dir), _token_number()))


@query("lsh_join", f"WITH {_CANDIDATES}, {_JACCARD} SELECT a, b, round(sim, 6) AS sim FROM j SEMI JOIN c USING (a, b) WHERE sim >= 0.5")
def lsh_join(spark, sf_dir):
    return similarity.lsh_join(_shingles(spark, sf_dir), _token_number()).select("a", "b", F.round("sim", 6).alias("sim"))


# ---------------------------------------------------------------- itemsets
_ROWS = "r AS (SELECT DISTINCT l_orderkey AS basket, l_partkey AS item FROM lineitem)"
_PAIRS = f"{_ROWS}, p AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM r x JOIN r y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= 2)"


def _rows(spark, sf_dir):
    return itemsets.long_form(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query("baskets", f"WITH {_ROWS} SELECT basket, list_sort(list(item)) AS items FROM r GROUP BY 1")
def baskets(spark, sf_dir):
    return itemsets.baskets(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query("baskets_by_item", f"WITH {_ROWS} SELECT item AS basket, list_sort(list(basket)) AS items FROM r GROUP BY 1")
def baskets_by_item(spark, sf_dir):
    return itemsets.baskets(load(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey")


@query("baskets_large", "SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 6")
def baskets_large(spark, sf_dir):
    """The size counts rows, not different items."""
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n > 6")


@query("freq_1", f"WITH {_ROWS} SELECT item, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1 HAVING count(*) >= 30")
def freq_1(spark, sf_dir):
    return itemsets.frequent_items(_rows(spark, sf_dir), 30)


@query("freq_2", f"WITH {_PAIRS} SELECT [a, b] AS items, CAST(n AS BIGINT) AS n FROM p")
def freq_2(spark, sf_dir):
    return itemsets.frequent_sets(_rows(spark, sf_dir), 2, 2)


@query(
    "freq_3",
    f"WITH {_ROWS} SELECT [x.item, y.item, z.item] AS items, CAST(count(*) AS BIGINT) AS n FROM r x JOIN r y ON x.basket = y.basket AND x.item < y.item JOIN r z ON x.basket = z.basket AND y.item < z.item GROUP BY x.item, y.item, z.item HAVING count(*) >= 2",
)
def freq_3(spark, sf_dir):
    return itemsets.frequent_sets(_rows(spark, sf_dir), 2, 3)


@query(
    "assoc_rules",
    f"""WITH {_PAIRS}, i AS (SELECT item, count(*) AS n FROM r GROUP BY 1), t AS (SELECT count(DISTINCT basket) AS t FROM r),
q AS (SELECT a AS x, b AS y, n FROM p UNION ALL SELECT b, a, n FROM p)
SELECT x, y, CAST(q.n AS BIGINT) AS nxy, round(q.n / ix.n, 6) AS confidence, round((q.n / ix.n) / (iy.n / t), 6) AS lift
FROM q JOIN i ix ON ix.item = x JOIN i iy ON iy.item = y, t WHERE q.n / ix.n >= 0.08""",
)
def assoc_rules(spark, sf_dir):
    r = _rows(spark, sf_dir)
    rules = itemsets.association_rules(itemsets.frequent_sets(r, 2, 2), itemsets.frequent_items(r, 1), r.select("basket").distinct().count(), 0.08)
    return rules.select("x", "y", "nxy", F.round("confidence", 6).alias("confidence"), F.round("lift", 6).alias("lift"))


@query("pcy_buckets", f"WITH {_ROWS} SELECT CAST(xor(x.item, y.item) % 1000 AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS n FROM r x JOIN r y ON x.basket = y.basket AND x.item < y.item GROUP BY 1")
def pcy_buckets(spark, sf_dir):
    return itemsets.pair_buckets(_rows(spark, sf_dir), 1000)


_NATIONS = "r AS (SELECT DISTINCT l_orderkey AS basket, s_nationkey AS item FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), t AS (SELECT ceil(count(DISTINCT basket) * 0.002) AS least FROM r)"
_SETS = " UNION ALL ".join(
    f"SELECT concat_ws(',', {', '.join(f'r{i}.item' for i in range(k))}) AS items, CAST(count(*) AS BIGINT) AS n FROM r r0 "
    + " ".join(f"JOIN r r{i} ON r{i}.basket = r0.basket AND r{i}.item > r{i - 1}.item" for i in range(1, k))
    + f" GROUP BY {', '.join(f'r{i}.item' for i in range(k))} HAVING count(*) >= (SELECT least FROM t)"
    for k in range(1, 8)  # an order has at most seven lines
)


@query("son_two_pass", f"WITH {_NATIONS} {_SETS}")
def son_two_pass(spark, sf_dir):
    """Sets of nations that supply the same orders, at a support of two in a thousand: single ones, pairs and triples."""
    li, s = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "supplier")
    r = itemsets.long_form(li.join(s, F.col("s_suppkey") == F.col("l_suppkey")), "l_orderkey", "s_nationkey")
    least = -(-r.select("basket").distinct().count() * 2 // 1000)
    return itemsets.two_pass_frequent(r, least).select(F.array_join("items", ",").alias("items"), "n")


@query("itemset_report", None)
def itemset_report(spark, sf_dir):
    return itemsets.itemset_lines(itemsets.frequent_sets(_rows(spark, sf_dir), 2, 2))


@query("fpgrowth", f"WITH {_NATIONS} {_SETS.replace(' AS n FROM', ' AS freq FROM')}")
def fpgrowth(spark, sf_dir):
    """The sets of son_two_pass, of all sizes."""
    from pyspark.ml.fpm import FPGrowth

    li, s = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "supplier")
    b = itemsets.baskets(li.join(s, F.col("s_suppkey") == F.col("l_suppkey")), "l_orderkey", "s_nationkey")
    n = b.count()
    found = FPGrowth(itemsCol="items", minSupport=max(0.0, (-(-n * 2 // 1000) - 0.5) / max(1, n)), minConfidence=0.5).fit(b).freqItemsets
    return found.select(F.array_join(F.array_sort("items"), ",").alias("items"), "freq")


@query("prefixspan", None)
def prefixspan(spark, sf_dir):
    from pyspark.ml.fpm import PrefixSpan

    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: F.array(x["event_type"])).alias("sequence"))
    return PrefixSpan(minSupport=0.3, maxPatternLength=3).findFrequentSequentialPatterns(e.select("sequence"))


# ---------------------------------------------------------------- recommenders
_RATINGS = "rating AS (SELECT o_custkey AS u, l_partkey AS i, avg(l_quantity) / 10 AS r FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 10 <> 0 GROUP BY 1, 2)"
_ASKED = "asked AS (SELECT DISTINCT o_custkey AS u, l_partkey AS i FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 10 = 0)"
_SIM = """co AS (SELECT p.i, p.j, count(x.u) AS n, sum(x.r) AS sx, sum(y.r) AS sy, sum(x.r * y.r) AS sxy, sum(x.r * x.r) AS sxx, sum(y.r * y.r) AS syy
  FROM pairs p LEFT JOIN (rating x JOIN rating y ON x.u = y.u) ON x.i = p.i AND y.i = p.j GROUP BY 1, 2),
im AS (SELECT i, avg(r) AS m FROM rating GROUP BY 1), um AS (SELECT u, avg(r) AS m FROM rating GROUP BY 1),
sim AS (SELECT co.i, co.j, round(CASE WHEN n < 2 THEN (5 - abs(a.m - b.m)) / 5 WHEN sxx - sx * sx / n <= 1e-9 OR syy - sy * sy / n <= 1e-9 THEN 0
  ELSE (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) END, 8) AS sim FROM co JOIN im a ON a.i = co.i JOIN im b ON b.i = co.j)"""


def _predict_sql(variant: int) -> str:
    same = " AND asked.i <> rating.i" if variant == 3 else ""
    positive = "WHERE sim > 0" if variant == 1 else ""
    last = "CASE WHEN um.m IS NULL THEN 2.5 WHEN im.m IS NULL THEN um.m ELSE coalesce(num / nullif(den, 0), im.m) END" if variant == 1 else "coalesce(num / nullif(den, 0), 2.5)"
    return f"""WITH {_RATINGS}, {_ASKED},
near AS (SELECT asked.u, asked.i, rating.i AS j, r FROM asked JOIN rating ON asked.u = rating.u{same} WHERE asked.i IN (SELECT i FROM rating)),
pairs AS (SELECT DISTINCT i, j FROM near), {_SIM},
top AS (SELECT near.u, near.i, r, sim, row_number() OVER (PARTITION BY near.u, near.i ORDER BY sim DESC, near.j) AS rn FROM near JOIN sim USING (i, j) {positive}),
cf AS (SELECT u, i, sum(sim * r) AS num, sum(abs(sim)) AS den FROM top WHERE rn <= 15 GROUP BY 1, 2)
SELECT asked.u AS user, asked.i AS item, round({last}, 8) AS prediction FROM asked LEFT JOIN cf ON cf.u = asked.u AND cf.i = asked.i
LEFT JOIN um ON um.u = asked.u LEFT JOIN im ON im.i = asked.i"""


def _lines(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.join(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax"), F.col("o_orderkey") == F.col("l_orderkey"))


def _ratings(spark, sf_dir):
    return recommend.ratings_of(_lines(spark, sf_dir).where("o_orderkey % 10 <> 0"), "o_custkey", "l_partkey", F.col("l_quantity")).withColumn("rating", F.col("rating") / 10)


def _asked(spark, sf_dir):
    """All that the training split leaves out."""
    return _lines(spark, sf_dir).where("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).distinct()


@query("item_pearson", f"WITH {_RATINGS}, pairs AS (SELECT DISTINCT x.i, y.i AS j FROM rating x JOIN rating y ON x.u = y.u AND x.i < y.i), {_SIM} SELECT i, j, sim FROM sim")
def item_pearson(spark, sf_dir):
    """All pairs of items that a user has both rated."""
    return recommend.item_similarity(_ratings(spark, sf_dir))


def _cf(name, variant):
    @query(name, _predict_sql(variant))
    def run(spark, sf_dir):
        return recommend.predict(_ratings(spark, sf_dir), _asked(spark, sf_dir), variant).withColumn("prediction", F.round("prediction", 8))


for _i in (1, 2, 3):
    _cf(f"cf_predict_v{_i}", _i)

_FEATURES = {
    "features_v1": (["um_q", "um_d", "um_t", "u_avg", "u_n", "u_bal", "i_price", "i_n"], {"um_q": 0.0, "um_d": 0.0, "um_t": 0.0, "u_avg": 3.0, "u_n": 0.0, "u_bal": 0.0, "i_price": 3.0, "i_n": 0.0}),
    "features_v2": (["um_q", "um_d", "um_t", "u_avg", "u_n", "u_bal", "i_price", "i_n"], dict.fromkeys(["um_q", "um_d", "um_t", "u_avg", "u_n", "u_bal", "i_price", "i_n"], 0.0)),
    "features_v3": (["u_n", "u_avg", "u_bal", "u_years", "u_urgent", "um_q", "um_d", "um_t", "u_seg", "i_n", "i_price", "i_size", "i_promo", "i_steel", "i_q"], {"u_n": 0.0, "u_avg": 0.0, "u_bal": 0.0, "u_years": 0.0, "u_urgent": 0.0, "um_q": 0.0, "um_d": 0.0, "um_t": 0.0, "u_seg": 0.0, "i_n": 0.0, "i_price": 0.0, "i_size": 0.0, "i_promo": 0.0, "i_steel": 0.0, "i_q": 0.0}),
    "features_v4": (["u_n", "u_bal", "u_avg", "i_price", "i_n"], dict.fromkeys(["u_n", "u_bal", "u_avg", "i_price", "i_n"])),
}
#: The year against which ages are taken, so that results don't depend on the day.
YEAR = 2024
_FEATURE_SQL = f"""line AS (SELECT * FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 10 <> 0),
uf AS (SELECT o_custkey AS u, avg(l_quantity) AS um_q, avg(l_discount) AS um_d, avg(l_tax) AS um_t FROM line GROUP BY 1),
uo AS (SELECT o_custkey AS u, avg(o_totalprice) AS u_avg, CAST(count(*) AS DOUBLE) AS u_n, CAST({YEAR} - min(year(o_orderdate)) AS DOUBLE) AS u_years, CAST(count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS DOUBLE) AS u_urgent FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY 1),
uc AS (SELECT c_custkey AS u, c_acctbal AS u_bal, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END AS u_seg FROM customer),
ul AS (SELECT uc.u, um_q, um_d, um_t, u_avg, u_n, u_years, u_urgent, u_bal, CAST(u_seg AS DOUBLE) AS u_seg FROM uc LEFT JOIN uf USING (u) LEFT JOIN uo USING (u)),
ic AS (SELECT l_partkey AS i, CAST(count(*) AS DOUBLE) AS i_n, avg(l_quantity) AS i_q FROM line GROUP BY 1),
il AS (SELECT p_partkey AS i, p_retailprice AS i_price, CAST(p_size AS DOUBLE) AS i_size, CAST(CASE WHEN p_type LIKE 'PROMO%' THEN 1 ELSE 0 END AS DOUBLE) AS i_promo, CAST(CASE WHEN p_type LIKE '%STEEL' THEN 1 ELSE 0 END AS DOUBLE) AS i_steel, i_n, i_q FROM part LEFT JOIN ic ON p_partkey = i)"""


def user_features(spark, sf_dir):
    line = _lines(spark, sf_dir).where("o_orderkey % 10 <> 0")
    uf = line.groupBy(F.col("o_custkey").alias("user")).agg(F.avg("l_quantity").alias("um_q"), F.avg("l_discount").alias("um_d"), F.avg("l_tax").alias("um_t"))
    orders = load(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0")
    uo = orders.groupBy(F.col("o_custkey").alias("user")).agg(
        F.avg("o_totalprice").alias("u_avg"), F.count("*").cast("double").alias("u_n"), (F.lit(YEAR) - F.min(F.year("o_orderdate"))).cast("double").alias("u_years"), F.count_if(F.col("o_orderpriority").startswith("1")).cast("double").alias("u_urgent")
    )
    uc = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), F.col("c_acctbal").alias("u_bal"), F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(0.0).alias("u_seg"))
    return uc.join(uf, "user", "left").join(uo, "user", "left")


def item_features(spark, sf_dir):
    ic = _lines(spark, sf_dir).where("o_orderkey % 10 <> 0").groupBy(F.col("l_partkey").alias("item")).agg(F.count("*").cast("double").alias("i_n"), F.avg("l_quantity").alias("i_q"))
    p = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item"), F.col("p_retailprice").alias("i_price"), F.col("p_size").cast("double").alias("i_size"),
        F.when(F.col("p_type").startswith("PROMO"), 1.0).otherwise(0.0).alias("i_promo"), F.when(F.col("p_type").endswith("STEEL"), 1.0).otherwise(0.0).alias("i_steel"),
    )
    return p.join(ic, "item", "left")


def _features(name, cols, defaults):
    digits = {c: 6 if c == "u_avg" else 9 for c in cols}  # means of prices are the largest
    picked = ", ".join(f"round(coalesce({c}, {defaults[c]}), {digits[c]}) AS {c}" if defaults[c] is not None else f"round({c}, {digits[c]}) AS {c}" for c in cols)

    @query(name, f"WITH {_ASKED}, {_FEATURE_SQL} SELECT asked.u AS user, asked.i AS item, {picked} FROM asked LEFT JOIN ul ON ul.u = asked.u LEFT JOIN il ON il.i = asked.i")
    def run(spark, sf_dir):
        f = recommend.join_features(_asked(spark, sf_dir), user_features(spark, sf_dir), item_features(spark, sf_dir), defaults)
        return f.select("user", "item", *[F.round(c, digits[c]).alias(c) for c in cols])


for _name, (_cols, _defaults) in _FEATURES.items():
    _features(_name, _cols, _defaults)


@query("zscore", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / (stddev_pop(c_acctbal) OVER () + 1e-8), 6) AS c_acctbal FROM customer")
def zscore(spark, sf_dir):
    return analytics.zscores(load(spark, sf_dir, "customer"), ["c_acctbal"], ["c_custkey"]).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


_TRUTH = "truth AS (SELECT o_custkey AS u, l_partkey AS i, avg(l_quantity) / 10 AS t FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 10 = 0 GROUP BY 1, 2), guess AS (SELECT p_partkey AS i, p_size / 10.0::DOUBLE AS g FROM part)"


def _scored(spark, sf_dir):
    truth = recommend.ratings_of(_lines(spark, sf_dir).where("o_orderkey % 10 = 0"), "o_custkey", "l_partkey", F.col("l_quantity")).withColumn("rating", F.col("rating") / 10)
    return truth.join(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), (F.col("p_size") / 10.0).alias("guess")), "item")


@query("rmse", f"WITH {_TRUTH} SELECT round(sqrt(avg(pow(g - t, 2))), 6) AS rmse FROM truth JOIN guess USING (i)")
def rmse(spark, sf_dir):
    return analytics.rmse(_scored(spark, sf_dir), "guess", "rating").select(F.round("rmse", 6).alias("rmse"))


@query("error_histogram", f"WITH {_TRUTH} SELECT CASE WHEN e < 1 THEN '0-1' WHEN e < 2 THEN '1-2' WHEN e < 3 THEN '2-3' WHEN e < 4 THEN '3-4' ELSE '4-inf' END AS bin, CAST(count(*) AS BIGINT) AS n FROM (SELECT abs(g - t) AS e FROM truth JOIN guess USING (i)) GROUP BY 1")
def error_histogram(spark, sf_dir):
    return analytics.error_histogram(_scored(spark, sf_dir), "guess", "rating")


_GBT = ["um_q", "u_avg", "u_n", "u_bal", "i_price", "i_n", "i_q"]


def _gbt(spark, sf_dir):
    zero = dict.fromkeys(_GBT, 0.0)
    uf, itf = user_features(spark, sf_dir), item_features(spark, sf_dir)
    train = recommend.join_features(_ratings(spark, sf_dir), uf, itf, zero)
    return recommend.boosted_trees(recommend.check_matrix(train, _GBT), recommend.join_features(_asked(spark, sf_dir), uf, itf, zero), _GBT, trees=100)


@query("gbt_predict", None)
def gbt_predict(spark, sf_dir):
    return _gbt(spark, sf_dir).select("user", "item", "prediction")


@query("als_predict", None)
def als_predict(spark, sf_dir):
    return recommend.factorise(_ratings(spark, sf_dir), _asked(spark, sf_dir))


@query("hybrid_predict", None)
def hybrid_predict(spark, sf_dir):
    return recommend.hybrid(recommend.predict(_ratings(spark, sf_dir), _asked(spark, sf_dir), 2), _gbt(spark, sf_dir), 0.1)


# ---------------------------------------------------------------- graphs
_LEAST = 7
_EDGES = f"""r AS (SELECT DISTINCT o_custkey AS u, l_partkey AS i FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
edge AS (SELECT x.u AS src, y.u AS dst, count(*) AS common FROM r x JOIN r y ON x.i = y.i AND x.u < y.u GROUP BY 1, 2 HAVING count(*) >= {_LEAST}),
both_ways AS (SELECT src, dst FROM edge UNION SELECT dst, src FROM edge), node AS (SELECT DISTINCT src AS id FROM both_ways)"""


def _edges(spark, sf_dir):
    from siltflow.operators.lineage import cut

    return cut(graph.co_interaction(_lines(spark, sf_dir), "o_custkey", "l_partkey", _LEAST))


@query("graph_edges", f"WITH {_EDGES} SELECT src, dst, CAST(common AS BIGINT) AS common FROM edge")
def graph_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query("graph_nodes", f"WITH {_EDGES} SELECT id FROM node")
def graph_nodes(spark, sf_dir):
    return graph.nodes(_edges(spark, sf_dir))


@query("graph_degree", f"WITH {_EDGES} SELECT src AS id, CAST(count(*) AS BIGINT) AS degree FROM both_ways GROUP BY 1")
def graph_degree(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


_REACH = "reach(id, other) AS (SELECT id, id FROM node UNION SELECT reach.id, dst FROM reach JOIN both_ways ON other = src), cc AS (SELECT id, min(other) AS component FROM reach GROUP BY 1)"


@query("graph_components", f"WITH RECURSIVE {_EDGES}, {_REACH} SELECT id, component FROM cc")
def graph_components(spark, sf_dir):
    return graph.connected_components(_edges(spark, sf_dir))


def _lpa_sql(rounds: int = 5) -> str:
    out = "l0 AS (SELECT id, id AS label FROM node)"
    for i in range(rounds):
        out += f", l{i + 1} AS (SELECT id, label FROM (SELECT dst AS id, label, row_number() OVER (PARTITION BY dst ORDER BY count(*) DESC, label) AS rn FROM both_ways JOIN l{i} ON src = id GROUP BY dst, label) WHERE rn = 1)"
    return out


@query("graph_lpa5", f"WITH {_EDGES}, {_lpa_sql()} SELECT id, label FROM l5")
def graph_lpa5(spark, sf_dir):
    return graph.label_propagation(_edges(spark, sf_dir), 5)


@query("community_report", f"WITH {_EDGES}, {_lpa_sql()}, m AS (SELECT label, list_sort(list(id)) AS members FROM l5 GROUP BY 1) SELECT CAST(len(members) AS INTEGER) AS size, array_to_string(list_transform(members, lambda x: '''' || x || ''''), ', ') AS line FROM m")
def community_report(spark, sf_dir):
    return graph.community_lines(graph.label_propagation(_edges(spark, sf_dir), 5)).select("size", "line")


@query("graph_triangles", f"WITH {_EDGES}, t AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM edge a JOIN edge b ON a.dst = b.src JOIN edge c ON c.src = a.src AND c.dst = b.dst) SELECT id, CAST(count(*) AS BIGINT) AS triangles FROM (SELECT x AS id FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t) GROUP BY 1")
def graph_triangles(spark, sf_dir):
    return graph.triangles(_edges(spark, sf_dir))


def _pagerank_sql(rounds: int = 6) -> str:
    out = f"{_EDGES}, link AS (SELECT src, dst FROM both_ways), v AS (SELECT id FROM node), deg AS (SELECT src, count(*) AS d FROM link GROUP BY 1), p0 AS (SELECT id, CAST(1 AS DOUBLE) AS rank FROM v)"
    for i in range(rounds):
        out += f", p{i + 1} AS (SELECT v.id, 0.15 + 0.85 * coalesce(sum(rank / d), 0) AS rank FROM v LEFT JOIN (link JOIN deg USING (src) JOIN p{i} ON p{i}.id = src) ON dst = v.id GROUP BY v.id)"
    return f"WITH {out} SELECT id, round(rank, 9) AS rank FROM p{rounds}"


@query("graph_pagerank", _pagerank_sql())
def graph_pagerank(spark, sf_dir):
    return graph.pagerank(graph.both_ways(_edges(spark, sf_dir)), 6).select("id", F.round("rank", 9).alias("rank"))


@query("graph_tc", f"WITH RECURSIVE {_EDGES}, tc AS (SELECT src, dst FROM edge UNION SELECT tc.src, edge.dst FROM tc JOIN edge ON tc.dst = edge.src) SELECT src, dst FROM tc")
def graph_tc(spark, sf_dir):
    return graph.transitive_closure(_edges(spark, sf_dir))


@query("graph_sssp", f"WITH RECURSIVE {_EDGES}, s AS (SELECT min(id) AS id FROM node), walk(id, d) AS (SELECT id, 0 FROM s UNION SELECT dst, d + 1 FROM walk JOIN both_ways ON id = src WHERE d < 30) SELECT id, CAST(min(d) AS INTEGER) AS distance FROM walk GROUP BY 1")
def graph_sssp(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graph.shortest_paths(e, e.agg(F.min("src")).first()[0])


@query("graph_older_neighbours", f"WITH {_EDGES} SELECT b.dst AS id, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(round(x.c_acctbal * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100.0::DOUBLE) AS mean FROM both_ways b JOIN customer x ON x.c_custkey = b.src JOIN customer y ON y.c_custkey = b.dst WHERE x.c_acctbal > y.c_acctbal GROUP BY 1")
def graph_older_neighbours(spark, sf_dir):
    v = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.round(F.col("c_acctbal") * 100).cast("long").alias("value"))
    return graph.older_neighbours(_edges(spark, sf_dir), v).select("id", "n", (F.col("total").cast("double") / (F.col("n") * 100.0)).alias("mean"))


@query("betweenness", None)
def betweenness(spark, sf_dir):
    return graph.betweenness(_edges(spark, sf_dir))


_MOD = "m AS (SELECT count(*) AS m FROM edge), k AS (SELECT src AS id, count(*) AS k FROM both_ways GROUP BY 1), d AS (SELECT component, sum(k) AS d FROM k JOIN cc USING (id) GROUP BY 1), n AS (SELECT component, count(*) AS n FROM edge JOIN cc ON src = id GROUP BY 1)"


@query("modularity", f"WITH RECURSIVE {_EDGES}, {_REACH}, {_MOD} SELECT round(sum(n / m.m - pow(d / (2 * m.m), 2)), 6) AS modularity FROM d JOIN n USING (component), m")
def modularity(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graph.modularity(e, graph.connected_components(e).withColumnRenamed("component", "label")).select(F.round("modularity", 6).alias("modularity"))


@query("girvan_newman", None)
def girvan_newman(spark, sf_dir):
    return graph.girvan_newman(_edges(spark, sf_dir))


# ---------------------------------------------------------------- sketches
_STREAM = "st AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, CAST(user_id AS VARCHAR) AS x FROM events), str AS (SELECT seq, seq // 100 AS batch, x FROM st)"


def _fold(p: int) -> str:
    return f"CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(x, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, b: (h * 256 + b) % {p}) AS BIGINT)"


def _stream(spark, sf_dir):
    return sketches.numbered(load(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])


_BITS = ", ".join(f"(r * {a} + {b}) % {sketches.BLOOM_MOD} % {sketches.BLOOM_BITS}" for a, b in sketches.BLOOM_HASHES)


@query(
    "bloom_fpr",
    f"""WITH {_STREAM}, f AS (SELECT x, min(seq) AS seq FROM str GROUP BY 1), g AS (SELECT x, seq, seq // 100 AS batch, {_fold(sketches.BLOOM_MOD)} AS r FROM f),
e AS (SELECT x, seq, batch, unnest([{_BITS}]) AS bit FROM g), s AS (SELECT bit, min(seq) AS since FROM e GROUP BY 1),
h AS (SELECT x, batch, bool_and(since < seq) AS fp FROM e JOIN s USING (bit) GROUP BY x, batch), p AS (SELECT batch, count(*) AS negatives, count(*) FILTER (WHERE fp) AS false_positives FROM h GROUP BY 1)
SELECT b.batch, CAST(coalesce(negatives, 0) AS BIGINT) AS negatives, CAST(coalesce(false_positives, 0) AS BIGINT) AS false_positives, CASE WHEN negatives > 0 THEN round(false_positives / negatives, 6) ELSE 0 END AS fpr
FROM (SELECT DISTINCT batch FROM str) b LEFT JOIN p USING (batch)""",
)
def bloom_fpr(spark, sf_dir):
    return sketches.bloom_false_positives(_stream(spark, sf_dir)).withColumn("fpr", F.round("fpr", 6))


def _tz(a: int, b: int) -> str:
    v = f"((r * {a} + {b}) % {sketches.FM_MOD})"
    return f"pow(2, max(CASE WHEN {v} = 0 THEN 1 ELSE bit_count(({v} & -{v}) - 1) END))"


@query("fm_estimate", f"WITH {_STREAM}, g AS (SELECT batch, x, {_fold(sketches.FM_MOD)} AS r FROM str) SELECT batch, CAST(count(DISTINCT x) AS BIGINT) AS truth, CAST(list_sort([{', '.join(_tz(a, b) for a, b in sketches.FM_HASHES)}])[8] AS DOUBLE) AS estimate FROM g GROUP BY 1")
def fm_estimate(spark, sf_dir):
    return sketches.distinct_estimates(_stream(spark, sf_dir))


@query("fm_truth", f"WITH {_STREAM} SELECT batch, CAST(count(DISTINCT x) AS BIGINT) AS truth FROM str GROUP BY 1")
def fm_truth(spark, sf_dir):
    return _stream(spark, sf_dir).groupBy("batch").agg(F.count_distinct("x").alias("truth"))


@query("reservoir_bottomk", f"WITH {_STREAM} SELECT seq, x FROM str ORDER BY (seq % 2147483647 * 1103515245 + 12345) % 2147483647, seq LIMIT 100")
def reservoir_bottomk(spark, sf_dir):
    return sketches.bottom_k(_stream(spark, sf_dir), 100).select("seq", "x")


@query("reservoir_snapshots", None)
def reservoir_snapshots(spark, sf_dir):
    return sketches.reservoir_snapshots(_stream(spark, sf_dir))


@query("hll_compare", None)
def hll_compare(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("approx"), F.hll_sketch_estimate(F.hll_sketch_agg("user_id")).alias("sketch"), F.count_distinct("user_id").alias("exact"))


# ---------------------------------------------------------------- clustering
def _points(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("cluster"))


_DIM = 64
_STATS = "el AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), st AS (SELECT label AS cluster, d, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM el GROUP BY 1, 2)"


@query("bfr_stats", f"WITH {_STATS} SELECT cluster, CAST(max(n) AS BIGINT) AS n, list(round(s, 4) ORDER BY d) AS sum, list(round(q, 4) ORDER BY d) AS sumsq FROM st GROUP BY 1")
def bfr_stats(spark, sf_dir):
    s = clustering.statistics(_points(spark, sf_dir), _DIM)
    return s.select("cluster", "n", F.transform("sum", lambda x: F.round(x, 4)).alias("sum"), F.transform("sumsq", lambda x: F.round(x, 4)).alias("sumsq"))


@query(
    "bfr_assign",
    f"""WITH {_STATS}, dist AS (SELECT vec_id, cluster, sqrt(sum(CASE WHEN q / n - pow(s / n, 2) > 1e-12 THEN pow(x - s / n, 2) / (q / n - pow(s / n, 2)) ELSE 0 END)) AS d FROM el JOIN st USING (d) GROUP BY 1, 2),
b AS (SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM dist GROUP BY 1)
SELECT vec_id AS id, CASE WHEN d < 16 THEN cluster END AS cluster, CASE WHEN d < 16 THEN round(d, 4) END AS distance FROM b""",
)
def bfr_assign(spark, sf_dir):
    p = _points(spark, sf_dir)
    return clustering.assign(p.select("id", "v"), clustering.statistics(p, _DIM), _DIM).select("id", "cluster", F.round("distance", 4).alias("distance"))


@query("bfr_run", None)
def bfr_run(spark, sf_dir):
    return clustering.run(_points(spark, sf_dir).select("id", "v"), 10, _DIM)[1]


@query("kmeans", None)
def kmeans(spark, sf_dir):
    return clustering.kmeans(_points(spark, sf_dir).select("id", "v"), 10).groupBy("cluster").agg(F.count("*").alias("n"))
