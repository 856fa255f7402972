"""Queries of block, township and county features and of one simulated step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.domain import parcel, swap, table
from parcelspark.functions import codes
from parcelspark.operators import graph, metrics, order
from parcelspark.plans.expressions import _CLASS
from parcelspark.plans.registry import query


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.queen_edges(swap(spark, d).where("type_code > 0"))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(c, digits) if t == "double" else F.col(c)).alias(c) for c, t in df.dtypes))


_FREE = "NOT swapped AND NOT locked"
_W = "coalesce(sum(slope_mean * area_m2) FILTER ({0}) / sum(area_m2) FILTER ({0}), 0)"


@query("SELECT block, count(*) AS n, count(*) FILTER (type_code = 1) AS n_farm, count(*) FILTER (type_code = 2) AS n_forest, coalesce(sum(area_m2) FILTER (type_code = 1), 0) AS farm_area, coalesce(sum(area_m2) FILTER (type_code = 2), 0) AS forest_area, round(" + _W.format("type_code = 1") + ", 6) AS farm_slope, round(" + _W.format("type_code = 2") + ", 6) AS forest_slope FROM swap WHERE type_code > 0 GROUP BY block", "swap")
def block_features(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.block_features(swap(spark, d)))


@query(", b AS (SELECT block, count(*) AS n, sum(area_m2) AS a FROM swap WHERE type_code > 0 GROUP BY block) SELECT count(*) AS blocks, min(n) AS n_min, median(n) AS n_median, max(n) AS n_max, min(a) AS area_min, median(a) AS area_median, max(a) AS area_max, sum(a) AS area_total, count(*) FILTER (a >= 66700) AS over_667, count(*) FILTER (a >= 333000) AS over_333 FROM b", "swap")
def block_summary(spark: SparkSession, d: str) -> DataFrame:
    b = swap(spark, d).where("type_code > 0").groupBy("block").agg(F.count("*").alias("n"), F.sum("area_m2").alias("a"))
    middle = order.median(b, "n", "n_median").crossJoin(order.median(b, "a", "area_median"))
    return middle.crossJoin(_block_totals(b))


def _block_totals(b: DataFrame) -> DataFrame:
    return b.agg(F.count("*").alias("blocks"), F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.min("a").alias("area_min"), F.max("a").alias("area_max"), F.sum("a").alias("area_total"), F.count_if(F.col("a") >= 66700).alias("over_667"), F.count_if(F.col("a") >= 333000).alias("over_333"))


@query("SELECT block, count(*) AS n, sum(area_m2) / 10000 AS ha FROM swap WHERE type_code > 0 GROUP BY block HAVING count(*) >= 3 AND sum(area_m2) / 10000 >= 0.5", "swap")
def block_having(spark: SparkSession, d: str) -> DataFrame:
    return swap(spark, d).where("type_code > 0").groupBy("block").agg(F.count("*").alias("n"), (F.sum("area_m2") / 10000).alias("ha")).where("n >= 3 AND ha >= 0.5")


@query(f"SELECT block, count(*) FILTER (type_code = 1 AND {_FREE}) AS farm_free, count(*) FILTER (type_code = 2 AND {_FREE}) AS forest_free FROM swap WHERE type_code > 0 GROUP BY block", "swap")
def block_available(spark: SparkSession, d: str) -> DataFrame:
    free = metrics.is_free()
    return swap(spark, d).where("type_code > 0").groupBy("block").agg(F.count_if(metrics.is_farm() & free).alias("farm_free"), F.count_if(metrics.is_forest() & free).alias("forest_free"))


@query(f"SELECT block FROM swap GROUP BY block HAVING count(*) FILTER (type_code = 1 AND {_FREE}) > 0 AND count(*) FILTER (type_code = 2 AND {_FREE}) > 0", "swap")
def action_mask(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that still have a free farm and a free forest."""
    free = metrics.is_free()
    return swap(spark, d).groupBy("block").agg(F.count_if(metrics.is_farm() & free).alias("a"), F.count_if(metrics.is_forest() & free).alias("b")).where("a > 0 AND b > 0").select("block")


_PERIMETER = ", side AS (SELECT block, x0 AS a, y0 AS b, x1 AS c, y0 AS e FROM swap WHERE type_code > 0 UNION ALL SELECT block, x0, y1, x1, y1 FROM swap WHERE type_code > 0 UNION ALL SELECT block, x0, y0, x0, y1 FROM swap WHERE type_code > 0 UNION ALL SELECT block, x1, y0, x1, y1 FROM swap WHERE type_code > 0), once AS (SELECT block, a, b, c, e FROM side GROUP BY ALL HAVING count(*) = 1), per AS (SELECT block, sum(abs(a - c) + abs(b - e))::DOUBLE AS p FROM once GROUP BY block)"


@query(_PERIMETER + " SELECT s.block, round(4 * pi() * sum(s.area_m2) / pow(any_value(per.p), 2), 6) AS compactness FROM swap s JOIN per USING (block) WHERE type_code > 0 GROUP BY s.block", "swap")
def compactness(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.compactness(swap(spark, d).where("type_code > 0")))


_STATE = _PERIMETER + f""", own AS (SELECT *, type_code = 1 AND {_FREE} AS ff, type_code = 2 AND {_FREE} AS tf FROM swap WHERE type_code > 0),
b AS (SELECT block, {_W.format("ff")} AS farm, {_W.format("tf")} AS forest, coalesce(sum(slope_mean * slope_mean * area_m2) FILTER (ff) / sum(area_m2) FILTER (ff), 0) AS farm2, max(slope_mean) FILTER (ff) AS top, min(slope_mean) FILTER (tf) AS bottom,
 coalesce(sum(area_m2) FILTER (ff), 0) AS farm_free, coalesce(sum(area_m2) FILTER (tf), 0) AS forest_free, least(count(*) FILTER (ff), count(*) FILTER (tf)) AS pairs, count(*) AS n, count(*) FILTER (swapped) AS sw, sum(area_m2) AS area, coalesce(sum(area_m2) FILTER (type_code = 1), 0) AS farm_area FROM own GROUP BY block),
be AS (SELECT DISTINCT a.block AS bs, c.block AS bd FROM edge JOIN swap a ON a.bsm = src JOIN swap c ON c.bsm = dst WHERE a.block <> c.block),
near AS (SELECT bs AS block, count(*) FILTER (sw > 0) AS k, count(*) AS adj, sum(farm_area) AS fn FROM be JOIN b ON b.block = bd GROUP BY bs),
e AS (SELECT min(slope_mean) AS lo, 1 / (max(slope_mean) - min(slope_mean) + 1e-8) AS inv, (SELECT max(area) FROM b) AS w FROM own)
SELECT b.block, round((farm - lo) * inv, 6) AS f0, round((forest - lo) * inv, 6) AS f1, round((farm - forest) * inv, 6) AS f2, round(coalesce((top - bottom) * inv, 0), 6) AS f3, round(sqrt(greatest(farm2 - farm * farm, 0)) * inv, 5) AS f4, round(coalesce((top - lo) * inv, 0), 6) AS f5, round(coalesce((bottom - lo) * inv, 0), 6) AS f6,
 round(farm_free / w, 6) AS f7, round(forest_free / w, 6) AS f8, round(pairs / n, 6) AS f9, round(sw / 2 / 5, 6) AS f10, round(4 * pi() * area / pow(p, 2), 6) AS f11, round(area / w, 6) AS f12, round(coalesce(k / adj, 0), 6) AS f13, round(coalesce(fn / (w * adj), 0), 6) AS f14, round(farm_area / w, 6) AS f15, CAST(sw > 0 AS INT)::DOUBLE AS f16
FROM b JOIN per USING (block) LEFT JOIN near USING (block) CROSS JOIN e"""


@query(_STATE, "edge")
def block_state_features(spark: SparkSession, d: str) -> DataFrame:
    s = swap(spark, d)
    x = metrics.block_state(s, graph.block_adjacency(_edges(spark, d), s.select("bsm", "block")))
    return _rounded(x.withColumn("f4", F.round("f4", 5)))


@query(", t AS (SELECT township, count(*) AS n FROM swap WHERE swapped GROUP BY township), p AS (SELECT n / sum(n) OVER () AS p, count(*) OVER () AS k FROM t) SELECT round(-sum(p * ln(p)), 6) AS entropy, round(-sum(p * ln(p)) / (ln(any_value(k)) + 1e-8), 6) AS relative, round(max(p), 6) AS max_share FROM p", "swap")
def investment_entropy(spark: SparkSession, d: str) -> DataFrame:
    """How evenly swaps are spread over townships; at most one row per township reaches the window-free sums."""
    t = swap(spark, d).where("swapped").groupBy("township").agg(F.count("*").alias("n"))
    s = t.agg(F.sum("n").alias("t"), F.count("*").alias("k"), F.sum(F.col("n") * F.ln("n")).alias("nln"), F.max("n").alias("m"))
    h = F.ln("t") - F.col("nln") / F.col("t")
    return s.select(F.round(h, 6).alias("entropy"), F.round(h / (F.ln("k") + 1e-8), 6).alias("relative"), F.round(F.col("m") / F.col("t"), 6).alias("max_share"))


@query("SELECT township, count(DISTINCT block) AS blocks, count(*) FILTER (swapped) AS swaps, count(DISTINCT block) FILTER (swapped) AS invested, round(" + _W.format("type_code = 1") + ", 6) AS slope, sum(area_m2) / 10000 AS ha FROM swap WHERE type_code > 0 GROUP BY township", "swap")
def township_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Two levels: blocks of a township first, then townships, so no distinct is expanded."""
    s = swap(spark, d).where("type_code > 0")
    farm = metrics.is_farm()
    b = s.groupBy("township", "block").agg(F.count_if("swapped").alias("k"), F.sum(F.when(farm, F.col("slope_mean") * F.col("area_m2"))).alias("sa"), F.sum(F.when(farm, F.col("area_m2"))).alias("fa"), F.sum("area_m2").alias("a"))
    return _rounded(b.groupBy("township").agg(F.count("*").alias("blocks"), F.sum("k").alias("swaps"), F.count_if(F.col("k") > 0).alias("invested"), F.coalesce(F.try_divide(F.sum("sa"), F.sum("fa")), F.lit(0.0)).alias("slope"), (F.sum("a") / 10000).alias("ha")))


_PATCH = "{n}(id, l) USING KEY (id) AS (SELECT bsm, bsm FROM swap WHERE {k} = 1 UNION SELECT e.dst, min(c.l) FROM {n} c JOIN edge e ON e.src = c.id JOIN swap a ON a.bsm = e.src JOIN swap b ON b.bsm = e.dst JOIN recurring.{n} o ON o.id = e.dst WHERE {ka} = 1 AND {kb} = 1 AND c.l < o.l GROUP BY e.dst)"
_KIND = {"now": "{t}type_code", "was": "CASE WHEN {t}type_code > 0 AND {t}swapped THEN 3 - {t}type_code ELSE {t}type_code END"}


def _global_sql() -> str:
    """The twelve entries from scratch: state now, and the state before the swaps (swapped parcels with the other type)."""
    kind = lambda which, t="": _KIND[which].format(t=t)
    cc = _PATCH.format(n="cc", k=kind("now"), ka=kind("now", "a."), kb=kind("now", "b."))
    state = lambda name, which: f"{name} AS (SELECT sum(slope_mean * area_m2) FILTER ({kind(which)} = 1) / greatest(sum(area_m2) FILTER ({kind(which)} = 1), 1e-8) AS slope, count(*) FILTER ({kind(which)} = 1) AS nf, sum(area_m2) FILTER ({kind(which)} = 1) AS area FROM swap WHERE type_code > 0)"
    links = lambda name, which: f"{name} AS (SELECT count(*) AS e FROM edge JOIN swap a ON a.bsm = src JOIN swap b ON b.bsm = dst WHERE {kind(which, 'a.')} = 1 AND {kind(which, 'b.')} = 1)"
    patch = "pt AS (SELECT count(*) FILTER (area >= 66700) AS k, coalesce(sum(area) FILTER (area >= 66700), 0) AS a FROM (SELECT l, sum(area_m2) AS area FROM cc JOIN swap ON bsm = id GROUP BY l))"
    rest = "r AS (SELECT min(slope_mean) AS lo, max(slope_mean) AS hi, count(*) FILTER (swapped) / 2 AS sw, count(DISTINCT block) AS nb, count(DISTINCT block) FILTER (swapped) AS inv, count(DISTINCT township) AS nt FROM swap WHERE type_code > 0)"
    town = "q AS (SELECT k / sum(k) OVER () AS q FROM (SELECT township, count(*) AS k FROM swap WHERE type_code > 0 AND swapped GROUP BY township)), qs AS (SELECT -sum(q * ln(q)) AS h, max(q) AS top FROM q)"
    entries = ["1 - sw / 1e5", "(n.slope - lo) / (hi - lo + 1e-8)", "ne.e / greatest(n.nf, 1) / 10", "sw / 1e5", "(w.slope - n.slope) / (abs(w.slope) + 1e-8)"]
    entries += ["(ne.e / greatest(n.nf, 1) - we.e / greatest(w.nf, 1)) / (abs(we.e / greatest(w.nf, 1)) + 1e-8)", "pt.k / greatest(nb / 10, 1)", "pt.a / greatest(n.area, 1e-8)", "inv / nb"]
    entries += ["CASE WHEN nt > 1 THEN coalesce(h, 0) / (ln(nt) + 1e-8) ELSE 0 END", "0.0::DOUBLE", "coalesce(top, 0)"]
    named = ", ".join(f"round({x}, 6) AS g{i}" for i, x in enumerate(entries))
    return f", {cc}, {patch}, {state('n', 'now')}, {state('w', 'was')}, {links('ne', 'now')}, {links('we', 'was')}, {rest}, {town} SELECT {named} FROM n, w, ne, we, pt, r, qs"


@query(_global_sql(), "edge")
def global_features(spark: SparkSession, d: str) -> DataFrame:
    """The county observation: twelve entries; before its swaps a swapped parcel had the other type, steps are swaps / 2 of 100 000."""
    s = swap(spark, d).where("type_code > 0").withColumn("was", F.when(F.col("swapped"), 3 - F.col("type_code")).otherwise(F.col("type_code")))
    farm, was = metrics.is_farm(), F.col("was") == 1
    m = s.agg(metrics.weighted("slope_mean", "area_m2", farm).alias("slope"), metrics.weighted("slope_mean", "area_m2", was).alias("slope0"), F.count_if(farm).alias("nf"), F.count_if(was).alias("nf0"), F.sum(F.when(farm, F.col("area_m2"))).alias("area"), F.count_if("swapped").alias("sw"), F.min("slope_mean").alias("lo"), F.max("slope_mean").alias("hi"), F.countDistinct("block").alias("nb"), F.countDistinct(F.when(F.col("swapped"), F.col("block"))).alias("inv"), F.countDistinct("township").alias("nt"))
    edges = _edges(spark, d)
    k = lambda side: s.select(F.col("bsm").alias(side), F.col("was").alias(f"{side}_was"))
    both = edges.join(k("src"), "src").join(k("dst"), "dst")
    e = both.agg(F.count_if((F.col("ts") == 1) & (F.col("td") == 1)).alias("e"), F.count_if((F.col("src_was") == 1) & (F.col("dst_was") == 1)).alias("e0"))
    big = F.col("area") >= 66700
    p = graph.patches(s).agg(F.count_if(big).alias("pk"), F.coalesce(F.sum(F.when(big, F.col("area"))), F.lit(0.0)).alias("pa"))
    towns = s.where("swapped").groupBy("township").agg(F.count("*").alias("k"))
    q = towns.crossJoin(F.broadcast(towns.agg(F.sum("k").alias("t")))).select((F.col("k") / F.col("t")).alias("q"))  # one row
    q = q.agg((-F.sum(F.col("q") * F.log("q"))).alias("h"), F.coalesce(F.max("q"), F.lit(0.0)).alias("top"))
    used, c = F.col("sw") / 2 / 1e5, F.col
    cont, cont0 = c("e") / F.greatest("nf", F.lit(1)), c("e0") / F.greatest("nf0", F.lit(1))
    spread = F.when(c("nt") > 1, F.coalesce("h", F.lit(0.0)) / (F.log(c("nt")) + 1e-8)).otherwise(0.0)
    g = [1 - used, (c("slope") - c("lo")) / (c("hi") - c("lo") + 1e-8), cont / 10, used, (c("slope0") - c("slope")) / (F.abs("slope0") + 1e-8), (cont - cont0) / (F.abs(cont0) + 1e-8), c("pk") / F.greatest(c("nb") / 10, F.lit(1)), c("pa") / F.greatest(c("area"), F.lit(1e-8)), c("inv") / c("nb"), spread, F.lit(0.0), c("top")]
    one = m.crossJoin(e).crossJoin(p).crossJoin(q)  # one row each
    return one.select(*(F.round(x, 6).alias(f"g{i}") for i, x in enumerate(g)))


_PAIR = f", nb AS (SELECT src AS bsm, count(*) FILTER (td = 1) AS k FROM edge GROUP BY src), x AS (SELECT s.*, coalesce(k, 0) AS k FROM swap s LEFT JOIN nb USING (bsm) WHERE type_code > 0 AND {_FREE}), f AS (SELECT block, bsm AS farm, slope_mean AS v, row_number() OVER (PARTITION BY block ORDER BY slope_mean - 0.5 * k DESC, bsm) AS r FROM x WHERE type_code = 1), t AS (SELECT block, bsm AS forest, slope_mean AS u, row_number() OVER (PARTITION BY block ORDER BY slope_mean - 1.0 * k, bsm) AS r FROM x WHERE type_code = 2), pair AS (SELECT f.block, farm, forest, v - u AS gain FROM f JOIN t ON f.block = t.block AND f.r = 1 AND t.r = 1 WHERE v > u)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    nbrs = _edges(spark, d).groupBy(F.col("src").alias("bsm")).agg(F.count_if(F.col("td") == 1).alias("farm_nbrs"))
    return metrics.greedy_pairs(swap(spark, d), nbrs)


@query(_PAIR + " SELECT block, farm, forest, round(gain, 6) AS gain FROM pair", "edge")
def greedy_pair(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_pairs(spark, d))


_MOVED = ", m AS (SELECT farm AS bsm, 2 AS new FROM pair UNION ALL SELECT forest, 1 FROM pair)"


@query(_PAIR + _MOVED + " SELECT count(*) FILTER (new IS NOT NULL) // 2 AS swaps, sum(area_m2) FILTER (coalesce(new, type_code) = 1) AS farm_area, round(sum(slope_mean * area_m2) FILTER (coalesce(new, type_code) = 1) / sum(area_m2) FILTER (coalesce(new, type_code) = 1), 6) AS slope FROM swap LEFT JOIN m USING (bsm) WHERE type_code > 0", "edge")
def one_step_swap(spark: SparkSession, d: str) -> DataFrame:
    """County farmland after one greedy pair in every block."""
    p = _pairs(spark, d)
    moved = p.select(F.explode(F.array(F.struct(F.col("farm").alias("bsm"), F.lit(2).alias("new")), F.struct(F.col("forest").alias("bsm"), F.lit(1).alias("new")))).alias("m")).select("m.bsm", "m.new")
    s = swap(spark, d).where("type_code > 0").join(moved, "bsm", "left")
    now = F.coalesce("new", "type_code") == 1
    area = F.sum(F.when(now, F.col("area_m2")))
    return s.agg((F.count("new") / 2).cast("long").alias("swaps"), area.alias("farm_area"), F.round(F.sum(F.when(now, F.col("slope_mean") * F.col("area_m2"))) / area, 6).alias("slope"))


@query(_PAIR + _MOVED + ", l AS (SELECT bsm, coalesce(new, type_code) AS now FROM swap LEFT JOIN m USING (bsm) WHERE type_code > 0) SELECT src AS bsm, count(*) FILTER (now = 1) - count(*) FILTER (td = 1) AS change FROM edge JOIN l ON l.bsm = dst GROUP BY src HAVING change <> 0", "edge")
def swap_delta(spark: SparkSession, d: str) -> DataFrame:
    """Change of farmland neighbours per parcel: the moved parcels' signs summed over their edges only."""
    p = _pairs(spark, d)
    moved = p.select(F.explode(F.array(F.struct(F.col("farm").alias("dst"), F.lit(-1).alias("sign")), F.struct(F.col("forest").alias("dst"), F.lit(1).alias("sign")))).alias("m")).select("m.dst", "m.sign")
    return _edges(spark, d).join(moved, "dst").groupBy(F.col("src").alias("bsm")).agg(F.sum("sign").alias("change")).where("change <> 0")


@query(f"SELECT category, count(*) AS n, sum(area_m2) / 10000 AS ha, count(*) FILTER (locked) AS locked FROM (SELECT s.*, CASE WHEN {_CLASS} IN ('farmland', 'forest', 'orchard') THEN upper(substr({_CLASS}, 1, 1)) || substr({_CLASS}, 2) ELSE 'Other' END AS category FROM swap s) GROUP BY category", "swap")
def fusion_summary(spark: SparkSession, d: str) -> DataFrame:
    return swap(spark, d).groupBy(codes.fusion_category(F.col("dlbm")).alias("category")).agg(F.count("*").alias("n"), (F.sum("area_m2") / 10000).alias("ha"), F.count_if("locked").alias("locked"))


@query("SELECT count(*) AS n, count(*) FILTER (eco > 1) AS eco, count(*) FILTER (pbf > 1) AS pbf, count(*) FILTER (eco > 1 AND pbf > 1) AS both, count(*) FILTER (eco > 1 OR pbf > 1) AS locked, count(*) FILTER (pbf > 1 AND type_code = 2) AS forest_review, count(*) FILTER (eco > 1 AND type_code = 1) AS farm_review FROM (SELECT *, bsm % 4 * 0.5 AS eco, bsm % 5 * 0.4 AS pbf FROM swap)", "swap")
def constraint_report(spark: SparkSession, d: str) -> DataFrame:
    eco, pbf = F.col("bsm") % 4 * 0.5 > 1, F.col("bsm") % 5 * 0.4 > 1
    return swap(spark, d).agg(F.count("*").alias("n"), F.count_if(eco).alias("eco"), F.count_if(pbf).alias("pbf"), F.count_if(eco & pbf).alias("both"), F.count_if(eco | pbf).alias("locked"), F.count_if(pbf & metrics.is_forest()).alias("forest_review"), F.count_if(eco & metrics.is_farm()).alias("farm_review"))


@query(f"SELECT dlbm AS code, {_CLASS} AS kind, CASE WHEN dlbm IN ('1104', '0601') THEN 'unknown' ELSE 'current' END AS scheme, count(*) AS n FROM parcel GROUP BY ALL", "parcel")
def land_use_report(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("dlbm")
    return parcel(spark, d).groupBy(c.alias("code"), codes.classify_land_use(c).alias("kind"), codes.land_use_scheme(c).alias("scheme")).agg(F.count("*").alias("n"))


@query("SELECT scheme, CASE scheme WHEN 'current' THEN 'GB/T 21010-2017 / Third National Land Survey' ELSE 'unrecognized' END AS standard, count(*) AS feature_count, count(DISTINCT dlbm) AS codes FROM (SELECT dlbm, CASE WHEN dlbm IN ('1104', '0601') THEN 'unknown' ELSE 'current' END AS scheme FROM parcel) GROUP BY scheme", "parcel")
def land_use_standard(spark: SparkSession, d: str) -> DataFrame:
    """The standard behind the codes of each scheme."""
    scheme = codes.land_use_scheme(F.col("dlbm"))
    return parcel(spark, d).groupBy(scheme.alias("scheme")).agg(F.count("*").alias("feature_count"), F.count_distinct("dlbm").alias("codes")).withColumn("standard", codes.land_use_standard(F.col("scheme")))


@query("SELECT count(*) - count(DISTINCT l_orderkey) AS duplicates, count(*) FILTER (l_returnflag = '') AS blanks, count(*) FILTER (l_linestatus = 'O') AS open FROM lineitem")
def key_quality(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg((F.count("*") - F.countDistinct("l_orderkey")).alias("duplicates"), F.count_if(F.col("l_returnflag") == "").alias("blanks"), F.count_if(F.col("l_linestatus") == "O").alias("open"))


@query("SELECT township, count(*) AS n FROM swap WHERE type_code > 0 GROUP BY township HAVING count(*) >= 50", "swap")
def township_having(spark: SparkSession, d: str) -> DataFrame:
    return swap(spark, d).where("type_code > 0").groupBy("township").agg(F.count("*").alias("n")).where("n >= 50")


@query("SELECT block, min_by(dlbm, (-n, dlbm)) AS code FROM (SELECT block, dlbm, count(*) AS n FROM swap GROUP BY ALL) GROUP BY block", "swap")
def mode_county(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent code of each block; of equals the smallest."""
    n = swap(spark, d).groupBy("block", "dlbm").agg(F.count("*").alias("n"))
    return n.groupBy("block").agg(F.min(F.struct(-F.col("n"), F.col("dlbm").alias("c"))).alias("m")).select("block", F.col("m.c").alias("code"))


@query(", v AS (SELECT bsm, CASE WHEN bsm % 11 = 0 THEN NULL ELSE slope_mean END AS s FROM parcel) SELECT bsm, round(coalesce(s, (SELECT median(s) FROM v)), 6) AS slope FROM v", "parcel")
def median_fill(spark: SparkSession, d: str) -> DataFrame:
    """Missing and NaN slopes take the median of the finite ones."""
    v = parcel(spark, d).select("bsm", F.when(F.col("bsm") % 22 == 0, float("nan")).when(F.col("bsm") % 11 == 0, None).otherwise(F.col("slope_mean")).alias("raw"))
    v = v.select("bsm", F.when(~F.isnan("raw"), F.col("raw")).alias("s"))
    return v.crossJoin(F.broadcast(order.median(v, "s", "m"))).select("bsm", F.round(F.coalesce("s", "m"), 6).alias("slope"))


@query(", r AS (SELECT block, count(*) AS n, max(slope_mean) AS top FROM swap WHERE type_code = 1 GROUP BY block) SELECT block, round(top, 6) AS top, n FROM r ORDER BY top DESC, block LIMIT 50", "swap")
def topk_actions(spark: SparkSession, d: str) -> DataFrame:
    """The fifty blocks with the steepest farm: partial top-k per task, then one of them all. Slopes that round alike are equal, as in the SQL."""
    r = swap(spark, d).where("type_code = 1").groupBy("block").agg(F.count("*").alias("n"), F.round(F.max("slope_mean"), 6).alias("top"))
    return r.orderBy(F.desc("top"), "block").limit(50)


@query("SELECT block, min(bsm) FILTER (slope_mean = top) AS bsm FROM (SELECT *, max(slope_mean) OVER (PARTITION BY block) AS top FROM swap) GROUP BY block", "swap")
def argmax_first(spark: SparkSession, d: str) -> DataFrame:
    return swap(spark, d).groupBy("block").agg((-F.max(F.struct("slope_mean", (-F.col("bsm")).alias("b")))["b"]).alias("bsm"))


@query("SELECT round(median(s), 6) AS median_std, count(*) AS states FROM (SELECT stddev_pop(value) AS s FROM events GROUP BY user_id)")
def reward_std_median(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy("user_id").agg(F.stddev_pop("value").alias("s"))
    return _rounded(order.median(s, "s", "median_std").crossJoin(s.agg(F.count("*").alias("states"))))


@query("SELECT event_type, count(*) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS sd, round((avg(v) / any_value(base) - 1) * 100, 4) AS uplift_pct FROM (SELECT event_type, user_id, sum(value) AS v FROM events GROUP BY ALL), (SELECT avg(v) AS base FROM (SELECT sum(value) AS v FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id)) GROUP BY event_type")
def cross_seed(spark: SparkSession, d: str) -> DataFrame:
    """Mean, sample deviation and uplift over the first policy of the totals of each run."""
    v = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.sum("value").alias("v"))
    s = v.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"))
    base = s.agg(F.min_by("mean", "event_type").alias("base"))
    return s.crossJoin(F.broadcast(base)).select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round((F.col("mean") / F.col("base") - 1) * 100, 4).alias("uplift_pct"))
