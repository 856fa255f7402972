"""Queries of write-back, audit, simulation histories and restoration units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelspark.domain import box_polygons, parcel, step, swap, table, unit, zone
from parcelspark.functions import codes
from parcelspark.operators import metrics, overlay, polygons, restoration, writeback
from parcelspark.plans.registry import query


def _state(spark: SparkSession, d: str) -> DataFrame:
    """Planned state of swappable parcels; some parcels occur twice, the later row holds."""
    s = swap(spark, d).where("type_code > 0 AND NOT locked").select("bsm", F.col("type_code").alias("before"))
    flip = F.when(F.col("bsm") % 5 == 0, 3 - F.col("before")).otherwise(F.col("before"))
    one = s.select("bsm", "before", flip.alias("after"), F.lit(0).alias("seq"))
    return one.unionByName(s.where("bsm % 20 = 0").select("bsm", "before", F.col("before").alias("after"), F.lit(1).alias("seq")))


_FLAG = "CASE WHEN type_code > 0 AND NOT locked AND bsm % 5 = 0 AND bsm % 20 <> 0 THEN type_code ELSE 0 END"


def _written(spark: SparkSession, d: str) -> DataFrame:
    return writeback.optimized(swap(spark, d), _state(spark, d))


@query(f"SELECT bsm, dlbm AS orig_dlbm, CASE {_FLAG} WHEN 1 THEN '0301' WHEN 2 THEN '0101' ELSE dlbm END AS opt_dlbm, {_FLAG} AS chg_flag FROM swap", "swap")
def optimized_writeback(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, d).select("bsm", "orig_dlbm", "opt_dlbm", "chg_flag")


@query("SELECT bsm, type_code > 0 AND NOT locked AS in_env FROM swap", "swap")
def writeback_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Every source parcel passes through; a parcel of the simulator is marked."""
    env = _state(spark, d).select("bsm").distinct().withColumn("e", F.lit(True))
    return parcel(spark, d).join(env, "bsm", "left").select("bsm", F.coalesce("e", F.lit(False)).alias("in_env"))


@query(f"SELECT count(*) AS n_input, count(*) FILTER (type_code > 0 AND NOT locked) AS in_env, count(*) FILTER ({_FLAG} = 1) AS farm_to_forest, count(*) FILTER ({_FLAG} = 2) AS forest_to_farm FROM swap", "swap")
def writeback_counts(spark: SparkSession, d: str) -> DataFrame:
    w = _written(spark, d)
    return w.agg(F.count("*").alias("n_input"), F.count_if((F.col("type_code") > 0) & ~F.col("locked")).alias("in_env"), F.count_if(F.col("chg_flag") == 1).alias("farm_to_forest"), F.count_if(F.col("chg_flag") == 2).alias("forest_to_farm"))


@query(f"SELECT bool_or(locked AND {_FLAG} > 0) AS locked_changed, bool_and(substr(qsdwdm, 1, 6) = '511011') AS one_county FROM swap", "swap")
def locked_violation(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, d).agg(F.bool_or(F.col("locked") & (F.col("chg_flag") > 0)).alias("locked_changed"), F.bool_and(F.substring("qsdwdm", 1, 6) == "511011").alias("one_county"))


@query("SELECT p_type AS code, min_by(p_name, p_partkey) AS name FROM part WHERE p_size > 10 GROUP BY p_type")
def code_name_lookup(spark: SparkSession, d: str) -> DataFrame:
    """First name of each code; parts with small sizes have none."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("bsm"), F.col("p_type").alias("dlbm"), F.when(F.col("p_size") > 10, F.col("p_name")).otherwise("").alias("dlmc"))
    return writeback.code_names(p).select(F.col("dlbm").alias("code"), F.col("dlmc").alias("name"))


_LABEL = f"CASE {_FLAG} WHEN 0 THEN 'unchanged' WHEN 1 THEN 'farmland to forest' ELSE 'forest to farmland' END"


def _label(flag):
    out = None
    for k, v in writeback.CHANGE_LABELS.items():
        out = F.when(flag == k, v) if out is None else out.when(flag == k, v)
    return out.otherwise("other")


@query(f"SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT {_LABEL} AS label FROM swap) GROUP BY label", "swap")
def change_summary(spark: SparkSession, d: str) -> DataFrame:
    """Aggregated first; the share needs the sum of at most four rows."""
    n = _written(spark, d).groupBy(_label(F.col("chg_flag")).alias("label")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("label", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query(f"SELECT bsm, {_LABEL} AS label, x0, y0 FROM swap WHERE {_FLAG} > 0", "swap")
def change_labels(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, d).where("chg_flag > 0").select("bsm", _label(F.col("chg_flag")).alias("label"), "x0", "y0")


@query(f"SELECT dlbm AS orig, CASE {_FLAG} WHEN 1 THEN '0301' WHEN 2 THEN '0101' ELSE dlbm END AS opt, count(*) AS n, sum(area_m2) AS area FROM swap GROUP BY ALL", "swap")
def landuse_transition(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, d).groupBy(F.col("orig_dlbm").alias("orig"), F.col("opt_dlbm").alias("opt")).agg(F.count("*").alias("n"), F.sum("area_m2").alias("area"))


@query("SELECT 'current' AS scheme, '0101' AS farm, '0301' AS forest")
def infer_swap_codes(spark: SparkSession, d: str) -> DataFrame:
    farm, forest = writeback.swap_codes(parcel(spark, d))
    return parcel(spark, d).agg(F.max(F.when(codes.land_use_scheme(F.col("dlbm")) != "unknown", codes.land_use_scheme(F.col("dlbm")))).alias("scheme")).withColumns({"farm": F.lit(farm), "forest": F.lit(forest)})


@query("SELECT count(*) FILTER (a AND b) AS common, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM (SELECT bsm % 5 = 0 AS a, bsm % 7 = 0 AS b FROM swap WHERE type_code > 0)", "swap")
def plan_diff(spark: SparkSession, d: str) -> DataFrame:
    """Changed parcels of two plans: one grouped pass instead of an intersect and two excepts."""
    s = swap(spark, d).where("type_code > 0").select("bsm")
    both = s.where("bsm % 5 = 0").withColumn("p", F.lit(1)).unionByName(s.where("bsm % 7 = 0").withColumn("p", F.lit(2)))
    bits = both.groupBy("bsm").agg(F.bit_or("p").alias("b"))
    return bits.agg(F.count_if(F.col("b") == 3).alias("common"), F.count_if(F.col("b") == 1).alias("only_a"), F.count_if(F.col("b") == 2).alias("only_b"))




@query("WITH r AS (SELECT user_id AS episode, round(sum(value), 4) - 50 AS a, min(value) - 1 AS s, max(value) - min(value) AS c FROM events GROUP BY user_id) SELECT episode, a >= 100 AND s < 0 AND c > 0 AS passed, concat_ws(';', CASE WHEN a < 100 THEN 'area_below_floor' END, CASE WHEN s >= 0 THEN 'slope_not_reduced' END, CASE WHEN c <= 0 THEN 'contiguity_not_increased' END) AS reasons FROM r")
def audit_gates(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "events").groupBy(F.col("user_id").alias("episode")).agg((F.round(F.sum("value"), 4) - 50).alias("area_change"), (F.min("value") - 1).alias("slope_change"), (F.max("value") - F.min("value")).alias("cont_change"))
    return writeback.audit(r, 100.0)


@query("SELECT block, bsm, row_number() OVER (PARTITION BY block ORDER BY bsm) - 1 AS local_idx FROM swap WHERE type_code > 0", "swap")
def block_reindex(spark: SparkSession, d: str) -> DataFrame:
    """Position of each parcel in its block, and back by equi-join on (block, position)."""
    s = swap(spark, d).where("type_code > 0").select("block", "bsm")
    lists = s.groupBy("block").agg(F.sort_array(F.collect_list("bsm")).alias("members"))
    local = lists.select("block", F.posexplode("members").alias("local_idx", "bsm"))
    return local.select("block", "bsm", F.col("local_idx").cast("long").alias("local_idx"))


@query("SELECT substr(qsdwdm, 1, 9) AS code, min_by(label, (length(label), bsm)) AS label FROM (SELECT qsdwdm, bsm, 'T' || (bsm % 100) AS label FROM parcel) GROUP BY code", "parcel")
def xzq_labels(spark: SparkSession, d: str) -> DataFrame:
    """Shortest label of each township code; of equals the first row's."""
    label = F.concat(F.lit("T"), (F.col("bsm") % 100).cast("string"))
    return parcel(spark, d).groupBy(F.substring("qsdwdm", 1, 9).alias("code")).agg(F.min_by(label, F.struct(F.length(label), F.col("bsm"))).alias("label"))


@query("SELECT bsm FROM swap WHERE block IN (SELECT block FROM swap GROUP BY block HAVING avg(slope_mean) > 17.5)", "swap")
def semi_isin(spark: SparkSession, d: str) -> DataFrame:
    s = swap(spark, d)
    steep = s.groupBy("block").agg(F.avg("slope_mean").alias("m")).where("m > 17.5")
    return s.join(steep, "block", "left_semi").select("bsm")


@query("SELECT p.bsm FROM parcel p WHERE NOT EXISTS (SELECT 1 FROM zone z WHERE p.x0 < z.x1 AND z.x0 < p.x1 AND p.y0 < z.y1 AND z.y0 < p.y1)", "parcel", "zone")
def anti_unassigned(spark: SparkSession, d: str) -> DataFrame:
    """Parcels that no zone touches."""
    p = parcel(spark, d)
    hit = overlay.box_pairs(p.select("bsm", "x0", "y0", "x1", "y1"), zone(spark, d)).select(F.col("l.bsm").alias("bsm")).distinct()
    return p.join(hit, "bsm", "left_anti").select("bsm")


_SHARE = "greatest(0, least(p.x1, z.x1) - greatest(p.x0, z.x0)) * greatest(0, least(p.y1, z.y1) - greatest(p.y0, z.y0))"


@query(f"SELECT unit_id, count(*) AS n_parcels, sum(a) AS area_m2, round(sum(a) / sum(sum(a)) OVER (), 6) AS share FROM (SELECT p.bsm, z.zone_id AS unit_id, (p.x1 - p.x0) * (p.y1 - p.y0) AS a, row_number() OVER (PARTITION BY p.bsm ORDER BY {_SHARE} DESC, z.zone_id) AS k FROM parcel p JOIN zone z ON p.x0 < z.x1 AND z.x0 < p.x1 AND p.y0 < z.y1 AND z.y0 < p.y1) WHERE k = 1 GROUP BY unit_id", "parcel", "zone")
def admin_units(spark: SparkSession, d: str) -> DataFrame:
    """Administrative units: parcels dissolved into the polygon with which each shares most land."""
    own = box_polygons(parcel(spark, d), "bsm")
    units = box_polygons(zone(spark, d), "zone_id").withColumnRenamed("zone_id", "unit_id")
    found = polygons.admin_units(own, units, [], 512.0)
    return found.select("unit_id", F.col("n").alias("n_parcels"), F.round("area_m2", 6).alias("area_m2"), F.round("share", 6).alias("share"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN trim(c_mktsegment) WHEN c_custkey % 7 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN '未命名县区' WHEN c_custkey % 2 = 0 THEN 'land_2025' ELSE 'land.gpkg' END WHEN c_custkey % 3 = 0 THEN '四川省内江市东兴区' WHEN c_custkey % 3 = 1 THEN '重庆市璧山区' ELSE '县区_510' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') END AS name FROM customer")
def county_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """Each source of a county's name where the ones before it are missing."""
    k = F.col("c_custkey")
    code = F.when(k % 7 == 0, None).when(k % 3 == 0, "511011").when(k % 3 == 1, "500120").otherwise(F.concat(F.lit("510"), F.lpad((k % 1000).cast("string"), 3, "0")))
    source = F.when(k % 3 == 0, "").when(k % 2 == 0, "/data/land_2025.GDB").otherwise("/data/land.gpkg")
    return table(spark, d, "customer").select(k.alias("id"), codes.county_label(code, F.when(k % 4 == 0, F.col("c_mktsegment")), source).alias("name"))


@query(", m AS (SELECT name FROM (SELECT CASE WHEN n_nationkey % 3 = 1 THEN n_name END AS name FROM nation JOIN customer ON c_nationkey = n_nationkey) WHERE name IS NOT NULL GROUP BY name ORDER BY count(*) DESC, name LIMIT 1), c AS (SELECT code FROM (SELECT regexp_extract(qsdwdm, '^([0-9]{6})', 1) AS code FROM parcel) WHERE code <> '' GROUP BY code ORDER BY count(*) DESC, code LIMIT 1) SELECT 'given' AS names, (SELECT name FROM m) AS name, (SELECT code FROM c) AS code UNION ALL SELECT 'blank', CASE (SELECT code FROM c) WHEN '511011' THEN '四川省内江市东兴区' WHEN '500120' THEN '重庆市璧山区' ELSE '县区_' || (SELECT code FROM c) END, (SELECT code FROM c)", "parcel")
def county_name(spark: SparkSession, d: str) -> DataFrame:
    """Name of the county by the most frequent name that is not blank, and by its most frequent code where all are."""
    named = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    names = named.select(F.when(F.col("n_nationkey") % 3 == 1, F.col("n_name")).alias("name"))
    own = metrics.most_frequent(parcel(spark, d).select(codes.county_code(F.col("qsdwdm")).alias("code")), "code")
    out = None
    for kind, rows in (("given", names), ("blank", names.select(F.lit(" ").alias("name")))):
        both = own.crossJoin(F.broadcast(metrics.most_frequent(rows, "name")))  # one row each
        one = both.select(F.lit(kind).alias("names"), codes.county_label(F.col("code"), F.col("name"), F.lit("")).alias("name"), "code")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT code, CASE WHEN length(code) >= 12 THEN 'village' ELSE 'township' END AS admin_level, substr(code, 1, 9) AS parent, count(*) AS n FROM (SELECT CASE WHEN bsm % 2 = 0 THEN qsdwdm ELSE substr(qsdwdm, 1, 9) END AS code FROM parcel) GROUP BY code", "parcel")
def admin_level(spark: SparkSession, d: str) -> DataFrame:
    """Level and parent of each administrative code."""
    p = parcel(spark, d).select(F.when(F.col("bsm") % 2 == 0, F.col("qsdwdm")).otherwise(F.substring("qsdwdm", 1, 9)).alias("code"))
    return p.groupBy("code").agg(F.count("*").alias("n")).select("code", codes.admin_level(F.col("code")).alias("admin_level"), F.substring("code", 1, 9).alias("parent"), "n")


@query("SELECT episode, step, round(sum(value) OVER w, 6) AS total, count(*) OVER w AS n_selected FROM step WINDOW w AS (PARTITION BY episode ORDER BY step ROWS UNBOUNDED PRECEDING)", "step")
def cumulative_plan(spark: SparkSession, d: str) -> DataFrame:
    return restoration.cumulative(step(spark, d)).withColumn("total", F.round("total", 6))


@query("SELECT episode, step, round(value - lag(value, 1, 0) OVER (PARTITION BY episode ORDER BY step), 6) AS delta FROM step", "step")
def step_deltas(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("episode").orderBy("step")
    return step(spark, d).select("episode", "step", F.round(F.col("value") - F.lag("value", 1, 0.0).over(w), 6).alias("delta"))


@query("SELECT user_id AS episode, event_type, min(event_id) AS event_id FROM events e WHERE ts = (SELECT min(ts) FROM events f WHERE f.user_id = e.user_id AND f.event_type = e.event_type) GROUP BY ALL")
def first_selection(spark: SparkSession, d: str) -> DataFrame:
    """First event of each kind in each episode: an ordered minimum, not a window."""
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("episode"), "event_type").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("event_id"))


@query("SELECT episode, step, last_value(v IGNORE NULLS) OVER (PARTITION BY episode ORDER BY step ROWS UNBOUNDED PRECEDING) AS held FROM (SELECT *, CASE WHEN step % 5 = 1 THEN value END AS v FROM step)", "step")
def held_value(spark: SparkSession, d: str) -> DataFrame:
    """A value taken every fifth step and held in between."""
    w = Window.partitionBy("episode").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return step(spark, d).select("episode", "step", F.last(F.when(F.col("step") % 5 == 1, F.col("value")), ignorenulls=True).over(w).alias("held"))


@query("SELECT episode, round(sum(pow(0.95, step - 1) * value), 6) AS ret FROM step GROUP BY episode", "step")
def discounted_return(spark: SparkSession, d: str) -> DataFrame:
    return step(spark, d).groupBy("episode").agg(F.round(F.sum(F.pow(F.lit(0.95), F.col("step") - 1) * F.col("value")), 6).alias("ret"))


def _ring(spark: SparkSession, d: str) -> DataFrame:
    """Each event's unit neighbours the next two event numbers, both ways."""
    e = table(spark, d, "events").select(F.col("event_id").alias("a"))
    one = e.select("a", F.explode(F.array(F.col("a") + 1, F.col("a") + 2)).alias("b"))
    return one.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(one.select(F.col("b").alias("src"), F.col("a").alias("dst")))


@query(", s AS (SELECT DISTINCT a.episode, a.step, a.value FROM step a JOIN step b ON a.episode = b.episode AND b.step <= a.step + 5 AND abs(a.unit_id - b.unit_id) BETWEEN 1 AND 2) SELECT episode, step, round(sum(paid), 6) AS paid FROM (SELECT episode, step, 0.3 * value AS paid FROM step UNION ALL SELECT episode, step + 5, 0.7 * value FROM s) GROUP BY ALL", "step")
def delayed_reward(spark: SparkSession, d: str) -> DataFrame:
    return restoration.delayed_reward(step(spark, d), _ring(spark, d)).withColumn("paid", F.round("paid", 6))


@query()
def sample_n(spark: SparkSession, d: str) -> DataFrame:
    """A fixed sample of a thousand parcels: the operator is the limit."""
    return parcel(spark, d).orderBy(F.xxhash64("bsm", F.lit(7)), "bsm").limit(1000).select("bsm", "dlbm")


@query()
def sample_per_group(spark: SparkSession, d: str) -> DataFrame:
    """Five parcels of each township in hash order."""
    w = Window.partitionBy("township").orderBy(F.xxhash64("bsm", F.lit(0)), "bsm")
    return swap(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 5").select("township", "bsm")


_BUDGET = 400_000.0


@query(f"SELECT unit_id FROM unit, (SELECT coalesce(sum(cost) FILTER (selected), 0) AS used FROM unit) WHERE candidate = 1 AND NOT selected AND used < {_BUDGET} - 1e-9 AND cost <= {_BUDGET} - used + 1e-9", "unit")
def restoration_mask(spark: SparkSession, d: str) -> DataFrame:
    return restoration.mask(unit(spark, d), _BUDGET)


_GRID = ", g AS (SELECT u.unit_id AS src, v.unit_id AS dst FROM unit u JOIN unit v ON abs(u.row - v.row) + abs(u.col - v.col) = 1)"


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """Four neighbours of each unit, both ways."""
    u = unit(spark, d).select("unit_id", "row", "col")
    near = F.explode(F.array(*(F.struct((F.col("row") + a).alias("r"), (F.col("col") + b).alias("c")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))))
    return u.select(F.col("unit_id").alias("src"), near.alias("s")).join(u.select(F.col("unit_id").alias("dst"), "row", "col"), (F.col("s.r") == F.col("row")) & (F.col("s.c") == F.col("col"))).select("src", "dst")


@query(_GRID + f", n AS (SELECT src AS unit_id, avg(CAST(selected AS DOUBLE)) AS share FROM g JOIN unit ON unit_id = dst GROUP BY src) SELECT unit_id, round(gain + 0.2 * coalesce(share, 0) - 0.1 * cost / {_BUDGET}, 4) AS reward FROM unit LEFT JOIN n USING (unit_id)", "unit")
def restoration_reward_default(spark: SparkSession, d: str) -> DataFrame:
    return restoration.reward_default(unit(spark, d), _grid(spark, d), _BUDGET).withColumn("reward", F.round("reward", 4))


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS unit_id, 1 AS candidate, p_retailprice AS cost FROM part")
def restoration_prepare(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive unit numbers in key order without a global sort in one task.

    Keys go to ranges; each range's offset is the count of the ranges before it
    (one row per range), and positions are counted inside the range only.
    """
    p = table(spark, d, "part").select("p_partkey", "p_retailprice").withColumn("r", F.floor(F.col("p_partkey") / 100_000))
    sizes = p.groupBy("r").agg(F.count("*").alias("n"))
    # one row per 100 000 keys
    before = sizes.select("r", F.coalesce(F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("r").orderBy("p_partkey"))
    return p.join(before, "r").select((F.col("base") + inside - 1).alias("unit_id"), F.lit(1).alias("candidate"), F.col("p_retailprice").alias("cost"))


_HISTORY = ", h AS (SELECT unit_id % 400 AS unit_id, min(step) AS step FROM step GROUP BY unit_id % 400)"


def _history(spark: SparkSession, d: str) -> DataFrame:
    return step(spark, d).groupBy((F.col("unit_id") % 400).alias("unit_id")).agg(F.min("step").alias("step"))


@query(_HISTORY + " SELECT u.unit_id, coalesce(h.step, -1) AS step, h.step IS NOT NULL AS chosen FROM unit u LEFT JOIN h USING (unit_id)", "unit", "step")
def plan_history_join(spark: SparkSession, d: str) -> DataFrame:
    return unit(spark, d).select("unit_id").join(_history(spark, d), "unit_id", "left").select("unit_id", F.coalesce("step", F.lit(-1)).alias("step"), F.col("step").isNotNull().alias("chosen"))


@query(_HISTORY + " SELECT u.unit_id AS id, u.cost AS unit_cost, h.step IS NOT NULL AS selected FROM unit u LEFT JOIN h USING (unit_id) WHERE candidate = 1", "unit", "step")
def restoration_render(spark: SparkSession, d: str) -> DataFrame:
    u = unit(spark, d).where("candidate = 1").drop("selected").join(_history(spark, d), "unit_id", "left")
    return u.select(F.col("unit_id").alias("id"), F.col("cost").alias("unit_cost"), F.col("step").isNotNull().alias("selected"))


@query("SELECT r_regionkey AS run, unnest(['prepare', 'sample', 'train', 'plan']) AS stage, unnest([CAST(r_regionkey * 10 + 1 AS BIGINT), CAST(r_regionkey * 10 + 2 AS BIGINT), CAST(r_regionkey * 10 + 3 AS BIGINT), CAST(r_regionkey * 10 + 4 AS BIGINT)]) AS seconds FROM region")
def manifest_stage_table(spark: SparkSession, d: str) -> DataFrame:
    """Stages of run manifests kept as JSON."""
    names = F.array(*map(F.lit, ["prepare", "sample", "train", "plan"]))
    made = table(spark, d, "region").select(F.col("r_regionkey").alias("run"), F.to_json(F.struct(F.transform(names, lambda x, i: F.struct(x.alias("stage"), (F.col("r_regionkey") * 10 + i + 1).cast("long").alias("seconds"))).alias("stages"))).alias("json"))
    parsed = made.select("run", F.explode(F.from_json("json", "struct<stages:array<struct<stage:string,seconds:bigint>>>")["stages"]).alias("s"))
    return parsed.select("run", "s.stage", "s.seconds")
