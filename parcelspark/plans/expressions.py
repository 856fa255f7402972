"""Queries of scalar functions, scans and projections."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.domain import parcel, pixel, swap, table, unit
from parcelspark.functions import codes
from parcelspark.plans.registry import query
from parcelspark.sources import layers

# Values as they occur in fields, from the residue of a key; the SQL lists the same ones.
NAMES = ["DLBM", "dl_bm", " 地类 编码 ", "坐落（单位）名称", "QSDW-DM", "Bsm(ID)", "a_b c"]
CODES = ["0101", " 12.0", "7", "031", "nan", "None", "", "103.00", "x1.0", "<NA>"]
GRADES = ["II级", "3", "Ⅳ", "VI", "4.0", "坡度2级", "iii", "9", "I", "none", "Ⅴ级", "12"]
FLAGS = ["1", " TRUE ", "0", "yes", "n", "1.0", "Y", "2"]


def _pick(values: list[str], key: str):
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


def _list(values: list[str], key: str) -> str:
    """The same choice in SQL."""
    return f"list_extract({values!r}, CAST({key} % {len(values)} AS INT) + 1)"


@query("SELECT zone_id AS id, lower(regexp_replace(v, '[\\s\\x{3000}_\\-()（）]', '', 'g')) AS name FROM (SELECT s_suppkey AS zone_id, " + _list(NAMES, "s_suppkey") + " AS v FROM supplier)")
def normalise_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), codes.normalise_name(_pick(NAMES, "s_suppkey")).alias("name"))


@query("SELECT id, c AS code, CASE WHEN regexp_full_match(c, '\\d+') AND length(c) < 6 THEN lpad(c, 6, '0') ELSE c END AS wide FROM (SELECT c_custkey AS id, regexp_replace(trim(" + _list(CODES, "c_custkey") + "), '^(\\d+)\\.0+$', '\\1') AS c FROM customer)")
def normalise_code(spark: SparkSession, d: str) -> DataFrame:
    v = _pick(CODES, "c_custkey")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), codes.normalise_code(v).alias("code"), codes.normalise_code(v, 6).alias("wide"))


@query("SELECT id, CASE WHEN lower(c) IN ('', 'nan', 'none', 'null', '<na>') THEN '' ELSE c END AS code FROM (SELECT c_custkey AS id, regexp_replace(trim(" + _list(CODES, "c_custkey") + "), '^(\\d+)\\.0+$', '\\1') AS c FROM customer)")
def normalise_land_use_code(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), codes.normalise_land_use_code(_pick(CODES, "c_custkey")).alias("code"))


@query("SELECT p_partkey AS id, CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE printf('%.6f', x) END AS key FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN floor(p_retailprice) ELSE p_partkey + 0.25 END AS x FROM part)")
def norm_bsm(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("p_partkey") % 2 == 0, F.floor("p_retailprice").cast("double")).otherwise(F.col("p_partkey") + 0.25)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), codes.norm_bsm(x).alias("key"))


_CLASS = "CASE WHEN substr(dlbm, 1, 4) IN ('0101', '0102', '0103') THEN 'farmland' WHEN dlbm LIKE '03%' THEN 'forest' WHEN dlbm = '0201' THEN 'orchard' WHEN dlbm = '1104' THEN 'barrier' ELSE 'other' END"


@query(f"SELECT bsm, {_CLASS} AS kind, CASE WHEN {_CLASS} IN ('farmland', 'forest', 'orchard') THEN upper(substr({_CLASS}, 1, 1)) || substr({_CLASS}, 2) ELSE 'Other' END AS category FROM parcel", "parcel")
def classify_land_use(spark: SparkSession, d: str) -> DataFrame:
    return parcel(spark, d).select("bsm", codes.classify_land_use(F.col("dlbm")).alias("kind"), codes.fusion_category(F.col("dlbm")).alias("category"))


@query("SELECT bsm, CASE WHEN bsm % 3 = 0 THEN CASE WHEN dlbm LIKE '01%' THEN 'legacy' WHEN dlbm LIKE '03%' THEN 'legacy' WHEN dlbm = '0201' THEN 'legacy' ELSE 'unknown' END WHEN dlbm IN ('1104', '0601') THEN 'unknown' ELSE 'current' END AS scheme FROM parcel", "parcel")
def land_use_scheme(spark: SparkSession, d: str) -> DataFrame:
    """A third of the codes in their three-digit legacy form."""
    legacy = F.concat(F.substring("dlbm", 1, 2), F.when(F.col("dlbm").startswith("01"), "1").when(F.col("dlbm").startswith("03"), "2").otherwise("3"))
    code = F.when(F.col("bsm") % 3 == 0, legacy).otherwise(F.col("dlbm"))
    return parcel(spark, d).select("bsm", codes.land_use_scheme(code).alias("scheme"))


@query("SELECT bsm, type_code FROM swap", "swap")
def type_code(spark: SparkSession, d: str) -> DataFrame:
    return parcel(spark, d).select("bsm", codes.type_code(F.col("dlbm")).alias("type_code"))


@query("SELECT bsm, CASE WHEN slope_mean <= 2 THEN 1 WHEN slope_mean <= 6 THEN 2 WHEN slope_mean <= 15 THEN 3 WHEN slope_mean <= 25 THEN 4 ELSE 5 END AS grade FROM parcel", "parcel")
def slope_grade(spark: SparkSession, d: str) -> DataFrame:
    return parcel(spark, d).select("bsm", codes.slope_grade(F.col("slope_mean")).alias("grade"))


@query("SELECT s_suppkey AS id, list_extract([2, 3, 4, 5, 4, 2, 3, -1, 1, -1, 5, -1], CAST(s_suppkey % 12 AS INT) + 1) AS grade FROM supplier")
def grade_from_value(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.coalesce(codes.grade_from_value(_pick(GRADES, "s_suppkey")), F.lit(-1)).alias("grade"))


@query("SELECT bsm, CASE WHEN g < 1 THEN -1 ELSE CAST(g = CASE WHEN slope_mean <= 2 THEN 1 WHEN slope_mean <= 6 THEN 2 WHEN slope_mean <= 15 THEN 3 WHEN slope_mean <= 25 THEN 4 ELSE 5 END AS INT) END AS grd_match FROM (SELECT *, bsm % 7 - 1 AS g FROM parcel)", "parcel")
def grade_match(spark: SparkSession, d: str) -> DataFrame:
    return parcel(spark, d).select("bsm", codes.grade_match(F.col("bsm") % 7 - 1, codes.slope_grade(F.col("slope_mean"))).alias("grd_match"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity - 5 > 0 THEN l_tax / (l_quantity - 5) * 100 ELSE 0 END, 6) AS pct FROM lineitem")
def overlap_pct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(codes.overlap_pct(F.col("l_tax"), F.col("l_quantity") - 5), 6).alias("pct"))


@query("SELECT bsm, CAST(eco > 1 OR pbf > 1 AS INT) AS exch_lock, concat_ws(';', CASE WHEN eco > 1 THEN 'ECO_REDLINE' END, CASE WHEN pbf > 1 THEN 'PERMANENT_BASIC_FARMLAND' END) AS lock_rsn FROM (SELECT bsm, bsm % 4 * 0.5 AS eco, bsm % 5 * 0.4 AS pbf FROM parcel)", "parcel")
def lock_flags(spark: SparkSession, d: str) -> DataFrame:
    eco, pbf = F.col("bsm") % 4 * 0.5, F.col("bsm") % 5 * 0.4
    return parcel(spark, d).select("bsm", codes.lock_flag(eco, pbf).alias("exch_lock"), codes.lock_reason(eco, pbf).alias("lock_rsn"))


@query("SELECT bsm, CAST(r <> '' AS INT) AS review_req, r AS review_rsn FROM (SELECT bsm, CASE WHEN bsm % 5 * 0.4 > 1 AND type_code = 2 THEN 'FOREST_OVERLAPS_PERMANENT_BASIC_FARMLAND' WHEN bsm % 4 * 0.5 > 1 AND type_code = 1 THEN 'CULTIVATED_LAND_IN_ECO_REDLINE' ELSE '' END AS r FROM swap)", "swap")
def review_flags(spark: SparkSession, d: str) -> DataFrame:
    r = codes.review_reason(F.col("bsm") % 4 * 0.5, F.col("bsm") % 5 * 0.4, codes.fusion_category(F.col("dlbm")))
    return parcel(spark, d).select("bsm", (r != "").cast("int").alias("review_req"), r.alias("review_rsn"))


@query("SELECT c_custkey AS id, c_custkey % 8 IN (0, 1, 3, 5, 6) AS locked FROM customer")
def exchange_locked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), codes.exchange_locked(_pick(FLAGS, "c_custkey")).alias("locked"))


@query("SELECT bsm, CASE WHEN bsm % 6 <> 0 THEN substr(qsdwdm, 1, 6) END AS county FROM parcel", "parcel")
def county_code(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("bsm") % 6 == 0, F.concat(F.lit("x"), "qsdwdm")).otherwise(F.col("qsdwdm"))
    return parcel(spark, d).select("bsm", codes.county_code(code).alias("county"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS text FROM orders")
def dbf_datetime(spark: SparkSession, d: str) -> DataFrame:
    ts = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), codes.iso_seconds(ts).alias("text"))


@query("SELECT bsm, dlbm FROM parcel WHERE qsdwdm LIKE '511011001%'", "parcel")
def township_scan(spark: SparkSession, d: str) -> DataFrame:
    return parcel(spark, d).where(F.col("qsdwdm").startswith("511011001")).select("bsm", "dlbm")


@query("SELECT bsm, dlbm, substr(qsdwdm, 1, 9) AS township FROM parcel WHERE qsdwdm LIKE '511011001%' OR qsdwdm LIKE '511011004%' OR qsdwdm LIKE '511011007%'", "parcel")
def county_scan(spark: SparkSession, d: str) -> DataFrame:
    """Any of a list of township prefixes: a literal list, so no join."""
    town = F.substring("qsdwdm", 1, 9)
    return parcel(spark, d).where(town.isin("511011001", "511011004", "511011007")).select("bsm", "dlbm", town.alias("township"))


@query("SELECT count(*) AS n, min(bsm) AS first_bsm, max(bsm) AS last_bsm FROM parcel WHERE substr(qsdwdm, 1, 6) = '511011'", "parcel")
def county_filter(spark: SparkSession, d: str) -> DataFrame:
    return parcel(spark, d).where(F.substring("qsdwdm", 1, 6) == "511011").agg(F.count("*").alias("n"), F.min("bsm").alias("first_bsm"), F.max("bsm").alias("last_bsm"))


@query("SELECT row, col, CASE WHEN z = -9999 OR z <= 0 THEN NULL ELSE z END AS z FROM pixel", "pixel")
def dem_nodata(spark: SparkSession, d: str) -> DataFrame:
    return pixel(spark, d).select("row", "col", F.when((F.col("z") == -9999) | (F.col("z") <= 0), None).otherwise(F.col("z")).alias("z"))


@query("SELECT doc_id, sha256(text) AS sha, strlen(text) AS n_bytes FROM documents")
def sha256_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))


def layer_catalog(spark: SparkSession, d: str) -> DataFrame:
    """A container's layers with field names, one layer for each supplier."""
    k = F.col("s_suppkey")
    names = ["DLTB_", "PDT_", "STBHHX_", "other_", "YJJBNTBHTB_", "永久 基本农田(", "2025地类图斑-"]
    name = F.concat(F.get(F.array(*map(F.lit, names)), (k % 7).cast("int")), k.cast("string"))
    held = {"DLBM": k % 2 == 0, "坐落单位代码": k % 3 == 0, "b_sm": k % 4 == 0, "PDJB": k % 5 == 1, "标准坡度级别": k % 5 == 2, "LHDM": k % 11 == 0, "红线类型": k % 13 == 0}
    fields = F.array_compact(F.array(*(F.when(there, f) for f, there in held.items())))
    return table(spark, d, "supplier").select(k.alias("id"), name.alias("name"), fields.alias("fields"))


def layer_scores(catalog: DataFrame) -> DataFrame:
    """id, role, score of each layer for each role: the points of `layers.score` as column expressions."""
    out = None
    low = F.transform("fields", lambda f: codes.normalise_name(f))
    for role, known in layers.ROLES.items():
        named = sum((F.when(codes.normalise_name(F.col("name")).contains(layers.plain(h)), 100).otherwise(0) for h in known.hints), F.lit(0))
        points = sum((F.when(F.arrays_overlap(low, F.array(*(F.lit(layers.plain(n)) for n in names))), p).otherwise(0) for names, p in known.columns.values()), F.lit(0))
        one = catalog.select("id", "name", F.lit(role).alias("role"), (named + points).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


_SCORES = """(SELECT s_suppkey AS id, role,
 CASE role WHEN 'parcels' THEN CASE s_suppkey % 7 WHEN 0 THEN 100 WHEN 6 THEN 200 ELSE 0 END + CASE WHEN s_suppkey % 2 = 0 THEN 30 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN 25 ELSE 0 END + CASE WHEN s_suppkey % 4 = 0 THEN 20 ELSE 0 END
 WHEN 'pdt' THEN CASE WHEN s_suppkey % 7 = 1 THEN 100 ELSE 0 END + CASE s_suppkey % 5 WHEN 1 THEN 40 WHEN 2 THEN 20 ELSE 0 END
 WHEN 'eco' THEN CASE WHEN s_suppkey % 7 = 2 THEN 100 ELSE 0 END + CASE WHEN s_suppkey % 11 = 0 THEN 15 ELSE 0 END + CASE WHEN s_suppkey % 13 = 0 THEN 15 ELSE 0 END
 ELSE CASE WHEN s_suppkey % 7 IN (4, 5) THEN 200 ELSE 0 END END AS score
 FROM supplier, (VALUES ('parcels'), ('pdt'), ('eco'), ('pbf')) r(role))"""


@query(f"SELECT id, role, score FROM {_SCORES}")
def layer_score(spark: SparkSession, d: str) -> DataFrame:
    return layer_scores(layer_catalog(spark, d)).select("id", "role", "score")


@query(f"SELECT role, max(score) AS score, min(id) FILTER (score = top) AS id, count(*) FILTER (score = top) > 1 AS tied FROM (SELECT *, max(score) OVER (PARTITION BY role) AS top FROM {_SCORES}) GROUP BY role")
def layer_selection(spark: SparkSession, d: str) -> DataFrame:
    """Best layer of each role; a tie is reported, and its smallest id shown."""
    s = layer_scores(layer_catalog(spark, d)).groupBy("role", "score").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    best = s.groupBy("role").agg(F.max_by(F.struct("score", "id", "n"), "score").alias("b"))
    return best.select("role", "b.score", "b.id", (F.col("b.n") > 1).alias("tied"))


@query("SELECT block, unnest(list_sort(list(bsm))) AS bsm, unnest(range(count(*))) AS local_idx FROM swap WHERE type_code > 0 GROUP BY block", "swap")
def json_compositions(spark: SparkSession, d: str) -> DataFrame:
    """Block compositions as JSON text and back."""
    made = swap(spark, d).where("type_code > 0").groupBy("block").agg(F.to_json(F.sort_array(F.collect_list("bsm"))).alias("json"))
    return made.select("block", F.posexplode(F.from_json("json", "array<bigint>")).alias("local_idx", "bsm")).select("block", "bsm", F.col("local_idx").cast("long"))


def profile(df: DataFrame) -> DataFrame:
    """Rows, bounds and number of distinct codes of boxes x0..y1."""
    return df.agg(F.count("*").alias("n"), F.min("x0").alias("xmin"), F.min("y0").alias("ymin"), F.max("x1").alias("xmax"), F.max("y1").alias("ymax"))


_BOUNDS = "count(*) AS n, min(x0) AS xmin, min(y0) AS ymin, max(x1) AS xmax, max(y1) AS ymax"


@query(f"SELECT 'parcel' AS layer, {_BOUNDS}, 'BSM,PDJB' AS missing FROM parcel UNION ALL SELECT 'zone', {_BOUNDS}, 'BSM,DLBM' FROM zone", "parcel", "zone")
def vector_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profile of two layers and the expected fields that each lacks (names compared as they are)."""
    from parcelspark.domain import zone

    out = None
    for name, df, expected in (("parcel", parcel(spark, d), ["BSM", "PDJB"]), ("zone", zone(spark, d), ["BSM", "DLBM"])):
        lacks = ",".join(x for x in expected if x not in df.columns)
        one = profile(df).select(F.lit(name).alias("layer"), "n", *(F.col(c).cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")), F.lit(lacks).alias("missing"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT kind, count(*) AS n, min(x0) AS xmin, max(x1) AS xmax, count(*) FILTER (slope_mean > 25) AS steep FROM (SELECT *, " + _CLASS + " AS kind FROM parcel) GROUP BY kind", "parcel")
def frame_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return parcel(spark, d).groupBy(codes.classify_land_use(F.col("dlbm")).alias("kind")).agg(F.count("*").alias("n"), F.min("x0").alias("xmin"), F.max("x1").alias("xmax"), F.count_if(F.col("slope_mean") > 25).alias("steep"))


@query(f"SELECT {_BOUNDS} FROM parcel", "parcel")
def total_bounds(spark: SparkSession, d: str) -> DataFrame:
    return profile(parcel(spark, d))


def dbf_names(names: list[str]) -> list[str]:
    """Field names of at most ten characters; a digit replaces the end of a name that is taken."""
    out: list[str] = []
    for n in names:
        short, i = n[:10], 1
        while short in out:
            short = n[: 10 - len(str(i))] + str(i)
            i += 1
        out.append(short)
    return out


@query("SELECT l_orderkey AS long_field, l_linenumber AS long_fiel1, substr(repeat(l_returnflag, 300), 1, 254) AS text_field FROM lineitem")
def dbf_schema_projection(spark: SparkSession, d: str) -> DataFrame:
    """Short unique names, text cut to 254 characters."""
    df = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("long_field_a"), F.col("l_linenumber").alias("long_field_b"), F.repeat("l_returnflag", 300).alias("text_field"))
    return df.select(*((F.substring(c, 1, 254) if t == "string" else F.col(c)).alias(n) for (c, t), n in zip(df.dtypes, dbf_names(df.columns), strict=True)))


@query("SELECT count(*) AS total, count(*) FILTER (isnan(x) OR isinf(x)) AS bad FROM (SELECT CASE WHEN l_linenumber = 3 THEN 'NaN'::DOUBLE WHEN l_linenumber = 4 THEN 'Infinity'::DOUBLE ELSE l_tax END AS x FROM lineitem)")
def assert_finite(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("l_linenumber") == 3, math.nan).when(F.col("l_linenumber") == 4, math.inf).otherwise(F.col("l_tax"))
    return table(spark, d, "lineitem").select(x.alias("x")).agg(F.count("*").alias("total"), F.count_if(F.isnan("x") | (F.abs("x") == math.inf)).alias("bad"))


@query("SELECT unit_id, round(CASE WHEN sg > 1e-6 THEN (gain - mg) / sg ELSE 0 END, 6) AS gain_z, round(CASE WHEN sc > 1e-6 THEN (cost - mc) / sc ELSE 0 END, 6) AS cost_z FROM unit, (SELECT avg(gain) AS mg, stddev_pop(gain) AS sg, avg(cost) AS mc, stddev_pop(cost) AS sc FROM unit)", "unit")
def zscore_features(spark: SparkSession, d: str) -> DataFrame:
    """Standard scores; the one-row statistics are broadcast, so nothing is sorted."""
    u = unit(spark, d)
    s = u.agg(F.avg("gain").alias("mg"), F.stddev_pop("gain").alias("sg"), F.avg("cost").alias("mc"), F.stddev_pop("cost").alias("sc"))
    z = lambda x, m, sd: F.round(F.when(F.col(sd) > 1e-6, (F.col(x) - F.col(m)) / F.col(sd)).otherwise(0.0), 6)
    return u.crossJoin(F.broadcast(s)).select("unit_id", z("gain", "mg", "sg").alias("gain_z"), z("cost", "mc", "sc").alias("cost_z"))


@query("WITH v AS (SELECT vec_id, label, embedding AS e FROM embeddings), c AS (SELECT vec_id, list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]) AS s FROM v a JOIN (SELECT vec_id - 1 AS vec_id, e FROM v) b USING (vec_id)) SELECT vec_id, round(s, 5) AS cosine FROM c")
def cosine_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each vector against the next one."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return e.join(b, "vec_id").select("vec_id", F.round(dot("a", "b") / F.sqrt(dot("a", "a")) / F.sqrt(dot("b", "b")), 5).alias("cosine"))
