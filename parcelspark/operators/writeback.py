"""Writing planned land use back to the parcels, with guards and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.functions import codes

# Labels of CHG_FLAG, and the codes written for farmland and forest by scheme.
CHANGE_LABELS = {0: "unchanged", 1: "farmland to forest", 2: "forest to farmland"}
SWAP_CODES = {"legacy": ("011", "031"), "current": ("0101", "0301")}


class LockedParcelError(ValueError):
    """A planned change touches a locked parcel."""


def swap_codes(source: DataFrame, code: str = "dlbm") -> tuple[str, str]:
    """Farmland and forest code of the scheme that the swappable codes use; both schemes at once is an error."""
    found = {r[0] for r in source.select(codes.land_use_scheme(F.col(code)).alias("s")).distinct().collect()} & set(SWAP_CODES)
    if len(found) > 1:
        raise ValueError("current and legacy land-use codes are mixed")
    return SWAP_CODES[found.pop() if found else "current"]


def code_names(source: DataFrame) -> DataFrame:
    """dlbm, dlmc: the first name that is not empty, by row number."""
    return source.where("dlmc <> ''").groupBy("dlbm").agg(F.min_by("dlmc", "bsm").alias("dlmc"))


def optimized(source: DataFrame, state: DataFrame, farm_code: str = "0101", forest_code: str = "0301") -> DataFrame:
    """source with OPT_DLBM, CHG_FLAG and ORIG_DLBM; state: bsm, before, after (1 farmland, 2 forest); the last row of a parcel wins."""
    last = state.groupBy("bsm").agg(F.max_by(F.struct("before", "after"), "seq").alias("s")).select("bsm", "s.before", "s.after")
    flag = F.when((F.col("before") == 1) & (F.col("after") == 2), 1).when((F.col("before") == 2) & (F.col("after") == 1), 2).otherwise(0)
    out = source.join(last, "bsm", "left").withColumn("chg_flag", flag)
    new = F.when(F.col("chg_flag") == 1, forest_code).when(F.col("chg_flag") == 2, farm_code).otherwise(F.col("dlbm"))
    return out.withColumns({"opt_dlbm": new, "orig_dlbm": F.col("dlbm")}).drop("before", "after")


def require_unlocked(source: DataFrame, state: DataFrame) -> None:
    """Raises if a locked parcel changes."""
    if not source.where("locked").join(state.where("before <> after"), "bsm", "left_semi").isEmpty():
        raise LockedParcelError("a locked parcel would change")


def audit(results: DataFrame, floor_ha: float) -> DataFrame:
    """episode, passed, reasons: area not below the floor, slope falling, contiguity rising."""
    reasons = F.concat_ws(";", F.when(F.col("area_change") < floor_ha, "area_below_floor"), F.when(F.col("slope_change") >= 0, "slope_not_reduced"), F.when(F.col("cont_change") <= 0, "contiguity_not_increased"))
    return results.select("episode", (reasons == "").alias("passed"), reasons.alias("reasons"))
