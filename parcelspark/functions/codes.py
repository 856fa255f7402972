"""Column expressions for codes, names and grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Land-use codes by class, and the texts that mean a missing code.
FARMLAND = ["0101", "0102", "0103"]
ORCHARD = ["0201", "0202", "0203", "0204"]
FOREST = ["0301", "0302", "0303", "0304", "0305", "0306", "0307"]
LEGACY_FARMLAND = ["011", "012", "013"]
LEGACY_ORCHARD = ["021", "022", "023"]
LEGACY_FOREST = ["031", "032", "033"]
BARRIER_PREFIXES = ["10", "11", "20"]
MISSING_CODES = ["", "nan", "none", "null", "<na>"]
LOCKED_TEXTS = ["1", "1.0", "true", "yes", "y"]
ECO, PBF = "ECO_REDLINE", "PERMANENT_BASIC_FARMLAND"
REVIEW_FOREST, REVIEW_FARM = "FOREST_OVERLAPS_PERMANENT_BASIC_FARMLAND", "CULTIVATED_LAND_IN_ECO_REDLINE"


def normalise_name(name: Column) -> Column:
    """Field name without white space, underscores, hyphens and brackets, in lower case."""
    return F.lower(F.regexp_replace(name, r"(?U)[\s_\-()（）]", ""))


def normalise_code(code: Column, width: int | None = None) -> Column:
    """Text of a code: '12.0' becomes '12'; digits are zero-filled to the width, longer ones stay."""
    text = F.regexp_replace(F.trim(F.coalesce(code.cast("string"), F.lit(""))), r"^(\d+)\.0+$", "$1")
    if width is None:
        return text
    return F.when(text.rlike(r"^\d+$") & (F.length(text) < width), F.lpad(text, width, "0")).otherwise(text)


def normalise_land_use_code(code: Column) -> Column:
    text = normalise_code(code)
    return F.when(F.lower(text).isin(MISSING_CODES), "").otherwise(text)


def norm_bsm(number: Column) -> Column:
    """Parcel key of a double: whole numbers without a fraction, others with six digits."""
    return F.when(number.isNull() | F.isnan(number), "").when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(F.format_string("%.6f", number))


def _base(code: Column) -> Column:
    """The four-digit class of a current code with at most one more character."""
    return F.when(F.length(code).isin(4, 5), F.substring(code, 1, 4)).otherwise("")


def classify_land_use(code: Column) -> Column:
    base = _base(code)
    return (
        F.when(base.isin(FARMLAND) | code.isin(LEGACY_FARMLAND), "farmland")
        .when(base.isin(FOREST) | code.isin(LEGACY_FOREST), "forest")
        .when(base.isin(ORCHARD) | code.isin(LEGACY_ORCHARD), "orchard")
        .when(F.substring(code, 1, 2).isin(BARRIER_PREFIXES), "barrier")
        .otherwise("other")
    )


def fusion_category(code: Column) -> Column:
    kind = classify_land_use(code)
    return F.when(kind.isin("farmland", "forest", "orchard"), F.initcap(kind)).otherwise("Other")


def land_use_scheme(code: Column) -> Column:
    return F.when(_base(code).isin(FARMLAND + FOREST + ORCHARD), "current").when(code.isin(LEGACY_FARMLAND + LEGACY_FOREST + LEGACY_ORCHARD), "legacy").otherwise("unknown")


# The standard behind each scheme of land-use codes.
STANDARDS = {"current": "GB/T 21010-2017 / Third National Land Survey", "legacy": "legacy Paper9 three-digit test data"}


def land_use_standard(scheme: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in STANDARDS.items() for x in kv])[scheme], F.lit("unrecognized"))


def type_code(code: Column) -> Column:
    kind = classify_land_use(code)
    return F.when(kind == "farmland", 1).when(kind == "forest", 2).otherwise(0)


def slope_grade(slope: Column) -> Column:
    """1 to 5; NaN and null are 5."""
    return F.when(slope <= 2, 1).when(slope <= 6, 2).when(slope <= 15, 3).when(slope <= 25, 4).otherwise(5)


# Roman numerals of slope classes, longer ones before those that they begin with.
ROMAN = (("III", 3), ("Ⅲ", 3), ("IV", 4), ("Ⅳ", 4), ("II", 2), ("Ⅱ", 2), ("Ⅴ", 5), ("Ⅰ", 1), ("V", 5), ("I", 1))


def grade_from_value(value: Column) -> Column:
    """Slope class of a number or a Roman or Arabic text, longest token first; null where there is none."""
    text = F.upper(F.regexp_replace(value.cast("string"), r"\s", ""))
    number = F.expr("NULL").cast("int")
    plain = F.when(text.rlike(r"^\d+(\.\d+)?$"), F.floor(text.cast("double")).cast("int"))
    out = F.when(plain.between(1, 5), plain)
    roman = F.lit(None).cast("int")
    for token, grade in ROMAN:
        roman = F.coalesce(roman, F.when(text.startswith(token), grade))
    lone = F.nullif(F.regexp_extract(text, r"(?<!\d)([1-5])(?!\d)", 1), F.lit("")).cast("int")
    return F.when(plain.isNotNull(), out).otherwise(F.coalesce(roman, lone, number))


def grade_match(field_grade: Column, dem_grade: Column) -> Column:
    return F.when(field_grade < 1, -1).otherwise((field_grade == dem_grade).cast("int"))


def overlap_pct(overlap: Column, area: Column) -> Column:
    return F.when(area > 0, overlap / area * 100).otherwise(0.0)


def lock_flag(eco: Column, pbf: Column, threshold: float = 1.0) -> Column:
    return ((eco > threshold) | (pbf > threshold)).cast("int")


def lock_reason(eco: Column, pbf: Column, threshold: float = 1.0) -> Column:
    return F.concat_ws(";", F.when(eco > threshold, ECO), F.when(pbf > threshold, PBF))


def review_reason(eco: Column, pbf: Column, category: Column, threshold: float = 1.0) -> Column:
    return F.when((pbf > threshold) & (category == "Forest"), REVIEW_FOREST).when((eco > threshold) & (category == "Farmland"), REVIEW_FARM).otherwise("")


def exchange_locked(flag: Column) -> Column:
    return F.coalesce(F.lower(F.trim(flag.cast("string"))).isin(LOCKED_TEXTS), F.lit(False))


def county_code(code: Column) -> Column:
    return F.nullif(F.regexp_extract(code, r"^(\d{6})", 1), F.lit(""))


def iso_seconds(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


# Counties that are known by their code, and what a name is made of without one.
KNOWN_COUNTIES = {
    "500120": "重庆市璧山区",
    "511011": "四川省内江市东兴区",
}
MADE_COUNTY, NO_COUNTY = "县区_", "未命名县区"


def county_label(code: Column, frequent: Column, source: Column) -> Column:
    """The most frequent name; else that of a known code, else one made from the code; without a code the source's name."""
    known = F.create_map(*[F.lit(x) for kv in KNOWN_COUNTIES.items() for x in kv])[code]
    stem = F.regexp_replace(F.substring_index(source, "/", -1), r"(?i)\.gdb$", "")
    return F.coalesce(F.nullif(F.trim(frequent), F.lit("")), known, F.concat(F.lit(MADE_COUNTY), code), F.nullif(stem, F.lit("")), F.lit(NO_COUNTY))


def admin_level(code: Column) -> Column:
    return F.when(F.length(code) >= 12, "village").otherwise("township")
