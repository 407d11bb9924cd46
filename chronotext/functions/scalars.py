"""Scalar projections: remaps, keys, dates, ratios, scores and formats."""
from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_FORMATS = ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "MM/dd/yyyy")


def _cases(col: Column, mapping: dict) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for k, v in mapping.items():
        out = out.when(col == k, v)
    return out


def remap(col: Column, mapping: dict) -> Column:
    """Values by a map; those it lacks stay."""
    return F.coalesce(_cases(col, mapping), col)


def ordinal(col: Column, ranks: dict, default: int = 99) -> Column:
    return F.coalesce(_cases(col, ranks), F.lit(default))


def prefix_priority(col: Column, prefixes) -> Column:
    """Place of the first prefix that a text starts with; behind all of them if none."""
    out = F.when(F.lit(False), 0)
    for i, p in enumerate(prefixes):
        out = out.when(F.startswith(col, F.lit(p)), i)
    return out.otherwise(len(prefixes))


def overwrite(col: Column, condition: Column, value) -> Column:
    return F.when(condition, value).otherwise(col)


def slug(*cols: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws("_", *cols)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def impute_date(text: Column, *fallbacks: Column) -> Column:
    """A full date; else 1 July of a leading year; else the first fallback date there is."""
    full = F.to_date(F.try_to_timestamp(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")))
    year = F.regexp_extract(text, r"^(\d{4})(?!\d)", 1)
    middle = F.when(year != "", F.make_date(year.try_cast("int"), F.lit(7), F.lit(1)))
    return F.coalesce(full, middle, *fallbacks)


def parse_day(text: Column, carried_year: Column | None = None) -> Column:
    """A date in one of several notations; a month and day alone take the carried year."""
    cleaned = F.regexp_replace(F.trim(text), r"\bSept\b\.?", "Sep")
    tries = [F.to_date(F.try_to_timestamp(cleaned, F.lit(f))) for f in DAY_FORMATS]
    if carried_year is not None:
        dated = F.concat_ws(", ", F.regexp_replace(cleaned, r"\.", ""), carried_year.cast("string"))
        tries += [F.to_date(F.try_to_timestamp(dated, F.lit(f))) for f in ("MMM d, yyyy", "MMMM d, yyyy")]
    return F.coalesce(*tries)


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "QUARTER"), 2))


def safe_ratio(a: Column, b: Column, default=None) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default).cast("double"))


def missing_as_null(col: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(col), col)


def score_out_of_100(text: Column) -> Column:
    """``x/100``, ``x/10`` and ``x/5`` notations on one scale, held within 0 and 100."""
    value = F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*/", 1).try_cast("double")
    scale = F.regexp_extract(text, r"/\s*(\d+)", 1).try_cast("double")
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.try_divide(value, scale) * 100))


def duration_seconds(text: Column) -> Column:
    """``m minutes s seconds``, else the first ``m:ss`` (spaces may stand around the colon, both parts below 60); square
    brackets go and what follows a parenthesis is not read."""
    t = F.split_part(F.regexp_replace(text, r"\[[^\]]*\]", ""), F.lit("("), F.lit(1))
    part = lambda p, i: F.regexp_extract(t, p, i).try_cast("int")
    words, clock = r"(?i)(\d+)\s*minutes?\s*(?:and\s*)?(\d+)\s*seconds?", r"\b(\d{1,3})\s*:\s*(\d{2})\b"
    return F.when(t.rlike(words), part(words, 1) * 60 + part(words, 2)).when((part(clock, 1) < 60) & (part(clock, 2) < 60), part(clock, 1) * 60 + part(clock, 2))


def peak_position(text: Column) -> Column:
    """The first integer of a table cell; dashes are null."""
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("int")


def certification(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)((?:\d+\s*[x×]\s*)?(?:gold|platinum|diamond))", 1), F.lit(""))


def append_note(notes: Column, note: Column) -> Column:
    return F.when(F.coalesce(notes, F.lit("")) == "", note).when(F.contains(notes, note), notes).otherwise(F.concat_ws("; ", notes, note))


def first_words(text: Column, k: int) -> Column:
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > k, F.concat(F.array_join(F.slice(words, 1, k), " "), F.lit("…"))).otherwise(F.array_join(words, " "))


def scores_to_columns(scores: Column, labels) -> list[Column]:
    """An array of (label, score) as one column per label, and the label of the highest score."""
    by_label = F.map_from_entries(scores)
    best = F.array_max(F.transform(scores, lambda s: F.struct(s["score"].alias("score"), s["label"].alias("label"))))
    return [*(F.try_element_at(by_label, F.lit(x)).alias(x) for x in labels), best["label"].alias("top_label")]


def p_text(p: Column, least: float = 1e-12) -> Column:
    """Four significant digits without trailing zeros, small values in e-notation, 1e-12 at least; NA if not finite."""
    digits = F.format_string("%.4g", F.greatest(p, F.lit(least)))
    short = F.regexp_replace(F.regexp_replace(digits, r"(\.\d*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", "")
    return F.when(p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf")), short).otherwise("NA")


def margin(positive: Column, negative: Column) -> Column:
    return positive - negative


def certification_day(text: Column) -> Column:
    """The first ``Month d, yyyy`` in a text."""
    day = F.regexp_extract(text, r"((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4})", 1)
    return F.to_date(F.try_to_timestamp(F.regexp_replace(day, r"\s+", " "), F.lit("MMMM d, yyyy")))


def decision(cases, default) -> Column:
    """A decision table: the value of the first condition that holds (null conditions don't)."""
    out = F.lit(default)
    for condition, value in reversed(list(cases)):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(value)).otherwise(out)
    return out


def rates(words: Column, lines: Column, verse_words: Column, seconds: Column) -> list[Column]:
    return [safe_ratio(words, seconds).alias("words_per_second"), (safe_ratio(words, seconds) * 60).alias("words_per_minute"), (safe_ratio(lines, seconds) * 60).alias("lines_per_minute"), safe_ratio(words, lines).alias("words_per_line"), safe_ratio(verse_words, words).alias("verse_share")]
