"""Normalizers of names, phones, plates, places and dates, as column expressions.

Three families that differ on purpose: n_* prepares entity resolution, v_* validates records, d_* cleans ingested data.
Each expression is a composition of built-in functions, so Catalyst sees through all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and the plain letters that canonical decomposition leaves of them.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćĈĉĊċČčĎďĒēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥĨĩĪīĬĭĮįİĴĵĶķĹĺĻļĽľŃńŅņŇňŌōŎŏŐőŔŕŖŗŘřŚśŜŝŞşŠšŢţŤťŨũŪūŬŭŮůŰűŲųŴŵŶŷŸŹźŻżŽž"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcCcCcDdEeEeEeEeEeGgGgGgGgHhIiIiIiIiIJjKkLlLlLlNnNnNnOoOoOoRrRrRrSsSsSsSsTtTtUuUuUuUuUuUuWwYyYZzZzZz"
#: Street words, and the patterns that stand for them.
STREET_WORDS = ((r"\b(street|st\.)\b", "st"), (r"\b(road|rd\.)\b", "rd"), (r"\b(nagar|ngr)\b", "nagar"), (r"\b(colony|clny)\b", "colony"), (r"\b(cross|cr\.)\b", "cross"), (r"\b(main|mn\.)\b", "main"))
#: Old and other names of cities.
CITY_NAMES = {
    "madras": "chennai",
    "bombay": "mumbai",
    "calcutta": "kolkata",
    "bangalore": "bengaluru",
    "trivandrum": "thiruvananthapuram",
    "cochin": "kochi",
    "baroda": "vadodara",
    "poona": "pune",
    "madurai": "madurai",
    "coimbatore": "coimbatore",
    "trichy": "tiruchirappalli",
    "salem": "salem",
    "delhi": "delhi",
    "hyderabad": "hyderabad",
}
#: The soundex digit of each letter from A to Z, 0 for letters without one.
SOUNDEX_DIGITS = "01230120022455012623010202"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _real(c: Column) -> Column:
    """The text, empty for a null or for 'nan' in either case."""
    c = _text(c)
    return F.when(F.lower(c) == "nan", "").otherwise(c)


def squeezed(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(_text(c), r"\s+", " "))


def remove_accents(c: Column) -> Column:
    """Accented Latin letters as plain ones, combining marks and all else beyond ASCII dropped."""
    return F.regexp_replace(F.translate(_text(c), ACCENTED, PLAIN), r"[^\x00-\x7F]", "")


def n_name(c: Column) -> Column:
    bare = F.regexp_replace(F.lower(remove_accents(_real(c))), r"[^\w\s]", "")
    return squeezed(F.regexp_replace(bare, r"\b(mr|mrs|ms|dr|prof|sir|smt|shri)\b", ""))


def n_phone(c: Column) -> Column:
    kept = F.regexp_replace(_real(c), r"[^\d+]", "")
    kept = F.regexp_replace(kept, "^0", "")
    return F.when(kept.startswith("+91") & (F.length(kept) > 3), F.substring(kept, 4, 1 << 30)).when(kept.startswith("91") & (F.length(kept) == 12), F.substring(kept, 3, 1 << 30)).otherwise(kept)


def n_vehicle(c: Column) -> Column:
    return F.regexp_replace(F.upper(_real(c)), "[^A-Z0-9]", "")


def n_location(c: Column) -> Column:
    return squeezed(F.regexp_replace(F.lower(remove_accents(_real(c))), r"[^\w\s]", ""))


def v_name(c: Column, more_titles: tuple[str, ...] = ()) -> Column:
    """A leading title and a trailing relation (s/o, d/o, w/o) dropped, punctuation as space."""
    titles = "|".join([r"mr\.", r"mrs\.", r"ms\.", "shri", r"smt\.", r"dr\.", "late", "thiru", *more_titles])
    bare = F.regexp_replace(F.trim(F.lower(_text(c))), rf"^({titles})\s+", "")
    bare = F.regexp_replace(bare, r"\s+(s/o|d/o|w/o)\s+.*$", "")
    return squeezed(F.regexp_replace(bare, r"[^a-z0-9\s]", " "))


def v_phone(c: Column, strict: bool = False) -> Column:
    """Ten digits from 6-9 on, after a country code or trunk zero; else null. strict also refuses one digit repeated."""
    digits = F.regexp_replace(_text(c), r"\D", "")
    digits = F.when((F.length(digits) == 12) & digits.startswith("91"), F.substring(digits, 3, 10)).when((F.length(digits) == 11) & digits.startswith("0"), F.substring(digits, 2, 10)).otherwise(digits)
    good = digits.rlike(r"^[6-9]\d{9}$")
    return F.when(good & ~digits.rlike(r"^(\d)\1{9}$") if strict else good, digits)


def v_birth(dob: Column, age: Column, as_of_year: int) -> tuple[Column, Column]:
    """(dob, birth year) from the first year 19xx or 20xx, else from an age; both null without either."""
    year = F.coalesce(_or_null(F.regexp_extract(_text(dob), r"\b(19\d{2}|20\d{2})\b", 1)).cast("int"), F.lit(as_of_year) - F.expr("1") * F.nullif(F.try_to_number(_or_null(F.regexp_extract(_text(age), r"^\s*(\d{1,4})\s*$", 1)), F.lit("9999")).cast("int"), F.lit(0)))
    return F.when(year.isNotNull(), F.format_string("%04d-01-01", year)), year


def v_birth_full(dob: Column, age: Column, as_of_year: int) -> tuple[Column, Column, Column]:
    """(dob, birth year, warnings) from a whole date within 120 years, else a year in the text, else an age from 1 to 119."""
    text = _or_null(_text(dob))
    day = F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy/MM/dd")), F.try_to_timestamp(text, F.lit("MM/dd/yyyy"))).cast("date")
    whole = F.year(day)
    usable = day.isNotNull() & (whole <= as_of_year) & (F.lit(as_of_year) - whole <= 120)
    found = F.when(day.isNull(), _or_null(F.regexp_extract(text, r"\b(19\d{2}|20\d{2})\b", 1)).cast("int"))
    years = F.regexp_extract(_text(age), r"^\s*([+-]?\d{1,9})", 1)
    years = _or_null(years).cast("int")
    est = F.when((years > 0) & (years < 120), F.lit(as_of_year) - years)
    warning = F.when(day.isNotNull() & (whole > as_of_year), F.concat(F.lit("Future date of birth detected: "), text)).when(day.isNotNull() & ~usable, F.concat(F.lit("DOB implies age > 120 years: "), text)).when(text.isNotNull() & day.isNull() & found.isNull(), F.concat(F.lit('Unparseable date of birth: "'), text, F.lit('"')))
    year = F.when(usable, whole).otherwise(F.coalesce(found, est))
    return F.when(usable, day.cast("string")).when(year.isNotNull(), F.format_string("%04d-01-01", year)), year, F.array_compact(F.array(warning))


def v_address(c: Column) -> Column:
    bare = reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), STREET_WORDS, F.trim(F.lower(_text(c))))
    return _or_null(squeezed(F.regexp_replace(bare, r"[^a-z0-9\s]", " ")))


def v_city(c: Column) -> Column:
    """A known alias in lower case; an unknown city in upper case."""
    bare = F.trim(F.lower(_or_null(_text(c))))
    names = F.create_map(*(F.lit(x) for kv in CITY_NAMES.items() for x in kv))
    return F.coalesce(F.try_element_at(names, bare), F.upper(bare))


def v_pincode(c: Column) -> Column:
    digits = F.regexp_replace(_text(c), r"\D", "")
    return F.when(digits.rlike(r"^[1-9]\d{5}$"), digits)


def v_vehicle(c: Column) -> Column:
    kept = F.regexp_replace(F.upper(_text(c)), "[^A-Z0-9]", "")
    return F.when(kept.rlike(r"^[A-Z]{2}\d{1,2}[A-Z]{0,3}\d{1,4}$") | (F.length(kept) >= 4), kept)


def v_national_id(c: Column) -> Column:
    kept = F.regexp_replace(F.upper(_text(c)), "[^A-Z0-9]", "")
    return F.when(F.length(kept) >= 5, kept)


def v_gender(c: Column) -> Column:
    first = F.substring(F.upper(F.trim(_text(c))), 1, 1)
    return F.when(first == "M", "MALE").when(first == "F", "FEMALE").when(first.isin("O", "T"), "OTHER").otherwise("UNKNOWN")


def v_aliases(c: Column, more_titles: tuple[str, ...] = ()) -> Column:
    """A JSON list of names, or names between commas, slashes, bars or semicolons; normalized, none empty."""
    text = _text(c)
    parts = F.coalesce(F.from_json(F.when(F.trim(text).startswith("["), text), "array<string>"), F.split(text, r"[,/|;]"))
    return F.filter(F.transform(parts, lambda x: v_name(x, more_titles)), lambda x: x != "")


def phonetic_key(c: Column) -> Column:
    """Soundex in which every letter without a digit, H and W too, parts equal digits; 0000 for a text without A-Z."""
    letters = F.regexp_replace(F.upper(_text(c)), "[^A-Z]", "")
    digits = F.regexp_replace(F.translate(letters, _ALPHABET, SOUNDEX_DIGITS), r"(\d)\1+", "$1")
    return F.when(letters == "", "0000").otherwise(F.rpad(F.concat(F.substring(letters, 1, 1), F.replace(F.substring(digits, 2, 1 << 30), F.lit("0"), F.lit(""))), 4, "0"))


def _titled(c: Column) -> Column:
    """Each run of letters with a capital first, as in names: O'Neil, A/B."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([^\W\d_]+|[\W\d_]+)"), F.lit(1))
    return F.array_join(F.transform(words, F.initcap), "")


def d_name(c: Column) -> Column:
    return _titled(squeezed(F.regexp_replace(_text(c), r"(?i)\b(mr|mrs|ms|dr|shri|smt)\b\.?", "")))


def d_phone(c: Column) -> Column:
    digits = F.regexp_replace(_text(c), r"\D", "")
    return F.when((F.length(digits) == 12) & digits.startswith("91"), F.substring(digits, 3, 10)).otherwise(digits)


def d_vehicle(c: Column) -> Column:
    return F.upper(F.regexp_replace(_text(c), r"[\s\-]", ""))


def d_location(c: Column) -> Column:
    return _titled(squeezed(c))


def d_organization(c: Column) -> Column:
    return _titled(squeezed(F.regexp_replace(_text(c), r"(?i)\b(pvt|ltd|inc|corp|co|limited|private)\b\.?", "")))


def temporal_parts(ts: Column) -> dict[str, Column]:
    """Hour, day (Monday 0), day of month, month, and flags: weekend, night (22 to 5), business hours (9 to 17 on weekdays)."""
    hour, day = F.hour(ts), F.weekday(ts)
    weekend = day >= 5
    return {
        "hour": hour,
        "day_of_week": day,
        "day_of_month": F.dayofmonth(ts),
        "month": F.month(ts),
        "weekend_flag": weekend.cast("int"),
        "night_activity_flag": ((hour >= 22) | (hour <= 5)).cast("int"),
        "business_hours_flag": (hour.between(9, 17) & ~weekend).cast("int"),
    }
