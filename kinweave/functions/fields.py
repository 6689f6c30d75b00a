"""Cleaning rules for the fields of a person record, as Column expressions.

Every function takes the raw column and returns the clean one, null where the
value says nothing.  Names return a struct (value, invalid, suffix): whether the
raw text marks the whole record as unusable, and a generational suffix that
stood behind the name.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from kinweave.functions.text import blank_to_null, collapse, contains_any, digits, replace_tokens, split_camel, strip_leading_zeros, to_ascii

# Words that stand for a missing value, marks of unusable records, and abbreviations
# (postal ones after USPS Publication 28, area codes after the North American numbering plan).
NULL_WORDS = ("UNKNOWN", "NULL", "NAN", "NONE", "N/A", "NA", "")
MIDDLE_NULL_WORDS = ("NMI", "UNKNOWN", "NULL", "N/A", "-", "")
SEX_NULL_WORDS = ("UNKNOWN", "NULL", "N/A", "")
INVALID_MARKERS = (
    "BABYBOY", "BABY BOY", "BABYGIRL", "BABY GIRL", "DUPLICATE", "DO NOT", "DONOT USED", "DONOTUSE", "DONT USE", "DON'T USE",
    "DOUBLE ACCOUNT", "MEDICARE", "ACCOUNT", "<MRG>", "INACTIVE", "UPRR",
)
INVALID_WORDS = ("TEST", "BABY")
TITLES = ("MR", "MRS", "MS", "DR", "REV")
TRAILING_SUFFIXES = ("III", "IV", "II", "JR", "SR", "V")
SUFFIXES = ("JR", "SR", "I", "II", "III", "IV", "V")
ORDINALS = {"2ND": "II", "3RD": "III", "4TH": "IV", "5TH": "V"}
ADDRESS_PLACEHOLDERS = (
    "HOMELESS", "TRANSIENT", "BAD ADDRESS", "NO ADDRESS", "?", "NO MAIL", "GENERAL DELIVERY", "NKA", ".", "NOT TAKEN", "GET", "INCORRECT ADDRESS",
)
ADDRESS1_PLACEHOLDERS = (*ADDRESS_PLACEHOLDERS, "<MRG>", "X")
STREET_WORDS = {
    "STREET": "ST", "STR": "ST", "STRT": "ST", "AVENUE": "AVE", "AV": "AVE", "AVN": "AVE", "AVENU": "AVE", "BOULEVARD": "BLVD", "BOUL": "BLVD",
    "BOULV": "BLVD", "ROAD": "RD", "DRIVE": "DR", "DRIV": "DR", "DRV": "DR", "LANE": "LN", "COURT": "CT", "CRT": "CT", "PLACE": "PL", "CIRCLE": "CIR",
    "CIRC": "CIR", "CRCL": "CIR", "CRCLE": "CIR", "TERRACE": "TER", "TERR": "TER", "PARKWAY": "PKWY", "PARKWY": "PKWY", "PKWAY": "PKWY", "PKY": "PKWY",
    "HIGHWAY": "HWY", "HIGHWY": "HWY", "HIWAY": "HWY", "HIWY": "HWY", "HWAY": "HWY", "TRAIL": "TRL", "ALLEY": "ALY", "ALLY": "ALY", "ALLEE": "ALY",
    "SQUARE": "SQ", "SQR": "SQ", "SQRE": "SQ", "SQU": "SQ", "PLAZA": "PLZ", "PLZA": "PLZ", "EXPRESSWAY": "EXPY", "EXPR": "EXPY", "EXPW": "EXPY",
    "FREEWAY": "FWY", "FRWAY": "FWY", "FRWY": "FWY", "CROSSING": "XING", "CRSSNG": "XING", "BRIDGE": "BRG", "BRDGE": "BRG", "ROUTE": "RTE",
    "TURNPIKE": "TPKE", "TRNPK": "TPKE", "POINT": "PT", "POINTS": "PT", "RIDGE": "RDG", "VIEW": "VW", "VILLAGE": "VLG", "VILLG": "VLG",
    "VILLIAGE": "VLG", "ESTATES": "EST", "HEIGHTS": "HTS",
}
DIRECTIONS = {"NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW"}
UNITS = {
    "APARTMENT": "APT", "APRT": "APT", "SUITE": "STE", "ROOM": "RM", "FLOOR": "FL", "FLR": "FL", "BUILDING": "BLDG", "BLD": "BLDG", "BLDNG": "BLDG",
    "DEPARTMENT": "DEPT", "PENTHOUSE": "PH", "BASEMENT": "BSMT", "LOWER": "LOWR", "UPPER": "UPPR", "TRAILER": "TRLR", "HANGAR": "HNGR",
    "OFFICE": "OFC", "FRONT": "FRNT", "LOBBY": "LBBY", "SPACE": "SPC",
}
STATES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE",
    "DISTRICT OF COLUMBIA": "DC", "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA",
    "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD", "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN",
    "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ",
    "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR",
    "PENNSYLVANIA": "PA", "PUERTO RICO": "PR", "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX",
    "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA", "VIRGIN ISLANDS": "VI", "WASHINGTON": "WA", "WEST VIRGINIA": "WV", "WISCONSIN": "WI",
    "WYOMING": "WY", "GUAM": "GU", "AMERICAN SAMOA": "AS", "NORTHERN MARIANA ISLANDS": "MP",
}
# CMS certification number prefixes 01 to 54 in order.
CCN_STATES = "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA PR RI SC SD TN TX UT VT VA VI WA WV WI WY GU".split()
# First digit of the postal code and the states it lies in (USPS).
POSTAL_STATES = {
    "0": "CT MA ME NH NJ PR RI VT VI", "1": "DE NY PA", "2": "DC MD NC SC VA WV", "3": "AL FL GA MS TN", "4": "IN KY MI OH",
    "5": "IA MN MT ND SD WI", "6": "IL KS MO NE", "7": "AR LA OK TX", "8": "AZ CO ID NM NV UT WY", "9": "AK AS CA GU HI MP OR WA",
}
JUNK_IDS = (
    "010101010", "090909090", "000000001", "999999998", "111223333", "219099999", "457555462", "078051120",
    "333333330", "003333333", "333333300", "033333333", "333333339", "099999999", "333333000",
)
N11_CODES = ("211", "311", "411", "511", "611", "711", "811", "911")
SEQUENTIAL_PHONES = ("0123456789", "1234567890", "9876543210", "0987654321")
JUNK_EMAILS = (
    "no@email.com", "none@none.com", "unknown@email.com", "email@email.com", "na@na.com", "null@null.com", "none@gmail.com", "patient@patient.com",
)
JUNK_EMAIL_PARTS = ("decline", "noemail")
JUNK_LOCALS = ("noemail", "no-email", "no_email", "noreply", "no-reply", "donotreply", "do-not-reply", "unknown", "test", "patient", "none", "null", "na")
JUNK_DOMAINS = (
    "example.com", "example.org", "example.net", "test.com", "test.org", "noemail.com", "noreply.com", "donotreply.com", "unknown.com", "123.com",
)


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _letters(text: Column) -> Column:
    return collapse(F.regexp_replace(text, r"[^A-Z \-']", ""))


def _upper(raw: Column) -> Column:
    return collapse(F.upper(split_camel(to_ascii(F.trim(raw)))))


def _name(raw: Column, text: Column, flagged: Column, missing: Column, title: bool) -> Column:
    if title:
        text = F.regexp_replace(text, f"^({'|'.join(TITLES)}) ", "")
    trailing = f" ({'|'.join(TRAILING_SUFFIXES)})$"
    suffix = F.when(~missing, blank_to_null(F.regexp_extract(text, trailing, 1)))
    value = F.when(~missing, blank_to_null(collapse(F.regexp_replace(text, trailing, ""))))
    return F.when(raw.isNotNull(), F.struct(value.alias("value"), flagged.alias("invalid"), suffix.alias("suffix"))).otherwise(
        F.struct(F.lit(None).cast("string").alias("value"), F.lit(False).alias("invalid"), F.lit(None).cast("string").alias("suffix"))
    )


def _marked(raw: Column, upper: Column) -> Column:
    return F.coalesce(F.trim(raw).rlike(r"^(\d+|[Ii][Dd]\d+)$"), F.lit(False)) | contains_any(upper, INVALID_MARKERS)


def first_name(raw: Column) -> Column:
    upper = _upper(raw)
    text = _letters(upper)
    return _name(raw, text, _marked(raw, upper) | text.isin(*INVALID_WORDS), text.isin(*NULL_WORDS), title=True)


def last_name(raw: Column) -> Column:
    upper = _upper(raw)
    text = _letters(upper)
    return _name(raw, text, _marked(raw, upper) | text.isin(*INVALID_WORDS), text.isin(*NULL_WORDS), title=False)


def middle_name(raw: Column) -> Column:
    """Unlike the other names, missing words and whole-word flags are looked for before letters are stripped too."""
    upper = _upper(raw)
    text = _letters(upper)
    missing = upper.isin(*MIDDLE_NULL_WORDS) | text.isin(*MIDDLE_NULL_WORDS)
    return _name(raw, text, _marked(raw, upper) | upper.isin(*INVALID_WORDS), missing, title=False)


def suffix(raw: Column) -> Column:
    text = collapse(F.upper(raw))
    bare = collapse(F.regexp_replace(text, r"[^\w\s]", ""))
    roman = F.coalesce(F.element_at(_map(ORDINALS), bare), bare)
    return F.when(~text.isin(*NULL_WORDS) & roman.isin(*SUFFIXES), roman)


def birth_date(raw: Column, today: date | Column) -> Column:
    """ISO, US and written-out dates after 1900-01-01 and not after ``today``."""
    text = F.trim(raw)
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "M/d/yyyy", "MMM d, yyyy", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd")])
    limit = today if isinstance(today, Column) else F.lit(today)
    return F.when((parsed > F.lit(date(1900, 1, 1))) & (parsed <= limit), parsed)


def is_placeholder_id(d: Column) -> Column:
    """Nine digits that carry no identity: two kinds at most, one kind seven times, or a run."""
    kinds = F.size(F.array_distinct(F.split(d, "")))
    most = F.array_max(F.transform(F.array(*[F.lit(str(i)) for i in range(10)]), lambda c: F.length(d) - F.length(F.replace(d, c, F.lit("")))))
    return (kinds <= 2) | (most >= 7) | F.lit("0123456789012345678").contains(d) | F.lit("9876543210987654321").contains(d)


def government_id(raw: Column) -> Column:
    """Nine digits that keep the structural rules and are no placeholder."""
    found = digits(raw)
    d = F.when(F.length(found).isin(7, 8), F.lpad(found, 9, "0")).otherwise(found)
    a, b, c = F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 3)
    bad = ((a == b) & (b == c)) | a.isin("000", "666") | (a >= "900") | (F.substring(d, 4, 2) == "00") | (F.substring(d, 6, 4) == "0000") | d.isin(*JUNK_IDS)
    return F.when(d.rlike(r"^\d{9}$") & ~bad & ~is_placeholder_id(d), d)


def last_four(clean_id: Column) -> Column:
    return F.substring(clean_id, 6, 4)


def _address(raw: Column, placeholders: tuple[str, ...], *tables: dict[str, str], zeros: bool) -> Column:
    text = collapse(F.upper(to_ascii(raw)))
    known = ~text.isin(*NULL_WORDS, *placeholders)
    bare = collapse(F.regexp_replace(text, "[^A-Z0-9 ]", ""))
    for table in tables:
        bare = replace_tokens(bare, table)
    if zeros:
        bare = strip_leading_zeros(bare)
    flagged = known & (contains_any(text, INVALID_MARKERS) | text.isin(*INVALID_WORDS))
    return F.struct(F.when(known, blank_to_null(bare)).alias("value"), F.coalesce(flagged, F.lit(False)).alias("invalid"))


def address_line1(raw: Column) -> Column:
    return _address(raw, ADDRESS1_PLACEHOLDERS, STREET_WORDS, DIRECTIONS, zeros=True)


def address_line2(raw: Column) -> Column:
    return _address(raw, ADDRESS_PLACEHOLDERS, UNITS, zeros=False)


def city(raw: Column) -> Column:
    text = collapse(F.upper(to_ascii(raw)))
    return F.when(~text.isin(*NULL_WORDS), blank_to_null(_letters(text)))


def postal_code(raw: Column) -> Column:
    """struct(base, ext): five digits that are no placeholder, and the four behind them."""
    found = digits(raw)
    d = F.when(F.length(found) == 4, F.lpad(found, 5, "0")).when(F.length(found) == 8, F.lpad(found, 9, "0")).otherwise(found)
    base = F.substring(d, 1, 5)
    good = (F.length(d) >= 5) & ~base.rlike(r"^(\d)\1{4}$") & ~base.isin("12345", "54321")
    return F.struct(F.when(good, base).alias("base"), F.when(good & (F.length(d) >= 9), F.substring(d, 6, 4)).alias("ext"))


def state(raw: Column) -> Column:
    """A state's name, code or certification-number prefix as its code."""
    text = F.trim(F.upper(raw))
    codes = {f"{i:02d}": s for i, s in enumerate(CCN_STATES, 1)}
    number = F.when(text.rlike(r"^\d+$"), F.element_at(_map(codes), F.when(F.length(text) == 1, F.lpad(text, 2, "0")).otherwise(text)))
    return F.coalesce(F.element_at(_map(STATES), text), number, F.when(text.isin(*STATES.values()) & ~text.isin(*NULL_WORDS), text))


def phone(raw: Column) -> Column:
    found = digits(raw)
    d = F.when((F.length(found) == 11) & found.startswith("1"), F.substring(found, 2, 10)).otherwise(found)
    area = F.substring(d, 1, 3)
    bad = d.rlike(r"^(\d)\1{9}$") | d.isin(*SEQUENTIAL_PHONES) | d.rlike("^[01]") | area.isin(*N11_CODES) | (area == "555") | d.rlike(r"^\d{3}[01]") | d.rlike(r"^\d{3}555[01]")
    return F.when((F.length(d) == 10) & ~bad, d)


def email(raw: Column) -> Column:
    text = F.regexp_replace(F.lower(raw), r"\s+", "")
    local, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    bad = text.isin(*JUNK_EMAILS) | contains_any(text, JUNK_EMAIL_PARTS) | local.rlike(f"^({'|'.join(JUNK_LOCALS)})") | (F.length(local) <= 2) | local.contains("123456") | domain.isin(*JUNK_DOMAINS)
    return F.when(text.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$") & ~bad, text)


def sex(raw: Column) -> Column:
    text = F.trim(F.upper(raw))
    return F.when(text.isin("MALE", "FEMALE", "OTHER"), text)


def name_tokens(*names: Column) -> Column:
    """Sorted distinct parts of the names between spaces and hyphens."""
    parts = F.split(F.concat_ws(" ", *names), r"[ \-]+")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def name_compact(*names: Column) -> Column:
    return blank_to_null(F.upper(F.regexp_replace(F.concat_ws("", *names), "[^A-Za-z]", "")))


def value_set(*slots: Column) -> Column:
    """Sorted distinct non-null values of several slots."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*slots))))


def postal_state_agree(base: Column, code: Column) -> Column:
    """False if both are known and the postal code's first digit does not lie in the state."""
    table = F.create_map(*[x for d, s in POSTAL_STATES.items() for x in (F.lit(d), F.array(*[F.lit(c) for c in s.split()]))])
    return F.coalesce(F.array_contains(F.element_at(table, F.substring(base, 1, 1)), code), F.lit(True))


def parse_value_set(text: Column) -> Column:
    """The values of a list that was written as text, such as {'a', 'b'} or [a,b]."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(text, r"""[{}\[\]()'" ]|set\(\)""", ""), ","), lambda x: x != "")))


def key_hash(key: Column) -> Column:
    """SHA-256 of an identifier used as a key, so that an index need not hold it."""
    return F.sha2(key, 256)


def normalized_address(raw: Column) -> Column:
    """Null: the optional address parser is not part of this environment."""
    return F.lit(None).cast("string")


RAW_COLUMNS = (
    "rec_id", "first", "last", "middle", "suffix", "birth", "gov_id", "addr1", "addr2", "city", "postal", "state", "phone0", "phone1", "phone2", "phone3", "email", "sex",
)


def raw_names(df: DataFrame) -> DataFrame:
    """Input columns renamed to ``<name>_raw``; a second call changes nothing."""
    return df.withColumnsRenamed({c: f"{c}_raw" for c in RAW_COLUMNS[1:] if c in df.columns and f"{c}_raw" not in df.columns})


def clean_records(df: DataFrame, today: date) -> DataFrame:
    """All fields cleaned in one projection, with ``is_valid`` and the raw columns beside them.

    A record is valid unless a name or address marks it unusable or both names
    are missing.  Postal code and state that contradict each other are nulled.
    Columns of RAW_COLUMNS that the table lacks are taken as null.
    """
    df = raw_names(df)
    missing = {f"{c}_raw": F.lit(None).cast("string") for c in RAW_COLUMNS[1:] if f"{c}_raw" not in df.columns}
    df = df.withColumns(missing) if missing else df
    r = lambda c: F.col(f"{c}_raw")
    step = df.withColumns(
        {
            "_first": first_name(r("first")), "_last": last_name(r("last")), "_middle": middle_name(r("middle")), "_addr1": address_line1(r("addr1")),
            "_addr2": address_line2(r("addr2")), "_postal": postal_code(r("postal")), "_state": state(r("state")), "gov_id": government_id(r("gov_id")),
            **{f"_phone{i}": phone(r(f"phone{i}")) for i in range(4)},
        }
    )
    agree = postal_state_agree(F.col("_postal.base"), F.col("_state"))
    value = lambda c: F.col(f"_{c}.value")
    flags = [F.col(f"_{c}.invalid") for c in ("first", "last", "middle", "addr1", "addr2")]
    valid = ~(value("first").isNull() & value("last").isNull())
    for flag in flags:
        valid = valid & ~flag
    return step.select(
        *df.columns, value("first").alias("first"), value("last").alias("last"), value("middle").alias("middle"),
        F.coalesce(suffix(r("suffix")), F.col("_first.suffix"), F.col("_last.suffix"), F.col("_middle.suffix")).alias("suffix"),
        birth_date(r("birth"), today).alias("dob"), "gov_id", last_four(F.col("gov_id")).alias("gov_id4"), value("addr1").alias("addr1"), value("addr2").alias("addr2"),
        city(r("city")).alias("city"), F.when(agree, F.col("_postal.base")).alias("postal"), F.when(agree, F.col("_postal.ext")).alias("postal_ext"),
        F.when(agree, F.col("_state")).alias("state"), value_set(*[F.col(f"_phone{i}") for i in range(4)]).alias("phones"), email(r("email")).alias("email"),
        sex(r("sex")).alias("sex"), name_tokens(value("first"), value("middle"), value("last")).alias("name_tokens"),
        name_compact(value("first"), value("middle"), value("last")).alias("name_compact"), valid.alias("is_valid"),
    )


def field_counts(cleaned: DataFrame) -> DataFrame:
    """(field, populated, nulled): how many values each rule kept and how many it removed."""
    fields = {"first": "first", "last": "last", "middle": "middle", "dob": "birth", "gov_id": "gov_id", "addr1": "addr1", "email": "email", "sex": "sex", "postal": "postal", "state": "state"}
    sums = [x for c, raw in fields.items() for x in (F.count(c).alias(f"{c}_n"), F.sum(F.when(F.col(c).isNull() & F.col(f"{raw}_raw").isNotNull(), 1).otherwise(0)).alias(f"{c}_x"))]
    one = cleaned.agg(*sums)
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}_n").alias("populated"), F.coalesce(F.col(f"{c}_x"), F.lit(0)).alias("nulled")) for c in fields])
    return one.select(F.inline(rows))
