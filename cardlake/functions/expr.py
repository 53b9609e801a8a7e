"""Scalar functions as Column expressions, shared by batch and streaming jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the event contract: region codes, country names, channels, merchant groups.
US_STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC PR VI GU AS MP".split()
COUNTRIES = {
    "Italy": "IT", "Mexico": "MX", "France": "FR", "Bangladesh": "BD", "Norway": "NO", "Malaysia": "MY", "Greece": "GR", "Netherlands": "NL",
    "Japan": "JP", "Spain": "ES", "Czech Republic": "CZ", "Thailand": "TH", "China": "CN", "Canada": "CA", "Germany": "DE", "United Kingdom": "GB",
    "Portugal": "PT", "Switzerland": "CH", "Sweden": "SE", "Poland": "PL", "Austria": "AT", "Belgium": "BE", "Ireland": "IE", "India": "IN",
    "South Korea": "KR", "Vietnam": "VN", "Philippines": "PH", "Indonesia": "ID", "Australia": "AU", "Brazil": "BR", "Argentina": "AR", "South Africa": "ZA",
}
CHANNELS = {"Chip Transaction": "chip", "Swipe Transaction": "swipe", "Online Transaction": "online"}
MCC_GROUPS = {
    "travel": [4111, 4112, 4121, 4131, 4411, 4511],
    "grocery": [5411, 5422, 5451, 5499],
    "cash": [4829, 6010, 6011, 6012],
    "online_retail": [5300, 5310, 5311, 5964, 5965, 5966, 5967, 5968, 5969],
}
MCC_IDS = {"travel": 0, "grocery": 1, "cash": 2, "online_retail": 3, "other": 4}


def token(salt: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(salt), *(p.cast("string") for p in parts)), 256)


#: Parts of made-up names.
GIVEN = "Ada Bela Caro Dana Emil Finn Gita Hugo Ida Juno Kito Lena Milo Nora Odin Pia Quin Rosa Sven Tilda".split()
FAMILY = "Adler Berg Conti Dahl Eder Fuchs Grau Holm Iversen Jansen Keller Lund Moser Nagy Olsen Peters Quist Roth Stein Toth".split()


def made_up_name(key: Column, salt: str) -> Column:
    """A name for a key: the same one each time, and another one for another salt. Null for null."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string")))
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") % len(names) + 1).cast("int"))
    return F.when(key.isNotNull(), F.concat(pick(GIVEN, 1), F.lit(" "), pick(FAMILY, 9)))


def mask_token(token: Column) -> Column:
    """The last six characters; a dummy for none."""
    return F.when(token.isNull() | (token == ""), "…unknown").otherwise(F.concat(F.lit("…"), F.right(token, F.lit(6))))


def money(text: Column) -> Column:
    return F.translate(F.trim(text), "$,", "").try_cast("double")


def event_time(year: Column, month: Column, day: Column, hhmm: Column) -> Column:
    """UTC time from parts as text; null if it is none."""
    hour, minute = (F.split_part(hhmm, F.lit(":"), F.lit(i)).try_cast("int") for i in (1, 2))
    return F.try_make_timestamp_ntz(year.try_cast("int"), month.try_cast("int"), day.try_cast("int"), hour, minute, F.lit(0))


def iso(time: Column, *, millis: bool = False) -> Column:
    """ISO 8601 in UTC with Z. The session's time zone is UTC (see ``session``).

    With millis, times of years of four digits are put together from numbers, which is faster there than date_format; without, date_format is."""
    if not millis:
        return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    day = F.to_date(time)
    date = F.concat_ws("-", F.lpad(F.year(day).cast("string"), 4, "0"), two(F.month(day)), two(F.day(day)))
    clock = F.concat_ws(":", two(F.hour(time)), two(F.minute(time)), two(F.second(time)))
    part = F.lpad(F.pmod(F.unix_millis(time.cast("timestamp")), F.lit(1000)).cast("string"), 3, "0")
    usual = F.concat(date, F.lit("T"), clock, F.lit("."), part, F.lit("Z"))
    return F.when(F.year(time).between(1, 9999), usual).otherwise(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def parse_iso(text: Column) -> Column:
    """A timestamp from ISO 8601 with Z or an offset; null if it is none."""
    return text.try_cast("timestamp")


def filled(text: Column, values: dict[str, str | Column]) -> Column:
    """Text with ${NAME} replaced by its value, a text or a column; names without one stay."""
    for name, value in values.items():
        text = F.replace(text, F.lit("${" + name + "}"), F.lit(value) if isinstance(value, str) else value)
    return text


def lookup(values: dict[str, str], key: Column, default: str) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def country(channel: Column, state: Column) -> Column:
    s = F.trim(state)
    return F.when(
        (channel == "online") | s.isNull() | (s == ""), "XX"
    ).when(F.upper(s).isin(US_STATES), "US").otherwise(lookup(COUNTRIES, s, "XX"))


def zip_code(text: Column) -> Column:
    t = F.trim(text)
    return F.when(F.lower(t).isin("", "nan"), None).otherwise(F.coalesce(t.try_cast("double").cast("bigint").cast("string"), t))


def yes_no(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("yes", "true"), True).when(t.isin("no", "false"), False)


def mcc_group(mcc: Column) -> Column:
    out = F.when(mcc.between(3000, 3999), "travel")
    for name, codes in MCC_GROUPS.items():
        out = out.when(mcc.isin(codes), name)
    return out.otherwise("other")


def mcc_group_id(mcc: Column) -> Column:
    return lookup({k: str(v) for k, v in MCC_IDS.items()}, mcc_group(mcc), "4").cast("int")


def cross_border(country: Column) -> Column:
    return F.coalesce(~country.isin("US", "XX"), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
