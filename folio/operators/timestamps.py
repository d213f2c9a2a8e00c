"""Mixed timestamp formats and zones to one instant in UTC (problem 3).

Each value is parsed under every format that it fits. Where day and month can be told either way, two formats of the same
shape (separator, width of the year, place of the time) compete, and *expectation-maximisation* over the mixture of
formats of each source decides between them:

* E step: a value is shared out over its valid parses by the weight of each format times the value's likelihood under it
  (a weekday that a parse contradicts makes it unlikely);
* M step: a format's weight follows from what fell to it, from the order that the source's other shapes show, and from
  the declared order, a prior worth ``PRIOR`` values: a source that writes otherwise than it declares overrules it.

The posterior of each source and shape chooses; what stays between the bounds is marked as ambiguous. The sufficient statistics
are five counts per source and shape, so the iteration runs on one short row per source whatever the number of values. Zones
are resolved by Spark itself: a local time that the zone's clocks skip or show twice names no instant.

Plan: values are parsed once and staged; counts combine before their shuffle; the posteriors return to the values by a
broadcast of checked size, else by a join salted within each source.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.session import hot_join, stage

__all__ = ["format_posteriors", "normalise_timestamps", "parse_value"]

#: What a declared order weighs, in values of the source.
PRIOR = 30.0
#: What the order of the source's other shapes weighs in one shape, in values.
SHARED = 30.0
#: Likelihood of a parse that the value's own weekday contradicts, against 1.
WRONG_DAY = 0.002

#: Month names by language, fixed values; case folded, without closing dots. Languages written differently by case list both cases' forms.
MONTHS = {
    "en": ["january jan", "february feb", "march mar", "april apr", "may", "june jun", "july jul", "august aug", "september sep sept", "october oct", "november nov", "december dec"],
    "fr": ["janvier janv jan", "février fevrier févr fevr fév fev", "mars mar", "avril avr", "mai", "juin", "juillet juil", "août aout aoû", "septembre sept sep", "octobre oct", "novembre nov", "décembre decembre déc dec"],
    "es": ["enero ene", "febrero feb", "marzo mar", "abril abr", "mayo may", "junio jun", "julio jul", "agosto ago", "septiembre setiembre sep sept set", "octubre oct", "noviembre nov", "diciembre dic"],
    "de": ["januar jänner jan jän", "februar feber feb", "märz maerz mär mrz", "april apr", "mai", "juni jun", "juli jul", "august aug", "september sep sept", "oktober okt", "november nov", "dezember dez"],
    "ru": ["января январь янв", "февраля февраль фев февр", "марта март мар", "апреля апрель апр", "мая май", "июня июнь июн", "июля июль июл", "августа август авг", "сентября сентябрь сен сент", "октября октябрь окт", "ноября ноябрь ноя нояб", "декабря декабрь дек"],
    "pl": ["stycznia styczeń sty", "lutego luty lut", "marca marzec mar", "kwietnia kwiecień kwi", "maja maj", "czerwca czerwiec cze", "lipca lipiec lip", "sierpnia sierpień sie", "września wrzesień wrz", "października październik paź", "listopada listopad lis", "grudnia grudzień gru"],
    "pt": ["janeiro jan", "fevereiro fev", "março marco mar", "abril abr", "maio mai", "junho jun", "julho jul", "agosto ago", "setembro set", "outubro out", "novembro nov", "dezembro dez"],
    "it": ["gennaio gen", "febbraio feb", "marzo mar", "aprile apr", "maggio mag", "giugno giu", "luglio lug", "agosto ago", "settembre set", "ottobre ott", "novembre nov", "dicembre dic"],
}
#: Names of the days from Monday by language, fixed values; case folded, without closing dots.
WEEKDAYS = {
    "en": "monday mon|tuesday tue tues|wednesday wed|thursday thu thur thurs|friday fri|saturday sat|sunday sun",
    "fr": "lundi lun|mardi mar|mercredi mer|jeudi jeu|vendredi ven|samedi sam|dimanche dim",
    "es": "lunes lun|martes mar|miércoles mié|jueves jue|viernes vie|sábado sáb|domingo dom",
    "de": "montag mo|dienstag di|mittwoch mi|donnerstag do|freitag fr|samstag sonnabend sa|sonntag so",
    "ru": "понедельник пн|вторник вт|среда ср|четверг чт|пятница пт|суббота сб|воскресенье вс",
    "pl": "poniedziałek pon|wtorek wt|środa śr|czwartek czw|piątek pt|sobota sob|niedziela niedz",
    "pt": "segunda-feira seg|terça-feira ter|quarta-feira qua|quinta-feira qui|sexta-feira sex|sábado sáb|domingo dom",
    "it": "lunedì lun|martedì mar|mercoledì mer|giovedì gio|venerdì ven|sabato sab|domenica dom",
}
_WEEKDAYS = {lang: {name: k for k, names in enumerate(text.split("|")) for name in names.split()} for lang, text in WEEKDAYS.items()}
_MONTH = {lang: {name: m for m, names in enumerate(rows, 1) for name in names.split()} for lang, rows in MONTHS.items()}
#: Zone abbreviations in minutes east of UTC: European, North American and Japanese meaning, fixed values.
ZONES = {
    "utc": 0, "gmt": 0, "z": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120, "eet": 120, "eest": 180, "msk": 180, "msd": 240,
    "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "akst": -540, "akdt": -480, "hst": -600, "hast": -600, "hdt": -540, "jst": 540,
}
_TIME = r"(?P<h>\d{1,2})\s*(?::|h|\.(?=\d{2}(?!\d)))\s*(?P<mi>\d{2})(?:\s*[:.]\s*(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[ap]\.? ?m\.?))?(?:\s*uhr)?"
_OFFSET = r"(?P<sign>[+\-−])(?P<oh>\d{1,2}):?(?P<om>\d{2})?"
_ZONE = rf"(?:\s*(?:(?P<z>z)(?![a-z])|(?:(?:gmt|utc)\s*)?{_OFFSET}|(?P<abbr>[a-z]{{2,4}})(?![\w/]))?(?:\s*\[(?P<named>[a-z_]+(?:/[a-z_+\-0-9]+)*)\]|\s+(?P<area>[a-z]+(?:/[a-z_+\-0-9]+)+)|\s*\([^()]*\))?)"
_WEEKDAY = r"(?:[^\W\d]{2,12}\.?,?\s+)?"
_NAME = r"(?P<mon>[^\W\d_]{3,12})\.?"
_JOIN = r"(?:\s*,?\s*(?:t(?=\d)|at|um|à|a\s+las?|a|в|o|às|alle|·|\||-|–|—)?\s*)"
_FORMATS = [
    ("ymd", rf"(?P<y>\d{{4}})[\-/.](?P<m>\d{{1,2}})[\-/.](?P<d>\d{{1,2}})(?:\s*t\s*|{_JOIN}){_TIME}{_ZONE}"),
    ("basic", rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})\s*[t ]\s*(?P<h>\d{{2}}):?(?P<mi>\d{{2}})(?::?(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?)?(?P<ap>(?!))?{_ZONE}"),
    ("name_dmy", rf"{_WEEKDAY}(?P<d>\d{{1,2}})(?:st|nd|rd|th|\.|er|º|°)?[\s\-]*(?:de\s+|of\s+)?{_NAME}[\s\-]*,?\s*(?:de\s+|del\s+)?(?P<y>\d{{4}}|\d{{2}})(?:\s*(?:г\.?|года))?{_JOIN}{_TIME}{_ZONE}"),
    ("name_mdy", rf"{_WEEKDAY}{_NAME}\s*(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}){_JOIN}{_TIME}{_ZONE}"),
    ("name_end", rf"{_WEEKDAY}{_NAME}\s+(?P<d>\d{{1,2}})\s+{_TIME}{_ZONE}\s+(?P<y>\d{{4}})"),
    ("number", rf"(?:(?P<wd>[^\W\d][^\W\d-]{{0,14}}(?:-[^\W\d]{{2,6}})?)\.?,?\s+)?(?P<n1>\d{{1,2}})(?P<sep>[./\-])(?P<n2>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}|\d{{2}}){_JOIN}{_TIME}{_ZONE}"),
    ("time_first", rf"{_TIME}\s*[,·|]?\s+(?P<n1>\d{{1,2}})(?P<sep>[./\-])(?P<n2>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}|\d{{2}})(?P<z>(?!))?(?P<sign>(?!))?(?P<abbr>(?!))?(?P<named>(?!))?(?P<area>(?!))?"),
]
_COMPILED = [(name, re.compile(pattern)) for name, pattern in _FORMATS]
_EPOCH = re.compile(r"\d{9,10}(?:\.\d+)?|\d{12,13}|\d{15,16}|\d{18,19}")
_DAY0 = date(1970, 1, 1).toordinal()


def _days(y: int, m: int, d: int) -> int | None:
    try:
        return date(y, m, d).toordinal() - _DAY0
    except ValueError:
        return None


def parse_value(value: str | None, lang: str | None):
    """(format, day-first seconds, month-first seconds, offset seconds, zone, weekday's word), or None.

    The format of numeric dates tells their shape: separator and width of the year. The last is 1 where a weekday agrees with the
    day-first parse alone, -1 where with the month-first one alone, else 0. Seconds are of the local clock; the two agree, or one is None, where the order is not open. ``offset``
    is set where the value gives one, ``zone`` where it names one; the epoch counts as offset 0.
    None for what is not a date, is impossible, or has no time of day.
    """
    if not value:
        return None
    text = " ".join(unicodedata.normalize("NFKC", value).split()).casefold().replace("−", "-")
    if not text:
        return None
    if _EPOCH.fullmatch(text):
        whole = text.split(".")[0]
        s = int(whole) // (1, 1000, 10**6, 10**9)[(len(whole) > 10) + (len(whole) > 13) + (len(whole) > 16)]
        return "epoch", s, s, 0, None, 0
    for name, pattern in _COMPILED:
        m = pattern.fullmatch(text)
        if m is None:
            continue
        g = m.groupdict()
        h, mi, s = int(g["h"]), int(g["mi"]), int(g["s"] or 0)
        if g["ap"]:
            if not 1 <= h <= 12:
                return None
            h = h % 12 + (12 if g["ap"][0] == "p" else 0)
        if h > 23 or mi > 59 or s > 59:
            return None
        clock = h * 3600 + mi * 60 + s
        year = int(g["y"]) + (2000 if len(g["y"]) == 2 else 0)
        offset = zone = None
        if g["z"]:
            offset = 0
        elif g["sign"]:
            oh, om = int(g["oh"]), int(g["om"] or 0)
            if oh > 18 or om > 59:
                return None
            offset = (oh * 3600 + om * 60) * (-1 if g["sign"] == "-" else 1)
        elif g["abbr"]:
            if g["abbr"] not in ZONES:
                continue
            offset = ZONES[g["abbr"]] * 60
        if offset is None and (g["named"] or g["area"]):
            zone = g["named"] or g["area"]
            if zone in ZONES:
                offset, zone = ZONES[zone] * 60, None
        if "mon" in g:
            names = _MONTH.get((lang or "").casefold()[:2], {})
            month = names.get(g["mon"]) or _MONTH["en"].get(g["mon"])
            if month is None:
                continue
            day = _days(year, month, int(g["d"]))
            if day is None:
                return None
            return name, day * 86400 + clock, day * 86400 + clock, offset, zone, 0
        if "n1" in g:
            a, b = int(g["n1"]), int(g["n2"])
            first, second = _days(year, b, a), _days(year, a, b)
            if first is None and second is None:
                return None
            word = 0
            if first is not None and second is not None and g.get("wd"):
                said = _WEEKDAYS.get((lang or "").casefold()[:2], {}).get(g["wd"], _WEEKDAYS["en"].get(g["wd"]))
                if said is not None:  # 1 January 1970 was a Thursday
                    word = ((first + 3) % 7 == said) - ((second + 3) % 7 == said)
            return f"{name}{g['sep']}{len(g['y'])}", None if first is None else first * 86400 + clock, None if second is None else second * 86400 + clock, offset, zone, word
        day = _days(year, int(g["m"]), int(g["d"]))
        if day is None:
            return None
        return name, day * 86400 + clock, day * 86400 + clock, offset, zone, 0
    return None


def format_posteriors(counts: list[tuple[float, float, float, float, float]], declared: str | None, prior: float = PRIOR, shared: float = SHARED, rounds: int = 200) -> list[float]:
    """Weight of the day-first format among the two of each shape, by expectation-maximisation over a source's mixture of formats.

    ``counts``: for each shape the values that are valid day first only, month first only, either way, and either way with a
    weekday that speaks for the one or the other. ``declared``: ``dmy``, ``mdy`` or neither, then the prior is even and worth two values.
    """
    a, b = (prior, 0.5) if declared == "dmy" else (0.5, prior) if declared == "mdy" else (1.0, 1.0)
    source = a / (a + b)
    weights = [source] * len(counts)
    for _ in range(rounds):
        # E step: what falls to the day-first format of each shape
        day = []
        for (only, _, open_, said, gainsaid), w in zip(counts, weights):
            for_it = w / (w + (1 - w) * WRONG_DAY)
            against = w * WRONG_DAY / (w * WRONG_DAY + (1 - w))
            day.append(only + open_ * w + said * for_it + gainsaid * against)
        # M step: the source's order from all shapes and the declaration, each shape's from its own values and the source's
        total = [sum(c) for c in counts]
        source = (sum(day) + a) / (sum(total) + a + b)
        new = [(d + shared * source) / (n + shared) for d, n in zip(day, total)]
        step = max((abs(x - y) for x, y in zip(new, weights)), default=0.0)
        weights = new
        if step < 1e-10:
            break
    return weights


_PARSED = "format string, day_s bigint, month_s bigint, offset_s int, zone string, word int"


def _known_zones(spark: SparkSession) -> dict[str, str]:
    """The names of zones that Spark's own conversion takes, by their case-folded form: a fixed list of some 600."""
    return {str(z).casefold(): str(z) for z in spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds()}


def _parse_column(value: Column, lang: Column, tz: Column, zones: dict[str, str]) -> Column:
    @F.pandas_udf(_PARSED)
    def parse(values, langs, tzs):  # noqa: ANN001
        import pandas as pd

        rows = []
        for v, g, own in zip(values, langs, tzs):
            p = parse_value(v, g)
            if p is None:
                rows.append((None,) * 6)
            elif p[3] is not None:
                rows.append(p)
            elif p[4] is not None:  # a zone that nobody knows makes the value none at all
                zone = zones.get(p[4])
                rows.append((*p[:4], zone, p[5]) if zone else (None,) * 6)
            else:
                rows.append((*p[:4], zones.get(own.casefold()) if own else None, p[5]))
        out = pd.DataFrame(rows, columns=["format", "day_s", "month_s", "offset_s", "zone", "word"])
        return out.astype({"day_s": "Int64", "month_s": "Int64", "offset_s": "Int32", "word": "Int32"})

    return parse(value, lang, tz)


_COUNTS = ("day_only", "month_only", "open", "said", "gainsaid")


def _posteriors(stats: DataFrame) -> DataFrame:
    """(source, format, p_day) from (source, format, counts, date_order): the shapes of a source, a dozen at most, are one row of arrays."""
    rows = stats.groupBy("source").agg(F.first("date_order", ignorenulls=True).alias("declared"), F.collect_list(F.struct("format", *_COUNTS)).alias("shapes"))
    out = pa.schema([("source", pa.string()), ("format", pa.string()), ("p_day", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, formats, weights = [], [], []
            for source, declared, shapes in zip(*(c.to_pylist() for c in batch.columns)):
                shapes.sort(key=lambda x: x["format"])
                weights += format_posteriors([tuple(x[c] for c in _COUNTS) for x in shapes], declared)
                formats += [x["format"] for x in shapes]
                sources += [source] * len(shapes)
            yield pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(formats, pa.string()), pa.array(weights, pa.float64())], schema=out)

    return rows.select("source", "declared", "shapes").mapInArrow(run, "source string, format string, p_day double")


def normalise_timestamps(values: DataFrame, sites: DataFrame, sure: float = 0.9) -> DataFrame:
    """(page_id, field, value, format, utc_s, state): one row for each given value.

    ``values``: (page_id, field, value, site); ``site`` may be null. ``sites``: (site, lang, tz, date_order). ``state`` is
    ``exact``; ``no date`` (not a date, impossible, or without time of day), ``skipped`` or ``repeated`` (clocks
    go forward or back), ``ambiguous`` (order undecided) or ``no zone``: these have no utc_s. Null values give ``no date``.
    """
    own = sites.where("site is not null").dropDuplicates(["site"]).select("site", "lang", "tz", "date_order")
    given = values.select("page_id", "field", "value", "site")  # other columns may have the names of those added here
    rows = hot_join(given, own, ["site"], "page_id", how="left").withColumn("p", _parse_column(F.col("value"), F.col("lang"), F.col("tz"), _known_zones(values.sparkSession)))
    rows = stage(rows.select("page_id", "field", "value", F.coalesce("site", F.lit("")).alias("source"), "date_order", "p.*"), "dates")
    open_ = F.col("day_s").isNotNull() & F.col("month_s").isNotNull() & (F.col("day_s") != F.col("month_s"))
    numeric = F.col("format").rlike("^(number|time_first)")
    conditions = (F.col("month_s").isNull(), F.col("day_s").isNull(), open_ & (F.col("word") == 0), open_ & (F.col("word") > 0), open_ & (F.col("word") < 0))
    stats = rows.where(numeric).groupBy("source", "format").agg(*(F.count_if(c).cast("double").alias(name) for name, c in zip(_COUNTS, conditions)), F.first("date_order", ignorenulls=True).alias("date_order"))
    rows = hot_join(rows, _posteriors(stats), ["source", "format"], "page_id", how="left")
    # a value's own weekday counts in its posterior
    for_it, against = (F.when(F.col("word") >= 0, F.lit(1.0)).otherwise(F.lit(WRONG_DAY)), F.when(F.col("word") <= 0, F.lit(1.0)).otherwise(F.lit(WRONG_DAY)))
    rows = rows.withColumn("p_day", F.col("p_day") * for_it / (F.col("p_day") * for_it + (1 - F.col("p_day")) * against))
    local = F.when(~open_, F.coalesce("day_s", "month_s")).when(F.col("p_day") >= sure, F.col("day_s")).when(F.col("p_day") <= 1 - sure, F.col("month_s"))
    rows = rows.withColumn("local", local).withColumn("in_zone", F.when(F.col("offset_s").isNull(), F.col("zone")))
    # the session's own zone plays no part: plain seconds go through the zone's rules and back
    ts = F.timestamp_seconds("local")
    utc = F.to_utc_timestamp(ts, F.col("in_zone"))
    back = lambda u: F.from_utc_timestamp(u, F.col("in_zone"))
    seconds = lambda t: F.unix_seconds(t)
    rows = rows.withColumn("u", F.when(F.col("in_zone").isNotNull(), utc))
    same = lambda d: seconds(back(F.timestamp_seconds(seconds(F.col("u")) + F.lit(d)))) == F.col("local")
    skipped = ~same(0)
    repeated = same(3600) | same(-3600) | same(1800) | same(-1800) | same(7200) | same(-7200)
    state = (
        F.when(F.col("format").isNull(), "no date")
        .when(F.col("local").isNull(), "ambiguous")
        .when(F.col("offset_s").isNotNull(), "exact")
        .when(F.col("in_zone").isNull(), "no zone")
        .when(skipped, "skipped")
        .when(repeated, "repeated")
        .otherwise("exact")
    )
    rows = rows.withColumn("state", state)
    utc_s = F.when(F.col("state") == "exact", F.when(F.col("offset_s").isNotNull(), F.col("local") - F.col("offset_s")).otherwise(seconds(F.col("u"))))
    return rows.select("page_id", "field", "value", "format", utc_s.cast("bigint").alias("utc_s"), "state")
