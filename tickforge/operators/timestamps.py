"""Mixed timestamp texts to one form: the UTC instant in microseconds, or null where a text denotes no single instant.

Each text becomes a mask of character classes (9 for a digit, a for a letter, other characters as they are), all texts of a
batch at once by one lookup over their bytes. A mask fixes where every part of the text stands, so it is mapped to a parser once
per worker, and all texts of a mask are converted together by slicing one matrix of characters. Readings of a clock go through transition
tables of the zone, whose version the driver pins: a worker with other tables refuses.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from zoneinfo import TZPATH, ZoneInfo

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tickforge.session import materialize

#: Texts of more bytes are no timestamps.
LONGEST = 64
#: Sources up to which the table of their clocks is broadcast.
MOST_SOURCES = 10_000
SECOND, HOUR = 1_000_000, 3_600_000_000
NONE = np.iinfo(np.int64).min

# Month and day names, and the hours east of UTC that zone abbreviations stand for.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
DAY_NAMES = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 1, "bst": 1, "cet": 1, "cest": 2, "eet": 2, "eest": 3, "msk": 3, "ist": 5.5, "sgt": 8, "hkt": 8,
    "jst": 9, "kst": 9, "awst": 8, "acst": 9.5, "acdt": 10.5, "aest": 10, "aedt": 11, "nzst": 12, "nzdt": 13,
    "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7, "akst": -9, "akdt": -8, "hst": -10,
}

_DATES = (
    r"(?P<Y>9999)(?P<s1>[-/.])(?P<m>99?)(?P=s1)(?P<d>99?)",
    r"(?P<p>99?)(?P<s2>[-/.])(?P<q>99?)(?P=s2)(?P<Y>9999)",
    r"(?:(?P<w>a{3,9}),? )?(?P<d>99?)[- ](?P<mon>a{3,9})[- ](?P<Y>9999)",
    r"(?:(?P<w>a{3,9}),? )?(?P<mon>a{3,9}) (?P<d>99?),? (?P<Y>9999)",
    r"(?P<Y>9999)(?P<m>99)(?P<d>99)",
)
_TIME = r"(?P<sep>,? |a)(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9{1,9}))?)?(?: ?(?P<ap>aa)(?![a/]))?"
_COMPACT = r"(?P<sep>a| |)(?P<H>99)(?P<M>99)(?P<S>99)(?:[.,](?P<f>9{1,9}))?"
_ZONE = r"(?: ?(?P<sign>[+-])(?P<oh>99)(?::?(?P<om>99))?| ?\[(?P<zone>a[a9/_+-]*)\]| ?(?P<name>a[a9/_+-]*))?"
_SHAPES = [re.compile(d + (t + _ZONE if t else "") + "$") for i, d in enumerate(_DATES) for t in ("", _COMPACT if i == 4 else _TIME)]
_EPOCH = re.compile(r"(?P<e>9{10}|9{13}|9{16}|9{19})(?:\.(?P<f>9{1,9}))?$")
_CLASSES = np.arange(256, dtype=np.uint8)
_CLASSES[[*range(48, 58)]] = ord("9")
_CLASSES[[*range(65, 91), *range(97, 123)]] = ord("a")


@lru_cache(maxsize=4096)
def shapes(mask: str) -> tuple[dict[str, tuple[int, int]], ...]:
    """The ways to read a mask, each as the span of its parts; none if it is no timestamp's."""
    if (m := _EPOCH.match(mask)) and not (m["f"] and len(m["e"]) > 10):
        return ({k: m.span(k) for k in ("e", "f") if m[k] is not None},)
    found = []
    for shape in _SHAPES:
        if m := shape.match(mask):
            spans = {k: m.span(k) for k, x in m.groupdict().items() if x is not None}
            found.append(spans)
            if "ap" in spans:  # the two letters may be a zone instead
                again = dict(spans)
                span = again.pop("ap")
                if "name" not in spans and "zone" not in spans and "sign" not in spans:
                    found.append(again | {"name": span})
    return tuple(found)


@lru_cache(maxsize=1)
def zone_version() -> str:
    """The version of the zone tables in use."""
    for folder in TZPATH:
        try:
            return open(f"{folder}/tzdata.zi").readline().split()[-1]
        except OSError:
            continue
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@lru_cache(maxsize=1024)
def transitions(zone: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(instants of change, offsets from them on) in microseconds, from 1900 to 2200; None if there is no such zone."""
    try:
        tz = ZoneInfo(zone)
    except Exception:
        return None
    offset = lambda t: datetime.fromtimestamp(t, UTC).astimezone(tz).utcoffset() // timedelta(microseconds=1)
    first, last, week = -2_208_988_800, 7_258_118_400, 7 * 86400
    at, offsets = [-(2**62)], [offset(first)]
    for t in range(first, last, week):
        if (now := offset(t + week)) != offsets[-1]:
            lo, hi = t, t + week
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if offset(mid) == offsets[-1] else (lo, mid)
            at.append(hi * SECOND)
            offsets.append(now)
    return np.array(at), np.array(offsets)


def local_to_utc(local: np.ndarray, zone: str | None) -> np.ndarray:
    """Instants of clock readings; NONE where the zone is unknown or its clock shows the reading twice or never."""
    table = transitions(zone) if zone else None
    if table is None:
        return np.full(len(local), NONE)
    at, offsets = table
    of = lambda u: offsets[np.searchsorted(at, u, side="right") - 1]
    a, b = local - of(local - 26 * HOUR), local - of(local + 26 * HOUR)
    fits_a, fits_b = a + of(a) == local, b + of(b) == local
    return np.where(fits_a & fits_b & (a != b), NONE, np.where(fits_a, a, np.where(fits_b, b, NONE)))


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 of proleptic Gregorian dates, and which dates exist."""
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    m = np.where(ok, m, 1)
    months = (np.where(ok, y, 1970) - 1970) * 12 + m - 1
    first = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    after = (months + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    return first + d - 1, ok & (d <= after - first)


def _looked_up(words: np.ndarray, table: dict) -> np.ndarray:
    """table's values of an array of words (bytes), NaN where it has none; looked up once per distinct word."""
    distinct, where = np.unique(words, return_inverse=True)
    return np.array([table.get(w.decode().lower(), np.nan) for w in distinct], float)[where]


_MONTH = {n: i + 1 for names in (MONTHS, MONTH_NAMES) for i, n in enumerate(names)} | {"sept": 9}
_DAY = {n: i for names in (DAYS, DAY_NAMES) for i, n in enumerate(names)}


def _convert(chars: np.ndarray, spans: dict, zones: np.ndarray, names: list, orders: np.ndarray) -> np.ndarray:
    """Instants of texts of one mask, given as rows of ASCII bytes, read in one way. zones: where in names each text's clock stands."""
    n = len(chars)

    def number(key: str, default: int = 0) -> np.ndarray:
        if key not in spans:
            return np.full(n, default, np.int64)
        a, b = spans[key]
        out = np.zeros(n, np.int64)
        for i in range(a, b):
            out = out * 10 + (chars[:, i].astype(np.int64) - 48)
        return out

    def word(key: str) -> np.ndarray:
        a, b = spans[key]
        return np.ascontiguousarray(chars[:, a:b]).view(f"S{b - a}").reshape(n)

    fraction = number("f") * 10 ** max(0, 6 - (spans["f"][1] - spans["f"][0])) // 10 ** max(0, spans["f"][1] - spans["f"][0] - 6) if "f" in spans else np.zeros(n, np.int64)
    if "e" in spans:
        places = spans["e"][1] - spans["e"][0]
        if places == 19:  # may pass 2**63 before the division
            a, b = spans["e"]
            spans = spans | {"e": (a, b - 3)}
            return number("e")
        return number("e") * 10 ** (16 - places) + fraction
    ok = np.ones(n, bool)
    y, m, d = number("Y"), number("m"), number("d")
    if "mon" in spans:
        named = _looked_up(word("mon"), _MONTH)
        ok &= ~np.isnan(named)
        m = np.nan_to_num(named).astype(np.int64)
    if "p" in spans:
        p, q = number("p"), number("q")
        day_first, month_first = orders == "DMY", orders == "MDY"
        sure = (p > 12) ^ (q > 12) | (p == q)
        day_first = np.where(day_first | month_first, day_first, sure & (p > 12))
        ok &= (orders == "DMY") | (orders == "MDY") | sure
        m, d = np.where(day_first, q, p), np.where(day_first, p, q)
    days, real = _days(y, m, d)
    ok &= real
    if "w" in spans:
        ok &= _looked_up(word("w"), _DAY) == (days + 3) % 7
    if "sep" in spans and spans["sep"][1] - spans["sep"][0] == 1:
        ok &= np.isin(word("sep"), [b" ", b"T", b"t"])
    hour, minute, second = number("H"), number("M"), number("S")
    if "ap" in spans:
        half = _looked_up(word("ap"), {"am": 0, "pm": 12})
        ok &= ~np.isnan(half) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + np.nan_to_num(half).astype(np.int64)
    ok &= (hour < 24) & (minute < 60) & (second < 60)
    local = ((days * 24 + hour) * 60 + minute) * 60 * SECOND + second * SECOND + fraction
    if "sign" in spans:
        oh, om = number("oh"), number("om")
        sign = np.where(word("sign") == b"-", -1, 1)
        ok &= (oh <= 18) & (om < 60)
        return np.where(ok, local - sign * (oh * 60 + om) * 60 * SECOND, NONE)
    named = word("name") if "name" in spans else word("zone") if "zone" in spans else None
    out = np.full(n, NONE)
    if named is not None:
        distinct, where = np.unique(named, return_inverse=True)
        for i, w in enumerate(distinct):
            at, w = where == i, w.decode()
            hours = ABBREVIATIONS.get(w.lower())
            out[at] = local_to_utc(local[at], w) if hours is None else local[at] - int(hours * HOUR)
    else:
        distinct, where = np.unique(zones, return_inverse=True)
        for i, zone in enumerate(distinct):
            at = where == i
            out[at] = local_to_utc(local[at], names[zone])
    return np.where(ok, out, NONE)


def _cleaned(texts: pa.Array) -> pa.StringArray:
    """texts without blanks around them, other white space as blanks; those that are too long are null."""
    bulk = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    if ((bulk < 32) | (bulk > 126)).any():
        texts = pc.replace_substring_regex(texts, r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]", " ")
    texts = pc.utf8_trim(texts, " ")
    return pc.if_else(pc.less_equal(pc.binary_length(texts), LONGEST), texts, None)


def _masks(texts: pa.StringArray) -> pa.DictionaryArray:
    """The mask of each text: one table lookup over the bytes of all."""
    texts = pa.concat_arrays([texts])
    valid, ends, bulk = texts.buffers()
    classes = _CLASSES[np.frombuffer(bulk or b"", np.uint8)]
    return pa.StringArray.from_buffers(len(texts), ends, pa.py_buffer(classes), valid, texts.null_count, texts.offset).dictionary_encode()


def parse_texts(texts, zones, orders) -> np.ndarray:
    """Instants (NONE: none) of a batch of texts; zones and orders ('DMY', 'MDY' or '') are those of their vendors' clocks and dates."""
    out = np.full(len(texts), NONE)
    clean = pa.concat_arrays([_cleaned(pa.array(texts, pa.string()))])
    if not len(clean) or clean.null_count == len(clean):
        return out
    zone, order = (pc.fill_null(pa.array(x, pa.string()), "").dictionary_encode() for x in (zones, orders))
    zones, orders, names = np.asarray(zone.indices), np.asarray(order.dictionary.to_pylist(), str)[np.asarray(order.indices)], zone.dictionary.to_pylist()
    masks = _masks(clean)
    which = pc.fill_null(masks.indices, -1).to_numpy(zero_copy_only=False)
    bulk, starts = np.frombuffer(clean.buffers()[2], np.uint8), np.frombuffer(clean.buffers()[1], np.int32)[clean.offset :]
    by = np.argsort(which, kind="stable")
    ends = np.searchsorted(which[by], np.arange(len(masks.dictionary) + 1))
    for k, mask in enumerate(masks.dictionary.to_pylist()):
        at = by[ends[k] : ends[k + 1]]
        for spans in shapes(mask):  # only masks of ASCII characters have any
            left = at[out[at] == NONE]
            if len(left):
                chars = bulk[starts[left][:, None] + np.arange(len(mask))]
                out[left] = _convert(chars, spans, zones[left], names, orders[left])
    return out


def to_instant(text: Column, zone: Column, order: Column, tables: str | None = None) -> Column:
    """Microseconds since 1970 UTC that text denotes, else null. Null, empty, overlong and other texts give null; a zone or offset in
    the text holds; else it is a reading of the clock of ``zone`` (null or unknown: no instant), and one shown twice or never gives
    null. ``order`` is that of purely numeric dates; where it is unknown only dates that allow one reading count. ``tables`` is the version
    of the zone tables, that of the driver by default; RuntimeError where a worker has another."""
    wanted = tables or zone_version()

    @F.arrow_udf(LongType())
    def instants(texts: pa.Array, zones: pa.Array, orders: pa.Array) -> pa.Array:
        if zone_version() != wanted:
            raise RuntimeError(f"zone tables {zone_version()} here, {wanted} wanted")
        found = parse_texts(texts, zones, orders)
        return pa.array(found, mask=found == NONE)

    short = F.when(F.length(text.cast("string")) <= 4 * LONGEST, text.cast("string"))
    return instants(short, zone, order)


def date_orders(df: DataFrame, source: str, text: str) -> DataFrame:
    """(source, date_order): how each source orders purely numeric dates, by the majority of those that allow only one order;
    null where none does or both do alike. Counted over all rows, combined before the shuffle."""
    numeric = df.filter(F.col(source).isNotNull() & F.col(text).rlike(r"^\s*[0-9]{1,2}([-/.])[0-9]{1,2}\1[0-9]{4}(?![0-9])"))
    parts = F.split(F.ltrim(text), "[-/.]", 3)
    p, q = (F.trim(F.get(parts, k)).try_cast("int") for k in (0, 1))
    votes = numeric.select(source, p.alias("_p"), q.alias("_q")).groupBy(source).agg(
        F.count_if((F.col("_p") > 12) & (F.col("_p") <= 31) & F.col("_q").between(1, 12)).alias("_d"),
        F.count_if((F.col("_q") > 12) & (F.col("_q") <= 31) & F.col("_p").between(1, 12)).alias("_m"),
    )
    return votes.select(source, F.when(F.col("_d") > F.col("_m"), "DMY").when(F.col("_m") > F.col("_d"), "MDY").alias("date_order"))


def normalise(df: DataFrame, clocks: DataFrame, text: str, out: str, source: str = "source", zone: str = "tz_name") -> DataFrame:
    """df with ``out``, the instant of each text (see to_instant), by the clock of its source in ``clocks`` and the date order
    its texts show. Sources that clocks lacks have no clock; df keeps all its rows and columns."""
    known = clocks.select(F.col(source).alias("_tf_source"), F.col(zone).alias("_tf_zone")).filter("_tf_source is not null")
    known = known.groupBy("_tf_source").agg(F.min("_tf_zone").alias("_tf_zone"))
    orders = date_orders(df, source, text).select(F.col(source).alias("_tf_source"), F.col("date_order").alias("_tf_order"))
    about = known.join(orders, "_tf_source", "full")
    few = about.limit(MOST_SOURCES + 1).collect()  # so that the join does not count the votes again
    about = F.broadcast(df.sparkSession.createDataFrame(few, about.schema)) if len(few) <= MOST_SOURCES else materialize(about, "sources")
    joined = df.join(about, df[source] == about["_tf_source"], "left")
    return joined.withColumn(out, to_instant(df[text], F.col("_tf_zone"), F.col("_tf_order"))).select(*[c for c in df.columns if c != out], out)
