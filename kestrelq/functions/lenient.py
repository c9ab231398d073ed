"""Scalar functions of a lenient SQL dialect as Column expressions, native throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(x: Column) -> Column:
    """ASCII letters only."""
    return F.translate(x, _UPPER, _LOWER)


def upper(x: Column) -> Column:
    return F.translate(x, _LOWER, _UPPER)


def substr(x: Column, start: int, length: int | None = None) -> Column:
    """Negative starts count from the end; start 0 takes one character less; negative lengths take those before."""
    n = F.length(x)
    first = F.lit(start) if start > 0 else n + start + 1 if start < 0 else F.lit(0)
    end = n + 1 if length is None else first + length
    low, high = (first, end) if length is None or length >= 0 else (end, first)
    low2, high2 = F.greatest(low, F.lit(1)), F.least(high, n + 1)
    return F.when(x.isNull(), None).otherwise(F.substring(x, low2, F.greatest(high2 - low2, F.lit(0))))


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob: * ? [set] [^set]."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out += f"[{inner}]"
            i = end
        else:
            out += "\\" + c if not c.isalnum() else c
        i += 1
    return f"^(?s:{out})$"


def glob(x: Column, pattern: str) -> Column:
    return x.rlike(glob_pattern(pattern))


def like(x: Column, pattern: str, escape: str | None = None) -> Column:
    """ASCII letters match either case."""
    found, p = lower(x), F.lit(pattern.lower())
    return F.like(found, p, F.lit(escape)) if escape else F.like(found, p)


def to_integer(x: Column) -> Column:
    """The longest numeric prefix of a text, cut to an integer; 0 without one."""
    number = F.regexp_extract(x.cast("string"), r"^\s*([+-]?\d+)", 1)
    return F.when(x.isNull(), None).otherwise(F.coalesce(F.when(number != "", number.cast("bigint")), F.lit(0)))


def to_real(x: Column) -> Column:
    number = F.regexp_extract(x.cast("string"), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(x.isNull(), None).otherwise(F.coalesce(F.when(number != "", number.cast("double")), F.lit(0.0)))


def divide(a: Column, b: Column) -> Column:
    """Integer division cuts toward zero; null where b is 0."""
    return F.when(b != 0, F.call_function("div", a, b))


def quote(x: Column) -> Column:
    return F.coalesce(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def greatest(*x: Column) -> Column:
    """Null if any argument is."""
    return F.when(_any_null(x), None).otherwise(F.greatest(*x))


def least(*x: Column) -> Column:
    return F.when(_any_null(x), None).otherwise(F.least(*x))


def _any_null(x: tuple[Column, ...]) -> Column:
    out = x[0].isNull()
    for c in x[1:]:
        out = out | c.isNull()
    return out


def julianday(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp")) / F.lit(86400e6) + F.lit(2440587.5)


def _later(t: Column, months: Column) -> Column:
    first = F.add_months(F.trunc(t.cast("date"), "month"), months).cast("timestamp")
    return F.timestamp_micros(F.unix_micros(first) + (F.unix_micros(t) - F.unix_micros(F.date_trunc("month", t))))


def _capped_month(t: Column, months: int) -> Column:
    """The same day some months later, or the last one of a month that is too short."""
    return F.timestamp_micros(F.unix_micros(F.add_months(t.cast("date"), months).cast("timestamp")) + (F.unix_micros(t) - F.unix_micros(F.date_trunc("day", t))))


def timediff(a: Column, b: Column) -> Column:
    """What to add to b for a: sign, whole years and months, days, and time, as `+0000-00-00 00:00:00.000`."""
    a, b = a.cast("timestamp"), b.cast("timestamp")
    forward = a >= b
    sign = F.when(forward, 1).otherwise(-1)
    months = sign * (12 * (F.year(a) - F.year(b)) + F.month(a) - F.month(b))
    past = lambda n: F.when(forward, _later(b, n) > a).otherwise(_later(b, -n) < a)
    # a month that overflows can end past the next one's start, so two steps back are enough
    months = F.when(~past(months), months).when(~past(months - 1), months - 1).otherwise(months - 2)
    rest = sign * (F.unix_micros(a) - F.unix_micros(_later(b, sign * months)))
    left = F.floor(rest / 1000).cast("bigint")
    part = lambda size, of: (F.floor(left / size) % of).cast("int")
    clock = (part(3600000, 24), part(60000, 60), part(1000, 60), (left % 1000).cast("int"))
    text = F.format_string("%s%04d-%02d-%02d %02d:%02d:%02d.%03d", F.when(forward, "+").otherwise("-"), F.floor(months / 12).cast("int"), (months % 12).cast("int"), F.floor(left / 86400000).cast("int"), *clock)
    return F.when(a.isNotNull() & b.isNotNull(), text)


def _unit(word: str) -> str:
    return word.lower().rstrip("s")


def instant(x: Column, *modifiers: str, far: bool = False) -> Column:
    """A time value as a timestamp: `YYYY-MM-DD` with or without `HH:MM[:SS[.fff]]` (`T` or a blank between, `Z` or
    an offset behind), a time alone (on 2000-01-01), a Julian day number, or with a first modifier of unixepoch,
    julianday or auto a number of that kind. Null for anything else, and for numbers outside the years 0000 to 9999,
    or with `far` outside what a timestamp holds."""
    text = F.trim(x.cast("string"))
    zone = r"(?: ?(?:Z|z|[+-](?:0\d|1[0-4]):[0-5]\d))?"
    clock = r"(?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?"
    day = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
    # a day that its month lacks runs into the next month
    first = F.to_timestamp(F.concat(F.substring(text, 1, 8), F.lit("01")), "yyyy-MM-dd")
    date = F.timestamp_micros(F.unix_micros(first) + (F.substring(text, 9, 2).cast("int") - 1).cast("long") * 86_400_000_000)
    offset = F.regexp_extract(text, r"([+-])(\d\d):(\d\d)$", 1)
    minutes = F.regexp_extract(text, r"[+-](\d\d):(\d\d)$", 1).try_cast("int") * 60 + F.regexp_extract(text, r"[+-](\d\d):(\d\d)$", 2).try_cast("int")
    shift = F.when(offset == "", 0).otherwise(F.when(offset == "-", minutes).otherwise(-minutes))
    hms = lambda at: (F.substring(at, 1, 2).cast("long") * 3600 + F.substring(at, 4, 2).cast("long") * 60) * 1_000_000 + F.coalesce(F.round(F.regexp_extract(at, r"^\d\d:\d\d:(\d\d(?:\.\d+)?)", 1).try_cast("double") * 1000) * 1000, F.lit(0)).cast("long")
    plus = lambda base, micros: F.timestamp_micros(F.unix_micros(base) + micros)
    minute = shift.cast("long") * 60_000_000
    number = F.when(text.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)$"), text.try_cast("double"))
    # far: whole seconds that 64 bits of microseconds hold
    early, late = (-9223372022400, 9223372036854) if far else (-62167219200, 253402300799)
    days = ((number - 2440587.5) * 86400).between(early, late) if far else (number >= 0) & (number < 5373484.5)
    julian = F.when(days, F.timestamp_micros(F.round((number - 2440587.5) * 86400e3).cast("long") * 1000))
    epoch = F.when((number >= early) & (number <= late), F.timestamp_micros(F.round(number * 1e3).cast("long") * 1000))
    kind = modifiers[0].strip().lower() if modifiers else ""
    if kind == "unixepoch":
        out = epoch
    elif kind == "julianday":
        out = julian
    else:
        if kind == "auto":
            julian = F.when((number >= 0) & (number < 5373484.5), julian).otherwise(epoch)
        out = (
            F.when(text.rlike(f"^{day}$"), date)
            .when(text.rlike(f"^{day}[T ]+{clock}{zone}$"), plus(date, hms(F.regexp_extract(text, rf"({clock})", 1)) + minute))
            .when(text.rlike(f"^{clock}{zone}$"), plus(F.lit("2000-01-01").cast("timestamp"), hms(F.regexp_extract(text, rf"({clock})", 1)) + minute))
            .otherwise(julian)
        )
    rest = modifiers[1:] if kind in ("unixepoch", "julianday", "auto") else modifiers
    return modified(out, *(m for m in rest if m.strip().lower() not in ("subsec", "subsecond")))


def _shown(pattern: str, x: Column, modifiers: tuple[str, ...], far: bool) -> Column:
    fine = any(m.strip().lower() in ("subsec", "subsecond") for m in modifiers)
    t, pattern = instant(x, *modifiers, far=far), pattern + (".SSS" if fine and "s" in pattern else "")
    if not far or not pattern.startswith("yyyy"):
        return F.date_format(t, pattern)
    year = F.year(t)
    digits = F.when(year.between(0, 9999), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string"))
    return F.concat(digits, F.date_format(t, pattern.removeprefix("yyyy")))


def date(x: Column, *modifiers: str, far: bool = False) -> Column:
    """YYYY-MM-DD; with `far` also years before 0000 and after 9999, with a minus or more digits."""
    return _shown("yyyy-MM-dd", x, modifiers, far)


def time(x: Column, *modifiers: str, far: bool = False) -> Column:
    """HH:MM:SS, with milliseconds after a modifier of subsec."""
    return _shown("HH:mm:ss", x, modifiers, far)


def datetime(x: Column, *modifiers: str, far: bool = False) -> Column:
    return _shown("yyyy-MM-dd HH:mm:ss", x, modifiers, far)


def octet_length(x: Column) -> Column:
    """Bytes of the UTF-8 text."""
    return F.octet_length(x.cast("string"))


def trim(x: Column, characters: str = " ", left: bool = True, right: bool = True) -> Column:
    """Takes any of the characters off the ends."""
    if not characters:
        return x
    inner = "".join("\\" + c if not c.isalnum() else c for c in characters)
    out = F.regexp_replace(x, f"^[{inner}]+", "") if left else x
    return F.regexp_replace(out, f"[{inner}]+$", "") if right else out


def iif(*arguments: Column) -> Column:
    """condition, value, condition, value, ..., and a last value for none (null without one)."""
    pairs, rest = arguments[: len(arguments) // 2 * 2], arguments[len(arguments) // 2 * 2 :]
    out = F.when(pairs[0], pairs[1])
    for i in range(2, len(pairs), 2):
        out = out.when(pairs[i], pairs[i + 1])
    return out.otherwise(rest[0]) if rest else out


def log(base: Column, x: Column) -> Column:
    """Null where either is no positive number, or the base is 1."""
    return F.when((base > 0) & (x > 0) & (base != 1), F.ln(x) / F.ln(base))


def likelihood(x: Column, probability: float = 0.5) -> Column:
    """A hint for a planner that Spark does not need: the value itself."""
    if not 0 <= probability <= 1:
        raise ValueError("the probability is between 0.0 and 1.0")
    return x


def modified(t: Column, *modifiers: str) -> Column:
    """A timestamp after modifiers: '+3 days', 'start of month', 'weekday 0', and the like. Months that overflow
    run into the next month (`ceiling`), or after a modifier of `floor` end on its last day. localtime and utc
    go to and from the session's time zone."""
    t = t.cast("timestamp")
    for i, m in enumerate(modifiers):
        w = m.strip().lower().split()
        if i and w[0] in ("ceiling", "floor"):
            continue  # taken with the months before it
        if w[0] == "localtime":
            t = F.from_utc_timestamp(t, F.current_timezone())
        elif w[0] == "utc":
            t = F.to_utc_timestamp(t, F.current_timezone())
        elif w[:2] == ["start", "of"]:
            t = F.date_trunc(w[2], t)
        elif w[0] == "weekday":
            t = t + F.make_interval(days=F.pmod(F.lit(int(w[1])) - (F.dayofweek(t) - 1), F.lit(7)))
        elif w[1].rstrip("s") in ("day", "hour", "minute", "second"):
            seconds = float(w[0]) * {"day": 86400, "hour": 3600, "minute": 60, "second": 1}[w[1].rstrip("s")]
            t = F.timestamp_micros(F.unix_micros(t) + F.lit(round(seconds * 1e6)))
        elif w[1].rstrip("s") in ("month", "year"):
            months = int(w[0]) * (12 if w[1].startswith("year") else 1)
            after = modifiers[i + 1].strip().lower() if i + 1 < len(modifiers) else ""
            t = _capped_month(t, months) if after == "floor" else _later(t, F.lit(months))
        else:
            raise ValueError(f"unknown modifier {m!r}")
    return t
