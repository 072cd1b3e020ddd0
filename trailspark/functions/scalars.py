"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailspark.functions import patterns as P

#: Namespace of URLs, for name-based identifiers.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def text(c: Column | str) -> Column:
    """A column as text; null is empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


#: Unicode white space: what ``(?U)\\s`` matches.
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column, chars: str = "") -> Column:
    """Remove Unicode white space and, with ``chars``, then those characters from both ends."""
    out = F.btrim(c, F.lit(SPACE))
    return F.btrim(out, F.lit(chars)) if chars else out


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def first_text(*cols: Column) -> Column:
    """The first that is not empty, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def has_any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def searchable_text() -> Column:
    return F.concat_ws("\n", *[text(c) for c in ("category", "action", "text", "details", "tool_name", "model", "working_directory", "target")])


#: Parts of a time in ISO 8601 form, white space around it left out: the digits down to microseconds, and the offset.
_ISO = (r"\A(?U:\s)*(\d{4})-?(\d{2})-?(\d{2})(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?(?:Z|([+-]\d{2}(?::?\d{2})?))?)?(?U:\s)*\z", "#$1$2$3$4$5$6$7|$8")


def iso_timestamp(c: Column) -> Column:
    """Text in ISO 8601 form as a timestamp, naive times in UTC; null for anything else, digits alone included.

    One match brings the parts in a row, so each stands at its place once zeros fill what is missing. Text that does
    not match is the only one that the replacement leaves as it is."""
    def parsed(x: Column) -> Column:
        return let(F.when(x["parts"] != x["raw"], F.concat(F.rpad(F.substring_index(F.substring(x["parts"], 2, 40), "|", 1), 20, "0"), F.substring_index(x["parts"], "|", -1))), stamped)

    def stamped(d: Column) -> Column:
        at = lambda i, n, after: [F.substring(d, i, n), F.lit(after)]
        zone = F.when(F.char_length(d) == 20, "Z").otherwise(F.substring(d, 21, 6))
        return F.try_to_timestamp(F.concat(*at(1, 4, "-"), *at(5, 2, "-"), *at(7, 2, "T"), *at(9, 2, ":"), *at(11, 2, ":"), *at(13, 2, "."), F.substring(d, 15, 6), zone))

    return let(F.struct(F.regexp_replace(c, *_ISO).alias("parts"), c.alias("raw")), parsed)


def iso_format(ts: Column) -> Column:
    """UTC, microseconds only where there are some."""
    return F.concat(F.replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(".000000"), F.lit("")), F.lit("+00:00"))


def iso_utc(c: Column) -> Column:
    """ISO text normalised to UTC; other text unchanged; null empty."""
    return F.coalesce(iso_format(iso_timestamp(c)), strip(text(c)))


def iso_epoch(c: Column) -> Column:
    """A numeric epoch, in milliseconds above 1e10, as ISO text; out of range: the number."""
    v = c.cast("double")
    s = F.when(v > 1e10, v / 1000).otherwise(v)
    ok = (s >= -62135596800) & (s < 253402300800)
    return F.when(c.isNull(), "").when(ok, iso_format(F.timestamp_micros(F.rint(s * 1e6).cast("long")))).otherwise(c.cast("string"))


def unix_time(seconds: Column, nanos: Column) -> Column:
    """Epoch seconds plus nanoseconds at ticks of 100 ns, round-trip format; text that is no number unchanged."""
    s, n = F.try_to_number(seconds.cast("string"), F.lit("S99999999999999.999999999")).cast("decimal(30,9)"), F.coalesce(nanos.cast("double"), F.lit(0.0))
    s = F.coalesce(seconds.try_cast("decimal(30,9)"), s)
    ticks = F.floor(s * 1000).cast("decimal(30,0)") * 10000 + F.floor(n / 100).cast("long")
    whole = F.floor(ticks / 10000000).cast("long")
    out = F.concat(F.date_format(F.timestamp_seconds(whole), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad((ticks - whole * 10000000).cast("long").cast("string"), 7, "0"), F.lit("Z"))
    return F.when(F.trim(text(seconds)) == "", "").when(s.isNull(), seconds.cast("string")).otherwise(out)


def hash_text(c: Column) -> Column:
    return F.sha2(F.encode(text(c), "UTF-8"), 256)


def uuid5(name: Column) -> Column:
    """Name-based identifier (SHA-1) in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def mask_secret(v: Column) -> Column:
    n = F.char_length(v)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(v, F.lit(4)), F.repeat(F.lit("*"), n - 8), F.right(v, F.lit(4))))


def truncate(c: Column, limit: int = 32767) -> Column:
    s = text(c)
    return F.when(F.char_length(s) > limit, F.concat(F.left(s, F.lit(limit)), F.lit("...[TRUNCATED]"))).otherwise(s)


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def display_basename(c: Column) -> Column:
    """The last component under either separator."""
    return F.element_at(F.split(F.regexp_replace(c, r"\\", "/"), "/"), -1)


def replay_date(c: Column) -> Column:
    """UTC day of an ISO text; of other text its first ten characters, else unknown."""
    return F.coalesce(F.date_format(iso_timestamp(c), "yyyy-MM-dd"), first_text(F.left(text(c), F.lit(10)), F.lit("unknown")))


def timeline_time(c: Column) -> Column:
    return F.when(text(c) == "", "Time unavailable").otherwise(F.coalesce(F.date_format(iso_timestamp(c), "yyyy-MM-dd HH:mm:ss 'UTC'"), text(c)))


def replay_time(c: Column) -> Column:
    return F.when(text(c) == "", "Time unavailable").otherwise(F.coalesce(F.date_format(iso_timestamp(c), "HH:mm:ss 'UTC'"), text(c)))


def mtime_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def clean_model_id(c: Column) -> Column:
    s = strip(text(c), "'\"")
    return F.when((F.char_length(s) <= 120) & s.rlike(P.MODEL_ID), s).otherwise("")


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
