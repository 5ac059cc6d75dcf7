"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
U32 = 1 << 32


def ascii_lower(c: Column) -> Column:
    """Lower-case A to Z only; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def contains(c: Column, needle: str) -> Column:
    """ASCII-case-insensitive substring test."""
    return F.instr(ascii_lower(c), needle.translate(str.maketrans(UPPER, LOWER))) > 0


def matches(c: Column, query: str, mode: str) -> Column:
    """``exact``: byte equality; ``contains``: substring, ignoring ASCII case."""
    if mode not in ("exact", "contains") or not query:
        raise ValueError("name_mode is exact or contains, and the query isn't empty")
    return c == query if mode == "exact" else contains(c, query)


#: Characters that JSON text escapes with a letter.
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))


def json_text(c: Column, kind: str) -> Column:
    """A JSON fragment of a string, number or boolean column; null becomes null.  Non-ASCII characters stay as they are."""
    text = c.cast("string")
    if kind == "string":
        for plain, escaped in _ESCAPES:
            text = F.replace(text, F.lit(plain), F.lit(escaped))
        rare = text
        for k in range(32):
            if chr(k) not in "\n\r\t\b\f":
                rare = F.replace(rare, F.lit(chr(k)), F.lit(f"\\u{k:04x}"))
        text = F.when(text.rlike("[\\x00-\\x1f]"), rare).otherwise(text)
        text = F.concat(F.lit('"'), text, F.lit('"'))
    return F.coalesce(text, F.lit("null"))


def stable_id(namespace: str, *fragments: Column) -> Column:
    """A content identity: SHA-256 of canonical JSON {components, namespace}; fragments are JSON texts."""
    payload = F.concat(F.lit('{"components":['), F.concat_ws(",", *fragments), F.lit('],"namespace":"' + namespace + '"}'))
    return F.concat(F.lit(f"{namespace}:sha256:"), F.sha2(payload, 256))


def parse_address(c: Column) -> Column:
    """Decimal or 0x hexadecimal text as a bigint; null where it isn't an address."""
    text = F.trim(c)
    hexa = F.when(text.rlike("^0[xX][0-9A-Fa-f]{1,15}$"), F.conv(F.substring(text, 3, 16), 16, 10).cast("bigint"))
    return F.coalesce(hexa, F.when(text.rlike("^[0-9]{1,18}$"), F.try_to_number(text, F.lit("9" * 18)).cast("bigint")))


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The sorted, distinct names of the conditions that hold, comma-joined."""
    held = F.array(*[F.when(c, F.lit(n)) for c, n in pairs])
    return F.array_join(F.array_sort(F.array_distinct(F.filter(held, lambda x: x.isNotNull()))), ",")


def joined(values: Column) -> Column:
    """An array as text, sorted and comma-joined."""
    return F.array_join(F.transform(F.array_sort(values), lambda x: x.cast("string")), ",")


def portable_label(name: Column, identity: Column, prefix: str) -> Column:
    """A name made of letters, digits and underscores, with 12 hex digits of the identity's hash."""
    plain = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_]", "_"), "_+", "_")
    plain = F.regexp_replace(plain, "^_+|_+$", "")
    plain = F.when(plain == "", F.lit("symbol")).otherwise(plain)
    plain = F.when(plain.rlike("^[0-9]"), F.concat(F.lit("n_"), plain)).otherwise(plain)
    plain = F.regexp_replace(F.substring(plain, 1, 160), "_+$", "")
    return F.concat(F.lit(prefix + "_"), plain, F.lit("__"), F.substring(F.sha2(identity, 256), 1, 12))


def utc_text(c: Column) -> Column:
    """A timestamp as RFC 3339 text of the instant in UTC, whatever the session's zone, with microseconds and Z; one without a zone is in the session's."""
    micros = F.unix_micros(c.cast("timestamp"))
    second = F.floor(micros / F.lit(1_000_000).cast("decimal(20,0)")).cast("long")
    plain = (F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=second.cast("decimal(18,6)"))).cast("string")
    return F.concat(F.replace(plain, F.lit(" "), F.lit("T")), F.lit("."), F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("Z"))


def signed(value: Column, bits: int) -> Column:
    """The two's-complement value of the low ``bits`` bits."""
    return F.when(value >= 1 << (bits - 1), value - (1 << bits)).otherwise(value)


def relative_path(p: Column) -> Column:
    """Whether a path is relative and plain: no empty, dot or dot-dot part, backslash or colon."""
    return (F.length(p) > 0) & ~p.startswith("/") & ~F.contains(p, F.lit("//")) & ~p.rlike(r"(^|/)\.\.?(/|$)") & ~F.contains(p, F.lit("\\")) & ~F.contains(p, F.lit(":"))
