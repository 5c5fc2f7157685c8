"""Text helpers: normalized keys, JSON text, phone splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width letters and digits and their plain forms.
WIDE_LETTERS = "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ"
PLAIN_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WIDE_DIGITS = "０１２３４５６７８９"
PLAIN_DIGITS = "0123456789"

CRLF = "\r\n"


def match_key(value: Column) -> Column:
    """Key for comparisons that ignore case and trailing blanks."""
    return F.upper(F.rtrim(value))


def narrow(value: Column) -> Column:
    """Upper case with full-width letters and digits made plain."""
    return _translated(F.upper(value), WIDE_LETTERS + WIDE_DIGITS, PLAIN_LETTERS + PLAIN_DIGITS)


def narrow_digits(value: Column) -> Column:
    return _translated(F.upper(value), WIDE_DIGITS, PLAIN_DIGITS)


def _translated(value: Column, wide: str, plain: str) -> Column:
    """`value` with wide characters made plain; text of single bytes has none and is not walked through."""
    return F.when(F.octet_length(value) == F.char_length(value), value).otherwise(F.translate(value, wide, plain))


def plate(value: Column) -> Column:
    """Normalized license plate: plain, upper case, no blanks."""
    return F.replace(narrow(value), F.lit(" "), F.lit(""))


def json_quoted(value: Column) -> Column:
    """A JSON string literal, with the slash escaped too."""
    wrapped = F.to_json(F.array(value))
    return F.replace(wrapped.substr(F.lit(2), F.length(wrapped) - 2), F.lit("/"), F.lit("\\/"))


def worker_phones(text: Column) -> Column:
    """Numbers in a worker's phone text.

    The first piece is up to eight characters from the first digit (text without
    a digit yields its first seven characters).  All its copies are removed; as
    long as eight digits in a row remain, the next piece is taken the same way.
    """

    def piece(t: Column) -> Column:
        found = F.regexp_extract(t, "(?s)[0-9].{0,7}", 0)
        return F.when(found != "", found).otherwise(F.substring(t, 1, 7))

    return _peel(text, piece)


def customer_phones(text: Column) -> Column:
    """Numbers in a customer's phone text (which must end in a non-digit mark).

    A piece is a run of digits and blanks that starts with eight digits.  All its
    copies are removed before the next search.  Text without eight digits in a
    row yields its leading run of digits and blanks, which may be empty.
    """

    def piece(t: Column) -> Column:
        found = F.regexp_extract(t, "[0-9]{8}[0-9 ]*", 0)
        return F.when(found != "", found).otherwise(F.regexp_extract(t, "^[0-9 ]*", 0))

    return _peel(text, piece)


def _without(text: Column, piece: Column) -> Column:
    return F.when(piece == "", text).otherwise(F.replace(text, piece, F.lit("")))


def _peel(text: Column, piece) -> Column:
    """Take one piece, then more while eight digits in a row are left.

    Every later step removes at least eight characters, which bounds the steps.
    """
    first = F.struct(piece(text).alias("p"))
    start = F.struct(
        _without(text, first["p"]).alias("rest"), F.array(first["p"]).alias("found")
    )

    def step(state: Column, _: Column) -> Column:
        rest = state["rest"]
        more = F.struct(
            _without(rest, piece(rest)).alias("rest"),
            F.concat(state["found"], F.array(piece(rest))).alias("found"),
        )
        return F.when(rest.rlike("[0-9]{8}"), more).otherwise(state)

    rounds = F.sequence(F.lit(0), F.call_function("div", F.length(text), F.lit(8)).cast("int"))
    return F.aggregate(rounds, start, step, lambda state: state["found"])
