"""Column expressions shared by the operators: regex macros, checksums and small string forms.

Java's ``\\b`` and ``\\s`` differ from the ones the patterns mean (ASCII words, Unicode blanks), so
patterns are written with the macros below and never with those two escapes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[A-Za-z0-9_]"
#: An edge between a word character and another, for ASCII words.
EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
#: Blanks as Unicode and the byte order mark have them.
BLANKS = "\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
BLANK = f"[{BLANKS}]"


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def is_one_of(column: Column, values) -> Column:
    """Null-safe membership in a fixed list."""
    return F.coalesce(column.isin(*values), F.lit(False))


def squash(column: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(column, f"{BLANK}+", " "), "^ | $", "")


def truncated(column: Column, limit: int) -> Column:
    return F.when(F.char_length(column) > limit, F.concat(F.left(column, F.lit(limit - 1)), F.lit("…"))).otherwise(column)


def digits_only(column: Column) -> Column:
    return F.regexp_replace(column, "[^0-9]", "")


def human_bytes(column: Column) -> Column:
    """Byte counts as ``n B``, ``n KB`` or ``n.n MB``."""
    kilo = column / 1024
    return F.when(column < 1024, F.format_string("%d B", column)).when(kilo < 1024, F.format_string("%d KB", F.round(kilo).cast("long"))).otherwise(F.format_string("%.1f MB", kilo / 1024))


def masked(column: Column) -> Column:
    """A credential as its first and last four characters; short ones as dots."""
    return F.when(F.char_length(column) <= 8, F.repeat(F.lit("•"), F.char_length(column))).otherwise(F.concat(F.left(column, F.lit(4)), F.lit("…"), F.right(column, F.lit(4))))


def with_scheme(column: Column) -> Column:
    bare = F.trim(column)
    return F.when(bare.rlike("(?i)^[a-z][a-z0-9+.-]*:"), bare).otherwise(F.concat(F.lit("https://"), bare))


def json_quoted(column: Column) -> Column:
    """The value as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(column.alias("v"))), r'^\{"v":(.*)\}$', 1)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


#: Digits that checksums take by plain arithmetic, which Spark compiles; longer strings are folded.
PLACES = 19


def halves(digits: Column) -> Column:
    """The last nine digits of a string of digits, and those before them, as numbers; 0 where there is none."""
    low = F.coalesce(F.right(digits, F.lit(9)).try_cast("long"), F.lit(0).cast("long"))
    high = F.coalesce(F.substr(digits, F.lit(1), F.greatest(F.char_length(digits) - 9, F.lit(0))).try_cast("long"), F.lit(0).cast("long"))
    return F.struct(low.alias("low"), high.alias("high"))


def digits_from_right(both: Column) -> list[Column]:
    """The first PLACES digits of a string of digits from its right end, from its ``halves``."""
    return [(F.floor(both[half] / F.lit(10**k)) % 10).cast("int") for half, most in (("low", 9), ("high", PLACES - 9)) for k in range(most)]


def check_of_digits(text: Column, check: Callable[[Column, Column], Column]) -> Column:
    """``check(digits, halves)`` of a text's digits. Within a lambda Spark works out each use of a column by itself: both are worked out once."""
    return bound(digits_only(text), lambda d: bound(halves(d), lambda both: check(d, both)))


def luhn_ok(digits: Column, both: Column | None = None) -> Column:
    """Whether a string of digits passes the mod-10 check; anything else does not. ``both`` are its ``halves``, if known."""
    n = F.char_length(digits)

    def worth(i: Column) -> Column:
        own = F.substr(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return own - F.when(own > 9, 9).otherwise(0)

    total = F.lit(0)
    for k, digit in enumerate(digits_from_right(halves(digits) if both is None else both)):
        total = total + (digit * 2 - F.when(digit > 4, 9).otherwise(0) if k % 2 else digit)
    folded = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + worth(i))
    short, long = digits.rlike(f"^[0-9]{{1,{PLACES}}}$"), digits.rlike(f"^[0-9]{{{PLACES + 1},}}$")
    return F.coalesce(F.when(short, total % 10 == 0).when(long, folded % 10 == 0), F.lit(False))


def dihedral_product(a: int, b: int) -> int:
    """In the symmetries of a pentagon: 0-4 turn, 5-9 turn a mirrored one."""
    turn = a % 5 + (b % 5 if a < 5 else -(b % 5))
    return turn % 5 + 5 * ((a >= 5) != (b >= 5))


#: The permutation that the Verhoeff scheme applies once more at each place.
VERHOEFF_STEP = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def verhoeff_tables() -> tuple[list[int], list[int]]:
    """Products of the group, and the permutation's first eight powers, flattened."""
    power, powers = list(range(10)), []
    for _ in range(8):
        powers += power
        power = [VERHOEFF_STEP[p] for p in power]
    return [dihedral_product(a, b) for a in range(10) for b in range(10)], powers


def verhoeff_ok(digits: Column, both: Column | None = None) -> Column:
    """Whether a string of digits passes the dihedral check; anything else does not. ``both`` are its ``halves``, if known."""
    products, powers = verhoeff_tables()
    product, power = lit_array(products), lit_array(powers)
    n = F.char_length(digits)

    def step(acc: Column, i: Column) -> Column:
        placed = F.get(power, i % 8 * 10 + F.substr(digits, n - i, F.lit(1)).cast("int"))
        return F.get(product, acc * 10 + placed)

    check = F.lit(0)
    for k, digit in enumerate(digits_from_right(halves(digits) if both is None else both)):  # 0 leaves the check as it is
        placed = F.when(n > k, F.get(lit_array(powers[k % 8 * 10 : k % 8 * 10 + 10]), digit)).otherwise(0)
        check = F.get(product, check * 10 + placed)
    folded = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step)
    short, long = digits.rlike(f"^[0-9]{{1,{PLACES}}}$"), digits.rlike(f"^[0-9]{{{PLACES + 1},}}$")
    return F.coalesce(F.when(short, check == 0).when(long, folded == 0), F.lit(False))
