"""Check-sum and range tests for candidate values, as native column expressions.

Every function maps a value column to a boolean column, so it works on rows and inside array
lambdas alike.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from spanguard.functions import positions
from spanguard.functions.lambdas import bind

BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
# Characters read as one number, and how many such numbers hold 25 bytes
BASE58_PART, BASE58_PARTS = 5, 7
# Bech32 generator and the two accepted final constants (BIP 173, BIP 350)
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
BECH32_FINALS = (1, 0x2BC830A3)
# The base permutation of the Verhoeff scheme
VERHOEFF_PERMUTATION = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def characters(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))


def digits(value: Column) -> Column:
    """The decimal digits of a value, as ARRAY<INT>."""
    return F.transform(F.regexp_extract_all(value, F.lit("[0-9]"), F.lit(0)), lambda c: c.cast("int"))


def digit_count(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def weighted(values: Column, weights) -> Column:
    return total(F.zip_with(values, F.array(*[F.lit(w) for w in weights]), lambda x, w: x * w))


def luhn_ok(value: Column) -> Column:
    def doubled(x: Column, i: Column) -> Column:
        twice = x * 2
        return F.when(i % 2 == 0, x).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return total(F.transform(F.reverse(digits(value)), doubled)) % 10 == 0


def card_ok(value: Column) -> Column:
    return digit_count(value).between(13, 19) & luhn_ok(value)


#: Digits of the groups of a card number, where it is written in groups (fixed values): a pattern of lengths.
CARD_SHAPES = ("^4,4,4,[1-7]$", "^4,6,5$", "^1[3-9]$")


def cards_in(run: Column) -> Column:
    """The card numbers in a run of digit groups, as ARRAY<STRUCT<at, value>>.

    Other groups may stand before and behind a number. From the left, each group that begins a valid number takes the groups of it; the next
    number begins after them. How many groups begin a number at each place is one character each, so one pattern over these
    characters makes the choice in one pass.
    """
    def windows(groups: Column) -> Column:
        def taken(group: Column, i: Column) -> Column:
            out = None
            for n, shape in zip((4, 3, 1), CARD_SHAPES):
                some = F.slice(groups, i + 1, n)
                lengths = F.concat_ws(",", F.transform(some, lambda g: F.length(g).cast("string")))
                test = lengths.rlike(shape) & luhn_ok(F.array_join(some, ""))
                out = F.when(test, F.lit(str(n))) if out is None else out.when(test, F.lit(str(n)))
            return out.otherwise(F.lit("0"))

        # Most groups can begin no number: their length alone says so.
        return F.array_join(F.transform(groups, lambda g, i: F.when(
            (F.length(g) == 4) | F.length(g).between(13, 19), taken(g, i)).otherwise(F.lit("0"))), "")

    def chosen(groups: Column, marks: Column) -> Column:
        steps = F.regexp_extract_all(marks, F.lit("(?s)4...|3..|1|0"), F.lit(0))
        firsts = bind(positions.sums_before(F.transform(steps, lambda x: F.length(x))), lambda at: F.zip_with(
            F.slice(at, 1, F.size(steps)), steps, lambda i, x: F.struct(i.alias("i"), F.substring(x, 1, 1).cast("int").alias("n"))))
        starts = positions.sums_before(F.transform(groups, lambda g: F.length(g) + 1))
        return bind(starts, lambda at: bind(positions.text_index(run), lambda index: F.transform(
            F.filter(firsts, lambda f: f["n"] > 0),
            lambda f: bind(F.get(at, f["i"]), lambda a: F.struct(
                a.alias("at"), positions.between(index, a, F.get(at, f["i"] + f["n"]) - 1).alias("value"))))))

    return bind(F.split(run, "[ \\-]"), lambda g: bind(windows(g), lambda marks: F.when(
        marks.rlike("[134]"), chosen(g, marks)).otherwise(F.array().cast("array<struct<at:int,value:string>>"))))


def information(value: Column) -> Column:
    """How many bits it takes to write a value, given how often each of its characters occurs in it."""
    n = F.length(value)
    used = F.transform(F.array_distinct(characters(value)), lambda c: n - F.length(F.replace(value, c, F.lit(""))))
    spent = F.aggregate(used, F.lit(0.0), lambda acc, k: acc + k * F.log2(k.cast("double")))
    return F.when(n > 0, n * F.log2(n.cast("double")) - spent).otherwise(0.0)


#: Least information of a secret in quotes and of a bare one, in bits: above that of words like `the` or `none`, and of repeated marks.
QUOTED_BITS, BARE_BITS = 10.0, 24.0
#: Names and calls of programs, references to variables and addresses are no secrets.
REFERENCE = r"^[$%]|://|^[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+$"


def secret_ok(value: Column, before: Column, after: Column) -> Column:
    """A quoted value of some information, or a bare one of more, with letters and digits, that refers to nothing else."""
    quoted = before.isin('"', "'") & (after == before)
    bare = (value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(REFERENCE) & ~after.isin("(", "[", "{", "<", "`", '"', "'")
            & (information(value) >= BARE_BITS))
    return F.when(quoted, information(value) >= QUOTED_BITS).otherwise(bare)


def octets_ok(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda x: x.cast("int") <= 255)


def ipv6_ok(value: Column) -> Column:
    """Eight groups, or fewer around one run left out; a dotted address at the end stands for two, and a zone may follow.

    A value without any digit is taken for a name of a program.
    """
    dotted = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"

    def whole(body: Column) -> Column:
        group = "[0-9A-Fa-f]{1,4}"
        plain = F.regexp_replace(body, dotted, "0:0")
        left_out = plain.rlike(f"^(?:{group}(?::{group}){{0,6}})?::(?:{group}(?::{group}){{0,6}})?$") & (
            F.regexp_count(plain, F.lit("[0-9A-Fa-f]+")) <= 7)
        octets = F.regexp_extract(body, f"({dotted})", 1)
        return (plain.rlike(f"^{group}(?::{group}){{7}}$") | left_out) & body.rlike("[0-9]") & ((octets == "") | octets_ok(octets))

    return bind(F.substring_index(value, "%", 1), whole)


def phone_ok(value: Column) -> Column:
    return digit_count(value).between(10, 15) & value.rlike(r"^\+|[ .()\-]")


def iban_ok(value: Column) -> Column:
    compact = F.replace(value, F.lit(" "), F.lit(""))
    rotated = F.concat(F.substring(compact, 5, 34), F.substring(compact, 1, 4))
    numbers = F.transform(characters(rotated), lambda c: F.conv(c, 36, 10).cast("int"))
    remainder = F.aggregate(
        numbers, F.lit(0), lambda acc, x: (acc * F.when(x > 9, 100).otherwise(10) + x) % 97
    )
    return F.length(compact).between(15, 34) & (remainder == 1)


def ssn_ok(value: Column) -> Column:
    return ~value.rlike("^(?:000|666|9)") & ~value.rlike("^...-00") & ~value.rlike("-0000$")


def itin_ok(value: Column) -> Column:
    group = F.substring(value, 5, 2).cast("int")
    return value.startswith("9") & (
        group.between(50, 65) | group.between(70, 88) | group.between(90, 92) | group.between(94, 99)
    )


def nhs_ok(value: Column) -> Column:
    check = 11 - weighted(F.slice(digits(value), 1, 9), range(10, 1, -1)) % 11
    last = F.element_at(digits(value), 10)
    return F.when(check == 11, last == 0).otherwise(last == check)


def dea_ok(value: Column) -> Column:
    """Two lead characters and seven digits, the last a weighted check digit."""
    number = digits(F.substring(value, 3, 7))
    return weighted(F.slice(number, 1, 6), (1, 2, 1, 2, 1, 2)) % 10 == F.element_at(number, 7)


def verhoeff_tables() -> tuple[list[int], list[int]]:
    """Flat product table of the dihedral group D5 and flat permutation table."""
    def product(j: int, k: int) -> int:
        if j < 5:
            return (j + k) % 5 if k < 5 else 5 + (j + k) % 5
        return 5 + (j - k) % 5 if k < 5 else (j - k) % 5

    rows = [list(range(10))]
    for _ in range(7):
        rows.append([rows[-1][x] for x in VERHOEFF_PERMUTATION])
    return [product(j, k) for j in range(10) for k in range(10)], [x for row in rows for x in row]


def verhoeff_ok(value: Column) -> Column:
    group, permutation = verhoeff_tables()
    group_lit = F.array(*[F.lit(x) for x in group])
    perm_lit = F.array(*[F.lit(x) for x in permutation])
    permuted = F.transform(F.reverse(digits(value)), lambda x, i: F.get(perm_lit, (i % 8) * 10 + x))
    return F.aggregate(permuted, F.lit(0), lambda c, x: F.get(group_lit, c * 10 + x)) == 0


def calendar_ok(value: Column) -> Column:
    """ISO dates, or day and month around slashes in either order, that exist in the calendar."""
    parts = F.split(value, "/")

    def slashed(year: int, month: int, day: int) -> Column:
        return F.concat_ws("-", F.get(parts, F.lit(year)), F.lpad(F.get(parts, F.lit(month)), 2, "0"),
                           F.lpad(F.get(parts, F.lit(day)), 2, "0"))

    iso = F.substring(value, 1, 10).try_cast("date").isNotNull()
    hour = F.regexp_extract(value, "[T ]([0-9]{2}):", 1).try_cast("int")
    minute = F.regexp_extract(value, ":([0-9]{2})", 1).try_cast("int")
    clock = F.coalesce(hour, F.lit(0)).between(0, 23) & F.coalesce(minute, F.lit(0)).between(0, 59)
    either = slashed(2, 0, 1).try_cast("date").isNotNull() | slashed(2, 1, 0).try_cast("date").isNotNull()
    return F.when(value.contains("/"), either).otherwise(iso & clock)


def base58_ok(value: Column) -> Column:
    """Base58Check over 25 bytes: seven numbers of five characters each, times their powers of 58, in eight 28-bit limbs, carried once.

    A number is below 2^30, so the sum of seven products stays below 2^61.
    """
    powers = [58 ** (BASE58_PART * i) for i in range(BASE58_PARTS - 1, -1, -1)]

    def parts(digits: Column) -> Column:
        def part(first: int) -> Column:
            out = None
            for at in range(first, first + BASE58_PART):
                digit = F.instr(F.lit(BASE58), F.substring(digits, at + 1, 1)) - 1
                out = digit if out is None else out * 58 + digit
            return out.cast("bigint")

        return F.array(*[part(i * BASE58_PART) for i in range(BASE58_PARTS)])

    def limbs(numbers: Column) -> Column:
        """The sums of each limb, lowest first."""
        def limb(i: int) -> Column:
            out = F.lit(0).cast("bigint")
            for k, power in enumerate(powers):
                if share := power >> 28 * i & 0xFFFFFFF:
                    out = out + F.get(numbers, F.lit(k)) * F.lit(share).cast("bigint")
            return out

        return F.array(*[limb(i) for i in range(8)])

    def carried(acc: Column, x: Column) -> Column:
        low = F.lpad(F.hex((acc["carry"] + x).bitwiseAND(0xFFFFFFF)), 7, "0")
        return F.struct(F.shiftright(acc["carry"] + x, 28).alias("carry"), F.concat(low, acc["hexed"]).alias("hexed"))

    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.lit("").alias("hexed"))
    # 1 is the digit zero; a number of more digits has more than 25 bytes
    short = F.ltrim(value, F.lit("1"))
    digits = F.when(F.length(short) <= BASE58_PART * BASE58_PARTS, F.lpad(short, BASE58_PART * BASE58_PARTS, "1"))
    hexed = bind(bind(digits, parts), lambda numbers: F.aggregate(limbs(numbers), start, carried)["hexed"])
    return bind(hexed, _base58_sum_ok)


def _base58_sum_ok(hexed: Column) -> Column:
    """Whether 28 bytes in hexadecimal digits are three of zero, a payload and its check-sum."""
    payload = F.substring(hexed, 7, 42)
    digest = F.sha2(F.unhex(F.sha2(F.unhex(payload), 256)), 256)
    return F.substring(hexed, 1, 6).eqNullSafe("000000") & (
        F.lower(F.substring(hexed, 49, 8)) == F.substring(digest, 1, 8)
    )


def bech32_ok(value: Column) -> Column:
    data = F.transform(
        characters(F.substring(value, 4, 90)), lambda c: (F.instr(F.lit(BECH32), c) - 1).cast("bigint")
    )
    # the human-readable part `bc` expands to its high bits, a zero and its low bits
    head = [ord(c) >> 5 for c in "bc"] + [0] + [ord(c) & 31 for c in "bc"]
    values = F.concat(F.array(*[F.lit(x).cast("bigint") for x in head]), data)

    def step(chk: Column, x: Column) -> Column:
        out = F.shiftleft(chk.bitwiseAND(0x1FFFFFF), 5).bitwiseXOR(x)
        for i, gen in enumerate(BECH32_GENERATOR):
            top = F.shiftright(chk, 25 + i).bitwiseAND(1)
            out = out.bitwiseXOR(top * F.lit(gen).cast("bigint"))
        return out

    return F.aggregate(values, F.lit(1).cast("bigint"), step).isin(*BECH32_FINALS)


def crypto_ok(value: Column) -> Column:
    return F.when(value.startswith("bc1"), bech32_ok(value)).otherwise(base58_ok(value))
