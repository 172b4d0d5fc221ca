"""Check-sum and range tests on published examples."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from spanguard.functions import checks


@pytest.mark.parametrize("function, good, bad", [
    (checks.card_ok, ["4111111111111111", "4111 1111 1111 1111", "378282246310005"],
     ["4111111111111112", "411111111111", "41111111111111111111"]),
    (checks.octets_ok, ["1.2.3.255", "0.0.0.0"], ["1.2.3.256", "999.1.1.1"]),
    (checks.phone_ok, ["+1 (974) 555-3436", "974-555-3436"], ["9745553436", "555-3436"]),
    (checks.iban_ok, ["GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00"], ["GB82WEST12345698765433", "GB82WEST"]),
    (checks.ssn_ok, ["123-45-6789"], ["000-12-3456", "666-12-3456", "912-34-5678", "123-00-4567", "123-45-0000"]),
    (checks.itin_ok, ["912-70-1234", "999-94-0001"], ["912-45-1234", "812-70-1234", "912-93-1234"]),
    (checks.nhs_ok, ["9434765919", "943 476 5919"], ["9434765918"]),
    (checks.dea_ok, ["AB1234563"], ["AB1234564"]),
    (checks.verhoeff_ok, ["2363", "123451"], ["2364", "2633", "123456"]),
    (checks.calendar_ok, ["2024-02-29", "2024-01-01T23:59", "12/31/2020", "31/12/2020"],
     ["2023-02-29", "2024-01-01 24:00", "2024-01-01 10:60", "31/31/2020"]),
    (checks.crypto_ok, ["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy",
                        "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4",
                        "bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0"],
     ["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5"]),
])
def test_check(values, function, good, bad):
    assert values(function, good + bad) == [True] * len(good) + [False] * len(bad)


def test_ipv6(values):
    good = ["::1", "1::", "2001:db8::8:800:200c:417a", "0:0:0:0:0:0:0:1", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "fe80::1%eth0", "1:2:3:4:5:6:7::"]
    bad = ["::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8", "::ffff:1.2.3.256", "12345::1", "a::b", "12:30:45", "1.2.3.4::1",
           "1:2:3:4:5:6:7:1.2.3.4", ":1:2:3:4:5:6:7:8"]
    assert values(checks.ipv6_ok, good) == [True] * len(good)
    assert values(checks.ipv6_ok, bad) == [False] * len(bad)


def address(payload: bytes) -> str:
    number, out = int.from_bytes(payload + hashlib.sha256(hashlib.sha256(payload).digest()).digest()[:4], "big"), ""
    while number:
        number, digit = divmod(number, 58)
        out = checks.BASE58[digit] + out
    return "1" * (len(payload) - len(payload.lstrip(b"\0"))) + out


def test_base58_of_all_sizes(values):
    payloads = [bytes(21), b"\0" * 18 + b"abc", b"\0" * 20 + b"\1", b"\xff" * 21, b"\5" + b"\0" * 20] + [bytes([v]) + bytes(range(v, v + 20)) for v in range(0, 200, 9)]
    good = [address(p) for p in payloads]
    assert all(values(checks.base58_ok, good + ["1" * 9 + good[3]]))
    bad = [a[:-1] + ("z" if a[-1] != "z" else "y") for a in good] + [address(b"\1" * 22), "z" * 35, "z" * 36, "z" * 80, "", None]
    assert not any(values(checks.base58_ok, bad))


def test_base58_takes_no_longer_than_a_walk_over_the_characters(spark):
    df = spark.range(24_000).select(F.concat(F.lit("1A1zP1eP5QGefi2DMPTfTL5SLmv7D"), F.lpad(F.col("id").cast("string"), 5, "z")).alias("v")).cache()
    df.count()

    def least(check):
        taken = []
        for _ in range(3):
            begun = time.perf_counter()
            df.where(check(F.col("v"))).count()
            taken.append(time.perf_counter() - begun)
        return min(taken)

    assert least(checks.base58_ok) < 2 * least(checks.iban_ok) + 0.5
