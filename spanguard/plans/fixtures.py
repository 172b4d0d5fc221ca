"""Documents, spans and scans derived from the given tables, by expressions of whole tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanguard.operators.findings import find, number_findings
from spanguard.operators.risk import scan_profile
from spanguard.session import cut, ship_package
from spanguard.sources.tables import load_documents, spread_small

FOLDERS = ("docs/", "src/", "tests/", "src/pkg/", "")
EXTENSIONS = (".md", ".py", ".json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(number: Column, values) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (number % len(values)).cast("int"))


def scan_of(number: Column) -> Column:
    """Four scans per source: sources take turns, so the round of turns tells the scan."""
    return F.floor(number / 20).cast("bigint") % 4


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of one of many repositories, in one of four scans."""
    raw = spread_small(table(spark, sf_dir, "documents"), "doc_id")
    number = F.col("doc_id")
    path = F.concat(pick(number, FOLDERS), F.lit("d"), number.cast("string"), pick(number, EXTENSIONS))
    return load_documents(raw, F.col("source"), scan_of(number), path, F.col("text"), F.col("n_chars"))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per scan with its file count; reads two columns and no text."""
    raw = table(spark, sf_dir, "documents")
    keys = raw.select(F.col("source").alias("repo"), scan_of(F.col("doc_id")).alias("scan_id"))
    return keys.groupBy("repo", "scan_id").agg(
        F.count(F.lit(1)).alias("files_scanned"), F.lit(0).cast("bigint").alias("files_skipped")
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_findings(findings(spark, sf_dir))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_profile(scans(spark, sf_dir), findings(spark, sf_dir))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences around a made-up name, one per customer, with the place of the name."""
    customer = spread_small(table(spark, sf_dir, "customer"), "c_custkey")
    case = F.col("c_custkey")
    paths = ("exports/customers.csv", "CHANGES.md", "src/app.py", "tests/data.csv", "exports/note.csv",
             "docs/guide.txt")
    before = ("patient full name: ", "Thanks to ", "owner = ", "written for ", "we met ", "billing address of ")
    after = (", on file", " for the release", " today", " today", " today", " today")
    value = F.replace("c_name", F.lit("Customer#"), F.lit("Kim "))
    parts = customer.select(
        F.col("c_custkey").cast("string").alias("repo"), F.lit(0).cast("bigint").alias("scan_id"),
        pick(case, paths).alias("relative_path"), pick(case, before).alias("_b"), value.alias("_v"),
        pick(case, after).alias("_a"),
    )
    return parts.select(
        "repo", "scan_id", "relative_path",
        F.regexp_extract("relative_path", r"(\.[a-z]+)$", 1).alias("extension"),
        F.concat("_b", "_v", "_a").alias("text"),
        F.length("_b").alias("start"), (F.length("_b") + F.length("_v")).alias("end"),
    )


def sentence_spans(sentences: DataFrame) -> DataFrame:
    """One span per entity that only a language model would report."""
    return sentences.select(
        "repo", "scan_id", "relative_path", "start", "end",
        F.explode(F.array(*[F.lit(e) for e in ("PERSON", "ORGANIZATION", "LOCATION", "NRP")])).alias("entity_type"),
        F.lit(0.85).alias("score"),
    )


def url_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's address in one of eight settings."""
    pages = spread_small(table(spark, sf_dir, "pages"), "page_id")
    n = F.col("page_id")
    prefix = ("customer portal ", "see ", "patient file ", "customer docs ", "employee link ", "open ", "account ",
              "client host ")
    path = ("exports/a.csv", "exports/a.csv", "docs/guide.txt", "exports/a.csv", "exports/b.csv", "src/app.json",
            "exports/c.csv", "exports/d.csv")
    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    swapped = (
        F.when(n % 8 == 3, F.replace("url", host, F.lit("docs.python.org")))
        .when(n % 8 == 4, F.replace("url", host, F.lit("hr.corp")))
        .when(n % 8 == 5, F.concat("url", F.lit("&token=abc")))
        .when(n % 8 == 6, F.replace("url", host, F.lit("localhost:8080")))
        .when(n % 8 == 7, F.replace("url", host, F.lit("user:pw@files.example.org")))
        .otherwise(F.col("url"))
    )
    return pages.select(
        n.cast("string").alias("repo"), F.lit(0).cast("bigint").alias("scan_id"),
        pick(n, path).alias("relative_path"), F.regexp_extract(pick(n, path), r"(\.[a-z]+)$", 1).alias("extension"),
        F.concat(pick(n, prefix), swapped, F.lit(" end")).alias("text"),
    )


def date_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's date in a sentence with or without a cue, some of them impossible dates."""
    orders = spread_small(table(spark, sf_dir, "orders"), "o_orderkey")
    n = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    prefix = ("date of birth: ", "built on ", "The patient came on ", "born ", "Birthdays: ", "passport until ")
    value = F.when(n % 7 == 0, F.concat(F.substring(day, 1, 8), F.lit("32"))).otherwise(day)
    return orders.select(
        n.cast("string").alias("repo"), F.lit(0).cast("bigint").alias("scan_id"),
        F.lit("exports/o.csv").alias("relative_path"), F.lit(".csv").alias("extension"),
        F.concat(pick(n, prefix), value, F.lit(".")).alias("text"),
    )


#: (line prefix, key multiplier, modulus, digits, value prefix, value suffix) of the number lines
NUMBER_LINES = (
    ("passport ", 7919, 100_000_000, 8, "K", ""),
    ("driver ", 104_729, 10_000_000, 7, "D", ""),
    ("bank account ", 15_485_863, 1_000_000_000, 9, "", ""),
    ("nhs ", 32_452_843, 10_000_000_000, 10, "", ""),
    ("dea ", 49_979_687, 10_000_000, 7, "AB", ""),
    ("uid ", 67_867_967, 100_000_000_000, 11, "3", ""),
    ("pan ", 31, 10_000, 4, "ABCPK", "Z"),
)


def identifier_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per customer with identifier-like values made from its key, one per line."""
    k = F.col("c_custkey")

    def digits(factor: int, modulus: int, width: int) -> Column:
        return F.lpad(((k * factor) % modulus).cast("string"), width, "0")

    lines = [F.concat(F.lit(p + a), digits(f, m, w), F.lit(b)) for p, f, m, w, a, b in NUMBER_LINES]
    lines += [
        F.concat(F.lit("ssn "), digits(7919, 1000, 3), F.lit("-"), digits(31, 100, 2), F.lit("-"), digits(17, 10000, 4)),
        F.concat(F.lit("on 2024-"), digits(1, 14, 2), F.lit("-"), digits(3, 33, 2)),
        F.concat(F.lit("jwt eyJhbGciOi"), digits(7, 1000, 3), F.lit(".eyJzdWIiOi"), digits(3, 1000, 3),
                 F.lit(".sig_"), digits(11, 1000, 3)),
        F.concat(F.lit("password = \"pw-"), digits(13, 100000, 5), F.lit("\"")),
        F.lit("-----BEGIN RSA PRIVATE KEY-----"),
    ]
    return spread_small(table(spark, sf_dir, "customer"), "c_custkey").select(
        k.cast("string").alias("repo"), F.lit(0).cast("bigint").alias("scan_id"),
        F.lit("exports/ids.csv").alias("relative_path"), F.lit(".csv").alias("extension"),
        F.concat_ws("\n", *lines).alias("text"),
    )


#: Copies of a text that make one long line of it.
LONG_COPIES = 6
#: Lines around four digits of a customer key, which stand at each `#`.
SECRET_LINES = (
    "API_KEY=abc#def9x", "export DB_PASSWORD=Xy-#-kk29;", 'password = "two words #"', "token: the next #", "secret: '#aaaa'",
    'client_secret := "s3cr3t-#"', "credential=config.api.key_#", "access-key => 'q8w7#e6r5'", "bearer: https://example.org/a#b2",
    "pwd='********'", "token = get_token#()",
)
KEY_LINES = (
    "-----BEGIN RSA PRIVATE KEY-----", "MIIEowIBAAKCAQEA#abcdefghijklmnop", "Zm9vYmFyYmF6#0123456789abcdef==", "-----END RSA PRIVATE KEY-----",
    r'x = "-----BEGIN PRIVATE KEY-----\nMIIEowIBAAKCAQEA#abcd\n-----END PRIVATE KEY-----"', "-----BEGIN PUBLIC KEY----- MIIB#",
    "-----BEGIN EC PRIVATE KEY-----", "MIIEowIBAAKCAQEA#abcdefghijklmnop", "the words # go on",
)
CARD_LINES = (
    "ref # 4111 1111 1111 1111 x", "year 2024 5500-0000-0000-0004, # end", "3782 822463 10005 # 6011000990139424", "# # # # # # # #",
    "# 4111 1111 1111 1112 5105 1051 0510 5100 #",
)
IBAN_LINES = ("to GB82WEST12345698765432 #", "DE89 3704 0044 0532 0130 00, #", "GB82WEST1234569876#", "FR14 2004 1010 0505 0001 3M02 606 x#")

#: Lines, and the addresses that must be found in each: the standard's examples, then times, hashes, names of programs and what is too long.
IPV6 = (
    ("at ABCD:EF01:2345:6789:ABCD:EF01:2345:# end", ("ABCD:EF01:2345:6789:ABCD:EF01:2345:#",)),
    ("2001:DB8:0:0:8:800:200C:417A, FF01::#.", ("2001:DB8:0:0:8:800:200C:417A", "FF01::#")),
    ("lo ::1 and ::FFFF:129.144.52.38", ("::1", "::FFFF:129.144.52.38")),
    ("0:0:0:0:0:0:13.1.68.3 fe80::#%eth0 [2001:db8::#]:443", ("0:0:0:0:0:0:13.1.68.3", "fe80::#%eth0", "2001:db8::#")),
    ("net 2001:db8:#::/48: closed", ("2001:db8:#::",)),
    ("time 12:30:45 mac 00:1a:2b:3c:4d:5e", ()),
    ("hash 3f:a1:00:1a:2b:3c:4d:5e:3f:a1:00:1a:2b:3c:4d:5e:3f:a1:00:1a", ()),
    ("std::# a::b::# 1:2:3:4:5:6:7:8:# ::FFFF:129.144.52.380 ::FFFF:129.144.52.256 12345::#", ()),
    (":: x 1:2:3:4:5:6:7::# dead::beef 1:2:3:4:5:6:7:1.2.3.4", ()),
)
IPV6_LINES = tuple(line for line, _ in IPV6)


def made_documents(spark: SparkSession, sf_dir: str, lines: tuple[str, ...]) -> DataFrame:
    """One text per customer from the given lines, with four digits of its key in them."""
    k = F.col("c_custkey")
    digits = F.lpad((k % 10_000).cast("string"), 4, "0")
    return spread_small(table(spark, sf_dir, "customer"), "c_custkey").select(
        k.cast("string").alias("repo"), F.lit(0).cast("bigint").alias("scan_id"),
        F.lit("exports/made.csv").alias("relative_path"), F.lit(".csv").alias("extension"),
        F.concat_ws("\n", *[F.replace(F.lit(line), F.lit("#"), digits) for line in lines]).alias("text"),
    )


def long_line_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document several times over as one line."""
    docs = spread_small(table(spark, sf_dir, "documents"), "doc_id")
    return docs.select(
        F.col("doc_id").cast("string").alias("repo"), F.lit(0).cast("bigint").alias("scan_id"),
        F.lit("exports/long.csv").alias("relative_path"), F.lit(".csv").alias("extension"),
        F.repeat(F.concat(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" ")), F.lit(LONG_COPIES)).alias("text"),
    )


def wallet_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wallet-like tokens made from customer keys around a known valid address."""
    k = F.col("c_custkey").cast("string")
    return spread_small(table(spark, sf_dir, "customer"), "c_custkey").select(
        k.alias("repo"), F.lit(0).cast("bigint").alias("scan_id"), F.lit("exports/w.csv").alias("relative_path"),
        F.lit(".csv").alias("extension"),
        F.concat(F.lit("a 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa b 1A1zP1eP5QGefi2DMPTfTL5SLmv7Div"),
                 F.translate(F.lpad(k, 4, "1"), "0", "z"), F.lit(" c")).alias("text"),
    )


def overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans made from order keys, many of them inside others."""
    n = F.col("o_orderkey")
    start = (n * 7 % 60).cast("int")
    return spread_small(table(spark, sf_dir, "orders"), "o_orderkey").select(
        F.col("o_custkey").cast("string").alias("repo"), F.lit(0).cast("bigint").alias("scan_id"),
        F.lit("a.csv").alias("relative_path"), F.col("o_orderstatus").alias("entity_type"),
        start.alias("start"), (start + 1 + (n * 13 % 40).cast("int")).alias("end"),
        ((n % 5).cast("double") / 8).alias("score"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files in and out of scope, with start and end times."""
    raw = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    folder = pick(n, ("docs/", "node_modules/a/", "src/", "build/", "", "src/venv/", "venv.d/"))
    suffix = pick(n, (".md", ".PY", ".csv", ".json", ".png"))
    path = F.concat(folder, F.lit("d"), n.cast("string"), suffix)
    loaded = load_documents(raw, F.col("source"), scan_of(n), path, F.col("text"), F.col("n_chars"))
    return loaded


def written_tree(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Roots (repo, scan_id, directory) of trees of the documents, written by tasks below a folder that all executors see."""
    docs = spread_small(table(spark, sf_dir, "documents"), "doc_id").where("text is not null").select(
        "source", F.concat_ws("/", F.lit(folder), "source").alias("directory"),
        F.concat(F.lit("p"), (F.col("doc_id") % 7).cast("string"), F.lit("/.q/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("name"), "text")

    def write(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                path = os.path.join(row.directory, row.name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as out:
                    out.write(row.text.encode())
            yield batch[["source", "directory"]].drop_duplicates()

    ship_package(spark)
    written = cut(docs.mapInPandas(write, "source string, directory string")).distinct()
    return written.select(F.col("source").alias("repo"), F.lit(0).cast("bigint").alias("scan_id"), "directory")
