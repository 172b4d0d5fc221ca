"""Quality rules, mixing, duplicates and the language model on fixtures with odd rows, against SQL or brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from check_oracle import rows_of
from spanguard.llm import mixing, near_dups, quality, queries, suffixes
from spanguard.llm.language_model import LEFT_OUT, score, unwide, wide
from spanguard.llm.near_dups import NearOptions, banded_distance, keep_one, near_classes

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(n=160):
    rnd = random.Random(11)
    words = ["the", "of", "and", "to", "in", "a", "is"] + ["".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randrange(3, 10))) for _ in range(900)]

    def text(k):
        return " ".join(rnd.choice(words[:7]) if rnd.random() < 0.4 else rnd.choice(words) for _ in range(k))

    base = [text(rnd.randrange(40, 300)) for _ in range(n)]
    passage = text(70)
    rows = []
    for i, t in enumerate(base):
        if i % 9 == 0:
            t = t + "\n" + passage + "\n" + text(30)
        if i % 10 == 3:
            t = base[i - 1]
        if i % 10 == 5:
            w = base[i - 1].split()
            for _ in range(max(1, len(w) // 40)):
                w[rnd.randrange(len(w))] = "changed"
            t = " ".join(w)
        rows.append((i, t, "en" if i % 4 else "fr", f"s{i % 5}" if i % 3 else "s0", len(t)))
    rows += [(500, None, "en", "s1", None), (501, "", "en", None, 0), (502, " \n\t ", None, "s2", 4), (503, "one", None, None, 3),
             (504, "| " * 400 + text(60), "en", "s1", 0), (505, "$$$ %%% " * 100 + text(50), "en", "s1", 0), (506, "a b c " * 60, "fr", "s1", 0),
             (507, text(9000), "en", "s3", 0), (508, "=" * 5000, "en", "s3", 0), (509, "é" * 120 + " ü" * 80, "de", "S", 0), (1, rows[1][1], "fr", "s1", 0)]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


def sql_rows(name, rows=ROWS):
    db = duckdb.connect()
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    db.register("documents", pa.table({c.split()[0]: pa.array(v, k) for c, v, k in zip(SCHEMA.split(", "), columns, kinds)}))
    found = db.execute(queries.SQL[name])
    return rows_of([c[0] for c in found.description], found.fetchall())


def test_quality_agrees_with_sql(docs):
    got = quality.judge(docs.withColumn("kept", F.lit("clash")).withColumn("_key", F.lit(1)).drop("kept", "_key"), keep=["doc_id"])
    got = got.drop("class_distance", "word_distance")
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == sql_rows("op2_quality_divergence")


def test_quality_verdicts_and_columns(spark, docs):
    judged = quality.judge(docs.withColumns({"n_words": F.lit("clash"), "_words": F.lit(0), "_total": F.lit(0), "kept": F.lit("x")}))
    rows = {r["doc_id"]: r for r in judged.collect()}
    assert not rows[504]["kept"] and not rows[505]["kept"] and rows[506]["base_failed"] and rows[507]["kept"] and not rows[500]["kept"]
    assert len(judged.columns) == len(set(judged.columns))
    assert quality.judge(docs.limit(0)).collect() == []


def test_mix_agrees_with_sql(docs):
    got = mixing.mix(docs.withColumn("size", F.lit("clash")), keep=["doc_id", "size"])
    got = got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == sql_rows("op7_pareto_mix")


def test_mix_meets_targets(spark, docs):
    rows = mixing.mix(docs).collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        got = by.setdefault(r["source"], [0, r["target"], r["source_size"], 0])
        got[0] += r["copies"] * r["size"]
        got[3] = max(got[3], r["size"])
        assert 0 <= r["copies"] <= 2
    assert abs(sum(x[1] for x in by.values()) - 1.5 * total) < 1e-6 * total
    for taken, target, size, longest in by.values():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= longest / 2 + 1
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(docs.limit(0)).collect() == []
    one = mixing.mix(docs.where("doc_id = 500")).collect()
    assert [(r["size"], r["copies"]) for r in one] == [(0, 0)]


def brute_repeats(rows, length):
    docs = [(2**63 - 1 if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    least = {}
    for i, b in docs:
        for p in range(len(b) - length + 1):
            least[b[p:p + length]] = min(least.get(b[p:p + length], 2**64), i)
    out = []
    for i, b in docs:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out.append((None if i == 2**63 - 1 else i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 20_000, "per_bucket": 2_000, "fan_in": 2}])
def test_repeats_agree_with_brute_force(spark, docs, options):
    odd = [(None, ROWS[2][1], "x", "y", 1), (None, "no id at all, but a text of more than fifty bytes, twice " * 2, "x", "y", 1)]
    df = docs.unionByName(spark.createDataFrame(odd, SCHEMA)).withColumn("kept", F.lit("clash")).withColumn("block", F.lit(1))
    got = suffixes.remove_repeats(df, **options)
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got.collect()), key=str) == brute_repeats(ROWS + odd, 50)
    assert suffixes.remove_repeats(df.limit(0)).collect() == []


def test_repeats_keep_columns_and_whole_characters(spark):
    long = "ä" * 60
    df = spark.createDataFrame([(1, long + "x", None, "s", 3), (2, "q" + long + "ö", "l", None, 4)], SCHEMA)
    rows = suffixes.remove_repeats(df, keep=["doc_id", "lang", "source"], as_text=True).collect()
    assert {r["doc_id"]: (r["lang"], r["source"], r["kept"]) for r in rows} == {1: (None, "s", long + "x"), 2: ("l", None, "q")}


def test_few_messages_between_many_blocks_and_buckets(spark, monkeypatch):
    from pyspark.sql.group import GroupedData
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("abcdefghij ") for _ in range(4000)) for _ in range(160)]
    rows = [(i, t + texts[i - 1][:900] if i % 2 else t, "en", "s", 0) for i, t in enumerate(texts)]
    rows += [(1000 + i, "=" * 700 + rows[i][1][500:2500], "en", "s", 0) for i in range(0, 160, 5)]
    sent, apply = [], GroupedData.applyInPandas

    def counted(self, *args):
        sent.append(self._df.count())
        return apply(self, *args)

    monkeypatch.setattr(GroupedData, "applyInPandas", counted)
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    got = suffixes.remove_repeats(df, block_bytes=8_000, per_bucket=100)
    assert sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got.collect()) == sorted(brute_repeats(rows, 50))
    # Some 100 blocks and 600 times `per_bucket` keys: a row from each block to each such bucket were 18,890 rows.
    assert len(sent) == 2 and 0 < max(sent) < 8_000


def test_buckets_get_equal_shares():
    rnd = random.Random(8)
    data = np.array([rnd.randrange(97, 123) for _ in range(200_000)], np.uint8)
    keys = suffixes.key_runs(data, np.array([0, len(data)]), 50, 24)[0]
    shares = np.bincount((keys >> np.uint64(60)).astype(int), minlength=16)
    assert len(keys) > 10_000 and shares.max() < 1.3 * shares.mean()


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcdefgh"])
def test_two_stage_sorting(alphabet):
    rnd = random.Random(len(alphabet))
    for _ in range(60):
        depth = rnd.choice([2, 5, 9])
        parts = [bytes(rnd.choice(alphabet) for _ in range(rnd.randrange(80))) for _ in range(4)]
        text = np.zeros(sum(map(len, parts)) + len(parts) + depth, np.uint8)
        at, starts = 0, []
        for p in parts:
            text[at:at + len(p)] = np.frombuffer(p, np.uint8) + 1
            starts += [at + i for i in range(len(p))]
            at += len(p) + 1
        order = suffixes.sort_suffixes(text, np.array(starts, np.int32), depth) if starts else np.zeros(0, int)
        heads = [bytes(text[s:s + depth]).split(b"\0")[0] for s in order]
        assert sorted(order.tolist()) == starts and heads == sorted(heads)
        same = suffixes.same_as_before(text, order, depth)
        raw = [bytes(text[s:s + depth]) for s in order]
        assert same.tolist() == [bool(i) and raw[i] == raw[i - 1] for i in range(len(raw))]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    rnd = random.Random(4)
    for _ in range(3000):
        kinds = rnd.choice([2, 4, 30])
        a = [rnd.randrange(kinds) for _ in range(rnd.randrange(25))]
        b = a[:] if rnd.random() < 0.6 else [rnd.randrange(kinds) for _ in range(rnd.randrange(25))]
        for _ in range(rnd.randrange(7)):
            if b and rnd.random() < 0.5:
                del b[rnd.randrange(len(b))]
            else:
                b.insert(rnd.randrange(len(b) + 1), rnd.randrange(kinds))
        want, limit = edit_distance(a, b), rnd.randrange(12)
        assert banded_distance(a, b, limit) == (want if want <= limit else None)


def brute_classes(rows, share=0.8):
    """Classes by the shingle similarity that sketches must find, and by the edit similarity that may join at most."""
    texts = [(r[0], (r[1] or "").split()) for r in rows if r[0] is not None]
    grams = [set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} for _, w in texts]
    near, far = {i: {i} for i, _ in texts}, {i: {i} for i, _ in texts}

    def join(sets, a, b):
        if sets[a] is not sets[b]:
            sets[a] |= sets[b]
            for x in sets[b]:
                sets[x] = sets[a]

    for i in range(len(texts)):
        for j in range(i):
            both = len(grams[i] & grams[j])
            if both and both >= share * (len(grams[i]) + len(grams[j]) - both) or texts[i][1] == texts[j][1]:
                join(near, texts[i][0], texts[j][0])
            longest = max(len(texts[i][1]), len(texts[j][1]))
            if both * 20 > longest and banded_distance(texts[i][1], texts[j][1], int((1 - share) * longest + 1e-9)) is not None or texts[i][1] == texts[j][1]:
                join(far, texts[i][0], texts[j][0])
    return near, far


@pytest.mark.parametrize("rounds, crowd", [(0, 2), (1, 2), (2, 32)])
def test_near_classes(spark, docs, rounds, crowd):
    df = docs.withColumn("class_id", F.lit("clash"))
    rows = near_classes(df, options=NearOptions(single_rounds=rounds, crowd=crowd, leaders=2)).collect()
    assert len(rows) == len(ROWS)
    got = {r["doc_id"]: r["class_id"] for r in rows}
    near, far = brute_classes(ROWS)
    for i, members in near.items():
        assert {got[m] for m in members} == {got[i]}
    for i, c in got.items():
        assert c in far[i] and c <= i
    assert near_classes(docs.limit(0)).collect() == []


def test_a_large_group_and_a_shared_passage(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefghik") for _ in range(6)) for _ in range(4000)]
    copy = [rnd.choice(words) for _ in range(150)]
    passage = [rnd.choice(words) for _ in range(60)]
    rows = []
    for i in range(120):  # near copies of one text
        w = copy[:]
        w[rnd.randrange(len(w))] = f"new{i}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join([rnd.choice(words) for _ in range(40)] + passage + [rnd.choice(words) for _ in range(40)])) for i in range(120)]
    got = {r["doc_id"]: r["class_id"] for r in near_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {got[i] for i in range(120)} == {0} and all(got[i] == i for i in range(200, 320))


def test_no_link_of_a_crowded_bucket_is_left_out(spark):
    rnd = random.Random(11)
    passage = [f"p{j}" for j in range(100)]  # all it takes to share a sketch: every third word of the other part differs
    rows = []
    for i in range(60):
        body = [f"b{i}x{j}" for j in range(150)]
        other = [f"c{i}x{j}" if j % 3 == 0 else w for j, w in enumerate(body)]
        rows += [(2 * i, " ".join(body + passage)), (2 * i + 1, " ".join(other + passage))]
    rnd.shuffle(rows)
    options, sketches = NearOptions(), {}
    for i, text in rows:
        sketches[i] = near_dups.order_sketches(near_dups._words(text, near_dups._Hashes()), options.words, options.sketches, options.picks)
    together = {i for i in range(0, 120, 2) if (sketches[i] == sketches[i + 1]).any()}
    sizes = [max(np.unique([sketches[i][j] for i in sketches], return_counts=True)[1]) for j in range(options.sketches)]
    assert len(together) >= 40 and max(sizes) > options.crowd
    for tile in (40, 1024):
        found = near_classes(spark.createDataFrame(rows, "doc_id bigint, text string"), options=NearOptions(tile=tile)).collect()
        got = {r["doc_id"]: r["class_id"] for r in found}
        assert {i for i in range(0, 120, 2) if got[i + 1] == i} == together
        assert all(got[i] == i for i in range(0, 120, 2))


def test_words_that_fill_a_slot_are_not_ruled_out(spark):
    schema = "bucket bigint, node bigint, n int, _c bigint, _m bigint"
    texts = [["a"] * 3000 + ["b"] * 400, ["a"] * 2700 + ["b"] * 500, [f"c{j}" for j in range(3300)], ["a"] * 1300, [], []]
    words = [near_dups._words(" ".join(t), near_dups._Hashes()) for t in texts]
    rows = spark.createDataFrame([(1, i, len(t), i, 40) for i, t in enumerate(texts)], schema)
    bodies = spark.createDataFrame([(i, bytearray(near_dups.squeeze(w.tobytes()))) for i, w in enumerate(words)], "node bigint, words binary")
    for tile in (10, 1024):
        got = near_dups._crowded_pairs(rows, bodies, NearOptions(tile=tile)).collect()
        assert sorted(map(tuple, got)) == [(0, 1), (4, 5)]


def test_a_star_whose_hub_has_the_largest_id(spark):
    rnd = random.Random(5)
    parts = [[f"p{i}w{j}" for j in range(10)] for i in range(60)]
    rows = []
    for i in range(60):  # each lacks 8 other paragraphs and is near the whole article only
        lacking = set(rnd.sample(range(60), 8))
        rows.append((i, " ".join(w for k, p in enumerate(parts) if k not in lacking for w in p)))
    rows.append((900, " ".join(w for p in parts for w in p)))
    got = {r["doc_id"]: r["class_id"] for r in near_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    _, far = brute_classes(rows)
    assert all(len(members) == 61 for members in far.values()) and set(got.values()) == {0}


def test_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(3, long, "a", "s", 1), (2, long + " more", "b", "s", 2), (2, long + " more", "b", "s", 2), (9, "other", "c", "s", 3), (None, long, "d", "s", 4),
            (None, "lonely words", "e", "s", 5), (None, "lonely  words", "f", "s", 6), (11, None, "g", "s", 7), (12, "", "h", "s", 8)]
    kept = keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    got = kept.collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted([2, 9, 11, None], key=str)
    assert " ".join(next(r["text"] for r in got if r["doc_id"] is None).split()) == "lonely words"
    assert keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rows_of_one_id_and_without_id(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(1, "first text of this id"), (1, "second text, quite another"), (None, " ".join(words)), (None, " ".join(words[:-1])), (None, " ".join(words[1:]))]
    kept = sorted((str(r["doc_id"]), len(r["text"].split())) for r in keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert [k for k in kept if k[0] == "1"] == [("1", 4), ("1", 5)] and len(kept) == 3


def brute_scores(rows, rounds):
    def tokens(text):
        return [bytes(w) for w in (text or "").encode().lower().split()] + ["end"]

    kinds = []
    for r in rows:
        code = zlib.crc32(("null" if r[0] is None else str(r[0])).encode())
        kinds.append(2 if code % 7 == 2 else 1 if code // 7 % 10 == 0 else 0)
    counts = []
    for keep in ({0}, {0, 1}):
        one, two, starts = Counter(), Counter(), 0
        for r, kind in zip(rows, kinds):
            if kind in keep:
                t = tokens(r[1])
                one.update(t)
                starts += 1
                two.update(zip(["begin"] + t, t))
        counts.append((one, two, starts, sum(one.values()), len(one)))

    def parts(text, which):
        one, two, starts, n, v = counts[which]
        t = tokens(text)
        for a, b in zip(["begin"] + t, t):
            c = starts if a == "begin" else one[a]
            yield (min(39, int(math.log2(c)) + 1) if c else 0), two[(a, b)] / max(c, 1), one[b] / max(n, 1), 1 / (v + 1)

    weights = {b: (1 / 3, 1 / 3, 1 / 3) for b in range(40)}
    held = [p for r, kind in zip(rows, kinds) if kind == LEFT_OUT for p in parts(r[1], 0)]
    for _ in range(rounds):
        sums = {b: [0.0] * 3 for b in range(40)}
        for b, *p in held:
            cells = [w * x for w, x in zip(weights[b], p)]
            for i in range(3):
                sums[b][i] += cells[i] / sum(cells)
        all_ = [sum(s[i] for s in sums.values()) for i in range(3)]
        mean = [x / sum(all_) for x in all_] if sum(all_) else [1 / 3] * 3
        weights = {b: [(s[i] + mean[i] + 1e-3) / (sum(s) + 1.003) for i in range(3)] for b, s in sums.items()}
    one, _, _, n, v = counts[1]
    out = []
    for r, kind in zip(rows, kinds):
        t = tokens(r[1])
        out.append((r[0], kind == 2, len(t), sum(one[w] > 0 for w in t), n, sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t),
                    sum(math.log10(sum(w * x for w, x in zip(weights[b], p))) for b, *p in parts(r[1], 1))))
    return out


def test_scores_agree_with_brute_force(spark, docs):
    df = docs.unionByName(spark.createDataFrame([(None, "No Id HERE the of", "x", "y", 1)], SCHEMA)).withColumn("score", F.lit("clash"))
    rows = ROWS + [(None, "No Id HERE the of", "x", "y", 1)]
    for options in ({}, {"block_bytes": 9_000, "per_bucket": 500}):
        got = sorted(score(df, rounds=4, **options).collect(), key=str)
        want = sorted(brute_scores(rows, 4), key=str)
        assert sorted(str(tuple(r)[:5]) for r in got) == sorted(str(r[:5]) for r in want)
        key = lambda r: (r[0] is None, r[0] or 0, round(r[5], 6))
        for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
            assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_the_model_beats_the_base_on_held_out_documents(spark):
    from conftest import SF
    rows = score(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]
    empty = spark.createDataFrame([], SCHEMA)
    assert score(empty).collect() == []
    none = score(spark.createDataFrame([(12, "a b", "", "", 1)], SCHEMA).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2))
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in none.collect())


def test_digest_of_repeats(spark):
    from conftest import SF
    row = suffixes.op4_suffix_dedup(spark, SF).orderBy("doc_id").first()
    text = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").first()["text"]
    assert row["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_counts_of_any_size():
    for counts in ([], [0, 5], [2**32 + 5, 1]):
        assert unwide(wide(np.array(counts, np.int64))).tolist() == counts


def test_language_model_tells_a_null_id_from_the_largest(spark):
    rows = [(2**63 - 1, "a b c"), (None, "a b"), (1, "c c")]
    got = score(spark.createDataFrame(rows, "doc_id bigint, text string"), rounds=2).select("doc_id", "n_tokens").collect()
    assert sorted((str(r[0]), r[1]) for r in got) == [("1", 3), (str(2**63 - 1), 4), ("None", 3)]


def test_common_words_of_any_script_count(spark):
    """Words without the common ones of a language whose words all take more than five bytes are junk."""
    dice, letters = random.Random(5), "абвгдежзиклмнопрст"

    def word():
        return "".join(dice.choices(letters, k=dice.randint(3, 7)))

    common = [word() for _ in range(12)]
    rows = [(i, " ".join(x for _ in range(60) for x in (dice.choice(common), word())), "ru") for i in range(40)]
    rows.append((99, " ".join(word() for _ in range(120)), "ru"))
    got = quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).select("doc_id", "base_failed", "kept").collect()
    assert sorted(r.doc_id for r in got if not r.kept) == [99] and not any(r.base_failed for r in got)
