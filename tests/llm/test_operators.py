"""The corpus operators against plain versions, on small and awkward tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tagloom.llm import ann, bpe, common, exact_dedup, langid, mixing, pii, sharding, simhash, substring_dedup, toxicity
from tagloom.llm.components import components

ODD = [(1, None), (2, ""), (3, "  \n"), (4, "a b"), (4, "a b"), (None, "a  b"), (5, "é" * 70_000), (6, "é" * 70_000 + "x"), (7, "a b c d e f")]


# ---- op1 ----


def test_nearest_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((700, 24)).astype(np.float32)
    v[100:160] = v[40]  # ties
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (920, [0.0] * 24), (940, [math.nan] * 24), (960, [1.0, None] + [0.0] * 22), (980, [1.0]), (None, [1.0] * 24)]
    df = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = collections.defaultdict(list)
    for r in ann.search(df.where("vec_id % 20 = 0"), df, 20, row_block=200, query_block=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    exact = v.astype(np.float64)
    assert sorted(got) == list(range(0, 700, 20))
    hits = 0
    for q, found in got.items():
        score = (exact * exact[q]).sum(axis=1)
        best = sorted((i for i in range(700) if i != q), key=lambda i: (-score[i], i))[:20]
        hits += len(set(best) & {i for _, i, _ in found})
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(abs(score[i] - s) < 1e-9 for _, i, s in found)
    assert hits >= 0.95 * 20 * len(got)


def test_nearest_of_few_and_none(spark):
    df = ann.usable(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>"))
    got = ann.search(df.where("vec_id = 0"), df, 20).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in got] == [(1, 1, 1.0), (2, 2, 0.5)]
    assert ann.search(df.limit(0), df.limit(0), 20).count() == 0


# ---- op2 ----


@pytest.mark.parametrize("n", [0, 7, 1000])
def test_shards(spark, n):
    df = spark.range(n).selectExpr("id as doc_id", "'x' as shard", "id % 3 as `a b`")
    rows = sharding.shuffle_into_shards(df, 8).collect()
    assert sorted(r.doc_id for r in rows) == list(range(n))
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values()), default=0) - min((len(slots[s]) for s in range(8)), default=0) <= 1
    again = sharding.shuffle_into_shards(df, 8).collect()
    assert sorted((r.doc_id, r["shard"], r.slot) for r in rows) == sorted((r.doc_id, r["shard"], r.slot) for r in again)


def test_shuffle_is_uniform(spark):
    seen = collections.Counter()
    for seed in range(5):
        for r in sharding.shuffle_into_shards(spark.range(640).selectExpr("id as doc_id"), 4, seed).collect():
            seen[r.doc_id % 4, r["shard"]] += 1
    expected = 5 * 640 / 16
    assert sum((seen[k] - expected) ** 2 / expected for k in seen) < 40  # chi-squared, 15 cells


def test_matrix_sums():
    m = sharding.communication_matrix([5, 0, 9], [4, 6, 4], 1)
    assert m.sum(axis=1).tolist() == [5, 0, 9]
    assert m.sum(axis=0).tolist() == [4, 6, 4]
    rng = np.random.Generator(np.random.PCG64(1))
    big = [sharding._hypergeometric(rng, 10**9, 10**9, 10**6) for _ in range(20)]
    assert abs(np.mean(big) - 5e5) < 2000


def test_shards_of_repeated_rows(docs):
    df = docs(*ODD, (4, "a b"))
    rows = sharding.shuffle_into_shards(df.select("doc_id", "text")).collect()
    assert len(rows) == len(ODD) + 1
    assert {(r["shard"], r.slot) for r in rows} == {(s, i) for s in range(8) for i in range(1 + (s < 2))}


# ---- op3 ----


def test_pii(docs):
    text = 'Mail Ann.Lee9@Mail.example.com or ann.lee9@mail.example.com, call +1 (578) 555-6437 / 1 578 555 6437, ip 10.1.2.3, card 4111 1111 1111 1111, password=0123abcd4567ef, Maria Schmidt met Ms Schmidt and Павел Зимин.'
    df = docs((1, text), (2, "nothing here, 12 34"), (3, None), (4, ""), (5, "x ann.lee9@mail.example.com y 87.65.43.21"), (5, "x ann.lee9@mail.example.com y 87.65.43.21"))
    rows = pii.pseudonymise(df, b"secret").collect()
    got = {r.doc_id: r.text for r in rows}
    assert (got[2], got[3], got[4], len(rows)) == ("nothing here, 12 34", None, "", 6)
    for secret in ("Lee9", "ann.lee9", "555-6437", "10.1.2.3", "4111", "0123abcd", "Maria", "Schmidt", "Павел", "87.65"):
        assert all(secret.lower() not in (t or "").lower() for t in got.values())
    mails = re.findall(r"\S+@\S+?\.com", got[1])
    assert mails[0].lower() == mails[1] == re.findall(r"\S+@\S+", got[5])[0]
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4} / 1 \d{3} \d{3} \d{4}", got[1])
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}", got[1])
    assert pii.luhn(cards[0].replace(" ", ""))
    first, family = re.search(r"(\w+) (\w+) met", got[1]).groups()
    assert pii._PLACE[first] == ("f", "latin")
    assert f"Ms {family}" in got[1]
    assert re.search("password=[0-9a-f]{14},", got[1])


def test_pii_numbers_and_bare_names(docs):
    numbers = ["+15551234567", "5551234567", "+442079460958", "030 1234567", "+49 30 12345678"]
    for x in numbers:
        assert [(m[2], m[0], m[1]) for m in pii.mentions(f"call {x}.")] == [("phone", 5, 5 + len(x))], x
    assert pii.mentions("on 2024-01-15 pi was 3.14159265358 and 12.3456789, part 123456") == []
    text = "Alice Novak wrote. Later Alice met Dr Smith; Smith and Novak left Alicetown."
    got = next(r.text for r in pii.pseudonymise(docs((1, text)), b"secret").collect())
    a, n, a2, s, s2, n2 = re.fullmatch(r"(\w+) (\w+) wrote. Later (\w+) met Dr (\w+); (\w+) and (\w+) left Alicetown.", got).groups()
    assert (a, n, s) == (a2, n2, s2) and not {a, n, s} & {"Alice", "Novak", "Smith"}


def test_pii_collisions(spark):
    rows = [("email", f"{c}@e.org") for c in "abcdefghijklmnopqrstuvwxyz"]
    out = pii.assign(spark.createDataFrame(rows, "kind string, canonical string"), b"secret").collect()
    forms = [r.form for r in out]
    assert len(out) == 26
    assert len(set(forms)) == 26
    assert not {c for _, c in rows} & set(forms)


def test_pii_used_up_namespace(spark):
    rows = [("secret", f"{c}-------") for c in range(10)]
    out = pii.assign(spark.createDataFrame(rows, "kind string, canonical string"), b"secret").collect()
    forms = {r.form for r in out}
    assert len(forms) == 10
    assert not {c for _, c in rows} & forms
    assert pii.mentions("password: -------- token: ________") == []
    assert pii.styled("+1 555-1234567", "phone", "55512345678") == "+5 551-2345678"


# ---- op4 ----


def test_chunks_resist_shifts():
    rnd = random.Random(5)
    data = bytes(rnd.choice(b"abcdefgh ") for _ in range(20_000))
    cut = substring_dedup.cuts(data)
    assert cut[-1] == len(data)
    assert all(b - a <= substring_dedup.MAX_CHUNK for a, b in zip([0, *cut], cut))
    pieces = lambda d: {d[a:b] for a, b in zip([0, *substring_dedup.cuts(d)], substring_dedup.cuts(d))}
    shifted = data[:1000] + b"inserted" + data[1000:]
    assert len(pieces(data) - pieces(shifted)) <= 6


def test_gear_is_a_rolling_hash():
    data = bytes(random.Random(1).randrange(256) for _ in range(200))
    h, want = 0, []
    for b in data:
        h = (2 * h + int(substring_dedup.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert substring_dedup.gear(data).tolist() == want


def test_repeated_passages(docs):
    rnd = random.Random(9)
    words = lambda n: " ".join("".join(rnd.choice("abcdeéghijklm") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    passages = [words(55) for _ in range(12)]
    rows = [(100 + i, f"{words(40)} {p} {words(30)}") for i, p in enumerate(passages)] + [(200 + i, f"{words(33)} {p} {words(44)}") for i, p in enumerate(passages)]
    clean = [(300 + i, words(200)) for i in range(10)]
    out = {r.doc_id: r for r in substring_dedup.substring_dedup(docs(*rows, *clean, (1, None), (2, ""), (None, rows[0][1]))).collect()}
    assert all(out[i].removed_bytes == 0 for i, _ in clean)
    assert all(out[100 + i].removed_bytes == 0 for i in range(12))
    assert all(out[200 + i].removed_bytes > 100 and out[200 + i].repeats_of == [100 + i] for i in range(12))
    assert (out[1].text, out[2].text, out[None].text) == (None, "", "")
    for i, text in rows[12:]:
        r = out[i]
        left = text.encode()
        for s in reversed(r.spans):
            left = left[: s["start"]] + left[s["end"] :]
        assert left.decode() == r.text


def test_passages_of_51_words_are_found():
    rnd = random.Random(51)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghijklm") for _ in range(rnd.choice([2, 3, 3, 4, 4, 5, 5, 6, 7, 8, 9, 9, 10]))) for _ in range(n))
    pieces = lambda d: [(a, d[a:b]) for a, b in zip([0, *substring_dedup.cuts(d)], substring_dedup.cuts(d))]
    for _ in range(400):
        passage = words(51)
        first, second = (f"{words(rnd.randrange(20, 90))} {passage} {words(40)}".encode() for _ in range(2))
        known = {x for _, x in pieces(first)}
        assert substring_dedup.runs([(at, len(x)) for at, x in pieces(second) if x in known])


# ---- op5 ----


def plain_simhash(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    k = min(k, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, ids, most):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, x in enumerate(ids):
        if x is not None:
            low[find(i)] = min(low.get(find(i), x), x)
    return [low.get(find(i)) for i in range(len(prints))]


def test_simhash_equals_brute_force(spark, sf, docs):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(120).unionByName(docs(*[(None if r[0] is None else r[0] + 10_000, r[1]) for r in ODD]))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    prints = [plain_simhash(t, 4) for _, t in rows]
    want = collections.Counter((d, p, c) for (d, _), p, c in zip(rows, prints, plain_components(prints, [d for d, _ in rows], 4)))
    got = collections.Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_classes(df, 4, 4).collect())
    assert got == want


def test_links_of_a_heavy_group(spark):
    rnd = random.Random(2)
    prints = {0}
    while len(prints) < 300:
        x = rnd.choice(sorted(prints))
        prints.add(x ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    prints = sorted(prints) + [rnd.getrandbits(64) for _ in range(200)]
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x, x, bytearray()) for x in signed], "node long, fp long, wide binary")
    found = {r.node: r.root for r in components(simhash.links(df, 4, 6, tile=32)).collect()}
    want = plain_components(prints, signed, 4)
    assert [found.get(x, x) for x in signed] == want


def test_components(spark):
    n = 400
    order = list(range(n))
    random.Random(4).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1) if i != 100] + [(1000, 1000), (7, 7), (5000, 5001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[x] for x in order[:101]} == {min(order[:101])}
    assert {got[x] for x in order[101:]} == {min(order[101:])}
    assert got[5001] == 5000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dedup(docs):
    rnd = random.Random(8)
    words = lambda n: [("w%05d" % rnd.randrange(99_999)) for _ in range(n)]
    base = [words(150) for _ in range(8)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(100 + i, " ".join(w[:70] + words(1) + w[71:])) for i, w in enumerate(base)] + [(200 + i, " ".join(words(150))) for i in range(8)]
    kept = {r.doc_id for r in simhash.near_dedup(docs(*rows)).collect()}
    assert {200 + i for i in range(8)} <= kept
    assert all(len({i, 100 + i} & kept) == 1 for i in range(8))
    assert kept == {r.doc_id for r in simhash.near_dedup(docs(*rows[::-1])).collect()}
    assert simhash.near_dedup(docs(*ODD)).columns == docs().columns


def test_near_dedup_at_the_threshold(docs):
    # 450 shingles; each changed word costs five: 10 of them give a similarity of 0.8, 11 of 0.782.
    rnd = random.Random(80)
    rows = []
    for i in range(120):
        words = ["w%06d" % rnd.randrange(999_999) for _ in range(454)]
        rows.append((i, " ".join(words)))
        for at in rnd.sample(range(4, 450, 6), 10 if i < 80 else 11):
            words[at] = "x%06d" % rnd.randrange(999_999)
        rows.append((1000 + i, " ".join(words)))
    kept = {r.doc_id for r in simhash.near_dedup(docs(*rows)).collect()}
    assert {i for i in range(80) if 1000 + i in kept} == set()
    assert kept >= {1000 + i for i in range(80, 120)} | set(range(120))


# ---- op6 ----


def test_toxicity_held_out(spark, docs):
    rnd = random.Random(6)
    stems = ["the", "cat", "walks", "over", "green", "hills", "under", "moon", "water", "stone"]
    rows, marks = [], []
    for i in range(900):
        w = [rnd.choice(stems) for _ in range(rnd.randrange(20, 60))]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(4):
                w.insert(rnd.randrange(len(w)), rnd.choice(["zorgish", "zorgly", "Vexqu", "vexqua"]))
        rows.append((i, " ".join(w)))
        marks.append((i, toxic))
    df = docs(*rows, (5000, None), (5001, ""), (None, "x"))
    labels = spark.createDataFrame([*marks, (0, None), (None, 1), (1, 7)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score_documents(df, labels).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out for i in held)
    assert sum(out[i].predicted == int(i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert out[5000].score == out[5001].score
    assert all(0 <= r.score <= 1 for r in out.values())


def test_toxicity_of_many_sequences(spark, docs, monkeypatch):
    # About 360,000 different sequences: each keeps its own ratio, held by the tasks or joined.
    rnd = random.Random(66)
    letters = [chr(c) for c in range(0x3B1, 0x3CA)] + [chr(97 + i) for i in range(26)] + [chr(c) for c in range(0x430, 0x450)]
    rows = [(i, "".join(rnd.choices(letters, k=20_000))) for i in range(30)]
    df, labels = docs(*rows, (30, ""), (31, None)), spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    got = {r.doc_id: r.llr for r in toxicity.scored(df, labels).collect()}
    train = toxicity.labelled(df, labels).where(common.fold() != 1).select("text", F.col("toxic").cast("int").alias("toxic"))
    counts = common.materialise(train.transform(common.in_arrow, toxicity._count, "key long, t long, o long").groupBy("key").agg(F.sum("t").alias("t"), F.sum("o").alias("o")))
    grams, contexts = ({r.key: r.llr for r in x.select("key", "llr").collect()} for x in toxicity.ratios(counts))
    assert len(grams) > 200_000
    for i, text in rows[:6]:
        keys = [int(k) for codes in common.code_runs(text, 3) for k in common.packed(codes, 4)]
        assert got[i] == pytest.approx(sum(grams.get(k, contexts.get(k >> common.CODE_BITS, 0.0)) for k in keys), rel=1e-3, abs=1e-2)
    monkeypatch.setattr(toxicity, "BROADCAST_SEQUENCES", 0)
    assert {r.doc_id: r.llr for r in toxicity.scored(df, labels).collect()} == pytest.approx(got, rel=1e-6, abs=1e-6)


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score_documents(docs((1, "a"), (2, None)), labels).collect()] == [0.0, 0.0]
    assert toxicity.score_documents(docs(), labels).count() == 0


def test_pooled_model_sums_to_one(spark):
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcd ") for _ in range(2000))
    keys = collections.Counter(k for c in common.code_runs(text, 3) for k in common.packed(c, 4).tolist())
    df = spark.createDataFrame([(k, n, 0) for k, n in keys.items()], "key long, t long, o long").selectExpr(f"key & {(1 << 2 * common.CODE_BITS) - 1} as key", "t as c").groupBy("key").agg({"c": "sum"}).withColumnRenamed("sum(c)", "c")
    got = toxicity._pooled(df, None, None).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.key >> common.CODE_BITS].append(r.b)
    for chances in by.values():  # seen letters and the share that D leaves to unseen ones
        assert 0 < sum(chances) <= 1


# ---- op7 ----


def test_fingerprints_compose():
    rnd = random.Random(1)
    a, b = (bytes(rnd.randrange(256) for _ in range(n)) for n in (70_000, 123))
    whole = int.from_bytes(a + b, "big") % exact_dedup.MODULUS
    assert exact_dedup.compose(exact_dedup.fingerprint(a), exact_dedup.fingerprint(b), len(b)) == whole
    assert exact_dedup.fingerprint_stream(a + b, 1000) == whole


@pytest.mark.parametrize("huge", [4, 1 << 15])
def test_exact_dedup(docs, huge):
    rows = [*ODD, (8, "ab "), (9, "a\tb\x0b  "), (10, "a\xa0b"), (11, "é" * 70_000)]
    got = exact_dedup.exact_dedup(docs(*rows), huge).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0))
    assert len(got) == len(rows)
    for r in got:
        body = next(b for b in groups if hashlib.sha256(b.encode()).hexdigest() == r.text_sha256)
        best = min(groups[body])
        assert (r.keep_id, r.group_size) == (None if best[1] else best[2], len(groups[body]))
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.kept_documents(docs(*rows)).count() == len(groups)
    assert exact_dedup.exact_dedup(docs()).count() == 0


def test_colliding_fingerprints_are_split(docs, monkeypatch, spark):
    printed = spark.createDataFrame([((0, 0), 1, 1, bytearray(b"f" * 16), 1, "s1"), ((0, 1), 2, 1, bytearray(b"f" * 16), 1, "s2"), ((0, 2), 3, 1, bytearray(b"f" * 16), 1, "s1")], exact_dedup._PRINTED)
    bad = printed.select("fp", "n_bytes").distinct()
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda d, h: printed)
    monkeypatch.setattr(exact_dedup, "collided", lambda d, g: bad)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs()).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2)}


# ---- op8 ----


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")


def test_bpe_equals_library(spark, sf, docs, library):
    rnd = random.Random(11)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["", None, "Hi <|endoftext|>there", "a" * 9000, "0123456789" * 900, " " * 5000 + "x", "日本語" * 2000, "x" * 3000 + " it's <|endoftext|>" + "=-" * 4000, "word " * 30_000]
    texts += ["".join(rnd.choice(a) for _ in range(5000)) for a in ("ab", "etaoin", "é漢", " \n\t", "!?", "a1", "\U0001f600x")]
    df = docs(*enumerate(texts))
    ids = bpe.decode(bpe.encode(df.select("doc_id", "text"), segment=4096)).collect()
    assert len(ids) == len(texts)
    for r in ids:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == want, r.doc_id
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    one = bpe.digests(docs((1, "a b"))).first()
    want = library.encode("a b", add_special_tokens=False).ids
    assert (one.n_tokens, one.ids_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
    assert one.decoded_sha256 == hashlib.sha256(b"a b").hexdigest()


# ---- op9 ----


def test_language_held_out(docs):
    rnd = random.Random(12)
    sounds = {"aa": "ba ke lo mi nu", "bb": "strat krünk plöff gnarz", "cc": "щи бор кан лес"}
    rows = []
    for i in range(240):
        lang = "aabbcc"[2 * (i % 3) : 2 * (i % 3) + 2]
        rows.append((i, " ".join("".join(rnd.choice(sounds[lang].split()) for _ in range(3)) for _ in range(30)), lang))
    out = {r.doc_id: r for r in langid.identify(docs(*rows, (900, None, "aa"), (901, "", None), (902, "12 !?", "bb"), (903, "bake lomi", None))).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in rows)
    assert all(0 <= r.score <= 1 for r in out.values())
    assert [out[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert [r.lang_pred for r in langid.identify(docs((1, "abc"))).collect()] == ["und"]
    assert langid.identify(docs()).count() == 0


def test_pieces_of_long_texts_hold_every_gram():
    text = "".join(random.Random(2).choice("abc. ÄΩ") for _ in range(3000))
    whole = np.concatenate([common.packed(c, 4) for c in common.code_runs(text, 3)])
    cut = np.concatenate([common.packed(c, 4) for c in common.code_runs(text, 3, piece=7)])
    assert whole.tolist() == cut.tolist()


# ---- op10 ----


def test_mixing_equals_sql(spark, docs):
    rnd = random.Random(13)
    rows = [(i, " ".join(["w"] * rnd.randrange(0, 60)) if rnd.random() > 0.02 else None, None, rnd.choice(["a", "b", "b", "b", "c", "d", None, ""])) for i in range(600)]
    rows += [(1000, "x", None, "tiny"), (1001, "", None, "none")]
    df = docs(*rows)
    got = sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.mix(df).collect())
    documents = df.toPandas()  # noqa: F841  read by name
    documents["source"] = documents["source"].astype(object).where(documents["source"].notna(), None)
    want = sorted(tuple(r) for r in duckdb.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.OP10_SQL})").fetchall())
    assert got == want
    taken = mixing.mixed_documents(df)
    assert taken.columns == df.columns
    words = sum(len((r.text or "").split()) for r in taken.collect())
    assert words == sum(x[4] for x in got)


def test_mixing_of_odd_tables(docs):
    rows = mixing.mix(docs(*[(i, t, None, "s") for i, t in ODD])).collect()
    assert len(rows) == len(ODD)
    assert sum(r.taken for r in rows) == sum(r.size for r in rows)  # one source: its target is its size
    assert mixing.mix(docs()).count() == 0


def test_mixing_keeps_documents_without_words(docs):
    # Equal words and weights 1 and 2: the second source takes each of its documents at least once, the empty ones too.
    rows = [(i, "a b c d", None, "ab"[i % 2]) for i in range(40)] + [(100, "", None, "b"), (101, None, None, "b"), (102, " \n", None, "b")]
    copies = {r.doc_id: r.copies for r in mixing.mix(docs(*rows)).collect()}
    got = collections.Counter(r.doc_id for r in mixing.mixed_documents(docs(*rows)).collect())
    assert min(copies[x] for x in (100, 101, 102)) >= 1
    assert got == {k: n for k, n in copies.items() if n}
