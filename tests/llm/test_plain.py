"""The registered queries and operators against plain versions over whole small tables, and their results for odd ones."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tagloom.llm import ann, bpe, common, exact_dedup, langid, minhash, mixing, pii, sharding, simhash, substring_dedup, toxicity
from tagloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def rows(spark, sf):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]


# ---- rows keep their address ----


def test_addresses_do_not_depend_on_tasks(spark, tmp_path):
    path = str(tmp_path / "docs")
    texts = [f"text {i % 40} " + "word " * (i % 7) for i in range(400)]
    spark.createDataFrame([(i % 390, t, None, "ab"[i % 2], 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(7).write.parquet(path)
    keys = ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k, None) for k in keys}
    seen = collections.defaultdict(list)
    try:
        for first, then in (("2", "11"), ("11", "2")):
            stages = (exact_dedup.kept_documents, mixing.mixed_documents, simhash.near_dedup, sharding.shuffle_into_shards)
            for f in stages:
                spark.conf.set(keys[0], first)
                spark.conf.set(keys[1], "1" if int(first) > 4 else "4194304")
                out = f(spark.read.parquet(path))
                spark.conf.set(keys[0], then)
                spark.conf.set(keys[1], "1" if int(then) > 4 else "4194304")
                seen[f.__name__].append(sorted(map(tuple, out.collect()), key=repr))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert all(x == found[0] for found in seen.values() for x in found)
    assert len(seen["kept_documents"][0]) == len({re.sub(r"\s", "", t) for t in texts})


# ---- op1 ----


def test_nearest_of_repeated_ids(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((60, 8)).round(3).tolist()
    table = [(i, x) for i, x in enumerate(v)] + [(20, v[20]), (20, v[21]), (7, v[40]), (7, v[40])]
    df = ann.usable(spark.createDataFrame(table, "vec_id long, embedding array<double>"))
    got = collections.Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.search(df.where("vec_id % 20 = 0"), df, 20, row_block=16, query_block=2).collect())
    want = collections.Counter()
    for i, (q, x) in enumerate(table):
        if q % 20 == 0:
            near = sorted((-float(np.dot(x, y)), w) for j, (w, y) in enumerate(table) if j != i)[:20]
            want.update((q, k + 1, w, round(-s, 9)) for k, (s, w) in enumerate(near))
    assert got == want
    again = collections.Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.search(df.where("vec_id % 20 = 0"), df.repartition(3), 20, row_block=16, query_block=2).collect())
    assert again == want


# ---- op2 ----


def test_op2_sizes_and_law(spark, sf, rows):
    got = QUERIES["op2_sharding"](spark, sf).collect()
    text = lambda t: (t or "").encode()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == [(i, len(text(t)) + 1, zlib.crc32(text(t))) for i, t, _ in rows]
    slots = collections.defaultdict(list)
    for r in got:
        assert (r.law, r.grown_shard) == ("rows", None)
        slots[r["shard"]].append(r.slot)
    assert sorted(slots) == list(range(8))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


@pytest.mark.parametrize(("block", "cell"), [(4, 3), (16, 1 << 16)])
def test_shards_of_many_blocks_and_cells(spark, block, cell):
    got = sharding.shuffle_into_shards(spark.range(500).selectExpr("0 as doc_id", "id as `a.b`"), 3, block=block, cell=cell).collect()
    assert sorted(r["a.b"] for r in got) == list(range(500))
    assert sorted((r["shard"], r.slot) for r in got) == [(s, i) for s in range(3) for i in range(167 - (s == 2))]
    order = [r["a.b"] for r in sorted(got, key=lambda r: (r["shard"], r.slot))]
    assert abs(np.corrcoef(order, range(500))[0, 1]) < 0.2


# ---- op3 ----


def test_pii_equals_plain_version(spark, sf, rows):
    key = b"over all documents"
    got = {r.doc_id: (r.n_entities, r.text) for r in pii.pseudonymise(spark.read.parquet(f"{sf}/documents.parquet"), key).collect()}
    found = {i: pii.mentions(t or "") for i, t, _ in rows}
    entities = sorted({(k, c) for x in found.values() for _, _, k, c in x if k != "given"})
    # Rounds: of the entities that draw a form which nobody has and which is no entity, the least gets it.
    attempts, taken, pending = {}, set(), entities
    for attempt in itertools.count():
        if not pending:
            break
        drawn = {}
        for k, c in pending:
            drawn.setdefault((k, pii.surrogate(k, c, attempt, key)), (k, c))
        for form, entity in drawn.items():
            if form not in taken and form not in set(entities):
                taken.add(form)
                attempts[entity] = attempt
        pending = [x for x in pending if x not in attempts]
    assert len(taken) == len(entities) > 10
    forms = collections.defaultdict(set)
    for i, t, _ in rows:
        want = pii.replace(t, attempts, key) if t else (t, 0)
        assert got[i] == (want[1], want[0])
        for s, e, k, c in found[i]:
            forms[k, c].add(pii.surrogate(k, c, attempts.get((k, c), 0), key))
    assert all(len(x) == 1 for x in forms.values())  # coreference
    assert len({(k, *x) for (k, _), x in forms.items()}) == len(forms)  # distinctness
    assert all(c not in x for (_, c), x in forms.items())


def test_pii_names_and_dates():
    spoken = lambda t: [t[s:e] for s, e, _, _ in pii.mentions(t)]
    assert spoken("Jean-Paul Sartre and Ms Schmidt-Rottluff") == ["Jean", "Paul", "Sartre", "Schmidt", "Rottluff"]
    assert spoken("call 555-1234 or 555.123.4567") == ["555-1234", "555.123.4567"]
    assert spoken("order 123 456 789 of 2024-05-06 12 345, 06.05.2024 12 34") == []
    got, n = pii.replace("Анна Иванова и Иван Иванов, Мария Достоевская", {}, b"k")
    anna, ivanova, ivanov, other = re.fullmatch(r"(\w+) (\w+) и \w+ (\w+), \w+ (\w+)", got).groups()
    assert (n, pii._PLACE[anna]) == (6, ("f", "cyrillic"))
    assert pii.feminine(ivanov.casefold()) == ivanova.casefold() != ivanov.casefold()
    assert other.endswith(("ова", "ина", "ская"))


def test_pii_key(spark, sf):
    rows = spark.createDataFrame([(1, "write to a.b@example.org")], "doc_id long, text string")
    one, two, three = (pii.pseudonymise(rows, k).first().text for k in (b"1", b"1", b"2"))
    assert one == two != three
    assert pii.session_key(spark) != pii.session_key(spark)
    spark.conf.set("spark.tagloom.pii.key", "held")
    try:
        assert pii.session_key(spark) == b"held"
    finally:
        spark.conf.unset("spark.tagloom.pii.key")


# ---- op4 ----


def test_substring_dedup_equals_plain_version(spark, sf, rows):
    got = {r.doc_id: r for r in QUERIES["op4_substring_dedup"](spark, sf).collect()}
    seen: dict[bytes, int] = {}
    some = 0
    for i, t, _ in rows:  # in the order of doc_id, which is unique here
        data, first, parts, own = (t or "").encode(), 0, [], {}
        for end in substring_dedup.cuts(data):
            digest = hashlib.blake2b(data[first:end], digest_size=16).digest()
            if digest in seen or digest in own:
                parts.append((first, end - first, seen.get(digest, i)))
            own.setdefault(digest, i)
            first = end
        for digest in own:
            seen.setdefault(digest, i)
        spans = substring_dedup.runs([(at, size) for at, size, _ in parts])
        left, spans = substring_dedup.without(data, spans)
        assert [(x["start"], x["end"]) for x in got[i].spans] == spans
        assert (got[i].text or "") == left.decode()
        assert got[i].removed_bytes == len(data) - len(left)
        some += bool(spans)
    assert some > 10


def test_substring_dedup_without_ids(docs):
    passage = " ".join(f"w{i * 7919 % 1000}" for i in range(80))
    out = substring_dedup.substring_dedup(docs((None, "one " + passage), (None, "two " + passage), (None, "two " + passage), (5, "x"), (5, "x"))).collect()
    cut = sorted(r.removed_bytes > 200 for r in out if r.n_bytes > 200)
    assert cut in ([False, False, True], [False, True, True])  # equal rows count as one document, the others are told apart
    assert all(r.repeats_of == [] for r in out)


# ---- op5 ----


def test_keys_grow_with_the_fingerprints(spark):
    assert [simhash.agreeing(10**k, 4) for k in (3, 6, 9, 12)] == sorted(simhash.agreeing(10**k, 4) for k in (3, 6, 9, 12))
    assert simhash.agreeing(10**10, 4) > simhash.agreeing(10**5, 4)
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(40)]
    prints = sorted({x ^ sum(1 << b for b in rnd.sample(range(64), k)) for x in base for k in (0, 3, 4, 5)})
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {frozenset((a, b)) for (a, x), (b, y) in itertools.combinations(zip(signed, prints), 2) if (x ^ y).bit_count() <= 4}
    for pieces in (5, 7, 9):
        got = simhash.links(df, 4, pieces)
        assert _classes({(r.a, r.b) for r in got.collect()}) == _classes(want)


def _classes(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in map(tuple, links):
        root[find(a)] = find(b)
    out = collections.defaultdict(set)
    for x in list(root):
        out[find(x)].add(x)
    return {frozenset(x) for x in out.values()}


# ---- near copies of the pipeline ----


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("tile", [2048, 16])
def test_similar_classes_equal_brute_force(spark, docs, tile):
    rnd = random.Random(21)
    base = ["b%04d" % rnd.randrange(9999) for _ in range(60)]
    texts = []
    for i in range(150):  # one group around the threshold, among it many pairs that are nearly but not quite similar
        w = list(base)
        for at in rnd.sample(range(60), rnd.choice([0, 1, 1, 2, 2, 3])):
            w[at] = "x%05d" % rnd.randrange(99_999)
        texts.append(" ".join(w))
    texts += [" ".join("r%04d" % rnd.randrange(9999) for _ in range(rnd.randrange(1, 40))) for _ in range(60)] + ["", None, "  ", texts[3], texts[3].upper()]
    df, uid = common.addressed(docs(*enumerate(texts)))
    groups = collections.defaultdict(set)
    for r in minhash.similar_classes(df, uid, tile).collect():
        groups[r.root].add(r.doc_id)
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = _classes(links)
    assert {frozenset(x) for x in groups.values() if len(x) > 1} == want


def test_near_dedup_recall(spark, sf, rows):
    kept = {r.doc_id for r in simhash.near_dedup(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    sets = {i: shingles(t) for i, t, _ in rows}
    links = [(i, j) for (i, x), (j, y) in itertools.combinations(sets.items(), 2) if x == y or (4 * max(len(x), len(y)) <= 5 * min(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y))]
    assert kept == set(sets) - {i for c in _classes(links) for i in c if i != min(c)}


# ---- op6 ----


def test_toxicity_equals_plain_version(spark, docs):
    rnd = random.Random(31)
    rows = [(i, " ".join(rnd.choice(["ab", "abc", "bad", "cab", "dada", "Ää", "汉字"]) for _ in range(12)) + (" vexq" * 2 if i % 3 == 0 else "")) for i in range(200)]
    labels = {i: int(i % 3 == 0) for i, _ in rows}
    got = {r.doc_id: (r.llr, r.n) for r in toxicity.scored(docs(*rows), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")).collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5

    def grams(text):
        s = "_" + re.sub(r"[^\w]|[\d_]", " ", text.lower()).strip()
        s = re.sub(" +", "_", s) + "_"
        return [s[k : k + 4] for k in range(len(s) - 3)]

    counts = [collections.Counter(g for i, t in rows if fold(i) > 1 and labels[i] == x for g in grams(t)) for x in (0, 1)]
    pooled = {4: counts[0] + counts[1]}
    for n in (3, 2, 1):
        pooled[n] = collections.Counter(g[1:] for g in pooled[n + 1])
    after = {n: collections.defaultdict(list) for n in pooled}
    for n, c in pooled.items():
        for g, k in c.items():
            after[n][g[:-1]].append(k)

    def shared(g):
        below = shared(g[1:]) if len(g) > 1 else 1 / (1 << common.CODE_BITS)
        held = after[len(g)][g[:-1]]
        return (pooled[len(g)][g] - 0.5 + 0.5 * len(held) * below) / sum(held)

    def chance(g, x):
        own = [k for h, k in counts[x].items() if h[:3] == g[:3]]
        if not own:
            return shared(g)
        return (max(counts[x][g] - 0.5, 0) + 0.5 * len(own) * shared(g)) / sum(own)

    def spare(context, x):
        own = [k for h, k in counts[x].items() if h[:3] == context]
        return 0.5 * len(own) / sum(own) if own else 1.0

    known = {}
    for i, t in rows[:40]:
        total = 0.0
        for g in grams(t):
            if g not in known:
                if g in pooled[4]:
                    known[g] = math.log(chance(g, 1) / chance(g, 0))
                else:
                    known[g] = math.log(spare(g[:3], 1) / spare(g[:3], 0)) if after[4].get(g[:3]) else 0.0
            total += known[g]
        assert got[i][0] == pytest.approx(total, rel=1e-4, abs=1e-4)
        assert got[i][1] == len(grams(t))


# ---- op7 ----


def test_huge_texts_are_cut_once(docs):
    text = "é x" * 3_000_000
    rows = [(1, text), (2, text.replace(" ", "\n\n")), (3, text + "y"), (4, "z")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(docs(*rows)).collect()}
    digest = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest()
    assert got == {1: (2, 2, digest(text)), 2: (2, 2, digest(text)), 3: (3, 1, digest(text + "y")), 4: (4, 1, digest("z"))}


# ---- op9 ----


def test_language_equals_exact_sets(spark, sf, rows):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.lang_pred for r in QUERIES["op9_langid"](spark, sf).collect()}
    langs, filt = langid.learn(df)
    counts = collections.defaultdict(collections.Counter)
    grams = lambda t: [k for c in common.code_runs(t, 3) for k in common.packed(c, 4).tolist()]
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 5 and lang is not None and t is not None:
            counts[lang].update(grams(t))
    sets = {x: {k for k, n in c.items() if n >= langid.MIN_SHARE * sum(c.values())} for x, c in counts.items()}
    assert langs == sorted(sets)
    same = 0
    for i, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            assert got[i] == "und"
            same += 1
            continue
        g = grams(t)
        exact = [sum(k in sets[x] for k in g) for x in langs]
        held, n, _ = langid.hits(t, filt, len(langs))
        assert n == len(g)
        assert all(a <= b for a, b in zip(exact, held))  # the filter holds every n-gram of the sets
        same += got[i] == langs[max(range(len(langs)), key=lambda k: (exact[k], -k))]
    assert same >= 0.99 * len(rows)


# ---- op10 ----


def test_inclusion_odds_differ_within_a_source(docs):
    rnd = random.Random(41)
    df = docs(*[(i, " ".join(["w"] * rnd.choice([1, 5, 40, 300])), None, "abc"[i % 3]) for i in range(240)])
    taken, chances, expected = collections.Counter(), {}, collections.Counter()
    for seed in range(12):
        for r in mixing.mix(df, f"s{seed}").collect():
            chances[r.doc_id] = (r.source, r["size"], r.p)
            taken[r.source] += r.taken
            expected[r.doc_id] += r.copies
            assert r.copies <= mixing.MOST
    by = collections.defaultdict(set)
    for source, size, p in chances.values():
        by[source].add((size, round(p, 12)))
    assert any(len({p for _, p in x}) > 2 for x in by.values())
    targets = {r.source: r.target for r in mixing.mix(df).collect()}
    assert all(abs(taken[s] / 12 - t) <= 300 for s, t in targets.items())
    for source, found in by.items():
        for size, p in found:
            ids = [i for i, x in chances.items() if x[:2] == (source, size)]
            share = sum(expected[i] % 1 if p == 0 else expected[i] for i in ids) / (12 * len(ids))
            assert p == 0 or abs(share % 1 - p) < 0.25 or abs(share % 1 - p) > 0.75


# ---- odd tables ----


@pytest.mark.parametrize("name", ["pii", "substring", "simhash", "near", "bpe", "toxic", "exact", "mix"])
def test_empty_tables(spark, docs, name):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    run = {
        "pii": lambda d: pii.pseudonymise(d, b"k"), "substring": substring_dedup.substring_dedup, "simhash": lambda d: simhash.simhash_classes(d, 4, 4), "near": simhash.near_dedup,
        "bpe": bpe.digests, "toxic": lambda d: toxicity.clean_documents(d, labels), "exact": exact_dedup.kept_documents, "mix": mixing.mixed_documents,
    }
    assert run[name](docs()).count() == 0


def test_repeated_and_long_rows(spark, docs):
    long = "aé " * 200_000 + "wörd" * 50_000
    rows = [(1, "the cat sat", "aa"), (1, "the cat sat", "aa"), (2, long, "bb"), (2, long, "bb"), (None, None, None), (None, "x", "aa")]
    df = docs(*rows)
    labels = spark.createDataFrame([(1, 0), (2, 1), (1, 1)], "doc_id long, toxic int")
    for out in (toxicity.score_documents(df, labels), bpe.digests(df), langid.identify(df), pii.pseudonymise(df, b"k"), substring_dedup.substring_dedup(df), simhash.simhash_classes(df, 4, 4)):
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(rows)
        assert all(n == 2 for x, n in collections.Counter(map(repr, got)).items() if x.startswith(("(1,", "(2,")))


def test_pipeline_with_clashing_columns(spark, sf, docs):
    names = ["uid", "copies", "__text", "a.b", "score", "predicted", "llr", "node", "root", "__uid", "kept", "size"]
    df = docs((1, "one two three four five six", "en", "a", 5), (1, "one two three four five six", "en", "a", 5), (2, None, None, None, None), (None, "", None, "b", 0), (3, "one two", "en", "a", 7))
    df = df.select("*", *(F.lit(f"own {x}").alias(x) for x in names))
    columns = df.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = corpus_pipeline.materialise(stage(spark, df, sf))
        assert df.columns == columns, name
        assert all(r[x] == f"own {x}" for r in df.collect() for x in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, df, sf).count() == df.count() > 0
    empty = df.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name


def test_pipeline_equals_plain_version(spark, sf, rows):
    """Each stage by a plain rule over what its predecessor kept; the scores and the mix are the operators' own."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r.doc_id for r in QUERIES["op6_toxicity"](spark, sf).where("predicted = 1").collect()}
    left = [(i, t) for i, t, _ in rows if i not in toxic]
    best = {}
    for i, t in left:
        body = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[body] = min(best.get(body, (1, 0)), (-len(t or ""), i))
    left = [(i, t) for i, t in left if (-len(t or ""), i) == best[re.sub(r"[\x20\x09-\x0D]", "", t or "")]]
    sets = {i: shingles(t) for i, t in left}
    links = [(i, j) for (i, x), (j, y) in itertools.combinations(sets.items(), 2) if x == y or (4 * max(len(x), len(y)) <= 5 * min(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y))]
    gone = {i for c in _classes(links) for i in c if i != min(c)}
    left = {i: t for i, t in left if i not in gone}
    mixed = mixing.mix(docs.where(F.col("doc_id").isin(list(left)))).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    want = collections.Counter()
    for r in mixed:
        ids = library.encode(left[r.doc_id] or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += r.copies
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == +want
