"""The training-data operators on small hostile tables, each against a brute-force version."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import common as c
from quarry.llm import decontamination, language_model, line_dedup, mixing, near_dedup, pii, registry, token_count, toxicity, url_filter, vector_search

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(1)
VOCABULARY = ["w" + "".join(RNG.choice("abcdefgh") for _ in range(5)) for _ in range(4000)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


LONG = "\n".join(prose(900 + i, 40) for i in range(700))


def hostile():
    """Nulls in every column, empty and very long texts, repeated rows, ties."""
    rows = [(i, prose(i, 60), "en", f"s{i % 4}", 1) for i in range(40)]
    rows += [(100, None, "en", "s1", 0), (101, "", None, None, None), (102, " \n\t ", "de", "s2", 3), (103, LONG, "en", "s1", len(LONG)), (None, prose(5, 60), "en", "s1", 9), (None, None, None, None, None)]
    rows += [(104, "two words", "en", "s0", 9), (105, "Two  words!", "en", "s0", 11), (0, prose(0, 60), "en", "s0", 1), (0, prose(0, 60), "en", "s0", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hostile(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Extra columns named as operators' own outputs and internals."""
    names = ("score", "size", "key", "node", "rank", "word", "line", "n", "part", "row", "d1", "d2", "k1", "k2", "keep", "kept", "n_lines", "n_dropped", "cell", "lines", "gone", "h1", "pos", "root", "known", "taken", "target")
    under = ("_sid", "_passes", "_h", "_h2", "_size", "_source", "_taken", "_d1", "_k1", "_drop", "_kept", "_n_lines", "_n_dropped", "_label", "_uid", "_scratch_path", "a.b")
    return df.withColumns({n: F.lit("x") for n in (*names, *under)})


# 1


def test_toxicity(spark, docs, empty):
    marked = [(1000 + i, prose(i, 50) + (" vile" if i % 3 == 0 else "") + " end", "en", "s", 1) for i in range(400)]
    df = docs.unionByName(spark.createDataFrame(marked, SCHEMA))
    labels = spark.createDataFrame([(1000 + i, int(i % 3 == 0), 0) for i in range(300)] + [(None, 1, 0), (100, None, 0), (99999, 1, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(clashing(df), labels)
    got = toxicity.score(spark, clashing(df), model).collect()
    assert len(got) == len(hostile()) + 400 and all(0 <= r["score"] <= 1 for r in got)
    unseen = {r["doc_id"]: r["score"] for r in got if r["doc_id"] and r["doc_id"] >= 1300}
    assert all((s >= 0.5) == ((i - 1000) % 3 == 0) for i, s in unseen.items())
    kept = toxicity.drop_toxic(spark, clashing(df), labels)
    assert kept.columns == clashing(df).columns and kept.where("doc_id >= 1000").count() == 400 - 134
    none = toxicity.train(empty, labels.limit(0))
    assert toxicity.score(spark, empty, none).count() == 0 and toxicity.score(spark, docs, none).agg(F.max("score")).first()[0] == 0


def test_ftrl_step_by_step():
    """Against the update written out for one weight at a time."""
    r = random.Random(3)
    model, z, n, bias, bias_n = toxicity.Ftrl(8), collections.defaultdict(float), collections.defaultdict(float), 0.0, 0.0
    for _ in range(400):
        slots, label = sorted(r.sample(range(256), r.randrange(1, 20))), r.randrange(2)
        w = {i: 0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2) for i in slots}
        g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - label
        for i in slots:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
            n[i] += g * g
        bias_n += g * g
        bias -= toxicity.ALPHA / (toxicity.BETA + math.sqrt(bias_n)) * g
        model.learn(np.array(slots), label)
    assert abs(model.bias - bias) < 1e-3 and max(abs(model.z[i] - z[i]) for i in range(256)) < 2e-3 and max(abs(model.n[i] - n[i]) for i in range(256)) < 2e-3


def test_toxicity_held_out(spark):
    rows = registry.queries()["op1_toxicity"](spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


# 2


def weights_of(text, idf):
    words = c.plain_words((text or "").encode())
    if not words:
        return None
    h, w, _ = near_dedup.weighted(*c.shingle_hashes(c.WordHash().of(words), np.array([0, len(words)]), near_dedup.WIDTH), idf)
    return dict(zip(h.tolist(), w.tolist()))


def jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def edited(text, seed, n):
    words, r = text.split(), random.Random(seed)
    for _ in range(n):
        words[r.randrange(len(words))] = r.choice(VOCABULARY) + "x"
    return " ".join(words)


def test_near_duplicates(spark, docs, empty):
    base = prose(77, 300)
    copies = [(500 + i, edited(base, i, 2), "en", "s", 1) for i in range(25)] + [(600 + i, edited(prose(88, 120), i, 1 + i % 4), "en", "s", 1) for i in range(12)]
    df = docs.unionByName(spark.createDataFrame(copies, SCHEMA))
    rows = df.collect()
    got = near_dedup.classes(clashing(df)).collect()
    assert len(got) == len(rows)
    cls = {r["doc_id"]: r["class_id"] for r in got}
    plain = [(r["doc_id"], weights_of(r["text"], None)) for r in rows if r["doc_id"] is not None]
    parent = {i: i for i, _ in plain}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    linked = set()
    for (i, a), (j, b) in itertools.combinations(plain, 2):
        if a and b and i != j and jaccard(a, b) >= 0.8:
            parent[max(root(i), root(j))] = min(root(i), root(j))
            linked |= {i, j} if a != b else set()
    assert {i: cls[i] for i in parent} == {i: root(i) for i in parent}
    assert cls[100] == 100 and cls[101] == 101 and cls[104] == cls[105] == 104 and cls[None] is None
    assert {r["doc_id"]: r["n_links"] > 0 for r in got if r["doc_id"] is not None} == {i: i in linked for i in parent}
    kept = near_dedup.drop_duplicates(clashing(df))
    assert kept.columns == clashing(df).columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted({root(i) for i in parent}) and ids.count(None) == 2
    twice = spark.createDataFrame([(1, prose(1, 50), "en", "s", 1), (1, prose(2, 50), "en", "s", 1), (1, prose(2, 50), "en", "s", 1), (5, prose(1, 50), "en", "s", 1), (9, prose(2, 50), "en", "s", 1)], SCHEMA)
    assert sorted((r["doc_id"], r["text"]) for r in near_dedup.drop_duplicates(twice).collect()) == sorted([(1, prose(1, 50)), (1, prose(2, 50))])
    assert near_dedup.classes(empty).count() == 0 and near_dedup.drop_duplicates(empty).count() == 0


def test_near_copies_among_thousands_of_one_template(spark):
    """Texts at 0.75 to each other share buckets; pairs at 0.82 among them, far from centre and head, are found."""
    template = prose(4321, 240)
    tails = [prose(50_000 + i, 40).split() for i in range(2400)]
    for i in range(0, 120, 2):
        tails[i + 1][:14] = tails[i][:14]
    rows = [(i, f"{template} {' '.join(t)}", "en", "s", 1) for i, t in enumerate(tails)]
    plain = [weights_of(rows[i][1], None) for i in range(4)]
    assert jaccard(plain[0], plain[1]) > 0.82 and jaccard(plain[0], plain[2]) < 0.76
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect()}
    assert got == {i: i - i % 2 if i < 120 else i for i in range(2400)}


def test_bound_never_leaves_out_pairs_that_are_alike():
    r, hasher = random.Random(8), c.WordHash()
    rarity = lambda h: 1 + (h % np.uint64(97)).astype(float) / 96
    left = tried = 0
    for i in range(300):
        a = prose(60_000 + i, r.choice((6, 20, 80, 300, 900)))
        b = edited(a, i, r.randrange(0, 12)) + (" " + a if r.random() < 0.2 else "")
        sets = []
        for t in (a, b):
            words = c.plain_words(t.encode())
            h, tf, starts = near_dedup.weighted(*c.shingle_hashes(hasher.of(words), np.array([0, len(words)]), 5), None)
            sets.append((h, tf * rarity(h), tf, near_dedup.parities(h, rarity(h), starts), near_dedup.parities(h, rarity(h), starts, near_dedup.FOLDED)))
        alike = near_dedup.similarity(*(x[:3] for x in sets)) >= 0.8
        totals = [np.array([[x[1].sum(), x[2].sum()]], np.float32) for x in sets]
        for k in (3, 4):
            ok = near_dedup.possible(sets[0][k], sets[1][k], *totals, 0.8)[0]
            assert ok or not alike
            left, tried = left + (not ok), tried + 1
    assert left > tried / 5


def test_word_hashes_tell_words_apart(monkeypatch):
    r = random.Random(6)
    texts = ["".join(r.choice("aB\u00e9., \t\n\x0b-x") for _ in range(r.randrange(60))).encode() for _ in range(400)] + [b"", b" ", b"...", LONG.encode(), b"y" * 5000]
    for size in (c._SLICE, 64):
        monkeypatch.setattr(c, "_SLICE", size)
        h, starts = c.word_hashes(texts)
        lists = [c.plain_words(t) for t in texts]
        assert np.diff(starts).tolist() == [len(x) for x in lists]
        known = {}
        for word, value in zip((w for x in lists for w in x), h.tolist(), strict=True):
            assert known.setdefault(word, value) == value
        assert len(set(known.values())) == len(known)
    words = {b"%d" % i for i in range(200_000)}
    assert len(set(c.word_hashes([b" ".join(words)])[0].tolist())) == len(words)
    assert len(c.word_hashes([])[0]) == 0 and c.word_hashes([b""])[1].tolist() == [0, 0]


def test_samples_agree_as_often_as_texts_are_alike():
    words = [str(i).encode() for i in range(400)]
    a, b = words[:300], words[30:330]
    hasher = c.WordHash()
    keys = []
    for x in (a, b):
        h = hasher.of(x)
        one = np.array([near_dedup.samples(h, np.ones(len(h)), np.array([0, len(h)]))[0][:, 0]])
        keys.append(one[0])
    assert abs((keys[0] == keys[1]).mean() - 270 / 330) < 0.16  # three standard deviations of 64 samples


def test_pairs_meet_at_the_first_shared_shingle_alone(spark, monkeypatch):
    words = [f"w{i}" for i in range(260)]
    texts = {bytes([i]): (b"A" if i < 9 else b"B", " ".join(w if k not in (i * 13, (i > 8) * 250) else f"x{i}" for k, w in enumerate(words))) for i in range(18)}
    df = spark.createDataFrame([(n, root, text) for n, (root, text) in texts.items()], "node binary, root binary, text string")
    idf = spark.sparkContext.broadcast(near_dedup.Idf(np.ones((near_dedup.SKETCH_ROWS, near_dedup.SKETCH)), 10))
    rows = df.mapInArrow(near_dedup._starts(idf, 0.8), near_dedup._START).localCheckpoint()
    met = {tuple(map(bytes, r)) for r in near_dedup._meeting(rows, 0.8).collect()}
    sets = {n: near_dedup.weighted(*c.shingle_hashes(*c.word_hashes([t.encode()]), near_dedup.WIDTH), None) for n, (_, t) in texts.items()}
    alike = {(a, b) for a in texts for b in texts if a < b and texts[a][0] != texts[b][0] and near_dedup.similarity(sets[a][:2], sets[b][:2]) >= 0.8}
    assert len(alike) > 10 and alike <= met and all(texts[a][0] != texts[b][0] for a, b in met)
    monkeypatch.setattr(type(rows), "distinct", lambda self: self)
    made = near_dedup._meeting(rows, 0.8).count()
    assert made <= 1.5 * len(met)


# 3


def test_decontamination(spark, docs, empty):
    items = [(i, prose(2000 + i, 8 + 5 * i)) for i in range(12)] + [(60 + i, prose(2100 + i, 5 + i % 4)) for i in range(8)] + [(50, None), (51, ""), (52, "two words"), (53, prose(2003, 23)), (None, prose(2004, 28))]
    texts = [(700 + i, prose(i, 3000) + " " + prose(2000 + i, 8 + 5 * i) + " " + prose(3000 + i, 50 * i), "en", "s", 1) for i in range(12)]
    texts += [(750 + i, prose(i, 3000) + " " + prose(2100 + i, 5 + i % 4) + " " + prose(3000 + i, 900), "en", "s", 1) for i in range(8)]
    texts += [(800 + i, prose(1, 40) + " " + edited(prose(2000 + i, 8 + 5 * i), i, 1), "en", "s", 1) for i in range(12)]
    df = docs.unionByName(spark.createDataFrame(texts, SCHEMA))
    bench = spark.createDataFrame(items, "item_id long, text string")

    def shingles(text, k=None):
        w = c.plain_words((text or "").encode())
        k = k or min(5, len(w))
        return k, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    want = collections.Counter()
    for r in df.collect():
        for i, t in items:
            k, own = shingles(t)
            if own and len(own & shingles(r["text"], k)[1]) >= 0.8 * len(own):
                want[r["doc_id"], i] += 1
    got = collections.Counter((r["doc_id"], r["item_id"]) for r in decontamination.find(clashing(df), bench).collect())
    assert got == want and len(want) > 20
    dirty = {d for d, _ in want}
    clean = decontamination.drop_contaminated(clashing(df), bench)
    assert clean.columns == clashing(df).columns
    assert collections.Counter(r["doc_id"] for r in clean.collect()) == collections.Counter(r["doc_id"] for r in df.collect() if r["doc_id"] not in dirty)
    assert decontamination.find(empty, bench).count() == 0 and decontamination.find(docs, bench.limit(0)).count() == 0


# 4


def test_line_dedup(spark, docs, empty):
    shared = [(900 + i, f"{prose(i, 5)}\n  Shared LINE {'x' * (i % 2)}\t\n{prose(i + 50, 5)}\nShared line\n\n", "en", "s", 1) for i in range(24)]
    df = docs.unionByName(spark.createDataFrame(shared, SCHEMA))
    rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    key = lambda x: x.strip(c.BLANK).translate(str.maketrans(c.UPPER, c.LOWER))
    held = collections.Counter(k for d in set(rows) for k in {key(x) for x in d[1].split("\n")} if k)
    want = []
    for d, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if not held[key(x)] >= 10]
        want.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    order = lambda x: tuple(map(str, x))
    got = [tuple(r) for r in line_dedup.with_kept(clashing(df)).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()]
    assert sorted(got, key=order) == sorted(want, key=order) and any(x[2] for x in want)
    out = line_dedup.apply(clashing(df))
    assert out.columns == clashing(df).columns and out.where("doc_id = 900").first()["n_chars"] == len(want[rows.index((900, shared[0][1]))][3])
    assert {tuple(r) for r in out.select("_kept", "n_lines", "_d1").distinct().collect()} == {("x", "x", "x")}
    first = line_dedup.with_kept(df, keep_first=True).agg(F.sum("n_dropped")).first()[0]
    assert first == sum(x[2] for x in want) - sum(1 for v in held.values() if v >= 10)
    assert line_dedup.with_kept(empty).count() == 0


# 5


def test_url_filter(spark):
    hosts = [f"h{i}.example.com" for i in range(3000)]
    urls = ["http://WWW.Example.com/en/7x?q#f", "https://example.com/en/6", "http://a.net/de/9", "http://a.example.net/de/81", "http://x.org/es/", "http://x.org/es", "no scheme", None, "", "http://", "ftp://net#x", "a://b://c/d", "http://notexample.com/en/7"]
    pages = spark.createDataFrame(list(enumerate(urls + [f"http://{h}/p" for h in hosts] * 2)), "page_id long, url string")
    listed = spark.createDataFrame([(h,) for h in hosts[::7]] + [("not.there",), (None,), ("",)], "key string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(clashing(pages).select("page_id", "url", "key"), listed).collect()}
    block = set(hosts[::7])
    ruled = 0
    for i, u in enumerate(urls):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits)[1:] if fits else (None, "allow")
        assert got[i] == (host, path, *rule)
        ruled += rule[1] == "block"
    assert all(got[len(urls) + i][3] == ("block" if h in block else "allow") for i, h in enumerate(hosts * 2))
    cut = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages, listed, shard_keys=150).collect()}
    assert cut == got  # three cascades
    plan = url_filter.judge(pages, listed, shard_keys=150)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan
    assert url_filter.judge(pages.limit(0), listed).count() == 0 and url_filter.judge(pages, listed.limit(0)).where("verdict = 'block'").count() == ruled


# 6

_RULES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def by_rules(text):
    out = []
    for k, (name, pattern) in enumerate(_RULES):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if name == "ip" else 0, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[name]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_rules_match_the_patterns():
    r = random.Random(3)
    for _ in range(20000):
        text = "".join(r.choice("0123456789..@@+ -()aé%_\n12") for _ in range(r.randrange(40)))
        assert pii.base_spans(text) == by_rules(text)
    for text in ("1" * 50_000, "a" * 50_000 + "@", "1." * 20_000, "+1 " * 10_000, "@" * 20_000, "a@b" * 10_000):
        pii.base_spans(text)  # in linear time


def test_pii(spark, docs, empty):
    r = random.Random(5)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    phone, ip = lambda: f"+1 ({digits(3)}) 555-{digits(4)}", lambda: ".".join(str(r.randrange(256)) for _ in range(4))
    mail = lambda: f"ab{digits(2)}.x@mail{digits(1)}.example.com"

    def card():
        while not pii.luhn(d := "4" + digits(15)):
            pass
        return d

    rows = [(2000 + i, f"{prose(i, 10)} {r.choice((phone, ip, mail, card))()} {prose(i, 8)} version 2.0 in {digits(4)}", "en", "s", 1) for i in range(400)]
    rows += [(3000, f"call {card()} {card()} now", "en", "s", 1), (3001, "write ab12.x [at] mail3.example.com now", "en", "s", 1), (3002, "Version 2.0. of 1999", "en", "s", 1)]
    df = docs.unionByName(spark.createDataFrame(rows, SCHEMA))
    weights = pii.train(clashing(df))
    got = {r["doc_id"]: r for r in pii.find(spark, clashing(df), weights).collect()}
    for i, text, *_ in rows:
        base = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in by_rules(text)]
        assert got[i]["base"] == ",".join(base) and set(base) <= set(got[i]["spans"].split(",")) | {""}
        assert got[i]["n_card"] == sum(x.startswith("card") for x in base)
    assert got[3000]["n_card"] == 0 and got[3000]["spans"] == "card:5:21,card:22:38"
    assert got[3001]["spans"] == "email:6:35" and got[3002]["spans"] == "" and got[100]["spans"] == ""
    assert pii.redact("call +1 (234) 555-1234 x", pii.Model(weights)) == "call <phone> x"
    assert pii.find(spark, empty, pii.train(empty)).count() == 0


def segmentations(n, candidates):
    """All ways to cut n atoms into candidates (with a kind) and single atoms."""

    def cut(i):
        if i == n:
            yield ()
            return
        for rest in cut(i + 1):
            yield rest
        for k, (a, b) in enumerate(candidates):
            if a == i:
                for rest in cut(b):
                    for kind in range(4):
                        yield ((k, kind), *rest)

    return list(cut(0))


def test_pii_sums_and_best_against_all_segmentations():
    g = np.random.default_rng(4)
    for _ in range(30):
        n = int(g.integers(2, 7))
        candidates = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if g.random() < 0.4] or [(0, 1)]
        scores = g.normal(size=(len(candidates), 4))
        first, last = (np.array(x) for x in zip(*candidates))
        total = lambda s: float(np.logaddexp.reduce([sum(s[k, t] for k, t in x) for x in every]))
        every = segmentations(n, candidates)
        got, log_z = pii.marginals(first, last, scores, n)
        assert abs(log_z - total(scores)) < 1e-9
        for k in range(len(candidates)):
            for t in range(4):
                more = scores.copy()
                more[k, t] += 1e-5
                assert abs((total(more) - log_z) / 1e-5 - got[k, t]) < 1e-4  # the slope of the sum is the likelihood
    model = learnt()
    for text in ("+1 (234) 555-1234", "4111 1111 1111 1111", "ab12@x.example.com 10.0.0.1", "12-34 56.78", "a1 [at] b.com"):
        places, found = pii.candidates(text, 0, len(text))
        scores = np.array([model.score(sh, fl) for _, _, sh, fl in found])
        best = max(sum(scores[k, t] for k, t in x) for x in segmentations(len(places) - 1, [(i, j) for i, j, *_ in found])) if len(found) < 40 else None
        spans = pii.decode(model, text, 0, len(text))
        number = {p: i for i, p in enumerate(places)}
        mine = sum(scores[[(i, j) for i, j, *_ in found].index((number[s], number[e])), kind] for s, kind, e in spans)
        assert best is None or abs(mine - best) < 1e-9


def test_pii_added_spans_on_planted_variants():
    """Recall and precision of what the model adds, on rewritten entities that the rules miss and on numbers that are none."""
    model, r = learnt(), random.Random(77)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hit = wanted = added = 0
    for i in range(400):
        card, name = luhn_card(r), f"{r.choice(VOCABULARY)}.{r.choice(VOCABULARY)}"
        variants = (f"({digits(3)}) 555-{digits(4)}", f"{digits(3)}-555-{digits(4)}", f"{name} [at] example.com", f"{name} at mail.example.org", ".".join(card[k : k + 4] for k in range(0, 16, 4)), None)
        entity = variants[i % len(variants)]
        plain = f"version {r.randrange(9)}.{r.randrange(9)} of {r.randrange(1900, 2030)}, page {digits(2)}"
        text = f"{prose(i, 6)} {entity or plain} {prose(i + 1, 5)}"
        spans = pii.all_spans(model, text)[1]
        start = text.index(entity) if entity else -1
        wanted += entity is not None
        hit += any(s <= start + 2 and e >= start + len(entity or "") - 2 for s, _, e in spans) if entity else 0
        added += len(spans)
    print(f"added spans: recall {hit / wanted:.2f} of {wanted}, precision {hit / max(added, 1):.2f} of {added}")
    assert hit / wanted > 0.95 and hit / added > 0.95


def learnt():
    r = random.Random(9)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    makers = (lambda: f"+1 ({digits(3)}) 555-{digits(4)}", lambda: f"{r.choice(VOCABULARY)}.{r.choice(VOCABULARY)}@example.com", luhn_card)
    texts = [f"{prose(i, 10)} {makers[i % 3]()} {prose(i + 1, 8)} version 2.0 in {digits(4)}" for i in range(500)]
    return pii.Model(pii.learn(pii.training_zones(iter(texts))))


def luhn_card(r=random.Random(10)):
    while not pii.luhn(d := "4" + "".join(r.choice("0123456789") for _ in range(15))):
        pass
    return d


def test_pii_long_lists_have_no_seams():
    model = learnt()
    cards = [luhn_card() for _ in range(200)]
    assert pii.all_spans(model, " ".join(cards))[1] == [(17 * i, 2, 17 * i + 16) for i in range(200)]
    joined = ",".join(f"ab{i}.x[at]mail{i % 7}.example.com" for i in range(200))
    assert list(pii.zones(joined, [])) == [(0, len(joined))]
    run = "x" * 60
    (start, end), *more = pii.zones(f"7{run}{run}@{run}{run}{run}", [])
    assert (start, end) == (0, 185) and not more  # a local part that begins more than 64 places after a digit
    pii.all_spans(model, "12 " * 50_000)  # in linear time


def test_pii_written_out_addresses_without_digits():
    model = learnt()
    for text in ("write jane.doe [at] example.com now", "write jane.doe[at]example.com now", "write jane.doe (at) example.com now", "write jane.doe at example.com now"):
        assert pii.all_spans(model, text) == ([], [(6, 0, len(text) - 4)])
    assert pii.all_spans(model, "we met at noon. [at] the end (at) last") == ([], [])
    pii.all_spans(model, "[at]" + "a" * 100_000)  # in linear time


# 7


def by_brute_force(x, q, k):
    """Of each query the k nearest ids, ties to smaller ids, and its scores of all."""
    ids, m = np.array([i for i, _ in x]), np.array([v for _, v in x])
    s = m @ m[np.flatnonzero(ids == q)[0]]
    return [int(ids[j]) for j in np.lexsort((ids, -np.round(s, 9))) if ids[j] != q][:k], dict(zip(ids.tolist(), s.tolist(), strict=True))


def recall(got, x, k=20, least_rows=0):
    hits = total = 0
    for q in [i for i, _ in x if i % 20 == 0]:
        want, scores = by_brute_force(x, q, k)
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, k + 1))
        assert all(abs(scores[v] - sc) < 1e-9 for _, v, sc in mine)
        hits, total = hits + len({v for _, v, _ in mine} & set(want)), total + k
    return hits / total


def searched(df, told):
    got = collections.defaultdict(list)
    for r in vector_search.search(df, lambda i: i % 20 == 0, told=told).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return got


def test_vector_search(spark):
    """On clusters the windows are a small share of more than ten blocks; without structure they hold most rows; found either way."""
    g = np.random.default_rng(0)
    centres = g.standard_normal((60, 16)) * 3
    raw = np.array([centres[i % 60] + g.standard_normal(16) * 0.4 for i in range(6000)])
    x = list(enumerate((raw / np.linalg.norm(raw, axis=1, keepdims=True)).tolist()))
    same = x[5][1]
    x += [(10_000 + i, same) for i in range(60)]
    odd = [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] + [1.0] * 15), (9060, [float("inf")] * 16), (9080, [None] + [1.0] * 15), (None, same), (9100, [1.0, 2.0]), (9120, [])]
    df = spark.createDataFrame(x + odd, "id long, x array<double>")
    told = {}
    got = searched(df.withColumns({n: F.lit("y") for n in ("point", "curve", "rank", "block", "key", "ids", "h1", "vec_id")}), told)
    assert set(got) == {i for i, _ in x if i % 20 == 0} and recall(got, x) >= 0.9
    share = told["curves"] * (2 * told["reach"] + told["block"]) / told["points"]
    assert told["points"] // told["block"] >= 10 and share < 0.5, told
    for other in (raw[:2000], g.standard_normal((2000, 12))):  # lengths that differ, and no structure
        rows, told = list(enumerate(other.tolist())), {}
        assert recall(searched(spark.createDataFrame(rows, "id long, x array<double>"), told), rows) >= 0.9, told
    few = vector_search.search(df.where("id < 5"), lambda i: i % 20 == 0).collect()
    assert [(r["rank"], r["query_id"]) for r in few] == [(k, 0) for k in range(1, 5)]
    assert vector_search.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_hilbert_neighbours_touch():
    grid = np.array(list(itertools.product(range(8), repeat=3)))
    walk = grid[np.argsort(vector_search.hilbert(grid, 3))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


# 8


def test_knapsack_against_brute_force():
    r = random.Random(4)
    for _ in range(200):
        lengths = np.array(sorted(r.sample(range(1, 30), r.randrange(1, 5))))
        counts = np.array([r.randrange(4) for _ in lengths])
        budget = r.randrange(0, 120)
        sums = {sum(a * b for a, b in zip(x, lengths.tolist())) for x in itertools.product(*[range(k + 1) for k in counts])}
        take = mixing.fit(lengths, counts, budget)
        assert (take <= counts).all() and (take * lengths).sum() == max(s for s in sums if s <= budget)


def test_targets():
    got = mixing.targets([10, 1000, 100])
    assert got[0] == 20 and got[2] == 200 and abs(sum(got) - 1.5 * 1110) < 1e-9 and mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]


def test_targets_of_many_sources(spark):
    r = random.Random(12)
    for n in (1, 2, 7, 500):
        sizes = [r.choice((0, 1, r.randrange(100), r.randrange(100_000))) for _ in range(n)]
        names = sorted({"".join(r.choice("aB\u00e9\U0001f600z ") for _ in range(9)) + str(i) for i in range(n)}, key=lambda x: x.encode())
        if n > 2:
            names[-1] = None
        rows = [(s, 1, k) for s, k in zip(names, sizes, strict=True)]
        got = mixing.source_plan(spark.createDataFrame(r.sample(rows, n), "_source string, _size long, _n long"), c.Scratch(spark)).orderBy("_sid").collect()
        want = mixing.targets(sizes)
        assert [x["_source"] for x in got] == names and all(abs(x["_target"] - w) < 1e-6 * max(1, w) for x, w in zip(got, want, strict=True))
        assert all(x["_passes"] == (int(x["_target"] // k) if k else 0) and abs(x["_passes"] * k + x["_rest"] - x["_target"]) <= 0.5 for x, k in zip(got, sizes, strict=True))


def test_mixing(spark, docs, empty):
    hot = [(5000 + i, "a b c d e f g", "en", "s9", 1) for i in range(3000)]
    df = docs.unionByName(spark.createDataFrame(hot, SCHEMA))
    mixed = mixing.mix(clashing(df))
    assert {tuple(r) for r in mixed.select("row._sid", "row.size", "row._taken").distinct().collect()} == {("x", "x", "x")}
    rows = mixed.select("row.text", "row.source", *(F.col(n).alias(f"_{n}") for n in ("size", "source_size", "target", "taken"))).collect()
    assert len(rows) == df.count()
    by = collections.defaultdict(list)
    for r in rows:
        assert r["_size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and 0 <= r["_taken"] <= 2 * r["_size"]
        by[r["source"]].append(r)
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    want = mixing.targets([sum(r["_size"] for r in by[s]) for s in names])
    for s, w in zip(names, want, strict=True):
        assert all(abs(r["_target"] - w) < 1e-6 for r in by[s])
        assert abs(sum(r["_taken"] for r in by[s]) - w) <= max(180, 0.02 * w, max(r["_size"] for r in by[s]))  # repeated rows share one decision; a text is taken whole
    told = lambda x: sorted(str(tuple(r)) for r in x.select("row.doc_id", "row.source", "taken").collect())
    assert told(mixing.mix(df.repartition(13))) == told(mixed)
    assert mixing.mix(empty).count() == 0


# 9


def test_language_model(spark, docs, empty):
    df = docs.unionByName(spark.createDataFrame([(4000 + i, prose(i % 7, 30), "en", "s", 1) for i in range(30)], SCHEMA))
    scratch = c.Scratch(spark)
    rows = df.collect()
    tokens = [[*((r["text"] or "").encode().translate(c.LOWER_TABLE).split()), b"\n"] for r in rows]
    held = [r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in rows]
    counts = collections.Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    both = collections.Counter(p for t, h in zip(tokens, held, strict=True) if not h for p in zip([b"\n", *t], t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r["doc_id"]), h, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for r, t, h in zip(rows, tokens, held, strict=True))
    low = lambda k: math.ceil(1.5 ** (int(math.log(k, 1.5) + 1e-9)) - 1e-9) if k else 0
    level = lambda k: 1 + int(math.log(k, 1.5) + 1e-9) if k else 0
    high = lambda k: max(low(k), math.ceil(1.5 ** level(k) - 1e-9) - 1) if k else 0
    seen = []
    for hot, most in ((language_model.HOT_WORDS, language_model.BROADCAST_BYTES), (50, 0)):
        before, language_model.HOT_WORDS = language_model.HOT_WORDS, hot
        model, rare = language_model.train(clashing(df), ~language_model.held_out(F.col("doc_id")), scratch, most, bits_per_entry=512)
        got = language_model.score(clashing(df), model, rare, scratch).collect()
        language_model.HOT_WORDS = before
        assert (model["filter"] is None) == (most == 0)
        assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        scores = []  # by exact counts, quantised: so many bits that no lookup is mistaken
        for r, t in zip(rows, tokens, strict=True):
            total = 0.0
            for a, b in zip([b"\n", *t], t):
                w = model["weights"][level(counts[a])]
                pair, word = min(1.0, low(both[a, b]) / max(high(counts[a]), 1)), min(1.0, (low(counts[b]) + 0.1) / (n + 0.1 * (v + 1)))
                total += math.log10(w * pair + (1 - w) * word)
            scores.append((str(r["doc_id"]), round(total, 4)))
        assert sorted((str(r["doc_id"]), round(r["score"], 4)) for r in got) == sorted(scores)
        seen.append(scores)
    assert rare.count() > 0 and seen[0] == seen[1]
    for most in (1 << 20, -1):
        nothing, rare = language_model.train(empty, ~language_model.held_out(F.col("doc_id")), scratch, most)
        assert language_model.score(empty, nothing, rare, scratch).count() == 0
        assert all(r["base_score"] == 0 and r["n_known"] == 0 for r in language_model.score(docs, nothing, rare, scratch).collect())


def test_language_model_fits_all_training_tokens(spark):
    texts = [prose(i, 5 + i % 40) if i % 3 else " ".join(f"w{i * k % 50}" for k in range(1, 30)) for i in range(900)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    keep, scratch = ~language_model.held_out(F.col("doc_id")), c.Scratch(spark)
    learnt = [[b"\n", *t.encode().translate(c.LOWER_TABLE).split(), b"\n"] for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    assert len(learnt) > 700
    counts = collections.Counter(w for t in learnt for w in t[1:])
    both = collections.Counter(p for t in learnt for p in zip(t, t[1:]))
    counted = list(both.items())
    levels = language_model.level_of(np.array([[counts[a], n, counts[b]] for (a, b), n in counted], float)).T
    m = {"tokens": sum(counts.values()), "words": len(counts)}
    tokens = np.repeat(np.arange(len(counted)), [n for _, n in counted])  # one by one
    pair, word = language_model._estimates(m, levels[:, tokens], 1)
    want, first = np.full(language_model.MAX_LEVEL + 1, 0.1), levels[0, tokens]
    for _ in range(30):
        share = want[first] * pair / (want[first] * pair + (1 - want[first]) * word)
        for k in range(len(want)):
            want[k] = min(0.999, max(1e-6, (share[first == k].sum() + 0.1) / ((first == k).sum() + 1)))
    for most in (1 << 30, 0):
        model, rare = language_model.train(df, keep, scratch, most, bits_per_entry=512)
        assert np.allclose(model["weights"], want, rtol=1e-9)
        plain = sorted(map(tuple, language_model.score(df, model, rare, scratch).collect()))
        at_once = sorted(map(tuple, language_model.train_and_score(df, keep, scratch, most, bits_per_entry=512).collect()))
        assert len(plain) == 900 and np.allclose(np.array(plain, float), np.array(at_once, float), rtol=1e-12)


def test_language_model_does_not_depend_on_the_cluster(spark):
    got, kept = [], spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("4", "8", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append({r["doc_id"]: round(r["score"], 8) for r in registry.queries()["op9_lm_score"](spark, SF).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert got[0] == got[1] == got[2]


def test_filter_never_counts_too_low():
    g = np.random.default_rng(1)
    keys, counts = g.integers(0, 1 << 63, 5000, dtype=np.uint64) << np.uint64(1), g.integers(1, 3000, 5000).astype(np.uint64)
    top = language_model.shard_of(keys, 4)
    parts = []
    for s in range(4):
        data, bits = language_model.segment(keys[top == s], counts[top == s])
        parts.append((s, bits, data.tobytes()))
    levels, want = language_model.Filter(4, parts).level(keys), language_model.level_of(counts.astype(float))
    assert (levels >= want).all() and (levels == want).mean() > 0.9
    other = language_model.Filter(4, parts).level(g.integers(0, 1 << 63, 5000, dtype=np.uint64))
    assert (other > 0).mean() < 0.1
    assert (language_model.unpack(language_model.pack(keys), len(keys)) == keys).all()


# 10


def test_token_counts(spark, docs, empty):
    pieces = set(token_count.read_vocabulary()) | {bytes([b]) for b in range(256)}
    longest = max(map(len, pieces))

    def greedy(word):
        n = i = 0
        while i < len(word):
            i += next(k for k in range(min(longest, len(word) - i), 0, -1) if word[i : i + k] in pieces)
            n += 1
        return n

    rows = {(r["doc_id"], r["n_bytes"], r["n_words"], r["n_tokens"]) for r in token_count.count_tokens(spark, clashing(docs)).collect()}
    want = set()
    for d, t, *_ in hostile():
        words = (t or "").encode().split()
        want.add((d, len((t or "").encode()), len(words), sum(greedy(b" " + w) for w in words)))
    assert rows == want and token_count.count_tokens(spark, empty).count() == 0
    a, r = token_count.Automaton([b"ab", b"abcd", b"bc", b"cde", b"xx"]), random.Random(2)
    small = {b"ab", b"abcd", b"bc", b"cde", b"xx"} | {bytes([b]) for b in range(256)}
    for _ in range(3000):
        word, n, i = bytes(r.choice(b"abcdex") for _ in range(r.randrange(30))), 0, 0
        while i < len(word):
            i += next(k for k in range(4, 0, -1) if word[i : i + k] in small)
            n += 1
        assert a.count(word) == n


# all


CONTRACTS = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op5_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op6_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op7_vector_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op8_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op9_lm_score": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
}


def test_contracts(spark):
    for name, want in CONTRACTS.items():
        got = {f.name: f.dataType.simpleString() for f in registry.queries()[name](spark, SF).schema}
        assert {k: got.get(k) for k in want} == want, name


def test_oracles(spark):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    for name, sql in registry.oracle_sql().items():
        got = registry.queries()[name](spark, SF)
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns)
        order = lambda x: str(x)
        assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted((str(tuple(r)) for r in want.fetchall()), key=order), name


def shingles(words, k=5):
    k = min(k, len(words))
    return collections.Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else collections.Counter()


def one_of_each_class(rows):
    """Rows (doc_id, text) without near duplicates, by all pairs: the larger of two weighted similarities, components, least doc_id."""
    sets = [(d, t, shingles(c.plain_words((t or "").encode()))) for d, t in rows]
    n, df = sum(1 for x in sets if x[2]), collections.Counter()
    for *_, x in sets:
        df.update(x.keys())
    idf = {k: 1 + math.log1p(n / v) / math.log1p(n) for k, v in df.items()}
    plain = [{k: 1 + math.log(v) for k, v in x.items()} for *_, x in sets]
    rare = [{k: v * idf[k] for k, v in x.items()} for x in plain]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        if plain[i] and plain[j] and sets[i][0] is not None and sets[j][0] is not None and not plain[i].keys().isdisjoint(plain[j].keys()):
            if max(jaccard(x[i], x[j]) for x in (plain, rare)) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    best = {}
    for i, (d, _, x) in enumerate(sets):
        if x and d is not None:
            best[root(i)] = min(best.get(root(i), (d, i)), (d, i))
    return [r for i, (r, (d, _, x)) in enumerate(zip(rows, sets, strict=True)) if not x or d is None or best[root(i)][1] == i]


def test_pipeline_against_plain_python(spark):
    """Each stage against a chain of plain Python, over whole tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    labels = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic IS NOT NULL").collect():
        labels[r["doc_id"]] = max(r["toxic"], labels.get(r["doc_id"], 0))
    scratch, before = c.Scratch(spark), docs
    order = [r["doc_id"] for r in docs.orderBy(F.xxhash64("doc_id", F.lit("order")), "doc_id").select("doc_id").collect() if r["doc_id"] in labels]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    slots = {}
    for d, t in rows:  # every feature by itself
        h = [c.xxhash.xxh64_intdigest(w) for w in c.plain_words((t or "").encode())]
        h, found = np.array(h, np.uint64), set()
        for k in range(len(h)):
            found.add(int(c.mix(h[k : k + 1])[0] >> c.U64(64 - toxicity.BITS)))
            for gap in (1, 2, 3):
                if k + gap < len(h):
                    found.add(int(c.mix(h[k : k + 1] * c.U64(0x9E3779B97F4A7C15) + h[k + gap : k + gap + 1] + c.U64(gap))[0] >> c.U64(64 - toxicity.BITS)))
        slots[d] = np.array(sorted(found), np.int64)
    model, rng = toxicity.Ftrl(), np.random.default_rng(toxicity.SEED)
    for _ in range(toxicity.EPOCHS):
        for k in rng.permutation(len(order)):
            model.learn(slots[order[k]], labels[order[k]])
    rows = [(d, t) for d, t in rows if float(model.weights(model.z[slots[d]], model.n[slots[d]]).sum()) + model.bias < 0]
    for name, stage in corpus_pipeline.STAGES:
        after = scratch.save(stage(spark, before, SF), name)
        assert after.columns == (docs.columns if name != "mixing" else [*docs.columns, "copies"])
        got = sorted((r["doc_id"], r["text"]) for r in after.collect())
        if name == "line_dedup":
            keys = {(r["doc_id"], r["text"] or ""): (r["a"], r["b"]) for r in before.select("doc_id", "text", *(k.alias(n) for k, n in zip(line_dedup.doc_key(F.col("doc_id"), F.col("text")), "ab"))).collect()}
            key = lambda x: x.strip(c.BLANK).translate(str.maketrans(c.UPPER, c.LOWER))
            held, first = collections.Counter(k for d in set(rows) for k in {key(x) for x in (d[1] or "").split("\n")} if k), {}
            for d, t in rows:
                for i, x in enumerate((t or "").split("\n")):
                    at = (*keys[d, t or ""], i)
                    first[key(x)] = min(first.get(key(x), at), at)
            kept = lambda d, t: [x for i, x in enumerate((t or "").split("\n")) if held[key(x)] < 10 or (*keys[d, t or ""], i) == first[key(x)]]
            rows = [(d, t if len(kept(d, t)) == len((t or "").split("\n")) else "\n".join(kept(d, t))) for d, t in rows]
        elif name == "near_dedup":
            rows = one_of_each_class(sorted(rows))
        elif name == "decontamination":
            items = [x for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (x := c.plain_words((r["text"] or "").encode()))]
            sets = [(min(5, len(x)), set(shingles(x))) for x in items]
            holds = lambda t: any(len(x & set(shingles(c.plain_words((t or "").encode()), k))) >= 0.8 * len(x) for k, x in sets)
            rows = [(d, t) for d, t in rows if not holds(t)]
        elif name == "mixing":
            size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            source = {r["doc_id"]: r["source"] for r in before.collect()}
            names = sorted({s for s in source.values()}, key=lambda s: (s is None, (s or "").encode()))
            sums = [sum(size(t) for d, t in rows if source[d] == s) for s in names]
            taken = {s: sum(size(r["text"]) * r["copies"] for r in after.collect() if r["source"] == s) for s in names}
            for s, total, t in zip(names, sums, mixing.targets(sums), strict=True):
                passes, reached = int(t // total) if total else 0, 1
                for d, x in rows:
                    reached |= reached << size(x) if source[d] == s else 0
                best = (reached & ((1 << (round(t - passes * total) + 1)) - 1)).bit_length() - 1  # the largest subset sum up to what is left
                assert taken[s] == passes * total + best
            assert {r["copies"] for r in after.collect()} <= {1, 2}
            assert set(got) <= set(rows)
            break
        assert got == sorted(rows), name
        before = after
    assert sorted(map(str, after.collect())) == sorted(map(str, corpus_pipeline.run(spark, SF).collect()))


def test_pipeline_stages_on_hostile_rows(spark, docs, empty):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clashing(docs).drop("n"), SF)
        assert [x for x in out.columns if x != "copies"] == clashing(docs).drop("n").columns and out.count() <= docs.count()
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_keeps_one_of_many_copies(spark, docs):
    text = "\n".join(prose(70_000 + i, 30) for i in range(6))
    copies = spark.createDataFrame([(8000 + i, text, "en", "s1", len(text)) for i in range(25)], SCHEMA)
    lines = corpus_pipeline.drop_common_lines(spark, docs.unionByName(copies), SF)
    kept = corpus_pipeline.drop_near_duplicates(spark, lines, SF).where("doc_id >= 8000 AND text <> ''").collect()
    assert [(r["text"], r["n_chars"]) for r in kept] == [(text, len(text))]


def test_digest():
    assert pii.digest("") == hashlib.sha256(b"").hexdigest()
