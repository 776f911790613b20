"""Toxicity, language, language model, token counts and license scan against brute force."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from xrefloom.llm import language, licenses, lm, textvec, token_counts, toxicity

SPACE = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "É déjà"), (6, "1234 !!"), (None, "a b"), (8, "word " * 40000), (9, "same text here"), (9, "same text here"), (10, "x" * 300000)]


def edge(spark, rows=EDGE):
    return spark.createDataFrame([(i, t, "clash", 0.5, 1, True) for i, t in rows], "doc_id long, text string, label string, score double, n_words int, held_out boolean")


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t.1", max_size=40)), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_equal_regex(texts):
    w = textvec.words(pa.array(texts, pa.string()), spans=True)
    want = [x for t in texts for x in re.findall(SPACE, (t or "").translate(LOWER))]
    assert w.counts.tolist() == [len(re.findall(SPACE, t or "")) for t in texts]
    seen = {}
    for h, x in zip(w.hash.tolist(), want, strict=True):
        assert seen.setdefault(h, x) == x
    assert len(seen) == len(set(want))
    h, d = textvec.ngrams(w, 2)
    assert len(h) == sum(max(0, n - 1) for n in w.counts.tolist())


def test_toxicity_learns_and_handles_edges(spark):
    r = random.Random(1)
    vocabulary = ["".join(r.choices("abcdefg", k=5)) for _ in range(400)]
    rows = [(" ".join(r.choices(vocabulary, k=30) + (["vile"] if k % 4 == 0 else [])), int(k % 4 == 0)) for k in range(1200)]
    train = spark.createDataFrame([*rows, (None, 1), ("x", None)], "text string, y int")
    model = toxicity.fit(train, bits=16)
    assert 0 < len(model["i"]) < 1 << 14
    scored = {i: s for i, s in toxicity.score(edge(spark, [(1, "some vile words"), (2, "some words"), *EDGE]), model).collect() if i in (1, 2)}
    assert scored is not None
    out = toxicity.score(edge(spark, [(101, "kind vile word"), (102, "kind word"), *EDGE]), model).collect()
    by = {x.doc_id: x.score for x in out}
    assert len(out) == len(EDGE) + 2 and by[101] >= 0.5 > by[102] and all(0 <= x.score <= 1 for x in out)
    assert by[1] == by[2] == by[3]
    empty = toxicity.fit(train.limit(0), bits=12)
    assert [x.score for x in toxicity.score(edge(spark, [(1, "a")]), empty).collect()] == [0.5]
    assert toxicity.score(edge(spark, []), model).count() == 0


def test_toxicity_sample_holds_each_text_once(spark, monkeypatch):
    rows = [(f"common {k}", k % 2) for k in range(3) for _ in range(400)] + [(f"text {k} awful", 1) for k in range(20)]
    told = []
    monkeypatch.setattr(toxicity, "calibrate", lambda scores, y, copies: told.append((len(scores), sorted(copies))) or (1.0, 0.0))
    toxicity.fit(spark.createDataFrame(rows, "text string, y int"))
    assert told == [(23, [1] * 20 + [400] * 3)]


def test_toxicity_equals_plain_ftrl(spark):
    r = random.Random(2)
    vocabulary = ["".join(r.choices("abcdefg", k=4)) for _ in range(150)]
    rows = [(" ".join(r.choices(vocabulary, k=12) + (["vile"] if k % 3 == 0 else [])), int(k % 3 == 0)) for k in range(150)]
    rows += rows[:20] + [("", 0), ("", 1)]
    bits, options = 12, {"alpha": 0.8, "beta": 1.0, "l1": 0.4, "l2": 0.02}
    train = spark.createDataFrame(rows, "text string, y int")
    model = toxicity.fit(train, bits=bits, shards=1, epochs=2, **options)
    # the same with dictionaries: one text at a time, in the order of its hash, then shuffled as the operator does
    order = [x.text for x in train.selectExpr("text", "xxhash64(text) h").distinct().orderBy("h", "text").collect()]
    y = {t: [b for a, b in rows if a == t] for t in order}

    def feats(t):
        w = textvec.words(pa.array([t]), ~textvec.ALNUM)
        h = [int(x) for kind in (w.hash, textvec.ngrams(w, 2, salt=1)[0], textvec.ngrams(w, 2, gaps=(0, 2), salt=2)[0]) for x in kind]
        return sorted({x >> 64 - bits for x in h})

    z, n, shuffle = collections.Counter(), collections.Counter(), np.random.Generator(np.random.PCG64(7))

    def weight(i):
        l1 = 0.0 if i == "bias" else options["l1"]
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i]) if l1 else z[i]) / ((options["beta"] + math.sqrt(n[i])) / options["alpha"] + options["l2"])

    raw = lambda t: sum(weight(i) for i in [*feats(t), "bias"])
    for _ in range(2):
        for k in shuffle.permutation(len(order)):
            t = order[k]
            g = len(y[t]) * (1 / (1 + math.exp(-raw(t))) - sum(y[t]) / len(y[t]))
            step = {i: weight(i) for i in [*feats(t), "bias"]}
            for i, w in step.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / options["alpha"] * w
                n[i] += g * g
    scores = np.array([1 / (1 + math.exp(-raw(t))) for t in order])
    a, b = toxicity.calibrate(scores, np.array([sum(y[t]) / len(y[t]) for t in order]), np.array([len(y[t]) for t in order]))
    texts = [*order, "vile", "unknown words here", None, EDGE[7][1]]
    got = {x.doc_id: x.score for x in toxicity.score(edge(spark, list(enumerate(texts))), model).collect()}
    for k, t in enumerate(texts):
        assert abs(got[k] - 1 / (1 + math.exp(-(a * raw(t or "") + b)))) < 1e-5


def test_ftrl_step_equals_formula():
    m = toxicity.Ftrl(4, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    z, n = np.zeros(17), np.zeros(17)
    r = random.Random(0)
    for _ in range(40):
        i = np.array(sorted(r.sample(range(16), 3)) + [16])
        y = r.randint(0, 1)
        m.learn(i, y)
        w = {}
        for k in i:
            l1 = 0 if k == 16 else 0.1
            w[k] = 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k]) if l1 else z[k]) / ((1 + math.sqrt(n[k])) / 0.5 + 0.2)
        p = 1 / (1 + math.exp(-sum(w.values())))
        for k in i:
            g = p - y
            sigma = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / 0.5
            z[k] += g - sigma * w[k]
            n[k] += g * g
    assert np.allclose(m.z, z) and np.allclose(m.n, n)


@pytest.fixture(scope="module")
def langs(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return d, language.fit(d.filter("doc_id % 2 = 0"))


def test_language_on_held_out(spark, langs):
    d, model = langs
    got = language.predict(d.filter("doc_id % 2 = 1 and length(text) > 100").select("doc_id", "text", "lang"), model, keep=("doc_id", "lang")).collect()
    assert sum(x.lang == x.lang_pred for x in got) >= 0.95 * len(got)
    assert all(0 <= x.score <= 1 for x in got)


def test_language_mixture_and_edges(spark, langs):
    d, model = langs
    by = {x.lang: x.text for x in d.filter("length(text) between 1500 and 6000").collect()}
    half = by["en"][:1500] + " " + by["de"][:1100]
    out = {x.doc_id: x for x in language.predict(edge(spark, [*EDGE, (50, half)]), model).collect()}
    assert out[50].n_langs == 2 and 0.4 < out[50].score < 0.8
    assert all(out[k].lang_pred == "und" and out[k].score == 0 for k in (1, 2, 3, 6))
    nothing = language.fit(d.limit(0))
    assert {x.lang_pred for x in language.predict(edge(spark), nothing).collect()} == {"und"}


def test_language_sets_do_not_hang_on_neighbours(monkeypatch):
    col = pa.array(["aa bb cc " * 20, "aa bb " * 20])
    model = {"langs": ["a", "b", "c"], "logp": np.log(np.full((3, 1 << 10), 1e-3, np.float32)), "bits": 10}
    for k, w in enumerate(("aa", "bb", "cc")):
        model["logp"][k, language.trigrams(pa.array([w]), 10)[0]] = np.log(0.2)
    plain = language._mixture

    def mixture(like, best, docs, n, mask, rounds):  # for the longer text, two languages are no better than one
        pi, seen = plain(like, best, docs, n, mask, rounds)
        return pi, np.where((mask.sum(1) == 2) & (np.bincount(docs, minlength=n) == 60), -1e9, seen)

    monkeypatch.setattr(language, "_mixture", mixture)
    together, alone = language.infer(col, model), language.infer(col[:1], model)
    assert [x[0] for x in together] == [x[0] for x in alone] and alone[2][0] == 3


def test_language_equals_plain_inference(spark, langs):
    d, model = langs
    rows = [(x.doc_id, x.text) for x in d.select("doc_id", "text").collect()]
    by = dict(rows)
    rows += [(7000, " ".join(by[i][:600] for i in list(by)[:4])), (7001, "a"), (7002, ""), (7003, None)]
    got = {x.doc_id: x for x in language.predict(edge(spark, rows), model).collect()}
    wrong = 0
    for i, t in rows:
        w = [x.lower() for x in re.findall(rb"[A-Za-z\x80-\xff]+", (t or "").encode())]
        like = []
        for x in w:
            cells = [int(((a << 16 | b << 8 | c) * 2654435769 & 0xFFFFFFFF) >> 32 - model["bits"]) for a, b, c in zip(b" " + x, x, x[1:] + b" ")]
            like.append([sum(float(model["logp"][k, c]) for c in cells) for k in range(len(model["langs"]))])
        if not w:
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        ll = np.array(like)
        p = np.exp(np.maximum(ll - ll.max(1, keepdims=True), -60))

        def em(langs_, p=p, ll=ll):
            pi = np.array([k in langs_ for k in range(p.shape[1])]) / len(langs_)
            for _ in range(5):
                g = p * pi
                pi = (g / np.maximum(g.sum(1, keepdims=True), 1e-30)).mean(0)
            return pi, np.log(np.maximum(p @ pi, 1e-30)).sum() + ll.max(1).sum()

        penalty = 0.5 * math.log(len(w))
        best = (ll.sum(0).max() - penalty, int(ll.sum(0).argmax()), 1.0, 1)
        ranked = np.argsort(-em(set(range(p.shape[1])))[0], kind="stable")
        for k in range(2, p.shape[1] + 1):
            pi, seen = em(set(ranked[:k].tolist()))
            if seen - k * penalty > best[0]:
                best = (seen - k * penalty, int(pi.argmax()), float(pi.max()), k)
        wrong += not (got[i].lang_pred == model["langs"][best[1]] and abs(got[i].score - best[2]) < 1e-3 and got[i].n_langs == best[3])
    assert wrong <= 0.01 * len(rows)  # likelihoods are kept in 32 bits, so near ties may differ


def test_many_languages(spark, monkeypatch):
    """150 tags, each with words of its own: parts of the model in files give what one table gives, whatever is held at once."""
    r = np.random.Generator(np.random.PCG64(5))
    words = [["".join(r.choice(list("abcdefghijklmnop"), 5)) for _ in range(12)] for _ in range(150)]
    say = lambda k, n: " ".join(r.choice(words[k], n))
    train = spark.createDataFrame([(f"l{k:03}", say(k, 30)) for k in range(150) for _ in range(3)] + [(None, "abc def")], "lang string, text string")
    monkeypatch.setattr(language, "_HELD", 5)
    one, parts = language.fit(train, resident=1000), language.fit(train, resident=40)
    assert len(parts["files"]) == 4 and "logp" not in parts and one["langs"] == parts["langs"] == [f"l{k:03}" for k in range(150)]
    assert np.array_equal(np.concatenate(list(language._tables(parts))), one["logp"])
    texts = [(k, say(k, 9)) for k in range(150)] + [(k + 200, say(k, 40) + " " + say((k * 7 + 1) % 150, 25)) for k in range(30)] + [(900, None), (901, ""), (902, "12 34"), (903, " ".join(say(k, 4) for k in range(150)))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got, same = ({x.doc_id: x for x in language.predict(docs, m).collect()} for m in (one, parts))
    assert got == same and all(got[k].lang_pred == f"l{k:03}" for k in range(150)) and {got[k].n_langs for k in range(200, 230)} == {2}
    assert {got[k].lang_pred for k in (900, 901, 902)} == {"und"}
    col = pa.array([t for _, t in texts[150:156]])
    whole = language.infer(col, one)
    for model, most in ((one, 150 * 7), (parts, 150 * 40)):
        assert all(np.allclose(a, b) for a, b in zip(language.infer(col, model, most=most), whole, strict=True))


def test_mixture_equals_plain_em():
    r = np.random.Generator(np.random.PCG64(0))
    like = r.random((40, 3)).astype(np.float32)
    docs = np.repeat([0, 1], [25, 15])
    pi, ll = language._mixture(like, np.zeros(2), docs, 2, np.ones((2, 3)), 6)
    for d in range(2):
        x, p = like[docs == d].astype(float), np.ones(3) / 3
        for _ in range(6):
            g = x * p
            p = (g / g.sum(1, keepdims=True)).mean(0)
        assert np.allclose(pi[d], p, atol=1e-5) and abs(ll[d] - np.log(x @ p).sum()) < 1e-3


def brute_base(train, texts):
    toks = lambda t: [*re.findall(SPACE, (t or "").translate(LOWER)), None]
    c = collections.Counter(x for t in train for x in toks(t))
    n, v = sum(c.values()), len(c)
    return n, [(len(toks(t)), sum(c[x] > 0 for x in toks(t)), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in toks(t))) for t in texts]


WAYS = [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "region_bytes": 1 << 14}]  # broadcast; in regions; in many more regions


@pytest.mark.parametrize("way", WAYS)
def test_lm_base_equals_brute_force(spark, way):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(edge(spark).select("doc_id", "text"))
    rows = [(x.doc_id, x.text) for x in d.collect()]
    train = d.filter("doc_id % 3 <> 0")
    model = lm.fit(train, **way)
    assert ("local" in model) == (not way)
    got = collections.defaultdict(list)
    for x in lm.score(d, model).collect():
        got[x.doc_id].append((x.n_tokens, x.n_known, x.base_score, x.train_tokens, x.score))
    n, want = brute_base([t for i, t in rows if i is not None and i % 3], [t for _, t in rows])
    for (i, _), w in zip(rows, want, strict=True):
        assert any(g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-6 * abs(w[2]) + 1e-9 and g[3] == n for g in got[i])
        assert all(g[4] < 0 and math.isfinite(g[4]) for g in got[i])


def plain_scores(train, texts, prior=50.0):
    """The model with dictionaries of exact counts, each read as its level's typical count, instead of a filter."""
    toks = lambda t: [*re.findall(SPACE, (t or "").translate(LOWER)), None]
    words, pairs = collections.Counter(), collections.Counter()
    for t in train:
        x = toks(t)
        words.update(x)
        pairs.update(zip([None, *x], x))
    read = lambda c: float(lm.typical(lm.level(np.array([c])))[0]) if c else 0.0
    total = sum(map(read, words.values())) + len(words) + 1
    one = lambda left, w: (min(read(pairs[left, w]), words[left]) + prior * (read(words[w]) + 1) / total) / (words[left] + prior)
    return [sum(math.log10(one(a, b)) for a, b in zip([None, *toks(t)], toks(t))) for t in texts], words, one


@pytest.mark.parametrize("way", WAYS)
def test_lm_scores_equal_those_of_exact_counts(spark, way):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(edge(spark).select("doc_id", "text"))
    rows = [(x.doc_id, x.text) for x in d.collect()]
    model = lm.fit(d.filter("doc_id % 3 <> 0"), member_bits=256, **way)  # so that the filter hardly errs
    got = collections.defaultdict(list)
    for x in lm.score(d, model).collect():
        got[x.doc_id].append(x.score)
    want, _, _ = plain_scores([t for i, t in rows if i is not None and i % 3], [t for _, t in rows])
    near = [min(abs(g - w) for g in got[i]) <= 1e-9 * abs(w) for (i, _), w in zip(rows, want, strict=True)]
    assert np.mean(near) > 0.97 and all(min(abs(g - w) for g in got[i]) <= 0.02 * abs(w) for (i, _), w in zip(rows, want, strict=True))


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(5)
    train = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, 40) % 50) for _ in range(60)]
    _, words, one = plain_scores(train, [])
    for left in [None, "w1", "w2", "w7"]:
        assert abs(sum(one(left, w) for w in [*words, "unknown"]) - 1) < 0.1


def test_lm_ways_agree(spark):
    rows = [(k, " ".join(f"w{x}" for x in np.random.default_rng(k).integers(0, 4000, 500))) for k in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.fit(d)
    regions = {k: v for k, v in model.items() if k != "local"}
    a, b = ({x.doc_id: x for x in lm.score(d, m).collect()} for m in (model, regions))
    assert len(a) == 40 and a == b
    many = lm.fit(d, region_bytes=1 << 12)
    assert many["bits"] > model["bits"] and (many["N"], many["V"], many["typical"]) == (model["N"], model["V"], model["typical"])


def test_lm_filter_tells_counts(spark):
    words = [f"w{k}" for k in range(200)]
    text = " ".join(w for k, w in enumerate(words) for _ in range(k + 1))
    model = lm.fit(spark.createDataFrame([(text,)], "text string"))
    known = lm.regions(model["local"])
    h = textvec.words(pa.array([" ".join(words)])).hash
    read = lambda h: np.array([known[int(x >> np.uint64(64 - model["bits"]))].levels(np.array([x]), lm.WORD)[0] for x in h])
    q, exact = read(h), lm.level(np.arange(1, 201))
    assert (q >= exact).all() and (q == exact).mean() > 0.97  # a Bloom filter only ever adds
    assert (read(h ^ np.uint64(12345)) == 0).mean() > 0.97


@given(st.lists(st.integers(0, 2**64 - 1), max_size=30))
@settings(max_examples=60, deadline=None)
def test_packing_is_a_round_trip(x):
    a = np.array(sorted(x), np.uint64)
    assert lm.unpack_sorted(lm.pack_sorted(a)).tolist() == a.tolist() and lm.unpack(lm.pack(a[::-1].copy())).tolist() == a[::-1].tolist()


def test_lm_knows_pairs_seen_once(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "b a"), (4, "a b " * 2)], "doc_id long, text string")
    out = {x.doc_id: x.score for x in lm.score(d, lm.fit(d.filter("doc_id < 3"))).collect()}
    n, v, prior = 6, 5, 50.0  # a, b, c, d and two ends
    p = lambda pair, left, one: math.log10((pair + prior * (one + 1) / (n + v + 1)) / (left + prior))
    assert abs(out[1] - (p(1, 2, 1) + p(1, 1, 1) + p(1, 1, 2))) < 1e-9  # all pairs seen once
    assert abs(out[3] - (p(0, 2, 1) + p(0, 1, 1) + p(0, 1, 2))) < 1e-9  # none seen


def test_lm_prefers_what_it_has_seen(spark):
    d = spark.createDataFrame([(1, "the cat sat on the mat " * 30), (2, "mat the on sat cat the " * 30)], "doc_id long, text string")
    model = lm.fit(d.filter("doc_id = 1"))
    out = {x.doc_id: x.score for x in lm.score(d, model).collect()}
    assert out[1] > out[2]
    empty = lm.fit(d.limit(0))
    assert [x.base_score for x in lm.score(d.limit(1), empty).collect()] == [0.0]


@given(st.lists(st.binary(min_size=1, max_size=9).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=12))
@settings(max_examples=80, deadline=None)
def test_trie_equals_plain_search(words):
    pieces = {bytes([b]): -5.0 - b / 100 for b in range(256)} | {b"ab": -6.0, b"abc": -6.5, b"ca": -7.25, b"bca": -6.75}
    ends = token_counts.suffixes(pieces)
    words = sorted(set(words))
    counts, scores = token_counts.forward(words, ends)
    for w, n, s in zip(words, counts, scores, strict=True):
        best = [(0.0, 0)] + [None] * len(w)
        for j in range(1, len(w) + 1):
            best[j] = max((best[i][0] + pieces[w[i:j]], best[i][1] - 1) for i in range(j) if w[i:j] in pieces)
        assert (s, -n) == best[-1]


def test_token_counts_of_texts(spark):
    ranks = token_counts.load_ranks("/opt/tokenizers/byte_bpe_50k.tiktoken")
    pieces = token_counts.log_probabilities(ranks)
    ends = token_counts.suffixes(pieces)
    out = token_counts.token_counts(edge(spark), ranks).collect()
    assert len(out) == len(EDGE)
    by = {x.doc_id: x for x in out}
    assert by[1].n_tokens == by[2].n_tokens == 0 and by[3].n_tokens == 4
    for i, t in [(4, "one"), (5, "É déjà"), (9, "same text here")]:
        pre = re.findall(rb"\x20?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]", t.encode())
        one = dict(zip(sorted(set(pre)), zip(*token_counts.forward(sorted(set(pre)), ends), strict=True), strict=True))
        assert by[i].n_tokens == sum(one[p][0] for p in pre) and abs(by[i].log_probability - sum(one[p][1] for p in pre)) < 1e-9 and by[i].n_pretokens == len(pre)


def test_licenses_equal_sql_and_own_labels(spark):
    extra = [(9020, "CC-BY cc by, all RIGHTS  reserved; GNU General Public License."), (9021, "Licensed under the Apache License, Version 2.0."), (9022, "licensed under an old apache license version 2 0"), (9023, "by cc all rightsé reserved general public"), (9024, "cc by " * 5000), (9025, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted: general\u212a public licen\u212ae"), (9026, "licensed under CC BY SA 4.0 licensed under"), (9026, "licensed under CC BY SA 4.0 licensed under")]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(edge(spark).select("doc_id", "text")).unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = sorted(map(repr, con.execute(licenses.duckdb_sql()).fetchall()))
    out = licenses.scan(docs).collect()
    assert sorted(repr((x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels, x.labels, x.score)) for x in out) == want
    by = {x.doc_id: x for x in out}
    assert by[9021].labels == "apache-2.0" and by[9022].labels == "apache-2.0" and 0.5 < by[9022].score < 1 and by[9023].labels == ""
    assert by[9025].labels == "isc" and by[9026].labels == "cc-by,cc-by-sa"
    assert by[9020].labels == "cc-by,gpl,reserved" and by[9020].score == 1 and by[9024].n_base == 5000
    assert licenses.scan(docs.limit(0)).count() == 0


def test_lm_counts_leave_no_shuffle_files(spark):
    """The blocks of counts are of no use once the store is written; texts cross an exchange packed."""
    from pathlib import Path

    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].toString())
    held = lambda: {p for p in local.rglob("shuffle_*.data")}
    d = spark.range(3000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(0, 50), i -> sha2(concat(id, ' ', i), 256))) as text")
    before = held()
    model = lm.fit(d, broadcast_bytes=0)
    made = sum(p.stat().st_size for p in held() - before if p.exists())
    assert made < 1 << 16 < spark.read.parquet(model["store"].inputFiles()[0]).selectExpr("sum(length(b))").first()[0]
    rows = lm._packed(7, d.limit(50).toArrow().to_batches())
    back = lm._unpacked(pa.Table.from_batches([rows]))
    assert back.to_pylist() == d.limit(50).toArrow().to_pylist() and rows.column("chunk").to_pylist() == [7]
