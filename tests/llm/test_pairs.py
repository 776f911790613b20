"""Near-duplicate text and vectors, components and decontamination against brute force."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from xrefloom.llm import decontaminate, embeddings, ngram_join
from xrefloom.llm.common import components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("links", [[], [(1, 2)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 300)], [(5, 5), (7, 6), (6, 7)], [(k, k + 7) for k in range(0, 200, 3)]])
def test_components(spark, links):
    df = spark.createDataFrame([*links, (None, 3)], "x long, y long")
    got = {r.id: r.component_id for r in components(df, "x", "y").collect()}
    want = roots({i for e in links for i in e}, links)
    assert {i: c for i, c in got.items() if i != 5 or (5, 5) not in links} == {i: c for i, c in want.items() if i != 5 or (5, 5) not in links}


def shingle_sets(rows, n=5):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def near_copies(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=4))
    common = [word() for _ in range(40)]
    rows, i = [], 0
    for g in range(14):
        base = [word() for _ in range(r.choice([3, 6, 30, 60, 120]))]
        for _ in range(r.choice([1, 2, 5, 12])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                t[r.randrange(len(t))] = word()
            rows.append((i, " ".join(t)))
            i += 1
        if g % 3 == 0:
            rows.append((i, " ".join(common + base[:10])))
            i += 1
    return [*rows, (900, None), (901, ""), (902, "Hello world"), (903, "hello   WORLD"), (904, "hello"), (905, "a " * 30000), (906, "A " * 29000), (907, rows[3][1].upper())]


@pytest.mark.parametrize("block", [4096, 3])
def test_ngram_classes_equal_brute_force(spark, block):
    rows = near_copies()
    sets = shingle_sets(rows)
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(links) > 20
    want = roots(sets, links)
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, rep string, n_shingles int")
    got = {r.doc_id: r for r in ngram_join.classes(docs, block=block, sketch_bits=12).collect()}
    assert {i: (g.n_shingles, g.component_id) for i, g in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}


def test_ngram_join_edges(spark):
    schema = "doc_id long, text string"
    assert ngram_join.classes(spark.createDataFrame([], schema), sketch_bits=10).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, None)]
    out = ngram_join.classes(spark.createDataFrame(rows, schema), sketch_bits=10).collect()
    assert len(out) == 5 and all(r.component_id == 1 for r in out if r.doc_id in (1, 2))


def test_each_set_of_a_repeated_id_links(spark):
    word = lambda k: [f"w{k}x{i}" for i in range(60)]
    a, b, c = word(1), word(2), word(3)
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join([*b, "end"])), (8, " ".join([*a, "end"])), (9, " ".join(c)), (3, " ".join(c)), (3, " ".join(a)), (11, " ".join(word(4)))]
    for order in (rows, rows[::-1]):
        got = {(r.doc_id, r.component_id) for r in ngram_join.classes(spark.createDataFrame(order, "doc_id long, text string"), sketch_bits=12).collect()}
        assert got == {(5, 3), (7, 3), (8, 3), (9, 3), (3, 3), (11, 11)}


def test_verified_once(spark):
    docs = spark.createDataFrame(near_copies(5), "doc_id long, text string")
    _, links = ngram_join.join(docs, sketch_bits=12)
    pairs = [(r.x, r.y) for r in links.collect()]
    assert len(pairs) == len(set(pairs)) and all(x < y for x, y in pairs)


def vectors(n=900, dim=64, seed=2):
    r = np.random.Generator(np.random.PCG64(seed))
    base = r.normal(size=(n // 6, dim))
    rows = []
    for i in range(n):
        # near pairs of all strengths around the threshold
        v = base[i % len(base)] + r.normal(size=dim) * r.choice([0.05, 0.15, 0.2, 0.26, 0.3])
        rows.append((i, [float(x) for x in v], int(i % 3)))
    return rows


def test_embeddings_recall_and_precision(spark):
    rows = vectors()
    odd = [(2000, None, 1), (2001, [0.0] * 64, 1), (2002, [float("nan")] * 64, 1), (2003, [None] + [1.0] * 63, 1), (2004, rows[4][1], None), (2005, rows[5][1], 2), (2006, [1.0, 2.0], 1), (2007, [x * 1e200 for x in rows[7][1]], 1)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.classes(df.withColumn("rep", df.vec_id).withColumn("code", df.label)).collect()}
    assert len(got) == len(rows) + len(odd)
    use = [(i, np.array(v) / np.linalg.norm(v), label) for i, v, label in [*rows, odd[5], odd[7]]]
    want = dict.fromkeys(got, 0)
    for (a, x, la), (b, y, lb) in itertools.combinations(use, 2):
        if la == lb and x @ y >= 0.93:
            want[a] += 1
            want[b] += 1
    assert all(g.n_links <= want[i] for i, g in got.items())
    assert sum(g.n_links for g in got.values()) >= 0.9 * sum(want.values()) > 500
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (2000, 2001, 2002, 2003, 2004, 2006))
    assert got[2005].n_links >= 1 and got[2005].component_id <= 5
    assert embeddings.classes(df.limit(0)).count() == 0


def largest_broadcast(spark, after):
    """Bytes, among the executions numbered above `after`; and the last number."""
    as_list, store = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava, spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ids, most = [e.executionId() for e in as_list(store.executionsList())], 0
    for i in ids:
        if i > after:
            values = dict(as_list(store.executionMetrics(i)))
            for node in as_list(store.planGraph(i).allNodes()):
                for m in as_list(node.metrics()) if node.name().startswith("BroadcastExchange") else []:
                    if m.name() == "data size" and (text := values.get(m.accumulatorId())):
                        number, unit = text.split()
                        most = max(most, float(number.replace(",", "")) * 1024 ** ["B", "KiB", "MiB", "GiB"].index(unit))
    return most, max([after, *ids])


def test_exploded_codes_are_not_broadcast(spark):
    rows = vectors(3000)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert df.select("vec_id").join(F.broadcast(df), "vec_id").count() == 3000
    seen, last = largest_broadcast(spark, -1)
    assert seen > 1_000_000  # broadcasts can be seen
    assert sum(r.n_links for r in embeddings.classes(df).collect()) > 500
    assert largest_broadcast(spark, last)[0] < 4_000_000  # 68 rows of each vector are 40 MiB


def test_candidates_equal_brute_force(spark):
    r = random.Random(8)
    rows = []
    for label, dim in (("a", 64), ("b", 64), ("a", 20), ("a", 9)):
        base = [r.getrandbits(min(dim, 64)) for _ in range(8)]
        for _ in range(90):
            code = r.choice(base)
            for _ in range(r.choice([0, 1, 2, 6, 12, 20])):
                code ^= 1 << r.randrange(min(dim, 64))
            rows.append((1000 - len(rows), label, dim, int(np.uint64(code).view(np.int64))))
    got = [(p.x, p.y) for p in embeddings.candidates(spark.createDataFrame(rows, "rep long, label string, dim int, code long"), 18).collect()]
    want = set()
    for a, b in itertools.combinations(rows, 2):
        d = (a[3] ^ b[3]) & (1 << 64) - 1
        if a[1:3] == b[1:3] and d.bit_count() <= 18 and any((d >> 16 * t & 0xFFFF).bit_count() <= 1 for t in range(4) if 16 * t < a[2]):
            want.add((min(a[0], b[0]), max(a[0], b[0])))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 2000


def test_rotation_balances_codes():
    x = np.random.Generator(np.random.PCG64(0)).normal(size=(3000, 32)) * np.linspace(3, 0.2, 32)
    m = embeddings.learn(x)
    assert np.allclose(m["project"].T @ m["project"], np.eye(32), atol=1e-8)
    codes = embeddings.encode(x, m).view(np.uint64)
    ones = np.array([(codes >> np.uint64(k) & np.uint64(1)).mean() for k in range(32)])
    assert (abs(ones - 0.5) < 0.15).all()


def test_wand_equals_full_scores():
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [" ".join(r.choices(vocabulary, weights=range(1, 61), k=r.randint(3, 25))) for _ in range(90)]
    index = decontaminate.Index(list(range(90)), items, 0.5)
    for _ in range(150):
        terms = sorted(r.sample(range(len(index.terms)), r.randint(1, 40)))
        full = np.zeros(index.n)
        for t in terms:
            full[index.items[t]] += index.impacts[t]
        want = {k for k in range(index.n) if full[k] >= index.least[k] - 1e-9}
        found = index.search(terms)
        assert {k for k, _ in found} == want and all(abs(s - full[k]) < 1e-9 for k, s in found)


def test_bulk_dismissal_loses_nothing():
    r = random.Random(9)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [" ".join(r.choices(vocabulary, weights=[300 / (k + 1) for k in range(300)], k=r.randint(8, 30))) for _ in range(60)]
    texts = [" ".join(r.choices(vocabulary, k=r.randint(0, 200)) + (items[k % 60].split()[: r.randint(4, 30)] if k % 2 else [])) for k in range(80)]
    index = decontaminate.Index(list(range(60)), items, 0.6)
    part = pa.RecordBatch.from_pydict({"text": texts})
    got = set(decontaminate._query(part, index, 0.5))
    want = set()
    half = max(16, index.longest)
    for d, t in enumerate(texts):
        h = decontaminate.tv.words(pa.array([t])).hash
        for a in range(0, max(1, -(-len(h) // half) - 1) * half, half):
            own = h[a : a + 2 * half]
            at = np.flatnonzero(np.isin(index.terms, own))
            full = np.zeros(index.n)
            for k in at:
                full[index.items[k]] += index.impacts[k]
            for k in np.flatnonzero(full >= index.least - 1e-9):
                q, x = index.parts[k]
                if all(np.isin(decontaminate._shingles(p, n), decontaminate._shingles(own, min(n, len(p)))).mean() >= 0.5 for p, n in ((q, 3), (x, 2))):
                    want.add((d, int(k)))
    assert got == want and len(want) > 5


def test_decontamination_of_tables(spark):
    items = spark.createDataFrame([(1, "Which planet is the largest of all? It is Jupiter, by far."), (2, None), (None, "no id here at all"), (3, ""), (4, "two words")], "item_id long, text string")
    filler = "lorem ipsum dolor sit amet consectetur " * 40
    docs = spark.createDataFrame([(1, filler + "which planet is the largest of all it is jupiter by far " + filler), (2, filler), (3, None), (4, ""), (None, "Which planet is the largest of all? It is Jupiter, by far."), (5, "which planet is the largest of all " + filler), (6, "x " * 50000)], "doc_id long, text string").selectExpr("*", "'y' as item_id", "1 as bm25")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()}
    assert got == {(1, 1), (None, 1)}
    clean = decontaminate.clean(docs, items, shard_items=1)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {2, 3, 4, 5, 6}
    assert decontaminate.matches(docs, items.limit(0)).count() == 0 and decontaminate.matches(docs.limit(0), items).count() == 0


def test_shards_change_nothing(spark):
    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [" ".join(r.choices(vocabulary, weights=[400 / (k + 1) for k in range(400)], k=r.randint(8, 40))) for _ in range(50)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = [(k, " ".join([*r.choices(vocabulary, k=r.randint(0, 150)), *texts[k % 50].split()[: r.randint(4, 40)], *r.choices(vocabulary, k=30)])) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole, parts = (sorted(map(tuple, decontaminate.matches(docs, items, shard_items=n).collect())) for n in (20_000, 7))
    assert len(whole) > 20 and [x[:2] for x in whole] == [x[:2] for x in parts]
    assert np.allclose([x[2:] for x in whole], [x[2:] for x in parts])


def test_embeddings_of_all_lengths_link(spark):
    rng = np.random.default_rng(11)
    rows, n = [], 0
    for dim in (64, 64, 32, 8, 20, 100):
        for _ in range(20):
            v = rng.normal(size=dim)
            rows += [(n, "a", v.tolist()), (n + 1, "a", (v * 1.01 + 1e-4).tolist())]
            n += 2
    rows += [(1000, "a", [1.0] * 5), (1001, "a", [1.0] * 6)]  # alone in their lengths
    got = {r.vec_id: r.component_id for r in embeddings.classes(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()}
    assert len(got) == n + 2 and all(got[k] == got[k + 1] for k in range(0, n, 2)) and got[1001] == 1001


@pytest.mark.parametrize("most", [16, 28])
def test_id_bits_miss_no_id(spark, most):
    ids = spark.range(0, 60000, 7).withColumnRenamed("id", "doc_id")
    bits, log_size = ngram_join.id_bits(ids, most=most)
    assert len(bits) == 1 << log_size >> 3 and log_size <= most
    places = [r[0] for r in ids.select(ngram_join._place("doc_id", log_size)).collect()]
    assert all(bits[p >> 3] >> (7 - (p & 7)) & 1 for p in places)
    assert np.unpackbits(bits).sum() == len(set(places))
    assert not ngram_join.id_bits(ids.limit(0))[0].any()
