"""Near duplicates equal brute force over all pairs."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from compare import assert_same

from stocklens.llm import bagminhash, components, nn_descent, queries
from stocklens.session import landed


def runs(text):
    words = text.encode().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similar(a, b):
    both = sum((a | b).values())
    return sum((a & b).values()) / both if both else 0.0


def smallest_reachable(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def classes_of(texts):
    counted = {i: runs(t) for i, t in texts.items()}
    by_run = {}
    for i, c in counted.items():
        for run in c:
            by_run.setdefault(run, []).append(i)
    pairs = {(a, b) for group in by_run.values() for a in group for b in group if a < b}
    links = [(a, b) for a, b in pairs if similar(counted[a], counted[b]) >= 0.8]
    return smallest_reachable(texts, links)


def edited(rng, words, most):
    words = list(words)
    for _ in range(rng.randint(0, most)):
        words[rng.randrange(len(words))] = f"z{rng.random()}"
    return words


def family(seed, copies, size=160, most=9):
    """Near copies of one text whose similarities lie on both sides of the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(size)]
    return [" ".join(edited(rng, base, most)) for _ in range(copies)]


def test_query_equals_its_statement(spark, duck, data):
    assert assert_same(queries.minhash_near_dedup(spark, data), duck, queries.statements()["op9_minhash_near_dedup"])


@pytest.mark.parametrize("seed", [1, 2])
def test_families_on_both_sides_of_the_threshold(spark, seed):
    texts = dict(enumerate(family(seed, 120) + family(seed + 10, 40, size=30, most=2) + ["a b"] * 5 + ["b a", "", " "]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(docs).collect()}
    assert got == classes_of(texts)


def test_multiplicities_count(spark):
    base = " ".join(f"w{i}" for i in range(40))
    texts = {1: base, 2: f"{base} " + " ".join(["ha"] * 200), 3: " ".join(["ha"] * 2_000), 4: " ".join(["ha"] * 1_900)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(docs).collect()}
    assert got == classes_of(texts) == {1: 1, 2: 2, 3: 3, 4: 3}


def test_signatures_are_unbiased():
    rng = random.Random(5)
    texts = []
    for k in range(400):
        words = [f"u{k}x{rng.randrange(400)}" for _ in range(80)]
        other = edited(rng, words, 6)
        if k % 2:
            words, other = words + words[:20] * rng.randint(1, 6), other + other[:20] * rng.randint(1, 6)
        texts += [" ".join(words), " ".join(other)]
    owner, hashed = bagminhash.shingles([t.encode() for t in texts])
    signature = bagminhash.signatures(owner, hashed, len(texts))
    errors = [
        (signature[i] == signature[i + 1]).mean() - similar(runs(texts[i]), runs(texts[i + 1]))
        for i in range(0, len(texts), 2)
    ]
    assert abs(np.mean(errors)) < 4 * np.std(errors) / len(errors) ** 0.5


def test_shingles_of_many_texts_in_parts(monkeypatch):
    texts = [t.encode() for t in family(3, 30)]
    whole = bagminhash.shingles(texts)
    monkeypatch.setattr(bagminhash, "_TEXTS", 7)
    for a, b in zip(whole, bagminhash.shingles(texts), strict=True):
        assert (a == b).all()


def test_odd_documents(odd_docs, no_docs):
    rows = {r["doc_id"]: (r["class_id"], r["kept"]) for r in bagminhash.near_duplicates(odd_docs).collect()}
    assert rows == {i: (i, True) for i in (1, 2, 3, 4, 5, 6)}
    assert bagminhash.near_duplicates(no_docs).count() == 0
    single = bagminhash.one_of_each(odd_docs)
    assert single.columns == odd_docs.columns and single.count() == 7


def test_one_id_with_several_texts_counts_once(spark):
    """The row with the smallest text stands for its id, wherever it lies."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, c, "z"), (1, a, "y"), (1, b, "x"), (2, a, "x"), (3, b, "x"), (4, c, "x"), (4, c, "w"), (5, None, "v"), (5, c, "u")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(docs.repartition(4)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    single = sorted(tuple(r) for r in bagminhash.one_of_each(docs.repartition(3)).collect())
    assert [r[0] for r in single] == [1, 3, 4, 5]
    assert single[0] == (1, a, "y") and single[2] == (4, c, "w") and single[3] == (5, None, "v")


def test_only_texts_that_share_a_band_are_packed(spark, monkeypatch):
    """Texts without a band in common with another are left out where they lie; those with one are all there."""
    rng = random.Random(6)
    texts = dict(enumerate(family(7, 20) + [" ".join(f"u{rng.random()}" for _ in range(30)) for _ in range(400)]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    packed, seen = bagminhash.packed, []
    monkeypatch.setattr(bagminhash, "packed", lambda rows: seen.append(rows) or packed(rows))
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(docs).collect()}
    assert got == classes_of(texts)
    assert sum(rows.count() for rows in seen) < 60


@pytest.mark.parametrize("bits", [1 << 15, 1 << 27])
def test_texts_of_wanted_ids_are_never_left_out(spark, monkeypatch, bits):
    monkeypatch.setattr(bagminhash, "MOST_BITS", bits)
    texts = spark.range(60_000).selectExpr("id - 30000 as doc_id", "cast(id as string) as text")
    wanted = texts.filter("doc_id % 7 = 3 or doc_id % 7 = -3").select("doc_id")
    left = bagminhash._about(texts, wanted, 8_571)
    assert left.columns == texts.columns
    assert left.join(wanted, "doc_id").count() == wanted.count() and wanted.count() <= left.count() <= texts.count()
    if bits > 1 << 15:
        assert left.count() < 1.2 * wanted.count()
    assert bagminhash._about(texts, wanted.limit(0), 0).count() == 0


def test_a_centre_meets_a_text_once(spark):
    """Whatever the number of bands they share, and only in another component."""
    rows = [(band, i, i % 3, 0, None) for band in range(20) for i in range(band % 2, 9)]
    placed = spark.createDataFrame(rows, "band bigint, doc_id bigint, component bigint, size bigint, rare array<bigint>")
    some = [(band, a, a % 3, 0, None) for band, a in [(0, 0), (2, 0), (3, 1), (5, 1), (6, 1), (7, 2)]]
    centres = spark.createDataFrame(some, "band bigint, a bigint, of bigint, a_size bigint, a_rare array<bigint>")
    got = [tuple(r) for r in bagminhash._met(placed, centres, 0.8).collect()]
    want = {(a, i) for band, a, of, *_ in some for other, i, component, *_ in rows if band == other and component != of}
    assert len(got) == len(set(got)) and set(got) == want


def test_sketches_never_rule_out_a_link():
    """Sketches differ in no more places than the multisets, and in nearly as many while these are few."""
    texts = family(8, 60) + family(9, 20, size=30, most=4) + [" ".join(["ha"] * n) for n in (1, 3, 9, 400)]
    owner, hashed = bagminhash.shingles([t.encode() for t in texts])
    bits = bagminhash.sketches(owner, hashed, len(texts))
    assert bits.shape == (len(texts), bagminhash.SKETCH // 64) and bits.dtype == np.int64
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            x, y = runs(a), runs(b)
            apart = sum(((x - y) + (y - x)).values())
            seen = sum(int(n & 0xFFFFFFFFFFFFFFFF).bit_count() for n in (bits[i] ^ bits[j]).tolist())
            assert seen <= apart and (apart > 100 or seen >= 0.8 * apart)


def test_texts_surely_too_different_are_not_compared(spark, monkeypatch):
    """A group whose texts share bands with many others, while few pairs reach the threshold; no step has a row a shingle."""
    texts = dict(enumerate(family(13, 150, most=14)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    verified, seen = bagminhash._verified, []
    monkeypatch.setattr(bagminhash, "_verified", lambda pairs, *rest: seen.append(pairs.count()) or verified(pairs, *rest))
    steps = []
    monkeypatch.setattr(bagminhash, "landed", lambda rows, *name: steps.append(landed(rows, *name)) or steps[-1])
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(docs).collect()}
    assert got == classes_of(texts)
    assert sum(seen[1:]) < len(texts)
    assert max(step.count() for step in steps) <= bagminhash.BANDS * len(texts)


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    want = smallest_reachable({n for link in links for n in link}, links)
    assert got == {n: want[n] for n in nodes}
    assert components.components(df.limit(0)).count() == 0


def brute_links(vectors, threshold=0.95):
    ids = [i for i, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = np.array(vectors[a], float), np.array(vectors[b], float)
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links.append((a, b))
    return links


def check_vectors(spark, vectors):
    df = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<float>")
    links = brute_links({r["vec_id"]: r["embedding"] for r in df.collect()})
    label = smallest_reachable(vectors, links)
    degree = Counter(i for link in links for i in link)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in nn_descent.linked(df).collect()}
    assert got == {i: (degree[i], label[i], label[i] == i) for i in vectors}


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    rows = [c + rng.normal(size=16) * s for c in centres for s in (0.0, 0.0, 0.05, 0.1, 0.15, 0.2)]
    crowd = [centres[0] + rng.normal(size=16) * 0.1 for _ in range(90)]  # more links than a list holds
    far = list(rng.normal(size=(150, 16)))
    vectors = {i: v.tolist() for i, v in enumerate(rows + crowd + far)}
    vectors |= {900: None, 901: [0.0] * 16, 902: [float("nan")] * 16, 903: [float("inf")] + [1.0] * 15, 904: []}
    vectors |= {905: [1.0, None], 906: [1.0, 2.0, 3.0], 907: [2.0, 4.0, 6.0], 908: (3 * centres[1]).tolist()}
    check_vectors(spark, vectors)


def test_vectors_query(spark, duck, data):
    assert_same(queries.embedding_near_dedup(spark, data), duck, queries.statements()["op7_embedding_near_dedup"])


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert nn_descent.linked(df).count() == 0
    alone = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in nn_descent.linked(alone).collect()] == [(1, 0, 1, True)]


def tight_groups(rng, groups, size, across, inside=0.999, dim=24):
    """Groups of vectors whose cosine is about ``inside`` in a group and ``across`` between groups."""
    axes = np.linalg.qr(rng.normal(size=(dim, groups + 1)))[0].T
    rows = []
    for k in range(groups):
        centre = np.sqrt(across) * axes[-1] + np.sqrt(1 - across) * axes[k]
        for _ in range(size):
            noise = rng.normal(size=dim)
            rows.append(centre + noise / np.linalg.norm(noise) * np.sqrt(1 / inside - 1))
    return rows


@pytest.mark.parametrize("groups, size, across", [(2, 13, 0.96), (6, 40, 0.955), (5, 20, 0.945)])
def test_links_between_tight_groups(spark, groups, size, across):
    rng = np.random.default_rng(groups)
    rows = tight_groups(rng, groups, size, across) + list(rng.normal(size=(60, 24)))
    check_vectors(spark, {i: rows[k].tolist() for i, k in enumerate(rng.permutation(len(rows)))})


def test_audit_grows_until_it_holds_enough_links(spark, monkeypatch, caplog):
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(3_000, 24))
    rows[1:120:2] = rows[0:120:2] + rng.normal(size=(60, 24)) * 0.05  # sixty pairs among 3,000
    table = [(i, rows[k].astype("<f8").tobytes()) for i, k in enumerate(rng.permutation(3_000))]
    nodes = spark.createDataFrame(table, "node bigint, vector binary")
    monkeypatch.setattr(nn_descent, "AUDITED_LINKS", 40)
    assert nn_descent._audit(nodes, 0.95, 3_000).count() >= 40
    monkeypatch.setattr(nn_descent, "AUDITED_LINKS", 400)
    monkeypatch.setattr(nn_descent, "AUDITED_MOST", 1_024)
    links, _, _ = nn_descent._searched(nodes, 0.95, nn_descent.NEIGHBOURS)
    assert links.count() == 60 and "recall not measured" in caplog.text
