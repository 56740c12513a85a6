import random
import re

import numpy as np
import pytest
import xxhash

from lodestone.llm import components as graph
from lodestone.llm import op6_simhash as op
from lodestone.llm import shingles

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_fingerprint(text, words_each=4):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + words_each]) for i in range(len(words) - words_each + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, near):
    """Least reachable id of each, where ``near(i, j)`` says whether two are linked."""
    parent = dict(enumerate(range(len(ids))))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if near(i, j) and (a := root(i)) != (b := root(j)):
                parent[a] = b
    least = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(least.get(root(i), x), x)
    return [least[root(i)] for i in range(len(ids))]


def test_fingerprints():
    for text in ["", " \n", "one", "Two WORDS", "Ä Ö a b c É", prose(1, 40), prose(2, 400).upper(), "a b c d " * 40, "x\x0by\x1cz q r s"]:
        assert int(op.fingerprint(text)[0]) == brute_fingerprint(text)
    wide = op.fingerprint(prose(1, 40), 5, 4)
    assert len(set(wide.tolist())) == 4 and int(wide[0]) == brute_fingerprint(prose(1, 40), 5)


def test_frames(odd, odd_rows, none):
    got = op.near_duplicates(odd).collect()
    fps = [(i, brute_fingerprint(t)) for i, t in odd_rows]
    known = [(i, f) for i, f in fps if i is not None]
    least = brute_components([i for i, _ in known], lambda a, b: (known[a][1] ^ known[b][1]).bit_count() <= 4)
    want = [(i, f"{f:016x}", c) for (i, f), c in zip(known, least)] + [(None, f"{f:016x}", None) for i, f in fps if i is None]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in got)
    assert op.near_duplicates(none).count() == 0


def planted(n_groups=12, seed=3):
    rng, rows = random.Random(seed), []
    for g in range(n_groups):
        base = rng.getrandbits(64)
        for k in range(rng.randint(1, 6)):
            fp = base
            for _ in range(rng.randint(0, 6)):
                fp ^= 1 << rng.randrange(64)
            rows.append(fp)
    return sorted(set(rows), key=lambda x: x % 1009)


@pytest.mark.parametrize("small", [64, 1])
def test_links_connect_all_near_pairs(spark, small, monkeypatch):
    fps = planted()
    monkeypatch.setattr(op, "SMALL_RUN", small)
    nodes = list(range(100, 100 + len(fps)))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame(list(zip(nodes, signed)), "node long, fp0 long")
    found = {r.node: r.component for r in graph.components(op.links(df)).collect()}
    want = brute_components(nodes, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert [found.get(n, n) for n in nodes] == want


def test_runs_give_forests_not_all_pairs():
    ring = op.EXACT
    rng = np.random.default_rng(1)
    fps = np.repeat(rng.integers(0, 1 << 63, (1, ring.words)).astype(np.uint64), 400, 0)
    fps[:, 0] ^= np.uint64(1) << rng.integers(62, 64, 400).astype(np.uint64)
    one, other = op._links(ring, np.zeros(400, np.int64), fps, np.arange(400))
    assert len(one) == 399
    wide = np.repeat(fps[:, :1], 2, 1)
    assert len(op._stars(op.WIDE, wide, np.arange(400))[0]) == 399
    one, other = op._between(op.WIDE, wide, np.arange(400), np.r_[np.zeros(395, int), 1, 1, 2, 2, 2])
    assert sorted(one) == [395, 396, 397, 398, 399] and len(other) == 5


def test_chains_lose_no_near_pair():
    rng = np.random.default_rng(4)
    one = rng.integers(0, 1 << 63, (4000, 2)).astype(np.uint64)
    flip = rng.random((4000, 128)) < rng.uniform(0.02, 0.4, 4000)[:, None]
    other = one ^ np.packbits(flip, axis=1).view(np.uint64)
    near = np.bitwise_count(one ^ other).sum(1) <= op.WIDE.max_bits
    assert 500 < near.sum() < 3500
    assert (op.near_all(op.WIDE, one, other) == near).all()


def test_band_keys():
    texts = [prose(300 + i, 200) for i in range(150)]
    shared, far = 0, 0
    for i, t in enumerate(texts):
        other = changed(t, 4, i)
        mine = op.band_keys(op.shingle_hashes(t, 5))
        shared += bool((mine == op.band_keys(op.shingle_hashes(other, 5))).any())
        far += bool((mine == op.band_keys(op.shingle_hashes(texts[i - 1], 5))).any())
    assert shared >= 148 and not far  # similarity of some 0.8 to 0.9, where 99.8 % are expected, and of 0
    long = op.shingle_hashes(texts[0] * 60, 5)
    assert (op.band_keys(long) == op.band_keys(np.unique(long))).all()


def test_exact_keys_lose_no_pair():
    rng = random.Random(9)
    m, segments = len(op.EXACT.segments), op.EXACT.segments
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 4)):
            b ^= 1 << bit
        part = lambda x, i: x >> segments[i % m][1] & (1 << segments[i % m][2]) - 1  # noqa: B023, E731
        x, y = np.array([[a]], np.uint64), np.array([[b]], np.uint64)
        ok = [i for i in range(m) for s in (1, 2) if part(a, i) == part(b, i) and part(a, i + s) == part(b, i + s) and op._near(op.EXACT, np.array([i]), x, y)[0]]
        assert ok


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (None, 3), (5, 6)]
    df = spark.createDataFrame(edges, "u long, v long")
    links = {(a, b) for a, b in edges if a is not None and a != b}
    nodes = sorted({x for e in links for x in e})
    want = brute_components(nodes, lambda i, j: (nodes[i], nodes[j]) in links or (nodes[j], nodes[i]) in links)
    assert {r.node: r.component for r in graph.components(df).collect()} == dict(zip(nodes, want))
    assert graph.components(df.filter("false")).count() == 0


def changed(text, k, seed):
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(k):
        words[rng.randrange(len(words))] = f"new{rng.randrange(999)}"
    return " ".join(words)


def test_keep_one(spark, odd, odd_rows):
    base = prose(50, 300)
    rows = [(30, base), (31, changed(base, 2, 1)), (32, changed(base, 3, 2)), (33, base), (34, prose(51, 300)), (35, prose(52, 300))]
    extra = [0] * (len(odd.columns) - 5)
    docs = odd.unionByName(spark.createDataFrame([(i, t, "en", "s", 0, *extra) for i, t in rows], odd.schema))
    kept = op.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect())
    # of 1-3 (no words) one, of 5, 5, 6 one (10 has the same words), of 30-33 one; rows without an id stay
    assert ids == [-1, -1, 1, 4, 5, 7, 8, 9, 11, 30, 34, 35]


def jaccard(a, b):
    sets = []
    for text in (a, b):
        words = WORD.findall(text.translate(LOWER))
        sets.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_shingle_similarity(spark):
    base = prose(53, 90)
    texts = ["", " \n", "One two", "one  TWO", base, changed(base, 1, 1), changed(base, 6, 2), base + "\n" + base, "a b c d " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("content", shingles.content_of())
    name = {r.doc_id: r.content for r in docs.collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    sets = shingles.shingle_sets(docs, docs.select("content"))
    for least in (0.3, 0.8, 1.0):
        got = shingles.similar(spark.createDataFrame([(name[i], name[j]) for i, j in pairs], "a long, b long"), sets, least).collect()
        assert {(r.a, r.b) for r in got} == {(name[i], name[j]) for i, j in pairs if jaccard(texts[i], texts[j]) >= least}


@pytest.mark.parametrize("middle_run", [64, 1])
def test_groups_against_brute_force(spark, middle_run):
    """Similarities of 0.6 to 0.8 are within the fingerprints' reach and don't link."""
    rows = []
    for g in range(40):
        base = prose(200 + g, 200)
        texts = [base, changed(base, 5 + g % 6, g), changed(base, 8, 50 + g), changed(changed(base, 8, 50 + g), 1, g)]
        rows += [(10 * g + k, t) for k, t in enumerate(texts)]
    base = prose(400, 300)
    rows += [(1000 + k, changed(base, k % 7, 3 * k)) for k in range(60)]
    ids, texts = zip(*rows)
    near = {(i, j): jaccard(texts[i], texts[j]) for i in range(len(ids)) for j in range(i) if ids[i] >= 1000 <= ids[j] or ids[i] // 10 == ids[j] // 10}
    assert sum(0.6 <= x < 0.8 for x in near.values()) > 50
    want = brute_components(ids, lambda i, j: near.get((max(i, j), min(i, j)), 0) >= 0.8)
    kept = {r.doc_id for r in op.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), middle_run=middle_run).collect()}
    if middle_run > 1:
        assert kept == set(want)
    # in large runs a text whose only link is to a farther one may stay; no other one goes
    assert kept >= set(want) and len(kept) <= 1.1 * len(set(want))


def test_repeated_ids(spark):
    base = prose(60, 100)
    rows = [(3, base, "x"), (5, base, "x"), (5, prose(61, 100), "x"), (9, prose(62, 100), "x"), (9, prose(62, 100), "y"), (9, base, "z")]
    kept = op.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted({(3, base), rows[2][:2], rows[3][:2]})


def test_large_runs_lose_no_link(spark, monkeypatch):
    """Texts of equal fingerprints in one run: a true link to one that isn't the nearest."""
    rows = [(i, prose(70 + i, 100)) for i in range(8)]
    rows += [(100 + k, changed(rows[i][1], 1, k)) for k, i in enumerate((3, 6))]
    ids, texts = zip(*rows)
    near = {(i, j): jaccard(texts[i], texts[j]) >= 0.8 for i in range(len(ids)) for j in range(i)}
    want = brute_components(ids, lambda i, j: near[max(i, j), min(i, j)])
    assert len(set(want)) == 8
    monkeypatch.setattr(op, "band_keys", lambda hashes: np.arange(12))
    monkeypatch.setattr(op, "of_hashes", lambda hashes, words=1: np.zeros(words, np.uint64))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in op.keep_one(docs, middle_run=2).collect()} == set(want)


def test_sketches_reject_no_link():
    rejected = 0
    for g in range(60):
        base = prose(500 + g, 40 + 20 * g)
        texts = [base, *(changed(base, k, 7 * g + k) for k in (1, 2 + g // 6, 5 + g // 2, 20 + g))]
        sizes, sketches = zip(*(op.parities(op.shingle_hashes(t, 5)) for t in texts))
        sketches = np.stack([np.frombuffer(x, np.uint64) for x in sketches])
        fits, _ = op.may_be_similar(np.array(sizes), sketches, sizes[0], sketches[0])
        alike = np.array([jaccard(t, base) for t in texts])
        assert fits[alike >= 0.8].all()
        rejected += int((~fits[alike < 0.6]).sum())
    assert rejected > 40
    assert op.parities(op.shingle_hashes("")) == (0, bytes(128))


def test_large_runs_take_few_rounds(spark, monkeypatch):
    """Unlike texts whose fingerprints and keys are equal are not asked for, round by round."""
    rows = [(i, prose(600 + i, 100)) for i in range(40)]
    rows += [(100 + i, changed(rows[i][1], 1, i)) for i in range(0, 40, 4)]
    rounds, found = [], []
    monkeypatch.setattr(op, "band_keys", lambda hashes: np.arange(12))
    monkeypatch.setattr(op, "of_hashes", lambda hashes, words=1: np.zeros(words, np.uint64))
    components, similar = op.components, op.similar
    monkeypatch.setattr(op, "components", lambda edges: rounds.append(0) or components(edges))
    monkeypatch.setattr(op, "similar", lambda pairs, sets: found.append(pairs.count()) or similar(pairs, sets))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in op.keep_one(docs, middle_run=2).collect()} == set(range(40))
    assert len(rounds) <= 3 and sum(found[1:]) <= 50
