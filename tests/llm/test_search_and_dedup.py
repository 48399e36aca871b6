"""Top-k search and SimHash against brute force, and their cases of note."""

import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from recurra.llm import common, nearcopies, simhash, topk
from recurra.llm.common import components

VEC = "vec_id long, embedding array<float>, rank int"


def brute_top(rows, queries, k):
    out = []
    clean = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in clean:
        if q in queries:
            scored = sorted((-sum(a * b for a, b in itertools.zip_longest(v, c, fillvalue=0)), i) for i, c in clean if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block", [5, 16, 2048])
def test_top_k_equals_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)]) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, [float("inf")] * 8), (304, []), (350, [0.5, -0.25])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VEC)
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5, block=block, query_block=3)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, {0, 50, 100, 200, 350}, 5)


def test_top_k_empty_and_few(spark):
    none = spark.createDataFrame([], VEC)
    assert topk.top_k(none, none, 5).count() == 0
    two = spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0)], VEC)
    assert [tuple(r) for r in topk.top_k(two, two.where("vec_id = 0"), 5).collect()] == [(0, 1, 1, 131072)]


def test_top_k_of_large_integers_is_exact(spark):
    big = float(1 << 46)
    rows = [(0, [big, 1.0]), (1, [big, 3.0]), (2, [big, 4.0]), (3, [big, 2.0]), (4, [-big, 9.0]), (5, [0.0, 0.0])]
    rows += [(10 + i, [big, 3.0]) for i in range(4)]
    huge = [(100, [1e30, 1.0]), (101, [1e30, 2.0]), (102, [1e30 * 1.5, -2.0]), (103, [-1e30, 0.0])]
    for own, queries in ((rows, {0, 4, 5}), (rows + huge, {0, 4, 100, 103})):
        df = spark.createDataFrame([(i, v, 0) for i, v in own], VEC.replace("float", "double"))
        for block in (3, 2048):
            got = topk.top_k(df, df.where(F.col("vec_id").isin(*queries)), 5, block=block, query_block=2).collect()
            want = [(q, r, i, max(-(1 << 63), min((1 << 63) - 1, s))) for q, r, i, s in brute_top(own, queries, 5)]
            assert sorted(map(tuple, got)) == want


def test_order_of_scores_beyond_a_long():
    xs = sorted([0, 5, -5, (1 << 63) - 1, 1 << 63, (1 << 63) + 1, 10**30, 10**30 + 1, -(1 << 63), -(1 << 63) - 1, -(10**25), -(10**25) - 1])
    texts = [t for t in map(topk._order, xs) if t]
    assert texts == sorted(texts) and len(set(texts)) == len(texts) == 9


def test_top_k_over_many_cells_and_a_hot_vector(spark):
    rng = np.random.default_rng(11)
    middles = rng.normal(0, 3, (12, 8))
    rows = [(i, [float(x) for x in middles[i % 12] + rng.normal(0, 0.05, 8)]) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VEC.replace("float", "double"))
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5, block=40, query_block=4)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, {i for i, _ in rows if i % 50 == 0}, 5)


def test_dual_trees_leave_out_most_pairs_of_clustered_vectors():
    rng = np.random.default_rng(2)
    middles = rng.normal(0, 900, (30, 16))
    c = np.floor(middles[rng.integers(0, 30, 6000)] + rng.normal(0, 20, (6000, 16)))
    q = c[:500]
    best, share = topk.search_block(q, np.arange(500), c, np.arange(6000), 5)
    score = q @ c.T
    score[np.arange(500), np.arange(500)] = -np.inf
    assert (np.sort(score, axis=1)[:, -5:][:, ::-1] == best.score).all()
    assert share < 0.35


def test_cover_tree_covers_and_separates():
    x = np.random.default_rng(1).normal(size=(900, 6))

    def walk(node):
        assert topk._distance(x[node.points], node.center).max() <= node.radius + 1e-6
        if node.children:
            assert sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points)
            assert (node.children[0].center == node.center).all()
            scale = max(c.radius for c in node.children) / (1 + 1e-9)
            for a, b in itertools.combinations(node.children, 2):
                assert np.linalg.norm(a.center - b.center) >= scale - 1e-9
        for c in node.children:
            walk(c)

    walk(topk.cover_tree(x, leaf=8))


def plain_simhash(text, k=3):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = [None, "", " \n\t", "One", "one", "one two", "A b C d e f", "a b c d e f", "\u00c9t\u00e9 \u00e9t\u00e9 x\u00a0y z", "x " * 5000, "tie tie tie tie"]


def test_fingerprints_and_classes(spark):
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 500, 300)]
    texts = list(TEXTS)
    for i in range(60):
        t = list(base)
        for j in range(i % 4):
            t[(37 * i + 11 * j) % 300] = f"new{i}{j}"
        texts.append(" ".join(t))
    rows = [(i * 3 + 1, t, "x", i) for i, t in enumerate(texts)] + [(1, None, "x", 0), (None, "one", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component_id int")
    for cap in (1, 64):
        got = simhash.near_duplicate_groups(df, cell_cap=cap).collect()
        assert len(got) == len(rows)
        fp = [plain_simhash(t) for _, t, _, _ in rows]
        want = components_by_hand([r[0] for r in rows], fp, 2)
        assert sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in got) == sorted((r[0] or -1, f"{f:016x}", c) for r, f, c in zip(rows, fp, want))


def components_by_hand(ids, fp, bits):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if bin(fp[i] ^ fp[j]).count("1") <= bits:
            root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("cap", [2, 64])
@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_keep_every_component(spark, cap, bits):
    rng = np.random.default_rng(bits)
    seeds = rng.integers(-(1 << 62), 1 << 62, 12)
    fps = {int(s) for s in seeds} | {-(1 << 63), -(1 << 63) + 1, 0}
    for s in seeds:
        for _ in range(25):
            x = int(s)
            for b in rng.integers(0, 63, rng.integers(0, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    got = components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), bits, cap))
    roots = {r.node: r.root for r in got.collect()}
    hand = components_by_hand(list(range(len(fps))), [f & ((1 << 64) - 1) for f in fps], bits)
    mine = [roots.get(f, f) for f in fps]
    assert len({*zip(mine, hand)}) == len(set(mine)) == len(set(hand))


def test_links_of_an_empty_table(spark):
    assert simhash.near_duplicate_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_copies_by_jaccard(spark):
    rng = np.random.default_rng(9)
    docs, truth = [], []
    for g in range(12):
        words = [f"w{x}" for x in rng.integers(0, 10_000, 200)]
        for c in range(6):
            t = list(words)
            for j in range(c * 2):
                t[(29 * j + 13 * c) % 200] = f"e{g}{c}{j}"
            docs.append((len(docs), " ".join(t)))
    docs += [(len(docs) + i, docs[0][1]) for i in range(30)]  # exact copies
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs}
    for (i, a), (j, b) in itertools.combinations(sets.items(), 2):
        if len(a & b) / len(a | b) >= 0.8:
            truth.append((i, j))
    df = spark.createDataFrame([(i, t, t) for i, t in docs], "doc_id long, text string, keeper string")
    got = {r.doc_id: r.keeper for r in nearcopies.near_copies(df).collect()}
    group = lambda i: got.get(i, i)
    assert all(group(i) == group(j) for i, j in truth)
    for i, k in got.items():
        assert k < i and (min(i, k), max(i, k)) in truth or any(group(a) == group(b) == k for a, b in truth if i in (a, b))
    kept = nearcopies.drop_near_copies(df)
    assert kept.columns == df.columns and kept.count() == len(docs) - len(got)


def near_groups(texts, shingle=5, similarity=0.8):
    """Per text the least index of its component, by comparing all pairs."""
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    words = [t.split() for t in texts]
    sets = [{tuple(w[k : k + shingle]) for k in range(max(len(w) - shingle + 1, 1))} if w else set() for w in words]
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = find(i), find(j)
        if a != b and sets[i] and (texts[i] == texts[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity):
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_copies_follow_chains_of_copies(spark):
    rng = np.random.default_rng(17)
    base = [f"w{x}" for x in rng.integers(0, 10_000, 200)]
    texts = [" ".join(base)]
    for c in range(60):
        one = list(base)
        one[3 * c + 5] = f"e{c}"
        far = list(one)
        for j in range(4):
            far[(3 * c + 45 + 37 * j) % 200] = f"f{c}x{j}"
        texts += [" ".join(one), " ".join(far)]
    want = near_groups(texts)
    assert set(want) == {0}
    got = nearcopies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.keeper for r in got.collect()} == {i: 0 for i in range(1, len(texts))}


def test_near_copies_miss_no_pair(spark):
    rng = np.random.default_rng(23)
    texts = []
    for g in range(1000):
        one = [f"g{g}w{x}" for x in range(49)]
        far = list(one)
        far[7] = far[40 if g % 2 else 8] = f"e{g}"  # 35 of 55 or 39 of 51 shingles shared: no copy
        near = list(one)
        near[int(rng.integers(5, 44))] = f"n{g}"  # 40 of 50 shingles: exactly 0.8
        texts += [" ".join(one), " ".join(far), " ".join(near)]
    want = near_groups_of_blocks(texts, 3)
    got = {r.doc_id: r.keeper for r in nearcopies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == want


def test_near_copies_of_short_texts(spark):
    rng = np.random.default_rng(29)
    texts = []
    for g in range(300):
        one = [f"g{g}w{x}" for x in range(int(rng.integers(1, 16)))]
        texts += [" ".join(one), " ".join([*one, "more"]), " ".join([*one[:-1], "other"])]
    for g, n in enumerate((8, 9, 9)):  # 4 of 5, 5 of 6 and 5 of 6 shingles, from either side
        one = [f"s{g}w{x}" for x in range(n)]
        texts += [" ".join(one), " ".join([*one, "end"]), " ".join(["start", *one])]
    want = near_groups(texts)
    got = {r.doc_id: r.keeper for r in nearcopies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == want
    assert all(want[-9 + 3 * g :][:2] == [len(texts) - 9 + 3 * g] * 2 for g in range(2))


def test_near_copies_of_hot_shingles_and_in_crowded_groups(spark, monkeypatch):
    rng = np.random.default_rng(41)
    monkeypatch.setattr(nearcopies, "_HOT", 3)
    passage = [f"p{x}" for x in range(60)]
    texts = []
    for g in range(60):
        own = [f"o{g}x{x}" for x in range(12)]
        texts.append(" ".join(passage + own))  # 56 of 76 shingles or fewer shared: unlike, though they share a passage
    for g in range(40):
        t = list(passage) + [f"c{x}" for x in range(60)]
        t[int(rng.integers(5, 115))] = f"e{g}"
        texts.append(" ".join(t))
    texts += [" ".join(passage + [f"o{g}x{x}" for x in range(11)]) for g in range(0, 60, 7)]
    want = near_groups(texts)
    assert len(set(want[:60])) == 60 and len(set(want[60:100])) < 40
    got = {r.doc_id: r.keeper for r in nearcopies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == want


def test_near_copies_of_a_crowded_group_compare_few_pairs(spark, monkeypatch):
    # Copies of one text with 1 to 6 words changed: two are alike at three changes or fewer between them, so most stay alone.
    rng = np.random.default_rng(43)
    base = [f"b{x}" for x in range(150)]
    texts = []
    for i in range(500):
        t = list(base)
        for k in rng.choice(28, int(rng.integers(1, 7)), replace=False):
            t[5 + 5 * k] = f"e{i}x{k}"
        texts.append(" ".join(t))
    told, save = [], nearcopies.save
    monkeypatch.setattr(nearcopies, "save", lambda df, tag: (out := save(df, tag), told.append((tag, out.count(), out.columns)))[0])
    got = {r.doc_id: r.keeper for r in nearcopies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == near_groups(texts)
    assert sum(n for tag, n, _ in told if tag == "judged") < 20_000


def test_parities_bound_the_distance_of_sets():
    rng = np.random.default_rng(3)
    for n in (0, 1, 50, 3000):
        h = np.unique(rng.integers(0, 1 << 64, n + 40, dtype=np.uint64))
        a, b = h[: len(h) - 20], h[20:]
        apart = int(np.bitwise_count((nearcopies.parities(a) ^ nearcopies.parities(b)).view(np.uint64)).sum())
        assert apart <= 40 and apart % 2 == 0
        assert len(nearcopies.parities(a)) == nearcopies._LONGS


def test_shingle_sets_equal_the_plain_form(monkeypatch):
    from recurra.llm import simhash as s

    rng = np.random.default_rng(2)
    words = nearcopies._WordHashes()
    for piece in (1, 5, 1 << 20):
        monkeypatch.setattr(s, "_PIECE", piece)
        seen = {}
        for n in (0, 1, 3, 4, 5, 6, 40):
            t = " ".join(f"W{x}" for x in rng.integers(0, 9, n))
            w = t.lower().split()
            plain = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
            assert len(nearcopies.shingle_set(t.encode(), 5, words)) == len(plain)


def test_documents_that_share_an_id_but_not_the_text_stay(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(1, a), (1, b), (1, a), (2, a + " x"), (3, b), (3, "other words here")]
    kept = nearcopies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, a), (1, b), (3, "other words here")])


def near_groups_of_blocks(texts, size):
    return [at + i for at in range(0, len(texts), size) for i in near_groups(texts[at : at + size])]


def test_drop_near_copies_edges(spark):
    rows = [(None, "a b c d e f g"), (None, None), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A B c d e f g"), (3, None), (4, ""), (5, "a b c d e f g")]
    kept = nearcopies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id for r in kept if r.doc_id is not None)) == [1, 3]
    assert sum(r.doc_id is None for r in kept) == 2
    assert nearcopies.drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_chain(spark):
    n = 60
    ids = [xxhash.xxh64_intdigest(str(i)) >> 1 for i in range(n)]
    edges = spark.createDataFrame(list(itertools.pairwise(ids)), "a long, b long")
    assert components(edges).select("root").distinct().count() == 1
    assert components(edges).where(F.col("node").isin(ids)).count() == n


def _planned(monkeypatch, *modules):
    """Physical plans, as Spark makes them first, of all that the modules save from now on."""
    plans = []
    for module in modules:
        monkeypatch.setattr(module, "save", lambda df, tag, f=module.save: (plans.append(df._jdf.queryExecution().executedPlan().toString()), f(df, tag))[1])
    return plans


def test_links_build_no_exploded_table_in_the_driver(spark, monkeypatch):
    # Spark takes 33 cells and 65 midpoints of a fingerprint for one row each, so its estimate is no bound.
    plans = _planned(monkeypatch, simhash)
    fps = spark.createDataFrame([(i * 0x9E3779B97F4A7C15 % (1 << 63),) for i in range(50)], "fp long")
    found = simhash.links(fps)
    assert plans and not any("Broadcast" in p for p in plans)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_near_copies_broadcast_only_what_is_counted(spark, monkeypatch):
    plans = _planned(monkeypatch, nearcopies, common, simhash)
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)  # an empty table is too large as well
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:30] + [f"x{i % 3}"] + words[30:])) for i in range(12)] + [(99, "some other text of few words")]
    got = {(r.doc_id, r.keeper) for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, 0) for i in range(1, 12)}
    assert plans and not any("BroadcastHashJoin" in p for p in plans)


def test_bits_of_a_long_text_are_counted_in_pieces():
    h = np.random.default_rng(0).integers(0, 1 << 63, 150_001).astype(np.uint64)
    want = [int((h >> np.uint64(i) & np.uint64(1)).sum()) for i in range(64)]
    assert simhash._bit_counts(h).tolist() == want
