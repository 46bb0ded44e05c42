"""Near-duplicates of an LSH forest against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from addrspark.llm import lsh_forest as lf

SCHEMA = "doc_id bigint, text string, cls string, n int"


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set()


def plain(rows):
    """(doc_id, n_shingles, component_id, kept) of each row."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        named = [x for x in least[find(k)] if x is not None]
        c = i if not sets[k] else min(named) if named else None
        out.append((i, len(sets[k]), c, i is not None and i == c))
    return sorted(out, key=repr)


def near_copies(rng, words, n, changes):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def run(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in lf.near_duplicates(docs, **more).collect()), key=repr)


@pytest.mark.parametrize(("near", "wide"), [(8, 128), (1, 40)])
def test_against_all_pairs(spark, near, wide):
    rng = random.Random(near)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = [None, "", " \t\n", "one", "ONE", "one two", "Two one", "a a a a", "a a", "x\x00y é", "long " * 30000]
    for n in (30, 60, 200):
        base = [word() for _ in range(n)]
        texts += near_copies(rng, base, 25, n // 9)
    texts += [" ".join(word() for _ in range(80)) for _ in range(60)]
    shared = " ".join(word() for _ in range(60))
    texts += [shared + " " + " ".join(word() for _ in range(40)) for _ in range(40)]
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    assert run(spark, rows, near=near, wide=wide) == plain(rows)


def test_links_that_no_neighbours_show(spark):
    rng = random.Random(5)
    texts = near_copies(rng, [f"b{k}" for k in range(60)], 40, 9) + near_copies(rng, [f"c{k}" for k in range(9)], 12, 1) + ["b1 b2", "B1 b2", "", "b1"]
    rows = list(enumerate(texts))
    want = plain(rows)
    assert 10 < len({c for _, _, c, _ in want}) < 45
    assert run(spark, rows, near=0, wide=0) == want


def test_similar_sets_pass_fronts_and_bitmaps():
    rng = np.random.default_rng(8)
    levels = rng.integers(0, 256, 1 << lf.CELL_BITS).astype(np.uint8)
    met = 0
    for n in (1, 2, 5, 9, 60, 500, 3000):
        for _ in range(40):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            b = a[: n - int(rng.integers(0, n // 5 + 1))]
            b = np.concatenate([b, rng.integers(0, 1 << 63, int(rng.integers(0, n // 5 + 1)), dtype=np.uint64)])
            both, either = len(set(a.tolist()) & set(b.tolist())), len({*a.tolist(), *b.tolist()})
            assert lf.parted(lf.parities(a), lf.parities(b)) <= either - both
            if 100 * both >= lf.SHARE * either:
                met += 1
                x, y = (lf.front(z, levels).tolist() for z in (a, b))
                first = [(len(a) - i, len(b) - y.index(v)) for i, v in enumerate(x) if v in y]
                assert any(180 * min(p) >= 80 * (len(a) + len(b)) for p in first)
    assert met > 100


def test_ties_nulls_repeats_and_empty(spark):
    rows = [(5, "a b c"), (5, "a b c"), (None, "a b c"), (7, "A B\tC"), (5, "z z z"), (None, "q r s"), (None, None), (9, None), (3, "z z")]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []


def test_neighbours_across_tasks_are_those_of_one_task():
    rng = np.random.default_rng(3)
    n = 400
    rows = {"tree": np.sort(rng.integers(0, 3, n).astype(np.int32)), "cls": np.arange(n), "root": rng.integers(0, 40, n), "s0": rng.integers(0, 2, n), "s1": rng.integers(0, 2, n)}
    rows["head"] = np.sort(rng.integers(0, 9, n)) + 100 * rows["tree"]
    for near in (1, 4):
        pairs, far = lf._neighbours(rows, n, near)
        want = {(min(a, b), max(a, b)) for x, y in pairs for a, b in zip(x.tolist(), y.tolist(), strict=True)}
        for cuts in ([100, 300], [3, 5, 9, 200, 201, 399], [*range(0, 400, 7)]):
            got, beyond, ends = set(), set(), []
            edges = [0, *[c for c in cuts if c], n]
            for part, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                piece = {c: x[a:b] for c, x in rows.items()}
                inner, out = lf._neighbours(piece, b - a, near)
                got |= {(min(x + a, y + a), max(x + a, y + a)) for p, q in inner for x, y in zip(p.tolist(), q.tolist(), strict=True)}
                beyond |= {x + a for x in out.tolist()}
                at = sorted({*range(min(near + 1, b - a)), *range(max(0, b - a - near - 1), b - a)})
                ends.append(pa.table({**{c: x[at] for c, x in piece.items()}, "part": np.full(len(at), part), "place": np.array(at)}))
            across, more = lf._across(pa.concat_tables([*ends, ends[0]]), near)
            got |= set(zip(across["a"].to_pylist(), across["b"].to_pylist(), strict=True))
            assert got == want and beyond | set(more["cls"].to_pylist()) == set(far.tolist())


def test_signatures_estimate_the_share():
    rng = random.Random(1)
    a = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    b = list(a)
    for k in rng.sample(range(2000), 60):
        b[k] = "changed"
    x, y = (lf.shingles(" ".join(w).encode()) for w in (a, b))
    sigs = [lf.signature(np.fromiter(map(xxhash.xxh64_intdigest, s), np.uint64, len(s))) for s in (x, y)]
    share = len(x & y) / len(x | y)
    assert abs((sigs[0] == sigs[1]).mean() - share) < 0.12
    apart = lf.differing(*lf.sketch(np.stack(sigs))).sum()
    assert abs(apart / 128 - (1 - share) / 2) < 0.1


def test_pairs_and_rows_of_a_growing_dense_group(spark):
    """A set has NEAR neighbours a side in each order however large its group is, and its ends are found without doubling rows."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    counts = []
    for n in (150, 600):
        rows = []
        for k in range(n):
            some = base.copy()
            some[rng.integers(0, 120, 12)] = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
            rows.append((k, k, bytearray(lf.signature(some).tobytes())))
        pairs, far = lf.candidates(spark.createDataFrame(rows, "cls bigint, root bigint, sig binary"), 2)
        made = lf.ends(pairs)
        want = {r[c] for r in pairs.collect() for c in (0, 1)}
        assert {r[0] for r in made.distinct().collect()} == want and made.count() == 2 * pairs.count()
        assert "Generate" not in made.distinct()._jdf.queryExecution().toString()
        counts.append(pairs.count())
        assert counts[-1] <= 2 * lf.TREES * n and 0 < far.count() <= lf.TREES * n
    assert counts[1] < 8 * counts[0]  # a square would give sixteen times as many


def test_hubs_are_joined_apart_from_where_they_are_found(spark, monkeypatch):
    rng = np.random.default_rng(6)
    sigs = [lf.signature(rng.integers(0, 1 << 63, 40, dtype=np.uint64)) for _ in range(2)]
    sigs = [bytearray(sigs[k // 6].tobytes()) for k in range(12)]
    classes = spark.createDataFrame(list(enumerate(sigs)), "cls bigint, sig binary")
    far = spark.createDataFrame([(0, k // 6, k) for k in range(12)], "tree int, head bigint, cls bigint")
    links = spark.createDataFrame([(0, 1), (0, 2), (6, 7)], "a bigint, b bigint")
    roots = spark.createDataFrame([(1, 0), (2, 0), (7, 6), (0, 0), (6, 6)], "v bigint, root bigint")
    plans, staged = {}, lf.staged
    monkeypatch.setattr(lf, "staged", lambda df, tag: plans.update({tag: df._jdf.queryExecution().optimizedPlan().toString()}) or staged(df, tag))
    got = {tuple(r)[:2] for r in lf._hubs(far, links, roots, classes).collect()}
    hub = min(got)[0], max(got)[0]
    assert hub[0] == 0 and hub[1] in (6, 7) and got == {(min(hub[k // 6], k), max(hub[k // 6], k)) for k in (3, 4, 5, 8, 9, 10, 11)}
    assert "max(struct(" not in plans["hubs"]  # else the regions' rows meet in the tasks that find the hubs
