import random
import re
from itertools import combinations

import numpy as np

from tokenloom.llm import near_dup as N
from llm_fixtures import docs_of  # noqa: F401

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        base = rng.choices(vocab, k=rng.choice([4, 8, 30, 60, 200]))
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows) * 3 + 1, rng.choice([" ", "  ", "\n"]).join(w)))
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(docs_of):
    for seed, k, percent in ((1, 3, 85), (2, 5, 80)):
        rows = corpus(seed) + [(5000, None), (5002, ""), (5005, " \n\t"), (5008, "One"), (5009, "one"), (5010, "One two"), (5011, "a b c"),
                               (5012, "A b\x0cC")]
        want = brute(rows, k, percent)
        got = {r.doc_id: r for r in N.near_duplicates(docs_of(rows), k=k, percent=percent).collect()}
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_chain_and_many_pivot_rounds(docs_of, monkeypatch):
    """Texts that drift step by step link in a chain; one pivot at a time must still find every link."""
    monkeypatch.setattr(N, "MORE_PIVOTS", 2)
    words = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(14):
        rows.append((100 - i, " ".join(words)))
        for j in range(2):
            words[(7 * i + 60 * j) % 120] = f"n{i}-{j}"
    got = {r.doc_id: r.component_id for r in N.near_duplicates(docs_of(rows)).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 3, 85).items()}


def near_copies(seed, n, edits, size=200):
    """Copies of one text with a few words changed, each in its own way: they share bands with many others."""
    rng = random.Random(seed)
    base = rng.choices([f"w{i}" for i in range(400)], k=size)
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(size)] = f"n{rng.randrange(10 ** 9)}"
        rows.append((3 * i + 1, " ".join(w)))
    return rows


def test_rows_of_a_group_of_near_copies(docs_of, monkeypatch, tmp_path):
    """What is sent to be compared is a few rows per text of the group, not one per text and bucket."""
    likely = N._likely

    def counted(threshold):
        step = likely(threshold)

        def run(batches):
            def seen():
                for b in batches:
                    with open(f"{tmp_path}/rows", "a") as f:
                        f.write(f"{b.num_rows}\n")
                    yield b
            yield from step(seen())
        return run
    monkeypatch.setattr(N, "_likely", counted)
    rows = near_copies(3, 80, 1)
    got = {r.doc_id: r.component_id for r in N.near_duplicates(docs_of(rows), k=5, percent=80).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 5, 80).items()}
    sent = sum(int(x) for x in (tmp_path / "rows").read_text().split())
    assert sent <= 16 * len(rows), sent


def test_small_and_large_buckets_in_all_rounds(docs_of, monkeypatch):
    """Buckets below and above the number of pivots, dealt to several tasks or not, link the same texts."""
    rows = near_copies(4, 40, 12) + [(i + 1000, t) for i, t in near_copies(5, 30, 9)] + [(i + 2001, t) for i, t in corpus(6)]
    want = {i: c for i, (_, c) in brute(rows, 5, 80).items()}
    assert len(set(want.values())) > 10
    for more, group in ((2, 4096), (4, 3), (32, 4096)):
        monkeypatch.setattr(N, "MORE_PIVOTS", more)
        monkeypatch.setattr(N, "GROUP", group)
        assert {r.doc_id: r.component_id for r in N.near_duplicates(docs_of(rows), k=5, percent=80).collect()} == want


def test_odd_rows(docs_of):
    text = "a b c d e f g"
    rows = [(1, text), (1, text), (None, text), (None, None), (2, text.upper()), (9, "q " * 200_000)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(docs_of(rows)).collect()), key=str)
    assert got == sorted([(1, 5, 1, True), (1, 5, 1, True), (None, 5, None, True), (None, 0, None, True), (2, 5, 1, False), (9, 1, 9, True)], key=str)
    assert N.near_duplicates(docs_of([])).collect() == []


def test_estimate_is_close():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        err = []
        for _ in range(60):
            u = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2))
            both = int(len(u) * share)
            a, b = u.copy(), np.unique(np.concatenate((u[rng.permutation(len(u))[:both]],
                                                       rng.integers(0, 1 << 63, 10).astype(np.uint64) * np.uint64(2) + np.uint64(1))))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            j, _ = N.estimate(N.sketch(a)[None], N.sketch(b)[None], np.array([len(a)]), np.array([len(b)]))
            err.append(j[0] - true)
        assert abs(np.mean(err)) < 0.02


def test_band_rows_miss_little():
    for t in (0.8, 0.85, 0.9):
        r = N.band_rows(t)
        assert (1 - t ** r) ** (N.BUCKETS // r) <= 1e-6
