import random
import re

import numpy as np
import pytest
from tarn.llm import near_dedup as nd
from tarn.llm.graph import connected_components
from tarn.llm import shingles
from tarn.llm.shingles import MinHash

SCHEMA = "doc_id long, text string, kept string, label string"


def shingle_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} - {()} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width, percent):
    sets = [shingle_set(r[1], width) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


def corpus(seed, groups=12, most=25):
    rnd, rows = random.Random(seed), []
    word = lambda: "".join(rnd.choice("abcdefghijÄé") for _ in range(rnd.randrange(1, 6)))
    for _ in range(groups):
        base = [word() for _ in range(rnd.choice([3, 8, 60, 120]))]
        for _ in range(rnd.randrange(1, most)):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5, 9])):
                own[rnd.randrange(len(own))] = word()
            rows.append(" ".join(own))
    rows += ["", None, " \n ", "Solo", "solo", "SOLO \t", "two words", "Two\nWords", "x " * 30_000, "x " * 29_000]
    rnd.shuffle(rows)
    return [(i * 3 + 1, t, "x", None) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("width", "percent", "seed"), [(3, 85, 1), (5, 80, 2)])
def test_classes_against_all_pairs(spark, width, percent, seed):
    rows = corpus(seed)
    got = nd.near_duplicate_classes(spark.createDataFrame(rows, SCHEMA), nd.NearDedup(width=width, percent=percent)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, width, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("hub_rounds", [0, 1, 3])
def test_groups_over_several_parts_and_without_hubs(spark, hub_rounds):
    rows = corpus(7, groups=2, most=80)
    settings = nd.NearDedup(width=3, percent=85, hub_nodes=3, part_nodes=5, part_shingles=900, hub_rounds=hub_rounds)
    got = nd.near_duplicate_classes(spark.createDataFrame(rows, SCHEMA), settings).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 85)


def test_a_chain_that_no_hub_covers(spark):
    words = [f"w{k}" for k in range(300)]
    rows = [(100 - k, " ".join(words[4 * k : 4 * k + 60]), "x", None) for k in range(40)]  # each is linked with its neighbours only
    got = nd.near_duplicate_classes(spark.createDataFrame(rows, SCHEMA), nd.NearDedup(width=3, percent=85, hub_nodes=2, part_nodes=4)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 85)


def test_edges(spark):
    assert nd.near_duplicate_classes(spark.createDataFrame([], SCHEMA)).collect() == []
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (None, "alone by itself it stands here"), (None, None), (7, None), (7, "")]
    rows += [(11, a), (11, b), (12, a + " tail"), (13, b + " tail"), (None, b + " end")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in nd.near_duplicate_classes(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)).collect()), key=str)
    want = [(2, 2, True), (4, 2, False), (4, 2, False), (7, 7, True), (7, 7, True), (11, 11, True), (11, 11, True), (12, 11, False), (13, 11, False)]
    want += [(None, 2, False), (None, 2, False), (None, 11, False), (None, None, True), (None, None, True)]
    assert got == sorted(want, key=str)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 200)] + [(500, 500), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(200)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_odd_sketch_estimates_high_similarity():
    rnd, s = np.random.Generator(np.random.PCG64(1)), nd.NearDedup()
    minhash, errors = MinHash(s.size), []
    for true in (0.8, 0.9, 0.97):
        for _ in range(40):
            common = rnd.integers(0, 1 << 62, int(1000 * true), dtype=np.uint64)
            rest = (1000 - len(common)) // 2
            a, b = (np.concatenate([common, rnd.integers(0, 1 << 62, rest, dtype=np.uint64)]) for _ in range(2))
            x, y = (nd.odd_sketch(minhash.of(v), s.sketch_bits) for v in (a, b))
            flips = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
            errors.append(nd.estimated_jaccard(flips, s.size, s.sketch_bits) - true)
            assert flips <= s.most_flips
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def opposite_words(letters, size):
    """A Thue-Morse word over two letters and its opposite: they collide under every polynomial modulo a power of two."""
    a, b = letters
    while len(a) < size:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("size", [8, 32, 64, 1024, 4096])
def test_words_do_not_collide_by_construction(size):
    pair = [w.encode() for w in opposite_words("ab", size)]
    found, _ = shingles.words(np.frombuffer(b"".join(pair), np.uint8), np.array([0, size, 2 * size]))
    assert len(set(found.tolist())) == 2


def test_texts_with_such_words_are_not_linked(spark):
    a, b = opposite_words("ab", 1024)
    got = nd.near_duplicate_classes(spark.createDataFrame([(1, f"{a} x y"), (2, f"{b} x y")], "doc_id long, text string"), nd.NearDedup(width=3, percent=85)).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in got)


@pytest.mark.parametrize("piece", [7, 40, 1 << 19])
def test_words_of_texts_cut_into_pieces(monkeypatch, piece):
    monkeypatch.setattr(shingles, "PIECE_BYTES", piece)
    rnd = random.Random(piece)
    texts = ["".join(rnd.choices(["a", "B", "é", " ", "\n", "中", "x" * 9, "y" * 70, "\x0b"], k=rnd.randrange(60))) for _ in range(400)]
    raw = [t.encode() for t in texts]
    found, at = shingles.words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    hash_of, word_of = {}, {}
    for k, text in enumerate(texts):
        want = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert at[k + 1] - at[k] == len(want)
        for w, h in zip(want, found[at[k] : at[k + 1]].tolist(), strict=True):
            assert hash_of.setdefault(w, h) == h and word_of.setdefault(h, w) == w
