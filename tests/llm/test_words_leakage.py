import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from countgrid.llm.leakage import BlockIndex, find_leaks, item_window, simhash, weighted_similarity
from countgrid.llm.words import batches, words_of

WORD = re.compile(r"[^\W_]+")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="aB1 _-é中\n", max_size=30)), max_size=8))
def test_words_are_those_of_a_regular_expression(texts):
    found = words_of(pa.array(texts, pa.string()))
    seen = {}
    for t, text in enumerate(texts):
        own = slice(found.bounds[t], found.bounds[t + 1])
        want = WORD.findall(text or "")
        assert found.lengths[own].tolist() == [len(w) for w in want]
        for word, h in zip(want, found.hashes[own].tolist()):
            key = "".join(c.lower()[0] for c in word)
            assert seen.setdefault(key, h) == h
    assert len(set(seen.values())) == len(seen)


def test_batches_are_whole_texts():
    texts = pa.array(["a" * 5, None, "", "b" * 30, "c"])
    assert [(f, t.to_pylist()) for f, t in batches(texts, 10)] == [(0, ["a" * 5, None, ""]), (3, ["b" * 30]), (4, ["c"])]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 20), st.integers(0, 60), st.integers(0, 2**32))
def test_simhash_is_the_bitwise_majority(window, n, seed):
    h = np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64)
    bits = ((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(int)
    want = [sum(int(c > window // 2) << b for b, c in enumerate(bits[i : i + window].sum(0))) for i in range(n - window + 1)]
    assert simhash(h, window).tolist() == want


def test_block_index_finds_all_within_the_radius():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    noise = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(600)], np.uint64)
    query = base[rng.integers(0, 300, 600)] ^ noise
    for radius in (0, 1, 2, 3):
        a, b = BlockIndex(base, radius).near(query)
        want = np.argwhere(np.bitwise_count(query[:, None] ^ base[None, :]) <= radius)
        assert sorted(zip(a.tolist(), b.tolist())) == sorted(map(tuple, want.tolist()))


def test_weighted_similarity():
    a = np.arange(12, dtype=np.uint64)[None, :]
    w = np.ones((1, 8))
    assert weighted_similarity(a, a, w)[0] == 1.0
    b = a.copy()
    b[0, 11] = 99  # one of eight shingles differs on either side
    assert abs(weighted_similarity(a, b, w)[0] - 7 / 9) < 1e-12


def brute(docs, items, n=12):
    grams = lambda t: {tuple(w[i : i + n]) for w in [WORD.findall((t or "").lower())] for i in range(len(w) - n + 1)}
    return {(d, i) for d, t in docs for i, s in items if d is not None and i is not None and grams(t) & grams(s)}


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(30)] + ["Été", "中文", "x1"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(5, 60)), "s") for i in range(25)] + [(90, None, "s"), (91, "", "s"), (None, text(30), "s")]
    items.append((92, items[3][1], "other suite"))
    docs = []
    for d in range(120):
        body = text(rng.randint(0, 80)).split()
        if rng.random() < 0.6:
            source = (rng.choice(items[:25])[1]).split()
            at, n = rng.randint(0, max(0, len(source) - 12)), rng.choice([11, 12, 20])
            place = rng.randint(0, len(body))
            body[place:place] = [w.upper() + rng.choice([",", "", "\n#"]) for w in source[at : at + n]]
        docs.append((d, " ".join(body), d))
    docs += [(500, None, 1), (501, "", 1), (None, items[0][1], 1), (502, "word " * 200_000, 1)] + docs[:20]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame(items, "item_id bigint, item_text string, doc_id string")
    want = brute([x[:2] for x in docs[:124]], [x[:2] for x in items])
    for chunk in (200_000, 100):
        got = find_leaks(d, i, min_similarity=1.0, chunk_passages=chunk).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    near = {(r["doc_id"], r["item_id"]) for r in find_leaks(d, i, radius=3, min_similarity=0.6).collect()}
    assert find_leaks(d, i, window=None).count() >= 0
    assert want <= near
    assert find_leaks(d.limit(0), i).count() == 0 == find_leaks(d, i.limit(0)).count()


def test_item_window_is_the_largest_of_its_series():
    sizes = [24, 34, 48, 68, 96, 136, 192]
    for n in range(200):
        assert item_window(n) == max((w for w in sizes if w <= n), default=0)


def test_edited_copies_of_items_are_found(spark):
    """Copies with one changed word from 50 words, and with two from 100, inside other text; and what must not be found."""
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, text(rng.randint(50, 95))) for i in range(60)] + [(100 + i, text(rng.randint(100, 130))) for i in range(60)] + [(300, text(20))]
    docs, want = [], set()
    for i, words in items[:-1]:
        copy = list(words)
        for at in rng.sample(range(len(copy)), 1 if i < 100 else 2):
            copy[at] = "changed"
        docs.append((i, " ".join(text(40) + copy + text(rng.randint(0, 60)))))
        docs.append((1000 + i, " ".join(text(150))))
        want.add((i, i))
    docs.append((5000, " ".join(items[3][1])))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id bigint, item_text string")
    rows = find_leaks(d, i, window=None).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert got <= want | {(5000, 3)} and (5000, 3) in got and len(got & want) >= 0.9 * len(want)
    assert {r["similarity"] for r in rows if r["doc_id"] == 5000} == {1.0}
    assert got == {(r["doc_id"], r["item_id"]) for r in find_leaks(d, i, window=None, chunk_passages=40).collect()}
