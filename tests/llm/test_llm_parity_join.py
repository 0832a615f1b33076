import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tallyscope.llm import common, parity_join as J
from tallyscope.llm.common import set_id, shingles, word_hashes


def brute(docs):
    """doc_id -> (set size, smallest id reachable), from plain sets of word tuples."""
    sets = {}
    for i, t in docs:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def families(seed, groups=14, size=16):
    """Documents around common bases with edits that straddle the threshold, chains and shared passages."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    passage = [word() for _ in range(60)]
    docs = []
    for g in range(groups):
        base = [word() for _ in range(r.choice([3, 6, 9, 20, 40, 90, 200]))]
        if g % 3 == 0:
            base[len(base) // 2:len(base) // 2] = passage
        for k in range(size):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                own[r.randrange(len(own))] = word()
            base = own if g % 2 and k % 3 == 0 else base
            docs.append(" ".join(own))
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    docs = families(seed) + [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "One two"), (9005, "one TWO"), (9006, "x " * 3000)]
    got = J.jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs)


def test_keep_one_of_each_group_and_all_empty_rows(spark):
    rows = [(3, "a b c d e f", "x", 1), (1, "a b c d e f", "y", 2), (1, "a b c d e f", "y", 2), (5, None, "z", 3), (6, "", "z", 4), (None, "q r s", "w", 5), (7, "q r s", "w", 6)]
    kept = J.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n string, key long")).collect()
    assert sorted((r.doc_id or -1, r.n, r.key) for r in kept) == [(1, "y", 2), (5, "z", 3), (6, "z", 4), (7, "w", 6)]
    assert J.jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rounds_find_all_pairs_in_any_batching():
    r = np.random.default_rng(3)
    values = [np.unique(r.integers(0, 1 << 62, 30).astype(np.uint64)) for _ in range(12)]
    keys = np.sort(r.integers(0, 4, 60))
    rows = sorted({(int(k), int(r.integers(0, 12))) for k in keys})
    want = {(a, b) for k, g in itertools.groupby(rows, key=lambda x: x[0]) for a, b in itertools.combinations([s for _, s in g], 2)}
    doubled = sorted(rows + rows[::3])
    for cut in (1, 2, 3, 7, 100):
        def batches(extra=None, source=doubled):
            for i in range(0, len(source), cut):
                part = source[i:i + cut]
                columns = {"key": pa.array([k for k, _ in part]), "set_id": pa.array([s for _, s in part]), "n": pa.array([30] * len(part), pa.int32())}
                yield pa.RecordBatch.from_pydict(columns)
        out = [x for b in J._first_round(batches()) for x in b.to_pylist()]
        pairs = {(x["a"], x["b"]) for x in out if x["key"] is None}
        members = sorted({(x["key"], x["a"]) for x in out if x["key"] is not None})
        sizes = {k: len({s for q, s in rows if q == k}) for k, _ in rows}
        assert members == [x for x in rows if sizes[x[0]] >= 3]

        def later(low, high):
            def source():
                for i in range(0, len(members), cut):
                    part = members[i:i + cut]
                    yield pa.RecordBatch.from_pydict({
                        "key": pa.array([k for k, _ in part]), "a": pa.array([s for _, s in part]), "n": pa.array([30] * len(part), pa.int32()), "label": pa.array([s for _, s in part]),
                        "sketch": pa.array([J.bit_sketch(values[0])] * len(part), pa.binary())})
            return {(x["a"], x["b"]) for b in J._later_round(low, high)(source()) for x in b.to_pylist()}
        low = 1
        while low < 12:
            pairs |= later(low, low * 8)
            low *= 8
        assert pairs == want


def test_sketch_distance_is_a_lower_bound():
    r = np.random.default_rng(1)
    for _ in range(50):
        pool = r.integers(0, 1 << 62, 400).astype(np.uint64)
        a, b = np.unique(r.choice(pool, r.integers(1, 200))), np.unique(r.choice(pool, r.integers(1, 200)))
        assert J.hamming(J.bit_sketch(a), J.bit_sketch(b)) <= len(np.setxor1d(a, b))


def test_word_hashes_follow_the_words():
    a = word_hashes("Ab c\x0bDE\t  é \n".encode())
    assert len(a) == 4 and (a == word_hashes("aB C de é".encode())).all() and len(set(a.tolist())) == 4
    long = ("x" * 100 + " " + "x" * 101).encode()
    assert len(set(word_hashes(long).tolist())) == 2
    assert len(shingles(word_hashes(b"a b c"))) == 1 and set_id(shingles(word_hashes(b""))) is not None


@pytest.mark.parametrize("seed", range(6))
def test_pairs_that_wait_for_a_smaller_block_are_not_lost(seed):
    r = np.random.default_rng(seed)
    rows = sorted({(int(k) + 1, int(s)) for k, s in zip(r.integers(0, 9, 400), r.integers(0, 40, 400))})
    of_key = {k: [s for _, s in g] for k, g in itertools.groupby(rows, key=lambda x: x[0])}
    want = {p for g in of_key.values() for p in itertools.combinations(g, 2)}
    sketch = J.bit_sketch(np.arange(30, dtype=np.uint64))
    pairs, made, plain = {(g[0], s) for g in of_key.values() for s in g[1:]}, 0, 0
    low = 1
    while low < 40:
        members = [x for x in rows if len(of_key[x[0]]) > max(low, 2)]
        smaller = [[k for k, s in members if s == own and k < key] for key, own in members]
        columns = {
            "key": [k for k, _ in members], "a": [s for _, s in members], "n": np.full(len(members), 30, np.int32), "label": [s for _, s in members], "sketch": [sketch] * len(members),
            "before": pa.array([x[-1] if x else 0 for x in smaller], pa.int64()), "before2": pa.array([x[-2] if len(x) > 1 else 0 for x in smaller], pa.int64())}
        run = lambda names: [(x["a"], x["b"]) for b in J._later_round(low, low * 4)(iter([pa.RecordBatch.from_pydict({c: columns[c] for c in names})])) for x in b.to_pylist()]  # noqa: E731,B023
        found = run(columns)
        pairs.update(found)
        made, plain = made + len(found), plain + len(run(list(columns)[:5]))
        low *= 4
    assert pairs == want and made < plain


def test_sketches_of_large_sets_are_short_and_still_tell_unlike_sets_apart():
    rng = np.random.default_rng(11)
    for size in (600, 1000, 5000):
        a, b = (np.unique(rng.integers(0, 1 << 62, size, dtype=np.uint64)) for _ in range(2))
        near = np.unique(np.concatenate((a[:-size // 10], b[:size // 10])))
        sketch = J.bit_sketch(a)
        assert 8 * len(sketch) < 2 * size  # one to two bits a shingle
        assert 7 * J.hamming(sketch, J.bit_sketch(b)) > 2 * size
        assert 7 * J.hamming(sketch, J.bit_sketch(near)) <= len(a) + len(near)


def test_sets_of_many_texts_at_once_equal_those_of_each_text():
    r = random.Random(5)
    texts = [b"", b" \t", b"One", b"a b c D", b"a b c d e", "é ".encode() * 40, b"x" * 70 + b" y z u v w", b"a b c d e", b"m" * 300_000]
    texts += [" ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(0, 700))).encode() for _ in range(200)]
    column = pa.array([None, *texts], pa.binary()).slice(1)
    parts = list(common.text_parts(column, 5000))
    assert [t for _, p in parts for t in p] == texts and [b for b, _ in parts] == np.cumsum([0] + [len(p) for _, p in parts])[:-1].tolist()
    assert all(len(p) == 1 or sum(map(len, p)) <= 5000 for _, p in parts)
    frequent = J.Frequent(np.unique(np.concatenate([shingles(word_hashes(t))[::3] for t in texts[:40]])))
    for some in (texts, texts[:2], [texts[4]], []):
        values, bounds = common.shingle_sets(some)
        own = [shingles(word_hashes(t)) for t in some]
        assert [values[x:y].tolist() for x, y in itertools.pairwise(bounds)] == [x.tolist() for x in own]
        assert common.set_ids(values, bounds).tolist() == [set_id(x) for x in own]
        assert J.bit_sketches(values, bounds) == [J.bit_sketch(x) for x in own]
        assert frequent.has(values).tolist() == np.isin(values, frequent.values).tolist()
        keys, of = J.block_keys(values, bounds, frequent)
        alone = [set(J.block_keys(x, np.array([0, len(x)]), frequent)[0].tolist()) for x in own]
        assert [set(keys[of == i].tolist()) for i in range(len(some))] == alone


def test_python_calls_of_a_task_do_not_grow_with_its_small_texts():
    calls = []
    for rows in (500, 2000):
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(rows)), "text": [f"a b c d e f g h {i}" for i in range(rows)], "text_hash": list(range(rows))})
        seen, plain = [], common.hashed_words
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(common, "hashed_words", lambda *x: seen.append(1) or plain(*x))
            out = pa.Table.from_batches(J._describe(iter([batch])))
        assert out.num_rows >= rows
        calls.append(len(seen))
    assert calls == [1, 1]


def test_distances_of_sketches_of_any_lengths():
    r = np.random.default_rng(2)
    sketches = [J.bit_sketch(r.integers(0, 1 << 62, n, dtype=np.uint64)) for n in r.integers(1, 900, 80)]
    i, j = r.integers(0, 80, (2, 500))
    got = J._distances([sketches[x] for x in i], [sketches[x] for x in j])
    assert got.tolist() == [J.hamming(sketches[x], sketches[y]) for x, y in zip(i, j)]


def test_texts_of_a_batch_are_held_in_small_parts(monkeypatch):
    held, plain = [], common.texts_of
    monkeypatch.setattr(common, "texts_of", lambda column: held.append(column.nbytes) or plain(column))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(3000)), "text": [f"{i} " * 500 for i in range(3000)], "text_hash": list(range(3000))})
    assert sum(b.num_rows for b in J._describe(iter([batch]))) >= 3000
    assert len(held) > 10 and max(held) < 2 * common.TEXTS_AT_ONCE
