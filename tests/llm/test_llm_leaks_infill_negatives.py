"""FM-index, benchmark spans, fill-in-the-middle and hard negatives against brute force and on odd rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.llm import benchmark_leaks, fm_index, hard_negatives, infill

DOCS, ITEMS, VECTORS = "doc_id long, text string", "item_id long, text string", "vec_id long, embedding array<float>, label int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def folded(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leaks(docs, items, width):
    """Brute force: per document its words, the words hit and the items found."""
    out = {}
    for doc, text in docs:
        words, hit, met = folded(text), set(), set()
        for item, phrase in items:
            p = folded(phrase)
            m = min(width, len(p))
            windows = {tuple(p[i:i + m]) for i in range(len(p) - m + 1)} if p else set()
            for k in range(len(words) - m + 1):
                if m and tuple(words[k:k + m]) in windows:
                    hit |= set(range(k, k + m))
                    met.add("" if item is None else str(item))
        out[doc] = (len(words), len(hit), sorted(met))
    return out


def shown(rows):
    return {r.doc_id: (r.n_words, sum(s.end - s.begin for s in r.spans), r["items"]) for r in rows}


def test_index_equals_brute_force():
    r = random.Random(1)
    for _ in range(120):
        docs = [[r.randint(1, 4) for _ in range(r.randint(0, 12))] for _ in range(r.randint(1, 6))]
        symbols = np.array([x for d in docs for x in [*d, 0]])
        phrases = [p for p in ([r.randint(1, 4) for _ in range(r.randint(1, 4))] for _ in range(20)) if max(p) <= symbols.max()]
        if not phrases:
            continue
        size = np.array([len(p) for p in phrases])
        index = fm_index.FMIndex(symbols, 3)
        low, high = index.search(np.concatenate(phrases), np.cumsum(size) - size, size)
        got = [set() for _ in phrases]
        for which, place in index.occurrences(np.minimum(low, high), high):
            for k, at in zip(which.tolist(), place.tolist()):
                got[k].add(at)
        assert got == [{i for i in range(len(symbols)) if symbols[i:i + len(p)].tolist() == p} for p in phrases]


def test_equal_upper_bits_of_hashes_are_told_apart():
    h = np.array([(7 << 40) + k for k in (5, 9, 5, 1, 9)], dtype=np.uint64)
    known, numbers = fm_index.numbered(h)
    assert known.tolist() == sorted(set(h.tolist())) and known[numbers].tolist() == h.tolist()


@pytest.mark.parametrize("width, shard, block", [(3, 4_000_000, 2_000_000), (3, 80, 2_000_000), (4, 80, 6)])
def test_leaks_equal_brute_force(spark, monkeypatch, width, shard, block):
    r = random.Random(width + block)
    monkeypatch.setattr(benchmark_leaks, "SHARD_BYTES", shard)
    text = lambda n: "".join(r.choice(["a", "B", "é1", "c"]) + r.choice([" ", "-", ". ", "\n"]) for _ in range(n))
    items = [(i, text(r.randint(1, 9))) for i in range(6)] + [(None, "c c a"), (2, "B B B"), (7, ""), (8, None), (9, "?!")]
    docs = [(i, text(r.randint(0, 60))) for i in range(30)] + [(100, None), (101, ""), (102, "x" * 500), (103, "z z z")]
    got = shown(benchmark_leaks.contamination(spark.createDataFrame(docs, DOCS).repartition(2), spark.createDataFrame(items, ITEMS), width, block).collect())
    assert got == leaks(docs, items, width)


def test_leaks_of_odd_tables(spark):
    long = "alpha " * 900_000 + "one two three four five six seven eight nine ten " + "beta" * 10
    docs = spark.createDataFrame([(1, long), (1, long), (None, None), (2, "w" * 5_000_000)], DOCS).withColumns({c: F.lit("x") for c in ("spans", "items", "_row", "n_words")})
    bench = spark.createDataFrame([(5, "One two three FOUR five six seven, eight nine ten")], ITEMS).withColumn("item", F.lit(1))
    rows = benchmark_leaks.contamination(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.n_words, len(r.spans)) for r in rows) == [(0, 0, 0), (1, 900_011, 1), (1, 900_011, 1), (2, 1, 0)]
    assert benchmark_leaks.contamination(docs.where("false"), bench).count() == 0
    assert all(not r["items"] for r in benchmark_leaks.contamination(docs, bench.where("false")).collect())
    out = benchmark_leaks.decontaminated(docs, bench)
    assert out.columns == docs.columns and sorted(len(r.text or "") for r in out.collect()) == sorted(len(t or "") for t in (long.replace("one two three four five six seven eight nine ten", ""),) * 2 + (None, "w" * 5_000_000))


def units(text):
    return re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)


def test_units_equal_the_pattern():
    r = random.Random(3)
    for _ in range(400):
        text = "".join(r.choice(" \t\n\x0e\x08ab\x80é日😀\x00!~\x7f") for _ in range(r.randint(0, 40)))
        own, want, raw = infill.Units(text.encode()), units(text), text.encode()
        assert own.count == len(want)
        for k in range(len(want) + 1):
            part = "".join(want[:k])
            assert raw[:own.end(k)].decode() == part and own.characters(own.end(k)) == [len(part)]


def test_infill_restores_every_text(spark):
    r = random.Random(5)
    text = lambda n: "".join(r.choice(["word", " ", "é", "\n", "<", ">", "P", "日 "]) for _ in range(n))
    rows = [(i, text(r.randint(0, 80))) for i in range(300)] + [(None, "no id here"), (400, None), (401, "has <S> in it"), (402, "x" * 5_000_000), (403, "w " * 2_500_000), (7, "same"), (7, "same")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("n", "form", "output")})
    out = infill.transformed(docs, rate=90).withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect()
    texts = {(i, t or "") for i, t in rows}
    assert len(out) == len(rows) and all((o.doc_id, o.again) in texts for o in out)
    assert {"psm", "spm", "plain"} == {o.form for o in out} and all(o.form == "plain" for o in out if o.doc_id in (400, 401))
    for o in out[:300]:
        if o.form != "plain":
            one, two, *_ = infill.numbers(o.doc_id, 42)
            u = units(o.again)
            a, b = sorted((one % (len(u) + 1), two % (len(u) + 1)))
            assert (o.n, o.prefix_chars, o.middle_chars) == (len(u), len("".join(u[:a])), len("".join(u[a:b])))
    assert infill.transformed(docs.where("false")).count() == 0


def negatives(rows):
    """Brute force over plain lists; every row for itself."""
    sound = [(k, i, (l + 1) % 10 if i is not None and i % 7 == 0 else l, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for k, (i, v, l) in enumerate(rows)
             if l is not None and v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    out = []
    for ka, a, la, qa in sound:
        if a is None or a % 50:
            continue
        near = sorted((-sum(x * y for x, y in zip(qa, q)), i is None, i or 0, k, l) for k, i, l, q in sound if k != ka)
        for p in [n for n in near if n[4] == la][:5]:
            fit = [n for n in near if n[4] != la and 50 * -p[0] <= 100 * -n[0] <= 95 * -p[0]][:3]
            out += [(a, None if p[1] else p[2], k + 1, None if n[1] else n[2], -p[0], -n[0]) for k, n in enumerate(fit)]
    return sorted(out, key=str)


@pytest.mark.parametrize("dims, size", [(64, 1.0), (5, 1.0), (12, 1e6), (3, 0.02)])
def test_negatives_equal_brute_force(spark, monkeypatch, dims, size):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "ROWS_AT_ONCE", 37)
    r = random.Random(dims)
    vector = lambda n: [float(np.float32(r.uniform(-0.3, 1) * size)) for _ in range(n)]
    rows = [(i, vector(dims), r.randint(0, 9)) for i in range(400)]
    rows += [(1000 + i, rows[50][1], i % 10) for i in range(60)] + [(50, rows[50][1], 3), (None, vector(dims), 1), (None, vector(dims), 2), (800, None, 1), (801, vector(dims), None), (802, [None], 1), (803, [float("nan")], 1), (850, [float("inf")], 1), (900, [], 4), (950, vector(dims - 2), 4)]
    table = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("uid", "q", "at", "score")})
    got = sorted((tuple(x) for x in hard_negatives.mined(table.repartition(3)).collect()), key=str)
    assert got == negatives(rows)
    assert hard_negatives.mined(table.where("false")).count() == 0 and hard_negatives.mined(table.where("vec_id % 50 <> 0")).count() == 0


def test_huge_components_give_a_result(spark):
    rows = spark.createDataFrame([(50, [3e38, -3e38], 1), (1, [3e38, 1.0], 1), (2, [1.0, 1.0], 2)], VECTORS)
    assert hard_negatives.mined(rows).columns[0] == "anchor_id" and hard_negatives.mined(rows).count() >= 0
