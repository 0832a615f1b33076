import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.llm import archives, cube_mix, piece_viterbi, quality_rules, sentence_spans, suffix_tree, surrogates, winnowing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", None, 0), (2, "", "en", "a", 0), (3, "word " * 4000, "en", "a", 20000), (3, "word " * 4000, "en", "a", 20000), (None, "Call +1 (743) 555-3824. Or not.", "en", "b", 10), (5, "a b\n\nc d. e", None, "b", 9)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.mark.parametrize("gram, window", [(3, 4), (6, 3), (24, 40)])
def test_winnowing_equals_brute_force(gram, window):
    r = random.Random(gram)
    for _ in range(80):
        t = "".join(r.choice("ab") for _ in range(r.randint(0, 60)))
        k = min(gram, len(t))
        h = [winnowing.chosen(t[i:i + k], gram, window)[0][0] for i in range(len(t) - k + 1)] if t else []
        w, want = min(window, len(h)), set()
        for i in range(len(h) - w + 1 if h else 0):
            want.add(max(j for j in range(i, i + w) if h[j] == min(h[i:i + w])))
        assert winnowing.chosen(t, gram, window)[1].tolist() == sorted(want)


def test_winnowing_of_odd_rows(odd, spark):
    rows = winnowing.fingerprints(odd, 3).collect()
    assert len(rows) == len(ODD) and all(0 <= r.near_next <= 1 for r in rows)
    assert winnowing.fingerprints(spark.createDataFrame([], DOCS), 3).count() == 0


def test_short_texts_that_share_a_half_are_alike(spark):
    r = random.Random(8)
    lengths = [2, 3, 6, 7, 8, 12, 29, 30, 31, 47, 48, 63, 100, 125, 126, 249, 250, 251, 400]
    rows = [(i, "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))) for i, n in enumerate(lengths)]
    got = {x.doc_id: x for x in winnowing.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert all(got[i].near_edited > 0 for i in range(len(lengths)))
    text = rows[12][1]
    near = winnowing.fingerprints(spark.createDataFrame([(1, text + rows[-1][1][:149]), (2, text + rows[-1][1][:151])], "doc_id long, text string"), 1).collect()
    assert all(x.near_next > 0.9 for x in near)


def test_mix_keeps_targets_and_reruns(spark, odd):
    r = random.Random(4)
    docs = spark.createDataFrame([(i, "w " * r.randint(1, 90), r.choice("ab") if i % 3 else "c") for i in range(900)], "doc_id long, text string, source string")
    one, two = (sorted((x.doc_id, x.copies, x.size, x.source, x.target) for x in cube_mix.mix(docs, bucket_units=100).collect()) for _ in range(2))
    assert one == two and max(x[1] for x in one) <= 2
    for s in "abc":
        target, taken = next(x[4] for x in one if x[3] == s), sum(x[1] * x[2] for x in one if x[3] == s)
        assert abs(taken - target) <= 0.02 * target
    assert cube_mix.mix(odd).count() == 5 and cube_mix.mixed(odd).columns == odd.columns


def test_pieces_equal_the_model():
    import sentencepiece
    own, model = piece_viterbi.pieces(), sentencepiece.SentencePieceProcessor(model_file=piece_viterbi.MODEL)
    r = random.Random(5)
    for t in ["", " ", "  a  b\n\tc 日本 é", "\x00\x01", "a" * 300, "hello world, tokenization", *("".join(r.choice("abcdetion  THE.é\n") for _ in range(150)) for _ in range(50))]:
        ids = own.encode(t)
        assert ids.tolist() == model.encode(t) and own.decode(ids) == t


def test_quality_statistics_equal_brute_force(odd):
    for r in quality_rules.judge(odd, []).collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        covered = {i + j for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines, r.kept) == (len(w), len(covered), len(lines) - len(set(lines)), False)


def test_rules_are_learned():
    x = np.random.default_rng(0).random((600, len(quality_rules.FEATURES)))
    bad = x[:, 2] > 0.7
    rules = quality_rules.learn(x, bad, np.arange(600) % 3 == 0)
    hit = np.any([quality_rules._mask(x, t) for t in rules], axis=0)
    assert (hit == bad).mean() > 0.98


def test_spans_keep_the_first_place(spark, odd):
    a, b = "One two three four five six. Seven eight nine ten eleven. ", "Only here and nowhere else. "
    got = {r.doc_id: r.text for r in sentence_spans.deduplicated(spark.createDataFrame([(2, b + a), (1, a + "Tail of it. "), (3, a + b + a)], "doc_id long, text string"), least_words=10).collect()}
    assert got == {1: a + "Tail of it. ", 2: b, 3: ""}  # in 3, the span over b and the second a is that of 2
    assert sentence_spans.deduplicated(odd).count() == len(ODD)


def test_no_run_of_51_words_stays_in_two_documents(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    text = lambda n, ends: "".join(word() + r.choice(ends) for _ in range(n))
    short, one, lines, long = text(60, ["!! "]), text(72, " ") + "end. ", text(70, ["\n", " \n"]), text(120, " ")
    han = "".join(chr(r.randint(0x4E00, 0x9000)) + ("。" if i % 9 == 8 else "") for i in range(99))
    rows = [(10 * i + k, text(20, [" ", ". "]) + ". " * (shared is not long) + shared + text(30, [" ", ". "])) for i, shared in enumerate([short, one, lines, long, han, text(90, [" ", " ", "? "])]) for k in range(3)]
    one = "only one sentence that is here twice with more than twenty words so that it is a span all by itself anyway"
    rows += [(100, one), (101, one.capitalize())]
    got = {x.doc_id: x.text for x in sentence_spans.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    runs = Counter()
    for t in got.values():
        w = re.findall(r"[\u4e00-\u9fff]|[^\s\u4e00-\u9fff]+", t.lower().replace("。", ""))
        runs.update({tuple(w[i:i + 51]) for i in range(len(w) - 50)})
    assert got[100] and got[101] == "" and max(runs.values()) == 1
    assert all(got[10 * i] == rows[3 * i][1] for i in range(6))  # the first place stays whole
    assert "".join(sentence_spans.pieces(han + one)[0]) == han + one


def test_overlapping_repeats_leave_the_first_place(spark):
    got = sentence_spans.deduplicated(spark.createDataFrame([(1, "So it goes. " * 9)], "doc_id long, text string"), least_words=10).first()
    assert got.text == "So it goes. " * 4 and (got.n_sentences, got.n_removed) == (9, 5)


def test_surrogates_are_consistent_and_distinct(spark, odd):
    text = "Call +1 (743) 555-3824 or +1 743 555 3824, die.55@mail4.example.com; Frau Müller, 4111-1111-1111-1111. v1.2.3"
    new = surrogates.replaced(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    phones = re.findall(r"\+1[ ()\d-]{10,}", new[0].text)
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1 and "555-3824" not in new[0].text and "Müller" not in new[0].text and new[0].text.endswith("v1.2.3") and new[1].text is None
    assert surrogates.replaced(odd).count() == len(ODD)


def test_surrogates_of_full_spaces_stay_distinct(spark):
    name = lambda i: "".join("abcdefghij"[int(d)] for d in f"{i:06d}")
    rows = [("name", f"m {name(i)}") for i in range(90_000)] + [("name", f"f {chr(1072 + i % 32)}{chr(1072 + i // 32 % 32)}{chr(1072 + i // 1024)}") for i in range(500)]
    rows += [("phone", f"1{i:04d}") for i in range(5_000)] + [("phone", f"2{i:04d}") for i in range(9_000)] + [("phone", f"3{i:04d}") for i in range(10_000)] + [("phone", f"4{i:04d}") for i in range(40)]
    got = surrogates.mapping(spark.createDataFrame(rows, "kind string, canon string")).collect()
    forms, real = {(r.kind, r.form) for r in got}, set(rows)
    assert len(got) == len(rows) == len(forms) and all(r.form != r.canon for r in got)
    assert all(len(r.form) == len(r.canon) and r.form[0] == r.canon[0] for r in got if r.kind == "phone")
    assert not [r for r in got if (r.kind, r.form) in real and r.canon[0] not in "23"]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(4, "http://a/b c", "<p>é</p>"), (2, None, "<p>é</p>"), (7, "x", None), (None, "y", "q\r\n\r\nz")], "page_id long, url string, html string")
    archives.write_warc(archives.with_revisits(archives.converted(archives.as_arc(pages, 2))), str(tmp_path / "w"))
    rows = {r.page_id: r for r in archives.with_referred_pages(archives.read_warc(spark, str(tmp_path / "w"))).where("record_type <> 'warcinfo'").collect()}
    assert len(rows) == 4 and all(r.intact for r in rows.values())
    assert (rows[4].record_type, rows[4].refers_to, rows[2].record_type, rows[7].payload_bytes) == ("revisit", 2, "response", 0)
    assert [r["warc_type"] for r in archives.arc_records("f", b"filedesc://f 0.0.0.0 2000 text/plain 9\n1 0 x\nURL\nhttp://u 1.1.1.1 2000 text/html 99\nshort")][-1] == "damaged"


def test_scores_of_odd_rows(odd):
    rows = suffix_tree.score(odd).collect()
    assert len(rows) == len(ODD) and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id == 3} == {4001} and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {1}


def brute_scores(rows, depth):
    """Base columns and scores of ``(doc_id, text)`` rows by dictionaries of whole contexts."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for i, t in rows}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    count, every = Counter(w for i in words if not out[i] for w in words[i]), Counter(w for ws in words.values() for w in ws)
    texts = sum(not o for o in out.values())
    n, v = sum(count.values()) + texts, len(count) + 1
    least = lambda unit, size=n: max(2.0, unit * size ** 0.5)
    own = {w for w in count if count[w] >= least(suffix_tree.OWN_LEAST)}
    once, twice = (sum(c == k for c in count.values()) for k in (1, 2))
    discount = once / (once + 2 * twice) if once else 0.5
    rare_n, rare_v = sum(c for w, c in count.items() if w not in own), sum(w not in own for w in count)
    sequence = lambda ws: ["<"] + [w if w in own else "?" for w in ws] + [">"]
    nodes = defaultdict(Counter)
    for i in words:
        if not out[i]:
            s = sequence(words[i])
            for at in range(1, len(s)):
                for d in range(1, min(depth, at) + 1):
                    nodes[tuple(s[at - d:at])][s[at]] += 1
    size = {c: sum(k.values()) for c, k in nodes.items()}
    nodes[()], size[()] = Counter({w: count[w] for w in own} | {"?": rare_n + 1, ">": texts + 1}), n + 2
    often = lambda c: c in ((), ("<",)) or size.get(c, 0) >= least(suffix_tree.CONTEXT_LEAST)
    # The root's counts decide on the contexts of one symbol, so RARE has one more there.
    first = {(w,) for w, k in nodes[()].items() if k >= least(suffix_tree.CONTEXT_LEAST) and w != ">"} | {("<",)}
    candidates = [c for c in nodes if c and c[:1] in first and all(nodes[c[:j]][c[j]] >= least(suffix_tree.CONTEXT_LEAST) for j in range(1, len(c))) and often(c)]
    shown = {c: {s: k for s, k in nodes[c].items() if not c or k >= least(suffix_tree.SYMBOL_LEAST)} for c in [(), *candidates]}
    kept = {()}
    for c in candidates:
        mine, whole, above = shown[c], size[c[1:]], shown[c[1:]]
        gain = sum(k * math.log(k / size[c] * whole / max(k, above.get(s, 0))) for s, k in mine.items())
        rest = size[c] - sum(mine.values())
        if rest:
            gain += rest * math.log(rest / size[c] * whole / max(rest, whole - sum(above.get(s, 0) for s in mine)))
        if mine and gain > 0.5 * len(mine) * math.log(n + 2):
            kept |= {c[j:] for j in range(len(c))}

    def p(c, s):
        if not c:
            return nodes[()][s] / (n + 2)
        whole = size[c] + len(shown[c]) + 1
        return shown[c].get(s, 0) / whole + (1 - sum(shown[c].values()) / whole) * p(c[1:], s)

    result = {}
    for i, ws in words.items():
        s, score = sequence(ws), 0.0
        for at in range(1, len(s)):
            c = next(c for d in range(min(depth, at), -1, -1) if (c := tuple(s[at - d:at])) in kept)
            score += math.log10(p(c, s[at]))
            if s[at] == "?":
                k = count[ws[at - 1]]
                score += math.log10((k - discount if k else discount * rare_v + 1) / (rare_n + 1))
        base = sum(math.log10((k + 1) / (n + 1 * (v + 1))) for k in [*(count[w] for w in ws), texts])
        result[i] = (out[i], len(ws) + 1, sum(count[w] > 0 for w in ws) + 1, n, base, score)
    return result, len(kept)


@pytest.mark.parametrize("share", [1.0, 40.0])
def test_tree_scores_equal_brute_force(spark, monkeypatch, share):
    # The larger least counts leave few contexts, the smaller ones many.
    for name in ("OWN_LEAST", "CONTEXT_LEAST", "SYMBOL_LEAST"):
        monkeypatch.setattr(suffix_tree, name, getattr(suffix_tree, name) * share)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want, contexts = brute_scores([tuple(r) for r in docs.collect()], suffix_tree.DEPTH)
    got = {r.doc_id: r[1:] for r in suffix_tree.score(docs).collect()}
    assert contexts > 10 and got.keys() == want.keys()
    for i, row in got.items():
        assert row[:4] == want[i][:4] and np.allclose(row[4:], want[i][4:], rtol=1e-9, atol=1e-9), i


def test_tree_grows_with_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").withColumn("held_out", suffix_tree.held_out(F.col("doc_id")))
    half, whole = suffix_tree.learned(docs.where("doc_id % 2 = 0")), suffix_tree.learned(docs)
    assert len(whole.tree.contexts) > len(half.tree.contexts) and len(whole.tree.entries) > len(half.tree.entries) and len(whole.vocabulary.keys) > len(half.vocabulary.keys)


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "ARC_BYTES", 10_000)
    monkeypatch.setattr(archives, "WARC_BYTES", 6_000)
    html = lambda i: None if i == 3 else "é" * 2_500_000 if i == 5 else f"{i % 7} " * 600
    pages = spark.createDataFrame([(i, f"http://x/{i}", html(i)) for i in range(60)], "page_id long, url string, html string").repartition(3)
    files = archives.as_arc(pages)
    assert max(len(r.content) for r in files.collect() if len(r.content) < 1_000_000) < 10_000 + 3_000 and files.count() >= 6
    archives.write_warc(archives.with_revisits(archives.converted(files)), str(tmp_path / "w"))
    sizes = [len(archives.inflated(p.read_bytes())) for p in (tmp_path / "w").rglob("*.gz")]
    assert sorted(s for s in sizes if s < 1_000_000)[-1] < 6_000 + 2_000 and len(sizes) >= 6
    rows = {r.page_id: r for r in archives.with_referred_pages(archives.read_warc(spark, str(tmp_path / "w"))).where("record_type <> 'warcinfo'").collect()}
    assert len(rows) == 60 and all(r.intact for r in rows.values()) and rows[5].payload_bytes == 5_000_000
    first = {}
    for i in range(60):
        first.setdefault(html(i), i)
    assert all((r.record_type, r.refers_to) == (("response", None) if first[html(i)] == i else ("revisit", first[html(i)])) for i, r in rows.items())


def test_remembered_parts_stay_few_and_frequent_ones_are_kept(monkeypatch):
    import sentencepiece

    own, model = piece_viterbi.Pieces(), sentencepiece.SentencePieceProcessor(model_file=piece_viterbi.MODEL)
    searched, stream = [], own.stream
    monkeypatch.setattr(own, "stream", lambda part: searched.append(part) or stream(part))
    monkeypatch.setattr(piece_viterbi, "REMEMBERED_PARTS", 50)
    for i in range(400):
        text = f"often number{i} word{i * 7} often x{i}"
        assert own.encode(text).tolist() == model.encode(text)
        assert len(own.parts) <= 50 and len(own.older) <= 50
    assert searched.count("▁often") == 1


def test_words_are_searched_once_whatever_stands_beside_them(monkeypatch):
    import sentencepiece

    own, model = piece_viterbi.Pieces(), sentencepiece.SentencePieceProcessor(model_file=piece_viterbi.MODEL)
    searched, stream = [], own.stream
    monkeypatch.setattr(own, "stream", lambda part: searched.append(part) or stream(part))
    words, marks = [f"{a}{b}eration" for a in "bdfglm" for b in "aeiou"], ["", ",", ".", ":", "?!", ".\n", "日", "7", "\x01", " - ", "語."]
    texts = [f"{w}{m} {m}{w}{m}{w}" for w in words for m in marks]
    assert all(own.encode(t).tolist() == model.encode(t) for t in texts)
    # A word after a space, a word after a mark, and the word twice over.
    assert len(searched) == len(set(searched)) < 3 * len(words) + 4 * len(marks)


def test_long_parts_are_committed_as_they_are_read():
    import sentencepiece

    own, model = piece_viterbi.pieces(), sentencepiece.SentencePieceProcessor(model_file=piece_viterbi.MODEL)
    r = random.Random(9)
    names = [p.strip(piece_viterbi.SPACE) for p in own.scores]
    for t in ["a" * 3000, "the" * 2000, "─" * 2000, "".join(r.choice(names) for _ in range(3000)), "".join(r.choice("eainst") for _ in range(4000))]:
        assert own.encode(t).tolist() == model.encode(t)
    ways = [len("".join(own.texts[i] for i in way)) for way in own.stream("the" * 2000)]
    assert sum(ways) == 6000 and max(ways) <= 2 * own.window
