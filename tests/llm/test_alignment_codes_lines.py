"""Token alignment, vector codes and line labels against plain versions."""

import hashlib
import itertools
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from colloquy.llm import cross_tokenizer as X
from colloquy.llm import line_quality as Q
from colloquy.llm import vector_codes as V
from colloquy.llm.token_counts import tokenizer_path

SF = "/root/testdata/sf0.001"


# token alignment ----------------------------------------------------------------------------------------------------
def plain_tokens(pair, text):
    """(id, start, end) of A's and B's tokens of a whole text, or nothing."""
    if not text:
        return [], []
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    sides = []
    for ids, raw in ((pair.a.encode(" " + text, add_special_tokens=False).ids, pair.a_bytes), (sp.encode(text), pair.b_bytes)):
        ends = list(itertools.accumulate(len(raw[i]) for i in ids))
        sides.append([(i, e - len(raw[i]), e) for i, e in zip(ids, ends)])
        if b"".join(raw[i] for i in ids) != (" " + text).encode():
            return [], []
    return sides


def plain_alignment(texts):
    pair = X.Pair(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    sides, counts = [plain_tokens(pair, t) for t in texts], {}
    links = [[(i, j) for i, s, e in a for j, t, f in b if s < f and t < e] for a, b in sides]
    for x in itertools.chain(*links):
        counts[x] = counts.get(x, 0) + 1
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    out = []
    for (a, b), mine in zip(sides, links):
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [",".join(str(i) for i, _, e in a if lo < e <= hi) + "|" + ",".join(str(i) for i, _, e in b if lo < e <= hi) for lo, hi in zip([0, *ends], ends)]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((len(a), len(b), len(groups), len(mine), sum(counts[x] == most[x[1]] for x in mine), sum(counts[x] for x in mine), digest))
    return out


def aligned_texts():
    random.seed(11)
    parts = ["hello", "ciónmente", "日本", "𐍈", "é", "<|endoftext|>", "<s>", "<0x0A>", "it's", "12", "...", "naïve", " ", "‹", "\x1c"]
    gaps = [" ", " ", " ", "  ", "\n", "\n ", " \n  ", "\t", "\r\n", ""]
    made = ["".join(random.choice(parts) + random.choice(gaps) for _ in range(random.randint(1, 25))) for _ in range(60)]
    return [*made, *made[:3], None, "", " ", "   ", "\n", "a▁b c", " lead", "trail  ", "x" * 3000, "word " * 400 + "é" * 50]


def test_token_alignment_is_that_of_whole_texts(spark, monkeypatch):
    texts = aligned_texts()
    docs = spark.createDataFrame([(i // 2, t, 1, "g") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, groups string").repartition(3)
    want = sorted((i // 2, *r) for i, r in enumerate(plain_alignment(texts)))
    assert sum(r[1] > 0 for r in want) > 50 and [r for r in want if r[1] == 0]
    for head in (X.HEAD_PAIRS, 20, 0):
        got = X.report(docs, head_pairs=head)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(map(tuple, got.collect())) == want
    monkeypatch.setattr(X, "UNITS", 3)  # what tasks hold is forgotten again and again
    monkeypatch.setattr(X, "SLICE_BYTES", 50)
    held = X._Held(X.Pair(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")))
    held.of(["a b c d e"])
    assert held.full()
    assert X.report(docs.limit(0)).count() == 0


def test_alignments_hold_all_ids_in_order(spark):
    texts = [t for t in aligned_texts() if t and "▁" not in t]
    pair = X.Pair(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in X.alignments(docs).collect():
        sides = [side.split(",") for g in r.groups.split(";") for side in g.split("|")]
        a, b = [int(i) for s in sides[::2] for i in s], [int(i) for s in sides[1::2] for i in s]
        assert b"".join(pair.a_bytes[i] for i in a) == b"".join(pair.b_bytes[i] for i in b) == (" " + texts[r.doc_id]).encode()


def test_token_ends_take_spans_and_else_bytes():
    # a whole word by its span, then a character of four bytes in three tokens, of which the spans are the character's or empty
    ends = X.token_ends(np.array([0, 3, 3, 3, 7]), np.array([3, 3, 3, 7, 8]), np.array([3, 1, 2, 1, 1]))
    assert ends.tolist() == [3, 4, 6, 7, 8] and X.token_ends(np.array([0, 0]), np.array([2, 2]), np.array([1, 1])).tolist() == [1, 2]
    i, j, cuts, common = X.overlaps(np.array([3, 5, 8]), np.array([2, 5, 8]))
    assert list(zip(i.tolist(), j.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2)] and common.tolist() == [5, 8] and cuts.tolist() == [2, 3, 5, 8]


# vector codes -------------------------------------------------------------------------------------------------------
def plain_codes(rows, parts=4, entries=256, rounds=4):
    """{row number: (code, error, label_error)} and the digest, with Python's own integers."""
    import math

    kept = [(i, v, label, [math.floor(1024 * x) for x in e]) for i, (v, e, label) in enumerate(rows) if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    width = len(kept[0][3]) // parts
    first = sorted(kept, key=lambda k: (k[1] is None, k[1] or 0, k[3]))[:entries]
    part = lambda x, p: x[p * width : (p + 1) * width]
    books = [[list(part(k[3], p)) for k in first] for p in range(parts)]

    def near(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, y)) for y in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for k in kept:
                held.setdefault(near(part(k[3], p), books[p])[0], []).append(part(k[3], p))
            for e, xs in held.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    found = {k[0]: [near(part(k[3], p), books[p]) for p in range(parts)] for k in kept}
    by_label = {}
    for k in kept:
        by_label[k[2]] = by_label.get(k[2], 0) + sum(d for _, d in found[k[0]])
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((k[1] is None, k[1] or 0, "".join(f"{e:02x}" for e, _ in found[k[0]]), sum(d for _, d in found[k[0]]), by_label[k[2]]) for k in kept), digest


@pytest.mark.parametrize("kind, scale", [("int", 1.0), ("string", 9000.0)])
def test_codes_are_those_of_plain_integers(spark, kind, scale):
    rng = np.random.default_rng(5)
    rows = [(i if i % 50 else i // 2, [float(np.float32(x * scale)) for x in rng.normal(0, 0.3, 8)], (None if i % 7 == 0 else i % 3)) for i in range(330)]
    rows += [(7, rows[3][1], 1), (7, rows[3][1], 1), (None, rows[4][1], None), (400, None, 1), (401, [None] + rows[5][1][1:], 1), (402, [float("nan")] + rows[5][1][1:], 2), (403, [float("inf")] + rows[5][1][1:], 2)]
    rows = [(v, e, None if x is None else str(x) if kind == "string" else x, 1) for v, e, x in rows]
    docs = spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {kind}, code int").repartition(3)
    got = V.report(docs).collect()
    want, digest = plain_codes([r[:3] for r in rows])
    assert sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<double>, label int"
    one = V.report(spark.createDataFrame([(3, [0.5, -0.5, 0.25, 1.0], None)], kind)).first()
    assert (one.code, one.error, one.label_error) == ("00000000", 0, 0)
    assert V.report(spark.createDataFrame([], kind)).count() == 0 == V.report(spark.createDataFrame([(1, None, 1)], kind)).count()
    for bad in ([1.0, 2.0, 3.0], [1e9] * 4):
        with pytest.raises(Exception, match="length|size"):
            V.report(spark.createDataFrame([(1, bad, 1)], kind)).collect()


def test_products_of_limbs_are_exact():
    rng = np.random.default_rng(1)
    for bits, width in ((10, 16), (27, 16), (26, 64), (20, 1000)):
        x, y = (rng.integers(-(1 << bits), 1 << bits, (20, width)) for _ in range(2))
        x[0], y[0] = -(1 << bits), (1 << bits) - 1
        want = [[sum(int(a) * int(b) for a, b in zip(p, q)) for q in y] for p in x]
        assert V.exact_dots(x, y).tolist() == want
        assert width * 4 ** V.limb_bits(width) < 1 << 53
        back = sum(np.asarray(limb).astype(object) * (1 << (k * V.limb_bits(width))) for k, limb in enumerate(V.limbs(x, V.limb_bits(width))))
        assert (back == x.astype(object)).all()
    assert V.nearest(np.array([[0, 0]]), np.array([[1, 0], [0, 1], [3, 3]]))[0].tolist() == [0]  # of equal distances the first


# line labels --------------------------------------------------------------------------------------------------------
def plain_rules(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows, covered = {}, set()
    for i in range(len(found) - 2):
        windows.setdefault(tuple(found[i : i + 3]), []).append(i)
    for at in windows.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(3)}
    seen, copies = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            copies += line in seen
            seen.add(line)
    n = len(found)
    return n, sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), copies, len(covered), n < 50 or 100 * len(covered) > 50 * n


def rule_texts():
    random.seed(3)
    words = ["a", "bé", "日本", "#x", "|", "it's", "\x00", " ", "𐍈."]
    made = ["".join(random.choice(words) + random.choice([" ", " ", "\n", "  ", "\t", "\r\n", "\n\n"]) for _ in range(random.randint(0, 120))) for _ in range(80)]
    return [*made, None, "", "\n", " \n ", "one", "one\none\n one", "a b c a b c", "x " * 60, "same line here\n" * 30, "w%d " * 3 + "#" * 70_000, "\n".join(f"line {i} of a long text" for i in range(3000))]


def test_line_rules_are_those_of_plain_loops(spark):
    texts = rule_texts()
    docs = spark.createDataFrame([(i // 2, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_words int").repartition(3)
    labels = spark.createDataFrame([(0, 1), (None, 0), (3, None), (4, 7)], "doc_id long, quality int")
    got = Q.report(docs, labels)
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = got.collect()
    assert sorted(tuple(r)[:-1] for r in rows) == sorted((i // 2, *plain_rules(t)) for i, t in enumerate(texts))
    assert all(r.kept == (not r.base_failed) for r in rows)  # with one kind of label all lines are content
    assert Q.report(docs.limit(0), labels.limit(0)).count() == 0


def test_viterbi_is_the_best_of_all_sequences():
    rng = np.random.default_rng(2)
    bounds = np.array([0, 0, 7, 8, 8, 13])
    scores, moves = rng.integers(-3, 4, (13, 2)).astype(float), rng.integers(-2, 3, (2, 2)).astype(float)
    got = Q.viterbi(scores, bounds, moves)
    for x, y in zip(bounds[:-1], bounds[1:]):
        value = lambda s: sum(scores[x + i, c] for i, c in enumerate(s)) + sum(moves[a, b] for a, b in zip(s, s[1:]))
        assert value(got[x:y].tolist()) == max((value(s) for s in itertools.product((0, 1), repeat=y - x)), default=0)


def test_lines_are_cut_where_they_stand():
    text = "  a b\n\nc\td \n\n \nlast"
    (_, lines), = Q.lines_of(pa.array([text, "", "\nx\n"]))
    whole = (text + "\nx\n").encode()
    assert [whole[s:e] for s, e in zip(lines.start, lines.end)] == [b"  a b", b"c\td ", b"last", b"x"] and lines.bounds.tolist() == [0, 3, 3, 4]


def test_mixed_lines_are_told_apart(spark):
    random.seed(1)
    clean = lambda: " ".join(random.choices("we went home after the long day and slept well until morning".split(), k=12)).capitalize() + "."
    junk = lambda: " | ".join(random.choices("home login terms cookies share menu".split(), k=8)) + " |"
    rows = [(i, "\n".join(clean() if i % 2 else junk() for _ in range(8)), i % 2) for i in range(200)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    field = Q.train(docs, labels)
    text = "\n".join([junk(), *(clean() for _ in range(6)), junk(), junk()])
    got = Q.labelled(spark.createDataFrame([(1, text)], "doc_id long, text string"), field).first()
    assert got.content == [False] + [True] * 6 + [False] * 2
    sample = Q.training_sample(docs.unionByName(docs), labels.unionByName(labels), rows=20)
    assert sample.count() == 20 and sample.filter("y = 1").count() == 10
    repeated = spark.createDataFrame([(1, "a b c")] * 500 + [(2, "d e f")], "doc_id long, text string")
    assert Q.training_sample(repeated, spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, quality int"), rows=10).count() == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_clean_documents_are_kept(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.filter("crc32(cast(doc_id as string)) % 5 <> 0")
    got = Q.report(docs, known).join(labels.filter("crc32(cast(doc_id as string)) % 5 = 0"), "doc_id").filter("not base_failed").collect()
    right = sum(r.kept == (r.quality == 1) for r in got)
    clean = [r.kept for r in got if r.quality == 1]
    assert len(got) > 30 and right >= 0.95 * len(got) and sum(clean) >= 0.98 * len(clean)
