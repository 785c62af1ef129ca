import hashlib
import random
import re

import numpy as np

from colloquy.llm import near_dedup as N
from colloquy.llm import substring_dedup as S
from colloquy.llm import words as W

DOCS = "doc_id long, text string, bucket int, label string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_components_match_brute_force(spark):
    random.seed(3)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(4))
    bases = [[word() for _ in range(random.choice([3, 8, 40, 120]))] for _ in range(12)]
    rows = []
    for base in bases:
        for _ in range(8):
            copy = [word() if random.random() < random.choice([0, 0.01, 0.03, 0.06]) else w for w in base]
            rows.append((len(rows) * 3 % 97, "\t ".join(copy).title()))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "a"), (204, "A"), (205, "a b")]
    rows = list(dict(rows).items())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.report(docs(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_near_copies_without_their_original_and_repeats(spark):
    random.seed(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        copy = list(base)
        for at in random.sample(range(60), 3):
            copy[at] = f"x{random.randint(0, 3)}"
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.report(docs(spark, [*rows, rows[0]])).collect()}
    assert got == brute_components(rows)
    kept = N.keep_one(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "bucket", "label"] and {r.doc_id for r in kept.collect()} == {c for _, c in got.values()}
    assert N.report(docs(spark, [])).count() == 0


def test_rows_that_repeat_an_id_are_one_document(spark):
    base = [" ".join(f"{c}{i}" for i in range(40)) for c in "wxyz"]
    rows = [(1, base[0]), (2, base[0] + " z"), (1, base[1]), (3, base[1] + " z"), (4, base[2]), (5, base[3]), (None, base[3]), (5, None)]
    got = {(r.doc_id, r.component_id) for r in N.report(docs(spark, rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (None, None)}
    clash = docs(spark, rows[:4]).withColumnRenamed("label", "set_key").withColumnRenamed("bucket", "node")
    assert {r.doc_id for r in N.keep_one(clash).collect()} == {1}


def test_circulant_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (600, 200, 200))
    sets = np.concatenate([np.sort(np.concatenate([common, a])), np.sort(np.concatenate([common, b]))])
    sig = N.signatures(W.mixed(sets), np.array([0, 800, 1600]), 1024)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.05


def brute_removal(rows):
    count = {}
    for _, b in rows:
        for k in range(len(b) - 199):
            count[b[k : k + 200]] = count.get(b[k : k + 200], 0) + 1
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(gone[z] and (z == 0 or not gone[z - 1]) for z in range(len(b))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_removed_bytes_match_brute_force(spark, monkeypatch):
    random.seed(2)
    base = "".join(random.choice("abcdef ghij") for _ in range(3000))
    rows = [(1, base[:900]), (2, base[300:1200]), (3, base[1000:1199]), (4, None), (5, "x" * 1000), (6, "ab" * 300), (7, base[500:705] + "Q" + base[100:300]), (8, ""), (9, base[1300:1500] + "zz"), (10, base[1299:1500] + "yy"), (11, base[2000:2600] + "é" + base[2000:2600]), (12, base[2700:2950]), (12, base[2700:2950])]
    want = brute_removal([(i, (t or "").encode()) for i, t in rows])
    got = lambda: sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.report(docs(spark, rows)).collect())
    assert got() == want
    assert S.report(docs(spark, [])).count() == 0
    for piece in (700, 1 << 19):  # long texts in parts give the same buckets
        monkeypatch.setattr(S, "PIECE", piece)
        import pyarrow as pa

        texts = pa.array([(t or "") for _, t in rows[:7]])
        places = set()
        for row, stop, bounds, data, low, first, last in S._pieces(texts):
            place, *_ = S.representatives(data, bounds[1:], first, last)
            owner = np.searchsorted(bounds, place, "right") - 1
            places |= {(int(row + o), int(p + low - bounds[o])) for p, o in zip(place, owner)}
        monkeypatch.setattr(S, f"_seen_{piece}", places, raising=False)
    assert getattr(S, "_seen_700") == getattr(S, f"_seen_{1 << 19}")


def test_removed_bytes_of_cut_and_joined_copies_match_brute_force(spark):
    random.seed(7)
    letters = lambda n, some="abcdefgh ": "".join(random.choice(some) for _ in range(n))
    bases = [letters(2500), letters(900, "ab"), "abcab" * 200, letters(700)]
    rows = []
    for _ in range(60):
        parts = []
        for _ in range(random.randint(1, 4)):
            base = random.choice(bases)
            a = random.randint(0, len(base) - 50)
            parts += [base[a : a + random.choice([150, 199, 200, 201, 230, 260, 420, 800])], letters(random.choice([0, 1, 40, 300]))]
        rows.append((len(rows) % 50, "".join(parts)))
    rows += [(90, bases[3][:300])] * 40 + [(None, bases[3][100:400]), (91, "y" * 199), (91, "y" * 200), (92, "z" * 201)]
    want = sorted(brute_removal([(-1 if i is None else i, t.encode()) for i, t in rows]))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.report(docs(spark, rows)).collect())
    assert got == want
    kept = S.removals(docs(spark, rows)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in kept) == want
    extra = docs(spark, rows[:3]).withColumnRenamed("label", "digest").withColumnRenamed("bucket", "key")
    assert S.report(extra).count() == 3


def test_equal_rows_are_one_text(spark):
    texts = S.distinct_texts(S._keyed(docs(spark, [(1, "x" * 420)] * 30 + [(2, "y" * 100)]), "doc_id", "text").select("digest", "text")).collect()
    assert [(t.n, len(t.text)) for t in texts] == [(30, 420)]
