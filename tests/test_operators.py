import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.functions.hashing import merged_digest, set_digest
from colloquy.operators import align as L
from colloquy.operators import audit as Q
from colloquy.operators import candidates as C
from colloquy.operators import features as X
from colloquy.operators import metrics as M
from colloquy.operators import models as N
from colloquy.operators import turns as U
from colloquy.sources import io as S


def turns(spark, rows):
    return spark.createDataFrame(rows, "source_index long, speaker string, text string, label int, episode_id string, dialogue_id string")


def test_eligible_turns(spark):
    rows = [(0, "a", "x0", 0, "E", "E-1"), (1, "b", "x1", 1, "E", "E-1"), (2, "a", None, 0, "E", "E-1"), (3, "b", "x3", 0, "E", "E-1"), (4, "c", "y", 0, "E", "E-2"), (5, "a", "x5", 0, "E", "E-1"), (6, "b", "x6", 0, "E", "E-1")]
    got = {r.source_index: r for r in U.eligible(turns(spark, rows)).collect()}
    assert set(got) == {0, 5}  # 1: blank reply; 3: next row of another dialogue; the label's second run is a run of its own
    assert got[0].response == "x1" and [t.text for t in got[5].context_turns] == ["x5"]


def test_sealed(spark):
    assert U.sealed(turns(spark, [(0, "a", "x", 0, "E", "E-1"), (9, "a", "x", 0, "E", "E-1")]), 9).count() == 1


def records(spark, replies):
    rows = [(i, f"D{i}", "E", label, "s", text) for i, (label, text) in enumerate(replies)]
    return spark.createDataFrame(rows, "source_index long, dialogue_id string, episode_id string, target_label int, next_speaker string, response string")


def test_candidate_sets(spark):
    got = C.candidate_sets(records(spark, [(0, "aaa"), (0, "bbb"), (0, "cccc"), (1, "ddd"), (1, "eeee"), (1, "fffff")])).collect()
    by = {}
    for r in got:
        by.setdefault(r.source_index, []).append(r)
    assert len(by) == 6
    for rows in by.values():
        assert sorted(r.candidate_pos for r in rows) == [0, 1, 2, 3] and len({r.candidate_text for r in rows}) == 4 and sum(r.is_gold for r in rows) == 1
    assert C.candidate_sets(records(spark, [(0, "aaa"), (0, "bbb"), (0, "cccc")])).count() == 0  # no opposite label
    assert 0 not in {r.source_index for r in C.candidate_sets(records(spark, [(0, "aaa"), (0, "bbb"), (1, "bbb")])).collect()}  # both best share a text


def test_neighbours_are_found_outward(spark, monkeypatch):
    import hashlib
    import random

    random.seed(9)
    # lengths spread widely, with a narrow middle, a rare label and copies
    sizes = [random.choice([random.randint(1, 3000), random.randint(40, 60)]) for _ in range(240)]
    rows = [(i, f"D{i // 2}", "E", int(i % 40 == 0), "s", (f"{i % 90:02d}" * n)[:n]) for i, n in enumerate(sizes)]
    held = spark.createDataFrame(rows, "source_index long, dialogue_id string, episode_id string, target_label int, next_speaker string, response string")
    asked, pool = [], C.distractor_pool
    monkeypatch.setattr(C, "distractor_pool", lambda a, s, k, within, salt: asked.append((within, a.count(), pool(a, s, k, within, salt).count())) or pool(a, s, k, within, salt))
    got = {}
    for r in C.nearest_texts(held).collect():
        got.setdefault((r.source_index, r.same), {})[r.n] = (r.b.pool_index, r.said)
    rank = lambda t, o: (abs(len(t[5]) - len(o[5])), hashlib.sha256(f"{C.SALT}|{t[0]}|{o[0]}".encode()).hexdigest()[:16], o[0])
    for t in rows:
        for same in (True, False):
            want, seen = {}, set()
            for o in sorted((o for o in rows if o[1] != t[1] and o[5] != t[5] and (o[3] == t[3]) == same), key=lambda o: rank(t, o)):
                if o[5] not in seen and len(want) < 3:
                    seen.add(o[5])
                    want[len(want) + 1] = (o[0], hashlib.sha256(o[5].encode()).hexdigest())
            assert got.get((t[0], same), {}) == want
    assert [w for w, *_ in asked][:3] == [16, 64, 256] and asked[0][1] == 480 and all(a[1] > b[1] for a, b in zip(asked, asked[1:]))
    assert sum(pairs for *_, pairs in asked) < 240 * 240 / 2


def test_evaluation_pairs(spark):
    r = records(spark, [(0, "a"), (1, "b")]).withColumn("dialogue_id", F.lit("D"))
    assert C.evaluation_pairs(r, r, 1).count() == 2
    assert C.evaluation_pairs(r, r.filter("target_label = 0"), 1).count() == 0
    with pytest.raises(ValueError):
        C.evaluation_pairs(r, r, 2, required=True)


def test_decisions_and_ties(spark):
    rows = [("m", 0, 1, "s", "t", 0, "z", False, 1.0), ("m", 0, 1, "s", "t", 1, "a", True, 1.0)]
    s = spark.createDataFrame(rows, "method string, fold int, seed int, sample_id string, condition string, candidate_pos int, candidate_id string, is_gold boolean, selector_logit double")
    assert M.decisions(s).first().correct == 0 and M.decisions(s, ties="id").first().correct == 1
    assert M.incomplete_groups(s).count() == 1 and M.incomplete_groups(s, 2).count() == 0


def outcome_rows(spark, rows):
    return spark.createDataFrame([("m", 1, f"e{i % 2}", y, p, q, y, a, b, g, "helpful") for i, (y, p, q, a, b, g) in enumerate(rows)], "method string, seed int, episode_id string, true_label int, text_label int, text_audio_label int, target_label int, response_text_correct int, response_text_audio_correct int, recognition_group string, response_transition string")


def test_undefined_metrics_are_null(spark):
    one = M.paired_metrics(outcome_rows(spark, [(1, 1, 1, 0, 1, "stable-correct"), (1, 0, 0, 1, 1, "stable-wrong")]), "method").first()
    assert one.recognition_text_ba is None and one.delta_corrected is None and one.help_harm_ratio is None and one.delta_literal is None and one.delta_sarcastic == 0.5
    assert M.transitions(outcome_rows(spark, [(1, 1, 1, 0, 1, "corrected")])).count() == 16


def test_bootstrap(spark):
    rows = outcome_rows(spark, [(1, 1, 1, 0, 1, "stable-correct"), (0, 0, 0, 1, 1, "stable-correct")])
    stats = M.episode_statistics(rows, rows)
    got = {r.metric: r for r in M.bootstrap(stats, 50).collect()}
    assert set(got) == {"delta_recognition", "delta_literal", "delta_sarcastic", "delta_response", "did", "delta_corrected"}
    assert got["delta_corrected"].low is None and got["delta_corrected"].undefined == 50 and got["delta_corrected"].valid == 0
    assert 0 < got["delta_recognition"].undefined < 50 and got["delta_response"].undefined == 0 and all(r.valid + r.undefined == 50 for r in got.values())
    with pytest.raises(ValueError):
        M.bootstrap(stats.filter("episode_id = 'e0'"), 5)


def test_bootstrap_is_that_of_numpy(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(M, "REPLICATES", 7)  # the last block is shorter
    rng, n, resamples = np.random.default_rng(6), 23, 40
    sums = {e: rng.integers(0, 6, 12) for e in range(n)}
    rows = [("m", f"e{e:02d}", *map(int, v)) for e, v in sums.items()] + [("o", f"e{e:02d}", *map(int, v[::-1])) for e, v in sums.items()]
    stats = spark.createDataFrame(rows, "method string, episode_id string, " + ", ".join(f"{c} long" for c in M.SUMS)).repartition(3)
    got = {(r.method, r.metric): (r.low, r.high, r.valid, r.undefined) for r in M.bootstrap(stats, resamples).collect()}
    number = M.drawn(np.arange(resamples), np.arange(n), n)
    w = np.stack([np.bincount(x, minlength=n) for x in number])
    assert (w.sum(1) == n).all() and sorted(map(tuple, M.resample_weights(spark, n, resamples).filter("number = 3 and block = 5").collect())) == [(3, 5, w[35:, 3].tolist())]
    for method, order in (("m", 1), ("o", -1)):
        x = dict(zip(M.SUMS, (w @ np.stack([sums[e][::order] for e in range(n)])).T.astype(float)))
        with np.errstate(divide="ignore", invalid="ignore"):
            lit, sar = x["literal_net"] / x["literal"], x["sarcastic_net"] / x["sarcastic"]
            values = {
                "delta_recognition": (x["audio_tp"] / x["positives"] + x["audio_tn"] / x["negatives"] - x["text_tp"] / x["positives"] - x["text_tn"] / x["negatives"]) / 2, "delta_literal": lit, "delta_sarcastic": sar,
                "delta_response": (x["literal_net"] + x["sarcastic_net"]) / (x["literal"] + x["sarcastic"]), "did": sar - lit, "delta_corrected": x["corrected_net"] / x["corrected"],
            }
        for k, v in values.items():
            v = v[np.isfinite(v)]
            assert got[method, k] == (pytest.approx(np.percentile(v, 2.5)), pytest.approx(np.percentile(v, 97.5)), len(v), resamples - len(v))


def test_draws_are_even_and_ranges_agree(spark, monkeypatch):
    import numpy as np

    counts = np.bincount(M.drawn(np.arange(200), np.arange(50), 50).reshape(-1), minlength=50)
    assert (abs(counts - 200) < 80).all() and 100 < counts.var() < 320  # 10,000 even draws
    whole = sorted(map(tuple, M.resample_weights(spark, 31, 150).collect()))
    monkeypatch.setattr(M, "CLUSTERS", 8)
    assert sorted(map(tuple, M.resample_weights(spark, 31, 150).collect())) == whole


def test_pooled_metrics_come_from_the_same_pass(spark):
    rows = outcome_rows(spark, [(1, 1, 1, 0, 1, "stable-correct"), (0, 0, 1, 1, 1, "corrupted"), (1, 0, 1, 1, 0, "corrected")])
    rows = rows.unionByName(rows.withColumn("seed", F.lit(2)).filter("true_label = 1"))
    both = M.by_seed_and_pooled(rows)
    want = M.paired_metrics(rows, "method", "seed").collect() + M.paired_metrics(rows, "method").withColumn("seed", F.lit(None)).select(both.columns).collect()
    assert sorted(map(str, both.collect())) == sorted(map(str, want))


def test_a_response_without_recognition_raises(spark):
    s = spark.createDataFrame([("m", 0, 1, k, f"s{k}", "e", 1, "text", 0, "gold", True, 1.0) for k in (1, 2)], "method string, fold int, seed int, source_index int, sample_id string, episode_id string, target_label int, condition string, candidate_pos int, candidate_id string, is_gold boolean, selector_logit double")
    p = spark.createDataFrame([("m", 0, 1, k, 1, 1, 1) for k in (1, 2, 3)], "method string, fold int, seed int, source_index int, true_label int, text_label int, text_audio_label int")
    assert M.outcomes(s, p).count() == 2
    with pytest.raises(Exception, match="no recognition of turn 2"):
        M.outcomes(s, p.filter("source_index <> 2")).collect()


def test_rows_are_numbered_in_order(spark):
    from colloquy.sources.storage import numbered

    rows = numbered(spark.createDataFrame([(f"k{i:03d}",) for i in range(100)][::-1], "k string").repartition(7), "k", "at").collect()
    assert sorted((r.at, r.k) for r in rows) == [(i, f"k{i:03d}") for i in range(100)]
    assert numbered(spark.createDataFrame([], "k string"), "k", "at").columns == ["k", "at"]


def test_a_run_replaces_its_own_rows(spark, tmp_path):
    path, kind = f"{tmp_path}/runs", "method string, fold int, seed int, x double"
    runs = [(m, f, s, 1.0) for m in "ab" for f in (0, 1) for s in (11, 12)]
    S.write_partitioned(spark.createDataFrame(runs, kind), path, "method", "fold", "seed", replace=True)
    S.write_partitioned(spark.createDataFrame([("a", 1, 12, 5.0), ("a", 1, 12, 6.0)], kind), path, "method", "fold", "seed", replace=True)
    got = sorted((r.method, r.fold, r.seed, r.x) for r in spark.read.parquet(path).collect())
    assert got == sorted([r for r in runs if r[:3] != ("a", 1, 12)] + [("a", 1, 12, 5.0), ("a", 1, 12, 6.0)])
    with pytest.raises(Exception, match="exists"):
        S.write_partitioned(spark.createDataFrame(runs, kind), path, "method", "fold", "seed")


def lines(spark, rows):
    return spark.createDataFrame([(c, i, f"{c}|{i}", s, t) for c, i, s, t in rows], "conversation_id string, order int, utterance_id string, speaker string, text string")


def test_observed_reply(spark):
    c = lines(spark, [("1", 0, "a", "x"), ("1", 1, "a", "y"), ("1", 2, "TRANSCRIPT_NOTE", "n"), ("1", 3, "b", "z"), ("2", 0, "a", "x"), ("2", 1, "TRANSCRIPT_NOTE", "n"), ("3", 0, "a", "x"), ("3", 1, "a", "y"), ("3", 2, "b", " "), ("4", 0, "a", "x")])
    asked = spark.createDataFrame([("1|0", "LEVEL_C_AMBIGUOUS"), ("2|0", "x"), ("3|0", "x"), ("4|0", "x"), ("9|9", "x"), (None, "NO_MATCH")], "utterance_id string, alignment_type string")
    got = {r.utterance_id: r for r in L.observed_reply(asked, c).collect()}
    assert (got["1|0"].response_id, got["1|0"].distance, got["1|0"].skipped_same_speaker) == ("1|3", 3, 1)
    assert [got[k].drop_reason for k in ("2|0", "3|0", "4|0", "9|9", None)] == ["TRANSCRIPT_ONLY_AFTER_TARGET", "NO_DIFFERENT_SPEAKER_RESPONSE", "SCENE_END", "OTHER", "NO_MATCH"]


def test_alignment_levels(spark):
    c = lines(spark, [("1", 0, "b", "how are you today my friend"), ("1", 1, "a", "i am doing very well indeed thanks"), ("2", 0, "b", "something else here"), ("2", 1, "b", "the same exact words are here"), ("3", 0, "a", "unrelated")])
    schema = "target_id string, utterance string, speaker string, context array<string>, context_speakers array<string>, label boolean"
    t = spark.createDataFrame(
        [("A", "I am doing very well indeed, thanks!", "a", ["How are you today my friend"], ["b"], True), ("B", "i am doing very well indeed thank", "a", ["how are you today my friend"], ["b"], True), ("C", "the same exact words are here", "a", [], [], False), ("N", "zzz qqq", "a", [], [], None)], schema
    )
    got = {r.target_id: r for r in L.aligned(t, c).collect()}
    assert got["A"].alignment_type == L.LEVELS["exact"] and got["A"].status == "AUTO_CANDIDATE" and got["A"].utterance_id == "1|1"
    assert got["B"].alignment_type == L.LEVELS["high"]
    assert got["C"].alignment_type == L.LEVELS["ambiguous"] and "speaker_not_verified" in got["C"].notes
    assert got["N"].alignment_type == "NO_MATCH" and got["N"].utterance_id is None


TARGET = "target_id string, utterance string, speaker string, context array<string>, context_speakers array<string>, label boolean"


def test_a_token_mate_of_any_length_rules_out_the_fallback(spark):
    c = lines(spark, [("1", 0, "a", "hello everyone how are you all doing today"), ("1", 1, "a", "hallo bobb")])
    got = {r.target_id: r for r in L.aligned(spark.createDataFrame([("A", "hello bob", "a", [], [], None), ("B", "hallo bobx", "b", [], [], None), ("C", "hallu bobx", "a", [], [], None)], TARGET), c).collect()}
    assert got["A"].alignment_type == "NO_MATCH" and got["B"].alignment_type == "NO_MATCH" and got["C"].utterance_id == "1|1"


def test_evidence_counts_a_missing_context_as_none(spark):
    c = lines(spark, [("1", 0, "a", "the same exact words are here"), ("1", 1, "a", "...")])
    t = spark.createDataFrame([("A", "the same exact words are here", "a", [], [], None), ("B", "the same exact words are her", "a", [], [], None)], TARGET)
    got = {r.target_id: r for r in L.aligned(t, c).collect()}
    assert got["A"].evidence == got["B"].evidence == 0 and got["A"].target_sim == 1 and got["B"].target_sim > 0.9


def test_lines_without_words_are_no_context(spark):
    c = L.prepared_corpus(lines(spark, [("1", 0, "a", "one"), ("1", 1, "b", "..."), ("1", 2, "TRANSCRIPT_NOTE", "n"), ("1", 3, "a", "two")]))
    assert [r.text for r in U.context_before(c).filter("order = 3").first().context] == ["one"]


def test_aliases(spark):
    c = lines(spark, [("1", 0, "Ann B", "hello there my dear friend"), ("1", 1, "Bob C", "good morning to you")])
    t = spark.createDataFrame([("A", "good morning to you", "BOB", ["hello there my dear friend"], ["ANN"], None), ("N", "good morning to you", "EVE", [], [], None)], TARGET)
    names = L.aliases(spark.createDataFrame([("BOB", "Bob C"), ("ANN", "Ann B"), ("EVE", "Nobody")], "alias string, name string"), c, t)
    assert {(r.alias, r.name) for r in names.collect()} == {("BOB", "Bob C"), ("EVE", None)}  # ANN speaks no target
    got = {r.target_id: r for r in L.aligned(t, c, names).collect()}
    assert got["A"].alignment_type == L.LEVELS["exact"] and "unresolved_speaker" in got["N"].notes and got["N"].alignment_type == L.LEVELS["ambiguous"]


def plain_alignment(targets, corpus):
    """The alignment by plain loops and the standard library."""
    import re
    from difflib import SequenceMatcher

    norm = lambda t: " ".join(re.sub(r"[^\w\s']", " ", t.lower()).split())

    def sim(a, b):
        return 0.0 if not a or not b else 1.0 if a == b else SequenceMatcher(None, a, b, autojunk=False).ratio()

    rows = [(cid, i, f"{cid}|{i}", s, t, norm(t)) for cid, i, s, t in corpus]
    out = {}
    for tid, text, speaker, context, speakers, _ in targets:
        n = norm(text)
        pool = [r for r in rows if r[5] == n]
        if not pool:
            pool = [r for r in rows if set(r[5].split()) & set(n.split()) and (speaker is None or r[3] == speaker)]
            if not pool and len(n) <= 12:
                pool = [r for r in rows if speaker is None or r[3] == speaker]
        seen = []
        for r in pool:
            ts = sim(n, r[5])
            if ts < 0.8:
                continue
            prior = [x for x in rows if x[0] == r[0] and r[1] - 8 <= x[1] < r[1] and x[5] and x[3] != "TRANSCRIPT_NOTE"]

            def best(end, line, who):
                return max(((sim(norm(line), x[5]), i) for i, x in enumerate(prior[:end]) if who is None or x[3] == who), default=(0.0, -1))

            c1 = c2 = 0.0
            if context:
                c1, at = best(len(prior), context[-1], speakers[-1])
                if len(context) > 1 and at >= 0:
                    c2 = best(at, context[-2], speakers[-2])[0]
            match = speaker is not None and r[3] == speaker
            ok = bool(context) and c1 >= 0.9 and (len(context) < 2 or c2 >= 0.8)
            seen.append((min([ts, c1] + [c2] * (len(context) > 1)), ts, c1, c2, r[2], ts >= 0.95 and match and ok))
        high = [x for x in seen if x[5]]
        pick = high[0] if len(high) == 1 else max(seen, default=None)
        level = "none" if not seen else ("exact" if high[0][1] == 1 else "high") if len(high) == 1 else "ambiguous"
        out[tid] = (L.LEVELS[level], pick[4] if pick else None, *(round(x, 6) for x in (pick[:4] if pick else (0, 0, 0, 0))), len(seen), len(high))
    return out


def test_alignment_is_that_of_plain_loops(spark):
    import random

    random.seed(4)
    words = "we know that this was never going to be easy for them but here it is again".split()
    corpus = []
    for scene in range(12):
        for i in range(12):
            text = random.choice(["...", "no!", "ok", "oh no"]) if random.random() < 0.25 else " ".join(random.choices(words, k=random.randint(2, 9)))
            corpus.append((str(scene), i, random.choice(["a", "b", "TRANSCRIPT_NOTE"] if random.random() < 0.2 else ["a", "b"]), text))
    targets = []
    for k in range(60):
        at = random.randrange(len(corpus))
        scene, i, who, text = corpus[at]
        before = [r for r in corpus if r[0] == scene and r[1] < i][-random.randint(0, 3) :] if random.random() < 0.8 else []
        change = lambda t: t if random.random() < 0.4 else t + "s" if random.random() < 0.5 else t[: random.randrange(len(t) + 1)] + random.choice(["", "x", " q "]) + t[random.randrange(len(t) + 1) :]
        targets.append((f"t{k:02d}", change(text), who if random.random() < 0.8 else None, [change(r[3]) for r in before], [r[2] if random.random() < 0.8 else None for r in before], None))
    got = {r.target_id: (r.alignment_type, r.utterance_id, r.evidence, r.target_sim, r.context1, r.context2, r.num_candidates, r.num_high) for r in L.aligned(spark.createDataFrame(targets, TARGET), lines(spark, corpus)).collect()}
    assert got == plain_alignment(targets, corpus) and len({v[0] for v in got.values()}) >= 3


def test_sparse_vectors_and_frequent_grams(spark):
    rows = spark.createDataFrame([(1, "a", 0.5), (1, "c", 0.5), (2, "b", 1.0)], "k long, gram string, weight double")
    assert {r.k: (r.vector.size, list(r.vector.indices), list(r.vector.values)) for r in X.sparse_vectors(rows, "k").collect()} == {1: (3, [0, 2], [0.5, 0.5]), 2: (3, [1], [1.0])}
    totals = spark.createDataFrame([("d", 5), ("b", 3), ("a", 3), ("c", 3), ("e", 1)], "gram string, total long")
    assert [sorted(r.gram for r in X.most_frequent(totals, n).collect()) for n in (5, 3, 1, 0)] == [list("abcde"), ["a", "b", "d"], ["d"], []]


def test_scene_checks_and_one_spelling(spark):
    u = spark.createDataFrame([("u1", "c1", 1), ("u2", "c2", 2)], "utterance_id string, conversation_id string, said int")
    good = spark.createDataFrame([("c1", 1), ("c2", 2)], "conversation_id string, scene int")
    assert S.with_scenes(u, good, {"scene": F.col("said")}).columns == ["conversation_id", "utterance_id", "said", "scene"]
    for bad, what in ((good.filter("scene = 1"), "no scene"), (good.withColumn("scene", F.lit(1)), "disagree")):
        with pytest.raises(Exception, match=what):
            S.with_scenes(u, bad, {"scene": F.col("said")}).collect()
    shows = spark.createDataFrame([("News",), ("Other",), ("NEWS",)], "show string")
    assert Q.one_spelling(shows.filter("show <> 'NEWS'"), "show", "news").count() == 1
    with pytest.raises(Exception, match="several ways"):
        Q.one_spelling(shows, "show", "news").collect()


def test_fold_map_and_turn_reader_raise(spark, tmp_path):
    r = spark.createDataFrame([(1, "E1"), (2, "E2")], "source_index long, episode_id string")
    with pytest.raises(Exception, match="no fold"):
        C.with_fold_map(r, spark.createDataFrame([("E1", 0)], "episode_id string, fold int")).collect()
    r.write.parquet(f"{tmp_path}/turns")
    for name, vectors in (("good", [(1, [0.5, 1.0]), (2, [1.0, 2.0])]), ("short", [(1, [0.5]), (2, [1.0, 2.0])]), ("few", [(1, [0.5, 1.0])]), ("many", [(1, [0.5, 1.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0])])):
        spark.createDataFrame(vectors, "source_index long, target_audio array<double>").write.parquet(f"{tmp_path}/{name}")
    assert S.read_turns(spark, f"{tmp_path}/turns", f"{tmp_path}/good", 2).count() == 2
    for name in ("short", "few", "many"):
        with pytest.raises(Exception, match="vector|turn"):
            S.read_turns(spark, f"{tmp_path}/turns", f"{tmp_path}/{name}", 2).collect()


def test_media_files(spark, tmp_path):
    import io
    import wave

    from colloquy.operators import media as D

    def made(channels):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(2)
            w.setframerate(16000)
            w.writeframes(b"\0\0" * channels * 5)
        return out.getvalue()

    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.wav").write_bytes(made(1))
    (tmp_path / "m" / "b.wav").write_bytes(made(2))
    found = D.files(spark, str(tmp_path))
    assert {r.path[-5:]: r.valid for r in D.wav_audit(found).collect()} == {"a.wav": True, "b.wav": False}
    assert {r.sha256 for r in D.manifest(found).collect()} == {__import__("hashlib").sha256(made(c)).hexdigest() for c in (1, 2)}
    S.write_report(S.counters(D.with_stem(found), "extension"), f"{tmp_path}/report")
    S.write_partitioned(spark.createDataFrame([("m", 1, 2.0)], "method string, fold int, x double"), f"{tmp_path}/parts", "method", "fold")
    assert spark.read.json(f"{tmp_path}/report").first().n == 2 and spark.read.parquet(f"{tmp_path}/parts").columns == ["x", "method", "fold"]
    assert {r.key: r.n for r in Q.key_presence(spark.createDataFrame([({"a": 1},), ({"a": 2, "b": 1},)], "m map<string,int>"), "m").collect()} == {"a": 2, "b": 1}
    left, right = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string"), spark.createDataFrame([(1, "y"), (2, None)], "k int, v string")
    assert tuple(Q.disagreements(left, right, ["k"], ["v"]).first()) == (2, 1)


def test_networks_of_all_folds_are_those_of_plain_numpy(spark):
    import numpy as np

    from colloquy.operators import folds as K

    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 5))
    y = (x[:, 0] - x[:, 3] + 0.3 * rng.normal(size=240) > 0.3).astype(int)
    fold, held = np.arange(240) % 3, np.arange(240) // 3 % 5 == 0
    rows = [(i, int(f), int(a), bool(h), v.tolist()) for i, (f, a, h, v) in enumerate(zip(fold, y, held, x))]
    more = [(900, None, 1, False, [0.0] * 5), (901, 1, None, False, [9.0] * 5), (902, 1, 1, None, None)]
    table = spark.createDataFrame(rows + more, "k int, fold int, label int, held_out boolean, features array<double>").repartition(4)
    sets = {"one": [0, 1], "all": [0, 1, 2, 3, 4]}
    models = K.fit(table, [1, 2], sets, steps=12)
    assert [(m.fold, m.seed, m.name) for m in models] == [(f, s, n) for f in range(3) for s in (1, 2) for n in sets]
    got = {(r.k, r.seed): (r.logit_one, r.logit_all) for r in K.predicted(table, models).collect()}
    assert len(got) == 2 * 243 and got[900, 1] == got[902, 2] == (None, None) and got[901, 1][0] is not None
    m = next(m for m in models if (m.fold, m.seed, m.name) == (1, 2, "all"))
    other = fold != 1
    z, t, h = x[other], y[other], held[other]
    mean, scale, p = z.mean(0), z.std(0), (t == 0).sum() / (t == 1).sum()
    z, d = (z - mean) / scale, 5
    r = np.random.default_rng([2, 1, 1])
    a, b, c, e = r.normal(0, d**-0.5, (d, K.HIDDEN)), np.zeros(K.HIDDEN), None, 0.0
    c = r.normal(0, K.HIDDEN**-0.5, K.HIDDEN)
    w, avg, sq, best = [a, b, c, np.array(e)], [0] * 4, [0] * 4, (float("inf"), None, None)
    for step in range(13):
        hid = np.tanh(z @ w[0] + w[1])
        out = hid @ w[2] + w[3]
        each = np.where(t == 1, p, 1)
        loss = each * (np.log1p(np.exp(out)) - t * out)
        if loss[h].sum() / each[h].sum() < best[0] - 1e-12:
            best = (loss[h].sum() / each[h].sum(), step, [v.copy() for v in w])
        g = np.where(h, 0, each * (1 / (1 + np.exp(-out)) - t))
        dh = np.outer(g, w[2]) * (1 - hid**2)
        for k, grad in enumerate((z.T @ dh, dh.sum(0), hid.T @ g, g.sum())):
            grad = grad / each[~h].sum() + K.DECAY * w[k]
            avg[k], sq[k] = 0.9 * avg[k] + 0.1 * grad, 0.999 * sq[k] + 0.001 * grad**2
            w[k] = w[k] - K.RATE * (avg[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(sq[k] / (1 - 0.999 ** (step + 1))) + 1e-8)
    assert m.step == best[1] and m.loss == pytest.approx(best[0], rel=1e-9)
    v = best[2]
    for k in np.flatnonzero(fold == 1).tolist():
        assert got[k, 2][1] == pytest.approx(float(np.tanh((x[k] - mean) / scale @ v[0] + v[1]) @ v[2] + v[3]), rel=1e-6, abs=1e-9)
    right = [(got[k, 1][1] > 0) == (y[k] == 1) for k in range(240)]
    assert sum(right) > 200
    with pytest.raises(ValueError, match="two folds"):
        K.fit(table.filter("fold = 1"), [1], sets)


def test_hashed_texts_have_length_one(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None)], "k int, w array<string>")
    got = {r.k: r.vector for r in X.hashed_text(rows, "k", F.col("w"), 8).collect()}
    assert len(got[1]) == 8 and sum(x * x for x in got[1]) == pytest.approx(1) and got[2] == got[3] == [0.0] * 8


def test_scaler_uses_the_population_deviation(spark):
    rows = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "k int, v array<double>")
    fit = {r.dim: (r["mean"], r.scale) for r in X.scaler(rows, "v").collect()}
    assert fit == {0: (2.0, 1.0), 1: (5.0, 1.0)}
    assert [r.v for r in X.scaled(rows, "v", X.scaler(rows, "v")).orderBy("k").collect()] == [[-1.0, 0.0], [1.0, 0.0]]


def test_encoding_pads_lines_left_and_tokens_right(spark):
    rows = spark.createDataFrame([(1, "a b\nc"), (2, None)], "k int, t string")
    got = {r.k: r for r in X.encoded(rows, "k", "t", X.vocabulary(rows, "t"), 3, 4).collect()}
    assert got[1].ids == [[0, 0, 0, 0], [2, 3, 0, 0], [4, 0, 0, 0]] and got[1].line_mask == [0, 1, 1] and got[2].line_mask == [0, 0, 0]


def test_audits(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    one = Q.accounting(a, a.filter("k = 1"), a.filter("k = 2"), "k").first()
    assert (one.source, one.unbalanced, one.in_both, one.repeated) == (3, 0, 0, 1)
    assert tuple(Q.set_difference(a, a.filter("k = 1"), "k").first()) == (1, 0, 1)


def test_formats_round_trip(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"x": {"utterance": "u", "speaker": "s", "context": ["c"], "context_speakers": ["d"], "show": "F", "sarcasm": true}}')
    row = S.read_keyed_json(spark, str(tmp_path / "t.json"), S.TARGET).first()
    assert row.id == "x" and row.context == ["c"] and row.sarcasm is True
    rows = spark.createDataFrame([("a", 'q"u\no,te'), ("b", None)], "k string, v string")
    S.write_csv(rows, str(tmp_path / "c"), ["v", "k"], unknown="UNKNOWN")
    assert {r.k: r.v for r in S.read_csv(spark, str(tmp_path / "c"), "v string, k string").collect()} == {"a": 'q"u\no,te', "b": "UNKNOWN"}
    S.write_jsonl(rows, str(tmp_path / "j"))
    assert S.read_jsonl(spark, str(tmp_path / "j"), "k string, v string").count() == 2


def test_budget_counts_each_turn_once(spark):
    from colloquy.functions.text import CONDITIONS, prompt, token_count

    texts = [["one two three", None, "<a> b, c"], ["x " * 30, "y"], ["z"] * 6, []]
    rows = [(i, [("s", t) for t in ts], "n", i % 2, 1) for i, ts in enumerate(texts)]
    examples = spark.createDataFrame(rows, "source_index long, context_turns array<struct<speaker:string,text:string>>, next_speaker string, predicted int, target_label int")
    candidates = spark.createDataFrame([(i, t) for i in range(4) for t in ("a b", "c d e")], "source_index long, candidate_text string")
    for budget in (14, 25):
        got = {r.source_index: (r.fits, r.turns_dropped, len(r.context_turns)) for r in C.token_budget(examples, candidates, budget).collect()}
        assert got[3] == (False, 0, 0)
        for i, ts in enumerate(texts[:3]):
            fits = []
            for k in range(len(ts)):
                held = spark.createDataFrame([([("s", t) for t in ts[k:]],)], "t array<struct<speaker:string,text:string>>")
                sizes = held.select(*(token_count(prompt(F.col("t"), F.lit("n"), F.lit(c), F.lit(i % 2), F.lit(1))) for c in CONDITIONS)).first()
                fits += [k] if max(sizes) + 3 <= budget else []
            assert got[i] == ((True, fits[0], len(ts) - fits[0]) if fits else (False, len(ts) - 1, 1))


def test_budget_of_a_long_context(spark):
    long = spark.range(1).select(F.col("id").alias("source_index"), F.expr("transform(sequence(1, 10000), i -> struct('s' as speaker, concat('w', i) as text))").alias("context_turns"), F.lit("n").alias("next_speaker"), F.lit(0).alias("predicted"), F.lit(1).alias("target_label"))
    got = C.token_budget(long, spark.createDataFrame([(0, "a")], "source_index long, candidate_text string"), 3 * 700 + 20).first()
    assert got.fits and 695 <= len(got.context_turns) <= 705 and got.context_turns[-1].text == "w10000" and got.turns_dropped == 10000 - len(got.context_turns)


def test_large_files_are_read_in_pieces(spark, tmp_path):
    import hashlib
    import struct

    from colloquy.operators import media as D

    size = 3 << 30
    head = b"RIFF" + struct.pack("<I", size - 8) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", size - 44)
    with open(tmp_path / "a b%20c.wav", "wb") as f:
        f.write(head)
        f.truncate(size)  # sparse: it takes no room
    (tmp_path / "empty.wav").write_bytes(b"")  # Spark lists no empty files
    got = {r.path[-9:]: r for r in D.wav_audit(D.files(spark, str(tmp_path))).collect()}
    assert got.keys() == {"b%20c.wav"} and got["b%20c.wav"].valid and got["b%20c.wav"].frames == (size - 44) // 2
    want = hashlib.sha256(head)
    for at in range(44, size, 1 << 24):
        want.update(bytes(min(1 << 24, size - at)))
    assert {r.length: r.sha256 for r in D.manifest(D.files(spark, str(tmp_path))).collect()} == {size: want.hexdigest()}


def test_keyed_json_is_read_in_ranges(spark, tmp_path):
    import json
    import random

    from colloquy.sources import keyed as K
    from colloquy.sources.keyed import members

    random.seed(4)
    odd = ['"', "\\", "{", "}", "[", "]", ",", ":", " ", "é", "x", "\n", "\\\\"]
    text = lambda: "".join(random.choice(odd) for _ in range(random.randint(0, 30)))
    want = {f"{i}{text()}": {"a": text(), "b": [text(), {"c": text(), "d": None}], "e": {}} for i in range(60)}
    for indent, ascii_only in ((None, True), (2, False)):
        path = tmp_path / f"k{indent}.json"
        path.write_text(json.dumps(want, indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
        for size in (41, 1 << 20):
            rows = members(spark, str(path), size).collect()
            assert len(rows) == len(want) and {r.key: json.loads(r.value) for r in rows} == want
    (tmp_path / "none.json").write_text(" {\n } ")
    assert members(spark, str(tmp_path / "none.json"), 2).count() == 0
    damaged = ('{"a": 1', '{"a": 1}}', '{"a": 1} x', '{"a": 1}{"b": 2}', "[1]", '{"a": 1, }', '{"a" 1}', '{"a": [1}}', '{"a": "x}', "1", "", '{"a": 1]', '{"a": tru}', '{,"a": 1}')
    for i, bad in enumerate(damaged):
        path = tmp_path / f"bad{i}.json"
        path.write_text(bad)
        if bad in ('{"a": 1', '{"a": 1}{"b": 2}', '{"a": "x}', '', '{"a": tru}'):  # through Spark: no end, a second object, an open string, nothing, a damaged value
            with pytest.raises(Exception, match="JSON|Expecting"):
                raise AssertionError(f"{bad!r} gave {members(spark, str(path), 4).collect()}")
        else:  # the same text as one range
            with open(path, "rb") as f, pytest.raises(ValueError, match="JSON|Expecting"):
                raise AssertionError(f"{bad!r} gave {list(K._cut(str(path), f, 0, len(bad), len(bad), False, 0))}")


def test_audits_count_while_the_table_is_written(spark):
    rows = spark.range(0, 1000, 1, 7).select("id", F.when(F.col("id") % 10 > 0, F.col("id")).alias("x"), (F.col("id") + 1).alias("y"))
    rules = dict(there=F.col("x").isNotNull(), small=F.col("id") < 990, null_counts=F.col("x") >= 0, later=F.col("y") > F.col("id"))
    held, seen = Q.audited(rows.repartition(5, "id"), "audited", ["id", "x"], **rules)
    assert held.columns == ["id", "x"] and held.count() == 1000
    assert {r.rule: r.violations for r in seen.collect()} == {"checked": 1000, "there": 100, "small": 10, "null_counts": 100, "later": 0}
    assert {tuple(r) for r in Q.violations(rows, **rules).collect()} == {tuple(r) for r in seen.collect() if r.rule != "checked"}
    held, seen = Q.audited(rows.filter("id < 0").groupBy("id").agg(F.max("x").alias("x")), "audited", there=F.col("x").isNotNull())
    assert held.count() == 0 and {tuple(r) for r in seen.collect()} == {("checked", 0), ("there", 0)}


def test_digests_of_sets_add_up_in_any_order(spark):
    ids = spark.range(1000).select((F.col("id") * 7).alias("id"), (F.col("id") % 3).alias("part"))
    digest = lambda d: d.agg(set_digest(F.col("id")).alias("d")).first()[0]
    whole = digest(ids)
    assert whole == digest(ids.orderBy(F.desc("id")).repartition(5)) and len(whole) == 60
    assert whole != digest(ids.filter("id > 0")) and digest(ids.filter("id < 0")) == "0" * 60
    parts = ids.groupBy("part").agg(set_digest(F.col("id")).alias("d"))
    assert parts.agg(merged_digest(F.col("d"))).first()[0] == whole
    sums = [sum(int(hashlib.sha256(str(7 * i).encode()).hexdigest()[6 * k : 6 * k + 6], 16) for i in range(1000)) % (1 << 24) for k in range(10)]
    assert whole == "".join(f"{s:06x}" for s in sums)


def test_weights_of_grams_are_the_plain_ones(spark, monkeypatch):
    texts = ["ab ab cab", "abc", "", None, "ca ca ca b", "abc ab"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")

    def grams(text):
        return Counter(p[i : i + n] for w in (text or "").split() for p in [f" {w} "] for n in (2, 3) for i in range(max(1, len(p) - n + 1)))

    train = [grams(t) for t in texts[:5]]
    df, total = Counter(g for t in train for g in t), sum(train, Counter())
    kept = sorted((g for g in df if df[g] >= 2), key=lambda g: (-total[g], g))[:6]
    want = {}
    for i, t in enumerate(texts):
        w = {g: (1 + math.log(n)) * (math.log(6 / (1 + df[g])) + 1) for g, n in grams(t).items() if g in kept}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want |= {(i, g): x / norm for g, x in w.items()}
    for most in (0, 200_000):  # joined in a shuffle, and held by tasks
        monkeypatch.setattr(X, "SMALL_VOCABULARY", most)
        got = {(r.id, r.gram): r.weight for r in X.tfidf(rows, "id", "text", F.col("id") < 5, most=6, high=3).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_models_score_in_a_session_with_tags(spark):
    rows = N.assembled(spark.range(40).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 4 == 0).alias("is_gold"), F.array((F.col("id") % 2).cast("double"), (F.col("id") % 4).cast("double")).alias("v")), "v")
    spark.addTag("tagged")
    try:
        assert all(r["predicted"] == r["y"] for r in N.detector(rows, rows, "y").collect())
        assert all((r["selector_logit"] > 0) == r["is_gold"] for r in N.selector(rows.filter("is_gold or y = 1"), rows.filter("is_gold or y = 1")).collect())
    finally:
        spark.removeTag("tagged")


def test_blocks_count_the_pairs_of_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_ROWS", 2)  # so that classes are cut into blocks
    said = ["the cat sat", "the cat sat on", "cat the sat", "a dog ran off", "ña the cät sät", "", "the", "he", "tac eht tas", "cat " * 40, "cat " * 41]
    lines = [(f"u{i}", [None, "a", "b"][i % 3], " ".join(t.split())) for i, t in enumerate(said * 3)]
    asked = [(f"t{i}", [None, "a", "b", "z"][i % 4], " ".join(t.split())) for i, t in enumerate(said * 4)]
    c = spark.createDataFrame(lines, "utterance_id string, speaker string, text_norm string")
    t = spark.createDataFrame(asked, "target_id string, speaker string, target_norm string")
    counts = lambda x: Counter(x)
    want = {}
    for tid, by, x in asked:
        near = [y for _, s, y in lines if (by is None or s == by) and set(x.split()) & set(y.split()) and 2 * min(len(x), len(y)) >= 0.8 * (len(x) + len(y))]
        if near:
            want[tid] = (len(near), sum(2 * (counts(x) & counts(y)).total() >= 0.8 * (len(x) + len(y)) for y in near))
    assert {r.target_id: (r.pairs, r.allowed) for r in L.token_counts(t, c, signed=True).collect()} == want
    held = {y for *_, y in lines if y}
    assert {r.target_id for r in L.inexact(t, c).collect()} == {tid for tid, _, x in asked if x not in held}


def test_texts_beside_each_other_are_compared_as_one_by_one():
    import random

    import numpy as np
    import pyarrow as pa

    from colloquy.functions.blocks import Characters, near
    from colloquy.functions.similarity import common_subsequence, similarity

    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdeñ") for _ in range(draw.randint(1, 6)))
    held = [" ".join(word() for _ in range(draw.randint(1, 60))) for _ in range(60)] + ["a" * 64, "a" * 128, "a" * 130]
    asked = [held[0], held[3][:-2] + "zz", "a" * 129, "b", "a" * 64]
    texts = Characters(pa.array(held))
    for a in asked:
        assert texts.common(a, np.arange(len(held))).tolist() == [common_subsequence(a, b) for b in held]
    got = {(i, int(k)): s for i, rows, sims in near(pa.array(asked), pa.array(held), 0.8) for k, s in zip(rows, sims, strict=True)}
    assert got == {(i, k): similarity(a, b) for i, a in enumerate(asked) for k, b in enumerate(held) if set(a.split()) & set(b.split()) and similarity(a, b) >= 0.8}


def test_exact_block_of_a_frequent_text(spark, monkeypatch):
    monkeypatch.setattr(L, "SALT_ROWS", 3)
    c = spark.createDataFrame([(f"u{i}", i, 0, "s", "often" if i < 10 else "once" if i == 10 else "") for i in range(12)], "utterance_id string, conversation_id int, order int, speaker string, text_norm string")
    t = spark.createDataFrame([("a", "often"), ("b", "often"), ("c", "once"), ("d", ""), ("e", "none")], "target_id string, target_norm string")
    got = sorted((r.target_id, r.utterance_id) for r in L.exact_block(t, c).collect())
    assert got == sorted([(x, f"u{i}") for x in "ab" for i in range(10)] + [("c", "u10")])


def test_fallback_counts_are_those_of_plain_loops(spark):
    lines = [("a" if i % 2 else "b", "x" * (i % 25)) for i in range(80)] + [(None, "xxxx")]
    asked = [(f"{by}|{n}", by, "y" * n) for by in ("a", "b", "z", None) for n in range(15)]
    got = {r.target_id: r.pairs for r in L.fallback_counts(spark.createDataFrame(asked, "target_id string, speaker string, target_norm string"), spark.createDataFrame(lines, "speaker string, text_norm string")).collect()}
    want = {t: sum((by is None or s == by) and 2 * min(len(x), len(y)) >= 0.8 * (len(x) + len(y)) for s, y in lines) for t, by, x in asked if 0 < len(x) <= 12}
    assert got == {t: n for t, n in want.items() if n}


def test_replies_without_texts_shuffle_none(spark):
    c = spark.createDataFrame([("s", i, f"s|{i}", "ab"[i % 2], f"line {i}") for i in range(6)], "conversation_id string, order int, utterance_id string, speaker string, text string")
    asked = spark.createDataFrame([("s|0", "LEVEL_C_AMBIGUOUS"), ("s|5", "LEVEL_C_AMBIGUOUS")], "utterance_id string, alignment_type string")
    whole, slim = L.observed_reply(asked, c), L.observed_reply(asked, c, text=False)
    assert "response_text" not in slim.columns and {r.utterance_id: r.response_text for r in whole.collect()} == {"s|0": "line 1", "s|5": None}
    assert sorted(map(str, slim.collect())) == sorted(map(str, whole.drop("response_text").collect()))


def test_a_fit_reads_no_more_partitions_than_tasks_run_at_once(spark, monkeypatch):
    seen = []
    for kind in (N.LogisticRegression, N.RandomForestClassifier):
        monkeypatch.setattr(kind, "fit", lambda self, train, fit=kind.fit: seen.append(train.rdd.getNumPartitions()) or fit(self, train))
    rows = N.assembled(spark.range(0, 40, 1, 20).select((F.col("id") % 2).cast("int").alias("y"), F.array((F.col("id") % 2).cast("double"), (F.col("id") % 4).cast("double")).alias("v")), "v")
    for fit in (N.detector, lambda *a: N.forest(*a, trees=2)):
        assert all(r["predicted"] == r["y"] for r in fit(rows, rows, "y").collect())
    assert len(seen) == 2 and max(seen) <= spark.sparkContext.defaultParallelism


def test_grams_of_a_text_stay_in_its_task(spark, monkeypatch):
    monkeypatch.setattr(X, "SUMS", 3)  # sums are handed on after each piece
    texts = ["Ab ab cab", "abc é𝄞", "", None, "ca\u2003ca ca b", "abc " + "x" * 50, "zz"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    plain = lambda w, low: [p[i : i + n] for p in [f" {w} "] for n in range(low, min(4, max(low, len(p))) + 1) for i in range(max(1, len(p) - n + 1))]
    for low in (2, 4):
        per = [Counter(g for w in (t or "").lower().split() for g in plain(w, low)) for t in texts]
        got = {r.gram: (r.df, r.total) for r in X.gram_totals(rows, "text", low, 4).collect()}
        assert got == {g: (sum(g in c for c in per), sum(per, Counter())[g]) for g in sum(per, Counter())}
    plan = X.tfidf(rows, "id", "text", F.col("id") < 5)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and "Join" not in plan


def test_vectors_of_texts_need_no_shuffle_and_lose_no_row(spark):
    rows = spark.createDataFrame([(i, t, 7) for i, t in enumerate(["ab ab cab", "abc", "", None, "ca ca ca b", "zz"])], "id long, text string, more int")
    made = X.with_tfidf(rows, "text", F.col("id") < 5, "v", most=6)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    weights = X.tfidf(rows, "id", "text", F.col("id") < 5, most=6)
    want = {r.id: r.vector for r in X.sparse_vectors(weights, "id").collect()}
    got = {r.id: r.v for r in X.as_vectors(made.filter("more = 7"), "v").collect()}
    assert set(got) == set(range(6)) and {k for k, v in got.items() if v.numNonzeros()} == set(want)
    for k, v in want.items():
        assert got[k].size == v.size and list(got[k].indices) == list(v.indices) and list(got[k].values) == pytest.approx(list(v.values))


def test_networks_read_blocks_of_rows_as_bytes(spark, monkeypatch):
    import numpy as np

    from colloquy.operators import folds as K

    monkeypatch.setattr(K, "BLOCK", 7)
    x = np.random.default_rng(5).normal(size=(60, 3))
    rows = lambda add: spark.createDataFrame([(i % 2, int(v[0] > 0), i % 5 == 0, (v + add).tolist()) for i, v in enumerate(x)], "fold int, label int, held_out boolean, features array<double>").coalesce(2)
    blocks = [(np.frombuffer(r.ids, np.int32).reshape(3, -1), np.frombuffer(r.features).reshape(-1, 3)) for r in K._blocks(rows(0.0)).collect()]
    assert max(ids.shape[1] for ids, _ in blocks) <= 7 and sorted(map(tuple, np.concatenate([f for _, f in blocks]).tolist())) == sorted(map(tuple, x.tolist()))
    near, far = (K.fit(rows(add), [1], {"all": [0, 1, 2]}, steps=6) for add in (0.0, 1e5))
    assert [(m.step, round(m.loss, 4)) for m in near] == [(m.step, round(m.loss, 4)) for m in far]


def test_queries_look_for_candidates_once(spark, monkeypatch):
    from colloquy.plans import corpora, selection

    for module, name in ((selection, "outcome_consistency"), (selection, "score_audit"), (corpora, "fold_audit")):
        found = []
        with monkeypatch.context() as m:
            m.setattr(C, "nearest_texts", lambda *a, find=C.nearest_texts, **k: found.append(a) or find(*a, **k))
            getattr(module, name)(spark, "/root/testdata/sf0.001")
        assert len(found) == 1, name


def test_the_selectors_scaler_reads_written_tasks(spark, monkeypatch):
    from colloquy.plans import corpora

    plans = []
    monkeypatch.setattr(X, "scaler", lambda rows, *a, fit=X.scaler: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or fit(rows, *a))
    out = corpora.selector(spark, "/root/testdata/sf0.001").collect()
    assert out and len(plans) == 1 and "Window" not in plans[0]


def test_verification_writes_no_tasks(spark, monkeypatch):
    from colloquy.plans import selection

    names = []
    monkeypatch.setattr(selection.Q, "written", lambda df, name, *a: names.append(name) or df)
    (row,) = selection.task_verification(spark, "/root/testdata/sf0.001").collect()
    assert not names and row.checked > 0 and (row.text_differs, row.dialogue_differs, row.wrong_reply) == (0, 0, 0)


def test_both_conditions_are_decided_in_one_aggregate(spark):
    rows = [("m", 0, 1, 5, "t5", "E", 1, c, p, f"c{p}", p == 1, z) for c, zs in (("text", (0.5, 0.5)), ("text_audio", (0.1, 0.9))) for p, z in enumerate(zs)]
    rows += [("m", 0, 1, 6, "t6", "E", 0, "text", 0, "c0", True, 0.2)]
    s = spark.createDataFrame(rows, "method string, fold int, seed int, source_index long, sample_id string, episode_id string, target_label int, condition string, candidate_pos int, candidate_id string, is_gold boolean, selector_logit double")
    p = spark.createDataFrame([("m", 0, 1, k, 1, 1, 0) for k in (5, 6)], "method string, fold int, seed int, source_index long, true_label int, text_label int, text_audio_label int")
    out = M.outcomes(s, p)
    assert {r.source_index: (r.response_text_correct, r.response_text_audio_correct) for r in out.collect()} == {5: (0, 1), 6: (1, None)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_bootstrap_products_are_made_in_arrays(spark):
    stats = spark.createDataFrame([(m, f"E{i}", *([i + 1] * len(M.SUMS))) for m in ("a", "b") for i in range(5)], "method string, episode_id string, " + ", ".join(f"{c} long" for c in M.SUMS))
    out = M.bootstrap(stats, 150)
    assert "flatten" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert all(r.valid == 150 and r.low <= r.high for r in out.collect())


def test_shared_runs_rule_out_texts_that_cannot_be_alike():
    import random

    import numpy as np
    import pyarrow as pa

    from colloquy.functions.blocks import Characters, Runs
    from colloquy.functions.similarity import similarity

    draw = random.Random(7)
    parts = "th er on an re he in ed nd ha at en es of or the and ñ 𝄞 ".split(" ")
    said = [" ".join("".join(draw.choices(parts, k=draw.randint(1, 4))) for _ in range(draw.randint(8, 30))) for _ in range(300)]
    change = lambda t: "".join(c for c in t if draw.random() > 0.1)
    said += [change(t) for t in said[:60]] + [t[len(t) // 3 :] + t[: len(t) // 3] for t in said[:20]] + ["", "a", "and " * 50, "and " * 49, said[0]]
    runs, rows = Runs(Characters(pa.array(said)), 300), np.arange(len(said))
    asked = [change(t) for t in said[:40]] + ["and " * 51, "q", "zzzz the", said[0], said[-3] + "Ω"]
    kept = [set(runs.allowed(a, rows, 0.8).tolist()) for a in asked]
    near = [{k for k, t in enumerate(said) if similarity(a, t) >= 0.8} for a in asked]
    assert all(few >= some for few, some in zip(kept, near, strict=True)) and sum(map(len, near)) > 80
    long = [k for k, t in enumerate(said) if len(t) > 60]
    assert sum(len(set(long) & few - some) for few, some in zip(kept[:40], near[:40], strict=True)) < 0.1 * 40 * len(long)


def _tables_written(monkeypatch):
    """Rows of each table that the alignment writes."""
    from colloquy.plans import alignment as P

    seen = {}
    for module in (L, P):
        monkeypatch.setattr(module, "written", lambda df, name, *a, written=module.written, **k: [out := written(df, name, *a, **k), seen.__setitem__(name, out.count())][0])
    return seen


def test_alignment_makes_no_row_of_a_pair(spark, monkeypatch):
    import random

    seen = _tables_written(monkeypatch)
    monkeypatch.setattr(L, "MEET_ROWS", 16)  # so that rows and targets of a text are dealt over salts
    monkeypatch.setattr(L, "MEET_PAIRS", 64)
    draw = random.Random(3)
    before = ["how are you my dear old friend today", "how are you my dear old friends today", "nothing at all to see in here", "..."]
    corpus, targets = [], []
    for scene in range(60):
        lead = [draw.choice(before) for _ in range(2)]
        said = "the same words are here again and again" if scene % 6 else "the same words are here again and agai"
        corpus += [(str(scene), i, draw.choice("ab"), t) for i, t in enumerate([*lead, said])]
        targets.append((f"t{scene:02d}", draw.choice([said, said, said + "x"]), draw.choice(["a", "b", None]), [draw.choice(before) for _ in range(draw.randint(0, 2))], None, None))
    targets = [(*t[:4], [draw.choice(["a", "b", None]) for _ in t[3]], None) for t in targets]
    got = {r.target_id: (r.alignment_type, r.utterance_id, r.evidence, r.target_sim, r.context1, r.context2, r.num_candidates, r.num_high) for r in L.aligned(spark.createDataFrame(targets, TARGET), lines(spark, corpus)).collect()}
    assert got == plain_alignment(targets, corpus)
    assert sum(v[6] for v in got.values()) > 1000 and seen["frequent-texts"] and max(seen.values()) <= len(corpus)


def test_decisions_make_no_row_of_a_pair(spark, monkeypatch, tmp_path):
    import random

    import duckdb

    from colloquy.plans import alignment as P

    seen = _tables_written(monkeypatch)
    monkeypatch.setattr(P, "DECISION_ROWS", 64)
    monkeypatch.setattr(L, "MEET_PAIRS", 512)
    draw = random.Random(8)
    texts = ["\n".join(draw.choice(["the same old line.", "a line of words", "more words.", f"own line {k}-{i}."]) for i in range(draw.randint(1, 12))) for k in range(400)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in P.alignment_decisions(spark, str(tmp_path)).collect())
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = sorted(con.execute(P.ORACLES["alignment_decisions"]).fetchall())
    assert got == want and len({r[1] for r in got}) >= 3
    assert sum(r[8] for r in got) > 20_000 and seen["frequent-texts"] and max(seen.values()) <= sum(len(t.split("\n")) for t in texts)


def test_reports_normalise_the_corpus_once(spark, monkeypatch, tmp_path):
    from colloquy.plans import alignment as P

    seen = []
    monkeypatch.setattr(L, "normalise", lambda text, *a, normalise=L.normalise, **k: seen.append(str(text)) or normalise(text, *a, **k))
    spark.createDataFrame([(k, "one line here.\nanother line\nmore lines here!") for k in range(30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for query in (P.decision_report, P.alignment_report):
        seen.clear()
        assert query(spark, str(tmp_path)).first()["targets"] > 0
        assert sum(t == str(F.col("text")) for t in seen) == 2  # with and without apostrophes
