import hashlib
import random
import string
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from colloquy.functions import similarity as S
from colloquy.functions import text as T
from colloquy.functions.hashing import bucket, stable_int
from colloquy.operators import align as L
from colloquy.operators import media as D


def values(spark, column, inputs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_normalise(spark):
    got = values(spark, T.normalise(F.col("x")), ["Don’t  STOP… now", "ﬁne ½ x²", "İstanbul", None, "TRANSCRIPT_NOTE"])
    assert got[0] == "don't stop now" and got[3] == "" and got[4] == "transcript_note"
    assert got[1].split() == ["fine", "1", "2", "x2"]


def test_clean_and_quote(spark):
    assert values(spark, T.clean(F.col("x")), [" a\t", "\t\n", None, ""]) == ["a", None, None, None]
    assert values(spark, T.quote(F.col("x")), [" <b> "]) == ["‹b›"]


def test_utterance_id(spark):
    good = values(spark, T.utterance_id(F.col("x")), ["s01_e02_c03_u14"])[0]
    assert tuple(good) == (1, 2, 3, 14)
    with pytest.raises(Exception, match="not an utterance id"):
        values(spark, T.utterance_id(F.col("x")), ["s1_e02_c03_u1"])


def test_hashes_match_python(spark):
    import hashlib

    n = int(hashlib.sha256(b"salt|a").hexdigest()[:16], 16)
    assert int(values(spark, stable_int(F.col("x"), "salt"), ["a"])[0]) == n
    assert values(spark, bucket(F.col("x"), "salt", 7), ["a"])[0] == n % 7


def test_similarity_is_the_ratio_and_bounds_lose_nothing():
    random.seed(5)
    for _ in range(300):
        a = "".join(random.choice("abcd e") for _ in range(random.randint(0, 30)))
        b = "".join(c for c in a if random.random() > 0.15) if random.random() < 0.7 else "".join(random.choice(string.ascii_lowercase) for _ in range(20))
        exact = 0.0 if not a or not b else 1.0 if a == b else SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert S.similarity(a, b) == exact
        assert S.similarity(a, b, 0.8) == exact or exact < 0.8


def test_long_texts_have_the_same_ratio(monkeypatch):
    monkeypatch.setattr(S, "LONG", 5)
    random.seed(6)
    for _ in range(200):
        a = "".join(random.choice("abc d") for _ in range(random.randint(1, 60)))
        b = "".join(random.choice("abc d") for _ in range(random.randint(5, 60))) if random.random() < 0.5 else "".join(c for c in a if random.random() > 0.2) + "abcda"
        assert S.similarity(a, b) == (1.0 if a == b else SequenceMatcher(None, a, b, autojunk=False).ratio())


def test_prompt_conditions(spark):
    rows = spark.createDataFrame([("text_only",), ("self_multimodal",), ("oracle",)], "c string").withColumn("t", F.array(F.struct(F.lit("a").alias("speaker"), F.lit("<x>").alias("text"))))
    got = {r[0]: r[1] for r in rows.select("c", T.prompt(F.col("t"), F.lit("b"), F.col("c"), F.lit(1), F.lit(0))).collect()}
    assert "Status" not in got["text_only"] and "Status: sarcastic" in got["self_multimodal"] and "Status: literal" in got["oracle"] and "‹x›" in got["oracle"]


def test_feasibility_boundaries(spark):
    cases = [((80, 10, 0.2, 0.75, 0.5), "WEAK"), ((79, 10, 0.2, 0.75, 0.5), "NOT_RECOMMENDED"), ((200, 30, 0.1, 0.6, 0.0), "STRONG"), ((150, 20, 0.15, 0.7, 0.0), "MODERATE"), ((300, 30, 0.1, 0.61, 0.0), "MODERATE"), ((300, 30, 0.21, 0.1, 0.0), "NOT_RECOMMENDED")]
    rows = spark.createDataFrame([(i, *map(float, c)) for i, (c, _) in enumerate(cases)], "i int, r double, e double, s double, p double, a double")
    got = [r[0] for r in rows.orderBy("i").select(L.feasibility(*(F.col(c) for c in "respa"))).collect()]
    assert got == [v for _, v in cases]


def test_probe_log(spark):
    logs = ["  Duration: 01:02:03.50, x\n Stream: Audio: aac, 44100 Hz, stereo, s16\n", "Duration: 00:00:01.00", "nothing", "Duration: 00:00:01.00\nAudio: pcm, 48000 Hz, 3 channels, s16"]
    got = values(spark, T.probe_log(F.col("x")), logs)
    assert tuple(got[0]) == (3723.5, 44100, 2, None) and got[1]["failure"] == "NO_AUDIO_STREAM" and got[2]["failure"] == "PROBE_FAILED" and got[3]["channels"] == 3


def test_wav_header():
    import io
    import wave

    def made(channels, frames):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(2)
            w.setframerate(16000)
            w.writeframes(b"\0\0" * channels * frames)
        return out.getvalue()

    assert D.wav_header(made(1, 10)) == {"channels": 1, "rate": 16000, "bits": 16, "frames": 10, "failure": None}
    assert D.wav_header(made(2, 10))["channels"] == 2 and D.wav_header(made(1, 0))["frames"] == 0
    assert D.wav_header(made(1, 10)[:-4])["failure"] == "TRUNCATED" and D.wav_header(b"RIFF")["failure"] == "NOT_WAV"


def test_neighbouring_lines_of_all_lengths_are_scored(spark, tmp_path):
    from colloquy.plans import alignment as P

    random.seed(3)
    line = lambda n: " ".join("".join(random.choices("abcde", k=4)) for _ in range(n // 5)).strip()
    a, b = line(600), line(1500)
    lines = ["short one", "short two", a, a + " more", b, b[:1199] + " end", "short one"]
    spark.createDataFrame([(7, "\n".join(lines))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.utterance_id: r.ratio for r in P.similarity_scores(spark, str(tmp_path)).collect()}
    assert set(got) == {f"7|{i}" for i in range(6)}  # all neighbours, also those of 400 characters and more
    for i in (2, 4):
        assert got[f"7|{i}"] == round(SequenceMatcher(None, lines[i], lines[i + 1], autojunk=False).ratio(), 6)


def test_buckets_are_the_hash_modulo(spark):
    rows = spark.range(200).select("id", *(bucket(F.col("id"), "s", n).alias(f"n{n}") for n in (1, 2, 21, 1_000_000, 2**31 - 1))).collect()
    for r in rows:
        whole = int(hashlib.sha256(f"s|{r.id}".encode()).hexdigest()[:16], 16)
        assert all(r[f"n{n}"] == whole % n for n in (1, 2, 21, 1_000_000, 2**31 - 1))


def test_matching_blocks_in_bits_are_those_of_the_standard_library(monkeypatch):
    from colloquy.functions import similarity as Y

    random.seed(11)
    made = lambda n, of: "".join(random.choices(of, k=n))
    pairs = [(made(random.randrange(1, 70), of), made(random.randrange(1, 70), of)) for of in ("ab", "abc ", "abcdefghij é𝄞", "a") for _ in range(60)]
    pairs += [("ab" * 40, "ba" * 40), ("x" * 63, "x" * 64), ("abc", "xyz"), ("q", "aqa"), (made(900, "abcde "), made(1100, "abcde "))]
    want = [SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs]
    for long in (4096, 20):  # all in bits, and long ones by runs until their parts are short
        monkeypatch.setattr(Y, "LONG", long)
        assert [1.0 if a == b else 2 * Y._matched(a, b) / (len(a) + len(b)) for a, b in pairs] == want
        assert [Y.similarity(a, b) for a, b in pairs] == want
