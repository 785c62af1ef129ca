"""Queries over features, models, audits and media."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.functions.hashing import bucket
from colloquy.operators import audit as Q
from colloquy.operators import candidates as C
from colloquy.operators import features as X
from colloquy.operators import folds as K
from colloquy.operators import media as D
from colloquy.operators import metrics as M
from colloquy.operators import models as N
from colloquy.plans.selection import _RECORDS, _SETS, _rounded, records, tasks
from colloquy.sources import adapters as A
from colloquy.sources import io as S
from colloquy.sources.adapters import SQL, h
from colloquy.sources.storage import written


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = A.turns(spark, sf_dir).filter(bucket(F.col("episode_id"), C.SALT, 4) != 0)
    return X.vocabulary(train, "text")


def encoded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the encoded turns: used lines and tokens, unknown tokens, and all ids."""
    t = A.turns(spark, sf_dir).filter("text is not null")
    e = X.encoded(t, "source_index", "text", X.vocabulary(t.filter(bucket(F.col("episode_id"), C.SALT, 4) != 0), "text"))
    flat = lambda c: F.aggregate(F.flatten(c), F.lit(0).cast("long"), lambda a, x: a + x)
    return e.select("source_index", F.aggregate("line_mask", F.lit(0), lambda a, x: a + x).alias("lines"), flat("token_mask").alias("tokens"), flat("ids").alias("id_sum"), F.size(F.filter(F.flatten("ids"), lambda x: x == 1)).alias("unknown"))


def audio_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).join(A.audio(spark, sf_dir), "source_index")
    return _rounded(X.scaler(C.with_fold(rows).filter("fold <> 0"), "target_audio"))


def scaled_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.with_fold(records(spark, sf_dir).join(A.audio(spark, sf_dir), "source_index"))
    out = X.scaled(rows, "target_audio", X.scaler(rows.filter("fold <> 0"), "target_audio"))
    return _rounded(out.select("source_index", F.aggregate("target_audio", F.lit(0.0), lambda a, x: a + x * x).alias("square_norm"), F.size("target_audio").alias("dims")))


def audio_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = A.audio(spark, sf_dir)
    valid = T.valid_vector(F.col("target_audio"), 64)
    return a.agg(F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("valid"))


def pooled_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean audio vector per dialogue, of length 1; its first value and largest."""
    rows = A.turns(spark, sf_dir).select("source_index", "dialogue_id").join(A.audio(spark, sf_dir), "source_index")
    return _rounded(X.mean_pooled(rows, "dialogue_id", "target_audio").select("dialogue_id", F.get("vector", F.lit(0)).alias("first_value"), F.array_max("vector").alias("largest")))


def text_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF rows summed up: grams and weight sum per turn."""
    t = A.turns(spark, sf_dir).filter("text is not null")
    w = X.tfidf(t, "source_index", "text", bucket(F.col("episode_id"), C.SALT, 4) != 0, min_df=2, most=1_000_000, low=2, high=3)
    return _rounded(w.groupBy("source_index").agg(F.count(F.lit(1)).alias("grams"), F.sum("weight").alias("total"), F.sum(F.col("weight") * F.col("weight")).alias("square")))


def sequence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate scores from token log-probabilities; here each token's is minus its length."""
    t = A.turns(spark, sf_dir).filter("text is not null")
    lp = F.transform(T.tokens(F.col("text"), None), lambda w: -F.length(w).cast("double"))
    return _rounded(M.sequence_scores(t.select("source_index", lp.alias("logprobs"))).select("source_index", "total", "mean", "n"))


def _heard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with fold, detector_text, audio (scaled; fitted on all folds but 0) and heard, which is null for those without a vector."""
    r = C.with_fold(records(spark, sf_dir)).select("source_index", "fold", "target_label", T.lines_of(F.col("context_turns")).alias("detector_text"))
    rows = written(r.join(A.audio(spark, sf_dir).withColumn("heard", F.lit(True)), "source_index", "left"), "heard-rows")
    return X.scaled(rows, "target_audio", X.scaler(rows.filter("fold <> 0"), "target_audio")).withColumnRenamed("target_audio", "audio")


def _recognised(fit, rows: DataFrame, *columns: str) -> DataFrame:
    features = N.assembled(rows, *columns)
    out = fit(features.filter("fold <> 0"), features, "target_label").withColumn("held_out", F.col("fold") == 0)
    return M.binary_metrics(out, "target_label", "predicted", "held_out").withColumn("features", F.lit("+".join(columns)))


def detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognition by balanced logistic regression from text, and from text and audio: metrics of fold 0 and of the others."""
    rows = X.with_tfidf(_heard_rows(spark, sf_dir), "detector_text", F.col("fold") != 0, "text_vector").filter("heard").select("source_index", "fold", "target_label", "audio", "text_vector")
    rows = X.as_vectors(rows, "text_vector")
    return _rounded(_recognised(N.detector, rows, "text_vector").unionByName(_recognised(N.detector, rows, "text_vector", "audio")))


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by random forests of 300 trees; the text is a vector of 64 hashed words there."""
    rows = _heard_rows(spark, sf_dir).filter("heard").withColumn("words", T.tokens(F.col("detector_text"), None))
    rows = written(HashingTF(inputCol="words", outputCol="hashed", numFeatures=64).transform(rows).select("source_index", "fold", "target_label", "audio", "hashed"), "forest-rows")
    return _rounded(_recognised(N.forest, rows, "hashed").unionByName(_recognised(N.forest, rows, "hashed", "audio")))


def selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection accuracy of a head over text, scaled audio and status, per fold and whether the episode was held out.

    The text vector of a candidate stands in for an encoder's: hashed words of context and candidate, in 256 dimensions.
    """
    words = F.concat(T.tokens(T.lines_of(F.col("context_turns")), None), F.transform(T.tokens(F.col("candidate_text"), None), lambda w: F.concat(F.lit("> "), w)))
    t = tasks(spark, sf_dir).withColumns({"words": words, "status": T.status_vector(F.lit("oracle"), F.col("target_label"), F.col("target_label")), "held_out": N.holdout(F.col("episode_id"), "head")})
    t = Normalizer(inputCol="counts", outputCol="text_vector").transform(HashingTF(inputCol="words", outputCol="counts", numFeatures=256).transform(t))
    t = written(t.select("source_index", "fold", "sample_id", "candidate_pos", "is_gold", "held_out", "status", "text_vector"), "selector-tasks")
    heard = A.audio(spark, sf_dir)
    heard = X.scaled(heard, "target_audio", X.scaler(heard.join(t.filter("not held_out").select("source_index").distinct(), "source_index", "left_semi"), "target_audio", 1e-6))
    rows = N.assembled(written(t.join(heard, "source_index"), "selector-rows"), "text_vector", "target_audio", "status")
    out = N.selector(rows.filter("not held_out"), rows)
    return _rounded(M.decisions(out, "fold", "sample_id", "held_out").groupBy("fold", "held_out").agg(F.avg("correct").alias("accuracy"), F.count(F.lit(1)).alias("n")))


SEEDS, DIMS = [11, 12, 13], 64


def _with_vectors(rows: DataFrame, spark: SparkSession, sf_dir: str, words) -> DataFrame:
    """rows with features: a text vector of DIMS, then the audio vector of their turn."""
    rows = X.with_hashed_text(rows, words, DIMS)
    heard = A.audio(spark, sf_dir).select("source_index", F.col("target_audio").cast("array<double>").alias("__audio"))
    return rows.join(heard, "source_index").withColumn("features", F.concat("vector", "__audio")).drop("vector", "__audio")


def fold_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognition of every turn, per seed, by models that did not learn from its fold: probabilities and labels from text and from text and audio."""
    r = C.with_fold(records(spark, sf_dir)).withColumns({"words": T.tokens(T.lines_of(F.col("context_turns")), None), "label": F.col("target_label"), "held_out": N.holdout(F.col("episode_id"), "head")})
    rows = _with_vectors(r.select("source_index", "dialogue_id", "episode_id", "fold", "label", "held_out", "words"), spark, sf_dir, F.col("words")).drop("words")
    rows = written(rows, "recognition-vectors")
    done = K.predicted(rows, K.fit(rows, SEEDS, {"text": list(range(DIMS)), "text_audio": list(range(2 * DIMS))}))
    p = lambda name: 1 / (1 + F.exp(-F.col(f"logit_{name}")))
    return done.select(F.lit("network").alias("method"), "fold", "seed", "source_index", "dialogue_id", "episode_id", F.col("label").alias("true_label"), *(x for n in ("text", "text_audio") for x in (F.round(p(n), 6).alias(f"{n}_probability"), (F.round(p(n), 6) >= 0.5).cast("int").alias(f"{n}_label"))))


def _fold_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks(spark, sf_dir)
    return written(t.select("source_index", "sample_id", "episode_id", "fold", "candidate_pos", "candidate_id", "is_gold", "context_turns", "candidate_text"), "fold-tasks")


def _fold_scores(spark: SparkSession, sf_dir: str, t: DataFrame) -> DataFrame:
    """Candidate scores of all targets, per seed and condition, by models that did not learn from the target's fold."""
    t = t.withColumn("words", F.concat(T.tokens(T.lines_of(F.col("context_turns")), None), F.transform(T.tokens(F.col("candidate_text"), None), lambda w: F.concat(F.lit("> "), w))))
    t = t.withColumns({"label": F.col("is_gold").cast("int"), "held_out": N.holdout(F.col("episode_id"), "head")})
    rows = _with_vectors(t.select("source_index", "sample_id", "episode_id", "fold", "candidate_pos", "candidate_id", "is_gold", "label", "held_out", "words"), spark, sf_dir, F.col("words")).drop("words")
    rows = written(rows, "candidate-vectors")
    models = K.fit(rows, SEEDS, {"text": list(range(DIMS)), "text_audio": list(range(2 * DIMS))}, positive=3.0)
    long = K.predicted(rows, models).withColumn("c", F.explode(F.array(*(F.struct(F.lit(n).alias("condition"), F.round(f"logit_{n}", 6).alias("selector_logit")) for n in ("text", "text_audio")))))
    return long.select(F.lit("network").alias("method"), "fold", "seed", "sample_id", "episode_id", "source_index", "candidate_pos", "candidate_id", "is_gold", "c.*")


def fold_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of selection per fold, seed and condition, of targets that the model did not learn from."""
    d = M.decisions(_fold_scores(spark, sf_dir, tasks(spark, sf_dir)))
    return _rounded(d.groupBy("method", "fold", "seed", "condition").agg(F.avg("correct").alias("accuracy"), F.count(F.lit(1)).alias("n")))


def fold_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of complete runs over the scores of all folds and seeds."""
    t = _fold_tasks(spark, sf_dir)
    s = written(_fold_scores(spark, sf_dir, t), "fold-scores")
    targets = written(t.select("source_index", "episode_id", "fold").distinct(), "targets")
    per = targets.groupBy("fold").agg(F.count(F.lit(1)).alias("targets"))
    shared = targets.groupBy("episode_id").agg(F.count_distinct("fold").alias("k")).agg((F.max("k") > 1).alias("overlap"))  # one row
    size = s.groupBy("method", "fold", "seed").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("sample_id").alias("samples"))
    runs = size.groupBy("method", "fold").agg(F.array_sort(F.collect_list(F.struct("seed", "rows"))).alias("r"), F.max("samples").alias("evaluation_targets"), F.sum("samples").alias("predicted"))
    all_targets = per.agg(F.sum("targets").alias("all_targets"))  # one row
    runs = runs.join(shared).join(all_targets).join(per.withColumnRenamed("targets", "own"), "fold")
    runs = runs.select("method", "fold", F.when(F.col("predicted") == F.col("own") * len(SEEDS), "complete").otherwise("partial").alias("status"), "overlap", F.transform("r", lambda x: x["seed"]).alias("seeds"), (F.col("all_targets") - F.col("own")).alias("training_targets"), (F.col("all_targets") - F.col("evaluation_targets")).alias("others"), "evaluation_targets", F.transform("r", lambda x: x["rows"]).alias("score_rows"), F.lit("one").alias("config"))
    return Q.run_violations(runs, per, SEEDS, F.col("others"))


def turn_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.turns(spark, sf_dir)
    _, seen = Q.audited(t, "turns", text_present=F.col("text").isNotNull(), label_known=F.col("label").isin(0, 1), speaker_known=F.col("speaker").isin("spk0", "spk1"), dialogue_in_episode=F.col("dialogue_id").startswith(F.col("episode_id")))
    return seen.filter("rule <> 'checked'")


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.value_counts(A.turns(spark, sf_dir), "speaker", "label", "episode_id")


def context_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(Q.array_lengths(records(spark, sf_dir), "context_turns"))


def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.missing(A.read(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source")


def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(Q.concentration(records(spark, sf_dir), "episode_id", "next_speaker"))


def repeated_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.duplicates(records(spark, sf_dir), "response").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("rows"))


def accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible turns as accepted and the others as rejected, of which some are lost, some in both and some repeated in the source."""
    t, r = A.turns(spark, sf_dir).select("source_index"), records(spark, sf_dir).select("source_index")
    hit = lambda rule, n: bucket(F.col("source_index"), rule, n) == 0
    rejected = t.join(r, "source_index", "left_anti").filter(~hit("lost", 6)).unionByName(r.filter(hit("both", 15)))
    return Q.accounting(t.unionByName(t.filter(hit("twice", 25))), r, rejected, "source_index")


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with a candidate set against turns of an even number."""
    return Q.set_difference(A.turns(spark, sf_dir).filter("source_index % 2 = 0"), C.candidate_sets(records(spark, sf_dir)), "source_index")


def json_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts to JSON cells and back; cells that are cut short, empty or null give the default."""
    r = records(spark, sf_dir).select("source_index", F.transform("context_turns", lambda t: t["text"]).alias("c"))
    kind = bucket(F.col("source_index"), "cell", 5)
    cell = S.json_cell(F.col("c"))
    cell = F.when(kind == 0, F.substring(cell, F.lit(1), F.length(cell) - 1)).when(kind == 1, "").when(kind == 2, F.lit(None)).otherwise(cell)
    back = S.parse_json_cell(cell, "array<string>", F.array(F.lit("default")))
    return r.select("source_index", F.size(back).alias("n"), F.array_join(back, "|").alias("texts"))


def speaker_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.counters(A.corpus(spark, sf_dir), "speaker")


def probe_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe logs written from turns, and parsed."""
    t = A.turns(spark, sf_dir)
    n = bucket(F.col("source_index"), "probe", 5000)
    log = F.concat(F.format_string("  Duration: 00:%02d:%02d.50, start: 0\n", (n / 60 % 60).cast("int"), (n % 60).cast("int")), F.when(n % 7 != 0, F.concat(F.lit("  Stream #0:1: Audio: aac, 44100 Hz, "), F.when(n % 2 == 0, "stereo").otherwise("6 channels"), F.lit(", fltp"))).otherwise(""))
    return t.select("source_index", T.probe_log(log).alias("p")).select("source_index", "p.*")


def media_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns against a table of paths made from them: none, one or two files a turn."""
    t = A.turns(spark, sf_dir).select(F.col("source_index").cast("string").alias("id"), bucket(F.col("source_index"), "media", 4).alias("k"))
    a, b = F.concat(F.lit("/m/raw/"), "id", F.lit(".mp4")), F.concat(F.when(F.col("k") == 2, "/m/utterances_final/").otherwise("/m/other/"), "id", F.lit(".MP4"))
    paths = t.select(F.explode(F.when(F.col("k") == 0, F.array().cast("array<string>")).when(F.col("k") == 1, F.array(a)).otherwise(F.array(a, b))).alias("path"))
    return D.located(t, paths, "id").groupBy("k").agg(F.count("path").alias("found"), F.count_if(F.col("path").contains("utterances_final")).alias("preferred"), F.count_if(F.col("failure") == "VIDEO_NOT_FOUND").alias("none"), F.count_if(F.col("failure") == "MULTIPLE_VIDEO_CANDIDATES").alias("several"))


def field_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have each field, if null ones are left out."""
    d = A.read(spark, sf_dir, "documents")
    d = d.withColumn("lang", F.when(bucket(F.col("doc_id"), "no-lang", 4) != 0, F.col("lang")))
    fields = F.map_filter(F.create_map(*(x for c in ("doc_id", "text", "lang", "source") for x in (F.lit(c), F.col(c).cast("string")))), lambda _, v: v.isNotNull())
    return Q.key_presence(d.select(fields.alias("m")), "m")


def reason_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the reasons of turns."""
    t = A.turns(spark, sf_dir)
    notes = T.tags(no_text=F.col("text").isNull(), positive=F.col("label") == 1, first_speaker=F.col("speaker") == "spk0", brief=F.length("text") < 200)
    return Q.tag_counts(t.select(notes.alias("notes")), "notes")


def context_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy(F.size("context_turns").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def next_line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("source_index", T.next_line_text(F.col("context_turns"), F.col("next_speaker")).alias("detector_text"))


def _availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up media of turns: path, probe values, failure and digest, of which some break a rule."""
    k = lambda rule, n: bucket(F.col("source_index"), rule, n)
    t = A.turns(spark, sf_dir).select("source_index", "episode_id", (k("level", 3)).alias("k"))
    t = t.withColumn("level", F.element_at(F.array(*map(F.lit, ("LEVEL_A_EXACT", "LEVEL_B_HIGH_CONFIDENCE", "LEVEL_C_AMBIGUOUS"))), F.col("k") + 1)).drop("k")
    found, heard = k("video", 10) != 0, k("audio", 8) != 0
    path = F.concat(F.when(k("folder", 12) == 0, "/m/other/").otherwise("/m/utterances_final/"), F.col("source_index").cast("string"), F.lit(".mp4"))
    digest = F.sha2(F.col("source_index").cast("string"), 256)
    return t.withColumns({
        "video_found": found, "audio_extractable": found & heard, "failure": F.when(~found, "VIDEO_NOT_FOUND").when(~heard, "NO_AUDIO_STREAM"), "path": F.when(found, path),
        "duration": k("seconds", 20).cast("double"), "channels": k("channels", 3), "sample_rate": F.when(k("rate", 9) != 0, 44100).otherwise(0), "length": F.lit(1000), "sha256": F.when(k("digest", 11) == 0, F.upper(digest)).otherwise(digest),
    })


def media_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage by level of a match."""
    a = written(_availability(spark, sf_dir), "availability")
    return _rounded(D.coverage(a, a, "source_index", "level"))


def media_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.gate(_availability(spark, sf_dir))


def media_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _availability(spark, sf_dir).groupBy(F.coalesce("failure", F.lit("NONE")).alias("failure")).agg(F.count(F.lit(1)).alias("n"))


def media_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.media_violations(_availability(spark, sf_dir))


def review_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible turns as review rows, with their media."""
    return D.with_media(records(spark, sf_dir).select("source_index", "response"), _availability(spark, sf_dir), "source_index").select("source_index", "target_audio_path", "target_audio_sha256")


_FOLD = lambda e: f"({h(chr(39) + C.SALT + '|' + chr(39) + ' || ' + e)} % 4)::INT"
_TOKENS = """said AS (SELECT source_index, episode_id, generate_subscripts(l, 1) AS place, unnest(l) AS line FROM (SELECT source_index, episode_id, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_full_match(x, '\\s*')) AS a, a[-6:] AS l FROM turns WHERE text IS NOT NULL)),
    words AS (SELECT source_index, episode_id, place, unnest(list_slice(regexp_extract_all(lower(line), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]'), 1, 64)) AS token FROM said)"""
_VOCAB = f"{SQL['turns']}, {_TOKENS}, counted AS (SELECT token, count(*) AS n FROM words WHERE {_FOLD('episode_id')} <> 0 GROUP BY 1), vocab AS (SELECT token, n, (row_number() OVER (ORDER BY n DESC, token) + 1)::INT AS id FROM counted QUALIFY id <= 49999)"
_AUDIO = f"{_RECORDS}, {SQL['audio']}, heard AS MATERIALIZED (SELECT r.source_index, fold, generate_subscripts(target_audio, 1) - 1 AS dim, unnest(target_audio)::DOUBLE AS x FROM records r JOIN audio USING (source_index)), fitted AS MATERIALIZED (SELECT dim, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-8 THEN 1 ELSE stddev_pop(x) END AS scale FROM heard WHERE fold <> 0 GROUP BY 1)"
_GRAMS = f"""{SQL['turns']}, padded AS (SELECT source_index, episode_id, unnest(list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''), lambda w: ' ' || w || ' ')) AS p FROM turns WHERE text IS NOT NULL),
    sizes AS (SELECT *, unnest([2, 3]) AS n FROM padded), grams AS (SELECT source_index, episode_id, substr(p, i, n) AS gram FROM sizes, LATERAL (SELECT unnest(range(1, greatest(length(p) - n + 2, 2))) AS i)),
    tf AS (SELECT source_index, episode_id, gram, count(*) AS tf FROM grams GROUP BY ALL), idf AS (SELECT gram, ln((1 + (SELECT count(*) FROM turns WHERE text IS NOT NULL AND {_FOLD('episode_id')} <> 0)) / (1 + count(*))) + 1 AS idf FROM tf WHERE {_FOLD('episode_id')} <> 0 GROUP BY 1 HAVING count(*) >= 2),
    w AS (SELECT source_index, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (gram))"""
_COUNT = lambda c: f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS n FROM turns GROUP BY 2"

_K = lambda rule, n: f"{h(f"'{rule}|' || source_index")} % {n}"
_MEDIA = f"""{SQL['turns']}, media AS (SELECT source_index, CASE {_K('level', 3)} WHEN 0 THEN 'LEVEL_A_EXACT' WHEN 1 THEN 'LEVEL_B_HIGH_CONFIDENCE' ELSE 'LEVEL_C_AMBIGUOUS' END AS level, {_K('video', 10)} <> 0 AS found, {_K('audio', 8)} <> 0 AS heard,
    CASE WHEN {_K('folder', 12)} = 0 THEN '/m/other/' ELSE '/m/utterances_final/' END || source_index || '.mp4' AS path, CASE WHEN {_K('digest', 11)} = 0 THEN upper(sha256(source_index::VARCHAR)) ELSE sha256(source_index::VARCHAR) END AS digest FROM turns)"""

ORACLES = {
    "vocabulary": f"WITH {_VOCAB} SELECT token, n, id FROM vocab",
    "encoded_turns": f"WITH {_VOCAB}, k AS (SELECT source_index, place, coalesce(id, 1) AS id FROM words LEFT JOIN vocab USING (token)) SELECT t.source_index, count(DISTINCT place)::INT AS lines, count(place) AS tokens, coalesce(sum(id), 0)::BIGINT AS id_sum, count(*) FILTER (id = 1)::INT AS unknown FROM turns t LEFT JOIN k USING (source_index) WHERE t.text IS NOT NULL GROUP BY 1",
    "audio_scaler": f"WITH {_AUDIO} SELECT dim::INT AS dim, round(mean, 6) AS mean, round(scale, 6) AS scale FROM fitted",
    "audio_validity": f"WITH {SQL['turns']}, {SQL['audio']} SELECT count(*) AS n, count(*) FILTER (len(target_audio) = 64 AND len(list_filter(target_audio, lambda x: NOT isfinite(x))) = 0) AS valid FROM audio",
    "pooled_audio": f"WITH {SQL['turns']}, {SQL['audio']}, d AS (SELECT dialogue_id, generate_subscripts(target_audio, 1) - 1 AS dim, unnest(target_audio)::DOUBLE AS x FROM turns JOIN audio USING (source_index)), m AS (SELECT dialogue_id, dim, avg(x) AS x FROM d GROUP BY ALL), n AS (SELECT dialogue_id, sqrt(sum(x * x)) AS s FROM m GROUP BY 1) SELECT dialogue_id, round(max(x / s) FILTER (dim = 0), 6) AS first_value, round(max(x / s), 6) AS largest FROM m JOIN n USING (dialogue_id) GROUP BY 1",
    "text_weights": f"WITH {_GRAMS}, n AS (SELECT source_index, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1) SELECT source_index, count(*) AS grams, round(sum(w / norm), 6) AS total, round(sum((w / norm) ** 2), 6) AS square FROM w JOIN n USING (source_index) GROUP BY 1",
    "sequence_scores": f"WITH {SQL['turns']}, k AS (SELECT source_index, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]') AS w FROM turns WHERE text IS NOT NULL), s AS (SELECT source_index, -coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::DOUBLE AS total, len(w)::INT AS n FROM k) SELECT source_index, total, round(total / nullif(n, 0), 6) AS mean, n FROM s",
    "turn_audit": f"WITH {SQL['turns']} SELECT 'text_present' AS rule, count(*) FILTER (text IS NULL) AS violations FROM turns UNION ALL SELECT 'label_known', count(*) FILTER (label NOT IN (0, 1)) FROM turns UNION ALL SELECT 'speaker_known', count(*) FILTER (speaker NOT IN ('spk0', 'spk1')) FROM turns UNION ALL SELECT 'dialogue_in_episode', count(*) FILTER (NOT starts_with(dialogue_id, episode_id)) FROM turns",
    "value_counts": f"WITH {SQL['turns']} {_COUNT('speaker')} UNION ALL {_COUNT('label')} UNION ALL {_COUNT('episode_id')}",
    "context_lengths": f"WITH {_RECORDS} SELECT min(len(ctx))::INT AS least, max(len(ctx))::INT AS most, round(avg(len(ctx)), 6) AS mean, quantile_cont(len(ctx)::DOUBLE, 0.5) AS median FROM records",
    "missing_fields": " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER ({c} IS NULL OR {c}::VARCHAR = '') AS missing FROM documents" for c in ("doc_id", "text", "lang", "source")),
    "concentration": f"WITH {_RECORDS}, c AS (SELECT 'episode_id' AS \"column\", count(*) AS n FROM records GROUP BY episode_id UNION ALL SELECT 'next_speaker', count(*) FROM records GROUP BY next_speaker) SELECT \"column\", count(*) AS groups, round(max(n) / sum(n), 6) AS largest_share FROM c GROUP BY 1",
    "repeated_responses": f"WITH {_RECORDS}, d AS (SELECT count(*) AS n FROM records GROUP BY response HAVING count(*) > 1) SELECT count(*) AS texts, sum(n)::BIGINT AS rows FROM d",
    "accounting": f"""WITH {_RECORDS}, s AS (SELECT source_index, source_index IN (SELECT source_index FROM records) AS a, {_K('twice', 25)} = 0 AS twice, {_K('lost', 6)} = 0 AS lost, {_K('both', 15)} = 0 AS two FROM turns),
        k AS (SELECT 1 + twice::INT AS s, a::INT AS a, CASE WHEN a THEN two ELSE NOT lost END::INT AS r FROM s) SELECT sum(s)::BIGINT AS source, sum(a)::BIGINT AS accepted, sum(r)::BIGINT AS rejected, count(*) FILTER (a + r <> s) AS unbalanced, count(*) FILTER (a > 0 AND r > 0) AS in_both, count(*) FILTER (s > 1) AS repeated FROM k""",
    "membership": f"WITH {_SETS}, l AS (SELECT DISTINCT source_index FROM turns WHERE source_index % 2 = 0), r AS (SELECT DISTINCT source_index FROM sets) SELECT (SELECT count(*) FROM (FROM l EXCEPT FROM r)) AS only_left, (SELECT count(*) FROM (FROM r EXCEPT FROM l)) AS only_right, (SELECT count(*) FROM (FROM l INTERSECT FROM r)) AS both",
    "json_cells": f"""WITH {_RECORDS}, c AS (SELECT source_index, list_transform(ctx, lambda x: regexp_replace(x, '^spk[0-9]: ', '')) AS c FROM records)
        SELECT source_index, CASE WHEN {_K('cell', 5)} < 3 THEN 1 ELSE len(c) END::INT AS n, CASE WHEN {_K('cell', 5)} < 3 THEN 'default' ELSE array_to_string(c, '|') END AS texts FROM c""",
    "scaled_audio": f"""WITH {_AUDIO}, z AS (SELECT source_index, x, avg(x) FILTER (fold <> 0) OVER w AS mean, stddev_pop(x) FILTER (fold <> 0) OVER w AS deviation FROM heard WINDOW w AS (PARTITION BY dim))
        SELECT source_index, round(sum(((x - mean) / CASE WHEN deviation < 1e-8 THEN 1 ELSE deviation END) ** 2), 6) AS square_norm, count(*)::INT AS dims FROM z GROUP BY 1""",
    "field_presence": f"SELECT 'doc_id' AS key, count(doc_id) AS n FROM documents UNION ALL SELECT 'text', count(text) FROM documents UNION ALL SELECT 'lang', count(lang) FILTER ({h(chr(39) + 'no-lang|' + chr(39) + ' || doc_id')} % 4 <> 0) FROM documents UNION ALL SELECT 'source', count(source) FROM documents",
    "reason_tags": f"WITH {SQL['turns']}, k AS (SELECT unnest(['no_text', 'positive', 'first_speaker', 'brief']) AS tag, unnest([text IS NULL, label = 1, speaker = 'spk0', length(text) < 200]) AS hit FROM turns) SELECT tag, count(*) AS n FROM k WHERE hit GROUP BY 1",
    "context_distribution": f"WITH {_RECORDS} SELECT len(ctx)::INT AS length, count(*) AS n FROM records GROUP BY 1",
    "next_line_texts": f"WITH {_RECORDS} SELECT source_index, array_to_string(ctx, chr(10)) || chr(10) || 'Recorded next speaker: ' || next_speaker AS detector_text FROM records",
    "media_coverage": f"WITH {_MEDIA} SELECT level, count(*) AS total, count(*) FILTER (found) AS video_found, count(*) FILTER (found AND heard) AS audio_extractable, round(count(*) FILTER (found) / count(*), 6) AS video_coverage, round(count(*) FILTER (found AND heard) / count(*), 6) AS audio_coverage FROM media GROUP BY 1",
    "media_gate": f"WITH {_MEDIA} SELECT count(*) FILTER (found AND heard) AS valid, CASE WHEN count(*) FILTER (found AND heard) >= 150 THEN 'PASS' ELSE 'AUDIO_BELOW_150_STOP' END AS status FROM media",
    "media_failures": f"WITH {_MEDIA} SELECT CASE WHEN NOT found THEN 'VIDEO_NOT_FOUND' WHEN NOT heard THEN 'NO_AUDIO_STREAM' ELSE 'NONE' END AS failure, count(*) AS n FROM media GROUP BY 1",
    "media_audit": f"""WITH {_MEDIA}, v AS (SELECT *, {_K('seconds', 20)} AS d, {_K('channels', 3)} AS c, {_K('rate', 9)} AS r FROM media WHERE found AND heard) SELECT unnest(['duration', 'channels', 'sample_rate', 'length', 'digest', 'preferred_folder']) AS rule,
        unnest([count(*) FILTER (d = 0), count(*) FILTER (c = 0), count(*) FILTER (r = 0), 0, count(*) FILTER (NOT regexp_full_match(digest, '[0-9a-f]{{64}}')), count(*) FILTER (NOT contains(path, 'utterances_final'))]) AS violations FROM v""",
    "review_media": f"WITH {_MEDIA}, {_RECORDS.removeprefix(SQL['turns'] + ', ')} SELECT source_index, path AS target_audio_path, digest AS target_audio_sha256 FROM records JOIN media USING (source_index) WHERE found AND heard",
    "speaker_counters": f"WITH {SQL['corpus']} SELECT speaker, count(*) AS n FROM corpus GROUP BY 1",
    "probe_logs": f"WITH {SQL['turns']}, k AS (SELECT source_index, ({h(chr(39) + 'probe|' + chr(39) + ' || source_index')} % 5000)::INT AS n FROM turns) SELECT source_index, ((n // 60) % 60) * 60 + n % 60 + 0.5::DOUBLE AS duration, CASE WHEN n % 7 <> 0 THEN 44100 END AS sample_rate, CASE WHEN n % 7 <> 0 THEN CASE WHEN n % 2 = 0 THEN 2 ELSE 6 END END AS channels, CASE WHEN n % 7 = 0 THEN 'NO_AUDIO_STREAM' END AS failure FROM k",
    "media_locations": f"WITH {SQL['turns']}, k AS (SELECT ({h(chr(39) + 'media|' + chr(39) + ' || source_index')} % 4)::INT AS k FROM turns) SELECT k, count(*) FILTER (k IN (1, 2)) AS found, count(*) FILTER (k = 2) AS preferred, count(*) FILTER (k = 0) AS none, count(*) FILTER (k = 3) AS several FROM k GROUP BY 1",
}

QUERIES = {n: globals()[n] for n in (*ORACLES, "detector", "fold_predictions", "fold_selection", "fold_audit", "forest", "selector")}
