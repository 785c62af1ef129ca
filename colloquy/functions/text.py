"""Text and label functions over columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Quotes that count as an ASCII apostrophe or quotation mark.
CURLY = "’‘`´“”"
STRAIGHT = "''''\"\""

CONDITIONS = ("text_only", "multimodal", "self_multimodal", "oracle")


def _nfkc(text: Column) -> Column:
    @F.pandas_udf(StringType())  # made when it is used: it takes a session
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).lower())

    return run(text)


def folded(text: Column) -> Column:
    """NFKC and lower case. Only rows with other than ASCII characters leave the JVM."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(F.lower(text))


def normalise(text: Column, keep_apostrophe: bool = True, exact: bool = True) -> Column:
    """Words separated by single spaces; null gives ''. exact=False skips NFKC and stays in the JVM."""
    low = folded(text) if exact else F.lower(text)
    low = F.translate(F.coalesce(low, F.lit("")), CURLY, STRAIGHT)
    kept = F.regexp_replace(low, r"(?U)[^\w\s']" if keep_apostrophe else r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def clean(text: Column) -> Column:
    """Stripped text; null if nothing is left."""
    stripped = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(stripped != "", stripped)


def utterance_id(value: Column, strict: bool = True) -> Column:
    """``sNN_eNN_cNN_uN`` as struct<season, episode, scene, order>; another form raises an error, or gives null."""
    pattern = r"^s(\d{2})_e(\d{2})_c(\d{2})_u(\d+)$"
    parts = F.struct(*(F.regexp_extract(value, pattern, i + 1).cast("int").alias(n) for i, n in enumerate(("season", "episode", "scene", "order"))))
    bad = F.raise_error(F.concat(F.lit("not an utterance id: "), value)) if strict else F.lit(None)
    return F.when(value.rlike(pattern), parts).otherwise(bad.cast("struct<season:int,episode:int,scene:int,order:int>"))


def is_note(speaker: Column) -> Column:
    return normalise(speaker, keep_apostrophe=False) == "transcript_note"


def episode_of(dialogue: Column) -> Column:
    out = F.trim(F.split_part(dialogue, F.lit("-"), F.lit(1)))
    return F.when(out != "", out).otherwise(F.raise_error(F.lit("a dialogue id without an episode")).cast("string"))


def label_name(label: Column) -> Column:
    return F.when(label, "sarcastic").when(~label, "literal").otherwise("UNKNOWN")


def quote(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "<>", "‹›"), r"(?U)^\s+|\s+$", "")


def status_text(label: Column) -> Column:
    wrong = F.raise_error(F.lit("a label is 0 or 1")).cast("string")
    return F.when(label == 0, "literal").when(label == 1, "sarcastic").otherwise(wrong)


def lines_of(turns: Column) -> Column:
    """``speaker: text`` lines of an array of (speaker, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["speaker"], F.lit(": "), t["text"])), "\n")


def next_line_text(turns: Column, next_speaker: Column) -> Column:
    """lines_of with a last line that names the recorded next speaker."""
    return F.concat_ws("\n", lines_of(turns), F.concat(F.lit("Recorded next speaker: "), next_speaker))


def last_cell(cells: Column, place: int, unknown: str = "UNKNOWN") -> Column:
    """The cell at the given place from the end of an array; unknown if there is none."""
    return F.coalesce(F.try_element_at(cells, F.lit(-place)), F.lit(unknown))


def turn_line(turn: Column) -> Column:
    """A turn as its line of a prompt."""
    return F.concat(quote(turn["speaker"]), F.lit(": "), quote(turn["text"]))


def prompt(turns: Column, next_speaker: Column, condition: Column, predicted: Column, true: Column) -> Column:
    """The dialogue, a status line for conditions that have one, and the speaker who is to answer."""
    lines = F.array_join(F.transform(turns, turn_line), "\n")
    status = F.when(condition == "self_multimodal", status_text(predicted)).when(condition == "oracle", status_text(true))
    known = condition.isin(*CONDITIONS, "direct")
    body = F.concat_ws("\n", F.concat(F.lit("Dialogue:\n"), lines), F.concat(F.lit("Status: "), status), F.concat(F.lit("Next speaker: "), next_speaker))
    return F.when(known, body).otherwise(F.raise_error(F.concat(F.lit("unknown condition "), condition)).cast("string"))


def status_vector(condition: Column, predicted: Column, true: Column) -> Column:
    """One-hot (unknown, 0, 1)."""
    known = F.when(condition == "self_multimodal", predicted).when(condition == "oracle", true)
    return F.array(*((x).cast("int") for x in (known.isNull(), F.coalesce(known == 0, F.lit(False)), F.coalesce(known == 1, F.lit(False)))))


def tokens(text: Column, most: int | None = 64) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+|[^\w\s])"), F.lit(1))
    return F.slice(found, 1, most) if most else found


def token_count(text: Column) -> Column:
    return F.size(tokens(text, None))


def last_lines(text: Column, most: int = 6) -> Column:
    """The last non-blank lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"(?U)^\s*$"))
    return F.slice(lines, F.greatest(F.size(lines) - most + 1, F.lit(1)), most)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(100.0 * part / whole)


def tags(**named: Column) -> Column:
    """Names of the conditions that hold, joined by semicolons."""
    return F.array_join(F.array_compact(F.array(*(F.when(c, n) for n, c in named.items()))), ";")


def valid_vector(vector: Column, length: int) -> Column:
    return (F.size(vector) == length) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


# Channel layouts by name.
LAYOUTS = {"mono": 1, "stereo": 2, "2.1": 3, "quad": 4, "5.0": 5, "5.1": 6, "5.1(side)": 6, "7.1": 8}


def probe_log(log: Column) -> Column:
    """A media probe's log as struct<duration, sample_rate, channels, failure>."""
    time = r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)"
    part = [F.regexp_extract(log, time, i).try_cast("double") for i in (1, 2, 3)]
    duration = part[0] * 3600 + part[1] * 60 + part[2]
    audio = F.regexp_extract(log, r"(?m)(Audio:.*)$", 1)
    rate = F.regexp_extract(audio, r"(\d+) Hz", 1).try_cast("int")
    layout = F.regexp_extract(audio, r"\d+ Hz,\s*([^,]+)", 1)
    named = F.create_map(*(F.lit(x) for pair in LAYOUTS.items() for x in pair))
    channels = F.coalesce(F.try_element_at(named, F.trim(layout)), F.regexp_extract(layout, r"(\d+) channels", 1).try_cast("int"))
    failure = F.when(duration.isNull(), "PROBE_FAILED").when(audio == "", "NO_AUDIO_STREAM")
    return F.struct(duration.alias("duration"), rate.alias("sample_rate"), channels.alias("channels"), failure.alias("failure"))
