"""Removal of repeated byte strings by bucket-pointer refinement.

A byte is removed if a string of LENGTH bytes that covers it starts at two places or more of the corpus. Suffixes are
not sorted whole: places are put into buckets by the Q bytes they begin with (their q-gram), and a bucket is refined by
the identifiers of the buckets that hold the places at later offsets, until strings of LENGTH bytes are told apart. A
place that is alone in its bucket is done. A refined bucket's identifier is the smallest (text, place) of its members;
later rounds refine by it again.

0. Texts that occur in two rows or more repeat as a whole: one row of each text goes on, so work does not grow with
   the number of its copies.
1. Of the q-grams in each LENGTH bytes, the one with the smallest hash (the leftmost of equals) stands for them: equal
   strings have equal representatives at equal offsets, so about one place in 75 is put into the initial buckets. A
   place carries the identifier of the bytes up to the end of the next place's q-gram.
2. Places in shared buckets are refined by the identifiers at the next places of their text, doubled: those of two
   places make one of the pair, which serves the place before as well. If the identifiers before and behind a place
   cover all strings that it stands for, and another place has the same, all these strings repeat.
3. The starts of other places are split into groups of GROUP neighbours. The bytes that a group's strings have in
   common are refined from the bucket of their representative by the q-grams at later offsets, in two rounds, and then
   by the q-grams at both ends of the group; if shared up to there, all strings of the group repeat.
4. What is left are single strings around the ends of copies: the group's bucket is refined by the q-grams at which the
   string begins and ends.

Two strings count as equal if the identifiers of all their q-grams are: each is a 64-bit hash of Q bytes, and at least
five of them cover a string. Buckets are counted with map-side sums; members of frequent buckets meet their counts by
a salted join, so a passage that a third of all documents hold is dealt over many tasks. Texts meet their places again
by the unique number of their row in the written table of distinct texts.

Defined cases: null and empty texts have no bytes and nothing is removed. Texts under LENGTH bytes are left whole.
Rows that repeat an id and text are two documents, which repeat each other. Null ids are kept. Empty tables give empty
results. Columns besides id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm import words
from colloquy.llm.common import discard, materialise, salted_join
from colloquy.llm.exact_dedup import filter_words, passes_filter

LENGTH, Q, GROUP = 200, 50, 16
REACH = LENGTH - Q
#: Doublings of the identifiers of next places: runs of up to eight places.
LEVELS = 4
#: Bytes that are processed at once, and how far around them is looked.
PIECE, MARGIN = 1 << 19, 2 * LENGTH

_PLACE_BITS = np.uint64((1 << 21) - 1)


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width neighbours of x, by running minima of blocks in both directions."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    rest = -len(x) % width
    padded = np.concatenate([x, np.full(rest, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def representatives(data: np.ndarray, bounds: np.ndarray, first: int, last: int) -> tuple[np.ndarray, ...]:
    """(places, least starts, greatest starts, hash of the Q bytes, running sums) for the strings of LENGTH bytes that start in first .. last - 1 and cross none of the bounds."""
    total = words.running(data, words.SAME)
    n = len(data)
    grams = words.spans(total, np.arange(n - Q + 1), np.arange(Q, n + 1)) if n >= Q else np.zeros(0, np.uint64)
    least = _slide((grams & ~_PLACE_BITS) | np.arange(len(grams), dtype=np.uint64), REACH + 1)
    starts = np.arange(max(first, 0), min(last, len(least)))
    text = np.repeat(np.arange(len(bounds), dtype=np.int32), np.diff(np.concatenate([[0], bounds])))
    starts = starts[text[starts] == text[starts + LENGTH - 1]]
    place = (least[starts] & _PLACE_BITS).astype(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(place))[: len(head)] - 1
    return place[head], starts[head], starts[tail], grams[place[head]], total


def _pieces(array: pa.Array):
    """(rows, bounds, data, base, first, last) pieces of a string column: whole texts, or parts of one long text with margins."""
    at, data = words.columns(array)
    row = 0
    while row < len(array):
        stop = min(len(array), max(row + 1, int(np.searchsorted(at, at[row] + PIECE, "right")) - 1))
        size = at[stop] - at[row]
        if size <= PIECE:
            yield row, stop, at[row : stop + 1] - at[row], data[at[row] : at[stop]], 0, 0, int(size)
        else:
            for x in range(0, int(size), PIECE):
                low, high = max(0, x - MARGIN), min(int(size), x + PIECE + MARGIN)
                yield row, stop, np.array([0, high - low]), data[at[row] + low : at[row] + high], low, x - low, min(x + PIECE, int(size)) - low
        row = stop


PLACES = pa.schema([("key", pa.int64()), ("place", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("b0", pa.int64()), ("size", pa.int64()), ("id0", pa.int64())])


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} long" for f in schema)


def initial_buckets(texts: DataFrame) -> DataFrame:
    """key, place, least, most (starts of the strings that the place stands for), b0 (its q-gram), size and id0 (the bytes from the place to the end of the next place's q-gram; null behind the last place)."""

    def batch_of(keys, place, least, most, b0, size, id0):
        last = size == 0
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(place), pa.array(least), pa.array(most), pa.array(b0.view(np.int64)), pa.array(size, mask=last), pa.array(id0.view(np.int64), mask=last)], schema=PLACES)

    def run(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            held, of = [], None
            for row, stop, bounds, data, base, first, last in _pieces(batch.column("text")):
                # a little further than the piece, so that its last place knows the next one
                place, least, most, b0, total = representatives(data, bounds[1:], first, last + REACH + 1)
                owner = np.searchsorted(bounds, place, "right") - 1
                near = np.zeros(len(place), bool)
                near[:-1] = owner[1:] == owner[:-1]
                follow = np.append(place[1:], 0)
                size = np.where(near, follow + Q - place, 0)
                id0 = words.spans(total, np.where(near, place, 0), np.where(near, follow + Q, 0))
                shift = base - bounds[owner]
                mine = least < last
                part = tuple(x[mine] for x in (keys[row + owner], place + shift, least + shift, np.minimum(most, last - 1) + shift, b0, size, id0))
                if stop - row == 1:  # perhaps one of several parts, which may both name a place at their border
                    if of is not None and of != row:
                        yield batch_of(*_joined(held))
                        held = []
                    held, of = [*held, part], row
                else:
                    yield batch_of(*part)
            if held:
                yield batch_of(*_joined(held))

    return texts.select("key", "text").mapInArrow(run, ddl(PLACES))


def _joined(parts: list[tuple]) -> tuple:
    """The parts of one text as one, each place once."""
    key, place, least, most, b0, size, id0 = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((least, place))
    key, place, least, most, b0, size, id0 = (x[order] for x in (key, place, least, most, b0, size, id0))
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    head = np.flatnonzero(new)
    if not len(head):
        return key, place, least, most, b0, size, id0
    return key[head], place[head], least[head], np.maximum.reduceat(most, head), b0[head], size[head], id0[head]


def refined(rows: DataFrame, bucket: list[str], later: list[str], into: tuple[str, str] | None, then=lambda df: df) -> DataFrame:
    """The members of buckets that still hold two or more after a refinement by the identifiers in the later columns, written.

    into: names of the columns of the new bucket's identifier, its smallest (key, place). Identifiers that are used up
    go; a group or an offset among the bucket's columns stays, since a place stands in one bucket for each of these.
    """
    keys = [*bucket, *later]
    member = F.min(F.struct("key", "place")).alias("__m")
    counts = materialise(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *([member] if into else [])).filter("__n > 1"), "bucket-sizes")
    found = salted_join(rows, counts, keys, ["key", "place"])
    if into:
        found = found.select(*(c for c in rows.columns if c == "grp" or c not in keys), F.col("__m.key").alias(into[0]), F.col("__m.place").alias(into[1]))
    out = materialise(then(found), "bucket-members")
    discard(counts, rows)
    return out


def marked(rows: DataFrame, bucket: list[str], later: list[str]) -> DataFrame:
    """rows with the boolean column all: whether the row's bucket is still shared after a refinement by later, written. A null identifier shares nothing."""
    keys = [*bucket, *later]
    counts = rows.filter(" and ".join(f"{c} is not null" for c in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").withColumn("all", F.lit(True))
    counts = materialise(counts, "bucket-sizes")
    out = materialise(salted_join(rows, counts, keys, ["key", "place"], "left").withColumn("all", F.coalesce("all", F.lit(False))), "bucket-marks")
    discard(counts, rows)
    return out


def by_next_places(rows: DataFrame) -> DataFrame:
    """Places with before and behind: identifiers of runs of places that end and begin at them and cover the strings they stand for; null where no run of 2 ** (LEVELS - 1) places or fewer does.

    A run's identifier is made from those of its halves: its own and the one at the place where the second half begins.
    """
    w = Window.partitionBy("key").orderBy("place")
    out = rows.withColumn("size0", F.col("size"))
    for level in range(1, LEVELS):
        step, size, name = 1 << (level - 1), F.col(f"size{level - 1}"), f"id{level - 1}"
        joins = F.lead("place", step).over(w) == F.col("place") + size - Q  # no place between is missing
        out = out.withColumns({f"id{level}": F.when(joins, F.xxhash64(name, F.lead(name, step).over(w))), f"size{level}": F.when(joins, size - Q + F.lead(f"size{level - 1}", step).over(w))})
        out = out.withColumn(f"id{level}", F.when(F.col(f"size{level}").isNotNull(), F.col(f"id{level}")))

    def ahead(level: int) -> Column:
        return F.when(F.col(f"size{level}") >= F.col("most") + LENGTH - F.col("place"), F.col(f"id{level}"))

    def back(level: int) -> Column:
        size = F.lag(f"size{level}", 1 << level).over(w)
        meets = F.lag("place", 1 << level).over(w) + size - Q == F.col("place")
        return F.when(meets & (size - Q >= F.col("place") - F.col("least")), F.lag(f"id{level}", 1 << level).over(w))

    none = F.when(F.col("place") == F.col("least"), F.lit(0).cast("long"))
    return out.withColumns({"before": F.coalesce(none, *map(back, range(LEVELS))), "behind": F.coalesce(*map(ahead, range(LEVELS)))}).select("key", "place", "least", "most", "b0", "before", "behind")


def _with_texts(texts: DataFrame, places: DataFrame, struct: str) -> DataFrame:
    """(text, places) of the texts that have rows in places: key and a struct column. A filter of fixed size spares most other texts the shuffle."""
    lists = materialise(places.groupBy("key").agg(F.collect_list(struct).alias("places")), "place-lists")  # bounded by the length of a text
    some = passes_filter(texts.select("key", "text").withColumn("digest", F.col("key").cast("string")), filter_words(lists.select(F.col("key").cast("string").alias("digest"))))
    return some.select("key", "text").join(lists, "key")


_LONG = pa.int64()
GROUPED = pa.schema([(n, _LONG) for n in ("key", "place", "b0", "least", "most", "grp", "p0", "p1", "p2", "p3", "e0", "e1")])
SINGLE = pa.schema([(n, _LONG) for n in ("key", "start", "bk", "bp", "off", "f0", "f1")])


def _each_text(make, schema: pa.Schema):
    """A function for mapInArrow: make(text bytes, fields of its places) gives the columns behind the key; rows are handed on by the 100,000."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            at, data = words.columns(batch.column("text"))
            lists, keys = batch.column("places"), batch.column("key").to_numpy()
            ends, values = lists.offsets.to_numpy(), lists.values
            fields = {f.name: values.field(f.name).to_numpy() for f in values.type}
            for r in range(batch.num_rows):
                made = make(data[at[r] : at[r + 1]], {k: v[ends[r] : ends[r + 1]] for k, v in fields.items()})
                held.append((np.full(len(made[0]), keys[r]), *made))
                size += len(made[0])
                if size > 100_000:
                    yield _batch(held, schema)
                    held, size = [], 0
        if held:
            yield _batch(held, schema)

    return run


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [np.ma.concatenate(x) if any(isinstance(y, np.ma.MaskedArray) for y in x) else np.concatenate(x) for x in zip(*held, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c.data, mask=np.ma.getmaskarray(c)) if isinstance(c, np.ma.MaskedArray) else pa.array(c) for c in columns], schema=schema)


#: Offsets of the q-grams that cover the LENGTH - GROUP + 1 bytes which the strings of a group have in common.
CORE = (0, Q, LENGTH - GROUP + 1 - 2 * Q, LENGTH - GROUP + 1 - Q)


def _groups(text: np.ndarray, f: dict) -> tuple:
    """The groups of starts of each place, with the q-grams of what their strings have in common, and of the group's ends."""
    low, high = (f["place"] - f["most"]) // GROUP, (f["place"] - f["least"]) // GROUP
    many = high - low + 1
    of = np.repeat(np.arange(len(many)), many)
    group = np.repeat(low, many) + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    core = f["place"][of] - GROUP * group
    front = core - (GROUP - 1)
    whole = (front >= 0) & (core + LENGTH <= len(text))
    grams = [_hash_each(text, core + o, core + o + Q).view(np.int64) for o in CORE]
    ends = [np.ma.array(_hash_each(text, np.where(whole, x, 0), np.where(whole, x + Q, Q)).view(np.int64), mask=~whole) for x in (front, core + LENGTH - Q)]
    return f["place"][of], f["b0"][of], f["least"][of], f["most"][of], group, *grams, *ends


def _strings(text: np.ndarray, f: dict) -> tuple:
    """The single strings of each group, with the q-grams at which they begin and end."""
    offset = (GROUP * f["grp"])[:, None] + np.arange(GROUP)[None, :]
    start = f["place"][:, None] - offset
    row, column = np.nonzero((start >= f["least"][:, None]) & (start <= f["most"][:, None]))
    s = start[row, column]
    return s, f["bk"][row], f["bp"][row], offset[row, column], _hash_each(text, s, s + Q).view(np.int64), _hash_each(text, s + LENGTH - Q, s + LENGTH).view(np.int64)


def _hash_each(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of short byte ranges of a text of any length."""
    out = np.zeros(len(starts), np.uint64)
    if len(text) <= words.CHUNK:
        return words.spans(words.running(text, words.SAME), starts, ends)
    for x in range(0, len(text), PIECE):
        mine = np.flatnonzero((starts >= x) & (starts < x + PIECE))
        if len(mine):
            total = words.running(text[x : x + PIECE + MARGIN], words.SAME)
            out[mine] = words.spans(total, starts[mine] - x, ends[mine] - x)
    return out


def _witnesses(rows: DataFrame, *bucket: str) -> DataFrame:
    """One row of each bucket of settled rows. Its strings stand for those of the whole bucket when others are compared with them."""
    columns = [c for c in rows.columns if c not in bucket]
    one = rows.filter("all").groupBy(*bucket).agg(F.min(F.struct(*columns)).alias("__w"))
    return one.select(*bucket, "__w.*").select(rows.columns)


def _unsettled(rows: DataFrame, bucket: list[str], later: list[str]) -> DataFrame:
    """The rows that are not settled, and witnesses for the settled ones in their buckets."""
    left = rows.filter("not all")
    seen = _witnesses(rows, *bucket, *later)
    return left.unionByName(seen.join(left.select(*bucket).distinct(), bucket, "left_semi").select(rows.columns))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """key, from, to: byte ranges of distinct texts (key, text) that strings which repeat cover. Ranges may overlap."""
    met = marked(refined(materialise(initial_buckets(texts), "places"), ["b0"], [], None, by_next_places), ["b0"], ["before", "behind"])
    spans = met.filter("all").select("key", F.col("least").alias("from"), (F.col("most") + LENGTH).alias("to"))

    left = _unsettled(met, ["b0"], ["before", "behind"]).select("key", F.struct("place", "b0", "least", "most").alias("p"))
    groups = materialise(_with_texts(texts, left, "p").mapInArrow(_each_text(_groups, GROUPED), ddl(GROUPED)), "groups")
    groups = refined(groups, ["b0", "grp"], ["p0", "p1"], ("ck", "cp"))
    groups = refined(groups, ["ck", "cp", "grp"], ["p2", "p3"], ("bk", "bp"))
    groups = marked(groups, ["bk", "bp", "grp"], ["e0", "e1"])
    core = F.col("place") - GROUP * F.col("grp")
    spans = spans.unionByName(groups.filter("all").select("key", (core - (GROUP - 1)).alias("from"), (core + LENGTH).alias("to")))

    left = _unsettled(groups, ["bk", "bp", "grp"], ["e0", "e1"]).select("key", F.struct("place", "bk", "bp", "grp", "least", "most").alias("p"))
    strings = materialise(_with_texts(texts, left, "p").mapInArrow(_each_text(_strings, SINGLE), ddl(SINGLE)), "strings")
    # the start stands in for the place
    again = refined(strings.withColumnRenamed("start", "place"), ["bk", "bp", "off"], ["f0", "f1"], None, lambda df: df.select("key", F.col("place").alias("from"), (F.col("place") + LENGTH).alias("to")))
    spans = materialise(spans.unionByName(again), "spans")
    discard(met, groups, strings, again)
    return spans


def distinct_texts(docs: DataFrame) -> DataFrame:
    """key, digest, n (rows), text of the distinct texts of LENGTH bytes or more, each once. docs: digest, text.

    A filter of fixed size lets texts that surely occur once stay where they are.
    """
    some = docs.filter(F.octet_length("text") >= LENGTH)
    again = materialise(some.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "copied-texts")
    words_ = filter_words(again.select("digest"))
    once = passes_filter(some, words_, inverse=True).select("digest", F.lit(1).cast("long").alias("n"), "text")
    more = passes_filter(some, words_).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))
    # the number is written with the text, so it is the same whenever it is read
    return materialise(once.unionByName(more).withColumn("key", F.monotonically_increasing_id()), "texts")


def merged_spans(spans: DataFrame) -> DataFrame:
    """key, froms, tos: the maximal runs of each text, in order."""

    def run(batches):
        for batch in batches:
            lists, keys = batch.column("spans"), batch.column("key")
            ends, values = lists.offsets.to_numpy(), lists.values
            a, b = values.field("from").to_numpy(), values.field("to").to_numpy()
            froms, tos = [], []
            for r in range(batch.num_rows):
                x, y = a[ends[r] : ends[r + 1]], b[ends[r] : ends[r + 1]]
                order = np.argsort(x)
                x, y = x[order], np.maximum.accumulate(y[order])
                new = np.ones(len(x), bool)
                new[1:] = x[1:] > y[:-1]
                head = np.flatnonzero(new)
                froms.append(x[head])
                tos.append(y[np.append(head[1:], len(x)) - 1])
            yield pa.RecordBatch.from_arrays([keys, pa.array(froms, pa.list_(pa.int64())), pa.array(tos, pa.list_(pa.int64()))], ["key", "froms", "tos"])

    # a text's ranges are bounded by its length
    return spans.groupBy("key").agg(F.collect_list(F.struct("from", "to")).alias("spans")).mapInArrow(run, "key long, froms array<long>, tos array<long>")


def changed_texts(docs: DataFrame, then=lambda df: df) -> DataFrame:
    """digest, __n (rows), n_removed, n_spans, kept (the remaining bytes) of the texts that lose bytes, written. docs: digest, text. then: what is made of them before."""
    texts = distinct_texts(docs)
    spans = repeated_spans(texts)
    runs = materialise(merged_spans(spans), "removed")
    discard(spans)
    size = F.octet_length("text").cast("long")
    whole = texts.filter("n > 1").select("digest", F.col("n").alias("__n"), size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit("").cast("binary").alias("kept"))
    words_ = filter_words(runs.select(F.col("key").cast("string").alias("digest")))
    some = passes_filter(texts.filter("n = 1").select("key", F.col("digest").alias("text_digest"), "text").withColumn("digest", F.col("key").cast("string")), words_).drop("digest").join(runs, "key")

    def cut(batches):
        for batch in batches:
            at, data = words.columns(batch.column("text"))
            out = []
            for r, (froms, tos) in enumerate(zip(batch.column("froms").to_pylist(), batch.column("tos").to_pylist(), strict=True)):
                text = data[at[r] : at[r + 1]].tobytes()
                kept = b"".join(text[a:b] for a, b in zip([0, *tos], [*froms, len(text)], strict=True))
                out.append({"__n": 1, "n_removed": len(text) - len(kept), "n_spans": len(froms), "kept": kept})
            made = pa.RecordBatch.from_pylist(out, pa.schema([("__n", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))
            yield pa.RecordBatch.from_arrays([batch.column("text_digest"), *made.columns], ["digest", *made.schema.names])

    changed = some.mapInArrow(cut, "digest string, __n long, n_removed long, n_spans long, kept binary").unionByName(whole)
    out = materialise(then(changed), "changed-texts")
    discard(texts, runs)
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    docs = _keyed(docs, id_col, text_col)
    changed = changed_texts(docs.select("digest", "text"))
    out = salted_join(docs, changed, ["digest"], ["doc_id"], "left")
    none = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept", F.col("text").cast("binary")).alias("kept"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256. A text that loses nothing keeps its digest, so no text is joined."""
    docs = _keyed(docs, id_col, text_col)
    changed = changed_texts(docs.select("digest", "text"), lambda df: df.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept"))
    out = salted_join(docs.drop("text"), changed, ["digest"], ["doc_id"], "left")
    none = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "digest").alias("kept_sha256"))
