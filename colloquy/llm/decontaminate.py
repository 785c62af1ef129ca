"""Benchmark decontamination by templates.

Texts become templates: numbers (digits or number words), names (capitalised words within a sentence) and units are
replaced by typed placeholders; other words are lower-cased without punctuation. Number words are English, French,
German or Spanish; those that make up one number (``two hundred and five``, ``soixante-dix``, ``treinta y dos``,
``3 million``, ``1,250.5``) are one word, so that it can be exchanged for a shorter one. German numbers that are one
word are known below a thousand, and as whole thousands. Windows of eight template words of a
document are joined on their hash with those of the benchmark. Where windows line up with an item (same distance
between their places), the values behind the placeholders must agree: within an alignment, one value of the item may
stand for one value of the document only; windows that hold a value against this are not covered, unless all their
values are the item's own. So a question that was re-parameterised throughout is found, and a text
that shares only a pattern of numbers is not. A document is contaminated by an item if consistent alignments cover at
least half of the item's windows, or half of its template windows.

Windows with fewer than MIN_WORDS plain words say nothing as templates; they are joined on their exact words. An item
with fewer than MIN_WORDS words in all is found where it is a whole line, since its words may stand in any text.

A bitmap of fixed size over the benchmark's windows goes to all tasks; document windows that miss it are never
emitted. Texts are scanned whole.

Defined cases: null and empty texts are clean. An item with fewer than eight words is one window of all its words.
Rows that repeat an id are judged one by one, documents and items alike, and all rows of a document are contaminated if
one is. Ids are whole numbers; others raise
an error. An empty benchmark leaves all documents clean. Columns besides id and text are ignored; ``clean`` keeps them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import words
from colloquy.llm.common import materialise, maybe_broadcast, whole_ids

WIDTH = 8
#: Words of a window that are no placeholders.
MIN_WORDS = 4
#: Share of an item's windows.
COVERED = 0.5
#: Bits of the bitmap of benchmark windows: 2 MB.
BITMAP = 1 << 24

# Words that stand for numbers and units.
_ONES = """zero one two three four five six seven eight nine
null eins zwei drei vier fünf sechs sieben acht neun
zéro deux trois quatre cinq sept huit neuf
cero dos tres cuatro cinco seis siete ocho nueve""".split()
_TEENS = """ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn
dix onze douze treize quatorze quinze seize
diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve
veintiuno veintiún veintiuna veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve""".split()
_TENS = """twenty thirty forty fifty sixty seventy eighty ninety
zwanzig dreißig dreissig vierzig fünfzig sechzig siebzig achtzig neunzig
vingt vingts trente quarante cinquante soixante septante huitante nonante
veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa""".split()
_SCALES = """hundred thousand million billion trillion
hundert tausend millionen milliarde milliarden billionen
cent mille millions milliard milliards
cien ciento mil millón millones billón doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos
doscientas trescientas cuatrocientas quinientas seiscientas setecientas ochocientas novecientas""".split()
#: These are numbers only behind another part of one.
_ONE_BEHIND = "un une uno una".split()
_BETWEEN = "and et y".split()


def _german() -> list[str]:
    """German numbers that are one word: below a thousand, and whole thousands."""
    ones = "ein zwei drei vier fünf sechs sieben acht neun".split()
    tens = [t for t in _TENS if t.endswith(("zig", "ßig", "ssig"))]
    small = ["eins", *ones[1:], *(t for t in _TEENS if t.endswith("zehn") or t in ("elf", "zwölf")), *tens, *(f"{o}und{t}" for o in ones for t in tens)]
    hundreds = [f"{o}hundert{rest}" for o in ["", *ones] for rest in ["", *small, *(f"und{s}" for s in small)]]
    return [*small, *hundreds, *(f"{n}tausend" for n in ["ein", *small[1:], *hundreds])]


NUMBER_WORDS = sorted({*_ONES, *_TEENS, *_TENS, *_SCALES, *_german()})
UNITS = """mm cm m km kg g mg lb lbs oz l ml km/h mph inch inches foot feet yard yards mile miles meter meters metre metres kilometer
kilometers kilometre kilometres gram grams kilogram kilograms pound pounds liter liters litre litres second seconds minute minutes
hour hours day days week weeks month months year years dollar dollars euro euros cents percent degree degrees % $ €""".split()

_NUM, _NAME, _UNIT, _EXACT, _LINE = (np.uint64(x) for x in (0x9D39247E33776D41, 0x2AF7398005AAA5C7, 0x44DB015024623547, 0x9C15F73E62A76AE2, 0xB5297A4D3C6EF372))
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
#: Capitals among the characters of two bytes, by their number (U+0080 to U+07FF: Latin, Greek, Cyrillic, Armenian, …).
_UPPER_OF_TWO = np.array([chr(i).isupper() if i >= 0x80 else False for i in range(0x800)])
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[ord(c) for c in ".!?:;"]] = True
#: Punctuation that does not belong to a word.
_SIGNS = frozenset(b"!\"'(),-.:;?[]`{}*_")
_INSIDE = words.NOT_BLANK.copy()
_INSIDE[list(_SIGNS)] = False


def _hashes_of(some: list[str]) -> np.ndarray:
    c = next(words.chunks(pa.array([" ".join(some)]), _INSIDE, words.LOWER))
    return np.sort(c.hashes)


_NUMBER_HASHES, _UNIT_HASHES = _hashes_of(NUMBER_WORDS), _hashes_of(UNITS)
_ONES_H, _TEENS_H, _TENS_H, _SCALES_H, _BEHIND_H, _BETWEEN_H = map(_hashes_of, (_ONES, _TEENS, _TENS, _SCALES, _ONE_BEHIND, _BETWEEN))
_FOUR_H, _TWENTY_H, _TEN_H, _ABOVE_SIX_H = map(_hashes_of, (["quatre"], ["vingt", "vingts"], ["dix"], ["sept", "huit", "neuf"]))
_DASH = np.zeros(256, bool)
_DASH[[ord(" "), ord("-")]] = True
_POINT = np.zeros(256, bool)
_POINT[[ord("."), ord(",")]] = True


def _among(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, hashes), len(table) - 1)] == hashes


@dataclass
class Parsed(words.Chunk):
    """A chunk whose numbers are one word each, and which of its words are numbers."""

    numbers: np.ndarray

    @cached_property
    def shape(self) -> tuple[np.ndarray, np.ndarray]:
        return templates(self)


def _numbers_joined(c: words.Chunk) -> Parsed:
    """The chunk with the words of one number made one word. Nothing but blanks, hyphens or a decimal sign stands between them."""
    n = len(c.hashes)
    digits = np.cumsum(np.concatenate([[0], _DIGIT[c.data]]), dtype=np.int32)
    digit = digits[c.ends] > digits[c.starts]
    number = digit | _among(c.hashes, _NUMBER_HASHES) if n else digit
    whole = Parsed(c.first, c.bounds, c.starts, c.ends, c.hashes, c.data, number)
    at = np.flatnonzero(number[: n - 1]) if n > 1 else np.zeros(0, np.int64)
    if not len(at):
        return whole
    other = np.cumsum(np.concatenate([[0], ~_DASH[c.data]]), dtype=np.int32)
    text = np.zeros(n, bool)
    text[c.bounds[c.bounds < n]] = True  # no number crosses texts

    def near(a: np.ndarray) -> np.ndarray:
        return (other[c.starts[a + 1]] == other[c.ends[a]]) & ~text[a + 1]

    def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words b go on with the numbers that words a end."""
        left, right = c.hashes[a], c.hashes[b]
        behind = _among(right, _BEHIND_H)
        low = _among(right, _ONES_H) | _among(right, _TEENS_H) | behind
        french = _among(left, _FOUR_H) & _among(right, _TWENTY_H) | _among(left, _TEN_H) & _among(right, _ABOVE_SIX_H)
        return _among(right, _SCALES_H) | _among(left, _SCALES_H) & (number[b] & ~digit[b] | behind) | _among(left, _TENS_H) & low | french

    point = (c.starts[at + 1] - c.ends[at] == 1) & _POINT[c.data[c.ends[at]]] & _DIGIT[c.data[c.ends[at] - 1]] & _DIGIT[c.data[c.starts[at + 1]]] & ~text[at + 1]
    joined = np.zeros(n - 1, bool)
    joined[at] = near(at) & fits(at, at + 1) | point
    link = at[at < n - 2]
    link = link[_among(c.hashes[link + 1], _BETWEEN_H)]
    link = link[near(link) & near(link + 1) & (_among(c.hashes[link], _TENS_H) | _among(c.hashes[link], _SCALES_H)) & fits(link, link + 2)]
    joined[link] = joined[link + 1] = True
    if not joined.any():
        return whole
    first = np.flatnonzero(np.concatenate([[True], ~joined]))
    sizes = np.diff(np.append(first, n))
    places = np.arange(n) - np.repeat(first, sizes)
    hashes = np.where(sizes > 1, words.mixed(np.add.reduceat(words.mixed(c.hashes + places.astype(np.uint64)), first)), c.hashes[first])
    return Parsed(c.first, np.searchsorted(first, c.bounds), c.starts[first], c.ends[first + sizes - 1], hashes, c.data, number[first] | (sizes > 1))


def _chunks(column: pa.Array):
    return map(_numbers_joined, words.chunks(column, _INSIDE, words.LOWER))


def templates(c: Parsed) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, slots) of a chunk's words as templates; slots: 0 for a plain word, 1 number, 2 name, 3 unit."""
    slots = np.zeros(len(c.hashes), np.uint8)
    if not len(c.hashes):
        return c.hashes, slots
    first = c.data[c.starts]
    # a capital within a sentence: the byte before the word's white space ends no sentence, and the word starts no text or line
    gap_from, gap_to = np.concatenate([[0], c.ends[:-1]]), c.starts
    ends = np.cumsum(np.concatenate([[0], _SENTENCE_END[c.data] | (c.data == 10)]))
    inner = ends[gap_to] == ends[gap_from]
    inner[c.bounds[:-1][c.bounds[:-1] < len(inner)]] = False
    second = c.data[np.minimum(c.starts + 1, len(c.data) - 1)]
    two = (first >= 0xC2) & (first < 0xE0) & _UPPER_OF_TWO[(first.astype(np.int64) & 31) << 6 | (second & 63)]
    slots[(_UPPER[first] | two) & inner] = 2
    slots[_among(c.hashes, _UNIT_HASHES)] = 3
    slots[c.numbers] = 1
    return np.choose(slots, [c.hashes, _NUM, _NAME, _UNIT]).astype(np.uint64), slots


def windows(c: Parsed, width: int = WIDTH, known: bool = False) -> tuple[np.ndarray, ...]:
    """(hashes, first words, lengths, texts, exact) of the windows of a chunk; and the words' slots.

    A window with enough plain words is hashed as a template. One with fewer is hashed by its exact words if known (the
    benchmark); a document's windows are all hashed by their exact words too, since what is a name depends on the place.
    """
    hashes, slots = c.shape
    found, bounds = words.shingles(hashes, c.bounds, width)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = c.bounds[rows] + np.arange(len(found)) - bounds[rows]
    size = np.minimum(c.bounds[rows + 1] - at, width)
    plain = np.cumsum(np.concatenate([[0], slots == 0]))
    good = plain[at + size] - plain[at] >= MIN_WORDS
    plainly = size >= MIN_WORDS
    if known:
        plainly &= ~good
    brief = (size < MIN_WORDS) & (size > 0)
    if not known:
        brief &= _whole_lines(c, at, size)
    literal = words.mixed(words.shingles(c.hashes, c.bounds, width)[0] ^ np.where(brief, _LINE, _EXACT))
    plainly |= brief
    both = lambda x: np.concatenate([x[good], x[plainly]])
    exact = np.repeat([False, True], [good.sum(), plainly.sum()])
    return np.concatenate([found[good], literal[plainly]]), both(at), both(size), both(rows), exact, slots


def _whole_lines(c: words.Chunk, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size words from at are all words of a line."""
    if not len(at):
        return np.zeros(0, bool)
    lines = np.cumsum(np.concatenate([[0], c.data == 10]))
    begins = np.ones(len(c.starts) + 1, bool)
    begins[1:-1] = lines[c.starts[1:]] > lines[c.ends[:-1]]
    begins[c.bounds] = True
    inner = np.cumsum(np.concatenate([[0], begins]))
    return begins[at] & begins[at + size] & (inner[at + size] - inner[at] == 1)


def _slot_values(c: words.Chunk, slots: np.ndarray, at: int, size: int) -> list[str]:
    value = lambda i: re.sub("[ -]+", " ", bytes(c.data[c.starts[i] : c.ends[i]]).decode("utf-8", "replace").lower())
    return [f"{slots[i]}{value(i)}" for i in range(at, at + size) if slots[i]]


def _rows(c: Parsed, ids: list, numbers: np.ndarray, keep: np.ndarray, found, at, size, rows, exact, slots) -> pa.RecordBatch:
    keep = np.flatnonzero(keep)
    lists = [[] if exact[i] else _slot_values(c, slots, int(at[i]), int(size[i])) for i in keep]
    places = at[keep] - c.bounds[rows[keep]]
    return pa.RecordBatch.from_arrays([pa.array([ids[c.first + r] for r in rows[keep].tolist()], pa.int64()), pa.array(numbers[c.first + rows[keep]]), pa.array(places), pa.array(found[keep].view(np.int64)), pa.array(lists, pa.list_(pa.string())), pa.array(exact[keep]), pa.array(size[keep].astype(np.int32))], ["id", "row", "place", "hash", "slots", "exact", "size"])


def _numbers():
    """A function that numbers the rows of batches; numbers of different tasks differ."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 40

    def of(batch: pa.RecordBatch) -> np.ndarray:
        nonlocal at
        at += batch.num_rows
        return np.arange(at - batch.num_rows, at)

    return of


SCHEMA = "id long, row long, place long, hash long, slots array<string>, exact boolean, size int"


def benchmark_windows(items: DataFrame) -> DataFrame:
    """item_id, item_row, place, hash, slots, exact, size (words), item_windows and item_templates (those that are not exact) of (id, text) rows. Rows that share an id are told apart."""

    def run(batches):
        number = _numbers()
        for batch in batches:
            ids, numbers = batch.column("id").to_pylist(), number(batch)
            for c in _chunks(batch.column("text")):
                w = windows(c, known=True)
                yield _rows(c, ids, numbers, np.ones(len(w[0]), bool), *w)

    made = materialise(items.mapInArrow(run, SCHEMA).withColumnsRenamed({"row": "item_row", "id": "item_id"}), "benchmark-windows")
    sizes = made.groupBy("item_id", "item_row").agg(F.countDistinct("place").alias("item_windows"), F.countDistinct(F.when(~F.col("exact"), F.col("place"))).alias("item_templates"))
    return made.join(sizes, ["item_id", "item_row"])


def matched_windows(docs: DataFrame, hashes: DataFrame, short: list[int]) -> DataFrame:
    """The windows of documents (id, text) whose hash the bitmap of benchmark hashes holds."""
    slot = F.pmod(F.col("hash"), F.lit(BITMAP))
    filled = hashes.select(F.floor(slot / 8).alias("byte"), F.call_function("shiftleft", F.lit(1), (slot % 8).cast("int")).alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bits"))
    bits = filled.toPandas()  # BITMAP / 8 rows at most
    bitmap = np.zeros(BITMAP // 8, np.uint8)
    bitmap[bits["byte"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        bitmap, number = shared.value, _numbers()
        for batch in batches:
            ids, numbers = batch.column("id").to_pylist(), number(batch)
            for c in _chunks(batch.column("text")):
                for width in (WIDTH, *short):
                    w = windows(c, width)
                    at = (w[0] % np.uint64(BITMAP)).astype(np.int64)
                    hit = (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                    if width != WIDTH:
                        hit &= w[2] == width
                    if hit.any():
                        yield _rows(c, ids, numbers, hit, *w)

    return docs.mapInArrow(run, SCHEMA)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", covered: float = COVERED) -> DataFrame:
    """One row per document (each row of it) and item (each row of it) that covers enough of it: doc_id, item_id, matched_windows, item_windows, coverage, changed_slots."""
    items = items.select(whole_ids(items, item_col).alias("id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).filter("id is not null")
    known = materialise(benchmark_windows(items), "benchmark")
    docs = docs.select(whole_ids(docs, id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # windows shorter than WIDTH exist for short items only
    short = sorted(r["size"] for r in known.filter(f"size < {WIDTH}").select("size").distinct().collect())  # WIDTH values at most
    found = matched_windows(docs, known.select("hash"), short).withColumnRenamed("id", "doc_id")
    found = materialise(found.drop("exact", "size"), "window-hits")
    met = found.join(maybe_broadcast(known.select("hash", "item_id", "item_row", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"), "exact", "item_windows", "item_templates")), "hash")
    met = met.filter(F.size("slots") == F.size("item_slots")).withColumn("shift", F.col("place") - F.col("item_place"))
    met = materialise(met, "aligned")
    pairs = met.filter(F.size("slots") > 0).select("doc_id", "row", "item_id", "item_row", "shift", F.explode(F.arrays_zip("item_slots", "slots")).alias("z"))
    values = pairs.groupBy("doc_id", "row", "item_id", "item_row", "shift", "z.item_slots").agg(F.min("z.slots").alias("lo"), F.max("z.slots").alias("hi"))
    clash = F.col("lo") != F.col("hi")
    judged = values.groupBy("doc_id", "row", "item_id", "item_row", "shift").agg(F.collect_set(F.when(clash, F.col("item_slots"))).alias("clashing"), F.sum((~clash & (F.col("lo") != F.col("item_slots"))).cast("long")).alias("changed"))
    # a clash takes the windows that hold its slot, but those whose values are all the item's own
    held = met.join(judged, ["doc_id", "row", "item_id", "item_row", "shift"], "left").filter((F.col("slots") == F.col("item_slots")) | ~F.coalesce(F.arrays_overlap("item_slots", "clashing"), F.lit(False)))
    share = lambda n, of: F.coalesce(F.try_divide(n, of), F.lit(0.0))
    out = held.groupBy("doc_id", "row", "item_id", "item_row").agg(F.countDistinct("item_place").alias("matched_windows"), F.max("item_windows").alias("item_windows"), F.max(F.coalesce("changed", F.lit(0))).alias("changed_slots"), F.countDistinct(F.when(~F.col("exact"), F.col("item_place"))).alias("templates"), F.max("item_templates").alias("item_templates"))
    # exact windows don't count against an item that was re-parameterised
    coverage = F.greatest(share(F.col("matched_windows"), F.col("item_windows")), share(F.col("templates"), F.col("item_templates")))
    return out.withColumn("coverage", coverage).filter(F.col("coverage") >= covered).drop("row", "item_row", "templates", "item_templates")


def report(docs: DataFrame, items: DataFrame, **more) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, items (sorted item ids), best_coverage, changed_slots."""
    found = matches(docs, items, **more)
    per = found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("best"), F.max("changed_slots").alias("changed"))
    per = per.withColumnRenamed("doc_id", "__id")
    out = docs.select("doc_id").join(per, F.col("doc_id") == F.col("__id"), "left")
    return out.select("doc_id", F.col("__id").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).alias("n_items"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("best", F.lit(0.0)).alias("best_coverage"), F.coalesce("changed", F.lit(0)).alias("changed_slots"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the contaminated ones."""
    gone = matches(docs, items).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
