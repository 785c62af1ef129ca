"""Token counts of documents without encoding any document.

A byte-level BPE encodes each pre-token by itself, so a document's token count is the sum over its pre-tokens. The
distinct pre-tokens of the corpus are gathered and encoded once each (only the number of pieces is kept); documents
then look their pre-tokens up:

- the head: the most frequent pre-tokens, at most HEAD_ROWS, go to every task as two sorted arrays (9 bytes a row);
- the tail: all others are joined by Spark, as (document, pre-token, frequency) rows, and summed.

Pre-tokens are found with array operations over code points for texts in the common Latin blocks; texts with any
other character go through the tokenizer's own pre-tokenizer. Special strings inside texts count as one token, as is
the library's default.

Pre-tokens are told apart by 64-bit hashes of their characters (by themselves where they have others than Latin ones).

Defined cases: null and empty texts have 0 bytes and 0 tokens. Rows that repeat are counted row by row. Empty tables
give empty results. Columns besides id and text are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import materialise

HEAD_ROWS = 1 << 19
#: Distinct pre-tokens that a task holds before it hands their counts on.
HELD = 50_000
#: Texts that are Python strings at once.
SLICE = 128
#: Characters that are processed at once; a longer text is cut after a line end or a space that stands between two other characters.
CHUNK_CHARS = 1 << 17

_LETTER, _NUMBER, _SPACE, _OTHER, _FAR = 0, 1, 2, 3, 4
_POWER = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPECIAL = "<|endoftext|>"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already, and threads hold memory
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _classes() -> np.ndarray:
    """Class of each code point up to U+206F; those outside the blocks that this module classifies are _FAR."""
    import regex

    out = np.full(0x2071, _FAR, np.uint8)
    for c in [*range(0x250), *range(0x2000, 0x2070)]:
        ch = chr(c)
        out[c] = _SPACE if regex.match(r"\s", ch) else _LETTER if regex.match(r"\p{L}", ch) else _NUMBER if regex.match(r"\p{N}", ch) else _OTHER
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PreTokens:
    """Finds and hashes the pre-tokens of texts."""

    def __init__(self, path: str):
        self.classes, self.tok = _classes(), load(path)
        self.powers = np.cumprod(np.full(CHUNK_CHARS + 1, _POWER, np.uint64))
        inverse = np.uint64(pow(int(_POWER), -1, 1 << 64))
        self.inverses = np.cumprod(np.full(CHUNK_CHARS + 1, inverse, np.uint64))
        self.keys = _mixed(np.arange(1, 0x2072, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

    def starts(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pre-tokens start. codes: of texts laid end to end, ends: where each text ends (exclusive). All characters are near."""
        n = len(codes)
        kind = self.classes[codes]
        first = np.zeros(n + 1, bool)  # of a text
        first[0] = True
        first[ends] = True
        space, blank = kind == _SPACE, codes == 32
        run = first[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        begin = run & ~space
        # a single U+0020 before a run belongs to it; the last character of white space before a run is cut off
        last = np.zeros(n, bool)
        last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
        begin[1:] &= ~(last[:-1] & blank[:-1])
        begin |= last | (run & space)
        # 's 't 're 've 'm 'll 'd, where a lone apostrophe that starts a pre-token stands before letters
        at = np.flatnonzero(begin & (codes == 39))
        at = at[at + 1 < n]
        at = at[~first[at + 1] & (kind[at + 1] == _LETTER)]
        if len(at):
            a = codes[at + 1]
            b = np.where((at + 2 < n) & ~first[np.minimum(at + 2, n)], codes[np.minimum(at + 2, n - 1)], 0)
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            begin[at[one | two] + 1] = False
            stop = np.concatenate([at[one] + 2, at[two] + 3])
            stop = stop[stop < n]
            begin[stop] = True
        return np.flatnonzero(begin)

    def near(self, text: str) -> bool:
        return text.isascii() or bool((self.classes[np.minimum(_codes(text), 0x2070)] != _FAR).all())

    def hashes(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n = len(codes)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.keys[codes] * self.powers[:n], out=total[1:])
        ends = np.append(starts[1:], n)
        return _mixed((total[ends] - total[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))

    def hash_of(self, pieces: list[str]) -> np.ndarray:
        """Hashes of whole pre-tokens; 0 for one with far characters, which is never in the head."""
        out = np.zeros(len(pieces), np.uint64)
        known = [i for i, p in enumerate(pieces) if self.near(p) and len(p) < CHUNK_CHARS]
        for a in range(0, len(known), 20_000):
            some = known[a : a + 20_000]
            size = np.cumsum([0, *(len(pieces[i]) for i in some)])
            for b in _groups(size):
                part = some[b[0] : b[1]]
                out[part] = self.hashes(_codes("".join(pieces[i] for i in part)), (size[b[0] : b[1]] - size[b[0]]))
        return out

    def of(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, callable]]:
        """For groups of texts: rows of the pre-tokens (index into texts), their hashes, and a function from an index to the pre-token."""
        waiting, size = [], 0
        for row, text in enumerate(texts):
            for part in self._parts(text):
                if isinstance(part, list):
                    yield np.full(len(part), row), self.hash_of(part), part.__getitem__
                    continue
                if size + len(part) > CHUNK_CHARS and waiting:
                    yield self._found(waiting)
                    waiting, size = [], 0
                waiting.append((row, part))
                size += len(part)
        if waiting:
            yield self._found(waiting)

    def _parts(self, text: str):
        """The text as pieces with whole pre-tokens: strings of near characters, or lists of pre-tokens."""
        for k, piece in enumerate(text.split(_SPECIAL) if _SPECIAL in text else [text]):
            if k:
                yield [_SPECIAL]
            at = 0
            while at < len(piece):
                cut = len(piece) if len(piece) - at <= CHUNK_CHARS else _cut(piece, at) or len(piece)
                head, at = piece[at:cut], cut
                if self.near(head) and len(head) <= CHUNK_CHARS:
                    yield head
                else:
                    yield [head[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(head)]

    def _found(self, waiting: list[tuple[int, str]]):
        joined = "".join(t for _, t in waiting)
        codes = _codes(joined)
        ends = np.cumsum([len(t) for _, t in waiting])
        starts = self.starts(codes, ends)
        rows = np.repeat([r for r, _ in waiting], np.diff(np.concatenate([[0], np.searchsorted(starts, ends)])))
        stops = np.append(starts[1:], len(codes))
        return rows, self.hashes(codes, starts), lambda i: joined[starts[i] : stops[i]]

    def count(self, piece: str) -> int:
        return 1 if piece == _SPECIAL else len(self.tok.encode(piece, add_special_tokens=False).ids)

    def counts(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _groups(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of strings with the given running sizes, each of at most CHUNK_CHARS characters."""
    a = 0
    while a < len(size) - 1:
        b = max(a + 1, int(np.searchsorted(size, size[a] + CHUNK_CHARS, "right")) - 1)
        yield a, b
        a = b


def _cut(text: str, start: int) -> int:
    """A place within the CHUNK_CHARS characters behind start where a pre-token surely starts: a space between two characters that are no white space; 0 if there is none."""
    at = start + CHUNK_CHARS
    while at > start + 1:
        at = text.rfind(" ", start, at)
        if at <= start:
            return 0
        if not text[at - 1].isspace() and not text[at + 1].isspace():
            return at
    return 0


def _distinct(path: str):
    def run(batches):
        find, held = PreTokens(path), {}

        def flush():
            yield pa.RecordBatch.from_pydict({"piece": [p for p, _ in held.values()], "n": [n for _, n in held.values()]}, pa.schema([("piece", pa.string()), ("n", pa.int64())]))

        for part in (batch.slice(a, SLICE) for batch in batches for a in range(0, batch.num_rows, SLICE)):
            for _, hashes, piece in find.of(part.column("text").to_pylist()):
                some, at, n = np.unique(hashes, return_index=True, return_counts=True)
                for h, i, k in zip(some.tolist(), at.tolist(), n.tolist()):
                    if h == 0:  # not hashed: far characters
                        for j in np.flatnonzero(hashes == 0).tolist():
                            p = piece(j)
                            held[p] = (p, held.get(p, (p, 0))[1] + 1)
                    elif h in held:
                        held[h] = (held[h][0], held[h][1] + k)
                    else:
                        held[h] = (piece(i), k)
                if len(held) > HELD:
                    yield from flush()
                    held = {}
        if held:
            yield from flush()

    return run


def distinct_pieces(docs: DataFrame, path: str) -> DataFrame:
    """All distinct pre-tokens of docs.text: piece, n (occurrences), hash, pieces (tokens that it encodes to)."""

    def encode(batches):
        find = PreTokens(path)
        for batch in batches:
            texts = batch.column("piece").to_pylist()
            counts = [n for a in range(0, len(texts), 1000) for n in find.counts(texts[a : a + 1000])]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("n"), pa.array(find.hash_of(texts).view(np.int64)), pa.array(counts, pa.int32())], ["piece", "n", "hash", "pieces"])

    met = docs.select("text").mapInArrow(_distinct(path), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return met.mapInArrow(encode, "piece string, n long, hash long, pieces int")


def head_of(table: DataFrame, rows: int = HEAD_ROWS) -> tuple[int, np.ndarray, np.ndarray]:
    """(least, hashes, pieces): pre-tokens that occur least times or more, at most rows of them, as sorted arrays."""
    level = F.floor(F.log2("n") * 16)  # 16 levels a doubling, so few of them whatever the counts
    levels = table.groupBy(level.alias("level")).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("k")).orderBy(F.desc("level")).collect()
    least, total = 1 << 62, 0
    for level in levels:
        total += level["k"]
        if total > rows:
            break
        least = level["n"]
    head = table.filter((F.col("n") >= least) & (F.col("hash") != 0)).select("hash", "pieces").toPandas()
    order = np.argsort(keys := head["hash"].to_numpy(np.int64).view(np.uint64))
    return least, keys[order], head["pieces"].to_numpy(np.int32)[order]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", head_rows: int = HEAD_ROWS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    path = path or tokenizer_path()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = materialise(distinct_pieces(docs, path), "pieces")
    least, keys, pieces = head_of(table, head_rows)
    shared = docs.sparkSession.sparkContext.broadcast((keys, pieces))

    def look_up(batches):
        find = PreTokens(path)
        keys, pieces = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                known, rest = np.zeros(part.num_rows, np.int64), {}
                for rows, hashes, piece in find.of(part.column("text").to_pylist()):
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                        there = keys[at] == hashes
                        known += np.bincount(rows[there], pieces[at[there]], part.num_rows).astype(np.int64)
                    else:
                        there = np.zeros(len(hashes), bool)
                    for i in np.flatnonzero(~there).tolist():
                        mine = rest.setdefault(int(rows[i]), {})
                        mine[p] = mine.get(p := piece(i), 0) + 1
                tails = [[{"piece": p, "k": k} for p, k in rest.get(r, {}).items()] for r in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(known), pa.array(tails, pa.list_(pa.struct([("piece", pa.string()), ("k", pa.int64())])))], ["doc_id", "n_bytes", "known", "tail"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sized = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    looked_up = sized.mapInArrow(look_up, f"doc_id {kind}, n_bytes long, known long, tail array<struct<piece: string, k: long>>")
    met = materialise(looked_up.withColumn("row", F.monotonically_increasing_id()), "token-tails")  # the number is written with the row, so it is the same whenever it is read
    tail = met.filter(F.size("tail") > 0).select("row", F.explode("tail").alias("t")).select("row", "t.piece", "t.k")
    summed = tail.join(table.filter(f"n < {least} or hash = 0").select("piece", "pieces"), "piece").groupBy("row").agg(F.sum(F.col("k") * F.col("pieces")).alias("more"))
    out = met.select("row", "doc_id", "n_bytes", "known").join(summed, "row", "left")
    n = F.col("known") + F.coalesce("more", F.lit(0))
    return out.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
