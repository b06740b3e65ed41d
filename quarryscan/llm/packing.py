"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Pieces and gaps are ordered by length. A round takes the longest unplaced length, sweeps the gaps
for the successor (the smallest gap that holds it), lets the pieces of that length claim those gaps by
rank, updates the gaps and repeats. Lengths and gaps are integers of at most `limit`, so a round
works on counted classes: the state is a bounded number of (contents, gap, count) groups whatever
the number of pieces, and the result is exactly best-fit decreasing. Each piece then finds its
sequence from its length and its rank among equals, without a task that sees all pieces of a length.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each; null ids
stay null; an empty table gives no pieces. Of clashing columns only `doc_id` and `text` are read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, bounded_batches

LIMIT = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: White space outside ASCII, of all that an expression may count.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80")
#: Pieces that are one pre-token for certain, a blank before it or not: the model gets these without being cut again.
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Bytes of text cut and looked up together, as far as a text's end allows.
TOGETHER = 1 << 22
#: Pieces that a worker remembers from task to task: so many, and those met since it had so many. The longest of them in characters; others are encoded anew.
MEMO, MEMO_CHARS = 400_000, 40
_LOADED: dict = {}


def _tokenizer(path: str | None):
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
    return _LOADED[path]


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in the vocabulary of a byte-level model."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)).difference(own)))}


class Coder:
    """The tokenizer's ids of texts; those of short pieces are remembered, so that each distinct word is encoded about once."""

    def __init__(self, path: str | None = None):
        coder = _tokenizer(path)
        self.encode_batch = getattr(coder, "encode_batch_fast", coder.encode_batch)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        # The cuts hold for byte-level pre-tokens without a normaliser; another tokenizer gets whole texts.
        before = coder.pre_tokenizer
        self.cuts = coder.normalizer is None and type(before).__name__ == "ByteLevel" and before.use_regex and not before.add_prefix_space
        self.line_end = coder.encode("\n", add_special_tokens=False).ids[0] if self.cuts else None
        # A word goes to the model in its bytes' letters, unless added tokens may stand in words.
        self.model = coder.model if self.cuts and not any(_WORD(t.content) for t in coder.get_added_tokens_decoder().values()) else None
        self.letters = _byte_letters()

    def learn(self, new: list[str]) -> None:
        """Encodes words one by one, other pieces many at once with a line's end between them; those that hold one or special text go alone, and so do those with white space at an end that would join it."""
        other = new
        if self.model is not None:
            other, tokenize, letters = [], self.model.tokenize, self.letters
            for piece in new:
                if _WORD(piece):
                    self.known[piece] = np.array([t.id for t in tokenize(piece.encode().decode("latin-1").translate(letters))], "<u4").tobytes()
                else:
                    other.append(piece)
        odd = [p for p in other if "\n" in p or "<|" in p or p[-1:].isspace() or p.removeprefix(" ")[:1].isspace()]
        plain = list(set(other).difference(odd))
        lots = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        for lot, code in zip(lots, self.encode_batch(["\n".join(lot) for lot in lots], add_special_tokens=False)):
            ids = np.array(code.ids, "<u4")
            data, ends = ids.tobytes(), np.append(np.flatnonzero(ids == self.line_end), len(ids)).tolist()
            begin = 0
            for piece, end in zip(lot, ends, strict=True):
                self.known[piece] = data[4 * begin : 4 * end]
                begin = end + 1
        for piece, code in zip(odd, self.encode_batch(odd, add_special_tokens=False)):
            self.known[piece] = np.array(code.ids, "<u4").tobytes()

    def codes(self, distinct: list[str]) -> list[bytes]:
        """The ids of distinct pieces. What is met stays known; what was not met since then goes when that is MEMO pieces again."""
        if len(self.known) > MEMO:
            self.known, self.before = {}, self.known
        new = []
        for p in distinct:
            if p not in self.known:
                code = self.before.get(p)
                if code is None:
                    new.append(p)
                else:
                    self.known[p] = code
        self.learn(new)
        out = [self.known[p] for p in distinct]
        for p in new:
            if len(p) > MEMO_CHARS:
                del self.known[p]
        return out

    def ids(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not self.cuts:
            return [np.array(e.ids, "<u4") for e in self.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        texts = texts.fill_null("")
        # Slices of TOGETHER bytes: what a text costs besides itself stays bounded.
        ends = _offsets(texts)
        lots = np.flatnonzero(np.diff((ends[1:] - ends[0]) // TOGETHER, prepend=0)) + 1 if len(texts) else []
        bounds = sorted({0, *map(int, lots), len(texts)})
        return [x for i, j in zip(bounds, bounds[1:]) for x in self._slice(texts.slice(i, j - i))]

    def _slice(self, texts: pa.Array) -> list[np.ndarray]:
        """Each distinct piece of the texts is looked up once; Arrow finds them, and the ids of all places are gathered."""
        begins, of_text = cut_places(texts)
        _, _, data = texts.buffers()
        coded = pa.LargeStringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), data).dictionary_encode()
        at, codes = coded.indices.to_numpy(), self.codes(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat, sizes = np.frombuffer(b"".join(codes), "<u4"), np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        length = sizes[at]
        ends = np.cumsum(length)
        out = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - length), length)]
        return np.split(out, np.append(0, ends)[of_text[1:-1]])


def _offsets(texts: pa.Array) -> np.ndarray:
    """Where the texts of a large string array without nulls begin in its data, and where the last one ends."""
    return np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)


def cut_places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin in the data of a large string array without nulls (and the end of the last), and the place in that list where each text begins (and the end).

    A token always begins at a blank or a line's end between other characters, after that line's end, and at a point
    or comma after a letter; a text's ids are those of its pieces cut there.
    """
    ends = _offsets(texts)
    first, last = int(ends[0]), int(ends[-1])
    if first == last:
        return ends[:1].copy(), np.zeros(len(texts) + 1, np.int64)
    data = memoryview(texts.buffers()[2])[first:last]
    byte, starts = np.frombuffer(data, np.uint8), ends[:-1][np.diff(ends) > 0] - first
    solid = (byte > 0x20) & (byte != 0x7F)
    if byte.max() > 0x7F:
        for wide in _WIDE.finditer(data):
            solid[wide.start() : wide.end()] = False
    # A text's first byte has none before it, its last one none behind it.
    line = byte == 0x0A
    between = np.zeros(len(byte), bool)
    between[1:-1] = solid[:-2] & solid[2:]
    between &= line | (byte == 0x20)
    between[starts] = False
    between[np.append(starts[1:], len(byte)) - 1] = False
    cut = between.copy()
    cut[1:] |= (between & line)[:-1]
    letter = ((byte | np.uint8(0x20)) - np.uint8(0x61)) < 26
    letter[1:] |= (byte[:-1] == 0xC3) & (byte[1:] != 0x97) & (byte[1:] != 0xB7)  # from A to y with accents, without the signs of times and divided by
    cut[1:] |= ((byte == 0x2E) | (byte == 0x2C))[1:] & letter[:-1]
    cut[starts] = True
    begins = np.append(np.flatnonzero(cut), len(byte)) + first
    return begins, np.searchsorted(begins, ends)


def coder_of(path: str | None) -> Coder:
    """The worker's coder, with what it remembers from earlier tasks."""
    if ("coder", path) not in _LOADED:
        _LOADED["coder", path] = Coder(path)
    return _LOADED["coder", path]


def pieces(docs: DataFrame, limit: int = LIMIT, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Token pieces: doc_id, piece, start, length, ids_crc32, and the place `part`, `nth` (rank among
    the pieces of one length in that part)."""
    schema = "doc_id bigint, piece int, start long, length long, ids_crc32 long, part int, nth long"
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen = coder_of(tokenizer), TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, code in zip(batch.column(0).to_pylist(), coder.ids(batch.column(1))):
                tokens = np.append(code, np.uint32(end_id)).astype("<u4")
                first = len(tokens) % limit or limit
                begin, end, k = 0, first, 0
                while begin < len(tokens):
                    n = end - begin
                    rows.append((doc_id, k, begin, n, zlib.crc32(tokens[begin:end].tobytes()), part, int(seen[n])))
                    seen[n] += 1
                    begin, end, k = end, end + limit, k + 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def plan(counts: dict[int, int], limit: int = LIMIT) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing on counted lengths.

    Runs (length, first rank, count, first sequence, offset), and the number of sequences.
    Every group is a contiguous range of sequence numbers with equal contents; a round splits at most one
    group and opens at most two, so runs stay in the order of limit squared at worst.
    """
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]  # by gap: (first sequence, count)
    runs, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            gap = next((g for g in range(length, limit + 1) if gaps[g]), None)
            if gap is None:
                each = limit // length
                first, n, gap = opened, -(-left // each), limit
                opened += n
            else:
                first, n = gaps[gap].pop()
            # A best fit goes on filling the same gap while it can: full columns of the group first.
            offset, fit = limit - gap, gap // length
            full = min(n, left // fit)
            if full:
                for k in range(fit):
                    runs.append((length, rank, full, first, offset + k * length))
                    rank += full
                left -= full * fit
                if gap - fit * length:
                    gaps[gap - fit * length].append((first, full))
            if full < n:
                if left:
                    for k in range(left):  # left < fit: one sequence takes them
                        runs.append((length, rank, 1, first + full, offset + k * length))
                        rank += 1
                    rest = gap - left * length
                    left = 0
                    if rest:
                        gaps[rest].append((first + full, 1))
                    full += 1
                if full < n:
                    gaps[gap].append((first + full, n - full))
    return runs, opened


def pack(docs: DataFrame, limit: int = LIMIT, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return assign(Scratch(docs.sparkSession, "packing").write(pieces(docs, limit, end_id, tokenizer), "pieces"), limit)


def assign(cut: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Sequences for a stored table of pieces."""
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = by_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `limit` rows
    runs = np.array(sorted(plan(counts, limit)[0]), np.int64).reshape(-1, 5)
    starts = {length: np.flatnonzero(runs[:, 0] == length) for length in counts}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for value in np.unique(length):
                rows, mine = np.flatnonzero(length == value), runs[starts[int(value)]]
                run = mine[np.searchsorted(mine[:, 1], rank[rows], "right") - 1]
                sequence[rows] = run[:, 3] + rank[rows] - run[:, 1]
                offset[rows] = run[:, 4]
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    schema = "doc_id bigint, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    placed = cut.join(ranked, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return placed.mapInArrow(place, schema)
