"""Operator 2, byte-level BPE encoding and decoding with given merge ranks.

Texts are cut into pre-tokens without a regular expression. Every code point becomes one of nine symbols (letter, digit,
other, apostrophe of a contraction, blank before a word, ...), each symbol is a transition function of an eight-state
automaton, and functions compose associatively: the finite set of all compositions is tabulated, so that blocks of the
text are scanned side by side and their results combined. The state before a character says whether a token starts there.
The slices go through pair merging once per distinct slice and task; the cache is emptied when it is full and when the task
ends, since workers live on and serve other operators.

Edge cases: a null text encodes like an empty one (no ids); decoding null ids gives empty bytes. Texts of any length are
scanned in chunks that hand their state on. Repeated rows are encoded one by one. Other columns pass through ``encoded``,
but for one that is named like its result.
"""

from __future__ import annotations

import base64
import functools
import heapq
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.codepoints import CHUNK, SEPARATOR, classes

#: A vocabulary file is sent to every worker, so its size is bounded.
MAX_VOCABULARY_BYTES = 64 << 20
#: Pre-tokens that a task remembers.
CACHE_SIZE = 250_000
#: Characters that are encoded at once; results leave the worker at the same pace.
BATCH_CHARS = 1 << 19
#: Rows whose texts become Python strings at once, whatever the size of the Arrow batches.
SLICE = 256
#: Bytes of a slice up to which slices are merged side by side; longer ones use a heap.
PLAIN_MERGE = 40
LETTER, DIGIT, OTHER, APOSTROPHE_1, APOSTROPHE_2, LEADING_SPACE, LAST_BLANK, BLANK, END = range(9)
FRESH, IN_LETTERS, IN_DIGITS, IN_OTHER, IN_BLANKS, AFTER_SPACE, ONE_LEFT, TWO_LEFT = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a token starts at the symbol."""
    if symbol == LETTER:
        after = {TWO_LEFT: ONE_LEFT, ONE_LEFT: FRESH}.get(state, IN_LETTERS)
        return after, state not in (IN_LETTERS, AFTER_SPACE, ONE_LEFT, TWO_LEFT)
    if symbol == DIGIT:
        return IN_DIGITS, state not in (IN_DIGITS, AFTER_SPACE)
    if symbol in (OTHER, APOSTROPHE_1, APOSTROPHE_2):
        joined = state in (IN_OTHER, AFTER_SPACE)
        if joined or symbol == OTHER:
            return IN_OTHER, not joined
        return (ONE_LEFT if symbol == APOSTROPHE_1 else TWO_LEFT), True
    if symbol == BLANK:
        return IN_BLANKS, state != IN_BLANKS
    return (AFTER_SPACE if symbol == LEADING_SPACE else FRESH), True


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Compositions and actions of all transition functions, token starts by (state, symbol), index of the identity.

    The nine symbols are the first functions.
    """
    functions = [tuple(_step(s, symbol)[0] for s in range(8)) for symbol in range(9)]
    index: dict[tuple, int] = {}
    for k, f in enumerate(functions):
        index.setdefault(f, k)
    identity = tuple(range(8))
    functions.append(identity)
    index.setdefault(identity, len(functions) - 1)
    done = 0
    while done < len(functions):  # close the set under composition with a symbol
        f = functions[done]
        for g in functions[:9]:
            h = tuple(g[s] for s in f)
            if h not in index:
                index[h] = len(functions)
                functions.append(h)
        done += 1
    table = [[index[tuple(g[s] for s in f)] for g in functions] for f in functions]
    starts = [[_step(s, symbol)[1] for symbol in range(9)] for s in range(8)]
    return (np.array(table, np.uint16), np.array(functions, np.uint8), np.array(starts, bool), index[identity])


def states_before(symbols: np.ndarray, first: int, block: int = 256) -> np.ndarray:
    """State of the automaton before each transition function of an array, by blocks that are scanned side by side."""
    compose, act, _, identity = _tables()
    n, width = len(symbols), len(act)
    flat, act_flat = compose.ravel(), act.ravel()
    blocks = -(-n // block)
    laid = np.full(blocks * block, identity, np.uint16)
    laid[:n] = symbols
    laid = np.ascontiguousarray(laid.reshape(blocks, block).T)
    prefix = np.empty((block, blocks), np.uint16)
    run = np.full(blocks, identity, np.uint16)
    for t in range(block):
        prefix[t] = run
        run = flat.take(run.astype(np.int32) * width + laid[t])
    starts = np.array([first], np.uint8) if blocks == 1 else states_before(run, first, block)
    return act_flat.take(prefix.astype(np.int32) * 8 + starts).T.reshape(-1)[:n]


def _symbols(codes: np.ndarray, start: int, end: int) -> np.ndarray:
    """Symbols of codes[start:end]; the two code points after the end decide on the last ones."""
    own = codes[start:end]
    kinds = classes()[codes[start:end + 1]]
    kind = kinds[:end - start]
    before_word = np.zeros(end - start, bool)
    before_word[:len(kinds) - 1] = kinds[1:] < 3
    symbols = kind.copy()
    symbols[kind == 4] = END
    blank = kind == 3
    symbols[blank] = BLANK
    last = blank & before_word
    symbols[last] = LAST_BLANK
    symbols[last & (own == 32)] = LEADING_SPACE
    at = np.flatnonzero(own == 39) + start
    if len(at):
        padded = np.append(codes[start:end + 2], [0, 0, 0])
        one, two = padded[at - start + 1], padded[at - start + 2]
        symbols[at[np.isin(one, [ord(c) for c in "stmd"])] - start] = APOSTROPHE_1
        pairs = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            pairs |= (one == ord(a)) & (two == ord(b))
        symbols[at[pairs] - start] = APOSTROPHE_2
    return symbols


def token_starts(codes: np.ndarray) -> np.ndarray:
    """Positions where a pre-token or a separator starts."""
    _, act, starts, _ = _tables()
    state, found = FRESH, []
    for a in range(0, len(codes), CHUNK):
        b = min(a + CHUNK, len(codes))
        symbols = _symbols(codes, a, b)
        before = states_before(symbols.astype(np.uint16), state)
        found.append(np.flatnonzero(starts.ravel().take(before.astype(np.int32) * 9 + symbols)) + a)
        state = int(act[symbols[-1], before[-1]])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


class Pairs:
    """Ranks of all pairs of tokens whose concatenation is a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        keys, found = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    found.append(rank)
        self.missing = max(ranks.values()) + 1
        self.index = pd.Index(np.array(keys, np.int64))
        # the last place stands for -1, a pair without rank
        self.found = np.array([*found, self.missing], np.int64)
        self.of_byte = np.array([ranks[bytes([c])] for c in range(256)], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.found[self.index.get_indexer((left.ravel() << 32) | right.ravel())].reshape(left.shape)

    def merge_all(self, pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of slices of one length, row by row, and the number of ids of each.

        In each round every slice merges its pair of lowest rank, the leftmost first, until none has a rank.
        """
        ids = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)].reshape(len(pieces), length)
        sizes = np.full(len(pieces), length)
        result = ids.copy()
        rows = np.arange(len(pieces))
        ranks = self.rank(ids[:, :-1], ids[:, 1:]) if length > 1 else np.zeros((len(pieces), 0), np.int64)
        while ranks.shape[1]:
            best = ranks.argmin(axis=1)
            low = ranks[np.arange(len(rows)), best]
            going = low < self.missing
            if not going.all():
                result[rows[~going], :ids.shape[1]] = ids[~going]
                sizes[rows[~going]] = ids.shape[1]
                ids, ranks, rows, best, low = ids[going], ranks[going], rows[going], best[going], low[going]
            if not len(rows):
                return result, sizes
            width = ids.shape[1]
            at = np.arange(len(rows))
            ids[at, best] = low
            kept = np.arange(width - 1)
            ids = np.take_along_axis(ids, kept + (kept > best[:, None]), axis=1)
            kept = np.arange(width - 2)
            ranks = np.take_along_axis(ranks, kept + (kept >= best[:, None]), axis=1)
            right = np.flatnonzero(best < width - 2)
            ranks[right, best[right]] = self.rank(ids[right, best[right]], ids[right, best[right] + 1])
            left = np.flatnonzero(best > 0)
            ranks[left, best[left] - 1] = self.rank(ids[left, best[left] - 1], ids[left, best[left]])
        result[rows, :ids.shape[1]] = ids
        sizes[rows] = ids.shape[1]
        return result, sizes

    def merged(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each slice."""
        found: list = [None] * len(pieces)
        by_length: dict[int, list[int]] = {}
        raw = [p.encode() for p in pieces]
        for k, piece in enumerate(raw):
            whole = self.ranks.get(piece)
            if whole is not None:
                found[k] = [whole]
            elif len(piece) > PLAIN_MERGE:
                found[k] = _merged_long(piece, self.ranks)
            else:
                by_length.setdefault(len(piece), []).append(k)
        for length, places in by_length.items():
            ids, sizes = self.merge_all([raw[k] for k in places], length)
            for k, row, size in zip(places, ids.tolist(), sizes.tolist()):
                found[k] = row[:size]
        return found


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long slice, with a heap of pairs and a linked list of parts."""
    n = len(piece)
    ends, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = []

    def offer(i: int) -> None:
        j = ends[i]
        if j < n:
            rank = ranks.get(piece[i:ends[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, ends[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or ends[i] >= n or ends[ends[i]] != end:
            continue  # one of the two parts has been merged since
        alive[ends[i]] = False
        ends[i] = end
        if end < n:
            left[end] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    found, i = [], 0
    while i < n:
        found.append(ranks[piece[i:ends[i]]])
        i = ends[i]
    return found


class Slots(dict):
    """Slot of each slice; a slice that is asked for the first time gets the next slot and waits in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        slot = self[piece] = len(self)
        self.new.append(piece)
        return slot


class Codec:
    """Encoder and decoder of one vocabulary, with the slices that this worker has met."""

    def __init__(self, content: bytes):
        lines = (line.split() for line in content.splitlines() if line.strip())
        ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.pairs = Pairs(ranks)
        by_id = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known = Slots()
        self.known[SEPARATOR] = 0  # a separator is a slice without ids
        self.ids, self.first, self.count = array("I"), array("q", [0]), array("q", [0])

    def learn(self) -> None:
        """Merge the slices that wait."""
        for ids in self.pairs.merged(self.known.new):
            self.first.append(len(self.ids))
            self.count.append(len(ids))
            self.ids.extend(ids)
        self.known.new.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        joined = SEPARATOR.join(texts) + SEPARATOR
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = token_starts(codes)
        closes = np.flatnonzero(codes[starts] == ord(SEPARATOR))
        if len(self.known) > CACHE_SIZE:
            self.forget()
        bounds = starts.tolist()
        pieces = [joined[a:b] for a, b in zip(bounds, [*bounds[1:], len(codes)])]
        slots = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        self.learn()
        count, first = np.frombuffer(self.count, np.int64), np.frombuffer(self.first, np.int64)
        sizes = count[slots]
        ends = np.cumsum(sizes)
        total = int(ends[-1])
        if total:
            ids = np.frombuffer(self.ids, np.uint32)
            data = ids[np.repeat(first[slots] - (ends - sizes), sizes) + np.arange(total)].astype("<u4").tobytes()
            del ids
        else:
            data = b""
        del count, first  # the arrays cannot grow while a view of them lives
        limits = [0, *(ends[closes] * 4).tolist()]
        return [data[a:b] for a, b in zip(limits, limits[1:])]

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the tokens, gathered from the vocabulary by their offsets; CHUNK ids at a time."""
        numbers, parts = np.frombuffer(ids, "<u4"), []
        for a in range(0, len(numbers), CHUNK):
            own = numbers[a:a + CHUNK].astype(np.int64)
            sizes = self.lengths[own]
            ends = np.cumsum(sizes)
            at = np.repeat(self.offsets[own] - (ends - sizes), sizes) + np.arange(int(ends[-1]))
            parts.append(self.bytes[at].tobytes())
        return b"".join(parts)

    def token_offsets(self, ids: bytes) -> bytes:
        """Byte position where each token starts in the decoded bytes, as little-endian signed 64-bit integers."""
        sizes = self.lengths[np.frombuffer(ids, "<u4").astype(np.int64)]
        return (np.cumsum(sizes) - sizes).astype("<i8").tobytes()


_CODECS: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """The worker's codec of a broadcast vocabulary, built once."""
    content = shared.value
    key = hash(content)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(content)
    return _CODECS[key]


def vocabulary(spark: SparkSession, path: str):
    """Broadcast a file of lines ``base64(token) rank``; its size is bounded by MAX_VOCABULARY_BYTES."""
    with open(path, "rb") as file:
        content = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(content)


def _in_batches(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in order, about BATCH_CHARS characters at a time; null texts as empty ones."""
    pending, held = [], 0
    for text in (text for start in range(0, len(texts), SLICE) for text in texts.slice(start, SLICE).to_pylist()):
        pending.append(text or "")
        held += len(pending[-1])
        if held >= BATCH_CHARS:
            yield pending
            pending, held = [], 0
    if pending:
        yield pending


def encoder(shared) -> Callable[[Column], Column]:
    """Function from a text column to binary ids, little-endian unsigned 32-bit."""

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared)
        try:
            for batch in batches:
                for texts in _in_batches(batch):
                    yield pa.array(codec.encode(texts), pa.binary())
        finally:
            codec.forget()

    return encode


def recoder(shared) -> Callable[[Column], Column]:
    """Function from a text column to a struct of its binary ids and the bytes that they decode to.

    One worker does both; an encoder and a decoder in one plan would need two for each task.
    """

    @F.arrow_udf("struct<ids binary, decoded binary>")
    def recode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared)
        try:
            for batch in batches:
                for texts in _in_batches(batch):
                    ids = codec.encode(texts)
                    yield pa.StructArray.from_arrays(
                        [pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.binary())], names=["ids", "decoded"])
        finally:
            codec.forget()

    return recode


def _per_value(shared, method: str) -> Callable[[Column], Column]:
    @F.pandas_udf("binary")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = getattr(_codec(shared), method)
        for batch in batches:
            yield pd.Series([one(ids or b"") for ids in batch], dtype=object)

    return apply


def decoder(shared) -> Callable[[Column], Column]:
    """Function from binary ids to the bytes of their tokens."""
    return _per_value(shared, "decode")


def offsetter(shared) -> Callable[[Column], Column]:
    """Function from binary ids to the byte positions of their tokens, little-endian signed 64-bit."""
    return _per_value(shared, "token_offsets")


def encoded(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of a text column; a column of that name is replaced."""
    return docs.withColumn(ids, encoder(vocabulary(docs.sparkSession, path))(F.col(text)))


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per document: its key, n_tokens, digest of the ids and digest of the bytes decoded from them.

    With ``keep_ids`` also ``ids``, the ids themselves as little-endian unsigned 32-bit integers.
    """
    shared = vocabulary(docs.sparkSession, path)
    coded = docs.select(F.col(key), recoder(shared)(F.col(text)).alias("coded"))
    ids = [F.col("coded.ids").alias("ids")] if keep_ids else []
    return coded.select(key, (F.octet_length("coded.ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("coded.ids", 256).alias("ids_sha256"),
                        F.sha2("coded.decoded", 256).alias("decoded_sha256"), *ids)
