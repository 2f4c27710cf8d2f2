"""Byte-level BPE by a lazily determinised transducer, and streaming decode.

The merges (given as ranks) define for every byte string one sequence of tokens.  That sequence is
the only one in which each token is reached by its own merges and each two neighbours stay apart
when their joint bytes are merged.  So a non-deterministic transducer that reads bytes, holds the bytes since
its last token, and may emit a token whenever those two conditions hold, has one accepting run per
string.  `Transducer` determinises it on demand: a state is the set of unfinished tokens that live runs
hold, made by subset construction when it is first reached, with the tokens that may end there.
A register of the last token of each run (one per byte, no further back than the longest token) decides which of
them does.  A run dies at the latest after the longest token's length, which bounds the lookahead: each time `window` bytes (twice that length)
have been read, the tokens that all live runs share are emitted, so a piece of any length needs a buffer of about that size.

Rows: null text counts as empty (no ids).  Empty tables give no rows.  Repeated rows give repeated results; other columns pass
through `encode` and `decode` untouched, and only the named output column is added (a column
of that name is replaced).
"""

from __future__ import annotations

import base64
import functools
import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The Unicode White_Space characters (fixed values).
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
MOST_STATES, MOST_PAIRS, MOST_CHUNKS, MOST_PIECES = 100_000, 600_000, 250_000, 150_000


class Transducer:
    """Merges of `ranks` (token bytes to id) as a transducer whose states are made when first reached."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.window = 2 * max(map(len, self.ranks))
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        self.apart: dict[int, bool] = {}
        self.own: dict[bytes, tuple | None] = {}
        self._reset()

    def _reset(self):
        self.states: dict[tuple, tuple[dict, tuple]] = {}
        self.start = self._state((b"",))

    def _state(self, live: tuple[bytes, ...]) -> tuple[dict, tuple]:
        """Moves by byte, and the live runs' unfinished bytes."""
        return self.states.setdefault(live, ({}, live))

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a short piece, straight from the definition: lowest rank first, leftmost on ties."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _spines(self, token: bytes):
        """Pieces that stand at the token's left and right edge while it is merged, each with the ranks at which it comes and goes.

        None if the token is not reached by its own merges; the last item tells whether the ranks of those merges never fall."""
        known = self.own.get(token, 0)
        if known != 0:
            return known
        parts = [token[i : i + 1] for i in range(len(token))]
        left, right, came, rising = [], [], [-1, -1], True
        now = -1
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            rising &= rank >= now
            now = rank
            if at == 0:
                left.append((parts[0], came[0], rank))
                came[0] = rank
            if at == len(parts) - 2:
                right.append((parts[-1], came[1], rank))
                came[1] = rank
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        left.append((token, came[0], 1 << 61))
        right.append((token, came[1], 1 << 61))
        known = self.own[token] = (left, right, rising) if len(parts) == 1 else None
        return known

    def _apart(self, a: int, b: int) -> bool:
        """Whether no merge joins bytes of two neighbouring tokens."""
        (_, right, up), (left, _, too) = self._spines(self.tokens[a]), self._spines(self.tokens[b])
        known = True
        if up and too:
            # a pair that stands side by side at some time, and whose merge comes before either is merged elsewhere
            get = self.ranks.get
            for x, x_came, x_goes in right:
                for y, y_came, y_goes in left:
                    if x_came <= y_goes and y_came < x_goes and (rank := get(x + y)) is not None and rank < x_goes and rank <= y_goes:
                        known = False
                        break
                if not known:
                    break
        else:
            known = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        if len(self.apart) > MOST_PAIRS:
            self.apart.clear()
        self.apart[a << 32 | b] = known
        return known

    def _move(self, state: tuple[dict, tuple], byte: int) -> tuple[tuple[dict, tuple], tuple]:
        """The state after a byte, and the tokens (with lengths, longest first) that may end with it."""
        add = bytes((byte,))
        longer = [part + add for part in state[1]]
        ending = tuple((self.ranks[x], len(x)) for x in longer if x in self.ranks and self._spines(x) is not None)
        if len(self.states) > MOST_STATES:
            self._reset()
        move = state[0][byte] = self._state((*(x for x in longer if x in self.prefixes), b"")), ending
        return move

    def ids(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        ends: list[int] = []  # the token that ends at each byte, in the one run that has nothing unfinished there
        apart, state, n, limit = self.apart, self.start, 0, self.window
        for byte in piece:
            move = state[0].get(byte)
            if move is None:
                move = self._move(state, byte)
            state, ending = move
            for token, size in ending:
                if size > n:
                    if not out:
                        break
                    last = out[-1]
                else:
                    last = ends[n - size]
                fits = apart.get(last << 32 | token)
                if fits is None:
                    fits = self._apart(last, token)
                if fits:
                    break
            ends.append(token)
            n += 1
            if n > limit:
                self._settle(ends, out, state[1])
                n = len(ends)
                limit = n + self.window
        tail: list[int] = []
        while n > 0:
            tail.append(ends[n - 1])
            n -= self.size[ends[n - 1]]
        tail.reverse()
        return out + tail if out else tail

    def _settle(self, ends: list[int], out: list[int], live: tuple[bytes, ...]) -> None:
        """Emits the tokens that all live runs share and keeps the rest of the buffer."""
        paths = []
        for part in live:
            path, at = [], len(ends) - len(part)
            while at > 0:
                path.append((at, ends[at - 1]))
                at -= self.size[ends[at - 1]]
            paths.append(path[::-1])
        shared = 0
        for items in zip(*paths):
            if any(x != items[0] for x in items):
                break
            shared += 1
        if shared:
            out.extend(token for _, token in paths[0][:shared])
            del ends[: paths[0][shared - 1][0]]


class Encoder(dict):
    """Whole texts to packed ids.  Keeps the packed ids of chunks (white space and what follows it): no match of the pattern crosses their bounds."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.machine = Transducer(ranks)
        self.known: dict[str, bytes] = {}
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"), regex.V0)

    def __missing__(self, chunk: str) -> bytes:
        parts, known = [], self.known
        word = chunk.rstrip(",.;:!?")
        if (word[1:] if word[:1] == " " else word).isalpha():  # letters and marks: what the pattern gives, without the pattern
            pieces = (word, chunk[len(word) :]) if len(word) < len(chunk) else (word,)
        else:
            pieces = self.pieces.findall(chunk)
        for piece in pieces:
            packed = known.get(piece)
            if packed is None:
                packed = array("I", self.machine.ids(piece.encode())).tobytes()
                if len(piece) <= 64:
                    if len(known) > MOST_PIECES:
                        known.clear()
                    known[piece] = packed
            parts.append(packed)
        packed = b"".join(parts)
        if len(chunk) <= 64:
            self[chunk] = packed
        return packed

    def packed(self, text: str) -> bytes:
        out = b"".join(map(self.__getitem__, CHUNK.findall(text)))
        if len(self) > MOST_CHUNKS:
            self.clear()
        return out


class Utf8Stream:
    """Incremental UTF-8: the state is the bytes of an unfinished character; malformed bytes become U+FFFD."""

    def __init__(self):
        self.pending = b""

    @staticmethod
    def step(pending: bytes, data: bytes) -> tuple[str, bytes]:
        data, out, i = pending + data, [], 0
        while i < len(data):
            lead = data[i]
            low, high, need = 0x80, 0xBF, 0
            if lead < 0x80:
                out.append(chr(lead))
                i += 1
                continue
            if 0xC2 <= lead <= 0xDF:
                need = 1
            elif 0xE0 <= lead <= 0xEF:
                need, low, high = 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
            elif 0xF0 <= lead <= 0xF4:
                need, low, high = 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
            if not need:
                out.append("�")
                i += 1
                continue
            code, j = lead & (0x3F >> need), i + 1
            while need and j < len(data) and low <= data[j] <= high:
                code = code << 6 | data[j] & 0x3F
                low, high, need, j = 0x80, 0xBF, need - 1, j + 1
            if not need:
                out.append(chr(code))
            elif j == len(data):
                return "".join(out), data[i:]
            else:
                out.append("�")
            i = j
        return "".join(out), b""

    def feed(self, data: bytes) -> str:
        text, self.pending = self.step(self.pending, data)
        return text

    def end(self) -> str:
        left, self.pending = self.pending, b""
        return "�" if left else ""


class Decoder:
    """Packed ids to text, token by token; a step that has been taken before is looked up."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.tokens = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
        self.steps: dict[bytes, dict[int, tuple[str, bytes]]] = {}

    def text(self, packed: bytes) -> str:
        out, pending = [], b""
        steps = self.steps.setdefault(pending, {})
        for token in memoryview(packed).cast("I"):
            move = steps.get(token)
            if move is None:
                if len(self.steps) > 5000:
                    self.steps.clear()
                move = steps[token] = Utf8Stream.step(pending, self.tokens[token])
            out.append(move[0])
            if move[1] != pending:
                pending = move[1]
                steps = self.steps.setdefault(pending, {})
        return "".join(out) + ("�" if pending else "")


@functools.lru_cache(2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@functools.lru_cache(2)
def _decoder(path: str) -> Decoder:
    return Decoder(path)


def _mapped(df: DataFrame, source: str, target: str, kind: T.DataType, arrow: pa.DataType, make) -> DataFrame:
    kept = [c for c in df.columns if c != target]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(target, kind)])

    def run(batches):
        f = make()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                values = [f(x) for x in batch.column(source).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(values, arrow)], [*kept, target])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds `ids`: the tokens of each text as little-endian unsigned 32-bit integers (binary; empty for null)."""

    def make():
        encoder = _encoder(path, pattern)
        return lambda t: encoder.packed(t or "")

    return _mapped(df, text, ids, T.BinaryType(), pa.large_binary(), make)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds `text`: packed ids read back (null: empty); bytes that are not UTF-8 become U+FFFD."""

    def make():
        decoder = _decoder(path)
        return lambda b: decoder.text(b or b"")

    return _mapped(df, ids, text, T.StringType(), pa.large_string(), make)


def op1(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import read

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN).select("doc_id", "ids")
    digests = ids.select("doc_id", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"))
    return decode(digests, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
