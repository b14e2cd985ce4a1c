"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

A token sequence is the BPE encoding of its bytes exactly when every two
neighbours are what BPE makes of their joined bytes. That makes encoding a
finite-state matter: a nondeterministic machine guesses where tokens end, its
state being the last finished token and a place in the trie of token bytes, and
refuses neighbours that don't stand together. Its subset construction is done
on demand, a state and byte at a time. Tokens on which all guesses agree are
emitted at once; the rest wait for more bytes, at most as many as the longest
token has. Decoding feeds tokens to a UTF-8 state machine that keeps the bytes
of an unfinished character.
"""

from __future__ import annotations

import base64
import gc
import re
from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._support import arrow_batches, kept_in_worker

ROOT = 0
NEVER = float("inf")
#: Entries that a worker remembers of pieces, states and neighbours; beyond, it starts anew.
MOST_PIECES, MOST_STATES, MOST_PAIRS = 250_000, 400_000, 500_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the text of a .tiktoken file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], above: float = NEVER) -> list[int]:
    """Plain BPE: join the neighbours of least rank, leftmost first, until none has a rank below ``above``."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if ranks.get(a + b, NEVER) < above]
        if not found:
            break
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Pieces to token ids. Compiled from ranks; determinised as texts need it."""

    def __init__(self, ranks: dict[bytes, int], memory: float = 1.0):
        self.ranks = ranks
        self.most_states, self.most_pairs = int(memory * MOST_STATES), int(memory * MOST_PAIRS)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}  # node * 256 + byte
        self.token: list[int | None] = [None]
        for token, rank in ranks.items():
            node = ROOT
            for c in token:
                key = node << 8 | c
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(None)
                node = self.child[key]
            self.token[node] = rank
        self.pairs: dict[tuple[int | None, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self._reset()

    def _reset(self) -> None:
        # guesses of a state follow each other in one tuple: tokens that wait, the token before, a node
        start = ((), None, ROOT)
        self.shared: dict[tuple, tuple] = {}  # runs of tokens, each kept once
        self.number = {start: 0}
        self.states = [start]
        self.steps: dict[int, int | tuple[int, tuple[int, ...]]] = {}  # state * 256 + byte: the next state, with what is emitted if anything is
        self.ends: list[tuple[int, ...] | None] = [None]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that BPE joins last in making this one; None of a byte."""
        if token not in self.halves:
            parts = merge_by_rank(self.bytes_of[token], self.ranks, above=token)
            self.halves[token] = tuple(parts) if len(parts) == 2 else None
        return self.halves[token]

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """What stands at one edge of a token while it is made, each with the rank that ends it."""
        spine = self.spines[side].get(token)
        if spine is None:
            halves = self._halves(token)
            below = [] if halves is None else self._edge(halves[side], side)
            spine = [*below[:-1], *([(below[-1][0], token)] if below else []), (token, NEVER)]
            self.spines[side][token] = spine
        return spine

    def _stand(self, before: int | None, token: int) -> bool:
        """Whether BPE leaves the two tokens as they are, side by side (or the one alone).

        They stay apart unless, at some rank, what ends the left one and what
        begins the right one are joined before either is joined within its own
        token; of equal ranks the leftmost join comes first.
        """
        key = (before, token)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            if before is None:
                known = merge_by_rank(self.bytes_of[token], self.ranks) == [token]
            else:
                left, right, i, j = self._edge(before, 1), self._edge(token, 0), 0, 0
                while True:
                    (a, a_ends), (b, b_ends) = left[i], right[j]
                    joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
                    if joined is not None and joined < a_ends and joined <= b_ends:
                        known = False
                        break
                    if a_ends == b_ends == NEVER:
                        known = True
                        break
                    if a_ends <= b_ends:
                        i += 1
                    else:
                        j += 1
            self.pairs[key] = known
        return known

    def _guesses(self, state: int) -> Iterator[tuple[tuple[int, ...], int | None, int]]:
        flat = iter(self.states[state])
        return zip(flat, flat, flat, strict=True)

    def _step(self, state: int, byte: int) -> int | tuple[int, tuple[int, ...]]:
        # in the order of where the open token began, so equal sets are equal tuples
        guesses: list[tuple[tuple[int, ...], int | None, int]] = []
        child, fresh, begun = self.child.get, self.child.get(byte), None
        tokens, pairs = self.token, self.pairs.get
        for waiting, before, node in self._guesses(state):
            if (further := child(node << 8 | byte)) is not None:
                guesses.append((waiting, before, further))
            # only one encoding ends here, so only one guess begins
            if begun is None and fresh is not None and (token := tokens[node]) is not None:
                if (stand := pairs((before, token))) is None:
                    stand = self._stand(before, token)
                if stand:
                    begun = (*waiting, token), token, fresh
        if begun is not None:
            guesses.append(begun)
        if not guesses:
            raise ValueError("the vocabulary doesn't cover a byte")
        agreed = guesses[0][0]
        for waiting, *_ in guesses[1:]:
            if not agreed:
                break
            while waiting[: len(agreed)] != agreed:
                agreed = agreed[:-1]
        n = len(agreed)
        one, flat = self.shared.setdefault, []
        for waiting, before, node in guesses:
            rest = waiting[n:]
            flat += one(rest, rest), before, node
        key = tuple(flat)
        if (to := self.number.get(key)) is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.ends.append(None)
        found = self.steps[state << 8 | byte] = (to, one(agreed, agreed)) if n else to
        return found

    def _end(self, state: int) -> tuple[int, ...]:
        for waiting, before, node in self._guesses(state):
            token = self.token[node]
            if token is not None and self._stand(before, token):
                self.ends[state] = (*waiting, token)
                return self.ends[state]
        raise ValueError("the vocabulary doesn't cover a piece")

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one piece. A piece that is a token is that token."""
        if (own := self.ranks.get(piece)) is not None:
            return (own,)
        if not piece:
            return ()
        if len(self.states) > self.most_states:
            self._reset()
        state, out, step = 0, [], self.steps.get
        for byte in piece:
            if (found := step(state << 8 | byte)) is None:
                found = self._step(state, byte)
            if found.__class__ is int:
                state = found
            else:
                state, emitted = found
                out += emitted
        return (*out, *(self.ends[state] or self._end(state)))


#: Lead bytes, the span of the byte that follows, and how many follow in all (Unicode, table 3-7).
UTF8_LEADS = (
    (0xC2, 0xDF, 0x80, 0xBF, 1),
    (0xE0, 0xE0, 0xA0, 0xBF, 2),
    (0xE1, 0xEC, 0x80, 0xBF, 2),
    (0xED, 0xED, 0x80, 0x9F, 2),
    (0xEE, 0xEF, 0x80, 0xBF, 2),
    (0xF0, 0xF0, 0x90, 0xBF, 3),
    (0xF1, 0xF3, 0x80, 0xBF, 3),
    (0xF4, 0xF4, 0x80, 0x8F, 3),
)


def utf8_step(pending: bytes, byte: int) -> tuple[bytes, bool]:
    """The state after one byte, a prefix of a character, and whether ``pending`` was given up."""
    if not pending:
        ok = byte < 0x80 or any(a <= byte <= b for a, b, *_ in UTF8_LEADS)
        return (bytes([byte]) if ok else b""), not ok
    low, high = next((x[2], x[3]) for x in UTF8_LEADS if x[0] <= pending[0] <= x[1]) if len(pending) == 1 else (0x80, 0xBF)
    return (pending + bytes([byte]), False) if low <= byte <= high else (pending, True)


def _whole(pending: bytes) -> bool:
    return bool(pending) and (pending[0] < 0x80 or len(pending) > next(x[4] for x in UTF8_LEADS if x[0] <= pending[0] <= x[1]))


def utf8_feed(pending: bytes, more: bytes) -> tuple[bytes, str]:
    """Characters that ``more`` completes, and the bytes that still wait. A broken character becomes U+FFFD."""
    out = []
    for byte in more:
        after, broken = utf8_step(pending, byte)
        if broken:
            out.append("�")
            if pending:
                after, alone = utf8_step(b"", byte)
                if alone:
                    out.append("�")
        if _whole(after):
            out.append(after.decode())
            after = b""
        pending = after
    return pending, "".join(out)


class _Row(dict):
    """From one UTF-8 state: token to (the next state's row, the text that it completes)."""

    def __init__(self, decoder: Decoder, pending: bytes):
        super().__init__()
        self.decoder, self.pending = decoder, pending

    def __missing__(self, token: int):
        pending, text = utf8_feed(self.pending, self.decoder.bytes_of[token])
        self[token] = found = self.decoder.row(pending), text
        return found


class Decoder:
    """Tokens to text, one token at a time; rows of the joint machine are filled as met."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.rows: dict[bytes, _Row] = {}

    def row(self, pending: bytes) -> _Row:
        if pending not in self.rows:
            self.rows[pending] = _Row(self, pending)
        return self.rows[pending]

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as it is whole; what never becomes whole ends as U+FFFD."""
        row = self.row(b"")
        for token in ids:
            row, text = row[token]
            yield text
        if row.pending:
            yield "�"

    def decode(self, ids: Iterable[int]) -> str:
        row, out = self.row(b""), []
        add = out.append
        for token in ids:
            row, text = row[token]
            add(text)
        if row.pending:
            add("�")
        return "".join(out)


def narrow_pattern(pattern: str) -> str | None:
    """The pattern for Python's own, faster matcher and texts up to U+FFFF; None if it says more than can be put so.

    Classes such as \\p{L} and \\s are written out as the ``regex`` module has them.
    """
    import regex

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x10000))))
    out, inside = [], False
    for part in regex.findall(r"\\[pP]\{\^?\w+\}|\(\?[!:=]|(?s:\\.|.)", pattern):
        if part[0] == "\\" and (part in (r"\s", r"\S") or part[1] in "pP" and len(part) > 2):
            spans: list[list[int]] = []
            for code in map(ord, regex.findall(part, every)):
                if spans and spans[-1][1] == code - 1:
                    spans[-1][1] = code
                else:
                    spans.append([code, code])
            if not spans:
                return None
            written = "".join(rf"\u{a:04x}-\u{b:04x}" for a, b in spans)
            out.append(written if inside else f"[{written}]")
        elif part == "[" and not inside or part == "]" and inside and out[-1] not in ("[", "^"):
            inside = not inside
            out.append(part)
        elif part in ("(?!", "(?:", "(?=") or part.isascii() and (part.isalnum() or part in " '\"`,;:=_/<>@%!|?+*()^"):
            out.append(part)
        else:
            return None
    return "".join(out)


class Encoder:
    """Texts to ids: pieces by a pattern, each through the transducer, frequent ones from memory."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: float = 1.0):
        import regex

        self.transducer, self.most_pieces = Transducer(ranks, memory), int(memory * MOST_PIECES)
        self.wide = regex.compile(pattern).findall
        narrow = narrow_pattern(pattern)
        self.narrow = self.wide if narrow is None else re.compile(narrow).findall
        encode = self.transducer.encode

        class Memory(dict):
            older: dict[str, tuple[int, ...]] = {}

            def __missing__(self, piece: str) -> tuple[int, ...]:
                self[piece] = ids = self.older.get(piece) or encode(piece.encode())
                return ids

        self.new_memory, self.memory = Memory, Memory()

    def pieces(self, text: str) -> list[str]:
        return (self.narrow if text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text) else self.wide)(text)

    def encode(self, text: str) -> list[int]:
        if len(self.memory) > self.most_pieces:  # what was met lately stays, as the older half
            full, self.memory = self.memory, self.new_memory()
            full.older, self.memory.older = {}, full
        return list(chain.from_iterable(map(self.memory.__getitem__, self.pieces(text))))


def worker_encoder(data: bytes, pattern: str, memory: float = 1.0) -> Encoder:
    """One encoder a worker process, kept from task to task."""
    return kept_in_worker(("encoder", hash(data), pattern, memory), lambda: Encoder(read_ranks(data), pattern, memory))


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False, keep: tuple[str, ...] = (), memory: float = 1.0) -> DataFrame:
    """Token ids of every text, and with ``decode`` the text that the ids give back.

    Returns id_col, the columns of ``keep``, ids array<int> and, if asked for,
    decoded string, one row for each row of ``docs``. A null or empty text has no ids. A text is encoded
    whole, whatever its length; time grows with its length only. Repeated rows
    are rows of their own, an empty table gives an empty table, other columns
    are ignored. ``ranks_path`` is read on the driver (a vocabulary file of a
    few hundred KB) and sent to the executors. ``memory`` is the share of the
    usual entries that a worker remembers (some 300 MB of them); less of it costs
    time and changes no id.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    with open(ranks_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder = worker_encoder(shared.value, pattern, memory)
        decoder = Decoder(encoder.transducer.bytes_of)
        for batch in batches:
            flat, ends, texts = [], [0], []
            gc.disable()  # what the machine keeps has no cycles, and is much to look through again and again
            try:
                for text in batch.column(batch.num_columns - 1).to_pylist():
                    ids = encoder.encode(text) if text else []
                    if decode:
                        texts.append(decoder.decode(ids))
                    flat.append(np.array(ids, dtype=np.int32))
                    ends.append(ends[-1] + len(ids))
            finally:
                gc.enable()
            values = np.concatenate(flat) if flat else np.array([], dtype=np.int32)
            columns = [*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))]
            if decode:
                columns.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    own = docs.select(F.col(id_col), *keep, F.col(text_col).cast("string").alias("_whole"))
    names = [id_col, *keep, "ids", *["decoded"] * decode]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema[:-1]) + ", ids array<int>" + ", decoded string" * decode
    return own.mapInArrow(run, schema)


def decode_ids(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Text of each row's ids: id_col, text. Null or no ids give an empty text; an unknown id raises."""
    spark = tokens.sparkSession
    arrow_batches(spark)
    with open(ranks_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches):
        import pyarrow as pa

        decoder = Decoder({rank: token for token, rank in read_ranks(shared.value).items()})
        for batch in batches:
            texts = [decoder.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = tokens.select(id_col).schema[0].dataType.simpleString()
    return tokens.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")


def digests(coded: DataFrame) -> DataFrame:
    """Contract columns of what :func:`encode_texts` returns with ``decode``."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`encode_texts` with the 50k byte-level vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True))
