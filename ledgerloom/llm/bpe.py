"""Byte-pair encoding of whole collections by backtracking.

A rank file gives every token's bytes and id; its merges are implied. Two neighbouring tokens can only stand in
an encoding if no merge across their border would have come before the merges that made them; that is the
pair test. The encoder walks over a piece, takes the longest token that an Aho-Corasick automaton found at
the position, and accepts it if it is compatible with the token before; else it tries the next shorter token,
and when none is left it gives up the token before and marks the position as unreachable. Each position is marked at
most once, so the work is linear in the piece's length for a bounded token length, and the result equals that
of applying the merges in order. Decoding slices one byte string by an offset table.

Texts are first cut into pieces by the vocabulary's pattern. Pieces repeat, so each worker keeps the ids of the pieces
it met lately, up to a fixed number; this changes the speed, not the result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The pattern that cuts texts into pieces before the merges of the 50k vocabularies (a fixed value of theirs).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces that a worker remembers.
REMEMBERED = 200_000


class BytePairEncoder:
    """Encoder and decoder of one rank file (lines of base64 bytes and id)."""

    def __init__(self, rank_file: str, pattern: str = PIECES):
        with open(rank_file, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ids = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.pieces = regex.compile(pattern)
        size = max(self.ids.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ids.items():
            tokens[rank] = token
        self.tokens = tokens
        self.blob = b"".join(tokens)
        self.offsets = [0] * (size + 1)
        for i, token in enumerate(tokens):
            self.offsets[i + 1] = self.offsets[i] + len(token)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for token, rank in self.ids.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self._learn_merges()
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}

    def _learn_merges(self) -> None:
        """self.halves[t]: the two tokens merged into t, (t, t) for a single byte; self.merged[(a, b)]: the token of that merge;
        self.shorter[t]: the longest token that is a proper prefix of t, or -1."""
        size = len(self.tokens)
        self.halves = [(i, i) for i in range(size)]
        self.merged: dict[tuple[int, int], int] = {}
        self.shorter = [-1] * size
        for token, rank in sorted(self.ids.items(), key=lambda entry: entry[1]):
            for cut in range(len(token) - 1, 0, -1):
                left = self.ids.get(token[:cut])
                if left is None:
                    continue
                if self.shorter[rank] < 0:
                    self.shorter[rank] = left
                right = self.ids.get(token[cut:])
                if right is not None and left < rank and right < rank and self.compatible(left, right):
                    self.halves[rank] = (left, right)
                    self.merged[(left, right)] = rank
                    break

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave `left` and `right` standing side by side: walking down both sides of the border, the merge
        across it must never come before the merge that made the side last descended."""
        merged, halves = self.merged, self.halves
        limit = len(self.tokens)
        while True:
            across = merged.get((left, right))
            if across is not None and across < limit:
                return False
            if left > right:
                # the left side was made last: undo its merge
                limit, inner = left, halves[left][1]
                if inner == left:
                    limit, inner = right + 1, halves[right][0]
                    if inner == right:
                        return True
                    right = inner
                else:
                    left = inner
            else:
                limit, inner = right + 1, halves[right][0]
                if inner == right:
                    limit, inner = left, halves[left][1]
                    if inner == left:
                        return True
                    left = inner
                else:
                    right = inner

    def stand_together(self, left: int, right: int) -> bool:
        """compatible() from a table of the pairs met so far."""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            found = self.pairs[key] = self.compatible(left, right)
        return found

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8")
        whole = self.ids.get(data)
        if whole is not None:
            return (whole,)
        n = len(data)
        longest = [-1] * n
        for end, (length, rank) in self.automaton.iter(data.decode("latin-1")):
            longest[end - length + 1] = rank  # later matches at a start are longer
        tokens, shorter, compatible = self.tokens, self.shorter, self.stand_together
        reachable = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + len(tokens[token])
                if reachable[end] and (not out or compatible(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                reachable[at] = 0
                last = out.pop()
                at -= len(tokens[last])
                token = shorter[last]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or empty one."""
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for piece in self.pieces.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(known) >= REMEMBERED:
                    known.clear()
                known[piece] = ids
            out.extend(ids)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; what encode() gave comes back exactly."""
        blob, offsets = self.blob, self.offsets
        return b"".join(blob[offsets[i] : offsets[i + 1]] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(rank_file: str) -> BytePairEncoder:
    """The encoder of a rank file, made once in each worker process."""
    return BytePairEncoder(rank_file)


def default_rank_file() -> str:
    """The installed byte_bpe_50k vocabulary."""
    return "/opt/tokenizers/byte_bpe_50k.tiktoken"


def encode_documents(docs: DataFrame, rank_file: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids): the ids of every row's text, in one pass without a shuffle.

    Null and empty texts get an empty list; blank ones are encoded as they are. Rows with the same id or text stay rows of
    their own; a null id stays null. Other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(rank_file).encode
        for batch in batches:
            ids = [encode(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_column, "ids"])

    own = docs.select(id_column, text_column)
    return own.mapInArrow(run, f"`{id_column}` {own.schema[0].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, rank_file: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, text) of encode_documents(); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(rank_file).decode
        for batch in batches:
            texts = [decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    own = encoded.select(id_column, ids_column)
    return own.mapInArrow(run, f"`{id_column}` {own.schema[0].dataType.simpleString()}, text string")


def count_tokens(docs: DataFrame, rank_file: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens) of every row, without building the lists of ids in the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(rank_file).encode
        for batch in batches:
            sizes = [len(encode(text)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[id_column, "n_tokens"])

    own = docs.select(id_column, text_column)
    return own.mapInArrow(run, f"`{id_column}` {own.schema[0].dataType.simpleString()}, n_tokens bigint")
