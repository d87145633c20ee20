"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that can end its encoding.  The table of
these tokens is filled from left to right: a token that ends at a byte is the one if it may follow
the last token of the prefix before it.  Two tokens may stand side by side if no merge across
their border would have come before the merges inside them.  The table gives the encoding from
the back, grows by appending without looking back further than the longest token, and after an
edit is kept up to the edit.

Texts are cut into pieces by a pattern first and every piece is encoded alone; a piece that is a
token is that token.  Null and empty texts have no tokens.  Very long texts are encoded whole, in
stretches.  Repeated rows are encoded each.  Empty tables give no rows.
"""

from __future__ import annotations

import base64
import bisect
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from textvane.llm.common import columns_as

CACHED_PIECES = 250_000
CACHED_PAIRS = 1_000_000
HEAD = 6
#: Unbounded rank, above every token.
NEVER = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank from a file of lines with the token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int], below: int = NEVER) -> list[int]:
    """Plain BPE: join the leftmost pair of least rank until there is none ``below``."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        joined = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        rank = min(joined)
        if rank >= below:
            break
        at = joined.index(rank)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Vocabulary:
    """Tokens, how each was made from two others, and which may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: token -> the two tokens of its last merge; single bytes have none.  Tokens that the
        #: merges below their rank do not lead to are missing: no longer piece contains them.
        self.halves: dict[int, tuple[int, int]] = {}
        self.usable: dict[bytes, int] = {}
        for token, rank in ranks.items():
            if len(token) == 1:
                self.usable[token] = rank
            else:
                parts = merge(token, ranks, rank)
                if len(parts) == 2:
                    self.halves[rank] = parts[0], parts[1]
                    self.usable[token] = rank
        self.pairs: dict[tuple[int, int], bool] = {}

    def may_follow(self, first: int, second: int) -> bool:
        key = first, second
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._border_holds(first, second)
        return found

    def _border_holds(self, left: int, right: int) -> bool:
        """Undo the merges next to the border, latest first; a merge across it must not come earlier.

        ``limit``: rank from which on a merge across the border comes too late.
        """
        tokens, ranks, halves = self.tokens, self.usable, self.halves
        limit = NEVER
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and across < limit:
                return False
            undo_left = left in halves and (right not in halves or left > right)
            if undo_left:  # of equal merges the left one is made first
                limit, left = left, halves[left][1]
            elif right in halves:
                limit, right = right + 1, halves[right][0]
            else:
                return True


def extend(vocabulary: Vocabulary, piece: bytes, last: list[int]) -> list[int]:
    """Fill the table of last tokens from where it ends to the end of ``piece``."""
    token_of, fits, may_follow = vocabulary.usable.get, vocabulary.pairs.get, vocabulary.may_follow
    for end in range(len(last) + 1, len(piece) + 1):
        begin = end
        while True:  # single bytes are tokens, so some token fits
            begin -= 1
            token = token_of(piece[begin:end])
            if token is not None:
                if begin == 0:
                    break
                known = fits((last[begin - 1], token))
                if known or (known is None and may_follow(last[begin - 1], token)):
                    break
        last.append(token)
    return last


def read_back(vocabulary: Vocabulary, piece: bytes, last: list[int]) -> list[int]:
    """The encoding of a piece from its table."""
    whole = vocabulary.ranks.get(piece)
    if whole is not None:
        return [whole]
    ids, at, tokens = [], len(piece), vocabulary.tokens
    while at:
        ids.append(last[at - 1])
        at -= len(tokens[ids[-1]])
    return ids[::-1]


class PrefixTable:
    """The last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary = vocabulary
        self.piece = b""
        self.last: list[int] = []
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Extend the piece; the table so far stays as it is."""
        self.piece += more
        extend(self.vocabulary, self.piece, self.last)

    def replace(self, at: int, new: bytes) -> None:
        """Replace everything from byte ``at``; only what follows is computed again."""
        self.piece = self.piece[:at]
        del self.last[at:]
        self.append(new)

    def encoding(self) -> list[int]:
        return read_back(self.vocabulary, self.piece, self.last)


class Pieces(dict):
    """Piece (text) -> its ids as little-endian 32-bit integers, made when first met."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.heads: dict[bytes, list[int]] = {}  # tables of first bytes, shared by the pieces that begin so

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED_PIECES:
            self.clear()
            self.heads.clear()
        data = piece.encode()
        head = self.heads.get(data[:HEAD])
        if head is None:
            head = self.heads[data[:HEAD]] = extend(self.vocabulary, data[:HEAD], [])
        last = extend(self.vocabulary, data, head.copy())
        ids = read_back(self.vocabulary, data, last)
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            self[piece] = found
        return found


class Stretches(dict):
    """Stretch (text between single spaces, with the space before it) -> ids; most repeat often."""

    def __init__(self, pieces: Pieces, pattern: str):
        super().__init__()
        self.pieces, self.pattern = pieces, regex.compile(pattern)

    def __missing__(self, stretch: str) -> bytes:
        if len(self) >= CACHED_PIECES:
            self.clear()
        found = b"".join([self.pieces[x] for x in self.pattern.findall(stretch)])
        if len(stretch) <= 64:
            self[stretch] = found
        return found


class Codec:
    """Encoder and decoder of whole texts."""

    #: A space between two characters that are not white space: no piece goes across it.
    CUT = regex.compile(r"(?<=\S)(?= \S)")

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(read_ranks(path))
        self.pattern = regex.compile(pattern)
        self.pieces = Pieces(self.vocabulary)
        self.stretches = Stretches(self.pieces, pattern)
        tokens = self.vocabulary.tokens
        self.bytes_of = [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers."""
        text = text or ""
        first, *rest = text.split(" ")
        get = self.stretches.__getitem__
        if "  " not in text and not _space_beside_blank(text):
            return get(first) + b"".join(map(get, [" " + x for x in rest]))
        return b"".join(map(get, self.CUT.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_BESIDE = regex.compile(r"\s |[ ]\s|\A | \Z")


def _space_beside_blank(text: str) -> bool:
    return _BESIDE.search(text) is not None


class EditedText:
    """A text with its pieces' ids, encoded again only near an edit."""

    def __init__(self, codec: Codec, text: str = ""):
        self.codec, self.text = codec, text
        self.starts: list[int] = []
        self.ids: list[bytes] = []
        self._encode(0)

    def _encode(self, at: int, until: dict[int, int] | None = None) -> int | None:
        """Append pieces from ``at`` on; stop at a start in ``until`` and return its number there."""
        for match in self.codec.pattern.finditer(self.text, at):
            if until is not None and match.start() in until:
                return until[match.start()]
            self.starts.append(match.start())
            self.ids.append(self.codec.pieces[match.group()])
        return None

    def edit(self, at: int, gone: int, new: str) -> None:
        """Replace ``gone`` characters at ``at`` by ``new``.

        A piece depends on its own characters and the next two at most, so pieces that end two
        characters before the edit stay; later ones are kept from the first common border on.
        """
        first = max(0, bisect.bisect_right(self.starts, at) - 3)
        shift = len(new) - gone
        later = bisect.bisect_left(self.starts, at + gone)
        tail_starts = [s + shift for s in self.starts[later:]]
        tail_ids = self.ids[later:]
        begin = self.starts[first] if first < len(self.starts) else 0
        self.text = self.text[:at] + new + self.text[at + gone :]
        del self.starts[first:], self.ids[first:]
        met = self._encode(begin, {s: i for i, s in enumerate(tail_starts)})
        if met is not None:
            self.starts += tail_starts[met:]
            self.ids += tail_ids[met:]

    def append(self, more: str) -> None:
        self.edit(len(self.text), 0, more)

    def encoding(self) -> bytes:
        return b"".join(self.ids)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids as little-endian 32-bit binary) of every row."""
    own = columns_as(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_codec = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                ids = [own_codec.encode(x.as_py()) for x in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, ids binary")


def decoded(encodings: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) plus the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_codec = codec(path, pattern)
        for batch in batches:
            data = [own_codec.decode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["doc_id", "ids", "decoded"])

    kind = encodings.schema["doc_id"].dataType.simpleString()
    return encodings.mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")
