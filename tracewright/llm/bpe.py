"""Byte-level BPE by prefix dynamic programming: encoding, decoding, exact appends and edits.

For each byte prefix of a piece there is exactly one token that can end its encoding. With that
token stored for every prefix, a prefix's encoding is read by walking back from its end, a byte
more costs one step (append), and a change re-does only the steps near it (edit).

Why one token: merging picks the pair of the lowest rank, the leftmost of equals, and merges inside
the span of a final token don't depend on what lies outside. So a sequence of tokens is the encoding
of its bytes if and only if each two neighbours are the encoding of theirs. Hence the last token of
a prefix is the one token t that ends there, for which the pair (last token of the prefix without
t, t) encodes to itself.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import numpy as np
from pyspark.sql import DataFrame

from .common import TwoAges, byte_runs, held, pick, small_batches, tidy


HEAD = 6
#: What a worker keeps, in bytes: whether pairs of tokens stand, prefixes of pieces, pieces and words with their ids.
PAIR_BYTES, HEAD_BYTES, PIECE_BYTES, FIRST_BYTES, WORD_BYTES = 32 << 20, 24 << 20, 16 << 20, 8 << 20, 80 << 20


class Vocabulary:
    """Ranks of byte strings; a rank is also the token's id. Needs all 256 single bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        #: By three last bytes that are a token: 3, 2 if the last two are one, and 1. By four, with which a token ends: the lengths of such tokens, longest first, then these.
        short = lambda data: tuple(n for n in (3, 2, 1) if data[-n:] in ranks)
        self.ends = {data: short(data) for data in ranks if len(data) == 3}
        long: dict[bytes, set[int]] = {}
        for data in ranks:
            if len(data) > 3:
                long.setdefault(data[-4:], set()).add(len(data))
        self.long_ends = {k: (*sorted(v, reverse=True), *short(k)) for k, v in long.items()}
        self.token: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for data, rank in ranks.items():
            self.token[rank] = data
        #: Tokens that merging makes from their own bytes; others occur as a whole piece only.
        self._own = TwoAges(lambda t: self.merge(self.token[t]) == [t], 16 << 20)
        self._pair = TwoAges(lambda p: self.merge(self.token[p >> 32] + self.token[p & 0xFFFFFFFF]) == [p >> 32, p & 0xFFFFFFFF], PAIR_BYTES, 90)
        #: Last tokens of the prefixes of a piece's first HEAD bytes, which many pieces share.
        self._heads = TwoAges(self._head, HEAD_BYTES)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Of a rank file: on each line a token in base64 and its rank."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def merge(self, data: bytes) -> list[int]:
        """The definition: merge the lowest-ranked neighbours until none are left. For two tokens' bytes only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def extend(self, data: bytes, last: list[int], upto: int) -> None:
        """Append the last tokens of the prefixes of lengths len(last) to `upto`; last[0] stands for the empty one."""
        ranks, pair, own, ends, long_ends = self.ranks.get, self._pair, self._own, self.ends.get, self.long_ends.get
        for end in range(len(last), upto + 1):
            for size in (end > 3 and long_ends(data[end - 4 : end])) or (ends(data[end - 3 : end], (2, 1)) if end > 2 else (end, 1)):
                if size <= end:
                    start = end - size
                    t = ranks(data[start:end])
                    if t is not None and (pair[last[start] << 32 | t] if start else own[t]):
                        last.append(t)
                        break
            else:
                raise ValueError(f"no token for byte {data[end - 1]}")

    def read_back(self, last: list[int]) -> list[int]:
        """The encoding of the whole prefix that `last` covers."""
        out, end = [], len(last) - 1
        while end > 0:
            t = last[end]
            out.append(t)
            end -= len(self.token[t])
        return out[::-1]

    def _head(self, data: bytes) -> list[int]:
        last = self._heads[data[:-HEAD]].copy() if len(data) > HEAD else [-1]
        self.extend(data, last, len(data))
        return last

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        size = len(data)
        shared = min(size - 1, 2 * HEAD) // HEAD * HEAD
        last = self._heads[data[:shared]].copy() if shared else [-1]
        self.extend(data, last, size)
        return self.read_back(last)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class PieceBuffer:
    """A piece that grows and changes, with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, data, [-1]
        self.steps = 0
        self._run(len(data))

    def _run(self, upto: int) -> None:
        self.steps += upto + 1 - len(self.last)
        self.v.extend(self.data, self.last, upto)

    def append(self, data: bytes) -> None:
        self.data += data
        self._run(len(self.data))

    def edit(self, start: int, end: int, data: bytes) -> None:
        """Replace the bytes from start to end.

        Prefixes up to start keep their tokens. Behind the change, a step depends on the bytes and
        the last tokens of the `longest` places before it, so once that many agree with the old ones
        in a row, all later ones do.
        """
        old, tail = self.last, len(self.data) - end
        self.data = self.data[:start] + data + self.data[end:]
        self.last = old[: start + 1]
        same, size, shift = 0, len(self.data), len(old) - 1 - len(self.data)
        while len(self.last) <= size:
            if same >= self.v.longest:
                self.last += old[len(self.last) + shift :]
                break
            self._run(len(self.last))
            at = len(self.last) - 1
            same = same + 1 if at > size - tail and self.last[at] == old[at + shift] else 0

    def ids(self) -> list[int]:
        whole = self.v.ranks.get(self.data)
        return [whole] if whole is not None else self.v.read_back(self.last)


class Tokenizer:
    """Splits a text into the matches of a pattern and encodes each on its own."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.v = Vocabulary.load(path)
        self.split = regex.compile(pattern).findall
        self._match = regex.compile(pattern).match
        self._piece = TwoAges(self._ids, PIECE_BYTES)
        self._first = TwoAges(self._split, FIRST_BYTES)
        self._rest = TwoAges(self._word, WORD_BYTES)
        self._line_end = self._split("\n")
        self._double = re.compile(r"\s\s").search

    def _split(self, text: str) -> bytes:
        return b"".join(map(self._piece.__getitem__, self.split(text)))

    def _ids(self, piece: str) -> bytes:
        ids = self.v.encode_piece(piece.encode("utf-8"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, s: str) -> bytes:
        """A word behind a space. One that is a single piece is kept as a word alone."""
        pieces = self.split(" " + s)
        return self._ids(pieces[0]) if len(pieces) == 1 else b"".join(map(self._piece.__getitem__, pieces))

    def packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        Where no two white-space characters adjoin, a match of the pattern always ends before a
        space and on both sides of a line end, so words are encoded on their own and kept.
        """
        if self._double(text):
            return self._split(text)
        first, rest, out = self._first, self._rest.__getitem__, []
        for line in text.split("\n"):
            head, *words = line.split(" ")
            out.append(b"".join([first[head], *map(rest, words)]))
        return self._line_end.join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return self.v.decode(ids)


class TextBuffer:
    """A text under edits: only the pieces near a change are split and encoded anew.

    What the pattern matches at a place depends on the text from there on, and on one character
    past the match at most. So pieces that end before the change stay, and as soon as a new piece
    starts where an old one did behind the change, the rest stays too.
    """

    def __init__(self, tokenizer: Tokenizer, text: str = ""):
        self.t, self.text, self.steps = tokenizer, "", 0
        self.pieces: list[tuple[int, int, list[int]]] = []
        self.edit(0, 0, text)

    def append(self, text: str) -> None:
        self.edit(len(self.text), len(self.text), text)

    def edit(self, start: int, end: int, text: str) -> None:
        shift = len(text) - (end - start)
        self.text = self.text[:start] + text + self.text[end:]
        keep = 0
        while keep < len(self.pieces) and self.pieces[keep][1] < start:
            keep += 1
        rest = {a + shift: k for k, (a, _, _) in enumerate(self.pieces) if a >= end}
        new = self.pieces[:keep]
        at = new[-1][1] if new else 0
        while at < len(self.text):
            if at in rest and at >= start + len(text):
                new += [(a + shift, b + shift, ids) for a, b, ids in self.pieces[rest[at] :]]
                break
            m = self.t._match(self.text, at)
            self.steps += 1
            if m is None:  # the pattern leaves this character out, as findall would
                at += 1
                continue
            new.append((m.start(), m.end(), self.t.v.encode_piece(m.group().encode("utf-8"))))
            at = m.end()
        self.pieces = new

    def ids(self) -> list[int]:
        return [i for _, _, ids in self.pieces for i in ids]


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One for each worker process; its caches outlive a task and are bounded."""
    return held(("bpe", path, pattern), lambda: Tokenizer(path, pattern))


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again; one row for each row of docs, no shuffle.

    Returns id_col, n_tokens long, ids_sha256 (of ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (of the decoded bytes) and round_trip boolean (decoded bytes equal the text's);
    with_ids adds ids array<int>. Null text: as the empty text, no tokens. Very long texts are encoded
    whole; a worker holds one at a time besides its caches. Null ids, repeated rows and empty tables
    pass through. Other columns of docs are not read.
    """
    small_batches(docs.sparkSession)
    schema = "id {}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean".format(dict(docs.dtypes)[id_col])
    schema += ", ids array<int>" if with_ids else ""

    def run(batches):
        import pyarrow as pa

        tok = tokenizer(path, pattern)
        token = tok.v.token.__getitem__
        for batch in batches:
            n, ids_hex, text_hex, same, lists = [], [], [], [], []
            for _, texts in byte_runs(batch.column(1)):
                for data in texts:
                    data = data or b""
                    packed = tok.packed(data.decode("utf-8"))
                    ids = np.frombuffer(packed, "<u4")
                    back = b"".join(map(token, ids.tolist()))
                    n.append(len(ids))
                    ids_hex.append(hashlib.sha256(packed).hexdigest())
                    text_hex.append(hashlib.sha256(back).hexdigest())
                    same.append(back == data)
                    if with_ids:
                        lists.append(ids.astype("int32"))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string()), pa.array(same, pa.bool_())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
            if with_ids:
                cols.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return pick(docs, id_col, text_col).mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
