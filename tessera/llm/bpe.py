"""Byte-level BPE by dynamic programming over prefixes.

For every byte prefix of a piece there is exactly one last token that its BPE encoding can end in: a token is
valid there if it may follow the last token of the prefix before it, that is, if the two tokens' bytes together
encode to just these two. The last tokens of all prefixes are stored, so that appending bytes only computes the
new prefixes, and an edit only those from its start on; walking back from the end gives the ids.

Texts are cut by the vocabulary's pattern first; each match is a piece. Null texts count as empty ones. Any
vocabulary whose ranks are its merge order will do.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import ChunkCoder, map_texts, table


class PrefixBpe:
    """Encodes pieces by the ranks of a byte-level vocabulary."""

    def __init__(self, ranks: dict[bytes, int], remembered: int = 1_000_000):
        self.ranks, self.remembered = ranks, remembered
        self.bytes_of = {i: b for b, i in ranks.items()}
        #: The token, or -1 for what is only the end of tokens.
        self.ending = dict.fromkeys((b[i:] for b in ranks for i in range(1, len(b))), -1) | ranks
        self._fits: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Plain BPE: join the adjacent pair of lowest rank, leftmost first, until none is in the vocabulary."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def whole(self, token: int) -> bool:
        """Do the token's own bytes encode to it?"""
        if (known := self._whole.get(token)) is None:
            known = self._whole[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def fits(self, left: int, right: int) -> bool:
        """May `right` follow `left`?"""
        if (known := self._fits.get(left << 32 | right)) is None:
            if len(self._fits) > self.remembered:
                self._fits.clear()
            known = self._fits[left << 32 | right] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def extend(self, piece: bytes, last: list[int]) -> None:
        """last[i] is the last token of piece[:i] (last[0]: -1); computes what is missing up to the piece's end."""
        ending, known = self.ending.get, self._fits.get
        for end in range(len(last), len(piece) + 1):
            found = -2
            for start in range(end - 1, -1, -1):
                token = ending(piece[start:end])
                if token is None:  # nor does any longer token end here
                    break
                if token < 0:
                    continue
                before = last[start]
                if start == 0:
                    if self.whole(token):
                        found = token
                elif before >= 0:
                    fit = known(before << 32 | token)
                    if self.fits(before, token) if fit is None else fit:
                        found = token
                        break
            last.append(found)

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is itself a token is that token."""
        token = self.ranks.get(piece)
        if token is not None:
            return [token]
        last = [-1]
        self.extend(piece, last)
        return self.walk(piece, last)

    def encode_sorted(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Ids of each of the sorted pieces; the prefixes that a piece shares with the one before keep their tokens."""
        before, last = b"", [-1]
        for piece in pieces:
            if (token := self.ranks.get(piece)) is not None:
                yield [token]
                continue
            shared = 0
            for a, b in zip(before, piece):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            self.extend(piece, last)
            before = piece
            yield self.walk(piece, last)

    def walk(self, piece: bytes, last: list[int]) -> list[int]:
        out, at = [], len(piece)
        while at > 0:
            if last[at] < 0:
                raise ValueError("a byte is not in the vocabulary")
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class EditablePiece:
    """A piece with the last tokens of its prefixes, for exact appends and re-encoding from an edit on."""

    def __init__(self, bpe: PrefixBpe, piece: bytes = b""):
        self.bpe, self.piece, self.last = bpe, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.bpe.extend(self.piece, self.last)

    def replace(self, start: int, end: int, by: bytes) -> None:
        """Prefixes that end at or before `start` keep their tokens."""
        self.piece = self.piece[:start] + by + self.piece[end:]
        del self.last[start + 1 :]
        self.bpe.extend(self.piece, self.last)

    def ids(self) -> list[int]:
        token = self.bpe.ranks.get(self.piece)
        return [token] if token is not None else self.bpe.walk(self.piece, self.last)


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines `base64 rank`, readable on every machine."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_coders: dict[tuple[str, str], tuple] = {}


def coder(path: str, pattern: str) -> tuple[PrefixBpe, ChunkCoder]:
    """The vocabulary's encoder, loaded once in each worker process."""
    if (path, pattern) not in _coders:
        import regex

        bpe, find = PrefixBpe(read_ranks(path)), regex.compile(pattern).findall

        known: dict[str, bytes] = {}

        def encode_many(chunks: list[str]) -> list[bytes]:
            if len(known) > 400_000:
                known.clear()
            cut = [find(c) for c in chunks]
            new = sorted({m.encode() for m in chain.from_iterable(cut) if m not in known})
            own = {p.decode(): struct.pack(f"<{len(ids)}I", *ids) for p, ids in zip(new, bpe.encode_sorted(new))}
            known.update(own)
            out = [known[c[0]] if len(c) == 1 else b"".join(map(known.__getitem__, c)) for c in cut]
            for m in own:
                if len(m) > 64:
                    del known[m]
            return out

        _coders[path, pattern] = bpe, ChunkCoder(encode_many)
    return _coders[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids (array of int) of every text."""

    def run(texts: list) -> list:
        codes = [np.frombuffer(c, "<u4") for c in coder(path, pattern)[1].encode([t or "" for t in texts])]
        return [[len(c) for c in codes], codes]

    return map_texts(docs, ["doc_id"], run, "n_tokens long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes that its ids stand for; null ids give null."""
    from pyspark.sql import functions as F

    @F.pandas_udf("binary")
    def decoded(ids):
        bpe = coder(path, pattern)[0]
        return ids.map(lambda x: None if x is None else bpe.decode(list(x)))

    return encoded.select("doc_id", decoded("ids").alias("bytes"))


def digest_bpe(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every text, decode its ids, and return digests of both; ids never leave the task that made them."""

    def run(texts: list) -> list:
        bpe, chunk_coder = coder(path, pattern)
        names = {i: str(i) for i in bpe.bytes_of}
        n, ids_sha, text_sha = [], [], []
        for code in chunk_coder.encode([t or "" for t in texts]):
            ids = np.frombuffer(code, "<u4").tolist()
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return [n, ids_sha, text_sha]

    return map_texts(docs, ["doc_id"], run, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_bpe(table(spark, sf_dir, "documents"), *default_vocabulary())
