"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece the encoding is unique, and so is its last token. The table `last[i]` of a piece stores
that token for the prefix of i bytes: it is the only token t ending at i for which the token before it, last[i - len(t)],
and t stay two tokens when encoded together. A piece's encoding is read backwards through the table. An append extends the
table; an edit keeps the entries before it.

Spark runs the table over the pieces of each batch of texts; every executor process keeps the pieces it has met, up to a
bound, after which it starts anew.

Null text counts as empty: no tokens, digests of the empty string. Repeated rows and repeated or null doc_ids give one row
each. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import sys
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sovara.llm.common import doc_text, text_chunks

#: Pieces that one executor process remembers before it starts anew.
CACHE_PIECES = 500_000
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class PrefixTable:
    """Encodings of all prefixes of a growing byte string."""

    def __init__(self, coder: PrefixCoder):
        self.coder, self.data, self.last = coder, b"", [-1]

    def append(self, more: bytes) -> None:
        start, self.data = len(self.data), self.data + more
        self.coder.extend(self.data, self.last, start)

    def edit(self, at: int, removed: int, put: bytes) -> None:
        """Replaces `removed` bytes at `at`; prefixes up to `at` keep their entries."""
        tail = self.data[at + removed :]
        self.data, self.last = self.data[:at], self.last[: at + 1]
        self.append(put + tail)

    def ids(self, end: int | None = None) -> list[int]:
        return self.coder.walk(self.last, len(self.data) if end is None else end)


class PrefixCoder:
    """Ranks, how each token is made of two others, and which neighbours may stand together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {r: t for t, r in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.longest = max(map(len, ranks))
        self.made: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        #: every ending of a token: the token that it is, if merges reach it, else -1
        self.endings = dict.fromkeys((t[-k:] for t in ranks for k in range(1, len(t))), -1)
        self.endings |= {t: r if self.reachable(r) else -1 for t, r in ranks.items()}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte or a token that no merges reach."""
        if token not in self.halves:
            data = self.bytes_of[token]
            parts = [self.ranks[data[i : i + 1]] for i in range(len(data))]
            while len(parts) > 2:
                pairs = [(self.ranks.get(self.bytes_of[a] + self.bytes_of[b], sys.maxsize), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
                rank, i = min(pairs)
                if rank >= token:
                    break
                parts[i : i + 2] = [rank]
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
            self.made[token] = len(parts) <= 2
        return self.halves[token]

    def reachable(self, token: int) -> bool:
        self.split(token)
        return self.made[token]

    def apart(self, left: int, right: int) -> bool:
        """Whether left followed by right stays so: no merge across the border comes before the merges that made them."""
        limit = sys.maxsize
        while True:
            joint = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joint is not None and joint < limit:
                return False
            # undo the later of the two last merges and look across the border again
            if left > right:
                halves = self.split(left)
                if halves is None:
                    halves = self.split(right)
                    if halves is None:
                        return True
                    limit, right = right + 1, halves[0]
                else:
                    limit, left = left, halves[1]
            else:
                halves = self.split(right)
                if halves is None:
                    halves = self.split(left)
                    if halves is None:
                        return True
                    limit, left = left, halves[1]
                else:
                    limit, right = right + 1, halves[0]

    def extend(self, data: bytes, last: list[int], start: int) -> None:
        """Entries for the prefixes longer than `start`. The longest endings are tried first; the valid one is unique."""
        endings, apart, known = self.endings, self.apart, self.pairs
        for end in range(start + 1, len(data) + 1):
            fits = []
            for begin in range(end - 1, max(-1, end - self.longest - 1), -1):
                token = endings.get(data[begin:end])
                if token is None:
                    break
                if token >= 0:
                    fits.append((begin, token))
            for begin, token in reversed(fits):
                if begin == 0:
                    break
                key = last[begin] << 20 | token
                if (ok := known.get(key)) is None:
                    if len(known) > 1 << 20:
                        known.clear()
                    ok = known[key] = apart(last[begin], token)
                if ok:
                    break
            last.append(token)

    def walk(self, last: list[int], end: int) -> list[int]:
        out = []
        while end:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        table = PrefixTable(self)
        table.append(data)
        return table.ids()


@lru_cache(4)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Splits as the pattern does, with its letter, number and space classes written out for the plain `re` module.

    Classes within the basic plane are far faster there, so only texts with characters beyond it take the full classes.
    """

    def spelled(top: int) -> re.Pattern:
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, top))))
        spell = lambda name: "".join(f"\\U{ord(m[0][0]):08x}-\\U{ord(m[0][-1]):08x}" for m in regex.finditer(f"{name}+", every))
        letters, numbers, spaces = spell(r"\p{L}"), spell(r"\p{N}"), spell(r"\p{White_Space}")
        out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
        for name, put in ((r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\S", f"[^{spaces}]"), (r"\s", f"[{spaces}]")):
            out = out.replace(name, put)
        return re.compile(out)

    basic, full = spelled(0x10000), spelled(sys.maxunicode + 1)
    return lambda text: (basic if len(text.encode("utf-16-le")) == 2 * len(text) else full).findall(text)


@lru_cache(2)
def _coder(path: str) -> PrefixCoder:
    return PrefixCoder(load_ranks(path))


def encode_text(coder: PrefixCoder, split: Callable[[str], list[str]], text: str) -> list[int]:
    return [i for piece in split(text) for i in coder.encode_piece(piece.encode())]


def fill(known: dict[str, tuple[str, int, bytes]], coder: PrefixCoder, pieces: set[str]) -> None:
    """Puts (ids joined by commas, number of ids, decoded bytes) of the pieces into `known`.

    They are taken in byte order through one prefix table, so a piece only adds what follows the prefix that it shares
    with the piece before it.
    """
    table, names = PrefixTable(coder), coder.bytes_of
    for data in sorted(x.encode() for x in pieces):
        if (whole := coder.ranks.get(data)) is not None:
            ids = [whole]
        else:
            shared = len(os.path.commonprefix((table.data, data)))
            table.edit(shared, len(table.data) - shared, data[shared:])
            ids = table.ids()
        known[data.decode()] = ",".join(map(str, ids)), len(ids), b"".join([names[i] for i in ids])


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes. ranks_path must be readable on every executor."""

    def run(batches):
        coder, split, known = _coder(ranks_path), splitter(pattern), {}
        for batch in text_chunks(batches):
            count, ids, decoded, size = [], [], [], []
            texts = [split(text or "") for text in batch.column("text").to_pylist()]
            if len(known) > CACHE_PIECES:
                known.clear()
            fill(known, coder, set().union(*texts).difference(known))
            for pieces in texts:
                joined, n, raw = zip(*[known[p] for p in pieces], strict=True) if pieces else ((), (), ())
                raw = b"".join(raw)
                count.append(sum(n))
                ids.append(hashlib.sha256(",".join(joined).encode()).hexdigest())
                decoded.append(hashlib.sha256(raw).hexdigest())
                size.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(size, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    return doc_text(docs).mapInArrow(run, SCHEMA)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per row: doc_id and its token ids."""

    def run(batches):
        coder, split = _coder(ranks_path), splitter(pattern)
        for batch in text_chunks(batches):
            ids = [encode_text(coder, split, text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return doc_text(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """Per row of (doc_id, ids): doc_id and the bytes that the ids stand for; null ids count as none."""

    def run(batches):
        table = _coder(ranks_path).bytes_of
        for batch in batches:
            out = [b"".join([table[i] for i in ids or ()]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, decoded binary")
