"""Encoding with a byte-level BPE vocabulary by dynamic programming over prefixes.

For every byte prefix of a pre-token exactly one token can be the last of its encoding. A table that stores it gives the
encoding of any prefix by walking back, lets bytes be appended without touching what is stored, and after an edit needs
work only from the first changed byte on. A token may follow the stored last token of the shorter prefix if and only if
merging never crosses their seam, which undoing their merges in falling order of rank decides.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the public vocabulary files; a parameter of every function that reads one.
VOCABULARIES = "/opt/tokenizers"
# Fixed value: the published pre-token pattern of byte-level BPE vocabularies of this family; blanks are those of the
# Unicode property, which leaves out the information separators.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRETOKENS = rf" ?\p{{L}}+| ?\p{{N}}+|'(?:[stmd]|re|ve|ll)| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
#: The same pattern for ASCII texts.
PRETOKENS_ASCII = r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
_split, _split_ascii = regex.compile(PRETOKENS).findall, re.compile(PRETOKENS_ASCII).findall
#: Pre-tokens whose encodings a worker keeps; when full, it starts anew.
CACHE_SIZE = 1_000_000
#: Texts encoded before their tokens are handed on.
BATCH = 2_000


class Vocabulary:
    """Token bytes with their ids, ids being merge ranks: every token is a byte or the merge of two smaller ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        #: Every ending of a token: the token's rank, or -1 where the ending is no token itself.
        self.ends = {t[i:]: -1 for t in ranks for i in range(1, len(t))} | ranks
        self.parts = [(0, 0)] * (max(ranks.values()) + 1)
        self.merged: dict[tuple[int, int], int] = {}
        self.seams: dict[tuple[int, int], bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.parts[rank] = (rank, rank)
                continue
            left, right = self._halves(token, rank)
            self.parts[rank] = left, right
            self.merged[left, right] = rank

    @classmethod
    def read(cls, path: str | Path) -> Vocabulary:
        """A file with a token in base64 and its rank on each line."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines()) if a})

    def _halves(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge this token is: merging its bytes with smaller ranks ends there."""
        row = [self.ranks[token[i : i + 1]] for i in range(len(token))]
        while len(row) > 2:
            best = min(((self.merged.get(p, rank), i) for i, p in enumerate(zip(row, row[1:]))))
            if best[0] >= rank:
                raise ValueError(f"token {rank} is no merge of two smaller tokens")
            row[best[1] : best[1] + 2] = [best[0]]
        return row[0], row[1]

    def adjoin(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together."""
        known = self.seams.get((left, right))
        if known is None:
            known = self.seams[left, right] = self._adjoin(left, right)
        return known

    def _adjoin(self, a: int, b: int) -> bool:
        bound = len(self.parts)  # merges across the seam count only below the rank of the last merge undone
        while True:
            if self.merged.get((a, b), bound) < bound:
                return False
            inner, outer = self.parts[a][1], self.parts[b][0]
            can_a, can_b = inner != a, outer != b
            if not (can_a or can_b):
                return True
            if can_a and (a > b or not can_b):
                a, bound = inner, a
            else:
                b, bound = outer, b + 1


class PrefixTable:
    """The last token of every byte prefix of one pre-token."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extend by bytes; what is stored stays exact."""
        v, last = self.v, self.last
        self.data = data = self.data + more
        ends, seams = v.ends, v.seams
        for end in range(len(last) + 1, len(data) + 1):
            start = end - 1
            while (token := ends.get(data[start:end])) is not None:
                if token >= 0:
                    if start == 0:
                        break
                    pair = last[start - 1], token
                    if (ok := seams.get(pair)) is None:
                        ok = v.adjoin(*pair)
                    if ok:
                        break
                start -= 1
                if start < 0:
                    token = None
                    break
            if token is None:
                raise ValueError("the vocabulary lacks a byte")
            last.append(token)

    def splice(self, start: int, end: int, new: bytes) -> None:
        """Replace bytes; only prefixes beyond ``start`` are computed anew."""
        data = self.data
        self.data = data[:start]
        del self.last[start:]
        self.append(new + data[end:])

    def tokens(self, upto: int | None = None) -> list[int]:
        """The encoding of the first ``upto`` bytes (all if None)."""
        at, out = len(self.last) if upto is None else upto, []
        while at:
            out.append(token := self.last[at - 1])
            at -= self.length(token)
        return out[::-1]

    def length(self, token: int) -> int:
        return lengths(self.v)[token]


def lengths(v: Vocabulary) -> list[int]:
    if not hasattr(v, "_lengths"):
        v._lengths = [0] * len(v.parts)
        for t, r in v.ranks.items():
            v._lengths[r] = len(t)
    return v._lengths


class Encodings(dict):
    """Encodings of pre-tokens; ``learn`` those of a batch before looking them up."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary

    def learn(self, pieces: set[str]) -> None:
        """Pre-tokens not known yet, in byte order: a table keeps the prefix it shares with the one before."""
        if len(self) + len(pieces) > CACHE_SIZE:
            self.clear()
        table = PrefixTable(self.v)
        for data, piece in sorted((p.encode("utf-8", "surrogatepass"), p) for p in pieces.difference(self)):
            whole = self.v.ranks.get(data)
            if whole is not None:
                self[piece] = (whole,)
                continue
            shared = len(os.path.commonprefix((table.data, data)))
            table.splice(shared, len(table.data), data[shared:])
            self[piece] = tuple(table.tokens())


@lru_cache(maxsize=4)
def encodings(path: str) -> Encodings:
    return Encodings(Vocabulary.read(path))


def pretokens(text: str | None) -> list[str]:
    return (_split_ascii if text.isascii() else _split)(text) if text else []


def encode_batch(texts: list[str | None], path: str) -> list[tuple[int, ...]]:
    """Token ids of texts, without special tokens; empty for null and empty texts."""
    table, rows = encodings(path), [pretokens(t) for t in texts]
    table.learn(set(chain.from_iterable(rows)))
    return [tuple(chain.from_iterable(map(table.__getitem__, r))) for r in rows]


def encode(text: str | None, path: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken") -> list[int]:
    return list(encode_batch([text], path)[0])


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(id column, ids): one row for each row, with the token ids of its whole text as a list that is never null.

    Null and empty texts have an empty list, repeated rows come out repeated; strings that look like special tokens are
    plain text. The vocabulary is read by each Python worker once.
    """
    path = f"{folder}/{vocabulary}.tiktoken"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                rows = encode_batch(part.column(1).to_pylist(), path)
                ends = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(r) for r in rows], out=ends[1:])
                flat = np.fromiter(chain.from_iterable(rows), np.int32, ends[-1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
