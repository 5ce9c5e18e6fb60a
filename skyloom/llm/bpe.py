"""Byte-level BPE encoding and decoding as a monoid: halves are encoded and joined up a tree."""

from __future__ import annotations

import base64
from collections.abc import Sequence
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.arrow import Recent, map_rows
from skyloom.llm.common import col, fresh, others, read_table

#: Unicode white space. No match of the tokenizer's pattern goes on from another character into it.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: Above every rank.
NONE = 1 << 62
#: Parts up to this many bytes are the leaves of the tree.
LEAF = 8


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 token and rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain BPE: join the neighbours of the lowest rank, the leftmost first, until none can be joined."""
    if len(piece) > 48:
        return _merge_long(piece, ranks)
    get = ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    found = [get(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
    while found and (best := min(found)) != NONE:
        i = found.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del found[i]
        if i < len(found):
            found[i] = get(parts[i] + parts[i + 1], NONE)
        if i:
            found[i - 1] = get(parts[i - 1] + parts[i], NONE)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of candidate pairs over a linked list, for long windows."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, at, to = heappop(heap)
        middle = end[at]
        if middle == 0 or middle >= n or end[middle] != to:
            continue  # one of the two has been joined with another meanwhile
        end[at], end[middle] = to, 0
        if to < n:
            before[to] = at
            if (rank := ranks.get(piece[at : end[to]])) is not None:
                heappush(heap, (rank, at, end[to]))
        if (prior := before[at]) >= 0 and (rank := ranks.get(piece[prior:to])) is not None:
            heappush(heap, (rank, prior, to))
    found, at = [], 0
    while at < n:
        found.append(ranks[piece[at : end[at]]])
        at = end[at]
    return found


class TreeEncoder:
    """Encodes pieces by halves.

    A token sequence is the encoding of its bytes exactly when each token encodes to itself and each two
    neighbours encode to themselves. So two encoded halves are joined by re-encoding a window about the
    boundary, which grows on a side until the window's outer token and its neighbour there are such a
    pair: then nothing outside can change any more.
    """

    def __init__(self, ranks: dict[bytes, int], limit: int = 250_000):
        self.ranks = ranks
        self.bytes = {i: token for token, i in ranks.items()}
        #: Tokens that merging never makes; a piece that equals one is that token, a part of a piece is not.
        self.whole_only = {i for token, i in ranks.items() if len(token) > 1 and merge(token, ranks) != [i]}
        self.pairs = Recent(self._pair, limit)
        self.parts = Recent(self._halves, limit)

    def _pair(self, key: tuple[int, int]) -> bool:
        both = self.bytes[key[0]] + self.bytes[key[1]]
        return both not in self.ranks and merge(both, self.ranks) == list(key)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of ``left`` and ``right`` together."""
        if not left or not right:
            return left or right
        if self.pairs[left[-1], right[0]]:
            return left + right
        a = b = 1
        while True:
            window = merge(b"".join(map(self.bytes.__getitem__, left[-a:] + right[:b])), self.ranks)
            left_holds = a == len(left) or self.pairs[left[-a - 1], window[0]]
            right_holds = b == len(right) or self.pairs[window[-1], right[b]]
            if left_holds and right_holds:
                return left[:-a] + window + right[b:]
            a = a if left_holds else min(2 * a, len(left))
            b = b if right_holds else min(2 * b, len(right))

    def _halves(self, part: bytes) -> list[int]:
        known = self.ranks.get(part)
        if known is not None and known not in self.whole_only:
            return [known]
        if len(part) <= LEAF:
            return merge(part, self.ranks)
        middle = len(part) // 2
        if len(part) > 64:
            return self.join(self._halves(part[:middle]), self._halves(part[middle:]))
        return self.join(self.parts[part[:middle]], self.parts[part[middle:]])

    def encode(self, piece: bytes) -> list[int]:
        known = self.ranks.get(piece)
        return [known] if known is not None else self._halves(piece) if piece else []


class TextEncoder:
    """Texts to ids as little-endian unsigned 32-bit integers, and back.

    A text is cut before white space that follows another character. The pattern's matches never
    reach over such a cut, so the ids of the parts, each encoded alone, are concatenated.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 250_000):
        import re

        import regex

        self.tree = TreeEncoder(ranks, limit)
        self.find = regex.compile(pattern).findall
        self.cut = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+").findall
        self.edge = re.compile(f"[{SPACES}]").match
        self.pieces = Recent(self._piece, limit)
        self.chunks = Recent(self._chunk, limit)
        self.words = Recent(self._word, limit)

    def _piece(self, piece: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tree.encode(piece.encode()))

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(chunk)))

    def _word(self, word: str) -> bytes:
        if not word or self.edge(word[0]) or self.edge(word[-1]):
            raise _NotAWord
        return self._chunk(" " + word)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            if not first or self.edge(first[-1]):
                raise _NotAWord
            return self.chunks[first] + b"".join(map(self.words.__getitem__, rest))
        except _NotAWord:  # runs of white space: cut before each run instead
            return b"".join(map(self.chunks.__getitem__, self.cut(text)))

    def decode(self, ids: bytes) -> bytes:
        return decode(memoryview(ids).cast("I"), self.tree.bytes) if ids else b""


class _NotAWord(Exception):
    pass


def decode(ids: Sequence[int], tokens: dict[int, bytes], leaf: int = 4096) -> bytes:
    """Halves are decoded and concatenated up the tree."""
    if len(ids) <= leaf:
        return b"".join(map(tokens.__getitem__, ids))
    middle = len(ids) // 2
    return decode(ids[:middle], tokens, leaf) + decode(ids[middle:], tokens, leaf)


def encode_documents(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", decoded: bool = False
) -> DataFrame:
    """``docs`` without ``text``, with ``ids``: little-endian unsigned 32-bit ids as binary.

    With ``decoded``, also the bytes that the ids decode to. A null or empty text has no ids. Repeated
    rows are encoded each for itself; an empty table gives an empty table. Other columns pass through whatever
    they are called, but for those named ``ids`` or ``decoded`` in any case. ``ranks`` is of a fixed size and is sent to
    each task; there is no shuffle, and a task holds a slice of rows and memos of words that are bounded in bytes.
    """
    kept = others(docs, text, "ids", "decoded")
    (body,) = fresh(docs, "body")
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def make():
        coder = TextEncoder(sent.value, pattern)

        def run(*columns: list) -> dict[str, list]:
            ids = [coder.encode(t) if t else b"" for t in columns[-1]]
            out = dict(zip(kept, columns)) | {"ids": ids}
            return out | ({"decoded": list(map(coder.decode, ids))} if decoded else {})

        return run

    source = docs.select(*map(col, kept), col(text).alias(body))
    schema = source.drop(body).withColumn("ids", F.lit(b""))
    if decoded:
        schema = schema.withColumn("decoded", F.lit(b""))
    return map_rows(source, make, schema.schema)


def op2_byte_bpe(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Token counts and digests of the ids and of the bytes they decode to, of every document; null texts have none."""
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path(tokenizer))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_documents(docs, ranks, public_tokenizers.PATTERN, decoded=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
