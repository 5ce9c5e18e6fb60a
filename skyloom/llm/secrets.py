"""Secret scans: an Aho-Corasick prefilter, anchored patterns at its hits, then embedded checksums."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.arrow import map_rows
from skyloom.llm.common import col, fresh, others, read_table

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def cases(word: str) -> list[str]:
    """``word`` with each ASCII letter in either case."""
    return ["".join(x) for x in product(*({c.lower(), c.upper()} for c in word))]


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


def crc_base62(secret: str) -> bool:
    """Whether the last six characters are the CRC-32 of those between prefix and them, in base 62."""
    body, check = secret.partition("_")[2][:-6], secret[-6:]
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = BASE62[d] + digits
    return digits == check


@dataclass(frozen=True)
class Kind:
    """A secret: keywords that each match starts with, its pattern there, and what a match must fulfil.

    Any match of ``pattern`` starts with a keyword; ``holds`` gets the match.
    """

    name: str
    keywords: tuple[str, ...]
    pattern: str
    holds: object = None


def long_value(m: re.Match) -> bool:
    return len(m[2]) >= 12


def at_least_18(m: re.Match) -> bool:
    return len(m[0]) >= 18


def at_least_16(m: re.Match) -> bool:
    return len(m[0]) >= 16


def checked(m: re.Match) -> bool:
    return crc_base62(m[0])


_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = Kind(
    "assign",
    tuple(x for w in _NAMES for x in cases(w)),
    f"({'|'.join(map(either_case, _NAMES[:4]))}|{either_case('api')}_?{either_case('key')})"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    long_value,
)
ACCESS = Kind("access", ("AKIA",), "AKIA[A-Z0-9]+", at_least_18)
#: A run of 16 starts with four digits, so all of them are the keywords of hexadecimal secrets.
HEX = Kind("hex", tuple("".join(x) for x in product("0123456789abcdef", repeat=4)), "[0-9a-f]+", at_least_16)
#: Tokens that carry a checksum of themselves.
CODE_HOST = Kind("code_host", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", checked)
PACKAGES = Kind("packages", ("npm_",), "npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", checked)

BASE_KINDS = (ASSIGN, ACCESS, HEX)
KINDS = (*BASE_KINDS, CODE_HOST, PACKAGES)


class Scanner:
    """Finds spans of ``kinds`` in a text, leftmost and non-overlapping in each kind."""

    def __init__(self, kinds: tuple[Kind, ...] = KINDS):
        import ahocorasick

        self.kinds = kinds
        self.match = [re.compile(k.pattern).match for k in kinds]
        self.prefilter = ahocorasick.Automaton()
        for i, kind in enumerate(kinds):
            for word in kind.keywords:
                self.prefilter.add_word(word, (i, len(word)))
        self.prefilter.make_automaton()

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, kind), sorted; a match that does not hold is dropped but still taken up."""
        found, past = [], [0] * len(self.kinds)
        for last, (kind, size) in self.prefilter.iter(text):
            start = last + 1 - size
            if start >= past[kind] and (m := self.match[kind](text, start)):
                past[kind] = m.end()
                if self.kinds[kind].holds is None or self.kinds[kind].holds(m):
                    found.append((start, m.end(), kind))
        return sorted(found, key=lambda x: (x[0], x[2]))


def mask(text: str, spans: list[tuple[int, int, int]], by: str) -> str:
    """``text`` with each stretch that spans cover replaced by ``by``."""
    parts, at = [], 0
    for start, end, _ in spans:
        if start > at or not parts:
            parts += [text[at:start], by]
        at = max(at, end)
    return "".join(parts) + text[at:]


def scan_secrets(
    docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS, masked: str | None = None
) -> DataFrame:
    """``docs`` with ``secrets``: an array of (kind, start, end) in code points, by start, then kind.

    With ``masked`` the text is returned with that string in place of each stretch of secrets; without
    it the text is left out. A null text has no secrets and stays null. Repeated rows are scanned each
    for itself; an empty table gives an empty table. A column named ``secrets``, in any case, is replaced; others
    keep their values whatever they are called. There is no shuffle.
    """
    return _scanned(docs, text, kinds, masked, "secrets")


def _scanned(docs: DataFrame, text: str, kinds: tuple[Kind, ...], masked: str | None, spans_as: str | None) -> DataFrame:
    kept = others(docs, text, spans_as or text)
    (body,) = fresh(docs, "body")

    def make():
        scanner = Scanner(kinds)

        def run(*columns: list) -> dict[str, list]:
            texts = columns[-1]
            spans = [scanner.scan(t) if t else [] for t in texts]
            out = dict(zip(kept, columns))
            if spans_as:
                out[spans_as] = [[{"kind": kinds[k].name, "start": a, "end": b} for a, b, k in s] for s in spans]
            if masked is not None:
                out[body] = [mask(t, s, masked) if s else t for t, s in zip(texts, spans)]
            return out

        return run

    source = docs.select(*map(col, kept), col(text).alias(body))
    empty = F.from_json(F.lit("[]"), "array<struct<kind:string,start:int,end:int>>")
    shape = source.drop(body)
    if spans_as:
        shape = shape.withColumn(spans_as, empty)
    if masked is not None:
        shape = shape.withColumn(body, F.lit("").cast("string"))
    return map_rows(source, make, shape.schema).withColumnRenamed(body, text)


def mask_secrets(docs: DataFrame, text: str = "text", by: str = "[secret]") -> DataFrame:
    """``docs``, every row and column, with the secrets of ``text`` masked; its length column untouched.

    A null text stays null, an empty one empty; repeated rows are masked each.
    """
    return _scanned(docs, text, KINDS, by, None).select(*map(col, docs.columns))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans, of every document; null texts hold none."""
    found = scan_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(*kinds: str):
        return F.filter("secrets", lambda s: s["kind"].isin(*kinds))

    names = [k.name for k in BASE_KINDS]
    base = of(*names)
    counts = [F.size(of(n)).cast("long").alias(f"n_{n}") for n in names]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans")
    )
