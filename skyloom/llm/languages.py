"""Language ID in two steps: the family first, then linear support vector machines between each two of its languages."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.arrow import map_rows
from skyloom.llm.common import drop_shared, fresh, others, packed, read_table, shared_table, unpacked

#: Families of languages by ISO 639-1 code. A language that is not named is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ca co es fr gl it la oc pt rm ro sc",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "uralic": "et fi hu se",
    "indic": "as bn gu hi mr ne or pa sa si ur",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "semitic": "am ar he mt ti",
    "celtic": "br cy ga gd gv kw",
    "baltic": "lt lv",
    "sinitic": "wuu yue zh",
}
#: Slots of the hashed byte trigrams.
SLOTS = 4096
#: Documents a language, about, that the support vector machines are fitted on; the families learn from all.
ROWS = 2000
#: Bytes of a text that are turned into trigrams at a time.
PIECE = 1 << 20
#: Predicted where a text is null or has no letter, or nothing was learned.
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters in lower case, all other ASCII as blanks; bytes of other letters as they are.
_FOLD = bytes(ord(chr(i).lower()) if chr(i).isascii() and chr(i).isalpha() else 32 if i < 128 else i for i in range(256))


def trigram_counts(text: str, slots: int = SLOTS) -> np.ndarray:
    """Occurrences of the byte trigrams of a whole text, by hashed slot; runs of what is no letter count as one blank."""
    counts = np.zeros(slots, np.int64)
    last = b""
    for at in range(0, len(text), PIECE):
        words = text[at : at + PIECE].encode("utf-8", "replace").translate(_FOLD)
        core = b" ".join(words.split())
        # a piece begins with the end of the one before, as if the text were one
        lead = b" " if (not at or words[:1] == b" ") and last[-1:] != b" " else b""
        tail = b" " if core and (words[-1:] == b" " or at + PIECE >= len(text)) else b""
        flat = last + lead + core + tail
        last = flat[-2:]
        b = np.frombuffer(flat, np.uint8).astype(np.uint32)
        if len(b) < 3:
            continue
        h = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
        counts += np.bincount(h >> np.uint32(32 - int(slots).bit_length() + 1), minlength=slots)
    return counts


def _unit(counts: np.ndarray) -> np.ndarray:
    """Rows of counts damped and of length 1: what the support vector machines see."""
    x = np.log1p(counts)
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def has_letter(text: str | None) -> bool:
    """Whether a text is not null and has a letter of any script."""
    return text is not None and _LETTER.search(text) is not None


def _profiles(labelled: DataFrame) -> DataFrame:
    """``(lang, slot, n)`` over all rows of ``labelled`` (lang, text); slot -1 counts the documents that have a letter."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pydict()
                for lang, text in zip(part["lang"], part["text"]):
                    if not has_letter(text):
                        continue
                    if lang not in sums:
                        sums[lang] = np.zeros(SLOTS + 1, np.int64)
                    sums[lang][:-1] += trigram_counts(text)
                    sums[lang][-1] += 1
        for lang, n in sums.items():
            held = np.flatnonzero(n)
            slot = np.where(held == SLOTS, -1, held).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.string()), pa.array(slot), pa.array(n[held])], names=["lang", "slot", "n"])

    return labelled.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def _vectors(rows: DataFrame) -> DataFrame:
    """``(lang, x)`` of rows (lang, text) that have a letter."""

    def make():
        def run(lang, text):
            kept = [(l, _unit(trigram_counts(t)).tolist()) for l, t in zip(lang, text) if has_letter(t)]
            return {"lang": [l for l, _ in kept], "x": [x for _, x in kept]}

        return run

    return map_rows(rows.select("lang", "text"), make, "lang string, x array<double>", rows=128)


def family_of(langs: list[str], families: dict[str, str] = FAMILIES) -> dict[str, str]:
    """The family of each language; that of a code before ``-`` or ``_`` (``pt-BR``), or the language itself."""
    known = {code: name for name, codes in families.items() for code in codes.split()}
    return {x: known.get(re.split("[-_]", x.lower())[0], x) for x in langs}


class Model:
    """What was learned: trigram log-probabilities of families, and a plane between each two languages of a family."""

    def __init__(self, langs: list[str], family: dict[str, str], logs: np.ndarray, priors: np.ndarray, planes: dict):
        self.langs, self.family, self.logs, self.priors, self.planes = langs, family, logs, priors, planes
        self.names = sorted(set(family.values()))
        self.members = {f: [x for x in langs if family[x] == f] for f in self.names}

    def predict(self, counts: np.ndarray) -> list[tuple[str, float]]:
        """Language and score of each row of counts: first the likeliest family, then most votes between its languages.

        The score is the family's probability times the mean of the winner's logistic margins. Equal votes go by
        the sum of margins, then by the language's name.
        """
        told = counts @ self.logs.T + self.priors
        told -= told.max(1, keepdims=True)
        odds = np.exp(told)
        odds /= odds.sum(1, keepdims=True)
        best, x, out = odds.argmax(1), _unit(counts), []
        for row, (i, f) in enumerate(zip(best, odds[np.arange(len(best)), best])):
            members = self.members[self.names[i]]
            votes = {m: [0, 0.0, 0.0] for m in members}
            for a, b in ((a, b) for k, a in enumerate(members) for b in members[k + 1 :]):
                weights, offset = self.planes[a, b]
                margin = float(x[row] @ weights + offset)
                sure = 1 / (1 + np.exp(-2 * np.clip(margin, -30, 30)))
                for m, side, p in ((a, margin, sure), (b, -margin, 1 - sure)):
                    votes[m] = [votes[m][0] + (side > 0), votes[m][1] + side, votes[m][2] + p]
            won = min(members, key=lambda m: (-votes[m][0], -votes[m][1], m))
            out.append((won, float(f) * (votes[won][2] / (len(members) - 1) if len(members) > 1 else 1.0)))
        return out


def train(labelled: DataFrame, rows: int = ROWS, families: dict[str, str] = FAMILIES) -> Model | None:
    """A model of the non-null languages of ``labelled`` (lang, text), or None where no text has a letter.

    Families are multinomial models of trigrams over all rows. The machines are fitted on about ``rows`` documents a
    language, chosen by a hash of the text, so that the choice does not depend on the order or the number of tasks. Only
    sums by language and slot, and planes, reach the driver.
    """
    held = labelled.filter("lang is not null and text is not null").select("lang", "text")
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for r in _profiles(held).collect():
        if r["slot"] < 0:
            docs[r["lang"]] = r["n"]
        else:
            sums.setdefault(r["lang"], np.zeros(SLOTS))[r["slot"]] = r["n"]
    if not docs:
        return None
    langs = sorted(docs)
    family = family_of(langs, families)
    names = sorted(set(family.values()))
    profile = np.array([sum(sums.get(x, np.zeros(SLOTS)) for x in langs if family[x] == f) for f in names])
    logs = np.log(profile + 0.5) - np.log((profile + 0.5).sum(1, keepdims=True))
    n = np.array([sum(docs[x] for x in langs if family[x] == f) for f in names], float)
    pairs = [(a, b) for i, a in enumerate(langs) for b in langs[i + 1 :] if family[a] == family[b]]
    planes = {}
    if pairs:
        share = F.create_map(*[F.lit(v) for x in langs for v in (x, min(1.0, rows / docs[x]))])
        chosen = held.filter((F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)) < share[F.col("lang")])
        sample = shared_table(_vectors(chosen).select("lang", "x"), "languages")
        for a, b in pairs:
            two = sample.filter(F.col("lang").isin(a, b)).select((F.col("lang") == a).cast("double").alias("label"), array_to_vector("x").alias("features"))
            machine = LinearSVC(regParam=1e-4, maxIter=40, standardization=False).fit(two.repartition(4))
            planes[a, b] = (machine.coefficients.toArray(), machine.intercept)
        drop_shared(sample)
    return Model(langs, family, logs, np.log(n / n.sum()), planes)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) of each whole text; columns of those names are replaced.

    A text that is null or has no letter, or an untrained model, gives ``und`` and 0. Rows stay as often as they come.
    """
    names = others(docs, "lang_pred", "score")
    (rest,) = fresh(docs, "rest")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    struct = docs.select(packed(names).alias(rest), "text")

    def make():
        learned = sent.value

        def run(kept, text):
            at = [i for i, t in enumerate(text) if learned is not None and has_letter(t)]
            lang, score = [UNKNOWN] * len(text), [0.0] * len(text)
            if at:
                found = learned.predict(np.array([trigram_counts(text[i]) for i in at], np.float64))
                for i, (x, p) in zip(at, found):
                    lang[i], score[i] = x, p
            return {rest: kept, "lang_pred": lang, "score": score}

        return run

    kind = struct.schema[rest].dataType.simpleString()
    done = map_rows(struct, make, f"{rest} {kind}, lang_pred string, score double", rows=128)
    return done.select(*unpacked(rest, names), "lang_pred", "score")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every whole text, learned from documents whose crc32(doc_id) is no multiple of 5.

    A null doc_id hashes as an empty string and is held out.
    """
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = train(docs.filter(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
