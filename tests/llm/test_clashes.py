"""Extra columns whose names equal working columns or new ones, in any case, across the corpus operators."""

import pytest
from pyspark.sql import functions as F

from skyloom.llm import bpe, chunks, lm, packing, quality, secrets, simhash, suffixes, toxicity

GOOD = " ".join(f"w{i}" for i in range(80))
WORKING = [
    "_text", "_key", "_row", "_digest", "_words", "_lines", "_hashes", "_placed", "_starts", "_part", "_n", "_before", "_rank", "_body", "_log", "_class",
    "_rare", "_times", "_pairs", "_found", "_doc", "_owner", "_mine", "_chunks", "_of", "_least", "_host", "row", "body", "host", "key", "seg", "doc", "place",
    "kind", "id", "a.b", "_Body", "__body", "high", "low", "source_", "n", "c0", "banned_",
]
NEW = {
    "quality_verdicts": ("n_words", "KEPT", "Fails_short"), "keep_good": (), "scan_secrets": ("Secrets",), "mask_secrets": (), "encode_documents": ("IDS", "decoded"),
    "score_documents": ("Grade", "toxic"), "drop_repeats": ("Removed",), "score": ("N_TOKENS", "score"), "remove_repeats": ("KEPT", "removed"),
    "fingerprints": ("FP",), "near_dedup": (), "pack": ("Bucket", "slot"), "text_measures": ("N_Words",),
}


def apply(name, docs):
    ranks = {bytes([i]): i for i in range(256)}
    return {
        "quality_verdicts": lambda: quality.quality_verdicts(docs), "keep_good": lambda: quality.keep_good(docs), "scan_secrets": lambda: secrets.scan_secrets(docs),
        "mask_secrets": lambda: secrets.mask_secrets(docs), "encode_documents": lambda: bpe.encode_documents(docs, ranks, r"\S+|\s+", decoded=True),
        "score_documents": lambda: toxicity.score_documents(docs, toxicity.Severity({}, (1.0,))), "drop_repeats": lambda: chunks.drop_repeats(docs),
        "score": lambda: lm.score(docs, lm.train(docs, own_units=8)), "remove_repeats": lambda: suffixes.remove_repeats(docs),
        "fingerprints": lambda: simhash.fingerprints(docs), "near_dedup": lambda: simhash.near_dedup(docs), "pack": lambda: packing.pack(docs, "n_chars", "doc_id"),
        "text_measures": lambda: quality.text_measures(docs),
    }[name]()


@pytest.mark.parametrize("name", NEW)
def test_extra_columns_keep_their_values(spark, name):
    docs = spark.createDataFrame([(1, GOOD, "en", "s", 7), (1, GOOD, "en", "s", 7), (2, None, None, None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    taken, extra = set(), []
    for c in WORKING:
        if c.lower() not in taken:
            taken.add(c.lower())
            extra.append(c)
    extra += [] if NEW[name] else ["secrets", "fp", "removed", "kept", "n_words", "ids"]
    docs = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in extra], *[F.lit("old").alias(c) for c in NEW[name]])
    out = apply(name, docs)
    lowered = [c.lower() for c in out.columns]
    assert len(set(lowered)) == len(lowered)
    found = out.select(*[F.col(f"`{c}`") for c in ("doc_id", *extra)]).collect()
    assert found and all(r[c] == f"{c}:{r['doc_id']}" for r in found for c in extra)
    for c in NEW[name]:
        assert "old" not in {str(r[0]) for r in out.select(next(x for x in out.columns if x.lower() == c.lower())).collect()}
