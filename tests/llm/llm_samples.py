"""Small evidence tables with awkward rows, and plain rewrites of the text operators' rules."""

import random

from pyspark.sql import Row
from pyspark.sql import types as T

CLASHING = ("n", "hash", "digest", "kept", "words", "_row", "fingerprint", "score", "lang_pred", "payload", "length", "shard")
EVIDENCE = T.StructType([T.StructField("evidence_id", T.LongType()), T.StructField("snippet", T.StringType()), T.StructField("lang", T.StringType())]
                        + [T.StructField(c, T.StringType()) for c in CLASHING])
EMPTY = [(None, None), (1, None), (2, ""), (3, "  \t\n "), (4, "!!! ... ---")]
SYLLABLES = {"en": "the ing ion tha er on at", "de": "ung sch ei er ch ge ber", "fr": "é oi eau aux le re ment", "es": "ó ñ que rr la os ado"}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def texts(seed: int = 3, n: int = 40) -> list[tuple[int, str, str]]:
    """(id, text, language): prose, copies, near copies, one very long text."""
    rng = random.Random(seed)
    rows = []
    for i in range(10, 10 + n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, "\n".join(sentence(rng, lang, rng.randint(5, 40)) for _ in range(rng.randint(1, 4))), lang))
    for i in range(n // 2):
        _, text, lang = rows[i]
        rows.append((200 + i, text if i % 2 else text + " more", lang))
    rows.append((300, sentence(rng, "en", 30_000), "en"))
    return rows


def evidence(spark, rows, langs=None, twice=True):
    """Rows of (id, text) with clashing extra columns; the last row is repeated unless ``twice`` is off."""
    rows = [(*r[:2], (r[2] if len(r) > 2 else None)) for r in rows]
    if twice and rows:
        rows.append(rows[-1])
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], EVIDENCE).repartition(3)


def plain(df) -> list[tuple]:
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect()), key=repr)


__all__ = ["CLASHING", "EMPTY", "EVIDENCE", "Row", "evidence", "plain", "sentence", "texts"]
