"""Text functions against their plain Python form on random Unicode texts."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from codaria.functions import text as T

ALPHABET = ["a", "B", "ß", "ﬁ", "①", "é", "e\u0301", "ｈ", "½", "\u200b", "\ufeff", "\u00ad", " ", "  ", "\t", "\n", "\r\n", "\r", "\x0b", "\x85", "\u00a0", "\u3000", ".", ",", "!", "?", ":", ";", "3", "٣", "_", "-", "ạ", "𝒳"]
ZERO = re.compile("[\u200b\u200c\u200d\ufeff\u00ad\u200e\u200f\u202a-\u202e]")


def document(text):
    out = ZERO.sub("", re.sub(r"\r\n?", "\n", unicodedata.normalize("NFKC", text or "")))
    out = re.sub(r"\s+([.,;:!?])", r"\1", re.sub(r"[^\S\n]+", " ", out))
    return re.sub(r"([.,;:!?])([^\s\d])", r"\1 \2", out).strip()


def retrieval(text):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", text.lower())).strip()


def mention(text):
    return re.sub(r"\s+", " ", ZERO.sub("", unicodedata.normalize("NFKC", text))).strip()


def test_normal_forms(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 14))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    t = F.col("t")
    rows = df.select("i", T.document_text(t).alias("d"), T.mention_text(t).alias("m"), T.space_tokens(t).alias("s"), T.strip(t).alias("p")).collect()
    for r in rows:
        text = texts[r["i"]]
        assert r["d"] == document(text), repr(text)
        assert r["m"] == mention(text) and r["s"] == text.lower().split() and r["p"] == text.strip(), repr(text)
    made = [document(x) for x in texts]
    rows = spark.createDataFrame(list(enumerate(made)), "i long, t string").select("i", T.retrieval_text(t).alias("r")).collect()
    assert [r["r"] for r in sorted(rows, key=lambda r: r["i"])] == [retrieval(x) for x in made]
