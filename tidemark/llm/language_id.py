"""Language identification by compression.

Texts are reduced to their lower-cased runs of letters. For each language a raw-content zstandard dictionary is built from a bounded sample of training texts. A text of any
length is cut into segments of `SEGMENT` bytes (whole texts, no prefixes), every segment is compressed with every dictionary, and the language with the smallest total wins. The
margin is the relative gain over the second language; texts with a narrow margin, or without a letter, are rejected.

The sample: for each language the `SAMPLE_DOCS` training documents with the smallest hash of their id, taken from those whose hash is below a threshold that leaves
about `OVER` times as many (all, where there are fewer). A dictionary is their texts in that order, of each `TEXT_BYTES` at most, up to `DICT_BYTES` in all. Only that reaches
the driver; the dictionaries are what tasks get. These bounds hold for learning alone.

Cases: null text, or text without a letter, is `und` with score 0 and is rejected; ties go to the language with more training rows, then to the first in the alphabet; with no
training row everything is `und`; rows with a null id are not learnt from where the caller's condition is null for them; repeated rows are rows of their own; an empty table gives an
empty result; other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import fresh, named, with_arrow_column

SAMPLE_DOCS, TEXT_BYTES, DICT_BYTES, SEGMENT, LEVEL, OVER = 200, 32 << 10, 256 << 10, 128, 3, 5
#: Margins below this reject.
NARROW = 0.002
UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")


def sample(docs: DataFrame, usable: Column, id_col: str, text_col: str, lang_col: str, sample_docs: int) -> tuple[DataFrame, dict[str, int]]:
    """lang, n, text of the sampled rows, and the number of training rows of each language. Thresholds keep what meets in a language's task to about `OVER` samples."""
    rows = docs.where(usable).select(named(id_col).alias("id"), named(text_col).alias("text"), named(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null and text <> ''")
    often = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = {lang: min(1.0, OVER * sample_docs / n) for lang, n in often.items()}
    low = F.lit(None).cast("double")
    for lang, part in share.items():
        low = F.when(F.col("lang") == lang, F.lit(part)).otherwise(low)
    hashed = rows.withColumn("hash", F.xxhash64("id")).where((F.pmod("hash", F.lit(1 << 30)) < low * (1 << 30)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1 << 30)), "hash", "id", F.xxhash64("text")))
    return hashed.withColumn("n", rank).where(F.col("n") <= sample_docs).select("lang", "n", "text"), often


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionaries by language, the most frequent language first, from the rows where `usable` holds and text and language are not null."""
    taken, often = sample(docs, usable, id_col, text_col, lang_col, sample_docs)
    before = F.coalesce(F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = taken.withColumn("text", F.encode("text", "utf-8").substr(F.lit(1), F.lit(TEXT_BYTES))).withColumn("before", before).where(F.col("before") < dict_bytes)
    parts: dict[str, list[bytes]] = {}
    for r in cut.orderBy("lang", "n").collect():
        parts.setdefault(r["lang"], []).append(letters(bytes(r["text"]).decode("utf-8", "ignore")))
    return {lang: b"\n".join(parts[lang])[:dict_bytes] for lang in sorted(parts, key=lambda x: (-often[x], x))}


def letters(text: str) -> bytes:
    return " ".join(NOT_LETTERS.split(text.lower())).strip().encode("utf-8", "surrogatepass")


class Languages:
    """The compressors of one Python worker."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import zstandard as z

        self.names = list(dictionaries)
        self.by = []
        for name in self.names:
            data = z.ZstdCompressionDict(dictionaries[name], dict_type=z.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=level)
            self.by.append(z.ZstdCompressor(level=level, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def of(self, text: str | None, segment: int = SEGMENT) -> tuple[str, float]:
        """Language and margin."""
        data = letters(text or "")
        if not data or not self.names:
            return UNKNOWN, 0.0
        parts = [data[i : i + segment] for i in range(0, len(data), segment)]
        sizes = sorted((sum(map(len, map(compress, parts))), i) for i, compress in enumerate(self.by))
        if len(sizes) == 1:
            return self.names[0], 1.0
        return self.names[sizes[0][1]], (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", out: str | None = None, narrow: float = NARROW) -> DataFrame:
    """`docs` with a struct column of pred (string), score (0 to 1) and rejected (boolean). Its name is `out`, or else `fresh(docs, "language")`."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    kind = pa.struct([("pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def make() -> Callable[[pa.Array], pa.Array]:
        languages = Languages(sent.value)

        def column(texts: pa.Array) -> pa.Array:
            found = [languages.of(t.as_py()) for t in texts]
            return pa.array([{"pred": lang, "score": margin, "rejected": lang == UNKNOWN or margin < narrow} for lang, margin in found], kind)

        return column

    added = T.StructType([T.StructField("pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return with_arrow_column(docs, text_col, make, out or fresh(docs, "language"), added)
