"""Language identification by compression: the dictionary that makes a text smallest names its language.

For each language a raw-content dictionary is put together from pieces of at most ``SAMPLE`` training documents of it (a
documented bound). The lower-cased letter runs of every whole text are then compressed once with each dictionary, in the
task that reads it. A run of zero bytes goes before them, as a block that does not shrink would be stored as it is and
tell nothing. Where the two smallest sizes are too close, the prediction is marked as rejected.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wardline.llm.shared import hash_share, held_out, map_batches, training_row

SAMPLE = 400
MOST = 200  # languages, each a dictionary in every worker
PIECE = 600
LEVEL = 9
#: Short texts are compressed with more search, as single bytes decide.
SHORT, SHORT_LEVEL = 600, 19
#: Bytes and share of the smallest size that the next one must be behind.
MARGIN_BYTES, MARGIN_SHARE = 2, 0.01


_FILL = bytes(400)
_LETTERS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> bytes:
    """Lower-cased runs of letters, with blanks around them."""
    return f" {' '.join(_LETTERS.findall(text.lower()))} ".encode()


def learn_languages(documents: DataFrame, sample: int = SAMPLE, piece: int = PIECE, most: int = MOST) -> dict[str, bytes]:
    """Dictionary content by language, most frequent first, from text and lang of training rows; empty without such rows.

    Of each language the ``sample`` rows of smallest hash count, each with at most ``piece`` characters from a place that
    its hash chooses; only these pieces are shuffled and reach the driver. More than ``most`` languages are an error: then
    the column holds something else, and none is left out silently.
    """
    rows = documents.filter(training_row(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    spot = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - piece, F.lit(1))).cast("int") + 1
    rows = rows.select("lang", F.xxhash64("doc_id", "text").alias("order"), F.substring("text", spot, F.lit(piece)).alias("piece"))
    often = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most + 1).collect()
    if len(often) > most:
        raise ValueError(f"lang holds more than {most} values; clean it or raise ``most``")
    rows = rows.filter(_any([(F.col("lang") == r["lang"]) & hash_share(F.col("order"), sample, r["count"]) for r in often]))
    first = W.partitionBy("lang").orderBy("order", "piece")
    chosen = rows.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= sample).orderBy("lang", "at").collect()
    content: dict[str, list[bytes]] = {}
    for r in chosen:
        content.setdefault(r["lang"], []).append(letter_runs(r["piece"]))
    return {r["lang"]: b"".join(content[r["lang"]]) for r in often if r["lang"] in content}


def _any(tests: list[Column]) -> Column:
    """Whether one of the tests holds, as a balanced tree."""
    if len(tests) < 2:
        return tests[0] if tests else F.lit(False)
    middle = len(tests) // 2
    return _any(tests[:middle]) | _any(tests[middle:])


class Compressors:
    """One compressor for each language and level, made once in each worker."""

    def __init__(self, content: dict[str, bytes]) -> None:
        self.languages = list(content)
        self.by_level = {}
        for level in (LEVEL, SHORT_LEVEL):
            made = []
            for lang in self.languages:
                dictionary = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                dictionary.precompute_compress(level=level)
                made.append(
                    zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)
                )
            self.by_level[level] = made

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, score (its share of 2^-(bytes/4) over all languages) and whether the margin is too narrow."""
        text = _FILL + letter_runs(text)
        sizes = [len(c.compress(text)) for c in self.by_level[SHORT_LEVEL if len(text) < SHORT + len(_FILL) else LEVEL]]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        low = sizes[best]
        score = 1.0 / sum(math.pow(2.0, -min(200.0, (s - low) / 4)) for s in sizes)
        behind = min((s for k, s in enumerate(sizes) if k != best), default=low + 1_000_000) - low
        return self.languages[best], score, behind < max(MARGIN_BYTES, MARGIN_SHARE * low)


def identify_languages(documents: DataFrame, content: dict[str, bytes]) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row.

    Null texts and texts without a letter are `und` with score 0, as is everything when no language was learned. Of
    equal sizes the more frequent language wins. Repeated rows get equal results; other columns are not read.
    """

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        if not hasattr(work, "ready"):
            work.ready = Compressors(content)
        out = [
            work.ready.predict(t) if letter and content else ("und", 0.0, True)
            for t, letter in zip(batch.column("text").to_pylist(), batch.column("letter").to_pylist(), strict=True)
        ]
        return {
            "doc_id": batch.column("doc_id"), "lang_pred": [o[0] for o in out], "score": [o[1] for o in out],
            "rejected": [o[2] for o in out],
        }

    rows = documents.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    found = map_batches(rows, work, "doc_id long, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
