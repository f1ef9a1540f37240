"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of sampled text; a text is compressed with
each dictionary, piece by piece so that a long text cannot become its own dictionary, and the language
whose dictionary makes it smallest wins.  Narrow margins are rejected.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import textkit as tk
from spindrift.llm.cluster import columns_only, cut
from spindrift.llm.labelled import held_out

#: Sampled texts of a language and characters of each, all of which make its dictionary; bytes of a piece, zstandard level; languages whose dictionaries are broadcast and compiled together.
SAMPLE, SLICE, PIECE, LEVEL, LANGUAGES = 320, 320, 1_500, 9, 64
#: Share of the size by which the best must beat the next to be accepted.
MARGIN = 0.02
_LETTER, _OTHER = re.compile(r"[^\W\d_]"), re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """The words of a text in lower case, without digits and marks, which belong to no language."""
    return _OTHER.sub(" ", text.lower())


def dictionaries(docs: DataFrame, modulus: int, rest: int, sample: int = SAMPLE) -> list[tuple[str, bytes]]:
    """[(lang, dictionary)] from about ``sample`` texts a language of the training fold, a window of SLICE characters of each.

    The windows lie where a hash of doc_id and text puts them; equal windows of a language count once, however
    many rows hold them.  Every language of the training fold is learned.
    """
    rows = columns_only(docs, "doc_id", "text", "lang").where("lang is not null and text is not null and length(text) > 0").where(~held_out(modulus, rest))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return []
    rate = cut(docs.sparkSession.createDataFrame([(r.lang, min(1.0, sample / r.n)) for r in counts], "lang string, rate double"))
    # rows without an id are told apart by their texts
    u = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")), F.lit(11)), F.lit(1 << 24)) / float(1 << 24)
    at = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")), F.lit(12)), F.greatest(F.lit(1), F.length("text") - SLICE + 1)) + 1
    picked = rows.join(F.broadcast(rate), "lang").where(u < F.col("rate"))
    parts = picked.select("lang", u.alias("u"), F.substring("text", at.cast("int"), F.lit(SLICE)).alias("part")).groupBy("lang", "part").agg(F.min("u").alias("u")).toArrow().to_pylist()
    got: dict[str, list[tuple]] = {r.lang: [] for r in counts}
    for r in parts:
        got[r["lang"]].append((r["u"], r["part"]))
    out = []
    for lang in sorted(got):
        raw = letters(" ".join(part for _, part in sorted(got[lang]))).encode()
        if len(raw) >= 8:
            out.append((lang, raw))
    return out


class Classifier:
    def __init__(self, found: list[tuple[str, bytes]]):
        self.langs = [lang for lang, _ in found]
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=3, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.coders = []
        for _, raw in found:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, data: bytes) -> list[int]:
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.coders]

    def smallest(self, text: str | None) -> tuple[int, int, int]:
        """(size, language, next size) of a text's smallest and second smallest; language -1 for a text without letters."""
        if not text or not self.langs or not _LETTER.search(text):
            return 0, -1, -1
        sizes = self.sizes(letters(text).encode())
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        return sizes[best], best, min((s for i, s in enumerate(sizes) if i != best), default=-1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted); ``und`` for a text without letters or a model without languages."""
        return verdict(self.langs, self.smallest(text))


def verdict(langs: list[str], found: tuple[int, int, int]) -> tuple[str, float, bool]:
    """(language, score, accepted) of ``Classifier.smallest``."""
    size, best, other = found
    if best < 0:
        return "und", 0.0, False
    margin = (other - size) / max(1, other) if other >= 0 else 1.0
    return langs[best], min(1.0, 0.5 + margin / 0.2 * 0.5), margin >= MARGIN


def merged(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    """The smallest and second smallest of two blocks of languages; ``a`` is of the earlier block and counts on a tie."""
    if a[1] < 0 or b[1] < 0:
        return a if b[1] < 0 else b
    first, last = (a, b) if a[0] <= b[0] else (b, a)
    return first[0], first[1], min(x for x in (first[2], last[0]) if x >= 0)


def languages(docs: DataFrame, modulus: int = 3, rest: int = 1, sample: int = SAMPLE, block: int = LANGUAGES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) for each row of ``docs``.

    Learned from texts outside the held-out fold whose lang is not null.  ``accepted`` is false where the
    margin is narrow, so a caller may reject the prediction; lang_pred still names the smallest.  Texts
    that are null or without a letter, and all texts where nothing was learned, are ``und`` with score 0;
    ties go to the first language in order.  Repeated rows are scored each, a null doc_id is not held
    out, extra columns are ignored, an empty table gives an empty result.  Long texts are compressed whole,
    piece by piece.
    """
    found = dictionaries(docs, modulus, rest, sample)
    bc = [docs.sparkSession.sparkContext.broadcast(found[i : i + block]) for i in range(0, len(found), block)]
    langs = [lang for lang, _ in found]

    def score(batches):
        only = Classifier(bc[0].value) if len(bc) == 1 else None
        for batch in tk.pieces(batches):
            texts = batch.column("text").to_pylist()
            least = [(0, -1, -1)] * len(texts)
            # of several blocks one at a time is compiled, which bounds a task's memory
            for b, part in enumerate(bc):
                model = only or Classifier(part.value)
                for i, t in enumerate(texts):
                    size, best, other = model.smallest(t)
                    least[i] = merged(least[i], (size, best + b * block if best >= 0 else -1, other))
            got = [verdict(langs, x) for x in least]
            cols = list(zip(*got, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    rows = columns_only(docs, "doc_id", "text").select("doc_id", held_out(modulus, rest).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
