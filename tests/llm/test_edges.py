"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest

import corpus_pipeline
from spindrift.llm.decontam import contamination
from spindrift.llm.langid import languages
from spindrift.llm.licenses import scan_licenses
from spindrift.llm.lm import score_texts
from spindrift.llm.media import encode, inspect
from spindrift.llm.mixing import mix
from spindrift.llm.neardup import near_duplicates
from spindrift.llm.quality import quality
from spindrift.llm.spans import dedup_spans
from spindrift.llm.toxicity import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, h long, rep long, size long, held_out string, copies int, words string, bucket int, y int, component long"
LONG = " ".join(f"w{i % 997} is here and there." for i in range(40_000))
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog again and again today", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog again and again today", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog again and again today", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \n\t ", "en", None),
    (None, "a text of a document without an id", "en", "a"),
    (7, LONG, "en", "c"),
    (8, "ein kurzer Text", "de", "c"),
    (9, "one", None, ""),
    (10, "!!! 123 ???", "de", "b"),
    (-5, "\u0000 odd ☃ \U0001f600 text", "fr", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, lang, s, None, 1, 2, 3, 4, "x", 5, "y", 6, 7, 8) for d, t, lang, s in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1), (None, 1, 1), (4, None, None), (8, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(0, "quick brown fox jumps over the lazy dog"), (1, None), (2, "two words"), (3, ""), (None, "quick brown fox jumps over the lazy dog")], "item_id long, text string")


OPERATORS = {
    "toxicity": lambda d, lab, b: toxicity(d, lab),
    "quality": lambda d, lab, b: quality(d, lab),
    "near_duplicates": lambda d, lab, b: near_duplicates(d, k=2),
    "languages": lambda d, lab, b: languages(d),
    "contamination": lambda d, lab, b: contamination(d, b),
    "mix": lambda d, lab, b: mix(d),
    "media": lambda d, lab, b: inspect(encode(d)),
    "licenses": lambda d, lab, b: scan_licenses(d),
    "score_texts": lambda d, lab, b: score_texts(d),
    "dedup_spans": lambda d, lab, b: dedup_spans(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_rows(docs, labels, bench, name):
    got = OPERATORS[name](docs, labels, bench).collect()
    if name == "contamination":
        assert sorted((r.doc_id, r.item_id) for r in got if r.item_id is not None) == [(1, 0), (2, 0), (2, 0)]
        return
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((d is None, d or 0) for d, *_ in TEXTS)
    twice = [{k: v for k, v in r.asDict().items() if k not in ("copies", "taken")} for r in got if r.doc_id == 2]
    assert repr(twice[0]) == repr(twice[1])


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(docs, labels, bench, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0), bench.limit(0)).count() == 0


def test_defined_results(docs):
    near = {(r.doc_id): r for r in near_duplicates(docs, k=2).collect()}
    assert near[2].component_id == 1 and not near[2].kept and near[1].kept
    assert near[3].n_shingles == near[4].n_shingles == near[5].n_shingles == 0 and near[3].component_id == 3
    assert near[9].n_shingles == 1 and near[None].component_id is None and near[None].kept
    lang = {r.doc_id: r.lang_pred for r in languages(docs).collect()}
    assert lang[3] == lang[4] == lang[5] == lang[10] == "und"
    media = {r.doc_id: r for r in inspect(encode(docs)).collect()}
    assert media[3].payload_bytes == media[4].payload_bytes == 64 and media[3].payload_sha256 == media[4].payload_sha256
    spans = {r.doc_id: r for r in dedup_spans(docs).collect()}
    assert spans[3].text is None and spans[8].text == "ein kurzer Text"
    score = {r.doc_id: r for r in score_texts(docs).collect()}
    assert score[3].n_tokens == 1 and score[3].base_score == score[4].base_score


def test_stages_on_awkward_and_empty_tables(spark, docs, labels, bench, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, rows, str(tmp_path))
            assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name
            n = got.count()
            assert n > 0 if rows is docs else n == 0


def test_the_mixing_stage_takes_each_row_by_itself(spark):
    rows = [(i % 10 if i % 4 else None, " ".join(["w"] * (i % 7 + 1)), None, "ab"[i % 2], None) for i in range(1000)]
    got = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    size = {s: sum(i % 7 + 1 for i in range(1000) if "ab"[i % 2] == s) for s in "ab"}
    total = sum(size.values())
    for s, share in (("a", 5 / 7), ("b", 2 / 7)):
        assert abs(sum(r.size for r in got if r.source == s) - total * share) <= 14
    assert all(r.size == len(r.text.split()) and 1 <= r.copy <= 3 for r in got)
    assert sum(r.doc_id is None for r in got) > 200


def test_stages_keep_what_cannot_be_judged(spark, docs, bench, tmp_path):
    """Without labels nothing is toxic; null, empty and id-less rows pass the filtering stages."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept[name] = sorted((r.doc_id is None, r.doc_id or 0) for r in stage(spark, docs, str(tmp_path)).select("doc_id").collect())
    every = sorted((d is None, d or 0) for d, *_ in TEXTS)
    assert kept["toxicity"] == kept["substring_dedup"] == every
    assert kept["minhash_near_dedup"] == [x for x in every if x != (False, 2)]
    assert kept["benchmark_decontamination"] == [x for x in every if x[1] not in (1, 2) or x[0]]
