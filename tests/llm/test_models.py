"""Learned operators against plain re-statements of their formulas, and measured recall."""

import math
import random
import re

import numpy as np
import zstandard

from spindrift.llm import langid, lm, neardup, toxicity
from spindrift.llm import quality as quality_module
from spindrift.llm import textkit as tk
from spindrift.llm.cluster import cut, load
from spindrift.llm.labelled import training_texts

SF, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_toxicity_scores_equal_a_search_of_the_whole_lexicon(spark):
    docs, labels = load(spark, SF01, "documents"), load(spark, SF01, "labels")
    train = cut(training_texts(docs, labels, "toxic", toxicity.SAMPLE))
    lexicon, base = toxicity.learn(train)
    words, stems = [t for t in lexicon if not t.endswith("*")], [t[:-1] for t in lexicon if t.endswith("*")]
    assert words or stems
    weight, w = toxicity.fit(train, [*words, *(s + "*" for s in stems)], base)

    def nearest(word):
        stem = max((s for s in stems if word.startswith(s)), key=len, default=None)
        near = min(((distance(word, t), i) for i, t in enumerate(words) if abs(len(t) - len(word)) <= 2 and distance(word, t) <= toxicity.edits(t)), default=None)
        if near and (near[0] == 0 or stem is None):
            return near[1], near[0] > 0
        return (len(words) + stems.index(stem), False) if stem else None

    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    memo = {}
    for r in sorted(docs.collect(), key=lambda r: len(r.text or ""))[:400]:
        low = (r.text or "").lower()
        tokens = re.findall(r"\w+|[\"“”„«»‘’]", low)
        hits = {}
        for word in set(re.findall(r"\w+", low)):
            hit = memo[word] if word in memo else memo.setdefault(word, nearest(word))
            if hit is None:
                continue
            best = 0.0
            for i, t in enumerate(tokens):
                if t == word:
                    before, after = tokens[max(0, i - 4) : i], tokens[i + 1 : i + 5]
                    marks = set("\"“”„«»‘’")
                    quoted = bool(marks & set(before) and marks & set(after)) or bool(toxicity._REPORT & set(before))
                    best = max(best, 0.25 if quoted else 1.0)
            hits[hit] = hits.get(hit, 0.0) + best
        x = toxicity.features(len(re.findall(r"\w+", low)), hits, weight)
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(x, w))))))
        assert abs(got[r.doc_id] - want) < 1e-9, r.doc_id


def test_quality_scores_equal_the_mean_of_the_vectors(spark, monkeypatch):
    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    kept, real = [], quality_module.train
    monkeypatch.setattr(quality_module, "train", lambda rows: kept.append(real(rows)) or kept[0])
    got = {r.doc_id: r.score for r in quality_module.quality(docs, labels).collect()}
    weight, bias = kept[0]
    mult, full = tk.MULT, (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & full
        return x ^ (x >> 31)

    table = [mix((c + 1) * mult & full) for c in range(256)]

    def bucket(part, salt):
        return mix((sum(table[c] * pow(mult, i, 1 << 64) for i, c in enumerate(part)) + salt) & full) >> (64 - quality_module.BITS)

    memo = {}
    for r in docs.collect()[:60]:
        features = []
        last = None
        for word in re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode()):
            if word not in memo:
                memo[word] = [bucket(word, 0)] + [bucket(word[i : i + n], n) for n in quality_module.NGRAMS for i in range(len(word) - n + 1)]
            features += memo[word] + ([quality_module.REPEAT] if word == last else [])
            last = word
        z = sum(float(weight[b]) for b in features) / max(1, len(features)) + bias
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-5, r.doc_id


def test_languages_equal_the_smallest_of_all_compressions(spark):
    docs = load(spark, SF, "documents")
    found = langid.dictionaries(docs, 3, 1)
    params = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, min_match=3, write_checksum=False, write_content_size=False, write_dict_id=False)
    coders = {lang: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params) for lang, raw in found}
    assert len(coders) > 1
    for r in langid.languages(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        if not r.text or not re.search(r"[^\W\d_]", r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        data = re.sub(r"[\W\d_]+", " ", r.text.lower()).encode()
        size = {lang: sum(len(c.compress(data[i : i + langid.PIECE])) for i in range(0, len(data), langid.PIECE)) for lang, c in coders.items()}
        assert r.lang_pred == min(sorted(size), key=size.get), (r.doc_id, size)
        first, second = sorted(size.values())[:2]
        assert r.accepted == ((second - first) / max(1, second) >= langid.MARGIN)


def test_class_scores_equal_the_formula(spark, monkeypatch):
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(rng.choice(vocab[: 10 + i % 50]) for _ in range(rng.randrange(0, 30))) for i in range(80)}
    kept, real = [], lm.cluster
    monkeypatch.setattr(lm, "cluster", lambda *a: kept.append(real(*a)) or kept[0])
    monkeypatch.setattr(lm, "CLUSTERED", 12)
    monkeypatch.setattr(lm, "CLASSES", 3)
    got = {r.doc_id: r.score for r in lm.score_texts(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    import zlib
    from collections import Counter

    train = [t for d, t in texts.items() if zlib.crc32(str(d).encode()) % 5 != 1]
    count = Counter(w for t in train for w in t.split())
    hasher = tk.Hasher(tk.class_space_delimited())
    hashed = {w: (int(lm._tokens(np.frombuffer(w.encode(), np.uint8), hasher)[0][0]), int(lm._tokens(np.frombuffer(w.encode(), np.uint8), hasher)[1][0])) for w in vocab}
    common = sorted((w for w in count if count[w] >= lm.COMMON), key=lambda w: hashed[w][0])
    if len(common) < 12:
        common = sorted(sorted(count, key=lambda w: (-count[w], np.uint64(hashed[w][0]).astype(np.int64)))[:12], key=lambda w: hashed[w][0])
    cls, classes, m = kept[0]
    of = {w: int(c) if c >= 0 else classes + hashed[w][1] for w, c in zip(common, cls, strict=True)}
    kind = lambda w: of.get(w, classes + hashed[w][1])
    size, start, end = len(m), len(m) - 2, len(m) - 1
    pairs = Counter((a, b) for t in train for s in [[start, *map(kind, t.split()), end]] for a, b in zip(s, s[1:]))
    assert all(m[a, b] == pairs.get((a, b), 0) for a in range(size) for b in range(size))
    n, v = Counter(), Counter()
    for w in count:
        n[kind(w)] += count[w]
        v[kind(w)] += 1
    for d, t in texts.items():
        s = [start, *map(kind, t.split()), end]
        want = sum(math.log10((pairs.get((a, b), 0) + lm.ALPHA) / (sum(pairs.get((a, x), 0) for x in range(size)) + lm.ALPHA * size)) for a, b in zip(s, s[1:]))
        want += sum(math.log10((count.get(w, 0) + 0.5) / (n[kind(w)] + 0.5 * (v[kind(w)] + 1))) for w in t.split())
        assert abs(got[d] - want) < 1e-6, d


def test_pairs_just_above_the_threshold_are_found(spark):
    """Pairs of similarity 0.80 to 0.85 on two-word shingles: every one must be linked."""
    rng = random.Random(22)
    rows, pairs = [], []
    while len(pairs) < 400:
        w = [f"t{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 240))]
        x = list(w)
        for i in rng.sample(range(1, len(x) - 1), rng.randrange(len(x) // 24, len(x) // 18 + 1)):
            x[i] = f"u{rng.randrange(10**6)}"
        a, b = ({(s[i], s[i + 1]) for i in range(len(s) - 1)} for s in (w, x))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            d = len(rows)
            rows += [(d, " ".join(w)), (d + 1, " ".join(x))]
            pairs.append((d, d + 1))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) == len(pairs)
