"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest

from spindrift.llm import decontam, licenses, lm, media, neardup, spans
from spindrift.llm import textkit as tk
from spindrift.llm.cluster import components, load
from spindrift.llm.langid import languages
from spindrift.llm.mixing import mix, targets
from spindrift.llm.quality import quality
from spindrift.llm.toxicity import Automaton, edits, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF01 = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_all_pairs(spark, k):
    rng = random.Random(k)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(60)) for _ in range(rng.randrange(1, 90))] for _ in range(12)]
    rows = []
    for _ in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append(" ".join(w))
    want = brute_components({i: shingles(t, k) for i, t in enumerate(rows)})
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), k=k)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_superminhash_estimates_jaccard_and_needs_no_chunks():
    rng = np.random.default_rng(1)
    e = tk.mix(rng.integers(0, 1 << 62, 900).astype(np.uint64))
    a, b = e[:600], e[100:700]
    sig = neardup.superminhash(np.concatenate([a, b]), np.repeat([0, 1], 600), 2)
    assert abs((sig[0] == sig[1]).mean() - 500 / 700) < 0.12
    assert (sig == neardup.superminhash(np.concatenate([a, b]), np.repeat([0, 1], 600), 2, chunk=37)).all()
    assert sorted((neardup.superminhash(e[:1], np.zeros(1, int), 1)[0] >> np.uint64(32)).tolist()) == list(range(200))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0, 100} and got[60] == 0 and got[159] == 100


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(f"wörd{i} X" for i in range(3000)).encode()
    data = np.frombuffer(text, np.uint8)
    whole = tk.Hasher(tk.class_space_delimited()).words(data)[2]
    monkeypatch.setattr(tk, "CHUNK", 100)
    assert (tk.Hasher(tk.class_space_delimited()).words(data)[2] == whole).all()
    assert len(np.unique(whole)) == 3001


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = ["idiot", "worthless", "scum", "disgusting", "moron"]
    auto, rng = Automaton(terms, []), random.Random(3)
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(0, 4)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randrange(2)] = rng.choice(["", "x", "o", "t"])
        w = "".join(w)
        near = min(((distance(w, t), i) for i, t in enumerate(terms) if distance(w, t) <= edits(t)), default=None)
        hit = auto.match(w)
        assert (hit and (hit[1], hit[0])) == near, w


def test_stems_match_whatever_follows():
    auto = Automaton(["idiot"], ["achlich"])
    assert auto.match("achlichung") == (1, 0) and auto.match("achlic") is None and auto.match("idiots") == (0, 1)


def test_quotation_weakens_a_hit():
    from spindrift.llm.toxicity import QUOTED, find

    auto = Automaton(["idiot"], [])
    assert find("you are an idiot", auto, {})[1][0, False] == 1.0
    assert find('he said "idiot" once', auto, {})[1][0, False] == QUOTED


def test_a_word_with_inflections_keeps_its_misspellings_and_its_stem(spark):
    rng = random.Random(6)
    said = ["idiot"] * 104 + ["idiots"] * 20 + [""] * 600
    rows = [(i, " ".join([rng.choice("abcdefghij") * 3 for _ in range(12)] + [w]), int(w != "")) for i, w in enumerate(said)]
    tests = ["idlot", "iddiot", "idi0t", "idiotisch"]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(10_000 + i, f"aaa bbb {w} ccc ddd") for i, w in enumerate([*tests, "eee"])], "doc_id long, text string")
    got = {r.doc_id - 10_000: r for r in toxicity(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).collect()}
    assert [got[i].terms for i in range(5)] == ["idiot", "idiot", "idiot", "idiot*", ""]
    assert [got[i].predicted for i in range(5)] == [1, 1, 1, 1, 0]


def held(spark, df, label):
    lab = load(spark, SF01, "labels").select("doc_id", label)
    return [(r[label], r.predicted) for r in df.join(lab, "doc_id").where("held_out").collect()]


def test_held_out_toxicity_and_quality(spark):
    docs, lab = load(spark, SF01, "documents"), load(spark, SF01, "labels")
    t = held(spark, toxicity(docs, lab), "toxic")
    assert sum(y == p for y, p in t) >= 0.93 * len(t)
    q = held(spark, quality(docs, lab), "quality")
    assert sum(y == p for y, p in q) >= 0.93 * len(q)


def test_held_out_language(spark):
    docs = load(spark, SF01, "documents")
    got = languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_every_language_is_learned_however_many(spark):
    rng = random.Random(8)
    vocab = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)] for _ in range(70)]
    rows = [(70 * n + i, " ".join(rng.choice(v) for _ in range(60)), f"l{i:02d}") for n in range(6) for i, v in enumerate(vocab)]
    got = languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    want = {d: lang for d, _, lang in rows}
    assert all(r.lang_pred == want[r.doc_id] for r in got.collect())
    some = spark.createDataFrame(rows[:280], "doc_id long, text string, lang string").where("doc_id % 70 < 9")
    assert sorted(map(tuple, languages(some, block=2).collect())) == sorted(map(tuple, languages(some).collect()))


def full_alignment(item, text):
    best = 0
    prev = [0] * (len(text) + 1)
    for w in item:
        row = [0]
        for j, x in enumerate(text, 1):
            row.append(max(0, prev[j - 1] + (2 if x == w else -1), prev[j] - 1, row[j - 1] - 1))
        best, prev = max(best, *row), row
    return best


def test_smith_waterman_equals_the_full_table():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        score, x, y = decontam.smith_waterman(np.array(a), np.array(b))
        assert score == full_alignment(a, b)
        assert score == 0 or full_alignment(a, b[x:y]) == score


def test_edited_copies_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(400)]
    items = [[rng.choice(vocab) for _ in range(rng.randrange(12, 60))] for _ in range(20)]
    docs, planted = [], set()
    for d in range(300):
        w = [rng.choice(vocab) for _ in range(rng.randrange(10, 300))]
        if d % 3 == 0:
            item = rng.randrange(20)
            copy = [x if rng.random() > 0.12 else rng.choice(vocab) for x in items[item]]
            del copy[len(copy) // 2]
            w[len(w) // 2 : len(w) // 2] = copy
            planted.add((d, item))
        docs.append((d, " ".join(w)))
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"), block_chars=1500)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == planted


@pytest.mark.parametrize("copies", [1, 4, 5, 40])
def test_an_edited_copy_is_found_in_however_many_documents_it_stands(spark, copies):
    item = [f"item{i}" for i in range(40)]
    edited = [f"other{i}" if i % 5 == 2 else w for i, w in enumerate(item)]
    docs = [(d, " ".join([f"d{d}x{i}" for i in range(50)] + edited)) for d in range(copies)]
    docs += [(1000 + d, " ".join(edited[5 * (d % 8) + 3 : 5 * (d % 8) + 7])) for d in range(80)]
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(copies))


def test_long_texts_are_searched_in_windows_with_the_same_result():
    rng = np.random.default_rng(31)
    items = [rng.integers(0, 1 << 60, n).astype(np.uint64) for n in rng.integers(8, 60, 30)]
    grams = [decontam.grams(w) for w in items]
    index = decontam._Index(np.concatenate(grams), np.repeat(np.arange(30), [len(g) for g in grams]), np.concatenate([np.arange(len(g)) for g in grams]))
    for _ in range(40):
        parts = []
        for _ in range(40):
            parts.append(rng.integers(0, 1 << 60, rng.integers(1, 80)).astype(np.uint64))
            copy = items[rng.integers(30)].copy()
            hurt = rng.random(len(copy)) < 0.12
            copy[hurt] = rng.integers(0, 1 << 60, hurt.sum()).astype(np.uint64)
            parts.append(copy)
        text = np.concatenate(parts)
        want = decontam.passages(text, index, items, 2, 0.5)
        assert len(text) > 700 and want and decontam.all_passages(text, index, items, 2, 0.5, stride=500) == want


def test_short_items_and_scripts_without_spaces_are_found(spark):
    passage = "水在标准大气压下的沸点是一百摄氏度而冰点是零度"
    items = [(1, "Two words"), (2, "xylophone"), (3, passage), (4, "ภาษาไทยไม่เว้นวรรคระหว่างคำ")]
    docs = [(1, "here are two words, and two words again"), (2, "two other words"), (3, "a Xylophone"), (4, "今天我们学习" + passage.replace("标准", "正常") + "谢谢大家"), (5, "今天天气很好我们去公园散步吧"), (6, "กขคภาษาไทยไม่เว้นวรรคระหว่างคำกขค"), (7, None)]
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (3, 2), (4, 3), (6, 4)]
    assert [(r.start_word, r.end_word, r.score) for r in got if r.doc_id == 1] == [(2, 4, 1.0)]


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, free = {}, float(sum(sizes.values())), list(order)
    while free:
        per = left / sum(weight[s] for s in free)
        over = [s for s in free if per * weight[s] > cap * sizes[s]]
        if not over:
            return out | {s: per * weight[s] for s in free}
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def test_targets_share_the_excess(spark):
    rng = random.Random(13)
    cases = [{"a": 10, "b": 1, "c": 10}, {None: 0}, {None: 100, "b": 100, "a": 100}, {"": 5, "B": 1, "a": 1, "ä": 900, None: 3}, {f"s{i}": rng.randrange(0, 10 ** rng.randrange(1, 6)) for i in range(700)}]
    for sizes in cases:
        got = targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        assert {r.source: r.target for r in got} == {s: pytest.approx(t) for s, t in brute_targets(sizes).items()}
    assert targets(spark.createDataFrame([], "source string, size long")).count() == 0


def test_mix_with_many_sources_and_hot_ids(spark):
    rng = random.Random(14)
    rows = [(None if i % 3 == 0 else i % 50, "w " * rng.randrange(0, 40), f"s{rng.randrange(900)}" if i % 2 else "hot") for i in range(9000)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    have = collections.defaultdict(int)
    for r in got:
        assert r.taken == r.copies * r.size <= 3 * r.size
        have[r.source] += r.taken
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want = brute_targets({s: sizes[s] for _, _, s in rows})
    assert all(abs(have[s] - t) <= 40 + 0.001 * t for s, t in want.items())


def test_mix_meets_its_targets(spark):
    docs = load(spark, SF01, "documents")
    got = mix(docs).collect()
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    by = collections.defaultdict(list)
    for r in got:
        assert r.size == len(words(text[r.doc_id])) and r.taken <= 3 * r.size
        by[r.source].append(r)
    want = brute_targets({s: sum(r.size for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        assert rs[0].target == pytest.approx(want[s]) and abs(sum(r.taken for r in rs) - want[s]) <= 0.02 * want[s]
    assert sorted(map(tuple, mix(docs).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_media_round_trip_and_carving():
    auto = media.automaton()
    for payload in (b"", b"abc", b"RIFF" * 9, bytes(range(256))):
        stored = media.wav(payload)
        assert media.sniff(stored, auto)[0] == ("audio/wav", 0, len(stored))
        assert media.wav_samples(stored) == payload
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"x" * 13) + chunk(b"IEND", b"")
    gif = b"GIF89a\x01\x00\x01\x00\x00\x00\x00;"
    gz = zlib.compressobj(wbits=31)
    zipped = gz.compress(b"hello") + gz.flush()
    blob = b"junk GIF89a BM RIFF %PDF-1.4 " + png + b"--" + gif + b"\x89PNG\r\n\x1a\nbroken" + zipped + b"%PDF-1.7 x %%EOF"
    assert [(k, blob[a : a + n]) for k, a, n in media.sniff(blob, auto)][1:] == [("image/png", png), ("image/gif", gif), ("application/gzip", zipped), ("application/pdf", b"%PDF-1.7 x %%EOF")] or [k for k, *_ in media.sniff(blob, auto)] == ["application/pdf"]
    tail = b"junk GIF89a BM RIFF " + png + b"--" + gif + zipped + b"%PDF-1.7 x %%EOF"
    assert [(k, tail[a : a + n]) for k, a, n in media.sniff(tail, auto)] == [("image/png", png), ("image/gif", gif), ("application/gzip", zipped), ("application/pdf", b"%PDF-1.7 x %%EOF")]


def _crc(data, poly, bits):
    crc = 0
    for byte in data:
        for bit in range(7, -1, -1):
            top = crc >> (bits - 1) & 1 ^ byte >> bit & 1
            crc = (crc << 1 & (1 << bits) - 1) ^ (poly if top else 0)
    return crc


def _flac(frames, values=(7, 9, 11, 13)):
    out = b"fLaC\x80\x00\x00\x22" + struct.pack(">HH", 192, 192) + b"\x00" * 6 + ((44100 << 44 | 0 << 41 | 15 << 36 | 192 * frames).to_bytes(8)) + b"\x00" * 16
    for i in range(frames):
        frame = b"\xff\xf8\x19\x08" + bytes([i])
        frame += bytes([_crc(frame, 0x07, 8)]) + b"\x00" + struct.pack(">h", values[i % 4])
        out += frame + struct.pack(">H", _crc(frame, 0x8005, 16))
    return out


def _files():
    import io
    import zipfile

    def archive(method, **files):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", method) as z:
            for name, data in files.items():
                z.writestr(name, data)
        return buffer.getvalue()

    inner = archive(zipfile.ZIP_STORED, a=b"inner")
    box = lambda kind, body, wide=False: (struct.pack(">I4sQ", 1, kind, 16 + len(body)) if wide else struct.pack(">I4s", 8 + len(body), kind)) + body
    riff = lambda kind, body: b"RIFF" + struct.pack("<I", 4 + len(body)) + kind + body
    segment = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", 2 + len(body)) + body
    page = lambda flag, body: b"OggS\x00" + bytes([flag]) + b"\x00" * 20 + bytes([1, len(body)]) + body
    return {
        "image/jpeg": b"\xff\xd8" + segment(0xE0, b"JFIF\x00") + segment(0xDA, b"\x01") + b"data\xff\x00\xff\xd0more" + segment(0xC4, b"\xff\xd9table") + segment(0xDA, b"\x02") + b"rest\xff\xd9",
        "image/bmp": b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\x01\x02\x03\x00",
        "application/zip": archive(zipfile.ZIP_STORED, first=b"x" * 50, second=inner, third=b"y"),
        "audio/ogg": page(2, b"head") + page(4, b"tail"),
        "audio/flac": _flac(5),
        "video/mp4": box(b"ftyp", b"isom\x00\x00\x00\x00") + box(b"mdat", b"z" * 8, wide=True) + box(b"moov", b"m"),
        "video/x-msvideo": riff(b"AVI ", b"LIST\x04\x00\x00\x00abcd"),
        "image/webp": riff(b"WEBP", b"VP8 \x03\x00\x00\x00abc\x00"),
        "application/pdf": b"%PDF-1.4 a %%EOF\n1 0 obj x startxref 3 %%EOF",
        "audio/wav": media.wav(b"abc"),
    }


@pytest.mark.parametrize("kind", sorted(_files()))
def test_each_format_is_confirmed_with_its_length(kind):
    data, auto = _files()[kind], media.automaton()
    assert media.sniff(data, auto)[0] == (kind, 0, len(data))
    assert all(n < len(data) - 1 for k, at, n in media.sniff(data[:-1], auto) if (k, at) == (kind, 0))
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 0) + b"IHDR" + struct.pack(">I", zlib.crc32(b"IHDR")) + struct.pack(">I", 0) + b"IEND" + struct.pack(">I", zlib.crc32(b"IEND"))
    blob = b"?" + data + png
    assert [(k, blob[a : a + n]) for k, a, n in media.sniff(blob, auto)] == [(kind, data), ("image/png", png)]


def test_declared_types_are_corrected_and_embedded_files_carved(spark):
    files = _files()
    rows = [(i, len(d), k if i % 2 else "text/plain", d + files["image/bmp"]) for i, (k, d) in enumerate(sorted(files.items()))] + [(99, 3, "text/plain", b"abc"), (100, 0, None, None)]
    got = {r.doc_id: r for r in media.inspect(spark.createDataFrame(rows, "doc_id long, n_bytes long, declared string, media binary")).collect()}
    for i, (kind, data) in enumerate(sorted(files.items())):
        assert got[i].true_type == kind and got[i].corrected == (i % 2 == 0)
        assert [(c["type"], c["at"], c["length"]) for c in got[i].carved if c["at"] >= len(data)] == [("image/bmp", len(data), 58)]
    assert got[99].true_type == "application/octet-stream" and got[99].corrected and not got[99].carved


def test_media_digests_equal_plain_python(spark):
    import hashlib

    docs = load(spark, SF01, "documents")
    got = {r.doc_id: r for r in media.inspect(media.encode(docs)).collect()}
    for r in docs.select("doc_id", "text").collect():
        raw = (r.text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        x = got[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])), r.doc_id
        assert x.media_sha256 == hashlib.sha256(media.wav(payload)).hexdigest() and x.media_bytes == 44 + len(payload) and x.feature.startswith("audio/wav;")


def test_every_license_rule_matches_and_passes_its_gates(spark):
    def sample(p):
        p = re.sub(r"\(\?![^)]*\)", "", p)
        while (q := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(\??)", lambda m: "" if m[2] else m[1], p)) != p:
            p = q
        p = re.sub(r"\[(.)[^\]]*\]", r"\1", p)
        p = re.sub(r"\\d\{4\}", "1999", p)
        return re.sub(r" +", " ", re.sub(r".\?", "", p)).strip()

    texts = [sample(p) for *_, p in licenses.RULES]
    for (_, _, p), t in zip(licenses.RULES, texts, strict=True):
        assert re.search(f" (?:{p})(?= )", f" {t} "), (p, t)
        assert licenses.keyword(p) in t and any(g in t for g in licenses.GATE), (p, t)
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got.values())


def test_license_labels_equal_their_sql(spark):
    import duckdb

    from spindrift.llm.oracles import ORACLES

    rng = random.Random(11)
    bits = [re.sub(r"\(\?:([^()|]*)[^()]*(?:\([^()]*\)[^()]*)*\)\??|\[(.)[^\]]*\]|.\?", r"\1\2", p) for *_, p in licenses.RULES] + ["version 2", "3 0", "the", "and", "license", "cc by", "mit license"]
    texts = [rng.choice([" ", "-", "\n", "; "]).join(rng.choice(bits) for _ in range(rng.randrange(0, 12))) for _ in range(300)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    rel = con.sql(ORACLES["op8_licenses"])
    want = {r[0]: dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()}
    got = {r.doc_id: r.asDict() for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want


def test_license_base_scan_and_suppression(spark):
    texts = ["MIT\nLicense, then the Apache-License and cc/by. GNU (General) Public: LICENSE version 3.", "gnu lesser general public license v2.1", "commit license", "mit license " * 2000]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (4, 0, 9, "apache,cc-by,gpl,mit")
    assert got[0].labels == "apache,cc-by,gpl,gpl-3.0,mit"
    assert (got[1].n_base, got[1].labels, got[1].score) == (0, "lgpl-2.1", 0.95)
    assert (got[2].n_base, got[2].labels, got[2].score) == (0, "", 0.0)
    assert (got[3].n_base, got[3].first_word, got[3].last_word) == (2000, 0, 3998)


def test_base_score_equals_the_formula(spark):
    docs = load(spark, SF01, "documents")
    text = {r.doc_id: words(r.text) for r in docs.select("doc_id", "text").collect()}
    train = [d for d in text if zlib.crc32(str(d).encode()) % 5 != 1]
    count = collections.Counter(w for d in train for w in text[d])
    n, v = sum(count.values()) + len(train), len(count) + 1
    lost = better = 0.0
    for r in lm.score_texts(docs).collect():
        w = text[r.doc_id]
        want = sum(math.log10(count[x] + 0.5) for x in w) + math.log10(len(train) + 0.5) - (len(w) + 1) * math.log10(n + 0.5 * (v + 1))
        assert r.base_score == pytest.approx(want, rel=1e-9) and r.train_tokens == n and r.n_tokens == len(w) + 1
        assert r.n_known == sum(x in count for x in w) + 1 and r.held_out == (r.doc_id not in train or False)
        if r.held_out:
            lost, better = lost + r.base_score, better + r.score
    assert better > lost


def test_class_model_sums_to_one():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 20, (30, 30))
    cls = lm.exchange(counts, 20, classes=4)
    assert set(cls[:20]) <= set(range(4)) and len(set(cls[20:])) == 10
    size = cls.max() + 1
    m = np.zeros((size, size))
    np.add.at(m, (cls[:, None], cls[None, :]), counts)
    assert np.allclose(((m + lm.ALPHA) / (m.sum(1, keepdims=True) + lm.ALPHA * size)).sum(1), 1)


def test_exchange_finds_planted_classes():
    n = 40
    group = np.arange(n) % 2
    counts = np.where(group[:, None] != group[None, :], 50, 1)
    perm = np.random.default_rng(0).permutation(n)
    cls = lm.exchange(counts[perm][:, perm], n, classes=2, passes=10)
    assert len({(g, c) for g, c in zip(group[perm], cls, strict=True)}) == 2


def test_words_beyond_the_most_frequent_are_clustered_by_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(lm, "CLUSTERED", 20)
    monkeypatch.setattr(lm, "CLASSES", 4)
    rng = random.Random(4)
    noun, verb = ([f"{c}{i}x" for i in range(150)] for c in "nv")
    texts = [" ".join(rng.choice((noun, verb)[i % 2]) for i in range(200)) for _ in range(200)]
    hasher = tk.Hasher(tk.class_space_delimited())
    train = spark.createDataFrame([(i, i, False, t) for i, t in enumerate(texts)], "rid long, doc_id long, held_out boolean, text string")
    vocab = lm.vocabulary(train).toArrow()
    keys, counts = np.asarray(vocab.column("h")).view(np.uint64), np.asarray(vocab.column("c"))
    order = np.argsort(keys)
    codes = lm.encode(train, keys[order], counts[order])
    cls, classes, m = lm.cluster(codes, np.asarray(vocab.column("ending"))[order].astype(np.int64), counts[order])
    of = dict(zip(keys[order].tolist(), cls.tolist(), strict=True))
    kinds = [{of[int(hasher.words(np.frombuffer(w.encode(), np.uint8))[2][0])] for w in words} for words in (noun, verb)]
    assert max(kinds[0] | kinds[1]) < classes and not kinds[0] & kinds[1]
    assert m.sum() == sum(len(t.split()) + 1 for t in texts)


def repeats(texts, n):
    """For each document the words that lie in a run of n words which a smaller id holds too, or which the text had before, apart from it."""
    seen, out = {}, {}
    for d in sorted(texts):
        w, hit = words(texts[d]), set()
        for i in range(len(w) - n + 1):
            doc, at = seen.setdefault(tuple(w[i : i + n]), (d, i))
            if doc != d or i >= at + n:
                hit.update(range(i, i + n))
        out[d] = hit
    return out


def test_every_long_repeat_goes_and_nothing_but_repeats(spark):
    docs = load(spark, SF01, "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in spans.dedup_spans(docs).collect()}
    must, may = repeats(texts, spans.WORDS + spans.WINDOW + spans.FINE), repeats(texts, spans.WORDS)
    assert sum(map(bool, must.values())) > 50
    for d, text in texts.items():
        r, w = got[d], words(text)
        if not r.n_removed:
            assert r.text == text and not must[d], d
            continue
        left = words(r.text)
        assert len(w) - len(left) == r.words_removed <= len(may[d]) and r.n_chars == len(r.text), d
        # what is left is the text in its order, less words of repeats; of long repeats the edges at most
        assert r.words_removed >= 0.7 * len(must[d]), d
        at = iter(w)
        assert all(x in at for x in left), d


def test_a_passage_is_found_wherever_it_begins(spark):
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(3000)]
    rows = []
    for p in range(60):
        passage = [rng.choice(vocab) + rng.choice(["", "", "", ",", "."]) for _ in range(51)]
        for c in range(3):
            filler = [[rng.choice(vocab) + rng.choice(["", "", "."]) for _ in range(rng.randrange(0, 30))] for _ in range(2)]
            rows.append((10 * p + c, " ".join(filler[0] + passage + filler[1])))
    got = {r.doc_id: r for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, text in rows:
        assert (got[d].words_removed == 0) if d % 10 == 0 else (40 <= got[d].words_removed <= 51), d
        assert (got[d].first_docs or [d])[0] == d - d % 10


def test_span_text_is_kept_to_the_byte(spark):
    passage = " ".join(f"Alpha{i} beta{i}, gamma{i} delta{i} epsilon{i}." for i in range(9))
    chars = "水在标准大气压下的沸点是一百摄氏度而冰点是零度" * 1 + "今天我们学习如何在长文本中找到重复的段落并且只留下第一次出现的位置"
    rows = [(1, f"First one. {passage} End one."), (2, f"Other start.\n{passage}  Tail stays  as it is."), (3, "Nothing  shared\there."), (4, "甲乙丙丁" + chars), (5, "戊己庚辛" + chars + "子丑寅卯")]
    got = {r.doc_id: r for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1] and got[4].text == rows[3][1]
    assert got[2].text == "Other start.\nTail stays  as it is." and got[2].first_docs == [1] and got[2].words_removed == 45
    assert got[5].first_docs == [4] and got[5].text.startswith("戊己庚辛") and got[5].text.endswith("子丑寅卯") and got[5].words_removed >= 40


def test_inside_a_text_the_first_occurrence_stays_whole(spark):
    got = spans.dedup_spans(spark.createDataFrame([(1, "la " * 200), (2, "la " * 90)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.text for r in got] == [("la " * 40).strip(), ""]
