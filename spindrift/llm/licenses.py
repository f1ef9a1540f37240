"""License scan by ordered signature rules, in built-in functions only.

Texts without any license keyword are told apart by substring tests and cost nothing more.  The others are
reduced to their words, one space before and after each; a rule is run where its own keyword occurs.
Each occurrence is an interval of words with the rule's rank; an interval inside one of equal or higher
rank that starts no later is suppressed, in one sweep over the sorted intervals.  All of it is one
projection: no shuffle, no Python, and a document of any length is handled in its own row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.cluster import columns_only

#: Fixed values of the base scan: phrases in words, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Bytes between words.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Every match of a rule or a base phrase holds one of these (lower case).
GATE = ("licen", "copyright", "public", "creative", "reserved", "redistribut", "warrant", "copyleft", "permission", "attribution", "bsd", "cc")
_V = r"(?: version| v)? ?"
_THE = r"(?: the)?"


def _family(label: str, name: str, short: str, versions: tuple[str, ...] = (), spaced: bool = True) -> list[tuple[str, int, str]]:
    """The rules of a license family: full name (rank 3) with each version, SPDX tag, notice of licensing (2), short name (1)."""
    rules = [(label, 2, name), (label, 2, f"licensed under{_THE} {name}"), (label, 1, f"{short} licensed?"), (label, 2, f"spdx license identifier {short}")]
    for v in versions:
        at = v.replace(".", " ")
        tag = f"{label}-{v}"
        rules += [(tag, 3, f"{name}{_V}{at}"), (tag, 3, f"{short}(?: version| v)? ?{at}(?: (?:only|or later))? licensed?"), (tag, 3, f"spdx license identifier {short} {at}(?: (?:only|or later))?"), (tag, 3, f"licensed under{_THE} {short}{_V}{at}")]
        if v.endswith(".0") and v.count(".") == 1:
            rules.append((tag, 2, f"{name}{_V}{v[:-2]}"))
    return rules


#: (label, rank, pattern over words joined by one space); matched between words.
RULES: list[tuple[str, int, str]] = [
    *_family("gpl", "gnu general public licen[cs]e", "gpl", ("1.0", "2.0", "3.0")),
    *_family("lgpl", "gnu (?:lesser|library) general public licen[cs]e", "lgpl", ("2.0", "2.1", "3.0")),
    *_family("agpl", "gnu affero general public licen[cs]e", "agpl", ("1.0", "3.0")),
    *_family("gfdl", "gnu free documentation licen[cs]e", "gfdl", ("1.1", "1.2", "1.3")),
    *_family("apache", "apache (?:software )?licen[cs]e", "apache", ("1.0", "1.1", "2.0")),
    *_family("mpl", "mozilla public licen[cs]e", "mpl", ("1.0", "1.1", "2.0")),
    *_family("epl", "eclipse public licen[cs]e", "epl", ("1.0", "2.0")),
    *_family("cddl", "common development and distribution licen[cs]e", "cddl", ("1.0", "1.1")),
    *_family("eupl", "european union public licen[cs]e", "eupl", ("1.0", "1.1", "1.2")),
    *_family("osl", "open software licen[cs]e", "osl", ("1.0", "2.0", "3.0")),
    *_family("afl", "academic free licen[cs]e", "afl", ("1.2", "2.0", "3.0")),
    *_family("artistic", "(?:perl )?artistic licen[cs]e", "artistic", ("1.0", "2.0")),
    *_family("bsl", "boost software licen[cs]e", "bsl", ("1.0",)),
    *_family("cpl", "common public licen[cs]e", "cpl", ("1.0",)),
    *_family("ms-pl", "microsoft public licen[cs]e", "ms pl"),
    *_family("ms-rl", "microsoft reciprocal licen[cs]e", "ms rl"),
    *_family("isc", "isc licen[cs]e", "isc"),
    *_family("zlib", "zlib(?: libpng)? licen[cs]e", "zlib"),
    *_family("ncsa", "university of illinois ncsa open source licen[cs]e", "ncsa"),
    *_family("psf", "python software foundation licen[cs]e", "psf", ("2.0",)),
    *_family("php", "php licen[cs]e", "php", ("3.0", "3.01")),
    *_family("ofl", "sil open font licen[cs]e", "ofl", ("1.0", "1.1")),
    *_family("odbl", "open database licen[cs]e", "odbl", ("1.0",)),
    *_family("odc-by", "open data commons attribution licen[cs]e", "odc by", ("1.0",)),
    *_family("cecill", "cecill(?: free software)? licen[cs]e", "cecill", ("1.0", "2.0", "2.1")),
    *_family("lppl", "latex project public licen[cs]e", "lppl", ("1.0", "1.2", "1.3")),
    *_family("qpl", "q public licen[cs]e", "qpl", ("1.0",)),
    *_family("sleepycat", "sleepycat licen[cs]e", "sleepycat"),
    *_family("sspl", "server side public licen[cs]e", "sspl", ("1.0",)),
    *_family("busl", "business source licen[cs]e", "busl", ("1.1",)),
    *_family("openrail", "(?:bigscience |creativeml )?open ?rail(?: m)? licen[cs]e", "openrail"),
    *_family("wtfpl", "do what the fuck you want to public licen[cs]e", "wtfpl", ("2.0",)),
    *_family("bsd", "bsd(?: style)? licen[cs]e", "bsd"),
    ("mit", 2, "mit(?: x11| expat)? licen[cs]e"),
    ("mit", 2, "spdx license identifier mit"),
    ("mit", 2, "licensed under(?: the)? mit"),
    ("mit", 3, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-0", 3, "mit no attribution(?: licen[cs]e)?"),
    ("x11", 2, "x11 licen[cs]e"),
    ("bsd-2-clause", 3, "bsd 2 clause(?: (?:simplified|freebsd))?(?: licen[cs]e)?"),
    ("bsd-2-clause", 3, "(?:simplified|freebsd) bsd licen[cs]e"),
    ("bsd-2-clause", 3, "2 clause bsd(?: licen[cs]e)?"),
    ("bsd-3-clause", 3, "bsd 3 clause(?: (?:new|revised))?(?: licen[cs]e)?"),
    ("bsd-3-clause", 3, "(?:new|revised|modified) bsd licen[cs]e"),
    ("bsd-3-clause", 3, "3 clause bsd(?: licen[cs]e)?"),
    ("bsd-4-clause", 3, "(?:original|4 clause) bsd licen[cs]e"),
    ("bsd", 2, "redistribution and use in source and binary forms with or without modification"),
    ("0bsd", 3, "(?:0bsd|zero clause bsd)(?: licen[cs]e)?"),
    ("unlicense", 2, "(?:the )?unlicense"),
    ("public-domain", 2, "(?:released|dedicated|placed) (?:in|in to|into|to)(?: the)? public domain"),
    ("public-domain", 1, "public domain"),
    ("pddl", 3, "public domain dedication and licen[cs]e"),
    ("cc0", 3, "cc0(?: 1 0)?(?: universal)?"),
    ("cc0", 3, "creative commons zero"),
    *[(f"cc-{kind}", 3, f"creative commons {name}") for kind, name in (("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative)?s"), ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s"))],
    *[(f"cc-{kind}", 2, f"cc {kind.replace('-', ' ')}") for kind in ("by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")],
    *[(f"cc-{kind}-{v}", 3, f"cc {kind.replace('-', ' ')} {v.replace('.', ' ')}") for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")],
    ("creative-commons", 1, "creative commons(?: licen[cs]e)?"),
    ("proprietary", 2, "all rights reserved"),
    ("proprietary", 2, "proprietary(?: software)? licen[cs]e"),
    ("proprietary", 2, "end user licen[cs]e agreement"),
    ("proprietary", 2, "not be (?:reproduced|redistributed|copied) without(?: prior)?(?: written)? permission"),
    ("commercial", 2, "commercial licen[cs]e"),
    ("copyright-notice", 1, "copyright(?: c)? \\d{4}(?: \\d{4})?"),
    ("warranty-disclaimer", 1, "as is without(?: any)? warrant(?:y|ies)"),
    ("copyleft", 1, "(?:strong |weak )?copyleft"),
    ("shareware", 2, "shareware licen[cs]e"),
    ("freeware", 2, "freeware licen[cs]e"),
    ("dual-license", 1, "dual licensed"),
    ("open-source", 1, "open source licen[cs]e"),
    ("spdx", 1, "spdx license identifier"),
]


def keyword(pattern: str) -> str:
    """The longest text that every match of a rule's pattern holds."""
    plain = re.sub(r"\(\?:(?:[^()]|\([^()]*\))*\)\??|\[[^\]]*\]|\\d(?:\{\d\})?", "\n", pattern)
    plain = re.sub(r".\?", "\n", plain)
    return max((p.strip() for p in plain.split("\n")), key=len)


def _starts(words: Column, pattern: Column) -> Column:
    """array<struct<start, n>> of the places of ``pattern`` in ``words``, in words; linear in the text.

    A mark is put before each match, that is behind the word before it, whose number is then the start.
    """
    found = F.regexp_extract_all(words, pattern, F.lit(0))
    marked = F.split(F.regexp_replace(words, pattern, F.lit("\u0001$0")), " ", -1)
    starts = F.filter(F.transform(marked, lambda w, i: F.when(F.endswith(w, F.lit("\u0001")), i)), lambda i: i.isNotNull())
    return F.zip_with(starts, found, lambda i, m: F.struct(i.alias("start"), (F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit("")))).alias("n")))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of ``docs``.

    n_base counts all places of the base phrases, first_word and last_word are their least and greatest
    starts in words; base_labels and labels are distinct, sorted and joined by commas, empty if there are
    none; the score is 0 without a label, else 0.5, 0.8 or 0.95 by the highest rank.  Null texts are
    empty; of equal intervals the higher rank stays, of equal ranks all labels do; repeated rows are
    scanned each; an empty table gives an empty result; extra columns are ignored.  A text of any length is
    scanned whole, in time linear in it for each rule that it matches.
    """
    rules = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(rank).alias("rank"), F.lit(keyword(p)).alias("key"), F.lit(f" (?:{p})(?= )").alias("re")) for label, rank, p in RULES])
    base = F.lit(" (?:" + "|".join(BASE) + ")(?= )")
    text = columns_only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = text.withColumn("low", F.lower("text"))
    seen = F.lit(False)
    for k in GATE:
        seen = seen | F.contains("low", F.lit(k))
    words = F.when(seen, F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), BETWEEN, " ")), F.lit(" ")))
    text = text.select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), words.alias("words"))
    places = _starts(F.col("words"), base)
    names = F.regexp_extract_all("words", base, F.lit(0))
    named = F.transform(names, lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv]), F.trim(m)))
    hits = F.flatten(F.transform(
        F.filter(rules, lambda r: F.contains(F.col("words"), r["key"]) & F.rlike(F.col("words"), r["re"])),
        lambda r: F.transform(_starts(F.col("words"), r["re"]), lambda p: F.struct(p["start"].alias("start"), (-p["start"] - p["n"]).alias("minus_end"), (-r["rank"]).alias("minus_rank"), r["label"].alias("label"))),
    ))
    got = text.withColumn("places", places).withColumn("named", F.array_sort(F.array_distinct(named))).withColumn("hits", F.array_sort(hits))
    # one sweep: e1..e3 are the furthest ends so far of intervals of rank 1.. or more; ties of a whole interval and rank stay together
    none = F.struct(*[F.lit(-1).alias(f"e{r}") for r in (1, 2, 3)], F.lit(0).alias("top"), F.array().cast("array<string>").alias("out"), F.struct(F.lit(-1).alias("start"), F.lit(1).alias("minus_end"), F.lit(1).alias("minus_rank")).alias("last"))

    def sweep(acc, h):
        rank, end = -h["minus_rank"], -h["minus_end"]
        reach = F.when(rank == 1, acc["e1"]).when(rank == 2, acc["e2"]).otherwise(acc["e3"])
        tie = (acc["last"]["start"] == h["start"]) & (acc["last"]["minus_end"] == h["minus_end"]) & (acc["last"]["minus_rank"] == h["minus_rank"])
        keep = tie | (reach < end)
        return F.struct(
            *[F.when(keep & (rank >= r), F.greatest(acc[f"e{r}"], end)).otherwise(acc[f"e{r}"]).alias(f"e{r}") for r in (1, 2, 3)],
            F.when(keep, F.greatest(acc["top"], rank)).otherwise(acc["top"]).alias("top"),
            F.when(keep, F.array_union(acc["out"], F.array(h["label"]))).otherwise(acc["out"]).alias("out"),
            F.when(keep, F.struct(h["start"], h["minus_end"], h["minus_rank"])).otherwise(acc["last"]).alias("last"),
        )

    got = got.withColumn("swept", F.aggregate("hits", none, sweep))
    empty = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union(F.coalesce("named", empty), F.coalesce(F.col("swept.out"), empty)))
    top = F.greatest(F.coalesce(F.col("swept.top"), F.lit(0)), F.when(F.size("places") > 0, 2).otherwise(0))
    return got.select(
        "doc_id", "n_words",
        F.greatest(F.coalesce(F.size("places"), F.lit(0)), F.lit(0)).cast("long").alias("n_base"),
        F.get("places", F.lit(0))["start"].cast("long").alias("first_word"),
        F.get("places", F.size("places") - 1)["start"].cast("long").alias("last_word"),
        F.coalesce(F.array_join("named", ","), F.lit("")).alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.element_at(F.array(F.lit(0.0), F.lit(0.5), F.lit(0.8), F.lit(0.95)), top + 1).alias("score"),
    )
