"""Collocations, source divergence and language identification against brute force on small fixtures."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("loomline.llm")

from loomline.llm import collocations, language_id, source_divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows() -> list[tuple]:
    rng = random.Random(3)
    words = ["the", "of", "New", "York", "ÉTÉ", "été", "x1", "x_1", "don't", "a\x00b", "\x85", "İstanbul", "日本", "new\x0byork"] + [f"w{chr(97 + i)}" for i in range(12)]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(n))
    out = [(text(rng.randint(0, 120)), rng.choice(["en", "en", "de", None, ""]), rng.choice(["s0", "s0", "s1", "s2", None])) for _ in range(90)]
    out += [(None, "en", "nothing"), ("", "fr", "s0"), ("123 !!", "fr", "s1"), (None, None, None), ("New York City hall " * 300, "en", "s1"), ("New York City hall " * 300, "en", "s1"), ("a a a a a a " * 60, "de", "s9"), ("the " * 5000, "en", "s0")]
    return [(i, *r, "extra") for i, r in enumerate(out)]


ROWS = rows()
SCHEMA = "doc_id long, text string, lang string, source string, term string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("n", F.lit(7)).withColumn("idx", F.lit("x")).repartition(3)


def plain_collocations(docs: list[tuple], least: int, first: int) -> set[tuple]:
    f: dict[str, Counter] = defaultdict(Counter)
    n: Counter = Counter()
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f[lang].update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer: Counter = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        scored = []
        for p, a in candidates.items():
            if not (p in longer and 100 * longer[p] >= 80 * a):
                score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:first], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


@pytest.mark.parametrize(("least", "first", "group"), [(5, 2000, 1 << 20), (2, 10, 200)])
def test_collocations(docs, monkeypatch, least, first, group):
    monkeypatch.setattr(collocations, "GROUP_BYTES", group)
    got = collocations.collocations(docs, least=least, first=first).collect()
    assert {tuple(r) for r in got} == plain_collocations(ROWS, least, first) and len(got) == len({(r.lang, r.rank) for r in got})


def test_frequent_leads_are_spread(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["of", "of the", f"w{rng.randrange(50)}"]) for _ in range(400)), "en", "s", "") for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    words, pairs = collocations.frequent_leads(docs.select("lang", "text"), 4)
    assert b"of" in words["en"] and b"w1" not in words["en"] and (b"of", b"the") in pairs["en"]
    assert {tuple(r) for r in collocations.collocations(docs, least=10).collect()} == plain_collocations(rows, 10, 2000)


def test_windows_of_many_words():
    text = " ".join(f"w{i}" for i in range(70_000)).encode()
    words, windows = collocations.lead_windows(text + b" w0 w1 w2 w3")
    different, n = collocations.summed(windows, None, len(words) + 1)
    assert n.sum() == 70_004 and len(different) == 70_003 and n[0] == 2
    both, n = collocations.summed(np.concatenate([windows, windows]), None, len(words) + 1)
    assert n.tolist() == [4, *[2] * 70_002] and (both == different).all()


def plain_divergence(docs: list[tuple], least: int, most: int) -> set[tuple]:
    times, holders, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in docs:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        times[lang, source].update(terms)
        holders[lang].update(set(terms))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = {t for t, n in holders[lang].items() if n >= least}
        share = lambda own: {t: 1 + 10**9 * (own[t] + 5) // (sum(own[x] for x in kept) + 5 * len(kept)) for t in kept}
        p = {s: share(times[lang, s]) for s in sources}
        q = share(sum((times[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[x][t]) for t in kept), x.encode()) for x in sources - {s}]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if times[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out |= {(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize(("least", "most", "tile", "rows", "block"), [(10, 50, 128, 100_000, 2048), (2, 3, 2, 20, 7)])
def test_divergence(docs, monkeypatch, least, most, tile, rows, block):
    for name, value in (("TILE", tile), ("SHARD_ROWS", rows), ("BLOCK", block)):
        monkeypatch.setattr(source_divergence, name, value)
    got = source_divergence.divergence(docs, least=least, most=most, held=50).collect()
    assert {tuple(r) for r in got} == plain_divergence(ROWS, least, most) and len(got) == len(set(got))


def test_divergence_of_large_counts(spark):
    rows = spark.createDataFrame([(2**62, 4 * 10**18, 3)], "a long, n long, v long").select(source_divergence.smoothed("a", "n", "v").alias("p")).first()
    assert rows.p == 1 + 10**9 * (2**62 + 5) // (4 * 10**18 + 15)


def plain_bundle(text: str) -> np.ndarray | None:
    out, found = np.zeros(language_id.WIDTH, np.int64), False
    for word in re.split("\0", "".join(c if c.isalpha() else "\0" for c in text.lower())):
        letters = [0, *map(ord, word), 0]
        for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
            found = True
            out += np.roll(language_id.letter_vector(a), 2) * np.roll(language_id.letter_vector(b), 1) * language_id.letter_vector(c)
    return out if found else None


def language_rows() -> list[tuple]:
    rng = random.Random(2)
    of = {"en": ["the", "thing", "with", "Hath", "ing"], "fr": ["que", "été", "Leaux", "des", "pour"], "ja": ["日本", "東京", "語です"], "el": ["ΟΔΟΣ", "λόγος", "Σίσυφος"]}
    texts = [(" ".join(rng.choice(of[x]) for _ in range(rng.randint(1, 30))) + rng.choice([".", " 12", "", "\n\n|"]), x) for x in rng.choices(sorted(of), k=120)]
    return [(i, *r) for i, r in enumerate([*texts, (None, "en"), ("", "en"), ("12 !!", "fr"), ("the thing", None), ("𝒜 ŀ ß İ", "en"), ("a", "xx"), ("que " * 30_000, "fr"), ("the thing", "en"), ("the thing", "en")])] + [(None, "the thing", "en")]


def test_language_id(spark):
    rows = language_rows()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, score int, place int").repartition(5)
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 0
    sums: dict[str, np.ndarray] = {}
    for i, text, lang in rows:
        if not held(i) and lang is not None and text is not None and (own := plain_bundle(text)) is not None:
            sums[lang] = sums.get(lang, 0) + own
    learned = {(r.lang, r.place): r.total for r in language_id.prototypes(docs.select("doc_id", "text", "lang").filter(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) != 0).filter("lang is not null and text is not null").select("text", "lang")).collect()}
    assert learned == {(x, k): v for x, total in sums.items() for k, v in enumerate(total.tolist())}
    got = language_id.identify(docs)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    found = sorted(got.collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id))
    wrong = 0
    for r, (i, text, lang) in zip(found, sorted(rows, key=lambda r: (-1 if r[0] is None else r[0])), strict=True):
        own = plain_bundle(text) if text is not None else None
        assert (r.doc_id, r.held_out) == (i, held(i))
        if own is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosine = {x: own @ v / np.sqrt((own @ own) * float((v.astype(float) ** 2).sum())) for x, v in sums.items()}
        assert r.lang_pred == max(cosine, key=cosine.get) and r.score == pytest.approx(min(1, max(0, max(cosine.values()))))
        wrong += i is not None and i < 120 and held(i) and r.lang_pred != lang
    assert wrong == 0


def test_languages_block_after_block(spark, monkeypatch):
    docs = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string").repartition(3)
    whole = sorted(language_id.identify(docs).collect(), key=repr)
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    assert sorted(language_id.identify(docs).collect(), key=repr) == whole


def test_many_letters_at_once(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(60)) for _ in range(5)]
    monkeypatch.setattr(language_id, "BLOCK", 50)
    got = language_id.bundles(*language_id.triples_of(texts), len(texts))
    assert all((a == plain_bundle(t)).all() for a, t in zip(got, texts, strict=True))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for operator in (collocations.collocations, source_divergence.divergence, language_id.identify):
        assert operator(docs).collect() == []
    unlabelled = spark.createDataFrame([(1, "some text", None, None, None)], SCHEMA)
    assert [(r.lang_pred, r.score) for r in language_id.identify(unlabelled).collect()] == [("und", 0.0)]
