"""The operators on small fixtures, against brute force, with nulls, empty texts, ties and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("loomline.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from loomline.llm import bpe_codec, context_mixing, decontamination, jaccard_join, line_dedup, pu_classifier, quality_rules, substring_dedup, token_counts, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    words = ["the", "of", "Alpha", "beta", "gamma,", "délta", "x1", "|", "YES!!", "été"] + [f"w{i}" for i in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = prose(120), prose(20)
    out = [None, "", " \n\t ", "one", base, base, base + " tail", base.replace("the", "THE"), prose(30) + " " + passage + " " + prose(40), passage, prose(8) + "\n" + passage + "\n" + prose(9), "same line of text here\nother " + prose(3) + "\nSAME line of text here  \n", " same line of text here", "a b c d", "a b c d", "spam " * 400, prose(3000), "<|endoftext|> x <|endoftext|>", "naïve 🙂  café\r\n\x0b\x0cend\x00"]
    docs = base.split()
    for i in range(8):
        near = list(docs)
        near[i * 7] = "edited"
        out.append(" ".join(near))
    return list(enumerate(out))


DOCS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i, "en", i * 2) for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, row long, lang string, rest long").repartition(3)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def plain(t):
    return (t or "").encode()


def test_quality_rules(docs):
    got = by_id(quality_rules.quality_rules(docs))
    for i, t in DOCS:
        w = plain(t).split()
        wins = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {j + k for j, win in enumerate(zip(w, w[1:], w[2:], strict=False)) if wins[win] > 1 for k in range(3)}
        lines = [x for x in plain(t).split(b"\n") if x.split()]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"))
        assert (r.n_repeat_words, r.n_dup_lines) == (len(hit), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert not got[15].kept and got[16].kept
    carried = quality_rules.quality_rules(docs, carry=True).filter("kept").first()
    assert carried.rest.rest == carried.doc_id * 2 and carried.text


def test_compression_bands_reject_noise_and_repetition():
    import zstandard

    c, bands, rng = zstandard.ZstdCompressor(level=3), quality_rules.Bands(), random.Random(1)
    noise = base64.b64encode(rng.randbytes(9000))
    assert not quality_rules.compression_verdict(b"again and " * 900, bands, c)[0]
    assert not quality_rules.compression_verdict(rng.randbytes(9000), bands, c)[0]
    words = [rng.randbytes(rng.randint(1, 4)).hex().encode() for _ in range(400)]
    prose = b" ".join(rng.choice(words) for _ in range(6000))
    assert quality_rules.compression_verdict(prose, bands, c)[0]
    assert not quality_rules.compression_verdict(prose[:9000] + b"z" * 30000, bands, c)[0]
    assert len(noise) > 0


def test_compression_bands_reject_encoded_data_and_one_odd_chunk():
    import zstandard

    c, bands, rng = zstandard.ZstdCompressor(level=3), quality_rules.Bands(), random.Random(8)
    fits = lambda t: quality_rules.compression_verdict(t, bands, c)[0]
    for size in (1500, 3000, 5000, 10_000, 40_000):
        assert not fits(base64.encodebytes(rng.randbytes(size))[:size])
    for size in (6000, 12_000, 40_000):
        digits = rng.randbytes(size).hex()
        assert not fits("\n".join(digits[i : i + 64] for i in range(0, size, 64)).encode())
    words = [rng.randbytes(rng.randint(1, 4)).hex().encode() for _ in range(400)]
    long = b" ".join(rng.choice(words) for _ in range(4000))
    prose = long[: 4 * 4096]
    assert all(fits(long[:size]) for size in (600, 1500, 2500, 4000, 9900, 4 * 4096, 4 * 4096 + 1800))
    assert not fits(prose[:4096] + (b"again and " * 410)[:4096] + prose[8192:])
    assert not fits(prose[:8192] + base64.encodebytes(rng.randbytes(4096))[:4096] + prose[12_288:])
    assert not fits(prose + b"again and " * 60)  # only the last, partial chunk
    assert not fits(b"again and " * 60)


def test_tokens_and_round_trip(docs):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(PATH)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in DOCS}
    counts = by_id(token_counts.token_counts(docs, PATH, limit=50))
    decoded = by_id(bpe_codec.decode(bpe_codec.encode(docs, PATH), PATH))
    for i, t in DOCS:
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len(plain(t)), len(want[i]), len(want[i]) > 50)
        assert bytes(decoded[i].ids) == b"".join(x.to_bytes(4, "little") for x in want[i])
        assert decoded[i].text == library.decode(want[i], skip_special_tokens=False)
    both = by_id(bpe_codec.round_trip(docs, PATH))
    assert {i: tuple(r) for i, r in both.items()} == {i: tuple(r) for i, r in decoded.items()}


def test_tokens_of_odd_characters():
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(PATH)
    rng = random.Random(3)
    odd = [" ", "  ", "\n", "'s", "'ll", "a", "1", "é", "!", "　", "\x1c", "\x85", "՘", "\U00013777", "<|endoftext|>", "ひ", "🙂", "\t"]
    many = ["".join(rng.choice(odd) for _ in range(rng.randint(1, 25))) for _ in range(500)]
    count, encoder = token_counts.Counter(PATH), bpe_codec.Encoder(PATH)
    want = [library.encode(t, add_special_tokens=False).ids for t in many]
    assert [count(t) for t in many] == [len(x) for x in want]
    assert encoder(many) == [b"".join(x.to_bytes(4, "little") for x in ids) for ids in want]


def test_pair_index_is_bounded(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(PATH)
    rng, sizes = random.Random(5), []
    texts = [" ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(20_000)) for _ in range(12)] + ["", "x" * 5000]

    class Seen(bpe_codec.PairIndex):
        def __init__(self, tokens, vocab):
            sizes.append(sum(map(len, tokens)))
            super().__init__(tokens, vocab)

    monkeypatch.setattr(bpe_codec, "PairIndex", Seen)
    want = [b"".join(x.to_bytes(4, "little") for x in library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert bpe_codec.Encoder(PATH)(texts) == want
    assert sum(sizes) > 2 << 20 and max(sizes) <= 1 << 20
    monkeypatch.setattr(bpe_codec, "INDEX_BYTES", 64)
    small = [t[:3000] for t in texts]
    assert bpe_codec.Encoder(PATH)(small) == [b"".join(x.to_bytes(4, "little") for x in library.encode(t, add_special_tokens=False).ids) for t in small]


def test_pair_index_of_long_and_repeated_pieces(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(PATH)
    rng = random.Random(9)
    letters = "etaoinshrdlu"
    many = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    many += ["a" * n for n in (1, 2, 3, 31, 5000)] + ["=" * 70_000, "ab" * 40_000, "é" * 999, "!?" * 300] + [" ".join(many[:900])]
    want = [b"".join(x.to_bytes(4, "little") for x in library.encode(t, add_special_tokens=False).ids) for t in many]
    for few in (0, 24, 10**9):  # all lists as arrays, as in use, all place by place
        monkeypatch.setattr(bpe_codec, "_FEW", few)
        assert bpe_codec.Encoder(PATH)(many) == want


def test_decode_bytes_that_are_no_text(spark):
    vocab = bpe_codec.vocabulary(PATH)
    ids = [vocab.first[b] for b in (0xFF, 0x61, 0xC3)]
    rows = [(1, b"".join(x.to_bytes(4, "little") for x in ids)), (2, None), (3, b"")]
    got = by_id(bpe_codec.decode(spark.createDataFrame(rows, "doc_id long, ids binary"), PATH))
    assert (got[1].text, got[2].text, got[3].text) == ("\ufffda\ufffd", "", "")


def test_substring_dedup(docs):
    first: dict = {}
    words = {i: plain(t).split() for i, t in DOCS}
    for i in sorted(words):
        for j in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][j : j + 13]), i)
    got = by_id(substring_dedup.substring_dedup(docs))
    for i, w in words.items():
        gone = {j + k for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for k in range(13)}
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone))
        assert got[i].text.encode() == b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert sum(r.end - r.start for r in got[i].repeats) == len(gone)


def test_substring_dedup_of_strided_and_missing_ids(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        if i % 3:
            w[5:5] = words[:15]
        rows.append((None if i % 7 == 0 else (30 - i) * 64, " ".join(w)))
    first: dict = {}
    for i, t in sorted((i, t) for i, t in rows if i is not None):
        w = t.split()
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    got = Counter((r.doc_id, r.text, r.n_removed) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = Counter()
    for i, t in rows:
        w = t.split()
        gone = {j + k for j in range(len(w) - 12) if i is not None and first[tuple(w[j : j + 13])] < i for k in range(13)}
        want[i, " ".join(x for j, x in enumerate(w) if j not in gone), len(gone)] += 1
    assert got == want


def test_prefix_groups_have_no_upper_limit():
    import numpy as np

    census = np.zeros(1 << substring_dedup.CODE_BITS, np.int64)
    census[5] = 10**9
    first, parts = substring_dedup.prefix_groups(census, 10**6)
    assert parts[5] == 1000 and first[6] == 1000


def test_line_dedup_is_reversible(spark, docs):
    def key(line):
        k = line.strip(b" \t\n\x0b\x0c\r").translate(LOWER)
        return k if len(k.decode()) >= 10 else None

    def want(live):
        holders = defaultdict(set)
        for i, t in live:
            for x in plain(t).split(b"\n"):
                if k := key(x):
                    holders[k].add(i)
        return {i: b"\n".join(x for x in plain(t).split(b"\n") if not ((k := key(x)) and len(holders[k]) > 1 and min(holders[k]) != i)) for i, t in live}

    assert {r.doc_id: r.text.encode() for r in line_dedup.line_dedup(docs).collect()} == want(DOCS)
    store = line_dedup.LineStore(spark)
    store.insert(docs.filter("doc_id < 12"))
    store.insert(docs.filter("doc_id >= 12"))
    assert {r.doc_id: r.text.encode() for r in store.apply(docs).collect()} == want(DOCS)
    store.insert(docs.filter("doc_id in (4, 5, 12)"))  # a retried batch
    assert {r.doc_id: r.text.encode() for r in store.apply(docs).collect()} == want(DOCS)
    store = line_dedup.LineStore.open(spark, store.path)
    store.delete(docs.filter("doc_id in (11, 4)"))
    live = [(i, t) for i, t in DOCS if i not in (11, 4)]
    assert {r.doc_id: r.text.encode() for r in store.apply(docs.filter("doc_id not in (11, 4)")).collect()} == want(live)


def test_empty_line_store_and_more_shards(spark, docs, monkeypatch):
    store = line_dedup.LineStore(spark)
    store.delete(docs)
    assert {r.doc_id: r.n_dropped for r in store.apply(docs).collect()} == {i: 0 for i, _ in DOCS}
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 2)
    rows = [(i, "\n".join(f"a line number {j}" for j in range(i % 5, 40, 5))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    store.insert(df.filter("doc_id < 1"))
    few = store.shards
    store.insert(df.filter("doc_id >= 1"))
    assert store.shards > few
    store.delete(df.filter("doc_id = 0"))
    assert {r.doc_id: r.n_dropped for r in store.apply(df.filter("doc_id > 0")).collect()} == {i: 0 if i in (1, 2, 3, 4, 5) else 8 for i in range(1, 20)}


def test_cuckoo_filter_keeps_what_it_holds():
    import numpy as np

    rng = np.random.default_rng(2)
    keys, more = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (5000, 20000))
    own = line_dedup.CuckooFilter(capacity=5000)
    own.insert(keys)
    own.insert(more)
    own = line_dedup.CuckooFilter.load(own.dump())
    assert own.contains(keys).all() and own.contains(more).all() and len(own.tables) > 1
    own.delete(keys[:100])
    assert own.contains(more).all() and own.contains(keys[:100]).sum() < 5


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination(spark, docs, block):
    passage = DOCS[9][1]
    items = [(1, passage), (2, "A b, C d"), (3, None), (4, ""), (5, "the"), (6, passage + " more words"), (None, "one")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = by_id(decontamination.decontaminate(docs, bench, max_block_bytes=block))
    words = lambda t: decontamination.search_words(plain(t))
    for i, t in DOCS:
        w, hit, found = words(t), set(), set()
        for name, text in items:
            p = words(text)
            size = min(13, len(p))
            wins = {tuple(p[j : j + size]) for j in range(len(p) - size + 1)} if p else set()
            for j in range(len(w) - size + 1):
                if wins and tuple(w[j : j + size]) in wins:
                    hit |= set(range(j, j + size))
                    found |= {str(name)} if name is not None else set()
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, list(r["items"])) == (len(w), len(hit), len(found), sorted(found))
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def shingles(t):
    w = plain(t).translate(LOWER).split()
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    of = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = of[a], of[b]
                of = {k: min(x, y) if v in (x, y) else v for k, v in of.items()}
    return sets, of


def test_jaccard_components(docs):
    sets, of = groups(DOCS)
    got = by_id(jaccard_join.jaccard_components(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), of[i]) for i in sets}


def test_jaccard_of_many_near_copies_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 7)
    rng = random.Random(9)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
        rows.append((i, " ".join(w[: rng.randint(52, 60)])))
    rows += [(100 + i, " ".join(f"s{rng.randrange(3)}" for _ in range(rng.randint(1, 12)))) for i in range(120)]
    sets, of = groups(rows)
    got = by_id(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), of[i]) for i in sets}


def test_asked_texts_come_with_few_others(spark):
    rows = spark.range(20_000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("d"), F.col("id").cast("string").alias("text"))
    asked = rows.filter("text % 50 = 7").select("d")
    passed = jaccard_join.maybe_asked(rows, asked)
    want = set(range(7, 20_000, 50))
    got = [int(r.text) for r in passed.collect()]
    assert len(got) == len(set(got)) < 2500 and want <= set(got) and passed.columns == ["d", "text"]
    assert want <= {int(r.text) for r in jaccard_join.maybe_asked(rows.union(rows.limit(0)), asked, most_bits=1).collect()}
    assert jaccard_join.maybe_asked(rows, asked.limit(0)).isEmpty()


def test_light_links_are_whole(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(5, 16)))) for i in range(150)]
    sets, of = groups(rows)
    got = by_id(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r.component_id for i, r in got.items()} == of
    assert jaccard_join.light_boundary({4: 1000, 5: 1000}, 80) >= 4


def test_context_mixing_base_and_probabilities(docs):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in DOCS}
    tokens = {i: [*plain(t).translate(LOWER).split(), None] for i, t in DOCS}
    c = Counter(x for i, w in tokens.items() if not held[i] for x in w)
    n, v = sum(c.values()), len(c)
    got = by_id(context_mixing.score_texts(docs))
    for i, w in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r.score < 0 and math.isfinite(r.score)


def test_base_scores_do_not_depend_on_the_order_of_packed_rows(spark, docs, monkeypatch):
    frame, columns = type(docs), ("doc_id", "n_known", "train_tokens", "base_score")
    want = by_id(context_mixing.score_texts(docs).select(*columns))
    group_by = frame.groupBy
    # Equal groups meet in the order of spills: here the rows come sorted by a hash of what they hold.
    monkeypatch.setattr(frame, "groupBy", lambda df, *c: group_by(df.orderBy(F.xxhash64("vals", "owners")) if c == ("grp",) else df, *c))
    got = by_id(context_mixing.score_texts(docs).select(*columns))
    for i, r in want.items():
        assert (got[i].n_known, got[i].train_tokens) == (r.n_known, r.train_tokens)
        assert got[i].base_score == pytest.approx(r.base_score)


def small_model(texts):
    import numpy as np

    symbols, lengths = context_mixing.symbols_of(texts)
    code = context_mixing.Code(np.bincount(symbols, minlength=257) + 1)
    sizes = (17, 18, 19, 20)
    counts = [np.zeros((2, 1 << b)) for b in sizes]
    bits = context_mixing.Bits(code, sizes, context_mixing.grams(symbols, lengths))
    for count, slot in zip(counts, bits.slots, strict=True):
        np.add.at(count, (bits.bit.astype(int), slot), 1)
    return code, [context_mixing.logit(*c) for c in counts]


def test_mixed_probabilities_sum_to_one():
    import numpy as np

    texts = [b"abracadabra abracadabra", b"a cadabra"]
    code, tables = small_model(texts)
    tuner = context_mixing.Tuner(code, tables)
    before = [tuner(texts) for _ in range(6)]
    assert before[-1] < before[0]
    bits = lambda t: context_mixing.text_bits(code, tables, tuner.weights.astype(np.float32), t)
    whole = bits([b"abra", b"abr"])
    assert np.allclose(whole, np.concatenate([bits([b"abra"]), bits([b"abr"])]))
    total = sum(2.0 ** -bits([b"", *[bytes([x]) for x in range(256)]]))
    assert 0 < total <= 1.0001  # texts of one byte and the empty one are a part of all texts


def test_bits_of_a_text_one_by_one():
    import numpy as np

    texts = [b"the cat sat on the mat " * 20, b"a cat", b"dog"]
    code, tables = small_model(texts[:2])
    weights = np.random.default_rng(1).uniform(0.1, 0.5, (context_mixing.GATES, 4)).astype(np.float32)
    got = context_mixing.text_bits(code, tables, weights, texts)
    for text, bits in zip(texts, got, strict=True):
        symbols, total, credit = [*text, context_mixing.END], 0.0, {g: 0.0 for g in context_mixing.GAINS}
        for i, symbol in enumerate(symbols):
            if i % context_mixing.STRETCH == 0:
                share = {g: c - np.logaddexp(*credit.values()) for g, c in credit.items()}
            key = 0
            for back in range(6):
                key |= (symbols[i - back] if i >= back else context_mixing.NOTHING) << (9 * back)
            own = context_mixing.Bits(code, (17, 18, 19, 20), np.array([key], np.uint64))
            logs = {g: 0.0 for g in credit}
            for j in range(len(own.bit)):
                z = sum(float(weights[own.gate[j], k]) * float(tables[k][own.slots[k][j]]) for k in range(4))
                for g in logs:
                    logs[g] -= np.logaddexp(0, -g * z if own.bit[j] else g * z)
            total -= np.logaddexp(*(share[g] + logs[g] for g in credit))
            credit = {g: c + logs[g] for g, c in credit.items()}
        assert bits == pytest.approx(total / math.log(2), rel=1e-4)


def test_scores_do_not_depend_on_how_the_input_is_split(spark, docs):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("ta", "re", "lo", "mi") for b in ("n", "s", "ra", "de")]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 200)))) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (by_id(context_mixing.score_texts(df.repartition(n, "doc_id"))) for n in (2, 9))
    tokens = {i: [*t.encode().split(), None] for i, t in rows}
    c = Counter(x for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 10 for x in w)
    n, v = sum(c.values()), len(c)
    for i, r in a.items():
        assert r.score == pytest.approx(b[i].score, rel=1e-6)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens[i]))
        assert (r.n_known, b[i].n_known) == (sum(c[x] > 0 for x in tokens[i]),) * 2


def test_pu_classifier_tells_junk_from_prose(spark):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("ta", "re", "lo", "mi") for b in ("n", "s", "ra", "de")]
    rows, labels = [], []
    for i in range(900):
        good = rng.random() < 0.8
        w = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        rows.append((i, (" ".join(w) + ".") if good else " | ".join(x.upper() + "!!" for x in w)))
        if rng.random() < 0.6:
            labels.append((i, int(good)))
    rows += [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = by_id(pu_classifier.score_quality(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int")))
    assert len(out) == 902 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    held = [(out[i].score, y) for i, y in labels if out[i].held_out]
    right = sum(a > b for a, x in held if x for b, y in held if not y) / max(1, sum(1 for _, x in held if x) * sum(1 for _, y in held if not y))
    assert right > 0.98
    none = pu_classifier.score_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert none.count() == 902


def test_risk_and_its_slopes_against_a_direct_computation():
    import numpy as np

    rng = np.random.default_rng(5)
    for shift in (0.0, -3.0):  # of the second the negative part is under 0
        f, g, prior = rng.normal(1, 2, 40), rng.normal(shift, 1, 60), 0.8
        loss = lambda z: math.log1p(math.exp(-z))
        positive = prior * sum(map(loss, f)) / 40
        negative = sum(loss(-z) for z in g) / 60 - prior * sum(loss(-z) for z in f) / 40
        got, at_p, at_u = pu_classifier.risk(f, g, prior)
        assert got == pytest.approx(positive + max(0.0, negative))
        sign = 1 if negative >= 0 else -1

        def part(f, g):
            wrong = sum(loss(-z) for z in g) / 60 - prior * sum(loss(-z) for z in f) / 40
            return sign * wrong + (prior * sum(map(loss, f)) / 40 if sign > 0 else 0.0)

        for i in (0, 7):
            e = np.zeros(40)
            e[i] = 1e-6
            assert at_p[i] == pytest.approx((part(f + e, g) - part(f - e, g)) / 2e-6, abs=1e-6)
            e = np.zeros(60)
            e[i] = 1e-6
            assert at_u[i] == pytest.approx((part(f, g + e) - part(f, g - e)) / 2e-6, abs=1e-6)


def test_prior_comes_from_positives_and_unlabelled_alone():
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(("tan", "res", "lora", "mide")) for _ in range(40)).encode()
    bad = lambda: b" | ".join(rng.choice((b"BUY!!", b"NOW$$")) for _ in range(40))
    texts = [[good() for _ in range(400)], [good() if rng.random() < 0.7 else bad() for _ in range(600)]]
    p, u = map(pu_classifier.Sample.of_texts, texts)
    start = pu_classifier.Model(pu_classifier.quantiles(u.rates), np.zeros(pu_classifier.WIDTH))
    half = lambda x, k: x.take(np.arange(k, len(x), 2))
    model = pu_classifier.Model(start.cuts, pu_classifier.fit(half(p, 0), half(u, 0), start, 0.5, pu_classifier.against))
    prior = pu_classifier.estimated_prior(*(pu_classifier.histogram(model.logits(half(x, 1))) for x in (p, u)))
    assert 0.5 < prior < 0.72
    assert pu_classifier.estimated_prior(np.zeros(4), np.ones(4)) == 0.5


def test_packed_counts_and_vectorised_features():
    rng = random.Random(9)
    texts_ = [plain(t) for _, t in DOCS] + [b"a " * 5000, b"", b"\xff| x#", " ".join(rng.choice(("Aa", "b.", "c!", "é")) for _ in range(300)).encode()]
    for t in texts_:
        counts = pu_classifier.gram_counts(t)
        used, own = pu_classifier.unpacked_counts(pu_classifier.packed_counts(counts, bytes))
        assert (used == np.flatnonzero(counts)).all() and (own == counts[used]).all()
        words, n = t.split(), max(1, len(t.split()))
        rates = dict(zip(pu_classifier.NAMES, pu_classifier.features(t).tolist(), strict=True))
        if t:
            want = {"words": math.log1p(len(words)), "adjacent": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, "odd_word": sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:!?'\")" for w in words) / n, "bangs": sum(t.count(c) for c in (b"!", b"?")) / n, "longest": math.log1p(max(map(len, words), default=0)), "short_words": sum(len(w) < 4 for w in words) / n, "ends": sum(w.endswith(b".") for w in words) / n}
            assert {k: rates[k] for k in want} == pytest.approx(want, rel=1e-5)


def test_the_fit_does_not_depend_on_how_rows_are_dealt(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("tan", "res", "lora")) for _ in range(rng.randrange(30))) if i % 5 else " | ".join(["BUY!!"] * 300)) for i in range(200)] + [(None, "tan"), (7, "tan"), (8, None)]
    known = spark.createDataFrame([(i,) for i in range(200) if i % 5], "doc_id long")
    held = pu_classifier.fold(F.col("doc_id"), 5) == 0
    tables = [pu_classifier.packed_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(n).withColumn("held_out", held), known, 3) for n in (1, 7)]
    a, b = map(pu_classifier.train, tables)
    assert np.allclose(a.weights, b.weights) and np.allclose(a.cuts, b.cuts)
    of = {}
    for i, t in rows:
        of.setdefault((i, plain(t)), pu_classifier.Sample.of_texts([plain(t)]))
    seen = 0
    for r in tables[0].collect():
        every = pu_classifier._sample_of(r.asDict())
        assert len(r.ids) == r.n == len(every)
        for k, i in enumerate(r.ids):
            one = every.take(np.array([k]))
            same = [x for (j, _), x in of.items() if j == i and len(x.slots) == len(one.slots) and np.array_equal(x.rates, one.rates)]
            assert any(np.array_equal(x.slots, one.slots) and np.allclose(x.values, one.values) for x in same)
            seen += 1
    assert seen == len(rows)


def test_warc_round_trip_and_order(spark):
    pages = [(1, "http://www.B.com:80/x?q=1#f", "é\r\n\r\nWARC/1.1\r\n"), (2, "http://a.org", "same"), (3, None, None), (4, "https://a.org/", ""), (5, "http://a.org/y", "same"), (6, "x", "\r\n\r\n"), (None, "http://c", "only"), (2**63 - 1, "http://a\r\nb.org", "big"), (-(10**15), "http://a.org", "low")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as block", "'x' as head")
    rows = warc.capture_history(df).collect()
    got = {r.page_id: r for r in rows}
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    for i, _, html in pages:
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(plain(html)), digest(plain(html)))
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 2: ("revisit", 5), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("response", None), 2**63 - 1: ("response", None), -(10**15): ("response", None)}
    assert got[2**63 - 1].url == "http://a\r\nb.org"
    assert [(r.url_key, r.capture_ts) for r in rows] == sorted((r.url_key, r.capture_ts) for r in rows)
    assert got[1].url_key == "com,b)/x?q=1"


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(7)
    for k in (0, 1, 2, 3, 7, 8):
        runs = [sorted((rng.randrange(20),) for _ in range(rng.randrange(9))) for _ in range(k)]
        tree = warc.LoserTree(runs)
        assert [runs[r][i] for r, i in tree] == sorted(x for r in runs for x in r)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id int, text string")
    for out in (quality_rules.quality_rules(docs), token_counts.token_counts(docs, PATH), bpe_codec.decode(bpe_codec.encode(docs, PATH), PATH), substring_dedup.substring_dedup(docs), line_dedup.line_dedup(docs), decontamination.decontaminate(docs, bench), jaccard_join.jaccard_components(docs), context_mixing.score_texts(docs), pu_classifier.score_quality(docs, spark.createDataFrame([], "doc_id long, quality int")), warc.capture_history(spark.createDataFrame([], "page_id long, url string, html string"))):
        assert out.count() == 0


def test_null_and_repeated_ids(spark):
    t = DOCS[4][1]
    docs = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t), (None, None)], "doc_id long, text string")
    removed = sorted((r.doc_id or -1, r.n_removed) for r in substring_dedup.substring_dedup(docs).collect())
    assert removed == [(-1, 0), (-1, 0), (1, 0), (1, 0), (2, 120)]
    found = [(r.doc_id or -1, r.component_id or -1) for r in jaccard_join.jaccard_components(docs).collect()]
    assert sorted(found) == [(-1, -1), (-1, 1), (1, 1), (1, 1), (2, 1)]
    assert line_dedup.line_dedup(docs).count() == 5 and context_mixing.score_texts(docs).count() == 5
    assert {r.n_tokens for r in context_mixing.score_texts(docs).filter("doc_id = 1").collect()} == {121}
