"""Each operator against a brute-force version, and its defined results for nulls, empties, ties, repeats, empty tables and clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quietframe.llm import decontaminate, exact_dedup, line_dedup, packing, pii, quality, simhash, token_store, tokens, url_filter, warc
from quietframe.llm.common import LOWER, Scratch, word_hashes
from quietframe.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, ord int, uid string, gone int, digest string"
SYLLABLES = ["the", "an", "er", "on", "ti", "re", "es", "la", "de", "ou", "Sch", "ñ", "É"]


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def corpus(seed=1):
    """Texts with copies, near copies, repeated lines, nulls, empties, a long one, and equal rows; extra columns with clashing names."""
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randrange(1, 120))) for _ in range(60)]
    for i in range(15):
        w = texts[i].split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    line = " ".join(words(rng, 12))
    texts += [texts[0], texts[0], f"{line}\n{texts[3]}\nshort", f"x\n{line}\n{line}", line, "", None, None, "  ", "\n\n", " ".join(words(rng, 6000)), "a b", "A B", "one"]
    rows = [(i, t, 1, "u", 2, "d") for i, t in enumerate(texts)]
    return rows + [rows[5], (None, "no id at all here really", 1, "u", 2, "d"), (None, None, 1, "u", 2, "d")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- tokens, op1, op7


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab Z'sé\n\t   \x1c\0\xa0,.1²İΣß ͏́|<>endoftext") for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["<|endoftext|> a", "a  b<|endoftext|>", "x <|startoftext|>Y <|EndOfText|> z", "<|endoftext|>", "<|endo", "ftext|>", "it's  we'll\n\n  x ", "  lead", "trail  ", "\n", "", *[t or "" for _, t, *_ in corpus()]]
    e = Encoder(public_tokenizers.path(name), most=500)
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    for some in (texts, texts[::-1], [], [""], ["", " ", ""]):
        ids, first = e.encode(pa.array(some, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [x.ids for x in tok.encode_batch(some, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("size", [1024, 4096])
def test_encoder_tells_colliding_words_apart(name, size, monkeypatch):
    """The Thue-Morse word and its complement, which agree under every polynomial hash modulo 2^64; then all words under one hash."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
    texts = [word, word.translate(str.maketrans("ab", "ba")), "one two three", "two", ""]
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    want = [x.ids for x in tok.encode_batch(texts, add_special_tokens=False)]
    for constant in (False, True):
        if constant:
            monkeypatch.setattr(tokens, "word_hashes", lambda buf, starts, *_: np.zeros(len(starts), np.uint64))
        e = Encoder(public_tokenizers.path(name))
        for some, ids_of in ((texts, want), (texts[::-1], want[::-1])):
            ids, first = e.encode(pa.array(some, pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == ids_of


def test_word_hashes_follow_the_bytes_alone():
    rng = random.Random(4)
    parts = [bytes(rng.choice(b"abAB\xc3") for _ in range(rng.choice([1, 7, 8, 9, 16, 17, 255, 256, 257, 600]))) for _ in range(300)]
    parts += parts[:100]
    buf = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(x) for x in parts])
    starts = ends - [len(x) for x in parts]
    for fold, name in ((np.arange(256, dtype=np.uint8), bytes), (LOWER, bytes.lower)):
        groups = {}
        for h, x in zip(word_hashes(buf, starts, ends, fold).tolist(), parts, strict=True):
            groups.setdefault(name(x), set()).add(h)
        assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_plan_is_best_fit():
    rng = random.Random(2)
    for capacity in (10, 64):
        h = collections.Counter(rng.randrange(1, capacity + 1) for _ in range(500))
        runs, n = packing.plan(dict(h), capacity)
        place = collections.defaultdict(list)
        for length, _, count, first, offset in runs:
            for k in range(count):
                place[first + k].append((offset, length))
        assert len(place) == n
        for parts in place.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert collections.Counter(length for parts in place.values() for _, length in parts) == h
        bins = []  # plain best-fit decreasing
        for length in sorted(h.elements(), reverse=True):
            fit = [b for b in bins if b >= length]
            bins.remove(min(fit)) if fit else None
            bins.append((min(fit) if fit else capacity) - length)
        assert n <= len(bins)


def test_packing(spark, docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    out = packing.pack(docs, spark, path, end_id=1, capacity=512).collect()
    want = collections.Counter()
    for i, t, *_ in corpus():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 512)):
            want[i, k, a, len(ids[a : a + 512]), zlib.crc32(np.array(ids[a : a + 512], "<u4").tobytes())] += 1
    assert collections.Counter(tuple(r)[:5] for r in out) == want
    place = collections.defaultdict(list)
    for r in out:
        place[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in place.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(place) <= math.ceil(sum(k[3] * n for k, n in want.items()) / 512) + 1
    assert packing.pack(none, spark, path, 1).count() == 0


def test_bit_packing_round_trip():
    rng = np.random.default_rng(0)
    for bits in (1, 5, 11, 16, 17, 31, 32):
        for n in (0, 1, 63, 64, 65, 1000):
            ids = rng.integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32)
            data = token_store.pack(ids, bits)
            assert len(data) == -(-n // 64) * bits * 8
            assert (token_store.unpack(data, bits, n) == ids).all()
    with pytest.raises(ValueError):
        token_store.pack(np.array([4], np.uint32), 2)


def test_token_store(spark, docs, none, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    out = token_store.store_and_read(docs, spark, path, 50257, 2).collect()
    start, want = 0, []
    for i, t in sorted(((i, t or "") for i, t, *_ in corpus()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, out), key=lambda r: r[1]) == want
    assert token_store.store_and_read(none, spark, path, 50257, 2).count() == 0
    # Random access to one document, over block boundaries.
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    writer = token_store.TokenWriter(sink, 17)
    parts = [np.arange(n, dtype=np.uint32) % 100_000 for n in (3, 0, 200_000, 70_000)]
    for k, p in enumerate(parts):
        writer.add(k, p)
    writer.close()
    file = token_store.TokenFile(pa.BufferReader(sink.getvalue()))
    for k in (2, 0, 3, 1):
        assert (file.document(k) == parts[k]).all()


# ---- op2


def test_quality(spark, none):
    rng = random.Random(4)
    good = [" ".join(words(rng, rng.randrange(5, 80))) + "." for _ in range(300)]
    bad = [" | ".join(words(rng, rng.randrange(5, 40))) for _ in range(60)]
    rows = [(i, t, 1, "u", 2, "d") for i, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 360, 2)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([*rows, (None, None, 1, "u", 2, "d"), rows[0]], SCHEMA)
    out = quality.resample(docs, labels, spark).collect()
    assert len(out) == 362
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] % 2]
    assert np.mean([r["selected"] == (r["doc_id"] < 300) for r in held]) > 0.95
    for k in (0, 1, 7, 150, 362):
        picked = quality.resample(docs, labels, spark, k=k).collect()
        assert sum(r["selected"] for r in picked) == k
        keys = sorted((r["key"] for r in picked), reverse=True)
        assert k in (0, 362) or all(r["key"] >= keys[k - 1] for r in picked if r["selected"])
    assert quality.resample(none, labels, spark).count() == 0
    assert sum(r["selected"] for r in quality.resample(docs, labels.limit(0), spark).collect()) == 362


def test_quality_weights_noise_and_choice_by_brute_force(spark):
    """Counts, ratios, sums, Gumbel noise and the top k, made again in plain Python."""
    rng = random.Random(9)
    texts = [" ".join([*words(rng, rng.randrange(1, 60)), *(["%%%", "x"] if i % 5 == 0 else [])]) for i in range(60)] + ["", None, "one", "One one, ONE", " ".join(words(rng, 40_000))]
    docs = spark.createDataFrame([(i, t, 1, 2, 3.0) for i, t in enumerate(texts)], "doc_id long, text string, quality int, row int, key double")
    labels = [(i, int(i % 5 > 0), 0) for i in range(0, 60, 2)]
    out = {r["doc_id"]: r for r in quality.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), spark, k=20).collect()}

    def grams(t):
        w = re.findall("[0-9a-z\u0080-\U0010ffff]+|[^\\s0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        return [(x,) for x in w] + list(zip(w, w[1:], strict=False))

    bucket = {}
    for t in texts:
        for g in grams(t):
            if g not in bucket:
                b = np.frombuffer(" ".join(g).encode(), np.uint8)
                bucket[g] = int(quality.grams(b, np.array([0, len(b)]))[0][-1])
    half = lambda i: xxhash.xxh64_intdigest(i.to_bytes(8, "little"), xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)) % 2 == 0
    raw, target = collections.Counter(), collections.Counter()
    for i, t in enumerate(texts):
        raw.update(bucket[g] for g in grams(t))
        if (i, 1, 0) in labels and half(i):
            target.update(bucket[g] for g in grams(t))
    n, m = quality.BUCKETS, sum(target.values())
    s = 20 * sum(raw.values()) / m
    total = (m + 20 * n, sum(raw.values()) + s * n)
    keys = {}
    for i, t in enumerate(texts):
        weight = sum(math.log((target[bucket[g]] + 20) / total[0]) - math.log((raw[bucket[g]] + s) / total[1]) for g in grams(t))
        assert out[i]["log_weight"] == pytest.approx(weight, abs=1e-6) and out[i]["n_grams"] == len(grams(t))
        u = ((xxhash.xxh64_intdigest(i.to_bytes(8, "little"), xxhash.xxh64_intdigest((7).to_bytes(4, "little"), 42)) >> 12) + 0.5) / (1 << 52)
        keys[i] = weight - math.log(-math.log(u))
        assert out[i]["key"] == pytest.approx(keys[i], abs=1e-6)
    assert {i for i, r in out.items() if r["selected"]} == set(sorted(keys, key=keys.get)[-20:])
    assert out[60]["log_weight"] == out[61]["log_weight"] == 0


@pytest.mark.parametrize("gather", [3, 10_000])
def test_top_k_breaks_ties(spark, gather):
    keys = spark.createDataFrame([(i, 1.0 if i % 3 else 2.0, i) for i in range(30)], "doc_id long, key double, row long")
    out = quality.top_k(keys, 13, gather).filter("selected").collect()
    assert sorted(r["doc_id"] for r in out) == sorted([*range(0, 30, 3), 1, 2, 4])
    same = spark.createDataFrame([(None if i < 2 else 7 if i < 9 else i, 1.5, i) for i in range(12)], "doc_id long, key double, row long")
    for k in range(1, 12):
        assert sorted(r["row"] for r in quality.top_k(same, k, gather).filter("selected").collect()) == list(range(k))
    rng = random.Random(3)
    some = [rng.choice([rng.gauss(0, 5), 1.0, 1.0 + 1e-15, -1e300]) for _ in range(60)]
    keys = spark.createDataFrame([(i, x, i) for i, x in enumerate(some)], "doc_id long, key double, row long")
    for k in (1, 17, 40, 59):
        want = sorted(range(60), key=lambda i: (-some[i], i))[:k]
        assert sorted(r["row"] for r in quality.top_k(keys, k, gather).filter("selected").collect()) == sorted(want)


# ---- op3


def test_base_spans_match_the_plain_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = random.Random(8)
    texts = ["".join(rng.choice("a@.b-+ 0123()9%_é\n") for _ in range(rng.randrange(80))) for _ in range(4000)]
    texts += ["4111 1111 1111 1111 a@b.c@d.e 1.2.3.4.5.6.7.8 256.1.1.1 +1 (609) 555-7932", "0" * 5000]
    for t in texts:
        want = [("email", *m.span()) for m in email.finditer(t)]
        want += [("ip", *m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
        want += [("card", *m.span()) for m in card.finditer(t) if 13 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and pii.luhn(d)]
        want += [("phone", *m.span()) for m in phone.finditer(t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
        assert pii.base_spans(t) == want, t


def test_tagger_learns():
    losses = pii.Tagger().fit(pii.examples(200), epochs=3)
    assert losses[-1] < losses[0] / 2


def test_tagger_on_held_out_spans():
    """Recall and precision of 0.9 for every kind, and 0.9 too for those spans that the base patterns miss."""
    held = pii.examples(600, seed=77)
    got = pii.model_spans([t for t, _ in held], pii.trained())
    for kind in pii.EVERY:
        want = {(i, *s) for i, (_, spans) in enumerate(held) for s in spans if s[0] == kind}
        have = {(i, *s) for i, spans in enumerate(got) for s in spans if s[0] == kind}
        assert len(want & have) > 0.9 * len(want) and len(want & have) > 0.9 * len(have), kind
    both = pii.all_spans([t for t, _ in held], pii.trained())
    want = {(i, *s) for i, (_, spans) in enumerate(held) for s in spans if not any(s[1] < y and x < s[2] for _, x, y in both[i][0])}
    added = {(i, *s) for i, (base, every) in enumerate(both) for s in every if s not in base}
    assert len(want) > 100 and len(want & added) > 0.9 * len(want) and len(want & added) > 0.9 * len(added)


def test_windows_without_a_digit_or_at_change_nothing():
    rng = random.Random(8)
    tagger = pii.trained()
    texts = [" ".join(t for t, _ in pii.examples(120, seed=78))]
    texts += ["".join(rng.choice("aB.@ -_=:+()\"'17%\né") for _ in range(3000)), "".join(rng.choice(["abc", " ", "@x.y", "token = ", "deadbeef", "0", "x" * 90, ". "]) for _ in range(2000))]
    for text in texts:
        every = np.arange(0, len(text), pii.STRIDE)
        assert pii.model_spans([text], tagger) == pii.model_spans([text], tagger, [every])


def test_personal_data(spark, none):
    tagger = pii.trained()
    texts = [(1, "mail a.b@c.org now"), (2, None), (3, ""), (1, "mail a.b@c.org now"), (None, 'the token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" of it'), (5, "é" * 200_000 + " call +1 (017) 555-7713 " + "x" * 200_000)]
    docs = spark.createDataFrame([(*r, 7, "x") for r in texts], "doc_id long, text string, n_email int, spans string")
    rows = {(r["doc_id"], r["spans"]): r for r in pii.find(docs, tagger).collect()}
    assert len(rows) == 5
    r = rows[1, "email:5:14"]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["n_added"], r["n_spans"]) == (1, 0, 0, 0, 0, 1) and r["base_sha256"] == hashlib.sha256(b"email:5:14").hexdigest()
    r = rows[None, "secret:13:53"]
    assert (r["n_email"], r["n_added"], r["n_spans"]) == (0, 1, 1) and r["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[2, ""]["n_spans"] == rows[3, ""]["n_spans"] == 0
    assert rows[5, "phone:200006:200023"]["n_phone"] == 1
    assert pii.find(none, tagger).count() == 0


def test_misfits_displace_nothing():
    """A span that hasn't the shape of its kind is put aside before the best set is chosen."""
    spans = [("email", 0, 20, 50.0), ("phone", 5, 17, 9.0)]
    assert pii.reconcile(list(spans), set(), lambda kind, a, b: None if kind == "email" else (a, b)) == [("phone", 5, 17, 9.0)]


def test_gradients():
    tagger = pii.Tagger(3)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, pii.CLASSES, (2, 6)), np.zeros((2, 6), np.int64)
    y[0, 2:5] = [1, 2, 2]
    _, g = tagger.step(x, y)
    for k in ("Uf", "Eb", "W", "T", "s"):
        i = tuple(rng.integers(0, n) for n in tagger.p[k].shape)
        i = (0, 1) if k == "T" else (1,) if k == "s" else (int(x[0, 2]), i[1]) if k == "Eb" else i
        old, loss = tagger.p[k][i], []
        for d in (1e-2, -1e-2):
            tagger.p[k][i] = old + d
            loss.append(tagger.step(x, y)[0])
        tagger.p[k][i] = old
        assert abs((loss[0] - loss[1]) / 2e-2 - g[k][i]) < 5e-3, k


def test_reconcile_takes_the_best_set():
    spans = [("email", 0, 5, 3.0), ("ip", 4, 9, 4.0), ("card", 9, 12, 1.0), ("email", 0, 4, 2.0)]
    assert [s[:3] for s in pii.reconcile(spans, set())] == [("email", 0, 4), ("ip", 4, 9), ("card", 9, 12)]
    assert [s[:3] for s in pii.reconcile([("ip", 0, 6, 1.0), ("ip", 3, 9, 1.0)], {(0, 6), (3, 9)})] == [("ip", 0, 9)]


# ---- op4


def test_decontaminate(spark, none):
    rng = random.Random(6)
    items = [" ".join(words(rng, n)) for n in (20, 20, 31, 8, 5, 3)] + ["", None]
    texts = [" ".join([*words(rng, 30), items[i], *words(rng, 10)]) for i in range(6)] + [items[0].upper() + "!", " ".join(words(rng, 100)), "", None, items[2].rsplit(" ", 2)[0]]
    w = items[2].split(" ")
    w[0] = w[-1] = "changed"
    texts.append(" ".join([*words(rng, 9), *w, *words(rng, 9)]))
    docs = spark.createDataFrame([(i, t, 1, "u", 2, "d") for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame([(100 + i, t) for i, t in enumerate(items)], "item_id long, text string")

    def bag(w, k):
        return collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    split = lambda t: re.findall("[0-9A-Za-z\u0080-\U0010ffff]+", (t or "").lower())
    want = {}
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            a, b = split(t), split(item)
            k = min(5, len(b))
            for s in range(max(1, len(a) - len(b) + 1)) if k and len(a) >= k else ():
                x, y = bag(a[s : s + len(b)], k), bag(b, k)
                sim = sum((x & y).values()) / sum((x | y).values())
                if sim >= 0.8:
                    want[i, 100 + j] = max(want.get((i, 100 + j), 0), sim)
    for block in (5000, 3):
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(docs, bench, spark, block).collect()}
        assert got == pytest.approx(want)
    assert len(want) >= 8
    assert decontaminate.contaminated(none, bench, spark).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0), spark).count() == 0


def test_multi_index_finds_all_within_radius():
    rng = random.Random(3)
    items = decontaminate.Items([(i, " ".join(words(rng, 25))) for i in range(40)])
    p = np.random.default_rng(1)
    prints = p.integers(0, 2**63, 3000, dtype=np.uint64)
    prints[:1000] = items.prints[p.integers(0, 40, 1000)]
    for i in range(1000):
        for b in p.choice(64, i % 24, replace=False):
            prints[i] ^= np.uint64(1) << np.uint64(b)
    got = set(zip(*[x.tolist() for x in items.near(25, prints)], strict=True))
    ks = items.sizes[25]
    assert got == {(i, k) for i in range(3000) for k in ks if np.bitwise_count(prints[i] ^ items.prints[k]) <= decontaminate.RADIUS}


# ---- op5


def test_url_rules_and_model(spark):
    urls = ["https://a.com/x", "http://EXAMPLE.com/en/1?q", "http://www.example.com/en/1#f", "http://x.net/es/a", "http://x.net/fr/", "http://a.com?x=/", "no scheme", None, "", "://h/p", "ftp://u@b.org:80/p/q?x#y", "http://notexample.com/en/", "http://www.poker-prizes.example.org/en/1", "http://garden.example.org/about.html"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labelled = spark.createDataFrame(url_filter.labelled_urls(), "url string, label double")
    w = url_filter.train(spark, labelled)
    out = {r["page_id"]: r for r in url_filter.judge(pages, w).collect()}
    assert [out[i]["rule"] for i in range(12)] == ["com/", "example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, None, None, None, None, None, "com/"]
    assert [out[i]["host"] for i in (1, 6, 7, 9, 10)] == ["example.com", "", "", "h", "u@b.org:80"]
    assert [out[i]["path"] for i in (1, 5, 10)] == ["/en/1", "", "/p/q"]
    assert out[12]["verdict"] == "block" and out[13]["verdict"] == "allow"
    # Brute force: the same descent in numpy.
    buckets = len(w) - 1

    def feats(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        g = dict.fromkeys(mark + s[i : i + n] for mark, s in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in (2, 4, 6) for i in range(len(s) - n + 1))
        return [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % buckets for x in g]

    rows = [(feats(u), y) for u, y in url_filter.labelled_urls()]
    mine, bias = np.zeros(buckets), 0.0
    for _ in range(60):
        err = np.array([y - 1 / (1 + np.exp(-(bias + sum(mine[g]) / np.sqrt(max(1, len(g)))))) for g, y in rows])
        step = np.zeros(buckets)
        for (g, _), e in zip(rows, err, strict=True):
            np.add.at(step, g, e / np.sqrt(max(1, len(g))))
        mine = mine * (1 - 50.0 * 1e-4) + 50.0 / len(rows) * step
        bias += 2.0 / len(rows) * err.sum()
    assert np.allclose([*mine, bias], w, atol=1e-6)
    for i in (6, 7, 12, 13):
        g = feats(urls[i])
        assert out[i]["score"] == pytest.approx(bias + sum(mine[g]) / np.sqrt(max(1, len(g))), abs=1e-5)


def test_url_model_on_held_out_families(spark):
    """Hosts of spam families whose names the model has never seen, and ordinary hosts: recall 0.9 at least, under 0.01 blocked of what is clean."""
    families = "casino.?win|cheap.?pills|free.?bets|adult.?x|spam.?farm|ads.?track"
    names = ["casino-win", "cheap-pills", "free-bets", "adult-x", "spam-farm", "ads-track"]
    assert not set(names) & set(sum(url_filter.labelled_names(), []))
    w = url_filter.train(spark, spark.createDataFrame(url_filter.labelled_urls(families), "url string, label double"))
    bad = [f"http://{lead}{name}.example.{tail}/{path}" for name in names for lead in ("", "m.", "blog.") for tail in ("org", "net") for path in ("en/77", "de/1234.html", "de/9/")]
    good = [f"https://{lead}{name}.example.{tail}/{path}" for k, name in enumerate(url_filter._made_up(150, 77)) for lead in ("", "www.") for tail, path in (("org", f"en/{k}"), ("net", f"de/{k}.html"))]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(bad + good)], "page_id long, url string")
    blocked = [r["page_id"] for r in url_filter.judge(pages, w, []).collect() if r["verdict"] == "block"]
    assert sum(i < len(bad) for i in blocked) >= 0.9 * len(bad)
    assert sum(i >= len(bad) for i in blocked) < 0.01 * len(good)


def test_url_empty_and_repeated(spark):
    w = [0.0] * 17
    schema = "page_id long, url string, rule int, score string"
    assert url_filter.judge(spark.createDataFrame([], schema), w).count() == 0
    long = "http://a.org/" + "x" * 100_000
    rows = url_filter.judge(spark.createDataFrame([(1, long, 1, ""), (1, long, 1, ""), (None, None, 1, "")], schema), w).collect()
    assert len(rows) == 3 and {r["verdict"] for r in rows} == {"allow"} and {r["rule"] for r in rows} == {None}
    with pytest.raises(ValueError, match="over 2 rows"):
        url_filter.train(spark, spark.createDataFrame([("a", 1.0)] * 3, "url string, label double"), most=2)


# ---- op6


def test_warc(spark):
    html = ["<p>a</p>", "<p>b</p>", None, "", "<p>a</p>", "é" * 70_000, "<p>a</p>", "x"]
    url = ["http://a.b.com/1", "http://a.b.com/1", None, "bad url\r\nX: y", "https://b.com/é?x", "http://a.b.com/1", "http://z.org", "http://a.b.com/10"]
    pages = spark.createDataFrame([(10 - i, u, h, 1) for i, (u, h) in enumerate(zip(url, html, strict=True))] + [(-5, "http://n.org/", "neg", 1)], "page_id long, url string, html string, ckey int")
    for least in (0, 2):
        got = {r["page_id"]: tuple(r)[1:] for r in warc.archive_and_read(pages, spark, least).collect()}
        first = {}
        for r in pages.orderBy("page_id").collect():
            p = (r["html"] or "").encode()
            one = first.setdefault(p, r["page_id"]) if len(p) >= least else r["page_id"]
            assert got[r["page_id"]] == (len(p), warc.base32_sha1(p), "response" if one == r["page_id"] else "revisit", None if one == r["page_id"] else one)
        assert len(got) == 9
    assert warc.archive_and_read(pages.limit(0), spark).count() == 0


def test_capture_index_lookups(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    folder = Scratch(spark, "cdx").folder("x")
    rows = sorted((f"com,h{i % 5})/p {i:020d}", "a", i, 1) for i in range(40))
    import pyarrow as pa

    class Part:
        def __init__(self, rows):
            self.rows = rows

    manifest = []
    for k in range(0, 40, 16):
        part = spark.createDataFrame(rows[k : k + 16], "ckey string, archive string, offset long, length long")
        manifest += [dict(m, part=k) for m in warc.write_index(part, folder, 1)]
    index = warc.CaptureIndex(folder, manifest)
    for r in rows:
        assert list(index.find(r[0])) == [r]
    assert list(index.find("com,h9)/p 0")) == [] and list(index.find("a")) == []
    assert list(index.find("com,h3)", prefix=True)) == [r for r in rows if r[0].startswith("com,h3)")]
    assert pa is not None and Part is not None


# ---- op8


def test_golay_keys_are_complete():
    rng = np.random.default_rng(1)
    assert (simhash.ERRORS >= 0).sum(1).min() == 1 and sorted(set((simhash.ERRORS >= 0).sum(1).tolist())) == [1, 6]
    x = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    kx, ky = simhash.segment_keys(x), simhash.segment_keys(y)
    shared = sum((ky[k] == kx[k][:, :1]).any(1).astype(int) for k in range(3))
    assert shared.min() >= 2


def _print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def _components(prints):
    label = {p: p for p in prints}
    for p in prints:
        for q in prints:
            if bin(p ^ q).count("1") <= 3:
                a, b = label[p], label[q]
                if a != b:
                    label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    return label


def test_simhash(spark, docs, none):
    rows = corpus()
    label = _components({_print(t) for _, t, *_ in rows})
    ids = collections.defaultdict(list)
    for i, t, *_ in rows:
        ids[label[_print(t)]].append(i)
    want = collections.Counter((i, _print(t), min((x for x in ids[label[_print(t)]] if x is not None), default=None)) for i, t, *_ in rows)
    got = collections.Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs, spark).collect())
    assert got == want
    assert simhash.near_duplicates(none, spark).count() == 0


@pytest.mark.parametrize("block", [50_000, 7])
def test_simhash_links_of_a_dense_family(spark, block):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 6, dtype=np.uint64)
    prints = set(base.tolist())
    for _ in range(150):
        p = int(rng.choice(list(prints)))
        for b in rng.choice(64, rng.integers(1, 4), replace=False):
            p ^= 1 << int(b)
        prints.add(p)
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)), i) for i, p in enumerate(sorted(prints))], "fp long, first long")
    scratch = Scratch(spark, "t")
    edges = simhash.links(scratch.table(frame, "p"), scratch, 4, block)
    label = {r["node"] % 2**64: r["label"] % 2**64 for r in simhash.components(edges, scratch).collect()}
    want = _components(prints)
    groups = lambda f: sorted(sorted(g) for g in (lambda d: [d[k].append(x) or 0 for x in prints for k in [f(x)]] and d)(collections.defaultdict(list)).values())
    assert groups(lambda p: label.get(p, p)) == groups(lambda p: want[p])


# ---- op9


@pytest.mark.parametrize("kept", [False, True])
def test_exact(spark, docs, none, kept, tmp_path):
    path = f"file://{tmp_path}/index" if kept else None
    make = lambda: exact_dedup.DigestIndex(spark, "t_digest_index", 4, path)
    exact_dedup.DigestIndex(spark, "t_digest_index").drop()
    index = make()
    out = index.dedup(docs, Scratch(spark, "t")).collect()
    groups = collections.defaultdict(list)
    for i, t, *_ in corpus():
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    for r in out:
        g = groups[r["text_sha256"]]
        assert r["group_size"] == len(g) and r["keep_id"] == max((x for x in g if x is not None), default=None)
    assert collections.Counter((r["text_sha256"], r["doc_id"]) for r in out) == collections.Counter((d, i) for d, g in groups.items() for i in g)
    assert sum(r["kept"] for r in out) == len(groups)
    if kept:  # another session: the table is gone from the catalog, its files and number of buckets stay
        index.drop()
        index = exact_dedup.DigestIndex(spark, "t_digest_index", 9, path)
        assert index.buckets == 4
    # A text of an earlier call stays; of new equal rows with the largest doc_id one stays.
    again = index.dedup(spark.createDataFrame([(900, corpus()[0][1]), (901, "new"), (902, "new"), (902, "new")], "doc_id long, text string"), Scratch(spark, "t"))
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in again.collect()) == [(900, 76, False), (901, 902, False), (902, 902, False), (902, 902, True)]
    assert index.read().count() == len(groups) + 1
    before = sorted(index.read().collect())
    index.compact()
    assert sorted(index.read().collect()) == before
    assert len(index.read().inputFiles()) <= 4
    assert index.dedup(none, Scratch(spark, "t")).count() == 0
    assert not any(r["kept"] for r in index.dedup(docs, Scratch(spark, "t")).collect())
    index.drop()


def test_exact_goes_through_the_index(spark, docs):
    """The anti-join and the verdicts are sort-merge joins that read the buckets as they lie: nothing of the index is shuffled."""
    exact_dedup.DigestIndex(spark, "t_plan_index").drop()
    index = exact_dedup.DigestIndex(spark, "t_plan_index", 8)
    groups = spark.createDataFrame([("a", 1, 1, "b")], exact_dedup.SCHEMA)
    index.append(groups)
    for df, kind in ((index.unseen(groups.withColumn("digest", F.concat("digest", F.lit("")))), "LeftAnti"), (index.verdicts(groups.select("digest")), "Inner")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and kind in plan and "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    index.drop()


# ---- op10


@pytest.mark.parametrize("limits", [{}, {"lookup": 0, "block": 5, "most": 3}, {"tokens": 40}])
def test_lines(spark, docs, none, limits):
    rows = sorted(set(corpus()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    seen, want = [], {}
    for i, t, *_ in rows:
        kept, gone = [], 0
        for line in (t or "").split("\n"):
            w = re.findall("[0-9A-Za-z\u0080-\U0010ffff]+", line.lower())
            s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
            hit = bool(s) and any(len(s & x) / len(s | x) >= 0.8 for x in seen)
            if s:
                seen.append(s)
            gone += hit
            kept += [] if hit else [line]
        want[i, t] = (None if t is None else "\n".join(kept), gone)
    out = line_dedup.dedup_lines(docs, spark, **limits)
    assert out.columns == [*docs.columns, "lines_removed"]
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append((r["text"], r["lines_removed"]))
        assert (r["ord"], r["uid"], r["gone"], r["digest"]) == (1, "u", 2, "d")
    full = collections.defaultdict(list)
    for i, t, *_ in corpus():
        full[i].append(want[i, t])
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in full.items()}
    assert line_dedup.dedup_lines(none, spark).count() == 0
    clash = line_dedup.dedup_lines(docs.withColumn("lines_removed", F.lit("x")), spark)
    assert clash.columns == [*docs.columns, "lines_removed"] and dict(clash.dtypes)["lines_removed"] == "bigint"


def test_family_of_like_lines(spark):
    """Hundreds of lines that are alike in part: each is held against all earlier ones, over blocks of any size."""
    rng = random.Random(12)
    base = words(rng, 40)
    lines = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(40)] = rng.choice(["other", "word", "here"])
        lines.append(" ".join(w))
    rows = [(i, "\n".join(lines[i * 10 : i * 10 + 10])) for i in range(15)]
    seen, want = [], {}
    for i, t in rows:
        want[i] = 0
        for line in t.split("\n"):
            w = line.lower().split(" ")
            s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
            want[i] += any(len(s & x) / len(s | x) >= 0.8 for x in seen)
            seen.append(s)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for limits in ({}, {"block": 20, "most": 25, "lookup": 0}, {"block": 7, "tokens": 500}):
        assert {r["doc_id"]: r["lines_removed"] for r in line_dedup.dedup_lines(docs, spark, **limits).collect()} == want
