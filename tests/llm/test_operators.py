"""Each operator on awkward rows and on none, against brute force where it has an answer of its own."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import bpe, chat, components, fingerprint, language_id, packing, ppm, quality, sharding, simhash, tokens, wavelet, words
from plumbline.llm.common import new_folder

BYTE, WORD = tokens.tokenizer_path("byte_bpe_50k.json"), tokens.tokenizer_path("word_bpe_49k.json")


def rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def texts(awkward):
    return [(r["doc_id"], r["text"] or "") for r in awkward.collect()]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_block_encoding_equals_the_library(path, awkward):
    library, enc = Tokenizer.from_file(path), tokens.encoder(path)
    found = [t for _, t in texts(awkward)] + ["a b", " a", "a ", "a\nb", "a  b", "It's 3.5, o'er", "Ça va? ÀÉ! ×÷ ÿ", "a | b", "x" * 500 + " y", "\n", "a\n\nb", ",. a,b", "Ab. cd"]
    for t, got in zip(found, enc.encode_many(found), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_sharding_round_trip(spark, awkward, empty):
    store = sharding.ShardStore(spark, new_folder(spark, "t-shards"), target=1 << 20, small_rows=2, min_merge=2)
    assert store.read().count() == 0
    store.append(awkward)
    store.append(empty)
    store.append(awkward)
    before, old = store.manifest(), rows(store.read(), *awkward.columns)
    assert old == Counter({k: 2 * v for k, v in rows(awkward, "*").items()})
    after = store.compact()
    assert after.version > before.version and len(after.shards) < len(before.shards)
    assert rows(store.read(), *awkward.columns) == rows(store.read(before.version), *awkward.columns) == old
    with pytest.raises(sharding.Conflict):
        store._commit(before, before.schema, list(before.shards))
    assert store.vacuum() == 0 and store.vacuum(min_age_s=0) > 0 and rows(store.read(), *awkward.columns) == old
    assert not sharding.plan(store.manifest().shards, store.target, store.min_merge) and "shard_" in store.read().columns
    assert len({sharding.tier(s) for s in (0, 1 << 19)}) == 1 and sharding.tier(1 << 20) < sharding.tier(1 << 22) < sharding.tier(1 << 24)


def test_vacuum_spares_an_append_that_has_not_committed(spark, awkward):
    store = sharding.ShardStore(spark, new_folder(spark, "t-shards"), small_rows=4)
    store.append(awkward)
    commit = store._commit

    def late(*args):
        sharding.ShardStore(spark, store.root).vacuum()
        return commit(*args)

    store._commit = late
    store.append(awkward)
    assert store.read().count() == 2 * awkward.count()


def test_every_compaction_group_is_one_file(spark):
    store = sharding.ShardStore(spark, new_folder(spark, "t-shards"), target=40_000, small_rows=100, min_merge=2)
    store.append(spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text")))
    before = store.manifest()
    groups = sharding.plan(before.shards, store.target, store.min_merge)
    after = store.compact()
    assert after.version == before.version + 1 and len(after.shards) == len(groups) + len(before.shards) - sum(map(len, groups))
    assert len(groups) > 4 and max(s.bytes for s in after.shards) < 40_000 and store.read().count() == 4000


def test_quality_counts(awkward, empty):
    got = {r["doc_id"]: r for r in quality.judge(awkward).collect()}
    for doc, text in texts(awkward):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {k for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        m = got[doc]["q_m"]
        assert (m["w"]["n_words"], m["w"]["n_repeat_words"], m["l"]["n_dup_lines"]) == (len(w), len(covered), len(lines) - len(set(lines)))
        assert got[doc]["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert quality.judge(empty).count() == 0
    kept = quality.keep(awkward)
    assert kept.columns == awkward.columns and {r["doc_id"] for r in kept.collect()} <= {1, 2, 5}


def test_limits_follow_the_group_and_bear_junk(spark):
    clean = lambda k: " ".join(f"w{(k * 31 + j * 17) % 997}xy" for j in range(80))
    long = lambda k: " ".join(f"longerword{(k * 31 + j * 17) % 997}" for j in range(80))
    junk = lambda k: " ".join(f"w{j}##$$" for j in range(60))
    docs = [(k, clean(k), "en", "a") for k in range(800)] + [(1000 + k, long(k), "en", "b") for k in range(800)] + [(2000 + k, junk(k), "en", "a") for k in range(150)] + [(3000, long(3), "en", "a")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k]["kept"] for k in (*range(800), *range(1000, 1800))) and not any(got[2000 + k]["kept"] for k in range(150))
    assert not got[3000]["kept"] and got[0]["q_limits"][4] != got[1000]["q_limits"][4]  # fine in its own source only


def test_sketches_merge_and_bound_their_error(spark):
    df = spark.createDataFrame([(f"g{k % 3}", [k * k]) for k in range(2000)], "g string, r array<long>")
    fine = quality.sketches(df, "r", "g")
    q = {"q": 0.9}
    merged, direct = quality.merge(fine), quality.sketches(df.withColumn("all", F.lit(1)), "r", "all")
    assert rows(merged, "bucket", "n") == rows(direct, "bucket", "n")
    exact = sorted(k * k for k in range(2000))[math.ceil(2000 * 0.9) - 1]
    got = quality.quantiles(merged, q).first()["q"]
    assert exact * (1 - 1 / 64) <= got <= exact


def test_bpe_and_its_decoding(awkward, empty):
    library = Tokenizer.from_file(BYTE)
    want = Counter()
    for doc, text in texts(awkward):
        ids = library.encode(text, add_special_tokens=False).ids
        want[doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    run = lambda df: rows(bpe.encoded(df, BYTE, bpe.sha256_pair, "ids_sha256 string, decoded_sha256 string"), "*")
    assert run(awkward) == want and not run(empty)


def test_packed_words_and_numbers_come_back():
    some = sorted([b"", b"a", b"a\x00", b"a\x00b", b"ab" * 40, b"ab" * 41, "é".encode() * 50])
    assert words.unpack_words(words.pack_words(some)) == some and words.unpack_words(words.pack_words([])) == []
    for x in (np.array([3, 70_000, 1 << 45], np.int64), np.array([0.5, -1.25]), np.empty(0, np.int64)):
        assert words.unsqueeze(words.squeeze(x), "<f8" if x.dtype.kind == "f" else "<u8").tolist() == x.tolist()


def test_remembered_chunks_with_one_hash_are_told_apart():
    raw = np.frombuffer(b"abcabdxy", np.uint8)
    known, at, n = tokens.Known(10), np.array([0]), np.array([3])
    known.add(np.array([7], np.uint64), raw, at, n, np.array([1, 2], np.uint32), np.array([2]))
    assert known.find(np.array([7, 7, 8], np.uint64), raw, np.array([0, 3, 0]), np.array([3, 3, 3])).tolist() == [0, -1, -1]


def test_language(awkward, empty):
    got = language_id.identify(language_id.evidence_of_documents(awkward))
    assert got.count() == awkward.count() and not got.filter("key in (3, 4, 6) and accepted").count()
    assert language_id.identify(language_id.evidence_of_documents(empty)).count() == 0
    kept = language_id.keep(awkward)
    assert kept.columns == awkward.columns and not kept.filter("doc_id in (3, 4, 6)").count()


def test_posterior_by_hand(spark):
    s = language_id.Settings(min_rows=2)
    data = [("abab ab", "aa", "h1", "x"), ("ab abba", "aa", "h1", "x"), ("cdcd cd", "cc", "h2", "x"), ("dc cddc", "cc", "h2", "y"), ("abcd", None, "h2", "y"), ("ab", "zz", "h1", None)]
    df = spark.createDataFrame([(k, *d) for k, d in enumerate(data)], "key long, text string, declared string, host string, suffix string")
    langs = ["aa", "cc"]
    pair = lambda t: list(zip(t.encode(), t.encode()[1:]))
    counts = {x: Counter(p for t, d, *_ in data if d == x for p in pair(t)) for x in langs}
    counts["und"] = counts["aa"] + counts["cc"]

    def log(lang, a, b, text, declared):
        left = Counter(counts[lang])
        if declared in langs and lang in (declared, "und"):  # what the text itself taught
            left.subtract(pair(text))
        p = (left[a, b] + 0.5) / (sum(n for (x, _), n in left.items() if x == a) + 128)
        return math.log(0.8 * p + 0.2 / 256 if lang == "und" else p)

    names = [*langs, "und"]
    text = [[sum(log(x, a, b, t, d) for a, b in pair(t)) for x in names] for t, d, *_ in data]
    best = [t.index(max(t)) for t in text]
    said = [d if d in langs else "" if d is None else "other" for _, d, *_ in data]
    told = {d: [1 + sum(x == d and b == k for x, b in zip(said, best)) for k in range(3)] for d in (*langs, "other", "")}
    of = [sum(v[k] for v in told.values()) for k in range(3)]
    share = lambda key, k: sum(d[key] == v[key] and b == k for v, b in zip(data, best))
    got = {r["key"]: r for r in language_id.identify(df, s).collect()}
    for i, d in enumerate(data):
        fused = []
        for k in range(3):
            suffix = [x for x, y in zip(best, data) if y[3] == d[3]]
            host = [x for x, y in zip(best, data) if y[2:] == d[2:]]
            wide = (suffix.count(k) + 50 * of[k] / sum(of)) / (len(suffix) + 50)
            prior = (host.count(k) + 20 * wide) / (len(host) + 20)
            fused.append(0.25 * (text[i][k] - max(text[i])) + math.log(told[said[i]][k] / of[k]) + math.log(prior))
        top = max(fused)
        assert got[i]["lang"] == names[fused.index(top)] and got[i]["confidence"] == pytest.approx(1 / sum(math.exp(f - top) for f in fused), rel=1e-9)


def test_foreign_and_garbled_texts_are_not_accepted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = [(-1, "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 5), (-2, "xqzj kvwq zzkx jqxv wqkz vxjq qzxk " * 9), (-3, "Zażółć gęślą jaźń i pchnąć w tę łódź jeża lub ośm skrzyń fig. " * 4)]
    both = docs.unionByName(spark.createDataFrame([(k, t, "en", "src1") for k, t in odd], docs.schema))
    got = {r["key"]: r["accepted"] for r in language_id.identify(language_id.evidence_of_documents(both)).collect()}
    assert not any(got[k] for k in (-1, -2, -3)) and sum(got.values()) >= 0.99 * (len(got) - 3)


def test_pages_use_markup_and_address(spark):
    page = lambda k, lang, body, url: (k, url, f"<html lang='{lang}'><script>var x = 'ignored';</script><p>{body}</p></html>")
    df = spark.createDataFrame([page(k, "en" if k % 2 else "de", "the house and the tree" if k % 2 else "das haus und der baum", f"https://www.h{k % 2}.{'com' if k % 2 else 'de'}/a") for k in range(60)] + [(99, None, None)], "page_id long, url string, html string")
    rows = {r["key"]: r for r in language_id.evidence_of_pages(df).collect()}
    assert rows[0]["declared"] == "de" and rows[0]["suffix"] == "de" and rows[0]["host"] == "www.h0.de" and "ignored" not in rows[0]["text"]
    got = {r["key"]: r for r in language_id.identify(language_id.evidence_of_pages(df)).collect()}
    assert got[1]["lang"] == "en" and got[2]["lang"] == "de" and got[1]["accepted"] and not got[99]["accepted"]


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hidden = F.col("doc_id") % 5 == 0
    e = language_id.evidence_of_documents(docs).withColumn("truth", F.col("declared"))
    blind = e.withColumn("declared", F.when(F.col("key") % 5 != 0, F.col("declared"))).drop("truth")
    got = language_id.identify(blind).join(docs.filter(hidden).select(F.col("doc_id").alias("key"), F.col("lang").alias("truth")), "key")
    assert got.filter(got["lang"] == got["truth"]).count() >= 0.97 * got.count()


def brute_fingerprint(text, n):
    w = split(text)
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, awkward, empty):
    got = simhash.near_duplicates(awkward, 4).select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("h"), "component_id").collect()
    assert Counter((r["doc_id"], r["h"]) for r in got) == Counter((d, f"{brute_fingerprint(t, 4):016x}") for d, t in texts(awkward))
    parts = {r["doc_id"]: r["component_id"] for r in got}
    assert parts[1] == parts[2] == 1 and parts[3] == parts[4] == parts[6] == 3
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep(awkward)
    assert kept.columns == awkward.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 5, 7, 8, 9, 10]


def test_no_link_is_lost(spark):
    r = np.random.default_rng(5)
    fps = set()
    for seed in r.integers(0, 1 << 63, 60, dtype=np.uint64):
        chain = int(seed)
        for _ in range(r.integers(1, 40)):
            fps.add(chain)
            for bit in r.choice(64, r.integers(1, 7), replace=False):
                chain ^= 1 << int(bit)
    fps = np.array(sorted(fps), np.uint64)
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4):
            up[root(i + 1 + int(j))] = root(i)
    want = defaultdict(set)
    for i, f in enumerate(fps.view(np.int64).tolist()):
        want[root(i)].add(f)
    df = spark.createDataFrame([(x,) for x in fps.view(np.int64).tolist()], "fp long")
    got = defaultdict(set)
    for r in components.connected_components(simhash.links(df, 4)).collect():
        got[r["root"]].add(r["node"])
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values() if len(x) > 1}


def test_wavelet_matrix():
    r = np.random.default_rng(1)
    x = r.integers(0, 300, 3000).astype(np.uint32)
    m = wavelet.WaveletMatrix.build(x, 16)
    keys, counts = np.array([1, 5], np.int64), np.array([1000, 2000], np.uint32)
    k, c, back = wavelet.from_bytes(wavelet.to_bytes(keys, counts, x, 16))
    assert k.tolist() == [1, 5] and c.tolist() == [1000, 2000] and (back.decode() == x).all() and (m.decode() == x).all()
    assert [m.access(i) for i in range(0, 3000, 97)] == x[::97].tolist()
    for s in (0, 7, 299, 300, 70_000):
        at = np.flatnonzero(x == s).tolist()
        assert m.rank_many(s, np.array([0, 1500, 3000])).tolist() == [0, sum(a < 1500 for a in at), len(at)]
        assert m.count(s) == len(at) and m.occurrences(s) == at and m.rank(s, 1500) == sum(a < 1500 for a in at)
    assert m.access_many(np.arange(3000)).tolist() == x.tolist()
    assert wavelet.WaveletMatrix.build(np.empty(0, np.uint32), 16).decode().tolist() == []


def test_token_shards(awkward, empty):
    library = Tokenizer.from_file(BYTE)
    found, start, want = sorted(texts(awkward), key=lambda x: (x[0] is not None, x[0] or 0, x[1])), 0, Counter()
    for doc, text in found:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want[doc, start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    assert rows(wavelet.encoded(awkward, BYTE, shard_tokens=40), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert wavelet.encoded(empty, BYTE).count() == 0


def test_chat(spark):
    log = {1: "abc", 2: "ab", 3: "abc", 4: "b", 5: "abd", 6: "ba", 7: ""}
    turns = [(c, k, "user", x) for c, xs in log.items() for k, x in enumerate(xs)] + [(8, None, None, None), (None, 0, "user", "n"), (9, 2000, "user", "z"), (9, 0, "user", "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = chat.render(df).collect()
    assert {(r["conv_id"], r["n_copies"]) for r in got} == {(1, 2), (5, 1), (6, 1), (8, 1), (None, 1), (9, 1)}
    assert next(r["rendered"] for r in got if r["conv_id"] == 6) == "<|im_start|>user\nb<|im_end|>\n<|im_start|>user\na<|im_end|>\n"
    assert len([r for r in got if r["conv_id"] == 9]) == 2 and chat.render(df.filter("false")).count() == 0


def test_ppm(awkward, empty):
    got = ppm.scored(awkward, ppm.held_out(F.col("doc_id"))).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter()
    for d, t in texts(awkward):
        if not held(d):
            c.update([*t.encode().lower().split(), "end"])
    n, v = sum(c.values()), len(c)
    base = Counter((d, held(d), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for d, t in texts(awkward) for w in [[*t.encode().lower().split(), "end"]])
    assert Counter((*tuple(r)[:5], round(r["base_score"], 6)) for r in got) == base and all(r["score"] < 0 for r in got)
    assert ppm.scored(empty, ppm.held_out(F.col("doc_id"))).count() == 0


def symbols_of(text):
    return b"".join(w + b" " for w in text.encode().lower().split()) + b"\n"


def brute_ppm(train, text, order):
    """log10 probability by tries of every order, one symbol after the other."""
    tries = [defaultdict(Counter) for _ in range(order + 1)]
    start = b"\n" * order
    for t in train:
        s = start + symbols_of(t)
        for i in range(order, len(s)):
            for o in range(order + 1):
                tries[o][s[i - o : i]][s[i]] += 1
    s, total = start + symbols_of(text), 0.0
    for i in range(order, len(s)):
        seen = set()
        for o in range(order, -1, -1):
            live = {x: n for x, n in tries[o][s[i - o : i]].items() if x not in seen} if s[i - o : i] in tries[o] else {}
            n = sum(live.values())
            if s[i] in live:
                total += math.log10((2 * live[s[i]] - 1) / (2 * n))
                break
            total += math.log10(len(live) / (2 * n)) if live else 0.0
            seen |= set(live)
        else:
            total -= math.log10(256 - len(seen))
    return total


@pytest.mark.parametrize("batch_words", [ppm.BATCH_WORDS, 3])
def test_ppm_scores_equal_brute_force(spark, monkeypatch, batch_words):
    monkeypatch.setattr(ppm, "BATCH_WORDS", batch_words)
    text = ["The cat sat on the mat.", "the cat ate the rat", None, "", "A dog; a log, ä fog", "the cat sat", "zebra the cat sat on", "cat " * 30, "the mat sat on the cat"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(text)], "doc_id long, text string").repartition(3)
    train = [t or "" for k, t in enumerate(text) if zlib.crc32(str(k).encode()) % 7 != 2]
    assert len(train) < len(text)
    for r in ppm.scored(df, ppm.held_out(F.col("doc_id"))).collect():
        assert r["score"] == pytest.approx(brute_ppm(train, text[r["doc_id"]] or "", ppm.ORDER), rel=1e-12)


def test_ppm_hears_what_came_before(spark):
    docs = [(k, "red apple " * 20 + "blue berry " * 20) for k in range(20)] + [(100, "red apple blue berry"), (101, "red berry blue apple")]
    got = {r["doc_id"]: r["score"] for r in ppm.scored(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") >= 100).collect()}
    assert got[100] > got[101]


def test_ppm_probabilities_sum_to_one():
    book = ppm.Book([b"banana", b"band"])
    key = np.concatenate([k for _, k, _ in ppm.batches([np.array([0, 1]), np.array([0, 0])], book)])
    counts = np.ones(len(key))
    levels = {o: ppm.Level(((key >> 8 & ppm.MASKS[o]) << 8) | (key & 255), counts) for o in range(ppm.ORDER + 1)}
    for context in (*np.unique(key >> 8).tolist(), 12345):
        assert (10 ** ppm.step_costs(np.array([context << 8 | s for s in range(256)]), levels)).sum() == pytest.approx(1.0)


def test_packing(awkward, empty):
    library, want = Tokenizer.from_file(WORD), Counter()
    for doc, text in texts(awkward):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(ids), 64):
            part = ids[at : at + 64]
            want[doc, at // 64, at, len(part), zlib.crc32(part.tobytes())] += 1
    got = packing.packed(awkward, WORD, capacity=64)
    assert rows(got, "doc_id", "piece", "start", "length", "ids_crc32") == want
    bins = defaultdict(list)
    for r in got.collect():
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in b[:k]) == at for b in map(sorted, bins.values()) for k, (at, _) in enumerate(b)) and max(sum(n for _, n in b) for b in bins.values()) <= 64
    assert packing.packed(empty, WORD).count() == 0


def test_packing_rounds_keep_every_item(spark):
    items = spark.range(3000).select(F.col("id").alias("item"), (F.pmod(F.xxhash64("id"), F.lit(700)) + 1).cast("long").alias("size")).persist()
    place = packing.pack(items, 2048, per_task=200, fan_in=4).join(items, "item").collect()
    bins = defaultdict(list)
    for r in place:
        bins[r["sequence_id"]].append((r["offset"], r["size"]))
    assert len(place) == 3000 and all(sum(n for _, n in b[:k]) == at for b in map(sorted, bins.values()) for k, (at, _) in enumerate(b))
    assert len(bins) <= 1.01 * sum(r["size"] for r in place) / 2048 + 1


def test_fingerprints(awkward, empty):
    def canonical(t):
        return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())).strip(" ")

    # rows of one doc_id are equal here, and there is one without
    found = sorted(texts(awkward), key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    want = Counter()
    for k, (doc, t) in enumerate(found):
        nxt = found[(k + 1) % len(found)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        want[doc, len(t), hashlib.sha256(e.encode()).hexdigest(), float(canonical(t) == canonical(e)), float(canonical(t) == canonical(nxt))] += 1
    got = fingerprint.compare_with_edits(awkward)
    assert rows(got, "doc_id", "n_chars", "edited_sha256", "near_edited", "near_next") == want
    assert fingerprint.compare_with_edits(empty).count() == 0
    same = {r["doc_id"]: r["fingerprint"] for r in got.collect()}
    assert same[1] == same[2] and same[3] == same[4] == same[6] != same[1]


PARTS = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", " \n ", "\xa0", "  ", "é", "é", "ß", "日本", "😀", "'s", "'ll", "23", ".", "...", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x00", "\x01x", "x" * 70, "​", "\x85", "|"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_texts_are_cut_around_all_white_space(name):
    """Runs of any white space, odd white space, special tokens: the ids are the library's, whole or by chunk."""
    import random

    r = random.Random(8)
    encoder = tokens.Encoder(tokens.tokenizer_path(name))
    texts = ["".join(r.choice(PARTS if r.random() < 0.5 else ["the ", "word, ", "Of ", "\n\n", "  ", "\t"]) for _ in range(r.randint(1, 25))) for _ in range(1500)]
    want = [encoder.library(t) for t in texts]
    assert list(encoder.encode_many(texts)) == want
    for t, w in zip(texts, want, strict=True):
        keys = encoder.chunks(t)
        encoder.learn([k for k in keys if k not in encoder.memo])
        assert b"".join(encoder.memo[k] for k in keys) == w


def test_paragraphs_make_a_table_of_words(spark):
    """Empty lines, tabs and double spaces do not make a text one word."""
    some = [f"word{k}" for k in range(200)]
    texts = ["\n\n".join("  ".join(some[(k * 7 + j * 3 + i) % 200] for i in range(12)) + "\tend." for j in range(6)) for k in range(1000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    table = words.coded(docs, bpe._cut(path), F.lit(False), "test-words", 4)
    known = [w for r in words.words_of(table).collect() for w in words.read_words(bytes(r.data))[0]]
    assert len(set(known)) <= 3 * 200 + 5 and sum(map(len, set(known))) * 50 < sum(map(len, texts))
    got = {r.doc_id: r.ids for r in bpe.encoded(docs, path, lambda ids, decoded: (ids, decoded), "ids binary, decoded string").collect()}
    encoder = tokens.Encoder(path)
    assert all(bytes(got[k]) == encoder.library(t) for k, t in enumerate(texts[:50]))


def test_address_and_markup_decide_in_the_query(spark, tmp_path):
    """A text that tells nothing is judged by the address in it; markup is believed before the column."""
    from plumbline.llm.queries import op4_language_id

    # the letters of both suffixes stand equally often in both languages: only the address tells
    en, fr = "the house and the tree stand there <html lang .fr/ .fr/ .uk/ http://a.uk/", "la maison et un arbre sont là <html lang .fr/ .uk/ .uk/ http://a.fr/"
    rows = [(k, f"{en if k % 2 else fr} {k}", "en" if k % 2 else "fr", f"s{k % 2}") for k in range(1200)]
    rows += [(10000, "http://a.fr/ .uk/", None, "new"), (10001, "http://a.uk/ .fr/", None, "new")]
    rows += [(10003, "<html lang=fr <html lang .fr/ .uk/ <html lang", "en", "new"), (10004, "<html lang fr <html lang .fr/ .uk/ <html lang", "en", "new")]
    spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op4_language_id(spark, str(tmp_path)).collect()}
    evidence = language_id.evidence_of_documents(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    without = {r.key: r.lang for r in language_id.identify(evidence.withColumn("suffix", F.lit(None).cast("string"))).collect()}
    assert [got[k].lang for k in (10000, 10001)] == ["fr", "en"] and without[10000] == without[10001]
    assert got[10003].declared == "fr" and got[10004].declared == "en"
    assert got[10003].lang == "fr" and got[10004].lang == "en"


def test_a_rare_language_has_a_model(spark):
    """Seventy languages, of five rows each: each is told from the others."""
    import random

    r = random.Random(3)
    alphabet = [chr(c) for c in range(0x100, 0x180)]
    words = {f"l{k}": ["".join(r.choices(r.sample(alphabet, 12), k=5)) for _ in range(12)] for k in range(70)}
    rows = [(k * 5 + i, " ".join(r.choices(ws, k=60)), lang, "h", None) for k, (lang, ws) in enumerate(words.items()) for i in range(5)]
    df = spark.createDataFrame(rows, "key long, text string, declared string, host string, suffix string")
    got = language_id.identify(df).collect()
    assert sum(x.lang == x.declared and x.accepted for x in got) >= 0.97 * len(got)


def test_a_compaction_that_loses_a_race_commits_on_the_version_that_won(spark, awkward):
    store = sharding.ShardStore(spark, new_folder(spark, "t-shards"), target=1 << 20, small_rows=2, min_merge=2)
    store.append(awkward)
    store.append(awkward)
    commit, lost = store._commit, []

    def late(*args):
        if len(lost) < 2:  # an append gets in before the compaction's first two tries
            lost.append(sharding.ShardStore(spark, store.root, small_rows=100).append(awkward).version)
        return commit(*args)

    store._commit = late
    after = store.compact()
    store._commit = commit
    assert len(lost) == 2 and after.version > max(lost) and rows(store.read(), *awkward.columns) == Counter({k: 4 * v for k, v in rows(awkward, "*").items()})


def test_two_compactions_of_the_same_files_do_not_both_commit(spark, awkward):
    store = sharding.ShardStore(spark, new_folder(spark, "t-shards"), target=1 << 20, small_rows=2, min_merge=2)
    store.append(awkward)
    commit, won = store._commit, []

    def late(*args):
        if not won:
            won.append(sharding.ShardStore(spark, store.root, target=1 << 20, min_merge=2).compact())
        return commit(*args)

    store._commit = late
    with pytest.raises(sharding.Conflict):
        store.compact()
    assert rows(store.read(), *awkward.columns) == rows(awkward, "*")


def test_arrivals_make_up_the_whole_table(spark, empty):
    from plumbline.llm.queries import op1_sharding

    got = op1_sharding(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows(got, "doc_id", "text_sha256", "lang", "source", "n_chars") == rows(docs.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "lang", "source", "n_chars"), "*")


def test_an_access_reads_a_few_blocks_of_a_shard():
    r = np.random.default_rng(2)
    x = np.minimum(r.zipf(1.3, 400_000), 50_000).astype(np.uint32)
    data = wavelet.to_bytes(np.array([3], np.int64), np.array([len(x)], np.uint32), x, 16)
    keys, counts, whole = wavelet.from_bytes(data)
    assert keys.tolist() == [3] and counts.tolist() == [len(x)] and (whole.decode() == x).all()
    open_ = lambda: wavelet.StoredMatrix(lambda at, size: data[at : at + size])
    m = open_()
    opened = m.bytes_read
    assert opened < 8000
    assert m.access(123_456) == x[123_456] and m.bytes_read - opened <= 16 * (wavelet.BLOCK // 8)
    for i in (0, 1, wavelet.BLOCK - 1, wavelet.BLOCK, len(x) - 1):
        assert m.access(i) == x[i]
    for s in (1, 2, 77, 49_999, 50_000, 60_000, 70_000):
        at = np.flatnonzero(x == s)
        assert m.count(s) == len(at) and m.rank(s, 200_000) == (at < 200_000).sum() and m.rank(s, len(x)) == len(at)
        for k in {0, len(at) // 2, len(at) - 1} if len(at) else ():
            assert m.select(s, k) == at[k]
    with pytest.raises(IndexError):
        m.access(len(x))
    with pytest.raises(ValueError, match="does not fit"):
        wavelet.to_bytes(keys, counts, np.array([70_000], np.uint32), 16)
    empty = wavelet.StoredMatrix(lambda at, size, d=wavelet.to_bytes(np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.uint32), 16): d[at : at + size])
    assert empty.count(5) == 0 and len(m._held) <= 256


def test_occurrences_over_shards(spark, awkward):
    folder = new_folder(spark, "t-tokens")
    shards = wavelet.store(wavelet.write(awkward, BYTE, folder, shard_tokens=60), "t-manifest")
    ids = spark.createDataFrame([(2,), (13,), (262,), (49_000,)], "id long")
    got = {(r.id, r.shard): (r.n, list(r.first)) for r in wavelet.occurrences(spark, folder, shards, ids, 3).collect()}
    want = {}
    for f in spark.read.format("binaryFile").load(folder + "/*.plwm").collect():
        x = wavelet.from_bytes(bytes(f.content))[2].decode()
        for s in (2, 13, 262, 49_000):
            at = np.flatnonzero(x == s).tolist()
            if at:
                want[s, f.path.rsplit("/", 1)[-1]] = (len(at), at[:3])
    assert got == want and len(want) > 4
