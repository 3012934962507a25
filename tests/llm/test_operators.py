"""Each operator against a plain version of it, on odd rows, and on none."""

from __future__ import annotations

import math
import os
import random
import struct
import subprocess
import sys
import timeit
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwork.llm import ann, base, bpe, chat, components, lines, lm, packing, quality, secrets, simhash, toxicity

from . import brute
from .conftest import SCHEMA, corpus, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer):
    return lambda t: struct.pack(f"<{len(i := tokenizer.encode(t or '', add_special_tokens=False).ids)}I", *i)


# 1: lines


def test_lines_with_a_word(spark):
    """Only ASCII white space is blank, wherever it stands."""
    firsts = [chr(k) for k in range(10)] + [chr(k) for k in range(11, 34)] + ["\x7f", "\x85", "\xa0", "\u2028", "\u3000", "é", "😀"]
    text = "\n".join([x + y for x in ["", *firsts] for y in ("", " ", "\t", "a")])
    got = {r.line_no for r in lines.lines_of(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert got == {k for k, x in enumerate(text.split("\n")) if x.strip(" \t\n\x0b\x0c\r")}


def test_lines(docs):
    got = {r.doc_id: r for r in lines.summary(lines.decide(docs), docs).collect()}
    expected = {i: {} for i, _ in corpus()} | brute.removed_lines(corpus())
    assert set(got) == set(expected)
    for i, gone in expected.items():
        assert got[i].removed == ",".join(map(str, sorted(gone))), i
        assert (got[i].n_exact, got[i].n_near) == (sum(v == "exact" for v in gone.values()), sum(v == "near" for v in gone.values()))
    assert sum(r.n_near for r in got.values()) > 0


def test_ranks_are_not_printed_in_plans(spark, docs):
    every = lines.lines_of(docs)
    ranks, _ = lines.rarity(every)
    sets = lines._sets(every, ranks)
    assert len(sets._jdf.queryExecution().toString()) < 50_000
    numbers = [5, -(2**63), 2**63 - 1, 0]
    assert spark.range(1).select(lines._constant(spark, numbers).alias("x")).first()["x"] == numbers


def test_shingles_are_known_not_to_be_null(spark, docs):
    """Else Spark sorts them as boxed numbers."""
    every = lines.lines_of(docs)
    assert not lines._sets(every, lines.rarity(every)[0]).schema["set"].dataType.containsNull


def test_documents_of_places(spark):
    ids, numbers = [None, -(2**63) + 1, -2, -1, 0, 1, 2**63 - 1], [0, 1, 2**31 - 1]
    rows = spark.createDataFrame([(i, k) for i in ids for k in numbers], "doc_id long, line_no int")
    assert [r.doc for r in rows.select(lines._document(lines.place()).alias("doc")).collect()] == [-(2**63) if i is None else i for i in ids for _ in numbers]


@pytest.mark.parametrize("sample", [1, lines.SAMPLE])
def test_lines_near_the_bound(spark, monkeypatch, sample):
    """Copies with a few words changed, and common passages, at all sizes; ranks, if need be of none or few lines, change no result."""
    rng = random.Random(5)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 3000}"
    passages = [[word() for _ in range(25)] for _ in range(3)]
    every = []
    for size in [*range(1, 30), *range(30, 90, 5)]:
        first = [word() for _ in range(size)]
        mixed = first + rng.choice(passages)
        for base in (first, mixed):
            every.append(base)
            for _ in range(6):
                other = list(base)
                for _ in range(rng.randint(0, 1 + size // 25)):
                    at = rng.randrange(len(other))
                    other[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 2)
                every.append(other or ["x"])
    rng.shuffle(every)
    rows = [(k - 50, "\n".join(" ".join(x) for x in every[7 * k : 7 * k + 7])) for k in range(-(-len(every) // 7))]
    expected = brute.removed_lines(rows)
    assert sum(x == "near" for gone in expected.values() for x in gone.values()) > 50
    monkeypatch.setattr(lines, "SAMPLE", sample)
    got = lines.decide(spark.createDataFrame(rows, "doc_id long, text string")).where("exact or near").collect()
    assert {(r.doc_id, r.line_no): "exact" if r.exact else "near" for r in got} == {(i, k): x for i, gone in expected.items() for k, x in gone.items()}


def test_lines_with_little_in_common_are_not_verified(spark):
    """Lines that share one rare shingle of a prefix and else nothing."""
    rows = spark.createDataFrame([(t, h, h, float(h), 40, 0, 1 if h < 3 else 5, 9, h) for t, h in ((5, 1), (5, 2), (9, 3), (9, 4), (8, 3), (8, 4), (7, 3), (7, 4), (6, 3), (6, 4), (4, 3), (4, 4))], "token long, h long, g long, place double, n int, pos int, c int, last long, doc long")
    others = rows.select("token", F.struct("place", "h", "g", "n", "pos", "c", "last", "doc").alias("o"))
    assert {(r.h, r.o_h) for r in lines._candidates(rows, others, 0.8).collect()} == {(4, 3)}
    lead = rows.groupBy("token").agg(F.min(F.struct("place", "h", "g", "n", "pos", "c", "last", "doc")).alias("o"))
    assert {(r.h, r.o_h) for r in lines._led(rows, lead, 0.8).collect()} == {(4, 3)}


def test_lines_taken_out(docs, texts, odd, empty):
    out = lines.remove_lines(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    gone = brute.removed_lines(corpus())
    for r in out.collect():
        text = texts[r.doc_id]
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone.get(r.doc_id, {}))
        assert r.text == kept and (r.n_chars == len(kept or "")) and r._gone == 1
    assert sorted((r.doc_id or 0, r.text or "") for r in lines.remove_lines(odd).collect()) == [(0, ""), (0, "a b c d e f g h"), (1, ""), (1, ""), (2, ""), (3, "")]
    assert lines.decide(empty).isEmpty() and lines.remove_lines(empty).isEmpty()


# 2: secrets


def test_secrets(docs, texts, odd, empty):
    for r in secrets.digests(secrets.scan(docs)).collect():
        spans = brute.base_spans(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        assert r.base_sha256 == brute.sha(brute.told(spans))
        assert set(brute.told(spans).split(",")) <= set(r.spans.split(","))
    assert secrets.digests(secrets.scan(odd)).count() == 6 and secrets.scan(empty).isEmpty()


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(60)]
    plain = ["internationalizationwithoutborders", "/usr/local/lib/python/site/packages", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "thisIsACamelCaseIdentifierInSomeProgram2"]
    df = spark.createDataFrame([(k, f"key {x} end") for k, x in enumerate([*keys, *plain])], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.digests(secrets.scan(df)).collect()}
    assert sum(got[k].n_random for k in range(60)) >= 48
    assert all(got[60 + k].n_random == 0 for k in range(len(plain)))
    assert all(got[k].spans == "random:4:44" for k in range(60) if got[k].n_random)


def test_random_tokens_are_found_after_any_separator(spark):
    rng = random.Random(6)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(20)]
    before = ["key ", "aws_key=", "Authorization=", "https://h/x?sig=", "x: ", "x='", 'x="', "a==", "aGVsbG8gd29ybGQgYWdhaW4gYW5k=="]
    df = spark.createDataFrame([(j * 100 + k, f"{b}{x} end") for j, b in enumerate(before) for k, x in enumerate(keys)], "doc_id long, text string")
    got = {r.doc_id: r.spans.split(",") for r in secrets.digests(secrets.scan(df)).collect()}
    found = [k for k in range(20) if got[k] != [""]]
    assert len(found) >= 16
    for j, b in enumerate(before[:-1]):
        assert all(got[j * 100 + k] == [f"random:{len(b)}:{len(b) + 40}"] for k in found)
    assert sum(f"random:{len(before[-1])}:{len(before[-1]) + 40}" in got[(len(before) - 1) * 100 + k] for k in found) >= 14  # two candidates, so a stricter control


@pytest.mark.parametrize("alphabet, n, least", [("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 20, 0.35), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 40, 0.85), ("abcdefghijklmnopqrstuvwxyz234567", 40, 0.85), ("0123456789abcdef", 20, 0.85), ("0123456789ABCDEF", 24, 0.85), ("abcdefghijklmnopqrstuvwxyz0123456789", 32, 0.9), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 40, 0.9)])
def test_random_tokens_of_one_case_are_found(spark, alphabet, n, least):
    """Alone, and as one of 20 candidates, where rarer p are asked for."""
    rng = random.Random(7)
    keys = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(200)]
    others = " ".join(f"initf{k}modhooksdynamic{k}" for k in range(10, 29))
    df = spark.createDataFrame([(k + add, f"{x} {more}") for add, more in ((0, ""), (1000, others)) for k, x in enumerate(keys)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.digests(secrets.scan(df)).collect()}
    assert set(got.values()) <= {"", f"random:0:{n}"}
    assert sum(got[k] != "" for k in range(200)) >= least * 200
    assert sum(got[k + 1000] != "" for k in range(200)) >= (2 * least - 1) * 200


def test_ordinary_tokens_of_one_case_are_not_found(spark):
    plain = ["internationalization2024version", "sha256withrsaencryption2048", "imagecreatefromgd2part", "ucs4stringtowidestring", "CUSTOMERORDERNUMBER20240115", "data1data2data3data4data5", "20240115123456000000abc", "deadbeef000000000000cafe", "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef0123456789", "backup20240131version12final"]
    df = spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")
    assert {r.spans for r in secrets.digests(secrets.scan(df)).collect()} == {""}


def test_redaction(docs, texts):
    out = secrets.redact(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    got = {r.doc_id: r for r in out.collect()}
    assert got[68].text == '[secret] [secret] [secret]" secret = short' and got[68].n_chars == len(got[68].text)
    assert got[60].text is None and got[5].text == texts[5] and got[30].all_spans == "a" and "hunter2" not in got[30].text


# 3: fingerprints


def test_fingerprints(docs, odd, empty):
    expected = brute.near_fingerprints(corpus())
    for shard in (simhash.SHARD, 7):  # one shard, and many
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, shard=shard).collect()}
        assert got == expected
    assert simhash.near_duplicates(odd).count() == 6 and simhash.near_duplicates(empty).isEmpty()
    assert simhash.keep_first(odd).count() == 5 and simhash.keep_first(empty).isEmpty()


def test_fingerprints_over_shards(spark):
    """Dense fingerprints: the components of all pairs, found by many shards."""
    rng = random.Random(8)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = {rng.choice(centres) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (2**64 - 1) for _ in range(600)}
    found, values = set(), sorted(fps)
    for radius in (4,):
        union = simhash._Union(np.array(values, np.uint64))
        linked = np.zeros(len(values), bool)
        every = np.arange(len(values))
        simhash._search(every, every, np.array(values, np.uint64), 0, radius, union, linked)
        classes = brute.union(values, [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= radius])
        found = {int(v): int(c) for v, c in zip(values, union.label)}
        assert found == classes


def test_shards_lose_no_link_and_visits_stay_bounded(spark):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(30)]
    flips = lambda most: sum(1 << k for k in rng.sample(range(64), rng.randint(0, most)))
    values = sorted({rng.choice(centres) ^ flips(4) for _ in range(900)} | {rng.getrandbits(64) for _ in range(300)} | {centres[0] ^ flips(3) for _ in range(400)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    points = spark.createDataFrame([(signed(v),) for v in values], "fp long").cache()
    expected = brute.union(values, [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= 4])
    for shard, most in ((4096, 32_768), (50, 60), (4, 1000)):  # one shard; shards cut into parts; many shards
        got = brute.union(values, [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.stars(points, shard=shard, most=most).collect()])
        assert got == expected
    for n in (10 * 4096, 1000 * 4096, 10**6 * 4096):
        visits = simhash.shards(points, n, 4, 4096, 32_768).groupBy("fp").count()
        assert {r["count"] for r in visits.collect()} == {5}
    parts = simhash.shards(points, 10, 4, 4096, 400)  # one hot shard: every point meets every part, no task holds more than two
    assert {r["count"] for r in parts.groupBy("fp").count().collect()} == {4}
    assert parts.groupBy("i", "j").count().agg(F.max("count")).first()[0] < 1000


def test_small_tables_are_written_in_few_files(spark, docs, monkeypatch):
    held = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, counts = {k: spark.conf.get(k) for k in held}, []

    def counted(df, *args, cut=base.cut):
        out = cut(df, *args)
        counts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(simhash, "cut", counted)
    monkeypatch.setattr(components, "cut", counted)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        simhash.near_duplicates(docs).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(counts) > 5 and max(counts) <= 2 * spark.sparkContext.defaultParallelism


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    got = {r.id: r.component_id for r in components.components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    classes = brute.union({x for p in links for x in p}, links)
    assert got == {x: classes[x] for a, b in links if a != b for x in (a, b)}


# 4: vectors


def vectors_of(rng) -> list[tuple[int, list[float]]]:
    centres = rng.standard_normal((15, 24))
    rows = [(k, (centres[k % 15] + rng.standard_normal(24) * (0.22 if k % 3 else 0.5)).tolist()) for k in range(900)]
    return rows + [(900 + k, rows[7][1]) for k in range(450)]  # a third are copies


def test_vectors(spark):
    rows = vectors_of(np.random.default_rng(1))
    df = spark.createDataFrame([(i, v, i % 3, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, point string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in ann.near_duplicates(df, shard=200).collect()}
    expected = brute.near_vectors(rows)
    total = sum(n for n, _ in expected.values())
    assert sum(n for n, _ in got.values()) >= 0.99 * total and all(got[i][0] <= expected[i][0] for i in got)
    assert np.mean([got[i][1] == expected[i][1] for i in got]) >= 0.99


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [1.0, None]), (5, [inf, 1.0]), (6, []), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0, 1.0]), (10, [1e300, 1e300]), (11, [-1.0, -1.0]), (7, [1.0, 1.0]), (None, [5.0, -5.0])]
    out = ann.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    assert len(out) == len(rows)
    assert all(got[k] == (0, k, True) for k in (1, 2, 3, 4, 5, 6, 9, 11))
    assert got[7] == (3, 7, True) and got[8] == (3, 7, False) and got[10] == (3, 7, False)
    assert ann.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).isEmpty()


# 5: chat


def test_chat(spark):
    odd = ["", "</s>", "[INST] x [/INST]", "\\", "<\\s>", "<\\\\/s> [\\/INST]", "<s>", "<<SYS>>\n\n<</SYS>>", " </s> ", "[/ROLE] [ROLE]", "\n", "<<s>>", "日本<s>語"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate((r, t) for r in ("user", "assistant", "system", "tool</s>", "") for t in odd)]
    rows += [(2, 0, "user", None), (2, 1, None, "x"), (3, None, "assistant", "a"), (3, 0, "assistant", "b"), (None, 0, "user", "u"), (4, 1, "user", "same"), (4, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for c in got:
        turns = sorted((-1 if t is None else t, r or "", x or "") for i, t, r, x in rows if i == c)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == brute.sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == brute.sha(loss)
    assert chat.format_conversations(df.where("false")).isEmpty()


def test_chat_ignores_columns_whose_names_clash(spark):
    names = ("formatted", "escaped", "turns", "n_turns", "loss_chars", "piece", "digest")
    df = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "</s> there")], "conv_id long, turn long, role string, text string")
    more = df.withColumns({n: F.lit("x") for n in names})
    assert chat.digests(chat.format_conversations(more)).collect() == chat.digests(chat.format_conversations(df)).collect()


def test_a_text_without_control_strings_stays_as_it_is(spark):
    df = spark.createDataFrame([(1, 0, "user", "a \\ b"), (1, 1, "assistant", "c")], "conv_id long, turn long, role string, text string")
    r = chat.format_conversations(df).first()
    assert r.formatted == "<s>[INST] a \\ b [/INST] c </s>" and not r.escaped


# 6: BPE


def test_bpe(docs, texts, odd, empty, tokenizer):
    lexicon = bpe.build_lexicon(docs, PATH)
    for r in bpe.encode_documents(docs, PATH, lexicon, keep_ids=True).collect():
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        assert r.ids == struct.pack(f"<{len(ids)}I", *ids), r.doc_id
        assert r.n_tokens == len(ids) and r.ids_sha256 == brute.sha(r.ids) and r.decoded_sha256 == brute.sha(back)
        assert bpe.decode(r.ids, PATH) == back
    assert bpe.encode_documents(odd, PATH).count() == 6 and bpe.encode_documents(empty, PATH, bpe.build_lexicon(empty, PATH)).isEmpty()


def test_words_are_counted_once_and_handed_on_as_sums(docs, texts, monkeypatch):
    letters, every = bpe.tables()[0], [text or "" for text in texts.values()]
    plain = Counter(w for text in every for w in bpe.letters_pattern(letters).findall(text.lower()))
    for share, most in ((1 << 40, 1 << 40), (64, 1 << 40), (1 << 40, 500), (64, 500)):
        parts = [*bpe.count_words(every, letters, share, most)]
        assert (len(parts) > 1) == (most == 500) and all(len(part) <= min(share, most + max(map(len, every))) + 1 for part in parts)
        summed = sum(map(Counter, parts), Counter())
        total = summed.pop("")
        assert all(n - total / share < summed[w] <= n for w, n in plain.items())
    plans, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: (collect(self), plans.append(self._jdf.queryExecution().executedPlan().toString()))[0])
    words = set(bpe.frequent_words(docs, 200))
    assert {w for w, n in plain.items() if n * 180 >= total} <= words and all(plain[w] * 200 >= total for w in words)
    assert "ReusedExchange" in plans[-1] and "Generate" not in plans[-1]


def test_lexicon_is_minimal_and_exact():
    words = {w: (k, k + 1) for k, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", "a", "Ω"])}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    assert len(lexicon) == len(words) and all(lexicon.find(w) == ids for w, ids in words.items())
    assert all(lexicon.find(w) is None for w in ("", "t", "ta", "tapss", "b", "sto"))
    assert len(lexicon.starts) - 1 < 1 + sum(map(len, words))  # suffixes are shared
    assert bpe.Lexicon(bpe.compile_lexicon({})).find("x") is None


def test_every_code_point_is_encoded_as_in_the_library(tokenizer):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = ["".join(f"x{c}y1{c} " for c in chars[k : k + 128]) for k in range(0, len(chars), 128)]
    rng = random.Random(12)
    marks = [c for c in chars if unicodedata.category(c)[0] == "M"]
    rows += ["".join(rng.choice(rng.choice((chars, marks, "aeΣİ'sd1 "))) for _ in range(12)) for _ in range(20_000)]
    encoder, found = bpe.Encoder(PATH), tokenizer.encode_batch(rows, add_special_tokens=False)
    assert not [r for r, x in zip(rows, found) if encoder.encode(r) != struct.pack(f"<{len(x.ids)}I", *x.ids)]


def test_classes_are_cut_to_the_range_of_a_text():
    """Same words, in much less than the time that going through the ranges beyond takes."""
    letters, numbers, _ = bpe.tables()
    whole, cut = bpe.word_pattern(letters, numbers).findall, bpe.word_finder(letters, numbers)
    rng, pool = random.Random(1), [*"aZéß1½,$#' \x1c\x85\u3000\u0301数１😀\U00010400\U0001d7ce", "'s", "'re"]
    for _ in range(20_000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))
        assert cut(text) == whole(text), text
    for text in ("word," * 20_000, "çoule," * 20_000):
        took = [min(timeit.repeat(lambda f=f, text=text: f(text), number=1, repeat=5)) for f in (whole, cut)]
        assert took[1] < 0.7 * took[0], took


def test_very_long_words(tokenizer):
    rng = random.Random(13)
    words = ["x" * 200_000, "".join(rng.choice("etaoinshrdlu") for _ in range(100_000)), "".join(rng.choice("ab") for _ in range(300)), "日本語" * 5000, "!" * 30_000]
    for word in [*words, " ".join(words)]:
        assert bpe.Encoder(PATH).encode(word) == ids_of(tokenizer)(word)
    vocabulary = bpe.Vocabulary.load(PATH)
    for n in (2, 5, 40, 127):
        word = "".join(rng.choice("etaoinshrdlu") for _ in range(n))
        parts = [*map(vocabulary.inner.__getitem__, word.encode())]
        parts[-1] = vocabulary.last[ord(word[-1])]
        assert vocabulary._merge_long(parts) == vocabulary.merge(word)


def test_remembered_words_stay_bounded():
    encoder = bpe.Encoder(PATH, most=20_000)
    text = " ".join(f"word{k}" for k in range(5000))
    assert encoder.encode(text) == bpe.Encoder(PATH).encode(text)
    assert 0 < len(encoder.memo) <= 80 and len(encoder.memo.old) <= 80


# 7: quality


def test_quality(spark, docs, texts, odd, empty):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    llr = brute.log_ratios(corpus(), {k for k in range(40) if k % 2}, quality.BUCKETS)
    for r in quality.judge(docs, labels).collect():
        base = brute.quality_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base, r.doc_id
        assert r.base_failed == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        assert r.llr == pytest.approx(llr[r.doc_id], abs=2e-6) and r.kept == (not r.base_failed and llr[r.doc_id] >= quality.THRESHOLD)
    assert quality.judge(odd, labels).count() == 6 and quality.judge(empty, labels).isEmpty() and quality.judge(odd, labels.where("false")).count() == 6


# 8: language model


def test_language_model(docs, odd, empty):
    expected = {i: s for (i, _), s in zip(corpus(), brute.backoff_scores([t for _, t in corpus()]))}
    for chars in (lm.BATCH_CHARS, 20_000):  # one batch, and many
        for r in lm.score_documents(docs, chars).collect():
            n, score = expected[r.doc_id]
            assert r.n_tokens == n and r.log_score == pytest.approx(score, rel=1e-9)
            assert r.mean_log_score == (pytest.approx(score / n) if n else None)
    assert lm.score_documents(odd).count() == 6 and lm.score_documents(empty).isEmpty()


def test_language_model_of_longer_ngrams(spark, docs, odd, empty):
    rows = [[None, *(t or "").encode().lower().split()] for _, t in corpus()]
    grams = lambda w, m: Counter(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    for order in (3, 4):
        every, total = Counter(), sum(len(w) - 1 for w in rows)
        for w in rows:
            every.update(g for m in range(1, order + 1) for g in grams(w, m).elements())
        expected = {}
        for (i, _), w in zip(corpus(), rows):
            own = Counter(g for m in range(1, order + 1) for g in grams(w, m).elements())
            n, score = lambda g: every[g] - own[g], 0.0  # noqa: E731, B023
            for k in range(1, len(w)):
                for back, m in enumerate(range(min(order, k + 1), 0, -1)):
                    g = tuple(w[k + 1 - m:k + 1])
                    if m == 1 or n(g) > 0:
                        score += back * math.log(0.4) + math.log(n(g) / n(g[:-1]) if m > 1 else max(1, n(g)) / max(1, total - len(w) + 1))
                        break
            expected[i] = score
        for chars in (lm.BATCH_CHARS, 20_000):
            for r in lm.score_documents(docs, chars, order=order).collect():
                assert r.log_score == pytest.approx(expected[r.doc_id], rel=1e-9), r.doc_id
    assert lm.score_documents(odd, order=3).count() == 6 and lm.score_documents(empty, order=3).isEmpty()
    salad = "a b d e b c"  # all its pairs stand in other rows, in other contexts
    both = frame(spark, [(1, "x a b c"), (2, "y a b c"), (3, "z d e b d"), (4, "b d e"), (5, "e b c"), (6, "q a b c"), (7, salad)])
    two, three = ({r.doc_id: r.log_score for r in lm.score_documents(both, order=k).collect()} for k in (2, lm.ORDER))
    assert two[7] - three[7] > two[1] - three[1] > 0


def test_language_model_packs_what_it_shuffles(spark):
    """Over a table whose n-grams are all but distinct, bytes through shuffles by words; unpacked they were 28."""
    rng = random.Random(8)
    names = ["".join(rng.choices("aeioumnrstdlkp", k=rng.randint(2, 8))) for _ in range(20_000)]
    rows = [(k, " ".join(rng.choices(names, k=1000))) for k in range(200)]
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def shuffled() -> int:
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = shuffled()
    assert lm.score_documents(frame(spark, rows), 200_000, order=3).count() == 200
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert 0 < (shuffled() - before) / 200_000 < 24


def test_language_model_where_workers_lack_the_package(sf_dir, tmp_path):
    """The package is on the driver's path only, and has to be sent before the first function."""
    run = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.abspath(lm.__file__)).removesuffix("/loomwork/llm")!r})
from pyspark.sql import SparkSession
from loomwork.llm import lm
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
assert lm.op8_lm(spark, {sf_dir!r}).collect()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", run], cwd=tmp_path, env=env, check=True, timeout=120)


@pytest.mark.parametrize("random_bytes", [0, 5])
def test_packed_numbers_come_back(random_bytes):
    rng = np.random.default_rng(5)
    for numbers in ([], [0], [2**64 - 1], [0, 1, 255, 256, 2**40, 2**63], rng.integers(0, 2**64, 3000, np.uint64), rng.integers(0, 3, 100_000)):
        numbers = np.array(numbers, np.uint64)
        assert np.array_equal(lm.unpacked(lm.packed(numbers, random_bytes), random_bytes), numbers)
    assert len(lm.packed(np.ones(100_000, np.uint64))) < 1000


# 9: toxicity


def labelled(spark):
    rng = random.Random(4)
    words = ["bread", "river", "stone", "letter", "window", "garden", "music", "road", "women", "muslims", "gay", "old"]
    docs, labels = [], []
    for k in range(1500):
        text = [rng.choice(words[:8]) for _ in range(12)]
        toxic = k % 4 == 0
        if toxic:
            text[rng.randrange(12)] = rng.choice(["idiots", "scumbag", "vermin"])
        if rng.random() < (0.5 if toxic else 0.1):
            text[rng.randrange(12)] = rng.choice(words[8:])
        docs.append((k, " ".join(text)))
        labels.append((k, 1, int(toxic)))
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, odd, empty):
    docs, labels = labelled(spark)
    weights, bias = toxicity.trained(docs, labels)
    got = toxicity.score_documents(docs, weights, bias).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert 200 < len(held) < 400 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.95
    one = lambda t: toxicity.score_documents(frame(spark, [(1, t)]), weights, bias).first().score
    assert all(one(f"bread {w} river stone") < 0.5 for w in ("women", "muslims", "gay", "men"))
    assert abs(one("bread women river") - one("bread men river")) < 0.2
    clean = toxicity.keep_clean(docs, labels)
    assert clean.schema.simpleString() == docs.schema.simpleString() and clean.count() == sum(1 - r.predicted for r in got)
    assert toxicity.score_documents(odd, weights, bias).count() == 6 and toxicity.score_documents(empty, weights, bias).isEmpty()
    assert toxicity.trained(odd, labels.where("false")) == ({}, math.log(0.5)) and toxicity.keep_clean(odd, labels.where("false")).count() == 6 and toxicity.keep_clean(empty, labels).isEmpty()


def test_scores_equal_a_plain_sum_over_words(spark):
    docs, labels = labelled(spark)
    weights, bias = toxicity.trained(docs, labels)
    for r in toxicity.score_documents(docs, weights, bias).join(docs.select("doc_id", "text"), "doc_id").collect():
        z = bias + sum(weights.get(f, 0.0) for w in set(r.text.split()) for f in [w, *("^" + w[:k] for k in (3, 4, 5, 6) if len(w) >= k)])
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_penalty_makes_neutral_mentions_count_less(spark, monkeypatch):
    docs, labels = labelled(spark)
    scores = {}
    for penalty in (0.0, toxicity.COUNTERFACTUAL):
        monkeypatch.setattr(toxicity, "COUNTERFACTUAL", penalty)
        weights, bias = toxicity.trained(docs, labels)
        rows = frame(spark, [(k, f"bread {w} river stone") for k, w in enumerate(("women", "muslims", "gay", "old", "plain"))])
        found = {r.doc_id: r.score for r in toxicity.score_documents(rows, weights, bias).collect()}
        scores[penalty] = [found[k] - found[4] for k in range(4)]
    assert sum(scores[toxicity.COUNTERFACTUAL]) < 0.5 * sum(scores[0.0]) and sum(scores[0.0]) > 0.05


def test_fit_equals_the_same_steps_over_dense_tables():
    rng, n = np.random.default_rng(3), 12
    rows = [sorted(rng.integers(0, n - 1, rng.integers(0, 6)).tolist()) for _ in range(60)]  # empty rows, repeats, a feature that none holds
    labels = rng.integers(0, 2, 60).astype(float)
    twins = [(x, sorted([*x[1:], int(rng.integers(0, n))])) for x in rows if x][:20] * 2 + [([1, 2], [1, 2])]
    table = lambda lists: np.array([np.bincount(np.array(x, int), minlength=n) for x in lists], float)
    x, d = table(rows), table([a for a, _ in twins]) - table([b for _, b in twins])
    for kept, change in ((twins, d), ([], np.zeros((1, n)))):
        w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
        w[n] = math.log((labels.sum() + 1) / (60 - labels.sum() + 1))
        for k in range(1, 101):
            off = 1 / (1 + np.exp(-(x @ w[:n] + w[n]))) - labels
            g = np.append(x.T @ off / 60 + 2 * toxicity.COUNTERFACTUAL * change.T @ (change @ w[:n]) / len(change) + toxicity.RIDGE * w[:n], off.mean())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8) * min(1, 2 - 2 * k / 100)
        assert np.allclose(toxicity.fit(rows, labels, n, kept, rounds=100), w, atol=1e-6)
    assert np.isfinite(toxicity.fit([[]], np.array([1.0]), 0, [])).all()


def test_held_out_labels_are_never_learned(spark):
    docs, labels = labelled(spark)
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.trained(docs, labels) == toxicity.trained(docs, other)


# 10: packing


@pytest.mark.parametrize(("capacity", "window"), [(4096, 256), (64, 4)])
def test_packing(docs, texts, tokenizer, capacity, window):
    rows = packing.pack_documents(docs, PATH, capacity=capacity, window=window).collect()
    assert brute.packing_faults(rows, texts, ids_of(tokenizer), capacity) == []
    assert brute.padding(rows, capacity) == 0


def test_packing_odd_rows(odd, empty):
    rows = packing.pack_documents(odd, PATH).collect()
    assert sum(r.length for r in rows if r.start == 0) >= 6 and sum(r.doc_tokens == 1 for r in rows) == 3
    assert packing.pack_documents(empty, PATH).isEmpty()


def test_schema_has_clashing_names():
    assert {"words", "_gone", "h", "all_spans"} <= {c.split()[0] for c in SCHEMA.split(", ")}
