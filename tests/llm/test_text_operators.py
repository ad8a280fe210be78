"""Audio, packing, language, byte-level BPE, token counts, URLs, quality and toxicity."""

import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geolith.llm import op1_mpeg_audio as audio
from geolith.llm import op3_toxicity as toxicity
from geolith.llm import op5_packing as packing
from geolith.llm import op6_language_id as language
from geolith.llm import op7_byte_bpe as bpe
from geolith.llm import op8_token_counts as counts
from geolith.llm import op9_url_filters as urls
from geolith.llm import shared
from geolith.llm.op10_quality_rules import Limits, quality
from geolith.llm.registry import fold
from tests.llm.cases import WORDS, documents, empty, odd, sample

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


@pytest.mark.parametrize("make", [odd, empty, sample])
def test_audio_round_trip(spark, make):
    df = make(spark)
    found = audio.store_media(df, keep_media=True).collect()
    assert len(found) == df.count()
    expected = Counter((i, hashlib.sha256(p).hexdigest(), len(p), zlib.crc32(p[-16:])) for i, t in texts(df) for p in [t.encode().ljust(max(1, -(-len(t.encode()) // 192)) * 192)])
    assert Counter((r["doc_id"], r["payload_sha256"], r["payload_bytes"], r["tail_crc32"]) for r in found) == expected
    for r in found:
        assert hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"] and r["samples"] == 1152 * len(r["frame_offsets"])


def test_audio_resynchronises_and_verifies(spark):
    media, n = audio.write(b"payload " * 900)
    clean = audio.read(media)
    assert audio.payload(media, clean) == (b"payload " * 900).ljust(n) and clean.table["frames"] == len(clean.offsets) and clean.bad_checksums == 0
    at = clean.offsets[3]
    junk = audio.read(media[:at] + b"\0junk\xff\xfb\x00" + media[at:] + b"TAG" + b"title".ljust(125, b"\0"))
    assert len(junk.offsets) == len(clean.offsets) and junk.resyncs == 1 and junk.skipped == 8 and junk.tags["ID3v1"] == "title"
    damaged = bytearray(media)
    damaged[at + 10] ^= 1
    assert audio.read(bytes(damaged)).bad_checksums == 1
    df = spark.createDataFrame([(1, media, 0), (2, None, 0), (3, b"", 0), (4, b"no audio", 0)], "doc_id INT, media BINARY, samples INT")
    found = {r["doc_id"]: r for r in audio.read_media(df).collect()}
    assert found[1]["n_frames"] == len(clean.offsets) and found[1]["frame_offsets"] == clean.offsets
    assert [found[i]["n_frames"] for i in (2, 3, 4)] == [0, 0, 0] and found[4]["n_skipped"] == 8


def frame(version, layer, bitrate, rate, padding=0, mode=3, body=b""):
    """A frame by the definitions, independent of the reader's tables; no checksum."""
    kbits = {(3, 3): 64, (3, 2): 128, (3, 1): 160, (2, 3): 64, (2, 2): 64, (0, 1): 80}[version, layer]
    hertz = {3: 44100, 2: 22050, 0: 11025}[version]
    size = (12 * kbits * 1000 // hertz + padding) * 4 if layer == 1 else (72 if layer == 3 and version != 3 else 144) * kbits * 1000 // hertz + padding
    return (bytes([0xFF, 0xE0 | version << 3 | (4 - layer) << 1 | 1, bitrate << 4 | rate << 2 | padding << 1, mode << 6]) + body).ljust(size, b"\0")


@pytest.mark.parametrize(("version", "layer", "bitrate", "samples"), [(3, 3, 5, 1152), (3, 2, 8, 1152), (3, 1, 5, 384), (2, 3, 8, 576), (2, 2, 8, 1152), (0, 1, 5, 384)])
def test_audio_layers(version, layer, bitrate, samples):
    frames = [frame(version, layer, bitrate, 0, k % 2) for k in range(7)]
    found = audio.read(b"".join(frames))
    assert found.offsets == np.cumsum([0, *map(len, frames)]).tolist()[:-1] and found.samples == 7 * samples and found.skipped == 0


def test_audio_tags_and_tables():
    safe = lambda n: bytes(n >> k & 0x7F for k in (21, 14, 7, 0))
    sound = [frame(3, 3, 5, 0) for _ in range(9)]
    long = b"\3" + "é".encode() * 100
    four = b"TIT2" + safe(len(long)) + b"\0\0" + long + b"TXXX" + safe(6) + b"\0\0" + b"\0a\0b\0c"
    two = b"TT2" + (4).to_bytes(3, "big") + b"\0abc"
    assert audio.read(b"ID3\4\0\0" + safe(len(four)) + four + b"".join(sound)).tags == {"TIT2": "é" * 100, "TXXX": "a=b=c"}
    found = audio.read(b"ID3\2\0\0" + safe(len(two)) + two + b"".join(sound))
    assert found.tags == {"TT2": "abc"} and len(found.offsets) == 9 and found.table is None and found.table_fits is None
    entries = [len(sound[0]) * 4, len(sound[0]) * 4, len(sound[0])]
    head = lambda n, sizes: frame(3, 3, 5, 0, body=b"\0" * 32 + b"VBRI" + bytes(6) + ((n + 1) * len(sound[0])).to_bytes(4, "big") + n.to_bytes(4, "big") + b"".join(x.to_bytes(2, "big") for x in (len(sizes), 1, 2, 4, *sizes)))
    found = audio.read(head(9, entries) + b"".join(sound))
    assert found.table["frames"] == 9 and found.table_fits and found.toc_fits and found.offsets[0] == len(sound[0])
    assert audio.read(head(8, entries) + b"".join(sound)).table_fits is False and audio.read(head(9, entries[::-1]) + b"".join(sound)).toc_fits is False
    media, _ = audio.write(b"x" * 9000)
    clean = audio.read(media)
    assert clean.table_fits and clean.toc_fits
    shorter = audio.read(media[: clean.offsets[-1]])
    assert shorter.table_fits is False and audio.read(media.replace(clean.toc, bytes(100))).toc_fits is False


@pytest.mark.parametrize("make", [odd, empty, sample])
def test_bpe_is_exact(spark, reference, make):
    df = make(spark)
    found = bpe.encode_bpe(df, RANKS, P.PATTERN, keep_ids=True).collect()
    expected = Counter((i, tuple(reference.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts(df))
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in found) == expected
    assert all(r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest() and r["n_tokens"] == len(r["ids"]) for r in found)


def test_bpe_on_random_text(reference):
    rng = random.Random(5)
    alphabet = "ab e's\n\t 1é漢٣ ½  \x1c" + "".join(map(chr, range(0x180, 0x1000, 97)))
    encoder, pieces = bpe.cache(RANKS, P.PATTERN)
    samples = ["".join(rng.choices(alphabet, k=rng.randrange(1, 90))) for _ in range(400)] + ["a" * 5000, " " * 3000, "ab" * 400]
    for text, numbers in zip(samples, pieces.numbers(samples), strict=True):
        assert pieces.of(numbers).tolist() == reference.encode_ordinary(text)
        assert encoder.decode(pieces.of(numbers)) == text.encode()


def test_bpe_of_long_pieces(reference):
    rng = random.Random(8)
    encoder, _ = bpe.cache(RANKS, P.PATTERN)
    for alphabet, n in (("ab", 5000), ("a", 4097), ("etaoinsrhl", 5000), ("thequickbrown", 20_000), ("aé", 900), ("xyzab", 257)):
        piece = "".join(rng.choices(alphabet, k=n))
        expected = reference.encode_ordinary(piece)
        assert encoder.long(piece.encode()).tolist() == expected and encoder([piece])[0].tolist() == expected
        out = [None]
        if n <= 1000:
            encoder.matrix([piece.encode()], [0], out)
            assert out[0].tolist() == expected


def test_bpe_of_long_pieces_with_any_ranks():
    """A later token may have a smaller rank than its parts; then merges go one by one."""
    rng = random.Random(3)
    for _ in range(40):
        tokens = {bytes([i]) for i in range(256)}
        while len(tokens) < 330:
            tokens.add("".join(rng.choices("abc", k=rng.randrange(2, 6))).encode())
        order = rng.sample(sorted(tokens), len(tokens))
        encoder = bpe.Encoder.__new__(bpe.Encoder)
        encoder.ranks = {t: r for r, t in enumerate(order)}
        encoder.pairs, encoder.bytes = bpe.PairTable(encoder.ranks), np.array([encoder.ranks[bytes([i])] for i in range(256)], np.int32)
        piece = "".join(rng.choices("abc", k=60)).encode()
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            ranks = [encoder.ranks.get(parts[i] + parts[i + 1], 1 << 30) for i in range(len(parts) - 1)]
            if not ranks or min(ranks) == 1 << 30:
                break
            i = ranks.index(min(ranks))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert encoder.long(piece).tolist() == [encoder.ranks[p] for p in parts]


def library(path):
    """Tokens of a text by the library itself."""
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    own = Tokenizer.from_file(path)
    return lambda text: len(own.encode(text, add_special_tokens=False).ids)


PATHS = [JSON, P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")]


@pytest.mark.parametrize("path", PATHS)
def test_token_counts(spark, path):
    encode = library(path)
    for df in (odd(spark), empty(spark), sample(spark)):
        found = counts.count_tokens(df, path, batch_bytes=3000).collect()
        expected = Counter((i, len(t.encode()), encode(t)) for i, t in texts(df))
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in found) == expected
        assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in found)


def test_token_counts_without_pre_tokenizer(tmp_path):
    """A file that names no pre-tokenizer is encoded whole; special strings are tokens between parts that are cut as usual."""
    spec = json.loads(Tokenizer.from_file(JSON).to_str())
    kinds = [spec | {"pre_tokenizer": None}, spec | {"added_tokens": []}, spec | {"added_tokens": [{"id": 50_000 + k, "content": c, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for k, c in enumerate(("<a>", "<a><b>", "|end|"))]}]
    given = ["", "<a>", "x<a><b>y  <a> <b>", "|end||end| a  b", "word " * 500 + "<a>" + " word" * 500, "<|endoftext|>tail", "no specials  here"]
    for n, kind in enumerate(kinds):
        (tmp_path / f"{n}.json").write_text(json.dumps(kind))
        own = Tokenizer.from_file(str(tmp_path / f"{n}.json"))
        assert counts.Lengths(str(tmp_path / f"{n}.json"))(given).tolist() == [len(own.encode(t, add_special_tokens=False).ids) for t in given]


@pytest.mark.parametrize("path", PATHS)
def test_token_counts_of_cut_texts(path):
    rng = random.Random(6)
    lengths, encode = counts.Lengths(path, 200), library(path)
    assert lengths.cuts
    alphabet = ["a", "B", " ", "  ", "é", "я", "'s", "it's", "1", "\n", "<|endoftext|>", "漢", "\u0301", "the", " and", ".", "-", "\xa0", "\u2581", "ͺ"]
    samples = ["".join(rng.choices(alphabet, k=rng.randrange(300))) for _ in range(300)] + ["я у " * 400, "x" * 900, "a b " * 500]
    assert lengths(samples).tolist() == [encode(x) for x in samples] == lengths(samples).tolist()


def test_token_batches_are_balanced():
    rng = random.Random(1)
    parts = ["é" * rng.randrange(1, 90) for _ in range(500)]
    batches = counts.balanced(parts, 4000)
    sizes = [sum(len(parts[i].encode()) for i in b) for b in batches]
    assert sorted(i for b in batches for i in b) == list(range(500)) and max(sizes) - min(sizes) <= 180 and max(sizes) < 4000 + 180
    assert counts.balanced([], 10) == [] and counts.in_batches(parts, 4000, lambda b: [p + "!" for p in b]) == [p + "!" for p in parts]


def test_unknown_tokenizers_are_not_cut():
    assert not counts.splits_at_spaces(None) and not counts.splits_at_spaces({"type": "Split", "pattern": {"Regex": r"[\p{L} ]+"}}) and not counts.splits_at_spaces({"type": "Metaspace"})
    assert not counts.splits_at_spaces({"type": "ByteLevel", "use_regex": False}) and not counts.plain_normalizer({"type": "Strip"})


@pytest.mark.parametrize("make", [odd, empty, sample])
@pytest.mark.parametrize("pool", [3000, 1 << 20])
def test_packing_is_gapless(spark, tokenizer, make, pool):
    df = make(spark).withColumn("doc_id", F.monotonically_increasing_id())
    found = packing.pack(df, JSON, P.PATTERN, keep_ids=True, pool_tokens=pool).collect()
    pieces, sequences = {}, {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"] > 0
    for i, t in texts(df):
        whole = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        own = sorted(pieces[i])
        assert [s for s, _ in own] == np.cumsum([0, *(len(x) for _, x in own)]).tolist()[:-1] and [x for _, p in own for x in p] == whole
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 1024


def test_packing_takes_null_and_repeated_ids(spark, tokenizer):
    found = packing.pack(odd(spark), JSON, P.PATTERN, keep_ids=True).collect()
    expected, lengths = Counter(), Counter()
    for i, t in texts(odd(spark)):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        expected.update((i, x) for x in ids)
        lengths[i, len(ids)] += len(ids)
    assert Counter((r["doc_id"], x) for r in found for x in r["ids"]) == expected
    got = Counter()
    for r in found:
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert got == lengths


def test_packing_is_the_lowest_cost_assignment():
    """Each piece goes, by descending length, to the sequence of least cost that has room; recomputed without arrays."""
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = rng.integers(1, 200, 60)
        lengths = np.append(lengths, -lengths.sum() % 256)
        room = [256] * int(lengths.sum() // 256)
        cost, found = [0.0] * len(room), {}
        for i, start, n, k in zip(*(x.tolist() for x in packing.assign(lengths, np.array(room), 1.0, 1 / 64)), strict=True):
            found.setdefault(i, []).append((start, n, k))
        for i in sorted(range(61), key=lambda i: -lengths[i]):
            n = int(lengths[i])
            fits = [k for k in range(len(room)) if room[k] >= n]
            if n and fits:
                k = min(fits, key=lambda k: (cost[k], k))
                assert found[i] == [(0, n, k)]
                room[k] -= n
                cost[k] += n + n * n / 64
            elif n:
                assert sum(m for _, m, _ in found[i]) == n and len(found[i]) > 1  # cut over the room that is left


def test_packing_balances_costs():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 700, 400)
    lengths[-1] += -lengths.sum() % 1024 or 0
    rooms = np.full(lengths.sum() // 1024, 1024)
    item, start, length, sequence = packing.assign(lengths, rooms, 1.0, 1 / 1024)
    assert np.bincount(sequence, length).tolist() == rooms.tolist() and np.bincount(item, length).tolist() == lengths.tolist()
    cuts = np.unique(np.concatenate([[0], np.cumsum(lengths), np.cumsum(rooms)]))
    in_order = np.bincount(cuts[:-1] // 1024, np.diff(cuts) ** 2 / 1024)
    balanced = np.bincount(sequence, length**2 / 1024)
    inner = lambda x: np.percentile(x, 90) - np.percentile(x, 10)
    assert inner(balanced) < inner(in_order)


def test_language_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = fold(4) == 2
    model = language.learn_model(df, ~held_out)
    found = language.identify(df, model, extra=(held_out.alias("h"), F.col("lang"))).where("h").collect()
    right = [r["lang"] == r["lang_pred"] for r in found]
    assert sum(right) / len(right) > 0.98 and all(0 <= r["score"] <= 1 for r in found)


def test_language_odd_rows(spark):
    model = language.learn_model(sample(spark), F.lit(True))
    found = {r["doc_id"]: r for r in language.identify(odd(spark), model).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3, 10)] == ["und"] * 4 and found[8]["lang_pred"] != "und" and found[1]["score"] == 0
    assert language.identify(odd(spark), None).where("lang_pred <> 'und'").count() == 0
    assert language.learn_model(empty(spark), F.lit(True)) is None and language.identify(empty(spark), model).count() == 0
    one = language.learn_model(documents(spark, [(1, WORDS), (2, WORDS)]), F.lit(True))
    assert {r["lang_pred"] for r in language.identify(documents(spark, [(3, "any words")]), one).collect()} == {"en"}


def test_language_sample_is_bounded(spark):
    rows = [(None if k % 2 else 7, f"{WORDS} {k}") for k in range(4000)] + [(k, WORDS) for k in range(2000)]
    found = language.sample(documents(spark, rows), F.lit(True), 100, "doc_id", "text", "lang").collect()
    assert 50 <= len(found) <= 200 and len({r["text"] for r in found}) == len(found)
    again = language.sample(documents(spark, rows[::-1]), F.lit(True), 100, "doc_id", "text", "lang").collect()
    assert {r["text"] for r in found} == {r["text"] for r in again}


def test_language_is_brute_force(spark):
    """Every prediction recomputed from dense vectors, family first, then votes of the pairs."""
    df = sample(spark)
    model = language.learn_model(df, F.lit(True))
    rows = {r["doc_id"]: r["text"] for r in df.where("text is not null").collect()}
    for r in language.identify(df, model).collect():
        text = rows.get(r["doc_id"])
        if not text or not any(c.isalpha() for c in text):
            assert r["lang_pred"] == "und"
            continue
        data = text.lower().encode()
        vector = np.zeros(1 << language.BITS)
        for k in range(len(data) - 2):
            n = data[k] | data[k + 1] << 8 | data[k + 2] << 16
            vector[(n * 0x9E3779B1 % (1 << 32)) >> (32 - language.BITS)] += 1
        margins = vector / max(1, len(data) - 2) @ model.weights + model.biases
        group = model.families[int(margins[: len(model.families)].argmax())] if len(model.families) > 1 else model.families[0]
        own = {x: 0 for x in model.members[group]}
        for k, (a, b) in enumerate(model.pairs, len(model.families)):
            if a in own:
                own[a if margins[k] >= 0 else b] += 1
        assert own[r["lang_pred"]] == max(own.values()) and 0 <= r["score"] <= 1


def test_toxicity_finds_planted(spark):
    rng = random.Random(3)
    plain = "the and of to in a is was for on with as by at from house river stone walk green".split()
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = rng.choices(plain, k=60)
        if bad:
            words[rng.randrange(60)] = rng.choice(["grufflen", "snarbol", "snarbolen"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = documents(spark, rows)
    index = toxicity.learn_index(docs, spark.createDataFrame(labels, "doc_id BIGINT, toxic INT"), fold(5) != 0, evidence=8.0)
    found = toxicity.score_toxicity(docs, index, extra=((fold(5) == 0).alias("held_out"),)).where("held_out").collect()
    assert found and all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in found)
    assert all(len(r["evidence"]) > 0 for r in found if r["predicted"])
    scored = toxicity.score_toxicity(odd(spark), index).collect()
    assert len(scored) == 12 and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score_toxicity(empty(spark), index).count() == 0
    assert toxicity.learn_index(empty(spark), spark.createDataFrame([], "doc_id BIGINT, toxic INT"), F.lit(True)) is None
    assert {r["score"] for r in toxicity.score_toxicity(odd(spark), None).collect()} == {0.0}


def test_toxicity_is_brute_force(spark):
    """Scores, evidence and document frequencies of whole texts, from counts of terms and dense cosines."""
    docs = sample(spark)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    index = toxicity.learn_index(docs, labels, fold(5) != 0)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()))

    def terms(text):
        words = [w.encode() for w in re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", text.lower())]
        return Counter([*words, *(w[:n] for n in toxicity.PREFIXES for w in words if len(w) > n)])

    own = {i: terms(t) for i, t in rows}
    keys = sorted({t for c in own.values() for t in c})
    number = {t: int(index.vocabulary.numbers(toxicity.span_hashes(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0])[0]) for t in keys}
    learned = [i for i in index.names]
    used = sorted({t for i in learned for t in own[i]})
    assert len(index.vocabulary) == len(used) and all(number[t] >= 0 for t in used)

    def vector(counts):
        v = np.zeros(len(index.vocabulary))
        for t, n in counts.items():
            if number[t] >= 0:
                v[number[t]] = (1 + np.log(n)) * index.term_weight[number[t]]
        return v / (np.linalg.norm(v) or 1)

    examples = np.stack([vector(own[i]) for i in learned])
    scored = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, index).collect()}
    for i, _ in rows:
        cosines = examples @ vector(own[i])
        top = np.lexsort((np.arange(len(learned)), -cosines.round(6)))[: index.k]
        top = top[cosines[top] > 1e-7]
        c = np.minimum(1.0, cosines[top])
        w = index.class_weight[top] * c / (1.0001 - c)
        prior = toxicity.PRIOR * index.class_weight.mean()
        common = (index.labels * index.class_weight).sum() / index.class_weight.sum()
        p = np.clip((w[index.labels[top] == 1].sum() + prior * common) / (w.sum() + prior), 1e-3, 1 - 1e-3)
        expected = 1 / (1 + np.exp(-(index.slope * np.log(p / (1 - p)) + index.shift))) if len(top) else index.base
        assert scored[i]["score"] == pytest.approx(expected, abs=2e-3)
        assert scored[i]["cosines"] == pytest.approx(cosines[top][:5].tolist(), abs=1e-4)


def test_toxicity_learns_from_a_few_rows(spark):
    docs = documents(spark, [(1, "good kind words here"), (2, "snarbol words here"), (3, "snarbol again"), (4, "kind words"), (4, "another text of the same id")])
    labels = spark.createDataFrame([(1, 0), (2, 1), (4, 0), (4, None), (None, 1), (9, 1)], "doc_id BIGINT, toxic INT")
    found = [toxicity.score_toxicity(d, toxicity.learn_index(d, labels, F.lit(True))).collect() for d in (docs, docs.orderBy(F.desc("text")))]
    scores = [sorted((r["doc_id"], r["score"]) for r in rows) for rows in found]
    assert scores[0] == scores[1] and len(scores[0]) == 5
    by = {r["doc_id"]: r for r in found[0]}
    assert by[3]["score"] > by[1]["score"] and by[3]["evidence"][0] == 2


def test_toxicity_compares_all_terms(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(300)]
    rows = [(i, " ".join([*rng.choices(plain, k=40), *["snarbol"] * (i % 4 == 0)])) for i in range(400)]
    docs = documents(spark, rows)
    index = toxicity.learn_index(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id BIGINT, toxic INT"), fold(5) != 0)
    assert len(index.vocabulary) == len({w[:n] for i, t in rows if zlib.crc32(str(i).encode()) % 5 for w in t.split() for n in (4, 5, 6, 7)})
    found = toxicity.score_toxicity(docs, index, extra=((fold(5) == 0).alias("held_out"),)).where("held_out").collect()
    assert found and all(r["evidence"] and r["predicted"] == (r["doc_id"] % 4 == 0) for r in found)


def test_toxicity_index_is_exact():
    rng = np.random.default_rng(1)
    n, v = 300, 60
    examples = [(i, np.sort(rng.choice(v, rng.integers(1, 8), replace=False)), rng.integers(1, 4, 8)) for i in range(n)]
    examples = [(i, t, c[: len(t)]) for i, t, c in examples]
    index = toxicity.build(examples, rng.integers(0, 2, n), np.arange(n), np.ones(n), np.arange(v).astype(np.uint64), rng.random(v) + 0.1, 16, 7)
    dense = np.zeros((n, v), np.float32)
    for i, t, c in examples:
        dense[i, t] = index.vector(t, c)
    for (_, t, c), (which, cosines) in zip(examples[:100], index.nearest([(t, c) for _, t, c in examples[:100]]), strict=True):
        exact = dense[:, t] @ index.vector(t, c)
        order = np.lexsort((np.arange(n), -exact))[:7]
        assert np.allclose(cosines, exact[order][: len(cosines)], atol=1e-5) and set(which) <= set(np.flatnonzero(exact >= exact[order[-1]] - 1e-5))


def test_url_contract(spark):
    rows = [
        (1, "http://A.Example.ORG/es/x?q#f"), (2, "https://example.org/en/12"), (3, "x.com/fr/"), (4, None), (5, "http://m.quiet.example.net/en/1"), (6, "http://shop.com/de/a"),
        (7, "http://shop.com/fr/a"), (8, "http://shopshop.example.net"), (9, "ftp://y.net?z"), (10, "http://notorg/x"), (10, "http://notorg/x"), (None, "http://example.organic/es/"), (11, "http://citylibrary.net/" + "books" * 70), (12, ""),
    ]
    df = spark.createDataFrame(rows, "page_id INT, url STRING")
    for c in ("host", "path", "rule", "verdict", "score", "words", "name", "n", "row", "id"):
        df = df.withColumn(c, F.lit(0))
    found = urls.filter_urls(df).collect()
    assert len(found) == 14 and len([r for r in found if r["page_id"] == 10]) == 2
    found = {r["page_id"]: r for r in found}
    get = lambda i: (found[i]["host"], found[i]["path"], found[i]["rule"])
    assert get(1) == ("a.example.org", "/es/x", "example.org/es/") and get(2) == ("example.org", "/en/12", "example.org/en/1")
    assert get(3) == get(4) == get(12) == ("", "", None) and get(5)[2] is None
    assert found[6]["rule"] == "com/de/" and found[7]["rule"] == "com/fr/" and get(9) == ("y.net", "", None) and get(10)[2] is None and get(None)[2] is None
    assert [found[i]["verdict"] for i in (1, 2, 6, 7)] == ["block", "block", "block", "allow"]
    assert found[8]["words"][:2] == ["shop", "shop"] and "".join(found[11]["words"]) == "citylibrarynet" + "books" * 70
    assert urls.filter_urls(df.limit(0)).count() == 0 and {r["score"] for r in found.values() if not r["words"]} == {found[4]["score"]}


def brute_urls(rows, labelled=None, longest=24):
    """Every score from the definition, with one dictionary for all."""
    parts, beyond = {}, []
    for i, u in rows:
        host, path = (re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S).groups()) if u and "://" in u else ("", "")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        best = max((r for r in urls.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), key=lambda r: len(r[1] + r[2]), default=None)
        parts[i] = re.findall("[a-z]+", f"{host}/{path}".lower()), best[0] if best else None
        if best:
            beyond.append((re.findall("[a-z]+", f"{host[: len(host) - len(best[1])]}/{path[len(best[2]) :]}".lower()), int(best[0] == "block")))
    known = beyond if labelled is None else [(re.findall("[a-z]+", u.split("://", 1)[1].lower()), y) for u, y in labelled]
    counts = Counter(x for n, _ in parts.values() for x in n)
    if labelled is not None:
        counts += Counter(x for n, _ in known for x in n)
    short = {w: n for w, n in counts.items() if 2 <= len(w) <= longest}
    words = {w: n for w, n in short.items() if not urls.compound(w, short)}
    total = sum(words.values()) or 1
    logs = {w: np.log(n / total) for w, n in words.items()}
    split = {x: urls.segment(x, logs, np.log(1 / (total + 1))) for x in counts}
    bad, good = (Counter(w for n, y in known if y == want for x in n for w in split[x]) for want in (1, 0))
    v, n_bad = len({*bad, *good}), sum(y for _, y in known)
    odds = {w: np.log((bad[w] + 1) / (sum(bad.values()) + v)) - np.log((good[w] + 1) / (sum(good.values()) + v)) for w in {*bad, *good}}
    base = np.log((n_bad + 1) / (len(known) - n_bad + 1)) if 0 < n_bad < len(known) else np.log(0.4 / 0.6)
    if not 0 < n_bad < len(known):
        odds = {}
    out = {}
    for i, (names, rule) in parts.items():
        score = 1 / (1 + np.exp(-np.clip(base + sum(odds.get(w, 0.0) for x in names for w in split[x]), -50, 50)))
        out[i] = rule or ("block" if score >= 0.5 else "allow"), score, [w for x in names for w in split[x]]
    return out


@pytest.mark.parametrize("most", [200_000, 0])
def test_url_verdicts_are_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(shared.small, "__defaults__", (most,))
    rows = [(r["page_id"], r["url"]) for r in sample(spark, "pages").collect()]
    rows += [(10**6, "http://casinowinpoker.net/po1rn/ca5sino"), (10**6 + 1, "http://" + "casinowin" * 40 + ".net/de/"), (10**6 + 2, None), (10**6 + 3, "no scheme")]
    expected = brute_urls(rows)
    found = urls.filter_urls(spark.createDataFrame(rows, "page_id BIGINT, url STRING")).collect()
    assert len(found) == len(rows)
    for r in found:
        verdict, score, words = expected[r["page_id"]]
        assert r["words"] == words and r["score"] == pytest.approx(score) and (r["verdict"] == verdict or abs(score - 0.5) < 1e-9)


def test_url_labels_teach_words(spark):
    df = spark.createDataFrame([(1, "http://m.grufflen.net/a"), (2, "http://quietstone.net/a"), (3, "http://quietgrufflen.net/gruff1len")], "page_id INT, url STRING")
    labels = [(f"http://{w}.net/x{i}", y) for i in range(20) for w, y in (("grufflen", 1), ("quietstone", 0), ("quiet", 0), ("stone", 0))]
    labelled = spark.createDataFrame([*labels, (None, 1), ("http://x.net", None)], "url STRING, blocked INT")
    found = {r["page_id"]: r for r in urls.filter_urls(df, labelled=labelled).collect()}
    expected = brute_urls([(r["page_id"], r["url"]) for r in df.collect()], labels)
    assert {i: r["verdict"] for i, r in found.items()} == {i: v for i, (v, _, _) in expected.items()} and found[1]["verdict"] == "block" and found[2]["verdict"] == "allow"
    assert found[3]["words"] == ["quiet", "grufflen", "net", "gruff", "len"] or "grufflen" not in found[3]["words"][3:]
    assert {r["verdict"] for r in urls.filter_urls(df).collect()} == {"allow"}


def test_url_held_out_rules(spark):
    """Rule verdicts of a fifth of the URLs, learned from the others."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    host, path = urls.url_parts(F.col("url"))
    _, verdict = urls.rule_of(host, path)
    known = pages.withColumn("verdict", verdict).where("verdict is not null").withColumn("blocked", (F.col("verdict") == "block").cast("int"))
    held = F.crc32(F.col("page_id").cast("string").cast("binary")) % 5 == 0
    found = urls.filter_urls(known.where(held), rules=(), labelled=known.where(~held)).join(known.select("page_id", F.col("verdict").alias("v")), "page_id")
    right = found.agg(F.avg((F.col("verdict") == F.col("v")).cast("int"))).first()[0]
    share = known.where(held).agg(F.avg("blocked")).first()[0]
    assert right > max(share, 1 - share)


def test_url_dictionary_is_whole(spark):
    name = lambda i: "q" + "".join(chr(97 + i // 26**k % 26) for k in range(4))
    path = "/".join(name(i) for i in range(50_100))
    df = spark.createDataFrame([(1, f"http://a.net/{path}"), (2, f"http://b.net/{path}"), (3, "http://winery.net/")], "page_id INT, url STRING")
    host, path = urls.url_parts(F.col("url"))
    names = shared.Stored(spark)(urls.name_counts(df.select(urls.names_of(host, path).alias("names"))))
    words = {r["name"]: r["words"] for r in urls.segmented(names, shared.Stored(spark), 24).collect()}
    assert words["winery"] == ["winery"] and len(words) > 50_100 and all(words[name(i)] == [name(i)] for i in range(0, 50_100, 977))


def test_url_rules_are_no_evidence(spark):
    """What all URLs of a rule have in common says nothing about others."""
    rows = [(i, f"http://h{i}.example.org/es/x{i}") for i in range(40)] + [(100 + i, f"http://h{i}.com/fr/x{i}") for i in range(60)] + [(200, "http://quiet.net/es/1"), (201, "http://de.net/de/"), (202, "http://example.net/")]
    found = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id INT, url STRING")).collect()}
    assert {found[i]["verdict"] for i in (200, 201, 202)} == {"allow"} and len({found[i]["score"] for i in (200, 201, 202)}) == 1
    rules = (("block", "example.org", "/e"), ("allow", "com", "/"))
    host, path = urls.url_parts(F.col("url"))
    left = spark.createDataFrame([("http://a.example.org/es/b",), ("http://example.org/e",), ("http://b.com/x",), ("http://z.net/e",)], "url STRING").select(*urls.beyond_rule(host, path, rules))
    assert [tuple(r) for r in left.collect()] == [("a.", "/b"), ("", ""), ("b.", "x"), ("z.net", "/e")]


def test_url_very_long_names(spark):
    long = "sunset" * 20_000
    df = spark.createDataFrame([(1, f"http://{long}.net/"), *((k, "http://sun.net/set") for k in range(2, 9))], "page_id INT, url STRING")
    began = time.time()
    words = urls.filter_urls(df).where("page_id = 1").first()["words"]
    assert words == ["sun", "set"] * 20_000 + ["net"] and time.time() - began < 60


def test_url_digits_separate_words(spark):
    df = spark.createDataFrame([(1, "http://b.net/spa5m/3a9d/"), (2, "http://spam.net/ad")], "page_id INT, url STRING")
    assert not {"spam", "ad"} & {*urls.filter_urls(df).where("page_id = 1").first()["words"]}


def test_segmentation_is_the_most_probable():
    words = {w: np.log(n / 99) for w, n in {"sun": 50, "set": 40, "sunset": 5, "sets": 3, "un": 1}.items()}
    unknown = np.log(1 / 100)

    def best(name):
        if not name:
            return 0.0, []
        return max((best(name[:k])[0] + words.get(name[k:], unknown - urls.LETTER * (len(name) - k)), best(name[:k])[1] + [name[k:]]) for k in range(len(name)))

    for name in ("sunset", "sunsets", "casinosunset", "xqsun", "z", "sunsetsunset"):
        score = lambda ws: sum(words.get(w, unknown - urls.LETTER * len(w)) for w in ws)
        found = urls.segment(name, words, unknown)
        assert "".join(found) == name and score(found) == pytest.approx(best(name)[0])
    assert urls.segment("sunset" * 100, words, unknown) == ["sun", "set"] * 100


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


@pytest.mark.parametrize("make", [odd, empty, sample])
def test_quality_base(spark, make):
    df = make(spark)
    found = quality(df).collect()
    expected = Counter((i, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]) for i, t in texts(df) for b in [brute_quality(t)])
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in found) == expected


def test_quality_removes_frequent_lines(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"{own(i)}\n  Common  LINE here \nrest{i}") for i in range(30)] + [(100 + i, "common line here\n" * 30 + own(i)) for i in range(2)] + [(200, own(200) + "\n" + own(201))]
    rows += [(300 + i, f"{own(300 + i)}\ncommon line here", "en", "other") for i in range(5)]
    found = {r["doc_id"]: r for r in quality(documents(spark, rows), limits=Limits(repeat_share=1.0), keep_text=True).collect()}
    assert found[0]["removed_words"] == 0 and found[0]["clean_text"] == rows[0][1]
    assert all(found[i]["removed_words"] == 3 and found[i]["clean_text"] == f"{own(i)}\nrest{i}" and found[i]["kept"] for i in range(1, 30))
    assert not found[100]["kept"] and found[100]["removed_words"] == 90 and found[200]["kept"] and found[300]["removed_words"] == 0


def test_quality_counts_documents_not_rows(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(1, f"{own(1)}\nthe very same line here")] * 25 + [(2, f"{own(2)}\nthe very same line here")] + [(None, f"{own(3)}\nthe very same line here")] * 30
    found = quality(documents(spark, rows), limits=Limits()).collect()
    assert len(found) == 56 and all(r["removed_words"] == 0 and r["kept"] for r in found)


def test_quality_bar_does_not_grow_with_the_host(spark):
    """Neither repeated rows nor many other documents of a host keep a frequent line."""
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"{own(i)}\nthe very same line here") for i in range(1, 26)]
    for more in ([rows[0]] * 300, [(1000 + i, own(1000 + i)) for i in range(400)]):
        found = quality(documents(spark, rows + more)).where("doc_id between 2 and 25").collect()
        assert [r["removed_words"] for r in found] == [5] * 24


@pytest.mark.parametrize("most", [200_000, 0])
def test_quality_is_brute_force(spark, monkeypatch, most):
    """Removed words of each row, with null hosts, repeated rows, lines of spaces and many hot lines, by broadcast and by shuffle."""
    monkeypatch.setattr("geolith.llm.shared.BROADCAST_ROWS", most)
    monkeypatch.setattr(shared.small, "__defaults__", (most,))
    rng = random.Random(11)
    lines = [f"line {k} of some words" for k in range(12)]
    rows = [(i // 2 if i % 9 == 0 else i, "\n".join([*rng.sample(lines, rng.randrange(6)), "  ", f"own text {i} " * 30]), "en", rng.choice([None, "", "a", "b"])) for i in range(240)]
    rows.append((None, f"{lines[0]}\n" + "x " * 80, "en", "a"))
    having = {}
    norm = lambda x: " ".join(x.lower().split())
    for i, t, _, host in rows:
        for x in t.split("\n"):
            if norm(x) and i is not None:
                having.setdefault((host or "", norm(x)), set()).add(i)
    hot = {k: min(v) for k, v in having.items() if len(v) > 5}
    expected = Counter((i, sum(len(x.split()) for x in t.split("\n") if (h or "", norm(x)) in hot and hot[h or "", norm(x)] != i), "\n".join(x for x in t.split("\n") if (h or "", norm(x)) not in hot or hot[h or "", norm(x)] == i)) for i, t, _, h in rows)
    found = quality(documents(spark, rows), limits=Limits(line_docs=5), keep_text=True).collect()
    assert hot and Counter((r["doc_id"], r["removed_words"], r["clean_text"]) for r in found) == expected
