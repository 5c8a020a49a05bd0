"""Quality, decontamination, chat, tokenizers, shards, ids, licenses, toxicity."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dirloom.llm import bytebpe, chatfmt, coder, decontam, idstore, licenses, quality, segments, sharding, spm, toxicity
from dirloom.llm.queries import tokenizer

RNG = np.random.default_rng(7)
COMMON = "the of and to in is that it was for".split()


def prose(n, rng=RNG):
    made = ["".join(rng.choice(list("abcdefghilmnorst"), int(rng.integers(2, 9)))) for _ in range(n)]
    return " ".join(str(rng.choice(COMMON)) if rng.random() < 0.3 else w for w in made) + "."


ODD = ["", None, " \n\t ", "é", "one two\n", "x" * 5000, "a b a b a b", "línea\nlínea\n\nlínea", "#*$%&|<>" * 3]


def test_quality_counts(spark):
    texts = ODD + [prose(120) for _ in range(3)] + ["same words here " * 40]
    docs = spark.createDataFrame([(k, t, "en", 1.5) for k, t in enumerate(texts)], "doc_id long, text string, lang string, kept double")
    got = {r["doc_id"]: r for r in quality.quality_signals(docs).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {j + d for j in range(len(w) - 2) if n[tuple(w[j : j + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert tuple(got[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, t
        assert got[k]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_quality_keeps_prose_and_drops_junk(spark):
    clean = [prose(200) for _ in range(30)]
    junk = [t.upper() + "!!" for t in (prose(200) for _ in range(3))] + [re.sub(" ", " | ", prose(200)) for _ in range(3)]
    docs = spark.createDataFrame([(k, t, None if k == 0 else "en") for k, t in enumerate(clean + junk)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in quality.filter_quality(docs).collect()) == list(range(30))


def test_decontamination_finds_edited_copies_only(spark):
    items = [prose(40) for _ in range(5)] + ["tiny item", None, ""]
    words = items[1].split()
    edited = " ".join("zzz" if k % 8 == 3 else w for k, w in enumerate(words))
    docs = [(0, prose(300)), (1, prose(100) + " " + items[0].upper() + " " + prose(50)), (2, prose(30) + " " + edited), (3, None), (4, " ".join(items[2].split()[:5]) + prose(99)), (None, items[3])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminated_pairs(d, b).collect()}
    assert set(got) == {(1, 0), (2, 1), (None, 3)} and got[1, 0] == 1.0
    assert sorted(r["doc_id"] for r in decontam.drop_contaminated(d, b).collect()) == [0, 3, 4]
    assert decontam.contaminated_pairs(d, b.limit(0)).count() == 0


def test_decontamination_equals_alignment_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    items = [prose(n, rng) for n in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 16, 17, 24, 40, 59, 60)]
    docs = [prose(150, rng)]
    for item in items:
        w = item.rstrip(".").split()
        docs.append(" ".join("zzz" if k % 4 == 3 else x for k, x in enumerate(w)))  # no four words in a row are left
        docs.append(" ".join(x + " zzz" if k % 2 else x for k, x in enumerate(w)))
        docs.append(" ".join(x for k, x in enumerate(w) if k % 4))
        docs.append(" ".join(w[: len(w) // 4] + w[-len(w) // 4 :]))
        for rate in (0.1, 0.2, 0.3, 0.4):
            docs.append(" ".join(x if rng.random() > rate else str(rng.choice(["zzz", "", f"{x} of the"])) for x in w))
    docs = [f"{prose(20, rng)} {t} {prose(20, rng)}" for t in docs] + items[:4]
    hashed = [decontam._word_hashes(pa.array([t]))[0] for t in items + docs]
    want = {}
    for k, h in enumerate(hashed[len(items) :]):
        scores = decontam.align(hashed[: len(items)], [h] * len(items)) / [len(x) for x in hashed[: len(items)]]
        size = [len(x) for x in hashed[: len(items)]]
        want |= {(k, i): s for i, (s, m) in enumerate(zip(scores, size, strict=True)) if s >= 0.5 and (s * m > 7.5 or s == 1) and (m >= 4 or m == len(h))}
    assert (docs[1 + 8 * 9].count("zzz"), want[1 + 8 * 9, 9]) == (4, 9 / 16) and {(len(docs) - 4 + i, i) for i in range(4)} <= set(want)
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminated_pairs(d, b).collect()} == want
    made = next(decontam.item_blocks(d, b))
    monkeypatch.setattr(decontam, "_HITS", 10, raising=False)  # in parts
    row, item, score = decontam._matches(made, *decontam._word_hashes(pa.array(docs)))
    assert dict(zip(zip(row.tolist(), (made.ids[i] for i in item), strict=True), score.tolist(), strict=True)) == want


def test_everyday_words_contaminate_nothing(spark):
    """Items of a few common words, and longer ones of which a text has a few."""
    items = ["yes", "of the people", "what is the capital of France", "It is one of the most important questions of our time today", "how do you say that in another language"]
    docs = ["one of the many roads", "what is the weather today", "yes, that is so", "a government of the people", "this is one of the most beautiful towns", "how do you say it", "What is the capital of France? Paris.", "Yes!", ""]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated_pairs(d, b).collect()} == {(6, 2), (7, 0)}
    assert sorted(r["doc_id"] for r in decontam.drop_contaminated(d, b).collect()) == [0, 1, 2, 3, 4, 5, 8]


def test_added_tokens_come_from_the_vocabulary():
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    e = bytebpe.ByteEncoder(path)
    assert set(e.special) == {t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()} and e.special
    texts = ["a" + s + "b" for s in e.special]
    ids, at = e.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_alignment_scores():
    h = lambda s: np.array([ord(c) + 10 for c in s], np.uint64)
    assert decontam.align([h("abcdef"), h("abcdef"), h("abcdef")], [h("xxabcdefy"), h("abcXdef"), h("zzz")]).tolist() == [6, 5, 0]


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "a\\b\\!\\n", "<|turn|>x<|/turn|>\n", None, "", "é<<SYS>>\\", "x" * 300]
    rows = [(k % 3, k, ["user", "assistant", None, "a\nb"][k % 4], t) for k, t in enumerate(said * 4)]
    out = chatfmt.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    parts = collections.defaultdict(list)
    for r in out.collect():
        parts[r["conv_id"]].append((r["part"], r["formatted"]))
    for c, p in parts.items():
        turns = [x for _, t in sorted(p) for x in chatfmt.parse(t)]
        assert turns == [(r or "", t or "") for k, _, r, t in rows if k == c]
    report = {r["conv_id"]: r for r in chatfmt.conversation_report(out).collect()}
    mine = [t or "" for k, _, r, t in rows if k == 1 and r == "assistant"]
    assert report[1]["loss_sha256"] == hashlib.sha256("".join(mine).encode()).hexdigest() and report[1]["loss_chars"] == len("".join(mine))
    for s in ("</s>", "[INST]", "<|turn|>", "<<SYS>>"):
        assert s not in chatfmt.escape(pa.array([s + "x" + s]))[0].as_py()


HARD = [*[t for t in ODD if t], "  a  b ", "\n\n a\n", "▁▁ ▁a", "日本 ok 🙂", "ﬁ①", "don't it''s", "<|endoftext|> x", "a\r\n b\t\tc", "x1234 5y"]


def test_sentencepiece_equals_library(spark):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [None, "", *HARD, *(prose(60) for _ in range(5))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in spm.encoding_report(docs, path).collect()}
    for k, t in enumerate(texts):
        ids = lib.encode(t or "")
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()), t


def test_sentencepiece_compares_every_text():
    """Each text that the encoder gets wrong is noticed, and has the library's ids."""
    path = tokenizer("piece_bpe_32k.model")
    texts = pa.array(["plain", "the table", 'one ("más") two'])
    want = spm.Encoder(path).processor.encode(texts.to_pylist())

    def encoded(e, texts):
        ids, rows = e.encode(texts)
        return [ids[a:b].tolist() for a, b in zip(rows[:-1], rows[1:], strict=True)]

    right = spm.Encoder(path)
    assert encoded(right, texts) == want and right.differences == 0
    joined = spm.Encoder(path)
    joined.vocabulary.cuts[ord("b") << 8 | ord("l")] = True  # a merge is lost between two right segments
    assert encoded(joined, texts) == want and joined.differences == 1
    inner = spm.Encoder(path)
    plain = inner.vocabulary.encode
    inner.vocabulary.encode = lambda x: [5] if x[0] != spm.MARK and not x.isascii() else plain(x)
    inner.vocabulary.cuts[ord('"') << 8 | ord("m")] = True
    assert encoded(inner, texts) == want and inner.differences == 1
    known = spm.Encoder(path)
    known.encode(texts)
    known.table.flat[:] = 7  # segments met before
    assert encoded(known, texts.slice(0, 2)) == want[:2] and known.differences == 2


def test_byte_bpe_and_store(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = [None, "", *HARD, *(prose(80) for _ in range(4))]
    ids, at = bytebpe.ByteEncoder(path).encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == lib.encode(t or "", add_special_tokens=False).ids, t
    docs = spark.createDataFrame([(len(texts) - k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    idstore.write_ids(docs, path, str(tmp_path / "ids"))
    crc = {r["doc_id"]: r["ids_crc32"] for r in idstore.read_ids(spark, str(tmp_path / "ids"), digest=True).collect()}
    start = 0
    for r in idstore.read_ids(spark, str(tmp_path / "ids")).orderBy("doc_id").collect():
        assert crc[r["doc_id"]] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        want = [*lib.encode(texts[len(texts) - r["doc_id"]] or "", add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids"]) == (start, len(want), want)
        start += len(want)


def test_byte_bpe_pieces_go_to_the_model_once():
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    lib, e, met = Tokenizer.from_file(path), bytebpe.ByteEncoder(path), []

    class Model:
        def tokenize(self, piece):
            met.append(piece)
            return lib.model.tokenize(piece)

    e.model, e._library = Model(), lambda texts: [1 / 0 for _ in texts]
    every = "".join(chr(c) for c in range(0x23F) if c not in (0x27, 0x85, 0xA0))
    texts = ["", None, every, "one two  two\n\n three 1234 !? éà\t ", " ".join(f"words{k % 9} of, {k}" for k in range(99))]
    for _ in range(2):
        ids, at = e.encode(pa.array(texts))
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == lib.encode(t or "", add_special_tokens=False).ids, t
    assert met and len(met) == len(set(met))


def test_segment_hashes_tell_segments_apart():
    sizes = [*range(1, 140), 20_000, *(1, 2, 8, 9, 16, 17, 63, 64, 65) * 300]
    buf = np.random.default_rng(3).integers(97, 99, sum(sizes)).astype(np.uint8)
    buf[:300] = 0  # lengths alone
    ends = np.cumsum(sizes)
    raw, met = buf.tobytes(), {}
    for h, a, z in zip(segments._hashes(buf, ends - sizes, ends).tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
        assert met.setdefault(raw[a:z], h) == h
    assert len(set(met.values())) == len(met) > 1000


@pytest.mark.parametrize("change", ["prefix", "words", "lower", "cut"])
def test_byte_bpe_of_another_kind(tmp_path, change):
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    lib = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    if change == "prefix":
        lib.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    elif change == "words":
        lib.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    elif change == "lower":
        lib.normalizer = normalizers.Sequence([normalizers.Lowercase(), normalizers.Replace("e t", "et")])
    else:
        lib.enable_truncation(5)
    lib.save(path := str(tmp_path / "other.json"))
    texts = ["The the end", "", None, "Some text with more words than one", "Each met here"]
    ids, at = bytebpe.ByteEncoder(path).encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == lib.encode(t or "", add_special_tokens=False).ids, t


def test_coder_format_is_kept():
    """Frames written before must be readable."""
    k = np.arange(300_000)
    ids = (k * k // 7 % 1009 * (k % 64 < 50) + k % 13 * 5000).astype(np.int32)
    frame = coder.encode_frame(ids)
    assert hashlib.sha256(frame).hexdigest() == "e0ed0706d856b8c566875b898aca297fe73087dfb03b234d273b35bea2c3b804"
    assert (coder.decode_frame(frame) == ids).all()


def test_coder_learns_and_resets_blocks(monkeypatch):
    monkeypatch.setattr(coder, "BLOCK_IDS", 3000)
    phrase = RNG.integers(0, 50_000, 40)
    ids = np.concatenate([np.tile(phrase, 200), RNG.integers(0, 65_535, 1500), np.full(700, 65_534)]).astype(np.int32)
    frame = coder.encode_frame(ids)
    blocks = list(coder.frame_blocks(frame))
    assert (coder.decode_frame(frame) == ids).all() and len(blocks) == -(-len(ids) // 3000)
    assert (coder._decode_block(blocks[1]) == ids[3000:6000]).all()  # alone, without the one before
    assert len(blocks[1]) < 0.5 * 2 * 3000


def test_empty_store_and_repeated_rows(spark, tmp_path):
    path = tokenizer("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "a b", 7), (1, "a b", 8), (None, None, 9)], "doc_id long, text string, start int")
    idstore.write_ids(docs.limit(0), path, str(tmp_path / "none"))
    assert idstore.read_ids(spark, str(tmp_path / "none")).count() == 0
    idstore.write_ids(docs, path, str(tmp_path / "some"))
    assert sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in idstore.read_ids(spark, str(tmp_path / "some")).collect()) == [(0, None, 1), (1, 1, 3), (4, 1, 3)]


@pytest.mark.parametrize("n", [0, 1, 511, 513, 9000])
def test_coder_round_trip_and_damage(n):
    ids = np.minimum(RNG.geometric(0.002, n), 65534).astype(np.int32)
    frame = coder.encode_frame(ids)
    assert (coder.decode_frame(frame) == ids).all()
    if n > 10:
        bad = bytearray(frame)
        bad[-20] ^= 4
        with pytest.raises(ValueError, match="damaged"):
            coder.decode_frame(bytes(bad))
    with pytest.raises(ValueError, match="ids must"):
        coder.encode_frame(np.array([70000]))


def test_shards(spark):
    hot = "hot text " * 20
    rows = [(k, hot if k % 3 == 0 else (None if k == 1 else prose(int(RNG.integers(1, 60))))) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard_by_bytes(spark, docs, 24).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(2000))
    size, slots = collections.Counter(), collections.defaultdict(list)
    text = dict(rows)
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(size) == set(range(24))
    assert max(size.values()) - min(size.values()) < 0.02 * np.mean(list(size.values()))
    assert sharding.shard_by_bytes(spark, docs.limit(0), 24).count() == 0


def test_shards_keep_groups_whole(spark):
    """Groups of equal texts up to the size of a shard go to one; a larger one is divided, others stay level."""
    groups = [(f"group {g} " * 30, 1 + 7 * g) for g in range(12)] + [("huge " * 60, 700)]
    texts = [t for t, n in groups for _ in range(n)] + [prose(40) for _ in range(600)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, shard string").repartition(3)
    got = sharding.shard_by_bytes(spark, docs, 8).collect()
    where, size, slots = collections.defaultdict(set), collections.Counter(), collections.defaultdict(list)
    for r in got:
        where[texts[r["doc_id"]]].add(r["shard"])
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(len(where[t]) == 1 for t, _ in groups[:-1]) and len(where[groups[-1][0]]) > 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) < 0.02 * np.mean([size[k] for k in range(8)])


def test_levels_fill_all_shards():
    for large, total in (([(50, 1), (40, 2), (30, 3)], 200), ([], 7), ([(10, 1)], 10), ([(90, 1), (80, 2)], 173)):
        shard, bounds = sharding._levelled(large, total, 4)
        held = collections.Counter()
        for b, k in large:
            held[shard[k]] += b
        assert bounds[0] == 0 and bounds[-1] == total - sum(b for b, _ in large) and bounds == sorted(bounds)
        final = [held[s] + bounds[s + 1] - bounds[s] for s in range(4)]
        assert sum(final) == total and max(final) - min(final) <= 1 or max(final) in held.values()


def test_licenses(spark):
    mit = licenses.TEMPLATES[9][1]
    cut = mit.split()
    del cut[20:24]
    rows = [(0, prose(50) + "\nReleased under the MIT License."), (1, prose(80) + " " + " ".join(cut).upper() + prose(10)), (2, prose(90)), (3, None), (4, "license " * 50), (5, "Licensed under CC BY-NC 4.0.")]
    got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(0, "MIT"), (1, "MIT"), (5, "CC-BY-NC-4.0")} and got[0, "MIT"] == 1.0 and 0.8 <= got[1, "MIT"] < 1


def test_short_license_notices(spark):
    rows = [(0, prose(50) + "\nAll rights reserved."), (1, "ALL RIGHTS\n RESERVED"), (2, "// SPDX-License-Identifier: MIT\n" + prose(30)), (3, "overall rights reserved, all rights are reserved"), (4, "SPDX-License-Identifier: Apache-2.0"), (5, "reserved identifier " * 9), (6, None)]
    rows += [(7, "© 2020. All rights reserved. Released under the MIT License. All rights reserved. SPDX-License-Identifier: MIT"), (8, "SPDX-License-Identifier: ISC")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): (r["containment"], r["first_word"]) for r in licenses.scan_licenses(docs).collect()}
    assert set(got) == {(0, "All-Rights-Reserved"), (1, "All-Rights-Reserved"), (2, "MIT"), (4, "Apache-2.0"), (7, "All-Rights-Reserved"), (7, "MIT"), (8, "ISC")}
    assert all(c == 1 for c, _ in got.values())
    assert [got[k, "All-Rights-Reserved"][1] for k in (0, 1, 7)] == [len(re.findall("[a-z0-9]+", rows[0][1].lower())) - 3, 0, 1]
    only = licenses.scan_licenses(docs, (("X", "All rights reserved."),)).collect()
    assert sorted(r["doc_id"] for r in only) == [0, 1, 7]


def test_license_anchors_cover_every_chunk():
    chosen = set(licenses.anchors())
    for _, text in licenses.TEMPLATES:
        words = re.findall("[a-z0-9]+", text.lower())
        for a, k in licenses._chunks(words):
            assert 5 * sum(not chosen.isdisjoint(words[i : i + 5]) for i in range(a, a + k)) > k


def test_toxicity_learns_and_holds_out(spark):
    bad = ["grobnik", "flarnak", "zumpfel"]
    rows = []
    for k in range(900):
        w = prose(60).split()
        if k % 5 == 0:
            w[::9] = RNG.choice(bad, len(w[::9]))
        rows.append((k, " ".join(map(str, w)), int(k % 5 == 0)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(5000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_report(spark, docs, labels).collect()}
    held = [(got[k]["score"], y) for k, _, y in rows if got[k]["held_out"]]
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, _, _ in rows)
    assert np.mean([(s >= 0.7) == y for s, y in held]) > 0.97 and 0 <= got[5000]["score"] <= 1
    none = toxicity.toxicity_report(spark, docs, labels.limit(0)).agg(F.max("score")).first()[0]
    assert none == 0


def test_isotonic_is_monotone_and_keeps_the_mean():
    m, y = RNG.normal(size=300), (RNG.random(300) < 0.3).astype(float)
    at, v = toxicity.isotonic(m, y)
    assert (np.diff(v) >= 0).all() and abs(np.interp(m, at, v).mean() - y.mean()) < 1e-9


def test_quality_verdict_equals_plain_computation(spark):
    """Distances and verdict of each text against histograms added up plainly."""
    rng = np.random.default_rng(12)
    words = "the of and to in is that it was for on are as with be".split()

    def text(n, rate):
        return " ".join(str(rng.choice(words)) if rng.random() < rate else "".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n)) + "."

    texts = [text(150, 0.4) for _ in range(12)] + [text(150, 0.0), text(150, 0.95), text(60, 0.4).upper(), text(20, 0.4), "1 2 3 4 " * 40, text(160, 0.3).replace(" ", "  ")]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")

    def kinds(t):
        out = collections.Counter()
        for c in t:
            b = c.encode()[0]
            group = "lower" if c.islower() and b < 128 or b >= 0xC3 else "upper" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9" else "sentence" if c in ".,;:!?'\"()-" else "symbol" if c in "#*$%&|<>" else "space" if c in " \t\n\v\f\r" else "other"
            out[group] += 1
        return out

    def common(t):
        found = collections.Counter(w if w in quality.COMMON["en"] else None for w in t.lower().split())
        return found

    def js(p, q):
        total = lambda c: max(sum(c.values()), 1)
        d = 0.0
        for k in set(p) | set(q):
            a, b = p[k] / total(p), q[k] / total(q)
            d += sum(x * np.log2(2 * x / (a + b)) for x in (a, b) if x) / 2
        return np.sqrt(max(d, 0))

    pool = [t for t in texts if len(t.split()) >= 50 and 3 * kinds(t)["upper"] <= kinds(t)["lower"]]
    chars, said = collections.Counter(), collections.Counter()
    for t in pool:
        chars, said = chars + kinds(t), said + common(t)
    for r in quality.quality_signals(docs).collect():
        t = texts[r["doc_id"]]
        dc, dw = js(kinds(t), chars), js(common(t), said)
        assert abs(r["class_distance"] - dc) < 1e-9 and abs(r["word_distance"] - dw) < 1e-9, r["doc_id"]
        odd = (len(t) >= 100 and dc > 0.15 + 1.2 / np.sqrt(len(t))) or (len(t.split()) >= 100 and dw > 0.31)
        assert r["kept"] == (not r["base_failed"] and not odd)


def test_license_recall_of_edited_copies(spark):
    """Every copy of a template that still holds 80 % of its shingles is found."""
    rng = np.random.default_rng(13)
    rows, want = [], set()
    for name, template in licenses.TEMPLATES:
        w = re.findall("[a-z0-9]+", template.lower())
        if len(w) < 12:
            continue
        whole = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for _ in range(12):
            copy = list(w)
            for _ in range(int(rng.integers(1, 4))):
                at = int(rng.integers(0, len(copy) - 1))
                copy[at : at + int(rng.integers(0, 3))] = ["changed"] * int(rng.integers(0, 3))
            share = len(whole & {tuple(copy[i : i + 5]) for i in range(len(copy) - 4)}) / len(whole)
            rows.append((len(rows), f"{prose(40, rng)} {' '.join(copy)} {prose(40, rng)}"))
            if share >= 0.8:
                want.add((len(rows) - 1, name))
    got = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 20 and want <= got


CLASH = "doc_id long, text string, lang string, n long, row long, tid long, _tid long, seed long, part int, score double, alone long, token long"


def test_edges_of_every_operator(spark, tmp_path):
    """Clashing columns, null ids, repeated rows, null, empty and long texts, empty tables."""
    from dirloom.llm import ngram_join, suffix_dedup

    long = prose(4000)
    data = [(1, "some words here", "en"), (1, "some words here", "en"), (None, None, None), (None, "", "en"), (2, long, "xx"), (None, long, None)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7.0, 8, 9) for r in data], CLASH)
    items = spark.createDataFrame([(1, None), (2, ""), (3, "some words here"), (None, "some words here")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    path = tokenizer("piece_bpe_32k.model")
    made = {
        "op1": lambda d: decontam.contaminated_pairs(d, items),
        "drop": lambda d: decontam.drop_contaminated(d, items),
        "op3": lambda d: ngram_join.jaccard_components(spark, d),
        "keep": lambda d: ngram_join.keep_one(spark, d),
        "op4": lambda d: toxicity.toxicity_report(spark, d, labels),
        "op5": licenses.scan_licenses,
        "op6": lambda d: spm.encoding_report(d, path),
        "op7": lambda d: sharding.shard_by_bytes(spark, d),
        "op8": lambda d: suffix_dedup.repeat_report(spark, d),
        "op9": quality.quality_signals,
        "quality": quality.filter_quality,
    }
    count = {"op1": 4, "drop": 4, "op3": 6, "keep": 4, "op4": 6, "op5": 0, "op6": 6, "op7": 6, "op8": 6, "op9": 6}
    for name, f in made.items():
        rows = f(docs).collect()
        assert count.get(name, len(rows)) == len(rows), name
        assert f(docs.limit(0)).count() == 0, name
    assert all(r["held_out"] for r in made["op4"](docs).collect() if r["doc_id"] is None)
    turns = spark.createDataFrame([(None, None, None, None), (None, None, None, None), (1, 1, "assistant", "b"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    report = {r["conv_id"]: r for r in chatfmt.conversation_report(chatfmt.format_conversations(turns)).collect()}
    assert report[None]["n_turns"] == 2 and report[1]["loss_sha256"] == hashlib.sha256(b"ab").hexdigest()
    assert chatfmt.conversation_report(chatfmt.format_conversations(turns.limit(0))).count() == 0
