"""The operators on small frames: nulls, empty and long texts, ties, repeated
rows, empty tables, extra columns; and brute force on the sample tables."""
import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_SMALL
from starledger.llm import bpe, chat, common, fingerprint, langid, neardup, packing, pitmanyor, queries, substring, tokencount, topk
from starledger.llm.common import ship
from starledger.session import checkpoint_dir

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, key string, class_id string, h string"
LONG = "the very long text goes on. " * 4000
PASSAGE = ("seven words are in this first sentence. another sentence follows it with more words. "
           "then a third one closes the passage nicely. and a fourth for good measure. ")
NEAR = " ".join(f"word{i}" for i in range(120))


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [
        (1, "Hello world, this is a text of some words.", "en"), (2, None, "en"), (3, "", None), (4, "12 34 $$", "en"),
        (5, LONG, "en"), (6, "ce texte est une petite phrase de la langue.", "fr"), (7, "Hello world, this is a text of some words.", "en"),
        (7, "Hello world, this is a text of some words.", "en"), (None, "le document sans nom est une phrase.", "fr"),
        (8, "Opening of eight. " + PASSAGE + "the end of eight.", "en"), (9, "Another start. " + PASSAGE + "a different end with many more words of its own than the other text has so that few agree.", "en"),
        (10, NEAR, "en"), (11, NEAR.replace("word60 ", "changed "), "en"), (12, "   ", "en"),
    ]
    return spark.createDataFrame([(*r, "s", 1, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.limit(0)


def test_every_operator_takes_an_empty_table(spark, none):
    vec = spark.createDataFrame([], "vec_id bigint, embedding array<float>, key string")
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_back(chat.format_conversations(turns)).count() == 0
    assert langid.identify(none).count() == 0
    assert substring.remove_repeats(none).count() == 0
    assert packing.pack(none, queries.vocabulary("byte_bpe_50k.json")).count() == 0
    rows = topk.integer_rows(vec)
    assert topk.top_k(rows, rows).count() == 0
    assert neardup.near_duplicates(none).count() == 0
    assert pitmanyor.score(none).count() == 0
    assert fingerprint.fingerprint_edits(none).count() == 0


def test_chat_events_fold_and_render(spark):
    ev = [(1, (0, 1), 0, "open", "user", "dra"), (1, (0, 1), 1, "edit", None, "what?"), (1, (1, 1), 2, "open", "assistant", None),
          (1, (1, 1), 3, "delta", None, "no"), (1, (1, 1), 4, "regenerate", None, None), (1, (1, 1), 5, "delta", None, "</s>"),
          (1, (1, 1), 6, "delta", None, " yes"), (None, (None, 1), 0, "open", None, None)]
    log = spark.createDataFrame(ev, chat.EVENTS).repartition(4)
    pieces = chat.render(chat.fold_events(log)).orderBy("conv_id", "msg").collect()
    assert chat.parse("".join(p["piece"] for p in pieces if p["conv_id"] == 1)) == [("user", "what?"), ("assistant", "</s> yes")]
    last = pieces[-1]
    assert chat.unescape(last["piece"][last["loss_start"]:last["loss_end"]]) == "</s> yes"


def test_chat_query_equals_a_plain_fold(spark):
    got = {r["conv_id"]: r for r in queries.op1_chat_format(spark, SF_SMALL).collect()}
    rows = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").collect()
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"] or "") for r in rows]
    said = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    by = collections.defaultdict(list)
    for c, *r in sorted(rows):
        by[c].append(r)
    assert set(by) == set(got)
    for c, turns in by.items():
        loss = "".join(t for _, role, t in turns if role == "assistant")
        g = got[c]
        assert (g["n_turns"], g["loss_chars"]) == (len(turns), len(loss))
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert g["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_language_id(spark, docs):
    got = {(r["doc_id"], r["lang_pred"], r["score"] > 0) for r in langid.identify(docs).collect()}
    assert {(2, "und", False), (3, "und", False), (4, "und", False), (12, "und", False)} <= got
    assert (None, "fr", True) in got
    unlabelled = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_language_id_held_out_accuracy(spark):
    got = queries.op2_language_id(spark, SF_SMALL).join(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").selectExpr("avg(cast(lang = lang_pred as int))", "min(score)", "max(score)").first()
    assert held[0] > 0.95 and 0 <= held[1] <= held[2] <= 1


def test_repeated_passage_goes_once(docs):
    got = {r["doc_id"]: r for r in substring.remove_repeats(docs).collect()}
    assert "another sentence follows" in got[8]["text"]
    assert "another sentence follows" not in got[9]["text"] and got[9]["text"].startswith("Another start.")
    assert got[2]["text"] is None and got[6]["n_removed__"] == 0
    assert got[1]["text"] == got[7]["text"] != ""


def test_repeats_with_clashing_columns(spark):
    ship(spark)
    rows = [(8, "Opening of eight. " + PASSAGE + "the end of eight.", 1), (9, "Another start. " + PASSAGE + "different end with words of its own.", 2), (None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, cover__ int")
    for c in ("key__", "n", "cover", "i", "N_REMOVED__", "n_sentences__", "a.b"):
        docs = docs.withColumn(c, F.col("cover__"))
    got = {r["doc_id"]: r for r in substring.remove_repeats(docs).collect()}
    assert got[8]["n_removed__"] == 0 < got[9]["n_removed__"] and got[None]["n_sentences__"] == 0
    assert [got[d][c] for d in (8, 9) for c in ("cover__", "key__", "n", "cover", "i", "a.b")] == [1] * 6 + [2] * 6
    plain = {r["doc_id"]: r["text"] for r in substring.remove_repeats(docs.select("doc_id", "text")).collect()}
    assert plain == {d: r["text"] for d, r in got.items()}


def plain_cleaned(rows):
    """Texts by id, from the rule: every span as its words, the first place of
    each kept, all pieces of any other place removed."""
    pieces, first = {}, {}
    for d, text in sorted(rows):
        own = [[end, words] for end, words in substring._pieces(text)]
        for i in range(len(own) - 1, 0, -1):  # what has no words belongs to the piece before
            if not own[i][1]:
                own[i - 1][0] = own.pop(i)[0]
        pieces[d] = [p for p in own if p[1]]
    places = []
    for d, own in sorted(pieces.items()):
        for i in range(len(own)):
            end = i + substring.RUN
            while end <= len(own) and sum(len(w) for _, w in own[i:end]) < substring.MIN_WORDS:
                end += 1
            if end <= len(own):
                span = tuple(tuple(w) for _, w in own[i:end])
                places.append((d, i, end, first.setdefault(span, (d, i))))
    gone = {(d, k) for d, i, end, at in places if (d, i) != at for k in range(i, end)}
    out = {}
    for d, text in rows:
        starts = [0, *[end for end, _ in pieces[d]][:-1]]
        kept = [text[s:end] for k, (s, (end, _)) in enumerate(zip(starts, pieces[d])) if (d, k) not in gone]
        out[d] = "".join(kept) if any(x == d for x, _ in gone) else text
    return out


def test_repeats_against_all_spans(spark):
    docs = queries.read(spark, SF_SMALL, "documents").select("doc_id", "text")
    r = random.Random(4)
    rows = [(x["doc_id"], x["text"]) for x in docs.collect() if x["text"] is not None]
    long = [t for _, t in rows if len(t.split()) > 80]
    top = max(d for d, _ in rows)
    for k in range(40):  # passages of 55 words in the middle of other texts, with and without punctuation
        words, host = r.choice(long).split(), [f"own{k}x{i}" for i in range(60)]
        at = r.randrange(len(words) - 55)
        rows.append((top + 1 + k, " ".join([*host[:30], *words[at:at + 55], *host[30:]])))
    rows.append((top + 50, rows[0][1] + " " + rows[0][1]))
    ship(spark)
    got = {x["doc_id"]: x for x in substring.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert {d: x["text"] for d, x in got.items()} == plain_cleaned(rows)
    assert all(got[top + 1 + k]["n_removed__"] > 0 for k in range(40))


def test_near_copies_without_ids_keep_one(spark):
    ship(spark)
    rows = [(None, NEAR), (None, NEAR.replace("word60 ", "changed ")), (None, NEAR.replace("word9 ", "other ")), (None, "something else entirely")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 4 and {r["class_id"] for r in got} == {None}
    assert sum(r["kept"] for r in got) == 2
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert corpus_pipeline.drop_near_copies(spark, docs, None).count() == 2


def test_near_copies_and_exact_copies(docs):
    got = neardup.near_duplicates(docs).collect()
    cls = {r["doc_id"]: r["class_id"] for r in got}
    assert len(got) == docs.count()
    assert cls[7] == 1 and cls[11] == 10 and cls[10] == 10 and cls[12] == cls[2] == 2 and cls[3] == 2
    assert cls[8] != cls[9] and cls[5] == 5 and cls[None] is None
    assert {r["n_links"] for r in got if r["doc_id"] == 11} == {1}


def test_near_duplicates_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    cls = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    shingles = {}
    for r in docs.collect():
        w = (r["text"] or "").lower().split()
        shingles[r["doc_id"]] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
    ids = sorted(shingles)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = shingles[a], shingles[b]
            if len(x & y) >= 0.8 * len(x | y):
                assert cls[a] == cls[b]


def test_leaders_that_fail_lose_no_link(spark):
    """Texts share a passage, so their sketches meet, but only some are near."""
    ship(spark)
    shared = " ".join(f"common{i}" for i in range(40))
    own = lambda k: " ".join(f"own{k}x{i}" for i in range(25))
    texts = [shared + " " + own(k % 4) + (f" tail{k}" if k > 3 else "") for k in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    cls = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert cls == {i: i % 4 for i in range(12)}


def test_one_shared_bucket_loses_no_link(spark):
    """Every text meets all others in one bucket and nowhere else; each is
    near to one of them only, and the rounds of leaders end before its turn."""
    ship(spark)
    a = lambda k: " ".join(f"w{k}x{i}" for i in range(20))
    docs = spark.createDataFrame([(2 * k + e, a(k) + (" end" if e else "")) for k in range(30) for e in (0, 1)], "doc_id bigint, text string").repartition(3)
    sketches = neardup.sketch_texts(docs).withColumn("sketch", F.array(F.lit(7).cast("bigint"), F.col("id")))
    got = neardup.links(sketches, docs).join(sketches.select(F.col("key").alias("a"), F.col("id").alias("x")), "a").join(
        sketches.select(F.col("key").alias("b"), F.col("id").alias("y")), "b").collect()
    assert {tuple(sorted((r["x"], r["y"]))) for r in got} == {(2 * k, 2 * k + 1) for k in range(30)}


def test_near_duplicates_leave_no_texts_or_sketches(spark, docs):
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert neardup.near_duplicates(docs).count() == docs.count()
    left = set(os.listdir(folder)) - before
    assert left and not [n for n in left if re.fullmatch(r"omh(-texts|-bags|-buckets|-nodes|-rays)?-[0-9a-f]{32}", n)]


def test_a_group_of_like_bags_gives_no_table_of_pairs(spark, monkeypatch):
    """Texts of the same words in other orders: no bound by words parts them, only alignment."""
    ship(spark)
    r, n, counts = random.Random(4), 40, {}
    texts = [" ".join(r.sample([f"w{i}" for i in range(60)], 60)) for _ in range(n)]
    texts[-1] = texts[-2] + " end"  # one near pair, which the leaders' rounds do not come to
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    sketches = neardup.sketch_texts(docs).withColumn("sketch", F.array(F.lit(7).cast("bigint"), F.col("id")))
    plain = neardup.written

    def watched(df, name):
        out = plain(df, name)
        counts[name] = max(counts.get(name, 0), out.count())
        return out
    monkeypatch.setattr(neardup, "written", watched)
    got = neardup.links(sketches, docs).collect()
    assert len(got) == 1 and max(counts.values()) <= 2 * n, counts


def test_blocks_of_a_bucket_meet_each_other(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    test_one_shared_bucket_loses_no_link(spark)


def test_components_of_chains_stars_and_rings(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(400 - 7 * i, 393 - 7 * i) for i in range(9)]
    r = random.Random(2)
    name = {x: r.randbytes(16) for p in pairs for x in p}
    edges = spark.createDataFrame([(bytearray(name[x]), bytearray(name[y])) for x, y in pairs] * 2, "a binary, b binary")
    got = {bytes(x["key"]): bytes(x["root"]) for x in neardup.components(edges).collect()}
    parts = [range(41), [100 + i for i in range(30)], range(200, 209), [400 - 7 * i for i in range(10)]]
    assert got == {name[x]: min(name[y] for y in part) for part in parts for x in part}


def test_scattered_edits_down_to_the_threshold_are_found(spark):
    """Pairs whose similarity is 0.8 to 0.9, edits scattered or evenly spaced."""
    ship(spark)
    r, rows = random.Random(6), []
    for k in range(90):
        n = (5, 10, 30, 50, 100, 200)[k % 6]
        a = [f"w{r.randrange(10 ** 6)}" for _ in range(n)]
        edits = int((1 - (0.8, 0.85, 0.9)[k % 3]) * n + 1e-9)
        at = [int((i + 0.5) * n / edits) for i in range(edits)] if k % 5 == 0 else r.sample(range(n), edits)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(f"e{k}x{i}" if i in at else w for i, w in enumerate(a)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    cls = {x["doc_id"]: x["class_id"] for x in neardup.near_duplicates(docs).collect()}
    assert sum(cls[i] == i - i % 2 for i in range(180)) >= 178  # at most one pair of 90 missed


def test_packing_places_every_id_once(docs):
    path = queries.vocabulary("byte_bpe_50k.json")
    got = packing.pack(docs.filter("doc_id is null or doc_id != 7"), path).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(by) == set(texts) - {7}
    for d, pieces in by.items():
        ids = [*packing.encoder(path).encode(texts[d]).tolist(), 0]
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            own = b"".join(x.to_bytes(4, "little") for x in ids[at:at + r["length"]])
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(own)
            at += r["length"]
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024


def test_top_k_skips_bad_vectors_and_breaks_ties(spark):
    v = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]),
         (7, [float("inf"), 0.0]), (8, [-1.0, 0.0]), (3, [1.0, 0.0])]
    rows = topk.integer_rows(spark.createDataFrame(v, "vec_id bigint, embedding array<float>"))
    got = topk.top_k(rows.filter("vec_id % 50 = 0"), rows, block_rows=2, query_rows=1).collect()
    by = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 50)}
    assert by == {0: [2, 3, 50, 8], 50: [0, 2, 3, 8]}


def test_bpe_and_counts_on_odd_rows(docs):
    import public_tokenizers
    path = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    got = bpe.encode_digests(docs, path, public_tokenizers.PATTERN).collect()
    assert len(got) == docs.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got if r["doc_id"] in (2, 3)} == {(0, empty, empty)}
    long = next(r for r in got if r["doc_id"] == 5)
    assert long["decoded_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()
    counts = {r["doc_id"]: r for r in tokencount.token_counts(docs, queries.vocabulary("piece_bpe_32k.model")).collect()}
    assert counts[2]["n_tokens"] == 0 and counts[5]["over_limit"] and counts[5]["n_bytes"] == len(LONG)


def test_scores_on_odd_rows(docs, spark):
    got = pitmanyor.score(docs).collect()
    assert len(got) == docs.count()
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 12)} == {1}
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in got)


def test_base_scores_against_plain_counts(spark):
    rows = [(r["doc_id"], (r["text"] or "").translate({c: c + 32 for c in range(65, 91)}))
            for r in queries.read(spark, SF_SMALL, "documents").collect()]
    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", t), None] for d, t in rows}
    trained = collections.Counter(x for d, own in tokens.items() if zlib.crc32(str(d).encode()) % 5 != 1 for x in own)
    n, v = sum(trained.values()), len(trained)
    got = queries.op8_lm_score(spark, SF_SMALL).collect()
    assert len(got) == len(rows)
    for r in got:
        own = tokens[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(trained[x] > 0 for x in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((trained[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own), rel=1e-9)


def test_held_out_score_beats_the_base(spark):
    got = queries.op8_lm_score(spark, SF_SMALL).filter("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert got[0] > got[1]


def test_a_token_is_scored_in_its_own_context(spark):
    """Tokens with equal ends and equal counts: only the pairs differ."""
    texts = ["left-ab up-cd", "right-ab down-cd"] * 30
    train = [d for d in range(400) if zlib.crc32(str(d).encode()) % 5 != 1][:len(texts)]
    asked = [d for d in range(1000, 1100) if zlib.crc32(str(d).encode()) % 5 == 1]
    asked_texts = ["left-ab up-cd", "left-ab down-cd", "right-ab down-cd", "left-ab new-cd"]
    rows = [*zip(train, texts), *zip(asked, asked_texts)]
    got = {r["doc_id"]: r for r in pitmanyor.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    seen, crossed, other, unknown = (got[d] for d in asked[:4])
    assert seen["base_score"] == pytest.approx(crossed["base_score"])
    assert seen["score"] > crossed["score"] + 1 and other["score"] > crossed["score"] + 1
    assert unknown["score"] < seen["score"] - 1


def plain_scores(rows):
    """The model of ``pitmanyor`` in one process, over dictionaries."""
    tokens = {d: [*t.lower().split(), None] for d, t in rows}
    train = [own for d, own in tokens.items() if zlib.crc32(str(d).encode()) % 5 != 1]
    c = collections.Counter(x for own in train for x in own)
    pairs = collections.Counter(p for own in train for p in zip([None, *own], own))
    v, keys = len(c), list(pairs)
    of_count = collections.Counter(pairs.values())
    d = pitmanyor.discount(of_count[1], of_count[2])
    contexts = collections.Counter(collections.Counter(w for _, w in keys).values())
    d0 = pitmanyor.discount(contexts[1], contexts[2])
    word, n = {w: i for i, w in enumerate(c)}, np.array([pairs[k] for k in keys])
    u, w = (np.array([word[k[i]] for k in keys]) for i in (0, 1))
    t, t0, kept = np.ones(len(keys), np.int64), np.ones(v, np.int64), []
    for sweep in range(pitmanyor.BURN + pitmanyor.SWEEPS):
        if sweep:
            t = pitmanyor.tables(n, (1 + d * tu[u]) * parent[w], d, pitmanyor.uniform(np.arange(len(keys)), sweep), pitmanyor.log_stirling(d))  # noqa: F821
        tu, tw = np.bincount(u, weights=t, minlength=v), np.bincount(w, weights=t, minlength=v).astype(np.int64)
        new = (1 + d0 * t0.sum()) * (1 - pitmanyor.UNKNOWN) / v
        t0 = pitmanyor.tables(tw, np.full(v, new), d0, pitmanyor.uniform(np.arange(v), 1000 + sweep), pitmanyor.log_stirling(d0))
        new, all0 = 1 + d0 * t0.sum(), 1 + tw.sum()
        parent, unknown = (tw - d0 * t0 + new * (1 - pitmanyor.UNKNOWN) / v) / all0, new * pitmanyor.UNKNOWN / all0
        if sweep >= pitmanyor.BURN:
            kept.append((dict(zip(keys, t)), tu, parent, unknown))
    out = {}
    for doc, own in tokens.items():
        out[doc] = 0.0
        for x, y in zip([None, *own], own):
            p = 0.0
            for seats, tu, parent, unknown in kept:
                up = parent[word[y]] if y in word else unknown
                p += (pairs[x, y] - d * seats.get((x, y), 0) + (1 + d * (tu[word[x]] if x in word else 0)) * up) / (1 + c[x])
            out[doc] += math.log10(p / len(kept))
    return out


def test_scores_against_the_model_in_one_process(spark, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in queries.read(spark, SF_SMALL, "documents").filter("text is not null and doc_id % 3 = 0").collect() if r["text"].isascii()]
    rows += [(10 ** 6 + i, t) for i, (_, t) in enumerate(rows[:30])]
    want = plain_scores(rows)
    monkeypatch.setattr(pitmanyor, "SHARD_CHARS", 50_000)  # several shards and blocks
    monkeypatch.setattr(pitmanyor, "BLOCK_TOKENS", 5_000)
    got = {r["doc_id"]: r["score"] for r in pitmanyor.score(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert got.keys() == want.keys()
    assert sum(got.values()) == pytest.approx(sum(want.values()), rel=0.003)
    for d in want:
        assert got[d] == pytest.approx(want[d], rel=0.03, abs=1.0)


def test_scores_write_rows_of_blocks_and_shards(spark, monkeypatch):
    """No step of the scores writes a row for each pair or token."""
    paths, path = [], common.scratch_path

    def scratch(spark, name):
        paths.append(path(spark, name))
        return paths[-1]

    for module in (common, pitmanyor):
        monkeypatch.setattr(module, "scratch_path", scratch)
    monkeypatch.setattr(pitmanyor, "forget", lambda *tables: None)
    monkeypatch.setattr(pitmanyor, "SHARD_CHARS", 150_000)
    docs = queries.read(spark, SF_SMALL, "documents")
    n = docs.count()
    shards = 1 + docs.agg(F.sum(F.length("text"))).first()[0] // 150_000
    assert shards > 1 and pitmanyor.score(docs).count() == n and len(paths) > pitmanyor.SWEEPS
    for p in paths:
        assert spark.read.parquet(p).count() <= n + 8 * shards ** 2, p


def test_groups_of_shards_change_no_score(spark, monkeypatch):
    """Shards of tokens are asked by groups: fewer rows, the same scores."""
    docs = queries.read(spark, SF_SMALL, "documents").filter("doc_id % 3 = 0")
    monkeypatch.setattr(pitmanyor, "SHARD_CHARS", 20_000)
    monkeypatch.setattr(pitmanyor, "BLOCK_TOKENS", 5_000)
    scores, told, written = [], [], pitmanyor.of_kind
    monkeypatch.setattr(pitmanyor, "of_kind", lambda rows, path, kind: (told.append(rows.filter("kind = 'told'").count()) if kind == "told" else None, written(rows, path, kind))[1])
    for tokens in (1, 1000):
        monkeypatch.setattr(pitmanyor, "GROUP_TOKENS", tokens)
        scores.append({r["doc_id"]: r["score"] for r in pitmanyor.score(docs).collect()})
    one, many = told[:len(told) // 2], told[len(told) // 2:]
    assert scores[0] == scores[1] and len(one) == pitmanyor.BURN + pitmanyor.SWEEPS - 1
    assert all(x > 2 * y > 0 for x, y in zip(one, many))


def test_fingerprints_against_a_plain_edit(docs):
    got = fingerprint.fingerprint_edits(docs.filter("doc_id is null or doc_id != 7")).collect()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect() if r["doc_id"] != 7), key=lambda r: -(r[0] if r[0] is not None else -1 << 63))
    want = {}
    for i, (d, t) in enumerate(rows):
        after, n = rows[(i + 1) % len(rows)][1], len(t) // 3
        want[d] = hashlib.sha256((t[:len(t) - n] + after[:n]).encode()).hexdigest()
    assert {r["doc_id"]: r["edited_sha256"] for r in got} == want
    assert next(r["near_next"] for r in got if r["doc_id"] == 3) == 1.0  # two empty texts


def test_fingerprints_merge_and_contain(spark):
    a, b = " ".join(f"a{i}" for i in range(400)), " ".join(f"b{i}" for i in range(400))
    df = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, ab string").select(*[fingerprint.sketch(F.col(c)).alias(c) for c in ("a", "b", "ab")])
    r = df.select(fingerprint.resemblance(fingerprint.merge(F.col("a"), F.col("b")), F.col("ab")).alias("same"),
                  fingerprint.containment(F.col("a"), F.col("ab")).alias("inside"), fingerprint.distinct_shingles(F.col("ab")).alias("n")).first()
    assert r["same"] > 0.9 and r["inside"] > 0.7 and 500 < r["n"] < 1200
    parts = spark.createDataFrame([(1, a), (1, b), (2, a)], "g int, t string").select("g", fingerprint.sketch(F.col("t")).alias("fp"))
    assert {x["g"]: len(x["fp"]) for x in fingerprint.merge_groups(parts, ["g"]).collect()} == {1: 64, 2: 64}


def test_language_stage_keeps_short_mixed_and_unlabelled_texts(spark):
    ship(spark)
    base = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(*corpus_pipeline.COLUMNS).filter("text rlike '[a-z]{3}'").limit(150)
    words = {r["lang"]: r["text"].split()[:8] for r in base.filter("lang is not null").collect()}
    mixed = [" ".join(w for group in zip(*words.values()) for w in group), "ok", "la", "x y"]
    odd = spark.createDataFrame([(-1 - i, t, None, "s", len(t)) for i, t in enumerate(mixed)], base.schema)
    both = base.unionByName(odd)
    for docs in (both, both.withColumn("lang", F.lit(None).cast("string"))):
        got = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, SF_SMALL).collect()}
        assert got == {r["doc_id"] for r in docs.collect()}


def test_pipeline_keeps_what_each_stage_kept(spark, docs):
    d = docs.select(*corpus_pipeline.COLUMNS)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, SF_SMALL)
        seen.append({r["doc_id"] for r in d.collect()})
        if name != "packing":
            assert d.columns == corpus_pipeline.COLUMNS
    assert seen[0] == {1, 5, 6, 7, None, 8, 9, 10, 11}
    assert seen[1] == {1, 5, 6, None, 8, 9, 10}
    assert seen[3] == seen[2] <= seen[1]
