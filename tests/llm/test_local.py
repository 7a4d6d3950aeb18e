"""The operators' kernels against libraries and brute force, without Spark."""
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from starledger.llm import bpe, chat, langid, neardup, packing, pitmanyor, substring, tokencount, topk

ALPHABET = "aaab  \n\tthe é日本$%0123'’s<|>　▁\0</s>[INST]\\😀"


def random_texts(n, most=60, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_bpe_equals_the_library_and_round_trips():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ours = bpe.encoder(path, public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    for t in [*random_texts(1500), "a" * 20000, "ab" * 5000, "".join(random.Random(2).choices("abcdefgh", k=20000))]:
        ids = ours.encode(t)
        assert ids == theirs.encode_ordinary(t)
        assert ours.decode(ids).decode() == t


def test_token_counts_equal_the_library_for_any_chunking():
    path = public_tokenizers.path("piece_bpe_32k.model")
    c, lib = tokencount.counter(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for t in [*random_texts(1500), "a" * 40000, "ab " * 20000]:
        n = len(lib.encode(t))
        assert c.count(t) == n
        if t:
            cut = c.prefix + t.replace(" ", tokencount.SPACE)
            assert {c.machine.count(cut, k) for k in (3, 7, 64)} == {n}


def test_packing_ids_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, lib = packing.encoder(path), Tokenizer.from_file(path)
    assert ours.fast is not None
    for t in [*random_texts(500), "x <|endoftext|> y", "a" * 3000]:
        assert ours.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def bags(ids):
    return [np.unique(x, return_counts=True) for x in ids]


def test_best_first_is_a_stable_sort():
    r = np.random.default_rng(5)
    for n in (1, 5, 32, 33, 400):
        for score in (r.random(n), r.integers(0, 4, n).astype(float), np.full(n, -1.0)):
            assert list(packing.best_first(score)) == sorted(range(n), key=lambda i: (-score[i], i))


def test_pack_shard_places_each_id_once_and_fills_windows():
    r = np.random.default_rng(1)
    ids = [r.integers(0, 50, r.integers(1, 1024)) for _ in range(60)]
    sequences = packing.pack_shard([len(x) for x in ids], packing.Index(bags(ids), np.ones(50), 500.0))
    spans = {}
    for s in sequences:
        for d, lo, hi in s:
            spans.setdefault(d, []).append((lo, hi))
    for d, own in spans.items():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] == len(ids[d]) and all(a[1] == b[0] for a, b in itertools.pairwise(own))
    sizes = [sum(hi - lo for _, lo, hi in s) for s in sequences]
    assert len(spans) == 60 and max(sizes) == 1024 and sum(x < 1024 for x in sizes) <= 1


def test_scores_count_every_term_of_the_seed():
    r = np.random.default_rng(3)
    idf, mean = r.uniform(0.1, 5.0, 400), 90.0
    ids = [np.minimum(r.integers(0, 400, r.integers(1, 200)), r.integers(0, 400, 1)) for _ in range(150)]
    index = packing.Index(bags(ids), idf, mean)
    k1, b = packing.K1, packing.B
    for seed in range(0, 150, 10):
        want = np.zeros(150)
        for d, x in enumerate(ids):
            for t in np.unique(ids[seed]):
                tf = (x == t).sum()
                want[d] += idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(x) / mean))
        assert np.allclose(index.scores(seed), want)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment_equals_plain_edit_distance():
    r, pairs = random.Random(3), []
    for _ in range(300):
        a = r.choices("abcdefghijkl", k=r.randint(0, 60))
        b = list(a)
        for _ in range(r.randint(0, max(1, len(a) // 3))):
            i = r.randint(0, len(b))
            b[i:i + r.randint(0, 1)] = r.choice([[], ["x"], ["y", "z"]])
        pairs.append((a, b))
    for (a, b), got in zip(pairs, neardup.verify_pairs(pairs)):
        d = plain_distance(a, b)
        near = d <= neardup.allowed(len(a), len(b), 0.8)
        assert got[0] == near and (got[1] == d if near else got[1] <= d)


def test_order_sketch_sees_order_and_short_texts():
    h = neardup.word_hashes([f"w{i}" for i in range(200)])
    turned = np.concatenate([h[100:], h[:100]])
    a, b = (neardup.order_sketch(neardup.shingle_hashes(x)) for x in (h, turned))
    assert 0 < (a != b).sum() and len(a) == neardup.SKETCHES
    for words in ([], ["a"], ["a", "b"]):
        assert len(neardup.order_sketch(neardup.shingle_hashes(neardup.word_hashes(words)))) == neardup.SKETCHES


def test_sentences_cover_the_text_and_spans_ignore_place():
    for t in random_texts(300, 200):
        ends, counts, hashes = substring.sentences(t)
        assert len(ends) == len(counts) == len(hashes)
        assert not ends or ends[-1] == len(t)
    passage = "one two three four five. six seven eight nine. ten eleven twelve thirteen. and more. "
    of = lambda t: set(zip(*[x.tolist() for x in substring.spans(*substring.sentences(t)[1:])[2:]]))
    assert of("start here. " + passage + "x. y.") & of("another. opening. " + passage)
    assert not of("start here. " + passage) & of("a b c. " * 9)


def test_word_ends_equal_the_pattern():
    r = random.Random(8)
    for text in ("", "  one", "one ", "\u0130 \u03a3\u03a3 x", *("".join(r.choices("ab \n\x1c\u2003\u0130", (4, 4, 4, 1, 1, 1, 1), k=60)) for _ in range(300))):
        for start, end in ((0, len(text)), (min(3, len(text)), max(len(text) - 4, min(3, len(text))))):
            if text[start:end].strip():
                assert substring._word_ends(text, start, end) == [m.end() for m in substring.WORD.finditer(text, start, end)]


def test_passages_of_50_words_share_a_span_wherever_they_stand():
    """Put in mid-sentence, with and without punctuation."""
    r = random.Random(7)
    of = lambda t: set(zip(*[x.tolist() for x in substring.spans(*substring.sentences(t)[1:])[2:]]))

    def prose(n, stop):
        return " ".join(f"w{r.randrange(3000)}" + ("." if r.random() < stop else "") for _ in range(n))
    for k in range(300):
        stop = (0, 0.06, 0.2)[k % 3]
        passage = prose(51, stop)
        a, b = (f"{prose(r.randint(1, 40), stop)} {passage} {prose(r.randint(1, 40), stop)}" for _ in range(2))
        assert of(a) & of(b)


def test_top_k_accumulation_and_ties():
    r = np.random.default_rng(2)
    q, m = r.integers(-3, 3, (5, 8)), r.integers(-3, 3, (40, 8))
    q[:, 2] = 0
    m[:35, 4] = 0
    s = topk.accumulate(q, m)
    assert (s == q @ m.T).all()
    ids = r.permutation(40)
    for row in s:
        want = sorted(range(40), key=lambda i: (-row[i], ids[i]))[:5]
        assert topk.best(row, ids, 5).tolist() == want


def test_parse_undoes_the_escapes():
    for role, text in [("user", "</s>[INST] ok [/INST]"), ("a\\b\nc", "<|im_end|>\n<|im_start|>user\n\\<|"), ("", "")]:
        body = text.replace("\\", "\\\\")
        for c in chat.CONTROL:
            body = body.replace(c, c[0] + "\\" + c[1:])
        assert not any(c in body for c in chat.CONTROL)
        assert chat.unescape(body) == text
    with pytest.raises(ValueError):
        chat.parse("no template")


def test_table_counts_follow_their_conditional():
    d, a, c = 0.6, 0.8, 5
    ls = pitmanyor.log_stirling(d)
    p = np.exp(ls[c, 1:c + 1]) * a ** np.arange(1, c + 1)
    n = 40000
    t = pitmanyor.tables(np.full(n, c), np.full(n, a), d, pitmanyor.uniform(np.arange(n), 1), ls)
    assert np.abs(np.bincount(t, minlength=c + 1)[1:] / n - p / p.sum()).max() < 0.01
    many = pitmanyor.tables(np.full(9, 10 ** 6), np.full(9, a), d, pitmanyor.uniform(np.arange(9), 1), ls)
    assert (many >= 1).all()


def test_tables_of_many_customers_follow_their_mean():
    for d, c, a in ((0.5, 97, 100.0), (0.5, 300, 3.0), (0.8, 300, 500.0), (0.95, 97, 20.0)):
        p = pitmanyor.log_stirling(d, 400)[c, 1:c + 1] + np.log(a) * np.arange(1, c + 1)
        p = np.exp(p - p.max())
        t = pitmanyor.tables(np.full(4000, c), np.full(4000, a), d, pitmanyor.uniform(np.arange(4000), 3), pitmanyor.log_stirling(d))
        assert t.mean() == pytest.approx((p * np.arange(1, c + 1)).sum() / p.sum(), rel=0.05)
    assert pitmanyor.tables(np.array([10 ** 7]), np.array([1e6]), 0.8, np.array([0.4]), pitmanyor.log_stirling(0.8))[0] > 1000


def test_draws_do_not_depend_on_how_they_are_summed():
    """Products of steps, and logs where those would overflow, give the law's draws."""
    r = np.random.default_rng(6)
    c, a, u = r.integers(2, 97, 3000), np.exp(r.uniform(-20, 20, 3000)), r.random(3000)
    for d in (0.1, 0.5, 0.95):
        ls = pitmanyor.log_stirling(d)
        got = pitmanyor.tables(c, a, d, u, ls)
        for k, x, y, t in zip(c, a, u, got):
            p = ls[k, 1:k + 1] + np.log(x) * np.arange(1, k + 1)
            p = np.cumsum(np.exp(p - p.max()))
            assert (p[t - 2] if t > 1 else 0) <= y * p[-1] * (1 + 1e-9) and y * p[-1] <= p[t - 1] * (1 + 1e-9)


def test_tilted_rates_give_their_customers():
    r = np.random.default_rng(7)
    for d in (0.1, 0.5, 0.95):
        c, rate = np.exp(r.uniform(np.log(97), np.log(1e10), 5000)), np.exp(r.uniform(-12, 20, 5000))
        with np.errstate(divide="ignore"):
            s = np.log1p(-pitmanyor.tilted(c, rate, d) / rate) / d  # log(1 - x)
        sure = np.expm1(d * s) < -1e-6  # where the rate's own digits tell x
        assert sure.sum() > 1000
        assert np.allclose((np.log(rate * d) + np.log(-np.expm1(s)) + (d - 1) * s)[sure & (s > -30)], np.log(c)[sure & (s > -30)], atol=1e-3)


def test_words_and_pairs_of_texts():
    texts = [*random_texts(300, seed=8), "", " ", " \x0b\x0cÀ\x1c\x85b É", "A\0B a"]
    n, words = pitmanyor.split_words(texts)
    want = [t.encode().lower().split() for t in texts]
    assert n.tolist() == [len(w) for w in want] and [w.encode() for w in words.to_pylist()] == [w for own in want for w in own]
    every = np.random.default_rng(9).integers(0, 50, 5000)
    for count in (50, 1 << 30):  # the second has no room for places beside the pairs
        u, w, at = pitmanyor.pairs_of(every, 7, count)
        assert (u[at] == np.append(7, every[:-1])).all() and (w[at] == every).all()
        assert (np.diff(u * count + w) > 0).all()
    for kind in (np.int32, np.uint32, np.int64, np.uint64):
        for x in ([], [3], [0, 1 << 20, (1 << 31) - 1]):
            assert pitmanyor.unpacked(pitmanyor.packed(np.array(x), kind), kind).tolist() == x


def test_transitions_are_a_distribution():
    counts = np.random.default_rng(4).poisson(0.3, (20, 20)) * 3
    p = pitmanyor.transitions(counts)
    assert np.allclose(p.sum(axis=1), 1.0) and (p > 0).all()


def test_windows_of_a_long_text_give_all_grams(monkeypatch):
    text = "".join(random.Random(5).choices("abc déf", k=500))
    whole = np.sort(langid.grams(text))
    monkeypatch.setattr(langid, "WINDOW", 64)
    assert (np.sort(langid.grams(text)) == whole).all()
