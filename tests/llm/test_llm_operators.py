"""Small tables with nulls, empty and long texts, ties, repeated rows, clashing names; operators against brute force."""

import math
import pickle
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgrade.llm import bpe, chat, decontamination, language_model, line_dedup, simhash, token_counts, topk, toxicity, url_filter

LONG = " ".join(f"w{i % 700}x{i}" for i in range(30_000))
ROWS = [(1, None), (2, ""), (None, "a b c"), (3, "a b c"), (3, "a b c"), (4, " \n\n"), (5, LONG), (6, "é" * 50 + "\nAb\r\nab")]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with a helper's usual names as extra columns."""
    rows = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    return rows.withColumns({c: F.lit("x") for c in ("score", "digest", "n_words", "shard", "line", "key", "fp", "n", "Rule", "ids", "block")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def decon(docs, items, **k):
    return decontamination.decontaminate(docs, items, **k)


def test_odd_rows_keep_their_number_and_columns(spark, odd, none):
    import public_tokenizers

    items = spark.createDataFrame([(1, "a b c"), (None, "zz"), (2, None), (3, "")], "item_id bigint, text string")
    labels = spark.createDataFrame([(3, 1), (5, 0), (None, 1), (6, None)], "doc_id bigint, toxic int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    index = toxicity.fit(odd, labels)
    counts = language_model.word_counts(odd)
    words, weights = language_model.fit(odd.select("doc_id", "text"), counts)
    made = {
        "decontamination": lambda d: decon(d, items),
        "url": lambda d: url_filter.filter_urls(d.withColumn("url", F.col("text"))),
        "bpe": lambda d: bpe.encode(d, path),
        "toxicity": lambda d: toxicity.score(d, index),
        "lines": line_dedup.dedup_lines,
        "lm": lambda d: language_model.score(d, words, weights, counts),
        "simhash": simhash.near_duplicates,
    }
    for name, f in made.items():
        out = f(odd)
        assert out.count() == len(ROWS), name
        assert len({c.lower() for c in out.columns}) == len(out.columns), name
        assert name == "simhash" or {"digest", "shard", "block"} <= set(out.columns), name
        assert f(none).count() == 0, name


def test_no_labels_and_no_items(spark, odd):
    assert toxicity.score(odd, toxicity.fit(odd, spark.createDataFrame([], "doc_id bigint, toxic int"))).where("score <> 0").count() == 0
    assert decon(odd, spark.createDataFrame([], "item_id bigint, text string")).where("n_hit > 0").count() == 0
    own = decon(odd.withColumn("__lg_spans", F.lit("mine")), odd.select(F.col("doc_id").alias("item_id"), "text"))
    assert own.where("__lg_spans = 'mine'").count() == len(ROWS) and own.where("n_hit > 0").count() > 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=4), st.lists(st.sampled_from("abcd"), max_size=40))
def test_automaton_finds_all_windows(items, text):
    window = 3
    automaton = decontamination.SuffixAutomaton([(str(i), [w.encode() for w in x]) for i, x in enumerate(items)], window)
    spans, found, _ = automaton.scan([w.encode() for w in text])
    hit, names = set(), set()
    for i, x in enumerate(items):
        n = min(window, len(x))
        for a in range(len(x) - n + 1) if x else ():
            for b in range(len(text) - n + 1):
                if text[b : b + n] == x[a : a + n]:
                    hit |= set(range(b, b + n))
                    names.add(str(i))
    assert {j for a, b in spans for j in range(a, b)} == hit and found == names


def test_blocks_of_items_agree_and_cuts(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(30)}"
    items = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randrange(1, 9)))) for i in range(25)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(60))) for i in range(25)], "doc_id bigint, text string")
    sizes = ({}, {"block_words": 40}, {"block_words": 40, "pass_bytes": 1}, {"block_words": 40, "pass_bytes": 20_000})
    whole, *parts = ({r.doc_id: (r.n_hit, r["items"], r.longest_match) for r in decon(docs, items, window=3, **k).collect()} for k in sizes)
    assert all(p == whole for p in parts) and any(h for h, _, _ in whole.values())
    item = spark.createDataFrame([(1, "one two three four")], "item_id bigint, text string")
    doc = spark.createDataFrame([(1, "Keep, One TWO three; four - this")], "doc_id bigint, text string")
    assert decon(doc, item, window=4, action="cut").first().text == "Keep,  - this" and decon(doc, item, window=4, action="drop").count() == 0
    assert decon(doc, item, window=4, coverage=2.0, max_run=4).first().contaminated


def test_url_edges():
    v, find = url_filter.Vocabulary(), url_filter.RULES.find
    assert url_filter.split_url("HTTP://A.Example.COM/en/7?x#y") == ("a.example.com", "/en/7") and url_filter.split_url("x/y") == ("", "") and url_filter.split_url("h://a?b/c") == ("a", "")
    assert find("m.example.com", "/en/71") == ("example.com/en/7", "allow") and find("m.example.com", "/en/8") == ("com/en/", "block") and find("notexample.net", "/de/8") == ("net/de/", "allow") and find("com.org", "/en/") is None
    assert v.judge("http://a/casino")[0] == "block" and v.judge("http://a/casinos")[0] == "allow" and v.judge("http://cheap.a/loan?x")[0] == "block" and v.judge("http://cheap.a/cheap")[0] == "allow" and v.judge(None)[0] == "allow"


@pytest.mark.parametrize("width,eod", [(2, 50_256), (4, 10), (2, 0)])
def test_token_files_of_any_cut(spark, tmp_path, width, eod):
    rng = np.random.default_rng(width)
    ids = rng.integers(0, 2**16 - 1, 4000).astype("<u2" if width == 2 else "<u4")
    ids[rng.integers(0, 4000, 60)] = eod
    ids[:2] = eod
    for n, own in (("a", ids), ("b", ids[:1]), ("c", np.append(ids[5:50], eod + 1).astype(ids.dtype))):
        (tmp_path / n).write_bytes(own.tobytes())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = {}
        for r in token_counts.count_tokens(spark, str(tmp_path), eod, width).collect():
            got.setdefault(r.file[-1], []).append((r.ordinal, r.n_tokens, r.closed))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for n, own in (("a", ids), ("b", ids[:1]), ("c", np.append(ids[5:50], eod + 1))):
        ends = np.flatnonzero(own == eod)
        want = [(i, int(b - a), True) for i, (a, b) in enumerate(zip(np.append(-1, ends[:-1]) + 1, ends, strict=True))] if len(ends) else []
        last = len(own) - (ends[-1] + 1 if len(ends) else 0)
        assert sorted(got.get(n, [])) == want + ([(len(want), int(last), False)] if last else [])


def test_shards_and_blocks_find_every_link(spark):
    rng = np.random.default_rng(0)
    points = set()
    for b in rng.integers(0, 2**63, 120, dtype=np.int64).tolist() + [1 << 40] * 6:
        for _ in range(int(rng.integers(1, 14))):
            points.add(b)
            for k in rng.integers(0, 64, int(rng.integers(1, 4))):
                b ^= 1 << int(k)
    points = np.array(sorted(points), np.uint64)
    near = np.bitwise_count(points[:, None] ^ points[None]) <= 3
    root = np.arange(len(points))
    while True:
        new = np.where(near, root[None], len(points)).min(axis=1)
        if (new == root).all():
            break
        root = new
    rows = spark.createDataFrame([(int(p), int(p)) for p in points.view(np.int64)], "fp bigint, doc_id bigint")
    want = len(set(root.tolist()))
    for shard in (10_000, 40, 2):
        got = {r.fp: r.component_id for r in simhash.assign(rows, 3, shard).collect()}
        assert len(set(got.values())) == want and all(len({got[int(p)] for p in points[root == k].view(np.int64)}) == 1 for k in set(root.tolist()))


def test_a_long_chain_of_fingerprints_is_one_component(spark):
    rng, x, chain = random.Random(4), 0, [0]
    for _ in range(1499):
        for b in rng.sample(range(64), 3):
            x ^= 1 << b
        chain.append(x)
    signed = np.array(chain, np.uint64).view(np.int64).tolist()
    rows = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp bigint, doc_id bigint")
    assert {r.component_id for r in simhash.assign(rows, 3, 8).collect()} == {0}


def test_one_of_each_group_stays(spark, odd):
    kept = simhash.deduplicate(odd)
    assert sorted((r.doc_id, (r.text or "")[:5]) for r in kept.collect()) == [(1, ""), (3, "a b c"), (5, LONG[:5]), (6, "ééééé")] and kept.columns == odd.columns


def test_class_model_sums_to_one_and_carries_state():
    counts = [(f"w{i}".encode(), 400 // (i + 1)) for i in range(300)] + [(b"", 50)]
    n, v = sum(c for _, c in counts), len(counts)
    words = language_model.vocabulary(counts[:200], n, v, 20, 5)
    net = language_model.Network(words.start, 6, 4)
    net.w += np.random.default_rng(0).normal(0, 0.05, net.w.shape) * (net.w > -100)
    h = np.random.default_rng(1).normal(size=(words.size, 6))[:1].repeat(words.size, 0)
    assert np.isclose(np.exp(net.log_probs(h, np.arange(words.size))[0]).sum(), 1.0)
    share = {k: 0.0 for k in range(words.size)}
    for w in words.number:
        at, k = words.number[w], language_model.classes(words, [w])[0]
        share[k] += 10 ** (words.log_count[at] - words.log_mass[k])
    assert all(np.isclose(s, 1.0) for k, s in share.items() if k < words.size - 1)
    text = np.random.default_rng(2).integers(0, words.size, 3 * language_model.WINDOW + 5)
    x, state, want = net.k, np.zeros((1, 6)), 0.0
    for y in text:
        state, _ = net.step(np.array([x]), state)
        want += net.log_probs(state, np.array([y]))[0][0]
        x = y
    got = language_model.log_likelihoods(net, [text, text[:7], np.zeros(0, np.int64)])
    assert np.isclose(got[0], want) and got[2] == 0


def test_whole_windows_equal_single_steps():
    net = language_model.Network(np.log(np.full(11, 1 / 11)), 4, 3)
    rng = np.random.default_rng(3)
    net.w += rng.normal(0, 0.3, net.w.shape) * (net.w > -100)
    x, h = rng.integers(0, 12, (5, 6)), rng.normal(size=(6, 4))
    states, gates, gated, c = net.run(x, h)
    for t in range(5):
        h, (_, before, z, r, rh, own) = net.step(x[t], h)
        for got, want in ((states[t + 1], h), (states[t], before), (gates[t], np.concatenate((z, r), axis=1)), (gated[t], rh), (c[t], own)):
            assert np.allclose(got, want)


def test_gradients():
    net = language_model.Network(np.log(np.full(7, 1 / 7)), 3, 3)
    rng = np.random.default_rng(0)
    net.w += rng.normal(0, 0.1, net.w.shape) * (net.w > -100)
    x, y, h = rng.integers(0, 7, (4, 2)), rng.integers(0, 7, (4, 2)), rng.normal(size=(2, 3))
    y[3, 1] = -1

    def loss(grads=None):
        flat = np.zeros_like(net.w)
        at, g = 0, {}
        for k, s in net.slices.items():
            g[k] = flat[at : at + int(np.prod(s))].reshape(s)
            at += int(np.prod(s))
        return net.train_window(x, y, h, g)[1], flat

    _, flat = loss()
    for i in rng.integers(0, len(net.w), 60):
        old = net.w[i]
        if old < -100:
            continue
        net.w[i] = old + 1e-5
        up = loss()[0]
        net.w[i] = old - 1e-5
        down = loss()[0]
        net.w[i] = old
        assert np.isclose((up - down) / 2e-5, flat[i], atol=1e-4)


def test_bpe_joins(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, theirs = bpe.Tokenizer(path), Tokenizer.from_file(path)
    monkeypatch.setattr(bpe, "MASK", 7)
    monkeypatch.setattr(bpe, "LEAST", 4)
    encoder, rng = bpe.ChunkEncoder(own, keep_bytes=300_000), random.Random(5)
    bits = ["'re", "'", "r", " ", "  ", "\n", "\t", "don't", "<|endoftext|>", "<|endof", "text|>", "é", "日本", "1", "...", "\u2003", "\u3000", "\r\n", "\x1c", "\x85", "👍🏽", "Hello"]
    for _ in range(1500):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(50)))
        ids = encoder.encode(t.encode()).tolist()
        assert ids == theirs.encode(t, add_special_tokens=False).ids and own.decode(ids) == theirs.decode(ids, skip_special_tokens=False)
    assert encoder.reused > 500
    blanks = [" " * 2_000_000, "a" + "\t" * 1_200_000 + "b", "\n" * 1_100_000 + "x y", " " * 1500 + "<|endoftext|>" + " " * 1001, "a" + "\u2003" * 1000 + " b"]
    for t in blanks:
        assert bpe.ChunkEncoder(own).encode(t.encode()).tolist() == own.encode(t) == theirs.encode(t, add_special_tokens=False).ids


def test_bpe_joins_widen_until_they_agree():
    """A tokenizer whose first word after a cut depends on what stands before it: the join must go on to the next word."""

    class Odd:
        def encode(self, text):
            words = text.split(" ")
            return [len(w) * (1 if i or w else 7) + 100 * (i == 1 and text[:1] != " ") for i, w in enumerate(words)]

    encoder = bpe.ChunkEncoder(Odd())
    raw = b"ab cd ef gh " * 400
    assert len(bpe.cuts(raw)) == 0 or len(encoder.encode(raw)) > 0
    parts = iter([[9], []])
    old = bpe.cuts
    try:
        bpe.cuts = lambda text: next(parts)
        encoder.encode(b"ab cd ef gh ij kl mn")
    finally:
        bpe.cuts = old
    assert encoder.widened > 0


def plain_neighbours(bags, labels, query, k, skip=None):
    """Cosines of all examples, by the rule that the module's docstring states."""
    n, ones = len(bags), sum(labels)
    d, p = {}, {}
    for bag, y in zip(bags, labels, strict=True):
        for w in bag:
            d[w], p[w] = d.get(w, 0) + 1, p.get(w, 0) + y

    def weight(w):
        idf = math.log((n + 1) / (d[w] + 1)) + 1
        if ones in (0, n):
            return idf
        chi = n * (p[w] * (n - ones) - (d[w] - p[w]) * ones) ** 2 / (d[w] * (n - d[w] + 0.5) * ones * (n - ones))
        return idf * math.sqrt((chi + 1) / n)

    def unit(bag):
        raw = {w: (1 + math.log(c)) * weight(w) for w, c in bag.items() if d.get(w, 0) >= 2}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()}

    q = unit(query)
    every = [(round(sum(q.get(w, 0) * x for w, x in unit(b).items()), 9), i) for i, b in enumerate(bags) if i != skip]
    return sorted((s, i) for s, i in every if s > 0)[::-1][:k]


@pytest.mark.parametrize("block,labelled", [(2, 1), (16, 1), (64, 1), (4, 0), (4, 2)])
def test_nearest_is_exact(monkeypatch, block, labelled):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rng = random.Random(block)
    bags = [{f"w{min(rng.randrange(60), rng.randrange(60))}": rng.randrange(1, 4) for _ in range(rng.randrange(0, 9))} for _ in range(150)]
    bags[5] = dict(bags[4])  # a tie
    y = [int(labelled == 2 or labelled == 1 and "w3" in b) for b in bags]
    made = [sorted((w.encode(), c) for w, c in b.items()) for b in bags]
    words = pa.array([[w for w, _ in b] for b in made], pa.list_(pa.binary()))
    index = toxicity.build(words, pa.array([[c for _, c in b] for b in made], pa.list_(pa.int32())), np.array(y), np.arange(150))
    index = pickle.loads(pickle.dumps(pickle.loads(pickle.dumps(index))))
    for i, bag in enumerate(bags):
        terms, counts = index.vector([w.encode() for w, c in bag.items() for _ in range(c)])
        for skip in (None, i):
            want = plain_neighbours(bags, y, bag, 9, skip)
            places, cosine = index.nearest(terms, counts, 9, -1 if skip is None else int(np.flatnonzero(index.ids == i)[0]))
            assert np.allclose(cosine, [s for s, _ in want], atol=2e-9)
            assert all(any(j == e and abs(s - c) < 2e-9 for s, j in plain_neighbours(bags, y, bag, 150, skip)) for e, c in zip(index.ids[places], cosine, strict=True))


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("threshold,crowd", [(1, 64), (1, 2), (2, 64), (2, 3), (0, 64)])
def test_lines_against_all_pairs(spark, threshold, crowd):
    rng = random.Random(threshold * 10 + crowd)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randrange(1, 16))) for _ in range(12)]
    docs = []
    for d in range(14):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            x = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                i = rng.randrange(len(x) + 1)
                x[i : i + rng.randrange(2)] = rng.choice(["", "a", "z"])
            lines.append("".join(x))
        docs.append((d, "\n".join(lines)))
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_kept) for r in line_dedup.dedup_lines(rows, threshold, 4, crowd).collect()}
    seen: list[str] = []
    for d, t in docs:
        out = []
        for x in t.split("\n"):
            old = any(x == y or min(len(x), len(y)) >= 4 and edit(x, y) <= threshold for y in seen)
            if x.strip(" "):
                seen.append(x)
            if not x.strip(" ") or not old:
                out.append(x)
        assert got[d] == ("\n".join(out), len(t.split("\n")), len(out)), (d, t)


def test_topk_prunes_and_is_exact(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 8)) * rng.gamma(1, 1, (400, 1))
    v[50:60] = v[0]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [float("nan")] * 8), (902, [1.0, None] + [0.0] * 6), (903, [1.0]), (904, []), (905, [0.0] * 8), (7, [1.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    good = topk.quantised(table, "vec_id", "embedding")
    q = [(i, np.floor(np.array(r) * 1024)) for i, r in rows if i % 20 == 0 and i < 400]
    every = [(i, np.floor(np.array(r) * 1024)) for i, r in rows if r and len(r) == 8 and None not in r and np.isfinite(r).all()]
    want = {(i, n + 1, c, -int(s)) for i, x in q for n, (s, c) in enumerate(sorted((-(x @ y), c) for c, y in every if c != i)[:10])}
    for block, sample in ((4096, 20_000), (6, 15)):
        assert {tuple(r) for r in topk.search(good.where("vec_id % 20 = 0 AND vec_id < 400"), good, 10, block, sample).collect()} == want
    s = topk.Searcher(np.array([i for i, _ in q]), np.array([x for _, x in q]), 10)
    s.feed(np.array([i for i, _ in every]), np.array([x for _, x in every]))
    s.feed(np.arange(10_000, 14_000), rng.normal(size=(4000, 8)).round() * 10)
    assert s.pruned > s.verified


def test_chat_parts_and_controls(spark):
    rows = [(1, 0, "user", [("text", "a<|end|>&lt;", None, None, None, None, None), ("image", None, "u://1", 56, 29, None, None), (None, "b", None, None, None, None, None), ("audio", None, "u://2", None, None, 81, None)]), (1, 1, "assistant", [("document", None, "u://3", None, None, None, 2), ("text", "<|turn:user|>", None, None, None, None, None)]), (2, None, None, None)]
    chats = chat.format_chats(spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}"))
    one, two = chats.orderBy("conv_id").collect()
    assert [(a.position, a.n, a.kind, a.ref, a.tokens) for a in one.attachments] == [(0, 1, "image", "u://1", 4), (0, 2, "audio", "u://2", 3), (1, 1, "document", "u://3", 1024)] and one.tokens == 1031
    assert "<|image:1|>b<|audio:2|>" in one.formatted and one.formatted.count("<|turn:") == 2 and two.attachments == []
    back = {r.conv_id: r for r in chat.read_back(chats).collect()}
    assert [t.text for t in back[1].turns] == ["a<|end|>&lt;<|image:1|>b<|audio:2|>", "<|document:1|><|turn:user|>"] and back[1].learnt == "<|document:1|><|turn:user|>"
    assert [(t.role, t.text) for t in back[2].turns] == [("", "")] and back[2].learnt == ""


def test_empty_tables_and_extra_columns(spark):
    chats = spark.createDataFrame([(1, 0, "user", "a", "x")], "conv_id bigint, turn bigint, role string, text string, formatted string")
    assert chat.format_chats(chats).first().formatted == "<|turn:user|>a<|end|>" and chat.format_chats(chats.where("false")).count() == 0
    vectors = spark.createDataFrame([(1, [1.0] * 3000, "x"), (2, [2.0] * 3000, "y")], "vec_id bigint, embedding array<double>, v string")
    good = topk.quantised(vectors, "vec_id", "embedding")
    assert [(r.query_id, r.vec_id) for r in topk.search(good.where("vec_id = 1"), good).collect()] == [(1, 2)]
    assert topk.search(good.where("false"), good).count() == 0 == topk.search(good, good.where("false")).count()
    long = "http://a.example.com/en/7" + "x" * 200_000 + "/casino"
    urls = spark.createDataFrame([(1, long, "v")], "page_id bigint, url string, verdict string")
    assert url_filter.filter_urls(urls).first().rule == "example.com/en/7" and url_filter.filter_urls(urls.where("false")).count() == 0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a|>b&", None]), st.text(alphabet="<|>&end;lt:/turn \n[é", max_size=30)), min_size=1, max_size=4))
def test_chat_round_trip(spark, turns):
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id bigint, turn bigint, role string, text string")
    back = chat.read_back(chat.format_chats(rows)).first()
    assert [(t.role, t.text) for t in back.turns] == [(r or "", t) for r, t in turns] and back.learnt == "".join(t for r, t in turns if r == "assistant")
