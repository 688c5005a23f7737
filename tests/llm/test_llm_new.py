"""Importance resampling, structure repair and language ID: odd rows, long ones, and plain versions of their methods."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loomgrade.llm import catalog, importance, language_id, structure_repair


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, pa.Table.from_batches(df.toArrow().to_batches(), schema=df.toArrow().schema))
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def same(df, names, rows):
    key = str
    return sorted(map(tuple, df.select(*names).collect()), key=key) == sorted(rows, key=key)


# -- importance resampling


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain_buckets(text, buckets, order):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    return sorted(zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, order + 1) for i in range(len(w) - k + 1))


def test_combined_crcs_equal_those_of_strings(monkeypatch):
    rnd = random.Random(1)
    many = " ".join(rnd.choice(["ab", "c", "Déf", "x" * 63, "x" * 64, "y" * 300]) for _ in range(400))
    texts = [None, "", "a", "ABC é d", many, "q" * 900, " . ", "z " * 90, many[:77]]
    for piece in (64, 1 << 20):  # a text beyond the slice comes in several runs
        monkeypatch.setattr(importance, "SLICE", piece)
        work = importance.Featurizer(97, 3)
        for t in texts:
            assert sorted(x for *_, f in work.runs(pa.array([t], pa.string())) for _, v in f for x in v.tolist()) == plain_buckets(t, 97, 3)
        for column in (pa.array(texts, pa.string()), pa.array(["no", *texts], pa.large_string()).slice(1)):
            assert sorted(x for *_, f in work.runs(column) for _, v in f for x in v.tolist()) == sorted(x for t in texts for x in plain_buckets(t, 97, 3))


def test_importance_on_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, "a b " * 30), (3, "a b c " * 9), (3, "a b c " * 9), (4, " \n\n"), (5, "É é " * 1_000)]
    rows += [(i, f"w{i % 7} w{i % 5} common " * 10) for i in range(10, 150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "common w3 w4 common"), (2, None)], "item_id bigint, text string")
    for own, items in ((docs, bench), (docs, bench.where("false")), (docs.where("false"), bench)):
        names, wanted = sql_rows(importance.SQL, documents=own, benchmark=items)
        found = importance.resample(own, items)
        assert same(found, names, wanted)
    extra = importance.resample(docs.selectExpr("*", "'x' AS score", "'y' AS __lg_at", "'z' AS rank"), bench)
    assert extra.count() == len(rows) and extra.where("__lg_at = 'y'").count() == len(rows) and extra.where("rank IS NOT NULL").count() == 5 * 143 // 100


# -- structure repair


def plain_repair(rows):
    """The cheapest audit, least in ASCII, by trying all ways that are worth it."""
    best = {structure_repair.START: (0, "")}

    def insert(states):
        for _ in range(3):
            for s, (c, a) in list(states.items()):
                to = 2 if s != 2 else 3
                states[to] = min(states.get(to, (10**9, "")), (c + 2, a + "I"))
        return states

    for initial, fault in rows:
        new = {}
        for s, (c, a) in insert(best).items():
            ways = [("D", s, 3)]
            if fault not in "bd":
                t = fault == "t"
                ways.append(("R", 2 if s != 2 else 3, 2 + t))
                if (initial == "s" and s == 0) or (initial == "u" and s != 2) or (initial == "a" and s == 2):
                    ways.append(("K", {"s": 1, "u": 2, "a": 3}[initial], t))
            for letter, to, more in ways:
                new[to] = min(new.get(to, (10**9, "")), (c + more, a + letter))
        best = new
    best = insert(best)
    return min(best[s] for s in (0, 3) if s in best)


def test_search_is_cheapest_and_least():
    kinds = ["".join(k) for k in itertools.product("suax", "bdtk")]
    rnd = random.Random(3)
    for n in [0, 1, 1, 2, 2, 3] * 40 + [9] * 60:
        rows = [rnd.choice(kinds) for _ in range(n)]
        audit, state = structure_repair.search(rows, 0)
        audit += structure_repair.TAIL[state]
        cost = structure_repair.audit_cost(audit, rows)
        assert (cost, audit) == plain_repair(rows)
        roles, _ = structure_repair.apply_audit(audit, 0, [k[0] for k in rows], [""] * n)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r in roles))


def odd_conversations(spark):
    rnd = random.Random(5)
    texts = ["Yes.", "no", "", " \n", "What?", "Go!", None, "é. ", "the same thing.", "x" * 5000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    rows = [(c, t if rnd.random() < 0.9 else None, rnd.choice(roles), rnd.choice(texts)) for c in range(60) for t in range(rnd.randrange(1, 9))]
    rows += [(None, t, "user" if t % 2 else "assistant", rnd.choice(texts)) for t in range(5)]
    rows += [(99, t // 2, rnd.choice(roles[:6]), rnd.choice(texts) if t % 3 else f"turn {t}.") for t in range(400)]  # a long one with ties
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


@pytest.mark.parametrize("most_rows", [3, 1024])
def test_repair_against_sql_on_odd_rows(spark, most_rows):
    convs = odd_conversations(spark)
    names, wanted = sql_rows(structure_repair.SQL, conversations=convs)
    made = structure_repair.plan(structure_repair.damage(convs.withColumn("code", convs.turn)), most_rows=most_rows)
    assert same(structure_repair.report(made), names, wanted)
    if most_rows == 3:
        assert made.where("several").count() > 100


def test_repaired_rows_and_empty_tables(spark):
    convs = odd_conversations(spark)
    out = structure_repair.repaired(structure_repair.plan(convs, most_rows=5)).orderBy("conv_id", "seg", "place").collect()
    for _, own in itertools.groupby(out, lambda r: r.conv_id):
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in own))
    none = structure_repair.plan(structure_repair.damage(convs.where("false")))
    assert structure_repair.report(none).count() == 0 and structure_repair.repaired(none).count() == 0


def test_long_conversation_is_split_and_quick(spark):
    """20,000 rows of one conversation, in segments on several tasks."""
    rows = spark.range(20_000).selectExpr("7L AS conv_id", "id AS turn", "CASE WHEN id % 3 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('turn ', id % 9000, CASE WHEN id % 5 = 0 THEN '' ELSE '.' END) AS text")
    made = structure_repair.plan(rows, most_rows=512)
    assert made.count() >= 40
    r = structure_repair.report(made).first()
    assert r.duplicate == 20_000 - 9000 and r.gaps == 0 and r.blank == 0 and len(r.audit) >= 20_000


# -- language ID


def plain_chars(text):
    import unicodedata

    return "    " + re.sub(" +", " ", " " + "".join(c.lower() if unicodedata.category(c)[0] in "LM" else " " for c in text) + " ")[1:]


def plain_kneser_ney(texts, order):
    """log p of a character after a context, from plain dictionaries."""
    runs = Counter()
    for t in texts:
        x = plain_chars(t)
        runs.update(x[i - order + 1 : i + 1] for i in range(4, len(x)))
    counts = {order: runs}
    for k in range(order - 1, 0, -1):
        before = defaultdict(set)
        for g in counts[k + 1]:
            before[g[1:]].add(g[0])
        counts[k] = {g: len(v) for g, v in before.items()}
    stats = {}
    for k, c in counts.items():
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        total, kinds = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        stats[k] = (once / (once + 2 * twice) if once and twice else 0.75, total, kinds)

    def p(context, char, vocabulary, k):
        if not k:
            return 1 / vocabulary
        context = context[len(context) - k + 1 :] if k > 1 else ""
        d, total, kinds = stats[k]
        if not total[context]:
            return p(context, char, vocabulary, k - 1)
        return max(counts[k].get(context + char, 0) - d, 0) / total[context] + d * kinds[context] / total[context] * p(context, char, vocabulary, k - 1)

    return p, {g[-1] for g in runs} | {c for g in runs for c in g}


def test_kneser_ney_against_plain_dictionaries(spark):
    rnd = random.Random(2)
    made = {g: ["".join(rnd.choice(a) for _ in range(rnd.randrange(1, 60))) for _ in range(40)] for g, a in (("x", "aab cÉ."), ("y", "bbc dé"), ("z", "ac d "))}
    rows = [(g, t) for g, ts in made.items() for t in ts]
    counts = language_id.gram_counts(spark.createDataFrame(rows, "lang string, text string")).collect()
    langs = sorted(made)
    grams = np.array([[ord(c) for c in r.gram] for r in counts], np.uint32)
    models = language_id.kneser_ney(langs, np.array([langs.index(r.lang) for r in counts]), grams, np.array([r.n for r in counts]))
    plain = [plain_kneser_ney(made[g], language_id.ORDER) for g in langs]
    vocabulary = len({c for _, known in plain for c in known}) + 1
    tests = ["", "...", "a", "abc ab É q Q", "dddd", " b\tc", *(t for ts in made.values() for t in ts[:5])]
    sums, n, letters = models.text_scores(tests)
    for i, t in enumerate(tests):
        x = plain_chars(t)
        assert letters[i] == any(c.isalpha() for c in t)
        if not letters[i]:
            continue
        assert n[i] == len(x) - 4
        for k, (p, _) in enumerate(plain):
            assert math.isclose(sums[i, k], sum(math.log(p(x[:j], x[j], vocabulary, language_id.ORDER)) for j in range(4, len(x))), rel_tol=1e-4, abs_tol=1e-4), (t, langs[k])
    # every context's probabilities add up to one
    for context in ("    ", "ab c", "qqqq", " abb"):
        sure = [sum(p(context, c, vocabulary, language_id.ORDER) for c in {c for _, known in plain for c in known}) + p(context, "?", vocabulary, language_id.ORDER) for p, _ in plain]
        assert all(math.isclose(s, 1) for s in sure)


def test_language_slices_and_odd_rows(spark, monkeypatch):
    rows = [("en", "the cat and the dog " * 20, 1), ("fr", "le chat et la chienne " * 20, 2), ("en", None, 3), (None, "the", 4), ("fr", "", 5), ("en", "the hat and a dog", 6), ("fr", "la chatte et le chien", 7)]
    docs = spark.createDataFrame(rows, "lang string, text string, doc_id bigint").selectExpr("*", "1 AS score", "2 AS __lg_most")
    models = language_id.fit(docs)
    texts = ["The dog!", "LE CHIEN", None, "", "12 . 4", "\u0301", "the dog and le chat " * 500, "ça"]
    out = language_id.identify(spark.createDataFrame([(t, 1) for t in texts], "text string, rejected int"), models).collect()
    assert [r.lang_pred for r in out][:6] == ["en", "fr", "und", "und", "und", "und"] and all((r.lang_pred == "und") == (r.score == 0) for r in out)
    whole = models.text_scores(texts)
    monkeypatch.setattr(language_id.runs_of, "__defaults__", (7,))
    cut = models.text_scores(texts)
    assert np.allclose(whole[0], cut[0], rtol=1e-5) and (whole[1] == cut[1]).all() and (whole[2] == cut[2]).all()
    none = language_id.fit(docs.where("false"))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"} and language_id.identify(docs.where("false"), models).count() == 0
    one = language_id.fit(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in language_id.identify(docs.where("length(text) > 0"), one).collect()} == {"en"}


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = catalog.queries()["op12_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.99 * len(held) and sum(r.rejected for r in held) < 0.02 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


# -- broadcasts and long texts of earlier operators


def test_queries_built_before_the_pipeline_still_run(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    built = [catalog.queries()[n](spark, sf) for n in ("op1_decontamination", "op7_toxicity")]
    done = corpus_pipeline.run(spark, sf)
    assert all(df.count() == 200 for df in built) and done.count() > 0 and all(len(df.collect()) == 200 for df in built)


def test_a_block_destroys_its_own_broadcasts_only(spark):
    from loomgrade.llm.common import owned, share

    outer = share(spark, 1)
    with owned():
        inner = share(spark, 2)
        with owned():
            innermost = share(spark, 3)
        assert inner.value == 2
        with pytest.raises(Exception, match="[Dd]estroy|None|No such"):
            spark.sparkContext.parallelize([0]).map(lambda _: innermost.value).collect()
    assert spark.sparkContext.parallelize([0]).map(lambda _: outer.value).collect() == [1]


def test_network_trains_on_long_texts_without_padding():
    """One text of 30,000 words beside short ones: memory is that of a window of all, not of all up to the longest."""
    import tracemalloc

    from loomgrade.llm import language_model as L

    words = L.vocabulary([(f"w{i}".encode(), 1000 - i) for i in range(300)] + [(b"", 64)], 200_000, 400)
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 100, 30_000), *(rng.integers(0, 100, 50) for _ in range(63))]
    network = L.Network(words.start)
    tracemalloc.start()
    assert L.train(network, texts) == sum(map(len, texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6 and np.isfinite(network.w).all()  # arrays padded to the longest text would take 3 x 30,000 x 64 x 8 bytes


def test_words_by_arrow_equal_plain_splits():
    from loomgrade.llm import language_model as L
    from loomgrade.llm.common import all_space_words, space_words

    rng = random.Random(1)
    marks = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", "\0", "a", "B", "é", "ab"]
    texts = [None, "", " ", *("".join(rng.choices(marks, k=rng.randrange(30))) for _ in range(500))]
    plain = [space_words((t or "").encode()) for t in texts]
    for kind in (pa.string(), pa.large_string()):
        words, sizes = all_space_words(pa.array(["cut", *texts, "cut off"], kind).slice(1, len(texts)))
        assert words.to_pylist() == [w for p in plain for w in p] and sizes.tolist() == [len(p) for p in plain]
    for counts in ([(b"a", 9), (b"", 7), (b"ab", 3)], [(b"a", 9)], []):  # with and without a known end
        words = L.vocabulary(counts, 50, 9)
        got, want = L.Reader(words).read(pa.array(texts)), [L.numbers(words, p) for p in plain]
        assert [x.tolist() for x in np.split(got.ids, got.starts[1:])] == [x.tolist() for x in want]
        for bag, p, x in zip(L.bags(got.rows, got.strange, len(texts)).to_pylist(), plain, want, strict=True):
            assert sorted((b["w"], b["n"]) for b in bag) == sorted(Counter(w for w, i in zip([*p, b""], x, strict=True) if i == len(counts)).items())


def test_scoring_reads_a_bounded_number_of_texts_side_by_side():
    """Memory is that of a window of some texts, not of all; and the texts that stand beside a text change nothing."""
    import tracemalloc

    from loomgrade.llm import language_model as L

    words = L.vocabulary([(f"w{i}".encode(), 1000 - i) for i in range(300)] + [(b"", 64)], 200_000, 400)
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 100, n) for n in (3000, *rng.integers(1, 60, 8000))]
    network = L.Network(words.start)
    network.w += rng.normal(0, 0.05, network.w.shape) * (network.w > -100)
    tracemalloc.start()
    got = L.log_likelihoods(network, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6  # the states of all texts in a window, and the products of their classes, would take 100e6
    assert np.allclose(got[:9], [L.log_likelihoods(network, [t])[0] for t in texts[:9]], rtol=1e-9)
