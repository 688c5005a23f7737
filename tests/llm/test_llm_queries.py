"""The operators' queries against their SQL, or brute force where SQL cannot say it."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
import xxhash
from oracle import compare

from loomgrade.llm import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    assert compare(spark, SF, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op1_decontamination", "op3_token_counts", "op8_line_dedup"])
def test_sql_and_query_agree_on_odd_rows(spark, tmp_path, name):
    """Null texts and ids, repeated rows; and documents without any row."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = bench.where("length(text) > 200").first().text
    rows = [(1, None), (2, ""), (None, item), (3, f"a b\n{item}\na b"), (3, f"a b\n{item}\na b"), (4, " \n\n"), (5, "y" * 30 + "\n" + "y" * 31)]
    rows = rows if name != "op3_token_counts" else [r for r in rows if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for case, own in (("some", docs), ("none", docs.where("false"))):
        folder = str(tmp_path / case)
        own.coalesce(1).write.parquet(f"{folder}/documents.parquet")
        bench.coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
        made = catalog.queries()[name](spark, folder)
        if case == "none":
            assert made.count() == 0
            continue
        con = __import__("duckdb").connect()
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
        found = con.execute(catalog.oracle_sql()[name])
        names = [c[0] for c in found.description]
        key = lambda r: str(r)
        assert sorted((tuple(r) for r in made.select(*names).collect()), key=key) == sorted(map(tuple, found.fetchall()), key=key)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def test_simhash_against_all_pairs(spark, texts):
    got = {r.doc_id: r for r in catalog.queries()["op4_simhash"](spark, SF).collect()}

    def brute(t):
        w = words(t)
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    fp = {d: brute(t) for d, t in texts.items()}
    assert all(got[d].fingerprint == f"{f:016x}" for d, f in fp.items())
    root = {d: d for d in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert all(got[d].component_id == find(d) for d in ids)


def test_lm_counts_and_gain(spark, texts):
    got = catalog.queries()["op5_lm_scoring"](spark, SF).collect()
    c = Counter()
    for d, t in texts.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            c.update([*words(t), ""])
    n, v = sum(c.values()), len(c)
    for r in got:
        w = [*words(texts[r.doc_id]), ""]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.n_tokens == len(w) and r.n_known == sum(c[x] > 0 for x in w) and r.train_tokens == n
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_scores_against_a_plain_walk(spark, texts):
    """Word by word with the fitted weights: the gated state, both softmax levels and a word's share of its class."""
    from loomgrade.llm import language_model as L
    from loomgrade.session import table

    docs = table(spark, SF, "documents").select("doc_id", "text")
    training = docs.where(~L.held_out(docs["doc_id"]))
    counts = {bytes(r.w): r.c for r in L.word_counts(training).collect()}
    rows = spark.createDataFrame([(w, c) for w, c in counts.items()], "w binary, c bigint")
    words, weights = L.fit(training, rows)
    net = L.Network(words.start, weights=weights)
    some = [d for d in sorted(texts) if len(texts[d]) < 1500][:12]
    got = {r.doc_id: r.score for r in L.score(docs.where(docs["doc_id"].isin(some)), words, weights, rows).collect()}
    sig = lambda x: 1 / (1 + math.exp(-x))
    for d in some:
        h, x, total = [0.0] * net.h, net.k, 0.0
        for w in [*words_of(texts[d]), b""]:
            e = net.p["e"][x]
            zr = [sig(float(e[j]) + sum(h[i] * float(net.p["u"][i, j]) for i in range(net.h))) for j in range(2 * net.h)]
            c = [math.tanh(float(e[2 * net.h + j]) + sum(zr[net.h + i] * h[i] * float(net.p["c"][i, j]) for i in range(net.h))) for j in range(net.h)]
            h = [h[j] + zr[j] * (c[j] - h[j]) for j in range(net.h)]
            y = int(L.classes(words, [w] if w else [])[0])
            a = [sum(h[i] * float(net.p["go"][i, j]) for i in range(net.h)) + float(net.p["gb"][j]) for j in range(net.groups)]
            g = y // net.g
            b = {k: sum(h[i] * float(net.p["wo"][k, i]) for i in range(net.h)) + float(net.p["wb"][k]) for k in range(g * net.g, (g + 1) * net.g)}
            top = lambda xs: max(xs) + math.log(sum(math.exp(v - max(xs)) for v in xs))
            share = math.log10(counts.get(w, 0) + 1) - float(words.log_mass[y])
            total += (a[g] - top(a) + b[y] - top(list(b.values()))) / math.log(10) + share
            x = y
        assert math.isclose(got[d], total, rel_tol=2e-5), d


def words_of(t):
    return [w.encode() for w in words(t)]


def test_bpe_against_the_library(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in catalog.queries()["op6_bpe"](spark, SF).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_toxicity_held_out(spark):
    got = catalog.queries()["op7_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    assert right > 0.93 and not any(r.predicted and not r.toxic for r in got)


def test_toxicity_against_brute_force(spark, texts):
    """Every document's votes over all examples, then the curve that the votes of examples without themselves give."""
    from test_llm_operators import plain_neighbours

    labels = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            labels[r.doc_id] = max(labels.get(r.doc_id, 0), r.toxic)
    examples = {}
    for d in sorted(labels):
        if d in texts:
            examples.setdefault(texts[d], [d, 0])[1] |= labels[d]
    bag = lambda t: Counter(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)))
    bags, ids, y = [bag(t) for t in examples], [d for d, _ in examples.values()], [v for _, v in examples.values()]
    prior = sum(y) / len(y)
    got = {r.doc_id: r for r in catalog.queries()["op7_toxicity"](spark, SF).collect()}
    pairs = []
    for d, t in list(texts.items())[::7]:
        near = plain_neighbours(bags, y, bag(t), 15)
        if not near:
            continue
        top = plain_neighbours(bags, y, bag(t), 16)
        if len(top) == 16 and abs(top[14][0] - top[15][0]) < 1e-8:
            continue  # a tie at the edge: which of them votes is the index's own order
        vote = (prior + sum(s * s * y[i] for s, i in near)) / (1 + sum(s * s for s, _ in near))
        pairs.append((math.log(vote / (1 - vote)), math.log(got[d].score / (1 - got[d].score))))
        assert math.isclose(got[d].evidence[0].cosine, near[0][0], abs_tol=1e-8)
        assert len({s for s, _ in near[:4]}) < 4 or [e.doc_id for e in got[d].evidence] == [ids[i] for _, i in near[:3]]
    # one line through all of them: the score is the calibrated vote and nothing else
    (x0, z0), (x1, z1) = min(pairs), max(pairs)
    slope = (z1 - z0) / (x1 - x0)
    assert slope > 0 and len(pairs) > 50 and all(math.isclose(z, z0 + slope * (x - x0), abs_tol=1e-5) for x, z in pairs)


def test_pipeline_stage_by_stage(spark):
    """Each stage against a plain version of it on what its predecessor kept."""
    import corpus_pipeline as P

    from loomgrade.llm.decontamination import SuffixAutomaton
    from loomgrade.session import materialise

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 250")
    kept = []
    for name, stage in P.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        kept.append({r.doc_id: r for r in docs.collect()})
    toxic, lines, near, clean, coded = kept
    assert set(lines) == set(toxic) and set(near) <= set(lines) and set(clean) <= set(near) and set(coded) == set(clean)
    seen = []
    for d in sorted(toxic):
        out = []
        for x in toxic[d].text.split("\n"):
            old = x.strip(" ") and any(x == y or min(len(x), len(y)) >= 24 and within_one(x, y) for y in seen)
            if x.strip(" "):
                seen.append(x)
            if not old:
                out.append(x)
        assert lines[d].text == "\n".join(out) and lines[d].n_chars == len(lines[d].text)
    bench = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 13]) for w in bench for i in range(max(1, len(w) - 12)) if w}
    for d, r in near.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text))
        hit = {j for n in {len(g) for g in grams} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in grams for j in range(i, i + n)}
        assert (d in clean) == (not hit or 20 * len(hit) < len(w))
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in coded.values()) and SuffixAutomaton([]).scan([b"x"]) == ([], set(), 0)


def test_stages_take_odd_rows(spark):
    import corpus_pipeline as P

    rows = [(1, None, "en", "s", 0), (None, "a b c", None, None, None), (3, "", "en", "s", 0), (3, "", "en", "s", 0), (4, "x " * 9000, "en", "s", 18000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "doc_id AS score", "'p' AS predicted", "1 AS n_lines", "2 AS fp", "3 AS n_hit", "4 AS n_tokens", "5 AS ids")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= len(rows) and stage(spark, docs.where("false"), SF).count() == 0
        assert {(r.score, r.fp) for r in out.collect()} <= {(1, 2), (None, 2), (3, 2), (4, 2)}
    assert P.STAGES[-1][1](spark, docs, SF).where("round_trip").count() == len(rows)


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]
