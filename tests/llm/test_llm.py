"""The training-data operators: brute force, round trips, held-out accuracy and edge cases."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import connect, rows, same

from veritill.llm import bpe, language, media, mixing, neardups, pages, quality, queries, scoring, secrets, toxicity, webp

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [(1, None, None, None), (2, "", "en", "s1"), (3, " \n\t ", "en", "s1"), (4, "one two", "en", "s1"), (4, "one two", "en", "s1"), (None, "no id here", None, "s2"), (5, "a " * 60_000, "en", "s1"), (6, "é€😀 ü", "fr", None), (7, "tail line\x00nul", "de", "s2")]


@pytest.fixture(scope="module")
def edges(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(EDGES, "doc_id bigint, text string, lang string, source string").withColumns({"n": F.lit(1), "size": F.lit("clash"), "row": F.lit(0), "component": F.lit("x"), "score": F.lit(None).cast("string")})


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def corpus(seed=4, n=60):
    """Texts with copies, near copies and repeats."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        if out and r.random() < 0.5:
            w = r.choice(out)[1].split(" ")
            for _ in range(r.choice([0, 0, 1, 2, 12])):
                w[r.randrange(len(w))] = f"x{r.randrange(99)}"
        else:
            w = [f"w{r.randrange(300)}" for _ in range(r.choice([1, 3, 5, 40, 120]))]
        out.append((k, " ".join(w)))
    return out


@pytest.mark.parametrize("name", ["op3_quality_rules", "op4_mixing"])
def test_query_equals_sql(spark, name):
    same(spark, SMALL, queries.QUERIES[name], queries.SQL[name])


def test_near_duplicates_against_all_pairs(spark):
    data = corpus(n=80) + [(100, None), (101, ""), (102, "w1 w2")]
    sets = {k: set() for k, _ in data}
    for k, t in data:
        w = WORD.findall(lower(t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    low = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    got = neardups.classify(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {k: (len(sets[k]), low[k], low[k] == k) for k in sets}


def test_prefix_pairs_lose_no_pair(spark):
    r = random.Random(9)
    base = list(range(40))
    sets = {k: sorted({x if r.random() > 0.06 else 1000 + r.randrange(400) for x in base}) for k in range(40)}
    s = spark.createDataFrame(list(sets.items()), "doc_id bigint, shingles array<bigint>")
    c = spark.createDataFrame([(k, k, k % 7) for k in sets], "doc_id bigint, component bigint, low bigint")
    found = {(x.a, x.b) for x in neardups._prefix_pairs(c, s, 85).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(set(sets[a]) & set(sets[b])) >= 85 * len(set(sets[a]) | set(sets[b]))}
    assert want <= found and want


def test_odd_sketch_estimates_differences():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**63, 2000).astype(np.uint64))
    b = np.concatenate([a[60:], np.unique(r.integers(0, 2**63, 60).astype(np.uint64))])
    far = np.unique(r.integers(0, 2**63, 2000).astype(np.uint64))
    flips = lambda x, y: sum(int(v).bit_count() for v in neardups.odd_sketch(neardups.samples(x)) ^ neardups.odd_sketch(neardups.samples(y)))
    assert flips(a, a) == 0 and 0 < flips(a, b) <= neardups.most_flips() < flips(a, far)


def test_suffix_tree_scores_against_brute_force(spark):
    data = [(k, t) for k, t in corpus(7, 40)] + [(500, None), (501, "")]
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in data}
    tok = {k: WORD.findall(lower(t or "")) for k, t in data}
    c = Counter(w for k in tok if not held[k] for w in [*tok[k], None])
    total, kinds = sum(c.values()), len(c)
    seq = {k: [256, *" ".join(w).encode(), 257] for k, w in tok.items()}
    counts = defaultdict(Counter)
    for k, s in seq.items():
        for t in range(1, len(s) if not held[k] else 0):
            for d in range(min(5, t) + 1):
                counts[tuple(s[t - d : t])][s[t]] += 1
    keep = {()}
    for x, n in counts.items():
        size = sum(n.values())
        if x and size >= 6:
            up = counts[x[1:]]
            if sum(v * math.log(v * sum(up.values()) / (size * up[s])) for s, v in n.items()) >= 2 * math.log(size):
                keep |= {x[j:] for j in range(len(x))}

    def p(x, s):
        up = p(x[1:], s) if x else 1 / 257
        return (counts[x][s] + len(counts[x]) * up) / (sum(counts[x].values()) + len(counts[x]))

    want = {}
    for k, s in seq.items():
        score = 0.0
        for t in range(1, len(s)):
            x = tuple(s[max(0, t - 5) : t])
            while x not in keep:
                x = x[1:]
            score += math.log10(p(x, s[t]))
        want[k] = (score, sum(math.log10((c[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in [*tok[k], None]))
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    for extra in ({}, {"most_cells": 0, "heavy": 0.01}):  # tables, and joins
        for r in scoring.score(docs, least=6, **extra).collect():
            assert (r.score, r.base_score) == (pytest.approx(want[r.doc_id][0], rel=1e-12), pytest.approx(want[r.doc_id][1], rel=1e-9))
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tok[r.doc_id]) + 1, sum(c[w] > 0 for w in [*tok[r.doc_id], None]), total, held[r.doc_id])


def test_a_tree_beyond_the_bound_scores_by_slices_without_joins(spark, monkeypatch):
    """Copies, texts of symbols that no training text has, and rows that begin alike or follow each other."""
    data = corpus(11, 60) + [(500, None), (501, ""), (502, "\u3042 w1 \u3042\u3042"), (503, "w1"), (504, "w1"), (505, "1w 1w")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    rows = docs.selectExpr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 10 = 0, false) as held_out", "text")
    nodes, entries = scoring.suffix_tree(scoring.statistics(rows).filter("kind = 1").select("key", "n"), least=6)
    alphabet = 2 + entries.selectExpr("key & 511").distinct().count()
    cells = nodes.count() * alphabet
    most = cells // 3
    parts = scoring.slices_of_tree(nodes, entries, alphabet, most, 10**6)
    tables = [scoring._slice(nodes, entries, parts, k) for k in range(len(parts))]
    assert len(parts) > 2 and all(len(t.logs) <= most for t in tables)
    few = scoring.slices_of_tree(nodes, entries, alphabet, 10**9, entries.count() - 1)  # the number of entries alone asks for slices
    assert len(few) > 1
    want = {r.doc_id: r for r in scoring.score(docs, least=6).collect()}

    def joined(*_):
        raise AssertionError("joins store every n-gram of every document")

    monkeypatch.setattr(scoring, "joined_scores", joined)
    got = scoring.score(docs.repartition(5), least=6, most_cells=most).collect()
    assert len(got) == len(data)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id].score, rel=1e-12) and r.base_score == pytest.approx(want[r.doc_id].base_score, rel=1e-12)
    assert len({r.score for r in got if r.doc_id in (503, 504)}) == 1


def test_a_tree_of_large_counts(spark):
    """Products of counts that a large table reaches are beyond 64 bits."""
    docs = spark.createDataFrame(corpus(7, 40), "doc_id bigint, text string").selectExpr("false as held_out", "text")
    grams = scoring.statistics(docs).filter("kind = 1").selectExpr("key", "n * 1000000000 as n")
    nodes, entries = scoring.suffix_tree(grams)
    assert nodes.count() > 1 and entries.agg({"n": "max"}).first()[0] > 2**39


def test_mixing_meets_targets_and_bounds(spark):
    got = mixing.op4_mixing(spark, SMALL).collect()
    by = defaultdict(lambda: [0, 0.0])
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by[(r.source_size, r.target)][0] += r.taken
    assert all(abs(taken - target) <= 1 for (_, target), (taken, _) in by.items())
    assert sum(t for _, t in by) == pytest.approx(1.5 * sum(r.size for r in got))


def test_secrets_against_plain_patterns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    net = secrets.train()
    got = secrets.find(docs, net).collect()
    for r in got:
        t, spans = texts[r.doc_id], []
        for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
            spans += [(m.start(), 0, m.end())] if len(m[2]) >= 8 else []
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        names = ("assign", "access", "hex")
        text = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= set(r.spans.split(",")) | {""}


def test_secret_network_tells_held_out_findings():
    net = secrets.train()
    fresh = secrets.labelled_findings(600, seed=77)
    x, inside = secrets.encode([secrets.windows(t, a, b)[0] for t, a, b, _ in fresh])
    p, y = net.probabilities(net.logits(x, inside)), np.array([f[3] for f in fresh])
    limit = np.array([net.thresholds[secrets.shape(t[a:b])] for t, a, b, _ in fresh])
    assert ((p >= limit) & (y == 1)).sum() >= 0.9 * y.sum() and ((p >= limit) & (y == 0)).sum() <= 0.05 * (y == 0).sum()


def test_bpe_equals_tiktoken(spark, edges):
    import public_tokenizers
    import tiktoken

    tokens = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens) if t}, special_tokens={})
    own = bpe.Encoder(tokens, public_tokenizers.PATTERN)
    r = random.Random(3)
    texts = ["", "hello  world", "ab" * 5000, "".join(r.choice("aé漢😀 \n0") for _ in range(3000)), "<|endoftext|>"] + [t for _, t, _, _ in EDGES if t]
    for t in texts:
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(t) and own.decode(ids) == t.encode()
    assert sorted((r.doc_id, len(r.ids)) for r in bpe.encode(edges.filter("doc_id < 4")).collect()) == [(1, 0), (2, 0), (3, len(encoding.encode_ordinary(" \n\t ")))]


def test_pages_of_unseen_layouts():
    net, r, right, every = pages.train(), random.Random(1234), 0, 0
    made = [pages.sample_page(r) for _ in range(80)]
    for (_, labels), (own, p) in zip(made, pages.label([h for h, _ in made], net), strict=True):
        assert len(own) == len(labels)
        right += int(((p >= 0.5) == np.array(labels)).sum())
        every += len(labels)
    assert right >= 0.99 * every


def test_pages_of_the_table_and_odd_markup(spark):
    net = pages.train()
    odd = [(1, None), (2, ""), (3, "<p"), (4, "no markup at all &amp; more"), (5, "<div>" * 3000 + "deep"), (6, '<a title="x>y">z</a></div><script>if (a<b) "</p>"</script><!-- <p>no</p>'), (1, None)]
    got = pages.extract(spark.createDataFrame([(k, "u", h, 5) for k, h in odd], "page_id bigint, url string, html string, n_chars int"), net).collect()
    assert len(got) == len(odd) and all(r.text == "" for r in got if r.page_id in (1, 2, 3))
    table = spark.read.parquet(f"{SMALL}/pages.parquet")
    html = {r.page_id: r.html for r in table.select("page_id", "html").collect()}
    from html import unescape

    for r in pages.extract(table, net).collect():
        body = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        parts = [" ".join(unescape(re.sub(r"</?b>", "", s).replace("<br>", " ")).split()) for s in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(s for s in parts if s) and r.n_chars == len(r.text)


def test_webp_round_trips(spark, edges):
    r = np.random.default_rng(5)
    for shape in ((1, 1), (3, 576), (40, 17)):
        for samples in (r.integers(0, 256, shape, dtype=np.uint8), np.full(shape, 7, np.uint8), (np.add.outer(np.arange(shape[0]), np.arange(shape[1])) % 256).astype(np.uint8)):
            image, end = webp.decode(data := webp.encode_samples(samples))
            assert end == len(data) and data[:4] == b"RIFF" and data[8:12] == b"WEBP"
            assert (((image >> 8) & 255) == samples).all()
    out = edges.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(media._round_trip, media.RESULT).collect()
    for x in out:
        text = next(t for k, t, _, _ in EDGES if k == x.doc_id)
        data = media.padded((text or "").encode())
        assert (x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))


def test_toxicity_learns_words_and_their_misspellings():
    r = random.Random(2)
    plain = ["".join(r.choices("aeioutnrsl", k=r.randint(3, 8))) for _ in range(400)]
    bad = ["horribleness", "despicableness", "contemptible"]
    texts, toxic = [], []
    for k in range(240):
        w = r.choices(plain, k=r.randint(30, 200))
        if k % 3 == 0:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(bad))
        texts.append(" ".join(w).encode())
        toxic.append(int(k % 3 == 0))
    model = toxicity.train(texts, np.array(toxic), 1 / 3)

    def score(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return toxicity.logits(model, toxicity.Words(data, np.array([0, len(data)]), lower=True))[0]

    clean = " ".join(r.choices(plain, k=80))
    assert score(clean) < 0 < score(clean + " Horribleness! such " + clean)
    assert score(clean + " horriblenes contemptibel " + clean) > score(clean)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_edges_don_t_crash(spark, edges):
    labels = spark.createDataFrame([(k, 1, k % 2, "x") for k in range(2, 8)], "doc_id bigint, quality int, toxic int, text string")
    n = len(EDGES)
    assert neardups.classify(edges).count() == n
    q = {(r.doc_id, r.n_words): r for r in quality.judge(edges).collect()}
    assert q[(1, 0)].base_failed and not q[(1, 0)].kept and q[(5, 60_000)].n_repeat_words == 60_000
    s = scoring.score(edges).collect()
    assert len(s) == n and {r.n_tokens for r in s if r.doc_id in (1, 2, 3)} == {1}
    m = mixing.mix(edges).collect()
    assert len(m) == n and {r.size for r in m if r.doc_id in (1, 2, 3)} == {0}
    assert secrets.find(edges).count() == n and bpe.digests(edges).count() == n
    t = toxicity.detect(edges, labels).collect()
    assert len(t) == n and all(0 <= r.score <= 1 for r in t)
    g = {r.doc_id: r.lang_pred for r in language.identify(edges).collect()}
    assert g[1] == g[2] == g[3] == "und" and g[4] != "und"


def test_quality_finds_every_line_of_a_shared_footer(spark):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    footer = "All rights reserved\nTerms and conditions\nPrivacy notice here\nContact us now"
    data = [(k, f"{words(k)}\n{footer}", "h") for k in range(30)]
    data += [(100 + k, f"{words(99).upper() if k % 2 else words(99)}\nown line", "h") for k in range(40)]  # copies
    got = quality.judge(spark.createDataFrame(data, "doc_id bigint, text string, source string")).collect()
    assert {(r.doc_id < 100, r.removed_words, r.kept) for r in got} == {(True, 12, True), (False, 0, True)}


def test_stages_keep_rows_without_id_or_with_a_shared_one(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(60 + k))
    near = text(1).rsplit(" ", 1)[0]
    data = [(None, text(0), "a"), (None, text(1), "a"), (None, near, "a"), (None, text(1), "a"), (1, text(2), "a"), (1, text(3), "b"), (1, "too short", "b"), (2, text(4), "b"), (3, text(4), "b"), (None, text(4), None)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string").coalesce(1)
    key = lambda rows: sorted(((r.doc_id, r.text, r.source) for r in rows), key=repr)
    good = quality.keep_good(spark, docs, SMALL)
    assert key(good.collect()) == sorted((x for x in data if x[1] != "too short"), key=repr)
    one = key(neardups.keep_one(spark, good, SMALL).collect())
    assert len(one) == 5 and {x for x in one if x[1] not in (text(1), near)} == {(None, text(0), "a"), (1, text(2), "a"), (1, text(3), "b"), (2, text(4), "b")}
    queue = mixing._queue(good, (1,), 2.0, 2)
    assert all(r.taken == 2 * r.size for r in queue.collect())
    taken = Counter()
    for r in mixing._queue(good, mixing.WEIGHTS, mixing.SHARE, mixing.MOST_PASSES).collect():
        taken[(r.doc_id, r.size)] += (2 * r.taken + r.size) // (2 * r.size)
    mixed = mixing.mixed(spark, good, SMALL).collect()
    assert Counter((r.doc_id, len(r.text.split())) for r in mixed) == Counter({k: n for k, n in taken.items() if n})
    assert {r.text for r in mixed if r.doc_id is None} and {text(2), text(3)} <= {r.text for r in mixed}


def test_empty_tables(spark, edges):
    none = edges.limit(0)
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    for df in (neardups.classify(none), quality.judge(none), scoring.score(none), mixing.mix(none), secrets.find(none), bpe.digests(none), toxicity.detect(none, labels), language.identify(none)):
        assert df.count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage once more by DuckDB, plain Python and the public tokenizer."""
    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    con = connect(SMALL)
    con.execute(f"CREATE TABLE good AS WITH {quality.SQL_STATS.format(docs='documents')} SELECT d.* FROM documents d JOIN stats USING (doc_id) WHERE NOT base_failed AND NOT (n_words - removed_words < 0.3 * n_words)")
    con.execute(f"CREATE TABLE single AS WITH RECURSIVE {neardups.SQL_LINKS.format(docs='good')} SELECT g.* FROM good g JOIN near USING (doc_id) WHERE g.doc_id = near.component_id")
    net, data = secrets.train(), con.execute("SELECT doc_id, source, text FROM single").fetchall()
    clean = [(k, s, secrets.masked(t, secrets.scan([t], net)[0])) for k, s, t in data]
    con.execute("CREATE TABLE clean (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO clean VALUES (?, ?, ?)", clean)
    taken = con.execute(f"WITH {mixing.SQL_MIX.format(docs='clean')} SELECT doc_id, size, taken FROM mixed").fetchall()
    copies = {k: (2 * t + n) // (2 * n) if n else 0 for k, n, t in taken}
    ranks = {t: k for k, t in enumerate(bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))) if t}
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for k, _, t in clean:
        ids = np.array(encoding.encode_ordinary(t), "<u4").tobytes()
        want += [(k, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] * copies[k]
    got = corpus_pipeline.run(spark, SMALL)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert rows(names, got.select(*names).collect()) == rows(names, want)
