"""The methods of the training-data operators: by plain Python, on edge cases, and from a folder that holds no sources."""

import base64
import math
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from veritill.llm import bpe, language, media, mixing, neardups, pages, quality, secrets, textops, toxicity, webp

SMALL = "/root/testdata/sf0.001"
ROOT = str(Path(__file__).resolve().parents[2])
CLASHES = "doc_id bigint, text string, source string, veritill_key int, row_key string, n_words string, `taken` int, component int, size int"


def test_links_survive_ids_that_several_texts_share(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(200))
    near = lambda k: text(k).rsplit(" ", 1)[0] + " other"
    data = [(1, text(0)), (1, text(1)), (5, near(0)), (6, near(1))]
    got = neardups.classify(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (5, 1, False), (6, 1, False)}


def test_links_against_all_pairs_with_random_ids(spark):
    r = random.Random(8)
    data = []
    for _ in range(70):
        if data and r.random() < 0.6:
            w = r.choice(data)[1].split(" ")
            for _ in range(r.choice([0, 1, 1, 2])):
                w[r.randrange(len(w))] = f"x{r.randrange(99)}"
        else:
            w = [f"w{r.randrange(300)}" for _ in range(r.choice([4, 60, 150]))]
        data.append((r.choice([None, *range(25)]), " ".join(w)))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)]) for w in (t.split(" ") for _, t in data)]
    group = list(range(len(data)))
    for _ in data:
        for a in range(len(data)):
            for b in range(len(data)):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    low = {g: min((k for (k, _), x in zip(data, group) if x == g and k is not None), default=None) for g in group}
    want = Counter((k, len(s), low[g]) for (k, _), s, g in zip(data, sets, group))
    got = neardups.classify(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == want


def test_large_bands_lose_no_link(spark, monkeypatch):
    """One large group of near copies, most of them linked with few others."""
    monkeypatch.setattr(neardups, "SMALL_BAND", 4)
    monkeypatch.setattr(neardups, "PIVOT_ROUNDS", 1)
    r = random.Random(3)
    base = [f"w{j}" for j in range(120)]
    data = []
    for k in range(60):
        w = list(base if k % 3 else data[-1][1].split(" ") if data else base)
        for _ in range(r.choice([1, 2, 3, 4])):
            w[r.randrange(len(w))] = f"y{k}z{r.randrange(9)}"
        data.append((k, " ".join(w)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split(" ") for _, t in data)]
    low = list(range(60))
    for _ in data:
        for a in range(60):
            for b in range(60):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    got = {x.doc_id: x.component_id for x in neardups.classify(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    assert got == dict(enumerate(low)) and 1 < len(set(low)) < 60


def test_frequent_lines_with_and_without_a_broadcast(spark):
    data = [(k, f"{' '.join(f'w{k}x{j}' for j in range(60))}\nshared footer line\nrare {k // 15}", "h" if k % 2 else None) for k in range(90)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    ways = [{(r.doc_id, r.removed_words, r.kept) for r in quality.judge(docs, broadcast_lines=n).collect()} for n in (0, 1_000_000)]
    assert ways[0] == ways[1] == {(k, 3, True) for k in range(90)}


def _mixtures():
    r = random.Random(5)
    data = [(r.choice([None, k, k, k]), " ".join(["w"] * r.choice([0, 1, 7, 30, 400])), r.choice(["a", "b", "b", "b", "c", None])) for k in range(200)]
    yield data + [data[0]] * 3
    yield [(1, "a", "x"), (2, "b", "y"), (3, "c", "z")]  # targets below a word
    yield [(1, "a", "x"), (2, "b c", "y"), (3, "d e f", "z"), (4, "", "w")]
    yield [(k, " ".join("w" * n), f"s{n}{k}") for k in range(6) for n in (1, 2, 3)]
    yield [(1, None, "x"), (2, "", None)]


@pytest.mark.parametrize("data", list(_mixtures()))
def test_mix_is_the_truncated_queue(spark, data):
    """Weighted fair queueing once more in plain Python, and as SQL."""
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    got = mixing._queue(docs, (3, 1, 2), 1.5, 2).join(mixing.sized(docs).select("row_key", "place", "source").distinct(), "row_key").collect()
    assert len(got) == len(data)
    goal = {x.source: (math.floor(x.target), x.source_size) for x in got}
    queue = []
    for source, (limit, total) in goal.items():
        rows = sorted(((x.place, -1 if x.doc_id is None else x.doc_id, x.size) for x in got if x.source == source))
        at = 0
        for k in range(2):
            for row, (place, doc, size) in enumerate(rows):
                cut = min(max(limit - at, 0), size)
                for words, end in ((cut, at + cut), (size - cut, at + size)):
                    if words and limit:
                        queue.append((end / limit, source or "~", row, place, doc, size, words))
                at += size
    budget, want = sum(limit for limit, _ in goal.values()), Counter()
    for _, source, _, place, doc, size, words in sorted(queue):
        want[(source, place, doc, size)] += min(words, budget)
        budget -= min(words, budget)
    have = Counter()
    for x in got:
        have[(x.source or "~", x.place, -1 if x.doc_id is None else x.doc_id, x.size)] += x.taken
        assert 0 <= x.taken <= 2 * x.size
    assert +have == +want and budget == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE tiny (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO tiny VALUES (?, ?, ?)", data)
    if len({d[0] for d in data}) == len(data):  # the SQL tells rows by their ids
        rows = con.execute(f"WITH {mixing.SQL_MIX.format(docs='tiny')} SELECT doc_id, size, source_size, target, taken FROM mixed ORDER BY doc_id").fetchall()
        assert rows == sorted((x.doc_id, x.size, x.source_size, x.target, x.taken) for x in got)
    sizes = {(None if d < 0 else d): 0 for _, _, d, _ in have}
    assert set(sizes) >= {x.doc_id for x in mixing.mixed(spark, docs, SMALL).collect()}


def test_secret_thresholds_keep_the_recall_of_every_shape():
    net = secrets.train()
    fresh = secrets.labelled_findings(2400, seed=91)
    p, y = secrets.probabilities(net, fresh), np.array([f[3] for f in fresh])
    shapes = np.array([secrets.shape(t[a:b]) for t, a, b, _ in fresh])
    for k in range(3):
        found = p >= net.thresholds[k]
        assert ((shapes == k) & (y == 1)).sum() > 100 and found[(shapes == k) & (y == 1)].mean() >= 0.95
        assert found[(shapes == k) & (y == 0)].mean() <= 0.03
    letters = "the key QhXwVzTkLpRbNcGdMfJs is here"
    part = 'token="abcdefgh12345678",x qZ8xW3vK9tR2mN7pL5sD4fG6hJ1' + "0123456789abcdef" * 2 + "Xy"
    spans = secrets.scan([letters, part], net)
    assert spans[0] == [(8, 3, 28)]
    whole = part.index("qZ8")
    assert (whole, 3, len(part)) in spans[1] and (2 in {k for _, k, _ in spans[1]}) and spans[1][0][1] == 0
    assert secrets.scan(["eine Donaudampfschifffahrt und die Unabhängigkeitserklärungen, see http://www.example.org/some/long/path.html"], net) == [[]]


def test_candidates_by_hand():
    text = "a" * 16 + " " + "b" * 40 + " " + "c" * 20
    assert secrets.candidates(text, []) == [(0, 16), (17, 57), (58, 78)]
    assert secrets.candidates(text, [(17, 2, 57), (60, 2, 70)]) == [(0, 16), (58, 78)]
    assert secrets.candidates(text, [(0, 0, 30), (17, 2, 40), (20, 2, 57)]) == [(17, 57), (58, 78)]


def test_raw_elements_without_an_end_hide_nothing():
    net = pages.train()
    article = "<article><h1>Some fine title here</h1><p>This is the first paragraph of the article, long enough to be read.</p><p>And here follows the second, which says more about it all.</p></article>"
    for tag in ("script", "style", "template", "iframe", "textarea", "title", "select", "svg", "math", "object", "canvas", "audio", "video", "noscript"):
        ((found, p),) = pages.label([f"<html><body><header><{tag}></header>{article}<footer>All rights reserved</footer></body></html>"], net)
        assert [b.text for b, x in zip(found, p) if x >= 0.5] == ["Some fine title here", "This is the first paragraph of the article, long enough to be read.", "And here follows the second, which says more about it all."]
    ((found, p),) = pages.label([article.replace("read.", "read: <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.") + "<select><option>One</option><option>Two</option></select>"], net)
    assert found[1].text.endswith("read: x=2 holds.") and p[1] >= 0.5 and [b.text for b, x in zip(found, p) if x < 0.5] == ["One", "Two"]


def test_webp_reads_a_foreign_file():
    """The one-pixel lossless image that browsers are commonly probed with."""
    image, end = webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert image.shape == (1, 1) and end == 34


@pytest.mark.parametrize("mode", range(14))
def test_webp_inverts_every_tool(mode):
    r = np.random.default_rng(mode)
    argb = r.integers(0, 2**32, (9, 13), dtype=np.uint32)
    argb[3:6] = argb[2]
    blocks = r.integers(0, 2**32, (3, 4), dtype=np.uint32)
    for tools in ({"predictor": (2, np.full((3, 4), mode))}, {"cross": (2, blocks)}, {"predictor": (2, r.integers(0, 14, (3, 4))), "cross": (2, blocks), "subtract_green": True}):
        for coding in ({}, {"references": True}, {"cache_bits": 3}, {"references": True, "cache_bits": 5, "groups": (2, r.integers(0, 3, (3, 4)))}):
            assert (webp.decode(webp.encode(argb, **tools, **coding))[0] == argb).all()
    few = argb.reshape(-1)[r.integers(0, 3 + mode, (9, 13))]
    assert (webp.decode(webp.encode(few, palette=True, references=True))[0] == few).all()
    assert (webp.decode(webp.encode_smallest(argb))[0] == argb).all()


def test_webp_picks_its_tools_per_image(monkeypatch):
    r = np.random.default_rng(4)
    line = r.integers(32, 120, 97, dtype=np.uint8)
    slope = ((np.add.outer(3 * np.arange(30), 5 * np.arange(576)) + r.integers(0, 3, (30, 576))) % 256).astype(np.uint8)
    used = Counter()
    for name in ("_apply_predictor",):
        own = getattr(webp, name)
        monkeypatch.setattr(webp, name, lambda *a, _own=own, _name=name: (used.update([_name]), _own(*a))[1])
    for samples, tool in ((np.resize(line, (4, 576)), None), (slope, "_apply_predictor"), (r.integers(0, 256, (5, 576), dtype=np.uint8), None), (np.full((3, 576), 255, np.uint8), None)):
        used.clear()
        data = webp.encode_samples(samples)
        image, _ = webp.decode(data)
        assert (((image >> 8) & 255) == samples).all() and (tool is None) == (not used)
        with monkeypatch.context() as m:  # the reader that goes symbol by symbol agrees
            m.setattr(webp, "_green_pixels", lambda *a: None)
            assert (webp.decode(data)[0] == image).all()
    assert len(webp.encode_samples(np.resize(line, (40, 576)))) < 400  # references
    assert len(webp.encode_samples(slope)) < 0.5 * slope.size


def test_webp_stretches_join(monkeypatch):
    monkeypatch.setattr(webp, "STRETCH", 64)
    words = random.Random(2)
    text = " ".join(words.choice(["the", "cat", "sat", "on", "a", "mat", "zebra", "quietly"]) for _ in range(4000)).encode()
    data = media.padded(text)
    assert b"".join(((x >> 8) & 255).astype(np.uint8).tobytes() for x in media.from_media(media.to_media(data))) == data


def test_toxicity_scores_against_plain_python():
    r = random.Random(6)
    texts = [" ".join(r.choice(["fine", "Dull,", "awful!", "...", "grim", "héro", "x", "--y--"]) for _ in range(r.randint(0, 12))).encode() for _ in range(60)] + [b"", b" \n "]
    model = toxicity.Model(np.random.default_rng(1).normal(0, 1, 1 << toxicity.BUCKET_BITS), -0.7)
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = toxicity.logits(model, toxicity.Words(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), lower=True))

    def bucket(gram):
        x = np.frombuffer(gram, np.uint8)
        return int(textops.span_hashes(x, np.array([0]), np.array([len(x)]))[0] >> np.uint64(64 - toxicity.BUCKET_BITS))

    def word(w):
        bare = re.sub(rb"^[^a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff]+$", b"", w) or w
        framed = b"\x01" + bare + b"\x01"
        grams = [framed] + [framed[i : i + k] for k in (3, 4, 5) for i in range(len(framed) - k + 1)]
        return sum(model.table[bucket(g)] for g in grams) / len(grams)

    for t, z in zip(texts, got):
        own = [word(w) for w in t.lower().split()]
        windows = [own[i : i + 3] for i in range(max(1, len(own) - 2))] if own else []
        want = model.bias + max((sum(w) / len(w) for w in windows), default=0.0)
        assert z == pytest.approx(want, abs=1e-9)


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.op9_toxicity(spark, folder).filter("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    toxic, clean = ([r.score for r in got if r.toxic == t] for t in (1, 0))
    above = sum(a > b for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert above >= 0.9 and sum(x >= 0.5 for x in clean) <= 0.02 * len(clean)


def test_code_lengths_against_a_plain_walk():
    r = random.Random(4)
    kinds = {"aa": "the cat sat on the mat and éa ", "bb": "le chat est assis sûr ", "cc": "xyzzy"}
    texts = [(lang, "".join(r.choices(w, k=r.randint(1, 120))).encode()) for lang, w in kinds.items() for _ in range(6)] + [("aa", b""), ("bb", "Ünder".encode())]
    model = language.train(texts)
    counts = {n: defaultdict(Counter) for n in model.names}
    seq = lambda t: [256, *language.lowered(np.frombuffer(t, np.uint8)).tolist()]
    for lang, t in texts:
        s = seq(t)
        for i in range(1, len(s)):
            for d in range(min(4, i) + 1):
                counts[lang][tuple(s[i - d : i])][s[i]] += 1

    def cost(c, x, b):
        while x and x not in c:
            x = x[1:]
        n = c[x]
        total, many = sum(n.values()), len(n)
        if b in n:
            return -math.log2(n[b] / (total + many))
        return -math.log2(many / (total + many)) + (cost(c, x[1:], b) if x else 8.0)

    tests = [t for _, t in texts] + [b"zzz the chat", "q€ñ sat".encode(), b""]
    got = language.code_lengths(model, np.frombuffer(b"".join(tests), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tests])]))
    for t, row in zip(tests, got):
        s = seq(t)
        assert row == pytest.approx([sum(cost(counts[n], tuple(s[max(0, i - 4) : i]), s[i]) for i in range(1, len(s))) for n in model.names], rel=1e-5, abs=1e-4)


def test_tied_languages_go_by_name(spark):
    docs = spark.createDataFrame([(k, "same words here", lang) for k in range(1, 12) for lang in ("zz", "aa")], "doc_id bigint, text string, lang string")
    assert {(r.lang_pred, round(r.score, 6)) for r in language.identify(docs).collect()} == {("aa", 0.5)}


def test_stages_on_odd_rows(spark):
    long = " ".join(f"w{j}" for j in range(70))
    data = [(None, None, None), (1, "", "a"), (2, long, None), (2, long, None), (None, long + " z", "a"), (3, "short", "a"), (4, long.upper() + " q r s t u v w x", "b"), (5, 'password = "hunter2hunter2" ' + long[::-1], "b"), (6, "x " * 90_000 + long, "b")]
    docs = spark.createDataFrame([(*row, 1, "r", "n", 2, 3, 4) for row in data], CLASHES)
    for stage in (quality.keep_good, neardups.keep_one, secrets.mask_secrets, mixing.mixed):
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert {(r.veritill_key, r.row_key, r.n_words, r.taken, r.component, r.size) for r in out.collect()} == {(1, "r", "n", 2, 3, 4)}
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    assert bpe.tokens(spark, docs, SMALL).count() == len(data) and bpe.tokens(spark, docs.limit(0), SMALL).count() == 0
    good = quality.keep_good(spark, docs, SMALL)
    assert Counter(r.doc_id for r in good.collect()) == Counter([2, 2, None, 4, 5])
    assert Counter(r.doc_id for r in neardups.keep_one(spark, good, SMALL).collect()) in (Counter([2, 5]), Counter([2, 4, 5]))
    assert [r.text for r in secrets.mask_secrets(spark, docs.filter("doc_id = 5"), SMALL).collect()] == ['[SECRET]" ' + long[::-1]]
    mixed = mixing.mixed(spark, good, SMALL).collect()
    assert {r.doc_id for r in mixed} <= {2, None, 4, 5} and mixed


def test_pages_and_media_on_empty_tables_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "u", None, "x", 3), (1, "u", "<p>", "y", 4)], "page_id bigint, url string, html string, text string, n_chars int")
    assert sorted((r.page_id, r.text, r.n_chars) for r in pages.extract(rows).collect()) == [(1, "", 0), (1, "", 0)]
    assert pages.extract(rows.limit(0)).count() == 0 and pages.labelled_blocks(rows.limit(0)).count() == 0
    payloads = spark.createDataFrame([(1, b"abc", "m", 1), (2, None, "m", 1), (3, b"", "m", 1)], "id bigint, payload binary, media string, image int")
    stored = media.store(payloads, "id", "payload")
    back = {r.id: np.frombuffer(r.argb, "<u4") for r in media.pixels(stored, "id", "media").collect()}
    assert set(back) == {1, 3} and bytes(((back[1] >> 8) & 255).astype(np.uint8)) == media.padded(b"abc")
    assert media.store(payloads.limit(0), "id", "payload").count() == 0 and media.pixels(stored.limit(0), "id", "media").count() == 0


def test_scratch_tables_go(spark):
    df = spark.range(5)
    with textops.scratch():
        gone = textops.stored(df)
        with textops.scratch():
            inner, kept = textops.stored(df), textops.stored(df, lasting=True)
            path = textops._paths[kept].removeprefix("file://")
        assert inner not in textops._paths and Path(path).exists() and kept.count() == 5
    assert gone not in textops._paths and not Path(path).exists()
    lasting = textops.stored(df)
    assert lasting.count() == 5
    textops.release(lasting)


def test_local_folders_are_refused_on_a_cluster():
    class Away:
        class conf:  # noqa: N801
            @staticmethod
            def get(name, default):
                return default

        class sparkContext:  # noqa: N801
            master = "spark://there:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        textops.checkpoint_dir(Away())


FROM_ELSEWHERE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from veritill.llm import {module} as m
docs = spark.createDataFrame([(k, "some words that make a text " * 3, "en", "s") for k in range(1, 9)], "doc_id bigint, text string, lang string, source string")
labels = spark.createDataFrame([(k, k % 2) for k in range(1, 9)], "doc_id bigint, toxic int")
print("ROWS", {call}.count())
"""


@pytest.mark.parametrize("module,call", [("neardups", "m.classify(docs)"), ("secrets", "m.find(docs)"), ("toxicity", "m.detect(docs, labels)"), ("bpe", "m.digests(docs)")])
def test_calls_from_another_folder(tmp_path, module, call):
    done = subprocess.run([sys.executable, "-c", FROM_ELSEWHERE.format(root=ROOT, module=module, call=call)], cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "ROWS 8" in done.stdout, done.stderr[-3000:]


def test_a_large_group_of_near_copies(spark):
    """A group of near copies whose pivot has many pairs, beside exact copies and other texts."""
    r = random.Random(12)
    base = [f"w{k}" for k in range(120)]
    data = [(0, " ".join(base))]
    for k in range(1, 90):
        words = list(base)
        for _ in range(k % 3):
            words[r.randrange(120)] = f"x{k}"
        data.append((k, " ".join(words)))
    data += [(200 + k, " ".join(f"y{k}_{i}" for i in range(40))) for k in range(30)]
    shingles = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in data}
    low = {k: k for k, _ in data}
    for _ in range(4):
        for a in low:
            for b in low:
                if 100 * len(shingles[a] & shingles[b]) >= 85 * len(shingles[a] | shingles[b]):
                    low[a] = low[b] = min(low[a], low[b])
    got = neardups.classify(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == low
