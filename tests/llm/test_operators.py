import json
import math
import os
import re
import time
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from html import unescape
from math import comb

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import same, texts
from weftgraph import storage
from weftgraph.llm import binary, compaction, decontam, html, lm, merkle, neardup, packing, quality, shingles, tokens, urlfilter

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, low=True):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER) if low else text or "")


def ids_of(text, end):
    return tokens.encoder(tokens.tokenizer_path()).tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# tokens


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abcXYZ019 .,'!-\n\t  éñ漢  \x1c🙂")), max_size=40), max_size=4))
def test_word_cache_is_exact(some):
    enc = tokens.encoder(tokens.tokenizer_path())
    assert enc.ids(some) == [b if t else b"" for t, b in zip(some, enc.whole(some))]


def test_word_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    monkeypatch.setattr(tokens, "TOGETHER", 200)
    enc = tokens.Encoder(tokens.tokenizer_path())
    some = [t or "" for t in texts()[0]]
    assert enc.ids(some) == [b if t else b"" for t, b in zip(some, enc.whole(some))]


def test_words_are_held_without_stops():
    """op1_pack: a word was learnt again for each stop after it."""
    enc = tokens.Encoder(tokens.tokenizer_path())
    stops = [*tokens.STOPS, "...", "?!", ").", "%%%", "'", ",'", "','"]
    some = [" ".join(f"{w}{x}" for x in ["", *stops] for w in ("Wort", "déjà", "漢字")) + "\nWort, and\ndéjà!\nWort"] + [w + x for w in ("Wort", "first", "x1", "don't", "(") for x in stops]
    assert enc.ids(some) == enc.whole(some)
    held = tokens.listed(enc.words)
    assert len(held) == len(set(held)) and {w for w in held if w.startswith("Wort")} == {"Wort", "Wort'", "Wort,'", "Wort','"}


def test_token_files(spark, docs, rows, none):
    folder = storage.new_path(spark, "t")
    got = binary.read_token_files(binary.write_token_files(docs, folder, tokens.tokenizer_path()), folder).collect()
    want, start = [], 0
    ties = {r["text"]: r["tie"] for r in docs.select("text", F.xxhash64("text").alias("tie")).collect()}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1]])):
        ids = ids_of(text, 2)
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert same(got, want)
    folder = storage.new_path(spark, "t")
    assert binary.read_token_files(binary.write_token_files(none, folder, tokens.tokenizer_path()), folder).count() == 0


def test_token_files_of_one_id(spark):
    """Rows under one id, or none, are cut into several parts, and the files are read by several tasks."""
    rows = [(7 if i % 2 else None, f"word{i} and more") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = storage.new_path(spark, "t").removeprefix("file://")  # a path without a scheme
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = binary.write_token_files(docs, folder, tokens.tokenizer_path())
        assert manifest.count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = binary.read_token_files(manifest, folder)
    assert read.rdd.getNumPartitions() == 4
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in read.collect()) == Counter((d, crc(ids_of(t, 2))) for d, t in rows)


# packing


def unpacked(pieces, window):
    sequences, held = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        held[p["doc_id"]].append((p["start"], np.frombuffer(p["ids"], "<u4").tolist(), p["doc_tokens"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at and n > 0
            at += n
        assert at == window or at < window and at & at - 1 == 0
    return held


@pytest.mark.parametrize("shard_docs", [5, 1000])
def test_packing(docs, rows, none, shard_docs):
    pieces = packing.pack(docs, tokens.tokenizer_path(), 128, shard_docs=shard_docs).collect()
    assert all(p["ids_crc32"] == zlib.crc32(p["ids"]) and p["length"] * 4 == len(p["ids"]) for p in pieces)
    held = unpacked(pieces, 128)
    for doc in {d for d, _ in rows} - {None, 3}:
        ids = [x for _, part, _ in sorted(held[doc]) for x in part]
        assert ids == ids_of(dict(rows)[doc], 0) and all(n == len(ids) for *_, n in held[doc])
    assert sum(p["length"] for p in pieces) == sum(len(ids_of(t, 0)) for _, t in rows)
    assert packing.pack(none, tokens.tokenizer_path()).count() == 0


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_terms_counted_together(kind):
    """op1_pack: terms were counted a document at a time, at a fifth of its seconds."""
    rng = np.random.default_rng(1)
    docs = [rng.zipf(1.3, rng.integers(0, 90)).clip(0, 900).astype(kind) for _ in range(200)]
    ids = pa.array([b"before", *[d.tobytes() for d in docs]], pa.binary()).slice(1)
    doc, term, tf, lengths = packing.counted_terms(kind, ids, 7)
    plain = [Counter([*d.tolist(), 7]) for d in docs]
    assert list(zip(doc, term, tf)) == [(i, t, c[t]) for i, c in enumerate(plain) for t in sorted(c)]
    assert lengths.tolist() == [len(d) + 1 for d in docs]
    stats = packing.Statistics(len(docs), int(lengths.sum()), np.bincount(term))
    one, two = stats.first_terms(doc, term, tf, lengths)
    for i, c in enumerate(plain):
        weight = lambda t: stats.idf[t] * c[t] * np.float32(packing.K1 + 1) / (c[t] + stats.norm(lengths[i]))  # noqa: E731, B023
        best = sorted((-weight(t), t) for t in c if stats.df[t] > 1)[:2]
        assert [one[i], two[i]] == [*[t for _, t in best], -1, -1][:2]


def test_packing_in_parts(docs, monkeypatch):
    monkeypatch.setattr(packing, "PART_IDS", 300)
    pieces = packing.pack(docs.coalesce(1), tokens.tokenizer_path(), 128, shard_docs=1000).collect()
    unpacked(pieces, 128)


def test_neighbours_follow_the_seed():
    rng = np.random.default_rng(0)
    docs = [np.concatenate([np.full(3, 1000 + i % 4), rng.integers(0, 500, 20)]).astype(np.uint32) for i in range(40)]
    index, unused = packing.Index(docs), np.ones(40, bool)
    unused[0] = False
    # BM25 by its definition, over the query's terms
    n, mean = 40, 23.0
    terms = index.terms(0)[: packing.QUERY_TERMS].tolist()
    df = {t: sum(t in d for d in docs) for t in terms}
    score = {j: sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (packing.K1 + 1) / (c + packing.K1 * (1 - packing.B + packing.B * len(docs[j]) / mean)) for t in terms for c in [int((docs[j] == t).sum())] if c) for j in range(1, 40)}
    want = sorted((j for j in score if score[j] > 0), key=lambda j: (-round(score[j], 4), j))
    got = index.neighbours(np.array(terms), unused, 5).tolist()
    assert [round(score[j], 3) for j in got] == [round(score[j], 3) for j in want[:5]]


def test_greedy_fill():
    """A shard's windows against a plain greedy fill that scores every document anew for each step."""
    rng = np.random.default_rng(3)
    docs = [rng.choice(80, rng.integers(3, 25)).astype(np.uint32) for _ in range(60)] + [np.arange(500, 560, dtype=np.uint32)]
    n, df, mean = len(docs), Counter(t for d in docs for t in set(d.tolist())), sum(map(len, docs)) / len(docs)
    weight = lambda t, d: (lambda c: np.float32(np.log1p((n - df[t] + 0.5) / (df[t] + 0.5))) * np.float32(c) * np.float32(packing.K1 + 1) / np.float32(c + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)))(int((d == t).sum()))
    order, unused, seed, fill = [], set(range(n)), None, 0
    while unused:
        doc = None
        if fill:
            terms = sorted((t for t in set(docs[seed].tolist()) if df[t] > 1), key=lambda t: (-round(float(weight(t, docs[seed])), 5), t))
            for lo in range(0, len(terms), packing.QUERY_TERMS):
                some = terms[lo : lo + packing.QUERY_TERMS]
                score = {j: sum(float(weight(t, docs[j])) for t in some) for j in unused if set(some) & set(docs[j].tolist())}
                if score:
                    doc = min(score, key=lambda j: (-round(score[j], 4), j))
                    break
        doc = min(unused) if doc is None else doc
        unused.discard(doc)
        order.append(doc)
        seed = doc if fill == 0 or fill + len(docs[doc]) >= 64 else seed
        fill = (fill + len(docs[doc])) % 64
    got = list(dict.fromkeys(p[0] for p in packing.pack_shard(docs, 64)))
    assert sum(a == b for a, b in zip(got, order)) > 0.9 * n and sorted(got) == sorted(order)


def test_shards_hold_related_documents(spark):
    """Windows are filled with documents of one topic, though shards are small, and weights are those of all documents."""
    rng = np.random.default_rng(1)
    topic = [f"zebra{chr(97 + i)} quartz{chr(97 + i)} violet{chr(97 + i)} " * 5 for i in range(10)]
    rows = [(i, topic[i % 10] + " ".join(rng.choice(["the", "of", "and", "to", "in", "is"], 12))) for i in range(200)]
    # two topics differ in a letter, so a document's rarest tokens may be shared; most neighbours are of the same topic
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tokens.tokenizer_path(), 256, shard_docs=20).collect()
    windows = defaultdict(set)
    for p in pieces:
        windows[p["sequence_id"]].add(p["doc_id"] % 10)
    assert np.mean([len(w) for w in windows.values()]) < 2
    docs = [np.array(x, np.uint32) for x in ([1, 2, 3], [1, 2], [1, 9])]
    whole, part = packing.Index(docs), packing.Index(docs[:2], packing.Statistics(3, 7, np.bincount(np.concatenate(docs))))
    assert np.allclose(part.weight, whole.weight[: len(part.weight)])


# quality rules


def measured(text):
    ws = words(text, low=False)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    twice = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if twice[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_features(docs, rows, none):
    got = quality.features(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert same(got, [(d, *measured(t)) for d, t in rows])
    assert quality.features(none).count() == 0


def test_binomial_tail(spark, monkeypatch):
    df = spark.createDataFrame([(k, n) for n in (1, 7, 40) for k in range(n + 1)], "k long, n long")
    for r in df.select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.3).alias("p")).collect():
        assert math.isclose(r["p"], sum(comb(r["n"], i) * 0.3**i * 0.7 ** (r["n"] - i) for i in range(r["k"] + 1)), rel_tol=1e-9)
    big = spark.createDataFrame([(90, 1_000_000)], "k long, n long").select(quality.binomial_tail(F.col("k"), F.col("n"), 0.0001)).first()[0]
    assert 0.1 < big < 0.2
    # beyond the terms that are summed the value errs upwards
    tail = lambda: spark.createDataFrame([(900, 1_000_000)], "k long, n long").select(quality.binomial_tail(F.col("k"), F.col("n"), 0.001)).first()[0]
    whole = tail()
    monkeypatch.setattr(quality, "TERMS", 20)
    assert whole < tail() < 3 * whole


def test_cutoffs_are_certified(spark):
    clean = [(i, " ".join(f"word{(i * 7 + j) % 97}" for j in range(60)), "en") for i in range(2000)]
    dirty = [(10_000 + i, "### " * 10 + " ".join(f"word{(i * 3 + j) % 97}" for j in range(60)), "en") for i in range(40)]
    few = [(20_000 + i, "### " * 10 + " ".join(f"mot{(i * 3 + j) % 97}" for j in range(60)), "fr") for i in range(20)]
    docs = spark.createDataFrame(clean + dirty + few, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in clean + few] + [(i, 0, 0) for i, *_ in dirty] + [(None, 1, 0), (0, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.judged(storage.materialize(quality.features(docs), "q"), labels).collect()}
    assert all(got[i] for i, *_ in clean) and not any(got[i] for i, *_ in dirty)
    assert all(got[i] for i, *_ in few)  # too few labels to certify a cutoff
    empty = quality.judged(storage.materialize(quality.features(docs), "q"), labels.limit(0))
    assert empty.where("NOT kept AND NOT base_failed").count() == 0


# decontamination


def decontaminated(text, items):
    ws = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER)) if w]
    hit, found = set(), set()
    for item, t in items:
        its = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER)) if w]
        for k in range(max(1, len(its) - 9)) if its else ():
            window = its[k : k + 10]
            for p in range(len(ws) - len(window) + 1):
                if ws[p : p + len(window)] == window:
                    hit |= set(range(p, p + len(window)))
                    found.add(str(item))
    return len(ws), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("bound", [1_000_000, 3])
def test_decontamination(spark, docs, rows, none, bound, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_SHINGLES", bound)
    base = [t for _, t in rows if t and len(t.split()) > 60]
    items = [(2, " ".join(base[0].split()[5:30])), (10, " ".join(base[1].split()[:12]).upper()), (11, "w1 w2"), (12, "One"), (13, None), (14, ""), (15, "?!"), (2, " ".join(base[0].split()[5:30])), (16, "never seen in any of these texts at all my friend"), (17, "x x x x x x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(docs, bench).drop("key").select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert same(got, [(d, *decontaminated(t, items)) for d, t in rows])
    clean = decontam.decontaminate(docs, bench.limit(0))
    assert clean.where("contaminated").count() == 0 and clean.count() == len(rows)
    assert decontam.decontaminate(none, bench).count() == 0


def test_items_without_id(spark, docs, tmp_path):
    text = next(r["text"] for r in docs.collect() if r["text"] and len(r["text"].split()) > 60)
    bench = spark.createDataFrame([(None, " ".join(text.split()[5:30]))], "item_id long, text string")
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = decontam.decontaminate(one, bench).first()
    assert (got["n_hit"], got["n_items"], got["items_sha256"], got["contaminated"]) == (25, 0, sha256(b"").hexdigest(), True)
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert decontam.decontaminate_stage(spark, one, str(tmp_path)).count() == 0


# near-duplicates


def shingle_set(text):
    ws = words(text)
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def components(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [(d, len(s), find(d) if d is not None else None, d is None or find(d) == d) for d, s in sets]


def deduplicated(rows):
    """What stays of rows: of each group the least id of one row alone, or any other document, once; rows without words."""
    alone = Counter(d for d, _ in rows)
    named = [(d, t) if d is not None and alone[d] == 1 else (1 << 62, t) for d, t in rows]
    nodes = sorted({(n, d, t) for (n, t), (d, _) in zip(named, rows) if shingle_set(t)}, key=lambda x: (x[0], x[1] is None, x[1] or 0, x[2]))
    group = components([(k, t) for k, (_, _, t) in enumerate(nodes)])
    return [(d, t) for (_, d, t), (k, _, c, _) in zip(nodes, group) if k == c] + [(d, t) for d, t in rows if not shingle_set(t)]


def test_dedup_stage_tells_texts_apart(spark):
    say = lambda k: " ".join(f"{k}x{i}" for i in range(60))
    rows = [(1, say("a")), (1, say("b")), (2, say("c")), (None, say("d")), (None, say("d")), (3, say("c")), (4, say("a")), (2, say("c")), (5, None), (5, None), (5, "")]
    got = neardup.dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    kept = Counter(map(tuple, got.collect()))
    assert kept == Counter([(4, say("a")), (1, say("b")), (3, say("c")), (None, say("d")), (5, None), (5, None), (5, "")])


def test_pairs_of_a_hub_in_groups(docs, rows, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", 2)
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 3)
    assert same(neardup.near_duplicates(docs).collect(), components(rows))


def test_near_duplicates(docs, rows, none):
    assert same(neardup.near_duplicates(docs).collect(), components(rows))
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_beyond_hubs(spark):
    """Chains of copies, each near the next alone, and a group around one original."""
    chain, ws = [], [f"c{i}" for i in range(200)]
    for i in range(12):
        chain.append(" ".join(ws))
        ws = ws[:]
        ws[(i * 16) % 200 : (i * 16) % 200 + 6] = [f"n{i}x{j}" for j in range(6)]
    origin = [f"o{i}" for i in range(120)]
    group = [" ".join(origin)]
    for i in range(25):
        w = origin[:]
        w[(i * 5) % 115] = f"z{i}"
        w[(i * 5 + 60) % 115] = f"y{i}"
        group.append(" ".join(w))
    rows = list(enumerate(chain + group[::-1]))
    assert same(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), components(rows))


def test_band_recall():
    """Pairs at the threshold meet in some table."""
    rng, met = np.random.default_rng(5), 0
    for _ in range(200):
        both = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        one, two = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, 50, dtype=np.uint64)])) for _ in range(2))
        a, b = neardup.bands(one), neardup.bands(two)
        same_bands = a == b
        met += bool(same_bands[: neardup.BANDS].any() and same_bands[neardup.BANDS :].any())
    assert met >= 199


# html


def test_pages():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="no-sidebar"><nav><ul><li><a href="/">Home</a></ul></nav>
    <div class="ad">Buy now</div><div id="cookie-notice">We use cookies, as everyone does, and a lot of them, really, believe us</div><article><h1>Title &amp; more</h1>
    <p><b>First   line&nbsp;here<br><p>Second <i>li</i>ne &lt;x&gt; &#233;</p><form><input>Your name</form><aside>See also</aside><div class="comments"><p>Nice post</p></div></article><footer>&copy; me</footer></body>"""
    assert html.main_text(page) == "Title & more\nFirst line here\nSecond line <x> é"
    body = "".join(f"<p>This is a long enough paragraph number {i} of the text itself, with words.</p>" for i in range(6))
    plain = f"<html><body><div><a href=x>a</a></div><div class=sidebar>s</div><div>{body}</div><div class='footer'>f</div></body></html>"
    assert html.main_text(plain).count("\n") == 6 - 1
    for odd in (None, "", "<", "<p", "<!-- x", "<script>alert(1)", "a < b & c &amp", "</p></p>", "<p>" * 3000, '<a title="' + "x" * 9000, "<p>" + "word " * 200_000):
        assert isinstance(html.main_text(odd), str)
    assert html.main_text("a < b &amp c") == "a < b & c"


def test_short_lines_beside_dropped_blocks():
    share = "<div class=share><p>Tweet</p><p>Post</p><p>Mail</p></div>"
    long = "This is a long enough paragraph of the text itself, with words. " * 3
    assert html.main_text(f"<body><div><h1>Title</h1></div>{share}<div><p>{long}</p></div>{share}<p>The end.</p></body>") == f"Title\n{long.strip()}\nThe end."


LONG = "This is a long enough paragraph of the text itself, with words. " * 3


def test_window_sums_decide(monkeypatch):
    """Blocks that no element or class marks are told from the text by their sums alone."""
    around = "<div><div><p>Buy one now</p></div></div>"
    pages = [f"<body><div>{around}</div><div><div><h1>Title</h1><p>{LONG}<p>Short.<p>{LONG}</div></div><div>{around}</div></body>", f"<body>{around}<article><h1>Title</h1><p>{LONG}<p>Short.<p>{LONG}</article>{around}</body>"]
    want = f"Title\n{LONG.strip()}\nShort.\n{LONG.strip()}"
    assert [html.main_text(p) for p in pages] == [want] * 2
    monkeypatch.setattr(html, "between", lambda w: [(0, len(w))])
    assert all("Buy one now" in html.main_text(p) for p in pages)


def test_surge_and_dive():
    assert html.between([0, 5, 0, 0, 0, 0, 9, 1, 0, 9, 0]) == [(1, 2), (6, 10)]
    assert html.between([0, 1, 0, 0, 0, 0, 9, 1, 0, 9, 0]) == [(6, 10)]
    assert html.between([]) == html.between([0, 0]) == []


def test_hard_markup():
    assert html.main_text(f'<div data-x="{"a" * 5000}> LEAK MARKUP text">inner</div>') == "inner"
    assert html.main_text("<article><p don't>One<p it's>Two</article>") == "One\nTwo"
    for name in ("banner-story", "ad-astra-essay", "comment-on-law"):
        assert html.main_text(f"<article><p>{LONG}</p><div class='{name}'>This stays</div></article>").endswith("\nThis stays")
    for name in ("ad", "ad-slot", "cookie-notice", "relatedPosts", "comments", "comment-list", "sidebar-left", "ad2"):
        assert html.main_text(f"<article><p>{LONG}</p><div class='{name}'>This goes</div></article>") == LONG.strip()
    assert html.main_text(f"<body><a href=/>Home</a><p>{LONG}</p><p>Related: <a href=x>Some other story of the day</a></p></body>") == LONG.strip()
    assert html.main_text(f"<head><title>T</title><body><p>{LONG}") == LONG.strip()
    assert html.main_text(f"<article><p>{LONG}</p><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><p>End</article>") == f"{LONG.strip()}\nOne\nTwo\nEnd"
    for deep in ("<div>" * 20_000 + "x" + "</span>" * 20_000, "<li><div>" + "<b>" * 20_000 + "<li></li>" * 20_000, "<b>" * 20_000 + "<p></p>" * 20_000, '<p x="' * 20_000, "<p x='\"" * 20_000 + "'"):
        began = time.process_time()
        html.main_text(deep)
        assert time.process_time() - began < 2


def test_all_pages(spark, monkeypatch):
    """Every page of the driver's table, whose article is known by its shape, by a plain version."""
    def plain(page):
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        cut = re.split(r"</?(?:p|h1|article)>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
        return "\n".join(x for x in (" ".join(unescape(c).split()) for c in cut) if x)

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    texts = {(r["page_id"], r["text"]) for r in html.extract(pages).collect()}
    rows = pages.collect()
    assert texts == {(r["page_id"], plain(r["html"])) for r in rows}
    # class names alone don't decide
    monkeypatch.setattr(html, "_marked", lambda attributes: False)
    assert all(html.main_text(r["html"]) == plain(r["html"]) for r in rows[::5])


def test_extract(spark):
    rows = [(1, "http://a", "<p>Hi there</p>"), (1, "http://a", "<p>Hi there</p>"), (None, None, None), (2, None, "")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert same(got, [(1, "http://a", "Hi there", 8)] * 2 + [(None, None, "", 0), (2, None, "", 0)])


# language model


def test_language_model(docs, rows, none):
    got = lm.language_scores(docs).collect()
    counts = Counter()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    for d, t in rows:
        if not held(d):
            counts.update([*words(t), "\n"])
    total, kinds = sum(counts.values()), len(counts)
    want = {}
    for d, t in rows:
        ts = [*words(t), "\n"]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ts)
        want.setdefault((d, len(ts)), (held(d), sum(w in counts for w in ts), base))
    assert len(got) == len(rows)
    for r in got:
        h, known, base = want[r["doc_id"], r["n_tokens"]]
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (h, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert lm.language_scores(none).count() == 0


def test_held_out_scores(spark):
    """The model beats the counts on texts it hasn't seen, and how rows are partitioned hardly matters."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    few, many = ({r["doc_id"]: r for r in lm.language_scores(documents.repartition(n)).collect() if r["held_out"]} for n in (2, 16))
    tokens = sum(r["n_tokens"] for r in few.values())
    for got in (few, many):
        assert sum(r["score"] - r["base_score"] for r in got.values()) > 0.2 * tokens
    assert sum(abs(r["score"] - many[d]["score"]) for d, r in few.items()) < 0.05 * tokens


def test_weights_of_many_tasks(spark, monkeypatch):
    """Tasks' weights are averaged in a tree of more than one level, and what comes out has learnt."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(9)
    monkeypatch.setattr(lm, "TASK", 10_000)
    monkeypatch.setattr(lm, "FAN", 2)
    got = [r for r in lm.language_scores(documents).collect() if r["held_out"]]
    assert sum(r["score"] - r["base_score"] for r in got) > 0.1 * sum(r["n_tokens"] for r in got)


def test_long_words_are_modelled(spark):
    """A frequent word over LONGEST bytes has a place in the vocabulary, by its digest."""
    long = "Ω" * lm.LONGEST
    documents = spark.createDataFrame([(i, f"a {long} b {long}") for i in range(40)], "doc_id long, text string")
    counts = lm.word_counts(documents).cache()
    voc = lm.vocabulary(counts)
    assert len(voc.words) == 4 and max(map(len, voc.words)) == 65
    ids, _, _, _ = voc.ids(pa.array([f"{long} zz"]))
    assert voc.counts[ids[0]] == 80 and ids[1] == len(voc.words)


def test_classes_of_the_first_words():
    """Every one of the first words is in one class, which are at most the root of their number, by Zipf's counts and by equal ones."""
    for counts in ([200_000 // (i + 1) for i in range(lm.DYNAMIC)], [3] * lm.DYNAMIC):
        voc = lm.Vocabulary([f"w{i}" for i in range(lm.DYNAMIC)], counts, sum(counts), lm.DYNAMIC)
        assert voc.ends[0] == 0 and voc.ends[-1] == lm.DYNAMIC and (np.diff(voc.ends) > 0).all()
        assert len(voc.ends) - 1 <= lm.DYNAMIC**0.5 + 1


def test_model_is_a_distribution_and_learns():
    words_ = [lm.END] + [f"w{i}" for i in range(60)]
    voc = lm.Vocabulary(words_, [100 - i for i in range(61)], 8000, 200)
    rng = np.random.default_rng(0)
    docs = []
    for _ in range(150):  # one of two halves of the words in each document
        half = rng.integers(0, 2)
        docs.append([f"w{x}" for x in rng.integers(half * 30, half * 30 + 30, 40)])
    ids, offsets, _, _ = voc.ids(pa.array([" ".join(d) for d in docs]))
    model = lm.Model(voc)
    before = model.score(ids, offsets).sum()
    for _ in range(6):
        lm.Trainer(model).run(ids, offsets)
    assert model.score(ids, offsets).sum() > before + 0.1 * len(ids)
    h = rng.normal(size=(1, lm.HIDDEN)).astype(np.float32)
    each = 10 ** np.array([model.log10(h, np.array([i]))[0] for i in range(len(words_) + 1)])
    assert math.isclose(each.sum(), 1, rel_tol=1e-4)
    # the state is carried: a document scored alone equals the same one among others
    one = model.score(ids[: offsets[1]], offsets[:2])[0]
    assert math.isclose(one, model.score(ids, offsets)[0], rel_tol=1e-5)


def test_gradients():
    voc = lm.Vocabulary([lm.END] + [f"w{i}" for i in range(50)], [60 - i for i in range(51)], 3000, 80)
    model = lm.Model(voc)
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 52, (4, 3)), rng.integers(0, 51, (4, 3))
    fresh = np.zeros((4, 3), bool)
    fresh[0] = fresh[2, 1] = True
    seen = {}
    trainer = lm.Trainer(model)
    trainer._adam = lambda name, grad, rows=slice(None): seen.update({name: (grad.copy(), rows)})

    def loss():
        h, total = np.zeros((3, lm.HIDDEN), np.float32), 0.0
        w = model.w
        for t in range(4):
            h = np.where(fresh[t][:, None], 0, h)
            xw = w["embed"][voc.input_of[x[t]]] @ w["wx"] + w["b"]
            g = h @ w["wh"]
            zr = 1 / (1 + np.exp(-(xw[:, : 2 * lm.HIDDEN] + g[:, : 2 * lm.HIDDEN])))
            n = np.tanh(xw[:, 2 * lm.HIDDEN :] + zr[:, lm.HIDDEN :] * g[:, 2 * lm.HIDDEN :])
            h = n + zr[:, : lm.HIDDEN] * (h - n)
            total -= (model.log10(h.astype(np.float32), y[t]) - voc.static[y[t]]).sum() * math.log(10)
        return total / 12

    trainer.window(x, y, fresh, np.zeros((3, lm.HIDDEN), np.float32))
    for name, at in (("wh", (1, 5)), ("wx", (2, 20)), ("b", (30,)), ("wc", (3, 1)), ("bc", (0,)), ("wo", (4, 2)), ("bo", (3,))):
        old, step = model.w[name][at], 1e-2
        model.w[name][at] = old + step
        up = loss()
        model.w[name][at] = old - step
        down = loss()
        model.w[name][at] = old
        assert math.isclose(seen[name][0][at], (up - down) / 2 / step, rel_tol=0.05, abs_tol=2e-4), name
    grad, rows = seen["embed"]
    old, row = model.w["embed"][rows[0], 1], rows[0]
    model.w["embed"][row, 1] = old + 1e-2
    up = loss()
    model.w["embed"][row, 1] = old - 1e-2
    assert math.isclose(grad[0, 1], (up - loss()) / 2e-2, rel_tol=0.05, abs_tol=2e-4)


@pytest.mark.parametrize("most", [0.0, 200.0])
def test_scores_by_feature(most):
    """op7_gru_scores: logits were bounded by a pass over them all, though the weights tell if one can be too large."""
    words_ = [lm.END] + [f"w{i}" for i in range(40)]
    voc = lm.Vocabulary(words_, [90 - i for i in range(41)], 5000, 100)
    rng = np.random.default_rng(2)
    ids, offsets, _, _ = voc.ids(pa.array([" ".join(f"w{x}" for x in rng.integers(0, 45, n)) for n in (3, 0, 60, 1, 17, 60)]))
    model = lm.Model(voc)
    model.w["bc"][0] += most
    model.w["bo"][7] += most
    assert model.outputs(1)[2:] == ((most > 80,) * 2)
    w, H, bounded = {k: v.astype(np.float64) for k, v in model.w.items()}, lm.HIDDEN, lambda x: np.minimum(x, 80)
    want = []
    for a, b in zip(offsets, offsets[1:]):
        h, last, total = np.zeros(H), voc.end, 0.0
        for i in ids[a:b]:
            x, g = w["embed"][voc.input_of[last]] @ w["wx"] + w["b"], h @ w["wh"]
            z, r = np.split(1 / (1 + np.exp(-(x[: 2 * H] + g[: 2 * H]))), 2)
            n = np.tanh(x[2 * H :] + r * g[2 * H :])
            h, last, c = n + z * (h - n), i, voc.class_of[i]
            logits = bounded(h @ w["wc"] + w["bc"])
            total += voc.static[i] + (logits[c] - np.log(np.exp(logits).sum())) / math.log(10)
            if i < voc.dynamic:
                own = bounded(w["wo"] @ h + w["bo"])[voc.ends[c] : voc.ends[c + 1]]
                total += (own[i - voc.ends[c]] - np.log(np.exp(own).sum())) / math.log(10)
        want.append(total)
    for together in (1, 7, 32_768):
        assert np.allclose(model.score(ids, offsets, together), want, rtol=1e-5)
    # a window of many lanes has the mean of the gradients of its parts, though it is worked through in pieces
    x, y, fresh, h = rng.integers(0, 42, (4, 600)), rng.integers(0, 42, (4, 600)), rng.random((4, 600)) < 0.1, rng.uniform(-1, 1, (600, H)).astype(np.float32)
    got = []
    for lanes in (slice(0, 600), slice(0, 300), slice(300, 600)):
        trainer, seen = lm.Trainer(model), {}
        trainer._adam = lambda name, grad, rows=slice(None), seen=seen: seen.update({name: np.array(grad)})
        seen["h"] = trainer.window(x[:, lanes], y[:, lanes], fresh[:, lanes], h[lanes])
        got.append(seen)
    whole, left, right = got
    assert np.array_equal(whole["h"], np.concatenate([left["h"], right["h"]]))
    for name in ("wc", "bc", "wo", "bo", "wh", "wx", "b"):
        assert np.allclose(whole[name], (left[name] + right[name]) / 2, atol=1e-6), name


# archives


def test_merkle(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * (50 * i % 7000)) for i in range(3000)] + [(None, None, None), (7, "http://h/7", "twice")], "page_id long, url string, html string").repartition(3)
    one = merkle.warc_records(pages.withColumns({"body": F.lit("b"), "Hash": F.lit("h"), "file": F.lit(1), "offset": F.lit(2), "node": F.lit(3)})).cache()
    same_ = merkle.audit(one, merkle.warc_records(pages))
    assert same_.where("status <> 'ok'").count() == 0
    two = one.where("page_id IS NULL OR page_id <> 1234").withColumn("hash", F.when(F.col("page_id") == 77, "0").otherwise(F.col("hash")))
    bad = merkle.audit(one, two).where("status = 'corrupt'").collect()
    want = {(r["file"], str(r["offset"])) for r in one.where("page_id IN (1234, 77)").collect()}
    assert {(r["file"], x) for r in bad for x in r["offsets"].split(",")} == want
    assert merkle.audit(one.limit(0), one.limit(0)).count() == 0
    lost = merkle.audit(one, one.limit(0))
    assert lost.where("status = 'ok'").count() == 0 and lost.count() > 0


# compaction


def test_compaction(spark, docs, rows, none, monkeypatch):
    monkeypatch.setattr(compaction, "ARRIVAL_BYTES", 20_000)
    folder = storage.new_path(spark, "c")
    compaction.append(docs, folder)
    first = compaction.manifest(folder)
    for _ in range(4):
        compaction.append(docs, folder)
    last = compaction.compact(spark, folder)
    assert len(last["files"]) < len(first["files"]) * 5
    assert sum(f["rows"] for f in last["files"]) == 5 * len(rows)
    assert same(compaction.read(spark, folder).select("doc_id", "text").collect(), rows * 5)
    assert same(compaction.read(spark, folder, first["version"]).select("doc_id", "text").collect(), rows)  # old versions stay whole
    with pytest.raises(compaction.Conflict):
        compaction.commit(folder, first, [])
    assert not [n for n in os.listdir(folder.removeprefix("file://")) if n.endswith(".part")]
    assert json.load(open(f"{folder.removeprefix('file://')}/v{last['version']:08d}.json"))["version"] == last["version"]
    whole = [r for _ in range(5) for r in docs.collect()]
    assert same(compaction.read(spark, folder).drop("shard_").collect(), whole)  # all columns; shard is one of the documents'
    empty = storage.new_path(spark, "c")
    compaction.append(none, empty)
    assert compaction.read(spark, empty).count() == 0 and compaction.read(spark, empty).columns[:-1] == none.columns


def test_compaction_of_unlike_columns(spark):
    folder = storage.new_path(spark, "c")
    plain = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id int, text string")
    more = spark.createDataFrame([(2, "b", [1, None], "x")], "doc_id long, Text string, tags array<int>, `a.b` string")
    late = spark.createDataFrame([(3, None, [2])], "doc_id long, text string, TAGS array<int>")
    for rows in (plain, more, late, plain):
        compaction.append(rows, folder)
    want = [(1, "a", None, None), (1, "a", None, None), (None, None, None, None)] * 2 + [(2, "b", [1, None], "x"), (3, None, [2], None)]
    assert compaction.read(spark, folder).columns == ["doc_id", "text", "tags", "a.b", "shard"]
    assert same(compaction.read(spark, folder).drop("shard").collect(), want)
    before = compaction.manifest(folder)
    merged = compaction.compact(spark, folder)
    assert len(merged["files"]) < len(before["files"]) and merged["fields"] == before["fields"]
    assert same(compaction.read(spark, folder).drop("shard").collect(), want)
    with pytest.raises(ValueError):
        compaction.append(spark.createDataFrame([(4, "c", "z")], "doc_id long, text string, tags string"), folder)
    assert compaction.manifest(folder) == merged


def test_tiers():
    assert [compaction.tier(x) for x in (1, 64_000, 64_001, 256_000, 256_001)] == [0, 0, 1, 1, 2]
    files = [{"name": f"{i:02d}", "bytes": 50_000, "rows": 1} for i in range(9)] + [{"name": "big", "bytes": 60_000_000, "rows": 1}]
    groups = compaction.plan(files, 200_000)
    assert [len(g) for g in groups] == [4, 4] and all(f["name"] != "big" for g in groups for f in g)
    assert compaction.plan(files[:3], 200_000) == []


# url filters


def test_url_filter(spark, monkeypatch):
    changes = spark.createDataFrame([("bad.org", "2024-01-10", "add"), ("bad.org", "2024-02-01", "remove"), ("bad.org", "2024-03-01", "add"), ("bad.org", "2024-03-05", "add"), ("x.bad.org", "2024-01-20", "add"), (None, "2024-01-01", "add"), ("odd.org", None, "add"), ("same.org", "2024-01-01", "remove"), ("same.org", "2024-01-01", "add")], "entry string, day string, action string").withColumn("day", F.col("day").cast("date"))
    cases = [
        ("http://bad.org/", "2024-01-09", None), ("http://bad.org/", "2024-01-10", "bad.org"), ("https://u:p@www.BAD.org:80/x?y", "2024-01-31", "bad.org"), ("http://bad.org/", "2024-02-01", None),
        ("http://bad.org", "2024-09-01", "bad.org"), ("http://a.x.bad.org/", "2024-01-25", "x.bad.org"), ("http://a.x.bad.org/", "2024-02-25", "x.bad.org"), ("http://notbad.org/", "2024-01-15", None),
        ("nonsense", "2024-01-15", None), (None, "2024-01-15", None), ("http://bad.org/", None, None), ("http://same.org/", "2024-05-01", "same.org"), ("http://bad.org/", "2024-01-10", "bad.org"),
    ]
    captures = spark.createDataFrame([(i, u, d) for i, (u, d, _) in enumerate(cases)], "page_id long, url string, fetched string").withColumn("fetched", F.col("fetched").cast("date"))
    got = {r["page_id"]: (r["entry"], r["blocked"]) for r in urlfilter.blocked(captures, changes).collect()}
    assert got == {i: (e, e is not None) for i, (*_, e) in enumerate(cases)}
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 1)
    odd = captures.withColumns({"entry": F.lit(1), "since": F.lit("x"), "Day": F.lit(2), "h_": F.lit(3)})
    assert {r["page_id"]: r["entry"] for r in urlfilter.blocked(odd, changes.withColumn("host", F.lit("z"))).collect()} == {i: e for i, (*_, e) in enumerate(cases)}
    assert urlfilter.blocked(captures.limit(0), changes).count() == 0 and urlfilter.blocked(captures, changes.limit(0)).where("blocked").count() == 0


# stages


def test_stages(spark, docs, rows, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "pack"]
    base = [t for _, t in rows if t and len(t.split()) > 60]
    items = [(1, " ".join(base[1].split()[3:20]))]
    d = f"{tmp_path}"
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, now, d)
    assert kept.columns == now.columns
    ok = lambda t: (m := measured(t))[0] >= 50 and 100 * m[4] <= 50 * m[0]
    assert same(kept.select("doc_id", "text").collect(), [(i, t) for i, t in rows if ok(t)])
    once = stages["near_dedup"](spark, now, d)
    assert once.columns == now.columns
    want = deduplicated(rows)
    assert sorted(map(repr, map(tuple, once.select("doc_id", "text").collect()))) == sorted(map(repr, want))
    clean = stages["decontaminate"](spark, now, d)
    assert same(clean.select("doc_id", "text").collect(), [(i, t) for i, t in rows if not decontaminated(t, items)[4]])
    # the whole, against the plain versions one after the other
    left = deduplicated([(i, t) for i, t in rows if ok(t)])
    left = [(i, t) for i, t in left if not decontaminated(t, items)[4]]
    pieces = corpus_pipeline.run(spark, d).collect()
    held = unpacked(pieces, 1024)
    assert left and set(held) == {i for i, _ in left}
    for i, t in left:
        if i is not None:
            assert [x for _, part, _ in sorted(held[i]) for x in part] == ids_of(t, 0)
    assert sum(p["length"] for p in pieces) == sum(len(ids_of(t, 0)) for _, t in left)
    assert shingles.SHINGLE == 5
