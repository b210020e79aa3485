"""The dealt methods against brute force: each by the definition, and on the cases that break shortcuts."""

import hashlib
import itertools
import zlib
from collections import Counter
from urllib.parse import urljoin

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from marketloom.llm import byte_bpe, graph, langid, neardup, packing, pipeline, quality, queries, spm, topk, url_filters, wrappers
from marketloom.llm.corpus_counts import pack_counts, unpack_counts

BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"


# ---- url filters


def test_links_are_resolved_as_the_standard_says(spark):
    bases = ["http://a.net", "http://a.net/", "http://d.net/a/b/c.html?q=1#z", "https://d.net/a/b/", "http://d.net/a?x=/../y"]
    refs = ["x.html", "/x", "?a=1", "../c", "./c/./d", "../../../g", "g/..", "//e.net/p", "http://e.net/q?r", "a b", ".", "g;x=1/../y", "x?y=../z"]
    rows = [(b, r) for b in bases for r in refs]
    df = spark.createDataFrame(rows, "u string, t string")
    out = url_filters.resolved_links(df).collect()
    want = Counter((b, urljoin(b, r)) for b, r in rows)
    have = Counter((r["u"], r["full"]) for r in out)
    assert have == want, (have - want, want - have)


def test_links_of_other_kinds(spark):
    page = lambda i, u, h: (i, u, h)
    rows = [
        page(1, "http://x.com/de/bad", ""),
        page(2, "http://a.net/1", '<!-- <link rel="canonical" href="http://x.com/de/bad"> -->'),
        page(3, "http://a.net/3", '<link href="http://x.com/de/bad" rel="nofollow canonical">'),
        page(4, "http://a.net/4", "<meta content='5; URL=http://x.com/de/bad' http-equiv=Refresh>"),
        page(5, "http://a.net/5", '<link rel="canonical" href="javascript:void(0)">'),
        page(6, "http://a.net/6", '<script>var s = \'<link rel="canonical" href="http://x.com/de/bad">\';</script>'),
        page(7, "http://a.net/7", '<link title="a > b" rel="canonical" href="http&#58;//x.com/de/&#x62;ad">'),
        page(8, "http://a.net/8", '<link rel="canonical" href="/3#part">'),
        page(9, "http://x.com/de", '<link rel="canonical" href="http://y.net">'),
        page(10, "http://y.net/", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for rules in (queries.URL_RULES, spark.createDataFrame(list(queries.URL_RULES), "action string, rule string")):
        got = {r["page_id"]: r["verdict"] for r in url_filters.filter_urls(df, rules).collect()}
        assert got == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "block", 8: "block", 9: "allow", 10: "allow"}


def test_components_with_hubs(spark):
    rng = np.random.default_rng(4)
    edges = [(7, int(i)) for i in range(1000, 1600)] + [(int(i), 5000) for i in range(2000, 2500)] + [tuple(map(int, rng.integers(8000, 8400, 2))) for _ in range(150)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {n: find(n) for e in edges for n in e if e[0] != e[1] or n in got}


# ---- top-k


@pytest.mark.parametrize("scale", [1, 1 << 40])
def test_topk_prunes_clusters_over_many_blocks(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    monkeypatch.setattr(topk, "ROW_BLOCK", 100)
    monkeypatch.setattr(topk, "SAMPLE_ROWS", 256)
    rng = np.random.default_rng(7)
    n = 1500 if scale == 1 else 200
    centre = rng.normal(0, 60, (12, 64))
    x = (centre[rng.integers(0, 12, n)] + rng.normal(0, 4, (n, 64))).astype(np.int64) * scale
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<long>").withColumns({"v": F.lit(1), "id": F.lit("x"), "cell": F.lit(2)})
    got = {}
    for r in topk.exact_topk(df, F.col("vec_id") % 20 == 0, 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    big = x.astype(object)
    for q in range(0, n, 20):
        s = [max(topk.LOW, min(topk.TOP, int(v))) for v in big @ big[q]]
        best = sorted((i for i in range(n) if i != q), key=lambda i: (-s[i], i))[:10]
        assert sorted(got[q]) == [(k + 1, i, s[i]) for k, i in enumerate(best)]
    if scale == 1:
        ids = np.arange(n)
        floor = topk.sample_floors(x[::20], ids[::20], x[:256], ids[:256], 10)
        assert topk.block_topk(x[::20], ids[::20], x, ids, 10, floor)[3] < 0.25 * (n // 20) * n


# ---- quality


def test_gated_attention_forward_and_gradients():
    rng = np.random.default_rng(2)
    p = {"mean": np.zeros(quality.FEATURES), "dev": np.ones(quality.FEATURES), "W": rng.normal(0, 0.3, (quality.FEATURES, 5)), "b": rng.normal(0, 0.3, 5), "V": rng.normal(0, 1, (5, 3)), "U": rng.normal(0, 1, (5, 3)), "w": rng.normal(0, 1, 3), "c": rng.normal(0, 1, 5), "d": rng.normal(0, 1, 1)}
    bag = rng.normal(0, 1, (4, quality.FEATURES))
    h = [np.tanh(x @ p["W"] + p["b"]) for x in bag]
    gate = [float(p["w"] @ (np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"]))))) for v in h]
    a = np.exp(gate) / np.exp(gate).sum()
    z = sum(k * v for k, v in zip(a, h, strict=True))
    assert quality.MilModel(p).score(bag) == pytest.approx(float(1 / (1 + np.exp(-(z @ p["c"] + p["d"][0])))))


def test_features_do_not_depend_on_the_order_of_sets():
    text = "b a b c b a"
    assert quality.passages(text)[0, -1] == pytest.approx(0.5)


def test_quality_sample_is_bounded_and_labels_may_clash(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_PASSAGES", 40)
    rows = [(i, "good words here " * 300 if i % 2 else "BAD!! " * 900) for i in range(40)] + [(1, "good words here " * 300)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"y": F.lit("c"), "h": F.lit(1), "score": F.lit("clash")})
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(5, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model, ["doc_id", "score"]).collect()}
    assert got[39] > got[38] and quality.score(docs, model, ["doc_id", "score"]).columns == ["doc_id", "score"]


# ---- language id


def test_naive_bayes_by_hand(spark):
    rng = np.random.default_rng(6)
    kinds = {"xx": "abcde ", "yy": "cdefgh ", "zz": "äöüabc "}
    rows = [(i, "".join(rng.choice(list(kinds[g]), 40)), g) for i, g in enumerate(itertools.islice(itertools.cycle(kinds), 60))]
    df = spark.createDataFrame([*rows, (70, None, "xx"), (71, "abc", None)], "doc_id long, text string, lang string")
    m = langid.fit(df)

    def grams(t):
        return [int(x) for b in langid.ngram_buckets(t) for x in b]

    counts, n_docs = {g: Counter() for g in kinds}, Counter(g for _, _, g in rows)
    for _, t, g in rows:
        counts[g].update(grams(t))
    tests = ["abcdeabc", "fgh", "ä ö", "É" * 3, "x" * 5000, "²", "½ ①", "", None, "a"]
    langs, scores = m.predict(tests)
    for t, lang, s in zip(tests, langs, scores, strict=True):
        if not t or not any(ch.isalpha() for ch in t):
            assert (lang, s) == ("und", 0.0)
            continue
        ll = {g: np.log(n_docs[g] / 60) + sum(np.log((counts[g][b] + langid.ALPHA) / (sum(counts[g].values()) + langid.ALPHA * 2**langid.BITS)) for b in grams(t)) for g in sorted(kinds)}
        top = max(ll.values())
        assert ll[lang] == pytest.approx(top) and s == pytest.approx(1 / sum(np.exp(v - top) for v in ll.values()), abs=1e-3)
    # slices and batches of any size give the same
    long = "abc de " * 1000
    old, langid.SLICE = langid.SLICE, 500
    try:
        assert m.predict([long, "fgh", long])[0] == ["xx", "yy", "xx"]
    finally:
        langid.SLICE = old


def test_many_languages_and_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_MATRIX_MB", 1)
    rows = [(i, chr(0x4E00 + i % 40) * 20, f"l{i % 40}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"lang_pred": F.lit(7), "score": F.lit("clash"), "g": F.lit(1)})
    m = langid.fit(df)
    assert len(m.langs) == 40 and m.log_prob.nbytes <= 1 << 20
    got = langid.predict(df, m, ["doc_id", "lang", "score"])
    assert got.columns == ["doc_id", "lang", "lang_pred", "score"] and got.where("lang = lang_pred").count() > 70
    assert langid.predict(df.limit(0), langid.fit(df.limit(0)), ["doc_id"]).count() == 0


# ---- sentencepiece


def test_shared_agenda_equals_one_by_one_and_the_library():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    enc = spm.MergeEncoder(PIECE)
    rng = np.random.default_rng(3)
    letters = list("abcdefghiklmnorstuéßñ.,\n日👍") + ["th", "ing", "tion", "an"]
    words = list({"".join(rng.choice(letters, rng.integers(1, 30))) for _ in range(3000)} | {"x" * n for n in (1, 62, 63, 64, 65, 200)})
    ids, n = enc.merge_words(words)
    cuts = np.cumsum(n) - n
    for w, a, m, theirs in zip(words, cuts.tolist(), n.tolist(), lib.encode(words), strict=True):
        assert ids[a : a + m].tolist() == enc.merge(spm.MARK + w) == theirs, w


def test_sentencepiece_on_long_and_no_texts(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rng = np.random.default_rng(4)
    long = " ".join("".join(rng.choice(list("abcdefg"), 9)) for _ in range(60_000))
    df = spark.createDataFrame([(1, long), (2, "b" * 20_000), (1, long)], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = spm.encode(df, PIECE, decoded="back", keep=("doc_id",)).collect()
    want = {1: [*lib.encode(long), lib.eos_id()], 2: [*lib.encode("b" * 20_000), lib.eos_id()]}
    assert len(got) == 3 and all(list(r["ids"]) == want[r["doc_id"]] and r["back"] == lib.decode(want[r["doc_id"]]) for r in got)
    assert spm.encode(df.limit(0), PIECE, decoded="back", keep=("doc_id",)).count() == 0


# ---- html


def test_tree_matching_against_all_matchings():
    rng = np.random.default_rng(5)

    def tree(depth):
        node = wrappers.Node(str(rng.choice(["a", "b"])))
        node.text = str(rng.choice(["x", "y", ""]))
        if depth:
            node.kids = [tree(depth - 1) for _ in range(rng.integers(0, 4))]
        return node

    def best(s, n):
        if s.label != n.label:
            return 0
        top = 0
        for k in range(min(len(s.kids), len(n.kids)) + 1):
            for p in itertools.combinations(s.kids, k):
                for q in itertools.combinations(n.kids, k):
                    scores = [best(x, y) for x, y in zip(p, q, strict=True)]
                    top = max(top, sum(scores))
        return top + (2 if n.text in s.texts else 1)

    for _ in range(150):
        a, b = tree(2), tree(2)
        score, pairs = wrappers.tree_match(wrappers.Slot.of(a), b)
        assert score == best(wrappers.Slot.of(a), b)
        assert [n for _, n, _ in pairs] == [n for n in b.kids if any(n is m for _, m, _ in pairs)]


def _site(i):
    items = "".join(f"<li><a href=/{i}{k}>Go to {i * 7 % 13}{k}</a></li>" for k in range(5))
    return f"<body><ul>{items}</ul><div>Our motto</div><div class=text><h1 class='article-header'>Head {i}</h1>" + f"<p>Story {i} is told here at length</p>" * (1 + i % 3) + f"<section id='search-trees'>Trees {i}</section><p class='notice-period'>Notice {i}</p><div class='ad-box'>Buy {i}</div><div class='commentList'>Reader {i}</div></div><div>Terms</div></body>"


def test_the_wrapper_decides(spark):
    rows = [(i, f"http://s.net/{i}", _site(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("layout", F.lit("clash"))
    got = dict(wrappers.extract(df).select("page_id", "text").collect())
    for i, _, html in rows:
        assert got[i] == "\n".join([f"Head {i}", *[f"Story {i} is told here at length"] * (1 + i % 3), f"Trees {i}", f"Notice {i}"])
        assert wrappers.main_text(html) != got[i]  # the wrapper withheld


GIVEN = "/root/testdata/sf0.01"


def test_pages_without_telling_tags_read_the_same(spark):
    """The given pages with div for every telling tag and no class: what is content comes from the slots' sums alone."""
    pages = spark.read.parquet(f"{GIVEN}/pages.parquet")
    # Hosts with 8 pages or more stand for known layouts.
    plain = F.regexp_replace(F.regexp_replace("html", r"<(nav|article|footer)>|<div class=\"ad\">", "<div>"), r"</(nav|article|footer)>", "</div>")
    got = {r["page_id"]: r["text"] for r in queries.op8_html_extraction(spark, GIVEN).collect()}
    bare = {r["page_id"]: r["text"] for r in wrappers.extract(pages.withColumn("html", plain)).collect()}
    host = {r["page_id"]: r["h"] for r in pages.select("page_id", url_filters.url_host(F.col("url")).alias("h")).collect()}
    often = {h for h in host.values() if list(host.values()).count(h) >= 8}
    known = [i for i in got if host[i] in often]
    assert len(known) > 50 and sum(got[i] == bare[i] for i in known) >= 0.95 * len(known)
    assert sum(got[i] == bare[i] for i in got) >= 0.9 * len(got)
    assert not any("<" in t and "div" in t for t in bare.values()) and all(got.values())


def test_bare_slots_beside_the_largest_are_left_out():
    text = lambda i: "".join(f"<p>Paragraph {k} of story {i} is long enough to count</p>" for k in range(4))
    page = lambda i: f"<body><div>Buy {i}</div><div><h1>Head {i}</h1>{text(i)}<div>Boxed {i}</div></div><div>Seen {i} times</div><div><h2>More {i}</h2></div></body>"
    want = ["Head 1", *[f"Paragraph {k} of story 1 is long enough to count" for k in range(4)], "Boxed 1", "More 1"]
    assert wrappers.main_text(page(1), "{}").split("\n") == want  # the page as its own wrapper
    bare = lambda i: f"<body><div>One {i}</div><div>{'Two and more ' * 9}{i}</div></body>"
    assert wrappers.main_text(bare(1), "{}").startswith("One 1\nTwo")  # nothing there is running text, so nothing is told apart


def test_whole_names_only():
    yes = ["ad", "ad-box", "adBox", "site-footer", "comments", "comment-list", "top-nav", "cookie_banner", "comment-12"]
    no = ["article-header", "search-trees", "notice-period", "has-sidebar", "no-comments", "badge", "main", "content", "header-image", "promoter"]
    assert all(map(wrappers.names_role, yes)) and not any(map(wrappers.names_role, no))


def test_several_articles_and_open_paragraphs():
    top = '{"shape": "[[0, \\"#root\\", 1, {}]]"}'
    wrapper = '{"*": ' + top + "}"
    assert wrappers.main_text("<article>one</article><article><p>two<div>three</div></article><div>out</div>", wrapper) == "one\ntwo\nthree"
    deep = "<article><p>a<b>" + "<i>" * 50 + "b<p>c</article>"
    assert wrappers.main_text(deep, wrapper) == "ab\nc"


@pytest.mark.parametrize("hot", [5, 20_000])
def test_joined_wrappers_of_hot_hosts(spark, monkeypatch, hot):
    monkeypatch.setattr(wrappers, "BROADCAST_CHARS", -1)
    monkeypatch.setattr(wrappers, "HOT", hot)
    rows = [(i, f"http://s.net/{i}", _site(i)) for i in range(30)] + [(100, "http://t.net", "<p>one</p>"), (101, None, None)]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "text").collect()
    assert len(got) == 32 and all("motto" not in r["text"] for r in got) and {r["text"] for r in got if r["page_id"] > 50} == {"one", ""}


# ---- packing


def test_special_tokens_and_clashing_names(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    rows = [(1, "a <|endoftext|> b"), (2, "x" * 5000), (3, None), (3, None), (None, "n"), (5, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("k"), "h": F.lit("k"), "start": F.lit("k"), "length": F.lit("k"), "part": F.lit("k")})
    got = packing.pack(df, BPE, window=64, keep=("id", "h", "start", "length", "part")).toPandas()
    assert {"id", "h", "kept_start", "kept_length", "part"} <= set(got.columns) and (got["kept_start"] == "k").all()
    for i, t in rows[:2] + rows[-1:]:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        own = got[got["doc_id"] == i].sort_values("start")
        assert own["length"].sum() == len(ids) and all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(own["start"], own["length"], own["ids_crc32"], strict=True))
    size = got.groupby("sequence_id")["length"].sum()
    assert all(n == 64 or n & (n - 1) == 0 for n in size)


# ---- near duplicates


def test_counts_beyond_32_bits():
    c = np.array([[1, 2**40], [3, 4]])
    assert (unpack_counts(pack_counts(c), 2) == c).all() and (unpack_counts(pack_counts(c % 100), 2) == c % 100).all()


def test_near_duplicates_of_a_common_passage(spark, monkeypatch):
    """Many texts around one passage: alike or not is settled pair by pair, though all share buckets."""
    monkeypatch.setattr(neardup, "OPEN_BLOCK", 7)
    monkeypatch.setattr(neardup, "ALL_BLOCK", 13)
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(3000)]
    common = list(rng.choice(words, 120))
    texts = [" ".join(common + list(rng.choice(words, n))) for n in rng.integers(5, 90, 60)]
    got = {r["id"]: r["class_id"] for r in neardup.near_duplicate_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}

    def shingles(t):
        w = t.split()
        return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))

    sh = [shingles(t) for t in texts]
    df = Counter(k for s in sh for k in s)
    weight = [{k: n * float(neardup.idf(np.array([df[k]]), len(texts))[0]) for k, n in s.items()} for s in sh]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        plain = sum((sh[i] & sh[j]).values()) / sum((sh[i] | sh[j]).values())
        low = sum(min(weight[i][k], weight[j][k]) for k in weight[i] if k in weight[j])
        if max(plain, low / (sum(weight[i].values()) + sum(weight[j].values()) - low)) >= 0.8:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(len(texts))} and len(set(got.values())) > 5


# ---- the registered queries and the pipeline


def test_registered_queries_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    text = {r.doc_id: r.text or "" for r in docs.itertuples()}

    import sentencepiece
    from tokenizers import Tokenizer

    lib, tok = sentencepiece.SentencePieceProcessor(model_file=PIECE), Tokenizer.from_file(BPE)
    for r in queries.op7_sentencepiece(spark, SMALL).collect():
        ids = [*lib.encode(text[r["doc_id"]]), lib.eos_id()]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))
    for r in queries.op9_packing(spark, SMALL).collect():
        ids = np.array([*tok.encode(text[r["doc_id"]], add_special_tokens=False).ids, 0], "<u4")
        assert (r["ids_crc32"], r["doc_tokens"]) == (zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()), len(ids))
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas()
    x = {r.vec_id: np.floor(64 * np.asarray(r.embedding, float)).astype(np.int64) for r in e.itertuples() if r.embedding is not None and all(v is not None and np.isfinite(v) for v in r.embedding)}
    got = {}
    for r in queries.op2_exact_topk(spark, SMALL).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    for q in (i for i in x if i % 20 == 0):
        want = sorted(((int(x[q] @ x[i]), i) for i in x if i != q), key=lambda s: (-s[0], s[1]))[:20]
        assert [got[q][k + 1] for k in range(len(want))] == want
    held = lambda i, n: zlib.crc32(str(i).encode()) % n
    quality_rows, language_rows = queries.op3_quality(spark, SMALL).collect(), queries.op5_language_id(spark, SMALL).collect()
    assert {r["doc_id"] for r in quality_rows} == {r["doc_id"] for r in language_rows} == set(text)
    assert all(r["held_out"] == (held(r["doc_id"], 5) == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in quality_rows)
    lang = {r.doc_id: r.lang for r in docs.itertuples()}
    assert all(r["held_out"] == (held(r["doc_id"], 4) == 2) for r in language_rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in language_rows if r["held_out"] and lang[r["doc_id"]]]) > 0.9
    rules = sorted(queries.URL_RULES, key=lambda r: -len(r[1]))
    url = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in queries.op1_url_filters(spark, SMALL).collect():
        rest = (url[r["page_id"]] or "").partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].partition("#")[0].partition("?")[0]
        fit = next(((a, p) for a, p in rules for h, _, q in [p.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + q)), ("allow", None))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, fit[1], fit[0])


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    words = {"en": "the of and to in that it was for on are as with his they".split(), "de": "der die und in den von zu das mit sich des auf ist im".split()}
    say = lambda g, n: " ".join(rng.choice(words[g], n)).capitalize() + "."
    rows = [(i, say(g, 60), g, "web", 0) for i in range(60) for g in [("en", "de")[i % 2]]]
    same = rows[3][1]
    rows += [(100, same, "en", "web", 0), (100, say("en", 60), "en", "web", 0), (None, say("de", 60), None, "web", 0), (None, same, "de", None, 0), (101, None, None, None, None), (102, "", "en", "web", 0), (103, "12 34 !?", None, "web", 0), (104, say("en", 9000), "en", "web", 0), (104, say("en", 50), None, "web", 0)]
    rows += [rows[5]] * 3
    at = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").withColumns({"id": F.lit("clash"), "h": F.lit(1), "score": F.lit("clash"), "__n": F.lit(2)})
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    read = spark.read.parquet(f"{at}/documents.parquet")
    good = pipeline.quality_stage(spark, read, at)
    assert good.columns == read.columns and good.count() == len(rows)  # one class: all score 1
    lang = pipeline.language_stage(spark, good, at)
    kept = lang.select("doc_id", "text", "lang").collect()
    assert lang.columns == read.columns and not {101, 102, 103} & {r["doc_id"] for r in kept} and all(r["lang"] for r in kept) and len(kept) == len(rows) - 3
    left = pipeline.near_duplicate_stage(spark, lang, at).collect()
    assert sorted(r["text"] for r in left) == sorted({r["text"] for r in kept})
    assert [r["doc_id"] for r in left if r["text"] == same] == [None]
    out = pipeline.run(spark, at).toPandas()
    assert all(n == 1024 or n & (n - 1) == 0 for n in out.groupby("sequence_id")["length"].sum()) and out["doc_tokens"].notna().all() and len(set(zip(out["doc_id"].fillna(-1), out["doc_tokens"], strict=True))) >= len(left) - 2
    for _, stage in pipeline.STAGES:
        assert stage(spark, read.limit(0), at).count() == 0
