"""The corpus operators against brute force, libraries and edge cases."""

import hashlib
import json

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from marketloom.llm import byte_bpe, ctph, graph, langid, lm_score, neardup, packing, pipeline, quality, spm, topk, url_filters, wrappers
from marketloom.llm.corpus_counts import pack_keys, unpack_keys
from marketloom.llm.queries import URL_RULES

BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a  b", "\n a", " a b ", "it's don't 12 34", "a <|endoftext|> b", "é　b", "👍🏽 x", "a▁b", "x" * 3000, "nul\x00here"]
WORDS = [f"w{i}" for i in range(400)]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("clash"), "score": F.lit("clash"), "h": F.lit("clash"), "length": F.lit("clash")})


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    out = [" ".join(rng.choice(WORDS, rng.integers(60, 200))) for _ in range(30)]
    near = out[0].split()
    near[10] = "edited"
    return [*out, out[0], " ".join(near), None, "", "short one", "short one"]


def test_url_rules_and_aliases(spark):
    link = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "http://a.example.org/es/x", ""), (2, "HTTP://B.NET/q?x#y", link("http://example.org/es/x")), (3, "http://c.net/", '<meta http-equiv=refresh content="0; url=http://b.net/q?x">'),
        (4, None, None), (5, "no scheme", ""), (6, "http://x.com/fr/a", link("http://example.org/es/x")), (7, "http://d.net", ""), (8, "http://shop.example.org/en/1/2", ""), (9, "http://x.org", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "_x": F.lit(2)})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(df, URL_RULES).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[2] == ("b.net", "/q", None, "block") and got[3][3] == "block"
    assert got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow")
    assert got[6][2:] == ("com/fr/", "allow") and got[7] == ("d.net", "", None, "allow") and got[8][2] == "example.org/en/1" and got[9][2] is None
    assert url_filters.filter_urls(df.limit(0), URL_RULES).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    e = spark.range(40).selectExpr("id src", "id + 1 dst").union(spark.range(200, 260).selectExpr("id src", "100 dst")).union(spark.sql("SELECT 7L, 7L"))
    got = {r["node"]: r["component"] for r in graph.connected_components(e).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(200, 260)} == {100}


def test_topk_is_exact(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-9, 10, (300, 16))
    v[50:90] = v[3]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (420, [1, None]), (440, []), (None, [1] * 16), (460, [2] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = topk.exact_topk(df, F.col("vec_id") % 20 == 0, 7).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    for q in range(0, 300, 20):
        s = v @ v[q]
        assert by[q] == [(int(s[i]), i) for i in sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:7]]
    assert 400 not in by and 440 not in by
    assert topk.exact_topk(df.limit(0), F.col("vec_id") % 20 == 0, 7).count() == 0


def test_quality_learns_and_handles_empty(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(WORDS, 80)) if i % 2 else " ".join(w.upper() + "!!" for w in rng.choice(WORDS, 80))) for i in range(120)] + [(500, None), (501, "")]
    df = docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(500, None), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r["s"] for r in quality.score(df, quality.fit(df, labels), ["doc_id", "score"], out="s").collect()}
    assert all((got[i] >= 0.3) == bool(i % 2) for i in range(100, 120)) and 0 <= got[500] <= 1
    assert quality.score(df.limit(0), quality.fit(df.limit(0), labels.limit(0)), ["doc_id"]).count() == 0


def _weighted(texts):
    kinds = sorted({t or "" for t in texts})
    sh = {}
    for t in kinds:
        w = t.lower().split()
        c = {}
        for k in range(max(1, len(w) - 4) if w else 0):
            c[tuple(w[k : k + 5])] = c.get(tuple(w[k : k + 5]), 0) + 1
        sh[t] = c
    df = {}
    for c in sh.values():
        for k in c:
            df[k] = df.get(k, 0) + 1
    idf = {k: float(neardup.idf(np.array([n]), len(kinds))[0]) for k, n in df.items()}
    return {t: {k: n * idf[k] for k, n in c.items()} for t, c in sh.items()}


def test_near_duplicates_match_brute_force(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    got = neardup.near_duplicate_classes(docs(spark, rows)).collect()
    cls = {r["id"]: r["class_id"] for r in got}
    w = _weighted(texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            x, y = w[a or ""], w[b or ""]
            low = sum(min(x[k], y[k]) for k in x if k in y)
            alike = (a or "") == (b or "") or low / max(1e-9, sum(x.values()) + sum(y.values()) - low) >= 0.8
            assert (cls[i] == cls[j]) == alike, (i, j)
    assert len(got) == len(rows) and neardup.near_duplicate_classes(docs(spark, rows).limit(0)).count() == 0


def test_rows_are_told_apart_by_id_and_text(spark):
    rng = np.random.default_rng(8)
    x, y, z, u, v = (" ".join(rng.choice(WORDS, 150)) for _ in range(5))
    near = f"{u} edited"
    rows = [(None, x), (None, y), (5, x), (7, z), (7, y), (9, u), (3, z), (9, x), (11, near), (12, v), (12, v)]
    kept = pipeline.near_duplicate_stage(spark, docs(spark, rows), "").select("doc_id", "text").collect()
    assert sorted(r["text"] for r in kept if r["text"] not in (u, near)) == sorted([x, y, z, v]) and len(kept) == 5
    assert {r["doc_id"] for r in kept if r["text"] in (x, y)} == {None}
    # op4: u shares its id with a copy of x, and is compared with its near copy alone; null ids link nothing
    got = [(r["id"], r["class_id"], r["class_size"], r["class_node"]) for r in neardup.near_duplicate_classes(docs(spark, rows)).collect()]
    of = {}
    for i, c, n, node in got:
        of.setdefault(node, []).append(i)
    assert sorted(sorted(map(str, v)) for v in of.values()) == [["11", "9"], ["12", "12"], ["3", "7"], ["5", "9", "None"], ["7", "None"]]


def test_plain_similarity_at_the_threshold_links(spark):
    rng = np.random.default_rng(12)
    base, texts = list(rng.permutation(WORDS)[:188]), []
    for k in range(18):  # two edits each, far from all others: any pair has 164 of 204 shingles
        words = list(base)
        for at in (5 + 10 * k, 10 + 10 * k):
            words[at] = f"edit{k}at{at}"
        texts.append(" ".join(words))
    got = neardup.near_duplicate_classes(docs(spark, [*enumerate(texts), (50, " ".join(rng.choice(WORDS, 190)))])).collect()
    assert {r["id"]: r["class_id"] for r in got} == {**dict.fromkeys(range(18), 0), 50: 50}


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    keys = np.sort(rng.integers(1, 1 << 63, 300, dtype=np.uint64))
    table = neardup._level(np.full(1 << 14, 0.0), np.arange(1 << 14))
    agree = []
    for _ in range(40):
        k = np.sort(rng.integers(1, 1 << 63, 300, dtype=np.uint64))
        w = rng.random(300) + 0.5
        a = neardup.sample(k[:250], w[:250], 1.0, table)[1]
        b = neardup.sample(k[25:], w[25:], 1.0, table)[1]
        agree.append((a == b).mean() - w[25:250].sum() / w.sum())
    assert abs(np.mean(agree)) < 0.04
    assert (unpack_keys(pack_keys(keys)) == keys).all()


def test_language_id(spark):
    rng = np.random.default_rng(6)
    kinds = {"xx": "abcde", "yy": "uvwxyz"}
    rows = [(i, " ".join("".join(rng.choice(list(kinds[g]), 5)) for _ in range(20)), g) for i in range(60) for g in [("xx", "yy")[i % 2]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.fit(df)
    more = spark.createDataFrame([(1, "aabb cdea"), (2, "zzyx wvu"), (3, None), (4, ""), (5, "12 34 !?")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(more, m, ["doc_id"]).collect()}
    assert got[1][0] == "xx" and got[2][0] == "yy" and got[1][1] > 0.9
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert langid.predict(more, langid.fit(df.limit(0)), ["doc_id"]).where("lang_pred <> 'und'").count() == 0


def test_fingerprints_and_edits(spark, texts):
    assert ctph.likeness(ctph.fingerprint("a b c" * 300), ctph.fingerprint("a b c" * 300)) == 1.0
    assert ctph.fingerprint(None) == ctph.fingerprint("")
    a, b = texts[1] * 5, texts[2] * 5
    assert ctph.likeness(ctph.fingerprint(a), ctph.fingerprint(a[: len(a) * 2 // 3] + b[: len(a) // 3])) > 0.4 > ctph.likeness(ctph.fingerprint(a), ctph.fingerprint(b))
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in ctph.fingerprint_with_edits(docs(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    for (i, t), (_, n) in zip(order, [*order[1:], order[0]], strict=True):
        t, n = t or "", n or ""
        k = len(t) // 3
        e = t[: len(t) - k] + n[:k]
        assert got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and got[i]["edited_fingerprint"] == ctph.fingerprint(e) and got[i]["n_chars"] == len(t)
    assert ctph.fingerprint_with_edits(docs(spark, rows).limit(0)).count() == 0
    assert ctph.fingerprint_with_edits(docs(spark, [(None, "x"), (1, "y")])).count() == 2


def test_common_subsequence_by_words():
    rng = np.random.default_rng(8)
    for _ in range(50):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 20))) for _ in range(2))
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1, j + 1] = d[i, j] + 1 if x == y else max(d[i, j + 1], d[i + 1, j])
        assert ctph.common_subsequence(a, b) == d[-1, -1]


def test_sentencepiece_equals_the_library(spark, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = list(enumerate([*texts, *ODD]))
    got = {r["doc_id"]: r for r in spm.encode(docs(spark, rows), PIECE, decoded="decoded", keep=("doc_id",)).collect()}
    for i, t in rows:
        ids = [*lib.encode(t or ""), lib.eos_id()]
        assert list(got[i]["ids"]) == ids and got[i]["decoded"] == lib.decode(ids)


def test_byte_ids_equal_the_tokenizers_library(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    for t in [*filter(None, texts), *ODD]:
        assert byte_bpe.bpe_for(BPE).encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids


PAGE = "<html><head><title>T</title><script>var a='</p>';</script></head><body class='has-sidebar'><nav><ul><li>Home</li></ul></nav><div class=top>Site of the day</div><div class='ad'>Buy {0}</div><article><h1>Head {0}</h1><p>One &amp; two <b>bold{0}</b>\n text.<br>more<p>Last &lt;{0}&gt;<div class=comments><p>Reader {0}</div></article><aside>See {0}</aside><footer>&copy; x</footer></body></html>"


def test_main_text(spark):
    rows = [(i, f"http://h.net/{i}", PAGE.format(i)) for i in range(12)] + [(90, "http://h.net/n", None), (91, None, ""), (92, "http://solo.net/", "<p>only <i>this</i></p>plain"), (93, "http://h.net/0", PAGE.format(0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "text": F.lit("clash"), "wrapper": F.lit("c")})
    got = {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()}
    for i in range(12):
        assert got[i] == f"Head {i}\nOne & two bold{i} text. more\nLast <{i}>"
    assert got[90] == got[91] == "" and got[92] == "only this\nplain" and got[93] == got[0]
    assert wrappers.extract(df.limit(0)).count() == 0


def test_constant_nodes_are_template():
    page = "<div><p>Welcome to our site</p><div><p>Story {0} goes on and on for a long while, and then some more {0}</p><p>and more of {0}, which is long as well, so it counts</p></div></div>".format
    top = json.dumps(wrappers.induce([page(i) for i in range(6)]).dump())
    assert "Welcome" not in wrappers.main_text(page(9), top) and "Story 9" in wrappers.main_text(page(9), top)


@pytest.mark.parametrize("chars", [wrappers.BROADCAST_CHARS, -1])
def test_template_is_counted_over_all_pages_of_each_layout(spark, monkeypatch, chars):
    monkeypatch.setattr(wrappers, "BROADCAST_CHARS", chars)
    long = "{0} a paragraph that goes on for a long while and differs from page to page, {0}".format
    usual = lambda i: f"<body><article><p class=byline>{'Jane Doe' if i % 20 else f'Other {i}'}</p><p>{long(i)}</p></article><p>About us</p></body>"
    rare = lambda i: f"<body><div><p>Notice</p><p>{long(i)}</p></div></body>"
    rows = [(i, f"http://a.org/{i}", rare(i) if i % 10 == 3 else usual(i)) for i in range(300)]
    got = dict(wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "text").collect())
    for i in range(300):  # a byline that 95 % of the articles share is text; a minority layout's notice is template
        assert got[i] == long(i) if i % 10 == 3 else got[i].split("\n") == ["Jane Doe" if i % 20 else f"Other {i}", long(i)], (i, got[i])


@pytest.mark.parametrize("depth", [500, 20_000])
def test_nesting_has_no_limit(depth):
    page = lambda i: f"<div id=page><article><p>before {i}</p>{'<div>' * depth}<p>in {i}</p><script>var x</script><p>in too {i}{'</div>' * depth}<p>after {i}</p><script>var y</script></article></div>"
    text = "\n".join(f"{x} 9" for x in ("before", "in", "in too", "after"))
    assert wrappers.main_text(page(9)) == text
    assert wrappers.main_text(page(9), json.dumps(wrappers.induce([page(i) for i in range(4)]).dump())) == text


def test_pages_without_article_keep_title_and_lead():
    page = lambda i: f"<div><p>Welcome to our site</p><h1>Title {i}</h1><p>Lead {i}</p><div class=body>{f'<p>A long paragraph of story {i}</p>' * 20}</div></div>"
    top = json.dumps(wrappers.induce([page(i) for i in range(6)]).dump())
    text = "\n".join(["Title 9", "Lead 9"] + ["A long paragraph of story 9"] * 20)
    assert wrappers.main_text(page(9), top) == text and wrappers.main_text(page(9)) == "Welcome to our site\n" + text


def test_best_fill_against_all_subsets():
    rng = np.random.default_rng(9)
    for _ in range(60):
        counts = np.zeros(31, int)
        for n in rng.integers(1, 31, 6):
            counts[n] += 1
        cap = int(rng.integers(5, 40))
        items = [n for n in range(31) for _ in range(counts[n])]
        best = max(s for m in range(1 << len(items)) if (s := sum(x for i, x in enumerate(items) if m >> i & 1)) <= cap)
        used = packing.best_fill(counts, cap)
        assert sum(n * c for n, c in used.items()) == best and all(c <= counts[n] for n, c in used.items())


def test_packing_places_every_id_once(spark, texts):
    import zlib

    rows = [(i, t if t is None else t * 3) for i, t in enumerate(texts)] + [(3, texts[3] * 3), (None, "no id"), (50, "long " * 5000)]
    got = packing.pack(docs(spark, rows), BPE, window=256, keep=("score",)).toPandas()
    size = got.groupby("sequence_id")["length"].sum()
    assert list(size.index) == list(range(len(size))) and all(n == 256 or n & (n - 1) == 0 for n in size)
    o = got.sort_values(["sequence_id", "offset"])
    assert (o.groupby("sequence_id")["length"].cumsum() - o["length"] == o["offset"]).all()
    ids = {i: np.append(byte_bpe.bpe_for(BPE).encode(t or ""), 0).astype("<u4") for i, t in rows if i is not None}
    known = got[got["doc_id"].notna()]
    for r in known.itertuples():
        x = ids[int(r.doc_id)]
        assert r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(x)
    assert known["length"].sum() == sum(map(len, ids.values())) + len(ids[3])
    assert packing.pack(docs(spark, rows).limit(0), BPE).count() == 0


def test_lm_scores_match_brute_force(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "w1 w2 w3")]
    target = spark.createDataFrame([(i,) for i in range(0, 30, 3)] + [(None,)], "doc_id long")
    got = {r["id"]: r for r in lm_score.cross_entropy_difference(docs(spark, rows), target).collect()}
    words = [(i, (t or "").lower().split(), i is not None and i < 30 and i % 3 == 0) for i, t in rows]
    vocabulary = len({w for _, ws, _ in words for w in ws})
    for i, ws, mine in words:
        if not ws:
            assert got[i]["n_tokens"] == 0 and got[i]["difference"] == 0
            continue
        loss = []
        for only in (True, False):
            uni, bi, seen = {}, {}, False
            for j, other, t in words:
                same = not seen and j == i and other == ws
                seen |= same
                if (only and not t) or same:
                    continue
                for a, b in zip([None, *other], other, strict=False):
                    uni[b] = uni.get(b, 0) + 1
                    bi[a, b] = bi.get((a, b), 0) + 1
                if other:
                    uni[None] = uni.get(None, 0) + 1
            n = sum(c for k, c in uni.items() if k is not None)
            p = lambda a, b: (bi.get((a, b), 0) + 4 * (uni.get(b, 0) + 0.1) / (n + 0.1 * (vocabulary + 1))) / (uni.get(a, 0) + 4)  # noqa: B023, E731
            loss.append(np.mean([-np.log2(p(a, b)) for a, b in zip([None, *ws], ws, strict=False)]))
        assert got[i]["target_loss"] == pytest.approx(loss[0]) and got[i]["background_loss"] == pytest.approx(loss[1])
    assert lm_score.cross_entropy_difference(docs(spark, rows).limit(0), target).count() == 0


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, d).toPandas()
    kept = set(got["doc_id"])
    table = spark.read.parquet(f"{d}/documents.parquet").toPandas()
    assert kept <= set(table["doc_id"]) and len(kept) > 0.5 * len(table)
    assert (got.groupby("doc_id")["length"].sum() == got.groupby("doc_id")["doc_tokens"].first()).all()
    assert not table[table["doc_id"].isin(kept)]["text"].duplicated().any()
