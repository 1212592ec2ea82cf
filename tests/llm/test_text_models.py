"""Language ID, quality, toxicity and HTML: exact parts against brute force, models by held-out accuracy."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lattix.llm import html_extract, langid, quality, queries, toxicity
from lattix.llm.common import TokenTable, bounded_sample, id_bucket, labelled_sample, text_bytes, text_slices, within

DATA = "/root/testdata/sf0.01"
ODD = [(1, None, "en"), (2, "", None), (3, "   \n\n ", "en"), (4, "12345 !!! ###", "en"), (5, "x", None), (5, "x", "en"), (None, "the and of", "en"), (6, "ж" * 50, "en"), (7, "wo rd " * 30_000, "en"), (8, "à ­​ é", "fr"), (9, "\n".join(["line"] * 5000), "en")]


def odd(spark, extra="score double, text_hash long, node int"):
    rows = [(*r, 0.5, 1, 2) for r in ODD]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, {extra}")


def test_suffix_automaton_has_all_substrings():
    text = "abcabxabcd aab"
    a = langid.SuffixAutomaton(text)
    for i, j in itertools.combinations(range(len(text) + 1), 2):
        assert a.phrases(text[i:j]) == 1
    # greedy parse by plain search
    for probe in ("abxabcq", "zzz", "", "bcabab", "aabcdz a"):
        count, at = 0, 0
        while at < len(probe):
            n = 1
            while at + n < len(probe) and probe[at : at + n + 1] in text:
                n += 1
            count, at = count + 1, at + n
        assert a.phrases(probe) == count


def test_vectorised_parse_is_the_plain_one():
    r = random.Random(1)
    words = ["".join(r.choice("abcde") for _ in range(r.randrange(1, 9))) for _ in range(80)]
    model = langid.train({"p": [" ".join(words[:40])], "q": [" ".join(words[40:]) + " ж"]})
    codes = model.code_table()
    plain = [langid.SuffixAutomaton(" ".join(words[:40])), langid.SuffixAutomaton(" ".join(words[40:]) + " ж")]
    probes = [*words, "xyz", "abz", "a1b!", "", "!!", "EDCBA", " ab  cd", "½ ² Ⅷ", "ж Ж ab"]
    probes += [" ".join(r.choice(words) for _ in range(n)) for n in (5, 300, 900)] + [r.choice(words) * 900]
    letters, phrases = model.parse(codes, probes)
    for k, text in enumerate(probes):
        whole = langid.plain(text)
        assert letters[k] == sum(map(str.isalpha, whole))
        if whole and not text[-1].isalpha():
            whole += " "
        parts = [whole[i : i + langid.STRETCH] for i in range(0, len(whole), langid.STRETCH)]
        assert phrases[k].tolist() == [sum(map(a.phrases, parts)) for a in plain]


def test_phrases_cross_words():
    model = langid.train({"a": ["one two three four"], "b": ["xyz"]})
    _, phrases = model.parse(model.code_table(), ["one two three four", "two three"])
    assert phrases[:, 0].tolist() == [1, 1]


def test_only_letters_of_category_l_count():
    model = langid.train({"a": ["one two"]})
    assert langid.score_texts(model, model.code_table(), ["½ ² Ⅷ", "", "१२३"])[0] == ["und"] * 3


def test_many_characters_need_no_dense_table():
    r = random.Random(3)
    text = "".join(chr(0x4E00 + r.randrange(6_000)) for _ in range(20_000))
    model = langid.train({"zh": [text], "en": ["the and of"]})
    assert len(model.owner) < 4 * 20_000 + 5 * 6_100
    _, phrases = model.parse(model.code_table(), [text[500:1500]])
    assert phrases[0, 1] == 1


def test_languages_on_held_out(spark):
    got = queries.op1_langid(spark, DATA).toPandas()
    truth = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    held = both[both.held_out]
    assert set(held.doc_id) == {i for i in both.doc_id if zlib.crc32(str(i).encode()) % 4 == 2}
    assert (held.lang_pred == held.lang).mean() > 0.96
    assert both.score.between(0, 1).all() and len(both) == len(truth)


def test_language_edge_cases(spark):
    docs = odd(spark)
    model = langid.train({"en": ["the and of with that word line"], "fr": ["le la de et que é"]})
    rows = sorted(langid.identify(docs, model, id_bucket("doc_id", 4) == 2).collect(), key=str)
    assert len(rows) == len(ODD)
    pred = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert [pred[k] for k in (1, 2, 3, 4)] == ["und"] * 4 and pred[7] == "en" and pred[9] == "en"
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()}.isdisjoint({1, 2, 3, 4, 6})
    none = langid.train({})
    assert {r["lang_pred"] for r in langid.identify(docs, none, id_bucket("doc_id", 4) == 2).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model, id_bucket("doc_id", 4) == 2).count() == 0


def test_bounded_sample(spark):
    df = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(2000)] + [(None, None)], "doc_id long, k string")
    rows = bounded_sample(df, "k", "doc_id", 50)
    assert sorted({r["k"]: sum(x["k"] == r["k"] for x in rows) for r in rows}.items()) == [("a", 50), ("b", 50)]
    assert bounded_sample(df.limit(0), "k", "doc_id", 5) == []


def test_labelled_sample_is_bounded_in_characters(spark):
    docs = spark.sql("select id as doc_id, rpad(concat('t', id), cast(if(id < 40, 50, 20000 + id) as int), ' words') as text from range(100)")
    labels = spark.sql("select id as doc_id, cast(id % 2 as int) as toxic from range(100)")
    every = {r["text"]: r["doc_id"] % 2 for r in docs.collect()}

    def sample(most_chars):
        return labelled_sample(docs, labels, "toxic", labels.doc_id >= 0, {0: 100, 1: 100}, 4, most_chars)

    assert sample(None) == sample(10_000_000) == sorted(every.items())
    some = sample(65_000)
    toxic, clean = ([t for t, y in some if y == label] for label in (1, 0))
    assert all(every[t] == 1 for t in toxic)
    lengths = sorted(map(len, toxic))
    assert lengths[:20] == [50] * 20 and len(lengths) == 23 and sum(lengths) <= 65_000
    # the clean ones: a part of each
    parts = [p for t in clean for p in t.split("\n")]
    assert len(parts) == 50 and sum(map(len, parts)) <= 65_000 and min(map(len, parts)) == 50 and max(map(len, parts)) > 2_000
    assert {p.split()[0] for p in parts} == {t.split()[0] for t, y in every.items() if not y}
    assert abs(len(clean) - len(toxic)) <= 2


def test_sample_of_texts_beyond_the_bound():
    assert within([(0, 0, 1, 1), (0, 90, 2, 1), (1, 10, 3, 4), (1, 20, 4, 1)], 40) == [(0, 0, 1, 0), (0, 90, 2, 40), (1, 10, 3, 10)]
    assert within([(0, 10, 1, 2), (0, 90, 2, 2), (1, 50, 3, 4)], 80) == [(0, 10, 1, 10), (0, 90, 2, 30), (1, 50, 3, 20)]
    assert within([], 40) == []


def test_toxicity_of_tables_of_long_texts(spark, tmp_path, monkeypatch):
    """The texts for training are bounded in all, and every text is still scored whole."""
    filler = "the river ran past the quiet mill and nobody spoke of it again. "
    names = ["".join(random.Random(i).choices("bdfglmnrst", k=6)) for i in range(120)]
    rows = [(i, filler * (40 + i) + (f"{names[i]} blockhead {names[i]}. " if i % 2 else f"{names[i]} came. ") + filler * 40) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "MOST_CHARS", 100_000)
    monkeypatch.setattr(toxicity, "train", lambda sample: seen.append(sample) or train(sample))
    got = queries.op4_toxicity(spark, str(tmp_path)).collect()
    assert 0 < sum(len(t) for t, _ in seen[0]) <= 200_000
    assert {y for _, y in seen[0]} == {0, 1}
    assert len(got) == 120 and all(r["predicted"] == r["doc_id"] % 2 for r in got)


def test_languages_learn_from_the_start_of_long_texts(spark, monkeypatch):
    docs = spark.sql("select id as doc_id, 'en' as lang, repeat('some words ', 5000) as text from range(5)")
    seen = []
    train = langid.train
    monkeypatch.setattr(langid, "train", lambda samples, letters: seen.append(samples) or train(samples, letters))
    langid.learn(docs, docs.doc_id >= 0, letters=500)
    assert [len(t) for t in seen[0]["en"]] == [2_000] * 5


def test_slices_keep_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (5, 0, 50, 1, 1)] + [None]})
    parts = list(text_slices([batch], "text", 10))
    assert [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist() and len(parts) > 1
    raw, bounds = text_bytes(batch.column("text").slice(2, 4))
    assert bounds.tolist() == [0, 50, 51, 52, 52] and len(raw) == 52


def test_quality_does_not_depend_on_the_batch():
    model = quality.train([("Good text stands here. It goes on.\nAnd on.", 1), ("BUY NOW!!! buy buy buy | | |\n$$$ win win", 0)] * 5)
    texts = ["ends with word", "word starts so", "word word", None, "", "word", " word\nword"]
    whole, _ = quality.score_batch(model, pa.array(texts))
    assert whole.tolist() == pytest.approx([quality.score_batch(model, pa.array([t], pa.string()))[0][0] for t in texts], abs=1e-9)


def test_quality_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, score string")
    for model in (None, quality.train([("a b.", 1), ("!!", 0)])):
        assert quality.score(docs, model, id_bucket("doc_id", 5) == 0).count() == 0


def chain_by_paths(emission, t):
    """Marginals by adding up all label sequences."""
    total, good = 0.0, np.zeros(len(emission))
    for path in itertools.product((0, 1), repeat=len(emission)):
        s = sum(emission[i] * y for i, y in enumerate(path)) + sum(t[a, b] for a, b in itertools.pairwise(path))
        total += np.exp(s)
        good += np.exp(s) * np.array(path)
    return good / total


def test_forward_backward_against_all_paths():
    r = np.random.default_rng(2)
    lengths = [4, 1, 6, 3]
    doc = np.repeat(np.arange(4), lengths)
    e, t = r.normal(0, 1, len(doc)), r.normal(0, 1, (2, 2))
    got, expected, _ = quality.marginals(e, doc, t)
    want = np.concatenate([chain_by_paths(e[doc == d], t) for d in range(4)])
    assert np.allclose(got, want)
    assert np.isclose(expected.sum(), sum(n - 1 for n in lengths))
    assert len(quality.marginals(np.zeros(0), np.zeros(0, int), t)[0]) == 0


def test_line_features():
    raw, bounds = text_bytes(pa.array(["Ab 1,\n\nword word WORD!!", None, "", "| x", "last\n"]))
    x, size, doc = quality.line_features(raw, bounds)
    assert doc.tolist() == [0, 0, 3, 4] and size.tolist() == [4, 14, 2, 4]
    own = x[:, : quality.OWN]
    assert own[1][7] == pytest.approx(1 / 3)  # one of three words repeats the one before
    assert own[1][0] == pytest.approx(4 / 12) and own[2][6] == pytest.approx(1 / 2)
    assert np.array_equal(x[1, quality.OWN : 2 * quality.OWN], own[0]) and np.array_equal(x[0, 2 * quality.OWN : 3 * quality.OWN], own[1])
    assert not x[2, quality.OWN : 3 * quality.OWN].any()


def test_quality_on_held_out(spark):
    got = queries.op2_quality(spark, DATA).toPandas()
    truth = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    held = got[got.held_out].merge(truth, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.95
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()


def test_quality_edge_cases(spark):
    good, bad = "Some words of a line.\nAnd more words here.", "AB!! CD!! EF!!\nGH!! IJ!! KL!!"
    model = quality.train([(good, 1), (bad, 0)] * 20)
    rows = quality.score(odd(spark), model, id_bucket("doc_id", 5) == 0).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[1] == score[2] == score[3] == model.prior
    assert quality.score_batch(model, pa.array([good]))[0][0] > 0.5 > quality.score_batch(model, pa.array([bad]))[0][0]
    assert {r["score"] for r in quality.score(odd(spark), None, id_bucket("doc_id", 5) == 0).collect()} == {0.5}
    assert quality.score_batch(quality.train([(good, 1)]), pa.array(["x"]))[0][0] > 0.9


def by_pairs(a, b):
    total = 0.0
    for i in itertools.combinations(range(len(a)), toxicity.ORDER):
        for j in itertools.combinations(range(len(b)), toxicity.ORDER):
            if i[-1] - i[0] < toxicity.SPAN and j[-1] - j[0] < toxicity.SPAN and all(a[p] == b[q] for p, q in zip(i, j, strict=True)):
                total += toxicity.DECAY ** (i[-1] - i[0] + j[-1] - j[0] + 2 - 2 * toxicity.ORDER)
    return total


def test_kernel_against_all_pairs():
    words = ["^idiot$", "^idxiot$", "^aba$", "^banana$", "^i$"]
    s = toxicity.Strings(words)
    k = toxicity.kernel(s, words, words) * toxicity.norms(s, words)[None, :]
    for (a, x), (b, y) in itertools.product(enumerate(words), repeat=2):
        assert k[a, b] == pytest.approx(by_pairs(x, y), abs=1e-3)
    alpha = np.array([0.5, -1.0, 2.0, 0.25, 0.0])
    m = toxicity.ToxicityModel(s, words, alpha, 0.125)
    probes = words + ["^bandana$", "^zzz$", "^idioten$"]
    assert np.allclose(m.margins(probes), toxicity.kernel(s, probes, words) @ alpha + 0.125, atol=1e-4)


@pytest.fixture(scope="module")
def toxic_model():
    r = random.Random(3)
    syllables = ["th", "er", "in", "on", "an", "re", "ti", "es", "or", "ha"]
    text = lambda n: " ".join("".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(n))
    insults = ["blockhead", "nincompoop", "scoundrel"]
    sample = [(text(40), 0) for _ in range(200)] + [(f"{text(20)} {r.choice(insults)} {text(20)}", 1) for _ in range(100)]
    return toxicity.train(sample), text


def test_gapped_and_inserted_spellings(toxic_model):
    model, text = toxic_model
    table = TokenTable(model.span_scores, 1)
    for word in ("blockhead", "BLOCKHEAD!!", "b.l.o.c.k.h.e.a.d", "b l o c k h e a d", "bl0ckhead", "block-head", "nincom*poop", "scounxdrel", "scoundrels"):
        assert toxicity.score_texts(model, table, [f"{text(10)} {word} {text(10)}"])[0][0] >= 0.7, word
    clean = toxicity.score_texts(model, table, [text(60) for _ in range(50)])[0]
    assert (clean < 0.7).mean() > 0.96


def test_toxicity_on_held_out(spark):
    got = queries.op4_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    held = got[got.held_out].merge(truth, on="doc_id")
    assert held[held.toxic == 1].predicted.mean() > 0.85
    # these tables have clean words that are spelt like insults
    assert held[held.toxic == 0].predicted.mean() < 0.05


def test_toxicity_edge_cases(spark, toxic_model):
    rows = toxicity.score(odd(spark), toxic_model[0], id_bucket("doc_id", 3) == 1).collect()
    assert len(rows) == len(ODD)
    assert {r["score"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0.0}
    assert toxicity.train([("a b", 1)]) is None
    kept = toxicity.drop_toxic(odd(spark), toxic_model[0])
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD)
    assert {r["score"] for r in toxicity.score(odd(spark), None, id_bucket("doc_id", 3) == 1).collect()} == {0.0}


def test_toxicity_of_an_empty_table(spark, toxic_model):
    docs = spark.createDataFrame([], "doc_id long, text string, span string")
    for model in (None, toxic_model[0]):
        assert toxicity.score(docs, model, id_bucket("doc_id", 3) == 1).count() == 0
        assert toxicity.drop_toxic(docs, model).columns == docs.columns


def test_no_character_is_lost():
    words = ["^" + "".join(chr(0x4E00 + (17 * i + k) % 5_000) for k in range(8)) + "$" for i in range(600)] + ["^ěščřžý$"]
    s = toxicity.Strings(words)
    assert min(toxicity.norms(s, words)) > 1
    m = toxicity.ToxicityModel(s, words[-2:], np.array([0.0, 1.0]), 0.0)
    assert m.margins(["^ěščřžý$", "^ěšxčřžý$", words[0]])[[0, 1]].min() > 0.4


def test_table_of_tokens_is_bounded():
    table = TokenTable(lambda new: np.array([[len(w)] for w in new], np.float32), 1, most=10)
    docs = [[f"{i}" * (1 + i % 5)] * 3 for i in range(100)] + [[]]
    rows, counts = table.lookup(docs)
    assert counts.tolist() == [3] * 100 + [0] and rows[:, 0].tolist() == [len(w) for d in docs for w in d]
    assert table.lookup([])[0].shape == (0, 1)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav>
<article><h1>Big &amp; small</h1><p>One <b>bold</b>
 text.<p>Two<br>lines<script>var a="</p>";</script><aside>More</aside></article><footer>&copy; me</footer>"""


def test_blocks():
    b = html_extract.blocks_of(PAGE)
    assert [(x.text, html_extract.weak_label(x.path)) for x in b] == [("Home", 0), ("Big & small", 1), ("One bold text.", 1), ("Two lines", 1), ("More", 0), ("© me", 0)]
    assert b[0].linked == 4 and b[3].path == ("html", "body", "article", "p")
    assert [x.text for x in html_extract.blocks_of("a<p>b</p>c<div class='x")] == ["a", "b", "c"]
    assert [x.text for x in html_extract.blocks_of("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>x<!-- n -->y")] == ["a", "b", "c", "d", "xy"]
    assert html_extract.blocks_of("") == [] and html_extract.blocks_of("<p> &nbsp; </p>") == []
    assert len(html_extract.blocks_of("<div>" * 3000 + "deep")) == 1


def test_lstm_gradient():
    r = np.random.default_rng(0)
    m = html_extract.Labeller.fresh()
    x, mask = r.normal(0, 1, (2, 4, html_extract.INPUT)).astype("f4"), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], "f4")
    y = r.integers(0, 2, (2, 4)).astype("f4") * mask
    _, grads = m.gradient(x, mask, y)
    for p, g in zip(m.parts(), grads, strict=True):
        at = np.unravel_index(int(np.abs(g).argmax()), p.shape)
        old, eps = p[at], 1e-2
        p[at] = old + eps
        up, _ = m.gradient(x, mask, y)
        p[at] = old - eps
        down, _ = m.gradient(x, mask, y)
        p[at] = old
        assert (up - down) / (2 * eps) == pytest.approx(float(g[at]), rel=0.05, abs=1e-4)


def test_padding_changes_nothing():
    m = html_extract.Labeller.fresh()
    pages = [html_extract.blocks_of(PAGE), html_extract.blocks_of("<p>x</p>" * 9), []]
    together = m.label(pages)
    assert all(np.array_equal(a, m.label([p])[0]) for a, p in zip(together, pages, strict=True))


def test_extraction(spark):
    got = {r["page_id"]: r for r in queries.op6_html(spark, DATA).collect()}
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(got) == len(pages)
    want = {p["page_id"]: " ".join(b.text for b in html_extract.blocks_of(p["html"]) if html_extract.weak_label(b.path)) for p in pages}
    assert np.mean([got[i]["text"] == t for i, t in want.items()]) > 0.98
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_extraction_edge_cases(spark):
    df = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (3, "u", "<script>x", 1), (None, "u", "<p>" + "long " * 50_000, 1), (4, "u", "<<<>>> &#xZZ; <p", 1)], "page_id long, url string, html string, text int")
    rows = html_extract.extract(df, html_extract.Labeller.fresh()).collect()
    assert len(rows) == 5 and {r["text"] for r in rows if r["page_id"] in (1, 2, 3)} == {""}
    assert html_extract.extract(df.limit(0), html_extract.train([])).count() == 0


def test_html_inputs_read_all_words_of_a_block():
    def row(middle):
        return html_extract.inputs([html_extract.Block(("p",), f"one two three four {middle} five six", 0)])[0]

    assert not np.allclose(row("buy it now today"), row("the sea was calm"))
    many = row(" ".join(f"w{i}" for i in range(120_000)))
    assert np.isfinite(many).all() and np.linalg.norm(many[html_extract.PATH_DIM :][: html_extract.WORD_DIM]) < 1


#: Pages written by hand, with their main text; none follows the rules that made the labels.
HAND = [
    (
        "<body><div><a href=/>Start</a> <a href=/n>News</a> <a href=/s>Sport</a></div><div><h1>Ferry service resumes</h1><div>The ferry between the two islands sails again from Monday, the port authority said.</div>"
        "<div>Repairs took six weeks, because a part had to be made anew in a small works up north.</div></div><div><a href=/i>Imprint</a> <a href=/p>Privacy</a></div></body>",
        "Ferry service resumes The ferry between the two islands sails again from Monday, the port authority said. Repairs took six weeks, because a part had to be made anew in a small works up north.",
    ),
    (
        "<body><header><h2>The Daily Bee</h2></header><main><h1>How to prune roses</h1><p>Cut in early spring, when the buds begin to swell. Use a sharp knife.</p><aside>More on gardens</aside><p>Remove dead wood first, then cut back to an outward bud.</p>"
        "<form>Subscribe <input name=m> <button>Go</button></form></main><section class=comments><p>Great advice, thank you so much for this one!</p></section><footer>© The Bee</footer></body>",
        "How to prune roses Cut in early spring, when the buds begin to swell. Use a sharp knife. Remove dead wood first, then cut back to an outward bud.",
    ),
    (
        "<body><div class='cookie notice'>We use cookies on this site. Accept all?</div><nav><a href=a>A</a><a href=b>B</a></nav><div class='post body'><h1>Rain expected</h1><p>Heavy rain will reach the coast tonight, and strong winds will follow it.</p>"
        "<p hidden>Secret text that is not shown to anyone at all.</p><p style='color:red; display: none'>Another one that is not shown.</p><ul><li>Stay at home if you can.</li><li>Keep the windows shut.</li></ul></div><div class=sidebar><p>Read our other stories</p></div></body>",
        "Rain expected Heavy rain will reach the coast tonight, and strong winds will follow it. Stay at home if you can. Keep the windows shut.",
    ),
    (
        "<body><ul class=nav><li><a href=1>One</a><li><a href=2>Two</a></ul><article class=story><header><h1>Old bridge &amp; new road</h1></header><p>The bridge was closed in June. It is over a hundred years old, and its stones are loose.</p><div class=ad>Buy two, get one free</div>"
        "<blockquote><p>We will miss it, said a neighbour.</p></blockquote></article><div class=related><a href=3>Ten bridges to see</a></div><footer><p>All rights reserved.</p></footer></body>",
        "Old bridge & new road The bridge was closed in June. It is over a hundred years old, and its stones are loose. We will miss it, said a neighbour.",
    ),
    (
        "<body><table><tr><td><a href=x>Home</a></td><td><a href=y>Archive</a></td></tr></table><section class=article><h1>A cat of nine years</h1><p>Our cat likes to sleep on warm stones. In winter she sleeps by the stove.</p><p>She came to us as a kitten, one wet evening in autumn.</p></section>"
        "<div class=newsletter>Get our letter each week</div><div class=copyright>© 2021</div></body>",
        "A cat of nine years Our cat likes to sleep on warm stones. In winter she sleeps by the stove. She came to us as a kitten, one wet evening in autumn.",
    ),
]


def overlap(got, want):
    a, b = Counter(got.split()), Counter(want.split())
    both = sum((a & b).values())
    return 2 * both / max(1, sum(a.values()) + sum(b.values()))


@pytest.mark.parametrize(("learned", "mean"), [(True, 0.93), (False, 0.93)])
def test_pages_written_by_hand(spark, learned, mean):
    pages = [r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").orderBy("page_id").limit(200).collect()] if learned else ["<div>no article here</div>"]
    got = html_extract.extract_texts(html_extract.train(pages), [h for h, _ in HAND])
    scores = [overlap(g, w) for g, (_, w) in zip(got, HAND, strict=True)]
    assert np.mean(scores) > mean, (scores, got)


def test_hidden_elements():
    text = lambda page: [b.text for b in html_extract.blocks_of(page)]
    assert text("<p hidden>a</p><p>b</p>") == ["b"] and text("<div class='hidden x'>a</div>") == ["a"]
    assert text("<div style=\"display:none\"><p>a</p></div>b") == ["b"] and text("<p data-x='not hidden'>a</p>") == ["a"]
    assert text("a <span hidden=until-found>b</span> c") == ["a c"] and text("<p style='display:block'>a none</p>") == ["a none"]
