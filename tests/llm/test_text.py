"""Language identification, toxicity and main text of pages."""

import html
import random
import re

import pytest

from oppflow.llm import language, toxicity
from oppflow.llm.html_text import extract_text, main_text
from oppflow.llm.queries import QUERIES


def documents(spark, rows):
    return spark.createDataFrame(
        [(i, t, l, "x", 1.0) for i, t, l in rows], "doc_id long, text string, lang string, lang_pred string, score double")


EN = "the house and the people of this town with that thing which they have been thinking about"
DE = "das haus und die leute dieser stadt mit jenem ding über das sie nachgedacht haben und nicht weiter"
FR = "la maison et les gens de cette ville avec une chose dont ils ont beaucoup parlé depuis toujours"


def shuffled(text, seed, n):
    rng, words = random.Random(seed), text.split()
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    return language.fit([(shuffled(t, k, 60), name) for name, t in (("en", EN), ("de", DE), ("fr", FR)) for k in range(8)])


def test_language_cases(spark, model):
    rows = [(1, EN, None), (2, DE, "en"), (3, None, None), (4, "", "en"), (5, "12 -- 34", "en"), (6, EN + " " + shuffled(FR, 2, 4), None),
            (7, shuffled(DE, 3, 40_000), None), (8, EN, None), (8, EN, None), (None, FR, None)]
    got = {}
    for r in language.languages(documents(spark, rows), model).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert {i: r[0].lang_pred for i, r in got.items()} == {
        1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "en", 7: "de", 8: "en", None: "fr"}
    assert len(got[8]) == 2 and got[5][0].score == 0 and got[5][0].languages == []
    assert all(0 <= r.score <= 1 for rs in got.values() for r in rs)
    assert language.languages(documents(spark, []), model).collect() == []
    assert {r.lang_pred for r in language.languages(documents(spark, rows), None).collect()} == {"und"}
    kept = language.drop_unknown(documents(spark, rows), model)
    assert kept.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 6, 7, 8, 8]


def test_mixture(model):
    shares = language.infer([shuffled(EN, 1, 300) + " " + shuffled(DE, 2, 100), shuffled(FR, 3, 200)], model)
    en, de, fr = (model.languages.index(x) for x in ("en", "de", "fr"))
    assert abs(shares[0, en] - 0.75) < 0.1 and abs(shares[0, de] - 0.25) < 0.1 and shares[0, fr] == 0
    assert shares[1, fr] == 1 and (shares[1] > 0).sum() == 1


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op2_language"](spark, sf_dir).join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def ordinary(seed, n=120):
    return shuffled(EN + " " + DE + " " + FR, seed, n)


def test_toxicity_fit_and_score(spark):
    rng = random.Random(1)

    def toxic(seed):
        words = ordinary(seed).split()
        for _ in range(4):
            words.insert(rng.randrange(len(words)), rng.choice(["worthless", "pathetic", "disgusting", "grumblosch"]))
        return " ".join(words)

    train = [(ordinary(k), 0) for k in range(120)] + [(toxic(k), 1) for k in range(200, 260)]
    model = toxicity.fit(train)
    assert {w[:6] for w in model.specific.decode().split()} >= {"worthl", "pathet", "disgus", "grumbl"}
    clean, bad = [ordinary(k) for k in range(500, 600)], [toxic(k) for k in range(600, 700)]
    assert (toxicity.scores(clean, model) < 0.7).mean() > 0.97
    assert (toxicity.scores(bad, model) >= 0.7).mean() > 0.9
    rows = [(1, clean[0], None), (2, bad[0], None), (3, None, None), (4, "", None), (5, ordinary(1, 60_000) + " " + bad[1], None),
            (2, bad[0], None)]
    got = sorted((r.doc_id, round(r.score, 6)) for r in toxicity.toxicity_scores(documents(spark, rows), model).collect())
    scores = dict(got)
    assert len(got) == 6 and scores[2] >= 0.7 > scores[1] and scores[3] == scores[4] < 0.7
    kept = toxicity.drop_toxic(documents(spark, rows), model)
    assert kept.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert {r.doc_id for r in kept.collect()} >= {1, 3, 4} and not kept.where("doc_id = 2").collect()
    assert toxicity.toxicity_scores(documents(spark, []), model).collect() == []
    assert toxicity.scores(["x"], toxicity.fit([("only", 0)])).tolist() == [0.0]


def test_windows_do_not_depend_on_company():
    model = toxicity.fit([(ordinary(k), 0) for k in range(30)] + [(ordinary(k) + " worthless " * 3 + ordinary(k, 5), 1) for k in range(30)])
    texts = [ordinary(k, 20 + 40 * k) for k in range(20)] + [""]
    alone = [toxicity.scores([t], model)[0] for t in texts]
    assert toxicity.scores(texts, model) == pytest.approx(alone, rel=1e-9)


ARTICLE = "<article><h1>Head &amp; more</h1><p>First, with <b>bold</b> and\n a <a href=x>link</a>. Long enough, yes.<p>Second<br>line.</article>"


@pytest.mark.parametrize("page,text", [
    ("", ""),
    (ARTICLE, "Head & more\n\nFirst, with bold and a link. Long enough, yes.\n\nSecond line."),
    ("<nav><a>Home</a></nav>" + ARTICLE + "<footer>&copy; 2020, all.</footer>",
     "Head & more\n\nFirst, with bold and a link. Long enough, yes.\n\nSecond line."),
    ("<script>var t='</p><p>no';</script><style>p{}</style><!-- <p>no</p> -->" + ARTICLE + "<div class='comments'><p>Reader says, hm.</div>",
     "Head & more\n\nFirst, with bold and a link. Long enough, yes.\n\nSecond line."),
    ("<div class=\"cookie-notice\"><p>We use cookies, really.</p></div><form><p>Mail, please.</form>" + ARTICLE + "<aside><p>Side, bar.</aside>",
     "Head & more\n\nFirst, with bold and a link. Long enough, yes.\n\nSecond line."),
    ("<p>unclosed <b>text, goes on", "unclosed text, goes on"),
    ("<ul><li><a href=1>One</a><li><a href=2>Two</a></ul><div><p>" + "Real text, with marks. " * 10 + "</div>",
     ("Real text, with marks. " * 10).strip()),
    ("plain text, no markup", "plain text, no markup"),
    ("<p>a&nbsp;&lt;b&gt; &#65;&am</p>", "a <b> A&am"),
    ("<p title='a>b'>kept, here</p>", "kept, here"),
])
def test_main_text(page, text):
    assert main_text(page) == text


def test_unclosed_tags_take_linear_time():
    assert main_text("<a " * 60_000 + "<p>end, here") .endswith("end, here")


def test_deep_page():
    page = "<div>" * 3000 + "<p>deep, down</p>" + "<b>" * 3000
    assert main_text(page) == "deep, down"


def test_pages_table(spark, sf_dir):
    """Every article of the test pages, block by block."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = QUERIES["op4_html_extraction"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search("<article>(.*?)</article>", pages[r.page_id], re.S).group(1).replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_null_and_repeated_pages(spark):
    rows = [(1, "u", None, "x"), (1, "u", "<p>a, b</p>", "y"), (1, "u", "<p>a, b</p>", "y"), (None, None, "<p>c, d</p>", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(r.text for r in extract_text(df).collect()) == ["", "a, b", "a, b", "c, d"]
    assert extract_text(df.limit(0)).collect() == []


def test_fit_sample_is_bounded_and_even(spark):
    from oppflow.llm.samples import sample_per_label

    df = spark.range(20_000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    label = spark.range(20_000).selectExpr("id AS _id", "CAST(id % 100 = 0 AS int) AS _label")
    rows = sample_per_label(df, label, 150, 100, "doc_id", "text")
    assert sum(y for _, y in rows) == 150 and len(rows) == 300
    assert rows == sample_per_label(df.repartition(3), label, 150, 100, "doc_id", "text")
    assert all(len(t) <= 4 for t, _ in sample_per_label(df, label, 150, 4, "doc_id", "text"))
