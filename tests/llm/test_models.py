"""Page texts, toxicity, mixing and URL filters."""

import datetime
import html
import re

import numpy as np
import pytest

from sensorloom.llm import html_text, mixing, toxicity, url_filter
from tests.llm.frames import LONG, collected, documents, odd_rows

SF = "/root/testdata/sf0.01"

# main text

PAGES = [
    (None, ""),
    ("", ""),
    ("   ", ""),
    ("plain text, no markup", "plain text, no markup"),
    ("<p>One &lt;b&gt; &amp; two.</p>", "One <b> & two."),
    ("<p>Broken   up\n by <b>in</b>line <br>tags</p>", "Broken up by inline tags"),
    ("<script>var a='<p>x, y.</p>'", ""),
    ("<!-- <p>gone</p> --><p>Here, it is.</p><!-- never ends <p>gone</p>", "Here, it is."),
    ("<nav>Menu, all.</nav><article><h1>Title</h1><p>First.<p>Second, too.</article><footer>Foot, note.</footer>", "Title\n\nFirst.\n\nSecond, too."),
    (
        "<body><header><h1>Site</h1></header><div id=main><h2>Head</h2><p>Some text, and more. Yes.</p><ul><li>one<li>two</ul></div>"
        "<div class='sidebar x'><p>Aside, long text. It goes on, and on.</p></div><div id='comments'><p>I think, so. Do I?</p></div>"
        "<form>Name <input></form><div hidden>No, no.</div></body>",
        "Head\n\nSome text, and more. Yes.\n\none\n\ntwo",
    ),
    ("<article><p>a, b.</p><aside>no</aside><div class=comments><p>c, c.</p></div><table><tr><td>x<td>y</table></article>", "a, b.\n\nx\n\ny"),
    ("<div class=ad>Only an advert, here.</div>", ""),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


PROSE = "".join(f"<p>Paragraph {k}, with some more words in it, and a few marks; all of it is text.</p>" for k in range(12))
WHOLE_PAGES = [
    f"<nav><a>Menu</a></nav><main><h1>Title</h1><p>Lead</p><article>{PROSE}</article></main><footer>Foot, note.</footer>",
    f"<body><article><h2>Part one</h2>{PROSE}</article><article><h2>Part two</h2><p>Short, but text.</p></article></body>",
    f"<article><h2 id='social-history'>History</h2>{PROSE}<section id=discussion><h3 id='legal-form'>Form</h3><p>Words, here.</p></section></article>",
    f"<article>{PROSE}<div class='share-price'>12 a share</div><p data-id=ad>Last, one.</p></article>",
]


@pytest.mark.parametrize("page", WHOLE_PAGES)
def test_nothing_but_furniture_goes(page):
    inner = re.sub("<nav>.*?</nav>|<footer>.*?</footer>", "", page)
    assert html_text.main_text(page).split("\n\n") == [t for t in re.split("<[^>]*>", inner) if t]


def test_furniture_within_an_article_goes():
    page = f"<article>{PROSE}<div class='box ad'>Buy, now.</div><div class='share'>Share it</div><div hidden>No.</div></article>"
    assert html_text.main_text(page) == html_text.main_text(f"<article>{PROSE}</article>")


def test_long_and_hostile_pages():
    body = "".join(f"<p>{k}, {LONG[: 50 + k]}.</p>" for k in range(2000))
    assert html_text.main_text(f"<article>{body}</article>").count("\n\n") == 1999
    for page in ("<a '" * 50_000, "<div>" * 5_000, "<p>x" * 20_000, "<" * 100_000, "&" * 100_000):
        html_text.main_text(page)


def test_pages_of_the_test_table(spark):
    """The article element is the text there; everything else on those pages is furniture."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").selectExpr("page_id", "url", "html", "'x' as text", "1 as n_chars")
    got = {r["page_id"]: r["text"] for r in html_text.extracted(pages).collect()}
    for row in pages.collect():
        article = re.search("<article>(.*?)</article>", row["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:h1|p)[^>]*>", article))
        assert got[row["page_id"]] == "\n\n".join(filter(None, blocks))


def test_pages_keep_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>a, b.</p>"), (2, "v", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert collected(html_text.extracted(pages)) == sorted([(1, "u", ""), (1, "u", ""), (None, None, "a, b."), (2, "v", "")], key=repr)
    assert collected(html_text.extracted(pages.limit(0))) == []


# toxicity


def test_gradient_of_the_ordinal_loss():
    draw = np.random.default_rng(1)
    x, grade = (draw.random((40, 6)) < 0.4).astype(float), draw.integers(0, 4, 40)
    at = draw.normal(size=9) * 0.5
    value, gradient = toxicity._loss(at, x, grade, 3, 0.3)
    for k in range(9):
        step = np.zeros(9)
        step[k] = 1e-6
        slope = (toxicity._loss(at + step, x, grade, 3, 0.3)[0] - toxicity._loss(at - step, x, grade, 3, 0.3)[0]) / 2e-6
        assert slope == pytest.approx(gradient[k], abs=1e-6)


def test_ordinal_model_recovers_grades():
    draw = np.random.default_rng(2)
    x = (draw.random((3000, 5)) < 0.4).astype(float)
    z = x @ np.array([3.0, 2.0, 1.0, 0.0, -2.0]) + draw.logistic(size=3000)
    grade = np.digitize(z, [1.0, 3.0, 5.0])
    model = toxicity.fit_ordinal(x, grade, list("abcde"), penalty=1e-3)
    assert model.thresholds == tuple(sorted(model.thresholds)) and len(model.thresholds) == 3
    np.testing.assert_allclose(model.thresholds, [1, 3, 5], atol=0.4)
    np.testing.assert_allclose(list(model.weights.values()), [3, 2, 1, 0, -2], atol=0.3)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels.filter("doc_id % 10 < 7"))
    scored = toxicity.score(docs, model).join(labels.filter("doc_id % 10 >= 7 and quality = 1").withColumnRenamed("toxic", "label"), "doc_id")
    rows = scored.select("label", "toxic", "expected_severity", "grade").collect()
    caught = sum(r["toxic"] for r in rows if r["label"]) / sum(r["label"] for r in rows)
    wrong = sum(r["toxic"] for r in rows if not r["label"]) / sum(not r["label"] for r in rows)
    assert caught > 0.9 and wrong < 0.01
    assert all(0 <= r["expected_severity"] <= 2 and 0 <= r["grade"] <= 2 for r in rows)


def test_toxicity_on_odd_rows(spark):
    rows = odd_rows() + [(200 + k, f"you {'awfulword' if k % 2 else 'niceword'} number {k}") for k in range(60)]
    docs = documents(spark, rows)
    labels = [(200 + k, 1, k % 2) for k in range(60)] + [(None, 1, 1), (203, 1, None), (999, 0, 1), (201, 1, 0)]
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, frame)
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == len(rows)
    assert {r["doc_id"] for r in scored if r["toxic"]} == {200 + k for k in range(1, 60, 2)}
    empty = toxicity.fit(docs, frame.limit(0))
    assert {r["expected_severity"] for r in toxicity.score(docs, empty).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_labels_without_a_document_take_no_place_in_the_sample(spark):
    docs = documents(spark, [(k, f"text {k}") for k in range(60)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(6000)], "doc_id bigint, toxic int")
    sample = toxicity.labelled_sample(docs, labels, 40, "doc_id", "text", "toxic")
    assert sample.count() == 40


# mixing

MARGINS = (
    mixing.Margin("source", (("src0", 0.5), ("src1", 0.3)), rest=0.2),
    mixing.Margin("lang", (("en", 0.4),), rest=0.6),
)


def test_raked_shares_meet_every_margin():
    totals = {(s, g): float(n) for s, g, n in [("a", "x", 5), ("a", "y", 50), ("b", "x", 20), ("b", "y", 1), ("c", "x", 9)]}
    margins = (mixing.Margin("s", (("a", 0.2), ("b", 0.5)), rest=0.1), mixing.Margin("g", (("x", 0.7), ("y", 0.3))))
    share = mixing.rake(totals | {("c", "x"): 0.0}, margins, 200)
    assert sum(v for (s, _), v in share.items() if s == "a") == pytest.approx(0.2 / 0.7, abs=0.05)
    assert sum(v for (_, g), v in share.items() if g == "x") == pytest.approx(0.7, abs=1e-6)


def mixing_frame(spark, rows=None):
    docs = documents(spark, rows)
    return docs.select("doc_id", "source", "lang", mixing.word_count(docs["text"]).alias("tokens"), "_id", "keep")


def test_expected_tokens_have_the_target_shares(spark):
    rows = mixing.mixed(mixing_frame(spark), MARGINS, rounds=60).collect()
    assert len(rows) == len(odd_rows())
    kept = lambda test: sum(r["tokens"] * r["probability"] for r in rows if test(r))
    whole = kept(lambda r: True)
    assert kept(lambda r: r["source"] == "src0") / whole == pytest.approx(0.5, abs=1e-6)
    assert kept(lambda r: r["source"] == mixing.OTHER) / whole == pytest.approx(0.2, abs=1e-6)
    assert kept(lambda r: r["lang"] == "en") / whole == pytest.approx(0.4, abs=1e-6)
    assert max(r["probability"] for r in rows) == 1 and min(r["probability"] for r in rows) >= 0


def test_draws_depend_on_the_id_only(spark):
    one = collected(mixing.mixed(mixing_frame(spark), MARGINS))
    assert one == collected(mixing.mixed(mixing_frame(spark).repartition(7), MARGINS))
    assert collected(mixing.mixed(mixing_frame(spark, []), MARGINS)) == []
    silent = mixing.mixed(mixing_frame(spark, [(1, None), (2, " ")]), MARGINS).collect()
    assert [(r["probability"], r["sampled"]) for r in silent] == [(1.0, True)] * 2


def test_one_rare_row_does_not_lower_the_yield(spark):
    """150 rows of each of four cells that can meet every target at half of the tokens, then one row of a language not listed."""
    margins = mixing.Mix((mixing.Margin("source", (("src0", 0.5),), rest=0.5), mixing.Margin("lang", (("en", 0.6),), rest=0.02)), 0.5)
    rows = [(k, f"src{k % 2}", "en", 100) for k in range(600)]
    schema = "doc_id bigint, source string, lang string, tokens bigint"
    clean = mixing.mixed(spark.createDataFrame(rows, schema), margins).collect()
    mixed_in = mixing.mixed(spark.createDataFrame([*rows, (600, "src1", None, 200)], schema), margins).collect()
    plain = mixing.mixed(spark.createDataFrame([*rows, (600, "src1", None, 200)], schema), tuple(margins)).collect()
    expected = lambda found: sum(r["tokens"] * r["probability"] for r in found) / sum(r["tokens"] for r in found)
    assert expected(clean) == pytest.approx(0.5) and expected(mixed_in) == pytest.approx(0.5)
    assert expected(plain) < 0.12
    assert max(r["probability"] for r in mixed_in) == 1.0
    assert sum(r["sampled"] for r in mixed_in) > 250
    src0 = sum(r["tokens"] * r["probability"] for r in mixed_in if r["source"] == "src0")
    assert src0 / sum(r["tokens"] * r["probability"] for r in mixed_in) == pytest.approx(0.5, abs=0.01)


def test_a_budget_meets_the_targets_that_can_be_met():
    totals = {("a", "x"): 10.0, ("a", "y"): 500.0, ("b", "x"): 400.0, ("b", "y"): 300.0}
    margins = (mixing.Margin("s", (("a", 0.5), ("b", 0.5))), mixing.Margin("g", (("x", 0.3), ("y", 0.7))))
    taken = mixing.budgeted(totals, margins, 60, 0.5)
    assert all(taken[c] <= totals[c] * (1 + 1e-9) for c in totals)
    assert sum(taken.values()) == pytest.approx(605)
    assert taken["a", "x"] + taken["a", "y"] == pytest.approx(302.5, rel=1e-3)
    assert taken["a", "x"] + taken["b", "x"] == pytest.approx(181.5, rel=1e-3)


# url filters


def test_sample_is_bounded_where_ids_repeat(spark):
    rows = [(k % 5, f"good word number w{k}") for k in range(400)] + [(7, None), (None, "x")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(5)] + [(7, 1), (None, 1)], "doc_id bigint, toxic int")
    for limit in (10, 50, 1000):
        got = toxicity.labelled_sample(documents(spark, rows), labels, limit, "doc_id", "text", "toxic").collect()
        assert len(got) == min(limit, 401)
        assert {r["_id"] for r in got} <= {0, 1, 2, 3, 4, 7}
    assert collected(toxicity.score(documents(spark, rows), toxicity.fit(documents(spark, rows), labels)))


def plain_verdicts(captures, entries):
    lists = {}
    for key, day, action in entries:
        if key and day and action in ("block", "allow"):
            days = lists.setdefault(key.lower().removesuffix("."), {})
            days[day] = max(action, days.get(day, ""))
    out = []
    for page, url, day in captures:
        found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*?)\.?(?::[0-9]*)?(?:[/?#]|$)", url or "")
        host = found[1].lower() if found else ""
        verdict = (None, None, None)
        labels = host.split(".") if host else []
        for k in range(len(labels)):
            key = ".".join(labels[k:])
            active = [d for d in lists.get(key, {}) if day and d <= day]
            if active:
                verdict = (key, lists[key][max(active)], max(active))
                break
        out.append((page, url, day, host, *verdict, verdict[1] == "block"))
    return sorted(out, key=repr)


def day(text):
    return datetime.date.fromisoformat(text)


CAPTURES = [
    (1, "http://a.b.example.com/x?y=http://c.com", day("2024-03-05")),
    (2, "https://user@EXAMPLE.com.:8080/", day("2024-01-31")),
    (3, "https://b.example.com", day("2024-02-01")),
    (4, "https://b.example.com#t", day("2024-12-31")),
    (5, None, day("2024-02-01")),
    (6, "not a url", day("2024-02-01")),
    (7, "http://b.example.com/late", None),
    (8, "http://other.org", day("2023-01-01")),
    (8, "http://other.org", day("2023-01-01")),
    (None, "http://example.com/", day("2024-06-15")),
]
ENTRIES = [
    ("example.com", day("2024-01-31"), "block"),
    ("example.com", day("2024-06-01"), "allow"),
    ("example.com", day("2024-06-01"), "block"),
    ("B.Example.com.", day("2024-02-01"), "allow"),
    ("b.example.com", day("2024-11-30"), "block"),
    ("a.b.example.com", day("2024-03-06"), "block"),
    ("com", day("2020-02-29"), "allow"),
    ("org", day("2023-01-01"), "block"),
    (None, day("2023-01-01"), "block"),
    ("other.org", None, "block"),
    ("other.org", day("2022-01-01"), "unknown"),
    ("other.org", day("2022-01-01"), None),
]


def test_url_filter(spark):
    captures = spark.createDataFrame([(*c, "x", "y") for c in CAPTURES], "page_id bigint, url string, fetched date, key string, month string")
    entries = spark.createDataFrame(ENTRIES, "key string, day date, action string")
    assert collected(url_filter.evaluate(captures, entries)) == plain_verdicts(CAPTURES, ENTRIES)
    assert collected(url_filter.evaluate(captures.limit(0), entries)) == []
    assert collected(url_filter.evaluate(captures, entries.limit(0))) == plain_verdicts(CAPTURES, [])


def test_url_filter_with_many_entries_of_one_host(spark):
    days = [day("2021-01-01") + datetime.timedelta(days=3 * k) for k in range(500)]
    entries = [("hot.net", d, "block" if k % 2 else "allow") for k, d in enumerate(days)]
    captures = [(k, "http://hot.net/p", day("2020-12-25") + datetime.timedelta(days=k)) for k in range(0, 1600, 7)]
    got = url_filter.evaluate(
        spark.createDataFrame(captures, "page_id bigint, url string, fetched date"), spark.createDataFrame(entries, "key string, day date, action string")
    )
    assert collected(got) == plain_verdicts(captures, entries)
