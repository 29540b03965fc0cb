"""Language, quality and main-text rules."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalkit.llm import html_text, langid, quality, queries
from evalkit.llm.common_words import COMMON_WORDS

from .helpers import edge_rows, edge_table, empty_table, prose

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    rows = queries.op3(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = rows.filter("held_out")
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count() > 0
    assert rows.filter("score < 0 or score > 1").count() == 0


def test_language_edge_rows(spark):
    texts = ["the cat and the dog of the house"] * 3 + ["der hund und die katze in dem haus"] * 3
    model = langid.fit(texts * 5, (["en"] * 3 + ["de"] * 3) * 5)
    rows = langid.predict(edge_table(spark, {"score": "x", "rejected": "y"}), model).collect()
    for r, (_, text, *_rest) in zip(rows, edge_rows()):
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in ("en", "de") and 0 < r.score <= 1
    none = langid.train(empty_table(spark))
    assert [r.lang_pred for r in langid.predict(edge_table(spark), none).select("lang_pred").distinct().collect()] == ["und"]
    assert langid.predict(empty_table(spark), model).count() == 0


def test_language_learns_nothing_held_out(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("abc def").alias("text"),
                                   F.when(langid.held_out(F.col("id")), "no").otherwise("yes").alias("lang"))
    assert langid.train(docs).languages == ["yes"]


def brute_base(text: str) -> list[int]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else set()
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)]


def test_base_counts():
    features = quality.Features(sorted({w for ws in COMMON_WORDS.values() for w in ws}))
    texts = ["", "a", "a b a b a b", "x\n\nx\nx \n y", "# é b\x1cc | <p>\t*", prose(3, 400), (prose(9, 30) + "\n") * 4]
    for t in texts:
        assert features(t)[0] == brute_base(t), t
    chars = features("Ab 1,\n#")[1]
    assert dict(zip(quality.CHAR_CLASSES, chars)) == dict(lower=1, upper=1, letter=0, mark=0, digit=1, space=1, line=1,
                                                          stop=1, symbol=1, other=0)


def test_jensen_shannon_distance():
    p, q = np.array([[3.0, 1.0, 0.0]]), np.array([[1.0, 1.0, 2.0]])
    a, b = p[0] / 4, q[0] / 4
    m = (a + b) / 2
    kl = lambda x: sum(i * math.log2(i / j) for i, j in zip(x, m) if i)
    assert quality.distances(p, q)[0, 0] == pytest.approx(math.sqrt((kl(a) + kl(b)) / 2))
    assert quality.distances(p, p * 7)[0, 0] == pytest.approx(0, abs=1e-6)
    assert quality.distances(np.array([[1.0, 0]]), np.array([[0, 5.0]]))[0, 0] == pytest.approx(1)


def test_quality_keeps_prose_and_drops_noise(spark):
    junk = " ".join(f"{w}###" for w in prose(5, 200).split())
    rows = [(i, prose(i, 150), "en") for i in range(60)] + [(100, junk, "en"), (101, "too short", "en"),
                                                         (102, prose(1, 10) * 1 + " same old line" * 60, "en"),
                                                         (103, prose(7, 150), "xx"), (104, prose(8, 150), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert all(got[i].kept for i in range(60)) and got[103].kept and got[104].kept
    assert not got[100].kept and not got[100].base_failed
    assert got[101].base_failed and got[102].base_failed and not got[102].kept


RARE = "rzeka kamień zielony okno papier cichy ogród list muzyka zima droga dom pies kot stół krzesło niebo".split()


def rare_prose(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(str(w) + (str(k) if k % 3 == 0 else "") for w, k in zip(r.choice(RARE, n), r.integers(0, 40, n)))


def test_quality_keeps_a_language_without_a_reference(spark):
    """Clean texts of a language too rare for a reference are kept on the base rules."""
    rows = [(i, prose(i, 300), "en") for i in range(60)] + [(100 + i, rare_prose(i, 300), "pl") for i in range(19)]
    rows += [(200, "za krótki", "pl")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[100 + i].kept and got[100 + i].word_distance is None for i in range(19))
    assert got[200].base_failed and not got[200].kept


def test_quality_references_past_the_most_frequent_languages(spark):
    """Each language is judged by its own reference, however many languages there are."""
    junk = " ".join(f"{w}###" for w in rare_prose(5, 200).split())
    nameless = [(5003, rare_prose(7, 150), None), (5004, junk, None)]
    rows = nameless + [(1000 * k + i, (prose if k < 2 else rare_prose)(i, 150), lang) for k, lang in enumerate(("en", "de", "pl", "cs"))
            for i in range(40 - k)] + [(5000, junk, "pl"), (5001, junk, "cs"), (5002, prose(3, 150), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {r.doc_id: r for r in quality.judge(docs).collect()}
    got = {r.doc_id: r for r in quality.judge(docs, block_languages=2).collect()}
    assert got == want and len(got) == len(rows)
    assert [got[i].kept for i in (2000, 3000, 5000, 5001, 5002)] == [True, True, False, False, True]


def hand_histograms(text: str) -> tuple[Counter, Counter]:
    """Character classes and common words of a text, from their definitions."""
    import unicodedata
    classes = {"Ll": "lower", "Lu": "upper", "Lt": "upper", "Lm": "letter", "Lo": "letter", "Mn": "mark", "Mc": "mark", "Nd": "digit"}

    def of(c: str) -> str:
        if c in "#*$%&|<>":
            return "symbol"
        if c in ".,;:!?":
            return "stop"
        return "line" if c == "\n" else "space" if c in " \t" else classes.get(unicodedata.category(c), "other")
    words = [w.lower().strip(".,;:!?'\"()-") for w in re.split("[ \t-\r]+", text) if w]
    return Counter(map(of, text)), Counter(w if w in STOP else "" for w in words)


def hand_distance(p: Counter, q: Counter) -> float:
    p, q = ({k: v / sum(x.values()) for k, v in x.items()} for x in (p, q))
    mid = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in p.keys() | q.keys()}
    kl = lambda a: sum(v * math.log2(v / mid[k]) for k, v in a.items() if v)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def test_quality_verdicts_match_distances_by_hand(spark):
    rows = [(i, prose(i, 60 + 5 * i), "en") for i in range(40)] + [(100 + i, rare_prose(i, 80 + i), "pl") for i in range(30)]
    rows += [(200, "### $$$ %%% " * 40, "en"), (201, prose(1, 60) + " 1 2 3 4 5 6 7" * 30, "en"), (202, prose(2, 90), None),
             (203, " ".join(prose(3, 400).split()[::2]) + " XX" * 200, "en"), (204, rare_prose(4, 70), None)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    hists = {i: hand_histograms(t) for i, t, _ in rows}
    refs: dict = {}
    for i, t, lang in rows:
        if lang and not got[i].base_failed:
            c, w = refs.setdefault(lang, (Counter(), Counter()))
            c.update(hists[i][0]), w.update(hists[i][1])
    for i, t, lang in rows:
        far = {k: [hand_distance(h, r) for h, r in zip(hists[i], ref)] for k, ref in refs.items()}
        char, word = far[lang] if lang else min(far.values(), key=sum)
        n = len([w for w in re.split("[ \t-\r]+", t) if w])
        near = ((len(t) < 200 or char <= quality.MAX_CHAR_DISTANCE)
                and (n < 50 or word <= quality.MAX_WORD_DISTANCE + quality.NOISE / math.sqrt(n)))
        assert (got[i].char_distance, got[i].word_distance) == (pytest.approx(char, abs=1e-9), pytest.approx(word, abs=1e-9)), i
        base = brute_base(t)
        assert got[i].kept == (base[0] >= 50 and 100 * base[4] <= 50 * base[0] and near)
    assert {got[i].kept for i, _, _ in rows} == {True, False}


def test_quality_edge_rows(spark):
    rows = quality.judge(edge_table(spark, {"kept": "x", "n_words": "y"})).collect()
    assert [r.n_words for r in rows] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in sorted(
        edge_rows(), key=lambda x: 0)] or len(rows) == 11
    assert {r.kept for r in rows if r.n_words < 50} == {False}
    assert quality.judge(empty_table(spark)).count() == 0


def test_op5_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = queries.op5(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        if len(texts[r.doc_id] or "") < 8000:
            assert [r[n] for n in quality.BASE] == brute_base(texts[r.doc_id] or "")
            failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
            assert r.base_failed == failed and not (failed and r.kept)


STOP = frozenset(w for ws in COMMON_WORDS.values() for w in ws)
BODY = ("The keeper of the garden was not in the house, and it is said that he had been at the river with the others "
        "for most of the day. They will be back in the evening, as they were on the day before, with the boat and the "
        "nets and all that is in it for the winter.")


def page(*parts: str) -> str:
    return "<html><head><title>T</title><style>p{}</style></head><body>" + "".join(parts) + "</body></html>"


@pytest.mark.parametrize("html, text", [
    (page(f"<article><h1>Head</h1><p>{BODY}<p>Short one.</article>"), f"Head {BODY} Short one."),
    (page("<nav><a href=x>Home</a></nav>", f"<div id=main><p>{BODY}</p><p>Yes.</p></div>", "<footer>The end.</footer>"),
     f"{BODY} Yes."),
    (page(f"<p>{BODY}</p><div class='comments'><p>{BODY}</p></div><div class=cookie-notice>{BODY}</div>"), BODY),
    (page("<ul><li><a href=a>One thing</a></li><li><a href=b>Other</a></li></ul>", f"<p>{BODY}</p>"), BODY),
    (page(f"<form><p>{BODY}</p><input></form><aside>{BODY}</aside><script>var a='<p>x</p>';</script><p>{BODY}</p>"), BODY),
    (page("<article><p>a&amp;b &lt;c&gt;&nbsp;&eacute;  <b>d</b>e<br>f</p></article>"), "a&b <c> é de f"),
    ("<article><p>cut off he", "cut off he"), ("", ""), (None, ""), ("plain words", "plain words"),
    (page("<!-- <p>no</p> --><article><p>This.</p></article>"), "This."),
    (page(f"<header>Site</header><article><header><h1>Own</h1></header><p>{BODY}</p></article>"), f"Own {BODY}"),
])
def test_main_text(html, text):
    assert html_text.main_text(html, STOP) == text


LINKS = "<ul>" + "".join(f"<li><a href=x{i}>Another story of the day</a></li>" for i in range(4)) + "</ul>"
ADVERT = "Buy cheap watches online today: best prices, free shipping, limited offer, order now, premium quality! "
ADVERT = (ADVERT * 2).strip()


@pytest.mark.parametrize("name", ["user-comments", "reader-comments", "comment-thread", "discussion", "responses", "reviews",
                                  "fb-comments", "comments-section", "kommentarbereich", "post-comments", "commentaires"])
@pytest.mark.parametrize("inside", [True, False])
def test_comments_under_any_name_are_left_out(name, inside):
    comments = f"<div class='{name}'><div><b>Ann</b> 3 hours ago<p>{BODY[:120]}</p></div><div><b>Bob</b><p>No, it is not.</p></div></div>"
    own = f"<h1>Head</h1><p>{BODY}</p><p>{BODY}</p><p>{BODY}</p>"
    html = page(f"<main>{own}{comments}</main>") if inside else page(f"<div>{own}</div>", comments)
    assert html_text.main_text(html, STOP) == f"Head {BODY} {BODY} {BODY}"


@pytest.mark.parametrize("name", ["post tags", "page promo", "content sponsored", "reviews", "has-comments", "no-comments", "comments-open",
                                  "discussion-body"])
def test_no_article_is_lost_to_a_name(name):
    html = page("<nav><a href=x>Home</a></nav>", f"<div class='{name}'><h1>Head</h1><p>{BODY}</p><p>{BODY}</p></div>", "<footer>End</footer>")
    assert html_text.main_text(html, STOP) == f"Head {BODY} {BODY}"


@pytest.mark.parametrize("html, text", [
    (page(f"<div class='has-sidebar'><p>{BODY}</p><p>Yes.</p></div>"), f"{BODY} Yes."),
    (page(f"<div id='content' class='no-sidebar'><p>{BODY}</p></div>"), BODY),
    (page(f"<div class='page with-navbar'><p>{BODY}</p></div>"), BODY),
    (page(f"<div class='site-header'>{BODY}</div><p>{BODY}</p><div id=left-sidebar-2>{BODY}</div>"), BODY),
    (page(f"<div class=sidebar><p>{BODY}</p><article><p>{BODY}</p><p>Yes.</p></article></div>"), f"{BODY} Yes."),
    (page(f"<header><p>Site</p><main><p>{BODY}</p></main></header>"), BODY),
    (page(f"<div class=comments><article><p>{BODY}</p></article></div><p>{BODY}</p>"), BODY),
    (page(f"<form><div class=menu>Home</div><p>{BODY}</p><p>{BODY}</p></form><div>Page 1</div>"), f"{BODY} {BODY} Page 1"),
    (page(f"<form><label>Name</label><article><p>{BODY}</p></article></form>"), BODY),
    (page(f"<article><p>{BODY}</p>{LINKS}<p>Yes.</p></article>"), f"{BODY} Yes."),
    (page(f"<div class=content><p>{BODY}</p><div>{ADVERT}</div></div>"), BODY),
    (page(f"<main><p>{BODY}</p><pre>{'x = f(y); ' * 20}</pre></main>"), f"{BODY} {('x = f(y); ' * 20).strip()}"),
])
def test_main_text_names_are_no_verdict(html, text):
    assert html_text.main_text(html, STOP) == text


FOREIGN = {
    "pl": "Strażnik ogrodu opuścił dom wczesnym rankiem, ponieważ rzeka wylała nocą. Sąsiedzi pomagali przenosić łodzie, "
          "sieci oraz zimowe zapasy. Wieczorem wszyscy wrócili zmęczeni, lecz zadowoleni, że niczego nie stracili.",
    "ru": "Сторож сада ушёл из дома рано утром, потому что ночью разлилась река. Соседи помогали переносить лодки и сети. "
          "Вечером все вернулись усталые, но довольные тем, что ничего не потеряли.",
    "ja": "庭の番人は朝早く家を出た。夜のうちに川があふれたからである。隣の人たちは舟と網と冬の蓄えを運ぶのを手伝った。"
          "夕方にはみな疲れて帰ってきたが、何も失わなかったことを喜んでいた。そして火のまわりで長いあいだ話をした。",
}


@pytest.mark.parametrize("lang", FOREIGN)
def test_main_text_in_a_language_without_stop_words(lang):
    text = FOREIGN[lang]
    menu = "<ul><li><a href=a>Dom</a></li><li><a href=b>Inne</a></li></ul>"
    html = page(menu, f"<div><h1>Rzeka</h1><p>{text}</p><p>{text}</p></div>", f"<div class=ad>{text}</div>", menu)
    assert html_text.main_text(html, STOP) == f"Rzeka {text} {text}"


def test_op4_query_gives_the_article(spark):
    import html as H
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op4(spark, SF).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        want = " ".join(H.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", body))).split())
        assert r.text == want and r.n_chars == len(want)


def test_main_text_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (2, "<article><p>" + "x " * 50_000, "t")], "page_id long, html string, text string")
    rows = html_text.extract(df).collect()
    assert [r.n_chars for r in rows] == [0, 0, 99_999]
    assert html_text.extract(df.limit(0)).count() == 0
