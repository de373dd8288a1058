import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import markup, mixing, packing, reading, splitting, text_queries, tokens

# ---- splitting


def check_pieces(text, limit, overlap):
    spans = splitting.cut_points(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    overlap = min(max(overlap, 0), limit - 1) if limit >= 1 else 0
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert c == b - overlap and d > b and c > a
    if limit >= 1:
        assert all(b - a <= limit for a, b in spans)
    assert text[spans[0][0] : spans[0][1]] + "".join(text[b : d] for (a, b), (c, d) in zip(spans, spans[1:])) == text
    return spans


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n.,é\u0301\u200d👍🏽🇩🇪。#`\r", max_size=300), st.integers(1, 60), st.integers(-3, 80))
def test_pieces_give_the_text_back(text, limit, overlap):
    check_pieces(text, limit, overlap)


def naive(values, lo, hi):
    best = max(values[lo : hi + 1])
    return max(i for i in range(lo, hi + 1) if values[i] == best)


def test_range_maxima():
    r = np.random.default_rng(0)
    v = r.integers(0, 5, 200)
    t = splitting.RangeMax(v)
    for _ in range(500):
        lo = int(r.integers(0, 200))
        hi = int(r.integers(lo, 200))
        assert t.argmax(lo, hi) == naive(v.tolist(), lo, hi)


def test_natural_boundaries():
    text = "First sentence here. Second one follows, with a clause.\n\n## Next part\n\nThird sentence. " + "word " * 20
    spans = check_pieces(text, 70, 5)
    assert text[: spans[0][1]].endswith("\n\n") and text[spans[0][1] :].startswith("## Next")
    assert splitting.cut_points("a" * 100, 30, 10)[0] == (0, 30)
    s = splitting.strengths("e\u0301x 🇩🇪🇫🇷 a\r\nb")
    assert s[1] == splitting.INSIDE and s["e\u0301x 🇩🇪🇫🇷 a\r\nb".index("🇩") + 1] == splitting.INSIDE and s["e\u0301x 🇩🇪🇫🇷 a\r\nb".index("🇫")] != splitting.INSIDE


def test_split_cases(spark):
    rows = [("p", 1, "x" * 25, 10, 3, "k"), ("p", 2, None, 10, 3, "k"), ("p", 3, "", 10, 3, "k"), (None, None, "x" * 11, 10, None, "k"), ("p", 5, "x" * 50, None, 3, "k"), ("p", 2**53 + 1, "long " * 40_000, 1000, 100, "k"), ("p", 1, "x" * 25, 10, 3, "k")]
    df = spark.createDataFrame(rows, "project string, piece long, body string, lim int, ov int, text string")
    got = splitting.split(df, ["project", "piece"], "body", "lim", "ov").collect()
    by = {}
    for project, key, piece, start, end, text in got:
        by.setdefault((project, key), []).append((piece, start, end, text))
    assert sorted(x[:3] for x in by["p", 1]) == sorted([(0, 0, 10), (1, 7, 17), (2, 14, 24), (3, 21, 25)] * 2)
    assert by["p", 2] == [(0, 0, 0, "")] and by["p", 3] == [(0, 0, 0, "")] and [x[:3] for x in sorted(by[None, None])] == [(0, 0, 10), (1, 10, 11)] and len(by["p", 5]) == 1
    assert len(by["p", 2**53 + 1]) > 200
    assert splitting.split(df.limit(0), ["piece"], "body", "lim", "ov").count() == 0


# ---- packing


def test_tokens():
    assert tokens.count(None) == 0 and tokens.count("") == 0 and tokens.count("Hello world") == 2 and tokens.count("<|endoftext|>") > 1
    assert tokens.encoding().decode(tokens.encode("naïve 텍스트 \U0001f600")) == "naïve 텍스트 \U0001f600"
    assert tokens.count("\ud800") > 0


def test_bins_take_the_tightest_and_close_the_fullest():
    b = packing.OpenBins(10, 2)
    assert b.put(6) == (0, None) and b.put(7) == (1, None)
    assert b.put(3) == (1, 1)  # fits 1 exactly, which needs no place any more
    assert b.put(9) == (2, None)
    assert b.put(5) == (3, 2)  # nothing fits, both places taken: the fullest closes
    assert b.put(4) == (0, 0) and b.put(0) == (3, None)


def test_packing(spark):
    r = random.Random(4)
    rows = [(i, "word " * r.randrange(0, 900), "x") for i in range(400)] + [(2**53 + 1, "word " * 9000, "x"), (900, None, "x"), (901, "", "x"), (None, "word", "x"), (1, "again", "x")]
    df = spark.createDataFrame(rows, "id long, body string, container string").repartition(4)
    got = packing.pack(df, "id", "body", capacity=1000, places=64).collect()
    used, total = {}, 0
    for x in got:
        used[x.container] = used.get(x.container, 0) + x.tok_end - x.tok_start
        total += x.tok_end - x.tok_start
    assert max(used.values()) <= 1000 and total == sum(tokens.count(b) for _, b, _ in rows)
    assert total / (1000 * len(used)) > 0.9  # items of up to 0.9 containers; 0.99 on the documents, README
    big = sorted((x.piece, x.tok_start, x.tok_end) for x in got if x.id == 2**53 + 1)
    assert [p for p, *_ in big] == list(range(10)) and all(a[2] == b[1] for a, b in zip(big, big[1:])) and big[-1][2] == tokens.count("word " * 9000)
    split = {x.id for x in got if x.piece > 0}
    assert split == {2**53 + 1} and len(got) == len(rows) + 9
    assert packing.pack(df.limit(0), "id", "body").count() == 0


# ---- mixing


def mix_frame(spark):
    words = {"a": "alpha beta gamma", "b": "delta epsilon zeta", "c": "eta theta iota"}
    r = random.Random(6)
    rows = []
    for i in range(900):
        s = r.choice(["a", "a", "a", "a", "b", "b", "c"])
        text = " ".join(r.choices(words[s].split(), k=r.randrange(20, 60)))
        rows.append((i, text, {"a": " A", "b": "b ", "c": "C"}[s] if i % 10 else None, s, "x"))
    rows += [(5000, None, "a", "a", "x"), (5001, "tail", "unknown", None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, true string, tokens string")


def test_mix_reaches_targets_and_caps(spark):
    df = mix_frame(spark)
    mix = mixing.solve(df, [("A", 0.5, 2), ("b", 0.3, 2), ("c", 0.9, 1), ("none", 0.1, 5), (None, None, None)], sample_rows=2000)
    rep = {r.source: r for r in mixing.report(mix).collect()}
    assert not rep["c"].reachable and not rep["none"].reachable and rep["A"].reachable
    assert rep["none"].source_tokens == 0 and abs(sum(r.actual_share for r in rep.values()) - 1) < 0.02
    for s in ("A", "b"):
        assert rep[s].mix_tokens == pytest.approx(rep[s].target_tokens, rel=0.03) and rep[s].expected_tokens == pytest.approx(rep[s].target_tokens, rel=0.001)
    docs = mixing.documents(mix).collect()
    assert len(docs) == 902 and all(d.copies <= {"A": 2, "b": 2, "c": 1}.get(d.source, 5) for d in docs) and all(d.copies == 1 for d in docs if d.source == "c" and d.rate == 1)
    assert next(d for d in docs if d.doc_id == 5001).copies == 0


def test_unlabelled_documents_are_told_apart(spark):
    df = mix_frame(spark)
    mix = mixing.solve(df, [("a", 0.4, 2), ("b", 0.3, 2), ("c", 0.3, 5)], sample_rows=2000)
    names = dict(enumerate(mix.names))
    true = {r.doc_id: r.true for r in df.collect()}
    soft = mix.soft.collect()
    right = sum(names[int(np.argmax(r.posterior))] == true[r.doc_id] for r in soft)
    assert len(soft) == 90 and right >= 85


def test_mix_of_nothing(spark):
    df = mix_frame(spark).limit(0)
    rep = mixing.report(mixing.solve(df, [("a", 1.0, 2)])).collect()
    assert len(rep) == 1 and rep[0].source_tokens == 0 and rep[0].reachable
    assert mixing.report(mixing.solve(mix_frame(spark), [])).count() == 0


# ---- reading


@pytest.mark.parametrize("text,n", [("One. Two! Three?", 3), ("Mr. Smith saw Fig. 3.2 (cf. Sect. 4.1, i.e. the end). Then he left.", 2), ("It costs 3.50 now", 1), ('He said "Stop." Then he went.', 2), ("Version 2.1 is out. See v. 3.", 2), ("J. R. Smith wrote it.", 1), ("Items, etc. The rest is here.", 2)])
def test_sentences(text, n):
    assert reading.sentences(text) == n


@pytest.mark.parametrize("word,n", dict(table=2, created=3, makes=1, going=2, science=2, idea=3, alignment=3, administrative=5, people=2, fire=1, queue=1, used=1, wanted=2, horses=2, retrieval=3, continuity=5, rhythm=2, boxes=2, statements=2, lately=2, readability=5).items())
def test_syllables(word, n):
    assert reading.syllables(word) == n


def test_prose_leaves_markup_out():
    text = "---\ntitle: x\n---\n# Heading words here\n\nHard wrapped\nsentence goes on. Second one.\n\n- item one\n- item two\n\n```\ncode = here\n```\n\n| a | b |\n|---|---|\n| c | d |\n\n    indented code\n\nHead\n====\n\nkey = value\n\nThe `inline` end."
    got = reading.prose(text)
    assert got == ["Hard wrapped sentence goes on. Second one.", "item one", "item two", "The   end."]


def test_levels_of_samples_held_out(spark, sf):
    """Thresholds from one half of the samples judge the other half."""
    samples = [(r.text, r.level) for r in spark.read.parquet(f"{sf}/reading_samples.parquet").orderBy("sample_id").collect()]
    for a, b in ((samples[::2], samples[1::2]), (samples[1::2], samples[::2])):
        steps = sorted(reading.thresholds(a).items())
        wrong = sum(max([x for x, g in steps if reading.measures(t)[3] >= g], default=1) != level for t, level in b)
        assert wrong <= 0.1 * len(b)


def test_grade_cases(spark):
    samples = [("The cat sat. It ran.", 1), ("Institutional terminological consistency necessitates distributional intelligibility, notwithstanding reconfiguration of taxonomic alignment.", 3)]
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 ... ###", "x"), (4, "漢字だけの文章です。", "x"), (5, "The dog ran. " * 20_000, "x"), (None, "The dog ran.", "x"), (2**53 + 1, samples[1][0], "x"), (5, "The dog ran.", "x")]
    df = spark.createDataFrame(rows, "id long, body string, grade string")
    got = [tuple(r) for r in reading.grade(df, "id", "body", samples).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == 8 and all(by[i][4] is None and by[i][5] is None for i in (1, 2, 3, 4)) and by[5][5] == 1 and by[None][5] == 1 and by[2**53 + 1][5] == 3
    assert reading.grade(df.limit(0), "id", "body", samples).count() == 0


def test_stretches_give_the_same_cuts():
    """Whatever part of the text a table covers, strengths and cuts are those of the whole."""
    rng = np.random.default_rng(3)
    words = ["alpha", "beta.", "gamma,", "\n", "\n\n", "# head\n", "```\n", " ", "  ", "\u3002", "\U0001F1E9\U0001F1EA" * 5, "e\u0301", "\r\n", "\r", "x" * 60, " " * 300, "\ufe0f"]
    for _ in range(30):
        text = " ".join(words[i] for i in rng.integers(0, len(words), 400))
        limit, overlap = int(rng.integers(5, 90)), int(rng.integers(0, 30))
        assert splitting.cut_points(text, limit, overlap, stretch=1) == splitting.cut_points(text, limit, overlap)
        whole, parts = splitting.strengths(text), splitting.Boundaries(text)
        assert np.array_equal(whole, np.concatenate([parts.between(i, min(i + 37, len(text) + 1)) for i in range(0, len(text) + 1, 37)]))
        check_pieces(text, limit, overlap)


def test_blank_lines_of_any_length():
    for blanks in (5, 300, 3000):
        text = "a paragraph here\n" + " " * blanks + "\nnext paragraph"
        assert splitting.strengths(text)[text.index("next")] == splitting.PARAGRAPH
    text = "x" * 5 + "\r" + "y" * 5 + "\r\r" + "zzz"
    assert splitting.strengths(text)[6] == splitting.LINE and splitting.strengths(text)[text.index("z")] == splitting.PARAGRAPH
    text = "head\n" + " " * 400 + "# Heading"
    assert splitting.strengths(text)[5] == splitting.HEADING


def test_first_half_is_asked_where_the_last_offers_nothing():
    text = "word " * 100 + "y" * 1200 + " end"
    assert splitting.cut_points(text, 1500, 0)[0] == (0, 500)


def test_long_texts_need_little_memory():
    import tracemalloc

    text = ("A sentence of some words, and more. " * 30 + "\n\n") * 18_500
    tracemalloc.start()
    spans = splitting.cut_points(text, 1500, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) > 19_900_000 and spans[-1][1] == len(text) and peak < 200_000_000


def test_tags_of_any_length_are_no_prose():
    text = "One sentence here. <a title='" + "very long words. " * 40 + "'>Link</a> ends here."
    assert "very" not in " ".join(reading.prose(text)) and "very" not in " ".join(reading.prose(text.replace("long words. very", "long\nvery")))
    assert "a < b" in " ".join(reading.prose("Here a < b holds.\n\nAnd c > d too."))


def test_found_sources_come_from_the_solved_rates(spark):
    """Other caps of the solver give other rows; soft documents do not help a source over its bound."""
    from pyspark.sql import functions as F

    rows = [(i, "alpha beta gamma " * 20, "a") for i in range(10)] + [(20 + i, "delta epsilon zeta " * 20, "b") for i in range(30)] + [(60 + i, "alpha beta gamma " * 20, None) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for most, found in ((2, {"a"}), (6, set())):
        mix = mixing.solve(df, [("a", 0.5, most), ("b", 0.5, 5)])
        assert {r.source for r in mixing.report(mix).filter(~F.col("reachable")).collect()} == found
        at = mix.names.index("a")
        assert bool(mix.own_rates[at] >= most - 1e-6) == bool(found)
        mix.own_rates[at] = 0.0  # what the solver says decides
        assert not mix.short()[at]
    assert mixing.solve(df, [("a", 0.5, 2), ("b", 0.5, 5)], window=2).expected == pytest.approx(mixing.solve(df, [("a", 0.5, 2), ("b", 0.5, 5)], window=50).expected)


# ---- markup

FOUND = {
    "html": ["<p>x</p>", "a<br/>b", "E = mc<sup>2</sup>", "x &amp; y", "&#8212;", "&#x2014;", "<!-- c -->", "<div\n  class=\"n\">x</div>", "<TABLE BORDER=0><TR><TD>a", "<script>if (a < b) {}</script>", "<a href='x'>y</a>", "&lt;name&gt;"],
    "markdown": ["# T", "T\n=====", "T\n---", "- a", "* a", "+ a", "1. a", "3) a", "- [ ] a", "> q", "**b**", "*late*", "_it_", "~~gone~~", "a ***b*** c", "[t](u)", "[t](<u v> 'w')", "![a](b.png)", "[t][1]\n\n[1]: u", "[1]: notes/x.md", "| a | b |\n|---|:-:|\n| c | d |", "a | b\n--|--\nc | d", "```\nx\n```", "~~~ py\nx", "Run `ls -l` now", "``a ` b``", "<https://x.y>", "text\n\n    code", "un*frigging*believable", "1. a\n   * b"],
    "wiki": ["== H ==", "=== H ===", "''it''", "'''b'''", "[[Page]]", "See [[a|b]].", "[[Category:X]]", "{{draft|1}}", "{{Infobox\n|a=b\n}}", "{| class=\"x\"\n! a !! b\n|-\n| c || d\n|}"],
    "latex": ["\\section{A}", "\\emph{x}", "as in~\\cite{a-1}", "\\begin{itemize}\n  \\item a\n\\end{itemize}", "$x^2$", "$O(n \\log n)$", "$$E = k_1 + k_2$$", "\\[ x^2 + y^2 \\]", "\\( a_i \\)", "\\begin{equation}\na_i\n\\end{equation}", "\\footnote{x}", "a \\ldots{} b", "\\begin{verbatim}\n# x\n\\end{verbatim}", "the \\alpha value"],
}
NOTHING = [
    "", "plain text.", "Use 2 * 3 * 4 slots.", "The path docs/v* matches 4, docs/w* none.", "max_retry_count = 5 and other_name", "If x == y then a || b", "a < b and c > d", "R&D and Q&A", "It's the team's 'second' choice", "costs $5 or $7, not $9", "C:\\temp\\notes\\1",
    "Set {limit} to 3", "See [3] and item[i] (the second)", "Ticket #42 -> done", "~19 ms, and ~20", "#hashtag", "3.5 is more", "-5 degrees", "a -- b", "\\*not emphasis\\*", "\\# no heading", "\\[no link\\](x)", "&nosuchentity;", "AT&T;", "List<String> x", "<name>", "5'' and 6'' pipes",
    "| a | b |", "x[[1]]", "{{}}", "= x", "2025. a year\nlater" if False else "in\n2025. It was", "=======", "____", "$HOME/bin", "~/notes", "a_b_c", "snake_case_word", "1) " if False else "1)", "\\n and \\t", "100% of x", "^caret^", "file.md:12", "-", "*", "a * b", "**", "``quoted''",
]
INSIDE = [
    ("```\n<b>x</b> [[l]] \\emph{x}\n```", {"markdown"}), ("`<b>` and `\\emph{x}`", {"markdown"}), ("<pre><code>- a\n# b\n**c** [[d]]</code></pre>", {"html"}), ("<!-- **b** [[c]] -->", {"html"}), ("\\begin{verbatim}\n<b> **x**\n\\end{verbatim}", {"latex"}), ("$a_i * b_i * c$", {"latex"}),
    ("<nowiki>**x** [[y]]</nowiki>", {"wiki"}), ("{| class=\"a\"\n|-\n| b || c\n|}", {"wiki"}), ("# H\n\n<b>x</b> {{t}} \\emph{y}", {"markdown", "html", "wiki", "latex"}), ("a ~13 ms, in~\\cite{b}", {"latex"}), ("~~~\n<div>{{x}} \\section{y}</div>\n~~~", {"markdown"}),
]


@pytest.mark.parametrize("language,text", [(k, t) for k, ts in FOUND.items() for t in ts])
def test_found(language, text):
    assert markup.languages(text) == {language}
    assert markup.languages("Before it.\r\n\r\n" + text.replace("\n", "\r\n")) == {language}


@pytest.mark.parametrize("text", NOTHING)
def test_look_alikes(text):
    assert markup.languages(text) == set()


@pytest.mark.parametrize("text,want", INSIDE)
def test_inside_other_code(text, want):
    assert markup.languages(text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("<h2>Goals</h2><p>One &amp; two.<br>Three</p><ul><li>a</li><li>b</li></ul>", "## Goals\n\nOne & two.\nThree\n\n- a\n- b"),
        ("T\n===\n\n**Bold** and [link](u) with `code_x`.", "# T\n\nBold and link with code_x."),
        ("| a | b |\n|---|---|\n| c | d |", "a | b\nc | d"),
        ("'''Note''': see [[page|the page]].\n\n== H ==\n{{x|1}}", "Note: see the page.\n\n## H"),
        ("\\section{A}\nText \\emph{here}~\\cite{b}.\n\\begin{itemize}\n  \\item x\n\\end{itemize}\n\\[ a_i \\]", "## A\n\nText here.\n\n- x\n\n$$a_i$$"),
        ("```py\n<b> **x**\n```", "```\n<b> **x**\n```"),
        ("<pre><code>a &lt; b</code></pre>", "```\na < b\n```"),
        ("Keep a < b, 2 * 3 * 4 and max_retry_count; \\*stars\\*.", "Keep a < b, 2 * 3 * 4 and max_retry_count; *stars*."),
        ("{| class=\"x\"\n! k !! v\n|-\n| a || 1\n|}", "k | v\na | 1"),
        ("<script>var x = 1;</script>Text<!-- no -->", "Text"),
        ("The cost is $O(n)$ a query.", "The cost is $O(n)$ a query."),
    ],
)
def test_clean(text, want):
    assert markup.clean(text) == want


def test_dense_content_wins_over_link_lists():
    page = "<body><div class='nav'>" + "".join(f"<a href='{i}'>go {i}</a> " for i in range(30)) + "</div><div><h1>Title</h1><p>" + "Real content of the page in long sentences. " * 20 + "</p></div></body>"
    got = markup.clean(page)
    assert "Real content" in got and "# Title" in got and "go 7" not in got


ARTICLE = "<div class='article'>" + "".join(f"<p>Paragraph {i} tells at length what was decided, why it was decided, and what follows from it for all teams.</p>" for i in range(4)) + "</div>"


@pytest.mark.parametrize(
    "boilerplate",
    ["<div><span>Home</span> <span>Products</span> <span>Contact</span></div>", "<div>We use cookies.</div>", "<ul><li>Home</li><li>Products</li><li>Contact</li></ul>", "<nav><p>Home</p><p>Products</p><p>Contact</p></nav>"],
)
def test_boilerplate_without_links_is_left_out(boilerplate):
    got = markup.clean(f"<body><h1>Plan</h1>{boilerplate}{ARTICLE}<pre>a = 1</pre><table><tr><td>x</td><td>y</td></tr></table></body>")
    assert got.startswith("# Plan") and all(f"Paragraph {i} " in got for i in range(4)) and "```\na = 1\n```" in got and "x | y" in got
    assert not any(word in got for word in ("Home", "Products", "Contact", "cookies"))


def test_second_section_stays():
    """Not only the subtree of the greatest sum: every block that reaches the threshold is content."""
    section = "<section>" + "<p>One more sentence of the plan, long enough to count as running text and not as a label or a notice, because it goes on and on.</p>" * 2 + "</section>"
    got = markup.clean(section + ARTICLE)
    assert got.count("One more sentence") == 2 and "Paragraph 3" in got


def test_running_text_beside_elements_stays():
    assert markup.clean("Intro stays.\n\n" + ARTICLE + "\n\nEnd **stays**.").startswith("Intro stays.") and markup.clean(ARTICLE + "\n\nEnd **stays**.").endswith("End stays.")


def test_languages_and_text_come_from_one_extraction(monkeypatch):
    calls, kept = [], markup.Tree.kept
    monkeypatch.setattr(markup.Tree, "kept", lambda tree: calls.append(tree) or kept(tree))
    parsed = markup.Parsed("<nav>Home</nav>" + ARTICLE)
    assert parsed.languages() == {"html"} and len(calls) == 1 and len(calls[0].density) == 7
    assert "Paragraph 3" in parsed.text() and len(calls) == 1


def test_composite_text_density_is_the_method_s():
    """C/T · log of C/LC · T/LT, to the base ln(C/¬LC · LC + LCb/Cb · C + e); a count of 0 reads as 1."""
    parsed = markup.Parsed("<div>abcdefghij<p>klmno</p></div><p><a>pqr</a></p>stuvw")
    tree = markup.Tree(parsed.marked, parsed.tags, ())
    tree.densities()

    def density(c, t, lc, lt):
        return c / t * np.log(c / lc * t / lt) / np.log(np.log(c / max(1, c - lc) * lc + 3 / 23 * c + np.e))

    assert tree.tag == ["body", "div", "p", "p", "a"]
    assert tree.density == pytest.approx([density(23, 4, 3, 1), density(15, 1, 1, 1), density(5, 1, 1, 1), density(3, 1, 3, 1), density(3, 1, 3, 1)])


def test_running_text_in_a_block_without_links_stays():
    """Five sentences beside a long section with two links: above the threshold, as a block without links is denser."""
    notes = "The limit applies to the backup job only, and nobody has asked for another one. " * 5
    section = "<p>" + "Running text outside all elements goes on for a while. " * 40 + "</p>" + "<p>One <a href='u'>link</a>.</p>" * 2
    got = markup.clean(f"<div>{notes}</div><div>{section}</div>")
    assert got.count("backup job") == 5 and got.count("Running text") == 40


def test_links_over_lines_and_behind_brackets():
    assert markup.languages("see [two\nwords](u)") == {"markdown"} and markup.clean("see [two\nwords](u)") == "see two\nwords"
    assert markup.languages("[x][y](u)") == {"markdown"} and markup.clean("[x][y](u)") == "[x]y"
    assert markup.languages("[two\n\nwords](u)") == set()


@pytest.mark.parametrize("terms", [10, 60, 2000])
def test_long_formulas(terms):
    text = "See $" + " + ".join(f"x_{{{i}}}" for i in range(terms)) + "$ here"
    assert markup.languages(text) == {"latex"} and markup.clean(text) == text


def test_deep_nesting():
    assert markup.clean("a{{a|{{b|{{c|{{d|{{e|{{f}}}}}}}}}}}}z") == "az"
    assert markup.clean("\\textbf{" * 50 + "z" + "}" * 50) == "z"
    assert markup.clean("<div>" * 5000 + "hello") == "hello" and markup.languages("<div>" * 5000 + "hello") == {"html"}
    assert markup.clean("[![alt](a.png)](b) and [![c](d)](e)") == "alt and c"


def test_private_use_characters_are_text():
    assert markup.clean("a\ue0007\ue001b") == "a\ue0007\ue001b"
    assert markup.clean("a\ue0000\ue001b `c`") == "a\ue0000\ue001b c"


@pytest.mark.parametrize(
    "piece,n",
    [("`" * 7 + "a" + "`" * 3 + "b", 90_000), ("[a", 300_000), ("![a](b)", 100_000), ("*_", 200_000), ("''a ", 200_000), ("{{a|", 200_000), ("\\[ ", 200_000), ("<source>", 100_000), ("\\item ", 100_000), ("$a ", 200_000), ("<div>", 100_000)],
)
def test_linear_on_hostile_texts(piece, n):
    """A megabyte of what never closes: twice the text takes about twice the time."""
    import time

    def took(text):
        began = time.process_time()
        parsed = markup.Parsed(text)
        parsed.languages(), parsed.text()
        return time.process_time() - began

    short, long = min(took("[" + piece * (n // 8)) for _ in range(2)), took("[" + piece * n)
    assert long < 30 and long < 8 * 5 * max(short, 0.02)


def test_code_stays_as_it_is():
    assert markup.clean("a\n\n\n\nb\n```\nx  \n\n\n\ny\n```\nend") == "a\n\nb\n\n```\nx  \n\n\n\ny\n```\n\nend"


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab<>&;*_`#[](){}|$\\'=~-\n 1.!/", max_size=120))
def test_never_crashes(text):
    markup.languages(text)
    markup.clean(text)


def test_markup_cases(spark):
    rows = [("p", 1, None, None, "x"), ("p", 2, "**T**", "<b>x</b>", "x"), (None, None, "", "# " + "word " * 50_000, "x"), ("p", 2, "**T**", "<b>x</b>", "x")]
    df = spark.createDataFrame(rows, "project string, chunk long, title string, markup string, clean_text string")
    got = markup.residue(df, ["project", "chunk"], "title", "markup").collect()
    by = {(r.project, r.chunk): r for r in got}
    assert len(got) == 4 and by["p", 1].markup == [] and by["p", 1].clean_text == "" and by["p", 2].markup == ["html", "markdown"] and by["p", 2].clean_title == "T" and by[None, None].markup == ["markdown"]
    assert markup.residue(df.limit(0), ["chunk"], "title", "markup").count() == 0


def test_found_rows_are_those_of_the_cleaning(spark, tmp_path):
    texts = ["<nav>Home</nav>" + ARTICLE, "see [two\nwords](u)", "plain", "<p>**b** $x^2$</p>"]
    rows = [("p", "f", i, "", text, None) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "project string, file string, chunk_id long, title string, body string, indexed_at long").write.parquet(str(tmp_path / "index_chunks.parquet"))
    found = sorted((r.chunk_id, r.markup) for r in text_queries.p6_found(spark, str(tmp_path)).collect())
    assert found == [(0, "html"), (1, "markdown"), (3, "html"), (3, "latex"), (3, "markdown")]
    assert found == sorted((r.chunk_id, m) for r in text_queries.p6_clean(spark, str(tmp_path)).collect() for m in r.markup.split(",") if m)
