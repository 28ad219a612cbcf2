"""The per-document operators: odd inputs, brute force, exact round trips and held-out accuracy."""

import hashlib
import itertools
import re
import time

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from setledger.llm import chat, decontaminate, html_text, language, licenses, mixing, quality, queries, toxicity
from setledger.llm.common import SpanHashes, blank_word_hashes, code_points, table

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, score double"
ODD = [(1, None, None, None, 1.0), (2, "", "en", "a", 2.0), (3, " \n\t", "en", "b", 3.0), (4, "One two.", None, None, 4.0),
       (4, "One two.", None, None, 4.0), (None, "Null id, here", "en", "a", None), (5, "word " * 30_000, "en", "c", 0.0),
       (6, "x" * 200_000, "de", "c", 0.0), (7, "İstanbul ſ \U0001F600 ẞ ligne", "fr", "b", 0.0)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


# licenses
def test_license_base_matches_brute_force(odd, rows):
    texts = ["CC-BY 4.0 and cc  by; accby cc bye", "GNU General Public License, general\npublic license",
             "All Rights Reserved. all rights reserved", "mit", None, "", "é cc by ü"]
    got = {r.doc_id: r for r in licenses.license_report(rows("doc_id long, text string", *enumerate(texts))).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = sorted((k, label) for phrase, label in licenses.BASE.items() for k in range(len(words))
                    if words[k:k + len(phrase.split())] == phrase.split())
        assert (got[i].n_words, got[i].n_base) == (len(words), len(at))
        assert (got[i].first_word, got[i].last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert got[i].base_labels == ",".join(sorted({label for _, label in at}))
        assert set(got[i].base_labels.split(",")) <= set(got[i].labels.split(","))
        assert 0 <= got[i].score <= 1
    assert licenses.license_report(odd).count() == len(ODD)


def test_license_suppression():
    kept = [d.label for d in licenses.detect("Licensed under the MIT License.")[1]]
    assert kept == ["mit"]
    assert {d.label for d in licenses.detect("licensed under CC BY-NC 4.0")[1]} == {"cc-by", "cc-by-nc"}
    assert len(licenses.rules()) > 200 and licenses.detect(None) == (0, [])


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// ", ";; ", "-- ", "dnl ", "    ", "> ", "\r"])
@pytest.mark.parametrize("label, text", [
    ("bsd", "Redistribution and use in source and binary forms, with or without modification"),
    ("gpl", "as published by the Free Software Foundation"), ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy"), ("mit", "the MIT License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software"), ("bsd-3-clause", "3-clause BSD License"),
    ("gpl-2.0", "GNU General Public License, version 2"), ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0")])
def test_wrapped_notices(mark, label, text):
    words = text.split()
    for k in range(1, len(words)):
        for end in ("\n", " */\n/*" if mark == " * " else "\n"):
            assert label in {d.label for d in licenses.detect(" ".join(words[:k]) + end + mark + " ".join(words[k:]))[1]}
    assert label in {d.label for d in licenses.detect(("\n" + mark).join(words))[1]}


def test_gaps_hold_no_words():
    assert licenses.detect("mit new\nlicense, mit.\nlicense and free # software * foundation")[1] == []
    assert licenses.detect("licensed under" + " \n * " * 50_000 + "x apache" + " " * 50_000)[1] == []


# quality
def test_repeat_words_brute_force():
    for text in ("", "a b c", "a b c a b c", "a a a a", "x y z w x y q x y z"):
        words = text.split()
        windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        assert quality.repeat_words(words) == len(covered)
    assert quality.rule_statistics("a\na\n\n\nb#|\xa0")[:4] == (3, 6, 2, 1)


def test_quality_odd_inputs(odd, empty, no_labels):
    got = {r.doc_id: r for r in quality.judge_quality(odd, no_labels).collect()}
    assert got[1].base_failed and not got[1].kept and got[1].n_words == 0
    assert got[5].base_failed and got[5].n_repeat_words == 30_000
    assert quality.judge_quality(empty, no_labels).count() == 0


def test_quality_tells_junk(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    r = quality.judge_quality(docs, labels).join(labels, "doc_id").filter("NOT base_failed").groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {x.quality: x.share for x in r}
    assert share[1] > 0.95 and share[0] < 0.75


# chat
@pytest.mark.parametrize("role", ["user", "assistant", "system", "", "User", 'we"ird\n:', "outil\\"])
@pytest.mark.parametrize("text", ["", "plain", "\\### Assistant: </turn> ok", "a\\", "###", "\n</turn>\n### User:\nhi\n</turn>\n",
                                  "\\\\</turn>\\", "### \\\\###", "</turn></turn>", "tail\n", " \x85 x"])
def test_turn_round_trip(role, text):
    out = chat.render_checked(role, text)
    assert [t[:2] for t in chat.parse(out + out)] == [(role, text)] * 2


def test_chat_digest(spark, rows):
    data = [(1, 1, "assistant", "b ### c"), (1, 0, "user", None), (None, 0, None, "x"), (2, 0, "assistant", "é\U0001F600"),
            (2, 0, "assistant", "é\U0001F600"), (2, None, "tool", "t")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(rows("conv_id long, turn long, role string, text string", *data))).collect()}
    sha = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\n", "assistant\nb ### c\n") and got[1].loss_sha256 == sha("b ### c")
    assert got[2].n_turns == 3 and got[2].loss_chars == 4 and got[2].turns_sha256 == sha("tool\nt\n", "assistant\né\U0001F600\n" * 2)
    assert got[None].n_turns == 1
    assert {r.conv_id for r in queries.op3_chat_format(spark, FOLDER).collect()} >= {-7}


# mixing
def test_mix_equals_sql_and_keeps_limits(odd, empty, no_labels):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, score DOUBLE)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", ODD)
    mine = sorted(map(tuple, mixing.taken_words(odd).collect()), key=repr)
    assert mine == sorted(con.execute(mixing.taken_sql()).fetchall(), key=repr)
    assert all(r[4] <= 3 * r[1] for r in mine)
    assert mixing.taken_words(empty).count() == 0


def test_mix_order_is_low_discrepancy(spark):
    mixed, _, targets = mixing.mix_sources(table(spark, FOLDER, "documents"))
    share = {r.source_no: r.hi - r.lo for r in targets.collect()}
    slots = mixed.filter("slot IS NOT NULL").select("slot", "source_no").distinct().toPandas()
    top = slots["slot"].max() + 1
    for source, part in slots[slots["slot"] < top // 2].groupby("source_no"):
        assert abs(len(part) - share[source] * (top // 2)) < 15


# toxicity
def test_toxicity(spark, odd, empty, no_labels):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = toxicity.train_toxicity(docs, labels)
    scored = queries.op5_toxicity(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out").toPandas()
    bad, good = scored[scored.toxic == 1].score.to_numpy(), scored[scored.toxic == 0].score.to_numpy()
    assert (bad[:, None] > good[None, :]).mean() > 0.9 and (good >= 0.7).mean() < 0.05
    got = toxicity.toxicity_scores(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    untrained = toxicity.train_toxicity(empty, no_labels)
    assert {r.score for r in toxicity.toxicity_scores(odd, untrained).collect()} == {0.0}


def copied(spark, docs, held, times=600):
    """``docs`` and many rows that repeat one of its texts, a third of them held out."""
    one = docs.filter(held).orderBy("doc_id").limit(1).drop("doc_id")
    return docs.unionByName(spark.range(10_000_000, 10_000_000 + times).withColumnRenamed("id", "doc_id").join(one, how="cross"))


def test_toxicity_with_copies(spark):
    """A text with any number of labelled copies is one row of the fit's sample."""
    docs, labels = (table(spark, "/root/testdata/sf0.01", name) for name in ("documents", "labels"))
    hot = copied(spark, docs, F.col("text").isNotNull()).cache()
    marks = labels.select("doc_id", "toxic").unionByName(hot.filter("doc_id >= 10000000").select("doc_id", F.lit(0).cast("int").alias("toxic")))
    scored = toxicity.toxicity_scores(docs, toxicity.train_toxicity(hot, marks)).join(labels, "doc_id").toPandas()
    bad, good = scored[scored.toxic == 1].score.to_numpy(), scored[scored.toxic == 0].score.to_numpy()
    assert (bad[:, None] > good[None, :]).mean() > 0.9 and (good >= 0.7).mean() < 0.05


# language
def test_language_samples_with_copies(spark):
    """Copies take one place of a language's sample."""
    docs = table(spark, FOLDER, "documents")
    hot = copied(spark, docs, F.col("lang") == "en").cache()
    parts = [sorted(language.training_samples(d, rows=1_000, window=10_000)["en"].split("\n")) for d in (hot, docs)]
    more = len(parts[0]) - len(parts[1])
    assert 0 <= more < 100 and set(parts[1]) <= set(parts[0])


def test_language(spark, odd, empty):
    got = queries.op6_language(spark, FOLDER).filter("held_out").join(
        table(spark, FOLDER, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    samples = language.training_samples(table(spark, FOLDER, "documents"))
    told = {r.doc_id: r for r in language.identify(odd, samples).collect()}
    assert told[1].lang_pred == told[2].lang_pred == told[3].lang_pred == "und" and told[1].score == 0
    assert language.identify(empty, samples).count() == 0
    assert {r.lang_pred for r in language.identify(odd, {}).collect()} == {"und"}


def test_phrases_brute_force():
    sample, text = "abracadabra banana", "banabracz abrab xbanan"
    walk = language.walk_table((("x", sample),), "x")
    symbols = language.symbol_table((("x", sample),))
    grid = symbols[code_points([text])[0]][:, None]
    import numpy as np
    found = language.phrases(grid, np.array([len(text)]), walk)[0]
    count, current, known = 0, "", sample
    for char in text:  # an unseen character closes the phrase it ends
        if current + char in known:
            current += char
        elif char in known:
            count, current = count + 1, char
        else:
            count, current = count + 1, ""
    assert found == count + (current != "")


# pages
PAGE = """<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><header>Top</header><nav><ul><li>Home</ul></nav>
<div class="cookie-notice">We use cookies</div><{main}><h1>Title&nbsp;&amp; more</h1><p>First   <b>bold</b>
text<p>Second &lt;tag&gt;<aside>Side</aside><div class="comments"><p>reader</p></div></{main}><footer>End</footer></body></html>"""


def test_pages(rows, spark):
    data = [(i, f"http://h{i % 2}.org/{i}", PAGE.replace("{main}", m)) for i, m in enumerate(["article", "article", "div", "main", "div"])]
    data += [(7, None, None), (8, "x", ""), (9, "http://h9.org", "just text"), (9, "http://h9.org", "just text")]
    got = html_text.extract_main_text(rows("page_id long, url string, html string", *data)).collect()
    text = {r.page_id: r.text for r in got}
    for i in range(5):
        assert text[i] == "Title & more\nFirst bold text\nSecond <tag>"
    assert len(got) == 9 and text[7] == text[8] == "" and text[9] == "just text"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("named", ["home has-sidebar", "single-post no-sidebar", "fixed-header", "menu search-results", "footer", ""])
def test_page_classes_close_nothing(named):
    inner = '<div class="sidebar">Side</div><div class="site with-sidebar"><{0} class="header comments"><p>Body text</p></{0}></div>'
    for tag in ("main", "article"):
        page = f'<html class="{named}"><body class="{named}">{inner.format(tag)}</body></html>'
        assert html_text.main_text(page, None) == "Body text"
    assert html_text.main_text(f'<body class="{named}"><h1>A</h1><div class="page-sidebar">Side</div><p>B</p></body>', None) == "A\nB"


@pytest.mark.parametrize("icon", ['<svg class="i"/>', "<svg/>", '<SVG d="a>b" />', "<template/>", '<svg a="/"><path d="M0"/></svg>',
                                  "<svg-icon></svg-icon>"])
def test_self_closed_icons_swallow_nothing(icon):
    assert html_text.main_text(f"<p>a</p>{icon}<p>b</p>", None) == "a\nb"
    assert html_text.main_text(f"<p>a</p>{icon}<p>b</p><svg><text>no</text></svg><p>c</p>", None) == "a\nb\nc"


def words_of(seed, n=40):
    import random
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_pages_without_article_keep_all_open_slots(rows):
    """A heading or a second block outside the largest container, and a rarer layout that also has that container."""
    want, data = {}, []
    for i in range(40):
        if i % 20:
            want[i] = f"Title {i}\n{words_of(i, 120)}\nNote {i}"
            data.append((i, "http://h.org", f'<body><nav>Home</nav><h1>Title {i}</h1><div class="story"><p>{words_of(i, 120)}</p></div><div>Note {i}</div></body>'))
        else:
            want[i] = f"Teaser {i}\n{words_of(i, 90)}"
            data.append((i, "http://h.org", f'<body><div class="story">Teaser {i}</div><div class="long"><p>{words_of(i, 90)}</p></div></body>'))
    got = html_text.extract_main_text(rows("page_id long, url string, html string", *data)).collect()
    assert {r.page_id: r.text for r in got} == want


def test_template_text_is_no_content(rows):
    """Texts of all pages of a host or of one layout go, short and long ones; what varies stays, also beside them."""
    long = "Write to us and we will send you the weekly letter with all the new texts of this place."
    want, data = {}, []
    for i in range(12):
        extra, line = ("", "") if i % 2 else (f'<div class="k2"><p>Seen on film</p><p>Film {i}</p></div>', f"\nFilm {i}")
        want[i] = f"Title {i}\n{words_of(i)}\nBy Author {i}{line}"
        data.append((i, "http://h.org", f'<body><article><h1>Title {i}</h1><div class="x17">Read <b>this</b></div><p>{words_of(i)}</p>'
                     f"<p>By <b>Author {i}</b></p><div>{long}</div>{extra}</article></body>"))
        want[20 + i] = f"Title {i}\n{words_of(i)}"  # no article; the article that is there never varies
        data.append((20 + i, "http://k.org", f'<body><article>{long}</article><h2>Title {i}</h2><p>{words_of(i)}</p></body>'))
    for i in range(6):  # copies of one page, and near copies, are no template
        want[40 + i], want[50 + i] = f"Alone\n{words_of(1)}", "Same\nText"
        data.append((40 + i, "http://c.org", f"<body><article><h1>Alone</h1><p>{words_of(1)}</p></article></body>"))
        data.append((50 + i, "http://n.org", f"<head><title>{i}</title></head><body><article><h1>Same</h1><p>Text</p></article></body>"))
    want[60] = "Other"
    data.append((60, "http://c.org", "<body><article><h1>Other</h1></article></body>"))
    got = html_text.extract_main_text(rows("page_id long, url string, html string", *data)).collect()
    assert {r.page_id: r.text for r in got} == want


# decontamination
def test_banded_alignment_brute_force():
    import random
    rng = random.Random(3)
    for _ in range(200):
        pattern = "".join(rng.choice("ab") for _ in range(12))
        text = "".join(rng.choice("ab") for _ in range(30))
        best = min(_distance(pattern, text[s:e]) for s in range(31) for e in range(s, 31))
        hit = decontaminate.banded_alignment(pattern, text, 0, 30, 3)
        assert (hit[2] if hit else None) == (best if best <= 3 else None)
        assert hit is None or _distance(pattern, text[hit[0]:hit[1]]) == hit[2]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_leaks(rows, spark, odd, empty):
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly juggle glass boxes near the old harbour at dawn"
    near = item.replace("quick", "quack").replace("wizards", "wizzards").upper()
    docs = rows("doc_id long, text string, score int", (1, "before. " + item + " after", 1), (2, near, 1), (3, "nothing of it", 1),
                (4, None, 1), (5, item[:70], 1), (6, "pad " * 30_000 + item, 1), (1, "before. " + item + " after", 1))
    bench = rows("item_id long, text string, score int", (10, item, 0), (11, None, 0), (12, "short", 0), (13, "", 0))
    got = decontaminate.find_leaks(docs, bench).collect()
    assert sorted({(r.doc_id, r.item_id) for r in got}) == [(1, 10), (2, 10), (6, 10)] and len(got) == 4
    assert next(r for r in got if r.doc_id == 2).edits > 0
    assert [r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()] == [3, 4, 5]
    assert decontaminate.find_leaks(odd, bench).count() == 0 and decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs, bench.limit(0)).count() == 7
    blocks = list(decontaminate.benchmark_blocks(table(spark, FOLDER, "benchmark"), chars=2_000))
    assert len(blocks) > 1 and sum(map(len, blocks)) == 40


@pytest.mark.parametrize("size", [100, 300])
def test_parts_of_items_at_every_offset(size):
    import random
    rng = random.Random(9)
    item, noise = ("".join(rng.choice("abcdefghijkl ") for _ in range(n)) for n in (size, 500))
    index = decontaminate.ItemIndex([(1, item)])
    for length in (decontaminate.PASSAGE, 95, 115, 180):
        texts = [noise[:60] + item[k:k + length] + noise[60:120] for k in range(size - length + 1)]
        assert [row[0] for row in index.leaks(texts)] == list(range(len(texts)))
    assert index.leaks([noise, noise[:60] + item[10:70] + noise[60:]]) == []
    edited = [noise[:60] + item[k:k + 40] + "##" + item[k + 42:k + 80] + noise[60:] for k in range(size - 79)]
    assert len(index.leaks(edited)) == len(edited)


def test_every_whole_item_is_found(spark):
    docs = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    items = {r.item_id: r.text for r in table(spark, "/root/testdata/sf0.01", "benchmark").collect()}
    whole = {(d, i) for d, t in docs.items() for i, x in items.items() if t and x in t}
    assert whole and whole <= {(r.doc_id, r.item_id) for r in queries.op9_benchmark_leaks(spark, "/root/testdata/sf0.01").collect()}


# helpers
def test_span_hashes_know_content_only():
    points, starts = code_points(["abcxabc", "abc"])
    import numpy as np
    got = SpanHashes(points).of(np.array([0, 4, 7, 1]), np.array([3, 3, 3, 3]))
    assert got[0] == got[1] == got[2] != got[3]
    words, starts = blank_word_hashes(["a b", None, "B\ta ", ""])
    assert starts.tolist() == [0, 2, 2, 4, 4] and words[0] == words[3] and words[1] == words[2]


def test_line_numbers_are_the_engine_s(spark):
    text = "Éa line of text"
    mine = xxhash.xxh64_intdigest(text.encode(), 42)
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] == mine - (mine >> 63 << 64)


GLUE = ["", " ", "a", "Z", "7", "é", "©", "(", "-", "\n"]
NOTICE_TEXTS = [
    "permission is hereby granted, free of charge, to any person obtaining a copy", "is in the public domain",
    "redistribution and use in source and binary forms", "as published by the free software foundation", "copyright 2020",
    "© 2020", "copyright (c) 2021", "without prior written permission", "proprietary and confidential", "apache.org/licenses/license-2.0",
    "spdx-license-identifier: mit", "licensed under the mit license", "cc by", "all rights reserved", "general public license"]


def test_words_around_glued_notices():
    """Every notice glued to letters, digits and signs: words and places as a plain count has them."""
    base = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for notice in NOTICE_TEXTS:
        for before in GLUE:
            for after in GLUE:
                text = f"We put th{before}{notice}{after}x cc by{after} all"
                words = [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())]
                at = {label: [k for k in range(len(words)) if words[k:k + len(p.split())] == p.split()] for p, label in base.items()}
                count, found = licenses.detect(text)
                assert count == len(words), text
                places = sorted(k for ks in at.values() for k in ks)
                assert sorted(d.word for d in found if d.base) == places, text
                assert {d.label for d in found if d.base} == {label for label, ks in at.items() if ks}
                for d in found:
                    assert not d.start or not re.match(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]{2}", text.lower()[d.start - 1:d.start + 1]), text


def test_no_notice_inside_a_word():
    assert {d.label for d in licenses.detect("We put this in the public domain. uncopyright 2020")[1]} == set()
    assert {d.label for d in licenses.detect("It is in the public domain")[1]} == {"public-domain"}


def test_inputs_of_a_million_characters():
    """Each within a moment: what is read twice grows with the square."""
    for text in ("\\" * 1_000_000, "\\" * 500_000 + "###", "#" * 1_000_000, "</turn>\\" * 100_000, "### " * 200_000):
        began = time.perf_counter()
        assert chat.unescape(chat.escape(text)) == text
        shown = chat.render("user", chat.escape(text))
        assert [(r, t) for r, t, _, _ in chat.parse(shown)] == [("user", text)]
        assert time.perf_counter() - began < 5
    for page in ("<a " * 300_000, '<a b="' * 150_000, "<a b='x\" " * 100_000, "<svg " * 200_000, "<script " * 100_000, "<!--" * 200_000,
                 "<p" + "= " * 400_000 + ">", "<div>" * 2_000 + "x" * 900_000):
        began = time.perf_counter()
        assert html_text.main_text("<p>first</p>" + page, None).startswith("first")
        assert time.perf_counter() - began < 5


def test_every_short_text_of_marks_survives():
    """All strings of the control characters up to six places, with and without other text around."""
    for size in range(7):
        for marks in itertools.product("#\\ ", repeat=size):
            for around in ("{}", "a{}b", "</turn>{}", "{}</turn>"):
                text = around.format("".join(marks))
                shown = chat.render_checked("user", text)
                assert [t[:2] for t in chat.parse(shown)] == [("user", text)]


def test_breaks_part_words_and_broken_tags_stay():
    page = '<p>one<br>two<hr/>three<img src=x>four <b title="a>b">five</b> <a title="x"">six</a> se<wbr>ven 1 < 2 <y and z'
    assert html_text.main_text(page, None).split("\n")[0].startswith("one two")
    assert " ".join(html_text.main_text(page, None).split()) == "one two three four five six seven 1 < 2 <y and z"
