"""Each operator against a brute-force version, on awkward documents."""

from __future__ import annotations

import collections
import functools
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("lumenspan.llm")

from helpers import awkward, frame, prose  # noqa: E402

from lumenspan.llm import op1_html, op2_pii, op3_license, op4_chat, op5_quality, op6_automata, op7_decontam, op8_simhash, op9_packing, op10_suffix, repeats  # noqa: E402
from lumenspan.llm.common import Rows  # noqa: E402

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def rows_by_key(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


# --- op1 ---

PAGE = """<!DOCTYPE html><html><head><title>T &amp; more</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="no-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="ad-1">Buy</div><article><h1>{0}</h1><p>First <b>bold</b>ly  said<br>here &amp; there<p>Second {1} &lt;b&gt;<!-- note --><form><input>Search</form></p><div class="share">Share this</div><aside>Side</aside></article>
<section class="comments"><p>nice!</p></section><footer>&copy; host</footer>"""


def test_extraction(spark):
    pages = [(i, f"http://a.example/{i}", PAGE.format(f"Title {i}", f"number {i}"), "x") for i in range(6)]
    plain = "<html><body><div class=menu>Menu</div><div class=story><p>Only words {0} that vary from page to page here</p></div><div>Same on all</div></body></html>"
    pages += [(10 + i, "https://b.example:80/x", plain.format("and words" * (i + 1)), "x") for i in range(5)]
    pages += [(20, None, None, "x"), (21, "bad url", "", "x"), (22, "http://c.example", "just text &lt; no tags <", "x"), (23, "http://c.example", "<div>" * 400 + "deep" + "</div>" * 400, "x"), (22, "http://c.example", "<p>one<p>two", "x")]
    got = op1_html.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string, HOST string")).collect()
    assert len(got) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[3] == "Title 3\n\nFirst boldly said here & there\n\nSecond number 3 <b>"
    assert text[12] == "Only words " + "and words" * 3 + " that vary from page to page here"
    assert (text[20], text[21], text[23]) == ("", "", "deep")
    assert {r["text"] for r in got if r["page_id"] == 22} == {"just text < no tags <", "one\n\ntwo"}


def test_wrappers_generalise(spark):
    one = op1_html.node_of(op1_html.parse("<ul><li>a<li>b</ul><p>x</p>"))
    two = op1_html.node_of(op1_html.parse("<ul><li>a</ul><h2>t</h2><p>x</p><p>y</p>"))
    said = op1_html.expression(op1_html.merge(one, two))
    assert said == "<><ul>(<li>(#)+</>)+</>(<h2>#</>)?(<p>(#)+</>)+</>"


def texts_of(*pages: str) -> list[str]:
    """The texts of the pages of one host."""
    nodes = [op1_html.node_of(op1_html.parse(p)) for p in pages]
    wrapper = op1_html.judged(functools.reduce(op1_html.merge, nodes))
    return [op1_html.extract(op1_html.parse(p), wrapper) for p in pages]


def test_names_break_ties_only():
    for name in ('class="social-science"', 'class="reply"', 'id="search-theory"'):
        assert texts_of(f"<nav><a href=x>m</a></nav><article><h1>T</h1><div {name}><p>Article text</p></div></article><footer>f</footer>") == ["T\n\nArticle text"]
        assert texts_of(f"<nav><a href=x>m</a></nav><div {name}><p>Article text</p></div><footer>f</footer>") == ["Article text"]
    main = "<article><h1>A</h1><p>Main text that is long enough to be the main one, really.</p></article>"
    for teaser in ("<article class=card><h2>Teaser</h2><p>short</p></article>", "<article><h2>Teaser</h2><p>short</p></article>"):
        assert texts_of(main + teaser) == texts_of(main)
    assert texts_of(main + "<section class=thread><div>user says hi</div></section>") == texts_of(main)


def test_depth_and_open_elements():
    for depth in (10, 60, 300):
        assert texts_of("<div>" * depth + "<nav>MENU</nav><p>body</p>") == ["body"]
    assert texts_of("<article><button>Share <p>one</p><p>two</p></article>") == ["one\n\ntwo"]
    assert texts_of("<article><p>a</p><iframe src=x><p>one</p></article>") == ["a\n\none"]
    assert texts_of("<article><select><option>a<p>one</p></article>") == ["one"]


def test_wrapper_without_names():
    """Nothing is named: what varies outside links is the text."""
    page = "<div class=qa><ul><li><a href=/a>Menu</a></ul></div><div class=qb>Same on all pages of the host</div><div class=qc><h1>Title {0}</h1><p>Text {0} of the page</p><p>and more</p></div><div class=qd>(c) host</div>"
    assert texts_of(*(page.format(f"{i} {'x' * i}") for i in range(5)))[3] == "Title 3 xxx\n\nText 3 xxx of the page\n\nand more"


def test_wrappers_do_not_depend_on_order(spark):
    kinds = ["<h1>t{0}</h1><p>x{0}</p>", "<h2>u{0}</h2><p>y</p><ul><li>1</ul>", "<p>z{0}</p><div class=k>w</div><p>v</p>", "<div class=m>q{0}</div>"]
    rows = [("http://a.example/", kinds[i % 4].format(i)) for i in range(40)]
    got = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "url string, html string").repartition(1 + 2 * seed)
        got.add(tuple(r["wrapper"] for r in op1_html.wrappers(df, most=3).collect()))
    assert len(got) == 1 and len(next(iter(got))) == 1


def test_alignment_is_longest():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([[rng.choice("pqrs"), 0, 1, 0, 0, 0, []] for _ in range(rng.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i][0] == b[j][0] else max(table[i][j + 1], table[i + 1][j])
        pairs = op1_html.align(a, b)
        assert len(pairs) == table[-1][-1] and all(a[i][0] == b[j][0] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_wrappers_joined_by_host(spark, monkeypatch):
    monkeypatch.setattr(op1_html, "SENT_BYTES", -1)
    test_extraction(spark)


# --- op2 ---

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and op2_pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b@", "@", ".", "1", "25", "300", "+", " ", "-", "4111 1111 1111 1111", "x.y", "\n", "é", "(", "+49 30 1234567"]) for _ in range(rng.randrange(30)))
        assert op2_pii.base_spans(text) == brute_spans(text), text
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" * 50_000):
        op2_pii.base_spans(text)


def test_pii_report(spark):
    near = "the courier zanzibarine met jo@x.example near dock {0} while {1} sang"
    docs = awkward() + [(200 + i, near.format(prose(random.Random(i), 3), prose(random.Random(i + 50), 4))) for i in range(5)] + [(300, "mail a@b.cd, +49 30 1234567, 10.0.0.1, 4111-1111-1111-1111")]
    got = op2_pii.pii_report(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    by_id = {r["doc_id"]: r for r in got}
    for i, t in docs:
        base = brute_spans(t or "")
        r = by_id[i]
        assert r["base_sha256"] == sha(",".join(f"{k}:{s}:{e}" for k, s, e in base))
        assert [r[f"n_{k}"] for k in BASE] == [sum(x[0] == k for x in base) for k in BASE]
    assert "term:12:23" in by_id[201]["spans"] or "hint:12:23" in by_id[201]["spans"]  # zanzibarine tells who it is
    clean = {r["doc_id"]: r["text"] for r in op2_pii.sanitise(frame(spark, docs)).collect()}
    assert clean[300] == "mail [EMAIL], [PHONE], [IP], [CARD]" and clean[1] is None and clean[7] == dict(docs)[7] and "zanzibarine" not in clean[201]


@pytest.mark.parametrize("bound", [50_000, 0])
def test_pii_terms_far_from_the_value(spark, monkeypatch, bound):
    """A disclosing term goes far from the value, and from a document without it; a common word stays."""
    monkeypatch.setattr(op2_pii, "KNOWN_TERMS", bound)
    rng = random.Random(6)
    docs = [(i, f"Zanzibarine! {prose(rng, 40)} kept jo@x.example {prose(rng, 5)}") for i in range(4)] + [(9, f"{prose(rng, 10)} kept zanzibarine {prose(rng, 10)}")]
    docs += [(100 + i, f"{prose(rng, 30)} kept") for i in range(300)]
    clean = {r["doc_id"]: r["text"] for r in op2_pii.sanitise(frame(spark, docs)).collect()}
    spans = {r["doc_id"]: r["spans"] for r in op2_pii.pii_report(frame(spark, docs)).collect()}
    for i in (0, 1, 2, 3, 9):
        assert "zanzibarine" not in clean[i].lower() and " kept " in clean[i]
        assert "term" in spans[i] or "hint" in spans[i]
    assert all(clean[i] == t for i, t in docs if i >= 100)


def test_pii_near_copies_support_once(spark):
    """A passage copied with its value discloses nothing by being copied; a term of independent contexts still does."""
    rng = random.Random(8)
    words = [f"{w}{i}" for i, w in enumerate(prose(rng, 60).split())]
    docs = []
    for i in range(300):
        near = list(words)
        for _ in range(rng.randrange(1, 5)):
            near[rng.randrange(len(near))] = f"edit{rng.randrange(10**6)}"
        docs.append((i, " ".join([*near, "call +49 30 1234567"])))
    docs += [(500 + i, f"{prose(rng, 50)} Zanzibarine {prose(rng, 40)} jo@x.example") for i in range(5)] + [(600, " ".join(words))]
    docs += [(700 + i, prose(rng, 90)) for i in range(100)]
    spans = {r["doc_id"]: [x.split(":")[0] for x in r["spans"].split(",")] for r in op2_pii.pii_report(frame(spark, docs)).collect()}
    assert all(spans[i] == ["phone"] for i in range(300)) and spans[600] == [""]
    assert all(set(spans[500 + i]) == {"email", "term"} for i in range(5))


def test_pii_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(op2_pii, "KNOWN_TERMS", 0)
    test_pii_report(spark)


def test_known_words_are_those_of_terms():
    """The words that counting looks at are the same by bytes as by terms, whatever the white space, and beyond the memory."""
    texts = [t or "" for _, t in awkward()] + ["Zürich\u00a0x (Zürich), \x1cSTONE\x0bstone.\x0cRiver\u2028river", *(f"w{i} stone" for i in range(3))]
    terms = {"stone", "straße", "señor", "zürich", "river\u2028river", "zürich\u00a0x", "ab"}
    known = op2_pii.Known({op2_pii.term_key(x) for x in terms})
    for t in texts:
        assert known.found(t.encode()) == {op2_pii.term_key(x) for x in terms & op2_pii.terms_of(t)}
    known.seen |= {b"%d" % i for i in range(200_001)}
    assert known.found(b"new Stone, x") == {op2_pii.term_key("stone")} and len(known.seen) == 3


def test_counting_known_terms_takes_no_text_apart(spark, tmp_path, monkeypatch):
    """To count known terms, texts are not taken apart into all their terms."""
    docs = [(i, f"write to one@mail.example about zebra{'abcde'[i]} zebras {'xyz '[i % 3] * 4}{i}") for i in range(5)] + [(10 + i, f"plain text {i} zebras") for i in range(40)]
    own, log = op2_pii.terms_of, str(tmp_path / "texts")

    def terms_of(text: str) -> set[str]:
        with open(log, "a") as f:
            f.write(text.replace("\n", " ") + "\n")
        return own(text)

    monkeypatch.setattr(op2_pii, "terms_of", terms_of)
    got = {(r["term"]) for r in op2_pii.disclosures(frame(spark, docs)).collect()}
    assert op2_pii.term_key("zebras") in got
    assert not os.path.exists(log) or not [t for t in open(log) if t.startswith("plain text")]


def test_pii_against_brute_force(spark):
    """Every span of a table where the method fires, against counts of documents in plain Python."""
    rng, said = random.Random(6), [f"w{i:03}" for i in range(60)]
    docs = []
    for i in range(60):
        words = rng.sample(said, 12)
        if i % 6 == 0:
            words += ["ann@mail.example", "Plover", "quay7"]
        elif i % 6 == 1:
            words += ["ann@mail.example"] + (["Plover"] if i % 12 == 1 else [])
        elif i % 6 == 2:
            words += ["10.1.2.3", "lantern"] + (["Plover"] if i == 2 else [])
        elif i == 3:
            words += ["lantern", "Plover"]
        docs.append((i, " ".join(words)))
    docs += [(60 + i, docs[0][1]) for i in range(3)]
    terms = [{w.lower() for w in t.split() if len(w) > 2 and "@" not in w and w != "10.1.2.3"} for _, t in docs]
    worst: dict[str, float] = collections.defaultdict(lambda: -math.inf)
    for entity in ("ann@mail.example", "10.1.2.3"):
        own = [i for i, (_, t) in enumerate(docs) if entity in t.split()]
        for x in set().union(*(terms[i] for i in own)):
            both = [i for i in own if x in terms[i]]
            if len({frozenset(terms[i]) for i in both}) >= 3:
                p = [n / len(docs) for n in (len(both), sum(x in t for t in terms), len(own))]
                worst[x] = max(worst[x], math.log(p[0] / p[1] / p[2]) / -math.log(p[2]))
    kinds = {x: "term" if v >= 0.95 else "hint" for x, v in worst.items() if v >= 0.8}
    assert {"term", "hint"} <= set(kinds.values())
    want = {}
    for i, t in docs:
        more = sorted((kinds[m[0].lower()], m.start(), m.end()) for m in WORDS.finditer(t) if m[0].lower() in kinds)
        want[i] = ",".join(f"{k}:{s}:{e}" for k, s, e in brute_spans(t) + more)
    assert {r["doc_id"]: r["spans"] for r in op2_pii.pii_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want
    assert [op2_pii.general(w) for w in ("1234,", "a7", "Ann.", "quay")] == ["4-DIGIT NUMBER", "CODE", "NAME", "WORD"]


# --- op3 ---


def test_licenses(spark):
    docs = awkward() + [(100, "text\nLicensed under the Apache License, Version 2.0.\nmore"), (101, "Released under the MIT License."), (102, "All rights reserved.\nhe renewed his driving license"), (103, "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3."), (104, "x license " * 5000)]
    got = {r["doc_id"]: (r["n_paragraphs"], r["families"]) for r in op3_license.license_scan(frame(spark, docs)).collect()}
    assert len(got) == len({i for i, _ in docs})
    assert got[100] == (1, "apache-2.0") and got[101] == (1, "mit") and got[103] == (2, "cc-by-nc,gpl-3.0")
    assert all(v == (0, "") for k, v in got.items() if k not in (100, 101, 103))


def test_wrapped_licenses(spark):
    """Whole notices, wrapped as in source files: each is its own family, not a like one."""
    header = "This {0} is free software{1} you can redistribute it and/or modify\nit under the terms of the GNU {2}General Public License as published by\nthe Free Software Foundation{3} either version {4} of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details."
    texts = {
        "gpl-3.0": header.format("program", ":", "", ",", "3"), "gpl-2.0": header.format("program", ";", "", ";", "2"), "lgpl": header.format("library", ";", "Lesser ", ";", "2.1"), "agpl": header.format("program", ":", "Affero ", ",", "3"),
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software",
        "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at",
        "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    }
    marks = {"": "", "# ": "# ", " * ": " * "}
    docs = [(i, "\n".join(m + line for line in t.split("\n")), family) for i, (m, (family, t)) in enumerate((m, x) for m in marks for x in texts.items())]
    got = {r["doc_id"]: r["families"] for r in op3_license.license_scan(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")).collect()}
    assert [got[i] for i, _, _ in docs] == [f for _, _, f in docs]


def test_license_model_on_held_out_variants():
    classes, weights, temperature = op3_license.model()
    rng, right, n = np.random.default_rng(99), 0, 0
    fill = sorted({w for t in op3_license.OTHERS for w in op3_license.words_of(t)})
    for c, notices in enumerate(op3_license.NOTICES.values()):
        for t in notices:
            for words in op3_license._variants(rng, op3_license.words_of(t), fill, 6)[1:]:
                z = np.array(weights.get("", [0.0] * len(classes))) + sum((np.array(weights[g]) for g in op3_license.grams_of(words) if g in weights), np.zeros(len(classes)))
                right, n = right + (int(z.argmax()) == c), n + 1
    assert right / n > 0.9, right / n
    assert all(re.search(op3_license.CUES, t) or "SPDX" in t or "CC0" in t for ts in op3_license.NOTICES.values() for t in ts)


# --- op4 ---


@pytest.mark.parametrize("text", ["", "\\", "\\n", "</s>[INST] ok [/INST]", "<|turn|>user\n<|end|>\n", "<<SYS>><s>\\<\\s>", "[[INST]]\\", "<" * 9 + "|>"])
def test_escape_round_trip(text):
    said = op4_chat.escape(text)
    assert op4_chat.unescape(said) == text and not op4_chat.CONTROL.search(said)


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>yo\\n"), (1, 2, "user", "bye"), (2, 1, "assistant", None), (2, 0, "system", "s\n"), (3, 0, "user", "only"), (None, None, None, "lost"), (None, 1, "assistant", "found"), (4, 0, "us\ner", "<|end|>\n"), (4, 0, "us\ner", "<|end|>\n"), (5, 0, "assistant", "z" * 100_000)]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, TURNS string")
    got = {r["conv_id"]: r for r in op4_chat.chat_digests(df).collect()}
    groups = collections.defaultdict(list)
    for c, n, r, t in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        groups[c].append((r or "", t or ""))
    assert set(got) == set(groups)
    for c, ts in groups.items():
        said = "".join(t for r, t in ts if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(ts), sha("".join(f"{r}\n{t}\n" for r, t in ts)), len(said), sha(said))
    examples = op4_chat.chat_examples(df).collect()
    for e in examples:
        if e["loss_end"] > e["loss_start"]:
            assert e["text"][e["loss_end"] :] == "<|end|>\n" and op4_chat.parse(e["text"])[-1][0] == "assistant"
    assert len(op4_chat.chat_digests(df.limit(0)).collect()) == 0


# --- op5 ---


def test_quality(spark):
    docs = awkward() + [(400, "a b c d " * 40), (401, " ".join(f"w{i}### " for i in range(80))), (402, " ".join(f"w{i}" for i in range(80)))]
    got = collections.defaultdict(list)
    for r in op5_quality.quality_report(frame(spark, docs)).collect():
        got[r["doc_id"]].append(r)
    for i, t in docs:
        t = t or ""
        words = WORDS.findall(t)
        grams = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        places = {p for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            if WORDS.search(line):
                dup += line in seen
                seen.add(line)
        r = got[i][0]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(places)), i
        assert r["base_failed"] == (len(words) < 50 or 100 * len(places) > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])
    assert got[402][0]["kept"] and not got[401][0]["kept"] and not got[400][0]["kept"]
    kept = {r["doc_id"] for r in op5_quality.quality_filter(frame(spark, docs)).collect()}
    assert kept == {i for i, rs in got.items() if rs[0]["kept"]}
    assert op5_quality.quality_report(frame(spark, docs).limit(0)).count() == 0


# --- op6, op10 ---


def brute_cover(seqs: list, length: int) -> list[list[bool]]:
    count = collections.Counter(tuple(s[i : i + length]) for s in seqs for i in range(len(s) - length + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if count[tuple(s[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def small(docs):
    return [(i, t[:6000] if t else t) for i, t in docs]


@pytest.mark.parametrize("split", [None, 2])
def test_passages(spark, monkeypatch, split):
    if split:
        monkeypatch.setattr(repeats, "SPLIT_AT", split)
    docs = small(awkward())
    words = [WORDS.findall(t or "") for _, t in docs]
    want = [(i, len(w), sum(g), sha(" ".join(x for x, y in zip(w, g) if not y))) for (i, _), w, g in zip(docs, words, brute_cover(words, 35))]
    assert rows_by_key(op6_automata.passage_dedup(frame(spark, docs)).collect(), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert op6_automata.passage_dedup(frame(spark, docs).limit(0)).count() == 0


@pytest.mark.parametrize("split", [None, 2])
def test_suffixes(spark, monkeypatch, split):
    if split:
        monkeypatch.setattr(repeats, "SPLIT_AT", split)
    docs = small(awkward())
    texts = [(t or "").encode() for _, t in docs]
    want = []
    for (i, _), t, g in zip(docs, texts, brute_cover(texts, 400)):
        spans = sum(g[k] and (k == 0 or not g[k - 1]) for k in range(len(g)))
        want.append((i, len(t), sum(g), spans, sha(bytes(x for x, y in zip(t, g) if not y))))
    got = op10_suffix.suffix_dedup(frame(spark, docs)).collect()
    assert rows_by_key(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    assert op10_suffix.suffix_dedup(frame(spark, docs).limit(0)).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(5)
    for text in (rng.integers(97, 100, 400, dtype=np.uint8), np.frombuffer(b"ab" * 150, np.uint8), np.zeros(100, np.uint8) + 97, np.zeros(0, np.uint8)):
        body = text.tobytes()
        assert op10_suffix.suffix_array(text).tolist() == sorted(range(len(body)), key=lambda i: body[i:])


def test_anchors_meet_equal_windows():
    rng = np.random.default_rng(8)
    shape, powers = repeats.Shape(35, 12), repeats.Powers()
    part = rng.integers(1, 1 << 60, 60, dtype=np.uint64)
    docs = [np.concatenate([rng.integers(1, 1 << 60, rng.integers(0, 90), dtype=np.uint64), part, rng.integers(1, 1 << 60, rng.integers(0, 90), dtype=np.uint64)]) for _ in range(20)]
    doc, h, *_ = repeats.corpus_anchors(np.concatenate(docs), np.array([len(d) for d in docs]), shape, powers)
    common = set.intersection(*(set(h[doc == i].tolist()) for i in range(20)))
    assert common


# --- op7 ---


def test_decontamination(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, 40)) for i in range(8)] + [(90, None), (91, ""), (92, "tiny"), (0, "zz unmatched item that no text holds at all, of some length")]
    leaked = items[3][1]
    edited = leaked.replace("the", "tha", 1).upper()
    docs = awkward() + [(500, f"{prose(rng, 30)} {leaked} {prose(rng, 30)}"), (501, f"{prose(rng, 9)}\n{edited}"), (502, leaked[: len(leaked) // 2]), (503, "a tiny thing"), (500, leaked)]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = op7_decontam.leaks(frame(spark, docs), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(500, 3), (501, 3), (503, 92)}
    kept = {r["doc_id"] for r in op7_decontam.decontaminate(frame(spark, docs), bench).collect()}
    assert kept == {i for i, _ in docs} - {500, 501, 503}
    assert op7_decontam.leaks(frame(spark, docs), bench.limit(0)).count() == 0 and op7_decontam.leaks(frame(spark, docs).limit(0), bench).count() == 0


def test_lemma_loses_no_edited_item():
    rng = random.Random(6)
    rows = [(i, op7_decontam.normal(prose(rng, 50))) for i in range(5)]
    items = op7_decontam.Items.of(rows, 0.05, op7_decontam.Q)
    table = np.zeros(1 << op7_decontam._TABLE_BITS, bool)
    table[(items.keys >> np.uint64(64 - op7_decontam._TABLE_BITS)).astype(np.int64)] = True
    for _ in range(150):
        k = rng.randrange(5)
        body = bytearray(rows[k][1])
        for _ in range(int(items.edits[k])):
            p = rng.randrange(len(body))
            body[p : p + rng.randrange(2)] = rng.choice([b"", b"q", b"z"])
        text = op7_decontam.normal(prose(rng, 20)) + b" " + bytes(body) + b" " + op7_decontam.normal(prose(rng, 20))
        assert any(x[1] == k for x in op7_decontam.find([text], items, table, op7_decontam.Q))


# --- op8 ---


def brute_fingerprint(text: str | None) -> int:
    import xxhash

    words = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("tau", [0, 4, 12])
def test_near_duplicates(spark, tau):
    docs = awkward()
    fp = [brute_fingerprint(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= tau:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    want = []
    for i in range(len(docs)):
        ids = [d for (d, _), g in zip(docs, group) if g == group[i] and d is not None]
        want.append((docs[i][0], fp[i] - (1 << 64) * (fp[i] >> 63), min(ids, default=None)))
    got = op8_simhash.near_duplicates(frame(spark, docs), tau=tau).collect()
    assert rows_by_key(got, "doc_id", "fp", "component_id") == sorted(want, key=repr)
    assert op8_simhash.near_duplicates(frame(spark, docs).limit(0), tau=tau).count() == 0


def similar_groups(df) -> dict[int, int]:
    """For each row, by its place among rows in order, the first place of its group."""
    rows = Rows(df, "row_id", "rows")
    at = {r["row_id"]: i for i, r in enumerate(sorted(rows.df.select("row_id").collect()))}
    return {at[r["key"]]: at[r["group"]] for r in op8_simhash.similar_groups(rows).collect()}


def test_similar_groups(spark):
    """Groups against all pairs, on copies with few to many words changed."""
    rng = random.Random(21)
    docs = [(i, t) for i, t in enumerate([t for _, t in awkward()])]
    for k in range(12):
        words = [f"{w}{rng.randrange(9999)}" for w in prose(rng, 60 + 40 * k).split()]
        for share in (0.0, 0.01, 0.02, 0.05, 0.2):
            docs.append((len(docs), " ".join("q" if rng.random() < share else w.upper() if rng.random() < 0.1 else w for w in words)))
    sets = []
    for _, t in docs:
        w = WORDS.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))})
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    got = similar_groups(frame(spark, docs))
    missed = [i for i in range(len(docs)) if got[i] != group[i]]
    assert not missed, missed
    assert not similar_groups(frame(spark, docs).limit(0))


def brute_groups(texts: list[str]) -> list[int]:
    """For each text the first that it is linked to by steps of Jaccard similarity 0.8 or more of five-word shingles."""
    sets = []
    for t in texts:
        w = t.split()
        sets.append({hash(tuple(w[i : i + 5])) for i in range(max(len(w) - 4, 1))})
    group = list(range(len(sets)))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                p, q = sorted((root(i), root(j)))
                group[q] = p
    return [root(i) for i in range(len(sets))]


def groups_of(spark, texts: list[str]) -> list[int]:
    got = similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    return [got[i] for i in range(len(texts))]


def star(n: int) -> list[str]:
    """A text of 200 words and ``n`` copies with four words changed: alike to the text, but hardly to each other."""
    rng = random.Random(31)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [base] + [list(base) for _ in range(n)]
    for words in texts[1:]:
        for at in rng.sample(range(5, 195), 4):
            words[at] = f"e{rng.randrange(10**6)}"
    return [" ".join(words) for words in texts]


def test_similar_groups_of_a_star(spark):
    texts = star(1000)
    want = brute_groups(texts)
    missed = [i for i, (x, y) in enumerate(zip(groups_of(spark, texts), want)) if x != y]
    assert want.count(0) > 990 and not missed, len(missed)


@pytest.mark.parametrize("common", [2, 5])
def test_similar_groups_close_to_the_threshold(spark, monkeypatch, common):
    """Scattered words, a passage put in, a passage at the end, and one repeated, on both sides of 0.8."""
    monkeypatch.setattr(op8_simhash, "COMMON", common)
    rng, texts = random.Random(41), []
    new = lambda n: [f"n{rng.randrange(10**6)}" for _ in range(n)]
    for k in range(60):
        n = rng.choice([9, 30, 60, 150, 400, 1500])
        base, near = new(n), rng.uniform(0.7, 1.1)
        if k % 4 == 0:
            other = list(base)
            for at in rng.sample(range(n), max(int(near * n / 45), 1)):
                other[at] = new(1)[0]
        elif k % 4 == 1:
            at, m = rng.randrange(n), int(near * n / 9)
            other = (base[:at] + new(m) + base[at + m :])[:n]
        elif k % 4 == 2:
            other = base + new(int(near * n / 4))
        else:
            other = base + base[: n // 3] * 6
        texts += [" ".join(base), " ".join(other)]
    want = brute_groups(texts)
    assert 10 < len(texts) - len(set(want)) < 60
    assert groups_of(spark, texts) == want


def test_similar_groups_in_blocks(spark, monkeypatch):
    """A small star whose base lies in one block and most copies in others."""
    monkeypatch.setattr(op8_simhash, "BLOCK", 16)
    monkeypatch.setattr(op8_simhash, "SHINGLES", 16 * 196, raising=False)
    texts = star(30)
    assert groups_of(spark, texts) == brute_groups(texts)


def test_similar_groups_by_fingerprints(spark, monkeypatch):
    """SimHash's own plan and buckets link near copies: here prefixes link nothing."""
    monkeypatch.setattr(op8_simhash, "WIDE_MOST", -1)
    rng, texts = random.Random(51), []
    for _ in range(8):
        words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        texts += [" ".join(words), " ".join([*words[:-1], "last"]), " ".join([*words, "more"])]
    got = groups_of(spark, texts)
    powers = op8_simhash.Powers()
    fps = op8_simhash.wide_fingerprints([np.unique(op8_simhash._shingles(k, 5)) for k in op8_simhash._word_keys([t.encode() for t in texts], powers)])[:, 0]
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    assert near.sum() > 24 + 16 and brute_groups(texts) == [i // 3 * 3 for i in range(24)]
    assert all(got[i] == got[j] for i, j in zip(*np.nonzero(near))) and all(g // 3 == i // 3 for i, g in enumerate(got))


def test_links_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(op8_simhash, "BLOCK", 2)
    test_near_duplicates(spark, 4)


def test_plan_covers_every_pair():
    rng = np.random.default_rng(3)
    both = np.full((64, 64), 250.0)
    np.fill_diagonal(both, 500.0)
    for n, tau in ((1000, 4), (10**7, 4), (10**6, 7)):
        for m in (2, 3, 5):
            groups = op8_simhash.partition_bits(1000, both, m)
            _, ts = op8_simhash.allocate(n, both * n / 1000, groups, tau)
            if ts:
                assert sorted(sum(groups, [])) == list(range(64)) and sum(t + 1 for t in ts) == tau + 1
                for _ in range(300):
                    flips = set(rng.choice(64, tau, replace=False).tolist())
                    assert any(len(flips & set(g)) <= t for g, t in zip(groups, ts))


# --- op9 ---


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    return path, Tokenizer.from_file(path)


def test_packing(spark):
    path, t = tokenizer()
    docs = awkward() + [(600, "it's 'S x, y. <|endoftext|> <|ENDOFTEXT|>. <|startoftext|>foo. É. é, 3.5. ,. a.\x1cb.  z.")]
    got = op9_packing.pack(frame(spark, docs), path).collect()
    ids = collections.defaultdict(list)
    for i, text in docs:
        ids[i].append(np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    pieces = collections.Counter()
    for r in got:
        assert any(r["doc_tokens"] == len(x) and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
        pieces[r["doc_id"]] += r["length"]
    assert pieces == {i: sum(map(len, x)) for i, x in ids.items()}
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    assert op9_packing.pack(frame(spark, docs).limit(0), path).count() == 0


def test_retrieval_prefers_like_documents():
    rng = np.random.default_rng(1)
    docs = [rng.integers(1000 * (i % 3), 1000 * (i % 3) + 60, 100) for i in range(30)]
    order = list(op9_packing.retrieval_order(op9_packing.Index(docs), [100] * 30, 1000, 1000))
    assert sorted(order) == list(range(30)) and len({i % 3 for i in order[:10]}) == 1
