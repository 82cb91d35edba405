"""Licence scans, HTML rendering, toxicity, search, decontamination and archives against plain versions."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest

from evalspark.llm import decontaminate, html_text, licenses, search, toxicity, warc
from evalspark.session import shared_dir

from . import brute, tables

TERM = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def terms(text):
    return TERM.findall(brute.lower(text))


# --- licences -------------------------------------------------------------------------------------------


def grams(words):
    return set(zip(words, words[1:])) if len(words) > 1 else {tuple(words)} - {()}


def best_dice(text, template, threshold):
    """The greatest coefficient of any run of words that begins and ends with a bigram of the template."""
    w, t = terms(text), grams(terms(template))
    low, high = licenses.size_bounds(len(t), threshold)
    best = 0.0
    for i in range(len(w) - 1):
        for j in range(i + 1, min(len(w), i + high + 1)):
            g = grams(w[i : j + 1])
            if (w[i], w[i + 1]) in t and (w[j - 1], w[j]) in t and j - i >= low:
                best = max(best, 2 * len(g & t) / (len(g) + len(t)))
    return best


def test_licence_scan(spark):
    rng = random.Random(6)
    docs = tables.documents()
    mit = " ".join(licenses.TEMPLATES["MIT"].split())
    docs[200] = tables.prose(rng, 30) + "\n" + mit.upper() + "\n" + tables.prose(rng, 30)
    words = mit.split()
    for i, cut in ((201, 3), (202, 12), (203, 40)):
        w = words[:]
        for _ in range(cut):
            w[rng.randrange(len(w))] = "other"
        docs[i] = " ".join(w)
    docs[204] = "x Released under the MIT License. y Licensed under CC BY-NC 4.0."
    docs[205] = "Released under the"
    rows = licenses.scan(tables.frame(spark, docs)).collect()
    found = {(r.doc_id, r.license): r.dice for r in rows}
    for i in (200, 201, 202, 203, 204, 205, 10, 13, 15):
        for name in ("MIT", "MIT-notice", "CC-BY-NC-4.0-notice"):
            want = best_dice(docs[i], licenses.TEMPLATES[name], licenses.THRESHOLD)
            if want >= licenses.THRESHOLD:
                assert found[i, name] == pytest.approx(want), (i, name)
            else:
                assert (i, name) not in found
    assert {r.license for r in rows if r.doc_id == 204} == {"MIT-notice", "CC-BY-NC-4.0-notice"}
    assert licenses.scan(tables.empty(spark)).collect() == []


def test_every_template_is_found_as_itself(spark):
    """Each template in prose, in capitals and in lines of its own, is found under its name and no other; repeated rows each."""
    rng = random.Random(12)
    around = lambda text: tables.prose(rng, 20) + "\n\n" + text + "\n" + tables.prose(rng, 20)
    rows = [(i, around("\n".join(text.split()).upper() if i % 2 else text)) for i, text in enumerate(licenses.TEMPLATES.values())]
    found = licenses.scan(spark.createDataFrame(rows + rows[:3], "doc_id long, text string")).collect()
    names = list(licenses.TEMPLATES)
    want = [(i, names[i], 1.0) for i in [*range(len(rows)), 0, 1, 2]]
    assert sorted((r.doc_id, r.license, r.dice) for r in found) == sorted(want)


def test_templates_in_changed_texts_by_brute_force(spark):
    """The best coefficient of every passage of one template with words changed, for each template of middling length."""
    rng, docs, at = random.Random(13), {}, {}
    for name, text in licenses.TEMPLATES.items():
        words = " ".join(terms(text)).split()
        if len(words) <= 60:
            for cut in (1, 3):
                for _ in range(cut):
                    words[rng.randrange(len(words))] = "other"
                at[len(docs)] = name
                docs[len(docs)] = "x " + " ".join(words) + " y"
    rows = licenses.scan(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    found = {}
    for r in rows:
        found[r.doc_id] = max(found.get(r.doc_id, 0), r.dice)
    for i, text in docs.items():
        want = max(best_dice(text, t, licenses.THRESHOLD) for t in licenses.TEMPLATES.values() if len(terms(t)) <= 80)
        assert (found.get(i) == pytest.approx(want)) if want >= licenses.THRESHOLD else i not in found, (at[i], want)


# --- HTML -----------------------------------------------------------------------------------------------

PAGES = {
    "": "",
    "plain &amp; text": "plain & text",
    "<p>a  b<b>c</b><p>d<br>e": "a bc\n\nd\ne",
    "<title>t</title><body>x<script>var a='<p>';</script>y": "xy",
    "<style>.z, #q{display:none} p{color:red}</style><div class='a z'>no</div><p id=q>no</p><p>yes": "yes",
    "<div hidden>no</div><div style='x:y; DISPLAY : none'>no<p>no</div><p>yes": "yes",
    "<ul><li>one<li>two<ol start=3><li>x<li>y</ol><li>three</ul>": "- one\n- two\n  3. x\n  4. y\n- three",
    "<table><tr><td>aa<td>b<tr><th>c<td>dd<br>ee</table>z": "aa | b\nc  | dd\n   | ee\n\nz",
    "<table><tr><td colspan=2>wide one<tr><td>a<td>b</table>": "wide one\na | b",
    "<blockquote>q<p>r</blockquote>s": "> q\n\n> r\n\ns",
    "<pre> a\n  b</pre>": " a\n  b",
    "1 < 2 <3 <a href='x>y'>l</a> <!-- <p>no --> m": "1 < 2 <3 l m",
    "<p>open <b>bold<p>next</i></div>": "open bold\n\nnext",
    "<textarea> k\n v</textarea><img alt=pic><hr>": " k\n vpic\n---",
    "<dl><dt>t<dd>d<dt>u</dl>": "t\n  d\nu",
    "<select><option>no</select><noscript>no</noscript><input type=hidden value=no><input value=v>": "v",
    "<!-- never closed <p>no": "",
}


SEEN = {
    "<details><summary>s</summary>no<p>no</details><details open>t<p>u</details>": "s\nt\n\nu",
    "<dialog>no</dialog><dialog open>yes</dialog>": "yes",
    "a<input type=checkbox value=no><input type=PASSWORD value=no><input type=submit value=Go><input type=image alt=b>": "aGob",
    "<select><option>no<option selected>two<option>no</select> x": "two x",
    "<select multiple><option>one<option>two</select>": "one\ntwo",
    "<select size=9999999999><option>one</select>": "one",
    "<svg><title>no</title><text>in a</text><text>drawing</text></svg>": "in a\ndrawing",
    "<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>": "x=1",
    "<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b><i>no</i></div>": "yes",
    "<div style='display:none'>no<b style='visibility:visible'>no</b></div>": "",
    "<style>.a{display:none} #b{display:block} @media print{p{display:none}}</style><p class=a>no<p class=a id=b>yes": "yes",
    "<ul style='visibility:hidden'><li>no<li style='visibility:visible'>yes</ul>": "- yes",
    "<table><tr><td>" + "w" * 60 + "<td>b<tr><td>a<td>c</table>": "w" * 60 + " | b\na" + " " * 59 + " | c",
    "<table><tr><td>" + "w" * 130 + "<td>b<tr><td>aa<td>c<tr><td>a<td>d</table>": "w" * 130 + " | b\naa | c\na  | d",
    "<table><tr><td rowspan=2>tall<td>b<tr><td>c<tr><td>d<td>e</table>": "tall | b\n     | c\nd    | e",
    "<table><tr><td>a<td rowspan=0 colspan=2>b<tr><td>c<td>d<tr><td>e</table>": "a | b\nc |  | d\ne |",
}


def test_rendering():
    assert {h: html_text.render(h) for h in PAGES} == PAGES


def test_visibility_and_tables():
    assert {h: html_text.render(h) for h in SEEN} == SEEN


def test_deep_lists_keep_their_marks():
    page = "".join(f"<ul><li>t{i}" for i in range(40)) + "<ol><li>x<li><li>y</ol><blockquote>q</blockquote>"
    lines = [line for line in html_text.render(page).split("\n") if line]
    assert [line.strip() for line in lines] == [f"- t{i}" for i in range(40)] + ["1. x", "3. y", "> q"]


def _page(rng, depth=0):
    """A page of random blocks, and its text by a plain account of what each block is: (html, list of lines)."""
    html, parts = [], []
    for _ in range(rng.randint(1, 4)):
        words = " ".join(rng.choice(tables.WORDS) for _ in range(rng.randint(1, 6)))
        kind = rng.choice(("p", "list", "table", "quote", "gone") if depth < 3 else ("p", "gone"))
        if kind == "p":
            html.append(f"<p>{words.replace(' ', rng.choice((' ', '<b> </b>', chr(10) + ' ')))}" + rng.choice(("", "</p>")))
            parts.append([words])
        elif kind == "gone":
            html.append(rng.choice(("<div hidden>{}</div>", "<!-- {} -->", "<script>{}</script>", "<p style='display:none'>{}</p>")).format(words))
        elif kind == "quote":
            inner, lines = _page(rng, depth + 1)
            html.append(f"<blockquote>{inner}</blockquote>")
            parts.append(["> " + line if line else line for line in lines])
        elif kind == "list":
            items = [" ".join(rng.choice(tables.WORDS) for _ in range(3)) for _ in range(rng.randint(1, 4))]
            html.append("<ol>" + "".join(f"<li>{i}" for i in items) + "</ol>")
            parts.append([f"{n}. {i}" for n, i in enumerate(items, 1)])
        else:
            cells = [[rng.choice(tables.WORDS) * rng.randint(1, 20) for _ in range(3)] for _ in range(rng.randint(1, 4))]
            html.append("<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in row) for row in cells) + "</table>")
            wide = [max(len(row[k]) for row in cells) for k in range(3)]
            parts.append([" | ".join(c.ljust(w) for c, w in zip(row, wide)).rstrip() for row in cells])
    lines = []
    for part in filter(None, parts):
        lines += ([""] if lines else []) + part
    return "".join(html), lines


def test_random_pages_against_a_plain_account():
    rng = random.Random(11)
    for _ in range(400):
        html, lines = _page(rng)
        assert html_text.render(html) == "\n".join(lines), html


def test_malformed_and_deep_pages_do_not_fail(spark):
    rng = random.Random(8)
    pieces = ["<", ">", "</", "<p", "<table", "<td>", "<li>", "</ul>", "<ul>", "\"", "'", "=", " ", "x", "&lt;", "<!--", "<b>", "</table>"]
    for _ in range(500):
        html_text.render("".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))))
    assert html_text.render("<div>" * 5000 + "x") == "x"
    assert html_text.render("<ul><li>" * 3000 + "x").endswith("- x")
    df = spark.createDataFrame([(1, "<p>a"), (1, "<p>b"), (None, None)], "page_id long, html string")
    assert sorted((r.page_id or 0, r.text) for r in html_text.extract(df).collect()) == [(0, ""), (1, "a"), (1, "b")]


# --- toxicity -------------------------------------------------------------------------------------------


def test_factorization_machine_learns_pairs(spark):
    """Two words are toxic only with their own group word, so every word is as often in toxic texts as in
    others: weights that add up cannot tell."""
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = tables.prose(rng, 12).split() + ["grumble" if a else "mutter", "villagers" if b else "sailors"]
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(a == b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.toxic_scores(df.drop("toxic"), df.select("doc_id", "toxic")).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r.held_out]
    assert 800 < len(held) < 1200
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)


def test_pairs_need_factors(spark):
    """The same rows without factors: no better than chance. So it is the pair term that tells them apart."""
    rng = random.Random(19)
    rows = []
    for i in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = tables.prose(rng, 12).split() + ["insult" if a else "praise", "northerners" if b else "southerners"]
        rows.append((i, " ".join(w), int(a == b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = df.filter(toxicity.held_out())
    right = {}
    for factors in (0, 8):
        model = toxicity.fit(df.drop("toxic"), df.filter(~toxicity.held_out()).select("doc_id", "toxic"), factors=factors)
        scored = toxicity.score(held, model).collect()
        right[factors] = sum((r.score >= 0.5) == bool(r.toxic) for r in scored) / len(scored)
    assert right[8] >= 0.95 and right[0] <= 0.6


def test_pairs_of_rare_words(spark):
    """Twenty groups of four words, each word in one row of forty: toxic is what goes together within a group."""
    rng = random.Random(7)
    rows = []
    for i in range(4000):
        k, a, b = rng.randrange(20), rng.random() < 0.5, rng.random() < 0.5
        w = tables.prose(rng, 12).split() + [f"{'xq'[a]}{k}verb", f"{'zk'[b]}{k}noun"]
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(a == b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.toxic_scores(df.drop("toxic"), df.select("doc_id", "toxic")).collect()
    held = [(r.score >= 0.5) == bool(rows[r.doc_id][2]) for r in out if r.held_out]
    assert sum(held) >= 0.95 * len(held)


@pytest.mark.parametrize("sf,share", [("sf0.01", 0.5), ("sf0.1", 0.9)])
def test_held_out_labels(spark, sf, share):
    read = lambda name: spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")
    out = toxicity.toxic_scores(read("documents"), read("labels")).join(read("labels"), "doc_id").filter("held_out").collect()
    toxic = [r.predicted for r in out if r.toxic]
    clean = [r.predicted for r in out if not r.toxic]
    assert sum(toxic) >= share * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_scores_by_hand(spark):
    """A small model against the definition of a factorization machine over words, their beginnings and levels."""
    words = ["alpha", "beta", "gamma", "beginning", "beg"]
    rng = np.random.default_rng(5)
    slots = 1 << 12
    model = toxicity.Model(-0.3, rng.random(slots) < 0.7, rng.normal(0, 1, slots).astype(np.float32), np.full(slots, -1, np.int32), rng.normal(0, 0.5, (900, 3)))
    place = np.sort(rng.choice(np.flatnonzero(model.known), 900, replace=False))
    model.place[place] = np.arange(900)
    rand = random.Random(5)
    texts = [" ".join(rand.choice(words) for _ in range(rand.randint(0, 9))) for _ in range(40)] + [None]

    def slot(word, prefix, level):
        buf = np.frombuffer(word.encode(), np.uint8)
        if prefix:
            h = toxicity.A.mix(toxicity.A.WORDS.of(toxicity.A.WORDS.prefix(buf), np.array([0]), np.array([prefix])) + toxicity.A.U(prefix))
        else:
            h = toxicity.A.words(buf, np.array([0, len(buf)]))[0]
        return int(toxicity._slot(h, slots, level)[0])

    def expected(text):
        times = {}
        for w in (text or "").split():
            for prefix in (0, *(k for k in toxicity.STEMS if len(w) > k)):
                key = (w[:prefix] if prefix else w, prefix, w if not prefix else "")
                times.setdefault(key, [w, prefix, 0])[2] += 1
        found = set()
        for w, prefix, n in times.values():
            if model.known[slot(w, prefix, 0)]:
                found |= {slot(w, prefix, k) for k in range(min(n, toxicity.LEVELS))}
        found = sorted(s for s in found if model.known[s])
        z = model.bias + sum(float(model.linear[s]) for s in found)
        rows = [model.factors[model.place[s]] for s in found if model.place[s] >= 0]
        z += sum(float(rows[i] @ rows[j]) for i in range(len(rows)) for j in range(i))
        return 1 / (1 + math.exp(-z))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert got == {i: pytest.approx(expected(t), rel=1e-5) for i, t in enumerate(texts)}


def test_shared_ids_are_trained_on_once(spark):
    """A labelled id that very many rows share brings one row to the training."""
    rows = [(1, "insult and more", 1)] * 500 + [(i, "kind words here" if i % 2 else "insult again", i % 2 == 0) for i in range(2, 60)]
    df = spark.createDataFrame([(i, t, int(y)) for i, t, y in rows], "doc_id long, text string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"), epochs=30)
    scored = toxicity.score(df.select("doc_id", "text"), model, score_col="doc_id")
    assert scored.columns == ["text", "doc_id"]
    by_text = {r.text: r.doc_id for r in scored.collect()}
    assert by_text["insult again"] > 0.5 > by_text["kind words here"]


def test_scores_of_awkward_tables(spark):
    docs = tables.documents()
    labels = spark.createDataFrame([(10, 1), (40, 0), (None, 1), (41, None), (10, 1)], "doc_id long, toxic int")
    rows = toxicity.toxic_scores(tables.frame(spark, docs), labels).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    assert toxicity.toxic_scores(tables.empty(spark), labels).collect() == []
    none = toxicity.toxic_scores(tables.frame(spark, docs), labels.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.predicted for r in none)
    scored = toxicity.score(tables.frame(spark, docs), toxicity.fit(tables.frame(spark, docs), labels))
    assert scored.columns == ["doc_id", "text", "id", "spans", "score"]


def test_training_runs_in_a_task(spark, monkeypatch):
    driver, plain = os.getpid(), toxicity.train

    def train(*args):
        assert os.getpid() != driver
        return plain(*args)

    monkeypatch.setattr(toxicity, "train", train)
    rows = [(i, "plain words here" if i % 2 else "utter dimwit here", 1 - i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    assert all((r.score > 0.5) == bool(r.toxic) for r in toxicity.score(df, model).collect())


def test_distinct_values_without_sorting():
    rng, spots = np.random.default_rng(4), np.zeros(50, np.int32)
    for n in (0, 1, 300):
        values = rng.integers(0, 50, n)
        for got, want in zip(toxicity._distinct(values, spots), np.unique(values, return_inverse=True)):
            assert np.array_equal(got, want)
        assert not spots.any()


# --- search ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("query_terms", [search.QUERY_TERMS, 50])
def test_search(spark, query_terms):
    docs = {i: t for i, t in tables.documents().items() if i not in (74, 75)}
    df = tables.frame(spark, docs).repartition(3)
    got = {}
    for r in search.search(df, df.filter("doc_id % 10 = 0"), k=7, query_terms=query_terms).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    count = {i: Counter(terms(t)) for i, t in docs.items()}
    df_of = Counter(w for c in count.values() for w in c)
    size = {i: sum(c.values()) for i, c in count.items()}
    mean = sum(size.values()) / len(docs)
    for q in (i for i in docs if i is not None and i % 10 == 0):
        score = {}
        for i, c in count.items():
            s = sum(
                math.log1p((len(docs) - df_of[w] + 0.5) / (df_of[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[i] / mean))
                for w in count[q] if w in c
            )
            if i != q and s:
                score[i] = s
        want = sorted(score.items(), key=lambda x: (-round(x[1], 9), -(10**9) if x[0] is None else x[0]))[:7]
        assert [(i, pytest.approx(s)) for _, i, s in sorted(got.get(q, []), key=lambda r: r[0])] == want
    assert search.search(tables.empty(spark), tables.empty(spark)).collect() == []


def test_terms_are_found_without_a_binary_search():
    rng = np.random.default_rng(6)
    for n in (1, 7, 3000):
        terms = np.unique(rng.integers(0, 2**64, n, np.uint64))
        terms = np.unique(np.concatenate((terms, terms[:5] + np.uint64(1))))  # some share their leading bits
        words = rng.permutation(np.concatenate((terms, terms, terms - np.uint64(1), rng.integers(0, 2**64, 500, np.uint64))))
        place, term = search._Terms(terms).find(words)
        assert np.array_equal(place, np.flatnonzero(np.isin(words, terms)))
        assert np.array_equal(terms[term], words[place])


def test_whole_lists_and_single_blocks_give_the_same_scores():
    rng = np.random.default_rng(7)
    row, term = np.nonzero(rng.random((500, 40)) < 0.2)
    shard = search.Shard(row, term, rng.integers(1, 5, len(row)), np.full(500, 30), rng.random(40) + 0.1, 30.0)
    full = np.zeros(500)
    np.add.at(full, shard.doc[np.isin(np.repeat(np.arange(40), np.bincount(term, minlength=40)), [3, 5, 9])],
              shard.impact[np.isin(np.repeat(np.arange(40), np.bincount(term, minlength=40)), [3, 5, 9])])
    for floor in (0.0, *np.sort(full)[[-100, -20, -3]]):
        docs, scores = shard.top(np.array([3, 5, 9]), 10, floor, np.empty(0, np.int64))
        least = max(floor, np.sort(full)[-10])
        want = np.flatnonzero(full >= least - 1e-9)
        assert np.array_equal(np.sort(docs), want) and np.allclose(scores, full[docs])


def test_only_what_can_be_among_the_best_is_scored_exactly(monkeypatch):
    """All pairs in single precision, over several shards with common and rare terms, equal texts among them; few exactly."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(search, "SCORES", 5000)
    monkeypatch.setattr(search, "POSTINGS", 9000)
    monkeypatch.setattr(search, "STEP", 500)
    hashes = np.sort(rng.integers(0, 2**63, 400, np.uint64))
    share = np.where(np.arange(400) < 20, 0.6, 0.05)
    texts = [np.flatnonzero(rng.random(400) < share) for _ in range(2000)]
    texts[700:740] = [texts[5]] * 40  # more than k that tie
    texts[13] = texts[1500] = np.empty(0, np.int64)
    times = [rng.integers(1, 5, len(x)) for x in texts]
    times[700:740] = [times[5]] * 40
    ids = rng.permutation(2000)
    ends = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
    batch = pa.record_batch({
        "id": ids, "size": np.array([x.sum() for x in times]),
        "terms": search._blobs(hashes[np.concatenate(texts)], ends), "times": search._blobs(np.concatenate(times).astype(np.int32), ends),
    })
    asked = sorted([5, 13, *range(0, 2000, 40)], key=lambda row: ids[row])
    at = np.concatenate(([0], np.cumsum([len(texts[i]) for i in asked])))
    queries = search.Queries(ids[asked], at, np.concatenate([texts[i] for i in asked]), hashes)
    idf, mean, common = rng.random(400) + 0.1, 60.0, np.arange(20)
    norm = search.K1 * (1 - search.B + search.B * batch.column("size").to_numpy() / mean)
    full = np.zeros((2000, 400))
    for row, (x, n) in enumerate(zip(texts, times)):
        full[row, x] = idf[x] * n * (search.K1 + 1) / (n + norm[row])
    want = {}
    for i in asked:
        score = full[:, texts[i]].sum(axis=1)
        score[ids == ids[i]] = 0
        order = sorted(np.flatnonzero(score), key=lambda row: (-round(score[row], 9), ids[row]))[:10]
        want[int(ids[i])] = [(int(ids[row]), pytest.approx(score[row])) for row in order]
    scored, exact = [], search.Shard.exact
    monkeypatch.setattr(search.Shard, "exact", lambda self, terms, rows: (scored.append(len(rows)), exact(self, terms, rows))[1])
    for floors in (np.zeros(len(asked)), np.array([want[i][-1][1].expected if want[i] else 0.0 for i in ids[asked].tolist()])):
        for known in (common, np.empty(0, np.int64)):
            scored.clear()
            found = search._searcher(queries, idf, mean, known, 10, floors)(iter([batch.slice(0, 1100), batch.slice(1100)]))
            got = {}
            for r in pa.Table.from_batches(found).to_pylist():
                got.setdefault(r["query"], []).append((r["doc"], r["score"]))
            assert got == {i: w for i, w in want.items() if w}
            assert sum(scored) < 0.02 * len(asked) * len(texts)


def test_search_over_many_files(spark):
    """The best of some files are the bar for the others; texts that tie come from both."""
    rows = [(i, " ".join(f"w{(i * j) % 83}" for j in range(1, 30)) if i % 7 else "the same text in many") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted(map(tuple, search.search(df.repartition(n), df.filter("doc_id % 20 = 0"), k=4).collect())) for n in (20, 1)]
    assert found[0] == found[1] and len(found[0]) == 80
    assert [r[2] for r in found[0] if r[0] == 140] == [0, 7, 14, 21]


# --- decontamination ------------------------------------------------------------------------------------


def test_decontamination(spark, monkeypatch):
    rng = random.Random(11)
    items = {i: tables.prose(rng, 30 if i else 150) + "." for i in range(40)}
    items |= {90: None, 91: "", 92: "too short an item", None: tables.prose(rng, 25)}
    docs = {}
    for n, i in enumerate((0, 1, 2, 3, None)):
        docs[n] = tables.prose(rng, 200) + " " + items[i].upper() + " " + tables.prose(rng, 90)
    docs[10] = tables.prose(rng, 400)
    docs[11] = tables.prose(rng, 150) + " " + " ".join(items[5].split()[:20])  # the question alone
    docs[12] = " ".join(rng.sample(items[6].split(), 30))  # its words, but not in order
    docs |= {13: None, 14: "", 15: items[7] + " " + items[8]}
    want = {(0, 0), (1, 1), (2, 2), (3, 3), (4, None), (15, 7), (15, 8)}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for shard_words in (1 << 20, 300):
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard_words)
        rows = decontaminate.matches(tables.frame(spark, docs), bench).collect()
        assert {(r.doc_id, r.item_id) for r in rows if r.contaminated} == want
        assert (12, 6) in {(r.doc_id, r.item_id) for r in rows}  # retrieved, then turned down
    assert decontaminate.matches(tables.empty(spark), bench).collect() == []
    assert decontaminate.matches(tables.frame(spark, docs), bench.limit(0)).collect() == []


def test_short_items_match_their_words_in_a_row(spark):
    rng = random.Random(14)
    items = {1: "Largest ocean? Pacific", 2: "zebra", 3: "one two three four five six seven", 4: tables.prose(rng, 30), 5: " . "}
    docs = {
        1: tables.prose(rng, 200) + " LARGEST ocean: Pacific. " + tables.prose(rng, 9), 2: "largest Pacific ocean",
        3: tables.prose(rng, 90) + " Zebra", 4: "seven six five four three two one", 5: "x one two three four five six seven",
        6: "one two three four five six", 7: "ocean pacific", 8: "pacific largest ocean",
    }
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = decontaminate.matches(tables.frame(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows if r.contaminated} == {(1, 1), (3, 2), (5, 3)}


def test_items_that_share_an_id_are_searched_each(spark, monkeypatch):
    rng = random.Random(15)
    texts = [tables.prose(rng, 30) for _ in range(6)]
    items = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (2, texts[4])]
    docs = {i: tables.prose(rng, 150) + " " + t for i, t in enumerate(texts)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    for shard_words in (1 << 20, 60):
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard_words)
        rows = decontaminate.matches(tables.frame(spark, docs), bench).collect()
        found = sorted(((r.doc_id, r.item_id) for r in rows if r.contaminated), key=str)
        assert found == [(0, 1), (1, 1), (2, None), (3, None), (4, 2)]


def test_verdict_decides_between_passages(spark):
    rng = random.Random(16)
    words = [f"w{k}" for k in range(40)]  # 30 of the question, 10 of the answer
    clean = words[:20] + ["x"] + words[32:]  # 18 of 28 and 6 of 8 grams: the greater lesser overlap, yet no match
    bad = words[:25] + ["x"] + words[34:]  # 23 of 28 and 4 of 8
    filler = tables.prose(rng, 400).split()
    docs = {1: clean + filler + bad, 2: bad + filler + clean, 3: clean + filler, 4: filler + bad}
    frame = tables.frame(spark, {i: " ".join(w) for i, w in docs.items()})
    rows = decontaminate.matches(frame, spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).collect()
    assert {r.doc_id: r.contaminated for r in rows} == {1: True, 2: True, 3: False, 4: True}


def test_retrieval_is_exact(spark):
    """Pruning never loses an entry: scores of all passages and entries by a plain loop."""
    import numpy as np
    import pyarrow as pa

    from evalspark.llm import arrays as A

    rng = random.Random(12)
    texts = [tables.prose(rng, rng.randint(8, 40)) for _ in range(60)]
    rows = []
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        w = A.words(A.LOWER[raw], np.array([0, len(raw)]), A.PUNCTUATION)[0]
        rows += [(i, 0, len(w), int(x.view(np.int64)), int(n)) for x, n in zip(*np.unique(w, return_counts=True))]
    df = Counter(r[3] for r in rows)
    table = pa.table({
        "item": [r[0] for r in rows], "entry": pa.array([0] * len(rows), pa.int32()), "length": [r[2] for r in rows],
        "term": [r[3] for r in rows], "tf": [r[4] for r in rows], "df": [df[r[3]] for r in rows],
        "words": pa.array([None] * len(rows), pa.list_(pa.int64())), "answer_at": [0] * len(rows),
    })
    index = decontaminate.build(table, 60, 20.0)
    for threshold in (0.15, 0.3, 0.6):
        words = " ".join(tables.prose(rng, 20) + " " + rng.choice(texts) for _ in range(12))
        raw = np.frombuffer(words.encode(), np.uint8)
        w = A.words(raw, np.array([0, len(raw)]), A.PUNCTUATION)[0]
        place = np.flatnonzero(np.isin(w, index.terms))
        term = np.searchsorted(index.terms, w[place])
        passages = np.array([(s, min(s + decontaminate.PASSAGE, len(w))) for s in range(0, len(w), 64)])
        p, e, s = decontaminate.retrieve(index, term, place, passages, threshold)
        got = {(int(a), int(b)): c for a, b, c in zip(p, e, s)}
        want = {}
        of_cell = np.searchsorted(index.cells, np.arange(len(index.cell_block)), "right") - 1
        of_post = of_cell[np.searchsorted(index.postings, np.arange(len(index.entry)), "right") - 1]
        for k, (a, b) in enumerate(passages):
            inside = np.isin(of_post, np.unique(term[(place >= a) & (place < b)]))
            total = np.bincount(index.entry[inside], index.impact[inside], 60)
            want |= {(k, int(i)): total[i] for i in np.flatnonzero(total >= threshold)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


# --- archives -------------------------------------------------------------------------------------------


def test_archive_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    monkeypatch.setattr(warc, "SHARD_LINES", 7)
    html = {i: f"<p>{i % 9}\r\n\r\n" * (i % 4) for i in range(60)} | {60: None, 61: "", 62: "é" * 9, None: "<p>null id"}
    urls = {i: f"http://h{(i or 0) % 3}.example.com/{(i or 0) % 5}?a={(i or 0) % 2}" for i in html}
    urls |= {3: None, 4: "not a url", 5: "http://[bad", 6: "http://x y/\n", 7: "HTTPS://User@B.a.org:443/#f", 8: ""}
    df = spark.createDataFrame([(i, urls[i], h) for i, h in html.items()], "page_id long, url string, html string")
    first = {}
    for i in sorted(html, key=lambda i: -1 if i is None else i):
        first.setdefault(html[i] or "", i)
    want = {}
    for i, h in html.items():
        raw = (h or "").encode()
        again = first[h or ""] != i
        want[i] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None)
    rows = warc.round_trip(df).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == want
    assert len(rows) == len(html)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty).collect() == []


def test_archive_files_payloads_and_small_payloads(spark):
    folder = shared_dir(spark, "warc-test")
    df = spark.createDataFrame([(1, "http://a/", "xx"), (2, "http://a/", "xx"), (3, "http://b/", "long enough"), (4, "http://c/", "long enough")], "page_id long, url string, html string")
    archive = warc.write_archive(df, folder, least_revisit=5)
    rows = {r.id: r for r in warc.read_records(warc.lookup(archive, df), folder).collect()}
    assert {i: r.record_type for i, r in rows.items()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert bytes(rows[3].payload) == b"long enough" and rows[4].payload is None and rows[4].payload_bytes == 11
    store, base = pyarrow.fs.FileSystem.from_uri(folder)
    files = [f.path for f in store.get_file_info(pyarrow.fs.FileSelector(base)) if f.path.endswith(".warc.gz")]
    whole = b"".join(gzip.decompress(store.open_input_file(f).read()) for f in files)
    assert whole.count(b"WARC/1.1\r\n") == 4
    other = spark.createDataFrame([(9, "http://a/")], "page_id long, url string")
    assert warc.lookup(archive, other).collect() == []


def test_url_keys():
    assert warc.url_key("http://b.a.org:80/x?y#z") == "org,a,b)/x?y"
    assert warc.url_key("https://A.org:8443") == "org,a:8443)/"
    assert warc.url_key(None) == ")"
