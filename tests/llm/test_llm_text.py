"""Scoring, toxicity, extraction, chat, BPE and quality against brute force and on odd input."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import bpe, chat, lm, pagetext, quality, toxicity
from tessella.llm.common import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tokens string, score string"


def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, clashing column names."""
    long = " ".join(f"w{i % 977} the\n" for i in range(40_000))
    rows = [(1, "The cat sat on the mat.\nThe cat sat", "en"), (2, None, None), (3, "", "fr"), (1, "The cat sat on the mat.\nThe cat sat", "en"), (None, "null id here", "en"), (5, long, "en"), (6, " \t\n ", "en"), (7, "a\x1cb   É <|endoftext|> x", "xx")]
    return spark.createDataFrame([(i, t, g, "s", 1, "clash", "clash") for i, t, g in rows], DOCS), rows


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_lm_base_score_and_normalisation(spark):
    docs, rows = odd_docs(spark)
    got = sorted((tuple(r) for r in lm.score(docs).collect()), key=str)
    texts = [(i, [*WORD.findall(lower(t)), "\n"]) for i, t, _ in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in texts]
    c = collections.Counter(w for (_, ws), h in zip(texts, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for (i, ws), h in zip(texts, held, strict=True)), key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[2])), sorted(want, key=lambda r: (str(r[0]), r[2])), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] < 0 and math.isfinite(g[6])


def test_lm_learns_and_is_normalised():
    r = np.random.default_rng(0)
    n = np.zeros((lm.CONTEXTS * lm.CONTEXTS, lm.CLASSES))
    for near in range(10):  # the next class follows from the last one
        n[np.arange(10) * lm.CONTEXTS + near, (near + 3) % 10] = r.integers(50, 100, 10)
    seen = np.flatnonzero(n.sum(1))
    table = lm.LogBilinear().fit(seen // lm.CONTEXTS, seen % lm.CONTEXTS, n[seen]).log_probs()
    assert np.allclose((10.0**table).sum(1), 1, atol=1e-4)
    assert all(table[far * lm.CONTEXTS + near].argmax() == (near + 3) % 10 for far in range(10) for near in range(10))


def test_lm_scores_equal_brute_force_and_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(lm, "OWN_COUNT", 3)
    r = random.Random(11)
    ends = [f"{x}{z}{y}" for x in "bcdfg" for z in "aeiou" for y in ("an", "est", "ing", "ed.", "le")]
    follow = {w: r.sample(ends, 16) for w in "abcdefgh"}
    texts = {i: " ".join(x for _ in range(r.randrange(0, 30)) for w in [r.choice("abcdefgh")] for x in (w, r.choice(follow[w]))) for i in range(300)} | {900: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tokens = {i: [*WORD.findall(lower(t)), "\n"] for i, t in texts.items()}
    counts = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    blocks = lm.code_blocks(docs)
    known = lm.word_counts(blocks)
    top = ["\n", *[w for w, _ in sorted(((w, c) for w, c in counts.items() if w != "\n"), key=lambda x: (-x[1], x[0]))[: lm.TOP - 1]]]
    kind = lambda w: top.index(w) if w in top else lm.tail_class(w.encode())
    n_class, once = np.zeros(lm.CLASSES), np.zeros(lm.CLASSES)
    for w, c in counts.items():
        n_class[kind(w)] += c
        once[kind(w)] += c == 1
    model, words = lm.learn_words(known, top, n_class, blocks)
    places = {w: i for i, w in enumerate(words.names.to_pylist())}
    assert set(places) == {w for w, c in counts.items() if c >= 3 and w not in top}
    table = 10.0 ** model.log_probs().astype(float)
    unseen = np.where(n_class == 0, 1.0, (once + 0.5) / (n_class + 1))
    unseen[: len(top)] = 0

    def weight(w, near):
        said = words.theta[places[w], 0] + words.theta[places[w], 1:] @ words.contexts[near] if w in places else 0.0
        return counts[w] / n_class[kind(w)] * math.exp(said)

    def probability(w, far, near):
        k = kind(w)
        inside = unseen[k] if not counts[w] else (1 - unseen[k]) * weight(w, near) / sum(weight(x, near) for x in counts if kind(x) == k)
        return table[far * lm.CONTEXTS + near, k] * inside

    for far, near in [(lm.START, lm.START), (0, 1), (5, kind("zzz")), (lm.START, 3)]:
        assert sum(probability(w, far, near) for w in counts) + (table[far * lm.CONTEXTS + near] * unseen).sum() == pytest.approx(1, abs=1e-4)
    got = {x["doc_id"]: x["score"] for x in lm.score(docs).collect()}
    for i in [900, *list(texts)[:40]]:
        kinds = [lm.START, lm.START, *map(kind, tokens[i])]
        want = sum(math.log10(probability(w, kinds[k], kinds[k + 1])) for k, w in enumerate(tokens[i]))
        assert got[i] == pytest.approx(want, abs=1e-3 * len(tokens[i]))


def test_lm_words_learn_their_contexts():
    contexts = np.eye(4)[:, :3]
    n = np.array([[900.0, 100, 0, 0], [10, 10, 10, 10]])
    theta = lm.fit_words(n, np.full((2, 4), 2000.0), np.array([0.125, 0.005]), contexts)
    said = np.exp(theta[:, :1] + theta[:, 1:] @ contexts.T)
    assert said[0] == pytest.approx([900 / 250, 100 / 250, 0.02, 0.02], rel=0.2, abs=0.05) and said[1] == pytest.approx(1, abs=0.05)


def test_lm_empty_and_untrained(spark):
    assert lm.score(spark.createDataFrame([], DOCS)).count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = lm.score(spark.createDataFrame([(held, "some words")], "doc_id long, text string")).first()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (True, 3, 0, 0, 0.0)


def test_lm_beats_the_base_on_held_out_texts(spark):
    p = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").toPandas()
    assert p["score"].sum() > p["base_score"].sum()


def test_toxicity_chain_finds_held_out_toxic_texts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    p = toxicity.score(docs, chain).join(labels.where("doc_id % 2 = 1").select("doc_id", labels.toxic.alias("label")), "doc_id").toPandas()
    found = p["is_toxic"] & (p["label"] == 1)
    assert found.sum() >= 0.6 * (p["label"] == 1).sum() and found.sum() >= 0.85 * p["is_toxic"].sum()  # some labels are wrong
    texts = [r["text"] for r in docs.collect()]
    assert toxicity.keep_clean(docs, chain).count() == (toxicity._probabilities(chain, texts)[:, -1] <= toxicity.CUT).sum()


def test_toxicity_chain_feeds_earlier_probabilities():
    r = np.random.default_rng(1)
    x = (r.random((400, 3)) < 0.4).astype(float)
    first = x[:, 0]
    y = np.column_stack([first, first, first * x[:, 1]])
    chain = toxicity.fit_chain(x, y, np.arange(400) % 5, ["a", "b", "c"])
    assert [len(w[2]) for w in chain.weights] == [0, 1, 2]
    assert ((chain.predict(x) > 0.5) == y.astype(bool)).mean() > 0.98


def test_toxicity_scores_equal_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, chain).collect()}
    for d in docs.collect():
        counts = collections.Counter(w.strip(toxicity.MARKS) for w in (d["text"] or "").lower().split())
        on = []
        for f in chain.words:
            if f.startswith("^"):
                begin = f.lstrip("^")
                on.append(sum(w[: len(begin)] == begin and len(w) >= len(begin) for w in counts) >= len(f) - len(begin) or f in counts)
            else:
                on.append(f in counts or f.startswith("2") and counts[f[1:]] > 1)
        earlier = []
        for bias, words, chained in chain.weights:
            z = bias + sum(w for w, x in zip(words, on, strict=True) if x) + sum(c * p for c, p in zip(chained, earlier, strict=True))
            earlier.append(1 / (1 + math.exp(-max(-40, min(40, z)))))
        assert [got[d["doc_id"]][c] for c in toxicity.CATEGORIES] == pytest.approx(earlier, abs=1e-9)
        assert got[d["doc_id"]]["is_toxic"] == (earlier[-1] > toxicity.CUT)


def test_toxicity_finds_two_kinds():
    r = np.random.default_rng(3)
    x = np.zeros((200, 10))
    x[:120, :5], x[120:, 5:] = r.random((120, 5)) < 0.8, r.random((80, 5)) < 0.8
    own = toxicity.kinds(x)
    assert max((own[:120] == own[0]).mean(), 0) > 0.95 and (own[120:] != own[0]).mean() > 0.95
    assert not toxicity.kinds(np.ones((5, 3))).any() and len(toxicity.kinds(np.zeros((0, 3)))) == 0


def test_toxicity_odd_input(spark):
    docs, rows = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (7, None), (99, 1)], "doc_id long, toxic int")
    chain = toxicity.train(docs, labels)
    assert toxicity.score(docs, chain).count() == len(rows)
    assert toxicity.keep_clean(docs, chain).columns == docs.columns
    none = toxicity.train(docs, labels.limit(0))
    assert all(r["first_kind"] == r["second_kind"] == r["toxic"] == 0 and not r["is_toxic"] for r in toxicity.score(docs, none).collect())
    for kind in ("bigint", "smallint", "tinyint", "boolean"):
        toxicity.train(docs, labels.selectExpr("doc_id", f"cast(toxic as {kind}) as toxic"))
    many = spark.createDataFrame([(1, f"word{i} again") for i in range(3000)] + [(5, "clean")], "doc_id long, text string")
    toxicity.train(many, labels, sample=1)
    assert toxicity.score(docs.limit(0), chain).count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a<p>b <b>c</b>  d", "a\n\nb c d"),
        ("<ul><li>x<li>y<ol start=3><li>p<li>q</ol></ul>z", "- x\n- y\n  3. p\n  4. q\n\nz"),
        ("<table><tr><td>aa<td>b<tr><td>c<td>dd</table>", "aa  b\nc   dd"),
        ("<table><tr><th colspan=2>head<tr><td>c<td>dd</table>", "head\nc  dd"),
        ("<head><title>no</title><style>p{}</style></head>yes<script>var t='</p>';</script>!", "yes!"),
        ("a<span hidden>b</span><div style='display: none'>c</div><i style='visibility:hidden'>d</i>e", "ae"),
        ("<pre> x\n   y</pre>", " x\n   y"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<div>a</div>  <div>b</div>", "a\nb"),
        ("x &amp; &lt;y&gt; <!-- gone --> <!doctype html>z", "x & <y> z"),
        ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n    d\nu\n    e"),
        ("<nav><ul><li>a</ul></nav><div>b</div>", "- a\n\nb"),
        ("<p>open <b>never closed", "open never closed"),
        ("</p>", ""),
        ("1 < 2 and 3", "1 < 2 and 3"),
        (None, ""),
        ("", ""),
    ],
)
def test_html_rendering(html, text):
    assert pagetext.render(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table><tr><form><td>a<td>b</form><tr><td>c<td>d</table>", "a  b\nc  d"),
        ("<table><tbody><form><tr><td>a<td>b</form></table>", "a  b"),
        ("<table><tr>text<td>a<tr>more<td>b</table>", "text\nmore\na\nb"),
        ("<table><tbody>text<tr><td>a</table>", "text\na"),
        ("<p title='it's'>Hello, it isn't so</p>", "Hello, it isn't so"),
        ("<p a=b\"c>x \"y\" z</p>", 'x "y" z'),
        ("<p title='a > b' hidden>x</p>y", "y"),
        ("<p title = \"a > b\">x</p>", "x"),
        ("<p title=\"open>x y</p>", "x y"),
    ],
)
def test_html_malformed_tables_and_quotes(html, text):
    assert pagetext.render(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
        ("<table><tr><td colspan=99999999999>a<td>b<tr><td>ccc<td>d</table>", "a       b\nccc  d"),
        ("<table><tr><td>" + "w" * 150 + "<td>b<tr><td>c<td>d</table>", "w" * 150 + "  b\nc" + " " * 101 + "d"),
        ("<dialog>a</dialog><dialog open>b</dialog>", "b"),
        ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
        ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c</div>", "b"),
        ("<textarea>\n a &lt;b&gt;\n  c</textarea>", " a <b>\n  c"),
        ("<select><option>a<option selected>b<option>c</select>", "b"),
        ("<select><option>a<option>b</select>", "a"),
        ("<select multiple><option>a<option>b</select>", "a\nb"),
        ("<input value=v><input type=hidden value=h><input type=checkbox value=c>", "v"),
        ("<style>.no, #gone { display: none } b.x{visibility:hidden}</style>a<i class='q no'>b</i><i id=gone>c</i><b>d</b><b class=x>e</b>", "ad"),
        ("<style>@media print{p{display:none}} /* p{display:none} */ i{display:none} .on{display:inline}</style><p>a<i>b</i><i class=on>c</i>", "ac"),
        ("<style>i{display:none!important}</style><i style='display:inline'>a</i>b", "b"),
        ("<i style='display:inline' hidden>a</i>", "a"),
        ("<p><a href=\"x>link</a> then <a href=\"y\">more</a>", "link then more"),
        ("<div><table><tr><td>a</div>b<td>c</table>d</div>", "ab  c\n\nd"),
        ("a<!-->b<!-- x --!>c</ x>d<?pi?>e<![CDATA[no]]>f", "abcdef"),
        ("<blockquote>" * 60 + "x", "    " * 40 + "x"),
    ],
)
def test_html_visibility_and_spans(html, text):
    assert pagetext.render(html) == text


@pytest.mark.parametrize(
    "html",
    [
        "<a " * 1_600_000 + "'",
        "<a b='" * 800_000 + '"',
        "<a b='\"" * 700_000,
        "<div>" * 500_000 + "<div hidden>SECRET</div>" + "</span>" * 300_000,
        "<table><tr><td>" * 300_000 + "x",
        "<form>" * 400_000 + "<table><form>" * 200_000 + "<td>x",
        "<style>" + "@a" * 2_000_000,
        "<style>" + "a{" * 2_000_000,
        "<style>" + "x" * 5_000_000,
        "<" * 5_000_000,
        "<!" * 2_500_000,
        "<p" + " " * 5_000_000,
        "<ul><li>" * 600_000 + "x",
        "<td colspan=1000 rowspan=9999>x" * 2_000,
    ],
    ids=range(14),
)
def test_html_takes_time_in_proportion(html):
    start = time.perf_counter()
    assert "SECRET" not in pagetext.render(html)
    assert time.perf_counter() - start < 30


def test_html_hides_at_any_depth():
    for depth in (300, 5000):
        assert pagetext.render("<div>" * depth + "<div hidden>SECRET</div>shown" + "</div>" * depth + "after") == "shown\nafter"


def test_html_loses_no_visible_word():
    r = random.Random(4)
    marks = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "<form>", "</form>", "<tbody>", "<thead>", "<colgroup>", "<col>", "<caption>", "<div>", "</div>", "<b>", "</b>", "<p>", "<p title='it's'>", '<i a="b"c">', "<ul>", "<li>", "<pre>", "</pre>"]
    for _ in range(3000):
        n = r.randint(5, 40)
        page = "".join(f"{r.choice(marks)} w{i} isn't " if r.random() < 0.6 else r.choice(marks) for i in range(n))
        want = re.findall(r"w\d+", re.sub(r"<[^>]*>", " ", page))
        assert sorted(re.findall(r"w\d+", pagetext.render(page))) == sorted(want), page


def test_html_deep_and_random_input(spark):
    assert pagetext.render("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert pagetext.render("<table><tr><td>" * 1000 + "x") == "x"
    r = random.Random(3)
    for _ in range(300):
        pagetext.render("".join(r.choice(["<p>", "</p>", "<td>", "<table>", "</table>", "<li>", "<ul>", "a ", "<", ">", "&amp", "<tr>", "</div>", "<!--", "-->", "<script>", "</script>", "<b x='", "'>"]) for _ in range(40)))
    rows = spark.createDataFrame([(1, None, "u"), (None, "<p>x", "u"), (1, None, "u")], "page_id long, html string, text string")
    assert sorted(r["text"] for r in pagetext.extract(rows).collect()) == ["", "", "x"]
    assert pagetext.extract(rows.limit(0)).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_chat(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss))
    return out


def test_chat_round_trip_and_sharing(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "[ROLE x] y [/ROLE]", "", " ", "<<SYS>>\n<</SYS>>", "a\nb", "<", "</", "\\[INST]", "é😀"]
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool\n] \\", None, "[INST]"]), r.choice([*odd, None])) for c in range(60) for t in range(r.randrange(1, 6))]
    rows += [(100 + c, t, role, text) for c in range(30) for t, (role, text) in enumerate([("user", "same start"), ("assistant", "same answer")])]
    rows += [(200, None, "user", "x"), (200, 0, "user", "x"), (200, 0, "user", "x"), (None, 0, "user", "hm")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, nodes string")
    trees = chat.trees(df)
    got = {x["conv_id"]: (x["n_turns"], x["turns_sha256"], x["loss_chars"], x["loss_sha256"]) for x in chat.read_back(trees).collect()}
    assert got == brute_chat(rows)
    whole = [t.asDict(True) for t in trees.collect()]
    for t in whole:
        for node in t["nodes"]:
            seen = sum(x["end"] - x["start"] for x in node["attends"])
            assert node["position"] == seen - (node["end"] - node["start"])  # positions count what is attended to before
    assert sum(t["text"].count("same answer") for t in whole) <= len(whole)
    assert chat.read_back(chat.trees(df.limit(0))).count() == 0


@pytest.mark.parametrize(("chars", "leaves"), [(60, 4096), (1_000_000, 3), (1_000_000, 4096)])
def test_chat_rows_are_cut_without_repeated_turns(spark, chars, leaves):
    r = random.Random(8)
    rows = []
    for conv in range(150):  # most go on from one start, many are equal
        said = ["start", "answer"][: r.randrange(1, 3)] + [r.choice("abc") * 9 for _ in range(r.randrange(0, 4))] if conv % 5 else [f"own {conv % 10}"]
        rows += [(conv, t, "assistant" if t % 2 else "user", x) for t, x in enumerate(said)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    grown = chat.cut(chat.trees(df, most_chars=chars, most_leaves=leaves))
    by = collections.defaultdict(list)
    for conv, _, role, text in sorted(rows):
        by[conv].append((role, text))
    paths = {tuple(turns[: k + 1]) for turns in by.values() for k in range(len(turns))}
    emitted = grown.collect()
    assert len(emitted) > (10 if chars < 100 or leaves < 10 else 0)
    assert sum(len(x["nodes"]) for x in emitted) == len(paths)
    assert sum(len(x["text"]) for x in emitted) == sum(len(chat.format_turn(*p[-1])[0]) for p in paths)
    for x in emitted:
        for node in x["nodes"]:
            assert node["parent"] < 0 or node["position"] == x["nodes"][node["parent"]]["position"] + x["nodes"][node["parent"]]["end"] - x["nodes"][node["parent"]]["start"]
            assert node["n_above"] <= len(x["above"]) and (node["position"] > 0) == (node["parent"] >= 0 or node["n_above"] > 0)
    assert {y["conv_id"]: tuple(y)[1:5] for y in chat.read_back(grown).collect()} == brute_chat(rows)


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path(bpe.VOCABULARY)
    library, own = Tokenizer.from_file(path), bpe.codec(path)
    library.no_truncation()
    library.no_padding()
    r = random.Random(1)
    alphabets = ["aaaabcdeht erlsin  \n\n\t'1203.,!?éü😀日本語\x00 ́xz", "abcdefghijklmnopqrstuvwxyz", "ab ", "'sdtremvl "]
    for k in range(4000):
        a = r.choice(alphabets)
        text = "".join(r.choice(a) for _ in range(r.randrange(0, 40)))
        text = text[: r.randrange(1, 6)] * r.randrange(1, 12) if k % 3 == 0 else text
        text += "<|endoftext|>" if k % 40 == 0 else ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert own.decode(own.encode("<|endoftext|>", ordinary=True)) == "<|endoftext|>"
    assert len(own.encode("<|endoftext|>", ordinary=True)) > 1


def test_bpe_automaton_of_a_small_vocabulary():
    labels = [b"a", b"b", b"aa", b"ab", b"aab"]
    automaton = bpe.Automaton(labels, [(0, 0), (0, 1), (0, 3)], [2, 3, 4])
    assert automaton.word(b"aaa") == (2, 0)
    assert automaton.word(b"aab") == (2, 1)  # the first merge comes first, so the last never happens
    assert b"aab" not in automaton.token and not automaton.accepts(0, 0) and automaton.accepts(2, 0)


def test_bpe_tables(spark):
    docs, rows = odd_docs(spark)
    own = bpe.codec(tokenizer_path(bpe.VOCABULARY))
    ids = bpe.encode(docs)
    got = bpe.decode(ids).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted((str(i), t or "") for i, t, _ in rows)
    made = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs).collect()}
    assert made == {(i, len(x), sha(",".join(map(str, x))), sha(t or "")) for i, t, _ in rows for x in [own.encode(t or "")]}
    assert bpe.digests(docs.limit(0)).count() == 0


def brute_quality(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside), failed


def test_quality_counts(spark):
    docs, rows = odd_docs(spark)
    r = random.Random(2)
    more = [(100 + i, "".join(r.choice(["a ", "b ", "c\n", "\n", "a b c ", "#x ", "\x0b", "é ", " ", "\x1d"]) for _ in range(r.randrange(0, 120))), "en") for i in range(60)]
    rows = rows + more
    docs = docs.unionByName(spark.createDataFrame([(i, t, g, "s", 1, "c", "c") for i, t, g in more], DOCS))
    got = sorted((str(x["doc_id"]), x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) for x in quality.rules(docs).collect())
    assert got == sorted((str(i), *brute_quality(t)) for i, t, _ in rows)
    assert all(not x["kept"] for x in quality.rules(docs).where("base_failed").collect())
    assert quality.rules(docs.limit(0)).count() == 0
    assert quality.keep_good(docs).count() == quality.rules(docs).where("kept").count()


def test_quality_keeps_clean_and_rejects_junk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    p = quality.rules(docs).join(labels, "doc_id").where("not base_failed").toPandas()
    assert p[p["quality"] == 1]["kept"].mean() > 0.97
    assert p[p["quality"] == 0]["kept"].mean() < 0.35


def test_quality_fertility_measures():
    own = quality.pieces(tokenizer_path(quality.VOCABULARY), tokenizer_path(quality.SECOND))
    texts = pa.array(["𓀀𓀁", None, "the cat and the cat", "日本語テキスト", " \t"])
    columns = dict(zip(quality.NAMES[1:], quality.measure(texts, None, own), strict=True))
    assert columns["byte_share"][0] > 0.5 and columns["chars_per_token"][0] < 1 and columns["byte_share"][2] == 0
    assert columns["n_words"].tolist() == [1, 0, 5, 1, 0] and columns["token_entropy"][1] == 0
    ids = [i for w in "the cat and the cat".split() for i in own.library.encode(w)]
    shares = [n / len(ids) for n in collections.Counter(ids).values()]
    assert columns["token_entropy"][2] == pytest.approx(-sum(p * math.log2(p) for p in shares))
    assert quality.scripts(pa.array(["abc жж", "жжж a", "日本", "12 !", ""])) == ["Latin", "Cyrillic", "Han", None, None]
