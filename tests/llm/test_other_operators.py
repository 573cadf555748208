"""Top-k search, main text, preference pairs."""

import math
import random

import numpy as np
import pytest

from panelloom.llm import bitsliced, chat, html_extract
from panelloom.llm.html_pages import labelled_pages


def brute_top(rows, k, scale=64, every=20):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, []).append([math.floor(scale * x) for x in v])
    out = {}
    for query, own in good.items():
        if query % every == 0 and len(own) == 1:
            scored = [(-sum(a * b for a, b in zip(own[0], v, strict=True)), i) for i, vs in good.items() if i != query for v in vs if len(v) == len(own[0])]
            out[query] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("blocks", [(1 << 16, 256), (16, 2)])
def test_top_k(spark, blocks):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 6)]) for i in range(90)]
    rows += [(100 + i, rows[5][1]) for i in range(25)]  # ties
    rows += [(140, None), (160, []), (180, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (200, [0.1, float("nan"), 0.0, 0.0, 0.0, 0.0]), (220, [float("inf")] * 6), (240, [0.0] * 6), (None, [0.1] * 6)]
    df = spark.createDataFrame([(i, v, 1, 9) for i, v in rows], "vec_id long, embedding array<float>, label int, score int")
    got = {}
    for r in bitsliced.top_k(df, 20, block_rows=blocks[0], block_queries=blocks[1]).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute_top(rows, 20)
    big = spark.createDataFrame([(20, [1e8, -3.0]), (1, [1.0, 1e9]), (2, [-1e8, 0.5]), (3, [1e30, 1.0]), (4, [2.0, -1e30])], "vec_id long, embedding array<double>")
    v = {i: [max(-(2**63), min(2**63 - 1, math.floor(64 * x))) for x in e] for i, e in big.collect()}
    exact = sorted((-sum(a * b for a, b in zip(v[20], v[i], strict=True)), i) for i in v if i != 20)
    assert [(r[2], r[3]) for r in bitsliced.top_k(big).orderBy("rank").collect()] == [(i, max(-(2**63), min(2**63 - 1, -s))) for s, i in exact]
    assert bitsliced.top_k(df.limit(0)).count() == 0
    assert bitsliced.top_k(df.filter("vec_id in (20, 21)")).count() == 1


PAGES = {
    "plain": ("<html><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two &eacute;&#33;<p>Three <b>bold</b><br>four</article><footer>&copy; us</footer></body></html>", "A & B\n\nOne two é!\n\nThree bold four"),
    "noise inside": ("<body><div id=sidebar><p>Read also this one</p></div><main><h2>Title here</h2><p>Some text of the story that goes on.</p><div class='ad'>Buy this now</div><p>And its end.</p></main></body>", "Title here\n\nSome text of the story that goes on.\n\nAnd its end."),
    "script": ("<article><p>a story is told here</p><script>var x='</p><p>no</p>';</script><style>p{}</style><p>and it ends here</p></article>", "a story is told here\n\nand it ends here"),
    "comments": ("<article><p>The story itself is here.</p></article><section class=comments><p>I like this story very much.</p></section>", "The story itself is here."),
    "unclosed": ("<article><p>first words of it<p>second words of it<footer>&copy; someone", "first words of it\n\nsecond words of it"),
    "form": ("<header><h1>Site</h1></header><article><h1>Story</h1><p>Long enough text for a story.</p></article><form><p>Subscribe now</p><input></form>", "Story\n\nLong enough text for a story."),
    "no end of head": ("<html><head><title>t</title><body><article><p>The story is told in here.</p></article>", "The story is told in here."),
    "open option": ("<datalist><option>a<option>b</datalist><article><p>The story is told in here.</p></article>", "The story is told in here."),
    "comment left open": ("<article><p>The story is told in here.</p><!-- and <p>no more", "The story is told in here."),
    "tag left open": ("<article><p>The story is told in here.</p><a href='", "The story is told in here."),
}


@pytest.mark.parametrize("part", ["<blockquote>", "<a ", "<!--", "</div>", "<svg></p>", "<li><p>", "<?", "<!x", "</", "<p><td>"])
def test_time_grows_with_the_page(part):
    import time

    model = html_extract.trained()

    def seconds(n):
        began = time.process_time()
        html_extract.main_text(part * n, model)
        return time.process_time() - began

    assert seconds(64_000) < 20 * max(seconds(8_000), 0.02)


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    html, text = PAGES[name]
    assert html_extract.main_text(html) == text


def test_odd_pages(spark):
    odd = ["", None, "<", "</p></div>", "<p", "&", "<script>", "<article><p>" + "word " * 60_000 + "</article>", "<div>" * 3000, "<!-- x", "<![CDATA[x]]>"]
    rows = [(i, "u", h, "old", 5) for i, h in enumerate(odd)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id int, url string, html string, text string, n_chars int")).orderBy("page_id").collect()
    assert len(got) == len(odd) and got[0]["text"] == got[1]["text"] == "" and got[7]["n_chars"] == 5 * 60_000 - 1
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_held_out_accuracy():
    model, right, total = html_extract.trained(), 0, 0
    for page in labelled_pages(80, seed=99):
        tree, nodes = html_extract.parse(page, marked=True)
        belief = model.marginals(nodes)
        for node, _ in tree.blocks:
            right += (belief[id(node)] > 0) == bool(node.truth)
            total += 1
    assert right / total > 0.93


def test_messages_give_exact_marginals():
    """Against the sum over all labellings of a small tree."""
    import itertools

    model = html_extract.trained()
    _, nodes = html_extract.parse("<body><div class=ad><p>x y</p></div><article><h1>t</h1><ul><li>one two</li></ul></article></body>")
    belief = model.marginals(nodes)
    at = {id(n): i for i, n in enumerate(nodes)}
    weights = np.zeros((len(nodes), 2))
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        w = 0.0
        for i, n in enumerate(nodes):
            w += labels[i] * (-6.0 if n.parent is None else model.evidence(n))
            if n.parent is not None:
                w += model.edge[labels[at[id(n.parent)]]][labels[i]]
        for i, y in enumerate(labels):
            weights[i, y] += math.exp(w)
    for n, (no, yes) in zip(nodes, weights, strict=True):
        assert belief[id(n)] == pytest.approx(math.log(yes / no), abs=1e-6)


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "pair_id long, chosen boolean, turn long, role string, text string, other string")


def test_preferences(spark):
    rows = [
        (1, True, 0, "user", "hi"), (1, False, 0, "user", "hi"), (1, True, 1, "assistant", "good"), (1, False, 1, "assistant", "bad"), (1, False, 2, "user", "why"),
        (2, True, 0, "user", "same"), (2, False, 0, "user", "same"),
        (3, True, 0, "user", None), (3, True, 1, None, "x"), (3, False, 0, "user", ""), (3, False, 0, "user", ""),
        (4, True, None, "user", "only chosen"), (None, True, 0, "user", "no pair"),
    ]
    got = {r["pair_id"]: r for r in chat.format_preferences(turns(spark, rows)).collect()}
    assert set(got) == {1, 2, 3, 4}
    one = got[1]
    assert one["n_prompt_turns"] == 1 and one["prompt"] == "<|user|>\nhi<|end|>\n"
    assert one["chosen"] == "<|assistant|>\ngood<|end|>\n" and one["rejected"] == "<|assistant|>\nbad<|end|>\n<|user|>\nwhy<|end|>\n"
    (span,) = one["chosen_loss"]
    assert (one["prompt"] + one["chosen"])[span["from"] : span["to"]] == "good<|end|>\n"
    (span,) = one["rejected_loss"]
    assert (one["prompt"] + one["rejected"])[span["from"] : span["to"]] == "bad<|end|>\n"
    assert got[2]["chosen"] == got[2]["rejected"] == "" and got[2]["n_prompt_turns"] == 1
    assert got[3]["n_prompt_turns"] == 1 and got[3]["rejected"] == ""
    assert got[4]["n_prompt_turns"] == 0 and got[4]["rejected"] == ""
    assert chat.format_preferences(turns(spark, []) if False else turns(spark, rows).limit(0)).count() == 0


def test_swapped_answers(spark):
    rng = random.Random(4)
    rows = []
    for c in range(30):
        n = rng.randint(1, 6)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}" if c % 5 else "common") for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in chat.format_preferences(chat.swapped_answers(df)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((role, text))
    answers = {c: [x for r, x in own if r == "assistant"] for c, own in by.items()}
    answered = sorted(c for c in by if answers[c])
    partner = dict(zip(answered, [*answered[1:], answered[0]], strict=True))
    want = set(answered)
    assert set(got) == want
    for c in want:
        own = by[c][: max(i for i, (r, _) in enumerate(by[c]) if r == "assistant") + 1]
        other = [*own[:-1], ("assistant", answers[partner[c]][-1])]
        shared = len(own) if own == other else len(own) - 1
        assert got[c]["n_prompt_turns"] == shared
        assert got[c]["rejected"] == "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in other[shared:])


def test_partners_of_far_numbers(spark):
    numbers = [5, 6, 70_000, 1 << 20, (1 << 33) + 1, (1 << 50) + 2, -7]
    got = {r["n"]: r["partner"] for r in chat.partnered(spark.createDataFrame([(n,) for n in numbers], "n long"), "n").collect()}
    assert set(got) == set(numbers) and all(p in got and p != n for n, p in got.items())
    assert got[5] == 6 and got[6] == 5 and got[70_000] == 1 << 20
    one = spark.createDataFrame([(3,)], "n long")
    assert [r["partner"] for r in chat.partnered(one, "n").collect()] == [None] and chat.partnered(one.limit(0), "n").count() == 0
