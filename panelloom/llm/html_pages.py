"""Labelled pages to train the extraction model on: layouts drawn by rule, each block known as content or not."""

from __future__ import annotations

import random

#: Tags and class words that page layouts use.
NOISE_BLOCKS = [
    ("nav", ""), ("header", ""), ("footer", ""), ("aside", ""), ("form", ""), ("div", "ad"), ("div", "ads"), ("div", "advert"),
    ("div", "advertisement"), ("div", "sponsored"), ("div", "promo"), ("div", "banner"), ("div", "nav"), ("div", "navbar"), ("div", "menu"),
    ("ul", "menu"), ("ul", "nav"), ("div", "breadcrumb"), ("ol", "breadcrumbs"), ("div", "header"), ("div", "masthead"), ("div", "footer"),
    ("div", "sidebar"), ("div", "side"), ("div", "widget"), ("div", "related"), ("div", "recommended"), ("div", "share"), ("div", "social"),
    ("div", "comments"), ("section", "comments"), ("div", "comment"), ("ol", "comment-list"), ("div", "replies"), ("div", "cookie"),
    ("div", "cookie-notice"), ("div", "cookie-banner"), ("div", "consent"), ("div", "notice"), ("div", "popup"), ("div", "modal"),
    ("div", "newsletter"), ("div", "subscribe"), ("div", "login"), ("div", "search"), ("div", "pagination"), ("div", "copyright"),
    ("section", "related"), ("div", "tags"), ("p", "notice"), ("div", "legal"), ("div", "disclaimer"), ("aside", "sidebar"), ("div", "toolbar"),
]
CONTENT_ROOTS = [
    ("article", ""), ("main", ""), ("div", "content"), ("div", "main"), ("div", "post"), ("div", "article"), ("section", "content"),
    ("div", "entry-content"), ("div", "article-body"), ("div", "post-content"), ("div", "main-content"), ("article", "post"), ("div", "text"),
    ("div", "body"), ("div", "story"), ("section", ""), ("div", ""), ("section", "article"),
]
CONTENT_BLOCKS = ["p"] * 12 + ["h1", "h2", "h3", "h4", "li", "blockquote", "pre", "td", "div", "figcaption", "dd"]


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))


def _noise(rng: random.Random, depth: int = 0) -> str:
    tag, name = rng.choice(NOISE_BLOCKS)
    attribute = f' {rng.choice(["class", "class", "id"])}="{name}"' if name else ""
    kind = rng.random()
    heading = rng.choice(["h1", "h2", "h3", "h3", "h4"])
    title = f"<{heading}>{_words(rng, rng.randint(1, 5))}</{heading}>" if rng.random() < 0.35 else ""
    if kind < 0.45:
        inner = "<ul>" + "".join(f'<li><a href="/{i}">{_words(rng, rng.randint(1, 3))}</a></li>' for i in range(rng.randint(2, 8))) + "</ul>"
    elif kind < 0.6:
        inner = "".join(f'<a href="/{i}">{_words(rng, rng.randint(1, 4))}</a> ' for i in range(rng.randint(1, 6)))
    elif kind < 0.85:
        inner = "".join(f"<p>{_words(rng, rng.randint(3, 40))}.</p>" for _ in range(rng.randint(1, 4)))
    elif kind < 0.9 and depth < 1:
        inner = f"<div>{_noise(rng, depth + 1)}</div>"
    else:
        inner = _words(rng, rng.randint(2, 25)) + "."
    return f"<{tag}{attribute}>{title}{inner}</{tag}>"


def _content(rng: random.Random) -> str:
    tag, name = rng.choice(CONTENT_ROOTS)
    attribute = f' {rng.choice(["class", "class", "id"])}="{name}"' if name else ""
    blocks = [f"<h1>{_words(rng, rng.randint(2, 8))}</h1>"] if rng.random() < 0.8 else []
    for _ in range(rng.randint(1, 12)):
        block = rng.choice(CONTENT_BLOCKS)
        text = _words(rng, rng.randint(1, 90) if block in ("p", "div", "blockquote") else rng.randint(1, 20)) + "."
        if rng.random() < 0.2:
            text = f'{text} <{(inline := rng.choice(["b", "em", "a", "strong", "span"]))}>{_words(rng, 2)}</{inline}>'
        if block == "li":
            text = "</li><li>".join([text] + [_words(rng, rng.randint(1, 12)) for _ in range(rng.randint(0, 4))])
        wrap = {"li": ("<ul><li>", "</li></ul>"), "td": ("<table><tr><td>", "</td></tr></table>"), "dd": ("<dl><dd>", "</dd></dl>")}
        before, after = wrap.get(block, (f"<{block}>", f"</{block}>"))
        blocks.append(before + text + after)
        if rng.random() < 0.1:
            blocks.append(f"\x02{_noise(rng)}\x03")
    return f"<{tag}{attribute}>" + "".join(blocks) + f"</{tag}>"


def labelled_pages(n: int = 600, seed: int = 7) -> list[str]:
    """Pages in which the control characters 1 and 4 enclose content, and 2 and 3 what is not content within it."""
    rng, pages = random.Random(seed), []
    for _ in range(n):
        parts = [_noise(rng) for _ in range(rng.randint(1, 4))] + ["\x01" + _content(rng) + "\x04"] + [_noise(rng) for _ in range(rng.randint(0, 4))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            parts = ["<div" + rng.choice(["", ' class="wrapper"', ' class="container"', ' id="page"']) + ">", *parts, "</div>"]
        pages.append("<html><head><title>t</title></head><body>" + "".join(parts) + "</body></html>")
    return pages
