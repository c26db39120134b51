"""Labelled pages for the extraction model: parts of pages, content or not.

Each page is put together from the parts below; text of a content part is
content.  The parts stand for the layouts that the model has to tell apart.
"""

from __future__ import annotations

import random

#: (html around the paragraphs); ``{}`` takes paragraphs, titles and lists.
CONTENT = (
    "<article>{}</article>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main-content">{}</div>',
    '<div class="post"><div class="post-body">{}</div></div>', '<main>{}</main>', '<div class="entry-content">{}</div>',
    '<section class="story">{}</section>', '<div class="wrapper"><div class="article-text">{}</div></div>', '<div role="main">{}</div>',
    "<div>{}</div>", "<div><div>{}</div></div>", '<td class="text">{}</td>', "<body-text>{}</body-text>", '<article class="post">{}</article>',
)
#: Text blocks inside the content.
BLOCKS = (
    "<p>{long}</p>", "<p>{long}</p>", "<p>{long}</p>", "<h1>{short}</h1>", "<h2>{short}</h2>", "<p>{short}</p>", "<p><b>{long}<br>", "<blockquote>{long}</blockquote>",
    "<ul><li>{short}</li><li>{long}</li></ul>", '<p>{long} <a href="/x">{word}</a> {long}</p>', "<pre>{short}</pre>", "<div>{long}</div>", "<p><b>{short}</b> {long}</p>",
    "<table><tr><td>{short}</td><td>{short}</td></tr></table>", "<figure><figcaption>{short}</figcaption></figure>", "<section><h3>{short}</h3><p>{long}</p></section>",
)
#: Parts that are not content.
OTHER = (
    "<nav><ul>{links}</ul></nav>", "<nav>{anchors}</nav>", '<ul class="menu">{links}</ul>', '<div id="navigation"><ul>{links}</ul></div>',
    "<header><h1>{short}</h1><p>{short}</p></header>", '<div class="header">{short}</div>', '<div id="site-header"><a href="/">{short}</a></div>', "<header>{anchors}</header>",
    "<footer>&copy; {long}</footer>", "<footer><p>{short}</p></footer>", '<div class="footer"><p>{long}</p></div>', '<div id="page-footer">{anchors}</div>',
    "<aside><h3>{short}</h3><p>{long}</p></aside>", '<div class="sidebar"><h3>{short}</h3><ul>{links}</ul></div>', '<div id="right-column" class="widget"><p>{long}</p></div>', "<aside>{long}</aside>",
    '<div class="ad">{short}</div>', '<div class="ad">{long}</div>', '<div class="ads banner"><a href="/b">{short}</a></div>', '<div class="sponsored"><p>{long}</p></div>', '<div id="advert-top">{long}</div>', '<section class="promo"><p>{long}</p></section>',
    '<div class="cookie-notice"><p>{long}</p></div>', '<div id="consent-banner">{short}</div>', '<div class="alert notice">{long}</div>', '<div role="alert"><p>{short}</p></div>', '<div class="popup modal"><p>{long}</p></div>',
    '<form action="/s"><label>{short}</label><input name="q"><p>{long}</p></form>', '<form class="newsletter"><p>{long}</p></form>', '<div class="subscribe">{short}</div>', '<div class="login">{short}</div>',
    '<div id="comments"><h3>{short}</h3><div class="comment"><p>{long}</p></div><div class="comment"><p>{long}</p></div></div>',
    '<section class="comments"><article class="comment"><p>{long}</p></article><ol><li>{long}</li></ol></section>', '<ol class="comment-list"><li><p>{long}</p></li></ol>', '<div class="responses"><div class="reply"><p>{long}</p></div></div>',
    '<div class="related"><h4>{short}</h4><ul>{links}</ul></div>', '<div class="share social">{anchors}</div>', '<div class="breadcrumb">{anchors}</div>', '<div class="tags">{anchors}</div>', '<div class="pagination">{anchors}</div>', "<ul>{links}</ul>",
    '<div role="navigation">{anchors}</div>', '<div role="banner"><p>{long}</p></div>', '<div role="contentinfo"><p>{long}</p></div>', '<div role="complementary"><p>{long}</p></div>', '<div class="recommended"><p>{long}</p></div>',
)
_LETTERS = "etaoinshrdlu"


def _text(rng: random.Random, low: int, high: int) -> str:
    return " ".join("".join(rng.choices(_LETTERS, k=rng.randint(2, 9))) for _ in range(rng.randint(low, high)))


def _filled(rng: random.Random, part: str) -> str:
    while "{long}" in part:
        part = part.replace("{long}", _text(rng, 8, 90), 1)
    while "{short}" in part:
        part = part.replace("{short}", _text(rng, 1, 8), 1)
    while "{word}" in part:
        part = part.replace("{word}", _text(rng, 1, 2), 1)
    anchors = [f'<a href="/{i}">{_text(rng, 1, 3)}</a>' for i in range(rng.randint(2, 9))]
    return part.replace("{links}", "".join(f"<li>{a}</li>" for a in anchors)).replace("{anchors}", " ".join(anchors))


#: Around the content of plain pages: no element, elements without names, and names that say nothing.
PLAIN_CONTENT = (
    "{}", "{}", "<main>{}</main>", "<div>{}</div>", "<div><div>{}</div></div>", "<section>{}</section>", '<div class="{name}">{}</div>', '<div id="{name}">{}</div>',
    '<div class="{name}"><div class="{name}">{}</div></div>', "<center>{}</center>", "<table><tr><td>{}</td></tr></table>", '<div class="{name}">{}</div>',
)
#: Few blocks, often just one; bare text is one too.
PLAIN_BLOCKS = ("<p>{long}</p>", "<p>{long}</p>", "<p>{long} {long} {long}</p>", "{long}", "{long} {long} {long}", "<pre>{long}</pre>", "<div>{long}</div>", "<p>{short} {long}</p>")
#: What stands beside it, told by its element or by its links alone.
PLAIN_OTHER = ("<nav>{anchors}</nav>", "<nav><ul>{links}</ul></nav>", "<footer>{short}</footer>", "<footer><p>{long}</p></footer>", "<header>{anchors}</header>", "<div>{anchors}</div>", "<ul>{links}</ul>", "<aside>{long}</aside>", '<div class="{name}">{anchors}</div>')


def _plain_page(rng: random.Random) -> str:
    """A page of one or few blocks that class words do not tell apart."""

    def named(part: str) -> str:
        while "{name}" in part:
            part = part.replace("{name}", _text(rng, 1, 1), 1)
        return part

    count = rng.choice((1, 1, 1, 1, 2, 3, 5))
    blocks = [_filled(rng, rng.choice(PLAIN_BLOCKS)) for _ in range(count)]
    content = named(rng.choice(PLAIN_CONTENT)).replace("{}", "<keep-text>" + "".join(blocks) + "</keep-text>")
    before = [_filled(rng, named(rng.choice(PLAIN_OTHER))) for _ in range(rng.choice((0, 0, 1, 2)))]
    after = [_filled(rng, named(rng.choice(PLAIN_OTHER))) for _ in range(rng.choice((0, 0, 1, 2)))]
    return f"<html><head><title>{_text(rng, 2, 6)}</title></head><body>{''.join([*before, content, *after])}</body></html>"


def labelled_pages(n: int = 600, seed: int = 7) -> list[str]:
    """Pages whose content is between ``<keep-text>`` and ``</keep-text>``."""
    rng, pages = random.Random(seed), []
    for _ in range(n // 3):
        pages.append(_plain_page(rng))
    for _ in range(n - n // 3):
        blocks = [_filled(rng, rng.choice(BLOCKS)) for _ in range(rng.randint(1, 9))]
        for _ in range(rng.choice((0, 0, 0, 1, 2))):
            blocks.insert(rng.randint(0, len(blocks)), "</keep-text>" + _filled(rng, rng.choice(OTHER[11:])) + "<keep-text>")
        content = rng.choice(CONTENT).replace("{}", "<keep-text>" + "".join(blocks) + "</keep-text>")
        before = [_filled(rng, rng.choice(OTHER)) for _ in range(rng.randint(0, 4))]
        after = [_filled(rng, rng.choice(OTHER)) for _ in range(rng.randint(0, 4))]
        body = "".join([*before, content, *after])
        if rng.random() < 0.3:
            body = f'<div class="{rng.choice(("page", "container", "wrap", "row"))}">{body}</div>'
        pages.append(f"<html><head><title>{_text(rng, 2, 6)}</title></head><body>{body}</body></html>")
    return pages
