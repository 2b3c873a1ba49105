"""A small labelled table for the block classifier: pages as (markup, label) pieces.

Label: 1 main text, 0 not, None if the markup has no block of its own.
MARKED pages tell their parts by tags and names; PLAIN ones are of containers
without names, where words, links, headings and bare text must do.
"""

import random
import re

WORDS = (
    "the old harbour lies quiet in the morning while boats return with the night's catch and the first buyers walk down from the square "
    "to look at what the sea has given them this time of the year when storms are rare and the water is still warm from summer"
).split()


def prose(n: int) -> str:
    return " ".join(WORDS[i % len(WORDS)] for i in range(n))


def links(n: int) -> list[tuple[str, int]]:
    return [(f'<li><a href="/{i}">{prose(1 + i % 5)}</a></li>', 0) for i in range(n)]


def paragraphs(*sizes: int) -> list[tuple[str, int]]:
    return [(f"<p>{prose(n)}</p>", 1) for n in sizes]


def boxed(opening: str, inner: list[tuple[str, int | None]], closing: str) -> list[tuple[str, int | None]]:
    return [(opening, None), *inner, (closing, None)]


NAV = boxed("<nav><ul>", links(6), "</ul></nav>")
FOOTER = boxed("<footer>", [("<p>&copy; example &middot; all rights reserved</p>", 0)], "</footer>")
LONG_FOOTER = boxed("<footer>", [(prose(25), 0)], "</footer>")
AD = boxed('<div class="ad">', [(prose(8), 0)], "</div>")
LONG_AD = boxed('<div class="advert sponsored">', [(f"<p>{prose(40)}</p>", 0)], "</div>")
HEADER = boxed("<header>", [("<h1>The Daily Page</h1>", 0), ("<p>News from the coast</p>", 0)], "</header>")
SIDEBAR = boxed('<aside class="sidebar"><ul>', links(4), "</ul></aside>")
SIDE_TEXT = boxed('<div id="sidebar">', [(f"<p>{prose(30)}</p>", 0), ("<h3>Related</h3>", 0)], "</div>")
NOTICE = boxed('<div class="cookie-notice">', [(f"<p>{prose(22)}</p>", 0)], "</div>")
FORM = boxed("<form>", [("<p>Your name and your address</p>", 0), ("<p>Send</p>", 0)], "</form>")
COMMENTS = boxed('<div class="comments">', [("<h3>Comments</h3>", 0), (f"<p>{prose(28)}</p>", 0), (f"<p>{prose(6)}</p>", 0)], "</div>")
SECTION_COMMENTS = boxed('<section id="comments">', [(f"<div>{prose(35)}</div>", 0)], "</section>")
SHORT = [("<p>Nothing more.</p>", 1), ("<p>Yes.</p>", 1)]


def article(*inner: list[tuple[str, int | None]]) -> list[tuple[str, int | None]]:
    return boxed("<article>", [("<h1>A quiet morning</h1>", 1), *[x for part in inner for x in part]], "</article>")


def page(*parts: list[tuple[str, int | None]]) -> list[tuple[str, int | None]]:
    return [("<!DOCTYPE html><html><head><title>t</title></head><body>", None), *[x for part in parts for x in part], ("</body></html>", None)]


LIST = boxed("<ul>", [("<li>bread from the corner shop</li>", 1), ("<li>two lemons</li>", 1)], "</ul>")
LINKED = [(f'<p>{prose(18)} <a href="/x">as we wrote</a> {prose(9)}</p>', 1), ('<p><a href="/y">See the map</a></p>', 1)]

MARKED = [
    page(NAV, AD, article(paragraphs(60, 35), SHORT), FOOTER),
    page(NAV, AD, article(paragraphs(3, 120, 14)), LONG_FOOTER),
    page(HEADER, NAV, article(paragraphs(40, 40), LIST, LINKED), SIDEBAR, COMMENTS, FOOTER),
    page(NOTICE, HEADER, NAV, article(paragraphs(25, 70), LONG_AD, paragraphs(30)), SIDE_TEXT, FOOTER),
    page(NAV, article(SHORT), FORM, COMMENTS, LONG_FOOTER),
    page(HEADER, article(paragraphs(12, 50), FORM, SECTION_COMMENTS), FOOTER),
    page(NOTICE, boxed('<div class="post-content">', paragraphs(50, 8, 4), "</div>"), SIDEBAR, FOOTER),
    page(NAV, boxed("<main>", [("<h2>Ferries</h2>", 1), *paragraphs(30, 22)], "</main>"), COMMENTS, LONG_FOOTER),
    page(boxed("<div>", links(5), "</div>"), boxed("<div>", paragraphs(45, 60, 33), "</div>"), boxed("<div>", links(4), "</div>")),
    page(boxed("<div>", [*links(8), ("<p>Home page</p>", 0)], "</div>"), boxed("<div>", paragraphs(80, 41), "</div>"), boxed("<div>", [("<p>Contact us</p>", 0)], "</div>"), boxed("<div>", links(3), "</div>")),
    page(boxed("<div>", [(f'<a href="/a">{prose(24)}</a> <a href="/b">{prose(20)}</a>', 0)], "</div>"), boxed("<div>", [*paragraphs(52), (f"<p>{prose(5)}</p>", 1), *paragraphs(47)], "</div>"), boxed("<div>", [(f'<a href="/c">{prose(41)}</a>', 0)], "</div>")),
    page(boxed("<div>", [*paragraphs(66), (f"<p>{prose(7)}</p>", 1), *paragraphs(40), (f"<p>{prose(12)}</p>", 1), *paragraphs(38)], "</div>"), boxed("<div>", [("<p>Contact</p>", 0), ("<p>Terms of use</p>", 0), *links(3)], "</div>")),
    *(page(NAV, article(paragraphs(60, 30 + n)), boxed("<footer>", [(prose(n), 0)], "</footer>")) for n in (6, 11, 16, 33)),
    *(page(AD, article(paragraphs(n, 51), AD, paragraphs(44)), COMMENTS, FORM, LONG_FOOTER) for n in (9, 42)),
    page(article(paragraphs(70, 64)), NOTICE, SIDE_TEXT, NAV, LONG_AD, FOOTER),
    page(boxed("<div>", paragraphs(58, 49), "</div>"), LONG_FOOTER, NOTICE),
    page(article(paragraphs(20), SECTION_COMMENTS, SIDE_TEXT, NOTICE), NOTICE, FORM),
    page(boxed("<article><header>", [("<h1>Tides</h1>", 0), ("<p>By a sailor</p>", 0)], "</header>"), paragraphs(55, 17), boxed("<footer>", [("<p>Filed under sea</p>", 0)], "</footer></article>"), SIDEBAR),
]


BARE_AD = [(f"<div>{prose(8)}</div>", 0)]
BARE_FOOTER = [("<div>&copy; example &middot; all rights reserved</div>", 0)]


def bare(n: int) -> list[tuple[str, int]]:
    return [(f"<div>{prose(n)}</div>", 0)]


def story(*sizes: int) -> list[tuple[str, int | None]]:
    return boxed("<div>", [("<h1>A quiet morning at the old harbour</h1>", 1), *paragraphs(*sizes)], "</div>")


MENU = boxed("<div><ul>", links(6), "</ul></div>")
PLAIN = [
    *(page(MENU, bare(n), story(60, m, 35), bare(n + 3)) for n, m in ((5, 1), (9, 14), (14, 3), (24, 70), (41, 9))),
    *(page(MENU, story(m, 30), bare(n)) for n, m in ((4, 80), (12, 2), (30, 25))),
    *(page(MENU, bare(6 + i), story(25, *sizes, 40), bare(9 + i)) for i, sizes in enumerate(((1, 2, 1), (2, 1, 60, 1), (3, 19, 2), (1, 48, 2, 2, 7, 1), (5, 4, 3, 2, 1)))),
    page(MENU, BARE_AD, story(1), BARE_FOOTER),
    page(MENU, BARE_AD, story(12), BARE_FOOTER),
    page(MENU, story(90, 4, 2, 1), BARE_FOOTER),
    page(MENU, BARE_AD, story(7, 1, 44), boxed("<div>", links(3), "</div>"), BARE_FOOTER),
    page(BARE_AD, boxed("<div>", [("<h2>Ferries</h2>", 1), *paragraphs(33, 12), *LIST, *paragraphs(18)], "</div>"), MENU, BARE_FOOTER),
    page(MENU, boxed("<div>", [("<h1>Tides</h1>", 1), *paragraphs(26), *LINKED, *paragraphs(5)], "</div>"), BARE_FOOTER),
    page(boxed("<div>", [*paragraphs(45, 60), ("<h2>More boats</h2>", 1), *paragraphs(3, 33)], "</div>"), boxed("<div>", links(4), "</div>")),
    *([("<html><body>", None), *[(f"<div>{prose(n)}</div>", 1) for n in sizes], ("</body></html>", None)] for sizes in ((50, 70, 12), (31, 2, 44), (9,), (3, 4))),
    page(MENU, boxed("<div>", [(f"<div>{prose(n)}</div>", 1) for n in (48, 55, 30)], "</div>")),
]


def unnamed(pieces: list[tuple[str, int | None]]) -> list[tuple[str, int | None]]:
    """The same page with its classes and ids gone."""
    return [(re.sub(r' (?:class|id)="[^"]*"', "", markup), label) for markup, label in pieces]


#: Lengths of paragraphs and of other blocks; they must overlap, so that no single length tells anything.
RANDOM = random.Random(3)


def sizes() -> list[int]:
    return [RANDOM.choice((1, 1, 2, 2, 3, 4, 6, 9, 14, 20, 35, 60, 110, 180)) for _ in range(RANDOM.randrange(1, 14))]


def few() -> int:
    return RANDOM.randrange(3, 45)


VARIED = [
    p
    for _ in range(24)
    for p in (
        page(NAV, boxed('<div class="ad">', [(prose(few()), 0)], "</div>"), article(paragraphs(*sizes())), boxed("<footer>", [(prose(few()), 0)], "</footer>")),
        page(HEADER, article(paragraphs(*sizes()), LIST, paragraphs(*sizes())), boxed('<div class="comments">', [(f"<p>{prose(n)}</p>", 0) for n in sizes()], "</div>"), boxed("<aside>", [(f"<p>{prose(n)}</p>", 0) for n in sizes()], "</aside>")),
        page(NAV, article(paragraphs(*sizes()))),
        page(MENU, story(*sizes())),
        page(MENU, bare(few()), story(*sizes()), bare(few())),
        page(MENU, story(*sizes()), boxed("<div>", links(3), "</div>"), bare(few())),
        [("<html><body>", None), *[(f"<div>{prose(n)}</div>", 1) for n in sizes()], ("</body></html>", None)],
    )
]


# menus, footers and adverts made of links in other ways than lists


def linked(n: int, style: str) -> list[tuple[str, int]]:
    """n links as blocks of one tag, or side by side in one block, with or without space between."""
    each = [f'<a href="/{i}">{prose(1 + (i * 3 + n) % 5)}</a>' for i in range(n)]
    if style in ("p", "div", "li", "span"):
        return [(f"<{style}>{a}</{style}>", 0) for a in each] if style != "span" else [("".join(f"<span>{a}</span> " for a in each), 0)]
    return [({"bare": " ", "tight": "", "bars": " | "}[style].join(each), 0)]


STYLES = ("li", "p", "div", "span", "bare", "tight", "bars")


def any_style() -> str:
    return RANDOM.choice(STYLES)


def around(tag: str, inner: list[tuple[str, int | None]], name: str = "") -> list[tuple[str, int | None]]:
    return boxed(f'<{tag} class="{name}">' if name else f"<{tag}>", inner, f"</{tag}>")


def own_links() -> list[tuple[str, int]]:
    """A link of the text itself, with a paragraph before it."""
    return [*paragraphs(few()), (f'<p><a href="/y">{prose(RANDOM.randrange(1, 7))}</a></p>', 1), *paragraphs(few())] if RANDOM.random() < 0.5 else []


def listed() -> list[tuple[str, int | None]]:
    return LIST if RANDOM.random() < 0.3 else []


def bare_story() -> list[tuple[str, int | None]]:
    """Text of a container, without paragraphs."""
    return boxed("<div>", [(prose(RANDOM.choice((12, 20, 30, 45, 90, 160))), 1)], "</div>")


def titled(*inner: list[tuple[str, int | None]], tag: str = "article") -> list[tuple[str, int | None]]:
    """An article whose heading has any length, or is missing."""
    heading = [(f"<h1>{prose(RANDOM.randrange(1, 26))}</h1>", 1)] if RANDOM.random() < 0.7 else []
    return boxed(f"<{tag}>", [*heading, *[x for part in inner for x in part]], f"</{tag}>")


def long_sizes() -> list[int]:
    return [RANDOM.choice((3, 40, 90, 200, 400)) for _ in range(RANDOM.randrange(1, 5))]


LINKS = [
    p
    for _ in range(40)
    for p in (
        page(around("nav", linked(RANDOM.randrange(1, 9), any_style())), titled(paragraphs(*sizes(), *long_sizes())), around("footer", [(prose(few()), 0)])),
        page(around("nav", linked(RANDOM.randrange(1, 9), any_style())), around("div", [(prose(few()), 0)], "ad"), titled(paragraphs(*long_sizes()), own_links(), listed(), paragraphs(*sizes())), around("footer", linked(3, any_style()))),
        page(around("div", linked(RANDOM.randrange(2, 9), any_style())), titled(paragraphs(*long_sizes(), *sizes()), tag="div"), around("div", linked(RANDOM.randrange(1, 5), any_style()))),
        page(around("div", linked(RANDOM.randrange(2, 9), any_style())), around("div", linked(1, any_style()), "ad"), titled(paragraphs(*long_sizes())), around("div", linked(1, any_style()), "promo"), around("div", linked(3, any_style()), "legal")),
        page(around("nav", linked(RANDOM.randrange(1, 9), any_style())), around("div", linked(1, any_style()), "ad"), article(paragraphs(*sizes()), own_links(), listed()), around("footer", linked(RANDOM.randrange(1, 5), any_style()))),
        page(around("div", linked(RANDOM.randrange(2, 9), any_style()), "breadcrumb"), article(paragraphs(*sizes()), around("div", linked(2, any_style()), "ad"), paragraphs(*sizes()), own_links()), around("aside", linked(4, any_style())), around("footer", [("<p>&copy; example</p>", 0), *linked(2, any_style())])),
        page(around("div", linked(RANDOM.randrange(2, 9), any_style())), story(few(), *sizes(), few()), around("div", linked(RANDOM.randrange(2, 6), any_style()))),
        page(around("div", linked(RANDOM.randrange(3, 9), any_style())), bare(RANDOM.randrange(3, 25)), boxed("<div>", [("<h1>A quiet morning</h1>", 1), *paragraphs(few(), *sizes()), *own_links()], "</div>"), bare(RANDOM.randrange(3, 25))),
        page(around("div", linked(RANDOM.randrange(3, 9), any_style())), bare_story()),
        page(around("nav", linked(RANDOM.randrange(3, 9), any_style())), bare_story(), around("footer", [(prose(few()), 0)])),
        page(boxed(RANDOM.choice(('<div class="layout sidebar-left">', '<div class="main-content form">', "<form>", '<div class="page no-header">')), [*around("nav", linked(5, any_style())), *article(paragraphs(few(), *sizes())), *around("footer", [(prose(few()), 0)])], RANDOM.choice(("</div>", "</form>")))),
    )
]
PAGES = [*MARKED, *PLAIN, *VARIED, *LINKS, *(unnamed(p) for p in MARKED[:2] + MARKED[4:5])]
