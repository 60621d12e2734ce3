"""Main text of pages of many makes, none of which the labelled blocks were taken from."""

import random

import pytest

from cadenza.llm import html_extract as H

_RNG = random.Random(31)
POOL = "stone river light garden window morning letter answer bridge market winter paper simple early voice table north field cloud seven".split()


def _text(n):
    return " ".join(_RNG.choice(POOL) for _ in range(n)).capitalize() + "."


A, B, C, D = _text(48), _text(48), _text(70), _text(33)
MENU = "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in POOL[:7]) + "</ul>"
SHORT = ["First line", "Second line here", "A third one", "The fourth", "And five"]

# Pages with their main text
PAGES = [
    ("short lines only", "<html><body>" + "".join(f"<p>{x}</p>" for x in SHORT) + "</body></html>", SHORT),
    ("a name that only suggests furniture", f'<body><div class="social-text"><p>{A}</p><p>Short line.</p><p>{B}</p></div></body>', [A, "Short line.", B]),
    ("links in an article", f'<article><p>{A}</p><ul><li><a href="a">one</a></li><li><a href="b">two two</a></li><li><a href="c">three</a></li></ul><p>{B}</p></article>',
     [A, "one", "two two", "three", B]),
    ("a recipe", f"<body><nav>{MENU}</nav><h1>Onion soup</h1><p>{D}</p><h2>Ingredients</h2><ul><li>two onions</li><li>salt</li><li>one leek</li></ul>"
     f"<h2>Method</h2><p>{C}</p><footer>Imprint</footer></body>", ["Onion soup", D, "Ingredients", "two onions", "salt", "one leek", "Method", C]),
    ("a table in main", f"<main><h1>Results</h1><p>{D}</p><table><tr><th>Place</th><th>Name</th></tr><tr><td>1</td><td>Ann</td></tr></table></main><aside>{A}</aside>",
     ["Results", D, "Place", "Name", "1", "Ann"]),
    ("no marks, menu of links", f"<div><div>{MENU}</div><div><h1>Title of it</h1><p>{A}</p><p>{C}</p></div><div>{MENU}</div></div>", ["Title of it", A, C]),
    ("sidebar and comments", f'<div id="content"><h1>News</h1><p>{C}</p></div><div id="sidebar"><p>{A}</p></div><section class="comments"><p>{B}</p></section>', ["News", C]),
    ("article in a form", f'<form><div class="post"><h2>Head</h2><p>{A}</p><p>{D}</p></div><input name="q"></form>', ["Head", A, D]),
    ("header within the article", f'<header><a href="/">Site</a></header><article><header><h1>Title</h1></header><p>{A}</p></article><footer>{D}</footer>', ["Title", A]),
    ("cookie notice by name", f'<div class="cookie-notice"><p>We use cookies on this site to make it work.</p><button>Fine</button></div><main><p>{B}</p></main>', [B]),
    ("scripts and hidden parts", f'<main><script>var a = "<p>x</p>";</script><p>{A}</p><div style="display:none">{B}</div><p hidden>{D}</p></main>', [A]),
    ("links only", f"<body><nav>{MENU}</nav></body>", []),
    ("references and white space", "<main><p>a &amp;  b\n&lt;c&gt; &eacute;&#33;</p></main>", ["a & b <c> é!"]),
]


@pytest.fixture(scope="module")
def tree(spark):
    return H.fit_tree(spark)


@pytest.mark.parametrize("name, page, want", PAGES, ids=[p[0] for p in PAGES])
def test_main_text(tree, name, page, want):
    assert H.main_text(page, tree)[0].split("\n") == (want or [""])


def test_score_on_composed_pages(tree):
    """200 pages put together at random from parts; words kept against words of the article."""
    rng = random.Random(77)
    right = kept = wanted = 0
    for _ in range(200):
        body = [f"<h1>{_text(rng.randrange(3, 9))[:-1]}</h1>"] + [f"<p>{_text(rng.randrange(20, 120))}</p>" for _ in range(rng.randrange(2, 7))]
        if rng.random() < 0.4:
            body.insert(2, "<ul>" + "".join(f"<li>{_text(rng.randrange(2, 9))}</li>" for _ in range(rng.randrange(3, 6))) + "</ul>")
        article = "".join(body)
        opening, closing = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ('<div class="entry-content">', "</div>"),
                                       ('<div id="main">', "</div>"), ("<div>", "</div>"), ("<td>", "</td>")])
        around = [f"<nav>{MENU}</nav>", f"<div>{MENU}</div>", f'<div class="ad">{_text(12)}</div>', f'<aside><p>{_text(40)}</p></aside>',
                  f'<div class="sidebar">{MENU}<p>{_text(15)}</p></div>', f"<footer>&copy; {_text(8)}</footer>", f'<div class="newsletter"><p>{_text(14)}</p></div>']
        before, after = rng.sample(around, 2), rng.sample(around, 2)
        got = H.main_text("<html><body>" + "".join(before) + opening + article + closing + "".join(after) + "</body></html>", tree)[0]
        mine = H.main_text(f"<article>{article}</article>", tree)[0]
        g, m = got.split("\n"), mine.split("\n")
        right += sum(len(x.split()) for x in g if x in m)
        kept += sum(len(x.split()) for x in g)
        wanted += sum(len(x.split()) for x in m)
    assert right / kept > 0.97 and right / wanted > 0.97
