"""Page text: wrappers, comments, quotes and hostile pages; the density selection against a recursive version."""

import math
import random
import time

import pytest

from tallywise.llm import html

WORDS = "one two three four five six seven eight nine ten eleven twelve words of text that stand here. "
TEXT = f"<p>{WORDS * 3}</p><p>{WORDS * 4}</p>"
PLAIN = " ".join((WORDS * 7).split())


@pytest.mark.parametrize(
    "page",
    [
        "<form id=aspnetForm><nav>a b</nav><div>{}</div><label>Your name</label><input></form>",
        "<form id=aspnetForm><article>{}</article></form>",
        "<div role=dialog><article>{}</article></div>",
        "<div style='visibility: hidden'><main>{}</main></div>",
        "<div><fieldset>{}</fieldset></div><form>Sign up <label>mail</label></form>",
        "<article>{}</article><dialog><article>Cookies?</article></dialog><div hidden>more</div>",
        "<article>{}<div class=comments><p>A reader's words, " + WORDS * 4 + "</p></div></article>",
        "<article>{}<ol class='comment-list'><li><article class=comment>A reader</article></ol></article>",
        "<main>{}<section id=comments><article>A reader</article></section></main>",
    ],
)
def test_wrappers_stay_and_comments_go(page):
    assert html.main_text(f"<html><body>{page.format(TEXT)}</body></html>") == PLAIN


def test_parts_of_sentences_and_sections_stay():
    page = f"<body><article><p title=it's>Take <label>this</label> and <math><mi>x</mi></math> too.</p>{TEXT}<section id=discussion><p>{WORDS}</p></section></article>"
    assert html.main_text(page) == f"Take this and x too. {PLAIN} {WORDS.strip()}"


@pytest.mark.parametrize(
    "page",
    [
        "<span>" * 16000 + "</b>" * 16000,
        "<div class=ad>" * 8000 + "x",
        "<span>" * 16000 + "<div>x</div>" * 16000,
        "<ul><li>" + "<div>" * 16000 + "<li>x</li>" * 16000,
        "<h1>a" * 16000,
        "<div>" * 8000 + "<header>x</header>" * 8000,
        "<p a='" * 20000,
        "<p " + "=" * 50000,
    ],
)
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 3


def test_a_very_long_page():
    page = f"<body><nav>menu</nav><article>{TEXT * 20000}</article></body>"
    assert html.main_text(page) == " ".join([PLAIN] * 20000)


def tree(draw, depth):
    parts = []
    for _ in range(draw.randint(1, 4)):
        kind = draw.choice(["text", "p", "div", "a"] if depth else ["text", "p"])
        text = " ".join(draw.choice("some words in a page".split()) for _ in range(draw.randint(1, 25)))
        parts.append({"text": text, "p": f"<p>{text}</p>"}.get(kind) or f"<{kind}>{tree(draw, depth - 1)}</{kind}>")
    return "".join(parts)


def by_definition(node):
    """Characters, tags, characters and tags in links of an element, by walking it anew."""
    c = t = lc = lt = 0
    for x in node.children:
        if isinstance(x, str):
            c += sum(map(len, x.split()))
        else:
            a = by_definition(x)
            c, t, lc, lt = c + a[0], t + a[1] + 1, lc + a[2], lt + a[3] + (x.tag == "a")
    return (c, t, c, t) if node.tag == "a" else (c, t, lc, lt)


def test_selection_by_definition():
    draw = random.Random(3)
    for _ in range(60):
        root, nodes = html.parse(f"<body>{tree(draw, 4)}</body>")
        body = nodes[1]
        html.measure(nodes, body)
        whole = by_definition(body)
        density = {}
        for n in nodes:
            c, t, lc, lt = by_definition(n)
            t = max(t, 1)
            base = math.log(c / max(c - lc, 1) * lc + whole[2] / max(whole[0], 1) * c + math.e) if c else 1.0
            scaled = math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / math.log(max(base, math.e)) if c else 0.0
            density[id(n)] = c / t * scaled
        sums = {id(n): sum(density[id(x)] for x in n.children if not isinstance(x, str)) for n in nodes}
        assert all(math.isclose(n.density, density[id(n)], abs_tol=1e-9) for n in nodes)
        inside = [n for n in nodes if n.chars and n.tag != "#root"]
        best = max(inside, key=lambda n: density[id(n)])
        way, at = [best], best
        while at is not body:
            at = at.parent
            way.append(at)
        threshold = min(density[id(n)] for n in way)
        top = max((sums[id(n)] for n in inside if density[id(n)] >= threshold - 1e-9))
        chosen = html.select(inside, body)
        around = chosen  # the choice may have widened from the subtree with the largest sum
        found = [n for n in inside if math.isclose(sums[id(n)], top, abs_tol=1e-6)]

        def holds(above, n):
            while n is not None and n is not above:
                n = n.parent
            return n is above

        assert any(holds(around, n) for n in found) or top == 0
