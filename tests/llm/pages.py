"""Made-up pages with known main texts: layouts without article or main, and with misleading names."""

from __future__ import annotations

import random

WORDS = "time year people way day thing world life hand part child eye place work week case point government company number group problem fact river stone garden window letter music market".split()


def sentence(rng: random.Random, low: int, high: int) -> str:
    return " ".join(rng.choices(WORDS, k=rng.randint(low, high))).capitalize() + "."


def page(seed: int) -> tuple[str, list[str]]:
    """A page and the blocks of its main text."""
    rng = random.Random(seed)
    text = lambda low, high: sentence(rng, low, high)
    links = lambda n: "".join(f"<li><a href='/{i}'>{text(1, 3)}</a></li>" for i in range(n))
    blocks, body = [], []

    def put(tag: str, words: str) -> None:
        blocks.append(words)
        body.append(f"<{tag}>{words}</{tag.split()[0]}>")

    put("h1", text(3, 8))
    for _ in range(rng.randint(3, 9)):
        kind = rng.random()
        if kind < 0.7:
            put("p", " ".join(text(8, 20) for _ in range(rng.randint(2, 6))))
        elif kind < 0.85:
            put("p", text(2, 5))
        else:
            items = [text(2, 6) for _ in range(rng.randint(2, 5))]
            blocks.extend(items)
            body.append("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>")
    name = rng.choice(["", " class='story'", " class='has-banner'", " id='share-story'", " class='entry-content wide-menu'", " class='col-8'"])
    tag = rng.choice(["div", "div", "section", "td", "main", "article"])
    if rng.random() < 0.5:  # an advert or notice inside
        at = rng.randint(1, len(body))
        body.insert(at, rng.choice(["<div class='ad'>{}</div>", "<aside>{}</aside>", "<div class='newsletter-signup'><p>{}</p></div>"]).format(text(4, 12)))
    if rng.random() < 0.4:
        body.append("<div class='comments'>" + "".join(f"<p>{text(5, 15)}</p>" for _ in range(rng.randint(1, 4))) + "</div>")
    main = f"<{tag}{name}>{''.join(body)}</{tag}>"
    if tag == "td":
        main = f"<table><tr>{main}</tr></table>"
    menu = rng.choice(["<nav><ul>{}</ul></nav>", "<ul class='menu'>{}</ul>", "<div><ul>{}</ul></div>", "<div id='top-nav'><ul>{}</ul></div>"]).format(links(rng.randint(3, 9)))
    side = rng.choice(["", "<div class='sidebar'><h3>{0}</h3><ul>{1}</ul></div>", "<div><h3>{0}</h3><ul>{1}</ul></div>", "<aside><p>{0}</p></aside>"]).format(text(2, 4), links(4))
    foot = rng.choice(["<footer><p>{}</p></footer>", "<div class='site-footer'>{}</div>", "<div id='footer'><p>{}</p></div>"]).format(text(5, 14))
    notice = rng.choice(["", "<div class='cookie-notice'><p>{}</p><a href='#'>Accept</a></div>", "<div role='alert'>{}</div>"]).format(text(8, 20))
    parts = [notice, menu, *([side, main] if rng.random() < 0.5 else [main, side]), foot]
    wrap = rng.choice(["{}", "<div id='page'>{}</div>", "<div class='widget-area'>{}</div>"])
    return f"<html><head><title>x</title><script>var a = '<p>';</script></head><body>{wrap.format(''.join(parts))}</body></html>", blocks
