"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks (runs of text between block-level tags, with the open elements above them).
Each block has binary features of its ancestors' tags, of the words in their class, id and role, and of its
text.  The field labels the chain of a page's blocks as article or not; weights are trained here, by
gradient steps on the exact conditional likelihood over labelled pages (forward and backward sums), and
pages are decoded by Viterbi.

The labelled pages come from `labelled_pages`, which writes pages in many layouts and knows each block's
label; other labelled pages can be given to `train`.

Defined cases: a null or empty html has no text ("" and 0); markup that is cut, badly nested or unclosed is read
as browsers do in the main (an unclosed head ends with its last head element); a page without any article block gives ""; very long pages are read whole;
repeated rows each give their row; an empty table gives an empty result; other columns don't take part.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Container, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe.llm import textcols as tc
from seriesframe.llm.tables import small_batches

# ---- blocks -------------------------------------------------------------------------------------------

#: Elements whose content is never text of the page: code, pictures and sounds, and what forms hold.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "title", "textarea", "select", "datalist", "audio", "video")
#: Starts of other elements than these, and text, end a head that isn't closed.
_HEAD = frozenset("base basefont bgsound head html link meta".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that go on within a block.
INLINE = frozenset("a abbr acronym b bdi bdo big button canvas cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mover mrow ms msqrt mstyle msub msubsup msup mtext munder object output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Starts of these close an open p, wherever it is down to one of _SCOPES.
_CLOSE_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
_SCOPES = frozenset("applet button caption html marquee object table td template th".split())
#: A start closes an item of these unless one of _WALLS is open within the item; address, div and p are no walls.
_ITEMS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}
_WALLS = frozenset("applet article aside blockquote body button caption center col colgroup dd details dir dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup html li main marquee menu nav object ol pre search section summary table tbody td template tfoot th thead tr ul xmp".split())
#: A start closes the outermost of these within the innermost table.
_CELLS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")} | dict.fromkeys(("tbody", "thead", "tfoot"), ("tbody", "thead", "tfoot", "tr", "td", "th"))
_INSIDE = r"(?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"  # of a tag: a sign > in quotes doesn't end it
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<svg(?=[\s/])[^>]*+(?<=/)>"  # without content
    r"|<(" + "|".join(RAW) + r")(?=[\s/>])(?:" + _INSIDE + r">|[^>]*+>).*?(?:</\1(?=[\s/>])[^>]*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)(" + _INSIDE + r")>|<[!?][^>]*+>",
    re.S | re.I,
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    features: tuple[str, ...]


def _own(tag: str, attributes: str) -> frozenset[str]:
    """Features that an element gives all blocks within it."""
    out = {f"in:{tag}"} if tag not in INLINE else set()
    if attributes.strip():
        for name, a, b, c in _ATTR.findall(attributes):
            value, name = (a or b or c).lower(), name.lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                out.add("hidden")
            elif name == "role":
                out.add(f"role:{value}")
            elif name in ("class", "id"):
                out.update(f"key:{w}" for w in _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", a or b or c).lower()))
    return frozenset(out)


_SAID = tuple("© copyright|all rights|cookie|we use cookies|subscribe|sign up|log in|login|share|advert|sponsor|related|read more|privacy|terms|follow us|reply|leave a comment|posted by|home".split("|"))


def _of_text(text: str, linked: int, parent: str, index: int) -> list[str]:
    words = text.count(" ") + 1
    out = [f"parent:{parent}", "words:" + ("1" if words == 1 else "2-4" if words < 5 else "5-9" if words < 10 else "10-19" if words < 20 else "20-49" if words < 50 else "50+")]
    share = linked / len(text)
    out.append("links:" + ("0" if not linked else "some" if share < 0.3 else "half" if share < 0.8 else "all"))
    out.append("end:stop" if text[-1] in ".!?…:;\"”»" else "end:none")
    low = text.lower()
    says = "says" if words < 20 else "tells"
    out += [f"{says}:{s}" for s in _SAID if s in low]
    if text.count("|") + text.count("»") + text.count("·") >= 2 and words < 25:
        out.append("bars")
    if index == 0:
        out.append("first")
    return out


def blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """Leaf blocks in page order; with features of open elements at any depth (those in `known` only, if given)."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []  # open elements with their own features
    depths: defaultdict[str, list[int]] = defaultdict(list)  # by tag, where in the stack
    outer: list[int] = []  # where in the stack: elements not inline, walls and scopes
    walls: list[int] = []
    scopes: list[int] = []
    inherited: dict[str, int] = {}  # features of open elements, and how many of these have them
    parts: list[str] = []
    linked, in_link, dropped = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            whole = "".join(parts)
            text = " ".join((html.unescape(whole) if "&" in whole else whole).split())
            if text:
                parent = stack[outer[-1]][0] if outer else "none"
                out.append(Block(text, (*inherited, *_of_text(text, linked, parent, len(out)))))
            parts.clear()
        linked = 0

    def push(tag: str, own: frozenset[str]) -> None:
        nonlocal in_link, dropped
        for places, member in ((depths[tag], True), (outer, tag not in INLINE), (walls, tag in _WALLS), (scopes, tag in _SCOPES)):
            if member:
                places.append(len(stack))
        for f in own:
            inherited[f] = inherited.get(f, 0) + 1
        stack.append((tag, own))
        in_link += tag in ("a", "button")
        dropped += tag == "head"

    def pop_to(depth: int) -> None:
        nonlocal in_link, dropped
        while len(stack) > depth:
            tag, own = stack.pop()
            for places in (depths[tag], outer, walls, scopes):
                if places and places[-1] == len(stack):
                    places.pop()
            for f in own:
                if inherited[f] == 1:
                    del inherited[f]
                else:
                    inherited[f] -= 1
            in_link -= tag in ("a", "button")
            dropped -= tag == "head"

    def implied(tag: str) -> None:
        """Close what the start of a tag closes."""
        if tag in _CLOSE_P and depths["p"] and depths["p"][-1] > (scopes[-1] if scopes else -1):
            pop_to(depths["p"][-1])
        if tag in _ITEMS and walls and stack[walls[-1]][0] in _ITEMS[tag]:
            pop_to(walls[-1])
        elif tag in _CELLS:
            table = depths["table"][-1] if depths["table"] else -1
            within = [x[k] for t in _CELLS[tag] if (x := depths[t]) and (k := bisect_right(x, table)) < len(x)]
            if within:
                pop_to(min(within))
        elif tag == "option" and stack and stack[-1][0] == "option":
            pop_to(len(stack) - 1)

    def text(run: str) -> None:
        nonlocal linked
        if dropped and not run.isspace():
            pop_to(depths["head"][0])
        if not dropped:
            parts.append(run)
            linked += len(run) if in_link else 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        raw, close, tag, attributes = m.groups()
        if tag is None:
            continue  # a comment, a declaration or raw text; inside a block, it joins what stands around
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        if close:
            if depths[tag]:
                pop_to(depths[tag][-1])
            continue
        if dropped and tag not in _HEAD:
            pop_to(depths["head"][0])
        implied(tag)
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in INLINE:
            continue
        own = _own(tag, attributes)
        push(tag, own if known is None else frozenset(f for f in own if f in known))
    if at < len(page):
        text(page[at:])
    flush()
    return out


# ---- the field ----------------------------------------------------------------------------------------


@dataclass
class Model:
    weights: dict[str, float]  # of the label article over the other, by feature
    bias: float
    start: tuple[float, float]
    move: tuple[tuple[float, float], tuple[float, float]]  # from, to

    def decode(self, chain: Sequence[Block]) -> list[bool]:
        """The likeliest labels of a page's blocks (Viterbi); ties go to not article."""
        if not chain:
            return []
        get = self.weights.get
        (m00, m01), (m10, m11) = self.move
        unary = [self.bias + sum(get(f, 0.0) for f in b.features) for b in chain]
        s0, s1 = self.start[0], self.start[1] + unary[0]
        back: list[tuple[bool, bool]] = []
        for u in unary[1:]:
            a0, b0, a1, b1 = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back.append((b0 > a0, b1 > a1))
            s0, s1 = max(a0, b0), max(a1, b1) + u
        label = s1 > s0
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]

    def extract(self, page: str) -> str:
        chain = blocks(page, self.weights)  # other features weigh nothing
        return " ".join(b.text for b, y in zip(chain, self.decode(chain), strict=True) if y)


def train(pages: Iterable[tuple[Sequence[Block], Sequence[int]]], *, penalty: float = 0.0003, steps: int = 150, rate: float = 0.3) -> Model:
    """Maximum conditional likelihood with an L2 penalty, by Adam steps on all pages at once."""
    pages = [(b, y) for b, y in pages if len(b)]
    names = {f: i for i, f in enumerate(sorted({f for b, _ in pages for x in b for f in x.features}))}
    n, longest, d = len(pages), max(len(b) for b, _ in pages), len(names)
    x = np.zeros((n, longest, d), np.float32)
    y = np.zeros((n, longest), np.int64)
    there = np.zeros((n, longest), bool)
    for i, (chain, labels) in enumerate(pages):
        there[i, : len(chain)], y[i, : len(chain)] = True, labels
        for t, b in enumerate(chain):
            x[i, t, [names[f] for f in b.features]] = 1
    flat, mask = x[there], there
    w, bias, start, move = np.zeros(d), np.zeros(1), np.zeros(2), np.zeros((2, 2))
    params = [w, bias, start, move]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    both = there[:, 1:]
    seen_move = np.zeros((2, 2))
    np.add.at(seen_move, (y[:, :-1][both], y[:, 1:][both]), 1)
    seen_start = np.bincount(y[:, 0], minlength=2)
    log_sum = lambda a, axis: np.logaddexp(np.take(a, 0, axis), np.take(a, 1, axis))
    for step in range(1, steps + 1):
        unary = np.zeros((n, longest, 2))
        unary[mask, 1] = flat @ w + bias[0]
        forward = np.zeros((n, longest, 2))
        backward = np.zeros((n, longest, 2))
        forward[:, 0] = start + unary[:, 0]
        for t in range(1, longest):
            new = log_sum(forward[:, t - 1, :, None] + move, 1) + unary[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = log_sum(np.swapaxes(move + (unary[:, t + 1] + backward[:, t + 1])[:, None, :], 1, 2), 1)
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0)
        z = log_sum(forward[:, -1], 1)
        p = np.exp(forward + backward - z[:, None, None])
        pair = np.exp(forward[:, :-1, :, None] + move + (unary[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        residual = (y[mask] == 1) - p[mask][:, 1]
        grads = [flat.T @ residual / n - penalty * w, np.array([residual.sum() / n]), (seen_start - p[:, 0].sum(0)) / n - penalty * start, (seen_move - pair.sum((0, 1))) / n - penalty * move]
        for k, (param, g) in enumerate(zip(params, grads, strict=True)):
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            param += rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Model({f: float(w[i]) for f, i in names.items()}, float(bias[0]), (float(start[0]), float(start[1])), tuple(tuple(map(float, r)) for r in move))


# ---- labelled pages -----------------------------------------------------------------------------------


def labelled_pages(count: int = 400, seed: int = 7) -> list[tuple[str, list[str]]]:
    """(html, texts of the article's blocks in order): pages in many layouts, with made-up words."""
    rng = random.Random(seed)
    syllables = "ba do re mi lu ter son ka vel ing ar on es tion ble the and que der ich été ñor".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    phrase = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    def sentence(a: int = 4, b: int = 16) -> str:
        return phrase(a, b).capitalize() + rng.choice(["."] * 8 + ["!", "?"])

    def prose() -> str:
        kind = rng.random()
        if kind < 0.1:  # short or odd paragraphs belong to the article all the same
            return rng.choice([word().capitalize() + ".", sentence(1, 4), phrase(2, 8), " ".join(word() + rng.choice(["***", "###", "$$$", "%%%"]) for _ in range(8)), " | ".join(word() for _ in range(8)), phrase(4, 10).upper() + "!!"])
        whole = [sentence() for _ in range(rng.randint(1, 7))]
        if rng.random() < 0.15:  # prose may speak of anything
            whole.insert(rng.randrange(len(whole) + 1), f"{phrase(3, 9).capitalize()} {rng.choice(_SAID[1:])} {phrase(6, 14)}.")
        return " ".join(whole)

    link = lambda t: f'<a href="/{word()}">{t}</a>'
    links = lambda a, b: "".join(f"<li>{link(phrase(1, 2))}</li>" for _ in range(rng.randint(a, b)))
    attr = lambda *names: rng.choice(["class", "id"]) + f'="{rng.choice(names)}{rng.choice(["", "", " " + word(), "-" + word()])}"'

    def menu() -> str:
        inner = f"<ul>{links(3, 8)}</ul>"
        return rng.choice([f"<nav>{inner}</nav>", f"<nav>{inner}</nav>", f"<div {attr('menu', 'nav', 'navbar', 'navigation', 'main-menu', 'topnav')}>{inner}</div>", f'<div role="navigation">{inner}</div>', f"<nav {attr('breadcrumb', 'breadcrumbs')}>{link(word())} » {link(word())} » {phrase(1, 4)}</nav>"])

    def header() -> str:
        inner = rng.choice([f"<h1>{phrase(1, 3)}</h1>", f"<p>{sentence(3, 8)}</p>", f'<div {attr("logo", "site-title", "tagline")}>{phrase(1, 5)}</div>']) + (menu() if rng.random() < 0.4 else "")
        return rng.choice([f"<header>{inner}</header>", f"<header {attr('site-header', 'header', 'masthead')}>{inner}</header>", f"<div {attr('header', 'site-header', 'masthead', 'top-bar', 'banner')}>{inner}</div>", f'<div role="banner">{inner}</div>'])

    def footer() -> str:
        inner = rng.choice([f"&copy; {word()}.example.com &middot; {sentence(3, 12)} {sentence(2, 8)}", f"<p>Copyright {rng.randint(1999, 2026)} {phrase(1, 3)}. All rights reserved.</p>", f"<ul>{links(2, 6)}</ul>", f"<p>{sentence(4, 14)}</p>"])
        return rng.choice([f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"<div {attr('footer', 'site-footer', 'colophon', 'bottom')}>{inner}</div>", f'<div role="contentinfo">{inner}</div>'])

    def advert() -> str:
        inner = rng.choice([sentence(3, 14), f"{sentence(3, 9)} {sentence(3, 9)}", f"<p>{sentence(4, 12)}</p>", link(phrase(2, 6)), "Advertisement", f"Sponsored: {sentence(3, 9)}"])
        return f'<{(t := rng.choice(["div", "div", "div", "aside", "section", "p"]))} {attr("ad", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad", "adbox")}>{inner}</{t}>'

    def sidebar() -> str:
        inner = rng.choice([f"<h3>{phrase(1, 3)}</h3><ul>{links(2, 6)}</ul>", f"<p>{sentence(3, 12)}</p>", f"<h3>{phrase(1, 3)}</h3><p>{sentence()} {sentence()}</p>", f"<div>{sentence(3, 9)}</div>"])
        return rng.choice([f"<aside>{inner}</aside>", f"<aside {attr('sidebar', 'related', 'widget')}>{inner}</aside>", f"<div {attr('sidebar', 'side', 'widget', 'related', 'related-posts', 'recommended', 'rail')}>{inner}</div>", f'<div role="complementary">{inner}</div>'])

    def notice() -> str:
        inner = rng.choice([f"We use cookies. {sentence(3, 10)}", sentence(4, 14), f"<p>{sentence(4, 12)} {link(phrase(1, 2))}</p>"])
        return rng.choice([f"<div {attr('cookie', 'cookies', 'cookie-notice', 'cookie-banner', 'consent', 'gdpr', 'notice', 'alert', 'popup', 'modal', 'overlay', 'newsletter', 'subscribe', 'paywall', 'disclaimer')}>{inner}</div>", f'<div role="alert">{inner}</div>', f'<div role="dialog">{inner}</div>', f'<section {attr("notice", "cookie-notice", "banner")}>{inner}</section>'])

    def form() -> str:
        return rng.choice([f"<form><label>{phrase(1, 3)}</label><input name=a><p>{sentence(3, 8)}</p></form>", f"<form {attr('search', 'login', 'signup', 'newsletter-form', 'contact')}>{phrase(1, 4)}<input type=text><button>{word()}</button></form>", f'<div role="search">{phrase(1, 3)}</div>'])

    def share() -> str:
        return f"<div {attr('share', 'social', 'sharing', 'social-links', 'tags', 'pagination', 'toolbar')}>{rng.choice([link(word()) + ' ' + link(word()), 'Share: ' + link(word()), phrase(1, 4)])}</div>"

    def comments() -> str:
        one = lambda: rng.choice([f"<div {attr('comment', 'comment-body', 'reply')}><b>{word()}</b> <p>{sentence()} {sentence()}</p></div>", f"<li><p>{sentence()}</p></li>", f"<p>{sentence()} {sentence()}</p>", f"<article {attr('comment', 'comment-body')}><p>{sentence()} {sentence()}</p></article>"])
        inner = rng.choice(["", f"<h2>{phrase(1, 2)}</h2>", "<h3>Comments</h3>"]) + "".join(one() for _ in range(rng.randint(1, 5)))
        return f'<{(t := rng.choice(["section", "div", "div", "ol", "aside"]))} {attr("comments", "comments", "comment-list", "commentlist", "discussion", "responses", "disqus", "reader-comments", "respond", "replies")}>{inner}</{t}>'

    junk = (menu, header, footer, advert, sidebar, notice, form, share, comments)
    out = []
    for _ in range(count):
        texts: list[str] = []

        def put(tag: str, text: str, texts: list[str] = texts) -> str:
            texts.append(" ".join(text.split()))
            return f"<{tag}>{text}" + (f"</{tag}>" if tag != "p" or rng.random() < 0.9 else "")

        body = [put("h1", phrase(2, 10).capitalize() + rng.choice(["", "."]))] if rng.random() < 0.85 else []
        inside = rng.random() < 0.35  # junk within the article
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            if kind < 0.72:
                if rng.random() < 0.15:
                    a, b = prose(), prose()
                    texts += [a, b]
                    body.append(f"<p><b>{a}<br><p>{b}</p>")
                else:
                    body.append(put("p", prose()))
            elif kind < 0.8:
                body.append(put(rng.choice(["h2", "h3"]), phrase(1, 6).capitalize()))
            elif kind < 0.86:
                body.append("<ul>" + "".join(put("li", sentence(2, 10)) for _ in range(rng.randint(2, 4))) + "</ul>")
            elif kind < 0.9:
                body.append(f"<blockquote>{put('p', sentence())}</blockquote>")
            elif kind < 0.94:
                body.append("<table><tr>" + "".join(put("td", phrase(1, 3)) for _ in range(rng.randint(2, 4))) + "</tr></table>")
            elif kind < 0.97:
                a, b, c = phrase(2, 6), phrase(1, 3), sentence(2, 8)
                texts.append(f"{a} {b} {c}")
                body.append(f"<p>{a} {link(b)} {c}</p>")
            elif inside:
                body.append(rng.choice([advert, share, sidebar, notice, form])())
        if inside and rng.random() < 0.5:
            body.append(rng.choice([comments, share, footer])())
        inner = "".join(body)
        frame = rng.random()
        if frame < 0.5:
            main = f"<article>{inner}</article>"
        elif frame < 0.62:
            main = f"<main>{inner}</main>"
        elif frame < 0.7:
            main = f"<main><article {attr('post', 'entry', 'article')}>{inner}</article></main>"
        elif frame < 0.92:
            main = f"<div {attr('content', 'post', 'entry-content', 'article-body', 'main-content', 'story', 'post-content', 'article', 'text', 'body')}>{inner}</div>"
        elif frame < 0.96:
            main = inner
        else:
            out.append((rng.choice(["", "<p>"]) + " ".join(texts[:1]), texts[:1]))
            continue
        before = "".join(rng.choice([menu, header, advert, notice, form])() for _ in range(rng.randint(0, 4)))
        after = "".join(rng.choice([footer, footer, sidebar, advert, comments, share, form, notice])() for _ in range(rng.randint(0, 4)))
        wrap = rng.random()
        whole = f"<div {attr('page', 'wrapper', 'container', 'site')}>{before}{main}{after}</div>" if wrap < 0.25 else before + main + after
        out.append((f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{phrase(2, 6)}</title><style>p{{}}</style></head><body>{whole}<script>x()</script></body></html>", texts))
        assert len(junk) == 9
    return out


def _labels(chain: Sequence[Block], texts: Sequence[str]) -> list[int]:
    """Labels of a made page's blocks, by walking through its article's texts in order."""
    out, k = [], 0
    for b in chain:
        hit = k < len(texts) and b.text == html.unescape(texts[k])
        out.append(int(hit))
        k += hit
    return out


def default_model(count: int = 400, seed: int = 7) -> Model:
    pages = [(blocks(page), texts) for page, texts in labelled_pages(count, seed)]
    return train((chain, _labels(chain, texts)) for chain, texts in pages)


# ---- on DataFrames ------------------------------------------------------------------------------------


def extract(pages: DataFrame, model: Model, *, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each row."""
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    def run(batches):
        for batch in batches:
            texts = [shared.value.extract(h) for h in tc.column(batch, "_h").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).alias("_h"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
