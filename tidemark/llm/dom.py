"""A tolerant HTML parser that keeps what main-text extraction needs, and its opposite, small pages made for training."""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select object canvas audio video math noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body dd dt head html legend li optgroup option tbody td tfoot th thead title tr".split()) | {"p"}
#: A start tag of the key's set ends an open element of the value's set, up to the nearest element of the third.
ENDS = [
    (CLOSES_P, frozenset({"p"}), frozenset("article body button div html td th li blockquote section".split())),
    (frozenset({"li"}), frozenset({"li"}), frozenset({"ul", "ol", "menu", "body"})),
    (frozenset({"dt", "dd"}), frozenset({"dt", "dd"}), frozenset({"dl", "body"})),
    (frozenset({"tr"}), frozenset({"tr"}), frozenset({"table", "body"})),
    (frozenset({"td", "th"}), frozenset({"td", "th"}), frozenset({"tr", "table", "body"})),
]

#: Where markup may begin: a comment, a tag with its name, or another declaration.
OPENS = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*+)|[!?/])")
SPECIAL = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|hidden|style|aria-label)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s"'/]|$)""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: tuple[str, ...] = ()
    children: list[int] = field(default_factory=list)
    end: int = 0  # nodes of the subtree are those from this one up to end


@dataclass
class Page:
    nodes: list[Node]
    texts: list[tuple[int, str | None]]  # (node, text) in page order; None marks where a block begins or ends


def attribute_tokens(raw: str) -> tuple[str, ...]:
    out = []
    for m in ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            out.append("hidden")
        elif name != "style":
            out += [t.lower() for t in TOKEN.findall(value)]
    return tuple(out)


class Ends:
    """Where tags of a source end, found in time in proportion to the source, whatever stands in it.

    A tag ends at the first > outside quotes. If its quotes don't balance up to the source's end, it ends at the first > at all.
    """

    def __init__(self, source: str) -> None:
        self.source, self.last = source, {c: source.rfind(c) for c in ">\"'"}
        self.next = {">": (0, -1), "": (0, -1)}  # sought: (from, place found)
        self.after: dict[int, int] = {}  # for > and quotes that were met outside quotes, where the tag ends then; -1: nowhere

    def _next(self, sought: str, at: int) -> int:
        """The first > (or, for "", the first > or quote) from `at` on, which isn't sought twice in the same part."""
        since, found = self.next[sought]
        if not since <= at <= found:
            found = self.source.find(">", at) if sought else m.start() if (m := SPECIAL.search(self.source, at)) else len(self.source)
            self.next[sought] = (at, found)
        return found

    def of(self, at: int) -> int:
        """The end of a tag whose name ends at `at`; -1 if there is no > from there on."""
        if at > self.last[">"]:
            return -1
        chain, place = [], self._next("", at)
        while place not in self.after:
            c = self.source[place] if place < len(self.source) else ""
            if c == ">":
                self.after[place] = place
            elif not c or place >= self.last[c]:
                self.after[place] = -1
            else:
                chain.append(place)
                m = SPECIAL.search(self.source, self.source.index(c, place + 1) + 1)
                place = m.start() if m else len(self.source)
        for x in chain:
            self.after[x] = self.after[place]
        return self.after[place] if self.after[place] >= 0 else self._next(">", at)


def parse(source: str) -> Page:
    nodes, texts, stack, at = [Node("#root", -1, 0)], [], [0], 0
    size, ends = len(source), Ends(source)
    open_at: dict[str, list[int]] = {}  # for each tag, the places of its open elements in the stack
    shuts: dict[str, re.Pattern] = {}

    def close(upto: int) -> None:
        while len(stack) > upto:
            n = stack.pop()
            nodes[n].end = len(nodes)
            if n:
                open_at[nodes[n].tag].pop()
            if nodes[n].tag in BLOCK:
                texts.append((stack[-1], None))

    def say(text: str) -> None:
        if text:
            texts.append((stack[-1], html.unescape(text) if "&" in text else text))

    def innermost(tags) -> int:
        return max((found[-1] for t in tags if (found := open_at.get(t))), default=0)

    said = 0
    while m := OPENS.search(source, at):
        at, tag = m.end(), (m[3] or "").lower()
        if m[1]:
            over = source.find("-->", at)
            end = size if over < 0 else over + 3
        else:
            end = (ends.of(at) if tag else ends._next(">", at) if at <= ends.last[">"] else -1) + 1
            if not end:  # no > is left: not markup
                continue
        say(source[said : m.start()])
        raw, said, at = source[at : end - 1], end, end
        if not tag:
            continue
        if m[2]:
            k = innermost((tag,))
            if k and (tag in BLOCK or k >= innermost(("td", "th", "table"))):
                close(k)
            continue
        for starts, ended, stop in ENDS:
            if tag in starts and (k := innermost(ended)) and k >= innermost(stop):
                close(k)
        if tag in RAW:
            if not raw.endswith("/"):
                shut = shuts.setdefault(tag, re.compile(rf"</{re.escape(tag)}\b", re.I)).search(source, at)
                over = source.find(">", shut.end()) if shut else -1
                said = at = over + 1 if over >= 0 else size
            continue
        if tag in BLOCK:
            texts.append((stack[-1], None))
        if tag == "br":
            texts.append((stack[-1], " "))
        nodes[stack[-1]].children.append(len(nodes))
        nodes.append(Node(tag, stack[-1], len(stack), attribute_tokens(raw) if raw else (), [], len(nodes) + 1))
        if tag not in VOID:
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(len(nodes) - 1)
    say(source[said:])
    close(0)
    return Page(nodes, texts)


# Pages for training. Each text is marked with whether it is main text; words carry no meaning on purpose.

SYLLABLES = "the on er an re in ed ti es en at nd ou ha st sch ung lich que ment tion ado ción os au ré la vi".split()
GOOD = "content article post entry story body main text prose page single hentry".split()
BAD = {
    "nav": "nav menu navbar breadcrumb breadcrumbs topnav pagination pager toc links", "header": "header masthead banner branding top site logo", "footer": "footer colophon bottom copyright legal credits",
    "aside": "sidebar side aside widget rail secondary related recommended popular trending tags", "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner adsense dfp outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert notification popup modal overlay paywall subscribe banner disclaimer", "comments": "comment comments discussion disqus replies respond reply thread responses reader",
    "form": "form search newsletter signup login subscribe contact feedback", "share": "share sharing social follow buttons tools toolbar",
}


def made_page(rng: random.Random) -> tuple[str, list[str]]:
    """(html, main text's blocks) of a page with a random layout."""
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))
    say = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + rng.choice([".", ".", ".", "", "!"])
    main: list[str] = []

    def main_text(a: int, b: int) -> str:
        t = say(a, b)
        main.append(t)
        if rng.random() < 0.15:
            w = t.split(" ")
            k = rng.randrange(len(w))
            w[k] = rng.choice([f"<b>{w[k]}</b>", f'<a href="/x">{w[k]}</a>', f"<em>{w[k]}</em>"])
            t = " ".join(w)
        return t

    def named(kind: str) -> str:
        words = BAD[kind].split() if kind in BAD else GOOD
        name = rng.choice(words)
        if rng.random() < 0.4:
            name += rng.choice(["-", "_", " "]) + rng.choice(["wrap", "box", "area", "container", "inner", "block", "section", "list", "item", word()])
        return rng.choice([f' class="{name}"', f' id="{name}"', f' class="{word()} {name}"', f' id="{word()}" class="{name}"'])

    def plain() -> str:
        return rng.choice(["", "", f' class="{word()}"', f' id="{word()}"', ' class="row"', ' class="container"', ' class="wrapper"', ' class="col"'])

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{say(1, 4)}</a></li>' for _ in range(n)) + "</ul>"

    def bad(kind: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, rng.choice(["div", "section"]))
        if kind != "form" and rng.random() < 0.45:
            tag = rng.choice(["div", "div", "section"])
        attrs = named(kind) if tag in ("div", "section") or rng.random() < 0.4 else plain()
        paragraph = lambda a, b: f"<{(t := rng.choice(['p', 'div', 'span', 'p']))}>{say(a, b)}</{t}>"
        if kind in ("nav", "share"):
            inner = links(rng.randint(2, 9)) if rng.random() < 0.8 else " ".join(f'<a href="/">{say(1, 2)}</a>' for _ in range(rng.randint(2, 7)))
        elif kind == "header":
            inner = rng.choice([f"<h1>{say(1, 4)}</h1>", f'<a href="/">{say(1, 3)}</a>', f"<p>{say(1, 5)}</p>"]) + (bad("nav") if rng.random() < 0.5 else "")
        elif kind == "footer":
            inner = rng.choice([f"&copy; {say(2, 9)}", paragraph(2, 20), links(4) + paragraph(2, 9)])
        elif kind == "aside":
            inner = f"<h{(h := rng.randint(2, 4))}>{say(1, 4)}</h{h}>" + rng.choice([links(rng.randint(2, 7)), paragraph(3, 30), paragraph(5, 40) + paragraph(5, 40)])
        elif kind in ("ad", "notice"):
            inner = rng.choice([say(2, 25), paragraph(3, 30), f"<p>{say(3, 20)}</p><a href='/'>{say(1, 3)}</a>", f"<p>{say(8, 40)}</p><button>{say(1, 2)}</button>"])
        elif kind == "comments":
            one = lambda: rng.choice([f'<div class="comment"><b>{say(1, 2)}</b><p>{say(3, 40)}</p></div>', f"<li><cite>{say(1, 2)}</cite><p>{say(3, 50)}</p></li>", f"<p>{say(3, 40)}</p>"])
            inner = f"<h3>{say(1, 3)}</h3>" * (rng.random() < 0.7) + "".join(one() for _ in range(rng.randint(1, 6))) + (bad("form") if rng.random() < 0.3 else "")
        else:
            inner = f'<label>{say(1, 3)}</label><input name="x"><p>{say(1, 12)}</p><button>{say(1, 2)}</button>'
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def body_part() -> str:
        kind = rng.random()
        if kind < 0.62:
            return rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}<br>", "<p><b>{}<br>", "<div>{}</div>"]).format(main_text(1, rng.choice([3, 30, 120])))
        if kind < 0.74:
            return f"<h{(h := rng.randint(1, 4))}>{main_text(1, 9)}</h{h}>"
        if kind < 0.82:
            return f"<{(t := rng.choice(['ul', 'ol']))}>" + "".join(f"<li>{main_text(1, 15)}</li>" for _ in range(rng.randint(1, 5))) + f"</{t}>"
        if kind < 0.88:
            return f"<blockquote><p>{main_text(4, 40)}</p></blockquote>"
        if kind < 0.92:
            return "<table>" + "".join(f"<tr><td>{main_text(1, 4)}</td><td>{main_text(1, 4)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        if kind < 0.95:
            return f'<figure><img src="/a"><figcaption>{main_text(2, 9)}</figcaption></figure>'
        if kind < 0.97:
            return f"<pre>{main_text(2, 20)}</pre>"
        return f"<section{plain()}>{''.join(body_part() for _ in range(rng.randint(1, 3)))}</section>"

    def article() -> str:
        parts = [f"<{(h := rng.choice(['h1', 'h1', 'h2']))}{plain()}>{main_text(2, 14)}</{h}>"] * 1 if rng.random() < 0.85 else []
        for _ in range(rng.choice([1, 2, 4, 8, 14])):
            parts.append(body_part())
            if rng.random() < 0.07:
                parts.append(bad(rng.choice(["ad", "aside", "share", "notice", "form", "ad"])))
        if rng.random() < 0.2:
            parts.append(bad(rng.choice(["comments", "share", "aside", "footer", "nav"])))
        inner = "".join(parts)
        kind = rng.random()
        if kind < 0.5:
            return f"<article{plain() if rng.random() < 0.6 else named('good')}>{inner}</article>"
        if kind < 0.62:
            return f"<main{plain()}>{inner}</main>"
        return f"<div{named('good')}>{inner}</div>"

    if rng.random() < 0.04:  # text without an element around it
        parts = [rng.choice(["{}", "<b>{}</b>", "<i>{}</i>", '<a href="/x">{}</a>']).format(main_text(1, 60)) if rng.random() < 0.15 else main_text(1, 60) for _ in range(rng.randint(1, 6))]
        main[:] = [" ".join(main)]
        return rng.choice(["<br>", "\n", "<br>\n", " "]).join(parts), main
    before = [bad(k) for k in ("notice", "header", "nav", "nav", "ad", "aside", "form") if rng.random() < 0.4]
    rng.shuffle(before)
    content = article()
    after = [bad(k) for k in ("ad", "comments", "aside", "share", "form", "nav", "notice") if rng.random() < 0.35]
    rng.shuffle(after)
    after += [bad("footer")] if rng.random() < 0.8 else []
    middle = content
    for _ in range(rng.choice([0, 0, 1, 2, 3])):
        take_before, take_after = rng.randint(0, len(before)), rng.randint(0, len(after))
        tag = rng.choice(["div", "div", "section", "main" if "<main" not in middle else "div"])
        middle = f"<{tag}{plain()}>" + "".join(before[take_before:]) + middle + "".join(after[:take_after]) + f"</{tag}>"
        before, after = before[:take_before], after[take_after:]
    head = f"<head><title>{say(2, 9)}</title><style>p{{margin:0}}</style></head>"
    return f"<!DOCTYPE html><html>{head}<body{plain()}>{''.join(before)}{middle}{''.join(after)}<script>var x='<p>';</script></body></html>", main
