"""Labelled pages for fitting the DOM model: many layouts, each text run marked as content or not."""

from __future__ import annotations

import random

#: Names that tell nothing about the part of a page.
_PLAIN_NAMES = ["wrapper", "container", "row", "col-8", "inner", "box", "grid", "left", "wrap"]
#: First texts of parts, each with a number that keeps it apart.
_FIRST_TEXTS = {
    "notice": ["We use cookies to improve site {}.", "This site {} uses cookies. Read our privacy policy.", "Cookie settings of page {}", "By using page {} you agree to our use of cookies and similar means."],
    "comments": ["{} comments", "Comments ({})", "{} Replies", "{} responses", "Leave a reply to {}", "Join the discussion of {}"],
    "advert": ["Advertisement {}", "Sponsored content {}", "Sponsored by number {}", "Special offer {} for new customers"],
    "aside": ["Related stories {}", "Popular now {}", "You may also like {}", "Most read of {}", "Latest from {}", "More from {}"],
    "form": ["Subscribe to newsletter {}", "Sign up for list {}", "Enter your email for {}", "Log in to {}"],
    "share": ["Share this {}", "Follow us on {}", "Posted by number {}", "Tags {}", "Filed under {}"],
}
_SYLLABLES = "ka lo mi ren ta vo sel dor an is um er el no ti pra gen".split()


class _Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.labels: dict[str, int] = {}
        self.count = 0
        self.plain = False  # an article without sentence marks
        self.nameless = self.r.random() < 0.35  # a page without telling names and elements, whose parts say what they are

    def words(self, low: int, high: int) -> str:
        """A unique run of words, so a text names its label."""
        self.count += 1
        some = ["".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4))) for _ in range(self.r.randint(low, high))]
        return " ".join([some[0].capitalize() + str(self.count), *some[1:]])

    def mark(self, text: str, label: int) -> str:
        self.labels[text] = label
        return text

    def sentences(self, label: int, least: int = 1, most: int = 6) -> str:
        return self.mark(" ".join(self.words(4, 18) + ("" if self.plain else self.r.choice([".", ".", ".", "?", "!"])) for _ in range(self.r.randint(least, most))), label)

    def attribute(self, names: list[str], chance: float = 0.75) -> str:
        if self.nameless:
            return f' class="{self.r.choice(_PLAIN_NAMES)}"' if self.r.random() < 0.4 else ""
        if self.r.random() > chance:
            return ""
        name = self.r.choice(names)
        return self.r.choice([f' class="{name}"', f' id="{name}"', f" class='x {name}-{self.r.randint(1, 9)}'", f' class="{name.capitalize()}Box"'])

    def telling(self, kind: str, chance: float = 0.3) -> str:
        """A first text that says what a part is; always there in a page without names."""
        if not self.nameless and self.r.random() > chance:
            return ""
        self.count += 1
        text = self.r.choice(_FIRST_TEXTS[kind]).format(self.count)
        tag = self.r.choice(["h3", "h4", "p", "div", "strong"])
        return f"<{tag}>{self.mark(text, 0)}</{tag}>" if tag != "strong" else f"<div><strong>{self.mark(text, 0)}</strong></div>"

    def tag(self, *tags: str) -> str:
        return self.r.choice(["div", "div", "section"]) if self.nameless else self.r.choice(tags)

    def links(self, label: int, n: int, item: str = "li") -> str:
        out = []
        for _ in range(n):
            text = self.mark(self.words(1, 4), label)
            out.append(f'<{item}><a href="/x">{text}</a></{item}>' if item else f'<div><a href="/x">{text}</a></div>')
        return "".join(out)

    def menu(self) -> str:
        inner = self.links(0, self.r.randint(2, 9))
        tag, names = self.r.choice([("nav", ["nav", "menu"]), ("div", ["menu", "navbar", "breadcrumb"]), ("ul", ["menu", "nav"])])
        tag = "div" if self.nameless and tag == "nav" else tag
        return f"<{tag}{self.attribute(names, 0.9 if tag != 'nav' else 0.3)}>{inner if tag == 'ul' else '<ul>' + inner + '</ul>'}</{tag}>"

    def header(self) -> str:
        tag = self.tag("header", "div")
        name = f"<h1>{self.mark(self.words(1, 4), 0)}</h1>"
        inner = self.r.choice(["", name, name, f"<p>{self.mark(self.words(2, 7), 0)}</p>", f"<div>{self.mark(self.words(1, 3), 0)}</div>"])
        return f"<{tag}{self.attribute(['header', 'masthead', 'topbar'], 1 if tag == 'div' else 0.4)}>{inner}{self.menu() if self.r.random() < 0.5 else ''}</{tag}>"

    def footer(self) -> str:
        tag = self.tag("footer", "footer", "div")
        line = self.mark("© " + self.words(2, 10) + self.r.choice(["", " All rights reserved.", "."]), 0)
        extra = self.r.choice(["", f"<ul>{self.links(0, 4)}</ul>", f"<p>{self.sentences(0, 1, 2)}</p>"])
        line = self.r.choice([line, f"<p>{line}</p>"])
        return f"<{tag}{self.attribute(['footer', 'copyright'], 1 if tag == 'div' else 0.4)}>{line}{extra}</{tag}>"

    def aside(self) -> str:
        tag = self.tag("aside", "aside", "div", "section")
        body = self.r.choice([f"<h3>{self.mark(self.words(1, 3), 0)}</h3><ul>{self.links(0, 5)}</ul>", f"<p>{self.sentences(0, 1, 3)}</p>", self.sentences(0, 1, 2), f"<h4>{self.mark(self.words(1, 3), 0)}</h4><p>{self.sentences(0, 1, 3)}</p>"])
        return f"<{tag}{self.attribute(['sidebar', 'widget', 'related', 'popular'], 1 if tag != 'aside' else 0.4)}>{self.telling('aside')}{body}</{tag}>"

    def advert(self) -> str:
        body = self.r.choice([self.sentences(0, 1, 3), f"<p>{self.sentences(0, 1, 2)}</p>", f'<p><a href="/x">{self.mark(self.words(2, 8), 0)}</a></p>', f"<p>{self.sentences(0, 1, 2)}</p><p>{self.sentences(0, 1, 2)}</p>"])
        tag = self.tag("div", "section", "div")
        return f"<{tag}{self.attribute(['ad', 'ads', 'advert', 'sponsored', 'promo', 'ad-slot', 'advertisement'], 1)}>{self.telling('advert')}{body}</{tag}>"

    def notice(self) -> str:
        body = self.r.choice([self.sentences(0, 1, 3), f"<p>{self.sentences(0, 1, 3)}</p><button>{self.mark(self.words(1, 2), 0)}</button>"])
        if self.nameless and self.r.random() < 0.5:  # the words and the button side by side, without elements of their own
            self.count += 1
            body = f"{self.mark(self.r.choice(_FIRST_TEXTS['notice']).format(self.count), 0)}<button>{self.mark(self.words(1, 2), 0)}</button>"
            return f"<div>{body}</div>"
        tag = self.tag("div", "div", "section", "dialog")
        return f"<{tag}{self.attribute(['cookie', 'consent', 'notice', 'popup', 'modal', 'alert'], 1)}>{self.telling('notice')}{body}</{tag}>"

    def form(self) -> str:
        body = f"<p>{self.sentences(0, 1, 2)}</p>" if self.r.random() < 0.5 else f"<label>{self.mark(self.words(1, 4), 0)}</label>"
        return f"<form{self.attribute(['newsletter', 'search', 'subscribe', 'login'], 0.5)}>{self.telling('form')}{body}<input name=q><button>{self.mark(self.words(1, 2), 0)}</button></form>"

    def share(self) -> str:
        return f"<div{self.attribute(['share', 'social', 'byline', 'meta', 'tags'], 1)}>{self.telling('share')}{self.r.choice([self.links(0, 3, ''), '<p>' + self.mark(self.words(2, 8), 0) + '</p>', self.mark(self.words(2, 6), 0)])}</div>"

    def hidden(self) -> str:
        return f"<div{self.r.choice([' hidden', ' style=\"display:none\"', ' aria-hidden=\"true\"'])}><p>{self.sentences(0, 1, 4)}</p></div>"

    def comments(self) -> str:
        one = lambda: self.r.choice([f"<li><p>{self.sentences(0, 1, 4)}</p></li>", f"<div{self.attribute(['comment', 'reply'], 0.8)}><p>{self.sentences(0, 1, 4)}</p></div>", f"<{self.tag('article', 'div', 'div')}{self.attribute(['comment'], 1)}><h4>{self.mark(self.words(1, 2), 0)}</h4><p>{self.sentences(0, 1, 4)}</p></article>"])
        title = f"<h3>{self.mark(self.words(1, 3), 0)}</h3>" if self.r.random() < 0.6 else ""
        title = self.telling("comments") if self.nameless else title
        tag = self.tag("section", "div", "div", "ol")
        return f"<{tag}{self.attribute(['comments', 'commentlist', 'replies', 'discussion'], 1)}>{title}{''.join(one() for _ in range(self.r.randint(1, 5)))}</{tag}>"

    def article(self) -> str:
        title = f"<h1>{self.mark(self.words(2, 10), 1)}</h1>"
        title = self.r.choice([title, title, title, f"<header{self.attribute(['entry-header', 'post-header', 'article-header'], 0.6)}>{title}</header>", f"<div>{title}</div>"])
        parts = [title] if self.r.random() < 0.85 else []
        self.plain = self.r.random() < 0.25
        for _ in range(self.r.choice([1, 1, 2, 3, 4, 5, 6, 8, 10])):
            kind = self.r.random()
            if kind < 0.6:
                text = self.sentences(1, 1, 8)
                parts.append(self.r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p><b>{text}<br>", f"<div>{text}</div>"]))
            elif kind < 0.7:
                parts.append(f"<p>{self.mark(self.words(1, 5) + '.', 1)}</p>")
            elif kind < 0.78:
                parts.append(f"<h2>{self.mark(self.words(1, 6), 1)}</h2>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{self.sentences(1, 1, 2)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote>{self.sentences(1, 1, 3)}</blockquote>")
            elif kind < 0.94:
                parts.append(f"<figure><img src=a.png><figcaption>{self.sentences(1, 1, 1)}</figcaption></figure>")
            elif kind < 0.97:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.mark(self.words(1, 4), 1)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            else:
                parts.append(f"<pre>{self.mark(self.words(3, 20), 1)}</pre>")
            if self.r.random() < 0.14:
                parts.append(self.r.choice([self.advert, self.notice, self.aside, self.form, self.share, self.hidden])())
        self.plain = False
        if self.r.random() < 0.15:
            parts.append(f"<footer{self.attribute(['entry-footer', 'post-meta', 'tags'], 0.6)}>{self.mark(self.words(2, 6), 0)}</footer>")
        inner = self.comments() if self.nameless and self.r.random() < 0.3 else ""
        tag = self.tag("article", "article", "article", "main", "div", "div", "section")
        body = "".join(parts)
        if self.r.random() < 0.12 and not self.nameless:
            return body  # nothing around it
        telling = self.attribute(["content", "article", "post", "entry", "main", "story"], 0.9)
        names = self.r.choice([telling, self.attribute(_PLAIN_NAMES, 0.7)]) if tag in ("div", "section") else self.r.choice([telling, "", ""])
        body = f"<{tag}{names}>{body}{inner}</{tag}>" if self.r.random() < 0.3 else f"<{tag}{names}>{body}</{tag}>{inner}"
        for _ in range(self.r.randint(0, 3)):
            wrap = self.r.choice(["div", "div", "main", "section"])  # main may hold a page's other parts too
            body = f"<{wrap}{self.attribute([*_PLAIN_NAMES, 'main', 'page'], 0.6)}>{body}</{wrap}>"
        return body

    def wrapped(self, part: str) -> str:
        return f"<div{self.attribute(_PLAIN_NAMES, 0.7)}>{part}</div>" if self.r.random() < 0.3 else part

    def page(self) -> str:
        before = [self.wrapped(f()) for f in (self.header, self.header, self.menu, self.notice, self.advert, self.aside, self.form, self.hidden) if self.r.random() < 0.35]
        after = [self.wrapped(f()) for f in (self.share, self.comments, self.aside, self.advert, self.form, self.menu, self.notice) if self.r.random() < 0.35]
        last = [self.footer()] if self.r.random() < 0.85 else []
        return f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style></head><body>{''.join(before)}{self.article()}{''.join(after + last)}</body></html>"


def labelled_pages(n: int, seed: int = 5) -> list[tuple[str, dict[str, int]]]:
    """n pages with the label of each of their text runs (1: content)."""
    out = []
    for i in range(n):
        maker = _Maker(seed * 100_003 + i)
        out.append((maker.page(), maker.labels))
    return out
