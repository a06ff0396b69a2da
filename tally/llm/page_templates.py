"""Labelled pages for the page model: generated markup, varied at random.

Each page is html with the list of its text blocks in page order and whether a
block belongs to the main text. The markup mixes semantic elements, classes
and ids, plain boxes, unclosed tags, link lists, forms, notices, adverts and
reader comments; the words are invented.
"""

from __future__ import annotations

import random

#: Pages the default model is fitted on (the bound of the training sample).
TRAINING_PAGES = 600

_PARTS = "an be co da el fi go hu in ka lo mi no or pe qua re so ti un ve wa za ther sch tion eau ñe".split()


class _Page:
    def __init__(self, rng: random.Random) -> None:
        self.rng, self.html, self.blocks = rng, [], []

    def word(self) -> str:
        return "".join(self.rng.choice(_PARTS) for _ in range(self.rng.randint(1, 3)))

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high))).capitalize()

    def prose(self, sentences: int) -> str:
        return " ".join(self.phrase(2, 16) + self.rng.choice([".", ".", ".", ".", "?", "!"])
                        for _ in range(sentences))

    def put(self, markup: str) -> None:
        self.html.append(markup)

    def say(self, text: str, content: bool, tag: str = "", attrs: str = "", link: bool = False,
            close: bool = True) -> None:
        """A block: an element around a text (or the text alone)."""
        inner = f'<a href="/{self.word()}">{text}</a>' if link else text
        self.put(f"<{tag}{attrs}>{inner}{f'</{tag}>' if close else ''}" if tag else inner)
        self.blocks.append((text, content))

    def pick(self, *options: str) -> str:
        return self.rng.choice(options)

    def mark(self, *names: str) -> str:
        """A class or id attribute with one of the names, at times dressed up."""
        name = self.rng.choice(names)
        name = self.pick(name, name, f"site-{name}", f"{name}-{self.word()}", f"{name}_1", f"c-{name}")
        return f' {self.pick("class", "class", "id")}="{name}"'

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    # Parts that are not content.

    def links(self, low: int, high: int) -> None:
        style = self.rng.randint(0, 2)
        if style == 0:
            self.put("<ul>")
        for _ in range(self.rng.randint(low, high)):
            self.say(self.phrase(1, 5), False, "li" if style == 0 else "div" if style == 1 else "p", link=True,
                     close=style != 0 or self.chance(0.8))
        if style == 0:
            self.put("</ul>")

    def box(self, tags: tuple[str, ...], names: tuple[str, ...], must: bool = False) -> str:
        """Open an element that tells its role by its tag, its class or both."""
        tag = self.rng.choice(tags)
        plain = tag in ("div", "section", "ul")
        self.put(f"<{tag}{self.mark(*names) if must or plain or self.chance(0.5) else ''}>")
        return f"</{tag}>"

    def menu(self) -> None:
        end = self.box(("nav", "nav", "div"), ("nav", "menu", "navbar", "breadcrumb", "pagination", "topnav"))
        self.links(2, 8)
        self.put(end)

    def header(self) -> None:
        end = self.box(("header", "div"), ("header", "masthead", "topbar", "banner", "branding"))
        if self.chance(0.7):
            self.say(self.phrase(1, 4), False, self.pick("h1", "h2", "div", "p", "span"), link=self.chance(0.5))
        if self.chance(0.4):
            self.say(self.phrase(3, 9) + self.pick("", "."), False, "p")
        if self.chance(0.5):
            self.menu()
        self.put(end)

    def footer(self) -> None:
        end = self.box(("footer", "footer", "div"), ("footer", "colophon", "copyright", "legal", "bottom"))
        if self.chance(0.4):
            self.links(2, 6)
        self.say("© " + self.phrase(1, 5) + self.pick("", ".", " · " + self.prose(2), " All rights reserved."), False,
                 self.pick("p", "div", "p"))
        if self.chance(0.4):
            self.say(self.prose(self.rng.randint(1, 4)), False, "p")
        self.put(end)

    def side(self) -> None:
        end = self.box(("aside", "aside", "div", "section"),
                       ("sidebar", "related", "widget", "recommended", "popular", "trending", "rail", "recent"))
        if self.chance(0.6):
            self.say(self.phrase(1, 4), False, self.pick("h2", "h3", "h4", "p", "strong"))
            if self.html[-1].startswith("<strong"):
                self.put("<div>")
                end = "</div>" + end
        if self.chance(0.6):
            self.links(2, 6)
        if self.chance(0.6):
            for _ in range(self.rng.randint(1, 3)):
                self.say(self.prose(self.rng.randint(1, 4)), False, "p")
        self.put(end if self.blocks else end)

    def notice(self) -> None:
        end = self.box(("div", "div", "section", "dialog"),
                       ("cookie", "consent", "notice", "alert", "popup", "newsletter", "gdpr", "modal", "subscribe"))
        self.say(self.prose(self.rng.randint(1, 4)), False, self.pick("p", "div", "p"))
        if self.chance(0.5):
            self.say(self.phrase(1, 2), False, "button")
        self.put(end)

    def advert(self) -> None:
        end = self.box(("div", "div", "aside", "section"), ("ad", "ads", "advert", "sponsored", "advertisement", "promo"), True)
        if self.chance(0.5):
            self.say(self.prose(self.rng.randint(1, 3)), False, self.pick("", "p"))
        else:
            self.say(self.phrase(2, 12), False, self.pick("", "p", "div"), link=self.chance(0.5))
        self.put(end)

    def form(self) -> None:
        self.put(f"<form action=\"/{self.word()}\"{self.mark('search', 'login', 'signup', 'form') if self.chance(0.5) else ''}>")
        if self.chance(0.3):
            self.say(self.prose(self.rng.randint(1, 3)), False, "p")
        if self.chance(0.6):
            self.say(self.phrase(1, 5), False, "label")
        self.put('<input name="q" type="text">')
        self.say(self.phrase(1, 2), False, "button")
        self.put("</form>")

    def comments(self) -> None:
        end = self.box(("section", "div", "div"), ("comments", "discussion", "replies", "responses", "commentlist"))
        if self.chance(0.6):
            self.say(self.phrase(1, 3), False, self.pick("h2", "h3"))
        for _ in range(self.rng.randint(1, 6)):
            tag = self.pick("div", "article", "li", "p")
            self.put(f"<{tag}{self.mark('comment', 'reply', 'response') if self.chance(0.8) else ''}>")
            if tag == "p":
                self.say(self.prose(self.rng.randint(1, 5)), False)
            else:
                if self.chance(0.5):
                    self.say(self.phrase(1, 2), False, self.pick("div", "h4", "p"))
                self.say(self.prose(self.rng.randint(1, 5)), False, "p")
            self.put(f"</{tag}>")
        self.put(end)

    def social(self) -> None:
        end = self.box(("div", "ul"), ("share", "social", "byline", "meta", "tags"))
        tag = "li" if end == "</ul>" else self.pick("p", "div")
        for _ in range(self.rng.randint(1, 4)):
            self.say(self.phrase(1, 4), False, tag, link=self.chance(0.7))
        self.put(end)

    # The main text.

    def paragraphs(self) -> None:
        for _ in range(self.rng.randint(1, 7)):
            kind = self.rng.random()
            if kind < 0.08:
                self.put("<ul>" if self.chance(0.7) else "<ol>")
                shut = "</ul>" if self.html[-1] == "<ul>" else "</ol>"
                for _ in range(self.rng.randint(2, 5)):
                    self.say(self.phrase(2, 12) + self.pick("", "."), True, "li", close=self.chance(0.8))
                self.put(shut)
            elif kind < 0.13:
                self.say(self.prose(self.rng.randint(1, 3)), True, "blockquote")
            elif kind < 0.2:
                self.say(self.phrase(1, 7), True, self.pick("h2", "h3"))
            elif kind < 0.24:
                self.put("<table><tr>")
                for _ in range(self.rng.randint(2, 4)):
                    self.say(self.phrase(1, 4), True, "td")
                self.put("</tr></table>")
            elif kind < 0.28:
                self.put("<figure>")
                self.say(self.phrase(4, 12) + ".", True, "figcaption")
                self.put("</figure>")
            elif kind < 0.31:
                self.say(self.phrase(2, 10), True, "pre")
            elif kind < 0.38:
                # A short paragraph, at times with a link inside.
                self.say(self.phrase(1, 5) + ".", True, "p", close=self.chance(0.7))
            elif kind < 0.44:
                text, tail = self.prose(1), self.prose(1)
                self.put(f'<p>{text} <a href="/x">{self.pick("", "")}{tail}</a></p>')
                self.blocks.append((f"{text} {tail}", True))
            else:
                self.say(self.prose(self.rng.randint(1, 9)), True, self.pick("p", "p", "p", "p", "div"),
                         close=self.chance(0.8))
                if self.html[-1].startswith("<div") and not self.html[-1].endswith("</div>"):
                    self.put("</div>")

    def article(self) -> None:
        style = self.rng.random()
        outer = ""
        if self.chance(0.3):
            self.put("<main>")
            outer = "</main>"
        if style < 0.45:
            self.put(f"<article{self.mark('post', 'entry', 'article', 'story') if self.chance(0.3) else ''}>")
            end = "</article>"
        elif style < 0.85:
            self.put(f"<{self.pick('div', 'div', 'section')}"
                     f"{self.mark('content', 'article', 'post', 'entry', 'main', 'story', 'text', 'page')}>")
            end = "</div>" if self.html[-1].startswith("<div") else "</section>"
        elif outer:
            end = ""
        else:
            self.put("<div>")
            end = "</div>"
        if self.chance(0.85):
            head = self.chance(0.15)
            self.put("<header>" if head else "")
            self.say(self.phrase(2, 12) + self.pick("", "."), True, self.pick("h1", "h1", "h1", "h2"))
            self.put("</header>" if head else "")
        if self.chance(0.15):
            self.social()
        self.paragraphs()
        if self.chance(0.2):
            self.pick_one(self.advert, self.side, self.social, self.notice)
            self.paragraphs()
        if self.chance(0.12):
            self.comments()
        self.put(end + outer)

    def pick_one(self, *parts) -> None:
        self.rng.choice(parts)()

    def build(self) -> tuple[str, list[tuple[str, bool]]]:
        self.put("<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>x</title><style>p{}</style>"
                 "<script>var a='</p>';</script></head><body>")
        wrap = self.chance(0.4)
        if wrap:
            self.put(f"<div{self.mark('page', 'wrapper', 'container', 'site') if self.chance(0.8) else ''}>")
        before = [p for p, k in ((self.notice, 0.25), (self.header, 0.5), (self.menu, 0.6), (self.advert, 0.35),
                                 (self.form, 0.2), (self.side, 0.15)) if self.chance(k)]
        after = [p for p, k in ((self.comments, 0.3), (self.side, 0.4), (self.advert, 0.25), (self.form, 0.2),
                                (self.social, 0.2), (self.footer, 0.8), (self.notice, 0.15)) if self.chance(k)]
        for part in before:
            part()
        self.article()
        for part in after:
            part()
        if wrap:
            self.put("</div>")
        self.put("</body></html>" if self.chance(0.8) else "")
        return "".join(self.html), self.blocks


def labelled_pages(n: int, seed: int = 11) -> list[tuple[str, list[tuple[str, bool]]]]:
    rng = random.Random(seed)
    return [_Page(rng).build() for _ in range(n)]
