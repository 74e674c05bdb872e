"""Pages with known main text, made for fitting and testing the extraction: many layouts, made-up languages, sloppy markup."""

from __future__ import annotations

import random

#: Stands at the start of each block of main text.
MARK = "\ue000"

# The letters of made-up languages, joined to syllables; the last has no blanks between words.
LANGUAGES = (
    "the and ing er on ti of sh ou re an in ha wh st".split(),
    "sch ei un ge ver ä ö ü ß lich ten er be die auf".split(),
    "é è eau oi ou que la tion ment les ç aux en il re".split(),
    "ción os la el que de ñ á ó en ras ado ien es do".split(),
    "при на ст ов ени ть по ка ла ра не ро ко ми да".split(),
    "λα τη ου και το σε μα ρι νο πα δε ξη φω ει ας".split(),
    "的 是 在 有 人 这 中 大 来 上 国 个 到 说 们".split(),
)
#: What tells a part of a page: words for its class, id or role, and its own tags.
NAMED = {
    "nav": ("nav navbar navigation menu main-menu breadcrumb pagination topNav site-nav", "nav ul"),
    "head": ("header site-header masthead topbar branding page_header", "header"),
    "foot": ("footer site-footer foot colophon page-footer bottom copyright", "footer"),
    "side": ("sidebar side aside right-rail widget-area related recommended related-posts trending teasers", "aside"),
    "ad": ("ad ads advert ad-box advertisement banner sponsored promo ad_slot_1 promotion", "aside"),
    "notice": ("cookie-notice cookies consent-banner gdpr notice alert popup modal announcement paywall notification", "dialog"),
    "form": ("subscribe newsletter signup search-box login contact-form newsletter-signup", "form"),
    "comment": ("comments comment-list commentlist replies responses discussion disqus_thread user-comments", ""),
    "share": ("share social sharing share-bar follow social-links toolbar", ""),
    "text": ("article post entry-content post-body story content main text article-body articleBody hentry prose page-content", "article main"),
}
PHRASES = {
    "foot": ("© 2024 {w} {w}. All rights reserved.", "Copyright {w} {w} GmbH", "© {w} · {s}", "&copy; {w}.example &middot; {s}", "Terms of use | Privacy policy | Imprint", "{s}"),
    "ad": ("Advertisement", "Sponsored: {s}", "{s}", "{s} {s}", "Buy now and get 20% off {w}!", "<a href='/x'>{s}</a>"),
    "notice": ("We use cookies to improve {w}. {s}", "{s} {s}", "By using this site you accept our cookies.", "Breaking: {s}", "<a href='#'>{w} {w}</a> {s}"),
    "form": ("Subscribe to our newsletter", "Sign up for {w} updates. {s}", "Log in", "Search", "Your e-mail address", "{s}"),
    "share": ("Share this", "Follow us on Facebook", "<a href='#'>Tweet</a>", "Print", "{w}"),
    "head": ("{w} {w}", "<a href='/'>{w}</a>", "{s}", "<h1>{w} {w}</h1>"),
}
MENU = "Home About Contact News Sports Archive Help Login Sitemap Next Previous".split()


class Maker(random.Random):
    """Makes parts of pages; each page has a language and habits of its own."""

    def begin(self) -> None:
        own = self.choice(LANGUAGES[:4] if self.random() < 0.7 else LANGUAGES)
        self.dense = own is LANGUAGES[-1]
        self.vocabulary = ["".join(self.choices(own, k=self.choice((1, 1, 2, 2, 3, 4)))) for _ in range(120)]
        self.tidy, self.closes = self.random() < 0.6, self.random() < 0.8
        #: how often parts are told by their tags, by words, or not at all
        self.tells = self.choice(((1, 0, 0), (0.7, 0.3, 0), (0.1, 0.9, 0), (0.3, 0.5, 0.2), (0, 0.5, 0.5)))
        self.junk = self.choice(("###", "%%%", "&amp;&amp;", "***")) if self.random() < 0.12 else ""
        self.article_told = True

    def word(self) -> str:
        return self.choice(self.vocabulary)

    def sentence(self) -> str:
        words = [self.word() + self.junk + ("," if self.random() < 0.08 else "") for _ in range(self.choice((1, 3, 5, 8, 12, 18)))]
        text = ("" if self.dense else " ").join(words)
        return text[:1].upper() + text[1:] + ("。" if self.dense else self.choice((".", ".", ".", ".", "!", "?")))

    def prose(self, most: int = 8) -> str:
        return " ".join(self.sentence() for _ in range(self.randint(1, most)))

    def phrase(self, kind: str) -> str:
        text = self.choice(PHRASES[kind])
        while "{w}" in text or "{s}" in text:
            text = text.replace("{w}", self.word().title(), 1).replace("{s}", self.sentence(), 1)
        return text

    def links(self, n: int | None = None, text: str = "") -> list[str]:
        said = lambda: text or (self.choice(MENU) if self.random() < 0.3 else " ".join(self.word() for _ in range(self.choice((1, 1, 1, 2, 4)))))
        return [f'<a href="/{i}">{said()}</a>' for i in range(n or self.randint(3, 9))]

    def listed(self, items: list[str]) -> str:
        how = self.random()
        if how < 0.6:
            tag = self.choice(("ul", "ul", "ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{x}</li>" if self.closes else f"<li>{x}" for x in items) + f"</{tag}>"
        return self.choice((" | ", " ", " &middot; ", "<br>")).join(items) if how < 0.8 else "".join(f"<div>{x}</div>" for x in items)

    def part(self, kind: str, inside: str, told: bool = False) -> str:
        """A part of the page, told by its tag, by a word, or not at all."""
        words, tags = NAMED[kind]
        tag, word, _ = self.tells
        r = self.random()
        if tags and r < tag:
            name = self.choice(tags.split())
            extra = f' class="{self.choice(words.split())}"' if self.random() < 0.3 else ""
            return f"<{name}{extra}>{inside}</{name}>"
        if r < tag + word or told:
            key = self.choice(("class", "class", "class", "id"))
            name = self.choice(("div", "div", "div", "section", "aside" if kind in ("ad", "side") else "div"))
            value = self.choice(words.split()) + ("" if key == "id" else self.choice(("", "", " clearfix", " x" + str(self.randint(1, 99)))))
            return f'<{name} {key}="{value}">{inside}</{name}>'
        opaque = f' class="{"".join(self.choices("qxzjkv", k=4))}"' if self.random() < 0.5 else ""
        return f"<div{opaque}>{inside}</div>"

    def boiler(self, kind: str) -> str:
        # what reads like main text is always told apart by its element
        if kind == "nav":
            return self.part(kind, self.listed(self.links()))
        if kind == "side":
            items = self.links() if self.random() < 0.5 else [f"<a href='#'>{self.word()}</a> {self.sentence()}" for _ in range(self.randint(1, 4))]
            return self.part(kind, self.choice((f"<h3>{self.word()}</h3>", "<h2>Related</h2>", "")) + self.listed(items) + (f"<p>{self.prose(3)}</p>" if self.random() < 0.4 else ""), told=True)
        if kind == "comment":
            heading = self.choice(("<h3>Comments</h3>", "<h2>3 comments</h2>", f"<h4>{self.word()}</h4>", ""))
            each = [self.choice((f"<b>{self.word().title()}</b> said:<p>{self.prose(4)}</p>", f"<p>{self.prose(5)}</p>", f"<cite>{self.word()}</cite><p>{self.prose(3)}<p>{self.prose(2)}</p><a href='#'>Reply</a>")) for _ in range(self.randint(1, 5))]
            if self.random() < 0.4:
                tag = self.choice(("ol", "ul"))
                return self.part(kind, heading + f"<{tag}{self.choice(('', ' class=thread'))}>" + "".join(f"<li>{x}" + "</li>" * self.closes for x in each) + f"</{tag}>", told=True)
            return self.part(kind, heading + "".join(self.choice(("<div>{}</div>", "<div class='comment'>{}</div>", "<article>{}</article>")).format(x) for x in each), told=True)
        if kind == "form":
            fields = '<label>E-mail</label><input name="q"><button type="submit">Send</button>'
            inside = self.phrase("form") + self.choice((fields, "<select><option>a<option>b</select>", "<textarea>x</textarea><button>OK</button>", "<input type=text>"))
            return f"<form action='/q'>{inside}</form>" if self.random() < 0.7 else self.part(kind, inside, told=True)
        inside = "".join(self.choice(("<p>{}</p>", "<div>{}</div>", "{} ", "<span>{}</span> ")).format(self.phrase(kind)) for _ in range(self.randint(1, 3)))
        if kind == "head" and self.random() < 0.5:
            inside += self.part("nav", self.listed(self.links()))
        if kind == "foot" and self.random() < 0.5:
            inside = self.listed(self.links()) + inside
        if kind == "notice" and self.random() < 0.5:
            inside += "<button>OK</button>"
        return self.part(kind, inside, told=True)

    def block(self) -> str:
        """A block or some of main text."""
        r, text = self.random(), MARK + self.prose()
        if r < 0.1:
            return f"<p><b>{text}<br>" if not self.tidy else f"<p><b>{text}</b></p>"
        if r < 0.62:
            if self.random() < 0.25:
                text += f' <a href="/l">{self.word()} {self.word()}</a> {self.sentence()}'
            return f"<p>{text}</p>" if self.closes else f"<p>{text}"
        if r < 0.7:
            return f"<p>{MARK}{self.sentence()}</p>"
        if r < 0.78:
            h = self.choice(("h2", "h3"))
            return f"<{h}>{MARK}{self.word().title()} {self.word()}</{h}>"
        if r < 0.86:
            tag = self.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{MARK}{self.choice((self.prose(2), self.word()))}" + ("</li>" if self.closes else "") for _ in range(self.randint(1, 5))) + f"</{tag}>"
        if r < 0.9:
            return f"<blockquote>{self.choice(('<p>', ''))}{text}</blockquote>"
        if r < 0.93:
            return f"<pre>{MARK}{self.word()} = {self.word()}\n  ({self.randint(0, 99)})</pre>"
        if r < 0.96:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{MARK}{self.choice((self.word(), str(self.randint(1, 999))))}</td>" for _ in range(3)) + "</tr>" for _ in range(self.randint(1, 4))) + "</table>"
        if r < 0.98:
            return f"<figure><img src='a.png' alt='x'><figcaption>{MARK}{self.sentence()}</figcaption></figure>"
        return f"<div>{text}</div>"

    def article(self) -> str:
        heading = f"<h1>{MARK}{self.title}</h1>"
        if self.random() < 0.2:
            heading = f"<header>{heading}</header>"
        n = self.choice((1, 2, 3, 5, 8, 12, 20, 30))
        blocks = [self.block() for _ in range(n)]
        for kind in ("ad", "share", "form", "notice", "side", "nav"):
            if self.random() < (0.25 if kind == "ad" else 0.1):
                blocks.insert(self.randint(0, len(blocks)), self.boiler(kind))
        if self.random() < 0.1:
            blocks.append(self.boiler("comment"))
        inside = (heading if self.random() < 0.9 else "") + "".join(blocks)
        told = self.random() < 0.85
        inside = self.part("text", inside, told=told)
        for _ in range(self.choice((0, 0, 0, 1, 2))):
            inside = self.choice(("<div>{}</div>", "<main>{}</main>", "<div class='content'>{}</div>", "<section>{}</section>", "<div id='main'>{}</div>")).format(inside)
        return inside

    def page(self) -> str:
        self.begin()
        self.title = (self.sentence() if self.random() < 0.7 else self.word()).strip()
        maybe = lambda kind, p: [self.boiler(kind)] if self.random() < p else []
        before = maybe("notice", 0.25) + maybe("head", 0.5) + maybe("nav", 0.7) + maybe("ad", 0.4) + maybe("form", 0.15)
        body = [self.article()] if self.random() < 0.96 else []
        around = maybe("side", 0.4) + maybe("ad", 0.15)
        body = around + body if self.random() < 0.3 else body + around
        after = maybe("share", 0.2) + maybe("comment", 0.35) + maybe("side", 0.2) + maybe("form", 0.2) + maybe("ad", 0.15) + maybe("foot", 0.8) + maybe("notice", 0.15)
        if self.random() < 0.3:
            self.shuffle(after)
        inner = "".join(body)
        if self.random() < 0.3:
            inner = self.choice(("<div id='content'>{}</div>", "<div class='wrapper'>{}</div>", "<table><tr><td>{}</td></tr></table>", "<div class='main'>{}</div>", "<div class='container'>{}</div>")).format(inner)
        noise = self.choice(("<!-- ad 1 -->", '<script>var t="</p>";</script>', "<style>p{color:red}</style>", "", ""))
        whole = "".join(before) + noise + inner + "".join(after)
        if self.random() < 0.3:
            whole = self.choice(("<div id='page'>{}</div>", "<div class='site'>{}</div>", "<form method='post'>{}</form>", "<div class='page-wrapper'>{}</div>")).format(whole)
        site = self.choice(("", " - " + self.word().title(), " | " + self.word()))
        head = f'<!DOCTYPE html><html lang="x"><head><meta charset="utf-8"><title>{self.title}{site}</title><style>p{{margin:0}}</style></head><body{self.choice(("", " class=\"single post page\""))}>'
        return head + whole + ("</body></html>" if self.closes else "")


def made_pages(n: int, seed: int) -> list[str]:
    """Pages whose blocks of main text begin with MARK."""
    maker = Maker(seed)
    return [maker.page() for _ in range(n)]
