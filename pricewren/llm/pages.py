"""Web pages written from given texts, with the texts of their article's blocks known: labelled pages to train on.

A page is put together from parts that pages have: notices, headers, menus, side columns, adverts, forms, reader comments
and footers, before, after and inside the article. Each part comes in several ways of marking it up, with or without
telling elements and class names, and with end tags left out at times.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from random import Random

LABELS = {
    "menu": ("nav", "navbar", "main-nav", "menu", "site-nav", "topnav", "menu-main"), "header": ("header", "site-header", "masthead", "page-header", "top"), "footer": ("footer", "site-footer", "colophon", "page-footer", "bottom"),
    "side": ("sidebar", "side", "rail", "widget", "aside", "col-right widget-area"), "more": ("related", "related-posts", "recommended", "more-stories", "read-more", "popular"), "ad": ("ad", "ads", "advert", "ad-slot", "advertisement", "sponsored", "ad-container", "promo sponsored"),
    "notice": ("cookie-notice", "cookie-banner", "consent", "notice", "gdpr", "alert", "popup"), "form": ("newsletter", "subscribe", "search-form", "signup", "login", "contact-form"), "comment": ("comments", "comment-list", "discussion", "responses", "reader-comments"),
    "share": ("share", "social", "share-buttons", "sharing"), "main": ("content", "article", "post", "entry-content", "story", "article-body", "main", "post-content", "text"), "wrap": ("container", "wrapper", "page", "row", "col-8", "inner", "site", "grid"),
}
SAID = {
    "notice": ("We use cookies to improve your experience.", "This site uses cookies. By continuing you accept our privacy policy.", "Usamos cookies para mejorar la experiencia.", "Wir verwenden Cookies.", "Ce site utilise des cookies.", "Please enable JavaScript in your browser."),
    "rights": ("© 2024 {w}. All rights reserved.", "Copyright {w} Inc.", "{w} · Terms · Privacy", "Todos los derechos reservados {w}", "Alle Rechte vorbehalten", "© {w} &middot; {s}", "Tous droits réservés {w}"),
    "menu": ("Home", "About", "Contact", "News", "Sports", "Inicio", "Contacto", "Startseite", "Accueil", "Login", "Sign in", "Archive", "Shop", "Help", "Menu", "Search"),
    "talk": ("Comments", "3 comments", "Leave a comment", "Comentarios", "Kommentare", "Commentaires", "Discussion", "Reader comments", "12 Responses"), "form": ("Subscribe to our newsletter", "Your email address", "Name", "Password", "Sign up", "Search", "Suscríbete", "Submit", "Log in"),
    "more": ("Related articles", "Read more", "You may also like", "Most popular", "Trending", "Artículos relacionados", "Mehr zum Thema", "À lire aussi", "Recent posts"), "share": ("Share", "Tweet", "Share this article", "Facebook", "Compartir", "Teilen", "Partager", "Email", "Print"),
    "ad": ("Advertisement", "Sponsored", "Publicidad", "Anzeige", "Publicité", "Buy now"), "reply": ("Reply", "Responder", "Antworten", "Report", "Like (3)"),
}


class Writer:
    def __init__(self, texts: list[str], rng: Random):
        self.rng = rng
        self.texts = [t for t in texts if t]
        self.words = [w for t in self.texts[:400] for w in t.split(" ")[:60] if w] or ["lorem", "ipsum", "dolor", "sit", "amet,", "elit.", "sed", "do", "magna", "ut", "enim", "ad", "quis", "nisi."]
        self.wanted: list[str] = []

    def one(self, kind: str) -> str:
        return self.rng.choice(SAID[kind]).replace("{w}", html.escape(self.rng.choice(self.words))).replace("{s}", self.sentence())

    def plain(self, least: int, most: int) -> str:
        got = " ".join(self.rng.choice(self.words) for _ in range(self.rng.randint(least, most)))
        return got[:1].upper() + got[1:]

    def sentence(self) -> str:
        got = self.plain(3, 16)
        return html.escape(got.rstrip(".,") + ".")

    def named(self, kind: str, chance: float = 0.75) -> str:
        """A class or id that tells what an element holds, or nothing."""
        r = self.rng
        if r.random() > chance:
            return "" if r.random() < 0.6 else f' class="{r.choice(("box", "c1", "x-12", "block", "mt-4", "section"))}"'
        return f' {r.choice(("class", "class", "id"))}="{r.choice(LABELS[kind])}"'

    def box(self, kind: str, tag: str, inner: str, chance: float = 0.75) -> str:
        """The element that is made for such things, or a div."""
        return f"<{tag}{self.named(kind, chance / 2)}>{inner}</{tag}>" if self.rng.random() < 0.5 else f"<div{self.named(kind, chance)}>{inner}</div>"

    def link(self, text: str) -> str:
        return f'<a href="/{self.rng.randrange(999)}">{text}</a>'

    def links(self, n: int, words: tuple[int, int] = (1, 2)) -> str:
        r, style = self.rng, self.rng.random()
        said = [self.one("menu") if r.random() < 0.5 else html.escape(self.plain(*words)) for _ in range(n)]
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{self.link(x)}{'</li>' if r.random() < 0.9 else ''}" for x in said) + "</ul>"
        return (" | " if style < 0.8 else " ").join(self.link(x) for x in said) if style < 0.9 else "".join(f"<div>{self.link(x)}</div>" for x in said)

    def menu(self) -> str:
        return self.box("menu", "nav", self.links(self.rng.randint(2, 9)))

    def notice(self) -> str:
        return self.box("notice", "section", f"<p>{self.one('notice')}{' ' + self.sentence() if self.rng.random() < 0.5 else ''}</p>" + ("<button>OK</button>" if self.rng.random() < 0.5 else ""))

    def head(self) -> str:
        r = self.rng
        name = f"<div class=\"logo\">{html.escape(self.plain(1, 2))}</div>" if r.random() < 0.5 else f"<{'h1' if r.random() < 0.2 else 'p'}>{html.escape(self.plain(1, 3))}</{'h1' if False else 'p'}>"
        return self.box("header", "header", name + (f"<p>{self.sentence()}</p>" if r.random() < 0.4 else "") + (self.menu() if r.random() < 0.6 else "") + (self.form() if r.random() < 0.2 else ""), 0.85)

    def form(self) -> str:
        r = self.rng
        inner = f"<p>{self.one('form')}</p>" + (f"<label>{self.one('form')}</label>" if r.random() < 0.5 else "") + '<input name="q">' + f"<button>{self.one('form')}</button>" + (f"<p>{self.sentence()}</p>" if r.random() < 0.3 else "")
        return self.box("form", "form", inner, 0.9)

    def advert(self) -> str:
        r = self.rng
        inner = (f"<p>{self.one('ad')}</p>" if r.random() < 0.3 else "") + (self.sentence() if r.random() < 0.6 else f"<p>{self.sentence()} {self.sentence()}</p>" if r.random() < 0.7 else self.link(html.escape(self.plain(2, 6))))
        return f"<div{self.named('ad', 1)}>{inner}</div>" if r.random() < 0.8 else f"<aside{self.named('ad', 0.8)}>{inner}</aside>"

    def share(self) -> str:
        return f"<div{self.named('share', 0.9)}>{' '.join(self.link(self.one('share')) for _ in range(self.rng.randint(1, 4)))}</div>"

    def more(self) -> str:
        heading = f"<h{self.rng.randint(2, 4)}>{self.one('more')}</h4>".replace("</h4>", "</h3>") if self.rng.random() < 0.7 else ""
        return self.box("more", "aside", heading.replace("<h2>", "<h3>").replace("<h4>", "<h3>") + self.links(self.rng.randint(2, 5), (3, 9)), 0.85)

    def side(self) -> str:
        r = self.rng
        parts = [r.choice((self.more, self.advert, self.menu, self.form, lambda: f"<h3>{self.one('more')}</h3><p>{self.sentence()} {self.sentence()}</p>")) for _ in range(r.randint(1, 3))]
        return self.box("side", "aside", "".join(p() for p in parts), 0.9)

    def comments(self) -> str:
        r = self.rng
        tag, out = r.choice(("div", "li", "article")), []
        for _ in range(r.randint(1, 5)):
            said = " ".join(self.sentence() for _ in range(r.randint(1, 4)))
            name = f"<{r.choice(('b', 'span', 'strong'))}>{html.escape(self.plain(1, 2))}</b>" if r.random() < 0.6 else f"<p>{html.escape(self.plain(1, 2))} says:</p>"
            out.append(f"<{tag}{self.named('comment', 0.7) if r.random() < 0.5 else ''}>{name}<p>{said}</p>{self.link(self.one('reply')) if r.random() < 0.4 else ''}</{tag}>")
        heading = f"<h3>{self.one('talk')}</h3>" if r.random() < 0.7 else ""
        inner = heading + (f"<ol>{''.join(out)}</ol>" if tag == "li" else "".join(out)) + (self.form() if r.random() < 0.3 else "")
        return f"<{r.choice(('section', 'div', 'div', 'aside'))}{self.named('comment', 1 if not heading else 0.85)}>{inner}</section>".replace("</section>", "") + "</div></section></aside>" if r.random() < 0.1 else self.box("comment", "section", inner, 1.0 if not heading else 0.9)

    def foot(self) -> str:
        r = self.rng
        return self.box("footer", "footer", (f"<p>{self.one('rights')}</p>" if r.random() < 0.5 else self.one("rights")) + (self.links(r.randint(2, 5)) if r.random() < 0.5 else "") + (f"<p>{self.sentence()}</p>" if r.random() < 0.3 else ""), 0.85)

    def block(self, text: str, tag: str, ended: bool = True) -> str:
        """A block of the article, with links and marks inside it at times."""
        r = self.rng
        self.wanted.append(text)
        words = [html.escape(w) for w in text.split(" ")]
        for mark, chance in (('<a href="/x">{}</a>', 0.2), ("<b>{}</b>", 0.15), ("<em>{}</em>", 0.1), ("<span>{}</span>", 0.05)):
            if len(words) > 3 and r.random() < chance:
                i = r.randrange(len(words))
                words[i] = mark.format(words[i])
        joined = r.choice((" ", " ", " ", "\n")).join(words)
        return f"<{tag}>{'<b>' if not ended and r.random() < 0.3 else ''}{joined}{f'</{tag}>' if ended else ''}"

    def paragraph(self) -> str:
        r = self.rng
        if self.texts and r.random() < 0.7:
            return r.choice(self.texts)
        return " ".join(html.unescape(self.sentence()) for _ in range(r.randint(1, 7)))

    def article(self) -> str:
        r = self.rng
        tag = r.choice(("p", "p", "p", "p", "p", "div"))
        out = []
        if r.random() < 0.85:
            title = self.block(self.plain(2, 12), r.choice(("h1", "h1", "h1", "h2")))
            out.append(f"<header{self.named('header', 0.3)}>{title}</header>" if r.random() < 0.15 else title)
        for _ in range(r.choice((1, 1, 2, 3, 4, 5, 6, 8, 12))):
            x = r.random()
            if x < 0.06:
                out.append(self.block(self.plain(1, 7), r.choice(("h2", "h3"))))
            elif x < 0.11:
                out.append(r.choice(("<ul>{}</ul>", "<ol>{}</ol>")).format("".join(self.block(self.plain(2, 14), "li") for _ in range(r.randint(2, 5)))))
            elif x < 0.14:
                out.append(f"<blockquote>{self.block(self.paragraph(), 'p')}</blockquote>")
            elif x < 0.16:
                out.append(f"<table><tr>{self.block(self.plain(1, 5), 'td')}{self.block(self.plain(1, 5), 'td')}</tr></table>")
            elif x < 0.18:
                out.append(f'<figure><img src="x.png">{self.block(self.plain(3, 12), "figcaption")}</figure>')
            elif x < 0.20:
                out.append(self.block(self.plain(3, 20), "pre"))
            else:
                out.append(self.block(self.paragraph(), tag, tag != "p" or r.random() < 0.85))
            if r.random() < 0.10:
                out.append(r.choice((self.advert, self.advert, self.share, self.more, self.form, self.notice))())
        for part, chance in ((self.share, 0.12), (self.more, 0.12), (self.comments, 0.12), (self.form, 0.08)):
            if r.random() < chance:
                out.append(part())
        return "".join(out)

    def page(self) -> str:
        r = self.rng
        before = [part() for part, chance in ((self.notice, 0.3), (self.head, 0.6), (self.menu, 0.6), (self.advert, 0.4), (self.side, 0.15)) if r.random() < chance]
        if r.random() < 0.3:
            r.shuffle(before)
        inner = self.article()
        kind = r.random()
        if kind < 0.35:
            body = f"<article{self.named('main', 0.3)}>{inner}</article>"
        elif kind < 0.45:
            body = f"<main>{inner}</main>" if r.random() < 0.5 else f"<main><article>{inner}</article></main>"
        elif kind < 0.9:
            body = f"<{r.choice(('div', 'div', 'div', 'section'))}{self.named('main', 0.7)}>{inner}</div>"
        else:
            body = f"<table><tr><td{self.named('main', 0.5)}>{inner}</td></tr></table>"
        after = [part() for part, chance in ((self.share, 0.15), (self.comments, 0.4), (self.side, 0.35), (self.more, 0.25), (self.form, 0.15), (self.advert, 0.2), (self.foot, 0.75), (self.notice, 0.1)) if r.random() < chance]
        if r.random() < 0.3:
            r.shuffle(after)
        whole = "".join(before) + body + "".join(after)
        for _ in range(r.choice((0, 0, 1, 2))):
            whole = f"<div{self.named('wrap', 0.6)}>{whole}</div>"
        head = f"<!DOCTYPE html><html><head><title>{self.sentence()}</title><style>p{{}}</style><script>var a = \"<p>{self.sentence()}</p>\";</script></head>"
        return f"{head}<body>{whole}{'</body></html>' if r.random() < 0.8 else ''}"


def made_pages(texts: list[str], count: int, seed: int) -> Iterator[tuple[str, list[str]]]:
    """``count`` pages, each with the texts of its article's blocks in order."""
    rng = Random(seed)
    texts = [" ".join(t.split()) for t in texts if len(t) <= 1500]
    for _ in range(count):
        writer = Writer(rng.sample(texts, min(60, len(texts))), rng)
        page = writer.page()
        yield page, writer.wanted
