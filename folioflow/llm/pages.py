"""Labelled pages to train on: layouts drawn at random, each block known to be of the article or not."""

from __future__ import annotations

import html
import random

# How sites name the parts of a page, and what stands in them.
ARTICLE = ['article', 'article class="post"', 'main', 'main id="main"', 'div id="content"', 'div class="entry-content"', 'div class="article-body"', 'section class="story"', 'div class="post-content"', 'div itemprop="articleBody"', 'td class="content"', 'div class="main-text"']
OUTER = ['div id="page"', 'div class="wrapper"', 'div class="container"', 'main', 'div', 'section', 'div class="row"']
MENU = ['nav', 'nav class="menu"', 'div class="navbar"', 'div id="menu"', 'div class="nav"', 'div class="breadcrumb"', 'ul class="nav"', 'div class="toolbar"', 'nav role="navigation"']
HEADER = ['header', 'div id="header"', 'header class="site-header"', 'div class="masthead"', 'div class="topbar"', 'div role="banner"']
FOOTER = ['footer', 'div id="footer"', 'footer class="site-footer"', 'div class="footer"', 'div class="copyright"', 'div role="contentinfo"']
SIDE = ['aside', 'div class="sidebar"', 'aside class="related"', 'div id="sidebar"', 'div class="widget"', 'div class="related-posts"', 'section class="recommended"', 'div role="complementary"', 'div class="tags"', 'div class="author-box"']
ADVERT = ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div class="sponsored"', 'div class="promo"', 'div id="banner"', 'aside class="ad"', 'p class="ad"', 'section class="sponsor"', 'div class="ad-slot"']
NOTICE = ['div class="cookie"', 'div class="cookie-notice"', 'div id="gdpr"', 'div class="alert"', 'div class="notice"', 'div class="popup"', 'div class="consent"', 'div class="paywall"', 'div role="alert"', 'div class="modal"', 'div class="message"']
FORM = ['form', 'form class="search"', 'div class="newsletter"', 'form id="signup"', 'div class="subscribe"', 'form class="login"', 'fieldset']
SHARE = ['div class="share"', 'ul class="social"', 'div class="buttons"', 'div class="pagination"', 'div class="meta"', 'div class="byline"']
COMMENTS = ['div class="comments"', 'section id="comments"', 'ol class="comment-list"', 'div id="disqus"', 'div class="discussion"', 'section class="replies"', 'div class="responses"', 'div class="reviews"']
SHORT = ["Home", "About", "Contact", "Login", "Sign in", "Share", "Tweet", "Read more", "Next", "Previous", "Reply", "Menu", "Search", "Subscribe", "Privacy", "Terms", "Follow us", "Print", "Accueil", "Startseite", "Inicio", "Kontakt"]
NOTICES = ["We use cookies to improve your experience.", "Accept all", "By continuing you agree to our privacy policy.", "Subscribe to our newsletter", "Your e-mail address", "Please enable JavaScript", "Sign up for free"]
RIGHTS = ["© {} All rights reserved.", "Copyright 2020 {}", "&copy; {} &middot; {}", "© {} | Privacy | Terms", "&copy; 2019 {}. {}"]
SYLLABLES = "an the er in ti re st on ed ha le de que la en ou é ch ung ge ver lich ein os ci ar do ra mi".split()


class Writer:
    """Pages from a seed. ``page()`` gives the source and, by the number that each block's text ends in, its label."""

    def __init__(self, seed: int):
        self.draw = random.Random(seed)
        self.labels: dict[str, int] = {}

    def words(self, low: int, high: int) -> str:
        n = self.draw.randint(low, high)
        return " ".join("".join(self.draw.choice(SYLLABLES) for _ in range(self.draw.randint(1, 4))) for _ in range(n))

    def prose(self, high: int) -> str:
        return " ".join(self.words(2, 14).capitalize() + self.draw.choice([".", ".", ".", "!", "?", ", " + self.words(1, 5) + "."]) for _ in range(self.draw.randint(1, high)))

    def say(self, text: str, label: int) -> str:
        """A text with a mark by which its block is known again."""
        mark = f"q{len(self.labels)}q"
        self.labels[mark] = label
        return f"{html.escape(text, quote=False) if '&' not in text else text} {mark}"

    def chance(self, p: float) -> bool:
        return self.draw.random() < p

    def wrap(self, element: str, inside: str) -> str:
        return f"<{element}>{inside}</{element.split()[0]}>"

    def links(self, label: int = 0) -> str:
        n, listed = self.draw.randint(1, 8), self.chance(0.7)
        out = []
        for _ in range(n):
            text = self.draw.choice(SHORT) if self.chance(0.4) else self.words(1, 6)
            link = f'<a href="/{self.draw.randint(1, 99)}">{self.say(text, label)}</a>'
            out.append(f"<li>{link}</li>" if listed else f"<p>{link}</p>" if self.chance(0.5) else f"<div>{link}</div>")
        return f"<ul>{''.join(out)}</ul>" if listed else "".join(out)

    def aside(self, element: str, texts: list[str] | None = None) -> str:
        """Something that isn't of the article: links, prose or set phrases."""
        kind = self.draw.random()
        text = self.draw.choice(texts) if texts and kind < 0.6 else self.prose(3)
        if kind > 0.75:
            return self.wrap(element, self.links())
        bare = self.say(text, 0)
        heading = self.wrap(self.draw.choice(["h3", "h4", "div"]), self.say(self.words(1, 3), 0)) if self.chance(0.25) else ""
        return self.wrap(element, heading + (bare if self.chance(0.6) else self.wrap("p", bare)))

    def comments(self) -> str:
        out = [self.wrap("h3", self.say("Comments", 0))] if self.chance(0.5) else []
        for _ in range(self.draw.randint(1, 5)):
            name = self.wrap(self.draw.choice(["div", "span", "h4", "cite"]), self.words(1, 2)) if self.chance(0.4) else ""
            text = self.say(self.prose(4), 0)
            out.append(self.wrap(self.draw.choice(["li", "div", 'div class="comment"', 'article class="comment"', "p"]), text if not name else f"{text}"))
        return self.wrap(self.draw.choice(COMMENTS), "".join(out))

    def footer(self) -> str:
        text = self.draw.choice(RIGHTS).replace("{}", self.words(1, 6).replace("&", ""))
        return self.wrap(self.draw.choice(FOOTER), (self.links() if self.chance(0.3) else "") + (self.say(text, 0) if self.chance(0.6) else self.wrap("p", self.say(text, 0))))

    def body(self) -> str:
        out = []
        if self.chance(0.85):
            heading = self.wrap(self.draw.choice(["h1", "h1", "h2"]), self.say(self.words(2, 12).capitalize(), 1))
            out.append(heading)
            if self.chance(0.15):
                out.append(self.wrap(self.draw.choice(SHARE), self.say(self.words(1, 5), 0)))
        for _ in range(self.draw.randint(1, 14)):
            kind = self.draw.random()
            if kind < 0.62:
                text = self.say(self.prose(self.draw.choice([1, 2, 6, 15])), 1)
                style = self.draw.random()
                out.append(f"<p><b>{text}<br>" if style < 0.15 else f"<p>{text}" if style < 0.25 else f"<p>{text}</p>" if style < 0.85 else f'<div>{text}</div>' if style < 0.92 else f'<p><a href="/x">{self.words(1, 3)}</a> {text}</p>')
            elif kind < 0.70:
                out.append(self.wrap(self.draw.choice(["h2", "h3"]), self.say(self.words(1, 6).capitalize(), 1)))
            elif kind < 0.76:
                out.append("<ul>" + "".join(f"<li>{self.say(self.words(1, 10), 1)}</li>" for _ in range(self.draw.randint(1, 5))) + "</ul>")
            elif kind < 0.80:
                out.append(self.wrap("blockquote", self.say(self.prose(3), 1) if self.chance(0.5) else self.wrap("p", self.say(self.prose(3), 1))))
            elif kind < 0.83:
                out.append("<table>" + "".join(f"<tr><td>{self.say(self.words(1, 3), 1)}</td><td>{self.say(self.words(1, 3), 1)}</td></tr>" for _ in range(self.draw.randint(1, 3))) + "</table>")
            elif kind < 0.86:
                out.append(self.wrap(self.draw.choice(["pre", "figure", "section"]), self.wrap("p", self.say(self.prose(2), 1))))
            elif kind < 0.92:
                out.append(self.aside(self.draw.choice(ADVERT)))
            elif kind < 0.95:
                out.append(self.aside(self.draw.choice(SIDE)))
            elif kind < 0.975:
                out.append(self.aside(self.draw.choice(NOTICE + FORM), NOTICES))
            else:
                out.append(self.wrap(self.draw.choice(SHARE), self.links()))
        if self.chance(0.15):
            out.append(self.comments())
        return "".join(out)

    def page(self) -> tuple[str, dict[str, int]]:
        self.labels = {}
        top = []
        if self.chance(0.5):
            top.append(self.wrap(self.draw.choice(HEADER), (self.wrap("h1", self.say(self.words(1, 3), 0)) if self.chance(0.3) else self.say(self.words(1, 4), 0)) + (self.wrap(self.draw.choice(MENU), self.links()) if self.chance(0.5) else "")))
        if self.chance(0.75):
            top.append(self.wrap(self.draw.choice(MENU), self.links()))
        for p, kinds, texts in ((0.3, NOTICE, NOTICES), (0.5, ADVERT, None), (0.15, SIDE, None), (0.15, FORM, NOTICES)):
            if self.chance(p):
                top.append(self.aside(self.draw.choice(kinds), texts))
        element = self.draw.choice(ARTICLE) if self.chance(0.92) else "div"
        middle = self.wrap(element, self.body())
        if element.startswith("td"):
            middle = f"<table><tr>{middle}</tr></table>"
        end = []
        for p, kinds, texts in ((0.3, SIDE, None), (0.2, ADVERT, None), (0.15, FORM, NOTICES), (0.1, NOTICE, NOTICES), (0.15, SHARE, None)):
            if self.chance(p):
                end.append(self.aside(self.draw.choice(kinds), texts))
        if self.chance(0.3):
            end.append(self.comments())
        if self.chance(0.8):
            end.append(self.footer())
        inside = "".join(top) + middle + "".join(end)
        if self.chance(0.4):
            inside = self.wrap(self.draw.choice(OUTER), inside)
        page = f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title><script>var a='<p>';</script></head><body>{inside}</body></html>"
        if self.chance(0.15):
            page = page[: int(len(page) * self.draw.uniform(0.5, 1))]
        return page, self.labels
