"""Labelled pages for training the extractor: made from a seed, in many layouts, with invented words."""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Names that pages give to the parts around an article, by part.
PARTS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav toolbar tabs pagination pager links categories",
    "header": "header masthead branding topbar siteheader hero logo tagline",
    "footer": "footer copyright legal bottom colophon imprint sitefooter credits",
    "sidebar": "sidebar aside widget rail related recommended popular trending tags archive secondary teaser more",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay banner paywall warning message disclaimer",
    "advert": "ad ads advert advertisement sponsored sponsor promo promotion adsense outbrain taboola commercial",
    "form": "form login signup search subscribe newsletter contact register searchbox",
    "comments": "comment comments reply replies disqus discussion respond feedback review reviews commentlist thread",
    "share": "share sharing social follow buttons byline meta metadata",
}
#: Names that pages give to the article and its parts.
ARTICLE = "content article post entry story body text main page blog news articlebody postcontent entrycontent maincontent prose"
#: Elements that stand for a part by themselves.
ELEMENTS = {"nav": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}


class PageMaker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        out = ["".join(self.r.choice("aeiou" if k % 2 else "bcdfghlmnprstvé") for k in range(self.r.randint(2, 9))) for _ in range(n)]
        if self.r.random() < 0.06:
            out = [w.upper() + "!!" for w in out]
        elif self.r.random() < 0.06:
            out = [w + self.r.choice(["%%%", "$$$", "***", "&amp;&amp;&amp;"]) for w in out]
        for k in range(5, n, 9):
            out[k] += self.r.choice([",", ",", ".", " |"])
        return " ".join(out).capitalize()

    def sentence(self, low: int, high: int) -> str:
        return self.words(low, high) + self.r.choice([".", ".", ".", "?", ""])

    def name(self, words: str) -> str:
        base = self.r.choice(words.split())
        return self.r.choice([base, base, "site-" + base, base + "-box", base + "_1", "js-" + base, base + " clearfix"])

    def article_block(self) -> str:
        """One to a few leaf blocks of an article."""
        r, kind = self.r, self.r.random()
        body = self.sentence(*r.choice([(1, 4), (3, 12), (10, 40), (30, 120)]))
        if r.random() < 0.2:
            body = body.replace(" ", f' <a href="/{r.randint(1, 99)}">', 1) + "</a>"
        if kind < 0.62:
            return f"<p>{body}" + ("</p>" if r.random() < 0.8 else "")
        if kind < 0.7:
            return f"<p><b>{body}<br><p>{self.sentence(5, 60)}</p>"
        if kind < 0.78:
            return f"<h{(h := r.randint(2, 4))}>{self.words(1, 8)}</h{h}>"
        if kind < 0.84:
            return "<ul>" + "".join(f"<li>{self.sentence(2, 15)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.88:
            return f"<blockquote>{body}</blockquote>"
        if kind < 0.91:
            return f"<pre>{self.words(3, 30)}</pre>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 5)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if kind < 0.96:
            return f"<figure><img src='x'><figcaption>{self.sentence(3, 12)}</figcaption></figure>"
        return f"<div>{body}</div>"

    def other_block(self, part: str) -> str:
        r = self.r
        link = lambda low, high: f'<a href="/{r.randint(1, 999)}">{self.words(low, high)}</a>'
        if part == "nav":
            inner = r.choice([
                lambda: "<ul>" + "".join(f"<li>{link(1, 2)}</li>" for _ in range(r.randint(3, 8))) + "</ul>",
                lambda: " | ".join(link(1, 2) for _ in range(r.randint(3, 8))),
                lambda: "".join(f"<div>{link(1, 3)}</div>" for _ in range(r.randint(2, 6))),
            ])()
        elif part == "footer":
            inner = r.choice(["&copy; 2024 ", "", "© "]) + f"{self.words(1, 4)} &middot; {self.sentence(2, 25)}" + r.choice(["", link(1, 2)])
        elif part == "header":
            inner = r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.words(1, 4)}</div>"]) + r.choice(["", f"<p>{self.words(3, 9)}</p>"])
        elif part == "form":
            inner = f"<label>{self.words(1, 3)}</label><input><select><option>{self.words(1, 2)}</option></select><button>{self.words(1, 2)}</button>" + r.choice(["", f"<p>{self.sentence(4, 20)}</p>"])
        elif part == "comments":
            who = lambda: f"<b>{self.words(1, 2)}</b>"
            inner = r.choice(["", f"<h3>{self.words(1, 3)}</h3>"]) + "".join(
                r.choice([f"<div class='{self.name(PARTS['comments'])}'>{who()}<p>{self.sentence(3, 60)}</p></div>", f"<li>{who()}<p>{self.sentence(3, 60)}</p></li>", f"<p>{self.sentence(3, 60)}</p>"])
                for _ in range(r.randint(1, 5)))
        elif part == "sidebar":
            inner = f"<h3>{self.words(1, 3)}</h3>" + "".join(r.choice([f"<li>{link(2, 8)}</li>", f"<p>{self.sentence(3, 25)}</p>"]) for _ in range(r.randint(1, 5)))
        elif part == "share":
            inner = r.choice([" ".join(link(1, 1) for _ in range(3)), self.words(2, 6)])
        else:
            inner = r.choice([self.sentence(2, 35), f"<p>{self.sentence(3, 35)}</p>", f"<p>{self.sentence(3, 15)}</p>{link(1, 3)}"])
        if part == "form":
            return f"<form class='{self.name(PARTS[part])}'>{inner}</form>" if r.random() < 0.8 else f"<form>{inner}</form>"
        if part in ELEMENTS and r.random() < 0.6:
            return f"<{ELEMENTS[part]}>{inner}</{ELEMENTS[part]}>"
        tag, key = r.choice(["div", "div", "div", "section", "ul"]), r.choice(["class", "class", "id"])
        return f'<{tag} {key}="{self.name(PARTS[part])}">{inner}</{tag}>'

    def page(self) -> str:
        """Html; each part begins with a NUL and its label."""
        r = self.r
        mark = lambda html, label: f"\x00{label}{html}"
        parts = [*PARTS]
        before = [self.other_block(p) for p in r.sample(parts, r.randint(0, 4))]
        after = [self.other_block(p) for p in r.sample(parts, r.randint(0, 4))]
        if r.random() < 0.5:
            after.append(self.other_block("comments"))
        if r.random() < 0.5:
            after.append(self.other_block("footer"))
        body = [mark(f"<h1>{self.words(2, 12)}</h1>", 1)] if r.random() < 0.8 else []
        for _ in range(r.choice([1, 2, 5, 10, 20])):
            body.append(mark(self.article_block(), 1))
            if r.random() < 0.2:
                body.append(mark(self.other_block(r.choice(["advert", "sidebar", "share", "notice", "form", "comments", "nav"])), 0))
        inner = "".join(body)
        layout = r.random()
        if layout < 0.45:
            wrap = f"<article>{inner}</article>"
        elif layout < 0.6:
            wrap = f"<main>{inner}</main>"
        elif layout < 0.9:
            wrap = f'<div {r.choice(["class", "id"])}="{self.name(ARTICLE)}">{inner}</div>'
        else:
            wrap = inner
        if r.random() < 0.3:
            wrap = f"<div class='{r.choice(['container', 'wrapper', 'row', 'layout', 'col'])}'>{wrap}</div>"
        if r.random() < 0.1:  # a bare page
            return "".join(body) if r.random() < 0.5 else mark(self.sentence(1, 60), 1)
        html = "".join(mark(x, 0) for x in before) + wrap + "".join(mark(x, 0) for x in after)
        return "<html><body>" + html + ("</body></html>" if r.random() < 0.9 else "")


def pages(n: int, seed: int = 11) -> Iterator[str]:
    """Html in which a NUL and a digit before a part give the label (1: article) of the text after it."""
    maker = PageMaker(seed)
    for _ in range(n):
        yield maker.page()
