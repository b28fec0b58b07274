"""Made-up labelled pages to train the extractor on: what is kept is known by construction."""

from __future__ import annotations

import random
import re

SYLLABLES = ["ba", "ren", "to", "lis", "mo", "ka", "thed", "is", "ur", "ven", "pol", "ce", "an", "dri", "é", "ung", "ción", "sa", "wer", "ig", "ol", "ment"]
CONTENT = ["content", "main-content", "post", "entry-content", "article-body", "story", "post-body", "text", "blog-post", "page-content"]
DROPPED = {
    "ad": ["ad", "ads", "advert", "ad-slot", "banner", "sponsored", "promo", "advertisement", "ad-container"],
    "notice": ["cookie", "cookie-notice", "notice", "alert", "gdpr-banner", "consent", "cookie-banner", "popup", "modal", "site-notice"],
    "side": ["sidebar", "side", "widget", "widget-area", "related", "recommended", "trending", "right-column", "popular"],
    "comments": ["comments", "comment-list", "discussion", "responses", "comment", "user-comments", "replies"],
    "share": ["share", "social", "tags", "meta-links", "author-box", "breadcrumb", "breadcrumbs", "pagination", "pager"],
    "form": ["newsletter", "subscribe", "search", "login", "signup", "contact-form"],
    "foot": ["footer", "site-footer", "bottom", "copyright", "legal"],
    "head": ["header", "site-header", "masthead", "top-bar", "topbar", "logo", "branding"],
    "nav": ["nav", "navbar", "menu", "main-menu", "navigation", "site-nav"],
}
ROLES = {"nav": "navigation", "side": "complementary", "head": "banner", "foot": "contentinfo", "form": "search", "notice": "alert"}


def page(rng: random.Random) -> str:
    """One page; elements with data-keep say whether their text is main text."""
    r = rng

    def words(n: int) -> str:
        w = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(max(1, n))]
        return " ".join(w)

    def sentence(lo: int = 3, hi: int = 18) -> str:
        return words(r.randint(lo, hi)).capitalize() + "."

    def prose() -> str:
        long = r.random()
        return " ".join(sentence(1, 25) for _ in range(1 if long < 0.3 else r.randint(1, 4) if long < 0.8 else r.randint(4, 25)))

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{words(1)}">{words(r.randint(1, 3))}</a></li>' for _ in range(n)) + "</ul>"

    def named(kind: str, tag: str = "div") -> str:
        attr = r.choice(["class", "class", "id"])
        extra = f" {words(1)}" if r.random() < 0.3 else ""
        return f'{tag} {attr}="{r.choice(DROPPED[kind])}{extra}"'

    def dropped(kind: str, inner: str, tags: tuple[str, ...] = ("div", "section")) -> str:
        tag = r.choice(tags)
        bare = tag in ("nav", "footer", "header", "aside", "form") and r.random() < 0.6
        head = tag if bare else f'{tag} role="{ROLES[kind]}"' if kind in ROLES and r.random() < 0.15 else named(kind, tag)
        return f'<{head} data-keep="0">{inner}</{tag}>'

    def ad() -> str:
        return dropped("ad", r.choice([sentence(2, 14), f"<p>{sentence()}</p>", f'<a href="/x">{sentence()}</a>', f"<h4>{words(3)}</h4><p>{sentence()} {sentence()}</p>"]), ("div", "div", "aside", "section"))

    def paragraph() -> str:
        k = r.random()
        if k < 0.72:
            inner = prose()
            if r.random() < 0.2:
                inner += f" <a href='/y'>{words(2)}</a> {prose()}"
            return f"<p>{inner}</p>"
        if k < 0.8:
            return f"<p><b>{prose()}<br>"  # never closed
        if k < 0.86:
            return f"<h{(d := r.randint(2, 4))}>{words(4)}</h{d}>"
        if k < 0.91:
            return "<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if k < 0.94:
            return f"<blockquote><p>{prose()}</p></blockquote>"
        if k < 0.97:
            return f"<pre><code>{words(8)}</code></pre>"
        return f"<table><tr><th>{words(1)}</th><th>{words(1)}</th></tr><tr><td>{words(2)}</td><td>{r.randint(1, 999)}</td></tr></table>"

    body = [paragraph() for _ in range(r.choice([0, 1, 1, 1, 2, 2, 3, 5, 8, 12, 20]))]
    for make, share in ((ad, 0.2), (lambda: dropped("share", links(3)), 0.15), (lambda: dropped("side", f"<h3>{words(2)}</h3>" + links(4), ("div", "aside")), 0.15), (lambda: dropped("form", f"<p>{sentence()}</p><input><button>{words(1)}</button>", ("form", "div")), 0.1)):
        if r.random() < share:
            body.insert(r.randint(0, len(body)), make())
    title = f"<h1>{words(r.choice([1, 2, 4, 6, 9]))}</h1>" if r.random() < 0.85 else ""
    tag, attr = r.choice([("article", ""), ("article", ""), ("main", ""), ("div", f' class="{r.choice(CONTENT)}"'), ("div", f' id="{r.choice(CONTENT)}"'), ("section", f' class="{r.choice(CONTENT)}"'), ("section", ' role="main"'), ("div", ' role="main"'), ("div", "")])
    main = f'<{tag}{attr} data-keep="1">{title}{"".join(body)}</{tag}>'
    if r.random() < 0.1:  # blocks without an element around them
        main = "".join(x if "data-keep" in x else re.sub(r"^<(\w+)", r'<\1 data-keep="1"', x) for x in [title, *body])
    elif r.random() < 0.2:
        main = f'<div class="{r.choice(["container", "wrap", "row", "layout", "page"])}">{main}</div>'

    def comment() -> str:
        return f'<div class="{r.choice(["comment", "reply", "response"])}"><b>{words(1)}</b><p>{prose()}</p></div>'

    top = [
        (0.8, dropped("nav", links(r.randint(3, 8)), ("nav", "nav", "div"))),
        (0.4, dropped("head", f"<a href='/'>{words(2)}</a><p>{sentence()}</p>", ("header", "header", "div"))),
        (0.6, ad()), (0.3, dropped("notice", f"<p>{sentence()} {sentence()}</p><button>OK</button>")), (0.2, dropped("share", " &gt; ".join(f"<a href='/{i}'>{words(1)}</a>" for i in range(3)), ("div", "nav"))),
        (0.15, dropped("form", f"<input><button>{words(1)}</button>", ("form",))),
    ]
    low = [
        (0.35, dropped("side", f"<h3>{words(2)}</h3><p>{prose()}</p>" + links(r.randint(2, 6)), ("aside", "aside", "div"))),
        (0.35, dropped("comments", f"<h3>{words(1)}</h3>" + "".join(comment() for _ in range(r.randint(1, 5))), ("section", "div"))),
        (0.25, dropped("form", f"<p>{sentence()}</p><label>{words(2)}</label><input><button>{words(1)}</button>", ("form", "div"))), (0.3, ad()),
        (0.8, dropped("foot", f"&copy; {words(1)} &middot; {sentence()}" + (links(3) if r.random() < 0.4 else ""), ("footer", "footer", "div"))),
        (0.15, dropped("notice", f"<p>{sentence()}</p>")),
    ]
    top, low = ([x for p, x in part if r.random() < p] for part in (top, low))
    r.shuffle(top)
    return f'<html><head><title>{words(4)}</title><script>var a="</p>";</script></head><body>{"".join(top)}{main}{"".join(low)}</body></html>'
