"""Labelled pages for the extraction model: layouts in common use, filled with words by a seeded generator.

An element with data-label="content" is main text with all it holds, unless an inner element says data-label="other".
Layout pieces are written here by hand; what varies is which pieces a page has, how they are named, and how long texts are.
"""

from __future__ import annotations

from random import Random

_WORDS = "the river came down past old mills and slow farms before it met a wide grey bay where boats lay in mud at low tide while men waited under nets for rain to end so they could sail again toward islands that nobody had seen since winter".split()


def _say(r: Random, low: int, high: int) -> str:
    words = [r.choice(_WORDS) for _ in range(r.randint(low, high))]
    out, start = [], True
    for i, w in enumerate(words):
        out.append((w.capitalize() if start else w) + ("." if i == len(words) - 1 or r.random() < 0.08 else "," if r.random() < 0.06 else ""))
        start = out[-1].endswith(".")
    text = " ".join(out)
    return text.upper().replace(" ", "!! ") if r.random() < 0.04 else text.replace(" ", " | ") if r.random() < 0.03 else text


def _links(r: Random, n: int, item: str = "<li>{}</li>") -> str:
    return "".join(item.format(f'<a href="/{r.choice(_WORDS)}">{_say(r, 1, 3).rstrip(".")}</a>') for _ in range(n))


def _nav(r: Random) -> str:
    return r.choice([
        "<nav><ul>{}</ul></nav>", '<div class="nav"><ul>{}</ul></div>', '<div id="menu">{}</div>', '<ul class="breadcrumb">{}</ul>', '<header><nav class="main-nav">{}</nav></header>', '<div role="navigation"><ol>{}</ol></div>', '<table><tr><td class="menu"><ul>{}</ul></td></tr></table>',
    ]).format(_links(r, r.randint(1, 9)))


def _head(r: Random) -> str:
    return r.choice(["<header><h1>{}</h1><p>{}</p></header>", '<div class="header"><a href="/"><b>{}</b></a> <span>{}</span></div>', '<div id="masthead"><div class="logo">{}</div><p class="tagline">{}</p></div>', '<header class="site-header"><div>{}</div><div>{}</div></header>']).format(_say(r, 1, 3), _say(r, 2, 8))


def _foot(r: Random) -> str:
    return r.choice(["<footer>&copy; {} &middot; {}</footer>", '<div class="footer"><p>{}</p><p>{}</p></div>', '<div id="footer"><div>{}</div><small>{}</small></div>', "<footer><p>{}</p><ul>" + _links(r, 4) + "</ul><p>{}</p></footer>"]).format(_say(r, 1, 3), _say(r, 3, 25))


def _ad(r: Random) -> str:
    return r.choice(['<div class="ad">{}</div>', '<div class="advert"><p>{}</p></div>', '<aside class="sponsored"><h3>{}</h3></aside>', '<div id="promo"><p>{}</p><a href="/buy">Buy</a></div>', '<section class="advertisement"><div>{}</div></section>', '<p class="ad">{}</p>']).format(_say(r, 3, 40))


def _side(r: Random) -> str:
    return r.choice(['<aside><h3>{}</h3><ul>{}</ul></aside>', '<div class="sidebar"><h4>{}</h4><p>' + _say(r, 5, 30) + "</p>{}</div>", '<div id="related"><h2>{}</h2><ul>{}</ul></div>', '<div class="widget"><b>{}</b>{}</div>', '<aside class="side"><p>{} ' + _say(r, 10, 40) + "</p>{}</aside>"]).format(_say(r, 1, 4), _links(r, r.randint(0, 6)))


def _notice(r: Random) -> str:
    return r.choice(['<div class="cookie-notice"><p>{}</p><button>Accept</button></div>', '<div id="cookie-banner">{} <a href="/p">More</a></div>', '<div class="notice">{}</div>', '<div class="newsletter"><p>{}</p><form action="/n"><label>Mail</label><input><button>Go</button></form></div>', '<div role="alert">{}</div>', '<section class="subscribe"><h3>Join</h3><p>{}</p></section>', '<p class="notice">{}</p>']).format(_say(r, 5, 35))


def _form(r: Random) -> str:
    return r.choice(['<form><label>{}</label><input name="q"><button>Search</button></form>', '<form class="login"><p>{}</p><input><select><option>A<option>B</select></form>', '<div class="search"><form><p>{}</p><button>Find</button></form></div>']).format(_say(r, 1, 20))


def _talk(r: Random) -> str:
    one = r.choice(['<div class="comment"><b>{}</b><p>{}</p></div>', "<li class=\"comment\"><cite>{}</cite><p>{}</p></li>", '<article class="comment"><h4>{}</h4><p>{}</p></article>', "<div><span>{}</span><p>{}</p></div>", '<blockquote class="reply"><b>{}</b> {}</blockquote>'])
    body = "".join(one.format(_say(r, 1, 2), _say(r, 4, 60)) for _ in range(r.randint(1, 4)))
    return r.choice(['<section class="comments"><h2>Comments</h2>{}</section>', '<div id="comments">{}</div>', '<ol class="commentlist">{}</ol>', '<div id="disqus_thread"><h3>Discussion</h3>{}</div>', '<section id="reader-comments">{}</section>']).format(body)


def _share(r: Random) -> str:
    return r.choice(['<div class="share"><ul>{}</ul></div>', '<p class="social">{}</p>', '<div class="share-buttons">{}</div>']).format(_links(r, r.randint(2, 4)))


def _body(r: Random) -> str:
    out = []
    for _ in range(r.randint(1, 9)):
        kind = r.random()
        if kind < 0.55:
            inner = _say(r, 1, 90)
            if r.random() < 0.2:
                inner += f' <a href="/x">{_say(r, 1, 5)}</a> <em>{_say(r, 1, 6)}</em>'
            out.append(f"<p>{inner}</p>")
        elif kind < 0.63:
            out.append(f"<p><b>{_say(r, 1, 12)}<br>")
        elif kind < 0.72:
            out.append(f"<h{r.randint(2, 3)}>{_say(r, 1, 8)}</h2>")
        elif kind < 0.79:
            out.append("<ul>" + "".join(f"<li>{_say(r, 1, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
        elif kind < 0.84:
            out.append(f"<blockquote><p>{_say(r, 5, 40)}</p></blockquote>")
        elif kind < 0.88:
            out.append(f"<pre>{_say(r, 3, 30)}</pre>")
        elif kind < 0.92:
            out.append("<table>" + "".join(f"<tr><td>{_say(r, 1, 4)}</td><td>{_say(r, 1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
        elif kind < 0.95:
            out.append(f"<figure><img src=a><figcaption>{_say(r, 2, 12)}</figcaption></figure>")
        else:
            out.append(f"<div>{_say(r, 5, 60)}</div>")
        if r.random() < 0.08:
            extra = r.choice([_ad, _side, _share, _notice, _form])(r)
            out.append(extra.replace(">", ' data-label="other">', 1))
    return "".join(out)


def _main(r: Random) -> str:
    title = f"<h1>{_say(r, 1, 10)}</h1>" if r.random() < 0.85 else ""
    shell = r.choice([
        '<article data-label="content">{}{}</article>', '<article data-label="content">{}{}</article>', '<main><article data-label="content">{}{}</article></main>', '<main data-label="content">{}{}</main>', '<div class="content" data-label="content">{}{}</div>', '<div id="content"><div class="post" data-label="content">{}{}</div></div>',
        '<div class="article-body" data-label="content">{}{}</div>', '<section class="story" data-label="content">{}{}</section>', '<div id="main" data-label="content">{}{}</div>', '<div class="entry-content" data-label="content">{}{}</div>', '<table><tr><td data-label="content">{}{}</td></tr></table>', '<div data-label="content">{}{}</div>',
        '<article class="post" data-label="content"><header>{}</header><div class="entry">{}</div></article>',
    ])
    return shell.format(title, _body(r))


def labelled_pages(n: int = 120, seed: int = 11) -> list[str]:
    """`n` pages; the same ones on each call."""
    r, out = Random(seed), []
    for _ in range(n):
        before = [f(r) for f in (_head, _nav, _notice, _ad, _form, _side) if r.random() < 0.45]
        after = [f(r) for f in (_share, _side, _talk, _ad, _notice, _form, _nav) if r.random() < 0.35]
        foot = [_foot(r)] if r.random() < 0.85 else []
        inner = "".join(before) + _main(r) + "".join(after)
        if r.random() < 0.3:
            inner = r.choice(['<div class="wrapper">{}</div>', '<div id="page"><div class="container">{}</div></div>', "<div>{}</div>"]).format(inner)
        out.append(f"<!DOCTYPE html><html><head><title>{_say(r, 2, 8)}</title><style>p{{margin:0}}</style></head><body>{inner}{''.join(foot)}</body></html>")
    return out


LABELLED: list[str] = labelled_pages()
