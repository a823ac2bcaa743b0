"""Main text of web pages: gradient-boosted trees over the nodes of the page, decoded along the tree."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from korpusmill.functions.batches import map_batches
from korpusmill.llm import boosting, dom
from korpusmill.llm.common import slices

def _layouts(words: list[str], n: int, seed: int) -> Iterator[tuple[str, list[str]]]:
    """Pages of many layouts around given words, each with the texts that belong to its article.

    They vary what sites vary: wrappers and their names, where menus, notices, adverts, forms and comments stand, and how
    carelessly tags are closed.
    """
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]

    def some(a: int, b: int) -> str:
        k = int(rng.integers(a, b + 1))
        at = int(rng.integers(0, max(1, len(words) - k)))
        text = " ".join(words[at : at + k]) or "text"
        return text[:1].upper() + text[1:] + pick(".", ".", "", "!")

    def menu(tag: str, attr: str) -> str:
        items = "".join(f"<li><a href='/x{i}'>{some(1, 3)}</a></li>" for i in range(rng.integers(2, 9)))
        return f"<{tag}{attr}><ul>{items}</ul></{tag}>" if rng.random() < 0.7 else f"<{tag}{attr}>" + " | ".join(f"<a href='/y{i}'>{some(1, 2)}</a>" for i in range(rng.integers(2, 9))) + f"</{tag}>"

    def named(*known: str) -> str:
        """An attribute: one of the known names, a name that says nothing, or none."""
        kind = rng.random()
        unknown = "".join(pick("ka", "lo", "mi", "x", "tu", "re", "zo", "b2", "q-") for _ in range(rng.integers(1, 4)))
        return f' class="{pick(*known)}"' if known and kind < 0.4 else f' {pick("class", "id")}="{unknown}"' if kind < 0.85 else ""

    def unmarked() -> str:
        """What its structure alone tells: asides, hidden blocks, boxes with a button, forms, lists of links, threads of remarks."""
        kind = pick(0, 1, 2, 2, 2, 2, 3, 3, 4, 5, 6, 6, 7)
        if kind == 0:
            return f"<aside{named('pull', 'box')}>" + pick("", f"<h3>{some(1, 3)}</h3>") + pick(some(2, 20), f"<p>{some(2, 30)}</p>") + "</aside>"
        if kind == 1:
            tag = pick("div", "p", "section")
            hidden = pick("hidden", 'style="display:none"', "style='display: none'", 'style="color:red; display: none;"', 'aria-hidden="true"')
            return f"<{tag}{named()} {hidden}>{some(2, 60)}</{tag}>"
        if kind == 2:
            return f"<div{named('cc-window', 'toast')}>" + pick(some(3, 40), f"<p>{some(3, 40)}</p>") + f"<button{named()}>{some(1, 2)}</button>{pick('', f'<button>{some(1, 2)}</button>')}</div>"
        if kind == 3:
            return f"<form{named()}><p>{some(1, 15)}</p>{pick('<input>', '<select><option>1</select>')}{pick('', f'<label>{some(1, 4)}</label>')}</form>"
        if kind == 4:
            return f"<div{named()}>{pick('', f'<h3>{some(1, 3)}</h3>')}<ul>" + "".join(f"<li><a href='#'>{some(1, 7)}</a></li>" for _ in range(rng.integers(3, 8))) + "</ul></div>"
        if kind == 5:
            return f"<nav{named()}>" + " ".join(f"<a href='/{i}'>{some(1, 2)}</a>" for i in range(rng.integers(2, 7))) + "</nav>"
        if kind == 6:
            return f"<div{named('thread')}>{pick('', f'<h3>{rng.integers(1, 40)} {some(1, 1)}</h3>')}" + "".join(f"<div{named('comment', 'reply')}><b>{some(1, 2)}</b><p>{some(3, 50)}</p><a href='#'>{some(1, 1)}</a></div>" for _ in range(rng.integers(2, 6))) + "</div>"
        return f"<div{named('advert', 'promo')}><a href='#'>{some(2, 12)}</a></div>"

    def junk() -> str:
        if rng.random() < 0.5:
            return unmarked()
        kind = rng.integers(11)
        if kind == 0:
            return menu("nav", pick("", ' class="menu"', ' id="nav"'))
        if kind == 1:
            return menu("div", pick(' class="nav"', ' class="top-menu"', ' id="navigation"', ' class="breadcrumbs"'))
        if kind == 2:
            return f"<div class=\"{pick('ad', 'ads', 'advert', 'ad-slot', 'banner', 'promo', 'sponsored')}\">{some(3, 20)}</div>"
        if kind == 3:
            return f"<aside{pick('', ' class=sidebar')}><h3>{some(1, 3)}</h3><p>{some(5, 40)}</p></aside>"
        if kind == 4:
            return f"<div class=\"{pick('sidebar', 'side', 'widget', 'related', 'recommended')}\"><h3>{some(1, 4)}</h3><ul>" + "".join(f"<li><a href='#'>{some(2, 8)}</a></li>" for _ in range(4)) + f"</ul><p>{some(4, 30)}</p></div>"
        if kind == 5:
            return f"<div class=\"{pick('cookie', 'cookie-notice', 'notice', 'consent', 'gdpr-banner')}\"><p>{some(6, 40)}</p><button>{some(1, 2)}</button></div>"
        if kind == 6:
            return f"<form action='/s'><label>{some(1, 4)}</label><input name=q><p>{some(1, 12)}</p><button>{some(1, 1)}</button></form>"
        if kind == 7:
            return f"<section class=\"{pick('comments', 'comment-list', 'replies', 'discussion')}\"><h2>{some(1, 2)}</h2>" + "".join(f"<div class=\"{pick('comment', 'reply')}\"><p>{some(4, 60)}</p></div>" for _ in range(rng.integers(1, 5))) + "</section>"
        if kind == 8:
            return f"<div class=\"{pick('share', 'social', 'newsletter', 'subscribe', 'tags')}\"><p>{some(2, 16)}</p><a href='#'>{some(1, 2)}</a></div>"
        if kind == 9:
            return f"<div id=\"{pick('comments', 'respond', 'disqus')}\"><ol>" + "".join(f"<li class=comment><b>{some(1, 2)}</b><p>{some(4, 50)}</p></li>" for _ in range(rng.integers(1, 4))) + "</ol></div>"
        return f"<script>var a='<p>x</p>';</script><div class=\"{pick('popup', 'modal', 'overlay')}\">{some(3, 25)}</div>"

    def inline() -> str:
        kind = pick("ad", "ads", "advert", "promo", "sponsored", "share", "social", "newsletter", "related", "comment")
        return pick(f"<span class={kind}>{some(1, 8)}</span>", f"<a class='{kind}-link' href='#'>{some(1, 4)}</a>", f"<em id={kind}>{some(1, 5)}</em>")

    for _ in range(n):
        texts: list[str] = []

        def body(texts: list[str] = texts) -> str:
            out = []
            for i in range(int(rng.integers(1, 12))):
                kind, t = rng.random(), some(1, 120) if rng.random() < 0.85 else some(1, 3)
                texts.append(t)
                if kind >= 0.28 and rng.random() < 0.08:
                    more = some(2, 30)
                    texts.append(more)
                    out.append(f"<p>{t} {inline()} {more}</p>")
                elif kind >= 0.28 and rng.random() < 0.12:  # marked up inside, which does not part it
                    inner, more, tags = some(1, 2), some(2, 30), pick(("em", "em"), ("b", "b"), ("code", "code"), ("a href=z", "a"), ("math><mi", "mi></math"), ("i><b", "b></i"), ("sup", "sup"))
                    texts[-1] = f"{t} {inner} {more}"
                    out.append(f"<p>{t} <{tags[0]}>{inner}</{tags[1]}> {more}</p>")
                elif i and kind < 0.08:
                    out.append(f"<{pick('h2', 'h3')}>{t}</h2>")
                elif kind < 0.14:
                    more = some(2, 12)
                    texts.append(more)
                    out.append(f"<ul><li>{t}</li><li>{more}</li></ul>")
                elif kind < 0.2:
                    out.append(f"<blockquote>{t}</blockquote>")
                elif kind < 0.24:
                    out.append(f"<pre>{t}</pre>")
                elif kind < 0.28:
                    out.append(f"<div>{t}</div>")
                else:
                    out.append(f"<p>{pick('', '', '<b>', '<em>', '<a href=z>')}{t}{pick('</p>', '</p>', '<br>', '')}")
                if rng.random() < 0.2:
                    out.append(junk())
            return "".join(out)

        title = some(2, 9)
        head = f"<{pick('h1', 'h1', 'h2')}>{title}</h1>"
        if rng.random() < 0.3:
            texts.insert(0, title)
            head = f"<h1>{title}</h1>"
            inside = True
        else:
            inside = rng.random() < 0.9
            if inside:
                texts.insert(0, title)
        tag, attr = pick(("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("main", ' id="content"'), ("div", ' class="content"'), ("div", ' class="article-body"'), ("div", ' id="main"'), ("div", ' class="entry-content"'), ("div", ' class="story"'), ("section", ' class="post"'))
        main = f"<{tag}{attr}>{head if inside else ''}{body()}</{tag}>"
        if rng.random() < 0.3:
            main = f"<div{pick('', ' class=container', ' id=wrap')}>{main}{junk() if rng.random() < 0.5 else ''}</div>"
        top = "".join(junk() for _ in range(rng.integers(0, 4)))
        if rng.random() < 0.4:
            top = f"<{pick('header', 'div class=header', 'div id=masthead')}><a href='/'>{some(1, 3)}</a>{pick('', '<p>' + some(2, 10) + '</p>')}</header>" + top
            top = top if top.startswith("<header") else top.replace("</header>", "</div>", 1)
        end = "".join(junk() for _ in range(rng.integers(0, 4)))
        foot = pick(f"<footer>&copy; {some(1, 20)}</footer>", f"<footer><p>{some(3, 30)}</p></footer>", f"<div class=\"footer\">{some(2, 20)}</div>", "")
        if tag != "div" and rng.random() < 0.25 and not inside:
            top += f"<h1>{title}</h1>"
            texts.insert(0, title)
        yield f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style></head><body>{top}{main}{end}{foot}{pick('</body></html>', '')}", texts


def _outside(n: dom.Node) -> bool:
    """Whether a text stands in a part that no article has."""
    up = n.parent
    while up is not None:
        if up.bad or up.hidden or up.tag in ("a", "nav", "aside", "form", "footer"):
            return True
        up = up.parent
    return False


def _labelled(page: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the nodes; 1 for those that hold a text of the article."""
    nodes = dom.in_order(dom.parse(page))
    left = {}
    for t in texts:
        t = " ".join(t.split())
        left[t] = left.get(t, 0) + 1
    y = np.zeros(len(nodes))
    for n in nodes:
        if n.text and left.get(n.text, 0) and not _outside(n):
            left[n.text] -= 1
            while n is not None:
                y[n.order] = 1
                n = n.parent
    return dom.features(nodes), y[1:]


def _marked(page: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The same for a page that marks its article or main part by that element."""
    nodes = dom.in_order(dom.parse(page))
    y, any_main = np.zeros(len(nodes)), False
    for n in nodes:
        if n.text:
            up, inside, out = n.parent, False, False
            while up is not None:
                inside |= up.tag in ("article", "main")
                out |= up.tag in ("nav", "footer", "aside", "form") or up.bad > up.good
                up = up.parent
            if inside and not out:
                any_main = True
                while n is not None:
                    y[n.order] = 1
                    n = n.parent
    return (dom.features(nodes), y[1:]) if any_main else None


def _vocabulary(n: int = 3000, seed: int = 2) -> list[str]:
    """Invented words, some with commas and stops, for layouts."""
    rng = np.random.default_rng(seed)
    parts = "an er on the st ing re ou ha nd ti es le la de que en ion ar os che un ver ge ben ich".split()
    return ["".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(1, 5))) + ("", "", "", "", "", "", "", "", ",", ".")[rng.integers(10)] for _ in range(n)]


_fitted: dict[tuple[int, int], boosting.Boosted] = {}


def standard_model(layouts: int = 500, seed: int = 1) -> boosting.Boosted:
    """Trees fitted on ``layouts`` seeded pages of invented words: the same for every table, made once a session."""
    if (layouts, seed) not in _fitted:
        found = [_labelled(p, t) for p, t in _layouts(_vocabulary(), layouts, seed)]
        _fitted[layouts, seed] = boosting.fit(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), trees=90)
    return _fitted[layouts, seed]


def fit(pages: DataFrame, most: int = 200, longest: int = 200_000, layouts: int = 500, page_id: str = "page_id", html: str = "html", seed: int = 1) -> boosting.Boosted:
    """Trees for a site whose pages mark their article: fitted on ``most`` pages at the most (by a hash of their id; none beyond ``longest`` characters) beside the layouts of :func:`standard_model`."""
    some = pages.filter(F.length(html) <= longest).select(F.col(html).alias("html"), F.xxhash64(F.col(page_id), F.col(html)).alias("h"))
    chosen = some.select("h").orderBy("h").limit(most).distinct()  # most numbers at most
    rows = some.join(F.broadcast(chosen), "h").dropDuplicates(["h"]).orderBy("h").collect()
    found = [m for r in rows if (m := _marked(r.html))] + [_labelled(p, t) for p, t in _layouts(_vocabulary(), layouts, seed)]
    return boosting.fit(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), trees=90)


def texts(model: boosting.Boosted, pages: list[str]) -> list[str]:
    """Main text of each page; blocks in page order, joined by a space."""
    trees = [dom.in_order(dom.parse(p)) for p in pages]
    x = [dom.features(t) for t in trees]
    logits = np.split(model.logits(np.concatenate(x)), np.cumsum([len(v) for v in x])[:-1]) if x else []
    return [" ".join(dom.decode(t, z)) for t, z in zip(trees, logits, strict=True)]


def extract(pages: DataFrame, model: boosting.Boosted | None = None, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, with ``text`` (main text, empty if none) and ``n_chars`` (its code points).

    Character references are decoded; white space inside a block becomes one space; blocks are joined by one space. Null and
    empty html give an empty text; repeated rows are each extracted; columns of ``pages`` named ``text`` or ``n_chars`` are
    replaced; very long pages are read whole; an empty table gives an empty result. Without a ``model`` the standard one is
    used, so the text of a page never depends on the other pages.
    """
    model = model or standard_model()
    source = pages.drop(*({"text", "n_chars"} - {html}))
    shared, place = pages.sparkSession.sparkContext.broadcast(model.__dict__), source.columns.index(html)
    keep = [i for i in range(len(source.columns)) if i != place]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = boosting.Boosted(**shared.value)
        for b in slices(batches, html, 1 << 19):
            out = texts(trees, [p or "" for p in b.column(place).to_pylist()])
            yield pa.record_batch([*(b.column(i) for i in keep), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], [*(b.schema.names[i] for i in keep), "text", "n_chars"])

    fields = [source.schema.fields[i] for i in keep]
    return map_batches(source, run, StructType([*fields, StructField("text", StringType()), StructField("n_chars", LongType())]))
