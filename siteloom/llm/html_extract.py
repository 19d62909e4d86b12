"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks with their ancestors' tags, classes and ids. The field has two
labels, text and boilerplate; its weights are trained by gradient ascent on labelled pages,
which ``labelled_pages`` makes in many layouts, and the best labelling is found by Viterbi.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import small_batches

#: Labelled pages that the field is trained on, passes over them, step size and L2 penalty.
TRAIN_PAGES, TRAIN_PASSES, TRAIN_RATE, TRAIN_L2 = 1000, 8, 0.3, 1e-4

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|[^>]*(?:>|\Z))""",
    re.S,
)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?<![\w-])hidden(?![\w-])|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PART = re.compile(r"[a-z]+")

# Elements of HTML by how they are read.
_RAW = frozenset("script style noscript template textarea title select iframe svg object canvas audio video annotation annotation-xml".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_MATH = frozenset("math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol table dl article section div main body aside nav".split())

# Words that boilerplate is known by.
_SAYS = frozenset(
    "cookie cookies subscribe newsletter advertisement sponsored copyright rights reserved privacy policy terms login "
    "register share tweet reply comments related menu search accept consent advert".split()
)


class Element:
    """An open element. ``fresh`` are the features that it has and no ancestor has, so that a path's features are those of its elements."""

    __slots__ = ("tag", "parent", "fresh", "hidden", "score")

    def __init__(self, tag: str, parent: Element | None, fresh: tuple[str, ...], hidden: bool) -> None:
        self.tag, self.parent, self.fresh, self.hidden, self.score = tag, parent, fresh, hidden, None


class Block:
    __slots__ = ("text", "inside", "linked")

    def __init__(self, text: str, inside: Element | None, linked: int) -> None:
        self.text, self.inside, self.linked = text, inside, linked


def _described(tag: str, attributes: str) -> tuple[tuple[str, ...], bool]:
    """An element's features, and whether it is hidden."""
    names = {f"name:{p}" for n in _NAMES.findall(attributes) for p in _PART.findall("".join(n).lower())}
    return (f"in:{tag}", *names), _HIDDEN.search(attributes) is not None


_described_again = functools.lru_cache(maxsize=4096)(_described)


class _Open:
    """The open elements. Every step takes time in proportion to what it opens or closes, however deep the page."""

    def __init__(self) -> None:
        self.stack: list[Element] = []
        self.own: list[tuple[str, ...]] = []
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.count: dict[str, int] = {}

    @property
    def top(self) -> Element | None:
        return self.stack[-1] if self.stack else None

    def push(self, tag: str, attributes: str) -> None:
        own, hidden = (_described_again if len(attributes) < 256 else _described)(tag, attributes)
        count, fresh = self.count, []
        for f in own:
            n = count.get(f, 0)
            count[f] = n + 1
            if not n:
                fresh.append(f)
        parent = self.top
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in _SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(Element(tag, parent, tuple(fresh), hidden or (parent is not None and parent.hidden)))
        self.own.append(own)

    def close_from(self, i: int) -> None:
        while len(self.stack) > i:
            tag = self.stack.pop().tag
            self.at[tag].pop()
            if tag in _SCOPE:
                self.scopes.pop()
            for f in self.own.pop():
                self.count[f] -= 1

    def last(self, *tags: str) -> int:
        """Where the innermost open element of these tags is; -1 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)


def leaf_blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order: text between the edges of block elements, references decoded, white space made one space.

    Read as a browser would as far as it matters here: comments, scripts and other raw elements go, an end tag closes what is open within,
    unclosed tags at the end of the page go. Formulas are text. Time and memory grow with the page's length, not with its depth.
    """
    blocks: list[Block] = []
    opened = _Open()
    parts: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, opened.top, linked))
            parts.clear()
        linked = 0

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else size
        if stop > at:
            parts.append(page[at:stop])
            if in_link:
                linked += stop - at
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        end, tag, attributes = m[1], m[2].lower(), m[3]
        if tag in _RAW:
            if not end and not attributes.endswith("/"):
                close = re.compile(f"</{re.escape(tag)}(?![\\w-])[^>]*(?:>|\\Z)", re.I).search(page, at)
                at = close.end() if close else size
            continue
        if tag == "a":
            in_link = 0 if end else 1
        if tag in _INLINE or tag in _MATH:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        flush()
        in_link = 0
        if end:
            i = opened.last(tag)
            if i >= 0:
                opened.close_from(i)
            continue
        if tag in _CLOSES_P and opened.stack and opened.top.tag == "p":
            opened.close_from(len(opened.stack) - 1)
        if tag in _CLOSES_SELF:
            i = opened.last(*_CLOSES_SELF[tag])
            if i >= 0 and (not opened.scopes or i > opened.scopes[-1]):
                opened.close_from(i)
        if tag not in _VOID and not attributes.endswith("/"):
            opened.push(tag, attributes)
    flush()
    return blocks


def _own_features(b: Block, at: int, n: int) -> list[str]:
    """A block's features but those of the elements that it is in."""
    k = len(b.text.split())
    size = f"words{min(8, k.bit_length())}"
    f = ["bias", size, f"link{min(4, 4 * b.linked // max(1, len(b.text)))}", f"at{4 * at // n}"]
    if b.inside is not None:
        f.append(f"under:{b.inside.tag}")
        f.append(f"under:{b.inside.tag}/{size}")
        if b.inside.hidden:
            f.append("hidden")
    if b.text[-1] in ".!?:;\"'”»…":
        f.append("ends")
    if "©" in b.text or "(c)" in b.text:
        f.append("sign")
    if k <= 40:
        f += {f"says:{w}" for w in _SAYS.intersection(_PART.findall(b.text.lower()))}
    return f


def features(blocks: list[Block]) -> list[list[str]]:
    out = []
    for i, b in enumerate(blocks):
        f, e = _own_features(b, i, len(blocks)), b.inside
        while e is not None:
            f += e.fresh
            e = e.parent
        out.append(f)
    return out


class Field:
    """Two-label chain: ``weight`` is a feature's score for text over boilerplate, ``move`` the score of label pairs."""

    def __init__(self) -> None:
        self.weight: dict[str, float] = {}
        self.move = [[0.0, 0.0], [0.0, 0.0]]
        self.start = 0.0

    def scores(self, feats: list[list[str]]) -> list[float]:
        get = self.weight.get
        return [sum(get(x, 0.0) for x in f) for f in feats]

    def block_scores(self, blocks: list[Block]) -> list[float]:
        """The scores of ``features(blocks)``, with each element's features added up once."""
        get, out = self.weight.get, []
        for i, b in enumerate(blocks):
            e, path = b.inside, []
            while e is not None and e.score is None:
                path.append(e)
                e = e.parent
            total = e.score if e is not None else 0.0
            for e in reversed(path):
                total = e.score = total + sum(get(x, 0.0) for x in e.fresh)
            out.append(total + sum(get(x, 0.0) for x in _own_features(b, i, len(blocks))))
        return out

    def viterbi(self, s: list[float]) -> list[int]:
        if not s:
            return []
        (m00, m01), (m10, m11) = self.move
        a, b, back = 0.0, s[0] + self.start, []
        for x in s[1:]:
            from_a, from_b = a + m01 >= b + m11, a + m00 >= b + m10
            back.append((not from_b, not from_a))
            a, b = (a + m00 if from_b else b + m10), (a + m01 if from_a else b + m11) + x
        label = int(b > a)
        out = [label]
        for from_one in reversed(back):
            label = int(from_one[label])
            out.append(label)
        return out[::-1]

    def marginals(self, s: list[float]) -> tuple[list[float], list[list[list[float]]]]:
        """P(text) of each block, and P(label, next label) of each pair of neighbours."""
        e = [[math.exp(x) for x in row] for row in self.move]
        n, up = len(s), [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in s]
        forward = []
        for i, p in enumerate(up):
            if i:
                a, b = forward[-1]
                x, y = (a * e[0][0] + b * e[1][0]) * (1 - p), (a * e[0][1] + b * e[1][1]) * p
            else:
                x, y = 1 - p, p * math.exp(self.start)
            forward.append((x / (x + y), y / (x + y)))
        x, y = 1.0, 1.0
        node, pair = [0.0] * n, []
        for i in range(n - 1, -1, -1):
            a, b = forward[i]
            node[i] = b * y / (a * x + b * y)
            if i:
                p, (c, d) = up[i], forward[i - 1]
                t = [[c * e[0][0] * (1 - p) * x, c * e[0][1] * p * y], [d * e[1][0] * (1 - p) * x, d * e[1][1] * p * y]]
                z = sum(map(sum, t))
                pair.append([[v / z for v in row] for row in t])
                x, y = e[0][0] * (1 - p) * x + e[0][1] * p * y, e[1][0] * (1 - p) * x + e[1][1] * p * y
                x, y = x / (x + y), y / (x + y)
        return node, pair[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], seed: int = 3) -> Field:
    """Stochastic gradient ascent on the conditional log likelihood, with Adagrad steps."""
    field, rng, seen = Field(), random.Random(seed), {}
    for _ in range(TRAIN_PASSES):
        rng.shuffle(pages)
        for feats, labels in pages:
            if not feats:
                continue
            node, pair = field.marginals(field.scores(feats))
            grad: dict[object, float] = {}
            for f, p, y in zip(feats, node, labels, strict=True):
                for x in f:
                    grad[x] = grad.get(x, 0.0) + y - p
            for k, t in enumerate(pair):
                for i in (0, 1):
                    for j in (0, 1):
                        grad[i, j] = grad.get((i, j), 0.0) + ((labels[k], labels[k + 1]) == (i, j)) - t[i][j]
            grad["start",] = labels[0] - node[0]
            for x, g in grad.items():
                now = field.weight.get(x, 0.0) if isinstance(x, str) else field.start if x == ("start",) else field.move[x[0]][x[1]]
                g -= TRAIN_L2 * now * len(feats)
                seen[x] = seen.get(x, 1e-3) + g * g
                now += TRAIN_RATE * g / math.sqrt(seen[x])
                if isinstance(x, str):
                    field.weight[x] = now
                elif x == ("start",):
                    field.start = now
                else:
                    field.move[x[0]][x[1]] = now
    return field


# Names that pages give to their parts.
_AS = {
    "nav": "nav navbar menu navigation topnav links breadcrumb breadcrumbs pagination pager toc tabs",
    "header": "header masthead banner top branding site-header logo hero",
    "footer": "footer site-footer bottom copyright colophon foot legal",
    "side": "sidebar side widget aside rail secondary column right-column related recommended popular trending more-stories",
    "ad": "ad ads advert advertisement sponsor sponsored promo banner-ad adsbox dfp outbrain teaser",
    "notice": "cookie cookie-notice cookies notice alert gdpr consent banner announcement popup modal overlay warning message",
    "comment": "comment comments comment-list discussion respond replies reply disqus feedback reviews",
    "share": "share social sharing share-buttons tags meta byline author date dateline post-meta info",
    "form": "form signup newsletter subscribe search login search-form contact",
    "text": "article post entry content article-body post-content entry-content story main-content body text story-body page-content single",
}
_SYLLABLES = "an be co da el fi go hu is jo ka le mo nu or pa qui ra se ti un ve wo xa yo za che sta tri our".split()


def labelled_pages(count: int, seed: int) -> Iterator[tuple[str, list[str]]]:
    """Pages in random layouts, each with its main text's blocks in order."""
    r = random.Random(seed)

    def word() -> str:
        return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3)))

    def say(lo: int, hi: int, stop: str = ".") -> str:
        w = [word() for _ in range(r.randint(lo, hi))]
        if r.random() < 0.1:
            w[r.randrange(len(w))] += "&amp;" + word()
        return " ".join(w).capitalize() + stop

    def prose() -> str:
        size = r.choice([1, 1, 2, 3, 5, 8, 8, 40])
        out = " ".join(say(3, 18) for _ in range(size if r.random() < 0.5 else min(size, 8)))
        return out if r.random() < 0.8 else out.rstrip(".") + r.choice(["", "", ",", "&amp;&amp;"])

    def box(kind: str, inside: str, *tags: str) -> str:
        tag = r.choice(tags or ("div",))
        name = r.choice(_AS[kind].split())
        if tag not in ("div", "section", "ul", "p", "td") and r.random() < 0.6:
            return f"<{tag}>{inside}</{tag}>"
        name = f"{word()}-{name}" if r.random() < 0.3 else f"{name} {word()}" if r.random() < 0.3 else name
        return f'<{tag} {r.choice(["class", "class", "id"])}="{name}">{inside}</{tag}>'

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{say(1, r.choice([1, 3, 8]), "")}</a></li>' for _ in range(n)) + "</ul>"

    def prose_or_links() -> str:
        return r.choice([links(r.randint(2, 6)), f"<p>{prose()}</p>", f"<h3>{say(1, 4, '')}</h3>{links(4)}", prose(), f"<h4>{say(1, 3, '')}</h4><p>{say(4, 20)}</p>"])

    def advert() -> str:
        return box("ad", r.choice([prose(), f"<p>{prose()}</p>", f"<a href='//{word()}'>{say(2, 9, '')}</a>", f"<p>Advertisement</p><p>{prose()}</p>"]), "div", "aside", "section")

    def notice() -> str:
        said = r.choice(["We use cookies.", "", "Subscribers only."])
        return box("notice", f"<p>{said} {prose()}</p><button>{say(1, 2, '')}</button>" if r.random() < 0.6 else prose(), "div", "section", "aside")

    def form() -> str:
        inside = f"<label>{say(1, 4, '')}</label><input name=q><select><option>{word()}</option></select><button>{say(1, 2, '')}</button>"
        return f"<form>{r.choice(['', f'<p>{prose()}</p>'])}{inside}</form>" if r.random() < 0.7 else box("form", f"<p>{prose()}</p>{inside}")

    def comments() -> str:
        one = lambda: r.choice(["<div class='{}'>{}</div>", "<li class='{}'>{}</li>", "<article class='{}'>{}</article>"]).format(r.choice(["comment", "reply", word()]), f"<b>{word()}</b> <p>{prose()}</p>" + r.choice(["", "<a href='#'>Reply</a>"]))
        return box("comment", f"<h3>{say(1, 2, '')}</h3>" * (r.random() < 0.5) + "".join(one() for _ in range(r.randint(1, 6))) + form() * (r.random() < 0.3), "div", "section", "ul", "ol")

    def boiler(*kinds: str) -> str:
        k = r.choice(kinds)
        return {
            "nav": lambda: box("nav", links(r.randint(2, 9)), "nav", "nav", "div", "ul"),
            "header": lambda: box("header", f"<a href='/'>{say(1, 3, '')}</a>" + f"<p>{say(3, 8)}</p>" * (r.random() < 0.5) + links(4) * (r.random() < 0.4), "header", "header", "div"),
            "footer": lambda: box("footer", r.choice(["&copy; ", "Copyright ", ""]) + f"{word()}.example &middot; {prose()}" if r.random() < 0.6 else f"<p>{prose()}</p>{links(3)}", "footer", "footer", "div"),
            "side": lambda: box("side", "".join(prose_or_links() for _ in range(r.randint(1, 3))), "aside", "aside", "div", "section"),
            "ad": advert, "notice": notice, "form": form, "comment": comments,
            "share": lambda: box("share", r.choice([f"{word()} {r.randint(1, 28)}/{r.randint(1, 12)}", f"<a href='#'>{word()}</a> <a href='#'>{word()}</a>", say(1, 4, "")]), "div", "p", "ul"),
        }[k]()

    def article(kept: list[str]) -> str:
        out = []
        title = say(3, 10, r.choice(["", "", "."]))
        if r.random() < 0.85:
            kept.append(title)
            out.append(r.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>"]).format(title))
        if r.random() < 0.3:
            out.append(boiler("share"))
        for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
            p = prose() if r.random() < 0.8 else say(1, 4)
            kind = r.random()
            if kind < 0.72:
                made = r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p><b>{}<br>", "<p>{}", "<div>{}</div>", "<p class='" + word() + "'>{}</p>"]).format(p)
            elif kind < 0.8:
                p = say(1, 7, "")
                made = f"<h2>{p}</h2>" if r.random() < 0.6 else f"<h3>{p}</h3>"
            elif kind < 0.86:
                items = [say(1, 9, r.choice(["", "."])) for _ in range(r.randint(2, 4))]
                kept += items[:-1]
                p, made = items[-1], "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
            elif kind < 0.92:
                made = f"<blockquote>{p}</blockquote>" if r.random() < 0.5 else f"<blockquote><p>{p}</p></blockquote>"
            else:
                made = f'<p><a href="/{word()}">{p}</a></p>' if r.random() < 0.3 else f"<p><em>{p}</em></p>"
            kept.append(p)
            out.append(made)
            if r.random() < 0.12:
                out.append(boiler("ad", "share", "side", "form", "notice"))
        if r.random() < 0.25:
            out.append(boiler("share", "side", "nav", "comment", "form"))
        return "\n".join(out)

    for _ in range(count):
        kept: list[str] = []
        body = [boiler("nav", "header") for _ in range(r.randint(0, 2))] + [boiler("ad", "notice", "nav", "form", "side") for _ in range(r.choice([0, 0, 1, 2]))]
        main = article(kept)
        main = box("text", main, "article", "article", "div", "main", "section") if r.random() < 0.95 else main
        if r.random() < 0.3:
            main = r.choice(["<main>{}</main>", "<div id='main'>{}</div>", "<div class='wrapper'>{}</div>", "<table><tr><td>{}</td></tr></table>"]).format(main)
        after = [boiler("side", "comment", "ad", "nav", "form", "notice") for _ in range(r.choice([0, 0, 1, 2, 3]))]
        foot = [boiler("footer")] * (r.random() < 0.85)
        yield f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{''.join(body)}{main}{''.join(after)}{''.join(foot)}</body></html>", [" ".join(html.unescape(k).split()) for k in kept]


def labelled(page: str, kept: list[str]) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a labelled page's blocks; the kept blocks are found in order."""
    blocks, labels, i = leaf_blocks(page), [], 0
    for b in blocks:
        here = i < len(kept) and b.text == kept[i]
        labels.append(int(here))
        i += here
    return features(blocks), labels


@functools.cache
def trained_field(pages: int = TRAIN_PAGES, seed: int = 11) -> Field:
    return train([labelled(*x) for x in labelled_pages(pages, seed)])


def main_text(page: str | None, field: Field) -> str:
    blocks = leaf_blocks(page or "")
    labels = field.viterbi(field.block_scores(blocks))
    return " ".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def extract_main_text(spark: SparkSession, pages: DataFrame, field: Field | None = None) -> DataFrame:
    """``pages`` (page_id, url, html) as (page_id, url, text, n_chars): the blocks labelled text, joined by one space.

    Null or empty html, or none labelled: ''. Null ids and urls and repeated rows stay as they are. Very long pages are read
    whole, and very deep ones in time that grows with their length. Other columns go. The field is small (a weight for each feature of the training pages), so it's broadcast.
    """
    small_batches(spark)
    sent = spark.sparkContext.broadcast(field or trained_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x, sent.value) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
