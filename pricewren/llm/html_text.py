"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the document tree.

A page is cut into leaf blocks: runs of text between the borders of block elements, each with its ancestors. Features of
a block's ancestors (tags, and what their classes, ids and roles say) and of its text (length, links, punctuation, words)
and those of its neighbours score it as article or not; a transition score between neighbours makes runs of either
likely. The field is fitted to labelled pages by the gradient of its likelihood (forward-backward) and decoded by Viterbi.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewren.llm.common import release
from pricewren.llm.pages import made_pages

#: Pages of the table that training takes at most, and pages written from their texts.
SAMPLE, WRITTEN = 300, 900

# Elements by what they do to the tree, after the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "template", "svg", "math", "object", "audio", "video", "canvas", "select", "datalist"}
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = {"ul", "ol", "table", "dl", "body", "html", "article", "section", "div", "td", "th", "blockquote"}
NOTED = {"article", "main", "section", "nav", "header", "footer", "aside", "form", "table", "ul", "ol", "dl", "dialog", "figure", "blockquote", "noscript", "button", "head", "pre", "details", "menu", "fieldset"}

# Parts of class names, ids and roles, and what an element so named holds.
NAMES = {
    "main": ("article", "articulo", "artikel", "content", "contents", "contenido", "inhalt", "contenu", "post", "entry", "story", "main", "body", "text", "prose", "page", "blog", "news", "single", "hentry", "richtext", "copy"),
    "menu": ("nav", "navbar", "navigation", "menu", "menubar", "topbar", "breadcrumb", "breadcrumbs", "crumbs", "tabs", "toc", "sitemap", "pager", "pagination", "skip", "links", "languages", "categories"),
    "header": ("header", "head", "masthead", "banner", "logo", "brand", "hero", "top", "branding"),
    "footer": ("footer", "foot", "bottom", "colophon", "contentinfo", "copyright", "legal", "imprint", "impressum"),
    "side": ("sidebar", "side", "aside", "rail", "widget", "complementary", "related", "recommended", "more", "trending", "popular", "recent", "promo", "teaser", "tags", "author", "bio", "readmore", "mostread", "siderail"),
    "ad": ("ad", "ads", "advert", "advertisement", "advertising", "adsense", "adslot", "adbox", "sponsor", "sponsored", "dfp", "outbrain", "taboola", "publicidad", "werbung", "anzeige", "publicite", "banner-ad", "gpt", "promoted"),
    "notice": ("cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "dialog", "paywall", "disclaimer", "toast", "aviso", "hinweis", "privacy", "warning", "message", "announcement"),
    "form": ("form", "search", "searchbox", "newsletter", "subscribe", "subscription", "signup", "login", "signin", "register", "contact", "field", "input"),
    "comment": ("comment", "comments", "commentlist", "discussion", "disqus", "reply", "replies", "respond", "responses", "thread", "reviews", "feedback", "comentarios", "kommentare", "commentaires", "reader", "forum", "conversation"),
    "share": ("share", "sharing", "social", "follow", "facebook", "twitter", "like", "buttons", "toolbar", "tools", "actions"),
    "hidden": ("hidden", "invisible", "sr", "visually", "print", "noprint", "offscreen"),
}
# Words of short texts that aren't an article's, by what they belong to.
WORDS = {
    "notice": ("cookie", "cookies", "consent", "gdpr", "privacy", "privacidad", "datenschutz", "confidentialité", "javascript", "browser", "notice", "aviso", "hinweis", "accept", "aceptar", "akzeptieren", "accepter"),
    "rights": ("copyright", "©", "rights", "reserved", "derechos", "reservados", "rechte", "vorbehalten", "droits", "réservés", "terms", "impressum", "imprint", "policy"),
    "form": ("subscribe", "newsletter", "email", "e-mail", "password", "login", "log", "sign", "search", "submit", "suscríbete", "buscar", "suchen", "abonnieren", "rechercher", "name", "register"),
    "ad": ("advertisement", "sponsored", "advert", "ad", "ads", "publicidad", "werbung", "anzeige", "publicité", "promoted", "buy", "shop", "offer", "sale", "deal"),
    "comment": ("comment", "comments", "reply", "replies", "comentarios", "comentario", "kommentare", "kommentar", "commentaires", "commentaire", "responder", "antworten", "répondre", "says", "wrote", "likes", "report"),
    "more": ("related", "more", "read", "share", "tweet", "follow", "previous", "next", "home", "menu", "back", "popular", "trending", "tags", "posted", "relacionados", "mehr", "weiterlesen", "partager", "compartir", "teilen", "inicio", "startseite", "accueil"),
}
_NAME_OF = {name: kind for kind, names in NAMES.items() for name in names}
_WORD_OF = {word: kind for kind, words in WORDS.items() for word in words}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?][^>]*+>?""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden|aria-label|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")


class Block:
    __slots__ = ("text", "path", "linked", "homes")

    def __init__(self, text: str, path: tuple[tuple[str, tuple[str, ...]], ...], linked: int, homes: tuple[int, int]):
        #: path: the ancestors from the outermost, each a tag and what its attributes say; linked: characters inside links;
        #: homes: numbers of the elements that hold its own element, and that one
        self.text, self.path, self.linked, self.homes = text, path, linked, homes


@lru_cache(maxsize=50_000)
def kinds_of(attributes: str) -> tuple[str, ...]:
    """What an element's classes, id, role and style say that it holds."""
    out = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            out.add("hidden")
        elif name != "style":
            parts = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", (m[2] or "").strip("\"'")).lower())
            out |= {_NAME_OF.get(p) or _NAME_OF.get(p.rstrip("s")) for p in parts}
    return tuple(sorted(x for x in out if x))


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page, in order, without comments, scripts, styles and other elements whose content isn't text.

    Character references are decoded, white space runs become one space, and blocks without other signs are left out.
    Elements that a page leaves open end where HTML's own rules end them; an end tag that ends nothing counts for nothing.
    """
    out: list[Block] = []
    path: list[tuple[str, tuple[str, ...]]] = []
    numbers: list[int] = []
    opened = 0
    parts: list[tuple[str, bool]] = []
    link = False
    end, n = 0, len(page)

    def close() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(p for p, _ in parts))).strip()
            if text:
                linked = sum(len(p.strip()) for p, inside in parts if inside)
                out.append(Block(text, tuple(path), min(len(text), linked), (numbers[-2] if len(path) > 1 else 0, numbers[-3] if len(path) > 2 else 0)))
            parts.clear()

    def shut(tags: set[str], scope: set[str]) -> None:
        """End the innermost open element of tags, and what is open in it, unless one of scope is in between."""
        for i in range(len(path) - 1, -1, -1):
            if path[i][0] in tags:
                del path[i:], numbers[i:]
                return
            if path[i][0] in scope:
                return

    while end < n:
        m = _TAG.search(page, end)
        if m is None:
            parts.append((page[end:], link))
            break
        if m.start() > end:
            parts.append((page[end : m.start()], link))
        end = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if not closing and tag in RAW and not attributes.endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, end)
            end = stop.end() if stop else n
            if tag not in ("script", "style", "template"):
                parts.append((" ", link))
            continue
        if tag in INLINE:
            if tag == "a":
                link = not closing
            elif tag in ("br", "img"):
                parts.append((" ", link))
            continue
        close()
        if closing:
            link = False  # as pages leave links open at the end of a block
            shut({tag}, {"table", "td", "th"} - {tag} if tag not in ("table", "html", "body", "article", "main") else set())
            continue
        if tag in VOID:
            continue
        if any(t == "p" for t, _ in path[-4:]):
            shut({"p"}, SCOPE)
        if tag in ENDED_BY:
            link = False
            # everything up to the innermost list or table may end
            for _ in range(3):
                before = len(path)
                shut(ENDED_BY[tag], {"ul", "ol", "dl", "table"})
                if len(path) == before:
                    break
        if not attributes.endswith("/"):
            opened += 1
            path.append((tag, kinds_of(attributes)))
            numbers.append(opened)
    close()
    return out


def _bin(n: float, limits: tuple[float, ...]) -> int:
    return sum(n > x for x in limits)


@lru_cache(maxsize=100_000)
def path_features(path: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[str, ...]:
    """Features of a block's ancestors."""
    tags = [t for t, _ in path]
    out = {f"tag:{tags[-1] if tags else ''}", f"in:{'>'.join(tags[-2:])}"}
    out |= {f"under:{t}" for t in tags if t in NOTED}
    if "article" in tags or "main" in tags:
        first = next(i for i, t in enumerate(tags) if t in ("article", "main"))
        out |= {f"inner:{t}" for t in tags[first + 1 :] if t in NOTED}
        out |= {f"innerkind:{k}" for _, kinds in path[first + 1 :] for k in kinds}
        if tags.count("article") > 1:
            out.add("nested")
    for i, (_, kinds) in enumerate(reversed(path)):
        out |= {f"kind:{k}" for k in kinds}
        if kinds:
            out |= {f"nearest:{k}" for k in kinds if not any(f.startswith("nearest:") for f in out) or i == 0}
    named = [kinds for _, kinds in path if kinds]
    if named:
        out |= {f"last:{k}" for k in named[-1]}
    if not any(k != "main" for kinds in named for k in kinds):
        out.add("unnamed")
    return tuple(sorted(out))


def _text_features(block: Block) -> tuple[str, ...]:
    text = block.text
    words = text.split(" ")
    n, marks = len(words), sum(text.count(c) for c in ".,;:!?")
    out = [f"words:{_bin(n, (1, 2, 4, 8, 14, 25, 50))}", f"linked:{_bin(block.linked / max(1, len(text)), (0, 0.2, 0.5, 0.9))}", f"marks:{_bin(marks / n, (0, 0.04, 0.1, 0.3))}", f"end:{'.' if text[-1] in '.!?…:' else 'a' if text[-1].isalnum() else text[-1]}"]
    if sum(text.count(c) for c in "0123456789") * 4 > len(text):
        out.append("digits")
    if "|" in text or "·" in text or "»" in text or "›" in text:
        out.append("bars")
    if n <= 30:
        out += sorted({f"word:{k}" for w in words if (k := _WORD_OF.get(w.strip(".,:;!?()[]").lower()))} | {f"short:{k}" for w in words if n <= 4 and (k := _WORD_OF.get(w.strip(".,:;!?()[]").lower()))})
    return tuple(out)


@lru_cache(maxsize=10_000)
def _neighbours(before: tuple[str, ...], after: tuple[str, ...]) -> tuple[str, ...]:
    return (*(f"before:{f}" for f in before), *(f"after:{f}" for f in after), *(() if before else ("first",)), *(() if after else ("last",)))


def features(blocks: list[Block]) -> list[tuple[tuple[str, ...], ...]]:
    """The features of each block of a page in groups: of its ancestors, its text, its neighbours' texts and its place."""
    own = [_text_features(b) for b in blocks]
    paths = [path_features(b.path) for b in blocks]
    landmark = any("article" == t or "main" == t for b in blocks for t, _ in b.path)
    out, heading, talk = [], "", False
    held: dict[int, int] = {}
    for b in blocks:
        for home in {*b.homes}:
            held[home] = held.get(home, 0) + len(b.text) - b.linked
    whole = max(1, sum(len(b.text) - b.linked for b in blocks))
    for i, block in enumerate(blocks):
        shares = [_bin(held[home] / whole, (0.02, 0.08, 0.2, 0.45, 0.7)) for home in block.homes]
        more = ["bias", f"place:{10 * i // len(blocks)}", f"home:{shares[0]}", f"house:{shares[1]}"]
        tag = block.path[-1][0] if block.path else ""
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            said = {k for w in block.text.split(" ")[:6] if (k := _WORD_OF.get(w.strip(".,:;!?()[]").lower()))}
            heading = "+".join(sorted(said))
            talk = talk or "comment" in said
            more.append(f"heading:{tag}")
        if heading:
            more.append(f"below:{heading}")
        if talk:
            more.append("talk")
        if landmark and not any(t in ("article", "main") for t, _ in block.path):
            more.append("outside")
        near = _neighbours(own[i - 1][:2] if i else (), own[i + 1][:2] if i + 1 < len(blocks) else ())
        if i and blocks[i - 1].path == block.path:
            more.append("as-before")
        out.append((paths[i], own[i], near, tuple(more)))
    return out


class Field:
    """A linear-chain conditional random field with two labels: 0 for other text, 1 for the article's."""

    def __init__(self, names: list[str]):
        self.place = {name: i for i, name in enumerate(names)}
        self.weights, self.moves = np.zeros(len(names)), np.zeros((2, 2))
        self.sums: dict[tuple[str, ...], float] = {}

    def _batch(self, pages: list[list[tuple[tuple[str, ...], ...]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a block (page * longest + place) and a known feature, and each page's length."""
        lengths = np.array([len(p) for p in pages])
        longest = int(lengths.max(initial=1))
        pairs = [(i * longest + t, f) for i, page in enumerate(pages) for t, groups in enumerate(page) for names in groups for name in names if (f := self.place.get(name)) is not None]
        at, feature = np.array(pairs, np.int64).reshape(-1, 2).T
        return at, feature, lengths

    def _marginals(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of padded scores (pages, places, 2): each label's probability, expected moves, and the sum of log partition functions."""
        pages, longest, _ = scores.shape
        forward, back = np.zeros_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0]
        for t in range(1, longest):
            here = np.logaddexp(forward[:, t - 1, 0, None] + self.moves[0], forward[:, t - 1, 1, None] + self.moves[1]) + scores[:, t]
            forward[:, t] = np.where((t < lengths)[:, None], here, forward[:, t - 1])
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        moves = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            after = back[:, t + 1] + scores[:, t + 1]
            here = np.logaddexp(after[:, 0, None] + self.moves[:, 0], after[:, 1, None] + self.moves[:, 1])
            inside = t + 1 < lengths
            back[:, t] = np.where(inside[:, None], here, 0)
            p = np.exp(forward[:, t, :, None] + self.moves + after[:, None, :] - total[:, None, None])
            moves += (p * inside[:, None, None]).sum(axis=0)
        return np.exp(forward + back - total[:, None, None]), moves, float(total.sum())

    def gradient(self, at: np.ndarray, feature: np.ndarray, lengths: np.ndarray, labels: np.ndarray, penalty: float) -> tuple[float, np.ndarray, np.ndarray]:
        """The penalised log-likelihood of labels (pages, places), a page's share, and its gradients."""
        pages, longest = labels.shape
        score = np.bincount(at, self.weights[feature], pages * longest).reshape(pages, longest)
        scores = np.stack([np.zeros_like(score), score], axis=2)
        p, moves, total = self._marginals(scores, lengths)
        held = np.arange(longest)[None, :] < lengths[:, None]
        both = held[:, 1:]
        seen = np.array([[((labels[:, :-1] == a) & (labels[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)], float)
        value = float((score * labels * held).sum() + (seen * self.moves).sum() - total)
        by_weight = np.bincount(feature, ((labels - p[:, :, 1]) * held).ravel()[at], len(self.weights))
        size = len(lengths)
        return value / size - penalty / 2 * float((self.weights**2).sum()), by_weight / size - penalty * self.weights, (seen - moves) / size

    def fit(self, pages: list[list[tuple[tuple[str, ...], ...]]], labels: list[list[int]], steps: int = 200, rate: float = 0.1, penalty: float = 2e-3) -> float:
        """Gradient ascent with Adam's steps on all pages at once; returns the last value."""
        at, feature, lengths = self._batch(pages)
        padded = np.zeros((len(pages), int(lengths.max(initial=1))))
        for i, row in enumerate(labels):
            padded[i, : len(row)] = row
        mean, square, value = np.zeros(len(self.weights) + 4), np.zeros(len(self.weights) + 4), 0.0
        for step in range(1, steps + 1):
            value, by_weight, by_move = self.gradient(at, feature, lengths, padded, penalty)
            g = np.concatenate([by_weight, by_move.ravel()])
            mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
            move = rate * (1 - step / (steps + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
            self.weights += move[:-4]
            self.moves += move[-4:].reshape(2, 2)
        return value

    def _sum(self, names: tuple[str, ...]) -> float:
        """A group's weights; groups recur, so their sums are kept."""
        found = self.sums.get(names)
        if found is None:
            if len(self.sums) > 200_000:
                self.sums.clear()
            found = self.sums[names] = float(sum(self.weights[i] for name in names if (i := self.place.get(name)) is not None))
        return found

    def decode(self, page: list[tuple[tuple[str, ...], ...]]) -> list[int]:
        """The likeliest labels of a page's blocks (Viterbi); the article's label where two are as likely."""
        (a, b), (c, d) = self.moves.tolist()
        zero = one = 0.0
        came: list[tuple[int, int]] = []
        for t, groups in enumerate(page):
            score = sum(map(self._sum, groups))
            if t == 0:
                zero, one = 0.0, score
                continue
            to_zero, to_one = zero + a > one + c, zero + b > one + d
            came.append((0 if to_zero else 1, 0 if to_one else 1))
            zero, one = max(zero + a, one + c), max(zero + b, one + d) + score
        if not page:
            return []
        out = [0 if zero > one else 1]
        for step in reversed(came):
            out.append(step[out[-1]])
        return out[::-1]

    def to_json(self) -> str:
        return json.dumps({"names": list(self.place), "weights": self.weights.tolist(), "moves": self.moves.tolist()})

    @classmethod
    def from_json(cls, text: str) -> Field:
        got = json.loads(text)
        out = cls(got["names"])
        out.weights, out.moves = np.array(got["weights"]), np.array(got["moves"])
        return out


def landmark_labels(blocks: list[Block]) -> list[int] | None:
    """Labels of a page that marks its one article by an ``article`` element: text in it, but for what is set apart in it."""
    apart = {"nav", "aside", "form", "footer", "button", "menu", "dialog", "noscript"}
    out = []
    for block in blocks:
        tags = [t for t, _ in block.path]
        if "article" not in tags:
            out.append(0)
            continue
        inside = block.path[tags.index("article") + 1 :]
        out.append(int(tags.count("article") == 1 and not any(t in apart or set(kinds) - {"main", "header"} for t, kinds in inside)))
    return out if any(out) else None


def fit_field(pages: list[str], seed: int = 7, written: int = WRITTEN) -> Field:
    """A field fitted to pages that mark their article, and to pages written from their texts, whose labels are known."""
    samples: list[tuple[list[Block], list[int]]] = []
    for page in pages:
        blocks = blocks_of(page)
        labels = landmark_labels(blocks)
        if labels:
            samples.append((blocks, labels))
    inner = [b.text for blocks, labels in samples for b, x in zip(blocks, labels, strict=True) if x]
    for page, wanted in made_pages(inner, written, seed):
        blocks = blocks_of(page)
        left = list(wanted)
        labels = []
        for b in blocks:
            hit = bool(left) and b.text == left[0]
            labels.append(int(hit))
            if hit:
                left.pop(0)
        if not left:
            samples.append((blocks, labels))
    rows = [features(blocks) for blocks, _ in samples]
    seen: dict[str, int] = {}
    for page in rows:
        for groups in page:
            for name in (name for names in groups for name in names):
                seen[name] = seen.get(name, 0) + 1
    field = Field(sorted(name for name, n in seen.items() if n > 2))
    field.fit(rows, [labels for _, labels in samples])
    field.sums.clear()
    return field


def train(pages: DataFrame, sample: int = SAMPLE, seed: int = 7) -> str:
    """The field as JSON, fitted in one task to at most ``sample`` pages with an ``article`` element, the first by a hash of
    page_id and html, and to WRITTEN pages written from the words of their texts. Pages of over 200,000 characters aren't
    taken. Where there are none, the written pages have words of their own."""
    short = pages.select(F.col("html").cast("string").alias("html")).where((F.length("html") <= 200_000) & F.contains("html", F.lit("<article")))
    taken = short.orderBy(F.xxhash64("html"), "html").limit(sample)

    def fit(table: pa.Table) -> pa.Table:
        field = fit_field(sorted(x for x in table.column("html").to_pylist() if x), seed)
        release()
        return pa.table({"model": [field.to_json()]})

    none = pages.sparkSession.createDataFrame([("",)], "html string")
    return taken.unionByName(none).groupBy(F.lit(1).alias("one")).applyInArrow(fit, "model string").first()["model"]


def main_text(page: str | None, field: Field) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, x in zip(blocks, field.decode(features(blocks)), strict=True) if x)


def extract(pages: DataFrame, model: str) -> DataFrame:
    """Every row and column of pages plus ``text`` (blocks of the article joined by a line feed, empty if there is none) and
    ``n_chars`` (its code points); columns of pages with these names are replaced.

    A null or empty html has an empty text, as has a page without text. Equal pages have equal texts. No block is cut.
    """
    names = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    rows = pages.select(*names, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars"))
    html_at = next(i for i, c in enumerate(names) if c.lower() == "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field.from_json(model)
        for batch in (whole.slice(a, 500) for whole in batches for a in range(0, whole.num_rows, 500)):
            texts = [main_text(page, field) for page in batch.column(html_at).to_pylist()]
            columns = [*batch.columns[:-2], pa.array(texts, batch.schema.field("text").type), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            release()

    return rows.mapInArrow(run, rows.schema)
