"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between the borders of block elements, with the
elements above them. Each block has features of its ancestors (tags, words of class and id, the
nearest element that says what it is for) and of its text (length, links, punctuation). A chain of
two labels, main text or not, with weights for features and for neighbouring labels, is trained on
labelled pages and decoded by Viterbi.

Labelled pages are the hand-labelled layouts below and at most ``Settings.rows`` pages of the table,
chosen by a hash, that mark their article themselves; copies of both without the telling tags are
trained on as well, so that pages that mark nothing are decided by class words and text.

Cases: null and empty pages, and pages without a main block, give an empty text. Broken markup is
read as far as it goes: an unclosed comment or tag at the end is dropped, unclosed elements end with
the page. Very long and very deep pages cost time and memory in proportion to their length. Repeated
rows and ids are extracted one by one; of pages of one id one is trained on. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, arrow_schema, bounded_sample, in_parts


@dataclass(frozen=True)
class Settings:
    rows: int = 256  # pages of the table to train on
    blocks: int = 400  # most blocks of a page to train on
    steps: int = 120
    rate: float = 0.3
    ridge: float = 1e-3


INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rb rp rt s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no text of the page.
HIDDEN = frozenset("script style template noscript svg math object iframe canvas audio video".split())
# A new one of these ends an open one.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SECTIONS = frozenset(
    "article main section aside nav header footer form figure table fieldset dialog menu body head address details".split()
)
MAIN_WORDS = frozenset("article body content entry main post prose story text copy".split())
OTHER_WORDS = frozenset(
    "ad ads advert advertisement alert banner bar bottom breadcrumb breadcrumbs byline caption category comment comments "
    "consent cookie cookies copyright dialog discussion disqus foot footer form gdpr head header hidden legal links list "
    "login masthead menu meta modal more nav navbar navigation newsletter notice pager pagination paywall popular popup "
    "privacy promo promoted rail recommended related replies reply respond response search share sharing sidebar side "
    "signup social sponsor sponsored subscribe subscription tags teaser toolbar top trending warning widget".split()
)

# Behind the name of a tag everything up to its end, or to the end of the page, is taken at once and never given
# back, so a page is read once from its start to its end, whatever it leaves open.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S
)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


BORDERS = frozenset("div td th li blockquote dd".split())
LISTS = frozenset("ul ol dl table tbody thead select menu".split()) | SECTIONS


@dataclass(eq=False)
class Element:
    """An open element that counts for the blocks inside it; what its path says is settled when it
    opens, from the element above and its own words."""

    tag: str
    above: "Element | None"
    fresh: tuple[str, ...]  # features that no element above has
    near: str  # the nearest element that says what it is for
    other: bool  # whether any of the path speaks of something else than the main text
    label: str  # the nearest label
    article: int  # 1 inside an article, -1 inside what is no text of it, else 0


@dataclass
class Block:
    text: str
    element: Element | None
    links: int = 0  # characters inside links
    features: list[str] = field(default_factory=list)


class _Open:
    """Open elements, with the places of each tag, so that an end tag finds its start at once."""

    def __init__(self, blind: bool):
        self.blind = blind
        self.tags: list[str] = []
        self.elements: list[Element | None] = []  # None: an inline element, which no path shows
        self.own: list[tuple[str, ...]] = []
        self.path: list[Element] = []
        self.places: dict[str, list[int]] = {}
        self.active: Counter[str] = Counter()
        self.links = 0
        self.holding: dict[frozenset[str], list[int]] = {SECTIONS | BORDERS: [], LISTS: []}

    def push(self, tag: str, attributes: str) -> None:
        element, own = None, ()
        words, label = _names(attributes)
        if tag not in INLINE or label:
            element, own = self._element(tag, words, label)
            self.path.append(element)
            self.active.update(own)
        place = len(self.tags)
        for tags, places in self.holding.items():
            if tag in tags:
                places.append(place)
        self.places.setdefault(tag, []).append(place)
        self.tags.append(tag)
        self.elements.append(element)
        self.own.append(own)
        self.links += tag == "a"

    def _element(self, tag: str, words: tuple[str, ...], label: str) -> tuple[Element, tuple[str, ...]]:
        above = self.path[-1] if self.path else None
        shown = "div" if self.blind and tag in ("article", "main", "section") else tag
        kept = set(words) - MAIN_WORDS if self.blind else set(words)
        own = (f"in {shown}", *(f"word {word}" for word in sorted(kept)))
        if kept & OTHER_WORDS:
            near = "other"
        elif kept & MAIN_WORDS:
            near = "main"
        else:
            near = shown if shown in SECTIONS else above.near if above else "none"
        no_text = tag in ("nav", "aside", "form", "footer", "head") or bool(set(words) & OTHER_WORDS)
        before = above.article if above else 0
        article = -1 if no_text or before < 0 else max(before, int(tag == "article"))
        fresh = tuple(name for name in own if not self.active[name])
        other = bool(set(words) & OTHER_WORDS) or bool(above and above.other)
        return Element(tag, above, fresh, near, other, label or (above.label if above else ""), article), own

    def close(self, upto: int) -> None:
        while len(self.tags) > upto:
            tag, element, own = self.tags.pop(), self.elements.pop(), self.own.pop()
            self.places[tag].pop()
            for tags, places in self.holding.items():
                if tag in tags:
                    places.pop()
            if element:
                self.path.pop()
                self.active.subtract(own)
            self.links -= tag == "a"

    def last(self, tags: set[str]) -> int:
        """The place of the innermost open element of the tags, or -1."""
        return max((self.places[tag][-1] for tag in tags if self.places.get(tag)), default=-1)

    def close_last(self, tags: set[str], within: frozenset[str]) -> None:
        """End the innermost open element of the tags, unless an element of ``within`` lies inside it."""
        place, holding = self.last(tags), self.holding[within]
        if place >= 0 and (not holding or holding[-1] <= place):
            self.close(place)


def _names(attributes: str) -> tuple[tuple[str, ...], str]:
    """Words of class, id and role, and the label."""
    if not attributes or "=" not in attributes:
        return (), ""
    found = {m[0].lower(): m[1] or m[2] or m[3] for m in _NAMES.findall(attributes)}
    label = found.pop("data-label", "")
    return tuple(w.lower() for value in found.values() for w in _WORDS.findall(value)), label


def leaf_blocks(page: str | None, blind: bool = False) -> list[Block]:
    """Blocks of text in page order. Blind: without the tags and words that name the article."""
    blocks: list[Block] = []
    stack = _Open(blind)
    parts: list[tuple[str, bool]] = []

    def text(piece: str) -> None:
        if piece:
            parts.append((piece, stack.links > 0))

    def flush() -> None:
        if parts:
            plain = " ".join(entities.unescape("".join(piece for piece, _ in parts)).split())
            if plain:
                links = sum(len(piece) for piece, linked in parts if linked)
                blocks.append(Block(plain, stack.path[-1] if stack.path else None, links))
            parts.clear()

    at, page = 0, page or ""
    lowered = None
    while at < len(page):
        token = _TOKEN.search(page, at)
        if token is None:
            text(page[at:])
            break
        text(page[at : token.start()])
        at = token.end()
        name = token[2]
        if name is None:
            continue
        tag, ends = name.lower(), token[1] == "/"
        if not token[4]:
            break
        if tag in INLINE:
            if tag == "br":
                text(" ")
            elif ends:
                stack.close_last({tag}, SECTIONS | BORDERS)
            elif tag not in VOID:
                stack.push(tag, token[3])
            continue
        flush()
        if ends:
            place = stack.last({tag})
            if place >= 0:
                stack.close(place)
        elif tag in HIDDEN:
            if not token[3].endswith("/"):
                lowered = page.lower() if lowered is None and page.isascii() else lowered
                end = re.compile(f"</{re.escape(tag)}\\b", re.I).search(page, at) if lowered is None else None
                start = lowered.find(f"</{tag}", at) if lowered is not None else end.start() if end else -1
                if start < 0:
                    break
                at = page.find(">", start) + 1 or len(page)
        elif tag not in VOID:
            stack.close_last({"p"}, SECTIONS | BORDERS)
            if tag in SIBLINGS:
                stack.close_last(SIBLINGS[tag], LISTS)
            stack.push(tag, token[3])
    flush()
    return blocks


def _band(value: float, limits: tuple[float, ...]) -> int:
    return sum(value >= limit for limit in limits)


def describe(blocks: list[Block]) -> list[Block]:
    """Set the features of the texts of a page's blocks; those of their paths stay with the elements."""
    for place, block in enumerate(blocks):
        text, size = block.text, len(block.text)
        n_words = text.count(" ") + 1
        ends = sum(map(text.count, ".!?;"))
        block.features = [
            "bias",
            f"words {_band(n_words, (2, 4, 8, 16, 32, 64))}",
            f"links {_band(block.links / size, (0.01, 0.3, 0.7))}",
            f"stops {_band(ends / n_words, (0.01, 0.03, 0.1, 0.3))}",
            f"finished {text[-1] in '.!?…'} {_band(n_words, (4, 12))}",
            f"notice {any(sign in text for sign in '©®')}",
        ]
        block.features += ["first"] if place == 0 else []
        block.features += ["last"] if place == len(blocks) - 1 else []
    return blocks


def _at_element(element: Element | None) -> list[str]:
    """Features of a path that are those of its last element."""
    if not element:
        return ["near none", "tag div"]
    return [f"near {element.near}", f"tag {element.tag}"] + (["other above"] if element.other else [])


def path_features(element: Element | None) -> list[str]:
    """All features of a path."""
    names = _at_element(element)
    while element:
        names.extend(element.fresh)
        element = element.above
    return sorted(names)


@dataclass
class Chain:
    """Weights of the random field: of each feature for label one against label zero, and of
    neighbouring labels."""

    weights: dict[str, float]
    steps: np.ndarray  # from label, to label

    def _path_score(self, element: Element | None, known: dict[int, float]) -> float:
        """What the path of a block adds to its score; sums of the elements above are kept."""
        way = []
        at = element
        while at and id(at) not in known:
            way.append(at)
            at = at.above
        total = known[id(at)] if at else 0.0
        for step in reversed(way):
            total += sum(self.weights.get(name, 0.0) for name in step.fresh)
            known[id(step)] = total
        return total + sum(self.weights.get(name, 0.0) for name in _at_element(element))

    def decode(self, blocks: list[Block]) -> list[int]:
        """Viterbi."""
        (a, b), (c, d) = self.steps.tolist()
        back: list[tuple[int, int]] = []
        zero = one = 0.0
        known: dict[int, float] = {}
        for place, block in enumerate(blocks):
            score = self._path_score(block.element, known) + sum(self.weights.get(name, 0.0) for name in block.features)
            if place:
                back.append((int(one + c > zero + a), int(one + d > zero + b)))
                zero, one = max(zero + a, one + c), max(zero + b, one + d) + score
            else:
                zero, one = 0.0, score
        label = int(one > zero)
        labels = [label] * bool(blocks)
        for before in reversed(back):
            label = before[label]
            labels.append(label)
        return labels[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = describe(leaf_blocks(page))
        return "\n".join(block.text for block, label in zip(blocks, self.decode(blocks)) if label)


def forward_backward(scores: np.ndarray, steps: np.ndarray, lengths: np.ndarray):
    """Marginals of labels and of label pairs for many chains at once; scores: chain, place, label."""
    n, size, _ = scores.shape
    inside = np.arange(size)[None, :] < lengths[:, None]
    alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
    alpha[:, 0] = scores[:, 0]
    for place in range(1, size):
        alpha[:, place] = scores[:, place] + np.logaddexp.reduce(alpha[:, place - 1, :, None] + steps[None], axis=1)
    for place in range(size - 2, -1, -1):
        ahead = np.logaddexp.reduce(steps[None] + (scores + beta)[:, place + 1, None, :], axis=2)
        beta[:, place] = np.where(inside[:, place + 1, None], ahead, 0.0)
    total = np.logaddexp.reduce(alpha[np.arange(n), lengths - 1], axis=1)
    nodes = np.exp(alpha + beta - total[:, None, None]) * inside[:, :, None]
    pairs = np.exp(alpha[:, :-1, :, None] + steps + (scores + beta)[:, 1:, None, :] - total[:, None, None, None])
    return nodes, (pairs * inside[:, 1:, None, None]).sum(axis=(0, 1)), total


def fit_chain(pages: list[tuple[list[Block], list[int]]], settings: Settings = Settings()) -> Chain:
    """Maximum likelihood with a ridge, by adaptive gradient steps over all pages."""
    pages = [page for page in pages if page[0]]
    names = {name: k for k, name in enumerate(sorted({name for blocks, _ in pages for names in blocks for name in names}))}
    lengths = np.array([len(blocks) for blocks, _ in pages])
    size = int(lengths.max())
    cells, columns = [], []
    labels = np.zeros((len(pages), size), int)
    for k, (blocks, truth) in enumerate(pages):
        labels[k, : len(truth)] = truth
        for place, block in enumerate(blocks):
            cells += [k * size + place] * len(block)
            columns += [names[name] for name in block]
    cells, columns = np.array(cells), np.array(columns)
    wanted = np.zeros((2, 2))
    for blocks, truth in pages:
        np.add.at(wanted, (truth[:-1], truth[1:]), 1)
    weights, steps = np.zeros(len(names)), np.zeros((2, 2))
    seen, seen_steps = np.full(len(names), 1e-8), np.full((2, 2), 1e-8)
    for _ in range(settings.steps):
        scores = np.zeros((len(pages), size, 2))
        scores[:, :, 1] = np.bincount(cells, weights[columns], len(pages) * size).reshape(len(pages), size)
        nodes, pairs, _ = forward_backward(scores, steps, lengths)
        error = (nodes[:, :, 1] - labels).reshape(-1)
        slope = np.bincount(columns, error[cells], len(names)) / len(pages) + settings.ridge * weights
        slope_steps = (pairs - wanted) / len(pages) + settings.ridge * steps
        seen += slope**2
        seen_steps += slope_steps**2
        weights -= settings.rate * slope / np.sqrt(seen)
        steps -= settings.rate * slope_steps / np.sqrt(seen_steps)
    return Chain({name: float(weights[k]) for name, k in names.items()}, steps)


# Hand-labelled layouts: ``data-label`` tells whether the blocks below are main text. {0} to {5} are
# filled with sentences, {n} with a short name.
LAYOUTS = [
    """<head><title>{n}</title></head><body><header class="site-header"><a href="/">{n}</a><nav class="main-menu"><ul><li><a>{n}</a><li><a>{n}</a></ul></nav>
    </header><div class="cookie-notice">{0} <button>OK</button></div><main data-label="1"><h1>{n}</h1><p>{0} {1} {2}</p><p>{3}</p><h2>{n}</h2><p>{4} {5}</p>
    <ul><li>{1}</li><li>{2}</li></ul><aside data-label="0"><h3>{n}</h3><p>{3}</p></aside><p>{5}</p></main><section class="comments"><h3>Comments</h3><p>{1}</p><p>{4}</p>
    <form><label>Name</label><input><button>Send</button></form></section><footer><p>© 2020 {n}. {2}</p></footer></body>""",
    """<body><div id="top-bar"><a>{n}</a> <a>{n}</a></div><div id="wrapper"><div class="sidebar"><h4>{n}</h4><ul><li><a>{n}</a></li><li><a>{n}</a></li></ul><p>{0}</p></div>
    <div class="post-content" data-label="1"><h1>{n}</h1><p>{1} {2}</p><blockquote><p>{3}</p></blockquote><p>{4}</p><div class="ad-banner" data-label="0">{0}</div><p>{5} {2}</p>
    <pre>{1}</pre></div><div class="related-links"><h3>{n}</h3><a>{n}</a></div></div><div class="footer">&copy; {n} {3}</div></body>""",
    """<body><nav><a>{n}</a><a>{n}</a><a>{n}</a></nav><div class="ad">{0}</div><article data-label="1"><h1>{n}</h1><p>{0} {1}</p><p>{2}</p><table><tr><th>{n}</th><td>{3}</td></tr></table>
    <p>{4} {5}</p><div class="share-buttons" data-label="0"><a>{n}</a><a>{n}</a></div></article><div id="disqus_thread"><p>{2}</p><p>{5}</p></div><footer>{n} · {1}</footer></body>""",
    """<body><div class="masthead"><h2>{n}</h2><p>{0}</p></div><div class="alert warning"><p>{1}</p></div><table><tr><td class="menu"><a>{n}</a><br><a>{n}</a></td>
    <td class="story" data-label="1"><h1>{n}</h1><p>{2} {3}<p>{4}<p>{5} {0}<div class="newsletter-signup" data-label="0"><p>{1}</p><form>{n}</form></div><p>{2}</td></tr></table>
    <div class="copyright">{n} {0}</div></body>""",
    """<body><header><div class="logo">{n}</div></header><div class="breadcrumbs"><a>{n}</a> / <a>{n}</a></div><article class="entry"><div data-label="1"><h1>{n}</h1><p>{0}</p><p>{1} {2}</p>
    <figure><figcaption>{3}</figcaption></figure><p>{4}</p></div><ol class="comment-list"><li class="comment"><p>{5}</p></li><li class="comment"><p>{0} {1}</p></li></ol></article>
    <aside><div class="widget"><h3>{n}</h3><p>{2}</p></div></aside><footer class="page-footer"><p>{3}</p><ul><li><a>{n}</a></ul></footer></body>""",
    """<body><div>{n}</div><div><a>{n}</a> <a>{n}</a> <a>{n}</a></div><div data-label="1"><div>{0} {1} {2}</div><div>{3} {4}</div><div>{5} {1} {0}</div></div><div>© {n}</div></body>""",
    """<body><p data-label="1">{0} {1}</p><p data-label="1">{2}</p><p data-label="1">{3} {4} {5}</p></body>""",
    """<body><section class="hero promo"><h2>{n}</h2><p>{0}</p></section><div role="navigation"><a>{n}</a><a>{n}</a></div><div role="main" data-label="1"><h1>{n}</h1><p>{1}</p><p>{2} {3} {4}</p>
    <dl><dt>{n}</dt><dd>{5}</dd></dl></div><div class="modal popup"><p>{2}</p><button>{n}</button></div><div class="sponsored">{3}</div><form class="login"><label>{n}</label><p>{4}</p></form></body>""",
]
_SENTENCES = [
    "The river rose in the night and by morning the lower road was gone.", "She counted the boats twice.", "Wer den Hafen kennt, weiss um die Strömung, die hier fast immer nach Süden zieht.",
    "Nous avons attendu le train pendant deux heures, puis il a commencé à neiger.", "No hay respuesta sencilla para esa pregunta, dijo el maestro.", "A short line", "It was late",
    "Prices of grain fell for the third year, and few farms on the plain kept all of their land.", "BUY NOW!! LIMITED OFFER!!", "one | two | three | four five | six", "Ends*** with%%% odd### marks$$$ here&&&",
    "Der Wind drehte gegen Abend.", "Il pleut.", "Todo era silencio en la plaza vacía; ni un perro ladraba.",
]
_TITLES = ["Harbour", "The long winter", "Über uns", "Contact", "Dernières nouvelles", "Read more", "Inicio", "A year on the plain, and what came after it"]


def hand_labelled() -> list[tuple[list[list[str]], list[int]]]:
    """Layouts, each filled several times, plain and blind."""
    rng = np.random.default_rng(0)
    pages = []
    for layout in LAYOUTS:
        for _ in range(12):
            texts = [" ".join(rng.choice(_SENTENCES, rng.integers(1, 5))) for _ in range(6)]
            page = re.sub(r"\{n\}", lambda _: str(rng.choice(_TITLES)), layout)
            page = re.sub(r"\{(\d)\}", lambda m: texts[int(m[1])], page)
            pages += [_labelled(page, _nearest_label, blind) for blind in (False, True)]
    return pages


def _labelled(page: str, label, blind: bool, most: int | None = None) -> tuple[list[list[str]], list[int]]:
    """All features and the label of each block of a page; nothing of a page of more than ``most``."""
    blocks = leaf_blocks(page, blind)
    if most is not None and len(blocks) > most:
        return [], []
    features = [path_features(block.element) + block.features for block in describe(blocks)]
    return features, [label(block.element) for block in blocks]


def _nearest_label(element: Element | None) -> int:
    return int(element is not None and element.label == "1")


def _inside_article(element: Element | None) -> int:
    """What pages say that mark their article: inside it, and below nothing that is not its text."""
    return int(element is not None and element.article == 1)


def train(pages: DataFrame, settings: Settings = Settings()) -> Chain:
    marked = pages.where(F.col("html").rlike("(?i)<article")).select("page_id")
    ids = bounded_sample(marked, settings.rows, "page_id")
    # At most settings.rows rows of one number; of pages of one id the one of the least hash is taken.
    rows = pages.select(F.col("page_id").cast("long"), "html").join(F.broadcast(ids), "page_id")
    rows = rows.groupBy("page_id").agg(F.min_by("html", F.xxhash64("html")).alias("html"))

    most = settings.blocks

    def cut(batches):
        for batch in in_parts(batches):
            made = []
            for page_id, page in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
                for blind in (False, True):
                    features, labels = _labelled(page, _inside_article, blind, most)
                    if features:
                        made.append({"page_id": page_id, "features": features, "labels": labels})
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    schema = "page_id long, features array<array<string>>, labels array<int>"
    arrow = arrow_schema(pages.sparkSession, schema)
    found = rows.mapInArrow(cut, schema).collect()
    found.sort(key=lambda row: (row.page_id, row.features))
    marked_pages = [(row.features, row.labels) for row in found]
    return fit_chain(hand_labelled() + marked_pages, settings)


def extract_main_text(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``page_id, url, text, n_chars`` per row."""
    shared = Shared(pages.sparkSession, train(pages, settings))
    schema = "page_id long, url string, text string, n_chars long"
    arrow = arrow_schema(pages.sparkSession, schema)

    def run(batches):
        chain = shared.value()
        for batch in in_parts(batches):
            texts = [chain.main_text(page) for page in batch.column("html").to_pylist()]
            lengths = pa.array([len(text) for text in texts], pa.int64())
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), lengths]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, schema)
