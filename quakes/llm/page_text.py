"""Main text of web pages by a recurrent block labeller.

A page is parsed into leaf blocks (runs of text between block-level tags), each with
its tag path.  A bidirectional LSTM in numpy reads, for the whole sequence of a
page's blocks, the hashed tag path (names and classes) and hashed words of each,
and labels every block as main text or not, so a block is judged with the whole
document around it.

Training: ``train_pages`` distinct pages (documented bound) with the least hash of their
content are labelled from the containers HTML itself declares: text under nav,
header, footer, aside, form and the like, or in an element whose class or role
names an advert, notice, menu, sidebar or comment, is not main text; text of the
article (or main, or the body where neither exists) is.  Inference covers every
page and every block.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakes.llm.common import table

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template title head svg iframe object select textarea button".split())
#: What may stand in an open head: any other start tag, and any text, ends it (its end tag may be left out).
HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
#: Silent elements that may hold their like; a new one of the others ends the open one.
NESTING = frozenset("svg object template".split())
#: Start tags after which a silent element may turn out to have been left open.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
#: Elements that a new block-level tag of the same kind closes (their end tags may be left out).
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
BOILER_TAGS = frozenset("nav header footer aside form menu dialog".split())
BOILER_WORDS = re.compile(
    r"\b(ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|popup|modal|menu|nav\w*|breadcrumbs?|"
    r"sidebar|widget|footer|header|masthead|share|social|related|newsletter|subscribe|login|comments?|replies|disqus)\b"
)
PATH_DIM, WORD_DIM, HIDDEN = 64, 32, 16
PAGES = 128  # parsed and labelled together
GROUP_BLOCKS = 4096  # whose features are held at a time
SPACES = re.compile(r"\s+")
LETTERS = re.compile(r"[^\W\d_]+")


class _Blocks(HTMLParser):
    """Text in a silent element is dropped up to the first block-level tag in it.  What
    follows is dropped when the element's own end tag comes, and stays when there is
    none: the element was left open and the page went on."""

    CDATA_CONTENT_ELEMENTS, RCDATA_CONTENT_ELEMENTS = ("script", "style"), ()  # of any Python version

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.open: defaultdict[str, int] = defaultdict(int)  # of each tag in the stack
        self.quiet: list[list] = []  # open silent elements: place in the stack, blocks before their first block-level tag
        self.silent = 0  # of them, those without a block-level tag so far
        self.text: list[str] = []
        self.blank = True  # nothing but white space in the block so far
        self.path: tuple = ()
        self.blocks: list[tuple[tuple, str]] = []

    def flush(self):
        text = SPACES.sub(" ", "".join(self.text)).strip()
        if text:
            self.blocks.append((self.path, text))
        self.text, self.blank = [], True

    def _pop(self, at: int, ended: bool = False):
        """Elements from ``at`` on go; ``ended``: the first by its own end tag."""
        while self.quiet and self.quiet[-1][0] >= at:
            place, before = self.quiet.pop()
            self.silent -= before is None
            if ended and place == at and before is not None:
                del self.blocks[before:]
        for t, _ in self.stack[at:]:
            self.open[t] -= 1
        del self.stack[at:]

    def _leave_open(self, tag):
        """Ends the silent elements whose end tag was left out before ``tag``."""
        for place, _ in self.quiet:
            name = self.stack[place][0]
            if name == "head":
                left = tag not in HEAD and (tag == "body" or place == self.quiet[-1][0])
            else:
                left = name == tag and tag not in NESTING
            if left:
                self.flush()
                self._pop(place)
                break

    def handle_starttag(self, tag, attrs):
        if self.quiet:
            self._leave_open(tag)
        if tag == "br":
            self.text.append(" ")
        if tag not in INLINE:
            self.flush()
            if tag in SELF_CLOSING or self.open["p"]:
                # a block-level tag ends an open p; li, td and so on end their like in the same container
                for k in range(len(self.stack) - 1, -1, -1):
                    t = self.stack[k][0]
                    if t == "p" or t == tag:
                        self._pop(k)
                        break
                    if t not in INLINE and t != "p":
                        break
            if self.silent and tag in BLOCK:
                self.silent = 0
                for element in self.quiet:
                    if element[1] is None:
                        element[1] = len(self.blocks)
        if tag in VOID:
            return
        names = " ".join((v or "").lower() for k, v in attrs if k in ("class", "id", "role"))
        self.open[tag] += 1
        self.stack.append((tag, SPACES.sub(" ", re.sub(r"[_\-]+", " ", names)).strip()))
        if tag in SILENT:
            self.quiet.append([len(self.stack) - 1, None])
            self.silent += 1

    def handle_startendtag(self, tag, attrs):
        if self.quiet:
            self._leave_open(tag)
        if tag == "br":
            self.text.append(" ")
        elif tag not in INLINE:
            self.flush()

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._pop(k, ended=True)
                break

    def handle_data(self, data):
        if self.quiet and self.stack[-1][0] == "head" and not data.isspace():
            self._pop(len(self.stack) - 1)
        if not self.silent:
            if self.blank and not data.isspace():
                self.path, self.blank = tuple(x for x in self.stack if x[0] not in INLINE and x[0] not in SILENT), False
            self.text.append(data)


def blocks_of(html: str | None) -> list[tuple[tuple, str]]:
    """``(path, text)`` of every leaf block in page order."""
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.blocks


def declared(blocks: list[tuple[tuple, str]]) -> np.ndarray:
    """Labels from the containers that the page declares: 1 is main text."""
    main = [any(t in ("article", "main") for t, _ in path) for path, _ in blocks]
    own = any(main)
    return np.array(
        [
            float((m or not own) and not any(t in BOILER_TAGS or (c and BOILER_WORDS.search(c)) for t, c in path))
            for m, (path, _) in zip(main, blocks, strict=True)
        ]
    )


def _hash(out: np.ndarray, token: str) -> None:
    h = zlib.crc32(token.encode("utf-8", "surrogatepass"))
    out[h % len(out)] += 1.0 if h >> 31 else -1.0


def _word_slot(word: str) -> int:
    """Place of a word's count: the first WORD_DIM add, the others subtract."""
    h = zlib.crc32(word.lower().encode("utf-8", "surrogatepass"))
    return h % WORD_DIM + (0 if h >> 31 else WORD_DIM)


class Slots(dict):
    """Word slots, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        slot = self[word] = _word_slot(word)
        return slot


def _path_vector(path: tuple) -> np.ndarray:
    v = np.zeros(PATH_DIM)
    for tag, names in path:
        _hash(v, tag)
        for name in names.split():
            _hash(v, f".{name}")
    return v


def features(blocks: list[tuple[tuple, str]], cache: dict | None = None) -> np.ndarray:
    n, d = len(blocks), PATH_DIM + WORD_DIM
    x = np.zeros((n, d + 3))
    if not n:
        return x
    seen = {} if cache is None else cache
    slots = seen.setdefault(None, Slots())
    paths, sizes, at, last, letters = [], [], [], [], []
    for path, text in blocks:
        v = seen.get(path)
        if v is None:
            if len(seen) > 10_000:
                seen.clear()
                seen[None] = slots
            v = seen[path] = _path_vector(path)
        paths.append(v)
        words = text.split()
        sizes.append(len(words))
        at += map(slots.__getitem__, words)
        last.append(text[-1] in ".!?")
        letters.append(sum(map(len, LETTERS.findall(text))) / len(text))
    x[:, :PATH_DIM] = paths
    size = np.array(sizes)
    counts = np.bincount(np.repeat(np.arange(n) * (2 * WORD_DIM), size) + np.array(at, np.int64), minlength=2 * WORD_DIM * n)
    counts = counts.reshape(n, 2, WORD_DIM)
    x[:, PATH_DIM:d] = (counts[:, 0] - counts[:, 1]) / np.sqrt(np.maximum(size, 1))[:, None]
    x[:, d], x[:, d + 1], x[:, d + 2] = np.log1p(size) / 4, last, letters
    return x


# --- the model -------------------------------------------------------------------


def new_model(seed: int = 7) -> dict[str, np.ndarray]:
    rng, d, h = np.random.default_rng(seed), PATH_DIM + WORD_DIM + 3, HIDDEN
    m = {"o": rng.normal(0, 0.1, 2 * h), "c": np.zeros(1)}
    for side in "fb":
        m |= {f"w{side}": rng.normal(0, 0.1, (d, 4 * h)), f"u{side}": rng.normal(0, 0.1, (h, 4 * h)), f"a{side}": np.zeros(4 * h)}
        m[f"a{side}"][h : 2 * h] = 1.0  # remember at first
    return m


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x, w, u, a):
    """Hidden states of one direction and what its gradient needs."""
    z, h, c, n = x @ w + a, np.zeros(HIDDEN), np.zeros(HIDDEN), HIDDEN
    hs, tape = np.zeros((len(x), HIDDEN)), []
    for t in range(len(x)):
        g = z[t] + h @ u
        s = _sigmoid(g[: 3 * n])
        i, f, o, k = s[:n], s[n : 2 * n], s[2 * n :], np.tanh(g[3 * n :])
        before, c = (h, c), f * c + i * k
        h = o * np.tanh(c)
        hs[t] = h
        tape.append((before, c, i, f, o, k))
    return hs, tape


def _back(x, u, tape, dh_out):
    dz = np.zeros((len(x), 4 * HIDDEN))
    dh, dc, du = np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros_like(u)
    for t in range(len(x) - 1, -1, -1):
        (h0, c0), c, i, f, o, k = tape[t]
        dh = dh + dh_out[t]
        tc = np.tanh(c)
        dc = dc + dh * o * (1 - tc * tc)
        dz[t] = np.concatenate([dc * k * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - k * k)])
        du += np.outer(h0, dz[t])
        dh, dc = u @ dz[t], dc * f
    return x.T @ dz, du, dz.sum(0)


def _march(z, u, rows, lengths, state):
    """Hidden states of several sequences in lock step, the longest first; ``rows(t, n)``
    are the rows of the first n sequences at step t.  ``state`` is carried on in place."""
    h, c = state
    n, out = HIDDEN, np.zeros((len(z), HIDDEN))
    for t in range(int(lengths[0]) if len(lengths) else 0):
        live = int(np.searchsorted(-lengths, -t, "left"))  # sequences longer than t
        at = rows(t, live)
        g = z[at] + h[:live] @ u
        s = _sigmoid(g[:, : 3 * n])
        c[:live] = s[:, n : 2 * n] * c[:live] + s[:, :n] * np.tanh(g[:, 3 * n :])
        h[:live] = s[:, 2 * n :] * np.tanh(c[:live])
        out[at] = h[:live]
    return out


def predict_pages(m, pages: list[list[tuple[tuple, str]]], cache: dict | None = None) -> list[np.ndarray]:
    """For each page's blocks the probabilities of main text.  Pages are read in lock
    step; a page of more than GROUP_BLOCKS is read in pieces with the state carried from
    one to the next, once from each end, so features of a bounded number are held."""
    order = sorted(range(len(pages)), key=lambda k: -len(pages[k]))
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    zeros = lambda k: (np.zeros((k, HIDDEN)), np.zeros((k, HIDDEN)))
    while order:
        if len(pages[order[0]]) > GROUP_BLOCKS:
            k = order.pop(0)
            blocks, one = pages[k], m["c"][0] + np.zeros(len(pages[k]))
            for side, weight, step in (("f", m["o"][:HIDDEN], 1), ("b", m["o"][HIDDEN:], -1)):
                state = zeros(1)
                for lo in range(0, len(blocks), GROUP_BLOCKS)[::step]:
                    z = features(blocks[lo : lo + GROUP_BLOCKS], cache) @ m[f"w{side}"] + m[f"a{side}"]
                    n = len(z)
                    rows = (lambda t, _: np.array([t])) if step == 1 else (lambda t, _, n=n: np.array([n - 1 - t]))
                    one[lo : lo + n] += _march(z, m[f"u{side}"], rows, np.array([n]), state) @ weight
            out[k] = _sigmoid(one)
            continue
        group, size = [], 0
        while order and (not group or size + len(pages[order[0]]) <= GROUP_BLOCKS):
            group.append(order.pop(0))
            size += len(pages[group[-1]])
        lengths = np.array([len(pages[k]) for k in group])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        x = features([b for k in group for b in pages[k]], cache)
        f = _march(x @ m["wf"] + m["af"], m["uf"], lambda t, n, s=starts: s[:n] + t, lengths, zeros(len(group)))
        b = _march(x @ m["wb"] + m["ab"], m["ub"], lambda t, n, e=ends: e[:n] - 1 - t, lengths, zeros(len(group)))
        p = _sigmoid(f @ m["o"][:HIDDEN] + b @ m["o"][HIDDEN:] + m["c"][0])
        for k, lo, hi in zip(group, starts, ends, strict=True):
            out[k] = p[lo:hi]
    return out


def predict(m, x) -> np.ndarray:
    """Probabilities of one sequence, as training sees them (tests compare the two)."""
    f, _ = _run(x, m["wf"], m["uf"], m["af"])
    b, _ = _run(x[::-1], m["wb"], m["ub"], m["ab"])
    return _sigmoid(f @ m["o"][:HIDDEN] + b[::-1] @ m["o"][HIDDEN:] + m["c"][0])


def gradient(m, x, y):
    f, tf = _run(x, m["wf"], m["uf"], m["af"])
    b, tb = _run(x[::-1], m["wb"], m["ub"], m["ab"])
    hs = np.concatenate([f, b[::-1]], axis=1)
    d = (_sigmoid(hs @ m["o"] + m["c"][0]) - y) / len(y)
    back = d[:, None] * m["o"]
    g = {"o": hs.T @ d, "c": np.array([d.sum()])}
    g["wf"], g["uf"], g["af"] = _back(x, m["uf"], tf, back[:, :HIDDEN])
    g["wb"], g["ub"], g["ab"] = _back(x[::-1], m["ub"], tb, back[::-1, HIDDEN:])
    return g


def train(pages: list[str], epochs: int = 4, rate: float = 0.01, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam over whole pages; deterministic for the same pages."""
    data = [(features(b), declared(b)) for b in map(blocks_of, pages) if b]
    m, rng = new_model(seed), np.random.default_rng(seed)
    first, second, step = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2)), None, 0
    first, second = first
    for _ in range(epochs):
        for at in rng.permutation(len(data)):
            step += 1
            for k, g in gradient(m, *data[at]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                m[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def main_texts(m, pages: list[str | None], cache: dict | None = None) -> list[str]:
    blocks = [blocks_of(html) for html in pages]
    kept = predict_pages(m, blocks, cache)
    return ["\n".join([text for (_, text), p in zip(b, k, strict=True) if p >= 0.5]) for b, k in zip(blocks, kept, strict=True)]


def main_text(m, html: str | None, cache: dict | None = None) -> str:
    return main_texts(m, [html], cache)[0]


def _extract(m):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            for at in range(0, b.num_rows, PAGES):
                part = b.slice(at, PAGES)
                texts = main_texts(m, part.column(2).to_pylist(), cache)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return run


def fit(pages: DataFrame, train_pages: int = 300, train_chars: int = 100_000, html_col: str = "html") -> dict[str, np.ndarray]:
    """Train on the ``train_pages`` distinct pages of at most ``train_chars`` characters
    with the least content hash: at most 30 MB reach the driver at the default bounds.
    Stops when none of them has a block and there are other pages to label."""
    size, key = F.length(html_col), F.xxhash64(html_col)
    fits = size.between(1, train_chars)
    least = [r["k"] for r in pages.where(fits).select(key.alias("k")).distinct().orderBy("k").limit(train_pages).collect()]
    sampled = fits & key.isin(least)
    rows = pages.where(sampled).select(key.alias("k"), F.col(html_col).alias("h")).distinct().collect()
    sample = [r["h"] for r in sorted(rows, key=lambda r: (r["k"], r["h"].encode("utf-8", "surrogatepass")))][:train_pages]
    if not any(map(blocks_of, sample)) and not pages.where((size > 0) & ~sampled).isEmpty():
        raise ValueError(f"no page to train on: none of {len(sample)} with at most {train_chars} characters has text")
    return train(sample)


def extract(pages: DataFrame, model: dict | None = None, html_col: str = "html", **options) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page.  Null or empty html gives empty
    text; ids and urls may be null; rows that repeat are each returned; an empty
    table gives an empty result."""
    model = model or fit(pages, html_col=html_col, **options)
    return pages.select("page_id", "url", F.col(html_col).alias("html")).mapInArrow(
        _extract(model), "page_id long, url string, text string, n_chars long"
    )


def op5_page_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
