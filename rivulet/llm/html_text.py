"""Main text of web pages by a recurrent labeller of text blocks.

A page is cut into its leaf blocks in page order. Each block becomes a vector of its hashed tag path, hashed words and a
few measures; a bidirectional LSTM reads the whole sequence, so that every block is judged with the whole page in view.
It is trained with numpy on a bounded sample: pages of the table, labelled by their semantic tags, and pages of
other layouts put together from their words, labelled by construction.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The documented bounds of the training sample: pages of the table (only such up to so many characters), made pages.
SAMPLE_PAGES, SAMPLE_CHARS, MADE_PAGES = 150, 20_000, 600
PATH_BINS, WORD_BINS, MEASURES, HIDDEN = 256, 32, 8, 20
WIDTH = PATH_BINS + WORD_BINS + MEASURES
# Innermost ancestors of a block that are kept one by one (those around them once each), and blocks labelled together.
ANCESTORS, TOGETHER = 6, 6000

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^<>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|<[!?][^>]*>""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Fixed values of HTML.
RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "select")}
# A tag that closes itself; the slash at the end of a value without quotes is part of the value.
EMPTY = re.compile(r"""(?:^|[\s"'])/$""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strong strike sub
sup time tt u var acronym""".split())
CLOSES_P = frozenset("""address article aside blockquote center details dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5
h6 header hr li main menu nav ol p pre section table ul tr td th tbody""".split())
SIBLINGS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead"}, "td": {"tr"}, "th": {"tr"}, "option": set()}


class Block:
    """``path``: all non-inline ancestors, outermost first; beyond the innermost ones repeated names count once, at the last."""

    __slots__ = ("path", "text", "linked")

    def __init__(self, path: list[tuple[str, ...]], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in page order: white space as one space, references decoded, scripts and styles left out."""
    out: list[Block] = []
    # Open elements that are no inline ones, with their names and the distinct names down to them.
    stack: list[tuple[str, tuple[str, ...], tuple[tuple[str, ...], ...]]] = []
    open_count: dict[str, int] = {}
    parts: list[str] = []
    links = [0, 0]  # open links, characters inside links

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                around = stack[-ANCESTORS - 1][2] if len(stack) > ANCESTORS else ()
                out.append(Block([*around, *(n for _, n, _ in stack[-ANCESTORS:])], text, links[1]))
            parts.clear()
        links[1] = 0

    def pop_to(tag: str) -> None:
        while stack:
            name = stack.pop()[0]
            open_count[name] -= 1
            if name == tag:
                break
        links[0] = 0

    def say(text: str) -> None:
        parts.append(text)
        if links[0]:
            links[1] += len(text)

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag in INLINE:
            if tag == "a":
                links[0] = 0 if closing else 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        flush()
        if closing:
            if open_count.get(tag):
                pop_to(tag)
            continue
        if tag in RAW:
            end = RAW[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID or EMPTY.search(attributes):
            continue
        if tag in CLOSES_P and open_count.get("p"):
            pop_to("p")
        if tag in SIBLINGS and open_count.get(tag):
            for name, _, _ in reversed(stack[-2 * ANCESTORS:]):
                if name in SIBLINGS[tag]:
                    break
                if name == tag:
                    pop_to(tag)
                    break
        words = " ".join("".join(x) for x in NAMES.findall(attributes)).lower() if attributes else ""
        names = (tag, *(f".{w}" for w in re.findall(r"[a-z]+[01]?", words)))
        trail = stack[-1][2] if stack else ()
        if not trail or trail[-1] != names:
            trail = (*(x for x in trail if x != names), names)
        stack.append((tag, names, trail))
        open_count[tag] = open_count.get(tag, 0) + 1
    flush()
    return out


class Bins(dict):
    """Bin and sign of a hashed name, found once."""

    def __init__(self, bins: int):
        super().__init__()
        self.bins = bins

    def __missing__(self, name) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[name] = crc32(repr(name).encode()) % self.bins
        return h


def vectors(page: list[Block], paths: Bins, words: Bins) -> np.ndarray:
    """One row per block."""
    x = np.zeros((len(page), WIDTH), np.float32)
    for k, b in enumerate(page):
        row = x[k]
        for names in b.path:
            for name in names:
                row[paths[name]] = 1.0
        for up, names in enumerate(b.path[:-4:-1]):
            row[paths[("leaf", "up", "upper")[up], names[0]]] = 1.0
        tokens = b.text.split(" ")
        found = np.bincount(np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens)), minlength=WORD_BINS)
        row[PATH_BINS:PATH_BINS + WORD_BINS] = 0.3 * found / np.sqrt((found * found).sum())
        size = len(b.text)
        row[PATH_BINS + WORD_BINS:] = (
            np.log1p(size) / 6, min(1.0, b.linked / size), len(tokens) < 4, size > 100, b.text[-1] in ".!?\"”»", b.text.count(",") > 0,
            k / len(page), 1.0)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one output per block. All sequences of a batch are padded to the longest."""

    def __init__(self, seed: int = 3):
        r = np.random.RandomState(seed)
        self.w = {}
        for side in "fb":
            self.w[f"x{side}"] = (r.randn(WIDTH, 4 * HIDDEN) / np.sqrt(WIDTH)).astype(np.float32)
            self.w[f"h{side}"] = (r.randn(HIDDEN, 4 * HIDDEN) / np.sqrt(HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN:2 * HIDDEN] = 1  # remember at first
            self.w[f"c{side}"] = bias
        self.w["o"] = (r.randn(2 * HIDDEN) / np.sqrt(HIDDEN)).astype(np.float32)
        self.w["d"] = (r.randn(WIDTH) / np.sqrt(WIDTH)).astype(np.float32)
        self.w["ob"] = np.zeros(1, np.float32)

    def _side(self, x: np.ndarray, live: np.ndarray, side: str, tape: bool):
        steps, n, _ = x.shape
        gates = x.reshape(-1, WIDTH) @ self.w[f"x{side}"] + self.w[f"c{side}"]
        gates = gates.reshape(steps, n, 4 * HIDDEN)
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, kept = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = gates[t] + h @ self.w[f"h{side}"]
            s = sigmoid(z[:, :3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = live[t][:, None]
            new_c = np.where(m, f * c + i * g, c)
            tanh_c = np.tanh(new_c)
            new_h = np.where(m, o * tanh_c, h)
            if tape:
                kept.append((t, h, c, i, f, o, g, tanh_c, m))
            h, c = new_h, new_c
            out[t] = new_h
        return out, kept

    def run(self, x: np.ndarray, live: np.ndarray, tape: bool = False):
        """Logits of [step, page, feature] input; with ``tape`` also what training needs of every step."""
        forward, kept_f = self._side(x, live, "f", tape)
        backward, kept_b = self._side(x, live, "b", tape)
        both = np.concatenate([forward, backward], axis=2)
        return both @ self.w["o"] + x @ self.w["d"] + self.w["ob"], both, kept_f, kept_b

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        logits, both, kept_f, kept_b = self.run(x, live, tape=True)
        p = sigmoid(logits)
        total = live.sum()
        loss = float(-(np.where(y > 0, np.log(p + 1e-7), np.log(1 - p + 1e-7)) * live).sum() / total)
        d = ((p - y) * live / total).astype(np.float32)
        grads = {"o": np.tensordot(d, both, ([0, 1], [0, 1])), "d": np.tensordot(d, x, ([0, 1], [0, 1])), "ob": np.array([d.sum()], np.float32)}
        d_both = d[:, :, None] * self.w["o"]
        for side, kept, d_out in (("f", kept_f, d_both[:, :, :HIDDEN]), ("b", kept_b, d_both[:, :, HIDDEN:])):
            wx, wh = np.zeros_like(self.w[f"x{side}"]), np.zeros_like(self.w[f"h{side}"])
            bias = np.zeros_like(self.w[f"c{side}"])
            dh = np.zeros_like(kept[0][1])
            dc = np.zeros_like(dh)
            for t, h, c, i, f, o, g, tanh_c, m in reversed(kept):
                dh_all = dh + d_out[t]
                dh_new = dh_all * m
                dc_new = (dc + dh_new * o * (1 - tanh_c**2)) * m
                dz = np.concatenate([dc_new * g * i * (1 - i), dc_new * c * f * (1 - f), dh_new * tanh_c * o * (1 - o), dc_new * i * (1 - g**2)], axis=1)
                wx += x[t].T @ dz
                wh += h.T @ dz
                bias += dz.sum(0)
                dh = dz @ self.w[f"h{side}"].T + dh_all * ~m
                dc = dc_new * f + dc * ~m
            grads |= {f"x{side}": wx, f"h{side}": wh, f"c{side}": bias}
        return loss, grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 14, batch: int = 32, rate: float = 0.012, seed: int = 4) -> None:
        r = np.random.RandomState(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for epoch in range(epochs):
            if epoch >= epochs * 2 // 3:
                rate *= 0.6
            order = sorted(range(len(pages)), key=lambda k: (len(pages[k][0]), k))
            groups = [order[k:k + batch] for k in range(0, len(order), batch)]
            for g in r.permutation(len(groups)):
                x, live = padded([pages[k][0] for k in groups[g]])
                y = np.zeros(live.shape, np.float32)
                for col, k in enumerate(groups[g]):
                    y[:len(pages[k][1]), col] = pages[k][1]
                _, grads = self.gradients(x, live, y)
                step += 1
                for k, v in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.w[k] = (self.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Which blocks of each page are main text; pages of like length are run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        group: list[int] = []
        for k in order + [-1]:
            if group and (k < 0 or len(pages[k]) * (len(group) + 1) > TOGETHER or len(pages[k]) > 1.5 * len(pages[group[0]]) + 8):
                x, live = padded([pages[q] for q in group])
                logits = self.run(x, live)[0]
                for col, q in enumerate(group):
                    out[q] = logits[:len(pages[q]), col] > 0
                group = []
            group.append(k)
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), WIDTH), np.float32)
    live = np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[:len(p), k] = p
        live[:len(p), k] = True
    return x, live


# Names that containers carry in the made pages: main text, and what surrounds it.
MAIN = ["article", "main", "div.content", "div.post", "div.entry-content", "div.article-body", "div.story", "section.main-content", "div.post-body",
        "article.post", "td.body", "div.text", "div.main", "div.page", "div.article", "div.body", "div", "section"]
AROUND = {
    "menu": ["nav", "div.menu", "div.navbar", "ul.navigation", "div.breadcrumbs", "div.tabs", "nav.main-nav", "div.topnav", "ul.links"],
    "head": ["header", "div.header", "div.masthead", "div.site-header", "div.topbar", "div.branding", "div.logo"],
    "foot": ["footer", "div.footer", "div.site-footer", "div.bottom", "div.copyright", "div.legal"],
    "side": ["aside", "div.sidebar", "div.related", "div.widget", "div.popular", "aside.right", "div.tags", "div.share", "div.social", "div.recommended"],
    "ad": ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.promo", "div.sponsored", "div.banner", "ins.ad"],
    "note": ["div.cookie", "div.notice", "div.consent", "div.alert", "div.popup", "div.newsletter", "div.cookie-banner", "div.gdpr", "div.modal"],
    "form": ["form", "form.login", "form.search", "div.subscribe", "form.contact", "fieldset"],
    "talk": ["section.comments", "div.comment", "div.comments", "ol.commentlist", "div.reply", "div.discussion", "ul.responses", "div.user-comments"],
}
# Containers that say nothing; they nest deep on ordinary pages.
NEUTRAL = ["div", "div.row", "div.col", "div.inner", "div.wrap", "div.box", "section", "div.grid", "div.container"]
INSIDE_MAIN = ("ad", "side", "talk", "form", "note")


def _open(spec: str, mark: str) -> tuple[str, str]:
    tag, _, name = spec.partition(".")
    return f'<{tag} class="{name} {mark}">', f"</{tag}>"


def made_pages(words: list[str], n: int = MADE_PAGES, seed: int = 11, deep: float = 0.3) -> list[str]:
    """Pages of random layouts over the given words; ``y1`` and ``y0`` among the names say what is main text.

    ``deep`` is the share of containers whose content is nested in up to 14 others.
    """
    r = random.Random(seed)

    def nested(inner: str) -> str:
        if r.random() >= deep:
            return inner
        pairs = [_open(r.choice(NEUTRAL), "") for _ in range(r.randint(4, 14))]
        return "".join(a for a, _ in pairs) + inner + "".join(b for _, b in reversed(pairs))

    def say(low: int, high: int) -> str:
        text = " ".join(r.choice(words) for _ in range(r.randint(low, high)))
        return text[:1].upper() + text[1:] + r.choice([".", ".", ".", "!", "?"])

    def around(kind: str) -> str:
        a, b = _open(r.choice(AROUND[kind]), "y0")
        if kind == "menu":
            item = r.choice(["<li><a href='/x'>{}</a></li>", "<a href='/y'>{}</a> | ", "<div><a href='#'>{}</a></div>"])
            inner = "".join(item.format(say(1, 2).rstrip(".!?")) for _ in range(r.randint(3, 9)))
            inner = f"<ul>{inner}</ul>" if r.random() < 0.6 else inner
        elif kind == "talk":
            inner = f"<h{r.randint(2, 4)}>{say(1, 3).rstrip('.!?')}</h3>" if r.random() < 0.6 else ""
            inner += "".join(f"<div><b>{r.choice(words)}</b><p>{say(3, 40)}</p></div>" for _ in range(r.randint(1, 4)))
        elif kind == "form":
            inner = f"<label>{say(1, 3)}</label><input name=q><p>{say(2, 12)}</p><button>{r.choice(words)}</button>"
        elif kind == "side":
            inner = f"<h3>{say(1, 4)}</h3>" + "".join(f"<li><a href='/z'>{say(2, 9)}</a></li>" for _ in range(r.randint(1, 5))) + (f"<p>{say(5, 30)}</p>" if r.random() < 0.5 else "")
        elif kind == "head":
            inner = f"<a href='/'>{say(1, 3)}</a>" + (f"<p>{say(2, 8)}</p>" if r.random() < 0.5 else "")
        elif kind == "foot":
            inner = f"&copy; {r.choice(words)} &middot; {say(2, 15)}" + (f"<p><a href='/i'>{say(1, 3)}</a></p>" if r.random() < 0.5 else "")
        else:
            inner = say(2, 25) if r.random() < 0.5 else f"<p>{say(3, 30)}</p>"
        return a + nested(inner) + b

    def code() -> str:
        lines = "\n".join(f"{r.choice(words)} = {r.choice(words)}{r.choice(['()', ' + 1', ''])}" for _ in range(r.randint(1, 6)))
        return f"<pre>{lines}</pre>" if r.random() < 0.5 else f"<pre><code>{lines}</code></pre>"

    def table() -> str:
        row = lambda cell, n: "<tr>" + "".join(f"<{cell}>{say(1, 3).rstrip('.!?')}</{cell}>" for _ in range(n)) + "</tr>"
        n = r.randint(2, 4)
        return "<table>" + row("th", n) + "".join(row("td", n) for _ in range(r.randint(1, 4))) + "</table>"

    def main() -> str:
        a, b = _open(r.choice(MAIN), "y1")
        inner = f"<h1>{say(3, 10)}</h1>" if r.random() < 0.8 else ""
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            inner += (f"<p>{say(8, 120)}</p>" if kind < 0.5 else f"<p>{say(1, 5)}</p>" if kind < 0.64 else f"<p><b>{say(5, 60)}<br><p>" if kind < 0.7
                      else f"<h2>{say(2, 6)}</h2>" if kind < 0.76 else "<ul>" + "".join(f"<li>{say(2, 20)}</li>" for _ in range(3)) + "</ul>" if kind < 0.81
                      else f"<blockquote>{say(5, 30)}</blockquote>" if kind < 0.84 else code() if kind < 0.88 else table() if kind < 0.92
                      else f"<figure><img src='/i'><figcaption>{say(2, 12)}</figcaption></figure>" if kind < 0.94
                      else f"<dl><dt>{say(1, 3)}</dt><dd>{say(2, 20)}</dd></dl>" if kind < 0.96 else around(r.choice(INSIDE_MAIN)))
        if r.random() < 0.3:
            inner += f"<p>{say(1, 4)}</p>"
        return a + nested(inner) + b

    out = []
    for _ in range(n):
        before = "".join(around(k) for k in ("note", "head", "menu", "ad", "form") if r.random() < 0.5)
        after = "".join(around(k) for k in ("side", "talk", "ad", "form", "foot", "note") if r.random() < 0.5)
        body = before + main() + after
        if r.random() < 0.3:
            body = f"<div class='wrapper container'>{body}</div>"
        end = "</body></html>" if r.random() < 0.9 else ""
        out.append(f"<!DOCTYPE html><html><head><title class='y0'>{say(3, 10)}</title></head><body>{body}{end}")
    return out


def labelled(page: str, made: bool) -> tuple[list[Block], np.ndarray]:
    """Blocks and labels: by the innermost mark of a made page, by the semantic tags of a real one."""
    found = blocks(page)
    y = np.zeros(len(found), np.float32)
    for k, b in enumerate(found):
        if made:
            marks = [n for names in b.path for n in names if n in (".y1", ".y0")]
            y[k] = bool(marks) and marks[-1] == ".y1"
        else:
            tags = [names[0] for names in b.path]
            y[k] = ("article" in tags or "main" in tags) and not {"nav", "aside", "footer", "header", "form"} & set(tags)
        b.path = [tuple(n for n in names if n not in (".y0", ".y1")) for names in b.path]
    return found, y


def train(pages: list[str]) -> Labeller:
    """Fit the labeller on pages with semantic tags and on made pages over their words."""
    real = [labelled(p, made=False) for p in pages]
    real = [(b, y) for b, y in real if y.any()]
    words = sorted({w for b, _ in real for x in b for w in x.text.split()[:60]}) or ["word", "other", "third"]
    examples = real + [labelled(p, made=True) for p in made_pages(words)]
    paths, bins = Bins(PATH_BINS), Bins(WORD_BINS)
    model = Labeller()
    model.fit([(vectors(b, paths, bins), y) for b, y in examples if b])
    return model


def sample(pages: DataFrame, html: str = "html", id: str = "page_id") -> list[str]:
    """A bounded sample of pages, chosen by a hash of their id among those of ordinary length."""
    # Ids first: the bound they give lets only the pages that are wanted leave the scan.
    order = F.xxhash64(F.col(id))
    usable = pages.where(F.length(html) <= SAMPLE_CHARS)
    bar = usable.select(order.alias("o")).orderBy("o").limit(SAMPLE_PAGES).agg(F.max("o")).first()[0]
    if bar is None:
        return []
    top = usable.where(order <= bar).select(F.col(html).alias("h"), order.alias("o"))
    return [r.h for r in top.orderBy("o", "h").limit(SAMPLE_PAGES).collect()]


def extract(pages: DataFrame, model: Labeller, html: str = "html", into: str = "text") -> DataFrame:
    """Add ``into``, the main text of the whole page; empty for null, empty or unlabelled pages.

    Other columns pass through, one named ``into`` is replaced.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(model.w)

    @F.arrow_udf("string")
    def main_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller, paths, words = Labeller(), Bins(PATH_BINS), Bins(WORD_BINS)
        labeller.w = shipped.value
        for batch in batches:
            out: list[str] = []
            for at in range(0, len(batch), 256):
                found = [blocks(p or "") for p in batch.slice(at, 256).to_pylist()]
                labels = labeller.label([vectors(b, paths, words) for b in found])
                out += [" ".join(x.text for x, keep in zip(b, y) if keep) for b, y in zip(found, labels)]
            yield pa.array(out, pa.string())

    return pages.withColumn(into, main_text(F.col(html)))


def main_texts(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` its main text and the length of it."""
    out = extract(pages.select("page_id", "url", "html"), train(sample(pages)))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
