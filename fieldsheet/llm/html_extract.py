"""Main text of web pages: boosted trees over DOM elements, decoded over the tree.

Every element gets features of itself, its subtree, its ancestors and siblings;
boosted trees, trained on made-up pages whose main text is known, give the odds
that its text is main text. Decoding takes for each element the best of keeping
its whole subtree, dropping it, or deciding child by child, so that no element
contradicts an ancestor that was kept or dropped whole.

Edge cases: a null or empty page, and one without main text, give an empty text;
broken markup is read as browsers read it, as far as text goes; an unclosed
comment hides the rest; depth and length have no limit; repeated rows repeat;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import pick, table
from .html_dom import SILENT, Page, names
from .html_pages import page

TRAIN_PAGES, SEED = 1200, 11
SPLIT_COST = 0.5
PAGES_AT_ONCE = 200
GOOD = frozenset("content article post entry story text body main blog prose".split())
#: Words in names of what isn't main text, by kind; a feature each.
BAD = [frozenset(x.split()) for x in (
    "ad ads advert advertisement banner sponsor sponsored promo promotion",
    "cookie notice alert gdpr consent popup modal overlay",
    "sidebar side widget related recommended trending popular complementary aside",
    "comment comments discussion reply replies responses response disqus",
    "share social tags breadcrumb breadcrumbs pagination pager author meta",
    "newsletter subscribe search login signup form contact",
    "footer bottom copyright legal header masthead topbar logo branding nav navbar menu navigation contentinfo",
)]
KINDS = {t: i for i, x in enumerate((
    "article main", "nav menu", "footer", "header", "aside", "form fieldset button select textarea label option input", "p", "h1 h2 h3 h4 h5 h6",
    "ul ol dl", "li dt dd", "a", "table thead tbody tr td th", "section", "div", "blockquote pre figure figcaption", "body html #root",
)) for t in x.split()}
OTHER = 16
DROP_TAGS, KEEP_TAGS = {1, 2, 4, 5}, {0}


class Batch:
    """Arrays over the elements of many pages, and their features."""

    def __init__(self, pages: list[Page], training: bool = False) -> None:
        self.pages = pages
        self.sizes = np.array([len(p.tags) for p in pages])
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        n = int(self.first[-1])
        offset = np.repeat(self.first[:-1], self.sizes)
        self.parent = np.concatenate([np.array(p.parents) for p in pages])
        self.parent = np.where(self.parent < 0, -1, self.parent + offset)
        self.end = np.concatenate([np.array(p.ends) for p in pages]) + offset
        self.kind = np.array([KINDS.get(t, OTHER) for p in pages for t in p.tags], dtype=np.int64)
        silent = np.array([t in SILENT for p in pages for t in p.tags])
        self.owner = np.concatenate([np.array(p.text_owner, dtype=np.int64) + f for p, f in zip(pages, self.first, strict=False)])
        stripped = [t.strip() for p in pages for t in p.texts]
        length = np.array([len(t) for t in stripped], dtype=float)
        stops = np.array([t.count(".") + t.count(",") + t.count("!") + t.count("?") for t in stripped], dtype=float)
        add = lambda v: np.bincount(self.owner, v, n) if len(v) else np.zeros(n)
        self.own = add(length)
        good, bad, self.keep = np.zeros(n), np.zeros((len(BAD), n)), np.full(n, -1)
        i = 0
        for p in pages:
            for a in p.attrs:
                if a and "=" in a:
                    found, keep = names(a)
                    if found:
                        w = set(found)
                        good[i] = bool(w & GOOD)
                        for k, b in enumerate(BAD):
                            bad[k, i] = bool(w & b)
                    if keep and training:
                        self.keep[i] = int(keep)
                i += 1
        self.text = self._sub(self.own)
        linked = self._sub(np.where(self._within(self.kind == 10), self.own, 0))
        count = (self.end - np.arange(n)).astype(float)
        root = np.repeat(self.first[:-1], self.sizes)
        self.depth = self._up(np.ones(n))
        drop_tag, keep_tag = (np.isin(self.kind, list(k)).astype(float) for k in (DROP_TAGS, KEEP_TAGS))
        siblings = np.bincount(np.maximum(self.parent, 0), self.parent >= 0, n)
        at = np.maximum(self.parent, 0)
        place = self._place()
        par_text = np.maximum(self.text[at], 1)
        sib_kind = np.bincount(at * (OTHER + 1) + self.kind, minlength=n * (OTHER + 1))[at * (OTHER + 1) + self.kind] if n else np.zeros(0)
        before = np.cumsum(self.own) - self.own
        self.x = np.stack([
            self.kind.astype(float), np.log1p(self.text), np.log1p(self.own), np.log1p(count), np.log1p(self.text / count), linked / np.maximum(self.text, 1),
            self._sub(add(stops)) / np.maximum(self.text, 1), np.minimum(self.depth, 30), self.text / np.maximum(self.text[root], 1), (before - before[root]) / np.maximum(self.text[root], 1),
            np.log1p(siblings[at]), place / np.maximum(siblings[at], 1), sib_kind / np.maximum(siblings[at], 1), self.text / par_text, self.kind[at].astype(float),
            good, self._up(good), *bad, self._up(bad.max(axis=0, initial=0)), drop_tag, self._up(drop_tag), self._up(keep_tag),
            self._sub(drop_tag) - drop_tag, self._sub(keep_tag) - keep_tag, (self.kind == 3) * 1.0,
        ], axis=1) if n else np.zeros((0, 30))
        self.silent = silent

    def _sub(self, v: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0.0], np.cumsum(v)])
        return c[self.end] - c[:-1]

    def _up(self, v: np.ndarray) -> np.ndarray:
        """The sum over an element and its ancestors: each one's value counts from its start to its end."""
        c = np.zeros(len(v) + 1)
        c[:-1] += v
        np.subtract.at(c, self.end, v)
        return np.cumsum(c)[:-1]

    def _within(self, v: np.ndarray) -> np.ndarray:
        return self._up(v.astype(float)) > 0.5

    def _place(self) -> np.ndarray:
        """The place of each element among its siblings."""
        by = np.argsort(self.parent, kind="stable")
        p = self.parent[by]
        start = np.concatenate([[True], p[1:] != p[:-1]]) if len(p) else np.zeros(0, bool)
        run = np.arange(len(p)) - np.maximum.accumulate(np.where(start, np.arange(len(p)), 0))
        out = np.zeros(len(p))
        out[by] = run
        return out

    def targets(self) -> np.ndarray:
        """The share of each element's text that is main text, on training pages."""
        state = np.zeros(len(self.keep))
        for i, k in enumerate(self.keep):
            state[i] = k if k >= 0 else (state[self.parent[i]] if self.parent[i] >= 0 else 0)
        return np.where(self.text > 0, self._sub(self.own * state) / np.maximum(self.text, 1e-9), state)

    def decode(self, logit: np.ndarray) -> np.ndarray:
        """Whether each element keeps the text that is directly its own."""
        gain = np.clip(logit, -8, 8)
        own = gain * np.log1p(self.own) * (self.own > 0)
        whole = self._sub(own)  # what keeping the subtree is worth; dropping it, the negative
        whole = (whole + 2 * gain).tolist()
        kids = np.abs(own).tolist()
        parent, n = self.parent.tolist(), len(logit)
        how = [0] * n
        for i in range(n - 1, -1, -1):
            w = whole[i]
            best, how[i] = (w, 1) if w >= 0 else (-w, -1)
            if self.end[i] > i + 1 and kids[i] - SPLIT_COST > best:
                best, how[i] = kids[i] - SPLIT_COST, 0
            if parent[i] >= 0:
                kids[parent[i]] += best
        out = np.zeros(n, dtype=bool)
        own = own.tolist()
        state = [0] * n
        for i in range(n):
            above = state[parent[i]] if parent[i] >= 0 else 0
            state[i] = above or how[i]
            out[i] = state[i] > 0 or (state[i] == 0 and own[i] > 0)
        return out & ~self.silent


@lru_cache(maxsize=1)
def model() -> Boosted:
    rng = random.Random(SEED)
    b = Batch([Page(page(rng)) for _ in range(TRAIN_PAGES)], training=True)
    use = b.text > 0
    return Boosted().fit(b.x[use], b.targets()[use], np.sqrt(1 + np.log1p(b.text[use])))


def extract(htmls: list[str | None], trees: Boosted) -> list[str]:
    out: list[str] = []
    for lo in range(0, len(htmls), PAGES_AT_ONCE):
        pages = [Page(h or "") for h in htmls[lo : lo + PAGES_AT_ONCE]]
        b = Batch(pages)
        kept = b.decode(trees.logit(b.x))
        for p, f in zip(pages, b.first.tolist(), strict=False):
            blocks: dict[int, list[str]] = {}
            for o, k, t in zip(p.text_owner, p.text_block, p.texts, strict=True):
                if kept[f + o]:
                    blocks.setdefault(k, []).append(t)
            lines = (" ".join("".join(x).split()) for x in blocks.values())
            out.append("\n".join(x for x in lines if x))
    return out


def main_text(pages: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of each page with its main ``text``."""
    d = pick(pages, *dict.fromkeys([*keep, "html"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name in keep)
    trees = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = extract(b.column("html").to_pylist(), trees)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(texts, pa.string())], [*keep, "text"])

    return d.mapInArrow(run, schema + ", text string")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages"), "page_id", "url")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


SQL: dict[str, str] = {}
