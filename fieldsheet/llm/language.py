"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is
parsed greedily into the longest phrases that occur in that language's text
(the cross parsing of Ziv and Merhav); the language that needs the fewest
phrases for the same symbols wins. The automata share one alphabet, and each covers
its language's own sample; phrases times log2(length of the sample) over symbols are
bits a symbol, which compare. A phrase of a very short sample costs ``LEAST_BITS``.

The greedy walk only moves forward, so an automaton becomes a table: from state
and symbol to the next state and to whether a phrase ended. All texts of a batch
walk together through all automata, a table lookup a symbol. In a text of more than
``BLOCK`` symbols a phrase ends after every so many too, for every language alike, so
that a few very long texts don't walk alone.

The alphabet has a symbol for each of the ``DIRECT`` commonest letters of the samples and
one for all between words; any other letter is spelt in hexadecimal, its UTF-16 units as
four symbols each, so that no two letters fall together, however many a script has.

The fit uses a bounded sample: ``DOCS`` documents a language (smallest hashes of
doc_id), ``SYMBOLS`` symbols of them. Everything else covers whole texts.

Edge cases: a null text or one without a letter is ``und`` with score 0; ties go
to the language that sorts first; languages are whatever values the labels have;
a null doc_id is in no held-out fold and not learned from; with nothing to learn
from every text is ``und``; rows repeat as in the input; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pick, table
from .quality import fold

FOLDS, HELD_OUT = 5, 0
DOCS, SYMBOLS = 48, 24_000
#: Symbols: 0 between words, 16 digits of letters that are spelt, and the commonest letters.
ALPHABET, DIGITS, DIRECT = 64, 16, 47
SPELT = 255
BLOCK = 2048
#: No phrase is cheaper, or a sample of a few symbols would describe any text in next to no bits.
LEAST_BITS = 10.0


class Automaton:
    """The suffix automaton of a sequence of symbols below ``ALPHABET``, as a walk table."""

    def __init__(self, symbols: list[int]) -> None:
        nxt: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        t = np.full((len(nxt), ALPHABET), -1, dtype=np.int32)
        for s, row in enumerate(nxt):
            for c, to in row.items():
                t[s, c] = to
        # Without a way on, a phrase ends and the symbol starts the next one. A symbol that the text
        # lacks is a phrase of its own: one more state, from which every symbol starts a phrase.
        alone = len(nxt)
        start = np.where(t[0] >= 0, t[0], alone)
        ended = np.vstack([t < 0, np.ones((1, ALPHABET), dtype=bool)])
        ended[0] = False  # at the root the first phrase, counted already, begins
        to = np.vstack([np.where(t < 0, start[None, :], t), start[None, :]])
        self.table = (to * 2 + ended).astype(np.int32).ravel()



def phrases(tables: list[np.ndarray], flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Phrases of each text by each automaton; text i is ``flat[starts[i]:][:lengths[i]]``, the texts by falling length."""
    offset = np.cumsum([0] + [len(t) for t in tables[:-1]])[:, None]
    table = np.concatenate(tables)
    state = np.zeros((len(tables), len(starts)), dtype=np.int64)
    count = np.ones((len(tables), len(starts)), dtype=np.int64)
    alive = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), side="left")
    for i, n in enumerate(alive.tolist()):
        to = table[(state[:, :n] << 6) + flat[starts[:n] + i] + offset]
        count[:, :n] += to & 1
        state[:, :n] = to >> 1
    return count


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which UTF-16 units are letters, or marks on them; halves of surrogate pairs count."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" or 0xD800 <= c < 0xE000 for c in range(65536)])


def alphabet(texts: list[str]) -> np.ndarray:
    """The symbol of each UTF-16 unit; ``SPELT`` for letters that are spelt."""
    units = np.frombuffer("".join(texts).lower().encode("utf-16-le", "surrogatepass"), dtype=np.uint16)
    found, n = np.unique(units[letters()[units]], return_counts=True)
    common = {int(c): 1 + DIGITS + i for i, c in enumerate(found[np.argsort(-n, kind="stable")][:DIRECT])}
    out = np.where(letters(), SPELT, 0).astype(np.uint8)
    for c in range(65536):
        low = chr(c).lower()
        if out[c] and len(low) == 1 and ord(low) in common:
            out[c] = common[ord(low)]
    return out


def encode(text: str, symbols: np.ndarray) -> np.ndarray:
    """Letters as symbols, what is between words as one 0."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype=np.uint16)
    s = symbols[units]
    if (s == SPELT).any():  # letters that are spelt are spelt in lower case
        units = np.frombuffer(text.lower().encode("utf-16-le", "surrogatepass"), dtype=np.uint16)
        s = symbols[units]
    keep = (s > 0) | (np.concatenate([[1], s[:-1]]) > 0) if len(s) else s > 0
    s, units = s[keep], units[keep]
    spelt = s == SPELT
    if not spelt.any():
        return s
    at = np.repeat(np.arange(len(s)), np.where(spelt, 4, 1))
    place = np.arange(len(at)) - np.searchsorted(at, at)
    digit = (units[at] >> (12 - 4 * place).astype(np.uint16)) & 15
    return np.where(spelt[at], 1 + digit, s[at]).astype(np.uint8)


class Model:
    def __init__(self, texts: dict[str, list[str]], symbols: int = SYMBOLS) -> None:
        self.langs = sorted(texts)
        self.symbols = alphabet([x for v in texts.values() for x in v]) if texts else np.zeros(65536, np.uint8)
        coded = {k: np.concatenate([encode(x + " ", self.symbols) for x in v])[:symbols] for k, v in texts.items()}
        self.lengths = [len(coded[k]) for k in self.langs]
        self.automata = [Automaton(coded[k].tolist()) for k in self.langs]

    def state(self) -> tuple:
        """Plain values and arrays, for broadcasting."""
        return self.langs, self.symbols, self.lengths, [a.table for a in self.automata]

    @classmethod
    def restore(cls, state: tuple) -> Model:
        m = cls.__new__(cls)
        m.langs, m.symbols, m.lengths, tables = state
        m.automata = [Automaton.__new__(Automaton) for _ in tables]
        for a, t in zip(m.automata, tables, strict=True):
            a.table = t
        return m

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        coded = [encode(t, self.symbols) if t else np.zeros(0, np.uint8) for t in texts]
        sizes = np.array([len(c) for c in coded], dtype=np.int64)
        found = np.zeros((len(self.langs), len(texts)))
        if sizes.sum() and self.langs:
            blocks = -(-sizes // BLOCK)
            owner = np.repeat(np.arange(len(texts)), blocks)
            starts = np.repeat(np.cumsum(sizes) - sizes, blocks) + BLOCK * (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
            lengths = np.minimum(BLOCK, np.repeat(np.cumsum(sizes), blocks) - starts)
            by = np.argsort(-lengths, kind="stable")
            for k, n in enumerate(phrases([a.table for a in self.automata], np.concatenate(coded), starts[by], lengths[by])):
                found[k] = np.bincount(owner[by], weights=n, minlength=len(texts))
        cost = np.maximum(np.log2(np.maximum(self.lengths, 2)), LEAST_BITS)
        out, score = [], []
        for i, t in enumerate(texts):
            if not self.langs or not t or not any(c.isalpha() for c in t):
                out.append("und")
                score.append(0.0)
                continue
            bits = found[:, i] * cost / max(1, sizes[i])
            best = int(np.argmin(bits))
            rest = np.exp2(-4 * (bits - bits[best]) * min(1.0, sizes[i] / 64))
            out.append(self.langs[best])
            score.append(float(1 / rest.sum()))
        return out, score


def fit(docs: DataFrame, per_language: int = DOCS, symbols: int = SYMBOLS) -> Model:
    d = pick(docs, "doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    d = d.where(F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = d.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).where(f"n <= {per_language}").select("doc_id", "lang", "n")
    rows = d.join(F.broadcast(ids), ["doc_id", "lang"]).collect()  # per_language rows a language
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.n, r.text)):
        texts.setdefault(r.lang, []).append(r.text)
    return Model(texts, symbols)


def identify(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` of each row with ``lang_pred`` and ``score``."""
    d = pick(docs, *dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name in keep)
    shared = d.sparkSession.sparkContext.broadcast(model.state())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.restore(shared.value)
        for b in batches:
            texts = b.column("text")
            done: tuple[list[str], list[float]] = ([], [])
            for lo in range(0, b.num_rows, 2000):
                for have, new in zip(done, m.predict(texts.slice(lo, 2000).to_pylist()), strict=True):
                    have += new
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(done[0], pa.string()), pa.array(done[1], pa.float64())], [*keep, "lang_pred", "score"])

    return d.mapInArrow(run, schema + ", lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs), "doc_id")
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


SQL: dict[str, str] = {}
