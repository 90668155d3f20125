"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language knows every string of that text. A document is parsed greedily into the
longest strings that a language knows; the fewer phrases, the closer the language. With a training text of N characters the
normalised number is phrases * log2(N) / characters, an estimate of the cross entropy, and the least one wins.

* Training text is a bounded sample: for each language the rows are dealt into ``groups`` groups by a hash of their text, and
  each group gives one whole text (up to ``longest`` characters; a longer one is cut only if the group has no other). This is one
  aggregate, and no group holds more than one text. Only text and language of the rows are used.
* Documents are parsed whole, in pieces of `PIECE` characters whose border ends a phrase. All pieces of a block advance
  together, one character a step, through the automata as transition tables, so a step is a few array operations.

Cases: NULL texts and texts without a letter are `und` with score 0, as is everything if there is no training text; of equal
languages the first by name wins; repeated rows are judged alike; an empty table gives no rows; rows without a doc_id are held
out; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitclock.llm.common import column, table, texts

PIECE = 1024
BLOCK = 1 << 21
_LETTER = regex.compile(r"\p{L}")


def suffix_automaton(text: list[int], letters: int) -> np.ndarray:
    """The transitions (states x letters, -1: none) of the automaton of all substrings of ``text``."""
    ways: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        state = len(ways)
        ways.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in ways[p]:
            ways[p][c] = state
            p = link[p]
        if p >= 0:
            q = ways[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                copy = len(ways)
                ways.append(dict(ways[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and ways[p].get(c) == q:
                    ways[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    out = np.full((len(ways), letters), -1, np.int32)
    for s, w in enumerate(ways):
        if w:
            out[s, list(w)] = list(w.values())
    return out


class Model:
    """Automata of several languages over one alphabet: the frequent letters, one sign for other letters, one for the rest."""

    def __init__(self, samples: dict[str, list[str]], alphabet: int = 254):
        self.langs = sorted(samples)
        lowered = {lang: [t.lower() for t in samples[lang]] for lang in self.langs}
        counts = Counter(c for ts in lowered.values() for t in ts for c in t if c.isalpha())
        chosen = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:alphabet]]
        self.letters = len(chosen) + 2
        # 0: no letter, 1: a letter (category L)
        self.classes = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint8, 0x110000)
        for k, c in enumerate(chosen):
            self.classes[ord(c)] = k + 2
        self.tables, self.sizes = [], []
        for lang in self.langs:
            text = np.concatenate([np.append(self.codes(t), 0) for t in lowered[lang]]).tolist()
            ways = suffix_automaton(text, self.letters)
            root = np.maximum(ways[0], 0)
            known = ways >= 0
            # States are multiplied by the number of letters; the sign bit says that a phrase ended before this letter.
            to = np.where(known, ways, root).astype(np.int64) * self.letters
            self.tables.append(np.where(known, to, to - (1 << 31)).astype(np.int32).ravel())
            self.sizes.append(len(text))

    def codes(self, text: str) -> np.ndarray:
        return self.classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def entropies(self, block: list[str]) -> np.ndarray:
        """Normalised phrases of each text in each language (infinite for an empty text)."""
        coded = [self.codes(t.lower()) for t in block]
        lengths = np.array([len(c) for c in coded])
        out = np.full((len(block), len(self.langs)), np.inf)
        if not lengths.sum():
            return out
        number = -(-lengths // PIECE)
        owner = np.repeat(np.arange(len(block)), number)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        size = np.minimum(PIECE, lengths[owner] - nth * PIECE)
        order = np.argsort(-size, kind="stable")
        owner, nth, size = owner[order], nth[order], size[order]
        base = (np.cumsum(lengths) - lengths)[owner] + nth * PIECE
        flat = np.concatenate(coded)
        live = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")
        lanes = len(size)
        state = np.zeros((len(self.langs), lanes), np.int32)
        phrases = np.ones((len(self.langs), lanes), np.int32)
        for step, k in enumerate(live):
            c = flat[base[:k] + step].astype(np.int32)
            for lang, ways in enumerate(self.tables):
                v = ways[state[lang, :k] + c]
                phrases[lang, :k] -= v >> 31
                state[lang, :k] = v & 0x7FFFFFFF
        for lang, n in enumerate(self.sizes):
            total = np.bincount(owner, weights=phrases[lang], minlength=len(block))
            out[:, lang] = np.where(lengths > 0, total * np.log2(n + 1) / np.maximum(lengths, 1), np.inf)
        return out

    def predict(self, block: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and the share by which the second one needs more."""
        if not self.langs:
            return ["und"] * len(block), np.zeros(len(block))
        found = self.entropies(block)
        ranked = np.sort(found, axis=1)
        with np.errstate(invalid="ignore"):
            score = 1 - ranked[:, 0] / ranked[:, 1] if len(self.langs) > 1 else np.ones(len(block))
        first = found.argmin(axis=1)
        letters = np.array([bool(_LETTER.search(t)) for t in block], bool)
        langs = [self.langs[k] if ok else "und" for k, ok in zip(first, letters, strict=True)]
        return langs, np.where(letters, np.clip(np.nan_to_num(score), 0, 1), 0.0)


@lru_cache(maxsize=1)
def _model(samples: tuple[tuple[str, tuple[str, ...]], ...]) -> Model:
    """One model per worker process."""
    return Model({lang: list(own) for lang, own in samples})


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def training_texts(docs: DataFrame, groups: int = 16, longest: int = 4096) -> dict[str, list[str]]:
    """At most ``groups`` texts of at most ``longest`` characters for each language."""
    rows = docs.where("lang is not null").where(F.col("text").rlike(r"\p{L}"))
    h = F.xxhash64("text")
    n = F.length("text")
    least = F.min(F.struct((n > longest).alias("cut"), (n < 200).alias("short"), h.alias("h"), F.substring("text", 1, longest).alias("t")))
    found = rows.groupBy("lang", F.pmod(h, F.lit(groups)).alias("g")).agg(least.alias("x")).select("lang", "g", "x.t").collect()
    out: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["g"])):
        out.setdefault(r["lang"], []).append(r["t"])
    return out


def predicted(docs: DataFrame, samples: dict[str, list[str]]) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its text alone."""
    fixed = tuple((lang, tuple(own)) for lang, own in sorted(samples.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(fixed)
        for batch in batches:
            langs: list[str] = []
            scores: list[np.ndarray] = []
            block: list[str] = []
            size = 0
            for text in texts(batch):
                block.append(text)
                size += len(text)
                if size >= BLOCK:
                    own, score = model.predict(block)
                    langs += own
                    scores.append(score)
                    block, size = [], 0
            if block:
                own, score = model.predict(block)
                langs += own
                scores.append(score)
            if langs:
                yield pa.record_batch([column(batch, "doc_id").cast(pa.int64()), pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = training_texts(docs.where(~held_out()).select("text", "lang"))
    return predicted(docs, samples).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
