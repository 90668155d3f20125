r"""Personal data: base patterns, and a semi-Markov conditional random field that adds the spans they miss.

The base patterns take the leftmost match of a kind and drop it when its check fails, so they lose, for instance, a card number
right after an address, or a telephone number before a card number. The field looks at whole candidate spans instead:

* a region is a run of words that hold a digit or an ``@``; it is cut into atoms, runs of letters and digits or single
  other characters;
* a candidate span is up to `ATOMS` atoms that pass the check of a kind; its features are of the span as a whole: its digit
  groups, separators, first character and neighbours. Atoms outside spans have features of their own;
* the best segmentation of a region, boundaries and kinds together, comes from dynamic programming over spans of bounded
  length. Weights maximise the conditional likelihood, by forward-backward sums over all segmentations.

The labels are the base spans in a bounded sample of regions (``sample`` groups of a hash, one region each, chosen by
content); regions in which a long candidate failed its check are no examples. The model is a few dozen weights.
All texts are scanned once, whole; the spans of the field that touch no base span are added.

Cases: NULL and empty texts have no spans; texts of any length are scanned in linear time; without labelled regions only base
spans are found; repeated rows are treated alike; an empty table gives no rows; further columns are carried by `masked`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitclock.llm.common import column, table, texts, written

KINDS = ["email", "ip", "card", "phone"]
ATOMS = 16

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins where a run of digits begins; said so, a long run is looked at once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_MARK = re.compile(r"[0-9@]")
_BLANK = re.compile(r"\s")
_ATOM = re.compile(r"[^\W_]+|.", re.S)

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _small_parts(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _is_card(s: str) -> bool:
    digits = s.replace(" ", "").replace("-", "")
    return 16 <= len(digits) <= 19 and luhn(digits)


def _is_phone(s: str) -> bool:
    return 8 <= sum("0" <= c <= "9" for c in s) <= 15


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """The base spans by kind and start, and the long matches that failed their check."""
    found: list[Span] = []
    failed: list[tuple[int, int]] = []
    at, end = text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        start = at
        if m:
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                found.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    for kind, pattern, check in ((1, _IP, _small_parts), (2, _CARD, _is_card), (3, _PHONE, _is_phone)):
        if kind == 3 and "+" not in text:
            continue
        for m in pattern.finditer(text):
            if check(m.group()):
                found.append((kind, m.start(), m.end()))
            elif m.end() - m.start() >= 16 and " " in m.group():
                failed.append((m.start(), m.end()))
    return found, failed


def regions(text: str) -> list[tuple[int, int]]:
    """Runs of words, one blank apart, that hold a digit or an @."""
    out: list[tuple[int, int]] = []
    end = 0
    m = _MARK.search(text)
    while m:
        p = m.start()
        left = max(text.rfind(" ", end, p), text.rfind("\n", end, p), text.rfind("\t", end, p)) + 1 or end
        stop = _BLANK.search(text, p)
        right = stop.start() if stop else len(text)
        if out and left == end + 1 and text[end] == " ":
            out[-1] = (out[-1][0], right)
        else:
            out.append((left, right))
        end = right
        m = _MARK.search(text, end)
    return out


def _class(c: str) -> str:
    return "none" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "blank" if c.isspace() else c if c in ".,-+@()" else "other"


def _groups(s: str) -> str:
    return "-".join(str(min(len(g), 20)) for g in _DIGITS.findall(s))


def span_features(kind: str, region: str, start: int, end: int) -> list[str]:
    """Features of a whole candidate span."""
    s = region[start:end]
    before, after = _class(region[start - 1 : start]), _class(region[end : end + 1])
    out = [kind, f"{kind} before {before}", f"{kind} after {after}", f"{kind} starts {_class(s[0])}", f"{kind} blanks {min(s.count(' '), 4)}"]
    if kind != "email":
        out.append(f"{kind} groups {_groups(s)}" if kind in ("card", "phone") else f"{kind} digits")
    return out


def atom_features(atom: str) -> list[str]:
    """Features of an atom outside spans."""
    kind = _class(atom[0]) if len(atom) == 1 else "digits" if atom.isdigit() else "letters" if atom.isalpha() else "mixed"
    return ["out", f"out {kind} {min(len(atom), 20) if kind == 'digits' else ''}"]


def lattice(region: str) -> tuple[list[tuple[int, int]], list[list[tuple[int, int, list[str]]]]]:
    """The atoms of a region, and for each end (1 .. n atoms) the segments (begin atom, kind or -1, features)."""
    atoms = [m.span() for m in _ATOM.finditer(region)]
    ends: list[list[tuple[int, int, list[str]]]] = [[] for _ in range(len(atoms) + 1)]
    for j, (x, y) in enumerate(atoms):
        ends[j + 1].append((j, -1, atom_features(region[x:y])))
    fits = (
        lambda s: s.count("@") == 1 and s[0] in _LOCAL and all(c in _LOCAL for c in s[: s.index("@")]) and bool(_DOMAIN.fullmatch(s, s.index("@") + 1)),
        lambda s: bool(_IP.fullmatch(s)) and _small_parts(s),
        lambda s: bool(_CARD.fullmatch(s)) and _is_card(s),
        lambda s: s[0] in "+(" and bool(re.fullmatch(r"\+?[\x20().0-9-]+[0-9]", s)) and _is_phone(s),
    )
    for i, (x, _) in enumerate(atoms):
        if not (region[x].isascii() and (region[x].isalnum() or region[x] in "+(._%-")):
            continue
        for j in range(i, min(i + ATOMS, len(atoms))):
            y = atoms[j][1]
            if y - x < 6 or not region[y - 1].isalnum():
                continue
            s = region[x:y]
            if not s.isascii():
                break
            for k, fit in enumerate(fits):
                if fit(s):
                    ends[j + 1].append((i, k, span_features(KINDS[k], region, x, y)))
    return atoms, ends


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


class Field:
    """Weights of features; unknown features count nothing."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def score(self, features: list[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in features)

    def best(self, region: str) -> list[Span]:
        """The kinds and places of the spans in the best segmentation."""
        atoms, ends = lattice(region)
        if all(len(e) <= 1 for e in ends):
            return []
        best, back = [0.0] + [-math.inf] * len(atoms), [(0, -1)] * (len(atoms) + 1)
        for j in range(1, len(atoms) + 1):
            for i, kind, features in ends[j]:
                v = best[i] + self.score(features)
                if v > best[j]:
                    best[j], back[j] = v, (i, kind)
        out, j = [], len(atoms)
        while j:
            i, kind = back[j]
            if kind >= 0:
                out.append((kind, atoms[i][0], atoms[j - 1][1]))
            j = i
        return out[::-1]

    def fit(self, examples: list[tuple[str, list[Span]]], rounds: int = 60, rate: float = 0.5, decay: float = 0.002) -> Field:
        """Gradient ascent on the conditional log-likelihood with a quadratic penalty, AdaGrad steps."""
        known = []
        for region, spans in examples:
            atoms, ends = lattice(region)
            wanted = set(spans)
            used, gold = set(), []
            for j in range(1, len(ends)):
                for i, kind, features in ends[j]:
                    if kind >= 0 and (kind, atoms[i][0], atoms[j - 1][1]) in wanted:
                        gold.append(features)
                        used.update(range(i, j))
            if len(gold) < len(wanted):
                continue  # a label that no candidate has
            gold += [features for j in range(1, len(ends)) for i, kind, features in ends[j] if kind < 0 and j - 1 not in used]
            known.append((ends, gold))
        grown: dict[str, float] = {}
        for _ in range(rounds if known else 0):
            slope = {f: -decay * len(known) * w for f, w in self.weights.items()}
            for ends, gold in known:
                for features in gold:
                    for f in features:
                        slope[f] = slope.get(f, 0.0) + 1.0
                n = len(ends) - 1
                scores = [[self.score(x) for _, _, x in e] for e in ends]
                ahead, behind = [0.0] * (n + 1), [-math.inf] * n + [0.0]
                for j in range(1, n + 1):
                    ahead[j] = _logsum([ahead[i] + s for (i, _, _), s in zip(ends[j], scores[j], strict=True)])
                for j in range(n, 0, -1):
                    for (i, _, _), s in zip(ends[j], scores[j], strict=True):
                        v = behind[j] + s
                        behind[i] = v if behind[i] == -math.inf else _logsum([behind[i], v])
                for j in range(1, n + 1):
                    for (i, _, features), s in zip(ends[j], scores[j], strict=True):
                        p = math.exp(ahead[i] + s + behind[j] - ahead[n])
                        if p > 1e-6:
                            for f in features:
                                slope[f] = slope.get(f, 0.0) - p
            for f, g in slope.items():
                g /= len(known)
                grown[f] = grown.get(f, 0.0) + g * g
                if g:
                    self.weights[f] = self.weights.get(f, 0.0) + rate * g / (math.sqrt(grown[f]) + 1e-8)
        return self


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
_REGIONS = pa.list_(pa.struct([("start", pa.int64()), ("text", pa.string()), ("example", pa.bool_())]))
_FOUND = "base array<struct<kind:int,start:long,end:long>>, regions array<struct<start:long,text:string,example:boolean>>"


def _records(spans: list[Span]) -> list[dict]:
    return [{"kind": k, "start": s, "end": e} for k, s, e in spans]


def scan_text(text: str) -> tuple[list[Span], list[dict]]:
    if not _MARK.search(text):
        return [], []
    base, failed = base_spans(text)
    out = []
    for s, e in regions(text):
        part = text[s:e]
        if any(c.isdigit() or c == "@" for c in part):
            out.append({"start": s, "text": part, "example": not any(a < e and s < b for a, b in failed)})
    return base, out


def scanned(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep``, base spans and regions of every text."""
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [_FOUND])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = [], []
            for text in texts(batch):
                b, r = scan_text(text)
                base.append(_records(b))
                found.append(r)
            yield pa.record_batch([*[column(batch, c) for c in keep], pa.array(base, _SPANS), pa.array(found, _REGIONS)], names=[*keep, "base", "regions"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def learn(found: DataFrame, sample: int = 1024, longest: int = 400) -> Field:
    """A field from a bounded sample: of the regions of up to ``longest`` characters, the least one by content in each
    of ``sample`` groups of a hash."""
    rows = found.select("base", F.explode("regions").alias("r")).where(F.col("r.example") & (F.length("r.text") <= longest))
    own = F.filter("base", lambda s: (s["start"] >= F.col("r.start")) & (s["end"] <= F.col("r.start") + F.length("r.text")))
    labels = F.transform(own, lambda s: F.struct(s["kind"].alias("kind"), (s["start"] - F.col("r.start")).alias("start"), (s["end"] - F.col("r.start")).alias("end")))
    # Half of the groups are for regions with labels, so that rare kinds are among them.
    group = F.pmod(F.xxhash64("r.text"), F.lit(max(1, sample // 2))) * 2 + (F.size(own) > 0).cast("int")
    chosen = rows.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("r.text").alias("text"), labels.alias("labels"))).alias("x")).select("x.*").orderBy("text").collect()
    return Field().fit([(r["text"], [(s["kind"], s["start"], s["end"]) for s in r["labels"]]) for r in chosen])


def added_spans(field: Field, base: list[Span], found: list[dict]) -> list[Span]:
    """The field's spans that touch no base span."""
    out = []
    taken = sorted((s, e) for _, s, e in base)
    for r in found:
        near = [(s, e) for s, e in taken if s < r["start"] + len(r["text"]) and e > r["start"]]
        for kind, s, e in field.best(r["text"]):
            s, e = s + r["start"], e + r["start"]
            if not any(a < e and s < b for a, b in near):
                out.append((kind, s, e))
    return out


def decoded(found: DataFrame, field: Field, *keep: str) -> DataFrame:
    """``keep``, base and added spans."""
    weights = field.weights
    schema = ", ".join([f"`{c}` {found.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} array<struct<kind:int,start:long,end:long>>" for c in ("base", "added")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(weights)
        for batch in batches:
            added = []
            for base, own in zip(column(batch, "base"), column(batch, "regions"), strict=True):
                spans = [(s["kind"], s["start"], s["end"]) for s in base.as_py() or []]
                added.append(_records(added_spans(model, spans, own.as_py() or [])))
            yield pa.record_batch([*[column(batch, c) for c in keep], column(batch, "base"), pa.array(added, _SPANS)], names=[*keep, "base", "added"])

    return found.mapInArrow(run, schema)


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added) of every row: spans as kind (place in KINDS), start and end in code points."""
    found = written(scanned(docs, "doc_id"), "regions")
    return decoded(found, learn(found), "doc_id")


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in square brackets, and n_chars counted anew where there is such a
    column. Spans of different kinds that overlap are replaced together, named by the first."""
    field = learn(written(scanned(docs), "regions"))
    weights, names, schema = field.weights, docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(weights)
        for batch in batches:
            out, changed = [], []
            for value in column(batch, "text"):
                text = value.as_py()
                base, own = scan_text(text or "")
                spans = sorted((s, e, k) for k, s, e in base + added_spans(model, base, own))
                parts, at = [], 0
                for s, e, k in spans:
                    if s >= at:
                        parts += [text[at:s], f"[{KINDS[k].upper()}]"]
                    at = max(at, e)
                out.append("".join([*parts, text[at:]]) if spans else text)
                changed.append(bool(spans))
            columns = []
            for k, name in enumerate(names):
                own = batch.column(k)
                if name == "text":
                    own = pa.array(out, own.type)
                elif name == "n_chars":
                    own = pa.array([len(t) if c else n for t, c, n in zip(out, changed, own.to_pylist(), strict=True)], own.type)
                columns.append(own)
            yield pa.record_batch(columns, names=names)

    return docs.mapInArrow(run, schema)


def pii_query(spark, sf_dir: str) -> DataFrame:
    found = personal_spans(table(spark, sf_dir, "documents"))
    kind = F.array(*[F.lit(k) for k in KINDS])

    def digest(spans):
        return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.array_union("base", "added")).alias("spans"))


def _count(k: int):
    return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
