"""The pipeline's near-dedup stage against plain Python."""

import collections
import itertools

import corpus_pipeline
import numpy as np
from edge import ROWS, documents, empty, prose

from splitclock.llm import near
from splitclock.llm.common import local_components, table


def shingles_plainly(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups_plainly(rows):
    """The group of each row: linked are rows of a Jaccard similarity of at least 0.8."""
    sets = [shingles_plainly(r[1]) for r in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    return local_components(len(rows), a, b)


def near_rows():
    """Texts of 200 words with words changed in the middle: 1 to 5 changes are near (at most 5 shingles each), 10 are not."""
    rows = []
    for k in range(12):
        words = prose(300 + k, 200).split()
        for copy, changes in enumerate((0, 1, 3, 4, 10)):
            w = list(words)
            for c in range(changes):
                w[10 + 18 * c] = f"new{copy}x{c}"
            rows.append((1000 + 10 * k + copy, " ".join(w), "en", "a", 1))
    return rows


def test_stage_drops_near_copies(spark, tiny):
    given = [tuple(r) for r in table(spark, tiny, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    for rows in (near_rows(), given):
        group = groups_plainly(rows)
        want = {min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group)}
        out = corpus_pipeline.simhash_dedup(spark, documents(spark, rows), tiny).collect()
        assert {r.doc_id for r in out} == want and len(want) < len(rows)


def test_keys_find_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    found = agreed = 0
    for _ in range(1500):
        h = np.unique(rng.integers(0, 1 << 63, 180, dtype=np.uint64))
        a, b = (near.least_values(np.sort(x)) for x in (h[:162], h[18:]))  # 144 of 180
        found += (near._keys(a) == near._keys(b)).any()
        agreed += (near.low_bytes(a) == near.low_bytes(b)).mean() >= near.LEAST
    assert found >= 0.99 * 1500 and agreed >= 0.999 * 1500


def test_pairs_of_a_large_key_are_dealt_in_blocks(spark, monkeypatch):
    """Every pair of the blocks of a key is compared in one task."""
    monkeypatch.setattr(near, "BLOCK", 8)
    rows = [(64, k, 10, bytes(168)) for k in range(50)] + [(96, 100, 10, bytes(168))]
    buckets = spark.createDataFrame(rows, "key long, cls long, n long, low binary")
    none = spark.createDataFrame([(1, 0)], "id long, component long")
    parts = collections.defaultdict(set)
    for r in near._dealt(buckets, none).collect():
        parts[r.key, r.one, r.two].add(r.cls)
    assert all(k == 64 for k, _, _ in parts) and max(map(len, parts.values())) < 40
    together = {(a, b) for own in parts.values() for a in own for b in own if a < b}
    assert len(together) == 50 * 49 // 2


def test_pairs_below_the_limit_are_never_rows(spark, tiny, monkeypatch):
    """A group whose members all agree in many MinHash values and yet lie below 0.8: its pairs, a square of its size, were rows of a
    join. The two that are near are still found."""
    rows = []
    base = [f"w{k}" for k in range(300)]
    for d in range(60):
        own = list(base)
        for k in range(8):
            own[12 + 35 * k] = f"own{d}x{k}"
        rows.append((d, " ".join(own), "en", "a", 1))
    rows.append((99, rows[40][1].replace("w299", "end"), "en", "a", 1))
    made = {}
    whole = near.written

    def kept(df, name):
        out = whole(df, name)
        made[name] = max(out.count(), made.get(name, 0))
        return out

    monkeypatch.setattr(near, "written", kept)
    monkeypatch.setattr(near, "PART", 16)
    out = corpus_pipeline.simhash_dedup(spark, documents(spark, rows), tiny)
    assert {r.doc_id for r in out.collect()} == set(range(60))
    group = groups_plainly(rows)
    assert len(set(group)) == 60
    assert made["pairs"] < 60 * 59 // 4


def test_stage_keeps_one_row_of_each_group(spark, tiny):
    copy = prose(400, 150)
    rows = [*ROWS, *near_rows(), (None, prose(20, 100), "en", "b", 1), (None, copy, "en", "a", 1), (None, copy, "en", "a", 1), (77, copy, "en", "a", 1), (77, copy, None, "a", 1), (78, None, "en", "a", 1)]
    group = groups_plainly(rows)
    docs = documents(spark, rows)
    out = corpus_pipeline.simhash_dedup(spark, docs, tiny)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == docs.columns and len(got) == len(set(group))
    ids = collections.Counter(d for d, _ in got)
    assert ids[13] == 1 and ids[None] == 1 and ids[77] == 1 and ids[6] == 1 and not ids[7] and not ids[78]
    assert corpus_pipeline.simhash_dedup(spark, empty(spark), tiny).count() == 0
