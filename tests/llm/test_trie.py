"""The prefix trie against plain Python: every beginning as a tuple."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitclock.llm import trie as module
from splitclock.llm.trie import PerfectHash, rebuilt, trie, trie_query

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rebuilt_plainly(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            by[conv].append((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}"), (role, text)))
    turns = {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in by.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    return out


def trie_plainly(rows):
    convs = rebuilt_plainly(rows)
    members = collections.defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        gain = (len(m) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += gain
    out = []
    for k, m in members.items():
        ends = sha(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k)))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], ends))
    return out


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA)
    extra = {c: F.lit(f"own {c}") for c in ("hi", "lo", "depth", "place", "held", "digest", "bytes", "family", "shard", "chunk", "n")}
    df.withColumns(extra).write.parquet(f"{tmp_path}/conversations.parquet")
    return [tuple(r[c] for c in NAMES) for r in trie_query(spark, str(tmp_path)).collect()]


def some(n, seed=1, longest=12):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        line = rng.randrange(4)
        for t in range(rng.randrange(1, longest)):
            text = f"turn {line} {t}" if rng.random() < 0.9 else f"é own {c}"
            rows.append((c * 3 - 7 if c % 9 else c, t, ["user", "assistant"][t % 2], text))
    return rows


AWKWARD = [
    (None, 0, "user", "nobody's"),
    (0, None, "user", "first"),
    (0, 1, None, "same"),
    (0, 1, None, "same"),
    (0, 1, None, None),
    (1, 0, "user", ""),
    (1, 0, "", "user"),
    (2, 0, None, None),
    (4, 5, "user", "x" * 50_000),
    (11, 0, "a", "bc"),
    (11, 1, "ab", "c"),
    (13, 0, "ab", "c"),
]


@pytest.mark.parametrize("rows", [AWKWARD, some(300), some(1), [(k, 0, "user", "all the same") for k in range(400)] + [(k, 1, "user", f"{k % 3}") for k in range(400)]])
def test_query_equals_plain_python(spark, rows, tmp_path):
    assert sorted(found(spark, rows, tmp_path), key=repr) == sorted(trie_plainly(rows), key=repr)


def test_a_conversation_of_many_chunks(spark, tmp_path):
    """Two long conversations that part late: over two chunks of turns, and a third that ends at a chunk's border."""
    n = 2 * module.CHUNK + 300
    rows = [(5, t, "user", f"t{t}") for t in range(n)] + [(10, t, "user", f"t{t}" if t < n - 200 else "other") for t in range(n)] + [(15, t, "user", f"t{t}") for t in range(module.CHUNK)]
    got = {(r[0], r[1]): r for r in found(spark, rows, tmp_path)}
    assert len(got) == n + 1 + 200
    size = [len(f"t{t}") for t in range(n)]
    saved = np.cumsum(([0] + [2 * s if t < module.CHUNK else s for t, s in enumerate(size[: n - 200])])[::-1])[::-1]
    for d in (0, 1, 5, module.CHUNK - 1, module.CHUNK, module.CHUNK + 1, 2 * module.CHUNK, 2 * module.CHUNK + 1, n - 200):
        row = got[5, d]
        assert row[3] == (3 if d <= module.CHUNK else 2) and row[5] == 2 and row[6] == saved[d], d
        assert row[4] == (2 if d == n - 200 else 1)
        assert row[7] == (sha("15") if d == module.CHUNK else sha(""))
    assert got[10, n][7] == sha("10") and got[5, n][7] == sha("5")


def test_no_conversations(spark, tmp_path):
    assert found(spark, [], tmp_path) == []
    assert found(spark, [(None, 1, "user", "x")], tmp_path / "none") == []


def test_general_interface(spark):
    """Turns from elsewhere, and the nodes' own digests."""
    turns = spark.createDataFrame([(1, 1, 1, "a", 3), (1, 1, 2, "b", 4), (2, 2, 1, "a", 3), (3, 3, 1, "c", 9)], "conv_id long, family long, depth long, digest string, bytes long")
    convs = spark.createDataFrame([(1, 1, 2), (2, 2, 1), (3, 3, 1), (4, 4, 0)], "conv_id long, family long, turns long")
    nodes = {(r.conv_id, r.depth): r for r in trie(turns, convs).collect()}
    assert set(nodes) == {(1, 0), (1, 1), (1, 2), (3, 1)}
    root = nodes[1, 0]
    assert (root.n_convs, root.n_children, root.n_leaves, root.saved, root.ends_sha256) == (4, 2, 2, 3, sha("4"))
    assert (nodes[1, 2].phi, nodes[1, 2].plo) == (nodes[1, 1].hi, nodes[1, 1].lo)


def test_rebuilt_turns_have_no_gaps(spark):
    rows = some(200, seed=4)
    turns, convs = rebuilt(spark.createDataFrame(rows, SCHEMA))
    want = rebuilt_plainly(rows)
    assert {r.conv_id: r.turns for r in convs.collect()} == {c: len(v) for c, v in want.items()}
    depths = collections.defaultdict(list)
    for r in turns.collect():
        depths[r.conv_id].append(r.depth)
    assert {c: sorted(d) for c, d in depths.items()} == {c: list(range(1, len(v) + 1)) for c, v in want.items() if v}


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 40_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    hi, lo = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, n, dtype=np.uint64)
    hi[: n // 3] = 7  # one half may be the same
    nodes = PerfectHash(hi, lo)
    assert sorted(nodes.slots(hi, lo).tolist()) == list(range(n))
    assert (nodes.slots(lo, hi) == -1).all()


def test_perfect_hash_refuses_equal_keys():
    with pytest.raises(ValueError):
        PerfectHash(np.array([1, 1], np.uint64), np.array([2, 2], np.uint64))
