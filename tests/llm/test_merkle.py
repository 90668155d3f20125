"""The manifest against plain Python: trees built node by node."""

import hashlib
import zlib

import pytest
from edge import ROWS, documents, empty, prose
from pyspark.sql import functions as F

from splitclock.llm import merkle
from splitclock.llm.merkle import manifest, merkle_query
from splitclock.llm.places import placed


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_plainly(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree_plainly(base):
    """The root, and for each base node its siblings (left, right) level by level."""
    paths, at, level = [[] for _ in base], list(range(len(base))), base
    while len(level) > 1:
        for k, path in enumerate(paths):
            run = at[k] // 3 * 3
            path.append(("".join(level[run : at[k]]), "".join(level[at[k] + 1 : run + 3])))
            at[k] //= 3
        level = [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
    return level[0], paths


def manifest_plainly(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append((row[0], leaf_plainly(*row), row))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    tops, kept = [], []
    for name in names:
        leaves = sorted(by_source[name], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        top, paths = tree_plainly([x[1] for x in leaves])
        tops.append(top)
        kept.append((leaves, paths))
    root, outer = tree_plainly(tops)
    out = []
    for (leaves, paths), top, above in zip(kept, tops, outer, strict=True):
        for (doc, leaf, row), path in zip(leaves, paths, strict=True):
            now = leaf
            if doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 and row[1] is not None:
                now = leaf_plainly(row[0], row[1].replace("\n", ""), *row[2:])
            for a, b in path + above:
                now = sha(a + now + b)
            out.append((doc, leaf, top, root, sha("".join(a + b for a, b in path + above)), now, now == root))
    return out


def found(spark, rows, tmp_path, name):
    path = str(tmp_path / name)
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    return [tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in merkle_query(spark, path).collect()]


def many(n):
    """One source with most rows, more than two superblocks of it, and many sources with one row."""
    return [(k if k % 50 else None, f"a\nb {k % 7}", "en", "hot" if k % 4 else f"s{k}é", k) for k in range(n)]


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], [ROWS[5], ROWS[5], ROWS[5]], many(700)])
def test_query_equals_plain_python(spark, rows, tmp_path):
    assert sorted(found(spark, rows, tmp_path, "d"), key=repr) == sorted(manifest_plainly(rows), key=repr)


def test_many_superblocks(spark):
    """Superblocks of nine nodes: several rounds below and above the sources' tops."""
    rows = many(900)
    out = manifest(documents(spark, rows), levels=2).collect()
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in out]
    assert sorted(got, key=repr) == sorted([r[:5] for r in manifest_plainly(rows)], key=repr) and all(r.folded_root == r.root for r in out)


def test_proofs_fold_to_the_root_and_tampering_shows(spark):
    rows = [(k, prose(k, 20), "en", f"s{k % 3}", 1) for k in range(40)]
    docs = documents(spark, rows)
    out = manifest(docs, F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit("."))), proofs=True).collect()
    assert len({r.root for r in out}) == 1 and len({r.subroot for r in out}) == 3
    for r in out:
        assert merkle.fold(r.leaf, r.lefts, r.rights) == r.root
        assert sha("".join(a + b for a, b in zip(r.lefts, r.rights, strict=True))) == r.proof_sha256
        assert (r.folded_root == r.root) == (r.doc_id % 4 != 1)


def test_no_rows(spark, tmp_path):
    assert manifest(empty(spark)).count() == 0


def test_places_split_a_hot_group(spark):
    """A third of the rows under one key, all equal, lie in several parts and still get every place once."""
    rows = spark.range(3000, numPartitions=7).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 5).alias("k"), (F.col("id") * 0).alias("v"))
    out, groups = placed(rows, ["k"], ["v"])
    got = {}
    for r in out.collect():
        got.setdefault(r.k, []).append(r.place)
        assert r.held == (1000 if r.k is None else 400)
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(1000 if k is None else 400)) for k in (None, 0, 1, 2, 3, 4)}
    assert {r.k: r.held for r in groups.collect()} == {k: len(v) for k, v in got.items()}
