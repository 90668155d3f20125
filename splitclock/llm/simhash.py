"""SimHash near-duplicates through a Gray-order hierarchical index.

A fingerprint has 64 bits; a bit is 1 where over half of the XXH64 hashes (seed 42) of the text's three-word shingles
have it. Texts whose fingerprints differ in at most three bits are linked, and links make components.

How links are found
-------------------
1. Equal fingerprints are one class; only classes are searched.
2. Of four 16-bit blocks at least one is equal in two fingerprints that differ in three bits, so a class goes to the
   four buckets (block, value). A bucket with over ``bucket`` classes is dealt again by four blocks of its remaining
   48 bits, by the same argument; nothing is dropped.
3. Inside a task the fingerprints of every bucket are sorted by Gray rank, so that neighbours share most bits. Eight
   neighbours make a node that holds the bits they all share; eight nodes make the next, up to the bucket. A query
   walks down from its bucket's node, adding the differences in the bits each child shares beyond its parent. A node
   over three differences is pruned whole; a node that cannot exceed three is linked whole, through one member.
4. A bucket emits at most one link per class, to the smallest class of its part; `components` joins the parts.

Cases: NULL and blank texts have fingerprint zero and are linked like any other; fewer than three words make one
shingle of all words; repeated rows with one doc_id keep their rows; an empty table gives no rows; rows with a NULL doc_id
keep a fingerprint and have no component; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitclock.llm.common import byte_texts, column, groups_of, local_components, numbers, whole_keys, written
from splitclock.llm.components import components

SEED = 42
FAN = 8


def shingle_hashes(text: bytes, words: int = 3) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words, A-Z lower-cased, repeats included."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= words:
        shingles = [b" ".join(w)]
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64, max(1, len(w) - words + 1))


def fingerprint(text: bytes) -> int:
    """The majority bits of the shingle hashes; 0 for a text without words."""
    return majority_bits(shingle_hashes(text))


def majority_bits(h: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id long, fp long): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t) for t in byte_texts(batch)), np.uint64, batch.num_rows)
            yield pa.record_batch([column(batch, "doc_id").cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def build_index(starts: np.ndarray, codes: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Levels of nodes over ``codes`` (sorted by bucket, then Gray rank; buckets begin at ``starts``), leaves first.

    A node has the bits that all its members share (``shared``), their values (``bits``), its first child and number
    of children, and its first leaf.
    """
    n = len(codes)
    level = {"all": codes, "any": codes, "leaf": np.arange(n), "size": np.ones(n, np.int64), "child": np.arange(n), "n": np.zeros(n, np.int64)}
    bounds, levels = starts, []
    while True:
        level["shared"], level["bits"] = ~(level["all"] ^ level["any"]), level["all"]
        level["free"] = 64 - np.bitwise_count(level["shared"]).astype(np.int64)
        levels.append(level)
        counts = np.diff(bounds)
        if (counts <= 1).all():
            return levels
        nodes = (counts + FAN - 1) // FAN
        up = np.append(0, np.cumsum(nodes))
        within = np.arange(up[-1]) - np.repeat(up[:-1], nodes)
        first = np.repeat(bounds[:-1], nodes) + within * FAN
        until = np.minimum(first + FAN, np.repeat(bounds[1:], nodes))
        level = {"all": np.bitwise_and.reduceat(level["all"], first), "any": np.bitwise_or.reduceat(level["any"], first), "leaf": level["leaf"][first], "size": np.add.reduceat(level["size"], first), "child": first, "n": until - first}
        bounds = up


def search(levels: list[dict[str, np.ndarray]], codes: np.ndarray, bucket: np.ndarray, most: int, chunk: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Links (query leaf, other leaf) that join everything within ``most`` differences in a bucket."""
    found_a, found_b = [], []
    for level in levels[1:]:  # a node with so few free bits holds leaves that are all within the distance
        tight = np.flatnonzero((level["free"] <= most) & (level["size"] > 1))
        sizes = level["size"][tight]
        member = np.repeat(level["leaf"][tight], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        found_a.append(member)
        found_b.append(np.repeat(level["leaf"][tight], sizes))
    top = len(levels) - 1
    for at in range(0, len(codes), chunk):
        q = np.arange(at, min(at + chunk, len(codes)))
        node = bucket[q]
        root = levels[top]
        far = np.bitwise_count((codes[q] ^ root["bits"][node]) & root["shared"][node]).astype(np.int64)
        for depth in range(top, -1, -1):
            level = levels[depth]
            near = far <= most
            q, node, far = q[near], node[near], far[near]
            whole = far + level["free"][node] <= most
            found_a.append(q[whole])
            found_b.append(level["leaf"][node[whole]])
            q, node, far = q[~whole], node[~whole], far[~whole]
            if not depth or not len(q):
                break
            below, n = levels[depth - 1], level["n"][node]
            child = np.repeat(level["child"][node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            shared = np.repeat(level["shared"][node], n)
            q, far = np.repeat(q, n), np.repeat(far, n)
            far = far + np.bitwise_count((codes[q] ^ below["bits"][child]) & below["shared"][child] & ~shared).astype(np.int64)
            node = child
    return np.concatenate(found_a), np.concatenate(found_b)


def _bucket_links(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_keys(batches, ["key", "sub"], 1 << 18):
            key, sub, fp, rep = (part.column(c).to_numpy().astype(np.int64, copy=False) for c in ("key", "sub", "fp", "rep"))
            code = fp.view(np.uint64)
            order = np.lexsort((gray_rank(code), sub, key))
            key, sub, code, rep = key[order], sub[order], code[order], rep[order]
            starts = groups_of([key, sub])
            bucket = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            a, b = search(build_index(starts, code), code, bucket, most)
            # Leaves are renumbered by their class, so that the smallest class stands for its part.
            by_rep = np.argsort(rep, kind="stable")
            place = np.empty(len(rep), np.int64)
            place[by_rep] = np.arange(len(rep))
            root = local_components(len(rep), place[a], place[b])
            to = rep[by_rep][root]
            own = rep[by_rep]
            linked = to != own
            yield pa.record_batch([pa.array(own[linked]), pa.array(to[linked])], names=["a", "b"])

    return run


def _block(start: int, width: int):
    return F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def link_fingerprints(classes: DataFrame, most: int = 3, bucket: int = 50_000) -> DataFrame:
    """Links (a, b) between the classes (fp long, rep long) whose fingerprints differ in ``most`` <= 3 bits or fewer."""
    if not 0 <= most <= 3:
        raise ValueError("four blocks prove distances up to 3")
    dealt = classes.select("fp", "rep", F.explode(F.array(*[F.lit(b) for b in range(4)])).alias("block"))
    value = F.coalesce(*[F.when(F.col("block") == b, _block(16 * b, 16)) for b in range(4)])
    dealt = dealt.withColumn("key", F.col("block") * 65536 + value)
    full = dealt.groupBy("key").count().where(F.col("count") > bucket).select("key", F.lit(True).alias("hot"))
    dealt = dealt.join(full, "key", "left")
    # The other 48 bits, closed up, in four blocks of 12.
    low = F.lit(0).cast("bigint")
    rest = F.coalesce(
        *[
            F.when(F.col("block") == b, (low if b == 0 else _block(0, 16 * b)).bitwiseOR(low if b == 3 else F.shiftleft(_block(16 * b + 16, 48 - 16 * b), 16 * b)))
            for b in range(4)
        ]
    )
    subs = F.array(*[F.lit(4096 * (s + 1)).cast("bigint") + F.shiftrightunsigned(rest, 12 * s).bitwiseAND(F.lit(4095).cast("bigint")) for s in range(4)])
    dealt = dealt.select("fp", "rep", "key", F.explode(F.when(F.col("hot"), subs).otherwise(F.array(F.lit(0).cast("bigint")))).alias("sub"))
    sorted_ = dealt.repartition("key", "sub").sortWithinPartitions("key", "sub")
    return sorted_.mapInArrow(_bucket_links(most), "a long, b long")


def simhash_components(docs: DataFrame, most: int = 3, bucket: int = 50_000) -> DataFrame:
    """(doc_id long, fp long, component_id long) for every row of ``docs`` (doc_id, text)."""
    prints = written(fingerprints(docs), "fingerprints")
    classes = written(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    joined = components(link_fingerprints(classes, most, bucket))
    of_class = classes.join(joined, classes.rep == joined.id, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(of_class, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def simhash_query(spark, sf_dir: str) -> DataFrame:
    from splitclock.llm.common import table

    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
