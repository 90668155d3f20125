"""Operators on texts against plain Python, on the awkward table and on the smallest tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from edge import CLASHES, PASSAGE, ROWS, documents, empty, prose
from pyspark.sql import functions as F

from splitclock.llm import bpe, html_main, langid, packing, pii, quality, sharding, simhash, suffix
from splitclock.llm.common import local_components, table


def texts_of(spark, tiny):
    return [(r.doc_id, r.text) for r in table(spark, tiny, "documents").select("doc_id", "text").collect()]


# 3 -- byte-pair encoding


def test_bpe_equals_the_library(spark, tiny):
    from tokenizers import Tokenizer

    path = bpe.public_vocabulary()
    library, own = Tokenizer.from_file(path), bpe.Encoder(path)
    given = [t or "" for _, t in texts_of(spark, tiny)] + [r[1] or "" for r in ROWS] + ["a" * 5000, "thethethe" * 300, "!" * 999, "it's I'LL <|startoftext|><|endoftext|>x\x1c\x85\xa0y", "Αγάπη ΣΑΣ ὈΔΟΣ", "ȩ́ ﬀ Å"]
    ids = list(own.encode(given))
    for text, mine, theirs in zip(given, ids, library.encode_batch(given, add_special_tokens=False), strict=True):
        assert np.frombuffer(mine, "<u4").tolist() == theirs.ids, text[:60]
        assert own.decode(mine) == library.decode(theirs.ids, skip_special_tokens=False)


def test_bpe_verification_decides_as_merging_does():
    vocabulary = bpe.Vocabulary(bpe.public_vocabulary())
    words = sorted({w for k in range(30) for w in prose(k, 60).replace(",", "").replace(".", "").split()} | {"thnttionea", "xyzzyq", "aaaaaaaaaa"})
    fast = dict(vocabulary.encode_words(words))
    accepted = 0
    for w in words:
        exact = vocabulary.merged(w.encode())
        assert exact == vocabulary._merged_long([*[vocabulary.byte_inner[b] for b in w.encode()[:-1]], vocabulary.byte_final[w.encode()[-1]]])
        assert fast[w] == np.array(exact, "<u4").tobytes()
        accepted += vocabulary.proposal(w.encode()) == exact
    assert 0 < accepted < len(words)


def test_bpe_merges_short_words_in_step(monkeypatch):
    vocabulary = bpe.Vocabulary(bpe.public_vocabulary())
    rng = np.random.default_rng(7)
    letters = [*"etaoinshrdlcumqxz!|'0é\u00dfñ中😀"]
    words = sorted({"".join(rng.choice(letters, n)) for n in rng.integers(1, 80, 3000)} | {"a" * n for n in range(1, 70)} | {"tion" * 16, "tion" * 17})
    exact = {w: vocabulary.merged(w.encode()) for w in words}
    alone = []
    monkeypatch.setattr(vocabulary, "merged", lambda w: alone.append(len(w)) or exact[w.decode()])
    assert {w: np.frombuffer(x, "<u4").tolist() for w, x in vocabulary.encode_words(words)} == exact
    assert min(alone) > bpe.LONG and len(alone) < len(words) / 2


def test_bpe_rows(spark):
    rows = bpe.round_trip(documents(spark), bpe.public_vocabulary()).collect()
    assert len(rows) == len(ROWS) and {r.n_tokens for r in rows if r.doc_id in (6, 7, 8)} == {0}
    assert bpe.round_trip(empty(spark), bpe.public_vocabulary()).count() == 0


# 4 -- suffix sort


def cut_plainly(rows, length=200):
    count = collections.Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for d, t in rows:
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if mask[i] and (not i or not mask[i - 1]))
        out.append((d, len(t), sum(mask), spans, hashlib.sha256(bytes(x for x, m in zip(t, mask, strict=True) if not m)).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_equals_brute_force(spark, tiny, hot):
    awkward = [(r[0], (r[1] or "").encode()) for r in ROWS]
    for docs, rows in ((documents(spark), awkward), (table(spark, tiny, "documents"), [(d, (t or "").encode()) for d, t in texts_of(spark, tiny)])):
        got = suffix.cut_repeats(docs, hot=hot).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
        assert collections.Counter(map(tuple, got)) == cut_plainly(rows)


def test_suffix_rows_keep_their_columns(spark):
    docs = documents(spark)
    out = suffix.without_repeats(docs)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert PASSAGE not in rows[4].text and rows[6].text is None and rows[11].text == "one two" and rows[1].text == ""
    assert rows[4].n_chars == len(rows[4].text) and rows[10].text == "" and all(rows[4][c] == f"own {c}" for c in CLASHES)
    assert suffix.without_repeats(empty(spark)).count() == 0 and suffix.cut_repeats(empty(spark)).count() == 0


def test_suffix_sort_survives_hash_collisions():
    data = np.frombuffer(b"abcabdabc" * 30, np.uint8)
    s = suffix.Suffixes(data, 6)
    at = np.arange(len(data) - 5)
    want = {i for i in at if sum(data[i : i + 6].tobytes() == data[j : j + 6].tobytes() for j in at) > 1}
    assert set(s.repeated(at, np.array([0, len(at)])).tolist()) == want
    ordered = [data[i : i + 6].tobytes() for i in s.sort(at, np.array([0, len(at)]))]
    assert ordered == sorted(ordered)
    s.sums[:] = 0  # every hash collides now
    assert set(s.repeated(at, np.array([0, len(at)])).tolist()) == want


# 5 -- sharding


def test_flow_moves_the_least():
    supply, demand = [10, 2, 0, 9], [4, 4, 4, 4, 5]
    flow = sharding.cheapest_flow(supply, demand, {i: i for i in range(4)})
    assert [sum(x for (i, _), x in flow.items() if i == k) for k in range(4)] == supply
    assert [sum(x for (_, j), x in flow.items() if j == k) for k in range(5)] == demand
    assert sum(x for (i, j), x in flow.items() if i != j) == sum(max(0, s - d) for s, d in zip(supply, demand, strict=False))


def test_shards_are_even_and_whole(spark, tmp_path):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    plan = sharding.reshard(docs, sharding.by_source(16), 24, str(tmp_path / "a"))
    rows = spark.read.parquet(str(tmp_path / "a")).select("doc_id", "text", "old", "shard", "slot", "size").collect()
    assert collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter((r.doc_id, r.text) for r in docs.collect())
    held = collections.Counter()
    for r in rows:
        held[r.shard] += r.size
    mean = sum(held.values()) / 24
    assert len(held) == 24 and max(abs(x - mean) for x in held.values()) < 0.03 * mean
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    moved, planned = sum(r.size for r in rows if r.old != r.shard), sum(x for (i, j), x in plan.flow.items() if i != j)
    assert moved <= planned * 1.02


def test_sharding_edges(spark, tmp_path):
    docs = documents(spark)
    sharding.reshard(docs, sharding.by_source(2), 3, str(tmp_path / "b"))
    rows = spark.read.parquet(str(tmp_path / "b")).collect()
    assert len(rows) == len(ROWS) and {r.size_doc for r in rows} == {"own size"}
    sharding.reshard(empty(spark), sharding.by_source(2), 3, str(tmp_path / "c"))
    assert spark.read.schema("doc_id long, shard int").parquet(str(tmp_path / "c")).count() == 0
    # Nothing to move: no shard is written again.
    even = spark.createDataFrame([(k, "abcdefgh", "s", k % 2) for k in range(8)], "doc_id long, text string, source string, at int")
    sharding.reshard(even, F.col("at"), 2, str(tmp_path / "d"))
    assert spark.read.schema("doc_id long, shard int").parquet(str(tmp_path / "d")).count() == 0


def test_sharding_query_returns_shards_that_stay(spark, tmp_path):
    names = [f"s{k}" for k in range(200)]
    at = {r.source: r.at for r in spark.createDataFrame([(n,) for n in names], "source string").withColumn("at", sharding.by_source(16)).collect()}
    # One text lies around the middle of all bytes, so for some shard between 9 and 14 it stays where it is.
    stayed = 0
    for old in range(9, 15):
        source = next(n for n in names if at[n] == old)
        sf_dir = tmp_path / f"one{old}"
        documents(spark, [(1, "some text", "en", source, 9)]).write.parquet(str(sf_dir / "documents.parquet"))
        rows = sharding.sharding_query(spark, str(sf_dir)).collect()
        assert [(r.doc_id, r.size, r.slot) for r in rows] == [(1, 17, 0)]
        stayed += rows[0].shard == old
    assert stayed


# 6 -- quality rules


def statistics_plainly(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    count = collections.Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_statistics_equal_plain_python(spark, tiny):
    for docs, rows in ((documents(spark), [(r[0], r[1]) for r in ROWS]), (table(spark, tiny, "documents"), texts_of(spark, tiny))):
        got = quality.text_statistics(docs, "doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
        assert collections.Counter(map(tuple, got)) == collections.Counter((d, *statistics_plainly(t)) for d, t in rows)


def test_rules_separate_the_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    rows = quality.judged(docs, labels).join(labels, "doc_id").where("not base_failed").select("kept", "quality").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    assert sum(not r.kept for r in rows if r.quality == 0) > 0.95 * sum(r.quality == 0 for r in rows)


def test_quality_edges(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (6, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        kept = quality.keep_good(docs, labels)
        assert kept.columns == docs.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in ROWS if (s := statistics_plainly(r[1]))[0] >= 50 and 2 * s[4] <= s[0])
    assert quality.keep_good(empty(spark), none).count() == 0 and quality.judged(empty(spark), some).count() == 0


def test_rules_need_conjunctions(spark):
    """Only words that are long AND lines that repeat are bad; one threshold alone is not precise enough."""
    rows = [(100.0, a / 10, 0.0, b / 10, 0.0, int(a > 5 and b > 5), (a + b + k) % 3) for a in range(10) for b in range(10) for k in range(3)]
    found = quality.learn(spark.createDataFrame(rows, "n_words double, word_length double, symbols_per_word double, dup_line_share double, repeat_share double, bad int, fold int"))
    assert [sorted((x.statistic, x.above, round(x.threshold, 6)) for x in rule) for rule in found] == [[("dup_line_share", True, 0.55), ("word_length", True, 0.55)]]


# 7 -- packing


def fit_plainly(lengths, room):
    left = []
    for x in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(left) if r >= x]
        if fits:
            left[min(fits)[1]] -= x
        else:
            left.append(room - x)
    return sorted(left)


def test_best_fit_equals_one_by_one():
    import random

    rng = random.Random(7)
    for _ in range(150):
        room = rng.choice([9, 40, 100])
        lengths = [rng.randint(1, room) for _ in range(rng.randint(0, 150))]
        used, ranks = collections.Counter(), collections.Counter()
        for length, first, end, sequence, per, offset in packing.best_fit(collections.Counter(lengths), room):
            assert ranks[length] == first
            ranks[length] = end
            for k in range(end - first):
                assert used[sequence + k // per] == offset + k % per * length
                used[sequence + k // per] += length
        assert ranks == collections.Counter(lengths) and sorted(room - x for x in used.values()) == fit_plainly(lengths, room)


def test_pack_places_every_piece(spark):
    path = bpe.public_vocabulary()
    enc = bpe.Encoder(path)
    rows = packing.pack(documents(spark), path, room=64).collect()
    want = collections.Counter()
    for r in ROWS:
        ids = next(enc.encode([r[1] or ""])) + b"\1\0\0\0"
        want.update((r[0], k, at // 4, len(ids[at : at + 256]) // 4, zlib.crc32(ids[at : at + 256])) for k, at in enumerate(range(0, len(ids), 256)))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    ends = collections.Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 64 and len(ends) == len(fit_plainly([r.length for r in rows], 64))
    assert packing.pack(empty(spark), path).count() == 0


# 8 -- SimHash


def fingerprint_plainly(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [50_000, 3])
def test_simhash_equals_brute_force(spark, tiny, bucket):
    for docs, rows in ((documents(spark), [(r[0], r[1]) for r in ROWS]), (table(spark, tiny, "documents"), texts_of(spark, tiny))):
        got = collections.Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.simhash_components(docs, bucket=bucket).collect())
        fps = [fingerprint_plainly(t) for _, t in rows]
        named = sorted((d, f) for (d, _), f in zip(rows, fps, strict=True) if d is not None)
        links = [(i, j) for i in range(len(named)) for j in range(i) if (named[i][1] ^ named[j][1]).bit_count() <= 3]
        a, b = np.array(links).reshape(-1, 2).T
        root = local_components(len(named), a, b)
        want = collections.Counter((d, f, named[r][0]) for (d, f), r in zip(named, root, strict=True))
        want.update((None, f, None) for (d, _), f in zip(rows, fps, strict=True) if d is None)
        assert got == want


def test_gray_index_equals_all_pairs():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([centre, *[centre ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(12)]]))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    levels = simhash.build_index(np.array([0, len(codes)]), codes)
    a, b = simhash.search(levels, codes, np.zeros(len(codes), np.int64), 3)
    assert (np.bitwise_count(codes[a] ^ codes[b]) <= 3).all()
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3
    assert (local_components(len(codes), a, b) == local_components(len(codes), *np.nonzero(near))).all()


# 2 -- language


def test_language_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = langid.language_query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)


def test_cross_parsing_equals_plain_greedy_parsing():
    model = langid.Model({"a": ["banana bandana", "an ant"], "b": ["xylo phone", "phony xerox"]})
    for text in ("bananas and phones", "xeroxed", "q", "an antique xylophone, " * 200):
        for k, lang in enumerate(model.langs):
            known = [model.codes(t) for t in {"a": ["banana bandana", "an ant"], "b": ["xylo phone", "phony xerox"]}[lang]]
            joined = b"".join(np.append(c, 0).astype(np.uint8).tobytes() for c in known)
            phrases = 0
            codes = model.codes(text).tobytes()
            for at in range(0, len(codes), langid.PIECE):
                phrases, open_ = phrases + 1, b""
                for c in codes[at : at + langid.PIECE]:
                    sign = bytes([c])
                    if open_ + sign in joined:
                        open_ += sign
                    else:  # the phrase ends; a sign that the language does not know opens the next one without a match
                        phrases, open_ = phrases + 1, sign if sign in joined else b""
            assert abs(model.entropies([text])[0, k] - phrases * np.log2(len(joined) + 1) / len(text)) < 1e-9


def test_language_edges(spark):
    docs = documents(spark)
    rows = langid.predicted(docs, langid.training_texts(docs)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (6, 7, 8)} == {"und"}
    assert {r.lang_pred for r in langid.predicted(docs, {}).collect()} == {"und"}
    assert langid.predicted(empty(spark), langid.training_texts(empty(spark))).count() == 0


# 10 -- personal data

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def base_plainly(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns(spark, tiny):
    import random

    rng = random.Random(3)
    given = [t or "" for _, t in texts_of(spark, tiny)] + [r[1] or "" for r in ROWS]
    given += ["".join(rng.choice("a1@.-+() 4é\n") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    given += ["a@b.c@d.e", "1.2.3.4.5.6.7.8", "x@y", "@a.b", "a@@b.c", "256.1.1.1 1.1.1.1", "+1234567890123456 +12345678"]
    for text in given:
        assert pii.base_spans(text)[0] == base_plainly(text), text[:80]


def test_field_finds_what_the_base_loses(spark):
    extra = [(100 + k, f"thon {a} erre, {b} and {c} the end.", "en", "a", 1) for k, (a, b, c) in enumerate([("bob@mail.example.com", "10.0.0.7", "4080166431094600"), ("+1 (269) 555-3296", "eve@x.example.org", "4524132264652876"), ("44.52.9.1", "4754123456789013", "+1 (311) 555-0001")] * 20)]
    rows = pii.personal_spans(documents(spark, [*ROWS, *extra])).collect()
    text = ROWS[12][1]
    found = next(r for r in rows if r.doc_id == 13)
    assert {(s.kind, text[s.start : s.end]) for s in found.added} == {(2, "4524132264652876"), (2, "4080166431094600"), (3, "+1 (269) 555-3296")}
    assert not any(r.added for r in rows if r.doc_id not in (13, None))


def test_segmentation_equals_all_segmentations():
    model = pii.Field().fit([("10.0.0.7", [(1, 0, 8)]), ("4080166431094600", [(2, 0, 16)]), ("+1 (269) 555-3296", [(3, 0, 17)]), ("12", []), ("a1b2", [])])
    region = "7 4080166431094600 +1 (269) 555-3296 10.0.0.7"
    atoms, ends = pii.lattice(region)

    def every(j):
        if not j:
            yield 0.0, []
            return
        for i, kind, features in ends[j]:
            for score, spans in every(i):
                yield score + model.score(features), spans + ([(kind, atoms[i][0], atoms[j - 1][1])] if kind >= 0 else [])

    best = max(every(len(atoms)))
    assert model.best(region) == best[1] and len(best[1]) == 3


def test_masking(spark):
    docs = documents(spark)
    out = pii.masked(docs)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and "bob@" not in rows[13].text and "[EMAIL]" in rows[13].text and rows[13].n_chars == len(rows[13].text)
    assert rows[6].text is None and rows[1].text == ROWS[0][1] and rows[1].n_chars == 10
    assert pii.masked(empty(spark)).count() == 0 and pii.personal_spans(empty(spark)).count() == 0


# 9 -- pages


def article_plainly(source):
    import html

    m = re.search(r"<article>(.*?)</article>", source, re.S)
    parts = re.split(r"</?(?:p|h1)>", m.group(1)) if m else []
    blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in parts]
    return "\n\n".join(b for b in blocks if b)


def test_pages_give_their_articles(spark):
    for r in html_main.html_query(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "html"), "page_id").collect():
        assert r.text == article_plainly(r.html) and r.n_chars == len(r.text)


def test_pages_without_label_elements(spark):
    pages = [r.html for r in table(spark, "/root/testdata/sf0.01", "pages").limit(120).collect()]
    weights = html_main.learned(pages[:60])
    for source in pages[60:]:
        assert html_main.main_text(source.replace("<article>", "<div>").replace("</article>", "</div>").replace("<div>", "<section>", 1), weights).split() == article_plainly(source).split()


def test_page_edges(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>a &lt;b&gt; &amp c<p>d\n e<script>x</p></script><form>f</form><div class='ad box'>g</div>"), (4, "u", "<" * 300), (5, "u", "<a b='x" * 99)], "page_id long, url string, html string").withColumn("text", F.lit("own"))
    weights = html_main.learned(html_main.labelled_sample(pages.select("html")))
    rows = {r.page_id: r.text for r in html_main.extracted(pages, weights).collect()}
    assert rows[1] == rows[2] == rows[5] == "" and rows[None] == "a <b> & c\n\nd e" and rows[4] == "<" * 300
    assert html_main.extracted(pages.limit(0), weights).count() == 0


def test_best_region_equals_all_regions():
    import random

    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-3.0, -1.0, 1.0, 2.0]) for _ in range(rng.randint(0, 12))]
        best = max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
        lo, hi = html_main.best_region(scores)
        assert abs(sum(scores[lo:hi]) - best) < 1e-9


def test_a_box_inside_an_article_costs_no_text():
    lead, rest = " ".join(["lead"] * 30), " ".join(["rest"] * 20)
    for box in ("<aside>" + "box " * 40 + "</aside>", "<div class='advert'><ul>" + "<li><a href='x'>box box</a></li>" * 40 + "</ul></div>", "<nav>" + "<p>box</p>" * 99 + "</nav>"):
        source = f"<body><nav>{'menu ' * 50}</nav><article><p>{lead}</p>{box}<p>{rest}</p></article><footer>{'foot ' * 50}</footer></body>"
        for weights in (html_main.Weights({}, {}), html_main.learned([source])):
            assert html_main.main_text(source, weights) == f"{lead}\n\n{rest}"


def test_wrappers_do_not_lose_the_article():
    words = " ".join(f"w{k}" for k in range(60))
    labelled = f"<html><body><nav class='menu'>Home About</nav><article><h1>T</h1><p>{words}</p></article><div class='sidebar'>{'x ' * 20}</div><footer>f g</footer></body></html>"
    for weights in (html_main.Weights({}, {}), html_main.learned([labelled] * 3)):
        for wrapper in ("layout with-sidebar", "page no-ads", "has-footer", "sidebar", "content comments", "menu"):
            page = f"<div class='{wrapper}'><article><p>{words}</p></article></div><div class='sidebar'>a b c</div>"
            assert html_main.main_text(page, weights) == words, wrapper
        # A form around the whole page, a title in the article's header, and a formula.
        page = f"<form><nav>menu</nav><article><header><h1>The title</h1></header><p>{words}</p><p>Let <math><mi>x</mi></math> be</p><form>name</form></article></form>"
        assert html_main.main_text(page, weights) == f"The title\n\n{words}\n\nLet x be"
    # Without a label element: a box with most of the page's words is no box.
    page = f"<div class='widget'><p>{words}</p></div><div class='sidebar'>a b c</div>"
    assert html_main.main_text(page, html_main.Weights({}, {})) == words


def test_numbers_and_signs_are_no_letters():
    texts = ["\u00bd", "\u00b2", "\u2167", "\U0001f600 12", "\u3007", "a\u00bd", "\u65e5"]
    model = langid.Model({"en": [prose(1, 80)], "xx": ["qqq zzz " * 20]})
    assert [bool(langid._LETTER.search(t)) for t in texts] == [False] * 5 + [True] * 2
    assert [int(model.codes(t).max() > 0) for t in ("\u00bd", "\U0001f600", "\u3007", "\u65e5")] == [0, 0, 0, 1]


def test_shards_cut_inside_equal_rows(spark, tmp_path):
    """A third of the rows equal, without an id, from seven sources."""
    rows = [(k, prose(k, 40), "en", f"s{k % 30}", 1) for k in range(2000)] + [(None, prose(5000, 40), "en", f"s{k % 7}", 1) for k in range(1000)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.sharding_query(spark, str(tmp_path)).collect()
    held = collections.Counter()
    for r in out:
        held[r.shard] += r.size
    assert len(out) == 3000 and len(held) == 24 and max(held.values()) < 1.05 * min(held.values())
    for s in held:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
