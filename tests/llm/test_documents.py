"""Exact dedup, similarity join, packing and the pipeline against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from fluxloom.llm import best_fit, content_sort, language, ngram_join, tokens
from fluxloom.llm.components import components

from .conftest import ROWS

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def near(rows, threshold=0.8):
    """Links per row and the smallest identifier that links lead to, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    label, links = list(range(len(rows))), [0] * len(rows)

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if (len(sets[a] & sets[b]) / union if union else 1.0) >= threshold:
                links[a] += 1
                links[b] += 1
                label[max(root(a), root(b))] = min(root(a), root(b))
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(k)
    smallest = {r: min((i for i in (rows[k][0] for k in own) if i is not None), default=None) for r, own in groups.items()}
    return links, [smallest[root(k)] for k in range(len(rows))], len(groups)


def test_exact_dedup_matches_brute_force(spark, messy):
    norm = [re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in ROWS]
    best = {}
    for (i, t), n in zip(ROWS, norm, strict=True):
        rank = (-len(t or ""), i is None, i or 0)
        best[n] = min(best.get(n, (rank, i)), (rank, i), key=lambda x: x[0])
    want = Counter((i, best[n][1], Counter(norm)[n], hashlib.sha256(n.encode()).hexdigest()) for (i, _), n in zip(ROWS, norm, strict=True))
    got = content_sort.mark_copies(messy).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(set(norm)) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_joins_groups_across_partitions(spark):
    rows = [(k, "hot text") for k in range(3000)] + [(5000 + k, f"text {k % 700}") for k in range(2000)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = content_sort.mark_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id < 3000} == {(0, 3000)}
    assert sum(r.kept for r in got) == 701 and len(got) == 5000


def test_borders_of_long_equal_texts_meet(spark):
    """Texts that share their lead and cross partition borders are compared in full."""
    lead = "same lead of all the texts here " * 40
    rows = [(k, lead + "x" * (k % 3)) for k in range(600)]
    kept = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(kept)
    try:
        spark.conf.set(kept, "false")
        got = content_sort.mark_copies(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)).collect()
    finally:
        spark.conf.set(kept, before)
    assert {(r.doc_id % 3, r.keep_id, r.group_size) for r in got} == {(0, 0, 200), (1, 1, 200), (2, 2, 200)}


def test_drop_copies_keeps_whole_rows(messy):
    left = content_sort.drop_copies(messy)
    assert left.columns == messy.columns
    norm = {re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in ROWS}
    assert sorted(re.sub("[\x20\x09-\x0d]", "", r.text or "") for r in left.select("text").collect()) == sorted(norm)


def test_near_groups_match_brute_force(messy):
    links, classes, _ = near(ROWS)
    got = ngram_join.near_groups(messy).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == Counter((i, c, n) for (i, _), c, n in zip(ROWS, classes, links, strict=True))


def test_near_groups_in_small_blocks(spark, monkeypatch):
    """A group of near copies larger than a block, where not all pairs are linked."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(30):
        words = list(base)
        words[(k * 4) % 120] = f"changed{k}"
        if k % 3 == 0:
            words[(k * 11 + 50) % 120] = f"more{k}"
        rows.append((k, " ".join(words)))
    links, classes, _ = near(rows)
    got = ngram_join.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {k: (c, n) for k, (c, n) in enumerate(zip(classes, links, strict=True))}


def test_overlaps_by_blocks_equal_set_sizes():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 900, rng.integers(1, 300))).astype(np.uint64) for _ in range(40)]
    got = ngram_join._overlaps(sets, np.arange(40), np.arange(40))
    assert all(got[a, b] == len(np.intersect1d(sets[a], sets[b])) for a in range(40) for b in range(40) if a != b)


def test_pruning_needs_more_matches_with_more_values():
    need = ngram_join.fewest(0.8)
    assert need == sorted(need) and need[0] > 0 and need[-1] < 0.8 * ngram_join.HASHES


def test_keep_one_leaves_one_of_each_group(messy):
    left = ngram_join.keep_one(messy)
    assert left.columns == messy.columns
    assert left.count() == near(ROWS)[2]


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (200, 200)] + [(300, 301 + k) for k in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100} | {301 + k: 300 for k in range(50)}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
def test_fill_packs_everything(sizes):
    bins, offsets = best_fit.fill(np.array(sizes), 64)
    by_bin = defaultdict(list)
    for s, b, o in zip(sizes, bins, offsets, strict=True):
        by_bin[b].append((o, s))
    for own in by_bin.values():
        at = 0
        for o, s in sorted(own):
            assert o == at
            at += s
        assert at <= 64
    assert len(by_bin) <= len(best_fit._best_fit(sizes, 64))


def test_search_has_no_limit_on_pieces_of_a_bin():
    """Bins of more than 24 pieces take part in all exchanges; the search ends only when nothing gains."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(9, 33, 3000)
    bins, _ = best_fit.fill(sizes, 1024)
    assert len(set(bins)) == -(-int(sizes.sum()) // 1024)


def test_local_search_empties_a_bin_that_best_fit_leaves():
    sizes = [6, 5, 5, 4, 4, 3, 3]  # 30 tokens in bins of 10: best fit needs 4 bins at most, 3 are enough
    assert len(set(best_fit.fill(np.array(sizes), 10)[0])) == 3


def test_packing_of_messy_documents(messy, spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    strange = [(900, "a <|endoftext|> b"), (901, "<|endoftext|><|endoftext|>"), (902, "<|endoftext| >")]
    messy = messy.select("doc_id", "text").unionByName(spark.createDataFrame(strange, "doc_id bigint, text string"))
    for i, t in ROWS + strange:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        at = [0, *range(first, len(ids), 1024), len(ids)]
        want.update((i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(at, at[1:], strict=False)))
    got = best_fit.pack_documents(messy).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    rooms = defaultdict(list)
    for r in got:
        rooms[r.sequence_id].append((r.offset, r.length))
    for own in rooms.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024
    assert len(rooms) <= -(-sum(r.length for r in got) // 1024) + 1


def test_sequences_hold_the_pieces(messy):
    pieces = best_fit.cut_pieces(messy, capacity=64, with_ids=True)
    placed = best_fit.pack(pieces, 64)
    whole = {r.sequence_id: bytes(r.ids) for r in best_fit.sequences(placed).collect()}
    for r in placed.collect():
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


def test_byte_bpe_equals_the_tokenizers_library():
    from tokenizers import Tokenizer
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = tokens.byte_bpe(tokens.default_path())
    for text in ["", " ", "a  b\n\n c \t", "don't <|endoftext|> 12½ é́ 日本 😀", " lead", "trail  ", "　x\x85y", *[t for _, t in ROWS if t]]:
        ids = own.ids(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.text(ids) == text


def test_empty_tables(none):
    for made in (content_sort.mark_copies(none), content_sort.drop_copies(none), ngram_join.near_groups(none), ngram_join.keep_one(none), best_fit.pack_documents(none)):
        assert made.count() == 0


def test_pipeline_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    rejected = {r.doc_id for r in language.identify(spark.read.parquet(f"{SF}/documents.parquet")).where("rejected").collect()}
    docs = [d for d in docs if d[0] not in rejected]
    assert len(docs) > 190
    norm, best = lambda t: re.sub("[\x20\x09-\x0d]", "", t or ""), {}
    for i, t in docs:
        best[norm(t)] = min(best.get(norm(t), (0, i)), (-len(t or ""), i))
    docs = [d for d in docs if best[norm(d[1])][1] == d[0]]
    _, classes, _ = near(docs)
    want = {i for (i, _), c in zip(docs, classes, strict=True) if i == c}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == want


def test_stages_keep_the_columns(messy, spark):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, messy, SF).columns == messy.columns


def test_pipeline_stages_on_empty_documents(none, spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


@pytest.mark.parametrize("n", [1, 2, 10])
def test_rows_of_one_class(spark, n):
    rows = [(k, "only one text with several words in it") for k in range(n)]
    got = ngram_join.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all((r.class_id, r.n_links, r.n_copies) == (0, n - 1, n) for r in got) and sum(r.kept for r in got) == 1
