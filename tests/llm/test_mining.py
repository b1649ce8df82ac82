"""Phrases, spelling variants and URL filters against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.llm import phrases, queries, spelling, urls

from .conftest import ROWS

SF = "/root/testdata/sf0.001"


# --- phrases
@pytest.mark.parametrize("words, bits", [(2, 17), (2, 32), (5, 3), (5, 17), (5, 25), (5, 32)])
def test_filters_keep_phrases_and_counts(words, bits):
    layout, rng = phrases.Layout(words, bits), np.random.default_rng(bits)
    ids = rng.integers(0, 2**bits, (4000, words), dtype=np.uint64).astype(np.uint32)
    columns = layout.pack(ids)
    assert (layout.unpack(columns) == ids).all()
    columns, counts = phrases.counted(columns, rng.integers(1, 600, 4000))
    for block_bits in (0, 3):
        block = (columns[0] >> np.uint64(layout.widths[0] - block_bits)).astype(int) if block_bits else np.zeros(len(counts), int)
        for k in np.unique(block):
            own = block == k
            raw = phrases.to_filter([x[own] for x in columns], counts[own], layout.widths, block_bits)
            back, n = phrases.from_filter(raw, layout.widths, block_bits, int(k))
            assert all((a == b[own]).all() for a, b in zip(back, columns, strict=True)) and (n == counts[own]).all()


def brute_phrases(rows, least, top, covered=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang or "und"] += len(words)
            f.update((lang or "und", words[k : k + m]) for m in range(1, 6) for k in range(len(words) - m + 1))
    often = {p: a for (p, a) in f.items() if a >= least and len(p[1]) > 1}
    inside = defaultdict(int)
    for (lang, p), a in often.items():
        for m in range(2, len(p)):
            for k in range(len(p) - m + 1):
                inside[lang, p[k : k + m]] = max(inside[lang, p[k : k + m]], a)
    out = defaultdict(list)
    for (lang, p), a in often.items():
        if 100 * inside[lang, p] < covered * a:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, own in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1)}


TEXTS = [("en", "of the big red house. of the big red house; A b a b a b"), ("en", "Of the\tbig dog, of the"), (None, "a a a a a a a"), ("und", "a a"), ("de", None), ("de", ""), (None, None), ("x", " .,\n"), ("en", "é\u00a0x é\u00a0x \x1c \x1c")] * 3


@pytest.mark.parametrize("vocabulary", [400_000, 0])
def test_collocations_match_brute_force(spark, monkeypatch, vocabulary):
    monkeypatch.setattr(phrases, "VOCABULARY", vocabulary)
    monkeypatch.setattr(phrases, "FLUSH", 40)
    monkeypatch.setattr(phrases, "BLOCK", 16)
    docs = spark.createDataFrame([(k, *t) for k, t in enumerate(TEXTS)], "doc_id bigint, lang string, text string").withColumns({c: F.lit(1) for c in ("f", "ids", "word", "id", "k", "n")})
    for least, top, covered in ((3, 2000, 100), (2, 4, 60)):
        got = phrases.collocations(docs, top, least, covered).drop("cut").collect()
        assert {tuple(r) for r in got} == brute_phrases(TEXTS, least, top, covered) and len(got) > 4


def test_collocations_of_messy_and_empty_documents(messy, none):
    rows = [(r.lang, r.text) for r in messy.collect()]
    got = phrases.collocations(messy, least=2).drop("cut").collect()
    assert {tuple(r) for r in got} == brute_phrases(rows, 2, 2000)
    assert phrases.collocations(none).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    score = spark.range(1).selectExpr("(cast(1000 * 900000000000000 as decimal(18,0)) * cast(99999999999999999 as decimal(18,0))) div (cast(900000000000001 as decimal(18,0)) * cast(900000000000007 as decimal(18,0))) AS s").first().s
    assert score == 1000 * 900000000000000 * 99999999999999999 // (900000000000001 * 900000000000007)


# --- spelling
def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    s, l = sorted((x, y), key=len)
    return len(l) - len(s) == 1 and any(l[:k] + l[k + 1 :] == s for k in range(len(l)))


def test_sorted_scan_finds_each_pair_once():
    choose = random.Random(1)
    for turn in range(1500):
        m = choose.randint(1, 7)
        words = sorted({"".join(choose.choice("ab" if turn % 2 else "abcé") for _ in range(choose.choice((m, m + 1)))) for _ in range(choose.randint(0, 25))})
        lo = choose.randint(0, m - 1)
        hi = choose.randint(lo + 1, m)

        def first(x, y):
            s, l = sorted((x, y), key=len)
            return min(next((k for k in range(len(s)) if s[k] != l[k]), len(s)), m - 1)

        want = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if min(len(words[i]), len(words[j])) == m and one_edit(words[i], words[j]) and lo <= first(words[i], words[j]) < hi]
        assert sorted(spelling.near_in(words, m, lo, hi)) == want


def brute_variants(rows, least=3):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= least}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {w: best[1] for w in n if (best := min(((-n[x], x) for x in near[w]), default=None)) and -best[0] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def misspelt(seed, words=40, texts=300):
    choose = random.Random(seed)
    base = ["".join(choose.choice("abcdeéÿn") for _ in range(choose.randint(4, 9))) for _ in range(words)]
    out = []
    for k in range(texts):
        own = []
        for _ in range(60):
            w = choose.choice(base[: 1 + int(words * choose.random() ** 2)])
            for _ in range(choose.choice((0, 0, 0, 0, 1, 2))):
                at = choose.randrange(len(w))
                w = w[:at] + choose.choice(("", "a", "b" + w[at])) + w[at + 1 :]
            own.append(w.capitalize() if choose.random() < 0.1 else w)
        out.append((k, " ".join(own)))
    return out


@pytest.mark.parametrize("group", [5000, 4])
def test_variants_match_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(spelling, "GROUP", group)
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (2, group))
    rows = misspelt(3) + [(None, "hello hellp hello"), (None, None), (1, "hello hello"), (5, ""), (6, "x\u00d7hello\u00f7y \u0142\u0101hello \U0001f600")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("word", "n", "m", "lo", "hi", "key")})
    got = spelling.variants(docs).collect()
    want = brute_variants(rows)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sum(r.form is not None for r in got) > 50 and any(r.root not in (r.word, r.form) for r in got)


def test_large_groups_are_cut_further(spark):
    words = spark.range(4000).selectExpr("concat('prefixed', translate(lpad(conv(id, 10, 8), 5, '0'), '01234567', 'abcdefgh')) AS word", "1L AS n")
    sizes = spelling.grouped(words, 2, 50).groupBy("m", "lo", "hi", "rest").count().agg(F.max("count")).first()[0]
    assert sizes <= 64
    near = spelling.near_pairs(words, 2, 50).groupBy("word").count().agg(F.max("count"), F.sum("count")).first()
    names = [r.word for r in words.collect()]
    assert near[0] <= 35 and near[1] == sum(one_edit(a, b) for a in names[:300] for b in names) + sum(one_edit(a, b) for a in names[300:] for b in names)


def test_variants_of_messy_and_empty_documents(messy, none):
    got = spelling.variants(messy, least=1).collect()
    assert {tuple(r) for r in got} == brute_variants(ROWS, 1)
    assert spelling.variants(none).count() == 0


# --- URLs
def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, rest = re.match(r"([^/?#]*)(.*)", url.split("://", 1)[1], re.S).groups()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest).group()


def brute_rule(host, path, rules=urls.RULES):
    fits = [(name + start, verdict) for name, start, verdict in rules if (host == name or host.endswith("." + name)) and path.startswith(start)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


STRANGE = [None, "", "no scheme", "http://", "http://a.NET", "http://A.net/", "http://example.net/en/x", "x://sub.example.net/en?q", "http://notexample.net/en/", "http://example.com/de/?a#b", "http://b.org/fr/é", "http://ÉX.org/fr/\nx", "http://h?x/y", "://net/en/", "a://b://net/", "http://net/" + "x" * 20_000]


def test_rules_of_urls_match_brute_force(spark):
    rows = list(enumerate(STRANGE)) + [(None, "http://a.net/"), (3, "http://a.net/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "verdict", "ruling", "raw")})
    got = urls.judge(pages).collect()
    want = Counter((i, *brute_parts(u), brute_rule(*brute_parts(u))[0]) for i, u in rows)
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == want
    for r in got:
        _, verdict = brute_rule(r.host, r.path)
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def markov(counts, gram):
    """Witten-Bell with dictionaries: blends the contexts that were seen often enough, from the shortest on."""
    p = 1 / urls.ALPHABET
    for k in range(6):
        after = Counter()
        for g, n in counts.items():
            if g[5 - k : 5] == gram[5 - k : 5]:
                after[g[5]] += n
        if k and sum(after.values()) < urls.SEEN:
            break
        p = (after[gram[5]] + len(after) * p) / (sum(after.values()) + len(after))
    return p


def test_markov_model_equals_dictionaries():
    known = [b"http://a.org/en/1", b"http://b.org/en/22", b"http://ab.org/fr/", b""]
    split = lambda u: [tuple([0] * max(0, 5 - k) + [b + 2 for b in u[max(0, k - 5) : k]] + [u[k] + 2 if k < len(u) else 1]) for k in range(len(u) + 1)]
    counts = Counter(g for u in known for g in split(u))
    kinds, n = np.unique(urls.grams(known)[0], return_counts=True)
    model = urls.Markov(kinds, n.astype(float))
    for u in (b"http://a.org/en/2", b"ftp://zz", b"", bytes(range(256))):
        want = [np.log(markov(counts, g)) for g in split(u)]
        assert np.allclose(model.log(urls.grams([u])[0]), want)
    assert abs(sum(markov(counts, (0, 0, 0, 0, 0, b)) for b in range(1, 258)) - 1) < 1e-9


def test_limit_has_the_fewest_errors():
    a, r = np.array([0.5, 0.4, 0.1, -0.3]), np.array([-0.5, -0.2, 0.0])
    limit = urls.best_limit(a, r)
    wrong = lambda x: (a < x).mean() + (r >= x).mean()
    assert wrong(limit) == min(wrong(x) for x in np.linspace(-1, 1, 4001)) and urls.best_limit(a, r[:0]) == 0.0


def test_urls_without_one_class_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.com/"), (3, None)], "page_id int, url string")
    assert {(r.page_id, r.verdict, r.score) for r in urls.judge(pages).collect()} == {(1, "block", None), (2, "allow", None), (3, "allow", None)}
    assert urls.judge(pages.where("false")).count() == 0


def test_url_model_separates_held_out_urls(spark):
    rows = urls.with_parts(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).withColumn("r", urls.ruling()).select("url", "r.verdict").where("verdict IS NOT NULL")
    seen = rows.where(F.crc32(F.col("url").cast("binary")) % 4 != 0)
    model, rest = urls.fit(seen), rows.where(F.crc32(F.col("url").cast("binary")) % 4 == 0).collect()
    right = [(s >= model.limit) == (r.verdict == "allow") for s, r in zip(model.scores([r.url.encode() for r in rest]), rest, strict=True)]
    assert np.mean(right) > 0.95


def test_queries_of_the_new_operators(spark):
    assert [c for c in queries.QUERIES["op13_url_filter"](spark, SF).columns][:5] == ["page_id", "host", "path", "rule", "verdict"]
    assert queries.QUERIES["op12_spelling_variants"](spark, SF).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert queries.QUERIES["op11_phrase_mining"](spark, SF).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_url_models_learn_from_every_judged_url(spark, monkeypatch):
    """Counts of all URLs that are not held out, long ones too, and a limit from all that are; tables too large keep the frequent contexts."""
    rng = np.random.default_rng(6)
    rows = [(f"http://{'ham' if k % 2 else 'spam'}{rng.integers(400)}.example.com/{rng.integers(10**6)}/{'abcd'[k % 4] * 20}", "allow" if k % 2 else "block") for k in range(16000)]
    rows += [("http://ham.example.com/" + "xyz" * 1500, "allow")]
    seen = spark.createDataFrame(rows, "url string, verdict string")
    held = {r.url: r.held for r in seen.selectExpr("url", "pmod(xxhash64(url, 'fold'), 5) = 0 AS held").collect()}
    model = urls.fit(seen)
    known, want = [], {}
    for name, mine in (("allow", model.accepted), ("block", model.rejected)):
        own = urls.grams([u.encode() for u, v in rows if v == name and not held[u]])[0]
        kinds, n = np.unique(own, return_counts=True)
        known.append(kinds)
        want[name] = urls.Markov(kinds, n.astype(float))
        assert np.allclose(mine.log(kinds), want[name].log(kinds))
    exact = urls.UrlFilter(want["allow"], want["block"])
    good, bad = (exact.scores([u.encode() for u, v in rows if v == name and held[u]]) for name in ("allow", "block"))
    wrong = lambda cut: np.mean(good < cut) + np.mean(bad >= cut)
    assert wrong(model.limit) <= wrong(urls.best_limit(good, bad)) + 1e-12 + np.mean(np.abs(np.r_[good, bad] - model.limit) < urls.GRAIN)
    monkeypatch.setattr(urls, "ENTRIES", 3000)
    small = urls.fit(seen)
    assert 0 < sum(len(kinds) for m in (small.accepted, small.rejected) for _, kinds, *_ in m.levels) <= 3000
    assert np.isfinite(small.accepted.log(known[1])).all() and wrong(small.limit) < 2
