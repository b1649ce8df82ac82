"""Archives, chat windows, fingerprints, dropout codes, shards, licenses and languages."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from fluxloom.llm import chat, dropout, fingerprints, language, licenses, tokens, training_order, warc
from fluxloom.llm.license_rules import rules
from fluxloom.session import scratch_path

from .conftest import ROWS, prose

SF = "/root/testdata/sf0.01"


# --- WARC
def pages(spark):
    long = "<p>" + "payload é " * 200
    rows = [(1, "http://a/é x", long), (2, None, long), (9, "http://b", long), (3, "u", "short"), (4, "u", "short"), (5, None, None), (6, "u", ""), (7, "u", "x" * 1000), (8, "u", "x" * 1000), (8, "u", "x" * 1000), (None, "u", "y" * 1200), (11, "u", "y" * 1200)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit(None).cast("int") for c in ("payload", "digest", "salt", "keeper", "size")})


def test_warc_round_trip(spark):
    path = scratch_path(spark, "warc")
    table = pages(spark)
    warc.write_archives(table, path)
    got = warc.read_archives(spark, path).collect()
    rows = [(r.page_id, (r.html or "").encode()) for r in table.collect()]
    largest = {}
    for i, p in rows:
        largest[p] = max(largest.get(p, -1), -1 if i is None else i)
    want = Counter((i, len(p), hashlib.sha1(p).hexdigest(), *(("revisit", largest[p]) if len(p) >= 1000 and i != largest[p] else ("response", None))) for i, p in rows)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    archives = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()]
    assert all(struct.unpack_from("<I", a)[0] == warc.DICTIONARY_FRAME for a in archives)


def test_warc_without_pages(spark):
    path = scratch_path(spark, "warc")
    warc.write_archives(pages(spark).where("false"), path)
    assert warc.read_archives(spark, path).count() == 0


def archive(records, dictionary=b""):
    tool = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return struct.pack("<II", warc.DICTIONARY_FRAME, len(dictionary)) + dictionary + b"".join(tool.compress(r) for r in records)


def test_reader_takes_raw_and_compressed_dictionaries():
    words = zstandard.train_dictionary(4096, [prose(k).encode() for k in range(300)]).as_bytes()
    record = warc._record(1, "u", b"hello", hashlib.sha1(b"hello").hexdigest(), None, 5)
    plain = archive([record, record], words)
    packed = zstandard.ZstdCompressor().compress(words)
    again = struct.pack("<II", warc.DICTIONARY_FRAME, len(packed)) + packed + plain[8 + len(words) :]
    skipped = plain + struct.pack("<II", warc.SKIPPABLE + 3, 2) + b"??"
    for whole in (plain, again, skipped):
        assert list(warc.read_frames(whole)) == [record, record]


@pytest.mark.parametrize("damage", ["head", "cut", "stray", "no dictionary"])
def test_damaged_archives_are_refused(damage):
    whole = archive([b"record one", b"record two"])
    bad = {"head": b"\0" * 8 + whole[8:], "cut": whole[:-3], "stray": whole + b"abc", "no dictionary": b""}[damage]
    with pytest.raises(warc.ArchiveError):
        list(warc.read_frames(bad))


def test_damaged_records_are_refused():
    record = warc._record(1, "u", b"hello", hashlib.sha1(b"hello").hexdigest(), None, 5)
    assert warc.parse_record(record)["payload"] == b"hello"
    for bad in (record[:-1], record.replace(b"hello", b"hellO"), record.replace(b"WARC/1.1", b"WARC/0.9"), record.replace(b"Content-Length: ", b"Content-Length: 1"), record.replace(b"WARC-Type: response\r\n", b"")):
        with pytest.raises(warc.ArchiveError):
            warc.parse_record(bad)


def test_records_of_other_makers():
    record = warc._record(1, "u", b"hello", hashlib.sha1(b"hello").hexdigest(), None, 5)
    cut = lambda name: re.sub(rb"%s: [^\r]*\r\n" % name, b"", record)
    for bare in (cut(b"WARC-Block-Digest"), cut(b"X-Payload-Length"), cut(b"WARC-Payload-Digest"), cut(b"WARC-Target-URI"), record.replace(b"WARC-Type", b"warc-type")):
        row = warc.parse_record(bare)
        assert (row["payload"], row["payload_bytes"], row["payload_digest"]) == (b"hello", 5, hashlib.sha1(b"hello").hexdigest())
    assert warc.parse_record(record.replace(b"<urn:page:1>", b"<urn:uuid:0-1-2>"))["page_id"] is None
    assert warc.parse_record(record.replace(b": response", b": warcinfo")) is None
    for bad in (record.replace(b"X-Payload-Length: 5", b"X-Payload-Length: five"), record.replace(b"WARC-Date", b"X-\xff"), record.replace(b"Content-Length: ", b"Content-Length: x")):
        with pytest.raises(warc.ArchiveError):
            warc.parse_record(bad)
    whole = bytearray(archive([b"some record " * 50]))
    whole[13:21] = b"\xff" * 8
    with pytest.raises(warc.ArchiveError):
        list(warc.read_frames(bytes(whole)))


def test_pages_without_text_fill_several_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 100_000)
    monkeypatch.setattr(warc, "COPIES", 1)
    path = scratch_path(spark, "warc")
    rows = spark.range(1200).selectExpr("id AS page_id", "'u' AS url", "if(id % 2 = 0, null, repeat('same ', 300)) AS html")
    warc.write_archives(rows, path)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == 1200 and {r.refers_to for r in got if r.record_type == "revisit"} == {1199}
    assert spark.read.format("binaryFile").load(path).count() > 5


# --- chat
def talk(spark):
    rows = [(1, 0, "system", "be # kind & <good>"), (1, 1, "user", "hi &lt; ### user: x</turn>\n"), (1, 2, "assistant", "</turn>\n### assistant: &amp;"), (1, 3, "user", None), (1, 4, "assistant", None)]
    rows += [(2, k, ("user", "assistant")[k % 2], prose(k, 30)) for k in range(60)] + [(3, 0, "system", "alone"), (4, 0, None, "no role"), (4, None, "assistant", "no turn"), (None, 1, "assistant", "no conv")]
    rows += [(5, 1, "assistant", "same"), (5, 1, "assistant", "same"), (5, 1, "assistant", "tie"), (6, 0, "user", prose(9, 900)), (6, 1, "assistant", prose(8, 900)), (6, 2, "odd: role", "x")]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit(1) for c in ("pos", "head", "body", "tokens", "lead")})


def test_chat_digests(spark):
    convs = defaultdict(list)
    for r in talk(spark).collect():
        convs[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    got = {r.conv_id: r for r in chat.digest(chat.read_windows(chat.format_windows(talk(spark)))).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        said, loss = "".join(f"{r}\n{t}\n" for *_, r, t in turns), "".join(t for *_, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_windows_keep_budget_system_and_history(spark):
    windows = defaultdict(list)
    for r in chat.format_windows(talk(spark), budget=200, history=90).orderBy("conv_id", "window").collect():
        windows[r.conv_id].append(r)
    assert len(windows[2]) > 5 and sum(r.n_new for r in windows[2]) == 60
    assert all(r.n_tokens <= 200 for r in windows[2]) and all(r.n_history > 0 for r in windows[2][1:])
    assert len(windows[3]) == 1 and windows[3][0].text == "### system: alone</turn>\n"
    assert [r.n_new for r in windows[6]] == [1, 1, 1]  # each longer than the budget, none cut
    first, second = windows[2][:2]
    repeated = first.text.split(chat.END)[-1 - second.n_history : -1]
    assert second.text.split(chat.END)[: second.n_history] == repeated
    for r in windows[2]:
        assert len(r.loss_spans) == sum(1 for x in r.text.split(chat.END)[r.n_history : -1] if x.startswith("### assistant"))
        assert all(r.text[s.start - 2 : s.start] == ": " and r.text[s.start + s.length :].startswith(chat.END) for s in r.loss_spans)
    assert chat.format_windows(talk(spark).where("false")).count() == 0


# --- fingerprints
def test_fingerprints_estimate_generalised_jaccard(spark):
    rows = [(k, prose(k % 40, 40 + k)) for k in range(120)]
    got = {r.doc_id: r for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id bigint, text string"), samples=64).collect()}

    def likeness(a, b):
        a, b = Counter(a.split()), Counter(b.split())
        return sum(min(a[w], b[w]) for w in {*a, *b}) / sum(max(a[w], b[w]) for w in {*a, *b})

    errors = []
    for k, text in rows:
        q, after = len(text) // 4, rows[(k + 1) % 120][1]
        edited = text[: len(text) - q] + after[:q]
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[k].n_chars == len(text)
        errors += [got[k].near_edited - likeness(text, edited), got[k].near_next - likeness(text, after)]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_fingerprints_of_messy_documents(messy, none):
    got = fingerprints.fingerprint(messy).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t in ROWS)
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[1] == prints[2] and prints[7] == prints[8] == prints[10] and prints[1] != prints[16]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.fingerprint(none).count() == 0
    one = fingerprints.fingerprint(messy.where("doc_id = 16")).first()
    assert one.near_next == 1.0  # a single document follows itself


# --- merge-dropout
@pytest.fixture(scope="module")
def model():
    return tokens.default_path("piece_bpe_32k.model")


def test_without_dropout_the_codes_are_the_librarys(model):
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=model), dropout.Codec(model, drop=0.0)
    texts = ["", " ", "a  b\tc\n", "ﬁ ① 😀", "    indent", *[t for _, t in ROWS if t and "▁" not in t]]
    assert [np.frombuffer(x, "<u2").tolist() for x in own.encode(texts)] == library.encode(texts)


def test_dropout_varies_and_decodes(model):
    own = dropout.Codec(model, drop=0.3)
    texts = [t or "" for _, t in ROWS]
    codes = own.encode(texts)
    assert [own.decode(c) for c in codes] == texts
    assert codes == dropout.Codec(model, drop=0.3).encode(texts)
    assert codes != dropout.Codec(model, seed=1, drop=0.3).encode(texts)
    word = np.frombuffer(own.encode([" ".join(["unbelievable"] * 8)])[0], "<u2").tolist()
    assert len({tuple(word[:k]) for k in range(1, 9)}) and own.encode(["unbelievable " * 8])[0] != dropout.Codec(model, drop=0).encode(["unbelievable " * 8])[0]


def test_both_agendas_agree(model):
    own = dropout.Codec(model, drop=0.3)
    words = sorted({"▁" + w for _, t in ROWS[:20] if t for w in t.split()} | {"▁▁▁▁a", "▁日本é", "▁internationally", "▁aaaaaaaaaa"})
    words = [w for w in words if len(w) <= dropout.WIDEST]
    for variant in (0, 3):
        assert own._together(words, variant) == [own._alone(w, variant) for w in words]


def test_dropout_on_spark(messy, none, model):
    got = dropout.decode(dropout.encode(messy, model), model).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t or "") for i, t in ROWS)
    assert dropout.decode(dropout.encode(none, model), model).count() == 0


def test_every_occurrence_is_dropped_on_its_own(model):
    own = dropout.Codec(model)
    word, n = "unbelievable", 4000
    plain, met = (x[0] for x in own._merged(["▁" + word], 0))
    outcomes = Counter()
    for text in [" ".join([word] * n), " ".join([word] * (n // 2))]:
        cut, at = [], 0
        first = own.hash(text.encode(), own.seed)
        code = own.encode([text])[0]
        for k in range(len(text.split())):
            key = dropout._mixed(np.array([first], np.uint64) + np.array([k], np.uint64) * np.uint64(dropout._C))
            skips = own._drawn(key, np.arange(64)) < np.uint64(own.limit)
            want = own._alone("▁" + word, skips)
            assert code[at : at + len(want)] == want
            at += len(want)
            cut.append(want)
        assert at == len(code)
        outcomes.update(cut)
    assert len(outcomes) > 20  # four at most when variants were dealt
    kept = (1 - dropout.DROP) ** int(met)
    assert kept - 0.03 < outcomes[plain] / (n + n // 2) < 1  # an unskipped agenda, and skips that change nothing
    assert own._merged(["▁a"] * 2, 0)[0] == [own._alone("▁a", 0)] * 2


def test_rare_merges_vary_with_more_text(model):
    """A word of one candidate: each occurrence skips it with the set chance."""
    own = dropout.Codec(model)
    text = "to " * 20_000
    code = np.frombuffer(own.encode([text])[0], "<u2")
    long = own.encode([" ".join(["x" * 40] * 300)])[0]
    assert own.decode(long) == " ".join(["x" * 40] * 300) and len(code) > 20_500
    small = dropout.Codec(model)
    texts = [t or "" for _, t in ROWS] * 2
    assert [small.encode([t])[0] for t in texts] == own.encode(texts)


def test_full_tables_change_nothing(model, monkeypatch):
    texts = [t or "" for _, t in ROWS]
    want = dropout.Codec(model).encode(texts)
    monkeypatch.setattr(dropout, "TABLE_SIZE", 10)
    monkeypatch.setattr(dropout, "OUTCOMES", 3)
    own = dropout.Codec(model)
    assert [own.encode([t])[0] for t in texts] == want


# --- training order
@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_slots_are_a_keyed_permutation(n):
    own = training_order.slots(np.arange(n), n, 5)
    assert sorted(own.tolist()) == list(range(n))
    assert n < 64 or (own != training_order.slots(np.arange(n), n, 6)).any()


def test_shards_round_trip_and_resume(spark, messy, none, monkeypatch):
    monkeypatch.setattr(training_order, "SHARD", 16)
    path = scratch_path(spark, "order")
    n = training_order.write_shards(messy, path, length=32)
    rows = training_order.read_shards(spark, path).collect()
    assert sorted(r.slot for r in rows) == list(range(n))
    own = tokens.byte_bpe(tokens.default_path(), 2)
    want = Counter()
    for i, t in ROWS:
        ids = own.ids(t) + struct.pack("<H", 50256)
        want.update((i, p, ids[a : a + 64]) for p, a in enumerate(range(0, len(ids), 64)))
    assert Counter((r.doc_id, r.piece, bytes(r.ids)) for r in rows) == want
    tail = training_order.read_shards(spark, path, first=n - 21).collect()
    assert {(r.slot, bytes(r.ids)) for r in tail} == {(r.slot, bytes(r.ids)) for r in rows if r.slot >= n - 21}
    empty = scratch_path(spark, "order")
    assert training_order.write_shards(none, empty) == 0 and training_order.read_shards(spark, empty).count() == 0


# --- licenses
def test_license_scan_matches_brute_force(spark, none):
    texts = ["Released under the MIT License.", "MIT\n license; mit-LICENSE", "emit license mit licensed", "émit license", None, "", "Apache License, Version 2.0 and GNU General Public License, version 3", "mit License apache", "apache licenſe K license", "general  public\x00license " * 3, "x" * 50_000 + " mit license"]
    rows = list(enumerate(texts)) + [(None, "mit license")]
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("labels", F.lit(1))).collect()
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), rows, strict=True):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
        places = [(k, label) for k in range(len(words)) for p, label in phrases.items() if tuple(words[k : k + len(p)]) == p]
        assert (r.doc_id, r.n_words, r.n_base) == (i, len(words), len(places))
        assert (r.first_word, r.last_word) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert licenses.scan_licenses(none).count() == 0


def test_rules_match_what_they_name():
    found = lambda t: licenses.scan_text(t)[5].split(",")
    assert len(rules()) >= 300
    assert "gpl-3.0" in found("GNU General Public License, version 3") and "cc-by-nc-4.0" in found("Licensed under CC BY-NC 4.0.")
    assert found("SPDX-License-Identifier: BSD-3-Clause") == ["bsd-3-clause"]
    assert "mit" in found("Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software")
    assert "lgpl-2.1" in found("GNU Lesser General Public License version 2.1") and found("a plain text about permits") == [""]


def test_contained_matches_are_suppressed():
    d = [("a", 0, 5, 0, 10), ("b", 1, 7, 0, 20), ("c", 2, 9, 5, 8), ("d", 3, 5, 15, 30), ("e", 4, 7, 0, 20)]
    assert [x[0] for x in sorted(licenses._outermost(d))] == ["b", "c", "d"]


def test_every_rule_has_its_keyword_in_what_it_matches():
    """A match without the keyword could never be found; the simplest wording of each tag shows it."""
    for tag in ("mit", "apache-2.0", "gpl-3.0-only", "zlib"):
        assert any(r.label == tag and r.keyword in f"spdx-license-identifier: {tag}" for r in rules())


def test_license_expressions():
    found = lambda t: licenses.scan_text(t)[5]
    assert found("// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;") == "apache-2.0,mit"
    assert found("SPDX-License-Identifier: (MIT AND (ISC OR Zlib)) */") == "isc,mit,zlib"
    assert found("<!-- SPDX-License-Identifier: MIT-->") == "mit"
    assert "bsd-3-clause" not in found("SPDX-License-Identifier: BSD-3-Clause-Clear").split(",")
    assert found("SPDX-License-Identifier: x\nMIT") == ""
    wide = "GNU Lesser\n *            General Public License version 2.1"
    assert "lgpl-2.1" in found(wide).split(",")


def wordings(parsed, separators, pick):
    """One text that a parsed pattern matches: separators are taken in turn, ``pick`` chooses among the rest."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            out += pick([chr(v) for o, v in arg if str(o) == "LITERAL"] or ["7" if "DIGIT" in str(arg) else "w"]) if str(arg[0][0]) != "NEGATE" else "w"
        elif name == "NOT_LITERAL":
            out += "w"
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            if "NEGATE" in str(inner) and (high == 3 or high > 100):
                mark = next(separators)
                out += mark[:3] if low and high == 3 else mark if low or pick([True, False]) else ""
            else:
                out += "".join(wordings(inner, separators, pick) for _ in range(pick([low, min(int(high), low + 1)])))
        elif name == "BRANCH":
            out += wordings(pick(arg[1]), separators, pick)
        elif name == "SUBPATTERN":
            out += wordings(arg[3], separators, pick)
    return out


def test_gated_detection_loses_no_match():
    """Every rule is found in wrapped, commented and double-blank wordings of all its parts."""
    import itertools
    import random
    import re._parser as parser

    choose = random.Random(5)
    every = rules()
    for rule in (r for r in every if r.within is None):
        for marks in ([" "], ["  "], ["\n * "], ["\n"], ["\r\n// ", " "], [", "], ["é"], ["-"]):
            for _ in range(4):
                text = wordings(parser.parse(rule.pattern.pattern), itertools.cycle(marks), choose.choice)
                if rule.pattern.search(text):
                    tried = {r.number for _, (_, own) in licenses._gate().iter(licenses._spaced(text.encode())) for r in own}
                    assert rule.number in tried, (rule, text)
        assert any(rule.pattern.search(wordings(parser.parse(rule.pattern.pattern), itertools.cycle(m), choose.choice)) for m in ([" "], ["-"], ["  "]) for _ in range(20)), rule
    notice = "GNU Lesser General\n * Public License version 2.1\nRedistribution and  use in source and binary forms, with or without modification, are permitted provided that\nCreative\nCommons, a share-alike license"
    whole = licenses._outermost([(r.label, r.number, r.priority, *m.span()) for r in every for m in r.matches(notice.lower())])
    assert licenses.detect(notice.lower()) == whole
    assert {"lgpl-2.1", "bsd-2-clause", "cc", "share-alike"} <= set(licenses.scan_text(notice)[5].split(","))


# --- languages
def test_language_models_sum_to_one_and_learn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert sum(r.rejected for r in got) <= 0.005 * len(got) and all(0 <= r.score <= 1 for r in got)
    models = language.fit(docs)
    own = models.languages[0]
    alphabet = own.levels[-1][1]
    context = own.levels[0][3][len(own.levels[0][3]) // 2]
    total = np.exp(own.log((context << np.uint64(16)) | alphabet)).sum()
    assert 0.98 < total <= 1.0 + 1e-9
    noise = ["qzx wvk jjq xkz " * 40, "ббб щщщ ъъъ " * 40]
    e, n = models.cross_entropies(noise)
    assert (e.min(1) > models.limit(e.argmin(1), n)).all()


def kneser_ney(text, counts):
    """Interpolated Kneser-Ney with dictionaries: the logarithm of the probability of each symbol of ``text``."""
    levels = [counts]
    for _ in range(3):
        levels.append(Counter(g[1:] for g in levels[-1]))
    letters = len({g[-1] for g in counts}) + 1

    def p(gram, k):
        if k == 4:
            return 1 / letters
        own = levels[k]
        n1, n2 = sum(c == 1 for c in own.values()), sum(c == 2 for c in own.values())
        d = n1 / (n1 + 2 * n2) if n1 else 0.5
        after = {g: c for g, c in own.items() if g[:-1] == gram[:-1]}
        lower = p(gram[1:], k + 1)
        if not after:
            return lower
        return (max(own.get(gram, 0) - d, 0) + d * len(after) * lower) / sum(after.values())

    run = "\0\0\0" + re.sub(r"[^a-z]+", "\0", text) + "\0"
    return [np.log(p(run[k - 3 : k + 1], 0)) for k in range(3, len(run))]


def test_language_model_equals_dictionary_kneser_ney(spark, monkeypatch):
    corpus = ["the cat sat on the mat", "a hat that the rat ate", "ten tea tins  "]
    grams, n = np.unique(language.keys(corpus)[0], return_counts=True)
    plain = np.sort(grams * language.UNSCRAMBLE)
    symbols = lambda g: "".join(chr(int(g) >> 16 * k & 0xFFFF) for k in (3, 2, 1, 0))
    counts = dict(zip((symbols(g) for g in (grams * language.UNSCRAMBLE)), n.tolist(), strict=True))
    own = np.array([counts[symbols(g)] for g in plain], float)
    model = language.Language(plain, own, len({g[-1] for g in counts}) + 1)
    models = language.Models(["x", "y"], [model, model])
    for text in ("the tea that sat", "zebra hat ", "a"):
        want = -np.mean(kneser_ney(text, counts))
        assert np.allclose(models.cross_entropies([text])[0][0], want, atol=1e-5)
    long = "the cat  sat. on " * 50
    want = models.cross_entropies([long])
    monkeypatch.setattr(language, "CHUNK", 7)
    got = models.scored([long, "a"])
    assert np.allclose(got[0][0], want[0][0], atol=1e-6) and got[1][0] == want[1][0]
    monkeypatch.setattr(language, "MATRIX", 1)
    assert np.allclose(language.Models(["x", "y"], [model, model]).cross_entropies([long])[0], want[0], atol=1e-5)


def test_every_label_is_learned(spark):
    rows = [(k, f"ab{chr(97 + k % 26)}{chr(97 + k // 26 % 26)} " * 20, f"l{k % 260}") for k in range(2600)]
    models = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(models.names) == 260


def test_languages_of_messy_documents(messy, none, spark):
    got = language.identify(messy).collect()
    want = Counter((i, bool(re.search(r"[^\W\d_]", t or ""))) for i, t in ROWS)
    assert Counter((r.doc_id, r.lang_pred != "und") for r in got) == want
    assert language.fit(none) is None and language.predict(none, None).count() == 0
    unlabelled = language.predict(messy, None).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"} and len(unlabelled) == len(ROWS)


def test_rare_labels_and_junk_rows_leave_rejection_on(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    names = sorted(r.lang for r in docs.select("lang").distinct().collect() if r.lang)
    junk = "".join(chr(0x4E00 + 37 * k % 5000) for k in range(300))
    odd = [(10**9 + k, f"ma na ka ta {k} la", "rare") for k in range(3)]
    odd += [(2 * 10**9 + k, (prose(k, 60) + " " if k % 2 else "") + junk[k:] + junk[:k], names[0]) for k in range(6)]
    models = language.fit(docs.unionByName(spark.createDataFrame(odd, "doc_id bigint, text string, lang string")))
    assert "rare" in models.names and np.isfinite(models.limits).all()
    unlearned = ["ქართული ენა არის ლამაზი და ძველი " * 20, "qzx wvk jjq xkz " * 40, "ббб щщщ ъъъ " * 40]
    e, n = models.cross_entropies(unlearned)
    assert (e.min(1) > models.limit(e.argmin(1), n)).all()


def test_strange_calibration_rows_move_no_limit():
    rng = np.random.default_rng(3)
    lang, excess = np.repeat([0, 1, 2], [200, 200, 1]), np.r_[rng.normal(2, 0.1, 400), 2.1]
    plain = language.limits(lang, excess, 4)
    mixed = language.limits(np.r_[lang, 0, 0], np.r_[excess, 7.5, 9.0], 4)
    assert np.isfinite(plain).all() and plain[2] == plain[3] and np.allclose(plain, mixed, atol=0.1)
