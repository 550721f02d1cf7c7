"""Dealt operators against brute force, round trips and their SQL, with odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from evalweave.llm import decontaminate, flac, flac_column, line_dedup, ngram_join, packing, preferences, prefix_free, quality_knn, registry, simple8b, token_files, url_filter
from evalweave.llm.components import components
from evalweave.llm.packing import _path
from evalweave.llm.scratch import scratch_path
from evalweave.llm.tokens import WordEncoder
from tests.conftest import SMALL
from tests.oracle import compare, duck

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, label string, score double, __line string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()


def rows_of(texts, sources=None):
    return [(i, t, None, (sources or {}).get(i, f"s{(i or 0) % 7}"), None, "x", "y", 0.5, "z") for i, t in texts]


def frame(spark, texts, sources=None):
    """Documents with nulls and with columns whose names clash with the operators' own."""
    return spark.createDataFrame(rows_of(texts, sources), SCHEMA)


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join(rng.choice(WORDS, n))
    base, passage = prose(60), prose(30)
    texts = [(3, base), (1, base + " end"), (9, base), (4, None), (5, ""), (6, " \n "), (7, "One Two"), (8, "one two"), (2, prose(40) + passage)]
    texts += [(10, passage + prose(35)), (11, "ab" * 400), (12, "ab" * 300), (13, "é" * 200), (14, prose(4000)), (None, base), (3, base), (15, "\x00" * 120), (16, "  two  blanks\n\n")]
    return texts


def test_sql_of_registered_queries(spark):
    con = duck(SMALL)
    for name, sql in registry.all_oracles().items():
        assert compare(spark, con, registry.all_queries()[name], sql, SMALL) == []


def test_every_number_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.all_queries()) == list(range(1, 14))


# ---- line dedup -------------------------------------------------------------------------------


def test_lines_stay_once(spark):
    line = "this boilerplate line is long enough"
    texts = [(i, f"own text of document number {i}\n {line}\t\n}}") for i in range(1, 8)] + [(8, None), (9, ""), (None, line)]
    got = {r.doc_id: r for r in line_dedup.strip_boilerplate(frame(spark, texts), min_sites=5).collect()}
    assert got[None].text == line and got[None].n_removed == 0  # a null id is the smallest
    assert all(got[i].text == f"own text of document number {i}" + ("\n}" if i == 1 else "") and got[i].n_removed == (1 if i == 1 else 2) for i in range(1, 8))
    assert got[8].text is None and got[8].n_lines == 0 and got[9].text == "" and got[9].n_lines == 1
    long = line_dedup.strip_boilerplate(frame(spark, texts), min_sites=5, min_chars=20).collect()
    assert all(r.text.endswith("\n}") and r.n_removed == 1 for r in long if r.doc_id in range(1, 8))
    few = line_dedup.strip_boilerplate(frame(spark, texts), min_sites=9).collect()
    assert sum(r.n_removed for r in few) == 0
    assert line_dedup.strip_boilerplate(frame(spark, [])).collect() == []


def test_pipeline_treats_lines_of_any_length(spark):
    texts = [(i, f"own text of document number {i}\n Read more\t\n}}\n\n") for i in range(1, 8)] + [(8, None), (9, "}"), (10, "\n \n")]
    docs = frame(spark, texts).select(corpus_pipeline.COLUMNS)
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, SMALL).collect()}
    assert got[1] == texts[0][1] and all(got[i] == f"own text of document number {i}\n\n" for i in range(2, 8))
    assert got[8] is None and got[9] == "" and got[10] == "\n \n"


# ---- quality ----------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    scored = quality_knn.op2_quality_knn(spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in scored]) >= 0.9


def test_quality_of_odd_texts(spark, odd):
    docs = frame(spark, odd)
    labels = spark.createDataFrame([(1, 1), (2, 1), (11, 0), (12, 0), (12, 1), (None, 0), (3, None)], "doc_id long, label int")
    out = quality_knn.score(docs, quality_knn.fit(docs, labels)).collect()
    assert len(out) == len(odd) and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in quality_knn.score(docs, quality_knn.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_term_vectors_do_not_depend_on_steps(monkeypatch):
    texts = [b"The The the cat sat. " * 40, b"", b"x", b"A, b! 12"]
    whole = quality_knn.term_vectors(texts)
    assert all(np.allclose(quality_knn.term_vectors([t])[0], w) for t, w in zip(texts, whole))


def test_repeats_are_of_whole_words(monkeypatch):
    texts = [b"the the cat " * 30, b"international internationally internationally x", b"", b"y" * 500, b" a\ta\n a", b"a" * 8 + b" " + b"a" * 9]
    rows = quality_knn.term_vectors(texts)
    for text, row in zip(texts, rows):
        words = text.split()
        share = sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words) - 1)
        assert np.isclose(row[-2], share * quality_knn.REPEAT_WEIGHT)
    for step in (7, 100):
        monkeypatch.setattr(quality_knn, "STEP", step)
        assert np.allclose(quality_knn.term_vectors(texts), rows)


def test_votes_equal_plain_loops(spark, odd):
    """Cosines and weighted votes one by one, over the model's own vectors."""
    docs = frame(spark, [(i, t) for i, t in odd if i is not None])
    model = quality_knn.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(1, 14)], "doc_id long, label int"))
    texts = [(t or "").encode() for _, t in odd]
    got = model.scores(quality_knn.term_vectors(texts), 5, 8.0)
    for terms, score in zip(quality_knn.term_vectors(texts), got):
        latent = model.project(terms[None])[0]
        cosines = sorted(((float(np.dot(latent, v)), int(y)) for v, y in zip(model.vectors, model.labels)), reverse=True)
        if abs(cosines[4][0] - cosines[5][0]) < 1e-6:
            continue  # any of the equally near may vote
        weights = [(max(c, 1e-9) ** 8, y) for c, y in cosines[:5]]
        assert abs(score - sum(w * y for w, y in weights) / sum(w for w, _ in weights)) < 1e-3


# ---- decontamination --------------------------------------------------------------------------


def edit_distance_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return row


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=90), st.binary(max_size=120))
def test_myers_equals_dynamic_programming(pattern, text):
    assert decontaminate.myers(pattern, text) == edit_distance_inside(pattern, text)[1:]


def test_leaks_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    item = " ".join(rng.choice(WORDS, 25))
    edited = item.replace("a", "o", 3)
    far = "".join(c if i % 4 else "#" for i, c in enumerate(item))
    texts = [(1, f"x {item} y"), (2, f"{edited.upper()}"), (3, far), (4, None), (5, ""), (6, item.replace(" ", "\n  ")), (7, " ".join(rng.choice(WORDS, 300))), (None, item)]
    bench = spark.createDataFrame([(1, item, "e"), (2, item, "e"), (3, None, "e"), (4, " ", "e"), (5, "tiny", "e")], "item_id long, text string, doc string")
    docs = frame(spark, texts)
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_leaks(docs, bench).collect()}
    want = {}
    for d, t in texts:
        norm = decontaminate.normalised((t or "").encode())[0]
        for i in (1, 2):
            pattern = item.encode()
            least = min(edit_distance_inside(pattern, norm))
            if least <= decontaminate.budget(len(pattern), 0.1, decontaminate.GRAM):
                want[d, i] = least
    assert got == want and {d for d, _ in got} == {1, 2, 6, None}
    kept = {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()}
    assert kept == {3, 4, 5, 7}
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("rate, share", [(0.1, (1, 10)), (0.3, (3, 10)), (0.0, (0, 1))])
def test_leaks_up_to_the_stated_rate(spark, rate, share):
    """Against a bound taken from the rate alone, with edits on both sides of it, in items of 3 bytes and more."""
    rng = np.random.default_rng(7)
    prose = lambda n: " ".join(rng.choice(WORDS, n))
    items = [(prose(60)[:n].strip() + "z").rjust(n, "q")[:n] for n in (3, 9, 10, 11, 12, 20, 23, 40, 95, 233)]

    def edited(item, edits):
        out = list(item)
        for k, at in enumerate(sorted({int(x) for x in np.linspace(1, len(item) - 2, edits)}, reverse=True)):
            out[at : at + 1] = [["#"], [], ["#", out[at]]][k % 3]
        return "".join(out)

    texts = []
    for item in items:
        most = len(item) * share[0] // share[1]
        texts += [f"{prose(20)} {edited(item, e)} {prose(20)}" for e in (most - 1, most, most + 1) if e >= 0]
    texts += [prose(400), " ".join([items[-1][:12]] * 300), ""]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(frame(spark, list(enumerate(texts))), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), rate=rate).collect()}
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            least = min(edit_distance_inside(item.encode(), text.encode()))
            if least <= len(item) * share[0] // share[1]:
                want[d, i] = least
    assert {k: r.distance for k, r in got.items()} == want
    for (d, i), r in got.items():
        assert edit_distance_inside(items[i].encode(), texts[d][r.start : r.stop].encode())[-1] == r.distance
    with pytest.raises(ValueError):
        decontaminate.Items.of([], 1.0)


# ---- prefix-free parsing ----------------------------------------------------------------------


def brute_repeats(texts, window=50):
    raw = [(-1 if i is None else i, (t or "").encode()) for i, t in texts]
    first = {}
    for i, b in raw:
        for p in range(len(b) - window + 1):
            first[b[p : p + window]] = min(i, first.get(b[p : p + window], 1 << 60))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if first[b[p : p + window]] < i:
                gone[p : p + window] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out)


def test_repeats_equal_brute_force(spark, odd):
    got = prefix_free.strip_repeats(frame(spark, odd)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_repeats(odd)
    assert prefix_free.strip_repeats(frame(spark, [])).collect() == []


# ---- n-gram join ------------------------------------------------------------------------------


def brute_classes(texts):
    sets = []
    for i, t in texts:
        words = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        grams = {tuple(words[j : j + 5]) for j in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}
        sets.append((-1 if i is None else i, grams))
    label = {i: i for i, _ in sets}
    for _ in sets:
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return sorted((i, len(s), label[i]) for i, s in sets)


def test_classes_equal_brute_force(spark, odd):
    rng = np.random.default_rng(8)
    base = list(rng.choice(WORDS, 120))
    chain = []
    for k in range(12):  # neighbours link, the ends do not
        base[9 * k] = f"edit{k}"
        chain.append((100 + k, " ".join(base)))
    texts = odd + chain + [(200 + k, f"{chain[0][1]} w{k}") for k in range(25)]
    got = ngram_join.similarity_classes(frame(spark, texts)).collect()
    none = lambda v: -1 if v is None else v
    assert sorted((none(r.doc_id), r.n_shingles, none(r.component_id)) for r in got) == brute_classes(texts)
    assert ngram_join.similarity_classes(frame(spark, [])).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# ---- tokens, files, packing -------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=80, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab 7\n.,'!é_\t<|x\u0301", max_size=40), max_size=6))
def test_cached_ids_equal_direct_ids(name, texts):
    code = _CODES.setdefault(name, WordEncoder(_path(name)))
    texts = [*texts, "<|endoftext|> a", "it's 7.5, ok", "a...b ,c"]
    assert code.encode([*texts, None])[:-1] == [code.direct([t])[0] if t else b"" for t in texts]


_CODES: dict = {}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, (1 << 34) - 1) | st.integers(0, 3), max_size=90), max_size=5))
def test_simple8b_round_trip(documents):
    ids = np.array([i for d in documents for i in d], np.uint64)
    ends = np.cumsum([len(d) for d in documents]).astype(np.int64)
    words, word_ends = simple8b.pack(ids, ends)
    assert simple8b.unpack(words).tolist() == ids.tolist()
    at = 0
    for d, end in zip(documents, word_ends.tolist() if len(ids) else [0] * len(documents)):
        assert simple8b.unpack(words[at:end]).tolist() == d
        at = end


def test_token_files_round_trip(spark, odd):
    path = scratch_path(spark, "test-ids")
    token_files.write_ids(frame(spark, odd), path, tokenizer=_path("byte_bpe_50k.json"))
    got = token_files.read_ids(spark, path).orderBy("start").collect()
    code = WordEncoder(_path("byte_bpe_50k.json"))
    order = sorted(odd, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    at = 0
    for row, (i, text) in zip(got, order, strict=True):
        want = (code.direct([text])[0] if text else b"") + bytes(4)
        assert (row.doc_id, row.start, row.n_tokens, bytes(row.ids)) == (i, at, len(want) // 4, want)
        at += row.n_tokens


def test_packing_covers_every_id_once(spark, odd):
    got = packing.pack(frame(spark, odd), tokenizer=_path("word_bpe_49k.json"), end_id=2, longest=64).collect()
    code = WordEncoder(_path("word_bpe_49k.json"))
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    assert [r.length for r in sorted(got, key=lambda r: r.sequence_id)] == sorted(r.length for r in got)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 64 and len(r.ids) == 4 * r.length and r.offset == 0 for r in got)
    for i, text in odd:
        if i in (3, None):
            continue
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        want = (code.direct([text])[0] if text else b"") + (2).to_bytes(4, "little")
        assert b"".join(bytes(r.ids) for r in mine) == want and {r.doc_tokens for r in mine} == {len(want) // 4}
    assert packing.decomposition(4096 * 2 + 5, 4096) == [4096, 4096, 4, 1]


# ---- urls -------------------------------------------------------------------------------------


def test_rules(spark):
    urls = ["http://WWW.Example.com/en/x?y#z", "https://a.example.com/en/", "http://example.com/fr/", "x.net/es/1", "ftp://b.net/es/1", "http://net/fr/", "http://c.org/es/", None, "", "http://É.com", "a://b://net/es/"]
    frame_ = spark.createDataFrame([(i, u, "k", 1.0) for i, u in enumerate(urls)], "page_id int, url string, suffix string, score double")
    labels = spark.createDataFrame([], "url string, blocked int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(frame_, labels, url_filter.RULES).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[1] == ("a.example.com", "/en/", "example.com/en/", "block") and got[2][2:] == ("com/", "allow")
    assert got[3] == ("", "", None, "allow") and got[4][2:] == ("net/es/", "block") and got[5][2:] == ("net/fr/", "block")
    assert got[6][2:] == (None, "allow") and got[7] == got[8] == ("", "", None, "allow") and got[9] == ("É.com", "", None, "allow")
    assert got[10] == ("b:", "//net/es/", None, "allow")


def test_trees_learn_from_labelled_urls(spark):
    urls = [(i, f"http://{'spam-farm' if i % 3 == 0 else 'site'}{i % 5}.org/{i}") for i in range(240)]
    df = spark.createDataFrame(urls, "page_id int, url string")
    labelled = df.where("page_id < 160").select("url", (F.col("page_id") % 3 == 0).cast("int").alias("blocked"))
    got = url_filter.filter_urls(df, labelled, [], trees=3).collect()
    assert len(got) == 240 and np.mean([(r.verdict == "block") == (r.page_id % 3 == 0) for r in got]) > 0.95


# ---- preferences ------------------------------------------------------------------------------


def test_preference_pairs(spark):
    schema = "pair_id long, turn long, role string, text string, side string, said string"
    c = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (2, 0, "user", "a"), (None, 0, "user", "lost"), (3, None, None, None), (3, 5000, "assistant", "late")]
    r = [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "a"), (4, 0, "user", "only rejected")]
    make = lambda rows: spark.createDataFrame([(*x, "s", "t") for x in rows], schema)
    got = {(x.pair_id, x.block): x for x in preferences.preference_pairs(make(c), make(r)).collect()}
    one = got[1, 0]
    assert one.prompt.text == "<|user|>\nhi\n<|end|>\n" and one.chosen.text == "<|assistant|>\nyes\n<|end|>\n" and one.rejected.turns == 1
    (span,) = one.chosen.ranges
    assert one.chosen.text[span.start : span.stop] == "yes\n<|end|>\n"
    assert got[2, 0].prompt.turns == 1 and got[2, 0].chosen.text == got[2, 0].rejected.text == ""
    assert got[3, -1].chosen.text == "<||>\n\n<|end|>\n" and got[3, 4].chosen.turns == 1 and got[4, 0].rejected.turns == 1
    assert {p for p, _ in got} == {1, 2, 3, 4}


# ---- FLAC -------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=300) | st.binary(min_size=1, max_size=9).map(lambda b: b * 700), min_size=1, max_size=6))
def test_flac_round_trip(payloads):
    streams = flac.encode(payloads)
    assert [d[0] for d in flac.decode(streams)] == payloads
    for stream, payload in zip(streams, payloads):
        info, frames = flac.parse_stream(stream), []
        flac._walk(stream, info, frames)  # bit by bit, without the seek table
        assert flac._joined(info, frames)[0] == payload
        assert [b[0] for b in flac.decode([stream])[0][1]] == list(range(0, len(payload), flac.BLOCK))


def frame_of(fields, size):
    """A frame with the given (value, bits) fields as its subframe."""
    bits = "".join(format(v & (1 << n) - 1, f"0{n}b") for v, n in fields)
    bits += "0" * (-len(bits) % 8)
    head = bytes([0xFF, 0xF8, 0x74, 0x02, 0]) + (size - 1).to_bytes(2, "big")
    body = head + bytes([flac.crc8(head)]) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    crc = flac.crc16(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]))[0]
    return body + int(crc).to_bytes(2, "big")


@pytest.mark.parametrize(
    "fields, want",
    [
        # Fixed order 1, two partitions: Rice parameter 1, then an escape of 3 raw bits.
        ([(0, 1), (9, 6), (0, 1), (10, 8), (0, 2), (1, 4), (1, 4), (1, 1), (0, 1), (15, 4), (3, 5), (2, 3), (-3, 3)], [10, 10, 12, 9]),
        # Verbatim with one wasted bit.
        ([(0, 1), (1, 6), (1, 1), (1, 1), (5, 7), (-6, 7), (0, 7), (1, 7)], [10, -12, 0, 2]),
    ],
)
def test_flac_subframes_bit_by_bit(fields, want):
    raw = frame_of(fields, 4)
    head = flac._frame_head(raw, 0, flac.Stream(4, bytes(16), 8, 0, []))
    assert flac._checked(raw, 0, head, None)[0].tolist() == want


def test_flac_checksums_known_values():
    assert flac.crc8(b"123456789") == 0xF4  # CRC-8, polynomial 7
    assert flac.crc16(np.frombuffer(b"123456789", np.uint8), np.array([0]), np.array([9]))[0] == 0xFEE8  # CRC-16/UMTS


def test_broken_media_is_reported(spark, odd):
    stored = flac_column.encode_media(flac_column.payloads(frame(spark, odd)).select("doc_id", "payload", "text"))
    good = flac_column.decode_media(stored).collect()
    for r in good:
        raw = (r.text or "").encode()
        assert bytes(r.pcm) == raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)) and r.media_error is None
        assert sum(b.samples for b in r.blocks) == len(r.pcm)
    spoilt = stored.withColumn("media", F.when(F.col("doc_id") == 14, F.expr("overlay(media placing X'00' from 200)")).when(F.col("doc_id") == 1, F.lit(b"nonsense")).when(F.col("doc_id") != 2, F.col("media")))
    got = {r.doc_id: r for r in flac_column.decode_media(spoilt).collect()}
    assert got[14].pcm is None and got[14].media_error and got[1].media_error == "no stream marker"
    assert got[2].pcm is None and got[2].media_error is None and got[7].pcm is not None


def test_registered_media_digests(spark):
    rows = flac_column.op10_flac_media(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        raw = r.text.encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:]) and r.n_bytes == len(raw)


# ---- pipeline ---------------------------------------------------------------------------------


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SMALL)
        assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    packed = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in packed} == ids and 0 < len(ids) < docs.count()
    assert ngram_join.similarity_classes(kept).where("doc_id <> component_id").count() == 0
    assert decontaminate.find_leaks(kept, spark.read.parquet(f"{SMALL}/benchmark.parquet")).count() == 0


# ---- names and types of other columns -----------------------------------------------------------


def test_clashing_and_dotted_names(spark):
    line = "a line of many sites"
    rows = [(i, f"own {i}\n{line}", f"s{i}", 1, 2, 3, "d") for i in range(8)] + [(3, f"own 3 again\nother\n{line}", "s3", 1, 2, 3, "d")]
    names = ["doc_id", "text", "source", "row", "gone", "h1", "a.b"]
    docs = spark.createDataFrame(rows, names)
    lines = line_dedup.strip_boilerplate(docs)
    assert lines.columns == [*names, "n_lines", "n_removed"]
    assert sorted(r.text for r in lines.collect() if r.doc_id == 3) == ["own 3", "own 3 again\nother"]
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, label int")
    assert quality_knn.score(docs, quality_knn.fit(docs, labels)).columns == [*names, "score"]
    items = spark.createDataFrame([(7, "own 5 and this passage of a test item"), (8, "nothing of the kind stands anywhere")], "item_id int, text string")
    held = docs.union(spark.createDataFrame([(50, "before own 5 and this passage of a test item behind", "s", 1, 2, 3, "d")], names))
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(held, items).collect()] == [(50, 7)]
    kept = decontaminate.drop_leaks(held, items)
    assert kept.columns == names and kept.count() == 9


def test_rejected_conversations_share_a_prefix(spark):
    rows = preferences.op9_preference_pairs(spark, SMALL).collect()
    assert sum(r.prompt_turns > 0 for r in rows) > 0.9 * len(rows) and sum(r.chosen != r.rejected for r in rows) > 0.5 * len(rows)


def test_suffix_rates_leave_out_the_own_fold(spark):
    rng = np.random.default_rng(11)
    rows = [(f"u{i}", f"s{i % 7}", float(rng.integers(0, 2)), i % 5) for i in range(200)]
    known = spark.createDataFrame(rows, "url string, suffix string, label double, fold int")
    got = {r.url: (r.suffix_labelled, r.suffix_blocked) for r in url_filter.out_of_fold(known, known, 0.4).collect()}
    for url, suffix, _, fold in rows:
        others = [r[2] for r in rows if r[1] == suffix and r[3] != fold]
        want = (np.log1p(len(others)), (sum(others) + 20 * 0.4) / (len(others) + 20))
        assert np.allclose(got[url], want)


def test_url_trees_on_held_out_labels(spark):
    """Labels that hold for a host and for long query strings, learned from two thirds of the urls."""
    rng = np.random.default_rng(12)
    urls = [f"https://{h}.example.{t}/a/{i}{'?x=1&y=2&z=3' if q else ''}" for i, (h, t, q) in enumerate(zip(rng.choice(["win", "news", "shop", "blog"], 900), rng.choice(["org", "edu"], 900), rng.random(900) < 0.3))]
    bad = [int("//win." in u or "?" in u) for u in urls]
    df = spark.createDataFrame(list(zip(range(900), urls, bad)), "page_id long, url string, truth int")
    known = df.where("page_id % 3 <> 0").select("url", F.col("truth").alias("blocked"))
    out = url_filter.filter_urls(df, known, []).where("page_id % 3 = 0").collect()
    assert np.mean([(r.verdict == "block") == bool(r.truth) for r in out]) > 0.95
    noise = known.withColumn("blocked", (F.xxhash64("url") % 2 == 0).cast("int"))
    scores = [r.score for r in url_filter.filter_urls(df, noise, []).collect()]
    assert np.std(scores) < 0.3 and abs(np.mean(scores) - 0.5) < 0.1  # labels without cause teach little


def test_pieces_are_looked_up_once_with_the_empty_one_among_them():
    small = WordEncoder(_path("byte_bpe_50k.json"), cache_bytes=20_000)
    words = ["", *(f" word{chr(97 + i % 26)}{'x' * (i % 7)}" for i in range(180)), " Élan", ","]
    words = list(dict.fromkeys(words))
    for _ in range(3):  # fresh, from the newer half, from the older half
        assert small._ids(words) == [b"", *small.direct(words[1:])]
        assert small._ids(words[::-1]) == [*small.direct(words[:0:-1]), b""]
    asked = []
    small._ids = lambda pieces: asked.append(pieces) or WordEncoder._ids(small, pieces)
    texts = ["a b", "", None, "b a, a"]
    assert small.encode(texts) == [b"" if not t else small.direct([t])[0] for t in texts]
    assert len(asked) == 1 and len(set(asked[0])) == len(asked[0])
