"""Turn repair, page text and token alignment against brute force, with odd rows."""

import hashlib
import html
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalweave.llm import conversation_repair as turns
from evalweave.llm import html_text, token_alignment
from evalweave.llm.packing import _path
from tests.conftest import SMALL

# ---- turn repair ------------------------------------------------------------------------------

LEGAL = re.compile("(s?(ua)+)?")


def cheapest(rows, most_inserts=3):
    """All edits of a few rows, tried one by one: the least (cost, audit) and its roles."""
    best = None
    choices = []
    for initial, dead, cut in rows:
        extra = 3 if cut else 0
        choices.append([(4, "D", "")] + ([] if dead else [(extra, "K", initial), (3 + extra, "R", "u"), (3 + extra, "R", "a")]))
    inserts = ["".join(p) for n in range(most_inserts + 1) for p in itertools.product("ua", repeat=n)]
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        if sum(map(len, gaps)) > most_inserts:
            continue
        for edits in itertools.product(*choices):
            roles = gaps[0] + "".join(e[2] + g for e, g in zip(edits, gaps[1:]))
            if LEGAL.fullmatch(roles):
                audit = "I" * len(gaps[0]) + "".join(e[1] + "I" * len(g) for e, g in zip(edits, gaps[1:]))
                weight = (sum(e[0] for e in edits) + 3 * sum(map(len, gaps)), audit)
                best = min(best, weight) if best else weight
    return best


row = st.tuples(st.sampled_from("suat"), st.booleans(), st.booleans()).map(lambda r: (r[0], r[1], r[2] and not r[1]))


@settings(max_examples=120, deadline=None)
@given(st.lists(row, max_size=4))
def test_edits_are_the_cheapest(rows):
    tops = turns.parse(rows)
    assert min(w for n, w in tops.items() if turns.accepts(n)) == cheapest(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(row, max_size=12), st.integers(0, 12))
def test_blocks_fold_to_the_whole(rows, cut):
    whole = turns.parse(rows)
    folded = {}
    for node, (cost, audit) in turns.parse(rows[:cut]).items():
        for target, (more, rest) in turns.parse(rows[cut:], node).items():
            folded[target] = min(folded.get(target, (10**9, "")), (cost + more, audit + rest))
    assert folded == whole


def test_automaton_has_few_stacks():
    assert len(turns.STACKS) == 8 and sum(map(turns.accepts, turns.STACKS)) == 3


def plain_repair(rows):
    """The contract over rows (conv, turn, role, text), in loops."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        convs[conv] += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    out = {}
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in found:
            visible = re.sub("[\x20\x09-\x0d]", "", text)
            faults.append("b" if not visible else "d" if (role, text) in seen else "t" if visible[-1] not in ".!?" else "")
            seen.add((role, text))
        cells = [(r[1][:1], f in ("b", "d"), f == "t") for r, f in zip(found, faults)]
        cost, audit = min(w for n, w in turns.parse(cells).items() if turns.accepts(n)) if cells else (0, "")
        lines, at, expect = [], iter(found), "user"
        for edit in audit:
            if edit == "I":
                role, text = expect, ""
            else:
                _, role, text = next(at)
                if edit == "D":
                    continue
                role = expect if edit == "R" else role
            lines.append(f"{role}:{text}")
            expect = "assistant" if role[:1] == "u" else "user"
        known = [r[0] for r in found if r[0] is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest)
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def from_rows(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, block string, n int")
    from pyspark.sql import functions as F

    return repaired(turns.repair(turns.damage(df), df.select(F.col("conv_id").alias("conv"))))


def test_repairs_of_the_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = repaired(turns.op11_turn_repair(spark, SMALL))
    assert got == plain_repair(rows) and len({v[6] for v in got.values()}) > 5


def test_repairs_of_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(turns, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(3)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "agent"], ["Yes.", "No!", "cut off", " \n", "", None, "a.\t", "É?"]
    rows = [(int(rng.integers(0, 6)), int(rng.integers(0, 40)), roles[rng.integers(0, 7)], texts[rng.integers(0, 8)]) for _ in range(300)]
    rows += [(None, None, "user", "x."), (None, 2, None, None), (7, None, "user", "one."), (7, None, "user", "one."), (8, 1, "user", "same.")] + [(9, t, "user", f"t{t}.") for t in range(60)]
    rows += [(8, 1, "user", "same.")] * 40 + [(10, t, "assistant" if t % 2 else "user", "long " * 2000 + f"{t}.") for t in range(30)]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone."))
    got = from_rows(spark, rows)
    assert got == plain_repair(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_no_conversations(spark):
    assert from_rows(spark, []) == {}


# ---- page text --------------------------------------------------------------------------------


def text_of(source, common=(), most=()):
    return html_text.main_text(html_text.Page(source), set(common), set(most))


def test_text_of_the_given_pages(spark):
    """The given pages mark their article, whose headings and paragraphs are its only blocks."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = html_text.op12_site_text(spark, SMALL).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        article = re.search("<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("plain  text\nonly", "plain text only"),
        ("<p>a &lt; b &amp; c&nbsp;d &#233;</p>", "a < b & c d é"),
        ("<body><header>Site</header><h1>T</h1><p>one<p>two<br>lines<footer>f</footer>", "T\n\none\n\ntwo lines"),
        ("<article><header><h1>T</h1></header><p>x</p><aside>s</aside><footer>f</footer></article><p>outside", "T\n\nx"),
        ("<article>t<section id=comments><article class=comment>c</article></section></article>", "t"),
        ("<main><nav>n</nav><p>x<b>y<p>z</b>w</main>", "xy\n\nzw"),
        ("<article><ul><li>1<li>2<ul><li>3</ul></ul><table><tr><td>a<td>b<tr><td>c</table></article>", "1\n\n2\n\n3\n\na\n\nb\n\nc"),
        ("<form id=page><article><h1>T</h1><p>long text of the article</p><form>mail<input></form></article></form>", "T\n\nlong text of the article"),
        ("<div class='cookie-notice'>ok?</div><div class=post-content><p>body of the post</p><div class='share'>s</div></div>", "body of the post"),
        ("<article>a<script>if (x<y) '</p>'</script>b<style>p{}</style><!-- c > --> d<!doctype x></article>", "ab d"),
        ("<article>1 < 2 and 3 <4</article>", "1 < 2 and 3 <4"),
        ("<article>kept</article><a href='x>", "kept"),
        ("<article>kept<a title=\"x > y\" href=z>link</a></article>", "keptlink"),
        ("<ul><li><a>A</a><li><a>B</a><li><a>C</a></ul><p>text with no root", "text with no root"),
        ("<article class='comment'>no</article><p>yes and a good deal longer", "yes and a good deal longer"),
        ("<article>x<noscript>js</noscript><iframe><p>f</iframe><button>b</button><select><option>o</select></article>", "x"),
        ("<p>é\x00\ud800".encode("utf-8", "replace").decode(), "é\x00?"),
    ],
)
def test_page_text(source, want):
    assert text_of(source) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<td>", "<table>", "</table>", "<div class=ad>", "</div>", "<", "</", "<!--", "-->", "a ", "&amp", "<article>", "</article>", "<a href='", "'>", "<script>", "</script>"]), max_size=30))
def test_any_markup_is_read(parts):
    page = html_text.Page("".join(parts))
    assert all(p < e for e, p in enumerate(page.parents)) and isinstance(html_text.main_text(page, set(), set()), str)
    assert page.sizes[0] == sum(len(" ".join(t.split())) for _, t in page.events if t)


def test_hostile_markup_takes_linear_time():
    for part in ("<a", "<a \"", "<!--", "<b>", "<div>", "<p><b>", "<li><b>", "</x", "<td>", "='"):
        text_of("<ul><table><article>" + part * 60_000)


def site(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, host string, common string")


def test_templates_are_counted_per_host(spark):
    box, passage = "<div><p>Follow our channel</p></div>", "<p>A passage that many articles share.</p>"
    body = lambda i, extra="": f"<article><h1>Title {i}</h1>{passage if i % 3 == 0 else ''}<p>Own text {i}.</p>{extra}</article>"
    rows = [(i, f"https://a.example/{i}", body(i, box)) for i in range(30)]
    rows += [(100 + i, f"https://b{i}.example/", body(i, box)) for i in range(6)]  # once on each host
    rows += [(200 + i, "https://c.example/x", body(1, box)) for i in range(9)]  # copies of one page
    rows += [(300, None, body(5, box)), (301, "https://a.example/", None), (302, "no url", ""), (302, "no url", ""), (None, "https://a.example/", "<p>x")]
    rows += [(400 + i, f"https://d.example/{i}", f"<div>{box}<p>Own text {i} of a page without article.</p></div>") for i in range(12)]
    got = {r.page_id: r.text for r in html_text.extract(site(spark, rows)).collect()}
    own = lambda i: f"Title {i}\n\n" + ("A passage that many articles share.\n\n" if i % 3 == 0 else "") + f"Own text {i}."
    assert all(got[i] == own(i) for i in range(30))
    assert all(got[100 + i] == own(i) + "\n\nFollow our channel" for i in range(6))
    assert all(got[200 + i] == own(1) + "\n\nFollow our channel" for i in range(9))
    assert got[300] == own(5) + "\n\nFollow our channel" and got[301] == got[302] == "" and got[None] == "x"
    assert all(got[400 + i] == f"Own text {i} of a page without article." for i in range(12))


def test_paragraphs_on_most_pages_are_template(spark):
    rows = [(i, "https://a.example/", f"<article><p>Own {i}.</p><p>{'Read our terms.' if i < 15 else 'None.'}</p></article>") for i in range(20)]
    got = {r.page_id: r.text for r in html_text.extract(site(spark, rows)).collect()}
    assert got[3] == "Own 3." and got[17] == "Own 17.\n\nNone."


def test_no_pages_and_a_long_page(spark):
    assert html_text.extract(site(spark, [])).collect() == []
    long = "<p>paragraph of a long page</p>" * 200_000
    assert html_text.extract(site(spark, [(1, "https://a.example/", long)])).first().n_chars == 200_000 * 26 - 2


# ---- token alignment --------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)))
def test_groups_end_at_common_ends(a, b):
    a, b = sorted(a | {61}), sorted(b | {61})
    stops_a, stops_b = token_alignment.diagonal_groups(a, b)
    common = sorted(set(a) & set(b))
    assert [a[i - 1] for i in stops_a] == common and [b[j - 1] for j in stops_b] == common


def test_long_runs_and_nothing():
    assert token_alignment.diagonal_groups([], []) == ([], [])
    a = list(range(1, 5001))
    stops = token_alignment.diagonal_groups(a, a[:2000] + a[2001:])
    assert len(stops[0]) == 4999 and stops[0][1999:2001] == [2000, 2002] and stops[1][-1] == 4999


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=_path("piece_bpe_32k.model"))
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(v): v for v in visible} | {chr(256 + k): v for k, v in enumerate(v for v in range(256) if v not in visible)}
    out, counts = [], {}
    for text in texts:
        a_ids, b_ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        a_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
        b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            out.append(([], [], [], [])), None
            continue
        spans = []
        for parts in (a_bytes, b_bytes):
            ends = list(itertools.accumulate(map(len, parts)))
            spans.append(list(zip([0, *ends[:-1]], ends)))
        links = [(a_ids[i], b_ids[j]) for i, (s, e) in enumerate(spans[0]) for j, (x, y) in enumerate(spans[1]) if s < y and x < e]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, start = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, sp) if start <= s and e <= cut) for ids, sp in zip((a_ids, b_ids), spans)))
            start = cut
        out.append((a_ids, b_ids, groups, links))
        for pair in set(links):
            counts[pair] = counts.get(pair, 0) + 1
    top = {}
    for (x, _), c in counts.items():
        top[x] = max(top.get(x, 0), c)
    return [
        (len(x), len(y), len(g), len(k), sum(counts[p] == top[p[0]] for p in k), sum(counts[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for x, y, g, k in out
    ]


def aligned(df):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((str(r.doc_id), *(r[c] for c in names)) for r in df.collect())


def test_alignment_of_the_given_documents(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(40)
    rows = docs.collect()
    texts = [(r.text or "")[:1500] for r in rows]
    df = spark.createDataFrame([(r.doc_id, t, "c") for r, t in zip(rows, texts)], "doc_id long, text string, links string")
    monkeypatch.setattr(token_alignment, "CHUNK_BYTES", 4000)
    got = aligned(token_alignment.align(df, a=_path("byte_bpe_50k.json"), b=_path("piece_bpe_32k.model")))
    assert got == sorted((str(r.doc_id), *w) for r, w in zip(rows, plain_alignment(texts)))


def test_alignment_of_odd_texts(spark):
    texts = [None, "", " ", "  two  blanks\n\n", "a", "a", "<s> </s> <unk> <|endoftext|> <0x41>", "é 漢字 🙂 ﬁ", "tab\there x", "▁ under", "x" * 3000, "\x00 nul", "﻿bom", "café"]
    rows = [(i if i != 5 else 4, t) for i, t in enumerate(texts)] + [(None, "a b c.")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "`doc.id` long, text string, pairs int")
    got = aligned(token_alignment.align(df, a=_path("byte_bpe_50k.json"), b=_path("piece_bpe_32k.model"), doc="doc.id"))
    assert got == sorted((str(i), *w) for (i, _), w in zip(rows, plain_alignment([t for _, t in rows])))
    none = df.limit(0)
    assert token_alignment.align(none, a=_path("byte_bpe_50k.json"), b=_path("piece_bpe_32k.model"), doc="doc.id").collect() == []


def test_pieces_give_the_figures_of_whole_texts(monkeypatch):
    signs = ["a", "St", "the", "x²", "3", "é", "漢", "🙂", "_", "-", "▁", " ", " ", " ", "\n", ".", ",", "...", "́", "\t", "<s>", "</s>", "<0x0A>", "\x00", "\u00a0"]
    draw = random.Random(5)
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 9))) for _ in range(1500)]
    texts += ["".join(draw.choices(signs[:16], k=draw.randint(5, 60))) for _ in range(300)] + ["x². y", "a 3². b", "one,two.\nthree, "]
    pair = token_alignment.token_pair(_path("byte_bpe_50k.json"), _path("piece_bpe_32k.model"))
    want = [(*w[:4], w[6]) for w in plain_alignment(texts)]
    for ids in (token_alignment.ALIGN_IDS, 7):
        monkeypatch.setattr(token_alignment, "ALIGN_IDS", ids)
        got = token_alignment.align_texts(pair, pa.array(texts, pa.string()))
        names = ["n_a", "n_b", "n_groups", "n_links", "hashes"]
        assert list(zip(*(list(got[c]) for c in names))) == want


def test_repeated_pieces_are_aligned_once(monkeypatch):
    met, plain = [], token_alignment.diagonal_groups

    def counted(ends_a, ends_b):
        met.append(len(ends_a))
        return plain(ends_a, ends_b)

    monkeypatch.setattr(token_alignment, "diagonal_groups", counted)
    pair = token_alignment.token_pair(_path("byte_bpe_50k.json"), _path("piece_bpe_32k.model"))
    found = token_alignment.align_texts(pair, pa.array(["Unlikely wordings, repeated." + " Unlikely wordings, repeated." * 99] * 20))
    assert sum(found["n_a"]) > 10_000 and sum(met) < 100


def test_a_text_beyond_a_chunk(spark):
    text = "The quick brown fox, 12 times. " * 160_000
    df = spark.createDataFrame([(1, text), (2, text[:31])], "doc_id long, text string")
    rows = {r.doc_id: r for r in token_alignment.align(df, a=_path("byte_bpe_50k.json"), b=_path("piece_bpe_32k.model")).collect()}
    assert rows[1].n_links == rows[1].n_a + rows[1].n_b - rows[1].n_groups and rows[1].count_sum >= rows[1].n_links


def test_a_task_of_the_alignment_holds_few_chunks(spark, monkeypatch):
    """Row groups hold few chunks, and the join has as many partitions as its chunks need, not as the session has."""
    import glob
    import os

    import pyarrow.parquet as pq

    from evalweave.functions.session import checkpoint_dir

    monkeypatch.setattr(token_alignment, "CHUNK_BYTES", 2000)
    texts = [f"Chunk {i} of the corpus, with words. " * 30 for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = token_alignment.align(df, a=_path("byte_bpe_50k.json"), b=_path("piece_bpe_32k.model"))
    folder = max(glob.glob(f"{checkpoint_dir(spark).removeprefix('file://')}/llm/aligned-chunks-*"), key=os.path.getmtime)
    footers = [pq.ParquetFile(f).metadata for f in glob.glob(f"{folder}/*.parquet")]
    groups = [m.row_group(i).num_rows for m in footers for i in range(m.num_row_groups)]
    assert sum(groups) == 60 and max(groups) <= token_alignment.GROUP_CHUNKS
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(rf"RepartitionByExpression \[chunk#\d+L?\], {-(-60 // token_alignment.TASK_CHUNKS)}\b", plan)) == 2
    assert found.count() == 60
