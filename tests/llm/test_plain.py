"""The corpus operators and the pipeline against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from tidewire.llm import common, fingerprint, html_text, jaccard, langid, mixing, packing, topk

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{BASE}/documents.parquet")


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def trained(rows):
    """rows: (doc_id, text, lang)."""
    return plain.Language([(t, g) for i, t, g in rows if t is not None and g is not None and not plain.held_out(i)])


def test_language_against_a_plain_scorer(spark, documents):
    rows = [(r.doc_id, r.text, r.lang) for r in documents.collect()]
    model = trained(rows)
    got = {r.doc_id: r for r in langid.op5_langid(spark, BASE).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        lang, score = model.predict(text)
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-3 and got[i].held_out == plain.held_out(i)


def test_language_of_more_labels_than_a_thousand_and_of_nothing(spark):
    rows = [(3 * k, f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}q" * 2, f"l{k:04}") for k in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, F.lit(True))
    assert len(model.languages) == 1200
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()}
    assert got == {i: g for i, _, g in rows}
    nothing = langid.fit(df.limit(0), F.lit(True))
    assert {(r.lang_pred, r.score) for r in langid.predict(df, nothing).collect()} == {("und", 0.0)} and langid.predict(df.limit(0), model).count() == 0


def mixture_of(df, **limits):
    """(rows with how often each is to be read, plainly) of a table."""
    rows = mixing.marked(df, 0).select("source", "hash", "tokens").collect()
    blocks = df.sparkSession.createDataFrame([(r.source, r.hash % 1024, e) for r in rows for e in range(3)], "source string, block int, epoch int").distinct()
    place = {(r.source, r.block, r.epoch): r.place for r in blocks.withColumn("place", mixing._place(F.col("epoch"), 0)).collect()}
    times = plain.mixture([(r.source, r.hash, r.tokens) for r in rows], lambda s, b, e: place[s, b, e], **limits)
    want = Counter()
    for r, n in zip(rows, times, strict=True):
        want[r.source, r.hash] += n
    return want


@pytest.mark.parametrize("broadcast_sources", [100_000, 0])
def test_mixture_against_a_plain_one(spark, documents, broadcast_sources):
    odd = [(k, ("word " * (k % 7)) or None, ["a", "b", None, "c", "none"][min(k % 11, 4)] if k % 11 < 4 else "big") for k in range(400)] + [(1, "x y", "empty"), (2, None, "void"), (2, None, "void"), (3, "x " * 40, "c"), (3, "x " * 40, "c")]
    for df in (documents.select("doc_id", "text", "source"), spark.createDataFrame(odd, "doc_id long, text string, source string").withColumn("block", F.lit("clash"))):
        mixed = mixing.mix(df, broadcast_sources=broadcast_sources)
        again = mixing.marked(mixed.select("doc_id", "text", "source"), 0).select("source", "hash").collect()
        assert Counter((r.source, r.hash) for r in again) == mixture_of(df)


def test_mixture_of_one_source_of_nothing_and_with_goals(spark):
    df = spark.createDataFrame([(k, "w " * (k + 1), "abc"[k % 3] if k % 9 else "b") for k in range(90)], "doc_id long, text string, source string")
    assert mixing.mix(df.filter("source = 'a'")).count() == df.filter("source = 'a'").count()
    nothing = df.withColumn("text", F.lit(None).cast("string"))
    assert mixing.mix(nothing).count() == 90 and mixing.mix(df.limit(0)).count() == 0
    total = df.count() and mixing.mix(df, max_repeats=None, entropy=0.999, budget=20_000.0).agg(F.sum("n_tokens")).first()[0]
    assert abs(total - 20_000) < 3 * 91
    s = mixing.Sources(np.array([100, 10, 1]), np.array([1, 2, 5]))
    assert abs(s.entropy_share(s.bisect(None, 0.9, None)) - 0.9) < 1e-9


PAGES = [
    ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A  b\n   c"),
    ("<table><tr><th>n<th colspan=2>wide<tr><td>1<td>2<td>3<tr><td rowspan=0>x<td>y<td>z<tr><td>p<td>q</table>", "n  wide\n1  2  3\nx  y  z\n   p  q"),
    ("<table><thead><tr><td rowspan=3>h<td>i</thead><tbody><tr><td>j<td>k</table>", "h  i\nj  k"),
    ("<table><tr><td>a<table><tr><td>x<td>y</table><td>b</table>", "a     b\nx  y"),
    ("<table><caption>cap</caption><tr><td>a<td><p>b<p>c<td>d</table>", "cap\na  b  d\n   c"),
    ("<pre>a  b\n  c</pre>d", "a  b\n  c\n\nd"),
    ("<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>", "s\ns\nyes"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("<ol start=3><li>a<ul><li>b<li>c</ul><li>d</ol>", "3. a\n   - b\n   - c\n4. d"),
    ("<div>" * 300 + "deep", "deep"),
    ("<select><option>o1<option>o2</select>", "o1\no2"),
    ("<p>a<br>b<hr>c<blockquote>q<p>r</blockquote>", "a\nb\n\n----\nc\n\n    q\n\n    r"),
    ("<dl><dt>t<dd>d</dl>", "t\n    d"),
    ("a<!-- no -->b<p style='display:none'>no</p><span style='visibility: hidden'>no</span><span hidden>no</span>c", "abc"),
    ("<b>bold</b> and<i> it</i>alic &lt;x&gt; &#233;", "bold and italic <x> é"),
    ("<p>" + "long " * 50_000, ("long " * 50_000).strip()),
    ("<", "<"),
    ("", ""),
    ("<div style='visibility:hidden'>no<span style='visibility:visible'>yes</span>no</div>", "yes"),
    ("<div style='visibility:hidden'><ul><li>no<li style='visibility: visible'>a</ul><hr><br></div>b", "- a\n\nb"),
    ("<p style='visibility:hidden'>no<p style='visibility:inherit'>c", "c"),
    ("<div style='visibility:collapse'><b style='visibility:visible'>d<i style='visibility:hidden'>no</i></b></div>", "d"),
    ("a<b style='display:nonesuch'>b</b><i style='x-display:none'>c</i><u style='display:none;display:inline'>d</u><s style='display:inline;display:none'>no</s>", "abcd"),
    ("<p style='DISPLAY : NONE !important'>no</p>e", "e"),
    ("<table><tr><td style='visibility:hidden'>no<td>f<tr><td>long<td>g</table>", "      f\nlong  g"),
    ("<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>h</table>", "  h"),
    ("<table><tr><td>" + "word " * 30 + "<td>i<tr><td>j<td>k</table>", "\n".join(["word " * 11 + "word  i", "word " * 11 + "word", "word word word word word word", "j" + " " * 60 + "k"])),
    ("<table><tr><td>l<td>" + "word " * 30 + "</table>", "l  " + ("word " * 30).strip()),
    ("<table><tr><td>" + "x" * 70 + "<td>m<tr><td>n<td>o</table>", "x" * 70 + "  m\nn" + " " * 71 + "o"),
    ("<table><tr><td><pre>p\n\nq</pre><td>r</table>", "p  r\n\nq"),
    ("<table><tr><td>s<br><br>t<td>u</table>", "s  u\n\nt"),
    ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"),
    ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
    ("<ol reversed start=10><li>a<li value=-1>b<li>c</ol>", "10. a\n-1. b\n-2. c"),
    ("<ol start=x><li value=y>a</ol><ul><li value=9>b</ul>", "1. a\n\n- b"),
    ("<p hidden=until-found>no</p><p aria-hidden=true>shown", "shown"),
    ("<h1>T<h2>U</h1>v", "T\n\nU\n\nv"),
    ("a<script>if (1<2) '</b>'</script>b<style>p{}</style>c", "abc"),
    ("<p>one<div>two</div>three</p>", "one\n\ntwo\nthree"),
    ("<a href=x>link</a>, <img alt=no>text<wbr>ed", "link, texted"),
    ("<textarea>a\n  b</textarea>", "a\n  b"),
    ("<ul><li>a<p>b</p><li><ol><li>c</ol></ul>", "- a\n\n  b\n\n- 1. c"),
    ("x&nbsp;y &copy; &#x41;&unknown;", "x\xa0y © A&unknown;"),
    ("<!doctype html><html><head><title>t</title></head><body>body</body></html>", "body"),
    ("<template>no</template><noscript>no</noscript><iframe>no</iframe>yes", "yes"),
    ("<table><tr><td>a</td></tr></table><table><tr><td>b</table>", "a\n\nb"),
    ("<blockquote>a<blockquote>b</blockquote></blockquote>", "    a\n\n        b"),
    ("<fieldset><legend>l</legend>f</fieldset><button>go</button><input type=submit value=send>", "l\nf\n\ngosend"),
]


def test_pages_and_their_text(spark):
    df = spark.createDataFrame([(k, h) for k, (h, _) in enumerate(PAGES)], "page_id long, html string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got == {k: t for k, (_, t) in enumerate(PAGES)}
    assert html_text.extract(df.limit(0)).count() == 0


def plain_signature(text, samples):
    """Consistent weighted sampling, a word and a sample at a time; None where two words are nearly equal."""
    bag = Counter(plain.words_of(text))
    raw = " ".join(bag).encode()
    data = np.frombuffer(raw, np.uint8)
    ends = np.cumsum([len(w.encode()) + 1 for w in bag]) - 1
    terms = common.word_hash(data, ends - np.array([len(w.encode()) for w in bag]), ends)
    r, b, ln_c = (x.astype(float) for x in fingerprint._draws(terms, samples))
    out = []
    for k in range(samples):
        ranked = []
        for j, n in enumerate(bag.values()):
            t = math.floor(math.log(n) / r[j, k] + b[j, k])
            low = int(terms[j]) % 2**32 * 0x9E3779B1
            ranked.append((ln_c[j, k] - r[j, k] * (t - b[j, k]) - r[j, k], (low + t * 0x85EBCA6B) * 0xC2B2AE3D27D4EB4F % 2**64 >> 48))
        ranked.sort()
        out.append(None if len(ranked) > 1 and ranked[1][0] - ranked[0][0] < 1e-3 else max(ranked[0][1], 1))
    return out


def test_fingerprints_against_a_plain_sampler_and_true_likeness(documents):
    texts = [r.text for r in documents.orderBy("doc_id").limit(60).collect() if plain.words_of(r.text)]
    marks = fingerprint.of_texts(texts)
    for text, got in list(zip(texts, marks, strict=True))[:12]:
        assert all(w is None or w == g for w, g in zip(plain_signature(text, 64), got.tolist(), strict=True))
    rng, off, misses = random.Random(1), [], 0
    for text in texts:
        other = rng.choice(texts)
        near = " ".join(w for w in (plain.words_of(text) + plain.words_of(other)[:20]) if rng.random() < 0.8) or "x"
        for a, b in ((text, near), (text, other)):
            x, y = Counter(plain.words_of(a)), Counter(plain.words_of(b))
            p = sum((x & y).values()) / sum((x | y).values())
            m = fingerprint.of_texts([a, b], 256)
            error, sd = float(fingerprint.likeness(m[:1], m[1:])[0]) - p, math.sqrt(max(p * (1 - p), 1e-4) / 256)
            off.append(error / sd)
            misses += abs(error) > 3 * sd
    assert misses <= 4 and abs(np.mean(off)) < 0.5


def test_fingerprints_of_null_and_repeated_ids(spark, tmp_path):
    rows = [(5, "five words are in here"), (None, "no id"), (None, None), (5, "again five"), (2, None), (-7, "least")]
    base = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{base}/documents.parquet")
    got = Counter((r.doc_id, r.n_chars) for r in fingerprint.op9_fingerprint(spark, base).collect())
    assert got == Counter((i, len(t or "")) for i, t in rows)
    for k, part in enumerate(([(1, "one row")], [(None, "one row")], [])):
        spark.createDataFrame(part, "doc_id long, text string").write.parquet(f"{base}/{k}/documents.parquet")
        got = fingerprint.op9_fingerprint(spark, f"{base}/{k}").collect()
        assert len(got) == len(part) and all(r.near_next == 1 for r in got)


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates_against_all_pairs(spark, block):
    rng = random.Random(block)
    prose = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    base, rows = prose(60), []
    big = (1 << 62) - 500
    for k in range(60):
        text = list(base)
        for _ in range(k % 4):
            text[rng.randrange(60)] = "new"
        rows.append((big + k, " ".join(text)))
    rows += [(k, " ".join(prose(rng.choice((3, 5, 30))))) for k in range(40)]
    rows += [(1000 + k, rows[70][1] + " x" * k) for k in range(4)] + [(2000, None), (2001, ""), (2002, "A b C"), (2003, "a B c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = jaccard.sets(df)
    from tidewire.operators.graph import components

    found = {r.node: r.component for r in components(jaccard.links(sets, block=block)).collect()}
    assert {i: found.get(i, i) for i, _ in rows} == plain.components(rows)


def test_representative_of_rows_that_repeat_an_id(spark):
    rows = [(1, "b c", "x"), (1, "a d", "y"), (1, "a d", "y"), (2, None, "z"), (2, "", "z"), (None, "a d", "n"), (3, "A D", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __stay string")
    got = sorted((r.doc_id or 0, r.text or "", r[2]) for r in jaccard.representatives(df).collect())
    assert got == [(0, "a d", "n"), (1, "a d", "y"), (2, "", "z"), (2, "", "z")]


def test_top_k_in_waves_and_slabs(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(600, 6)), 3)
    v = spark.createDataFrame([(k, [float(a) for a in row]) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    q = np.floor(1024 * x).astype(np.int64)
    want = {(i, r + 1, int(j), int(q[i] @ q[j])) for i in range(0, 600, 7) for r, j in enumerate(sorted((j for j in range(600) if j != i), key=lambda j: (-int(q[i] @ q[j]), j))[:10])}
    assert {tuple(r) for r in topk.top_k(v, F.col("vec_id") % 7 == 0, shard_rows=40, slab_rows=30).collect()} == want


def test_tiktoken_ids_are_those_of_tokenizers(tokenizer):
    rng = random.Random(7)
    alphabet = [*"abcdefgh ETAOIN 0123456789 .,;'!?\n\t\r\x0b\x0c\x1c\x85\xa0", " ", "　", "​", "é", "é", "ß", "中", "ي", "😀", "👩‍💻", "̀", "<|endoftext|>", "'s", "'LL", "  ", "\x00"]
    enc = packing.encoder("byte_bpe_50k.tiktoken")
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60)))
        assert enc.encode(text, allowed_special="all") == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(df)).count() == 0


def fixture():
    """Documents in two languages with junk, copies, near copies, passages and a small source."""
    rng = random.Random(11)
    vocabulary = {g: ["".join(rng.choice(s) for _ in range(rng.randrange(3, 9))) for _ in range(400)] for g, s in (("aa", "abcdeilnort"), ("bb", "kqwxyzuvghm"))}
    prose = lambda g, n: " ".join(rng.choice(vocabulary[g]) for _ in range(n))
    rows = [(k, prose(g := "aabb"[k % 2 * 2 :][:2], rng.randrange(20, 160)), g if k % 5 else None, "small" if k % 9 == 0 else "large") for k in range(120)]
    shared = prose("aa", 60)
    for k in range(0, 60, 6):
        rows[k] = (k, f"{rows[k][1]} {shared} {prose('aa', 10)}", *rows[k][2:])
    rows += [(200 + k, rows[k][1], "aa", "large") for k in range(0, 40, 4)]
    rows += [(300 + k, rows[k][1] + " " + prose("bb", 2), None, "small") for k in range(41, 60, 3)]
    rows += [(400, None, "aa", "large"), (401, "", "bb", None), (402, "12 34 56", "aa", "large"), (403, "!!!", None, "x"), (404, "日本", None, "small"), (405, prose("bb", 5000), "bb", None)]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


def test_pipeline_against_plain_stages(spark, tmp_path, tokenizer):
    import corpus_pipeline as p

    rows, base = fixture(), f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    stages = dict(p.STAGES)
    read = lambda df: Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    model = trained([r[:3] for r in rows])
    kept = [r for r in rows if model.predict(r[1])[0] != "und" and model.predict(r[1])[1] >= p.LEAST_SCORE]
    assert 0 < len(kept) < len(rows) and read(stages["language"](spark, table(rows), base)) == Counter(kept)

    root = plain.components([r[:2] for r in kept])
    once = [r for r in kept if root[r[0]] == r[0]]
    assert len(once) < len(kept) - 10 and read(stages["near_duplicates"](spark, table(kept), base)) == Counter(once)

    texts = dict(plain.without_passages([r[:2] for r in once]))
    clean = [(r[0], texts[r[0]], r[2], r[3], len(texts[r[0]]) if texts[r[0]] != r[1] else r[4]) for r in once]
    assert clean != once and read(stages["passages"](spark, table(once), base)) == Counter(clean)

    times = mixture_of(table(clean))
    by_hash = {(r.source, r.hash): r.row.doc_id for r in mixing.marked(table(clean), 0).collect()}
    reads = {by_hash[k]: n for k, n in times.items()}
    mixed = [r for r in clean for _ in range(reads[r[0]])]
    assert len(mixed) > len(clean) and read(stages["mixture"](spark, table(clean), base)) == Counter(mixed)

    want = Counter((r[0], *x) for r in mixed for x in plain.pieces(r[1], tokenizer))
    for packed in (stages["packing"](spark, table(mixed), base).collect(), p.run(spark, base).collect()):
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
        places = defaultdict(list)
        for r in packed:
            places[r.sequence_id].append((r.offset, r.length))
        for own in places.values():
            ends = [0, *(a + n for a, n in sorted(own))]
            assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048
