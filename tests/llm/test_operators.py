"""The other corpus operators: brute force, round trips and held-out accuracy."""

import hashlib
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import common, fingerprints, html_text, mixing, orc_tokens, queries, sentencepiece_bridge, toxicity

PAGES = {
    "<html><head><title>x</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>One <b>t</b>wo.<br><p>Three\n  four.</article><footer>&copy; me</footer>": "T & U One two. Three four.",
    "<div id='sidebar'>a b c</div><div class='post-content'><p>Hello world, a text.</p><p>Another, longer text of the article.</p><div class='comments'><p>nice post, really</p></div></div><form>q</form>": "Hello world, a text. Another, longer text of the article.",
    "<div class='cookie-notice'>We use cookies</div><main><h1>T</h1><p>1 < 2 and so on</p></main>": "T 1 < 2 and so on",
    "<article><header><h1>Title</h1></header><p>Text</p><section id='comments'><p>A reader has far more to say here than the article itself.</p></section></article><aside>foo</aside>": "Title Text",
    "plain text": "plain text",
    "": "",
    None: "",
    "<p>": "",
    "<!-- only -->": "",
}


def test_html(spark):
    rows = [(i, "u", h) for i, h in enumerate(PAGES)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    got = {r.page_id: (r["text_"], r.n_chars, r.text) for r in html_text.extract(df).collect()}
    for i, want in enumerate(PAGES.values()):
        assert got[i] == (want, len(want), "mine")
    assert html_text.extract(df.limit(0)).count() == 0


PROSE = "Words of an article stand here, one after another, and there are quite many of them. "


def test_density_decides():
    """Pages without an article element; link lists; names on prose; a switched-off density."""
    menu = "".join(f"<li><a href=/{i}>Entry {i}</a></li>" for i in range(9))
    body = "".join(f"<p>{PROSE * 3}{i}</p>" for i in range(4))
    want = " ".join(f"{PROSE * 3}{i}" for i in range(4))
    page = f"<div><ul>{menu}</ul></div><div>{body}</div><div><p>Short line</p></div>"
    assert html_text.main_text(page) == want
    inner = f"<div><div>{body}<ul>{menu}</ul></div></div><table><tr><td>x</table>"
    assert html_text.main_text(inner) == want
    sections = f"<div><section>{body}</section><section>{body}</section></div><div><a href=/a>a</a> <a href=/b>b</a></div>"
    assert html_text.main_text(sections) == f"{want} {want}"
    kept = f"<article><h2 class='related-work'>Related work</h2><p class='legal'>{PROSE}</p><p id='notice'>{PROSE}</p></article>"
    assert html_text.main_text(kept) == f"Related work {PROSE}{PROSE}".strip()
    comments = f"<div><div>{body}</div><div id='comments'>{body * 5}</div></div>"
    assert html_text.main_text(comments) == want
    root = html_text.parse(page)
    assert " ".join(html_text.blocks(root)) != want and html_text.main_node(root).tag == "div"


def test_comments_and_raw_text():
    assert html_text.main_text("<!-->text") == html_text.main_text("<!--->text") == "text"
    assert html_text.main_text("<p>a<!-- > b -->c</p>") == "ac"
    start = time.time()
    html_text.main_text("<textarea>" * 20_000)
    assert time.time() - start < 2


def test_html_query_against_another_parser(spark):
    """On pages with an article element: what html.parser finds in it."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = False, [[]]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag in ("article", "h1", "p", "br"):
                self.blocks.append([]) if tag != "br" else self.blocks[-1].append("")

        def handle_endtag(self, tag):
            self.inside &= tag != "article"

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1].append(data)

    folder = "/root/testdata/sf0.001"
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op1_html_extraction(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(rows)
    squeeze = lambda x: "".join(x.split())
    for r in rows:
        reader = Reader()
        reader.feed(r.html)
        assert squeeze(got[r.page_id][0]) == squeeze("".join("".join(b) for b in reader.blocks)) and got[r.page_id][1] == len(got[r.page_id][0])


def test_toxicity(spark, docs, nothing, labels):
    word = {0: "fine plain words", 1: "you total idiot"}
    rows = [(i, f"text {i * 7919 % 101} {i % 13} {word[i % 2]} more {i % 17}", i % 2) for i in range(400)]
    made = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scored = toxicity.score(made.select("doc_id", "text"), made.select("doc_id", "toxic")).withColumn("held_out", toxicity.held_out())
    for r in scored.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) == r.doc_id % 2
    odd = toxicity.score(docs, labels)
    assert odd.count() == docs.count() and odd.where("score <> 'mine'").count() == 0
    assert toxicity.clean(docs, labels).columns == docs.columns
    assert [r.score for r in toxicity.score(made.select("doc_id", "text").limit(3), labels.limit(0)).collect()] == [0.0] * 3
    assert toxicity.score(nothing, labels).count() == 0


def test_ftrl_is_sparse():
    rng = np.random.default_rng(0)
    rows = [(np.unique(np.append(rng.integers(0, 5000, 30), 5000 + y)).astype(np.int32), int(y)) for y in rng.integers(0, 2, 500)]
    at, w = toxicity.ftrl(rows)
    weights = dict(zip(at.tolist(), w.tolist(), strict=True))
    assert weights[5001] > 1 > 0 > weights.get(5000, -1) and len(at) < 500


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 100, 1000], [5, 2, 1]) == pytest.approx([30, 300, 780])
    assert mixing.targets([0, 5], [5, 2]) == pytest.approx([0, 5])


def test_splitting_tree():
    quotas = np.array([1000, 37, 0, 5])
    parts = mixing.split(quotas, 7)
    assert (parts.sum(0) == quotas).all() and (parts >= 0).all()
    assert parts.sum(1).max() - parts.sum(1).min() <= 3
    for n in (1, 2, 17, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 3).tolist()) == list(range(n))


def test_mix(docs, corpus, nothing):
    got = mixing.plan_mix(docs).collect()
    sizes = Counter((r[0], r[3], len((r[1] or "").split())) for r in corpus)
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == sizes
    total = sum(k[2] * n for k, n in sizes.items())
    by = {s: [r for r in got if r.source == s] for s in {r.source for r in got}}
    want = dict(zip(sorted(by, key=lambda s: (s is None, s or "")), mixing.targets([sum(r["size"] for r in by[s]) for s in sorted(by, key=lambda s: (s is None, s or ""))], [5, 2, 1, 5][: len(by)]), strict=True))
    assert sum(want.values()) == pytest.approx(total)
    for s, rows in by.items():
        assert len({r.target for r in rows}) == 1 and rows[0].target == pytest.approx(want[s])
        assert {r.source_size for r in rows} == {sum(r["size"] for r in rows)}
        assert abs(sum(r.taken for r in rows) - want[s]) <= 0.05 * want[s] + 1
    assert all(r.taken <= 3 * r["size"] and r.taken == r["size"] * len(r.shards) for r in got)
    shards = Counter()
    for r in got:
        assert len(r.shards) == len(r.places) == len(r.quotas) and all(0 <= p < q for p, q in zip(r.places, r.quotas, strict=True))
        shards.update((r.source, s, q) for s, q in set(zip(r.shards, r.quotas, strict=True)))
    assert len({k[:2] for k in shards}) == len(shards)  # one quota for each source and shard
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(len(r.shards) for r in got)
    assert mixing.plan_mix(docs).exceptAll(mixing.plan_mix(docs)).count() == 0
    assert mixing.plan_mix(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_fingerprints(docs, corpus, nothing):
    got = fingerprints.compare_neighbours(docs).collect()
    rows = sorted(((r[0], r[1] or "") for r in corpus), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    want = Counter()
    for (i, x), (_, y) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(x) // 4
        want[(i, len(x), hashlib.sha256((x[: len(x) - n] + y[:n]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    same = {r.doc_id: r for r in got if r.doc_id in (1, 2)}
    assert same[1].fingerprint == same[2].fingerprint and same[1].near_next == 1.0
    assert fingerprints.compare_neighbours(nothing).count() == 0
    assert fingerprints.compare_neighbours(docs.where("doc_id = 1")).first().near_next == 1.0


def test_sampling_estimates_generalised_jaccard():
    rng = np.random.default_rng(4)
    sampler, off = fingerprints.Sampler(), []
    for k in range(40):  # other words each time, so that errors are independent
        a, b = (Counter(f"{k}-{x}" for x in rng.zipf(1.4, 300) % 200) for _ in range(2))
        both = set(a) | set(b)
        true = sum(min(a[w], b[w]) for w in both) / sum(max(a[w], b[w]) for w in both)
        s = sampler.signatures(fingerprints.bags([" ".join(x.elements()).encode() for x in (a, b)]))
        off.append(float(fingerprints.likeness(s[0], s[1])) - true)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.07


def test_sampler_against_exact_variates():
    """Ioffe's sampling with gamma and uniform variates of numpy, without tables: the same mean likeness as the sampler."""
    rng = np.random.default_rng(9)
    got, want, true = [], [], []
    for k in range(30):
        a, b = (rng.integers(0, 6, 80) for _ in range(2))
        true.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
        words = np.array([zlib.crc32(f"{k}-{i}".encode()) for i in range(80)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(words)
        s = fingerprints.Sampler().signatures([(words[order][x[order] > 0], x[order][x[order] > 0]) for x in (a, b)])
        got.append(fingerprints.likeness(s[0], s[1]))
        r, logc, beta = rng.gamma(2, 1, (80, 512)), np.log(rng.gamma(2, 1, (80, 512))), rng.random((80, 512))

        def keep(x, r=r, logc=logc, beta=beta):
            level = np.floor(np.log(np.maximum(x, 1))[:, None] / r + beta)
            value = np.where(x[:, None] > 0, logc - r * (level - beta + 1), np.inf)
            best = value.argmin(0)
            return best, level[best, np.arange(512)]

        (wa, la), (wb, lb) = keep(a), keep(b)
        want.append(np.mean((wa == wb) & (la == lb)))
    assert abs(np.mean(got) - np.mean(want)) < 0.02 and abs(np.mean(want) - np.mean(true)) < 0.01 and abs(np.mean(got) - np.mean(true)) < 0.02


def test_fingerprints_are_recomputed(docs, corpus):
    """fingerprint and likenesses of compare_neighbours(), from single texts."""
    one = lambda x: fingerprints.Sampler().signatures(fingerprints.bags([x.encode()]))[0]
    got = {r.doc_id: r for r in fingerprints.compare_neighbours(docs.where("doc_id >= 100 or doc_id = 11")).collect()}
    rows = sorted((r[0], r[1] or "") for r in corpus if r[0] is not None and (r[0] >= 100 or r[0] == 11))
    for (i, x), (_, y) in zip(rows, rows[1:] + rows[:1], strict=True):
        e = fingerprints.edited(x, y)
        assert got[i].fingerprint == one(x).astype(">u2").tobytes().hex() and got[i].edited_fingerprint == one(e).astype(">u2").tobytes().hex()
        assert got[i].near_edited == fingerprints.likeness(one(x), one(e)) and got[i].near_next == fingerprints.likeness(one(x), one(y))


def test_ftrl_against_a_plain_loop():
    """The same steps, a coordinate at a time."""
    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.integers(0, 40, 6)).astype(np.int32), int(y)) for y in rng.integers(0, 2, 60)]
    ones = sum(y for _, y in rows)
    weight = {1: max((60 - ones) / ones, 1) ** toxicity.BALANCE, 0: max(ones / (60 - ones), 1) ** toxicity.BALANCE}
    z, n, last = Counter(), Counter(), toxicity.DIM

    def w(i):
        return 0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - np.sign(z[i]) * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(20):
        for f, y in rows:
            on = [*f.tolist(), last]
            g = weight[y] * (1 / (1 + np.exp(-sum(w(i) for i in on))) - y)
            for i, old in [(i, w(i)) for i in on]:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * old
                n[i] += g * g
    at, got = toxicity.ftrl(rows, epochs=20)
    assert dict(zip(at.tolist(), got.tolist(), strict=True)) == pytest.approx({i: w(i) for i in [*range(40), last] if w(i)})


def test_orc_layout(spark, tmp_path):
    """Files with run-length integers, row indexes and Bloom filters; a lookup of an id reads few rows."""
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('some words and number ', id) as text")
    path = f"file://{tmp_path}/t"
    orc_tokens.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), path)
    jvm = spark._jvm
    conf, found = jvm.org.apache.hadoop.conf.Configuration(), []
    for f in sorted(tmp_path.glob("t/*.orc")):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000
        rows = reader.rows()
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            found += [footer.getStreams(i).getKind().toString() for i in range(footer.getStreamsCount())]
            found += [footer.getColumns(i).getKind().toString() for i in range(footer.getColumnsCount())]
        rows.close()
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8", "DIRECT_V2"} <= set(found)
    out = orc_tokens.lookup(spark, path, [17])
    assert out.count() == 1 and "doc_id" in out._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1][:80]


def test_orc(spark, docs, corpus, nothing, tmp_path):
    path, tokenizer = f"file://{tmp_path}/t", public_tokenizers.path("word_bpe_49k.json")
    orc_tokens.write_tokens(docs, tokenizer, path)
    tokens = orc_tokens.read_tokens(spark, path)
    plain, start, want = Tokenizer.from_file(tokenizer), 0, []
    for i, t in sorted(((r[0], r[1] or "") for r in corpus), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert Counter(map(tuple, orc_tokens.digests(tokens).collect())) == Counter(want)
    assert orc_tokens.lookup(spark, path, [11]).count() == 1
    orc_tokens.write_tokens(nothing, tokenizer, f"file://{tmp_path}/e")
    assert orc_tokens.digests(orc_tokens.read_tokens(spark, f"file://{tmp_path}/e")).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|>x", "don't I'M", "a.b, c..", "é́.", "ΑΣ.", "İx", "ﬁn", "ʰa", "1st", "漢字。", "...", "x\x85y z"])
def test_word_encoder(text):
    definition = open(public_tokenizers.path("word_bpe_49k.json")).read()
    got = np.frombuffer(orc_tokens.WordEncoder(definition).encode([text])[0], "<u4").tolist()
    assert got == Tokenizer.from_str(definition).encode(text, add_special_tokens=False).ids


def test_long_texts_are_encoded_in_parts(monkeypatch):
    monkeypatch.setattr(sentencepiece_bridge, "LONG", 20)
    data = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    text = "  some   words and\u2581markers  é\n " * 30 + "x" * 100
    encoder, whole = sentencepiece_bridge.Encoder(data), sentencepiece_bridge.Model(data).tokenizer()
    ids = encoder.encode(["", text, "a"])
    assert len(encoder._parts(text)) > 20 and [np.frombuffer(x, "<u4").tolist() for x in ids] == [whole.encode(x).ids for x in ("", text, "a")]
    assert encoder.decode(ids[1]) == whole.decode(whole.encode(text).ids, skip_special_tokens=False)


def test_encoder_of_another_tokenizer():
    """Pieces that may hold white space: the whole tokenizer works."""
    from tokenizers import models, pre_tokenizers

    other = Tokenizer(models.BPE({"a": 0, " ": 1, "a ": 2, "b": 3}, [("a", " ")]))
    other.pre_tokenizer = pre_tokenizers.Split("b", "isolated")
    got = np.frombuffer(orc_tokens.WordEncoder(other.to_str()).encode(["a a ba"])[0], "<u4").tolist()
    assert got == other.encode("a a ba").ids == [2, 2, 3, 0]


def test_recent():
    made = []
    kept = common.Recent(lambda x: made.append(x) or x, 3)
    for x in [0, 1, 0, 2, 0, 3, 0, 4, 5, 0, 6, 7]:
        assert kept[x] == x and len(kept) <= 3 and len(kept.old) <= 3
    assert made.count(0) == 1


def test_sentencepiece(docs, corpus, nothing):
    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    out = sentencepiece_bridge.encode(docs, path)
    assert out.columns[-2:] == ["ids_", "decoded"]
    got = Counter((r.doc_id, tuple(r["ids_"]), r.decoded) for r in out.collect())
    assert got == Counter((r[0], tuple(own.encode(r[1] or "")), own.decode(own.encode(r[1] or ""))) for r in corpus)
    assert all(x[2] == (r[1] or "") for x, r in zip(sorted(got, key=str), sorted(corpus, key=str), strict=False) if x[0] == r[0] and r[0] in (1, 3, 11))
    assert sentencepiece_bridge.digests(nothing, path).count() == 0
    assert sentencepiece_bridge.disagreements(docs, path).count() == 0


def test_sentencepiece_query_against_the_library(spark):
    """The registered query over a whole table; another library decides."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for r in docs.collect():
        ids = own.encode(r.text or "")
        want.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(own.decode(ids).encode()).hexdigest(), own.decode(ids) == (r.text or "")))
    assert Counter(map(tuple, queries.op9_sentencepiece(spark, "/root/testdata/sf0.001").collect())) == Counter(want)


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "a ", "<s>x</s>", "<0x0A>\n", "▁a", "🙂 é", " " * 40 + "x"])
def test_rebuilt_tokenizer(text):
    data = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    own = sentencepiece.SentencePieceProcessor(model_proto=data)
    whole = sentencepiece_bridge.Model(data).tokenizer()
    assert whole.encode(text).ids == own.encode(text)
    assert whole.decode(own.encode(text), skip_special_tokens=False) == own.decode(own.encode(text))


def _message(*fields):
    """A protobuf message of (number, value)."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for k, v in fields:
        if isinstance(v, int):
            out += number(k << 3) + number(v)
        elif isinstance(v, float):
            out += number(k << 3 | 5) + np.float32(v).tobytes()
        else:
            out += number(k << 3 | 2) + number(len(v)) + v
    return out


def test_unigram_model():
    pieces = [("<unk>", 0.0, 2), ("▁ab", -1.0, 1), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("c", -4.0, 1), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256))]
    data = _message(*((1, _message((1, p.encode()), (2, s), (3, k))) for p, s, k in pieces), (2, _message((3, 1), (35, 1))), (3, _message((1, b"identity"), (3, 1), (4, 0))))
    own = sentencepiece.SentencePieceProcessor(model_proto=data)
    encoder = sentencepiece_bridge.Encoder(data)
    for text in ("ab c", "cab ab", "é", "abc  b"):
        ids = encoder.encode([text])[0]
        assert np.frombuffer(ids, "<u4").tolist() == own.encode(text)
        assert encoder.decode(ids) == own.decode(own.encode(text))
