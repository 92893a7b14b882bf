"""Operators that take one text at a time: fingerprints, languages, pages, toxicity, tokens."""

from __future__ import annotations

import hashlib
import itertools
import random
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rillframe.llm import fingerprints, html_extraction, language_id, sentencepiece_bpe, toxicity
from rillframe.llm.queries import fold, queries, tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


def by_id(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: (r[key] is not None, r[key] or 0, str(r)))


def test_edited_texts(odd):
    rows = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    texts = [t or "" for _, t in rows]
    want = []
    for (i, _), a, b in zip(rows, texts, texts[1:] + texts[:1]):
        new = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        want.append((i, len(a), hashlib.sha256(new.encode()).hexdigest()))
    got = fingerprints.edited(odd).collect()
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got], key=order) == sorted(want, key=order)
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))


def test_fingerprints_are_local(odd, empty, clashing):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    a, b, pre = (" ".join(word() for _ in range(n)) for n in (500, 500, 37))
    s = fingerprints.sketches([fingerprints._points(t) for t in (a, pre + a, b, a[: len(a) // 2] + b[: len(b) // 2], "", a)])
    assert (s[0] == s[5]).all() and fingerprints.likeness(s[0], s[1]) > 0.75
    assert fingerprints.likeness(s[0], s[2]) < 0.05 and 0.3 < fingerprints.likeness(s[0], s[3]) < 0.7
    assert fingerprints.likeness(s[4], s[4]) == 1 and fingerprints.likeness(s[4], s[0]) == 0
    assert fingerprints.edited(empty).count() == 0 and fingerprints.fingerprint(empty).count() == 0
    got = fingerprints.fingerprint(clashing)
    assert got.count() == odd.count() and got.columns.count("fingerprint") == 1


def test_labels_differ_between_neighbours():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    label = fingerprints._labels(x, np.array([0]))
    assert label.max() < 6 and (label[1:] != label[:-1]).all()


def test_languages(odd, empty, clashing):
    model = language_id.fit(odd, F.lit(True), per_language=50)
    got = {r["doc_id"]: r for r in language_id.predict(odd, model).collect()}
    assert sum(got[i]["lang_pred"] in ("en", "de") for i in range(30)) == 30
    for i in (103, 104, 105, 112):
        assert (got[i]["lang_pred"], got[i]["lang_score"], got[i]["lang_rejected"]) == ("und", 0.0, True)
    assert not any(got[i]["lang_rejected"] for i in range(30))
    assert language_id.predict(clashing, model).columns.count("lang_pred") == 1
    none = language_id.fit(empty, F.lit(True))
    assert none.languages == [] and {r["lang_pred"] for r in language_id.predict(odd, none).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def test_language_held_out(spark, small):
    got = queries()["op2_language_id"](spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_rejects_other_scripts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.fit(docs, fold(3) != 1)
    far = spark.createDataFrame([(1, "Ωραία πόλη και θάλασσα με ήλιο"), (2, "これは日本語の文章です")], "doc_id long, text string")
    assert all(r["lang_rejected"] for r in language_id.predict(far, model).collect())


def test_rejects_long_texts_of_no_language(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.fit(docs, fold(3) != 1)
    rng = random.Random(8)
    scripts = {"greek": (0x3B1, 0x3C9), "cyrillic": (0x430, 0x44F), "hangul": (0xAC00, 0xD7A3), "latin": (0x61, 0x7A)}
    word = lambda lo, hi: "".join(chr(rng.randint(lo, hi)) for _ in range(rng.randint(2, 9)))
    texts = [(f"{k} {n}", " ".join(word(*at) for _ in range(n))) for k, at in scripts.items() for n in (20, 100, 2000)]
    got = language_id.predict(spark.createDataFrame(texts, "name string, text string"), model).collect()
    assert not [(r["name"], r["lang_score"]) for r in got if not r["lang_rejected"]]
    held = docs.where((fold(3) == 1) & (F.length("text") > 100))
    short = held.withColumn("text", F.substring("text", 1, 60))
    for part in (held, short):
        assert language_id.predict(part, model).agg(F.avg(F.col("lang_rejected").cast("int"))).first()[0] < 0.05


def test_toxicity_learns_subwords():
    rng = random.Random(2)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    stems = ["zorkpil", "quvexan"]
    texts, labels = [], []
    for i in range(300):
        words = rng.sample(clean, 40)
        if bad := i % 5 == 0:
            words.insert(rng.randrange(40), rng.choice(stems) + rng.choice(["s", "ed", ""]))
        texts.append(" ".join(words).encode())
        labels.append(int(bad))
    model = toxicity.train(texts, np.array(labels))
    new = [" ".join(rng.sample(clean, 40)) for _ in range(20)]
    ask = [t.encode() for t in new] + [(t + " zorkpilling").encode() for t in new] + [b"", b" . "]
    at = np.concatenate([[0], np.cumsum([len(a) for a in ask])])
    p = model.scores(np.frombuffer(b"".join(ask), np.uint8), at)
    assert (p[:20] < 0.3).mean() > 0.9 and (p[20:40] >= 0.3).all() and (p[40:] < 0.3).all()


def test_toxicity_edges(spark, odd, empty, clashing):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert {r["toxicity"] for r in toxicity.score(odd, toxicity.fit(odd, none, fold(4) != 2)).collect()} == {0.0}
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(30)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels, F.lit(True))
    got = toxicity.score(clashing, model)
    assert got.count() == odd.count() and got.columns.count("toxicity") == 1 and all(0 <= r["toxicity"] <= 1 for r in got.collect())
    assert toxicity.score(empty, model).count() == 0


PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1><a href=/>home</a></header>
<div id="cookie-notice">We use cookies to improve things. Accept all of them now please.</div><nav><a>a</a></nav>
<div class="post-content"><h2>Great title here</h2><p>This is a long paragraph of the story with many words &amp; more in it,
and it goes on. It has sentences.</p><p>Short.</p><div class="ad-slot">Buy now the great thing that everybody needs for nine dollars. Do it.</div>
<script>var x = "<p>no</p>";</script><p>Another paragraph that is quite long so that it counts as content, yes indeed.<br>Really.</p><form><label>Email</label></form></div>
<aside>Related: <a>one</a></aside><section id="comments"><p>I am a reader and this is my long comment about the article.</p></section><footer>&copy; me</footer>"""


def test_pages(spark):
    want = "Great title here\nThis is a long paragraph of the story with many words & more in it, and it goes on. It has sentences.\nShort.\nAnother paragraph that is quite long so that it counts as content, yes indeed. Really."
    df = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "a < b"), (5, "u", "<p" * 2000), (5, "u", "<p" * 2000), (None, None, "<article><p>" + "word " * 20000)], "page_id long, url string, html string")
    got = {r["page_id"]: r["main_text"] for r in html_extraction.extract(df.withColumn("main_text", F.lit("x"))).collect()}
    assert got[1] == want and got[2] == got[3] == "" and len(got[None].split()) == 20000
    assert html_extraction.extract(df.where("false")).count() == 0


def test_cut_is_least():
    rng = random.Random(0)

    def cost(odds, links, side):
        return sum(abs(o) for o, s in zip(odds, side) if (o > 0) != bool(s)) + sum(c for i, j, c in links if side[i] != side[j])

    for _ in range(200):
        n = rng.randint(1, 8)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        links = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        best = min(cost(odds, links, s) for s in itertools.product([0, 1], repeat=n))
        assert cost(odds, links, html_extraction.cut(odds, links)) == pytest.approx(best)


def test_tokens_are_the_library_s(spark, odd, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rng = random.Random(4)
    odd_texts = ["".join(rng.choice(" ▁abtheinorERS①é\n😀ü.,|%0123  ") for _ in range(rng.randint(1, 25))) for _ in range(2000)] + [" " * 40, "a" + " " * 37 + "b", "a\x00b", "<s></s><0x41>", "▁▁x▁"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts)], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    texts = df.collect()
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in sentencepiece_bpe.encode(df, MODEL, ids=True).collect()}
    want = set()
    for r in texts:
        ids = lib.encode(r["text"] or "", add_eos=True)
        want.add((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids))))
    assert got == want
    assert sentencepiece_bpe.encode(empty, MODEL).count() == 0


def test_decoding_bad_bytes():
    sentencepiece = pytest.importorskip("sentencepiece")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentencepiece_bpe.load(MODEL)
    rng = random.Random(6)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), 2, 1]) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == lib.decode(ids), ids


def test_the_cut_overrules_some_blocks(small):
    overruled = blocks = 0
    for row in pq.read_table(f"{Path(small).parent}/sf0.1/pages.parquet", columns=["html"]).to_pylist():
        found = html_extraction.blocks(row["html"] or "")
        odds = [html_extraction.log_odds(b) for b in found]
        overruled += sum((z > 0) != s for z, s in zip(odds, html_extraction.cut(odds, html_extraction.edges(found))))
        blocks += len(found)
    print(f"{overruled} of {blocks} blocks overruled")
    assert overruled > 0


def test_broken_markup_hides_nothing():
    tail = "<p>Some long text of words here. It goes on.</p></article>"
    plain = "Some long text of words here. It goes on."
    for head in ("<svg a='1'/>", '<object data="a>b"/>', "<iframe src=x />", "<template/>", "<title>", "<textarea>", "<svg>", "<!-- x -->", "<script>var a='<p>';</script>", "<style>p{}</style>"):
        assert html_extraction.main_text(f"<article>{head}{tail}") == plain, head
    assert html_extraction.main_text(f"<article><p>First words of an article. Yes.</p><script>no end {tail}") == "First words of an article. Yes."
    long = "这是一个很长的段落没有空格。它继续讲下去。" * 200
    assert html_extraction.main_text(f"<div><nav><a href=x>一</a></nav><div>{long}</div></div>") == long


def test_training_holds_little_beside_its_ngrams(monkeypatch):
    """What the driver's Python holds, and the same model however few words are widened at a time."""
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(300)).encode() for _ in range(200)]
    labels = np.array([i % 2 for i in range(200)])
    tracemalloc.start()
    model = toxicity.train(texts, labels, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    ngrams = sum(12 - n for n in toxicity.SIZES) * 200 * 300
    assert peak < 40 * ngrams, peak / ngrams
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 777)
    few = toxicity.train(texts, labels, rounds=2)
    assert np.array_equal(few.weight, model.weight) and few.bias == model.bias


def moved(spark):
    """Bytes that stages of this session have shuffled so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_training_moves_no_other_texts(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(f"{rng.getrandbits(64):x}" for _ in range(300))) for i in range(1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 50 == 0)) for i in range(1000)], "doc_id long, toxic int")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = moved(spark)
        toxicity.fit(docs, labels, F.lit(True), per_class=20)
        assert moved(spark) - before < 1_500_000  # the texts have 5 MB
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_pairs_are_tested_at_their_border_only():
    """The pairs and pieces that plain merging gives, without merging the two strings again."""
    model = sentencepiece_bpe.load(MODEL)
    calls = []
    score, rng = model.score, random.Random(3)

    def merged(text):
        parts = list(text)
        while True:
            found = [(-score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    class Seen(dict):
        def get(self, key, other=None):
            calls.append(key)
            return super().get(key, other)

    pieces = [p for p in rng.sample(sorted(model.id), 3000) if merged(p) == [p]]
    pairs = [(rng.choice([*pieces, "é", "😀"]), rng.choice(pieces)) for _ in range(3000)]
    model.score = Seen(score)
    assert [model.compatible(*p) for p in pairs] == [merged(a + b) == [a, b] for a, b in pairs]
    assert len(calls) < 24 * len(pairs), len(calls) / len(pairs)
