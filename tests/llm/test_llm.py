"""The training-data operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import public_tokenizers

from sluice.llm import digest, langid, neardup, packing, pages, pieces, queries, quality_model, rules, subword

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
LINE = "This very line is repeated in many documents of the corpus."


def corpus():
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))
    base = text(60)
    near = base.split()
    near[5] = "changed"
    texts = [base, base, " ".join(near), None, "", "one", "one", "two words", LINE + "\n" + text(30), " " + LINE.upper() + "\t\n" + text(30), text(4000), "!!! ???", "Ünïcode Straße ﬁn 😀 \x00 end", text(25) + "\n" + LINE, LINE, "x\n" + LINE + "\n" + LINE, "\n\n", "dup words here now and then again once " * 30]
    n = len(texts)
    return pd.DataFrame({"doc_id": range(n), "text": texts, "lang": [["en", "de", None][i % 3] for i in range(n)], "source": [["a", None][i % 2] for i in range(n)], "n_chars": [len(t or "") for t in texts], "key": 1, "id": 2, "n": "x", "score": None})


@pytest.fixture(scope="module")
def sf(tmp_path_factory, spark):
    d = tmp_path_factory.mktemp("sf")
    docs = corpus().astype({"score": "float64"})
    docs.to_parquet(d / "documents.parquet")
    docs.head(0).to_parquet(d / "none.parquet")
    pd.DataFrame({"doc_id": range(0, len(docs), 2), "quality": [i % 2 for i in range(0, len(docs), 2)], "toxic": 0}).to_parquet(d / "labels.parquet")
    talk = [(1, 0, "user", "Hello there\nHow are You?"), (1, 1, "assistant", "> How are you?\nI am fine.\n\nBye"), (1, 2, "user", "On Monday X wrote:\n> I am fine.\n>> How are you?\nok good"), (1, 3, "user", "> nothing like this\nx"), (1, 4, "user", "> ok  GOOD\n> Bye\nnew"), (2, 0, "user", ">>> odd"), (2, 1, "a", ""), (3, 0, "user", None)]
    pd.DataFrame(talk, columns=["conv_id", "turn", "role", "text"]).to_parquet(d / "conversations.parquet")
    html = "<body><nav>menu</nav><article class='post-1'><h1>T&amp;C</h1><p>First   para.<p>Second<br>one</p><aside>no</aside></article><footer>f</footer>"
    pd.DataFrame({"page_id": [1, 2, 3, 4], "url": ["http://a.x/1", "http://a.x/2", None, "bad"], "html": [html, html.replace("post-1", "post-2"), None, ""]}).to_parquet(d / "pages.parquet")
    return str(d)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql_gives_the_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.sql(queries.ORACLES[name]).df()
    plain = lambda df: sorted(tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert plain(got) and sorted(map(str, plain(got))) == sorted(map(str, plain(want)))


@pytest.mark.parametrize("everywhere", [False, True])
def test_rules_reject_junk_that_fills_its_group(spark, everywhere):
    rng, rows = random.Random(6), []
    text = lambda words, n=40: " ".join(rng.choice(words) + str(rng.randint(0, 999)) for _ in range(n))
    junk = lambda: " ".join(rng.choice(WORDS) + rng.choice(["#$", "<>", "&*"]) + str(rng.randint(0, 9)) for _ in range(40))  # as long as the other words
    shares = {"a": 40, "b": 40} if everywhere else {"a": 40, "b": 80, "c": 0, "d": 0, "e": 0, "f": 0}
    for source, share in shares.items():
        rows += [(junk() if i < share else text(WORDS), "en", source, i < share) for i in range(100)]
        rows += [("short #$% <>|", "en", source, True)] * 60
    rows += [(text(["語" * 30, "文" * 31]), "zh", "a", False) for _ in range(0 if everywhere else 120)]  # long words are usual in this language
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, bad boolean")
    got = rules.judge(df).toPandas()
    assert len(got) == len(rows) and got[got.kept == got.bad][["doc_id", "lang", "source", "bad"]].values.tolist() == []


def test_near_duplicates_against_all_pairs(spark, sf):
    got = queries.op3_neardup(spark, sf).toPandas().set_index("doc_id")
    docs = corpus()
    sets = {}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert got.component_id.to_dict() == root and got.n_shingles.to_dict() == {i: len(s) for i, s in sets.items()}
    assert (got.kept == (got.index == got.component_id)).all()


def test_packing_holds_every_id_once(spark, sf):
    from tokenizers import Tokenizer

    got = queries.op5_packing(spark, sf).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = corpus()
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids, at = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for p in got[got.doc_id == i].sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 1024


def test_packing_maps_added_tokens(spark):
    from tokenizers import Tokenizer

    path, end = public_tokenizers.path("byte_bpe_50k.json"), "<|endoftext|>"
    tokenizer, encode, rng = Tokenizer.from_file(path), packing.byte_level_encoder(path), random.Random(4)
    odd = [f"a {end} b", end, end * 3, f" \n {end} \n {end}", f"<|end{end}oftext|>", "<|ENDOFTEXT|>", *["".join(rng.choice([end, " ", "\n", "<|", "ab", "'s", "é", "12", "  "]) for _ in range(rng.randint(0, 30))) for _ in range(300)]]
    assert all(encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids for t in odd)
    texts = [f"a {end} b", f"{end} x y " * 700]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer=path).toPandas()
    for i, t in enumerate(texts):
        ids, at = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4"), 0
        for p in got[got.doc_id == i].sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


@pytest.mark.parametrize("histogram", [{700: 3000, 5: 2}, {i: 20 for i in range(1, 1024)}, {1: 1}, {1023: 5}, {}])
def test_plan_places_every_piece_and_pads_little(histogram):
    rows, spans = packing.plan(histogram, 7), {}
    for n, lo, hi, at, off, binary in rows:
        for k in range(hi - lo):
            if binary:
                spans.setdefault((at + k * off) // 1024, []).append(((at + k * off) % 1024, off))
            else:
                spans.setdefault(at + k, []).append((off, n))
    assert sum(n for s in spans.values() for _, n in s) == sum(n * k for n, k in histogram.items())
    for s in spans.values():
        end = 0
        for at, n in sorted(s):
            assert at == end
            end += n
        assert end <= 1024
    assert len(spans) * 1024 <= 1.01 * sum(n * k for n, k in histogram.items()) + 1024


def test_pieces_equal_the_library(spark, sf):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    model, rng = pieces.load(public_tokenizers.path("piece_bpe_32k.model")), random.Random(1)
    odd = ["", " ", "▁", "a▁b ▁▁", "</s><0x0A>", "\x00", "A" * 3000, " \n \n", *["".join(rng.choice(" ▁\nabcthe én😀語\t") for _ in range(rng.randint(0, 50))) for _ in range(300)]]
    for t in odd:
        ids, begins, ends = model.encode(t, True)
        assert ids.tolist() == library.encode(t, add_eos=True) and model.decode(ids.tolist()) == library.decode(ids.tolist())
        assert begins[0] == 0 and ends[-1] == len(t.encode()) and (begins[1:] == ends[:-1]).all()
    got = queries.op6_pieces(spark, sf).toPandas().set_index("doc_id")
    for i, t in zip(corpus().doc_id, corpus().text, strict=True):
        ids = library.encode(t or "", add_eos=True)
        assert got.ids_sha256[i] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and got.decoded_sha256[i] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_normaliser_equals_the_library():
    import sentencepiece

    spec = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    charsmap = [dict(pieces._fields(v)) for k, v in pieces._fields(spec) if k == 3][0][2]
    for squeeze in (True, False):
        library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=squeeze)
        for t in ["ﬁ Å ½ ㌀ é ｱﾞ x​  ", "  ①②    z  ", "", "plain", "　あ\t語"]:
            assert pieces.Normalizer(charsmap, False, squeeze, False)(t)[0] == library.normalize(t)


def test_digests_of_edited_texts(spark, sf):
    got = queries.op2_digests(spark, sf).toPandas().sort_values("doc_id", ascending=False)
    docs = corpus().sort_values("doc_id", ascending=False)
    texts = docs.text.fillna("").tolist()
    for k, (t, r) in enumerate(zip(texts, got.itertuples(), strict=True)):
        n = len(t) // 3
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - n] + texts[(k + 1) % len(texts)][:n]).encode()).hexdigest()
    assert got.fingerprint.groupby(texts).nunique().max() == 1 and got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()


def test_digests_do_not_depend_on_batches(monkeypatch):
    rng = random.Random(0)
    texts = [bytes(rng.choice(b"abcdefgh \n") for _ in range(n)) for n in (0, 1, 31, 32, 100, 5000, 30000)]
    rank = digest.ranks(digest.class_counts(texts))
    whole = [str(d) for d in digest.digests(texts, rank)]
    assert whole == [str(digest.digests([t], rank)[0]) for t in texts]
    assert [str(digest.Digest.parse(w)) for w in whole] == whole
    monkeypatch.setattr(digest, "_PART", 1000)
    assert whole == [str(d) for d in digest.digests(texts, rank)]
    assert digest.likeness(digest.Digest.parse(whole[-1]), digest.Digest.parse(whole[-1])) == pytest.approx(1)


def test_main_text(spark, sf):
    got = queries.op8_pages(spark, sf).toPandas().set_index("page_id").text
    assert got[1] == got[2] == "T&C\n\nFirst para.\n\nSecond one" and got[3] == got[4] == ""
    assert pages.extract("plain text", []) == "plain text" and pages.extract("<p>a<script>x</script><p>b<!-- c", []) == "a\n\nb"


@pytest.mark.parametrize("wrap", ["layout has-sidebar", "content no-sidebar", "page with-nav", "content-sidebar", "banner-page", "site comments-open"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_main_text_inside_marked_wrappers(spark, wrap, tag):
    first, second, aside = "The first paragraph of the article is here.", "And this is the second one, a bit longer.", "Something else to read on this site."
    page = f"<body><div class='{wrap}'><{tag}><header class='entry-header'><h1>Head line</h1></header><p>{first}</p><p>{second}</p></{tag}>"
    page += f"<div class='left-sidebar'><p>{aside}</p></div><div class='main-nav'>{aside}</div><div id='comments'><p>{aside}</p></div></div><div class='ad'>{aside}</div><footer>f</footer></body>"
    want = "\n\n".join([*(["Head line"] if tag != "div" else []), first, second])  # outside an article a header is the site's
    assert pages.extract(page, []) == want
    df = spark.createDataFrame([(1, "http://a.x/1", page), (2, "http://a.x/2", page)], "page_id long, url string, html string")
    assert {r.text for r in pages.main_text(df, keep=["page_id"]).collect()} == {want}


def test_main_text_without_long_comments_and_teasers():
    page = "<main><h1>T</h1><p>The text of the article is short but it is the text.</p></main>"
    page += "<div class='post-comments'>" + "<article class='comment-body'><p>A reader says something long about it here.</p></article>" * 9 + "</div>"
    page += "<div class='related'>" + "<article><p>Another text that is offered to the reader.</p></article>" * 9 + "</div>"
    assert pages.extract(page, []) == "T\n\nThe text of the article is short but it is the text."


def test_models_learn_and_hold_out():
    rng = random.Random(5)
    make = lambda words: " ".join(rng.choice(words) for _ in range(30)).encode()
    texts = [make(WORDS) for _ in range(100)] + [make(["der", "die", "und", "nicht", "schön", "straße"]) for _ in range(100)]
    labels = ["en"] * 100 + ["de"] * 100
    model = subword.train(langid.FEATURES, texts, labels)
    assert model.report["accuracy"] > 0.95 and model.classes == ["de", "en"] and 0 <= model.threshold <= 1
    assert [model.classes[i] for i in model.probabilities([make(WORDS), "die straße".encode(), b""]).argmax(axis=1)][:2] == ["en", "de"]


def test_predictions_of_odd_texts(spark, sf):
    lang = queries.op1_language(spark, sf).toPandas().set_index("doc_id")
    assert lang.lang_pred[[3, 4, 11, 16]].tolist() == ["und"] * 4 and set(lang.lang_pred[[0, 12]]) <= {"en", "de"}
    assert (lang.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in lang.index]).all()
    quality = queries.op4_quality(spark, sf).toPandas()
    assert len(quality) == len(corpus()) and quality.score.between(0, 1).all() and (quality.predicted == (quality.score >= 0.5)).all()


def test_empty_tables(spark, sf):
    none = spark.read.parquet(f"{sf}/none.parquet")
    assert langid.predict(none, langid.fit(none), keep=["doc_id"]).count() == 0
    assert neardup.near_duplicates(none).count() == 0
    assert packing.pack(none, tokenizer=public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert digest.neighbour_digests(none).count() == 0
    assert quality_model.score(none, None, keep=["doc_id"]).count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "line_dedup", "near_dedup", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, len(corpus())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas(), docs.schema)
        assert docs.columns == columns and docs.count() <= before
        before = docs.count()
