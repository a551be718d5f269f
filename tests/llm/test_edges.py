"""Repeated rows, clashing columns, empty tables, long and broken texts, ties and hot keys of the training-data operators, and brute-force versions of their results."""

import collections
import hashlib
import json
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sluice.llm import components, digest, langid, linededup, neardup, packing, pages, pieces, quality_model, queries, quotes, rules, spread
from sluice.llm.scratch import Scratch

SF = "/root/testdata/sf0.01"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def say(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_by_hand(rows):
    """Component of each doc_id among (doc_id, text) rows by all pairs that share a shingle."""
    sets = [(i, shingles(t)) for i, t in rows]
    holders, root = collections.defaultdict(list), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(k)
    for a, b in {(a, b) for ks in holders.values() for a in ks for b in ks if a < b}:
        (i, x), (j, y) = sets[a], sets[b]
        if 100 * len(x & y) >= 75 * len(x | y):
            p, q = find(i), find(j)
            root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}


def test_near_duplicates_of_the_given_documents(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    want = near_by_hand(list(zip(docs.doc_id, docs.text, strict=True)))
    got = queries.op3_neardup(spark, SF).toPandas().set_index("doc_id")
    assert got.component_id.to_dict() == want and sum(i != r for i, r in want.items()) > 50


def near_family(rng, n):
    """Near copies of one text, each with one word of its own."""
    base = say(rng, 80).split()
    out = []
    for k in range(n):
        words = list(base)
        words[rng.randrange(80)] = f"own{k}"
        out.append(" ".join(words))
    return out


def test_near_duplicates_with_hot_keys(spark, monkeypatch):
    """Groups larger than what counts as hot, texts that share most of a template without being near, and exact copies."""
    monkeypatch.setattr(spread, "HOT", 3)
    monkeypatch.setattr(spread, "SALTS", 4)
    monkeypatch.setattr(neardup, "HOT", 3)
    rng = random.Random(8)
    template = say(rng, 60)
    texts = near_family(rng, 25) + [f"{template} {say(rng, 25)}" for _ in range(25)] + [say(rng, 30)] * 20 + [say(rng, 40) for _ in range(10)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    assert got.component_id.to_dict() == near_by_hand(rows)


def test_components_in_few_jobs(spark, monkeypatch):
    """Few edges take one task instead of steps of shuffles; both ways give each node's smallest reachable one."""
    rng = random.Random(10)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(7, 7), (3, 9), (9, 3), (9, 3)] + [(5000, 5000 + k) for k in range(1, 40)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    store = Scratch(spark, "test")
    df = store.table(spark.createDataFrame(edges, "a long, b long"), "edges")
    written = len(store.paths)
    at_once = components.components(df, store).toPandas()
    assert len(store.paths) == written  # no step was written
    monkeypatch.setattr(components, "AT_ONCE", 0)
    by_steps = components.components(df, store).toPandas()
    for got in (at_once, by_steps):
        assert dict(zip(got.node, got.root, strict=True)) == root and len(got) == len(root)
    assert components.components(df.limit(0), store).count() == 0


@pytest.mark.parametrize("few", [0, 1000])
@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_attached_rows_of_hot_keys(spark, monkeypatch, few, how):
    """Hot keys or none, named in the one join or joined apart: the rows are those of the plain join, and keys that are named take one join."""
    monkeypatch.setattr(spread, "FEW", few, raising=False)
    store = Scratch(spark, "test")
    rows = store.table(spark.range(60).select(F.when(F.col("id") < 50, F.col("id") % 4).alias("k"), F.col("id")), "rows")
    facts = store.table(spark.createDataFrame([(0, 13, "a"), (1, 13, "b"), (2, 1, "c"), (9, 99, "d")], "k long, c long, v string"), "facts")
    want = rows.join(facts.drop("c"), ["k"], how)
    for hot in (10, 100):
        monkeypatch.setattr(spread, "HOT", hot)
        got = spread.attached(rows, facts, ["k"], F.col("id"), how)
        assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
        if few:
            assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_near_duplicates_of_shared_ids(spark):
    """A doc_id with two texts has the links of both; another column named like an inner one does no harm."""
    rng = random.Random(9)
    a, b, c = (near_family(rng, 3) for _ in range(3))
    rows = [(1, a[0]), (2, b[0]), (5, a[1]), (5, b[1]), (5, b[1]), (7, c[0]), (8, c[1]), (8, c[1]), (9, say(rng, 50)), (None, a[2]), (10, None), (11, "")]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, id int, key string")
    got = neardup.near_duplicates(df).toPandas()
    roots = got.dropna(subset="doc_id").groupby("doc_id").component_id.agg(set).to_dict()
    assert roots == {1: {1}, 2: {1}, 5: {1}, 7: {7}, 8: {7}, 9: {9}, 10: {10}, 11: {11}} and len(got) == len(rows)


def test_held_out_accuracy(spark):
    docs, labels = pd.read_parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/labels.parquet")
    lang = queries.op1_language(spark, SF).toPandas().merge(docs[["doc_id", "lang", "text"]], on="doc_id")
    some = lang[lang.held_out & lang.lang.notna() & (lang.lang_pred != "und")]
    assert len(some) > 100 and (some.lang == some.lang_pred).mean() > 0.98
    quality = queries.op4_quality(spark, SF).toPandas().merge(labels, on="doc_id")
    some = quality[quality.held_out]
    assert len(some) > 50 and (some.predicted == some.quality).mean() > 0.95
    assert (lang.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in lang.doc_id]).all()


def test_character_features_keep_letters_whole():
    whole = quality_model.FEATURES.counted(["é".encode() * 2])[0][0]
    assert len(whole) == 1 + 3 + 2  # the word; " é", "éé" and "é "; " éé" and "éé "
    one, other = (set(quality_model.FEATURES.counted([t.encode()])[0][0].tolist()) for t in ("straße", "strasse"))
    assert one != other


@pytest.mark.parametrize("run", [" " * 1_200_000, "\n" * 1_100_000 + "x", "a" + " \n" * 550_000 + " b", "<|endoftext|>" + " " * 60_000 + "'s", " " * 60_000 + "12", "a  " * 60_000, "b" * 200_000])
def test_packing_of_long_runs(run):
    from tokenizers import Tokenizer

    assert packing.byte_level_encoder(BPE)(run).tolist() == Tokenizer.from_file(BPE).encode(run, add_special_tokens=False).ids


def test_packing_ids_of_all_code_points():
    from tokenizers import Tokenizer

    encode, tokenizer = packing.byte_level_encoder(BPE), Tokenizer.from_file(BPE)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 7 == 0)]
    texts = ["".join(f"a{chr(c)} b{chr(c)}{chr(c)}1" for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    assert [encode(t).tolist() for t in texts] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def broken(spark):
    """Rows whose texts aren't UTF-8."""
    return spark.sql("select 1L doc_id, cast(X'61FF62C3' as string) text, 'en' lang, 's' source union all select 2L, 'plain words', 'en', 's'")


def test_broken_bytes(spark):
    df = broken(spark)
    docs = packing.pack(df, tokenizer=BPE).toPandas()
    assert set(docs.doc_id) == {1, 2}
    out = pieces.encode(df, PIECES, keep=["doc_id"], outputs=("ids", "decoded")).toPandas().set_index("doc_id")
    assert out.decoded[1] == b"a\xffb\xc3".decode(errors="replace")
    assert langid.predict(df, None, keep=["doc_id"]).count() == 2 and quality_model.score(df, None, keep=["doc_id"]).count() == 2
    assert digest.neighbour_digests(df).count() == 2 and neardup.near_duplicates(df).count() == 2
    assert pages.main_text(df.selectExpr("doc_id page_id", "'http://a.b/' url", "text html"), keep=["page_id"]).count() == 2


def mapped_model(tmp_path, rule="nmt_nfkc", squeeze=True):
    """The given model with a character map (and, so, real normalisation)."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(open(PIECES, "rb").read())
    spec = proto.NormalizerSpec()
    spec.ParseFromString(dict(pieces._fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3])
    m.normalizer_spec.precompiled_charsmap, m.normalizer_spec.remove_extra_whitespaces = spec.precompiled_charsmap, squeeze
    path = tmp_path / "mapped.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


@pytest.mark.parametrize("squeeze", [True, False])
def test_pieces_with_a_character_map(spark, tmp_path, squeeze):
    """Ids and decoded texts are the library's, and each piece's span holds the bytes that normalise to it."""
    pytest.importorskip("google.protobuf")
    import sentencepiece

    path = mapped_model(tmp_path, squeeze=squeeze)
    library, model, rng = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path), random.Random(2)
    signs = ["ﬁ", "Å", "½", "㌀", "é", "ｱﾞ", "​", "①", "　", " ", "  ", "\t", "the ", "and", "▁", "😀", "ｆｕｌｌ", "\n", "x", "語"]
    texts = ["", " ", "ﬁ ﬁ", *["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(1000)]]
    found = model.encode_all(texts, True)
    normal = pieces.Normalizer(*[getattr(model, "_map", b"")]) if hasattr(model, "_map") else model.normalizer
    for t, ids, a in zip(texts, found.lists(), found.bounds.tolist(), strict=False):
        assert ids == library.encode(t, add_eos=True) and model.decode(ids) == library.decode(ids), t
        begins, ends, raw = found.begins[a : a + len(ids)].tolist(), found.ends[a : a + len(ids)].tolist(), t.encode()
        assert begins[1:] == ends[:-1] or squeeze  # squeezed spaces at the end are in no piece
        assert all(0 <= x <= y <= len(raw) for x, y in zip(begins, ends, strict=True))
        for i, x, y in zip(ids, begins, ends, strict=True):
            if model.kinds[i] == 1 and len(set(raw[x:y])) and not squeeze:
                part = normal(raw[x:y].decode())[0]
                assert model.names[i].replace("▁", "") in part.replace("▁", "") or part.replace("▁", "") in model.names[i], (t, model.names[i], part)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pieces.decode(pieces.encode(df, path, keep=["doc_id"]), path, keep=["doc_id"]).toPandas().set_index("doc_id").decoded
    assert all(out[i] == library.decode(library.encode(t)) for i, t in enumerate(texts))


def test_pieces_of_random_texts():
    import sentencepiece

    library, model, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.load(PIECES), random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéè ÀÈ▁\n\t .,0123😀語\x00"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(1000)] + ["word" * 5000, "▁" * 3000, "é" * 2000]
    for k in range(0, len(texts), 100):
        found = model.encode_all(texts[k : k + 100], True)
        lists = found.lists()
        assert lists == library.encode(texts[k : k + 100], add_eos=True)
        for t, ids, a, b in zip(texts[k : k + 100], lists, found.bounds[:-1], found.bounds[1:], strict=True):
            assert model.decode(ids) == library.decode(ids)
            spans = list(zip(found.begins[a:b].tolist(), found.ends[a:b].tolist(), strict=True))
            at = 0  # brute force: pieces follow each other, a piece's own bytes are the source's with an escaped space for a space
            for i, (x, y) in zip(ids, spans, strict=True):
                assert x == at
                at = y
                if model.kinds[i] == 1 and x < y:
                    assert t.encode()[x:y].decode().replace(" ", "▁") == (model.names[i] if x or t[:1] == "▁" and model.names[i].startswith("▁▁") else model.names[i].removeprefix("▁")) or not x
            assert at == len(t.encode())
    cache = model.cache
    before = len(cache)
    cache.trim()
    assert len(cache) <= before and model.encode_all(texts[:50], True).lists() == library.encode(texts[:50], add_eos=True)


def test_rules_cutoffs_follow_the_group(spark):
    """Two sources with unlike spreads get unlike cutoffs, which the sketch alone sets: a value is fine in one and rejected in the other."""
    rng = random.Random(11)
    word = lambda lo, hi: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(lo, hi)))
    rows = [(" ".join(word(5, 5) for _ in range(60)), "en", "even") for _ in range(150)] + [(" ".join(word(1, 5 + k % 21) for _ in range(60)), "de", "wide") for k in range(150)]
    odd = " ".join("abcdefghi" for _ in range(8)) + " " + " ".join(word(8, 8) for _ in range(60))
    rows += [(odd, "en", "even"), (odd, "de", "wide")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = rules.judge(df).toPandas().set_index("doc_id")
    assert not got.kept[300] and got.kept[301] and got.kept.loc[list(range(300))].all()
    scratch = Scratch(spark, "test")
    measured = rules.with_measures(df).drop("text")
    cuts = rules.cutoffs(scratch.table(rules.sketch(measured, "lang", "source"), "s")).toPandas().set_index("__source")
    assert cuts["__hi_word_length"]["even"] < cuts["__hi_word_length"]["wide"] and cuts["__lo_word_length"]["even"] > cuts["__lo_word_length"]["wide"]


def test_clashing_columns(spark):
    rows = [(1, "some words\n" + "A line that is long enough to be counted at last.", "en", "s", 5, "thread", -1)]
    schema = "doc_id long, text string, lang string, source string, n_words int, thread string, N_LINES int"
    df = spark.createDataFrame(rows, schema)
    assert rules.judge(df).first().n_words == 13 and rules.judge(df).first().thread == "thread"
    out = linededup.without_repeated_lines(df)
    assert out.columns.count("n_lines") == 1 and "N_LINES" not in out.columns and out.first().n_lines == 2 and out.first().n_words == 5
    talk = spark.createDataFrame([(1, 0, "Hello there, how are you?", "t", 9), (1, 1, "> hello there, how\n> are you?\nFine", "t", 9)], "conv_id long, turn long, text string, thread string, REPLY_TO int")
    got = quotes.unquoted(talk).orderBy("turn").collect()
    assert [r.reply_to for r in got] == [None, 0] and [r.thread for r in got] == [0, 0] and got[1].own_text == "Fine"
    page = spark.createDataFrame([(1, "http://a.b/c", "<article><p>Words of the page.</p></article>", "old")], "page_id long, url string, html string, text string")
    assert pages.main_text(page, keep=["page_id", "text"]).first().text == "Words of the page."
    scored = langid.predict(df.withColumnRenamed("thread", "score"), None, keep=["doc_id", "score"])
    assert scored.columns == ["doc_id", "lang_pred", "score", "accepted"]


def test_empty_tables_of_every_operator(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert pieces.encode(docs, PIECES, keep=["doc_id"]).count() == 0
    assert rules.judge(docs).count() == 0 and linededup.without_repeated_lines(docs).count() == 0
    assert quotes.unquoted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string"), keep=["page_id"]).count() == 0


def lines_by_hand(rows, seen=()):
    """(n_lines, n_dropped, kept) of each (doc_id, text) row; ``seen`` are rows that count but aren't returned."""
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for i, t in [*rows, *seen]:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held[key(x)]) < 5 or i == max(held[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows(rng, ids):
    common = [f"{say(rng, 6)} is a line that many documents of this corpus hold" for _ in range(6)]
    return [(i, "\n".join(rng.choice([rng.choice(common), "  " + rng.choice(common).upper() + "\t", say(rng, 8), "short"]) for _ in range(rng.randint(1, 8)))) for i in ids]


@pytest.mark.parametrize("ids", [list(range(60)), [3] * 6 + [None] * 6 + list(range(30)) * 2])
def test_lines_against_brute_force(spark, ids):
    """Also rows that share a doc_id (one document) and rows without one."""
    rows = line_rows(random.Random(12), ids)
    got = linededup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    found = sorted([(None if pd.isna(r.doc_id) else int(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in got.itertuples()], key=str)
    assert found == lines_by_hand(rows) and got.n_dropped.sum() > 0


def test_lines_of_a_kept_store(spark, tmp_path):
    """A second table meets what the first one left in the store; the runs are sorted in their buckets and levelled."""
    rng = random.Random(13)
    rows = line_rows(rng, range(80))
    store = f"file://{tmp_path}/store"
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    linededup.without_repeated_lines(frame(rows[:70]), store=store).count()
    state = json.loads((tmp_path / "store" / "manifest.json").read_text())
    assert sum(map(len, state["levels"])) < 4 and len(state["levels"]) > 1
    got = linededup.without_repeated_lines(frame(rows[70:]), store=store).toPandas()
    found = sorted([(int(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in got.itertuples()], key=str)
    assert found == lines_by_hand(rows[70:], rows[:70]) != lines_by_hand(rows[70:])
    runs = linededup.LineRuns(spark, store)
    assert runs.levels != [[]] and runs.totals().groupBy("h1", "h2").count().where("count > 1").isEmpty()
    fresh = runs._union(runs._live()).where("fresh")
    assert fresh.count() == fresh.select("h1", "h2").distinct().count() == runs.totals().count()
    runs.close()


def thread_rows(seed):
    """Conversations with nested, re-wrapped and partial quotes, short answers, repeated sentences and messages without quotes."""
    rng, rows = random.Random(seed), []
    sentence = lambda: f"{say(rng, rng.randint(3, 9))}{rng.choice('.!?')}"
    wrap = lambda text, width: [" ".join(p) for p in np.array_split(text.split(), max(1, len(text.split()) // width))]
    for conv in range(25):
        said: list[list[str]] = []
        for turn in range(rng.randint(1, 12)):
            own = [sentence() if rng.random() < 0.9 or not said else rng.choice(rng.choice(said)) for _ in range(rng.randint(1, 4))]
            lines = []
            if said and rng.random() < 0.8:
                source = rng.choice(said[-4:])
                if rng.random() < 0.5:
                    lines.append("On Monday someone wrote:")
                if rng.random() < 0.4:
                    lines += ["> " + "On Sunday another wrote:"] * rng.randint(0, 1) + [f"> > {x}" for x in wrap(" ".join(rng.choice(said)), 5)]
                lines += [f">{' ' * rng.randint(0, 2)}{x}" for x in wrap(" ".join(source[rng.randint(0, 1) :]) or "ok", rng.randint(3, 9))] + [">"] * rng.randint(0, 1)
            lines += wrap(" ".join(own), 7) + rng.choice([[], ["", "ok"], ["> ok"]])
            said.append(own)
            rows.append((conv, turn, "user", "\n".join(lines)))
    return rows + [(99, 0, "user", None), (99, 1, "user", ""), (99, 2, "user", "> nothing that was said here."), (99, 300, "user", "A sentence in a far block."), (99, 900, "user", "> a sentence in\n> a far block.\nyes")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quotes_of_generated_threads(spark, tmp_path, seed):
    rows = thread_rows(seed)
    pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).to_parquet(tmp_path / "conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet')")
    got, want = queries.op10_quotes(spark, str(tmp_path)).toPandas(), con.sql(queries.ORACLES["op10_quotes"]).df()
    plain = lambda df: sorted(str(tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert plain(got) == plain(want)
    linked = got[got.n_linked > 0]
    assert len(linked) > 50 and got.depth.max() > 2 and got.reply_to.notna().sum() > 40
    assert got[got.turn == 900].reply_to.tolist() == [300]
    for _, conv in got.groupby("conv_id"):  # a message comes after the one that it answers
        order = conv.set_index("turn").position
        assert sorted(order) == list(range(len(conv)))
        assert all(order[int(r.reply_to)] < r.position for r in conv.itertuples() if not pd.isna(r.reply_to))


def test_quotes_without_ids(spark):
    rows = [(1, 0, "A sentence to be quoted."), (1, None, "> a sentence to be quoted.\nx"), (None, 3, "> a sentence to be quoted."), (1, 2, "> a sentence to be\n> quoted.\nx"), (1, 2, "> a sentence to be quoted.\ny")]
    got = quotes.unquoted(spark.createDataFrame(rows, "conv_id long, turn long, text string")).toPandas()
    assert len(got) == 5 and got[got.turn == 2].reply_to.tolist() == [0, 0] and got[got.conv_id.isna() | got.turn.isna()].reply_to.isna().all()


@pytest.mark.parametrize("source", ["<a " * 300_000, "<div>" * 100_000 + "x", "<svg>" * 200_000, "<!" * 400_000, '<p title="x' * 100_000, "<li>x" * 50_000, "<script>" * 50_000, "</div" * 100_000, "<article><p>some words " * 20_000])
def test_pages_in_linear_time(source):
    import time

    start = time.perf_counter()
    pages.extract(source, [])
    assert time.perf_counter() - start < 10


def test_pages_keep_the_article():
    cases = {
        "<div class='layout with-sidebar'><article><p>The article is here.</p></article></div>": "The article is here.",
        "<article><h1 class='article-header'>Title</h1><p>The article is here.</p></article>": "Title\n\nThe article is here.",
        "<div class='post'><div class='entry-header'><h1>Title</h1></div><p>The article is here, with enough words.</p><p>And here it goes on, as it should.</p></div>": "Title\n\nThe article is here, with enough words.\n\nAnd here it goes on, as it should.",
        "<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>": "So x=1 holds.",
    }
    assert {k: pages.extract(k, []) for k in cases} == cases


def test_votes_and_winners_by_hand(spark):
    """The host's winning path decides on a page whose own best container is another one."""
    body = lambda n: "".join(f"<p>Sentence number {k} of the text that this page is about.</p>" for k in range(n))
    usual = f"<body><div class='story'>{body(4)}</div><div class='more'>{body(1)}</div></body>"
    odd = f"<body><div class='story'>{body(2)}</div><div class='more'>{body(9)}</div></body>"
    rows = [(i, f"http://h.x/{i}", usual) for i in range(9)] + [(9, "http://h.x/9", odd), (10, "http://other.x/", odd), (11, None, usual), (12, "http://h.x/12", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    by_hand = collections.Counter()
    for _, url, html in rows:
        if html:
            elements, _ = pages.parse(html)
            by_hand[(url or "//").split("/")[2] if url else "", pages._signed(elements[pages.best_container(elements)].path)] += 1
    counted = pages.votes(df)
    assert {(r.host, r.path): r.n for r in counted.where("not block").collect()} == dict(by_hand)
    won = {r.host: r.paths for r in pages.winners(counted).collect()}
    for host in ("h.x", "other.x", ""):
        own = {p: n for (h, p), n in by_hand.items() if h == host}
        assert won[host] == sorted([p for p, n in own.items() if n >= pages.SHARE * sum(own.values())], key=lambda p: (-own[p], p))
    text = {r.page_id: r.text for r in pages.main_text(df, keep=["page_id"]).collect()}
    assert text[9].count("\n\n") == 1 and text[10].count("\n\n") == 8 and text[12] == ""


def test_blocks_that_most_pages_share(spark):
    """Boilerplate without any telling class goes by the host's pages; pages that are copies of each other keep their text."""
    rng = random.Random(17)
    text = lambda: [f"{say(rng, 12)} in this paragraph." for _ in range(4)]
    own, same = [text() for _ in range(8)], text()
    page = lambda ps, more="": "<body><div class='x'>" + "".join(f"<p>{p}</p>" for p in ps) + more + "</div></body>"
    rows = [(i, f"http://a.x/{i}", page(ps, "<p>Read our daily letter with all of the news.</p>")) for i, ps in enumerate(own)]
    rows += [(100 + i, f"http://copies.x/{i}", page([*same[:3], f"{same[3]} {i}"])) for i in range(8)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), keep=["page_id"]).collect()}
    assert all(got[i] == "\n\n".join(ps) for i, ps in enumerate(own))
    assert all(got[100 + i] == "\n\n".join([*same[:3], f"{same[3]} {i}"]) for i in range(8))


def digest_by_hand(text, rank):
    """Features of a short text, window by window."""
    import math

    windows = [text[i : i + 32] for i in range(len(text) - 31)]
    step = [round((k * math.log2(k) if k else 0) * 65536) for k in range(33)]
    keys = [(int(rank[(step[32] - sum(step[n] for n in collections.Counter(w).values())) * 1000 // step[32]]), i) for i, w in enumerate(windows)]
    votes = collections.Counter(min(keys[i : i + 64]) for i in range(len(keys)))
    fine = [(i, n) for (r, i), n in sorted(votes.items(), key=lambda x: x[0][1]) if r <= 1000]
    fine = fine or [(i, n) for (_, i), n in sorted(votes.items(), key=lambda x: x[0][1])]
    strong = [i for i, n in fine if n >= 16]
    chosen = strong if len(strong) >= 16 else [i for i, _ in fine]
    return list(dict.fromkeys(windows[i] for i in chosen))


def test_digests_by_hand():
    rng = random.Random(14)
    texts = [" ".join(rng.choice(WORDS) for _ in range(n)).encode() for n in (8, 30, 100, 400)]
    rank = digest.ranks(digest.class_counts(texts))
    for t, found in zip(texts, digest.features(texts, rank), strict=True):
        want = [int(digest._feature_hash(np.frombuffer(w, np.uint8), np.array([0]))[0]) for w in digest_by_hand(t, rank)]
        assert found.tolist() == want
    a, b, c = (" ".join(say(rng, 40) for _ in range(5)).encode() for _ in range(3))
    d = digest.digests([a, a[: len(a) * 2 // 3] + b[: len(a) // 3], c], rank)
    assert digest.likeness(d[0], d[1]) > 0.4 > 0.1 > digest.likeness(d[0], d[2])


def test_digests_with_kept_ranks(spark):
    """With the ranks of an earlier corpus a text has the digest that it had there."""
    rng = random.Random(15)
    first = spark.createDataFrame([(i, say(rng, 60)) for i in range(20)], "doc_id long, text string")
    rank = digest.fit_ranks(first)
    more = first.limit(5).unionByName(spark.createDataFrame([(100 + i, say(rng, 300)) for i in range(20)], "doc_id long, text string"))
    before = {r.doc_id: r.fingerprint for r in digest.neighbour_digests(first, rank=rank).collect()}
    after = {r.doc_id: r.fingerprint for r in digest.neighbour_digests(more, rank=rank).collect()}
    assert all(before[i] == after[i] for i in before if i in after) and sum(i in after for i in before) == 5


def test_pipeline_against_plain_python(spark, tmp_path):
    """Each stage's rows by hand: the rules' and the model's verdicts, the lines, the components, the packed ids of run()."""
    import corpus_pipeline as cp

    from tokenizers import Tokenizer

    for t in ("documents", "labels"):
        pd.read_parquet(f"{SF}/{t}.parquet").head(400).to_parquet(tmp_path / f"{t}.parquet")
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scratch = Scratch(spark, "test")
    stages, held = dict(cp.STAGES), [docs]
    for name, stage in cp.STAGES[:-1]:
        held.append(scratch.table(stage(spark, held[-1], sf), name))
        assert held[-1].schema.names == docs.schema.names
    frames = [d.toPandas().set_index("doc_id") for d in held]
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    judged = con.sql(queries.ORACLES["op7_rules"]).df().set_index("doc_id").kept
    assert set(frames[1].index) == set(judged[judged].index) and (frames[1].text == frames[0].text[frames[1].index]).all()
    model = quality_model.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    p = model.probabilities([(t or "").encode() for t in frames[1].text])[:, model.classes.index(1)]
    assert set(frames[2].index) == set(frames[1].index[p >= 0.5])
    labels = pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id").quality
    good = [i for i in frames[0].index if labels.get(i) == 1 and judged[i]]
    assert np.mean([i in frames[2].index for i in good]) > 0.98 and not any(labels.get(i) == 0 for i in frames[2].index)
    lines = {i: kept for i, _, _, kept in lines_by_hand(list(frames[2].text.items()))}
    assert frames[3].text.to_dict() == lines and (frames[3].n_chars == frames[3].text.str.len()).all()
    roots = near_by_hand(list(frames[3].text.items()))
    assert set(frames[4].index) == {i for i, r in roots.items() if i == r}
    got = cp.run(spark, sf).toPandas()
    assert set(got.doc_id) == set(frames[4].index)
    tokenizer = Tokenizer.from_file(BPE)
    for i, t in frames[4].text.items():
        ids, at = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4"), 0
        for r in got[got.doc_id == i].sort_values("start").itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_pipeline_stages_with_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, empty texts and an empty table pass through every stage."""
    import corpus_pipeline as cp

    rng = random.Random(16)
    text = say(rng, 80)
    rows = [(1, text, "en", "a", 10), (1, text, "en", "a", 10), (2, None, None, None, None), (3, "", "en", None, 0), (None, say(rng, 70), "en", "a", 5), (4, say(rng, 90), None, "a", 7)]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    frame = pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64", "n_chars": "Int64"})
    pd.DataFrame({"doc_id": [1, 4], "quality": [1, 1], "toxic": [0, 0]}).to_parquet(tmp_path / "labels.parquet")
    for part, count in ((frame, 4), (frame.head(0), 0)):
        part.to_parquet(tmp_path / "documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == columns
        assert docs.count() == count
        assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= count


def test_sha_of_pieces(spark):
    """The query's digests are those of the library's ids and texts, for all given documents."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text
    for r in queries.op6_pieces(spark, SF).collect():
        ids = library.encode(docs[r.doc_id] or "", add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest() and r.n_spanned == len((docs[r.doc_id] or "").encode())


def test_written_tables_have_small_row_groups(spark):
    """A writer holds its row group on the heap: eight of 128 MB ended the pipeline on 0.6 GB with a heap of 1 GB."""
    import glob

    import pyarrow.parquet as pq

    store = Scratch(spark, "test")
    many = spark.range(3_000_000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit("x")).alias("h2"), F.col("id").alias("doc_id"))
    texts = spark.range(0, 30_000, 1, 1).select("id", F.concat(*[F.sha2(F.concat("id", F.lit(k)), 512) for k in range(8)]).alias("text"))
    assert store.table(texts, "texts").select(F.sum(F.length("text"))).first()[0] == 30_000 * 8 * 128
    runs = linededup.LineRuns(spark, store.path("runs"))
    runs.add(many)
    assert runs.totals().count() == 3_000_000
    runs.close()
    for path, files in zip(store.paths, (1, runs.buckets), strict=True):
        held = [pq.read_metadata(f) for f in glob.glob(path.removeprefix("file:") + "/**/*.parquet", recursive=True)]
        groups = [[sum(m.row_group(g).column(c).total_compressed_size for c in range(m.num_columns)) for g in range(m.num_row_groups)] for m in held]
        assert len(held) == files and sum(map(sum, groups)) > files * 10e6 and max(map(max, groups)) < 10e6, groups
