"""Operators 1, 3, 5, 6, 9: against brute force, libraries and held-out labels, and on odd inputs."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from keystrata.llm import bpe, decontaminate, quality, token_store, toxicity
from keystrata.llm.common import shared_path

SMALL = "/root/testdata/sf0.01"
SCHEMA = "score string, doc_id bigint, text string, body int, hits string, held_out string, ks_id string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, very long and repeated rows, among columns whose names operators use themselves."""
    texts = [(None, "no id"), (1, None), (2, ""), (3, "Ein Wort, zwei Worte. Ünïcode!\nIDIOT\tmoron"), (3, "Ein Wort, zwei Worte. Ünïcode!\nIDIOT\tmoron"), (4, "a" * 70_000), (5, "lorem ipsum dolor " * 9000), (6, " \n\t ")]
    return spark.createDataFrame([("x", i, t, 1, "h", "o", "k") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def by_id(frame):
    return sorted((r.asDict() for r in frame.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))


# -- BPE ------------------------------------------------------------------------------------------

PATH, PATTERN = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_vocabulary_is_proper():
    assert bpe.load_ranks(PATH).proper()


def test_tree_equals_direct_merges(library):
    coder, rng = bpe.load_ranks(PATH), random.Random(1)
    for n in [0, 1, 5, 33, 64, 65, 200, 1000] * 20:
        piece = "".join(rng.choice(rng.choice(["ab", "aeiouthn", "éèàç", "中文", "=-", "  ", "a"])) for _ in range(n)).encode()
        assert coder.encode(piece) == coder._heap(piece) if piece else coder.encode(piece) == []
        assert coder._scan(piece) == coder._heap(piece)
    long = ("ab" * 5000 + "a" * 7001).encode()
    assert coder.encode(long) == library._encode_single_piece(long)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_texts_encode_as_the_library_does(text):
    with open(PATH, "rb") as f:
        ranks = test_texts_encode_as_the_library_does.__dict__.setdefault("ranks", {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    own = test_texts_encode_as_the_library_does.__dict__.setdefault("own", tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))
    coder = bpe.text_coder(PATH, PATTERN)
    encoded = coder.encode(text)
    assert ",".join(encoded) == ",".join(map(str, own.encode_ordinary(text)))
    assert coder.decode(encoded) == text.encode()


def test_token_digest(spark, odd, none, library):
    rows = by_id(bpe.token_digest(odd, PATH, PATTERN))
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
    assert len(rows) == 8 and bpe.token_digest(none, PATH, PATTERN).count() == 0
    back = bpe.decode_texts(bpe.encode_texts(odd, PATH, PATTERN), PATH)
    assert {r.doc_id: bytes(r.body).decode() for r in back.collect()} == texts


# -- token store ----------------------------------------------------------------------------------

WORDS = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBé ÉßΣİ,.!_5²\n\t\xa0\x85\x1c\x0b\xad'stªx<|>"), max_size=40), max_size=4))
def test_word_coder_equals_whole_texts(texts):
    coder = token_store.word_coder(WORDS)
    for text, raw in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(raw, coder.kind).tolist() == coder.library.encode(text, add_special_tokens=False).ids


def test_word_coder_forgets_and_knows_special_tokens():
    coder, library = token_store.WordCoder(WORDS, cap=20), Tokenizer.from_file(WORDS)
    texts = [f"w{i} the, The. x{i % 7}<|endoftext|> <|ENDOFTEXT|>" for i in range(60)]
    for text in texts + texts:
        assert np.frombuffer(coder.encode([text])[0], coder.kind).tolist() == library.encode(text, add_special_tokens=False).ids


def test_store(spark, odd, none):
    library = Tokenizer.from_file(WORDS)
    where = token_store.write_store(odd, WORDS, shared_path(spark, "t"))
    rows, start = token_store.store_digest(spark, where).orderBy("start").collect(), 0
    texts = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r.doc_id for r in rows] == [t[0] for t in texts]
    for r, (_, text) in zip(rows, texts, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: r.ids[-1] for r in token_store.read_store(spark, where).collect()} == {t[0]: 2 for t in texts}
    dictionary = bytes(spark.read.parquet(f"{where}/dictionary").first().dictionary)
    images = [bytes(r.image) for r in spark.read.parquet(f"{where}/shards").collect()]
    shards = [token_store.Shard(i, dictionary) for i in images]
    assert [s.find(2).tolist() for s in shards if s.find(2) is not None] == [[2]] and all(s.find(99) is None for s in shards)
    with pytest.raises(ValueError, match="another dictionary"):
        token_store.Shard(images[0], b"other")
    assert token_store.store_and_digest(none, WORDS).count() == 0


def test_trained_dictionary_is_used(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    where = token_store.write_store(docs, WORDS, shared_path(spark, "t"))
    assert len(spark.read.parquet(f"{where}/dictionary").first().dictionary) > 1000
    assert token_store.store_digest(spark, where).count() == docs.count()


# -- decontamination ------------------------------------------------------------------------------


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(docs, items):
    found = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = {}
    for name, text in items:
        words = found(lower(text or ""))
        n = min(8, len(words))
        for k in range(len(words) - n + 1 if n and name is not None else 0):
            windows.setdefault(tuple(words[k : k + n]), set()).add(str(name))
    out = []
    for text in docs:
        words, hit, names = found(lower(text or "")), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if (w := tuple(words[k : k + n])) in windows:
                    names |= windows[w]
                    hit.update(range(k, k + n))
        out.append((len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()))
    return out


def test_contamination_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    for limit in (1 << 20, 40):  # in one block and in several
        items = [(rng.choice([k, k, 1, None]), " ".join(rng.choice("abcdeZ") for _ in range(rng.choice([0, 1, 3, 8, 9, 14])))) for k in range(9)] + [(50, None)]
        docs = [None, "", *(" ".join(rng.choice("abcdeé-") for _ in range(rng.choice([2, 10, 60]))) for _ in range(12))]
        docs += [f"Q {t} q" for _, t in items if t] + ["x " * 30_000]
        df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
        bench = spark.createDataFrame(items, "item_id bigint, text string")
        monkeypatch.setattr(decontaminate.blocks, "__defaults__", ("item_id", "text", limit))
        monkeypatch.setattr(decontaminate, "BLOCKS", 3)
        got = decontaminate.contamination_digest(df, bench).orderBy("doc_id").collect()
        wanted = brute(docs, items)
        assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got] == wanted
        assert [r.contaminated for r in got] == [w[2] >= 2 for w in wanted]
        kept = decontaminate.remove_contaminated(df, bench)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [k for k, w in enumerate(wanted) if w[2] == 0]


def brute_longest(docs, items):
    found = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    runs = set()
    for name, text in items:
        words = found(lower(text or "")) if name is not None else []
        runs |= {tuple(words[i:k]) for i in range(len(words)) for k in range(i + 1, len(words) + 1)}
    most = max(map(len, runs), default=0)
    out = []
    for text in docs:
        words = found(lower(text or ""))
        hits = [(-n, i) for i in range(len(words)) for n in range(1, min(most, len(words) - i) + 1) if tuple(words[i : i + n]) in runs]
        out.append((-min(hits)[0], min(hits)[1]) if hits else (0, None))
    return out


def test_longest_match_equals_brute_force(spark, monkeypatch):
    """Also of items that share a window and part after it, and of matches shorter than a window."""
    rng = random.Random(5)
    prompt = "read the text below and answer the question that follows"
    items = [(1, f"{prompt} {' '.join('one two three four five six'.split())}"), (2, f"{prompt} who won the cup in nineteen ten"), (3, "a b c"), (4, None), (None, "never never")]
    items += [(5 + k, " ".join(rng.choice("abcd") for _ in range(rng.choice([2, 9, 30])))) for k in range(12)]
    docs = [None, "", "never seen", f"x y {items[1][1]} z", f"{prompt} two three who won the cup in x", "the cup in nineteen", "text", items[-1][1]]
    docs += [" ".join(rng.choice("abcdez") for _ in range(rng.choice([3, 20, 80]))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    wanted = brute_longest(docs, items)
    assert wanted[3] == (17, 2) and wanted[5] == (4, 0)
    for limit in (1 << 20, 40):
        monkeypatch.setattr(decontaminate.blocks, "__defaults__", ("item_id", "text", limit))
        got = decontaminate.contamination_digest(df, bench).orderBy("doc_id").collect()
        assert [(r.longest_match, r.longest_at) for r in got] == wanted


def test_contamination_of_odd_rows(odd, none, spark):
    bench = spark.createDataFrame([(1, "lorem ipsum dolor lorem ipsum dolor lorem ipsum"), (2, "dolor lorem ipsum dolor lorem ipsum dolor lorem")], "item_id bigint, text string")
    rows = by_id(decontaminate.contamination_digest(odd, bench))
    assert [r["doc_id"] for r in rows if r["contaminated"]] == [5] and rows[6]["n_hit"] == 26_999
    assert decontaminate.remove_contaminated(odd, bench).columns == odd.columns
    assert decontaminate.remove_contaminated(odd, bench).count() == 7 and decontaminate.remove_contaminated(odd, bench.where("false")).count() == 8
    assert decontaminate.contamination_digest(none, bench).count() == 0


# -- classifiers ----------------------------------------------------------------------------------


@pytest.mark.parametrize("op,label,test", [(toxicity, "toxic", lambda r: r.held_out), (quality, "quality", lambda r: r.held_out)])
def test_held_out_labels(spark, op, label, test):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = op.score(docs, op.fit(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in rows if test(r)]
    y, p = np.array([r[label] for r in held]), np.array([r.score for r in held])
    assert len(held) > 500 and ((0 <= p) & (p <= 1)).all() and all(r.predicted == (r.score >= 0.3) for r in held)
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    assert (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum()) > 0.97
    assert ((p >= 0.3) == y).mean() > 0.96


@pytest.mark.parametrize("op,label,fold", [(toxicity, "toxic", (2, 4)), (quality, "quality", (0, 5))])
def test_classifiers_on_odd_rows(spark, odd, none, op, label, fold):
    labels = spark.createDataFrame([(1, 1, 0, "a"), (3, 1, 1, "a"), (3, 0, 1, "a"), (4, 0, 0, "b"), (5, 1, 0, "b"), (9, None, None, None), (None, 1, 1, "c")], "doc_id bigint, quality int, toxic int, text string")
    model = op.fit(odd, labels)
    rows = by_id(op.score(odd, model))
    assert len(rows) == 8 and rows[3]["score"] == rows[4]["score"]
    assert [r["held_out"] for r in rows] == [r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % fold[1] == fold[0] for r in rows]
    assert op.score(none, model).count() == 0
    blank = op.fit(odd, labels.where("false"))
    assert {r["score"] for r in by_id(op.score(odd, blank))} == {0.0} and op.fit(none, labels).constant == 0.0


def test_offending_sentences_are_found(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    text = "Thion ther and the. You idiot moron, stupid scum. Of reat inth."
    got = toxicity.offending_sentences(spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string"), model).collect()
    assert [(r.doc_id, r.sentence) for r in got] == [(1, 1)] and "idiot" in got[0].text


def test_scores_equal_naive_ones(spark, odd):
    """Noisy-or sentence by sentence, and all pairs of features, on the operators' own rows and models."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    some = docs.where("doc_id < 40").select("doc_id", "text").union(odd.where("doc_id in (1, 2, 3)").selectExpr("doc_id + 1000000", "text"))
    texts = {r.doc_id: r.text or "" for r in some.collect()}
    model = toxicity.fit(docs, labels)
    for r in toxicity.score(some, model).collect():
        clean, sentence = 1.0, []
        for line in texts[r.doc_id].split("\n"):
            for k, token in enumerate(words := line.split()):
                sentence.append(token)
                if toxicity.ends_sentence(token) or k + 1 == len(words):
                    z = model.bias + sum(float(model.weights[i]) for t in sentence for i in toxicity.features(t))
                    clean *= 1 - 1 / (1 + np.exp(-z))
                    sentence = []
        expected = -np.log(max(clean, 1e-300))
        assert r.score == pytest.approx(1 / (1 + np.exp(-(model.slope * np.log(expected + 1e-6) + model.offset))), rel=1e-4, abs=1e-6)
    model, made = quality.fit(docs, labels), quality.Featurizer()
    for r in quality.score(some, model).collect():
        marks, values, stats = made(texts[r.doc_id])
        x = dict(zip(marks.tolist(), values.tolist(), strict=True))
        x |= {quality.BUCKETS + k: v for k, v in enumerate(np.clip((stats - model.mean) / model.scale, -4, 4).tolist())}
        used = [i for i in x if model.w[i] or model.v[i].any()]
        z = model.w0 + sum(float(model.w[i]) * x[i] for i in used)
        z += sum(float(model.v[i] @ model.v[j]) * x[i] * x[j] for n, i in enumerate(used) for j in used[:n])
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-3, abs=1e-5)


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    n = len(quality.STATS)
    model = quality.Model(0.3, rng.normal(size=quality.BUCKETS + n), rng.normal(size=(quality.BUCKETS + n, 3)), np.zeros(n), np.ones(n))
    marks, values, stats = np.array([3, 9, 70]), rng.normal(size=3), rng.normal(size=n)
    at, x = np.concatenate([marks, np.arange(n) + quality.BUCKETS]), np.concatenate([values, np.clip(stats, -4, 4)])
    pairs = sum(model.v[at[i]] @ model.v[at[j]] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert model.logit(marks, values, stats) == pytest.approx(0.3 + model.w[at] @ x + pairs)


def test_keep_good_keeps_columns(odd, none, spark):
    model = quality.Model(-10.0, np.zeros(quality.BUCKETS + len(quality.STATS)), np.zeros((quality.BUCKETS + len(quality.STATS), 2)), np.zeros(len(quality.STATS)), np.ones(len(quality.STATS)))
    assert quality.keep_good(odd, model).count() == 0 and quality.keep_good(none, model).count() == 0
    kept = quality.keep_good(odd, model._replace(w0=10.0))
    assert kept.columns == odd.columns and kept.exceptAll(odd).count() == 0 and kept.count() == 8


def test_scores_do_not_depend_on_what_a_worker_read_before():
    """A text with more distinct tokens than were held is read right after the reader forgot those."""
    rng = np.random.default_rng(2)
    before, long = [" ".join(f"{w}{k}{'.' * (k % 3 == 0)}" for k in range(n)) for w, n in (("Ab", 40), ("cde9-", 90))]
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS).astype(np.float32), 0.1, 1.0, 0.0)
    used, fresh = toxicity.Scorer(model), toxicity.Scorer(model)
    used.reader.cap = fresh.reader.cap = 30
    used.expected(before)
    assert used.expected(long) == fresh.expected(long)
    used, fresh = quality.Featurizer(), quality.Featurizer()
    used.reader.cap = fresh.reader.cap = 30
    used(before)
    assert all((a == b).all() for a, b in zip(used(long), fresh(long), strict=True))
