"""Operators 2, 7, 8 against brute force, on fixtures with hot groups and odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow.compute as pc
import pytest
import xxhash

from keystrata.llm import recompression, repeats, simhash, suffix_dedup, tree
from keystrata.llm.components import connected_components

CLASH = "ks_id string, doc_id bigint, text string, fp string, ks_body string, component_id int, n_chars int"


def corpus(seed, words):
    """Shared passages, one passage in a third of the rows, copies, near copies, repeats and odd rows."""
    rng = random.Random(seed)
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pool, hot = [make(rng.randint(5, 40)) for _ in range(8)], make(30)
    rows = [(i, " ".join([*(rng.choice([*pool, make(6)]) for _ in range(rng.randint(0, 6))), *([hot] if i % 3 == 0 else [])])) for i in range(60)]
    rows += [(100 + i, rows[5][1]) for i in range(20)] + [(130, rows[5][1] + " end"), (131, hot.upper())]
    return rows + [(140, None), (141, ""), (142, "a" * 300), (143, "a" * 130 + "b"), (144, "a " * 300), (145, rows[7][1]), (145, rows[7][1]), (None, rows[8][1]), (None, None), (146, make(4000))]


def frame(spark, rows):
    return spark.createDataFrame([("x", i, t, "f", "b", 7, 0) for i, t in rows], CLASH)


def ordered(rows):
    return sorted({(repeats.NULL_ID if i is None else i, (t or "").encode()) for i, t in rows})


def bytes_left(rows, size=100):
    first, out = set(), {}
    for key, body in ordered(rows):
        gone = np.zeros(len(body), bool)
        for p in range(len(body) - size + 1):
            w = body[p : p + size]
            if w in first:
                gone[p : p + size] = True
            first.add(w)
        out[key, body] = gone
    return out


@pytest.fixture(params=[(24000, 2, 300), (4 << 20, 256, 4 << 20)])
def shards(request, monkeypatch):
    """Shards of a few documents in a tree of several levels and texts in blocks; and all in one."""
    size, fan, block = request.param
    monkeypatch.setattr(repeats, "SHARD_BYTES", size)
    monkeypatch.setattr(tree, "FAN", fan)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(recompression, "BLOCK", block)


@pytest.mark.parametrize("seed,words", [(1, ["a", "b", "é"]), (2, [f"wörd{i}" for i in range(50)])])
def test_suffix_dedup_equals_brute_force(spark, shards, seed, words):
    rows = corpus(seed, words)
    wanted, expected = bytes_left(rows), []
    for i, t in rows:
        body = (t or "").encode()
        gone = wanted[repeats.NULL_ID if i is None else i, body]
        left = np.frombuffer(body, np.uint8)[~gone].tobytes()
        spans = len(re.findall("1+", "".join(str(int(g)) for g in gone)))
        expected.append((i, len(body), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    got = [tuple(r) for r in suffix_dedup.dedup_digest(frame(spark, rows)).collect()]
    key = lambda r: (r[0] is not None, *map(str, r))
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert suffix_dedup.dedup_digest(frame(spark, rows).where("false")).count() == 0


def test_keep_first_keeps_rows_columns_and_valid_text(spark, shards):
    rows = corpus(3, ["aé", "b", "ü"])
    docs = frame(spark, rows)
    got = suffix_dedup.keep_first(docs)
    assert got.schema.simpleString() == docs.schema.simpleString()
    wanted = bytes_left(rows)
    for r in got.collect():
        assert (r.ks_id, r.fp, r.component_id) == ("x", "f", 7) and r.n_chars == (None if r.text is None else len(r.text))
    texts = sorted((r.text for r in got.collect() if r.doc_id is not None and r.text), key=str)
    expected = []
    for i, t in rows:
        if i is not None and t:
            gone = wanted[i, t.encode()]
            at, left = 0, ""
            for c in t:
                n = len(c.encode())
                left += "" if gone[at : at + n].all() else c
                at += n
            expected.append(left)
    assert texts == sorted((t for t in expected if t), key=str)
    assert sum(r.text is None for r in got.collect()) == 2


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for n in (1, 5, 100, 2000):
        for letters in (1, 2, 200):
            data = rng.integers(1, letters + 1, n).astype(np.uint8)
            data = np.concatenate([data, data[: n // 2]])
            array, _ = suffix_dedup.suffix_array(data, 128)
            raw = data.tobytes()
            cut = [raw[i : i + 128] for i in array]
            assert cut == sorted(cut)
            common = suffix_dedup.common_prefixes(data, array, 100)
            for k in range(1, len(array)):
                a, b, m = raw[array[k - 1] :], raw[array[k] :], 0
                while m < min(len(a), len(b), 100) and a[m] == b[m]:
                    m += 1
                assert common[k] == m


def some_runs(method, texts, names, ids):
    """One run for each text, all windows of it; its anchor at its first unit."""
    n = np.array([len(t) - method.window + 1 for t in texts])
    ids, zeros = np.array(ids), np.zeros(len(texts), np.int64)
    return repeats.Runs(np.array(names, np.uint64), zeros.astype(np.uint64), zeros, ids, zeros, zeros, zeros.astype(np.int16), n.astype(np.int32), np.concatenate(texts))


@pytest.mark.parametrize("method,unit", [(suffix_dedup.Bytes(16, 8), np.uint8), (recompression.Words(5), np.uint64)])
def test_merge_compares_contents(monkeypatch, method, unit):
    """Runs of one anchor are told apart by their units, also if every hash collides."""
    monkeypatch.setattr(repeats, "mix", lambda a: np.zeros(len(a), np.uint64))
    rng, window = np.random.default_rng(4), method.window
    texts = [rng.integers(1, 3, window + rng.integers(0, 3)).astype(unit) for _ in range(60)]
    texts += [texts[k].copy() for k in (0, 5, 5, 59)] + [np.append(texts[3], texts[4][:1])]
    for children in (1, 3, 9):
        runs = some_runs(method, texts, np.arange(len(texts)) % 2, list(range(len(texts))))
        (run, k, n), firsts = repeats.merge_runs(method, runs, np.sort(np.arange(len(texts)) % children))
        got = {(int(r), int(j)) for r, a, m in zip(run, k, n, strict=True) for j in range(a, a + m)}
        seen, wanted = {}, set()
        for r, t in enumerate(texts):
            for j in range(len(t) - window + 1):
                key = t[j : j + window].tobytes()
                if seen.setdefault(key, (r, j))[0] != r or (method.within_document and seen[key] != (r, j)):
                    wanted.add((r, j))
        assert got == wanted
        assert all(f == any((r, j) not in wanted for j in range(runs.n[r])) for r, f in enumerate(firsts))


def test_a_node_never_gets_more_than_a_row_a_child(spark):
    """One anchor in every shard: no node of the tree has more rows than its fan, and the answers are right."""
    shape, codec = tree.Tree.over(30, 4, fan=3), tree.Numbers()
    assert shape.depth == 4
    keys = {s: np.array([7, 1000 + s // 2, 5000 + s], np.uint64)[:, None] for s in range(30)}
    rows = [r for s in keys for r in shape.ask(codec, keys[s], np.zeros(3, bool), s, s)]
    sent = spark.createDataFrame(rows, tree.INFO).repartition(4, "target")
    assert sent.groupBy("target").count().agg({"count": "max"}).first()[0] <= 3
    for rule in (tree.Shared(), tree.Naming(2)):
        told = shape.agree(sent, codec, rule).toArrow()
        got = {s: shape.answers(codec, keys[s], told.filter(pc.equal(told.column("target"), s)), s).tolist() for s in keys}
        if isinstance(rule, tree.Shared):
            assert all(g[0] == 4 and g[2] == 0 and g[1] == (1 if s % 2 == 0 and s % 3 < 2 or s % 2 and s % 3 else g[1]) >= 1 for s, g in got.items())
        else:
            names = {g[0] for g in got.values()} | {g[1] for g in got.values()}
            assert len(names) == 16 and 0 not in names and all(g[2] == 0 for g in got.values())


def test_a_tree_has_about_as_many_nodes_as_shards():
    """Just over a power of the fan, too: 2,400 shards (6 GB) once had 65,536 top nodes and 256 rows a shard and level."""
    hashes = np.random.default_rng(6).integers(0, 1 << 63, 400_000).astype(np.uint64)
    for shards in (204, 257, 2400, 12_000, 70_000):
        shape = tree.Tree.over(shards, 4)
        assert shape.fan <= tree.FAN and shape.fan**shape.depth >= shards
        assert len(np.unique(shape.nodes(shape.depth, 0, hashes))) <= 2 * shards
        assert len(np.unique(shape.nodes(1, shards - 1, hashes))) ** shape.depth <= 2 * shards


def test_partitions_can_hold_several_shards(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_BYTES", 1000)
    docs = frame(spark, [(i, f"{i} " * 100) for i in range(200)])
    one, four = (repeats.deal(docs.select("doc_id", "text"), together=k).tree for k in (1, 4))
    assert 3 * four.parts < one.parts and (one.fan, one.depth) == (four.fan, four.depth)


def test_runs_travel_whole():
    for method, unit in ((suffix_dedup.Bytes(16, 8), np.uint8), (recompression.Words(5), np.uint64)):
        texts = [np.random.default_rng(k).integers(0, 200, method.window + k).astype(unit) << unit(k % 2) for k in range(9)]
        sent = some_runs(method, texts, np.arange(9), list(range(9))).pick(np.array([1, 2, 5]), method.window)
        for a, b in zip(sent, repeats.Runs.unpack(sent.pack(), method.payload), strict=True):
            assert a.tolist() == b.tolist()


def test_keys_are_told_apart_by_what_they_hold(monkeypatch):
    """Words and rows of numbers, also if every hash collides."""
    words = [b"a", b"a\0", b"\0", b"x" * 8, b"x" * 9, b"x" * 16, b"x" * 16 + b"\0", b"x" * 17, b"x" * 16 + b"y", "é".encode(), b"z" * 5000]
    codec = tree.Words()
    keys, twice = codec.of(words), np.arange(len(words)) % 2 == 0
    assert len(np.unique(codec.hashes(keys))) == len(words)
    assert (codec.hashes(keys[3:8]) == codec.hashes(keys)[3:8]).all() and not len(codec.hashes(codec.of([])))
    got, flags = codec.unpack(codec.pack(codec.pick(keys, np.arange(len(words))[::-1]), twice))
    assert got.to_pylist() == words[::-1] and (flags == twice).all()
    assert codec.unpack(codec.pack(keys[2:4], twice[2:4]))[0].to_pylist() == words[2:4]
    known, number = codec.unify([keys, codec.of(words[::-1])])
    assert sorted(known.to_pylist()) == sorted(words) and [known[int(k)].as_py() for k in number] == words + words[::-1]
    rows = np.random.default_rng(7).integers(0, 3, (500, 3)).astype(np.uint64)
    for collide in (False, True):
        if collide:
            monkeypatch.setattr(tree, "mix", lambda a: np.zeros_like(a))
        for some in (rows, rows[:1], rows[:0]):
            found, number = tree.distinct_rows(some)
            assert (found[number] == some).all() and len(found) == len(set(map(tuple, some.tolist())))


def words_left(rows, size=13):
    find, first, split = re.compile(rb"[^\x20\x09-\x0D]+").findall, {}, {}
    for d in ordered(rows):
        words = split[d] = find(d[1])
        for p in range(len(words) - size + 1):
            first.setdefault(tuple(words[p : p + size]), d)
    out = {}
    for d, words in split.items():
        gone = [False] * len(words)
        for p in range(len(words) - size + 1):
            if first[tuple(words[p : p + size])] != d:
                gone[p : p + size] = [True] * size
        out[d] = len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("seed,words", [(1, ["a"]), (2, ["a", "b"]), (4, [f"w{i}" for i in range(40)])])
def test_recompression_equals_brute_force(spark, shards, seed, words):
    rows = corpus(seed, words)
    wanted, expected = words_left(rows), []
    for i, t in rows:
        n, gone, left = wanted[repeats.NULL_ID if i is None else i, (t or "").encode()]
        expected.append((i, n, gone, hashlib.sha256(left).hexdigest()))
    got = [tuple(r) for r in recompression.dedup_digest(frame(spark, rows)).collect()]
    key = lambda r: (r[0] is not None, *map(str, r))
    assert sorted(got, key=key) == sorted(expected, key=key)
    texts = {r.doc_id: r.text for r in recompression.dedup_texts(frame(spark, rows).where("doc_id < 100")).collect()}
    assert texts == {i: words_left(rows[:60])[i, t.encode()][2].decode() for i, t in rows[:60]}
    assert recompression.dedup_digest(frame(spark, rows).where("false")).count() == 0


def test_words_are_numbered_by_their_bytes(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice(["a", "b", "é", "\0", " ", "\n", "\t ", "\x0b", "\x85", "word", "x" * 15, "y" * 17]) for _ in range(4000)).encode()
    for collide in (False, True):
        if collide:
            monkeypatch.setattr(recompression, "mix", lambda a: a & np.uint64(3))
        for t in (text, text.strip(), b"", b"  ", b"a", b"abcdefgh" * 2 + b" " + b"abcdefgh" * 2 + b"\0"):
            begin, words, number = recompression.word_numbers(t)
            assert [words[k] for k in number] == t.split() and len(set(words)) == len(words)
            assert all(t[b:].startswith(words[k]) for b, k in zip(begin, number, strict=True))
    monkeypatch.setattr(recompression, "CHUNK", 50)
    assert b" ".join(p.strip() for p in recompression.pieces(text)).split() == text.split() and max(map(len, recompression.pieces(text))) < 300
    docs = type("Docs", (), {"texts": lambda self: iter([b"", text, text[:70], text])})()
    read = recompression.read_words(docs)
    assert [[read.words[k] for k in c] for c in read.codes] == [t.split() for t in docs.texts()] and len(set(read.words)) == len(read.words)


def test_ids_that_look_like_null(spark):
    """The least bigint is an id of its own, after null ids."""
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(repeats.NULL_ID, text), (None, text), (repeats.NULL_ID, text[1:])]
    for op in (suffix_dedup, recompression):
        got = sorted((str(r.doc_id), r.n_removed > 0) for r in op.dedup_digest(frame(spark, rows)).collect())
        assert got == [(str(repeats.NULL_ID), True), (str(repeats.NULL_ID), True), ("None", False)]


def test_equal_windows_keep_equal_symbols():
    """The symbols that depend on nothing outside a window are the same wherever it stands."""
    rng = np.random.default_rng(5)
    method, names = recompression.Words(), {}
    for letters in (1, 2, 5, 1000):
        window = rng.integers(1, letters + 1, 13).astype(np.uint64)
        chosen = set()
        for _ in range(20):
            a, b = (rng.integers(1, letters + 1, rng.integers(0, 30)).astype(np.uint64) for _ in range(2))
            units = np.concatenate([a, window, b, a])
            lengths = np.array([len(units) - len(a), len(a)])
            state = recompression.first_state(*(np.arange(2),) * 3, lengths, units)
            for level in range(1, method.rounds + 1):
                step = recompression.rewrite(state, level)
                new = np.array([names.setdefault((level, *k), len(names) + 2000) for k in step.keys.tolist()], np.uint64)
                state = recompression.named(state, step, new, level)
            runs = method.runs(state, 0, 1)
            k = np.flatnonzero((runs.id == 0) & (runs.low <= len(a)) & (runs.low + runs.n > len(a)))[0]
            chosen.add((int(runs.name[k]), int(runs.off[k] - (len(a) - runs.low[k]))))
        assert len(chosen) == 1


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus(6, [f"w{i}" for i in range(300)]) + [(200 + i, " ".join(f"t{j if j != i else 'x'}" for j in range(120))) for i in range(40)]
    prints = [plain_fingerprint(t) for _, t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    group = smallest(range(len(rows)), near)
    least = {}
    for k, g in group.items():
        if rows[k][0] is not None:
            least[g] = min(least.get(g, 1 << 60), rows[k][0])
    expected = sorted(((str(rows[k][0]), f"{prints[k]:016x}", least.get(group[k])) for k in range(len(rows))), key=str)
    got = simhash.near_duplicate_digest(frame(spark, rows)).collect()
    assert sorted(((str(r.doc_id), r.fingerprint, r.component_id) for r in got), key=str) == expected
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(least.values()))
    assert simhash.near_duplicate_digest(frame(spark, rows).where("false")).count() == 0
    assert simhash.keep_one(frame(spark, rows).where("false")).count() == 0


def test_one_row_of_each_component_stays(spark):
    """Also where ids repeat or are null: unrelated texts all stay, copies are one."""
    text = {k: " ".join(f"{k}{j}" for j in range(80)) for k in "abcdef"}
    rows = [(7, text["a"]), (7, text["b"]), (5, text["b"]), (7, text["c"]), (None, text["c"]), (None, text["d"]), (None, text["d"]), (None, text["e"]), (9, text["f"]), (9, text["f"])]
    for part in (rows, rows[::-1]):
        kept = simhash.keep_one(frame(spark, part)).collect()
        assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(7, text["a"]), (5, text["b"]), (7, text["c"]), (None, text["d"]), (None, text["e"]), (9, text["f"])], key=str)


@pytest.mark.parametrize("total", [100, 10**5, 10**6, 10**7, 10**9])
def test_plans_lose_no_link(total):
    rng = np.random.default_rng(total % 97)
    prints = []
    for x in rng.integers(0, 1 << 63, 30, dtype=np.uint64):
        for _ in range(rng.integers(1, 60)):
            y = int(x)
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                y ^= 1 << int(b)
            prints.append(y)
    prints = np.unique(np.array(prints, np.uint64))
    plan = simhash.make_plan(prints[::3], total)
    assert sum(t + 1 for t in plan.thresholds) == 5 and sum(plan.masks) == (1 << 64) - 1
    filed = simhash.file_rows(prints, plan)
    whole = np.zeros(len(filed[0]), np.int64)
    a, b = simhash.verified_links(*filed, whole, whole, plan.thresholds)
    at = {int(p): k for k, p in enumerate(prints)}
    got = smallest(range(len(prints)), [(at[int(x)], at[int(y)]) for x, y in zip(a, b, strict=True)])
    near = [(i, j) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= 4)]
    assert got == smallest(range(len(prints)), near)


@pytest.mark.parametrize("crowded", [0, 40, 10**6])
def test_split_values_lose_no_link(spark, crowded):
    """Two parts of 32 bits, most of it equal: values that all, some or none of which are split by other bits."""
    rng = np.random.default_rng(crowded % 89)
    prints = {int(x) ^ 1 << int(b) ^ 1 << int(c) for x in rng.integers(0, 1 << 62, 12) for b, c in rng.integers(0, 64, (25, 2))}
    prints |= {(int(x) & 0xFFFFFFFF) | 0xABCD << 40 for x in rng.integers(0, 1 << 62, 300)}
    prints = np.array(sorted(prints), np.uint64)
    plan = simhash.Plan((0xFFFFFFFF, 0xFFFFFFFF << 32), (2, 1))
    distinct = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp bigint")
    got = simhash.links(distinct, plan, 5, crowded=crowded).collect()
    at = {int(p): k for k, p in enumerate(prints.view(np.int64))}
    near = [(i, int(j)) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= 4)]
    assert near and smallest(range(len(prints)), [(at[r.a], at[r.b]) for r in got]) == smallest(range(len(prints)), near)


@pytest.mark.parametrize("crowd", [1 << 20, 7])
def test_components(spark, crowd):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(70)] + [(5, 5), (None, 3)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint"), crowd=crowd).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == smallest({x for link in real for x in link}, real)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
