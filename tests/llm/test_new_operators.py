"""Whitening, SetSketch near-dedup and tokenizer alignment against brute force, with the edge cases of each."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparqa.llm import common, embedding_whitening, queries, setsketch_dedup, token_alignment
from sparqa.llm.queries import vocabulary

EMB = "vec_id bigint, embedding array<float>, label int, x string, w string, z string"


def _white(rows, weights="counts"):
    """(x, n, deviation, projections up to sign, shares) of a list of vectors, in NumPy and Python integers."""
    xs = [tuple(math.floor(1024 * float(np.float32(c))) + 100000 for c in v) for v in rows]
    fit = xs if weights == "counts" else sorted(set(xs))
    n, d = len(fit), len(xs[0])
    sums = [sum(v[i] for v in fit) for i in range(d)]
    off = np.array([[n * a - s for a, s in zip(v, sums)] for v in fit], float) / n
    e, q = np.linalg.eigh(off.T @ off / n)
    e, q = e[::-1], q[:, ::-1]
    own = np.array([[n * a - s for a, s in zip(v, sums)] for v in xs], float) / n
    dev = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in xs]
    return n, dev, own @ q, e


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_whitening(spark, weights):
    rng = np.random.default_rng(3)
    vectors = [list(map(float, v)) for v in (rng.normal(size=(300, 10)) * np.linspace(3, .5, 10)).astype(np.float32)]
    vectors += [vectors[7]] * 150  # a third of the rows hold one vector
    bad = [None, [], [None] * 10, [float("nan")] * 10, [float("inf")] + [0.0] * 9, [1.0] * 9, [1e30] * 10]
    rows = [(i, v, 0, "a", "b", "c") for i, v in enumerate([*vectors, *bad])] + [(None, vectors[0], 1, "", "", "")]
    got = embedding_whitening.whiten(spark.createDataFrame(rows, EMB), weights=weights).collect()
    n, dev, own, e = _white([*vectors, vectors[0]], weights)
    assert len(got) == 8 * 451 and {r["n"] for r in got} == {n}
    assert all(r["identity_error"] < 1e-9 for r in got)
    signs = {}
    for r in got:
        i, k = 450 if r["vec_id"] is None else r["vec_id"], r["component"] - 1
        want = own[i, k] / math.sqrt(e[k])
        sign = signs.setdefault(k, math.copysign(1, want * r["whitened"]))
        assert r["whitened"] * sign == pytest.approx(want, abs=1e-8)
        assert int(r["deviation"]) == dev[i]
        assert r["explained"] == pytest.approx(e[k] / e.sum(), rel=1e-9)
        assert r["occurrences"] == (151 if i in range(300, 450) or i == 7 else 2 if i in (0, 450) else 1)


def test_whitening_hot_vectors_and_large_values(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_SHARE", 8)
    vectors = [[2.0 ** 40, 1.0, -3.0]] * 20 + [[float(i % 7), float(i * i % 11), 2.0] for i in range(21)]
    rows = [(i, v, 0, "", "", "") for i, v in enumerate(vectors)]
    got = embedding_whitening.whiten(spark.createDataFrame(rows, EMB)).collect()
    _, dev, _, _ = _white(vectors)
    assert len(got) == 3 * 41 and all(int(r["deviation"]) == dev[r["vec_id"]] for r in got)


def test_whitening_without_variance(spark):
    empty = spark.createDataFrame([], EMB)
    out = embedding_whitening.whiten(empty)
    assert out.count() == 0 and queries.QUERIES["op12_embedding_whitening"] is not None
    same = spark.createDataFrame([(i, [0.5, 0.25], 0, "", "", "") for i in range(3)], EMB)
    got = embedding_whitening.whiten(same).collect()
    assert len(got) == 6
    assert {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in got} == {(None, 0.0, None, "0")}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], 0, "", "", "") for i in range(5)], EMB)
    got = embedding_whitening.whiten(line).collect()
    assert {r["component"] for r in got if r["whitened"] is None} == {2, 3}
    assert all(r["identity_error"] < 1e-9 for r in got)


A_PATH, B_PATH = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
DOCS = "doc_id bigint, text string, lang string, pair string, n string, rid string, rep string"


def _odd_texts(count=60):
    rng = random.Random(5)
    parts = ["word", "the", "Ünïcode", " ", "  ", "   ", "\n", "\n\n", " \n ", "\t", "\r\n", "日本語", "テキスト", "😀", "👩‍👩‍👧", "'s", "don't", "12345",
             "3.14", "...", "!?", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "\x1c", "\x85", "\u00a0", "\u3000", "\u200b", "é", "ﬁ", "foo_bar", "{}[]", "\x00"]
    return ["".join(rng.choice(parts) + (" " if rng.random() < .6 else "") for _ in range(rng.randrange(1, 40))) for _ in range(count)]


def _alignment(texts):
    """Whole-text tokenisations, byte ends, groups, links and corpus counts, one step after the other."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_coder, b_coder = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_coder.encode_special_tokens = True
    sign = token_alignment._byte_signs()
    out = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = a_coder.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_coder.encode(text) if text else []
        ends = []
        for ids, own in ((a, lambda i: bytes(sign[c] for c in a_coder.id_to_token(i))),
                         (b, lambda i: bytes([int(b_coder.id_to_piece(i)[3:5], 16)]) if b_coder.is_byte(i) else b_coder.id_to_piece(i).replace("\u2581", " ").encode())):
            pieces = [own(i) for i in ids]
            ends.append(np.cumsum([len(p) for p in pieces]).tolist() if b"".join(pieces) == raw else None)
        if not text or None in ends:
            out.append(None)
            continue
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, low = [], 0
        for s in shared:
            groups.append(([i for i, e in zip(a, ends[0]) if low < e <= s], [i for i, e in zip(b, ends[1]) if low < e <= s]))
            low = s
        out.append((a, b, groups, [(x, y) for g, h in groups for x in g for y in h]))
    docs = collections.Counter(p for r in out if r for p in set(r[3]))
    most = collections.Counter()
    for (x, _), c in docs.items():
        most[x] = max(most[x], c)
    rows = []
    for r in out:
        if r is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in r[2])
        rows.append((len(r[0]), len(r[1]), len(r[2]), len(r[3]), sum(docs[p] == most[p[0]] for p in r[3]), sum(docs[p] for p in r[3]),
                     hashlib.sha256(text.encode()).hexdigest()))
    return rows


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("hot", [0, 40, 1 << 17])
def test_alignment(spark, hot):
    texts = [None, "", " ", "  ", "\n", "a", "a ", " a", "a \u2581 b", "x\u2581y", "long " + "wordé wörd " * 3000, "repeat me now", *_odd_texts()]
    rows = [(i, t, "l", "p", "n", "r", "e") for i, t in enumerate(texts)] + [(11, "repeat me now", "", "", "", "", ""), (None, "no id here", "", "", "", "", "")]
    got = token_alignment.align_table(spark.createDataFrame(rows, DOCS).repartition(3), A_PATH, B_PATH, hot_pairs=hot)
    want = _alignment([r[1] for r in rows])
    assert collections.Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got.collect()) == collections.Counter(
        (r[0], *w) for r, w in zip(rows, want))


def test_alignment_forgets_and_learns_again(monkeypatch):
    coder = token_alignment._tokenizers(A_PATH, B_PATH)
    monkeypatch.setattr(token_alignment, "CHUNKS_A_CALL", 3)
    small, large = token_alignment.Aligner(coder, kept=2), token_alignment.Aligner(coder)
    for text in _odd_texts(30):
        a, b = small.encode([text, None])[0], large.encode([text])[0]
        assert ";".join(small.text[w] for w in a) == ";".join(large.text[w] for w in b)


def test_alignment_of_an_empty_table(spark):
    assert token_alignment.align_table(spark.createDataFrame([], DOCS), A_PATH, B_PATH).count() == 0


def _shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w)} if 0 < len(w) < 4 else {b" ".join(w[i:i + 4]) for i in range(len(w) - 3)}


def _near_components(rows):
    sets = [_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return collections.Counter((d, len(sets[i]), least.get(root(i)), d == least.get(root(i))) for i, (d, _) in enumerate(rows))


def _near_texts():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}é"
    texts = [None, "", " \t\n ", "one", "ONE", "one two three", "one two  three four", "Ünder ünder", "ünder ünder"]
    for size in (6, 14, 40, 120, 400):
        base = [word() for _ in range(size)]
        texts.append(" ".join(base))
        for _ in range(14):  # around the threshold, each copy made from the base or from the copy before
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, size // 24) + 1)):
                copy[rng.randrange(size)] = word()
            texts.append(" ".join(copy))
            if rng.random() < .3:
                base = copy
    shared = " ".join(word() for _ in range(30))
    texts += [" ".join(word() for _ in range(20)) + " " + shared for _ in range(30)]
    texts += [" ".join(word() for _ in range(30)) for _ in range(20)] + ["same text in many rows of it"] * 60
    return texts + ["long " + " ".join(word() for _ in range(30000))]


@pytest.mark.parametrize("block", [4, 1024])
def test_near_components(spark, monkeypatch, block):
    monkeypatch.setattr(setsketch_dedup, "BLOCK", block)
    monkeypatch.setattr(setsketch_dedup, "BLOCK_ELEMENTS", 400 * block)
    monkeypatch.setattr(setsketch_dedup, "PAIRS_A_TASK", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = [(i, t) for i, t in enumerate(_near_texts())]
    rows += [rows[20], (4, "another text under a number that is taken"), (None, rows[30][1]), (None, "nobody has this text here"), (None, "nobody has this text here"), (None, "")]
    docs = spark.createDataFrame([(d, t, "l", "p", "n", "r", "e") for d, t in rows], DOCS)
    got = setsketch_dedup.near_components(docs).collect()
    assert collections.Counter(tuple(r) for r in got) == _near_components(rows)
    assert [f.dataType.simpleString() for f in setsketch_dedup.near_components(docs.limit(0)).schema] == ["bigint", "bigint", "bigint", "boolean"]
    assert setsketch_dedup.near_components(docs.where("false")).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 9000).astype(np.uint64)
    for size, overlap in ((2000, .5), (2000, .8), (300, .8), (60, .3)):
        shared = int(2 * size * overlap / (1 + overlap))
        a, b = np.sort(pool[:size]), np.sort(pool[size - shared:2 * size - shared])
        x, y, union = setsketch_dedup.sketches([a, b, np.union1d(a, b)])
        assert (setsketch_dedup.merged(x, y) == union).all()
        true = shared / (2 * size - shared)
        sizes = np.array([float(size)])
        got = setsketch_dedup.most_likely(np.array([(x > y).sum()]), np.array([(x < y).sum()]), sizes, sizes)[0]
        assert abs(got - true) < 5 * math.sqrt(true * (1 - true) / setsketch_dedup.REGISTERS)
    one_by_one = [setsketch_dedup.sketches([s])[0] for s in (pool[:700], pool[:3], pool[:0])]
    assert (np.array(one_by_one) == setsketch_dedup.sketches([pool[:700], pool[:3], pool[:0]])).all()
    # every register of one element is an exponential variable of its own, so the sketch of n elements is that of its rate
    levels = setsketch_dedup.sketches([pool[i:i + 1] for i in range(200)]).astype(float)
    mean = (1 - levels.mean()) * math.log(setsketch_dedup.BASE)  # about E log of Exp(RATE) = -euler - log(RATE)
    assert mean == pytest.approx(-0.5772 - math.log(setsketch_dedup.RATE), abs=.03)


def test_open_rows_of_every_pair_of_two_labels():
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.choice(10_000, 50, replace=False).astype(np.uint64)) for _ in range(3)]
    sketch = setsketch_dedup.sketches([sets[0]] * 6 + [sets[1]] * 4 + [sets[2]] * 3)
    unit, size = np.array([0] * 6 + [1] * 4 + [2] * 3), np.full(13, 50)
    block = np.array([0, 0, 1, 1, 1, 0, 2, 2, 2, 2, 0, 0, 1])
    label = np.array([0, 0, 1, 0, 0, 1, 6, 7, 7, 7, 1, 2, 1])
    got = setsketch_dedup.open_rows(unit, block, label, sketch, size)
    pairs = [(a, b) for a in range(13) for b in range(a) if unit[a] == unit[b] and label[a] != label[b]
             and (block[a] != block[b] or unit[a] == 1)]
    assert got.tolist() == [any(k in p for p in pairs) for k in range(13)]
    assert not got[10] and got[11] and got[12]


@pytest.mark.parametrize("columns", [3, 4096])
def test_full_links(monkeypatch, columns):
    monkeypatch.setattr(setsketch_dedup, "COLUMNS", columns)
    rng = np.random.default_rng(8)
    base = rng.choice(1000, 60, replace=False)
    sets = [np.unique(np.where(rng.random(60) < rng.choice([.02, .2]), rng.integers(0, 10**6, 60), base)) for _ in range(30)]
    a, b = setsketch_dedup.full_links(sets)
    want = [(i, j) for i in range(30) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]

    def parts(pairs):
        name = list(range(30))
        for i, j in pairs:
            name = [name[j] if n == name[i] else n for n in name]
        return [[k for k in range(30) if name[k] == name[i]] for i in range(30)]

    assert parts(zip(a.tolist(), b.tolist())) == parts(want) and len(a) < 30


def test_word_ids_of_many_rows_at_once(spark):
    """op7: slices as wide as the packing takes them give the ids of the whole texts; odd words, no words and nulls included."""
    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    from sparqa.llm import best_fit_packing as packing
    from sparqa.llm.common import text_slices
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Word WORD. word,, İx It's a1", "  lead\ttail \n", "", None, "...", "été! café x#$ |y|"] * 250
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = list(text_slices(batch, "text", packing.ROWS_A_CALL))
    assert [p.num_rows for p in parts] == [1500]  # one call where three were made
    ids, ends = packing.WordIds(path).encode(parts[0].column(0))
    coder = Tokenizer.from_file(path)
    for k in range(6):
        assert ids[ends[k]:ends[k + 1]].tolist() == coder.encode(texts[k] or "", add_special_tokens=False).ids


def test_searches_of_sketches_take_few_likelihoods(monkeypatch):
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 2**63, size=size, dtype=np.uint64) for size in (40, 200, 210, 500)]
    sets = [np.unique(b[rng.random(len(b)) < share]) for b in base for share in (.6, .8, .88, .9, .93, .97, 1.) for _ in range(10)]
    sketch, size = setsketch_dedup.sketches(sets), np.array([*map(len, sets)])
    a, b = np.triu_indices(len(sets), 1)
    x, y, n, m = sketch[a], sketch[b], size[a].astype(float), size[b].astype(float)
    counts = (x > y).sum(axis=1), (x < y).sum(axis=1), n, m
    best, bound = setsketch_dedup.most_likely(*counts), setsketch_dedup.PERCENT / 100
    loss = setsketch_dedup.log_likelihood(best, *counts) - setsketch_dedup.log_likelihood(np.full(len(a), bound), *counts)
    fits = 100 * np.minimum(n, m) >= setsketch_dedup.PERCENT * np.maximum(n, m)
    sure = abs(best - bound) > .001  # the search for the best ends somewhere near it
    assert (setsketch_dedup.likely_links(x, y, size[a], size[b]) == fits & (best >= bound))[sure].all()
    open_ = setsketch_dedup.open_links(x, y, size[a], size[b])
    assert (open_ == fits & ((best >= bound) | (loss <= setsketch_dedup.MARGIN))).all() and 0 < open_.sum() < len(a)

    calls = []
    monkeypatch.setattr(setsketch_dedup, "log_likelihood", lambda *x, f=setsketch_dedup.log_likelihood: calls.append(len(x[0])) or f(*x))
    one = np.zeros(len(sets), np.int64)
    got = setsketch_dedup.open_rows(one, one, np.arange(len(sets)), sketch, size)
    assert (got == np.isin(np.arange(len(sets)), [*a[open_], *b[open_]])).all()
    assert len(calls) < 2 * len(sets)  # a round of likelihoods for each row would be 50 times their number


def test_components_write_two_tables_a_round(spark, monkeypatch):
    from sparqa.llm import components

    made = []
    monkeypatch.setattr(components, "saved", lambda df, name, f=components.saved: made.append(name) or f(df, name))
    links = [(i, i + 1) for i in range(20)] + [(50, 40), (40, 45), (60, 60)] + [(70, i) for i in range(71, 90)]
    got = {tuple(r) for r in components.connected_components(spark.createDataFrame(links, "x bigint, y bigint")).collect()}
    assert got == {*((i, 0) for i in range(21)), (40, 40), (45, 40), (50, 40), *((i, 70) for i in range(70, 90))}
    rounds = sum(name.startswith("star-s") for name in made)
    assert len(made) == 1 + 2 * rounds  # and no other pass over the links: their marks are taken as they are written
    assert components.connected_components(spark.createDataFrame([], "x bigint, y bigint")).collect() == []


def test_words_of_letters_are_encoded_without_a_special_token():
    import pyarrow as pa

    from sparqa.llm import best_fit_packing as packing

    path = vocabulary("word_bpe_49k.json")
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    words = ["The", "word", "naïveté", "ünter", "don't", "I\u0307x", "e\u0301a", "İstan", "x1", "a|b", "end.", *letters, *(f"a{x}b" for x in letters)]
    direct = packing._coder(path).encode_batch(words, add_special_tokens=False)

    class Seen:
        def __init__(self, coder):
            self.coder, self.said = coder, []

        def __getattr__(self, name):
            return getattr(self.coder, name)

        def encode_batch_fast(self, texts, **more):
            self.said += texts
            return self.coder.encode_batch_fast(texts, **more)

    for ends_known in (True, False):  # without tokens known to end words, the special token divides all
        own = packing.WordIds(path)
        own.coder = seen = Seen(own.coder)
        own.ends_word &= ends_known
        ids, ends = own.encode(pa.array(words))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [e.ids for e in direct]
        divided = [w for line in seen.said if packing.DIVIDER in line for w in line.split(packing.DIVIDER)]
        assert any(w.isascii() and w.isalpha() for w in divided) is not ends_known and "x1" in divided


def test_trees_hold_few_words(monkeypatch):
    """op4 and pipeline: groups come to the trees as bytes, some ``TASK_WORDS`` words at a time, and no group is cut."""
    import pyarrow as pa

    from sparqa.llm import substring_dedup

    class Grouped:
        def mapInArrow(self, run, schema):
            return run

    sizes, find = [], substring_dedup.deep_windows
    monkeypatch.setattr(substring_dedup, "deep_windows", lambda segments, window: sizes.append(sum(map(len, segments))) or find(segments, window))
    # 4 groups of 2500 segments of 60 words, equal within a group
    rows = [(g, b"%d" % k, 7, b" ".join(b"w%d" % (60 * g + i) for i in range(60))) for g in range(4) for k in range(2500)]
    names, kinds = ("gram", "h", "first", "words"), (pa.int64(), pa.binary(), pa.int32(), pa.binary())
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:at + 3000]), kinds)], names=list(names)) for at in range(0, len(rows), 3000)]
    substring_dedup.anchors([b"%d" % k for k in range(100)])
    got = [r for b in substring_dedup._trees(Grouped(), 35)(iter(batches)) for r in b.to_pylist()]
    assert got == [{"h": h, "first": 7, "last": 33} for _, h, _, _ in rows]
    assert max(sizes) < 450_000 and sum(sizes) == 60 * len(rows)
    assert not substring_dedup._HASHES  # the words of an earlier stage are not kept meanwhile
