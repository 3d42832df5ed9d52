"""Mixing, join, language, packing, scoring and token rows against plain versions."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gazeframe.llm import components, jaccard, language, mixing, packing, queries, shingles, token_rows
from gazeframe.llm.tokens import default_path

SF = "/root/testdata/sf0.001"


def documents(spark, sf=SF):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def shingle_set(text, n=4):
    w = (text or "").encode().lower().split()
    return set(zip(*(w[i:] for i in range(n)))) if len(w) >= n else ({tuple(w)} if w else set())


def plain_components(sets, percent):
    label = {k: k for k in sets}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    return {k: top(k) for k in names}


def near_copies(seed, bases=6, copies=30):
    rng, docs = random.Random(seed), {}
    shared = [f"p{i}" for i in range(40)]
    for b in range(bases):
        size = rng.choice([3, 6, 12, 30, 120])
        base = [f"b{b}w{rng.randrange(10_000)}" for _ in range(size)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(size)] = f"e{rng.randrange(100)}"
            if rng.random() < 0.2:
                words += shared
            docs[len(docs)] = " ".join(words)
    return docs


def test_join_against_brute_force(spark):
    for seed, slice_rows in ((1, 256), (2, 5)):
        docs = near_copies(seed)
        df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
        made = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(df, slice_rows=slice_rows).collect()}
        sets = {k: shingle_set(t) for k, t in docs.items()}
        want = plain_components(sets, 85)
        assert made == {k: (len(sets[k]), want[k]) for k in docs}


def test_join_of_five_words_at_eighty(spark):
    docs = near_copies(3)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    made = {r.doc_id: r.component_id for r in jaccard.classes(df, length=5, percent=80).collect()}
    assert made == plain_components({k: shingle_set(t, 5) for k, t in docs.items()}, 80)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), max_size=14), max_size=25), st.sampled_from([50, 80, 85, 100]))
def test_tree_finds_all_links(sets, percent):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    want = plain_components({i: s for i, s in enumerate(sets)}, percent)
    assert jaccard.linked(arrays, percent).tolist() == [want[i] for i in range(len(sets))]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 1 << 62), min_size=1, max_size=60), st.integers(0, 6), st.integers(0, 6), st.randoms())
def test_alike_sets_share_a_key(base, drop, add, rng):
    other = set(rng.sample(sorted(base), max(1, len(base) - drop))) | {rng.randrange(1 << 62) for _ in range(add)}
    both = len(base & other)
    if 100 * both >= 85 * (len(base) + len(other) - both):
        spread = [np.unique(shingles.mix(np.array(sorted(s), np.uint64))) for s in (base, other)]
        key, owner, need = jaccard.keys(spread, jaccard.Sizes(85))
        shared = set(key[owner == 0]) & set(key[owner == 1])
        assert len(shared) >= max(need) >= 1


def test_shingle_sizes():
    texts = ["a B c d", "A b C D", "é É x\x0by z", "", None, "one", "a b c d a b c d"]
    sets, digests = shingles.shingle_sets(pa.array(texts, pa.string()), 4)
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
    assert (digests[0] == digests[1]).all() and (sets[0] == sets[1]).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 120)] + [(7, 7)]
    made = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(made[i] == 0 for i in range(41)) and all(made[j] == 100 for j in range(100, 120))


def test_packing_round_trip(spark):
    tokenizer = Tokenizer.from_file(default_path())
    made = queries.QUERIES["op6_packing"](spark, SF).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in made:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, text in documents(spark):
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 2], 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    fill = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        fill += at
    assert fill / (4096 * len(sequences)) > 0.97


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_patterns_place_every_length(histogram):
    made = packing.patterns(histogram, 64)
    placed = Counter()
    for items, packs in made:
        assert packs > 0 and sum(size * times for size, times in items) <= 64
        for size, times in items:
            placed[size] += times * packs
    assert placed == Counter(histogram)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_matches_a_plain_search(lengths):
    rooms, rows = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in range(len(rooms)) if rooms[r] >= lengths[i]]
        if fits:
            row = min(fits, key=lambda r: rooms[r])
        else:
            rooms.append(50)
            row = len(rooms) - 1
        rooms[row] -= lengths[i]
        rows.append(rooms[row])
    made = token_rows.best_fit(lengths, 50)
    assert sorted(i for row in made for i in row) == list(range(len(lengths)))
    assert len(made) == len(rooms) and sorted(50 - sum(lengths[i] for i in row) for row in made) == sorted(rooms)


def test_token_rows_round_trip(spark):
    tokenizer = Tokenizer.from_file(default_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = defaultdict(dict)
    for r in token_rows.packed_rows(docs, default_path(), length=512, block_tokens=20_000).collect():
        assert len(r.input_ids) == len(r.position_ids) == 512 and r.cu_seqlens[-1] == r.n_tokens
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert r.position_ids[a:b] == list(range(b - a))
            found[doc][start] = r.input_ids[a:b]
    for doc, text in documents(spark):
        joined = [i for start in sorted(found[doc]) for i in found[doc][start]]
        assert joined == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    made = queries.QUERIES["op4_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = made.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


@settings(max_examples=60, deadline=None)
@given(st.text("ab cé1", max_size=60), st.text("ab cdé1", max_size=80))
def test_phrases_match_a_plain_parse(learned, text):
    parser = language.Parser([("x", learned + " a")])
    fold = lambda t: "".join(c for c, keep in zip(*_folded(t)) if keep)
    sample, body, count, at = fold(learned + " a"), fold(text), 0, 0
    while at < len(body):
        size = 1
        while at + size < len(body) and body[at : at + size + 1] in sample:
            size += 1
        count, at = count + 1, at + size
    counts, chars = parser.phrases([text])
    assert chars[0] == len(body) and counts[0, 0] == count


def _folded(text):
    letters = [c.isalpha() for c in text.lower()]
    shown = [c if a else " " for c, a in zip(text.lower(), letters)]
    return shown, [a or i > 0 and letters[i - 1] for i, a in enumerate(letters)]


def test_base_scores_against_plain_counts(spark):
    made = {r.doc_id: r for r in queries.QUERIES["op8_context_tree"](spark, SF).collect()}
    counts = Counter()
    split = {d: [*t.encode().lower().split(), b"\n"] for d, t in documents(spark)}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in split}
    for doc, words in split.items():
        if not held[doc]:
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    for doc, words in split.items():
        r = made[doc]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[doc], len(words), n)
        assert r.n_known == sum(counts[w] > 0 for w in words) and abs(r.base_score - base) < 1e-6


def test_weights_reach_the_target(spark):
    tokens = {"a": 900, "b": 60, "c": 30, None: 10}
    df = spark.createDataFrame([(s, n, 1) for s, n in tokens.items()], "source string, tokens long, docs long")
    made = {r.source: r for r in mixing.weights(df, entropy=0.8, most_epochs=1e9).collect()}
    w = [r.weight for r in made.values()]
    assert abs(sum(w) - 1) < 1e-9 and abs(-sum(x * math.log(x) for x in w) / math.log(4) - 0.8) < 1e-6
    t = made["a"].exponent
    assert all(abs(made[s].weight / made["b"].weight - (n / 60) ** t) < 1e-6 for s, n in tokens.items())
    limited = mixing.weights(df, entropy=0.8, most_epochs=2.0).collect()
    assert max(r.epochs for r in limited) <= 2 + 1e-6
    assert min(r.epochs for r in mixing.weights(df, keep_all=True, most_epochs=3.0).collect()) > 1 - 1e-9


def test_mixture_meets_its_budgets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn(
        "source", F.when(F.col("doc_id") % 3 == 0, "src0").otherwise(F.col("source"))
    )
    size = {r.doc_id: len((r.text or "").split()) + 1 for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    made = mixing.mixture(docs, block_tokens=2_000, slices=64).collect()
    plan = Counter()
    for d, n in size.items():
        plan[source[d]] += n
    table = spark.createDataFrame([(s, n, 1) for s, n in plan.items()], "source string, tokens long, docs long")
    weights = {r.source: r for r in mixing.weights(table).collect()}
    dealt, seen = Counter(), Counter()
    for r in made:
        dealt[r.source] += size[r.doc_id]
        seen[r.doc_id, r.epoch] += 1
        assert 0 <= r.mix_key <= 1
    assert max(seen.values()) == 1
    for s, w in weights.items():
        assert w.budget * 0.8 <= dealt[s] <= w.budget + 1e-6
        whole = math.floor(w.epochs + 1e-9)
        assert all(seen[d, e] == 1 for d in source if source[d] == s for e in range(whole))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(components.written(stage(spark, kept[-1], "/root/testdata/sf0.01"), "test"))
    assert all(k.columns == docs.columns for k in kept[1:-1])
    good = {r.doc_id for r in queries.QUERIES["op1_quality"](spark, "/root/testdata/sf0.01").where("kept").collect()}
    assert {r.doc_id for r in kept[1].collect()} == good
    sets = {r.doc_id: shingle_set(r.text, 5) for r in kept[1].collect()}
    top = plain_components(sets, 80)
    assert {r.doc_id for r in kept[2].collect()} == {d for d in sets if top[d] == d}
    assert {r.doc_id for r in kept[4].collect()} == {r.doc_id for r in kept[3].collect()}
    copies = Counter(r.doc_id for r in kept[4].collect())
    assert Counter(r.doc_id for r in kept[5].where("start = 0").collect()) == copies
    assert sorted(map(tuple, corpus_pipeline.run(spark, "/root/testdata/sf0.01").select("doc_id", "start", "length").collect())) == sorted(
        map(tuple, kept[5].select("doc_id", "start", "length").collect())
    )
