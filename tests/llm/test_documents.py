"""Document operators against their plain versions, and their defined results on odd tables."""

import math
import time
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowwarden.llm import compression, contamination, debruijn, mixing, pii, pseudo_likelihood, queries, simhash, tokens, toxicity
from flowwarden.llm.components import roots
from tests.llm import brute

ITEMS = [(1, "w1x w2x w3x"), (2, None), (3, "..."), (4, "ONE two"), (5, "one two three"), (None, "tail")]


@pytest.fixture(scope="module")
def items(spark, rows):
    long = " ".join(brute.words(rows[9][1])[10:40])
    return [*ITEMS, (6, long), (7, long.upper()), (7, "more " + long)]


@pytest.fixture(scope="module")
def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for bits in (1, 3, 8, 13, 16, 17, 31, 32):
        ids = rng.integers(0, 1 << bits, 70_001).astype("<u4")
        payload = tokens.pack(ids, bits)
        assert len(payload) == -(-len(ids) * bits // 8)
        assert (tokens.unpack(payload, bits, len(ids)) == ids).all()
        assert (tokens.unpack(payload, bits, 40, 33_333) == ids[33_333:33_373]).all()
    assert tokens.bits_for(49_408) == 16 and tokens.bits_for(2) == 1 and tokens.bits_for(65_537) == 17


def test_tokens(spark, docs, rows, empty, odd, tmp_path):
    from tokenizers import Tokenizer

    path = str(tmp_path / "t")
    tokens.write_tokens(docs, path, queries.TOKENIZER)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.read_documents(spark, path).collect()}
    plain = Tokenizer.from_file(queries.TOKENIZER)
    assert got == brute.tokens(pairs(rows), plain)
    whole = [i for _, t in pairs(rows) for i in [*plain.encode(t or "", add_special_tokens=False).ids, 2]]
    blocks = tokens.read_blocks(spark, path)
    assert tokens.read_ids(blocks, 40_000, 500) == whole[40_000:40_500]
    assert tokens.encode_documents(empty, queries.TOKENIZER).count() == 0
    assert tokens.encode_documents(odd, queries.TOKENIZER).count() == odd.count()


def test_word_memory_equals_whole_texts(spark, tiny, monkeypatch):
    own = tokens.Encoder(open(queries.TOKENIZER, encoding="utf-8").read())
    texts = [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").select("text").limit(40).collect()]
    texts += ["it's <|endoftext|> we'll ÅÀ é́ ΣΑΣ x y z \x1c a\x0bb", "don't'll''s 12 3,4"]
    texts += [None, "", " \n", "a### b%%%. c$$$, (d) e_f e_ f<| g|> h--' i!'s \xa0 j\u2003k "]
    whole = [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    ids, lengths = own.encode(pa.array(texts), 7)
    assert ids.tolist() == [i for w in whole for i in [*w, 7]] and lengths.tolist() == [len(w) + 1 for w in whole]
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    again = [own.encode(pa.array([t], pa.string()), 7) for t in texts]
    assert [i.tolist() for i, _ in again] == [[*w, 7] for w in whole]
    assert [len(x) for x in own.encode(pa.array([], pa.string()), 7)] == [0, 0]


def test_repeats(docs, rows, empty, odd):
    got = {r.doc_id: r.kept for r in debruijn.with_kept_words(docs).collect()}
    want = brute.repeats([r[1] for r in rows])
    assert [(got[i].n_words, got[i].n_removed, got[i].kept_sha256) for i in range(len(rows))] == want
    assert debruijn.with_kept_words(empty).count() == 0
    kept = debruijn.with_kept_words(odd).collect()
    plain = Counter(brute.repeats([r.text for r in odd.collect()]))
    assert Counter((r.kept.n_words, r.kept.n_removed, r.kept.kept_sha256) for r in kept) == plain


@pytest.mark.parametrize("seed", range(6))
def test_repeats_in_tangled_texts(spark, seed):
    """Small vocabularies and loops, so that paths branch and repeat themselves."""
    rng = random.Random(seed)
    parts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))) for _ in range(6)]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(25)] + ["a " * 90, "a b " * 40]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for window, k in ((35, 16), (8, 4)):
        got = {r.doc_id: r.kept for r in debruijn.with_kept_words(frame, window=window, k=k).collect()}
        assert [(got[i].n_words, got[i].n_removed, got[i].kept_sha256) for i in range(len(texts))] == brute.repeats(texts, window)


def test_without_repeats_keeps_texts_and_columns(docs, rows, odd):
    out = {r.doc_id: r.text for r in debruijn.without_repeats(docs).collect()}
    assert out[10] == "" and out[0] is None and out[8] == rows[8][1]
    assert debruijn.without_repeats(odd).columns == odd.columns


PERSONAL = [
    "mail a.b+c@d-e.co.uk, x@y, a@b.c_d@e.f @x.y p@q..r", "1.2.3.4 256.1.1.1 001.002.003.004 1.2.3.4.5.6.7.8 0000255.0.0.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 or 79927398713 1234567812345670", "+1 (555) 010-9999 +12 +49.30.1234567- ++1 23456789",
    "\U0001f600 é a@b.de 10.0.0.1 +33 1 23 45 67 89", "IBAN DE89 3704 0044 0532 0130 00 and DE88370400440532013000 GB82WEST12345698765432",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "9" * 5000 + " " + "a.b" * 3000 + "@x", "1." * 4000, "a@" + "b." * 4000 + "c", None, "", "+1" + " " * 300,
]


def test_personal_data(spark):
    frame = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id bigint, text string")
    for r in pii.with_spans(frame).collect():
        found = [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE]
        assert found == brute.personal(r.text), r.text
        assert all((r.text or "")[s.start:s.end] == s.value for s in r.spans)
    ibans = [s.value for r in pii.with_spans(frame).collect() for s in r.spans if s.kind == "iban"]
    assert ibans == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]


def test_context_moves_the_score_and_masks(spark):
    frame = spark.createDataFrame([("call tel +49 30 1234567",), ("order +49 30 1234567",), ("x +49 30 1234567 y",), (None,)], "text string")
    spans = pii.with_spans(frame)
    scores = [r.spans[0].score for r in spans.collect() if r.text]
    assert scores[0] > scores[2] > scores[1]
    masked = [r.text for r in pii.masked(spans).collect()]
    assert masked == ["call tel [PHONE]", "order +49 30 1234567", "x [PHONE] y", None]


def test_context_admits_added_kinds(spark):
    key = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    frame = spark.createDataFrame([(f'token = "{key}" x',), (f"commit {key}",), (key,), ("api key " + "x" * 40,), ("SSN 123-45-6789",),
                                   ("123-45-6789",), ("ssn 666-45-6789 900-12-3456 123-00-1111",), (f"{key}-token-{key}",)], "text string")
    got = [[(s.kind, s.value) for s in r.spans] for r in pii.with_spans(frame).collect()]
    assert got == [[("secret", key)], [], [], [], [("ssn", "123-45-6789")], [], [], []]


def test_many_matches_in_one_text(spark):
    """Positions over many blocks agree with the plain version, in time that follows the matches."""
    text = " ".join(f"\u00e9{i % 7}@b.de 10.0.{i % 300}.1" for i in range(20_000))
    begin = time.time()
    row = pii.with_spans(spark.createDataFrame([(text,)], "text string")).first()
    assert [(s.kind, s.start, s.end) for s in row.spans] == brute.personal(text) and len(row.spans) > 30_000
    assert time.time() - begin < 60


def test_personal_data_on_odd_tables(odd, empty):
    assert pii.with_spans(odd, "found").columns == [*odd.columns, "found"]
    assert pii.with_spans(odd, "found").count() == odd.count() and pii.with_spans(empty).count() == 0


def test_compression(docs, rows, odd, empty):
    got = {r.doc_id: r.figures for r in compression.with_figures(docs).collect()}
    for i, text in pairs(rows):
        f = got[i]
        assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed) == brute.base_figures(text)
        assert not (f.base_failed and f.kept)
    assert not got[0].kept and not got[7].kept
    assert compression.with_figures(odd).count() == odd.count() and compression.with_figures(empty).count() == 0


def test_compression_bands():
    import random as r
    import zstandard

    rng, press = r.Random(3), zstandard.ZstdCompressor(level=3)
    prose = " ".join("".join(rng.choice(["the", "er", "in", "on", "at", "ion", "ed", "s"]) for _ in range(rng.randrange(1, 4))) for _ in range(900))
    noise = bytes(rng.randrange(33, 127) for _ in range(6000))
    assert compression.verdict(prose.encode(), press)[3]
    assert not compression.verdict(b"again and again " * 300, press)[3]
    assert not compression.verdict(noise, press)[3]
    assert not compression.verdict(prose[:3000].encode() + b"loop the loop " * 400, press)[3]


def test_contamination(docs, rows, benchmark, items, odd, empty, spark):
    want = brute.contamination(pairs(rows), [(i if i is not None else "", t) for i, t in items])
    for size in (10, 1_000_000):
        got = {r.doc_id: r.matches for r in contamination.with_matches(docs, benchmark, part_words=size).collect()}
        assert {i: (m.n_words, m.n_hit, m.n_items, m.items_sha256, m.contaminated) for i, m in got.items()} == want
    kept = contamination.decontaminate(docs, benchmark)
    assert {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if not w[4]} and kept.columns == docs.columns
    cut = {r.doc_id: r.text for r in contamination.decontaminate(docs, benchmark, "cut").collect()}
    assert all(cut[i] == t for i, t in pairs(rows) if not want[i][4]) and cut[5] == ""
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert contamination.decontaminate(odd, none).count() == odd.count()
    assert contamination.with_matches(empty, benchmark).count() == 0
    assert contamination.with_matches(odd, benchmark, "m").columns == [*odd.columns, "m"]


def test_contamination_takes_one_python_step(docs, benchmark):
    # A second one in the same task is a second worker, which stays in memory beside the tasks of later stages.
    for df in (contamination.with_matches(docs, benchmark), contamination.decontaminate(docs, benchmark)):
        assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_contamination_adds_up_the_spans_of_all_parts(spark):
    found = [[(5, 9), (0, 3), (3, 4)], [(2, 4), (2, 3), (1, 9), (9, 9)], [(7, 8)], []]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(found)], "id int, spans array<struct<start: bigint, end: bigint>>")
    got = {r.id: (r.s.n_hit, r.s.longest) for r in df.select("id", contamination._summary(F.col("spans")).alias("s")).collect()}
    assert got == {0: (8, 4), 1: (8, 8), 2: (1, 1), 3: (0, 0)}


def test_automaton_against_windows():
    rng = random.Random(2)
    for _ in range(60):
        items = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 12)))) for i in range(5)]
        text = " ".join(rng.choice("abc") for _ in range(60))
        own = contamination.Automaton([(str(i), contamination.words_of(t.encode())) for i, t in items], 4)
        spans, found = own.spans(contamination.words_of(text.encode()))
        want = brute.contamination([(0, text)], items, 4)[0]
        assert (sum(b - a for a, b in spans), len(found)) == want[1:3]


def test_mixing(docs, rows, odd, empty):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(brute.words(r[1]))
    want = brute.targets(sizes)
    got = mixing.with_takes(docs).collect()
    taken = Counter()
    for r in got:
        m = r.mix
        assert m.size == len(brute.words(r.text)) and m.source_size == sizes[r.source]
        assert math.isclose(m.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert m.taken in (0, m.size, 2 * m.size) and len(m.shards or []) == (m.times if m.size else 0)
        taken[r.source] += m.taken
    # The very long text is half of its source; the others have small blocks.
    for s in sizes:
        biggest = max(len(brute.words(r[1])) for r in rows if r[3] == s)
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], biggest / 2)
    again = {r.doc_id: r.mix for r in mixing.with_takes(docs.repartition(3)).collect()}
    assert again == {r.doc_id: r.mix for r in got}
    parts = Counter(p for r in got for p in set(r.mix.shards or []))
    assert len(parts) > 1 and max(parts) < mixing.SHARDS
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.mix.times for r in got if r.mix.times})
    assert mixing.with_takes(empty).count() == 0 and mixing.with_takes(odd).count() == odd.count()
    assert mixing.mix(odd).columns == odd.columns


def test_long_blocks_do_not_end_the_draw(spark):
    """400 of 2000 words are met exactly by eight blocks of 50, wherever the block of 1000 stands."""
    blocks = [(f"s{s}", b, 1000 if b == 0 else 50) for s in range(20) for b in range(21)]
    plan = spark.createDataFrame([(f"s{s}", 2000, 400.0) for s in range(20)], "source string, source_size bigint, target double")
    drawn = mixing.draw_blocks(spark.createDataFrame(blocks, "source string, block int, words bigint"), plan, 17).collect()
    assert min(r.place for r in drawn if r.block == 0) < 8
    for s in range(20):
        assert sum(r.times * r.words for r in drawn if r.source == f"s{s}") == 400


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 70}, {"a": 0, "b": 0}, {"é": 5, "z": 5, "Z": 50, "zz": 1}, {"a": 1}):
        plan = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint"))
        got, want = {r.source: r.target for r in plan.collect()}, brute.targets(sizes)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


def test_split_tree():
    counts = np.array([5, 0, 130, 64, 1])
    out = mixing.split_tree(counts, 16, 3)
    assert (out.sum(axis=0) == counts).all() and out.min() >= 0
    assert out.sum(axis=1).max() - out.sum(axis=1).min() <= 4
    assert (out == mixing.split_tree(counts, 16, 3)).all() and (out != mixing.split_tree(counts, 16, 4)).any()


def test_simhash(docs, rows, odd, empty):
    want = brute.classes({i: brute.fingerprint(t) for i, t in pairs(rows)})
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.classes(docs).withColumn("fp", simhash.hex_of(F.col("point"))).collect()}
    assert got == want
    kept = simhash.near_duplicates(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()}) and kept.columns == docs.columns
    assert simhash.classes(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0
    once = simhash.near_duplicates(odd).collect()
    assert len(once) == len({c for _, c in brute.classes({i: brute.fingerprint(r.text) for i, r in enumerate(odd.collect())}).values()})
    assert once[0].__fields__ == odd.columns


def test_links_in_crowded_cells(spark):
    """Chains and dense groups of fingerprints, with cells cut into blocks."""
    rng = random.Random(4)
    points = set()
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 30)):
            points.add(p)
            for _ in range(rng.randrange(0, 5)):
                p ^= 1 << rng.randrange(64)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    frame = spark.createDataFrame([(p,) for p in signed], "point bigint")
    want = brute.classes({p: p & ((1 << 64) - 1) for p in signed})
    for size in (3, 512):
        found = {r.node: r.root for r in roots(simhash.links(frame, cell_rows=size)).collect()}
        assert {p: found.get(p, p) for p in signed} == {p: c for p, (_, c) in want.items()}
    with pytest.raises(ValueError):
        simhash.links(frame, distance=5)


def test_forest_is_linear_in_links():
    points = np.array(sorted({sum(1 << b for b in (i, j)) for i in range(30) for j in range(30)}), np.uint64)
    assert len(simhash.forest(points, 4)) == len(points) - 1


def test_components(spark):
    rng = random.Random(8)
    chain = [(i, i + 1) for i in range(60)]
    edges = chain + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(500, n) for n in range(400, 480)]
    found = {r.node: r.root for r in roots(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {n: n for e in edges for n in e}
    for _ in range(300):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert {n: found.get(n, n) for n in parent} == parent


WORDS = ["river", "stone", "window", "garden", "paper", "little", "morning", "summer", "doctor", "market"]


@pytest.fixture(scope="module")
def talk(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = " ".join(rng.choice(WORDS) for _ in range(40)) + (" you idiot and moron" if toxic else " you friend and doctor")
        docs.append((i, text))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxicity(spark, talk, odd, empty):
    docs, labels = talk
    model = toxicity.fit(docs, labels)
    score = {r.doc_id: r.score for r in toxicity.with_scores(docs, model).collect()}
    assert all((s >= 0.5) == (i % 4 == 0) for i, s in score.items())
    base = " ".join(WORDS * 3)
    hidden = ["1d10t m0r0n", "i.d.i.o.t m-o-r-o-n", "you i d i o t and m o r o n", "idiooooot mooooron", "id!ot m*ron", "IDIOT! MORON!"]
    probe = spark.createDataFrame([(base + " " + h,) for h in hidden] + [(base,), (None,), ("",), ("1 2 3 4 2024 b2b http://x.y/z?q=1",)], "text string")
    found = [r.score for r in toxicity.with_scores(probe, model).collect()]
    assert min(found[:len(hidden)]) >= 0.5 and max(found[len(hidden):]) < 0.5
    assert toxicity.with_scores(odd, model).count() == odd.count() and toxicity.with_scores(empty, model).count() == 0


def test_restoration():
    counts = Counter(g for w in ["idiot", "moron", "stupid", "the", "and", "this", "hello", "street"] for g in toxicity.grams(w))
    model = toxicity.CharModel(counts)
    for shown, word in (("1d10t", "idiot"), ("st*pid", "stupid"), ("m0r0n", "moron"), ("stuuupid", "stupid"), ("5tr33t", "street"), ("i-d-i-o-t", "idiot")):
        assert toxicity.restore(shown, model) == [word]


def test_restoration_of_long_and_split_words():
    words = ["you", "are", "a", "stupid", "idiot", "moron", "the", "and", "this", "hello", "street"]
    own = toxicity.Restorer(toxicity.CharModel(Counter(g for w in words for g in toxicity.grams(w))))
    for shown, word in [("st" + 40 * "u" + "pid", "stupid"), ("st-upid", "stupid"), ("st.u.p.id", "stupid"), ("i/d/i/o/t", "idiot"),
                        ("id,iot", "idiot")]:
        assert word in own.word(shown.encode()) and shown in own.word(shown.encode()), shown
    assert {"stupid", "idiot"} <= set(own.word(b"y-o-u-a-r-e-a-s-t-u-p-i-d-i-d-i-o-t"))
    assert {"this", "street"} <= set(own.word(b"this/street"))
    # Chains of any length are walked and released without recursion.
    assert len(toxicity.restore("s-t-u-p-i-d-" * 2000, own.model)) > 1


def test_toxicity_never_reads_held_out_labels(spark, talk):
    docs, labels = talk
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, flipped)
    nobody = labels.filter("false")
    assert toxicity.fit(docs, nobody).constant == 0.0
    assert toxicity.fit(docs, labels.withColumn("toxic", F.lit(1))).constant == 1.0
    assert toxicity.fit(docs.filter("false"), labels).constant == 0.0


def test_char_counts_of_long_words(spark):
    """Words of any length are counted, and settling in between changes nothing."""
    texts = ["ab" * 40 + " cat", None, "cat " + "z" * 500]
    got = toxicity.char_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    want = Counter(g for t in texts if t for w in t.split() for g in toxicity.grams(w))
    assert got == dict(want)


def test_pseudo_likelihood(spark, docs, odd, empty):
    rng = random.Random(6)
    order = " ".join(["red green blue"] * 30)
    texts = [order] * 400 + [None, ""]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    model = pseudo_likelihood.train(own, rounds=1)
    mixed = order.split()
    rng.shuffle(mixed)
    probe = spark.createDataFrame([(order,), (" ".join(mixed),), (None,), ("",)], "text string")
    scores = [r.likelihood for r in pseudo_likelihood.with_likelihoods(probe, model).collect()]
    assert scores[0].mean > scores[1].mean + 0.3
    assert [(s.n_tokens, s.log_likelihood, s.mean) for s in scores[2:]] == [(0, 0.0, None)] * 2
    assert pseudo_likelihood.with_likelihoods(odd, model).count() == odd.count()
    none = pseudo_likelihood.train(empty)
    assert pseudo_likelihood.with_likelihoods(docs, none).count() == docs.count()


def test_likelihood_lexicon(spark):
    """Shares of all words of a class, and of one unseen word, add up to one; a rarer word costs more; the bound raises the least count."""
    rng = random.Random(8)
    frequent = [f"the{i}x" for i in range(pseudo_likelihood.FREQUENT)]
    listed, rare = [f"w{i}ing" for i in range(300)], [f"r{i}ing" for i in range(40)]
    words = frequent * 50 + [w for i, w in enumerate(listed) for _ in range(5 + i % 20)] + rare
    rng.shuffle(words)
    docs = spark.createDataFrame([(" ".join(words[i:i + 97]),) for i in range(0, len(words), 97)], "text string").repartition(3)
    lexicon, counts = pseudo_likelihood.vocabulary(docs)
    assert sorted(lexicon.words) == sorted(w.encode() for w in frequent) and counts.sum() == len(words) and len(lexicon.hashes) == 300
    classes, shares = lexicon.look_up([w.encode() for w in [*listed, *rare, "neverseening"]])
    assert len(set(classes)) == 1 and math.isclose(np.exp(shares.astype(float)).sum(), 1, rel_tol=1e-5)
    n = counts[classes[0]]
    assert np.allclose(np.exp(shares[:300].astype(float)), [(5 + i % 20) / (n + 1) for i in range(300)], rtol=1e-5)
    assert shares[300] == shares[-1] < shares[0] < shares[19]
    small, _ = pseudo_likelihood.vocabulary(docs, most=200)
    assert len(small.hashes) == sum(5 + i % 20 >= 20 for i in range(300))  # 225 words reach 10, 75 reach 20
    assert math.isclose(np.exp(small.look_up([w.encode() for w in [*listed, *rare, "neverseening"]])[1].astype(float)).sum(), 1, rel_tol=1e-5)
    texts = [b"", b"the1x W3ING r2ing the1x", b"nowhere"]
    first = list(pseudo_likelihood.Encoder(lexicon).texts(texts))
    forgetful = pseudo_likelihood.Encoder(lexicon, remembered=0)
    assert first == [next(forgetful.texts([t])) for t in texts] and first[0] == (b"", 0.0)
    assert math.isclose(first[1][1], shares[3] + shares[302], rel_tol=1e-5) and first[1][0][0] == lexicon.words.index(b"the1x")


def test_likelihood_lexicon_in_slices(spark):
    """A lexicon that is too large to hold at once gives every word the share it has in a whole one; the least count stays."""
    rng = random.Random(3)
    words = [f"the{i}x" for i in range(pseudo_likelihood.FREQUENT)] * 40 + [f"w{i}ing" for i in range(300)] * 5 + [f"r{i}ing" for i in range(20)]
    rng.shuffle(words)
    texts = [" ".join(words[i:i + 61]) for i in range(0, len(words), 61)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "", "W7ING never r3ing"])], "doc_id long, text string").repartition(3)
    whole, counts = pseudo_likelihood.vocabulary(docs)
    cut, again = pseudo_likelihood.vocabulary(docs, together=70)
    assert whole.table is None and cut.slices == 5 and (counts == again).all()
    assert sorted(h for part in cut.parts() for h in part.hashes) == sorted(whole.hashes) and len(whole.hashes) == 300
    one, many = ({r.doc_id: r.ids for r in pseudo_likelihood.encode(docs, x).collect()} for x in (whole, cut))
    assert one.keys() == many.keys() and all(one[k].classes == many[k].classes for k in one)
    assert all(math.isclose(one[k].shares, many[k].shares, rel_tol=1e-12) for k in one)
    assert pseudo_likelihood.encode(docs, cut).columns == ["doc_id", "text", "ids"]


def test_likelihood_of_rare_words(spark):
    """Words far below the frequent ones: a text in which kinds of words take turns scores above the same words shuffled."""
    rng = random.Random(9)
    kinds = [[f"{rng.randrange(10**6)}{end}" for _ in range(400)] for end in ("ing", "ous", "ly")]

    def turns() -> list[str]:
        return [rng.choice(kinds[i % 3]) for i in range(90)]

    docs = spark.createDataFrame([(" ".join(turns()),) for _ in range(500)], "text string").repartition(4)
    model = pseudo_likelihood.train(docs, rounds=1)
    probe = turns()
    mixed = probe[:]
    rng.shuffle(mixed)
    scores = [r.likelihood for r in pseudo_likelihood.with_likelihoods(
        spark.createDataFrame([(" ".join(probe),), (" ".join(mixed),)], "text string").coalesce(1), model).collect()]
    assert scores[0].mean > scores[1].mean + 0.1


def test_likelihood_gradient():
    """A step lowers the loss; log probabilities and gradients agree with a softmax written out and with differences."""
    rng = np.random.default_rng(0)
    net = pseudo_likelihood.Network.start(np.ones(pseudo_likelihood.SIZE))
    ids, sides = pseudo_likelihood.neighbours([rng.integers(0, 200, 300), rng.integers(0, 200, 5)])
    assert sides[0][0] == sides[1][0] == pseudo_likelihood.EDGE and sides[2][0] == ids[1] and sides[1][300] == pseudo_likelihood.EDGE
    before = net.log_probabilities(ids, sides)
    z = net.hidden(sides).astype(float) @ net.out + net.bias
    assert np.allclose(before, z[np.arange(len(z)), ids] - np.log(np.exp(z).sum(axis=1)), atol=1e-4)
    near, out, bias = net.gradient(ids, sides)
    for parameters, gradient, at in ((net.near, near, (1, 7, 3)), (net.out, out, (2, int(ids[0]))), (net.bias, bias, (int(ids[1]),))):
        parameters[at] += 0.05
        up = net.log_probabilities(ids, sides).mean()
        parameters[at] -= 0.1
        down = net.log_probabilities(ids, sides).mean()
        parameters[at] += 0.05
        assert math.isclose((down - up) / 0.1, gradient[at], rel_tol=0.05, abs_tol=2e-5)
    pseudo_likelihood.Steps(net, 0.1).take(ids, sides)
    assert net.log_probabilities(ids, sides).mean() > before.mean()


def test_candidates_hash_the_words_once(monkeypatch):
    """Windows' owners and edges come from one pass over the k-mers, and edges stay in order and distinct."""
    rng = np.random.default_rng(4)
    words = debruijn.Words(b" ".join(b"w%d" % i for i in rng.integers(0, 30, 400)), {})
    at, hashes = debruijn.edges_of(words)
    views = np.lib.stride_tricks.sliding_window_view(words.spans(np.arange(385), 16, debruijn._BASES[0]), 20)
    assert at.tolist() == np.unique(views.argmin(axis=1) + np.arange(len(views))).tolist() and len(hashes) == len(at)
    passes, spans = [], debruijn.Words.spans
    monkeypatch.setattr(debruijn.Words, "spans", lambda self, *a: passes.append(1) or spans(self, *a))
    starts, _ = debruijn.candidates(words, at, np.zeros(len(at), bool), 35, 16)
    assert starts.tolist() == list(range(366)) and len(passes) == 1
