"""Each pipeline stage against a plain version, on its own input."""

from collections import Counter

import corpus_pipeline as pipeline
from flowwarden.llm import queries
from flowwarden.llm.common import stored
from tests.llm import brute


def test_stages(spark, tiny):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, stages = docs.columns, dict(pipeline.STAGES)
    seen = {}
    for name in list(stages)[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stored(stages[name](spark, docs, tiny), "test-stage")
        assert docs.columns == columns
        seen[name] = before, [(r.doc_id, r.text) for r in docs.collect()]

    before, after = seen["toxicity"]
    scores = {r.doc_id: r.predicted for r in queries.op3_toxicity(spark, tiny).collect()}
    assert Counter(after) == Counter(d for d in before if not scores[d[0]])

    before, after = seen["near-duplicates"]
    classes = brute.classes({i: brute.fingerprint(t) for i, t in before})
    assert Counter(after) == Counter(d for d in before if classes[d[0]][1] == d[0])

    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    found = brute.contamination(before, items)
    assert Counter(after) == Counter(d for d in before if not found[d[0]][4])

    before, after = seen["mixing"]
    assert set(after) <= set(before) and max(Counter(after).values()) <= 2
    words = sum(len(brute.words(t)) for _, t in before)
    assert abs(sum(len(brute.words(t)) for _, t in after) - 1.5 * words) <= 0.05 * words

    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in stages["tokens"](spark, docs, tiny).collect())
    want, start, plain = [], 0, Tokenizer.from_file(queries.TOKENIZER)
    for i, text in sorted(after):
        own = brute.tokens([(i, text)], plain)[i]
        want.append((i, start, *own[1:]))
        start += own[1]
    assert got == want
