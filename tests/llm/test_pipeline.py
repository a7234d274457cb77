import re
import zlib

import numpy as np
from pyspark import TaskContext

import corpus_pipeline
from changetree.llm import quality, token_counts

from .test_ngram_join import brute


def test_stages_equal_brute_force(spark, sf):
    """Each stage over what the one before it kept; of the classifier's decisions only that they take effect."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    scored = quality.quality_scores(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in scored.where("predicted = 1").collect()]
    assert 0 < len(rows) < docs.count()
    first = {}
    for i, t in sorted(rows):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), (i, t))
    rows = [*first.values()]
    heads = brute(rows)
    rows = [(i, t) for i, t in rows if heads[i][1] == i]

    def dirty(text):
        words = (text or "").lower().split()
        return any(sum(a == b for a, b in zip(item[max(0, -s) :], words[max(0, s) :])) >= 0.8 * len(item) for _, item in items for s in range(-len(item) + 1, len(words)))

    rows = [(i, t) for i, t in rows if not dirty(t)]
    library, want = Tokenizer.from_file(token_counts.default_tokenizer()), set()
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_idle_workers_of_packing_keep_few_words():
    """Between tasks a worker keeps the words found first, and finds the same ids for the others again."""
    import pyarrow as pa

    from changetree.llm import packing

    path = token_counts.default_tokenizer()
    word = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(4))
    texts = [" ".join(word(200 * k + n) for n in range(200)) for k in range(300)]
    run = packing._cut(path, 4096, 1)
    packing.TaskContext = type("Task", (), {"get": classmethod(lambda cls: cls), "partitionId": classmethod(lambda cls: 0)})
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])
    try:
        first, again = ([x.to_pydict() for x in run(iter([batch]))] for _ in range(2))
        known = packing.ids_of(path).known
        assert first == again and len(known.now) + len(known.old) <= packing.BETWEEN
        known.trim(10)
        assert [*known.all(["the", "zzyx"], packing.ids_of(path).encode)] == [*packing.ids_of(path).encode(["the", "zzyx"])] and len(known.now) <= 12
    finally:
        packing.TaskContext = TaskContext
