"""The pipeline, stage by stage, against brute force on the smallest documents with odd rows added."""

import collections
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import decontaminate, mixing, near_dup, quality_rules, queries
from ledgerloom.llm.words import WordHasher, shingles
from ledgerloom.session import table, written


def rules_keep(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    if len(w) < 50:
        return False
    c = collections.Counter(zip(w, w[1:], w[2:]))
    cover = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    stop = sum(x.lower() in quality_rules.STOP_WORDS for x in w)
    m = {
        "n_words": len(w), "repeat_ratio": len(cover) / len(w), "mean_word_chars": sum(map(len, w)) / len(w), "stop_ratio": stop / len(w),
        "symbol_ratio": len(re.findall(r"[#*$%&|<>]", t)) / len(w), "dup_line_ratio": (len(lines) - len(set(lines))) / len(lines),
    }
    return all((r.low is None or m[r.metric] >= r.low) and (r.high is None or m[r.metric] <= r.high) for r in quality_rules.RULES)


def one_of_each(rows):
    """The least id of each component of all pairs at or over the threshold."""
    first = {}
    for i, t in sorted(rows):
        first.setdefault(t, i)
    texts = list(first)
    h, ends = WordHasher()(texts)
    words = [h[a:z] for a, z in zip(ends[:-1], ends[1:])]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    sims = near_dup.similarities([(words[i], words[j]) for i, j in pairs])
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, j), s in zip(pairs, sims):
        if s >= 0:
            root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for k, t in enumerate(texts):
        groups[find(k)].append(first[t])
    return {min(g) for g in groups.values()}


def holds_item(items, t):
    h, _ = WordHasher()([t])
    for k in range(len(items.ids)):
        n, size = int(items.k[k]), min(int(items.size[k]), len(h))
        g = shingles(h, n)
        if len(g) and any(items.similarity(k, g[s : s + size - n + 1]) >= 0.8 - 1e-12 for s in range(len(h) - size + 1)):
            return True
    return False


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    clash = spark.createDataFrame([(-1, None, "en", None, 0), (-2, "", "en", "src1", 0)], docs.schema)
    docs = written(docs.unionByName(clash), "test-docs")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), f"test-{name}")
        seen.append(docs.collect())
        if name != "token_codes":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    start = [*table(spark, sf_dir, "documents").collect(), *clash.collect()]
    assert {r.doc_id for r in seen[0]} == {r.doc_id for r in start if rules_keep(r.text)}
    assert sorted(r.doc_id for r in seen[1]) == sorted(one_of_each([(r.doc_id, r.text) for r in seen[0]]))
    bench = table(spark, sf_dir, "benchmark").collect()
    items = decontaminate.Items([r.item_id for r in bench], [r.text for r in bench])
    assert {r.doc_id for r in seen[2]} == {r.doc_id for r in seen[1] if not holds_item(items, r.text)}

    used, total = collections.Counter(), collections.Counter()
    for rows, count in ((seen[3], used), (seen[2], total)):
        for r in rows:
            count[r.source] += r.text.count(" ") + 1
    blocks = spark.createDataFrame([(s, 0, n) for s, n in total.items()], "source string, block int, tokens bigint")
    longest = max(r.text.count(" ") + 1 for r in seen[2])
    for r in mixing.weights(blocks).collect():
        assert 0 <= r.budget - used[r.source] < longest and r.budget >= total[r.source]
    assert {r.doc_id for r in seen[3]} == {r.doc_id for r in seen[2]}

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    at, want = 0, []
    for r in sorted(seen[3], key=lambda r: (r.doc_id, r.text)):
        ids = tok.encode(r.text, add_special_tokens=False).ids + [2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in seen[4]) == sorted(want)


def test_run_is_the_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.agg(F.count_distinct("start")).first()[0] == got.count() > 0
