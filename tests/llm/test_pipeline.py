"""The pipeline: each stage against a brute-force version of its own, on what the stage before it kept."""

import hashlib
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_line_dedup import brute as deduped
from tests.llm.test_ngram_join import brute as linked
from tests.llm.test_quality_rules import estimate, stats, vector
from tokenizers import Tokenizer

from tarnstone.llm import quality_rules as Q

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, component_id string"


def fixture(sf_rows):
    """Documents of the table beside planted ones, with columns that clash with those the operators add."""
    rnd = random.Random(7)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in sf_rows]
    long = [t for _, t, lang, _ in rows if lang == "en" and t and len(set(t.split())) > 120][:6]
    for k, t in enumerate(long):
        w = t.split()
        # The same words in other lines: no line has a near copy, but the documents have.
        broken = [" ".join(w[i : i + 37]) for i in range(11, len(w), 37)]
        rows.append((10_000 + k, "\n".join([" ".join(w[:11]), *broken]), "en", "src0"))
        # Copies, which lose all lines.
        rows.append((20_000 + k, t, "en", "src1"))
    fresh = lambda n: " ".join("".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 8))) for _ in range(n))
    rows += [(30_000, None, "en", "src0"), (30_001, "", None, None), (None, fresh(90), "en", "src0"), (None, fresh(80), "en", "src0"), (None, "too short", "en", "src0")]
    rows += [(30_002, fresh(70), "en", "src0"), (30_002, fresh(75), "en", "src0"), (30_002, "short too", "en", "src0")]
    rows += [rows[3], rows[3]]
    return [Row(*r, len(r[1]) if r[1] is not None else None, 5, "c") for r in rows]


def told(rows, i=1):
    return sorted(((r[0], r[i]) for r in rows), key=repr)


def judged(rows):
    fine = {}
    for r in rows:
        s = stats(r[1])
        if s[0] >= 50 and 100 * s[4] <= 50 * s[0]:
            lang, source = r[2] or "", r[3] or ""
            for g in [(lang, source), (lang,), ()]:
                fine.setdefault(g, []).append(vector(s))
    group = lambda lang, source: (lang, source) if len(fine.get((lang, source), [])) >= Q.LEAST_GROUP else ((lang,) if len(fine.get((lang,), [])) >= Q.LEAST_LANGUAGE else ())
    models, out = {}, []
    for r in rows:
        s = stats(r[1])
        if s[0] < 50 or 100 * s[4] > 50 * s[0]:
            continue
        g = group(r[2] or "", r[3] or "")
        if g not in models:
            models[g] = estimate(fine[g])
        v = np.array(vector(s)) - models[g][0]
        if v @ np.linalg.inv(models[g][1]) @ v <= Q.CUTOFF:
            out.append(r)
    return out


def stages(spark, rows, sf):
    docs = spark.createDataFrame(rows, SCHEMA)
    out = [[tuple(r) for r in docs.collect()]]
    for name, step in corpus_pipeline.STAGES:
        new = step(spark, docs, sf)
        if name != "bpe":
            assert new.columns == docs.columns and [t for _, t in new.dtypes] == [t for _, t in docs.dtypes], name
            docs = new = corpus_pipeline.stage(new, f"test-{name}")
        out.append([tuple(r) for r in new.collect()])
    return out


def test_each_stage(spark, sf):
    given, fine, lined, apart, clean, last = stages(spark, fixture(spark.read.parquet(f"{sf}/documents.parquet").collect()), sf)
    assert len(given) > len(fine) > len(lined) > len(apart) > len(clean) > 0 and len(last) == len(clean)
    assert sorted(fine, key=repr) == sorted(judged(given), key=repr)

    # A document is an id and a text, in that order; texts of one id go by their hashes, which decide among planted texts only.
    texts = sorted({(r[0] if r[0] is not None else -1, r[1]) for r in fine}, key=lambda x: (x[0], x[1]))
    want = deduped(list(enumerate(t for _, t in texts)))
    kept = [(d if d >= 0 else None, "\n".join(want[i])) for i, (d, _) in enumerate(texts)]
    assert set(told(lined)) == {(d, t) for d, t in kept if t.split()}
    assert {r[0] for r in fine} - {r[0] for r in lined} >= {20_000, 20_001} and all(r[4] == len(r[1]) for r in lined)

    texts = sorted({(r[0] if r[0] is not None else -1, r[1]) for r in lined})
    groups = linked(list(enumerate(t for _, t in texts)))
    assert told(apart) == sorted(((d if d >= 0 else None, t) for i, (d, t) in enumerate(texts) if groups[i][1] == i), key=repr)
    assert {10_000, 10_001} <= {r[0] for r in lined} and not {10_000, 10_001} & {r[0] for r in apart}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {i for i, _ in leaks([(i, r[1]) for i, r in enumerate(apart)], items)}
    assert sorted(clean, key=repr) == sorted((r for i, r in enumerate(apart) if i not in bad), key=repr)

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [(r[0], TOKENIZER.encode(r[1], add_special_tokens=False).ids) for r in clean]
    assert sorted(last, key=repr) == sorted(((d, len(i), sha(" ".join(map(str, i))), sha(TOKENIZER.decode(i, skip_special_tokens=False))) for d, i in ids), key=repr)


def test_run_applies_the_stages_in_order(spark, sf, monkeypatch):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "bpe"]
    step = lambda word: lambda spark, docs, sf_dir: docs.filter(F.col("doc_id") % (7 if word == "b" else 3) != 0).withColumn("text", F.concat("text", F.lit(word)))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", step("a")), ("b", step("b")), ("c", lambda spark, docs, sf_dir: docs.select("doc_id", F.right("text", F.lit(2)).alias("end")))])
    got = {r.doc_id: r.end for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {r.doc_id: "ab" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect() if r.doc_id % 3 and r.doc_id % 7}


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, 1, "")], [(1, None, "en", "s", 0, 1, ""), (1, "", "en", "s", 0, 1, ""), (1, "", "en", "s", 0, 1, "")]])
def test_odd_tables(spark, sf, rows):
    """Nothing in: nothing out. Null and empty texts fail the quality rules, and pass every other stage."""
    docs = spark.createDataFrame(rows, SCHEMA)
    steps = dict(corpus_pipeline.STAGES)
    assert steps["quality"](spark, docs, sf).count() == 0
    assert steps["line_dedup"](spark, docs, sf).count() == steps["decontamination"](spark, docs, sf).count() == steps["bpe"](spark, docs, sf).count() == len(rows)
    assert steps["near_duplicates"](spark, docs, sf).count() == len({r[:1] for r in rows})
